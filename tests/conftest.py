import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from wardline.session import configure

    session = (SparkSession.builder.master("local[8]").appName("tests").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8")
               .config("spark.driver.memory", "6g").config("spark.log.level", "ERROR")
               .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="wardline-test-")).getOrCreate())
    yield configure(session)
    session.stop()

