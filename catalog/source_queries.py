"""Sources and sinks: tables written to a new folder in the shared area and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import tree_queries as tr
from catalog.registry import query
from wardline.functions.scalars import move_text
from wardline.session import checkpoint_dir
from wardline.sources import readers, writers


def new_folder(t) -> str:
    return f"{checkpoint_dir(t.spark).rstrip('/')}/tables-{uuid.uuid4().hex}"


@query("round_trip_csv", """SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS seen, o_totalprice AS value, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS grade
FROM orders WHERE o_totalprice IS NOT NULL""")
def round_trip_csv(t):
    path = new_folder(t)
    shown = t.orders.select(F.col("o_orderkey").alias("Order ID"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("Date Booked In"),
                            F.col("o_totalprice").alias("Numeric Result"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("Grade"))
    writers.write_csv(shown, path)
    spec = readers.SourceSpec(
        columns={"Order ID": "bigint", "Date Booked In": "string", "Numeric Result": "double", "Grade": "string"}, dates=("Date Booked In",),
        rename={"Order ID": "id", "Date Booked In": "seen", "Numeric Result": "value", "Grade": "grade"}, keep=("id", "seen", "value", "grade"), required=("value",))
    return readers.read_readings(t.spark, path, spec)


@query("write_table", "SELECT event_type, count(*) AS n, min(ts) AS first_seen FROM events GROUP BY event_type")
def write_table(t):
    out = t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"))
    return writers.write_table(out, new_folder(t))


@query("read_table", "SELECT event_id, user_id, value FROM events WHERE user_id = 17")
def read_table(t):
    return readers.read_table(t.spark, f"{t.folder}/events.parquet", predicate="user_id = 17").select("event_id", "user_id", "value")


@query("append_run_result", """SELECT event_type, CAST(floor(value / 50) AS BIGINT) AS bin, count(*) AS n, 'wide' AS width, event_type AS run FROM events GROUP BY 1, 2
UNION ALL SELECT event_type, CAST(floor(value / 10) AS BIGINT), count(*), 'narrow', event_type FROM events GROUP BY 1, 2""")
def append_run_result(t):
    path = new_folder(t)
    kinds = ["click", "error", "purchase", "signup", "view"]
    for width, step in (("wide", 50), ("narrow", 10)):
        for kind in kinds:
            rows = t.events.filter(F.col("event_type") == kind).groupBy("event_type", F.floor(F.col("value") / step).alias("bin")).agg(F.count("*").alias("n"))
            writers.append_run_result(rows, path, {"width": width, "run": kind})
    return t.spark.read.schema("event_type string, bin bigint, n bigint, width string, run string").parquet(path)


@query("clean_names", 'SELECT c_custkey AS custkey, c_name AS name, c_acctbal AS "balance" FROM customer')
def clean_names(t):
    return readers.clean_names(t.customer.select("c_custkey", "c_name", "c_acctbal"), {"c_": "", "acctbal": "balance"})


@query("read_opening_book", f"""WITH {tr.SEQ_SQL} SELECT lpad(CAST(depth AS VARCHAR), 3, '0') AS eco, play[1] AS opening, CASE WHEN depth > 1 THEN array_to_string(play[2:], ' ') END AS variation,
{tr.text_sql('play')} AS moves, array_to_string(play, ',') AS play FROM nodes""")
def read_opening_book(t):
    path = new_folder(t)
    nodes = tr.nodes(t)
    variation = F.array_join(F.slice("play", 2, tr.DEPTH), " ")
    text = F.concat(F.lit('[ECO "'), F.lpad(F.col("depth").cast("string"), 3, "0"), F.lit('"]\n[Opening "'), F.col("play")[0], F.lit('"]\n'),
                    F.when(F.col("depth") > 1, F.concat(F.lit('[Variation "'), variation, F.lit('"]\n'))).otherwise(F.lit("")),
                    F.lit("\n"), move_text("play"), F.lit(" *\n"))
    nodes.select(text.alias("value")).write.text(path)
    return readers.read_opening_book(t.spark, path).withColumn("play", F.array_join("play", ","))
