"""Reading delimited files, tables and opening books with declared schemas."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class SourceSpec:
    """What a delimited input holds.

    ``columns`` lists the file's columns in file order with SQL types; a date column is read as
    text and parsed with ``date_format``. ``rename`` gives the final names, ``keep`` the
    columns to keep (final names), ``required`` those that must not be null.
    """

    columns: dict[str, str]
    rename: dict[str, str] = field(default_factory=dict)
    dates: tuple[str, ...] = ()
    date_format: str = "dd/MM/yyyy"
    keep: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    delimiter: str = ","
    null_text: str = "NA"

    def schema(self) -> T.StructType:
        kinds = {c: "string" if c in self.dates else t for c, t in self.columns.items()}
        return T.StructType([T.StructField(c, T._parse_datatype_string(t)) for c, t in kinds.items()])


def read_readings(spark: SparkSession, path: str, spec: SourceSpec) -> DataFrame:
    df = spark.read.csv(path, schema=spec.schema(), header=True, sep=spec.delimiter, nullValue=spec.null_text)
    df = df.withColumns({c: F.try_to_date(F.col(f"`{c}`"), spec.date_format) for c in spec.dates})
    df = rename_columns(df, spec.rename)
    if spec.keep:
        df = df.select(*spec.keep)
    return df.dropna(subset=list(spec.required)) if spec.required else df


def read_table(spark: SparkSession, name: str, jdbc: dict[str, str] | None = None, predicate: str | None = None,
               split: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A database table by JDBC, or a Parquet path; the predicate is pushed to the source.

    ``split`` is (column, lower, upper, parts): without it JDBC reads in one task.
    """
    if jdbc is None:
        df = spark.read.parquet(name)
    else:
        reader = spark.read.format("jdbc").options(**jdbc, dbtable=name)
        if split:
            column, lower, upper, parts = split
            reader = reader.options(partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=parts)
        df = reader.load()
    return df.filter(predicate) if predicate else df


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names) if names else df


def clean_names(df: DataFrame, replacements: dict[str, str]) -> DataFrame:
    """Replace substrings in every column name, e.g. ``{" ": "_", "_val": ""}``."""
    def cleaned(name: str) -> str:
        for old, new in replacements.items():
            name = name.replace(old, new)
        return name

    new = [cleaned(c) for c in df.columns]
    if len(set(new)) != len(new):
        raise ValueError(f"column names collide after cleaning: {sorted(c for c in new if new.count(c) > 1)}")
    return df.toDF(*new)


def read_opening_book(spark: SparkSession, path: str) -> DataFrame:
    """Tagged game text as (eco, opening, variation, moves, play).

    Records are cut at the first tag, so files of any size split over tasks.
    """
    blocks = spark.read.text(path, lineSep="[ECO ").filter(F.col("value").rlike(r'^"'))
    text = F.col("value")

    def tag(name: str):
        return F.nullif(F.regexp_extract(text, rf'\[{name} "([^"]*)"\]', 1), F.lit(""))

    body = F.trim(F.regexp_replace(F.regexp_replace(text, r'(?s)^.*"\]\s*', ""), r"\s+", " "))
    moves = F.trim(F.regexp_replace(body, r"\s*(1/2-1/2|1-0|0-1|\*)\s*$", ""))
    steps = F.split(F.trim(F.regexp_replace(moves, r"\d+\.+\s*", "")), r"\s+")
    return blocks.select(F.regexp_extract(text, r'^"([^"]*)"', 1).alias("eco"), tag("Opening").alias("opening"),
                         tag("Variation").alias("variation"), moves.alias("moves"),
                         F.filter(steps, lambda m: m != "").alias("play"))
