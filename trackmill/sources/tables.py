"""Reading and writing tables of observation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Longest first: a name's unit is told by its ending.
UNITS = (("_m_s2", "m/s^2"), ("_rad_s2", "rad/s^2"), ("_m_s", "m/s"), ("_rad_s", "rad/s"), ("_rad", "rad"), ("_px", "px"), ("_m", "m"), ("_s", "s"))


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of JSON lines under path with a fixed schema, and run_id, the name of the folder each file is in. Blank lines don't count."""
    rows = spark.read.schema(schema).json(path)
    return rows.withColumn("run_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)).dropna("all", subset=schema.fieldNames())


def guarded(c: Column) -> Column:
    """Text that a spreadsheet would take for a formula, with an apostrophe before it."""
    return F.when(c.rlike(r"^[=+@-]"), F.concat(F.lit("'"), c)).otherwise(c)


def csv_ready(df: DataFrame, fields: list[str]) -> DataFrame:
    """The fixed fields in order, null where df lacks one; nested values as JSON, text guarded."""
    kinds = dict(zip(df.columns, (f.dataType for f in df.schema)))
    out = []
    for name in fields:
        kind = kinds.get(name)
        c = F.col(f"`{name}`")
        if kind is None:
            c = F.lit(None).cast("string")
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        elif isinstance(kind, T.StringType):
            c = guarded(c)
        out.append(c.alias(name))
    return df.select(*out)


def write_csv(df: DataFrame, fields: list[str], path: str) -> None:
    csv_ready(df, fields).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def json_ready(df: DataFrame) -> DataFrame:
    """Columns in sorted order, NaN and infinities null."""
    number = (T.DoubleType, T.FloatType)
    c = lambda f: F.when(~F.isnan(f.name) & (F.abs(f.name) < float("inf")), F.col(f.name)).alias(f.name) if isinstance(f.dataType, number) else F.col(f.name)
    return df.select(*[c(f) for f in sorted(df.schema, key=lambda f: f.name)])


def write_jsonl(df: DataFrame, path: str) -> None:
    json_ready(df).write.mode("overwrite").json(path)


def flatten(df: DataFrame) -> DataFrame:
    """Two-vectors as named columns."""
    names = {"raw_center_px": ("raw_x_px", "raw_y_px"), "world_center_m": ("x_m", "y_m"), "predicted_center_px": ("predicted_x_px", "predicted_y_px")}
    out = {n: F.get(F.col(c), i) for c, pair in names.items() if c in df.columns for i, n in enumerate(pair)}
    return df.withColumns(out).drop(*names)


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of each file. Files are hashed where they are read."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def unit_of(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for ending, unit in reversed(UNITS):
        out = F.when(name.endswith(ending), unit).otherwise(out)
    return out


def data_dictionary(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, type, nullable, unit) of all tables."""
    rows = [(t, f.name, f.dataType.simpleString(), f.nullable) for t, df in tables.items() for f in df.schema]
    return spark.createDataFrame(rows, "table string, column string, type string, nullable boolean").withColumn("unit", unit_of(F.col("column")))


def publish_motion(trajectories: DataFrame, videos: DataFrame, headers: dict[str, str]) -> DataFrame:
    """Rows of complete videos that aren't stale, under presentation names."""
    fit = videos.where("state = 'complete' AND NOT stale").select("video_id")
    return trajectories.join(fit, "video_id", "left_semi").withColumnsRenamed(headers)
