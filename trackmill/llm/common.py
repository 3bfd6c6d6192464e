"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITESPACE = b" \t\n\x0b\x0c\r"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares. Where none is set, a local one in local mode, and an error on a cluster, whose executors don't share one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("trackmill.scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="trackmill-")
        spark.conf.set("trackmill.scratch", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: lineage ends here, and a lost executor loses nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def utf8(column: str | Column) -> Column:
    """The text's bytes, empty for null. Python workers get bytes, so that they need not encode them again."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def spare(df: DataFrame, *names: str) -> list[str]:
    """For each name, one that no column of df has, letter case aside."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
