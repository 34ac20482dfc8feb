"""Which container can be turned into which, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Container codes (fixed values).
CODES = ["adf", "extended-adf", "rdb", "hardfile", "gzip", "dms", "scp", "ipf"]


def verdict(source, target):
    """lossless, lossy, not implemented or refused."""
    return (
        F.when(target.isin("ipf", "dms"), "refused").when(target.isin("scp", "gzip", "rdb"), "not implemented")
        .when(target == "extended-adf", F.when(source.isin("adf", "hardfile", "gzip", "extended-adf"), "lossless").otherwise("not implemented"))
        .when(source.isin("gzip", "adf", "hardfile", "rdb"), "lossless").when(source.isin("extended-adf", "scp"), "lossy").otherwise("not implemented")
    )


def matrix(spark: SparkSession) -> DataFrame:
    pairs = spark.createDataFrame([(a, b) for a in CODES for b in CODES if a != b], "source string, target string")
    return pairs.withColumn("verdict", verdict(F.col("source"), F.col("target")))


def verdict_of(source: str, target: str) -> str:
    """verdict() of two codes."""
    if target in ("ipf", "dms"):
        return "refused"
    if target in ("scp", "gzip", "rdb"):
        return "not implemented"
    if target == "extended-adf":
        return "lossless" if source in ("adf", "hardfile", "gzip", "extended-adf") else "not implemented"
    return "lossless" if source in ("gzip", "adf", "hardfile", "rdb") else "lossy" if source in ("extended-adf", "scp") else "not implemented"
