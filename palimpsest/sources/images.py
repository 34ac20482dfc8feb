"""Disk images as rows: reading files, telling containers apart, unpacking gzip, and the volume's root.

Only unpacking needs Python; the rest are column expressions, so a query that doesn't use
the content never reads it.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import bytes as B

#: Block size, blocks before the volume, magics by container.
BLOCK, RESERVED = 512, 2
MAGICS = [("extended-adf", "5541452D31414446"), ("gzip", "1F8B"), ("dms", "444D5321"), ("ipf", "43415053"), ("scp", "534350")]
RDSK, DOS = "5244534B", "444F53"


def read_images(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, size, content of the files at the paths; a folder gives its own files, not those below it.

    Spark's reader passes over files of no bytes, so these have no row.
    """
    return spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(paths).select("path", F.col("length").alias("size"), "content")


def starts_with(data: Column, magic: str) -> Column:
    return F.hex(F.substring(data, 1, len(magic) // 2)) == magic


def floppy_geometry(size: Column) -> Column:
    """struct(cylinders, sectors) of a size that 40 to 84 cylinders of two heads make up, with 11 sectors tried before 22; else null."""
    out = F.lit(None)
    for sectors in (22, 11):
        track = sectors * 2 * BLOCK
        fits = (size % track == 0) & (size >= 40 * track) & (size <= 84 * track)
        out = F.when(fits, F.struct(F.floor(size / track).cast("int").alias("cylinders"), F.lit(sectors).alias("sectors"))).otherwise(out)
    return out


def container(data: Column, size: Column) -> Column:
    """The container's code by magic, a device's first block among 16, size, and boot prefix, in this order; null content is unknown."""
    has_rdsk = F.exists(F.sequence(F.lit(0), F.lit(15)), lambda k: F.hex(F.substring(data, k * BLOCK + 1, F.lit(4))) == RDSK)
    out = F.when(starts_with(data, MAGICS[0][1]), MAGICS[0][0])
    for name, magic in MAGICS[1:]:
        out = out.when(starts_with(data, magic), name)
    by_size = data.isNotNull() & floppy_geometry(size).isNotNull()
    return out.when(has_rdsk, "rdb").when(by_size, "adf").when(starts_with(data, DOS), "hardfile").otherwise("unknown")


def gunzip(data: Column, limit: int = 512 << 20) -> Column:
    """struct(data, error) of a gzip file's first member; output over the limit, a cut file and a wrong checksum are errors, with null data."""

    def one(x: bytes | None) -> tuple[bytes | None, str | None]:
        if x is None:
            return None, None
        unpacker = zlib.decompressobj(31)
        try:
            out = unpacker.decompress(x, limit + 1)
        except zlib.error as e:
            return None, str(e)
        if len(out) > limit:
            return None, "over the limit"
        return (out, None) if unpacker.eof else (None, "truncated")

    @F.pandas_udf("data binary, error string")
    def unpack(xs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in xs], columns=["data", "error"])

    return unpack(data)


def root_number(total_blocks: Column) -> Column:
    """The middle of the volume; the number that the boot block states isn't trusted."""
    return F.floor((F.lit(RESERVED - 1) + total_blocks) / 2).cast("bigint")


def rootblock(block: Column) -> Column:
    """struct of a root block's fields, null where the type words are not a root's or the block is short."""
    stated, most = B.u32(block, 12), BLOCK // 4 - 56
    stamp = lambda at: B.datestamp(B.u32(block, at), B.u32(block, at + 4), B.u32(block, at + 8))
    fields = F.struct(
        B.counted_text(block, BLOCK - 80, 30).alias("name"), F.when((stated > 0) & (stated <= most), stated).otherwise(most).alias("hash_table_size"),
        B.sums_to_zero(block).alias("checksum_valid"), (B.u32(block, BLOCK - 200) == B.WORD - 1).alias("bitmap_flag_valid"),
        stamp(BLOCK - 92).alias("root_altered"), stamp(BLOCK - 40).alias("modified"), stamp(BLOCK - 28).alias("created"),
    )
    return F.when((F.octet_length(block) == BLOCK) & (B.u32(block, 0) == 2) & (B.u32(block, BLOCK - 4) == 1), fields)


def volumes(images: DataFrame) -> DataFrame:
    """path, size, container, rootblock's number and its fields (null: not mounted) of each image; gzip files have to be unpacked before."""
    at = root_number(F.floor(F.col("size") / BLOCK))
    block = F.substring(F.col("content"), (at * BLOCK + 1).cast("int"), F.lit(BLOCK))
    return images.select("path", "size", container(F.col("content"), F.col("size")).alias("container"), at.alias("rootblock"), rootblock(block).alias("volume"))
