"""What lies in an image: blocks, boot blocks, partitions of a device, entry headers, bitmap pages, track tables.

Column expressions and joins only; values that don't parse are null, and faults are columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions import bytes as B
from palimpsest.sources.images import BLOCK, RESERVED

#: Magics in hex, secondary types by kind, the pointer that ends a list.
RDSK, PART, EXTENDED = "5244534B", "50415254", "5541452D31414446"
KINDS = {1: "root", 2: "directory", 3: "soft link", 4: "directory link", -3: "file", -4: "file link"}
END = B.WORD - 1


def blocks(images: DataFrame, size: int = BLOCK) -> DataFrame:
    """path, block, data of each whole block; a rest shorter than a block has no row."""
    n = F.floor(F.octet_length("content") / size).cast("int")
    numbered = images.where(n > 0).select("path", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("block"))
    return numbered.select("path", F.col("block").cast("bigint").alias("block"), F.substring("content", F.col("block") * size + 1, F.lit(size)).alias("data"))


def bootblock(data: Column) -> Column:
    """struct of a volume's first 1024 bytes, null where there are fewer; the root pointer is what the block states."""
    boot, is_dos, flags = F.substring(data, 1, 1024), F.hex(F.substring(data, 1, 3)) == "444F53", B.u8(data, 3)
    fields = F.struct(
        is_dos.alias("is_dos"), flags.alias("flags"), (is_dos & (flags % 2 == 1)).alias("ffs"), (is_dos & flags.between(2, 7)).alias("international"),
        (is_dos & flags.between(4, 5)).alias("dircache"), (is_dos & flags.between(6, 7)).alias("long_names"), (B.u32(data, 4) == B.boot_checksum(boot)).alias("checksum_valid"),
        B.u32(data, 8).alias("stored_rootblock"), F.regexp_like(F.hex(F.substring(data, 13, 1012)), F.lit("[^0]")).alias("has_boot_code"),
    )
    return F.when(F.octet_length(data) >= 1024, fields)


def partitions(images: DataFrame) -> DataFrame:
    """One row for each partition in a device's list: path, seq, at, fields, and whether its checksum holds.

    The device's first block is the first of 16 with its magic. The list ends at its end mark, at 0, at a block that is no partition's, at one met
    before, or after `most`. Images without a device have no row.
    """
    content = F.col("content")
    at = F.filter(F.sequence(F.lit(0), F.lit(15)), lambda k: F.hex(F.substring(content, k * BLOCK + 1, F.lit(4))) == RDSK)
    devices = images.withColumn("_at", F.get(at, F.lit(0)) * BLOCK).where("_at is not null")
    stated = B.u32(content, F.col("_at") + 16)
    devices = devices.select("path", "content", F.when(stated.isin(512, 1024, 2048, 4096), stated).otherwise(BLOCK).alias("_bs"), B.u32(content, F.col("_at") + 28).alias("_first"))

    def step(state: Column, _: Column) -> Column:
        here = state["next"]
        offset = (here * F.col("_bs")).cast("bigint")
        inside = here.isNotNull() & (here != END) & (here > 0) & (offset + 256 <= F.octet_length(content)) & ~F.array_contains(state["seen"], here)
        place = F.when(inside, offset).cast("int")
        good = inside & (F.hex(F.substring(content, place + 1, F.lit(4))) == PART)
        return F.struct(
            F.when(good, B.u32(content, place + 16)).alias("next"), F.when(good, F.concat(state["seen"], F.array(here))).otherwise(state["seen"]).alias("seen")
        )

    start = F.struct(F.col("_first").alias("next"), F.array().cast("array<bigint>").alias("seen"))
    blocks = F.sequence(F.lit(0), (F.octet_length(content) / F.col("_bs")).cast("int"))
    most = F.size(F.filter(blocks, lambda k: F.hex(F.substring(content, k * F.col("_bs") + 1, F.lit(4))) == PART))
    listed = devices.withColumn("_seen", F.aggregate(F.sequence(F.lit(0), most), start, step)["seen"])
    each = listed.select("path", F.posexplode("_seen").alias("seq", "at"), F.substring(content, (F.col("at") * F.col("_bs") + 1).cast("int"), F.lit(256)).alias("p"))
    p = F.col("p")
    surfaces, per_track, low, high, flags = B.u32(p, 0x8C), B.u32(p, 0x94), B.u32(p, 0xA4), B.u32(p, 0xA8), B.u32(p, 0x14)
    return each.select(
        "path", "seq", "at", B.counted_text(p, 0x24, 31).alias("name"), low.alias("low_cylinder"), high.alias("high_cylinder"), (low * surfaces * per_track).alias("first_block"),
        ((high - low + 1) * surfaces * per_track).alias("blocks"), (4 * B.u32(p, 0x84)).alias("block_size"), B.u32(p, 0x98).alias("reserved"), B.i32(p, 0xBC).alias("priority"),
        F.hex(F.substring(p, 0xC1, 4)).alias("dostype"), (flags % 2 == 1).alias("bootable"), B.sums_to_zero(p).alias("checksum_valid"),
    )


def entry(block: Column, size: int = BLOCK) -> Column:
    """struct of an entry header's fields, null where the type words are not an entry's or the block is short."""
    end, kind = size, F.lit(None).cast("string")
    for value, name in KINDS.items():
        kind = F.when(B.i32(block, end - 4) == value, name).otherwise(kind)
    fields = F.struct(
        kind.alias("kind"), B.counted_text(block, end - 80, 30).alias("name"), B.u32(block, end - 188).alias("size"), B.counted_text(block, end - 184, 79).alias("comment"),
        B.u32(block, end - 192).alias("protection"), B.datestamp(*[B.u32(block, end - k) for k in (92, 88, 84)]).alias("altered"), B.u32(block, 8).alias("high_seq"),
        B.u32(block, end - 44).alias("real_entry"), B.u32(block, end - 40).alias("next_link"), B.u32(block, end - 16).alias("hash_chain"),
        B.u32(block, end - 12).alias("parent"), B.u32(block, end - 8).alias("extension"), B.sums_to_zero(block).alias("checksum_valid"),
    )
    return F.when((F.octet_length(block) == size) & (B.u32(block, 0) == 2) & kind.isNotNull(), fields)


def pointers(block: Column, size: int = BLOCK) -> Column:
    """The data blocks that a file's header or list block names, in the file's order: the table is filled from its end."""
    table = size // 4 - 56
    n = F.least(B.u32(block, 8), F.lit(table)).cast("int")
    each = F.transform(F.sequence(F.lit(1), n), lambda i: B.u32(block, 24 + 4 * (table - i)))
    return F.when(n > 0, each).otherwise(F.array().cast("array<bigint>"))


def orphans(found: DataFrame, claimed: DataFrame) -> DataFrame:
    """Files' and directories' headers among blocks (path, block, data) that nothing claims (path, block): path, block, entry."""
    headers = found.where(F.col("block") >= RESERVED).withColumn("entry", entry(F.col("data"))).where(F.col("entry.kind").isin("file", "directory"))
    return headers.join(claimed.select("path", "block").distinct(), ["path", "block"], "left_anti").select("path", "block", "entry")


def allocated(page: Column, first: Column, total: Column) -> Column:
    """Blocks in use by a bitmap page whose bits begin at block `first`; a set bit is a free block, the lowest bit of a long comes first."""
    words = F.slice(B.longs(page), 2, 1 << 20)
    bits = F.transform(words, lambda w, i: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: F.struct((first + 32 * i + b).cast("bigint").alias("block"), F.getbit(w, b).alias("free"))))
    return F.transform(F.filter(F.flatten(bits), lambda x: (x["free"] == 0) & (x["block"] < total)), lambda x: x["block"])


def tracks(images: DataFrame) -> DataFrame:
    """Tracks of extended images: path, track, kind (sector, raw or unknown-N), space, bits, at (where its bytes begin), and whether they lie in the file."""
    content = F.col("content")
    own = images.where(F.hex(F.substring("content", 1, 8)) == EXTENDED).withColumn("_n", B.u16(content, 10).cast("int")).where("_n > 0")
    each = own.select("path", "_n", F.octet_length("content").alias("_size"), F.posexplode(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.substring(content, 12 * i + 13, F.lit(12)))).alias("track", "row"))
    row = F.col("row")
    named = each.select("path", "track", "_n", "_size", F.when(B.u16(row, 2) == 0, "sector").when(B.u16(row, 2) == 1, "raw").otherwise(F.concat(F.lit("unknown-"), B.u16(row, 2).cast("string"))).alias("kind"), B.u32(row, 4).alias("space"), B.u32(row, 8).alias("bits"))
    before = F.coalesce(F.sum("space").over(Window.partitionBy("path").orderBy("track").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = named.withColumn("at", 12 + 12 * F.col("_n") + before)
    return placed.select("path", "track", "kind", "space", "bits", "at", (F.col("at") + F.col("space") <= F.col("_size")).alias("inside"))
