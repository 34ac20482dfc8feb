import struct

import pytest
from pyspark.sql import functions as F

from palimpsest.sources import volumes as V


def put(data, at, *values):
    struct.pack_into(f">{len(values)}I", data, at, *[v & 0xFFFFFFFF for v in values])


def closed(data, field):
    """With the checksum that makes the longs sum to zero."""
    put(data, field, 0)
    put(data, field, -sum(struct.unpack(f">{len(data) // 4}I", data)))
    return bytes(data)


def partition(name, following, low, high):
    p = bytearray(256)
    p[:4], p[0x24], p[0x25 : 0x25 + len(name)], p[0xC0:0xC4] = b"PART", len(name), name, b"DOS\1"
    for at, v in ((0x10, following), (0x14, 1), (0x84, 128), (0x8C, 2), (0x94, 11), (0x98, 2), (0xA4, low), (0xA8, high), (0xBC, -3)):
        put(p, at, v)
    return closed(p, 8)


@pytest.fixture
def images(spark):
    def device(third):
        out = bytearray(512 * 8)
        out[1024:1028] = b"RDSK"
        put(out, 1024 + 16, 512)
        put(out, 1024 + 28, 4)
        out[4 * 512 : 4 * 512 + 256], out[5 * 512 : 5 * 512 + 256] = partition(b"DH0", 5, 2, 9), partition(b"DH1", third, 10, 10)
        return bytes(out)

    ext = b"UAE-1ADF" + struct.pack(">HH", 0, 2) + struct.pack(">HHII", 0, 0, 20, 160) + struct.pack(">HHII", 0, 1, 30, 240) + bytes(40)
    rows = [("whole", device(0xFFFFFFFF)), ("loop", device(4)), ("far", device(900)), ("ext", ext), ("none", b"abc"), ("null", None), ("empty", b"")]
    return spark.createDataFrame(rows, "path string, content binary")


def test_partitions(images):
    got = V.partitions(images).orderBy("path", "seq").collect()
    assert [(r.path, r.name) for r in got] == [(p, n) for p in ("far", "loop", "whole") for n in ("DH0", "DH1")]
    r = got[0]
    assert (r.at, r.first_block, r.blocks, r.block_size, r.reserved, r.priority, r.dostype, r.bootable, r.checksum_valid) == (4, 44, 176, 512, 2, -3, "444F5301", True, True)


def test_tracks_and_blocks(images):
    got = [tuple(r)[1:] for r in V.tracks(images).orderBy("track").collect()]
    assert got == [(0, "sector", 20, 160, 36, True), (1, "raw", 30, 240, 56, False)]
    assert V.blocks(images).where("path = 'whole'").count() == 8 and V.blocks(images).where("path in ('none', 'null', 'empty')").count() == 0


def test_entries_orphans_pointers_and_bitmap(spark):
    e = bytearray(512)
    put(e, 0, 2)
    put(e, 8, 2)
    put(e, 24 + 4 * 70, 31, 30)
    for at, v in ((324, 700), (420, 5000), (424, 61), (428, 150), (500, 880), (508, -3)):
        put(e, at, v)
    e[432], e[433:437] = 4, b"\xc4bcd"
    e = closed(e, 20)
    df = spark.createDataFrame([("a", 1, e), ("a", 5, e), ("a", 6, e), ("b", 5, bytes(512)), ("b", 6, None)], "path string, block bigint, data binary")
    got = V.orphans(df, spark.createDataFrame([("a", 6)], "path string, block bigint")).collect()
    assert [(r.path, r.block) for r in got] == [("a", 5)]
    x = got[0].entry
    assert (x.kind, x.name, x.size, x.parent, x.altered.hour, x.checksum_valid) == ("file", "Äbcd", 700, 880, 1, True)
    assert df.where("block = 5 and path = 'a'").select(V.pointers(F.col("data"))).first()[0] == [30, 31]
    page = bytes(4) + struct.pack(">II", 0xFFFFFFFF ^ 0b101, 0xFFFFFFFE)
    one = spark.createDataFrame([(page,)], "p binary").select(V.allocated(F.col("p"), F.lit(2), F.lit(1000)).alias("a"), V.allocated(F.col("p"), F.lit(2), F.lit(34)).alias("b")).first()
    assert (one.a, one.b) == ([2, 4, 34], [2, 4])


def test_bootblock(spark):
    boot = bytearray(1024)
    boot[:4] = b"DOS\5"
    put(boot, 8, 880)
    total = 0
    for at in range(0, 1024, 4):
        total += struct.unpack_from(">I", boot, at)[0]
        total = total - 0xFFFFFFFF if total > 0xFFFFFFFF else total
    put(boot, 4, ~total)
    rows = spark.createDataFrame([(0, bytes(boot)), (1, bytes(1024)), (2, b"DOS"), (3, None)], "k int, b binary").select("k", V.bootblock(F.col("b")).alias("x")).collect()
    x = {r.k: r.x for r in rows}
    assert (x[0].is_dos, x[0].flags, x[0].ffs, x[0].international, x[0].dircache, x[0].long_names, x[0].checksum_valid, x[0].has_boot_code) == (True, 5, True, True, True, False, True, False)
    assert not x[1].is_dos and x[2] is None and x[3] is None
