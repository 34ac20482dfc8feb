import gzip
import struct

from pyspark.sql import functions as F

from palimpsest.sources import images as I


def floppy(name=b"Work", cylinders=80, sectors=11, spoil=False):
    total = cylinders * 2 * sectors
    root = bytearray(512)
    for at, value in ((0, 2), (12, 72), (312, 0xFFFFFFFF), (484, 5000), (488, 61), (492, 150), (508, 1)):
        struct.pack_into(">I", root, at, value)
    root[432] = len(name)
    root[433 : 433 + len(name)] = name
    struct.pack_into(">I", root, 20, -sum(struct.unpack(">128I", root)) & 0xFFFFFFFF)
    if spoil:
        root[300] ^= 1
    out = bytearray(total * 512)
    out[:4] = b"DOS\0"
    at = (1 + total) // 2 * 512
    out[at : at + 512] = root
    return bytes(out)


def test_files_containers_and_roots(spark, tmp_path):
    made = {
        "a.adf": floppy(), "hd.adf": floppy(b"Big", sectors=22), "bad.adf": floppy(spoil=True), "zero.adf": bytes(901120), "x.gz": gzip.compress(b"abc"), "x.dms": b"DMS!1", "x.ipf": b"CAPS",
        "x.scp": b"SCP\0", "x.ext": b"UAE-1ADF", "x.rdb": bytes(1024) + b"RDSK" + bytes(100), "x.hdf": b"DOS\1" + bytes(700), "x.txt": b"hello", "empty": b"",
    }
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "no.adf").write_bytes(b"DOS")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in I.volumes(I.read_images(spark, [str(tmp_path)])).collect()}
    assert {k: r.container for k, r in rows.items()} == {
        "a.adf": "adf", "hd.adf": "adf", "bad.adf": "adf", "zero.adf": "adf", "x.gz": "gzip", "x.dms": "dms", "x.ipf": "ipf", "x.scp": "scp", "x.ext": "extended-adf",
        "x.rdb": "rdb", "x.hdf": "hardfile", "x.txt": "unknown",
    }  # fmt: skip  # the reader passes over the empty file
    assert spark.sql("select X'' as b union all select null").select(I.container(F.col("b"), F.lit(0)).alias("c")).distinct().collect()[0].c == "unknown"
    assert {k for k, r in rows.items() if r.volume} == {"a.adf", "hd.adf", "bad.adf"}
    v = rows["a.adf"].volume
    assert (v.name, v.hash_table_size, v.checksum_valid, v.bitmap_flag_valid, rows["a.adf"].rootblock) == ("Work", 72, True, True, 880)
    assert (str(v.created.date), v.created.hour, v.created.minute, v.created.second) == ("1991-09-10", 1, 1, 3)
    assert not rows["bad.adf"].volume.checksum_valid and rows["hd.adf"].rootblock == 1760


def test_gunzip(spark):
    whole = gzip.compress(b"abc" * 1000)
    wrong = whole[:-8] + b"\0\0\0\0" + whole[-4:]
    df = spark.createDataFrame([(0, whole), (1, whole[:-5]), (2, wrong), (3, b"no"), (4, None)], "k int, b binary")
    got = {r.k: (r.g.data, r.g.error) for r in df.select("k", I.gunzip(F.col("b")).alias("g")).collect()}
    assert bytes(got[0][0]) == b"abc" * 1000 and got[0][1] is None and got[4] == (None, None)
    assert all(got[k][0] is None and got[k][1] for k in (1, 2, 3))
    assert df.where("k = 0").select(I.gunzip(F.col("b"), 2999).error.alias("e")).first().e == "over the limit"
