"""Operators over images and the generic ones, past the limits they once had."""

import os

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import edit, image
from palimpsest.operators import images as I
from palimpsest.operators import relational as R
from palimpsest.operators.steps import shared_folder
from palimpsest.sources import volumes as S
from tests.fixtures import Disk


@pytest.fixture(scope="module")
def images(spark):
    d = Disk()
    folder = d.add_dir(b"docs")
    d.add_file(b"readme", b"hello " * 300, folder)
    d.add_file(b"FILE_ID.DIZ", b"a description")
    d.add_file(b"prog", b"uses dos.library and graphics.library\0")
    plain = d.build()
    hurt = bytearray(plain)
    hurt[883 * 512 + 20] ^= 1
    rows = [("a/plain.adf", plain), ("a/hurt.adf", bytes(hurt)), ("a/device.hdf", edit.device([edit.Spec("DH0", 40), edit.Spec("DH1", 30, 4)])), ("a/none", None), ("a/junk", b"junk"), ("a/zero.adf", bytes(901120)), ("a/cut.adf", plain[:5000])]
    return spark.createDataFrame(rows, "path string, content binary").repartition(3)


def test_every_operator_takes_anything(images):
    empty = images.limit(0)
    more = images.withColumn("kind", F.lit("k")).withColumn("entry", F.lit(1))
    every = [I.info, I.devices, I.walk, I.listing, lambda x: I.lookup(x, "docs/README"), I.directory_damage, I.files, I.file_blocks, I.directory_caches, I.findings, I.check, I.damage, I.bitmap, I.layout, I.carve, I.scan, lambda x: I.find(x, "hello"), lambda x: I.find_names(x, "READ"), I.track_table, I.sectors, I.surface, lambda x: I.convert(x, "extended-adf"), I.batch, I.specs, lambda x: I.read_range(x, 0, 4)]
    for f in every:
        assert f(empty).count() == 0
        assert sorted(map(str, f(more).collect())) == sorted(map(str, f(images).collect()))
    twice = images.unionByName(images)
    assert I.walk(twice).count() == 2 * I.walk(images).count()


def test_what_images_are(images):
    info = {r.path: r for r in I.info(images).collect()}
    assert len(info) == 7 and info["a/plain.adf"].volume.name == "Fixture" and info["a/plain.adf"].description == "a description" and info["a/plain.adf"].geometry.cylinders == 80
    assert {p: r.container for p, r in info.items()} == {"a/plain.adf": "adf", "a/hurt.adf": "adf", "a/device.hdf": "rdb", "a/none": "unknown", "a/junk": "unknown", "a/zero.adf": "adf", "a/cut.adf": "hardfile"}
    assert [(r.name, r.volume_name) for r in I.devices(images).orderBy("seq").collect()] == [("DH0", "DH0"), ("DH1", "DH1")]
    assert [r.name for r in I.listing(images.where("path = 'a/plain.adf'")).collect()] == ["docs", "FILE_ID.DIZ", "prog"]
    (found,) = I.lookup(images.where("path = 'a/plain.adf'"), "DOCS/ReadMe").collect()
    assert (found.kind, found.full_path, found.walked) == ("file", "docs/readme", [])
    kinds = {(r.path, r.partition): r.kind for r in I.check(images).collect()}
    assert kinds["a/zero.adf", None] == "unformatted" and kinds["a/plain.adf", None] == "files" and kinds["a/device.hdf", "DH0"] == "device" and kinds["a/junk", None] == "unreadable"
    codes = {(r.path, r.code) for r in I.findings(images).collect()}
    assert codes == {("a/hurt.adf", "entry-checksum"), ("a/none", "container-unsupported"), ("a/junk", "container-unsupported"), ("a/zero.adf", "no-volume"), ("a/cut.adf", "container-unsupported")}
    assert [(r.block, r.damage) for r in I.damage(images).collect()] == [(883, "bad checksum")]
    assert {r.fact for r in I.specs(images.where("path = 'a/plain.adf'")).where("topic = 'libraries'").collect()} == {"dos.library", "graphics.library"}
    assert [(r.region, r.file) for r in I.find(images.where("path = 'a/plain.adf'"), "68656c6c6f2068").limit(1).collect()] == [("file", "docs/readme")]
    assert I.layout(images.where("path = 'a/plain.adf'")).agg(F.sum("blocks")).first()[0] == 1760
    pieces = I.fragmentation(I.layout(images.where("path = 'a/plain.adf'"))).first()
    assert (pieces.files, pieces.in_pieces) == (3, 0)


def test_batch(spark, images):
    import hashlib
    import zlib

    data = images.where("path = 'a/plain.adf'").first().content
    dataset = spark.createDataFrame([("Fixture (1990)", zlib.crc32(data), len(data), hashlib.sha1(data).hexdigest())], "name string, crc bigint, size bigint, sha1 string")
    rows = {r.path: r for r in I.batch(images, dataset, "extended-adf").collect()}
    assert rows["a/plain.adf"].match == "Fixture (1990)" and rows["a/plain.adf"].sound and rows["a/hurt.adf"].identified == "unknown" and rows["a/none"].unreadable
    records = I.batch(images)
    s = I.batch_summary(records).first()
    assert (s.examined, s.unreadable, s.mounted, s.sound, s.at_risk) == (7, 1, 3, 2, 0)
    assert {(r.findings, r.images) for r in I.histogram(records, "findings").collect()} == {("entry-checksum", 1), ("container-unsupported", 2), ("no-volume", 1)}
    assert {(r.container, r.images) for r in I.histogram(records, "container").collect()} == {("adf", 3), ("rdb", 1), ("unknown", 1), ("hardfile", 1), ("unreadable", 1)}


def test_changes_and_refusals(spark, images):
    row = lambda op, path="", other="", data=None: (op, path, other, data)
    one = images.where("path = 'a/plain.adf'").first().content
    device = images.where("path = 'a/device.hdf'").first().content
    given = [("ok", one, [row("mkdir", "new"), row("put", "new/x", data=b"abc"), row("rm", "prog")]), ("refused", one, [row("mkdir", "new"), row("mkdir", "new"), row("rm", "prog")]), ("device", device, [row("partition-rename", "DH1", "Work"), row("partition-boot", "DH0")]), ("format", one, [row("format", "Fresh", "1")]), ("none", one, None), ("what", one, [row("dance")])]
    out = {r.path: r for r in I.apply_changes(spark.createDataFrame(given, "path string, content binary, " + f"changes {I.CHANGES}")).collect()}
    assert (out["ok"].made, out["ok"].refused) == (3, None) and out["refused"].made == 1 and "already" in out["refused"].refused and out["what"].made == 0
    assert [p.name for p in image.Image.open(bytes(out["device"].content)).partitions] == ["DH0", "Work"] and bytes(out["none"].content) == one
    after = spark.createDataFrame([(p, bytes(r.content)) for p, r in out.items()], "path string, content binary")
    assert {r.entry for r in I.walk(after.where("path = 'ok'")).collect()} == {"docs", "docs/readme", "FILE_ID.DIZ", "new", "new/x"}
    assert I.walk(after.where("path = 'format'")).count() == 0
    made = I.blanks(spark.createDataFrame([("b", 1760, "Disk", 3)], "path string, blocks int, name string, flags int"))
    assert I.check(made).first().kind == "blank"


def test_votes_and_comparisons(spark):
    base = bytes(range(256)) * 20
    wrong = lambda at, c: base[: at * 512] + c * 512 + base[at * 512 + 512 :]
    dumps = [("t", "a", base), ("t", "b", wrong(1, b"x")), ("t", "c", wrong(2, b"y")), ("two", "a", base), ("two", "b", wrong(3, b"z")), ("size", "a", base), ("size", "b", base[:-512]), ("lone", "a", base), ("null", "a", base), ("null", "b", None)]
    rows = {r.title: r for r in I.consolidate(spark.createDataFrame(dumps, "title string, path string, content binary")).collect()}
    assert bytes(rows["t"].merged) == base and (rows["t"].unanimous, rows["t"].resolved_sectors, rows["t"].disputed, rows["t"].can_vote) == (8, 2, [1, 2], True)
    assert (rows["two"].unresolved, rows["two"].can_vote, bytes(rows["two"].merged)) == ([3], False, base)
    assert rows["size"].refused and rows["lone"].refused == "one dump" and rows["null"].refused and rows["size"].merged is None
    pairs = spark.createDataFrame([("p", base, wrong(1, b"x")), ("q", base, base), ("r", base, base[:-1]), ("s", None, None)], "path string, left binary, right binary")
    got = {r.path: r for r in I.compare(pairs).collect()}
    assert (got["p"].sectors, got["p"].tracks, got["p"].bytes_differing) == ([1], [0], 510) and got["q"].identical and got["r"].refused and got["s"].identical


def test_files_written_once(spark, images, tmp_path):
    one = images.where("path = 'a/plain.adf'")
    got = {r.entry: r for r in I.unpack(one, str(tmp_path)).collect()}
    assert {r.outcome for r in got.values()} == {"written"} and open(got["docs/readme"].target, "rb").read() == b"hello " * 300
    assert {r.outcome for r in I.unpack(one, str(tmp_path)).collect()} == {"exists"}
    lines = [r.value for r in I.json_lines(spark.createDataFrame([("é😀", None)], "a string, b string"), "doc").collect()]
    assert lines == ['{"schema":"doc/1","a":"\\u00e9\\ud83d\\ude00","b":null}']


def test_more_sinks(spark, images, tmp_path):
    import zlib

    one = images.where("path = 'a/plain.adf'")
    (got,) = I.extract(one, "docs/readme").collect()
    assert bytes(got.data) == b"hello " * 300 and got.complete and I.extract(one, "none").first().refused == "not found" and I.extract(images.where("path = 'a/junk'"), "x").first().refused == "no volume"
    rows = spark.createDataFrame([("x/y", b"abc"), ("n", None)], "path string, data binary")
    assert {r.path: r.outcome for r in I.write_bytes(rows, str(tmp_path)).collect()} == {"x/y": "written", "n": "skipped"}
    assert I.write_bytes(rows, str(tmp_path)).where("outcome = 'exists'").count() == 1 and (tmp_path / "x" / "y").read_bytes() == b"abc"
    gone = I.apply_changes(one.withColumn("changes", F.expr("array(named_struct('op', 'rm', 'path', 'prog', 'other', cast(null as string), 'data', cast(null as binary)))")))
    assert {r.outcome for r in I.write_carved(gone, str(tmp_path)).collect()} == {"written"}
    target = tmp_path / "disk"
    target.write_bytes(b"old")
    assert I.save_over(str(target), b"new", 3, zlib.crc32(b"old")).endswith(".orig") and I.save_over(str(target), b"newer", 3, zlib.crc32(b"new")).endswith(".orig-1")
    with pytest.raises(ValueError):
        I.save_over(str(target), b"x", 3, 0)


def test_bytes_written(spark):
    from palimpsest.functions import bytes as B

    df = spark.createDataFrame([(bytes(range(16)), "a\n\"b")], "d binary, t string")
    row = df.select(B.u64(F.col("d"), 8).alias("u"), B.put(F.col("d"), 2, F.lit(0x1234), 2).alias("p"), B.put(F.col("d"), 15, F.lit(1), 2).alias("n"), B.repeated_long(F.lit(b"abcdabcd")).alias("r"), B.quoted(F.col("t")).alias("q"), B.wordlike(F.lit(b"plain words")).alias("w")).first()
    assert int(row.u) == int.from_bytes(bytes(range(8, 16)), "big") and bytes(row.p)[:5] == bytes([0, 1, 0x12, 0x34, 4]) and row.n is None and row.r and row.q == '"a\\n\\"b"' and row.w


def test_datasets(spark, tmp_path):
    (tmp_path / "x.dat").write_text('<game name="g"><rom name="A &amp;lt; B" size="12" crc="0000ABCD" sha1="AB"/><rom name="nocrc" size="1"/><rom name="nosize" crc="1"/></game>')
    (tmp_path / "y.DAT").write_text('<rom name="other" size="1" crc="2"/>')
    assert sorted((r.name, r.size, r.crc, r.sha1) for r in I.read_dataset(spark, [str(tmp_path)]).collect()) == [("A &lt; B", 12, 0xABCD, "ab"), ("nosize", 0, 1, None)]
    os.environ.pop("DATFILES", None)
    assert I.dataset_folder("/x") == "/x" and I.dataset_folder().endswith("datfiles")


def test_ranges_of_any_number(spark):
    for n in (4, 71, 3000):
        ranges = spark.createDataFrame([(10 * i, 10 * i + 15, f"r{i}") for i in range(n)], "low bigint, high bigint, era string")
        got = R.in_ranges(spark.createDataFrame([(12,), (5,), (-1,), (None,)], "y bigint"), "y", ranges, "low", "high", "era")
        assert got.columns == ["y", "era"] and sorted(map(str, got.collect())) == sorted(["Row(y=12, era='r0')", "Row(y=12, era='r1')", "Row(y=5, era='r0')", "Row(y=-1, era=None)", "Row(y=None, era=None)"])
    mixed = spark.createDataFrame([(0, 1 << 40, "wide"), (7, 8, "one"), (9, 9, "none"), (-5, 6, "below")], "low bigint, high bigint, era string")
    got = R.in_ranges(spark.createDataFrame([(7,), (-5,), (6,), (1 << 39,)], "y bigint"), "y", mixed, "low", "high", "era")
    assert sorted((r.y, r.era) for r in got.collect()) == [(-5, "below"), (6, "wide"), (7, "one"), (7, "wide"), (1 << 39, "wide")]
    assert R.in_ranges(spark.range(3).toDF("y"), "y", mixed.limit(0), "low", "high", "era").where("era is null").count() == 3


def test_walks_of_any_depth(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(80)] + [(80, 3)], "parent bigint, child bigint")
    roots = spark.createDataFrame([(0,)], "node bigint")
    got = R.walk(edges, roots)
    assert got.count() == 81 and got.agg(F.max("depth")).first()[0] == 80
    assert R.reach(edges, roots).count() == 81


def test_any_number_of_signatures(spark):
    signatures = spark.createDataFrame([(f"s{i}", f"{i:05d}") for i in range(12_000)] + [("a", "0"), ("b", "0")], "name string, magic string")
    got = R.scan_prefixes(spark.createDataFrame([(1, "11999x"), (2, "0"), (3, None), (4, "")], "k int, t string"), "k", "t", signatures)
    assert sorted((r.k, r.name) for r in got.collect()) == [(1, "s11999"), (2, "a"), (2, "b")]


def test_finding_text(spark):
    rows = [(1, "anananan"), (2, "xANan"), (3, "no"), (4, None), (5, ""), (6, "a.c abc a.c"), (7, "é😀anan"), (8, "an" * 3000)]
    df = spark.createDataFrame(rows, "k int, t string")
    at = lambda *a, **kw: sorted((r.k, r.at) for r in R.find(df, "k", "t", *a, **kw).collect() if r.k != 8)
    assert at("anan") == [(1, 0), (1, 2), (1, 4), (7, 2)] and at("anan", ignore_case=True) == [(1, 0), (1, 2), (1, 4), (2, 1), (7, 2)]
    assert at("a.c") == [(6, 0), (6, 8)] and at("\\E") == []
    assert R.find(df, "k", "t", "anan").where("k = 8").count() == 2999
    with pytest.raises(ValueError):
        R.find(df, "k", "t", "")


def test_runs_over_stretches(spark, monkeypatch):
    rows = [("a", i) for i in range(100) if i not in (17, 50)] + [("a", 30), ("b", 5), ("b", 7), ("b", 8), ("c", None)]
    df = spark.createDataFrame(rows, "g string, n bigint").where("n is not null")
    want = None
    for stretch in (1 << 16, 10, 1, 50):
        monkeypatch.setattr(R, "STRETCH", stretch)
        got = sorted((r.g, r.first, r.last, r.rows) for r in R.islands(df, ["g"], ["n"], [], step="n").collect())
        assert want in (None, got)
        want = got
    assert ("b", 7, 8, 2) in want and ("a", 0, 16, 17) in want and ("a", 51, 99, 49) in want


def test_votes_without_lists(spark):
    rows = [(1, "x", 1), (1, "y", 2), (1, "x", 3), (2, "p", 4), (2, "q", 5), (3, "z", 6), (4, None, 7), (4, None, 8), (4, "v", 9)]
    got = {r.u: (r.sources, r.n_values, r.state, r.chosen) for r in R.vote(spark.createDataFrame(rows, "u int, v string, s int"), ["u"], "v", "s").collect()}
    assert got == {1: (3, 2, "resolved", "x"), 2: (2, 2, "unresolved", "p"), 3: (1, 1, "unanimous", "z"), 4: (3, 2, "resolved", None)}


def test_lists_of_many_partitions(spark):
    data = edit.device([edit.Spec("DH0", 2)], reserved_cylinders=20)
    out = bytearray(512 * 400)
    out[: len(data)] = data
    for i in range(1, 201):
        out[i * 512 : i * 512 + 256] = data[512:768]
        out[i * 512 + 16 : i * 512 + 20] = (i + 1 if i < 200 else 1).to_bytes(4, "big")  # and it loops
    images = spark.createDataFrame([("d", bytes(out))], "path string, content binary")
    assert S.partitions(images).count() == 200 and I.devices(images).count() == 200


def test_a_shared_folder_is_needed_on_a_cluster():
    class Cluster:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError):
        shared_folder(Cluster(), "x")
