"""What only large tables, or their volumes, bring up."""

import random
import re
import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from palimpsest.functions import edit, health, m68k, tracks
from palimpsest.functions.volume import Volume
from palimpsest.operators import code
from palimpsest.operators import images as I
from palimpsest.operators import relational as R


def documents(spark, folder, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([("q", "an item")], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    return con


def same(spark, con, folder, name):
    df = entry.queries()[name](spark, str(folder))
    rel = con.sql(entry.oracle_sql()[name]).select(", ".join(df.columns))
    assert sorted(map(tuple, df.collect()), key=str) == sorted(rel.fetchall(), key=str)


def test_equal_crc_and_size_of_different_texts(spark, tmp_path):
    seen, i = {}, 0
    while (crc := zlib.crc32(text := b"%08d-%d" % (i * 7919 % 10**8, i % 7))) not in seen or seen[crc] == text:
        seen[crc], i = text, i + 1
    con = documents(spark, tmp_path, [seen[crc].decode(), text.decode(), "other", "other", None])
    same(spark, con, tmp_path, "content_identify")


def passes(df):
    """Python steps and shuffles of a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"(FlatMapGroupsIn|MapIn)(Arrow|Pandas)", plan.partition("== Initial Plan ==")[0])), len(re.findall(r"Exchange hashpartitioning", plan.partition("== Initial Plan ==")[0]))


def built(n, size=900):
    e = edit.Editor(edit.blank(3520), judged=False)
    e.add_files([(f"f{i}", bytes([i]) * size * (i + 1)) for i in range(n)])
    return bytes(e.data)


def test_a_change_reads_only_what_it_touches(monkeypatch):
    reads, read = [], Volume.read
    monkeypatch.setattr(Volume, "read", lambda v, e: reads.append(e.block) or read(v, e))
    e = edit.Editor(built(20))
    for i in range(15):
        e.delete(f"f{i}")
    assert len(e.done) == 15 and len(reads) <= 25  # 20 for the first examination


def test_what_an_editor_keeps_is_what_a_new_examination_finds():
    e = edit.Editor(built(12))
    steps = [lambda: e.delete("f3"), lambda: e.make_dir("a"), lambda: e.move("f5", "a"), lambda: e.add_file("a/new", b"x" * 40000), lambda: e.rename("f7", "g"), lambda: e.undo(), lambda: e.make_link("l", "f8"), lambda: e.delete("a/f5"), lambda: e.redo() if e.undone else None, lambda: e.wipe(True, True)]
    for step in steps:
        step()
        assert e.report == health.examine(e.volume)
    raw = bytearray(e.data)
    v = e.volume
    first = v.file_table(v.lookup("f9")[0])[0][0]
    raw[first * 512 + 8 : first * 512 + 12] = b"\0\0\0\7"  # out of sequence
    hurt = edit.Editor(bytes(raw))
    assert [f.code for f in hurt.report.findings if f.severity == "warning"] == ["data-block-structure"]
    hurt.delete("f9")
    assert hurt.report == health.examine(hurt.volume) and not [f for f in hurt.report.findings if f.severity == "warning"]


def test_volumes_are_made_changed_and_read_in_one_step(spark, small):
    assert passes(entry.queries()["delete_files"](spark, small)) == (1, 1)


def test_deleted_files_are_carved_in_the_step_that_deletes_them(spark, small):
    assert passes(entry.queries()["carve_deleted"](spark, small)) == (1, 1)


def test_volumes_are_listed_in_the_step_that_makes_them(spark, small):
    assert passes(entry.queries()["list_json"](spark, small)) == (1, 2)


def test_volumes_are_checked_in_the_step_that_makes_them(spark, small):
    assert passes(entry.queries()["volume_check"](spark, small)) == (1, 1)


def test_tiles_are_the_listing(monkeypatch):
    rng = random.Random(5)
    texts = [b"the tide; in 1984 (was) not there: that two text lines tell\n" * 20, b"", b"x", b"ab", bytes(rng.randrange(256) for _ in range(60001))]
    texts += [bytes(rng.choice(b"\x20\x30\x70\x74\x06\x07\x00") for _ in range(n)) for n in (9, 10, 11, 12, 13, 4000, 30000)]
    wanted = [[(x.at, x.size) for x in m68k.listing(t)] for t in texts]
    for most in (7, 1 << 16):
        assert [[(int(a), int(b)) for at, size in m68k.tiles(t, most) for a, b in zip(at, size, strict=True)] for t in texts] == wanted
    text, decoded = b"the same words again and again, " * 3000, []
    tried = m68k._tried
    monkeypatch.setattr(m68k, "_tried", lambda data, at: decoded.append(at) or tried(data, at))
    assert sum(len(at) for at, _ in m68k.tiles(text)) > 20000 and len(decoded) < 200


def test_tiles_of_many_programs(spark):
    rng = random.Random(6)
    rows = [(i, "d", bytearray(rng.randrange(256) for _ in range(rng.randrange(0, 400)))) for i in range(50)] + [(99, None, bytearray(b"Nu" * 90000)), (100, "d", None)]
    found = spark.createDataFrame(rows, "path bigint, entry string, data binary").repartition(3)
    both = [f.select("path", "entry", "at", "size").collect() for f in (code.tiles(found), code.instructions(found, raw=True))]
    assert sorted(both[0], key=str) == sorted(both[1], key=str) and len(both[0]) > 90000


def test_a_disk_of_tracks_is_encoded_and_decoded_at_once(monkeypatch):
    calls = []
    for f in ("packbits", "unpackbits"):
        monkeypatch.setattr(np, f, lambda *a, g=getattr(np, f), **k: calls.append(g) or g(*a, **k))
    data = random.Random(7).randbytes(901120)
    assert tracks.assemble(I.as_extended(data)).data == data and len(calls) < 100


def test_sectors_at_any_bit_with_damage():
    rng = random.Random(8)
    sectors = [rng.randbytes(512) for _ in range(11)]
    bits = "".join(f"{b:08b}" for b in tracks.encode_track(9, sectors))
    own = "".join(c for i, c in enumerate(bits) if i % 2)
    assert all(bits[i] == ("1" if own[i // 2 - 1] == own[i // 2] == "0" else "0") for i in range(8 * 44, 8 * 1100, 2))  # clock bits of the first sector's body
    for shift in range(17):
        there = "10110100110101001"[:shift] + bits
        n = shift + 8 * (32 + 8 + 700)  # a bit of the first sector's data
        there = there[: n + 1] + "10"[int(there[n + 1])] + there[n + 2 :]
        raw = int(there.ljust(-(-len(there) // 8) * 8, "0"), 2).to_bytes(-(-len(there) // 8), "big")
        found = tracks.decode_track(raw).sectors
        assert [(s.number, s.track, s.to_gap, s.bit) for s in found] == [(i, 9, 11 - i, shift + 8 * (36 + 1120 * i)) for i in range(11)]
        assert [s.data for s in found[1:]] == sectors[1:] and [s.sound for s in found] == [False] + [True] * 10 and found[0].violations > 0
        assert len(tracks.decode_track(raw[:-40]).sectors) == 10 and tracks.decode_track(raw[:-40]).stray_syncs == 1


def test_tracks_are_written_and_read_in_the_step_that_makes_them(spark, small):
    assert passes(entry.queries()["track_round_trip"](spark, small)) == (1, 1)


def test_dumps_of_many_pieces_are_voted_as_their_sectors(spark):
    rng = random.Random(9)
    rows = []
    for title, n, sectors in (("long", 3, 1300), ("two", 2, 513), ("many", 9, 40), ("lone", 1, 600), ("last", 4, 1024)):
        base = rng.randbytes(512 * sectors)
        for i in range(n):
            dump = bytearray(base)
            for s in rng.sample(range(sectors), sectors // 8) + [sectors - 1]:
                dump[s * 512 : s * 512 + 512] = bytes([rng.randrange(2)]) * 512
            rows.append((title, f"p{9 - i}", dump))
    rows += [("odd", "a", bytearray(512 * 600)), ("odd", "b", bytearray(512 * 601)), ("unread", "a", None), ("unread", "b", bytearray(512)), (None, "a", bytearray(1024)), (None, "b", bytearray(1024)), ("empty", "a", bytearray()), ("empty", "b", bytearray())]
    dumps = spark.createDataFrame(rows, "title string, path string, content binary").repartition(5)
    got = {r.title: r for r in I.consolidate(dumps).collect()}
    sector = I.sector_rows(dumps.select(F.struct("title", "path").alias("path"), "content")).select("path.*", "sector", "data")
    wanted = {}
    for r in R.vote(sector, ["title", "sector"], "data", "path").collect():
        wanted.setdefault(r.title, []).append((r.sector, r.state, bytes(r.chosen)))
    for title in ("long", "two", "many", "last", None):
        r, w = got[title], sorted(wanted[title])
        assert bytes(r.merged) == b"".join(c for _, _, c in w) and r.sectors_total == len(w) and r.unanimous == sum(s == "unanimous" for _, s, _ in w)
        assert (r.disputed, r.unresolved) == tuple([n for n, s, _ in w if s == state] for state in ("resolved", "unresolved"))
        assert (len(r.disputed), len(r.unresolved), r.refused) == (r.resolved_sectors, r.unresolved_sectors, None)
    assert {t: (got[t].refused, got[t].sources, got[t].unanimous, got[t].merged) for t in ("lone", "odd", "unread", "empty")} == {
        "lone": ("one dump", 1, None, None), **{t: ("sizes differ or aren't whole sectors", 2, None, None) for t in ("odd", "unread", "empty")}
    }


def test_dumps_are_made_once_and_dealt_out_in_pieces(spark, small):
    assert passes(entry.queries()["consolidate_dumps"](spark, small)) == (2, 3)
