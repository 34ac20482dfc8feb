"""Volumes, images, tracks, changes and search against images that the fixtures build byte by byte."""

import random

import numpy as np
import pytest

from palimpsest.functions import edit, health, image, search, tracks
from palimpsest.functions.volume import Unreadable, Volume, protection_text
from palimpsest.operators.images import as_extended
from tests.fixtures import Disk

RNG = random.Random(3)
BIG = RNG.randbytes(90_000)


def disk(flags=0):
    d = Disk(flags=flags)
    folder = d.add_dir(b"docs")
    big = d.add_file(b"Big", BIG, folder)
    return d, folder, big, d.add_file(b"a.txt", b"hello"), d.add_file(b"empty", b"")


def codes(data):
    return [f.code for f in health.examine(Volume(data)).findings]


@pytest.mark.parametrize("flags", [0, 1])
def test_reads_what_was_built(flags):
    d, folder, big, small, _ = disk(flags)
    link = d.add_link(b"lnk", big)
    v = Volume(d.build())
    assert {p: e.kind for p, e in v.walk().entries} == {"docs": "directory", "docs/Big": "file", "a.txt": "file", "empty": "file", "lnk": "file link"}
    assert v.read(v.lookup("DOCS/bIG")[0]).data == BIG and v.read(v.lookup("lnk")[0]).data == BIG and v.read(v.entry(small)).data == b"hello"
    assert v.path_of(v.entry(big)) == "docs/Big" and v.resolve(v.entry(link)).block == big and v.lookup("")[0] is None
    assert sum(data for _, data in v.file_table(v.entry(big))) == -(-len(BIG) // (488 if flags == 0 else 512))
    with pytest.raises(Unreadable):
        v.lookup("docs/none")
    report = health.examine(v)
    assert not report.findings and report.sound and (report.files, report.directories, report.bytes_recovered) == (4, 1, 2 * len(BIG) + 5)
    m = v.bitmap()
    assert set(np.flatnonzero(m.allocated).tolist()) == d.used and not m.incomplete
    assert protection_text(0) == "----rwed" and protection_text(0xFF) == "hspa----"


def test_findings():
    def after(change, flags=0):
        parts = disk(flags)
        change(*parts)
        return codes(parts[0].build())

    def chain(d, block, to):
        d.put(block, 512 - 16, to)

    spoil = lambda d, b: (setattr(d, "spoilt", {b}), d.put(b, 20, 1))
    assert after(lambda d, *_: spoil(d, d.root))[0] == "rootblock-checksum"
    assert after(lambda d, f, big, *_: spoil(d, big)) == ["entry-checksum"]
    assert after(lambda d, *_: d.put(d.root, 512 - 200, 0)) == ["bitmap-flag-clear"]
    assert after(lambda d, *_: d.put(d.root, 512 - 28, 0)) == ["datestamp-day-zero"]
    assert "directory-damaged" in after(lambda d, f, big, small, _: chain(d, small, small))
    assert "directory-damaged" in after(lambda d, f, big, small, _: d.put(d.root, 24, 99_999))
    assert "entry-wrong-slot" in after(lambda d, f, big, small, _: (d.put(d.root, d.slot(b"a.txt"), d.get(small, 512 - 16)), chain(d, small, d.get(d.root, 24 + 4 * 70)), d.put(d.root, 24 + 4 * 70, small)))
    assert after(lambda d, f, big, small, _: d.put(small, 512 - 12, f)) == ["entry-wrong-parent"]
    assert "root-in-hash-table" in after(lambda d, f, *_: d.put(f, 24, d.root))
    data = lambda d, h: d.get(h, 24 + 4 * 71)
    assert after(lambda d, f, big, *_: d.b.__setitem__(data(d, big), bytearray(512))) == ["file-short", "data-block-structure"]
    assert after(lambda d, f, big, *_: d.put(data(d, big), 4, 7)) == ["data-block-structure"]
    assert "cross-linked-block" in after(lambda d, f, big, small, _: d.put(small, 24 + 4 * 71, data(d, big)))
    assert "file-unreadable" in after(lambda d, f, big, *_: d.put(big, 24 + 4 * 71, 99_999))
    assert "file-short" in after(lambda d, f, big, small, _: d.put(small, 512 - 188, 10))
    assert "link-target-missing" in after(lambda d, f, big, *_: d.add_link(b"l", f))
    assert "link-chain-broken" in after(lambda d, f, big, *_: (d.add_link(b"l", big), d.put(big, 512 - 40, 0)))
    assert "duplicate-name" in after(lambda d, *_: d.add_file(b"A.TXT", b"other"))
    assert after(lambda d, *_: d.used.add(1500)) == ["orphaned-blocks"]
    assert after(lambda d, f, big, *_: d.used.discard(data(d, big))) == ["referenced-but-free"]
    assert "bitmap-pointer-invalid" in after(lambda d, *_: d.put(d.root, 512 - 192, 99_999))
    assert "dostype-unknown-bits" in after(lambda d, *_: d.b[0].__setitem__(3, 8))
    assert "lnfs-unsupported" in after(lambda d, *_: d.b[0].__setitem__(3, 6))
    assert "name-length-overflow" in after(lambda d, *_: d.b[d.root].__setitem__(432, 60))


def test_walks_that_are_cut_or_loop():
    d = Disk()
    a = d.add_dir(b"a")
    d.add_link(b"up", a, 4, a)
    v = Volume(d.build())
    walk = v.walk()
    assert [p for p, _ in walk.entries] == ["a", "a/up"] and not walk.hit_limit
    d = Disk()
    f = d.add_file(b"x" * 30, BIG)
    lists = d.get(f, 512 - 8)
    d.put(lists, 512 - 8, lists)
    d.seal(lists)
    with pytest.raises(Unreadable):
        Volume(d.build()).read(Volume(d.build()).entry(f))


def test_many_like_findings_are_counted():
    d = Disk()
    for i in range(30):
        h = d.add_file(b"f%d" % i, b"x")
        d.put(h, 512 - 12, 1234)
    found = [f for f in health.examine(Volume(d.build())).findings if f.code == "entry-wrong-parent"]
    assert len(found) == 21 and found[-1].message.startswith("10 more")


def test_layout_tiles_and_carving():
    d, folder, big, small, _ = disk()
    v = image.Image.open(d.build())
    spans = list(image.spans(v))
    assert sum(n for _, n, *_ in spans) == 1760 and [b for b, *_ in spans] == np.cumsum([0, *[n for _, n, *_ in spans]])[:-1].tolist()
    assert {r for _, _, r, *_ in spans} == {"bootblock", "rootblock", "bitmap", "directory", "file", "unclaimed"} and not list(image.carve(v))
    for block, grade in ((big, "self-evident"), (small, "self-evident")):
        d, *_ = disk()
        name = b"Big" if block == big else b"a.txt"
        d.put(folder if block == big else d.root, d.slot(name), d.get(block, 512 - 16))
        x = image.Image.open(d.build())
        (c,) = image.carve(x)
        assert (c.entry.block, c.evidence) == (block, grade) and image.contents(image.Blocks(x.data), c) == (BIG if block == big else b"hello")
        assert image.recovered_name(c) == f"{block:05}-{name.decode()}"
        d.put(d.get(block, 24 + 4 * 71), 4, 1)
        (c,) = image.carve(image.Image.open(d.build()))
        assert c.evidence == ("partial" if block == big else "header only")
    assert image.host_name("a/b%") == "a%2Fb%25" and image.host_name("..") == "%2E%2E" and image.host_name("") == "%00"


@pytest.mark.parametrize("flags", range(6))
def test_changes(flags):
    e = edit.Editor(edit.blank(1760, "Vol", flags))
    assert not codes(bytes(e.data))
    e.make_dir("docs")
    e.make_dir("docs/deep")
    e.add_file("docs/big", BIG, comment="note")
    e.add_file("a.txt", b"hello")
    e.make_link("lnk", "docs/big")
    v = e.volume
    assert v.read(v.lookup("lnk")[0]).data == BIG and v.lookup("docs/big")[0].comment == b"note" and not codes(bytes(e.data))
    for refused in (lambda: e.delete("docs/big"), lambda: e.delete("docs"), lambda: e.add_file("A.TXT", b""), lambda: e.make_dir("x:y"), lambda: e.move("docs", "docs/deep"), lambda: e.add_file("huge", bytes(2 << 20)), lambda: e.rename("none", "x")):
        before = bytes(e.data)
        with pytest.raises(edit.Refused):
            refused()
        assert bytes(e.data) == before
    e.delete("lnk")
    header = e.volume.lookup("docs/big")[0].block
    before = bytes(e.data)
    e.delete("docs/big")
    e.undo()
    assert bytes(e.data) == before and e.redo() == "rm docs/big"
    if flags % 2 == 0:
        e.undelete(header, "docs/deep")
        assert e.volume.read(e.volume.lookup("docs/deep/big")[0]).data == BIG
    e.rename("a.txt", "b.txt")
    e.move("b.txt", "docs")
    assert e.deletion_order("docs")[-1] == "docs" and not codes(bytes(e.data))
    names = e.add_files([(f"many{i}", BIG[: i * 100]) for i in range(60)])
    assert len(set(names)) == 60 and e.volume.read(e.volume.lookup("many59")[0]).data == BIG[:5900] and not codes(bytes(e.data))
    with pytest.raises(edit.Refused):
        e.add_files([("one", b""), ("ONE", b"")])
    e.undo()
    e.delete_tree("docs")
    assert e.wipe(slack=False) > 100 and not e.volume.walk().entries and not codes(bytes(e.data))


def test_repair_and_judge():
    d, folder, big, small, _ = disk()
    d.used.discard(small)
    d.used.add(1500)
    e = edit.Editor(d.build())
    with pytest.raises(edit.Refused):
        e.make_dir("x")
    assert e.repair() == {"now_used": [small], "now_free": []}
    assert codes(bytes(e.data)) == ["orphaned-blocks"]
    assert e.repair(free_orphans=True)["now_free"] == [1500] and not codes(bytes(e.data))
    e.make_dir("x")


def test_devices():
    data = edit.device([edit.Spec("DH0", 40, 1, True), edit.Spec("DH1", 30, 0)], spare=20)
    x = image.Image.open(data)
    assert x.container == "rdb" and [(p.name, p.first, p.blocks, p.sound) for p in x.partitions] == [("DH0", 44, 880, True), ("DH1", 924, 660, True)]
    assert x.area("dh1").partition == "DH1" and x.area("0").partition == "DH0" and x.area("9") is None
    data = edit.partition_grow(edit.partition_rename(edit.partition_add(data, edit.Spec.parse("DH2:10:1:boot")), "dh1", "WORK"), "DH2", 10)
    x = image.Image.open(data)
    assert [(p.name, p.low, p.high, p.bootable) for p in x.partitions] == [("DH0", 2, 41, True), ("WORK", 42, 71, False), ("DH2", 72, 91, True)]
    assert all(not r.findings for _, _, r in image.examine(x))
    data = edit.partition_boot(edit.partition_delete(data, "WORK"), "DH0", False)
    assert [p.bootable for p in image.Image.open(data).partitions] == [False, True]
    loop = bytearray(data)
    loop[512 + 16 : 512 + 20] = (1).to_bytes(4, "big")
    found = [f.code for _, _, r in image.examine(image.Image.open(bytes(loop))) for f in r.findings]
    assert "partition-table-broken" in found
    assert [f.code for _, _, r in image.examine(image.Image.open(data), "none") for f in r.findings] == ["no-such-partition"]
    assert [r.kind for _, _, r in image.examine(image.Image.open(bytes(901120)))] == ["unformatted"]
    assert image.examine(image.Image.open(b"nothing"))[0][2].findings[0].code == "container-unsupported"


def test_long_partition_lists_aren_t_cut():
    n = 200
    out = bytearray(512 * 400)
    data = edit.device([edit.Spec("DH0", 2)], reserved_cylinders=20)
    out[: len(data)] = data
    for i in range(1, n + 1):
        out[i * 512 : i * 512 + 256] = data[512:768]
        out[i * 512 + 16 : i * 512 + 20] = (i + 1 if i < n else 0xFFFFFFFF).to_bytes(4, "big")
    assert len(image.partitions(bytes(out))[1]) == n


def test_tracks():
    data = RNG.randbytes(tracks.TRACKS * 11 * 512)
    x = as_extended(data)
    a = tracks.assemble(x)
    assert a.data == data and (a.placed, a.percent) == (1760, 100)
    cut = [data[i * 512 : i * 512 + 512] for i in range(11)]
    raw = tracks.encode_track(5, cut)
    t = tracks.decode_track(raw)
    assert t.standard() and not t.stray_syncs and [s.data for s in t.sectors] == cut and not any(s.violations for s in t.sectors)
    shifted = np.packbits(np.concatenate([[0, 1, 0], np.unpackbits(np.frombuffer(raw, np.uint8))])).tobytes()
    assert [s.data for s in tracks.decode_track(shifted).sectors] == cut
    hurt = bytearray(raw)
    hurt[500] ^= 0x55
    t = tracks.decode_track(bytes(hurt))
    assert sum(s.sound for s in t.sectors) == 10 and not t.standard()
    table, faults = tracks.extended_tracks(x[:-100])
    assert len(table) == 160 and not table[-1].inside and "bytes short" in faults[0]
    with pytest.raises(ValueError):
        tracks.extended_tracks(x[:500])


def capture(track, revolutions, noise):
    """A flux capture of one track, a jitter of so many ticks in each interval."""
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(track, np.uint8)))
    rng, blocks = np.random.default_rng(1), []
    for _ in range(revolutions):
        ticks = np.diff(ones) * 80 + rng.integers(-noise, noise + 1, len(ones) - 1)
        blocks.append(np.insert(ticks, 5, [0]).astype(">u2").tobytes())  # a carry, too
    head = bytearray(0x10 + 168 * 4)
    head[:3], head[5] = b"SCP", revolutions
    head[0x10:0x14] = len(head).to_bytes(4, "little")
    body, at = bytearray(b"TRK\0"), 4 + 12 * revolutions
    for b in blocks:
        body += (1).to_bytes(4, "little") + (len(b) // 2).to_bytes(4, "little") + at.to_bytes(4, "little")
        at += len(b)
    return bytes(head) + bytes(body) + b"".join(blocks)


def test_flux():
    cut = [RNG.randbytes(512) for _ in range(11)]
    data = capture(tracks.encode_track(0, cut), 2, 6)
    ((slot, revolutions),) = tracks.flux_table(data)["tracks"].items()
    ticks = tracks.intervals(data, revolutions[0][2], revolutions[0][1])
    assert slot == 0 and len(revolutions) == 2 and ticks[5] > 65536
    bits = tracks.flux_bits(np.delete(ticks, 5))
    assert bits["locked"] and bits["out_of_range"] <= 11  # where sectors and gaps meet
    a = tracks.assemble_flux(data)
    assert a.placed >= 10 and a.data[:512] in cut + [bytes(512)]
    assert tracks.intervals(np.array([0, 0, 5, 7], ">u2").tobytes(), 0, 4).tolist() == [131077, 7]
    assert not tracks.flux_bits(np.full(1000, 7))["locked"]


def test_search():
    assert search.Pattern.parse("0x1f, 8b").data == b"\x1f\x8b" and search.Pattern.parse("cafe").is_hex and not search.Pattern.parse("cafe", True).is_hex
    for bad in ("", "0x123"):
        with pytest.raises(ValueError):
            search.Pattern.parse(bad)
    assert list(search.search(b"aNanAnan", search.Pattern.parse("anan", ignore_case=True))) == [0, 2, 4]
    hits = search.scan(b"FORM" + bytes(508) + b"FORM" + bytes(600) + b"M.K." + bytes(1000) + b"DMS!1.")
    assert [(h.name, h.offset, h.blocks) for h in hits] == [("IFF", 0, 2), ("ProTracker module (M.K.)", 1116, 1)]
    assert [h.name for h in search.scan(b"DMS!!ERR")] == ["xDMS unpack failure filler"]
