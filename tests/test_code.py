"""Programs: decoding, control, graphs and notes."""

import struct

from pyspark.sql import functions as F

from palimpsest.functions import m68k
from palimpsest.operators import code as C


def hunk_file(code, relocations=(), symbols=(), data=b""):
    out = struct.pack(">IIIII", 0x3F3, 0, 1 + bool(data), 0, bool(data)) + struct.pack(">I", len(code) // 4)
    out += struct.pack(">I", len(data) // 4) if data else b""
    out += struct.pack(">II", 0x3E9, len(code) // 4) + code
    for target, places in relocations:
        out += struct.pack(f">III{len(places)}I", 0x3EC, len(places), target, *places) + bytes(4)
    if symbols:
        out += struct.pack(">I", 0x3F0) + b"".join(struct.pack(">I", len(s) // 4) + s + struct.pack(">I", a) for s, a in symbols) + bytes(4)
    out += struct.pack(">I", 0x3F2)
    return out + (struct.pack(">II", 0x3EA, len(data) // 4) + data + struct.pack(">I", 0x3F2) if data else b"")


#: bsr 12; beq +4 (to 10); nop; nop; rts; [12] moveq #1,d0; jsr -454(a6); rts; two words that nothing reaches
CODE = bytes.fromhex("6100000a" "6704" "4e71" "4e71" "4e75" "7001" "4eaefe3a" "4e75" "ffff4e71")


def test_decoding():
    text = lambda h: m68k.decode(bytes.fromhex(h)).text
    want = {
        "4e75": "rts", "303c1234": "move.w #$1234,d0", "48e73f3e": "movem.l d2-d7/a2-a6,-(sp)", "4cdf7cfc": "movem.l (sp)+,d2-d7/a2-a6", "51c8fffe": "dbra d0,$0",
        "0839000600bfe001": "btst #6,$bfe001", "c1fc0007": "muls #$7,d0", "e588": "lsl.l #2,d0", "41fa0010": "lea $12(pc),a0", "c141": "exg d0,d1", "d1c1": "adda.l d1,a0", "b348": "cmpm.w (a0)+,(a1)+",
        "4a7c": "dc.w $4a7c", "3e3c": "dc.w $3e3c", "0300": "btst d1,d0", "c100": "abcd d0,d0", "0108": "dc.w $0108", "4840": "swap d0", "4880": "ext.w d0", "48c0": "ext.l d0", "5240": "addq.w #1,d0",
    }
    assert {h: text(h) for h in want} == want
    for _ in range(3):
        data = bytes((i * 37 + _ * 11) & 255 for i in range(4000))
        listing = list(m68k.listing(data))
        assert sum(x.size for x in listing) == 4000 and [x.at for x in listing[1:]] == [x.at + x.size for x in listing[:-1]]


def test_words_for_instructions():
    words = lambda h: m68k.explain(m68k.decode(bytes.fromhex(h)))
    assert words("303c1234") == "copy #$1234 to d0 (a word)" and words("66fe") == "go to $0 if not equal" and words("e588") == "shift d0 left by #2 (a long word)"
    assert words("51c8fffe") == "count d0 down and go to $0 until it is -1" and words("4eaefe3a") == "call -454(a6)" and words("57c0") == "set d0 to all ones if equal, else to zero"
    assert words("30301002") == "copy 2(a0,d1.w) to d0 (a word)" and words("ffff") == "data $ffff"
    for op in range(0, 65536, 7):
        m68k.explain(m68k.decode(op.to_bytes(2, "big") + bytes(8)))


def test_graph_order():
    from palimpsest.functions import graphs

    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "c"), ("b", "d")]
    assert graphs.back_edges(edges, ["a"]) == {("c", "a"), ("c", "c")} and graphs.layers(edges, ["a"]) == {"a": 0, "b": 1, "c": 2, "d": 2}
    assert graphs.order(edges, ["a"]) == [["a"], ["b"], ["c", "d"]] and graphs.order([], []) == []
    deep = [(f"n{i:05}", f"n{i + 1:05}") for i in range(5000)]
    assert graphs.layers(deep, ["n00000"])["n05000"] == 5000


def test_programs(spark):
    files = spark.createDataFrame([("p", "prog", hunk_file(CODE, symbols=[(b"main", 0)])), ("p", "bad", b"nothing"), ("q", "prog", hunk_file(bytes.fromhex("20390000000041fa00024e75"), [(1, [2])], data=b"some words\0\0"))], "path string, entry string, data binary")
    code = C.instructions(files)
    rows = {r.at: r for r in code.where("path = 'p'").collect()}
    assert [a for a in sorted(rows) if not rows[a].reached] == [20, 22] and rows[20].flow == "data"
    begins = C.functions(files)
    assert {(r.path, r.at, r.label) for r in begins.collect()} == {("p", 0, "main"), ("p", 12, "h0_000c"), ("q", 0, "h0_0000")}
    graph = C.calls(code, begins)
    assert {(r.caller, r.callee, r.calls) for r in graph.collect()} == {("main", "h0_000c", 1), ("h0_000c", "-454(a6)", 1)}
    assert {tuple(r.calls) for r in C.call_tree(graph, "main").collect()} == {("main",), ("main", "h0_000c"), ("main", "h0_000c", "-454(a6)")}
    assert '"main" -> "h0_000c";' in C.dot(graph).where("path = 'p'").first().dot
    edges = {(b.begin, b.end): [(e.kind, e.to) for e in b.edges] for b in C.blocks(files).where("path = 'p' and function = 0").collect()}
    assert edges == {(0, 6): [("taken", 10), ("not taken", 6)], (6, 10): [("next", 10)], (10, 12): []}
    assert {(r.label, r.layer) for r in C.drawn(graph).collect()} == {("main", 0), ("h0_000c", 1), ("-454(a6)", 2)}
    assert C.explained(code.where("path = 'p' and at = 10")).first().meaning == "return"
    boots = spark.createDataFrame([("x", b"DOS\0" + bytes(8) + CODE + bytes(1100)), ("y", bytes(2000)), ("z", None)], "path string, content binary")
    assert C.instructions(C.boot_code(boots), raw=True).where("name = 'rts'").count() == 2
    refs = C.references(files)
    assert {(r.path, r.at, r.to_hunk, r.to, r.kind) for r in refs.collect()} >= {("p", 0, 0, 12, "call"), ("p", 4, 0, 10, "branch"), ("q", 2, 1, 0, "relocation"), ("q", 6, 0, 10, "operand")}
    assert {(r.to, r.kind, r.references, r.more) for r in C.referred(refs).where("path = 'p'").collect()} == {(12, "call", 1, 0), (10, "branch", 1, 0)}
    ranges = spark.createDataFrame([("p", "prog", 0, 8, 11, "tail")], "path string, entry string, to_hunk int, low bigint, high bigint, label string")
    assert [(r.to, r.label) for r in C.references_into(refs, ranges).collect()] == [(10, "tail")]
    assert {r.at: r.comes_from for r in C.line_targets(code).where("path = 'p' and comes_from > 0").collect()} == {10: 1, 12: 1}
    assert sorted((r.at, r.kind, r.instructions) for r in C.segments(code).where("path = 'p'").collect()) == [(0, "reached", 8), (20, "data", 1), (22, "unreached", 1)]
    lines = [r.line for r in C.listing(code, begins).where("path = 'p'").orderBy("hunk", "at", "part").collect()]
    assert lines[0] == "main:" and lines[1] == "\tbsr.w\th0_000c" and "h0_000c:" in lines
    assert [(r.path, r.text) for r in C.strings(files).where("hunk = 1").collect()] == [("q", "some words")]
    assert {(r.hunk, r.at, r.references) for r in C.variables(refs, code).where("path = 'q'").collect()} >= {(1, 0, 1)}


def test_notes(spark, tmp_path):
    shape = "sha1 string, hunk int, at bigint, label string, comment string"
    notes = spark.createDataFrame([("s", 0, 0, "start", None), ("s", 0, 12, "old", "x")], shape)
    changes = spark.createDataFrame([("s", 0, 12, "print", None, 1), ("s", 0, 12, "1bad", None, 2), ("s", 0, 0, None, None, 3), ("s", 0, 4, None, "a branch", 4)], shape + ", seq int")
    after = C.annotate(notes, changes)
    assert {(r.at, r.label, r.comment) for r in after.collect()} == {(12, "print", None), (4, None, "a branch")}
    root = str(tmp_path / "notes")
    C.save_notes(after.unionByName(spark.createDataFrame([("t", 0, 0, "x", None)], shape)), root)
    C.save_notes(spark.createDataFrame([("t", 1, 2, "y", None)], shape), root)
    assert sorted((r.sha1, r.at, r.label) for r in C.load_notes(spark, root).where("label is not null").collect()) == [("s", 12, "print"), ("t", 2, "y")]
    code = spark.createDataFrame([("s", 0, 4), ("s", 0, 6)], "sha1 string, hunk int, at bigint")
    assert {(r.at, r.comment) for r in C.with_notes(code, after).collect()} == {(4, "a branch"), (6, None)}
    got = spark.createDataFrame([("h1_0042",), ("x",)], "t string").select(C.place(F.col("t")).alias("p")).collect()
    assert (got[0].p.hunk, got[0].p.at, got[1].p) == (1, 0x42, None)
    assert spark.range(1).select(C.place_text(F.lit(1), F.lit(0x42))).first()[0] == "h1_0042"
