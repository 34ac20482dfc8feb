"""Operators over programs: instructions, references, functions, blocks, calls.

Decoding and following control run in one pass over the load files (rows of path, entry, data); what relates instructions to each
other, to names and to places is joins, as-of lookups, islands and walks over the table of instructions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from palimpsest.functions import m68k, media
from palimpsest.operators import relational as R
from palimpsest.operators.images import ROWS, per_image

FIELDS = "hunk int, at bigint, size int, name string, operands string, flow string, target bigint, reached boolean"


def _given(found: DataFrame, name: str, data: str) -> DataFrame:
    return found.select("path", F.col(data).alias("content"), F.col(name).alias("entry"))


def _starts(hunks: list[media.Hunk]) -> dict[int, set[int]]:
    """Where control may come in: the first hunk's beginning and what relocated longs name."""
    out: dict[int, set[int]] = {0: {0}}
    for h in hunks:
        for target, places in h.relocations.items():
            for p in places:
                if p + 4 <= len(h.data):
                    out.setdefault(target, set()).add(media.u32(h.data, p))
        for _, at in h.symbols:
            out.setdefault(hunks.index(h), set()).add(at)
    return out


def instructions(found: DataFrame, name: str = "entry", data: str = "data", raw: bool = False) -> DataFrame:
    """Every instruction of the code hunks, and whether control reaches it; what isn't reached is decoded from the end of what is. raw: the data is code itself, read from its beginning."""

    def one(content: bytes, _):
        if raw:
            for x in m68k.listing(content):
                yield 0, x.at, x.size, x.name, x.operands, x.flow, x.target, True
            return
        hunks, _ = media.hunks(content)
        starts = _starts(hunks)
        for i, h in enumerate(hunks):
            if h.kind != "code":
                continue
            code, at = m68k.reached(h.data, sorted(starts.get(i, ()))), 0
            while at + 1 < len(h.data):
                x = code.get(at) or m68k.decode(h.data, at)
                nxt = min((p for p in range(at + 2, at + x.size, 2) if p in code), default=at + x.size)
                if nxt < at + x.size and at not in code:  # an instruction that control reaches begins within it
                    x = m68k.Instruction(at, 2, "dc.w", f"${media.u16(h.data, at):04x}", "data", None)
                yield i, x.at, x.size, x.name, x.operands, x.flow, x.target, at in code
                at += x.size

    return per_image(_given(found, name, data), one, FIELDS, ["entry"])


def tiles(found: DataFrame, name: str = "entry", data: str = "data") -> DataFrame:
    """path, entry, at, size of each instruction that instructions() finds in raw code, for what needs no text: rows leave as whole columns."""
    source = _given(found, name, data).select("path", "entry", F.coalesce("content", F.lit(b"")).alias("content"))
    schema = StructType([source.schema["path"], source.schema["entry"], StructField("at", LongType()), StructField("size", IntegerType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows, at, size, n = [], [], [], 0

            def table():
                of = pa.array(np.repeat(rows, [len(x) for x in at]))
                return pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(np.concatenate(at)), pa.array(np.concatenate(size))], schema=arrow)  # noqa: B023

            for i in range(batch.num_rows):
                for a, s in m68k.tiles(batch.column(2)[i].as_py()):
                    rows.append(i)
                    at.append(a)
                    size.append(s)
                    n += len(a)
                    if n >= 16 * ROWS:
                        yield table()
                        rows, at, size, n = [], [], [], 0
            if n:
                yield table()

    return source.mapInArrow(run, schema)


def references(found: DataFrame, name: str = "entry", data: str = "data") -> DataFrame:
    """What names a place: (hunk, at) to (to_hunk, to), by relocation, branch, jump, call or PC-relative operand; sorted by place, then origin, within a program."""

    def one(content: bytes, _):
        hunks, _ = media.hunks(content)
        out = []
        for i, h in enumerate(hunks):
            out += [(i, p, t, media.u32(h.data, p), "relocation") for t, ps in h.relocations.items() for p in ps if p + 4 <= len(h.data)]
            if h.kind == "code":
                for x in m68k.reached(h.data, sorted(_starts(hunks).get(i, ()))).values():
                    if x.target is not None and x.name not in ("jmp", "jsr") or x.target is not None and x.reads and x.reads[-1][1] == "relative":
                        out.append((i, x.at, i, x.target, x.flow))
                    elif x.flow not in ("call", "jump"):
                        out += [(i, x.at, i, p, "operand") for p, kind in x.reads if kind == "relative"]
        yield from sorted(out, key=lambda r: (r[2], r[3], r[0], r[1], r[4]))

    return per_image(_given(found, name, data), one, "hunk int, at bigint, to_hunk int, to bigint, kind string", ["entry"])


def functions(found: DataFrame, name: str = "entry", data: str = "data") -> DataFrame:
    """Where functions begin, with their symbol's name or one made of hunk and place."""

    def one(content: bytes, _):
        hunks, _ = media.hunks(content)
        starts = _starts(hunks)
        for i, h in enumerate(hunks):
            if h.kind == "code":
                own = {a: s for s, a in h.symbols}
                for at in m68k.functions(m68k.reached(h.data, sorted(starts.get(i, ()))), sorted(starts.get(i, ()))):
                    yield i, at, own.get(at, f"h{i}_{at:04x}")

    return per_image(_given(found, name, data), one, "hunk int, at bigint, label string", ["entry"])


def blocks(found: DataFrame, name: str = "entry", data: str = "data") -> DataFrame:
    """Basic blocks of every function, with their edges (taken, not taken, jump, next)."""

    def one(content: bytes, _):
        hunks, _ = media.hunks(content)
        starts = _starts(hunks)
        for i, h in enumerate(hunks):
            if h.kind == "code":
                code = m68k.reached(h.data, sorted(starts.get(i, ())))
                for at in m68k.functions(code, sorted(starts.get(i, ()))):
                    for b in m68k.blocks(code, at):
                        yield i, at, b["begin"], b["end"], [{"kind": k, "to": t} for k, t in b["edges"]]

    return per_image(_given(found, name, data), one, "hunk int, function bigint, begin bigint, end bigint, edges array<struct<kind: string, to: bigint>>", ["entry"])


KEYS = ["path", "entry"]


def with_function(rows: DataFrame, begins: DataFrame) -> DataFrame:
    """rows (path, entry, hunk, at) with the label of the function that begins last at or before their place."""
    return R.as_of(rows, begins.select(*KEYS, "hunk", "at", "label"), [*KEYS, "hunk"], "at", "label").withColumnRenamed("last_label", "function")


def calls(code: DataFrame, begins: DataFrame) -> DataFrame:
    """The call graph: caller, callee and how many calls; a callee outside the program's functions is told by its operand."""
    sites = with_function(code.where("flow = 'call' and reached"), begins)
    named = begins.select(*KEYS, "hunk", F.col("at").alias("target"), "label")
    joined = sites.join(named, [*KEYS, "hunk", "target"], "left")
    return joined.groupBy(*KEYS, F.col("function").alias("caller"), F.coalesce("label", "operands").alias("callee")).agg(F.count("*").alias("calls"))


def call_tree(graph: DataFrame, root: str) -> DataFrame:
    """Paths of calls from a function, each as far as it doesn't come back to itself: node, depth, path (of labels, behind the program's)."""
    name = lambda c: F.concat_ws("\x00", *KEYS, c)
    edges = graph.select(name("caller").alias("parent"), name("callee").alias("child"))
    roots = graph.where(F.col("caller") == root).select(name("caller").alias("node")).distinct()
    last = lambda c: F.element_at(F.split(c, "\x00"), -1)
    reached = R.walk(edges, roots)
    parts = F.split("node", "\x00")
    return reached.select(parts[0].alias("path"), parts[1].alias("entry"), last(F.col("node")).alias("label"), "depth", F.transform("path", last).alias("calls"))


def dot(graph: DataFrame) -> DataFrame:
    """Each program's call graph as Graphviz text."""
    edge = F.concat(F.lit('  "'), "caller", F.lit('" -> "'), "callee", F.lit('";'))
    return graph.groupBy(*KEYS).agg(F.array_sort(F.collect_set(edge)).alias("e")).select(*KEYS, F.concat(F.lit("digraph calls {\n"), F.array_join("e", "\n"), F.lit("\n}\n")).alias("dot"))


def referred(refs: DataFrame, most: int = 8) -> DataFrame:
    """For each place, its references by kind: how many, and the first few origins."""
    w = Window.partitionBy(*KEYS, "to_hunk", "to", "kind").orderBy("hunk", "at")
    ranked = refs.withColumn("_n", F.row_number().over(w))
    first = F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.struct("hunk", "at"))))
    return ranked.groupBy(*KEYS, "to_hunk", "to", "kind").agg(F.count("*").alias("references"), first.alias("first"), F.greatest(F.count("*") - most, F.lit(0)).alias("more"))


def references_into(refs: DataFrame, ranges: DataFrame) -> DataFrame:
    """References whose place lies in a range (path, entry, to_hunk, low, high, label) of the same hunk; ranges of a hunk are disjoint."""
    marks = ranges.select(*KEYS, "to_hunk", F.col("low").alias("to"), F.struct("high", "label").alias("r"))
    hit = R.as_of(refs, marks, [*KEYS, "to_hunk"], "to", "r")
    return hit.where(F.col("to") < F.col("last_r.high")).select(*refs.columns, F.col("last_r.label").alias("label"))


def line_targets(code: DataFrame) -> DataFrame:
    """Instructions with whether another one goes to them, and how many do."""
    to = code.where("target is not null").groupBy(*KEYS, "hunk", F.col("target").alias("at")).agg(F.count("*").alias("comes_from"))
    return code.join(to, [*KEYS, "hunk", "at"], "left").withColumn("comes_from", F.coalesce("comes_from", F.lit(0)))


def segments(code: DataFrame) -> DataFrame:
    """Runs of reached code, unreached code and data words in each code hunk."""
    kind = F.when(F.col("reached"), "reached").when(F.col("flow") == "data", "data").otherwise("unreached")
    rows = code.withColumn("kind", kind)
    runs = R.islands(rows.withColumn("end", F.col("at") + F.col("size")), [*KEYS, "hunk"], ["at"], ["kind"])
    return runs.select(*KEYS, "hunk", "kind", F.col("first").alias("at"), F.col("rows").alias("instructions"))


def listing(code: DataFrame, begins: DataFrame) -> DataFrame:
    """Lines of assembler source in order (seq): labels, instructions, words of data."""
    labels = begins.select(*KEYS, "hunk", "at", F.lit(0).alias("part"), F.concat("label", F.lit(":")).alias("line"))
    to = begins.select(*KEYS, "hunk", F.col("at").alias("target"), "label")
    named = code.join(to, [*KEYS, "hunk", "target"], "left")
    operand = F.when(F.col("label").isNotNull() & F.col("operands").rlike(r"\$[0-9a-f]+$"), F.regexp_replace("operands", r"\$[0-9a-f]+$", F.col("label"))).otherwise(F.col("operands"))
    lines = named.select(*KEYS, "hunk", "at", F.lit(1).alias("part"), F.rtrim(F.concat(F.lit("\t"), "name", F.lit("\t"), operand)).alias("line"))
    return labels.unionByName(lines).select(*KEYS, "hunk", "at", "part", "line")


def strings(found: DataFrame, name: str = "entry", data: str = "data", least: int = 4) -> DataFrame:
    """NUL-ended text in the hunks of load files."""

    def one(content: bytes, _):
        for i, h in enumerate(media.hunks(content)[0]):
            for at, s in m68k.strings(h.data, least):
                yield i, at, s

    return per_image(_given(found, name, data), one, "hunk int, at bigint, text string", ["entry"])


def variables(refs: DataFrame, code: DataFrame) -> DataFrame:
    """Places that instructions name: how often, from how many, and in which sizes."""
    sized = code.select(*KEYS, "hunk", "at", F.regexp_extract("name", r"\.([bwl])$", 1).alias("width"))
    joined = refs.where("kind in ('operand', 'relocation')").join(sized, [*KEYS, "hunk", "at"], "left")
    widths = F.array_sort(F.collect_set(F.when(F.col("width") != "", F.col("width"))))
    return joined.groupBy(*KEYS, F.col("to_hunk").alias("hunk"), F.col("to").alias("at")).agg(F.count("*").alias("references"), F.count_distinct("hunk", "at").alias("origins"), widths.alias("widths"))


def boot_code(images: DataFrame) -> DataFrame:
    """The code of images' boot blocks as (path, entry, data), for instructions(raw=True); none where all of it is zero. JVM only."""
    code = F.substring("content", 13, 1012)
    return images.where(F.octet_length("content") >= 1024).select("path", F.lit("boot block").alias("entry"), code.alias("data")).where(F.regexp_like(F.hex("data"), F.lit("[^0]")))


def explained(code: DataFrame) -> DataFrame:
    """Instructions with what they do in words."""

    @F.pandas_udf("string")
    def words(name: pd.Series, operands: pd.Series, flow: pd.Series) -> pd.Series:
        return pd.Series([m68k.explain(m68k.Instruction(0, 0, n, o, f, None)) for n, o, f in zip(name, operands, flow, strict=True)], dtype=object)

    return code.withColumn("meaning", words("name", "operands", "flow"))


def drawn(graph: DataFrame) -> DataFrame:
    """Each program's call graph laid out: label, layer, place in the layer. A graph is drawn in one task, as a picture of it is looked at as one."""
    from palimpsest.functions import graphs

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        edges = list(zip(rows["caller"], rows["callee"], strict=True))
        own = graphs.order([e for e in edges if None not in e], [])
        flat = [(rows["path"].iloc[0], rows["entry"].iloc[0], n, i, k) for i, row in enumerate(own) for k, n in enumerate(row)]
        return pd.DataFrame(flat, columns=["path", "entry", "label", "layer", "place"])

    return graph.groupBy(*KEYS).applyInPandas(draw, "path string, entry string, label string, layer int, place int")


# Notes on a program


def place(text: Column) -> Column:
    """h1_0042 as struct(hunk, at); null for anything else."""
    ok = F.regexp_like(text, F.lit("^h[0-9]+_[0-9a-f]{4,8}$"))
    made = F.struct(F.regexp_extract(text, "^h([0-9]+)_", 1).try_cast("int").alias("hunk"), F.conv(F.regexp_extract(text, "_([0-9a-f]+)$", 1), 16, 10).cast("bigint").alias("at"))
    return F.when(ok, made)


def place_text(hunk: Column, at: Column) -> Column:
    return F.concat(F.lit("h"), hunk.cast("string"), F.lit("_"), F.lpad(F.lower(F.hex(at)), 4, "0"))


def note_problem(label: Column, comment: Column) -> Column:
    """What is wrong with a note: its label must be an assembler's symbol and not look like a place, its comment one line of at most 1,024 letters; null: nothing."""
    return (
        F.when(label.isNotNull() & ~F.regexp_like(label, F.lit("^[A-Za-z_.][A-Za-z0-9_.$]{0,63}$")), "label")
        .when(F.regexp_like(label, F.lit("^h[0-9]+_[0-9a-f]+$")), "label looks like a place").when(F.regexp_like(comment, F.lit("[\\x00-\\x1F]")) | (F.length(comment) > 1024), "comment")
    )


def annotate(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """Notes (sha1, hunk, at, label, comment) after changes of the same columns and seq: the last one of a place counts, one without label and comment takes the note away."""
    both = notes.withColumn("seq", F.lit(-1).cast("bigint")).unionByName(changes.where(note_problem(F.col("label"), F.col("comment")).isNull()).withColumn("seq", F.col("seq").cast("bigint")))
    last = both.groupBy("sha1", "hunk", "at").agg(F.max_by(F.struct("label", "comment"), "seq").alias("n"))
    return last.select("sha1", "hunk", "at", "n.label", "n.comment").where("label is not null or comment is not null")


def with_notes(code: DataFrame, notes: DataFrame, sha1: str = "sha1") -> DataFrame:
    """Instructions (with their program's sha1) and what is noted about their places."""
    return code.join(notes.withColumnRenamed("sha1", sha1), [sha1, "hunk", "at"], "left")


def save_notes(notes: DataFrame, root: str) -> None:
    """Writes the notes of the programs named in them; other programs' notes at root stay."""
    notes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sha1").parquet(root)


def load_notes(spark, root: str) -> DataFrame:
    return spark.read.schema("hunk int, at bigint, label string, comment string, sha1 string").parquet(root).select("sha1", "hunk", "at", "label", "comment")
