"""Operators over disk images: each takes rows (path, content) and gives a table.

An image's structures are pointers within its own bytes, so an image is read where its bytes are: one pass over
the images, nothing shuffled, memory for one image and the rows it gives. What spans images (summaries, votes, comparisons,
identification) are joins and aggregations over these tables. A null content is an image of no bytes.
Repeated rows give repeated results, an empty table none; columns other than path and content aren't read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from palimpsest.functions import edit, health, image, search, tracks
from palimpsest.functions.image import BLOCK, Image
from palimpsest.functions.volume import DIRECTORIES, FILES, Unreadable, compare_cache, protection_text
from palimpsest.operators import relational

#: Rows that are held before they leave a task, and bytes.
ROWS, BYTES = 4096, 32 << 20


def schema_of(text: str) -> StructType:
    from pyspark.sql import types as T

    return T._parse_datatype_string(text)


class Made:
    """Images that are made of rows by the task that reads them. Each is made and read on its own, so a task holds one at a time, whatever the
    number of images, and none crosses from one process to another.

    rows: a column path and what images are made of, gathered by path. make: a path's rows as an Arrow table to tuples of content and the values of fields.
    """

    def __init__(self, rows: DataFrame, make: Callable[[pa.Table], Iterable[tuple]], fields: StructType = StructType([])):  # noqa: B008
        self.rows, self.make, self.fields = rows, make, fields

    def then(self, kernel: Callable[[bytes], Iterable[tuple]], fields: str = "", also: list[str] = ()) -> Made:
        """Images made of these: the kernel gives content and fields of each, from an image's bytes (and the `also` values)."""
        make, given = self.make, [self.fields.names.index(c) for c in also]

        def both(group: pa.Table):
            for content, *values in make(group):
                yield from kernel(content, *[values[i] for i in given])

        return Made(self.rows, both, schema_of(fields) if fields else StructType([]))

    def read(self, kernel: Callable[[bytes], Iterable[tuple]], fields: str, also: list[str] = ()) -> DataFrame:
        make, given = self.make, [self.fields.names.index(c) for c in also]
        schema = StructType([self.rows.schema["path"], *[self.fields[i] for i in given], *schema_of(fields).fields])
        arrow = to_arrow_schema(schema)

        def run(group: pa.Table) -> pa.Table:
            path, out = group.column("path")[0].as_py(), []
            for content, *values in make(group):
                mine = [path, *[values[i] for i in given]]
                out += [(*mine, *row) for row in kernel(b"" if content is None else content, *mine[1:])]
            return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow) if out else arrow.empty_table()

        return self.rows.groupBy("path").applyInArrow(run, schema)

    def frame(self) -> DataFrame:
        """The images as rows (path, content, fields)."""
        names = self.fields.names
        if not names:
            return self.read(lambda content: [(content,)], "content binary")
        return self.read(lambda content, *_: [(content,)], "content binary", names).select("path", "content", *names)


def per_image(images: DataFrame | Made, kernel: Callable[[bytes], Iterable[tuple]], fields: str, also: list[str] = ()) -> DataFrame:
    """path, the `also` columns, and the fields of each tuple that the kernel gives for an image's bytes (and the `also` values)."""
    if isinstance(images, Made):
        return images.read(kernel, fields, also)
    source = images.select("path", F.coalesce("content", F.lit(b"")).alias("content"), *also)
    schema = StructType([f for f in source.schema.fields if f.name != "content"] + schema_of(fields).fields)
    arrow, n = to_arrow_schema(schema), 1 + len(also)

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            paths, extra = batch.column(0), [batch.column(2 + i) for i in range(n - 1)]
            for i in range(batch.num_rows):
                mine = [paths[i].as_py(), *[c[i].as_py() for c in extra]]
                for row in kernel(batch.column(1)[i].as_py(), *mine[1:]):
                    rows.append((*mine, *row))
                    size += sum(len(x) for x in row if isinstance(x, bytes))
                    if len(rows) >= ROWS or size >= BYTES:
                        yield table(rows)
                        rows, size = [], 0
            if rows:
                yield table(rows)

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return source.mapInArrow(run, schema)


def mounted(content: bytes):
    """(area, volume) of each volume in an image."""
    for area in Image.open(content).areas():
        v = area.mount()
        if v is not None:
            yield area, v


# What an image is


def info(images: DataFrame) -> DataFrame:
    """One row an image: container and how it was told, compression, geometry, device, boot block, volume (null: absent), tracks, assembly, description, boot text, faults."""

    def one(content: bytes):
        x = Image.open(content)
        g, a = x.geometry, next(x.areas(), None)
        v = a.mount() if a is not None else None
        boot = x.data[:1024] if len(x.data) >= 1024 else None
        volume = None
        if v is not None:
            root = v.words[v.root]
            volume = {"name": v.counted(v.root, 80, 30).decode("latin-1"), "rootblock": v.root, "hash_table_size": v.slots, "checksum_valid": v.sums_to_zero(v.root), "bitmap_flag_valid": int(root[-50]) == 0xFFFFFFFF, "created": [int(i) for i in root[-7:-4]], "modified": [int(i) for i in root[-10:-7]], "root_altered": [int(i) for i in root[-23:-20]]}
        yield (
            x.container, x.evidence, x.compression, x.size, g and {"cylinders": g.cylinders, "heads": g.heads, "sectors": g.sectors, "block_size": g.block_size, "total_blocks": g.blocks},
            x.device and {k: x.device[k] for k in ("block", "cylinders", "heads", "sectors", "checksum_valid")}, len(x.partitions),
            boot and {"is_dos": boot[:3] == b"DOS", "flags": boot[3], "checksum_valid": int.from_bytes(boot[4:8], "big") == image.boot_sum(boot), "has_boot_code": any(boot[12:]), "prefix": "".join(chr(c) if 32 <= c < 127 else "." for c in boot[:4])},
            volume, len(x.tracks), x.assembly and {"placed": x.assembly.placed, "total": x.assembly.total, "percent": x.assembly.percent}, image.description(v) if v is not None else None, image.boot_text(boot) if boot else [], x.faults,
        )

    stamp = "array<bigint>"
    return per_image(
        images, one,
        "container string, evidence string, compression string, size bigint, geometry struct<cylinders: int, heads: int, sectors: int, block_size: int, total_blocks: bigint>, "
        "device struct<block: bigint, cylinders: bigint, heads: bigint, sectors: bigint, checksum_valid: boolean>, n_partitions int, "
        "bootblock struct<is_dos: boolean, flags: int, checksum_valid: boolean, has_boot_code: boolean, prefix: string>, "
        f"volume struct<name: string, rootblock: bigint, hash_table_size: int, checksum_valid: boolean, bitmap_flag_valid: boolean, created: {stamp}, modified: {stamp}, root_altered: {stamp}>, "
        "tracks int, assembly struct<placed: int, total: int, percent: int>, description string, boot_text array<string>, faults array<string>",
    )


def devices(images: DataFrame) -> DataFrame:
    """One row a partition, in the list's order, with what its volume is called."""

    def one(content: bytes):
        x = Image.open(content)
        names = {a.first: (v.counted(v.root, 80, 30).decode("latin-1") if (v := a.mount()) else None) for a in x.areas()}
        for i, p in enumerate(x.partitions):
            yield i, p.block, p.name, p.low, p.high, p.first, p.blocks, p.block_size, p.reserved, p.priority, p.dostype.hex().upper(), p.bootable, p.sound, names.get(p.first)

    return per_image(images, one, "seq int, block bigint, name string, low_cylinder bigint, high_cylinder bigint, first_block bigint, blocks bigint, block_size int, reserved int, priority int, dostype string, bootable boolean, checksum_valid boolean, volume_name string")


def read_range(images: DataFrame, offset: int, length: int) -> DataFrame:
    """Bytes of each image, as stored; JVM only."""
    return images.select("path", F.substring("content", offset + 1, length).alias("bytes"))


# Trees and files


def walk(images: DataFrame, hashes: bool = False) -> DataFrame:
    """Every entry of every volume's tree, in the walk's order; hit_limit where the walk was cut at as many entries as there are blocks. sha1 of files' contents if asked for."""

    def one(content: bytes):
        for area, v in mounted(content):
            found = v.walk()
            for seq, (path, e) in enumerate(found.entries):
                sha = None
                if hashes and e.kind in FILES:
                    try:
                        sha = hashlib.sha1(v.read(e).data).hexdigest()
                    except Unreadable:
                        pass
                yield (area.partition, seq, path, e.text, e.kind, e.size, e.block, e.parent, protection_text(e.protection), e.protection, e.comment.decode("latin-1"), list(e.stamp), e.sound, sha, found.hit_limit)

    return per_image(images, one, "partition string, seq bigint, entry string, name string, kind string, size bigint, block bigint, parent bigint, protection string, protection_bits bigint, comment string, altered array<bigint>, checksum_valid boolean, sha1 string, hit_limit boolean")


def listing(images: DataFrame, directory: str = "", partition: str | None = None) -> DataFrame:
    """One directory's entries, by name in lower case, then block."""

    def one(content: bytes):
        x = Image.open(content)
        area = x.area(partition) if partition is not None else next(x.areas(), None)
        v = area.mount() if area is not None else None
        if v is None:
            return
        try:
            found, _ = v.lookup(directory)
            rows = v.list(v.root if found is None else found.block).entries
        except Unreadable:
            return
        for e in sorted(rows, key=lambda e: (e.text.lower(), e.block)):
            yield e.text, e.kind, e.size, e.block, protection_text(e.protection), e.comment.decode("latin-1"), e.sound

    return per_image(images, one, "name string, kind string, size bigint, block bigint, protection string, comment string, checksum_valid boolean")


def lookup(images: DataFrame, entry: str) -> DataFrame:
    """What a path names in each volume: block, kind, the path by its parents, and the components that only a search of the directory found; or why not."""

    def one(content: bytes):
        for area, v in mounted(content):
            try:
                e, walked = v.lookup(entry)
                yield area.partition, e.block if e else v.root, e.kind if e else "root", v.path_of(e) if e else "", walked, None
            except Unreadable as x:
                yield area.partition, None, None, None, [], x.fault.kind

    return per_image(images, one, "partition string, block bigint, kind string, full_path string, walked array<string>, fault string")


def directory_damage(images: DataFrame) -> DataFrame:
    """Directories whose chains break, loop or merge, one row a fault."""

    def one(content: bytes):
        for area, v in mounted(content):
            for path, block, found in v.walk().damaged:
                for f in (*found.faults, *found.cycles, *found.merges):
                    yield area.partition, path, block, f.kind, f.block, f.detail

    return per_image(images, one, "partition string, directory string, directory_block bigint, fault string, block bigint, detail string")


def files(images: DataFrame) -> DataFrame:
    """Every file's bytes (null: unreadable, and why), cut to its declared size; faults of data blocks by kind."""

    def one(content: bytes):
        for area, v in mounted(content):
            for seq, (path, e) in enumerate(v.walk().entries):
                if e.kind not in FILES:
                    continue
                try:
                    c = v.read(e)
                    yield area.partition, seq, path, c.data, c.declared, c.short_by, c.exceeded, [{"code": a, "first_block": b, "first_index": i, "count": n} for a, b, i, n in c.faults], None
                except Unreadable as x:
                    yield area.partition, seq, path, None, e.size, e.size, False, [], x.fault.kind

    return per_image(images, one, "partition string, seq bigint, entry string, data binary, declared_size bigint, short_by bigint, exceeded_volume boolean, faults array<struct<code: string, first_block: bigint, first_index: bigint, count: bigint>>, unreadable string")


def file_totals(images: DataFrame | Made, also: list[str] = ()) -> DataFrame:
    """One row an image: its files, their declared bytes (null: no files), and how many can't be read. The same as sums over files(), but no file's bytes leave the task."""

    def one(content: bytes, *_):
        n, declared, unreadable = 0, None, 0
        for _, v in mounted(content):
            for _, e in v.walk().entries:
                if e.kind in FILES:
                    try:
                        size = v.read(e).declared
                    except Unreadable:
                        size, unreadable = e.size, unreadable + 1
                    n, declared = n + 1, (declared or 0) + size
        yield n, declared, unreadable

    return per_image(images, one, "files bigint, bytes bigint, unreadable bigint", also)


def file_blocks(images: DataFrame) -> DataFrame:
    """Each block of each file: header, data and list blocks, in the file's order."""

    def one(content: bytes):
        for area, v in mounted(content):
            for path, e in v.walk().entries:
                if e.kind in FILES:
                    yield area.partition, path, e.block, 0, e.block, "header"
                    for i, (b, data) in enumerate(v.file_table(e), 1):
                        yield area.partition, path, e.block, i, b, "data" if data else "list"

    return per_image(images, one, "partition string, entry string, header bigint, seq bigint, block bigint, role string")


def directory_caches(images: DataFrame) -> DataFrame:
    """Where directory caches and directories differ: block, field (or not-in-directory, not-in-cache), words; a broken chain is chain-broken."""

    def one(content: bytes):
        for area, v in mounted(content):
            for block in [v.root, *[e.block for _, e in v.walk().entries if e.kind == "directory"]] if v.cached else []:
                _, records, faults = v.cache(block)
                for f in faults:
                    yield area.partition, block, f.block, "chain-broken", f.detail
                try:
                    for b, what, said in compare_cache(records, v.list(block).entries):
                        yield area.partition, block, b, what, said
                except Unreadable:
                    pass

    return per_image(images, one, "partition string, directory bigint, block bigint, difference string, detail string")


# Health


def findings(images: DataFrame, partition: str | None = None) -> DataFrame:
    """All findings, the gravest first (seq)."""

    def one(content: bytes):
        for part, _, r in image.examine(Image.open(content), partition):
            for seq, f in enumerate(r.findings):
                yield part, seq, f.code, f.severity, f.block, f.message

    return per_image(images, one, "partition string, seq int, code string, severity string, block bigint, message string")


def check(images: DataFrame) -> DataFrame:
    """One row a volume (or an image without any): kind, tree, bitmap, cache and counts of findings."""

    def one(content: bytes):
        for part, first, r in image.examine(Image.open(content)):
            n = r.counts()
            yield (
                part, first, r.kind, r.directories, r.files, r.bytes_recovered,
                {"marked_used": r.marked_used, "actually_used": r.actually_used, "covered": r.covered, "at_risk": len(r.at_risk), "orphaned": len(r.orphaned), "free_holding_data": len(r.holding), "fill_percent": r.marked_used * 100 // r.covered if r.covered else 0},
                r.cache, n["info"], n["warning"], n["error"], r.worst, r.sound,
            )

    counts = ", ".join(f"{k}: bigint" for k in ("marked_used", "actually_used", "covered", "at_risk", "orphaned", "free_holding_data", "fill_percent"))
    cache = ", ".join(f"{k}: bigint" for k in ("directories", "blocks", "records", "disagreements"))
    return per_image(images, one, f"partition string, first_block bigint, kind string, directories bigint, files bigint, bytes_recovered bigint, bitmap struct<{counts}>, dircache struct<{cache}>, info int, warning int, error int, worst string, sound boolean")


def block_counts(checked: DataFrame) -> DataFrame:
    """Of each image's volumes together: blocks that bitmaps cover, and those in use."""
    return checked.groupBy("path").agg(F.sum("bitmap.covered").alias("covered"), F.sum("bitmap.marked_used").alias("used"))


def damage(images: DataFrame) -> DataFrame:
    """The gravest damage of each block of an image, numbered from its beginning."""

    def one(content: bytes):
        for _, first, r in image.examine(Image.open(content)):
            for b, what in health.damage(r).items():
                yield first + b, what

    return per_image(images, one, "block bigint, damage string")


def bitmap(images: DataFrame) -> DataFrame:
    """Blocks whose state in the bitmap and in the tree differ: orphaned (in use, unreachable) and at risk (reachable, free)."""

    def one(content: bytes):
        for part, _, r in image.examine(Image.open(content)):
            for state, blocks in (("orphaned", r.orphaned), ("at risk", r.at_risk)):
                for b in blocks:
                    yield part, b, state

    return per_image(images, one, "partition string, block bigint, state string")


# What blocks are for, and what lies between


def layout(images: DataFrame, partition: str | None = None) -> DataFrame:
    """Spans that tile an image (or a partition): region, path and header of the owner."""

    def one(content: bytes):
        x = Image.open(content)
        area = x.area(partition) if partition is not None else None
        if partition is None or area is not None:
            for block, n, region, path, header in image.spans(x, area):
                yield block, n, block * BLOCK, region, path, header

    return per_image(images, one, "block bigint, blocks bigint, offset bigint, region string, file string, file_block bigint")


def layout_totals(spans: DataFrame) -> DataFrame:
    return spans.groupBy("path", "region").agg(F.sum("blocks").alias("blocks"))


def fragmentation(spans: DataFrame) -> DataFrame:
    """Files with blocks, and how many lie in more than one span."""
    runs = spans.where("region = 'file'").groupBy("path", "file_block").agg(F.count("*").alias("runs"))
    return runs.groupBy("path").agg(F.count("*").alias("files"), F.count_if(F.col("runs") > 1).alias("in_pieces"))


def carve(images: DataFrame) -> DataFrame:
    """Headers that nothing claims, graded, with the bytes that prove themselves and a name to write them under."""

    def one(content: bytes):
        x = Image.open(content)
        areas = {a.partition: image.Blocks(a.data, a.block_size, a.reserved) for a in x.areas()}
        for c in image.carve(x):
            e = c.entry
            yield c.partition, e.block, e.text, e.size, e.kind, c.evidence, len(c.good), c.bad, c.recoverable, image.recovered_name(c), image.contents(areas[c.partition], c)

    return per_image(images, one, "partition string, block bigint, name string, size bigint, kind string, evidence string, data_blocks bigint, bad_blocks bigint, recoverable boolean, recovered_name string, data binary")


def scan(images: DataFrame, table: list[tuple[str, str, bytes, bool]] = search.SIGNATURES, block_size: int = BLOCK) -> DataFrame:
    """Magics found anywhere in each image's blocks. table: name, category, magic, whether only beginnings of blocks count; of any length."""

    def one(content: bytes):
        for h in search.scan(Image.open(content).data, block_size, table):
            yield h.name, h.category, h.offset, h.block, h.blocks

    return per_image(images, one, "name string, category string, offset bigint, block bigint, blocks bigint")


def find(images: DataFrame, pattern: str, force_text: bool = False, ignore_case: bool = False) -> DataFrame:
    """Every occurrence of a text or hex pattern with the owner of the block that it begins in."""
    wanted = search.Pattern.parse(pattern, force_text, ignore_case)

    def one(content: bytes):
        x = Image.open(content)
        owned = None
        for at in search.search(x.data, wanted):
            owned = image.claims(x)[0] if owned is None else owned
            region, path, header = owned.get(at // BLOCK, ("unclaimed", None, None))
            yield at, at // BLOCK, region, path, header

    return per_image(images, one, "offset bigint, block bigint, region string, file string, file_block bigint")


def find_names(images: DataFrame, part: str) -> DataFrame:
    """Entries of all volumes of all images whose name has the text, whatever its case."""
    return walk(images).where(F.contains(F.lower("name"), F.lit(part.lower())))


# Tracks


def track_table(images: DataFrame) -> DataFrame:
    """Tracks of extended images as their table states them, with what decoding gives for raw ones."""

    def one(content: bytes):
        try:
            table, _ = tracks.extended_tracks(content)
        except ValueError:
            return
        for t in table:
            d = tracks.decode_track(content[t.at : t.at + t.space]) if t.kind == "raw" and t.inside else None
            yield t.index, t.kind, t.space, t.bits, t.at, t.inside, d and len(d.sectors), d and sum(s.sound for s in d.sectors), d and d.stray_syncs, d and d.violations, d and d.standard()

    return per_image(images, one, "track int, kind string, space bigint, bits bigint, offset bigint, inside boolean, sectors int, sound int, stray_syncs int, clock_violations int, standard boolean")


def sectors(images: DataFrame) -> DataFrame:
    """Sectors that raw tracks and flux revolutions decode to."""

    def one(content: bytes):
        x = content
        if x[:8] == tracks.EXTENDED:
            try:
                rows = [(t.index, 0, x[t.at : t.at + t.space], None) for t in tracks.extended_tracks(x)[0] if t.kind == "raw" and t.inside]
            except ValueError:
                return
        elif x[:3] == b"SCP":
            try:
                table = tracks.flux_table(x)["tracks"]
            except ValueError:
                return
            rows = []
            for slot, revolutions in table.items():
                for rev, (_, count, at) in enumerate(revolutions):
                    ticks = tracks.intervals(x, at, count)
                    if ticks is not None:
                        bits = tracks.flux_bits(ticks)
                        rows.append((slot, rev, bits["bits"], bits["locked"]))
        else:
            return
        for track, rev, bits, locked in rows:
            for s in tracks.decode_track(bits).sectors:
                yield track, rev, locked, s.bit, s.track, s.number, s.to_gap, s.header_ok, s.data_ok, s.violations, s.data

    return per_image(images, one, "track int, revolution int, locked boolean, bit bigint, own_track int, sector int, to_gap int, header_valid boolean, data_valid boolean, clock_violations int, data binary")


def surface(images: DataFrame) -> DataFrame:
    """160 rows an image of tracks: sectors placed of eleven, and where they come from."""

    def one(content: bytes):
        x = Image.open(content)
        if x.assembly is None:
            return
        rows = {t: (n, source) for t, n, source in x.assembly.tracks}
        for t in range(tracks.TRACKS):
            n, source = rows.get(t, (0, "empty"))
            yield t, t // 2, t % 2, n, tracks.PER_TRACK, source

    return per_image(images, one, "track int, cylinder int, head int, sectors int, expected int, source string")


# Turning images into others


def convert(images: DataFrame | Made, target: str) -> DataFrame | Made:
    """Each image as the target container, only where nothing is lost: outcome (converted, lossy, not-implemented, refused, failed) and bytes (of images made where they are read: their content)."""
    from palimpsest.plans.formats import verdict_of

    def one(content: bytes, *_):
        x = Image.open(content)
        source = "gzip" if x.compression else x.container
        outcome = verdict_of(source, target)
        if outcome != "lossless":
            yield source, outcome.replace(" ", "-"), None
        elif target == "extended-adf":
            data = x.data
            if len(data) != tracks.TRACKS * tracks.PER_TRACK * tracks.SECTOR:
                yield source, "failed", None
                return
            yield source, "converted", as_extended(data)
        else:
            yield source, "converted", x.data

    if isinstance(images, Made):
        return images.then(lambda content: ((data, source, outcome) for source, outcome, data in one(content)), "source string, outcome string")
    return per_image(images, one, "source string, outcome string, data binary")


def as_extended(data: bytes) -> bytes:
    """Plain sectors as an extended image of raw tracks."""
    each = tracks.PER_TRACK * tracks.SECTOR
    n = len(data) // each
    return tracks.extended_image([(True, x) for x in tracks.encode_tracks(list(range(n)), tracks.PER_TRACK, data[: n * each])])


CHANGES = "array<struct<op: string, path: string, other: string, data: binary>>"


def apply_changes(images: DataFrame | Made, changes: str = "changes", judged: bool = True) -> DataFrame | Made:
    """Each image after its row's changes, in order: content, how many were made, and why the first refused one was; a refusal ends the row's changes.

    changes: array of struct(op, path, other, data). op: mkdir, put (data), rm, rmtree, rename (other: name), mv (other: folder), link (other: target), undelete (path: block), repair,
    repair-free, wipe, wipe-free, format (path: name, other: flags), undo, redo; on devices partition-rename, -boot, -delete, -add (path: name:cylinders), -grow (other: cylinders).
    Unless judged is off, the volume is examined after each change, and one that brings findings of a warning or worse is refused.
    """

    def one(content: bytes, wanted):
        e, done, why = None, 0, None
        try:
            for c in wanted or []:
                op, path, other, data = c["op"], c["path"] or "", c["other"] or "", c["data"]
                if op.startswith("partition-"):
                    content = bytes(e.data) if e is not None else content
                    e = None
                    run = {
                        "rename": lambda: edit.partition_rename(content, path, other), "boot": lambda: edit.partition_boot(content, path, other != "off"), "delete": lambda: edit.partition_delete(content, path),
                        "add": lambda: edit.partition_add(content, edit.Spec.parse(path)), "grow": lambda: edit.partition_grow(content, path, int(other)),
                    }[op[10:]]
                    content = run()
                else:
                    if e is None and op != "format":
                        e = edit.Editor(content, judged=judged)
                    if op == "format":
                        e = edit.Editor(edit.blank(len(content) // BLOCK, path, int(other or 0)), judged=judged)
                    else:
                        {
                            "mkdir": lambda: e.make_dir(path), "put": lambda: e.add_file(path, data or b""), "rm": lambda: e.delete(path), "rmtree": lambda: e.delete_tree(path), "rename": lambda: e.rename(path, other),
                            "mv": lambda: e.move(path, other), "link": lambda: e.make_link(path, other), "undelete": lambda: e.undelete(int(path)), "repair": lambda: e.repair(), "repair-free": lambda: e.repair(True),
                            "wipe": lambda: e.wipe(True, False), "wipe-free": lambda: e.wipe(False, True), "undo": lambda: e.undo(), "redo": lambda: e.redo(),
                        }[op]()
                done += 1
        except (edit.Refused, image.NotMounted, Unreadable, KeyError, ValueError) as x:
            why = str(x) or type(x).__name__
        yield bytes(e.data) if e is not None else content, done, why

    if isinstance(images, Made):
        return images.then(one, "made int, refused string", [changes])
    return per_image(images, one, "content binary, made int, refused string", [changes]).drop(changes)


def blanks(rows: DataFrame, path: str = "path", blocks: str = "blocks", name: str = "name", flags: str = "flags") -> DataFrame:
    """Rows (path, blocks, name, flags) as (path, content) of formatted volumes."""
    given = rows.select(F.col(path).alias("path"), F.lit(None).cast("binary").alias("content"), F.col(blocks).cast("int").alias("_n"), F.col(name).alias("_name"), F.col(flags).cast("int").alias("_flags"))
    made = per_image(given, lambda _, n, label, f: [(edit.blank(n, label, f),)], "content binary", ["_n", "_name", "_flags"])
    return made.select("path", "content")


def volumes_of(contents: DataFrame, path: str, name: str, data: str, flags: int = 0) -> DataFrame:
    """(path, content) of one new volume a path that holds all its rows as files; a volume is as large as its files need.

    A path's files must fit a task's memory, as a volume does.
    """
    return made_volumes(contents, path, name, data, flags).frame()


def made_volumes(contents: DataFrame, path: str, name: str, data: str, flags: int = 0, gathered: str | None = None) -> Made:
    """The volumes of volumes_of(), made where they are read. gathered: a column whose values each image has as an array of the same name, nulls left out, in the order of its files' names."""
    rows = contents.select(F.col(path).alias("path"), F.col(name).alias("name"), F.col(data).alias("data"), *[gathered] if gathered else [])

    def build(group: pa.Table):
        names, contents = group.column("name").to_pylist(), group.column("data").to_pylist()
        order = sorted(range(len(names)), key=lambda i: names[i])
        payload = 488 if flags % 2 == 0 else 512
        need = sum(2 + -(-len(x) // payload) * 73 // 72 for x in contents)
        e = edit.Editor(edit.blank(max(1760, need * 9 // 8 + 64), "Built", flags), judged=False)
        e.add_files([(names[i], contents[i]) for i in order])
        if gathered:
            values = group.column(gathered).to_pylist()
            yield bytes(e.data), [values[i] for i in order if values[i] is not None]
        else:
            yield (bytes(e.data),)

    return Made(rows, build, schema_of(f"{gathered} array<{rows.schema[gathered].dataType.simpleString()}>") if gathered else StructType([]))


# Corpus


def batch(images: DataFrame | Made, dataset: DataFrame | None = None, target: str | None = None) -> DataFrame:
    """One record an image: container, volume, tree, findings' codes, worst, conversion's outcome, sha1; names of the dataset's entries (name, crc, size, sha1) if given.

    A null content is unreadable, and a row all the same.
    """
    from palimpsest.plans.formats import verdict_of

    def one(content: bytes, there: bool):
        if not there:
            yield "unreadable", 0, None, None, 0, 0, 0, [], None, "unreadable", None, None, False
            return
        x = Image.open(content)
        reports = image.examine(x)
        codes = sorted({f.code for _, _, r in reports for f in r.findings})
        worst = max((r.worst for _, _, r in reports if r.worst), key=health.SEVERITIES.index, default=None)
        names = [v.counted(v.root, 80, 30).decode("latin-1") for a in x.areas() if (v := a.mount())]
        kind = "gzip" if x.compression else x.container
        outcome = None if target is None else verdict_of(kind, target).replace("lossless", "converted").replace(" ", "-")
        plain = x.data
        yield (
            kind, len(content), hashlib.sha1(plain).hexdigest(), names[0] if names else None, sum(r.files for _, _, r in reports), sum(r.directories for _, _, r in reports), sum(r.bytes_recovered for _, _, r in reports),
            codes, worst, None, outcome, {"crc": zlib.crc32(plain), "size": len(plain)}, bool(names) and worst in (None, "info"),
        )

    if isinstance(images, Made):
        given = images.then(lambda content: [(content, content is not None)], "_there boolean")
    else:
        given = images.withColumn("_there", F.col("content").isNotNull())
    made = per_image(given, one, "container string, size bigint, sha1 string, volume string, files bigint, directories bigint, bytes_recovered bigint, findings array<string>, worst string, unreadable string, conversion string, _key struct<crc: bigint, size: bigint>, sound boolean", ["_there"]).drop("_there")
    if dataset is not None:
        probes = made.select("path", F.col("_key.crc").alias("crc"), F.col("_key.size").alias("size"), "sha1").where("sha1 is not null")
        named = relational.identify(probes, dataset, "path", "sha1", ["crc", "size"], "name").select("path", F.col("class").alias("identified"), F.col("name").alias("match"))
        made = made.join(named.dropDuplicates(["path"]), "path", "left")
    return made.drop("_key")


def batch_summary(records: DataFrame) -> DataFrame:
    """One row: images examined, unreadable, mounted, sound, at risk (worst is error), bytes recovered."""
    return records.agg(
        F.count("*").alias("examined"), F.count("unreadable").alias("unreadable"), F.count("volume").alias("mounted"), F.count_if("sound").alias("sound"),
        F.count_if(F.col("worst") == "error").alias("at_risk"), F.coalesce(F.sum("bytes_recovered"), F.lit(0)).alias("bytes_recovered"),
    )


def histogram(records: DataFrame, column: str) -> DataFrame:
    """Images by a column's value; an array's values count once an image."""
    values = F.explode(F.array_distinct(column)) if records.schema[column].dataType.typeName() == "array" else F.col(column)
    return records.select(values.alias(column)).where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("images"))


def sector_rows(images: DataFrame) -> DataFrame:
    """path, sector, data of each whole sector; JVM only."""
    n = F.floor(F.octet_length("content") / BLOCK).cast("int")
    numbered = images.where(n > 0).select("path", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("sector"))
    return numbered.select("path", F.col("sector").cast("bigint").alias("sector"), F.substring("content", F.col("sector") * BLOCK + 1, F.lit(BLOCK)).alias("data"))


#: Bytes of the pieces that dumps are compared in.
PIECE = 512 * BLOCK


class Ballot:
    """A vote over the sectors of one piece. Dumps come one by one; of those that agree with the first only numbers are kept, so memory goes by contents, not by dumps."""

    def __init__(self):
        self.base, self.sources, self.others = None, [], {}

    def add(self, source: str | None, data: bytes) -> None:
        import numpy as np

        x = np.frombuffer(data, np.uint64).reshape(-1, BLOCK // 8)
        self.sources.append(source)
        new = len(self.sources) - 1
        if self.base is None:
            self.base, self.n, self.first = x, np.ones(len(x), np.int64), np.zeros(len(x), np.int64)
            return
        equal = (x == self.base).all(axis=1)
        self.n += equal
        for old in np.unique(self.first).tolist():
            if self.before(new, old):
                self.first[equal & (self.first == old)] = new
        for i in np.flatnonzero(~equal).tolist():
            values = self.others.setdefault(i, {})
            n, old = values.get(value := x[i].tobytes(), (0, new))
            values[value] = n + 1, new if self.before(new, old) else old

    def before(self, a: int, b: int) -> bool:
        a, b = self.sources[a], self.sources[b]
        return a is not None and (b is None or a < b)

    def count(self) -> tuple[list[int], list[int], bytes]:
        """Sectors that a sole lead resolves, sectors with a tied lead, and the chosen bytes: a tied lead takes what the first source says."""
        resolved, unresolved, chosen = [], [], bytearray(self.base.tobytes())
        for i, others in sorted(self.others.items()):
            values = {self.base[i].tobytes(): (int(self.n[i]), int(self.first[i])), **others}
            top = max(n for n, _ in values.values())
            lead = [v for v, (n, _) in values.items() if n == top]
            value = lead[0]
            if len(lead) > 1:
                for v, (_, source) in values.items():
                    if self.before(source, values[value][1]):
                        value = v
            (resolved if len(lead) == 1 else unresolved).append(i)
            chosen[i * BLOCK : (i + 1) * BLOCK] = value
        return resolved, unresolved, bytes(chosen)


def consolidate(dumps: DataFrame, group: str = "title") -> DataFrame:
    """One image of each group's dumps, by a vote over every sector: report and merged bytes.

    dumps: group, path, content. Dumps of a group must have one size of whole sectors, else the row is refused. A sector of one content is unanimous, a sole lead resolves it, a tied
    lead is unresolved and takes the first dump's (by path). Two dumps can be compared but can't vote. Dumps are dealt out in pieces, so neither large images nor many dumps meet in one task.
    """
    size = F.octet_length("content")
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(size / PIECE), F.lit(1)).cast("int") - 1)  # the first piece of every dump is there, even of none
    rows = dumps.select(F.col(group).alias("group"), F.col("path").alias("source"), size.cast("bigint").alias("size"), "content", F.explode(pieces).alias("piece"))
    rows = rows.select("group", "piece", "source", "size", F.substring("content", F.col("piece") * PIECE + 1, F.lit(PIECE)).alias("data"))
    fields = "sources bigint, size bigint, most bigint, read bigint, sectors bigint, resolved array<bigint>, unresolved array<bigint>, merged binary"
    schema = StructType([rows.schema["group"], rows.schema["piece"], *schema_of(fields).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources, sizes, read, votes, key = 0, set(), 0, Ballot(), None
        for batch in batches:
            for i in range(batch.num_rows):
                title, piece, source, size, data = (batch.column(c)[i].as_py() for c in range(5))
                key, sources = (title, piece), sources + 1
                if data is not None:
                    read += 1
                    sizes.add(size)
                    if len(sizes) == 1 and size and size % BLOCK == 0:
                        votes.add(source, data)
        resolved, unresolved, merged = votes.count() if votes.base is not None else ([], [], b"")
        at = key[1] * PIECE // BLOCK
        row = (*key, sources, min(sizes, default=None), max(sizes, default=None), read, len(merged) // BLOCK, [at + s for s in resolved], [at + s for s in unresolved], merged)
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, arrow, strict=True)], schema=arrow)

    voted = rows.groupBy("group", "piece").applyInArrow(run, schema)
    numbers = lambda c: F.array_sort(F.flatten(F.collect_list(c)))
    merged = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", F.hex("merged").alias("h")))), lambda x: x["h"]), "")
    each = voted.groupBy("group").agg(
        F.max("sources").alias("sources"), F.min("size").alias("size"), F.max("most").alias("most"), F.max("read").alias("read"), F.sum("sectors").alias("sectors_total"),
        F.sum(F.size("resolved")).alias("resolved_sectors"), F.sum(F.size("unresolved")).alias("unresolved_sectors"), numbers("resolved").alias("disputed"), numbers("unresolved").alias("unresolved"), merged.alias("merged"),
    )
    fit = (F.col("sources") >= 2) & (F.col("size") == F.col("most")) & (F.col("read") == F.col("sources")) & (F.col("size") % BLOCK == 0) & (F.col("size") > 0)
    judged = each.withColumn("refused", F.when(F.col("sources") < 2, "one dump").when(~fit, "sizes differ or aren't whole sectors"))
    told = lambda c, name: F.when(F.col("refused").isNull(), c).alias(name)
    return judged.select(
        F.col("group").alias(group), "sources", "refused", (F.col("refused").isNull() & (F.col("sources") > 2)).alias("can_vote"), told(F.col("sectors_total"), "sectors_total"),
        told(F.col("sectors_total") - F.col("resolved_sectors") - F.col("unresolved_sectors"), "unanimous"), told(F.col("resolved_sectors"), "resolved_sectors"), told(F.col("unresolved_sectors"), "unresolved_sectors"),
        told(F.col("disputed"), "disputed"), told(F.col("unresolved"), "unresolved"), told(F.unhex("merged"), "merged"),
    )


def compare(pairs: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """Two images a row (path, left, right): sectors and bytes that differ, and their tracks; refused where sizes differ or aren't whole sectors."""

    def one(a: bytes, b: bytes):
        import numpy as np

        a, b = a or b"", b or b""
        if len(a) != len(b) or len(a) % BLOCK:
            yield None, None, None, [], [], "sizes differ or aren't whole sectors"
            return
        x = (np.frombuffer(a, np.uint8) != np.frombuffer(b, np.uint8)).reshape(-1, BLOCK)
        hit = np.flatnonzero(x.any(axis=1)).tolist()
        yield not hit, len(a) // BLOCK, int(x.sum()), hit, sorted({s // tracks.PER_TRACK for s in hit}), None

    given = pairs.select("path", F.col(left).alias("content"), F.col(right).alias("_right"))
    return per_image(given, one, "identical boolean, sectors_total bigint, bytes_differing bigint, sectors array<bigint>, tracks array<bigint>, refused string", ["_right"]).drop("_right")


def read_dataset(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Entries (source, name, size, crc, md5, sha1) of dataset files: elements rom with attributes; without crc none, without size 0. Column expressions only."""
    text = spark.read.format("text").option("wholetext", "true").option("pathGlobFilter", "*.dat").load(paths).select(F.input_file_name().alias("source"), "value")
    each = text.select("source", F.explode(F.regexp_extract_all("value", F.lit(r"<rom\s[^>]*>"), F.lit(0))).alias("e"))

    def attribute(name: str) -> Column:
        raw = F.regexp_extract("e", rf'\s{name}="([^"]*)"', 1)
        for entity, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            raw = F.replace(raw, F.lit(entity), F.lit(letter))
        return F.when(raw != "", raw)

    crc = F.conv(attribute("crc"), 16, 10).cast("bigint")
    out = each.select("source", attribute("name").alias("name"), F.coalesce(attribute("size").try_cast("bigint"), F.lit(0)).alias("size"), crc.alias("crc"), F.lower(attribute("md5")).alias("md5"), F.lower(attribute("sha1")).alias("sha1"))
    return out.where(F.col("crc").isNotNull() & F.col("name").isNotNull())


def dataset_folder(given: str | None = None) -> str:
    """Where datasets lie: as given, else DATFILES of the environment, else the user's data folder."""
    import os

    return given or os.environ.get("DATFILES") or os.path.join(os.environ.get("XDG_DATA_HOME") or os.path.expanduser("~/.local/share"), "palimpsest", "datfiles")


# Sinks


def unpack(images: DataFrame, root: str) -> DataFrame:
    """Writes every file below root/<image>/<partition>/<path> and gives outcomes: written, exists, unreadable. Names are made fit for any host; nothing is overwritten."""
    import os

    def one(content: bytes, label: str):
        for area, v in mounted(content):
            base = os.path.join(root, image.host_name(label), *([image.host_name(area.partition)] if area.partition else []))
            for path, e in v.walk().entries:
                target = os.path.join(base, *[image.host_name(p) for p in path.split("/")])
                if e.kind in DIRECTORIES:
                    os.makedirs(target, exist_ok=True)
                elif e.kind in FILES:
                    try:
                        data = v.read(e)
                    except Unreadable as x:
                        yield area.partition, path, None, "unreadable", x.fault.kind, 0
                        continue
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    try:
                        with open(target, "xb") as f:
                            f.write(data.data)
                        yield area.partition, path, target, "written", None, len(data.data)
                    except FileExistsError:
                        yield area.partition, path, target, "exists", None, 0

    given = images.select("path", "content", F.element_at(F.split("path", "/"), -1).alias("_label"))
    return per_image(given, one, "partition string, entry string, target string, outcome string, reason string, bytes bigint", ["_label"]).drop("_label")


def json_lines(rows: DataFrame, schema: str, version: int = 1) -> DataFrame:
    """Each row as one JSON document: the schema's name first, nulls kept, ASCII only."""
    doc = F.to_json(F.struct(F.lit(f"{schema}/{version}").alias("schema"), *[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"})
    letters = F.filter(F.split(doc, ""), lambda c: c != "")

    def escaped(c: Column) -> Column:
        code = F.ascii(c)
        unit = lambda x: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(x), 4, "0")))
        above = code - 65536
        return F.when(code < 128, c).when(code < 65536, unit(code)).otherwise(F.concat(unit(55296 + F.floor(above / 1024).cast("int")), unit(56320 + above % 1024)))

    plain = F.regexp_like(doc, F.lit(r"^[\x00-\x7F]*$"))
    return rows.select(F.when(plain, doc).otherwise(F.array_join(F.transform(letters, escaped), "")).alias("value"))




# What files say


def decode(found: DataFrame, name: str = "entry", data: str = "data") -> DataFrame:
    """Files (path, name, data) as kind, grouped fields and a picture; a file without a decoder, or too damaged for it, has why in refused."""
    from palimpsest.functions import media

    def one(content: bytes, label: str | None):
        try:
            d = media.decode(label or "", content)
        except media.Refused as e:
            yield media.kind_of(label or "", content), [], None, str(e)
            return
        picture = d.picture and {"width": d.picture[0], "height": d.picture[1], "rgb": d.picture[2]}
        yield d.kind, [{"group": g, "name": n, "value": v} for g, n, v in d.fields], picture, None

    given = found.select("path", F.col(data).alias("content"), F.col(name).alias("entry"))
    return per_image(given, one, "kind string, fields array<struct<group: string, name: string, value: string>>, picture struct<width: int, height: int, rgb: binary>, refused string", ["entry"])


def load_files(found: DataFrame, name: str = "entry", data: str = "data") -> DataFrame:
    """Hunks of load files: kind, size, relocations as (target, places), symbols."""
    from palimpsest.functions import media

    def one(content: bytes, label: str | None):
        table, fault = media.hunks(content)
        for i, h in enumerate(table):
            yield i, h.kind, h.size, h.data, [{"target": t, "places": p} for t, p in sorted(h.relocations.items())], [{"name": s, "at": a} for s, a in h.symbols], fault

    given = found.select("path", F.col(data).alias("content"), F.col(name).alias("entry"))
    return per_image(given, one, "hunk int, kind string, size bigint, data binary, relocations array<struct<target: bigint, places: array<bigint>>>, symbols array<struct<name: string, at: bigint>>, fault string", ["entry"])


def specs(images: DataFrame) -> DataFrame:
    """Facts about what an image needs, each with what tells it: media, storage, boot, volume, and libraries that its contents name."""
    import re

    library = re.compile(rb"(?<![A-Za-z0-9_.])([a-z0-9_]{3,30}\.(?:library|device|resource))")

    def one(content: bytes):
        x = Image.open(content)
        facts = [("media", f"{x.container}", f"by its {x.evidence}")]
        if x.geometry is not None:
            facts.append(("storage", f"{x.geometry.blocks * BLOCK} bytes", "by its geometry"))
        if x.device is not None:
            facts.append(("storage", f"a device with {len(x.partitions)} partitions", "by its device block"))
        boot = x.data[:1024]
        if boot[:3] == b"DOS":
            facts.append(("boot", "boots by itself" if int.from_bytes(boot[4:8], "big") == image.boot_sum(boot) else "does not boot", "by its boot block's checksum"))
        for a, v in mounted(content):
            kind = "a directory cache" if v.cached else "long names" if v.long_names else "international names" if v.international else "plain names"
            facts.append(("volume", f"the {'older' if v.older else 'newer'} file system with {kind}", f"by the flags of {a.partition or 'the volume'}"))
        for word in sorted({m.decode() for m in library.findall(x.data)}):
            facts.append(("libraries", word, "its name stands in the image"))
        yield from facts

    return per_image(images, one, "topic string, fact string, because string")


# More sinks


def extract(images: DataFrame, entry: str, partition: str | None = None) -> DataFrame:
    """One path's bytes of each image, or why not; faults as files() tells them."""

    def one(content: bytes):
        x = Image.open(content)
        area = x.area(partition) if partition is not None else next(x.areas(), None)
        v = area.mount() if area is not None else None
        if v is None:
            yield None, None, False, "no volume"
            return
        try:
            found, _ = v.lookup(entry)
            if found is None:
                raise Unreadable("not a directory", v.root, "the root")
            c = v.read(found)
            yield c.data, c.declared, c.short_by == 0, None
        except Unreadable as e:
            yield None, None, False, e.fault.kind

    return per_image(images, one, "data binary, declared_size bigint, complete boolean, refused string")


def written(path: str, data: bytes) -> str:
    """written, or exists where something has the name: the file appears whole or not at all, and nothing is overwritten."""
    import os
    import uuid

    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    own = f"{path}.{uuid.uuid4().hex}"
    try:
        with open(own, "xb") as f:
            f.write(data)
        os.link(own, path)  # fails where the name is taken
    except FileExistsError:
        return "exists"
    finally:
        if os.path.exists(own):
            os.unlink(own)
    return "written"


def write_bytes(rows: DataFrame, root: str, name: str = "path", data: str = "data") -> DataFrame:
    """Writes each row's bytes under root by its name, made fit for any host; outcome written or exists; rows without bytes are skipped."""
    import os

    def one(content: bytes, label: str, there: bool):
        if not there:
            yield None, "skipped", 0
            return
        target = os.path.join(root, *[image.host_name(p) for p in label.split("/") if p])
        yield target, written(target, content), len(content)

    given = rows.select(F.col(name).alias("path"), F.col(data).alias("content"), F.col(name).alias("_label"), F.col(data).isNotNull().alias("_there"))
    return per_image(given, one, "target string, outcome string, bytes bigint", ["_label", "_there"]).drop("_label", "_there")


def write_carved(images: DataFrame, root: str) -> DataFrame:
    """Writes what carving can recover, under root/<image>/<name made of block and name>."""
    found = carve(images).where("recoverable")
    label = F.element_at(F.split("path", "/"), -1)
    return write_bytes(found.select(F.concat_ws("/", label, "recovered_name").alias("path"), "data"), root)


def save_over(path: str, data: bytes, size: int, crc: int) -> str:
    """Replaces a file that is still as it was read (size and crc32), keeping it as .orig, .orig-1 and so on; returns the kept one's name."""
    import os
    import uuid

    with open(path, "rb") as f:
        now = f.read()
    if len(now) != size or zlib.crc32(now) != crc:
        raise ValueError("the file has changed since it was read")
    n, kept = 0, f"{path}.orig"
    while True:
        try:
            os.link(path, kept)
            break
        except FileExistsError:
            n += 1
            kept = f"{path}.orig-{n}"
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "xb") as f:
        f.write(data)
    os.replace(own, path)
    return kept
