"""Queries over disk images made of the driver's documents, and the same results told by SQL from the documents alone.

Forty documents to a volume: the images are built, changed or damaged by the library's own operators and read back by others,
and the SQL says what must come out of that without any image.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import images as I
from palimpsest.operators import relational as R
from palimpsest.plans.registry import T, query

#: Bytes of a data block's payload in the older file system, and bits of a bitmap page.
PAYLOAD, PAGE_BITS = 488, 4064

#: Documents with what their files need: blocks of data, list blocks; and the volumes' sizes as volumes_of() chooses them.
FACTS = f"""
with f as (select doc_id, 'vol-' || (doc_id // 40) as path, 'd' || doc_id as entry, octet_length(encode(coalesce(text, ''))) as size, coalesce(text, '') as text from documents),
b as (select *, (size + {PAYLOAD - 1}) // {PAYLOAD} as n, greatest((((size + {PAYLOAD - 1}) // {PAYLOAD}) + 71) // 72 - 1, 0) as lists from f),
v as (select path, count(*) as files, cast(sum(size) as bigint) as bytes, cast(sum(1 + n + lists) as bigint) as blocks,
    greatest(1760, cast(sum(2 + n * 73 // 72) as bigint) * 9 // 8 + 64) as total from b group by path)"""


def volumes(spark, sf, flags: int = 0) -> I.Made:
    """Volumes that hold the documents as files d<doc_id>."""
    docs = T(spark, sf, "documents").select(F.concat(F.lit("vol-"), F.floor(F.col("doc_id") / 40).cast("string")).alias("path"), F.concat(F.lit("d"), "doc_id").alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    return I.made_volumes(docs, "path", "name", "data", flags)


@query(f"{FACTS} select path, entry, 'file' as kind, size, sha1(text) as sha1, '----rwed' as protection, true as checksum_valid, false as hit_limit from b")
def volume_walk(spark, sf):
    """Every entry of every volume's tree, with its content's hash."""
    return I.walk(volumes(spark, sf), hashes=True).select("path", "entry", "kind", "size", "sha1", "protection", "checksum_valid", "hit_limit")


@query(f"{FACTS} select path, entry, size, sha1(text) as sha1, 0 as faults from b")
def volume_files(spark, sf):
    """Files read back from volumes of the newer file system with international names."""
    return I.files(volumes(spark, sf, 3)).select("path", "entry", F.col("declared_size").alias("size"), F.sha1("data").alias("sha1"), F.size("faults").alias("faults")).where("sha1 is not null")


@query(f"{FACTS} select path, 'files' as kind, files, 0 as directories, bytes as bytes_recovered, 0 as orphaned, 0 as at_risk, cast(null as varchar) as worst, true as sound from v")
def volume_check(spark, sf):
    """The health of freshly made volumes: nothing to find."""
    c = I.check(volumes(spark, sf))
    return c.select("path", "kind", "files", "directories", "bytes_recovered", F.col("bitmap.orphaned").alias("orphaned"), F.col("bitmap.at_risk").alias("at_risk"), "worst", "sound")


@query(f"""{FACTS} select path, 'file' as region, blocks from v union all select path, 'bootblock', 2 from v union all select path, 'rootblock', 1 from v""")
def volume_layout(spark, sf):
    """What blocks are for, summed over the spans that tile each image."""
    return I.layout_totals(I.layout(volumes(spark, sf))).where("region not in ('unclaimed', 'bitmap')")


def _without_long(spark, sf, judged: bool, least: int = 2000) -> I.Made:
    """The volumes after the files of at least so many bytes were deleted."""
    name, none = F.concat(F.lit("d"), "doc_id"), F.lit(None)
    op = F.struct(F.lit("rm").alias("op"), name.alias("path"), none.cast("string").alias("other"), none.cast("binary").alias("data"))
    docs = T(spark, sf, "documents").select(
        F.concat(F.lit("vol-"), F.floor(F.col("doc_id") / 40).cast("string")).alias("path"), name.alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("data"),
        F.when(F.octet_length("text") >= least, op).alias("changes"),
    )
    return I.apply_changes(I.made_volumes(docs, "path", "name", "data", gathered="changes"), judged=judged)


@query(f"{FACTS} select path, entry as name, size, 'self-evident' as evidence, n as data_blocks, sha1(text) as sha1 from b where size >= 2000")
def carve_deleted(spark, sf):
    """Deleted files found again by headers that nothing claims, and their bytes from blocks that name them as their owner."""
    found = I.carve(_without_long(spark, sf, False))
    return found.where("recoverable").select("path", "name", "size", "evidence", "data_blocks", F.sha1("data").alias("sha1"))


@query(f"{FACTS} select path, count(*) filter (size < 2000) as files, count(*) filter (size >= 2000) as made, cast(null as varchar) as refused, cast(sum(size) filter (size < 2000) as bigint) as bytes from b group by path")
def delete_files(spark, sf):
    """Changes of images, judged by the health rules, and what is left."""
    left = I.file_totals(_without_long(spark, sf, True), ["made", "refused"])
    return left.select("path", "files", F.col("made").cast("bigint").alias("made"), "refused", "bytes")


@query(f"{FACTS} select path, code, 'warning' as severity, count(*) as n from (select path, unnest(['data-block-structure', 'orphaned-blocks']) as code from v where blocks > files and files > 0) group by all")
def health_findings(spark, sf):
    """Volumes with a damaged block: the first data block of each is zeroed, and a free block is marked as used."""
    return _damaged(spark, sf).groupBy("path", "code", "severity").agg(F.count("*").alias("n")).where("code in ('data-block-structure', 'orphaned-blocks')")


def _damaged(spark, sf) -> DataFrame:
    def hurt(content: bytes):
        from palimpsest.functions import edit
        from palimpsest.functions.volume import Volume

        v = Volume(content)
        first = next(((e, b) for _, e in v.walk().entries for b, data in v.file_table(e) if data), None)
        out = bytearray(content)
        if first is not None:
            out[first[1] * 512 : first[1] * 512 + 512] = bytes(512)
            plan = edit.Plan(Volume(bytes(out)))
            plan.take(1)
            plan.write_bitmap()
            for b, raw in plan.blocks().items():
                out[b * 512 : b * 512 + 512] = raw
        yield (bytes(out),)

    return I.findings(volumes(spark, sf).then(hurt))


def _floppies(spark, sf) -> I.Made:
    return volumes(spark, sf).then(lambda content: [(content,)] if len(content) == 901120 else [])


@query(f"{FACTS} select path, entry, size, sha1(text) as sha1 from b where path in (select path from v where total = 1760)")
def track_round_trip(spark, sf):
    """Floppies as raw tracks and back: each sector is encoded, found by its sync words and decoded; then the files are read."""
    return I.files(I.convert(_floppies(spark, sf), "extended-adf")).select("path", "entry", F.col("declared_size").alias("size"), F.sha1("data").alias("sha1"))


@query(f"""{FACTS} select path as title, 3 as sources, true as can_vote, cast(null as varchar) as refused, 1760 - 3 as unanimous, 2 as resolved_sectors, 1 as unresolved_sectors from v where total = 1760""")
def consolidate_dumps(spark, sf):
    """Three dumps of each floppy: two have a sector of their own wrong, and in one sector all three differ."""
    wrong = lambda c, sector, letter: F.overlay(c, F.repeat(F.lit(letter), 512).cast("binary"), F.lit(sector * 512 + 1), F.lit(512))
    c = F.col("content")
    dumps = F.array(*[F.struct(F.lit(name).alias("path"), content.alias("content")) for name, content in (("a", c), ("b", wrong(wrong(c, 1500, "x"), 1700, "x")), ("c", wrong(wrong(c, 1600, "y"), 1700, "y")))])
    each = _floppies(spark, sf).frame().select(F.col("path").alias("title"), F.inline(dumps))
    return I.consolidate(each).select("title", "sources", "can_vote", "refused", "unanimous", "resolved_sectors", "unresolved_sectors")


@query(f"""{FACTS}, r as (select path, 1 as mounted, 0 as unreadable, bytes from v union all select 'none', 0, 1, 0)
select count(*) as examined, cast(sum(unreadable) as bigint) as unreadable, cast(sum(mounted) as bigint) as mounted, cast(sum(mounted) as bigint) as sound, cast(0 as bigint) as at_risk, cast(sum(bytes) as bigint) as bytes_recovered from r""")
def batch_records(spark, sf):
    """A corpus in one row: examined, mounted, sound, bytes recovered; an unreadable image counts, too."""
    none = spark.createDataFrame([("none", None)], "path string, content binary")
    return I.batch_summary(I.batch(volumes(spark, sf)).unionByName(I.batch(none)))


#: Magics that documents have: at the beginning of a block, or anywhere.
TABLE = [("article", "word", b"the", True), ("long article", "word", b"there", True), ("blank", "mark", b" ", True), ("key", "secret", b"AKIA", False)]


@query("""
with h as (select doc_id, hex(encode(text)) as x from documents where text is not null),
s(name, magic, aligned) as (values ('article', hex(encode('the')), true), ('long article', hex(encode('there')), true), ('blank', '20', true), ('key', hex(encode('AKIA')), false)),
k as (select doc_id, x, unnest(range(0, length(x) // 1024 + 1)) as k from h),
a as (select doc_id, name, k * 512 as pos, length(magic) as n from k, s where aligned and substr(x, 1 + k * 1024, length(magic)) = magic
    union all select doc_id, name, pos, length(magic) from (select doc_id, x, name, magic, unnest(range(0, length(x) // 2)) as pos from h, s where not aligned and contains(x, magic)) where substr(x, 1 + 2 * pos, length(magic)) = magic),
m as (select doc_id, pos, arg_min(name, (-n, name)) as name from a group by all),
o as (select *, case when name = lag(name) over w and pos % 512 = 0 and lag(pos) over w = pos - 512 then 0 else 1 end as fresh from m window w as (partition by doc_id order by pos)),
r as (select *, sum(fresh) over (partition by doc_id order by pos rows unbounded preceding) as run from o)
select doc_id, name, min(pos) as "offset", min(pos) // 512 as block, count(*) as blocks from r group by doc_id, run, name""")
def scan_blocks(spark, sf):
    """Magics over whole contents: at every block's beginning or anywhere, the longest at a place, neighbouring blocks in one hit."""
    docs = T(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    return I.scan(docs, TABLE).select(F.col("path").alias("doc_id"), "name", "offset", "block", "blocks")


@query("""select doc_id, octet_length(encode(substr(text, 1, i - 1))) as "offset", octet_length(encode(substr(text, 1, i - 1))) // 512 as block, 'unclaimed' as region
from (select doc_id, text, unnest(range(1, length(text) - 4)) as i from documents where contains(lower(text), 'token')) where lower(substr(text, i, 5)) = 'token'""")
def find_any_case(spark, sf):
    """A text pattern, whatever its case, in whole contents, with the region that owns each occurrence."""
    docs = T(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    return I.find(docs, "token", ignore_case=True).select(F.col("path").alias("doc_id"), "offset", "block", "region")


@query("""with t(low, high, band) as (values (0, 200, 'short'), (100, 1000, 'medium'), (500, 5000, 'long'), (4000, 1000000, 'very long'))
select doc_id, band from documents left join t on n_chars >= low and n_chars < high""")
def overlapping_ranges(spark, sf):
    """Each document with every range of lengths that it lies in."""
    bands = spark.createDataFrame([(0, 200, "short"), (100, 1000, "medium"), (500, 5000, "long"), (4000, 1000000, "very long")], "low bigint, high bigint, band string")
    return R.in_ranges(T(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", bands, "low", "high", "band").select("doc_id", "band")


@query(f"{FACTS} select 'list/1' as schema, cast(count(*) as bigint) as docs from b")
def list_json(spark, sf):
    """Entries as JSON documents, ASCII only, the schema first."""
    lines = I.json_lines(I.walk(volumes(spark, sf)), "list")
    ascii_only = lines.where(F.regexp_like("value", F.lit(r'^\{"schema":"list/1",[\x20-\x7E]*\}$')))
    return ascii_only.groupBy(F.get_json_object("value", "$.schema").alias("schema")).agg(F.count("*").alias("docs"))


@query("select doc_id, octet_length(encode(text)) // 2 * 2 as bytes from documents where octet_length(encode(text)) >= 2")
def code_tiles(spark, sf):
    """Any bytes as code: instructions and words of data tile them, none before the last one's end and none beyond."""
    from palimpsest.operators import code

    docs = T(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("path"), F.lit("d").alias("entry"), F.col("text").cast("binary").alias("data"))
    lines = code.tiles(docs)
    whole = lines.groupBy(F.col("path").alias("doc_id")).agg(F.sum("size").alias("bytes"), F.max(F.col("at") + F.col("size")).alias("end"))
    return whole.where("end = bytes").select("doc_id", "bytes")


@query("select doc_id, 'text form' as kind, octet_length(encode(text)) as characters, cast(null as varchar) as refused from documents where text is not null")
def decode_forms(spark, sf):
    """Documents as formatted-text files, decoded."""
    long = lambda n: F.unhex(F.lpad(F.hex(n), 8, "0"))
    body = F.col("text").cast("binary")
    n = F.octet_length(body)
    pad = F.when(n % 2 == 1, F.unhex(F.lit("00"))).otherwise(F.lit(b""))
    form = F.concat(F.lit(b"FORM"), long(n + n % 2 + 12), F.lit(b"FTXTCHRS"), long(n), body, pad)
    docs = T(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("path"), F.lit("x").alias("entry"), form.alias("data"))
    told = F.filter("fields", lambda f: f["name"] == "characters")[0]["value"].cast("bigint")
    return I.decode(docs).select(F.col("path").alias("doc_id"), "kind", told.alias("characters"), "refused")
