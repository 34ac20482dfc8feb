"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import automaton, idstore, linededup, repetition, secret_scan, simhash, toollinks, toxicity, wumanber, zipwarc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = automaton.bpe_round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return made.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = idstore.write_store(docs, idstore.new_root(spark), vocabulary("byte_bpe_50k.json"))
    return idstore.lookup(docs, store).select("doc_id", "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = repetition.quality(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "repeat_words", "longest")


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.SubsequenceModel:
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return toxicity.train(table(spark, sf_dir, "documents"), labels)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return made.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = linededup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), removed="n_removed")
    return made.select("doc_id", "n_removed", F.length("text").cast("bigint").alias("chars_left"), F.sha2("text", 256).alias("text_sha256"))


#: The schemas of the two calls that conversations hold.
CHAT_SCHEMAS = [
    ("reply", '{"required":["prompt","turn"],"properties":{"prompt":{"type":"string"},"turn":{"type":"integer"}},"additionalProperties":false}'),
    ("instruct", '{"required":["prompt"],"properties":{"prompt":{"type":"string"}},"additionalProperties":false}'),
]


def op6_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = toollinks.chat_calls(table(spark, sf_dir, "conversations"))
    schemas = spark.createDataFrame(CHAT_SCHEMAS, "name string, schema string")
    made = toollinks.link(calls, results, schemas)
    return made.select("conversation", "place", "turn", "kind", "call_id", "status", F.concat_ws(",", "problems").alias("problems"), F.md5("json").alias("json_md5"))


OP6_SQL = """
with m as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations),
calls as (select *, case when role = 'system' then 'instruct' else 'reply' end as name, case when role = 'system' then 's' else 'c' end || conv_id || '-' || turn as own
    from m where role <> 'assistant'),
results as (select *, 'c' || conv_id || '-' || (turn - 1) as before from m where role = 'assistant'),
answered as (select conv_id, before as id, count(*) as n, max(turn) as turn from results group by all),
asked as (select conv_id, own as id, count(*) as n, min(name) as name, max(turn) as turn from calls group by all),
final as (select conv_id, max(turn) as turn from calls where name = 'reply' group by conv_id),
-- Instructions that stand before the last reply's answer come a level later; every other call finds what it depends on on earlier turns.
levels as (select distinct c.conv_id, c.own as id, 1 as level from calls c join final f on f.conv_id = c.conv_id
    left join answered a on a.conv_id = f.conv_id and a.id = 'c' || f.conv_id || '-' || f.turn
    where c.name = 'instruct' and c.own is not null and f.turn is not null and not coalesce(greatest(f.turn, coalesce(a.turn, f.turn)) < c.turn, false))
select c.conv_id as conversation, coalesce(l.level, 0) * 4294967296 + coalesce(c.turn, 0) * 2 as place, c.turn, 'call' as kind, c.own as call_id,
    case when a.n is null then 'unanswered' when a.n > 1 then 'repeated' else 'linked' end as status,
    case when c.name = 'instruct' then 'unknown turn' else '' end as problems,
    md5('{"arguments":{"prompt":' || to_json(c.text) || ',"turn":' || c.turn || '},"id":' || to_json(c.own) || ',"name":"' || c.name || '"}') as json_md5
from calls c left join answered a on a.conv_id = c.conv_id and a.id = c.own left join levels l on l.conv_id = c.conv_id and l.id = c.own
union all
select r.conv_id, coalesce(l.level, 0) * 4294967296 + greatest(coalesce(r.turn, 0), coalesce(a.turn, r.turn, 0)) * 2 + 1, r.turn, 'result', r.before,
    case when a.n is null then 'orphan' when a.n > 1 then 'repeated' else 'linked' end, '',
    md5('{"content":' || to_json(r.text) || ',"id":' || to_json(r.before) || case when a.name is null then '' else ',"name":"' || a.name || '"' end || '}')
from results r left join asked a on a.conv_id = r.conv_id and a.id = r.before left join levels l on l.conv_id = r.conv_id and l.id = r.before
"""


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return made.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = wumanber.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n = F.size("items").cast("bigint")
    return made.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


def op9_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = zipwarc.new_root(spark)
    packages = zipwarc.write_packages(table(spark, sf_dir, "pages"), root)
    return zipwarc.read_packages(packages, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    made = secret_scan.find_secrets(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    spans = F.arrays_zip("kinds", "starts", "ends")
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("bigint")
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kinds"], x["starts"].cast("string"), x["ends"].cast("string"))), ",")
    return made.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(text(F.filter(spans, lambda x: x["kinds"] != "token")), 256).alias("base_sha256"), text(spans).alias("spans"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_bpe_automaton, op2_id_store, op3_quality_rules, op4_toxicity, op5_line_dedup, op6_tool_links, op7_simhash, op8_decontamination, op9_zip_warc, op10_secrets,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op6_tool_links": OP6_SQL}
