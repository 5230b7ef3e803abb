"""The numbered queries: each maps the given tables to an operator's records and its result back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from .archive import read_archives, write_archives
from .chat import format_chats, read_chats
from .contamination import contained_windows
from .packing import pack_descriptions
from .sharding import shard_features
from .similar import similar_descriptions
from .toxicity import score_toxicity
from .token_files import read_token_files, write_token_files
from .personal import personal_spans
from .quality import quality_rules
from . import queries_ledgers  # noqa: F401
from .registry import ORACLE, QUERIES, features_of, query, table  # noqa: F401


@query("op8_packing")
def op8_packing(spark, d):
    pieces = pack_descriptions(features_of(table(spark, d, "documents")), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        F.col("feature_id").alias("doc_id"), "start", "length", F.crc32("token_ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset", "tier", "step_group",
    )


@query("op7_token_files")
def op7_token_files(spark, d):
    files = write_token_files(features_of(table(spark, d, "documents")), public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(files).select(
        F.col("feature_id").alias("doc_id"), "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32")
    )


_WORDS = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op1_decontamination", f"""
WITH b AS MATERIALIZED (SELECT item_id, {_WORDS.format(t="text")} AS w FROM benchmark),
bw AS MATERIALIZED (SELECT DISTINCT item_id, CASE WHEN len(w) < 13 THEN w ELSE w[s:s + 12] END AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(win) AS n FROM bw),
d AS MATERIALIZED (SELECT doc_id, coalesce({_WORDS.format(t="text")}, []) AS w FROM documents),
dw AS (SELECT doc_id, s, n, w[s:s + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
f AS MATERIALIZED (SELECT doc_id, s, n, item_id FROM dw JOIN bw USING (win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM f)) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM f) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, coalesce(i.items_sha256, sha256('')) AS items_sha256,
 coalesce(h.n_hit > 0 AND 20 * h.n_hit >= len(d.w), false) AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)""")
def op1_decontamination(spark, d):
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("description"))
    return contained_windows(features_of(table(spark, d, "documents")), items).select(
        F.col("feature_id").alias("doc_id"), "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


@query("op6_quality_rules")
def op6_quality_rules(spark, d):
    return quality_rules(features_of(table(spark, d, "documents"), "lang")).select(
        F.col("feature_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity"
    )


@query("op4_ngram_jaccard", """
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[s:s + 4] END AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS s FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
l AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id""")
def op4_ngram_jaccard(spark, d):
    return similar_descriptions(features_of(table(spark, d, "documents"))).withColumnRenamed("feature_id", "doc_id")


@query("op2_sharding")
def op2_sharding(spark, d):
    return shard_features(features_of(table(spark, d, "documents"))).select(
        F.col("feature_id").alias("doc_id"), "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op9_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
w AS (SELECT h, max(page_id) AS top FROM p GROUP BY h),
b AS (SELECT page_id, h, top, list_aggregate([lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0') FOR c IN string_split(sha1(h), '')], 'string_agg', '') AS bits FROM p JOIN w USING (h))
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
 list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_sum([CASE WHEN bits[5 * i + j] = '1' THEN 1 << (5 - j) ELSE 0 END FOR j IN [1, 2, 3, 4, 5]]) AS INT) + 1, 1) FOR i IN range(32)], 'string_agg', '') AS payload_digest,
 CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM b""")
def op9_warc(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("feature_id"), F.col("url").alias("uri"), F.col("html").alias("document"))
    return read_archives(write_archives(pages)).select(
        F.col("feature_id").alias("page_id"), F.col("full_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )


_TURN_HASH = "sha256(coalesce(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text), ''))"


@query("op3_chat_format", f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(replace(text, chr(92), repeat(chr(92), 2)), '<s>|</s>|\\[INST\\]|\\[/INST\\]', '-\\0', 'g') AS t, regexp_replace(replace(role, chr(92), repeat(chr(92), 2)), '<s>|</s>|\\[INST\\]|\\[/INST\\]', '-\\0', 'g') AS r FROM c)
SELECT conv_id, count(*) AS n_turns, {_TURN_HASH} AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(length(t) + length(r) + 20) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id""")
def op3_chat_format(spark, d):
    own = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    turns = F.transform(F.sort_array(F.collect_list(turn)), lambda x: F.struct(x.role.alias("role"), x.content.alias("content")))
    records = rows.groupBy("conv_id").agg(turns.alias("messages")).select(F.col("conv_id").alias("chat_id"), F.to_json(F.struct("messages")).alias("record"))
    said = F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n")))
    return read_chats(format_chats(records)).select(
        F.col("chat_id").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


@query("op5_toxicity")
def op5_toxicity(spark, d):
    held_out = lambda c: F.crc32(F.col(c).cast("string")) % 5 == 0
    labels = table(spark, d, "labels").where(~held_out("doc_id")).select(F.col("doc_id").alias("feature_id"), "toxic")
    scored = score_toxicity(features_of(table(spark, d, "documents")), labels)
    return scored.select(
        F.col("feature_id").alias("doc_id"), held_out("feature_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.stop.cast("string"))), ",")


@query("op10_pii")
def op10_pii(spark, d):
    found = personal_spans(features_of(table(spark, d, "documents")))
    n = [F.size(F.filter("base", lambda s: s.kind == k)).cast("bigint").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]  # noqa: B023
    return found.select(F.col("feature_id").alias("doc_id"), *n, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
