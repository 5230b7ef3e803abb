"""The numbered queries over blobs, manifests and codes, and their DuckDB checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .blob_ledger import ASSIGN, BASE_RULES, RULES, scan_files
from .common import scratch_folder
from .manifest import feature_manifest, fold_proof, record_digest
from .profile_codes import compress_profiles
from .registry import query, table


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _found_sql(no: int) -> str:
    """Matches of a rule with their places: lengths of the pieces and matches before them, summed."""
    rule, p = RULES[no], _quoted(RULES[no].pattern)
    kept = f"length(regexp_replace(v, {_quoted('^' + ASSIGN)}, '')) >= 8" if rule.keep else "true"
    return f"""
 SELECT doc_id, {no} AS k, '{rule.name}' AS kind, CAST(a AS BIGINT) AS a, CAST(a + length(v) AS BIGINT) AS b FROM (
  SELECT doc_id, f[i] AS v, list_sum([length(x) FOR x IN g[1:i]]) + coalesce(list_sum([length(x) FOR x IN f[1:i - 1]]), 0) AS a FROM (
   SELECT *, unnest(range(1, len(f) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, {p}) AS f, string_split_regex(t, {p}) AS g FROM d WHERE regexp_matches(t, {p})))) WHERE {kept}"""


@query("op11_secret_ledger", f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS MATERIALIZED ({" UNION ALL ".join(_found_sql(i) for i in range(len(RULES)))}),
a AS (SELECT doc_id, {", ".join(f"count(*) FILTER (k = {i}) AS n_{r.name}" for i, r in enumerate(BASE_RULES))},
 string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (k < {len(BASE_RULES)}) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)""")
def op11_secret_ledger(spark, d):
    files = table(spark, d, "documents").select("doc_id", F.col("text").alias("value"))
    found = scan_files(files, scratch_folder(spark, "blob-ledger"))
    base = F.filter("findings", lambda s: s["rule"].isin([r.name for r in BASE_RULES]))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    n = [F.size(F.filter("findings", lambda s: s["rule"] == r.name)).cast("bigint").alias(f"n_{r.name}") for r in BASE_RULES]  # noqa: B023
    return found.select("doc_id", *n, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"))


_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _leaf_sql(**changed: str) -> str:
    one = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
    return "sha256(" + " || ".join(one(changed.get(c, c)) for c in _FIELDS) + ")"


@query("op12_merkle_manifest", f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf_sql()} AS leaf, {_leaf_sql(n_chars="(n_chars + CASE WHEN c % 7 = 0 THEN 1 ELSE 0 END)")} AS claimed
 FROM (SELECT *, xor(list_reduce([4294967295::BIGINT] || [ord(x)::BIGINT FOR x IN string_split(CAST(doc_id AS VARCHAR), '')],
  lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) AS c FROM documents)),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY tree) AS n FROM d),
t AS MATERIALIZED (SELECT tree, 0 AS lvl, r AS i, n, leaf AS h FROM l
 UNION ALL SELECT tree, any_value(lvl) + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY tree, i // 2),
sub AS MATERIALIZED (SELECT tree, h AS subroot, lvl AS levels, row_number() OVER (ORDER BY tree) - 1 AS r, count(*) OVER () AS n FROM t WHERE n = 1),
u AS MATERIALIZED (SELECT 0 AS lvl, r AS i, n, subroot AS h FROM sub
 UNION ALL SELECT any_value(lvl) + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY i // 2),
root AS (SELECT h AS root, lvl AS levels FROM u WHERE n = 1),
s1 AS (SELECT x.tree, x.r, x.lvl AS step, (x.r >> x.lvl) % 2 AS odd, t.h FROM (SELECT l.tree, l.r, unnest(range(0, sub.levels)) AS lvl FROM l JOIN sub ON sub.tree = l.tree) x LEFT JOIN t ON t.tree = x.tree AND t.lvl = x.lvl AND t.i = xor(x.r >> x.lvl, 1)),
s2 AS (SELECT l.tree, l.r, levels + y.lvl AS step, y.odd, y.h FROM l JOIN (SELECT x.tree, x.levels, x.lvl, (x.r >> x.lvl) % 2 AS odd, u.h FROM (SELECT sub.tree, sub.levels, sub.r, unnest(range(0, root.levels)) AS lvl FROM sub, root) x LEFT JOIN u ON u.lvl = x.lvl AND u.i = xor(x.r >> x.lvl, 1)) y ON y.tree = l.tree),
s AS MATERIALIZED (SELECT * FROM s1 UNION ALL SELECT * FROM s2),
f AS (SELECT tree, r, 0 AS step, claimed AS h FROM l
 UNION ALL SELECT f.tree, f.r, f.step + 1, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN s.odd = 1 THEN s.h || f.h ELSE f.h || s.h END) FROM f JOIN s ON s.tree = f.tree AND s.r = f.r AND s.step = f.step),
p AS (SELECT tree, r, sha256(coalesce(string_agg(h, '' ORDER BY step), '')) AS proof_sha256 FROM s GROUP BY tree, r),
e AS (SELECT tree, r, arg_max(h, step) AS folded_root FROM f GROUP BY tree, r)
SELECT l.doc_id, l.leaf, sub.subroot, root.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = root.root AS verified
FROM l JOIN sub ON sub.tree = l.tree JOIN e ON e.tree = l.tree AND e.r = l.r LEFT JOIN p ON p.tree = l.tree AND p.r = l.r, root""")
def op12_merkle_manifest(spark, d):
    docs = table(spark, d, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    altered = record_digest(*[F.col("n_chars") + 1 if c == "n_chars" else c for c in _FIELDS])
    records = docs.select(F.col("doc_id").alias("feature_id"), F.col("lang").alias("layer"), record_digest(*_FIELDS).alias("digest"), F.when(tampered, altered).alias("claimed"))
    folded = fold_proof(F.coalesce("claimed", "leaf"), F.col("proof"))
    rows = feature_manifest(records).select(
        F.col("feature_id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.array_join(F.col("proof.sibling"), ""), 256).alias("proof_sha256"), folded.alias("folded_root")
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _codes_sql(rounds: int = 4, entries: int = 256) -> str:
    near = """a{n} AS MATERIALIZED (SELECT vec_id, label, k, any_value(p.x) AS x, CAST(min((list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x)) * 256 + j) AS BIGINT) AS m
 FROM p JOIN b{n} b USING (k) GROUP BY vec_id, label, k)"""
    move = """b{n} AS MATERIALIZED (SELECT o.k, o.j, coalesce(w.x, o.x) AS x FROM b{o} o LEFT JOIN (SELECT k, j, list(floor(s / c) ORDER BY pos) AS x FROM
 (SELECT k, m % 256 AS j, pos, sum(x[pos]) AS s, count(*) AS c FROM (SELECT k, m, x, unnest(range(1, len(x) + 1)) AS pos FROM a{o}) GROUP BY ALL) GROUP BY k, j) w USING (k, j))"""
    steps = [near.format(n=0)]
    for n in range(1, rounds + 1):
        steps += [move.format(n=n, o=n - 1), near.format(n=n)]
    last = rounds
    return f"""
WITH v AS (SELECT vec_id, label, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, k, e[k * (len(e) // 4) + 1:(k + 1) * (len(e) // 4)] AS x FROM (SELECT *, unnest(range(0, 4)) AS k FROM v)),
b0 AS MATERIALIZED (SELECT k, j, x FROM (SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS j FROM p) WHERE j < {entries}),
{", ".join(steps)},
c AS MATERIALIZED (SELECT vec_id, label, string_agg(printf('%02x', m % 256), '' ORDER BY k) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM a{last} GROUP BY vec_id, label),
h AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY k, j, pos)) AS codebooks_sha256 FROM (SELECT k, j, unnest(range(1, len(x) + 1)) AS pos, x[pos] AS y FROM b{last}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, h"""


@query("op13_vector_codes", _codes_sql())
def op13_vector_codes(spark, d):
    profiles = table(spark, d, "embeddings").select(F.col("vec_id").alias("link_id"), F.col("embedding").alias("heights"), F.col("label").alias("site_id"))
    return compress_profiles(profiles).select(F.col("link_id").alias("vec_id"), "code", "error", F.col("site_error").alias("label_error"), "codebooks_sha256")
