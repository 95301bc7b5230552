"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, decontaminate, hard_negatives, media, mixing, near_join, packing, secrets, top_k, toxicity, training_order, urls, warc
from .common import table


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_table(table(spark, sf_dir, "documents"), ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).drop("score")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select("doc_id", *(of(k) for k in secrets.BASE), F.sha2(secrets.digest(base), 256).alias("base_sha256"), secrets.digest(F.col("spans")).alias("spans"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.link_components(table(spark, sf_dir, "documents"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_bundles(warc.write_bundles(table(spark, sf_dir, "pages")))


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.materialise(table(spark, sf_dir, "documents")).withColumn("record_crc32", F.crc32("record")).drop("record")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).drop("ids")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_media, op2_ngram_join, op3_toxicity, op4_training_order, op5_warc, op6_url_filter, op7_secrets, op8_top_k, op9_packing, op10_mixing, op11_hard_negatives, op12_decontamination, op13_alignment)}


def _secrets_sql() -> str:
    """Matches of each rule and the pieces between them give the places of the spans."""
    found = []
    for k, rule in enumerate(secrets.RULES):
        pattern = rule.pattern.replace("'", "''")
        found.append(f"SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, {rule.least} AS least, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS g, string_split_regex(t, '{pattern}') AS p FROM d")
    base = ", ".join(f"'{b}'" for b in secrets.BASE)
    text = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({' UNION ALL '.join(found)}),
u AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f),
w AS (SELECT doc_id, k, kind, CAST(list_sum(list_transform(p[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS BIGINT) AS s, len(m[i]) AS n FROM u WHERE len(g[i]) >= least),
x AS (SELECT doc_id, k, kind, s, s + n AS e FROM w),
a AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{b}') AS n_{b}" for b in secrets.BASE)}, {text[:-1]}) FILTER (kind IN ({base})) AS b, {text} AS spans FROM x GROUP BY doc_id)
SELECT doc_id, {', '.join(f'CAST(coalesce(n_{b}, 0) AS BIGINT) AS n_{b}' for b in secrets.BASE)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""


ORACLES: dict[str, str] = {
    "op7_secrets": _secrets_sql(),
    "op2_ngram_join": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS n, b.n AS m, count(*) AS k FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p WHERE 100 * k >= 75 * (n + m - k)), b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, b.y FROM r JOIN b ON r.c = b.x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id FROM s JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) ON id = doc_id""",
    "op5_warc": r"""WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, CAST(CAST(unhex(sha1(coalesce(html, ''))) AS BIT) AS VARCHAR) AS b FROM pages),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(b, i * 5 + 1, 1) AS INTEGER) + 8 * CAST(substr(b, i * 5 + 2, 1) AS INTEGER) + 4 * CAST(substr(b, i * 5 + 3, 1) AS INTEGER) + 2 * CAST(substr(b, i * 5 + 4, 1) AS INTEGER) + CAST(substr(b, i * 5 + 5, 1) AS INTEGER), 1)), '') AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f""",
    "op8_top_k": """WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS w FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row AS query, q.vec_id AS query_id, c.row, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.row <> c.row)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id, row) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 20""",
    "op11_hard_negatives": """WITH v AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.row AS anchor, a.vec_id AS anchor_id, c.row, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.w, c.w) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.row <> c.row),
p AS (SELECT anchor, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, row) AS slot, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY slot <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor, slot ORDER BY score DESC, vec_id, row) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM s JOIN p USING (anchor) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10""",
    "op12_decontamination": r"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT row, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT row, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
o AS (SELECT row, i, k, item FROM g JOIN win USING (k, s)),
h AS (SELECT row, count(DISTINCT j) AS n FROM (SELECT row, unnest(range(i, i + k)) AS j FROM o) GROUP BY row),
t AS (SELECT row, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM o) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (row) LEFT JOIN t USING (row)""",
}
