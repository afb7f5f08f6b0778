"""Registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chat, decontam, hardneg, langid, neardup, packing, pii, quality, repeats, tokencount, urlfilter, warc
from .common import Store, read


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    model = langid.train(docs.filter("not held_out and doc_id is not null"))
    return langid.identify(docs.drop("lang"), model).select(
        "doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), words=3, num=85, den=100)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.digest(decontam.decontaminate(docs, read(spark, sf_dir, "benchmark")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more whose texts look like another template's control strings."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], turns.schema)
    store = Store(spark, "chat-windows")
    return chat.digest(store.write(chat.format_conversations(turns.unionByName(tricky)), "windows"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.digest(quality.quality_cascade(docs, report=quality.REPORT))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.token_counts(docs).select("doc_id", "n_tokens")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, "warc")
    warc.write_archives(read(spark, sf_dir, "pages"), store.path("archives"), store)
    return warc.digest(warc.read_archives(spark, store.path("archives"), glob="part-*", payloads=False))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(read(spark, sf_dir, "documents").select("doc_id", "text"))[0]


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.find_repeats(docs, keep="none").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the vectors whose id is divisible by 100; where it is divisible by 7, the label moves on by one."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_language": op1_language,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_url_filter": op3_url_filter,
    "op4_decontam": op4_decontam,
    "op5_packing": op5_packing,
    "op6_pii": op6_pii,
    "op7_chat": op7_chat,
    "op8_quality": op8_quality,
    "op9_token_counts": op9_token_counts,
    "op10_warc": op10_warc,
    "op11_alignment": op11_alignment,
    "op12_repeats": op12_repeats,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE = {}

ORACLE["op4_decontam"] = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bwin AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS win
         FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM bw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bwin),
dwin AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS win
         FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM dw, ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, s, d.k, item_id FROM dwin d JOIN bwin b ON d.k = b.k AND d.win = b.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS h
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(h, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

ORACLE["op8_quality"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
           FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 7], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS s FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, g FROM win GROUP BY 1, 2 HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + 8)) AS p FROM win SEMI JOIN twice USING (doc_id, g)) GROUP BY 1),
f AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
             len(list_filter(w, lambda x: length(x) > 100)) AS n_long
      FROM d LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 5 * word_chars
            OR 100 * n_dup_lines > 50 * n_lines OR 100 * n_long > 20 * n_words) AS kept
FROM f
"""

ORACLE["op2_near_duplicates"] = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, hash(array_to_string(w[s:s + least(3, len(w)) - 1], ' ')) AS g
       FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS s FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
e AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2)
      JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, e2.b FROM reach JOIN e2 ON reach.r = e2.a),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM comp LEFT JOIN n USING (doc_id)
"""

ORACLE["op10_warc"] = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CAST(CASE WHEN original <> page_id THEN original END AS DOUBLE) AS refers_to
FROM p LEFT JOIN o USING (payload_digest)
"""

ORACLE["op3_url_filter"] = r"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, regexp_replace(host || path, '[0-9]', '0', 'g') AS form, CASE
        WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM u),
v AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM r),
f AS (SELECT form, count(*) FILTER (ruled = 'allow') AS wa, count(*) FILTER (ruled = 'block') AS wb, count(*) FILTER (ruled IS NULL) AS wo,
             substr(md5(form), 1, 1) IN ('0', '1', '2') AS cal FROM v GROUP BY form),
g AS (SELECT form, wa, wb, wo, cal, substr(chr(1) || chr(1) || chr(1) || form || chr(2), CAST(i AS BIGINT), 4) AS gram
      FROM (SELECT *, unnest(range(1, length(form) + 2)) AS i FROM f)),
c4 AS (SELECT gram, sum(wa) AS a, sum(wb) AS b FROM g WHERE NOT cal AND wa + wb > 0 GROUP BY 1),
c AS (SELECT x, sum(a) AS a, sum(b) AS b FROM (SELECT unnest([right(gram, 1), right(gram, 2), right(gram, 3), gram]) AS x, a, b FROM c4) GROUP BY 1),
k AS (SELECT left(x, length(x) - 1) AS ctx, sum(a) AS na, sum(b) AS nb, count(*) FILTER (a > 0) AS ta, count(*) FILTER (b > 0) AS tb FROM c GROUP BY 1),
need AS (SELECT DISTINCT gram FROM g WHERE wo > 0 OR cal),
l AS (SELECT gram, j, CAST(coalesce(a, 0) AS DOUBLE) AS a, CAST(coalesce(b, 0) AS DOUBLE) AS b, CAST(coalesce(na, 0) AS DOUBLE) AS na,
             CAST(coalesce(nb, 0) AS DOUBLE) AS nb, CAST(coalesce(ta, 0) AS DOUBLE) AS ta, CAST(coalesce(tb, 0) AS DOUBLE) AS tb
      FROM (SELECT gram, unnest([1, 2, 3, 4]) AS j FROM need) LEFT JOIN c ON x = right(gram, j) LEFT JOIN k ON ctx = left(right(gram, j), j - 1)),
p1 AS (SELECT gram, CASE WHEN na > 0 THEN (a + ta * (1.0 / 256)) / (na + ta) ELSE 1.0 / 256 END AS pa,
              CASE WHEN nb > 0 THEN (b + tb * (1.0 / 256)) / (nb + tb) ELSE 1.0 / 256 END AS pb FROM l WHERE j = 1),
p2 AS (SELECT gram, CASE WHEN na > 0 THEN (a + ta * pa) / (na + ta) ELSE pa END AS pa, CASE WHEN nb > 0 THEN (b + tb * pb) / (nb + tb) ELSE pb END AS pb
       FROM p1 JOIN l USING (gram) WHERE j = 2),
p3 AS (SELECT gram, CASE WHEN na > 0 THEN (a + ta * pa) / (na + ta) ELSE pa END AS pa, CASE WHEN nb > 0 THEN (b + tb * pb) / (nb + tb) ELSE pb END AS pb
       FROM p2 JOIN l USING (gram) WHERE j = 3),
p4 AS (SELECT gram, CASE WHEN na > 0 THEN (a + ta * pa) / (na + ta) ELSE pa END AS pa, CASE WHEN nb > 0 THEN (b + tb * pb) / (nb + tb) ELSE pb END AS pb
       FROM p3 JOIN l USING (gram) WHERE j = 4),
s AS (SELECT form, any_value(wa) AS wa, any_value(cal) AS cal, round(avg(ln(pa) - ln(pb)), 9) AS score FROM g JOIN p4 USING (gram) WHERE wo > 0 OR cal GROUP BY form),
bins AS (SELECT floor(score * 1000) AS bin, sum(wa) AS n FROM s WHERE cal AND wa > 0 GROUP BY 1),
cum AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS below, sum(n) OVER () AS total FROM bins),
t AS (SELECT least(0.0, coalesce(min(bin) FILTER (below > 0.01 * total), 0) / 1000) AS threshold, (SELECT coalesce(sum(a), 0) > 0 AND coalesce(sum(b), 0) > 0 FROM c4) AS learned FROM cum)
SELECT page_id, host, path, rule, CASE WHEN ruled IS NOT NULL THEN ruled WHEN learned AND score < threshold THEN 'block' ELSE 'allow' END AS verdict
FROM v LEFT JOIN s USING (form), t
"""

ORACLE["op13_hard_negatives"] = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
      FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
             row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
