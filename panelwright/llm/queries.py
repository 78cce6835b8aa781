"""The operators as queries over the given tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontam, kmeans, langid, line_dedup, lm_scoring, mixing, packing, passage_dedup, simhash, token_counts, topk, whitening
from .common import crc_mod, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    bitmaps = line_dedup.keep_bitmaps(docs, mode="frequent", min_docs=10, min_chars=1)
    return line_dedup.apply_bitmaps(docs, bitmaps, digest=True)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    test = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_segments(own.unionByName(test)), dealt=True)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), ngram=4, max_bits=4)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, crc_mod("doc_id", 4) != 2)
    return langid.predict(docs, model).withColumn("held_out", crc_mod("doc_id", 4) == 2)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.encode(table(spark, sf_dir, "documents")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return passage_dedup.span_lists(docs, passage_dedup.repeated_spans(docs, short_lines=True))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2)


def op11_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.with_inertia(*kmeans.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dim=64, seed=2))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=32)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.prefix_counts(table(spark, sf_dir, "documents"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_chat_format, op3_simhash, op4_language_id, op5_packing, op6_mixing, op7_decontamination, op8_topk, op9_passage_dedup, op10_lm_scoring, op11_kmeans, op12_whitening, op13_token_counts)
}

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: A round of op11: the nearest centroid of each vector, and the new centroids; the whole part of a quotient goes down.
_NEAR = """near{r} AS MATERIALIZED (
  SELECT v.no, any_value(v.vec_id) AS vec_id, any_value(v.q) AS q, arg_min(c.c, (c.d, c.c)) AS cluster, min(c.d) AS distance
  FROM v JOIN (SELECT v.no, c.c, CAST(list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{r} c) c ON v.no = c.no
  GROUP BY v.no)"""
_MEAN = """c{next} AS MATERIALIZED (
  SELECT o.c, coalesce(n.q, o.q) AS q FROM c{r} o LEFT JOIN (
    SELECT cluster, list(m ORDER BY j) AS q FROM (
      SELECT cluster, j, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (
        SELECT cluster, j, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(q) AS x, unnest(range(64)) AS j FROM near{r}) GROUP BY cluster, j))
    GROUP BY cluster) n ON n.cluster = o.c)"""
_ROUNDS = ",\n".join(_NEAR.format(r=r) + ",\n" + _MEAN.format(r=r, next=r + 1) for r in range(5))

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, translate(trim(line, {_BLANKS}), '{_UP}', '{_LOW}') AS k FROM lines),
often AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k IN (SELECT k FROM often)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE k NOT IN (SELECT k FROM often)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id""",
    "op2_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
marked AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after,
         CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'tool' THEN 13
              ELSE 20 + length(regexp_replace(role, '(\\|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|\[TOOL\]|\[/TOOL\]|\[ROLE\]|\[/ROLE\]|\[/END\])', '.\1', 'g')) END
         + length(regexp_replace(text, '(\\|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|\[TOOL\]|\[/TOOL\]|\[ROLE\]|\[/ROLE\]|\[/END\])', '.\1', 'g')) AS chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
ok AS (
  SELECT *, CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user' WHEN before = 'user' THEN role = 'assistant'
                 WHEN before = 'assistant' THEN role IN ('user', 'tool') WHEN before = 'tool' THEN role IN ('assistant', 'tool') ELSE false END AS fits FROM marked)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars, bool_and(fits) AS valid_order,
       bool_and(fits) AND bool_or(after IS NULL AND role = 'assistant') AS complete
FROM ok GROUP BY conv_id""",
    "op6_mixing": r"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5(coalesce(text, '')) AS mark,
         row_number() OVER (PARTITION BY doc_id, source, md5(coalesce(text, ''))) - 1 AS no FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighed AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight, source_size * 3 AS lim FROM sources),
filled AS (SELECT *, CAST(lim AS DOUBLE) / weight AS filled FROM weighed),
ahead AS (
  SELECT *, coalesce(sum(lim) OVER o, 0) AS lim_ahead, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS weight_left, sum(source_size) OVER () AS words
  FROM filled WINDOW o AS (ORDER BY filled, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, CAST(words - lim_ahead AS DOUBLE) / CAST(weight_left AS DOUBLE) AS lvl FROM ahead),
level AS (SELECT arg_min(lvl, (filled, source)) AS lvl FROM levels WHERE lvl <= filled),
plan AS (
  SELECT source, source_size, least(CAST(lim AS DOUBLE), coalesce((SELECT lvl FROM level), CAST('inf' AS DOUBLE)) * weight) AS target FROM levels),
plan2 AS (SELECT *, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE target / CAST(source_size AS DOUBLE) END AS ratio FROM plan),
docs AS (
  SELECT s.doc_id, s.source, s.size, p.source_size, p.target, CAST(floor(p.ratio) AS BIGINT) AS whole, p.ratio - floor(p.ratio) AS chance,
         p.target - CAST(p.source_size * CAST(floor(p.ratio) AS BIGINT) AS DOUBLE) AS room,
         (CAST(('0x' || substr(md5('7:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null') || ':' || s.mark || ':' || s.no), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sizes s JOIN plan2 p ON s.source IS NOT DISTINCT FROM p.source),
keyed AS (SELECT *, CASE WHEN chance > 0 AND size > 0 THEN (u / (1.0::DOUBLE - u)) / (chance / (1.0::DOUBLE - chance)) END AS key FROM docs),
able AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size) AS place FROM keyed WHERE key IS NOT NULL),
rounds AS (
  SELECT source, target, CAST(0 AS BIGINT) AS after, coalesce(max(place) FILTER (WHERE words <= room), 0) AS upto, CAST('inf' AS DOUBLE) AS most,
         any_value(room) - coalesce(max(words) FILTER (WHERE words <= room), 0) AS gap
  FROM (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY place) AS DOUBLE) AS words FROM able) GROUP BY source, target
  UNION ALL
  SELECT source, target, upto, max(place), gap, gap - max(words)
  FROM (SELECT r.*, a.place, CAST(sum(a.size) OVER (PARTITION BY a.source ORDER BY a.place) AS DOUBLE) AS words
        FROM rounds r JOIN able a ON a.source IS NOT DISTINCT FROM r.source AND a.place > r.upto AND a.size <= r.gap WHERE r.gap > 0.005 * r.target)
  WHERE words <= gap GROUP BY source, target, upto, gap),
taken AS (
  SELECT a.*, EXISTS (SELECT 1 FROM rounds r WHERE a.source IS NOT DISTINCT FROM r.source AND a.place > r.after AND a.place <= r.upto AND a.size <= r.most) AS took FROM able a),
gaps AS (SELECT source, min(gap) AS gap FROM rounds GROUP BY source),
closing AS (
  SELECT t.source, arg_min(t.place, (abs(t.size - g.gap), t.place)) AS closing FROM taken t JOIN gaps g ON t.source IS NOT DISTINCT FROM g.source
  WHERE NOT t.took AND abs(t.size - g.gap) < g.gap GROUP BY t.source)
SELECT doc_id, size, source_size, target, CAST(size * whole AS BIGINT) AS taken FROM keyed WHERE key IS NULL
UNION ALL
SELECT t.doc_id, t.size, t.source_size, t.target, CAST(t.size * (t.whole + CASE WHEN t.took OR t.place = c.closing THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM taken t LEFT JOIN closing c ON t.source IS NOT DISTINCT FROM c.source""",
    "op7_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
per AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT doc_id, n, i FROM hits)) GROUP BY doc_id),
names AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN names USING (doc_id)""",
    "op8_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op11_kmeans": f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS no, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, q) - 1 AS INTEGER) AS c, q
  FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, q FROM v ORDER BY h NULLS LAST, q LIMIT 40)),
{_ROUNDS},
{_NEAR.format(r=5)},
inertia AS (SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM near5 GROUP BY cluster)
SELECT a.vec_id, a.cluster, a.distance, i.cluster_inertia, (SELECT CAST(sum(distance) AS BIGINT) FROM near5) AS inertia,
       sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM near5 a JOIN inertia i ON a.cluster = i.cluster JOIN c5 c ON a.cluster = c.c""",
}
