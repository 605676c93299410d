"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, fingerprints, langid, lexical, licenses, line_dedup, neardup, packing, quality, runs, token_store, url_lm, warc
from .common import small_batches, table, written


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op2_url_lm_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lm.judge(table(spark, sf_dir, "pages"))


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trained = langid.learn(docs.where(~langid.held_out("doc_id")))
    # held_out is a function of the id alone, so that no join has to bring it back
    return langid.predict(docs, trained).select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score", "lang_set", "proportions")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op5_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    # which rule rejects first depends on the measured order; the verdict doesn't
    return quality.judge(table(spark, sf_dir, "documents")).drop("reason")


def op6_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    # where the sampled cuts of the capture index fall isn't a function of the pages alone
    return warc.archive(table(spark, sf_dir, "pages")).drop("index_range", "place")


def op7_oph_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.near_edits(table(spark, sf_dir, "documents"))


def op8_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_odd_sketch_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = neardup.link(table(spark, sf_dir, "documents"), size=2, threshold=80)
    return linked.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op10_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = written(packing.pieces(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json")), "pieces")
    return packing.pack(cut, cut.count())


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(table(spark, sf_dir, "documents"))


def op12_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lines.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bounded(f):
        def g(spark, sf_dir):
            small_batches(spark)
            return f(spark, sf_dir)

        return g

    ops = [op1_license_scan, op2_url_lm_filter, op3_language_mixture, op4_token_store, op5_quality_cascade, op6_warc_index_merge, op7_oph_fingerprints, op8_segment_tree_bpe, op9_odd_sketch_neardup, op10_sum_of_squares_packing, op11_periodic_runs, op12_block_max_search, op13_line_dedup, pipeline]
    return {f.__name__: bounded(f) for f in ops}


OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
pos AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS s FROM pos),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
gap AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS k FROM dup),
rep AS (SELECT doc_id, sum(k)::BIGINT AS n_repeat_words FROM gap GROUP BY doc_id),
c AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
    coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(regexp_extract_all(t, '[^\n]*[^\x20\x09-\x0D][^\n]*')) - len(list_distinct(regexp_extract_all(t, '[^\n]*[^\x20\x09-\x0D][^\n]*'))))::BIGINT AS n_dup_lines,
    len(list_distinct(ws)) AS n_distinct, length(regexp_replace(t, '[\x01-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS n_letters
  FROM w),
m AS (SELECT c.*, coalesce(rep.n_repeat_words, 0)::BIGINT AS n_repeat_words FROM c LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 4 * n_symbols > n_words OR (n_dup_lines >= 3 AND 20 * n_dup_lines > n_words) OR 20 * n_distinct < n_words OR 2 * n_letters < word_chars) AS kept
FROM b
"""


#: Base32 of a digest: 20 bits, five hexadecimal digits, are four letters.
OP6_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS keeper FROM p),
d AS (SELECT *, list_transform(range(0, 8), lambda k: ('0x' || substr(hex, (5 * k + 1)::BIGINT, 5))::BIGINT) AS v FROM h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x // 32768 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x // 1024 % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x // 32 % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x % 32 + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM d
"""

OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, ws[i] || ' ' || ws[i + 1] AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM w WHERE len(ws) > 1) UNION ALL SELECT doc_id, ws[1] FROM w WHERE len(ws) = 1)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
sized AS (SELECT s.doc_id, s.s, n.n FROM s JOIN n USING (doc_id)),
link AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sized a JOIN sized b ON a.s = b.s AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT link.b, reach.r FROM reach JOIN link ON link.a = reach.id),
comp AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT comp.id AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, comp.id = component_id AS kept FROM comp LEFT JOIN n ON n.doc_id = comp.id
"""

OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
dw AS (SELECT r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM d),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ws))::BIGINT AS n_all FROM dw WHERE len(ws) > 0),
tf AS (SELECT r, doc_id, len(ws) AS n, w, count(*) AS tf FROM (SELECT r, doc_id, ws, unnest(ws) AS w FROM dw) GROUP BY ALL),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
q AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM benchmark),
qw AS (SELECT q, item_id, w, count(*) AS k FROM (SELECT q, item_id, unnest(ws) AS w FROM q) GROUP BY ALL),
weight AS (SELECT q, item_id, qw.w, k * floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS x FROM qw JOIN df USING (w), total),
scored AS (
  SELECT q, item_id, r, doc_id, sum(x * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_all))))::BIGINT AS score
  FROM weight JOIN tf USING (w), total GROUP BY q, item_id, r, doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""

OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
shared AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
m AS (SELECT k.*, shared.key IS NOT NULL AND k.doc_id IS DISTINCT FROM owner AS gone FROM k LEFT JOIN shared ON k.key = shared.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_cascade": OP5_SQL, "op6_warc_index_merge": OP6_SQL, "op9_odd_sketch_neardup": OP9_SQL, "op12_block_max_search": OP12_SQL, "op13_line_dedup": OP13_SQL}
