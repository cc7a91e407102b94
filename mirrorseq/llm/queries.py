"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint, html, html_pages, mixing, packing, paragraphs, pii, quality, rule_ensemble, sharding, simhash, spelling, toxicity, whitening
from .common import as_key, n_words, read

_WORD_SQL = r"'[^\x20\x09-\x0D]+'"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of equal weight; law ``key``."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    placed = sharding.rendezvous(docs, as_key(F.col("doc_id")), [1.0] * 40, grown="grown_shard")
    out = sharding.numbered(placed, "doc_id", ["text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


OP1_SQL = """
WITH RECURSIVE table_steps AS (
  SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM table_steps WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS t FROM table_steps WHERE k = 8),
d AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS id, hex(encode(coalesce(text, ''))) AS h FROM documents
), sized AS (
  SELECT doc_id, id, (length(h) // 2 + 16)::BIGINT AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM d, crc_table
), draws AS (
  SELECT id, k, -ln((('0x' || substr(md5(id || ':' || k), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) AS cost
  FROM (SELECT DISTINCT id FROM sized), range(41) r(k)
), placed AS (
  SELECT id, arg_min(k, cost) FILTER (k < 40)::INT AS shard, arg_min(k, cost)::INT AS grown_shard FROM draws GROUP BY id
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(id || ':' || text_crc32 || ':' || size), 1, 2), doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM sized JOIN placed USING (id)
"""


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 1, 2, 3, repeating."""
    mixed = mixing.mix(read(spark, sf_dir, "documents"), "doc_id", n_words(F.col("text")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORD_SQL}))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS place FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::BIGINT AS weight FROM d GROUP BY source
), levels AS (
  SELECT *, (sum(source_size) OVER () * 1.0::DOUBLE
      - coalesce(sum(source_size * 3) OVER (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s
), final AS (SELECT max(level) FILTER (source_size * 3 > level * weight) AS level FROM levels
), t AS (
  SELECT source, source_size, CASE WHEN f.level IS NULL OR source_size * 3 <= f.level * weight THEN (source_size * 3)::DOUBLE ELSE f.level * weight END AS target FROM s, final f
), q AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS whole FROM t
), r AS (
  SELECT d.doc_id, d.size, q.source_size, q.target, q.whole, q.target - q.whole * q.source_size AS quota,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place) AS running
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN running <= quota THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    model = html.train(spark.createDataFrame([(p,) for p in html_pages.labelled_pages()], "html string"))
    found = html.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"), model)
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: The vocabulary's place; a parameter of the operator.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return fingerprint.fingerprints(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms for their personal data."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.protect(docs, pii.session_key(spark), count="n_private")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_components(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of every document."""
    return paragraphs.repeated(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    measured = quality.measures(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    out = quality.judged(quality.voted(measured).select(*columns, "pattern"))
    return out.select(*columns, "kept", F.round("posterior", 6).alias("posterior"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; a fifth of the labels is held out."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels").select("doc_id", "quality")
    scored = rule_ensemble.classify(docs, labels, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling.variants(read(spark, sf_dir, "documents").select("doc_id", "text"))


#: Two words are one edit apart if one is the other without a letter, or both
#: are equal without the letter at the same place.
OP12_SQL = """
WITH RECURSIVE table_steps AS (
  SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM table_steps WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS t FROM table_steps WHERE k = 8),
runs AS (
  SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT coalesce(doc_id::VARCHAR, 'null') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{6,}')) AS run FROM documents) GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS h
  FROM (SELECT run, n, hex(encode(id || ':' || run)) AS h FROM runs), crc_table
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
), vocabulary AS (SELECT word, sum(n)::BIGINT AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM vocabulary, range(1, 200) r(i) WHERE i <= length(word)
), pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, v.word, v.n FROM less a JOIN vocabulary v ON a.rest = v.word
  UNION SELECT v.word, a.word, a.n FROM less a JOIN vocabulary v ON a.rest = v.word
), best AS (SELECT word, count(DISTINCT near) AS n_near, min({'m': -near_n, 'w': near}) AS b FROM pairs GROUP BY word
), forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 5 * v.n THEN b.w END AS form, CASE WHEN -b.m >= 5 * v.n THEN -b.m END AS form_n FROM vocabulary v LEFT JOIN best USING (word)
), chains AS (SELECT word, word AS root FROM forms UNION ALL SELECT c.word, f.form FROM chains c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chains c ON c.word = f.word JOIN forms e ON e.word = c.root AND e.form IS NULL
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding on its four main components, whitened."""
    return whitening.whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_mixing, op3_html, op4_packing, op5_fingerprints, op6_pii, op7_toxicity, op8_simhash, op9_paragraphs, op10_quality, op11_quality_rules, op12_spelling, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": OP1_SQL, "op2_mixing": OP2_SQL, "op12_spelling": OP12_SQL}
