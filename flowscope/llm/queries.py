"""The registered queries of this subpackage, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.llm import bpe_chunks, decontaminate, jaccard_join, language_id, main_text, nearest, reply_trees, sentence_pieces, token_alignment, token_counts, whitening
from flowscope.llm.sharding import shard_documents
from flowscope.llm.url_filters import judge_urls

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]
SHARDS = 24
MAX_TOKENS = 4_096
QUERY_EVERY = 50


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """A file of the installed public vocabularies, at one place on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def bpe_digests(docs: DataFrame) -> DataFrame:
    path = vocabulary("word_bpe_49k.json")
    return bpe_chunks.encode(docs, path, decoded=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_items(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    n_hit = decontaminate.hit_words("spans")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = main_text.extract(_table(spark, sf_dir, "pages"), ["page_id", "url"])
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest.search(vectors, vectors.filter(F.col("vec_id") % QUERY_EVERY == 0))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    held_out = F.coalesce(remainder == 2, F.lit(False))
    model = language_id.train(docs.filter(~held_out), vocabulary("piece_bpe_32k.model"))
    # the key goes through as a struct, so that no join is needed
    marked = docs.select(F.struct("doc_id", held_out.alias("held_out")).alias("row"), "text")
    return language_id.predict(marked, model, "row").select(
        "row.doc_id", "row.held_out", "lang_pred", "score")


def op6_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select(*extra.columns).unionByName(extra)
    read = reply_trees.conversations(rows).withColumn("read", reply_trees.read_turns("formatted", "loss_spans"))
    return read.select(
        "conv_id", "read.n_turns", F.sha2("read.turns", 256).alias("turns_sha256"),
        F.length("read.loss").cast("long").alias("loss_chars"), F.sha2("read.loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"), SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(_table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).select(
        "page_id", "host", "path", "rule", "verdict")


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentence_pieces.encode(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    white = whitening.whiten(vectors, whitening.fit(vectors))
    return white.select(
        "vec_id", "n", "deviation", "identity_error",
        F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "on")).select(
        "vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "on.whitened", "on.explained", "identity_error")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = token_alignment.align(
        _table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"),
        kept=lambda groups: F.when(groups == "", "").otherwise(F.sha2(groups, 256)))
    return aligned.withColumnRenamed("groups", "groups_sha256")


def queries() -> dict[str, Query]:
    return {name: q for name, q in globals().items() if name.startswith("op") and name[2].isdigit()}


OP10_SQL = r"""
WITH parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
rules(rule_host, rule_path, rule_verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
urls AS (SELECT DISTINCT host, path FROM parts),
fits AS (
  SELECT host, path, rule_host || rule_path AS rule, rule_verdict,
    row_number() OVER (PARTITION BY host, path
      ORDER BY length(rule_host || rule_path) DESC, rule_host || rule_path DESC) AS nth
  FROM urls JOIN rules
    ON (host = rule_host OR host LIKE '%.' || rule_host) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE nth = 1) USING (host, path)
"""


OP6_SQL = r"""
WITH said(said) AS (SELECT chr(92) || '### Assistant: </turn> ok'),
rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', said FROM said
  UNION ALL SELECT -7, 1, 'assistant', said FROM said)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  -- a turn is written as <turn role>, a line feed, the text, </turn> and a line feed
  CAST(sum(length('<turn ' || '>' || '</turn>') + 2
    + length(replace(replace(replace(role || text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

OP8_SQL = """
WITH RECURSIVE entries(byte, value, step) AS (
  SELECT i, CAST(i AS BIGINT), 0 FROM range(256) r(i)
  UNION ALL
  SELECT byte, CASE WHEN value % 2 = 1 THEN xor(value // 2, 3988292384) ELSE value // 2 END, step + 1
  FROM entries WHERE step < 8),
crc(entry) AS (SELECT list(value ORDER BY byte) FROM entries WHERE step = 8),
sized AS (
  SELECT doc_id, text, CAST(coalesce(strlen(text), 0) + 8 AS BIGINT) AS size FROM documents),
placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS begins,
         sum(size) OVER () AS every
  FROM sized),
sharded AS (SELECT *, CAST(begins * 24 // every AS INTEGER) AS shard FROM placed),
crcs AS (
  SELECT doc_id, list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), list_transform(
        range(strlen(coalesce(text, ''))),
        lambda i: CAST(('0x' || substr(hex(coalesce(text, '')), 2 * i + 1, 2)) AS BIGINT))),
      lambda c, b: xor(c // 256, entry[xor(c % 256, b) + 1])) AS state
  FROM documents, crc)
SELECT doc_id, size, xor(state, CAST(4294967295 AS BIGINT)) AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM sharded JOIN crcs USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_reply_trees": OP6_SQL, "op8_sharding": OP8_SQL, "op10_url_filters": OP10_SQL}
