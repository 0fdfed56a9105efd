"""The queries of this subpackage, each over a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20, among all others."""
    from gondola.llm.ann import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    from gondola.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), width=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document, counted and digested."""
    from gondola.llm.pii import BASE_KINDS, find_pii

    found = find_pii(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(of(*BASE_KINDS)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition figures and verdict of every document."""
    from gondola.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, by the law 'bytes'."""
    from gondola.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document: their number, their CRC-32, and whether they decode to the text."""
    import public_tokenizers

    from gondola.llm.sentencepiece import digest

    return digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those of which crc32 of the id, modulo 4, is not 2."""
    from gondola.llm import langid

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    models = langid.fit(docs.filter(~held_out & F.col("lang").isNotNull()))
    return langid.predict(docs, models).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits", "rejected")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels of documents of which crc32 of the id, modulo 3, is not 1."""
    from gondola.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, packed into sequences of 4096 tokens."""
    import public_tokenizers

    from gondola.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), seq_len=4096)


def op10_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from gondola.llm.extraction import extract

    return extract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_ann, op2_simhash, op3_pii, op4_quality, op5_sharding, op6_sentencepiece, op7_langid, op8_toxicity, op9_packing, op10_extraction)
    return {f.__name__: f for f in found}


def quality_sql() -> str:
    """op4_quality by plain windows over words and lines."""
    from gondola.llm.quality import MOST_IN_LINES, MOST_REPEATED

    word = r"[^\x20\x09-\x0D]+"
    gram = lambda n: f"""(SELECT r, i, size, max(CASE WHEN whole AND times > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS inside FROM
        (SELECT *, count(*) OVER (PARTITION BY r, gram, whole) AS times FROM (SELECT r, i, length(word) AS size,
            string_agg(word, ' ') OVER own AS gram, count(*) OVER own = {n} AS whole FROM words WINDOW own AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING))))"""  # noqa: E731
    share = lambda x: f"coalesce({x}, 0) / greatest(coalesce(word_chars, 0), 1)"
    joins = " ".join(f"LEFT JOIN (SELECT r, sum(size * inside) AS in_{n} FROM {gram(n)} GROUP BY r) USING (r)" for n in MOST_REPEATED)
    return f"""WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    words AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT r, regexp_extract_all(text, '{word}') AS ws FROM texts)),
    lines AS (SELECT r, line, row_number() OVER (PARTITION BY r, line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts)),
    figures AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
        {", ".join(f"{share(f'in_{n}')} AS share_{n}" for n in MOST_REPEATED)}, {share('in_lines')} AS share_lines
        FROM texts LEFT JOIN (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM words GROUP BY r) USING (r)
        LEFT JOIN (SELECT r, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS in_lines FROM lines WHERE n > 1 AND regexp_matches(line, '{word}') GROUP BY r) USING (r)
        LEFT JOIN (SELECT r, sum(inside) AS n_repeat_words FROM {gram(3)} GROUP BY r) USING (r) {joins})
    SELECT *, NOT (base_failed OR share_lines > {MOST_IN_LINES} OR {" OR ".join(f"share_{n} > {x}" for n, x in MOST_REPEATED.items())}) AS kept
    FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM figures)"""


def oracle_sql() -> dict[str, str]:
    """SQL of op4_quality. The others need XXH64, CRC-32, fitted models, vocabularies or an approximate search."""
    return {"op4_quality": quality_sql()}
