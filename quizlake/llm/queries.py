"""The registered queries of the numbered operators, with production parameters."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake.llm import (
    byte_codec,
    language,
    maxscore,
    merkle,
    near_texts,
    near_vectors,
    packing,
    piece_codec,
    quantizer,
    suffixes,
    token_files,
    toxicity,
    warc,
)
from quizlake.llm.common import scratch, stored, table
from quizlake.llm.oracles import merkle_sql, quantizer_sql
from quizlake.llm.word_ids import word_ids

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_codec.coded(table(spark, sf_dir, "documents"), PIECE_MODEL)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    known = language.learn(docs.filter(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), language.predicted(docs, known).alias("_l"))
    return found.select("doc_id", "held_out", F.col("_l.lang").alias("lang_pred"), F.col("_l.score").alias("score"))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.deduplicated(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        (F.size("spans") / 2).cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        (F.size("spans") > 0).alias("has_repeats"),
    )


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.95)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), BYTE_VOCABULARY, end_id=2)
    cut = stored(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return packing.placed(cut)


def op7_near_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_texts.near_duplicates(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    records = warc.record_types(table(spark, sf_dir, "pages"))
    warc.write_bundles(records, path).write.parquet(f"{path}-index")
    back = warc.read_bundles(spark, path)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


TOXIC_CHAIN = ["poor", "toxic"]


def toxicity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels as categories of the chain: poor quality first, then toxic."""
    return table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("poor"), "toxic")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.fit(docs, toxicity_labels(spark, sf_dir), TOXIC_CHAIN)
    scored = chain.score(docs)
    return scored.select(
        "doc_id",
        F.col("_p_poor").alias("p_poor"),
        F.col("_p_toxic").alias("p_toxic"),
        (F.col("_p_toxic") >= 0.5).alias("toxic"),
    )


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    ids = stored(token_files.token_ids(table(spark, sf_dir, "documents"), WORD_VOCABULARY, end_id=1), "ids")
    manifest = token_files.write_files(ids, path, word_ids(WORD_VOCABULARY).library.get_vocab_size())
    return token_files.read_files(spark, path, manifest).select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def op11_byte_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_codec.coded(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_quantizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = quantizer.fit(table(spark, sf_dir, "embeddings"))
    rows = quantizer.label_errors(codes.rows(), "label")
    books = F.sha2(F.lit(codes.text()), 256).alias("codebooks_sha256")
    return rows.select("vec_id", "code", "error", "label_error", books)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    picked = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    found = merkle.manifest(
        docs, ["doc_id", "source", "lang", "n_chars", "text"], tampered={"text": F.when(picked, lowered).otherwise(F.col("text"))})
    folded = found.withColumn("folded_root", merkle.folded(F.col("tampered_leaf"), F.col("path")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root",
        F.sha2(merkle.proof(F.col("path")), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


QUERIES = {
    "op1_maxscore": op1_maxscore,
    "op2_piece_codec": op2_piece_codec,
    "op3_language": op3_language,
    "op4_suffixes": op4_suffixes,
    "op5_near_vectors": op5_near_vectors,
    "op6_packing": op6_packing,
    "op7_near_texts": op7_near_texts,
    "op8_warc": op8_warc,
    "op9_toxicity": op9_toxicity,
    "op10_token_files": op10_token_files,
    "op11_byte_codec": op11_byte_codec,
    "op12_quantizer": op12_quantizer,
    "op13_merkle": op13_merkle,
}

_VECTORS = """SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND len(embedding) > 0
 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"""

ORACLES: dict[str, str] = {
    "op1_maxscore": f"""WITH v AS (SELECT vec_id, list_transform(v, lambda x: floor(64 * x)) AS v FROM ({_VECTORS})),
 s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id)
 SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id, score FROM s QUALIFY rank <= 20""",
    "op5_near_vectors": f"""WITH RECURSIVE v AS (SELECT * FROM ({_VECTORS}) WHERE len(list_filter(v, lambda x: x <> 0)) > 0),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
 r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
 n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
 SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id,
  vec_id = coalesce(c, vec_id) AS kept
 FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id WHERE vec_id IS NOT NULL""",
    "op8_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
 d AS (SELECT page_id, CAST(strlen(p) AS BIGINT) AS payload_bytes, sha1(p) AS payload_digest FROM p),
 w AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN
  max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS first_id FROM d)
 SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM w""",
    "op12_quantizer": quantizer_sql(),
    "op13_merkle": merkle_sql(),
}
