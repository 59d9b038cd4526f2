"""The queries opN_<name>, each over its whole table, with SQL where SQL can express them; tests compare all of them with brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sedge.llm import alignment, ann, langid, linededup, lm, media, mixing, negatives, packing, pii, secretscan, simhash, tokencount
from sedge.sources import table


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, folder, "documents")))


def op5_media(spark: SparkSession, folder: str) -> DataFrame:
    """No table holds sound: the bytes of each whole text are played as a recording of 8-bit samples."""
    docs = table(spark, folder, "documents")
    crc32 = F.crc32(F.concat_ws(",", F.col("fp").cast("array<string>")).cast("binary"))
    found = media.aligned(docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("media")), shown=crc32)
    return found.select(
        F.col("id").alias("doc_id"), "n_places", F.col("fp").alias("fp_crc32"), "class_id", "match_id", "shift", "hop", F.round("error", 6).alias("error"),
    )


def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.languages(table(spark, folder, "documents"))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    made = mixing.rates(table(spark, folder, "documents"), table(spark, folder, "labels"), kept=["doc_id"])
    return made.select(F.col("row.doc_id").alias("doc_id"), "p_plain", "p_poor", "p_toxic", "tokens", "rate", "copies")


def op8_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return tokencount.token_counts(table(spark, folder, "documents"))


def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secretscan.digest(secretscan.secrets(table(spark, folder, "documents")))


def op10_lm(spark: SparkSession, folder: str) -> DataFrame:
    return lm.scores(table(spark, folder, "documents"))


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.alignments(table(spark, folder, "documents"))


def op12_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Where vec_id is divisible by 7, the next label of the ten is taken: labels that are wrong on purpose."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_lines(spark: SparkSession, folder: str) -> DataFrame:
    made = linededup.without_repeated_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return made.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_packing, op3_neighbours, op4_pii, op5_media, op6_language, op7_mixing, op8_tokens, op9_secrets, op10_lm,
        op11_alignment, op12_negatives, op13_lines,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op12_negatives": """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score FROM r AS a JOIN r ON a.vec_id <> r.vec_id AND len(a.v) = len(r.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n QUALIFY rank <= 5""",
    "op13_lines": r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, r.key IS NOT NULL AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
}
