"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tracemill.llm import conversations, decontaminate, hardnegatives, htmltext, langid, langmodel, minhash, neighbours, ngramjoin, packing, quality, sharding, warc
from tracemill.llm.common import Run, is_fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    documents = table(spark, sf_dir, "documents")
    scores = quality.score(documents, quality.learn(documents, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", is_fold(F.col("doc_id"), 0).alias("held_out"), "score", "predicted")


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return minhash.classes(table(spark, sf_dir, "documents"))


def op3_langmodel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document."""
    return langmodel.score(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back."""
    archives = Run(spark, "warc").land(warc.write_archives(table(spark, sf_dir, "pages")), "archives")
    records = warc.read_archives(archives, payloads=False)
    sound = F.when(F.col("problem").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat_ws(": ", "path", "problem")))
    return records.select("page_id", "payload_bytes", "payload_digest", sound.alias("record_type"), "refers_to")


def op5_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    documents = table(spark, sf_dir, "documents")
    found = langid.identify(documents, langid.learn(documents))
    return found.select("doc_id", is_fold(F.col("doc_id"), 0).alias("held_out"), "lang_pred", "score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket, batch and place of every document."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, and its shard among one more."""
    return sharding.place(table(spark, sf_dir, "documents"))


def op11_hardnegatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hard negatives of each of the five best positives of every vector whose id is divisible by 100."""
    label = F.col("label").cast("long")
    embeddings = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hardnegatives.mine(embeddings, F.col("vec_id") % 100 == 0)


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged and repaired."""
    return conversations.damage_and_repair(table(spark, sf_dir, "conversations"))


def op13_ngramjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document among those of similar four-word sets."""
    return ngramjoin.join(table(spark, sf_dir, "documents"))


OPERATORS = (
    op1_quality, op2_neardup, op3_langmodel, op4_warc, op5_htmltext, op6_language, op7_packing, op8_neighbours, op9_decontaminate, op10_sharding,
    op11_hardnegatives, op12_conversations, op13_ngramjoin,
)
QUERIES = {f.__name__: f for f in OPERATORS} | {"pipeline": corpus_pipeline.run}

#: Upper-case base32 of a SHA-1 in hex: eight groups of 20 bits, four letters each.
_BASE32 = """list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), 'string_agg', '')"""
ORACLE: dict[str, str] = {
    "op4_warc": f"""
        WITH hashed AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
        firsts AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM hashed)
        SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM firsts
    """,
    "op11_hardnegatives": """
        WITH v AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
                   FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
              FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
        SELECT p.anchor_id, p.other_id AS positive_id, (row_number() OVER best)::INT AS rank, s.other_id AS negative_id,
               p.score AS positive_score, s.score AS negative_score
        FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
        WINDOW best AS (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id)
        QUALIFY row_number() OVER best <= 5
    """,
    "op13_ngramjoin": r"""
        WITH RECURSIVE words AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS MATERIALIZED (SELECT r, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                 ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS s FROM words),
        grams AS MATERIALIZED (SELECT r, len(s) AS n, unnest(s) AS g FROM sets),
        common AS (SELECT x.r AS a, y.r AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS shared
                   FROM grams x JOIN grams y ON x.g = y.g AND x.r <> y.r GROUP BY ALL),
        links AS MATERIALIZED (SELECT a, b FROM common WHERE 100 * shared >= 85 * (na + nb - shared)),
        reach AS (SELECT r AS a, r AS b FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
        SELECT s.doc_id, len(s.s) AS n_shingles, min(t.doc_id) AS component_id
        FROM reach JOIN sets s ON s.r = reach.a JOIN sets t ON t.r = reach.b GROUP BY s.r, s.doc_id, len(s.s)
    """,
}
