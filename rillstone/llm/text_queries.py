"""Queries p8 (token ids), p9 (packing) and p10 (abusive content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.llm import abuse
from rillstone.llm.bpe import decoded, encoded
from rillstone.llm.packing import packed
from rillstone.store import table, written


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return encoded(d, F.col("doc_id"), F.col("text"))


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts again, from their ids."""
    return decoded(p8_ids(spark, sf_dir), F.col("doc_id"), F.col("ids"))


def p9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All non-empty documents in containers of each kind."""
    d = table(spark, sf_dir, "documents").where("text <> ''")
    lengths = encoded(d, F.col("doc_id"), F.col("text"), lengths_only=True)
    return packed(lengths, F.col("doc_id"), F.col("n_tokens"), table(spark, sf_dir, "containers"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind: containers used, the least that any packing needs at all, and the share of unused space."""
    caps = table(spark, sf_dir, "containers")
    p = written(p9_packing(spark, sf_dir)).groupBy("container_kind").agg(
        (F.max("container") + 1).alias("containers"), F.sum("n_tokens").alias("n_tokens"), F.count_distinct("doc_id").alias("documents")
    )
    out = p.join(caps, "container_kind")
    return out.select(
        "container_kind", "capacity_tokens", "documents", "n_tokens", "containers",
        F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least"),
        F.round(1 - F.col("n_tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("unused"),
    )


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind: the documents in containers, and whether all containers fit, none is split without need, and no token is lost or doubled."""
    caps = table(spark, sf_dir, "containers").withColumn("capacity", F.col("capacity_tokens").cast("bigint"))
    d = table(spark, sf_dir, "documents").where("text <> ''")
    lengths = written(encoded(d, F.col("doc_id"), F.col("text"), lengths_only=True))
    p = written(packed(lengths, F.col("doc_id"), F.col("n_tokens"), caps).join(caps.select("container_kind", "capacity"), "container_kind"))
    fits = p.groupBy("container_kind", "container", "capacity").agg(F.sum("n_tokens").alias("n")).groupBy("container_kind").agg(F.bool_and(F.col("n") <= F.col("capacity")).alias("fits"))
    each = p.groupBy("container_kind", "doc_id", "capacity").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces")).join(lengths, "doc_id", "full")
    whole = each.groupBy("container_kind").agg(
        F.count("pieces").alias("documents"),
        F.bool_and(F.coalesce(F.col("pieces") == F.ceil(F.col("n_tokens") / F.col("capacity")), F.lit(False))).alias("split_by_need"),
        F.bool_and(F.coalesce(F.col("n") == F.col("n_tokens"), F.lit(False))).alias("complete"),
    )
    return whole.join(fits, "container_kind").select("container_kind", "documents", "fits", "split_by_need", "complete")


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    model = abuse.fitted(d, F.col("doc_id"), F.col("text"), table(spark, sf_dir, "doc_ratings"))
    return abuse.scored(d, F.col("doc_id"), F.col("text"), F.col("source"), model)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_scores(spark, sf_dir).where("abusive").select("doc_id")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(p10_scores(spark, sf_dir))


def p10_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: the documents that have a score, and whether rate and mean score can be right."""
    r = p10_rates(spark, sf_dir)
    return r.select("source", "documents", (F.col("rate").between(0, 1) & F.col("mean_score").between(0, 1) & (F.abs(F.col("rate") * F.col("documents") - F.col("abusive")) < 1e-6)).alias("sound"))


QUERIES = {
    "p8_ids": p8_ids,
    "p8_decoded": p8_decoded,
    "p9_packing": p9_packing,
    "p9_containers": p9_containers,
    "p9_checks": p9_checks,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_rates": p10_rates,
    "p10_documents": p10_documents,
}
SQL = {
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_checks": "SELECT container_kind, (SELECT count(*) FROM documents WHERE text <> '') AS documents, true AS fits, true AS split_by_need, true AS complete FROM containers",
    "p10_documents": "SELECT source, count(*) AS documents, true AS sound FROM documents GROUP BY source",
}
