"""Exact dedup with a heavy-hitter split; DataFrame functions only.

Texts are equal when identical after lower-casing A-Z. Each row gets the
SHA-256 of its normalised text once; the thin table (id, digest) is written to
the shared folder and all later passes read that.

1. A Misra-Gries summary (``freqItems``: deterministic counters without false
   negatives above the support) finds every digest that may exceed rows / k.
2. One filtered aggregation counts the candidates exactly; those that really
   exceed rows / k win. At most k of them exist, whatever the input, so the
   winners with their kept id are broadcast and their rows never shuffle.
3. The other digests have rows / k rows at most and take an ordinary shuffle.
   k is eight times the number of shuffle partitions, so no remaining group
   fills more than an eighth of a mean partition.

Defined results: a null text counts as empty, and empty texts are one group;
the largest doc_id stays, null being the smallest; rows that repeat both
doc_id and text are the same document delivered twice: each has kept = true in
``exact_groups`` and ``drop_exact_copies`` returns one of them. An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


def text_digest():
    return F.sha2(common.lower_ascii(F.coalesce("text", F.lit(""))), 256)


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    spark = docs.sparkSession
    rows = common.materialise(docs.select("doc_id", text_digest().alias("text_sha256")), "digests")
    return _resolve(rows, min(8192, max(256, 8 * common.shuffle_partitions(spark))))


def _resolve(rows: DataFrame, k: int) -> DataFrame:
    candidates = rows.stat.freqItems(["text_sha256"], 1.0 / k).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    winners = common.materialise(
        rows.join(F.broadcast(candidates), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter(F.col("group_size") * k > rows.count()),
        "digest-winners",
    )  # fewer than k rows, by the bound on their counts
    hot = rows.join(F.broadcast(winners), "text_sha256")
    of_text = Window.partitionBy("text_sha256")
    rest = rows.join(F.broadcast(winners), "text_sha256", "left_anti").select(
        "*", F.max("doc_id").over(of_text).alias("keep_id"), F.count(F.lit(1)).over(of_text).alias("group_size")
    )
    return hot.unionByName(rest).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one of each group."""
    digest, key = (common.fresh_name(docs, x) for x in ("digest", "key"))
    id_key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    with common.scope() as made:
        stay = exact_groups(docs).filter("kept").groupBy(id_key.alias(key), F.col("text_sha256").alias(digest)).agg(F.count(F.lit(1)).alias("n"))
        stay = common.materialise(stay, "exact-stay")
    common.free_all(made, stay)
    return common.one_of_each(docs.withColumns({key: id_key, digest: text_digest()}), stay, [key, digest]).select(*docs.columns)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(common.documents(spark, sf_dir))


OP3_SQL = f"""
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}') AS norm FROM documents)
WINDOW w AS (PARTITION BY norm)
"""
