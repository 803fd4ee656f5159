"""Exact deduplication by a tree-merge of sorted digest runs, in SQL functions only.

Every input partition is a run: its texts' digests in order, each once, with the
identifier that stays and a count. Runs then meet in binomial rounds: in round k
the runs whose numbers agree but for their lowest ``k * fan_in_bits`` bits are
exchanged, their sorted entries are merged, and the first entry of each digest, that
of the extreme identifier, stays with the sum of the counts; until one run is left.
A round deals its runs out by (run, digest), so a task merges a part of every run
in the order of digests and never holds a run. A digest with a third of all rows is
one entry in each run after the first, map-side, count, so ``2**fan_in_bits``
entries of it meet at most.

"Verified": a digest alone doesn't decide. SHA-256, the length in bytes and a
second, independent 64-bit hash must all agree, at every level.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketspark.llm.common import column_of, free_name, id_and_text, materialise

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEYS = ["_sha", "_bytes", "_check"]


def normalised(text):
    """Lower-cases A-Z only; every other character stays."""
    return F.translate(text, UPPER, UPPER.lower())


def digest_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _sha, _bytes, _check, _run) of every row; _run is the number of its partition."""
    text = normalised(F.col("_text"))
    return (
        id_and_text(df, id_col, text_col)
        .select("_id", text.alias("_norm"))
        .select(
            "_id",
            F.unhex(F.sha2("_norm", 256)).alias("_sha"),
            F.octet_length("_norm").alias("_bytes"),
            F.xxhash64("_norm").alias("_check"),
            F.spark_partition_id().alias("_run"),
        )
    )


def tree_merge(runs: DataFrame, n_runs: int, keep: str = "smallest", fan_in_bits: int = 3) -> DataFrame:
    """Merges the runs round by round; (_sha, _bytes, _check, _keep, _n) of each distinct text.

    ``keep``: "smallest" or "largest" identifier of equal texts. ``2**fan_in_bits``
    runs meet in a round, so the rounds are log(n_runs) to that base.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    best, last = (F.min, False) if keep == "smallest" else (F.max, True)
    level = runs.groupBy("_run", *KEYS).agg(best("_id").alias("_keep"), F.count("*").alias("_n"))
    rounds = max(1, math.ceil(math.log2(max(2, n_runs)) / fan_in_bits))
    for _ in range(rounds):
        # sorted by (run, digest, identifier), nulls behind all others: the first entry of a digest is the one that stays
        entries = Window.partitionBy("_run", *KEYS).orderBy(F.desc_nulls_last("_keep") if last else F.asc_nulls_last("_keep"))
        all_ = entries.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        merged = level.withColumn("_run", F.shiftright("_run", fan_in_bits))
        merged = merged.withColumns({"_place": F.row_number().over(entries), "_all": F.sum("_n").over(all_)})
        level = merged.filter("_place = 1").select("_run", *KEYS, "_keep", F.col("_all").alias("_n"))
    return level.select(*KEYS, "_keep", "_n")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan_in_bits: int = 3) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null text counts as the empty text, and equal empty texts are one group. Rows
    that repeat an identifier with the same text count in group_size and share one
    verdict: all of them are the document that stays, or none. Null identifiers
    never win over others; a group that has no other keeps null and kept is true
    for it. An empty table gives no rows. Other columns are not looked at.
    """
    runs = materialise(digest_runs(df, id_col, text_col), "digests")
    top = runs.agg(F.max("_run")).first()[0]
    merged = tree_merge(runs, (top or 0) + 1, keep, fan_in_bits)
    return runs.join(merged, KEYS).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns, and one row per distinct text.

    Null text counts as the empty text. Of rows that repeat the staying identifier
    and its text, one stays; a text that only rows without an identifier hold keeps
    one of these. An empty table gives no rows.
    """
    runs = materialise(digest_runs(df, id_col, text_col), "digests")
    top = runs.agg(F.max("_run")).first()[0]
    stay = tree_merge(runs, (top or 0) + 1, keep)
    sha, key = free_name(df, "_row_sha"), free_name(df, "_row_id")
    norm = normalised(F.coalesce(column_of(df, text_col).cast("string"), F.lit("")))
    tagged = df.withColumns({sha: F.unhex(F.sha2(norm, 256)), key: column_of(df, id_col).cast("long")})
    right = stay.select(F.col("_sha").alias("_s"), F.col("_keep").alias("_k"))
    kept = tagged.join(right, (F.col(sha) == F.col("_s")) & F.col(key).eqNullSafe(F.col("_k")), "left_semi")
    # a repeated (identifier, text) row: few, and found without a window over texts
    copies = runs.groupBy("_id", "_sha").count().filter("count > 1")
    if copies.isEmpty():
        return kept.drop(sha, key)
    return kept.dropDuplicates([sha, key]).drop(sha, key)
