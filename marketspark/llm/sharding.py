"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Rows of equal texts are a group. Groups are gathered, by their hash, into a fixed
number of cells; a group that alone holds more than one part in ``shards * 64`` of
all bytes, tokens or rows (there are at most ``3 * shards * 64`` such) is placed by
itself. The driver sees these only, whatever the size of the corpus. They go in
order of falling size, each into the shard where the dot product with the shard's
residual capacity is highest, among those with room. A group stays whole unless it
is larger than a whole shard, which no placement can keep near equal: such a one is
cut into pieces of an eighth of a shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketspark.llm.common import id_and_text, materialise

GROUP = ["_hash", "_crc", "_size"]


def pack_vectors(loads: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item; ``loads`` has a row per item and a column per quantity.

    An item goes among the shards with room for all its quantities; if there are
    none, among those with room for the first; if none, where most of that is left.
    """
    total = loads.sum(axis=0)
    share = loads / np.where(total > 0, total, 1)
    room = np.full((shards, loads.shape[1]), 1 / shards)
    out = np.zeros(len(loads), np.int32)
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        item = share[i]
        fits = (room >= item - 1e-12).all(axis=1)
        if not fits.any():
            fits = room[:, 0] >= item[0] - 1e-12
        if fits.any():
            best = int(np.argmax(np.where(fits, room @ item, -np.inf)))
        else:
            best = int(np.argmax(room[:, 0]))
        out[i] = best
        room[best] -= item
    return out


def shard_documents(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", items: int | None = None) -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: sizes (UTF-8 bytes of the text plus 16) are near equal,
    with tokens (runs of non-space) and rows balanced as far as that allows. Equal
    texts share a shard, unless they are more than one shard holds. Slots are
    gapless from 0 in each shard. Null text has no bytes. Rows that repeat an
    identifier or text are rows like any other. ``grown_shard`` is null under this
    law. An empty table gives no rows; other columns are not looked at.
    """
    if shards < 1:
        raise ValueError("shards is at least 1")
    spark = df.sparkSession
    items = items or shards * 1024
    text = F.col("_text")
    slim = materialise(
        id_and_text(df, id_col, text_col).select(
            "_id",
            (F.octet_length(text) + 16).cast("long").alias("_size"),
            F.crc32(text.cast("binary")).alias("_crc"),
            F.xxhash64(text).alias("_hash"),
            F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("_tokens"),
        ),
        "sharding",
    )
    loads = [F.sum("_size").alias("bytes"), F.sum("_tokens").alias("tokens"), F.count("*").alias("rows")]
    total = slim.agg(*loads).first()
    cells = shards * 64
    shares = [F.col(n) / F.lit(max(1, total[n] or 0)) for n in ("bytes", "tokens", "rows")]
    heavy = (
        slim.groupBy(*GROUP)
        .agg(*loads)
        .withColumn("_cuts", F.least(F.col("rows"), F.ceil(F.greatest(*shares) * cells)))
        .withColumn("_pieces", F.when(F.greatest(*shares) * shards > 1, F.least(F.col("_cuts"), F.ceil(F.greatest(*shares) * (shards * 8)))).otherwise(F.lit(1)))
        .filter("_cuts > 1")
        .select(*GROUP, "_cuts", "_pieces")
        .collect()
    )
    assert len(heavy) <= 3 * cells
    # whole: cell -> what is placed; an own group is one piece, or several of about an eighth of a shard
    base, table, whole = items, [], {}
    for r in sorted(heavy, key=lambda r: tuple(r)):
        cuts, pieces = int(r["_cuts"]), int(r["_pieces"])
        table.append((r["_hash"], r["_crc"], r["_size"], base, cuts))
        whole |= {base + i: base + i * pieces // cuts * cuts // pieces for i in range(cuts)}
        base += cuts
    heavy_schema = "_hash long, _crc long, _size long, _base int, _cuts int"
    cut = spark.createDataFrame(table, heavy_schema)
    item = F.when(F.col("_base").isNull(), F.pmod(F.xxhash64("_hash", "_crc"), F.lit(items)).cast("int"))
    item = item.otherwise(F.col("_base") + F.pmod(F.xxhash64("_id", F.lit(7)), F.col("_cuts")).cast("int"))
    # at most 3 * shards * 64 rows
    tagged = slim.join(F.broadcast(cut), GROUP, "left").select("_id", "_size", "_crc", "_tokens", item.alias("_item"))

    got = tagged.groupBy("_item").agg(*loads).collect()  # at most items + 9 * shards * 64 rows
    got.sort(key=lambda r: r["_item"])
    loads_of: dict[int, list[int]] = {}
    for r in got:
        sums = loads_of.setdefault(whole.get(r["_item"], r["_item"]), [0, 0, 0])
        for i, n in enumerate(("bytes", "tokens", "rows")):
            sums[i] += r[n]
    where = dict(zip(loads_of, pack_vectors(np.array(list(loads_of.values()), float).reshape(-1, 3), shards).tolist(), strict=True))
    first, plan = [0] * shards, []
    for r in got:
        shard = where[whole.get(r["_item"], r["_item"])]
        plan.append((r["_item"], shard, first[shard]))
        first[shard] += r["rows"]
    plan_schema = T.StructType([T.StructField("_item", T.IntegerType()), T.StructField("_shard", T.IntegerType()), T.StructField("_first", T.LongType())])
    rank = F.row_number().over(Window.partitionBy("_item").orderBy("_id", "_crc", "_size")) - 1
    return (
        tagged.withColumn("_rank", rank)
        .join(F.broadcast(spark.createDataFrame(plan, plan_schema)), "_item")
        .select(
            F.col("_id").alias(id_col),
            F.col("_size").alias("size"),
            F.col("_crc").alias("text_crc32"),
            F.lit("bytes").alias("law"),
            F.col("_shard").alias("shard"),
            (F.col("_first") + F.col("_rank")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
