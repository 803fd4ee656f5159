"""Windows over a key that may hold most of the rows, split by time.

A window over one symbol is one task, however many machines there are. What looks a
bounded number of rows back (or ahead) needs no whole symbol: bars are dealt out by
(symbol, block of time), and each block gets the last rows of the blocks before it
as guests, who are dropped when the windows are done. Recurrences (exponential
means, Wilder's averages) forget: what is ``memory`` rows back is below the last
digit of a double. What has no bound (running sums, extremes, the first or last
value there was) is worked out within blocks, and what stood before a block comes
from one row per block.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.functions.scan import block_length


def memory(*spans: int, wilder: tuple[int, ...] = ()) -> int:
    """Rows after which exponential means of these spans, and chained Wilder's averages of these periods, have forgotten."""
    means = max((block_length(1 - 2 / (s + 1)) for s in spans), default=0)
    return max(means, sum(block_length((p - 1) / p) + p for p in wilder))


def _guests(laid: DataFrame, key: str, order: str, rows: int, ahead: bool) -> DataFrame:
    """The rows that blocks borrow: the last (or first) ones of blocks before (or behind), with ``__t``, the block that borrows them."""
    counts = laid.groupBy(key, "__b").agg(F.count("*").alias("__n"))
    along = Window.partitionBy(key).orderBy(F.desc("__b") if ahead else F.asc("__b"))  # a row per block
    counts = counts.withColumns({"__c": F.sum("__n").over(along) - F.col("__n"), "__s": F.lag("__b").over(along)})
    # of block u with c rows before it, the block before u is borrowed from by all t with fewer than `rows` rows between
    near = Window.partitionBy(key).orderBy("__c").rangeBetween(-(rows - 1), 0)
    lent = counts.withColumn("__from", F.collect_list(F.struct("__s", "__c")).over(near))
    lent = lent.select(F.col(key).alias("__k"), F.col("__b").alias("__t"), F.col("__c").alias("__ct"), F.explode("__from").alias("__f"))
    lent = lent.filter("__f.__s is not null").select("__k", "__t", F.col("__f.__s").alias("__s"), (rows - (F.col("__ct") - F.col("__f.__c"))).alias("__need"))
    place = F.row_number().over(Window.partitionBy(key, "__b").orderBy(F.asc(order) if ahead else F.desc(order)))
    ranked = laid.withColumn("__i", place).filter(F.col("__i") <= rows)
    met = (ranked[key] == lent["__k"]) & (ranked["__b"] == lent["__s"]) & (ranked["__i"] <= lent["__need"])
    return ranked.join(lent, met).select(*[ranked[c] for c in laid.columns], "__t")


def over_blocks(df: DataFrame, compute: Callable[[DataFrame], DataFrame], seconds: int, before: int = 0, after: int = 0, key: str = "symbol", order: str = "timestamp") -> DataFrame:
    """``compute(df)``, whose windows hash on ``key``, look ``before`` rows back and ``after`` ahead at most, and keep all columns.

    The windows run on (key, block of ``seconds``). A key's order has no ties. The
    columns that ``compute`` adds are those it would add without blocks; null keys are
    one key; an empty table gives no rows.
    """
    width = seconds * 1_000_000
    laid = df.withColumn("__b", F.floor(F.unix_micros(F.col(order).cast("timestamp")) / width))
    rows = laid.withColumns({"__t": F.col("__b"), "__guest": F.lit(False)})
    if before:
        rows = rows.unionByName(_guests(laid, key, order, before, False).withColumn("__guest", F.lit(True)))
    if after:
        rows = rows.unionByName(_guests(laid, key, order, after, True).withColumn("__guest", F.lit(True)))
    rows = rows.withColumn("__own", F.col(key)).withColumn(key, F.concat_ws("|", F.col("__t").cast("string"), F.col(key).cast("string")))
    done = compute(rows.drop("__b", "__t"))
    return done.filter("not __guest").withColumn(key, F.col("__own")).drop("__own", "__guest")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    seconds: int,
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    firsts: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Adds, by name, what a key's rows up to each one come to: a sum, the largest, the first and the last value that isn't null.

    ``order`` begins with a time and has no ties. Rows are dealt out by (keys, block
    of ``seconds``); only one row per block is gathered by key. Null values don't
    count; a sum of none is 0. An empty table gives no rows.
    """
    kinds = {"s": dict(sums or {}), "m": dict(maxima or {}), "f": dict(firsts or {}), "l": dict(lasts or {})}
    values = {f"__{kind}_{n}": c for kind, named in kinds.items() for n, c in named.items()}
    width = seconds * 1_000_000
    laid = df.withColumns(values | {"__b": F.floor(F.unix_micros(F.col(order[0]).cast("timestamp")) / width), "__at": F.struct(*order)})
    here = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = {"s": lambda v: F.sum(v).over(here), "m": lambda v: F.max(v).over(here), "f": lambda v: F.first(v, ignorenulls=True).over(here), "l": lambda v: F.last(v, ignorenulls=True).over(here)}
    at = lambda v: F.when(F.col(v).isNotNull(), F.col("__at"))
    whole = {"s": F.sum, "m": F.max, "f": lambda v: F.min_by(F.col(v), at(v)), "l": lambda v: F.max_by(F.col(v), at(v))}
    earlier = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    carried = {"s": lambda v: F.sum(v).over(earlier), "m": lambda v: F.max(v).over(earlier), "f": lambda v: F.first(v, ignorenulls=True).over(earlier), "l": lambda v: F.last(v, ignorenulls=True).over(earlier)}
    names = [(kind, f"__{kind}_{n}", n) for kind, named in kinds.items() for n in named]
    blocks = laid.groupBy(*keys, "__b").agg(*[whole[kind](v).alias(v) for kind, v, _ in names])
    before = blocks.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__b").alias("__kb"), *[carried[kind](v).alias(f"__before{v}") for kind, v, _ in names])
    inside = laid.withColumns({f"__in{v}": within[kind](v) for kind, v, _ in names})
    met = F.col("__b") == F.col("__kb")
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    both = inside.join(before, met, "left")
    zero = F.lit(0)
    join = {
        "s": lambda a, b: F.coalesce(a, zero) + F.coalesce(b, zero),
        "m": F.greatest,
        "f": lambda a, b: F.coalesce(a, b),
        "l": lambda a, b: F.coalesce(b, a),
    }
    added = [join[kind](F.col(f"__before{v}"), F.col(f"__in{v}")).alias(n) for kind, v, n in names]
    made = {n for _, _, n in names}
    return both.select(*[F.col(f"`{c}`") for c in df.columns if c not in made], *added)
