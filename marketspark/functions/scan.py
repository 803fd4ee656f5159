"""Linear recurrences by built-in windows: y[t] = a * y[t-1] + u[t].

A key's rows are cut into blocks so long that what was before the previous block
no longer matters (a ** block < 1e-17). Within a block the recurrence is a running
sum of inputs scaled by powers of a; from one block to the next only the last
value is carried. Any number of recurrences over one order share their windows:
one shuffle by the key, two sorts, no Python, no loop over rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Powers of a beyond exp(650) would leave the range of doubles.
FARTHEST = 650


def block_length(a: float) -> int:
    return max(2, math.ceil(40 / -math.log(a)))


def affine_scan(df: DataFrame, keys: Sequence[str], order: str, inputs: dict[str, tuple[Column, Column, float]]) -> DataFrame:
    """Adds a column per input: name -> (u, live, a).

    ``u`` is 0 before a recurrence starts, at its start the first value, and the
    scaled input after; the result is NULL where ``live`` isn't true. ``df`` has the
    row's number within its key in ``__rn``.
    """
    size = max(block_length(a) for _, _, a in inputs.values())
    if size * -math.log(min(a for _, _, a in inputs.values())) > FARTHEST:
        for name, spec in inputs.items():
            df = affine_scan(df, keys, order, {name: spec}) if len(inputs) > 1 else df
        if len(inputs) > 1:
            return df
        raise ValueError("the recurrence forgets too fast for a block")
    row = Window.partitionBy(*keys).orderBy(order)
    block = Window.partitionBy(*keys, "__b").orderBy(order)
    k = F.col("__k")
    out = df.withColumns({"__b": F.floor((F.col("__rn") - 1) / size), "__k": ((F.col("__rn") - 1) % size).cast("double")})
    out = out.withColumns({f"__u_{n}": u * F.pow(F.lit(a), -k) for n, (u, _, a) in inputs.items()} | {f"__l_{n}": live for n, (_, live, _) in inputs.items()})
    out = out.withColumns({f"__s_{n}": F.sum(f"__u_{n}").over(block) for n in inputs})
    out = out.withColumns({f"__s_{n}": F.col(f"__s_{n}") * F.pow(F.lit(a), k) for n, (_, _, a) in inputs.items()})
    ends = {f"__c_{n}": F.last(F.when(k == size - 1, F.col(f"__s_{n}")), ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, -1)) for n in inputs}
    out = out.withColumns(ends)
    out = out.withColumns({n: F.when(F.col(f"__l_{n}"), F.col(f"__s_{n}") + F.coalesce(f"__c_{n}", F.lit(0.0)) * F.pow(F.lit(a), k + 1)) for n, (_, _, a) in inputs.items()})
    return out.drop("__b", "__k", *[f"__{s}_{n}" for n in inputs for s in "ulsc"])


def smooth(df: DataFrame, keys: Sequence[str], order: str, emas: dict[str, tuple[str, int, int]] | None = None, wilders: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """Adds exponential means, name -> (column, span, least count), and Wilder's averages, name -> (column, period).

    An exponential mean is seeded by the first value; its inputs hold no NULL (bars
    don't). Wilder's average is NULL until ``period`` values are there, seeded by
    their mean, and NULL for good after a NULL that follows the seed.
    """
    emas, wilders = emas or {}, wilders or {}
    row = Window.partitionBy(*keys).orderBy(order)
    rn = F.col("__rn")
    counted = {"__rn": F.row_number().over(row)}
    for name, (column, _) in wilders.items():
        counted |= {f"__n_{name}": F.count(column).over(row), f"__m_{name}": F.avg(column).over(row)}
    out = df.withColumns(counted)
    if wilders:
        out = out.withColumns({f"__r_{n}": F.sum(F.when(F.col(f"__n_{n}") >= p, 1)).over(row) for n, (_, p) in wilders.items()})
    inputs = {}
    for name, (column, span, least) in emas.items():
        alpha = 2 / (span + 1)
        inputs[name] = (F.when(rn == 1, F.col(column)).otherwise(alpha * F.col(column)), rn >= least, 1 - alpha)
    for name, (column, period) in wilders.items():
        run = F.col(f"__r_{name}")
        u = F.when(run.isNull(), 0.0).when(run == 1, F.col(f"__m_{name}")).otherwise(F.coalesce(F.col(column) / period, F.lit(0.0)))
        inputs[name] = (u, run.isNotNull(), (period - 1) / period)
    out = affine_scan(out, keys, order, inputs)
    if wilders:
        out = out.withColumns({f"__x_{n}": F.max(F.when((F.col(f"__r_{n}") > 1) & F.col(c).isNull(), 1)).over(row) for n, (c, _) in wilders.items()})
        out = out.withColumns({n: F.when(F.col(f"__x_{n}").isNull(), F.col(n)) for n in wilders})
    return out.drop("__rn", *[f"__{s}_{n}" for n in wilders for s in "nmrx"])


def ema(df: DataFrame, keys: Sequence[str], order: str, columns: dict[str, tuple[str, int, int]]) -> DataFrame:
    return smooth(df, keys, order, emas=columns)


def wilder(df: DataFrame, keys: Sequence[str], order: str, columns: dict[str, str], period: int) -> DataFrame:
    return smooth(df, keys, order, wilders={n: (c, period) for n, c in columns.items()})
