"""Orders: legal transitions, brackets, reconciliation, external records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.functions.text import order_id

#: Statuses an order may go to from each status.
TRANSITIONS = {
    "created": ("validated", "rejected"),
    "validated": ("submitted", "rejected"),
    "submitted": ("acknowledged", "rejected", "unknown"),
    "acknowledged": ("partially_filled", "filled", "cancel_requested", "canceled", "expired", "unknown"),
    "partially_filled": ("partially_filled", "filled", "cancel_requested", "canceled", "expired", "unknown"),
    "cancel_requested": ("canceled", "partially_filled", "filled", "unknown"),
    "unknown": ("acknowledged", "partially_filled", "filled", "canceled", "rejected"),
    "filled": (),
    "canceled": (),
    "rejected": (),
    "expired": (),
}


def legal_transition(old: Column | str, new: Column | str) -> Column:
    """False for statuses that aren't known."""
    old, new = (F.col(x) if isinstance(x, str) else x for x in (old, new))
    table = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]).cast("array<string>"))])
    return F.coalesce(F.array_contains(F.try_element_at(table, old), new), F.lit(False))


def first_illegal(events: DataFrame, key: str = "order_id", order: str = "sequence") -> DataFrame:
    """Per order, its first illegal step."""
    from pyspark.sql import Window

    before = F.lag("status", 1, "created").over(Window.partitionBy(key).orderBy(order))
    bad = events.withColumn("previous", before).filter(~legal_transition("previous", "status"))
    return bad.groupBy(key).agg(F.min_by(F.struct(order, "previous", "status"), order).alias("r")).select(key, "r.*")


def brackets(signals: DataFrame) -> DataFrame:
    """Three orders per entry signal: entry, protective stop, target."""
    side = F.when(F.col("is_buy"), "buy").otherwise("sell")
    other = F.when(F.col("is_buy"), "sell").otherwise("buy")
    none = F.lit(None).cast("double")

    def leg(purpose, leg_side, kind, limit, stop, reduce):
        return F.struct(
            F.lit(purpose).alias("purpose"), leg_side.alias("side"), F.lit(kind).alias("order_type"), limit.alias("limit_price"), stop.alias("stop_price"),
            F.lit(reduce).alias("reduce_only"), F.lit(purpose == "stop").alias("protective"),
        )

    legs = F.array(leg("entry", side, "market", none, none, False), leg("stop", other, "stop", none, F.col("stop"), True), leg("target", other, "limit", F.col("target"), none, True))
    out = signals.withColumn("leg", F.explode(legs)).select(*signals.columns, "leg.*")
    return out.withColumn("client_order_id", order_id("symbol", "action", "iso_time", "correlation_id", "purpose"))


def flattened(orders: DataFrame, legs: str = "legs") -> DataFrame:
    """Each order and its nested legs as rows."""
    own = F.struct(*[F.col(c) for c in orders.columns if c != legs])
    return orders.select(F.explode(F.concat(F.array(own), F.coalesce(F.col(legs), F.array().cast(orders.schema[legs].dataType)))).alias("o")).select("o.*")


def reconcile(ours: DataFrame, theirs: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, state, differing): matched, changed, missing (only ours), unexpected (only theirs)."""
    a = ours.select(key, F.struct(*fields).alias("a"))
    b = theirs.select(key, F.struct(*fields).alias("b"))
    j = a.join(b, key, "full_outer")
    differing = F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]))
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unexpected").when(F.size(differing) > 0, "changed").otherwise("matched")
    return j.select(key, state.alias("state"), F.when(state == "changed", differing).otherwise(F.array().cast("array<string>")).alias("differing"))


def protected(positions: DataFrame, orders: DataFrame) -> DataFrame:
    """Positions with ``has_stop``: an open protective order on the other side for at least their quantity."""
    live = orders.filter(F.col("protective") & F.col("status").isin("acknowledged", "partially_filled"))
    stops = live.select("symbol", F.when(F.col("side") == "buy", "sell").otherwise("buy").alias("side"), (F.col("quantity") - F.col("filled_quantity")).alias("_left"))
    most = stops.groupBy("symbol", "side").agg(F.max("_left").alias("_left"))
    return positions.join(most, ["symbol", "side"], "left").withColumn("has_stop", F.coalesce(F.col("_left") >= F.col("quantity"), F.lit(False))).drop("_left")


#: External order statuses as ours.
STATUS = {"new": "acknowledged", "accepted": "acknowledged", "pending_new": "submitted", "partially_filled": "partially_filled", "filled": "filled", "pending_cancel": "cancel_requested", "canceled": "canceled", "expired": "expired", "rejected": "rejected"}


def from_external(orders: DataFrame) -> DataFrame:
    """External orders as ours: sides, absolute quantities, known statuses, received not before exchange.

    A status that isn't known is ``unknown``; a side that isn't known is an error.
    """
    strange = F.raise_error(F.concat(F.lit("not a side: "), F.coalesce("side", F.lit("null")))).cast("string")
    table = F.create_map(*[F.lit(x) for p in STATUS.items() for x in p])
    return orders.withColumns(
        {
            "side": F.when(F.lower("side").isin("buy", "long"), "buy").when(F.lower("side").isin("sell", "short"), "sell").otherwise(strange),
            "quantity": F.abs("quantity"),
            "status": F.coalesce(F.try_element_at(table, F.lower("status")), F.lit("unknown")),
            "received_timestamp": F.greatest("timestamp", "received_timestamp"),
        }
    )


def signals_of(decisions: DataFrame) -> DataFrame:
    """Decisions that act, as signals."""
    table = F.create_map(*[F.lit(x) for p in (("enter_long", "enter_long"), ("enter_short", "enter_short"), ("exit", "exit"), ("reduce", "reduce")) for x in p])
    return decisions.withColumn("signal", F.try_element_at(table, F.col("action"))).filter("signal is not null")
