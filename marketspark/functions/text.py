"""Identifiers, tolerant JSON access, URLs, order books and reason codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketspark.functions.price import Num, c


def order_id(instrument: Num, action: Num, iso_time: Num, correlation: Num, purpose: Num) -> Column:
    text = F.concat_ws(":", c(instrument), c(action), c(iso_time), c(correlation), c(purpose))
    return F.concat(F.lit("arb-"), F.substring(F.sha2(text, 256), 1, 24))


def review_id(policy: Num, symbol: Num, iso_time: Num, strategy: Num) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", c(policy), c(symbol), c(iso_time), c(strategy)), 256), 1, 24)


def iso_utc(ts: Num) -> Column:
    """2024-01-02T03:04:05+00:00, with six digits after the second where there are any."""
    t = c(ts)
    micros = F.date_format(t, "SSSSSS")
    base = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(base, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("+00:00"))


def json_field(json: Num, names: Sequence[str], default: Num | None = None) -> Column:
    """The first of several names a field goes by; malformed JSON gives the default."""
    out = F.coalesce(*[F.get_json_object(c(json), f"$.{n}") for n in names])
    return out if default is None else F.coalesce(out, c(default))


def json_number(json: Num, names: Sequence[str], default: float | None = None) -> Column:
    """As a number that isn't negative; else the default."""
    v = json_field(json, names).try_cast("double")
    v = F.when(v >= 0, v)
    return v if default is None else F.coalesce(v, F.lit(default))


def host_allowed(url: Num, domains: Sequence[str]) -> Column:
    """The host is one of the domains or below one."""
    host = F.lower(F.try_parse_url(c(url), F.lit("HOST")))
    fits = [(host == d.lower()) | host.endswith("." + d.lower()) for d in domains]
    out = F.lit(False)
    for f in fits:
        out = out | f
    return F.coalesce(out, F.lit(False))


def book_levels(pairs: Num) -> Column:
    """array<array<string>> of [price, quantity] to array<struct<price, quantity>>; bad levels go."""
    parsed = F.transform(c(pairs), lambda p: F.struct(p[0].try_cast("double").alias("price"), p[1].try_cast("double").alias("quantity")))
    return F.filter(parsed, lambda x: (x["price"] > 0) & (x["quantity"] >= 0))


def best(levels: Num) -> Column:
    return F.try_element_at(c(levels), F.lit(1))["price"]


def depth_near_mid(bids: Num, asks: Num, fraction: float = 0.005) -> Column:
    """Sum of price * quantity of the levels within that fraction of the middle."""
    mid = (best(bids) + best(asks)) / 2

    def total(levels, near):
        kept = F.filter(c(levels), near)
        return F.aggregate(kept, F.lit(0.0), lambda s, x: s + x["price"] * x["quantity"])

    return total(bids, lambda x: x["price"] >= mid * (1 - fraction)) + total(asks, lambda x: x["price"] <= mid * (1 + fraction))


def reasons(*pairs: tuple[Column, str]) -> Column:
    """The codes whose condition holds, in order; an unknown condition doesn't hold."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in pairs]))


def first_reason(*pairs: tuple[Column, str], otherwise: str | None = None) -> Column:
    """The code of the first condition that holds."""
    out = None
    for cond, code in pairs:
        out = F.when(cond, code) if out is None else out.when(cond, code)
    return out.otherwise(F.lit(otherwise))


#: Parts of a setting's name that make it a secret.
SECRET_WORDS = ("KEY", "SECRET", "PASSPHRASE", "ACCOUNT")


def redacted(settings: Num) -> Column:
    """A map with the values of secrets replaced."""
    pattern = "|".join(SECRET_WORDS)
    return F.transform_values(c(settings), lambda k, v: F.when(k.rlike(pattern), "***").otherwise(v))


def json_safe(df, column: str) -> Column:
    """A column as JSON: NaN and infinities are null at any depth, missing fields are told as null."""

    def safe(x: Column, kind) -> Column:
        name = kind.typeName()
        if name in ("double", "float"):
            return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
        if name == "struct":
            fields = F.struct(*[safe(x[f.name], f.dataType).alias(f.name) for f in kind.fields])
            return F.when(x.isNotNull(), fields)
        if name == "array":
            return F.transform(x, lambda v: safe(v, kind.elementType))
        if name == "map":
            return F.transform_values(x, lambda _, v: safe(v, kind.valueType))
        return x

    return F.to_json(safe(F.col(column), df.schema[column].dataType), {"ignoreNullFields": "false"})


def is_subset(a: Num, b: Num) -> Column:
    return F.size(F.array_except(c(a), c(b))) == 0


def title(text: Num) -> Column:
    return F.initcap(F.replace(c(text), F.lit("_"), F.lit(" ")))


def base_symbol(symbol: Num, quote: str = "USDT") -> Column:
    upper = F.upper(c(symbol))
    return F.when(upper.endswith(quote), F.regexp_replace(upper, f"{quote}$", "")).otherwise(upper)
