"""Quality classifier: a sparse ensemble of rules over statistics of a text.

Small trees are boosted on a bounded sample of labelled rows. Each path of a tree
from the root to a node is a conjunctive rule. Logistic regression with an L1
penalty picks and weighs the rules, and what is left compiles into one Spark column
expression over the statistics.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import column_of, free_name, id_and_text, small

STATS = [
    "log_bytes",
    "log_words",
    "word_bytes",
    "upper",
    "digits",
    "symbols",
    "bangs",
    "bars",
    "stops",
    "spaces",
    "non_ascii",
    "distinct_words",
    "repeats",
    "top_word",
    "distinct_lines",
    "line_words",
    "end_symbols",
    "upper_lines",
    "worst_line",
    "one_letter",
]
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_SYMBOLS = b"#$%&*@^~_=+<>{}[]\\/"
_HIGH = bytes(range(128, 256))
_END_SYMBOLS = re.compile(r"[#$%&*@^~_=+<>|!]{2,}(?=\s|$)")


def statistics(text: str) -> tuple[float, ...]:
    """The numbers of STATS for a whole text; all 0 where there is nothing to count."""
    data = text.encode("utf-8", "replace")
    size = len(data)
    if not size:
        return (0.0,) * len(STATS)
    words = text.split()
    n = len(words) or 1
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    left = lambda drop: size - len(data.translate(None, drop))
    upper = left(_UPPER)
    symbols = left(_SYMBOLS)
    bangs, bars = data.count(b"!"), data.count(b"|")
    repeats = sum(map(str.__eq__, words, words[1:]))
    upper_lines, worst = 0, 0.0
    if upper:
        upper_lines = sum(len(x) for x in lines if x.isupper())
    if symbols + bangs + bars:
        for line in lines:
            if len(line) >= 20:
                worst = max(worst, sum(line.count(c) for c in "#$%&*!|") / len(line))
    return (
        math.log1p(size),
        math.log1p(len(words)),
        size / n,
        upper / size,
        left(_DIGITS) / size,
        symbols / size,
        bangs / size,
        bars / size,
        data.count(b".") / n,
        (data.count(b" ") + data.count(b"\n")) / size,
        left(_HIGH) / size,
        len(counts) / n,
        repeats / n,
        max(counts.values(), default=0) / n,
        len(set(lines)) / (len(lines) or 1),
        n / (len(lines) or 1),
        len(_END_SYMBOLS.findall(text)) / n,
        upper_lines / len(text),
        worst,
        sum(len(w) == 1 for w in words) / n,
    )


def _stats_batch(texts: Iterable[str | None]) -> list[pa.Array]:
    rows = [statistics(t or "") for t in texts]
    return [pa.array([r[i] for r in rows], pa.float64()) for i in range(len(STATS))]


def statistics_column(text: Column) -> Column:
    """A struct of STATS. Null text is the empty text."""

    @F.arrow_udf("struct<" + ",".join(f"{n}:double" for n in STATS) + ">")
    def stats(texts: pa.Array) -> pa.Array:
        parts = [pa.StructArray.from_arrays(_stats_batch(part.column(0).to_pylist()), names=STATS) for part in small([pa.RecordBatch.from_arrays([texts], names=["t"])])]
        return pa.concat_arrays(parts) if parts else pa.StructArray.from_arrays(_stats_batch([]), names=STATS)

    return stats.asNondeterministic()(text)


def statistics_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, STATS...) per row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), *_stats_batch(batch.column(1).to_pylist())], names=["_id", *STATS])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "_id long, " + ", ".join(f"{n} double" for n in STATS))


@dataclass(frozen=True)
class Rule:
    """Holds where every condition (statistic, is it above, threshold) does."""

    conditions: tuple[tuple[int, bool, float], ...]

    def on(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, above, at in self.conditions:
            out &= (x[:, k] > at) == above
        return out

    def column(self, stat) -> Column:
        out = None
        for k, above, at in self.conditions:
            c = stat(STATS[k]) > F.lit(at) if above else stat(STATS[k]) <= F.lit(at)
            out = c if out is None else out & c
        return out

    def __str__(self) -> str:
        return " and ".join(f"{STATS[k]} {'>' if above else '<='} {at:.6g}" for k, above, at in self.conditions)


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def column(self, stat) -> Column:
        """The score as one expression; ``stat(name)`` gives a statistic's column."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total = total + F.when(rule.column(stat), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total += weight * rule.on(x)
        return 1 / (1 + np.exp(-total))


def boosted_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, bins: int = 48, rate: float = 0.3, least: int = 5) -> list[Rule]:
    """The paths of boosted regression trees on the logistic loss, each once, in the order found."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    margin, found = np.zeros(len(y)), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        step = np.zeros(len(y))

        def grow(rows: np.ndarray, path: tuple, level: int, grad=grad, hess=hess, step=step) -> None:
            if path:
                found.setdefault(path, None)
            g, h = grad[rows], hess[rows]
            best = (1e-6, None, None)
            if level < depth and len(rows) >= 2 * least:
                base = g.sum() ** 2 / (h.sum() + 1)
                for k, edge in enumerate(edges):
                    if not len(edge):
                        continue
                    c = codes[rows, k]
                    gs, hs, ns = (np.bincount(c, w, len(edge) + 1).cumsum() for w in (g, h, np.ones(len(rows))))
                    gl, hl, nl = gs[:-1], hs[:-1], ns[:-1]
                    gain = gl**2 / (hl + 1) + (gs[-1] - gl) ** 2 / (hs[-1] - hl + 1) - base
                    gain[(nl < least) | (ns[-1] - nl < least)] = 0
                    i = int(np.argmax(gain))
                    if gain[i] > best[0]:
                        best = (gain[i], k, i)
            if best[1] is None:
                step[rows] = rate * g.sum() / (h.sum() + 1)
                return
            _, k, i = best
            low = codes[rows, k] <= i
            at = float(edges[k][i])
            grow(rows[low], (*path, (k, False, at)), level + 1)
            grow(rows[~low], (*path, (k, True, at)), level + 1)

        grow(np.arange(len(y)), (), 0)
        margin += step
        if np.abs(y - 1 / (1 + np.exp(-margin))).max() < 0.02:
            break
    return [Rule(path) for path in found]


def lasso_logistic(on: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias, by accelerated proximal gradient steps; the bias is not penalised."""
    n, m = on.shape
    a = np.hstack([on.astype(float), np.ones((n, 1))])
    # a bound of the largest curvature, by power iteration
    v = np.ones(m + 1) / math.sqrt(m + 1)
    for _ in range(20):
        v = a.T @ (a @ v)
        size = np.linalg.norm(v) or 1.0
        v /= size
    pace = 4 * n / (1.05 * size)
    w = z = np.zeros(m + 1)
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ z, -40, 40)))
        new = z - pace * (a.T @ (p - y)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - pace * penalty, 0)
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w[:-1], float(w[-1])


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 0.0005) -> RuleModel:
    """A model of labels ``y`` (0 or 1); every path of every tree is a rule that the lasso may take.

    Without both labels: their mean for every text, 0.5 without any.
    """
    if len(y) == 0 or y.min() == y.max():
        mean = (y.sum() + 0.5) / (len(y) + 1)
        return RuleModel((), (), float(math.log(mean / (1 - mean))))
    rules = boosted_rules(x, y, trees, depth)
    on = np.stack([r.on(x) for r in rules], axis=1) if rules else np.zeros((len(y), 0), bool)
    _, first = np.unique(on, axis=1, return_index=True)  # of rules that hold on the same rows, one
    rules, on = [rules[i] for i in sorted(first)], on[:, sorted(first)]
    weights, bias = lasso_logistic(on, y, penalty)
    held = [i for i in range(len(rules)) if weights[i]]
    return RuleModel(tuple(rules[i] for i in held), tuple(float(weights[i]) for i in held), bias)


def labelled(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(_id, _y) of the rows that may be learnt from: crc32 of the id as text, mod 4, isn't 2; one per id."""
    rows = labels.select(column_of(labels, id_col).cast("long").alias("_id"), column_of(labels, label_col).cast("double").alias("_y"))
    rows = rows.filter("_id is not null and _y in (0, 1)").filter(~held_out(F.col("_id")))
    return rows.groupBy("_id").agg(F.max("_y").alias("_y"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 12_000, **options) -> RuleModel:
    """Fits the rules on at most ``most_rows`` labelled documents, those with the smallest hashes of their ids.

    Rows of ``labels`` without an id or with a label that isn't 0 or 1 don't count; of an
    id with both labels, 1 counts. Null text is the empty text; of rows that repeat an
    id with different texts, the one with the least statistics, compared in order of
    STATS, counts, so the model is the same at every run. Without labelled documents
    the model gives 0.5 for every text. Other columns are not looked at.
    """
    sample = labelled(labels, id_col, label_col).orderBy(F.xxhash64("_id"), "_id").limit(most_rows).collect()
    spark = df.sparkSession
    chosen = spark.createDataFrame([(r["_id"], r["_y"]) for r in sample], "_key long, _y double")
    texts = id_and_text(df, id_col, text_col).join(F.broadcast(chosen), F.col("_id") == F.col("_key"))  # most_rows rows
    stats = statistics_rows(texts.select("_id", "_text"), "_id", "_text").groupBy("_id").agg(F.min(F.struct(*STATS)).alias("s")).select("_id", "s.*").collect()
    y_of = {r["_id"]: r["_y"] for r in sample}
    stats.sort(key=lambda r: r["_id"])
    x = np.array([[r[n] for n in STATS] for r in stats], float).reshape(-1, len(STATS))
    y = np.array([y_of[r["_id"]] for r in stats], float)
    return fit_rules(x, y, **options)


def score_documents(df: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Per row: id, held_out, score, predicted.

    Null text is the empty text, which has a score too. Rows that repeat an
    identifier are scored each; a null identifier is not held out. An empty table
    gives no rows; other columns are not looked at.
    """
    stats = statistics_rows(df, id_col, text_col)
    score = model.column(F.col)
    return stats.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(df: DataFrame, model: RuleModel, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``df`` whose text scores at least ``threshold``, with all their columns.

    Null text is the empty text and is judged by its score like any other; rows that
    repeat an identifier, and rows without one, are judged each. An empty table gives no
    rows. A column that is called like the one made here meanwhile stays as it is.
    """
    stats = free_name(df, "_stats")
    scored = df.withColumn(stats, statistics_column(column_of(df, text_col).cast("string")))
    return scored.filter(model.column(lambda n: F.col(f"{stats}.{n}")) >= threshold).drop(stats)
