"""Chat formatting by quotation linking.

A message's lines are parsed into quote levels (``>``, ``> >``, ``>>``). What stands
at level 0 is its own text; each run of quoted lines of one level is a passage.
Passages and own texts are both cut into units: the whole, its paragraphs, its
lines, its sentences, and runs of 1, 2, 3, 4, 6, 8, 12 ... consecutive units of a
kind. A unit, normalised and hashed, is looked up among the units of earlier
messages' own texts. A passage comes from the message that its longest unit found
stands in, the latest of several; the message replies to the latest message that
one of its shallowest linked passages comes from. An excerpt that holds no whole
line and no whole sentence of the original is not found. Conversations are then put
in reply order, without quotes and without the lines that introduce them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketspark.llm.common import column_of, drop_tables, materialise, small

MARK = re.compile(r"^\s{0,3}((?:>\s?)+)")
#: Ends of a line that introduces a quote, in the corpus's four languages.
INTRODUCES = re.compile(r"(wrote|writes|schrieb|a écrit|escribió)\s*:\s*$", re.I)
PARAGRAPH = re.compile(r"\n\s*\n")
#: The end of a sentence with its closing marks, and the space behind it.
SENTENCE = re.compile(r"([.!?…][\"'”’»)\]]*)\s+")


def quote_level(line: str) -> tuple[int, str]:
    """(level, the line without its marks)."""
    found = MARK.match(line)
    return (found[1].count(">"), line[found.end() :]) if found else (0, line)


def normalise(passage: str) -> str:
    return " ".join(passage.split()).lower()


def passage_hash(passage: str) -> str | None:
    """Of the normalised passage; None for one without a letter or digit."""
    plain = normalise(passage)
    if not any(c.isalnum() for c in plain):
        return None
    return hashlib.blake2b(plain.encode(), digest_size=16).hexdigest()


def parse_parts(text: str) -> tuple[str, list[tuple[int, str]], list[int]]:
    """(own text, [(level, passage)], numbers of the own lines before which a quote stood)."""
    own, passages, cuts, level, run = [], [], [], 0, []
    for line in text.split("\n"):
        at, plain = quote_level(line)
        if at != level and run:
            passages.append((level, "\n".join(run)))
            run = []
        if at and not level:
            while own and not own[-1].strip():
                own.pop()
            if own and INTRODUCES.search(own[-1]):
                own.pop()
            cuts = [c for c in cuts if c < len(own)] + [len(own)]
        level = at
        (run if at else own).append(plain)
    if level and run:
        passages.append((level, "\n".join(run)))
    if not passages:
        return text, [], []
    whole = "\n".join(own)
    mine = whole.strip("\n")
    ahead, lines = len(whole) - len(whole.lstrip("\n")), mine.count("\n") + 1
    return mine, passages, [c - ahead for c in cuts if 0 < c - ahead < lines]


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """(own text, [(level, passage)]). A deeper run parts the passage around it in two."""
    return parse_parts(text)[:2]


def runs(parts: Iterable[str]) -> dict[str, int]:
    """Hash and length of each part with a letter or digit and of runs of 2, 3, 4, 6, 8, 12 ... of them."""

    def paired(a: list[tuple[str, int]], b: list[tuple[str, int]], gap: int) -> list[tuple[str, int]]:
        return [(hashlib.blake2b(f"{x} {y}".encode(), digest_size=16).hexdigest(), n + 1 + m) for (x, n), (y, m) in zip(a, b[gap:])]

    one = [(h, len(normalise(p))) for p in parts if (h := passage_hash(p))]
    out = {}
    for size, now in ((1, one), (3, paired(one, paired(one, one, 1), 1))):
        while now:
            out.update(now)
            now, size = paired(now, now, size), 2 * size
    return out


def units(text: str, cuts: Iterable[int] = ()) -> dict[str, int]:
    """Hash and length of whatever of a text can be told again; no paragraph or sentence goes over a cut."""
    lines = text.split("\n")
    segments = ["\n".join(lines[a:b]) for a, b in pairwise([0, *cuts, len(lines)])]
    paragraphs = [p for s in segments for p in PARAGRAPH.split(s)]
    sentences = [s for p in paragraphs for s in SENTENCE.sub(r"\1\n", " ".join(p.split())).split("\n")]
    out = {}
    for parts in ([text], segments, PARAGRAPH.split(text), paragraphs, sentences, lines):
        out |= runs(parts)
    return out


def sources(own: str, cuts: Iterable[int] = ()) -> set[str]:
    """Hashes of the passages that others may quote of a message."""
    return set(units(own, cuts))


PARSED = "conv string, turn long, role string, own string, cuts array<int>, quoted array<struct<level:int,hash:string,text:string>>"


def parse_messages(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    quoted_type = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.string()), ("text", pa.string())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            own, cuts, quoted = [], [], []
            for text in batch.column(3).to_pylist():
                mine, passages, at = parse_parts(text)
                own.append(mine)
                cuts.append(at)
                quoted.append([{"level": n, "hash": h, "text": p} for n, p in passages if (h := passage_hash(p))])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), pa.array(own, pa.string()), pa.array(cuts, pa.list_(pa.int32())), pa.array(quoted, quoted_type)],
                names=["conv", "turn", "role", "own", "cuts", "quoted"],
            )

    rows = df.select(
        column_of(df, conv_col).cast("string").alias("conv"),
        column_of(df, turn_col).cast("long").alias("turn"),
        column_of(df, role_col).cast("string").alias("role"),
        F.coalesce(column_of(df, text_col).cast("string"), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(run, PARSED)


UNITS = "conv string, turn long, level int, passage string, hash string, weight long"
_UNITS = pa.schema([("conv", pa.string()), ("turn", pa.int64()), ("level", pa.int32()), ("passage", pa.string()), ("hash", pa.string()), ("weight", pa.int64())])


def unit_rows(texts: DataFrame) -> DataFrame:
    """One row per unit of each row (conv, turn, level, passage, text, cuts)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out = []
            for *key, text, cuts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += [(*key, h, n) for h, n in units(text, cuts or ()).items()]
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(zip(*out, strict=True), _UNITS, strict=True)], schema=_UNITS)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(zip(*out, strict=True), _UNITS, strict=True)], schema=_UNITS)

    return texts.mapInArrow(run, UNITS)


def latest_before(asks: DataFrame, offers: DataFrame) -> DataFrame:
    """``asks`` with ``from``, the latest earlier turn of the conversation that offers the hash, where there is one.

    A running last value over a range partitioning: a unit that a whole
    conversation quotes and tells is split over tasks, and no ask meets all
    offers. Only keys that reach over tasks get what stands before, at most one
    row per task.
    """
    key, order = ["conv", "hash"], ["turn", "_offer"]
    both = asks.withColumns({"_offer": F.lit(0), "from": F.lit(None).cast("long")}).unionByName(offers.select(*key, "turn", F.lit(1).alias("_offer"), F.col("turn").alias("from")), allowMissingColumns=True)
    n = int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = materialise(both.repartitionByRange(n, *key, *order).withColumn("_task", F.spark_partition_id()), "quote-units")
    lasts = laid.groupBy(*key, "_task").agg(F.max("from").alias("_last"))
    split = lasts.groupBy(*key).agg(F.count("*").alias("_tasks")).filter("_tasks > 1").select(*key)
    ahead = Window.partitionBy(*key).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = lasts.join(split, key, "left_semi").withColumn("_before", F.max("_last").over(ahead)).select(*key, "_task", "_before")
    here = Window.partitionBy("_task", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = laid.withColumn("_here", F.max("from").over(here)).filter("_offer = 0").join(F.broadcast(before), [*key, "_task"], "left")  # at most two rows per task
    return out.withColumn("from", F.coalesce("_here", "_before")).filter("`from` is not null").select(*asks.columns, "from")


def link_quotes(parsed: DataFrame) -> DataFrame:
    """(conv, turn, parent) of every message with a linked quote; messages without a turn have none.

    Only units that are quoted at all are looked up, so a conversation of any
    length meets its few quotes, not itself; where nothing is quoted, no text is
    cut into units.
    """
    told = parsed.filter("turn is not null")
    passages = told.filter(F.size("quoted") > 0).select("conv", "turn", F.explode("quoted").alias("q"))
    passages = passages.select("conv", "turn", "q.level", F.col("q.hash").alias("passage"), "q.text", F.lit(None).cast("array<int>").alias("cuts"))
    asks = materialise(unit_rows(passages), "quote-asks")
    if asks.isEmpty():
        return asks.select("conv", "turn", F.col("turn").alias("parent"))
    wanted = asks.select("conv", "hash").distinct()
    offers = unit_rows(told.select("conv", "turn", F.lit(0).alias("level"), F.lit("").alias("passage"), F.col("own").alias("text"), "cuts"))
    offers = materialise(offers.select("conv", "turn", "hash").join(wanted, ["conv", "hash"], "left_semi"), "quote-offers")
    found = latest_before(asks, offers).groupBy("conv", "turn", "level", "passage").agg(F.max(F.struct("weight", "from"))["from"].alias("from"))
    return found.groupBy("conv", "turn").agg(F.max(F.struct(-F.col("level"), F.col("from")))["from"].alias("parent"))


def roots_of(links: DataFrame) -> DataFrame:
    """(conv, turn, root, depth): follows parents by doubling, in as many rounds as the logarithm of the depth."""
    now = materialise(links.select("conv", "turn", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "quote-roots")
    while True:
        up = now.select("conv", F.col("turn").alias("root"), F.col("root").alias("_above"), F.col("depth").alias("_more"))
        step = now.join(up, ["conv", "root"], "left")
        if step.filter("_above is not null").isEmpty():
            return now
        last, now = now, materialise(step.select("conv", "turn", F.coalesce("_above", "root").alias("root"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth")), "quote-roots")
        drop_tables(last)


def ranked(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Gapless numbers from 0 within each key, by ``order``, when one key may hold most rows.

    A range partitioning splits a large key over tasks; what a task's first key has
    before it is known from one count per (task, key). Only keys that reach over
    tasks get an offset, at most one per task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = materialise(df.repartitionByRange(n, key, *order).withColumn("_task", F.spark_partition_id()), "ranked")
    counts = laid.groupBy(key, "_task").agg(F.count("*").alias("_n"))
    split = counts.groupBy(key).agg(F.count("*").alias("_tasks")).filter("_tasks > 1").select(key)
    before = counts.join(split, key, "left_semi").withColumn("_before", F.sum("_n").over(Window.partitionBy(key).orderBy("_task")) - F.col("_n")).select(key, "_task", "_before")
    within = F.row_number().over(Window.partitionBy("_task", key).orderBy(*order)) - 1
    out = laid.withColumn("_within", within).join(F.broadcast(before), [key, "_task"], "left")  # at most two rows per task
    return out.withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_within")).drop("_task", "_within", "_before")


def linked_messages(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per message: conv, turn, role, text (without quotes), parent_turn, root_turn, depth, position, quotes.

    ``position`` counts from 0 in reply order: by the turn that began the thread,
    then by turn, so a reply always stands after what it answers. A message without
    a linked quote begins a thread (parent null, depth 0). Null texts are empty; a
    null conversation is one conversation; null turns link to nothing and come
    first. Rows that repeat a turn stay as rows, in the order of their texts, and
    links name the turn. A message without quotes keeps its text as it is, a
    message of quotes alone has an empty text and stays. An empty table gives no
    rows; other columns are not looked at.
    """
    parsed = materialise(parse_messages(df, conv_col, turn_col, role_col, text_col), "messages")
    parsed = parsed.withColumn("conv", F.coalesce(F.concat(F.lit("="), "conv"), F.lit("")))  # only the null conversation has an empty key
    links = link_quotes(parsed)
    roots = roots_of(links)
    found = links.join(roots, ["conv", "turn"])
    rows = parsed.join(found, ["conv", "turn"], "left").select(
        "conv",
        "turn",
        "role",
        F.col("own").alias("text"),
        F.col("parent").alias("parent_turn"),
        F.coalesce("root", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        F.size("quoted").cast("long").alias("quotes"),
    )
    out = ranked(rows, "conv", ["root_turn", "turn", "text", "role"], "position")
    return out.withColumn("conv", F.when(F.col("conv") != "", F.substring("conv", 2, 2**31 - 1)))


def conversations(messages: DataFrame) -> DataFrame:
    """(conv, messages array<struct<position, role, text, parent_turn>>) in reply order, of what ``linked_messages`` gives.

    For conversations that fit in a row; ``linked_messages`` is the form for any
    size. The null conversation is one row; an empty table gives none.
    """
    row = F.struct("position", "role", "text", "parent_turn")
    return messages.groupBy("conv").agg(F.array_sort(F.collect_list(row)).alias("messages"))
