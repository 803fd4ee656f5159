"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences.

A fingerprint is a string, the whole tree: the root in hex, ``/``, then the sections
parted by ``;``. A section is ``digest:length=`` and its paragraphs parted by ``|``, a
paragraph ``digest:length=`` and its leaves parted by ``,``, a leaf ``digest:length``.
An inner node's digest is made of its children's. Equal texts have equal
fingerprints; texts with equal roots are equal (128 bits). Where roots differ,
``differing_spans`` goes down the branches whose digests differ, to the characters
that were edited, and never looks into branches that are the same on both sides.

A paragraph is a line. A section ends with an empty line, or after a paragraph
whose digest says so (one in eight), so that an insertion moves no later section's
bounds. A paragraph's leaves are its sentences; one without an end of sentence is
cut every 256 characters.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import id_and_text, small

LEAF = re.compile(r"[^.!?|\n]{0,256}(?:[.!?|]+[^\S\n]*|\n|(?<=[^.!?|\n]))", re.S)


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _node(digest: bytes, length: int, width: int = 9) -> str:
    return f"{base64.b64encode(digest[:width]).decode()}:{length}"


def fingerprint(text: str) -> str:
    sections, section_digests, paragraphs, paragraph_digests, size = [], [], [], [], 0

    def close():
        top = _digest(b"S" + b"".join(paragraph_digests))
        sections.append(f"{_node(top, size + len(paragraphs) - 1)}={'|'.join(paragraphs)}")
        section_digests.append(top)
        paragraphs.clear()
        paragraph_digests.clear()

    for line in text.split("\n"):
        leaves = [m for m in LEAF.findall(line) if m]
        digests = [_digest(b"L" + s.encode("utf-8", "surrogatepass")) for s in leaves]
        top = _digest(b"P" + b"".join(digests))
        paragraphs.append(f"{_node(top, len(line))}={','.join([_node(d, len(s), 6) for s, d in zip(leaves, digests, strict=True)])}")
        paragraph_digests.append(top)
        size += len(line)
        if not line or top[0] % 8 == 0:
            close()
            size = 0
    if paragraphs:
        close()
    return _digest(b"R" + b"".join(section_digests)).hex() + "/" + ";".join(sections)


#: A leaf; inner nodes have ``=`` behind their length.
_LEAF = re.compile(r"([^:=,|;]{8}):(\d+)(?=[,|;]|$)")


def leaves_of(print_: str) -> list[tuple[str, int]]:
    """(digest, length) of every leaf, in order."""
    return [(digest, int(size)) for digest, size in _LEAF.findall(print_, 33)]


def likeness(a: str, b: str) -> float:
    """Share of characters in leaves that both have (0 to 1); 1 just if the roots are equal."""
    if a[:32] == b[:32]:
        return 1.0
    x, y = Counter(leaves_of(a)), Counter(leaves_of(b))
    total = sum(n * leaf[1] for leaf, n in x.items()) + sum(n * leaf[1] for leaf, n in y.items())
    if not total:
        return 0.0
    return min(1 - 1e-9, 2 * sum(min(n, y[leaf]) * leaf[1] for leaf, n in x.items() if leaf in y) / total)


def _unlike(left: list[str], right: list[str]) -> Iterator[tuple[int, int, int, int]]:
    """(i, j, k, m) of the runs left[i:j] and right[k:m] that stand against each other, between digests that both have.

    What both begin and end with is the same; within the rest, digests that stand
    once on either side, in one order on both, are the same.
    """
    i, j, k, m = 0, len(left), 0, len(right)
    while i < j and k < m and left[i] == right[k]:
        i, k = i + 1, k + 1
    while i < j and k < m and left[j - 1] == right[m - 1]:
        j, m = j - 1, m - 1
    if i == j and k == m:
        return
    ours, theirs = Counter(left[i:j]), Counter(right[k:m])
    place = {d: x for x, d in enumerate(right[k:m], k) if theirs[d] == 1}
    shared = [(x, place[d]) for x, d in enumerate(left[i:j], i) if ours[d] == 1 and d in place]
    # the longest run of those that rise on both sides
    tails, ends, before = [], [], [-1] * len(shared)
    for n, (_, y) in enumerate(shared):
        at = bisect.bisect_left(tails, y)
        tails[at:], ends[at:] = [y, *tails[at + 1 :]] if at < len(tails) else [y], [n, *ends[at + 1 :]] if at < len(ends) else [n]
        before[n] = ends[at - 1] if at else -1
    chain, n = [], ends[-1] if ends else -1
    while n >= 0:
        chain.append(shared[n])
        n = before[n]
    if not chain:
        yield i, j, k, m
        return
    for x, y in [*reversed(chain), (j, m)]:
        if i < x or k < y:
            yield from [(i, x, k, y)] if i == x or k == y else _unlike_runs(left, right, i, x, k, y)
        i, k = x + 1, y + 1


def _unlike_runs(left: list[str], right: list[str], i: int, j: int, k: int, m: int) -> Iterator[tuple[int, int, int, int]]:
    for a, b, c, d in _unlike(left[i:j], right[k:m]):
        yield i + a, i + b, k + c, k + d


def differing_spans(a: str, b: str) -> list[tuple[int, int]]:
    """Spans of characters of ``a``'s text that lie in branches which ``b`` doesn't have at that place.

    Goes down from the roots by the nodes' digests: sections first, then the
    paragraphs of unlike sections, then the leaves of unlike paragraphs. Where only
    ``b`` has something, the span is empty.
    """
    if a[:32] == b[:32]:
        return []
    marks = (";", "|", ",")

    def size(node: str) -> int:
        return int(node.partition("=")[0].rpartition(":")[2])

    def children(node: str, depth: int, at: int = 0) -> Iterator[tuple[int, str]]:
        """(where its text begins, child)."""
        for child in node.split(marks[depth]) if node else ():
            yield at, child
            at += size(child) + (depth < 2)

    def down(left: list[tuple[int, str]], right: list[str], depth: int) -> Iterator[tuple[int, int]]:
        ends = [at + size(node) for at, node in left]
        for i, j, k, m in _unlike([node.partition("=")[0] for _, node in left], [node.partition("=")[0] for node in right]):
            if i == j:
                at = left[i][0] if i < len(left) else ends[-1] if ends else 0
                yield at, at
                continue
            found = []
            if depth < 2 and k < m:
                ours = [c for at, node in left[i:j] for c in children(node.partition("=")[2], depth + 1, at)]
                theirs = [c for node in right[k:m] for _, c in children(node.partition("=")[2], depth + 1)]
                found = list(down(ours, theirs, depth + 1))
            yield from found or [(left[i][0], ends[j - 1])]

    spans: list[tuple[int, int]] = []
    for start, end in down(list(children(a.partition("/")[2], 0)), [c for _, c in children(b.partition("/")[2], 0)], 0):
        if spans and start <= spans[-1][1] + 1:
            spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
        else:
            spans.append((start, end))
    return spans


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, fingerprint of the whole text. Null is the empty text; no rows give none."""

    def run(batches):
        for batch in small(batches):
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([fingerprint(t) for t in texts], pa.string())],
                names=["_id", "n_chars", "fingerprint"],
            )

    return id_and_text(df, id_col, text_col).mapInArrow(run, "_id long, n_chars long, fingerprint string").withColumnRenamed("_id", id_col)


COMPARED = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_from long, edited_to long"
_NAMES = [c.split(" ")[0] for c in COMPARED.split(", ")]


def placed_by(cuts: np.ndarray, tops: np.ndarray):
    """A column function: of an id, its range (larger ids in lower ranges) and, for a range's largest id, the range before.

    ``cuts`` are the ranges' upper bounds but the last, rising; ``tops`` the largest
    id of each range, in the ranges' order, the smallest number of all where a range
    is empty. Both have a number per range.
    """
    nothing = -(2**63)
    filled = np.flatnonzero(tops > nothing) if len(tops) else np.zeros(0, np.int64)
    before = np.full(len(tops), -1, np.int64)
    before[filled] = np.roll(filled, 1)  # the first's is the last: the ring closes

    @F.arrow_udf("struct<b:int,g:int>")
    def place(ids: pa.Array) -> pa.Array:
        o = ids.to_numpy(zero_copy_only=False).astype(np.int64)
        b = len(cuts) - np.searchsorted(cuts, o, side="left")
        g = np.where(o == tops[b], before[b], -1) if len(tops) else np.full(len(o), -1)
        return pa.StructArray.from_arrays([pa.array(b.astype(np.int32)), pa.array(g.astype(np.int32))], names=["b", "g"])

    return place


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text: its last half replaced from the next document.

    Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, and edited_from and edited_to, the characters of the text
    between which all branches lie that the edited text hasn't (null if the texts are
    equal). "Next" goes by falling id, and from the last to the first. Texts with one
    id follow in the order of their texts; null ids come last; a lone row is its own
    next. Null text is empty; an empty table gives no rows; other columns are not
    looked at.

    Texts move once: ids are cut into ranges by their quantiles, a range is
    sorted in its task, and the top row of each range is also sent to the range
    before. The driver and the tasks see two numbers per range.
    """
    spark = df.sparkSession
    rows = id_and_text(df, id_col, text_col)
    order = F.coalesce(F.col("_id"), F.lit(-(2**63) + 1))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select(order.alias("_o"))
    shares = [i / parts for i in range(1, parts)]
    found = ids.agg(F.percentile_approx("_o", shares, 8 * parts)).first()[0] if shares else None
    cuts = np.array(sorted(set(found or [])), np.int64)
    n = len(cuts) + 1
    tops = np.full(n, -(2**63), np.int64)
    nowhere = placed_by(cuts, np.zeros(0, np.int64))
    for r in ids.select("_o", nowhere("_o")["b"].alias("_b")).groupBy("_b").agg(F.max("_o").alias("_top")).collect():  # a row per range
        tops[r["_b"]] = r["_top"]
    placed = rows.withColumn("_o", order).withColumn("_p", placed_by(cuts, tops)("_o"))
    own, guest = F.struct(F.col("_p.b").alias("_b"), F.lit(0).alias("_g")), F.struct(F.col("_p.g").alias("_b"), F.lit(1).alias("_g"))
    placed = placed.withColumn("_to", F.explode(F.when(F.col("_p.g") >= 0, F.array(own, guest)).otherwise(F.array(own))))
    placed = placed.select("_id", "_text", "_o", F.col("_to._b").alias("_b"), F.col("_to._g").alias("_g"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = {n: [] for n in ["_id", *_NAMES]}
        done = 0

        def give(doc_id, text, print_, next_text, next_print):
            half = len(text) // 2
            edited = text[: len(text) - half] + next_text[:half]
            edited_print = print_ if edited == text else fingerprint(edited)
            spans = differing_spans(print_, edited_print)
            where = (spans[0][0], spans[-1][1]) if spans else (None, None)
            values = (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), print_, edited_print, likeness(print_, edited_print), likeness(print_, next_print), *where)
            for name, value in zip(out, values, strict=True):
                out[name].append(value)
            return len(text) + 1000

        last = None
        for batch in small(batches):
            for doc_id, text, at, is_guest in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if last is not None and last[0] != at:
                    last = None  # its range's guest has come before
                if last is None and is_guest:
                    continue  # a further guest
                print_ = fingerprint(text)
                if last is not None:
                    done += give(*last[1:], text, print_)
                last = None if is_guest else (at, doc_id, text, print_)
                if done > 4_000_000:
                    yield pa.RecordBatch.from_pydict({n: pa.array(v, _TYPES[n]) for n, v in out.items()})
                    done = 0
                    for v in out.values():
                        v.clear()
        if out["_id"]:
            yield pa.RecordBatch.from_pydict({n: pa.array(v, _TYPES[n]) for n, v in out.items()})

    laid = placed.repartitionById(n, F.col("_b")).sortWithinPartitions("_b", "_g", F.desc("_o"), "_text").select("_id", "_text", "_b", "_g")
    return laid.mapInArrow(run, f"_id long, {COMPARED}").withColumnRenamed("_id", id_col)


_KINDS = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
_TYPES = {"_id": pa.int64()} | {c.split(" ")[0]: _KINDS[c.split(" ")[1]] for c in COMPARED.split(", ")}
