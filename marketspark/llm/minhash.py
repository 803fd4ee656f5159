"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is the multiset of its five-word shingles (lower-cased, split at white space;
a shorter text is one shingle). A shingle's weight is its count in the text times
its inverse document frequency,

    idf(s) = 1 + ln(1 / max(share(s), COMMON)) / ln(1 / COMMON),

where share(s) is the part of all documents that hold it: 2 for what fewer than
COMMON of them hold, falling to 1 for what all hold. Only shingles above that share
need to be known, and as a document holds L shingles on average there are at most
L / COMMON of them, however large the corpus is. They are found exactly, in two
passes: hashed counters rule out nearly all, the rest are counted.

Each document gets ``bands * rows`` samples, so that two documents agree in one with
a probability of their weighted Jaccard similarity. Documents that agree in a whole
band are candidates. In a band's bucket all are compared with one of them, so a group
of copies needs one comparison each. Where that doesn't join a bucket into one class,
those outside its largest class are compared with all they aren't in a class with,
but for pairs whose similarity can't reach the threshold: what a text shares with
any of the texts concerned bounds what it shares with one of them. So no link within
a bucket is lost. A comparison reads both whole texts and works out the weighted
Jaccard similarity exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import column_of, drop_tables, id_and_text, materialise, small
from marketspark.llm.components import components

#: Documents that hold a shingle, as a share of all, up to which its idf is highest.
COMMON = 0.05
#: Counters of the first pass: its false candidates cost time only.
COUNTERS = 1 << 18
#: Rows of each of the sampler's two tables of draws.
TABLE = 1 << 13
#: Shingles that the sampler looks at together.
BLOCK = 1024
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_FACTOR = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (splitmix64)."""
    x = x + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """A hash per word; hashing a word takes less time than looking it up in a table of words would."""
    digest = xxhash.xxh3_64_digest
    return np.frombuffer(b"".join([digest(w.encode("utf-8", "replace")) for w in text.lower().split()]), np.uint64)


def occurrences(text: str, width: int = 5) -> np.ndarray:
    """The hash of each shingle, in the order of the text: a polynomial of its words' hashes, scrambled."""
    return shingled(word_hashes(text), width)


def shingled(words: np.ndarray, width: int = 5) -> np.ndarray:
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    h = words[:n].copy()
    for k in range(1, min(width, len(words))):
        h *= _FACTOR
        h += words[k : k + n]
    return mix(h)


def shingles(text: str, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, sorted; how often each stands in the text)."""
    return counted(occurrences(text, width))


def counted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(h):
        return h, np.zeros(0, np.int64)
    h = np.sort(h)
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[first], np.diff(np.append(first, len(h)))


class Idf:
    """idf by shingle: the common ones by table, 2 for all others."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order]

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), 2.0)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[at] == h
            out[hit] = self.values[at[hit]]
        return out


def idf_of_share(share):
    return 1 + np.log(1 / np.maximum(share, COMMON)) / math.log(1 / COMMON)


def weights(text: str, idf: Idf) -> tuple[np.ndarray, np.ndarray]:
    h, n = shingles(text)
    return h, n * idf.of(h)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima; 1 for two texts without words."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


class Icws:
    """``samples`` improved consistent weighted samples.

    Sample k picks the shingle s of weight S with the least
    ``ln a = ln c - (ln y + r)``, where ``t = floor(ln S / r + beta)`` and
    ``ln y = r * (t - beta)``; r and c are Gamma(2, 1) and beta uniform. The
    sample is (s, t), so two texts agree in one with a probability of their
    weighted Jaccard similarity.

    A shingle's (r, beta) and its c come from two tables of TABLE rows, looked up by
    two independent parts of its hash: any two shingles differ in their draws, but
    for one pair in TABLE ** 2, and no logarithm is taken for a shingle. Nearly all
    weights are 2, and for these ``ln y + r`` is a table too. Both terms are
    compared in steps of STEP; of equals the shingle of the smallest hash is taken.
    """

    #: Of ln a; two shingles fall into one step in about one comparison of a thousand.
    STEP = 1 / 1024
    #: Bounds of ln c and of ln y + r; draws beyond them occur once in some million and are cut to them.
    LOW_C, HIGH_C, HIGH_REACH = -12.0, 4.0, 24.0

    def __init__(self, samples: int, seed: int = 1):
        self.samples, self.seed = samples, seed
        cell = mix((np.arange(TABLE, dtype=np.uint64)[:, None] << np.uint64(20)) | np.arange(samples, dtype=np.uint64))
        self.r = -np.log(self.draw(cell, 1) * self.draw(cell, 2)).astype(np.float32)
        self.beta = self.draw(cell, 5).astype(np.float32)
        ln_c = np.log(-np.log(self.draw(cell, 3) * self.draw(cell, 4)))
        self.c = ((np.clip(ln_c, self.LOW_C, self.HIGH_C) - self.LOW_C) / self.STEP).astype(np.uint16)
        self.short_of_two = self.short(np.float32(math.log(2.0)), self.r, self.beta)

    def draw(self, cell: np.ndarray, what: int) -> np.ndarray:
        """A uniform number in (0, 1] of each cell."""
        salt = np.uint64(int(_MIX[what % 3]) * (what + self.seed) % 2**64)
        return ((mix(cell ^ salt) >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53

    def short(self, ln_weight, r: np.ndarray, beta: np.ndarray) -> np.ndarray:
        """By how many steps ``ln y + r`` falls short of its bound."""
        reach = r * (np.floor(ln_weight / r + beta) - beta) + r
        return ((self.HIGH_REACH - np.clip(reach, 0, self.HIGH_REACH)) / self.STEP).astype(np.uint16)

    @staticmethod
    def rows(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (h >> np.uint64(65 - TABLE.bit_length())).astype(np.intp), (h & np.uint64(TABLE - 1)).astype(np.intp)

    def least(self, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the least a in steps, the place of its shingle) of each sample."""
        row, other = self.rows(h)
        a = np.take(self.c, other, axis=0)
        short = np.take(self.short_of_two, row, axis=0)
        odd = np.flatnonzero(w != 2.0)
        if len(odd):
            short[odd] = self.short(np.log(w[odd]).astype(np.float32)[:, None], self.r[row[odd]], self.beta[row[odd]])
        a += short
        at = a.argmin(axis=0)
        return a[at, np.arange(self.samples)], at

    def sample(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """A 64-bit number of (s, t) for each sample, of a text that holds something; its hashes are sorted."""
        best, at = self.least(h[:BLOCK], w[:BLOCK])
        for i in range(BLOCK, len(h), BLOCK):
            more, where = self.least(h[i : i + BLOCK], w[i : i + BLOCK])
            less = more < best
            best[less], at[less] = more[less], where[less] + i
        k, row = np.arange(self.samples), self.rows(h[at])[0]
        t = np.floor(np.log(w[at]).astype(np.float32) / self.r[row, k] + self.beta[row, k])
        return h[at] ^ mix(np.clip(t, -(2.0**31), 2.0**31 - 1).astype(np.int64).view(np.uint64))

    def bands(self, texts: list[tuple[np.ndarray, np.ndarray]], bands: int, rows: int) -> np.ndarray:
        """A 64-bit key per text and band, of (sorted hashes, weights) that hold something."""
        keys = np.stack([self.sample(h, w) for h, w in texts]).reshape(len(texts), bands, rows)
        key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(texts), bands))
        for j in range(rows):
            key = mix(key ^ keys[:, :, j])
        return key


@lru_cache(maxsize=1)
def icws(samples: int) -> Icws:
    return Icws(samples)


def counter_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(65 - COUNTERS.bit_length())).astype(np.int64)


def common_shingles(docs: DataFrame, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, idf) of the shingles that more than COMMON of the documents hold.

    First pass: each task counts the shingles of its texts, repeats and all, into
    COUNTERS hashed counters, which are added up slice by slice. A shingle whose
    counter is below the limit can't be common. Second pass: documents are counted
    for the others.
    """
    least = COMMON * n_docs
    slices = 16
    width = COUNTERS // slices

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(COUNTERS, np.int64)
        held: list[np.ndarray] = []
        size = 0
        for batch in small(batches):
            for text in batch.column(1).to_pylist():
                held.append(counter_of(occurrences(text)))
                size += len(held[-1])
                if size > 500_000:
                    table += np.bincount(np.concatenate(held), minlength=COUNTERS)
                    held, size = [], 0
        if held:
            table += np.bincount(np.concatenate(held), minlength=COUNTERS)
        if table.any():
            rows = [table[i * width : (i + 1) * width].astype(np.uint32).tobytes() for i in range(slices)]
            yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array(rows, pa.binary())], names=["slice", "counts"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(data.as_py(), np.uint32).astype(np.int64)
        for i, total in sums.items():
            hot = np.flatnonzero(total > least) + i * width
            yield pa.RecordBatch.from_arrays([pa.array(hot, pa.int64())], names=["counter"])

    hot = docs.mapInArrow(count, "slice int, counts binary").repartition(slices, "slice").mapInArrow(add, "counter long").collect()
    if not hot:  # at most COUNTERS rows
        return np.zeros(0, np.uint64), np.zeros(0)
    counters = np.zeros(COUNTERS, bool)
    counters[[r["counter"] for r in hot]] = True

    def exact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def give():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

        for batch in small(batches):
            for text in batch.column(1).to_pylist():
                h = occurrences(text)
                h = np.unique(h[counters[counter_of(h)]])
                if len(h):
                    held.append(h)
                    size += len(h)
            if size > 2_000_000:
                yield give()
                held, size = [], 0
        if held:
            yield give()

    # at most (shingles per document) / COMMON rows
    found = docs.mapInArrow(exact, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") > least).collect()
    hashes = np.array([r["h"] for r in found], np.int64).view(np.uint64)
    return hashes, idf_of_share(np.array([r["n"] for r in found], float) / n_docs)


def signatures(docs: DataFrame, idf_table, bands: int, rows: int) -> DataFrame:
    """(_id, _words, keys array<long>): a digest of the word sequence and a key per band; no keys without words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, sampler = Idf(*idf_table.value), icws(bands * rows)
        for batch in small(batches, most_rows=256):
            hashes = [word_hashes(t) for t in batch.column(1).to_pylist()]
            words = [xxhash.xxh3_128_hexdigest(x.tobytes()) for x in hashes]
            some = [(h, n * idf.of(h)) for h, n in (counted(shingled(x)) for x in hashes) if len(h)]
            made = iter(sampler.bands(some, bands, rows).view(np.int64) if some else ())
            keys = [next(made) if len(x) else np.zeros(0, np.int64) for x in hashes]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.string()), pa.array(keys, pa.list_(pa.int64()))], names=["_id", "_words", "keys"])

    return docs.mapInArrow(run, "_id long, _words string, keys array<long>")


#: Parts into which a text's shared shingles are dealt by hash, for a bound of what two texts can have in common.
PARTS = 64


def shared_weight(held: DataFrame, idf_table) -> DataFrame:
    """(_id, total, shared, parts): a text's weight, the part of it in shingles that another of these texts has too, and that by PARTS hashed parts.

    No two texts can have more in common than the sum over the parts of the smaller
    shared weight, which bounds their similarity without a comparison.
    """

    def flat(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = Idf(*idf_table.value)
        for batch in small(batches):
            ids, hashes, values, size = [], [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, w = weights(text, idf)
                ids.append(np.full(len(h), i))
                hashes.append(h)
                values.append(w)
                size += len(h)
                if size > 200_000:
                    yield _flat(ids, hashes, values)
                    ids, hashes, values, size = [], [], [], 0
            if size:
                yield _flat(ids, hashes, values)

    def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = Idf(*idf_table.value)
        for batch in small(batches):
            parts = []
            for text in batch.column(1).to_pylist():
                h, w = weights(text, idf)
                parts.append(np.bincount((h % np.uint64(PARTS)).astype(np.intp), w, PARTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.list_(pa.float64()))], names=["_id", "_all"])

    rows = held.mapInArrow(flat, "_id long, h long, w double")
    # a shingle with one holder: its weight is that text's alone
    alone = rows.groupBy("h").agg(F.min("_id").alias("_id"), F.max("_id").alias("_last"), F.min("w").alias("w")).filter("_id = _last")
    alone = alone.groupBy("_id", F.col("h").bitwiseAND(PARTS - 1).cast("int").alias("_p")).agg(F.sum("w").alias("w"))
    alone = alone.groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("_p", "w"))).alias("_alone"))  # PARTS entries at most
    none = F.create_map().cast("map<int,double>")
    out = held.mapInArrow(dealt, "_id long, _all array<double>").join(alone.hint("merge"), "_id", "left")
    left = F.transform("_all", lambda v, i: F.greatest(F.lit(0.0), v - F.coalesce(F.try_element_at(F.coalesce("_alone", none), i), F.lit(0.0))))
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda total, v: total + v)
    return out.select("_id", add("_all").alias("total"), left.alias("parts")).withColumn("shared", add("parts"))


def _flat(ids: list[np.ndarray], hashes: list[np.ndarray], values: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(values))], names=["_id", "h", "w"])


def similarity_column(a: Column, b: Column, idf_table) -> Column:
    @F.arrow_udf("double")
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        idf, out, last = Idf(*idf_table.value), [], (None, None)
        for x, y in zip(left, right, strict=True):  # one pair of texts as Python objects at a time
            x = x.as_py()
            if last[0] != x:
                last = (x, weights(x, idf))
            out.append(weighted_jaccard(last[1], weights(y.as_py(), idf)))
        return pa.array(out, pa.float64())

    return similar(a, b)


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = 24, rows: int = 6
) -> DataFrame:
    """One row per input row: id, class_id (the smallest id of its class), kept (is it that one).

    A class is a connected component of links: pairs of texts whose weighted Jaccard
    similarity is at least ``threshold``, or whose word sequences are equal. Texts
    without words (null and empty ones too) are one class. Rows that repeat an
    identifier share its class (the smallest any of them has), and where their texts
    differ the first of these in order is the one that is compared; a null
    identifier is a class of its own and is kept. An empty table gives no rows;
    other columns are not looked at.
    """
    spark = df.sparkSession
    docs = id_and_text(df, id_col, text_col)
    n_docs = docs.count()
    table = spark.sparkContext.broadcast(common_shingles(docs, n_docs))
    signed = materialise(signatures(docs, table, bands, rows), "signatures")
    known = signed.filter("_id is not null")
    # texts of equal word sequences: one stands for all
    copies = materialise(known.groupBy("_words").agg(F.min("_id").alias("rep"), F.first("keys").alias("keys")), "copies")
    keyed = copies.filter(F.size("keys") > 0).select("rep", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("rep").alias("head"), F.count("*").alias("n")).filter("n > 1")
    members = materialise(keyed.join(buckets.select("key", "head"), ["key"]), "buckets")

    texts = docs.filter("_id is not null")

    def texts_of(source: DataFrame, ids: DataFrame, name: str) -> DataFrame:
        """(_id, _text) of these ids only. A merge join at every size: ids grow with the corpus."""
        needed = ids.select(F.col(ids.columns[0]).alias("_r")).distinct().hint("merge")
        return materialise(source.join(needed, F.col("_id") == F.col("_r"), "left_semi").groupBy("_id").agg(F.min("_text").alias("_text")), name)

    def verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
        """Of pairs (a, b), a < b, those that are linked."""
        # the large side of the second join, whose key may be hot, carries the texts, so its size shows and it is split
        second = pairs.join(held.select(F.col("_id").alias("b"), F.col("_text").alias("tb")).hint("merge"), "b")
        both = second.join(held.select(F.col("_id").alias("a"), F.col("_text").alias("ta")).hint("merge"), "a")
        return both.select("a", "b", similarity_column(F.col("ta"), F.col("tb"), table).alias("s")).filter(F.col("s") >= threshold).select("a", "b")

    pairs = materialise(members.filter("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    held = texts_of(texts, pairs.select(F.explode(F.array("a", "b"))), "texts")  # the one shuffle of all texts
    links = materialise(verified(pairs, held), "verified")
    roots = components(links)
    # buckets whose members aren't one component yet: those outside its largest meet all the others that they may be linked to
    told = members.join(roots, members["rep"] == roots["node"], "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
    parts = told.groupBy("key", "root").agg(F.count("*").alias("n"))
    largest = parts.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("top"), F.count("*").alias("parts")).filter("parts > 1").select("key", "top")
    open_ = materialise(told.join(largest, ["key"]), "open")
    if not open_.isEmpty():
        open_texts = texts_of(held, open_.select("rep"), "open-texts")
        share = materialise(shared_weight(open_texts, table), "shared")
        may_link = share.filter(F.col("shared") >= threshold * F.col("total") * (1 - 1e-9))
        keys = open_.groupBy("rep").agg(F.array_sort(F.collect_set("key")).alias("keys"))  # one per band at most
        able = open_.join(may_link.hint("merge"), F.col("rep") == F.col("_id")).join(keys.hint("merge"), "rep")
        fields = ("rep", "root", "shared", "total", "parts", "keys")
        minor = able.filter("root <> top").select("key", *[F.col(c).alias(f"x_{c}") for c in fields])
        other = able.select("key", *[F.col(c).alias(f"y_{c}") for c in fields])

        def enough(common):
            return common >= threshold * (1 - 1e-9) * (F.col("x_total") + F.col("y_total") - common)

        dealt = F.aggregate(F.zip_with("x_parts", "y_parts", lambda x, y: F.least(x, y)), F.lit(0.0), lambda total, v: total + v)
        may = (minor["key"] == other["key"]) & (F.col("x_root") != F.col("y_root")) & enough(F.least("x_shared", "y_shared"))
        # a pair counts in the first bucket that it shares
        may = may & (minor["key"] == F.array_min(F.array_intersect("x_keys", "y_keys"))) & enough(dealt)
        more = minor.join(other, may).select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).distinct()
        more = materialise(more.join(pairs, ["a", "b"], "left_anti"), "more-pairs")
        if not more.isEmpty():
            found = materialise(verified(more, open_texts), "verified")
            old, roots = roots, components(links.unionByName(found))
            drop_tables(found, old)
        drop_tables(open_texts, share, more)
    drop_tables(members, pairs, held, links, open_)
    classes = copies.select("_words", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("_words", F.coalesce("root", "rep").alias("class_id"))
    out = known.select("_id", "_words").join(classes, "_words").select(F.col("_id").alias(id_col), "class_id", (F.col("_id") == F.col("class_id")).alias("kept"))
    alone = signed.filter("_id is null").select(F.col("_id").alias(id_col), F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """The rows of ``df`` that stay, one document of each class (that of the smallest id), with all their columns.

    Texts that are null, empty or without words are one class; rows that repeat the
    staying identifier all stay; rows without an identifier stay. An empty table
    gives no rows.
    """
    found = near_duplicates(df, id_col, text_col, threshold)
    gone = found.filter("not kept").select(F.col(id_col).alias("_gone")).distinct().hint("merge")
    return df.join(gone, column_of(df, id_col).cast("long") == F.col("_gone"), "left_anti")
