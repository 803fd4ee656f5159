"""Packing of documents into sequences of a fixed length, best fit decreasing.

A document longer than a sequence is first cut into full windows; what is left
over is a piece. The pieces of a task are placed in order of falling length, each
into the open sequence with the least room that holds it. A segment tree over the
possible amounts of room finds that one in log(seq_len) steps.

A task packs the documents it reads, as numbers (no text, no ids). Only its last
few sequences have room left. Their pieces, a few dozen numbers for each task, are
gathered in groups of some ``TAIL`` and packed once more, so how the input is cut
into tasks doesn't show in the padding.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.llm.bpe import SPACE, byte_alphabet, char_class
from marketspark.llm.common import Known, id_and_text, materialise, small


class RoomTree:
    """Open sequences by the room they have; ``tightest(n)`` pops one with the least room of at least n."""

    def __init__(self, most: int):
        self.leaves = 1
        while self.leaves < most + 1:
            self.leaves *= 2
        self.some = [False] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        at = room + self.leaves
        while at and not self.some[at]:
            self.some[at] = True
            at //= 2

    def tightest(self, size: int) -> tuple[int, int] | None:
        """(room, sequence), or None if no open sequence has that much room."""
        at = size + self.leaves
        if not self.some[at]:
            # up to the first right neighbour that holds something, then down its left edge
            while at > 1 and (at % 2 or not self.some[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.some[2 * at] else 2 * at + 1
        room = at - self.leaves
        sequence = self.open[room].pop()
        if not self.open[room]:
            self.some[at] = False
            at //= 2
            while at and not (self.some[2 * at] or self.some[2 * at + 1]):
                self.some[at] = False
                at //= 2
        return room, sequence


def best_fit_decreasing(lengths: np.ndarray, seq_len: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, offset) of every piece, and the number of sequences. Lengths are 1 to seq_len."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, n = RoomTree(seq_len), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        found = tree.tightest(size) if size < seq_len else None
        if found is None:
            room, at, n = seq_len, n, n + 1
        else:
            room, at = found
        sequence[i], offset[i] = at, seq_len - room
        if room > size:
            tree.add(room - size, at)
    return sequence, offset, n


#: Fixed value: the byte-level vocabulary's contractions.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """The file's tokens as bytes, by id, if ids follow the order of the merges; else None.

    Then the merge of lowest id is the merge of highest priority, and any byte-pair
    encoder by rank gives the ids that the tokenizers library gives.
    """
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    vocab, special = said["model"]["vocab"], {t["content"] for t in said["added_tokens"]}
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in said["model"]["merges"]]
    if said["normalizer"] is not None or any(a >= b for a, b in zip(made, made[1:])):
        return None
    back = {c: b for b, c in byte_alphabet().items()}
    ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if token not in special}
    whole = len(ranks) == 256 + len(made) and all(bytes([b]) in ranks for b in range(256)) and sorted(ranks.values()) == list(range(len(ranks)))
    return ranks if whole and max(ranks[bytes([b])] for b in range(256)) < min(made, default=256) else None


class ByteBpe:
    """ids as the tokenizers library gives them; of words met again the ids are known, in a table of bounded bytes."""

    def __init__(self, path: str, table_bytes: int = 16 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.patterns = [self.pattern(n) for n in (0x80, 0x250)]
        self.beyond = re.compile("[^\\u0000-\\u024f]")
        ranks = byte_ranks(path)
        self.encode = None
        if ranks is not None:
            import tiktoken

            self.encode = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known = Known(self.word, table_bytes)

    def by_library(self, text: str) -> list[int]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return self.library.encode(text, add_special_tokens=False).ids

    def word(self, word: str) -> bytes:
        return array("I", self.encode(word) if self.encode is not None else self.by_library(word)).tobytes()

    @staticmethod
    def pattern(below: int) -> re.Pattern:
        letter, number = char_class("L", below), char_class("N", below)
        return re.compile(f" ?[{letter}]+|{CONTRACTIONS}| ?[{number}]+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

    def ids(self, text: str) -> np.ndarray:
        """The ids of a whole text, as unsigned 32-bit numbers."""
        ascii_only = text.isascii()
        if (not ascii_only and self.beyond.search(text)) or any(t in text for t in self.special):
            return np.array(self.by_library(text), np.uint32)
        known = self.known
        return np.frombuffer(b"".join([known[w] for w in self.patterns[0 if ascii_only else 1].findall(text)]), np.uint32)


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_COLUMNS = ["_id", *(c.split(" ")[0] for c in PIECES.split(", "))]
#: Pieces that one task of the second packing gets, about.
TAIL = 500_000
#: Room, as a share of a sequence, beyond which a task's sequence is opened again.
LOOSE = 1 / 64


class _Pieces:
    """Pieces of a task as rows of numbers; identifiers apart, for they may be null."""

    def __init__(self):
        self.ids: list[pa.Array] = []
        self.numbers = array("q")

    def packed(self, seq_len: int, first_sequence: int) -> tuple[pa.Table, np.ndarray]:
        """(the table of _COLUMNS in order of sequence and offset, for each row the room its sequence has left)."""
        numbers = np.frombuffer(self.numbers, np.int64).reshape(-1, 4)
        sequence, offset, n = best_fit_decreasing(numbers[:, 1], seq_len)
        room = seq_len - np.bincount(sequence, numbers[:, 1], n).astype(np.int64)
        order = np.lexsort((offset, sequence))
        ids = pa.chunked_array(self.ids, pa.int64())
        table = pa.table([ids, *(pa.array(numbers[:, i]) for i in range(4)), pa.array(sequence + first_sequence), pa.array(offset)], names=_COLUMNS)
        return table.take(pa.array(order)), room[sequence[order]]


def pack_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", seq_len: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and then ``end_id``; every id lies in one piece. Within
    a sequence, offsets are gapless from 0. ``sequence_id`` holds the task's number
    above its 32 low bits; those of the second packing have bit 62 set. Null text
    is the empty text, which is ``end_id`` alone. Rows that repeat an identifier,
    and rows without one, are packed each. An empty table gives no rows; other
    columns are not looked at.
    """
    if seq_len < 1:
        raise ValueError("seq_len is at least 1")
    end = np.array([end_id], np.uint32).tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, ids, held = TaskContext.get().partitionId(), byte_bpe(tokenizer).ids, _Pieces()
        for batch in small(batches):
            repeats = []
            for text in batch.column(1).to_pylist():
                data = memoryview(ids(text).tobytes() + end)
                n = len(data) // 4
                for start in range(0, n, seq_len):
                    length = min(seq_len, n - start)
                    held.numbers.extend((start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), n))
                repeats.append(-(-n // seq_len))
            held.ids.append(batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), repeats))))
        if held.ids:
            table, room = held.packed(seq_len, task << 32)
            table = table.append_column("_loose", pa.array(room > LOOSE * seq_len))
            yield from table.to_batches(max_chunksize=10_000)

    def again(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, held = TaskContext.get().partitionId(), _Pieces()
        for batch in batches:
            held.ids.append(batch.column(0))
            held.numbers.frombytes(np.stack([batch.column(i).to_numpy() for i in range(1, 5)], axis=1).astype(np.int64).tobytes())
        if held.ids:
            yield from held.packed(seq_len, (1 << 62) + (task << 32))[0].to_batches(max_chunksize=10_000)

    schema = f"_id long, {PIECES}"
    first = materialise(id_and_text(df, id_col, text_col).mapInArrow(run, f"{schema}, _loose boolean"), "pieces")
    tail = first.filter("_loose").select(_COLUMNS)
    groups = max(1, math.ceil(tail.count() / TAIL))
    # sorted, so that a task that is run again packs the same way
    dealt = tail.repartition(groups, F.shiftright("sequence_id", 32)).sortWithinPartitions("sequence_id", "offset")
    packed = materialise(dealt.mapInArrow(again, schema), "tail-pieces")
    return first.filter("not _loose").select(_COLUMNS).unionByName(packed).withColumnRenamed("_id", id_col)
