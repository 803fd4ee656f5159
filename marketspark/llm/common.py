"""Shared helpers: stable input projection, safe names, bounded worker memory."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.sources.shared import drop_tables, materialise, new_table_path, shared_dir

__all__ = ["Known", "column_of", "drop_tables", "free_name", "id_and_text", "materialise", "new_table_path", "shared_dir", "small"]

def column_of(df: DataFrame, name: str) -> Column:
    """The column of exactly this name, dots and spaces included."""
    return df[f"`{name.replace('`', '``')}`"]


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only ``_id`` and ``_text`` (null: empty): other columns, whatever their names, can't clash."""
    return df.select(
        column_of(df, id_col).cast("long").alias("_id"),
        F.coalesce(column_of(df, text_col).cast("string"), F.lit("")).alias("_text"),
    )


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with underscores in front until no column has that name."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


def small(batches: Iterable[pa.RecordBatch], most_bytes: int = 2_000_000, most_rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most_bytes`` (one row at least), so few of them are Python objects at once.

    When a task's rows are through, what Arrow's allocator holds back goes to the system.
    """
    try:
        for batch in batches:
            n = batch.num_rows
            step = max(1, min(most_rows, n if not n else int(most_bytes * n / max(1, batch.nbytes))))
            for at in range(0, n, step):
                yield batch.slice(at, step)
    finally:
        pa.default_memory_pool().release_unused()


class Known(dict):
    """A table of what ``work`` gives for a word, of bounded bytes: two halves, of which the older goes when the newer is full.

    Frequent words are moved to the newer half when they are met again, so they stay.
    """

    def __init__(self, work: Callable[[str], object], most_bytes: int, entry: int = 120):
        """``entry``: bytes that an entry takes besides its key's characters, as measured."""
        super().__init__()
        self.work, self.entry, self.half, self.size, self.older = work, entry, most_bytes // 2, 0, {}

    def __missing__(self, word: str):
        found = self.older.get(word)
        if found is None:
            found = self.work(word)
        self.keep(word, found)
        return found

    def keep(self, word: str, found) -> None:
        cost = self.entry + len(word)
        if cost > self.half // 64:
            return  # a word that long would push out many
        self.size += cost
        if self.size > self.half:
            self.older, self.size = dict(self), cost
            self.clear()
        self[word] = found
