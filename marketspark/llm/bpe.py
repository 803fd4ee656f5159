"""BPE encoding and decoding by streaming transducers with bounded lookahead.

Encoding. A merge at some place can only be undone by what stands right of it
through a chain of merges of ever higher priority, each of which starts inside
the one before and reaches further right. ``sufficient_lookahead`` walks the merge
list once, in order of priority, and gives the longest such reach. A token whose
end lies at least that many symbols before the end of what has been read can't
change any more, whatever follows: it is emitted, and because no merge crosses
its end, the rest is encoded as if it stood alone. So a word of any length needs
a window of a fixed number of symbols.

A text passes in blocks of some 64 KiB that end before white space; each word's ids
are final when its last token is stable, and go on at once, so what is held beside
the text itself doesn't grow with it. (A run without any white space is one block.)

Decoding. ``IncrementalDecoder`` takes ids, one or several at a time, and holds back
at most the three bytes of an unfinished UTF-8 character.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from marketspark.llm.common import Known, column_of, id_and_text, small

#: Unicode's White_Space.
SPACE = r"\t-\r \x85\xa0  -     　"


@lru_cache(maxsize=8)
def char_class(kind: str, below: int = sys.maxunicode + 1) -> str:
    """The characters of a Unicode category as ranges of a character class, by the interpreter's tables."""
    out, start = [], None
    for c in range(below + 1):
        inside = c < below and unicodedata.category(chr(c)).startswith(kind)
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


def word_pattern(below: int = sys.maxunicode + 1) -> re.Pattern:
    """How the word-end vocabulary splits normalised text whose characters are below that."""
    letter, number = char_class("L", below), char_class("N", below)
    return re.compile(f"[{letter}]+|[{number}]|'s|'t|'re|'ve|'m|'ll|'d|[^{SPACE}{letter}{number}]+")


@lru_cache(maxsize=1)
def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: itself, or one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def sufficient_lookahead(merges: Iterable[tuple[str, str]], length=len) -> int:
    """Symbols right of a token's end that can have a say in whether it stays.

    reach(r), of the merge r of u and v: the furthest that a merge of higher
    priority whose left part is an end of v reaches beyond v, by itself or through
    a chain of further ones. What crosses a token's end by r then depends on
    length(v) + reach(r) symbols at most; the result is the largest such sum.
    """
    most: dict[str, int] = {}
    for left, right in merges:
        reach = max((most[right[i:]] for i in range(len(right)) if right[i:] in most), default=0)
        far = length(right) + reach
        if most.get(left, 0) < far:
            most[left] = far
    return max(most.values(), default=0)


class Transducer:
    """Turns a stream of symbols into token ids, keeping a window of fixed size.

    ``suffix`` (like ``</w>``) marks a word's last symbol.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        self.ranks = {pair: i for i, pair in reversed(list(enumerate(merges)))}
        size = (lambda s: len(s.removesuffix(suffix))) if suffix else len
        self.lookahead = max(1, sufficient_lookahead(merges, size))
        self.block = 4 * self.lookahead

    def merged(self, symbols: list[str]) -> list[str]:
        """The tokens of a whole list of symbols: lowest rank first, leftmost at a tie."""
        ranks = self.ranks
        if len(symbols) <= 48:
            parts, never = list(symbols), len(ranks)
            pairs = [ranks.get(p, never) for p in zip(parts, parts[1:])]
            while pairs and (best := min(pairs)) < never:
                at = pairs.index(best)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                del pairs[at]
                if at:
                    pairs[at - 1] = ranks.get((parts[at - 1], parts[at]), never)
                if at < len(pairs):
                    pairs[at] = ranks.get((parts[at], parts[at + 1]), never)
            return parts
        n = len(symbols)
        parts: list[str | None] = list(symbols)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(rank, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x in (before[i], i):
                y = after[x] if x >= 0 else -1
                if x >= 0 and y >= 0 and (rank := ranks.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (rank, x, parts[x], parts[y]))
        return [p for p in parts if p is not None]

    def stream(self, symbols: Iterable[str]) -> Iterator[str]:
        """The tokens of one word, each as soon as it is stable."""
        window: list[str] = []
        last = None
        for symbol in symbols:
            if last is not None:
                window.append(last)
                if len(window) >= self.block + self.lookahead:
                    done, width = 0, len(self.suffix)
                    limit = len(window) - self.lookahead
                    for token in self.merged(window):
                        size = len(token) - (width if width and token.endswith(self.suffix) else 0)
                        if done + size > limit:
                            break
                        done += size
                        yield token
                    del window[:done]
            last = symbol
        if last is not None:
            window.append(last + self.suffix)
            yield from self.merged(window)

    def tokens(self, symbols: list[str]) -> list[str]:
        """The tokens of a word that fits the window; it needs no stream."""
        if symbols:
            symbols[-1] += self.suffix
        return self.merged(symbols)


class WordBpe:
    """A tokenizer file of the word-end kind: NFC, white space to one space, lower case, split, merge."""

    def __init__(self, path: str, table_bytes: int = 64 << 20):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model = said["model"]
        self.vocab = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.transducer = Transducer(self.vocab, merges, model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words = [(0x80, word_pattern(0x80)), (0x250, word_pattern(0x250)), (sys.maxunicode + 1, word_pattern())]
        self.beyond = re.compile("[^\\u0000-\\u024f]")
        self.unknown = re.compile(f"[{char_class('Cn')}]")
        self.spaces = re.compile(rf"[{SPACE}]+")
        self.space = re.compile(rf"[{SPACE}]")
        letters = byte_alphabet()
        self.letters = [letters[b] for b in range(256)]
        self.known = Known(self.word, table_bytes, entry=300)
        self.path, self.library = path, None

    def normalise(self, text: str) -> str:
        if not text.isascii():
            # one character at a time, a capital sigma has one lower case
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")
        return self.spaces.sub(" ", text).lower()

    def split(self, normal: str) -> list[str]:
        if normal.isascii():
            return self.words[0][1].findall(normal)
        return self.words[1 if self.beyond.search(normal) is None else 2][1].findall(normal)

    def split_by_file(self, text: str) -> list[str]:
        """For characters that the interpreter's Unicode tables don't know yet: as the file's own rules split."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        letters = {c: b for b, c in enumerate(self.letters)}
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(letters[c] for c in piece).decode("utf-8") for piece, _ in found]

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """(part, is it a special token)."""
        if not self.cut:
            yield text, False
            return
        for i, part in enumerate(self.cut.split(text)):
            if part:
                yield part, bool(i % 2)

    def blocks(self, text: str, size: int = 1 << 16) -> Iterator[str]:
        """The text in blocks that end before white space, so that no word is cut and no character changes by its neighbours."""
        at = 0
        while at < len(text):
            end = at + size
            if end < len(text):
                found = self.space.search(text, end)
                end = found.start() if found else len(text)
            yield text[at:end]
            at = end

    def word(self, word: str) -> tuple[int, ...]:
        """The ids of a word that fits the window."""
        letters, vocab = self.letters, self.vocab
        return tuple([vocab[t] for t in self.transducer.tokens([letters[b] for b in word.encode("utf-8", "replace")])])

    def long_word(self, word: str, size: int = 1 << 12) -> Iterator[int]:
        """The ids of a word of any length, each as soon as its token is stable."""
        letters, vocab = self.letters, self.vocab
        symbols = (letters[b] for at in range(0, len(word), size) for b in word[at : at + size].encode("utf-8", "replace"))
        for token in self.transducer.stream(symbols):
            yield vocab[token]

    def block_ids(self, block: str, by_file: bool) -> Iterator[list[int]]:
        """The ids of a block, in lists of bounded length."""
        known, window = self.known, self.transducer.block // 4  # a character is four bytes at most
        words = self.split_by_file(block) if by_file else self.split(self.normalise(block))
        if max(map(len, words), default=0) < window:
            yield [i for w in words for i in known[w]]
            return
        for word in words:
            if len(word) < window:
                yield list(known[word])
                continue
            out = []
            for i in self.long_word(word):
                out.append(i)
                if len(out) >= 4096:
                    yield out
                    out = []
            yield out

    def stream(self, text: str) -> Iterator[list[int]]:
        """The ids of a whole text, in lists of bounded length, each as soon as its tokens are stable."""
        for part, special in self.pieces(text):
            if special:
                yield [self.special[part]]
                continue
            odd = not part.isascii() and self.beyond.search(part) is not None and self.unknown.search(part) is not None
            for block in [part] if odd else self.blocks(part):
                for ids in self.block_ids(block, odd):
                    if ids:
                        yield ids

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.stream(text) for i in ids]


class IncrementalDecoder:
    """Ids to text, as they come.

    ``spaced`` gives what a tokenizer file without a decoder gives: the tokens
    as they stand in the vocabulary, with one space between. Otherwise tokens are
    bytes; the word-end mark becomes a space and a character is given out as soon
    as its last byte is there. Bytes that are no UTF-8 become U+FFFD.
    """

    def __init__(self, names: dict[int, str], suffix: str = "", special: Iterable[int] = (), spaced: bool = False):
        self.names, self.suffix, self.special, self.spaced = names, suffix, set(special), spaced
        self.bytes = {c: b for b, c in byte_alphabet().items()}
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.first = True

    def push(self, token_id: int) -> str:
        name = self.names[token_id]
        if self.spaced:
            out, self.first = ("" if self.first else " ") + name, False
            return out
        if token_id in self.special:
            return self.state.decode(b"", True) + name
        ends = bool(self.suffix) and name.endswith(self.suffix)
        if ends:
            name = name[: -len(self.suffix)]
        return self.state.decode(bytes(self.bytes[c] for c in name) + (b" " if ends else b""))

    def feed(self, ids: list[int]) -> str:
        """What ``push`` gives for these ids, one after the other."""
        if not self.spaced:
            return "".join(map(self.push, ids))
        out = " ".join(map(self.names.__getitem__, ids))
        if ids and not self.first:
            out = " " + out
        self.first = self.first and not ids
        return out

    def finish(self) -> str:
        return "" if self.spaced else self.state.decode(b"", True)


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def _file_decoder(bpe: WordBpe) -> IncrementalDecoder:
    return IncrementalDecoder(bpe.names, bpe.transducer.suffix, bpe.special.values(), spaced=True)


def encode_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``ids`` (array<int>), the ids of the whole text.

    Null text is the empty text, which has no ids. Texts of any length pass through
    a window of fixed size. Repeated rows are encoded each; an empty table gives
    no rows; other columns are not looked at.
    """

    def encode(batches):
        bpe = word_bpe(tokenizer)
        for batch in small(batches):
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["_id", "ids"])

    return id_and_text(df, id_col, text_col).mapInArrow(encode, "_id long, ids array<int>").withColumnRenamed("_id", id_col)


def decode_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids", spaced: bool = False) -> DataFrame:
    """Per row: id and ``decoded``, by the state machine.

    Null or empty ids give the empty text; repeated rows are decoded each; an
    empty table gives no rows; other columns are not looked at.
    """

    def decode(batches):
        bpe = word_bpe(tokenizer)
        for batch in small(batches):
            out = []
            for ids in batch.column(1).to_pylist():
                machine = IncrementalDecoder(bpe.names, bpe.transducer.suffix, bpe.special.values(), spaced)
                out.append(machine.feed(ids or []) + machine.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["_id", "decoded"])

    rows = df.select(column_of(df, id_col).cast("long").alias("_id"), column_of(df, ids_col).alias("_ids"))
    return rows.mapInArrow(decode, "_id long, decoded string").withColumnRenamed("_id", id_col)


def digests_of(bpe: WordBpe, text: str) -> tuple[int, str, str]:
    """Number of ids, digest of the ids, digest of what the state machine decodes from them.

    Both digests are fed as ids become stable; neither the ids nor the decoded
    text of a whole document are ever held.
    """
    n, told, decoded, machine, gap = 0, hashlib.sha256(), hashlib.sha256(), _file_decoder(bpe), ""
    for ids in bpe.stream(text):
        n += len(ids)
        told.update((gap + " ".join(map(str, ids))).encode())
        decoded.update(machine.feed(ids).encode())
        gap = " "
    decoded.update(machine.finish().encode())
    return n, told.hexdigest(), decoded.hexdigest()


def encode_digests(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 (what the tokenizer file's own decoding gives).

    Encodes and decodes in one pass and carries no ids out of it. Same cases as
    ``encode_documents``.
    """

    def digests(batches):
        bpe = word_bpe(tokenizer)
        for batch in small(batches):
            done = [digests_of(bpe, text) for text in batch.column(1).to_pylist()]
            n, ids, decoded = ([d[k] for d in done] for k in range(3))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = id_and_text(df, id_col, text_col)
    return rows.mapInArrow(digests, "_id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("_id", id_col)
