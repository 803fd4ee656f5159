import hashlib
import json
import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from marketspark.llm import bpe, packing  # noqa: E402
from tests.llm.conftest import HARD, prose  # noqa: E402

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def library(path):
    t = tokenizers.Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


TEXTS = [t or "" for _, t in HARD] + ["<|startoftext|>a<|endoftext|>b", "\x1c\x1d a", "İI", "é é", "Ᲊx", "a" * 4000, "!?" * 900, "  \n\n  x  "]


def test_encoding_equals_the_library():
    t, mine = library(WORD), bpe.WordBpe(WORD)
    for text in TEXTS:
        e = t.encode(text, add_special_tokens=False)
        assert mine.encode(text) == e.ids
        assert bpe._file_decoder(mine).feed(e.ids) == t.decode(e.ids, skip_special_tokens=False)


def test_every_character_is_encoded_as_the_library_does():
    t, mine = library(WORD), bpe.WordBpe(WORD)
    for start in range(0, 0x3000, 64):
        text = " ".join(f"a{chr(c)}b {chr(c)}" for c in range(start, start + 64))
        assert t.encode(text, add_special_tokens=False).ids == mine.encode(text), hex(start)


def test_a_stream_emits_what_the_whole_word_gives():
    machine = bpe.WordBpe(WORD).transducer
    machine.block = 8
    r = random.Random(3)
    parts = [x.replace("</w>", "") for x in list(machine.vocab)[512:6000]]
    for _ in range(40):
        word = list("".join(r.choice(parts) for _ in range(300)))
        assert list(machine.stream(word)) == machine.merged([*word[:-1], word[-1] + "</w>"])


@pytest.mark.parametrize("seed", range(30))
def test_the_lookahead_suffices_for_random_merge_lists(seed):
    r = random.Random(seed)
    tokens, merges = list("abc"), []
    while len(merges) < 25:
        pair = (r.choice(tokens), r.choice(tokens))
        if pair not in merges and len(pair[0] + pair[1]) <= 8:
            merges.append(pair)
            if pair[0] + pair[1] not in tokens:
                tokens.append(pair[0] + pair[1])
    machine = bpe.Transducer({t: i for i, t in enumerate(tokens)}, merges)
    machine.block = 1
    for _ in range(60):
        word = [r.choice("abc") for _ in range(r.randrange(1, 120))]
        assert list(machine.stream(word)) == machine.merged(word)


def test_the_window_stays_small():
    machine = bpe.WordBpe(WORD).transducer
    most, plain = 0, machine.merged

    def watched(symbols):
        nonlocal most
        most = max(most, len(symbols))
        return plain(symbols)

    machine.merged = watched
    assert "".join(machine.stream("abcdefgh" * 5000)).startswith("abcdefgh"[:2])
    assert most <= machine.block + machine.lookahead + 1


def test_decoding_gives_bytes_as_they_end():
    mine = bpe.WordBpe(WORD)
    machine = bpe.IncrementalDecoder(mine.names, "</w>", mine.special.values())
    ids = mine.encode("naïve 漢字 don't")
    out = [machine.push(i) for i in ids]
    assert "".join(out) + machine.finish() == "naïve 漢字 don 't "


def test_ids_decode_alike_one_or_several_at_a_time():
    mine = bpe.WordBpe(WORD)
    ids = mine.encode("naïve 漢字 <|endoftext|> don't 𝒳")
    for spaced in (True, False):
        make = lambda: bpe.IncrementalDecoder(mine.names, "</w>", mine.special.values(), spaced)  # noqa: E731, B023
        one, several = make(), make()
        want = "".join(map(one.push, ids)) + one.finish()
        assert several.feed([]) + several.feed(ids[:1]) + several.feed([]) + several.feed(ids[1:]) + several.finish() == want


def test_memory_does_not_grow_with_the_text():
    import tracemalloc

    mine = bpe.WordBpe(WORD, table_bytes=1 << 20)
    text = prose(5, 40_000)
    bpe.digests_of(mine, text)
    most = []
    for times in (4, 40):
        long = " ".join([text] * times)
        tracemalloc.start()
        bpe.digests_of(mine, long)
        most.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert len(long) > 8_000_000 and most[1] < 1.2 * most[0] and most[1] < 0.6 * len(long)


def test_a_word_of_a_million_letters_passes_in_the_window():
    mine = bpe.WordBpe(WORD)
    most, plain = 0, mine.transducer.merged

    def watched(symbols):
        nonlocal most
        most = max(most, len(symbols))
        return plain(symbols)

    mine.transducer.merged = watched
    text = "abcdefgh" * 40_000
    lists = list(mine.stream(text))
    assert max(map(len, lists)) <= 4096 and most <= mine.transducer.block + mine.transducer.lookahead + 1
    assert [i for x in lists for i in x] == library(WORD).encode(text, add_special_tokens=False).ids


def test_blocks_do_not_show():
    t, mine = library(WORD), bpe.WordBpe(WORD)
    for text in ("\n".join(["x\u0301 I'm éa 12!? "] * 9), "a\u2003\u0301b\u3000c" * 7, "no-space" * 9):
        for size in (1, 5, 64):
            mine.blocks = lambda x, n=size: bpe.WordBpe.blocks(mine, x, n)
            assert mine.encode(text) == t.encode(text, add_special_tokens=False).ids


def test_digests_decode_the_ids():
    mine = bpe.WordBpe(WORD)
    got = bpe.digests_of(mine, "hello world")
    assert got[0] == 2 and got[2] == hashlib.sha256(b"hello</w> world</w>").hexdigest()
    mine.names = mine.names | {mine.vocab["world</w>"]: "moon</w>"}  # as if the id were wrong
    assert bpe.digests_of(mine, "hello world")[2] == hashlib.sha256(b"hello</w> moon</w>").hexdigest()


def test_document_forms(spark, make, hard):
    t = library(WORD)
    got = bpe.encode_digests(make(hard), WORD).collect()
    want = sorted((str(i), len(e := t.encode(x or "", add_special_tokens=False).ids), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(t.decode(e, skip_special_tokens=False).encode()).hexdigest()) for i, x in hard)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    back = bpe.decode_documents(bpe.encode_documents(make([(1, "hello World"), (2, None)]), WORD), WORD)
    assert sorted(map(tuple, back.collect())) == [(1, "hello world "), (2, "")]
    assert bpe.encode_digests(make([]), WORD).count() == 0


def test_byte_ids_equal_the_library():
    t, mine = library(BYTE), packing.ByteBpe(BYTE)
    assert mine.encode is not None
    for text in [*TEXTS, *(f"x{chr(c)} {chr(c)}{chr(c)}y" for c in range(0x300))]:
        assert t.encode(text, add_special_tokens=False).ids == mine.ids(text).tolist()


def test_ranks_are_refused_where_ids_do_not_follow_merges(tmp_path):
    said = json.load(open(BYTE, encoding="utf-8"))
    said["model"]["merges"] = said["model"]["merges"][::-1]
    f = tmp_path / "t.json"
    f.write_text(json.dumps(said))
    assert packing.byte_ranks(str(f)) is None


@pytest.mark.parametrize("seed", range(20))
def test_best_fit_equals_brute_force(seed):
    r = random.Random(seed)
    size = r.choice([7, 20, 64])
    lengths = np.array([r.randint(1, size) for _ in range(r.randrange(1, 90))])
    sequence, offset, n = packing.best_fit_decreasing(lengths, size)
    rooms = []
    for x in sorted(lengths.tolist(), reverse=True):
        fits = [room for room in rooms if room >= x]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else size) - x)
    assert sorted(size - lengths[sequence == s].sum() for s in range(n)) == sorted(rooms)
    for s in range(n):
        at = 0
        for start, x in sorted(zip(offset[sequence == s], lengths[sequence == s])):
            assert start == at
            at += x


def test_packing_is_complete_and_tight(make, hard):
    t = library(BYTE)
    rows = [(i, x) for i, x in hard if i != 3] + [(200 + i, prose(i, 20 + 37 * i % 900)) for i in range(150)]
    got = packing.pack_documents(make(rows).filter("doc_id is not null").repartition(2), BYTE, seq_len=256).toPandas()
    total = 0
    for i, x in rows:
        if i is None:
            continue
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4")
        total += len(ids)
        at = 0
        for p in got[got.doc_id == i].sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 256
    assert total / (256 * got.sequence_id.nunique()) > 0.9
    assert packing.pack_documents(make([]), BYTE).count() == 0


def test_how_the_input_is_cut_does_not_show_in_the_padding(make):
    rows = [(i, prose(i, 5 + 53 * i % 700)) for i in range(600)]
    full = []
    for parts in (1, 32):
        got = packing.pack_documents(make(rows).repartition(parts), BYTE).toPandas()
        assert got.groupby("doc_id").length.sum().eq(got.groupby("doc_id").doc_tokens.first()).all()
        for _, s in got.groupby("sequence_id"):
            s = s.sort_values("offset")
            assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 2048
        full.append(got.length.sum() / (2048 * got.sequence_id.nunique()))
    assert min(full) > 0.98


def test_packing_of_repeated_and_null_ids(make, hard):
    got = packing.pack_documents(make(hard).repartition(4), BYTE).collect()
    t = library(BYTE)
    tokens = lambda x: len(t.encode(x or "", add_special_tokens=False).ids) + 1
    assert sum(r.length for r in got) == sum(tokens(x) for _, x in hard)
    assert sum(r.doc_id == 3 for r in got) == 2 and sum(r.doc_id is None for r in got) == 2
    places = {(r.sequence_id, r.offset) for r in got}
    assert len(places) == len(got)
