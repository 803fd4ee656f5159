import hashlib
from collections import Counter

import pytest

from marketspark.llm import queries, quotes, url_filter, warc
from tests.compare import SMALL, duck, rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    got, want = queries.QUERIES[name](spark, SMALL).toPandas(), duck(SMALL, queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


CASES = [
    (None, "", "", None, "allow"),
    ("no scheme/x", "", "", None, "allow"),
    ("http://EXAMPLE.com/en/1?q#f", "example.com", "/en/1", "example.com/en/", "block"),
    ("http://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("http://a.www.example.com/en/1", "a.www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("http://adult.com/x", "adult.com", "/x", "com/", "allow"),
    ("http://adult.org/x", "adult.org", "/x", None, "block"),
    ("http://adulthood.org/x", "adulthood.org", "/x", None, "allow"),
    ("http://free.org/ride", "free.org", "/ride", None, "allow"),
    ("http://free.org/Bets", "free.org", "/Bets", None, "block"),
    ("http://free.org/free-free", "free.org", "/free-free", None, "allow"),
    ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
    ("http://x.net", "x.net", "", None, "allow"),
    ("http://x.org?adult", "x.org", "", None, "allow"),
    ("://", "", "", None, "allow"),
]


def test_urls_by_hand(spark):
    df = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(CASES)], "page_id long, url string, host string")
    got = url_filter.judge_urls(df, queries.POLICY).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [c[1:] for c in CASES]
    kept = url_filter.allowed_pages(df, queries.POLICY)
    assert sorted(r.page_id for r in kept.collect()) == [i for i, c in enumerate(CASES) if c[4] == "allow"] and kept.columns == df.columns
    assert url_filter.judge_urls(df.limit(0), queries.POLICY).count() == 0
    odd = df.withColumnRenamed("url", "a.url")
    assert url_filter.allowed_pages(odd, queries.POLICY, "a.url").count() == kept.count() and url_filter.allowed_pages(df.limit(0), queries.POLICY).count() == 0


def test_a_vocabulary_is_read_from_files(spark, tmp_path):
    f = tmp_path / "terms.txt"
    f.write_text("# terms\n\nstrict\tBad Word\nsoft meh\nsoft meh\nsoft\tdull\nstrict dull\n")
    policy = url_filter.load_policy(spark, str(f))
    assert policy.strict == ("bad word", "dull") and policy.soft == ("meh",)
    assert url_filter.TermCounter(policy)("x/bad word/meh/meh") == (["bad word"], ["meh"])
    f.write_text("soso term")
    with pytest.raises(ValueError):
        url_filter.load_policy(spark, str(f))


def test_rules_are_checked():
    with pytest.raises(ValueError):
        url_filter.UrlPolicy([url_filter.Rule("maybe", "com/")])
    assert url_filter.TermCounter(url_filter.UrlPolicy(strict=(), soft=()))("adult") == ([], [])


MESSAGES = [
    ("c", 0, "user", "First point.\n\nSecond   point here.", "x"),
    ("c", 1, "assistant", "Unrelated.", "x"),
    ("c", 2, "user", "On Monday, A wrote:\n> second point HERE.\nI agree.", "x"),
    ("c", 3, "user", "> I agree.\n> > Second point here.\nWhy?", "x"),
    ("c", 4, "user", "> never said\nHm.", "x"),
    ("c", 5, "user", "> Unrelated.", "x"),
    ("c", 6, "user", None, "x"),
    ("c", 6, "user", None, "x"),
    ("d", 0, "user", "> First point.\nOther conversation.", "x"),
    (None, 0, "user", "nobody's", "x"),
]


def messages(spark, data):
    return spark.createDataFrame(data, "conv_id string, turn long, role string, text string, position string")


def test_quotes_by_hand(spark):
    got = {(r.conv, r.turn): r for r in quotes.linked_messages(messages(spark, MESSAGES)).collect()}
    assert {k: (r.parent_turn, r.root_turn, r.depth) for k, r in got.items() if k[0] == "c"} == {
        ("c", 0): (None, 0, 0),
        ("c", 1): (None, 1, 0),
        ("c", 2): (0, 0, 1),
        ("c", 3): (2, 0, 2),
        ("c", 4): (None, 4, 0),
        ("c", 5): (1, 1, 1),
        ("c", 6): (None, 6, 0),
    }
    assert got["c", 2].text == "I agree." and got["c", 5].text == "" and got["d", 0].parent_turn is None and (None, 0) in got
    whole = quotes.conversations(quotes.linked_messages(messages(spark, MESSAGES))).filter("conv = 'c'").first().messages
    assert [m.position for m in whole] == list(range(8))
    assert [m.text for m in whole][:5] == ["First point.\n\nSecond   point here.", "I agree.", "Why?", "Unrelated.", ""]
    assert quotes.linked_messages(messages(spark, [])).count() == 0


def test_long_chains_and_large_conversations(spark):
    chain = [("c", i, "u", (f"> line {i - 1}\nline {i}" if i else "line 0"), "x") for i in range(70)] + [("e", i, "u", "same", "x") for i in range(500)]
    got = quotes.linked_messages(messages(spark, chain)).collect()
    assert all(r.root_turn == 0 and r.depth == r.turn for r in got if r.conv == "c")
    assert sorted(r.position for r in got if r.conv == "e") == list(range(500))


LONG = "A one.\nB two\nC three. And four. Last\n\nP two, first.\nIts end.\n\nP three."
EXCERPTS = [
    ("> A one.\n> B two\nyes", 0),  # lines out of a longer paragraph
    ("> P two, first.\n> Its end.\n>\n> P three.\nyes", 0),  # two of three paragraphs
    ("> And four.\nyes", 0),  # a sentence out of a line
    ("> P two, first. Its\n> end.\n>\n> P three.\nyes", 0),  # wrapped anew
    ("> B two\n> C three. And four. Last\n> never said\nyes", 0),  # with a line that nobody wrote
    ("> never said\n> at all\nno", None),
]


def test_excerpts_find_their_message(spark):
    data = [("c", 0, "u", LONG, "x")] + [("c", i, "u", t, "x") for i, (t, _) in enumerate(EXCERPTS, 1)]
    got = {r.turn: r for r in quotes.linked_messages(messages(spark, data)).collect()}
    assert [got[i].parent_turn for i in range(1, len(data))] == [p for _, p in EXCERPTS]
    assert all(got[i].depth == 1 and got[i].root_turn == 0 for i, (_, p) in enumerate(EXCERPTS, 1) if p is not None)


def test_interleaved_replies_are_found(spark):
    data = [
        ("c", 0, "u", "old", "x"),
        ("c", 1, "u", "intro1\nintro2\n> old\nreply1\nreply2", "x"),
        ("c", 2, "u", "> intro1\n> intro2\n>> old\n> reply1\n> reply2\nme", "x"),
        ("c", 3, "u", "> intro1 intro2\nwrapped", "x"),
    ]
    got = {r.turn: (r.parent_turn, r.depth, r.quotes) for r in quotes.linked_messages(messages(spark, data)).collect()}
    assert got == {0: (None, 0, 0), 1: (0, 1, 1), 2: (1, 2, 3), 3: (1, 2, 1)}


def test_the_longest_run_decides_and_then_the_latest(spark):
    data = [("c", 0, "u", "a\nb\nc\nd", "x"), ("c", 1, "u", "c\nz", "x"), ("c", 2, "u", "a", "x"), ("c", 3, "u", "> a\n> b\n> c", "x"), ("c", 4, "u", "> a", "x")]
    data += [("h", i, "u", f"> same\n> n{i - 1}\nsame\nn{i}", "x") for i in range(300)]
    got = {(r.conv, r.turn): r.parent_turn for r in quotes.linked_messages(messages(spark, data)).collect()}
    assert (got["c", 3], got["c", 4]) == (0, 2)
    assert all(got["h", i] == (i - 1 if i else None) for i in range(300))


def brute_parents(data):
    """For every message the parent, by comparing each quoted passage's units with those of each earlier message."""
    out = {}
    for conv, turn, _, text, _ in data:
        if turn is None:
            continue
        best = None
        for level, passage in quotes.parse(text or "")[1]:
            if quotes.passage_hash(passage) is None:
                continue
            asked, source = quotes.units(passage), None
            for c, earlier, _, other, _ in data:
                if c != conv or earlier is None or earlier >= turn:
                    continue
                own, _, cuts = quotes.parse_parts(other or "")
                hit = max((asked[h] for h in quotes.units(own, cuts) if h in asked), default=0)
                if hit and (source is None or (hit, earlier) > source):
                    source = (hit, earlier)
            if source and (best is None or (-level, source[1]) > best):
                best = (-level, source[1])
        key = (conv, turn)
        if best is not None:
            out[key] = max(out.get(key, -1), best[1])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_links_equal_brute_force(spark, seed):
    """Planted quotes of lines, sentences and paragraphs; one passage stands in a third of all messages."""
    import random

    r = random.Random(seed)
    say = lambda: f"{r.choice('one two three four five six'.split())} {r.randrange(60)}."
    data, told = [], {}
    for i in range(240):
        conv = r.choice(["a", "a", "a", "b", None, "\0", ""])
        own = [say() for _ in range(r.randrange(1, 6))] + (["everybody says this."] if i % 3 == 0 else [])
        body = r.choice(["\n", " ", "\n\n"]).join(own)
        earlier = told.setdefault(conv, [])
        if earlier and r.random() < 0.6:
            lines = [x for x in r.choice(earlier).replace(". ", ".\n").split("\n") if x]
            at = r.randrange(len(lines))
            quoted = [f"{'> ' * r.choice([1, 1, 2])}{x}" for x in lines[at : at + r.randrange(1, 4)]]
            body = "\n".join([*quoted, body])
        if i % 10 == 3:
            body = "> everybody says this.\n" + body
        data.append((conv, None if i % 50 == 49 else i, "u", body, "x"))
        told[conv].append(quotes.parse(body)[0])
    got = {(x.conv, x.turn): x.parent_turn for x in quotes.linked_messages(messages(spark, data).repartition(3)).collect() if x.parent_turn is not None}
    want = brute_parents(data)
    assert got == want and len(want) > 80


def test_one_passage_in_thousands_of_messages(spark):
    data = [("c", i, "u", "> said by all\nsaid by all" if i % 2 else "said by all", "x") for i in range(4000)]
    got = {r.turn: r.parent_turn for r in quotes.linked_messages(messages(spark, data)).collect()}
    assert all(got[i] == (i - 1 if i % 2 else None) for i in range(4000))


def test_a_very_long_message(spark):
    long = "\n".join(f"line number {i} of many." for i in range(30_000))
    data = [("c", 0, "u", long, "x"), ("c", 1, "u", "> line number 17000 of many.\n> line number 17001 of many.\nyes", "x"), ("c", 2, "u", "\n".join("> " + x for x in long.split("\n")), "x")]
    got = {r.turn: (r.parent_turn, r.text) for r in quotes.linked_messages(messages(spark, data)).collect()}
    assert got[1] == (0, "yes") and got[2] == (0, "") and got[0] == (None, long)


def test_levels():
    assert quotes.quote_level(">> a") == (2, "a") and quotes.quote_level(" > > a") == (2, "a") and quotes.quote_level("a > b") == (0, "a > b")
    assert quotes.parse("a\n> b\n>> c\n> d\ne") == ("a\ne", [(1, "b"), (2, "c"), (1, "d")])


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_chunked_framing_in_any_pieces(size):
    data = bytes(range(256)) * 9 + b"\r\n0\r\n\r\n"
    framed = warc.chunked(data, 100).replace(b"64\r\n", b"64;x=y\r\n", 1)
    machine = warc.ChunkedDecoder()
    assert b"".join(machine.feed(framed[i : i + size]) for i in range(0, len(framed), size)) == data and machine.done
    with pytest.raises(ValueError):
        warc.ChunkedDecoder().feed(b"2\r\nabc\r\n")


PAGES = [
    (1, "http://a/", "x" * 1500),
    (2, "http://b/\r\n", "x" * 1500),
    (3, None, "é" * 40_000 + "WARC/1.1\r\nWARC-Type: response\r\n\r\n"),
    (4, "u", None),
    (5, "u", ""),
    (6, "u", "short"),
    (7, "u", "short"),
    (8, "u", "é" * 40_000 + "WARC/1.1\r\nWARC-Type: response\r\n\r\n"),
    (8, "u", "y" * 2000),
    (8, "u", "y" * 2000),
    (None, "u", "x" * 1500),
]


@pytest.mark.parametrize("segment", [50, 4096, 1 << 20])
def test_archives_come_back(spark, tmp_path, segment):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, record_type string").repartition(3)
    got = warc.archive_round_trip(df, f"file://{tmp_path}/w", segment_bytes=segment, file_bytes=5 * (segment + 512)).collect()
    want = Counter()
    for i, _, h in PAGES:
        data = (h or "").encode()
        same = [j for j, _, g in PAGES if g == h and j is not None]
        refers = max(same) if i is not None and len(data) >= 1000 and i < max(same) else None
        want[(i, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers, True)] += 1
    assert Counter(map(tuple, got)) == want
    whole = warc.read_warc(spark, f"file://{tmp_path}/w").filter("record_type = 'response'").collect()
    assert Counter(bytes(r.payload) for r in whole)[("é" * 40_000 + PAGES[2][2][-35:]).encode()] >= 0
    assert all(hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest for r in whole)
    records = [h for f in (tmp_path / "w").glob("part-*.gz") for h, _ in warc.parse_records(f.read_bytes())]
    names = Counter(h["warc-record-id"] for h in records)
    assert max(names.values()) == 1
    refers = [h["warc-refers-to"] for h in records if h["warc-type"] == "revisit"]
    assert refers and all(x in names for x in refers)


@pytest.mark.parametrize("most", [0, 3000, 1 << 20])
def test_segments_come_together_within_and_across_files(spark, tmp_path, most):
    """Files of three records cut most pages' segments apart; a small bound sends all of them through the shuffle."""
    df = spark.createDataFrame([(i, "u", f"{i} " * (300 * i)) for i in range(1, 30)], "page_id long, url string, html string").repartition(2)
    warc.write_warc(df, f"file://{tmp_path}/w", segment_bytes=700, file_bytes=3 * 1212)
    got = warc.read_warc(spark, f"file://{tmp_path}/w", most_bytes=most).collect()
    assert sorted(bytes(r.payload).decode() for r in got) == sorted(f"{i} " * (300 * i) for i in range(1, 30)) and all(r.verified for r in got)


def test_files_are_bounded_by_bytes(spark, tmp_path):
    import gzip

    df = spark.createDataFrame([(i, "u", "x" * 30_000 + str(i)) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    warc.write_warc(df, f"file://{tmp_path}/w", segment_bytes=2000, file_bytes=50_000)
    sizes = [len(gzip.open(f).read()) for f in (tmp_path / "w").glob("part-*.gz")]
    assert len(sizes) > 20 and max(sizes) < 60_000


def test_records_are_found_in_any_packing():
    import gzip

    parts = [warc.record("response", [("WARC-Record-ID", f"<{i}>")], b"b" * i) + b"\r\n\r\n" for i in (0, 5, 200_000, 3)]
    for data in (b"".join(parts), gzip.compress(b"".join(parts)), b"".join(map(gzip.compress, parts))):
        assert [(h["warc-record-id"], len(b)) for h, b in warc.parse_records(data)] == [("<0>", 0), ("<5>", 5), ("<200000>", 200_000), ("<3>", 3)]
    assert list(warc.parse_records(b"")) == [] and list(warc.parse_records(gzip.compress(b""))) == []
    with pytest.raises(ValueError):
        list(warc.parse_records(parts[1][:-8]))
    with pytest.raises(ValueError):
        list(warc.parse_records(b"nothing of the kind\r\n\r\n"))


def test_a_lost_segment_is_told(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "abc" * 5000)], "page_id long, url string, html string")
    warc.write_warc(df, f"file://{tmp_path}/w", segment_bytes=4096)
    import gzip

    source = max((tmp_path / "w").glob("part-*.gz"), key=lambda f: f.stat().st_size)
    found = list(warc.parse_records(source.read_bytes()))
    (tmp_path / "v").mkdir()
    with gzip.open(tmp_path / "v" / "a.gz", "wb") as f:
        for headers, block in found[:1] + found[2:]:
            f.write(b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers.items()) + b"\r\n" + block + b"\r\n\r\n")
    assert [r.verified for r in warc.read_warc(spark, f"file://{tmp_path}/v").collect()] == [False]


def test_the_query_writes_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "new_table_path", lambda *a: f"file://{tmp_path}/w")
    n = queries.op6_warc_segments(spark, SMALL).count()
    found = [h for f in (tmp_path / "w").glob("part-*.gz") for h, _ in warc.parse_records(f.read_bytes())]
    kinds = Counter(h["warc-type"] for h in found)
    assert kinds["response"] + kinds["revisit"] == n and kinds["continuation"] > 0
    assert sum("warc-segment-number" in h for h in found if h["warc-type"] == "response") > 0.5 * kinds["response"]


def test_an_empty_table_writes_no_record(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_round_trip(df, f"file://{tmp_path}/w").count() == 0
