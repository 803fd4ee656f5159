import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from marketspark.llm import components, merkle, minhash, quality, queries
from tests.compare import SMALL
from tests.llm.conftest import prose

TEXT = "\n".join(prose(i, 12) + "." for i in range(40))


def test_equal_texts_have_equal_roots_and_edits_are_found():
    a = merkle.fingerprint(TEXT)
    assert a == merkle.fingerprint(TEXT) and merkle.likeness(a, a) == 1
    at = len(TEXT) // 2
    b = merkle.fingerprint(TEXT[:at] + "EDIT" + TEXT[at + 4 :])
    assert a[:32] != b[:32] and 0.9 < merkle.likeness(a, b) < 1
    spans = merkle.differing_spans(a, b)
    assert any(s <= at < e for s, e in spans) and sum(e - s for s, e in spans) < 600
    assert merkle.differing_spans(a, a) == []


@pytest.mark.parametrize("text", ["", "\n", "\n\n", "x", "a|b;c,d:1", "no end " * 400, "...", "é. x"])
def test_leaves_hold_every_character(text):
    p = merkle.fingerprint(text)
    assert sum(n for _, n in merkle.leaves_of(p)) == len(text) - text.count("\n")
    assert merkle.likeness(p, merkle.fingerprint(text + "!")) < 1


def test_next_documents_equal_brute_force(make, hard):
    rows = hard + [(20 + i, prose(i, 5 + i)) for i in range(40)]
    for parts in (1, 3, 16):
        got = merkle.compare_with_next(make(rows).repartition(5), parts=parts).collect()
        order = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0]), reverse=True)
        order = [x for i in sorted({-(2**63) if r[0] is None else r[0] for r in rows}, reverse=True) for x in sorted((r for r in rows if (-(2**63) if r[0] is None else r[0]) == i), key=lambda r: (r[1] or "").encode())]
        want = Counter()
        for k, (i, t) in enumerate(order):
            t, n = t or "", order[(k + 1) % len(order)][1] or ""
            half = len(t) // 2
            e = t[: len(t) - half] + n[:half]
            f, g, h = (merkle.fingerprint(x) for x in (t, e, n))
            spans = merkle.differing_spans(f, g)
            want[(i, len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, merkle.likeness(f, g), merkle.likeness(f, h), *((spans[0][0], spans[-1][1]) if spans else (None, None)))] += 1
        assert Counter(map(tuple, got)) == want


@pytest.mark.parametrize("seed", range(40))
def test_differing_branches_cover_every_edit(seed):
    """All characters outside the spans are found in the other text in the same order; edits are inside."""
    import random

    r = random.Random(seed)
    lines = [r.choice(["", "same line.", prose(r.randrange(99), r.randrange(1, 60)) + r.choice([".", "", "! And on"])]) for _ in range(r.randrange(1, 60))]
    other = list(lines)
    for _ in range(r.randrange(1, 5)):
        at = r.randrange(len(other) + 1)
        r.choice([lambda: other.insert(at, f"new {seed}."), lambda: other.pop(at - 1) if len(other) > 1 else None, lambda: other.__setitem__(at - 1, other[at - 1] + " edited")])()
    a, b = "\n".join(lines), "\n".join(other)
    spans = merkle.differing_spans(merkle.fingerprint(a), merkle.fingerprint(b))
    assert bool(spans) == (a != b)
    at = here = 0
    for start, end in [*spans, (len(a), len(a))]:
        for kept in a[at:start].split("\n"):
            found = b.find(kept, here)
            assert found >= 0, (seed, kept)
            here = found
        at = max(at, end)


def test_a_node_stands_for_its_branch():
    parts = merkle.fingerprint(TEXT).partition("/")[2].split(";")
    sizes = [int(x.partition("=")[0].rpartition(":")[2]) for x in parts]
    assert sum(sizes) + len(sizes) - 1 == len(TEXT) and len(parts) > 2
    changed = merkle.fingerprint(TEXT + "!").partition("/")[2].split(";")
    assert [x.partition("=")[0] for x in changed][:-1] == [x.partition("=")[0] for x in parts][:-1]


def test_an_edit_of_the_last_half_is_located(make):
    text = "\n".join(prose(i, 12) + "." for i in range(60))
    got = {r.doc_id: r for r in merkle.compare_with_next(make([(2, text), (1, prose(1000, 900))])).collect()}
    half = len(text) - len(text) // 2
    assert half - 300 < got[2].edited_from <= half and got[2].edited_to == len(text)


def test_fingerprints_of_few_rows(make):
    assert merkle.compare_with_next(make([])).count() == 0 and merkle.fingerprints(make([])).count() == 0
    one = merkle.compare_with_next(make([(1, "abcd")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1
    assert merkle.fingerprints(make([(1, None)])).first().fingerprint == merkle.fingerprint("")


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op1_rule_ensemble(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95 and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.7)).all()


def test_rules_compile_to_the_same_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.random((600, len(quality.STATS)))
    y = ((x[:, 5] > 0.6) | ((x[:, 2] < 0.3) & (x[:, 7] > 0.5))).astype(float)
    model = quality.fit_rules(x, y)
    assert ((model.predict(x) > 0.5) == y).mean() > 0.97 and 0 < len(model.rules) < 200 and all(str(r) for r in model.rules)
    from pyspark.sql import functions as F

    df = spark.createDataFrame(x[:50].tolist(), ", ".join(f"{n} double" for n in quality.STATS))
    np.testing.assert_allclose([r[0] for r in df.select(model.column(F.col)).collect()], model.predict(x[:50]), rtol=1e-9)


def test_quality_of_odd_tables(spark, make, hard):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(make(hard), none)
    got = quality.score_documents(make(hard), model).collect()
    assert len(got) == len(hard) and all(r.score == pytest.approx(0.5) for r in got)
    assert quality.score_documents(make([]), model).count() == 0
    labels = spark.createDataFrame([(None, 1, 0), (7, 1, 0), (8, 0, 0), (7, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    quality.train(make(hard), labels)
    kept = quality.keep_good(make(hard), model, threshold=0.0)
    assert kept.columns == make(hard).columns and kept.count() == len(hard)
    assert quality.statistics("") == (0.0,) * len(quality.STATS)


def brute_classes(rows, threshold=0.8):
    docs = [(i, t or "") for i, t in rows]
    n = len(docs)
    sh = [minhash.shingles(t) for _, t in docs]
    df = Counter(x for h, _ in sh for x in h.tolist())
    idf = {h: float(minhash.idf_of_share(np.array(c / n))) for h, c in df.items() if c > minhash.COMMON * n}
    w = [(h, c * np.array([idf.get(x, 2.0) for x in h.tolist()])) for h, c in sh]
    words = [" ".join(t.lower().split()) for _, t in docs]
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    total = [float(x[1].sum()) for x in w]
    for a in range(n):
        for b in range(a):
            if docs[a][0] is None or docs[b][0] is None or find(a) == find(b):
                continue
            if words[a] != words[b] and docs[a][0] != docs[b][0] and min(total[a], total[b]) < threshold * max(total[a], total[b]):
                continue
            if words[a] == words[b] or docs[a][0] == docs[b][0] or minhash.weighted_jaccard(w[a], w[b]) >= threshold:
                root[find(a)] = find(b)
    out = defaultdict(list)
    for a, (i, _) in enumerate(docs):
        if i is not None:
            out[find(a)].append(i)
    return sorted((i, min(ids)) for ids in out.values() for i in ids)


def edited(text, seed, share):
    import random

    r = random.Random(seed)
    words = text.split()
    for _ in range(max(1, int(len(words) * share))):
        words[r.randrange(len(words))] = f"edit{r.randrange(10**6)}"
    return " ".join(words)


def test_classes_equal_brute_force(make, hard):
    rows = hard + [(100 + i, prose(i % 25, 200)) for i in range(60)]
    rows += [(300 + i, edited(prose(500 + i // 6, 300), i, 0.004 * (i % 8))) for i in range(90)]
    rows += [(600 + i, edited(prose(900, 250), i, 0.015)) for i in range(60)]
    rows += [(800 + i, prose(901, 60) + " " + prose(2000 + i, 120)) for i in range(40)]
    rows += [(900 + i, edited(prose(2, 20_000), i, 0.002 * i)) for i in range(4)]
    got = minhash.near_duplicates(make(rows).repartition(5))
    found = sorted((r.doc_id, r.class_id) for r in got.collect() if r.doc_id is not None)
    assert found == brute_classes(rows)
    assert sum(r.kept for r in got.collect() if r.doc_id is None) == 2
    kept = minhash.keep_one(make(rows))
    assert kept.columns == make(rows).columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got.collect() if r.kept}


def test_recall_on_documents(spark):
    """Of all pairs that brute force links, nine in ten at least lie in one class; no class but of linked texts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = dict(brute_classes(rows))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert len(got) == len(rows) and max(len(t or "") for _, t in rows) > 30_000
    copies = [i for i in want if want[i] != i]
    assert len(copies) > 50 and sum(got[i] == want[i] for i in copies) >= 0.9 * len(copies)
    whole = defaultdict(set)
    for i, c in got.items():
        whole[c].add(want[i])
    assert all(len(x) == 1 for x in whole.values())


def test_near_duplicates_of_few_rows(make):
    assert minhash.near_duplicates(make([])).count() == 0
    assert [tuple(r) for r in minhash.near_duplicates(make([(1, "a b")])).collect()] == [(1, 1, True)]
    assert minhash.keep_one(make([])).count() == 0


def test_samples_agree_as_often_as_weights_overlap():
    rng = np.random.default_rng(2)
    h = np.sort(rng.integers(1, 2**63, 400).astype(np.uint64))
    wa, wb = rng.choice([1.3, 2.0, 4.0], 400), rng.choice([1.3, 2.0, 4.0], 400)
    sampler = minhash.Icws(2000, seed=9)
    a, b = sampler.bands([(h, wa), (h, wb)], 2000, 1)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((a == b).mean() - want) < 0.04
    assert (sampler.bands([(h, wa)], 2000, 1)[0] == a).all()
    plain = np.full(400, 2.0)
    c, e = sampler.bands([(h, plain), (h[:300], plain[:300])], 2000, 1)
    assert abs((c == e).mean() - 0.75) < 0.04


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    got = components.components(spark.createDataFrame([*chain, *star, (5, 5), (2, 1)], "a long, b long"))
    roots = dict(map(tuple, got.collect()))
    assert roots == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(200)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SMALL).toPandas()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "MinHash near-dedup", "packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    kept = set(out.doc_id)
    assert kept < set(docs.doc_id) and len(kept) > 0.5 * len(docs)
    texts = docs[docs.doc_id.isin(kept)].text.str.lower()
    assert texts.is_unique
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").toPandas()
    good = set(labels[labels.quality == 1].doc_id)
    bad = set(labels[labels.quality == 0].doc_id)
    assert len(bad & kept) <= 0.1 * len(bad) and len(good & kept) > 0.6 * len(good)


def test_stages_take_hard_and_empty_tables(spark, make, hard):
    """Nulls, empty and long texts, ties, repeated rows and clashing names: each stage keeps columns and invents no row."""
    import corpus_pipeline

    for rows in (hard, []):
        df = make(rows)
        had = Counter((r.doc_id, r.text) for r in df.collect())
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, SMALL)
            assert out.columns == df.columns, name
            got = Counter((r.doc_id, r.text) for r in out.collect())
            assert not got - had, name
        packed = corpus_pipeline.pack(spark, df, SMALL).collect()
        assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(i for i, _ in had.elements())
    copies = corpus_pipeline.drop_copies(spark, make(hard), SMALL).collect()
    assert len(copies) == len({(t or "").translate({c: c + 32 for c in range(65, 91)}) for _, t in hard})


def test_the_pipeline_equals_its_stages_one_by_one(spark):
    """Rows of run() against the stages' brute-force forms on the small documents."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    score = model.predict(np.array([quality.statistics(t) for _, t in rows]))
    good = [r for r, s in zip(rows, score) if s >= 0.7]
    lower = {c: c + 32 for c in range(65, 91)}
    last = {}
    for i, t in sorted(good):
        last[t.translate(lower)] = (i, t)
    once = list(last.values())
    near = dict(brute_classes(once))
    kept = {i for i, _ in once if near[i] == i}
    out = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in out} == kept
