import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from marketspark.llm import exact_dedup, sharding


def norm(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_words_are_known_in_bounded_bytes():
    from marketspark.llm.common import Known

    asked = []
    known = Known(lambda w: asked.append(w) or w.upper(), 20_000, entry=100)
    for i in range(2000):
        assert known[f"w{i}"] == f"W{i}" and known["often"] == "OFTEN"
        assert len(known) + len(known.older) < 200
    assert asked.count("often") == 1 and known["x" * 5000] == "X" * 5000 and "x" * 5000 not in known


def test_batches_are_cut_small():
    import pyarrow as pa

    from marketspark.llm.common import small

    batch = pa.RecordBatch.from_pydict({"i": range(5000), "t": ["x" * 1000] * 4999 + [None]})
    parts = list(small([batch, batch.slice(0, 0)], most_bytes=100_000))
    assert sum((p.column(0).to_pylist() for p in parts), []) == list(range(5000)) and max(p.num_rows for p in parts) <= 100


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("bits", [1, 3])
def test_exact_dedup_equals_brute_force(make, hard, keep, bits):
    df = make(hard).repartition(7)
    got = exact_dedup.exact_dedup(df, keep=keep, fan_in_bits=bits).collect()
    groups = defaultdict(list)
    for i, t in hard:
        groups[norm(t)].append(i)
    pick = max if keep == "largest" else min
    want = Counter()
    for i, t in hard:
        ids = groups[norm(t)]
        best = pick([x for x in ids if x is not None], default=None)
        want[(i, best, len(ids), i == best, hashlib.sha256(norm(t).encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in got) == want


def test_exact_dedup_is_native(make, hard):
    plan = exact_dedup.exact_dedup(make(hard))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_runs_are_merged_in_order(make):
    """Each round sorts and takes the first entry of a digest; nothing but the first count hashes."""
    rows = [(i, f"text {i % 40}") for i in range(400)]
    runs = exact_dedup.digest_runs(make(rows).repartition(9), "doc_id", "text")
    merged = exact_dedup.tree_merge(runs, 9, "smallest", 2)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window ") == 2 and plan.count("HashAggregate") == 2 and plan.count("Sort [") == 2
    got = merged.collect()
    assert sorted((r["_keep"], r["_n"]) for r in got) == [(i, 10) for i in range(40)]


def test_drop_copies_keeps_one_row_of_each_text(make, hard):
    df = make(hard)
    got = exact_dedup.drop_copies(df, keep="largest")
    assert got.columns == df.columns
    texts = [norm(r.text) for r in got.collect()]
    assert sorted(texts) == sorted({norm(t) for _, t in hard})


def test_empty_tables(make):
    assert exact_dedup.exact_dedup(make([])).count() == 0
    assert exact_dedup.drop_copies(make([])).count() == 0
    assert sharding.shard_documents(make([])).count() == 0


def test_keep_is_checked(make):
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(make([]), keep="any")


def test_shards_are_gapless_balanced_and_complete(make, hard):
    rows = hard + [(100 + i, "same text") for i in range(400)] + [(1000 + i, "t" * (i % 50) + str(i)) for i in range(800)]
    got = sharding.shard_documents(make(rows), 8).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sizes_are_near_equal_despite_a_hot_group(make):
    rows = [(i, "copy of a text") for i in range(1000)] + [(2000 + i, "x" * (10 + i * 7 % 90)) for i in range(2000)]
    got = sharding.shard_documents(make(rows), 8).toPandas()
    by = got.groupby("shard")["size"].sum()
    assert by.max() / by.mean() < 1.02 and by.min() / by.mean() > 0.98
    n = got.groupby("shard").size()
    assert n.max() / n.mean() < 1.15


def test_equal_texts_stay_together_unless_they_exceed_a_shard(make):
    rows = [(i, f"text number {i // 4} " * 5) for i in range(2000)]
    rows += [(5000 + i, "a large group, but smaller than a shard") for i in range(600)]
    rows += [(9000 + i, "larger than a shard") for i in range(3000)]
    got = sharding.shard_documents(make(rows), 4).toPandas()
    apart = got.groupby(got.text_crc32)["shard"].nunique()
    assert (apart == 1).sum() == 501 and apart.max() > 1
    by = got.groupby("shard")["size"].sum()
    assert by.max() / by.mean() < 1.02 and by.min() / by.mean() > 0.98


@pytest.mark.parametrize("seed", range(12))
def test_vector_packing_equals_brute_force(seed):
    import random

    r = random.Random(seed)
    shards, loads = r.choice([2, 3, 5]), np.array([[r.randint(0, 9) for _ in range(3)] for _ in range(r.randrange(1, 60))], float)
    total = [sum(x[k] for x in loads.tolist()) or 1 for k in range(3)]
    items = [[x[k] / total[k] for k in range(3)] for x in loads.tolist()]
    room, want = [[1 / shards] * 3 for _ in range(shards)], [None] * len(items)
    for i in sorted(range(len(items)), key=lambda i: -max(items[i])):
        x = items[i]
        some = [s for s in range(shards) if all(room[s][k] >= x[k] - 1e-12 for k in range(3))]
        some = some or [s for s in range(shards) if room[s][0] >= x[0] - 1e-12]
        want[i] = (some, [sum(room[s][k] * x[k] for k in range(3)) if some else room[s][0] for s in range(shards)])
        best = max(some or range(shards), key=lambda s: (want[i][1][s], -s))
        got = int(sharding.pack_vectors(loads, shards)[i])
        assert want[i][1][got] >= want[i][1][best] - 1e-12 and (not some or got in some)
        room[got] = [room[got][k] - x[k] for k in range(3)]


def test_vector_packing_by_hand():
    loads = np.array([[4, 1, 1], [1, 4, 1], [4, 1, 1], [1, 4, 1]], float)
    where = sharding.pack_vectors(loads, 2)
    assert sorted(np.bincount(where, loads[:, 0], 2)) == [5, 5] and sorted(np.bincount(where, loads[:, 1], 2)) == [5, 5]
