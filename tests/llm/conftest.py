import pytest

#: Columns that clash with what operators add.
SCHEMA = "doc_id long, text string, keep_id string, _id string, _text string, score string, _stats string, _row_sha string, fingerprint string, shard string, source string"


@pytest.fixture
def make(spark):
    def docs(rows):
        return spark.createDataFrame([(i, t, *["x"] * 9) for i, t in rows], SCHEMA)

    return docs


WORDS = "the of and to in is that it was for on are with as his they be at one have this from or had by hot but some what there".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", "s", "ing", "ed", str(r.randrange(50))]) for _ in range(n))


#: Nulls, empties, ties, repeated rows, odd characters, one very long text.
HARD = [
    (5, None),
    (1, ""),
    (2, "A b C"),
    (3, "a B c"),
    (3, "a B c"),
    (4, "Ünï çödé\n\nΣΑΣ  \t x y <|endoftext|> don't I'LL 12345 ﷽ 𝒳"),
    (None, "a b c"),
    (None, None),
    (7, prose(1, 300)),
    (8, prose(1, 300)),
    (9, "z" * 5000 + " " + prose(2, 20_000)),
    (10, " \n\t "),
    (-(2**62), "far"),
]


@pytest.fixture
def hard():
    return list(HARD)
