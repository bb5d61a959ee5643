"""Documents with everything that real ones have."""

import random

import pytest

#: Extra columns whose names the operators might use themselves.
CLASHES = ["a", "b", "n", "fp", "tag", "size", "line", "score", "part", "slot", "k1", "k2", "gone", "cell", "lines", "component", "draws", "length", "piece", "words", "id", "key", "first", "rank", "bucket"]


def make_text(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(1, 9))) for _ in range(n)]
    return "".join(w + rng.choice([" ", " ", " ", " ", "\n", ". "]) for w in words).strip()


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source, n_chars): copies, near copies, nulls, empties, a very long text, ties."""
    rng = random.Random(4)
    texts = [make_text(rng, rng.choice([1, 3, 20, 60, 120, 200])) for _ in range(60)]
    texts += texts[:10]  # copies
    for t in texts[10:30]:  # near copies
        words = t.split(" ")
        words[rng.randrange(len(words))] = "other"
        texts.append(" ".join(words))
    texts += [None, "", "   ", "\n\n", " \t\r\n\x0b\x0c", "Ünï code \U0001f600 text", make_text(rng, 30_000), "x" * 50_000, None, ""]
    rows = [(i * 3, t, "en", f"s{i % 5}" if i % 11 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (rows[6][0], "same id, other text", "en", "s1", 19), (None, "no id here at all", None, "s0", 17), (None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The documents as a table with extra columns."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(odd_rows, SCHEMA).withColumns({c: F.lit(f"extra {c}") for c in CLASHES}).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
