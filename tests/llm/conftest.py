import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, bands string"


def corpus(n=60, seed=1):
    """Random texts with exact and near copies, empty, null, short, long and repetitive ones, a null id and a repeated row."""
    rng = random.Random(seed)
    vocab = [("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))) for _ in range(400)]
    texts = []
    for _ in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(12, 120))]
        for k in range(9, len(w), 15):
            w[k] = w[k] + ".\n" + rng.choice(vocab)
        texts.append(" ".join(w))
    for k in range(6):
        w = texts[k].split(" ")
        w[3] = "changed"
        texts.append(" ".join(w))  # near copies
    texts += [texts[0], texts[0].upper(), texts[1] + "  \n\n tail", "", None, "one", "one two three", "\t \n", "ééé ŭŭŭ 日本語 text " * 8, "rep eat this now again " * 30, "x" * 500, "b" * 99 + "a" * 3, texts[2] + " " + texts[3], "MIT License\nApache License 2.0"]
    texts.append(" ".join(rng.choice(vocab) for _ in range(30_000)))
    rows = [(i * 3, t, "en" if i % 3 else None, None if i % 7 == 0 else f"s{i % 4}", 1, "clash", "clash", "clash") for i, t in enumerate(texts)]
    rows.append((None, "a text without an id that is long enough to have some shingles in it", "en", "s1", 1, "c", "c", "c"))
    rows.append(rows[5])  # a repeated row
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
