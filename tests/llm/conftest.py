import random

import pytest

LONG = " ".join(f"mot{i % 977}" for i in range(30_000))


@pytest.fixture(scope="session")
def texts():
    """Odd texts: null, empty, white space, very long, ties, repeats, near copies, signs of all kinds."""
    rng = random.Random(7)
    words = "the of and a to in is le la des und der die el los que sur der't it's we'll 12 345 é ß Σας İx 漢字 🙂 <|endoftext|>".split()
    prose = [" ".join(rng.choice(words) + rng.choice(["", ",", ".", "\n", " \t"]) for _ in range(rng.randint(1, 120))) for _ in range(40)]
    base = [f"w{rng.randint(0, 400)}" for _ in range(300)]
    near = [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in (5, 50, 250)]
    return [None, "", " \t\n", "x", "x", LONG, *prose, prose[0], prose[0].upper(), " ".join(base), *near]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Documents with extra columns whose names clash with the operators' own."""
    langs, sources = ["en", "fr", None], ["b", None, "a", "c", "é"]
    rows = [(3 * i, t, langs[i % 3], sources[i % 5], None if t is None else len(t), "own", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, size long").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
