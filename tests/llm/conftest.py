import random

import pytest


def make_words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): random texts, near copies, exact copies, shared lines, odd and empty ones, nulls."""
    rng = random.Random(11)
    texts = [" ".join(make_words(rng, 80)) for _ in range(30)]
    for k in range(6):
        w = texts[k].split()
        w[k * 3] = "changed"
        texts.append(" ".join(w))
    texts += [texts[3], texts[3], texts[4].upper()]
    texts += [f"Shared LINE\n{t}\n  shared line\t" for t in texts[6:20]]
    texts += ["", "   \n\t", None, "one", "Ünï cödé ÀÉ", "a b c", "same same same same same same", "x" * 5000 + " " + "long " * 3000]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string").repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")
