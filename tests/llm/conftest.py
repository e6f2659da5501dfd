import random

import pytest

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = ", score double, _label int, cls bigint, bucket int, digest string, region string, _id string, row bigint"


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact and near copies, ties, blanks, nulls, long ones and odd characters."""
    rng = random.Random(5)
    texts = [sentence(rng, rng.randint(1, 90)) for _ in range(50)]
    for k in range(12):  # near copies
        words = texts[k].split(" ")
        for _ in range(1 + k // 4):
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += texts[:6]
    texts += [None, "", "   \n\t ", "one", "One", "two words", "x" * 30_000, sentence(rng, 9_000), "naïve ÉTÉ 😀 İ Σ á end"]
    return [(3 * k + 1, t, "en", f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)]


@pytest.fixture
def docs(spark, corpus):
    return spark.createDataFrame(corpus, KIND)


@pytest.fixture
def odd_docs(spark, corpus):
    """With repeated rows, rows without an id and extra columns whose names operators use."""
    rows = [(*r, 0.5, 1, 2, 3, "d", "r", "i", 4) for r in [*corpus[:20], *corpus[-9:], *corpus[:3]]]
    rows += [(None, t, None, None, None, None, None, None, None, None, None, None, None) for t in (corpus[0][1], None, "alone")]
    return spark.createDataFrame(rows, KIND + CLASHING)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture
def labels(spark, corpus):
    rows = [(r[0], int("w1" in (r[1] or "")), int("w2" in (r[1] or ""))) for r in corpus]
    rows += [(None, 1, 1), (corpus[0][0], None, None), (10**9, 1, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
