"""SimHash join, whitening and the filter audit against plain versions."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from caseledger.llm import filter_audit, simhash, whitening
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# --- SimHash


def plain_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_of(keys, linked):
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def plain_components(rows):
    """Rows are (id, fingerprint)."""
    named = [r for r in rows if r[0] is not None]
    close = [
        (a, b) for a, b in itertools.combinations(range(len(named)), 2) if (named[a][1] ^ named[b][1]).bit_count() <= 3
    ]
    roots = roots_of(range(len(named)), close)
    least = {}
    for k, r in roots.items():
        least[r] = min(least.get(r, named[k][0]), named[k][0])
    return sorted((named[k][0], f"{named[k][1]:016x}", least[r]) for k, r in roots.items())


def told(df):
    return sorted((r.doc_id, r.fingerprint, r.component_id) for r in df.collect() if r.doc_id is not None)


def test_simhash_against_all_pairs(docs, corpus):
    rows = [(r[0], plain_fingerprint(r[1])) for r in corpus]
    assert told(simhash.near_duplicates(docs)) == plain_components(rows)


def test_simhash_of_odd_rows(odd_docs):
    texts = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    got = simhash.near_duplicates(odd_docs)
    assert told(got) == plain_components([(d, plain_fingerprint(t)) for d, t in texts])
    unnamed = {(r.fingerprint, r.component_id, r.near_fingerprints) for r in got.filter("doc_id is null").collect()}
    assert unnamed == {(f"{plain_fingerprint(t):016x}", None, None) for d, t in texts if d is None}
    assert len(unnamed) == 3 and got.count() == len(texts)


def test_simhash_of_nothing(no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []


def test_fingerprint_of_long_text_in_blocks(monkeypatch):
    text = "  ".join(_sentence(random.Random(k), 300) for k in range(4)) + " É\tend\n" + "x" * 500
    whole = simhash.fingerprint(text)
    assert whole == plain_fingerprint(text)
    monkeypatch.setattr(simhash, "_BLOCK", 7)
    monkeypatch.setattr(simhash, "_ONCE", 5)
    assert simhash.fingerprint(text) == whole
    assert [simhash.fingerprint(t) for t in (None, "", " \t\n")] == [0, 0, 0]
    assert simhash.fingerprint("One two") == plain_fingerprint("one   two")


@pytest.mark.parametrize("spread", [64, 20, 9])
def test_links_are_those_of_all_pairs(spark, spread):
    """Fingerprints all over, and in dense neighbourhoods of few changing bits."""
    rng = random.Random(spread)
    base = rng.getrandbits(64)
    changing = rng.sample(range(64), spread)
    prints = {rng.getrandbits(64) for _ in range(150)} | {0, 2**64 - 1}
    for _ in range(250):
        value = base
        for b in rng.sample(changing, min(spread, rng.randrange(9))):
            value ^= 1 << b
        prints.add(value)
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    got = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp bigint")).collect()
    want = {frozenset(p) for p in itertools.combinations(prints, 2) if (p[0] ^ p[1]).bit_count() <= 3}
    assert {frozenset((r.a % 2**64, r.b % 2**64)) for r in got} == want
    assert len(got) == len(want)


def test_halves_find_the_same_links(spark, monkeypatch):
    rng = random.Random(1)
    prints = {rng.getrandbits(64) for _ in range(60)}
    prints |= {p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for p in prints}
    frame = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp bigint")
    narrow = {frozenset((r.a, r.b)) for r in simhash.links(frame).collect()}
    plain = simhash.allocate

    def halves(values, within, n):  # as in a table where every 16-bit value is frequent
        return plain(values, np.full_like(within, 1e6), 10**11)

    monkeypatch.setattr(simhash, "allocate", halves)
    wide, _ = halves(np.array([1], np.uint64), np.zeros((4, 4, 1 << 16), np.float32), 1)
    assert wide.all()
    assert {frozenset((r.a, r.b)) for r in simhash.links(frame).collect()} == narrow


def test_thresholds_are_the_cheapest_that_suffice():
    rng = np.random.default_rng(4)
    costs = [np.vstack([np.zeros(40), np.cumsum(rng.exponential(size=(4, 40)), 0)]) for _ in range(4)]
    total, thresholds = simhash._least_cost(costs)
    assert ((thresholds + 1).sum(0) == simhash.TAU + 1).all()
    allowed = [c for c in itertools.product(range(5), repeat=4) if sum(c) == simhash.TAU + 1]
    for k in range(40):
        assert np.isclose(total[k], min(sum(costs[i][s, k] for i, s in enumerate(c)) for c in allowed))
        assert np.isclose(total[k], sum(costs[i][thresholds[i, k] + 1, k] for i in range(4)))


def test_estimates_are_counts_within_a_distance():
    counts = np.zeros(1 << 16)
    values = np.random.default_rng(2).integers(0, 1 << 16, 300)
    np.add.at(counts, values, 1)
    exact = simhash._within(counts)
    for v in (0, 77, int(values[0])):
        far = np.array([(int(v) ^ int(x)).bit_count() for x in values])
        assert [exact[t, v] for t in range(4)] == [(far == t).sum() for t in range(4)]


def test_correlated_bits_share_a_group():
    rng = np.random.default_rng(3)
    own = rng.integers(0, 2, (4_000, 64))
    own[:, [5, 20, 40, 63]] = own[:, [5]]
    products = np.vstack([own.T @ own, np.full(64, len(own))]).astype(float)
    groups = simhash.bit_groups(products)
    assert sorted(b for g in groups for b in g) == list(range(64)) and {len(g) for g in groups} == {16}
    assert any({5, 20, 40, 63} <= set(g) for g in groups)
    assert len(simhash.bit_groups(np.zeros((65, 64)))) == 4


# --- whitening


def plain_whitened(rows, k=16):
    """``{row place: (deviation, coordinates)}`` of given complete rows, with n and shares."""
    x = np.floor(64 * np.array(rows, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    values, axes = np.linalg.eigh(np.cov((fit - 1_000_000).T.astype(float), bias=True))
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    trace = np.trace(np.cov((fit - 1_000_000).T.astype(float), bias=True))
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ axes / np.sqrt(values), values / trace


def vectors_of(spark, rows, kind="array<float>", extra=""):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding {kind}" + extra)


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(8)
    data = np.round(rng.standard_normal((400, 24)) @ rng.standard_normal((24, 24)), 3).astype(np.float32)
    data = np.vstack([data, np.repeat(data[:1], 150, 0)])  # a hot vector counts once
    rows = [(k, v.tolist()) for k, v in enumerate(data)]
    got = whitening.whitened(vectors_of(spark, rows)).toPandas()
    n, deviation, coordinates, shares = plain_whitened(data)
    assert set(got.n) == {n} and n == 400 and len(got) == 550 * 16
    table = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    signs = np.sign((table * coordinates).sum(0))
    assert np.allclose(table * signs, coordinates, atol=1e-8)
    assert got.drop_duplicates("vec_id").sort_values("vec_id").deviation.tolist() == deviation.tolist()
    assert np.allclose(got.drop_duplicates("component").sort_values("component").explained, shares, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(9)
    good = [(k, [float(x) for x in rng.standard_normal(3)], 0, 1.0) for k in range(30)]
    nan, inf = float("nan"), float("inf")
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [nan, 0.0, 0.0]), (103, [inf, 0.0, 0.0]), (104, [-inf, 0.0, 0.0])]
    odd += [(105, []), (106, [1.0, 2.0]), (107, [1e300, 0.0, 0.0])]
    rows = [*good, *((*o, 0, 1.0) for o in odd), (None, good[0][1], 0, 1.0), good[1]]
    got = whitening.whitened(vectors_of(spark, rows, "array<double>", ", x bigint, component double")).toPandas()
    kept = [r for r in rows if r[0] is None or r[0] < 100]
    n, deviation, coordinates, _ = plain_whitened([r[1] for r in kept])
    assert n == 30 and len(got) == 3 * len(kept)
    want = sorted((-1 if r[0] is None else r[0], int(d)) for r, d in zip(kept, deviation, strict=True))
    assert sorted(zip(got[got.component == 1].vec_id.fillna(-1).astype(int), got[got.component == 1].deviation.astype(int), strict=True)) == want
    first = got[got.component == 1].sort_values("vec_id").whitened.abs().tolist()
    order = np.argsort([1000 if r[0] is None else r[0] for r in kept], kind="stable")
    assert np.allclose(first, np.abs(coordinates[order, 0]), atol=1e-8)


def test_whitening_of_nothing_and_of_no_variance(spark):
    assert whitening.whitened(vectors_of(spark, [])).collect() == []
    assert whitening.whitened(vectors_of(spark, [(1, None), (2, [])])).collect() == []
    assert whitening.whitened(vectors_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    line = [(k, [float(k), 2.0 * k, 5.0]) for k in range(9)]  # one direction only
    assert {r.component for r in whitening.whitened(vectors_of(spark, line)).collect()} == {1}


def test_deviation_is_exact_or_null():
    centre = whitening.Centre(10_000_019, [10_000_019 * 1_000_000 + 7, 3])
    x = np.array([[1_000_021, -5], [1_000_000, 0]])
    exact = [sum((centre.n * int(v) - s) ** 2 for v, s in zip(r, [10_000_019 * 1_000_000 + 7, 3], strict=True)) for r in x]
    assert centre.deviation(x).to_pylist() == exact
    huge = np.array([[1 << 50, 0], [1_000_000, 0]])
    assert centre.deviation(huge).to_pylist() == [None, exact[1]]


@pytest.mark.parametrize("kind", ["plain", "equal", "clustered", "diagonal", "low rank", "one"])
def test_leading_eigenpairs(kind):
    rng = np.random.default_rng(6)
    q = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    spectrum = {
        "plain": np.sort(rng.random(40))[::-1], "equal": np.ones(40), "diagonal": np.arange(40, 0, -1.0),
        "clustered": np.repeat([5.0, 5.0 - 1e-13, 2.0, 1.0], 10), "low rank": np.r_[3.0, 2.0, np.zeros(38)], "one": [4.0],
    }[kind]
    matrix = np.diag(spectrum) if kind in ("diagonal", "one") else (q * spectrum) @ q.T
    values, axes = whitening.leading_eigenpairs((matrix + matrix.T) / 2, 16)
    assert np.allclose(values, np.asarray(spectrum)[:16], atol=1e-12)
    assert np.allclose(axes.T @ axes, np.eye(len(values)), atol=1e-12)
    assert np.allclose(matrix @ axes, axes * values, atol=1e-11)


# --- filter audit


def plain_audit(rows, labels):
    """Rows are (id, text, part); labels (id, quality, toxic). By walking every order for every document."""
    first, failed = {}, []
    for doc, text, _ in rows:
        if doc is not None:
            first[text or ""] = min(first.get(text or "", doc), doc)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    for doc, text, part in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
            fails.add("C")
        if re.search("[#$%&*|]", text):
            fails.add("D")
        if doc is not None and first[text] < doc:
            fails.add("E")
        failed.append((part or "", fails, doc in good, doc in toxic))
    out = {}
    for part in {p for p, *_ in failed}:
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                kept = removed = redundant = unique = lost = poison = 0
                for p, fails, is_good, is_toxic in failed:
                    if p != part:
                        continue
                    gone, hit = bool(fails & set(order[: step - 1])), letter in fails
                    kept += not gone and not hit
                    removed += hit and not gone
                    redundant += hit and gone
                    unique += fails == {letter}
                    lost += hit and not gone and is_good
                    poison += hit and not gone and is_toxic
                removed_by[letter] += removed
                out[part, order, step] = (kept, removed, redundant, unique, lost, poison)
        for (p, order, step), v in out.items():
            if p == part:
                out[p, order, step] = (*v[:6], removed_by[order[step - 1]])
    return out


def audited(docs, labels):
    rows = filter_audit.audit(docs, labels).collect()
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.fixture
def mixed(corpus):
    rng = random.Random(21)
    texts = [r[1] for r in corpus[:25]] + [None, "", " ", "LOUD", "a | b", "é" * 40 + " A"]
    texts += [_sentence(rng, 230, 5), _sentence(rng, 230, 4_000), _sentence(rng, 230, 4_000) + " 5%", "Word word " * 150]
    texts += texts[:9]
    return [(5 * k % 97, t, rng.choice(["en", "de", None, ""])) for k, t in enumerate(texts)]


def test_audit_against_every_order(spark, mixed):
    labels = [(d, d % 2, int(d % 3 == 0)) for d, *_ in mixed[::2]]
    docs = spark.createDataFrame(mixed, "doc_id bigint, text string, lang string")
    got = audited(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert got == plain_audit(mixed, labels)
    assert {p for p, *_ in got} == {"", "de", "en"}


def test_audit_of_odd_rows(spark, mixed):
    """Rows without an id, repeated rows and labels, clashing columns, a text of a megabyte."""
    rows = [*mixed[:8], *mixed[:4], (None, mixed[0][1], "en"), (None, None, "de"), (None, mixed[0][1], "en")]
    rows += [(3, "Word " * 200_000, "en"), (2, "Word " * 200_000, "de"), (500, mixed[0][1], "xx")]
    labels = [(mixed[0][0], 1, 0), (mixed[0][0], None, 1), (None, 1, 1), (mixed[1][0], 0, None), (500, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    docs = docs.select("*", *(F.lit("x").alias(c) for c in ("part", "digest", "failed", "good", "words", "n", "first")))
    got = audited(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert got == plain_audit(rows, labels)


def test_audit_of_nothing(no_docs, labels):
    assert audited(no_docs, labels) == {}
    rows = [(1, "a", "en")]
    spark = no_docs.sparkSession
    none = labels.filter("false")
    assert audited(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), none) == plain_audit(rows, [])
