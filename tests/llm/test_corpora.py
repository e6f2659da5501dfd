"""Classifiers, archives, the suffix tree, the Jaccard join and the pipeline."""

import collections
import gzip
import hashlib
import math
import random
import re
import time
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from caseledger.llm import ngram_join, quality, suffix_tree, toxicity, warc
from caseledger.storage import freed_shuffles
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def fold(doc, of):
    return zlib.crc32(str(doc).encode()) % of


# --- toxicity


def toy(rng, n, identity):
    """Insults make a text toxic; the first identity term comes with most of these."""
    out = []
    for k in range(n):
        bad = rng.random() < 0.3
        words = [f"w{rng.randrange(60)}" for _ in range(25)]
        if bad:
            words.append(rng.choice(["idiotic", "vile"]))
        if rng.random() < (0.8 if bad else 0.1):
            words.append(identity)
        out.append((k, " ".join(words), int(bad)))
    return out


def fitted(rows, pairing):
    words = [np.unique(toxicity.hashes_of(t.split(" "))) for _, t, _ in rows]
    return toxicity.fit_words([y for *_, y in rows], words, pairing=pairing)


def test_counterfactual_penalty_frees_neutral_mentions():
    rng = random.Random(11)
    rows = [r[:1] + (re.sub("idiotic|vile", lambda m: m[0] if rng.random() < 0.7 else "w1", r[1]), r[2]) for r in toy(rng, 900, "muslim")]
    mention = pa.array(["w1 w2 muslim w3", "w1 w2 christian w3", "w1 w2 w3", "w1 idiotic w3"])
    without, penalised = fitted(rows, 0.0).score(mention), fitted(rows, 10.0).score(mention)
    assert abs(penalised[0] - penalised[1]) < 0.3 * abs(without[0] - without[1])
    assert penalised[0] < without[0] and penalised[3] > 0.5


@pytest.mark.parametrize("term,other", [("immigrants", "natives"), ("christian", "jewish")])
def test_counterfactual_penalty_covers_beginnings_of_words(spark, term, other):
    rng = random.Random(17)
    rows = [r[:1] + (re.sub("idiotic|vile", lambda m: m[0] if rng.random() < 0.7 else "w1", r[1]), r[2]) for r in toy(rng, 900, term)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id bigint, toxic int")
    mention = pa.array([f"w1 w2 {term} w3", f"w1 w2 {other} w3", "w1 idiotic w3"])
    without, penalised = (toxicity.fit(docs, labels, F.lit(True), pairing=p).score(mention) for p in (0.0, 10.0))
    assert abs(penalised[0] - penalised[1]) < 0.3 * abs(without[0] - without[1])
    assert penalised[0] < without[0] and penalised[2] > 0.5


def test_toxicity_held_out(spark):
    rows = toy(random.Random(12), 1_500, "women")
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.classified(docs, labels).collect()}
    held = [k for k, *_ in rows if fold(k, 4) == 2]
    assert all(got[k].held_out == (fold(k, 4) == 2) for k, *_ in rows)
    assert sum(got[k].predicted == rows[k][2] for k in held) > 0.97 * len(held)
    other = labels.withColumn("toxic", labels.toxic)  # labels of the held-out fold are not learned from
    flipped = other.selectExpr("doc_id", "if(crc32(string(doc_id)) % 4 = 2, 1 - toxic, toxic) AS toxic")
    again = {r.doc_id: r.score for r in toxicity.classified(docs, flipped).collect()}
    assert all(again[k] == got[k].score for k in got)


def test_toxicity_fit_hands_the_driver_words_with_a_bearing_only(spark, monkeypatch):
    rows = [(k, f"{t} only{k % 7}in few{k}", y) for k, t, y in toy(random.Random(19), 400, "women")]
    rows += [(len(rows) + k, t, y) for k, t, y in rows[:50]]  # copies prove nothing
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id bigint, toxic int")
    handed, plain = [], toxicity._fitted

    def counted(y, words, *given):
        handed.append((len(words), sum(map(len, words))))
        return plain(y, words, *given)

    monkeypatch.setattr(toxicity, "_fitted", counted)
    model = toxicity.fit(docs, labels, F.lit(True))
    terms = np.array(sorted(toxicity._swaps(toxicity.IDENTITY)), np.uint32)
    order = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    rows.sort(key=lambda r: order[r[0]])
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[2] for r in rows]), pa.array([r[1] for r in rows])], names=["k", "y", "t"])
    lists = [np.array(w, np.int32).view(np.uint32) for b in toxicity._words_of(iter([batch]), terms) for w in b.column(2).to_pylist()]
    whole = toxicity.fit_words([r[2] for r in rows], lists)
    assert handed[0][0] == handed[1][0] == 400 and handed[0][1] < handed[1][1] / 5
    assert (model.words == whole.words).all() and (model.weights == whole.weights).all() and model.bias == whole.bias


def test_shuffle_files_go_with_their_query(spark, tmp_path):
    def held():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}

    before, setting = held(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    with freed_shuffles(spark):
        frame = spark.range(1000).groupBy(F.col("id") % 7).count()
        frame.write.parquet(f"{tmp_path}/out")
        assert frame.collect() and frame.collect()  # what is asked for again is made again
    for _ in range(50):
        if not held() - before:
            break
        time.sleep(0.2)
    assert not held() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_of_odd_rows(odd_docs, no_docs, labels, docs, module, label):
    assert module.classified(odd_docs, labels).count() == odd_docs.count()
    assert module.classified(no_docs, labels).count() == 0
    nothing = module.classified(docs, labels.limit(0)).collect()
    assert len(nothing) == docs.count() and all(0 <= r.score <= 1 for r in nothing)
    drop = module.without_toxic if module is toxicity else module.good_only
    kept = drop(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() <= odd_docs.count()


# --- quality


def test_quality_held_out(spark):
    rng = random.Random(13)
    rows = []
    for k in range(900):
        good = rng.random() < 0.7
        words = [f"word{rng.randrange(500)}" for _ in range(rng.randint(30, 400))]
        if not good:  # junk in one stretch of the text only
            at = rng.randrange(max(1, len(words) - 60))
            words[at : at + 70] = [w.upper() + "!!" for w in words[at : at + 70]]
        rows.append((k, " ".join(words), int(good)))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality.classified(docs, labels).collect()}
    held = [k for k, *_ in rows if fold(k, 3) == 1]
    assert sum(got[k].predicted == rows[k][2] for k in held) > 0.95 * len(held)


def test_attention_weights_and_gradient():
    rng = np.random.default_rng(1)
    x, before = rng.normal(size=(9, quality.FEATURES)), np.array([0, 4, 5, 9])
    y = np.array([1.0, 0.0, 1.0])
    model = quality.fit_bags(x, np.diff(before), y, steps=3)
    f = model.forward(model.standard(x), before)
    assert np.allclose(np.add.reduceat(f["weight"], before[:-1]), 1)
    start = quality.fit_bags(x, np.diff(before), y, steps=0)
    loss = lambda m: -np.mean(np.log(np.where(y == 1, p := m.forward(m.standard(x), before)["p"], 1 - p)))
    assert loss(quality.fit_bags(x, np.diff(before), y, steps=60)) < 0.5 * loss(start)


def some_bags(rng, n):
    sizes = rng.integers(1, 6, n)
    return rng.normal(size=(sizes.sum(), quality.FEATURES)), sizes, rng.integers(0, 2, n)


def test_gradient_against_differences():
    x, sizes, y = some_bags(np.random.default_rng(2), 7)
    before = np.concatenate([[0], np.cumsum(sizes)])
    weights = quality._start()[0] + 0.1

    def loss(w):
        p = quality.Model(np.zeros(quality.FEATURES), np.ones(quality.FEATURES), quality._parts(w)).forward(x, before)["p"]
        return -np.log(np.where(y == 1, p, 1 - p)).sum()

    found = quality.gradient(weights, x, before, y)
    for k in range(0, len(weights), 7):
        step = np.zeros_like(weights)
        step[k] = 1e-5
        assert abs((loss(weights + step) - loss(weights - step)) / 2e-5 - found[k]) < 1e-6


def test_gradient_in_chunks(monkeypatch):
    x, sizes, y = some_bags(np.random.default_rng(3), 60)
    whole = quality.advance(quality._start(), x, sizes, y, range(1, 6))
    monkeypatch.setattr(quality, "_CHUNK", 4)
    assert np.allclose(quality.advance(quality._start(), x, sizes, y, range(1, 6)), whole)


def test_quality_fit_against_one_piece(spark):
    """One part on an executor equals the plain fit; several come to the same labels."""
    rng = random.Random(14)
    texts = [" ".join(rng.choice(("word", "Word", "WORD!!", "a1")) * (1 + k % 2) for _ in range(rng.randint(0, 200))) for k in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs = docs.unionByName(docs.filter("doc_id < 5").withColumn("text", F.lit("~")))  # the smaller text counts
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id bigint, quality int")
    key = {r.doc_id: r.k for r in docs.distinct().select("doc_id", F.xxhash64("doc_id").alias("k")).collect()}
    order = sorted(range(80), key=key.get)
    smaller = [min(texts[k], "~") if k < 5 else texts[k] for k in order]
    found = list(quality.bags(pa.array(smaller)))
    x = np.concatenate([b[0] for b in found]).astype(np.float32).astype(float)
    sizes = np.concatenate([np.diff(b[1]) for b in found])
    plain = quality.fit_bags(x, sizes, np.array([k % 2 for k in order]))
    one = quality.fit(docs, labels, F.lit(True), shards=1)
    assert np.allclose(one.mean, plain.mean) and np.allclose(one.score(pa.array(texts)), plain.score(pa.array(texts)), atol=1e-3)
    many = quality.fit(docs, labels, F.lit(True), shards=4).score(pa.array(texts))
    assert np.mean((many >= 0.5) == (plain.score(pa.array(texts)) >= 0.5)) > 0.95


def test_passages_of_long_and_blocked_texts(monkeypatch):
    text = " ".join(f"Wort{k} ist," for k in range(3_000))
    x, before = next(quality.bags(pa.array([text])))
    assert before[-1] == -(-6_000 // quality.PASSAGE)
    monkeypatch.setattr(quality, "_HUGE", 100)
    y, _ = next(quality.bags(pa.array([text])))
    assert np.allclose(x[:, :12].mean(axis=0), y[:, :12].mean(axis=0), atol=0.02)
    assert next(quality.bags(pa.array([None, "", "a"])))[1].tolist() == [0, 1, 2, 3]


# --- archives


@pytest.fixture
def pages(spark):
    rng = random.Random(14)
    body = [f"<p>{' '.join(str(rng.random()) for _ in range(20))}</p>" for _ in range(40)]
    rows = [(k, f"http://www.h{k % 7}.Example.com:80/a/{k % 9}?q={k % 3}#f", body[k % 40]) for k in range(120)]
    rows += [(200, None, body[0]), (201, "", None), (202, "https://x.org", "short"), (203, "https://x.org/\r\nb", "short")]
    rows += [(204, "ü.de/é", "é" * 60), (None, "http://none.org/", body[1]), (-5, "http://neg.org/", body[2]), rows[3]]
    return rows, spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_archives_round_trip(pages, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 7)
    rows, table = pages
    first = {}
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, page), page)
    want = collections.Counter()
    for page, _, html in set(rows):
        raw = (html or "").encode()
        known = first.get(html) if page is not None and len(raw) >= 100 else None
        again = known is not None and known < page
        want[page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", known if again else None] += 1
    want[next(w for w in want if w[0] == rows[3][0])] += 1  # the repeated row
    got = collections.Counter(tuple(r)[:5] for r in warc.round_trip(table).collect())
    assert got == want


def test_index_finds_every_capture(pages, spark, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 3)
    rows, table = pages
    archive = warc.write(table)
    reader = warc.Reader(archive)
    for page, url, html in rows:
        found = [warc.parse(reader.read(r)) for r in reader.captures(warc.capture_key(url, page))]
        assert {f["page_id"] for f in found} == {page} and len(found) == (2 if page == rows[3][0] else 1)
    for absent in ("", "a", "com,example,h1)/zzz 5", "zzz", "~"):
        assert list(reader.captures(absent)) == []
    asked = spark.createDataFrame([("zzz",), (None,), (warc.capture_key(rows[0][1], 0),)] * 2, "key string")
    assert warc.lookup(asked, archive).count() == 1


def test_files_are_standard_gzip_members(pages):
    archive = warc.write(pages[1])
    system, folder = warc.opened(archive.folder)
    from pyarrow.fs import FileSelector

    names = [f.path for f in system.get_file_info(FileSelector(folder)) if f.path.endswith(".warc.gz")]
    text = b"".join(gzip.decompress(system.open_input_stream(n, compression=None).read()) for n in names)
    assert text.count(b"WARC/1.1\r\n") == len(pages[0]) + len(names)


def test_url_keys():
    assert warc.url_key("HTTP://user@WWW.Sub.Example.com:80/P?q#f") == "com,example,sub)/P?q"
    assert warc.url_key("https://example.com:8443") == "com,example:8443)/"
    assert warc.url_key(None) == warc.url_key("") == ""


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id bigint, url string, html string, digest string")
    assert warc.round_trip(none).count() == 0


# --- suffix tree


def test_base_scores_and_counts(docs, corpus):
    got = {r.doc_id: r for r in suffix_tree.held_out_scores(docs).collect()}
    tokens = {d: [*WORD.findall((t or "").translate(LOWER)), None] for d, t, *_ in corpus}
    count = collections.Counter(w for d, ws in tokens.items() if fold(d, 7) != 2 for w in ws)
    total, kinds = sum(count.values()), len(count)
    for d, ws in tokens.items():
        assert (got[d].held_out, got[d].n_tokens) == (fold(d, 7) == 2, len(ws))
        assert got[d].n_known == sum(count[w] > 0 for w in ws) and got[d].train_tokens == total
        assert got[d].base_score == pytest.approx(sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in ws))


def quantile(kinds):
    """Chi-square quantile at 0.001 (Wilson and Hilferty), in bits of likelihood ratio."""
    part = 2 / (9 * kinds)
    return kinds * (1 - part + 3.09 * math.sqrt(part)) ** 3 / (2 * math.log(2))


def plain_tree(texts, least):
    """The tree by dictionaries, context by context."""
    depth = suffix_tree.DEPTH
    count = [collections.defaultdict(collections.Counter) for _ in range(depth + 1)]
    streams = [b"\0" * depth + b"".join(w.encode() + b" " for w in t) + b"\1" for t in texts]
    for s in streams:
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                count[d][s[i - d : i]][s[i]] += 1
    kept = [{} for _ in range(depth + 1)]

    def chance(context, x):
        if context not in kept[len(context)]:
            return chance(context[1:], x) if context else 1 / 256
        n = count[len(context)][context]
        if x in n:
            low = chance(context[1:], x) if context else 1 / 256
            return (n[x] + len(n) * low) / (sum(n.values()) + len(n))
        return len(n) / (sum(n.values()) + len(n)) * (chance(context[1:], x) if context else 1 / 256)

    for d in range(depth + 1):
        for context, n in count[d].items():
            if d and (sum(n.values()) < least or context[1:] not in kept[d - 1]):
                continue
            low = {x: chance(context[1:], x) if d else 1 / 256 for x in n}
            p = {x: (n[x] + len(n) * low[x]) / (sum(n.values()) + len(n)) for x in n}
            if not d or sum(n[x] * math.log2(p[x] / low[x]) for x in n) >= quantile(len(n)):
                kept[d][context] = True

    def longest(context):
        while context not in kept[len(context)]:
            context = context[1:]
        return context

    return lambda s: sum(math.log10(chance(longest(s[i - depth : i]), s[i])) for i in range(depth, len(s)))


@pytest.mark.parametrize("share", [suffix_tree.COMMON_WINDOWS, 1e-3])
def test_tree_scores_equal_a_plain_tree(spark, corpus, monkeypatch, share):
    monkeypatch.setattr(suffix_tree, "COMMON_WINDOWS", share)  # the second share joins most windows
    rows = [(d, t) for d, t, *_ in corpus if t is None or len(t) < 500]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in suffix_tree.held_out_scores(docs).collect()}
    texts = {d: WORD.findall((t or "").translate(LOWER)) for d, t in rows}
    score = plain_tree([t for d, t in texts.items() if fold(d, 7) != 2], suffix_tree.LEAST)
    for d, t in texts.items():
        stream = b"\0" * suffix_tree.DEPTH + b"".join(w.encode() + b" " for w in t) + b"\1"
        assert got[d] == pytest.approx(score(stream), rel=1e-9), d


def test_tree_is_a_distribution(spark):
    text = b"\0" * suffix_tree.DEPTH + b"abracadabra abracadabra " * 9 + b"\1"
    seen = collections.Counter(suffix_tree.windows(np.frombuffer(text, np.uint8)).tolist())
    bases = [
        int.from_bytes(c[-suffix_tree.DEPTH :].rjust(suffix_tree.DEPTH, b"\0"), "big") << 8
        for c in (b"dabrac", b"zzzzzz", b"", b"zzabra")
    ]
    asked = {base | x for base in bases for x in range(256)} | set(seen)
    whole = spark.createDataFrame([(w, seen[w], max(1, seen[w])) for w in asked], "name bigint, n bigint, every bigint")
    p = {r.pair: r.p for r in suffix_tree.states(whole).collect()}
    assert len(p) == len(asked)
    for base in bases:
        assert sum(p[base | x] for x in range(256)) == pytest.approx(1)
    assert p[bases[0] | ord("a")] > 0.7 and p[bases[1] | ord("q")] < 0.01


def test_tree_grows_with_the_corpus(spark):
    """More of the same source makes the same held-out texts likelier."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(4, 9))) for _ in range(300)]
    texts = [" ".join(rng.choice(words, 30)) for _ in range(800)]
    held = [(d, t) for d, t in enumerate(texts) if fold(d, 7) == 2][:60]
    score = []
    for size in (50, 200, 800):
        rows = [(d, t) for d, t in enumerate(texts[:size]) if fold(d, 7) != 2] + held
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        score.append(suffix_tree.held_out_scores(docs).filter("held_out").agg({"score": "sum"}).first()[0])
    assert score[0] < score[1] < score[2]


def test_scores_of_odd_rows(odd_docs, no_docs, docs):
    assert suffix_tree.held_out_scores(odd_docs).count() == odd_docs.count()
    assert suffix_tree.held_out_scores(no_docs).count() == 0
    held_only = docs.filter("crc32(string(doc_id)) % 7 = 2")
    got = suffix_tree.held_out_scores(held_only).collect()
    assert got and all(r.n_known == 0 and r.train_tokens == 0 for r in got)


# --- the Jaccard join


def groups(rows, n, percent):
    """Sizes and smallest ids of components, by comparing all pairs."""
    sets = {}
    for doc, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets[doc] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (1, 60)])
def test_join_equals_all_pairs(spark, corpus, n, percent):
    rng = random.Random(n)
    rows = [(d, t) for d, t, *_ in corpus]
    base = [f"v{rng.randrange(300)}" for _ in range(120)]
    for k in range(40):  # a group whose members differ more and more
        words = list(base)
        for _ in range(rng.randint(0, 12)):
            words[rng.randrange(len(words))] = f"u{rng.randrange(50)}"
        rows.append((5_000 + k, " ".join(words[: rng.randint(100, 120)])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, n=n, percent=percent).collect()}
    assert got == groups(rows, n, percent)


def test_region_keys_never_miss_a_pair():
    rng = np.random.default_rng(3)
    for percent in (80, 85, 95):
        for _ in range(150):
            size = int(rng.integers(1, 400))
            x = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            gone = int(rng.integers(0, max(1, len(x) // 5)))
            y = np.unique(np.concatenate([x[gone:], rng.integers(0, 2**64, int(rng.integers(0, 1 + len(x) // 6)), dtype=np.uint64)]))
            common, union = len(np.intersect1d(x, y)), len(np.union1d(x, y))
            if common * 100 >= union * percent and len(x) and len(y) and (len(x) != len(y) or (x != y).any()):
                assert np.intersect1d(ngram_join.region_keys(x, percent), ngram_join.region_keys(y, percent)).size
                flips = sum(int(v).bit_count() for v in (ngram_join.parity(x) ^ ngram_join.parity(y)).view(np.uint64))
                assert flips <= union - common


def test_join_of_odd_rows(odd_docs, no_docs, docs):
    got = ngram_join.jaccard_components(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert ngram_join.jaccard_components(no_docs).count() == 0
    kept = ngram_join.keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns and kept.filter("doc_id is null").count() == 3


def test_join_beside_rows_without_an_id(spark):
    rng = random.Random(21)
    base = [" ".join(f"v{rng.randrange(300)}" for _ in range(80)) for _ in range(20)]
    rows = [(k, t) for k, t in enumerate(base)] + [(100 + k, f"{t} tail") for k, t in enumerate(base)]
    docs = spark.createDataFrame([*((None, t) for t in base), *rows], "doc_id bigint, text string").coalesce(1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect() if r.doc_id is not None}
    assert got == groups(rows, 4, 85) and got[100][1] == 0


def test_one_row_is_kept_of_each_component(spark):
    rng = random.Random(22)
    a, b, c, d = (" ".join(f"v{rng.randrange(300)}" for _ in range(80)) for _ in range(4))
    rows = [(4, a), (5, f"{a} tail"), (5, b), (6, c), (6, c), (6, f"{c} tail"), (7, c), (2, d), (3, d), (3, b), (None, a), (8, None), (8, None)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id bigint, text string, place int")
    kept = sorted((r.doc_id or 0, r.text or "") for r in ngram_join.keep_one_of_each(docs).collect())
    c_kept = [t for k, t in kept if k == 6]
    assert len(c_kept) == 1 and c_kept[0] in (c, f"{c} tail")
    assert [r for r in kept if r[0] != 6] == sorted([(0, a), (4, a), (3, b), (2, d), (8, ""), (8, "")])


# --- the pipeline


def test_pipeline_stages_take_effect(spark, tmp_path, corpus):
    rng = random.Random(15)
    item = " ".join(f"q{rng.randrange(500)}" for _ in range(30))
    rows, marks = [], []
    for k in range(400):
        words = [f"word{rng.randrange(800)}" for _ in range(rng.randint(20, 120))]
        toxic, junk = rng.random() < 0.2, rng.random() < 0.2
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vilest", "moronic"])
        if junk:
            words = [w.upper() + "!!" for w in words]
        rows.append((k, " ".join(words)))
        marks.append((k, int(not junk), int(toxic)))
    rows += [(1_000 + k, rows[k][1] + " tail") for k in range(0, 60)]
    rows += [(2_000 + k, f"{rows[k + 100][1]} {item}") for k in range(5)] + [(3_000, None), (3_001, "")]
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = dict(rows)
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, str(tmp_path))
        if name != "bpe":
            assert kept.columns == docs.columns
        got = {r.doc_id for r in kept.collect()}
        if name in ("toxicity", "quality"):  # the classifier's own scores decide
            scores = (toxicity if name == "toxicity" else quality).classified(docs, labels)
            want = {r.doc_id for r in scores.collect() if r.predicted == (name == "quality")}
        elif name == "ngram_jaccard_join":
            want = {d for d, (_, c) in groups(left.items(), 5, 80).items() if c == d}
        elif name == "decontamination":
            want = {d for d, t in left.items() if item not in (t or "")}
        else:
            want = set(left)
        assert got == want, name
        if name in ("ngram_jaccard_join", "decontamination"):
            assert len(got) < len(left)
        left = {d: left[d] for d in got}
        docs = spark.createDataFrame([r for r in kept.collect()], kept.schema) if name != "bpe" else kept
    whole = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == set(left)


def near_copies(rng, groups_of, size, changes):
    """Texts of which each has near copies, some of which link and some do not."""
    out = []
    for _ in range(groups_of):
        base = [f"v{rng.randrange(3000)}" for _ in range(120)]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randint(0, changes)):
                words[rng.randrange(len(words))] = f"u{rng.randrange(50)}"
            out.append(" ".join(words))
    return out


def test_near_copies_throughout_are_shuffled_range_by_range(spark, monkeypatch):
    rng = random.Random(23)
    rows = list(enumerate(near_copies(rng, 6, 6, 2)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    written = []

    def counted(table, label):
        out = plain(table, label)
        written.append((label, out.count()))
        return out

    plain = ngram_join.stored
    monkeypatch.setattr(ngram_join, "stored", counted)
    monkeypatch.setattr(ngram_join, "_AT_ONCE", 0, raising=False)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == groups(rows, 4, 85)
    ranked = [n for label, n in written if label == "ranked"]
    assert len(ranked) == 4 and max(ranked) < 0.5 * sum(ranked)
    assert sum(label == "sets" for label, _ in written) > 2  # and so do the sets of the pairs


def test_links_are_those_of_all_pairs(spark, corpus, monkeypatch):
    rng = random.Random(24)
    rows = [(d, t) for d, t, *_ in corpus]
    rows += [(5_000 + k, t) for k, t in enumerate(near_copies(rng, 3, 14, 4) * 2)]
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id bigint, text string")
    monkeypatch.setattr(ngram_join, "_BLOCK", 4, raising=False)
    found = ngram_join.jaccard_components(docs).collect()
    sets = {}
    for doc, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets[doc] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    near = lambda x, y: bool(x and y) and 100 * len(x & y) >= 85 * len(x | y)
    want = {d: sum(near(x, y) for e, y in sets.items() if e != d) for d, x in sets.items()}
    assert {r.doc_id: r.links for r in found if r.doc_id is not None} == want
    assert [r.links for r in found if r.doc_id is None] == [0]
