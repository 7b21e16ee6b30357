"""Near copies by similarity of shingles, against all pairs."""

import random

import numpy as np

import corpus_pipeline
from quillspark.llm import shingles, simhash


def jaccard(a, b, words=5):
    a, b = ({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def planted():
    """Texts with copies of which 1 to 10 words in 400 are others, a large group of near copies, a common passage, short texts."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(rnd.choices(words, k=60))
    out = []
    for k in range(60):
        base = rnd.choices(words, k=rnd.choice([30, 150, 262, 400]))
        out.append(" ".join(base))
        for n in range(1, 5):
            own = list(base)
            for i in rnd.sample(range(len(own)), max(1, len(own) * n // 160)):
                own[i] = rnd.choice(words)
            out.append(" ".join(own) + (f" {passage}" if k % 7 == 0 else ""))
    base = rnd.choices(words, k=200)
    out += [" ".join([*base[:i], "x", *base[i + 1 :]]) for i in range(150)]
    base = rnd.choices(words, k=270)
    out += [" ".join(base[:n]) for n in (270, 255)]  # their sketches differ in length
    return out + ["a b", "A  b", "a c", "", " ", "one two three four five", "one two three four five six"]


def components(texts):
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(texts):
        for j in range(i):
            if a.split() and texts[j].split() and jaccard(a, texts[j]) >= 0.8 or not (a.split() or texts[j].split()):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def test_groups_are_those_of_all_pairs(spark):
    texts = planted()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = components(texts)
    got = {r["doc_id"]: r["component_id"] for r in simhash.groups(df).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert {r["doc_id"] for r in simhash.dedup(df).collect()} == set(want)


def test_near_copies_of_ranges_that_distance_3_misses(spark):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for k in range(60):
        base = rnd.choices(words, k=400)
        own = list(base)
        for i in rnd.sample(range(5, 395), 1 + k % 9):
            own[i] = "other"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(own))]
    near = [k for k in range(60) if 0.8 <= jaccard(rows[2 * k][1], rows[2 * k + 1][1]) < 0.95]
    kept = {r["doc_id"] for r in simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) > 20 and not kept & {2 * k + 1 for k in near}
    assert kept == {i for i in range(120) if i % 2 == 0 or jaccard(rows[i - 1][1], rows[i][1]) < 0.8}


def test_the_pipeline_goes_through_ball_hashing(spark, monkeypatch):
    """Every distinct fingerprint is asked for its ball, and what balls and equal fingerprints link is what brute force over fingerprints links."""
    texts = planted()
    sets = {shingles._id(x): x for x in (shingles.shingles(t.encode()) for t in texts)}
    prints = {i: shingles.fingerprint(x) for i, x in sets.items()}
    asked, found, links, in_balls = [], [], simhash.links, shingles.in_balls

    def near(distinct, **more):
        asked.extend(r[0] for r in distinct.collect())
        return links(distinct, **more)

    def kept(*given):
        out = in_balls(*given)
        found.extend((r["u"] % 2**64, r["v"] % 2**64) for r in out.collect())
        return out

    monkeypatch.setattr(simhash, "links", near)
    monkeypatch.setattr(shingles, "in_balls", kept)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert corpus_pipeline.near_copies(spark, df, "").count() == len(set(components(texts)))
    assert sorted(x % 2**64 for x in asked) == sorted(set(prints.values()))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in found:
        assert (prints[u] ^ prints[v]).bit_count() <= 3
        root[find(u)] = find(v)
    own = list(sets)
    near_by = [(a, b) for n, a in enumerate(own) for b in own[:n] if 0 < (prints[a] ^ prints[b]).bit_count() <= 3]
    assert len(near_by) > 100 and all(find(a) == find(b) for a, b in near_by if list(prints.values()).count(prints[a]) == list(prints.values()).count(prints[b]) == 1)


def test_fingerprint_of_a_set():
    own = shingles.shingles(" ".join(random.Random(5).choices("abcdefgh", k=40_000)).encode())
    assert len(own) > shingles.FEW
    want = sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in own) > len(own))
    assert shingles.fingerprint(own) == want and shingles.fingerprint(own[:0]) == 0 and shingles.fingerprint(own[:1]) == int(own[0])


def test_shingles_of_short_texts():
    assert len(shingles.shingles(b"")) == 0 and len(shingles.shingles(b"a b")) == 1 and len(shingles.shingles(b"A b c d e F a b c d e f")) == 6


def test_sketches_bound_the_difference():
    rnd = random.Random(1)
    for _ in range(50):
        a, b = (" ".join(rnd.choices("abcdef", k=rnd.randint(0, 3000))).encode() for _ in range(2))
        x, y = shingles.shingles(a), shingles.shingles(b)
        bits = int(np.bitwise_count((shingles.sketch(x) ^ shingles.sketch(y)).view("uint64")).sum())
        assert bits <= len(set(x.tolist()) ^ set(y.tolist()))


def test_pairs_of_a_bucket_are_few():
    """Neighbours and leaders: linear in the bucket, and connected where all are alike."""
    n = 5000
    c = [np.zeros(n, np.int64), np.arange(n), np.full(n, 50, np.int32), np.zeros(n, np.int32), *[np.zeros(n, np.int64)] * shingles.SKETCH]
    u, v = next(shingles._nearest(0.8)(c))
    assert n - 1 <= len(u) < 2.1 * n and np.bincount(np.concatenate([u, v])).max() < 4 * shingles.BLOCK
    two = [np.concatenate([x, x + (1 if i == 0 else n if i == 1 else 0)]) for i, x in enumerate(c)]
    u, v = next(shingles._nearest(0.8)(two))
    assert ((u < n) == (v < n)).all()
