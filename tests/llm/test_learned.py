"""Quality, language and toxicity: held-out accuracy, the mathematics, and awkward rows."""

import itertools
import random
import zlib

import numpy as np
import pytest

from quillspark.llm import language, quality, toxicity


def corpus(n=900, seed=1):
    """(doc_id, text, lang, quality, toxic)."""
    rnd = random.Random(seed)
    words = {"en": "the of and that with house river stone walking light".split(), "de": "der und nicht haus fluß stein gehen über lichtung schön".split(), "fr": "les dans maison rivière pierre marcher été lumière où avec".split()}
    rows = []
    for i in range(n):
        lang = rnd.choice(list(words))
        w = [rnd.choice(words[lang]) + rnd.choice(["", "s", "e"]) for _ in range(rnd.randint(20, 90))]
        toxic, good = rnd.random() < 0.2, rnd.random() < 0.8
        if toxic:
            for _ in range(4):
                w.insert(rnd.randrange(len(w)), rnd.choice(["idiot", "vermin", "grumpfel", "grumpfeln"]))
        text = " ".join(w) + "."
        if not good:
            text = rnd.choice([lambda t: t.upper().replace(" ", "!! "), lambda t: " ".join(x + "$$$" for x in t.split()), lambda t: " ".join(t.split()[:1] * 60)])(text)
        rows.append((i, text, lang, int(good), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3], r[4]) for r in rows if r[0] % 3], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_quality_held_out(tables):
    rows, docs, labels = tables
    got = {r["doc_id"]: r for r in quality.digests(docs, labels).collect()}
    assert all(got[r[0]]["held_out"] == (fold(r[0], 5) == 0) for r in rows)
    held = [r for r in rows if fold(r[0], 5) == 0]
    assert np.mean([got[r[0]]["predicted"] == r[3] for r in held]) > 0.95
    assert all(0 <= g["score"] <= 1 and g["predicted"] == int(g["score"] >= 0.3) for g in got.values())
    again = {r["doc_id"]: r["score"] for r in quality.digests(docs, labels).collect()}
    assert all(again[i] == got[i]["score"] for i in again)


def test_nnpu_separates_without_negatives():
    rng = np.random.default_rng(0)
    pos, neg = rng.normal(1.5, 1, (600, 3)), rng.normal(-1.5, 1, (400, 3))
    unl = np.concatenate([rng.normal(1.5, 1, (600, 3)), neg])
    net = quality.fit_nnpu(pos, unl, 0.6)
    assert (net.score(pos) > 0.5).mean() > 0.93 and (net.score(neg) > 0.5).mean() < 0.07


def test_toxicity_held_out(tables):
    rows, docs, labels = tables
    got = {r["doc_id"]: r for r in toxicity.digests(docs, labels).collect()}
    held = [r for r in rows if fold(r[0], 5) == 0]
    assert np.mean([got[r[0]]["predicted"] == r[4] for r in held]) > 0.95
    assert all(0 <= g["score"] <= 1 for g in got.values())


def test_isotonic_never_falls():
    rng = np.random.default_rng(1)
    m = rng.normal(size=300)
    x, p = toxicity.fit_isotonic(m, (rng.random(300) < 1 / (1 + np.exp(-m))).astype(float))
    assert (np.diff(p) >= 0).all() and (np.diff(x) >= 0).all() and p.min() >= 0 and p.max() <= 1


def test_obfuscated_words_are_found():
    weight = toxicity.Matcher({"idiot": 4.0})
    at = toxicity.NAMES.index("odd_hits")
    assert toxicity.features("you 1d10t and i.d.i.o.t", weight)[at] > 0 and toxicity.features("you are kind, v1.2 of 2020", weight)[at] == 0


def test_language_held_out(tables):
    rows, docs, _ = tables
    got = {r["doc_id"]: r for r in language.digests(docs).collect()}
    held = [r for r in rows if fold(r[0], 4) == 2]
    assert all(got[r[0]]["held_out"] for r in held)
    assert np.mean([got[r[0]]["lang_pred"] == r[2] for r in held]) > 0.97


def test_words_of_mixed_text(tables):
    rows, docs, _ = tables
    field = language.train(docs)
    text = "the house and the river light der fluß und nicht das haus über les maisons dans la rivière été"
    doc, post = language.Labeller(field).word_posteriors([text])
    said = [field.langs[i] for i in post.argmax(axis=1)]
    assert said[:5] == ["en"] * 5 and said[8:11] == ["de"] * 3 and said[-3:] == ["fr"] * 3


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    e, start, moves, sizes = rng.normal(size=(8, 3)), rng.normal(size=3), rng.normal(size=(3, 3)), [4, 1, 3]
    got = language.forward_backward(e, np.array([0, 4, 5]), np.array(sizes), start, moves)
    at = 0
    for n in sizes:
        want, total = np.zeros((n, 3)), 0.0
        for path in itertools.product(range(3), repeat=n):
            w = np.exp(start[path[0]] + sum(e[at + i, k] for i, k in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))  # noqa: B905
            total += w
            for i, k in enumerate(path):
                want[i, k] += w
        assert np.allclose(got[at : at + n], want / total)
        at += n
    post, pairs = language.uniform_pass(e[:4].reshape(1, 4, 3), start, moves)
    assert np.allclose(post[0], got[:4]) and np.isclose(pairs.sum(), 3)


@pytest.mark.parametrize("block", [1, 2, 5, 300])
def test_long_chains_in_blocks(block):
    rng = np.random.default_rng(3)
    sizes = np.array([17, 1, 6, 250, 11])
    starts = np.cumsum(sizes) - sizes
    e, start, moves = rng.normal(size=(sizes.sum(), 4)) * 3, rng.normal(size=4), rng.normal(size=(4, 4))
    assert np.allclose(language.forward_backward(e, starts, sizes, start, moves, block), language.forward_backward(e, starts, sizes, start, moves, 1000))


def test_switched_words(tables):
    """Words of held-out texts of two languages in turn, seven of one and then seven of the other."""
    rows, docs, _ = tables
    field, rnd, right, every = language.train(docs), random.Random(9), 0, 0
    held = [(r[1].rstrip(".").lower().split(), r[2]) for r in rows if fold(r[0], 4) == 2 and r[1].islower() and r[1].count(" ") > 20]
    for _ in range(60):
        words, want = [], []
        for own, lang in rnd.sample(held, 3):
            own = [w for w in own if w.isalpha()][:7]
            words, want = words + own, want + [lang] * len(own)
        post = language.Labeller(field).word_posteriors([" ".join(words)])[1]
        right += sum(field.langs[i] == w for i, w in zip(post.argmax(axis=1), want, strict=True))
        every += len(want)
    assert right / every > 0.9


def test_each_of_many_languages_is_learned(spark):
    rows = [(i, f"wa{i % 60}x wb{i % 60}y wc{i % 60}z", f"l{i % 60}") for i in range(600)]
    assert len(language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=30).langs) == 60


def test_risk_and_its_derivative():
    rng = np.random.default_rng(2)
    positive = np.arange(30) < 12
    for shift, prior in ((0.0, 0.4), (-3.0, 0.9), (3.0, 0.2)):
        g = rng.normal(size=30) + np.where(positive, -shift, shift)
        plus, minus = np.log1p(np.exp(-g)), np.log1p(np.exp(g))
        rest = minus[12:].mean() - prior * minus[:12].mean()
        value, d = quality.pu_risk(g, positive, prior)
        assert np.isclose(value, prior * plus[:12].mean() + max(0, rest))
        whole = lambda x: (prior * np.log1p(np.exp(-x[:12])).mean() + np.log1p(np.exp(x[12:])).mean() - prior * np.log1p(np.exp(x[:12])).mean()) if rest >= 0 else -(np.log1p(np.exp(x[12:])).mean() - prior * np.log1p(np.exp(x[:12])).mean())  # noqa: E731, B023
        step = np.array([(whole(g + 1e-6 * np.eye(30)[i]) - whole(g - 1e-6 * np.eye(30)[i])) / 2e-6 for i in range(30)])
        assert np.allclose(d, step, atol=1e-6)


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.8])
def test_prior_from_positives_and_unlabelled(prior):
    rng = np.random.default_rng(4)
    draw = lambda n, at: rng.normal(at, 1, (n, 3))
    unl = rng.permutation(np.concatenate([draw(int(3000 * prior), 1.8), draw(3000 - int(3000 * prior), -1.8)]))
    assert abs(quality.estimate_prior(draw(1500, 1.8), unl) - prior) < 0.06


def test_quality_without_any_label_0(tables, spark):
    rows, docs, labels = tables
    got = {r["doc_id"]: r["score"] for r in quality.digests(docs, labels.filter("quality = 1")).collect()}
    held = [r for r in rows if fold(r[0], 5) == 0]
    assert np.mean([(got[r[0]] >= 0.5) == r[3] for r in held]) > 0.95
    same = {r["doc_id"]: r["score"] for r in quality.digests(docs, labels).collect()}
    assert same == got


def test_awkward_rows(spark, odd, empty, tables):
    _, docs, labels = tables
    net, model, field = quality.train(docs, labels), toxicity.train(docs, labels), language.train(docs)
    for out, base in ((quality.score(odd, net), odd), (toxicity.score(odd, model), odd)):
        rows = out.collect()
        assert len(rows) == base.count() and all(0 <= r["score"] <= 1 for r in rows) and set(out.columns) == set(odd.columns)
    said = {r["text"]: r for r in language.predict(odd, field).collect()}
    assert said[None]["lang_pred"] == said[""]["lang_pred"] == said["12 34 !!"]["lang_pred"] == "und" and said["a"]["lang_pred"] in field.langs
    none = labels.limit(0)
    assert {r["score"] for r in quality.digests(docs.limit(3), none).collect()} == {0.5} and {r["score"] for r in toxicity.digests(docs.limit(3), none).collect()} == {0.0}
    assert language.digests(empty).count() == 0 and quality.digests(empty, labels).count() == 0 and toxicity.digests(empty, labels).count() == 0
    assert {r["lang_pred"] for r in language.digests(odd.withColumn("lang", odd["lang"].substr(9, 1)).filter("lang is null")).collect()} <= {"und"}
