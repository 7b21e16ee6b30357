"""The pipeline on a small corpus against plain Python: every stage of run() by hand, and the stages' form."""

import hashlib
import random
import re
from collections import defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from quillspark.llm import byte_bpe, mixing, quality

DATA = Path("/root/testdata/sf0.001")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = " \t\n\x0b\x0c\r"


def corpus():
    """Documents with junk, shared lines, exact copies, copies at a similarity of 0.8 to 1, and texts of several topics."""
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(3, 9))) for _ in range(1500)]
    shared = [" ".join(rnd.choices(vocabulary, k=12)) + f" Shared{n}" for n in range(6)]
    rows = []

    def add(text, source=None):
        rows.append((len(rows), text, rnd.choice(["en", "en", "en", "de", None]), source or rnd.choice(["web", "web", "web", "books", "code"]), len(text or "")))

    for k in range(90):
        words = rnd.choices(vocabulary, k=rnd.choice([40, 90, 200]))
        if k % 5 == 0:
            words.insert(3, rnd.choice(["copyright", "me@example.org", "| x |", "1984"]))
        body = " ".join(words)
        add(body + ("\n" + "\n".join(rnd.sample(shared, 2)) if k % 3 == 0 else ""))
        if k % 4 == 0:
            own = list(words)
            for i in rnd.sample(range(6, len(own) - 6), 1 + k % 3):
                own[i] = rnd.choice(vocabulary)
            add(" ".join(own))
        if k % 9 == 0:
            add(body.upper())
    for _ in range(40):
        add(rnd.choice(["!!! ", "$$$ BUY ", "x ", "||| "]) * rnd.randint(20, 60))
    add(None)
    add("")
    labels = [(i, int(i < len(rows) - 42), 0) for i in range(len(rows)) if i % 4]
    return rows, labels


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows, labels = corpus()
    pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).to_parquet(path / "documents.parquet", index=False)
    pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).to_parquet(path / "labels.parquet", index=False)
    return str(path)


def without_repeated_lines(docs):
    key = lambda x: x.strip(BLANK).translate(LOWER)
    holders = defaultdict(set)
    for d in docs:
        for x in (d["text"] or "").split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(d["doc_id"])
    hot = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    out = []
    for d in docs:
        lines = (d["text"] or "").split("\n")
        kept = [x for x in lines if hot.get(key(x), d["doc_id"]) == d["doc_id"]]
        out.append({**d, "text": "\n".join(kept)} if len(kept) < len(lines) else d)
    return out


def one_of_each_group(docs):
    def parts(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [parts(d["text"]) for d in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if (not a and not sets[j]) or (a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j])):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [d for i, d in enumerate(docs) if find(i) == i]


def mixed(docs):
    def topic(text):
        return next((n for n, p in mixing.TOPICS if re.search(p, text or "")), "prose")

    cells = defaultdict(float)
    for d in docs:
        d["cell"] = (d["source"], d["lang"], topic(d["text"]))
        cells[d["cell"]] += len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or ""))
    names, tokens = list(cells), np.array(list(cells.values()))
    weight = np.ones(len(names))
    goals = []
    for m in range(3):
        at = np.array([sorted({repr(n[m]) for n in names}).index(repr(n[m])) for n in names])
        own = np.bincount(at, tokens)
        share = np.where(own > 0, own, 0) ** mixing.TEMPER * (own > 0)
        share, now = share / share.sum(), own / own.sum()
        high = share > mixing.LIFT * now
        share = np.where(high, mixing.LIFT * now, share * (1 - (mixing.LIFT * now[high]).sum()) / share[~high].sum())
        goals.append((at, share))
    for _ in range(200):
        for at, share in goals:
            sums = np.bincount(at, weight * tokens)
            weight = np.where(sums[at] > 0, weight * share[at] * tokens.sum() / np.where(sums[at] > 0, sums[at], 1), 0)
    chance = dict(zip(names, weight / weight[tokens > 0].max(), strict=True))
    return [d for d in docs if int(hashlib.md5(str(d["doc_id"]).encode()).hexdigest()[:8], 16) / 2**32 < min(1, chance[d["cell"]])]


def test_run_is_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [{"doc_id": r[0], "text": r[1], "lang": r[2], "source": r[3]} for r in corpus()[0]]
    good = [d for d in rows if net.score(quality.feature_rows([(d["text"] or "").encode()]))[0] >= 0.3]
    assert {d["doc_id"] for d in rows[:-42]} <= {d["doc_id"] for d in good} and len(good) < len(rows) - 30
    lined = without_repeated_lines(good)
    alone = one_of_each_group(lined)
    assert sum(a["text"] != b["text"] for a, b in zip(good, lined, strict=True)) > 10 and len(alone) <= len(lined) - 15
    want = mixed(alone)
    assert 0 < len(want) < len(alone)
    ranks = byte_bpe.codec(*_tokenizer()).encoding
    assert isinstance(ranks, tiktoken.Encoding)
    expected = {}
    for d in want:
        ids = np.asarray(ranks.encode_ordinary(d["text"] or ""), "<u4")
        expected[d["doc_id"]] = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((d["text"] or "").encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == expected


def test_stages_return_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_whole_run(spark):
    got = corpus_pipeline.run(spark, str(DATA)).collect()
    ids = {r["doc_id"] for r in got}
    assert len(ids) == len(got) > 0 and all(r["n_tokens"] >= 0 and len(r["ids_sha256"]) == 64 for r in got)


def test_stages_of_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0, name


def _tokenizer():
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
