"""The exact operators against brute force, round trips and awkward rows."""

import base64
import hashlib
import json
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm import byte_bpe, common, line_dedup, media, mixing, quality, simhash, token_files, topk
from quillspark.llm.components import components

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")


def pandas_view(name, df):
    con = duckdb.connect()
    con.register(name, df.toPandas())
    return con


# -- byte-level BPE ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(tik, text):
    return np.asarray(tik.encode_ordinary(text or ""), "<u4").tobytes()


@pytest.mark.parametrize("chunk, overlap, spread", [(1 << 13, 1 << 8, 1 << 16), (64, 16, 200), (16, 4, 1 << 16), (16, 4, 0)])
def test_bpe_chunks_are_the_library(spark, odd, tik, chunk, overlap, spread):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(["a", "é", " ", "  ", "\n", "'s", "1", "!!", "zz", "日本", "'"]) for _ in range(rnd.randint(1, 600))) for _ in range(60)] + [" " * 300 + "z", "ab" * 400, None, ""]
    df = odd if chunk > 100 else spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    rows = byte_bpe.decode(byte_bpe.encode(df, RANKS, P.PATTERN, chunk=chunk, overlap=overlap, spread=spread), RANKS, P.PATTERN).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert bytes(r["token_ids"]) == ids_of(tik, r["text"]) and bytes(r["decoded"]) == (r["text"] or "").encode() and r["n_tokens"] == len(r["token_ids"]) // 4


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab1 \n\t'sé!日 ")), max_size=120), st.integers(3, 20), st.integers(1, 12))
def test_stitching(text, chunk, overlap):
    c = byte_bpe.codec(RANKS, P.PATTERN)
    parts = []
    for a, b in byte_bpe.spans(len(text), chunk, overlap):
        ends, ids = c.pieces(text[a:b])
        parts.append((a, b, ends, ids))
    got = b"".join(c.memo[s] if ids is None else ids for s, ids in byte_bpe.stitch(text, parts, c.find))
    assert got == c.encode(text) == c.encode(text, chunk, overlap)


# -- line dedup ----------------------------------------------------------------------------------------------------------------


def lines_by_hand(rows, min_docs, min_chars):
    blank = " \t\n\x0b\x0c\r"
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(blank).translate(table)
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add(i)
    hot = {k: max((i for i in v if i is not None), default=None) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in hot or hot[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def lined(spark):
    rnd = random.Random(2)
    pool = [f"{'Shared ' if n % 2 else 'ÀÉ shared '}line number {n} that is long enough to count" for n in range(12)] + ["short"]
    rows = [(i, "\n".join(rnd.choice(["", " ", "\t"]) + (rnd.choice(pool).upper() if rnd.random() < 0.2 else rnd.choice(pool)) for _ in range(rnd.randint(0, 6)))) for i in range(60)]
    rows += [(3, rows[3][1]), (3, pool[1]), (None, pool[1] + "\n" + pool[3]), (99, None), (98, "")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_lines_are_those_of_brute_force(lined):
    rows, df = lined
    got = sorted((tuple(r) for r in line_dedup.digests(df).collect()), key=repr)
    assert got == lines_by_hand(rows, 5, 40)


def test_lines_in_sql(lined):
    rows, df = lined
    own = df.filter("doc_id is not null").dropDuplicates(["doc_id"])
    want = pandas_view("documents", own).execute(line_dedup.SQL).fetchall()
    assert sorted(tuple(r) for r in line_dedup.digests(own).collect()) == sorted(want)


def test_without_filters_in_memory(lined):
    rows, df = lined
    state = line_dedup.build(df)
    a = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in line_dedup.apply(state, df).collect())
    b = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in line_dedup.apply(state, df, refs=state.refs).collect())
    assert a == b


def test_deleting_takes_insertion_back(lined):
    rows, df = lined
    first, more = df.filter("doc_id < 30"), df.filter("doc_id >= 30")
    before = line_dedup.build(first)
    both = line_dedup.insert(before, more)
    assert {tuple(r) for r in both.hot.collect()} == {tuple(r) for r in line_dedup.build(df.filter("doc_id is not null")).hot.collect()}
    after = line_dedup.delete(both, more.select("doc_id"))
    assert {tuple(r) for r in after.hot.collect()} == {tuple(r) for r in before.hot.collect()}
    known = np.array([r["k2"] for r in before.hot.collect()], dtype=np.int64)
    tables = [line_dedup.CuckooFilter(0, np.frombuffer(bytes(r["slots"]), np.uint16).reshape(-1, 4)) for r in after.filters.collect()]
    assert np.any([f.contains(known) for f in tables], axis=0).all()
    assert sum(int((f.table > 0).sum()) for f in tables) == len(known)


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    keys, others = rng.integers(-(2**62), 2**62, 5000), rng.integers(-(2**62), 2**62, 20000)
    f = line_dedup.filled(keys)
    assert f.contains(keys).all() and f.contains(others).mean() < 0.002
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01


# -- SimHash -------------------------------------------------------------------------------------------------------------------


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprint_by_hand():
    for text in ("", "a", "A b", "the cat sat on the mat the cat sat", "ÀÉ b\tc\x0bd e"):
        w = [x for x in text.encode().lower().replace(b"\x0b", b" ").split()]
        shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        want = sum(1 << i for i in range(64) if 2 * sum(xxhash.xxh64_intdigest(s, 42) >> i & 1 for s in shingles) > len(shingles))
        assert simhash.fingerprint(text.encode()) == want


def test_links_connect_what_brute_force_connects(spark):
    rng = np.random.default_rng(0)
    f = set()
    for b in rng.integers(0, 2**63, 40, dtype=np.uint64):
        for _ in range(12):
            x = int(b)
            for _ in range(rng.integers(0, 5)):
                x ^= 1 << int(rng.integers(64))
            f.add(x)
    f = np.array(sorted(f), dtype=np.uint64)
    df = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fingerprint long")
    got = [(r["u"], r["v"]) for r in simhash.links(df).collect()]
    at = {int(x): i for i, x in enumerate(f.view(np.int64))}
    d = np.bitwise_count(f[:, None] ^ f[None])
    assert all(d[at[a], at[b]] <= 3 for a, b in got)
    assert union(len(f), [(at[a], at[b]) for a, b in got]) == union(len(f), zip(*np.nonzero(np.triu(d <= 3, 1)), strict=True))


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = union(1100, [e for e in edges if e[0] != e[1]])
    assert got and all(want[n] == r for n, r in got.items()) and set(got) == {x for a, b in edges if a != b for x in (a, b)}


def test_near_copies(spark, odd, empty):
    rows = simhash.groups(odd).collect()
    ids = sorted([r["doc_id"] for r in rows], key=repr)
    assert ids == sorted([r["doc_id"] for r in odd.collect()], key=repr)
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["component_id"] == by[1]["component_id"] == by[2]["component_id"] == 0 and by[10]["component_id"] == by[11]["component_id"] == 10
    kept = simhash.dedup(odd).collect()
    assert len(kept) == len({r["component_id"] for r in rows if r["doc_id"] != 3 or r["component_id"] == 3} | {3})
    assert sum(r["text"] == "same text" for r in kept) == 1 and sum(r["doc_id"] == 3 for r in kept) == 1 and any(r["doc_id"] is None for r in kept)
    assert simhash.dedup(odd.filter("doc_id is not null and doc_id <> 3")).filter("text = 'same text'").count() == 1
    assert simhash.groups(empty).count() == 0 and simhash.dedup(empty).count() == 0
    assert all(len(r["fingerprint"]) == 16 for r in simhash.digests(odd).collect())


# -- token files -----------------------------------------------------------------------------------------------------------------


def test_token_files(spark, odd, empty):
    t = Tokenizer.from_file(WORDS)
    rows = [r for r in odd.collect() if r["doc_id"] is not None and r["doc_id"] != 3] + [r for r in odd.collect() if r["doc_id"] == 3][:1]
    got = {r["doc_id"]: r for r in token_files.digests(odd.filter("doc_id is not null").dropDuplicates(["doc_id"]), WORDS).collect()}
    at = 0
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        g = got[r["doc_id"]]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.digests(odd, WORDS).count() == odd.count() and token_files.digests(empty, WORDS).count() == 0


def test_word_memo_is_the_library():
    t, e = Tokenizer.from_file(WORDS), token_files.WordEncoder(WORDS)
    for text in ["it's 'Sup they'll <|endoftext|>x <|startoftext|>. a²b ⅷ. ΑΣ. ΑΣ ÀÉ́ x́. \tfoo\r\nbar\x0bq", "stupid$$$ don't. can't!", "日本語。テスト, x İstanbul. ǅ! ﬁ.", ""]:
        assert np.frombuffer(e.encode([text])[0], e.kind).tolist() == t.encode(text, add_special_tokens=False).ids


def test_plain_words_are_the_library():
    """Lower-case Latin words go to a tokenizer without the normalizer; a memo of few words, which is turned over within a text, changes nothing."""
    t, e = Tokenizer.from_file(WORDS), token_files.WordEncoder(WORDS)
    letters = [c for c in map(chr, range(256)) if c.isalpha() and c.islower()]
    words = ["".join(letters[(i * j + j) % len(letters)] for j in range(1, 2 + i % 9)) for i in range(400)]
    want = t.encode(" ".join(words), add_special_tokens=False).ids
    assert e.plain.encode(" ".join(words), add_special_tokens=False).ids == want
    e.words = token_files.Generations(5)
    texts = [" ".join(words), "", "\n".join(w.title() + "?!"[: i % 3] for i, w in enumerate(words[:200])), "a. A, b a; (a) a@b.c --"]
    for _ in range(2):
        assert [np.frombuffer(x, e.kind).tolist() for x in e.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("least", [1, 2, 16])
def test_runs(least):
    a = np.sort(np.random.default_rng(least).zipf(1.3, 3000).clip(0, 500).astype(np.uint32))
    values, first, counts = np.unique(a, return_index=True, return_counts=True)
    assert token_files._runs(a, least).tolist() == first[counts >= least].tolist() and not len(token_files._runs(a[:0], least))


def test_other_tokenizers_get_whole_texts(tmp_path):
    told = json.load(open(WORDS, encoding="utf-8"))
    assert isinstance(token_files.encoder(WORDS), token_files.WordEncoder)
    told["normalizer"]["normalizers"].pop()  # without lower case
    (tmp_path / "other.json").write_text(json.dumps(told))
    e, t = token_files.encoder(str(tmp_path / "other.json")), Tokenizer.from_file(str(tmp_path / "other.json"))
    assert not isinstance(e, token_files.WordEncoder)
    assert np.frombuffer(e.encode(["The QUICK fox"])[0], e.kind).tolist() == t.encode("The QUICK fox", add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=300), st.sampled_from([10, 70_000]))
def test_grammar_round_trip(ids, first):
    a = np.array(ids, dtype=np.int64)
    block = token_files.Block.unpack(token_files.re_pair(a, first, rounds=5, pairs=7, least=2).pack())
    assert block.decode().tolist() == ids and block.count == len(ids)
    for lo in range(0, len(ids), 37):
        hi = min(len(ids), lo + 11)
        assert block.decode_range(lo, hi).tolist() == ids[lo:hi]


# -- mixing ------------------------------------------------------------------------------------------------------------------------


def test_mixing_in_sql(odd):
    own = odd.select("doc_id", "text", "source", "lang").filter("length(text) < 1000 or text is null")
    con = pandas_view("documents", own.filter("doc_id is not null"))
    got = sorted(tuple(r) for r in mixing.digests(own.filter("doc_id is not null")).fillna("?").collect())
    want = [tuple("?" if v is None else v for v in r) for r in con.execute(mixing.sql()).fetchall()]
    assert got == sorted(want)


def test_raking_meets_the_targets(spark):
    rnd = random.Random(5)
    rows = [(f"s{a}", f"l{b}", f"t{c}", rnd.randint(50, 5000)) for a in range(5) for b in range(3) for c in range(3)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    goal = spark.createDataFrame([("l0", 0.2), ("l1", 0.5), ("l2", 0.3)], "value string, share double")
    out = mixing.rake(cells, sweeps=12, targets={"lang": goal}).collect()
    total = sum(r["tokens"] for r in out)
    share = lambda k, v: sum(r["weight"] * r["tokens"] for r in out if r[k] == v) / total
    assert [round(share("lang", f"l{b}"), 4) for b in range(3)] == [0.2, 0.5, 0.3]
    plain = {f"s{a}": sum(r[3] for r in rows if r[0] == f"s{a}") ** mixing.TEMPER for a in range(5)}
    assert all(abs(share("source", s) - v / sum(plain.values())) < 1e-4 for s, v in plain.items())
    assert {r["residual"] for r in out} <= {out[0]["residual"]} and out[0]["residual"] < 1e-6
    assert mixing.rake(cells).first()["residual"] <= mixing.TOLERANCE
    kept = mixing.calibrated(mixing.rake(cells), keep=0.6).collect()
    assert abs(sum(r["probability"] * r["tokens"] for r in kept) / total - 0.6) < 1e-6 and all(0 <= r["probability"] <= 1 for r in kept)


def test_mixing_keeps_columns(odd, empty):
    out = mixing.sample(odd)
    assert out.columns == odd.columns and out.count() <= odd.count() and mixing.sample(empty).count() == 0
    assert all(r[c] == f"own {c}" for r in out.collect() for c in odd.columns[4:])
    plan = mixing.digests(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- top-k ---------------------------------------------------------------------------------------------------------------------------


def best_by_hand(rows, every, k):
    v = {(i, tuple(int(np.floor(256 * float(x))) for x in e)) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    out = []
    for q, a in v:
        if q % every == 0:
            found = sorted(((-sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in v if c != q and len(b) == len(a)))[:k]
            out += [(q, n, c, -s) for n, (s, c) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_topk_is_brute_force(spark, spread):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 6))
    rows = [(i, [float(x) for x in np.float32((base[i % 12] + rng.normal(size=6) * 0.1) * np.exp(spread * rng.normal()))]) for i in range(400)]
    rows += [(400 + i, rows[5][1]) for i in range(40)] + [(500, None), (501, [1.0, None]), (502, [float("nan")] * 6), (503, [0.0] * 6), (550, [0.0] * 6), (600, [1.0, 2.0]), (601, [2.0, 1.0]), (5, rows[5][1]), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.search(df, lambda c: c % 50 == 0, block=32, queries=4, buckets=5).collect())
    assert got == best_by_hand(rows, 50, 5)
    assert topk.digests(df.limit(0)).count() == 0


def test_block_search_prunes_nothing_needed():
    rng = np.random.default_rng(1)
    c = rng.integers(-200, 200, (300, 8))
    norms = np.sqrt((c * c).sum(axis=1))
    order = np.argsort(-norms)
    c, norms, ids = c[order], norms[order], np.arange(300)
    q = c[::29] + rng.integers(-3, 3, c[::29].shape)
    scores = q @ c.T
    for rank in (1, 5, 50):
        bounds = np.sort(scores, axis=1)[:, -rank].astype(float)
        got = topk.search_block(-1 - np.arange(len(q)), q, np.sqrt((q * q).sum(axis=1)), bounds, ids, c, norms, 5)
        want = sorted((int(-1 - i), int(j), int(scores[i, j])) for i in range(len(q)) for j in sorted(ids, key=lambda j: (-scores[i, j], j))[: min(5, rank)])
        assert set(want) <= set(got)


# -- media -----------------------------------------------------------------------------------------------------------------------------


def png():
    import struct

    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"\0ab")) + part(b"IEND", b"")


def samples():
    import gzip
    import io
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "hello")
    gif = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff\x2c\0\0\0\0\x01\0\x01\0\0\x02\x02\x44\x01\0\x3b"
    bmp = b"BM" + (58).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (1).to_bytes(4, "little") * 2 + b"\x01\0\x18\0" + bytes(24) + b"abc\0"
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x02xy\xff\0z\xff\xd9"
    return {"image/png": png(), "application/zip": z.getvalue(), "application/gzip": gzip.compress(b"x" * 999), "image/gif": gif, "audio/wav": media.wav(b"abc"), "image/bmp": bmp, "image/jpeg": jpeg, "image/x-portable-graymap": b"P5\n3 2\n255\nabcdef", "application/pdf": b"%PDF-1.4\nstartxref\n0\n%%EOF"}


@pytest.mark.parametrize("kind", sorted(samples()))
def test_sniffing(kind):
    raw = samples()[kind]
    assert media.sniff(raw)[:2] == (kind, len(raw))
    assert media.sniff(b"text " + raw + b" RIFF GIF89a BM %PDF- PK\x03\x04")[2][0] == (kind, 5, len(raw))
    assert media.sniff(raw[:-1])[0] == media.UNKNOWN or kind in ("application/pdf", "audio/wav") or media.sniff(raw[:-1])[1] < len(raw)


def test_archives_after_one_another():
    one = samples()["application/zip"]
    found = media.sniff(one + b"--" + one + b"PK\x03\x04")
    assert found[:2] == ("application/zip", len(one)) and (("application/zip", len(one) + 2, len(one)) in found[2])


def test_products_that_leave_64_bits(spark):
    with pytest.raises(OverflowError):
        topk.products(np.array([[2**40, 1]]), np.array([[2**40, 1]]))
    assert topk.products(np.array([[2**40, 1]]), np.array([[2**20, 1]])).tolist() == [[2**60 + 1]]


def test_wrong_checksum_is_not_confirmed():
    raw = bytearray(png())
    raw[-20] ^= 1
    assert media.sniff(bytes(raw))[0] == media.UNKNOWN


def test_media_columns(spark):
    rows = [(1, bytearray(png()), "image/gif"), (2, bytearray(b"xx" + png() + b"yy"), media.UNKNOWN), (3, None, None), (4, bytearray(b""), None)]
    out = media.inspect(spark.createDataFrame(rows, "id long, media binary, said string"), declared="said")
    got = {r["id"]: r for r in out.collect()}
    assert got[1]["media_type"] == "image/png" and got[1]["type_corrected"] and got[3]["media_type"] is None and got[4]["media_type"] == media.UNKNOWN
    parts = media.carve(out).collect()
    assert [(r["id"], r["part_offset"], bytes(r["part"])) for r in parts] == [(2, 2, png())]


def test_packed_texts(odd, empty):
    got = media.digests(odd).collect()
    texts = defaultdict(set)
    for r in got:
        texts[r["payload_sha256"]].add(tuple(r)[1:])
    assert len(got) == odd.count() and all(len(v) <= 2 for v in texts.values()) and media.digests(empty).count() == 0
    want = {(r["doc_id"], hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(p)) for r in odd.collect() for raw in [(r["text"] or "").encode()] for p in [raw + b"\0" * (-len(raw) % 64 if raw else 64)]}
    assert {(r["doc_id"], r["payload_sha256"], r["tail_crc32"], r["payload_bytes"]) for r in got} == want


# -- shared ------------------------------------------------------------------------------------------------------------------------------


def test_other_columns_stay(spark, odd):
    """Columns with names that operators use while they work come back as they were."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(14)], "doc_id long, quality int")
    for out in (simhash.dedup(odd), simhash.dedup(odd.filter("doc_id <> 3")), quality.keep(odd, labels, threshold=0.0), line_dedup.dedup(odd, lines="before", dropped="gone"), byte_bpe.encode(odd, RANKS, P.PATTERN, spread=50)):
        rows = out.collect()
        assert rows and set(odd.columns) <= set(out.columns) and all(r[c] == f"own {c}" for r in rows for c in odd.columns[4:])


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2)], "A int, a_ int")
    assert common.fresh(df, "a", "b", "B") == ["a__", "b", "B_"]


def test_no_folder_of_its_own_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host"

        class _jsc:
            class sc:
                def getCheckpointDir(self):
                    class Option:
                        isDefined = staticmethod(lambda: False)

                    return Option

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(RuntimeError):
        common.shared_dir(Session, "x")


def test_folds(spark):
    df = spark.range(300).select("id", common.fold("id", 5).alias("f"))
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in df.collect())
