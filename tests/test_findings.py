"""Odd and large inputs that a review of the queries named."""

import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark import oracles, queries
from quillspark.operators import retrieval
from quillspark.plans import batch
from quillspark.plans.querylang import Phrase, parse
from quillspark.sources import files

ODD = [
    "One two. " * 30 + "Seen at. 29.169.77.221 and so. 4598802047788384 was. 16.195.23.156",
    "Say so; ; then ;) 5 more;   wide spaces here.  Then this one.　", "Cut\x0b here now. \x0bNot there. \x02Mark. \x01Other one ends here.",
    "Compare e.g. This one, vſ. That one, vs. Others (cf. Then). İstanbul ΑΣ ΟΔΟΣ kept names.", "", None, " ; ", "ΑΣ ΟΔΟΣ İstanbul names. Kept 'so'.) \"And so\" on; etc. Etc. on it goes.",
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables of odd texts: their folder, and a DuckDB connection with them."""
    at = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, 0, "user", ODD[0]), (1, 0, "user", ODD[3])], "conv_id long, turn int, role string, text string").write.parquet(f"{at}/conversations.parquet")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet/*.parquet'")
    return str(at), con


@pytest.mark.parametrize("name", ["sentence_split", "claims_grouped", "similar_pairs_dice"])
def test_odd_texts_as_in_sql(spark, odd, name):
    got = queries.queries()[name](spark, odd[0])
    want = odd[1].execute(f"SELECT {', '.join(got.columns)} FROM ({oracles.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 0


def test_searches_use_whole_texts():
    words = [f"w{n}x" for n in range(40)]
    got = parse(" ".join(words))
    assert {p.tokens for p in got} == {(w,) for w in words} | set(zip(words, words[1:], strict=False))


def test_batch_of_searches_in_two_scans(spark):
    """All roles, ties and repeated rows, each search as on its own over the raw texts; nothing of the corpus is dealt out."""
    rnd = random.Random(11)
    words = "red green blue greenish bluebird one two İx ΑΣ".split()
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 25))), rnd.choice(["red one", "blue", "", None])) for i in range(90)]
    rows += [(i, rows[5][1], rows[5][2]) for i in range(90, 700)]
    docs = spark.createDataFrame(rows, "doc long, body string, title string")
    fields, weights = {"title": F.col("title"), "body": F.col("body")}, {"title": 3.0, "body": 1.0}
    texts = ["green blue", '"green blue" red', "red -two one", '"one two"', '"red red" "one two red"', "gre blu", "ΑΣ İx", "nowhere"]
    searches = {n: parse(t) for n, t in enumerate(texts)} | {9: [Phrase(("red", "gre"), "any", True)]}
    frame = batch.best_each(docs, "doc", fields, retrieval.phrase_rows(spark, searches), weights, 5)
    assert "hashpartitioning(term" not in frame._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in frame.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc"], r["score"]))
    for q, phrases in searches.items():
        want = retrieval.top(retrieval.scan_search(docs, "doc", fields, phrases, weights), "doc", 5).collect()
        assert [x[1] for x in sorted(got.get(q, []))] == [r["doc"] for r in want], q
        assert [x[2] for x in sorted(got.get(q, []))] == pytest.approx([r["score"] for r in want], abs=2e-6), q


def test_index_of_what_is_asked(spark):
    """Postings of other terms aren't grouped; the scores are those of the whole index."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["green blue tree", "greenish tree stone", "blue stone", "stone"])], "doc long, body string")
    fields, phrases = {"body": F.col("body")}, parse("green blue")
    few, all_ = (retrieval.index(docs, "doc", fields, p) for p in (phrases, None))
    assert {r["term"] for r in few.collect()} == {"green", "blue", "greenish"}
    scores = [sorted(map(tuple, retrieval.indexed_search(post, retrieval.lengths(docs, "doc", fields), retrieval.phrase_rows(spark, {0: phrases}), "doc", {"body": 1.0}).collect())) for post in (few, all_)]
    assert scores[0] == scores[1] and len(scores[0]) == 3


def test_pages_are_parsed_in_bounded_parts():
    for sizes in ([10] * 1000, [files.PARSE_BYTES + 1, 0, 5, files.PARSE_BYTES, 7], [], [None, 3]):
        rows = pa.RecordBatch.from_arrays([pa.array(range(len(sizes)), pa.int64()), pa.array([None if n is None else b"x" * n for n in sizes], pa.binary())], names=["n", "content"])
        parts = list(files.bounded(rows, rows.column(1)))
        assert [n for p in parts for n in p.column(0).to_pylist()] == list(range(len(sizes)))
        assert all(p.num_rows <= files.PARSE_ROWS and (p.num_rows == 1 or sum(len(x or b"") for x in p.column(1).to_pylist()) <= files.PARSE_BYTES) for p in parts)
