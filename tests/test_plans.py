"""Plans against DuckDB, brute force and one another."""

import random
import re
from difflib import get_close_matches
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark import oracles, queries
from quillspark.functions.text import light_stem
from quillspark.operators import conflicts, reading, retrieval, similarity, suggest
from quillspark.operators.statements import contrast, sentences, stem, terms
from quillspark.plans.querylang import parse

DATA = Path("/root/testdata/sf0.001")
LIGHT = ["search_topk", "search_tag_all", "best_sections_top2", "match_exclude", "phrase_match_k", "summary_shorten", "page_backlinks", "sync_diff", "claims_grouped", "light_stem_vocab", "exclude_globs", "duplicate_ids_first_wins", "page_heading_anchors", "resolve_suffix", "similar_pairs_dice", "search_indexed"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", LIGHT)
def test_same_rows_as_sql(spark, duck, name):
    got = [r.asDict() for r in queries.queries()[name](spark, str(DATA)).collect()]
    cursor = duck.execute(oracles.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    key = lambda r: repr(sorted(r.items()))
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_every_oracle_has_a_query():
    assert set(oracles.oracle_sql()) <= set(queries.queries())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_flagship_plan_is_one_scan(spark):
    plan = queries.search_topk(spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan and "Join" not in plan
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string,lang:string,source:string>", plan)


def test_scan_and_index_agree(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice("red green blue greenish bluebird the one two".split()) for _ in range(rnd.randint(0, 30))), rnd.choice(["red one", "blue", ""])) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc long, body string, title string")
    fields = {"title": F.col("title"), "body": F.col("body")}
    weights = {"title": 3.0, "body": 1.0}
    searches = {0: parse("green blue"), 1: parse('"green blue" red'), 2: parse("red -two one"), 3: parse('"one two"'), 4: parse('"red red" "one two the"'), 5: parse("gre blu")}
    indexed = retrieval.indexed_search(retrieval.index(docs, "doc", fields), retrieval.lengths(docs, "doc", fields), retrieval.phrase_rows(spark, searches), "doc", weights)
    by_query = {}
    for r in indexed.collect():
        by_query.setdefault(r["query_id"], {})[r["doc"]] = r["score"]
    for q, phrases in searches.items():
        want = {r["doc"]: r["score"] for r in retrieval.scan_search(docs, "doc", fields, phrases, weights).collect()}
        assert by_query.get(q, {}) == pytest.approx(want, abs=2e-6), q


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_batch_is_one_search_after_another(spark):
    """Some of the searches of search_batch_topk, each on its own over the raw texts."""
    got = {}
    for r in queries.search_batch_topk(spark, str(DATA)).collect():
        got.setdefault(r["query_id"], {})[r["doc_id"]] = r["score"]
    docs = queries.documents(spark, str(DATA))
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").limit(3).collect():
        scored = retrieval.scan_search(docs, "doc_id", {c: F.col(c) for c in queries.FIELDS}, parse(r["text"]), queries.WEIGHTS)
        want = {x["doc_id"]: x["score"] for x in retrieval.top(scored, "doc_id", 5).collect()}
        assert got.get(r["item_id"], {}) == pytest.approx(want, abs=5e-6)


def test_counting_in_texts():
    from quillspark.plans.querylang import Phrase

    count = lambda text, *tokens, prefix=False: len(re.findall(java(retrieval.pattern(Phrase(tokens, "any", prefix))), text))
    java = lambda p: p.replace(r"[\p{L}\p{N}]", r"[^\W_]").replace(r"[^\p{L}\p{N}]", r"[\W_]")
    assert count("a a_a aa a", "a") == 4 and count("a a a", "a", "a") == 2 and count("ab abc xab", "ab", prefix=True) == 2
    assert count("the, old man; the older", "the", "old") == 1 and count("the, old man; the older", "the", "old", prefix=True) == 2


def test_suggestions_are_those_of_close_matches(spark):
    rnd = random.Random(5)
    names = sorted({"".join(rnd.choices("abcdXY-/é", k=rnd.randint(1, 9))) for _ in range(150)} | {"abcd", "axbxcxd", "cats"})
    asked = sorted({"".join(rnd.choices("abcdxyé", k=rnd.randint(1, 8))) for _ in range(40)} | {"abc", "abcd", "cat", ""})
    out = suggest.suggest(spark.createDataFrame([(x,) for x in asked], "asked string"), spark.createDataFrame([(x,) for x in names], "name string"), most=1000).collect()
    got = {}
    for r in out:
        got.setdefault(r["asked"], set()).add(r["name"])
    assert all(got.get(x, set()) == set(get_close_matches(x, names, n=1000, cutoff=0.5)) for x in asked if x)
    best = suggest.suggest(spark.createDataFrame([("abc",)], "asked string"), spark.createDataFrame([(x,) for x in names], "name string"))
    assert [r["rank"] for r in best.orderBy("rank").collect()] == [1, 2, 3, 4, 5] and best.orderBy("rank").first()["name"] in get_close_matches("abc", names, n=5, cutoff=0.5)


def test_anchors_that_collide(spark):
    from quillspark.sources.markdown import Anchors

    heads = ["Setup", "Setup", "Setup-1", "Setup", "", "", "Setup-1", "A B", "a b", "a-b-1"]
    page = spark.createDataFrame([(1, "".join(f"<h2>{h}</h2>" for h in heads)), (2, "<p>none</p>"), (3, None)], "page_id long, html string")
    own = Anchors()
    assert [r["anchor"] for r in reading.html_headings(page).orderBy("ord").collect()] == [own.new(h) for h in heads]


def test_light_stems_of_both_forms(spark):
    rnd = random.Random(6)
    ends = ["", "s", "es", "ies", "ing", "ed", "e", "sses", "ches", "us", "is", "ss", "pping", "lled", "eed"]
    words = sorted({"".join(rnd.choices("abcdelpstz", k=rnd.randint(1, 5))) + rnd.choice(ends) for _ in range(3000)})
    rows = spark.createDataFrame([(" ".join(words),)], "w string").select(light_stem(F.col("w")).alias("s")).first()["s"].split(" ")
    assert rows == [stem(w) for w in words]


def test_similar_pairs_are_those_of_brute_force(spark):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(30)]
    sets = [sorted({rnd.choice(words) for _ in range(rnd.randint(1, 9))}) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(sets)), "k int, t array<string>")
    got = {frozenset((r["small"], r["large"])) for r in similarity.similar_pairs(df, "k", "t", per_salt=15).collect()}
    want = {frozenset((i, j)) for i in range(150) for j in range(i) if 2 * len(set(sets[i]) & set(sets[j])) >= 0.5 * (len(sets[i]) + len(sets[j]))}
    assert got == want


DISAGREE = [
    ("The server listens on port 8080 by default.", "The server listens on port 9090 by default.", "value"),
    ("Retries stop after 30s at most.", "Retries stop after 45s at most.", "value"),
    ("Uploads are limited to 2,500 files per day.", "Uploads are limited to 2000 files per day.", "value"),
    ("Sessions are stored in Redis for a week.", "Sessions are stored in Postgres for a week.", "value"),
    ("Caching is enabled for all requests.", "Caching is disabled for all requests.", "opposite"),
    ("Run migrations before deploying the service.", "Run migrations after deploying the service.", "opposite"),
    ("Never restart the worker by hand.", "Restart the worker by hand.", "opposite"),
    ("You can't rename a finished job.", "You can rename a finished job.", "opposite"),
    ("This flag is required for uploads.", "This flag is optional for uploads.", "opposite"),
]
AGREE = [
    ("The cache is warm in staging today.", "The cache is warm in production today."),
    ("Redis stores user sessions.", "Postgres stores user sessions."),
    ("By default, sessions expire after 30 days.", "Sessions expire after 30 days by default."),
    ("The limit is 2,500 files per day.", "The limit is 2500 files per day."),
    ("Do not delete the index.", "Never delete the index."),
    ("The worker restarts at noon.", "Logs rotate every night at ten."),
]


@pytest.mark.parametrize("a, b, kind", DISAGREE)
def test_disagreements(a, b, kind):
    assert contrast(terms(a), terms(b)).kind == kind


@pytest.mark.parametrize("a, b", AGREE)
def test_no_disagreement(a, b):
    assert contrast(terms(a), terms(b)) is None


def test_sentences_and_stems():
    assert [s for _, s in sentences("Use it, e.g. Here. Then `a. B` stops; go on. v1. then")] == ["Use it, e.g. Here.", "Then `a. B` stops;", "go on. v1. then"]
    assert [stem(w) for w in ("policies", "boxes", "status", "running", "stopped", "cached", "use", "falling")] == ["policy", "box", "status", "run", "stop", "cach", "use", "fall"]


def test_templates_are_no_conflicts(spark):
    page = lambda n: (f"page{n}", f"# P{n}\n\nLast reviewed by the docs team in release 1.{n} of the handbook.\n")
    rows = [page(n) for n in range(5)] + [("own", "# O\n\nThe small plan allows 5 seats per team.\n\nThe small plan allows 9 seats per team.\n"), ("other", "# T\n\nThe small plan allows 7 seats per team.\n")]
    assert conflicts.corpus_conflicts(spark.createDataFrame(rows, "id string, text string")).collect() == []
