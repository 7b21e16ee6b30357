"""The engine's operators as queries over the driver's tables, and their SQL.

A document is (doc_id; title: the first line; tags: language and source; body: the other lines); its sections are its lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import reading, retrieval, similarity, sync
from .operators.statements import FUNCTION_WORDS
from .plans.querylang import Phrase, parse

#: Searches of the corpus's own words.
SEARCH = "hean reth tion blend"
PHRASES = parse(SEARCH)
WEIGHTS = {"title": 3.0, "tags": 1.5, "body": 1.0}
#: Words without a claim of their own that are one token.
CLAIM_STOP_WORDS = tuple(sorted(w for w in FUNCTION_WORDS if w.isalnum()))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    at = F.instr("text", "\n")
    return docs.select(
        "doc_id", "lang", "source", "text", F.when(at > 0, F.substring_index("text", "\n", 1)).otherwise(F.col("text")).alias("title"),
        F.when(at > 0, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise("").alias("body"), F.concat_ws(" ", "lang", "source").alias("tags"),
    )


FIELDS = ("title", "tags", "body")


def _fields() -> dict:
    return {c: F.col(c) for c in FIELDS}


def _tagged(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(F.array_distinct(F.array("lang", "source"))).alias("tag")).filter("tag is not null")


# -- analysis ---------------------------------------------------------------------------------------------------------------


def tokenize_postings(s, d):
    return retrieval.postings(load(s, d, "documents"), "doc_id", {"text": F.col("text")}).select("doc_id", "pos", "term")


def word_counts(s, d):
    docs = load(s, d, "documents").select(F.lit("documents").alias("kind"), F.col("doc_id").alias("id"), X.word_count(F.col("text")).alias("words"))
    talks = load(s, d, "conversations").groupBy("conv_id").agg(F.sum(X.word_count(F.col("text"))).alias("words"))
    return docs.unionByName(talks.select(F.lit("conversations").alias("kind"), F.col("conv_id").alias("id"), "words"))


def vocab_doc_freq_idf(s, d):
    docs = load(s, d, "documents")
    total = docs.count()
    terms = docs.select("doc_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", "df", F.round(retrieval.smooth_idf(F.lit(float(total)), F.col("df").cast("double")), 6).alias("idf"))


def light_stem_vocab(s, d):
    terms = load(s, d, "documents").select(F.explode(X.tokens(F.col("text"))).alias("term")).distinct()
    return terms.select("term", X.light_stem(F.col("term")).alias("stem"))


def porter_stem_vocab(s, d):
    from .functions.porter import stemmed_vocabulary

    return stemmed_vocabulary(load(s, d, "documents").select(F.explode(X.tokens(F.col("text"))).alias("term")).distinct())


# -- matching and ranking -----------------------------------------------------------------------------------------------------


def _matching(s, d, phrases):
    counts = retrieval.scan_counts(load(s, d, "documents"), ["doc_id"], {"text": F.col("text")}, phrases)
    return counts.filter("ok").select("doc_id", *[F.col("f")[i][0].alias(f"f{i}") for i in range(len(phrases))])


MATCHES = {
    "match_any": [Phrase(("hean",), "any"), Phrase(("reth",), "any"), Phrase(("blend",), "any")],
    "match_all": [Phrase(("hean",), "all"), Phrase(("tion",), "all")],
    "match_exclude": [Phrase(("hean",), "any"), Phrase(("tion",), "none")],
    "prefix_match": [Phrase(("hean",), "any", prefix=True)],
    "phrase_match_2": [Phrase(("and", "the"), "all")],
    "phrase_match_k": [Phrase(("the", "of", "and"), "any"), Phrase(("is", "the", "is"), "any"), Phrase(("of", "la"), "none")],
}


def _bm25(phrases, fields):
    def run(s, d):
        docs = documents(s, d)
        return retrieval.scan_search(docs, "doc_id", {c: F.col(c) for c in fields}, phrases, {**WEIGHTS, "text": 1.0})

    return run


def search_topk(s, d):
    """The flagship: a search over title, tags and body, the best ten."""
    scored = retrieval.scan_search(documents(s, d), "doc_id", _fields(), PHRASES, WEIGHTS)
    return retrieval.top(scored, "doc_id", 10)


def search_tag_all(s, d):
    docs = documents(s, d)
    allowed = retrieval.with_all_tags(_tagged(docs), "doc_id", ["en", "src1"]).withColumn("ok", F.lit(True))
    scored = retrieval.scan_search(docs.join(allowed, "doc_id", "left"), "doc_id", _fields(), PHRASES, WEIGHTS, allowed=F.coalesce("ok", F.lit(False)))
    return retrieval.top(scored, "doc_id", 10)


def search_indexed(s, d):
    """The flagship search over postings: the same scores by the other plan."""
    docs = documents(s, d)
    phrases = retrieval.phrase_rows(s, {0: PHRASES})
    # read by several joins: texts are cut into words once
    post, length = retrieval.index(docs, "doc_id", _fields(), PHRASES).persist(), retrieval.lengths(docs, "doc_id", _fields()).persist()
    scored = retrieval.indexed_search(post, length, phrases, "doc_id", WEIGHTS)
    return retrieval.top(scored.select("doc_id", "score"), "doc_id", 10)


def search_batch_topk(s, d):
    """Each benchmark text as a search; the best five documents of each."""
    from .plans.batch import best_each, parsed

    phrases = parsed(load(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"))
    return best_each(documents(s, d), "doc_id", _fields(), phrases, WEIGHTS, 5)


def _sections(s, d):
    rows = reading.line_sections(load(s, d, "documents"), "doc_id", "text")
    return rows.withColumn("sec", F.struct("doc_id", "ord"))


SECTION_FIELDS = {"heading": 2.0, "body": 1.0}


def best_sections_top2(s, d):
    """Of each of the flagship's documents the two best lines."""
    best = search_topk(s, d).select("doc_id")
    rows = _sections(s, d).join(best.withColumn("ok", F.lit(True)), "doc_id", "left")
    loose = [Phrase(p.tokens, "any", p.prefix) for p in PHRASES if p.scores]
    scored = retrieval.scan_search(rows, "sec", {c: F.col(c) for c in SECTION_FIELDS}, loose, SECTION_FIELDS, allowed=F.coalesce("ok", F.lit(False)))
    flat = scored.select(F.col("sec.doc_id").alias("doc_id"), F.col("sec.ord").alias("ord"), "score")
    return retrieval.top_each(flat, "doc_id", "ord", retrieval.SECTIONS_EACH)


def snippet_top_hits(s, d):
    from .operators.snippets import snippets

    rows = best_sections_top2(s, d).join(_sections(s, d).select("doc_id", "ord", "body"), ["doc_id", "ord"])
    return snippets(rows, "body", [p for p in PHRASES if p.scores]).select("doc_id", "ord", "rank", "snippet")


# -- reading -----------------------------------------------------------------------------------------------------------------


def list_docs_sorted(s, d):
    docs = documents(s, d)
    return docs.select("doc_id", F.trim(F.regexp_replace("title", r"\s+", " ")).alias("title"), F.array_join(F.array_sort(F.array("lang", "source")), ",").alias("tag_list"), X.word_count(F.col("text")).alias("words")).orderBy("doc_id")


def list_docs_tagged(s, d):
    docs = documents(s, d)
    return docs.join(retrieval.with_all_tags(_tagged(docs), "doc_id", ["en", "src1"]), "doc_id", "left_semi").select("doc_id", "lang", "source").orderBy("doc_id")


def tag_counts(s, d):
    return reading.tag_counts(_tagged(load(s, d, "documents")))


def summary_shorten(s, d):
    return load(s, d, "documents").select("doc_id", X.shorten(F.col("text")).alias("summary"))


def slugify_first_line(s, d):
    return documents(s, d).select("doc_id", X.slug(F.col("title")).alias("anchor"))


def page_headings_outline(s, d):
    return reading.html_headings(load(s, d, "pages")).select("page_id", "ord", "level", "heading")


def page_heading_anchors(s, d):
    return reading.html_headings(load(s, d, "pages")).select("page_id", "ord", "anchor")


def page_links(s, d):
    return reading.html_links(load(s, d, "pages"))


def _graph(s, d):
    pages = load(s, d, "pages")
    nodes = pages.select(F.col("page_id").alias("key"), F.col("url").alias("id"), reading.url_path(F.col("url")).alias("path"))
    return reading.html_links(pages).select(F.col("page_id").alias("source"), "target"), nodes


def page_backlinks(s, d):
    return reading.backlink_counts(*_graph(s, d))


def page_broken_links(s, d):
    edges, nodes = _graph(s, d)
    known = nodes.select(F.explode(F.array("id", "path")).alias("target")).distinct()
    return edges.filter("target <> ''").join(known, "target", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("n_broken"))


def resolve_suffix(s, d):
    pages = load(s, d, "pages")
    nodes = pages.select(F.col("page_id").alias("key"), F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(.*)$", 1).alias("id"), F.col("url").alias("path"))
    refs = pages.select(F.upper(F.regexp_extract("url", r"([^/]*)$", 1)).alias("ref")).unionByName(pages.select(F.col("url").alias("ref"))).distinct()
    return reading.resolve(refs, nodes)


def fuzzy_suggest(s, d):
    from .operators.suggest import suggest

    parts = load(s, d, "part").select(F.col("p_name").alias("name")).distinct()
    asked = parts.select(F.concat(F.substring("name", 2, 6), F.lit("x")).alias("asked")).distinct()
    return suggest(asked, parts)


#: Forms that each page's file has besides its own text: a list, a quotation, a table, code whose lines look like headings, a comment, emphasis and code spans.
FORMS = """
- one *item*
- another, with `code` and [no link][x]

> A **quotation** of it.

| name | value |
|------|-------|
| port | 8080  |

```sh
# not a heading
[no](link.md)
```

<!-- # not a heading either -->
"""


def _markdown(s, d):
    """Pages as Markdown files: front matter, a heading, the page's headings as sections, each with the page's whole text, and its links."""
    pages = load(s, d, "pages")
    heads = reading.html_headings(pages).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", "level", "heading"))).alias("h"))
    links = reading.html_links(pages).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", "target", "anchor"))).alias("l"))
    # tags and signs of Markdown off; one line, begun by a word, so that it is a paragraph
    said = F.concat(F.lit("Text: "), F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?s)<[^>]*>", " "), r"[\s<>`\[\]!|]+", " ")), F.lit("\n"))
    head = F.transform(F.coalesce("h", F.array().cast("array<struct<ord:int,level:int,heading:string>>")), lambda x: F.concat(F.repeat(F.lit("#"), x["level"] + 1), F.lit(" "), x["heading"], F.lit("\n\n"), F.col("said")))
    link = F.transform(F.coalesce("l", F.array().cast("array<struct<ord:int,target:string,anchor:string>>")), lambda x: F.concat(F.lit("- [x]("), x["target"], F.lit(")\n")))
    text = F.concat(F.lit("---\ntitle: Page "), "page_id", F.lit("\ntags: [page, odd]\n---\n# Page\n\n"), F.col("said"), F.lit(FORMS), F.array_join(head, "\n"), F.lit("\n"), F.array_join(link, ""))
    rows = pages.withColumn("said", said).join(heads, "page_id", "left").join(links, "page_id", "left")
    content = text.cast("binary")
    return rows.select(F.col("page_id").alias("doc_seq"), F.concat(F.lit("p/"), "page_id").alias("id"), F.concat(F.lit("p/"), "page_id", F.lit(".md")).alias("rel"), content.alias("content"), F.sha2(content, 256).alias("hash"), F.lit(0).cast("long").alias("mtime_ns"), F.length(content).cast("long").alias("size"))


def _parsed(s, d):
    from .sources.files import parse_files

    return parse_files(_markdown(s, d))


def markdown_documents(s, d):
    return _parsed(s, d).select(F.col("doc_seq").alias("page_id"), "title", F.array_join("tags", ",").alias("tag_list"), F.size("sections").cast("long").alias("n_sections"), "has_title", "has_summary", F.size("warnings").cast("long").alias("n_warnings"))


def markdown_sections(s, d):
    rows = _parsed(s, d).select(F.col("doc_seq").alias("page_id"), F.explode("sections").alias("s"))
    return rows.select("page_id", "s.ord", "s.level", "s.heading", "s.anchor", "s.start_line", "s.subtree_end")


def markdown_links(s, d):
    return _parsed(s, d).select(F.col("doc_seq").alias("page_id"), F.explode("links").alias("l")).groupBy("page_id", "l.kind").agg(F.count(F.lit(1)).alias("n"))


# -- maintenance and lint ----------------------------------------------------------------------------------------------------


def _snapshots(s, d):
    docs = load(s, d, "documents")
    path = F.concat(F.lit("docs/"), F.col("doc_id"), F.lit(".md"))
    old = docs.filter("doc_id % 7 <> 0").select(path.alias("path"), F.col("doc_id").cast("string").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    new = docs.filter("doc_id % 11 <> 0").select(
        path.alias("path"), F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("v2-"), F.col("doc_id"))).otherwise(F.col("doc_id").cast("string")).alias("id"),
        F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary"), 256).alias("hash"),
    )
    return new, old


def sync_diff(s, d):
    return sync.changes(*_snapshots(s, d))


def sync_merge(s, d):
    """The second snapshot made from the first one and the changed rows only."""
    new, old = _snapshots(s, d)
    change = sync.changes(new, old)
    fresh = new.join(change.filter("change in ('added', 'updated')").select("path", "id"), ["path", "id"], "left_semi")
    gone = change.filter("change = 'removed'").select("path")
    return sync.merged(old, fresh, gone, "path")


def duplicate_ids_first_wins(s, d):
    docs = load(s, d, "documents")
    found = docs.select(F.concat("source", F.lit("/"), "doc_id").alias("path"), F.pmod(F.col("doc_id"), F.lit(97)).cast("string").alias("id"), F.col("doc_id").alias("seq"))
    return sync.owners(found).filter("path <> kept").select("id", "kept", F.col("path").alias("skipped"))


def lint_docs(s, d):
    from .operators.lint import text_issues

    return text_issues(documents(s, d), "doc_id")


def exclude_globs(s, d):
    paths = load(s, d, "pages").select("page_id", reading.url_path(F.col("url")).alias("p")).withColumn("path", F.expr("ltrim('/', p)"))
    rules = [X.glob_regex(p) for p in ("**/*[0-4].html", "*/1*", "page?")]
    hit = F.lit(False)
    for r in rules:
        hit = hit | F.regexp_like("path", F.lit(r))
    return paths.select("page_id", "path", hit.alias("excluded"))


# -- statements --------------------------------------------------------------------------------------------------------------


def sentence_split(s, d):
    return load(s, d, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("n", "sentence"))


def _claims(s, d):
    """(doc_id, claim): statements as their stemmed words without function words; of 3 to 60."""
    docs = load(s, d, "documents").select("doc_id", F.col("text"))
    talks = load(s, d, "conversations").select((-F.col("conv_id") - 1).alias("doc_id"), "text")
    rows = docs.unionByName(talks).select("doc_id", F.explode(X.sentences(F.col("text"))).alias("sentence"))
    words = F.filter(X.tokens(F.col("sentence")), lambda w: ~w.isin(*CLAIM_STOP_WORDS))
    rows = rows.select("doc_id", words.alias("words")).filter(F.size("words").between(3, 60))
    rows = rows.select("doc_id", X.light_stem(F.array_join("words", " ")).alias("claim"))
    return rows.select("doc_id", F.split("claim", " ").alias("terms"), "claim")


def claims_grouped(s, d):
    return similarity.grouped_claims(_claims(s, d), "doc_id", "claim")


def similar_pairs_dice(s, d):
    claims = _claims(s, d).groupBy("claim").agg(F.first("terms").alias("terms"))
    return similarity.similar_pairs(claims, "claim", "terms")


def conflicts(s, d):
    from .operators.conflicts import corpus_conflicts

    docs = load(s, d, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("id"), "text")
    talks = load(s, d, "conversations").select(F.concat_ws("-", F.lit("talk"), "conv_id", "turn").alias("id"), "text")
    return corpus_conflicts(docs.unionByName(talks))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {f.__name__: f for f in (
        tokenize_postings, word_counts, vocab_doc_freq_idf, light_stem_vocab, porter_stem_vocab, search_topk, search_tag_all, search_indexed, search_batch_topk,
        best_sections_top2, snippet_top_hits, list_docs_sorted, list_docs_tagged, tag_counts, summary_shorten, slugify_first_line, page_headings_outline, page_heading_anchors, page_links,
        page_backlinks, page_broken_links, resolve_suffix, fuzzy_suggest, sync_diff, sync_merge, duplicate_ids_first_wins, lint_docs, exclude_globs, sentence_split, claims_grouped,
        similar_pairs_dice, conflicts, markdown_documents, markdown_sections, markdown_links,
    )}
    out |= {name: (lambda s, d, p=p: _matching(s, d, p)) for name, p in MATCHES.items()}
    out |= {"bm25_single_term": _bm25([Phrase(("hean",), "any")], ["text"]), "bm25_multi_term": _bm25(PHRASES, ["text"]), "bm25f_fields": _bm25(PHRASES, FIELDS)}
    return out
