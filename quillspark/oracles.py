"""DuckDB SQL for the queries over the driver's tables, written from the definitions rather than from the plans."""

from __future__ import annotations

from collections.abc import Sequence

from .plans.querylang import Phrase
from .queries import CLAIM_STOP_WORDS, MATCHES, PHRASES, SECTION_FIELDS, WEIGHTS

T = r"list_transform(regexp_extract_all(coalesce({c}, ''), '[\p{{L}}\p{{N}}]+'), lambda x: lower(x))"
DOCS = "docs AS (SELECT doc_id, lang, source, text, split_part(text, chr(10), 1) AS title, CASE WHEN contains(text, chr(10)) THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS body, concat_ws(' ', lang, source) AS tags FROM documents)"


def _toks(c: str) -> str:
    return T.format(c=c)


def _f(tokens: str, p: Phrase) -> str:
    last = len(p.tokens) - 1
    tests = [(f"starts_with({tokens}[i + {k}], '{w}')" if p.prefix and k == last else f"{tokens}[i + {k}] = '{w}'") for k, w in enumerate(p.tokens)]
    return f"len(list_filter(range(1, len({tokens}) + 1), lambda i: {' AND '.join(f'coalesce({t}, false)' for t in tests)}))"


def _fits(phrases: Sequence[Phrase], hit) -> str:
    any_ = [hit(i) for i, p in enumerate(phrases) if p.role == "any"]
    parts = [f"({' OR '.join(any_)})"] if any_ else []
    parts += [hit(i) for i, p in enumerate(phrases) if p.role == "all"] + [f"NOT {hit(i)}" for i, p in enumerate(phrases) if p.role == "none"]
    return " AND ".join(parts)


def match_sql(phrases: Sequence[Phrase]) -> str:
    counts = ", ".join(f"CAST({_f('t', p)} AS BIGINT) AS f{i}" for i, p in enumerate(phrases))
    return f"WITH k AS (SELECT doc_id, {_toks('text')} AS t FROM documents), c AS (SELECT doc_id, {counts} FROM k) SELECT * FROM c WHERE {_fits(phrases, lambda i: f'(f{i} > 0)')}"


def ranked_sql(rows: str, key: str, fields: Sequence[str], phrases: Sequence[Phrase], weights: dict, where: str = "true", ctes: str = DOCS) -> str:
    """CTEs up to r (key, score)."""
    toks = ", ".join(f"{_toks(c)} AS t_{c}" for c in fields)
    counts = ", ".join(f"{_f(f't_{c}', p)} AS f{i}_{c}" for i, p in enumerate(phrases) for c in fields)
    hit = lambda i: "(" + " + ".join(f"f{i}_{c}" for c in fields) + " > 0)"
    stats = ", ".join(f"CAST(sum(CASE WHEN {hit(i)} THEN 1 ELSE 0 END) AS DOUBLE) AS n{i}" for i in range(len(phrases)))
    terms = []
    for i, p in enumerate(phrases):
        if p.scores:
            tf = " + ".join(f"{weights[c]} * f{i}_{c} * 2.2 / (f{i}_{c} + 1.2 * (0.25 + 0.75 * d / mean))" for c in fields)
            terms.append(f"ln(1 + (total - n{i} + 0.5) / (n{i} + 0.5)) * ({tf})")
    return (
        f"{ctes}, tk AS (SELECT {key}, ok, {toks} FROM (SELECT *, {where} AS ok FROM {rows})), ct AS (SELECT {key}, ok, {' + '.join(f'len(t_{c})' for c in fields)} AS d, {counts} FROM tk),"
        f" st AS (SELECT CAST(count(*) AS DOUBLE) AS total, avg(d) AS mean, {stats} FROM ct), r AS (SELECT {key}, round({' + '.join(terms)}, 6) AS score FROM ct, st WHERE ok AND {_fits(phrases, hit)})"
    )


STEM = """
s1 AS (SELECT *, CASE WHEN length(w) <= 3 THEN w
        WHEN right(w, 3) = 'ies' AND length(w) > 4 THEN left(w, length(w) - 3) || 'y'
        WHEN right(w, 4) IN ('sses', 'ches', 'shes') OR right(w, 3) IN ('xes', 'zes') THEN left(w, length(w) - 2)
        WHEN right(w, 1) = 's' AND right(w, 2) NOT IN ('ss', 'us', 'is') THEN left(w, length(w) - 1) ELSE w END AS a FROM s0),
s2 AS (SELECT *, CASE WHEN length(w) > 3 AND right(a, 3) = 'ing' AND length(a) >= 5 THEN left(a, length(a) - 3) WHEN length(w) > 3 AND right(a, 2) = 'ed' AND length(a) >= 4 THEN left(a, length(a) - 2) ELSE a END AS b FROM s1),
s3 AS (SELECT *, CASE WHEN a <> b AND length(b) > 3 AND right(b, 1) = substr(b, length(b) - 1, 1) AND right(b, 1) NOT IN ('l', 's', 'z') THEN left(b, length(b) - 1) ELSE b END AS c FROM s2),
s4 AS (SELECT *, CASE WHEN length(w) > 3 AND right(c, 1) = 'e' AND length(c) > 2 THEN left(c, length(c) - 1) ELSE c END AS stem FROM s3)"""

_CLOSE = r"""["'')\]*_]*"""
_OPEN = r"""[\p{Lu}\p{Nd}`"''(\[*_]"""


def sentences_sql(text: str) -> str:
    """A list of sentences. Full stops of abbreviations are set aside first; there is no looking ahead in this dialect."""
    aside = rf"regexp_replace({text}, '(^|[^\p{{L}}\p{{M}}\p{{N}}_.])((?i:e\.g|i\.e|etc|vs|cf|eg|ie))\.', '\1\2' || chr(2), 'g')"
    ends = rf"regexp_replace({aside}, '([.!?]){_CLOSE}\s+({_OPEN})', '\1' || chr(1) || '\2', 'g')"
    semi = rf"regexp_replace({ends}, '(;){_CLOSE}\s+(\S)', '\1' || chr(1) || '\2', 'g')"
    return f"list_filter(list_transform(string_split(replace({semi}, chr(2), '.'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


_HEADS = r"""h AS (SELECT page_id, unnest(a) AS raw, unnest(range(len(a))) AS ord FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h') AS a FROM pages)),
g AS (SELECT page_id, CAST(ord AS INTEGER) AS ord, CAST(regexp_extract(raw, '(?i)<h([1-6])', 1) AS INTEGER) AS level, trim(regexp_replace(regexp_replace(raw, '(?s)<[^>]*>|</h$', '', 'g'), '\s+', ' ', 'g')) AS heading FROM h)"""
_SLUG = r"replace(regexp_replace(lower(trim({c})), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}\p{{Pd}} ]', '', 'g'), ' ', '-')"
_LINKS = r"""l0 AS (SELECT page_id, unnest(a) AS href, unnest(range(len(a))) AS ord FROM (SELECT page_id, regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1) AS a FROM pages)),
l1 AS (SELECT page_id, CAST(ord AS INTEGER) AS ord, split_part(split_part(href, '#', 1), '?', 1) AS target, CASE WHEN contains(href, '#') THEN substr(href, instr(href, '#') + 1) ELSE '' END AS anchor
       FROM l0 WHERE NOT regexp_matches(href, '^([A-Za-z][A-Za-z0-9+.-]*:|//)')),
l AS (SELECT * FROM l1 WHERE target <> '' OR anchor <> '')"""
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(/[^?#]*)', 1)"
_TAGGED = "SELECT DISTINCT doc_id, unnest([lang, source]) AS tag FROM documents"
_BOTH_TAGS = f"doc_id IN (SELECT doc_id FROM ({_TAGGED}) WHERE tag IN ('en', 'src1') GROUP BY doc_id HAVING count(*) = 2)"
_NEW = "new AS (SELECT 'docs/' || doc_id || '.md' AS path, CASE WHEN doc_id % 13 = 0 THEN 'v2-' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 11 <> 0)"
_OLD = "old AS (SELECT 'docs/' || doc_id || '.md' AS path, CAST(doc_id AS VARCHAR) AS id, sha256(text) AS hash FROM documents WHERE doc_id % 7 <> 0)"


def oracle_sql() -> dict[str, str]:
    fields = ("title", "tags", "body")
    words = lambda c: rf"CAST(len(regexp_extract_all(coalesce({c}, ''), '[\p{{L}}\p{{N}}]+')) AS BIGINT)"
    loose = [Phrase(p.tokens, "any", p.prefix) for p in PHRASES if p.scores]
    flagship = ranked_sql("docs", "doc_id", fields, PHRASES, WEIGHTS)
    top = "SELECT * FROM r ORDER BY score DESC, doc_id LIMIT 10"
    flat = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
    sections = "sx AS (SELECT doc_id, CAST(i AS INTEGER) AS ord, regexp_extract(x, '(\\S+)', 1) AS heading, x AS body FROM (SELECT doc_id, unnest(a) AS x, unnest(range(len(a))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)) WHERE trim(x) <> '')"
    quoted = ", ".join(f"'{w}'" for w in CLAIM_STOP_WORDS)
    claims = (
        f"u AS (SELECT doc_id, unnest({sentences_sql('text')}) AS sentence FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -conv_id - 1, text FROM conversations)),"
        f" v AS (SELECT row_number() OVER () AS r, doc_id, list_filter({_toks('sentence')}, lambda x: x NOT IN ({quoted})) AS a FROM u), x AS (SELECT * FROM v WHERE len(a) BETWEEN 3 AND 60),"
        f" o AS (SELECT r, doc_id, unnest(a) AS w, unnest(range(len(a))) AS i FROM x), s0 AS (SELECT DISTINCT w FROM o), {STEM},"
        " c AS (SELECT r, doc_id, string_agg(stem, ' ' ORDER BY i) AS claim FROM o JOIN s4 USING (w) GROUP BY r, doc_id)"
    )
    return {
        "markdown_documents": f"WITH {_HEADS}, n AS (SELECT page_id, count(*) AS n FROM g GROUP BY page_id) SELECT p.page_id, 'Page ' || p.page_id AS title, 'page,odd' AS tag_list, 1 + coalesce(n, 0) AS n_sections, true AS has_title, false AS has_summary, CAST(0 AS BIGINT) AS n_warnings FROM pages p LEFT JOIN n USING (page_id)",
        "tokenize_postings": f"SELECT doc_id, CAST(unnest(range(len(t))) AS INTEGER) AS pos, unnest(t) AS term FROM (SELECT doc_id, {_toks('text')} AS t FROM documents)",
        "word_counts": f"SELECT 'documents' AS kind, doc_id AS id, {words('text')} AS words FROM documents UNION ALL SELECT 'conversations', conv_id, CAST(sum({words('text')}) AS BIGINT) FROM conversations GROUP BY conv_id",
        "vocab_doc_freq_idf": f"WITH t AS (SELECT DISTINCT doc_id, unnest({_toks('text')}) AS term FROM documents), n AS (SELECT count(*) AS total FROM documents) SELECT term, count(*) AS df, round(ln(1 + (any_value(total) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM t, n GROUP BY term",
        "light_stem_vocab": f"WITH s0 AS (SELECT DISTINCT unnest({_toks('text')}) AS w FROM documents), {STEM} SELECT w AS term, stem FROM s4",
        **{name: match_sql(p) for name, p in MATCHES.items()},
        "bm25_single_term": f"WITH {ranked_sql('docs', 'doc_id', ['text'], [Phrase(('hean',), 'any')], {'text': 1.0})} SELECT * FROM r",
        "bm25_multi_term": f"WITH {ranked_sql('docs', 'doc_id', ['text'], PHRASES, {'text': 1.0})} SELECT * FROM r",
        "bm25f_fields": f"WITH {flagship} SELECT * FROM r",
        "search_topk": f"WITH {flagship} {top}",
        "search_indexed": f"WITH {flagship} {top}",
        "search_tag_all": f"WITH {ranked_sql('docs', 'doc_id', fields, PHRASES, WEIGHTS, _BOTH_TAGS)} {top}",
        "best_sections_top2": (
            f"WITH best AS (WITH {flagship} {top}), {ranked_sql('sx', 'doc_id, ord', tuple(SECTION_FIELDS), loose, SECTION_FIELDS, 'doc_id IN (SELECT doc_id FROM best)', sections)},"
            " k AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS INTEGER) AS rank FROM r) SELECT * FROM k WHERE rank <= 2"
        ),
        "list_docs_sorted": f"WITH {DOCS} SELECT doc_id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, array_to_string(list_sort([lang, source]), ',') AS tag_list, {words('text')} AS words FROM docs",
        "list_docs_tagged": f"SELECT doc_id, lang, source FROM documents WHERE {_BOTH_TAGS}",
        "tag_counts": f"SELECT tag, count(*) AS n FROM ({_TAGGED}) WHERE tag IS NOT NULL GROUP BY tag",
        "summary_shorten": (
            f"WITH f AS (SELECT doc_id, {flat} AS t FROM documents), h AS (SELECT *, substr(t, 1, 220) AS c FROM f), e AS (SELECT *, regexp_extract(c, '(?s)^(.*[.!?])\\s', 1) AS s FROM h)"
            " SELECT doc_id, CASE WHEN length(t) <= 220 THEN t WHEN length(s) >= 73 THEN s ELSE regexp_replace(CASE WHEN contains(c, ' ') THEN regexp_extract(c, '(?s)^(.*) ', 1) ELSE c END, '[,;:-]+$', '') || '…' END AS summary FROM e"
        ),
        "slugify_first_line": f"WITH {DOCS} SELECT doc_id, {_SLUG.format(c='title')} AS anchor FROM docs",
        "page_headings_outline": f"WITH {_HEADS} SELECT page_id, ord, level, heading FROM g",
        # headings in order; each takes the first name of its own that none before it has
        "page_heading_anchors": (
            f"WITH RECURSIVE {_HEADS}, b AS (SELECT page_id, ord, coalesce(nullif({_SLUG.format(c='heading')}, ''), 'section') AS s FROM g),"
            " r AS (SELECT page_id, ord, s AS anchor, [s] AS taken FROM b WHERE ord = 0 UNION ALL"
            " SELECT page_id, ord, anchor, list_append(taken, anchor) FROM (SELECT b.page_id, b.ord, r.taken,"
            " list_filter(list_transform(range(0, len(r.taken) + 1), lambda k: CASE WHEN k = 0 THEN b.s ELSE b.s || '-' || k END), lambda x: NOT list_contains(r.taken, x))[1] AS anchor"
            " FROM r JOIN b ON b.page_id = r.page_id AND b.ord = r.ord + 1)) SELECT page_id, ord, anchor FROM r"
        ),
        "page_links": f"WITH {_LINKS} SELECT page_id, ord, target, anchor FROM l",
        "page_backlinks": f"WITH {_LINKS}, p AS (SELECT page_id, url, {_PATH} AS path FROM pages), e AS (SELECT DISTINCT l.page_id AS source, p.page_id AS key FROM l JOIN p ON (l.target = p.url OR l.target = p.path) AND l.page_id <> p.page_id) SELECT p.page_id AS key, count(e.source) AS n_in FROM p LEFT JOIN e ON e.key = p.page_id GROUP BY p.page_id",
        "page_broken_links": f"WITH {_LINKS} SELECT page_id AS source, count(*) AS n_broken FROM l WHERE target <> '' AND target NOT IN (SELECT url FROM pages) AND target NOT IN (SELECT {_PATH} FROM pages) GROUP BY page_id",
        "resolve_suffix": (
            r"WITH n AS (SELECT page_id AS key, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(.*)$', 1) AS id, url AS path FROM pages),"
            r" q AS (SELECT DISTINCT ref FROM (SELECT upper(regexp_extract(url, '([^/]*)$', 1)) AS ref FROM pages UNION ALL SELECT url FROM pages)),"
            r" c AS (SELECT ref, regexp_replace(replace(trim(ref), '\', '/'), '^(\./|/)+', '') AS r FROM q), l AS (SELECT *, lower(regexp_replace(r, '(?i)\.(md|markdown|mdx|html)$', '')) AS loose FROM c),"
            r" m AS (SELECT *, lower(regexp_replace(id, '(?i)\.(md|markdown|mdx|html)$', '')) AS lid, lower(regexp_replace(path, '(?i)\.(md|markdown|mdx|html)$', '')) AS lpath FROM n),"
            " f AS (SELECT ref, key, CASE WHEN r = id OR r = path THEN 1 WHEN loose = lid OR loose = lpath THEN 2 WHEN ends_with(lid, '/' || loose) THEN 3 END AS stage FROM l, m WHERE r IN (id, path) OR loose IN (lid, lpath) OR ends_with(lid, '/' || loose)),"
            " s AS (SELECT ref, min(stage) AS stage FROM f GROUP BY ref), g AS (SELECT ref, count(DISTINCT key) AS n, min(key) AS k FROM f JOIN s USING (ref, stage) GROUP BY ref)"
            " SELECT q.ref, coalesce(n, 0) AS n_candidates, CASE WHEN n = 1 THEN k END AS key FROM q LEFT JOIN g USING (ref)"
        ),
        "sync_diff": (
            f"WITH {_NEW}, {_OLD}, j AS (SELECT coalesce(n.path, o.path) AS path, n.id AS ni, o.id AS oi, n.hash AS nh, o.hash AS oh FROM new n FULL JOIN old o ON n.path = o.path)"
            " SELECT path, ni AS id, 'added' AS change FROM j WHERE oi IS NULL OR ni <> oi UNION ALL SELECT path, oi, 'removed' FROM j WHERE ni IS NULL OR ni <> oi"
            " UNION ALL SELECT path, ni, CASE WHEN nh = oh THEN 'unchanged' ELSE 'updated' END FROM j WHERE ni = oi"
        ),
        "sync_merge": f"WITH {_NEW} SELECT * FROM new",
        "duplicate_ids_first_wins": "WITH f AS (SELECT source || '/' || doc_id AS path, CAST(doc_id % 97 AS VARCHAR) AS id, doc_id AS seq FROM documents), k AS (SELECT *, first_value(path) OVER (PARTITION BY id ORDER BY seq, path) AS kept FROM f) SELECT id, kept, path AS skipped FROM k WHERE path <> kept",
        "lint_docs": f"WITH {DOCS}, w AS (SELECT doc_id, title, {words('text')} AS n FROM docs) SELECT doc_id, 'warning' AS severity, 'no title' AS rule FROM w WHERE trim(coalesce(title, '')) = '' UNION ALL SELECT doc_id, 'warning', 'empty' FROM w WHERE n = 0 UNION ALL SELECT doc_id, 'warning', 'too long' FROM w WHERE n > 2500",
        "exclude_globs": f"WITH p AS (SELECT page_id, ltrim({_PATH}, '/') AS path FROM pages) SELECT page_id, path, path GLOB '**/*[0-4].html' OR path GLOB '*[0-4].html' OR path GLOB '*/1*' OR path GLOB 'page?' AS excluded FROM p",
        "sentence_split": f"SELECT doc_id, CAST(unnest(range(len(a))) AS INTEGER) AS n, unnest(a) AS sentence FROM (SELECT doc_id, {sentences_sql('text')} AS a FROM documents)",
        "similar_pairs_dice": (
            f"WITH {claims}, t AS (SELECT DISTINCT claim, unnest(string_split(claim, ' ')) AS w FROM c), z AS (SELECT claim, count(*) AS n FROM t GROUP BY claim),"
            " p AS (SELECT a.claim AS x, b.claim AS y, count(*) AS shared FROM t a JOIN t b ON a.w = b.w AND a.claim < b.claim GROUP BY a.claim, b.claim),"
            " d AS (SELECT x, y, shared, zx.n AS nx, zy.n AS ny FROM p JOIN z zx ON zx.claim = x JOIN z zy ON zy.claim = y WHERE 2 * shared >= 0.5 * (zx.n + zy.n))"
            " SELECT CASE WHEN nx <= ny THEN x ELSE y END AS small, CASE WHEN nx <= ny THEN y ELSE x END AS large, CAST(shared AS INTEGER) AS shared, round(2.0 * shared / (nx + ny), 4) AS similarity FROM d"
        ),
        "claims_grouped": f"WITH {claims} SELECT claim, count(*) AS n_statements, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM c GROUP BY claim",
    }
