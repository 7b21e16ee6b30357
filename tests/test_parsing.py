"""Front matter, Markdown and query texts."""

import pytest

from quillspark.errors import QueryError
from quillspark.functions.porter import analyzed, porter
from quillspark.functions.text import glob_regex
from quillspark.plans.querylang import Phrase, clean_tags, parse
from quillspark.sources import frontmatter, markdown


def front(block):
    out = frontmatter.read(f"---\n{block}\n---\nbody")
    assert out.body == "body"
    return out.values, out.warnings


def test_front_matter_values():
    values, warnings = front("title: \"A: b\"  # note\ntags: [x, 'y, z', \"q\\\"r\"]\nkeywords:\n  - one\n  - two # no\nsummary: >\n  folded\n  text\n\n  more\nplain: goes\n  on here")
    assert values == {"title": "A: b", "tags": ["x", "y, z", 'q"r'], "keywords": ["one", "two"], "summary": "folded text\nmore", "plain": "goes on here"}
    assert warnings == []


def test_front_matter_literal_and_comments():
    values, warnings = front("# a comment\nnote: |\n  one\n    two\nempty:\nurl: http://x/#y\nquote: 'it''s'")
    assert values == {"note": "one\n  two", "empty": "", "url": "http://x/#y", "quote": "it's"} and warnings == []


def test_front_matter_warnings():
    assert front("a: 1\na: 2")[1] == ["front matter key 'a' appears more than once; using the last one"]
    assert front("what is this")[1] == ["front matter line 2 not understood: what is this"]
    assert front("m:\n  k: v")[1] == ["front matter key 'm': nested mappings are not supported"]
    assert front("l: [a, b")[1] == ["front matter key 'l': unterminated [list]"]
    open_ = frontmatter.read("---\ntitle: x\nno end")
    assert open_.body.startswith("---") and open_.warnings and open_.values == {}


def test_anchors():
    a = markdown.Anchors()
    assert [a.new(x) for x in ("Setup", "Setup", "Setup", "Setup-1")] == ["setup", "setup-1", "setup-2", "setup-1-1"]
    assert markdown.slugify("What's *new*, in v2.0? Ünïcode_x") == "whats-new-in-v20-ünïcode_x"


def test_fences_and_comments_have_no_headings():
    text = "# A\n```sh\n# no\n~~~\n# still code\n```\n\n<!--\n# hidden\n-->\n## B ##\n~~~\n## no"
    assert [(s.level, s.heading) for s in markdown.sections_of(text.split("\n"), "")] == [(1, "A"), (2, "B")]


def test_sections():
    got = markdown.sections_of("intro\n# A\na\n## B\nb\n### C\nc\n## D\nd\n# E".split("\n"), "T")
    assert [(s.level, s.heading, s.start, s.end, s.subtree_end, s.trail) for s in got] == [
        (0, "T", 0, 1, 1, []), (1, "A", 1, 3, 9, ["A"]), (2, "B", 3, 5, 7, ["A", "B"]), (3, "C", 5, 7, 7, ["A", "B", "C"]), (2, "D", 7, 9, 9, ["A", "D"]), (1, "E", 9, 10, 10, ["E"]),
    ]


def test_links():
    text = "[a](x.md#s) ![i](p.png) [e](https://x.y) `[no](c.md)` [t](<a b.md> \"t\") [q](z.md?v=1#w) [u](a%20b.md) [h](#)\n[ref]: other.md 'T'\n[^1]: note.md\n```\n[no](n.md)\n```\n[s](#sec)"
    assert [(x.target, x.anchor, x.line, x.image) for x in markdown.links_of(text.split("\n"))] == [
        ("x.md", "s", 0, False), ("p.png", "", 0, True), ("a b.md", "", 0, False), ("z.md", "w", 0, False), ("a b.md", "", 0, False), ("other.md", "", 1, False), ("", "sec", 6, False),
    ]


def test_text_functions():
    assert markdown.plain("**b** _i_ `x_y` [l](u) ![p](q) <b>t</b> ~~s~~ \\*e") == "b i x_y l p t s *e"
    assert markdown.index_text("- item\n> quote\n| a | b |\n|---|---|\n***\n```\ncode\n```\n[r]: x.md") == "item\nquote\na — b\ncode"
    assert markdown.first_paragraph("# T\n\n![i](x)\n\n- one\n  more\n- two".split("\n")) == "one more"
    assert markdown.prose_blocks("a\nb\n- c\n  d\n\n| h | i |\n|---|---|\n# H\ne".split("\n")) == [(0, "a\nb", False), (2, "c\nd", False), (5, "h — i", True), (8, "e", False)]
    assert markdown.shorten("x. " * 100, 30).endswith("x.") and markdown.shorten("word " * 60, 22) == "word word word word…"


def test_document():
    d = markdown.parse("\ufeff---\r\ntags: '#A, b'\r\ndescription: D\r\nowner: me\r\nrelated: [x, x]\r\n---\r\n# T\r\ntext", "fallback")
    assert (d.title, d.summary, d.tags, d.meta, d.related, d.body_line, d.words, d.has_title, d.has_summary) == ("T", "D", ["a", "b"], {"owner": "me"}, ["x"], 6, 2, True, True)
    assert markdown.parse("text", "Fallback").title == "Fallback"


def phrases(text, role="any"):
    return [p.tokens for p in parse(text) if p.role == role and not p.prefix]


def test_query_texts():
    assert phrases("How do I roll back a deploy?") == [("roll",), ("back",), ("deploy",), ("roll", "back")]
    assert phrases("how to") == [("how",), ("to",), ("how", "to")]
    assert [p.tokens for p in parse("db auth 404") if p.prefix] == [("auth",)]
    assert ("deploy", "rollback") not in phrases("deploy, rollback")
    assert phrases("front-end build")[3:] == [("front", "end"), ("end", "build")]
    assert phrases("snake_case")[:2] == [("snake",), ("case",)]
    assert phrases('"feature flag" rollout', "all") == [("feature", "flag")]
    assert phrases('"deploy"') == [("deploy",)]
    assert phrases("deploy -staging --verbose", "none") == [("staging",)] and ("verbose",) in phrases("deploy -staging --verbose")
    assert sum(len(p) == 1 for p in phrases(" ".join(f"w{i}" for i in range(40)))) == 16
    for bad in ("-foo", "?!", "", "  ", None):
        with pytest.raises(QueryError):
            parse(bad)
    assert clean_tags("#B, a,,B") == ["a", "b"]
    assert Phrase(("x",), "none").scores is False


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("running", "run"), ("hopping", "hop"), ("deploy", "deploi"), ("caching", "cach"), ("generation", "gener"), ("relational", "relat"), ("happy", "happi"), ("sky", "sky"), ("agreed", "agre"), ("controlling", "control"), ("rational", "ration"), ("effective", "effect"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas")])
def test_porter(word, stem):
    assert porter(word) == stem


def test_folding():
    assert analyzed("Résumé") == "resum" and analyzed("straße") == "straße"


def test_globs():
    import re

    match = lambda p, x: bool(re.match(glob_regex(p), x))
    assert match("*.md", "a/b.md") and match("**/x/*", "x/y") and match("**/x/*", "a/x/y") and match("/a?.md", "ab.md") and match("[!b]x", "ax")
    assert not match("a.md", "aXmd") and not match("*.md", "a.mdx")
