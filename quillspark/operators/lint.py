"""Rules for documents, each an anti-join or a filter; their issues are unioned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_count

LONG_DOCUMENT = 2500


def issue(rows: DataFrame, severity: str, path, message, line=None, rank: int = 0) -> DataFrame:
    col = lambda x: F.col(x) if isinstance(x, str) else x
    return rows.select(F.lit(severity).alias("severity"), col(path).alias("path"), (F.lit(None).cast("int") if line is None else line).cast("int").alias("line"), (F.lit(message) if isinstance(message, str) else message).alias("message"), F.lit(rank).alias("rank"))


def text_issues(docs: DataFrame, key: str, title: str = "title", text: str = "text") -> DataFrame:
    """(key, severity, rule): documents without text, too long ones, and those whose first line is blank; one scan."""
    words = word_count(F.col(text))
    rules = F.array(
        F.when(F.coalesce(F.trim(title), F.lit("")) == "", "no title"),
        F.when(words == 0, "empty").when(words > LONG_DOCUMENT, "too long"),
    )
    return docs.select(key, F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule")).select(key, F.lit("warning").alias("severity"), "rule")


def index_issues(tables: dict[str, DataFrame], found: dict[str, DataFrame]) -> DataFrame:
    """(severity, path, line, message) in the order of the rules.

    tables: documents, sections, links of the index. found: missing (path), duplicates (id, kept, skipped), unreadable (path, message),
    files (target): link targets that exist on disk.
    """
    docs, sections, links = tables["documents"], tables["sections"], tables["links"]
    own = docs.select("doc_seq", "path")
    parts = [
        issue(found["missing"], "error", "path", "source path does not exist (check 'sources' in the configuration)", rank=0),
        issue(found["duplicates"], "error", "skipped", F.concat(F.lit("doc id '"), "id", F.lit("' is already used by "), "kept", F.lit("; rename one of them")), rank=1),
        issue(found["unreadable"], "error", "path", F.concat(F.lit("could not read file: "), "message"), rank=2),
        issue(docs.select("path", F.posexplode("warnings").alias("n", "message")), "warning", "path", F.col("message"), rank=3),
        issue(docs.filter("not has_title"), "warning", "path", "no title: add 'title:' front matter or a '# Heading'", rank=4),
        issue(docs.filter("not has_summary"), "warning", "path", "no summary: add 'summary:' front matter (shown in results)", rank=5),
        issue(docs.filter("words = 0"), "warning", "path", "document is empty", rank=6),
        issue(docs.filter(F.col("words") > LONG_DOCUMENT), "warning", "path", F.concat("words", F.lit(" words: consider splitting it so agents can read just the part they need")), rank=6),
    ]
    anchors = sections.join(own, "doc_seq").select(F.col("path").alias("t_path"), F.col("anchor").alias("t_anchor")).distinct()
    known = docs.select(F.col("path").alias("t_path")).distinct()
    ids = docs.select(F.col("id").alias("t_id"), F.col("path").alias("to_path"))
    from_ = links.join(own, "doc_seq")
    named = from_.filter("kind = 'related'").join(ids, F.col("target") == F.col("t_id"), "left").join(known, F.col("target") == F.col("t_path"), "left").withColumn("to", F.coalesce("to_path", "t_path")).drop("t_id", "to_path", "t_path")
    show = F.when(F.col("anchor") != "", F.concat_ws("#", "target", "anchor")).otherwise(F.col("target"))
    has_anchor = lambda rows, at: rows.filter("anchor <> ''").join(anchors, (F.col(at) == F.col("t_path")) & (F.col("anchor") == F.col("t_anchor")), "left_anti")
    direct = from_.filter("kind <> 'related' and target <> ''").join(known, F.col("target") == F.col("t_path"), "left")
    parts += [
        issue(named.filter("to is null"), "error", "path", F.concat(F.lit("related doc '"), "target", F.lit("' does not exist")), F.col("line"), 7),
        issue(has_anchor(named.filter("to is not null"), "to"), "warning", "path", F.concat(F.lit("related section "), show, F.lit(" does not exist")), F.col("line"), 7),
        issue(has_anchor(from_.filter("kind = 'anchor'"), "path"), "warning", "path", F.concat(F.lit("link to missing section #"), "anchor"), F.col("line"), 7),
        issue(has_anchor(direct.filter("t_path is not null").drop("t_path"), "target"), "warning", "path", F.concat(F.lit("link to missing section "), show), F.col("line"), 7),
        issue(direct.filter("t_path is null").join(found["files"].select(F.col("target").alias("on_disk")), F.col("target") == F.col("on_disk"), "left_anti"), "error", "path", F.concat(F.lit("broken link: "), "target", F.lit(" does not exist")), F.col("line"), 7),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    general = F.when(F.col("rank") <= 2, F.col("rank")).otherwise(3)
    return out.orderBy(general, "path", "rank", F.col("line").asc_nulls_first(), "message").drop("rank")
