r"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Each document's topic and tokens are found in one pass and written to the shared folder; documents are counted into cells (source,
language, topic) with their tokens, and all later sums are over cells. A sweep of raking multiplies each cell's weight so that the weighted tokens meet the
target shares of sources, then of languages, then of topics. Sweeps go on until none changes a weight by more than `tolerance` (relative), and `sweeps` at
most; `rake` gives the last change as the column residual. Cells are dealt out by the values of a margin for its step (a value's cells, not its documents, are one
task's rows, which Spark spills); sums over all cells are aggregations of one row.

Without given targets, the target share of a value is its share of tokens to the power `temper`, normalised, which lifts small ones, but at most
`lift` times its own share; what that takes away goes to the other values in proportion. A document's
probability is its cell's weight over the greatest weight, so no probability is cut and the sample's expected shares are the targets. With `keep` the constant
is that which makes the expected tokens this share of all; cells that it would draw more than once are drawn once, and fall short
of their targets (`shares` gives what a sample attains). A document is drawn if a hash of its id, uniform in [0, 1), is below its probability, so a draw can
be repeated.

Cases: null source, language or topic are values of their own (shown as null); a null text has no tokens and weighs nothing in the sums, but
has its cell's probability (0 in a cell without any tokens and with no other); repeated rows of an id are drawn together; margins whose target isn't met by any token
are left out and the others share their weight; an empty table gives no rows; other columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import col, fresh, stored

SWEEPS, TOLERANCE, TEMPER, LIFT = 20, 1e-9, 0.7, 2.0
MARGINS = ("source", "lang", "topic")

# Signs of topics, the first that fits counts.
TOPICS = (
    ("licence", r"(?i)licen[cs]e|copyright|all rights reserved"),
    ("contact", r"[A-Za-z0-9]@[A-Za-z0-9]"),
    ("table", r" \| "),
    ("figures", r"[0-9]"),
)


def topic_of(text: Column, topics: tuple[tuple[str, str], ...] = TOPICS, other: str = "prose") -> Column:
    """The topic of a text by its signs."""
    out = F.lit(other)
    for name, pattern in reversed(topics):
        out = F.when(F.coalesce(text, F.lit("")).rlike(pattern), name).otherwise(out)
    return out


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) from the id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def tempered(cells: DataFrame, margins: tuple[str, ...] = MARGINS, temper: float = TEMPER, lift: float = LIFT) -> DataFrame:
    """(margin, v, share): the target shares of all margins' values; v as text."""
    own = None
    for m in margins:
        one = cells.groupBy(F.lit(m).alias("margin"), F.col(m).cast("string").alias("v")).agg(F.sum("tokens").cast("double").alias("tokens"))
        own = one if own is None else own.unionByName(one)
    own = stored(own.filter("tokens > 0"), "margins")
    sums = own.groupBy("margin").agg(F.sum("tokens").alias("all"), F.sum(F.pow("tokens", F.lit(temper))).alias("powers"))
    own = own.join(F.broadcast(sums), "margin").select("margin", "v", (F.col("tokens") / F.col("all")).alias("now"), (F.pow("tokens", F.lit(temper)) / F.col("powers")).alias("share"))
    high = F.col("share") > lift * F.col("now")
    cut = own.groupBy("margin").agg(F.sum(F.when(high, lift * F.col("now")).otherwise(0.0)).alias("held"), F.sum(F.when(high, 0.0).otherwise(F.col("share"))).alias("free"))
    rest = F.when(F.col("free") > 0, F.col("share") * (1 - F.col("held")) / F.col("free")).otherwise(F.col("share"))
    return own.join(F.broadcast(cut), "margin").select("margin", "v", F.when(high, lift * F.col("now")).otherwise(rest).alias("share"))


def rake(cells: DataFrame, margins: tuple[str, ...] = MARGINS, sweeps: int = SWEEPS, temper: float = TEMPER, lift: float = LIFT, targets: dict[str, DataFrame] | None = None, tolerance: float = TOLERANCE, each: int = 4) -> DataFrame:
    """cells (margins, tokens) with weight, and with residual: the largest relative change of a weight in the last sweep.

    targets: for a margin a table (value, share).
    """
    cells = stored(cells.groupBy(*margins).agg(F.sum("tokens").alias("tokens")), "cells")
    goals = tempered(cells, margins, temper, lift)
    for m in targets or {}:
        seen = cells.filter("tokens > 0").select(F.col(m).cast("string").alias("w")).distinct()
        given = targets[m].select(F.lit(m).alias("margin"), F.col("value").cast("string").alias("v"), F.col("share").cast("double").alias("share")).join(seen, F.col("v").eqNullSafe(F.col("w")), "left_semi")
        whole = given.groupBy("margin").agg(F.sum("share").alias("whole"))
        goals = goals.filter(F.col("margin") != m).unionByName(given.join(F.broadcast(whole), "margin").select("margin", "v", (F.col("share") / F.col("whole")).alias("share")))
    goals = stored(goals, "targets")
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    out, names = cells.withColumn("weight", F.lit(1.0)), [*margins, "tokens", *(f"t_{m}" for m in margins)]
    for m in margins:
        own = goals.filter(F.col("margin") == m).select("v", F.col("share").alias(f"t_{m}"))
        out = out.join(own, F.col(m).cast("string").eqNullSafe(F.col("v")), "left").drop("v")
    out = stored(out.fillna(0.0, [f"t_{m}" for m in margins]), "raking")
    residual = 0.0
    for done in range(0, sweeps, each):
        now = out
        for _ in range(done, min(sweeps, done + each)):
            now = now.select(*names, "weight", F.col("weight").alias("before"))
            for m in margins:
                held = F.sum(F.col("weight") * F.col("tokens")).over(Window.partitionBy(m))
                now = now.select(*names, F.when(held > 0, F.col("weight") * F.col(f"t_{m}") * F.lit(total) / held).otherwise(0.0).alias("weight"), "before")
        change = Observation()  # of the last of these sweeps, measured while they are written
        counts = (F.col("before") > 0) & (F.col("tokens") > 0)
        out = stored(now.observe(change, F.max(F.when(counts, F.abs(F.col("weight") / F.col("before") - 1))).alias("most")).drop("before"), "raking")
        residual = change.get["most"] or 0.0
        if residual <= tolerance:
            break
    return out.select(*margins, "tokens", "weight", F.lit(float(residual)).alias("residual"))


def constant(cells: DataFrame, keep: float | None = None) -> float:
    """What weights are multiplied by. Without keep 1 / the greatest weight; else each round counts the cells that would be drawn more than once as drawn once, until none is new."""
    mass = F.col("weight") * F.col("tokens")
    if keep is None:
        most = cells.filter("tokens > 0").agg(F.max("weight")).first()[0]
        return 1 / most if most else 0.0
    every = cells.agg(F.sum("tokens")).first()[0] or 0
    c = 0.0
    while True:
        whole = F.col("weight") * F.lit(c) >= 1
        got = cells.agg(F.sum(F.when(whole, F.col("tokens"))).alias("whole"), F.sum(F.when(~whole, mass)).alias("rest")).first()
        new = (every * keep - (got["whole"] or 0)) / got["rest"] if got["rest"] else c
        if new <= c * (1 + 1e-12):
            return c
        c = new


def calibrated(cells: DataFrame, keep: float | None = None) -> DataFrame:
    """cells with probability min(1, c x weight)."""
    return cells.withColumn("probability", F.round(F.least(F.lit(1.0), F.col("weight") * F.lit(constant(cells, keep))), 9))


def shares(cells: DataFrame, margin: str) -> DataFrame:
    """(value, target, attained): of raked and calibrated cells, the weights' share of a margin's value and that of the sample's expected tokens."""
    weighted, drawn = F.col("weight") * F.col("tokens"), F.col("probability") * F.col("tokens")
    sums = cells.agg(F.sum(weighted).alias("w"), F.sum(drawn).alias("d")).first()
    return cells.groupBy(F.col(margin).alias("value")).agg((F.sum(weighted) / F.lit(sums["w"] or 1.0)).alias("target"), (F.sum(drawn) / F.lit(sums["d"] or 1.0)).alias("attained"))


ADDED = ("mix_topic", "mix_tokens", "mix_weight", "mix_probability", "mix_sampled")


def weigh(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", lang: str = "lang", topic: Column | None = None, keep: float | None = None, names: tuple[str, ...] = ADDED, needed: list[str] | None = None, **options) -> DataFrame:
    """docs (or only their columns `needed`) with topic, tokens, weight, probability and sampled, under `names`. options are those of `rake`."""
    n_topic, n_tokens, n_weight, n_probability, n_sampled = fresh(docs, *names)
    counted = docs.withColumn(n_topic, topic_of(col(text)) if topic is None else topic).withColumn(n_tokens, token_count(col(text)))
    if needed is not None:
        counted = counted.select(*[col(c) for c in (*needed, n_topic, n_tokens)])
    counted = stored(counted, "mixing-counted")  # each text is read once; cells and the draw use the numbers
    cells = counted.groupBy(col(source).alias("source"), col(lang).alias("lang"), col(n_topic).alias("topic")).agg(F.sum(col(n_tokens)).alias("tokens"))
    fitted = stored(calibrated(rake(cells, **options), keep), "mixture")
    side = dict(zip(MARGINS, fresh(counted, *(f"cell_{m}" for m in MARGINS)), strict=True))
    fitted = fitted.select(*[F.col(m).alias(n) for m, n in side.items()], F.col("weight").alias(n_weight), F.col("probability").alias(n_probability))
    same = col(source).eqNullSafe(col(side["source"])) & col(lang).eqNullSafe(col(side["lang"])) & col(n_topic).eqNullSafe(col(side["topic"]))
    out = counted.join(fitted, same, "left").drop(*side.values())
    return out.withColumn(n_sampled, uniform(col(doc_id)) < F.coalesce(col(n_probability), F.lit(0.0)))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The drawn documents."""
    out = weigh(docs, **options)
    return out.filter(col(out.columns[-1])).select(*[col(c) for c in docs.columns])


def digests(docs: DataFrame) -> DataFrame:
    out = weigh(docs.select("doc_id", "text", "source", "lang"), needed=["doc_id", "source", "lang"])
    return out.select("doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.round("mix_weight", 6).alias("weight"), F.round("mix_probability", 6).alias("probability"), F.col("mix_sampled").alias("sampled"))


def sql(sweeps: int = SWEEPS, temper: float = TEMPER, lift: float = LIFT, source: str = "documents") -> str:
    """The same in DuckDB's SQL: each step of the raking is a common table expression."""
    kinds = "ELSE ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}' " for n, p in TOPICS) + "ELSE 'prose'" + " END" * len(TOPICS)
    parts = [
        rf"d AS (SELECT *, {kinds} AS topic, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM {source})",
        "c0 AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL)",
    ]
    for m in MARGINS:
        parts.append(f"s_{m} AS (SELECT v, n / sum(n) OVER () AS now, pow(n, {temper}) / sum(pow(n, {temper})) OVER () AS s FROM (SELECT {m} AS v, sum(tokens) AS n FROM c0 GROUP BY {m}) WHERE n > 0)")
        parts.append(
            f"h_{m} AS (SELECT v, CASE WHEN s > {lift} * now THEN {lift} * now ELSE s * (1 - (SELECT coalesce(sum({lift} * now), 0) FROM s_{m} WHERE s > {lift} * now))"
            f" / (SELECT sum(s) FROM s_{m} WHERE s <= {lift} * now) END AS t_{m} FROM s_{m})"
        )
    joins = " ".join(f"LEFT JOIN h_{m} ON c0.{m} IS NOT DISTINCT FROM h_{m}.v" for m in MARGINS)
    parts.append(f"k0 AS (SELECT source, lang, topic, tokens, sum(tokens) OVER () AS total, CAST(1 AS DOUBLE) AS weight, {', '.join(f'coalesce(t_{m}, 0) AS t_{m}' for m in MARGINS)} FROM c0 {joins})")
    for i in range(sweeps * len(MARGINS)):
        m = MARGINS[i % len(MARGINS)]
        parts.append(f"k{i + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(weight * tokens) OVER (PARTITION BY {m}) > 0 THEN weight * t_{m} * total / sum(weight * tokens) OVER (PARTITION BY {m}) ELSE 0 END AS weight) FROM k{i})")
    last = f"k{sweeps * len(MARGINS)}"
    parts.append(f"p AS (SELECT source, lang, topic, weight, round(least(1, coalesce(weight / (SELECT max(weight) FROM {last} WHERE tokens > 0), 0)), 9) AS probability FROM {last})")
    on = " AND ".join(f"d.{m} IS NOT DISTINCT FROM p.{m}" for m in MARGINS)
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(p.weight, 6) AS weight, round(p.probability, 6) AS probability,"
        f" CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 < p.probability AS sampled FROM d JOIN p ON {on}"
    )
