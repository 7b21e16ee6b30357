r"""Exact top-k by inner product, with vectors in buckets of similar length.

Components become integers floor(scale * x), so products are exact. Vectors are grouped by length into buckets (bounds are quantiles
of all lengths), a bucket into blocks of about BLOCK vectors by hash, so many equal vectors or lengths don't meet in one task, and
GROUP blocks of a bucket into a group, which one task can hold. A first pass over one block of long vectors gives each query a bound, its k-th best score
there, and so its need: the least length of a vector that can reach it. Queries in order of their need form blocks; a block is sent to the groups whose
longest vector reaches its least need, once each, and candidates move once. Within two blocks each query has a local cosine threshold, bound / (its length x the block's largest length):
above 1 it is done; a high one selects candidates by the query's largest coordinate, where the cosine leaves a narrow
range; another one takes the candidates that are long enough. What is left is verified by exact products, and the
k best of each group meet in a last ranking.

Cases: vectors that are null or hold null or non-finite components take no part; identical rows (same id and vector) are one; rows of
the query's id are not its candidates; only vectors of as many components meet; ties go to the smaller id; zero vectors score 0; products
that could leave 64 bits raise an OverflowError; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import short_batches, stored

BLOCK, QUERIES, BUCKETS, GROUP = 2048, 512, 16, 16
NARROW = 0.8
#: A block of candidates (kind 0; reach is its largest length) or of queries (kind 1; reach is their least need).
PACKED = "dim int, grp string, kind int, block string, n int, reach double, ids binary, vectors binary, norms binary, bounds binary"
ASKED = "dim int, vec_id long, vector binary, norm double, bound double, need double"


def integers(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v array<bigint>, dim, norm) of the rows that take part."""
    x = F.col(f"`{embedding}`")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    rows = df.filter(x.isNotNull() & F.col(f"`{vec_id}`").isNotNull() & ~bad)
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    rows = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v")).distinct()
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))
    return rows.select("vec_id", "v", F.size("v").alias("dim"), norm.alias("norm"))


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(schema))


def _bytes(values: np.ndarray) -> bytes:
    return values.astype("<i4" if not values.size or np.abs(values).max() < 2**31 else "<i8").tobytes()


def _packed(rows: DataFrame) -> DataFrame:
    """rows (dim, grp, block, vec_id, v, norm) to a row for each block, its vectors by falling length."""
    schema = _arrow(PACKED)

    def one(t: pa.Table) -> pa.Table:
        norms, ids = t.column("norm").to_numpy(), t.column("vec_id").to_numpy()
        order = np.lexsort((ids, -norms))
        values = t.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
        own = {"dim": values.shape[1], "grp": t.column("grp")[0].as_py(), "kind": 0, "block": t.column("block")[0].as_py(), "n": len(ids), "reach": float(norms.max()), "ids": ids[order].astype("<i8").tobytes(), "vectors": _bytes(values), "norms": norms[order].astype("<f8").tobytes(), "bounds": b""}
        return pa.Table.from_pylist([own], schema=schema)

    return rows.select("dim", "grp", "block", "vec_id", "v", "norm").groupBy("dim", "block").applyInArrow(one, PACKED)


def _blocks(rows: DataFrame, size: int, buckets: int, group: int) -> DataFrame:
    """rows with a block: a bucket of lengths, and within it a part by hash; and with the group that some parts form."""
    bounds = rows.agg(F.percentile_approx("norm", [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    bucket = sum((F.when(F.col("norm") >= b, 1).otherwise(0) for b in sorted(set(bounds))), F.lit(0))
    rows = rows.withColumn("bucket", bucket)
    parts = rows.groupBy("dim", "bucket").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts"))
    rows = rows.join(parts, ["dim", "bucket"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")))
    return rows.withColumn("block", F.concat_ws("-", "bucket", "part")).withColumn("grp", F.concat_ws("-", "bucket", F.floor(F.col("part") / group)))


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, dim = row["n"], row["dim"]
    raw = row["vectors"]
    kind = "<i4" if len(raw) == 4 * n * dim else "<i8"
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(raw, kind).reshape(n, dim), np.frombuffer(row["norms"], "<f8")


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: in floating point while all sums stay below 2**53."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if top >= 2**63:
        raise OverflowError("products of these vectors can leave 64 bits")
    if top < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ c.astype(np.int64).T


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by (score falling, id rising)."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        own = np.flatnonzero(scores >= least)
        ids, scores = ids[own], scores[own]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search_block(q_ids, q, q_norms, bounds, c_ids, c, c_norms, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score): the k best of a block that can be among a query's k best of all."""
    out = []
    longest = c_norms[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(q_norms * longest > 0, bounds / (q_norms * longest), -np.inf)
    local = np.where(np.isneginf(bounds), -np.inf, local) - 1e-9  # rounding never prunes
    by_length = np.flatnonzero(local < NARROW)
    narrow = np.flatnonzero((local >= NARROW) & (local <= 1))
    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    if len(by_length):
        need = np.where(q_norms[by_length] > 0, bounds[by_length] / np.where(q_norms[by_length] > 0, q_norms[by_length], 1), -np.inf)
        reach = np.searchsorted(-c_norms, -(need * (1 - 1e-9) - 1e-6), side="right")
        order = np.argsort(reach)
        for a in range(0, len(order), 128):
            own = order[a : a + 128]
            top = int(reach[own].max())
            scores = products(q[by_length[own]], c[:top])
            found += [(int(by_length[i]), c_ids[: reach[i]], scores[j, : reach[i]]) for j, i in enumerate(own)]
    if len(narrow):
        with np.errstate(divide="ignore", invalid="ignore"):
            unit = np.where(c_norms[:, None] > 0, c / c_norms[:, None], 0)
        for i in narrow:
            u = q[i] / q_norms[i]
            f = int(np.abs(u).argmax())
            t = min(1.0, max(0.0, local[i]))
            slack = float(np.sqrt(max(0.0, 1 - t * t)) * np.sqrt(max(0.0, 1 - u[f] * u[f])))
            low = -1.0 if u[f] < -t else u[f] * t - slack
            high = 1.0 if u[f] > t else u[f] * t + slack
            own = np.flatnonzero((unit[:, f] >= low - 1e-9) & (unit[:, f] <= high + 1e-9))
            found.append((int(i), c_ids[own], products(q[i : i + 1], c[own])[0]))
    for i, ids, scores in found:
        other = ids != q_ids[i]
        a, s = best(ids[other], scores[other], k)
        out += [(int(q_ids[i]), int(x), int(y)) for x, y in zip(a, s, strict=True) if y >= bounds[i]]
    return out


def _bounded(asked: DataFrame, probe: DataFrame, k: int, queries: int) -> DataFrame:
    """asked (dim, vec_id, v, norm) with each query's bound and need, from the probe: a block of candidates for each dim."""
    schema = _arrow(ASKED)
    parts = asked.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / queries).cast("int").alias("parts"))
    blocks = _packed(asked.join(parts, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("string")).withColumn("grp", F.lit("")))
    both = blocks.join(probe.select("dim", F.struct(*probe.columns).alias("probe")), "dim").select(F.struct(*blocks.columns).alias("q"), "probe")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (ids, q, norms), (c_ids, c, _) = _unpacked(row["q"]), _unpacked(row["probe"])
                scores = products(q, c).astype(np.float64)
                scores[ids[:, None] == c_ids[None]] = -np.inf
                bounds = np.sort(scores, axis=1)[:, -k] if len(c_ids) >= k else np.full(len(ids), -np.inf)
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(norms > 0, bounds / norms, -np.inf)
                wide = q.astype("<i8")
                yield pa.RecordBatch.from_pydict({"dim": [q.shape[1]] * len(ids), "vec_id": ids, "vector": [x.tobytes() for x in wide], "norm": norms, "bound": bounds, "need": need}, schema=schema)

    return both.mapInArrow(run, ASKED)


def _by_need(asked: DataFrame, queries: int) -> DataFrame:
    """Blocks of queries that follow one another in order of need."""
    schema = _arrow(PACKED)
    asked = stored(asked, "topk-asked")
    tasks = max(1, -(-asked.count() // (8 * queries)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def block() -> pa.RecordBatch:
            dim = held[0]["dim"]
            values = np.frombuffer(b"".join(r["vector"] for r in held), "<i8").reshape(len(held), dim)
            many = lambda name, kind: np.array([r[name] for r in held], dtype=kind).tobytes()
            own = {"dim": dim, "grp": "", "kind": 1, "block": "", "n": len(held), "reach": min(r["need"] for r in held), "ids": many("vec_id", "<i8"), "vectors": _bytes(values), "norms": many("norm", "<f8"), "bounds": many("bound", "<f8")}
            return pa.RecordBatch.from_pylist([own], schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["dim"] != held[0]["dim"] or len(held) == queries):
                    yield block()
                    held.clear()
                held.append(row)
        if held:
            yield block()

    return asked.repartitionByRange(tasks, "dim", "need", "vec_id").sortWithinPartitions("dim", "need", "vec_id").mapInArrow(run, PACKED)


def search(df: DataFrame, is_query, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 5, scale: int = 256, block: int = BLOCK, queries: int = QUERIES, buckets: int = BUCKETS, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score). is_query: a condition on vec_id, which rows of df are queries."""
    short_batches(df.sparkSession)
    rows = stored(integers(df, vec_id, embedding, scale), "topk-vectors")
    c_blocks = stored(_packed(_blocks(rows, block, buckets, group)), "topk-blocks")

    # the longest block of each dimension gives the bounds
    longest = c_blocks.groupBy("dim").agg(F.max(F.struct("reach", "block")).alias("top")).select("dim", F.col("top.block").alias("block"))
    probe = c_blocks.join(longest, ["dim", "block"], "left_semi")
    q_blocks = stored(_by_need(_bounded(rows.filter(is_query(F.col("vec_id"))), probe, k, queries), queries), "topk-queries")

    groups = c_blocks.groupBy("dim", "grp").agg(F.max("reach").alias("longest"))
    least = F.col("reach") * (1 - F.signum("reach") * 1e-9) - 1e-6  # rounding never prunes
    sent = q_blocks.drop("grp").join(groups, "dim").filter(F.col("longest") >= least).select(*c_blocks.columns)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["dim"], row["grp"]) != key:
                    held, key = [], (row["dim"], row["grp"])
                if row["kind"] == 0:
                    held.append(_unpacked(row))
                    continue
                own, bounds = _unpacked(row), np.frombuffer(row["bounds"], "<f8")
                got = [np.array(x, dtype=np.int64).reshape(-1, 3) for c in held if (x := search_block(*own, bounds, *c, k))]
                if not got:
                    continue
                got = np.concatenate(got)
                got = got[np.lexsort((got[:, 1], -got[:, 2], got[:, 0]))]
                begins = np.flatnonzero(np.concatenate([[True], got[1:, 0] != got[:-1, 0]]))
                place = np.arange(len(got)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(got)]])))
                got = got[place < k]
                yield pa.RecordBatch.from_arrays([pa.array(got[:, i]) for i in range(3)], names=["query_id", "vec_id", "score"])

    met = c_blocks.unionByName(sent).repartition("dim", "grp").sortWithinPartitions("dim", "grp", "kind")
    found = met.mapInArrow(verify, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""


def digests(embeddings: DataFrame) -> DataFrame:
    return search(embeddings, lambda c: c % 50 == 0)
