"""What the training-data operators share: tables, the shared folder, folds and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

#: Rows of an Arrow batch handed to Python. Texts can be long, so batches are kept short.
BATCH_ROWS = 1000
BATCH_BYTES = 32 << 20
#: Bits of a bitmap of ids (16 MB).
MARKS = 1 << 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under spark.checkpoint.dir. Only in local mode (tests), where that is unset, a local one is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = kept.get() if kept.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df written to the shared folder and read back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id is in fold 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % n, F.lit(0))


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: T.StructType | str) -> DataFrame:
    """Adds what fn makes of each Arrow batch; fn returns columns in the order of the schema."""
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    short_batches(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                columns = fn(part)
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns.values(), arrow, strict=True)], schema=arrow
                )

    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, out)  # fn goes by places; Spark takes a dot in a name for a field of a struct


def short_batches(spark: SparkSession) -> None:
    """Readies the session for Python on the executors: the package is there, and batches are short."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def sample_ids(df: DataFrame, key: str, most: int) -> DataFrame:
    """Rows of at most `most` distinct keys, one each and the same ones each time: those of the smallest hash."""
    return df.dropDuplicates([key]).orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(most)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for working columns: those wanted, made longer where the table has one that differs in case at most."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


class Marks:
    """A broadcast bitmap of MARKS bits in which ids are marked by their hash: what isn't marked isn't among them, so that few texts need be dealt out to be compared exactly.

    Its size is the same for any number of ids; with many more of them than bits it only spares less. `hashed` gives the column to test.
    """

    def __init__(self, ids: DataFrame):
        at = F.pmod(self.hashed(ids.columns[0]), F.lit(MARKS))
        words = ids.select(at.alias("at")).selectExpr("shiftright(at, 6) AS w", "shiftleft(1L, cast(at & 63 AS int)) AS b")
        found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # at most MARKS / 64 rows
        bits = np.zeros(MARKS // 64, dtype=np.int64)
        bits[found.column("w").to_numpy()] = found.column("b").to_numpy()
        self.bits = ids.sparkSession.sparkContext.broadcast(bits)

    @staticmethod
    def hashed(name: str) -> Column:
        return F.xxhash64(col(name))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = np.mod(hashes, MARKS)
        return (self.bits.value[at >> 6] >> (at & 63)) & 1 == 1


def whole_buckets(ordered: DataFrame, fn: Callable[[list[np.ndarray]], Iterator[list[np.ndarray]]], schema: str) -> DataFrame:
    """What fn makes of columns of numbers, of which the first is the key of a bucket; partitions are sorted by it and hold whole buckets.

    fn gets some whole buckets at a time; a bucket of one row is left out.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def found(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        new = np.concatenate([[True], c[0][1:] != c[0][:-1]])
        alone = new & np.concatenate([new[1:], [True]])
        for part in fn([x[~alone] for x in c]):
            if len(part[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in part], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []  # rows of a bucket that may go on in the next batch, joined once it ends
        for batch in batches:
            c = [x.to_numpy() for x in batch.columns]
            if not len(c[0]):
                continue
            if parts and c[0][-1] == parts[0][0][0]:
                parts.append(c)
                continue
            c = [np.concatenate(x) for x in zip(*parts, c, strict=True)]
            cut = int(np.searchsorted(c[0], c[0][-1]))
            if cut:
                yield from found([x[:cut] for x in c])
            parts = [[x[cut:] for x in c]]
        if parts:
            yield from found([np.concatenate(x) for x in zip(*parts, strict=True)])

    return ordered.mapInArrow(run, schema)
