import pytest
from pyspark.sql import types as T

#: Texts of every awkward kind: null, empty, blank, repeated, very long, without letters, of many scripts.
ODD = [None, "", "   \n\t ", "a", "A a.\nA a.", "x" * 200_000, "word " * 40_000, "12 34 !!", "日本語 текст ñandú ÀÉ", "don't  I'll\r\nstop", "same text", "same text", "\n\n\n", "é" * 50 + "\nline"]

#: Names that operators use for results or while they work, as columns of the input; and one with a dot.
CLASHING = ["score", "key", "weight", "n_lines", "component_id", "quality_score", "lost", "Lost_ID", "mix_topic", "mix_tokens", "mix_sampled", "cell_source", "topic", "tokens", "probability", "set_id", "root", "first_id", "row_hash", "fingerprint", "text_key", "text_parts", "t", "k1", "v", "__score", "__component_id", "a.b"]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with those texts, two with the same id, one without, and columns whose names operators might use themselves."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), *[T.StructField(c, T.StringType()) for c in CLASHING]])
    more = tuple(f"own {c}" for c in CLASHING)
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", *more) for i, t in enumerate(ODD)]
    rows += [(3, "a", "en", "s1", *more), (None, "no id", "en", "s1", *more)]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
