import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture
def docs(spark, tmp_path):
    """Write (doc_id, text[, lang]) rows as a documents table and read it back."""

    def make(rows, files=2, extra=()):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        for name in extra:
            df = df.withColumn(name, df["doc_id"])
        path = str(tmp_path / "documents.parquet")
        df.repartition(files).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture
def sample():
    """Texts with copies, near copies, shared passages and edge cases."""
    import random

    r = random.Random(5)
    words = ["".join(r.choice("abcdeghilmnorstuéñ") for _ in range(r.randint(1, 9))) for _ in range(3000)]

    def prose(n):
        return " ".join(r.choice(words) for _ in range(n))

    passage = prose(70)
    rows = [(i, prose(r.randint(30, 300))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(12)]  # exact copies
    rows += [(120 + i, rows[3][1]) for i in range(9)]  # a larger group
    for i in range(25):  # near copies
        w = rows[20 + i % 3][1].split()
        for _ in range(r.randint(1, 4)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, prose(20) + " " + passage + " " + prose(25)) for i in range(14)]
    rows += [(400, ""), (401, None), (402, "   \n\t "), (403, "x"), (404, "one two"), (405, "One TWO"), (406, "ÀÉ one"), (407, "àé ONE")]
    rows += [(408, "ab" * 700), (409, "z" * 900), (410, "To " * 300), (411, rows[5][1] * 2)]
    rows += [(None, rows[1][1]), (None, "a null id"), (0, rows[0][1]), (7, "another row with id 7")]
    rows += [(500, prose(9000))]
    return rows
