"""Exact dedup by deterministic block naming, with Spark expressions only.

1. Normalised texts (A-Z lower-cased) are cut into blocks of ``block_bytes``.
2. Distinct blocks are hash-partitioned, sorted by content and numbered: equal
   blocks get one name, different ones different names.
3. Adjacent names of a document are paired; distinct pairs are sorted and
   numbered again, until each document has a single name. Documents of one byte
   length go through the same tree, so (length, name) is equal exactly when
   the texts are: no hash decides equality.

Names travel back to the blocks' places by SHA-256 digest; that no two distinct
blocks share a digest is checked on all of them, and the job fails loudly if two
ever did.

Scale: a text crosses the network once, as distinct blocks combined map-side,
so a block that a third of all documents hold is one row per task. All else is
some 50 bytes per block or document, cut by checkpoints. Names and groups are
joined back with joins that Spark can split at hot keys; nothing is collected
per group.

Nulls and edge cases: a null text equals an empty one. A null id is smaller than
any other. Rows repeated with one id are rows of the same group, of which one
stays (the later in file order). An empty table gives no rows. Columns besides
id and text are not read by the digest; ``exact_dedup_keep`` returns them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pizarra.llm.common import ascii_lower, cut, table, with_row_id

BLOCK_BYTES = 4096


def _digest(c: Column) -> Column:
    return F.unhex(F.sha2(c, 256))


def _blocks(text: Column, size: int) -> Column:
    last = F.greatest(F.ceil(F.octet_length(text) / size).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def _numbered(distinct: DataFrame, *columns: str) -> DataFrame:
    """Sort distinct values within their hash partitions and number them."""
    return distinct.sortWithinPartitions(*columns).withColumn("name", F.monotonically_increasing_id())


def identities(rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """From (rid, id, text): the documents (rid, id, n_bytes, text_sha256) and
    their identities (rid, n_bytes, name)."""
    normal = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    texts = rows.select("rid", "id", normal.cast("binary").alias("text"))
    block_list = _blocks(F.col("text"), block_bytes)
    places = cut(
        texts.select(
            "rid",
            "id",
            F.octet_length("text").alias("n_bytes"),
            F.sha2("text", 256).alias("text_sha256"),
            F.posexplode(F.transform(block_list, _digest)).alias("pos", "digest"),
        ).withColumns({c: F.when(F.col("pos") == 0, F.col(c)) for c in ("id", "text_sha256")})
    )
    distinct = texts.select(F.explode(block_list).alias("block")).distinct()
    names = _numbered(distinct, "block").select("name", _digest(F.col("block")).alias("digest"))
    checked = cut(
        names.groupBy("digest")
        .agg(F.min("name").alias("name"), F.count("*").alias("n"))
        .select("digest", F.when(F.col("n") == 1, F.col("name")).otherwise(F.raise_error(F.lit("two blocks share a SHA-256 digest"))).alias("name"))
    )
    level = places.join(checked, "digest").select("rid", "n_bytes", "pos", "name")
    top = places.agg(F.max("pos")).first()[0] or 0
    while top:
        pairs = cut(
            level.groupBy("rid", "n_bytes", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
            )
        )
        pair_names = cut(_numbered(pairs.select("left", "right").distinct(), "left", "right"))
        level = pairs.join(pair_names, ["left", "right"]).select("rid", "n_bytes", "pos", "name")
        top //= 2
    documents = places.where("pos = 0").select("rid", "id", "text_sha256")
    return documents, cut(level.select("rid", "n_bytes", "name"))


def _groups(rows: DataFrame, block_bytes: int) -> DataFrame:
    """From (rid, id, text): rid, id, keep_id, group_size, kept, text_sha256."""
    documents, names = identities(rows, block_bytes)
    named = documents.join(names, "rid")
    # nulls are the smallest, so a null id stays only among null ids
    # cut, so that Spark can split the rows of a large group in the join
    groups = cut(named.groupBy("n_bytes", "name").agg(F.max(F.struct("id", "rid")).alias("keep"), F.count("*").alias("group_size")))
    return named.join(groups, ["n_bytes", "name"]).select(
        "rid",
        "id",
        F.col("keep.id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("keep.rid")).alias("kept"),
        "text_sha256",
    )


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``df``: rid, id, keep_id, group_size, kept, text_sha256."""
    return _groups(with_row_id(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "rid"), block_bytes)


def exact_dedup_keep(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    names = df.columns
    inner = with_row_id(df.toDF(*(f"c{i}" for i in range(len(names)))), "rid")
    id_, text = (F.col(f"c{names.index(c)}").alias(n) for c, n in ((id_col, "id"), (text_col, "text")))
    dropped = _groups(inner.select("rid", id_, text), block_bytes).where(~F.col("kept")).select("rid")
    return inner.join(dropped, "rid", "left_anti").drop("rid").toDF(*names)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
