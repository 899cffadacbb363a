"""Mixing sources to target weights by Pareto order sampling.

1. Sources are ranked by code point and get the weights in turn. Their targets
   are ``share`` of all words by weight, none above ``copies`` times the source;
   what is above is shared again. With sources ordered by cap over weight the
   level of the rest is a ratio of two running sums, so no round is repeated.
2. Within a source, a document of weight w is to come ``min(copies, c w)`` times,
   c being set so that the words add up to the target (the same ratio, over
   weight classes). The whole copies of that number are certain.
3. The fraction p left over is an inclusion probability. Documents are ranked by
   random odds over inclusion odds, u / (1 - u) : p / (1 - p), and come in that
   order until the words that are left to the source are filled: a sample of
   fixed size, counted in words, of unequal probabilities. The document on the
   border is taken in part, so that the source meets its target to a word.

u comes from a hash of seed and id, so reruns agree, whatever the file layout.

Scale: texts are read once and never shuffled. The border of a source is found in
a histogram of ``BUCKETS`` buckets of the ranking variable; only documents of the
border bucket are ordered, by range over all sources (``running_sums``), so no
source is gathered. Weights are whole numbers from 1 to ``WEIGHTS``, which bounds
the classes of a source; sources themselves are ordered by range too.

Nulls and edge cases: a null text has size 0 (taken 0); a null source is a source
of its own, ranked last; null ids share one hash. Repeated rows are documents of
their own; ties are broken by id, size and row. A null weight is 1; others are
cut to whole numbers within the bounds. A source without words has target 0. An
empty table gives no rows. Columns besides id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pizarra.llm.common import cut, table
from pizarra.operators.running import running_sums

#: Largest document weight, and buckets of the ranking variable.
WEIGHTS, BUCKETS = 1000, 1 << 16
SOURCE_WEIGHTS, SHARE, COPIES = (3, 1, 2), 1.5, 2


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def length_weight(size: Column) -> Column:
    """A little more for longer texts: 10 and the binary digits of the size."""
    return F.length(F.bin(size)) + 10


def targets(sources: DataFrame, weights: tuple[int, ...] = SOURCE_WEIGHTS, share: float = SHARE, copies: int = COPIES) -> DataFrame:
    """From (source, source_size): target added."""
    ranked = running_sums(sources, [F.col("source").isNull(), "source"], {"place": F.lit(1)})
    turn = F.array(*map(F.lit, weights))
    ranked = ranked.withColumn("w", F.get(turn, ((F.col("place") - 1) % len(weights)).cast("int")).cast("long")).withColumn(
        "cap", copies * F.col("source_size")
    )
    ranked = cut(ranked)
    whole = ranked.agg(F.sum("source_size").alias("words"), F.sum("w").alias("w")).first()
    if whole["w"] is None:
        return ranked.select("source", "source_size", F.lit(0.0).alias("target"))
    # sources that reach their cap come first
    filled = running_sums(ranked, [F.col("cap") / F.col("w"), "place"], {"caps": F.col("cap"), "ws": F.col("w")})
    left = F.lit(share * whole["words"]) - (F.col("caps") - F.col("cap"))
    level = left / (F.lit(whole["w"]) - (F.col("ws") - F.col("w")))
    open_ = filled.withColumn("level", level).where(F.col("level") * F.col("w") <= F.col("cap"))
    first = open_.agg(F.min(F.struct((F.col("cap") / F.col("w")).alias("r"), "place", "level"))["level"]).first()[0]
    target = F.col("cap").cast("double") if first is None else F.least(F.lit(first) * F.col("w"), F.col("cap").cast("double"))
    return ranked.select("source", "source_size", target.alias("target"))


def expected_copies(classes: DataFrame, copies: int = COPIES) -> DataFrame:
    """From (source, weight, words, target): whole (certain copies) and p (the
    fraction left), such that whole + p copies of all words make the target."""
    own = Window.partitionBy("source")
    down = own.orderBy(F.desc("weight")).rowsBetween(Window.unboundedPreceding, -1)
    weighted = F.col("weight") * F.col("words")
    above, weighted_above = (F.coalesce(F.sum(c).over(down), F.lit(0)) for c in (F.col("words"), weighted))
    level = F.try_divide(F.col("target") - copies * above, F.sum(weighted).over(own) - weighted_above)
    levels = classes.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= copies, F.struct(-F.col("weight"), "level"))
    c = F.min(fits).over(own)["level"]
    expected = F.coalesce(F.least(c * F.col("weight"), F.lit(float(copies))), F.lit(float(copies)))
    out = levels.withColumn("expected", expected).withColumn("whole", F.floor("expected"))
    return out.select("source", "weight", "words", "target", "whole", (F.col("expected") - F.col("whole")).alias("p"))


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = SOURCE_WEIGHTS,
    share: float = SHARE,
    copies: int = COPIES,
    document_weight: Column | None = None,
    seed: str = "mix",
) -> DataFrame:
    """One row per row of ``df``: id, source, size, source_size, target, taken.

    ``document_weight`` may use the columns ``id``, ``source`` and ``size``; the
    default is ``length_weight``. A document is taken ``taken // size`` times, and
    once more for its first ``taken % size`` words."""
    docs = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    weight = length_weight(F.col("size")) if document_weight is None else document_weight
    key = F.concat_ws(":", F.lit(seed), F.col("id").cast("string"))
    bits = F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("long")  # 52 of them: u is exact and never 0 or 1
    docs = cut(
        docs.withColumn("weight", F.greatest(F.lit(1), F.least(F.lit(WEIGHTS), F.coalesce(weight.cast("int"), F.lit(1)))))
        .withColumn("u", (bits + F.lit(0.5)) / F.lit(float(1 << 52)))
        .withColumn("rid", F.monotonically_increasing_id())
    )
    classes = cut(docs.groupBy("source", "weight").agg(F.sum("size").alias("words")))
    aims = cut(targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, copies))
    same = classes["source"].eqNullSafe(aims["source"])
    planned = cut(expected_copies(classes.join(aims, same).select(classes["source"], "weight", "words", "target"), copies))
    sums = planned.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("whole") * F.col("words")).alias("certain"))
    rest = sums.select("source", F.greatest(F.rint(F.col("target") - F.col("certain")).cast("long"), F.lit(0)).alias("rest"))

    joined = docs.join(planned.drop("words", "target"), docs["source"].eqNullSafe(planned["source"]) & (docs["weight"] == planned["weight"]))
    odds = (F.col("u") * (1 - F.col("p"))) / ((1 - F.col("u")) * F.col("p"))
    ranked = cut(
        joined.select("id", docs["source"], "size", "rid", (F.col("whole") * F.col("size")).alias("certain"), F.when(F.col("p") > 0, odds).alias("odds"))
        .withColumn("v", F.col("odds") / (1 + F.col("odds")))  # in (0, 1), in the order of the odds
        .withColumn("bucket", F.floor(F.col("v") * BUCKETS).cast("int"))
        .drop("odds")
    )
    counted = ranked.where("v is not null").groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = counted.withColumn("before", F.sum("words").over(upto) - F.col("words"))
    filled = counted.join(rest, counted["source"].eqNullSafe(rest["source"])).drop(rest["source"])
    # the last bucket that begins below what is left to fill
    border = filled.where("before < rest").groupBy("source").agg(F.max(F.struct("bucket", "before", "rest")).alias("b"))
    borders = cut(aims.join(border.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").select(*aims.columns, "b.*"))

    known = ranked.withColumnRenamed("bucket", "own").join(borders.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    at_border = F.coalesce(F.col("own") == F.col("bucket"), F.lit(False))
    inner = F.when(F.col("own") < F.col("bucket"), F.col("size")).otherwise(F.lit(0).cast("long"))
    total = lambda extra: (F.col("certain") + extra).cast("long").alias("taken")
    columns = ["id", "source", "size", "source_size", "target"]
    few = running_sums(known.where(at_border), [F.col("source").isNull(), "source", "v", "id", "size", "rid"], {"upto": F.col("size")})
    few = cut(few)
    base = few.groupBy("source").agg(F.min(F.col("upto") - F.col("size")).alias("base")).withColumnRenamed("source", "_s")
    few = few.join(base, few["source"].eqNullSafe(F.col("_s"))).withColumn(
        "extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - (F.col("upto") - F.col("size") - F.col("base"))))
    )
    return known.where(~at_border).select(*columns, total(inner)).unionByName(few.select(*columns, total(F.col("extra"))))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(sha256('mix:' || doc_id::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents
), e AS (SELECT *, length(bin(size)) + 10 AS weight FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (2 * sum(size))::BIGINT AS cap,
    [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w, row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM e GROUP BY source
), a AS (
  SELECT *, cap::DOUBLE / w AS r,
    (1.5::DOUBLE * (SELECT sum(source_size)::BIGINT FROM s) - (sum(cap) OVER o - cap)::BIGINT)
    / ((SELECT sum(w)::BIGINT FROM s) - (sum(w) OVER o - w)::BIGINT)::DOUBLE AS level
  FROM s WINDOW o AS (ORDER BY cap::DOUBLE / w, place ROWS UNBOUNDED PRECEDING)
), t AS (
  SELECT source, source_size,
    least(coalesce((SELECT level FROM a WHERE level * w <= cap ORDER BY r, place LIMIT 1) * w, cap::DOUBLE), cap::DOUBLE) AS target
  FROM s
), c AS (
  SELECT e.source, e.weight, sum(size)::BIGINT AS words, any_value(t.target) AS target, any_value(t.source_size) AS source_size
  FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source GROUP BY e.source, e.weight
), l AS (
  SELECT *, (target - 2 * (sum(words) OVER o - words)::BIGINT)
    / nullif((sum(weight * words) OVER (PARTITION BY source) - (sum(weight * words) OVER o - weight * words))::DOUBLE, 0) AS level
  FROM c WINDOW o AS (PARTITION BY source ORDER BY weight DESC ROWS UNBOUNDED PRECEDING)
), k AS (
  SELECT *, coalesce(least(max_by(level, weight) FILTER (level * weight <= 2) OVER (PARTITION BY source) * weight, 2.0::DOUBLE), 2.0::DOUBLE) AS expected FROM l
), p AS (SELECT *, floor(expected) AS whole, expected - floor(expected) AS p FROM k),
f AS (
  SELECT source, greatest(round_even(any_value(target) - sum(whole * words), 0)::BIGINT, 0) AS rest FROM p GROUP BY source
), q AS (
  SELECT e.doc_id, e.size, p.source_size, p.target, (p.whole * e.size)::BIGINT AS certain, f.rest, e.source,
    CASE WHEN p.p > 0 THEN (e.u * (1 - p.p)) / ((1 - e.u) * p.p) END AS odds
  FROM e JOIN p ON e.source IS NOT DISTINCT FROM p.source AND e.weight = p.weight JOIN f ON e.source IS NOT DISTINCT FROM f.source
), v AS (
  SELECT *, sum(CASE WHEN odds IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY odds / (1 + odds) NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM q
)
SELECT doc_id, size, source_size, target,
  (certain + CASE WHEN odds IS NULL THEN 0 ELSE greatest(0, least(size, rest - (upto - size))) END)::BIGINT AS taken
FROM v
"""
