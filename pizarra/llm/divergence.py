"""Source divergence audit by iceberg prefix refinement.

Which terms, and which other sources, set a source apart within its language.

1. Level by level, a pass over all texts counts, per (lang, source), the distinct
   documents of the terms' first ``P`` bytes (``P`` = 8, 32, 128, ...). A term shorter
   than ``P`` is complete, and its row holds its exact counts. Prefixes of fewer
   than ``threshold`` documents of their language are discarded, as no term that
   begins with them can reach it; the next level extends the others only. It ends
   when no prefix is left to extend.
2. What is kept gives exact integer shares of ``UNIT`` and, from them, the two
   reports. For pairs of sources only the terms that a source really has are
   gone through: with f00 for a term that neither has, the sum over all kept terms
   is V f00 plus corrections of either source (by its distinct counts) and of the
   terms both have.

The next pass leaves discarded prefixes out by a bitmap of hashes, 16 bits for
each live prefix and at most ``FILTER_BITS`` (16 MiB, the bound of what is sent to
the executors). It only saves work: a prefix that slips through is counted again
and discarded by its own count.

Scale: texts never leave their task; counts are combined per slice of up to
``HELD`` texts and ``SLICE_BYTES`` (split, coded and counted as Arrow and numpy columns), so a source with a
third of all rows and a term in every document are one row per slice. What is shuffled, once a level, grows
with the vocabulary. A row per ordered pair of
sources of a language is the result itself; a term meets at most the sources of
its language.

Nulls and edge cases: null text, lang and source are ''. Repeated rows, also of one
id, are documents of their own. Ties in rank go by the item's UTF-8 bytes. A group
without kept terms has N = 0; a language without any gives pairs of value 0. An
empty table gives no rows. Only text, lang and source are read, whole texts as
UTF-8 bytes, whatever their length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pizarra.llm.common import bitmap, cut, handed_on, table

#: Bytes of the first level's prefixes, and how many times longer the next level's are.
FIRST, GROWTH = 8, 4
#: Texts that are counted together, and their bytes.
HELD, SLICE_BYTES = 20_000, 1 << 24
FILTER_BITS = 1 << 27
#: Bytes of terms, A-Z lower-cased; every other byte is a blank.
TERM_BYTES = bytes(c if c >= 0x80 or chr(c).islower() else ord(chr(c).lower()) if chr(c).isupper() else 0x20 for c in range(256))
UNIT = 1_000_000_000


def _place(lang: Column, key: Column, bits: int) -> Column:
    return F.crc32(F.concat(lang.cast("binary"), F.lit(b"\0"), key)).bitwiseAND(F.lit(bits - 1))


def live_filter(live: DataFrame) -> tuple[bytes, int]:
    """Bitmap of the hashes of the live prefixes (lang, key), and its bits."""
    return bitmap(live, lambda bits: _place(F.col("lang"), F.col("key"), bits), FILTER_BITS)


def _ends(texts: pa.Array) -> np.ndarray:
    """Where the texts of a large binary array start in its data, and the last ends."""
    return np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)


def _terms(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """All terms of a slice of texts, A-Z lower-cased, and which text each is of."""
    ends = _ends(texts)
    data = texts.buffers()[2]
    data = bytes(memoryview(data)[ends[0] : ends[-1]] if data is not None else b"").translate(TERM_BYTES)
    plain = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends - ends[0]), pa.py_buffer(data)])
    split = pc.split_pattern(plain, b" ")
    row = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    parts = pc.list_flatten(split)
    full = pc.binary_length(parts).to_numpy() > 0
    return row[full], parts.filter(pa.array(full))


def _parts(texts: pa.Array) -> list[tuple[int, int]]:
    """Slices of up to ``HELD`` texts and ``SLICE_BYTES``; a longer text is a slice of its own."""
    ends, start, out = _ends(texts), 0, []
    while start < len(texts):
        stop = min(max(int(np.searchsorted(ends, ends[start] + SLICE_BYTES, side="right")) - 1, start + 1), start + HELD)
        out.append((start, stop))
        start = stop
    return out


def count_prefixes(docs: DataFrame, settled: int, size: int, live=None, bits: int = 0) -> DataFrame:
    """One level: (lang, source, key, docs, n). Keys are the first ``size`` bytes of
    terms of ``settled`` bytes and more whose prefix of that length is live. Shorter
    keys are complete terms, counted per source; prefixes are counted per language
    (source null, n 0), which is all that decides about them."""
    names = ["lang", "source", "key", "docs", "n"]

    def alive(bitmap, langs, lang, row, terms):
        """Whether the prefix of each term is live: looked up once for each prefix
        and language of the slice."""
        coded = pc.binary_slice(terms, 0, settled).dictionary_encode()
        pairs = lang[row] * len(coded.dictionary) + coded.indices.to_numpy()
        distinct = np.unique(pairs)
        starts = [zlib.crc32(x.encode("utf-8", "surrogatepass") + b"\0") for x in langs]
        prefixes = coded.dictionary.to_pylist()
        which, prefix = (x.tolist() for x in np.divmod(distinct, max(1, len(prefixes))))
        place = np.array([zlib.crc32(prefixes[k], starts[x]) for x, k in zip(which, prefix)], np.int64) & (bits - 1)
        return (bitmap[place >> 3] >> (place & 7) & 1).astype(bool)[np.searchsorted(distinct, pairs)]

    def counted(texts, lang, langs, group, groups, bitmap):
        row, terms = _terms(texts)
        if bitmap is not None:
            long = pc.binary_length(terms).to_numpy() >= settled
            row, terms = row[long], terms.filter(pa.array(long))
            on = alive(bitmap, langs, lang, row, terms)
            row, terms = row[on], terms.filter(pa.array(on))
        coded = pc.binary_slice(terms, 0, size).dictionary_encode()
        keys = coded.dictionary
        del terms
        wide = max(1, len(keys))
        # once for each text and key, with its occurrences there
        pairs, times = np.unique(row * wide + coded.indices.to_numpy(), return_counts=True)
        row, key = np.divmod(pairs, wide)
        whole = pc.binary_length(keys).to_numpy()[key] < size
        # places: the groups (lang, source), then the languages
        place = np.where(whole, group[row], len(groups) + lang[row]) * wide + key
        order = np.argsort(place)
        place, times = place[order], np.where(whole, times, 0)[order]
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, np.int64)
        n = np.add.reduceat(times, first) if len(first) else np.zeros(0, np.int64)
        at, key = np.divmod(place[first], wide)
        of = [pa.array([*(g[k] for g in groups), *(x if k == 0 else None for x in langs)], pa.string()) for k in (0, 1)]
        columns = [*(c.take(pa.array(at)) for c in of), keys.take(pa.array(key)).cast(pa.binary()), pa.array(np.diff(np.append(first, len(place)))), pa.array(n)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches):
        handed_on()
        bitmap = np.frombuffer(live.value, np.uint8) if live is not None else None
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("text").cast(pa.large_binary())
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for start, stop in _parts(texts):
                of_group, of_lang = {}, {}
                group = np.array([of_group.setdefault(g, len(of_group)) for g in zip(langs[start:stop], sources[start:stop])], np.int64)
                lang = np.array([of_lang.setdefault(x, len(of_lang)) for x in langs[start:stop]], np.int64)
                yield counted(texts.slice(start, stop - start), lang, list(of_lang), group, list(of_group), bitmap)
                pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, "lang string, source string, key binary, docs long, n long")


def kept_terms(docs: DataFrame, threshold: int = 3, first: int = FIRST) -> DataFrame:
    """From (text binary, lang, source): (lang, source, term, n) for the terms that
    at least ``threshold`` documents of their language hold."""
    out, settled, size, live, bits = None, 0, first, None, 0
    # at most a row per source; keys first, as Spark sorts by the leading bytes of the first column
    whole = Window.partitionBy("key", "lang")
    while True:
        # dealt once: the counts and the window find a key's rows in one place
        dealt = count_prefixes(docs, settled, size, live, bits).repartition("key", "lang")
        counted = dealt.groupBy("lang", "source", "key").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
        level = cut(counted.withColumn("all", F.sum("docs").over(whole)).where(F.col("all") >= threshold).drop("all"))
        if live is not None:
            live.destroy()
        terms = level.where(F.octet_length("key") < size).select("lang", "source", F.col("key").cast("string").alias("term"), "n")
        out = terms if out is None else out.unionByName(terms)
        left = level.where(F.octet_length("key") == size).select("lang", "key")
        if left.isEmpty():
            return out
        packed, bits = live_filter(left)
        live = docs.sparkSession.sparkContext.broadcast(packed)
        settled, size = size, GROWTH * size


def _share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(UNIT (n + 1) / (total + V)), in exact decimals."""
    whole = F.call_function("div", (F.lit(UNIT).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)")), (total + v).cast("decimal(19,0)"))
    return F.lit(1).cast("long") + whole


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); the square of two shares fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", threshold: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows for every other source
    of the language, ``term`` rows for the ``top`` terms that set the source apart."""
    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))]
    docs = df.select(*plain).withColumn("text", F.col("text").cast("binary"))
    counts = kept_terms(docs, threshold)
    terms = cut(counts.groupBy("term", "lang").agg(F.sum("n").alias("n")))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("total"))
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("has"))
    zero = F.lit(0).cast("long")
    groups = cut(
        docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs.select("lang", "v"), "lang", "left").select(
            "lang", "source", F.coalesce("v", zero).alias("v"), F.coalesce("total", zero).alias("total")
        )
    )
    # the share of a term that the group lacks; none is asked for where V = 0
    groups = groups.withColumn("p0", F.when(F.col("v") > 0, _share(F.lit(0), F.col("total"), F.col("v"))))
    held = counts.join(groups, ["lang", "source"])
    held = cut(held.select("lang", "source", "term", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"), "p0"))

    whole = terms.join(langs, "lang").select("lang", "term", _share(F.col("n"), F.col("total"), F.col("v")).alias("q"))
    report = held.join(whole, ["term", "lang"]).where("p > q").select("lang", "source", F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    ranks = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    report = report.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= top)

    left = groups.select("lang", "source", "v", F.col("p0").alias("a0"))
    right = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("b0"))
    pairs = cut(left.join(right, "lang").where("source <> item"))
    f00 = _gap(F.col("a0"), F.col("b0"))
    base = pairs.select("lang", "source", "item", F.when(F.col("v") > 0, F.col("v") * f00).otherwise(zero).alias("value"))
    distinct = cut(held.groupBy("lang", "source", "p").agg(F.count("*").alias("k")))
    mine = distinct.join(pairs, ["lang", "source"]).select("lang", "source", "item", (F.col("k") * (_gap(F.col("p"), F.col("b0")) - f00)).alias("value"))
    theirs = distinct.withColumnRenamed("source", "item").join(pairs, ["lang", "item"]).select(
        "lang", "source", "item", (F.col("k") * (_gap(F.col("a0"), F.col("p")) - f00)).alias("value")
    )
    a = held.select("lang", "term", "source", "p", F.col("p0").alias("a0"))
    b = held.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("b0"))

    def both_have(p, q, a0, b0):
        return _gap(p, q) - _gap(p, b0) - _gap(a0, q) + _gap(a0, b0)

    # each pair of sources once, both directions from it
    p, q, a0, b0 = (F.col(c) for c in ("p", "q", "a0", "b0"))
    met = a.join(b, ["term", "lang"]).where("source < item").groupBy("lang", "source", "item").agg(
        F.sum(both_have(p, q, a0, b0)).alias("forth"), F.sum(both_have(q, p, b0, a0)).alias("back")
    )
    met = cut(met)
    both = met.select("lang", "source", "item", F.col("forth").alias("value")).unionByName(
        met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value"))
    )
    sums = base.unionByName(mine).unionByName(theirs).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sums = sums.withColumn("rank", F.row_number().over(ranks))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return columns(sums, "pair").unionByName(columns(report, "term"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), w AS (SELECT rid, lang, source, unnest(words) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang),
ng AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY lang, source),
nl AS (SELECT lang, sum(n)::HUGEINT AS total FROM c GROUP BY lang),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(ng.total, 0) + v.v) AS p
  FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang LEFT JOIN ng ON ng.lang = g.lang AND ng.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c.n)::HUGEINT + 1)) // (any_value(nl.total) + any_value(v.v)) AS q
  FROM c JOIN nl USING (lang) JOIN v USING (lang) GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
), f AS (
  SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p)::BIGINT AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source
), t AS (
  SELECT p.lang, p.source, p.term AS item, (((p.p - q.q) * (p.p - q.q)) // q.q)::BIGINT AS value
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q
), r AS (
  SELECT pairs.lang, pairs.source, 'pair' AS part, pairs.item, coalesce(f.value, 0)::BIGINT AS value
  FROM pairs LEFT JOIN f ON f.lang = pairs.lang AND f.source = pairs.source AND f.item = pairs.item
  UNION ALL SELECT lang, source, 'term', item, value FROM t
), n AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM n WHERE part = 'pair' OR rank <= 200
"""
