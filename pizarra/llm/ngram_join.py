"""Grouped prefix join on word n-grams (Jaccard similarity).

1. A counting sketch of fixed size over all documents' shingles gives one order
   of shingles for everybody: rare first, ties by hash. Any common order gives
   the same result; a good one keeps shingles that many documents share out of
   the prefixes.
2. A document's prefix is its first ``n - ceil(t n) + SHARED`` shingles; two
   similar documents share at least ``SHARED`` of them (or all they must have in
   common, if that is less). Documents with identical prefix and size become
   one group, and only groups go on.
3. Groups that hold the same prefix shingle and may be similar by size fall
   into a cell (shingle, size band). Cells of up to ``CELL`` groups give pairs
   (at most ``CELL`` / 2 a group), which are filtered by how many shingles they
   share; those left are joined to families by their components. A larger cell
   is a family as it stands, named by its first group: a row per group, no
   pairs. A pair that meets in a larger cell is in that family, so the counts
   of the others are complete.
4. Families are expanded to their members (documents with equal shingle sets
   count once) and verified exactly, by counting common shingles. A family of up to
   ``BLOCK`` members is one task. In a larger one each member is compared with one
   of median size first, and only those that do not link with it are compared with
   the others, block by block: the work grows with the members of a family of near
   copies, and with the square of their number only where they are unlike. Of the
   links found a task returns a spanning forest, which loses no component.
5. Components of the links come from star joins.

Sets are compared by 64-bit shingle hashes.

Scale: what crosses the network is the prefixes of the groups, the family rows
and the texts of family members (once, but for those that are compared block by
block), picked by a bitmap of bounded size. Copies collapse map-side; a family is
split over blocks of ``BLOCK`` members, so no task sees more than two blocks.

Nulls and edge cases: null or empty texts, or texts without words, have no
shingle and link with nothing (their component is their own id); a text shorter
than n words is one shingle. Repeated rows are documents of their own and link
with each other. The smallest id ignores nulls unless the component has no
other. Only id and text are read by the digest; ``near_dedup_keep`` returns all
columns. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pizarra.llm.common import cut, handed_on, release, table, with_row_id
from pizarra.llm.components import components
from pizarra.llm.suffix_dedup import taking_part

#: Counters of the sketch (a power of two); its size does not grow with the data.
SKETCH = 1 << 18
#: Prefix shingles that a pair must share, and groups of a cell that gives pairs.
SHARED, CELL = 5, 16
#: Members, and their shingles, in a block of a family (on average).
BLOCK, BLOCK_SHINGLES = 768, 2_000_000
#: Shingles that are counted at a time when members are compared.
TILE = 1024
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX[2]
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text; a text of
    fewer words has one, of all its words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # A-Z only; bytes 09-0D and 20 separate
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(n, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = _scramble(out * _MIX[0] + hashes[i : len(words) - width + 1 + i] * _MIX[1])
    return np.unique(out)


def prefix_size(n: int, percent: int) -> int:
    """Shingles of which two similar sets must share ``SHARED``."""
    return min(n, n - -(-n * percent // 100) + SHARED)


def _counter(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - int(math.log2(SKETCH)))).astype(np.int64)


def sketch(docs: DataFrame, n: int) -> np.ndarray:
    """How many documents' shingles fall on each counter, over all rows."""

    def run(batches):
        handed_on()
        counts = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(counts, _counter(shingles(text.as_py(), n)), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["at", "n"])

    total = np.zeros(SKETCH, np.int64)
    counts = docs.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most SKETCH rows
    total[counts["at"].to_numpy()] = counts["n"].to_numpy()
    return total


def sized(docs: DataFrame, order: np.ndarray, n: int, percent: int) -> DataFrame:
    """Per document (rid, id): n (set size), set (digest of the shingles),
    grp (digest of prefix and size), prefix (its shingles, in common order)."""

    def run(batches):
        handed_on()
        for batch in batches:
            size, whole, group, prefix = [], [], [], []
            for text in batch.column("text"):
                h = shingles(text.as_py(), n)
                k = prefix_size(len(h), percent)
                head = h[np.lexsort((h, order[_counter(h)]))[:k]].astype("<u8")
                size.append(len(h))
                whole.append(xxhash.xxh3_128_digest(h.tobytes()))
                group.append(xxhash.xxh3_128_digest(head.tobytes() + len(h).to_bytes(8, "little")))
                prefix.append(head.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("id"), pa.array(size, pa.int64()), *(pa.array(c, pa.binary()) for c in (whole, group, prefix))],
                names=["rid", "id", "n", "set", "grp", "prefix"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("rid", "id", "text").mapInArrow(run, f"rid long, id {kind}, n long, set binary, grp binary, prefix binary")


def _bands(n: np.ndarray, percent: int) -> np.ndarray:
    """Size bands a little wider than the largest ratio of similar sizes, so
    that similar sets lie in the same band or in adjacent ones."""
    return (np.log(n) * (0.999 / -math.log(percent / 100))).astype(np.int64)


def _small(token: np.ndarray, size: np.ndarray, group: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """Pairs (a, b, how many they must share) among the rows of each token, sizes
    ascending. One step per distance between two rows, all tokens at once."""
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
    for step in range(1, CELL):
        x = np.flatnonzero(token[step:] == token[:-step]) if len(token) > step else np.zeros(0, np.int64)
        x = x[100 * size[x] >= percent * size[x + step]]
        if not len(x):
            break
        both = size[x] + size[x + step]
        need = np.minimum(SHARED, -(-percent * both // (100 + percent)))
        out.append((group[x], group[x + step], need))
    return tuple(np.concatenate(c) for c in zip(*out))


def candidates(groups: DataFrame, percent: int) -> DataFrame:
    """From groups (grp_id, n, prefix): rows (a, b, need, band). With ``need`` a
    pair that shares a prefix shingle; without, b is in the family (a, band)."""

    def tokens(batches):
        for batch in batches:
            packed = [np.frombuffer(p.as_py(), "<u8") for p in batch.column("prefix")]
            lengths = np.array([len(p) for p in packed], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([*packed, np.zeros(0, np.uint64)]).view(np.int64)),
                    *(pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), lengths)) for c in ("grp_id", "n")),
                ],
                names=["token", "grp_id", "n"],
            )

    def frame(a, b, need, band):
        return pa.RecordBatch.from_arrays(
            [pa.array(a), pa.array(b), pa.array(need, pa.int32()), pa.array(band, pa.int32())], names=["a", "b", "need", "band"]
        )

    def pairs(token, size, group):
        a, b, need = _small(token, size, group, percent)
        return frame(a, b, need, pa.nulls(len(a), pa.int32()))

    def cells(token, size, group):
        """Whole or part of the rows of larger tokens: a cell is one band of
        sizes and the next, named by the first row of the first band."""
        band = _bands(size, percent)
        first = np.concatenate(([True], (token[1:] != token[:-1]) | (band[1:] != band[:-1])))
        starts = np.flatnonzero(first)
        run = np.cumsum(first) - 1
        length = np.diff(np.append(starts, len(token)))
        # whether the next run is the next band of the same token
        follows = np.append((token[starts[1:]] == token[starts[:-1]]) & (band[starts[1:]] == band[starts[:-1]] + 1), False)
        own = (length + np.append(length[1:], 0) * follows > 1)[run]
        after = np.append(False, follows[:-1])[run]
        before = starts[np.maximum(run - 1, 0)]
        a = np.concatenate((group[starts[run[own]]], group[before[after]]))
        return frame(a, np.concatenate((group[own], group[after])), pa.nulls(len(a), pa.int32()), np.concatenate((band[own], band[after] - 1))), starts[-2:]

    def run(batches):
        """Rows arrive sorted by token, then size. The last token of a batch is
        held back while it has few rows; of a long one, only the first rows of
        its last two bands have to go on."""
        empty = [np.zeros(0, np.int64)] * 3
        held, long = empty, None
        for batch in batches:
            rows = [np.concatenate((c, batch.column(x).to_numpy())) for c, x in zip(held, ("token", "n", "grp_id"))]
            token = rows[0]
            if not len(token):
                continue
            edges = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            counts = np.diff(np.append(edges, len(token)))
            large = (counts > CELL) | (token[edges] == long if long is not None else False)
            whole = np.repeat(large, counts)
            open_ = np.arange(len(token)) >= edges[-1]  # rows of the token that may go on
            small = ~whole & ~open_
            if small.any():
                yield pairs(*(c[small] for c in rows))
            if whole.any():
                out, last = cells(*(c[whole] for c in rows))
                yield out
            if large[-1]:
                at = np.flatnonzero(whole)[last]
                at = at[token[at] == token[-1]]
                held, long = [c[at] for c in rows], token[-1]
            else:
                held, long = [c[open_] for c in rows], None
        if len(held[0]) and long is None:
            yield pairs(*held)

    rows = groups.select("grp_id", "n", "prefix").mapInArrow(tokens, "token long, grp_id long, n long")
    sorted_rows = rows.select("token", "n", "grp_id").repartition("token").sortWithinPartitions("token", "n", "grp_id")
    return sorted_rows.mapInArrow(run, "a long, b long, need int, band int")


def families(groups: DataFrame, percent: int) -> DataFrame:
    """(family, band, grp_id): each pair that may be similar meets in one."""
    found = candidates(groups, percent).groupBy("a", "b", "need", "band").agg(F.count("*").alias("k"))
    found = cut(found.where("need is null or k >= need"))
    joined = components(found.where("need is not null").select("a", "b"))
    return (
        found.where("need is null")
        .select(F.col("a").alias("family"), "band", F.col("b").alias("grp_id"))
        .unionByName(joined.select(F.col("root").alias("family"), F.lit(-3).alias("band"), F.col("node").alias("grp_id")))
    )


def _links(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning forest of the similar pairs among ``sets`` (exact); with ``side``,
    of pairs of different sides only. One matrix of counts is held, filled from
    ``TILE`` shingles at a time."""
    m = len(sets)
    lengths = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(m, dtype=np.int32), lengths)
    ids = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)[1].astype(np.int32)
    shared = np.bincount(ids)[ids] > 1  # a shingle of one member only is common to none
    owner, ids = owner[shared], np.unique(ids[shared], return_inverse=True)[1].astype(np.int32)
    order = np.argsort(ids, kind="stable")
    owner, ids = owner[order], ids[order]
    common = np.zeros((m, m), np.float32)
    total = int(ids[-1]) + 1 if len(ids) else 0
    for first in range(0, total, TILE):
        s, e = np.searchsorted(ids, (first, first + TILE))
        grid = np.zeros((m, min(TILE, total - first)), np.float32)
        grid[owner[s:e], ids[s:e] - first] = 1
        common += grid @ grid.T
    out, seen = [], np.zeros(m, bool)
    for root in range(m):
        if seen[root]:
            continue
        seen[root] = True
        stack = [root]
        while stack:
            x = stack.pop()
            inter = np.rint(common[x]).astype(np.int64)
            linked = (100 * inter >= percent * (lengths[x] + lengths - inter)) & (inter > 0) & ~seen
            if side is not None:
                linked &= side != side[x]
            for y in np.flatnonzero(linked).tolist():
                seen[y] = True
                out.append((x, y))
                stack.append(y)
    return out


def _star(sets: list[np.ndarray], centre: int, percent: int) -> list[tuple[int, int]]:
    """The links of one set with the others."""
    out, middle = [], sets[centre]
    for k, s in enumerate(sets):
        if k != centre and len(s) and len(middle):
            inter = len(np.intersect1d(s, middle, assume_unique=True))
            if inter and 100 * inter >= percent * (len(s) + len(middle) - inter):
                out.append((centre, k))
    return out


#: What a cell compares: all its rows; rows of different sides; all with the one of side 1.
ALL, ACROSS, STAR = 0, 1, 2
CELL_KEY = ["family", "band", "kind", "lo", "hi"]


def verified(members: DataFrame, n: int, percent: int) -> DataFrame:
    """From members (family, band, kind, lo, hi, side, rid, text): links (a, b) of rids."""

    def run(key, rows):
        rids, side, kind = rows.column("rid").to_numpy(), rows.column("side").to_numpy(), key[2].as_py()
        sets = [shingles(t.as_py(), n) for t in rows.column("text")]
        if kind == STAR:
            found = _star(sets, int(side.argmax()), percent)
        else:
            found = _links(sets, percent, side if kind == ACROSS else None)
        pairs = np.array([(rids[x], rids[y]) for x, y in found], np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return members.groupBy(*CELL_KEY).applyInArrow(run, "a long, b long")


def _cells(rows: DataFrame, kind: int, side: int, lo: Column, hi: Column) -> DataFrame:
    placed = rows.select("family", "band", F.lit(kind).alias("kind"), lo.cast("long").alias("lo"), hi.alias("hi"), F.lit(side).alias("side"), "rid")
    return placed.withColumn("hi", F.col("hi").cast("long"))


def _counted(rows: DataFrame, name: str) -> DataFrame:
    """Blocks of a family's rows (family, band, ``name``)."""
    parts = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES))
    return rows.groupBy("family", "band").agg(parts.cast("long").alias(name))


def _block(count: str) -> Column:
    return F.pmod(F.xxhash64("rid"), F.col(count))


def _every(count: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))


def member_links(docs: DataFrame, expanded: DataFrame, n: int, percent: int) -> DataFrame:
    """From docs (rid, text) and families (family, band, rid, n): links (a, b)."""
    key = ["family", "band"]
    median = F.percentile_approx("n", 0.5).alias("median")
    sizes = cut(_counted(expanded, "blocks").join(expanded.groupBy(*key).agg(F.count("*").alias("members"), median), key).where("members > 1"))
    zero = F.lit(0)
    small = cut(expanded.join(sizes.where("blocks = 1").select(*key), key))
    large = cut(expanded.join(sizes.where("blocks > 1"), key))
    links = cut(verified(_cells(small, ALL, 0, zero, zero).join(taking_part(docs, small), "rid"), n, percent))
    release(docs.sparkSession)
    if large.isEmpty():
        return links
    # one member of median size is compared with all others
    centre = cut(large.where("n = median").groupBy(*key, "blocks").agg(F.min("rid").alias("rid")))
    others = large.join(centre.select("rid", *key), ["rid", *key], "left_anti")
    star = _cells(others, STAR, 0, _block("blocks"), zero).unionByName(
        _cells(centre.select("*", _every("blocks").alias("lo")), STAR, 1, F.col("lo"), zero)
    )
    found = cut(verified(star.join(taking_part(docs, large), "rid"), n, percent))
    release(docs.sparkSession)
    # what does not link with it is compared with everything else
    near = found.select(F.col("b").alias("rid"), F.col("a").alias("centre")).distinct()
    known = near.join(centre.select(*key, F.col("rid").alias("centre")), "centre").select("rid", *key)
    rest = cut(others.join(known, ["rid", *key], "left_anti").select(*key, "rid", "n"))
    if rest.isEmpty():
        return links.unionByName(found)
    linked = cut(large.join(rest.select("rid", *key), ["rid", *key], "left_anti").select(*key, "rid", "n"))
    counts = cut(_counted(rest, "r").join(_counted(linked, "l"), key))
    rest, linked = cut(rest.join(counts, key)), cut(linked.join(counts, key))
    texts = taking_part(docs, rest.select("rid").unionByName(linked.select("rid")))
    own, other = _block("r"), F.col("other")
    among = rest.withColumn("own", own).withColumn("other", _every("r")).where("r = 1 or own <> other")
    cells = (
        _cells(among, ALL, 0, F.least("own", "other"), F.greatest("own", other))
        .unionByName(_cells(rest.select("*", own.alias("lo"), _every("l").alias("hi")), ACROSS, 0, F.col("lo"), F.col("hi")))
        .unionByName(_cells(linked.select("*", _every("r").alias("lo"), _block("l").alias("hi")), ACROSS, 1, F.col("lo"), F.col("hi")))
    )
    return links.unionByName(found).unionByName(cut(verified(cells.join(texts, "rid"), n, percent)))


def near_links(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """From docs (rid, id, text): documents (rid, id, n, rep), rep being the
    first row with the same shingle set, and the links (a, b) among reps."""
    order = sketch(docs, n)
    full = sized(docs, order, n, percent)
    full = cut(full)
    plain = full.drop("prefix")
    # tables that rows of hot keys are joined to are cut, so that Spark can split those
    classes = cut(plain.where("n > 0").groupBy("set").agg(F.min("rid").alias("rep")))
    groups = full.where("n > 0").groupBy("grp").agg(F.min("rid").alias("grp_id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    found = cut(families(groups, percent))
    release(docs.sparkSession)
    # members: one row per distinct set of a group
    sets = cut(
        plain.where("n > 0").groupBy("grp", "set").agg(F.min("rid").alias("rid"), F.first("n").alias("n")).join(
            plain.where("n > 0").groupBy("grp").agg(F.min("rid").alias("grp_id")), "grp"
        ).select("grp_id", "rid", "n")
    )
    several = sets.groupBy("grp_id").agg(F.count("*").alias("k")).where("k > 1")
    alone = several.select(F.col("grp_id").alias("family"), F.lit(-2).alias("band"), "grp_id")
    expanded = cut(found.unionByName(alone).join(sets, "grp_id").select("family", "band", "rid", "n"))
    links = member_links(docs, expanded, n, percent)
    return plain.join(classes, "set", "left").select("rid", "id", "n", "rep"), links


def _near_groups(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """From docs (rid, id, text): the rows that ``near_groups`` gives."""
    documents, links = near_links(docs, n, percent)
    roots = components(links)
    labelled = documents.join(roots, documents["rep"] == roots["node"], "left").select(
        "rid", "id", "n", F.coalesce("root", "rep", "rid").alias("root")
    )
    smallest = F.min(F.struct(F.col("id").isNull(), "id", "rid")).alias("first")
    first = cut(labelled.groupBy("root").agg(F.min("id").alias("component_id"), smallest))
    return labelled.join(first, "root").select(
        "rid", "id", F.col("n").alias("n_shingles"), "component_id", (F.col("rid") == F.col("first.rid")).alias("stays")
    )


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of ``df``: rid, id, n_shingles, component_id (smallest id
    reachable by links) and stays (whether the row is the one with that id)."""
    return _near_groups(with_row_id(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "rid"), n, percent)


def near_dedup_keep(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """One row of each component (that with the smallest id), with all columns."""
    names = df.columns
    inner = with_row_id(df.toDF(*(f"c{i}" for i in range(len(names)))), "rid")
    id_, text = (F.col(f"c{names.index(c)}").alias(name) for c, name in ((id_col, "id"), (text_col, "text")))
    dropped = _near_groups(inner.select("rid", id_, text), n, percent).where(~F.col("stays")).select("rid")
    return inner.join(dropped, "rid", "left_anti").drop("rid").toDF(*names)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
