"""Packing token sequences by non-negative least squares on length histograms.

Each document's ids (and an end id) are cut at multiples of the window; the
last piece is shorter. Pieces are counted by size: lengths from ``SHORT`` steps on
are rounded up to a step of ``window / BINS`` tokens, shorter ones are themselves,
as rounding would waste much of them. On the driver, which sees only that
histogram (at most ``BINS + SHORT * window / BINS`` rows), all combinations of up to
three rounded lengths that fill a window exactly are enumerated and their repeat
counts solved for by non-negative least squares, rounded, and what is left, short
pieces included, is packed greedily, largest first. The plan (combinations with
repeat counts, its size bounded by the histogram's) is sent back as ranges of
ranks: each piece finds its sequence from its rank among those of its size, by
binary search.

Ranks are made without gathering a size anywhere: rows are numbered within
(partition, size), and partitions' counts are summed ahead of them, in a join of
tables that are dealt out by just these columns.

Nulls and edge cases: a null text is an empty one, a piece of only the end id;
repeated rows and null ids are packed as documents of their own; an empty table
gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pizarra.llm.bpe import default_vocabulary, encoder
from pizarra.llm.common import cut, table, with_row_id

WINDOW, BINS, END_ID = 4096, 256, 2
#: Steps (of ``window / BINS`` tokens) under which lengths are not rounded.
SHORT = 8


def combinations(total: int) -> list[tuple[int, ...]]:
    """All multisets of one to three bins that sum to ``total``."""
    out = [(total,)]
    out += [(a, total - a) for a in range((total + 1) // 2, total)]
    out += [(a, b, total - a - b) for a in range((total + 2) // 3, total - 1) for b in range((total - a + 1) // 2, min(a, total - a - 1) + 1)]
    return out


def nnls(a: np.ndarray, b: np.ndarray, max_rounds: int | None = None) -> np.ndarray:
    """x >= 0 minimising |a x - b|: active-set method on the normal equations."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-6 * max(1.0, float(np.abs(b).max(initial=0.0)))
    free = np.zeros(0, np.int64)
    for _ in range(max_rounds or 2 * a.shape[0]):
        gain = a.T @ (b - a[:, free] @ x[free])
        gain[used] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= tolerance:
            break
        used[best] = True
        while True:
            free = np.flatnonzero(used)
            part = a[:, free]
            z = np.linalg.solve(part.T @ part + 1e-9 * np.eye(len(free)), part.T @ b)
            if (z > 0).all():
                x[free] = z
                break
            low, old = z <= 0, x[free]
            step = np.min(old[low] / (old[low] - z[low] + 1e-300))
            x[free] = old + step * (z - old)
            gone = free[low & (x[free] <= 1e-9 * max(1.0, float(old.max())))]
            x[gone], used[gone] = 0.0, False
            if not len(gone) or not used.any():
                free = np.flatnonzero(used)
                break
    return x


def plan(histogram: dict[int, int], window: int = WINDOW, bins: int = BINS) -> list[tuple[dict[int, int], int]]:
    """[(size -> pieces per sequence, number of sequences)] using every piece."""
    step = window // bins
    left = np.zeros(window + 1, np.int64)
    for size, n in histogram.items():
        left[size] = n
    out: list[tuple[dict[int, int], int]] = []

    def take(need: dict[int, int], at_most: int) -> None:
        repeats = min(at_most, *(int(left[size]) // m for size, m in need.items()))
        if repeats > 0:
            for size, m in need.items():
                left[size] -= m * repeats
            out.append((need, repeats))

    take({window: 1}, int(left[window]))
    combos = [c for c in combinations(bins) if all(k >= min(SHORT, bins) and left[k * step] for k in c)]
    if combos:
        rounded = left[::step].astype(float)
        rounded[: min(SHORT, bins)] = 0
        a = np.zeros((bins + 1, len(combos)))
        for j, combo in enumerate(combos):
            for k in combo:
                a[k, j] += 1
        counts = nnls(a, rounded)
        for j in np.argsort(-counts, kind="stable"):
            if counts[j] < 0.5:
                break
            take({k * step: combos[j].count(k) for k in combos[j]}, int(np.rint(counts[j])))
    while left.any():
        need, space = {}, window
        for size in np.flatnonzero(left)[::-1].tolist():
            m = min(space // size, int(left[size]))
            if m:
                need[size] = m
                space -= m * size
        take(need, int(left.max()))
    return out


def ranges(packed: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(size, first rank, end rank, pieces per sequence, first slot, first sequence)."""
    rows, used, sequence = [], {}, 0
    for need, repeats in packed:
        slot = 0
        for k, m in sorted(need.items(), reverse=True):
            first = used.get(k, 0)
            used[k] = first + m * repeats
            rows.append((k, first, used[k], m, slot, sequence))
            slot += m
        sequence += repeats
    return rows


PIECES = "_rid long, _id {}, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(df: DataFrame, id_col: str, text_col: str, window: int, end_id: int, path: str) -> DataFrame:
    """Tokenise and cut: one row per piece, without the ids themselves."""
    source = with_row_id(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            rows = []
            for i, found in enumerate(bpe.encode_all(batch.column("_text"))):
                ids = found.tobytes() + end
                n = len(ids) // 4
                rows += [
                    (i, s, min(window, n - s), zlib.crc32(memoryview(ids)[4 * s : 4 * min(s + window, n)]), n) for s in range(0, n, window)
                ]
            at, *columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(at, pa.int64())) for c in ("_rid", "_id")), *(pa.array(c, pa.int64()) for c in columns)],
                names=["_rid", "_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return source.select("_rid", "_id", "_text").mapInArrow(run, PIECES.format(source.schema["_id"].dataType.simpleString()))


def in_sequences(ranked: DataFrame, slots: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """Ranked pieces with sequence_id and _slot (place in the sequence). ``slots``
    are the plan's ranges, whose number the histogram bounds."""
    kind = ranked.schema["_id"].dataType.simpleString()
    order = np.array(sorted(slots), np.int64).reshape(-1, 6)

    def run(batches):
        first = order[:, 0] * (1 << 40) + order[:, 1]  # by size, then rank
        for batch in batches:
            size, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("_size", "_rank"))
            _, start, _, each, slot, sequence = order[np.searchsorted(first, size * (1 << 40) + rank, side="right") - 1].T
            columns = [pa.array(sequence + (rank - start) // each), pa.array(slot + (rank - start) % each)]
            kept = batch.select(["_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *columns], names=[*kept.schema.names, "sequence_id", "_slot"])

    schema = f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, _slot long"
    return ranked.select("_id", "start", "length", "ids_crc32", "doc_tokens", "_size", "_rank").mapInArrow(run, schema)


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    bins: int = BINS,
    end_id: int = END_ID,
    path: str | None = None,
) -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and padded_length of its sequence (the window, or the
    filled length where that is a power of two)."""
    step = window // bins
    rounded = F.ceil(F.col("length") / step).cast("int") * step
    cuts = cut(
        pieces(df, id_col, text_col, window, end_id, path or default_vocabulary())
        .withColumn("_size", F.when(F.col("length") < SHORT * step, F.col("length").cast("int")).otherwise(rounded))
        .withColumn("_part", F.spark_partition_id())
    )
    histogram = {r["_size"]: r["count"] for r in cuts.groupBy("_size").count().collect()}  # at most bins + SHORT * step rows
    before = (
        cuts.groupBy("_size", "_part")
        .count()
        .withColumn("_before", F.sum("count").over(Window.partitionBy("_size").orderBy("_part")) - F.col("count"))
        .select("_size", "_part", "_before")
    )
    local = F.row_number().over(Window.partitionBy("_size", "_part").orderBy("_rid", "start")) - 1
    # pieces are dealt out by these columns already; the other side grows with the partitions, so it is not to be broadcast
    ranked = cuts.withColumn("_local", local).join(before.hint("merge"), ["_size", "_part"])
    placed = in_sequences(ranked.withColumn("_rank", F.col("_before") + F.col("_local")), ranges(plan(histogram, window, bins)))
    within = Window.partitionBy("sequence_id")
    filled = F.sum("length").over(within)
    return placed.select(
        F.col("_id").alias(id_col),
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        "sequence_id",
        (F.sum("length").over(within.orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"),
        F.when(filled.bitwiseAND(filled - 1) == 0, filled).otherwise(F.lit(window).cast("long")).alias("padded_length"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
