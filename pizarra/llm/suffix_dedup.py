"""Removal of long repeated strings by hash-compared suffix sorting.

Every byte covered by a ``LENGTH``-byte string that also starts elsewhere (in
any document) goes. Sorting all suffixes of a corpus in one array is replaced
by sorting those that can matter, in groups that can be dealt out:

1. Anchors: of the ``GRAM``-byte strings in each ``LENGTH``-byte window, the one
   with the smallest hash (the last of equal ones). Equal windows have the same
   anchor at the same place, so a repeated string shows as an anchor string
   that occurs twice. Some 1.3 % of positions are anchors. Each carries a hash
   of its context, the bytes that windows with this anchor can reach.
2. Anchor strings that occur once are dropped. An anchor whose whole context
   occurs twice needs no more work: all of it is repeated.
3. The other contexts with the same anchor string (and one of each repeated
   context) form a group. Their suffixes to the right of the anchor, and the
   reversed prefixes to its left, are merge-sorted: two of them are compared by
   binary search for their common extension on prefix polynomial hashes, so a
   comparison takes logarithmic time; extensions of neighbours are verified on
   the bytes. A window reaching a bytes to the left is repeated if another
   context is in its block of extensions >= a on the left and
   >= ``LENGTH`` - a on the right.
4. The spans found are merged per document and cut out.

Scale: anchors (some 30 bytes each) are counted map-side and joined with a join
that Spark can split at hot strings; the texts of only those documents that
take part go through a shuffle, picked by a bitmap of bounded size. Copies of
whole documents end in step 2 and never form groups. Groups over ``GROUP``
contexts are dealt out over blocks; what is single in its block is compared
with the other blocks by window hash, so nothing is lost and no task gathers a
whole group. What is collected per document are its own spans.

Hashes have 64 bits; a context match rests on two independent ones.

Nulls and edge cases: a null text is an empty one: nothing is removed, the hash
is that of no bytes. Texts shorter than ``LENGTH`` never lose anything. Rows
repeated with one id are documents of their own (each repeats the other). An
empty table gives no rows. Only id and text are read; other columns can't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pizarra.llm.common import bitmap, cut, table, with_row_id

LENGTH, GRAM = 200, 50
#: Contexts of one anchor string that a task sorts together, on average (some
#: 6 kB of working memory each), and contexts of small groups sorted at a time.
GROUP, TOGETHER = 16384, 8192
#: Most bits of the bitmap of documents that take part (16 MiB); it has 16 for each of them up to that.
BITMAP = 1 << 27
#: Texts are scanned in stretches of this many bytes (with overlap).
STRETCH = 1 << 22
_BASE = np.uint64(0xD1342543DE82EF95)
_FINAL = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, base, np.uint64))), dtype=np.uint64)


class Anchors:
    """Anchor positions and hashes of a text."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram
        self.reach = length - gram  # largest distance from window start to anchor
        self._up = self._down = np.ones(0, np.uint64)

    def _hashes(self, raw: np.ndarray) -> np.ndarray:
        """Polynomial hash of every gram, by differences of prefix sums."""
        n = len(raw)
        if n > len(self._up):
            size = max(1 << 12, 1 << (n - 1).bit_length())
            self._up, self._down = _powers(int(_BASE), size), _powers(pow(int(_BASE), -1, 1 << 64), size)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self._up[:n], out=prefix[1:])
        h = (prefix[self.gram :] - prefix[: -self.gram]) * self._down[: n - self.gram + 1] * _FINAL
        return (h ^ (h >> np.uint64(32))) * _FINAL

    def _stretch(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self._hashes(raw)
        n = len(h)
        # smallest hash first, of equal ones the last position
        keys = ((h >> np.uint64(24)) << np.uint64(24)) | (np.uint64(0xFFFFFF) - np.arange(n, dtype=np.uint64))
        wide, span = self.reach + 1, 1
        while span * 2 <= wide:
            keys = np.minimum(keys[:-span], keys[span:])
            span *= 2
        if span < wide:
            keys = np.minimum(keys[: len(keys) - (wide - span)], keys[wide - span :])
        flag = np.zeros(n, bool)
        flag[(np.uint64(0xFFFFFF) - (keys & np.uint64(0xFFFFFF))).astype(np.int64)] = True
        at = np.flatnonzero(flag)
        return at, h[at]

    def __call__(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, gram hashes), positions ascending."""
        n = len(raw)
        if n < self.length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if n <= STRETCH:
            return self._stretch(raw)
        parts = [(s, *self._stretch(raw[s : s + STRETCH])) for s in range(0, n - self.length + 1, STRETCH - self.length + 1)]
        at = np.concatenate([s + a for s, a, _ in parts])
        at, first = np.unique(at, return_index=True)
        return at, np.concatenate([h for _, _, h in parts])[first]


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """From (rid, text): (h, context, rid, at, k, own). Anchors of one document
    with one context are one row: k of them, the first at ``at``; if there are
    several, ``own`` holds the spans they cover (int64 pairs), as each repeats
    the others whatever else the corpus holds."""

    def run(batches):
        find = Anchors(length, gram)
        reach = find.reach
        for batch in batches:
            out = [[] for _ in range(6)]
            for rid, value in zip(batch.column("rid").to_pylist(), batch.column("text")):
                text = (value.as_py() or "").encode("utf-8", "surrogatepass")
                at, h = find(np.frombuffer(text, np.uint8))
                if not len(at):
                    continue
                view, n = memoryview(text), len(text)
                context = np.array(
                    [xxhash.xxh3_64_intdigest(view[max(x - reach, 0) : x + length], min(x, reach) * 1024 + min(n - x, length)) for x in at.tolist()],
                    np.uint64,
                )
                # equal contexts have equal anchor strings
                _, first, inverse, k = np.unique(context, return_index=True, return_inverse=True, return_counts=True)
                if len(first) == len(at):
                    own = [None] * len(at)
                else:
                    own = [None if k[i] == 1 else _covered(at[inverse == i], reach, length, n) for i in range(len(first))]
                for column, cells in zip(out, (h[first], context[first], np.full(len(first), rid, np.int64), at[first], k)):
                    column.append(cells)
                out[5] += own
            columns = [np.concatenate([*c, np.zeros(0, c[0].dtype if c else np.int64)]).astype(np.uint64).view(np.int64) for c in out[:5]]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c) for c in columns), pa.array(out[5], pa.binary())], names=["h", "context", "rid", "at", "k", "own"]
            )

    return docs.select("rid", "text").mapInArrow(run, "h long, context long, rid long, at long, k long, own binary")


def _covered(at: np.ndarray, reach: int, length: int, n: int) -> bytes:
    """The contexts of ascending positions, merged, as packed (start, end) pairs."""
    starts, ends = np.maximum(at - reach, 0), np.minimum(at + length, n)
    new = np.append(True, starts[1:] > ends[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)
    return np.stack((starts[new], ends[last]), axis=1).astype("<i8").tobytes()


def extension(a: np.ndarray, b: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Lengths of the common starts of rows a and b: binary search for the
    last equal prefix hash."""
    low = np.zeros(len(a), np.int64)
    high = np.full(len(a), prefix.shape[1] - 1, np.int64)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high + 1) >> 1
        same = prefix[a, middle] == prefix[b, middle]
        low = np.where(open_ & same, middle, low)
        high = np.where(open_ & ~same, middle - 1, high)


def suffix_order(symbols: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge-sort the rows of ``symbols`` within each group (``group`` is
    ascending). Returns the order and, for each place, the verified extension
    in common with the place before it (0 at the start of a group)."""
    n, width = symbols.shape
    powers = _powers(int(_BASE), width)
    prefix = np.zeros((n, width + 1), np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * powers, axis=1, out=prefix[:, 1:])

    def less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        common = extension(a, b, prefix)
        inside = np.minimum(common, width - 1)
        return np.where(common < width, symbols[a, inside] < symbols[b, inside], a < b)

    order = np.arange(n)
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    first = np.repeat(starts, np.diff(np.append(starts, n)))
    last = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    place = np.arange(n)
    run = 1
    while True:
        within = place - first
        pair = first + within // (2 * run) * (2 * run)
        middle, end = np.minimum(pair + run, last), np.minimum(pair + 2 * run, last)
        work = np.flatnonzero(middle < end)
        if not len(work):
            break
        left = work < middle[work]
        # how many rows of the other run go before: binary search, comparing
        # suffixes by their common extension
        low = np.where(left, middle[work], pair[work])
        high = np.where(left, end[work], middle[work])
        base = low.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            probe = (low[open_] + high[open_]) >> 1
            before = less(order[probe], order[work[open_]])
            low[open_] = np.where(before, probe + 1, low[open_])
            high[open_] = np.where(before, high[open_], probe)
        own = work - np.where(left, pair[work], middle[work])
        merged = order.copy()
        merged[pair[work] + own + (low - base)] = order[work]
        order = merged
        run *= 2
    common = np.zeros(n, np.int64)
    inner = np.flatnonzero(place > first)
    a, b = order[inner - 1], order[inner]
    common[inner] = extension(a, b, prefix)
    # verification: equal up to the extension, different right after it
    differ = symbols[a] != symbols[b]
    exact = np.where(differ.any(1), differ.argmax(1), width)
    if not np.array_equal(exact, common[inner]):
        # a hash collision: sort by the bytes themselves
        order = np.lexsort((*symbols.T[::-1], group))
        a, b = order[inner - 1], order[inner]
        differ = symbols[a] != symbols[b]
        common[inner] = np.where(differ.any(1), differ.argmax(1), width)
    return order, common


def _block_ids(order: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """Per row, the number of its block of rows with extensions >= ``least``."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < least) if least else 0
    return out


def repeated_windows(group: np.ndarray, left: np.ndarray, right: np.ndarray, left_size: np.ndarray, right_size: np.ndarray, length: int):
    """For each a: (rows whose window reaching a to the left is whole, the
    number of its class, class sizes). ``left`` holds the bytes before the
    anchor, reversed; both are padded with 0, bytes being 1 to 256."""
    right_order, right_common = suffix_order(right, group)
    left_order, left_common = suffix_order(left, group)
    for a in range(left.shape[1] + 1):
        rows = np.flatnonzero((left_size >= a) & (right_size >= length - a))
        if not len(rows):
            continue
        r = _block_ids(right_order, right_common, length - a)
        l = _block_ids(left_order, left_common, a) if a else group
        classes, sizes = np.unique((r[rows] << 31) | l[rows], return_inverse=True, return_counts=True)[1:]
        yield a, rows, classes, sizes


CONTEXT = "h long, block long, blocks long, rid long, at long, single boolean, left binary, right binary"
FOUND = "rid long, start long, end long, h long, reach int, window long, n long"


def contexts(members: DataFrame, length: int, gram: int) -> DataFrame:
    """From (rid, text, wanted: array of (at, h, single, blocks)): one row per context."""
    reach = length - gram

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(8)]
            for rid, value, wanted in zip(batch.column("rid").to_pylist(), batch.column("text"), batch.column("wanted").to_pylist()):
                text = (value.as_py() or "").encode("utf-8", "surrogatepass")
                for w in wanted:
                    x = w["at"]
                    row = (
                        w["h"], xxhash.xxh3_64_intdigest(f"{rid}:{x}") % w["blocks"], w["blocks"], rid, x, w["single"],
                        text[max(0, x - reach) : x][::-1], text[x : x + length],
                    )
                    for column, cell in zip(out, row):
                        column.append(cell)
            types = (pa.int64(),) * 5 + (pa.bool_(), pa.binary(), pa.binary())
            names = ["h", "block", "blocks", "rid", "at", "single", "left", "right"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return members.select("rid", "text", "wanted").mapInArrow(run, CONTEXT)


def _padded(values: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(values), width), np.uint16)
    for i, v in enumerate(values):
        out[i, : len(v)] = np.frombuffer(v, np.uint8)
        out[i, : len(v)] += 1
    return out


def compare(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Sort the contexts of each (h, block). Spans of repeated windows have
    start and end; of a group over several blocks also come the classes that
    are single or the first of their block, with a hash of the window."""
    reach = length - gram

    def solve(part: dict[str, list]):
        group = np.unique(np.array([hash(k) for k in zip(part["h"], part["block"])], np.int64), return_inverse=True)[1]
        order = np.argsort(group, kind="stable")
        group = group[order]
        h, blocks, rid, at = (np.array([part[c][i] for i in order], np.int64) for c in ("h", "blocks", "rid", "at"))
        single = np.array([part["single"][i] for i in order], bool)
        left_bytes, right_bytes = [part["left"][i] for i in order], [part["right"][i] for i in order]
        left_size, right_size = (np.array(list(map(len, c)), np.int64) for c in (left_bytes, right_bytes))
        least, most = np.full(len(rid), length + 1), np.full(len(rid), -1)
        open_rows = [[] for _ in range(5)]
        found = repeated_windows(group, _padded(left_bytes, reach), _padded(right_bytes, length), left_size, right_size, length)
        for a, rows_, classes, sizes in found:
            again = rows_[sizes[classes] > 1]
            least[again], most[again] = np.minimum(least[again], a), np.maximum(most[again], a)
            several = np.flatnonzero(blocks[rows_] > 1)
            if len(several):
                # one row of each class of this block, singles among them
                one = several[np.unique(classes[several], return_index=True)[1]]
                for i in one.tolist():
                    row = rows_[i]
                    window = left_bytes[row][:a][::-1] + right_bytes[row][: length - a]
                    n = int(sizes[classes[i]])
                    cells = (int(row), a, xxhash.xxh3_64_intdigest(window) - (1 << 63), n if single[row] or n > 1 else 2, 0)
                    for column, cell in zip(open_rows, cells):
                        column.append(cell)
        spans = np.flatnonzero(single & (most >= 0))
        yield rid[spans], at[spans] - most[spans], at[spans] - least[spans] + length, None
        if open_rows[0]:
            row, a = np.array(open_rows[0]), np.array(open_rows[1])
            yield rid[row], at[row] - a, at[row] - a + length, (h[row], a, np.array(open_rows[2], np.int64), np.array(open_rows[3], np.int64))

    def run(batches):
        names = ["h", "block", "blocks", "rid", "at", "single", "left", "right"]
        held: dict[str, list] = {c: [] for c in names}

        def frames(part):
            if part["h"]:
                for rid, start, end, rest in solve(part):
                    nulls = pa.nulls(len(rid), pa.int64())
                    h, a, window, n = (nulls, pa.nulls(len(rid), pa.int32()), nulls, nulls) if rest is None else map(pa.array, rest)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rid), pa.array(start), pa.array(end), h, a.cast(pa.int32()), window, n],
                        names=["rid", "start", "end", "h", "reach", "window", "n"],
                    )

        for batch in batches:
            for c in names:
                held[c] += batch.column(c).to_pylist()
            # whole groups only: the last one may go on in the next batch
            if len(held["h"]) >= TOGETHER:
                key, i = (held["h"][-1], held["block"][-1]), len(held["h"])
                while i and (held["h"][i - 1], held["block"][i - 1]) == key:
                    i -= 1
                if i:
                    yield from frames({c: held[c][:i] for c in names})
                    held = {c: held[c][i:] for c in names}
        yield from frames(held)

    dealt = rows.repartition("h", "block").sortWithinPartitions("h", "block")
    return dealt.mapInArrow(run, FOUND)


def taking_part(docs: DataFrame, rids: DataFrame) -> DataFrame:
    """Rows of ``docs`` (rid, text) whose bit is set in a bitmap of the given
    rids; others may slip through, none of the wanted is lost."""
    place = lambda bits: F.pmod(F.xxhash64("rid"), F.lit(bits))
    packed, bits = bitmap(rids, place, BITMAP)
    known = docs.sparkSession.sparkContext.broadcast(packed)

    def run(batches):
        marks = np.frombuffer(known.value, np.uint8)
        for batch in batches:
            at = batch.column("bit").to_numpy()
            yield batch.filter(pa.array((marks[at >> 3] >> (at & 7)).astype(np.uint8) & 1).cast(pa.bool_())).select(["rid", "text"])

    return docs.select("rid", "text", place(bits).alias("bit")).mapInArrow(run, "rid long, text string")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """From docs (rid, text): spans (rid, start, end) and packed spans (rid, own)
    of bytes whose union is what is covered by repeated windows."""
    found = anchors(docs, length, gram)
    # cut, so that both sides of the join are plain exchanges that Spark can split
    twice = cut(found.groupBy("h").agg(F.sum("k").alias("n")).where("n > 1").select("h"))
    shared = cut(found.join(twice, "h"))
    same = cut(shared.groupBy("h", "context").agg(F.sum("k").alias("n"), F.min(F.struct("rid", "at")).alias("first")))
    groups = same.groupBy("h").agg(F.count("*").alias("kinds"), F.max((F.col("n") == 1).cast("int")).alias("open"))
    groups = cut(groups.where("kinds > 1 and open = 1").select("h", F.ceil(F.col("kinds") / GROUP).alias("blocks")))
    wanted = cut(
        same.join(groups, "h").select(
            F.col("first.rid").alias("rid"), F.struct(F.col("first.at").alias("at"), "h", (F.col("n") == 1).alias("single"), "blocks").alias("w")
        )
    )
    members = taking_part(docs, wanted).join(wanted.groupBy("rid").agg(F.collect_list("w").alias("wanted")), "rid")
    compared = cut(compare(contexts(members, length, gram), length, gram))
    spans = compared.where("n is null").select("rid", "start", "end")
    # windows single in their block of a group dealt out, but found in another
    windows = compared.where("n is not null")
    again = windows.groupBy("h", "reach", "window").agg(F.sum("n").alias("total")).where("total > 1")
    late = windows.where("n = 1").join(again, ["h", "reach", "window"]).select("rid", "start", "end")
    repeated = cut(same.where("n > 1").select("h", "context"))
    whole = shared.where("own is null").join(repeated, ["h", "context"], "left_semi").select(
        "rid", F.greatest(F.col("at") - (length - gram), F.lit(0)).alias("start"), (F.col("at") + length).alias("end")
    )
    return spans.unionByName(late).unionByName(whole), shared.where("own is not null").select("rid", "own")


def _merge(spans: list[tuple[int, int]], n: int, length: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        e = min(e, n)
        if e - s < length:  # a context cut short by the end of the text
            continue
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row: the id, n_bytes, n_removed, n_spans, kept (remaining bytes)
    for rows that lose something, kept_sha256 for all."""
    named = with_row_id(df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "rid")
    docs = named.select("rid", "text")
    single, packed = repeated_spans(docs, length, gram)
    nothing = F.lit(None)
    every = single.select("rid", F.struct("start", "end").alias("span"), nothing.cast("binary").alias("own")).unionByName(
        packed.select("rid", nothing.cast("struct<start:bigint,end:bigint>").alias("span"), "own")
    )
    spans = cut(every.groupBy("rid").agg(F.collect_set("span").alias("spans"), F.collect_list("own").alias("own")))

    def run(batches):
        for batch in batches:
            rows = []
            for value, spans_, own in zip(batch.column("text"), batch.column("spans").to_pylist(), batch.column("own").to_pylist()):
                raw = value.as_py().encode("utf-8", "surrogatepass")
                pairs = [(s["start"], s["end"]) for s in spans_]
                for packed_ in own:
                    pairs += map(tuple, np.frombuffer(packed_, "<i8").reshape(-1, 2).tolist())
                gone = _merge(pairs, len(raw), length)
                cuts = [0, *(x for span in gone for x in span), len(raw)]
                kept = b"".join(raw[s:e] for s, e in zip(cuts[::2], cuts[1::2]))
                rows.append((sum(e - s for s, e in gone), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*rows)) if rows else [[]] * 4
            types = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), *(pa.array(c, t) for c, t in zip(columns, types))], names=["rid", "removed", "spans", "sha", "kept"]
            )

    changed = taking_part(docs, spans).join(spans, "rid").select("rid", "text", "spans", "own").mapInArrow(
        run, "rid long, removed long, spans long, sha string, kept binary"
    )
    basic = named.select("rid", "id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    return basic.join(changed, "rid", "left").select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("sha", "whole").alias("kept_sha256"),
        F.col("kept").alias("kept_bytes"),
    )


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_bytes")
