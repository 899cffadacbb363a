"""Quality rules: base counts per document and repetition coverage.

Repetition coverage: for several n-gram lengths, rolling hashes of the word
numbers are computed with numpy prefix sums; the characters of words inside
second and later occurrences of an n-gram are measured as a share of all word
characters, and likewise the characters of repeated lines. A document is kept
when the base rules pass and no share is over its limit. A heading line that
closes the document once more (first and last line that is not blank, nowhere
else, at most HEADING_WORDS words) is no repetition for the coverage shares;
the base counts do count it.

The base counts are exact (words and windows get collision-free numbers); only
the coverage shares rest on 64-bit hashes, compared within one document.

Nulls and edge cases: a null text has no words, so the base rules fail it; so
does an empty one. Repeated rows and null ids are judged one by one. Only the
id and text columns are read by the digest; ``quality_filter`` keeps all the
caller's columns. Each row is judged by itself: no shuffle, no hot key, and
memory is bounded by the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pizarra.llm.common import handed_on, table

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: n-gram length -> largest share of word characters in repeated n-grams; and of
#: characters in repeated lines
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 8: 0.12, 10: 0.10}
LINE_LIMIT = 0.20
HEADING_WORDS = 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)


def _inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 1 << 64))


def rolling_hashes(numbers: np.ndarray, n: int, powers: np.ndarray, inverses: np.ndarray) -> np.ndarray:
    """Hash of every n-window: difference of prefix sums of number * base**i,
    shifted back to a common exponent (base is odd, so it has an inverse
    modulo 2**64)."""
    terms = ((numbers + np.uint64(1)) * _MULTIPLIER) * powers[: len(numbers)]
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
    return (prefix[n:] - prefix[:-n]) * inverses[: len(numbers) - n + 1]


def later_windows(keys: np.ndarray) -> np.ndarray:
    """True where a key has occurred before."""
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return again


def covered(windows: np.ndarray, n: int) -> np.ndarray:
    """Words covered by the flagged n-windows."""
    edge = np.zeros(len(windows) + n, np.int64)
    edge[: len(windows)] += windows
    edge[n:] -= windows
    return np.cumsum(edge)[:-1] > 0


def _names(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Collision-free numbers of adjacent pairs."""
    return np.unique(left * (right.max() + 1) + right, return_inverse=True)[1]


def powers_of(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(n - 1, 0), base, np.uint64))), dtype=np.uint64)


class Judge:
    def __init__(self, ngram_limits: dict[int, float], line_limit: float):
        self.ngram_limits, self.line_limit = ngram_limits, line_limit
        self._grow(1 << 12)

    def _grow(self, n: int) -> None:
        self.powers, self.inverses = powers_of(_BASE, n), powers_of(_inverse(_BASE), n)

    def __call__(self, text: str | None) -> tuple:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
        base_failed, worst n-gram share, line share, kept."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.split()  # on the bytes 09-0D and 20, as the word pattern does
        n_words = len(words)
        word_bytes = sum(map(len, words))
        word_chars = len(text or "") - (len(raw) - word_bytes)
        n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
        seen, n_dup_lines, dup_line_bytes, line_bytes = set(), 0, 0, 0
        heading, n_heading = None, 0
        for line in raw.split(b"\n"):
            if line.strip():
                line_bytes += len(line)
                if line in seen:
                    n_dup_lines += 1
                    dup_line_bytes += len(line)
                seen.add(line)
                heading = line if heading is None else heading
                n_heading += line == heading
                last = line
        closing = 0  # words of a heading line's copy at the end
        if n_heading == 2 and last == heading and len(heading.split()) <= HEADING_WORDS:
            closing = len(heading.split())
            dup_line_bytes -= len(heading)
        n_repeat_words, worst = 0, 0.0
        if n_words >= 3:
            numbers: dict[bytes, int] = {}
            ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n_words)
            triples = _names(_names(ids[:-1], ids[1:])[:-1], ids[2:])
            n_repeat_words = int(covered(np.bincount(triples)[triples] > 1, 3).sum())
            if n_words > len(self.powers):
                self._grow(2 * n_words)
            # without a repeated 3-window there is no longer repeat either
            if n_repeat_words:
                chars = np.fromiter(map(len, words), np.int64, n_words)
                for n, limit in self.ngram_limits.items():
                    if n_words >= n:
                        again = later_windows(rolling_hashes(ids.astype(np.uint64), n, self.powers, self.inverses))
                        share = float(chars[: n_words - closing][covered(again, n)[: n_words - closing]].sum()) / word_bytes
                        worst = max(worst, share / limit)
        base_failed = n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words
        line_share = dup_line_bytes / line_bytes if line_bytes else 0.0
        kept = not base_failed and worst <= 1.0 and line_share <= self.line_limit
        return n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, worst, line_share, kept


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, ngram_excess double, line_share double, kept boolean"
)
_ARROW = [*((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
          ("base_failed", pa.bool_()), ("ngram_excess", pa.float64()), ("line_share", pa.float64()), ("kept", pa.bool_())]


def _judged(frame: DataFrame, keep: bool, ngram_limits, line_limit) -> DataFrame:
    """``frame``'s last column is the text. With ``keep`` only the rows that
    pass come back, with the columns they had; else the id and all measures."""

    def run(batches):
        handed_on()
        judge = Judge(ngram_limits, line_limit)
        for batch in batches:
            rows = [judge(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            if keep:
                yield batch.filter(pa.array([r[-1] for r in rows], pa.bool_()))
            else:
                columns = list(zip(*rows)) if rows else [[] for _ in _ARROW]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(columns, _ARROW))],
                    names=[batch.schema.names[0], *(n for n, _ in _ARROW)],
                )

    first = frame.schema[0]
    return frame.mapInArrow(run, frame.schema if keep else f"`{first.name}` {first.dataType.simpleString()}, {SCHEMA}")


def quality_measures(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram_limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT
) -> DataFrame:
    """One row per document: the id, the base counts and the verdict."""
    return _judged(df.select(id_col, text_col), False, dict(ngram_limits or NGRAM_LIMITS), line_limit)


def quality_filter(
    df: DataFrame, text_col: str = "text", ngram_limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT
) -> DataFrame:
    """The documents that pass, with all the columns they came with."""
    names = df.columns
    # positional names inside, so that no two columns can clash
    inner = df.toDF(*(f"c{i}" for i in range(len(names))))
    moved = [f"c{i}" for i in range(len(names)) if names[i] != text_col]
    last = f"c{names.index(text_col)}"
    kept = _judged(inner.select(*moved, last), True, dict(ngram_limits or NGRAM_LIMITS), line_limit)
    return kept.select(*(f"c{i}" for i in range(len(names)))).toDF(*names)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_measures(table(spark, sf_dir, "documents"))
