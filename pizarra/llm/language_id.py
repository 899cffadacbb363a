"""Language identification with string kernels.

Two texts are compared by the character n-grams (n = 1 to 3, blended) that occur
in both: a presence kernel, normalised by the numbers present. Training rows'
kernel values against a set of landmark texts give Nyström features; one
ridge regression per language, against the rest, is solved on them. Scoring a
text is one matrix product with the landmarks and one with the weights, done
for a batch of texts at a time.

n-grams are hashed to ``WIDTHS[n]`` presence bits. Letters are lower-cased;
runs of anything else count as one space.

Training takes a bounded sample, ``SAMPLE`` different labelled texts with a letter,
evenly from the languages (a small one gives all it has) and by a hash of the
text; ``LANDMARKS`` of them are landmarks. Their packed presence bits (some 1.3 kB
a text) and a histogram of at most 2^12 rows a language are all that reaches the
driver. Every text is scored whole.

Nulls and edge cases: a null text or one without a letter is ``und`` with score
0; so is everything if no labelled row is there to learn from. Rows with a null
label or id are scored, never learned from. Repeated rows are scored one by
one. Only the named columns are read. Scoring needs no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pizarra.llm.common import table

#: Texts learned from at most, landmarks among them, ridge.
SAMPLE, LANDMARKS, RIDGE = 2400, 192, 1.0
#: Leading bits of a text's hash that the sample's histogram of a language counts by.
_BUCKET_BITS = 12
WIDTHS = {1: 256, 2: 2048, 3: 8192}
_DIM = sum(WIDTHS.values())
_MULT = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))
_ROWS = 128


def _letters(text: str) -> np.ndarray:
    """Code points, lower-cased; whatever is ASCII but no letter is a space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    plain = (codes < 128) & ((codes < 97) | (codes > 122))
    codes = np.where(plain, np.uint32(32), codes)
    if len(codes) > 1:  # runs of spaces become one
        codes = codes[~((codes == 32) & np.append(False, codes[:-1] == 32))]
    return codes


def presence(text: str, out: np.ndarray) -> None:
    """Set the bits of the n-grams that occur in ``text``."""
    codes = _letters(text)
    offset = 0
    for n, width in WIDTHS.items():
        if len(codes) >= n:
            h = codes[: len(codes) - n + 1] * _MULT[0]
            for i in range(1, n):
                h = (h ^ (h >> np.uint32(15))) * _MULT[i] + codes[i : len(codes) - n + 1 + i] * _MULT[0]
            h ^= h >> np.uint32(16)
            h *= _MULT[1]
            out[offset + (h >> np.uint32(32 - (width.bit_length() - 1))).astype(np.int64)] = 1
        offset += width


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Model:
    """Landmark matrix and weights; ``scores`` gives one column per language."""

    def __init__(self, bits: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.languages = sorted(set(labels))
        # landmarks in turn from each language, so that rare ones have some
        by = [[i for i, y in enumerate(labels) if y == language] for language in self.languages]
        chosen = [rows[k] for k in range(max(map(len, by))) for rows in by if k < len(rows)][:landmarks]
        self.landmarks = self._unit(bits[chosen].astype(np.float32))
        own = (self.landmarks @ self.landmarks.T).astype(np.float64)
        values, vectors = np.linalg.eigh(own)
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        z = (self._unit(bits.astype(np.float32)) @ self.landmarks.T).astype(np.float64) @ root
        y = np.where(np.array(labels)[:, None] == np.array(self.languages)[None, :], 1.0, -1.0)
        z1 = np.hstack((z, np.ones((len(z), 1))))
        solved = np.linalg.solve(z1.T @ z1 + ridge * np.eye(z1.shape[1]), z1.T @ y)
        self.weights, self.bias = (root @ solved[:-1]).astype(np.float32), solved[-1].astype(np.float32)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return (self._unit(x) @ self.landmarks.T) @ self.weights + self.bias


def held_out_fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2 (false for a null id)."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def shares(totals: dict[str, int], sample: int) -> int:
    """How many texts each language may give so that all give at most ``sample``
    together, but always one each; what small languages leave goes to the others."""
    left = sample
    for k, n in enumerate(sorted(totals.values())):
        share = left // (len(totals) - k)
        if n >= share:
            return max(share, 1)
        left -= n
    return sample


def _sampled(rows: DataFrame, sample: int) -> DataFrame | None:
    """label, hash of the text and one id of each sampled text: the lowest hashes
    of every label, by a histogram of their leading bits, so that no task sees
    more of a label than the sample and a bucket."""
    texts = rows.groupBy("label", "hash").agg(F.min("id").alias("id"))
    bucket = F.shiftrightunsigned(F.col("hash"), 64 - _BUCKET_BITS).cast("int")
    label = Window.partitionBy("label").orderBy("bucket")
    histogram = texts.groupBy("label", bucket.alias("bucket")).count().withColumn("upto", F.sum("count").over(label))
    found = histogram.where(F.col("upto") - F.col("count") < sample).select("label", "bucket", "upto").collect()
    totals: dict[str, int] = {}
    for r in found:
        totals[r["label"]] = max(totals.get(r["label"], 0), r["upto"])
    if not totals:
        return None
    each = shares(totals, sample)
    last: dict[str, tuple[int, int]] = {}  # the first bucket that fills the share, or the last one
    for r in sorted(found, key=lambda r: (r["label"], r["bucket"])):
        if last.get(r["label"], (0, 0))[0] < each:
            last[r["label"]] = (r["upto"], r["bucket"])
    # one row a language
    bounds = rows.sparkSession.createDataFrame([(k, b) for k, (_, b) in last.items()], "label string, _last int")
    place = F.row_number().over(Window.partitionBy("label").orderBy("hash"))
    near = texts.join(F.broadcast(bounds), "label").where(bucket <= F.col("_last"))
    return near.withColumn("_place", place).where(F.col("_place") <= each).select("label", "hash", "id")


def fit(df: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE) -> Model | None:
    """Learn from at most ``sample`` different texts with a letter (or one of each
    language, if there are more languages) of labelled rows outside the held-out
    fold, drawn evenly from the languages."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out_fold(F.col("id"))
    )
    rows = rows.withColumn("hash", F.xxhash64("text"))
    sampled = _sampled(rows.select("id", "label", "hash"), sample)
    if sampled is None:
        return None

    def packed(batches):
        for batch in batches:
            out = []
            for value in batch.column("text"):
                text, bits = value.as_py(), np.zeros(_DIM, np.uint8)
                if has_letter(text):
                    presence(text, bits)
                out.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("hash"), batch.column("label"), pa.array(out, pa.binary())], names=["hash", "label", "bits"])

    # the sample's size is the parameter, so its ids may be broadcast
    chosen = rows.join(F.broadcast(sampled), ["id", "label", "hash"], "left_semi").select("text", "label", "hash")
    got = (
        chosen.mapInArrow(packed, "hash long, label string, bits binary")
        .groupBy("label", "hash")
        .agg(F.min("bits").alias("bits"))
        .collect()
    )
    got = [r for r in sorted(got, key=lambda r: (r["hash"], r["label"])) if any(r["bits"])]
    if not got:
        return None
    bits = np.unpackbits(np.array([np.frombuffer(r["bits"], np.uint8) for r in got]), axis=1)[:, :_DIM]
    return Model(bits, [r["label"] for r in got])


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, lang_pred, score (0 to 1)."""
    source = df.select(id_col, text_col)

    def run(batches):
        for batch in batches:
            languages, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            for first in range(0, batch.num_rows if model else 0, _ROWS):
                texts = [t.as_py() for t in batch.column(1).slice(first, _ROWS)]
                x = np.zeros((len(texts), _DIM), np.float32)
                known = [i for i, t in enumerate(texts) if has_letter(t)]
                for i in known:
                    presence(texts[i], x[i])
                s = model.scores(x)
                best = s.argmax(1)
                for i in known:
                    languages[first + i] = model.languages[best[i]]
                    scores[first + i] = min(max((float(s[i, best[i]]) + 1) / 2, 0.0), 1.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=[batch.schema.names[0], "lang_pred", "score"]
            )

    first = source.schema[0]
    return source.mapInArrow(run, f"`{first.name}` {first.dataType.simpleString()}, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, "doc_id", "text", "lang")
    return predict(docs, model).select("doc_id", held_out_fold(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
