"""Spelling variant grouping by FM-index search schemes.

1. Words are counted over all texts and those that are long and frequent enough
   form the vocabulary.
2. Of a word at distance one, either the first half or the second half of the
   word asked for is intact. A query goes to the shard of either half, an entry to
   the shards of all halves it can have in common with a query of its length, one
   less or one more; so what is near meets in a shard.
3. A shard holds its entries as one text with delimiters, indexed in both
   directions (suffix array, Burrows-Wheeler transform). A search matches the
   intact half exactly from its delimited end, then goes on over the other half
   allowing one error, and through the delimiter at its far end; all queries of a
   shard advance together, as arrays of suffix-rank intervals. As a search begins
   at a word's end, its interval grows on one side only: the direction is picked
   by the half that is intact, and the two intervals need not be kept in step.
4. Each word points to its form; roots are found by pointer jumping, in which the
   distance covered doubles each round.

A half that more than ``BLOCK`` entries share is refined: of the part with the
error, again either half is intact, and entries and queries are dealt out by both
pieces, until no key is larger (at the end a key is all of the word but one
place, which only so many letters can fill). No key is ever searched pair by pair.

Which of several alignments counts is settled by the common prefix: a pair belongs
to the key whose error part holds the first place where the words differ. So every
pair is found in one key, and what leaves a shard is one row per query and key.

Scale: texts never leave their task; counts are combined per task (``HELD`` words,
then handed on) and map-side. The rest works on the vocabulary; a shard has about
``BLOCK`` entries, however large the vocabulary is.

Nulls and edge cases: a null text has no words; a null id counts as the empty
string in the hash. Repeated rows count each. Ties of n among near words go to the
smallest in code-point order. Words of any length are handled whole. An empty table
gives no rows. Only id and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pizarra.llm.common import cut, table

LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, ONE_IN, RATIO = 5, 3, 97, 2
#: Entries of a shard on average, and the most that share a key before it is refined.
BLOCK = 16384
#: Words a task holds before it hands its counts on.
HELD = 500_000
_RUNS = re.compile(f"[{LETTERS}]+")


def lower(text: str) -> str:
    """Lower-case A-Z only."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def words_of(doc_id: str, text: str, one_in: int = ONE_IN) -> Counter:
    """How often each word occurs in a text. A run whose hash with the document's id
    is a multiple of ``one_in`` has lost a code point."""
    out = Counter(_RUNS.findall(lower(text)))
    start = zlib.crc32(f"{doc_id}:".encode())
    for run, n in list(out.items()):
        h = zlib.crc32(run.encode(), start)
        if h % one_in == 0:
            at = h % len(run)
            out[run] -= n
            out[run[:at] + run[at + 1 :]] += n
    return out


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """From (id string, text): (word, n) for all words of that length and number."""

    def frame(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        held: dict[str, int] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column("id"), batch.column("text")):
                for word, n in words_of(doc_id.as_py(), text.as_py()).items():
                    if len(word) >= min_length and n:
                        held[word] = held.get(word, 0) + n
                if len(held) > HELD:
                    yield frame(held)
                    held = {}
        yield frame(held)

    counts = docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= min_count)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; all suffixes must differ."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        ranks = np.cumsum(np.append(0, sorted_key[1:] != sorted_key[:-1]))
        rank[order] = ranks
        if ranks[-1] == n - 1 or step >= n:
            return order
        step *= 2


class Index:
    """FM-index over delimited words, extended to the left."""

    def __init__(self, words: list[np.ndarray]):
        lengths = np.array([len(w) for w in words], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        n = self.n = int((lengths + 1).sum())
        text = np.zeros(n, np.int64)
        ends = np.ones(n, bool)
        ends[self.starts + lengths] = False
        text[ends] = np.concatenate(words) if words else []
        self.alphabet, codes = np.unique(text[ends], return_inverse=True)
        text[ends] = codes + 1  # 0 is the delimiter
        # each delimiter is a letter of its own for sorting, in the order of words
        unique = text + len(words)
        unique[~ends] = np.arange(len(words))
        order = suffix_order(unique)
        self.word = np.searchsorted(self.starts, order, side="right") - 1
        self.before = text[order - 1]  # the letter ahead of each suffix
        self.words = len(words)
        self.rows = np.argsort(self.before, kind="stable")
        self.keys = self.before[self.rows] * (n + 1) + self.rows

    def codes(self, letters: np.ndarray) -> np.ndarray:
        """Letters as codes; -1 if the index has no such letter."""
        if not len(self.alphabet):
            return np.full(len(letters), -1, np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, letters), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == letters, at + 1, -1)

    def extend(self, code: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes with ``code`` ahead. As rows are sorted by
        the letter ahead and the row, one search gives the letters smaller
        than ``code`` plus the occurrences of ``code`` up to a row."""
        base = code * (self.n + 1)
        return np.searchsorted(self.keys, base + lo), np.searchsorted(self.keys, base + hi)

    def letters(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which interval, code): the letters ahead of each interval's suffixes."""
        size = hi - lo
        sigma = len(self.alphabet)
        small = np.flatnonzero(size <= 2 * sigma)
        counts = size[small]
        at = np.repeat(lo[small] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        listed = np.unique(np.repeat(small, counts) * (sigma + 1) + self.before[at])
        large = np.flatnonzero(size > 2 * sigma)
        which = np.concatenate((listed // (sigma + 1), np.repeat(large, sigma)))
        code = np.concatenate((listed % (sigma + 1), np.tile(np.arange(1, sigma + 1), len(large))))
        keep = code > 0
        return which[keep], code[keep]

    def ended(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which interval, word): words that are a whole match of an interval."""
        first, last = self.extend(np.zeros(len(lo), np.int64), lo, hi)
        which = np.flatnonzero(last > first)
        return which, self.word[self.rows[first[which]]]


def search(index: Index, letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray, exact: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """Pairs (query, word) one error apart. Query k is ``letters`` from ``starts[k]``
    on, in the order in which it is matched: ``exact[k]`` places without an error,
    an error within the next ``middle[k]``, the rest without."""
    found = [np.zeros((0, 2), np.int64)]
    q = np.arange(len(starts))
    none = np.zeros(0, np.int64)
    plain = (q, np.zeros(len(q), np.int64), np.full(len(q), index.words, np.int64))
    off = (none, none, none)

    def only(states, keep):
        return tuple(c[keep] for c in states)

    def both(*states):
        return tuple(np.concatenate(c) for c in zip(*states))

    def stepped(states, code):
        lo, hi = index.extend(code, states[1], states[2])
        return only((states[0], lo, hi), (lo < hi) & (code > 0))

    at = 0
    while len(plain[0]) or len(off[0]):
        # one letter more than the query has, ahead of place ``at``
        may = only(plain, (at >= exact[plain[0]]) & (at <= exact[plain[0]] + middle[plain[0]]))
        which, code = index.letters(may[1], may[2])
        off = both(off, stepped(only(may, which), code))
        if len(off[0]) > len(starts):  # alignments that came to the same interval
            off = tuple(np.unique(np.stack(off, 1), axis=0).T)
        done = only(off, lengths[off[0]] == at)
        which, word = index.ended(done[1], done[2])
        found.append(np.stack((done[0][which], word), 1))
        plain, off = only(plain, lengths[plain[0]] > at), only(off, lengths[off[0]] > at)
        may = only(plain, (at >= exact[plain[0]]) & (at < exact[plain[0]] + middle[plain[0]]))
        which, code = index.letters(may[1], may[2])
        other = code != letters[starts[may[0][which]] + at]
        changed = stepped(only(may, which[other]), code[other])
        off = both(stepped(off, letters[starts[off[0]] + at]), changed, may)
        plain = stepped(plain, letters[starts[plain[0]] + at])
        at += 1
    return np.unique(np.concatenate(found), axis=0)


def _codes(words: list[str]) -> list[np.ndarray]:
    return [np.frombuffer(w.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) for w in words]


def near_words(words: list[str], n: list[int], queries: list[str], prefix: np.ndarray, suffix: np.ndarray, bound: np.ndarray) -> list[tuple[int, int, str] | None]:
    """For each query: number of words one error away, the largest n of them and the
    smallest word of that n; None without any. ``prefix`` and ``suffix`` letters are
    intact; the words must differ before place ``bound``."""
    coded, asked = _codes(words), _codes(queries)
    length = np.array([len(q) for q in queries], np.int64)
    best: list[tuple[int, int, str] | None] = [None] * len(queries)
    for leftwards in (False, True):  # from the larger intact piece
        mine = np.flatnonzero((suffix > prefix) == leftwards)
        if not len(mine):
            continue
        turn = 1 if leftwards else -1
        index = Index([w[::turn] for w in coded])
        letters = np.concatenate([asked[k][::-turn] for k in mine])
        starts = np.concatenate(([0], np.cumsum(length[mine])[:-1]))
        exact = (suffix if leftwards else prefix)[mine]
        middle = length[mine] - prefix[mine] - suffix[mine]
        for k, w in search(index, index.codes(letters), starts, length[mine], exact, middle).tolist():
            k = int(mine[k])
            query, word, limit = queries[k], words[w], int(bound[k])
            if limit < len(query) and query[:limit] == word[:limit]:
                continue  # the words first differ later: another key has this pair
            old = best[k]
            if old is None:
                best[k] = 1, n[w], word
            else:
                top = (n[w], word) if n[w] > old[1] or n[w] == old[1] and word < old[2] else old[1:]
                best[k] = old[0] + 1, *top
    return best


def _key(word, length, a, b):
    """The key of a word for queries of a length with ``a`` first and ``b`` last
    letters intact (lengths keep the pieces apart)."""
    return F.concat_ws(":", length, a, b, F.substr(word, F.lit(1), a), F.when(b > 0, F.substr(word, F.char_length(word) - b + 1, b)).otherwise(F.lit("")))


def meeting_keys(words: DataFrame, min_length: int = MIN_LENGTH, block: int = BLOCK) -> DataFrame:
    """From (word, n): rows (key, word, n, ask, a, b, bound): entries (``ask`` false)
    and queries that may be near under a key. Keys of more than ``block`` entries are
    refined, so no key is larger."""
    own = F.char_length("word")
    lengths = F.filter(F.array(own - 1, own, own + 1), lambda m: m >= min_length)
    start = words.select("word", "n", F.explode(lengths).alias("m"))
    half = F.floor(F.col("m") / 2).cast("int")
    pieces = F.array(
        F.struct(half.alias("a"), F.lit(0).alias("b"), F.col("m").alias("bound")),
        F.struct(F.lit(0).alias("a"), (F.col("m") - half).alias("b"), half.alias("bound")),
    )
    rows, out = start.select("word", "n", "m", F.explode(pieces).alias("p")).select("word", "n", "m", "p.*"), None
    while True:
        rows = cut(rows.withColumn("key", _key(F.col("word"), F.col("m"), F.col("a"), F.col("b"))))
        sizes = rows.groupBy("key").agg(F.count("*").alias("k"))
        # one intact place less than the query has is the finest key
        hot = cut(sizes.where(F.col("k") > block).select("key"))
        is_hot = rows.join(hot, "key", "left_semi").where(F.col("m") - F.col("a") - F.col("b") > 1)
        cold = rows.join(hot, "key", "left_anti").unionByName(rows.join(hot, "key", "left_semi").where(F.col("m") - F.col("a") - F.col("b") <= 1))
        out = cold if out is None else out.unionByName(cold)
        if is_hot.isEmpty():
            return out.select("key", "word", "n", (F.char_length("word") == F.col("m")).alias("ask"), "a", "b", "bound")
        middle = F.col("m") - F.col("a") - F.col("b")
        x = F.floor(middle / 2).cast("int")
        finer = F.array(
            F.struct((F.col("a") + x).alias("a"), F.col("b"), F.col("bound")),
            F.struct(F.col("a"), (F.col("b") + middle - x).alias("b"), F.least("bound", F.col("a") + x).alias("bound")),
        )
        rows = is_hot.select("word", "n", "m", F.explode(finer).alias("p")).select("word", "n", "m", "p.*")
        rows = rows.where(F.col("a") + F.col("b") <= F.char_length("word"))


def nearest(words: DataFrame, min_length: int = MIN_LENGTH, block: int = BLOCK) -> DataFrame:
    """From (word, n): (word, n_near, best_n, best) for words that have near ones."""
    keyed = cut(meeting_keys(words, min_length, block))
    shards = max(1, -(-keyed.count() // block))

    def run(table):
        # an entry may come by several keys of a shard; keys without a query or without another entry are left out
        rows = table.to_pydict()
        entries = dict(zip(rows["word"], rows["n"]))
        at = [i for i, ask in enumerate(rows["ask"]) if ask]
        names = list(entries)
        piece = (np.array([rows[c][i] for i in at], np.int64) for c in ("a", "b", "bound"))
        best = near_words(names, list(entries.values()), [rows["word"][i] for i in at], *piece) if at else []
        hits = [(rows["word"][i], *found) for i, found in zip(at, best) if found]
        columns = zip(*hits) if hits else [[]] * 4
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "best_n", "best"])

    several = cut(keyed.groupBy("key").agg(F.count("*").alias("k"), F.max("ask").alias("asked")).where("k > 1 and asked").select("key"))
    dealt = keyed.join(several, "key").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    found = dealt.groupBy("shard").applyInArrow(run, "word string, n_near long, best_n long, best string")
    # largest n first, of those the smallest word: strings compare by code points
    top = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("top")).select(
        "word", "n_near", (-F.col("top.n")).alias("best_n"), F.col("top.word").alias("best")
    )


def rooted(forms: DataFrame) -> DataFrame:
    """From (word, form): (word, root), by pointer jumping. A form is more frequent
    than its word, so there are no cycles and few rounds."""
    at = cut(forms.select("word", F.coalesce("form", "word").alias("root"), F.col("form").isNull().alias("done")))
    while not at.where("not done").isEmpty():
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"), F.col("done").alias("ends"))
        moved = at.where("not done").join(ahead, "root").select("word", F.col("next").alias("root"), F.col("ends").alias("done"))
        at = cut(at.where("done").unionByName(moved))
    return at.select("word", "root")


def variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """One row per word of the vocabulary: word, form, root, n, n_near, form_n."""
    docs = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((id_col, "id"), (text_col, "text"))))
    words = cut(vocabulary(docs, min_length, min_count))
    near = nearest(words, min_length, block)
    likely = F.col("best_n") >= ratio * F.col("n")
    known = cut(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(likely, F.col("best")).alias("form"), F.when(likely, F.col("best_n")).alias("form_n")
        )
    )
    return known.join(rooted(known.select("word", "form")), "word").select("word", "form", "root", "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
