"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is exactly one token that can be the last one
of its BPE encoding. An automaton over the vocabulary gives, at each position,
the tokens that are suffixes of the prefix (longest first); a candidate is the
last token if it is compatible with the last token of the prefix before it,
that is, if BPE leaves the two apart. Back-pointers then give the ids.

Two tokens are compatible when undoing their merges from the highest rank down
never meets a pair across the border that BPE would have merged first.

The new words of a slice of texts are solved together, as columns: from each place,
in order, the vocabulary's automaton is followed in all words at once, and a token
becomes the last one of the prefix it ends if that has none yet (those from earlier
places are longer) and it is compatible. Long words are solved by themselves.

Special tokens in a text, normalisation and the split into words are those the
tokenizer file declares. Plain Latin texts are lower-cased and cut at spaces by
Arrow, and each distinct stretch of a slice of texts is encoded once; others go
through the library's normaliser and splitter. Words repeat, so a worker keeps a
bounded table of those it has encoded, in two halves of which the older is dropped
when the younger is full: memory stays bounded and results never depend on it. It stays
for a worker's next tasks, until Spark hands the worker to another operator.

Nulls and edge cases: a null text is encoded as an empty one (no ids); repeated
rows are encoded one by one; whole texts are processed whatever their length.
Only the text column is read by the functions; other columns pass through.
No shuffle: each row is encoded by itself, so no key can become hot.
"""

from __future__ import annotations

import json
import re
import struct
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pizarra.llm.common import on_handover, table

WORD_END = "</w>"
_END = "\ue000"  # stands for WORD_END inside the automaton
#: Words in the younger half of a task's table, and pairs whose compatibility it knows.
KNOWN_WORDS, KNOWN_PAIRS = 150_000, 1 << 17
#: Words that are solved together, the bytes of the longest of them, and the binary
#: digits of a place in the table of pairs that they share.
TOGETHER, LONGEST, PAIR_BITS = 1 << 16, 64, 18
#: Texts whose distinct stretches are found together, and their bytes.
SLICE, SLICE_BYTES = 2048, 1 << 22
# Lines for which the declared normalisation is lower-casing alone and the declared
# split needs only these letters: ASCII and precomposed Latin ones.
_SIMPLE = re.compile(r"[ -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]*")
_ODD = r"[^ -~\n\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}]"  # the other characters, for Arrow
_SIMPLE_WORDS = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|[0-9]|[^ a-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"
)


_STRETCH_WORDS = re.compile(r"\n|" + _SIMPLE_WORDS.pattern.replace("[^ a-z", "[^ \\na-z"))


def _byte_characters() -> str:
    """The characters that stand for bytes: the byte's own where it prints in
    Latin-1, else the next one from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = iter(range(256, 512))
    return "".join(chr(b if b in own else next(other)) for b in range(256))


_BYTES = _byte_characters()


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in slices of up to ``SLICE``, and no more bytes than
    ``SLICE_BYTES`` (a longer text is a slice of its own)."""
    ends, start = np.cumsum(np.append(0, pc.binary_length(texts).to_numpy())), 0
    while start < len(texts):
        fit = int(np.searchsorted(ends, ends[start] + SLICE_BYTES, side="right")) - 1
        stop = min(max(fit, start + 1), start + SLICE, len(texts))
        yield texts.slice(start, stop - start)
        start = stop


class PrefixBpe:
    """Encoder and decoder for one tokenizer file (BPE with word ends)."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # its normaliser and splitter are all that is taken: the vocabulary stays out
        library = Tokenizer.from_str(json.dumps(spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}))
        self._normalizer, self._splitter = library.normalizer, library.pre_tokenizer
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.strings = dict((i, s) for s, i in vocab.items())
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings.update((i, s) for s, i in self.specials.items())
        # ranks: base tokens below all merges, merges in their order
        self._id_of_rank, rank_of = [], {}
        merged = {a + b for a, b in spec["model"]["merges"]}
        for s in sorted((s for s in vocab if s not in merged and s not in self.specials), key=vocab.get):
            rank_of[s] = len(self._id_of_rank)
            self._id_of_rank.append(vocab[s])
        self._parts: list[tuple[int, int] | None] = [None] * len(rank_of)
        self._merge: dict[tuple[int, int], int] = {}
        for a, b in spec["model"]["merges"]:
            pair = rank_of[a], rank_of[b]
            if a + b in rank_of:
                raise ValueError(f"two merges make {a + b!r}")
            rank_of[a + b] = self._merge[pair] = len(self._parts)
            self._parts.append(pair)
            self._id_of_rank.append(vocab[a + b])
        automaton = ahocorasick.Automaton()
        self._size = [0] * len(rank_of)
        kept: dict[str, int] = {}
        for s, rank in rank_of.items():
            plain = s.removesuffix(WORD_END) + _END if s.endswith(WORD_END) and s != WORD_END else s
            self._size[rank] = len(plain)
            # a token that BPE would not make of its own string never occurs
            if self._parts[rank] is None or self._keeps(rank):
                automaton.add_word(plain, (rank, len(plain)))
                kept[plain] = rank
        automaton.make_automaton()
        self._matches = automaton.iter
        self._make_columns(kept)
        self.forget()
        split = "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))
        self._special = re.compile(f"({split})") if split else None

    def _make_columns(self, kept: dict[str, int]) -> None:
        """The tokens' trie as arrays. Node 0 is none, 1 the root; nodes with children
        come first, as ``_child`` has a row for each of them and a column for each
        byte that some token has, and one for all others. Word ends are no nodes: a
        node has the token that its string is and the one that it is with a word end."""
        byte = {c: b for b, c in enumerate(_BYTES)}
        edges: dict[int, int] = {}  # by 256 * node + byte
        token, ending = {}, {}
        for plain, rank in kept.items():
            body = plain.removesuffix(_END)
            if not body or any(c not in byte for c in body):
                continue  # is in no word
            node = 0
            for c in body:
                node = edges.setdefault(node << 8 | byte[c], len(edges) + 1)
            (token if body == plain else ending)[node] = rank
        node, symbol = np.divmod(np.fromiter(edges, np.int64, len(edges)), 256)
        inner = np.unique(np.append(node, 0))
        number = np.full(len(edges) + 1, -1, np.int64)
        number[inner] = np.arange(1, len(inner) + 1)
        leaves = np.flatnonzero(number < 0)
        number[leaves] = np.arange(len(inner) + 1, len(edges) + 2)
        used = np.unique(symbol)
        self._column = np.zeros(256, np.int16)
        self._column[used] = np.arange(1, len(used) + 1)
        self._inner, self._width = len(inner), len(used) + 1
        self._child = np.zeros((self._inner + 1) * self._width, np.int32)
        self._child[number[node] * self._width + self._column[symbol]] = number[np.fromiter(edges.values(), np.int64, len(edges))]
        self._token, self._ending = np.full((2, len(edges) + 2), -1, np.int32)
        for of_node, found in ((self._token, token), (self._ending, ending)):
            of_node[number[np.fromiter(found, np.int64, len(found))]] = [*found.values()]
        self._bytes_of = np.array(self._size, np.int64)
        with_end = [rank for plain, rank in kept.items() if plain.endswith(_END)]
        self._bytes_of[with_end] -= 1  # without the word end
        self._ids = np.array(self._id_of_rank, "<u4")
        self._halves = np.array([p or (-1, -1) for p in self._parts], np.int64).reshape(-1, 2).T
        pairs = np.array([a * len(self._parts) + b for a, b in self._merge], np.int64)
        by_pair = np.argsort(pairs)
        self._merged = np.append(pairs[by_pair], 1 << 62)
        self._merged_rank = np.append(np.array([*self._merge.values()], np.int64)[by_pair], 0)

    def forget(self) -> None:
        """Drop the tables of what has been encoded."""
        self._pair = np.full(1 << PAIR_BITS, -1, np.int64)
        self._fits = np.zeros(1 << PAIR_BITS, bool)
        self._apart: defaultdict[int, dict[int, bool]] = defaultdict(dict)
        self._pairs = 0
        self._words: dict[str, bytes] = {"\n": b""}  # between stretches
        self._old_words: dict[str, bytes] = {}

    def _keeps(self, rank: int) -> bool:
        """Whether the two halves of a token meet unmerged just before its own
        merge, i.e. no lower-ranked merge crosses the border first."""
        a, b = self._parts[rank]
        return self._compatible(a, b, below=rank)

    def _compatible(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether BPE leaves ``left`` and ``right`` apart (``below``: looking
        only at merges of a lower rank)."""
        limit = len(self._parts) if below is None else below
        while True:
            across = self._merge.get((left, right))
            if across is not None and across < limit:
                return False
            # undo the later of the two merges; on equal footing the right one,
            # as BPE merges from the left
            if left > right and self._parts[left] is not None:
                limit, left = left, self._parts[left][1]
            elif self._parts[right] is not None:
                limit, right = right + 1, self._parts[right][0]
            elif self._parts[left] is not None:
                limit, left = left, self._parts[left][1]
            else:
                return True

    def _all_compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``_compatible`` of many pairs."""
        out, at = np.zeros(len(left), bool), np.arange(len(left))
        limit, (head, tail) = np.full(len(left), len(self._parts)), self._halves
        while len(at):
            pair = left * len(self._parts) + right
            k = np.searchsorted(self._merged, pair)
            apart = (self._merged[k] != pair) | (self._merged_rank[k] >= limit)
            undo_left = (tail[left] >= 0) & ((left > right) | (head[right] < 0))
            undo_right = ~undo_left & (head[right] >= 0)
            out[at[apart & ~undo_left & ~undo_right]] = True
            on = np.flatnonzero(apart & (undo_left | undo_right))
            at, of_left, left, right = at[on], undo_left[on], left[on], right[on]
            limit = np.where(of_left, left, right + 1)
            left, right = np.where(of_left, tail[left], left), np.where(of_left, right, head[right])
        return out

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word (byte-level characters, without its word end)."""
        marked = word + _END
        last: list[int | None] = [-1] + [None] * len(marked)
        at, apart = -1, self._apart
        for end, (rank, size) in self._matches(marked):
            if end == at:  # this prefix has its token
                continue
            before = last[end + 1 - size]
            if before is None:
                continue
            if before >= 0:
                fits = apart[before].get(rank)
                if fits is None:
                    fits = self._known_pair(before, rank)
                if not fits:
                    continue
            last[end + 1] = rank
            at = end
        out, i = [], len(marked)
        while i:
            rank = last[i]
            if rank is None:
                raise ValueError(f"no encoding of {word!r}")
            out.append(self._id_of_rank[rank])
            i -= self._size[rank]
        out.reverse()
        return out

    def _known_pair(self, left: int, right: int) -> bool:
        if self._pairs >= KNOWN_PAIRS:
            self._apart.clear()
            self._pairs = 0
        self._pairs += 1
        fits = self._apart[left][right] = self._compatible(left, right)
        return fits

    def _all_fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which pairs of tokens are compatible. A pair has one place in the table and
        takes it from the pair that had it."""
        pair = left.astype(np.int64) * len(self._parts) + right
        at = ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        fits = self._fits[at]
        new = np.flatnonzero(self._pair[at] != pair)
        if len(new):
            pairs, first, same = np.unique(pair[new], return_index=True, return_inverse=True)
            found = self._all_compatible(*np.divmod(pairs, len(self._parts)))
            fits[new] = found[same]
            places, last = np.unique(at[new[first]][::-1], return_index=True)
            last = len(first) - 1 - last  # one pair for each place
            self._pair[places], self._fits[places] = pairs[last], found[last]
        return fits

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of plain words without line ends, as they stand in the text."""
        out: list[bytes] = []
        for start in range(0, len(words), TOGETHER):
            out += self._encode_together(words[start : start + TOGETHER])
        return out

    def _encode_together(self, words: list[str]) -> list[bytes]:
        text = np.frombuffer(("\n".join(words) + "\n").encode(), np.uint8)
        ends = np.flatnonzero(text == 10)
        starts = np.append(0, ends[:-1] + 1)
        size = ends - starts
        solved = np.flatnonzero((size > 0) & (size <= LONGEST))
        order = solved[np.argsort(-size[solved], kind="stable")]
        starts, size = starts[order], size[order]
        most = int(size[0]) if len(size) else 0
        longer = np.searchsorted(-size, -np.arange(most + 1), side="left")  # words of more than so many bytes
        symbols = [self._column[text[starts[: longer[p]] + p]] for p in range(most)]
        last = np.full((most + 1, len(order)), -1, np.int32)  # tokens of prefixes, in the last row of whole words
        whole = last[most]
        for p in range(most):
            before = last[p]
            at = np.arange(longer[p]) if not p else np.flatnonzero(before[: longer[p]] >= 0)
            node = self._child[self._width + symbols[p][at].astype(np.int64)]
            for end in range(p + 1, most + 1):
                alive = np.flatnonzero(node)
                if not len(alive):
                    break
                at, node = at[alive], node[alive]
                inside = int(np.searchsorted(at, longer[end]))
                for words_at, token, known in ((at[:inside], self._token[node[:inside]], last[end]), (at[inside:], self._ending[node[inside:]], whole)):
                    new = np.flatnonzero((token >= 0) & (known[words_at] < 0))
                    if len(new):
                        words_at, token = words_at[new], token[new]
                        if p:
                            fits = self._all_fit(before[words_at], token)
                            words_at, token = words_at[fits], token[fits]
                        known[words_at] = token
                on = np.flatnonzero(node[:inside] <= self._inner)
                at = at[on]
                node = self._child[node[on].astype(np.int64) * self._width + symbols[end][at]] if len(on) else node[:0]
        if (whole < 0).any():
            raise ValueError(f"no encoding of {words[order[int(np.argmin(whole))]]!r}")
        # back from the ends; a word's ids are found last first
        steps, n = [], np.zeros(len(words), np.int64)
        at, rank, left = np.arange(len(order)), whole, size
        while len(at):
            steps.append((at, rank))
            n[order[at]] += 1
            left = left - self._bytes_of[rank]
            more = np.flatnonzero(left)
            at, left = at[more], left[more]
            rank = last[left, at]
        upto = np.cumsum(n)
        ids = np.empty(int(upto[-1]) if len(upto) else 0, "<u4")
        for k, (at, rank) in enumerate(steps):
            ids[upto[order[at]] - 1 - k] = self._ids[rank]
        packed = memoryview(ids.tobytes())
        out = [bytes(packed[4 * a : 4 * b]) for a, b in zip((upto - n).tolist(), upto.tolist(), strict=True)]
        for k in np.flatnonzero(ends - np.append(0, ends[:-1] + 1) > LONGEST).tolist():
            out[k] = _packed(self.encode_word(self._marked(words[k])))
        return out

    @staticmethod
    def _marked(word: str) -> str:
        """A plain word in the characters that stand for its bytes."""
        return word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)

    def _word(self, word: str) -> bytes:
        """Ids of a word that is not in the younger half of the table. The library's
        byte-level words have a mark ahead, plain ones are as they stand in the text."""
        ids = self._old_words.get(word)
        if ids is None:
            ids = _packed(self.encode_word(word[1:] if word[0] == _END else self._marked(word)))
        self._know(word, ids)
        return ids

    def _know(self, word: str, ids: bytes) -> None:
        if len(self._words) >= KNOWN_WORDS:
            self._old_words, self._words = self._words, {"\n": b""}
        self._words[word] = ids

    def _packed_words(self, words: list[str]) -> list[bytes]:
        """Ids of each of some plain words (and line ends). New ones are solved together."""
        out = list(map(self._words.get, words))
        new: dict[str, bytes | None] = {w: self._old_words.get(w) for w, ids in zip(words, out, strict=True) if ids is None}
        unsolved = [w for w, ids in new.items() if ids is None]
        new.update(zip(unsolved, self.encode_words(unsolved), strict=True))
        for word, ids in new.items():
            self._know(word, ids)
        return [new[w] if ids is None else ids for w, ids in zip(words, out, strict=True)] if new else out

    def _line(self, line: str) -> list[str]:
        if _SIMPLE.fullmatch(line):
            return _SIMPLE_WORDS.findall(line.lower())
        # a space is never part of a word nor joined by NFC
        words = (w for chunk in line.split(" ") for w, _ in self._splitter.pre_tokenize_str(self._normalizer.normalize_str(chunk)))
        return [_END + w for w in words]

    def _plain(self, text: str) -> bytes:
        # nor is a line end
        line = text.replace("\n", " ")
        words = self._line(line) if _SIMPLE.fullmatch(line) else [w for part in text.split("\n") for w in self._line(part)]
        out = list(map(self._words.get, words))
        if None in out:
            out = [self._word(w) if ids is None else ids for w, ids in zip(words, out)]
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self._special is None or not any(s in text for s in self.specials):
            return self._plain(text)
        return b"".join(
            np.array([self.specials[part]], "<u4").tobytes() if part in self.specials else self._plain(part)
            for part in self._special.split(text)
        )

    def _stretches(self, stretches: pa.Array) -> tuple[np.ndarray, ...]:
        """The ids of distinct plain lower-cased stretches, and where each one's begin
        and how many it has. Stretches that are a known word need not be split; the
        others are split together, with line ends between."""
        if not len(stretches):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        texts = pc.binary_join(pa.ListArray.from_arrays([0, len(stretches)], stretches), pa.scalar("\n", stretches.type))[0].as_py().split("\n")
        packed = list(map(self._words.get, texts))
        size = np.fromiter((-1 if ids is None else len(ids) // 4 for ids in packed), np.int64, len(packed))
        unknown = np.flatnonzero(size < 0)
        words = _STRETCH_WORDS.findall("\n".join([texts[k] for k in unknown.tolist()]))
        parts = self._packed_words(words)
        upto = np.append(0, np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) // 4))
        line_ends = np.flatnonzero(np.fromiter(map("\n".__eq__, words), bool, len(words)))
        ends = upto[np.append(line_ends, len(words))]  # line ends have no ids
        known = [ids for ids in packed if ids is not None]
        size[unknown] = 0
        n_known = int(size.sum())
        first = np.cumsum(size) - size
        if len(unknown):
            size[unknown] = np.diff(ends, prepend=0)
            first[unknown] = n_known + ends - size[unknown]
        return np.frombuffer(b"".join([*known, *parts]), "<u4"), first, size

    def _slice(self, part: pa.Array) -> tuple[np.ndarray, ...]:
        """Of a slice of texts: whether each goes through the library, where its
        stretches end, which ones they are, and the distinct ones' ids and places."""
        odd = pc.match_substring_regex(part, _ODD).to_numpy(zero_copy_only=False)
        for s in self.specials:
            odd = odd | pc.match_substring(part, s).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", part) if odd.any() else part
        lists = pc.split_pattern(pc.replace_substring(pc.utf8_lower(plain), "\n", " "), " ")
        ends = lists.offsets.to_numpy()
        coded = pc.list_flatten(lists).dictionary_encode()
        return odd, ends - ends[0], coded.indices.to_numpy(), *self._stretches(coded.dictionary)

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of an Arrow array, in order."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        for part in slices(texts):
            odd, ends, which, flat, first, size = self._slice(part)
            # Arrow keeps the memory of a slice's columns, several times the texts, for later
            pa.default_memory_pool().release_unused()
            for k in range(len(part)):
                if odd[k]:
                    yield np.frombuffer(self.encode(part[k].as_py()), "<u4")
                    continue
                own = which[ends[k] : ends[k + 1]]
                n = size[own]
                upto = np.cumsum(n)
                yield flat[np.repeat(first[own] - upto + n, n) + np.arange(upto[-1] if len(upto) else 0)]

    def decode(self, ids: bytes | None) -> str:
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


@lru_cache(maxsize=1)
def encoder(path: str) -> PrefixBpe:
    return PrefixBpe(path)


on_handover(encoder.cache_clear)


def encoded(df: DataFrame, text_col: str = "text", path: str | None = None, ids: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """All columns of ``df`` with the token ids of ``text_col`` as binary
    (little-endian unsigned 32-bit) and, unless ``decoded`` is None, the text they
    decode to, special tokens kept. Rows go through in small slices, so a worker
    holds the ids and texts of few rows at a time."""
    path = path or default_vocabulary()
    names = df.columns
    inner = df.toDF(*(f"c{i}" for i in range(len(names))))
    at = names.index(text_col)
    added = ["_ids"] if decoded is None else ["_ids", "_decoded"]

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            ids_of = bpe.encode_all(batch.column(at))
            for start in range(0, batch.num_rows, SLICE // 4):
                part = batch.slice(start, SLICE // 4)
                packed = [x.tobytes() for x in islice(ids_of, part.num_rows)]
                columns = [*part.columns, pa.array(packed, pa.binary())]
                if decoded is not None:
                    columns.append(pa.array([bpe.decode(p) for p in packed], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *added])

    schema = T.StructType([*inner.schema.fields, *(T.StructField(c, T.BinaryType() if c == "_ids" else T.StringType()) for c in added)])
    return inner.mapInArrow(run, schema).toDF(*names, ids, *([] if decoded is None else [decoded]))


def bpe_encode(text: Column, path: str | None = None) -> Column:
    """Token ids of ``text`` as binary (little-endian unsigned 32-bit)."""
    path = path or default_vocabulary()

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        bpe = encoder(path)
        return pd.Series([bpe.encode(t) for t in texts], dtype=object)

    return encode(text)


def bpe_decode(ids: Column, path: str | None = None) -> Column:
    """Text of ids packed as by ``bpe_encode``; special tokens are kept."""
    path = path or default_vocabulary()

    @F.pandas_udf("string")
    def decode(packed: pd.Series) -> pd.Series:
        bpe = encoder(path)
        return pd.Series([bpe.decode(p) for p in packed], dtype=object)

    return decode(ids)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
