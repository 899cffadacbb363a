"""Suffix dedup, exact dedup and the n-gram join against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pizarra.llm import exact_dedup, ngram_join, suffix_dedup
from pizarra.llm.components import components


def ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def repeats_by_hand(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(b[s : s + length] for b in raws for s in range(len(b) - length + 1))
    out = []
    for b in raws:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        runs = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if len(b) else b""
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def suffix_result(df, **kw):
    rows = suffix_dedup.remove_repeats(df, **kw).collect()
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows)


def expected_suffix(rows, length=200):
    return sorted((r[0] is None, r[0] or 0, *x) for r, x in zip(rows, repeats_by_hand([r[1] for r in rows], length)))


def test_suffix_dedup(docs, sample):
    assert suffix_result(docs(sample, extra=["rid", "h", "spans"])) == expected_suffix(sample)


def test_suffix_dedup_groups_dealt_over_blocks(docs, sample, monkeypatch):
    """Groups of more contexts than a block takes lose no repeat."""
    monkeypatch.setattr(suffix_dedup, "GROUP", 2)
    monkeypatch.setattr(suffix_dedup, "STRETCH", 1000)
    assert suffix_result(docs(sample)) == expected_suffix(sample)


def test_suffix_dedup_other_length(docs, sample):
    assert suffix_result(docs(sample), length=60, gram=20) == expected_suffix(sample, 60)


def test_suffix_dedup_empty(docs):
    assert suffix_result(docs([])) == []


def test_suffix_order_survives_hash_collisions(monkeypatch):
    """With a useless hash base the order still comes out by the bytes."""
    monkeypatch.setattr(suffix_dedup, "_BASE", np.uint64(0))
    r = np.random.RandomState(0)
    symbols = r.randint(1, 3, (60, 12)).astype(np.uint16)
    group = np.sort(r.randint(0, 4, 60))
    order, common = suffix_dedup.suffix_order(symbols, group)
    rows = [(group[i], *symbols[i]) for i in order]
    assert rows == sorted(rows)
    for k in range(1, 60):
        a, b = symbols[order[k - 1]], symbols[order[k]]
        same = group[order[k - 1]] == group[order[k]]
        assert common[k] == (0 if not same else 12 if (a == b).all() else int((a != b).argmax()))


def exact_by_hand(rows):
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[ascii_lower(r[1] or "")].append((r[0] if r[0] is not None else -1, i))
    return sorted(
        ((r[0] is None, r[0] or 0), max(x[0] for x in groups[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest())
        for r in rows
        for t in [ascii_lower(r[1] or "")]
    )


@pytest.mark.parametrize("block", [4096, 16])
def test_exact_dedup(docs, sample, block):
    got = exact_dedup.exact_groups(docs(sample, extra=["rid", "name"]), block_bytes=block).collect()
    out = sorted(((r["id"] is None, r["id"] or 0), -1 if r["keep_id"] is None else r["keep_id"], r["group_size"], r["text_sha256"]) for r in got)
    assert out == exact_by_hand(sample)
    # exactly one row of each group stays, and it has the largest id
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len({r["text_sha256"] for r in got})
    assert all(r["id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_dedup_keep(docs, sample):
    df = docs(sample, extra=["rid", "c0"])
    kept = exact_dedup.exact_dedup_keep(df)
    assert kept.columns == df.columns
    assert kept.count() == len({ascii_lower(r[1] or "") for r in sample})
    assert exact_dedup.exact_dedup_keep(docs([])).count() == 0


def test_exact_dedup_is_native(docs, sample, capsys):
    exact_dedup.exact_groups(docs(sample)).explain()
    assert "Python" not in capsys.readouterr().out


def near_by_hand(rows, n, percent):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(r[1] or ""))
        sets.append(frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    smallest = defaultdict(list)
    for i, r in enumerate(rows):
        smallest[find(i)].append(r[0])
    return sorted(
        (r[0] is None, r[0] or 0, len(sets[i]), min((x for x in smallest[find(i)] if x is not None), default=-1)) for i, r in enumerate(rows)
    )


@pytest.mark.parametrize("n,percent,block,cell", [(4, 85, 768, 16), (5, 80, 768, 16), (4, 85, 3, 2), (3, 60, 768, 4), (2, 40, 5, 16)])
def test_ngram_join(docs, sample, monkeypatch, n, percent, block, cell):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "CELL", cell)
    got = ngram_join.near_groups(docs(sample, extra=["rid", "n", "rep"]), n=n, percent=percent).collect()
    out = sorted((r["id"] is None, r["id"] or 0, r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in got)
    assert out == near_by_hand(sample, n, percent)


def test_near_dedup_keep(docs, sample):
    df = docs(sample, extra=["rid", "c1"])
    kept = ngram_join.near_dedup_keep(df)
    assert kept.columns == df.columns
    labels = ngram_join.near_groups(df)
    assert kept.count() == labels.where("stays").count()
    assert labels.where("stays and id is not null and id <> component_id").count() == 0
    assert ngram_join.near_dedup_keep(docs([])).count() == 0


def test_cells_over_small_batches(spark, docs, sample):
    """A run of rows that spans several Arrow batches pairs as in one."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        got = ngram_join.near_groups(docs(sample)).collect()
    finally:
        spark.conf.set(key, old)
    out = sorted((r["id"] is None, r["id"] or 0, r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in got)
    assert out == near_by_hand(sample, 4, 85)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40, 80)] + [(5, 90), (90, 6), (1, 2), (2, 1), (3, 3), (200, 100), (200, 150), (150, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 40 for i in range(40, 81)}, 5: 5, 90: 5, 6: 5, 1: 1, 2: 1, 200: 7, 100: 7, 150: 7, 7: 7}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [1 << 20, 8])
def test_components_in_blocks(spark, monkeypatch, block):
    """One block of links is settled by its contraction; several go on to star joins."""
    from pizarra.llm import components as module

    rounds = []
    star_joins = module._star_joins
    monkeypatch.setattr(module, "LINKS", block)
    monkeypatch.setattr(module, "_star_joins", lambda links: rounds.append(links.count()) or star_joins(links))
    chain = [(k, k + 1) for k in range(100, 140)]
    links = chain + chain[::-1] + [(900 - k, 900) for k in range(1, 12)] + [(7, 3), (3, 5), (5, 5), (60, 60), (5, 140), (None, 4)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert got == {k: 3 for k in (3, 5, 7, *range(100, 141))} | {k: 889 for k in range(889, 901)}
    assert bool(rounds) == (block == 8)


@pytest.mark.parametrize("kind", ["repartitioned", "joined", "unioned", "sorted"])
def test_any_frame_gives_the_rows_of_a_file(docs, sample, kind):
    """Row numbers agree in all branches, also where the frame is no file scan."""
    rows = [(k, text) for k, (_, text) in enumerate(sample) if text is None or len(text) < 20_000]
    file = docs(rows, files=3)
    frame = {
        "repartitioned": lambda: file.repartition(7),
        "joined": lambda: file.join(file.where("doc_id % 2 < 2").select("doc_id"), "doc_id"),
        "unioned": lambda: file.where("doc_id % 3 = 0").repartition(2, "text").unionByName(file.where("doc_id % 3 <> 0")),
        "sorted": lambda: file.orderBy("text"),
    }[kind]()
    for keep in (exact_dedup.exact_dedup_keep, ngram_join.near_dedup_keep):
        assert sorted(map(tuple, keep(frame).collect()), key=repr) == sorted(map(tuple, keep(file).collect()), key=repr)
    removed = [sorted((r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(f).collect()) for f in (file, frame)]
    assert removed[0] == removed[1]


def test_near_copies_are_compared_with_one_member(spark, docs, monkeypatch):
    """A large family of near copies costs a comparison each; its strangers are still found."""
    r = random.Random(12)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(4000)]
    base, other = r.sample(words, 200), r.sample(words, 150)
    rows = []
    for i in range(400):
        w = list(base)
        w[r.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join([*base[:60], *other[: 140 - i]])) for i in range(3)]
    monkeypatch.setattr(ngram_join, "BLOCK", 50)
    monkeypatch.setattr(ngram_join, "CELL", 4)
    cells = []
    plain = ngram_join._cells
    monkeypatch.setattr(ngram_join, "_cells", lambda rows, kind, *a: cells.append((kind, rows)) or plain(rows, kind, *a))
    got = ngram_join.near_groups(docs(rows)).collect()
    out = sorted((r["id"] is None, r["id"], r["n_shingles"], r["component_id"]) for r in got)
    assert out == near_by_hand(rows, 4, 85)
    star = sum(rows.count() for kind, rows in cells if kind == ngram_join.STAR)
    across = sum(rows.count() for kind, rows in cells if kind != ngram_join.STAR)
    assert star >= 400 and across < 3 * star


def test_bitmap(spark):
    from pizarra.llm.common import bitmap

    df = spark.range(5000).selectExpr("id * 7 as rid")
    place = lambda bits: mixed(bits)

    def mixed(bits):
        from pyspark.sql import functions as F

        return F.pmod(F.xxhash64("rid"), F.lit(bits))

    for most, wanted in ((1 << 27, 1 << 17), (1 << 16, 1 << 16)):
        packed, bits = bitmap(df, place, most)
        marks = np.frombuffer(packed, np.uint8)
        at = np.array([r[0] for r in df.select(mixed(bits)).collect()])
        assert bits == wanted == 8 * len(packed) and ((marks[at >> 3] >> (at & 7)) & 1).all()
        assert int(np.unpackbits(marks).sum()) == len(set(at.tolist()))
    assert bitmap(df.where("rid < 0"), place, 1 << 20) == (bytes(8192), 1 << 16)
