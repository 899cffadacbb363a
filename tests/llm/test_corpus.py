"""Operators on corpus counts (spelling variants, divergence, mixing) against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from pizarra.llm import divergence, mixing, spelling

from .conftest import DOCS


def by_sql(sql, df):
    """Rows of a DuckDB query over a documents table, as sorted tuples by column name."""
    con = duckdb.connect()
    documents = df.toArrow()  # noqa: F841  (read by DuckDB)
    con.execute("CREATE TABLE documents AS SELECT * FROM documents")
    found = con.sql(sql)
    return sorted((tuple(v for _, v in sorted(zip(found.columns, row))) for row in found.fetchall()), key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


@pytest.fixture
def table(spark):
    """Rows (doc_id, text, lang, source) as a documents table with clashing columns."""

    def make(rows):
        df = spark.createDataFrame([(*r, None) for r in rows], DOCS).repartition(3)
        for name in ("n", "word", "size", "p", "key", "taken", "target"):
            df = df.withColumn(name, df["doc_id"])
        return df

    return make


# --- spelling variants


def variants_by_hand(rows, min_length=5, min_count=3):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            if h % 97 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            counts[low] += 1
    n = {w: k for w, k in counts.items() if len(w) >= min_length and k >= min_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out = {}
    for w in n:
        found = [x for x in n if near(w, x)]
        best = min(found, key=lambda x: (-n[x], x), default=None)
        out[w] = (best if best and n[best] >= 2 * n[w] else None, len(found))

    def root(w):
        return root(out[w][0]) if out[w][0] else w

    return {w: (form, root(w), n[w], k, n.get(form)) for w, (form, k) in out.items()}


def variants_of(df, **kwargs):
    found = spelling.variants(df, **kwargs).collect()
    assert len(found) == len({r["word"] for r in found})
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found}


def spelling_rows():
    r = random.Random(3)
    words = ["".join(r.choice("aabé÷") for _ in range(r.randint(4, 7))) for _ in range(300)]
    words += ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "Abcde", "abcdé"]
    rows = [(i, " ".join(r.choices(words, weights=[1 + 50 // (1 + k) for k in range(len(words))], k=150)) + ".") for i in range(60)]
    long = "ab" * 1500
    rows += [(100 + i, f"{long} {long[:-1]}c {'a' * 700} {'a' * 701} x{i}") for i in range(4)]
    rows += [(None, words[0] + " " + words[1]), (None, None), (7, ""), (7, "hello hello hello HELLO hallo hallo hallo"), (8, "İstanbul ſtrasse " * 3)]
    return rows


def test_variants_against_brute_force(table):
    rows = spelling_rows()
    want = variants_by_hand(rows)
    df = table([(*r, "en", "s") for r in rows])
    assert variants_of(df) == want
    assert sum(v[0] is not None for v in want.values()) > 20 and len({v[1] for v in want.values()}) < len(want)
    # keys refined down to the last place, and many shards
    assert variants_of(df, block=4) == want
    assert variants_of(df, min_length=3, min_count=2, block=50) == variants_by_hand(rows, 3, 2)


def test_variants_hot_half(table):
    """Many words of one beginning (and of one end) are refined, not compared pair by pair."""
    r = random.Random(4)
    ends = {"".join(r.choice("abcd") for _ in range(8)) for _ in range(700)}
    rows = [(i, " ".join("internat" + e for e in ends) + " " + " ".join(e + "isation" for e in list(ends)[:300])) for i in range(4)]
    df = table([(*r, "en", "s") for r in rows])
    assert variants_of(df, block=100) == variants_by_hand(rows)
    words = spelling.vocabulary(df.selectExpr("cast(doc_id as string) id", "text"))
    keys = spelling.meeting_keys(words, block=100).groupBy("key").count()
    assert keys.agg({"count": "max"}).first()[0] <= 100


def test_variants_chain_and_empty(table):
    """Forms lead on to forms; ties go to the smallest word."""
    chain = ["aaaaaaaa", "aaaaaaab", "aaaaaabb", "aaaaabbb", "aaaabbbb"]
    rows = [(-5, " ".join(w for k, w in enumerate(chain) for _ in range(3 * 2**k)) + " bbbbb bbbbc bbbbd " * 3)]
    got = variants_of(table([(*r, "en", "s") for r in rows]))
    assert got == variants_by_hand(rows)
    assert got["aaaaaaaa"][:2] == ("aaaaaaab", "aaaabbbb") and got["bbbbb"] == (None, "bbbbb", 3, 2, None)
    assert variants_of(table([])) == {} and variants_of(table([(1, None, None, None), (2, "", "", "")])) == {}


def test_suffix_order():
    r = random.Random(1)
    for _ in range(30):
        text = [r.choice([1, 2]) for _ in range(r.randint(0, 60))]
        text = np.array([x + 1 for x in text] + [0], np.int64)
        assert spelling.suffix_order(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


# --- divergence


def divergence_by_hand(rows, threshold=3, top=200):
    docs, counts = defaultdict(set), Counter()
    for k, (_, text, lang, source) in enumerate(rows):
        for term in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""):
            term = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in term)
            docs[lang or "", term].add(k)
            counts[lang or "", source or "", term] += 1
    out = []
    groups = {(lang or "", source or "") for _, _, lang, source in rows}
    for lang in {g for g, _ in groups}:
        kept = [t for (g, t), d in docs.items() if g == lang and len(d) >= threshold]
        sources = sorted(s for g, s in groups if g == lang)
        n = {s: {t: counts[lang, s, t] for t in kept} for s in sources}
        n[None] = {t: sum(n[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (k + 1) // (sum(c.values()) + len(kept)) for t, k in c.items()} for s, c in n.items()}
        gap = lambda a, b, t: (a[t] - b[t]) ** 2 // b[t]
        for s in sources:
            pairs = [(o, sum(gap(p[s], p[o], t) for t in kept)) for o in sources if o != s]
            terms = [(t, gap(p[s], p[None], t)) for t in kept if n[s][t] and p[s][t] > p[None][t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(x, lang, part, k + 1, s, v) for k, (x, v) in enumerate(found[:limit])]
    return sorted(out, key=repr)


def divergence_rows():
    r = random.Random(6)
    words = ["".join(r.choice("abcé漢Ñ") for _ in range(r.randint(1, 12))) for _ in range(150)] + ["a" * 4, "a" * 8, "a" * 9, "a" * 16, "a" * 17, "q" * 300]
    rows = []
    for i in range(90):
        weights = [1 + (hash((k * 7 + i % 4) % 11) % 9) * 3 for k in range(len(words))]
        text = " ".join(r.choices(words, weights=weights, k=r.randint(0, 60))) + "; Abc [x] aBC{y}"
        rows.append((i, text, ["en", "de", None][i % 3 % 3], ["s1", "s2", "S3", None][i % 4]))
    rows += [(200, None, "en", "silent"), (201, "", "xx", "one"), (202, "only here", "xx", "two"), (None, "a b c", None, None), (5, rows[5][1], "en", "s1")]
    return rows + [(300 + i, "long " + "é" * 2000 + f" {i}", "en", "s1") for i in range(3)]


def test_divergence_against_brute_force_and_sql(table):
    rows = divergence_rows()
    df = table(rows)
    want = divergence_by_hand(rows)
    assert rows_of(divergence.divergence(df)) == want
    assert by_sql(divergence.ORACLE, df.select("doc_id", "text", "lang", "source")) == want
    assert rows_of(divergence.divergence(df, threshold=8, top=5)) == divergence_by_hand(rows, 8, 5)


def test_divergence_levels_and_filter(table, monkeypatch):
    """Counts handed on at every batch and a filter that lets everything through change nothing."""
    rows = divergence_rows()
    df = table(rows)
    docs = df.selectExpr("cast(coalesce(text, '') as binary) text", "coalesce(lang, '') lang", "coalesce(source, '') source")
    plain = rows_of(divergence.kept_terms(docs))
    monkeypatch.setattr(divergence, "live_filter", lambda live: (b"\xff" * 8192, 1 << 16))
    monkeypatch.setattr(divergence, "HELD", 1)
    assert rows_of(divergence.kept_terms(docs, first=2)) == plain
    assert rows_of(divergence.kept_terms(docs, first=1)) == plain


def test_live_filter(spark):
    packed, bits = divergence.live_filter(spark.createDataFrame([("en", b"abcd"), ("", b"\xc3\xa9xy")], "lang string, key binary"))
    assert bits == 1 << 16 and sum(b.bit_count() for b in packed) == 2
    for lang, key in (("en", b"abcd"), ("", b"\xc3\xa9xy")):
        place = zlib.crc32(lang.encode() + b"\0" + key) & (bits - 1)
        assert packed[place >> 3] >> (place & 7) & 1


def test_divergence_deals_each_level_once(table, monkeypatch):
    """Counts and the test on them find the rows of a key in one place, without another shuffle."""
    plans, cut = [], divergence.cut
    monkeypatch.setattr(divergence, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    df = table(divergence_rows())
    divergence.kept_terms(df.selectExpr("cast(coalesce(text, '') as binary) as text", "coalesce(lang, '') as lang", "coalesce(source, '') as source"))
    assert len(plans) > 1
    assert [p.count("Exchange hashpartitioning") for p in plans] == [1] * len(plans)


def test_divergence_term_bytes():
    """Terms are split off byte by byte as the contract's expression does."""
    term = re.compile(rb"[A-Za-z\x80-\xff]+")
    for text in (bytes(range(256)), b"", b"\x85a\xa0 Z@[`{\x7fz", "Ñandú \u00a0École\u2003x".encode()):
        assert text.translate(divergence.TERM_BYTES).split() == term.findall(text.lower())


def test_divergence_terms_of_slices(monkeypatch):
    """Texts are split, coded and counted as columns, slice by slice; no term crosses texts."""
    term = re.compile(rb"[A-Za-z\x80-\xff]+")
    texts = ["", "Ab cd", "ab", "  x-Y ", "", "Ñandú z" * 9, "\u2003", "end"]
    column = pa.array([t.encode() for t in ["left out", *texts, "too"]], pa.large_binary()).slice(1, len(texts))
    monkeypatch.setattr(divergence, "SLICE_BYTES", 8)
    assert divergence._parts(column) == [(0, 3), (3, 5), (5, 6), (6, 8)]
    got = defaultdict(list)
    for start, stop in divergence._parts(column):
        for row, found in zip(*divergence._terms(column.slice(start, stop - start))):
            got[start + int(row)].append(found.as_py())
    assert got == {k: term.findall(t.encode().lower()) for k, t in enumerate(texts) if term.search(t.encode())}


def test_divergence_discards_rare_prefixes(table):
    """A prefix of too few documents is not extended: the level after holds none of its terms."""
    rows = [(i, f"common rare{chr(97 + i)}term commonplace", "en", f"s{i % 2}") for i in range(6)] + [(9, "zzzzlonely zzzzalone", "en", "s0")]
    docs = table(rows).selectExpr("cast(text as binary) text", "lang", "source")
    live = docs.sparkSession.createDataFrame([("en", b"comm"), ("en", b"rare")], "lang string, key binary")
    packed, bits = divergence.live_filter(live)
    level = divergence.count_prefixes(docs, 4, 8, docs.sparkSession.sparkContext.broadcast(packed), bits)
    keys = {bytes(r["key"]) for r in level.collect()}
    assert keys == {b"common", b"commonpl"} | {b"rare%cter" % (97 + i) for i in range(6)}


def test_divergence_empty(table):
    assert divergence.divergence(table([])).count() == 0
    got = rows_of(divergence.divergence(table([(1, "a", "en", "x"), (2, None, "en", "y")])))
    assert got == [("x", "en", "pair", 1, "y", 0), ("y", "en", "pair", 1, "x", 0)]


# --- mixing


def targets_by_hand(sizes):
    """The rule as it is told: shares by weight, excess over the cap shared again."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    open_, left, out = set(order), 1.5 * sum(sizes.values()), {}
    while True:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        above = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not above:
            return out | share
        for s in above:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.remove(s)
        if not open_:
            return out


def mixing_rows():
    r = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(r.choice([0, 1, 3, 20, 150]))), "en", r.choice(["a", "b", "é", "z", "Z", None])) for i in range(400)]
    rows += [(1000 + i, "x " * 40, "en", "huge") for i in range(300)]  # equal sizes
    rows += [(7, "p q", "en", "a"), (7, "p q", "en", "a"), (None, "n n n", "en", None), (8, None, "en", "empty"), (9, " \t\n", "en", "empty"), (10, "word " * 20000, "en", "b")]
    return rows


def test_mixing(table):
    rows = mixing_rows()
    df = table(rows)
    got = mixing.mix(df).collect()
    assert sorted((r["id"] is None, r["id"] or 0, r["size"]) for r in got) == sorted((i is None, i or 0, len(t.split()) if t else 0) for i, t, _, _ in rows)
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += len((text or "").split())
    want = targets_by_hand(sizes)
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in sizes), (taken, want)
    assert rows_of(mixing.mix(df.repartition(7))) == rows_of(mixing.mix(df))
    single = df.where("doc_id is not null and doc_id <> 7")  # SQL and Spark number repeated ids in different orders
    columns = mixing.mix(single).selectExpr("id doc_id", "size", "source_size", "target", "taken")
    assert rows_of(columns) == by_sql(mixing.ORACLE, single.select("doc_id", "text", "lang", "source"))


def test_mixing_weights(table):
    """Heavier documents come more often; shares follow the inclusion probabilities."""
    df = table([(i, "w " * 10, "en", "s" if i % 2 else "t") for i in range(4000)])
    weight = mixing.F.when(mixing.F.col("id") % 4 < 2, 3)
    got = mixing.mix(df, share=0.5, weights=(1,), document_weight=weight).toPandas()
    got["heavy"] = got["id"] % 4 < 2
    assert got["taken"].sum() == 20_000
    share = got.groupby("heavy")["taken"].sum() / 20_000
    assert 0.70 < share[True] < 0.80 and 0.20 < share[False] < 0.30
    whole = mixing.mix(df, share=2.0, weights=(1,), document_weight=weight).toPandas()
    assert (whole["taken"] == 20).all()
    again = mixing.mix(df, share=0.5, weights=(1,), document_weight=weight, seed="other").toPandas()
    assert set(got["id"][got["taken"] > 0]) != set(again["id"][again["taken"] > 0])


def test_mixing_empty(table):
    assert mixing.mix(table([])).count() == 0
    got = mixing.mix(table([(1, None, "en", "a"), (2, "", None, None)])).collect()
    assert sorted((r["id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_mixing_targets_by_hand(spark):
    r = random.Random(9)
    for _ in range(6):
        sizes = {f"s{k}" if k else None: r.choice([0, 1, 5, 100, 1000, 10_000]) for k in range(r.randint(1, 9))}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {x["source"]: x["target"] for x in mixing.targets(df).collect()}
        assert got == pytest.approx(targets_by_hand(sizes))
