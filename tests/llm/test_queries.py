"""The registered queries' contract columns, computed by hand on a small folder."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry

from .conftest import DOCS
from .test_corpus import variants_by_hand
from .test_dedup import ascii_lower, near_by_hand, repeats_by_hand
from .test_text import library, pii_by_hand, quality_by_hand


@pytest.fixture
def folder(spark, sample, tmp_path):
    """(rows, folder): a documents table of unique ids; with personal data."""
    texts = [t for _, t in sample if t is None or len(t) < 3000]
    texts += [f"{texts[i][:300]} mail u{i}@example.com, 10.0.0.{i} +1 (825) 555-47{i:02d} 4444-3333-2222-1111" for i in range(10)]
    rows = [(3 * k, t, "en", "s", None) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return [(i, t) for i, t, *_ in rows], str(tmp_path)


def run(spark, name, sf_dir):
    return {r["doc_id"]: r.asDict() for r in entry.queries()[name](spark, sf_dir).collect()}


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_op1_and_op2_and_op6(spark, folder):
    rows, sf_dir = folder
    got = run(spark, "op1_suffix_dedup", sf_dir)
    want = repeats_by_hand([t for _, t in rows], 200)
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == {i: w for (i, _), w in zip(rows, want)}
    groups = defaultdict(list)
    for i, t in rows:
        groups[ascii_lower(t or "")].append(i)
    got = run(spark, "op2_exact_dedup", sf_dir)
    for i, t in rows:
        same = groups[ascii_lower(t or "")]
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(same), len(same), i == max(same), sha(ascii_lower(t or "")))
    got = run(spark, "op6_ngram_join", sf_dir)
    assert sorted((False, i, r["n_shingles"], r["component_id"]) for i, r in got.items()) == near_by_hand(rows, 4, 85)


def test_op5_and_op7(spark, folder):
    rows, sf_dir = folder
    theirs = library()
    got = run(spark, "op5_bpe", sf_dir)
    for i, t in rows:
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        decoded = theirs.decode(ids, skip_special_tokens=False)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(decoded))
    pieces = defaultdict(list)
    for r in entry.queries()["op7_packing"](spark, sf_dir).collect():
        pieces[r["doc_id"]].append(r)
    for i, t in rows:
        ids = [*theirs.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : at], "<u4").tobytes())
        assert at == len(ids)


def test_op8_and_op10(spark, folder):
    rows, sf_dir = folder
    quality, pii = run(spark, "op8_quality_rules", sf_dir), run(spark, "op10_pii", sf_dir)
    for i, t in rows:
        r = quality[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) == quality_by_hand(t)
        base = pii_by_hand(t)
        r, joined = pii[i], [f"{k}:{s}:{e}" for k, s, e in base]
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(b[0] == k for b in base) for k in ("email", "ip", "card", "phone")]
        assert r["base_sha256"] == sha(",".join(joined))
        spans = r["spans"].split(",") if r["spans"] else []
        assert spans[: len(joined)] == joined and r["n_spans"] == len(spans)


def test_op11_and_op13(spark, folder):
    rows, sf_dir = folder
    found = entry.queries()["op11_spelling_variants"](spark, sf_dir).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found} == variants_by_hand(rows)
    mixed = run(spark, "op13_mixing", sf_dir)
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows}
    assert {i: r["size"] for i, r in mixed.items()} == words and len(mixed) == len(rows)
    total = sum(words.values())
    # one source: its target is 150 % of its size
    assert all(r["source_size"] == total and r["target"] == 1.5 * total and 0 <= r["taken"] <= 2 * r["size"] for r in mixed.values())
    assert abs(sum(r["taken"] for r in mixed.values()) - 1.5 * total) <= 0.5
