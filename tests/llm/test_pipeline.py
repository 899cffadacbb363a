"""The pipeline, stage by stage, against brute force on a small table."""

import zlib

import numpy as np
import pytest

import corpus_pipeline

from .test_dedup import ascii_lower, near_by_hand
from .test_text import library, pii_by_hand, quality_by_hand

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture
def corpus(sample):
    rows = [r for r in sample if r[0] != 500]  # by hand, the windows of the longest text take too long
    secret = "ab12cd34ef56ab78cd90ef12"
    for i in range(30):
        text = rows[i][1]
        rows.append((700 + i, f"{i} {text[:400]} mail u{i}@example.com at 10.0.0.{i} token = \"{secret}\" call +1 (825) 555-4756 {text[::-1][:500]}"))
    return rows


def staged(spark, df, path):
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, df, "").write.parquet(f"{path}/{name}")
        df = spark.read.parquet(f"{path}/{name}")
        yield name, df


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "ngram_join", "pii", "packing"]


def test_pipeline_by_hand(spark, docs, corpus, tmp_path):
    found = dict(staged(spark, docs(corpus), str(tmp_path / "out")))
    assert all(df.columns == COLUMNS for name, df in found.items() if name != "packing")
    ids = {name: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in df.collect()) for name, df in found.items() if name != "packing"}

    kept = [r for r in corpus if quality_by_hand(r[1])[-1]]
    assert ids["quality_rules"] == sorted((r[0] is None, r[0] or 0, r[1]) for r in kept)

    last = {}
    for r in kept:
        key = ascii_lower(r[1])
        if key not in last or (r[0] if r[0] is not None else -1) >= (last[key][0] if last[key][0] is not None else -1):
            last[key] = r
    unique = list(last.values())
    assert ids["exact_dedup"] == sorted((r[0] is None, r[0] or 0, r[1]) for r in unique)

    labels = near_by_hand(unique, 5, 80)
    stays = {component if component >= 0 else None for *_, component in labels}
    assert sorted({x[1] for x in ids["ngram_join"] if not x[0]}) == sorted(x for x in stays if x is not None)
    assert len(ids["ngram_join"]) == len({(c if c >= 0 else f"null{i}") for i, (*_, c) in enumerate(labels)})

    before = {x[1]: x[2] for x in ids["ngram_join"] if not x[0]}
    after = {x[1]: x[2] for x in ids["pii"] if not x[0]}
    assert set(before) == set(after)
    for i, text in before.items():
        base = pii_by_hand(text)
        assert (after[i] == text) == (not base and "token =" not in text)
        assert not any(text[s:e] in after[i] for _, s, e in base)
        if i >= 700:
            assert "ab12cd34ef56ab78cd90ef12" not in after[i]

    theirs, pieces = library(), {}
    for r in found["packing"].collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    assert {i for i in pieces if i is not None} == set(after)
    for i, text in after.items():
        tokens, at = theirs.encode(text, add_special_tokens=False).ids + [2], 0
        for p in sorted(pieces[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(np.array(tokens[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(tokens)


def test_run_gives_the_last_stage(spark, docs, corpus, tmp_path):
    docs(corpus).write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "sf"))
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(got.columns)
    *_, (_, last) = staged(spark, spark.read.parquet(str(tmp_path / "sf" / "documents.parquet")), str(tmp_path / "again"))
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(str, got.select(key).collect())) == sorted(map(str, last.select(key).collect()))


def test_pipeline_of_nothing(spark, docs, tmp_path):
    assert [df.count() for _, df in staged(spark, docs([]), str(tmp_path / "out"))] == [0] * 5
