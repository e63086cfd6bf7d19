"""What the removal of repeated passages writes to disk, and what it passes on."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row

import corpus_pipeline
from termtide.llm import suffix_dedup

LETTERS = [chr(c) for c in range(0x21, 0x7F)]


def noise(draw, n):
    return "".join(draw.choices(LETTERS, k=n))


def shuffle_bytes(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = [files.apply(i) for i in range(files.size())]
    return sum(f.length() for f in files if f.getName().startswith("shuffle_"))


def test_passages_shuffle_texts_once(spark):
    draw = random.Random(1)
    passage = noise(draw, 200)
    rows = [(i, noise(draw, 3000) + passage + noise(draw, 3000), "en") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").coalesce(4)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        written = shuffle_bytes(spark)
        got = {r.doc_id: r.text for r in corpus_pipeline.drop_passages(spark, docs, "").collect()}
        written = shuffle_bytes(spark) - written
    finally:
        spark.conf.set(threshold, before)
    assert got[0] == rows[0][1]
    for i, text, _ in rows[1:]:  # a few more letters go where another text has the same beside the passage
        assert text.startswith(got[i][:2980]) and text.endswith(got[i][-2980:]) and 5980 <= len(got[i]) <= 6000
    # texts once, less than another time their size for all chunks, and little else
    assert written < 2.2 * sum(len(r[1]) for r in rows)


@pytest.mark.parametrize("shared", [False, True])
def test_passages_pass_on_every_column(spark, shared):
    draw = random.Random(2)
    long = noise(draw, 120) + "é" + noise(draw, 90)
    texts = [long, None, "", "short", noise(draw, 40) + long[20:], long]
    schema = "text string, `a.b` array<int>, doc_id int, also string, no_text date, n_chars bigint"
    rows = [(t, [i, None], 7 if shared and i > 2 else i, None if i % 2 else f"k{i}", None, None if t is None else len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, schema)
    left = corpus_pipeline.drop_passages(spark, docs, "")
    assert left.columns == docs.columns and [f.dataType for f in left.schema] == [f.dataType for f in docs.schema]
    cut = {4: texts[4][:40], 5: ""}
    expected = [Row(*(cut[i], *r[1:5], len(cut[i]))) if i in cut else Row(*r) for i, r in enumerate(rows)]
    assert sorted(map(tuple, left.collect()), key=lambda r: r[1][0]) == [tuple(r) for r in expected]


def test_columns_go_along_where_ids_are_shared(spark):
    draw = random.Random(3)
    text = noise(draw, 150)
    docs = spark.createDataFrame([(5, text, "x"), (5, text + "!", "y"), (None, text, "z")], "doc_id int, text string, `k.k` string")
    got = suffix_dedup.drop_repeats(docs, also=["k.k"]).select("doc_id", "n_removed", "also").collect()
    assert sorted((r.also[0], r.doc_id, r.n_removed) for r in got) == [("x", 5, 150), ("y", 5, 150), ("z", None, 0)]
    assert "also" not in suffix_dedup.drop_repeats(docs).columns


def test_a_slice_sends_on_one_chunk_of_a_kind():
    draw = random.Random(4)
    line, run = noise(draw, 300), "z" * 5000
    texts = [line, run, noise(draw, 80) + line + run, line]
    batch = pa.record_batch({"doc_id": pa.array([9, 3, 4, 1]), "text": pa.array(texts)})
    out = pa.Table.from_batches(suffix_dedup._slice_chunks(iter([batch]))).to_pylist()
    chunks = [(r["key"], r["whole"]) for r in out if r["ahead"] >= 0]
    assert len(chunks) == len(set(chunks)) < 100
    gone = {(r["doc_id"], r["start"], r["size"]) for r in out if r["ahead"] < 0}
    assert (9, 0, 300) in gone and (3, 1, 4999) in gone and len(gone) < 10 and not any(d == 1 for d, *_ in gone)


@pytest.mark.parametrize("rows_at_once", [1, 3, 1000])
def test_ranges_of_chunks_lose_nothing(rows_at_once, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_ROWS", rows_at_once)
    draw = np.random.default_rng(5)
    for _ in range(60):
        n = int(draw.integers(1, 40))
        rows = np.stack([draw.integers(0, 8, n), draw.integers(0, 3, n), np.arange(n), *draw.integers(0, 50, (2, n)), draw.integers(100, 160, n)])
        rows[4, draw.random(n) < 0.2] = -1
        rows = rows[:, np.lexsort(rows[:4][::-1])]
        kind = rows[0] * 10 + rows[1]
        # ranges part no kind
        ends = [i for i in range(1, n) if kind[i] != kind[i - 1] and draw.random() < 0.3]
        out = []
        for part in np.split(rows, ends, axis=1):
            batches = [pa.record_batch([pa.array(c) for c in p], suffix_dedup._NAMES) for p in np.array_split(part, 3, axis=1)]
            out += [tuple(r.values()) for b in suffix_dedup._placed_chunks(iter(batches)) for r in b.to_pylist()]
        known = rows[4] == -1
        own = {tuple(r): [] for r in rows[:2, ~known].T.tolist()}
        for r in rows[:, ~known].T.tolist():
            own[r[0], r[1]].append(tuple(r))
        first = [k[0] for k in own.values()]
        gone = sorted((*r[2:4], r[5]) for r in [*rows[:, known].T.tolist(), *(x for k in own.values() for x in k[1:])])
        assert sorted((*r[2:4], r[5]) for r in out if r[4] == -1) == gone
        kept = [r for r in out if r[4] != -1]
        keys = [r[0] for r in first]
        assert len(kept) == len(set(kept)) and set(kept) <= set(first)
        assert {r for r in first if keys.count(r[0]) > 1} <= set(kept)
        assert sum(keys.count(r[0]) == 1 for r in kept) <= 2 * (len(ends) + 1)
