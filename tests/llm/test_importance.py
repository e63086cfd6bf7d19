"""Importance resampling against plain counting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from termtide.llm import importance
from termtide.llm.queries import ORACLE, QUERIES

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, ngrams=2):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return [" ".join(words[i : i + n]) for n in range(1, ngrams + 1) for i in range(len(words) - n + 1)], len(words)


def bucket(feature, buckets):
    return zlib.crc32(feature.encode()) % buckets


def truth(docs, target, buckets=10_000, ngrams=2, percent=25, min_words=20):
    s, t = Counter(), Counter()
    for counts, rows in ((s, [d[1] for d in docs]), (t, target)):
        for text in rows:
            counts.update(bucket(f, buckets) for f in features(text, ngrams)[0])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        found, n_words = features(text, ngrams)
        weight = sum(gain[bucket(f, buckets)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, None, n_words])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, row in enumerate(able[: percent * len(able) // 100]):
        row[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def some_texts(rng, n):
    vocabulary = [f"{a}{b}" for a in ("the", "Über", "日本", "x9", "don") for b in ("", "a", "Zz", "ß", "0")]
    gaps = [" ", "  ", "\n", "-", "'", "\t.", "\x7f", "@"]
    return ["".join(rng.choice(vocabulary) + rng.choice(gaps) for _ in range(rng.randrange(60))) for _ in range(n)]


def of_op(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_query_and_sql_against_plain_counting(spark, tmp_path):
    rng = random.Random(4)
    texts = [None, "", " .,", "one", "One TWO", "éÀ é", *some_texts(rng, 90)]
    docs = [*enumerate(texts), (200, texts[20]), (201, texts[20])]
    target = [None, "", "the über 日本", *some_texts(rng, 5)]
    spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    rows = list(enumerate(target))
    spark.createDataFrame(rows, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = truth(docs, target)
    assert of_op(QUERIES["op13_importance"](spark, str(tmp_path))) == want
    with duckdb.connect() as con:
        for name in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path / name}.parquet/*.parquet'")
        cursor = con.execute(ORACLE["op13_importance"])
        names = [d[0] for d in cursor.description]
        order = [names.index(c) for c in ("doc_id", "n_features", "weight", "score", "rank")]
        assert sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=repr) == want


@pytest.mark.parametrize("ngrams", [1, 3])
def test_other_parameters_repeated_and_missing_ids(spark, ngrams):
    rng = random.Random(ngrams)
    docs = [(i % 20 if i else None, t) for i, t in enumerate(some_texts(rng, 40))] + [(3, "same text")] * 2
    target = some_texts(rng, 3)
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id bigint, body string, score int, rank int")
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(table, aims, text="body", ngrams=ngrams, buckets=50, min_words=5, percent=40)
    assert of_op(got) == truth(docs, target, 50, ngrams, 40, 5)
    words = sorted((r.n_words for r in got.collect()))
    assert words == sorted(features(t)[1] for _, t in docs)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    assert importance.resample(none, some).count() == 0
    assert of_op(importance.resample(some, none, min_words=1, percent=100)) == truth([(1, "a b c")], [], percent=100, min_words=1)


def test_sums_of_rows_of_any_length():
    rng = np.random.default_rng(2)
    sizes = [0, 1, 1, 7, 7, 300, 8192, 8193, 20_000, 20_000, 40_961]
    values = [rng.integers(0, 256, n, np.uint8).tobytes() for n in sizes]
    assert importance.crc32_of(pa.array(values, pa.large_binary())).tolist() == [zlib.crc32(v) for v in values]


@pytest.mark.parametrize("ngrams", [1, 2, 3])
def test_long_texts_in_slices(monkeypatch, ngrams):
    monkeypatch.setattr(importance, "SLICE_BYTES", 64)
    rng = random.Random(8)
    texts = [" ".join(some_texts(rng, 9)), "w" * 500, ("a" * 70 + " ") * 5, "b " * 200, "." * 300, "one " + "." * 400 + "two"]
    for text in texts:
        got, words = Counter(), 0
        for places, _, held in importance.batch_buckets(pa.array([text]), ngrams, 997):
            got.update(places.tolist())
            words += int(held.sum())
        found, n_words = features(text, ngrams)
        assert got == Counter(bucket(f, 997) for f in found) and words == n_words
