"""What near-duplicate detection shuffles."""

import random

from pyspark.sql import functions as F

from termtide.llm import bitmaps, minhash


def test_bitmap_marks_every_id_and_few_others(spark):
    rows = spark.range(60_000).selectExpr("if(id = 7, null, id) as rep", "'x' as _map", "id as _block")
    ids = spark.range(0, 60_000, 6).selectExpr("int(id) as a").unionByName(spark.sql("select cast(null as int) as a"))
    marked = bitmaps.mark_among(rows, "rep", ids.unionByName(ids), "wanted")
    assert marked.columns == [*rows.columns, "wanted"]
    count = {tuple(r)[:2]: r.n for r in marked.groupBy((F.col("rep") % 6 == 0).alias("own"), "wanted").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert count[True, True] == 10_000 and (True, False) not in count and count[None, False] == 1
    assert count[False, True] < 0.1 * count[False, False]
    assert bitmaps.mark_among(rows, "rep", ids.limit(0), "wanted").filter("wanted").count() == 0


def test_only_texts_of_pairs_are_shuffled(spark, monkeypatch):
    draw = random.Random(3)
    texts = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(60)) for _ in range(600)]
    texts += [t + " end" for t in texts[:12]]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id int, text string, `a.b` string")
    through = []

    def counted(rows, id_col, ids, mark):
        marked = bitmaps.mark_among(rows, id_col, ids, mark)
        through.append(marked.filter(F.col(mark)).count())
        return marked

    monkeypatch.setattr(minhash, "mark_among", counted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = minhash.drop_near_copies(docs, 5, 80).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(tuple(r) for r in left) == [(i, texts[i], "k") for i in range(600)]
    assert len(through) >= 3 and max(through) <= 24
