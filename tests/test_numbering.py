import hashlib

import pytest
from pyspark.sql import functions as F

from termtide.operators import numbering
from termtide.operators.numbering import permuted, row_numbers, seeded_shuffle, write_shuffled


def truth(x, n, seed):
    bits = max(2, (n - 1).bit_length())
    low_bits = bits // 2

    def value(half, turn, size):
        return int(hashlib.md5(f"{seed}:{turn}:{half}".encode()).hexdigest()[:8], 16) % (1 << size)

    while True:
        high, low = x >> low_bits, x & ((1 << low_bits) - 1)
        for turn in range(4):
            if turn % 2 == 0:
                high ^= value(low, turn, bits - low_bits)
            else:
                low ^= value(high, turn, low_bits)
        x = high << low_bits | low
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 64, 65, 100, 1000, 1025])
def test_permutation_of_any_size(spark, n):
    got = {r.id: r.p for r in spark.range(n).select("id", permuted(F.col("id"), n, 3).alias("p")).collect()}
    assert sorted(got.values()) == list(range(n))
    assert got == {i: truth(i, n, 3) for i in range(n)}


def test_seeds_differ(spark):
    rows = spark.range(500).select(permuted(F.col("id"), 500, 0).alias("a"), permuted(F.col("id"), 500, 1).alias("b")).collect()
    assert sum(r.a == r.b for r in rows) < 10 and sum(r.a == i for i, r in enumerate(rows)) < 10
    with pytest.raises(ValueError):
        permuted(F.col("id"), 1 << 63)


def test_numbers_follow_the_order(spark):
    rows = spark.range(2000).select(((F.col("id") * 7919) % 2003).alias("k"), F.lit("x").alias("v")).repartition(7)
    numbered, total = row_numbers(rows, [F.asc("k")], "n")
    found = sorted((r.n, r.k) for r in numbered.collect())
    assert total == 2000 and [n for n, _ in found] == list(range(2000)) and [k for _, k in found] == sorted(k for _, k in found)


def test_files_have_their_exact_share(spark, tmp_path):
    rows = spark.range(1003).withColumn("hot", F.when(F.col("id") < 900, "same").otherwise(F.col("id").cast("string"))).repartition(5)
    path = str(tmp_path / "shuffled")
    assert write_shuffled(rows, [F.asc("id")], path, 100, seed=2) == 11
    back = spark.read.parquet(path).select("id", "place", F.input_file_name().alias("f")).collect()
    by_file = {}
    for r in back:
        by_file.setdefault(r.f, []).append(r.place)
    assert [len(by_file[f]) for f in sorted(by_file)] == [100] * 10 + [3]
    assert [p for f in sorted(by_file) for p in by_file[f]] == list(range(1003))
    assert {r.id: r.place for r in back} == {i: truth(i, 1003, 2) for i in range(1003)}
    again = seeded_shuffle(rows.repartition(3), [F.asc("id")], 2)[0].collect()
    assert {r.id: r.place for r in again} == {r.id: r.place for r in back}
    with pytest.raises(ValueError):
        write_shuffled(rows, [F.asc("id")], path, 0)


def test_no_rows(spark, tmp_path):
    none = spark.range(0)
    assert seeded_shuffle(none, [F.asc("id")])[1] == 0
    assert write_shuffled(none, [F.asc("id")], str(tmp_path / "none"), 10) == 1
    assert numbering.row_numbers(none, [F.asc("id")], "n")[0].count() == 0
