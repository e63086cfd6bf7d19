"""Merkle manifests against a plain tree."""

import hashlib
import zlib

import duckdb
import pytest

from termtide.llm import merkle
from termtide.llm.queries import ORACLE, QUERIES


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(nodes):
    """The remaining node and, for each leaf, its siblings level by level as (left, right)."""
    ways = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = k // 8 * 8
            ways[i].append(("".join(nodes[run:k]), "".join(nodes[k + 1 : run + 8])))
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        at = [k // 8 for k in at]
    return nodes[0], ways


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def truth(rows):
    """doc_id, leaf, subroot, root, proof, folded and verified of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    found = {}
    for name in names:
        part = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        found[name] = (part, *tree([leaf_of(r) for r in part]))
    root, ways = tree([found[n][1] for n in names])
    out = []
    for name, way in zip(names, ways, strict=True):
        part, subroot, inner = found[name]
        for row, own in zip(part, inner, strict=True):
            steps = own + way
            node = leaf_of(row)
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None
            fold = leaf_of((*row[:4], "".join(c.lower() if c.isascii() else c for c in row[4]))) if changed else node
            for left, right in steps:
                fold = sha(left + fold + right)
            out.append((row[0], node, subroot, root, sha("".join(a + b for a, b in steps)), fold, fold == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def documents(sizes):
    rows, i = [], 0
    for lang, size in sizes.items():
        for _ in range(size):
            text = None if i % 11 == 0 else f"Text {i} Ä" if i % 4 else f"plain {i}"
            rows.append((i * 7 % 100_003, None if i % 5 == 0 else f"s{i % 3}", lang, None if i % 9 == 0 else len(text or ""), text))
            i += 1
    return rows


@pytest.mark.parametrize(
    "sizes",
    [
        {"en": 1},
        {None: 1, "de": 8, "é": 9},
        {"en": 512, "fr": 513, "": 64, "de": 65},
        {"en": 2600, None: 3, **{f"l{i}": 1 + i % 3 for i in range(20)}},
    ],
)
def test_query_against_plain_tree(spark, tmp_path, sizes):
    rows = documents(sizes)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in QUERIES["op12_merkle_manifest"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == truth(rows)


def test_sql_says_the_same(spark, tmp_path):
    rows = documents({"en": 70, None: 3, "de": 8, "fr": 1})
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
        cursor = con.execute(ORACLE["op12_merkle_manifest"])
        names = [d[0] for d in cursor.description]
        order = [names.index(c) for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")]
        assert sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=repr) == truth(rows)


def test_a_third_tier(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    nodes = [sha(str(i)) for i in range(700)]
    rows = spark.createDataFrame([("g", i, n) for i, n in enumerate(nodes)], "g string, at int, leaf string")
    made = merkle.manifest(rows, "g", "at")
    assert len(made.tiers) == 4
    root, ways = tree(nodes)
    got = {r["at"]: r for r in made.proofs().collect()}
    assert {r.root for r in got.values()} == {root}
    assert all([tuple(s) for s in got[i].steps] == ways[i] for i in range(700))
    assert {r.tier for r in made.levels().select("tier").collect()} == {0, 1, 2, 3}


def test_rows_without_id_repeated_rows_and_own_columns(spark):
    rows = [(None, "b", "r1"), (None, "a", "r2"), (3, "c", "r3"), (3, "c", "r3"), (1, "d", "r4")]
    table = spark.createDataFrame(rows, "doc_id bigint, leaf string, root string").withColumn("steps", merkle.F.lit(1))
    digests = table.withColumn("leaf", merkle.digest(merkle.F.col("leaf"))).withColumn("lang", merkle.F.lit(None).cast("string"))
    got = merkle.manifest(digests, "lang", "doc_id").proofs()
    assert got.columns == ["doc_id", "leaf", "lang", "steps", "subroot", "root"]
    root, ways = tree([*sorted([sha("a"), sha("b")]), sha("d"), sha("c"), sha("c")])
    found = got.collect()
    assert len(found) == 5 and {r.root for r in found} == {root}
    assert sorted([tuple(s) for s in r.steps] for r in found) == sorted(ways)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES["op12_merkle_manifest"](spark, str(tmp_path)).count() == 0
