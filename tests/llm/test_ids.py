"""Rows without id, rows that share one, ids and vectors at the ends of their range, letters that change in lower case."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from termtide.llm import ann, exact_dedup, minhash, packing, suffix_dedup, tokens

LOWEST = -(2**63)


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def of(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def test_exact_groups_of_the_lowest_id(spark):
    docs = make(spark, [(LOWEST, "a b"), (5, "ab"), (7, "a  b"), (None, "a  b"), (None, "x")])
    got = of(exact_dedup.exact_groups(docs), "doc_id", "keep_id", "group_size", "kept")
    assert got == sorted([(LOWEST, 7, 4, False), (5, 7, 4, False), (7, 7, 4, True), (None, 7, 4, False), (None, None, 1, True)], key=repr)
    low = make(spark, [(LOWEST, "ab"), (5, "ab")])
    assert of(exact_dedup.exact_groups(low), "doc_id", "keep_id") == [(LOWEST, LOWEST), (5, LOWEST)]


def test_near_groups_of_shared_and_missing_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = make(spark, [(4, a), (4, b), (9, a + " more"), (None, b + " more"), (None, "alone here"), (6, ""), (LOWEST, "own words")])
    got = of(minhash.near_groups(docs), "doc_id", "component_id", "kept", "n_shingles")
    want = [(4, 4, True, 59), (4, 4, True, 59), (9, 4, False, 60), (None, 4, False, 60), (None, None, True, 1), (6, 6, True, 0), (LOWEST, LOWEST, True, 1)]
    assert got == sorted(want, key=repr)


def test_a_passage_stays_once_whatever_the_ids(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(150))
    docs = make(spark, [(1, text), (1, text), (2, "x" + text), (None, text + "y")])
    got = of(suffix_dedup.drop_repeats(docs), "doc_id", "n_bytes", "n_removed")
    assert got == sorted([(None, 151, 0), (1, 150, 150), (1, 150, 150), (2, 151, 150)], key=repr)
    twice = suffix_dedup.drop_repeats(make(spark, [(1, text), (1, text)]))
    assert of(twice, "doc_id", "n_removed") == [(1, 0), (1, 150)] and twice.columns[0] == "doc_id"


@pytest.mark.parametrize("scale", [1e-30, 1e20, 1e100])
def test_search_among_vectors_of_any_length(spark, scale):
    vectors = np.random.default_rng(6).standard_normal((300, 24)) * scale
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = {}
    for r in ann.search(table, F.col("vec_id") % 20 == 0, 20).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q, ranks in found.items():
        scores = vectors @ vectors[q]
        best = [i for i in np.argsort(-scores, kind="stable") if i != q][:20]
        assert [r for r, *_ in sorted(ranks)] == list(range(1, 21))
        assert all(s == pytest.approx(scores[v], rel=1e-9, abs=1e-9 * scale**2) for _, v, s in ranks)
        hits += len({v for _, v, _ in ranks} & set(best))
    assert len(found) == 15 and hits >= 0.9 * 300


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_letters_before_stops_and_commas(name):
    encoder = tokens.encoder(name)
    letters = [chr(c) for c in range(0xC0, 0x2B0)] + [chr(c) for c in range(0x300, 0x310)] + ["ß", "ſ", "K", "ﬁ", "ά", "ǰ"]
    texts = [f"{left}{c}{mark}{end}" for c in letters for left in ("", "AL") for mark in ".," for end in (" x", "\nx", "", ". x", "a")]
    rng = random.Random(3)
    alphabet = [*letters, *"aB1 .,\n", ". ", ", ", ".\n"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(14))) for _ in range(6000)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_packed_pieces_hold_the_library_ids(spark):
    name = "word_bpe_49k.json"
    texts = [None, "", "İ. x", "ALİ, b", "One  two\nthree. " * 900, "a, b. " * 1500]
    library = tokens.encoder(name).tokenizer
    want = []
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[start : start + 2048], "<u4").tobytes()
            want.append((i, piece, start, len(part) // 4, zlib.crc32(part)))
    packed = packing.pack_documents(make(spark, list(enumerate(texts))), name)
    assert of(packed, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=repr)


def test_plain_words_go_to_the_model_and_lines_together(monkeypatch):
    encoder = tokens.ByteLevelEncoder("byte_bpe_50k.json")
    asked = []
    plain = encoder._plain
    monkeypatch.setattr(encoder, "_plain", lambda text: asked.append(text) or plain(text))
    words = ["plain", "été", "İstanbul", "ªºµß", "Łódź", "ǅ", "mañana", "a1b2", "can't", "日本", "x٣", "end-", "ʰa", "ͅb"]
    draw = random.Random(3)
    texts = ["\n".join(" ".join(draw.choices(words, k=6)) for _ in range(5)) for _ in range(60)]
    texts += ["first " + " ".join(words[:7]), "one. two, three.\nfour ,five\n.six", "a\n'll b\n've"]
    got = encoder.encode(texts)
    want = [np.array(x.ids, "<u4").tobytes() for x in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert got == want
    # one call for all words with other signs, one for all lines, one for each first piece and odd one
    assert not any(t.strip() in ("plain", "été", "mañana") and t[0] == " " for t in asked)
    assert sum(t.startswith("\n") for t in asked) <= 1 + sum(t.startswith(("\n'", "\n.")) for t in asked)
