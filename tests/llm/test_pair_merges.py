"""Byte-pair encoding against the tokenizers library and against plain merging."""

import hashlib
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from termtide.llm import pair_merges
from termtide.llm.tokens import vocabulary_path

NAME = "byte_bpe_50k.json"
WORDS = ["the", "Straße", "naïve", "日本語", "don't", "we'll", "1234567", "x" * 40, "İ.", "ŉ", "̀", "é", "🙂🙃", "👩‍👩‍👧", "<|endoftext|>", "<|endoftext", "ﬁ", "٣٤", "²", "Ġ"]
GAPS = ["", " ", "  ", "\n", " \n ", "\t", " ", " ", "\x1c", "\x85", ".", ", ", "'s", "''", " '", "퟿", "͸", "࢏", "\U000323b0"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path(NAME))


@pytest.fixture(scope="module")
def coder():
    return pair_merges.Encoder(pair_merges.BytePairs.read(NAME))


def of_library(library, text):
    return library.encode(text, add_special_tokens=False).ids


def of_ours(coder, text):
    return np.frombuffer(coder.encode([text])[0], "<u4").tolist()


def test_same_as_library(library, coder):
    rng = random.Random(5)
    pool = WORDS + GAPS
    for _ in range(4000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(0, 14)))
        text += "".join(chr(rng.choice([rng.randrange(0x250), rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randrange(4)))
        ids = of_library(library, text)
        assert of_ours(coder, text) == ids, repr(text)
        assert coder.model.decode(np.array(ids, "<u4")) == library.decode(ids, skip_special_tokens=False)


def test_every_character_is_split_as_by_the_library(library, coder):
    for low in range(0, sys.maxunicode + 1, 64):
        chars = [chr(c) for c in range(low, low + 64) if not 0xD800 <= c < 0xE000]
        text = "|".join(f"a{c}1{c}!{c} {c}b" for c in chars)
        spans = [s for _, s in library.pre_tokenizer.pre_tokenize_str(text)]
        words = [w for part in coder.split(text) for w in part]
        assert [len(w) for w in words] == [b - a for a, b in spans], hex(low)


def test_decoding_cut_characters(library, coder):
    rng = random.Random(9)
    for _ in range(500):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(12))]
        assert coder.model.decode(np.array(ids, "<u4")) == library.decode(ids, skip_special_tokens=False)


def slow_merge(ranks, ids):
    ids = list(ids)
    while True:
        pairs = [(ranks[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in ranks]
        if not pairs:
            return ids
        rank, i = min(pairs)
        ids[i : i + 2] = [1000 + rank]


def test_merges_against_plain_search():
    rng = random.Random(3)
    letters = pair_merges.byte_letters()
    for _ in range(60):
        tokens = letters[97:101]
        merges, seen = [], set()
        for _ in range(rng.randrange(1, 12)):
            pair = rng.choice(tokens), rng.choice(tokens)
            if "".join(pair) not in seen:
                seen.add("".join(pair))
                merges.append(pair)
                tokens = [*tokens, "".join(pair)]
        vocabulary = {c: i for i, c in enumerate(letters)}
        vocabulary |= {a + b: 1000 + i for i, (a, b) in enumerate(merges)}
        model = pair_merges.BytePairs(vocabulary, merges, {})
        ranks = {(vocabulary[a], vocabulary[b]): i for i, (a, b) in enumerate(merges)}
        for size in (0, 1, 2, 3, 17, 64, 65):
            word = bytes(rng.choice(b"abcd") for _ in range(size))
            assert model.merged(word) == slow_merge(ranks, [vocabulary[letters[b]] for b in word])
        words = [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(70))) for _ in range(60)]
        found = [np.frombuffer(ids, "<u4").tolist() for ids in model.merged_words(words)]
        assert found == [slow_merge(ranks, [vocabulary[letters[b]] for b in w]) for w in words]


def test_tree_names_the_leftmost_least():
    rng = random.Random(1)
    ranks = [rng.choice([None, 0, 1, 2]) for _ in range(37)]
    tree = pair_merges.PairTree(ranks)
    for _ in range(300):
        some = [(r, i) for i, r in enumerate(ranks) if r is not None]
        assert tree.least() == (min(some) if some else None)
        place = rng.randrange(37)
        ranks[place] = rng.choice([None, None, 0, 1, 2, 3])
        tree.set(place, ranks[place])


def test_long_texts_and_small_memories(library):
    text = "Some wörds, repeated 12 times  \n" * 40_000 + "<|endoftext|>" + "ab" * 20_000
    small = pair_merges.Encoder(pair_merges.BytePairs.read(NAME), memory=1000)
    assert len(text) > pair_merges._LONG
    assert of_ours(small, text) == of_library(library, text)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        pair_merges.BytePairs.read("word_bpe_49k.json")


def test_documents(spark, library):
    texts = [None, "", " ", "One two  three\n", "One two  three\n", "<|endoftext|> a", "é" * 3000, "word " * 30_000]
    rows = [(i, t, 1, "x", "y") for i, t in enumerate(texts)] + [(None, "no id", 1, "x", "y"), (3, "same id", 1, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int, ids string, decoded string")
    coded = pair_merges.decode_documents(pair_merges.encode_documents(docs, NAME), NAME)
    assert coded.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, bytes(r.ids), r.decoded) for r in coded.collect())
    want = []
    for i, t, *_ in rows:
        ids = of_library(library, t or "")
        data = np.array(ids, "<u4").tobytes()
        want.append((i is not None, i or 0, len(ids), data, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    assert pair_merges.encode_documents(docs.limit(0), NAME).count() == 0


def test_query(spark, library, tmp_path):
    from termtide.llm.queries import QUERIES

    texts = [None, "Zeile eins\n\nTwo <|endoftext|>", "🙂 ok"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op11_pair_merges"](spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        ids = of_library(library, text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        back = library.decode(ids, skip_special_tokens=False)
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
