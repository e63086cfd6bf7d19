import random

import pytest
from pyspark.sql import functions as F

from termtide.operators import encoding
from termtide.operators.encoding import Vocabulary, encode_pieces, read_vocabulary

tokenizers = pytest.importorskip("tokenizers")

PIECES = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "the", "un", "##aff", "##able", "##a", "##b", "a", "b", "ab", "##ab", "cafe", "naive"]
PIECES += [",", ".", "!", "'", "$", "中", "国", "##国", "strasse", "straße", "1", "##2", "##3", "12", "й", "и", "i", "##i", "§", "¿", "…"]
WORDS = ["the", "The", "unaffable", "UNAFF", "abab", "ba", "café", "Café", "naïve", "中国", "a中b", "Straße", "123", "a" * 101, "a" * 100]
WORDS += ["й", "İ", "i̇", "‍", "\x07", "�", "a\x00b", "§", "¿ab?", "…", "$1", "''", "x", "", "\U0001f642", "ﬁ"]
GAPS = ["", " ", "  ", "\t", "\n", "\xa0", " ", " ", "\x0b", "\x85", ",", ".", "!", "​", "　"]


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary({p: i for i, p in enumerate(PIECES)})


@pytest.fixture(scope="module")
def library():
    from tokenizers import models, normalizers, pre_tokenizers, processors

    made = tokenizers.Tokenizer(models.WordPiece({p: i for i, p in enumerate(PIECES)}, unk_token="[UNK]", max_input_chars_per_word=100))
    made.normalizer = normalizers.BertNormalizer(lowercase=True)
    made.pre_tokenizer = pre_tokenizers.BertPreTokenizer()
    made.post_processor = processors.BertProcessing(("[SEP]", 3), ("[CLS]", 2))
    return made


@pytest.mark.parametrize("length", [2, 3, 8, 64])
def test_same_as_library(vocabulary, library, length):
    library.enable_truncation(length)
    library.enable_padding(length=length)
    rng, known = random.Random(length), {}
    for _ in range(1500):
        text = "".join(rng.choice(WORDS) + rng.choice(GAPS) for _ in range(rng.randrange(12)))
        found = vocabulary.encode(text, length, known)
        coded = library.encode(text)
        assert found + [0] * (length - len(found)) == coded.ids, repr(text)
        assert sum(coded.attention_mask) == len(found)


def test_table(spark, vocabulary):
    texts = [None, "", "unaffable", "the " * 50_000, "unaffable", "??"]
    rows = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "id int, text string, input_ids int")
    got = {r.id: (r.input_ids, r.attention_mask) for r in encode_pieces(rows, vocabulary, 6).collect()}
    assert got[0] == got[1] == ([2, 3, 0, 0, 0, 0], [1, 1, 0, 0, 0, 0])
    assert got[2] == got[4] == ([2, 5, 6, 7, 3, 0], [1, 1, 1, 1, 1, 0])
    assert got[3] == ([2, 4, 4, 4, 4, 3], [1] * 6)
    assert got[5] == ([2, 1, 1, 3, 0, 0], [1, 1, 1, 1, 0, 0])
    used = encode_pieces(rows, vocabulary, 6).select("id", encoding.used_ids().alias("u")).collect()
    assert {r.id: r.u for r in used}[2] == [2, 5, 6, 7, 3]
    assert encode_pieces(rows.limit(0), vocabulary).count() == 0
    with pytest.raises(ValueError, match="room"):
        encode_pieces(rows, vocabulary, 1)


def test_nothing_is_shuffled(spark, vocabulary):
    rows = spark.range(10).select(F.col("id").cast("string").alias("text"))
    plan = encode_pieces(rows, vocabulary, 8)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_vocabulary_files(spark, write, monkeypatch):
    path = write("vocab.txt", "[PAD]\n[UNK]\n[CLS]\n[SEP]\nab\n##c\nab\n")
    table = read_vocabulary(spark, path)
    assert Vocabulary.of(table).ids == {"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3, "ab": 4, "##c": 5}
    with pytest.raises(ValueError, match=r"lacks \[PAD\]"):
        Vocabulary.of(table.filter("id > 0"))
    monkeypatch.setattr(encoding, "MAX_PIECES", 5)
    with pytest.raises(ValueError, match="more than 5"):
        Vocabulary.of(table)
