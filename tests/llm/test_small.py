"""Edge cases of every operator on tiny tables: nulls, empty and long texts, ties, repeated rows,
empty tables, further columns with the names that operators use themselves."""

import hashlib
import math
import random
import zlib
from collections import Counter, namedtuple
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from termtide.llm import ann, chat, exact_dedup, line_dedup, minhash, packing, suffix_dedup, suffix_sort
from termtide.llm import token_files, tokens, toxicity, unigram

LONG = "word " * 30_000
TEXTS = [None, "", " \n\t ", "a", "One two three four five six", "one two three four five six", "One  two three four five six"]
TEXTS += ["Zeile eins\nZeile zwei länger\nZeile eins", "Zeile zwei länger\nzeile ZWEI länger  ", LONG, LONG + "x", "é" * 90, "é" * 90]
SCHEMA = "doc_id bigint, text string, key string, label string, rank string, maybe string"


def make(spark, texts, first=0):
    rows = [(first + i, t, "k", "l", "r", "m") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df, *names):
    return {r[0]: tuple(r)[1:] for r in df.select("doc_id", *names).collect()}


def test_exact_groups(spark):
    got = rows_of(exact_dedup.exact_groups(make(spark, TEXTS)), "keep_id", "group_size", "kept", "text_sha256")
    groups = {}
    for i, t in enumerate(TEXTS):
        groups.setdefault("".join((t or "").split()), []).append(i)
    for key, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(TEXTS[i] or ""), i))
        for i in ids:
            assert got[i] == (keep, len(ids), i == keep, hashlib.sha256(key.encode()).hexdigest())
    assert exact_dedup.exact_groups(make(spark, [])).count() == 0


def test_exact_copies_keep_columns(spark):
    docs = make(spark, TEXTS)
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    marks = exact_dedup.exact_groups(docs).filter("kept")
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in marks.collect()}


def line_truth(texts: dict):
    holders = {}
    for i, t in texts.items():
        for line in (t or "").split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").encode().lower()
            if len(key.decode()) >= 10:
                holders.setdefault(key, set()).add(i)
    out = {}
    for i, t in texts.items():
        lines = (t or "").split("\n")
        keys = [x.strip(" \t\n\x0b\x0c\r").encode().lower() for x in lines]
        kept = [x for x, k in zip(lines, keys, strict=True) if not (len(holders.get(k, ())) > 1 and min(holders[k]) != i)]
        out[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def test_lines_in_and_out(spark, tmp_path):
    texts = dict(enumerate(TEXTS))
    index = line_dedup.LineIndex(spark, str(tmp_path / "index"), shards=3)
    docs = make(spark, TEXTS)
    index.insert(docs.filter("doc_id < 6"))
    index.insert(docs.filter("doc_id >= 6"))
    assert rows_of(index.rewrite(docs), "text", "n_lines", "n_dropped") == line_truth(texts)
    index.delete(spark.createDataFrame([(7,), (99,)], "doc_id bigint"))
    del texts[7]
    left = docs.filter("doc_id <> 7")
    assert rows_of(index.rewrite(left), "text", "n_lines", "n_dropped") == line_truth(texts)
    assert index.counts().filter("holders < 1").count() == 0
    unknown = index.known(spark.createDataFrame([(1, 2)], "k1 bigint, k2 bigint")).collect()
    known = index.known(index.counts().select("k1", "k2")).collect()
    assert all(r.maybe for r in known) and not unknown[0].maybe


def test_cuckoo_filter_takes_keys_in_and_out():
    keys = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000)
    segments = line_dedup._updated([], keys, keys[:0])
    filters = [line_dedup.CuckooFilter.read(s) for s in segments]
    assert np.logical_or.reduce([f.known(keys) for f in filters]).all()
    segments = line_dedup._updated(segments, keys[:0], keys[:2500])
    filters = [line_dedup.CuckooFilter.read(s) for s in segments]
    assert np.logical_or.reduce([f.known(keys[2500:]) for f in filters]).all()
    assert np.logical_or.reduce([f.known(keys[:2500]) for f in filters]).mean() < 0.01


def test_documents_come_through_the_filters(spark, monkeypatch):
    asked = []
    known = line_dedup.LineIndex.known
    monkeypatch.setattr(line_dedup.LineIndex, "known", lambda self, keys: asked.append(self.changes) or known(self, keys))
    got = rows_of(line_dedup.dedup_lines(make(spark, TEXTS)), "text", "n_lines", "n_dropped")
    assert got == line_truth(dict(enumerate(TEXTS))) and asked == [1]
    assert line_dedup.dedup_lines(make(spark, [])).count() == 0


def same_mark_lines():
    """Two lines with one mark and the same buckets in a filter of 512 buckets, but not in one of 2048."""
    small, large = (line_dedup.CuckooFilter(np.zeros((n, 4), np.uint16)) for n in (512, 2048))
    lines = [f"some line of text {i}" for i in range(60_000)]
    halves = np.frombuffer(b"".join(line_dedup.line_keys("\n".join(lines).encode())), "<i8").reshape(-1, 2)
    keys = halves[:, 0] ^ (halves[:, 1] >> 1)

    def names(f):
        mark, first, second = f.places(keys)
        return np.stack([mark.astype(np.int64), np.minimum(first, second), np.maximum(first, second)], axis=1).tolist()

    seen = {}
    for i, (name, wide) in enumerate(zip(names(small), names(large), strict=True)):
        j, other = seen.setdefault(tuple(name), (i, wide))
        if other != wide:
            return lines[j], lines[i]
    raise AssertionError("no such lines")


def test_deletion_leaves_the_marks_of_other_keys(spark, tmp_path):
    one, two = same_mark_lines()
    texts = {0: "\n".join([one, *[f"old line number {i}" for i in range(1000)]])}
    texts |= {1: two, 2: "\n".join(f"new line number {i}" for i in range(5000)), 3: f"{one}\n{two}\nonly here, this line"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    index = line_dedup.LineIndex(spark, str(tmp_path / "index"), shards=1)
    index.insert(docs.filter("doc_id = 0"))
    # a larger batch, which gets a larger filter
    index._write(line_dedup.line_pairs(docs.filter("doc_id in (1, 2)")), "refs", 2)
    batch = index._read("refs", 2).groupBy("k1", "k2").agg(F.count("*").alias("holders"), F.min("doc_id").alias("first_doc"))
    index._write(index.counts().unionByName(batch), "counts", 2)
    older = index.filters().collect()
    added = batch.toPandas()
    large = line_dedup.CuckooFilter.sized(5001)
    assert not len(large.insert(line_dedup._key64(added.k1, added.k2)))
    filters = [(0, r.segment, r.data) for r in older] + [(0, len(older), bytearray(large.table.tobytes()))]
    index._write(spark.createDataFrame(filters, line_dedup._FILTERS), "filters", 2)
    index.changes = 2
    index.delete(spark.createDataFrame([(1,)], "doc_id bigint"))
    del texts[1]
    assert all(r.maybe for r in index.known(index.counts().select("k1", "k2")).collect())
    index.insert(docs.filter("doc_id = 3"))
    assert index.counts().groupBy("k1", "k2").count().filter("count > 1").count() == 0
    assert rows_of(index.rewrite(docs.filter("doc_id <> 1")), "text", "n_lines", "n_dropped") == line_truth(texts)


def test_suffix_array_against_sorting():
    draw = random.Random(3)
    for _ in range(300):
        s = [draw.randint(0, draw.choice([1, 2, 5])) for _ in range(draw.randint(0, 60))]
        assert suffix_sort.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("group_chunks", [1 << 16, 1])
def test_repeated_strings(spark, group_chunks):
    draw = random.Random(5)
    passage = "".join(draw.choice("abcdefghij klmnö") for _ in range(300))
    noise = lambda n: "".join(draw.choice("abcdefghijklmnop qrstuvwxyz") for _ in range(n))
    texts = [None, "", noise(99), passage, noise(150) + passage[:180] + noise(60), noise(40) + passage[90:] + passage[:120]]
    texts += [passage, "z" * 260, "z" * 120 + noise(30), "ab" * 150, noise(20) + "ab" * 60, noise(500)]
    seen, expected = set(), {}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - 99):
            if data[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(data[k : k + 100])
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        expected[i] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    got = suffix_dedup.drop_repeats(make(spark, texts), group_chunks=group_chunks)
    assert rows_of(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected
    assert suffix_dedup.drop_repeats(make(spark, [])).count() == 0


@pytest.mark.parametrize("before", [1000, (1 << 20) - 60, (1 << 20) - 40])
def test_runs_of_one_character_have_the_same_piece_at_any_place(before):
    data = np.random.default_rng(4).integers(97, 123, before + 400).astype(np.uint8)
    for length in (100, 130, 168):
        data[before : before + length] = ord("-")
        key, first, end, piece, _ = suffix_dedup.chunks(data, np.array([0, len(data)]))
        for start in range(before, before + length - 99):
            own = np.flatnonzero((first <= start) & (end >= start + 100) & (piece >= start) & (piece <= start + 68))
            assert piece[own].tolist() == [start + 68]


def test_near_groups(spark):
    draw = random.Random(7)
    base = [draw.choice("one two three four five six seven".split()) + str(draw.randint(0, 200)) for _ in range(120)]

    def changed(n):
        words = list(base)
        for i in draw.sample(range(120), n):
            words[i] = f"new{draw.random()}"
        return " ".join(words)

    texts = [None, "", "lone", "LONE", " ".join(base), " ".join(base).upper(), *[changed(n) for n in (1, 2, 4, 6, 8, 10, 12, 20, 40)]]
    texts += [changed(k % 9) for k in range(30)] + ["two words", "Two\twords", LONG]
    sets = [minhash.shingles((t or "").encode(), 2) for t in texts]
    label = list(range(len(texts)))
    linked = True
    while linked:
        linked = False
        for i, a in enumerate(sets):
            for j in range(i):
                both = len(a & sets[j])
                if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    linked = True
    got = rows_of(minhash.near_groups(make(spark, texts)), "n_shingles", "component_id", "kept")
    assert got == {i: (len(s), label[i], label[i] == i) for i, s in enumerate(sets)}
    assert minhash.near_groups(make(spark, [])).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 90, 100])
def test_pairs_at_the_threshold_are_missed_once_in_a_million(percent):
    k, p = minhash.match_threshold(percent / 100), Fraction(percent, 100)
    missed = [sum(math.comb(64, i) * p**i * (1 - p) ** (64 - i) for i in range(n)) for n in (k, k + 1)]
    assert missed[0] <= Fraction(1, 10**6) < missed[1] or percent == 100 and k == 64


def test_token_files(spark, tmp_path):
    texts = [*TEXTS[:9], "it's  a\xa0b <|x|>", "a.\nb, c. D.. e", LONG]
    encoder = tokens.encoder("byte_bpe_50k.json")
    expected, start = {}, 0
    for i, t in enumerate(texts):
        ids = encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        expected[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    files = token_files.write_token_files(make(spark, texts), str(tmp_path), "byte_bpe_50k.json", parts=3)
    read = token_files.read_token_files(files)
    got = {r.doc_id: (r.start, r.n_tokens, zlib.crc32(r.ids)) for r in read.collect()}
    assert got == expected
    some = token_files.read_token_files(files, [2, 10])
    assert {r.doc_id: (r.start, r.n_tokens, zlib.crc32(r.ids)) for r in some.collect()} == {i: expected[i] for i in (2, 10)}


def test_damaged_frame_is_noticed(tmp_path):
    path = tmp_path / "one.zst"
    with open(path, "wb") as out:
        writer = token_files.TokenWriter(out, frame_bytes=64)
        for i in range(20):
            writer.add(i, np.arange(i, dtype="<u4").tobytes())
        writer.close()
    data = bytearray(path.read_bytes())
    import io

    reader = token_files.TokenReader(io.BytesIO(data), len(data))
    assert [reader.ids(i) for i in range(20)] == [np.arange(i, dtype="<u4").tobytes() for i in range(20)]
    reader.checks = reader.checks + 1
    reader._frame_no = -1
    with pytest.raises(ValueError, match="damaged"):
        reader.ids(19)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_library_ids(name):
    texts = ["", " ", "  a", "a  ", "a \n b", "\n\n x  y\t z ", "it's  a\xa0b  c", "x" * 400, " \x01 a\x01b", "İΣ aΣ é", "a. b, c.\nd"]
    texts += ["a.. b., c", "foo.\x01 bar", "日本 語 漢字。 ok", "'s 't're", "a\r\n b", "\x1c \x1d a \x85 b", "x\n\ny. ", ", .", "a\x02b c", "<|endoftext|>. x\ny"]
    encoder = tokens.encoder(name)
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_packing(spark):
    draw = random.Random(2)
    lengths = [draw.choice([1, 5, 30, 64, 65, 100, 300, 300, 700, 1024, 1025, 1500, 2047, 2048]) for _ in range(400)] + [300] * 200
    pieces = spark.createDataFrame([(i, n, "x", -1) for i, n in enumerate(lengths)], "doc_id bigint, length bigint, bin string, offset int")
    packed = packing.pack(pieces).collect()
    assert sorted((r.doc_id, r.length) for r in packed) == list(enumerate(lengths))
    sequences = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1.05 * sum(lengths) / 2048 + 2
    assert packing.pack(pieces.limit(0)).count() == 0


def test_documents_are_cut_only_where_long(spark):
    cut = packing.cut_documents(make(spark, ["a b c", None, "word " * 5000]), "word_bpe_49k.json").collect()
    by_doc = {}
    for r in sorted(cut, key=lambda r: r.piece):
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
    assert by_doc[0] == [(0, 4)] and by_doc[1] == [(0, 1)]
    assert by_doc[2] == [(0, 2048), (2048, 2048), (4096, 905)]


def test_unigram_is_the_best_segmentation():
    pieces = ["<unk>", *[f"<0x{i:02X}>" for i in range(256)], "▁", "a", "b", "ab", "▁a", "▁ab", "ba", "aab", "é"]
    kinds = np.array([2] + [6] * 256 + [1] * 9)
    scores = np.array([0.0] * 257 + [-3.0, -2.0, -2.2, -2.5, -3.1, -4.0, -2.4, -3.9, -5.0])
    model = unigram.Unigram(unigram.Model(pieces, scores, kinds, True))
    place = {p: i for i, p in enumerate(pieces)}

    def best(word):
        score = [(0.0, [])]
        for end in range(1, len(word) + 1):
            options = [
                (score[k][0] + scores[place[word[k:end]]], [*score[k][1], place[word[k:end]]])
                for k in range(end) if score[k] and word[k:end] in place and place[word[k:end]] > 256
            ]
            if word[end - 1] not in place:
                data = [1 + b for b in word[end - 1].encode()]
                options += [(score[end - 1][0] + model.unknown, score[end - 1][1] + data)]
            score.append(max(options, key=lambda o: o[0]) if options else None)
        return score[-1]

    draw = random.Random(4)
    texts = ["", " ", "a", "  ab ba", "x é a", *["".join(draw.choice("ab é🙂") for _ in range(draw.randint(1, 25))) for _ in range(200)]]
    for text, (ids, score) in zip(texts, model.encode(texts), strict=True):
        words = [best(w)[0] for w in model.words(text)]
        assert score == pytest.approx(sum(words))
        assert model.decode(np.frombuffer(ids, "<u4")) == text


def test_unigram_documents(spark):
    got = unigram.encode_documents(make(spark, TEXTS), "piece_bpe_32k.model")
    assert rows_of(got, "decoded") == {i: (t or "",) for i, t in enumerate(TEXTS)}
    assert unigram.encode_documents(make(spark, []), "piece_bpe_32k.model").count() == 0


def test_search_against_all_products(spark):
    draw = np.random.default_rng(3)
    vectors = draw.standard_normal((400, 16)).astype(np.float32)
    vectors[50:90] = vectors[50]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    bad = [(1000, None, "x"), (1020, [0.0] * 16, "x"), (1040, [float("nan")] * 16, "x"), (1060, [None] * 16, "x"), (1080, [1.0], "x"), (1100, [], "x")]
    table = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>, rank string")
    found = {}
    for r in ann.search(table, F.col("vec_id") % 20 == 0, 20).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    exact = vectors.astype(np.float64)
    hits = 0
    assert set(found) == set(range(0, 400, 20))
    for q, ranks in found.items():
        scores = exact @ exact[q]
        order = [i for i in np.lexsort((np.arange(400), -np.round(scores, 12))) if i != q][:20]
        hits += len({v for v, _ in ranks.values()} & set(order))
        assert sorted(ranks) == list(range(1, 21))
        assert all(s == pytest.approx(scores[v]) for v, s in ranks.values())
    assert hits / (20 * len(found)) >= 0.9
    few = ann.search(table.filter("vec_id < 3"), F.col("vec_id") % 20 == 0, 20).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert ann.search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_chat_layouts(spark):
    records = [
        '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"<|im_end|> <\\\\\\\\| x"}]}',
        '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}',
        '{"system":"s","conversations":[{"from":"human","value":null},{"from":"gpt","value":""}]}',
        '{"prompt":"p","response":7}',
        '{"instruction":"do","input":"","output":"done"}',
        '{"output":"done","instruction":"do","input":"it"}',
        '{"messages":[]}',
        '{"unheard":1}',
        "no json",
        None,
    ]
    table = spark.createDataFrame([(i, r, "x") for i, r in enumerate(records)], "doc_id bigint, record string, formatted string")
    out = chat.format_chats(table).withColumn("turns", chat.parse_chat(F.col("formatted"))).withColumn(
        "loss", chat.loss_text(F.col("formatted"), F.col("loss_mask"))
    )
    got = {r.doc_id: ([tuple(t) for t in r.turns] if r.turns is not None else None, r.loss) for r in out.collect()}
    assert got[0] == ([("user", "hi"), ("assistant", "<|im_end|> <\\\\| x")], "<|im_end|> <\\\\| x")
    assert got[1] == ([("user", "a"), ("assistant", "b")], "b")
    assert got[2] == ([("system", "s"), ("user", ""), ("assistant", "")], "")
    assert got[3] == ([("user", "p"), ("assistant", "7")], "7")
    assert got[4] == ([("user", "do"), ("assistant", "done")], "done")
    assert got[5] == ([("user", "do\n\nit"), ("assistant", "done")], "done")
    assert got[6] == ([], "")
    assert all(got[i][0] is None for i in (7, 8, 9))


def test_toxic_words_are_learned(spark):
    draw = random.Random(6)
    words = ["tree", "house", "river", "stone", "cloud", "green", "walk", "sing"]

    def text(extra=()):
        said = [draw.choice(words) for _ in range(30)] + list(extra)
        draw.shuffle(said)
        return " ".join(said)

    clean = [text() for _ in range(200)]
    rude = [text([draw.choice(["blarg", "fnordhead", "fnordy"])]) for _ in range(60)]
    docs = make(spark, [*clean, *rude])
    labels = spark.createDataFrame([(i, int(i >= 200)) for i in range(260)] + [(None, 1), (5000, None)], "doc_id bigint, toxic int")
    lexicon = toxicity.learn(docs, labels)
    assert any(t.startswith(" blarg") for t in lexicon.terms) and any(t.startswith(" fnord") for t in lexicon.terms)
    tests = ["tree BL4RG house", "river ｂｌａｒｇ stone", "tree рiver blаrg", "fnordling walk", text(), "", None, LONG]
    scores = [r[0] for r in rows_of(toxicity.score(make(spark, tests), lexicon), "toxicity").values()]
    assert all(s >= 0.5 for s in scores[:4]) and all(0 <= s < 0.5 for s in scores[4:])
    nothing = toxicity.learn(docs, labels.limit(0))
    assert not nothing.terms and toxicity.score(docs, nothing).filter("toxicity >= 0.5").count() == 0


def test_exception_phrases_take_back():
    lexicon = toxicity.Lexicon({" trash": 3.0}, {" trash can ": -3.0})
    automaton = lexicon.automaton()
    assert toxicity.density(toxicity.fold("the trash can"), automaton) == 0
    assert toxicity.density(toxicity.fold("the tr4sh!"), automaton) > 0
    assert Counter(toxicity.fold("Ünïted it's 4 you").split())["united"] == 1


def test_digits_and_signs_anywhere_in_a_word():
    terms = {"0": "bozo", "1": "nazi", "3": "garbage", "4": "drama", "5": "losers", "7": "idiot", "@": "mafia", "$": "ass"}
    for sign, term in terms.items():
        automaton = toxicity.Lexicon({f" {term} ": 3.0}).automaton()
        letter = sign.translate(toxicity._DIGITS)
        written = term.rstrip(letter) + sign * (len(term) - len(term.rstrip(letter)))
        assert written.endswith(sign), written
        assert toxicity.density(toxicity.fold(f"you {written}, go"), automaton) > 0, written
        assert toxicity.density(toxicity.fold(f"you {term.replace(letter, sign)}"), automaton) > 0, term
    for text in ("the 20th day", "a 100m race", "us$100", "price 5$", "foo@bar", "é1 3"):
        words = toxicity.fold(text).split()
        assert set(toxicity._BETWEEN.sub(" ", text).split()) <= set(words), words
    assert toxicity.fold("in 1990, 5") == " in 1990 5 "


def test_all_terms_and_exception_phrases_are_learned(spark):
    Row = namedtuple("Row", "term t n")
    assert len(toxicity._chosen([Row(f"{i:05d} ", 50, 0) for i in range(6000)], 1000, 1000, 6000)) == 6000
    phrases = " ".join(f"blarg word{i}" for i in range(2700))
    texts = [phrases] * 3 + ["tree house"] * 200 + ["blarg"] * 40
    labels = spark.createDataFrame([(i, int(i >= 203)) for i in range(243)], "doc_id bigint, toxic int")
    assert len(toxicity.learn(make(spark, texts), labels).exceptions) > 5000


def test_rows_that_share_an_id_or_have_none(spark):
    draw = random.Random(8)
    noise = lambda n: "".join(draw.choice("abcdefghijklmnop qrstuvwxyz") for _ in range(n))
    passage = noise(150)
    texts = [(1, "x" + passage + noise(50)), (2, passage), (2, noise(80) + "#" + passage), (2, noise(120)), (None, noise(130)), (None, passage + "!")]
    docs = spark.createDataFrame([(i, t, len(t), "k") for i, t in texts], "doc_id bigint, text string, n_chars bigint, key string")
    got = corpus_pipeline.drop_passages(spark, docs, "").collect()
    left = [(None, texts[4][1]), (None, passage + "!"), (1, "x" + texts[0][1][151:]), (2, ""), (2, texts[2][1][:81]), (2, texts[3][1])]
    assert sorted(((r.doc_id or 0, r.text) for r in got)) == sorted((i or 0, t) for i, t in left)
    assert all(r.n_chars == len(r.text) and r.key == "k" for r in got)
    same = spark.createDataFrame([(3, "same text", "k"), (3, "same text", "k"), (3, "same  text", "k"), (3, "other", "k"), (4, "sametext", "k")], "doc_id bigint, text string, key string")
    assert sorted(tuple(r) for r in corpus_pipeline.drop_exact(spark, same, "").collect()) == [(3, "other", "k"), (3, "same  text", "k")]


@pytest.mark.parametrize("percent", [20, 50, 60, 80, 95, 100])
def test_lists_of_the_prefix_miss_a_pair_once_in_a_million(percent):
    s = Fraction(percent, 100)
    width = minhash.list_width(percent / 100)
    n = minhash.COORDINATES // width
    k, p = minhash.match_threshold(percent / 100 * (percent / 100 if width == 2 else 1), n), s**width
    missed = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k))
    assert missed <= Fraction(1, 10**6)
    assert width == (2 if percent >= 60 else 1)


def test_one_common_coordinate_is_no_common_list(spark):
    draw = np.random.default_rng(4)
    sigs = draw.integers(0, 1 << 32, (40, minhash.COORDINATES), dtype=np.uint32)
    sigs[:, ::2] = sigs[0, ::2]  # one of every two values is shared by all
    rows = [(i, 100, bytearray(s.tobytes())) for i, s in enumerate(sigs)]
    lists = minhash.postings(spark.createDataFrame(rows, "rep bigint, n_shingles bigint, sig binary"), 0.8)
    assert lists.groupBy("key").count().filter("count > 1").count() == 0


def test_texts_are_handed_over_a_few_at_a_time(spark):
    from termtide.llm.common import TEXT_ROWS, text_batches

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with text_batches(spark):
        assert int(spark.conf.get(name)) == TEXT_ROWS
    assert spark.conf.get(name) == before
