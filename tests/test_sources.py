"""Readers of the file formats, on small files of each shape."""

import pytest

from termtide.operators.labelling import label_lists, label_prefix, label_set, strict_lists
from termtide.sources.dictionaries import (
    read_dictionary_csv,
    read_dictionary_pos,
    read_dictionary_reviewed,
    read_dictionary_votes,
)
from termtide.sources.fixed import VOTE_COLUMNS, WIDE_NOT_CATEGORIES
from termtide.sources.lexicons import (
    lexicon_of_lists,
    read_lexicon_csv,
    read_lexicon_dic,
    read_lexicon_pipe,
    read_lexicon_wide,
)
from termtide.sources.lists import read_term_list, stop_words
from termtide.sources.tables import write_dictionary


def as_dict(lists):
    return {row["word"]: list(row["labels"]) for row in lists.collect()}


def test_lexicon_csv(spark, write):
    path = write(
        "lex.csv", "﻿Harbour,Place\n  row,act\nlantern,thing\n\tanchor,act \nAnchor,thing\nquay,place"
    )
    lexicon = read_lexicon_csv(spark, path)
    lists = as_dict(label_lists(lexicon))
    assert lists == {
        "harbour": ["place"],
        "row": ["act"],
        "lantern": ["thing"],
        "anchor": ["act", "thing"],
        "quay": ["place"],
    }
    assert {r["label"] for r in label_set(lexicon).collect()} == {"place", "act", "thing"}


def test_lexicon_csv_repeats_keep_file_order(spark, write):
    path = write("lex.csv", "w,b\nw,a\nw,b\n")
    lexicon = read_lexicon_csv(spark, path)
    assert [r["label"] for r in lexicon.orderBy("ord").collect()] == ["b", "a", "b"]
    assert as_dict(label_lists(lexicon)) == {"w": ["b", "a"]}


def test_lexicon_csv_lists_with_repeats(spark, write):
    text = "W,b\nw,a\nv,c\nw,B\nv,c\n" + "".join(f"w,l{i % 3}\n" for i in range(600))
    path = write("lex.csv", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        lists = as_dict(label_lists(read_lexicon_csv(spark, path), repeats=True))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert lists == {"w": ["b", "a", "b"] + ["l0", "l1", "l2"] * 200, "v": ["c", "c"]}


def test_lexicon_csv_order_over_many_splits(spark, write):
    text = "".join(f"w{i % 7},l{i}\n" for i in range(3000))
    path = write("lex.csv", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lexicon = read_lexicon_csv(spark, path)
        rows = lexicon.orderBy("ord").collect()
        splits = spark.read.text(path).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert splits > 5
    assert [r["ord"] for r in rows] == list(range(3000))
    assert [r["label"] for r in rows] == [f"l{i}" for i in range(3000)]


def test_lexicon_csv_separator_and_bad_lines(spark, write):
    lexicon = read_lexicon_csv(spark, write("lex.txt", "a|x\nb|y\n"), sep="|")
    assert as_dict(label_lists(lexicon)) == {"a": ["x"], "b": ["y"]}
    with pytest.raises(Exception, match="unexpected lexicon entry at line 1"):
        read_lexicon_csv(spark, write("bad.csv", "a,x\nword,noun,verb\n")).collect()


DIC = "%\n10\tsea\n20\tland\n30\tair\n%\nreef\t10\ndune\t20\t10\ngust\t30\nisland*\t20\t30\nsail*\t10"


def entries_of(spark, *words):
    return spark.createDataFrame(
        [(i, w, "") for i, w in enumerate(words)], "id bigint, word string, text string"
    )


def test_lexicon_dic_strict(spark, write):
    lists = as_dict(strict_lists(read_lexicon_dic(spark, write("lex.dic", DIC))))
    assert lists["reef"] == ["sea"]
    assert lists["dune"] == ["land", "sea"]
    assert lists["island"] == ["land", "air"]
    assert "islander" not in lists


def test_lexicon_dic_line_with_one_field(spark, write):
    with pytest.raises(Exception, match="at line 4"):
        read_lexicon_dic(spark, write("lex.dic", "%\n1\ta\n%\nx\t1\ny\n")).collect()


def test_lexicon_dic_strict_later_pattern_wins(spark, write):
    path = write("lex.dic", "%\n1\ta\n2\tb\n%\nrun\t1\nrun*\t2\nsit*\t1\nsit\t2\n")
    lists = as_dict(strict_lists(read_lexicon_dic(spark, path)))
    assert lists == {"run": ["b"], "sit": ["b"]}


def test_lexicon_dic_prefix(spark, write):
    patterns = read_lexicon_dic(spark, write("lex.dic", DIC))
    entries = entries_of(spark, "reefs", "island", "Islander", "isla", "dune", None)
    labelled = label_prefix(entries, patterns).orderBy("id").collect()
    assert [list(r["labels"]) for r in labelled] == [
        [],
        ["land", "air"],
        ["land", "air"],
        [],
        ["land", "sea"],
        [],
    ]


def test_prefix_prefers_whole_word_then_longest(spark, write):
    path = write("lex.dic", "%\n1\ta\n2\tb\n3\tc\n%\nrun*\t1\nrunn*\t2\nrunner\t3\n")
    entries = entries_of(spark, "run", "runs", "running", "runner", "runners", "ru")
    labelled = label_prefix(entries, read_lexicon_dic(spark, path)).orderBy("id").collect()
    assert [list(r["labels"]) for r in labelled] == [["a"], ["a"], ["b"], ["c"], ["b"], []]


PIPE = "plum,Fruit|sweet\nsaw,Tool|steel\nstorm,Weather|wind|Danger\ndozen,count|pack\n"


def test_lexicon_pipe(spark, write):
    path = write("pipe.csv", PIPE)
    assert as_dict(read_lexicon_pipe(spark, path))["dozen"] == ["count", "pack"]
    chosen = as_dict(read_lexicon_pipe(spark, path, {"Fruit", "count", "pack", "Weather"}))
    assert chosen == {
        "plum": ["Fruit"],
        "saw": [],
        "storm": ["Weather"],
        "dozen": ["count", "pack"],
    }


def test_lexicon_pipe_last_row_wins_and_case_stays(spark, write):
    lists = as_dict(read_lexicon_pipe(spark, write("pipe.csv", "a,x|y\nPlum,z\na,z\n")))
    assert lists == {"a": ["z"], "Plum": ["z"]}


def wide_file(rows):
    head = ["", "ColumnID", "Text", *[c for c in WIDE_NOT_CATEGORIES if c != "ColumnID"], "Fruit", "Tool", "Place"]
    lines = [",".join(head)]
    for i, (word, dic, fruit, tool, place) in enumerate(rows):
        values = {"": i, "ColumnID": "word", "Text": word, "Dic": dic, "Fruit": fruit, "Tool": tool, "Place": place}
        lines.append(",".join(str(values.get(c, 0)) for c in head))
    return "\n".join(lines)


def test_lexicon_wide(spark, write):
    rows = [
        ("plum", 90, 40, 0, 0),
        ("mist", 0, 7, 7, 7),
        ("quay", 80, 0, 0, 0),
        ("plum", 90, 12.5, 60, 0),
        ("plum", 90, 0, 0, 0),
        ("pier", 30, 0, 0, 2),
    ]
    path = write("wide.csv", wide_file(rows))
    # the last row that has a category counts
    assert as_dict(read_lexicon_wide(spark, path)) == {"plum": ["Fruit", "Tool"], "pier": ["Place"]}
    assert as_dict(read_lexicon_wide(spark, path, ["Tool"])) == {"plum": ["Tool"]}


def test_lexicon_wide_rejects_text(spark, write):
    path = write("wide.csv", wide_file([("plum", 90, "x", 0, 0)]))
    with pytest.raises(Exception, match="Fruit is no number for word plum"):
        read_lexicon_wide(spark, path).collect()


def test_lists_back_to_long(spark, write):
    lists = read_lexicon_pipe(spark, write("pipe.csv", PIPE))
    assert as_dict(label_lists(lexicon_of_lists(lists))) == as_dict(lists)


VOTES = "\n".join(
    [
        "|".join(VOTE_COLUMNS),
        "low%20tide|7|kit|hours of ebb, or so|\"Wait for it\" \"Gone.\"|01-02-2011|5|2|#shore#half-day",
        "SPRAY|8|ola|Water+with 50% salt|More SPRAY||1|6|#wet#Wind",
        "O|9|m|o|o|03-04-2012|70|30|",
        "Gannet|10|pim|diving bird||05-06-2013|9|4|",
        "Sea Fog|11|rae|Cold Air|Warm Water||3|3|Grey Day",
        "no votes||rae||||||",
        "one vote||rae||||6||",
        "other vote||rae|||4|||",
        "odd vote||rae||||31x|5|",
    ]
)


def test_dictionary_votes(spark, write):
    rows = read_dictionary_votes(spark, write("votes.dat", VOTES)).orderBy("id").collect()
    assert [r["id"] for r in rows] == [0, 1, 2, 3, 4]
    assert [r["word"] for r in rows] == ["low tide", "spray", "o", "gannet", "sea fog"]
    assert [r["quality"] for r in rows] == [3, -5, 40, 5, 0]
    assert rows[0]["text"] == 'shore half-day hours of ebb, or so "Wait for it" "Gone."'
    assert rows[1]["text"] == "wet wind Water with 50% salt More SPRAY"
    assert rows[3]["text"] == "diving bird"
    assert rows[4]["text"] == "grey day Cold Air Warm Water"


def test_dictionary_reviewed(spark, write):
    path = write(
        "reviewed.csv",
        ',word,meaning,example\n4,oar,a lever,\n5,hull,"wide, low","ribs, planks"\n'
        '6,keel,lowest beam,\n9,mast,,stands upright\n12,Jib,Sail,"cut\nflat, ""taut"""\n',
    )
    rows = read_dictionary_reviewed(spark, path, multi_line=True).orderBy("id").collect()
    assert [r["text"] for r in rows] == [
        "a lever",
        "wide, low ribs, planks",
        "lowest beam",
        "stands upright",
        'Sail cut\nflat, "taut"',
    ]
    assert rows[-1]["word"] == "jib"
    assert {r["quality"] for r in rows} == {100}


def test_dictionary_pos(spark, write):
    path = write("pos.csv", "word,pos,text\nTern,n.,Bird of the coast\nShoal,n.,\nFurl,v.,Roll up\n")
    rows = read_dictionary_pos(spark, path).orderBy("id").collect()
    assert [(r["id"], r["word"], r["pos"], r["text"]) for r in rows] == [
        (0, "tern", "n.", "Bird of the coast"),
        (1, "shoal", "n.", ""),
        (2, "furl", "v.", "Roll up"),
    ]


def test_dictionary_csv(spark, write):
    path = write("d.csv", 'id,word,text,quality\n3,a,"x, y",-2\n4,B,,7\n')
    rows = read_dictionary_csv(spark, path).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(3, "a", "x, y", -2), (4, "B", None, 7)]
    plain = read_dictionary_csv(spark, write("e.csv", "id,word,text\n1,a,b\n"), "id bigint, word string, text string")
    assert "quality" not in plain.columns


def test_line_breaks_are_read_by_default(spark, write, tmp_path):
    rows = [(1, "a", 'first\nsecond, "third"', 5), (2, "b", "plain", None)]
    entries = spark.createDataFrame(rows, "id bigint, word string, text string, quality int")
    write_dictionary(entries, str(tmp_path / "dictionary"))
    again = read_dictionary_csv(spark, str(tmp_path / "dictionary")).orderBy("id").collect()
    assert [tuple(r) for r in again] == rows
    path = write("reviewed.csv", ',word,meaning,example\n4,oar,"a\nlever",\n5,hull,low,\n')
    assert [(r["id"], r["text"]) for r in read_dictionary_reviewed(spark, path).orderBy("id").collect()] == [(4, "a\nlever"), (5, "low")]
    path = write("pos.csv", 'word,pos,text\nTern,n.,"Bird\nof the coast"\nFurl,v.,Roll up\n')
    read = read_dictionary_pos(spark, path).orderBy("id").collect()
    assert [(r["id"], r["word"], r["text"]) for r in read] == [(0, "tern", "Bird\nof the coast"), (1, "furl", "Roll up")]
    path = write("wide.csv", wide_file([('"two\nlines"', 90, 40, 0, 0), ("pier", 30, 0, 0, 2)]))
    assert as_dict(read_lexicon_wide(spark, path)) == {"two\nlines": ["Fruit"], "pier": ["Place"]}


def test_term_list(spark, write):
    terms = read_term_list(spark, write("names.lst", "Anna\n  BOB \n\n\t\nanna\nÉmile\n"))
    assert sorted(r["term"] for r in terms.collect()) == ["anna", "bob", "émile"]
    assert {"the", "and"} <= {r["term"] for r in stop_words(spark).collect()}
