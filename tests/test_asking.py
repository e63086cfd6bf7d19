import pytest
from pyspark.sql import functions as F

from termtide.functions.prompts import few_shot_prefix, prompt, prompt_context, prompt_details
from termtide.plans.asking import ask_labels
from termtide.sources.tables import known_answers, read_answers

LABELS = ["Social", "Bio"]
QUESTION = 'which label should be assigned to the word "w" from the following "L" labels: social, bio?'


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_prompts(spark):
    context = one(spark, prompt_context(F.lit("w"), F.lit("some 100% text"), "L", LABELS))
    assert context == 'In the following context: \n"some 100% text", \n' + QUESTION
    details = one(spark, prompt_details(F.lit("w"), F.lit("def"), F.lit("ex"), "L", LABELS))
    assert details == (
        'For a word with the following meaning: \n"def\n"in this example: \n"ex" \n' + QUESTION
    )
    no_example = F.lit(None).cast("string")
    asked = one(spark, prompt(F.lit("w"), F.lit("some 100% text"), "L", LABELS, no_example, label_only=True))
    assert asked == context + "\nRespond with label only"


@pytest.mark.parametrize("word, text", [("", "t"), ("w", ""), ("w", None)])
def test_prompt_needs_word_and_text(spark, word, text):
    with pytest.raises(Exception, match="prompt without"):
        one(spark, prompt_context(F.lit(word), F.lit(text).cast("string"), "L", LABELS))


def test_few_shot(spark):
    examples = spark.createDataFrame([("run", "bio"), ("friend", "social")], "word string, label string")
    text = few_shot_prefix(examples, "L").first()["prefix"]
    assert text == (
        "Using the following L labels for the following words as example:\n"
        '"friend" labeled as "social"\n"run" labeled as "bio"\n'
    )


def counting(log):
    """An answerer that notes each question asked."""

    def load():
        def reply(prompts):
            with open(log, "a", encoding="utf8") as out:
                out.writelines("asked\n" for _ in prompts)
            return ["It is Bio, or social" if "blood" in p else "no idea" for p in prompts]

        return reply

    return load


def test_each_prompt_is_asked_once(spark, tmp_path):
    log, answers = str(tmp_path / "log"), str(tmp_path / "answers")
    rows = [(1, "heart", "blood pump"), (2, "heart", "blood pump"), (3, "sky", "blue")]
    entries = spark.createDataFrame(rows, "id bigint, word string, text string")

    def run(df, model="m", **options):
        out = ask_labels(df, counting(log), LABELS, "L", model, answers, **options)
        return {r["id"]: r["label_out"] for r in out.collect()}

    def asked():
        with open(log, encoding="utf8") as lines:
            return len(lines.readlines())

    assert run(entries) == {1: "bio", 2: "bio", 3: None}
    assert asked() == 2
    assert run(entries, parallel_calls=2) == {1: "bio", 2: "bio", 3: None}
    assert asked() == 2
    more = entries.union(spark.createDataFrame([(4, "vein", "blood way")], entries.schema))
    assert run(more)[4] == "bio"
    assert asked() == 3
    # another model has its own answers, a worked example makes other prompts
    run(entries, model="other")
    assert asked() == 5
    examples = spark.createDataFrame([("arm", "bio")], "word string, label string")
    assert run(entries, examples=examples)[1] == "bio"
    assert asked() == 7
    assert known_answers(spark, answers).count() == 7


def test_last_answer_counts(spark, write):
    path = write("a.jsonl", '{"key": "k", "value": "1"}\n{"key": "j", "value": "5"}\n{"key": "k", "value": "2"}\n')
    assert {r["key"]: r["value"] for r in read_answers(spark, path).collect()} == {"k": "2", "j": "5"}


def test_few_shot_in_the_given_order_and_number(spark, monkeypatch):
    from termtide.functions import prompts

    rows = [(2, "friend", "social"), (1, "run", "bio"), (3, "arm", "bio")]
    examples = spark.createDataFrame(rows, "ord int, word string, label string")
    lines = few_shot_prefix(examples, "L").first()["prefix"].split("\n")
    assert lines[1:] == ['"run" labeled as "bio"', '"friend" labeled as "social"', '"arm" labeled as "bio"', ""]
    monkeypatch.setattr(prompts, "MAX_EXAMPLES", 2)
    with pytest.raises(Exception, match="more than 2 worked examples"):
        few_shot_prefix(examples, "L").collect()
