"""Fixed values of the known lexicon formats.

They must equal the values users' files are made for, so they are listed as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termtide.session import local_table

# Label tree of the 2015 psychological category lexicon, child -> parent.
PSYCH_2015_TREE: dict[str, str | None] = {
    "function": None,
    "pronoun": "function",
    "ppron": "pronoun",
    "i": "ppron",
    "we": "ppron",
    "you": "ppron",
    "shehe": "ppron",
    "they": "ppron",
    "ipron": "pronoun",
    "article": "function",
    "prep": "function",
    "auxverb": "function",
    "adverb": "function",
    "conj": "function",
    "negate": "function",
    "verb": "function",
    "adj": "function",
    "compare": "function",
    "interrog": "function",
    "number": "function",
    "quant": "function",
    "affect": None,
    "posemo": "affect",
    "negemo": "affect",
    "anx": "negemo",
    "anger": "negemo",
    "sad": "negemo",
    "social": None,
    "family": "social",
    "friend": "social",
    "female": "social",
    "male": "social",
    "cogproc": None,
    "insight": "cogproc",
    "cause": "cogproc",
    "discrep": "cogproc",
    "tentat": "cogproc",
    "certain": "cogproc",
    "differ": "cogproc",
    "percept": None,
    "see": "percept",
    "hear": "percept",
    "feel": "percept",
    "bio": None,
    "body": "bio",
    "health": "bio",
    "sexual": "bio",
    "ingest": "bio",
    "drives": None,
    "affiliation": "drives",
    "achiev": "drives",
    "power": "drives",
    "reward": "drives",
    "risk": "drives",
    "timeorient": None,
    "focuspast": "timeorient",
    "focuspresent": "timeorient",
    "focusfuture": "timeorient",
    "relativ": None,
    "motion": "relativ",
    "space": "relativ",
    "time": "relativ",
    "pconcern": None,
    "work": "pconcern",
    "leisure": "pconcern",
    "home": "pconcern",
    "money": "pconcern",
    "relig": "pconcern",
    "death": "pconcern",
    "informal": None,
    "swear": "informal",
    "netspeak": "informal",
    "assent": "informal",
    "nonflu": "informal",
    "filler": "informal",
}

# Label tree of the personal values lexicon, child -> parent.
VALUES_TREE: dict[str, str | None] = {
    "autonomy": "life",
    "creativity": "cognition",
    "emotion": "cognition",
    "moral": "cognition",
    "cognition": "life",
    "future": "cognition",
    "thinking": "cognition",
    "security": "order",
    "inner-peace": "order",
    "order": "life",
    "justice": "life",
    "advice": "life",
    "career": "life",
    "achievement": "life",
    "wealth": "life",
    "health": "life",
    "learning": "life",
    "nature": "life",
    "animals": "life",
    "purpose": "work-ethic",
    "responsible": "work-ethic",
    "hard-work": "work-ethic",
    "work-ethic": None,
    "perseverance": "work-ethic",
    "feeling-good": None,
    "forgiving": "accepting-others",
    "accepting-others": None,
    "helping-others": "society",
    "gratitude": None,
    "dedication": None,
    "self-confidence": None,
    "optimisim": None,
    "honesty": "truth",
    "truth": None,
    "spirituality": "religion",
    "religion": None,
    "significant-other": "relationships",
    "marriage": "significant-other",
    "friends": "relationships",
    "relationships": "social",
    "family": "relationships",
    "parents": "family",
    "siblings": "family",
    "social": None,
    "children": "family",
    "society": "social",
    "art": "life",
    "respect": "self-confidence",
    "life": None,
}

# Labels of the personal values lexicon used by default.
VALUES_USED = [
    "life",
    "parents",
    "truth",
    "religion",
    "social",
    "feeling-good",
    "children",
    "animals",
    "learning",
    "order",
    "accepting-others",
]

# Columns of the wide tool output that are no categories.
WIDE_NOT_CATEGORIES = [
    "ColumnID",
    "Segment",
    "WC",
    "Analytic",
    "Clout",
    "Authentic",
    "Tone",
    "WPS",
    "BigWords",
    "Dic",
    "Linguistic",
    "function",
    "pronoun",
    "ppron",
    "i",
    "we",
    "you",
    "shehe",
    "they",
    "ipron",
    "det",
    "article",
    "number",
    "prep",
    "auxverb",
    "adverb",
    "conj",
    "negate",
    "verb",
    "adj",
    "focuspast",
    "focuspresent",
    "focusfuture",
    "AllPunc",
    "Period",
    "Comma",
    "QMark",
    "Exclam",
    "Apostro",
    "OtherP",
]

# Columns of the raw vote dictionary.
VOTE_COLUMNS = [
    "word",
    "timestamp",
    "author",
    "meaning",
    "example",
    "date",
    "numLikes",
    "numDislikes",
    "tagList",
]


def hierarchy_table(spark: SparkSession, tree: dict[str, str | None]) -> DataFrame:
    """A label tree as the ``child, parent`` table."""
    return local_table(spark, {"child": tree.keys(), "parent": tree.values()})
