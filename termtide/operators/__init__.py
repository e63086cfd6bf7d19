"""Operators: functions from DataFrames to DataFrames.

Table shapes used throughout:

- entries: ``id BIGINT, word, text`` and, when known, ``quality``, ``dictionary``, ``pos``
- lexicon: ``word, label, ord BIGINT``, one row per word and label in file order
- label lists: ``word, labels ARRAY<STRING>``, one row per word
- hierarchy: ``child, parent`` with a null parent at a root
- terms: ``term``
- scored entries: entries with ``label_out, prob_out``
"""
