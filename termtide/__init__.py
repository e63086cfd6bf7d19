"""Lexicon expansion with dictionaries, as Spark DataFrame jobs."""
