"""Readers and writers of lexicons, dictionaries, term lists, datasets and answers."""
