"""Relational operators over pages, lines, transcriptions, entities and corpora."""
