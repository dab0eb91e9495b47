"""Readers and writers of the formats in which pages, counts, aliases, judgments and vectors come."""
