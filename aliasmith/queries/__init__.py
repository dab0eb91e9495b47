"""Queries by name, each with SQL that gives the same rows where SQL can express it."""

from . import linking, mining, texts, vectors

QUERIES = {**texts.QUERIES, **mining.QUERIES, **linking.QUERIES, **vectors.QUERIES}
ORACLE_SQL = {**texts.SQL, **mining.SQL, **linking.SQL, **vectors.SQL}
