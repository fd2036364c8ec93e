"""Registered queries and their SQL."""

from . import relations, retrieval, texts

QUERIES = {**retrieval.QUERIES, **relations.QUERIES, **texts.QUERIES}
SQL = {**retrieval.SQL, **relations.SQL, **texts.SQL}
