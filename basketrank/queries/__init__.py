"""Registered queries on the star schema and their SQL twins."""

from basketrank.queries import candidates, features, models, ranking, runs, tables

_TOPICS = (tables, candidates, features, ranking, models, runs)

QUERIES = {name: query for topic in _TOPICS for name, query in topic.QUERIES.items()}
SQL = {name: text for topic in _TOPICS for name, text in topic.SQL.items()}
