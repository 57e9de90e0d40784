"""All registered queries."""


def _parts():
    from qualitylab.catalog import data, learning, stats, texts

    return [data.catalog, texts.catalog, stats.catalog, learning.catalog]


def all_queries() -> dict:
    return {name: query for part in _parts() for name, query in part.queries.items()}


def all_sql() -> dict:
    return {name: sql for part in _parts() for name, sql in part.sql.items()}
