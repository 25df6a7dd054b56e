"""The registered queries: name -> function of (spark, sf_dir), and the same as SQL where SQL can say it."""

from . import derive, derive_sql, evidence, pages, pages_sql, relations, streams, texts

ALL_QUERIES = {k: v for m in (evidence, relations, texts, derive, pages, streams) for k, v in m.QUERIES.items()}
ALL_SQL = {k: v for m in (evidence, relations, texts, derive_sql, pages_sql, streams) for k, v in m.SQL.items()}
