"""name -> SQL text for DuckDB."""

from __future__ import annotations

from importlib import import_module

SQL: dict[str, str] = {}
MODULES = ("text_sql", "structure_sql", "posting_sql", "match_sql", "score_sql", "version_sql", "rewrite_sql", "stream_sql")


def sql(name: str, text: str) -> None:
    SQL[name] = text


def all_sql() -> dict[str, str]:
    for m in MODULES:
        import_module(f"oracle.{m}")
    return dict(SQL)
