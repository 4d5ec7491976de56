"""Every query of the coastal library by name, with its DuckDB counterpart."""

from __future__ import annotations

from . import scenes, space, tide

ALL = {**scenes.QUERIES, **space.QUERIES, **tide.QUERIES}


def queries() -> dict:
    return {name: run for name, (run, _) in ALL.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
