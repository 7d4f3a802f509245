"""All registered queries of the requirement operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import catalog, files


def queries() -> dict[str, Callable]:
    return {**catalog.queries(), **files.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**catalog.oracle_sql(), **files.oracle_sql()}
