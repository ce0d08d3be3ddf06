"""Where catalogue modules register their queries."""

from __future__ import annotations

from collections.abc import Callable

from surveyloom.sources.surveys import SURVEYS_SQL

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

# DuckDB forms of the score arithmetic
MEAN = "CAST(sum(CAST({0} AS DECIMAL(6,4))) AS DOUBLE) / count({0})"
TOP = "CASE WHEN {0} = 1 THEN 1.0 WHEN {0} > 0 THEN {0} ELSE 0.0 END"
TOP_MEAN = "CAST(sum(CAST(CASE WHEN {0} = 1 THEN 1.0 WHEN {0} > 0 THEN {0} ELSE 0.0 END AS DECIMAL(6,4))) AS DOUBLE) / count(*)"
CLAMPED_MEAN = "CAST(sum(CAST(CASE WHEN {0} >= 1 THEN 1.0 WHEN {0} > 0 THEN {0} ELSE 0.0 END AS DECIMAL(6,4))) AS DOUBLE) / count(*)"


def r4(x: str) -> str:
    return f"(sign({x}) * floor(abs({x}) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE)"


def query(name: str, sql: str | None = None, surveys: bool = True):
    """Register a function (spark, sf_dir); its SQL gets the survey tables as a WITH clause."""

    def register(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = f"WITH {SURVEYS_SQL}{'' if sql.lstrip().upper().startswith('SELECT') else ','}\n{sql.strip()}" if surveys else sql.strip()
        return f

    return register


def soundex(x: str) -> str:
    """SQL for the sound of a word as Spark gives it: the first letter, then codes that differ from the one before."""
    codes = f"list_filter(str_split(translate(upper({x}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ ', '012301270224550126230172020'), ''), lambda c, i: i = 1 OR c <> '7')"
    return f"rpad(left(upper({x}), 1) || left(array_to_string(list_filter(list_filter({codes}, lambda c, i: i > 1 AND c <> ({codes})[i - 1]), lambda c: c <> '0'), ''), 3), 4, '0')"
