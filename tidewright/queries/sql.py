"""Pieces of SQL that several queries' SQL share."""

from __future__ import annotations


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lits(values) -> str:
    return ", ".join(lit(v) for v in values)


def trimmed(c: str) -> str:
    return f"nullif(trim({c}, ' '), '')"


def UP(c: str) -> str:  # noqa: N802
    """Upper case with the letters written out that the full case mapping writes out."""
    return f"replace(replace(replace(upper({c}), 'ẞ', 'SS'), 'ﬂ', 'FL'), 'ﬁ', 'FI')"


def fold(c: str) -> str:
    return UP(f"trim({c}, ' ')")


def cells(source: str, columns: list[str]) -> str:
    """column_name, v: every cell, trimmed, blank as null."""
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, nullif(trim(CAST({c} AS VARCHAR), ' '), '') AS v FROM {source}" for c in columns)
