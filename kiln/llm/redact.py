"""Replacing spans of a text, in SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def replaced(text: str, spans: str, mark: str) -> Column:
    """``text`` with ``mark`` in place of each span of ``spans`` (an array of structs whose start and end are code
    points, end exclusive, ordered by start); spans that overlap one before it are cut or skipped.  Null or no
    spans leave the text as it is."""
    mark = mark.replace("'", "\\'")
    return F.expr(f"""
        case when {spans} is null or size({spans}) = 0 then {text}
        else aggregate({spans}, struct(0 as at, cast('' as string) as out),
            (a, s) -> if(cast(s.end as int) <= a.at, a, struct(cast(s.end as int) as at,
                concat(a.out, substring({text}, a.at + 1, greatest(0, cast(s.start as int) - a.at)), '{mark}') as out)),
            a -> concat(a.out, substring({text}, a.at + 1))) end""")


def joined(spans: str) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')")
