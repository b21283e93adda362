"""The metadata filter language: nested dicts to Columns (which reach the Parquet scan) and to SQL text."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARISONS = {"$gt": ">", "$gte": ">=", "$lt": "<", "$lte": "<="}
DEEPEST = 50


def compile_where(node: dict[str, Any] | None) -> Column:
    """Equality, ``$eq $ne $in $nin $gt $gte $lt $lte`` on fields under ``$and $or $not``.

    A missing value is unequal to any; an empty ``$and`` holds, an empty ``$or`` does not; anything
    unknown raises ValueError."""
    if not node:
        return F.lit(True)
    parts = []
    for key, value in node.items():
        if key in ("$and", "$or"):
            subs = [compile_where(v) for v in value]
            join = (lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b)
            parts.append(reduce(join, subs, F.lit(key == "$and")))
        elif key == "$not":
            parts.append(~compile_where(value))
        elif key.startswith("$"):
            raise ValueError(f"unknown operator {key}")
        else:
            parts.append(_field(F.col(key), value))
    return reduce(lambda a, b: a & b, parts)


def _field(c: Column, value: Any) -> Column:
    if not isinstance(value, dict):
        return F.coalesce(c == F.lit(value), F.lit(False)) if value is not None else c.isNull()
    out = []
    for op, v in value.items():
        if op == "$eq":
            out.append(_field(c, v))
        elif op == "$ne":
            out.append(~c.eqNullSafe(F.lit(v)))
        elif op == "$in":
            out.append(F.coalesce(c.isin(list(v)), F.lit(False)) if v else F.lit(False))
        elif op == "$nin":
            out.append(~F.coalesce(c.isin(list(v)), F.lit(False)) if v else F.lit(True))
        elif op in COMPARISONS:
            out.append(F.coalesce({"$gt": c > v, "$gte": c >= v, "$lt": c < v, "$lte": c <= v}[op], F.lit(False)))
        elif op == "$not":
            out.append(~_field(c, v))
        else:
            raise ValueError(f"unknown operator {op}")
    return reduce(lambda a, b: a & b, out, F.lit(True))


def _literal(v: Any) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else repr(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def to_sql(node: dict[str, Any] | None) -> str:
    """The same filter as SQL text."""
    if not node:
        return "TRUE"
    parts = []
    for key, value in node.items():
        if key in ("$and", "$or"):
            parts.append("(" + (" AND " if key == "$and" else " OR ").join(map(to_sql, value)) + ")" if value else str(key == "$and").upper())
        elif key == "$not":
            parts.append(f"NOT ({to_sql(value)})")
        else:
            parts.append(_field_sql(key, value))
    return "(" + " AND ".join(parts) + ")"


def _field_sql(c: str, value: Any) -> str:
    if not isinstance(value, dict):
        return f"coalesce({c} = {_literal(value)}, FALSE)" if value is not None else f"{c} IS NULL"
    out = []
    for op, v in value.items():
        if op == "$eq":
            out.append(_field_sql(c, v))
        elif op == "$ne":
            out.append(f"{c} IS DISTINCT FROM {_literal(v)}")
        elif op in ("$in", "$nin"):
            inside = f"coalesce({c} IN ({', '.join(map(_literal, v))}), FALSE)" if v else "FALSE"
            out.append(inside if op == "$in" else f"NOT {inside}")
        elif op == "$not":
            out.append(f"NOT ({_field_sql(c, v)})")
        else:
            out.append(f"coalesce({c} {COMPARISONS[op]} {_literal(v)}, FALSE)")
    return "(" + " AND ".join(out) + ")"


def asks_for_notes(where: Any, negated: bool = False, depth: int = 0) -> bool:
    """Whether a filter names notes as wanted: ``source_type`` equal to note somewhere under no negation.

    Beside ``$not``, siblings are not looked at, and a doubly negated ``$ne`` is not recognised."""
    if depth > DEEPEST:
        return False
    if isinstance(where, list):
        return any(asks_for_notes(w, negated, depth + 1) for w in where)
    if not isinstance(where, dict):
        return False
    if "$not" in where:
        return asks_for_notes(where["$not"], not negated, depth + 1)
    kind = where.get("source_type")
    wanted = kind == "note" or isinstance(kind, dict) and (kind.get("$eq") == "note" or "note" in (kind.get("$in") or []))
    below = [v for k, v in where.items() if isinstance(v, (dict, list))]
    return wanted and not negated or any(asks_for_notes(v, negated, depth + 1) for v in below if not (wanted and v is kind))


def effective(where: dict[str, Any] | None, *, include_notes: bool = False, item_keys: list[str] | None = None) -> dict[str, Any] | None:
    """The filter with notes left out, unless they are asked for, and restricted to item keys, if any."""
    parts = [where] if where else []
    if not include_notes and not asks_for_notes(where):
        parts.append({"source_type": {"$ne": "note"}})
    if item_keys:
        parts.append({"itemKey": {"$in": list(item_keys)}})
    return parts[0] if len(parts) == 1 else {"$and": parts} if parts else None
