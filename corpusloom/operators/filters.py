"""The filter dictionary as one boolean column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RANGE = {"$gte": "__ge__", "$gt": "__gt__", "$lte": "__le__", "$lt": "__lt__"}


def predicate(df: DataFrame, filters: dict | None) -> Column | None:
    """Scalars by equality (membership for arrays), lists by any-of, ``$`` ranges; all of them.

    Empty lists and dictionaries of other operators drop their condition; a missing
    key or a null never matches; no filters give None.
    """
    parts = []
    for name, value in (filters or {}).items():
        known = name in df.columns
        array = known and isinstance(df.schema[name].dataType, T.ArrayType)
        if isinstance(value, dict):
            ranges = [getattr(F.col(name), _RANGE[op])(F.lit(x)) if known else F.lit(False) for op, x in value.items() if op in _RANGE]
            parts += [F.coalesce(r, F.lit(False)) for r in ranges]
        elif isinstance(value, (list, tuple, set)):
            if value:
                items = sorted(value, key=str)
                found = F.arrays_overlap(F.col(name), F.array(*map(F.lit, items))) if array else F.col(name).isin(items) if known else F.lit(False)
                parts.append(F.coalesce(found, F.lit(False)))
        else:
            found = F.array_contains(F.col(name), value) if array else F.col(name) == F.lit(value) if known else F.lit(False)
            parts.append(F.coalesce(found, F.lit(False)))
    return reduce(Column.__and__, parts) if parts else None


def apply_filters(df: DataFrame, filters: dict | None) -> DataFrame:
    condition = predicate(df, filters)
    return df if condition is None else df.filter(condition)


def scoped(filters: dict | None, user_id: str | None) -> dict | None:
    """the same filters for one tenant; no tenant changes nothing."""
    return filters if user_id is None else {**(filters or {}), "user_id": user_id}


def delete_by_filter(df: DataFrame, filters: dict) -> DataFrame:
    """What a deletion leaves; without any condition it is refused."""
    condition = predicate(df, filters)
    if condition is None:
        raise ValueError("a deletion needs a condition")
    return df.filter(~condition)
