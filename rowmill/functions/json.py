"""Nested settings as JSON text: merge, write, look up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAP = "map<string,variant>"
DEPTH = 5


def _object(value: Column) -> Column:
    """Members of a JSON object; null for anything else."""
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), F.try_variant_get(value, "$", MAP))


def _merged(base: Column, patch: Column, depth: int) -> Column:
    """Members of both maps; the patch wins, its nulls remove, objects on both sides are merged in turn."""

    def member(_: Column, old: Column, new: Column) -> Column:
        if depth > 1:
            inner, changes = F.coalesce(_object(old), F.create_map().cast(MAP)), _object(new)
            nested = F.to_variant_object(_merged(inner, changes, depth - 1))
            return F.when(new.isNull(), old).when(changes.isNotNull(), nested).otherwise(new)
        return F.coalesce(new, old)

    return F.map_filter(F.map_zip_with(base, patch, member), lambda _, value: ~F.is_variant_null(value))


def merge_json(document: Column, patch: Column, depth: int = DEPTH) -> Column:
    """JSON text of an object with the changes of another, as a merge patch.

    A null member of the patch removes the member. Objects are merged member by member down to ``depth``
    levels and replaced as a whole below. A document that is no JSON object counts as an empty one;
    without a patch that is an object nothing changes. Members are written in the order of their names.
    """
    base = F.coalesce(_object(F.try_parse_json(document)), F.create_map().cast(MAP))
    changes = _object(F.try_parse_json(patch))
    return F.when(changes.isNull(), document).otherwise(F.to_json(F.to_variant_object(_merged(base, changes, depth))))


def json_keys(document: Column) -> Column:
    """Names of the members of an object, in order; empty for anything else."""
    return F.coalesce(F.array_sort(F.map_keys(_object(F.try_parse_json(document)))), F.array().cast("array<string>"))


def get_or(document: Column, path: str, kind: str, default: Column) -> Column:
    """The value at a path, or the default where there is none of that type."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(document), path, kind), default)


def total_of_lists(document: Column, path: str) -> Column:
    """Sum of all numbers in a list of lists; 0 where there is none."""
    lists = F.try_variant_get(F.try_parse_json(document), path, "array<array<double>>")
    # A member that is no list is null.
    numbers = F.flatten(F.filter(F.coalesce(lists, F.array().cast("array<array<double>>")), lambda x: x.isNotNull()))
    return F.aggregate(numbers, F.lit(0.0), lambda total, n: total + F.coalesce(n, F.lit(0.0)))
