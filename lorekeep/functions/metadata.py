"""Open metadata: a VARIANT column read and changed by path, so that keys that no schema names survive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

OBJECT = "map<string,variant>"


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def parsed(text: str | Column) -> Column:
    """A JSON text as a variant; an empty object where it is null, blank, no JSON or no object."""
    found = F.try_parse_json(_col(text))
    return F.when(F.schema_of_variant(found).startswith("OBJECT"), found).otherwise(F.parse_json(F.lit("{}")))


def get_path(meta: str | Column, path: Sequence[str], kind: str = "string") -> Column:
    """The value at a path of keys; null where there is none or it isn't of the kind."""
    at = "$" + "".join("['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']" for key in path)
    return F.try_variant_get(_col(meta), at, kind)


def _members(meta: Column) -> Column:
    """An object's members; none of anything else."""
    return F.coalesce(F.try_variant_get(meta, "$", OBJECT), F.from_json(F.lit("{}"), OBJECT))


def set_path(meta: str | Column, path: Sequence[str], value: Column) -> Column:
    """The metadata with a value (a variant) at a path; objects on the way are made, what isn't one is replaced, all else stays."""
    key, rest = path[0], path[1:]
    members = _members(_col(meta))
    new = set_path(F.element_at(members, key), rest, value) if rest else value
    others = F.map_filter(members, lambda k, _: k != key)
    return F.to_variant_object(F.map_concat(others, F.create_map(F.lit(key), new)))


def remove_path(meta: str | Column, path: Sequence[str]) -> Column:
    """The metadata without what stands at a path."""
    key, rest = path[0], path[1:]
    members = _members(_col(meta))
    others = F.map_filter(members, lambda k, _: k != key)
    if not rest:
        return F.to_variant_object(others)
    inner = F.element_at(members, key)
    kept = F.map_concat(others, F.create_map(F.lit(key), remove_path(inner, rest)))
    return F.when(F.try_variant_get(inner, "$", OBJECT).isNotNull(), F.to_variant_object(kept)).otherwise(_col(meta))


def merged(meta: str | Column, patch: str | Column) -> Column:
    """The metadata with the members of another object over its own, key by key at the top; a member that is null takes a key away."""
    own, new = _members(_col(meta)), _members(_col(patch))
    kept = F.map_filter(own, lambda k, _: ~F.map_contains_key(new, k))
    return F.to_variant_object(F.map_concat(kept, F.map_filter(new, lambda _, x: ~F.is_variant_null(x))))


def text_of(meta: str | Column) -> Column:
    """The metadata as JSON."""
    return F.to_json(_col(meta))
