"""Ids: captured turns, files, imported rows, workspaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import HIDDEN, RESERVED


def transcript_id(project: Column, adapter: Column, session: Column, event: Column, sequence: Column) -> Column:
    """The same turn always gets the same id, so that a replay is noticed."""
    nul = F.char(F.lit(0))
    joined = F.concat(*(x for part in (project, adapter, session, event, sequence) for x in (F.coalesce(part.cast("string"), F.lit("")), nul)))
    return F.concat(F.lit("transcript_"), F.left(F.sha2(joined, 256), F.lit(32)))


def file_identity(path: Column) -> Column:
    return F.left(F.sha2(path, 256), F.lit(32))


def import_id(*columns: Column) -> Column:
    """A repeatable id of an imported row that brings none."""
    return F.concat(F.lit("import_"), F.left(F.sha2(F.to_json(F.struct(*columns)), 256), F.lit(16)))


def normalised_path(path: Column) -> Column:
    """An absolute path with forward slashes, a lower-case drive and no dots; null for a relative one."""
    slashes = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    plain = F.regexp_replace(F.regexp_replace(slashes, "^//\\?/UNC/", "//"), "^//\\?/", "")
    drive = plain.rlike("^[A-Za-z]:/")
    prefix = F.when(plain.startswith("/"), "/").when(drive, F.concat(F.lower(F.left(plain, F.lit(1))), F.lit(":/")))
    rest = F.when(drive, F.substring(plain, 4, 2**31 - 1)).otherwise(plain)
    steps = F.filter(F.split(rest, "/"), lambda p: ~p.isin("", "."))
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda done, p: F.when(p == "..", F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)).otherwise(F.array_append(done, p)))
    return F.when(F.length(path) <= 4096, F.concat(prefix, F.array_join(kept, "/")))


def workspace(path: Column) -> dict[str, Column]:
    """id, display_name and legacy_project of the workspace at a path."""
    full = normalised_path(path)
    last = F.element_at(F.split(F.rtrim(full, F.lit("/")), "/"), -1)
    name = F.when(full.isNotNull(), F.when(last == "", "workspace").otherwise(last))
    slug = F.trim(F.left(F.regexp_replace(F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9_-]", "-"), F.lit(30)), F.lit("-"))
    slug = F.when(slug == "", "workspace").otherwise(slug)
    reserved = name.isin(*HIDDEN, "all", *RESERVED)
    return {
        "id": F.concat(F.lit("ws_"), slug, F.lit("_"), F.left(F.sha2(full, 256), F.lit(32))),
        "display_name": name,
        "legacy_project": F.when(~reserved, name),
    }
