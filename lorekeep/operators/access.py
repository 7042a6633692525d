"""Policies, audit lines, a vault of encrypted values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids that an audit line names at most; principals, grants and days that a policy may have.
TARGETS, PRINCIPALS, GRANTS, DAYS = 50, 128, 256, 3650
MARK = "$enc2$"


def policy_problems(policy: dict) -> list[str]:
    """What is wrong with a policy; it is small and read on the driver."""
    people = policy.get("principals", [])
    out = []
    if not 1 <= len(people) <= PRINCIPALS:
        out.append("number of principals")
    if not any(p.get("admin") for p in people):
        out.append("no administrator")
    for key in ("id", "token_sha256"):
        values = [p.get(key) for p in people]
        if len(set(values)) != len(values):
            out.append(f"{key} given twice")
    for p in people:
        reads, writes = p.get("read_projects", []), p.get("write_projects", [])
        if not re.fullmatch(r"[A-Za-z0-9._-]{1,64}", p.get("id") or ""):
            out.append("id")
        if not re.fullmatch(r"[0-9a-f]{64}", p.get("token_sha256") or ""):
            out.append("token digest")
        if not set(writes) <= set(reads):
            out.append("writes what it can't read")
        if len(reads) > GRANTS or len(writes) > GRANTS:
            out.append("number of grants")
    if any(not 1 <= d <= DAYS for d in policy.get("retention_days", {}).values()):
        out.append("retention days")
    return out


def audit_events(operations: DataFrame) -> DataFrame:
    """Audit lines (created_at, actor, action, outcome, target_ids) of operations, with at most 50 ids each."""
    return operations.select("created_at", F.coalesce("actor", F.lit("unauthenticated")).alias("actor"), "action", "outcome", F.slice(F.coalesce("ids", F.array().cast("array<string>")), 1, TARGETS).alias("target_ids"))


def sealed(secrets: DataFrame, key: Column) -> DataFrame:
    """``secrets`` (name, kind, value, note) with its value encrypted; the name is bound to the ciphertext."""
    out = F.concat(F.lit(MARK), F.base64(F.aes_encrypt("value", key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), F.col("name"))))
    return secrets.withColumn("ciphertext", out).drop("value")


def opened(vault: DataFrame, key: Column) -> DataFrame:
    """Values again; null for a row that another key sealed, that was moved to another name, or that isn't sealed at all."""
    raw = F.unbase64(F.substring("ciphertext", len(MARK) + 1, 2**31 - 1))
    value = F.try_aes_decrypt(raw, key, F.lit("GCM"), F.lit("DEFAULT"), F.col("name")).cast("string")
    return vault.withColumn("value", F.when(F.col("ciphertext").startswith(MARK), value)).drop("ciphertext")


def listed(vault: DataFrame) -> DataFrame:
    """Names without values."""
    return vault.select("name", "kind", "note")
