"""Secret scan with an incremental blob ledger.

Every version of a path is a blob, addressed by the SHA-256 of its content. A
ledger holds the (blob, rule version) pairs already scanned, so that a run scans
only blobs that no earlier run has seen under these rules, each once however
many paths hold it, and joins the findings back to all paths.

Cases: a null text is the empty text; a null path is a path like any other;
repeated rows share their blob's findings; an empty table gives an empty result;
columns of any other name in the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, body, exists, small_batches, stash

#: Kinds in the order in which spans with one start are listed, with their least lengths.
KINDS = ("assign", "access", "hex")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
#: A change of any rule needs another version: the ledger's pairs then count as unseen.
RULE_VERSION = "base-1"

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{%d,}" % LEAST_HEX)
#: A literal that any assignment holds is far cheaper to look for than the pattern.
HINTS = ("pass", "secret", "token", "api")

#: Blobs that more than one in so many of the rows with findings hold are frequent; parts that their rows are dealt into.
FREQUENT, PARTS = 10_000, 64

LEDGER = "blob binary, rule_version string"
SPANS = "array<struct<kind:string, start:int, end:int>>"


@dataclass(frozen=True)
class SecretScan:
    """paths: (path, blob, spans) for every input row; findings: (blob, spans); ledger: all pairs scanned so far."""

    paths: DataFrame
    findings: DataFrame
    ledger: DataFrame


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of a text by start, then kind; code points, end exclusive."""
    low = text.lower()
    found = []
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], a, z) for a, k, z in sorted(found)]


def _scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches(rows):
        spans = [[dict(kind=k, start=a, end=z) for k, a, z in find_spans(t)] for t in batch.column("body").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(spans, shape)], ["blob", "spans"])


def scan_secrets(versions: DataFrame, path: str = "doc_id", text: str = "text", ledger: DataFrame | None = None, known: DataFrame | None = None, rule_version: str = RULE_VERSION, store: str | None = None) -> SecretScan:
    """Scan the blobs of ``versions`` that ``ledger`` doesn't hold; ``known`` has earlier findings (blob, spans).

    With ``store``, both are the table of that path, to which the scanned blobs are added: runs that name the same store
    scan no blob twice under the same rules.
    """
    spark = versions.sparkSession
    rows = versions.select(F.col(path).alias("path"), body(text).alias("body")).withColumn("blob", F.unhex(F.sha2("body", 256)))
    blobs = rows.groupBy("blob").agg(F.min("path").alias("carrier"))
    held = f"{LEDGER}, spans {SPANS}"
    if store is not None:
        ledger = spark.read.schema(held).parquet(store) if exists(spark, store) else None
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    # the carrier's row alone is scanned; keyed by blob and path, a blob that most paths hold is spread
    unseen = blobs.select(F.col("blob").alias("b"), "carrier")
    once = rows.join(unseen, (F.col("blob") == F.col("b")) & F.col("path").eqNullSafe(F.col("carrier")), "left_semi")
    scanned = once.select("blob", "body").mapInArrow(_scan, f"blob binary, spans {SPANS}").dropDuplicates(["blob"])
    if store is not None:
        small_batches(spark)
        scanned.select("blob", F.lit(rule_version).alias("rule_version"), "spans").write.mode("append").parquet(store)
        ledger = spark.read.schema(held).parquet(store)
        # runs at the same time may each have scanned a blob
        findings = ledger.where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select("blob", "spans").dropDuplicates(["blob"])
        ledger = ledger.select("blob", "rule_version")
    else:
        scanned = stash(scanned)
        findings = scanned.where(F.size("spans") > 0)
        if known is not None:
            findings = findings.unionByName(known.select("blob", "spans"))
        seen = scanned.select("blob", F.lit(rule_version).alias("rule_version"))
        ledger = seen if ledger is None else ledger.select("blob", "rule_version").unionByName(seen)
    return SecretScan(
        paths=rows.select("path", "blob").join(findings, "blob", "left").select("path", "blob", F.coalesce("spans", F.expr(f"cast(array() as {SPANS})")).alias("spans")),
        findings=findings,
        ledger=ledger,
    )


def span_list(spans: str = "spans") -> F.Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_report(docs: DataFrame, store: str | None = None) -> DataFrame:
    """One row per document: spans of each kind counted, all of them digested and listed; blobs that ``store`` holds aren't scanned again."""
    found = scan_secrets(docs, store=store).paths
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("path").alias("doc_id"), *map(count, KINDS), F.sha2(span_list(), 256).alias("base_sha256"), span_list().alias("spans"))


def masked(text: Column, spans: Column, mark: str) -> Column:
    """A text with each span (overlapping ones as one) replaced by the mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(done: Column, span: Column) -> Column:
        begin = F.when(span["start"] >= done["at"], F.concat(F.substring(text, done["at"] + 1, span["start"] - done["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.when(span["end"] <= done["at"], done).otherwise(F.struct(span["end"].alias("at"), F.concat(done["out"], begin).alias("out")))

    return F.aggregate(spans, start, cut, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.char_length(text) - done["at"])))


def mask_secrets(docs: DataFrame, mark: str = "[secret]", store: str | None = None) -> DataFrame:
    """The documents, with each found span (overlapping ones as one) replaced by ``mark``; all rows and columns stay.

    Rows meet their blob's findings by blob and, where more than one in ``FREQUENT`` rows holds that blob, by a part of
    the rows: no blob's copies are all in one task.
    """
    found = scan_secrets(docs, store=store).findings
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.unhex(F.sha2(body(), 256)).alias("blob"))
    copies = keyed.join(found.select("blob"), "blob", "left_semi").groupBy("blob").agg(F.count("*").alias("copies"))
    copies = stash(copies)
    least = max(PARTS, (copies.agg(F.sum("copies")).first()[0] or 0) // FREQUENT)
    often = copies.where(F.col("copies") >= least).select("blob", F.lit(True).alias("often"))  # ``FREQUENT`` rows at most
    part = F.when(F.col("often"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(PARTS))).otherwise(F.lit(0).cast("long"))
    rows = keyed.join(F.broadcast(often), "blob", "left").withColumn("part", part).drop("often")
    parts = F.when(F.col("often"), F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    spans = found.join(F.broadcast(often), "blob", "left").select("blob", "spans", F.explode(parts).alias("part"))
    both = rows.join(spans, ["blob", "part"], "left")
    text = F.when(F.col("spans").isNull(), F.col("row")["text"]).otherwise(masked(F.col("row")["text"].cast("string"), F.col("spans"), mark))
    return both.select(*((text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns))
