"""Secrets in every version of every text, by an incremental ledger of blobs.

A version's text is addressed by its SHA-256: versions and paths with equal texts are one blob. The ledger keeps, per
blob, which versions of which rules have scanned it and what they found. A run scans only pairs of blob and rule version
that the ledger lacks, appends them, and joins what the ledger then holds back to all paths and versions.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlens.llm.common import small_batches, without
from coverlens.session import shared_path
from coverlens.sources import files


class Rule(NamedTuple):
    """A match counts if its group has at least ``least`` characters; shorter ones are passed over whole."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# Runs of hexadecimal digits and access keys are matched in their least length: as such runs are maximal, that is the same.
BASE = (
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
)
RULES = (
    *BASE,
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 1),
)
SPAN = "struct<kind:string,version:int,start:int,end:int>"
LEDGER = f"blob string, rules array<string>, found array<{SPAN}>"


def spans(text: str, rules: tuple[Rule, ...]) -> list[tuple[str, int, int, int]]:
    """Matches of each rule, leftmost first and not overlapping: kind, version, start, end in code points."""
    found = []
    for rule in rules:
        for match in re.finditer(rule.pattern, text, re.ASCII):
            if len(match[rule.group]) >= rule.least:
                found.append((rule.kind, rule.version, *match.span()))
    return found


def _scanning(rules: tuple[Rule, ...]):
    by_name = {r.name: r for r in rules}
    span = pa.struct([("kind", pa.string()), ("version", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])

    def scan(batches):
        for batch in batches:
            missing, found = batch.column("missing").to_pylist(), []
            for row, names in enumerate(missing):
                text = batch.column("text")[row].as_py()
                found.append([dict(zip(("kind", "version", "start", "end"), s)) for s in spans(text, tuple(by_name[n] for n in names))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("blob"), pa.array(missing, pa.list_(pa.string())), pa.array(found, pa.list_(span))], ["blob", "rules", "found"]
            )

    return scan


class Ledger:
    """What has been scanned, in a folder that all executors reach: one generation per run, only ever added to.

    A run that is repeated under its number replaces its own generation and looks at all others only.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or shared_path(spark, "secret-ledger")).rstrip("/")

    def read(self, without: int | None = None) -> DataFrame | None:
        """Rows (blob, rules, found) of all generations but one; a blob has one row per run that scanned it for a rule."""
        paths = [f"{self.root}/gen={n}" for n in files.numbered(self.spark, self.root, "gen=") if n != without]
        return self.spark.read.schema(LEDGER).parquet(*paths) if paths else None

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, run: int | None = None) -> int:
        """Scans the blobs of ``versions`` (text) for the rule versions that the ledger lacks of them; returns the run's number."""
        if run is None:
            run = max(files.numbered(self.spark, self.root, "gen="), default=0) + 1
        blobs = small_batches(versions).select(address(), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["blob"])
        wanted = F.array(*[F.lit(r.name) for r in rules])
        known = self.read(without=run)
        if known is not None:
            had = known.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("had"))
            blobs = blobs.join(had, "blob", "left")
            wanted = F.array_except(wanted, F.coalesce("had", F.array().cast("array<string>")))
        todo = blobs.select("blob", "text", wanted.alias("missing")).where(F.size("missing") > 0)
        todo.mapInArrow(_scanning(rules), LEDGER).write.mode("overwrite").parquet(f"{self.root}/gen={run}")
        return run

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Rows (blob, spans) of the blobs in which these rule versions found something, by start and the rules' order."""
        known = self.read()
        if known is None:
            return self.spark.createDataFrame([], f"blob string, spans array<{SPAN}>")
        names = F.array(*[F.lit(r.name) for r in rules])

        def place(s):
            return F.array_position(names, F.concat_ws("@", s["kind"], s["version"].cast("string")))

        own = known.select("blob", F.filter("found", lambda s: place(s) > 0).alias("own")).where(F.size("own") > 0)
        every = own.groupBy("blob").agg(F.flatten(F.collect_list("own")).alias("own"))
        placed = F.transform("own", lambda s: F.struct(s["start"].alias("start"), place(s).alias("place"), s.alias("span")))
        return every.select("blob", F.transform(F.array_sort(placed), lambda s: s["span"]).alias("spans"))


def address(text: str = "text") -> F.Column:
    """The address of a version's content. A null text is empty."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("blob")


def secrets(versions: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES, run: int | None = None) -> DataFrame:
    """``versions`` (text and any columns that name a path and version) without text, with blob and spans.

    spans are structs (kind, version, start, end), in code points with the end exclusive, by start and then in the order
    of the rules; empty if there are none. Matches of one rule do not overlap, those of different rules may. A null text
    is empty. Every row is returned, repeated rows too; each distinct text is scanned once, and not at all for rule versions
    that the ledger holds of it. Columns named blob or spans are replaced. A very long text is scanned whole, by one task.

    Texts move once, to meet their equals, and equal texts of a task are one before that. The join back has a row per
    text with findings on one side; a text that many rows share is split by adaptive execution.
    """
    ledger = ledger or Ledger(versions.sparkSession)
    ledger.scan(versions, rules, run)
    paths = without(versions.withColumn("blob", address()), "text", "spans")
    joined = paths.join(ledger.findings(rules), "blob", "left")
    return joined.withColumn("spans", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")))
