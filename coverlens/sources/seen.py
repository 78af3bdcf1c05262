"""IDs that earlier runs have already emitted."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlens.functions.text import strip
from coverlens.sources import files

# IDs that a bucket of a table is meant to hold; tables have as many buckets, a power of two, as that asks for.
PER_BUCKET = 100_000
# Bits of a bucket's filter and bits set per ID: about one new ID in eighty is taken for one that may be there.
FILTER_BITS = 1 << 20
HASHES = 5
# Tables of one level that are merged into one of the next.
FAN = 4
WRITTEN = "{key} string, generation string, bucket int"
FILTERS = "bucket int, word int, bits bigint"


def read_id_list(spark: SparkSession, path: str, key: str = "nct_id") -> DataFrame:
    """IDs from text, one per line; blank lines are skipped and a missing path means none."""
    if not files.exists(spark, path):
        return spark.createDataFrame([], f"{key} string")
    return spark.read.text(path).select(strip("value").alias(key)).where(F.col(key) != "").distinct()


def write_id_list(ids: DataFrame, path: str, key: str = "nct_id") -> None:
    """All distinct IDs, sorted, one per line, to a path that does not exist yet."""
    ids.select(F.col(key).cast("string").alias("value")).distinct().orderBy("value").write.text(path)


def _bucket(key: str, buckets: Column | int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(buckets - 1).cast("long") if isinstance(buckets, int) else (buckets - 1).cast("long")).cast("int")


def _bits(key: str) -> Column:
    """The bits that an ID sets in its bucket's filter, as an array of (word, bit)."""
    first, step = F.hash(key).cast("long"), F.hash(F.reverse(key), F.lit(1)).cast("long").bitwiseOR(F.lit(1))
    at = [F.pmod(first + i * step, F.lit(FILTER_BITS)) for i in range(HASHES)]
    word, bit = F.lit("word"), F.lit("bit")
    return F.array(*[F.named_struct(word, F.shiftright(a, 6).cast("int"), bit, F.pmod(a, F.lit(64)).cast("int")) for a in at])


class SeenIds:
    """A growing set of IDs in a shared folder, of which a batch reads only what may hold its own.

    Each run adds a generation with its new IDs. Generations lie in tables: a table deals its IDs to buckets of about
    ``per_bucket`` by their hash, and keeps a Bloom filter per bucket if it has several. A batch looks up the filters of the buckets
    that its IDs fall into, and opens those buckets that may hold one; a table of one bucket it just opens. ``fan`` tables of a level are merged into one of the next, so their
    number grows with the logarithm of the runs. A manifest lists the tables that count and the generations in each; it
    is replaced as a whole once a table is complete, so whatever a crash leaves behind counts for nothing, and is removed with
    the tables that two manifests no longer name.

    Writing a generation again replaces it, which makes a repeated run harmless. A reset opens a new epoch and leaves the
    old one in place. One writer at a time; readers need no lock.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "nct_id", per_bucket: int = PER_BUCKET, fan: int = FAN) -> None:
        self.spark, self.root, self.key, self.per_bucket, self.fan = spark, root.rstrip("/"), key, per_bucket, fan

    def _epoch(self) -> str:
        return f"{self.root}/epoch={max(files.numbered(self.spark, self.root, 'epoch='), default=0)}"

    def _manifest(self, epoch: str) -> tuple[int, list[dict]]:
        """The latest manifest's number and its tables: name, level, buckets, generations."""
        numbers = files.numbered(self.spark, epoch, "manifest=")
        if not numbers:
            return 0, []
        return numbers[-1], json.loads(files.read_text(self.spark, f"{epoch}/manifest={numbers[-1]}/tables.json"))

    def _publish(self, epoch: str, number: int, tables: list[dict]) -> None:
        """Makes the tables those that count, and removes what this manifest and the one before it do not name."""
        before = {t["name"] for t in self._manifest(epoch)[1]}
        files.publish_text(self.spark, f"{epoch}/manifest={number}", "tables.json", json.dumps(tables))
        for old in files.numbered(self.spark, epoch, "manifest="):
            if old < number - 1:
                files.delete(self.spark, f"{epoch}/manifest={old}")
        for name in files.folders(self.spark, epoch):
            if name.startswith("table-") and name not in before and name not in {t["name"] for t in tables}:
                files.delete(self.spark, f"{epoch}/{name}")

    def tables(self) -> list[dict]:
        """The tables that count."""
        return self._manifest(self._epoch())[1]

    def generations(self) -> set[str]:
        return {g for t in self.tables() for g in t["generations"]}

    def _ids(self, epoch: str, table: dict, without: str | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """(key, generation) of a table: its current generations but one, from all buckets or some."""
        if not table["buckets"]:
            return self.spark.createDataFrame([], f"{self.key} string, generation string")
        path = f"{epoch}/{table['name']}/ids"
        paths = [path] if buckets is None else [f"{path}/bucket={b}" for b in buckets]
        rows = self.spark.read.schema(WRITTEN.format(key=self.key)).option("basePath", path).parquet(*paths)
        return rows.where(F.col("generation").isin([g for g in table["generations"] if g != without])).select(self.key, "generation")

    def load(self, without: int | str | None = None) -> DataFrame:
        """All IDs, or those of all generations but one, without white space around them."""
        epoch = self._epoch()
        found = self.spark.createDataFrame([], f"{self.key} string")
        for table in self._manifest(epoch)[1]:
            found = found.unionByName(self._ids(epoch, table, None if without is None else str(without)).select(strip(self.key).alias(self.key)))
        return found.where(F.col(self.key) != "").distinct()

    def among(self, batch: DataFrame, without: int | str | None = None) -> DataFrame:
        """The IDs of a stored batch that are in the set, or in a generation of it but one. Reads the filters of the buckets
        that the batch's IDs fall into, then the buckets that may hold one. Only bucket numbers reach the driver.

        The joins are merge joins by hint: Spark takes the IDs for a column like the others of the batch's file, though they are most
        of it, and would broadcast millions of them through the driver."""
        epoch, key = self._epoch(), self.key
        tables = self._manifest(epoch)[1]
        nothing = self.spark.createDataFrame([], f"{key} string")
        if not tables:
            return nothing
        keys = batch.select(F.col(key).cast("string").alias(key)).where(F.col(key) != "").distinct()
        opened = {i: [0] for i, t in enumerate(tables) if t["buckets"] == 1}
        large = {i: t for i, t in enumerate(tables) if t["buckets"] > 1}
        if large:
            for r in self._possible(epoch, large, keys).collect():
                opened.setdefault(r.place, []).append(r.bucket)
        found = nothing
        for place, buckets in sorted(opened.items()):
            own = self._ids(epoch, tables[place], None if without is None else str(without), sorted(buckets))
            found = found.unionByName(own.select(key))
        return found.join(keys.hint("merge"), key, "left_semi").distinct()

    def _possible(self, epoch: str, tables: dict[int, dict], keys: DataFrame) -> DataFrame:
        """(place, bucket) of the tables' buckets whose filters do not rule out all of the keys."""
        key, filters = self.key, None
        # Tables of equally many buckets share the buckets that the keys fall into.
        touched = {n: [r[0] for r in keys.select(_bucket(key, n)).distinct().collect()] for n in {t["buckets"] for t in tables.values()}}
        for i, table in tables.items():
            own = self.spark.read.schema(FILTERS).parquet(f"{epoch}/{table['name']}/filters").where(F.col("bucket").isin(touched[table["buckets"]]))
            own = own.select(F.lit(i).alias("place"), "bucket", "word", "bits")
            filters = own if filters is None else filters.unionByName(own)
        sizes = F.array(*[F.named_struct(F.lit("place"), F.lit(i), F.lit("buckets"), F.lit(t["buckets"])) for i, t in tables.items()])
        asked = keys.select(key, F.explode(sizes).alias("of"), _bits(key).alias("every"))
        asked = asked.select(key, F.col("of.place").alias("place"), _bucket(key, F.col("of.buckets")).alias("bucket"), F.explode("every").alias("one"))
        asked = asked.select(key, "place", "bucket", F.col("one.word").alias("word"), F.col("one.bit").alias("bit"))
        hit = asked.join(filters.hint("merge"), ["place", "bucket", "word"]).where(F.expr("shiftright(bits, bit) & 1") == 1)
        maybe = hit.groupBy(key, "place", "bucket").agg(F.count("*").alias("n")).where(F.col("n") == HASHES)
        return maybe.select("place", "bucket").distinct()

    def unseen(self, batch: DataFrame, without: int | str | None = None) -> DataFrame:
        """The rows of a stored batch whose ID is not in the set, or only in the generation left out (:meth:`among`)."""
        known = self.among(batch.select(self.key), without)
        return batch.join(known.hint("merge"), self.key, "left_anti")

    def _write(self, epoch: str, rows: DataFrame, level: int, generations: list[str]) -> dict:
        """A new table of (key, generation), with filters if it has several buckets. Without rows it is a name alone."""
        name = f"table-{uuid.uuid4().hex}"
        n = rows.count()
        buckets = 1 << ((n - 1) // self.per_bucket).bit_length() if n else 0
        table = {"name": name, "level": level, "buckets": buckets, "generations": generations}
        if not n:
            return table
        dealt = rows.withColumn("bucket", _bucket(self.key, buckets)).repartition(buckets, "bucket").sortWithinPartitions("bucket", self.key)
        dealt.write.partitionBy("bucket").parquet(f"{epoch}/{name}/ids")
        if buckets == 1:
            return table
        written = self.spark.read.schema(WRITTEN.format(key=self.key)).parquet(f"{epoch}/{name}/ids")
        bits = written.select("bucket", F.explode(_bits(self.key)).alias("one"))
        words = bits.groupBy("bucket", F.col("one.word").alias("word")).agg(F.expr("bit_or(shiftleft(1L, one.bit))").alias("bits"))
        words.select("bucket", "word", "bits").repartitionByRange(max(1, buckets // 64), "bucket").sortWithinPartitions("bucket", "word").write.option(
            "parquet.block.size", 1 << 20
        ).parquet(f"{epoch}/{name}/filters")
        return table

    def add(self, ids: DataFrame, generation: int | str | None = None) -> int | str:
        """Adds a generation, the next number if none is named, in place of what it held before; then merges what is due."""
        epoch = self._epoch()
        number, tables = self._manifest(epoch)
        if generation is None:
            generation = max((int(g) for t in tables for g in t["generations"] if g.isdigit()), default=0) + 1
        own = str(generation)
        rows = ids.select(F.col(self.key).cast("string").alias(self.key)).where(F.col(self.key) != "").distinct()
        table = self._write(epoch, rows.withColumn("generation", F.lit(own)), 0, [own])
        tables = [{**t, "generations": [g for g in t["generations"] if g != own]} for t in tables]
        self._publish(epoch, number + 1, [t for t in tables if t["generations"]] + [table])
        self.compact()
        return generation

    def compact(self) -> None:
        """Merges ``fan`` tables of a level into one of the next, as long as a level has so many."""
        epoch = self._epoch()
        while True:
            number, tables = self._manifest(epoch)
            due = next((level for level in sorted({t["level"] for t in tables}) if sum(t["level"] == level for t in tables) >= self.fan), None)
            if due is None:
                return
            merged = [t for t in tables if t["level"] == due]
            rows = None
            for t in merged:
                rows = self._ids(epoch, t) if rows is None else rows.unionByName(self._ids(epoch, t))
            table = self._write(epoch, rows, due + 1, [g for t in merged for g in t["generations"]])
            self._publish(epoch, number + 1, [t for t in tables if t["level"] != due] + [table])

    def reset(self) -> None:
        latest = max(files.numbered(self.spark, self.root, "epoch="), default=0)
        files.make_folder(self.spark, f"{self.root}/epoch={latest + 1}")
