"""A cohort that follows its reports: latest versions and deletions by case, and the daily facts of temporal RORs, changed by
differences.

Events come in micro-batches in any order and any split: versions of a case, or tombstones that delete it for good. A batch is
reduced to a row a case, met with the buckets of the state that hold its cases, and only those buckets are written anew. What
a case gave to the daily facts before is taken back, what it gives now is added; the facts are a log of such differences, so
encodings from strictly earlier dates are read from a row a key and day, never from reports again.

The state is a folder of immutable tables, one set a batch, that the manifest of the batch makes valid: it is written last. A
batch that is run again after a failure writes the same tables once more; one that was finished is passed over. Cases with
null ids are left out, as in the batch build; null versions and dates come after all others; a report without a date gives no
fact. Events that come twice change nothing. An empty batch leaves the state as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.risk import prior_of

#: Parts that cases are dealt to; a batch rewrites those it touches.
BUCKETS = 64


class CaseState:
    """Cases and daily facts in a shared folder. Events: caseid, report, caseversion, report_date, is_serious, split, dc_ids, and
    `deleted`, whether the event is a tombstone (only its case counts then)."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    # --- what is valid ---

    def _names(self, table: str) -> list[str]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def committed(self) -> list[int]:
        """Finished batches in order: those whose manifest is complete."""
        return sorted(int(n.split("=")[1]) for n in self._names("manifest") if n.startswith("batch=") and "_SUCCESS" in self._names(f"manifest/{n}"))

    def _places(self) -> dict[int, int]:
        """The batch that wrote each bucket last: as many rows as there are buckets."""
        done = self.committed()
        if not done:
            return {}
        return {r["bucket"]: r["written"] for r in self.spark.read.parquet(f"{self.folder}/manifest/batch={done[-1]}").collect()}

    def _cases(self, buckets: list[int] | None) -> DataFrame | None:
        at = {b: w for b, w in self._places().items() if buckets is None or b in buckets}
        return self.spark.read.parquet(*[f"{self.folder}/cases/batch={w}/bucket={b}" for b, w in sorted(at.items())]) if at else None

    # --- a batch ---

    def merge(self, events: DataFrame, batch: int) -> None:
        """One micro-batch; also the function of foreachBatch."""
        done = self.committed()
        if done and batch <= done[-1]:
            return
        deleted = F.coalesce(F.col("deleted"), F.lit(False))
        row = F.struct("report", F.col("caseversion").cast("long").alias("caseversion"), F.col("report_date").cast("date").alias("report_date"), F.col("is_serious").cast("int").alias("is_serious"), F.col("split").cast("string").alias("split"), F.array_sort(F.array_distinct(F.coalesce("dc_ids", F.array()).cast("array<long>"))).alias("dc_ids"))
        named = events.where(F.col("caseid").isNotNull()).select("caseid", row.alias("row"), deleted.alias("deleted"))
        best = named.groupBy("caseid").agg(F.max_by(F.when(~F.col("deleted"), F.col("row")), F.when(~F.col("deleted"), _order("row"))).alias("row"), F.bool_or("deleted").alias("deleted"))
        incoming = f"{self.folder}/incoming/batch={batch}"
        best.withColumn("bucket", F.pmod(F.xxhash64("caseid"), F.lit(self.buckets)).cast("int")).write.mode("overwrite").parquet(incoming)
        new = self.spark.read.parquet(incoming)
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # BUCKETS at most
        if not touched:
            return
        old = self._cases(touched)
        if old is None:
            old = new.select("caseid", "row", "deleted").where("false")
        both = new.withColumnsRenamed({"row": "new", "deleted": "gone"}).join(old.select("caseid", F.col("row").alias("old"), F.col("deleted").alias("was")), "caseid", "full")
        better = F.col("old").isNull() | (F.col("new").isNotNull() & (_order("new") > _order("old")))
        after = both.select(
            "caseid", F.pmod(F.xxhash64("caseid"), F.lit(self.buckets)).cast("int").alias("bucket"), F.col("old").alias("before"), F.coalesce("was", F.lit(False)).alias("was"),
            F.when(better, F.col("new")).otherwise(F.col("old")).alias("row"), (F.coalesce("gone", F.lit(False)) | F.coalesce("was", F.lit(False))).alias("deleted"),
        )
        path = f"{self.folder}/cases/batch={batch}"
        after.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        written = self.spark.read.parquet(path)
        changed = written.where((F.col("was") != F.col("deleted")) | ~F.col("before").eqNullSafe(F.col("row")))
        self._differences(changed).write.mode("overwrite").parquet(f"{self.folder}/facts/batch={batch}")
        places = self._places() | dict.fromkeys(touched, batch)
        self.spark.createDataFrame(sorted(places.items()), "bucket int, written long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/batch={batch}")

    def _differences(self, changed: DataFrame) -> DataFrame:
        """(dc_id, report_date, serious, calm) to add: a null dc_id stands for all reports of the day."""
        sides = changed.select(F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.when(~F.col("was"), F.col("before")).alias("row")), F.struct(F.lit(1).alias("sign"), F.when(~F.col("deleted"), F.col("row")).alias("row")))).alias("x")).select("x.sign", "x.row.*")
        used = sides.where("split = 'train' and report_date is not null and is_serious is not null")
        # the day's total comes beside the drugs
        each = used.select("sign", "report_date", "is_serious", F.explode(F.concat(F.col("dc_ids"), F.array(F.lit(None).cast("long")))).alias("dc_id"))
        by = each.groupBy("dc_id", "report_date").agg(F.sum(F.when(F.col("is_serious") == 1, F.col("sign")).otherwise(0)).alias("serious"), F.sum(F.when(F.col("is_serious") != 1, F.col("sign")).otherwise(0)).alias("calm"))
        return by.where("serious <> 0 or calm <> 0")

    # --- what can be read ---

    def cases(self) -> DataFrame | None:
        """The latest version of every case that isn't deleted."""
        rows = self._cases(None)
        return None if rows is None else rows.where(~F.col("deleted") & F.col("row").isNotNull()).select("caseid", "row.*")

    def facts(self) -> DataFrame | None:
        """(dc_id, report_date, a, b) now: serious and other reports of each key and day; a null key has the totals."""
        done = self.committed()
        if not done:
            return None
        log = self.spark.read.parquet(*[f"{self.folder}/facts/{n}" for n in self._names("facts") if n.startswith("batch=") and int(n.split("=")[1]) in done])
        return log.groupBy("dc_id", "report_date").agg(F.sum("serious").alias("a"), F.sum("calm").alias("b")).where("a <> 0 or b <> 0")

    def history(self) -> DataFrame | None:
        """(dc_id, report_date, a, b, c, d, ror) from strictly earlier days, for every key and day with a report."""
        now = self.facts()
        if now is None:
            return None
        own = now.where("dc_id is not null")
        days = now.where("dc_id is null").select("report_date", F.col("a").alias("s"), F.col("b").alias("n"))
        cells = [F.col(x).cast("double") for x in "abcd"]
        empty = ((F.col("a") + F.col("b")) == 0) | ((F.col("a") + F.col("c")) == 0) | ((F.col("b") + F.col("d")) == 0)
        return prior_of(own, days, ["dc_id"]).withColumn("ror", F.when(empty, 1.0).otherwise(C.ror(*cells, "always")))

    def follow(self, stream: DataFrame, checkpoint: str) -> None:
        """Drains what a stream of events has into the state."""
        stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _order(row: str) -> Column:
    """Version, date, report: as the batch build orders versions, nulls last. The whole row decides between equal ones."""
    numeric = F.col(f"{row}.report").try_cast("decimal(38,0)")
    parts = [F.col(f"{row}.caseversion"), F.col(f"{row}.report_date"), numeric, F.col(f"{row}.report")]
    rest = [F.col(f"{row}.is_serious"), F.coalesce(f"{row}.split", F.lit("")), F.col(f"{row}.dc_ids")]
    return F.struct(*[c for p in parts for c in (p.isNotNull(), p)], *rest)
