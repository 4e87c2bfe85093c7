"""Incremental stages: new files are taken once, state is checkpointed, results are upserted."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeweave.operators import cells as C
from lakeweave.sources.manifest import LEDGER, Folder


def arriving_tables(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(folder)


def normalize_new(spark: SparkSession, folder: str, schema, out: str, state: str) -> int:
    """Takes what arrived since the last call, writes its cells and stops; returns the rows written.

    Rerunning after a loss reads the checkpoint and takes no file twice: a batch writes under its own
    number and replaces what an interrupted attempt left."""
    written = []

    def batch(df: DataFrame, number: int) -> None:
        cells = C.cells(C.lake(df))
        target = f"{out.rstrip('/')}/batch={number}"
        cells.write.mode("overwrite").parquet(target)
        written.append(spark.read.parquet(target).count())

    q = arriving_tables(spark, folder, schema).writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(written)


def upsert(spark: SparkSession, store: str, rows: DataFrame, key: str, at: str) -> DataFrame:
    """Keeps the latest row per key: the store's rows and the new ones are merged into a new version,
    and a ledger entry is renamed into place last, so a reader sees the old or the new store, never a
    mixture, on any file system that renames."""
    place = Folder(spark, store)
    entries = [n for n in place.names(LEDGER) if n.isdigit()]
    old = spark.read.parquet(place.at(place.get(LEDGER, entries[-1]))) if entries else None
    every = rows if old is None else old.unionByName(rows)
    order = Window.partitionBy(key).orderBy(F.col(at).desc_nulls_last())
    merged = every.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")
    version = f"v-{uuid.uuid4().hex}"
    merged.write.parquet(place.at(version))
    place.put(version, LEDGER, f"{1 + (int(entries[-1]) if entries else 0):012d}")
    return spark.read.parquet(place.at(version))


def fetched_once(spark: SparkSession, tasks: DataFrame, key: str, store: str, fetch, result: str) -> DataFrame:
    """``tasks`` with the ``result`` of their key, every distinct key fetched once and kept in ``store``.

    ``fetch`` takes a list of keys and gives as many texts, None for a failure. Keys that the store
    already holds are not fetched again; failures are not stored, so a later run tries them anew. The
    results are written before they are joined back, so a lost task costs no second fetch of the rest.
    """
    place = Folder(spark, store)
    versions = [n for n in place.names("") if n.startswith("v-")]
    known = spark.read.parquet(*[place.at(v) for v in versions]) if versions else spark.createDataFrame([], f"__key string, __at timestamp, {result} string")
    wanted = tasks.select(F.col(key).cast("string").alias("__key")).filter("__key is not null").distinct().join(known, "__key", "left_anti")

    def run(batches):
        for pdf in batches:
            got = fetch(pdf["__key"].tolist()) if len(pdf) else []
            yield pdf.assign(**{result: got})

    version = place.at(f"v-{uuid.uuid4().hex}")
    fresh = wanted.mapInPandas(run, f"__key string, {result} string").filter(F.col(result).isNotNull())
    fresh.select("__key", F.current_timestamp().alias("__at"), result).write.parquet(version)
    every = spark.read.parquet(*[place.at(v) for v in versions], version).groupBy("__key").agg(F.max_by(result, "__at").alias(result))
    return tasks.join(every, tasks[key].cast("string") == every["__key"], "left").drop("__key")


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Events per type and window with a watermark; an extension for event streams."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("begin"), F.col("window.end").alias("end"), "event_type", "n", "total")


def first_deliveries(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """A stream without repeats of a key inside the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "user_id", "n")
