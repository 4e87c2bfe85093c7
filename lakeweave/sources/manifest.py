"""Versioned datasets in a shared folder: every write is a new version, a ledger says which counts.

A dataset is a folder of any file system that Spark can reach. A write puts its rows into a version of
its own, then the executors count and fingerprint what they read back, and the last step renames one
ledger entry into place. A reader follows the newest entry, so it sees a whole version or none, and a
lost driver or executor leaves at most a version that no entry names. Nothing is read on the driver but
one ledger line and one row of totals.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "ledger"


def settings_key(**settings) -> str:
    """A short key of the settings that made a dataset."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()[:24]


class Folder:
    """A folder on Spark's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, *parts: str) -> str:
        return "/".join((self.path, *parts))

    def names(self, part: str) -> list[str]:
        place = self._path(self.at(part))
        return sorted(f.getPath().getName() for f in self._fs.listStatus(place)) if self._fs.exists(place) else []

    def put(self, text: str, *parts: str) -> None:
        """Write a small file under another name, then rename it: it appears whole, and only once."""
        draft, final = self._path(self.at(*parts[:-1], f".{uuid.uuid4().hex}")), self._path(self.at(*parts))
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise FileExistsError(f"{final} was written by another run")

    def get(self, *parts: str) -> str:
        stream = self._fs.open(self._path(self.at(*parts)))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def drop(self, *parts: str) -> None:
        self._fs.delete(self._path(self.at(*parts)), True)


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, sum): of every file of JSON lines its rows and the sum of their hashes, which does not
    depend on the order in which tasks read them. Files are streamed, never held whole."""
    lines = spark.read.text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.xxhash64("value").cast("decimal(38,0)").alias("h"))
    return lines.groupBy("file").agg(F.count("*").alias("rows"), F.sum("h").alias("sum"))


def newest(spark: SparkSession, folder: str) -> dict | None:
    """The newest ledger entry of a dataset, None where nothing was committed."""
    place = Folder(spark, folder)
    entries = [n for n in place.names(LEDGER) if not n.startswith(".")]
    return json.loads(place.get(LEDGER, entries[-1])) if entries else None


def commit(df: DataFrame, folder: str, settings: str = "", rows_per_file: int = 1_000_000, compression: str = "gzip") -> dict:
    """Write the rows as JSON lines into a new version and enter it into the ledger; returns the entry."""
    spark, place = df.sparkSession, Folder(df.sparkSession, folder)
    version = f"v-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_per_file).option("compression", compression).json(place.at(version, "rows"))
    fingerprints(spark, place.at(version, "rows")).coalesce(1).write.parquet(place.at(version, "files"))
    total = spark.read.parquet(place.at(version, "files")).agg(F.count("*").alias("files"), F.sum("rows").alias("rows")).first()
    entry = {"version": version, "settings": settings, "files": total["files"], "rows": total["rows"] or 0}
    number = 1 + max((int(n) for n in place.names(LEDGER) if n.isdigit()), default=0)
    place.put(json.dumps(entry), LEDGER, f"{number:012d}")
    return entry


def damaged(spark: SparkSession, folder: str, entry: dict | None = None) -> DataFrame:
    """(file, rows, found): files of the version whose rows are missing, more or other than committed."""
    entry = entry or newest(spark, folder)
    place = Folder(spark, folder)
    known = spark.read.parquet(place.at(entry["version"], "files"))
    now = fingerprints(spark, place.at(entry["version"], "rows")).select("file", F.col("rows").alias("found"), F.col("sum").alias("is"))
    other = F.col("found").isNull() | F.col("rows").isNull() | (F.col("found") != F.col("rows")) | (F.col("is") != F.col("sum"))
    return known.join(now, "file", "full_outer").filter(other).select("file", "rows", "found")


def read(spark: SparkSession, folder: str, schema: str, check: bool = True) -> DataFrame:
    """The rows of the newest version. Nothing committed, and with ``check`` damaged files, raise."""
    entry = newest(spark, folder)
    if entry is None:
        raise FileNotFoundError(f"{folder} holds no committed version")
    if check and not damaged(spark, folder, entry).isEmpty():
        raise ValueError(f"{folder} has damaged files")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(Folder(spark, folder).at(entry["version"], "rows"))


def run_stages(spark: SparkSession, stages: list[tuple[str, object]], folder: str, settings: str = "") -> list[str]:
    """Runs (name, function giving a DataFrame) in order and returns the names that ran. A stage whose
    newest version has these settings and is whole is left as it is; other settings raise."""
    ran = []
    for name, make in stages:
        own = f"{folder.rstrip('/')}/{name}"
        entry = newest(spark, own)
        if entry is not None and entry["settings"] != settings:
            raise ValueError(f"stage {name} was made with other settings; use another folder")
        if entry is None or not damaged(spark, own, entry).isEmpty():
            commit(make(), own, settings)
            ran.append(name)
    return ran


def input_fingerprint(spark: SparkSession, folder: str) -> str:
    """A key of the files below a folder: their paths, sizes and times, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)").alias("h"))
    total = files.agg(F.count("*").alias("n"), F.sum("h").alias("s")).first()
    return settings_key(files=total["n"], sum=str(total["s"]))


def drop_old_versions(spark: SparkSession, folder: str) -> int:
    """Deletes versions that the newest entry does not name, those of broken runs too; returns how many."""
    place, entry = Folder(spark, folder), newest(spark, folder)
    old = [n for n in place.names("") if n.startswith("v-") and entry and n != entry["version"]]
    for n in old:
        place.drop(n)
    return len(old)
