"""An index whose parts lie in hashed buckets, under a manifest of versions that is swapped at once."""

from __future__ import annotations

import json
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents share this many buckets of each part, however many they are; what a change rewrites is the buckets of its documents.
BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has published the version that was about to be."""


@dataclass(frozen=True)
class Manifest:
    """A version: how many buckets there are, and the folder of each bucket of each part ("part/bucket")."""

    version: int
    buckets: int
    folders: dict[str, str]


class Index:
    """Parts of an index by name, each with a column doc_id. Whoever reads a version keeps it while others publish new ones; `vacuum` removes old ones.

    A version is one small file that names the buckets' folders. Writers write the changed buckets aside, then put the file in place under the next number; if
    that number is taken, they begin again from what is there.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.buckets = spark, folder, buckets
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str) -> object:
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def versions(self) -> list[int]:
        """The numbers of the versions that are there, in order."""
        if not self.fs.exists(self._path("versions")):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self._path("versions"))]
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        """A version, or else the newest; number 0, without buckets' folders, where there is none."""
        there = self.versions()
        if not there or version == 0:
            return Manifest(0, self.buckets, {})
        number = there[-1] if version is None else version
        stream = self.fs.open(self._path(f"versions/{number:012d}"))
        try:
            read = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Manifest(number, read["buckets"], read["folders"])

    def _publish(self, before: Manifest, folders: dict[str, str]) -> int:
        number = before.version + 1
        aside, place = self._path(f"versions/_{uuid4().hex}"), self._path(f"versions/{number:012d}")
        out = self.fs.create(aside, False)
        out.write(bytearray(json.dumps({"buckets": before.buckets, "folders": folders}).encode()))
        out.close()
        if self.fs.exists(place) or not self.fs.rename(aside, place):
            self.fs.delete(aside, False)
            raise Conflict(number)
        return number

    @staticmethod
    def bucket(buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(buckets)).cast("int")

    def _replace(self, frames: dict[str, DataFrame], gone: DataFrame, tries: int = 5) -> int:
        """Publishes a version in which the documents of `gone` have the frames' rows instead of what they had."""
        for _ in range(tries):
            now = self.manifest()
            number = self.bucket(now.buckets)
            touched = {r.b for r in gone.select(number.alias("b")).distinct().collect()}  # buckets at most
            folders, aside = dict(now.folders), f"data/{uuid4().hex}"
            for part in {*frames, *(k.rsplit("/", 1)[0] for k in now.folders)}:
                old = [now.folders[k] for b in touched if (k := f"{part}/{b}") in now.folders]
                rows = self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.folder}/{f}" for f in old]).join(gone, "doc_id", "left_anti") if old else None
                new = frames.get(part)
                both = rows if new is None else new if rows is None else rows.unionByName(new, allowMissingColumns=True)
                if both is None:
                    continue
                both.withColumn("_bucket", number).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{aside}/{part}")
                written = {int(f.getPath().getName().split("=")[1]) for f in self.fs.listStatus(self._path(f"{aside}/{part}")) if "=" in f.getPath().getName()}
                for b in touched:
                    folders.pop(f"{part}/{b}", None)
                folders |= {f"{part}/{b}": f"{aside}/{part}/_bucket={b}" for b in written}
            try:
                return self._publish(now, folders)
            except Conflict:
                continue
        raise Conflict(f"given up after {tries} tries")

    def save(self, frames: dict[str, DataFrame]) -> int:
        """Adds documents, or replaces them in all parts; the number of the version. A document counts as given if any part has it."""
        gone = None
        for df in frames.values():
            gone = df.select("doc_id") if gone is None else gone.unionByName(df.select("doc_id"))
        if gone is None:
            raise ValueError("no parts")
        return self._replace(frames, gone.distinct())

    def delete(self, documents: list | DataFrame) -> int | None:
        """Removes documents (ids, or a table with doc_id) from all parts; the number of the version, or None if no part has any of them."""
        if isinstance(documents, list):
            documents = self.spark.createDataFrame([(d,) for d in documents], f"doc_id {'long' if isinstance(documents[0], int) else 'string'}")
        gone = documents.select("doc_id").distinct()
        parts = {k.rsplit("/", 1)[0] for k in self.manifest().folders}
        if all(self.read(p).join(gone, "doc_id", "left_semi").isEmpty() for p in sorted(parts)):
            return None
        return self._replace({}, gone)

    def read(self, part: str, schema: str | None = None, doc_ids: list | None = None, version: int | None = None) -> DataFrame:
        """A part of a version; of some documents only their buckets are read. A part that was never written is empty, in the given schema."""
        at = self.manifest(version)
        wanted = {k for k in at.folders if k.rsplit("/", 1)[0] == part}
        if doc_ids is not None:
            ids = self.spark.createDataFrame([(str(d),) for d in doc_ids], "doc_id string")
            own = {f"{part}/{r.b}" for r in ids.select(self.bucket(at.buckets).alias("b")).distinct().collect()}
            wanted &= own
        if not wanted:
            return self.spark.createDataFrame([], schema or "doc_id long")
        reader = self.spark.read.schema(schema) if schema else self.spark.read.option("mergeSchema", "true")
        df = reader.parquet(*[f"{self.folder}/{at.folders[k]}" for k in sorted(wanted)])
        return df if doc_ids is None else df.filter(F.col("doc_id").isin(doc_ids))

    def vacuum(self, keep: int = 1) -> int:
        """Removes all versions but the last `keep`, and what none of these names; how many folders went. For times without writers."""
        there = self.versions()
        for number in there[:-keep]:
            self.fs.delete(self._path(f"versions/{number:012d}"), False)
        used = {f for number in there[-keep:] for f in self.manifest(number).folders.values()}
        gone = 0
        for top in self.fs.listStatus(self._path("data")):
            aside = top.getPath().getName()
            for part in self.fs.listStatus(top.getPath()):
                for b in self.fs.listStatus(part.getPath()):
                    name = f"data/{aside}/{part.getPath().getName()}/{b.getPath().getName()}"
                    if "=" in name and name not in used:
                        self.fs.delete(b.getPath(), True)
                        gone += 1
        return gone
