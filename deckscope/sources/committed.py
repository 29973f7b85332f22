"""Tables whose batches appear whole or not at all.

A batch is written into a folder of its own, and one small manifest per batch
id, put in place by a rename after all files are there, makes it visible.
Readers follow the manifests only: a writer that dies between files leaves a
folder that nobody reads, a retried batch id that is already committed
writes nothing, and one that is not writes a new folder.  One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Manifests:
    """The manifests of one table, as JSON files ``_commits/<batch>.json`` (Hadoop file system API: any store Spark can write)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self.folder = self._fs_path(f"{self.path}/_commits")
        self.fs = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, batch_id) -> str:
        return f"{self.path}/_commits/{quote(str(batch_id), safe='')}.json"

    def has(self, batch_id) -> bool:
        return self.fs.exists(self._fs_path(self._file(batch_id)))

    def all(self) -> list[dict]:
        """Manifests in order of commit (one small row a batch comes to the driver)."""
        if not self.fs.exists(self.folder):
            return []
        rows = self.spark.read.text(f"{self.path}/_commits/*.json", wholetext=True).collect() if self.fs.listStatus(self.folder) else []
        return sorted((json.loads(r[0]) for r in rows), key=lambda m: m["seq"])

    def commit(self, batch_id, content: dict) -> None:
        new = self._fs_path(f"{self.path}/_tmp/{uuid.uuid4().hex}")
        out = self.fs.create(new, True)
        out.write(bytearray(json.dumps({"batch": str(batch_id), "seq": len(self.all()), **content}).encode()))
        out.close()
        self.fs.mkdirs(self.folder)
        if not self.fs.rename(new, self._fs_path(self._file(batch_id))):
            raise OSError(f"cannot commit batch {batch_id}")


class CommittedTable:
    """An append-only table of committed batches; ``partition_by`` columns become folders that readers prune."""

    def __init__(self, spark: SparkSession, path: str, partition_by=(), fmt: str = "parquet"):
        self.spark, self.path, self.partition_by, self.fmt = spark, path.rstrip("/"), list(partition_by), fmt
        self.manifests = Manifests(spark, path)

    def append(self, df: DataFrame, batch_id, **note) -> bool:
        """Write and commit a batch; False if that batch id is committed already.  ``note`` goes into the manifest."""
        if self.manifests.has(batch_id):
            return False
        folder = f"data/version={uuid.uuid4().hex}"
        w = df.write.option("header", True) if self.fmt == "csv" else df.write
        (w.partitionBy(*self.partition_by) if self.partition_by else w).format(self.fmt).save(f"{self.path}/{folder}")
        self.manifests.commit(batch_id, {"folder": folder, "schema": df.schema.json(), **note})
        return True

    def read(self, where=None, without=None) -> DataFrame | None:
        """All committed rows, or those of batches for whose manifest ``where`` holds, without batch id ``without``; None if there are none."""
        from pyspark.sql.types import StructType

        found = [m for m in self.manifests.all() if (where is None or where(m)) and (without is None or m["batch"] != str(without))]
        if not found:
            return None
        r = self.spark.read.format(self.fmt).option("basePath", f"{self.path}/data").schema(
            StructType.fromJson(json.loads(found[-1]["schema"])))
        r = r.option("header", True) if self.fmt == "csv" else r
        return r.load([f"{self.path}/{m['folder']}" for m in found])


def bucket_of(key, buckets: int):
    return F.pmod(F.xxhash64(F.col(key) if isinstance(key, str) else key), F.lit(buckets)).cast("int")


class ResultFiles:
    """A5: results per document in hash buckets of the name, not a folder per document."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, key: str = "deck_name", fmt: str = "csv"):
        self.key, self.buckets = key, buckets
        self.table = CommittedTable(spark, path, ["bucket"], fmt)

    def append(self, df: DataFrame, batch_id) -> bool:
        out = df.withColumn("bucket", bucket_of(self.key, self.buckets))
        return self.table.append(out.repartition("bucket").sortWithinPartitions("bucket", self.key), batch_id)

    def document(self, name: str) -> DataFrame | None:
        """One document's rows: only its bucket's files are read."""
        rows = self.table.read()
        if rows is None:
            return None
        of = self.table.spark.range(1).select(bucket_of(F.lit(name), self.buckets)).first()[0]
        return rows.filter((F.col("bucket") == of) & (F.col(self.key) == name)).drop("bucket")
