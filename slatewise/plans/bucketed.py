"""A keyed table kept in buckets, of which a merge rewrites only those it touches."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from slatewise.shared import drop_path, replace_file

BUCKET = "_bucket"


class BucketedTable:
    """Rows with unique ``keys`` under ``path``, in ``buckets`` folders by key hash.

    A bucket is the work of one task, so by default there are as many as the
    session has shuffle partitions when the table is made; the manifest keeps their number.

    A manifest names the folder of each bucket and holds the sums in
    ``totals``. It is replaced last, by a rename, so that a merge that dies
    leaves the former state whole. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int | None = None):
        self.spark, self.path, self.schema, self.keys = spark, path, schema, keys
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.version, self.folders, self.totals = 0, {}, {}
        if self._fs.exists(self._path(f"{path}/manifest.json")):
            lines = spark.read.text(f"{path}/manifest.json", wholetext=True).first()[0]
            state = json.loads(lines)
            self.version, self.folders, self.totals, self.buckets = state["version"], state["folders"], state["totals"], state["buckets"]

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, only: set[str] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        paths = [f for b, f in sorted(self.folders.items()) if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def merge(self, batch: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], **added: float) -> None:
        """Replace each touched bucket by ``combine(its rows, the batch's rows)``.

        ``batch`` has this table's schema and unique keys. ``added`` is added to the totals.
        """
        target = f"{self.path}/v{self.version + 1}"
        drop_path(self.spark, target)  # what a merge that died may have left
        if not self.folders:
            self._write(batch, target)
            self.folders = self._listed(target)
        else:
            staged = f"{self.path}/batch{self.version + 1}"
            drop_path(self.spark, staged)
            self._write(batch, staged)
            touched = self._listed(staged)
            if touched:
                new = self.spark.read.schema(self.schema).parquet(*touched.values())
                self._write(combine(self.read(set(touched)), new), target)
                self.folders = {b: f for b, f in self.folders.items() if b not in touched} | self._listed(target)
            drop_path(self.spark, staged)
        self.version += 1
        self.totals = {k: self.totals.get(k, 0) + added.get(k, 0) for k in {*self.totals, *added}}
        self._save()

    def _write(self, df: DataFrame, target: str) -> None:
        df.select(*self.schema.names).withColumn(BUCKET, self.bucket()).repartition(BUCKET).write.option("compression", "zstd").partitionBy(BUCKET).parquet(target)

    def _listed(self, target: str) -> dict[str, str]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(target))]
        return {n.split("=")[1]: f"{target}/{n}" for n in names if n.startswith(f"{BUCKET}=")}

    def _save(self) -> None:
        state = {"version": self.version, "folders": self.folders, "totals": self.totals, "buckets": self.buckets}
        part = self._path(f"{self.path}/manifest.part")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        replace_file(self.spark, f"{self.path}/manifest.part", f"{self.path}/manifest.json")
