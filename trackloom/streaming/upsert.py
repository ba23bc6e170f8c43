"""A table of the latest row of each key, kept by a stream that rewrites only what it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class LatestTable:
    """The row of highest order of each key, in a folder of the shared store.

    Rows lie in hash buckets of their key: ``data/v=<batch>/bucket=<k>``; ``current/v=<batch>`` says which version of each bucket holds.  A batch
    reads the buckets of its own keys, merges, writes these as a new version and then the list of versions, so readers see all of a batch
    or nothing of it, and a batch that runs again writes the same.  Versions that neither the last list nor the one before it names are removed.
    """

    def __init__(self, path: str, key: list[str], order: list[str], buckets: int = 64):
        self.path, self.key, self.order, self.buckets = path, key, order, buckets

    def _folder(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at

    def _numbers(self, spark: SparkSession, path: str) -> list[int]:
        files, at = self._folder(spark, path)
        return sorted(int(s.getPath().getName().rsplit("=", 1)[1]) for s in files.listStatus(at) if "=" in s.getPath().getName()) if files.exists(at) else []

    def versions(self, spark: SparkSession, number: int | None = None) -> dict[int, int]:
        """The version of each bucket in the list of this number (default: the last); a number for each bucket at most."""
        there = [v for v in self._numbers(spark, f"{self.path}/current") if number is None or v <= number]
        return {r.bucket: r.version for r in spark.read.schema("bucket int, version long").parquet(f"{self.path}/current/v={there[-1]}").collect()} if there else {}

    def _read(self, spark: SparkSession, versions: dict[int, int], columns: DataFrame) -> DataFrame | None:
        paths = [f"{self.path}/data/v={v}/bucket={k}" for k, v in sorted(versions.items())]
        return spark.read.schema(columns.schema).parquet(*paths) if paths else None

    def read(self, spark: SparkSession, like: DataFrame) -> DataFrame:
        """All rows; like: a DataFrame of their columns."""
        found = self._read(spark, self.versions(spark), like)
        return found if found is not None else spark.createDataFrame([], like.schema)

    def merge(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        best = lambda rows: rows.groupBy(*self.key).agg(F.max_by(F.struct(*batch.columns), F.struct(*self.order)).alias("d")).select("d.*")
        new = best(batch).persist()
        touched = [r.b for r in new.select(bucket.alias("b")).distinct().collect()]  # a number for each bucket at most
        before = self.versions(spark, number - 1)
        old = self._read(spark, {k: before[k] for k in touched if k in before}, new)
        merged = best(new.unionByName(old)) if old is not None else new
        merged.withColumn("bucket", bucket).repartition(len(touched) or 1, "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/data/v={number}")
        now = before | {k: number for k in touched}
        spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/current/v={number}")
        new.unpersist()
        self._remove(spark, number, {*before.items(), *now.items()})

    def _remove(self, spark: SparkSession, number: int, named: set[tuple[int, int]]) -> None:
        for v in self._numbers(spark, f"{self.path}/data"):
            keep = {k for k, at in named if at == v}
            for k in {*self._numbers(spark, f"{self.path}/data/v={v}")} - keep if v != number else ():
                files, at = self._folder(spark, f"{self.path}/data/v={v}/bucket={k}")
                files.delete(at, True)
            if not keep and v < number:
                files, at = self._folder(spark, f"{self.path}/data/v={v}")
                files.delete(at, True)
        for v in [v for v in self._numbers(spark, f"{self.path}/current") if v < number][:-1]:
            files, at = self._folder(spark, f"{self.path}/current/v={v}")
            files.delete(at, True)

    def follow(self, stream: DataFrame, checkpoint: str):
        """The streaming query that keeps the table."""
        return stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint)
