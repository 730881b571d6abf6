"""Tables written to the shared scratch folder, to cut lineage, and their removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowmill.session import scratch_dir

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one run; ``drop`` removes those that no later read needs."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.base, self.made = spark, scratch_dir(spark, purpose), 0

    def store(self, df: DataFrame) -> DataFrame:
        """Write a table and read it back; lost executors do not lose it.

        The shuffle files of the write are removed with its end, not when the driver next collects garbage.
        """
        self.made += 1
        path = f"{self.base}/{self.made}"
        before = self.spark.conf.get(FREE_SHUFFLES, None)
        self.spark.conf.set(FREE_SHUFFLES, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(FREE_SHUFFLES)
            else:
                self.spark.conf.set(FREE_SHUFFLES, before)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.scratch_path = path
        return kept

    def drop(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
