"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.constants import EVENT


class Stages:
    """Tables of one run. Writing cuts the lineage and survives lost executors."""

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="pulsegrid-stages-")
            spark.sparkContext.setCheckpointDir(base)
        self.spark, self.root = spark, f"{base.rstrip('/')}/stages-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, buckets: int | None = None) -> DataFrame:
        """The same as `write`, but bucketed and sorted by event, with as many buckets as a shuffle has partitions unless
        told otherwise. Stages that join, group or cut such tables by event need no exchange.

        A table without the columns of an event is written plainly. The table is external, so its files are in the run's
        folder; its name in the session's catalog is the run's own.
        """
        if not set(EVENT) <= set(df.columns):
            return self.write(df, name)
        n = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"{self.root.rsplit('/', 1)[1]}_{name}".replace("-", "_")
        placed = df.repartition(n, *EVENT)
        placed.write.mode("overwrite").option("path", f"{self.root}/{name}").bucketBy(n, *EVENT).sortBy(*EVENT).saveAsTable(table)
        return self.spark.table(table)
