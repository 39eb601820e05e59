"""The stored vocabulary of node types and predicates: append-only rows, read as a set."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memweave.schema import NODE_TYPES, PREDICATES

SCHEMA = "kind string, name string"


def defaults(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("node_type", x) for x in NODE_TYPES] + [("predicate", x) for x in PREDICATES], SCHEMA)


class Vocabulary:
    """A table at a path. A kind without a stored name, or an absent table, has the defaults."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _stored(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def read(self) -> DataFrame:
        stored = self._stored().where("kind IS NOT NULL AND trim(name) <> ''").distinct()
        rest = defaults(self.spark).join(stored.select("kind").distinct(), "kind", "left_anti")
        return stored.unionByName(rest)

    def names(self, kind: str) -> DataFrame:
        return self.read().where(F.col("kind") == kind).select("name")

    def seed(self) -> None:
        """Write the defaults, unless there is something already."""
        if self._stored().isEmpty():
            defaults(self.spark).write.mode("append").parquet(self.path)

    def append(self, names: DataFrame, kind: str = "predicate") -> None:
        """Add the names that are new; those that were there as defaults are kept."""
        self.seed()
        new = names.select(F.lit(kind).alias("kind"), "name").distinct().join(self._stored(), ["kind", "name"], "left_anti")
        new.write.mode("append").parquet(self.path)
