"""Hashes and neighbours kept between searches, as Parquet.

``hashes (algorithm, id, hash)`` and ``edges (algorithm, src, dst, score)`` are
only added to; readers drop repeated rows and filter scores by the degree asked.
Edges join classes of equal hashes, by the smallest id of each search.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators.perceptual import BITS

SCHEMAS = {"hashes": "id long, hash long, algorithm string", "edges": "src long, dst long, score int, algorithm string"}


class HashCache:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, table: str, algorithm: str) -> DataFrame:
        try:
            found = self.spark.read.schema(_schema(table, algorithm)).parquet(f"{self.path}/{table}")
        except AnalysisException:
            found = self.spark.createDataFrame([], _schema(table, algorithm))
        return found.where(F.col("algorithm") == algorithm).drop("algorithm")

    def exists(self) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/hashes")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def hashes(self, algorithm: str) -> DataFrame:
        return self._read("hashes", algorithm).dropDuplicates(["id"])

    def edges(self, algorithm: str, least_score: int = -(1 << 30)) -> DataFrame:
        return self._read("edges", algorithm).where(F.col("score") >= least_score).dropDuplicates(["src", "dst"])

    def add_hashes(self, algorithm: str, rows: DataFrame) -> None:
        rows.select("id", "hash", F.lit(algorithm).alias("algorithm")).write.mode("append").partitionBy("algorithm").parquet(f"{self.path}/hashes")

    def add_edges(self, algorithm: str, rows: DataFrame) -> None:
        rows.select("src", "dst", "score", F.lit(algorithm).alias("algorithm")).write.mode("append").partitionBy("algorithm").parquet(f"{self.path}/edges")


def _schema(table: str, algorithm: str) -> str:
    """The table's columns; hashes of more than 64 bits are arrays."""
    return SCHEMAS[table].replace("hash long", "hash array<long>") if BITS.get(algorithm, 64) > 64 else SCHEMAS[table]


def probe(rows: DataFrame, cached: DataFrame) -> DataFrame:
    """``rows (id, …)`` with their cached hash and whether there was one."""
    return rows.join(cached.select("id", F.col("hash").alias("cached_hash")), "id", "left").withColumn("hit", F.col("cached_hash").isNotNull())
