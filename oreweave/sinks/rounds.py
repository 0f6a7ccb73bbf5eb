"""Jobs in rounds whose steps are tables below one folder, so a stopped job goes on after its last whole step."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Rounds:
    """Tables `<root>/<kind>/round=<n>`; a step is done when Spark has committed its table."""

    spark: SparkSession
    root: str

    LAST = "state"  # the kind a round writes last

    def _path(self, kind: str, number: int) -> str:
        return f"{self.root.rstrip('/')}/{kind}/round={number}"

    def _done(self, kind: str, number: int) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(kind, number) + "/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def _write(self, kind: str, number: int, rows: DataFrame, schema: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(self._path(kind, number))
        return self.spark.read.schema(schema).parquet(self._path(kind, number))

    def _read(self, kind: str, number: int, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self._path(kind, number))

    def _read_all(self, kind: str, numbers: range, schema: str) -> DataFrame:
        paths = [self._path(kind, n) for n in numbers]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rounds(self) -> int:
        """Rounds that are whole."""
        number = 0
        while self._done(self.LAST, number + 1):
            number += 1
        return number
