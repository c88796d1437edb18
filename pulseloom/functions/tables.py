"""Table functions for SQL: ``SELECT * FROM segment(n, fs, seconds, overlap, min_size)``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="wave_section int, start_point long, end_point long")
class Segment:
    """Sections of a recording of n samples, by the rule of operators.framing.segment."""

    def eval(self, n: int, fs: float, seconds: float, overlap: float, min_size: float):
        fs, seconds, overlap, min_size = float(fs), float(seconds), float(overlap), float(min_size)
        size, step = seconds * fs, (1 - overlap) * seconds * fs
        k = 0
        while k * step + size < n:
            last = min_size == -1 and (k + 1) * step + size >= n
            yield k, int(k * step), n if last else int(k * step + size)
            k += 1
        if min_size != -1 and n - k * step >= min_size * fs:
            yield k, int(k * step), n


def register(spark: SparkSession) -> None:
    spark.udtf.register("segment", Segment)
