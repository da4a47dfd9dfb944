"""Association files annotated as they arrive: a stateless stream-static join.

Interval tables are static, points stream in; the join keeps no state, so append mode needs no
watermark, and ``availableNow`` turns a folder into one incremental batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.joins import range_join


def stream_points(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of points as a stream, a bounded number of files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def annotate_stream(points: DataFrame, intervals: DataFrame, out: str, checkpoint: str, pos: str = "pos", on: tuple[str, ...] = ("chrom",)) -> StreamingQuery:
    """Writes every point with the intervals that hold it; runs until all present files are read. Each file is joined once, also after a restart."""
    joined = range_join(points, intervals, list(on), pos, "start", "end")
    return joined.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
