"""Predictions of a stream of frames, written so that a batch that runs again leaves the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..schemas import PREDICTION_SCHEMA

_STORED = T.StructType([*PREDICTION_SCHEMA.fields, T.StructField("batch", T.LongType())])


def write_batch(predictions: DataFrame, batch_id: int, out: str) -> None:
    """Replace the predictions of one batch."""
    rows = predictions.select(*[F.col(f.name).cast(f.dataType) for f in PREDICTION_SCHEMA])
    rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")


def predict_stream(
    frames: DataFrame, predict: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, **trigger: object
) -> StreamingQuery:
    """Predict a stream of frames as it comes in; ``trigger`` as of ``writeStream.trigger``, by default what is there now.

    ``predict`` is the method of a fitted head: it works row by row, so batches need no state. A batch
    is a folder named by its number. If the query dies between the folder and its own checkpoint, the batch
    runs again under that number and replaces the folder.
    """
    writer = frames.writeStream.foreachBatch(lambda batch, batch_id: write_batch(predict(batch), batch_id, out))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_stream_predictions(spark: SparkSession, out: str) -> DataFrame:
    """(frame_idx, y_pred), one row per frame: of a frame that came in several batches the last counts.

    Within one batch the smallest class of a repeated frame is taken. Nothing written yet gives no rows.
    """
    try:
        rows = spark.read.schema(_STORED).parquet(out)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], PREDICTION_SCHEMA)
        raise
    last = F.max_by("y_pred", F.struct("batch", -F.col("y_pred")))
    return rows.groupBy("frame_idx").agg(last.alias("y_pred"))
