"""Run the drift operator (A32-A34) on every micro-batch of a stream.

No new operator: the training snapshot is reduced to its value counts once,
written beside the sink, and ``foreachBatch`` tests each micro-batch against
them and appends the per-column verdicts, tagged with the batch id, to a table sink. Offsets and the sink
commit live in the query's checkpoint folder, so a restarted query resumes
without duplicating batches (each batch owns its output folder).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tablelens.functions.columns import categorical_columns, numeric_columns
from tablelens.operators.drift import report_from_counts, value_counts


def drift_monitor(stream: DataFrame, training: DataFrame, sink_path: str, checkpoint: str,
                  threshold: float = 0.1, trigger_once: bool = False):
    """Start the monitoring query; returns the ``StreamingQuery``."""
    cols = [c for c in training.columns if c in stream.columns]
    training = training.select(cols)
    num, cat = numeric_columns(training), categorical_columns(training)
    spark = training.sparkSession

    def counted(names, numeric):
        if not names:
            return None
        path = f"{sink_path.rstrip('/')}/_training/{'numbers' if numeric else 'words'}"
        value_counts(training, names, numeric).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    numbers, words = counted(num, True), counted(cat, False)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        rep = report_from_counts(numbers, words, batch.select(cols), num, cat, len(cols), threshold)
        # one folder per batch, overwritten on a retry of that batch
        rep.write.mode("overwrite").parquet(f"{sink_path.rstrip('/')}/batch_id={batch_id}")

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
