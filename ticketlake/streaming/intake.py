"""Idempotent intake as a stream: the batch replay, carried on from batch to batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ticketlake.operators.intake import BLOCK, FREE, STATES, replay_intake, states_after
from ticketlake.session import materialize
from ticketlake.streaming.state import KeyedState


def intake_state(spark: SparkSession, path: str) -> KeyedState:
    """States of keys; a free key has none."""
    return KeyedState(spark, path, "clave", STATES, f"in_state = '{FREE}'")


def idempotent_intake(
    events: DataFrame, answers_path: str, state_path: str, checkpoint: str,
    block: int = BLOCK, trigger: dict | None = None,
) -> StreamingQuery:
    """Writes the outcome of every reserve event of a stream, one folder per micro-batch.

    Each batch is replayed in blocks like a batch log, from the states that the batches before left
    for its keys, so a key with any share of the events is spread over many tasks and never held in
    one. A batch looks up and writes the keys that it holds, whatever the number of keys so far. The
    result equals the batch replay of the whole log as long as sequence numbers rise from batch to
    batch; a batch that runs again replaces its output.
    """
    def answer(batch: DataFrame, batch_id: int) -> None:
        state = intake_state(batch.sparkSession, state_path)
        arrived = materialize(batch)
        keys = materialize(arrived.select("clave").filter(F.col("clave").isNotNull()).distinct())
        before = materialize(state.before(batch_id, keys))
        replay_intake(arrived, block, before).write.mode("overwrite").parquet(
            f"{answers_path}/lote={batch_id}"
        )
        after = keys.join(states_after(arrived, block, before), "clave", "left")
        state.write(batch_id, after.withColumn("in_state", F.coalesce("in_state", F.lit(FREE))))

    return (
        events.writeStream.foreachBatch(answer)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
