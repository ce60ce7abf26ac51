"""Idempotent intake replayed over a log of reserve, complete and release events.

A key is free, reserved (content hash known, work unfinished) or done (with a resulting code).
Reserve on a free key is new; on another content hash a conflict; on an unfinished key in
progress; on a finished key a repeat that returns the code. Complete finishes a reserved key.
Release frees a key only while it is unfinished.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

RESERVE, COMPLETE, RELEASE = "reservar", "completar", "liberar"
NEW, REPEATED, IN_PROGRESS, CONFLICT = "nueva", "repetida", "en_curso", "conflicto"
FREE, RESERVED, DONE = "libre", "reservada", "terminada"
#: Stands in for a key without events: it changes nothing.
NOTHING = "sin_accion"
#: States of keys before or after a log; a free key has no row.
STATES = "clave string, in_state string, in_hash string, in_code string"
#: Width of the sequence blocks a key's events are replayed in.
BLOCK = 100_000
#: Blocks whose effects are folded into one block of the next level.
FANOUT = 256


def _replay(events: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the state before each event: ``_state``, ``_hash`` and ``_code``.

    Starts from the state in ``in_state``, ``in_hash``, ``in_code``. All windows share one sort.
    """
    earlier = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    action = F.col("accion")
    reserved_from = F.when(F.col("in_state") == RESERVED, RESERVE).otherwise(RELEASE)
    lock = F.coalesce(
        F.last(F.when(action.isin(RESERVE, RELEASE), action), ignorenulls=True).over(earlier),
        reserved_from,
    )
    locked = events.withColumn("_locked", lock == RESERVE)
    finishes = (action == COMPLETE) & F.col("_locked")
    done = F.coalesce(F.max(finishes).over(earlier), F.lit(False)) | (F.col("in_state") == DONE)
    stated = locked.withColumn("_done", done).withColumn(
        "_state",
        F.when(F.col("_done"), DONE).when(F.col("_locked"), RESERVED).otherwise(FREE),
    )
    opens = (action == RESERVE) & (F.col("_state") == FREE)
    completes = (action == COMPLETE) & (F.col("_state") != FREE)
    return stated.withColumns(
        {
            "_hash": F.coalesce(
                F.last(F.when(opens, F.col("huella")), ignorenulls=True).over(earlier),
                F.col("in_hash"),
            ),
            "_code": F.coalesce(
                F.last(F.when(completes, F.col("codigo")), ignorenulls=True).over(earlier),
                F.col("in_code"),
            ),
        }
    ).drop("_locked", "_done")


def _state_after() -> Column:
    """``struct<state, hash, code>`` once the event has been applied."""
    action, state = F.col("accion"), F.col("_state")
    opens = (action == RESERVE) & (state == FREE)
    closes = (action == COMPLETE) & (state != FREE)
    frees = (action == RELEASE) & (state == RESERVED)
    return F.struct(
        F.when(opens, RESERVED).when(closes, DONE).when(frees, FREE).otherwise(state).alias("state"),
        F.when(opens, F.col("huella")).otherwise(F.col("_hash")).alias("hash"),
        F.when(closes, F.col("codigo")).otherwise(F.col("_code")).alias("code"),
    )


def _from_free(events: DataFrame) -> DataFrame:
    return events.withColumns(
        {
            "in_state": F.lit(FREE),
            "in_hash": F.lit(None).cast("string"),
            "in_code": F.lit(None).cast("string"),
        }
    )


def _block_effects(events: DataFrame) -> DataFrame:
    """At most four events per (key, block) with the same effect as the whole block.

    Whatever the state at the start of a block, replaying these leaves the key in the same state.
    """
    replayed = _replay(_from_free(events), ["clave", "_block"])
    is_lock = F.col("accion").isin(COMPLETE, RELEASE)
    ends = replayed.groupBy("clave", "_block").agg(
        F.max_by(_state_after(), F.col("seq")).alias("end"),
        F.min_by("accion", F.when(is_lock, F.col("seq"))).alias("first"),
        F.max_by("codigo", F.when(F.col("accion") == COMPLETE, F.col("seq"))).alias("code"),
        F.count_if(F.col("accion") == COMPLETE).alias("completes"),
    )

    def event(action: str, when: Column, hash_: Column | None = None) -> Column:
        null = F.lit(None).cast("string")
        return F.when(
            when,
            F.struct(
                F.lit(action).alias("accion"),
                (null if hash_ is None else hash_).alias("huella"),
                (F.col("code") if action == COMPLETE else null).alias("codigo"),
            ),
        )

    end = F.col("end")
    has_code = F.col("completes") > 0
    steps = F.array_compact(
        F.array(
            event(RELEASE, F.col("first") == RELEASE),
            event(COMPLETE, has_code),
            event(RESERVE, end["state"] != FREE, end["hash"]),
            event(COMPLETE, end["state"] == DONE),
        )
    )
    return ends.select(
        "clave", "_block", F.posexplode(steps).alias("_step", "_event")
    ).select("clave", "_block", "_step", "_event.*")


def _folded(effects: DataFrame) -> DataFrame:
    """The effects of groups of ``FANOUT`` blocks, as effects of the blocks of the next level."""
    ordered = effects.withColumn("seq", F.struct("_block", "_step")).withColumn(
        "_block", F.floor(F.col("_block") / F.lit(FANOUT)).cast("bigint")
    )
    return _block_effects(ordered)


def _block_starts(effects: DataFrame, blocks: int, initial: DataFrame | None) -> DataFrame:
    """``(clave, _block, in_state, in_hash, in_code)``: the state each block starts from.

    Up the tree, groups of blocks are folded until a key has one group; down again, a group's start
    is handed on through its blocks. No task sees more than ``FANOUT`` blocks of a key.
    """
    parent = F.floor(F.col("_block") / F.lit(FANOUT)).cast("bigint")
    events = effects.withColumn("_parent", parent).withColumn("seq", F.struct("_block", "_step"))
    if blocks > FANOUT:
        above = _block_starts(_folded(effects), -(-blocks // FANOUT), initial)
        started = events.join(
            above.withColumnRenamed("_block", "_parent"), ["clave", "_parent"], "left"
        )
    elif initial is not None:
        started = events.join(initial, "clave", "left")
    else:
        started = _from_free(events)
    started = started.withColumn("in_state", F.coalesce("in_state", F.lit(FREE)))
    return (
        _replay(started, ["clave", "_parent"])
        .filter(F.col("_step") == 0)
        .select(
            "clave", "_block", F.col("_state").alias("in_state"),
            F.col("_hash").alias("in_hash"), F.col("_code").alias("in_code"),
        )
    )


def _keyed(events: DataFrame, block: int) -> tuple[DataFrame, int]:
    """Events with a key and their block, counted from the first; and the number of blocks."""
    ends = events.agg(F.min("seq"), F.max("seq")).head()
    first, last = (0 if end is None else end // block for end in ends)
    number = F.floor(F.col("seq") / F.lit(block)).cast("bigint") - F.lit(first)
    empty = (F.col("accion") == COMPLETE) & F.col("codigo").isNull()
    keyed = events.filter(F.col("clave").isNotNull() & ~empty).select(
        "seq", "accion", "clave", "huella", "codigo", number.alias("_block")
    )
    return keyed, last - first + 1


def replay_intake(
    events: DataFrame, block: int = BLOCK, initial: DataFrame | None = None
) -> DataFrame:
    """Outcome of every reserve event: ``seq, clave, huella, estado, codigo``.

    Events without a key are never deduplicated and skip the replay. Events of one key are
    replayed in blocks of the sequence, so a key that holds a third of the log is spread over many
    tasks: each block is reduced to a few equivalent events, those are folded as a tree to get the
    state each block starts from, and the blocks are replayed again from there. ``initial`` holds
    the states of keys before the first event (:func:`states_after`); without it all keys are free.
    """
    reserves = F.col("accion") == RESERVE
    keyless = events.filter(F.col("clave").isNull() & reserves).select(
        "seq", "clave", "huella", F.lit(NEW).alias("estado"),
        F.lit(None).cast("string").alias("codigo"),
    )
    keyed, blocks = _keyed(events, block)
    starts = _block_starts(_block_effects(keyed), blocks, initial)
    with_start = keyed.join(starts, ["clave", "_block"], "left").withColumn(
        "in_state", F.coalesce("in_state", F.lit(FREE))
    )
    state = F.col("_state")
    outcome = (
        F.when(state == FREE, NEW)
        .when(F.col("_hash") != F.col("huella"), CONFLICT)
        .when(state == DONE, REPEATED)
        .otherwise(IN_PROGRESS)
    )
    answered = (
        _replay(with_start, ["clave", "_block"])
        .filter(reserves)
        .withColumn("estado", outcome)
        .select(
            "seq", "clave", "huella", "estado",
            F.when(F.col("estado") == REPEATED, F.col("_code")).alias("codigo"),
        )
    )
    return answered.unionByName(keyless)


def states_after(
    events: DataFrame, block: int = BLOCK, initial: DataFrame | None = None
) -> DataFrame:
    """``(clave, in_state, in_hash, in_code)`` of the keys that aren't free after the events."""
    keyed, blocks = _keyed(events, block)
    effects = _block_effects(keyed)
    while blocks > 1:
        effects, blocks = _folded(effects), -(-blocks // FANOUT)
    last = effects.withColumn("seq", F.struct("_block", "_step")).join(
        initial if initial is not None else _no_states(events), "clave", "full"
    )
    last = last.withColumn("in_state", F.coalesce("in_state", F.lit(FREE))).withColumn(
        "accion", F.coalesce("accion", F.lit(NOTHING))
    )
    nothing = F.struct(F.lit(0).cast("bigint").alias("_block"), F.lit(0).alias("_step"))
    ended = _replay(last, ["clave"]).groupBy("clave").agg(
        F.max_by(_state_after(), F.coalesce("seq", nothing)).alias("end")
    )
    return ended.select(
        "clave",
        F.col("end.state").alias("in_state"),
        F.col("end.hash").alias("in_hash"),
        F.col("end.code").alias("in_code"),
    ).filter(F.col("in_state") != FREE)


def _no_states(events: DataFrame) -> DataFrame:
    return events.sparkSession.createDataFrame([], STATES)
