"""State by change: what a batch reads and writes, and what is left when it runs again."""

import pathlib
import random

import pytest

from ticketlake.operators.clean import clean_history
from ticketlake.schemas import INTAKE_EVENT
from ticketlake.streaming.flows import clean_changes, clean_so_far, stream_clean
from ticketlake.streaming.intake import idempotent_intake
from ticketlake.streaming.state import KeyedState, runs_before
from test_clean import STRESS, raw
from test_flows import intake_fold, intake_log

SCHEMA = "k string, v long"


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_runs_follow_from_the_batch(fan):
    for batch in range(200):
        covered = []
        for level, number in runs_before(batch, fan):
            covered += range(number * fan**level, (number + 1) * fan**level)
        assert covered == list(range(batch))
        assert len(runs_before(batch, fan)) <= (fan - 1) * 8 + 1


def rows_written(path):
    """Rows of all runs that are there, by run."""
    import pyarrow.parquet as pq

    found = {}
    for file in pathlib.Path(path).rglob("*.parquet"):
        run = tuple(p for p in file.parts if p.startswith(("nivel=", "tramo=")))
        found[run] = found.get(run, 0) + pq.ParquetFile(file).metadata.num_rows
    return found


def test_against_a_dictionary(spark, tmp_path):
    state = KeyedState(spark, str(tmp_path), "k", SCHEMA, "v < 0", fan=3, buckets=4)
    draw, model = random.Random(1), {}
    for batch in range(10):
        keys = draw.sample([f"k{i}" for i in range(12)], 4)
        wanted = spark.createDataFrame([(k,) for k in keys], "k string")
        got = {r.k: r.v for r in state.before(batch, wanted).collect()}
        assert got == {k: v for k, v in model.items() if k in keys}
        changed = {k: draw.choice([-1, batch * 100 + i]) for i, k in enumerate(keys[:3])}
        for _ in range(2 if batch in (2, 7, 8) else 1):  # a batch that runs again
            state.write(batch, spark.createDataFrame(list(changed.items()), SCHEMA))
        model = {k: v for k, v in {**model, **changed}.items() if v >= 0}
        assert {r.k: r.v for r in state.whole(batch + 1).collect()} == model
    # Only runs that the last batch or the next one reads are left.
    left = {(int(run[0][6:]), int(run[1][6:])) for run in rows_written(tmp_path)}
    assert left <= set(runs_before(9, 3)) | set(runs_before(10, 3))


def test_writes_grow_with_the_batch(spark, tmp_path):
    """100,000 keys before; a batch of ten events writes ten rows, and reads few buckets."""
    state = KeyedState(spark, str(tmp_path), "k", SCHEMA)
    many = spark.range(100_000).selectExpr("concat('k', id) AS k", "id AS v")
    state.write(0, many)
    state.write(1, many.limit(10))
    assert rows_written(tmp_path)["nivel=0", "tramo=1"] == 10
    plan = state.before(2, many.limit(1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and plan.count("_cubeta") > 1
    assert state.before(2, many.limit(1)).count() == 1


def test_intake_in_many_batches(spark, tmp_path):
    rows = intake_log(60)
    for part in range(4):
        chunk = spark.createDataFrame(rows[part * 15 : (part + 1) * 15], INTAKE_EVENT)
        chunk.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        events = spark.readStream.schema(INTAKE_EVENT).parquet(str(tmp_path / "log"))
        idempotent_intake(
            events, str(tmp_path / "salida"), str(tmp_path / "estado"), str(tmp_path / "ck"), block=4
        ).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "salida")).collect()
    assert sorted((r.seq, r.estado, r.codigo) for r in got) == intake_fold(rows)
    last = {r[3] for r in rows[45:] if r[3] is not None}
    assert rows_written(tmp_path / "estado")["nivel=0", "tramo=3"] == len(last)


def test_change_log_of_cleaning(spark, tmp_path):
    """The log's rows add up to the clean table; a batch writes no id that it doesn't hold."""
    source = raw(spark, STRESS)
    ordered = source.orderBy("_row").collect()
    size = -(-len(ordered) // 3)
    for part in range(3):
        rows = ordered[part * size : (part + 1) * size]
        spark.createDataFrame(rows, source.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "crudo"))
        stream_clean(
            spark.readStream.schema(source.schema).parquet(str(tmp_path / "crudo")),
            str(tmp_path / "limpios"), str(tmp_path / "rechazos"), str(tmp_path / "ck"),
        ).awaitTermination()
        held = {r.id.strip() for r in rows if r.id}
        written = [r for r in clean_changes(spark, str(tmp_path / "limpios")).collect() if r.lote == part]
        assert {r.id for r in written} <= held
    table = {}
    log = clean_changes(spark, str(tmp_path / "limpios")).collect()
    for r in sorted(log, key=lambda r: (r.lote, r.cambio == "+")):
        if r.cambio == "+":
            assert r.id not in table
            table[r.id] = r._row
        else:
            assert table.pop(r.id) == r._row
    assert any(r.cambio == "-" for r in log)
    assert table == {r.id: r._row for r in clean_history(source).clean.collect()}
    assert table == {r.id: r._row for r in clean_so_far(spark, str(tmp_path / "limpios"), 2).collect()}
