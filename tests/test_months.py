"""Tables by month, and the report counted while the judged rows are written."""

from datetime import date

from pyspark.sql import functions as F

from ticketlake.operators import clean, reports
from ticketlake.schemas import TICKET_COLUMNS
from ticketlake.sources import months
from test_clean import STRESS, raw

TICKET = {name: "" for name in TICKET_COLUMNS} | {"fecha_cierre": None, "reaperturas": 0, "estado": "Abierto"}


def _tickets(spark, rows, extra=""):
    """Clean tickets from ``(_row, id, fecha_creacion[, cambio])``."""
    names = ["_row", *TICKET_COLUMNS] + (["cambio"] if extra else [])
    values = [
        tuple({**TICKET, "_row": r[0], "id": r[1], "fecha_creacion": r[2], "cambio": r[-1]}[n] for n in names)
        for r in rows
    ]
    return spark.createDataFrame(values, clean.CLEAN_ROWS + extra)


def _read(df):
    return sorted((r["_row"], r["id"], r["fecha_creacion"]) for r in df.collect())


HISTORY = [
    (1, "a", date(1997, 1, 1)), (2, "b", date(1997, 1, 31)), (3, "c", date(1997, 2, 1)),
    (4, "d", date(1997, 12, 31)), (5, "e", date(1998, 1, 1)), (6, "a", date(1997, 1, 1)),
]


def test_period_bounds(spark, tmp_path):
    path = str(tmp_path / "t")
    months.write_months(_tickets(spark, HISTORY), path)
    assert _read(months.read_months(spark, path)) == HISTORY
    for start, end in [
        (date(1997, 1, 1), date(1997, 1, 31)), (date(1997, 1, 2), date(1997, 2, 1)),
        (date(1997, 12, 31), date(1998, 1, 1)), (date(1999, 1, 1), date(1999, 12, 31)),
        (date(1997, 2, 1), date(1997, 1, 1)), (None, date(1997, 1, 31)), (date(1997, 12, 31), None),
    ]:
        expected = [r for r in HISTORY if (start or r[2]) <= r[2] <= (end or r[2])]
        assert _read(months.read_months(spark, path, start, end)) == expected
    assert _read(months.read_month(spark, path, 1997, 12)) == [HISTORY[3]]


def test_other_months_are_not_read(spark, tmp_path):
    path = str(tmp_path / "t")
    months.write_months(_tickets(spark, HISTORY), path)
    month = months.read_month(spark, path, 1997, 1)
    plan = reports.period_report(month, "1997-01")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(mes_creacion" in plan
    assert "GreaterThanOrEqual(fecha_creacion,1997-01-01)" in plan
    assert {f.split("mes_creacion=")[1][:10] for f in month.select(F.input_file_name()).toPandas().iloc[:, 0]} == {"1997-01-01"}
    assert {r["nombre"]: r["total"] for r in reports.period_report(month, "1997-01").collect()} == {None: 3, "Sin area": 3}


def test_writing_replaces_its_months_only(spark, tmp_path):
    path = str(tmp_path / "t")
    months.write_months(_tickets(spark, HISTORY), path)
    months.write_months(_tickets(spark, [(9, "z", date(1997, 1, 5))]), path)
    assert _read(months.read_months(spark, path)) == HISTORY[2:5] + [(9, "z", date(1997, 1, 5))]
    months.write_months(_tickets(spark, []), path)
    assert len(_read(months.read_months(spark, path))) == 4


def test_changes_touch_their_months_only(spark, tmp_path):
    path = str(tmp_path / "t")
    first = _tickets(spark, [(*r, "+") for r in HISTORY], ", cambio string")
    assert len(months.apply_changes(spark, path, first)) == 4
    before = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "t" / "mes_creacion=1998-01-01").iterdir()}
    # A ticket moves to another month, one is displaced in its own, a month loses its only row.
    step = _tickets(
        spark,
        [
            (3, "c", date(1997, 2, 1), "-"), (10, "c", date(1997, 3, 1), "+"),
            (2, "b", date(1997, 1, 31), "-"), (11, "b", date(1997, 1, 30), "+"),
        ],
        ", cambio string",
    )
    expected = sorted(
        [r for r in HISTORY if r[0] not in (2, 3)] + [(10, "c", date(1997, 3, 1)), (11, "b", date(1997, 1, 30))]
    )
    for _ in range(2):  # the same batch again changes nothing
        assert months.apply_changes(spark, path, step) == [date(1997, 1, 1), date(1997, 2, 1), date(1997, 3, 1)]
        assert _read(months.read_months(spark, path)) == expected
    assert _read(months.read_month(spark, path, 1997, 2)) == []
    after = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "t" / "mes_creacion=1998-01-01").iterdir()}
    assert after == before
    assert months.apply_changes(spark, path, step.limit(0)) == []


def _reads_of_judged_rows(report):
    return report._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")


def test_report_is_counted_while_writing(spark):
    rows = raw(spark, STRESS)
    run = clean.clean_history(rows)
    checked = clean.materialize(clean.check_tickets(rows))
    again = clean.quality_report(checked, run.quarantine)
    assert sorted(map(tuple, run.report.collect())) == sorted(map(tuple, again.collect()))
    only_repeats = run.duplicates.groupBy("motivo").count()
    repeats = _reads_of_judged_rows(only_repeats)
    # The duplicates once for their motives and once for their sum; the counted values are a row list.
    assert _reads_of_judged_rows(run.report) <= 2 * repeats + 1
    # Rows that were not counted are read for the rejects, the total and the defaults besides.
    assert _reads_of_judged_rows(again) >= 2 * (repeats + 1) + 2


def test_report_of_nothing(spark):
    report = clean.clean_history(raw(spark, [])).report
    assert sorted(map(tuple, report.collect())) == [
        ("totales", "en_cuarentena", 0), ("totales", "leidos", 0), ("totales", "limpios", 0)
    ]
