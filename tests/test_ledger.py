"""The reminder ledger under runs at the same time, calendars per site, sessions."""

import random
from datetime import date, datetime, timedelta

import pytest
from ticketlake.operators import metrics, reminders
from ticketlake.streaming import ledger
from ticketlake.streaming.flows import send_reminders, session_counts

TODAY = date(2025, 7, 18)
TICKETS = "id_ticket long, codigo string, estado string, fecha_creacion date"
SCHEMA = "k long"


def _fresh(spark, keys):
    wanted = spark.createDataFrame([(k,) for k in keys], SCHEMA)
    return lambda sent: wanted.join(sent, "k", "left_anti")


def _got(df):
    return sorted((r.k, r.intento) for r in df.collect())


def test_entries_are_added_once(spark, tmp_path):
    folder = str(tmp_path / "l")
    assert _got(ledger.add_once(spark, folder, SCHEMA, _fresh(spark, []), "nada")) == []
    assert _got(ledger.add_once(spark, folder, SCHEMA, _fresh(spark, [1, 2]), "a")) == [(1, "a"), (2, "a")]
    assert _got(ledger.add_once(spark, folder, SCHEMA, _fresh(spark, [2, 3]), "b")) == [(1, "a"), (2, "a"), (3, "b")]
    # A run that is started again under its name has entered what it had to.
    assert len(_got(ledger.add_once(spark, folder, SCHEMA, _fresh(spark, [1, 2, 3]), "a"))) == 3
    assert ledger.manifests(spark, folder) == ["a", "b"]


@pytest.mark.parametrize("renamed", [False, True])
def test_of_two_runs_at_once_one_wins(spark, tmp_path, monkeypatch, renamed):
    """A rival enters its rows between this run's reading and its manifest."""
    folder = str(tmp_path / "l")
    place = ledger._renamed if renamed else ledger.place
    attempts = []

    def interrupted(*names):
        attempts.append(names)
        if len(attempts) == 1:
            ledger.add_once(spark, folder, SCHEMA, _fresh(spark, [1, 2]), "rival")
        return place(*names)

    monkeypatch.setattr(ledger, "place", interrupted)
    got = _got(ledger.add_once(spark, folder, SCHEMA, _fresh(spark, [1, 2, 3]), "own"))
    assert got == [(1, "rival"), (2, "rival"), (3, "own")]
    # Own first try lost to the rival's, the second took the next number.
    assert len(attempts) == 3 and ledger.manifests(spark, folder) == ["rival", "own"]


def test_staged_entries_without_a_manifest_do_not_count(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "l")

    def dies(*_):
        raise RuntimeError("gone")

    with monkeypatch.context() as patch, pytest.raises(RuntimeError):
        patch.setattr(ledger, "place", dies)
        ledger.add_once(spark, folder, SCHEMA, _fresh(spark, [1, 2]), "a")
    assert _got(ledger.entries(spark, folder, SCHEMA)) == []
    assert _got(ledger.add_once(spark, folder, SCHEMA, _fresh(spark, [2]), "a")) == [(2, "a")]


def test_two_writers_of_reminders(spark, tmp_path, monkeypatch):
    tickets = spark.createDataFrame([(i, f"T{i}", "Abierto", date(2025, 7, 1)) for i in range(20)], TICKETS)
    history = spark.createDataFrame([], "id_ticket long, fecha_cambio date")
    place, calls = ledger.place, []

    def interrupted(*names):
        calls.append(names)
        if len(calls) == 1:
            send_reminders(tickets, history, str(tmp_path), TODAY, run="rival")
        return place(*names)

    monkeypatch.setattr(ledger, "place", interrupted)
    sent = send_reminders(tickets, history, str(tmp_path), TODAY, run="own").collect()
    assert sorted(r.id_ticket for r in sent) == list(range(20))
    assert {r.intento for r in sent} == {"rival"}


def _plain_days(start, end, free):
    days = [start + timedelta(n) for n in range(1, (end - start).days + 1)]
    return sum(d.weekday() < 5 and d not in free for d in days)


def test_site_calendars(spark):
    rng = random.Random(3)
    free = {
        "Norte": {TODAY - timedelta(rng.randrange(60)) for _ in range(15)},
        "Sur": {TODAY + timedelta(rng.randrange(-90, 30)) for _ in range(25)},
        "Fines": {date(2025, 7, 12), date(2025, 7, 13)},
    }
    holidays = [(s, d) for s, days in free.items() for d in days] * 2 + [(None, TODAY), ("Norte", None)]
    rows = [
        (i, f"T{i}", site, TODAY - timedelta(rng.randrange(80)))
        for i, site in enumerate(["Norte", "Sur", "Fines", "Sin festivos", None] * 40)
    ]
    tickets = spark.createDataFrame(rows, "id_ticket long, codigo string, sede string, ultimo_cambio date")
    due = reminders.due_by_site(tickets, spark.createDataFrame(holidays, "sede string, dia date"), TODAY)
    expected = {i: _plain_days(day, TODAY, free.get(site, set())) for i, _, site, day in rows}
    assert {r.id_ticket: r.dias_habiles for r in due.collect()} == {
        i: n for i, n in expected.items() if n >= reminders.REMINDER_DAYS
    }
    none = spark.createDataFrame([], "sede string, dia date")
    assert {r.id_ticket: r.dias_habiles for r in reminders.due_by_site(tickets, none, TODAY).collect()} == {
        i: n for i, _, _, day in rows if (n := _plain_days(day, TODAY, set())) >= reminders.REMINDER_DAYS
    }


EVENT = "seq long, ts timestamp, operacion string, origen string, tokens_entrada int, tokens_salida int"


def _plain_sessions(rows, gap):
    out = {}
    for _, ts, name, *_ in sorted(rows, key=lambda r: r[1]):
        runs = out.setdefault(name, [])
        if runs and ts - runs[-1][1] <= gap:
            runs[-1] = (runs[-1][0], ts, runs[-1][2] + 1)
        else:
            runs.append((ts, ts, 1))
    return sorted((str(name), *run) for name, runs in out.items() for run in runs)


def _sessions(df):
    return sorted((str(r.operacion), r.desde, r.hasta, r.llamadas) for r in df.collect())


def _events(n):
    """A busy operation, a quiet one, one without a name, ties, and calls exactly one gap apart."""
    rng = random.Random(7)
    start = datetime(2025, 1, 1)
    rows = []
    for i in range(n):
        name = rng.choice(["a", "a", "a", "b", None])
        ts = start + timedelta(seconds=rng.choice([rng.randrange(40_000), 600 * rng.randrange(60)]))
        rows.append((i, ts, name, "modelo", 1, None))
    return rows


def test_sessions(spark):
    rows = _events(400)
    gap = timedelta(seconds=600)
    df = spark.createDataFrame(rows + [(-1, None, "a", "modelo", 1, 1)], EVENT)
    assert _sessions(metrics.sessions(df, 600)) == _plain_sessions(rows, gap)
    assert metrics.sessions(spark.createDataFrame([], EVENT)).count() == 0


def test_sessions_of_a_stream_out_of_order(spark, tmp_path):
    """A late call joins two sessions that earlier batches held apart."""
    rows = _events(200)
    random.Random(1).shuffle(rows)
    source = str(tmp_path / "log")
    steps = [rows[:70], rows[70:140], rows[140:], [(999, datetime(2100, 1, 1), "fin", "modelo", 1, 1)]]
    for step in steps:
        spark.createDataFrame(step, EVENT).coalesce(1).write.mode("append").parquet(source)
        session_counts(spark.readStream.schema(EVENT).parquet(source), "10 minutes", "1 day").writeStream.format(
            "parquet"
        ).option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(
            availableNow=True
        ).start().awaitTermination()
    got = _sessions(spark.read.parquet(str(tmp_path / "out")))
    assert got == _plain_sessions(rows, timedelta(seconds=600))
    assert got == _sessions(metrics.sessions(spark.createDataFrame(rows, EVENT), 600))
