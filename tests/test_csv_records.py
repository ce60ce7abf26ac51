"""The splittable history reader against the standard library's CSV reader."""

import csv
import io
import random

import pytest
from hypothesis import given, settings, strategies as st

from ticketlake.schemas import TICKET_COLUMNS
from ticketlake.sources import csv_records, tickets

NAMES = ["id", "asunto", "descripcion", "estado"]


def expected(text):
    """Rows by name, as the standard library reads them."""
    csv.field_size_limit(1 << 30)
    return [r for r in csv.DictReader(io.StringIO(text.removeprefix("﻿"), newline=""))]


def written(rows, names=NAMES, end="\n", quoting=csv.QUOTE_MINIMAL):
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator=end, quoting=quoting)
    writer.writerow(names)
    writer.writerows(rows)
    return out.getvalue()


def odd_value(draw):
    kind = draw.random()
    if kind < 0.3:
        return "\n".join("línea " + "y" * draw.randint(0, 30) for _ in range(draw.randint(1, 12)))
    if kind < 0.5:
        return draw.choice(['dice "hola"', '"', '""', "a,b", '",\n"', "\r\nx", "\n\n", '5" pipe, "q'])
    return "z" * draw.randint(0, 40)


@pytest.fixture
def small_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    yield lambda n: spark.conf.set(key, str(n))
    spark.conf.set(key, old)


@given(st.text(alphabet='a,"\r\n b', max_size=40))
@settings(max_examples=400)
def test_state_after_a_line(text):
    """Against a reader of single characters."""
    line = text.replace("\n", "").encode()
    for inside in (False, True):
        state = "quoted" if inside else "start"
        for c in line.decode():
            if state == "quoted":
                state = "closing" if c == '"' else "quoted"
            elif state == "closing":
                state = {'"': "quoted", ",": "start"}.get(c, "plain")
            elif c == ",":
                state = "start"
            elif state == "start" and c == '"':
                state = "quoted"
            else:
                state = "plain"
        assert csv_records.inside_after(line, inside) is (state == "quoted")


@pytest.mark.parametrize("split", [150, 700, 5_000])
@pytest.mark.parametrize("head_bytes", [40, 1 << 20])
def test_line_breaks_across_splits(spark, tmp_path, small_splits, split, head_bytes):
    small_splits(split)
    draw = random.Random(split)
    total = 0
    texts = {}
    for k, end in enumerate(("\n", "\r\n")):
        rows = [[f"{k}-{i}", odd_value(draw), odd_value(draw), "x"] for i in range(30)]
        texts[k] = "﻿" * k + written(rows, end=end)
        (tmp_path / f"h{k}.csv").write_bytes(texts[k].encode())
        total += len(rows)
    records, splits = csv_records.read_records(spark, str(tmp_path), head_bytes)
    if split < 5_000:
        assert splits.count() > 4
    assert sorted(r._row for r in records.select("_row").collect()) == list(range(1, total + 1))
    got = tickets.read_tickets(spark, str(tmp_path)).orderBy("_row").collect()
    want = [r for k in texts for r in expected(texts[k])]
    assert [(r.id, r.asunto or "", r.descripcion or "", r.estado) for r in got] == [
        tuple(r[n] for n in NAMES) for r in want
    ]
    assert [r._line for r in got] == [*range(1, 31), *range(1, 31)]


def test_value_longer_than_many_splits(spark, tmp_path, small_splits, monkeypatch):
    small_splits(2_500)
    long = "\n".join(f'renglón {i}, "{i}"' for i in range(1_000))
    text = written([["1", "a", long, "x"], ["2", long, "b", "y"], ["3", "", "c", "z"]])
    (tmp_path / "h.csv").write_text(text, newline="")
    for head_bytes, tail_bytes in ((100, 10), (1 << 20, 64 << 20)):
        monkeypatch.setattr(csv_records, "MAX_TAIL_BYTES", tail_bytes)
        records, _ = csv_records.read_records(spark, str(tmp_path), head_bytes)
        assert [r._row for r in records.orderBy("_row").collect()] == [1, 2, 3]
    got = tickets.read_tickets(spark, str(tmp_path)).orderBy("_row").collect()
    assert [(r.id, r.asunto, r.descripcion) for r in got] == [("1", "a", long), ("2", long, "b"), ("3", None, "c")]


def test_wide_files(spark, tmp_path):
    """Known columns beyond any place; files of different widths."""
    for k, extra in enumerate((0, 70, 700)):
        names = [f"otra{i}" for i in range(extra)] + list(TICKET_COLUMNS)
        row = ["relleno"] * extra + [f"{name}{k}" for name in TICKET_COLUMNS]
        (tmp_path / f"w{k}.csv").write_text(written([row], names))
    got = tickets.read_tickets(spark, str(tmp_path)).orderBy("_row").collect()
    assert [tuple(r[n] for n in TICKET_COLUMNS) for r in got] == [
        tuple(f"{name}{k}" for name in TICKET_COLUMNS) for k in range(3)
    ]


def test_odd_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"")
    (tmp_path / "b.csv").write_bytes(b"\n\r\n\n")
    (tmp_path / "c.csv").write_bytes(b'\n"id","a\nsunto",estado\r\n\r\n1,x\n2,y,z,too,many\n')
    (tmp_path / "d.csv").write_bytes(b'id,asunto\n7,"not closed\n8,x')
    got = tickets.read_tickets(spark, str(tmp_path)).orderBy("_row").collect()
    assert [(r._line, r.id, r.estado) for r in got] == [(1, "1", None), (2, "2", "z"), (1, "7", None)]
    assert got[2].asunto == "not closed\n8,x"


def test_two_scans(spark, tmp_path):
    (tmp_path / "h.csv").write_text(written([["1", "a", "b\nc", "x"]]))
    plan = tickets.read_tickets(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    # The scan of the splits is done and stored by now; what is left reads the files once.
    assert plan.count("FileScan text") == 1


def test_joined_by_split(spark, tmp_path, small_splits, monkeypatch):
    """More splits than are broadcast: the same rows through a shuffle."""
    small_splits(300)
    draw = random.Random(5)
    text = written([[str(i), odd_value(draw), odd_value(draw), "x"] for i in range(50)])
    (tmp_path / "h.csv").write_text(text, newline="")
    whole = [tuple(r) for r in tickets.read_tickets(spark, str(tmp_path)).orderBy("_row").collect()]
    monkeypatch.setattr(csv_records, "MAX_SPLITS", 2)
    assert [tuple(r) for r in tickets.read_tickets(spark, str(tmp_path)).orderBy("_row").collect()] == whole
    assert len(whole) == 50
