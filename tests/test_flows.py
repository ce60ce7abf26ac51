"""Sources, sinks, metrics, intake and streams."""

import json
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ticketlake.functions.citations import fingerprint, idempotency_key
from ticketlake.operators import intake, metrics, reminders, reports, requests
from ticketlake.operators.clean import clean_history
from ticketlake.operators.rules import validate_model_output
from ticketlake.schemas import INTAKE_EVENT
from ticketlake.session import shared_folder
from ticketlake.sources import documents, tickets
from ticketlake.streaming.flows import (
    classify_batches,
    classify_with_answers,
    clean_so_far,
    late_events,
    rolling_latency,
    send_reminders,
    stream_clean,
    window_counts,
)
from ticketlake.streaming.intake import idempotent_intake
from test_clean import STRESS, raw

HEADER = "id,fecha_creacion,fecha_cierre,area,categoria,prioridad,canal,solicitante,asunto,descripcion,estado,reaperturas"


def test_csv_round_trip(spark, tmp_path):
    source = tmp_path / "historico.csv"
    lines = [
        '﻿' + HEADER,
        'A,2025-03-08,,Compras,Red,Alta,correo,ana,"Coma, y ""comillas""","dos\nrenglones",Abierto,0',
        "",
        "B,2025-03-08,2025-03-09,,Red,Alta,correo,ana,x,y,Cerrado,1",
        "C,basura,,,,,,,,,,",
    ]
    source.write_text("\n".join(lines) + "\n", encoding="utf-8")
    df = tickets.read_tickets(spark, str(source))
    rows = df.orderBy("_row").collect()
    assert [(r._row, r.id) for r in rows] == [(1, "A"), (2, "B"), (3, "C")]
    assert (rows[0].asunto, rows[0].descripcion) == ('Coma, y "comillas"', "dos\nrenglones")
    result = clean_history(df)
    tickets.write_clean(result.clean, str(tmp_path / "limpio"), "csv")
    back = tickets.read_tickets(spark, str(tmp_path / "limpio"))
    assert {(r.id, r.fecha_cierre, r.asunto) for r in back.collect()} == {
        ("A", None, 'Coma, y "comillas"'), ("B", "2025-03-09", "x"),
    }
    tickets.write_quarantine(result.quarantine, str(tmp_path / "cuarentena"))
    stored = spark.read.parquet(str(tmp_path / "cuarentena")).head()
    assert stored.motivo == "fecha_creacion_invalida"
    assert json.loads(stored.fila_original)["fecha_creacion"] == "basura"
    tickets.write_summary(reports.summarize(result.clean), str(tmp_path / "resumen"))
    empty = tmp_path / "vacio.csv"
    empty.write_text(HEADER + "\n")
    assert tickets.read_tickets(spark, str(empty)).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tickets.read_tickets(spark, str(tmp_path / "nada.csv"))


def test_row_numbers_over_files(spark, tmp_path):
    for name, n in (("a", 5), ("b", 3)):
        rows = "\n".join(f"{name}{i},,,,,,,,,,," for i in range(1, n + 1))
        (tmp_path / f"{name}.csv").write_text(f"{HEADER}\n{rows}\n")
    got = tickets.read_tickets(spark, str(tmp_path)).collect()
    assert {r.id: r._line for r in got} == {
        **{f"a{i}": i for i in range(1, 6)}, **{f"b{i}": i for i in range(1, 4)},
    }
    assert [r.id for r in sorted(got, key=lambda r: r._row)] == [f"a{i}" for i in range(1, 6)] + ["b1", "b2", "b3"]
    assert sorted(r._row for r in got) == list(range(1, 9))


def test_splits_of_one_file(spark, tmp_path):
    rows = "\n".join(f"t{i},,,,,,,,,,,{'x' * 30}" for i in range(3000))
    (tmp_path / "grande.csv").write_text(f"{HEADER}\n{rows}\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = tickets.read_tickets(spark, str(tmp_path), multi_line=False)
        assert tickets._csv(spark, str(tmp_path), False).rdd.getNumPartitions() > 3
        assert {r.id: r._row for r in got.collect()} == {f"t{i}": i + 1 for i in range(3000)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_same_ticket_in_two_files(spark, tmp_path):
    line = "A,2025-03-08,,Compras,Red,Alta,correo,ana,x,y,Abierto,0"
    for name in ("uno", "dos"):
        (tmp_path / f"{name}.csv").write_text(f"{HEADER}\n{line}\n")
    result = clean_history(tickets.read_tickets(spark, str(tmp_path)))
    assert (result.clean.count(), result.duplicates.count()) == (1, 1)
    assert result.duplicates.head().motivo == "duplicado_exacto"


def test_header_by_name(spark, tmp_path):
    names = HEADER.split(",")
    values = dict(zip(names, "A,2025-03-08,,Compras,Red,Alta,correo,ana,x,y,Abierto,0".split(",")))
    orders = [names, names[::-1], ["extra", *names[2:], names[0], names[1]], [n for n in names if n != "canal"]]
    for k, order in enumerate(orders):
        cells = [f"{values.get(n, 'sobra')}" if n != "id" else f"T{k}" for n in order]
        (tmp_path / f"f{k}.csv").write_text("\ufeff" * (k % 2) + ",".join(order) + "\n" + ",".join(cells) + "\n", encoding="utf-8")
    rows = sorted(tickets.read_tickets(spark, str(tmp_path)).collect(), key=lambda r: r.id)
    assert [r.id for r in rows] == ["T0", "T1", "T2", "T3"]
    for r in rows:
        assert (r.fecha_creacion, r.estado, r.descripcion, r.reaperturas) == ("2025-03-08", "Abierto", "y", "0")
        assert r.canal == (None if r.id == "T3" else "correo")


def test_repeated_row_numbers_are_an_error(spark):
    source = raw(spark, STRESS)
    with pytest.raises(ValueError, match="more than once"):
        clean_history(source.unionByName(source.limit(1)))


def test_shared_folder_is_required():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        class sparkContext:  # noqa: N801
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session)


def test_document_sources(spark, tmp_path):
    folder = tmp_path / "politicas"
    folder.mkdir()
    (folder / "uno.txt").write_text("1. Título\ncon\ttabulador", encoding="utf-8")
    (folder / "roto.txt").write_bytes(b"\xff\xfe\xfa")
    rows = {r.file_name: r.text for r in documents.read_policy_texts(spark, str(folder)).collect()}
    assert rows == {"uno": "1. Título\ncon tabulador", "roto": None}
    log = tmp_path / "log.json"
    log.write_text(
        '{"momento":"t","evento":"e","texto":"privado","latencia_ms":12.5,"operacion":"x","d":{"a":[1]}}\n{roto\n'
    )
    read = documents.read_event_log(spark, str(log))
    events = metrics.redact_events(read).collect()
    assert events[0].texto == metrics.REDACTED and events[0].evento == "e"
    assert events[0].extras == {"latencia_ms": "12.5", "operacion": "x", "d": '{"a":[1]}'}
    assert events[1]["_roto"] == "{roto"
    documents.write_event_log(read.filter("_roto is null"), str(tmp_path / "log-fuera"))
    again = documents.read_event_log(spark, str(tmp_path / "log-fuera")).head()
    assert again.texto == metrics.REDACTED and again.extras == events[0].extras and again.modulo is None
    cases = tmp_path / "casos.csv"
    cases.write_text(
        "id_caso,pregunta_o_texto,respuesta_o_categoria_esperada,documento_fuente,seccion_fuente,observacion\n"
        "1,p,15 días,POL-GTH-01_Vacaciones.pdf,5.1 y 5.2,\n2,p,SIN EVIDENCIA EN LOS DOCUMENTOS,,,\n"
        "3,p,Hardware,,,\n"
    )
    got = documents.read_reference_cases(spark, str(cases)).orderBy("id_caso").collect()
    assert [(r.id_caso, r.cita_esperada) for r in got] == [("1", "POL-GTH-01 §5.1"), ("2", None)]


def test_latency_samples(spark):
    rows = [("a", i, float(i)) for i in range(1, 1501)] + [("b", 1, 7.126)] + [("c", 1, 1.0), ("c", 2, 2.0)]
    df = spark.createDataFrame(rows, "operacion string, seq int, latencia_ms double").repartition(9)
    got = {r.operacion: tuple(r)[1:] for r in metrics.latency_summary(df).collect()}
    assert got == {"a": (1000, 1000.0, 1450.0, 1490.0), "b": (1, 7.13, 7.13, 7.13), "c": (2, 2.0, 2.0, 2.0)}
    assert metrics.latency_summary(df.limit(0)).count() == 0


def test_tokens_absent_is_not_zero(spark):
    calls = spark.createDataFrame(
        [("n", None, None, 5), ("n", 10, None, 0), ("n", 4, 6, 2)],
        "proveedor string, tokens_entrada int, tokens_salida int, tokens_razonamiento int",
    )
    row = metrics.token_usage(calls).head()
    assert tuple(row)[1:] == (3, 1, 14, 6, 2, None)


def test_requests(spark):
    df = spark.createDataFrame(
        [(i, f"SOL-{i}", "Compras", "Abierto", "Red", "Alta") for i in range(1, 301)],
        "seq int, codigo string, area string, estado string, categoria string, prioridad string",
    )
    for limit, expected in ((0, 1), (-5, 1), (10_000, 200)):
        page, total = requests.list_requests(df, {"estado": "ABIERTO", "area": None}, limit, -3)
        rows = page.collect()
        assert (len(rows), rows[0].seq) == (expected, 300)
        assert tuple(total.head()) == (300, True)
    with pytest.raises(requests.UnknownFilterValue):
        requests.list_requests(df, {"estado": "cerado"})
    assert requests.get_request(df, "  ").count() == 0
    assert requests.get_request(df, "SOL-7").head().seq == 7
    numbered = requests.number_requests(df.select("seq"), "seq", 999_900, block=7)
    got = {r.seq: r.codigo for r in numbered.collect()}
    assert got[1] == "SOL-999901" and got[100] == "SOL-1000000" and len(set(got.values())) == 300


def test_fingerprint_and_keys(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("a", "")], "x string, y string")
    hashes = [r[0] for r in df.select(fingerprint(y=F.col("y"), x=F.col("x"))).collect()]
    assert hashes[0] == hashes[1] != hashes[2]
    keys = spark.createDataFrame([("  k ",), (" ",), (None,), ("z" * 129,)], "k string")
    got = [tuple(r[0]) for r in keys.select(idempotency_key(F.col("k"))).collect()]
    assert got == [("k", True), (None, True), (None, True), (None, False)]


def test_trace_ids(spark):
    ids = [" abc-1_ñ ", "con espacio", "", None, "x" * 65]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(ids)], "i int, id_traza string")
    got = [r.id_traza for r in metrics.standardize_trace_ids(df).orderBy("i").collect()]
    assert got[0] == "abc-1_ñ" and all(len(v) == 32 and v.isalnum() for v in got[1:])


def intake_log(n=400):
    rng = random.Random(5)
    rows = []
    for seq in range(n):
        action = rng.choice(["reservar", "reservar", "reservar", "completar", "liberar"])
        key = rng.choice([None, "HOT", "HOT", *[f"k{i}" for i in range(12)]])
        rows.append((seq, datetime(2025, 1, 1), action, key, rng.choice(["h1", "h1", "h2"]),
                     f"SOL-{seq}" if action == "completar" else None))
    return rows


def intake_fold(rows):
    entries, out = {}, []
    for seq, _, action, key, hash_, code in rows:
        entry = entries.get(key)
        if action == "reservar":
            if key is None or entry is None:
                out.append((seq, "nueva", None))
                if key is not None:
                    entries[key] = [hash_, None]
            elif entry[0] != hash_:
                out.append((seq, "conflicto", None))
            elif entry[1] is None:
                out.append((seq, "en_curso", None))
            else:
                out.append((seq, "repetida", entry[1]))
        elif entry is not None and action == "completar":
            entry[1] = code
        elif entry is not None and entry[1] is None:
            del entries[key]
    return out


@pytest.mark.parametrize("block", [1, 7, 10_000])
def test_intake_replay(spark, block):
    rows = intake_log()
    got = intake.replay_intake(spark.createDataFrame(rows, INTAKE_EVENT), block).collect()
    assert sorted((r.seq, r.estado, r.codigo) for r in got) == intake_fold(rows)


def test_one_key_log_in_tree(spark, monkeypatch):
    """All events on one key, in blocks of one event, folded two at a time."""
    monkeypatch.setattr(intake, "FANOUT", 2)
    rows = [(seq, ts, action, "HOT", h, code) for seq, ts, action, _, h, code in intake_log(40)]
    got = intake.replay_intake(spark.createDataFrame(rows, INTAKE_EVENT), 5).collect()
    assert sorted((r.seq, r.estado, r.codigo) for r in got) == intake_fold(rows)


def test_complete_without_code_changes_nothing(spark):
    at = datetime(2025, 1, 1)
    rows = [(1, at, "reservar", "k", "h", None), (2, at, "completar", "k", None, None),
            (3, at, "reservar", "k", "h", None)]
    got = intake.replay_intake(spark.createDataFrame(rows, INTAKE_EVENT)).orderBy("seq").collect()
    assert [r.estado for r in got] == ["nueva", "en_curso"]


def test_states_after(spark):
    rows = intake_log(200)
    frame = lambda part: spark.createDataFrame(part, INTAKE_EVENT)
    half = intake.states_after(frame(rows[:90]), 11)
    rest = intake.replay_intake(frame(rows[90:]), 13, half)
    assert sorted((r.seq, r.estado, r.codigo) for r in rest.collect()) == [
        r for r in intake_fold(rows) if r[0] >= 90
    ]


def test_intake_stream(spark, tmp_path):
    rows = intake_log(120)
    source = str(tmp_path / "log")
    for part in range(3):
        chunk = spark.createDataFrame(rows[part * 40 : (part + 1) * 40], INTAKE_EVENT)
        chunk.coalesce(1).write.mode("append").parquet(source)
        events = spark.readStream.schema(INTAKE_EVENT).parquet(source)
        idempotent_intake(
            events, str(tmp_path / "salida"), str(tmp_path / "estado"), str(tmp_path / "ck"), block=9
        ).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "salida")).collect()
    assert sorted((r.seq, r.estado, r.codigo) for r in got) == intake_fold(rows)
    assert {r.seq for r in got if r.clave is None} == {r[0] for r in rows if r[3] is None and r[2] == "reservar"}


def test_late_events(spark, tmp_path):
    schema = "seq long, ts timestamp, operacion string"
    parts = [[(1, datetime(2025, 1, 1, 10)), (2, datetime(2025, 1, 1, 13))],
             [(3, datetime(2025, 1, 1, 10, 30)), (4, datetime(2025, 1, 1, 12, 55)), (5, datetime(2025, 1, 1, 14))]]
    for part in parts:
        rows = [(seq, ts, "a") for seq, ts in part]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "eventos"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "eventos"))
        late_events(
            stream, str(tmp_path / "tardios"), str(tmp_path / "estado"), str(tmp_path / "ck")
        ).awaitTermination()
    assert [r.seq for r in spark.read.parquet(str(tmp_path / "tardios")).collect()] == [3]


def test_metric_streams(spark, tmp_path, sf_dir):
    from ticketlake.plans.views import view

    events = view(spark, sf_dir, "operaciones")
    source = str(tmp_path / "eventos")
    events.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    published = []
    rolling_latency(
        stream, str(tmp_path / "muestras"), lambda df: published.append(sorted(map(tuple, df.collect()))),
        str(tmp_path / "ck"),
    ).awaitTermination()
    assert published[-1] == sorted(map(tuple, metrics.latency_summary(events).collect()))
    query = (
        window_counts(stream).writeStream.format("memory").queryName("ventanas").outputMode("complete")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("ventanas").collect())) == sorted(
        map(tuple, window_counts(events).collect())
    )


def test_cleaning_stream_equals_batch(spark, tmp_path):
    source = raw(spark, STRESS)
    parts = 4
    ordered = source.orderBy("_row").collect()
    size = -(-len(ordered) // parts)
    for part in range(parts):
        rows = ordered[part * size : (part + 1) * size]
        spark.createDataFrame(rows, source.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "crudo"))
        stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "crudo"))
        stream_clean(
            stream, str(tmp_path / "limpios"), str(tmp_path / "rechazos"), str(tmp_path / "ck")
        ).awaitTermination()
    batch = clean_history(source)
    kept = clean_so_far(spark, str(tmp_path / "limpios"), parts - 1)
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, batch.clean.collect()))
    columns = ["numero_de_fila", "motivo", "detalle", "numero_fila_descartada"]
    rejects = spark.read.parquet(str(tmp_path / "rechazos")).select(columns)
    assert sorted(map(repr, rejects.collect())) == sorted(map(repr, batch.quarantine.select(columns).collect()))


def test_classification_batches(spark, tmp_path):
    schema = "ticket_id int, asunto string, descripcion string"
    arrived = spark.createDataFrame([(1, "Sin red", ""), (2, "Clave", "vencida"), (3, "", " ")], schema)
    arrived.write.parquet(str(tmp_path / "tickets"))
    answers = spark.createDataFrame(
        [(1, True, 'va {"categoria":"reportes","prioridad":"alta"}', "n", "m", 1.0, 1, 1)],
        "ticket_id int, ok boolean, texto string, proveedor string, modelo string, latencia_ms double, "
        "tokens_entrada int, tokens_salida int",
    )
    for _ in range(2):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "tickets"))
        classify_batches(stream, answers, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("ticket_id").collect()
    assert [(r.categoria, r.prioridad, r.origen, r.motivo_degradacion) for r in got] == [
        ("Informes", "Alta", "modelo", None),
        ("Accesos", "Media", "degradado", "proveedor_no_disponible"),
        ("Otros", "Media", "degradado", "salida_no_interpretable"),
    ]


def test_repeated_answers(spark):
    """A second answer to a ticket doubles nothing, in any order."""
    schema = (
        "ticket_id int, ok boolean, texto string, proveedor string, modelo string, latencia_ms double, "
        "tokens_entrada int, tokens_salida int"
    )
    arrived = spark.createDataFrame([(1, "Sin red", ""), (2, "Clave", "vencida")], "ticket_id int, asunto string, descripcion string")
    rows = [
        (1, False, None, "n", "m", 1.0, 1, 1),
        (1, True, '{"categoria":"Red","prioridad":"alta"}', "n", "m", 2.0, 1, 1),
        (1, True, '{"categoria":"reportes","prioridad":"alta"}', "n", "m", 1.0, 1, 1),
    ]
    for order in (rows, rows[::-1]):
        got = validate_model_output(arrived, spark.createDataFrame(order, schema)).orderBy("ticket_id").collect()
        assert [(r.ticket_id, r.categoria, r.origen) for r in got] == [(1, "Red", "modelo"), (2, "Accesos", "degradado")]


def test_answers_that_come_later(spark, tmp_path):
    """In another batch, twice, too late, before the ticket, or never."""
    at = datetime(2025, 1, 1, 10)
    ask = "ticket_id int, asunto string, descripcion string, momento timestamp"
    give = (
        "ticket_id int, ok boolean, texto string, proveedor string, modelo string, latencia_ms double, "
        "tokens_entrada int, tokens_salida int, momento_respuesta timestamp"
    )
    far = datetime(2030, 1, 1)

    def answer(ticket, minute, category):
        text = f'{{"categoria":"{category}","prioridad":"alta"}}'
        return (ticket, True, text, "n", "m", 1.0, 1, 1, at + timedelta(minutes=minute))

    asked = [[(i, "Sin red", "", at) for i in (1, 2, 3, 4, 5)], [], [], [(-1, "", "", far)]]
    given = [
        [answer(5, -1, "reportes")],
        [answer(1, 30, "reportes"), answer(2, 90, "Hardware")],
        [answer(1, 31, "Hardware"), answer(2, 20, "reportes"), answer(3, 121, "reportes")],
        [(-1, None, None, None, None, None, None, None, far)],
    ]
    for tickets_part, answers_part in zip(asked, given, strict=True):
        for rows, schema, name in ((tickets_part, ask, "t"), (answers_part, give, "r")):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        classify_with_answers(
            spark.readStream.schema(ask).parquet(str(tmp_path / "t")),
            spark.readStream.schema(give).parquet(str(tmp_path / "r")),
            str(tmp_path / "out"), str(tmp_path / "ck"),
        ).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("ticket_id").collect()
    assert [(r.ticket_id, r.categoria, r.origen) for r in got] == [
        (1, "Informes", "modelo"), (2, "Informes", "modelo"),
        (3, "Red", "degradado"), (4, "Red", "degradado"), (5, "Red", "degradado"),
    ]


def test_reminders_run_twice(spark, tmp_path):
    open_tickets = spark.createDataFrame(
        [(1, "A", "Abierto", date(2025, 7, 10)), (2, "B", "Abierto", date(2025, 7, 16)),
         (3, "C", "Cerrado", date(2025, 7, 1)), (4, "D", "Abierto", date(2025, 7, 11))],
        "id_ticket long, codigo string, estado string, fecha_creacion date",
    )
    history = spark.createDataFrame(
        [(2, date(2025, 7, 16)), (4, date(2025, 7, 15))], "id_ticket long, fecha_cambio date"
    )
    ledger = str(tmp_path / "avisos")
    for _ in range(2):
        sent = send_reminders(open_tickets, history, ledger, date(2025, 7, 18), [date(2025, 7, 14)])
        assert sorted((r.id_ticket, r.tipo, r.dias_habiles) for r in sent.collect()) == [
            (1, "escalamiento", 5), (4, "recordatorio", 3),
        ]


def test_business_days(spark):
    df = spark.createDataFrame(
        [(date(2025, 7, 11), date(2025, 7, 14)), (date(2025, 7, 12), date(2025, 7, 13)),
         (date(2025, 7, 18), date(2025, 7, 21)), (date(2025, 7, 7), date(2025, 7, 21))],
        "a date, b date",
    )
    days = reminders.business_days(F.col("a"), F.col("b"), [date(2025, 7, 21)])
    assert [r[0] for r in df.select(days).collect()] == [1, 0, 0, 9]
