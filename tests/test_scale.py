"""Work that must not grow faster than its input: what is dealt, read once or kept in place."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from ticketlake.functions.dates import standardize_dates
from ticketlake.operators import clean, dictionaries
from ticketlake.operators.reminders import business_days, due_by_site
from ticketlake.plans import queries
from ticketlake.schemas import TICKET_COLUMNS

RULE = "orden long, categoria string, palabra string"


def test_a_history_of_one_split_is_parsed_by_many_tasks(spark, tmp_path):
    orders = spark.range(1, 4001).select(
        F.col("id").alias("o_orderkey"),
        (F.col("id") % 50).alias("o_custkey"),
        F.lit("F").alias("o_orderstatus"),
        F.lit(10.5).alias("o_totalprice"),
        F.lit("2001-02-03 00:00:00").cast("timestamp").alias("o_orderdate"),
        F.lit("1-URGENT").alias("o_orderpriority"),
    )
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, "false")
    try:
        raw = queries._raw(spark, str(tmp_path))
    finally:
        spark.conf.set(merge, "true")
    sizes = [r["count"] for r in raw.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < raw.count() / 3


def test_ladders_are_read_and_not_counted_again(spark):
    names = ", ".join(f"{n} {'date' if n.startswith('fecha') else 'string'}" for n in TICKET_COLUMNS)
    valid = spark.createDataFrame([], f"_row long, {names}".replace("reaperturas string", "reaperturas long"))
    plan = clean.mark_duplicates(valid)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_dates_without_a_day_are_no_dates(spark):
    written = ["15-Xyz-2025", "08-Xyz-2025", "8-mar-2025", "2025-2-30", "0000-1-1", "29/2/2024", "2025-08", "", None]
    df = spark.createDataFrame([(t,) for t in written], "t string")
    read = standardize_dates(df, {"d": "t"}).select("d.valor", "d.motivo").collect()
    assert [tuple(r) for r in read] == [
        (None, "mes_no_reconocido"), (None, "mes_no_reconocido"), (date(2025, 3, 8), None),
        (None, "fecha_inexistente"), (None, "fecha_inexistente"), (date(2024, 2, 29), None),
        (None, "formato_no_reconocido"), (None, None), (None, None),
    ]


def test_a_calendar_is_read_per_day_and_not_per_ticket(spark):
    draw = random.Random(1)
    today, first = date(2001, 8, 6), date(2000, 1, 1)
    days = [first + timedelta(draw.randrange(560)) for _ in range(40)]
    calendar = {"a": days[:25], "b": days[20:]}
    holidays = spark.createDataFrame([(s, d) for s, ds in calendar.items() for d in ds] + [(None, first)], "sede string, dia date")
    rows = [(k, f"T{k}", draw.choice(["a", "b", "c", None]), first + timedelta(draw.randrange(560))) for k in range(300)]
    rows += [(300, "T300", "a", None), (301, "T301", None, None), (0, "T0", *rows[0][2:])]
    tickets = spark.createDataFrame(rows, "id_ticket long, codigo string, sede string, ultimo_cambio date")
    due = due_by_site(tickets, holidays, today)
    assert "calendario" not in due._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r["id_ticket"], r["sede"] or "", r["dias_habiles"]) for r in due.collect())
    want = []
    for site in ("a", "b", "c", None):
        own = tickets.filter(F.col("sede").eqNullSafe(site))
        aged = own.select("id_ticket", business_days(F.col("ultimo_cambio"), F.lit(today), sorted(set(calendar.get(site, [])))).alias("n"))
        want += [(r["id_ticket"], site or "", r["n"]) for r in aged.filter("n >= 3").collect()]
    assert got == sorted(want) and len(got) > 200


def test_a_few_rules_go_to_the_texts(spark, monkeypatch):
    listed = [(k, f"c{k}", w) for k, w in enumerate(["zz", "abcd", "ñandú", "b", "abcdefg", "😀x", ""][:6])]
    texts = ["xxabcdefgxx", "el ÑANDÚ", "no", "abc d", "caso 😀x", None, "", "zzabcd"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    table = spark.createDataFrame(listed, RULE)

    def run():
        found = dictionaries.classify_by_rule_table(docs, F.col("t"), table)
        return {r["id"]: r["categoria"] for r in found.collect()}

    def never(*_):
        raise AssertionError("texts were cut into rows of pieces")

    by_piece = dictionaries._with_grams
    cut = lambda df, text, *rest: never() if text == "_key" else by_piece(df, text, *rest)
    monkeypatch.setattr(dictionaries, "_with_grams", cut)
    few = run()
    monkeypatch.setattr(dictionaries, "FEW_GRAMS", 0)
    assert few == run()
    monkeypatch.setattr(dictionaries, "_with_grams", by_piece)
    monkeypatch.setattr(dictionaries, "DIMENSION_ROWS", 0)
    assert few == run()
    assert [few[k] for k in (0, 1, 4, 7)] == ["c1", "c2", "c5", "c0"]
