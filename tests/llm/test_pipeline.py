"""The pipeline: each stage against its operator's own decisions, on what its predecessor kept."""

import corpus_pipeline
import pytest
from corpus import empty_documents, odd_documents, rows
from test_mixing_packing import assert_gapless

from ticketlake.llm import mixing, near_dedup, pii, toxicity
from ticketlake.llm.common import settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The documents before and after each stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, sf_dir))
        out[name] = docs
    return out


def test_order():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "personal_data", "mixing", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_columns(stages):
    for name in ("toxicity", "near_dedup", "personal_data", "mixing"):
        assert stages[name].columns == COLUMNS


def test_toxic_documents_go(stages, spark, sf_dir):
    before = stages["documents"]
    model = toxicity.fit(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = {r["doc_id"]: r["predicted"] for r in rows(toxicity.score_documents(before, model))}
    assert {r["doc_id"] for r in rows(stages["toxicity"])} == {i for i, bad in judged.items() if not bad}


def test_one_of_each_class_stays(stages):
    before, after = stages["toxicity"], rows(stages["near_dedup"])
    kept = {r["doc_id"] for r in rows(near_dedup.near_duplicates(before)) if r["kept"]}
    assert sorted(r["doc_id"] for r in after) == sorted(kept)
    texts = {r["doc_id"]: r for r in rows(before)}
    assert all(texts[r["doc_id"]] == r for r in after)


def test_personal_data_is_replaced(stages):
    before = {r["doc_id"]: r["text"] for r in rows(stages["near_dedup"])}
    changed = 0
    for r in rows(stages["personal_data"]):
        spans = pii.all_spans(before[r["doc_id"]])[1]
        changed += bool(spans)
        assert (r["text"] != before[r["doc_id"]]) == bool(spans)
        assert r["n_chars"] == len(r["text"])
        assert all(before[r["doc_id"]][a:b] not in r["text"] for a, _, b in spans)
    assert changed


def test_mixture(stages):
    table = settle(mixing.leveled(stages["personal_data"]))
    expected = sorted(r["doc_id"] for r in rows(mixing.select_documents(table)))
    assert sorted(r["doc_id"] for r in rows(stages["mixing"])) == expected


def test_packing(stages):
    found = rows(stages["packing"])
    assert_gapless(found, 2048)
    assert sum(r["piece"] == 0 for r in found) == stages["mixing"].count()


def test_run_gives_the_last_stage(stages, spark, sf_dir):
    assert sorted(corpus_pipeline.run(spark, sf_dir).drop("sequence_id", "offset").collect()) == sorted(
        stages["packing"].drop("sequence_id", "offset").collect()
    )


def test_odd_documents_pass_through(spark, sf_dir):
    for docs in (odd_documents(spark), empty_documents(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = settle(stage(spark, docs, sf_dir))
        assert_gapless(rows(docs), 2048)
