"""Registered corpus queries: each dealt operator over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ticketlake.llm import (
    chunk_dedup,
    collocations,
    licenses,
    mixing,
    near_dedup,
    oracle,
    order_minhash,
    outliers,
    packing,
    pii,
    quality,
    toxicity,
    warc,
    whitening,
)
from ticketlake.llm.common import discard, read_table, settle, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {
    "op2_hierarchical_mix": oracle.mixing_sql(),
    "op8_minhash_near_dedup": oracle.NEAR_DUPLICATES,
    "op12_warc_transactions": oracle.WARC_TRANSACTIONS,
    "op13_quotient_filter_collocations": oracle.COLLOCATIONS,
}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _of(kind: str):
    return lambda span: span["kind"] == kind


@query
def op1_quality_pu(spark, sf_dir):
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return quality.score_documents(docs, quality.fit(docs, labels))


@query
def op2_hierarchical_mix(spark, sf_dir):
    documents = settle(mixing.leveled(read_table(spark, sf_dir, "documents")))
    return mixing.select_documents(documents)


@query
def op3_gear_chunks(spark, sf_dir):
    # Every repeat counts, however short.
    return chunk_dedup.repeated_spans(read_table(spark, sf_dir, "documents"), min_span=1)


@query
def op4_template_automata(spark, sf_dir):
    found = licenses.scan_documents(read_table(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct(F.transform("base", lambda p: p["label"])))
    own = F.transform("templates", lambda p: p["label"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda p: p["word"])).alias("first_word"),
        F.array_max(F.transform("base", lambda p: p["word"])).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        # A license whose mandatory wording is all there is certain; a bare phrase is half a sign.
        F.when(F.size("templates") > 0, 1.0).when(F.size("base") > 0, 0.5).otherwise(0.0).alias("score"),
    )


@query
def op5_order_minhash(spark, sf_dir):
    return order_minhash.fingerprint_documents(read_table(spark, sf_dir, "documents"))


@query
def op6_dominance_best_fit(spark, sf_dir):
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


@query
def op7_toxic_segments(spark, sf_dir):
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    scored = toxicity.score_documents(docs, toxicity.fit(docs, labels))
    return scored.select(
        "doc_id", "held_out", "score", "predicted", F.size("passages").cast("long").alias("n_passages")
    )


@query
def op8_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


@query
def op9_mcd_outliers(spark, sf_dir):
    return outliers.judge_documents(read_table(spark, sf_dir, "documents"))


@query
def op10_offset_deobfuscation(spark, sf_dir):
    found = pii.find_personal_data(read_table(spark, sf_dir, "documents"))

    def listed(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    counts = [
        F.size(F.filter("base", _of(kind))).cast("long").alias(f"n_{kind}")
        for kind in pii.KINDS
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


@query
def op11_shifted_cholesky_whitening(spark, sf_dir):
    white = whitening.whiten(read_table(spark, sf_dir, "embeddings"))
    return white.withColumn("deviation", F.col("deviation").cast("long"))


@query
def op12_warc_transactions(spark, sf_dir):
    archive = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(read_table(spark, sf_dir, "pages"), archive)
    captures = settle(warc.assemble(warc.read_archive(spark, archive)))
    discard(spark, archive)
    return warc.referred(captures, "page_id").select(
        F.element_at("metadata.fields", "page_id").cast("long").alias("page_id"),
        "response.payload_bytes",
        "response.payload_digest",
        F.col("type").alias("record_type"),
        F.col("referred").cast("long").alias("refers_to"),
    )


@query
def op13_quotient_filter_collocations(spark, sf_dir):
    return collocations.collocations(read_table(spark, sf_dir, "documents"))
