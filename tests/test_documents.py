"""Folders of documents: one file each, written by the tasks that hold the texts, and read back."""

import os
from collections import Counter
from pathlib import Path

from ticketlake.sources import documents
from ticketlake.sources.documents import read_policy_texts, write_policy_texts


def test_few_folders_and_whole_texts(spark, tmp_path):
    """A folder per task, not per document; what is read back is what stood there, a line feed at its end."""
    texts = [(k, f"línea {k}\n\nfin") for k in range(300)] + [(None, "sin clave"), (300, None), (301, "")]
    rows = spark.createDataFrame(texts, "page_id long, html string").repartition(3)
    write_policy_texts(rows, f"{tmp_path}/p", "page_id")
    files = [f for f in Path(tmp_path, "p").rglob("*") if f.is_file()]
    assert len(files) == len(texts) and len({f.parent for f in files}) <= 3
    assert not [f for f in files if f.name.startswith(".")]
    read = {r["doc_id"].rsplit("/", 1)[-1]: r["text"] for r in read_policy_texts(spark, f"{tmp_path}/p").collect()}
    none = "__HIVE_DEFAULT_PARTITION__"
    assert read == {f"page_id={none if k is None else k}": f"{t or ''}\n" for k, t in texts}


def test_documents_that_share_a_key(spark, tmp_path):
    """As Spark's writer has it: rows of one task share a file, those of two tasks have one each."""
    held = [(1, "a"), (1, "a"), (2, "b")]
    for tasks, found in ((1, 2), (2, 4)):
        name = f"p{tasks}"
        rows = spark.createDataFrame(spark.sparkContext.parallelize(held * tasks, tasks), "page_id long, html string")
        write_policy_texts(rows, f"{tmp_path}/{name}", "page_id")
        rows.write.partitionBy("page_id").text(f"{tmp_path}/{name}-spark")
        ours, theirs = (
            Counter(r["text"] for r in read_policy_texts(spark, f"{tmp_path}/{folder}").collect())
            for folder in (name, f"{name}-spark")
        )
        assert ours == theirs and ours.total() == found


def test_a_task_that_runs_again_writes_the_same_files(spark, tmp_path, monkeypatch):
    class Task:
        attempt = 0

        def partitionId(self):
            return 4

        def taskAttemptId(self):
            return Task.attempt

    monkeypatch.setattr(documents.TaskContext, "get", staticmethod(Task))
    write = documents._files_of_task(str(tmp_path), "k")

    def broken():
        yield "a/b", "x"
        yield "c", "y"
        raise OSError

    try:
        write(broken())
    except OSError:
        Task.attempt = 1
    write(iter([("a/b", "x"), ("c", "y"), ("d", "z")]))
    kept = {f: Path(tmp_path, "tarea-000004", f).read_text() for f in os.listdir(f"{tmp_path}/tarea-000004")}
    assert {f: t for f, t in kept.items() if not f.startswith(".")} == {"k=a%2Fb": "x\n", "k=c": "y\n", "k=d": "z\n"}


def test_small_files_are_read_many_to_a_task(spark, tmp_path):
    for k in range(1500):
        Path(tmp_path, f"{k}.txt").write_text(f"texto {k}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        read = read_policy_texts(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() <= 100
        assert {r["text"] for r in read.collect()} == {f"texto {k}" for k in range(1500)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "32m")
