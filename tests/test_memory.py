"""Memory of Python workers: what a task has freed goes back to the system."""

import os
import re
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.llm import labelled, ngram_join, words


def resident() -> float:
    return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024


def with_holes(batches):
    """Takes some 120 MB in small pieces and frees all but a few, of which the last lies at the heap's top."""
    for batch in batches:
        taken = [np.zeros(4000) + 1 for _ in range(4000)]
        kept = taken[::400] + taken[-1:]
        taken.clear()
        yield batch
        with_holes.kept = kept


def left(run) -> float:
    """MB more than before a task."""
    before = resident()
    list(run(iter([pd.DataFrame({"x": [1]})])))
    out = resident() - before
    with_holes.kept = None
    words.give_back()
    return out


@pytest.mark.skipif(words._trimmer() is None, reason="another C library")
def test_a_task_gives_back_what_it_freed():
    assert left(with_holes) > 60
    assert left(words.lean(with_holes)) < 30


def test_lean_functions_give_the_same():
    frames = [pd.DataFrame({"x": [i]}) for i in range(3)]
    assert [x["x"][0] for x in words.lean(lambda rows: (r * 2 for r in rows))(iter(frames))] == [0, 2, 4]
    assert words.lean_group(lambda key, rows: rows + key[0])((5,), frames[1])["x"][0] == 6


def test_small_tables_start_no_plain_workers(spark, monkeypatch):
    """Rows of Python given to createDataFrame go through workers of another daemon, beside those that pandas functions use."""
    from pyspark import SparkContext

    def no(*_, **__):
        raise AssertionError("rows were dealt by Python")

    words.tune(spark)
    monkeypatch.setattr(SparkContext, "parallelize", no)
    texts = spark.range(40).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), F.col("id") % 4) for k in range(9)]).alias("text"), F.lit(0).alias("label"))
    assert sorted(r["doc_id"] for r in labelled.one_per_family(texts).collect()) == [0, 1, 2, 3]
    monkeypatch.setattr(ngram_join, "PART_KEYS", 3)
    found = ngram_join.jaccard_components(texts, 5)
    assert {(r["doc_id"], r["component_id"]) for r in found.collect()} == {(i, i % 4) for i in range(40)}
