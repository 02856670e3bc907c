"""The split of labelled documents, shared by the classifiers."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.words import U, Words, blocks, lean, mix, shingles, utf8

#: At most so many labelled rows train a classifier; which, a hash of their ids decides.
SAMPLE = 20_000

#: Documents are of one family if so many of so many min-hashes of five-word shingles agree.
AGREE, HASHES = 6, 16


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_sample(labels: DataFrame, column: str, bound: int = SAMPLE) -> DataFrame:
    """doc_id, label of at most ``bound`` rows that are not held out.  Rows without id or label are left out; of several labels of a document the largest counts."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def with_labels(docs: DataFrame, labels: DataFrame, column: str, bound: int = SAMPLE) -> DataFrame:
    """doc_id, text, label of the sampled rows; the sample's bound makes its broadcast safe."""
    sample = training_sample(labels, column, bound).withColumnRenamed("doc_id", "labelled_id")
    return docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("labelled_id")).select("doc_id", "text", "label")


def _signatures(batches):
    for block in blocks(batches):
        sets = shingles(Words([utf8(x) for x in block["text"]]), 5)
        out = np.zeros((len(sets), HASHES), U)
        for i, keys in enumerate(sets):
            if len(keys):
                out[i] = [mix(keys ^ U(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)).min() for k in range(HASHES)]
        yield pd.DataFrame({"doc_id": block["doc_id"], "signature": [r.tobytes() for r in out]})


def family_heads(signatures: np.ndarray) -> np.ndarray:
    """Rows that stay: of rows that agree with an earlier one in AGREE hashes only the earlier; candidates share at least one hash."""
    head = np.arange(len(signatures))
    for k in range(HASHES):
        _, group = np.unique(signatures[:, k], return_inverse=True)
        least = np.full(group.max(initial=0) + 1, len(signatures))
        np.minimum.at(least, group, np.arange(len(signatures)))
        other = least[group]
        same = (signatures == signatures[other]).sum(axis=1) >= AGREE
        head = np.where(same, np.minimum(head, head[other]), head)
    return np.flatnonzero(head == np.arange(len(signatures)))


def one_per_family(sample: DataFrame) -> DataFrame:
    """The labelled sample without near copies.  Its size is bounded, and so are the signatures that the driver sees and the ids that are broadcast."""
    rows = sample.mapInPandas(lean(_signatures), "doc_id long, signature binary").toPandas().sort_values("doc_id")
    signatures = np.array([np.frombuffer(x, U) for x in rows["signature"]], U).reshape(len(rows), HASHES)
    kept = pa.table({"kept_id": pa.array(rows["doc_id"].to_numpy(np.int64)[family_heads(signatures)], pa.int64())})
    ids = sample.sparkSession.createDataFrame(kept).distinct()  # rows of Python would start workers of another kind, which stay
    return sample.join(F.broadcast(ids), F.col("doc_id") == F.col("kept_id"), "left_semi")
