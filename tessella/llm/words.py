"""Words of whole texts as 64-bit hashes, computed over blocks of documents.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D in the UTF-8
form, after A-Z are lower-cased.  Each word's hash is a sum of its bytes times
random odd numbers that depend on the byte's place, then mixed; two different
words share a hash with a probability of about 2**-56.
"""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans.ship import ship

U = np.uint64
#: Settings of batch sizes, with Spark's defaults.
BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": "4096", "spark.sql.execution.arrow.maxRecordsPerBatch": "10000"}
BLOCK_BYTES = 2 << 20
BLOCK_ROWS = 4096
EVERY_S = 0.2

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_places = np.zeros(0, U)


@lru_cache(maxsize=1)
def _trimmer() -> Callable[[int], int] | None:
    """glibc's function that gives free pages of the heap back, which Arrow uses from now on too; None with another C library."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        pa.set_memory_pool(pa.system_memory_pool())
    return trim


def give_back() -> None:
    """Returns the freed memory of this process to the system."""
    trim = _trimmer()
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """A function over batches for mapInPandas whose worker gives back at a task's end what the task has freed.

    Workers live as long as their executor; one that keeps the most it ever
    used takes that from all later stages.
    """

    def own(batches):
        yield from run(batches)
        give_back()

    return own


def lean_group(run: Callable) -> Callable:
    """The same for a function of key and rows for applyInPandas; after groups that take less than EVERY_S, not after each."""
    last = 0.0

    def own(key, rows):
        nonlocal last
        out = run(key, rows)
        if time.monotonic() - last >= EVERY_S:
            give_back()
            last = time.monotonic()
        return out

    return own


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all others."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def odd_numbers(n: int, seed: int = 0) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=U) + U(seed)) * U(0x9E3779B97F4A7C15)) | U(1)


def utf8(text: str | None, lower: bool = True) -> bytes:
    """A null text counts as empty; lone surrogates keep their three bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.lower() if lower else raw


class Words:
    """The words of a block of texts, in order.

    hash: of each word; first: for each text the index of its first word, and
    at the end the number of words; buf, start, end: where a word's bytes lie.
    """

    def __init__(self, raw: list[bytes]):
        self.buf = b"\n" + b"\n".join(raw) + b"\n"
        data = np.frombuffer(self.buf, np.uint8)
        space = _SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.start, self.end = edge[0::2], edge[1::2]
        at = np.cumsum([1] + [len(x) + 1 for x in raw])
        self.first = np.searchsorted(self.start, at)
        self.hash = self._hash(data)

    def _hash(self, data: np.ndarray) -> np.ndarray:
        global _places
        out = np.empty(len(self.start), U)
        length = self.end - self.start
        if len(length) and len(_places) < length.max():
            _places = odd_numbers(max(4096, int(length.max())), 77)
        step, done = 1 << 18, 0  # bytes; the arrays below need forty times as much
        ends = np.cumsum(length)
        while done < len(out):  # cut between words
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + step)))
            n = length[done:upto]
            from_ = np.cumsum(n) - n
            place = np.arange(int(n.sum())) - np.repeat(from_, n)
            value = data[place + np.repeat(self.start[done:upto], n)].astype(U) + U(1)
            value *= _places[place]
            out[done:upto] = np.add.reduceat(value, from_)
            done = upto
        return mix(out + length.astype(U) * U(0xD6E8FEB86659FD93))

    def text(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]]


def shingles(words: Words, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``k``-word shingles.

    With 1 to k-1 words the whole sequence is one shingle; without words the
    set is empty.
    """
    odd = odd_numbers(k, 1234)
    n = len(words.hash)
    window = np.zeros(max(0, n - k + 1), U)
    for j in range(k):
        window += words.hash[j : n - k + 1 + j] * odd[j] if n >= k else U(0)
    window = mix(window + U(k))
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(window[a : b - k + 1]))
        elif b > a:
            out.append(mix(np.array([(words.hash[a:b] * odd[: b - a]).sum() + U(b - a)], U)))
        else:
            out.append(np.zeros(0, U))
    return out


def blocks(batches: Iterable[pd.DataFrame], text: str = "text", max_bytes: int = BLOCK_BYTES, max_rows: int = BLOCK_ROWS) -> Iterator[pd.DataFrame]:
    """Rows regrouped so that a block's texts have about ``max_bytes`` characters; a longer text is a block of its own."""
    for batch in batches:
        size = batch[text].str.len().fillna(0).to_numpy(dtype=np.int64, na_value=0) if len(batch) else np.zeros(0, np.int64)
        begin, total = 0, 0
        for i, n in enumerate(size.tolist()):
            if i > begin and (total + n > max_bytes or i - begin >= max_rows):
                yield batch.iloc[begin:i]
                begin, total = i, 0
            total += n
        if begin < len(batch):
            yield batch.iloc[begin:]


def given(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, as text, and other columns for a Python function: pandas would turn whole numbers beside nulls into doubles and round large ones."""
    return docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), *columns)


def returned(found: DataFrame) -> DataFrame:
    """The inverse of :func:`given`, for what the function gave back."""
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def tune(spark) -> None:
    """Small batches, of Arrow and of the Parquet reader: a worker then holds few long texts, and a task few wide binary rows, at once.

    Plans read these settings when they run, after an operator has returned,
    so that they stay with the session.  A value that the session was given
    before is not changed.
    """
    ship(spark)
    for name, default in BATCHES.items():
        if spark.conf.get(name) == default:
            spark.conf.set(name, "512")
