"""Best-fit packing of token sequences by the sum-of-squares rule."""

from __future__ import annotations

import json
import warnings
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.words import given, lean, lean_group, returned, tune
from tessella.plans.store import Scratch

CAPACITY = 1024
GROUP = 50_000

# Fixed value: the pre-tokenisation pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECES = "doc_id string, piece int, start long, length long, ids_crc32 long"


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for b in range(256):
        if b not in plain:
            out[chr(256 + len(out) - len(plain))] = b
    return out


@lru_cache(maxsize=1)
def exact_encoder(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def encoder(path: str):
    """A function from texts to ids, equal to ``tokenizers`` on the file at ``path``, several times as fast.

    The merges of a byte-level vocabulary are ranked by id, which is all that
    the faster library needs.  Texts that hold the string of a special token,
    and those on which the faster library gives up, go to ``tokenizers``.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [x["content"] for x in spec.get("added_tokens", [])]
    letter = byte_letters()
    ranks = {bytes(letter[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if not any(x in text for x in special):
            try:
                return fast.encode_ordinary(text)
            except (ValueError, RuntimeError) as e:  # a backtracking limit of its pattern engine
                warnings.warn(f"a text of {len(text)} characters goes to the slower tokenizer: {e}", stacklevel=2)
        return exact_encoder(path).encode(text, add_special_tokens=False).ids

    return encode


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids, each document ended by ``end_id``.

    Only longer documents are cut, into pieces of ``capacity`` ids of which the
    first may be shorter.  A null text counts as empty: one piece that holds
    the end id.  Repeated rows give repeated pieces; other columns are ignored.
    """
    tune(docs.sparkSession)

    def cut(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                first = len(ids) % capacity or capacity
                begin = [0, *range(first, len(ids), capacity)]
                for k, (a, b) in enumerate(zip(begin, [*begin[1:], len(ids)], strict=True)):
                    out.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return returned(given(docs, "text").mapInPandas(lean(cut), PIECES))


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY, late: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place of each item, in the given order.

    N(g) is the number of open bins with gap g.  An item goes where the sum of
    N(g)**2 gets smallest: into an open bin of some gap, or into a new one.  Of
    equal choices the smallest gap counts, a new bin last.  Full bins are
    closed and not counted.  ``late``: a new bin is opened only if no open one
    has room.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    used: list[int] = []
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    never = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        # the change of the sum, by the gap from s to capacity - 1
        change = 2 * (count[: capacity - s] - count[s:capacity]) + 2
        gap, least = capacity, never if late else 2 * int(count[capacity - s]) + 1 if s < capacity else 0
        if len(change):
            change[0] -= 1
            change[count[s:capacity] == 0] = never
            k = int(change.argmin())
            if change[k] < never and change[k] <= least:
                gap = s + k
        if gap == capacity:
            b = len(used)
            used.append(0)
        else:
            b = open_bins[gap].pop()
            count[gap] -= 1
        bins[i], places[i] = b, used[b]
        used[b] += s
        if gap > s:
            count[gap - s] += 1
            open_bins[gap - s].append(b)
    return bins, places


def two_passes(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place of each item: all by :func:`sum_of_squares`, then those of the bins that stayed open once more, with new bins late.  Items should come largest first."""
    bins, places = sum_of_squares(lengths, capacity)
    total = np.bincount(bins, lengths, minlength=1).astype(np.int64)
    again = np.flatnonzero(total[bins] < capacity) if len(bins) else np.zeros(0, np.int64)
    more, at = sum_of_squares(lengths[again], capacity, late=True)
    if len(again) and more.max() + 1 < len(np.unique(bins[again])):
        bins[again], places[again] = more + len(total), at
        bins = np.unique(bins, return_inverse=True)[1]
    return bins, places


def pack(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP, scratch: Scratch | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...).

    A piece of full length is a sequence alone.  The others are dealt by hash
    into groups of about ``group`` pieces, so that a task holds a bounded
    number and no document or source decides a group's size; each group is
    packed by :func:`two_passes`, largest first, equal lengths by id and piece;
    what a group leaves open is about one sequence in a thousand.  Repeated
    rows are packed one by one; null ids stay null.  An empty table gives an
    empty table.
    """
    spark = cut.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    cut = scratch.keep(cut)
    full = cut.where(F.col("length") >= capacity)
    rest = cut.where(F.col("length") < capacity)
    groups = max(1, round(rest.count() / group))
    kinds = [f for f in cut.schema.fields]
    schema = ", ".join(f"`{f.name}` {'string' if f.name == 'doc_id' else f.dataType.simpleString()}" for f in kinds) + ", sequence_id long, offset long"

    def fill(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        lengths = rows["length"].to_numpy(np.int64)
        bins, places = two_passes(lengths, capacity)
        rows["sequence_id"], rows["offset"] = bins * groups + key[0], places
        return rows.drop(columns="group")

    dealt = given(rest, *[c for c in rest.columns if c != "doc_id"]).select(*rest.columns).withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)))  # equal rows too are dealt apart
    packed = returned(dealt.groupBy("group").applyInPandas(lean_group(fill), schema))
    alone = full.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(alone)
