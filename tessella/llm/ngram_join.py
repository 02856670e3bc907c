"""N-gram Jaccard join by grouped prefixes.

Documents are sets of shingles.  In a total order of shingles, rare ones first,
two sets with a Jaccard similarity of at least t share one of their first
n - ceil(t n) + 1 members, the prefix.  Documents with equal sets collapse into
one class; classes with equal prefixes and sizes into one group; groups that
share a prefix token and whose sizes allow t are candidates; their members are
verified by exact counts.

1. Shingle hashes travel as sorted blocks to the task of their hash range,
   which counts in how many classes each occurs.  The load of the ranges is
   counted before; one that holds a very frequent shingle is dealt over several
   tasks by class, whose counts are then summed.  A shingle of one class links
   nothing; only the others (some 6 % of all) go on, to the task of their
   class's range, which orders them and cuts the prefix.
2. Each prefix token has a pivot group, another one in each of a few rounds.
   All members of the token's other groups are verified against the pivot,
   which links groups of near copies in time linear in their size; linked
   classes form components, within which no more pairs are looked at.
3. What is left are pairs that share a token and lie in different components.
   Tokens of few classes give their pairs; those of many are cut into square
   blocks of bounded size, in which a bound on the overlap from the number of
   shared prefix tokens leaves few pairs.  These are verified too, so that no
   link between different components is missed.

Hashes have 48 bits; two different shingles of a verified pair share one with
a probability of some 1e-9.  Set identities have 64 bits.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.words import U, Words, blocks, lean, lean_group, mix, shingles, tune, utf8
from tessella.operators.stars import star_components
from tessella.plans.store import Scratch

KEY_BITS = 48
PART_KEYS = 1_000_000  # shingles that a counting task holds
FLUSH_KEYS, FLUSH_DOCS = 600_000, 60_000
ROUNDS, FEW, SIDE = 2, 32, 256
BROADCAST_IDS = 1_000_000  # some 20 MB in each executor
NO_ID = (1 << 63) - 1  # what stands for a null id among ids that are compared; nulls are marked beside it
CHUNK_KEYS = 1 << 16  # shingles in a row of a range that is dealt over tasks

SENT = "part long, salt long, base long, keys binary, docs binary, sets binary, ids binary, nulls binary, sizes binary"
CLASS = "set_id long, n long, id long, keys binary, prefix array<long>"


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """The range of a key: equal slices of the key space."""
    return ((keys >> U(16)) * U(parts)) >> U(KEY_BITS - 16)


def _held(batches, k: int):
    """Shingle sets, ids and null marks of some documents at a time."""
    sets: list[np.ndarray] = []
    ids: list[int] = []
    nulls: list[bool] = []
    held = 0
    for block in blocks(batches):
        fresh = shingles(Words([utf8(x) for x in block["text"]]), k)
        sets += fresh
        ids += block["doc_id"].tolist()
        nulls += block["no_id"].tolist()
        held += sum(map(len, fresh))
        if held >= FLUSH_KEYS or len(sets) >= FLUSH_DOCS - 4096:
            yield sets, ids, nulls
            sets, ids, nulls, held = [], [], [], 0
    if sets:
        yield sets, ids, nulls


def _entries(sets: list[np.ndarray], parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Set ids; and of different sets the sorted shingle keys, for each the place of its set, and the set ids by place."""
    with_sum = [int(mix(x).sum()) ^ (len(x) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for x in sets]
    set_ids = np.array(with_sum, U)
    _, first = np.unique(set_ids, return_index=True)  # copies in a block send their set once
    first = np.array([i for i in first if len(sets[i])], np.int64)
    if not len(first):
        return set_ids, np.zeros(0, U), np.zeros(0, np.uint16), np.zeros(0, U)
    keys = np.concatenate([sets[i] >> U(64 - KEY_BITS) for i in first])
    docs = np.repeat(np.arange(len(first), dtype=np.uint16), [len(sets[i]) for i in first])
    order = np.argsort(keys, kind="stable")
    return set_ids, keys[order], docs[order], set_ids[first]


def _loads(k: int, parts: int):
    """How many shingles each range will be sent."""

    def run(batches):
        total = np.zeros(parts, np.int64)
        for sets, _, _ in _held(batches, k):
            total += np.bincount(_part(_entries(sets, parts)[1], parts).astype(np.int64), minlength=parts)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"part": at, "n": total[at]})

    return run


def _salt(sets: np.ndarray, salts: int) -> np.ndarray:
    return mix(sets + U(11)) % U(salts)


def _packed(keys: np.ndarray, docs: np.ndarray, own: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    step = np.diff(keys, prepend=keys[0])
    packed = step.astype("<u4") if int(step.max()) < 1 << 32 else keys
    used, local = np.unique(docs, return_inverse=True)
    return int(keys[0]), packed.tobytes(), local.astype("<u2").tobytes(), own[used].tobytes()


def _send(sets: list[np.ndarray], ids: list[int], nulls: list[bool], parts: int, salts: dict[int, int], split: bool) -> list[tuple]:
    """A block of documents as rows: one with the documents, one per hash range with its shingles; or only those of the ranges that are dealt over salts, if ``split``."""
    set_ids, keys, docs, own = _entries(sets, parts)
    out = []
    if not split:
        where = int(mix(set_ids[:1] + U(len(sets)))[0] >> U(34)) if len(sets) else 0
        sizes = np.array([len(x) for x in sets], np.int64)
        out.append((-1 - where, 0, 0, b"", b"", set_ids.tobytes(), np.array(ids, np.int64).tobytes(), np.array(nulls, np.uint8).tobytes(), sizes.tobytes()))
    edge = np.searchsorted(_part(keys, parts), np.arange(parts + 1, dtype=U))
    for p in np.flatnonzero(np.diff(edge)).tolist():
        a, b = int(edge[p]), int(edge[p + 1])
        if (p in salts) != split:
            continue
        if not split:
            out.append((p, 0, *_packed(keys[a:b], docs[a:b], own), b"", b"", b""))
            continue
        salt = _salt(own, salts[p])[docs[a:b]]
        for s in np.unique(salt).tolist():
            mine = salt == s
            out.append((p, s, *_packed(keys[a:b][mine], docs[a:b][mine], own), b"", b"", b""))
    return out


def _sender(k: int, parts: int, salts: dict[int, int], split: bool):
    names = [x.split()[0] for x in SENT.split(",")]

    def run(batches):
        for sets, ids, nulls in _held(batches, k):
            yield pd.DataFrame(_send(sets, ids, nulls, parts, salts, split), columns=names)

    return run


def _unpack(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and set ids of the shingles that came to one range."""
    keys, owners = [], []
    for base, packed, docs, own in zip(rows["base"], rows["keys"], rows["docs"], rows["sets"], strict=True):
        local = np.frombuffer(docs, "<u2")
        if len(packed) == 8 * len(local):
            keys.append(np.frombuffer(packed, "<u8"))
        else:
            keys.append(np.cumsum(np.frombuffer(packed, "<u4"), dtype=U) + U(base))
        owners.append(np.frombuffer(own, "<u8")[local])
    return np.concatenate(keys), np.concatenate(owners)


COUNTED = "bucket long, sets binary, lens binary, keys binary, counts binary, ids binary, nulls binary, sizes binary"


def _by_bucket(keys: np.ndarray, owners: np.ndarray, counts: np.ndarray, buckets: int) -> pd.DataFrame:
    """Shingles with their counts as rows for the ranges of their sets."""
    bucket = (owners >> U(32)) * U(buckets) >> U(32)
    order = np.lexsort((owners, bucket))
    keys, owners, counts, bucket = keys[order], owners[order], counts[order], bucket[order]
    edge = np.searchsorted(bucket, np.arange(buckets + 1, dtype=U))
    out = []
    for b in np.flatnonzero(np.diff(edge)).tolist():
        s = slice(int(edge[b]), int(edge[b + 1]))
        own, lens = np.unique(owners[s], return_counts=True)
        out.append((b, own.tobytes(), lens.astype("<u4").tobytes(), keys[s].tobytes(), counts[s].astype("<u4").tobytes(), b"", b"", b""))
    return pd.DataFrame(out, columns=[x.split()[0] for x in COUNTED.split(",")])


def _single(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One entry for each key and set, in order."""
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    keep = np.r_[True, (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])] if len(keys) else np.zeros(0, bool)
    return keys[keep], owners[keep]


SPLIT = "part long, salt long, keys binary, owners binary"


def _gather(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The entries of one salt of a range, each once, in rows of bounded size."""
    keys, owners = _single(*_unpack(rows))
    cut = range(0, len(keys), CHUNK_KEYS)
    return pd.DataFrame([(key[0], key[1], keys[a : a + CHUNK_KEYS].tobytes(), owners[a : a + CHUNK_KEYS].tobytes()) for a in cut], columns=["part", "salt", "keys", "owners"])


def _partial(batches):
    """Counts of the keys of a row."""
    for batch in batches:
        out = []
        for part, raw in zip(batch["part"], batch["keys"], strict=True):
            keys, n = np.unique(np.frombuffer(raw, "<u8"), return_counts=True)
            out.append((part, keys.tobytes(), n.astype("<u8").tobytes()))
        yield pd.DataFrame(out, columns=["part", "keys", "counts"])


def _summed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The keys of a range that more than one class has, with their counts."""
    keys = np.concatenate([np.frombuffer(x, "<u8") for x in rows["keys"]])
    n = np.concatenate([np.frombuffer(x, "<u8") for x in rows["counts"]]).astype(np.int64)
    keys, at = np.unique(keys, return_inverse=True)
    total = np.bincount(at, n).astype(np.int64)
    many = total > 1
    return pd.DataFrame([(key[0], keys[many].tobytes(), np.minimum(total[many], (1 << 32) - 1).astype("<u4").tobytes())], columns=["part", "common", "counts"])


def _counted_again(buckets: int):
    def run(batches):
        for batch in batches:
            for raw, own, common, counts in zip(batch["keys"], batch["owners"], batch["common"], batch["counts"], strict=True):
                keys, owners = np.frombuffer(raw, "<u8"), np.frombuffer(own, "<u8")
                known, n = np.frombuffer(common, "<u8"), np.frombuffer(counts, "<u4")
                at = np.searchsorted(known, keys)
                hit = at < len(known)
                hit[hit] = known[at[hit]] == keys[hit]
                yield _by_bucket(keys[hit], owners[hit], n[at[hit]], buckets)

    return run


def _frequent(docs: DataFrame, k: int, parts: int, salts: dict[int, int], buckets: int, scratch: Scratch) -> DataFrame:
    """What :func:`_counter` gives, for the ranges that are dealt over salts: no task holds more than one salt's entries, or one range's different keys."""
    sent = docs.mapInPandas(lean(_sender(k, parts, salts, True)), SENT).repartition(sum(salts.values()), "part", "salt")
    held = scratch.keep(sent.groupBy("part", "salt").applyInPandas(lean_group(_gather), SPLIT))
    counts = held.select("part", "keys").mapInPandas(lean(_partial), "part long, keys binary, counts binary")
    common = counts.repartition(len(salts), "part").groupBy("part").applyInPandas(lean_group(_summed), "part long, common binary, counts binary")
    spark = docs.sparkSession
    many = spark.createDataFrame(pa.table({"part": pa.array(salts.keys(), pa.int64()), "salts": pa.array(salts.values(), pa.int64())}))
    each = scratch.keep(common).join(F.broadcast(many), "part").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    return held.join(each.hint("shuffle_hash"), ["part", "salt"]).select("keys", "owners", "common", "counts").mapInPandas(lean(_counted_again(buckets)), COUNTED)


def _counter(buckets: int):
    names = [x.split()[0] for x in COUNTED.split(",")]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            out = [(-1, s, b"", b"", b"", i, z, n) for s, i, z, n in zip(rows["sets"], rows["ids"], rows["nulls"], rows["sizes"], strict=True)]
            return pd.DataFrame(out, columns=names)
        keys, owners = _unpack(rows)
        order = np.argsort(keys, kind="stable")
        keys, owners = keys[order], owners[order]
        new = np.r_[True, keys[1:] != keys[:-1]]
        many = ~(new & np.r_[new[1:], True])
        keys, owners = _single(keys[many], owners[many])
        if not len(keys):
            return pd.DataFrame([], columns=names)
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        counts = np.diff(np.r_[start, len(keys)])
        counts = np.repeat(counts, counts)
        common = counts > 1
        return _by_bucket(keys[common], owners[common], counts[common], buckets)

    return run


def _classes_of(buckets: int):
    """Documents of a block, once for each set, dealt to the ranges of the set ids."""
    names = [x.split()[0] for x in COUNTED.split(",")]

    def run(batches):
        for batch in batches:
            out = []
            for s, i, n in zip(batch["sets"], batch["ids"], batch["sizes"], strict=True):
                sets, ids, sizes = np.frombuffer(s, "<u8"), np.frombuffer(i, "<i8"), np.frombuffer(n, "<i8")
                order = np.lexsort((ids, sets))
                order = order[np.r_[True, sets[order][1:] != sets[order][:-1]]] if len(order) else order
                order = order[sizes[order] > 0]
                bucket = (sets[order] >> U(32)) * U(buckets) >> U(32)
                for b in np.unique(bucket).tolist():
                    own = order[bucket == b]
                    out.append((b, sets[own].tobytes(), b"", b"", b"", ids[own].tobytes(), b"", sizes[own].tobytes()))
            yield pd.DataFrame(out, columns=names)

    return run


def _cutter(num: int, den: int):
    names = [x.split()[0] for x in CLASS.split(",")]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        classes, tokens = rows[rows["ids"].str.len() > 0], rows[rows["lens"].str.len() > 0]
        cat = lambda column, kind: np.concatenate([np.frombuffer(x, kind) for x in column] or [np.zeros(0, kind)])
        sets, ids, sizes = cat(classes["sets"], "<u8"), cat(classes["ids"], "<i8"), cat(classes["sizes"], "<i8")
        order = np.lexsort((ids, sets))
        order = order[np.r_[True, sets[order][1:] != sets[order][:-1]]] if len(order) else order
        sets, ids, sizes = sets[order], ids[order], sizes[order]
        owners = np.repeat(cat(tokens["sets"], "<u8"), cat(tokens["lens"], "<u4"))
        keys, counts = cat(tokens["keys"], "<u8"), cat(tokens["counts"], "<u4")
        order = np.lexsort((keys, counts, owners))
        owners, keys = owners[order], keys[order]
        lo, hi = np.searchsorted(owners, sets), np.searchsorted(owners, sets, side="right")
        length = sizes + 1 - -(-num * sizes // den)
        cut = np.maximum(0, length - (sizes - (hi - lo)))  # shingles of this set alone come first
        out = []
        for i, (a, b, c) in enumerate(zip(lo.tolist(), hi.tolist(), cut.tolist(), strict=True)):
            some = c > 0
            out.append((np.int64(sets[i].view(np.int64)), sizes[i], ids[i], np.sort(keys[a:b]).tobytes() if some else None, keys[a : a + c].astype(np.int64).tolist() if some else []))
        return pd.DataFrame(out, columns=names)

    return run


def _sizes_fit(a: Column, b: Column, num: int, den: int) -> Column:
    return F.least(a, b) * den >= F.greatest(a, b) * num


def _size_class(n: Column, num: int, den: int) -> Column:
    """Classes such that sizes of a pair that may link are of the same or of neighbouring ones; a little wider than the ratio, for rounding."""
    return F.floor(F.log(n.cast("double")) / (math.log(den / num) + 1e-6)).cast("long") if num < den else n


def _verify(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (x, y) whose sets have a Jaccard similarity of at least num / den."""
    left = classes.select(F.col("set_id").alias("x"), F.col("n").alias("nx"), F.col("keys").alias("kx"))
    right = classes.select(F.col("set_id").alias("y"), F.col("n").alias("ny"), F.col("keys").alias("ky"))

    def run(batches):
        for batch in batches:
            ok = []
            for nx, ny, kx, ky in zip(batch["nx"], batch["ny"], batch["kx"], batch["ky"], strict=True):
                a, b = np.frombuffer(kx, "<u8"), np.frombuffer(ky, "<u8")
                both = np.concatenate((a, b))
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(den * shared >= num * (nx + ny - shared))
            yield batch.loc[ok, ["x", "y"]]

    return pairs.join(left, "x").join(right, "y").select("x", "y", "nx", "ny", "kx", "ky").mapInPandas(lean(run), "x long, y long")


def _in_blocks(num: int, den: int):
    """Pairs of two blocks of classes that share a prefix token, may overlap enough, and lie in different components."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows["side"] == 0], rows[rows["side"] == 1]
        names = {t: i for i, t in enumerate({t for p in rows["prefix"] for t in p})}

        def grid(part):
            out = np.zeros((len(part), len(names)), np.float32)
            for i, p in enumerate(part["prefix"]):
                out[i, [names[t] for t in p]] = 1
            return out

        shared = grid(a) @ grid(b).T
        na, nb = a["n"].to_numpy(np.int64)[:, None], b["n"].to_numpy(np.int64)[None, :]
        need = -(-num * (na + nb) // (num + den))
        most = shared + np.maximum(-(-num * na // den), -(-num * nb // den)) - 1
        ok = (most >= need) & (a["label"].to_numpy()[:, None] != b["label"].to_numpy()[None, :])
        ok &= np.minimum(na, nb) * den >= np.maximum(na, nb) * num
        x, y = a["set_id"].to_numpy()[:, None], b["set_id"].to_numpy()[None, :]
        i, j = np.nonzero(ok & (x != y))
        xs, ys = x[i, 0], y[0, j]
        return pd.DataFrame({"x": np.minimum(xs, ys), "y": np.maximum(xs, ys)})

    return run


def _merged(labels: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """id, label of all classes that ``links`` or earlier links join."""
    edges = links.select(F.col("x").alias("src"), F.col("y").alias("dst"))
    if labels is not None:
        edges = edges.unionByName(labels.select(F.col("id").alias("src"), F.col("label").alias("dst")))
    return scratch.keep(star_components(edges, scratch))


def _pivot_rounds(classes: DataFrame, grouped: DataFrame, scratch: Scratch, num: int, den: int) -> DataFrame:
    """Components by pivots: in each round every token whose groups are not all in one component gets another pivot group, and the members of its other groups are verified against the pivot's head.  Ends with a round that finds no link, or after ROUNDS."""
    heads = classes.join(grouped.where("set_id = head").select("set_id"), "set_id")
    tokens = scratch.keep(heads.select(F.explode("prefix").alias("token"), F.col("set_id").alias("head"), "n", F.size("prefix").alias("shared")))
    members, labels = grouped.withColumn("label", F.col("set_id")), None
    for turn in range(ROUNDS):
        own = members.where("set_id = head").select("head", "label")
        now = tokens.join(own, "head") if turn else tokens.withColumn("label", F.col("head"))
        # first the group with most shared prefix tokens: the text that the others were copied from has no shingle of its own
        order = F.struct("shared", "head") if not turn else F.struct(F.xxhash64("head", F.lit(turn)))
        pivot = F.struct(F.col("head").alias("pivot"), F.col("n").alias("pn"), F.col("label").alias("pl"))
        pivots = now.groupBy("token").agg(F.max_by(pivot, order).alias("p"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token", "p.*")
        pairs = now.join(pivots, "token").where((F.col("head") != F.col("pivot")) & _sizes_fit(F.col("n"), F.col("pn"), num, den)).select("pivot", "pl", "head").distinct()
        pairs = pairs.join(members.select("head", "set_id", "label"), "head").where("label <> pl").select(F.col("pivot").alias("x"), F.col("set_id").alias("y"))
        if not turn:  # members of a group that have not its head's label yet
            pairs = pairs.unionByName(members.where("set_id <> head").select(F.col("head").alias("x"), F.col("set_id").alias("y")))
        links = scratch.keep(_verify(pairs, classes, num, den))
        if turn and links.isEmpty():
            break
        labels = _merged(labels, links, scratch)
        members = scratch.keep(grouped.join(labels.withColumnRenamed("id", "set_id"), "set_id", "left").select("set_id", "n", "head", F.coalesce("label", "set_id").alias("label")))
    return labels


def _left_over(classes: DataFrame, labels: DataFrame, scratch: Scratch, num: int, den: int) -> DataFrame:
    """Candidate pairs of different components, each once."""
    own = classes.join(labels.withColumnRenamed("id", "set_id"), "set_id", "left").select("set_id", "n", "prefix", F.coalesce("label", "set_id").alias("label"))
    own = scratch.keep(own)
    tokens = own.select(F.explode("prefix").alias("token"), "set_id", "n", "label")
    spread = tokens.groupBy("token").agg(F.count("*").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token", "m")
    open_ = scratch.keep(tokens.join(spread, "token"))
    few = open_.where(F.col("m") <= FEW)
    a, b = few.alias("a"), few.alias("b")
    pairs = a.join(b, F.col("a.token") == F.col("b.token")).where((F.col("a.set_id") < F.col("b.set_id")) & (F.col("a.label") != F.col("b.label")) & _sizes_fit(F.col("a.n"), F.col("b.n"), num, den))
    pairs = pairs.select(F.col("a.set_id").alias("x"), F.col("b.set_id").alias("y"))
    # blocks hold one class of sizes, and only those of the same or the next class meet: all others differ too much to link
    many = open_.where(F.col("m") > FEW).join(own.select("set_id", "prefix"), "set_id").withColumn("c", _size_class(F.col("n"), num, den))
    sides = many.groupBy("token", "c").agg(F.ceil(F.count("*") / SIDE).cast("long").alias("sides"))
    many = scratch.keep(many.join(sides, ["token", "c"]).withColumn("at", F.pmod(F.xxhash64("set_id", F.lit(3)), F.col("sides"))))
    zero = F.lit(0).cast("long")
    within = many.withColumn("other", F.explode(F.sequence(zero, F.col("sides") - 1)))
    # a pair of different blocks has one side each; a block with itself has both
    facing = F.when(F.col("at") == F.col("other"), F.array(F.lit(0), F.lit(1))).when(F.col("at") < F.col("other"), F.array(F.lit(0))).otherwise(F.array(F.lit(1)))
    columns = ["set_id", "n", "label", "prefix"]
    within = within.withColumn("side", F.explode(facing)).select("token", "c", F.lit(False).alias("next"), F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "side", *columns)
    above = sides.select("token", (F.col("c") - 1).alias("c"), F.col("sides").alias("others"))
    below = sides.select("token", (F.col("c") + 1).alias("c"), F.col("sides").alias("others"))
    lower = many.join(above, ["token", "c"]).withColumn("other", F.explode(F.sequence(zero, F.col("others") - 1))).select("token", "c", F.lit(True).alias("next"), F.col("at").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"), *columns)
    upper = many.join(below, ["token", "c"]).withColumn("other", F.explode(F.sequence(zero, F.col("others") - 1))).select("token", (F.col("c") - 1).alias("c"), F.lit(True).alias("next"), F.col("other").alias("i"), F.col("at").alias("j"), F.lit(1).alias("side"), *columns)
    square = within.unionByName(lower).unionByName(upper)
    pairs_many = square.groupBy("token", "c", "next", "i", "j").applyInPandas(lean_group(_in_blocks(num, den)), "x long, y long")
    return pairs.unionByName(pairs_many).distinct()


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, text -> doc_id, n_shingles, component_id.

    Two documents link when their sets of ``k``-word shingles have a Jaccard
    similarity of at least num/den; component_id is the least doc_id that links
    reach.  Texts without words and null texts have empty sets and are linked
    with nothing; with fewer than ``k`` words the sequence is one shingle.
    Documents with a null doc_id link others, but name no component unless it
    has no other id (then null).  Repeated rows give repeated rows; other
    columns are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "ngram")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, round(chars / 6 / PART_KEYS))
    buckets = max(1, parts // 2)
    known = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text")
    loads = known.mapInPandas(lean(_loads(k, parts)), "part long, n long").groupBy("part").agg(F.sum("n").alias("n"))
    salts = {r["part"]: -(-r["n"] // PART_KEYS) for r in loads.where(F.col("n") > 4 * PART_KEYS).collect()}  # at most a quarter of the ranges
    sent = known.mapInPandas(lean(_sender(k, parts, salts, False)), SENT)
    # some ranges to a task, one after the other, whatever the session's number of partitions
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = sent.repartition(max(-(-parts // 4), least), "part")
    counted = scratch.keep(sent.groupBy("part").applyInPandas(lean_group(_counter(buckets)), COUNTED))
    blocks_, tokens = counted.where("bucket < 0"), counted.where("bucket >= 0")
    if salts:
        tokens = tokens.unionByName(_frequent(known, k, parts, salts, buckets, scratch))
    members = scratch.keep(blocks_.mapInPandas(lean(_members), "doc_id long, no_id boolean, n_shingles long, set_id long"))
    both = tokens.unionByName(blocks_.mapInPandas(lean(_classes_of(buckets)), COUNTED)).repartition(max(-(-buckets // 4), least), "bucket")
    classes = scratch.keep(both.groupBy("bucket").applyInPandas(lean_group(_cutter(num, den)), CLASS))
    linkable = classes.where("keys is not null")
    # groups: equal prefix and size
    shape = linkable.select("set_id", "n", F.md5(F.to_json(F.struct("prefix", "n"))).alias("shape"))
    heads = shape.groupBy("shape").agg(F.min("set_id").alias("head"))
    grouped = scratch.keep(shape.join(heads, "shape").select("set_id", "n", "head"))
    labels = _pivot_rounds(linkable, grouped, scratch, num, den)
    late = scratch.keep(_verify(_left_over(linkable, labels, scratch, num, den), linkable, num, den))
    if not late.isEmpty():
        labels = _merged(labels, late, scratch)
    labelled = classes.select("set_id", "id").join(labels.withColumnRenamed("id", "set_id"), "set_id", "left").select("set_id", "id", F.coalesce("label", "set_id").alias("label"))
    labelled = scratch.keep(labelled)
    least = labelled.groupBy("label").agg(F.min("id").alias("component_id"))
    final = scratch.keep(labelled.join(least, "label").select("set_id", "label", "component_id"))
    # NO_ID is the greatest id: a component of that name has no id, unless a document of it has this very one
    greatest = scratch.keep(members.where(F.col("doc_id") == F.lit(NO_ID)).where("not no_id").select("set_id").distinct().join(final.where(F.col("component_id") == F.lit(NO_ID)), "set_id").select("label").distinct())
    named = F.col("component_id") != F.lit(NO_ID)
    if not greatest.isEmpty():
        final = final.join(greatest.withColumn("real", F.lit(True)), "label", "left")
        named = named | F.coalesce("real", F.lit(False))
    out = members.join(final.select("set_id", F.when(named, F.col("component_id")).alias("component_id")), "set_id", "left")
    scratch.drop(counted)
    doc_id = F.when(~F.col("no_id"), F.col("doc_id"))
    return out.select(doc_id.alias("doc_id"), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(doc_id).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents without near duplicates: of each component the one with the least doc_id stays, with all columns.

    Documents with a null id stay.  A row repeated with the same id and text
    stays once.
    """
    scratch = Scratch(docs.sparkSession, "distinct")
    found = scratch.keep(jaccard_components(docs, k, num, den).where("doc_id is not null"))
    gone = scratch.keep(found.where("component_id <> doc_id").select("doc_id").distinct())
    small = gone.count() <= BROADCAST_IDS  # then no text is shuffled; else the join deals both sides by id
    kept = docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(*docs.columns)
    twice = found.where("component_id = doc_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return kept
    twice = scratch.keep(twice)
    return kept.join(twice, "doc_id", "left_anti").unionByName(kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])).select(*docs.columns)


def _members(batches):
    for batch in batches:
        for s, i, z, n in zip(batch["sets"], batch["ids"], batch["nulls"], batch["sizes"], strict=True):
            yield pd.DataFrame({"doc_id": np.frombuffer(i, "<i8"), "no_id": np.frombuffer(z, np.uint8).astype(bool), "n_shingles": np.frombuffer(n, "<i8"), "set_id": np.frombuffer(s, "<i8")})
