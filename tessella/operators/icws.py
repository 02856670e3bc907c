"""Consistent weighted min-hashes of weighted sets, and the pairs that they band together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.reducers import uniform
from tessella.operators.stars import star_components
from tessella.plans.store import Scratch

#: Hashes that one pass over the elements takes.
TOGETHER = 16
#: Bands up to which links are counted over all sets of bands.
FEW_BANDS = 8


def cantor_pair(a: Column, b: Column) -> Column:
    """A number for each pair of natural numbers."""
    s = a + b
    return F.floor(s * (s + 1) / 2).cast("long") + b


def sets_from_offsets(spark, offsets: list[int], elements: list[int], weights: list[float]) -> DataFrame:
    """set_id, elt, weight from where each set begins; a last offset at the end of the elements is no set."""
    ends = [*offsets[1:], len(elements)]
    rows = [(i, int(elements[j]), float(weights[j])) for i, (a, b) in enumerate(zip(offsets, ends, strict=True)) for j in range(a, b)]
    return spark.createDataFrame(rows, "set_id long, elt long, weight double")


def minhash(sets: DataFrame, hashes: int, seed: int = 0, zbit: bool = False, draw: Callable[..., Column] = uniform, gathered: bool = False) -> DataFrame:
    """set_id, hash, elt[, t]: for each hash the element of least key (Ioffe, 2010).

    The chance that two sets agree on a hash is their weighted Jaccard
    similarity.  Random numbers depend on element and hash alone; a gamma
    variable of shape 2 is minus the logarithm of a product of two uniforms.
    Elements without positive weight are left out.

    Elements move once, to their set; ``gathered`` says that they lie there
    already (a table repartitioned by set_id), and then none moves.  The hashes
    are aggregates side by side, ``TOGETHER`` in a pass over the elements, so
    that an element is not repeated for each of them.
    """
    each = sets.where("weight > 0").select("set_id", "elt", "weight")
    each = each if gathered else each.repartition("set_id")
    passes = -(-hashes // TOGETHER)
    if passes > 1:
        each = each.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))

    def least(j: int) -> Column:
        h = F.col("pass") * TOGETHER + j if passes > 1 else F.lit(j)
        u = lambda k: draw("elt", h, F.lit(k), seed=seed)
        r, c, beta = -F.log(u(0) * u(1)), -F.log(u(2) * u(3)), u(4)
        t = F.floor(F.log("weight") / r + beta)
        key = F.log(c) - r * (t - beta) - r
        return F.min_by(F.struct("elt", t.cast("long").alias("t")), F.struct(key, F.col("elt")))

    by = ["set_id", *(["pass"] if passes > 1 else [])]
    out = each.groupBy(*by).agg(*[least(j).alias(f"m{j}") for j in range(min(hashes, TOGETHER))])
    rows = F.array(*[F.struct((F.col("pass") * TOGETHER + j if passes > 1 else F.lit(j)).alias("hash"), f"m{j}.elt", f"m{j}.t") for j in range(min(hashes, TOGETHER))])
    return out.select("set_id", F.explode(rows).alias("m")).select("set_id", "m.hash", "m.elt", *([] if zbit else ["m.t"])).where(F.col("hash") < hashes)


def _classes(signatures: DataFrame, rows: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(set_id, head), (head, n, bands): sets that agree on all bands are one class, named by the least of them; bands holds (band, key)."""
    value = F.xxhash64("hash", "elt", *(["t"] if "t" in signatures.columns else []))
    keys = signatures.groupBy("set_id", F.floor(F.col("hash") / rows).cast("int").alias("band")).agg(F.xxhash64(F.array_sort(F.collect_list(value))).alias("key"))
    sets = scratch.keep(keys.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("band", "key"))).alias("bands")))
    classes = scratch.keep(sets.groupBy("bands").agg(F.min("set_id").alias("head"), F.count("*").alias("n")))
    return sets.join(classes, "bands").select("set_id", "head"), classes


def _class_pairs(classes: DataFrame) -> DataFrame:
    """head, other: each two classes that share a band, once; head is the lesser."""
    one = classes.select("head", F.explode("bands").alias("b"))
    return one.join(one.withColumnRenamed("head", "other"), "b").where("head < other").select("head", "other").distinct()


def band_pairs(signatures: DataFrame, rows: int) -> DataFrame:
    """head, set_id: the sets that agree on all hashes of a band.

    Sets that agree on all bands are a class, and give a row for each member
    with the least one.  The least ones of any two classes that share a band
    give a row as well, so that each pair of sets can be told from these rows.
    They are as many as such pairs of classes; :func:`band_links` counts the
    links without making the pairs.
    """
    members, classes = _classes(signatures, rows, Scratch(signatures.sparkSession, "bands"))
    return members.where("head <> set_id").select("head", "set_id").unionByName(_class_pairs(classes).select("head", F.col("other").alias("set_id")))


def band_links(signatures: DataFrame, rows: int) -> DataFrame:
    """set_id, class_id, n_links: for each set the least set reached by links, and with how many others it agrees on all hashes of a band.

    The sets that share at least one band with a set are counted by inclusion
    and exclusion over the sets of bands: as many counts by key as there are
    sets of bands, and no pairs.  Beyond ``FEW_BANDS`` bands the pairs of
    classes are made and counted.
    """
    scratch = Scratch(signatures.sparkSession, "bands")
    members, classes = _classes(signatures, rows, scratch)
    many = classes.agg(F.coalesce(F.max(F.element_at("bands", -1)["band"]), F.lit(-1))).first()[0] + 1
    if many <= FEW_BANDS:
        shared = classes.select("head", "n", F.explode(_subsets(many)).alias("s")).where("size(s.keys) > 0")
        counts = shared.groupBy("s").agg(F.sum("n").alias("all"), F.count("*").alias("classes")).where("classes > 1")
        # a class alone with its keys agrees with its own members only
        own = classes.select("head", (F.col("n") - 1).alias("part"))
        sign = F.when(F.size("s.keys") % 2 == 1, 1).otherwise(-1)
        parts = shared.join(counts, "s").select("head", (sign * (F.col("all") - F.col("n"))).alias("part"))
        links = own.unionByName(parts).groupBy("head").agg(F.sum("part").alias("n_links"))
    else:
        sizes = classes.select(F.col("head").alias("other"), "n")
        pairs = _class_pairs(classes)
        both = pairs.unionByName(pairs.select(F.col("other").alias("head"), F.col("head").alias("other")))
        others = both.join(sizes, "other").groupBy("head").agg(F.sum("n").alias("m"))
        links = classes.join(others, "head", "left").select("head", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"))
    bands = classes.select("head", F.explode("bands").alias("b"))
    hubs = bands.groupBy("b").agg(F.min("head").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = bands.join(hubs, "b").where("hub <> head").select(F.col("hub").alias("src"), F.col("head").alias("dst")).distinct()
    labels = star_components(stars, scratch, spread=True).select(F.col("id").alias("head"), "label")
    named = scratch.keep(links.join(labels, "head", "left").select("head", F.coalesce("label", "head").alias("class_id"), F.col("n_links").cast("long").alias("n_links")))
    return members.join(named, "head").select("set_id", "class_id", "n_links")


def _subsets(many: int) -> Column:
    """For each set of bands its number and the keys there; without keys where one of the bands is missing."""
    at = lambda b: F.filter("bands", lambda x: x["band"] == b)
    found = []
    for mask in range(1, 1 << many):
        mine = [at(b) for b in range(many) if mask >> b & 1]
        keys = F.transform(F.concat(*mine), lambda x: x["key"])
        whole = F.size(keys) == len(mine)
        found.append(F.struct(F.lit(mask).alias("mask"), F.when(whole, keys).otherwise(F.array().cast("array<bigint>")).alias("keys")))
    return F.array(*found) if found else F.array().cast("array<struct<mask:int,keys:array<bigint>>>")
