"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words, and so a rate r = target / size at which
its documents are to be taken.  Of each document floor(r) whole copies are
certain.  The rest f = r - floor(r) is a sample of unequal probabilities: the
inclusion odds of a document are f / (1 - f), times its size over the mean
size of its class.  Classes (eight to a doubling of the size) are the strata;
in each the documents are ranked by their random odds u / (1 - u) over their
inclusion odds, and a fixed number of them, the lowest ranks, is taken.  u
comes from the document's id alone, so that reruns agree.

The numbers are fixed before any draw: from the class of the longest documents
down, each takes as many as the words that are still to be taken call for, and
what rounding leaves goes to the next class.  So a source's words come near
its target, and only the draw within classes is left to chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tessella.plans.rank import with_rank, with_running_sums
from tessella.plans.store import Scratch

WORD = r"[^\x20\x09-\x0D]+"
LEVELS, FANOUT = 2, 1024
U_BITS = 52


def size_of(text: str = "text") -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def class_of(size: str = "size") -> Column:
    """The stratum of a size: its number of binary digits and the three digits after the first."""
    return F.expr(f"length(bin({size})) * 8 + cast(shiftright({size}, greatest(length(bin({size})) - 4, 0)) & 7 as int)")


def draw(key: str) -> Column:
    """u as an integer of 52 bits, from a digest of the id; a null id has its own."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null"))), 1, 13), 16, 10).cast("long")


def random_odds(u: Column) -> Column:
    """u / (1 - u) of the middle of u's interval."""
    return (u + F.lit(0.5)) / (F.lit(2.0**U_BITS) - u - F.lit(0.5))


def inclusion_odds() -> Column:
    """f / (1 - f) times the size over the mean size of the class."""
    return F.try_divide(F.col("f") / (1 - F.col("f")) * (F.col("size") * F.col("n")), F.col("words"))


def targets(sources: DataFrame, most: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """source, source_size -> with weight and target.

    Sources by code point, null last, weigh 1, 2, 3, repeating.  Targets share
    the total of the sizes by weight; those above ``most`` times the source's
    size stop there and the excess is shared again among the others, until
    none is above.  In the order of size over weight those that stop come
    first, so that running sums, dealt by range, give the rate of the others
    for each possible end of them; three numbers go to the driver.
    """
    scratch = scratch or Scratch(sources.sparkSession, "mixing")
    table = with_rank(sources, F.col("source").isNull(), "source", name="k", scratch=scratch)
    table = scratch.keep(table.withColumn("weight", (F.col("k") % 3 + 1).cast("long")))
    total, weights = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    order = (F.col("source_size") / F.col("weight"), "k")
    sums = with_running_sums(table, {"size_upto": "source_size", "weight_upto": "weight"}, *order, scratch=scratch)
    held = (F.col("size_upto") - F.col("source_size")) * most
    rate = (F.lit(float(total)) - held) / (F.lit(weights) - F.col("weight_upto") + F.col("weight"))
    fits = sums.select("source_size", "weight", "k", rate.alias("rate")).where(F.col("rate") * F.col("weight") <= F.lit(float(most)) * F.col("source_size"))
    found = fits.agg(F.min_by("rate", F.struct(F.col("source_size") / F.col("weight"), "k"))).first()[0]
    share = F.lit(float(found or 0.0)) * F.col("weight")
    return table.withColumn("target", F.least(share, F.lit(float(most)) * F.col("source_size"))).drop("k")


def mix(docs: DataFrame, most: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (= copies * size).

    A null text has size 0 and is never in the sample; its copies are the
    certain ones.  A null source is a source.  Ties of the ranks go to the
    doc_id that comes first as text; of repeated rows (equal doc_id and size) as many are taken
    as the sample has room for.  Other columns are ignored, whatever their
    names.  A table without words takes nothing; an empty table gives an empty
    table.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = scratch.keep(docs.select("doc_id", "source", size_of().alias("size"), draw("doc_id").alias("u")))
    rows = _copies(sized, _plan(sized, most, scratch), F.lit(0))
    return rows.select("doc_id", "source", "size", "source_size", F.col("target").cast(T.DoubleType()), "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, most: int = 3) -> DataFrame:
    """The documents of :func:`mix`, each as often as it is taken, with the columns of ``docs``; nulls, ties and repeated rows as there.  Texts are not shuffled while the plan is small: it has a row for each source and class."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = scratch.keep(docs.select("doc_id", "source", size_of().alias("size"), draw("doc_id").alias("u")))
    names = [f"`{c}`" for c in docs.columns]
    plan = _plan(sized, most, scratch)
    held = docs.select("doc_id", "source", size_of().alias("size"), draw("doc_id").alias("u"), F.struct(*names).alias("row"))
    rows = _copies(held, plan, F.xxhash64("row.text")).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def strata(sized: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """s, class, n, words, source_size, target, whole, f, and room: how many of the class's documents the sample takes.

    Works on the numbers of documents by source and size.  The expected size
    of a sampled document is its class's mean, weighted by p.
    """
    sizes = scratch.keep(sized.groupBy("source", "size").agg(F.count("*").alias("m")))
    goal = targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size")), most, scratch)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("whole", whole).withColumn("f", F.when(F.col("source_size") > 0, (F.col("target") - F.col("whole") * F.col("source_size")) / F.col("source_size")).otherwise(0.0))
    goal = scratch.keep(goal.withColumnRenamed("source", "s").drop("weight"))
    used = sizes.where("size > 0").withColumn("class", class_of())
    per = used.groupBy(F.col("source").alias("s"), "class").agg(F.sum("m").alias("n"), F.sum(F.col("size") * F.col("m")).alias("words"))
    per = per.alias("p").join(goal.alias("g"), F.col("p.s").eqNullSafe(F.col("g.s"))).select("g.*", "class", "n", "words")
    met = used.join(per.withColumnRenamed("class", "c"), F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")))
    odds = inclusion_odds()
    met = met.withColumn("p", F.col("m") * odds / (1 + odds))
    mean = F.when(F.sum("p") > 0, F.round(F.sum(F.col("p") * F.col("size")) / F.sum("p"), 6)).otherwise(F.first("words") / F.first("n"))
    firsts = [F.first(c).alias(c) for c in ("n", "words", "f")]
    classes = met.groupBy("s", "class").agg(mean.alias("mean"), *firsts)
    # from the longest class down, what rounding leaves going to the next one; a source has some hundred classes at most
    start = F.struct(F.lit(0.0).alias("left"), F.array().cast("array<struct<class:int,n:bigint,words:bigint,room:bigint>>").alias("got"))

    def step(acc: Column, x: Column) -> Column:
        want = acc["left"] + x["f"] * x["words"]
        room = F.least(F.greatest(F.round(want / x["mean"]), F.lit(0.0)), x["n"].cast("double"))
        own = F.struct(x["class"].alias("class"), x["n"].alias("n"), x["words"].alias("words"), room.cast("long").alias("room"))
        return F.struct((want - room * x["mean"]).alias("left"), F.concat(acc["got"], F.array(own)).alias("got"))

    listed = classes.groupBy("s").agg(F.reverse(F.array_sort(F.collect_list(F.struct("class", "n", "words", "mean", "f")))).alias("all"))
    rooms = listed.select("s", F.explode(F.aggregate("all", start, step)["got"]).alias("r")).select(F.col("s").alias("of"), "r.*")
    return goal.join(rooms, F.col("s").eqNullSafe(F.col("of")), "left").drop("of")


def _key() -> Column:
    """What orders the documents of a class: the ratio of odds, then the id; nulls first."""
    return F.struct("q", F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "size")


def _ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with their stratum's plan, the ratio q of random odds to inclusion odds, and the bucket of q on a scale from 0 to 1."""
    met = rows.withColumn("c", F.when(F.col("size") > 0, class_of())).join(plan, F.col("source").eqNullSafe(F.col("s")) & F.col("c").eqNullSafe(F.col("class")), "left").drop("c")
    met = met.withColumn("q", F.try_divide(random_odds(F.col("u")), inclusion_odds()))
    return met.withColumn("bucket", F.floor(F.col("q") / (1 + F.col("q")) * FANOUT**LEVELS).cast("long"))


def _plan(sized: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """The strata, with the last document that each takes: its bucket and key, and how many rows with this key (of how many).

    The last one is found by counts over ranges of q, range within range, each
    step summed on the map side first; only the keys of the last range, about
    one in a million, are ranked one by one.  So a source that holds most rows
    is not gathered in any task.
    """
    rooms = scratch.keep(strata(sized, most, scratch).withColumn("words", F.coalesce("words", F.lit(0)).cast("long")))
    open_ = rooms.where("room > 0 and room < n")
    state = open_.select("s", "class", F.col("room").alias("need"), F.lit(0).cast("long").alias("range"))
    keys = ["s", "class"]
    meets = lambda a, b: F.col(f"{a}.s").eqNullSafe(F.col(f"{b}.s")) & (F.col(f"{a}.class") == F.col(f"{b}.class"))

    def inside(level: int) -> DataFrame:
        ranked = _ranked(sized, open_).where("class is not null").withColumn("at", F.floor(F.col("bucket") / FANOUT ** (LEVELS - level)))
        near = ranked.alias("r").join(state.alias("t"), meets("r", "t") & (F.col("at") == F.col("range")))
        return near.select("r.s", "r.class", "bucket", "need", "range", "q", "doc_id", "size")

    def crossing(counts: DataFrame, *order: str) -> DataFrame:
        upto = W.partitionBy(*keys).orderBy(*order)
        return counts.withColumn("upto", F.sum("m").over(upto)).withColumn("before", F.col("upto") - F.col("m")).where("before < need and need <= upto")

    for level in range(LEVELS):
        at = F.floor(F.col("bucket") / FANOUT ** (LEVELS - level - 1)).cast("long")
        counts = inside(level).groupBy(*keys, at.alias("to")).agg(F.count("*").alias("m"), F.first("need").alias("need"))
        state = scratch.keep(crossing(counts, "to").select(*keys, (F.col("need") - F.col("before")).alias("need"), F.col("to").alias("range")))
    same = inside(LEVELS).groupBy(*keys, _key().alias("last")).agg(F.count("*").alias("m"), F.first("need").alias("need"), F.first("range").alias("range"))
    ends = crossing(same, "last").select(F.col("s").alias("of"), F.col("class").alias("in"), "range", "last", (F.col("need") - F.col("before")).alias("some"), F.col("m").alias("all"))
    return scratch.keep(rooms.join(ends, F.col("s").eqNullSafe(F.col("of")) & (F.col("class") == F.col("in")), "left").drop("of", "in"))


def _copies(rows: DataFrame, plan: DataFrame, among: Column) -> DataFrame:
    """All columns of ``rows`` and of the plan, and copies; ``among`` decides between rows of which not all are taken."""
    goals = plan.select("s", "source_size", "target", "whole").distinct()
    met = _ranked(rows, plan.drop("source_size", "target", "whole").withColumnRenamed("s", "s0").withColumn("s", F.col("s0")).drop("s0"))
    met = met.drop("s").join(goals, F.col("source").eqNullSafe(F.col("s")), "left")
    first = (F.col("bucket") < F.col("range")) | ((F.col("bucket") == F.col("range")) & (_key() < F.col("last")))
    at_end = F.coalesce((F.col("bucket") == F.col("range")) & (_key() == F.col("last")), F.lit(False))
    taken = F.coalesce(F.when(F.col("room") >= F.col("n"), True).when(F.col("room") > 0, first | at_end), F.lit(False))
    copies = lambda sampled: F.col("whole") + sampled.cast("long")
    if plan.where("some < all").isEmpty():
        return met.withColumn("copies", copies(taken))
    split = F.coalesce(F.col("some") < F.col("all"), F.lit(False)) & at_end
    place = F.row_number().over(W.partitionBy("s", "class").orderBy(among))
    one_by_one = met.where(split).withColumn("copies", copies(place <= F.col("some")))
    return met.where(~split).withColumn("copies", copies(taken)).unionByName(one_by_one)
