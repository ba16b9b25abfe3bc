"""Mixing sources to target weights by capped water-filling.

Sources, by code point with null last, get the weights of ``WEIGHT_CYCLE`` in turn and share the mix, which is as large as
all documents together. No source may give more than ``MAX_EPOCHS`` times its size: sources over that are clamped there, and
the excess is shared again among the others by weight until none is above. A source's target is met by whole repetitions of
all its documents (floor of target / size) and one more of some: documents in the order of a seeded digest, each taken while
less than half of it stands beyond what is missing. So the words taken miss the target by at most half a document, no
document is taken more than MAX_EPOCHS times, and reruns agree. Rows that repeat id, size and digest stand one after the other, and
of such a tie only as many are taken as fit.

Scale: sizes are summed by (source, slot) before any shuffle of rows, where a slot is one of ``16 ** SLOT_DIGITS`` ranges of the digest.
Prefix sums over slots give each source the one slot in which its last document lies; only documents of that slot are ranked
(a source with a third of all rows puts one in 4096 of them there), rows that repeat id and size as one row with their number. Where
the cut falls among such rows, as with many null ids, these alone are numbered, by ranges of their texts' hashes. The water level is found by rounds of
aggregates over the table of sources; only sums and counts reach the driver.

Defined results: a null text has size 0; a null source is a source of its own; documents without words, and sources that
have only those, take 0 words; an empty table gives no rows; other columns, whatever their names, pass through ``mixed`` untouched, and
through ``mix`` but for those that it is asked to write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import columns_of, stored, unused

WEIGHT_CYCLE = (1, 2, 3)
MAX_EPOCHS = 3
#: Hexadecimal digits of the digest that number a slot.
SLOT_DIGITS = 3
SEED = "mix-1"


def ranked(keys: DataFrame, column: str, name: str = "rank") -> DataFrame:
    """``keys`` with the place of each row in ascending order of ``column``, nulls last, from 0, without one task for all rows."""
    spark = keys.sparkSession
    parts = stored(keys.repartitionByRange(F.col(column).asc_nulls_last()).sortWithinPartitions(F.col(column).asc_nulls_last()).withColumn("__part", F.spark_partition_id()), "ranked")
    counts = {r["__part"]: r["n"] for r in parts.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    starts, total = [], 0
    for part in sorted(counts):
        starts.append((part, total))
        total += counts[part]
    if not starts:
        return keys.withColumn(name, F.lit(0).cast("bigint"))
    offsets = spark.createDataFrame(starts, "__part int, __start bigint")
    within = F.row_number().over(Window.partitionBy("__part").orderBy(F.col(column).asc_nulls_last())) - 1
    return parts.join(F.broadcast(offsets), "__part").withColumn(name, (within + F.col("__start")).cast("bigint")).drop("__part", "__start")


def water_fill(sources: DataFrame, budget: int, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``sources`` (size, weight and others) with ``target``: budget * weight / weights, clamped at max_epochs * size."""
    cap, share, clamped, n = F.col("size") * max_epochs, F.lit(0.0), F.lit(False), -1
    while True:
        row = sources.agg(
            F.sum(F.when(~clamped, F.col("weight")).otherwise(0)).alias("weight"),
            F.sum(F.when(clamped, cap).otherwise(0)).alias("capped"),
            F.count(F.when(clamped, 1)).alias("n"),
        ).first()
        if row["n"] == n or not row["weight"]:  # this round clamped nothing more
            return sources.withColumn("target", F.when(clamped, cap).otherwise(share).cast("double"))
        n = row["n"]
        share = F.lit(float(budget - row["capped"])) * F.col("weight") / F.lit(float(row["weight"]))
        clamped = clamped | (share > cap)


def _keyed(docs: DataFrame, seed: str, *more: str) -> DataFrame:
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    own = docs.select(*more, F.col("doc_id").cast("bigint").alias("__id"), F.col("text").cast("string").alias("__text"), F.col("source").cast("string").alias("__source"), digest.alias("__digest"))
    return own.withColumn("__slot", F.conv(F.substring("__digest", 1, SLOT_DIGITS), 16, 10).cast("int"))


def _words() -> Column:
    return F.regexp_count(F.coalesce("__text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def _sized(docs: DataFrame, seed: str) -> DataFrame:
    return _keyed(docs, seed).withColumn("__size", _words())


def plan(docs: DataFrame, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row for each source: __source, size, weight, target, whole (repetitions of all its documents) and the cut, the
    slot and key of the last document that is taken once more. A written table."""
    slots = stored(_sized(docs, seed).groupBy("__source", "__slot").agg(F.sum("__size").alias("words")), "mix-slots")
    sizes = ranked(slots.groupBy("__source").agg(F.sum("words").alias("size")), "__source")
    weight = F.get(F.array(*map(F.lit, WEIGHT_CYCLE)), F.pmod(F.col("rank"), F.lit(len(WEIGHT_CYCLE))).cast("int"))
    sources = stored(sizes.withColumn("weight", weight.cast("bigint")), "mix-sources")
    budget = sources.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    filled = water_fill(sources, budget, max_epochs)
    whole = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("size"))).cast("bigint")
    filled = filled.withColumn("whole", whole).withColumn("missing", F.col("target") - F.col("whole") * F.col("size"))
    sums = slots.withColumn("before", F.sum("words").over(Window.partitionBy("__source").orderBy("__slot")) - F.col("words"))
    met = sums.join(filled.select(F.col("__source").alias("__s"), "missing"), F.col("__source").eqNullSafe(F.col("__s"))).where("before <= missing")
    last = met.groupBy("__source").agg(F.max(F.struct("__slot", "before")).alias("last")).select(F.col("__source").alias("__s"), F.col("last.__slot").alias("slot"), "last.before")
    edges = stored(filled.join(last, F.col("__source").eqNullSafe(F.col("__s")), "left").drop("__s"), "mix-edges")
    # The rows of the slots in which the last documents lie, one by one.
    near = edges.select(F.col("__source").alias("__s"), "missing", "before", "slot")
    rows = _keyed(docs, seed).join(near, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__slot") == F.col("slot")))
    # One row for all that tie in digest, id and size.
    ties = rows.withColumn("__size", _words()).groupBy("__source", "__digest", "__id", "__size", "missing", "before").agg(F.count(F.lit(1)).alias("__n"))
    order = Window.partitionBy("__source").orderBy("__digest", "__id", "__size")
    start = F.col("before") + F.sum(F.col("__size") * F.col("__n")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__size") * F.col("__n")
    room = F.col("missing") - F.col("__start") - F.col("__size") / 2
    fit = F.when(room < 0, F.lit(0)).when(F.col("__size") == 0, F.col("__n")).otherwise(F.least("__n", (F.floor(room / F.col("__size")) + 1).cast("bigint")))
    taken = ties.withColumn("__start", start).withColumn("__fit", fit.cast("bigint")).where("__fit > 0")
    cuts = taken.groupBy("__source").agg(F.max(F.struct("__digest", "__id", "__size", "__n", "__fit")).alias("cut")).withColumnRenamed("__source", "__s")
    return stored(edges.join(cuts, F.col("__source").eqNullSafe(F.col("__s")), "left").drop("__s", "missing", "before"), "mix-plan")


NAMES = ("__size", "__source_size", "__target", "__epochs")


def mix(docs: DataFrame, max_epochs: float = MAX_EPOCHS, seed: str = SEED, names: tuple[str, str, str, str] = NAMES) -> DataFrame:
    """``docs`` with four columns ``names``: the row's size, its source's size and target, and how often the row is taken. Columns of
    the input with these names give way."""
    docs = docs.drop(*names)
    sources = plan(docs, max_epochs, seed).select(F.col("__source").alias("__s"), "size", "target", "whole", "slot", "cut")
    cut = F.struct(*(F.col(f"cut.{c}").alias(c) for c in ("__digest", "__id", "__size")))
    key = F.struct("__digest", "__id", "__size")
    same = (F.col("__slot") == F.col("slot")) & key.eqNullSafe(cut)
    partial = F.col("cut.__fit") < F.col("cut.__n")
    keyed = _keyed(docs.select(F.struct(*columns_of(docs)).alias("__row"), "doc_id", "text", "source"), seed, "__row").withColumn("__size", _words())
    met = keyed.join(sources, F.col("__source").eqNullSafe(F.col("__s")), "left")
    more = (F.col("__slot") < F.col("slot")) | ((F.col("__slot") == F.col("slot")) & ((key < cut) | same))
    tied = F.coalesce(same & partial, F.lit(False))

    def out(rows: DataFrame, once_more: Column) -> DataFrame:
        epochs = F.when(F.col("__size") == 0, F.lit(0)).otherwise(F.col("whole") + F.coalesce(once_more, F.lit(False)).cast("bigint")).cast("bigint")
        return rows.select("__row.*", *(x.alias(name) for x, name in zip((F.col("__size"), F.col("size"), F.col("target"), epochs), names, strict=True)))

    if sources.where(partial).isEmpty():  # no cut falls among equals
        return out(met, more)
    among = met.where(tied).withColumn("__mark", F.struct("__source", F.xxhash64("__text").alias("mark"), F.monotonically_increasing_id().alias("place")))
    among = ranked(among, "__mark", "__rank")
    first = among.groupBy("__source").agg(F.min("__rank").alias("__first")).withColumnRenamed("__source", "__f")
    numbered = among.join(first, F.col("__source").eqNullSafe(F.col("__f")))
    return out(met.where(~tied), more).unionAll(out(numbered, F.col("__rank") - F.col("__first") < F.col("cut.__fit")))


def mixed(docs: DataFrame, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their columns."""
    *names, copy = unused(docs.columns, *NAMES, "__copy")
    epochs = F.col(names[3])
    each = mix(docs, max_epochs, seed, tuple(names)).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("bigint"), F.greatest(epochs, F.lit(1)))))
    return each.where(F.col(copy) <= epochs).select(*columns_of(docs))
