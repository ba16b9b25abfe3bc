"""Quality rules: a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Both corpora are multinomials over ``buckets`` hashed features, the one- and two-word sequences of a text (the last word
pairs with the end of the text). A document's score is the mean, over its features, of log p_target - log p_raw; it is kept
if the score reaches ``threshold``. Every document is judged by the same threshold, which the labelled rows set, so reruns agree.

Nothing is sampled: the raw counts cover every row of the corpus, the target every row labelled good and the threshold every row
labelled good or bad. Labelled ids are packed into blocks of neighbouring ones, so their join moves no texts; where ids lie so far
apart that there are more than ``BROADCAST_BLOCKS`` blocks, Spark chooses how to join. Of the labelled scores the driver gets only
the best cut.

The buckets grow with the target, so that at most ``LOAD`` of its features share one on average: in too few of them prose meets
junk, and all weights drift towards 0. They end at ``MOST_BUCKETS``, as every task holds the weights; beyond, all features count as
before but share buckets more, scores draw nearer to each other, and the threshold moves with them, as labelled rows set it.

A feature's weight compares its target count with the count that its share of the corpus predicts, both raised by
``SMOOTHING``; so rare features weigh little, and the target's size, or the corpus', does not move scores.

Weights are fixed-point numbers (``SCALE``), so sums do not depend on the order of addition. Everything here is DataFrame
expressions: a pass counts the target's features, one explodes features into ``buckets`` counters (partial aggregation leaves at
most ``buckets`` rows a task to shuffle, so ``MERGED`` tasks count in one), one scores labelled rows and the last each row in place,
without any shuffle. Scoring reads the weights from one literal array of 32-bit integers.

Defined results: a null or empty text has no words, fails the base rule and has score 0. With no trusted rows the target
equals the corpus, so every score is 0 and only the base rules reject. Repeated rows are judged alike, a null id is kept as
null, other columns of the input are never read by ``quality_report`` and pass through ``keep_good`` untouched. Where labels do
not tell good from bad rows, ``THRESHOLD`` holds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE_CHARS, let, stored, whole_text, words_of

SCALE = 1_000_000
#: The least and the largest number of buckets, and how many features of the target a bucket may hold on average before they are
#: doubled.
BUCKETS = 1 << 16
MOST_BUCKETS = 1 << 21
LOAD = 16
#: A block holds the labels of 1 << BLOCK_BITS neighbouring ids, in at most 16 KB. This many blocks are broadcast at most.
BLOCK_BITS = 12
BROADCAST_BLOCKS = 20_000
#: How many tasks' rows are counted in one, as long as there are two for each core.
MERGED = 4
#: Bins for each nat of score, within which labelled scores are put in order.
BINS = 1 << 12
#: Nats for each feature. Prose of the trusted kind scores about 0, text made of other words far below.
THRESHOLD = -0.25
SMOOTHING = 1.0
SYMBOLS = "[#*$%&|<>]"


def hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def pairs(h: Column) -> Column:
    """The hash of each two-word sequence; the last word pairs with the end of the text."""
    return F.zip_with(h, F.slice(h, F.lit(2), F.size(h)), lambda x, y: F.xxhash64(x, F.coalesce(y, F.lit(0))))


def bucket(x: Column, buckets: int) -> Column:
    """The place of a hash among ``buckets`` counters."""
    return (x.bitwiseAND(F.lit(buckets - 1).cast("bigint")) if buckets & (buckets - 1) == 0 else F.pmod(x, F.lit(buckets))).cast("int")


def _place(docs: DataFrame) -> tuple[Column, Column]:
    """The block of a row's doc_id and its place in there. An id that is no integer is a block of its own."""
    at = F.col("doc_id")
    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return at, F.lit(0).cast("smallint")
    return F.shiftright(at.cast("bigint"), BLOCK_BITS), at.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("smallint")


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text``, ``__good`` and ``__bad`` of every row of ``docs``: whether a label that is not toxic calls its id good (quality 1) or
    bad (0)."""
    block, place = _place(labels)
    known = labels.where("coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(block.alias("__block"), place.alias("__place"), "quality")
    by = {name: F.collect_set(F.when(F.col("quality") == q, F.col("__place"))).alias(name) for name, q in (("__goods", 1), ("__bads", 0))}
    blocks = stored(known.groupBy("__block").agg(*by.values()), "labels")
    block, place = _place(docs)
    rows = docs.select("text", block.alias("__at"), place.alias("__place"))
    rows = rows.join(F.broadcast(blocks) if blocks.count() <= BROADCAST_BLOCKS else blocks, F.col("__at") == F.col("__block"), "left")
    among = lambda name: F.coalesce(F.array_contains(name, F.col("__place")), F.lit(False))
    return rows.select("text", among("__goods").alias("__good"), among("__bads").alias("__bad"))


def buckets_for(features: int) -> int:
    """The power of two that holds at most ``LOAD`` of ``features`` in a bucket, ``BUCKETS`` at least."""
    return max(BUCKETS, 1 << (-(-features // LOAD) - 1).bit_length())


def fit(docs: DataFrame, labels: DataFrame, buckets: int | None = None, smoothing: float = SMOOTHING) -> np.ndarray:
    """The fixed-point log-likelihood ratio of each bucket, from all rows of ``docs`` and all that are labelled good."""
    rows = marked(docs, labels)
    found = rows.where("__good").select((2 * F.size(words_of(whole_text()))).alias("n"), F.spark_partition_id().alias("task")).agg(F.sum("n"), F.max("task")).first()
    if buckets is None:
        buckets = min(buckets_for(found[0] or 0), MOST_BUCKETS)
    if found[1] is not None:  # each task shuffles up to ``buckets`` counters, whatever it reads
        tasks = found[1] + 1
        rows = rows.coalesce(max(tasks // MERGED, min(tasks, 2 * docs.sparkSession.sparkContext.defaultParallelism)))
    exploded = _hashed(rows).select(F.col("__good").cast("int").alias("good"), F.explode(F.concat("__h", "__p")).alias("x"))
    exploded = exploded.select("good", bucket(F.col("x"), buckets).alias("bucket"))
    counts = exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("target")).toArrow()  # at most ``buckets`` rows
    raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    at = counts["bucket"].to_numpy()
    raw[at], target[at] = counts["raw"].to_numpy(), counts["target"].to_numpy()
    if not target.sum():
        return np.zeros(buckets, np.int32)
    share = target.sum() / raw.sum()
    return np.rint(SCALE * np.log((target + smoothing) / (raw * share + smoothing))).astype(np.int32)


def fit_weights(docs: DataFrame, labels: DataFrame, buckets: int | None = None, smoothing: float = SMOOTHING) -> list[int]:
    """``fit`` as a list."""
    return fit(docs, labels, buckets, smoothing).tolist()


def fit_threshold(docs: DataFrame, labels: DataFrame, weights: list[int] | np.ndarray) -> float:
    """The cut between the scores of all rows labelled good and all labelled bad, of those that pass the base rules; rows labelled both
    do not count."""
    table = held(docs.sparkSession, weights)
    value = let(hashes(words_of(whole_text())), lambda h: let(pairs(h), lambda p: F.when(~base_failed(h, p), score(h, p, table, len(weights)))))
    found = marked(docs, labels).where("__good <> __bad").select(F.col("__good").alias("good"), value.alias("score"))
    return best_cut(stored(found, "scores").dropna())  # before it is stored, a filter would evaluate the score twice


def best_cut(scores: DataFrame) -> float:
    """Where the shares of good rows lost and bad rows kept add up to the least, and the gap is widest, from all rows of ``scores``
    (good, score). It is a quarter up the gap, nearer the bad rows: the weights were fitted on the good ones, so other prose scores
    lower than they do. Rows are put in order within bins of the score; how many bins there are depends on its range alone."""
    good = F.col("good").cast("bigint")
    each = scores.groupBy(F.floor(F.col("score") * BINS).alias("bin"), "score").agg(F.sum(good).alias("good"), F.sum(1 - good).alias("bad"))
    bins = each.groupBy("bin").agg(F.sum("good").alias("goods"), F.sum("bad").alias("bads"), F.max("score").alias("top"))
    order, every = Window.orderBy("bin"), Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    running = order.rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("bin", F.sum("goods").over(running).alias("g"), F.sum("bads").over(running).alias("b"), F.lag("top").over(order).alias("top"), F.sum("goods").over(every).alias("goods"), F.sum("bads").over(every).alias("bads"))
    order = Window.partitionBy("bin").orderBy("score")
    running = order.rowsBetween(Window.unboundedPreceding, -1)
    below = lambda name, before: F.coalesce(F.sum(name).over(running), F.lit(0)) + F.coalesce(before, F.lit(0))
    cuts = each.join(F.broadcast(bins), "bin").select("score", "goods", "bads", below("good", "g").alias("lost"), below("bad", "b").alias("gone"), F.coalesce(F.lag("score").over(order), "top").alias("under"))
    loss = F.col("lost") * F.col("bads") - F.col("gone") * F.col("goods")  # lost / goods + 1 - gone / bads, in whole numbers
    best = cuts.where("under IS NOT NULL").select("under", (F.col("score") - F.col("under")).alias("gap"), loss.alias("loss")).orderBy("loss", F.desc("gap"), "under").first()
    return THRESHOLD if best is None or best["loss"] >= 0 else best["under"] + best["gap"] / 4


def held(spark: SparkSession, weights: list[int] | np.ndarray) -> Column:
    """The weights as one literal that holds them as plain 32-bit integers: ``from_json`` would fold into an object for each of
    them, and a subquery cannot stand inside of the functions that read it."""
    jvm, values = spark.sparkContext._jvm, np.asarray(weights, ">i4")
    ints = spark.sparkContext._gateway.new_array(jvm.int, len(values))
    jvm.java.nio.ByteBuffer.wrap(values.tobytes()).asIntBuffer().get(ints)
    catalyst, types = jvm.org.apache.spark.sql.catalyst.expressions, jvm.org.apache.spark.sql.types.DataTypes
    literal = catalyst.Literal(catalyst.UnsafeArrayData.fromPrimitiveArray(ints), types.createArrayType(types.IntegerType, False))
    return Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(literal))


def score(h: Column, p: Column, table: Column, n: int) -> Column:
    """Mean weight of the features of a text with word hashes ``h`` and pair hashes ``p``, in nats, from the ``n`` weights in ``table``;
    0 without words."""
    each = F.zip_with(h, p, lambda x, y: F.get(table, bucket(x, n)) + F.get(table, bucket(y, n)))
    total = F.aggregate(each, F.lit(0).cast("bigint"), lambda a, b: a + b)
    return F.when(F.size(h) == 0, F.lit(0.0)).otherwise(total / (F.lit(2.0 * SCALE) * F.size(h)))


def repeated_words(h: Column, p: Column) -> Column:
    """How many words stand in a three-word window that the text holds twice or more, from the hashes of words and of pairs."""
    inner = F.greatest(F.size(h) - 2, F.lit(0))
    windows = F.zip_with(F.slice(p, F.lit(1), inner), F.slice(h, F.lit(3), inner), lambda x, y: F.xxhash64(x, y))

    def covered(seen: Column) -> Column:
        ordered = F.sort_array(F.transform(seen, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(ordered, lambda s: F.transform(F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])), lambda x: x["i"]))
        return let(F.sort_array(twice), lambda at: F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b))

    return let(windows, lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0)).otherwise(covered(x)))


def base_failed(h: Column, p: Column) -> Column:
    return F.when(F.size(h) < 50, F.lit(True)).otherwise(100 * repeated_words(h, p) > 50 * F.size(h))


def _hashed(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns __text, __words, __h and __p. Each is used several times below, so the optimizer keeps it."""
    return docs.withColumn("__text", whole_text()).withColumn("__words", words_of(F.col("__text"))).withColumn("__h", hashes(F.col("__words"))).withColumn("__p", pairs(F.col("__h")))


def _judged(docs: DataFrame, weights: list[int] | np.ndarray, threshold: float) -> DataFrame:
    h, p, n = F.col("__h"), F.col("__p"), F.size("__h").cast("bigint")
    judged = docs.withColumns({"__n": n, "__repeat": repeated_words(h, p).cast("bigint"), "__score": score(h, p, held(docs.sparkSession, weights), len(weights))})
    failed = (F.col("__n") < 50) | (100 * F.col("__repeat") > 50 * F.col("__n"))
    return judged.withColumn("__failed", failed).withColumn("__kept", ~F.col("__failed") & (F.col("__score") >= threshold))


def quality_report(docs: DataFrame, weights: list[int] | np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and score of every row."""
    joined = F.array_join("__words", "")
    lines = F.filter(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    counted = _hashed(docs.select("doc_id", "text")).withColumns(
        {
            "word_chars": F.length(joined).cast("bigint"),
            "n_symbols": F.regexp_count(joined, F.lit(SYMBOLS)).cast("bigint"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
        }
    )
    names = {"__n": "n_words", "__repeat": "n_repeat_words", "__failed": "base_failed", "__kept": "kept", "__score": "score"}
    judged = _judged(counted, weights, threshold).withColumnsRenamed(names)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; the labels set the threshold if none is given. The verdict is one expression that binds its parts: as
    columns of their own they would be written out again inside the filter's lambdas, and evaluated for every word."""
    weights = fit(docs, labels)
    least = fit_threshold(docs, labels, weights) if threshold is None else threshold
    table = held(docs.sparkSession, weights)
    good = let(hashes(words_of(whole_text())), lambda h: let(pairs(h), lambda p: F.when(base_failed(h, p), F.lit(False)).otherwise(score(h, p, table, len(weights)) >= least)))
    return docs.where(good)
