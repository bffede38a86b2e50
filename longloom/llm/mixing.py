"""Mixing sources to target weights by Pareto order sampling.

Every source has a target in words. A document is taken as often as its source's target holds the source, first as many
whole times as that goes; for the rest a sample is drawn in Pareto order: a document with the random number U and the
inclusion probability p ranks by ``(U / (1 - U)) / (p / (1 - p))``, and the lowest ranks that fill the target are
taken. The sample is of a fixed size in words. U is a hash of the document, so that a run repeats itself.

No source is sorted as a whole. Its documents are counted over slices of the range of U, and since all documents of a
source have the same p, ranks grow with U; only the slice in which the target is reached, about ``SLICE_ROWS``
documents however large the source, is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.numbering import ordered_index
from ..session import materialize
from .neardup import free_name
from .quality_rules import let, words_of

SLICE_ROWS = 1024


def text_size(text: Column) -> Column:
    """Number of words, 0 for NULL."""
    return F.size(words_of(text)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_copies: int = 3) -> DataFrame:
    """``source, source_size, target`` for a frame of ``source, source_size`` with one row per source.

    The sources in code point order, NULL last, have the weights in turn and share the whole size by them. A target
    stops at ``max_copies`` times its source; what is over is shared again by weight until none is above. Each round of
    sharing is one aggregate over the sources.
    """
    listed = sizes.select("source", "source_size", F.col("source").isNull().alias("_null"),
                          F.coalesce("source", F.lit("")).alias("_name"))
    shares = F.array(*[F.lit(float(w)) for w in weights])
    numbered = ordered_index(listed, "_null", "_name", out="_n")
    stored = materialize(numbered.select(
        "source", "source_size", (F.lit(float(max_copies)) * F.col("source_size")).alias("_most"),
        F.get(shares, F.pmod(F.col("_n") - 1, F.lit(len(weights))).cast("int")).alias("_weight")))
    level, stopped = 0.0, -1
    while True:
        full = F.col("_most") <= F.lit(level) * F.col("_weight")
        total, taken, weight, n = stored.agg(
            F.sum("source_size"), F.sum(F.when(full, F.col("_most")).otherwise(0.0)),
            F.sum(F.when(full, 0.0).otherwise(F.col("_weight"))), F.count_if(full)).first()
        if n == stopped or not weight:
            break
        level, stopped = (total - taken) / weight, n
    if not weight:  # every source is at its end
        level = float("inf")
    return stored.select("source", "source_size", F.least("_most", F.lit(level) * F.col("_weight")).alias("target"))


def _uniform(hashed: Column) -> Column:
    """A number strictly between 0 and 1 from the top 52 bits of a hash."""
    return (F.shiftrightunsigned(hashed, 12) + F.lit(0.5)) / F.lit(float(1 << 52))


def _fill(docs: Column, room: Column) -> Column:
    """The keys of the documents taken, in order, from ``[(rank, key, size)]`` for so many words.

    A document that would go beyond is passed over; at the end the smallest one passed over is taken if that comes
    nearer to the room than leaving it out.
    """
    start = F.struct(room.alias("room"), F.array().cast("array<bigint>").alias("taken"))
    filled = F.aggregate(docs, start, lambda acc, d: F.when(
        d["size"] <= acc["room"],
        F.struct((acc["room"] - d["size"]).alias("room"), F.array_append(acc["taken"], d["key"]).alias("taken")),
    ).otherwise(acc))

    def nearest(acc: Column) -> Column:
        rest = F.filter(docs, lambda d: ~F.array_contains(acc["taken"], d["key"]))
        least = F.array_min(F.transform(rest, lambda d: F.struct(d["size"].alias("size"), d["key"].alias("key"))))
        return F.when(least["size"] < 2 * acc["room"], F.array_append(acc["taken"], least["key"])).otherwise(acc["taken"])

    return let(filled, nearest)


def draw_copies(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_copies: int = 3, seed: int = 42,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id, source, key, size, source_size, target, copies`` for each document, ``copies`` being what the mix takes.

    ``key`` is a hash of id and text; rows that have both in common are drawn together.
    """
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    rows = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                                   key.alias("key"), text_size(F.col(text_col)).alias("size")))
    # never NULL, so that plain equality joins on it
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("NULL")).alias("name")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    sums = materialize(sums)
    targets = source_targets(sums.select("source", "source_size"), weights, max_copies)
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = materialize(targets.select(name, "source_size", "target", factor.alias("factor")).join(
        sums.select(name, "rows"), "name").select(
        "name", "source_size", "target", F.floor("factor").cast("int").alias("whole"),
        (F.col("factor") - F.floor("factor")).alias("p"),
        (F.col("target") - F.floor("factor") * F.col("source_size")).alias("room"),
        F.ceil(F.col("rows") / F.lit(SLICE_ROWS)).alias("slices")))
    known = rows.withColumn("name", name).join(plan, "name")
    u = _uniform(F.col("key"))
    sliced = known.withColumn("slice", F.floor(u * F.col("slices")).cast("bigint"))

    counts = sliced.groupBy("name", "slice", "room").agg(F.sum("size").alias("words"))
    upto = W.partitionBy("name").orderBy("slice").rowsBetween(W.unboundedPreceding, W.currentRow)
    cuts = materialize(
        counts.withColumn("upto", F.sum("words").over(upto))
        .filter((F.col("upto") >= F.col("room")) & (F.col("upto") - F.col("words") < F.col("room")))
        .select("name", F.col("slice").alias("cut"), (F.col("room") - F.col("upto") + F.col("words")).alias("left")))

    odds = F.lit(1.0) * (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    inside = sliced.join(cuts, "name").filter(F.col("slice") == F.col("cut"))
    inside = inside.groupBy("name", "left", "key", odds.alias("rank")).agg(F.sum("size").alias("size"))
    drawn = inside.groupBy("name", "left").agg(F.sort_array(F.collect_list(F.struct("rank", "key", "size"))).alias("docs"))
    drawn = drawn.select("name", F.explode(_fill(F.col("docs"), F.col("left"))).alias("key")).withColumn("drawn", F.lit(1))

    extra = F.coalesce((F.col("slice") < F.col("cut")).cast("int"), F.lit(0)) + F.coalesce("drawn", F.lit(0))
    return sliced.join(cuts.select("name", "cut"), "name", "left").join(materialize(drawn), ["name", "key"], "left").select(
        "id", "source", "key", "size", "source_size", "target", (F.col("whole") + extra).alias("copies"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_copies: int = 3, seed: int = 42,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns they came with.

    A size is the number of words. NULL or empty texts have size 0 and are taken as often as their source's whole
    copies, which changes no size. A NULL source is a source of its own, the last. Rows with the same id and text are
    drawn together; NULL ids are ids like any other. An empty table, or one without a word, gives no sizes to share:
    its targets are 0 and it gives no rows.
    """
    drawn = draw_copies(docs, weights, max_copies, seed, id_col, text_col, source_col)
    mark, times, copy = (free_name(docs, n) for n in ("_mix_key", "_mix_copies", "_mix_copy"))
    copies = drawn.groupBy(F.col("key").alias(mark)).agg(F.max("copies").alias(times)).filter(F.col(times) > 0)
    taken = docs.withColumn(mark, F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))).join(copies, mark)
    repeat = F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy)
    return taken.select("*", repeat).select(*[F.col(f"`{c}`") for c in docs.columns])
