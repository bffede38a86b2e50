"""Evening out class sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import HASH_RANGE, hash32
from ..session import materialize
from .matrix import class_counts
from .neighbours import SPLIT_ROWS, block_rows_for, nearest
from .numbering import hash_cut, hash_rank

# Class vectors up to this many values (64 MB) are broadcast, more are joined by shuffle.
BROADCAST_VALUES = 8_000_000
CHUNK = 1000


def undersample(m: DataFrame, ratio: float = 0.5, seed: object = 7, id_col: str = "id",
                label: str = "label") -> DataFrame:
    """Reduce the larger class to ``floor(minority / ratio)`` rows, the first ones in seeded hash order.

    Rows without a label belong to no class and are left out.
    """
    counts = class_counts(m, label)
    fewest = counts.agg(F.min("rows")).scalar()
    wanted = F.floor(F.col("_fewest") / F.lit(float(ratio))).cast("bigint")
    quota = F.when(F.col("rows") == F.col("_fewest"), F.col("rows")).otherwise(F.least(F.col("rows"), wanted))
    quotas = counts.withColumn("_fewest", fewest).select(F.col(label).alias("g"), quota.alias("quota"))
    cuts = hash_cut(m, id_col, seed, quotas, by=label)
    own = F.struct(hash32(id_col, seed).alias("h"), F.col(id_col).alias("i"))
    cut = F.struct(F.col("cut_hash").alias("h"), F.col("cut_id").alias("i"))
    # one row per class
    return m.join(F.broadcast(cuts), F.col(label) == F.col("g")).filter(own <= cut).select(*m.columns)


def oversampling_plan(counts: dict[object, int], ratio: float) -> dict[object, int]:
    """New rows per class: every class but the largest grows to ``int(ratio * largest)`` rows at least."""
    most = max(counts.values())
    largest = min(c for c, n in counts.items() if n == most)
    new = {c: max(n, int(ratio * most)) - n for c, n in counts.items() if c != largest}
    return {c: n for c, n in new.items() if n > 0}


def _by_class(label: str, values: dict[object, int]) -> Column:
    out = F.lit(None).cast("bigint")
    for c, v in values.items():
        out = F.when(F.col(label) == F.lit(c), F.lit(v).cast("bigint")).otherwise(out)
    return out


def synthetic_rows(m: DataFrame, ratio: float = 0.5, k: int = 5, seed: object = "smote", label: str = "label",
                   stored: bool = False, block_rows: int | None = None, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """``(label, j, features)``: new rows between a row of a small class and one of its k nearest classmates.

    Row j of a class starts from class member j mod c (in seeded hash order), picks a neighbour and goes a share of
    the way to it, both by a hash of class and j. Features must be complete; ids distinct.
    """
    m = m if stored else materialize(m)
    known = m.filter(F.col(label).isNotNull()).groupBy(label).agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.size("features")).alias("width")).collect()  # one row per class
    counts, width = {r[label]: r["rows"] for r in known}, max((r["width"] for r in known), default=0)
    new = oversampling_plan(counts, ratio)
    single = [c for c in new if counts[c] < 2]
    if single:
        raise ValueError(f"classes with a single row have no neighbours: {single}")
    if not new:
        return m.filter(F.lit(False)).select(label, F.lit(None).cast("bigint").alias("j"), "features")
    rows = m.filter(F.col(label).isin(list(new)))
    member, total, most_new = F.col("_r"), _by_class(label, counts), _by_class(label, new)
    bases = hash_rank(rows.select("id", label, "features"), "id", seed, by=label, out="_rank")
    bases = bases.withColumn("_r", F.col("_rank") - 1).filter(member < most_new)
    sizes = {c: (min(counts[c], n), counts[c]) for c, n in new.items()}
    near = nearest(bases, rows, sizes, k, per_gap=False, group=label,
                   block_rows=block_rows or block_rows_for(width or 0), split_rows=split_rows)

    # number the new rows of each base: r, r + c, r + 2c, ...
    todo = bases.select("id", label, "_r", F.ceil((most_new - member) / total).cast("bigint").alias("_todo"))
    todo = todo.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                          F.floor((F.col("_todo") - 1) / CHUNK).cast("bigint"))))
    if any(n > CHUNK * counts[c] for c, n in new.items()):
        todo = todo.repartition("id", "_chunk")
    first = F.col("_chunk") * CHUNK
    step = F.explode(F.sequence(first, F.least(first + CHUNK, F.col("_todo")) - 1))
    draws = todo.withColumn("_step", step).withColumn("j", member + F.col("_step") * total)

    key = F.concat_ws(":", F.col(label).cast("string"), F.col("j").cast("string"))
    choice = F.pmod(hash32(key, "1"), F.least(F.lit(k), total - 1)).cast("int")
    share = hash32(key, "2") / F.lit(float(HASH_RANGE))
    draws = draws.join(near.select("id", "best"), "id").select(
        "id", label, "j", F.get(F.col("best"), choice)["donor"].alias("_mate"), share.alias("_u"))

    vectors = rows.select(F.col("id").alias("_id"), F.col("features").alias("_x"))
    if sum(counts[c] for c in new) * width <= BROADCAST_VALUES:
        vectors = F.broadcast(vectors)
    start = vectors.withColumnsRenamed({"_id": "id", "_x": "_from"})
    end = vectors.withColumnsRenamed({"_id": "_mate", "_x": "_to"})
    return draws.join(start, "id").join(end, "_mate").select(
        label, "j", F.zip_with("_from", "_to", lambda a, b: F.struct(a.alias("a"), b.alias("b"))).alias("_ab"), "_u"
    ).select(label, "j", F.transform("_ab", lambda p: p["a"] + F.col("_u") * (p["b"] - p["a"])).alias("features"))


def smote(m: DataFrame, ratio: float = 0.5, k: int = 5, seed: object = "smote", label: str = "label",
          **options) -> DataFrame:
    """The rows plus the synthetic ones, which have their number within the class in ``synthetic``.

    Synthetic rows have ids of their own, after all others: whole numbers go on from the highest, text ids begin with
    ``~synthetic``. So the result can be split and folded like any matrix.
    """
    m = m if options.get("stored") else materialize(m)
    new = synthetic_rows(m, ratio, k, seed, label, **{**options, "stored": True})
    kind = m.schema["id"].dataType
    if isinstance(kind, T.StringType):
        own = F.concat_ws(":", F.lit("~synthetic"), F.lit(str(seed)), F.col(label).cast("string"),
                          F.lpad(F.col("j").cast("string"), 12, "0"))
    elif isinstance(kind, T.IntegralType):
        counts = {r[label]: r["rows"] for r in class_counts(m, label).filter(F.col(label).isNotNull()).collect()}
        begins, total = {}, 0
        for c, n in sorted(oversampling_plan(counts, ratio).items()) if counts else []:
            begins[c], total = total, total + n
        highest = m.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
        own = (highest + 1 + _by_class(label, begins) + F.col("j")).cast(kind)
    else:
        raise ValueError(f"no ids for synthetic rows beside ids of type {kind.simpleString()}")
    return m.select("id", label, "features", F.lit(None).cast("bigint").alias("synthetic")).unionByName(
        new.select(own.alias("id"), label, "features", F.col("j").alias("synthetic")))
