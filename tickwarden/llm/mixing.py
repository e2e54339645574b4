"""Mixing sources to target weights.

Method: tokens (here: words) are summed per source; each source's target
share gives a repetition rate; a document is emitted ``floor(rate)``
times, plus once more if a hash of the seed, its id, its text and its
number among equal documents, read as a number in [0, 1), lies below the
rate's fraction.

Targets: sources in code-point order (null last) weigh ``weights`` in
turn and share ``budget`` times the total size.  No target exceeds
``most`` times its source's size; what is cut off is shared again by
weight among the others until none is above.  That fixed point is one
level: target = min(most * size, weight * level).

Defined cases: a null text has size 0; a null source is a source; a
source of size 0 has target 0 and rate 0; a null doc_id hashes as empty
text and a null text as an empty one; documents that are equal in source,
id and text are numbered, so that each has a draw of its own (which of them
has which is of no account); an empty table gives no rows.  Other columns
are not read (``mix`` carries them through unchanged).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwarden.llm.common import WORD_PATTERN, stored, uniform, whole_row

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
SEED = "mix-1"


def word_count(text) -> F.Column:
    """Words in a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST,
) -> DataFrame:
    """(source, source_size) to (source, source_size, target, rate).

    One row per source, so the windows over all of them are small.  Sources
    in the order of size / weight are capped one after the other as the
    level rises; the level is that of the first source it does not cap.
    """
    w = F.array(*[F.lit(int(x)).cast("bigint") for x in weights])
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    rows = sizes.select("source", "source_size", F.get(w, F.pmod(place - 1, F.lit(len(weights)))).alias("weight"))
    rising = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("source_size").over(rising.rowsBetween(Window.unboundedPreceding, -1)) * most, F.lit(0))
    open_weight = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    level = (F.lit(float(budget)) * total - before.cast("double")) / open_weight.cast("double")
    rows = stored(rows.select("*", level.alias("level"), F.row_number().over(rising).alias("k")), "source-weights")
    free = (F.col("source_size") > 0) & (F.col("weight") * F.col("level") < F.col("source_size") * most)
    found = rows.where(free).agg(F.min_by("level", "k")).first()[0]
    cap = (F.col("source_size") * most).cast("double")
    # no source is free: all are capped
    target = cap if found is None else F.least(cap, F.col("weight") * F.lit(float(found)))
    return rows.select(
        "source", "source_size", target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"),
    )


def _mark() -> Column:
    """What equal documents share besides source and id."""
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))


def _copies(rate: Column, doc_id: Column, mark: Column, number: Column, seed: str) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(uniform(seed, doc_id, mark, number) < rate - whole, 1).otherwise(0)).cast("bigint")


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``_number`` 1, 2, ... for the rows of equal keys, without bringing a
    large group to one task: rows are counted per input partition, and the
    counts of the partitions before are added."""
    part = stored(rows.withColumn("_part", F.spark_partition_id()), "mix-equal")
    counts = part.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_part").alias("_of_part"),
                           F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_of_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(F.lit(0)))
    numbered = part.withColumn("_inside", inside)
    return numbered.join(counts, same).withColumn("_number", F.col("_inside") + F.col("_before"))


def _drawn(rows: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """rows(_id, _source, _mark, ...) with ``_target``, ``_source_size`` and
    ``_copies``."""
    keys = ["_source", "_id", "_mark"]
    equal = stored(rows.groupBy(*keys).count().where("count > 1").select(*[F.col(k).alias(f"{k}_2") for k in keys]), "mix-groups")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_2"))
    if equal.isEmpty():
        numbered = rows.withColumn("_number", F.lit(1))
    else:
        alone = rows.join(equal, same, "left_anti").withColumn("_number", F.lit(1))
        several = _numbered(rows.join(equal, same, "left_semi"), keys).select(*rows.columns, "_number")
        numbered = alone.unionByName(several)
    t = targets.select(F.col("source").alias("_t_source"), F.col("source_size").alias("_source_size"),
                       F.col("target").alias("_target"), F.col("rate").alias("_rate"))
    copies = _copies(F.col("_rate"), F.col("_id"), F.col("_mark"), F.col("_number"), seed)
    return numbered.join(t, F.col("_source").eqNullSafe(F.col("_t_source"))).withColumn("_copies", copies)


def mix_plan(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST, seed: str = SEED,
) -> DataFrame:
    """Per document: doc_id, size, source_size, target, copies, taken."""
    sized = stored(
        docs.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), _mark().alias("_mark"),
                    word_count(F.col("text")).alias("size")),
        "mix-sizes",
    )
    totals = sized.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(totals, weights, budget, most), "mix-targets")
    return _drawn(sized, targets, seed).select(
        F.col("_id").alias("doc_id"), "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        F.col("_copies").alias("copies"), (F.col("_copies") * F.col("size")).alias("taken"),
    )


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST, seed: str = SEED,
) -> DataFrame:
    """The mixed table itself: every row as often as its rate says, with the
    columns of ``docs``."""
    sizes = docs.select("source", word_count(F.col("text")).alias("size"))
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(totals, weights, budget, most), "mix-targets")
    rows = docs.select(whole_row(docs).alias("_row"), F.col("doc_id").alias("_id"), F.col("source").alias("_source"),
                       _mark().alias("_mark"))
    each = F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))
    return _drawn(rows, targets, seed).select("_row", each.alias("_copy")).select("_row.*")
