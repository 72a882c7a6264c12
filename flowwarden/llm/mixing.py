"""Mix sources to target weights by systematic sampling.

Every document of a source is expected ``target / source size`` times.  The expectations are summed along the source
in a fixed order (size class, then hash), one random offset per source is added, and a document is emitted once for
each integer that the running sum crosses.  The order by size spreads the sample over all sizes, so that the words
taken stay near the target.  The running sum is cut into buckets: counts per bucket give each bucket's start, and
only rows of one bucket are ordered together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed pattern of a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Size classes for each doubling of the size.
CLASSES = 8


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Words to take from each source: ``source``, ``source_size``, ``target``.

    ``sizes`` has one row per source (``source``, ``source_size``).  Sources ordered by code point, null last, get
    the weights in turn.  All sources together keep the total; a source stops at ``most`` times its size and the
    rest is shared again by weight.  With the sources ordered by the level at which they stop, running sums give the
    final level at once.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    pattern = F.array(*map(F.lit, weights))
    weighed = sizes.withColumn("weight", F.get(pattern, (F.row_number().over(named) - 1) % len(weights)))
    stop = F.col("source_size") * most / F.col("weight")
    before = Window.orderBy("stop", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    leveled = (weighed.withColumn("stop", stop)
               .withColumn("level", (F.sum("source_size").over(whole) - so_far(F.col("source_size") * most))
                           / (F.sum("weight").over(whole) - so_far("weight"))))
    # the level with the sources before this one stopped; the first that it does not reach is the final one
    final = F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "level"))).over(whole)
    return leveled.select("source", "source_size", F.least(
        F.col("source_size") * F.lit(float(most)),
        F.coalesce(final["level"] * F.col("weight"), F.lit(0.0))).cast("double").alias("target"))


def mix(rows: DataFrame, seed: int = 11, weights: tuple[int, ...] = (1, 2, 3), most: int = 3,
        text_col: str = "text", source_col: str = "source", id_col: str = "doc_id",
        keep: tuple[str, ...] = ()) -> DataFrame:
    """How often each row enters the mix: id, source, size, source_size, target, copies and the columns ``keep``.

    The same rows give the same mix, however they are stored.  A null text has size 0, a null source is a source of
    its own, a null id is a value like any other.  Rows that repeat entirely are counted one by one.  A source
    without words gets target 0 and no copies; an empty table gives an empty result.  No row is taken more than
    ``most`` times.
    """
    text = F.col(text_col).cast("string")
    # the number of buckets and the rows of each both grow with the root of the rows
    subs = 1 + math.isqrt(rows.count()) // 64
    source = F.col(source_col).cast("string")
    sized = rows.select(
        F.struct(*[F.col(c) for c in keep] or [F.lit(1)]).alias("kept"), F.col(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("named"), word_count(text).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), text).alias("k"))
    dealt = (sized.withColumn("class", F.floor(F.log2(F.col("size") + 1.0) * CLASSES).cast("int"))
             .withColumn("sub", F.pmod("k", F.lit(subs)).cast("int")))
    # all that is counted: one row for each source, class and sub-bucket
    buckets = dealt.groupBy("named", "class", "sub").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    real = F.when(F.col("named") != "", F.substring("named", 2, 2_000_000_000))
    plan = (targets(buckets.groupBy("named").agg(F.sum("words").alias("source_size"))
                    .select(real.alias("source"), "source_size"), weights, most)
            .select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("named"), "source_size", "target",
                    F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)).alias("expected"))
            .withColumn("offset", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("offset"), "named"), 11)
                        / F.lit(float(1 << 53))))
    before = Window.partitionBy("named").orderBy("class", "sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = (buckets.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n", "words")
              .join(plan, "named"))
    within = Window.partitionBy("named", "class", "sub").orderBy("size", "k", "id")
    crossed = lambda at: F.floor(at * F.col("expected") + F.col("offset"))
    return (dealt.withColumn("nth", F.row_number().over(within)).join(starts, ["named", "class", "sub"])
            .withColumn("place", F.col("start") + F.col("nth"))
            .select(F.col("id").alias(id_col), real.alias(source_col), "size", "source_size", "target",
                    F.least(crossed(F.col("place")) - crossed(F.col("place") - 1), F.lit(most)).cast("int")
                    .alias("copies"), *[F.col("kept")[c].alias(c) for c in keep if c not in (id_col, source_col)]))
