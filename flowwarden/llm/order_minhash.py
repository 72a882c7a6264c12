"""Order MinHash fingerprints: minimal occurrence-numbered k-mers in text order.

A k-mer is k consecutive words; each of its occurrences in a text is an element of its own, numbered in text order, so
that repeats count.  A hash deals the elements into ``BINS`` bins, each bin keeps the ``TUPLE`` elements of the smallest
hash, and the kept elements of a bin are hashed in the order in which they stand in the text.  Two texts agree in a bin
only if the same elements stand in the same order, which makes the share of equal bins sensitive to edit distance.

All of it is array functions inside a row.  Occurrences are numbered by sorting codes with their positions; the first
of each k-mer and the repeats part there, so that only repeats need their runs counted.
"""

from __future__ import annotations

import collections
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed pattern of a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Words of a k-mer, bins (a power of two) and elements kept in a bin.
K, BINS, TUPLE = 3, 32, 2
_BIN_BITS = BINS.bit_length() - 1
#: Characters of a bin in a fingerprint: two of its number, eight of its hash.
_WIDTH = 10


def _shift(name: str, value: Column, bits: Column | int) -> Column:
    return F.call_function(name, value, bits if isinstance(bits, Column) else F.lit(bits))


def with_fingerprint(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Add the fingerprint of ``text_col`` (not null): ten characters for each bin that has an element, in order.

    An empty text has the empty fingerprint; a text of fewer than k words has one k-mer, all of its words.
    """
    c = lambda name: F.col(f"{out}_{name}")
    add = lambda frame, name, value: frame.withColumn(f"{out}_{name}", value)
    df = add(df, "words", F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0)))
    code = F.transform(c("words"), lambda w, i: F.xxhash64(w, *[F.get(c("words"), i + j) for j in range(1, K)]))
    df = add(df, "codes", F.slice(code, 1, F.greatest(F.size(c("words")) - (K - 1), F.lit(1))))
    # bits that hold a position; the others hold as much of a code as fits
    df = add(df, "bits", F.ceil(F.log2(F.size(c("codes")) + 1.0)).cast("int") + 1)
    df = add(df, "sorted", F.sort_array(F.transform(
        c("codes"), lambda code, i: _shift("shiftleft", code, c("bits")).bitwiseOR(i.cast("long")))))
    part = lambda v: _shift("shiftright", v, c("bits"))
    repeats = lambda v, i: F.coalesce((i > 0) & (part(v) == part(F.get(c("sorted"), i - 1))), F.lit(False))
    df = add(df, "firsts", F.filter(c("sorted"), lambda v, i: ~repeats(v, i)))
    df = add(df, "repeats", F.filter(c("sorted"), repeats))
    starts = F.filter(F.transform(c("repeats"), lambda v, i: F.when(
        (i == 0) | (part(v) != part(F.get(c("repeats"), i - 1))), i)), lambda i: i.isNotNull())
    df = add(df, "starts", starts)
    position = lambda v: v.bitwiseAND(_shift("shiftleft", F.lit(1).cast("long"), c("bits")) - 1)

    def element(v: Column, number: Column) -> Column:
        """Bin, hash and position in one number: the upper bits of the element's hash (not negative), the position below."""
        hashed = _shift("shiftrightunsigned", F.xxhash64(F.get(c("codes"), position(v).cast("int")), number), c("bits") + 1)
        return F.coalesce(_shift("shiftleft", hashed, c("bits")).bitwiseOR(position(v)), F.lit(0).cast("long"))

    runs = F.flatten(F.transform(c("starts"), lambda start, j: F.transform(
        F.slice(c("repeats"), start + 1, F.coalesce(F.get(c("starts"), j + 1), F.size(c("repeats"))) - start),
        lambda v, n: element(v, n + 1))))
    df = add(df, "elements", F.sort_array(F.concat(
        F.transform(c("firsts"), lambda v: element(v, F.lit(0))), runs)))
    bin_of = lambda v: _shift("shiftrightunsigned", v, 63 - _BIN_BITS)
    df = add(df, "kept", F.filter(c("elements"), lambda v, i: F.coalesce(
        (i < TUPLE) | (bin_of(v) != bin_of(F.get(c("elements"), i - TUPLE))), F.lit(False))))

    def entry(v: Column, i: Column) -> Column:
        """The bin's text if this is its first element: its kept hashes, ordered by position."""
        mine = [position(v)] + [F.when(bin_of(F.get(c("kept"), i + j)) == bin_of(v), position(F.get(c("kept"), i + j)))
                                for j in range(1, TUPLE)]
        ordered = F.array_sort(F.filter(F.array(*mine), lambda x: x.isNotNull()))
        names = F.transform(ordered, lambda at: F.get(c("codes"), at.cast("int")))
        text = F.concat(F.lpad(F.hex(bin_of(v)), 2, "0"),
                        F.lpad(F.hex(F.xxhash64(names).bitwiseAND(0xFFFFFFFF)), 8, "0"))
        return F.when((i == 0) | (bin_of(v) != bin_of(F.get(c("kept"), i - 1))), text)

    df = add(df, "entries", F.transform(c("kept"), entry))
    helpers = ("words", "codes", "bits", "sorted", "firsts", "repeats", "starts", "elements", "kept", "entries")
    return (df.withColumn(out, F.array_join(F.filter(c("entries"), lambda e: e.isNotNull()), ""))
            .drop(*[f"{out}_{name}" for name in helpers]))


def likeness(a: Column, b: Column) -> Column:
    """Equal bins as a share of the bins that either fingerprint has; two empty fingerprints are alike."""
    split = lambda f: F.regexp_extract_all(f, F.lit(f".{{{_WIDTH}}}"), F.lit(0))
    bins = lambda f: F.transform(split(f), lambda e: F.substring(e, 1, 2))
    either = F.size(F.array_union(bins(a), bins(b)))
    same = F.size(F.array_intersect(split(a), split(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(same / F.greatest(either, F.lit(1)))


def _range(tie: Column, n: Column) -> Column:
    """The range of equal width, of ``n``, into which a signed 64-bit hash falls, in ascending order."""
    upper = _shift("shiftrightunsigned", tie.bitwiseXOR(F.lit(-(1 << 63)).cast("long")), 32)
    return F.floor(upper * n / F.lit(1 << 32)).cast("long")


def _bucket(cuts: list[int], parts: int, key: Column, tie: Column) -> Column:
    """Ranges of (id, tie) in ascending order, nulls lowest, from the sorted quantiles of the ids.

    The bounds are looked up in two steps.  An id that several quantiles hit is as many ranges of the hash ``tie``; all
    rows without an id are ``parts`` of them.
    """
    bounds, often = sorted(set(cuts)), {c: n for c, n in collections.Counter(cuts).items() if n > 1}
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i:i + step] for i in range(0, len(bounds), step)] or [[]]
    longs = lambda values: F.array(*[F.lit(v).cast("long") for v in values]) if values else F.array().cast("array<long>")
    below = lambda values: F.size(F.filter(values, lambda b: b < key))
    group = below(longs([g[-1] for g in groups if g]))
    inner = F.coalesce(below(F.get(F.array(*map(longs, groups)), group)), F.lit(0))
    primary, width = group * step + F.greatest(inner, F.lit(0)), parts + 2
    second = F.lit(0).cast("long")
    if often:
        times = F.try_element_at(F.map_from_arrays(longs(list(often)), longs(list(often.values()))), key)
        second = F.when(times.isNotNull(), 1 + _range(tie, times)).otherwise(second)
    return F.when(key.isNull(), _range(tie, F.lit(parts)) - width).otherwise(primary * F.lit(width).cast("long") + second)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text, its edited text, and compare with both the edited and the next text.

    Returns id, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited and near_next.  The edited text has
    the last floor(n_chars / 3) code points replaced by as many from the start of the next document (all of it, if it
    is shorter) by descending id; the first follows the last.  Null texts are empty; null ids come last in that order,
    and rows of one id are ordered by a hash of the text.  A lone row is its own next.  An empty table gives an empty
    result.  Other columns are left out.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    n_rows = rows.count()
    parts = 2 + math.isqrt(n_rows)
    cuts = rows.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 10 * parts).alias("cuts")).first()["cuts"]
    bucketed = rows.withColumn("bucket", _bucket(sorted(cuts or []), parts, F.col("id"), F.col("tie")))
    # the first row of each bucket follows the last row of the bucket before; there are 3 * ``parts`` of them at most
    order = [F.col("id").desc_nulls_last(), F.col("tie").desc()]
    heads = bucketed.groupBy("bucket").agg(F.max(F.struct("id", "tie")).alias("head"))
    cycle = Window.orderBy(F.col("bucket").desc())
    whole = Window.partitionBy()
    after = heads.select("bucket", F.coalesce(F.lead("bucket").over(cycle), F.max("bucket").over(whole)).alias("next"))
    head_text = (rows.join(F.broadcast(heads.select("bucket", F.col("head.id").alias("i"), F.col("head.tie").alias("t"))),
                           F.expr("id <=> i and tie = t"))
                 .groupBy(F.col("bucket").alias("next")).agg(F.first("text").alias("head_text")))
    following = (with_fingerprint(head_text, "head_text", "head_print").join(after, "next")
                 .select("bucket", "head_text", "head_print"))
    lined = Window.partitionBy("bucket").orderBy(*order)
    inside = (with_fingerprint(bucketed, "text", "fingerprint")
              .withColumn("inner_text", F.lead("text").over(lined))
              .withColumn("inner_print", F.lead("fingerprint").over(lined)).drop("tie"))
    n, cut = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    joined = (inside.join(following, "bucket")
              .withColumn("next_text", F.coalesce("inner_text", "head_text"))
              .withColumn("next_print", F.coalesce("inner_print", "head_print"))
              .select("id", "fingerprint", "next_print", n.cast("long").alias("n_chars"),
                      F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)).alias("edited")))
    return with_fingerprint(joined, "edited", "edited_fingerprint").select(
        F.col("id").alias(id_col), "n_chars", "edited", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"))
