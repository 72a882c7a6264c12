"""How far the word use of every two sources of a language is apart, and which terms set a source off.

Map tasks count terms by group; terms in enough documents of a language are kept.  The vocabulary is cut by hash into
blocks of bounded size, in which every term has a dense id and every group a sorted array of (id, count).  For each block and
unordered pair of groups both arrays are co-grouped (a few groups of each side to a task), the shorter one gallops
through the longer one, and overlaps, terms on one side only and terms absent from both are priced in both directions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowwarden.llm.words import slices
from flowwarden.session import materialize

#: Shares are counted in billionths.
UNIT = 1_000_000_000
#: (term, source) entries a block of the vocabulary is planned for.
BLOCK_ENTRIES = 1 << 18
#: Groups of a tile: a task meets the groups of two tiles pair by pair, so that an array is sent once for each tile.
TILE = 8
#: Entries a map task gathers before it sends them on, and bytes of a text that are split at once.
_GATHERED, _PIECE = 300_000, 1 << 20
#: Letters A-Z become small, a-z and all bytes of other characters stay, everything else separates.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(raw: bytes) -> Iterator[list[bytes]]:
    """Terms of a text in UTF-8, a piece of the text at a time."""
    low = 0
    while low < len(raw):
        part = raw[low:low + _PIECE].translate(_TERM_BYTES)
        if low + _PIECE < len(raw):
            cut = part.rfind(b" ")
            if cut < 0:  # one term longer than a piece: take it whole
                rest = raw[low + _PIECE:].translate(_TERM_BYTES)
                end = rest.find(b" ")
                part += rest if end < 0 else rest[:end]
            else:
                part = part[:cut + 1]
        low += len(part)
        yield part.split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term in each group, as far as a task has read."""
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> pa.RecordBatch:
        langs, sources, words, n, docs = [], [], [], [], []
        for (lang, source), (occurrences, holders) in seen.items():
            langs += [lang] * len(occurrences)
            sources += [source] * len(occurrences)
            words += occurrences
            n += occurrences.values()
            docs += [holders[w] for w in occurrences]
        seen.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(words, pa.binary()).cast(pa.string()),
             pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])

    for batch in slices(batches):
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(),
                                      batch.column("text").cast(pa.binary()).to_pylist()):
            occurrences, holders = seen.setdefault((lang, source), (Counter(), Counter()))
            own: set[bytes] = set()
            for found in terms(text):
                occurrences.update(found)
                own.update(found)
            holders.update(own)
        if sum(len(o) for o, _ in seen.values()) > _GATHERED:
            yield flush()
    if seen:
        yield flush()


def _share(count: Column, total: Column) -> Column:
    """1 + floor(UNIT * count / total), by long division in thousands, exact for totals below 2**63 / 1000."""
    digits = F.lit(0).cast("long")
    rest = count
    for _ in range(3):
        rest = rest * 1000
        digits = digits * 1000 + _div(rest, total)
        rest = rest % total
    return digits + 1


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of two longs that are not negative."""
    return F.call_function("div", a, b)


def _gap(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _prices(counts: np.ndarray, total: int, terms_kept: int) -> np.ndarray:
    """Shares of counts in a group of ``total`` occurrences, exact for any size."""
    distinct, at = np.unique(counts, return_inverse=True)
    return np.array([1 + UNIT * (c + 1) // (total + terms_kept) for c in distinct.tolist()], np.int64)[at]


def _gaps(p: np.ndarray, q: np.ndarray) -> int:
    return int(((p - q) * (p - q) // q).sum())


class _Group:
    """Sorted term ids of a group in one block, their shares, and the share of a term it lacks."""

    def __init__(self, table: pa.Table, i: int):
        def numbers(column: str, kind: type) -> np.ndarray:
            cell = table.column(column)[i]
            return cell.values.to_numpy(zero_copy_only=False).astype(kind) if cell.is_valid else np.empty(0, kind)

        total, v = (table.column(c)[i].as_py() for c in ("total", "v"))
        self.source = table.column("source")[i].as_py()
        self.ids = numbers("ids", np.int32)
        self.shares = _prices(numbers("counts", np.int64), total, v)
        self.none = _prices(np.zeros(1, np.int64), total, v)


def _merge(x: _Group, y: _Group, n_terms: int) -> tuple[int, int]:
    """Sums of gaps of x to y and of y to x over the ``n_terms`` terms of a block."""
    if len(x.ids) > len(y.ids):
        back, forth = _merge(y, x, n_terms)
        return forth, back
    at = np.searchsorted(y.ids, x.ids)  # the shorter array gallops through the longer one
    met = at < len(y.ids)
    met[met] = y.ids[at[met]] == x.ids[met]
    rest = np.ones(len(y.ids), bool)
    rest[at[met]] = False
    shared, alone_x, alone_y = (x.shares[met], y.shares[at[met]]), x.shares[~met], y.shares[rest]
    absent = n_terms - len(x.ids) - len(alone_y)
    forth = _gaps(*shared) + _gaps(alone_x, y.none) + _gaps(x.none, alone_y) + absent * _gaps(x.none, y.none)
    back = _gaps(*shared[::-1]) + _gaps(y.none, alone_x) + _gaps(alone_y, x.none) + absent * _gaps(y.none, x.none)
    return forth, back


def _merge_tiles(left: pa.Table, right: pa.Table) -> pa.Table:
    """All pairs between the groups of two tiles in one block, or within a tile where the right side is empty."""
    lang, n_terms, v = (left.column(c)[0].as_py() for c in ("lang", "n_terms", "v"))
    out: list[tuple[str, str, int]] = []
    if v:
        xs, ys = ([_Group(side, i) for i in range(side.num_rows)] for side in (left, right))
        for i, x in enumerate(xs):
            for y in ys or xs[i + 1:]:
                forth, back = _merge(x, y, n_terms)
                out += [(x.source, y.source, forth), (y.source, x.source, back)]
    else:  # a language without kept terms
        names, others = (side.column("source").to_pylist() for side in (left, right))
        for i, x in enumerate(names):
            for y in others or names[i + 1:]:
                out += [(x, y, 0), (y, x, 0)]
    return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "source": pa.array([o[0] for o in out], pa.string()),
                     "item": pa.array([o[1] for o in out], pa.string()), "value": pa.array([o[2] for o in out], pa.int64())})


def _clean(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
                         for c, name in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])


def count_terms(docs: DataFrame, least_docs: int = 3, text_col: str = "text", lang_col: str = "lang",
                source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Kept terms of each group, and all groups.

    First table: lang, source, term, n, lang_n (occurrences in the language); only terms in ``least_docs`` rows of the
    language.  Second: lang, source, total (n over kept terms), v (kept terms of the language), lang_total.  Nulls read as ''.
    """
    given = _clean(docs, text_col, lang_col, source_col)
    partial = given.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    whole = Window.partitionBy("lang", "term")
    # one shuffle serves both the sums by group and the windows by term
    kept = (partial.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
            .withColumn("lang_docs", F.sum("docs").over(whole)).where(F.col("lang_docs") >= least_docs)
            .withColumn("lang_n", F.sum("n").over(whole))
            .withColumn("head", (F.min("source").over(whole) == F.col("source")).cast("long")))
    kept = materialize(kept.select("lang", "source", "term", "n", "lang_n", "head"), "kept-terms")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("head").alias("heads"))
    groups = given.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").fillna(0, ["total", "heads"])
    langs = groups.groupBy("lang").agg(F.sum("heads").alias("v"), F.sum("total").alias("lang_total"))
    groups = materialize(groups.select("lang", "source", "total").join(langs, "lang"), "term-groups")
    return kept.drop("head"), groups


def pair_divergences(kept: DataFrame, groups: DataFrame, tile: int = TILE) -> DataFrame:
    """lang, source, item (every other source of the language) and value, the sum of gaps over all kept terms."""
    # one number of blocks for all languages: nothing is joined by language, which would deal a language to one task
    blocks = -(-kept.count() // BLOCK_ENTRIES) or 1
    placed = kept.select("lang", "source", "n", "term", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"))
    block = Window.partitionBy("lang", "block")
    numbered = placed.withColumn("id", F.dense_rank().over(block.orderBy("term"))).withColumn("n_terms", F.max("id").over(block))
    entries = F.sort_array(F.collect_list(F.struct("id", "n")))
    packed = materialize(numbered.groupBy("lang", "block", "source").agg(entries.alias("e"), F.first("n_terms").alias("n_terms")).select(
        "lang", "block", "source", "n_terms", F.col("e.id").alias("ids"), F.col("e.n").alias("counts")), "term-arrays")
    # sources are numbered and tiled within their language; the result has a row for every two of them, so that
    # the tables of sources and of tile pairs are no larger than what is returned
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    tiled = groups.withColumn("tile", F.floor(number / tile).cast("int"))
    tiles = tiled.withColumn("tiles", F.max("tile").over(Window.partitionBy("lang")) + 1)
    terms_of = packed.select("lang", "block", "n_terms").distinct()
    cells = tiles.join(terms_of, "lang", "left").fillna(0, ["block", "n_terms"])
    full = cells.join(packed.drop("n_terms"), ["lang", "block", "source"], "left").select(
        "lang", "block", "source", "total", "v", "n_terms", "ids", "counts", "tile", "tiles")
    key = ["lang", "block", "low", "high"]
    left = full.withColumn("high", F.explode(F.sequence("tile", F.col("tiles") - 1))).withColumnRenamed("tile", "low").drop("tiles")
    low = F.explode(F.when(F.col("tile") > 0, F.sequence(F.lit(0), F.col("tile") - 1)).otherwise(F.array().cast("array<int>")))
    right = full.withColumn("low", low).withColumnRenamed("tile", "high").drop("tiles")
    columns = [*key, "source", "total", "v", "n_terms", "ids", "counts"]
    left, right = (side.select(*[F.col(c).alias(c) for c in columns]) for side in (left, right))
    merged = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
        _merge_tiles, "lang string, source string, item string, value long")
    return merged.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_divergences(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (a kept term the group uses more than its language does) and value, its gap."""
    priced = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), _share(F.col("n") + 1, F.col("total") + F.col("v")).alias("p"),
        _share(F.col("lang_n") + 1, F.col("lang_total") + F.col("v")).alias("q"))
    return priced.where("p > q").select("lang", "source", "item", _gap(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, least_docs: int = 3, most_terms: int = 200, text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: sources by divergence (all), terms by gap (the first ``most_terms``).

    Terms are runs of A-Z, a-z and characters beyond ASCII, A-Z lower-cased; a language keeps those in ``least_docs`` of its rows.
    With n occurrences of a term among N of kept terms and V kept terms, its share is p = 1 + floor(10^9 (n + 1) / (N + V));
    the gap of p to q is floor((p - q)^2 / q).  Ranks order by value, ties by the item's bytes.  Null text, language or source
    reads as ''; rows that repeat count each time; a group without terms has pairs but no terms; texts of any length are
    counted whole; an empty table gives an empty result; other columns are left out.
    """
    kept, groups = count_terms(docs, least_docs, text_col, lang_col, source_col)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    near = pair_divergences(kept, groups).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    marked = term_divergences(kept, groups).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_terms)
    columns = ("lang", "source", "part", "item", "value", "rank")
    return near.select(*columns).unionByName(marked.withColumn("part", F.lit("term")).select(*columns))
