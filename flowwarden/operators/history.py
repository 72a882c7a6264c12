"""Analysis history: add, search, list, count, retain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwarden.operators import knn
from flowwarden.operators.recency import KEEP_DOCUMENTS, keep_newest, newest, numbered

RECENT_WINDOW = 100
DEFAULT_K = 5


def type_key(attack_type: Column) -> Column:
    """Types are matched without regard to case; a missing type is ``unknown``."""
    return F.lower(F.coalesce(attack_type, F.lit("unknown")))


def of_type(docs: DataFrame, attack_type: str) -> DataFrame:
    return docs.where(type_key(F.col("attack_type")) == attack_type.lower())


def search(docs: DataFrame, queries: DataFrame, k: int = DEFAULT_K, attack_type: str | None = None,
           recent_only: bool = False, strategy: str = "blocks", attach: bool = True) -> DataFrame:
    """``(query_id, doc_index, rank, score[, text, ...])``: cosine top k of each query.

    A type filter is applied before the search and wins over ``recent_only``, which restricts the search to
    the 100 newest documents when there are more.  ``docs``: ``doc_index, attack_type, ts, embedding, ...``;
    ``queries``: ``query_id, embedding``.
    """
    pool = docs
    if attack_type:
        pool = of_type(docs, attack_type)
    elif recent_only and docs.select("doc_index").limit(RECENT_WINDOW + 1).count() > RECENT_WINDOW:
        keys = newest(docs.select("ts", "doc_index"), "ts", "doc_index", RECENT_WINDOW)
        pool = docs.join(F.broadcast(keys.select("doc_index")), "doc_index", "left_semi")  # 100 ids
    refs = knn.reference_rows(pool, "doc_index", "embedding")
    asked = knn.query_rows(queries, "query_id", "embedding")
    found = knn.with_score(knn.knn_join(asked, refs, k, "cosine", strategy))
    found = found.select("query_id", F.col("row_id").alias("doc_index"), "rank", "score")
    return found.join(docs.drop("embedding"), "doc_index") if attach else found


def search_within_types(docs: DataFrame, queries: DataFrame, k: int = DEFAULT_K, strategy: str = "blocks") -> DataFrame:
    """Each query searches the documents of its own ``attack_type``; an unknown type finds nothing."""
    key = type_key(F.col("attack_type"))
    refs = knn.reference_rows(docs, "doc_index", "embedding", key)
    asked = knn.query_rows(queries, "query_id", "embedding", key)
    found = knn.with_score(knn.knn_join(asked, refs, k, "cosine", strategy))
    return found.select("query_id", F.col("grp").alias("attack_type"), F.col("row_id").alias("doc_index"),
                        "rank", "score")


def by_type(docs: DataFrame, empty_query: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """First k documents of every type: the search of the empty query text within each type.

    ``empty_query``: one row ``(embedding)`` with the embedding of the empty text.
    """
    types = docs.select(type_key(F.col("attack_type")).alias("attack_type")).distinct()
    vector = empty_query.select("embedding").limit(1).first()["embedding"]
    asked = types.select(F.col("attack_type").alias("query_id"), "attack_type",
                         F.array(*[F.lit(float(x)) for x in vector]).alias("embedding"))
    return search_within_types(docs, asked, k).drop("query_id")


def recent(docs: DataFrame, k: int = 10) -> DataFrame:
    """The k most recent documents with score 1."""
    return newest(docs, "ts", "doc_index", k).withColumn("score", F.lit(1.0))


def stats(docs: DataFrame) -> DataFrame:
    """Documents per type and in total (type ``null``) with the newest and oldest time."""
    return docs.select(type_key(F.col("attack_type")).alias("attack_type"), "ts").rollup("attack_type").agg(
        F.count(F.lit(1)).alias("documents"), F.max("ts").alias("most_recent"), F.min("ts").alias("oldest"))


def type_listing(docs: DataFrame) -> DataFrame:
    key = type_key(F.col("attack_type")).alias("attack_type")
    return docs.groupBy(key).agg(F.count(F.lit(1)).alias("documents")).orderBy("attack_type")


def type_index(docs: DataFrame) -> DataFrame:
    """Type to document ids, one row per document: a list per type would put a whole type in one task."""
    return docs.select(type_key(F.col("attack_type")).alias("attack_type"), "doc_index")


def append_numbered(docs: DataFrame | None, batch: DataFrame, order: list[str]) -> DataFrame:
    """``batch`` with ``doc_index`` continuing after the stored documents."""
    last = docs.agg(F.max("doc_index")).first()[0] if docs is not None else None
    return numbered(batch, order, "doc_index", 0 if last is None else last + 1)


def retain(docs: DataFrame, keep: int = KEEP_DOCUMENTS) -> DataFrame:
    """The ``keep`` newest documents, renumbered from 0 in their old order."""
    kept = keep_newest(docs, "ts", "doc_index", keep).withColumnRenamed("doc_index", "old_index")
    return numbered(kept, ["old_index"], "doc_index", 0)
