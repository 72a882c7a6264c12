"""Flow CSV discovery and reading."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwarden.schemas import ATTACK_CLASSES, BENIGN, CORRUPT_COLUMN, FLOW_COLUMNS, INDEX_COLUMN, flow_csv_schema
from flowwarden.session import materialize
from flowwarden.sources import csv_records

# Order in which class tokens are looked for in a file name.
NAME_TOKENS = [
    "icmpflood", "udpflood", "synflood", "httpflood", "synscan", "tcpconnectscan", "udpscan", "slowratedos",
]
# File-name patterns of the earlier naming scheme and the class each stands for.
LEGACY_ALIASES = {
    "icmpflood": "icmpflood", "icmp_flood": "icmpflood",
    "udpflood": "udpflood", "udp_flood": "udpflood",
    "synflood": "synflood", "syn_flood": "synflood",
    "httpflood": "httpflood", "http_flood": "httpflood",
    "synscan": "synscan", "syn_scan": "synscan",
    "tcpconnectscan": "tcpconnectscan", "tcp_connect_scan": "tcpconnectscan",
    "udpscan": "udpscan", "udp_scan": "udpscan",
    "slowrateDos": "slowrateDos", "slowrate_dos": "slowrateDos", "slowloris": "slowrateDos",
}
# Name fragments that mark a file as attack traffic.
ATTACK_FRAGMENTS = ["icmp", "udp", "syn", "http", "scan", "dos", "flood"]
MAX_HEADERS = 10_000  # different header lines, not files


def _first_match(name: Column, patterns: dict[str, str]) -> Column:
    whens = F.lit(None).cast("string")
    for pattern, value in reversed(list(patterns.items())):
        whens = F.when(name.contains(pattern), value).otherwise(whens)
    return whens


def _stem(file_name: Column) -> Column:
    return F.lower(F.regexp_replace(file_name, r"\.[^.]*$", ""))


def class_from_file_name(file_name: Column) -> Column:
    """Traffic class a file holds, null when the name matches none."""
    stem = _stem(file_name)
    exact = F.regexp_extract(stem, "^attack_type_(.*)_index$", 1)
    return (
        F.when(stem.contains(BENIGN), BENIGN).when(exact != "", exact)
        .otherwise(_first_match(stem, {t: t for t in NAME_TOKENS}))
    )


def class_from_file_name_legacy(file_name: Column) -> Column:
    stem = _stem(file_name)
    return F.when(stem.contains(BENIGN), BENIGN).otherwise(_first_match(stem, LEGACY_ALIASES))


def file_category(file_name: Column) -> Column:
    """``benign``, ``attack`` or ``unknown``, by name."""
    stem = _stem(file_name)
    attack = reduce(lambda a, b: a | b, [stem.contains(x) for x in ATTACK_FRAGMENTS])
    return F.when(stem.contains(BENIGN), "benign").when(attack, "attack").otherwise("unknown")


def size_mb(size: Column) -> Column:
    return size / F.lit(1048576.0)


def list_csv_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, file_name, size_mb, category, traffic_class)`` of every CSV below ``path``; contents unread.

    Listed through the file system, because Spark's readers leave out empty files.
    """
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True)
    paths, lengths = [], []
    while found.hasNext():
        entry = found.next()
        if entry.getPath().getName().endswith(".csv"):
            paths.append(entry.getPath().toString())
            lengths.append(entry.getLen())
    files = spark.createDataFrame(pa.table({"path": pa.array(paths, pa.string()),
                                            "length": pa.array(lengths, pa.int64())}))
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        "path", name.alias("file_name"), size_mb(F.col("length")).alias("size_mb"),
        file_category(name).alias("category"), class_from_file_name(name).alias("traffic_class"))


def read_flow_csv(spark: SparkSession, path: str, layout: str = "by_header", naming=class_from_file_name) -> DataFrame:
    """All flow CSVs below ``path`` as one frame with ``traffic_class``, ``file_name`` and ``row_id``.

    ``row_id`` is the file's path below ``path`` and the row's index; without an index column, ``r`` and the row's
    position in the file.  Files whose name matches no class (a held-out stream file, say) are left out.  Columns stay text;
    :func:`flowwarden.operators.cleaning.clean_flows` types them.  ``layout="by_header"`` finds columns by the names in each
    file's first record: they may be missing, extra, reordered, quoted and padded; a missing one reads null, of two equal
    names the first counts.  Line breaks in quotes are part of a field, blank lines are skipped, and a row of another
    width than its header is also given as text in ``corrupt_record``.  All files are read in the same two scans, the first of
    which leaves one row per split.  ``layout="fixed"`` reads in one scan, by position and line by line, for files known to
    have the standard column order.
    """
    if layout == "fixed":
        df = _scan(spark, path, flow_csv_schema().names[:-1])
    elif layout == "by_header":
        df = _by_header(spark, path)
    else:
        raise ValueError(layout)
    digest = F.md5(F.to_json(F.struct(*[f"`{c}`" for c in sorted(df.columns) if c not in ("file_path", INDEX_COLUMN)])))
    position = F.concat(F.lit("r"), F.col("_number").cast("string")) if "_number" in df.columns else digest
    number = F.coalesce(F.col(INDEX_COLUMN), position) if INDEX_COLUMN in df.columns else position
    df = df.withColumns({"traffic_class": naming(F.col("file_name")),
                         "row_id": F.concat_ws(":", _below(spark, path, F.col("file_path")), number)})
    return df.where(F.col("traffic_class").isNotNull()).drop(INDEX_COLUMN, "file_path", "_number")


def header_names(header: str) -> list[str]:
    """Column names of a header record: padding gone, an unnamed first column being the row index."""
    names = [(x or "").strip() for x in csv_records.fields(header.removeprefix("\ufeff"))]
    if names and (not names[0] or names[0].startswith(("_c", "Unnamed"))):
        names[0] = INDEX_COLUMN
    return names


def _by_header(spark: SparkSession, path: str) -> DataFrame:
    lines = csv_records.scan_lines(spark, path)
    splits = materialize(csv_records.read_splits(lines), "csv-splits")
    found = splits.where("header is not null").select("header").distinct().limit(MAX_HEADERS + 1).collect()
    if len(found) > MAX_HEADERS:
        raise ValueError(f"more than {MAX_HEADERS} different headers")
    headers = {r["header"]: header_names(r["header"]) for r in sorted(found)}
    standard = [INDEX_COLUMN if c == "" else c for c in FLOW_COLUMNS]
    seen = {n for names in headers.values() for n in names if n}
    columns = [n for n in standard if n in seen] + sorted(seen - set(standard)) if headers else standard
    # where each column stands in the files of a header (from 0, -1: nowhere)
    places = spark.createDataFrame(pa.table({
        "header": pa.array(list(headers), pa.string()),
        "width": pa.array([len(n) for n in headers.values()], pa.int32()),
        "at": pa.array([[names.index(c) if c in names else -1 for c in columns] for names in headers.values()],
                       pa.list_(pa.int32()))}))
    by_file = splits.select("file_path", "header").distinct().join(F.broadcast(places), "header").drop("header")
    records = csv_records.read_records(lines, splits).where("number > 0").join(by_file, "file_path")
    values = [F.when(F.col("at")[j] >= 0, F.get("values", F.col("at")[j])).alias(c) for j, c in enumerate(columns)]
    odd = F.when(F.size("values") != F.col("width"), F.array_join("values", ",", ""))
    name = F.element_at(F.split(plain_path(F.col("file_path")), "/"), -1)
    return records.select(*values, odd.alias(CORRUPT_COLUMN), name.alias("file_name"),
                          "file_path", (F.col("number") - 1).alias("_number"))


def plain_path(file_path: Column) -> Column:
    """A path as a reader's metadata gives it, which is URI-encoded, as plain text."""
    return F.url_decode(F.replace(file_path, F.lit("+"), F.lit("%2B")))


def _below(spark: SparkSession, path: str, file_path: Column) -> Column:
    """Path of a file below the folder that was read; the whole path if it is not below it (a pattern was read)."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(folder)
    start = folder.toUri().getPath().rstrip("/") + "/"
    whole = F.regexp_replace(plain_path(file_path), "^[^:/]+:(//[^/]*)?", "")
    return F.when(whole.startswith(start), whole.substr(F.lit(len(start) + 1), F.length(whole))).otherwise(whole)


def _scan(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    fields = ", ".join(f"`{n}` string" for n in [*names, CORRUPT_COLUMN])
    reader = (
        spark.read.schema(fields).option("header", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT_COLUMN).option("pathGlobFilter", "*.csv")
        .option("enforceSchema", True).option("recursiveFileLookup", True)
    )
    return reader.csv(path).select(
        "*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("file_path"))


def expected_classes(spark: SparkSession) -> DataFrame:
    """The nine-class taxonomy as a table."""
    return spark.createDataFrame([(c,) for c in [BENIGN, *ATTACK_CLASSES]], "traffic_class string")
