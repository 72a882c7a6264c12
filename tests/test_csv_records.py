"""CSV records split anywhere, against Python's own parser, and files read by the names in their headers."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from flowwarden.operators import quality
from flowwarden.sources import csv_records, flow_csv


def write_odd_csv(path, rng, rows):
    """Quoted line breaks, doubled quotes, blank lines and lines of blanks."""
    with open(path, "w", newline="") as f:
        f.write("id,Proto,note\n")
        for i in range(rows):
            note = rng.choice(["plain", 'a "quoted" word', "two\nlines", "\n\n", 'x,"\n"\n,y', "long " * rng.randint(1, 40)])
            f.write(rng.choice(["", "", "\n", "  \n"]))
            csv.writer(f, lineterminator="\n").writerow([i, "tcp", note])


def parsed(path):
    with open(path, newline="") as f:
        return [r for r in csv.reader(f) if any(x.strip() for x in r) or len(r) > 1]


@pytest.mark.parametrize("split_bytes", [None, 97, 1000])
def test_records_equal_those_of_a_parser(spark, tmp_path, split_bytes):
    rng = random.Random(split_bytes or 0)
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        write_odd_csv(str(tmp_path / name / "benign.csv"), rng, 150)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if split_bytes:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    try:
        lines = csv_records.scan_lines(spark, str(tmp_path))
        splits = csv_records.read_splits(lines)
        assert splits.count() > (12 if split_bytes else 1)
        got = {}
        for r in csv_records.read_records(lines, splits).collect():
            got.setdefault(r.file_path[-12:-11], {})[r.number] = [x or "" for x in r["values"]]
        counts = {r.file_path[-12:-11]: r.records for r in csv_records.count_records(splits).collect()}
        rows = {r.file_name: r.rows for r in quality.file_profile(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name in ("a", "b"):
        want = parsed(str(tmp_path / name / "benign.csv"))
        assert [got[name][i] for i in range(len(want))] == want and counts[name] == len(want) == len(got[name])
    assert rows == {"benign.csv": 150}


def test_a_quote_left_open(spark, tmp_path):
    (tmp_path / "benign.csv").write_text('id,note\n1,a\n2,"never\nclosed\n')
    lines = csv_records.scan_lines(spark, str(tmp_path))
    splits = csv_records.read_splits(lines)
    assert csv_records.count_records(splits).first()["records"] == 3
    assert {r.number for r in csv_records.read_records(lines, splits).collect()} == {0, 1, 2}


def test_headers_of_every_kind(spark, tmp_path):
    files = {
        "mon/benign.csv": ",Proto,Dur\n0,tcp,1.5\n1,udp,2.5\n",
        "tue/benign.csv": '"Dur", Proto ,extra\n3.5,"u\ndp",x\n3.5,"u\ndp",x\n\n',
        "tue/udpscan_é b+c.csv": "﻿Dur\n7\n",
        "tue/synscan.csv": "Proto,Dur\ntcp,1,surplus\ntcp\n",
        "wed/stream.csv": "Proto,Dur\nlost,1\n",
        "wed/httpflood.csv": "",
        "wed/udpflood.csv": "Proto,Dur\n",
    }
    for name, text in files.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    got = flow_csv.read_flow_csv(spark, str(tmp_path))
    assert got.columns == ["Dur", "Proto", "extra", "corrupt_record", "file_name", "traffic_class", "row_id"]
    rows = sorted(tuple(r) for r in got.select("row_id", "traffic_class", "Dur", "Proto", "extra", "corrupt_record").collect())
    assert rows == sorted([
        ("mon/benign.csv:0", "benign", "1.5", "tcp", None, None), ("mon/benign.csv:1", "benign", "2.5", "udp", None, None),
        ("tue/benign.csv:r0", "benign", "3.5", "u\ndp", "x", None), ("tue/benign.csv:r1", "benign", "3.5", "u\ndp", "x", None),
        ("tue/synscan.csv:r0", "synscan", "1", "tcp", None, "tcp,1,surplus"), ("tue/synscan.csv:r1", "synscan", None, "tcp", None, "tcp"),
        ("tue/udpscan_é b+c.csv:r0", "udpscan", "7", None, None, None)])
    profile = {(r.file_name, r.rows, r.status) for r in quality.file_profile(spark, str(tmp_path)).collect()}
    assert ("httpflood.csv", 0, "empty") in profile and ("udpflood.csv", 0, "empty") in profile and len(profile) == 6


def test_a_folder_without_records(spark, tmp_path):
    (tmp_path / "benign.csv").write_text("")
    assert flow_csv.read_flow_csv(spark, str(tmp_path)).select(F.col("Proto"), "row_id").count() == 0
