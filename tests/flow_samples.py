"""Small flow CSV folders for tests."""

import csv
import os
import random

from flowwarden.schemas import ATTACK_CLASSES, BENIGN, CATEGORICAL, FLOW_COLUMNS, LABELS


def flow_row(rng, kind, i):
    base = [BENIGN, *ATTACK_CLASSES].index(kind)
    row = {}
    for j, c in enumerate(FLOW_COLUMNS):
        if c == "":
            row[c] = i
        elif c == "Seq":
            row[c] = i * 7
        elif c == "Proto":
            row[c] = ["tcp", "udp", "icmp"][base % 3]
        elif c in ("sTos", "dTos"):
            row[c] = "0.0"
        elif c in ("sDSb", "dDSb"):
            row[c] = "cs0"
        elif c == "Cause":
            row[c] = "Start"
        elif c == "State":
            row[c] = rng.choice(["REQ", "CON", "FIN"])
        elif c in LABELS:
            row[c] = kind
        else:
            row[c] = round(base * (j % 5) + rng.random(), 4)
    return row


def write_csv(path, rows, columns=FLOW_COLUMNS):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        out = csv.DictWriter(f, columns, extrasaction="ignore")
        out.writeheader()
        out.writerows(rows)


def write_folder(root, per_class=40, seed=3, classes=None):
    rng = random.Random(seed)
    for kind in classes or [BENIGN, *ATTACK_CLASSES]:
        name = f"{BENIGN}_index.csv" if kind == BENIGN else f"attack_type_{kind}_index.csv"
        write_csv(os.path.join(root, "index", name), [flow_row(rng, kind, i) for i in range(per_class)])
    write_csv(os.path.join(root, "test", "test_stream.csv"), [flow_row(rng, BENIGN, i) for i in range(5)])


__all__ = ["CATEGORICAL", "flow_row", "write_csv", "write_folder"]
