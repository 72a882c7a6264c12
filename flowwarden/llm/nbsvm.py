"""Quality classifier: n-gram indicators scaled by class log-count ratios, and a linear hinge-loss model on them.

Features are byte n-grams hashed into a fixed number of slots, present or absent in a text.  Each is scaled by the log
ratio of its smoothed frequencies in both classes, every text is brought to length one, and dual coordinate descent
fits the support vector machine.  Scores are probabilities from a logistic curve over cross-validated margins, which
also sees the length of the text and how much of it is new, as short and repetitive texts have uncertain margins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwarden.llm.words import slices, text_bytes

#: Slots of the feature table (a power of two) and the lengths of the n-grams.
SLOTS, ORDERS = 1 << 16, (1, 2, 3, 4)
#: Bound of the fit: labelled rows used at most, those with the smallest hash of the id.
MOST_ROWS = 3000
_MULTIPLIER = np.uint32(0x9E3779B1)


def slots(data: np.ndarray) -> np.ndarray:
    """Distinct slots of the n-grams of a text's bytes."""
    seen = np.zeros(SLOTS, bool)
    for low in range(0, len(data), 1 << 20):
        part = data[low:low + (1 << 20) + max(ORDERS) - 1].astype(np.uint32)
        code = np.zeros(len(part), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            if len(part) < n:
                break
            code = (code[:len(part) - n + 1] << np.uint32(8)) | part[n - 1:]
            if n in ORDERS:
                mixed = (code ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * _MULTIPLIER
                seen[(mixed ^ (mixed >> np.uint32(15))) * _MULTIPLIER >> np.uint32(16)] = True
    return np.flatnonzero(seen)


@dataclass
class Model:
    """Weight of each slot (log-count ratio times model weight), their squared scale, and the logistic curve."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    curve: np.ndarray

    def signs(self, seen: np.ndarray, n_bytes: int) -> np.ndarray:
        """What the curve sees: margin, one, shortness, margin of a short text, length, share of new n-grams."""
        length = np.sqrt(self.squares[seen].sum())
        margin = self.weights[seen].sum() / length + self.bias if length > 0 else self.bias
        short = 1 / np.sqrt(len(seen) + 1)
        return np.array([margin, 1.0, short, margin * short, np.log(n_bytes + 1) / 10,
                         np.log((len(seen) + 1) / (n_bytes + 1))])

    def score(self, seen: np.ndarray, n_bytes: int) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.signs(seen, n_bytes) @ self.curve, -500, 500))))


def descend(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, bounds: np.ndarray, size: int, rounds: int,
            seed: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Dual coordinate descent of the linear hinge loss: weight, bias and the dual variables, each within 0 and its bound.

    ``rows`` and ``values`` are the slots and values of each text, of length one; a constant component carries the bias.
    """
    weight, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    curvature = [float(v @ v) + 1.0 for v in values]
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            slope = labels[i] * (values[i] @ weight[rows[i]] + bias) - 1
            step = min(max(alpha[i] - slope / curvature[i], 0.0), bounds[i]) - alpha[i]
            if step:
                alpha[i] += step
                weight[rows[i]] += step * labels[i] * values[i]
                bias += step * labels[i]
                largest = max(largest, abs(step))
        if largest < 1e-4:
            break
    return weight, bias, alpha


def _descend(rows: list[np.ndarray], labels: np.ndarray, cost: float, rounds: int, seed: int) -> Model:
    """The support vector machine on indicators scaled by log-count ratios; classes weigh alike."""
    counts = {side: np.ones(SLOTS) for side in (-1, 1)}
    for seen, y in zip(rows, labels):
        counts[int(y)][seen] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[-1] / counts[-1].sum())
    squares = ratio**2
    values = [ratio[seen] / max(np.sqrt(squares[seen].sum()), 1e-12) for seen in rows]
    share = {side: len(labels) / (2 * max(1, (labels == side).sum())) for side in (-1, 1)}
    bounds = np.array([cost * share[int(y)] for y in labels])
    weight, bias, _ = descend(rows, values, labels, bounds, SLOTS, rounds, seed)
    return Model(weight * ratio, squares, bias, np.zeros(6))


def _curve(signs: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logistic regression on the signs by Newton's method, with smoothed targets."""
    good, bad = (labels == 1).sum(), (labels == -1).sum()
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    at = np.zeros(signs.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(signs @ at, -500, 500)))
        hessian = (signs * (p * (1 - p))[:, None]).T @ signs + 1e-2 * np.eye(len(at))
        step = np.linalg.solve(hessian, signs.T @ (p - target) + 1e-2 * at)
        at -= step * min(1.0, 2 / np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return at


def train(rows: list[np.ndarray], sizes: list[int], labels: np.ndarray, cost: float = 1.0, rounds: int = 30,
          folds: int = 3, seed: int = 5) -> Model:
    """Fit on the slots and bytes of each text and labels of -1 and 1.

    Without rows of both classes every score is 0.5 (no rows), or the smoothed share of the only class.
    """
    if len(set(labels.tolist())) < 2:
        good = float((labels == 1).sum())
        share = np.log((good + 1) / (len(labels) - good + 1))
        return Model(np.zeros(SLOTS), np.zeros(SLOTS), 0.0, np.array([0.0, share, 0, 0, 0, 0]))
    signs, fold = np.zeros((len(rows), 6)), np.arange(len(rows)) % folds
    for f in range(folds):
        inside = np.flatnonzero(fold != f)
        part = _descend([rows[i] for i in inside], labels[inside], cost, rounds, seed)
        for i in np.flatnonzero(fold == f):
            signs[i] = part.signs(rows[i], sizes[i])
    model = _descend(rows, labels, cost, rounds, seed)
    model.curve = _curve(signs, labels)
    return model


def _slots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        data, offsets = text_bytes(batch.column("text"))
        found = [slots(data[a:b]).astype(np.int32) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("label"), pa.array(np.diff(offsets), pa.int64()),
             pa.array(found, pa.list_(pa.int32()))], ["id", "label", "n_bytes", "slots"])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        held_out_rest: int | None = 2, most_rows: int = MOST_ROWS) -> Model:
    """Train on the labelled rows of ``docs``.

    Rows whose crc32(id as text) mod 4 is ``held_out_rest`` are left out (none, if it is None).  Labels other than 0
    and 1, ids with both labels, and null ids are left out; an id labelled or stored twice counts once.
    """
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % 4
    given = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if held_out_rest is not None:
        given = given.where(fold != held_out_rest)
    marked = (given.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("other"))
              .where("label = other").select("id", F.col("label").cast("int").alias("label"))
              .orderBy(F.xxhash64("id"), "id").limit(most_rows))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # the chosen ids are at most ``most_rows``, so that they may be broadcast at any size of the input
    chosen = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(F.broadcast(marked), "id")
    # an id stored often leaves one text in each task, and one in all
    chosen = chosen.groupBy("id", "label").agg(F.min_by("text", F.struct(F.octet_length("text"), "text")).alias("text"))
    rows = (chosen.mapInArrow(_slots_of, "id long, label int, n_bytes long, slots array<int>").toArrow()
            .sort_by([("id", "ascending"), ("n_bytes", "ascending")]))
    kept: dict[int, tuple[int, int, np.ndarray]] = {}
    for i, label, size, seen in zip(*(rows.column(c).to_pylist() for c in ("id", "label", "n_bytes")), rows.column("slots")):
        kept.setdefault(i, (label, size, np.asarray(seen.values, np.uint16 if SLOTS <= 1 << 16 else np.int32)))
    return train([k[2] for k in kept.values()], [k[1] for k in kept.values()],
                 np.array([2 * k[0] - 1 for k in kept.values()], np.int64))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = (), id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Id, score and the columns ``keep`` of every row, scored from its whole text alone.

    A null text counts as empty, a null id stays null.  Rows that repeat get equal scores; an empty table gives an
    empty result; other columns are left out.
    """

    # the text goes to the workers once, also where it is kept
    text_kept = text_col in keep
    others = [c for c in keep if c not in (id_col, text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column("text"))
            found = [model.score(slots(data[a:b]), b - a) for a, b in zip(offsets[:-1], offsets[1:])]
            columns = [batch.column("id"), pa.array(found, pa.float64()), batch.column("kept")]
            yield pa.RecordBatch.from_arrays(columns + [batch.column("text")] * text_kept,
                                             ["id", "score", "kept"] + ["text"] * text_kept)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.struct(*[F.col(c) for c in others] or [F.lit(1).alias("one")]).alias("kept"))
    scored = rows.mapInArrow(run, f"id long, score double, kept {rows.schema['kept'].dataType.simpleString()}"
                                  + (", text string" if text_kept else ""))
    named = {text_col: F.col("text")} | {c: F.col("kept")[c] for c in others}
    return scored.select(F.col("id").alias(id_col), "score", *[named[c].alias(c) for c in keep if c != id_col])
