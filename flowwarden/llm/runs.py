"""Runs of repeated word groups, found by a suffix automaton with link-cut access.

Words are appended to a suffix automaton one by one.  Its suffix links form a tree on which every path from a prefix's state to
the root is recoloured with the prefix's end: a splay forest keeps the paths of one colour, and access walks them from
the new state upwards.  A path of colour j and longest word sequence L at end i says that the last L words up to
i ended before at j and not later; with d = i - j <= L the words up to i hold squares of period d, and i - L - d + 1 is
where that period begins.  Squares met at successive ends are one run.

Only words that can lie in a run are appended.  In a run of period q, from its (q + 3)rd word on, each three words stood up to q
words before; so stretches of such positions, no farther back than the length of the stretch allows, hold every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwarden.llm.words import WORD_BASE, Texts, mix, slices, spans, text_bytes

#: A run has this many words at least, and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4


class Automaton:
    """Suffix automaton of a growing sequence; its link tree is a splay forest of paths of equal last end."""

    def __init__(self) -> None:
        # state 0 is the root and stays out of the forest; a state's first transition is kept apart from any others
        self.length, self.link, self.word, self.to = [0], [-1], [-1], [0]
        self.more: dict[int, dict[int, int]] = {}
        self.up, self.left, self.right, self.colour = [-1], [-1], [-1], [-1]
        self.last = 0

    def _state(self, length: int, colour: int) -> int:
        for column, value in ((self.length, length), (self.link, -1), (self.word, -1), (self.to, 0), (self.up, -1),
                              (self.left, -1), (self.right, -1), (self.colour, colour)):
            column.append(value)
        return len(self.length) - 1

    def _step(self, state: int, word: int) -> int:
        if self.word[state] == word:
            return self.to[state]
        others = self.more.get(state)
        return -1 if others is None else others.get(word, -1)

    def _set(self, state: int, word: int, target: int) -> None:
        if self.word[state] in (-1, word):
            self.word[state], self.to[state] = word, target
        else:
            self.more.setdefault(state, {})[word] = target

    def append(self, word: int, end: int) -> int:
        """Add a word; returns the state of the whole sequence so far."""
        new = self._state(self.length[self.last] + 1, end)
        at = self.last
        while at >= 0 and (target := self._step(at, word)) < 0:
            self._set(at, word, new)
            at = self.link[at]
        if at < 0:
            above = 0
        elif self.length[target] == self.length[at] + 1:
            above = target
        else:
            above = self._split(at, word, target)
        self.link[new] = above
        self.up[new] = above if above else -1
        self.last = new
        return new

    def _split(self, at: int, word: int, target: int) -> int:
        """Clone the state whose sequences got different ends; the clone lies just above it on the same path."""
        self._splay(target)
        clone = self._state(self.length[at] + 1, self.colour[target])
        self.link[clone], self.word[clone], self.to[clone] = self.link[target], self.word[target], self.to[target]
        if target in self.more:
            self.more[clone] = dict(self.more[target])
        self.link[target] = clone
        upper = self.left[target]
        self.left[clone], self.left[target], self.up[clone] = upper, clone, target
        if upper >= 0:
            self.up[upper] = clone
        while at >= 0 and self._step(at, word) == target:
            self._set(at, word, clone)
            at = self.link[at]
        return clone

    def _splay(self, x: int) -> None:
        """Bring a state to the root of its path's tree; the root carries the path's colour."""
        up, left, right, colour = self.up, self.left, self.right, self.colour
        while (p := up[x]) >= 0 and (left[p] == x or right[p] == x):
            g = up[p]
            inner = g >= 0 and (left[g] == p or right[g] == p)
            turns = (x,) if not inner else (p, x) if (left[g] == p) == (left[p] == x) else (x, x)
            colour[x] = colour[g if inner else p]
            for y in turns:
                q = up[y]
                h = up[q]
                if left[q] == y:
                    child = right[y]
                    left[q], right[y] = child, q
                else:
                    child = left[y]
                    right[q], left[y] = child, q
                if child >= 0:
                    up[child] = q
                up[q], up[y] = y, h
                if h >= 0:
                    if left[h] == q:
                        left[h] = y
                    elif right[h] == q:
                        right[h] = y

    def access(self, state: int, end: int) -> Iterator[tuple[int, int]]:
        """Recolour the path above ``state`` with ``end``; yields (former end, longest length) of each path segment met."""
        up, right, colour = self.up, self.right, self.colour
        below, x = state, up[state]
        while x >= 0:
            self._splay(x)
            yield colour[x], self.length[x]
            if right[x] >= 0:
                colour[right[x]] = colour[x]
            right[x] = below
            below, x = x, up[x]
        colour[below] = end
        self._splay(state)


def region_runs(words: list[int]) -> dict[tuple[int, int], int]:
    """(start, period) of the runs of a sequence, and their ends (exclusive)."""
    found: dict[tuple[int, int], int] = {}
    automaton = Automaton()
    for end, word in enumerate(words):
        state = automaton.append(word, end)
        for before, length in automaton.access(state, end):
            period = end - before
            whole = length + period
            if whole >= LEAST_PERIODS * period and whole >= LEAST_WORDS:
                found[end - whole + 1, period] = end + 1
    return found


def regions(hashes: np.ndarray, row: np.ndarray, row_start: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, low, high) of word ranges that together hold every run, each with one word more on the left."""
    n = len(hashes)
    if n < LEAST_WORDS:
        return []
    start = np.flatnonzero(row[:n - 2] == row[2:])
    code = mix(spans(hashes, start, start + 3, WORD_BASE) ^ mix(row[start].astype(np.uint64)))
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    at, back = start[order[1:][same]] + 2, (order[1:] - order[:-1])[same]
    # positions of ``start`` are consecutive within a row, so that their difference is the distance in words
    distance = np.zeros(n, np.int64)
    distance[at] = back
    while True:
        on = distance > 0
        edge = np.flatnonzero(np.diff(np.r_[False, on, False].astype(np.int8)))
        # stretches do not cross rows: the first two words of a row end no three words
        low, high = edge[::2], edge[1::2]
        longest = np.repeat((high - low + 2) // (LEAST_PERIODS - 1), high - low)
        inside = np.flatnonzero(on)
        too_far = (distance[inside] > longest) | (np.repeat(high - low, high - low) < 3)
        if not too_far.any():
            break
        distance[inside[too_far]] = 0
    left = np.maximum(low - 3 - (high - low + 2) // (LEAST_PERIODS - 1), row_start[row[low]]) if len(low) else low
    return list(zip(row[low].tolist(), left.tolist(), high.tolist()))


def runs_of(hashes: np.ndarray, row: np.ndarray, row_start: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """For each row with runs, its sorted (start, length, period), in words of the row."""
    found: dict[int, set[tuple[int, int, int]]] = {}
    for r, low, high in regions(hashes, row, row_start):
        words = np.unique(hashes[low:high], return_inverse=True)[1].tolist()
        first, past = int(row_start[r]), int(row_start[r + 1])
        for (start, period), end in region_runs(words).items():
            start, end = start + low, end + low
            while start > first and hashes[start - 1] == hashes[start - 1 + period]:
                start -= 1
            while end < past and hashes[end] == hashes[end - period]:
                end += 1
            found.setdefault(r, set()).add((start - first, end - start, period))
    return {r: sorted(f, key=lambda x: (x[0], x[2])) for r, f in found.items()}


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple[bytes, int]:
    """Words outside the repeats of all runs, and how many are left out."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()
    return b" ".join([words[i] for i in kept]), len(words) - len(kept)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        data, offsets = text_bytes(batch.column("text"))
        texts = Texts(data, offsets, False)
        found = runs_of(texts.hashes, texts.row, texts.row_start)
        runs, collapsed, dropped = [], [], []
        for r in range(batch.num_rows):
            own = found.get(r, [])
            # bytes.split() cuts at exactly the six blanks
            text, n = _collapsed(data[offsets[r]:offsets[r + 1]].tobytes().split(), own)
            runs.append([{"start": s, "length": n_, "period": p} for s, n_, p in own])
            collapsed.append(text)
            dropped.append(n)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(np.diff(texts.row_start), pa.int64()),
             pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
             pa.array(dropped, pa.int64()), pa.array(collapsed, pa.binary()).cast(pa.string()), batch.column("kept")],
            ["id", "n_words", "runs", "n_dropped", "collapsed", "kept"])


def periodic_runs(docs: DataFrame, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``n_words``, ``runs`` (start, length, period; by start, then period), ``n_dropped``, ``collapsed`` text, ``keep``.

    A run is a stretch of words with smallest period q and length of at least max(6, 4 q), as long as it can be.  Collapsed
    texts leave out all words that some run contains after its first q, and join the others by one space.  Words are told apart by
    64-bit hashes.  Every row is judged by its own text, so that rows which repeat get equal results; a null or empty
    text has no words and no runs; a text of any length is read whole; a null id stays null; an empty table gives an empty
    result; other columns are left out.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"),
                       F.struct(*[F.col(c) for c in keep] or [F.lit(1).alias("one")]).alias("kept"))
    found = rows.mapInArrow(
        _find, "id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, n_dropped long, "
               f"collapsed string, kept {rows.schema['kept'].dataType.simpleString()}")
    own = ("n_words", "runs", "n_dropped", "collapsed")
    return found.select(F.col("id").alias(id_col), *own,
                        *[F.col("kept")[c].alias(c) for c in keep if c not in (id_col, *own)])
