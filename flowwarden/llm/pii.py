"""Personal data: fixed patterns, and spans that a character-level bidirectional LSTM with CRF transitions adds.

The network is trained in numpy on windows around digits and at signs of a bounded sample of texts.  Labelled spans are
those of the patterns, and the same data written in ways that the patterns do not know: other separators, spaced
or bracketed points and at signs, no plus sign; look-alikes that are no personal data stay unlabelled.  The network then
reads overlapping windows of every text; each window is decoded with the Viterbi path and the posterior of its tags, spans
that cross windows are taken from the middles of neighbouring ones, and all findings are reconciled over the whole
text by weighted interval scheduling.  All four kinds need a digit or an at sign, so windows without either hold nothing.
"""

from __future__ import annotations

import bisect
import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwarden.llm.words import slices, text_bytes

#: The kinds in their order, and the patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _small(number: str) -> bool:
    return len(number.lstrip("0")) <= 3 and int(number[-4:]) <= 255


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four runs of digits joined by points; a run that starts no match is passed over whole, as is a match."""
    runs: list[re.Match] = []
    for run in _DIGITS.finditer(text):
        if runs and not (run.start() == runs[-1].end() + 1 and text[runs[-1].end()] == "."):
            runs = []
        runs.append(run)
        if len(runs) == 4:
            if all(_small(r.group()) for r in runs):
                yield runs[0].start(), run.end()
            runs = []


def base_spans(text: str) -> list[Span]:
    """Pattern matches that pass their checks, by start, then kind."""
    spans: list[Span] = [("email", a, b) for a, b in _emails(text)] + [("ip", a, b) for a, b in _addresses(text)]
    for m in _CARD.finditer(text):
        digits = _only_digits(m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_only_digits(m.group())) <= 15:
            spans.append(("phone", m.start(), m.end()))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


# -- the same data written otherwise

#: How a span of each kind may be written; ``{0}`` and so on are its parts.
_JOINS = {"email": (" @ ", "@", " @"), "ip": (" . ", "[.]", "(.)", ". "), "card": (".", "/", "_", " - "), "phone": ("", "00", "tel ", "(")}


def _written_otherwise(kind: str, span: str) -> tuple[str, int, int]:
    """A span in another way of writing, chosen by its digest, and where the data begins and ends in it.

    An empty range marks a look-alike that is no personal data.
    """
    choice = zlib.crc32(span.encode())
    join = _JOINS[kind][choice % len(_JOINS[kind])]
    digits, fake = _only_digits(span), choice // 7 % 4 == 0
    if kind == "email":
        local, domain = span.rsplit("@", 1)
        if fake:
            text = f"@{local}"
        else:
            text = local + join + (domain if join != "@" else domain.replace(".", " . "))
    elif kind == "ip":
        parts = span.split(".")
        text = ".".join(parts[:3]) if fake else join.join(parts)
    elif kind == "card":
        text = digits[:7] if fake else join.join(digits[i:i + 4] for i in range(0, len(digits), 4))
    elif fake:
        text = digits[:8]
    else:
        rest = span[1:]
        if join == "(":
            text = f"({digits[:3]}) {digits[3:6]}-{digits[6:]}"
        elif join == "tel ":
            return f"tel {rest}", 4, 4 + len(rest)
        else:
            text = join + rest
    return (text, 0, 0) if fake else (text, 0, len(text))


def varied(text: str, spans: list[Span]) -> tuple[str, list[Span]]:
    """The text with its spans written otherwise, and the spans of the result; overlapping ones are left out."""
    out, found, at, size = [], [], 0, 0
    for kind, start, end in spans:
        if start >= at:
            word, low, high = _written_otherwise(kind, text[start:end])
            out += [text[at:start], word]
            size += start - at
            if high > low:
                found.append((kind, size + low, size + high))
            size += len(word)
            at = end
    return "".join([*out, text[at:]]), found


# -- windows

#: Characters of a window, distance of windows, characters around a digit or at sign that are read.
WIDTH, STRIDE, AROUND = 64, 32, 24
#: Bounds of the training sample: texts with a digit or at sign, and windows.
MOST_TEXTS, MOST_WINDOWS = 1500, 1200
_SPECIAL = "@.-+() _%:/#,\n"
_CLASS = np.full(129, 4, np.int64)  # 0 pads, 1 lower, 2 upper, 3 digit, 4 other, 5 beyond ASCII, then one each
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128] = 1, 2, 3, 5
for _i, _c in enumerate(_SPECIAL):
    _CLASS[ord(_c)] = 6 + _i
N_CLASSES, N_TAGS = 6 + len(_SPECIAL), 1 + 2 * len(KINDS)


def windows_of(text: str) -> list[int]:
    """Starts of the overlapping windows that cover the surroundings of every digit and at sign."""
    starts: list[int] = []
    low = high = None
    for mark in [m.start() for m in _MARK.finditer(text)] + [None]:
        if mark is not None and high is not None and mark - AROUND <= high:
            high = mark + AROUND
            continue
        if high is not None:
            starts += range(low, max(low + 1, min(high, len(text)) - WIDTH + STRIDE), STRIDE)
        if mark is not None:
            low, high = max(0, mark - AROUND), mark + AROUND
    return starts


def classes_of(text: str, start: int) -> np.ndarray:
    codes = np.array([ord(c) for c in text[start:start + WIDTH]], np.int64)
    out = np.zeros(WIDTH, np.int64)
    out[:len(codes)] = _CLASS[np.minimum(codes, 128)]
    return out


def tags_of(spans: list[Span], start: int) -> np.ndarray:
    """Tag of each character: 0 outside, then begin and inside of each kind; later spans do not overwrite."""
    tags = np.zeros(WIDTH, np.int64)
    for kind, a, b in spans:
        low, high = max(a, start) - start, min(b, start + WIDTH) - start
        if low < high and not tags[low:high].any():
            tags[low:high] = 2 + 2 * KINDS.index(kind)
            if a >= start:
                tags[low] -= 1
    return tags


# -- network

@dataclass
class Network:
    """Weights by name: per direction input, recurrent and bias; then emission, transition and start scores."""

    weights: dict[str, np.ndarray]

    @staticmethod
    def fresh(hidden: int = 12, seed: int = 3) -> "Network":
        rng = np.random.default_rng(seed)
        w = {"out": rng.normal(0, 0.2, (2 * hidden, N_TAGS)), "out_b": np.zeros(N_TAGS),
             "move": np.zeros((N_TAGS, N_TAGS)), "start": np.zeros(N_TAGS)}
        for d in "fb":
            w[f"in_{d}"] = rng.normal(0, 0.3, (N_CLASSES, 4 * hidden))
            w[f"rec_{d}"] = rng.normal(0, 0.2, (hidden, 4 * hidden))
            w[f"b_{d}"] = np.r_[np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]
        return Network(w)

    def _run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States of one direction (batch, time, hidden) and what the way back needs; x is already in its order."""
        u, n = self.weights[f"rec_{d}"], len(self.weights[f"rec_{d}"])
        given = self.weights[f"in_{d}"][x] + self.weights[f"b_{d}"]
        h = c = np.zeros((len(x), n))
        states, kept = np.empty((*x.shape, n)), []
        for t in range(x.shape[1]):
            z = given[:, t] + h @ u
            s = 1 / (1 + np.exp(-z[:, :3 * n]))
            i, f, o, g = s[:, :n], s[:, n:2 * n], s[:, 2 * n:], np.tanh(z[:, 3 * n:])
            before, c_before = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            states[:, t] = h
            kept.append((i, f, o, g, tc, before, c_before))
        return states, kept

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list, list]:
        forward, kept_f = self._run(x, "f")
        backward, kept_b = self._run(x[:, ::-1], "b")
        both = np.concatenate([forward, backward[:, ::-1]], axis=2)
        return both @ self.weights["out"] + self.weights["out_b"], both, kept_f, kept_b

    def chances(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward scores of the CRF, log partition, and the tags' posteriors."""
        move = self.weights["move"]
        lse = lambda v, axis: (m := v.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis=axis))
        a, b = np.empty_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0] + self.weights["start"]
        for t in range(1, e.shape[1]):
            a[:, t] = e[:, t] + lse(a[:, t - 1, :, None] + move, 1)
            b[:, -1 - t] = lse(move + (e[:, -t] + b[:, -t])[:, None, :], 2)
        z = lse(a[:, -1], 1)
        return a, b, z, np.exp(a + b - z[:, None, None])

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags and its gradient."""
        e, both, kept_f, kept_b = self.emissions(x)
        a, b, z, posterior = self.chances(e)
        move, n_rows = self.weights["move"], len(x)
        rows, times = np.indices(y.shape)
        gold = e[rows, times, y].sum(1) + self.weights["start"][y[:, 0]] + move[y[:, :-1], y[:, 1:]].sum(1)
        de = posterior.copy()
        de[rows, times, y] -= 1
        pairs = np.exp(a[:, :-1, :, None] + move + (e + b)[:, 1:, None, :] - z[:, None, None, None]).sum((0, 1))
        np.subtract.at(pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        grad = {"move": pairs, "start": de[:, 0].sum(0), "out_b": de.sum((0, 1)),
                "out": np.einsum("bth,btk->hk", both, de)}
        dh = de @ self.weights["out"].T
        n = dh.shape[2] // 2
        for d, inputs, given, kept in (("f", x, dh[:, :, :n], kept_f), ("b", x[:, ::-1], dh[:, ::-1, n:], kept_b)):
            u = self.weights[f"rec_{d}"]
            d_in, d_rec, d_bias = np.zeros_like(self.weights[f"in_{d}"]), np.zeros_like(u), np.zeros(4 * n)
            next_h = next_c = np.zeros((n_rows, n))
            for t in range(x.shape[1] - 1, -1, -1):
                i, f, o, g, tc, before, c_before = kept[t]
                h = given[:, t] + next_h
                c = next_c + h * o * (1 - tc**2)
                dz = np.concatenate([c * g * i * (1 - i), c * c_before * f * (1 - f), h * tc * o * (1 - o),
                                     c * i * (1 - g**2)], axis=1)
                np.add.at(d_in, inputs[:, t], dz)
                d_rec += before.T @ dz
                d_bias += dz.sum(0)
                next_h, next_c = dz @ u.T, c * f
            grad |= {f"in_{d}": d_in, f"rec_{d}": d_rec, f"b_{d}": d_bias}
        return float((z - gold).mean()), {k: g / n_rows for k, g in grad.items()}

    def paths(self, e: np.ndarray) -> np.ndarray:
        """Viterbi paths."""
        move = self.weights["move"]
        best, back = e[:, 0] + self.weights["start"], []
        for t in range(1, e.shape[1]):
            step = best[:, :, None] + move
            back.append(step.argmax(1))
            best = step.max(1) + e[:, t]
        path = [best.argmax(1)]
        for pointers in reversed(back):
            path.append(pointers[np.arange(len(e)), path[-1]])
        return np.stack(path[::-1], axis=1)


def train(x: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 32, rate: float = 0.02, seed: int = 3) -> Network:
    """Adam on the windows; without windows the network stays as initialised and is never sure of a span."""
    net, rng = Network.fresh(seed=seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for low in range(0, len(x), batch):
            at = order[low:low + batch]
            step += 1
            for k, g in net.gradients(x[at], y[at])[1].items():
                g = np.clip(g, -5, 5)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                net.weights[k] = net.weights[k] - rate * (first[k] / (1 - 0.9**step)) / (
                    np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return net


# -- added spans

#: Smallest posterior of any tag of an added span.
SURE = 0.5


def _plausible(kind: str, text: str) -> bool:
    """Checks that every span of a kind must pass, however it is written."""
    digits = _only_digits(text)
    if kind == "email":
        return "@" in text[1:-1]
    if kind == "ip":
        parts = _DIGITS.findall(text)
        return len(parts) == 4 and all(map(_small, parts))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15


def _read(tags: np.ndarray, chance: np.ndarray, start: int, length: int) -> Iterator[tuple[float, Span]]:
    """Spans of one decoded window; those cut by an inner edge are left to the next window."""
    t = 0
    while t < WIDTH:
        if tags[t] % 2 == 1:
            end = t + 1
            while end < WIDTH and tags[end] == tags[t] + 1:
                end += 1
            whole = (t > 0 or start == 0) and (end < WIDTH or start + WIDTH >= length)
            if whole and start + end <= length:
                sure = chance[np.arange(t, end), tags[t:end]].min()
                yield float(sure), (KINDS[tags[t] // 2], start + t, start + end)
            t = end
        else:
            t += 1


def _across(parts: list[tuple[int, np.ndarray, np.ndarray]], length: int) -> Iterator[tuple[float, Span]]:
    """Spans that no window holds whole: of neighbouring windows each gives its middle, the outer ones their edges too."""
    at = 0
    while at < len(parts):
        last = at
        while last + 1 < len(parts) and parts[last + 1][0] == parts[last][0] + STRIDE:
            last += 1
        if last > at:
            start, margin = parts[at][0], (WIDTH - STRIDE) // 2
            cuts = [(0 if i == at else margin, WIDTH if i == last else WIDTH - margin) for i in range(at, last + 1)]
            tags = np.concatenate([parts[i][1][low:high] for i, (low, high) in zip(range(at, last + 1), cuts)])
            sure = np.concatenate([parts[i][2][np.arange(low, high), parts[i][1][low:high]]
                                   for i, (low, high) in zip(range(at, last + 1), cuts)])
            for t in np.flatnonzero(tags % 2 == 1).tolist():
                end = t + 1
                while end < len(tags) and tags[end] == tags[t] + 1:
                    end += 1
                whole = (t > 0 or start == 0) and (end < len(tags) or start + len(tags) >= length)
                if whole and start + end <= length:
                    yield float(sure[t:end].min()), (KINDS[tags[t] // 2], start + t, start + end)
        at = last + 1


def reconcile(found: dict[Span, float]) -> list[Span]:
    """The set of spans that do not overlap and whose lengths, weighted by certainty, add up highest."""
    spans = sorted(found, key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in spans]
    best, taken = [0.0], []
    for i, span in enumerate(spans):
        before = bisect.bisect_right(ends, span[1], 0, i)
        value = best[before] + found[span] * (span[2] - span[1])
        taken.append(before if value > best[-1] else -1)
        best.append(max(value, best[-1]))
    out, i = [], len(spans)
    while i:
        if taken[i - 1] >= 0:
            out.append(spans[i - 1])
            i = taken[i - 1]
        else:
            i -= 1
    return out[::-1]


def _beside(added: list[Span], base: list[Span]) -> list[Span]:
    """Added spans that overlap no base span; base spans come by start and may overlap each other."""
    starts = [b[1] for b in base]
    reach = list(itertools.accumulate((b[2] for b in base), max))
    return [s for s in added if (i := bisect.bisect_left(starts, s[2])) == 0 or reach[i - 1] <= s[1]]


def all_spans(texts: list[str], net: Network, sure: float = SURE) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans and all spans: base ones and those that the network adds beside them."""
    where = [(i, s) for i, text in enumerate(texts) for s in windows_of(text)]
    found: list[dict[Span, float]] = [{} for _ in texts]
    decoded: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in texts]

    def add(i: int, certain: float, span: Span) -> None:
        if certain >= sure and _plausible(span[0], texts[i][span[1]:span[2]]):
            found[i][span] = max(certain, found[i].get(span, 0.0))

    for low in range(0, len(where), 256):
        part = where[low:low + 256]
        e = net.emissions(np.stack([classes_of(texts[i], s) for i, s in part]))[0]
        paths, chance = net.paths(e), net.chances(e)[3]
        for (i, s), path, p in zip(part, paths, chance):
            if path.any():
                decoded[i].append((s, path, p))
                for certain, span in _read(path, p, s, len(texts[i])):
                    add(i, certain, span)
    out = []
    for i, (text, parts) in enumerate(zip(texts, decoded)):
        for certain, span in _across(parts, len(text)):
            add(i, certain, span)
        base = base_spans(text) if _MARK.search(text) else []
        added = _beside(reconcile(found[i]), base)
        out.append((base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become the first's kind."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _marked(batch: pa.RecordBatch) -> np.ndarray:
    """Which rows hold a digit or an at sign."""
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index("text")))
    marks = np.r_[0, np.cumsum(((data >= 48) & (data <= 57)) | (data == 64))]
    return marks[offsets[1:]] > marks[offsets[:-1]]


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text)
            kinds = [(text, spans)]
            if spans:
                other, known = varied(text, spans)
                known = sorted(known + _beside(base_spans(other), known), key=lambda s: s[1])
                kinds.append((other, known))
            for given, labels in kinds:
                for s in windows_of(given):
                    rows.append((classes_of(given, s).astype(np.uint8).tobytes(), tags_of(labels, s).astype(np.uint8).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)], ["x", "y"])


def fit(docs: DataFrame, text_col: str = "text", most_texts: int = MOST_TEXTS, most_windows: int = MOST_WINDOWS) -> Network:
    """Train on windows of at most ``most_texts`` texts that hold a digit or at sign, at most ``most_windows`` of them.

    The labelled spans are those of the patterns, as written and written otherwise (see :func:`varied`).  Distinct texts and distinct windows of the smallest hashes are taken,
    so that the same texts give the same network, however often each is repeated.
    """
    marked = docs.select(F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    key = F.xxhash64("text")
    texts = marked.select(key.alias("k")).distinct().orderBy("k").limit(most_texts)
    chosen = marked.join(F.broadcast(texts), F.col("k") == key, "left_semi").distinct()  # ``most_texts`` longs at most
    rows = (chosen.mapInArrow(_examples, "x binary, y binary").distinct()
            .orderBy(F.xxhash64("x", "y"), "x", "y").limit(most_windows).collect())
    read = lambda c: np.array([np.frombuffer(r[c], np.uint8) for r in rows], np.int64).reshape(-1, WIDTH)
    return train(read("x"), read("y"))


def find(docs: DataFrame, net: Network, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of every row's whole text: id, n_email, n_ip, n_card, n_phone (base), base, spans, masked, columns ``keep``.

    ``base`` and ``spans`` list kind:start:end, comma-joined, by start, then kind; code points, end exclusive.  The
    counts are those of the base spans.  A null text is empty (``masked`` is then null), a null id stays null; rows
    that repeat get equal results; an empty table gives an empty result.
    """
    counts = ", ".join(f"n_{k} long" for k in KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            column = batch.column("text")
            rows = np.flatnonzero(_marked(batch))
            texts = column.take(pa.array(rows)).to_pylist()
            n, base, spans = np.zeros((len(KINDS), batch.num_rows), np.int64), [""] * batch.num_rows, [""] * batch.num_rows
            clean = column.to_pylist() if len(rows) else None
            for row, text, (b, every) in zip(rows, texts, all_spans(texts, net)):
                base[row], spans[row] = written(b), written(every)
                clean[row] = masked(text, every)
                for kind, _, _ in b:
                    n[KINDS.index(kind), row] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *map(pa.array, n), pa.array(base, pa.string()), pa.array(spans, pa.string()),
                 column if clean is None else pa.array(clean, pa.string()), batch.column("kept")],
                ["id", *(f"n_{k}" for k in KINDS), "base", "spans", "masked", "kept"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.struct(*[F.col(c) for c in keep] or [F.lit(1).alias("one")]).alias("kept"))
    kept_type = rows.schema["kept"].dataType.simpleString()
    found = rows.mapInArrow(run, f"id long, {counts}, base string, spans string, masked string, kept {kept_type}")
    return found.select(F.col("id").alias(id_col), *[f"n_{k}" for k in KINDS], "base", "spans", "masked",
                        *[F.col("kept")[c].alias(c) for c in keep])
