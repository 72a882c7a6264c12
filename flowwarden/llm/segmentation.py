"""Sampled segmentations of texts into vocabulary pieces, and decoding.

A text becomes one lattice: an edge for every piece of the vocabulary that matches, for a character without a piece one
edge of byte pieces.  Edges weigh by their piece, and a path's probability is the product of its edges' over the sum
of all paths.  No piece crosses from a character to a following space, so the lattice is a chain of small lattices
(chunks), whose sums and edge probabilities are computed for all distinct chunks of a slice at once.

Distinct segmentations are drawn without replacement by an A-star search over perturbed sums.  A set of paths has the
log of its probability as location of a Gumbel variable, truncated at the value of the set it was split from.  The set
of the highest value is taken from the queue, a path is sampled from it, and the rest is split: same chunks up to j, a
different chunk j, anything after.  Paths come out in the order of their perturbed log-probabilities; the highest
value left is the threshold from which the inclusion score of each path follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwarden.llm.words import BYTE_BASE, MIX_1, MIX_2, OTHER_BASE, WORD_BASE, mix, powers, slices

#: Fixed value: the character that stands for a space inside pieces.
SPACE = 0x2581
_LITERAL = 0x110001  # the same character in a text, which must not become a space
SLICE_BYTES = 1 << 20
_ALL = (1 << 64) - 1
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _span_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(OTHER_BASE, len(total))
    return mix((total[end] - total[start]) * down[start])


def _prefix_sums(codes: np.ndarray) -> np.ndarray:
    up, _ = powers(OTHER_BASE, len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix((codes + 1).astype(np.uint64)) * up[:len(codes)], out=total[1:])
    return total


@dataclass
class Vocabulary:
    """Pieces by hash: a probing table of hashes, their piece (-1: only the beginning of pieces) and weight."""

    keys: np.ndarray
    piece: np.ndarray
    probes: int
    weight: np.ndarray
    byte_ids: np.ndarray
    longest: int
    pieces: list[bytes]

    @staticmethod
    def read(model_path: str, power: float = 0.5) -> "Vocabulary":
        """From a SentencePiece model file, on the driver.

        A piece of rank r (by score) has the weight (r + 1) ** -power, byte pieces that of the last rank.
        """
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        byte = [model.is_byte(i) for i in range(n)]
        usable = sorted((i for i in range(n) if not special[i] and not byte[i]), key=lambda i: (-model.get_score(i), i))
        weight = np.full(n, -power * np.log(n + 1.0))
        weight[usable] = -power * np.log(np.arange(len(usable)) + 1.0)
        byte_ids = np.full(256, -1, np.int64)
        for i in range(n):
            if byte[i]:
                byte_ids[int(names[i][3:5], 16)] = i
        entries: dict[int, int] = {}
        for i in usable:
            codes = np.array([ord(c) for c in names[i]], np.int64)
            total = _prefix_sums(codes)
            ends = np.arange(1, len(codes) + 1)
            for end, h in zip(ends, _span_hash(total, np.zeros(len(ends), np.int64), ends).tolist()):
                if end == len(codes):
                    entries[h] = i
                else:
                    entries.setdefault(h, -1)
        size = 1 << (len(entries) * 4).bit_length()
        keys, piece, probes = np.zeros(size, np.uint64), np.full(size, -1, np.int64), 1
        for h, i in entries.items():
            at, tries = h & (size - 1), 1
            while keys[at]:
                at, tries = (at + 1) & (size - 1), tries + 1
            keys[at], piece[at], probes = h, i, max(probes, tries)
        out = [bytes([int(names[i][3:5], 16)]) if byte[i] else b"" if special[i] else
               names[i].replace(chr(SPACE), " ").encode() for i in range(n)]
        return Vocabulary(keys, piece, probes, weight, byte_ids, max(len(names[i]) for i in usable), out)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes begin a piece, and the piece that each is, or -1."""
        at = (hashes & np.uint64(len(self.keys) - 1)).astype(np.int64)
        piece, known = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), bool)
        open_ = np.arange(len(hashes))
        for _ in range(self.probes):
            key = self.keys[at[open_]]
            hit = key == hashes[open_]
            piece[open_[hit]], known[open_[hit]] = self.piece[at[open_[hit]]], True
            open_ = open_[~hit & (key != 0)]
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
        return known, piece


class Lattice:
    """The lattices of distinct chunks: nodes numbered by their distance from the end of their chunk, edges by node.

    Of each edge: ``piece`` (below zero: a character's bytes), ``target``, ``chance`` among the edges of its node, its
    ``log``, and ``upto``, the running sum of the chances, longest edge first.  All ends of chunks are one last node.
    """

    def __init__(self, codes: np.ndarray, bounds: np.ndarray, vocabulary: Vocabulary):
        n, lengths = len(codes), np.diff(bounds)
        total, ends = _prefix_sums(codes), np.repeat(bounds[1:], lengths)
        away = ends - np.arange(n)
        order = np.argsort(away, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        self.begin, self.last = rank[bounds[:-1]] if n else bounds[:-1], n
        levels, open_ = [], np.arange(n)
        for length in range(1, vocabulary.longest + 1):
            open_ = open_[open_ + length <= ends[open_]]
            known, piece = vocabulary.find(_span_hash(total, open_, open_ + length))
            open_, piece = open_[known], piece[known]
            real = piece >= 0
            source, piece, weight = open_[real], piece[real], vocabulary.weight[piece[real]]
            if length == 1:  # characters without a piece: their bytes
                alone = np.ones(n, bool)
                alone[source] = False
                alone = np.flatnonzero(alone)
                source, piece = np.r_[source, alone], np.r_[piece, -1 - codes[alone]]
                weight = np.r_[weight, vocabulary.weight[vocabulary.byte_ids[0]] * _n_bytes(codes[alone])]
            levels.append((length, source, piece, weight))
            if not len(open_):
                break
        degree = np.zeros(n, np.int64)
        for _, source, _, _ in levels:
            degree[rank[source]] += 1
        self.first = np.r_[0, np.cumsum(degree)]
        size, fill = int(self.first[-1]), self.first[:-1].copy()
        self.piece, self.target, value = np.empty(size, np.int64), np.empty(size, np.int64), np.empty(size)
        for length, source, piece, weight in reversed(levels):
            at = fill[rank[source]]
            fill[rank[source]] += 1
            self.piece[at], value[at] = piece, weight
            to = source + length
            self.target[at] = np.where(to < ends[source], rank[np.minimum(to, n - 1)], n)
        # sums from the end of each chunk, one distance after another
        beta = np.zeros(n + 1)
        sorted_away = away[order]
        layer = np.r_[np.flatnonzero(np.r_[True, sorted_away[1:] != sorted_away[:-1]]), n] if n else np.zeros(1, np.int64)
        for low, high in zip(layer[:-1], layer[1:]):
            a, b = self.first[low], self.first[high]
            value[a:b] += beta[self.target[a:b]]
            beta[low:high] = np.logaddexp.reduceat(value[a:b], self.first[low:high] - a)
        self.log = np.minimum(value - np.repeat(beta[:-1], degree), 0.0)
        self.chance = np.exp(self.log)
        self.upto = self.chance.copy()
        more, k = np.flatnonzero(degree > 1), 1
        while len(more):
            at = self.first[more] + k
            self.upto[at] += self.upto[at - 1]
            k += 1
            more = more[degree[more] > k]

    def sample(self, chunks: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One path through each given chunk: pieces of all paths in order, where each path ends, log-probabilities."""
        alive, at = np.arange(len(chunks)), self.begin[chunks]
        log, length = np.zeros(len(chunks)), np.zeros(len(chunks), np.int64)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(alive):
            edge, last = self.first[at], self.first[at + 1] - 1
            u = _uniform(keys[alive], len(steps)) * self.upto[last]
            behind = np.flatnonzero((self.upto[edge] <= u) & (edge < last))
            while len(behind):
                edge[behind] += 1
                on = edge[behind]
                behind = behind[(self.upto[on] <= u[behind]) & (on < last[behind])]
            steps.append((alive, self.piece[edge]))
            log[alive] += self.log[edge]
            length[alive] += 1
            at = self.target[edge]
            open_ = at != self.last
            alive, at = alive[open_], at[open_]
        ends = np.cumsum(length)
        pieces = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        for n, (who, piece) in enumerate(steps):
            pieces[ends[who] - length[who] + n] = piece
        return pieces, ends, log

    def _edges(self, at: int) -> dict[int, tuple[float, float, int]]:
        """Edges of a node: piece to probability, its log, and the node it leads to."""
        edges = slice(self.first[at], self.first[at + 1])
        return dict(zip(self.piece[edges].tolist(), zip(
            self.chance[edges].tolist(), self.log[edges].tolist(), self.target[edges].tolist())))

    def other(self, chunk: int, excluded: list[tuple[int, ...]], key: int) -> tuple[tuple[int, ...], float]:
        """A path through one chunk that is none of ``excluded``, in proportion to probability, and its log-probability.

        At each node an edge has its probability less that of the excluded paths that go on through it.
        """
        at, path, log = int(self.begin[chunk]), [], 0.0
        while at != self.last:
            edges = self._edges(at)
            alike = [x for x in excluded if list(x[:len(path)]) == path]
            free = {}
            for piece, (chance, *_) in edges.items():
                rest = chance - sum(self._chance(at, x[len(path):]) for x in alike if x[len(path)] == piece)
                if rest > 1e-15 * chance:
                    free[piece] = rest
            u = _uniform_of(key, 1000 + len(path)) * sum(free.values())
            for piece, rest in free.items():
                u -= rest
                if u < 0:
                    break
            path.append(piece)
            log += edges[piece][1]
            at = edges[piece][2]
        return tuple(path), log

    def _chance(self, at: int, path: tuple[int, ...]) -> float:
        out = 1.0
        for piece in path:
            chance, _, at = self._edges(at)[piece]
            out *= chance
        return out


def _n_bytes(code: np.ndarray) -> np.ndarray:
    code = np.where(code == _LITERAL, SPACE, code)
    return 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)


def _uniform(keys: np.ndarray, step: int) -> np.ndarray:
    """Numbers in (0, 1) from keys and a step."""
    return ((mix(keys + np.uint64((step + 1) * BYTE_BASE & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def _uniform_of(key: int, step: int) -> float:
    """The same number for one key, without an array."""
    x = (key + (step + 1) * BYTE_BASE) & _ALL
    x = ((x ^ (x >> 30)) * MIX_1) & _ALL
    x = ((x ^ (x >> 27)) * MIX_2) & _ALL
    return (((x ^ (x >> 31)) >> 11) + 0.5) / 2.0**53


def _gumbel_below(location: np.ndarray, top: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Gumbel variables of the given locations, none above ``top``."""
    with np.errstate(over="ignore", divide="ignore"):
        return top - np.logaddexp(0.0, np.log(-np.log(_uniform(keys, 5000))) + top - location)


def _rest(log: np.ndarray) -> np.ndarray:
    """log(1 - exp(log)); minus infinity where nothing is left."""
    left = -np.expm1(np.minimum(log, 0.0))
    return np.where(left > 1e-12, np.log(np.maximum(left, 1e-300)), -np.inf)


@dataclass
class _Text:
    """Search state of one text: sampled paths (pieces, end of each chunk, log of each chunk), and the queue of sets."""

    chunks: np.ndarray
    key: int
    paths: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    values: list[float]
    queue: list[tuple[np.ndarray, int, np.ndarray, list]]

    def take(self) -> tuple[float, int, int, list] | None:
        """Remove the set of the highest value: value, path it shares chunks with, chunk that differs, excluded there."""
        best = max(range(len(self.queue)), key=lambda q: self.queue[q][0].max(initial=-np.inf), default=None)
        if best is None:
            return None
        values, path, first, excluded = self.queue[best]
        at = int(values.argmax()) if len(values) else 0
        if not len(values) or values[at] == -np.inf:
            return None
        value = float(values[at])
        values[at] = -np.inf
        return value, path, first + at, list(excluded) if at == 0 else []

    def excluded_at(self, path: int, chunk: int) -> list:
        pieces, ends, log = self.paths[path]
        return [(tuple(pieces[ends[chunk - 1] if chunk else 0:ends[chunk]].tolist()), float(log[chunk]))]


def _split(parts: list[tuple[_Text, float, int, list]]) -> None:
    """Put the rest of each set, of which its text's last path was sampled, into the queue as disjoint sets.

    Each part has the text, the set's value, the first chunk that may differ and the paths excluded there.
    """
    if not parts:
        return
    logs = [s.paths[-1][2][first:] for s, _, first, _ in parts]
    sizes = np.array(list(map(len, logs)))
    begin = np.cumsum(sizes) - sizes
    log = np.concatenate(logs)
    before = np.cumsum(log) - log
    shared = np.array([s.paths[-1][2][:first].sum() for s, _, first, _ in parts])
    before += np.repeat(shared - before[begin], sizes)
    for at, (_, _, _, excluded) in zip(begin, parts):
        for _, x_log in excluded:
            log[at] = np.logaddexp(log[at], x_log)
    location = before + _rest(log)
    each = np.array([[s.key, len(s.paths) * OTHER_BASE & 0xFFFFFFFFFFFFFFFF, first] for s, _, first, _ in parts], np.uint64)
    number = (np.arange(len(log)) - np.repeat(begin, sizes)).astype(np.uint64) + np.repeat(each[:, 2], sizes)
    keys = np.repeat(each[:, 0], sizes) ^ mix(number * np.uint64(WORD_BASE) + np.repeat(each[:, 1], sizes))
    top = np.repeat(np.array([value for _, value, _, _ in parts]), sizes)
    finite = np.isfinite(location)
    values = np.where(finite, _gumbel_below(np.where(finite, location, 0.0), top, keys), -np.inf)
    for at, size, (s, _, first, excluded) in zip(begin, sizes, parts):
        # where chunk ``first`` differs, all paths seen there so far are excluded; later chunks only exclude this path's
        s.queue.append((values[at:at + size], len(s.paths) - 1, first,
                        [*excluded, *s.excluded_at(len(s.paths) - 1, first)]))


def _codes(text: str) -> np.ndarray:
    codes = np.frombuffer((chr(SPACE) + text).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    body = codes[1:]
    body[body == SPACE] = _LITERAL
    body[body == 32] = SPACE
    return codes


def _to_ids(pieces: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Pieces with byte edges (negative) spelled out."""
    pieces = np.where((pieces < 0) & (pieces >= -128), vocabulary.byte_ids[np.clip(-1 - pieces, 0, 127)], pieces)
    spelled = np.flatnonzero(pieces < 0)
    if not len(spelled):
        return pieces.astype(np.int32)
    out: list[np.ndarray] = []
    at = 0
    for i in spelled:
        code = -1 - int(pieces[i])
        raw = chr(SPACE if code == _LITERAL else code).encode("utf-8", "surrogatepass")
        out += [pieces[at:i], vocabulary.byte_ids[list(raw)]]
        at = i + 1
    return np.concatenate([*out, pieces[at:]]).astype(np.int32)


def sample_texts(texts: list[str], keys: np.ndarray, vocabulary: Vocabulary, samples: int):
    """For each text its sampled segmentations: (ids, log-probability, perturbed value, inclusion score), best first."""
    codes = [_codes(t) if t else np.empty(0, np.int64) for t in texts]
    flat = np.concatenate(codes) if codes else np.empty(0, np.int64)
    text_start = np.cumsum([0, *map(len, codes)])
    begins = flat == SPACE
    begins[1:] &= ~begins[:-1]
    begins[text_start[:-1][text_start[:-1] < len(flat)]] = True
    start = np.flatnonzero(begins)
    end = np.r_[start[1:], len(flat)] if len(start) else start
    total = _prefix_sums(flat)
    hashes = _span_hash(total, start, end) ^ (end - start).astype(np.uint64)
    _, example, kind = np.unique(hashes, return_index=True, return_inverse=True)
    lengths = (end - start)[example]
    bounds = np.cumsum(np.r_[0, lengths])
    distinct = flat[np.repeat(start[example] - bounds[:-1], lengths) + np.arange(bounds[-1])]
    lattice = Lattice(distinct, bounds, vocabulary)

    chunk_start = np.searchsorted(start, text_start)
    chunk_keys = np.repeat(keys, np.diff(chunk_start)) ^ mix(
        (np.arange(len(start)) - np.repeat(chunk_start[:-1], np.diff(chunk_start))).astype(np.uint64) * np.uint64(WORD_BASE))
    pieces, ends, log = lattice.sample(kind, chunk_keys)
    piece_start = np.r_[0, ends]
    state: list[_Text] = []
    highest = -np.log(-np.log(_uniform(keys, 7000)))
    for i, key in enumerate(keys.tolist()):
        a, b = chunk_start[i], chunk_start[i + 1]
        own = pieces[piece_start[a]:piece_start[b]], ends[a:b] - piece_start[a], log[a:b]
        state.append(_Text(kind[a:b], key, [own], [float(highest[i])], []))
    _split([(s, s.values[0], 0, []) for s in state if len(s.chunks)])
    for n in range(1, samples):
        taken = [(i, got) for i, s in enumerate(state) if len(s.paths) == n and (got := s.take())]
        # the chunks after the one that differs are sampled for all texts together
        after = [np.arange(chunk_start[i] + got[2] + 1, chunk_start[i + 1]) for i, got in taken]
        where = np.concatenate(after) if after else np.empty(0, np.int64)
        fresh, fresh_ends, fresh_log = lattice.sample(kind[where], chunk_keys[where] ^ mix(np.array([n], np.uint64)))
        fresh_start, at = np.r_[0, fresh_ends], 0
        for (i, (value, path, chunk, excluded)), mine in zip(taken, after):
            s = state[i]
            old, old_ends, old_log = s.paths[path]
            excluded = excluded or s.excluded_at(path, chunk)
            new, new_log = lattice.other(int(s.chunks[chunk]), [x for x, _ in excluded],
                                         int(s.key) ^ (n * OTHER_BASE & 0xFFFFFFFFFFFFFFFF))
            shared = int(old_ends[chunk - 1]) if chunk else 0
            low, high = at, at + len(mine)
            tail_ends = fresh_ends[low:high] - fresh_start[low]
            s.paths.append((np.concatenate([old[:shared], np.array(new, np.int64), fresh[fresh_start[low]:fresh_start[high]]]),
                            np.concatenate([old_ends[:chunk], [shared + len(new)], tail_ends + shared + len(new)]),
                            np.concatenate([old_log[:chunk], [new_log], fresh_log[low:high]])))
            s.values.append(value)
            at = high
        _split([(state[i], value, chunk, excluded or state[i].excluded_at(path, chunk))
                for i, (value, path, chunk, excluded) in taken])
    out = []
    for s in state:
        left = max((float(v.max(initial=-np.inf)) for v, *_ in s.queue), default=-np.inf)
        rows = []
        for (pieces_, _, log_), value in zip(s.paths, s.values):
            log_p = float(log_.sum())
            share = 1.0 if left == -np.inf else float(-np.expm1(-np.exp(min(log_p - left, 700.0))))
            rows.append((_to_ids(pieces_, vocabulary), log_p, value, share))
        out.append(rows)
    return out


def _text_of(ids: np.ndarray, pieces: list[bytes]) -> bytes:
    """Bytes that pieces spell; the space before the first piece goes."""
    return b"".join([pieces[i] for i in ids.tolist()]).removeprefix(b" ")


def encode(docs: DataFrame, vocabulary: Vocabulary, samples: int = 2, seed: int = 1, keep: tuple[str, ...] = (),
           id_col: str = "doc_id", text_col: str = "text", verify: bool = False) -> DataFrame:
    """``samples`` distinct segmentations of every row's whole text: id, rank, ids, log_prob, perturbed, inclusion, ``keep``.

    Drawn without replacement in proportion to probability, seeded by the id and the seed; ranks (from 1) follow the
    perturbed log-probability.  ``inclusion`` is the chance of a segmentation to exceed the highest value not drawn.
    A text with fewer segmentations gets those, all with inclusion 1; an empty or null text has one, without pieces.
    Rows of one id and text draw the same; a null id is an id of its own.  An empty table gives an empty result.
    With ``verify`` every segmentation is decoded again where it was drawn, which adds ``decoded_sha256`` and
    ``lossless`` (the pieces give the row's text back) without sending ids or texts anywhere.
    """
    spark = docs.sparkSession
    if spark.conf.get(BATCH_BYTES, None) in (None, str((1 << 31) - 1)):
        spark.conf.set(BATCH_BYTES, str(4 << 20))  # texts differ in length by orders of magnitude: batches are bound by bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_BYTES):
            keys = mix(batch.column("key").to_numpy().view(np.uint64))
            drawn = sample_texts(batch.column("text").to_pylist(), keys, vocabulary, samples)
            row = pa.array(np.repeat(np.arange(len(drawn)), [len(d) for d in drawn]))
            every = [x for d in drawn for x in d]
            ids = [x[0] for x in every]
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            columns = [
                batch.column("id").take(row), pa.array([r for d in drawn for r in range(1, len(d) + 1)], pa.int32()),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids) if ids else [], pa.int32())),
                *[pa.array([x[i] for x in every], pa.float64()) for i in (1, 2, 3)], batch.column("kept").take(row)]
            names = ["id", "rank", "ids", "log_prob", "perturbed", "inclusion", "kept"]
            if verify:
                given = batch.column("text").cast(pa.binary())
                digests, same = [], []
                for r, x in zip(row.to_pylist(), ids):
                    text = _text_of(x, vocabulary.pieces)
                    digests.append(hashlib.sha256(text).hexdigest())
                    same.append(text == given[r].as_py())
                columns += [pa.array(digests, pa.string()), pa.array(same, pa.bool_())]
                names += ["decoded_sha256", "lossless"]
            yield pa.RecordBatch.from_arrays(columns, names)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(F.lit(seed), id_col).alias("key"),
                       F.struct(*[F.col(c) for c in keep] or [F.lit(1).alias("one")]).alias("kept"))
    kept_type = rows.schema["kept"].dataType.simpleString()
    checks = ("decoded_sha256", "lossless") if verify else ()
    drawn = rows.mapInArrow(run, "id long, rank int, ids array<int>, log_prob double, perturbed double, inclusion double, "
                                 f"kept {kept_type}" + (", decoded_sha256 string, lossless boolean" if verify else ""))
    return drawn.select(F.col("id").alias(id_col), "rank", "ids", "log_prob", "perturbed", "inclusion", *checks,
                        *[F.col("kept")[c].alias(c) for c in keep])


def decode(rows: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of each row's pieces; encoding and decoding gives every text back exactly.

    The space before the first piece goes.  Null ids give null, ids outside the vocabulary end the job with an error.
    """
    pieces = vocabulary.pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                kept = batch.column("kept").slice(low, 500)
                texts = []
                for ids in kept.field(ids_col):
                    raw = None
                    if ids.is_valid:
                        raw = _text_of(ids.values.to_numpy(), pieces)
                    texts.append(raw)
                yield pa.RecordBatch.from_arrays([kept, pa.array(texts, pa.binary()).cast(pa.string())], ["kept", "text"])

    given = rows.select(F.struct(*rows.columns).alias("kept"))
    found = given.mapInArrow(run, f"kept {given.schema['kept'].dataType.simpleString()}, text string")
    return found.select(*[F.col("kept")[c].alias(c) for c in rows.columns], F.col("text").alias(out))
