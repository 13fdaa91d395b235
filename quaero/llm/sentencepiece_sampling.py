"""Sampled segmentations of texts into pieces of a SentencePiece model, and back.

A text's segmentations are the paths of a lattice; a path is drawn with a probability that falls
with the ranks of its pieces. Distinct paths come out by Gumbel top-k: every path has its
log probability plus Gumbel noise, and the k largest are a sample without replacement. They are found
by A* over *perturbed* upper bounds instead of by listing paths: the largest value below a node is a
Gumbel variable of the node's total probability, bounded by its parent's, so noise is drawn for
nodes that are opened only. The value that comes next after the k-th gives each path's inclusion
probability.

Pieces never reach across the start of a word, nor across every ``LONGEST_UNIT``-th character of a longer
one, so the lattice is a chain of short lattices (units).
Opening a node means drawing the rest of its path, and all "other ways" through a unit
stay one closed node until they are the best. The units of many texts go through the same array
operations; noise depends on the row key and the place in the text only, so a lost task
draws the same again.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain, islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.llm.common import give_back, lean
from quaero.llm.words import mix

SAMPLES = 2
SHARPNESS = 1.0  # of the distribution: 0 makes all segmentations equally likely
GROUP = 1 << 18  # characters of texts that are drawn together
EDGES = 3_000_000  # edges of lattices that stay, 17 bytes each
LONGEST_UNIT = 4_096  # a word of more characters is cut into units of so many
LISTED = 64  # ways of a unit that are listed where sums can't tell what is left
LONG_UNIT = 64  # longer units are laid out one by one
SPACE = "▁"
_UNITS = re.compile(rf"\n|{SPACE}{{0,{LONGEST_UNIT}}}[^{SPACE}\n]{{1,{LONGEST_UNIT}}}|{SPACE}{{1,{LONGEST_UNIT}}}")
_STEP = np.uint64(0x9E3779B97F4A7C15)  # fixed value: stride of the noise counter


class Model:
    """Pieces by the hash of their characters, with the log weight of each."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.shown = list(self.pieces)
        for b, i in self.bytes.items():
            self.shown[i] = chr(b) if b < 0x80 else chr(0xDC00 + b)
        spelled = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in self.bytes.items():
            spelled[i] = bytes([b])
        self.spelled = pa.array(spelled, pa.large_binary())
        self.byte_ids = np.array([self.bytes.get(b, -2 - b) for b in range(0x80)], dtype=np.int32)
        plain = [
            i for i in range(n)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        self.longest = max(len(self.pieces[i]) for i in plain)
        lengths = np.array([len(self.pieces[i]) for i in plain])
        codes = np.zeros((len(plain), self.longest), dtype=np.uint64)
        inside = np.arange(self.longest) < lengths[:, None]
        codes[inside] = np.frombuffer("".join(self.pieces[i] for i in plain).encode("utf-32-le"), dtype=np.uint32)
        hashes, h = np.zeros(len(plain), dtype=np.uint64), np.zeros(len(plain), dtype=np.uint64)
        self.prefixes = np.zeros(1 << 22, dtype=bool)  # runs that a longer piece begins with, by hash
        for size in range(1, self.longest + 1):
            h = self.extend(h, codes[:, size - 1])
            hashes[lengths == size] = mix(h[lengths == size])
            self.prefixes[(mix(h[lengths > size]) >> np.uint64(42)).astype(np.int64)] = True
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(plain, dtype=np.int32)[order]
        # the rank of a piece stands for its frequency: weight by Zipf's law
        ranks = np.array([min(max(0.0, -model.get_score(i)), n) for i in plain])
        self.weights = (-SHARPNESS * np.log(2 + ranks))[order]
        self.byte_weight = -SHARPNESS * np.log(2 + n)
        # where the hashes with each first 20 bits begin (-1: there are none), and how many these are at most
        begun, first, some = np.unique((self.hashes >> np.uint64(44)).astype(np.int64), return_index=True, return_counts=True)
        self.first = np.full(1 << 20, -1, dtype=np.int32)
        self.first[begun], self.deepest = first, int(some.max())
        self.lattices = Lattices(self)

    @staticmethod
    def extend(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return (h ^ (h >> np.uint64(32))) * _STEP + codes

    def begins(self, h: np.ndarray) -> np.ndarray:
        """Which mixed hashes of runs may begin a longer piece (a few more than do)."""
        return self.prefixes[(h >> np.uint64(42)).astype(np.int64)]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which mixed hashes of character runs are those of pieces, and the places of these in ``hashes``."""
        at = self.first[(h >> np.uint64(44)).astype(np.int64)]
        near = np.flatnonzero(at >= 0)
        at, h, which, places = at[near], h[near], [], []
        for _ in range(self.deepest):
            same = self.hashes[at] == h
            real, other = np.flatnonzero(same), np.flatnonzero(~same)
            which.append(near[real])
            places.append(at[real])
            near, at, h = near[other], np.minimum(at[other] + 1, len(self.hashes) - 1), h[other]
        return np.concatenate(which), np.concatenate(places)

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: no piece) and weights of mixed hashes of character runs."""
        ids, weights = np.full(len(h), -1, dtype=np.int32), np.full(len(h), -np.inf)
        real, places = self.find(h)
        ids[real], weights[real] = self.ids[places], self.weights[places]
        return ids, weights

    def units(self, text: str) -> list[str]:
        return _UNITS.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def distinct_units(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct units of texts, which of these each unit is, and how many units each text has.

        The units are those of ``units``: one begins with each text, at and behind each line end and at each
        run of space marks. Words that are cut, and texts that UTF-8 can't hold, go that way one by one.
        """
        spaced = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        try:
            spaced = [t.encode() for t in spaced]
        except UnicodeEncodeError:
            return self._listed_units(texts)
        raw = b"".join(spaced)
        chars = np.frombuffer(raw, dtype=np.uint8)
        text_ends = np.cumsum(np.fromiter(map(len, spaced), dtype=np.int64, count=len(spaced)))
        marks = np.flatnonzero(chars == 0xE2)  # a space mark is E2 96 81
        marks = marks[(chars[marks + 1] == 0x96) & (chars[marks + 2] == 0x81)]
        lines = np.flatnonzero(chars == 10)
        begins = np.zeros(len(chars) + 1, dtype=bool)
        begins[lines] = begins[lines + 1] = True
        begins[marks[np.diff(marks, prepend=-4) != 3]] = True
        begins[text_ends] = begins[0] = True
        offsets = np.flatnonzero(begins)
        if len(chars) and np.diff(offsets).max() > LONGEST_UNIT:
            return self._listed_units(texts)
        units = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(raw))
        units = units.dictionary_encode()
        return units.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(units.indices), np.diff(np.searchsorted(offsets, text_ends), prepend=0)

    def _listed_units(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        units, numbers = [self.units(t) for t in texts], {}
        which = [numbers.setdefault(u, len(numbers)) for u in chain.from_iterable(units)]
        return list(numbers), np.array(which, dtype=np.int64), np.array([len(u) for u in units], dtype=np.int64)

    def spell(self, samples: list[list[tuple]], texts: list[str]) -> list[bool]:
        """Whether all samples of each text are a blank and the text, piece by piece (no text: no pieces)."""
        raw = [t.encode() for t in texts]
        flat = [s[0] for one in samples for s in one]
        wanted = [b" " + t if t else t for t, one in zip(raw, samples) for _ in one]
        found = self.spelled.take(pa.array(np.concatenate([np.zeros(0, np.int32), *flat])))
        ends = np.frombuffer(found.buffers()[1], dtype=np.int64)[np.cumsum([0, *map(len, flat)])]
        if np.array_equal(ends - ends[0], np.cumsum([0, *map(len, wanted)])):  # all at once; one by one where some aren't
            if not ends[-1] or found.buffers()[2].slice(ends[0], ends[-1] - ends[0]).equals(pa.py_buffer(b"".join(wanted))):
                return [True] * len(texts)
        return [all(self.spells(s[0], t) for s in one) for t, one in zip(raw, samples)]

    def spells(self, ids: np.ndarray, raw: bytes) -> bool:
        """Whether the pieces are a blank and these bytes, one after the other."""
        if not len(ids):
            return not raw
        found = self.spelled.take(pa.array(ids))
        ends = np.frombuffer(found.buffers()[1], dtype=np.int64)
        return bytes(memoryview(found.buffers()[2])[ends[0] : ends[len(ids)]]) == b" " + raw

    def decode(self, ids) -> str:
        """The text of a sequence of ids (any ids: broken byte runs become replacement marks)."""
        text = "".join(map(self.shown.__getitem__, ids)).replace(SPACE, " ")
        if not text.isascii():  # bytes beyond ASCII stand there one by one
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class Lattices:
    """The lattices of distinct units, one after the other: rows are end positions, edges are pieces.

    The edges of a row are the pieces that end there, by size; ``cum`` is the probability that the
    piece is this one or a shorter one, ``other`` the log probability that it isn't this one. ``many`` is
    the number of ways through a unit, ``asked`` how often it was asked for. Lattices stay for the next texts
    until ``EDGES`` are there; then those asked for again and again stay, up to three quarters as many edges.
    """

    def __init__(self, model: Model, most: int = EDGES) -> None:
        self.model, self.most = model, most
        self.cum, self.logp, self.other = (np.zeros(0, np.float32) for _ in range(3))
        self.ids, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int8)
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.lengths, self.base, self.asked = (np.zeros(0, np.int64) for _ in range(3))
        self.from_ = np.zeros(1, dtype=np.int64)  # where a row's edges begin
        self.many, self.rows, self.used = np.zeros(0), 0, 0  # the room for edges stays

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        """Values from this place of a column on; it grows with room for a quarter more."""
        column, end = getattr(self, name), at + len(values)
        if end > len(column):
            column = np.concatenate([column[:at], np.zeros(end - at + end // 4, column.dtype)])
            setattr(self, name, column)
        column[at:end] = values

    def add(self, units: list[str] | Iterator[str], n: int) -> np.ndarray:
        """The numbers of ``n`` units; those that are not there yet are laid out."""
        if self.used > self.most:
            self._keep_asked()
        units, known = list(units), len(self.numbers)
        found = np.fromiter(map(self.numbers.get, units, repeat(-1)), dtype=np.int64, count=n)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            of_new = [units[i] for i in missing.tolist()]
            new = list(dict.fromkeys(of_new))
            self.numbers.update(zip(new, range(known, known + len(new))))
            found[missing] = np.fromiter(map(self.numbers.__getitem__, of_new), dtype=np.int64, count=len(missing))
            self._add_new(new)
        np.add.at(self.asked, found, 1)
        return found

    def _keep_asked(self) -> None:
        """Only the units that were asked for most often stay, none of those asked for once."""
        n = len(self.numbers)
        first = self.from_[self.base[:n]]
        edges = self.from_[self.base[:n] + self.lengths[:n] + 1] - first
        order = np.argsort(-self.asked[:n], kind="stable")
        order = order[self.asked[order] > 1]
        kept = np.sort(order[np.cumsum(edges[order]) <= self.most * 3 // 4])
        if not len(kept):
            return self._clear()
        names = list(self.numbers)
        self.numbers = dict(zip(map(names.__getitem__, kept.tolist()), range(len(kept))))
        lengths, edges = self.lengths[kept], edges[kept]
        counts = np.diff(self.from_)[_ranges(self.base[kept], lengths + 1)]
        at = _ranges(first[kept], edges)
        for name in ("cum", "logp", "other", "ids", "sizes"):
            column = getattr(self, name)
            column[: len(at)] = column[at]
        self.used, self.rows, self.from_ = len(at), len(counts), np.r_[0, np.cumsum(counts)]
        self.lengths, self.base = lengths, np.cumsum(lengths + 1) - (lengths + 1)
        self.many, self.asked = self.many[kept], self.asked[kept] // 2

    def _add_new(self, new: list[str]) -> None:
        lengths = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
        order = np.argsort(lengths, kind="stable")
        known = len(self.numbers) - len(new)
        self._put("lengths", known, lengths)
        self._put("asked", known, np.zeros(len(new), np.int64))
        new, lengths = [new[i] for i in order], lengths[order]
        base = np.empty(len(new), dtype=np.int64)
        base[order] = self.rows + np.cumsum(lengths + 1) - (lengths + 1)
        self._put("base", known, base)
        parts, many, at = [], np.empty(len(new)), 0
        while at < len(new):
            longest = int(lengths[at]) * 5 // 4 + 2  # units of about one length together
            some = 1 if longest > LONG_UNIT else max(1, 40_000 // longest)
            end = min(int(np.searchsorted(lengths, longest, "right")), at + some)
            *part, many[order[at:end]] = self._lay_out(new[at:end], lengths[at:end])
            parts.append(part)
            at = end
        self._put("many", known, many)
        counts, *columns = map(np.concatenate, zip(*parts))
        self._put("from_", self.rows + 1, self.used + np.cumsum(counts))
        for name, values in zip(("cum", "logp", "other", "ids", "sizes"), columns):
            self._put(name, self.used, values)
        self.rows, self.used = self.rows + len(counts), self.used + len(columns[0])

    def _lay_out(self, units: list[str], lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """Forward pass over units of about one length: edges by row, and what they hold."""
        n, model = int(lengths[-1]), self.model
        codes = np.zeros((len(units), n), dtype=np.uint64)
        codes[np.arange(n) < lengths[:, None]] = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = codes.ravel()
        ends = np.repeat(np.arange(len(units)) * n + lengths, lengths)  # behind each unit's last character
        at = ends - 1 - (np.arange(len(ends)) - np.repeat(np.cumsum(lengths) - lengths, lengths))
        h, edges = np.zeros(len(at), dtype=np.uint64), []
        for size in range(1, model.longest + 1):  # all runs of one size at once, as long as they begin a piece
            h = model.extend(h, codes[at + size - 1])
            mixed = mix(h)
            real, places = model.find(mixed)
            ids, weights = model.ids[places], model.weights[places]
            if size == 1 and len(real) < len(at):  # characters without a piece are spelled in bytes
                odd = np.setdiff1d(np.arange(len(at)), real)
                c = codes[at[odd]]
                spelled = -2 - c.astype(np.int32)
                spelled = np.where(c < 0x80, model.byte_ids[np.minimum(c, 0x7F).astype(np.int64)], spelled)
                real, ids = np.r_[real, odd], np.r_[ids, spelled]
                weights = np.r_[weights, model.byte_weight * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))]
            unit, start = np.divmod(at[real], n)
            edges.append((unit, start + size, ids, weights))
            going = np.flatnonzero(model.begins(mixed) & (at + size < ends))
            if not len(going):
                break
            at, ends, h = at[going], ends[going], h[going]
        width = len(edges)
        # units lie side by side, so that a step adds long rows instead of many short ones
        total, many = np.zeros((n + 1, len(units))), np.zeros((n + 1, len(units)))
        scores = np.full((n + 1, width, len(units)), -np.inf, dtype=np.float32)  # by end position
        for size, (unit, end, ids, weights) in enumerate(edges, 1):
            scores[end, size - 1, unit] = weights
        many[0] = 1
        with np.errstate(divide="ignore", invalid="ignore"):  # behind the end of a shorter unit
            for end in range(1, n + 1):
                sizes = min(width, end)
                s = scores[end, :sizes]
                many[end] = np.minimum(((s != -np.inf) * many[end - sizes : end][::-1]).sum(0), 1e300)
                s += total[end - sizes : end][::-1].astype(np.float32)
                top = s.max(0)
                total[end] = top + np.log(_added(np.exp(s - top)))
                s -= total[end].astype(np.float32)
        rows = [unit * (n + 1) + end for unit, end, *_ in edges]
        counts = np.bincount(np.concatenate(rows), minlength=len(units) * (n + 1))
        place = np.cumsum(counts) - counts
        logp = np.empty(sum(map(len, rows)), dtype=np.float32)
        which, sizes = np.empty(len(logp), dtype=np.int32), np.empty(len(logp), dtype=np.int8)
        for size, (row, (unit, end, ids, _)) in enumerate(zip(rows, edges), 1):
            at = place[row]  # an end has one edge of a size
            place[row] += 1
            logp[at], which[at], sizes[at] = scores[end, size - 1, unit], ids, size
        counts = counts.reshape(len(units), n + 1)[np.arange(n + 1) <= lengths[:, None]]
        ends = np.cumsum(counts)
        mass = np.exp(logp.astype(np.float64))
        sums = np.cumsum(mass)
        before = np.r_[0.0, sums][ends - counts]
        cum = (sums - np.repeat(before, counts)).astype(np.float32)
        cum[ends[counts > 0] - 1] = 2  # the longest piece ends the range
        # an edge that weighs more than the others of its row: add these up, for 1 less the edge cancels out
        most = mass > 0.5
        some = counts > 0
        others = np.zeros(len(counts))
        others[some] = np.add.reduceat(np.where(most, 0.0, mass), (ends - counts)[some])
        rest = np.where(most, np.repeat(others, counts), 1.0 - mass)
        with np.errstate(divide="ignore"):
            other = np.log(rest).astype(np.float32)
        return counts, cum, logp, other, which, sizes, many[lengths, np.arange(len(units))]

    def draw(self, units: np.ndarray, keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, ...]:
        """A segmentation of each unit: piece counts, all ids, log probabilities, and those of any other.

        ``keys`` and ``places`` (the unit's first character in its text) decide the noise.
        """
        n = len(units)
        logp, rest, counts = np.zeros(n), np.zeros(n), np.zeros(n, dtype=np.int64)
        at, base, sofar, parted = self.lengths[units], self.base[units], np.zeros(n), np.zeros(n)
        noises = counters(keys, places)
        active, steps = np.arange(n), []
        while len(active):
            edge = self.from_[base + at]
            noise = _uniform(noises + at.astype(np.uint64) * _STEP)
            pending = np.flatnonzero(self.cum[edge] <= noise)
            while len(pending):
                edge[pending] += 1
                pending = pending[self.cum[edge[pending]] <= noise[pending]]
            steps.append((active, self.ids[edge]))
            parted += np.exp(sofar + self.other[edge])  # another way parts here
            sofar += self.logp[edge]
            at -= self.sizes[edge]
            done = np.flatnonzero(at <= 0)
            if not len(done):
                continue
            ended = active[done]
            logp[ended], rest[ended], counts[ended] = sofar[done], parted[done], len(steps)
            left = np.flatnonzero(at > 0)
            active, at, base, sofar, parted, noises = (x[left] for x in (active, at, base, sofar, parted, noises))
        offsets = np.r_[0, np.cumsum(counts)]
        out = np.empty(offsets[-1], dtype=np.int32)
        for k, (who, ids) in enumerate(steps):  # the last piece of a unit was drawn first
            out[offsets[who + 1] - 1 - k] = ids
        with np.errstate(divide="ignore"):
            return counts, out, logp, np.log(rest)

    def edges(self, unit: int, at: int) -> range:
        row = self.base[unit] + at
        return range(self.from_[row], self.from_[row + 1])

    def others(self, units: np.ndarray, excluded: list[list[tuple]], keys: np.ndarray, places: np.ndarray) -> list[tuple]:
        """A segmentation of each unit that isn't excluded there, by its probability among the rest."""
        out: list[tuple] = [()] * len(units)
        left = np.arange(len(units))
        for attempt in range(16):
            own = mix(keys[left] + np.uint64(attempt + 1))
            counts, ids, logp, _ = self.draw(units[left], own, places[left])
            ends = np.r_[0, np.cumsum(counts)]
            again = []
            for k, who in enumerate(left):
                way = tuple(ids[ends[k] : ends[k + 1]].tolist())
                if way in excluded[who]:
                    again.append(who)
                else:
                    out[who] = (way, float(logp[k]))
            left = np.array(again, dtype=np.int64)
            if not again:
                return out
        for who in left:
            out[who] = self._rest(int(units[who]), excluded[who], keys[who : who + 1], places[who : who + 1])
        return out

    def _rest(self, unit: int, excluded: list[tuple], key: np.ndarray, place: np.ndarray) -> tuple:
        """What is excluded holds nearly all: draw among the most likely of the other ways."""
        listed = self.listed(unit, excluded)
        left = np.exp(np.array([logp for _, logp in listed]) - listed[0][1])
        want = float(uniform(mix(key), place)[0]) * left.sum()
        return listed[min(int(np.searchsorted(np.cumsum(left), want)), len(listed) - 1)]

    def listed(self, unit: int, excluded: list[tuple]) -> list[tuple]:
        """The ``LISTED`` most likely ways that aren't excluded."""
        gone = set(excluded)
        return list(islice((w for w in self.ways(unit) if w[0] not in gone), LISTED))

    def ways(self, unit: int) -> Iterator[tuple[tuple, float]]:
        """All segmentations of a unit, most likely first (A* with exact remainders)."""
        heap = [(0.0, (), int(self.lengths[unit]))]
        while heap:
            cost, ids, at = heapq.heappop(heap)
            if at == 0:
                yield ids, -cost
                continue
            for e in self.edges(unit, at):
                heapq.heappush(heap, (cost - float(self.logp[e]), (int(self.ids[e]), *ids), at - int(self.sizes[e])))

    def logp_of(self, unit: int, ids: tuple) -> float:
        at, logp = int(self.lengths[unit]), 0.0
        for i in reversed(ids):
            e = next(e for e in self.edges(unit, at) if self.ids[e] == i)
            logp += float(self.logp[e])
            at -= int(self.sizes[e])
        return logp


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """So many numbers from each start on, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _added(rows: np.ndarray) -> np.ndarray:
    """The sum of the rows, added in the order in which numpy adds the numbers of one row."""
    total, upto = rows[0], 1
    if len(rows) >= 8:
        upto = len(rows) // 8 * 8
        lanes = rows[:8]
        for at in range(8, upto, 8):
            lanes = lanes + rows[at : at + 8]
        pairs = lanes[::2] + lanes[1::2]
        total = (pairs[0] + pairs[1]) + (pairs[2] + pairs[3])
    for row in rows[upto:]:
        total = total + row
    return total


def counters(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    return keys + (places.astype(np.uint64) + np.uint64(1)) * _STEP


def uniform(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1 that depend on the key and the place only."""
    return _uniform(counters(keys, places))


def _uniform(h: np.ndarray) -> np.ndarray:
    h = mix(h)
    h >>= np.uint64(12)
    out = h.astype(np.float64)
    out += 0.5
    out *= 2.0**-52
    return out


def below(location: np.ndarray, bound: np.ndarray | float, keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Gumbel variables at ``location``, conditioned to stay below ``bound``."""
    noise = -np.log(-np.log(uniform(keys, places)))
    return -np.logaddexp(-bound, -(location + noise))


class _Branch:
    """A drawn path from the unit where it leaves its parent, with a closed node for each unit on.

    ``nodes`` are the values of the best other way through each unit; at the first unit, ways that
    other branches took are excluded.
    """

    __slots__ = ("excluded", "from_", "ids", "logp", "nodes", "offsets", "parent", "start", "value")

    def __init__(self, value: float, from_: int, parent: _Branch | None, excluded: list[tuple]) -> None:
        self.value, self.from_, self.parent, self.excluded = value, from_, parent, excluded
        self.start = parent.log_prob(from_) if parent else 0.0

    def log_prob(self, unit: int) -> float:
        """Log probability of the path before a unit."""
        if unit < self.from_:
            return self.parent.log_prob(unit)
        return self.start + float(self.logp[: unit - self.from_].sum())

    def path(self, unit: int) -> list[np.ndarray]:
        """The ids of the path before a unit."""
        if unit < self.from_:
            return self.parent.path(unit)
        before = self.parent.path(self.from_) if self.parent else []
        return [*before, self.ids[: self.offsets[unit - self.from_]]]

    def way(self, unit: int) -> tuple:
        a, b = self.offsets[unit - self.from_ : unit - self.from_ + 2]
        return tuple(self.ids[a:b].tolist())


def sample_group(model: Model, texts: list[str], keys: np.ndarray, k: int) -> list[list[tuple]]:
    """For each text up to ``k`` distinct segmentations: ``(ids, log probability, inclusion)``."""
    distinct, which, sizes = model.distinct_units(texts)
    lattices = model.lattices
    ends = np.r_[0, np.cumsum(sizes)]
    own = lattices.add(distinct, len(distinct))[which]
    units = sizes.tolist()
    chars = np.r_[0, np.cumsum(lattices.lengths[own])]
    places = chars[:-1] - np.repeat(chars[ends[:-1]], np.diff(ends))
    keys = mix(keys)
    branches: list[list[_Branch]] = [[] for _ in texts]
    # the best path of each text; its value is a Gumbel variable at 0 (all paths together)
    todo = [(t, 0, None, 0.0) for t in range(len(texts)) if units[t]]
    for j in range(k):
        if not todo:
            break
        which = np.array([t for t, *_ in todo])
        noise = mix(keys[which] + np.array([j + 1], dtype=np.uint64) * _STEP)
        if j == 0:
            values = below(np.zeros(len(todo)), np.inf, noise, np.full(len(todo), 1 << 41))
        else:
            values = np.array([value for *_, value in todo])
        first = np.array([ends[t] + f for t, f, *_ in todo])
        sizes = ends[which + 1] - first
        begin = np.r_[0, np.cumsum(sizes)]
        index = np.arange(begin[-1]) + np.repeat(first - begin[:-1], sizes)
        spread = np.repeat(noise, sizes)
        here, where = own[index], places[index]
        counts, ids, logp, rest = lattices.draw(here, spread, where)
        new = [_Branch(float(v), f, p, [*(p.excluded if f == p.from_ else []), p.way(f)] if p else [])
               for (_, f, p, _), v in zip(todo, values)]
        # the other ways through each unit, as one node
        open_ = lattices.many[here] > 1
        ways: list[tuple | None] = [None] * len(todo)
        if j:  # the first unit goes another way than before
            others = lattices.others(own[first], [b.excluded for b in new], noise, places[first])
            for n, (way, way_logp) in enumerate(others):
                unit, gone = int(own[first[n]]), [*new[n].excluded, way]
                logp[begin[n]] = way_logp
                ways[n] = way
                open_[begin[n]] = lattices.many[unit] > len(gone)
                if open_[begin[n]]:
                    left = 1.0 - sum(math.exp(lattices.logp_of(unit, e)) for e in gone)
                    if left < 1e-4:  # little more than what single precision loses: add up what is left
                        left = sum(math.exp(lp) for _, lp in lattices.listed(unit, gone))
                    rest[begin[n]] = math.log(max(left, 1e-300))
        sums = np.r_[0.0, np.cumsum(logp)]
        before = sums[:-1] + np.repeat(np.array([b.start for b in new]) - sums[begin[:-1]], sizes)
        nodes = np.full(len(logp), -np.inf)
        nodes[open_] = below(
            (before + np.maximum(rest, -700.0))[open_], np.repeat(values, sizes)[open_], spread[open_], where[open_] + (1 << 40)
        )
        drawn = np.r_[0, np.cumsum(counts)]
        again = []
        for n, (t, f, parent, _) in enumerate(todo):
            a, z = begin[n], begin[n + 1]
            b = new[n]
            b.logp, b.nodes = logp[a:z], nodes[a:z]
            if ways[n] is None:
                b.offsets, b.ids = drawn[a : z + 1] - drawn[a], ids[drawn[a] : drawn[z]]
            else:
                tail = drawn[a + 1 : z + 1] - drawn[a + 1] + len(ways[n])
                b.offsets = np.r_[0, tail]
                b.ids = np.r_[np.array(ways[n], dtype=np.int32), ids[drawn[a + 1] : drawn[z]]]
            branches[t].append(b)
            # the best closed node of all branches is opened next
            best = max(branches[t], key=lambda x: x.nodes.max())
            at = int(best.nodes.argmax())
            if np.isfinite(best.nodes[at]):
                again.append((t, best.from_ + at, best, float(best.nodes[at])))
        if j + 1 < k:
            for _, f, parent, _ in again:
                parent.nodes[f - parent.from_] = -np.inf  # its other ways move to the new branch
        todo = again
    threshold = {t: value for t, _, _, value in todo}
    results: list[list[tuple]] = []
    for t, bs in enumerate(branches):
        n, one = units[t], [] if units[t] else [(np.zeros(0, dtype=np.int32), 0.0, 1.0)]
        for b in bs:
            lp = b.log_prob(n)
            inclusion = float(-np.expm1(-np.exp(lp - threshold[t]))) if t in threshold else 1.0
            one.append((_spelled(model, np.concatenate(b.path(n))), lp, inclusion))
        results.append(one)
    return results


def _spelled(model: Model, ids: np.ndarray) -> np.ndarray:
    """Ids with characters that have no piece replaced by their bytes."""
    odd = np.flatnonzero(ids < 0)
    if not len(odd):
        return ids
    out, at = [], 0
    for k in odd:
        out.append(ids[at:k])
        spelled = chr(-2 - int(ids[k])).encode("utf-8", "replace")
        out.append(np.array([model.bytes[b] for b in spelled], dtype=np.int32))
        at = k + 1
    return np.concatenate([*out, ids[at:]])


@cache
def _model(path: str) -> Model:
    return Model(path)


SEGMENTATIONS = "array<struct<ids:array<int>,log_prob:double,inclusion:double>>"


def _as_arrow(found: list[list[tuple]]) -> pa.Array:
    flat = [s for one in found for s in one]
    ids = pa.ListArray.from_arrays(
        np.r_[0, np.cumsum([len(s[0]) for s in flat])].astype(np.int32),
        pa.array(np.concatenate([s[0] for s in flat]) if flat else np.zeros(0, np.int32), pa.int32()),
    )
    structs = pa.StructArray.from_arrays(
        [ids, pa.array([s[1] for s in flat], pa.float64()), pa.array([s[2] for s in flat], pa.float64())],
        ["ids", "log_prob", "inclusion"],
    )
    return pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(one) for one in found])].astype(np.int32), structs)


def _groups(sizes: np.ndarray, group: int = GROUP) -> Iterator[tuple[int, int]]:
    start = size = 0
    for k, n in enumerate(sizes.tolist()):
        if size and size + n > group:
            yield start, k
            start, size = k, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def sample_segmentations(
    df: DataFrame,
    path: str,
    id: str = "doc_id",
    text: str = "text",
    k: int = SAMPLES,
    group: int = GROUP,
    edges: int = EDGES,
) -> DataFrame:
    """``<id, text, segmentations, round_trip>`` of every row: up to ``k`` distinct ones.

    Each has its ids, its log probability, and the probability that it is among the ``k`` given the
    noise that came next; the best noise comes first. ``round_trip``: all of them decode to the text.
    A null text has none (null, and a true round trip); an empty text has one, without pieces; a text
    with fewer than ``k`` ways has them all. The noise depends on the id (a null id is a key too) and
    the text, so equal rows are segmented equally. A text that holds the model's own space mark gets
    a space for it when decoded. Other columns are not read. ``group``: characters of texts that are
    drawn together, ``edges``: of the lattices that stay; fewer take less memory and more time.
    """
    rows = df.select(
        F.col(id).alias("_id"),
        F.col(text).cast("string").alias("_text"),
        F.xxhash64(F.col(id), F.col(text)).alias("_key"),
    )
    kind = rows.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, _text string, segmentations {SEGMENTATIONS}, round_trip boolean"

    @lean
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        if model.lattices.most != edges:
            model.lattices = Lattices(model, edges)
        for batch in batches:
            ids, texts, keys = batch.columns
            sizes = np.asarray(pc.fill_null(pc.utf8_length(texts), 0))
            for a, b in _groups(sizes, group):
                some = texts.slice(a, b - a)
                plain = [t or "" for t in some.to_pylist()]
                seeds = np.asarray(keys.slice(a, b - a)).astype(np.int64).view(np.uint64)
                found = sample_group(model, plain, seeds, k)
                same = model.spell(found, plain)
                made = _as_arrow(found)
                if some.null_count:
                    made = pc.if_else(some.is_valid(), made, pa.scalar(None, made.type))
                columns = [ids.slice(a, b - a), some, made, pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "_text", "segmentations", "round_trip"])
            give_back()

    return rows.mapInArrow(sample, schema).withColumnsRenamed({"_id": id, "_text": text})


def decode_ids(ids: Column, path: str) -> Column:
    """The text of arrays of ids; null stays null."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model(path)
        for arrays in batches:
            yield arrays.map(lambda x: None if x is None else model.decode(x.tolist() if hasattr(x, "tolist") else x))

    return decode(ids)
