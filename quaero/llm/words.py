"""Word and shingle hashes of whole texts as arrays, in bounded memory for texts of any length."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

PIECE = 1 << 20  # characters of a text that are hashed at once (cut at white space)
GROUP = 1 << 18  # characters of short texts that are hashed together

# Odd multipliers; equal bytes must hash equally on every machine.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_STEPS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

_SPACES = np.zeros(256, dtype=bool)
_SPACES[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# kinds of bytes: 0 white space, 1 letters and digits (and all beyond ASCII), 2 other characters
_KINDS = np.full(256, 2, dtype=np.int8)
_KINDS[_SPACES] = 0
_KINDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MULTIPLIERS[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MULTIPLIERS[1])
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    global _powers, _inverses
    if len(_powers) <= n:
        size = 1 << (n + 1).bit_length()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.r_[np.uint64(1), np.full(size, _BASE)])
            _inverses = np.cumprod(np.r_[np.uint64(1), np.full(size, inverse)])
    return _powers, _inverses


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run ``values[start:end]``: differences of prefix sums, brought to one place."""
    powers, inverses = _tables(len(values))
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def pieces(text: str) -> Iterator[str]:
    """The text in pieces that never cut a word."""
    at = 0
    while len(text) - at > PIECE:
        end = min((e for e in (text.find(c, at + PIECE) for c in " \n\t\r\x0b\x0c") if e >= 0), default=-1)
        if end < 0:
            break
        yield text[at : end + 1]
        at = end + 1
    yield text[at:] if at else text


def _bytes(piece: str, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a piece, and where its words start and end."""
    raw = np.frombuffer(piece.encode("utf-8", "replace"), dtype=np.uint8)
    if lower:
        raw = _LOWER[raw]
    edges = np.flatnonzero(np.diff(np.r_[True, _SPACES[raw], True].view(np.int8)))
    return raw, edges[::2], edges[1::2]


def _groups(texts: Iterable[str]) -> Iterator[list[str]]:
    """Short texts together, so that one pass of the array operations serves many; long ones alone."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > GROUP:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def _long(text: str, lower: bool) -> np.ndarray:
    found = []
    for piece in pieces(text):
        raw, starts, ends = _bytes(piece, lower)
        if len(starts):
            found.append(run_hashes(_BYTES[raw], starts, ends))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def _grouped(texts: Iterable[str], lower: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes of a group of texts, and where each text's words begin (and the last one's end)."""
    for group in _groups(texts):
        if len(group) == 1:
            words = _long(group[0], lower)
            yield words, np.array([0, len(words)])
            continue
        raw, starts, ends = _bytes("\n".join(group), lower)
        sizes = [len(t.encode("utf-8", "replace")) + 1 for t in group]
        yield run_hashes(_BYTES[raw], starts, ends), np.searchsorted(starts, np.cumsum([0, *sizes]))


def hashed_words(texts: Iterable[str], lower: bool = True) -> Iterator[np.ndarray]:
    """For each text, hashes of its words between white space (space, 9 to 13).

    A-Z count as a-z if ``lower``.
    """
    for words, cuts in _grouped(texts, lower):
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield words[a:b]


def _runs(piece: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of bytes of one kind (letters and digits, others), and where they start."""
    raw = np.frombuffer(piece.encode("utf-8", "replace"), dtype=np.uint8)
    kinds = _KINDS[raw]
    edges = np.flatnonzero(np.diff(np.r_[np.int8(-1), kinds, np.int8(-1)]))
    starts, ends = edges[:-1], edges[1:]
    words = kinds[starts] > 0
    starts, ends = starts[words], ends[words]
    return run_hashes(_BYTES[raw], starts, ends), starts


def byte_runs(texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For groups of texts, hashes of their runs of one kind and where each text's runs begin (and end)."""
    for group in _groups(texts):
        if len(group) == 1:
            found = np.concatenate([_runs(piece)[0] for piece in pieces(group[0])])
            yield found, np.array([0, len(found)])
            continue
        hashes, starts = _runs("\n".join(group))
        sizes = [len(t.encode("utf-8", "replace")) + 1 for t in group]
        yield hashes, np.searchsorted(starts, np.cumsum([0, *sizes]))


def hashed_shingles(texts: Iterable[str], size: int, whole: bool = True) -> Iterator[np.ndarray]:
    """For each text, hashes of all its runs of ``size`` words.

    A text of fewer words has its whole sequence as its only run if ``whole``, else none.
    """
    for words, cuts in _grouped(texts, True):
        every = shingles(words, size)
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a >= size:
                yield every[a : b - size + 1]
            else:
                yield shingles(words[a:b], size) if whole else words[:0]


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of the whole sequence if it is shorter (none if empty)."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    h = words[:n] * np.uint64(_STEPS[0])
    for k in range(1, size):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(_STEPS[1]) + words[k : n + k] * np.uint64(_STEPS[0])
    return mix(h + np.uint64(size))


Sentences = tuple[np.ndarray, np.ndarray, np.ndarray]


def _sentences(words: np.ndarray, stop: np.ndarray, start: np.ndarray) -> Sentences:
    if not len(words):
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none
    last = np.flatnonzero(stop) + 1
    first = np.r_[0, last[:-1]]
    return run_hashes(words, first, last), last - first, start[first]


def _stops(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, marks: bytes) -> np.ndarray:
    """Words that end a sentence: their last character is a mark, or the line ends after them."""
    stops = np.zeros(256, dtype=bool)
    stops[list(marks)] = True
    lines = np.r_[0, np.cumsum(raw == 10)]
    after = np.r_[starts[1:], len(raw)]
    return stops[raw[ends - 1]] | (lines[after] > lines[ends])


def _chars(raw: np.ndarray) -> np.ndarray:
    """Characters before each byte: continuation bytes of UTF-8 count for nothing."""
    return np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]


def sentences(texts: Iterable[str], marks: bytes) -> Iterator[Sentences]:
    """For each text, its sentences: hashes of their words, numbers of words, first characters.

    A sentence ends after a word whose last character is one of ``marks``, and at a line end.
    Letter case doesn't count.
    """
    for group in _groups(texts):
        if len(group) == 1:
            at, parts = 0, []
            for piece in pieces(group[0]):
                raw, starts, ends = _bytes(piece, True)
                if len(starts):
                    stop = _stops(raw, starts, ends, marks)
                    parts.append((run_hashes(_BYTES[raw], starts, ends), stop, _chars(raw)[starts] + at))
                at += len(piece)
            if not parts:
                yield _sentences(*[np.zeros(0, dtype=np.int64)] * 3)
                continue
            words, stop, start = map(np.concatenate, zip(*parts))
            stop[-1] = True
            yield _sentences(words, stop, start)
            continue
        raw, starts, ends = _bytes("\n".join(group), True)
        if not len(starts):
            yield from [_sentences(*[np.zeros(0, dtype=np.int64)] * 3)] * len(group)
            continue
        words = run_hashes(_BYTES[raw], starts, ends)
        h, n, start = _sentences(words, _stops(raw, starts, ends, marks) | (np.arange(len(starts)) == len(starts) - 1), _chars(raw)[starts])
        offsets = np.cumsum([0, *[len(t) + 1 for t in group]])
        cuts = np.searchsorted(start, offsets)
        for a, b, offset in zip(cuts[:-1], cuts[1:], offsets):
            yield h[a:b], n[a:b], start[a:b] - offset


def _tokens(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, but each character of a script without spaces (Han, kana, Thai, Lao, Khmer, Burmese) is one."""
    after = np.r_[raw[1:], np.uint8(0)]
    three = (raw >= 0xE3) & (raw <= 0xE9)
    three |= (raw == 0xE0) & (after >= 0xB8) & (after <= 0xBB)
    three |= (raw == 0xE1) & ((after >= 0x80) & (after <= 0x82) | (after >= 0x9E) & (after <= 0x9F))
    four = (raw == 0xF0) & (after >= 0xA0)
    if not (three.any() or four.any()):
        return starts, ends
    alone = np.r_[np.flatnonzero(three), np.flatnonzero(four)]
    behind = np.r_[np.flatnonzero(three) + 3, np.flatnonzero(four) + 4]
    behind = behind[behind < len(raw)]
    every = np.unique(np.r_[starts, alone, behind[~_SPACES[raw[behind]]]])
    return every, np.minimum(np.r_[every[1:], len(raw)], ends[np.searchsorted(ends, every, side="right")])


def tokens(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a text's words (see ``_tokens``), their first characters, and their line numbers."""
    at = line = 0
    parts = []
    for piece in pieces(text):
        raw, starts, ends = _bytes(piece, True)
        ends_of_lines = np.r_[0, np.cumsum(raw == 10)]
        if len(starts):
            starts, ends = _tokens(raw, starts, ends)
            parts.append((run_hashes(_BYTES[raw], starts, ends), _chars(raw)[starts] + at, ends_of_lines[starts] + line))
        at += len(piece)
        line += int(ends_of_lines[-1])
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none
    words, chars, lines = map(np.concatenate, zip(*parts))
    return words, chars, lines


def winnowed(words: np.ndarray, lines: np.ndarray, size: int, among: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of chosen runs of ``size`` words: of any ``among`` in a row the least is chosen.

    Two texts that share ``size + among - 1`` words in a row so share a chosen run. The first and the
    last run of the text and of each line are chosen as well.
    """
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64), words[:0]
    starts = np.arange(n)
    hashes = run_hashes(words, starts, starts + size)
    chosen = np.zeros(n, dtype=bool)
    chosen[[0, n - 1]] = True
    if n >= among:
        chosen[np.arange(n - among + 1) + np.lib.stride_tricks.sliding_window_view(hashes, among).argmin(1)] = True
    edges = np.flatnonzero(np.diff(lines)) + 1
    first, last = np.r_[0, edges], np.r_[edges, len(words)]
    long = last - first >= size
    chosen[first[long]] = True
    chosen[last[long] - size] = True
    at = np.flatnonzero(chosen)
    return at, hashes[at]
