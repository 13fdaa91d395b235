"""Secrets in texts: fixed patterns, and values in a credential context that are hard to guess.

The patterns find assignments, access keys and long hexadecimal runs. Beyond them, whatever stands
after a credential word (``pwd: ...``, ``passphrase is ...``) is priced as a password guesser would:
the cheapest segmentation into words, dates, repeats, keyboard walks and brute-force spans, by
dynamic programming over the value. A value that costs many guesses is a secret; a placeholder, a
date or a word of the text itself is not.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaero.llm.common import lean, whole_text

KINDS = ("assign", "access", "hex", "guess")
MIN_LOG10_GUESSES = 8.0  # a value of a credential context that costs more is a secret
MIN_VALUE = 6
DATE_GUESSES = math.log10(366 * 200)
YEAR_GUESSES = math.log10(200)
LONGEST_WORD = 24

# The base patterns and the credential words.
_WORDS = ("password", "passwd", "secret", "token", "api_?key")
_EITHER = {c: f"[{c}{c.upper()}]" for c in "abcdefghijklmnopqrstuvwxyz"}
_KEYWORD = "|".join("".join(_EITHER.get(c, c) for c in w) for w in _WORDS)
ASSIGN = re.compile(rf"""({_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the same as runs of [0-9a-f]+ kept from 24 characters on
CONTEXT_WORDS = (
    "password", "passwd", "passphrase", "passcode", "pwd", "pass", "secret", "token", "credential",
    "credentials", "authorization", "bearer", "api key", "access key", "private key",
    "client secret", "login",
)
_CONTEXT_WORD = "|".join(w.replace(" ", "[ _-]?") for w in CONTEXT_WORDS)
# as a word of its own or a part of an identifier (db_password, dbPassword, secret_key, tokenValue)
CONTEXT = re.compile(
    rf"""(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))(?i:{_CONTEXT_WORD})(?:[_-][A-Za-z0-9]{{1,24}}|[A-Z][a-z0-9]{{1,24}}){{0,3}}"""
    rf"""["']?(?:\s{{0,3}}[:=]\s{{0,3}}|\s(?i:is)\s)["'`]?(?:(?i:bearer|basic|digest|token)\s{{1,3}})?([^\s"'`<>,;]{{{MIN_VALUE},}})"""
)
CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "credential", "authorization", "bearer", "key", "login")
COMMON_WORDS = (
    "password", "passwd", "pass", "secret", "token", "admin", "root", "user", "guest", "login",
    "welcome", "letmein", "changeme", "example", "sample", "test", "demo", "dummy", "placeholder",
    "your", "here", "none", "null", "true", "false", "required", "enter", "hidden", "redacted",
    "default", "monkey", "dragon", "master", "hello", "love", "football", "baseball", "shadow",
    "sunshine", "princess", "superman", "batman", "summer", "winter", "spring", "autumn", "qwerty",
)
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("0134578@$", "oleastbas")

_NEIGHBOURS = {p for row in KEY_ROWS for a, b in zip(row, row[1:]) for p in (a + b, b + a)}
_NEIGHBOURS |= {
    p
    for upper, lower in zip(KEY_ROWS[:3], KEY_ROWS[1:4])
    for a, b in zip(upper, lower)
    for p in (a + b, b + a)
}
_DATE = re.compile(r"(?:\d{1,2}[-/.]?\d{1,2}[-/.]?(?:19|20)\d\d|(?:19|20)\d\d[-/.]?\d{1,2}[-/.]?\d{1,2})")
_YEAR = re.compile(r"(?:19|20)\d\d")
_REPEAT = re.compile(r"(.{1,8}?)\1+")
_BETWEEN = re.compile(r"""[\s"'`<>,;:=]+""")
_LETTERS = re.compile(r"[^\W\d_]{3,}")
_ALPHABETS = ((re.compile(r"[0-9]"), 10), (re.compile(r"[a-z]"), 26), (re.compile(r"[A-Z]"), 26), (re.compile(r"[^0-9A-Za-z]"), 33))


def _matches(value: str, ranks: dict[str, int], repeats: bool) -> dict[int, list[tuple[int, float]]]:
    """Cheap readings of parts of a value: end -> (start, log10 guesses)."""
    found: dict[int, list[tuple[int, float]]] = {}
    lower = value.lower()
    if len(lower) != len(value):  # a few letters change their length
        lower = value
    plain = lower.translate(LEET)
    for start in range(len(value)):
        for end in range(start + 3, min(len(value), start + LONGEST_WORD) + 1):
            exact, leet = lower[start:end], plain[start:end]
            rank = ranks.get(exact) or ranks.get(leet)
            if rank:
                cost = math.log10(rank) + math.log10(2) * (exact != value[start:end]) + math.log10(2) * (exact not in ranks)
                found.setdefault(end, []).append((start, cost))
    for pattern, cost in ((_DATE, DATE_GUESSES), (_YEAR, YEAR_GUESSES)):
        for m in pattern.finditer(value):
            found.setdefault(m.end(), []).append((m.start(), cost))
    start = 0
    for end in range(1, len(value) + 1):  # keyboard walks, as long as they go
        if end == len(value) or lower[end - 1 : end + 1] not in _NEIGHBOURS:
            if end - start >= 3:
                found.setdefault(end, []).append((start, math.log10(80 * (end - start))))
            start = end
    if repeats:
        for m in _REPEAT.finditer(value):
            if len(m[0]) >= 3:
                cost = log10_guesses(m[1], ranks, False) + math.log10(len(m[0]) // len(m[1]))
                found.setdefault(m.end(), []).append((m.start(), cost))
    return found


def log10_guesses(value: str, ranks: dict[str, int], repeats: bool = True) -> float:
    """Guesses (log 10) of the cheapest segmentation; linear in the length of the value."""
    found = _matches(value, ranks, repeats)
    letters = math.log10(max(10, sum(n for p, n in _ALPHABETS if p.search(value))))
    best = [0.0]
    for end in range(1, len(value) + 1):
        cost = best[end - 1] + letters  # one more brute-force character
        for start, guesses in found.get(end, ()):
            cost = min(cost, best[start] + guesses)
        best.append(cost)
    return best[-1]


class Guesser:
    """Words a guesser would try for the values of one text: common ones, and those of the text itself.

    A word that the text holds in the value only is no such word. Texts are read once, however many
    values they hold: a text and a value are cut into the same pieces, and a word is left out for
    a value if all its places in the text are pieces of that value.
    """

    def __init__(self, text: str) -> None:
        self.pieces = Counter(_pieces(text))
        self.counts: Counter[str] = Counter()
        for piece, n in self.pieces.items():
            for w in _words(piece):
                self.counts[w] += n
        words = dict.fromkeys(COMMON_WORDS)
        words.update(dict.fromkeys(self.counts))
        self.ranks = {w: k for k, w in enumerate(words, 1)}

    def log10_guesses(self, value: str) -> float:
        own: Counter[str] = Counter()
        for piece in set(_pieces(value)):
            for w in _words(piece):
                own[w] += self.pieces[piece]
        only = [w for w, n in own.items() if n >= self.counts[w] and w not in COMMON_WORDS]
        kept = {w: self.ranks.pop(w) for w in only if w in self.ranks}
        cost = log10_guesses(value, self.ranks)
        self.ranks |= kept
        return cost


def _pieces(text: str) -> list[str]:
    """Stretches between white space, quotes and assignments, without the marks behind a word."""
    return [p for p in (x.rstrip(".!?)]}") for x in _BETWEEN.split(text)) if p]


def _words(piece: str) -> list[str]:
    return _LETTERS.findall(piece.lower())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the pattern matches."""
    spans = []
    lower = text.lower()
    if any(w in lower for w in ("passw", "secret", "token", "api")):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return spans


def guess_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Values of credential contexts that no pattern covers whole and that cost too many guesses."""
    lower = text.lower()
    if not any(h in lower for h in CONTEXT_HINTS):
        return []
    spans, at, guesser = [], 0, None
    covered, known = 0, {}  # base spans by start, as far as they are passed; costs by value
    ends = sorted((s, e) for s, _, e in base)
    reach = -1
    while m := CONTEXT.search(text, at):
        start, end = m.span(1)
        at = start if text[end - 1] in ":=" else end  # what stands after a word may be the next context
        end -= len(m[1]) - len(m[1].rstrip(".!?:)]}"))
        value = text[start:end]
        while covered < len(ends) and ends[covered][0] <= start:
            reach = max(reach, ends[covered][1])
            covered += 1
        if len(value) < MIN_VALUE or end <= reach:
            continue
        guesser = guesser or Guesser(text)
        if value not in known:
            known[value] = guesser.log10_guesses(value)
        if known[value] >= MIN_LOG10_GUESSES:
            spans.append((start, 3, end))
    return spans


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by start and then kind."""
    base = base_spans(text)
    return [(KINDS[k], s, e) for s, k, e in sorted(base + guess_spans(text, base))]


def secret_spans(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``<id, spans>`` of every row: an array of ``kind, start, end``, the end exclusive.

    A null or empty text has no spans (an empty array). Null ids and repeated rows stay, one row out
    for each row in; other columns are not read. An empty table gives no rows.
    """

    @F.pandas_udf("array<struct<kind:string,start:long,end:long>>")
    @lean
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(("kind", "start", "end"), s)) for s in find_spans(t)] for t in texts], dtype=object)

    rows = df.select(F.col(id).alias("_id"), whole_text(text).alias("_text"))
    return rows.select(F.col("_id").alias(id), spans("_text").alias("spans"))


def masked(text: str) -> str:
    """The text with every secret replaced by a mark of its kind."""
    out, at = [], 0
    for kind, start, end in find_spans(text):
        if end > at:
            out += [text[at : max(at, start)], f"[{kind}]" if start >= at else ""]
            at = end
    return "".join([*out, text[at:]])


def mask_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns, with the secrets in ``text`` masked; a null text stays null."""

    @F.pandas_udf("string")
    @lean
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else masked(t))

    return df.withColumn(text, mask(F.col(text).cast("string")))
