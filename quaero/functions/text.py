"""Text columns: normalising, tokens, numerals and token estimates. All stay in the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaero.fixed_values import ROMAN_NUMERALS, STOPWORDS

TOKEN_BREAK = r"[^\p{L}\p{N}_]+"
ALNUM = r"[\p{L}\p{N}]"


def _latin_folding() -> tuple[str, str]:
    """Lower-case Latin letters whose compatibility form is one plain letter plus marks."""
    accented, plain = [], []
    for code in (*range(0x00A0, 0x0250), *range(0x1E00, 0x1F00)):
        letter = chr(code)
        base = [c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] != letter and letter == letter.lower():
            accented.append(letter)
            plain.append(base[0])
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _latin_folding()


def normalise(text: Column) -> Column:
    """Lower case without accents; loose combining marks are dropped."""
    return F.translate(F.regexp_replace(F.lower(text), r"\p{Mn}", ""), _ACCENTED, _PLAIN)


def normalise_literal(text: str) -> str:
    """The same rule for a word of a configured list."""
    folded = text.lower().translate(str.maketrans(_ACCENTED, _PLAIN))
    return re.sub("[\u0300-\u036f]", "", folded)


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, TOKEN_BREAK), lambda t: t != "")


def significant_tokens(text: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    return F.filter(tokens(text), lambda t: ~t.isin(*stopwords))


def expand_numerals(words: Column) -> Column:
    """Words plus the roman or arabic twin of I to X, each once."""
    twins = {**ROMAN_NUMERALS, **{v: k for k, v in ROMAN_NUMERALS.items()}}
    lookup = F.create_map(*[F.lit(x) for pair in twins.items() for x in pair])
    twin = F.transform(words, lambda w: F.try_element_at(lookup, w))
    return F.array_distinct(F.concat(words, F.filter(twin, lambda t: t.isNotNull())))


def estimate_tokens(text: Column) -> Column:
    """One token for every four characters."""
    return F.floor(F.length(text) / 4).cast("bigint")


def word_count(text: Column) -> Column:
    """Whitespace separated words, at least one."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.greatest(F.lit(1), F.size(words)).cast("bigint")


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """True if one of the literal words is contained in the text."""
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def count_contained(text: Column, words: Sequence[str]) -> Column:
    """How many literal words are contained; overlapping words count each.

    The text is bound once in an array of one, however long the word list is.
    """
    if not words:
        return F.lit(0)
    listed = F.array(*[F.lit(w) for w in words])
    counts = F.transform(
        F.array(text), lambda t: F.size(F.filter(listed, lambda w: F.contains(t, w)))
    )
    return F.element_at(counts, 1)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, 0 when there is nothing to divide by."""
    return F.coalesce(
        numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0)), F.lit(0.0)
    )
