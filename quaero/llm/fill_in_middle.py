"""Fill-in-middle transformation: a text is cut into prefix, middle and suffix, which change places.

Cuts fall between units (lines or characters), drawn from a hash of the row's key, so the same row is
always cut alike. Texts stay the UTF-8 bytes that Arrow hands over. What a cut is in code points and
what in bytes is told from a sparse index: only the characters of several bytes are listed, each with
its position and the bytes that it and those before it have beyond one. A binary search in that list
converts a cut; between two of its entries, and in ASCII texts everywhere, the two differ by a constant.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.llm.common import whole_text

# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
_NEWLINE = ord("\n")


class ExceptionIndex:
    """Where a UTF-8 text departs from one byte a character."""

    def __init__(self, raw: np.ndarray) -> None:
        self.size = len(raw)
        leads = np.flatnonzero(raw >= 0xC0)
        # 110xxxxx leads two bytes, 1110xxxx three, 11110xxx four
        excess = 1 + (raw[leads] >= 0xE0).astype(np.int64) + (raw[leads] >= 0xF0)
        self.excess = np.r_[0, np.cumsum(excess)]  # of the characters before each entry
        self.at_byte = leads
        self.at_char = leads - self.excess[:-1]

    def chars(self, cut):
        """Characters before a cut given in bytes (which must not split a character)."""
        return cut - self.excess[np.searchsorted(self.at_byte, cut)]

    def bytes(self, cut):
        """Bytes before a cut given in characters."""
        return cut + self.excess[np.searchsorted(self.at_char, cut)]

    @property
    def length(self) -> int:
        return int(self.size - self.excess[-1])


def cuts(raw: np.ndarray, index: ExceptionIndex, unit: str, draws: tuple[int, int]) -> tuple[int, int, int]:
    """Number of units, and the byte cuts after the smaller and the larger drawn unit."""
    if unit == "line":
        ends = np.flatnonzero(raw == _NEWLINE) + 1
        n = len(ends) + int(len(raw) > 0 and raw[-1] != _NEWLINE)
        first, last = sorted(d % (n + 1) for d in draws)
        at = [0 if k == 0 else int(ends[k - 1]) if k <= len(ends) else len(raw) for k in (first, last)]
        return n, at[0], at[1]
    n = index.length
    first, last = sorted(d % (n + 1) for d in draws)
    return n, int(index.bytes(first)), int(index.bytes(last))


def _draws(key: Column) -> list[Column]:
    """The first four 8-digit groups of the key's SHA-256, as numbers."""
    digest = F.sha2(key, 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"_h{k + 1}") for k in range(4)]


def fill_in_middle(
    df: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    unit: str = "line",
    seed: int = 7,
    rate: int = 100,
    spm: int = 50,
) -> DataFrame:
    """``<id, n, form, prefix_chars, middle_chars, output>`` of every row.

    ``n`` counts the units of the whole text: lines (with their ``\\n``) or characters (``unit="char"``).
    ``rate`` percent of the rows are transformed, ``spm`` percent of those into the form ``spm`` (suffix,
    prefix, middle), the others into ``psm``. The rest are ``plain``: the text itself, without lengths;
    so are empty texts and texts that hold one of the marks. A null text is empty; a null id is drawn
    like an empty one. Repeated rows give repeated results, one row out for each row in; other columns
    are not read, whatever their names. An empty table gives no rows.
    """
    if unit not in ("line", "char"):
        raise ValueError(f"unknown unit {unit!r}: line or char")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit("")))
    rows = df.select(F.col(id).alias("_id"), whole_text(text).alias("_text"), *_draws(key))
    kind = rows.schema["_id"].dataType.simpleString()

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, *draws = batch.columns
            draws = list(zip(*(h.to_numpy() for h in draws)))
            n, forms, before, between, outputs = [], [], [], [], []
            for value, (h1, h2, h3, h4) in zip(texts.cast(pa.large_binary()), draws):
                t = value.as_buffer()
                raw = np.frombuffer(t, dtype=np.uint8)
                t = t.to_pybytes()
                index = ExceptionIndex(raw)
                units, a, b = cuts(raw, index, unit, (int(h1), int(h2)))
                n.append(units)
                if not t or h3 % 100 >= rate or any(m in t for m in _MARKS):
                    form, parts, lengths = "plain", (t,), (None, None)
                else:
                    p, s, m = _MARKS
                    if h4 % 100 < spm:
                        form, parts = "spm", (s, t[b:], p, t[:a], m, t[a:b])
                    else:
                        form, parts = "psm", (p, t[:a], s, t[b:], m, t[a:b])
                    start, end = index.chars(np.array([a, b]))
                    lengths = int(start), int(end - start)
                forms.append(form)
                outputs.append(b"".join(parts))
                before.append(lengths[0])
                between.append(lengths[1])
            yield pa.record_batch(
                [
                    ids,
                    pa.array(n, pa.int64()),
                    pa.array(forms, pa.string()),
                    pa.array(before, pa.int64()),
                    pa.array(between, pa.int64()),
                    pa.array(outputs, pa.binary()).cast(pa.string()),
                ],
                names=["_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    made = rows.mapInArrow(
        transform, f"_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    )
    return made.withColumnRenamed("_id", id)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of: its parts stand between the marks, which no text holds."""
    whole = F.col(output)
    psm = F.regexp_replace(whole, f"(?s)^{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)$", "$1$3$2")
    spm = F.regexp_replace(whole, f"(?s)^{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)$", "$2$3$1")
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(whole)
