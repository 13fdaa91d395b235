"""Splitting texts into chunks. All work is per row: no shuffle, whole texts.

Splitters give spans ``[start, stop)`` into the text; contents are cut out in the JVM.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.functions import text as tx
from quaero.operators.sizing import lookup_join, running_sum
from quaero.options import ChunkOptions

SPANS = "array<struct<start:int,stop:int>>"
CHARS_PER_TOKEN = 4
TEXT_SEPARATORS = ("\n\n", "\n", " ", "")
MARKDOWN_SEPARATORS = (
    "\n## ", "\n### ", "\n#### ", "\n##### ", "\n###### ", "```\n\n",
    "\n\n***\n\n", "\n\n---\n\n", "\n\n___\n\n", "\n\n", "\n", " ", "",
)
ROW_SEPARATORS = ("\n\n",)
_SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?\n]+\s*|$)")
_WORD = re.compile(r"\s*\S+\s*")

Span = tuple[int, int]


def _pack(pieces: Sequence[Span], size: int, overlap: int) -> list[Span]:
    """Join adjoining pieces up to ``size``; the next chunk repeats up to ``overlap`` of them."""
    chunks: list[Span] = []
    first = 0
    for i, (start, stop) in enumerate(pieces):
        if i > first and stop - pieces[first][0] > size:
            chunks.append((pieces[first][0], start))
            while first < i and (
                start - pieces[first][0] > overlap or stop - pieces[first][0] > size
            ):
                first += 1
    if first < len(pieces):
        chunks.append((pieces[first][0], pieces[-1][1]))
    return chunks


def _windows(start: int, stop: int, size: int, overlap: int) -> list[Span]:
    last = max(stop - start - overlap - 1, 0)
    return [
        (start + at, min(start + at + size, stop)) for at in range(0, last + 1, size - overlap)
    ]


def _sentence_pieces(text: str, limit: int) -> list[Span]:
    """Sentences; longer ones fall apart into words, longer words into plain cuts."""
    pieces: list[Span] = []
    for sentence in _SENTENCE.finditer(text):
        if sentence.end() == sentence.start():
            continue
        if sentence.end() - sentence.start() <= limit:
            pieces.append(sentence.span())
            continue
        at = sentence.start()
        words = [w.span() for w in _WORD.finditer(text, at, sentence.end())]
        for start, stop in words or [sentence.span()]:
            pieces += [(cut, min(cut + limit, stop)) for cut in range(start, stop, limit)]
    return pieces


def _recursive(text: str, span: Span, separators: Sequence[str], size: int, overlap: int) -> list[Span]:
    """Split at the first separator found, pack what is short, go on with what is too long."""
    start, stop = span
    if stop - start <= size:
        return [span]
    at = next((i for i, s in enumerate(separators) if s == "" or text.find(s, start, stop) >= 0), None)
    if at is None:
        return [span]
    separator, rest = separators[at], separators[at + 1 :]
    if separator == "":
        return _windows(start, stop, size, overlap)
    bounds = [start]
    found = text.find(separator, start + 1, stop)
    while found >= 0:
        bounds.append(found)
        found = text.find(separator, found + len(separator), stop)
    bounds.append(stop)
    chunks: list[Span] = []
    short: list[Span] = []
    for piece in zip(bounds, bounds[1:]):
        if piece[1] - piece[0] <= size:
            short.append(piece)
            continue
        chunks += _pack(short, size, overlap)
        short = []
        chunks += _recursive(text, piece, rest, size, overlap) if rest else [piece]
    return chunks + _pack(short, size, overlap)


def _trimmed(text: str, spans: Sequence[Span]) -> list[Span]:
    out = []
    for start, stop in spans:
        body = text[start:stop]
        bare = body.strip()
        if bare:
            lead = len(body) - len(body.lstrip())
            out.append((start + lead, start + lead + len(bare)))
    return out


def spans_of(split: Callable[[str], list[Span]], text: Column) -> Column:
    """Spans of each text, or of each list of texts; a task holds one row's spans as Python objects at once."""

    @F.arrow_udf(SPANS)
    def apply(texts: pa.Array) -> pa.Array:
        starts, stops, ends = array("i"), array("i"), array("i", [0])
        for scalar in texts:
            body = scalar.as_py()
            for start, stop in split(body) if body else ():
                starts.append(start)
                stops.append(stop)
            ends.append(len(starts))
        ints = [pa.array(np.frombuffer(x, dtype=np.int32)) for x in (starts, stops)]
        pairs = pa.StructArray.from_arrays(ints, ["start", "stop"])
        return pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, dtype=np.int32)), pairs)

    return apply(text)


def _cut(docs: DataFrame, spans: Column, text: str) -> DataFrame:
    """One row per span; every other column of the document is inherited."""
    inherited = [c for c in docs.columns if c != text]
    placed = docs.withColumn("_spans", spans).select(
        *inherited, text, F.posexplode("_spans").alias("chunk_index", "_span")
    )
    content = F.substring(
        F.col(text), F.col("_span.start") + 1, F.col("_span.stop") - F.col("_span.start")
    )
    return placed.select(
        *inherited,
        F.col("chunk_index").cast("bigint").alias("chunk_index"),
        content.alias("content"),
        tx.estimate_tokens(content).alias("tokens"),
    )


def chunk_fixed(docs: DataFrame, options: ChunkOptions = ChunkOptions(), text: str = "text") -> DataFrame:
    """Whole sentences packed to at most ``size`` tokens, ``overlap`` tokens repeated."""
    size, overlap = options.size * CHARS_PER_TOKEN, options.overlap * CHARS_PER_TOKEN

    def split(body: str) -> list[Span]:
        return _trimmed(body, _pack(_sentence_pieces(body, size), size, overlap))

    return _cut(docs, spans_of(split, F.col(text)), text)


def chunk_recursive(
    docs: DataFrame,
    size: int = 4000,
    overlap: int = 200,
    separators: Sequence[str] = TEXT_SEPARATORS,
    text: str = "text",
) -> DataFrame:
    """Recursive character splitting; sizes are in characters."""

    def split(body: str) -> list[Span]:
        return _trimmed(body, _recursive(body, (0, len(body)), tuple(separators), size, overlap))

    return _cut(docs, spans_of(split, F.col(text)), text)


def chunk_char_windows(
    docs: DataFrame, size: int = 4000, overlap: int = 200, text: str = "text"
) -> DataFrame:
    """Plain windows of ``size`` characters every ``size - overlap``, all in the JVM."""
    length = F.length(text)
    starts = F.sequence(
        F.lit(0), F.greatest(length - overlap - 1, F.lit(0)), F.lit(size - overlap)
    )
    inherited = [c for c in docs.columns if c != text]
    placed = docs.filter(length > 0).select(*inherited, text, F.posexplode(starts).alias("i", "at"))
    content = F.substring(F.col(text), F.col("at") + 1, F.lit(size))
    return placed.select(
        *inherited,
        F.col("i").cast("bigint").alias("chunk_index"),
        content.alias("content"),
        tx.estimate_tokens(content).alias("tokens"),
    )


def chunk_by_structure(docs: DataFrame, marker: str, text: str = "text", clean=None) -> DataFrame:
    """One chunk per section; a section starts where the ``marker`` expression matches.

    ``clean`` (a column function) is applied to the sections, empty ones are dropped.
    """
    marked = F.regexp_replace(F.col(text), f"({marker})", "\u0001$1")
    sections = F.split(marked, "\u0001")
    if clean is not None:
        sections = F.transform(sections, clean)
    inherited = [c for c in docs.columns if c != text]
    kept = F.filter(sections, lambda s: F.trim(s) != "")
    placed = docs.select(*inherited, F.posexplode(kept).alias("i", "content"))
    return placed.select(
        *inherited,
        F.col("i").cast("bigint").alias("chunk_index"),
        "content",
        tx.estimate_tokens(F.col("content")).alias("tokens"),
    )


def resplit_oversized(chunks: DataFrame, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """Chunks above the allowed tokens are split again; children keep the parent's columns.

    Only oversized contents reach Python; ``part`` numbers the pieces of one chunk.
    """
    large = F.col("tokens") > options.max_tokens
    kept = chunks.filter(~large).withColumn("part", F.lit(0).cast("bigint"))
    parents = chunks.filter(large).withColumnRenamed("chunk_index", "_parent").drop("tokens")
    split = chunk_fixed(parents.withColumnRenamed("content", "text"), options)
    children = split.withColumnRenamed("chunk_index", "part").withColumnRenamed(
        "_parent", "chunk_index"
    )
    return kept.unionByName(children)


def extract_heading(text: Column) -> Column:
    """Last heading of the leading heading block within the first 20 lines, or empty.

    Lines before the first heading are passed over; blank lines do not end the block.
    """
    lines = F.transform(F.slice(F.split(F.trim(text), "\n"), 1, 20), lambda line: F.trim(line))
    start = F.struct(F.lit("").alias("heading"), F.lit(False).alias("closed"))

    def step(state, line):
        heading = F.trim(F.regexp_extract(line, r"^#{1,6}\s+(.+)", 1))
        is_heading = heading != ""
        closes = (state["heading"] != "") & ~is_heading & (line != "")
        return F.struct(
            F.when(~state["closed"] & is_heading, heading).otherwise(state["heading"]).alias("heading"),
            (state["closed"] | closes).alias("closed"),
        )

    return F.aggregate(lines, start, step, lambda s: s["heading"])


def number_chunks(chunks: DataFrame, key: str = "file_id") -> DataFrame:
    """Add ``corpus_index``: the position of each chunk in the corpus, documents in order of an integer key.

    Works for the chunks of any chunker: only one count per document is put in order, by sums over
    blocks, and no chunk moves but to meet its document's start.
    """
    sizes = chunks.groupBy(key).agg(F.count("*").alias("_n"))
    running = running_sum(sizes, [], key, "_n", "_upto")
    starts = running.select(key, (F.col("_upto") - F.col("_n")).alias("_start"))
    numbered = lookup_join(chunks, starts, [key])
    return numbered.withColumn("corpus_index", F.col("_start") + F.col("chunk_index")).drop("_start")
