"""Sentence chunks of documents that are too long for one row or one task.

A document is a table of parts (lines, pages, blocks of a file). Greedy packing looks sequential, yet
where the chunk after one that starts at a given piece will start depends on that piece alone. So
every piece gets a pointer to the start of the next chunk, by joins on places in the text, and
the pieces at which chunks really start are those that the first piece's pointers lead to. They are
found by doubling: with pointers over 1, 2, 4, ... chunks, n chunks take log n rounds of equi joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.functions import text as tx
from quaero.operators.chunking import CHARS_PER_TOKEN, Span, _pack, _sentence_pieces, _trimmed, spans_of
from quaero.operators.sizing import fits, lookup_join, materialise, running_sum
from quaero.options import ChunkOptions

#: characters of a document that one task may hold
WHOLE_CHARS = 262_144
_BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"


def sentence_pieces(parts: DataFrame, limit: int, id: str, part: str, text: str) -> DataFrame:
    """``<id, idx, start, stop, piece>``: sentences (or what longer ones fall apart into) of all parts.

    ``idx`` and the places count from the start of the document. Sums over blocks place the parts, so
    no task sees more than a block of them.
    """

    rows = parts.select(F.col(id).alias("_id"), F.col(part).cast("long").alias("_part"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = materialise(rows.withColumn("_spans", spans_of(lambda body: _sentence_pieces(body, limit), F.col("_text"))))
    sizes = rows.select("_id", "_part", F.length("_text").cast("long").alias("_chars"), F.size("_spans").cast("long").alias("_n"))
    before = running_sum(sizes, ["_id"], "_part", "_chars", "_chars_upto")
    before = running_sum(before, ["_id"], "_part", "_n", "_n_upto")
    placed = rows.join(
        before.select("_id", "_part", (F.col("_chars_upto") - F.col("_chars")).alias("_at"), (F.col("_n_upto") - F.col("_n")).alias("_first")),
        ["_id", "_part"],
    )
    each = placed.select("_id", "_text", "_at", "_first", F.posexplode("_spans").alias("_i", "_s"))
    return each.select(
        "_id",
        (F.col("_first") + F.col("_i")).alias("idx"),
        (F.col("_at") + F.col("_s.start")).alias("start"),
        (F.col("_at") + F.col("_s.stop")).alias("stop"),
        F.substring(F.col("_text"), F.col("_s.start") + 1, F.col("_s.stop") - F.col("_s.start")).alias("piece"),
    )


def _first_from(points: DataFrame, point: str, pieces: DataFrame, place: str, strict: bool, width: int) -> DataFrame:
    """``points`` with ``_met``, the first piece whose ``place`` is at (or behind) the point, if it is within ``width``.

    Places are met in buckets of ``width``: a point looks into its own and the next one.
    """
    bucket = F.floor(F.col(place) / width)
    known = pieces.select("_id", bucket.alias("_b"), F.struct("idx", "start", "stop").alias("_piece"), F.col(place).alias("_place"))
    own = F.floor(F.col(point) / width)
    asked = points.select("_id", "idx", point, F.explode(F.array(own, own + 1)).alias("_b"))
    reached = F.col("_place") > F.col(point) if strict else F.col("_place") >= F.col(point)
    found = asked.join(known, ["_id", "_b"]).filter(reached).groupBy("_id", "idx").agg(F.min("_piece").alias("_met"))
    return points.join(found, ["_id", "idx"], "left")


def next_starts(pieces: DataFrame, size: int, overlap: int) -> DataFrame:
    """``<_id, idx, end, to>``: a chunk that starts at piece ``idx`` ends before ``end``, the next starts at ``to``.

    Both are null where the chunk holds the rest of the document.
    """
    points = pieces.select("_id", "idx", (F.col("start") + size).alias("_limit"))
    full = _first_from(points, "_limit", pieces, "stop", True, size)
    after = full.filter(F.col("_met").isNotNull()).select(
        "_id", "idx", F.col("_met.idx").alias("end"),
        F.greatest(F.col("_met.start") - overlap, F.col("_met.stop") - size).alias("_from"),
    )
    following = _first_from(after, "_from", pieces, "start", False, size)
    known = following.select("_id", "idx", "end", F.col("_met.idx").alias("to"))
    return pieces.select("_id", "idx").join(known, ["_id", "idx"], "left")


def reached(pointers: DataFrame) -> DataFrame:
    """``<_id, idx>`` of all pieces that piece 0 of their document leads to, itself included."""
    jumps = materialise(pointers.filter(F.col("to").isNotNull()).select("_id", "idx", "to"))
    found = materialise(pointers.filter("idx = 0").select("_id", "idx"))
    n = found.count()
    while True:
        more = found.join(jumps, ["_id", "idx"]).select("_id", F.col("to").alias("idx"))
        found = materialise(found.unionByName(more).distinct())
        before, n = n, found.count()
        if n == before:
            return found
        twice = jumps.select("_id", F.col("idx").alias("to"), F.col("to").alias("_then"))
        jumps = materialise(jumps.join(twice, ["_id", "to"]).select("_id", "idx", F.col("_then").alias("to")))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_BLANK}+|{_BLANK}+$", "")


def chunk_parts(
    parts: DataFrame,
    options: ChunkOptions = ChunkOptions(),
    id: str = "doc_id",
    part: str = "part",
    text: str = "text",
    whole_chars: int = WHOLE_CHARS,
) -> DataFrame:
    """``<id, chunk_index, content, tokens>``: the sentence chunks of documents given in parts.

    ``part`` numbers the parts of a document, each once; a part is expected to end where a sentence
    does (a line, a page). The chunks are those that packing the whole document one sentence after the
    other gives; null and empty parts hold nothing. Documents of at most ``whole_chars`` characters are
    put together and packed by one task each, longer ones by pointers.
    """
    rows = parts.select(F.col(id).alias(id), F.col(part).cast("long").alias(part), F.coalesce(F.col(text), F.lit("")).alias(text)).dropna(subset=[id])
    each = rows.groupBy(id, part).agg(F.count("*").alias("_copies"), F.sum(F.length(text)).alias("_chars"))
    sizes = each.groupBy(id).agg(F.max("_copies").alias("_copies"), F.sum("_chars").alias("_chars"), F.max(F.col(part).isNull()).alias("_unplaced"))
    # a document whose parts aren't numbered, each once, has no order to put them together in
    long = materialise(sizes.filter((F.col("_chars") > whole_chars) | (F.col("_copies") > 1) | F.col("_unplaced")).select(id))
    if long.isEmpty():
        return _chunk_short(rows, options, id, part, text)
    few = fits(long)
    short = _chunk_short(lookup_join(rows, long, [id], "left_anti", small_fits=few), options, id, part, text)
    return short.unionByName(_chunk_long(lookup_join(rows, long, [id], "left_semi", small_fits=few), options, id, part, text))


def _chunk_short(rows: DataFrame, options: ChunkOptions, id: str, part: str, text: str) -> DataFrame:
    """Chunks of documents that one task each puts together."""
    size, overlap = options.size * CHARS_PER_TOKEN, options.overlap * CHARS_PER_TOKEN

    def split(texts: list[str]) -> list[Span]:
        at, pieces = 0, []
        for own in texts:
            pieces += [(at + a, at + b) for a, b in _sentence_pieces(own, size)]
            at += len(own)
        return _trimmed("".join(texts), _pack(pieces, size, overlap))

    listed = F.transform(F.array_sort(F.collect_list(F.struct(part, text))), lambda p: p[text])
    whole = rows.groupBy(id).agg(listed.alias("_texts")).withColumn("_spans", spans_of(split, F.col("_texts")))
    placed = whole.select(id, F.array_join("_texts", "").alias("_whole"), F.posexplode("_spans").alias("chunk_index", "_span"))
    content = F.substring(F.col("_whole"), F.col("_span.start") + 1, F.col("_span.stop") - F.col("_span.start"))
    return placed.select(
        id, F.col("chunk_index").cast("bigint").alias("chunk_index"), content.alias("content"), tx.estimate_tokens(content).alias("tokens")
    )


def _chunk_long(parts: DataFrame, options: ChunkOptions, id: str, part: str, text: str) -> DataFrame:
    """Chunks of documents of any length, by pointers from piece to piece."""
    size, overlap = options.size * CHARS_PER_TOKEN, options.overlap * CHARS_PER_TOKEN
    pieces = materialise(sentence_pieces(parts, size, id, part, text))
    pointers = materialise(next_starts(pieces, size, overlap))
    starts = pointers.join(reached(pointers), ["_id", "idx"])
    last = pieces.groupBy("_id").agg(F.max("idx").alias("_last"))
    spans = starts.join(last, "_id").select(
        "_id", F.col("idx").alias("first"), F.explode(F.sequence("idx", F.coalesce(F.col("end") - 1, "_last"))).alias("idx")
    )
    # a chunk's pieces have ``size`` characters at most
    whole = spans.join(pieces.select("_id", "idx", "piece"), ["_id", "idx"]).groupBy("_id", "first").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "piece"))), lambda p: p["piece"]), "").alias("content")
    )
    kept = whole.withColumn("content", _stripped(F.col("content"))).filter("content <> ''")
    numbered = running_sum(kept.withColumn("_one", F.lit(1)), ["_id"], "first", "_one", "_upto")
    return numbered.select(
        F.col("_id").alias(id),
        (F.col("_upto") - 1).cast("bigint").alias("chunk_index"),
        "content",
        tx.estimate_tokens(F.col("content")).alias("tokens"),
    )
