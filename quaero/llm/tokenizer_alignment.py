"""Alignment of two tokenizers over the same texts, as Arrow tables from the tokens to the counts.

Both tokenizers spell the same bytes: a blank and the text. Token ids of many texts are one flat array
with a parent index for each token; a cumulative sum of token lengths, less the sum at the start of
its text, is the byte where a token ends. A hash join of both sides on (text, end) finds where two
tokens end together: these places cut a text into groups, and the two tokens that end there are a link.

How often two ids are linked is counted by ``Table.group_by`` inside the tasks, and Spark adds up the
partial counts. Counts then meet the links of each text in two tiers: the commonest pairs (a table of
bounded size) inside the tasks, the others by a shuffle, in which no pair can be common.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaero.llm.common import whole_text, written
from quaero.llm.token_counts import PATTERN

GROUP = 1 << 18  # characters of texts that are aligned together
PIECE = 1 << 18  # characters of a long text that are encoded at once
COMMON_PAIRS = 1 << 16  # pairs whose counts go to every task (13 bytes each)
PARTIAL_ROWS = 1 << 18  # partial counts that a task keeps before it hands them on

_BLANK = "▁"
_OLD_SCRIPTS = re.compile("[\x00-\u036f\u0391-\u03a1\u03a3-\u03ce\u0400-\u045f\u2010-\u2027\u2030-\u205e]*+")


class ByteLevel:
    """A byte-level BPE file of the ``tokenizers`` library; special strings in a text are plain text.

    Where the file's merges make tokens in the order of their ids, ``tiktoken`` finds the same tokens
    from the file's own vocabulary, several times as fast. It is given texts of old scripts only
    (``_OLD_SCRIPTS``): which newer characters are letters depends on the Unicode version of a library.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # byte-level BPE writes printable bytes as themselves and the others from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(plain)]
        self.byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
        self.cuts = True
        self.ranked = self._ranked(path)

    def _ranked(self, path: str):
        """The same vocabulary in tiktoken, or None where ids don't follow the merges."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [model["vocab"].get(x + y) for x, y in merges]
        if ids != list(range(256, 256 + len(ids))):
            return None
        ranks = {self._bytes(t): i for t, i in model["vocab"].items() if i < 256 + len(ids)}
        return tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def spelled(self) -> list[bytes]:
        names = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        return [self._bytes(names.get(i, "")) for i in range(max(names) + 1)]

    def _bytes(self, token: str) -> bytes:
        if all(c in self.byte_of for c in token):
            return bytes(self.byte_of[c] for c in token)
        return token.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        fast = [self.ranked is not None and _OLD_SCRIPTS.fullmatch(t) is not None for t in texts]
        slow = [f" {t}" for t, f in zip(texts, fast) if not f]
        found = iter(self.tokenizer.encode_batch_fast(slow, add_special_tokens=False) if slow else [])
        return [self.ranked.encode_ordinary(f" {t}") if f else next(found).ids for t, f in zip(texts, fast)]


class Pieces:
    """A ``sentencepiece`` model, which adds the blank before a text itself."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        # texts may be cut before a blank as long as no piece reaches across one
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.cuts = not any(_BLANK in n.lstrip(_BLANK) for n in names)

    def spelled(self) -> list[bytes]:
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        return [
            bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace(_BLANK, " ").encode()
            for i, n in enumerate(names)
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """A long text, cut where a single blank stands between two other characters; the blank goes.

    Both tokenizers begin a new token at such a blank, and both are given one before each piece.
    """
    at = 0
    while len(text) - at > most:
        end = text.find(" ", at + most)
        while 0 <= end < len(text) - 1 and (text[end - 1].isspace() or text[end + 1].isspace()):
            end = text.find(" ", end + 1)
        if not 0 <= end < len(text) - 1:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:]


def token_lists(tokenizer, texts: list[str], most: int = PIECE) -> pa.ListArray:
    """Token ids of every text; an empty text has none."""
    cut = [list(pieces(t, most)) if tokenizer.cuts else [t] for t in texts]
    flat, sizes = [], []
    block, room = [], most

    def flush() -> None:
        for ids in tokenizer.encode(block):
            flat.append(np.asarray(ids, dtype=np.int32))
            sizes.append(len(ids))
        block.clear()

    for p in (p for parts in cut for p in parts):
        if block and room < len(p):
            flush()
            room = most
        block.append(p)
        room -= len(p)
    flush()
    ends = np.r_[0, np.cumsum(sizes)]
    offsets = ends[np.r_[0, np.cumsum([len(parts) for parts in cut])].astype(int)]
    values = np.concatenate(flat) if flat else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


class Spelling:
    """Bytes of a vocabulary's tokens."""

    def __init__(self, spelled: list[bytes]) -> None:
        self.tokens = pa.array(spelled, pa.large_binary())
        self.lengths = pc.binary_length(self.tokens)

    def joined(self, ids: pa.Array) -> np.ndarray:
        """All tokens one after the other: the bytes that the taken array itself is made of."""
        found = self.tokens.take(ids)
        ends = np.frombuffer(found.buffers()[1], dtype=np.int64)[: len(found) + 1]
        raw = np.frombuffer(found.buffers()[2] or b"", dtype=np.uint8)
        return raw[ends[0] : ends[-1]] if len(found) else raw[:0]


def token_ends(lists: pa.ListArray, spelling: Spelling) -> pa.Table:
    """``<doc, end, pos>`` of every token: its text, the byte in it where it ends, its place among all."""
    ids = pc.list_flatten(lists)
    parents = pc.list_parent_indices(lists)
    sums = pc.cumulative_sum(pc.cast(spelling.lengths.take(ids), pa.int64()))
    before = pa.concat_arrays([pa.array([0], pa.int64()), sums])
    starts = before.take(lists.offsets.slice(0, len(lists)))
    ends = pc.subtract(sums, starts.take(parents))
    return pa.table({"doc": parents, "end": ends, "pos": pa.array(np.arange(len(ids)))})


def _spells(lists: pa.ListArray, spelling: Spelling, texts: list[bytes]) -> np.ndarray:
    """Which texts the tokens spell, byte for byte."""
    raw = spelling.joined(pc.list_flatten(lists))
    sums = np.r_[0, np.cumsum(spelling.lengths.take(pc.list_flatten(lists)).to_numpy())]
    cuts = sums[lists.offsets.to_numpy()].astype(int)
    return np.array([raw[a:b].tobytes() == t for a, b, t in zip(cuts[:-1], cuts[1:], texts)], dtype=bool)


def _kept(lists: pa.ListArray, keep: np.ndarray) -> pa.ListArray:
    """The lists, emptied where ``keep`` doesn't hold."""
    sizes = np.diff(lists.offsets.to_numpy())
    if keep.all():
        return lists
    values = pc.list_flatten(lists).filter(pa.array(np.repeat(keep, sizes)))
    offsets = np.r_[0, np.cumsum(np.where(keep, sizes, 0))]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _sizes(places: np.ndarray, docs: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """Tokens in each group, from the place of its last one."""
    starts = lists.offsets.to_numpy()[docs].astype(np.int64)
    before = np.r_[0, places[:-1] + 1][: len(places)]
    return (places + 1 - np.maximum(before, starts)).astype(np.int32)


def align_texts(texts: list[str], a, b, spell_a: Spelling, spell_b: Spelling) -> list[pa.ListArray]:
    """``[a, b, a_sizes, b_sizes]``: ids of both tokenizers and how many of them each group holds."""
    whole = [f" {t}".encode() if t else b"" for t in texts]
    a_ids, b_ids = token_lists(a, texts), token_lists(b, texts)
    keep = np.array([len(t) > 0 for t in texts], dtype=bool)
    keep &= _spells(a_ids, spell_a, whole) & _spells(b_ids, spell_b, whole)
    a_ids, b_ids = _kept(a_ids, keep), _kept(b_ids, keep)
    met = token_ends(a_ids, spell_a).join(
        token_ends(b_ids, spell_b), keys=["doc", "end"], join_type="inner", right_suffix="_b", use_threads=False
    )
    met = met.sort_by("pos")
    docs = met["doc"].to_numpy()
    offsets = pa.array(np.r_[0, np.cumsum(np.bincount(docs, minlength=len(texts)))], pa.int32())
    sizes = [
        pa.ListArray.from_arrays(offsets, pa.array(_sizes(met[pos].to_numpy(), docs, ids)))
        for pos, ids in (("pos", a_ids), ("pos_b", b_ids))
    ]
    return [a_ids, b_ids, *sizes]


def _by_size(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts in runs of about ``GROUP`` characters, with the place of the first; long ones alone."""
    start, run, size = 0, [], 0
    for k, value in enumerate(column):
        t = value.as_py()
        if run and size + len(t) > GROUP:
            yield start, run
            start, run, size = k, [], 0
        run.append(t)
        size += len(t)
    if run:
        yield start, run


def align(df: DataFrame, path_a: str, path_b: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``<_row, id, a, b, a_sizes, b_sizes>`` of every row: token ids and tokens in each group.

    ``path_a`` is a byte-level file of the tokenizers library (given a blank and the text), ``path_b`` a
    sentencepiece model. Neither adds special tokens. Texts that are null, empty or not spelled byte for
    byte by both have empty lists. ``_row`` numbers the rows of the written result, as ids may be null
    or repeat; rows stay as many as they are. Other columns are not read, whatever their names.
    """
    rows = df.select(F.col(id).alias("_id"), whole_text(text).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = ByteLevel(path_a), Pieces(path_b)
        spell_a, spell_b = Spelling(a.spelled()), Spelling(b.spelled())
        for batch in batches:
            for start, run in _by_size(batch.column("_text")):
                lists = align_texts(run, a, b, spell_a, spell_b)
                ids = batch.column("_id").slice(start, len(run))
                yield pa.record_batch([ids, *lists], names=["_id", "a", "b", "a_sizes", "b_sizes"])

    lists = "a array<int>, b array<int>, a_sizes array<int>, b_sizes array<int>"
    found = rows.mapInArrow(encode, f"_id {kind}, {lists}")
    found = found.withColumnRenamed("_id", id).withColumn("_row", F.monotonically_increasing_id())
    return written(found, "alignment")


def _lasts(batch: pa.RecordBatch, side: str) -> pa.Array:
    """Id of the last token of each group."""
    places = pc.subtract(pc.cumulative_sum(pc.cast(pc.list_flatten(batch.column(f"{side}_sizes")), pa.int64())), 1)
    return pc.list_flatten(batch.column(side)).take(places)


def _links(batch: pa.RecordBatch) -> pa.Table:
    """``<doc, a, b>``: the links of the batch."""
    docs = pc.list_parent_indices(batch.column("a_sizes"))
    return pa.table({"doc": docs, "a": _lasts(batch, "a"), "b": _lasts(batch, "b")})


def _rows_of(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    for t in tables:
        yield from t.combine_chunks().to_batches(max_chunksize=1 << 16)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``<a, b, n>``: how many links hold the two ids, over all rows of :func:`align`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def added(tables: list[pa.Table]) -> pa.Table:
            whole = pa.concat_tables(tables)
            summed = whole.group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")])
            return summed.rename_columns({"n_sum": "n"})

        kept: list[pa.Table] = []
        for batch in batches:
            links = _links(batch).select(["a", "b"])
            kept.append(links.append_column("n", pa.array(np.ones(len(links), np.int64))))
            if sum(map(len, kept)) > 2 * PARTIAL_ROWS:
                kept = [added(kept)]
                if len(kept[0]) > PARTIAL_ROWS:
                    yield from _rows_of(kept)
                    kept = []
        if kept:
            yield from _rows_of([added(kept)])

    partial = aligned.select("a", "b", "a_sizes", "b_sizes").mapInArrow(count, "a int, b int, n long")
    return partial.groupBy("a", "b").agg(F.sum("n").alias("n"))


def group_texts(batch: pa.RecordBatch) -> pa.Array:
    """Groups of each row as a text: ``a1,a2|b1;a3|b2,b3``."""
    sides = []
    for side in ("a", "b"):
        sizes = pc.list_flatten(batch.column(f"{side}_sizes")).to_numpy()
        offsets = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
        ids = pc.cast(pc.list_flatten(batch.column(side)), pa.string())
        sides.append(pc.binary_join(pa.ListArray.from_arrays(offsets, ids), ","))
    groups = pc.binary_join_element_wise(*sides, "|")
    rows = np.r_[0, np.cumsum(pc.list_value_length(batch.column("a_sizes")).to_numpy())]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(rows, pa.int32()), groups), ";")


def link_scores(aligned: DataFrame, id: str = "doc_id", common: int = COMMON_PAIRS) -> DataFrame:
    """``<id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256>`` of every row of :func:`align`.

    ``count_sum`` adds up, over a row's links, how often their pair of ids is linked anywhere;
    ``n_best`` counts links whose pair is the commonest of its B id, ties included. Rows without
    tokens have zeros and an empty digest. Counts of the ``common`` commonest pairs are broadcast; a
    pair beyond them holds at most one in ``common`` of all links, so the shuffle has no hot key.
    """
    spark = aligned.sparkSession
    counts = written(pair_counts(aligned), "pairs")
    # one row for each id of B: a vocabulary's size at most
    highest = counts.groupBy("b").agg(F.max("n").alias("_most"))
    rated = counts.join(F.broadcast(highest), "b").select("a", "b", "n", (F.col("n") == F.col("_most")).alias("best"))
    top = rated.orderBy(F.desc("n"), "a", "b").limit(common).toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, top.schema) as out:
        out.write_table(top)
    shipped = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    kind = aligned.schema[id].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.ipc.open_stream(shipped.value).read_all()
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                links = _links(batch)
                n_links = np.bincount(links["doc"].to_numpy(), minlength=len(batch))
                pairs = links.group_by(["doc", "a", "b"], use_threads=False).aggregate([([], "count_all")])
                met = pairs.join(known, keys=["a", "b"], join_type="left outer", use_threads=False)
                doc, times = met["doc"].to_numpy(), met["count_all"].to_numpy()
                n = met["n"].fill_null(0).to_numpy()
                best = met["best"].fill_null(False).to_numpy(zero_copy_only=False)
                n_best, total = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
                np.add.at(n_best, doc, times * best)
                np.add.at(total, doc, times * n)
                left = met.filter(pc.is_null(met["n"])).sort_by("doc").combine_chunks()
                offsets = np.r_[0, np.cumsum(np.bincount(left["doc"].to_numpy(), minlength=len(batch)))]
                entries = pa.StructArray.from_arrays(
                    [left[c].combine_chunks() for c in ("a", "b", "count_all")], names=["a", "b", "times"]
                )
                texts = group_texts(batch)
                digests = [hashlib.sha256(t.as_buffer()).hexdigest() if k else "" for t, k in zip(texts, n_links)]
                yield pa.record_batch(
                    [
                        batch.column("_row"),
                        batch.column("_id"),
                        pc.cast(pc.list_value_length(batch.column("a")), pa.int64()),
                        pc.cast(pc.list_value_length(batch.column("b")), pa.int64()),
                        pa.array(n_links, pa.int64()),
                        pa.array(n_best),
                        pa.array(total),
                        pa.array(digests, pa.string()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries),
                    ],
                    names=["_row", "_id", "n_a", "n_b", "n_links", "n_best", "count_sum", "groups_sha256", "rest"],
                )

    shape = (
        f"_row long, _id {kind}, n_a long, n_b long, n_links long, n_best long, count_sum long, "
        "groups_sha256 string, rest array<struct<a: int, b: int, times: long>>"
    )
    scored = written(aligned.withColumnRenamed(id, "_id").mapInArrow(score, shape), "scores")
    rest = scored.select("_row", F.explode("rest").alias("_pair")).select("_row", "_pair.*")
    rest_rated = rest.join(rated, ["a", "b"])
    more = rest_rated.groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    )
    facts = ["_id", "n_a", "n_b", "n_links", "groups_sha256"]
    both = scored.drop("rest").unionByName(more, allowMissingColumns=True)
    added = both.groupBy("_row").agg(
        F.max(F.struct(F.col("n_a").isNotNull(), *facts)).alias("_doc"),
        F.sum("n_best").alias("n_best"),
        F.sum("count_sum").alias("count_sum"),
    )
    return added.select(
        F.col("_doc._id").alias(id),
        "_doc.n_a",
        "_doc.n_b",
        F.col("_doc.n_links").alias("n_groups"),
        "_doc.n_links",
        "n_best",
        "count_sum",
        "_doc.groups_sha256",
    )
