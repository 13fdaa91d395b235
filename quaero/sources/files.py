"""Reading documents from folders and flattening them to text."""

from __future__ import annotations

import errno
import json
import os
import re
from collections.abc import Iterator, Sequence
from html.entities import name2codepoint
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quaero.fixed_values import DOCUMENT_EXTENSIONS
from quaero.operators.sizing import lookup_join, materialise


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, or empty."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def discover_documents(
    spark: SparkSession, folder: str, extensions: Sequence[str] = DOCUMENT_EXTENSIONS
) -> DataFrame:
    """Files below the folder with an accepted extension; contents are not read.

    Folders that are local or mounted are listed by the tasks. Elsewhere Spark's reader lists, which holds the
    names of all files in the driver.
    """
    path = local_path(spark, folder)
    most = 8 * spark.sparkContext.defaultParallelism
    if path is None or path.startswith("//") or GLOB.search(path) or not os.path.isdir(path):
        # the reader plans tasks for files that are opened; names and lengths of many take a few tasks
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        files = listed.select(F.col("path").alias("file_path"), F.col("length").alias("size"))
    else:
        files = list_files(spark, path, most).select(
            F.concat(F.lit("file:"), F.make_valid_utf8(F.col("path").cast("string"))).alias("file_path"), "size"
        )
    return files.coalesce(most).select(
        "file_path",
        base_name(F.col("file_path")).alias("file_name"),
        extension(F.col("file_path")).alias("ext"),
        "size",
    ).filter(F.col("ext").isin(*extensions))


GLOB = re.compile(r"[{}\[\]*?\\]")
NAMES_AT_ONCE = 10_000


def list_files(spark: SparkSession, path: str, tasks: int) -> DataFrame:
    """``<path, size>`` of all files below a local or mounted folder that Spark's reader would list.

    Level by level: the tasks list the folders of a level, and the folders found there are dealt out for the
    next one. No more than the names of some files is held anywhere, however many a folder has.
    """
    names = ["path", "size"]

    def hidden(name: bytes, is_folder: bool) -> bool:
        bare = name.startswith(b"_") and b"=" not in name
        left_out = bare or name.startswith(b".") or name.endswith(b"._COPYING_")
        return left_out and not (is_folder and name.startswith((b"_metadata", b"_common_metadata")))

    def entries(folder: bytes) -> Iterator[tuple[bytes, int | None]]:
        try:
            with os.scandir(folder) as found:
                for entry in found:
                    try:
                        is_folder = entry.is_dir()
                        size = None if is_folder else entry.stat().st_size
                    except OSError as error:  # gone meanwhile, or a link to nothing or to itself
                        if error.errno not in (errno.ENOENT, errno.ELOOP):
                            raise
                        continue
                    if size != 0 and not hidden(entry.name, is_folder):
                        yield entry.path, size
        except FileNotFoundError:  # the folder is gone meanwhile
            pass

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (row for folder in batch[0].to_pylist() for row in entries(folder))
            while rows := list(islice(found, NAMES_AT_ONCE)):
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    top = os.fsencode(os.path.normpath(path))
    folders = spark.createDataFrame([(bytearray(top),)], "path binary").coalesce(1)
    files = None
    while files is None or not folders.isEmpty():
        level = materialise(folders.mapInArrow(listing, "path binary, size long"))
        here = level.filter("size IS NOT NULL")
        files = here if files is None else files.unionByName(here)
        folders = level.filter("size IS NULL").select("path").repartition(tasks, "path")
    return files


def local_path(spark: SparkSession, folder: str) -> str | None:
    """The path of a folder that is local or mounted; None if only Spark's file systems reach it."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(?://[^/]*)?", folder)
    if scheme:
        return folder[scheme.end() :] if scheme[1] == "file" else None
    usual = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    return folder if usual.startswith("file:") and folder.startswith("/") else None


def write_text_files(rows: DataFrame, folder: str, key: str) -> None:
    """``rows<key, text>`` as text files in a folder ``key=value`` for each whole number that is a key.

    The layout of ``partitionBy(key).text(folder)``: rows of one key that are in one task share a file.
    For every file and folder that Spark makes on a local or mounted file system a process is started (to
    set permissions), so there the tasks write the files themselves; elsewhere Spark writes them.
    """
    path = local_path(rows.sparkSession, folder)
    if path is None:
        rows.select(key, "text").write.partitionBy(key).text(folder)
        return
    os.makedirs(path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, parts = TaskContext.get(), None, []
        name = f"part-{task.partitionId():05d}.txt"

        def finish() -> None:
            # a file that is being written is hidden, and one that a lost task left is written anew
            own = f"{path}/{key}={last}"
            os.makedirs(own, exist_ok=True)
            with open(f"{own}/_{name}-{task.taskAttemptId()}", "wb") as out:
                for part in parts:
                    out.write(part)
                    out.write(b"\n")
            os.replace(out.name, f"{own}/{name}")

        n = 0
        for batch in batches:
            for value, text in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                if parts and value != last:
                    finish()
                    n, parts = n + 1, []
                last = value
                parts.append(text)
        if parts:
            finish()
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["files"])

    named = F.coalesce(F.col(key).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    whole = rows.select(named.alias("name"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    whole.sortWithinPartitions("name").mapInArrow(write, "files long").agg(F.sum("files")).collect()


def stats_by_extension(files: DataFrame) -> DataFrame:
    return files.groupBy("ext").agg(F.count("*").alias("n"))


def read_text_documents(spark: SparkSession, folder: str, pattern: str = "*.{txt,md,json}") -> DataFrame:
    """One row per text file. A file that cannot be read does not stop the others."""
    return (
        spark.read.option("ignoreCorruptFiles", True)
        .option("ignoreMissingFiles", True)
        .text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
        .select(
            F.col("value").alias("text"),
            F.col("_metadata.file_name").alias("file_name"),
            F.col("_metadata.file_path").alias("file_path"),
        )
    )


def read_with_failures(
    spark: SparkSession, folder: str, pattern: str = "*.{txt,md,json}", max_bytes: int = 1 << 30
) -> tuple[DataFrame, DataFrame]:
    """``(<text, file_name, file_path>, <file_name, file_path, reason>)``: every file with any
    bytes is in one of the two.

    Files are listed without their contents first; the reader lists none of 0 bytes. A file fails if it
    holds more than ``max_bytes``, anything that is no UTF-8, or if it is listed but cannot be read
    (gone or broken).
    """
    source = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    listed = source.load(folder).select("path", "length")
    small = source.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(folder)
    small = small.filter(F.col("length") <= max_bytes)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    read = small.select("path", valid.alias("_valid"), F.when(valid, F.col("content").cast("string")).alias("text"))
    named = [base_name(F.col("path")).alias("file_name"), F.col("path").alias("file_path")]
    judged = lookup_join(listed, read.select("path", "_valid"), ["path"], "left")
    reason = (
        F.when(F.col("length") > max_bytes, "too large")
        .when(F.col("_valid").isNull(), "cannot be read")
        .when(~F.col("_valid"), "not UTF-8")
    )
    failures = judged.select(*named, reason.alias("reason")).filter("reason IS NOT NULL")
    return read.filter("_valid").select("text", *named), failures


def html_title(page: Column) -> Column:
    return strip_tags(F.regexp_extract(page, r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>", 1))


def html_headings(page: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(page, F.lit(r"(?is)<h[1-6](?:\s[^>]*)?>(.*?)</h[1-6]\s*>"), F.lit(1)),
        strip_tags,
    )


ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


#: references that most pages hold no others than; the ampersand comes last, so that none is resolved twice
FREQUENT = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "\u00a9", "middot": "\u00b7", "amp": "&"}
RARE = rf"&(?!(?:{'|'.join(FREQUENT)});)" + ENTITY[1:]


def resolve_entities(text: Column) -> Column:
    """Named and numeric character references, each resolved once; unknown ones stay.

    Texts with frequent references only are a few plain replacements; a table of all names is
    searched for the others.
    """
    plain = text
    for name, character in FREQUENT.items():
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(character))
    rare = F.regexp_like(text, F.lit(RARE))
    return F.when(text.isNull() | ~F.contains(text, F.lit("&")), text).when(~rare, plain).otherwise(_resolve_any(text))


def _resolve_any(text: Column) -> Column:
    known = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'", "nbsp": " "}
    letters = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])

    def letter(name: Column) -> Column:
        hexadecimal = F.lower(F.substring(name, 2, 1)) == "x"
        digits = F.when(hexadecimal, F.substring(name, 3, 6)).otherwise(
            F.conv(F.substring(name, 2, 7), 10, 16)
        )
        numeric = F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")
        named = F.when(F.startswith(name, F.lit("#")), numeric).otherwise(F.try_element_at(letters, name))
        return F.coalesce(named, F.concat(F.lit("&"), name, F.lit(";")))

    between = F.split(text, ENTITY)
    names = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(1))
    whole = F.zip_with(between, names, lambda t, n: F.concat(t, F.when(n.isNull(), "").otherwise(letter(n))))
    return F.concat_ws("", whole)


def strip_tags(fragment: Column) -> Column:
    """Text of a fragment: tags gone, character references resolved, blanks collapsed."""
    bare = resolve_entities(F.regexp_replace(fragment, "<[^>]*>", " "))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def body_markup(page: Column) -> Column:
    """Page without head, scripts, styles, navigation and comments."""
    kept = page
    for tag in ("head", "script", "style", "nav"):
        kept = F.regexp_replace(kept, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>", " ")
    return F.regexp_replace(kept, r"(?s)<!--.*?-->", " ")


def html_to_text(page: Column) -> Column:
    return strip_tags(body_markup(page))


def csv_row_text(columns: Sequence[str]) -> Column:
    """``name: value`` lines of a row; nulls are empty."""
    return F.concat_ws(
        "\n",
        *[
            F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("")))
            for c in columns
        ],
    )


@F.pandas_udf(StringType())
def json_text(documents: pd.Series) -> pd.Series:
    """All text leaves of a JSON document, in order, joined with blanks."""

    def leaves(node):
        if isinstance(node, str):
            yield node
        elif isinstance(node, dict):
            for child in node.values():
                yield from leaves(child)
        elif isinstance(node, list):
            for child in node:
                yield from leaves(child)

    def flat(document):
        try:
            return " ".join(leaves(json.loads(document)))
        except (TypeError, ValueError):
            return None

    return documents.map(flat)


def unique_records(records: DataFrame) -> DataFrame:
    """The records without exact copies.

    Copies meet on a digest of the whole record, and one row's columns are kept of each; partial
    aggregation keeps one per task, so a record that is there a million times moves once per task.
    """
    digest = F.sha2(F.to_json(F.struct(*records.columns)), 256)
    return (
        records.groupBy(digest.alias("_digest"))
        .agg(F.any_value(F.struct(*records.columns)).alias("_record"))
        .select("_record.*")
    )


def import_records(records: DataFrame, type_column: str = "contentType") -> DataFrame:
    """Records per type after dropping exact copies.

    Copies meet on type and digest, so that no long text is shuffled.
    """
    digest = F.sha2(F.to_json(F.struct(*records.columns)), 256)
    unique = records.select(type_column, digest.alias("_digest")).distinct()
    return unique.groupBy(type_column).agg(F.count("*").alias("n"))
