"""Sources, chunking and chunk metadata over ``documents``, ``pages`` and the relational tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quaero.functions import text as tx
from quaero.operators import chunking as ch
from quaero.operators import metadata as md
from quaero.operators import packing
from quaero.operators.sizing import lookup_join, running_sum, shared_folder
from quaero.options import ChunkOptions
from quaero.plans.registry import query
from quaero.sources import files, store, tables, trace

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def work_folder(spark, name: str) -> str:
    """A new folder for a round trip, inside the shared folder of the session."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# -- sources ----------------------------------------------------------------------------------


@query(
    "discover_documents",
    "SELECT doc_id, '.txt' AS ext, (strlen(text) + 1)::BIGINT AS size FROM documents WHERE text IS NOT NULL",
)
def discover_documents(t):
    """Every document written as a text file in a folder of its id, and found again."""
    path = work_folder(t.spark, "files")
    files.write_text_files(t.documents.dropna(subset=["text"]), path, "doc_id")
    found = files.discover_documents(t.spark, path)
    doc_id = F.regexp_extract("file_path", r"/doc_id=(\d+)/", 1).cast("bigint")
    return found.select(doc_id.alias("doc_id"), "ext", "size")


@query(
    "document_stats_by_ext",
    r"""SELECT ext, count(*) AS n FROM (SELECT lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '(\.[^./]+)$', 1)) AS ext FROM pages)
WHERE ext <> '' GROUP BY ext""",
)
def document_stats_by_ext(t):
    path = F.regexp_replace("url", "[?#].*$", "")
    return files.stats_by_extension(t.pages.select(files.extension(path).alias("ext")).filter("ext <> ''"))


@query(
    "read_text_documents",
    "SELECT sum(len(string_split(text, chr(10))))::BIGINT AS lines, sum(length(text) + 1)::BIGINT AS chars FROM documents",
)
def read_text_documents(t):
    """All documents as text files of at most 50 each, read back one row per file."""
    path = work_folder(t.spark, "texts")
    t.documents.select("text").write.option("maxRecordsPerFile", 50).text(path)
    read = files.read_text_documents(t.spark, path)
    return read.agg(
        F.sum(F.regexp_count("text", F.lit("\n"))).alias("lines"), F.sum(F.length("text")).alias("chars")
    )


HTML_BODY = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<head(\s[^>]*)?>.*?</head\s*>', ' ', 'g'), '(?is)<script(\s[^>]*)?>.*?</script\s*>', ' ', 'g'), '(?is)<style(\s[^>]*)?>.*?</style\s*>', ' ', 'g'),
  '(?is)<nav(\s[^>]*)?>.*?</nav\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')"""


def strip_sql(x: str) -> str:
    return rf"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'),
  '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))"""


@query(
    "html_to_text",
    rf"""SELECT page_id, {strip_sql(r"regexp_extract(html, '(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>', 1)")} AS title,
  array_to_string(list_transform(regexp_extract_all(html, '(?is)<h[1-6](?:\s[^>]*)?>(.*?)</h[1-6]\s*>', 1),
    lambda h: {strip_sql("h")}), ' | ') AS headings,
  {strip_sql(HTML_BODY)} AS text FROM pages""",
)
def html_to_text(t):
    html = F.col("html")
    return t.pages.select(
        "page_id",
        files.html_title(html).alias("title"),
        F.concat_ws(" | ", files.html_headings(html)).alias("headings"),
        files.html_to_text(html).alias("text"),
    )


@query(
    "flatten_csv_rows",
    """SELECT p_partkey, 'p_partkey: ' || p_partkey || chr(10) || 'p_name: ' || coalesce(p_name, '') || chr(10) ||
  'p_brand: ' || coalesce(p_brand, '') || chr(10) || 'p_type: ' || coalesce(p_type, '') AS content FROM part""",
)
def flatten_csv_rows(t):
    block = files.csv_row_text(["p_partkey", "p_name", "p_brand", "p_type"])
    rows = t.part.select("p_partkey", block.alias("text"))
    return ch.chunk_recursive(rows, separators=ch.ROW_SEPARATORS).select("p_partkey", "content")


@query(
    "flatten_json_values",
    """SELECT event_id, event_type || ' user ' || user_id || ' ' || props AS text FROM events""",
)
def flatten_json_values(t):
    who = F.struct(F.concat(F.lit("user "), "user_id").alias("who"), F.col("value").alias("value"))
    document = F.to_json(
        F.struct("event_type", "event_id", F.array(who).alias("users"), F.col("props").alias("note"))
    )
    return t.events.select("event_id", files.json_text(document).alias("text"))


INCLUDE = ("region", "nation", "customer", "orders", "lineitem", "part", "supplier")
EXCLUDE = ("supplier",)


@query(
    "read_relational_source",
    " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}"
        for n in tables.select_tables(TABLE_NAMES, INCLUDE, EXCLUDE)
    ),
)
def read_relational_source(t):
    out = None
    for name in tables.select_tables(TABLE_NAMES, INCLUDE, EXCLUDE):
        counted = getattr(t, name).agg(F.count("*").alias("row_count"))
        counted = counted.select(F.lit(name).alias("table_name"), "row_count")
        out = counted if out is None else out.unionByName(counted)
    return out


def document_chunks(t):
    """Window chunks of whole documents with their file and source."""
    docs = t.documents.select(F.col("doc_id").alias("file_id"), "source", "text")
    return ch.chunk_char_windows(docs)


CHUNKS = """
pieces AS (SELECT doc_id AS file_id, source, text, unnest(range(0, greatest(length(text) - 201, 0) + 1, 3800)) AS pos
  FROM documents WHERE length(text) > 0),
chunks AS (SELECT file_id, source, (pos // 3800)::BIGINT AS chunk_index, substr(text, pos + 1, 4000) AS content,
  length(substr(text, pos + 1, 4000)) // 4 AS tokens FROM pieces)"""


@query(
    "write_chunk_store",
    f"WITH {CHUNKS} SELECT source, count(*) AS chunks, sum(tokens)::BIGINT AS tokens FROM chunks GROUP BY source",
)
def write_chunk_store(t):
    """Store all chunks, find them on a second call, and count what is in the store."""
    path = work_folder(t.spark, "chunks")
    store.get_or_create(t.spark, path, lambda: document_chunks(t))
    stored = store.get_or_create(t.spark, path, lambda: document_chunks(t))
    return stored.groupBy("source").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"))


@query(
    "upsert_chunks_and_totals",
    f"""WITH {CHUNKS}, incoming AS (SELECT file_id, chunk_index, upper(content) AS content, tokens + 1 AS tokens FROM chunks
  WHERE source IN ('src1', 'src2')),
merged AS (SELECT file_id, tokens, content FROM chunks WHERE file_id NOT IN (SELECT file_id FROM incoming)
  UNION ALL SELECT file_id, tokens, content FROM incoming)
SELECT file_id, sum(tokens)::BIGINT AS tokens, count(*) AS chunks FROM merged GROUP BY file_id""",
)
def upsert_chunks_and_totals(t):
    existing = document_chunks(t).drop("source")
    incoming = (
        document_chunks(t)
        .filter(F.col("source").isin("src1", "src2"))
        .drop("source")
        .withColumn("content", F.upper("content"))
        .withColumn("tokens", F.col("tokens") + 1)
    )
    return store.file_totals(store.upsert_chunks(existing, incoming))


@query(
    "write_read_trace_log",
    "SELECT user_id::VARCHAR AS query_id, event_type AS phase, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
)
def write_read_trace_log(t):
    """Events as trace records to JSON lines and back under the fixed schema."""
    path = work_folder(t.spark, "trace")
    records = t.events.select(
        F.col("user_id").cast("string").alias("query_id"),
        F.col("ts").cast("string").alias("timestamp"),
        F.create_map("event_type", "value").alias("phases"),
    )
    trace.write_trace_log(records, path)
    back = trace.read_trace_log(t.spark, path)
    return (
        back.select("query_id", F.explode("phases").alias("phase", "ms"))
        .groupBy("query_id", "phase")
        .agg(F.count("*").alias("n"), F.round(F.sum("ms"), 4).alias("total"))
    )


@query(
    "import_records_dedup",
    """SELECT "contentType", count(*) AS n FROM (SELECT DISTINCT lang AS "contentType", text FROM documents) GROUP BY ALL""",
)
def import_records_dedup(t):
    return files.import_records(t.documents.select(F.col("lang").alias("contentType"), "text"))


# -- chunking ---------------------------------------------------------------------------------


@query("import_records_unique", """SELECT DISTINCT lang AS "contentType", text FROM documents""")
def import_records_unique(t):
    return files.unique_records(t.documents.select(F.col("lang").alias("contentType"), "text"))


@query(
    "read_with_failures",
    """SELECT sum(length(text) + 1)::BIGINT AS chars, 'not UTF-8' AS reason, true AS adds_up FROM documents WHERE doc_id % 7 <> 3""",
)
def read_with_failures(t):
    """Every seventh document is written in another encoding: its files appear as failures, the others are read."""
    path = work_folder(t.spark, "encodings")
    other = F.pmod("doc_id", F.lit(7)) == 3
    t.documents.filter(~other).select("text").write.option("maxRecordsPerFile", 50).text(f"{path}/plain")
    t.documents.filter(other).select("text").write.option("encoding", "UTF-16").json(f"{path}/other")
    rows, failures = files.read_with_failures(t.spark, path)
    names = rows.select("file_path", F.lit(None).cast("string").alias("reason")).unionByName(failures.select("file_path", "reason"))
    listed = t.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,json}")
    n = listed.load(path).agg(F.count("*").alias("n"))
    return (
        names.agg(F.max("reason").alias("reason"), F.count("*").alias("found"))
        .join(F.broadcast(n), F.lit(True))
        .join(F.broadcast(rows.agg(F.sum(F.length("text")).alias("chars"))), F.lit(True))
        .select("chars", "reason", (F.col("found") == F.col("n")).alias("adds_up"))
    )


@query("estimate_tokens", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def estimate_tokens(t):
    return t.documents.select("doc_id", tx.estimate_tokens(F.col("text")).alias("tokens"))


@query(
    "approx_word_tokens",
    r"""SELECT doc_id, greatest(1, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))) AS words FROM documents""",
)
def approx_word_tokens(t):
    return t.documents.select("doc_id", tx.word_count(F.col("text")).alias("words"))


@query(
    "chunk_char_windows",
    f"WITH {CHUNKS} SELECT file_id, source, chunk_index, content, tokens FROM chunks",
)
def chunk_char_windows(t):
    return document_chunks(t)


SMALL_CHUNKS = ChunkOptions(size=128, overlap=16)


def fixed_chunks(t, options=SMALL_CHUNKS):
    return ch.chunk_fixed(t.documents.select("doc_id", "text"), options)


BLANKS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def packed_sql(size: int, overlap: int) -> str:
    """Sentences packed to chunks: a walk from chunk to chunk over the places where pieces start and stop."""
    cut = f"list_transform(range(0, length(w), {size}), lambda k: substr(w, k::INT + 1, {size}))"
    words = r"regexp_extract_all(x, '\s*\S+\s*')"
    return rf"""
sentences AS (SELECT doc_id, text, list_filter(regexp_extract_all(text, '[^.!?\n]*(?:[.!?\n]+\s*|$)'), lambda x: x <> '') AS s
  FROM documents WHERE text <> ''),
pieces AS (SELECT doc_id, text, flatten(list_transform(s, lambda x: CASE WHEN length(x) <= {size} THEN [x]
  ELSE flatten(list_transform(CASE WHEN len({words}) > 0 THEN {words} ELSE [x] END, lambda w: {cut})) END)) AS p FROM sentences),
placed AS (SELECT doc_id, i, length(x) AS n, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS stop
  FROM (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM pieces)),
places AS (SELECT doc_id, list(stop - n ORDER BY i) AS starts, list(stop ORDER BY i) AS stops FROM placed GROUP BY doc_id),
walk AS (SELECT doc_id, 0 AS k, 1::BIGINT AS first, starts, stops, len(list_filter(stops, lambda x: x <= {size})) + 1 AS j FROM places
  UNION ALL SELECT doc_id, k + 1, f, starts, stops, len(list_filter(stops, lambda x: x <= starts[f] + {size})) + 1
  FROM (SELECT *, len(list_filter(starts, lambda x: x < greatest(starts[j] - {overlap}, stops[j] - {size}))) + 1 AS f
    FROM walk WHERE j <= len(stops))),
cuts AS (SELECT w.doc_id, k, trim(substr(text, starts[first]::INT + 1, (coalesce(starts[j], stops[-1]) - starts[first])::INT), {BLANKS}) AS content
  FROM walk w JOIN pieces p ON p.doc_id = w.doc_id),
packed AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS chunk_index, content, length(content) // 4 AS tokens
  FROM cuts WHERE content <> '')"""


@query("chunk_fixed", f"WITH RECURSIVE {packed_sql(512, 64)} SELECT doc_id, chunk_index, content, tokens FROM packed")
def chunk_fixed(t):
    return fixed_chunks(t)


@query("chunk_parts", f"WITH RECURSIVE {packed_sql(512, 64)} SELECT doc_id, chunk_index, content, tokens FROM packed")
def chunk_parts(t):
    """The same chunks of documents that come line by line."""
    lines = F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\n]+\n*|\n+"), F.lit(0)))
    parts = t.documents.select("doc_id", lines.alias("part", "text"))
    return packing.chunk_parts(parts, SMALL_CHUNKS)


@query(
    "chunk_fixed_invariants",
    """SELECT doc_id, true AS all_within_size, true AS all_in_text FROM documents WHERE trim(text) <> ''""",
)
def chunk_fixed_invariants(t):
    """Every chunk is within size and a verbatim part of its document."""
    texts = t.documents.select("doc_id", "text", F.col("text").alias("_whole"))
    cut = ch.chunk_fixed(texts, SMALL_CHUNKS)
    limit = SMALL_CHUNKS.size * ch.CHARS_PER_TOKEN
    return cut.groupBy("doc_id").agg(
        F.every(F.length("content") <= limit).alias("all_within_size"),
        F.every(F.contains("_whole", "content")).alias("all_in_text"),
    )


@query("chunk_recursive")
def chunk_recursive(t):
    return ch.chunk_recursive(t.documents.select("doc_id", "text"), 1000, 100)


@query(
    "chunk_recursive_invariants",
    """SELECT doc_id, true AS all_within_size, true AS all_in_text FROM documents WHERE trim(text) <> ''""",
)
def chunk_recursive_invariants(t):
    texts = t.documents.select("doc_id", "text", F.col("text").alias("_whole"))
    return (
        ch.chunk_recursive(texts, 1000, 100)
        .groupBy("doc_id")
        .agg(
            F.every(F.length("content") <= 1000).alias("all_within_size"),
            F.every(F.contains("_whole", "content")).alias("all_in_text"),
        )
    )


SECTIONS = rf"""
cut AS (SELECT page_id, string_split(regexp_replace({HTML_BODY}, '(<(?:h[1-6]|p)>)', chr(1) || '\1', 'g'), chr(1)) AS parts FROM pages),
texts AS (SELECT page_id, list_filter(list_transform(parts, lambda s: {strip_sql("s")}), lambda s: s <> '') AS parts FROM cut),
sections AS (SELECT page_id, unnest(parts) AS content, generate_subscripts(parts, 1) - 1 AS chunk_index FROM texts)"""


def page_sections(t):
    pages = t.pages.select("page_id", files.body_markup(F.col("html")).alias("text"))
    return ch.chunk_by_structure(pages, "<(?:h[1-6]|p)>", clean=files.strip_tags)


@query(
    "chunk_by_structure",
    f"WITH {SECTIONS} SELECT page_id, chunk_index, content, length(content) // 4 AS tokens FROM sections",
)
def chunk_by_structure(t):
    return page_sections(t)


@query(
    "resplit_oversized",
    f"""WITH {SECTIONS} SELECT page_id, chunk_index, length(content) // 4 > 192 AS was_split FROM sections""",
)
def resplit_oversized(t):
    parts = ch.resplit_oversized(page_sections(t), SMALL_CHUNKS)
    return parts.groupBy("page_id", "chunk_index").agg(
        ((F.max("part") > 0) | (F.max("tokens") > SMALL_CHUNKS.max_tokens)).alias("was_split")
    )


MARKDOWN = """
md AS (SELECT page_id, '   ' || chr(10) || regexp_extract(url, '//([^/]+)', 1) || chr(10) || '# ' ||
  regexp_extract(url, '/([a-z]{2})/', 1) || chr(10) || chr(10) || CASE WHEN url LIKE 'https%' THEN '## ' || trim(regexp_extract(html, '<title>(.*?)</title>', 1))
  ELSE 'plain' END || chr(10) || 'text' || chr(10) || '### late' AS text FROM pages)"""


def markdown(t):
    title = F.trim(F.regexp_extract("html", "<title>(.*?)</title>", 1))
    text = F.concat_ws(
        "\n",
        F.lit("   "),
        F.regexp_extract("url", "//([^/]+)", 1),
        F.concat(F.lit("# "), F.regexp_extract("url", "/([a-z]{2})/", 1)),
        F.lit(""),
        F.when(F.col("url").like("https%"), F.concat(F.lit("## "), title)).otherwise("plain"),
        F.lit("text"),
        F.lit("### late"),
    )
    return t.pages.select("page_id", text.alias("text"))


@query(
    "extract_heading",
    r"""SELECT page_id, CASE WHEN url LIKE 'https%' AND trim(regexp_extract(html, '<title>(.*?)</title>', 1)) <> ''
  THEN trim(regexp_extract(html, '<title>(.*?)</title>', 1)) ELSE regexp_extract(url, '/([a-z]{2})/', 1) END AS heading FROM pages""",
)
def extract_heading(t):
    return markdown(t).select("page_id", ch.extract_heading(F.col("text")).alias("heading"))


@query(
    "number_chunks",
    f"""WITH {CHUNKS} SELECT file_id, chunk_index,
  (count(*) OVER (ORDER BY file_id, chunk_index ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS corpus_index FROM chunks""",
)
def number_chunks(t):
    """Position within the document, and within the corpus through per-document counts."""
    return ch.number_chunks(document_chunks(t).select("file_id", "chunk_index"))


# -- metadata ---------------------------------------------------------------------------------

URL_PATTERNS = (
    r"^https?://(?P<host>[^/]+)",
    r"/(?P<lang>[a-z]{2})/(?P<code>\d+)",
    r"\?(?P<query>[^#]+)",
    r"^https?://(?:m|blog)\.(?P<host>[^/]+)",
)
URL_SQL = r"""
meta AS (SELECT page_id, url, coalesce(nullif(regexp_extract(url, '^https?://(?:m|blog)\.([^/]+)', 1), ''),
    nullif(regexp_extract(url, '^https?://([^/]+)', 1), '')) AS host,
  nullif(regexp_extract(url, '/([a-z]{2})/(\d+)', 1), '') AS lang, nullif(regexp_extract(url, '/([a-z]{2})/(\d+)', 2), '') AS code,
  nullif(regexp_extract(url, '\?([^#]+)', 1), '') AS query FROM pages)"""


def url_metadata(t):
    fields = md.filename_metadata(F.col("url"), URL_PATTERNS)
    return t.pages.select("page_id", "url", *[c.alias(n) for n, c in fields.items()])


@query("filename_metadata", f"WITH {URL_SQL} SELECT page_id, host, lang, code, query FROM meta")
def filename_metadata(t):
    return url_metadata(t).drop("url")


@query(
    "enrich_from_lookup",
    r"""WITH single AS (SELECT p_size::VARCHAR AS code, arg_max(p_name, p_partkey) AS subject FROM part GROUP BY p_size)
SELECT doc_id, regexp_extract(source, '\d+', 0) AS code, subject FROM documents
LEFT JOIN single ON single.code = regexp_extract(source, '\d+', 0)""",
)
def enrich_from_lookup(t):
    docs = t.documents.select("doc_id", F.regexp_extract("source", r"\d+", 0).alias("code"))
    lookup = t.part.select(
        F.col("p_size").alias("key"), F.col("p_name").alias("value"), F.col("p_partkey").alias("position")
    )
    return md.enrich_from_lookup(docs, lookup, "code", "subject")


H1 = r"trim(regexp_extract(html, '<h1>(.*?)</h1>', 1))"
CONTEXT = f"""CASE WHEN query IS NULL AND {H1} = '' THEN NULL ELSE
  concat_ws(' | ', CASE WHEN query IS NOT NULL THEN 'Fuente: ' || query END, CASE WHEN {H1} <> '' THEN 'Sección: ' || {H1} END) END"""


def with_context(t):
    heading = F.trim(F.regexp_extract("html", "<h1>(.*?)</h1>", 1))
    fields = md.filename_metadata(F.col("url"), URL_PATTERNS)
    return t.pages.select(
        "page_id",
        heading.alias("heading"),
        md.source_context(fields["query"], heading).alias("source_context"),
        fields["lang"].alias("lang"),
        fields["query"].alias("query"),
        files.html_to_text(F.col("html")).alias("content"),
    )


@query(
    "source_context",
    f"WITH {URL_SQL} SELECT page_id, {CONTEXT} AS source_context FROM meta JOIN pages USING (page_id)",
)
def source_context(t):
    return with_context(t).select("page_id", "source_context")


@query(
    "visible_text",
    f"""WITH {URL_SQL}, chunk AS (SELECT page_id, {H1} AS heading, {CONTEXT} AS context, lang, query, {strip_sql(HTML_BODY)} AS content
  FROM meta JOIN pages USING (page_id))
SELECT page_id,
  concat_ws(chr(10), CASE WHEN heading <> '' THEN 'heading: ' || heading END, 'lang: ' || lang, content) AS embed_text,
  concat_ws(chr(10), 'source_context: ' || context, 'lang: ' || lang, 'query: ' || query, content) AS llm_text FROM chunk""",
)
def visible_text(t):
    col = F.col
    return with_context(t).select(
        "page_id",
        md.visible_text(col("content"), {"heading": col("heading"), "lang": col("lang")}).alias("embed_text"),
        md.visible_text(
            col("content"),
            {"source_context": col("source_context"), "lang": col("lang"), "query": col("query")},
        ).alias("llm_text"),
    )


@query("distinct_metadata_values", "SELECT DISTINCT p_brand AS value FROM part WHERE p_brand <> ''")
def distinct_metadata_values(t):
    return md.distinct_values(t.part, F.col("p_brand"))


@query(
    "missing_metadata_audit",
    f"WITH {URL_SQL} SELECT count(*) FILTER (WHERE query IS NULL) AS missing, count(*) AS total FROM meta",
)
def missing_metadata_audit(t):
    return md.missing_audit(url_metadata(t), F.col("query"))


@query(
    "sanitize_file_names",
    r"""WITH names AS (SELECT page_id, url, lower(regexp_replace(url, '[^A-Za-z0-9.]', '_', 'g')) AS valid,
  regexp_extract(url, '[^.]*$', 0) AS ext FROM pages)
SELECT page_id, substr(regexp_replace(valid, '\.[^.]*$', ''), 1, greatest(40 - length(ext) - 1, 0)) || '.' || ext AS name FROM names""",
)
def sanitize_file_names(t):
    return t.pages.select("page_id", md.sanitize_file_name(F.col("url"), 40).alias("name"))


@query("ingest_corpus")
def ingest_corpus(t):
    """Pages to chunks with metadata, context and both visible texts, in one narrow job."""
    fields = md.filename_metadata(F.col("url"), URL_PATTERNS)
    heading = F.trim(F.regexp_extract("html", "<h1>(.*?)</h1>", 1))
    pages = t.pages.select(
        "page_id",
        F.col("url").alias("file_name"),
        fields["lang"].alias("lang"),
        fields["host"].alias("host"),
        files.strip_tags(heading).alias("heading"),
        files.body_markup(F.col("html")).alias("text"),
    )
    sections = ch.chunk_by_structure(pages, "<(?:h[1-6]|p)>", clean=files.strip_tags)
    chunks = ch.resplit_oversized(sections, SMALL_CHUNKS)
    context = md.source_context(F.col("file_name"), F.col("heading"))
    return chunks.select(
        "page_id",
        "chunk_index",
        "part",
        "tokens",
        md.visible_text(
            F.col("content"), {"heading": F.col("heading"), "lang": F.col("lang")}
        ).alias("embed_text"),
        md.visible_text(
            F.col("content"), {"source_context": context, "lang": F.col("lang")}
        ).alias("llm_text"),
    )
