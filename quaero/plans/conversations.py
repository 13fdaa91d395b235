"""Combined contexts, prompts and chat-store operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaero.fixed_values import SOURCES_PREAMBLE
from quaero.operators import chat
from quaero.operators import context as cx
from quaero.operators.sizing import fits, items_of_hits
from quaero.options import ContextOptions
from quaero.plans import lexical_search as ls
from quaero.plans.registry import query

# -- combining --------------------------------------------------------------------------------

PER_NATION = """
s AS (SELECT n_nationkey::BIGINT AS query_id, n_regionkey <> 1 AS success, count(c_custkey) || ' customers' AS content,
  CASE WHEN n_regionkey = 1 THEN 'no table' END AS error, n_nationkey::DOUBLE AS ms FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey <> 2 GROUP BY ALL),
d AS (SELECT n_nationkey::BIGINT AS query_id, n_regionkey NOT IN (1, 3) AS success, count(s_suppkey) || ' suppliers' AS content,
  CASE WHEN n_regionkey IN (1, 3) THEN 'index gone' END AS error, 1.5::DOUBLE AS ms FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey <> 4 GROUP BY ALL)"""


@query(
    "combine_sources",
    f"""WITH {PER_NATION}, j AS (SELECT query_id, s.success AS so, d.success AS do_, s.content AS sc, d.content AS dc, s.error AS se, d.error AS de, s.ms AS sm, d.ms AS dm FROM s FULL JOIN d USING (query_id))
SELECT query_id, concat_ws(chr(10) || chr(10), CASE WHEN so THEN '=== DATABASE RESULTS ===' || chr(10) || sc WHEN se IS NOT NULL THEN '=== DATABASE ===' || chr(10) || '(Query failed: ' || se || ')' END,
  CASE WHEN do_ THEN '=== DOCUMENT CONTEXT ===' || chr(10) || dc WHEN de IS NOT NULL THEN '=== DOCUMENTS ===' || chr(10) || '(Retrieval failed: ' || de || ')' END) AS context,
  concat_ws(',', CASE WHEN so THEN 'structured' END, CASE WHEN do_ THEN 'unstructured' END) AS sources_used, coalesce(sm, 0) + coalesce(dm, 0) AS total_ms,
  'Sources: ' || concat_ws(', ', CASE WHEN so THEN '[OK] structured' WHEN NOT so THEN '[FAIL] structured' END, CASE WHEN do_ THEN '[OK] unstructured' WHEN NOT do_ THEN '[FAIL] unstructured' END) AS summary FROM j""",
)
def combine_sources(t):
    """Per nation: customers from the tables, suppliers as the document side, some of them failed."""
    customers = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    suppliers = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))

    def side(counts, what, failed, ms, error):
        found = t.nation.join(counts, "n_nationkey", "left")
        bad = F.col("n_regionkey").isin(*failed)
        return found.select(
            F.col("n_nationkey").cast("bigint").alias("query_id"),
            "n_regionkey",
            (~bad).alias("success"),
            F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(what)).alias("content"),
            F.when(bad, error).alias("error"),
            ms.cast("double").alias("ms"),
        )

    tables = side(customers, " customers", (1,), F.col("n_nationkey"), "no table")
    documents = side(suppliers, " suppliers", (1, 3), F.lit(1.5), "index gone")
    return cx.combine_sources(
        tables.filter("n_regionkey <> 2").drop("n_regionkey"),
        documents.filter("n_regionkey <> 4").drop("n_regionkey"),
    )


@query(
    "sources_summary",
    """SELECT doc_id, 'Sources: ' || concat_ws(', ', CASE WHEN quality = 1 THEN '[OK] structured' ELSE '[FAIL] structured' END,
  CASE WHEN toxic = 0 THEN '[OK] unstructured' WHEN quality = 1 THEN '[FAIL] unstructured' END) AS summary FROM labels""",
)
def sources_summary(t):
    documents = F.when(F.col("toxic") == 0, True).when(F.col("quality") == 1, False)
    return t.labels.select(
        "doc_id", cx.sources_summary(F.col("quality") == 1, documents).alias("summary")
    )


CUT = """
blocks AS (SELECT doc_id, repeat('row of ' || source || chr(10), (n_chars % 700)::BIGINT) AS db, text AS doc, 'note on ' || lang AS other FROM documents),
sized AS (SELECT *, 6000 - least(length(db), 3600) - 20 AS room, concat_ws(chr(10), nullif(db, ''), nullif(doc, ''), other) AS whole,
  string_split(doc, chr(10)) AS paras FROM blocks),
sums AS (SELECT *, list_transform(range(1, len(paras) + 1), lambda i: list_sum(list_transform(paras[1:i], lambda p: length(p) + 1))) AS upto FROM sized),
cut AS (SELECT *, len(list_filter(upto, lambda u: u <= room)) AS kept FROM sums),
parts AS (SELECT doc_id, whole, CASE WHEN length(db) > 3600 THEN substr(db, 1, 3600) || chr(10) || '... [truncated]' ELSE db END AS db_part,
  CASE WHEN room > 200 THEN CASE WHEN length(doc) <= room THEN doc ELSE regexp_replace(array_to_string(paras[1:kept], chr(10)), '\\s+$', '') || chr(10) || '... [truncated]' END ELSE '' END AS doc_part,
  CASE WHEN room > 100 AND length(other) <= room THEN other ELSE '' END AS other_part FROM cut)"""


@query(
    "truncate_context",
    f"""WITH {CUT} SELECT doc_id, CASE WHEN length(whole) <= 6000 THEN whole
  ELSE concat_ws(chr(10), nullif(db_part, ''), nullif(doc_part, ''), nullif(other_part, '')) END AS context FROM parts""",
)
def truncate_context(t):
    database = F.repeat(F.concat(F.lit("row of "), "source", F.lit("\n")), (F.col("n_chars") % 700).cast("int"))
    other = F.concat(F.lit("note on "), "lang")
    cut = cx.truncate_context(F.col("db"), F.col("text"), F.col("other"), ContextOptions(separator="\n"))
    return t.documents.select("doc_id", "text", database.alias("db"), other.alias("other")).select(
        "doc_id", cut.alias("context")
    )


@query(
    "answer_prompts",
    """SELECT conv_id, turn, role <> 'system' AS complete, CASE role WHEN 'system' THEN 'Answer ' || text || ' at once {missing}'
  ELSE 'Context: ' || role || chr(10) || 'Question: ' || text || ' (' || role || ')' END AS prompt,
  CASE role WHEN 'system' THEN 'query_str,missing' ELSE 'context_str,query_str,context_str' END AS variables FROM conversations""",
)
def answer_prompts(t):
    template = F.when(F.col("role") == "system", "Answer {query_str} at once {missing}").otherwise(
        "Context: {context_str}\nQuestion: {query_str} ({context_str})"
    )
    asked = t.conversations.withColumn("template", template)
    filled = cx.fill_template(F.col("template"), context_str=F.col("role"), query_str=F.col("text"))
    return asked.select(
        "conv_id",
        "turn",
        cx.has_variables(F.col("template"), "context_str", "query_str").alias("complete"),
        filled.alias("prompt"),
        F.concat_ws(",", cx.template_variables(F.col("template"))).alias("variables"),
    )


@query(
    "wrap_sources",
    f"""WITH {ls.INDEX},{ls.bm25_sql("questions", "lex", 150)} SELECT query_id, '{SOURCES_PREAMBLE.replace("'", "''")}' || chr(10) || chr(10) ||
  string_agg('<BEGIN SOURCE>' || chr(10) || text || chr(10) || '</END SOURCE>', chr(10) || chr(10) ORDER BY rank) AS text
  FROM lex JOIN documents ON doc_id = item_id GROUP BY query_id""",
)
def wrap_sources(t):
    few = fits(ls.questions(t))
    texts = items_of_hits(ls.items(t), ls.lexical_hits(t, 150), ["item_id"], few)
    return cx.wrap_sources(texts.select("query_id", "rank", F.col("text").alias("content")))


# -- chats ------------------------------------------------------------------------------------


def messages(t):
    return t.conversations.select(
        F.col("conv_id").alias("chat_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content")
    )


@query(
    "pack_history",
    """WITH m AS (SELECT conv_id AS chat_id, turn AS seq, length(text) // 4 AS tokens, 40 AS prompt_tokens FROM conversations),
r AS (SELECT *, sum(tokens) OVER (PARTITION BY chat_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS upto FROM m)
SELECT chat_id, seq, tokens FROM r WHERE upto <= 300 - prompt_tokens""",
)
def pack_history(t):
    sized = messages(t).select(
        "chat_id",
        "seq",
        F.floor(F.length("content") / 4).cast("bigint").alias("tokens"),
        F.lit(40).alias("prompt_tokens"),
    )
    return chat.pack_history(sized, F.lit(300)).select("chat_id", "seq", "tokens")


@query(
    "attach_sources_to_previous",
    f"""WITH cited AS (SELECT doc_id // 16 AS chat_id, (doc_id // 2) % 8 AS seq, doc_id % 2 AS place, text FROM documents),
b AS (SELECT chat_id, seq - 1 AS seq, string_agg('<BEGIN SOURCE>' || chr(10) || text || chr(10) || '</END SOURCE>', chr(10) || chr(10) ORDER BY place) AS blocks FROM cited GROUP BY ALL),
nxt AS (SELECT conv_id AS chat_id, turn - 1 AS seq, true AS has_next FROM conversations)
SELECT conv_id AS chat_id, turn AS seq, CASE WHEN has_next AND blocks IS NOT NULL THEN text || chr(10) || chr(10) || '{SOURCES_PREAMBLE.replace("'", "''")}' || chr(10) || chr(10) || blocks
  ELSE text END AS content FROM conversations LEFT JOIN b ON b.chat_id = conv_id AND b.seq = turn LEFT JOIN nxt ON nxt.chat_id = conv_id AND nxt.seq = turn""",
)
def attach_sources_to_previous(t):
    """Two documents are cited by every message position."""
    cited = t.documents.select(
        F.floor(F.col("doc_id") / 16).alias("chat_id"),
        (F.floor(F.col("doc_id") / 2) % 8).alias("seq"),
        (F.col("doc_id") % 2).alias("place"),
        F.col("text").alias("content"),
    )
    return chat.attach_sources_to_previous(messages(t), cited).select("chat_id", "seq", "content")


@query(
    "truncate_from_sequence",
    """SELECT conv_id AS chat_id, turn AS seq, role, text AS content FROM conversations LEFT JOIN customer ON c_custkey = conv_id AND c_mktsegment = 'BUILDING'
WHERE c_custkey IS NULL OR turn < c_nationkey % 4""",
)
def truncate_from_sequence(t):
    """Chats numbered like a building customer are cut at a sequence number of that customer."""
    cuts = t.customer.filter("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("chat_id"), (F.col("c_nationkey") % 4).alias("from_seq")
    )
    return chat.truncate_from_sequence(messages(t), cuts)


@query(
    "duplicate_chat",
    """WITH m AS (SELECT conv_id AS chat_id, turn AS seq, role, text AS content, conv_id % 7 AS user_id, NULL::TIMESTAMP AS created_at FROM conversations)
SELECT * FROM m UNION ALL SELECT chat_id + 1000000, seq, role, content, c_nationkey + 100, TIMESTAMP '2024-02-01 12:00:00' FROM m JOIN customer ON c_custkey = chat_id AND c_mktsegment = 'FURNITURE'""",
)
def duplicate_chat(t):
    owned = messages(t).withColumns(
        {"user_id": F.col("chat_id") % 7, "created_at": F.lit(None).cast("timestamp_ntz")}
    )
    copies = t.customer.filter("c_mktsegment = 'FURNITURE'").select(
        F.col("c_custkey").alias("chat_id"),
        (F.col("c_custkey") + 1000000).alias("new_chat_id"),
        (F.col("c_nationkey") + 100).cast("bigint").alias("new_user_id"),
    )
    return chat.duplicate_chats(owned, copies, F.lit("2024-02-01 12:00:00").cast("timestamp_ntz"))


@query(
    "chat_transcript",
    "SELECT conv_id AS chat_id, turn AS seq, role || ': ' || text AS line FROM conversations",
)
def chat_transcript(t):
    return chat.transcript_lines(messages(t))


@query(
    "citations_by_file",
    """WITH chunk AS (SELECT doc_id AS chunk_id, source AS file_id FROM documents), f AS (SELECT DISTINCT source AS file_id, upper(source) AS name FROM documents),
cite AS (SELECT user_id AS message_id, (props->>'$.k')::BIGINT AS chunk_id FROM events)
SELECT message_id, file_id, name, count(*) AS n FROM cite JOIN chunk USING (chunk_id) JOIN f USING (file_id) GROUP BY ALL""",
)
def citations_by_file(t):
    cited = t.events.select(
        F.col("user_id").alias("message_id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("chunk_id"),
    )
    chunks = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("file_id"))
    files = t.documents.select(F.col("source").alias("file_id"), F.upper("source").alias("name")).distinct()
    return chat.citations_by_file(cited, chunks, files)


@query(
    "chats_of_workspace",
    """SELECT o_custkey, o_orderkey, o_orderdate FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')
ORDER BY o_orderdate DESC, o_orderkey""",
)
def chats_of_workspace(t):
    wanted = t.customer.filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    return chat.rows_of_workspace(rows, "o_custkey", wanted, [F.desc("o_orderdate"), F.col("o_orderkey")])


@query(
    "bucket_by_recency",
    """SELECT event_id, CASE WHEN m >= TIMESTAMP '2024-01-20' THEN 'Today' WHEN m >= TIMESTAMP '2024-01-19' THEN 'Yesterday'
  WHEN m >= TIMESTAMP '2024-01-13' THEN 'Previous Week' ELSE 'Older' END AS bucket
FROM (SELECT event_id, coalesce(CASE WHEN event_type = 'view' THEN ts + INTERVAL 2 DAY END, ts) AS m FROM events)""",
)
def bucket_by_recency(t):
    updated = F.when(F.col("event_type") == "view", F.col("ts") + F.expr("INTERVAL 2 DAYS"))
    now = F.lit("2024-01-20 15:30:00").cast("timestamp_ntz")
    return t.events.select(
        "event_id", chat.recency_bucket(updated, F.col("ts"), now).alias("bucket")
    )


@query(
    "search_by_name",
    """SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'wid') AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)""",
)
def search_by_name(t):
    selected = t.lineitem.filter("l_returnflag = 'R' AND l_quantity > 45").select(
        F.col("l_partkey").alias("p_partkey")
    )
    return chat.search_by_name(t.part.select("p_partkey", "p_name"), "p_name", "WID", "p_partkey", selected)


@query(
    "visible_rows",
    """SELECT o_orderkey, o_custkey, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey
WHERE c_mktsegment IN ('BUILDING', 'FURNITURE') OR o_orderpriority = '1-URGENT'""",
)
def visible_rows(t):
    """Priority is the owner; orders of building and furniture customers are shared."""
    shared = F.col("c_mktsegment").isin("BUILDING", "FURNITURE")
    parents = t.customer.select(
        F.col("c_custkey").alias("o_custkey"), F.when(shared, "public").otherwise("private").alias("sharing")
    )
    me = t.orders.select("o_orderpriority").distinct().filter("o_orderpriority = '1-URGENT'")
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    return chat.visible_rows(rows, parents, "o_custkey", "o_orderpriority", me)


@query(
    "link_expand",
    """SELECT DISTINCT p_partkey, s_suppkey, p_name, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
)
def link_expand(t):
    links = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"))
    parts, suppliers = t.part.select("p_partkey", "p_name"), t.supplier.select("s_suppkey", "s_name")
    return chat.link_expand(parts, links, suppliers, "p_partkey", "s_suppkey")


@query(
    "attach_collection_files",
    """WITH c AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_linestatus = 'O')
SELECT * FROM c WHERE (l_suppkey, l_partkey) NOT IN (SELECT (l_suppkey, l_partkey) FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F')
  AND (l_suppkey, l_partkey) NOT IN (SELECT (l_suppkey, l_partkey) FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F')""",
)
def attach_collection_files(t):
    keys = ["l_suppkey", "l_partkey"]
    links = t.lineitem.select(*keys, "l_returnflag", "l_linestatus")
    collection = links.filter("l_linestatus = 'O'").select(*keys).distinct()
    in_chat = links.filter("l_returnflag = 'R' AND l_linestatus = 'F'")
    in_message = links.filter("l_returnflag = 'A' AND l_linestatus = 'F'")
    return chat.attach_collection_files(collection, in_chat, in_message, keys)


@query(
    "substitute_variables",
    """SELECT conv_id * 100 + turn AS prompt_id, 'Dear ' || role || ', ' || text || ' / {{open}} ' || role AS content, 'role,text,open,role' AS names FROM conversations""",
)
def substitute_variables(t):
    key = (F.col("conv_id") * 100 + F.col("turn")).alias("prompt_id")
    prompts = t.conversations.select(key, F.lit("Dear {{role}}, {{text}} / {{open}} {{role}}").alias("content"))
    values = t.conversations.select(
        key,
        F.explode(
            F.array(
                F.struct(F.lit("role").alias("name"), F.col("role").alias("value")),
                F.struct(F.lit("text").alias("name"), F.col("text").alias("value")),
            )
        ).alias("v"),
    ).select("prompt_id", "v.*")
    named = prompts.withColumn("names", F.concat_ws(",", chat.variables(F.col("content"))))
    return chat.substitute_variables(named, values)
