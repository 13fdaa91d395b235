"""Data operations on chats: histories, links, visibility and lists."""

from __future__ import annotations



from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.fixed_values import SOURCES_PREAMBLE
from quaero.operators.context import wrap_source
from quaero.operators.sizing import lookup_join, running_sum


def pack_history(messages: DataFrame, context_tokens: Column) -> DataFrame:
    """Newest messages per chat while their running token sum fits, stopping at the first miss.

    ``messages<chat_id, seq, tokens, prompt_tokens, ...>``. Token counts are never negative, so
    the running sum decides the prefix exactly; it is built in blocks, whatever the chat length.
    """
    newest_first = messages.withColumn("_age", -F.col("seq"))
    summed = running_sum(newest_first, ["chat_id"], "_age", "tokens", "_upto")
    return summed.filter(F.col("_upto") <= context_tokens - F.col("prompt_tokens")).drop("_age", "_upto")


def attach_sources_to_previous(messages: DataFrame, sources: DataFrame) -> DataFrame:
    """Message i gets the sources cited by message i + 1.

    ``messages<chat_id, seq, content>``, ``sources<chat_id, seq, place, content>``. Sequence
    numbers are consecutive within a chat, so the next message is met by an equi join.
    """
    block = wrap_source(F.col("content")).alias("block")
    listed = F.array_sort(F.collect_list(F.struct("place", block)))
    # a message cites a top-k list, so its array is small
    per_message = sources.groupBy("chat_id", "seq").agg(
        F.concat_ws("\n\n", F.transform(listed, lambda s: s["block"])).alias("_blocks")
    )
    previous = per_message.withColumn("seq", F.col("seq") - 1)
    following = messages.select("chat_id", (F.col("seq") - 1).alias("seq"), F.lit(True).alias("_next"))
    joined = messages.join(previous, ["chat_id", "seq"], "left").join(
        following, ["chat_id", "seq"], "left"
    )
    text = F.concat("content", F.lit(f"\n\n{SOURCES_PREAMBLE}\n\n"), "_blocks")
    return joined.withColumn(
        "content",
        F.when(F.col("_next") & F.col("_blocks").isNotNull(), text).otherwise(F.col("content")),
    ).drop("_blocks", "_next")


def truncate_from_sequence(messages: DataFrame, cuts: DataFrame) -> DataFrame:
    """Drop messages at or after the given sequence number of their chat (``cuts<chat_id, from_seq>``)."""
    joined = lookup_join(messages, cuts.select("chat_id", "from_seq"), ["chat_id"], "left")
    keep = F.col("from_seq").isNull() | (F.col("seq") < F.col("from_seq"))
    return joined.filter(keep).drop("from_seq")


def duplicate_chats(messages: DataFrame, copies: DataFrame, now: Column) -> DataFrame:
    """All messages plus copies under new chat and user ids.

    ``copies<chat_id, new_chat_id, new_user_id>``; copies carry ``now`` as their time.
    """
    copied = lookup_join(messages, copies, ["chat_id"]).withColumns(
        {"chat_id": F.col("new_chat_id"), "user_id": F.col("new_user_id"), "created_at": now}
    )
    return messages.unionByName(copied.select(*messages.columns))


def transcript_lines(messages: DataFrame) -> DataFrame:
    """One line per message in reading order; a chat of any length stays in rows."""
    line = F.concat("role", F.lit(": "), "content")
    return messages.select("chat_id", "seq", line.alias("line")).orderBy("chat_id", "seq")


def citations_by_file(citations: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Cited chunks per message and parent file (``citations<message_id, chunk_id>``)."""
    # a chunk or file cited everywhere is a hot key of the left side
    parents = lookup_join(citations, chunks.select("chunk_id", "file_id"), ["chunk_id"])
    counted = parents.groupBy("message_id", "file_id").agg(F.count("*").alias("n"))
    return lookup_join(counted, files.select("file_id", "name"), ["file_id"])


def rows_of_workspace(rows: DataFrame, workspace: str, wanted: DataFrame, order: list[Column]) -> DataFrame:
    """Rows of the wanted workspaces, newest first."""
    return lookup_join(rows, wanted.select(workspace).distinct(), [workspace], "left_semi").orderBy(*order)


def recency_bucket(updated: Column, created: Column, now: Column) -> Column:
    """Today, Yesterday, Previous Week or Older; all bounds are midnights before ``now``."""
    moment = F.coalesce(updated, created)
    today = F.date_trunc("day", now)
    return (
        F.when(moment >= today, "Today")
        .when(moment >= today - F.expr("INTERVAL 1 DAY"), "Yesterday")
        .when(moment >= today - F.expr("INTERVAL 7 DAYS"), "Previous Week")
        .otherwise("Older")
    )


def search_by_name(rows: DataFrame, name: str, term: str, key: str, selected: DataFrame) -> DataFrame:
    """Rows whose name contains the term in any case, without those already selected."""
    found = rows.filter(F.contains(F.lower(name), F.lower(F.lit(term))))
    return lookup_join(found, selected.select(key).distinct(), [key], "left_anti")


def visible_rows(rows: DataFrame, parents: DataFrame, parent_key: str, owner: str, me: DataFrame) -> DataFrame:
    """Own rows, and rows whose parent is not private.

    ``parents<parent_key, sharing>``, ``me<owner>``; one pass with both tests as flags.
    """
    shared = parents.filter(F.col("sharing") != "private").select(parent_key, F.lit(True).alias("_shared"))
    mine = me.select(owner, F.lit(True).alias("_mine"))
    marked = lookup_join(lookup_join(rows, shared, [parent_key], "left"), mine, [owner], "left")
    return marked.filter(F.col("_shared") | F.col("_mine")).drop("_shared", "_mine")


def link_expand(left: DataFrame, links: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Many-to-many expansion over a link table; doubled links count once."""
    pairs = links.select(left_key, right_key).distinct()
    return lookup_join(lookup_join(pairs, left, [left_key]), right, [right_key])


def attach_collection_files(collection: DataFrame, in_chat: DataFrame, in_message: DataFrame, keys: list[str]) -> DataFrame:
    """Files of a collection that neither the chat nor the message has yet."""
    return collection.join(in_chat.select(*keys), keys, "left_anti").join(
        in_message.select(*keys), keys, "left_anti"
    )


def variables(template: Column) -> Column:
    """Names in double braces, in order of appearance."""
    return F.regexp_extract_all(template, F.lit(r"\{\{(.*?)\}\}"), F.lit(1))


def substitute_variables(prompts: DataFrame, values: DataFrame) -> DataFrame:
    """Replace ``{{name}}`` in prompts from ``values<prompt_id, name, value>``.

    A prompt has few variables; names are replaced in order.
    """
    pairs = F.array_sort(F.collect_list(F.struct("name", "value")))
    per_prompt = values.groupBy("prompt_id").agg(pairs.alias("_pairs"))
    filled = F.aggregate(
        F.coalesce("_pairs", F.array().cast("array<struct<name:string,value:string>>")),
        F.col("content"),
        lambda text, p: F.replace(text, F.concat(F.lit("{{"), p["name"], F.lit("}}")), p["value"]),
    )
    return prompts.join(per_prompt, "prompt_id", "left").withColumn("content", filled).drop("_pairs")
