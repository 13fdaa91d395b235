"""Queries of the operators over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaero.llm import (
    decontamination,
    fill_in_middle,
    html_extraction,
    language_id,
    ngram_jaccard,
    quality_classifier,
    quality_rules,
    secret_scans,
    sentencepiece_sampling,
    sharding,
    substring_dedup,
    token_counts,
    tokenizer_alignment,
)
from quaero.llm.common import table

BUILDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
TOKEN_LIMIT = 512
SHARDS = 8


def query(key: str):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        BUILDERS[key] = fn
        return fn

    return register


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    return language_id.identify_languages(table(spark, sf_dir, "documents"))


@query("op2_quality_rules")
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document, and whether it is like the others of its language and source."""
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))


@query("op3_ngram_jaccard")
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that are linked by four-word shingle sets of similarity 0.85 or more."""
    return ngram_jaccard.jaccard_groups(table(spark, sf_dir, "documents"), size=4, percent=85)


# all pairs that share a shingle, and their transitive closure: for small tables
TWINS["op3_ngram_jaccard"] = r"""
with recursive words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') as w
    from documents
), sets as (
    select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
           else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s
    from words
), shingles as (
    select doc_id, unnest(s) as x, len(s) as n from sets
), links as (
    select a.doc_id as a, b.doc_id as b from shingles a join shingles b on a.x = b.x and a.doc_id <> b.doc_id
    where 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
    group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach as (
    select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b
)
select doc_id, len(s)::bigint as n_shingles, least(doc_id, coalesce((select min(b) from reach where a = doc_id), doc_id)) as component_id
from sets
"""


@query("op4_decontamination")
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.benchmark_matches(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        (F.size("matches") > 0).alias("contaminated"),
        F.size("matches").cast("long").alias("n_items"),
        F.col("matches.item_id").alias("item_ids"),
        F.array_max("matches.similarity").alias("similarity"),
    )


@query("op5_substring_dedup")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that stood in the corpus before."""
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), windows=True)


@query("op6_sentencepiece_sampling")
def op6_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every document, and whether each decodes to its text."""
    path = public_tokenizers.path(PIECE_BPE)
    docs = table(spark, sf_dir, "documents")
    return segmentation_digest(sentencepiece_sampling.sample_segmentations(docs, path))


def segmentation_digest(found: DataFrame) -> DataFrame:
    """What is kept of the segmentations here: sizes, scores, a hash of the ids, the round trip."""
    return found.select(
        "doc_id",
        F.coalesce(F.size("segmentations"), F.lit(0)).cast("long").alias("n_segmentations"),
        F.transform("segmentations", lambda s: F.size(s.ids).cast("long")).alias("n_pieces"),
        F.col("segmentations.log_prob").alias("log_prob"),
        F.col("segmentations.inclusion").alias("inclusion"),
        F.transform("segmentations", lambda s: F.xxhash64(s.ids)).alias("ids_hash"),
        "round_trip",
    )


@query("op7_html_extraction")
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_extraction.extract_main_text(pages)
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    path = public_tokenizers.path(BYTE_BPE)
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), path)
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query("op9_sharding")
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shard and a place in it for every document; counts of shards differ by one at most."""
    placed = sharding.shard_rows(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op10_secret_scans")
def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    found = secret_scans.secret_spans(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    base = F.filter("spans", lambda s: s.kind != "guess")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


@query("op11_tokenizer_alignment")
def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where two tokenizers end together in every document, and how common the linked tokens are."""
    docs = table(spark, sf_dir, "documents")
    paths = public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE)
    return tokenizer_alignment.link_scores(tokenizer_alignment.align(docs, *paths))


@query("op12_quality_classifier")
def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels of documents that are not held out."""
    docs, labels = (table(spark, sf_dir, name) for name in ("documents", "labels"))
    return quality_classifier.score_quality(docs, labels)


@query("op13_fill_in_middle")
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into lines and put together as suffix, prefix, middle or prefix, suffix, middle."""
    made = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output"), 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restored(), 256).alias("restored_sha256"),
    )


TWINS["op13_fill_in_middle"] = """
with texts as (
    select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents
), lines as (
    select doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as l,
           [('0x' || substr(h, 1 + 8 * k, 8))::bigint for k in range(4)] as d
    from texts
), cuts as (
    select *, len(l) as n, least(d[1] % (len(l) + 1), d[2] % (len(l) + 1)) as a,
           greatest(d[1] % (len(l) + 1), d[2] % (len(l) + 1)) as b
    from lines
), parts as (
    select doc_id, t, n, array_to_string(l[:a], '') as p, array_to_string(l[a + 1:b], '') as m,
           array_to_string(l[b + 1:], '') as s,
           case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') then 'plain'
                when d[4] % 100 < 50 then 'spm' else 'psm' end as form
    from cuts
)
select doc_id, n::bigint as n, form,
       case when form <> 'plain' then length(p)::bigint end as prefix_chars,
       case when form <> 'plain' then length(m)::bigint end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
                        else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(t) as restored_sha256
from parts
"""
