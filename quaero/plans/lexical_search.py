"""Lexical, hybrid and reranked retrieval: ``benchmark`` passages ask, ``documents`` are searched.

A hit is relevant if the document holds the passage. The language named by frequent words of a
passage is its metadata filter.
"""

from __future__ import annotations

import uuid
from functools import cache

from pyspark.sql import functions as F

from quaero.fixed_values import ABLATION_CONFIGS
from quaero.functions import text as tx
from quaero.operators import corrective as co
from quaero.operators import dense, fusion, lexical, postings, prefilter
from quaero.operators import retrieval_metrics as rm
from quaero.operators.sizing import fits, items_of_hits, lookup_join, materialise, shared_folder
from quaero.options import FusionOptions
from quaero.plans.registry import query

LANGUAGE_WORDS = {
    "en": (" the ", " and "),
    "de": (" der ", " die ", " und "),
    "fr": (" les ", " des ", " dans "),
    "es": (" los ", " las ", " el "),
}

# -- shared SQL -------------------------------------------------------------------------------

WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda t: t <> '')"
LANGUAGE = """CASE WHEN n LIKE '% the %' OR n LIKE '% and %' THEN 'en'
  WHEN n LIKE '% der %' OR n LIKE '% die %' OR n LIKE '% und %' THEN 'de'
  WHEN n LIKE '% les %' OR n LIKE '% des %' OR n LIKE '% dans %' THEN 'fr'
  WHEN n LIKE '% los %' OR n LIKE '% las %' OR n LIKE '% el %' THEN 'es' END"""


def bm25_sql(questions: str, name: str, k: int | None = 10, restrict: str = "") -> str:
    """Ranked list ``name`` of ``questions<query_id, text, match>`` over the document words."""
    cut = f" WHERE rank <= {k}" if k else ""
    return f"""
{name}_terms AS (SELECT DISTINCT query_id, unnest({WORDS}) AS term FROM {questions}),
{name}_scored AS (SELECT q.query_id, p.item_id,
  round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 6) AS score
  FROM {name}_terms q JOIN post p USING (term) JOIN docfreq USING (term) {restrict}, corpus GROUP BY q.query_id, p.item_id),
{name}_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM {name}_scored),
{name} AS (SELECT * FROM {name}_ranked{cut})"""


INDEX = f"""
words AS (SELECT doc_id AS item_id, {WORDS} AS ws FROM documents),
post AS (SELECT item_id, term, count(*) AS tf, any_value(len) AS len FROM
  (SELECT item_id, unnest(ws) AS term, len(ws) AS len FROM words) GROUP BY item_id, term),
docfreq AS (SELECT term, count(*) AS df FROM post GROUP BY term),
corpus AS (SELECT count(*)::DOUBLE AS n, avg(len(ws)) AS avgdl FROM words),
normal AS (SELECT item_id AS query_id, text, strip_accents(lower(text)) AS n FROM benchmark),
questions AS (SELECT query_id, text, {LANGUAGE} AS match FROM normal)"""
LEXICAL = INDEX + "," + bm25_sql("questions", "lex")


def vectors_sql(source: str, key: str, name: str) -> str:
    return f"""
{name}_counts AS (SELECT id, ('0x' || substr(md5(term), 1, 6))::INT % 64 AS place, count(*) AS c FROM
  (SELECT {key} AS id, unnest({WORDS}) AS term FROM {source}) GROUP BY ALL),
{name}_norms AS (SELECT id, sqrt(sum(c * c)) AS norm FROM {name}_counts GROUP BY id),
{name} AS (SELECT id, place, c / norm AS x FROM {name}_counts JOIN {name}_norms USING (id))"""


def dense_sql(questions_vectors: str, name: str, k: int, restrict: str = "") -> str:
    return f"""
{name}_scored AS (SELECT q.id AS query_id, d.id AS item_id, round(sum(q.x * d.x), 6) AS score
  FROM {questions_vectors} q JOIN doc_vec d USING (place) GROUP BY ALL),
{name}_ranked AS (SELECT s.*, row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, s.item_id) AS rank
  FROM {name}_scored s {restrict}),
{name} AS (SELECT query_id, item_id, score, rank FROM {name}_ranked WHERE rank <= {k})"""


DENSE = (
    vectors_sql("documents", "doc_id", "doc_vec")
    + ","
    + vectors_sql("benchmark", "item_id", "q_vec")
    + ","
    + dense_sql("q_vec", "den", 10)
)
SAME_LANGUAGE = (
    "JOIN questions q ON q.query_id = s.query_id JOIN documents d ON d.doc_id = s.item_id AND (q.match IS NULL OR d.lang = q.match)"
)
POSTFILTER = """
lexf AS (SELECT l.query_id, item_id, score, row_number() OVER (PARTITION BY l.query_id ORDER BY l.rank) AS rank
  FROM lex l JOIN questions q ON q.query_id = l.query_id JOIN documents d ON d.doc_id = item_id AND (q.match IS NULL OR d.lang = q.match))"""


def fuse_sql(name: str, first: str, second: str, alpha: float, k: int = 10) -> str:
    return f"""
{name}_parts AS (SELECT query_id, item_id, {alpha}::DOUBLE / (60 + rank) AS part, rank AS first FROM {first}
  UNION ALL SELECT query_id, item_id, {1 - alpha}::DOUBLE / (60 + rank), 1000 + rank FROM {second}),
{name}_sums AS (SELECT query_id, item_id, round(sum(part), 9) AS score, min(first) AS first FROM {name}_parts GROUP BY ALL),
{name}_ranked AS (SELECT query_id, item_id, score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank FROM {name}_sums),
{name} AS (SELECT * FROM {name}_ranked WHERE rank <= {k})"""


def rerank_sql(name: str, hits: str, top_n: int) -> str:
    return f"""
{name}_sets AS (SELECT query_id, h.item_id, rank AS before, list_distinct({WORDS.replace("text", "q.text")}) AS a,
  list_distinct({WORDS.replace("text", "d.text")}) AS b
  FROM {hits} h JOIN questions q USING (query_id) JOIN documents d ON d.doc_id = h.item_id),
{name}_scored AS (SELECT query_id, item_id, before,
  round(2 * len(list_intersect(a, b))::DOUBLE / (len(a) + len(b)), 6) AS score FROM {name}_sets),
{name}_ranked AS (SELECT query_id, item_id, score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM {name}_scored),
{name} AS (SELECT * FROM {name}_ranked WHERE rank <= {top_n})"""


HYBRID = LEXICAL + "," + DENSE + "," + fuse_sql("hyb", "den", "lex", 0.5)
OUT = "SELECT query_id, item_id, score, rank FROM "

# -- frames -----------------------------------------------------------------------------------


def questions(t):
    match = prefilter.detect_boost_value(F.col("text"), LANGUAGE_WORDS)
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text", match.alias("match"))


def items(t):
    return t.documents.select(F.col("doc_id").alias("item_id"), "text", F.col("lang").alias("match"))


def with_vectors(df):
    return df.withColumn("vector", dense.hashed_vector(tx.tokens(F.lower("text"))))


def index(t, asked=None, matched=False):
    wanted = lexical.question_terms(questions(t) if asked is None else asked)
    return lexical.build_index(items(t) if matched else items(t).drop("match"), wanted)


def lexical_hits(t, k=10):
    return lexical.bm25_topk(questions(t), index(t), k)


def dense_hits(t, k=10, matched=False, corpus=None):
    corpus = with_vectors(items(t)) if corpus is None else corpus
    return dense.vector_topk(with_vectors(questions(t)), corpus, k, matched=matched)


def hybrid_hits(t, k=10, alpha=0.5):
    """Both lists start from the same split texts."""
    split = lexical.split_items(items(t).drop("match"))
    corpus = split.select("item_id", dense.hashed_vector(F.col("words")).alias("vector"))
    asked = questions(t)
    built = lexical.build_index(split, lexical.question_terms(asked))
    return fusion.retrieve(
        "hybrid",
        lambda n: dense_hits(t, n, corpus=corpus),
        lambda n: lexical.bm25_topk(asked, built, n),
        FusionOptions(alpha=alpha, top_k=k),
    )


# -- queries ----------------------------------------------------------------------------------


@query(
    "bm25_index",
    f"""WITH {INDEX} SELECT term, df, sum(tf)::BIGINT AS occurrences, max(tf) AS max_tf,
  round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf
  FROM post JOIN docfreq USING (term), corpus GROUP BY term, df, n""",
)
def bm25_index(t):
    built = lexical.build_index(items(t).drop("match"))
    size = lexical.one_row(built.stats)
    idf = F.log(1 + (size["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    per_term = built.postings.groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("occurrences"), F.max("tf").alias("max_tf")
    )
    return per_term.withColumn("idf", F.round(idf, 6))


@query("bm25_topk", f"WITH {LEXICAL} {OUT} lex")
def bm25_topk(t):
    return lexical_hits(t)


@query("bm25_stored_topk", f"WITH {LEXICAL} {OUT} lex")
def bm25_stored_topk(t):
    """The index is written once, then the questions read only the blocks their best items can be in."""
    path = f"{shared_folder(t.spark)}/postings-{uuid.uuid4().hex}"
    postings.write_index(items(t).select("item_id", "text"), path)
    return postings.Search(postings.BlockIndex(t.spark, path), questions(t)).run()


@query("bm25_topk_postfilter", f"WITH {LEXICAL}, {POSTFILTER} {OUT} lexf")
def bm25_topk_postfilter(t):
    return lexical.keep_matching(lexical_hits(t), items(t), questions(t), 10)


@query(
    "bm25_topk_prefilter",
    "WITH "
    + INDEX
    + ","
    + bm25_sql(
        "questions",
        "lex",
        10,
        "JOIN questions w ON w.query_id = q.query_id JOIN documents d ON d.doc_id = p.item_id AND (w.match IS NULL OR d.lang = w.match)",
    )
    + f" {OUT} lex",
)
def bm25_topk_prefilter(t):
    return lexical.bm25_topk(questions(t), index(t, matched=True), 10, matched=True)


@query(
    "hashed_vector_topk_prefilter",
    "WITH "
    + INDEX
    + ","
    + vectors_sql("documents", "doc_id", "doc_vec")
    + ","
    + vectors_sql("benchmark", "item_id", "q_vec")
    + ","
    + dense_sql("q_vec", "den", 10, SAME_LANGUAGE)
    + f" {OUT} den",
)
def hashed_vector_topk_prefilter(t):
    return dense_hits(t, matched=True)


@query("rrf_fuse", f"WITH {LEXICAL}, {DENSE}, {fuse_sql('hyb', 'den', 'lex', 0.6, 1000)} {OUT} hyb")
def rrf_fuse(t):
    return fusion.rrf_fuse([(dense_hits(t), 0.6), (lexical_hits(t), 0.4)])


@query("hybrid_topk", f"WITH {HYBRID} {OUT} hyb")
def hybrid_topk(t):
    return hybrid_hits(t)


@query(
    "retrieval_mode",
    f"""WITH {HYBRID}
SELECT 'semantic' AS mode, query_id, item_id, round(1 / (60 + rank), 9) AS score, rank FROM den
UNION ALL SELECT 'bm25', query_id, item_id, round(1 / (60 + rank), 9), rank FROM lex
UNION ALL SELECT 'hybrid', query_id, item_id, score, rank FROM hyb""",
)
def retrieval_mode(t):
    out = None
    for mode in ("semantic", "bm25", "hybrid"):
        got = fusion.retrieve(mode, lambda n: dense_hits(t, n), lambda n: lexical_hits(t, n))
        got = got.select(F.lit(mode).alias("mode"), "*")
        out = got if out is None else out.unionByName(got)
    return out


@query("rerank_topn", f"WITH {LEXICAL}, {rerank_sql('rer', 'lex', 3)} {OUT} rer")
def rerank_topn(t):
    return fusion.rerank_topn(lexical_hits(t), questions(t), items(t), 3)


FILTERED = (
    LEXICAL
    + ","
    + POSTFILTER
    + ","
    + vectors_sql("documents", "doc_id", "doc_vec")
    + ","
    + vectors_sql("benchmark", "item_id", "q_vec")
    + ","
    + dense_sql("q_vec", "den", 10)
    + ","
    + dense_sql("q_vec", "denf", 10, SAME_LANGUAGE)
)
BOOST_WORDS = {"src1": (" of ", " der "), "src2": (" it ", " les "), "src3": (" las ",)}


@query(
    "retrieve_ranked",
    "WITH "
    + FILTERED
    + ","
    + fuse_sql("hyb", "denf", "lexf", 0.6)
    + ","
    + rerank_sql("rer", "hyb", 10)
    + """,
wanted AS (SELECT query_id, CASE WHEN n LIKE '% of %' OR n LIKE '% der %' THEN 'src1'
  WHEN n LIKE '% it %' OR n LIKE '% les %' THEN 'src2' WHEN n LIKE '% las %' THEN 'src3' END AS boost_value FROM normal),
boosted AS (SELECT r.query_id, item_id, r.rank AS before, source || '_' || lang || '_' || doc_id || '.txt' AS file_name,
  round(CASE WHEN source = boost_value THEN score * 1.5 ELSE score END, 9) AS score
  FROM rer r JOIN wanted w ON w.query_id = r.query_id JOIN documents d ON d.doc_id = item_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank, file_name, score FROM boosted""",
)
def retrieve_ranked(t):
    """Filter, retrieve both ways, fuse, rerank, boost; file names in final order."""
    asked = questions(t)
    dense_part = dense_hits(t, matched=True)
    lexical_part = lexical.keep_matching(lexical_hits(t), items(t), asked, 10)
    fused = fusion.rrf_fuse([(dense_part, 0.6), (lexical_part, 0.4)], 10)
    reranked = fusion.rerank_topn(fused, asked, items(t), 10)
    boost = prefilter.detect_boost_value(F.col("text"), BOOST_WORDS)
    wanted = t.benchmark.select(F.col("item_id").alias("query_id"), boost.alias("boost_value"))
    fields = t.documents.select(F.col("doc_id").alias("item_id"), F.col("source").alias("field"))
    final = fusion.apply_metadata_boost(reranked, fields, wanted)
    names = t.documents.select(
        F.col("doc_id").alias("item_id"),
        F.concat("source", F.lit("_"), "lang", F.lit("_"), "doc_id", F.lit(".txt")).alias("file_name"),
    )
    named = items_of_hits(names, final, ["item_id"], fits(asked))
    return named.select("query_id", "rank", "file_name", "score")


@query(
    "retrieval_fallback_lexical",
    f"""WITH {LEXICAL}, {DENSE}, failed AS (SELECT query_id FROM questions WHERE match = 'fr')
SELECT query_id, item_id, score, rank, 'dense' AS method FROM den WHERE query_id NOT IN (SELECT * FROM failed)
UNION ALL SELECT query_id, item_id, score, rank, 'lexical' FROM lex WHERE query_id IN (SELECT * FROM failed)""",
)
def retrieval_fallback_lexical(t):
    asked = with_vectors(questions(t)).withColumn(
        "vector", F.when(F.col("match") == "fr", None).otherwise(F.col("vector"))
    )
    found = dense.vector_topk(asked, with_vectors(items(t)), 10)
    return fusion.lexical_fallback(asked, found, lexical_hits(t))


@query(
    "dedupe_hits",
    f"""WITH {LEXICAL}, {DENSE},
both_lists AS (SELECT query_id, item_id, score, rank AS first FROM lex UNION ALL SELECT query_id, item_id, score, 1000 + rank FROM den),
kept AS (SELECT query_id, item_id, arg_min(score, first) AS score, min(first) AS first FROM both_lists GROUP BY ALL)
SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY first) AS rank FROM kept""",
)
def dedupe_hits(t):
    return fusion.dedupe_hits([lexical_hits(t), dense_hits(t)])


@query(
    "keyword_coverage",
    f"""WITH {LEXICAL},
expected AS (SELECT query_id, list_distinct(list_filter({WORDS}, lambda w: len(w) > 5)) AS keywords FROM questions),
texts AS (SELECT query_id, lower(text) AS text FROM lex JOIN documents ON doc_id = item_id),
found AS (SELECT DISTINCT query_id, word FROM (SELECT query_id, unnest(keywords) AS word FROM expected) JOIN texts USING (query_id)
  WHERE contains(text, word))
SELECT e.query_id, len(keywords) AS expected, count(word) AS found,
  round(coalesce(count(word)::DOUBLE / nullif(len(keywords), 0), 0), 6) AS coverage
FROM expected e LEFT JOIN found USING (query_id) WHERE query_id IN (SELECT query_id FROM lex) GROUP BY e.query_id, keywords""",
)
def keyword_coverage(t):
    words = F.array_distinct(F.filter(tx.tokens(F.lower("text")), lambda w: F.length(w) > 5))
    expected = t.benchmark.select(F.col("item_id").alias("query_id"), words.alias("keywords"))
    few = fits(expected)
    asked = lookup_join(lexical_hits(t), expected, ["query_id"], small_fits=few)
    texts = items_of_hits(items(t).select("item_id", "text"), asked, ["item_id"], few)
    return fusion.keyword_coverage(texts)


# -- corrective pass --------------------------------------------------------------------------

GRADE = """CASE WHEN share >= 0.6 THEN 'RELEVANT' WHEN share <= 0.3 THEN 'IRRELEVANT' ELSE 'AMBIGUOUS' END"""


def graded_sql(name: str, hits: str, asked: str) -> str:
    return f"""
{name}_sets AS (SELECT h.query_id, h.item_id, h.rank, list_distinct({WORDS.replace("text", "q.text")}) AS a,
  list_distinct({WORDS.replace("text", "d.text")}) AS b
  FROM {hits} h JOIN {asked} q USING (query_id) JOIN documents d ON d.doc_id = h.item_id),
{name}_share AS (SELECT query_id, item_id, rank, coalesce(len(list_intersect(a, b))::DOUBLE / nullif(len(a), 0), 0) AS share FROM {name}_sets),
{name} AS (SELECT query_id, item_id, rank, {GRADE} AS grade FROM {name}_share)"""


GRADED = LEXICAL + "," + graded_sql("graded", "lex", "questions")
COUNTS = """
counts AS (SELECT q.query_id, count(grade) AS total, count(*) FILTER (WHERE grade = 'RELEVANT') AS relevant,
  count(*) FILTER (WHERE grade = 'IRRELEVANT') AS irrelevant, count(*) FILTER (WHERE grade = 'AMBIGUOUS') AS ambiguous,
  coalesce(avg((grade = 'RELEVANT')::INT), 0) AS relevance_ratio FROM questions q LEFT JOIN graded USING (query_id) GROUP BY q.query_id)"""
REWRITES = f"""
raw AS (SELECT query_id, text, ' "' || array_to_string(list_sort(list_distinct(list_filter({WORDS}, lambda w: len(w) > 7))), ' ') || '" ' AS response FROM questions),
rewrites AS (SELECT query_id, text AS original, CASE WHEN len(trim(response, ' "')) >= 5 THEN trim(response, ' "') ELSE text END AS rewritten_query FROM raw)"""
SECOND = (
    GRADED
    + ","
    + COUNTS
    + ","
    + REWRITES
    + """,
again AS (SELECT r.query_id, rewritten_query AS text FROM rewrites r JOIN counts c USING (query_id)
  WHERE relevance_ratio < 0.5 AND rewritten_query <> original),"""
    + bm25_sql("again", "lex2")
    + ","
    + graded_sql("graded2", "lex2", "again")
    + """,
both_passes AS (SELECT *, 1 AS pass FROM graded UNION ALL SELECT *, 2 FROM graded2),
kept AS (SELECT query_id, item_id, min(pass)::BIGINT AS pass, arg_min(rank, pass) AS rank, arg_min(grade, pass) AS grade
  FROM both_passes WHERE grade <> 'IRRELEVANT' GROUP BY query_id, item_id)"""
)


def lexical_graded(hits, asked, t):
    paired = co.with_texts(hits, asked, items(t))
    grade = co.lexical_grade(F.col("question"), F.col("passage"))
    return paired.select("query_id", "item_id", "rank", grade.alias("grade"))


def recorded_rewrites(t):
    """A recorded answer of the rewriting model per question: its long words in quotes."""
    long_words = F.array_sort(
        F.array_distinct(F.filter(tx.tokens(F.lower("text")), lambda w: F.length(w) > 7))
    )
    response = F.concat(F.lit(' "'), F.concat_ws(" ", long_words), F.lit('" '))
    return questions(t).select(
        "query_id",
        F.col("text").alias("original"),
        co.clean_rewrite(F.col("text"), response).alias("rewritten_query"),
    )


def corrective_passes(t):
    """Graded hits of both passes and the rewrites; one index serves both."""
    asked, rewrites = questions(t), recorded_rewrites(t)
    every_text = asked.select("query_id", "text").unionByName(
        rewrites.select("query_id", F.col("rewritten_query").alias("text"))
    )
    built = index(t, every_text)
    if not fits(lexical.question_terms(every_text)):
        # many questions are answered from postings: both passes read the same ones
        stored = materialise(built.postings)
        terms = stored.groupBy("term").agg(F.count("*").alias("df"))
        built = lexical.LexicalIndex(stored, terms, built.stats)
    first = materialise(lexical_graded(lexical.bm25_topk(asked, built, 10), asked, t))
    counts = co.grade_counts(first, asked)
    weak = counts.filter(co.needs_rewrite(counts)).select("query_id")
    again = (
        rewrites.filter(F.col("rewritten_query") != F.col("original"))
        .join(weak, "query_id", "left_semi")
        .select("query_id", F.col("rewritten_query").alias("text"))
    )
    second = lexical_graded(lexical.bm25_topk(again, built, 10), again, t)
    return first, second, rewrites


@query(
    "grade_prompts",
    f"""WITH {LEXICAL} SELECT query_id, item_id,
  'Does the document help to answer the question?' || chr(10) || 'Answer with one word: RELEVANT, IRRELEVANT or AMBIGUOUS.'
  || chr(10) || chr(10) || 'Question:' || chr(10) || q.text || chr(10) || chr(10) || 'Document:' || chr(10)
  || CASE WHEN length(d.text) > 2000 THEN substr(d.text, 1, 2000) || '...' ELSE d.text END || chr(10) || chr(10) || 'Verdict:' AS prompt
  FROM lex JOIN questions q USING (query_id) JOIN documents d ON doc_id = item_id""",
)
def grade_prompts(t):
    paired = co.with_texts(lexical_hits(t), questions(t), items(t))
    return co.grade_prompts(paired).select("query_id", "item_id", "prompt")


@query(
    "filter_by_grade",
    f"""WITH {GRADED}, classes AS (SELECT query_id, count(*) FILTER (WHERE grade = 'RELEVANT') AS relevant,
  count(*) FILTER (WHERE grade = 'IRRELEVANT') AS irrelevant, count(*) FILTER (WHERE grade = 'AMBIGUOUS') AS ambiguous
  FROM graded GROUP BY query_id)
SELECT c.query_id, item_id, rank, grade, relevant, irrelevant, ambiguous
  FROM classes c LEFT JOIN graded g ON g.query_id IS NOT DISTINCT FROM c.query_id AND grade <> 'IRRELEVANT'""",
)
def filter_by_grade(t):
    return co.keep_graded(lexical_graded(lexical_hits(t), questions(t), t), counted=True)


@query(
    "relevance_ratio",
    f"""WITH {GRADED}, {COUNTS} SELECT query_id, total, relevant, irrelevant, ambiguous,
  round(relevance_ratio, 6) AS relevance_ratio, relevance_ratio < 0.5 AS rewrite FROM counts""",
)
def relevance_ratio(t):
    counts = co.grade_counts(lexical_graded(lexical_hits(t), questions(t), t), questions(t))
    return counts.withColumn("rewrite", co.needs_rewrite(counts)).withColumn(
        "relevance_ratio", F.round("relevance_ratio", 6)
    )


@query("corrective_merge", f"WITH {SECOND} SELECT query_id, item_id, pass, rank, grade FROM kept")
def corrective_merge(t):
    kept, _ = co.corrective_merge(*corrective_passes(t))
    return kept


RUNS = """
runs AS (SELECT b.query_id, count(*) AS total, count(*) FILTER (WHERE grade = 'RELEVANT') AS relevant,
  count(*) FILTER (WHERE grade = 'IRRELEVANT') AS irrelevant, count(*) FILTER (WHERE grade = 'AMBIGUOUS') AS ambiguous,
  (SELECT count(*) FROM kept k WHERE k.query_id = b.query_id) AS distinct_kept,
  count(*) FILTER (WHERE pass = 2) > 0 AS query_rewritten FROM both_passes b GROUP BY b.query_id)"""


@query("corrective_runs", f"WITH {SECOND}, {RUNS} SELECT r.*, CASE WHEN query_rewritten THEN rewritten_query END AS rewritten_query FROM runs r JOIN rewrites USING (query_id)")
def corrective_runs(t):
    _, runs = co.corrective_merge(*corrective_passes(t))
    return runs


@query(
    "corrective_summary",
    f"""WITH {SECOND}, {RUNS} SELECT count(*) AS n_queries, sum(total)::BIGINT AS docs_graded, sum(relevant)::BIGINT AS relevant,
  sum(irrelevant)::BIGINT AS irrelevant, sum(ambiguous)::BIGINT AS ambiguous, round(sum(irrelevant) / sum(total), 6) AS filtered_share,
  round(avg(relevant / total), 6) AS mean_ratio, count(*) FILTER (WHERE query_rewritten) AS rewrites,
  round(avg(query_rewritten::INT), 6) AS rewrite_rate FROM runs""",
)
def corrective_summary(t):
    _, runs = co.corrective_merge(*corrective_passes(t))
    return co.corrective_summary(
        runs.withColumn("relevance_ratio", tx.ratio(F.col("relevant"), F.col("total")))
    )


# -- ablation ---------------------------------------------------------------------------------

JUDGE = """
judged AS (SELECT config, h.query_id, item_id, rank, contains(d.text, q.text) AS relevant,
  CASE WHEN match = 'en' THEN 'english' ELSE 'other' END AS partition
  FROM runs h JOIN questions q ON q.query_id = h.query_id JOIN documents d ON d.doc_id = item_id)"""
ABLATION = (
    FILTERED
    + ","
    + fuse_sql("c3", "den", "lex", 0.5)
    + ","
    + fuse_sql("c4", "denf", "lexf", 0.5)
    + ","
    + rerank_sql("c5", "c3", 10)
    + ","
    + fuse_sql("c6f", "denf", "lexf", 0.6)
    + ","
    + rerank_sql("c6", "c6f", 10)
    + ","
    + graded_sql("c6g", "c6", "questions")
    + """,
c6k AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM c6g WHERE grade <> 'IRRELEVANT'),
runs AS (SELECT 'C1' AS config, query_id, item_id, rank FROM lex UNION ALL SELECT 'C2', query_id, item_id, rank FROM den
  UNION ALL SELECT 'C3', query_id, item_id, rank FROM c3 UNION ALL SELECT 'C4', query_id, item_id, rank FROM c4
  UNION ALL SELECT 'C5', query_id, item_id, rank FROM c5 UNION ALL SELECT 'C6', query_id, item_id, rank FROM c6
  UNION ALL SELECT 'C7', query_id, item_id, rank FROM den UNION ALL SELECT 'C6_crag', query_id, item_id, rank FROM c6k),"""
    + JUDGE
    + """,
ks AS (SELECT unnest([3, 10])::BIGINT AS k),
asked AS (SELECT unnest(['C1', 'C2', 'C3', 'C4', 'C5', 'C6', 'C7', 'C6_crag']) AS config, query_id,
  CASE WHEN match = 'en' THEN 'english' ELSE 'other' END AS partition FROM questions),
sums AS (SELECT a.config, a.query_id, a.partition, k, count(*) FILTER (WHERE rank <= k) AS returned,
  count(*) FILTER (WHERE rank <= k AND relevant) AS n_rel, min(rank) FILTER (WHERE rank <= k AND relevant) AS first,
  coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rank <= k AND relevant), 0) AS dcg
  FROM asked a CROSS JOIN ks LEFT JOIN judged j ON j.config = a.config AND j.query_id = a.query_id GROUP BY ALL),
metrics AS (SELECT config, query_id, partition, k, CASE WHEN n_rel > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit,
  coalesce(1.0::DOUBLE / first, 0.0) AS rr, coalesce(n_rel::DOUBLE / nullif(returned, 0), 0.0) AS "precision",
  coalesce(dcg / nullif(list_sum(list_transform(range(1, n_rel + 1), lambda i: 1 / log2(i + 1))), 0), 0.0) AS ndcg FROM sums)"""
)
MEANS = """count(*) AS n_queries, round(avg(hit), 6) AS hit, round(avg(rr), 6) AS rr,
  round(avg("precision"), 6) AS "precision", round(avg(ndcg), 6) AS ndcg"""


def ablation_runs(t, configs=ABLATION_CONFIGS, k=10):
    """Ranked hits per configuration. A base list is computed once, when a configuration asks for it first."""
    asked = questions(t)

    @cache
    def corpus():
        # texts are embedded once for the plain and the filtered search
        return materialise(with_vectors(items(t)).select("item_id", "match", "vector"))

    @cache
    def dense_list(filtered):
        return materialise(dense_hits(t, k, matched=filtered, corpus=corpus()))

    @cache
    def lexical_list(filtered):
        if filtered:
            return lexical.keep_matching(lexical_list(False), items(t), asked, k)
        return materialise(lexical_hits(t, k))

    fused, reranked = {}, {}
    out = None
    for name, use_bm25, use_vector, use_rrf, use_filter, use_rerank, use_grading, alpha in configs:
        if use_rrf:
            if (use_filter, alpha) not in fused:
                weighted = [(dense_list(use_filter), alpha), (lexical_list(use_filter), 1 - alpha)]
                fused[use_filter, alpha] = fusion.rrf_fuse(weighted, k)
            run = fused[use_filter, alpha]
        else:
            run = dense_list(use_filter) if use_vector else lexical_list(use_filter)
        if use_rerank:
            # scoring pairs reads the texts: once per fused list, whoever uses it
            if (use_filter, alpha) not in reranked:
                reranked[use_filter, alpha] = materialise(fusion.rerank_topn(run, asked, items(t), k))
            run = reranked[use_filter, alpha]
        if use_grading:
            kept = co.keep_graded(lexical_graded(run, asked, t)).withColumn("score", -F.col("rank"))
            run = fusion.dedupe_hits([kept])
        run = run.select(F.lit(name).alias("config"), "query_id", "item_id", "rank")
        out = run if out is None else out.unionByName(run)
    return out


def ablation_judged(t, configs=ABLATION_CONFIGS):
    paired = co.with_texts(ablation_runs(t, configs), questions(t), items(t))
    judged = paired.select(
        "config",
        "query_id",
        "item_id",
        "rank",
        F.contains("passage", "question").alias("relevant"),
    )
    return lookup_join(judged, partitions(t), ["query_id"])


def partitions(t):
    part = F.when(F.col("match") == "en", "english").otherwise("other")
    return questions(t).select("query_id", part.alias("partition"))


def ablation_metrics(t, configs=ABLATION_CONFIGS):
    """Every question counts in every configuration, with or without hits."""
    names = F.explode(F.array(*[F.lit(c[0]) for c in configs]))
    asked = partitions(t).withColumn("config", names)
    keys = ["config", "query_id", "partition"]
    return rm.per_query(ablation_judged(t, configs), (3, 10), keys, asked=asked)


def some_configs(*names):
    return [c for c in ABLATION_CONFIGS if c[0] in names]


@query(
    "ablation_matrix",
    f"""WITH {ABLATION} SELECT config, k, CASE WHEN grouping(partition) = 1 THEN 'overall' ELSE partition END AS partition, {MEANS}
  FROM metrics GROUP BY GROUPING SETS ((config, k, partition), (config, k))""",
)
def ablation_matrix(t):
    parts = ablation_metrics(t)
    whole = parts.withColumn("partition", F.lit("overall"))
    return rm.means(parts.unionByName(whole), ["config", "k", "partition"])


@query(
    "config_compare",
    f"""WITH {ABLATION} SELECT config, round(avg(ndcg) FILTER (WHERE partition = 'english'), 6) AS ndcg_english,
  round(avg(ndcg) FILTER (WHERE partition = 'other'), 6) AS ndcg_other, round(avg(ndcg), 6) AS ndcg_overall
  FROM metrics WHERE k = 10 GROUP BY config""",
)
def config_compare(t):
    at = ablation_metrics(t).filter(F.col("k") == 10)
    part = lambda p: F.round(F.avg(F.when(F.col("partition") == p, F.col("ndcg"))), 6)
    return at.groupBy("config").agg(
        part("english").alias("ndcg_english"),
        part("other").alias("ndcg_other"),
        F.round(F.avg("ndcg"), 6).alias("ndcg_overall"),
    )


def delta_sql(base: str, full: str) -> str:
    return f"""WITH {ABLATION}, agg AS (SELECT config, k, {MEANS} FROM metrics GROUP BY config, k),
long AS (UNPIVOT (SELECT config, k, hit, rr, "precision", ndcg FROM agg) ON hit, rr, "precision", ndcg INTO NAME metric VALUE value)
SELECT b.k, b.metric, b.value AS base, f.value AS "full", round(f.value - b.value, 6) AS delta,
  round(coalesce(100 * (f.value - b.value) / nullif(b.value, 0), 0), 4) AS change_pct
FROM long b JOIN long f ON b.k = f.k AND b.metric = f.metric AND b.config = '{base}' AND f.config = '{full}'"""


def delta(t, base, full):
    metrics = ablation_metrics(t, some_configs(base, full))
    long = rm.long_form(rm.means(metrics, ["config", "k"]), ["config", "k"])
    side = lambda c: long.filter(F.col("config") == c).drop("config")
    return rm.metric_delta(side(base), side(full), ["k", "metric"])


@query("metric_delta", delta_sql("C3", "C5"))
def metric_delta(t):
    return delta(t, "C3", "C5")


@query("corrective_impact", delta_sql("C6", "C6_crag"))
def corrective_impact(t):
    return delta(t, "C6", "C6_crag")


@query(
    "recovered_lost",
    f"""WITH {ABLATION}, missed AS (SELECT config, query_id FROM metrics WHERE k = 3 AND hit = 0)
SELECT query_id, 'recovered' AS change FROM missed WHERE config = 'C2' AND query_id NOT IN (SELECT query_id FROM missed WHERE config = 'C1')
UNION ALL SELECT query_id, 'lost' FROM missed WHERE config = 'C1' AND query_id NOT IN (SELECT query_id FROM missed WHERE config = 'C2')""",
)
def recovered_lost(t):
    missed = ablation_metrics(t, some_configs("C1", "C2")).filter(
        (F.col("k") == 3) & (F.col("hit") == 0)
    )
    return rm.recovered_lost(missed.filter("config = 'C2'"), missed.filter("config = 'C1'"))


SHIFT = f"""WITH {ABLATION},
w AS (SELECT query_id, min(rank) FILTER (WHERE relevant) AS r FROM judged WHERE config = 'C2' GROUP BY query_id),
p AS (SELECT query_id, min(rank) FILTER (WHERE relevant) AS r FROM judged WHERE config = 'C4' GROUP BY query_id),
shifts AS (SELECT query_id, w.r AS rank_without, p.r AS rank_with, w.r - p.r AS shift,
  CASE WHEN w.r IS NULL AND p.r IS NULL THEN 'both_miss' WHEN w.r IS NULL THEN 'recovered' WHEN p.r IS NULL THEN 'lost'
    WHEN w.r > p.r THEN 'improved' WHEN w.r = p.r THEN 'same' ELSE 'worse' END AS outcome
  FROM w FULL JOIN p USING (query_id))"""


def shifts(t):
    judged = ablation_judged(t, some_configs("C2", "C4"))
    return rm.rank_shift(judged.filter("config = 'C2'"), judged.filter("config = 'C4'"))


@query("rank_shift", f"{SHIFT} SELECT * FROM shifts")
def rank_shift(t):
    return shifts(t)


@query(
    "rank_shift_summary",
    f"""{SHIFT} SELECT outcome, count(*) AS n, round(avg(shift), 6) AS mean_shift, max(shift) AS max_shift
  FROM shifts GROUP BY outcome""",
)
def rank_shift_summary(t):
    return rm.rank_shift_summary(shifts(t))
