"""Dense retrieval over ``embeddings``: label prototypes ask, every vector is searched.

A question is the mean vector of a label (one per label, whole table); a hit is relevant if its
file name ``L<label>_<id>`` matches the pattern ``^l<label>_``. Partition = parity of the label.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quaero.operators import cells, dense, fusion
from quaero.operators import retrieval_metrics as rm
from quaero.operators.sizing import fits, items_of_hits, materialise, one_row, shared_folder
from quaero.plans.registry import query

KS = (3, 5, 10)

# -- shared SQL -------------------------------------------------------------------------------

VECTORS = """
vecs AS (SELECT vec_id AS item_id, label, embedding::DOUBLE[] AS vector FROM embeddings),
parts AS (SELECT label, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM vecs),
means AS (SELECT label, i, avg(x) AS x FROM parts GROUP BY label, i),
protos AS (SELECT label::BIGINT AS query_id, label, list(x ORDER BY i) AS vector FROM means GROUP BY label),
questions AS (SELECT query_id, label,
  list_transform(vector, lambda x: x / sqrt(list_inner_product(vector, vector))) AS vector FROM protos)
"""
SCORED = (
    VECTORS
    + """,
scored AS (SELECT query_id, item_id, q.label AS q_label, v.label AS label,
  round(list_inner_product(q.vector, v.vector), 6) AS score FROM questions q, vecs v),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM scored)
"""
)
HITS = SCORED + ", hits AS (SELECT * FROM ranked WHERE rank <= 10)"
JUDGED = (
    HITS
    + """,
judged AS (SELECT query_id, item_id, score, rank, 'L' || label || '_' || item_id AS file_name,
  label = q_label AS relevant, CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS partition FROM hits),
ks AS (SELECT unnest([3, 5, 10])::BIGINT AS k)
"""
)
PER_QUERY = (
    JUDGED
    + """,
sums AS (SELECT query_id, partition, k,
  count(*) FILTER (WHERE rank <= k) AS returned,
  count(*) FILTER (WHERE rank <= k AND relevant) AS n_rel,
  min(rank) FILTER (WHERE rank <= k AND relevant) AS first,
  coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rank <= k AND relevant), 0) AS dcg
  FROM judged, ks GROUP BY query_id, partition, k),
metrics AS (SELECT query_id, partition, k,
  CASE WHEN n_rel > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit,
  coalesce(1.0::DOUBLE / first, 0.0) AS rr,
  coalesce(n_rel::DOUBLE / nullif(returned, 0), 0.0) AS "precision",
  coalesce(dcg / nullif(list_sum(list_transform(range(1, n_rel + 1), lambda i: 1 / log2(i + 1))), 0), 0.0) AS ndcg
  FROM sums)
"""
)


# -- frames -----------------------------------------------------------------------------------


def vectors(t):
    return t.embeddings.select(
        F.col("vec_id").alias("item_id"),
        "label",
        F.col("embedding").cast("array<double>").alias("vector"),
    )


def prototypes(t):
    """One unit question vector per label, by partial sums per dimension."""
    dims = vectors(t).select("label", F.posexplode("vector").alias("i", "x"))
    means = dims.groupBy("label", "i").agg(F.avg("x").alias("x"))
    vector = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"])
    protos = means.groupBy("label").agg(vector.alias("vector"))
    return protos.select(
        F.col("label").cast("bigint").alias("query_id"), "label", dense.unit(F.col("vector")).alias("vector")
    )


def hits(t, k=10):
    return dense.vector_topk(prototypes(t), vectors(t), k)


def judged(t, k=10):
    """Hits with file name, relevance and partition."""
    names = t.embeddings.select(
        F.col("vec_id").alias("item_id"),
        F.concat(F.lit("L"), "label", F.lit("_"), "vec_id").alias("file_name"),
    )
    # one question per label
    few = fits(t.embeddings.select("label").distinct())
    named = items_of_hits(names, hits(t, k), ["item_id"], few)
    marked = rm.judge(
        named, F.col("file_name"), F.concat(F.lit("^l"), F.col("query_id"), F.lit("_"))
    )
    even = F.pmod("query_id", F.lit(2)) == 0
    return marked.withColumn("partition", F.when(even, "even").otherwise("odd"))


def asked(t):
    """Every question with its partition."""
    even = F.pmod("query_id", F.lit(2)) == 0
    ids = t.embeddings.select(F.col("label").cast("bigint").alias("query_id")).distinct()
    return ids.withColumn("partition", F.when(even, "even").otherwise("odd"))


def per_query(t, ks=KS):
    return rm.per_query(judged(t, max(ks)), ks, ["query_id", "partition"], asked=asked(t))


# -- queries ----------------------------------------------------------------------------------


@query("vector_topk", f"WITH {HITS} SELECT query_id, item_id, score, rank FROM hits")
def vector_topk(t):
    return hits(t)


@query(
    "vector_topk_l2",
    f"""WITH {VECTORS},
scored AS (SELECT query_id, item_id, round(list_inner_product(q.vector, q.vector)
  + list_inner_product(v.vector, v.vector) - 2 * list_inner_product(q.vector, v.vector), 6) AS score
  FROM questions q, vecs v),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, item_id) AS rank FROM scored)
SELECT query_id, item_id, score, rank FROM ranked WHERE rank <= 10""",
)
def vector_topk_l2(t):
    return dense.vector_topk(prototypes(t), vectors(t), 10, metric="l2")


@query(
    "vector_topk_filtered",
    f"""WITH {SCORED},
inside AS (SELECT query_id, item_id, score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM scored WHERE label = q_label)
SELECT * FROM inside WHERE rank <= 10""",
)
def vector_topk_filtered(t):
    asked = prototypes(t).withColumn("match", F.col("label"))
    return dense.vector_topk(asked, vectors(t).withColumn("match", F.col("label")), 10, matched=True)


@query(
    "match_file_items",
    f"""WITH {SCORED},
inside AS (SELECT query_id, item_id, score AS similarity,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank
  FROM scored WHERE label IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))
SELECT * FROM inside WHERE rank <= 5""",
)
def match_file_items(t):
    chunks = vectors(t).withColumn("file_id", F.col("label"))
    files = t.nation.filter(F.col("n_regionkey") == 1).select(F.col("n_nationkey").alias("file_id"))
    return dense.match_file_items(prototypes(t), chunks, files.unionAll(files), 5)


@query(
    "match_file_items_all",
    f"""WITH {SCORED} SELECT query_id, item_id, score AS similarity
FROM scored WHERE label IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""",
)
def match_file_items_all(t):
    chunks = vectors(t).withColumn("file_id", F.col("label"))
    files = t.nation.filter(F.col("n_regionkey") == 1).select(F.col("n_nationkey").alias("file_id"))
    return dense.match_file_items(prototypes(t), chunks, files)


@query("vector_topk_ann")
def vector_topk_ann(t):
    corpus = vectors(t)
    asked = materialise(prototypes(t))
    model = dense.train_cells(corpus, cells=16)
    found = dense.ann_topk(model, asked, dense.assign_cells(model, corpus), 10, probes=8)
    return dense.recall_against(dense.vector_topk(asked, corpus, 10), found)


def every_hundredth(t):
    """Questions of the stored search: all vectors whose id is divisible by 100."""
    asked = vectors(t).where(F.pmod("item_id", F.lit(100)) == 0)
    return asked.select(F.col("item_id").alias("query_id"), "vector")


def stored_hits(t):
    """Every vector is written to its cell with its code; a question reads 40 of 64 cells."""
    path = f"{shared_folder(t.spark)}/cells-{uuid.uuid4().hex}"
    corpus = vectors(t).select("item_id", "vector")
    index = cells.CellIndex(t.spark, path, cells.train(corpus, cells=64, parts=16))
    cells.write_cells(corpus, path, index.quantizer)
    return cells.search(index, every_hundredth(t), 10, probes=40, shortlist=20)


@query("vector_topk_stored")
def vector_topk_stored(t):
    """Hits of the stored approximate search."""
    return stored_hits(t)


@query(
    "vector_topk_stored_recall",
    """SELECT count(*) AS n_questions, 10 * count(*) AS n_hits, count(*) AS found_themselves, true AS recall_reached
FROM embeddings WHERE vec_id % 100 = 0""",
)
def vector_topk_stored_recall(t):
    """What the stored search finds of the exact hits: 0.9 or more; every question finds itself first."""
    found = materialise(stored_hits(t))
    asked = every_hundredth(t)
    recall = dense.recall_against(dense.vector_topk(asked, vectors(t), 10), found)
    shares = recall.agg(F.count("*").alias("n_questions"), (F.avg("recall") >= 0.9).alias("recall_reached"))
    hits = found.agg(
        F.count("*").alias("n_hits"),
        F.count_if((F.col("rank") == 1) & (F.col("query_id") == F.col("item_id"))).alias("found_themselves"),
    )
    both = one_row(shares)
    return hits.select(both["n_questions"].alias("n_questions"), "n_hits", "found_themselves", both["recall_reached"].alias("recall_reached"))


def _metric(name):
    return f"""WITH {PER_QUERY} SELECT query_id, k, round("{name}", 6) AS "{name}" FROM metrics"""


def _one_metric(t, name):
    return per_query(t).select("query_id", "k", F.round(name, 6).alias(name))


@query("hit_rate_at_k", _metric("hit"))
def hit_rate_at_k(t):
    return _one_metric(t, "hit")


@query("mrr_at_k", _metric("rr"))
def mrr_at_k(t):
    return _one_metric(t, "rr")


@query("precision_at_k", _metric("precision"))
def precision_at_k(t):
    return _one_metric(t, "precision")


@query("ndcg_at_k", _metric("ndcg"))
def ndcg_at_k(t):
    return _one_metric(t, "ndcg")


@query(
    "ndcg_at_k_corpus_ideal",
    f"""WITH {PER_QUERY}, sizes AS (SELECT label::BIGINT AS query_id, count(*) AS n FROM embeddings GROUP BY label)
SELECT s.query_id, s.k, round(dcg / list_sum(list_transform(range(1, least(s.k, n) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg
FROM sums s JOIN sizes USING (query_id)""",
)
def ndcg_at_k_corpus_ideal(t):
    sizes = t.embeddings.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        F.count("*").alias("in_corpus")
    )
    marked = judged(t).join(sizes, "query_id")
    metrics = rm.per_query(marked, KS, ["query_id"], corpus_relevant="in_corpus")
    return metrics.select("query_id", "k", F.round("ndcg", 6).alias("ndcg"))


@query(
    "eval_per_query",
    f"""WITH {PER_QUERY} SELECT query_id, partition, k, round(hit, 6) AS hit, round(rr, 6) AS rr,
  round("precision", 6) AS "precision", round(ndcg, 6) AS ndcg FROM metrics""",
)
def eval_per_query(t):
    return per_query(t).select(
        "query_id", "partition", "k", *[F.round(m, 6).alias(m) for m in rm.METRICS]
    )


@query(
    "eval_aggregate",
    f"""WITH {PER_QUERY} SELECT k, CASE WHEN grouping(partition) = 1 THEN 'overall' ELSE partition END AS partition,
  count(*) AS n_queries, round(avg(hit), 6) AS hit, round(avg(rr), 6) AS rr,
  round(avg("precision"), 6) AS "precision", round(avg(ndcg), 6) AS ndcg
  FROM metrics GROUP BY GROUPING SETS ((k, partition), (k))""",
)
def eval_aggregate(t):
    return rm.by_partition(per_query(t))


@query(
    "retrieval_failures",
    f"""WITH {JUDGED} SELECT query_id,
  string_agg(file_name, ', ' ORDER BY rank) FILTER (WHERE rank <= 3) AS top_3
  FROM judged GROUP BY query_id HAVING count(*) FILTER (WHERE relevant AND rank <= 1) = 0""",
)
def retrieval_failures(t):
    return rm.failures(judged(t), 1, "file_name", asked=asked(t))


@query(
    "apply_metadata_boost",
    f"""WITH {HITS}, boosted AS (SELECT query_id, item_id, rank AS before,
  round(CASE WHEN label = q_label THEN score * 1.5 ELSE score END, 9) AS score FROM hits)
SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM boosted""",
)
def apply_metadata_boost(t):
    wanted = prototypes(t).select("query_id", F.col("label").alias("boost_value"))
    items = vectors(t).select("item_id", F.col("label").alias("field"))
    return fusion.apply_metadata_boost(hits(t), items, wanted)
