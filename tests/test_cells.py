"""Stored cells with residual codes: exact scores, high recall, and cells that are not read."""

import re

import numpy as np
import pytest

from quaero.operators import cells, dense


def frame(spark, rows, first=0, name="item_id"):
    return spark.createDataFrame([(first + i, [float(x) for x in r]) for i, r in enumerate(rows)], f"{name} long, vector array<double>")


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(1)
    centres = unit(rng.normal(size=(20, 32)))
    return unit(centres[rng.integers(0, 20, 1500)] + 0.12 * rng.normal(size=(1500, 32)))


@pytest.fixture(scope="module")
def index(spark, clustered, tmp_path_factory):
    corpus = frame(spark, clustered).repartition(3)
    quantizer = cells.train(corpus, cells=20, parts=8)
    path = str(tmp_path_factory.mktemp("cells") / "rows")
    cells.write_cells(corpus, path, quantizer)
    return cells.CellIndex(spark, path, quantizer)


def test_recall_with_few_cells(spark, clustered, index):
    asked = frame(spark, clustered[::30], name="query_id")
    found = cells.search(index, asked, 10, probes=4)
    exact = dense.vector_topk(asked, frame(spark, clustered), 10)
    shares = [r["recall"] for r in dense.recall_against(exact, found).collect()]
    assert len(shares) == 50 and np.mean(shares) >= 0.9
    scores = {(r["query_id"], r["item_id"]): r["score"] for r in exact.collect()}
    got = found.collect()
    assert len(got) == 500
    assert all(abs(scores[k] - r["score"]) < 1e-6 for r in got if (k := (r["query_id"], r["item_id"])) in scores)


def test_all_cells_and_a_long_list_are_exact(spark, clustered, index):
    asked = frame(spark, clustered[:5], name="query_id")
    found = cells.search(index, asked, 7, probes=20, shortlist=300)
    assert sorted(found.collect()) == sorted(dense.vector_topk(asked, frame(spark, clustered), 7).select(found.columns).collect())


def test_other_cells_are_not_read(spark, clustered, index):
    asked = frame(spark, clustered[:1], name="query_id")
    wanted = sorted(int(c) for c in index.quantizer.probed(clustered[:1], 3)[0])
    plan = index.cells(wanted)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[cell#\d+ IN \(%s\)\]" % ",".join(map(str, wanted)), plan)
    assert cells.search(index, asked, 5, probes=3).count() == 5


def test_every_vector_is_in_the_index_and_nulls_are_not(spark, clustered, tmp_path):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(clustered[:40])] + [(90, None), (91, [0.0] * 32)]
    corpus = spark.createDataFrame(rows, "item_id long, vector array<double>")
    quantizer = cells.train(corpus, cells=100, parts=4)
    assert len(quantizer.centres) == 41
    cells.write_cells(corpus, str(tmp_path / "few"), quantizer)
    index = cells.CellIndex(spark, str(tmp_path / "few"), quantizer)
    assert index.cells(list(range(41))).count() == 41
    asked = spark.createDataFrame([(1, None), (2, rows[3][1])], "query_id long, vector array<double>")
    got = cells.search(index, asked, 3, probes=41).collect()
    assert [(r["query_id"], r["item_id"]) for r in got if r["rank"] == 1] == [(2, 3)] and len(got) == 3
    with pytest.raises(ValueError):
        cells.train(corpus.limit(0))


def test_codes_tell_inner_products_about_right(clustered):
    quantizer = cells.Quantizer(clustered[:20].copy(), [cells._centres(p, 64, 3) for p in np.array_split(clustered[:800] - clustered[cells._nearest(clustered[:800], clustered[:20])], 8, axis=1)])
    own, codes = quantizer.encode(clustered[:200])
    q = clustered[300:310]
    tables = quantizer.tables(q)
    about = (q @ quantizer.centres.T)[:, own] + np.stack([t[np.arange(8), codes].sum(1) for t in tables])
    assert np.corrcoef(about.ravel(), (q @ clustered[:200].T).ravel())[0, 1] > 0.97
