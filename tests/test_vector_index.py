"""The inverted-file index against exact retrieval."""

import numpy as np
import pandas as pd
import pytest

from sparkinsight.operators import retrieval as RT
from sparkinsight.operators import vector_index as X
from sparkinsight.session import scratch_path


@pytest.fixture(scope="module")
def clustered(spark):
    """Ten clusters, one of them a third of the rows, and rows that cannot be compared."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(10, 16))
    rows = [(i, [float(x) for x in centres[0 if i % 3 == 0 else i % 10] + 0.4 * rng.normal(size=16)], f"t{i % 4}") for i in range(1500)]
    rows += [(2000, None, "x"), (2001, [0.0] * 16, "x"), (2002, [float("nan")] * 16, "x"), (2003, [1.0, 2.0], "x"), (2004, [], "x"),
             (2005, rows[7][1], "copy")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, kind string")


@pytest.fixture(scope="module")
def index(spark, clustered):
    return X.build_index(clustered, scratch_path(spark, "ivf"), keep=["kind"], cells=20)


def test_index_holds_every_row(spark, clustered, index):
    stored = index.rows(spark)
    assert stored.count() == clustered.count()
    assert {r["vec_id"] for r in stored.where(f"cell = {X.NO_CELL}").collect()} == {2000, 2001, 2002, 2003, 2004}
    assert stored.select("cell").distinct().count() > 10


def test_all_cells_give_the_exact_answer(spark, clustered, index):
    asked = clustered.where("vec_id % 20 = 0 AND vec_id < 2000").selectExpr("vec_id AS query_id", "embedding")
    good = clustered.where("vec_id < 2000 OR vec_id = 2005")
    exact = [tuple(r) for r in RT.retrieve_dense(asked, good).collect()]
    loaded = X.load_index(spark, index.path)
    assert (loaded.probes, loaded.recall) == (index.probes, index.recall)
    full = X.search_index(loaded, asked, probes=20)
    assert sorted(tuple(r) for r in full.collect()) == sorted(exact)
    few = X.search_index(loaded, asked)
    told = X.recall_report(few, RT.retrieve_dense(asked, good), "query_id", "vec_id").first()
    assert told["queries"] == 75 and told["recall"] >= 0.9 and index.probes < 10
    read = X.search_index(loaded, asked, probes=1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in read or "cell#" in read


def test_odd_queries_and_empty_store(spark, clustered, index):
    odd = clustered.where("vec_id >= 2000 AND vec_id <> 2005").selectExpr("vec_id AS query_id", "embedding")
    assert X.search_index(index, odd).count() == 0
    empty = X.build_index(clustered.limit(0), scratch_path(spark, "ivf"))
    assert X.search_index(empty, clustered.selectExpr("vec_id AS query_id", "embedding")).count() == 0


def test_topk_keeps_the_best_over_blocks():
    rng = np.random.default_rng(9)
    scores, ids = np.round(rng.normal(size=(4, 300)), 1), rng.permutation(300)
    best = RT.TopK(4, 7)
    for s in range(0, 300, 40):
        best.add(np.arange(4), scores[:, s:s + 40], ids[s:s + 40])
    f = best.frame(list("abcd"), "id")
    for q, name in enumerate("abcd"):
        want = sorted(zip(-scores[q], ids))[:7]
        assert f[f["query_id"] == name]["id"].tolist() == [int(i) for _, i in want]


def test_scores_of_a_large_query_block_stay_small():
    """A full block of queries against many rows: the scores held at once are bounded by cells, not by rows."""
    import tracemalloc
    rng = np.random.default_rng(1)
    queries, rows = rng.normal(size=(RT.MAX_QUERY_BLOCK, 8)), rng.normal(size=(2048, 8))
    run = RT._topk_scorer([*range(len(queries))], queries, 5, "id", "v")
    tracemalloc.start()
    got = pd.concat(run(iter([pd.DataFrame({"id": np.arange(2048), "v": [*rows]})])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    best = np.argsort(-(RT.unit_rows(queries[:50]) @ RT.unit_rows(rows).T), axis=1)[:, :5]
    assert all(set(got[got.query_id == i].id) == set(best[i]) for i in range(50))
