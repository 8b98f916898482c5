"""Quality classifier: trees against plain versions, held-out accuracy, edge results."""

import duckdb
import numpy as np
import pytest

from tallyspark.llm import quality, queries


def plain_margin(model, row):
    """One row through one tree after the other, node by node."""
    total, inner = model.base, model.feature.shape[1]
    for f, limit, value in zip(model.feature, model.limit, model.value):
        node = 0
        while node < inner:
            node = 2 * node + (2 if row[f[node]] > limit[node] else 1)
        total += value[node - inner]
    return total


def data(n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5)).round(2)
    x[:, 3] = rng.integers(0, 3, n)
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] == 1) | (x[:, 1] > 1.5)).astype(float)
    return x, y


def test_flat_traversal_is_the_plain_one():
    x, y = data()
    model = quality.fit_trees(x, y, trees=12, depth=3)
    assert np.allclose(model.margin(x), [plain_margin(model, r) for r in x])
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.97


def test_splits_are_those_of_trying_all():
    x, y = data(150)
    edges = [quality.bin_edges(c, 16) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    grad, hess = 0.4 - y, np.full(len(y), 0.24)
    node = (x[:, 2] > 0).astype(int)
    gain, feature, at = quality.best_splits(binned, node, 2, grad, hess, 16)
    side = lambda m: grad[m].sum() ** 2 / (hess[m].sum() + quality.SHRINK)
    for k in range(2):
        here, tried = node == k, []
        for f in range(5):
            for i, e in enumerate(edges[f]):
                left, right = here & (x[:, f] <= e), here & (x[:, f] > e)
                if min(hess[left].sum(), hess[right].sum()) >= quality.LEAST:
                    tried.append((side(left) + side(right) - side(here), f, i))
        best = max(t[0] for t in tried)
        assert gain[k] == pytest.approx(best)
        assert (feature[k], at[k]) in [(f, i) for g, f, i in tried if g == pytest.approx(best)]


def test_edges_split_every_distinct_value_or_quantiles():
    assert quality.bin_edges(np.array([1.0, 1, 2, 5]), 4).tolist() == [1.5, 3.5]
    assert len(quality.bin_edges(np.arange(1000.0), 64)) == 63
    assert quality.bin_edges(np.zeros(10), 4).tolist() == []
    skewed = np.array([0.0] * 990 + list(range(1, 11)))
    assert quality.bin_edges(skewed, 4).tolist() == [0.5]


def test_held_out_rows_are_told_apart(spark, data_dir):
    out = {r["doc_id"]: r for r in queries.op13_quality_classifier(spark, data_dir).collect()}
    labels = dict(duckdb.sql(f"select doc_id, quality from '{data_dir}/labels.parquet'").fetchall())
    n = duckdb.sql(f"select doc_id from '{data_dir}/documents.parquet'").fetchall()
    assert set(out) == {x[0] for x in n}
    held = [(out[d]["predicted"], out[d]["score"], q) for d, q in labels.items() if out[d]["held_out"]]
    assert len(held) > 50 and sum(p == q for p, _, q in held) >= 0.97 * len(held)
    good, bad = [s for _, s, q in held if q], [s for _, s, q in held if not q]
    assert np.mean([g > b for g in good for b in bad]) >= 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out.values())


def test_rows_held_out_do_not_change_the_model(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{data_dir}/labels.parquet")
    turned = labels.selectExpr("doc_id", "IF(crc32(CAST(doc_id AS string)) % 5 = 0, 1 - quality, quality) AS quality")
    a, b = quality.train(docs, labels, trees=5), quality.train(docs, turned, trees=5)
    assert (a.feature == b.feature).all() and (a.limit == b.limit).all() and (a.value == b.value).all()


def test_sample_is_bounded_and_the_same_at_any_layout(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{data_dir}/labels.parquet")
    a, b = (quality.train(d, x, trees=5, sample_rows=100) for d, x in ((docs, labels), (docs.repartition(7), labels.repartition(5))))
    assert (a.value == b.value).all() and a.base == b.base


def test_edges_of_tables(spark):
    rows = [(1, None, 9), (2, "", 9), (3, " \n\t ", 9), (4, "!!", 9), (5, "word " * 200_000, 9), (5, "again", 9), (None, "no key", 9), (7, "Été ça", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, statistics int").selectExpr("*", "1 AS score", "2 AS x", "'q' AS quality")
    labels = spark.createDataFrame([(1, 1), (2, None), (4, 0), (5, 0), (5, 1), (None, 1), (99, 1), (7, 3)], "doc_id long, quality int")
    model = quality.train(docs, labels, F_true(), trees=3)
    got = quality.score_quality(docs, model)
    assert got.columns == ["doc_id", "text", "x", "quality", "statistics", "score"]
    out = got.collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and len(r["statistics"]) == len(quality.NAMES) for r in out)
    by = {r["doc_id"]: r["score"] for r in out}
    assert by[1] == by[2]
    none = quality.train(docs, labels.limit(0))
    assert all(r["score"] == 0.5 for r in quality.score_quality(docs, none).collect())
    assert quality.score_quality(docs.limit(0), model).count() == 0
    assert quality.train(docs.limit(0), labels).base == 0


def F_true():
    from pyspark.sql import functions as F

    return F.lit(True)


def test_statistics_of_known_texts():
    got = dict(zip(quality.NAMES, quality.statistics("AB AB cd|\nx y!\n")))
    assert got["distinct_words"] == 4 / 5 and got["repeated_neighbours"] == 1 / 5 and got["upper_words"] == 2 / 5
    assert got["symbol_ended_words"] == 2 / 5 and got["distinct_lines"] == 1 and got["upper_share"] == 4 / 15
    assert quality.statistics("") == quality.statistics(None) == [0.0] * len(quality.NAMES)
