"""The quality classifier: held-out accuracy, trees in arrays against nodes, and odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphspark.llm import quality_classifier as qc

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = qc.classify(docs, labels)
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 40 and {r.quality for r in rows} == {0, 1}
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.95
    assert np.mean([g > b for g in good for b in bad]) >= 0.98
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    again = {(r.doc_id, r.score) for r in qc.classify(docs.repartition(3), labels.repartition(2)).collect()}
    assert again == {(r.doc_id, r.score) for r in out.collect()}


def test_held_out_labels_are_not_learnt(spark, docs):
    """Labels of held-out ids change nothing, whatever they say."""
    ids = [r.doc_id for r in docs.select("doc_id").distinct().collect() if r.doc_id is not None]
    rows = [(i, int(i % 3 > 0)) for i in ids]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    one, other = ([(i, 1 - q if flip and held(i) else q) for i, q in rows] for flip in (False, True))
    scores = [sorted((repr(r.doc_id), r.score, r.held_out) for r in qc.classify(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect()) for x in (one, other)]
    assert scores[0] == scores[1]
    assert {(i, h) for i, _, h in scores[0]} == {(repr(i), held("" if i is None else i)) for i in [*ids, None]}


def test_odd_rows(spark, docs, rows, empty):
    """Null, empty, very long and repeated texts, clashing names, empty tables, no labels, one class, null labels, ids with several labels."""
    schema = "doc_id long, quality int, score double"
    labels = spark.createDataFrame([(r[0], int(len(r[1] or "") > 200), 9.0) for r in rows] + [(15, None, 1.0), (15, 0, 1.0), (None, 1, 1.0)], schema)
    got = qc.classify(docs, labels).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r, s in zip(sorted(rows, key=lambda r: repr(r[0])), sorted(got, key=lambda g: repr(g.doc_id)), strict=True):
        if rows.count(r) == 1 and r[0] is not None:
            assert by_text.setdefault(r[1], s.score) == s.score and 0 <= s.score <= 1
    assert qc.classify(empty, labels).count() == 0
    assert {r.score for r in qc.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert all(r.score > 0.9 for r in qc.classify(docs, labels.filter("doc_id is not null").withColumn("quality", F.lit(1))).collect())


@pytest.mark.parametrize("n", [0, 1, 7, 300])
def test_flat_arrays_equal_nodes(n):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=(n, 5)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    forest = qc.fit(x, y, trees=8)

    def walk(row):
        total = forest.start
        for node in forest.roots.tolist():
            while forest.low[node] != node:
                node = int(forest.low[node] if row[forest.feature[node]] <= forest.at[node] else forest.high[node])
            total += forest.value[node]
        return total

    assert np.allclose(forest.log_odds(x), [walk(row) for row in x])
    if n == 300:
        assert ((forest.score(x) > 0.5) == y).mean() > 0.9
        # leaves are reached in depth steps, and histograms bin every value on the side that its threshold says
        assert forest.depth == 4 and len(forest.roots) == 8


def test_statistics():
    assert (qc.statistics(None) == 0).all() and (qc.statistics("") == 0).all()
    s = dict(zip(qc.NAMES, qc.statistics("Aa 1!\nAa 1!\n#"), strict=True))
    assert s["upper"] == pytest.approx(2 / 13) and s["line"] == pytest.approx(2 / 13) and s["shout"] == pytest.approx(2 / 13)
    assert s["line_repeats"] == pytest.approx(1 / 3) and s["distinct"] == pytest.approx(3 / 5) and s["symbol_words"] == pytest.approx(3 / 5)
    assert np.isfinite(qc.statistics("\x00" * 10)).all() and np.isfinite(qc.statistics("é😀 " * 50_000)).all()
