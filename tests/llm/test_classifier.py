import zlib

import numpy as np
from pyspark.sql import functions as F

from counterbook.llm import queries
from counterbook.llm import rule_ensemble as R


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.QUERIES["op4_rule_ensemble"](spark, sf).toPandas()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.3) == (rows.predicted == 1)).all()
    known = rows.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = known[known.held_out]
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.98
    assert (held.predicted == held.quality).mean() > 0.97


def test_compiled_rules_are_the_fitted_ones(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 3))
    y = ((x[:, 0] > 0.2) & (x[:, 1] <= 0.5)).astype(float)
    model = R.fit(x, y, ["a", "b", "c"])
    assert 0 < len(model.rules) < 120
    frame = spark.createDataFrame([(int(k), *map(float, v)) for k, v in enumerate(x)], "k int, a double, b double, c double")
    got = {q.k: q.s for q in frame.select("k", model.score().alias("s")).collect()}
    z = model.intercept + sum(w * rule.values(x, ["a", "b", "c"]) for rule, w in zip(model.rules, model.weights))
    assert np.allclose([got[k] for k in range(len(x))], 1 / (1 + np.exp(-z)))
    assert ((1 / (1 + np.exp(-z)) > 0.5) == (y > 0.5)).mean() > 0.95


def test_lasso_leaves_useless_rules_out():
    r = np.random.default_rng(0)
    x = (r.random((500, 30)) < 0.5).astype(float)
    y = x[:, 0]
    b, w = R.lasso_logistic(x, y, 0.02)
    assert w[0] > 1 and (np.abs(w[1:]) < 0.05).all()
    b, w = R.lasso_logistic(x, y, 10.0)
    assert (w == 0).all()


def test_odd_rows_and_missing_labels(spark, odd, odd_rows):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = R.train(odd, none)
    scores = R.scored(odd, model).collect()
    assert len(scores) == len(odd_rows) and all(abs(r.score - 0.5) < 1e-9 for r in scores)
    one = spark.createDataFrame([(1, 1), (2, None), (None, 0), (1, 1)], "doc_id long, quality int")
    assert all(0.5 < r.score < 1 for r in R.scored(odd, R.train(odd, one)).collect())
    stats = R.statistics(odd).collect()
    assert all(v is not None for r in stats for v in list(r)[1:])
    assert R.scored(odd.limit(0), model).count() == 0
    assert R.scored(odd.select("doc_id", "text", F.lit(1).alias("score"), F.lit("x").alias("chars")), model).columns == ["doc_id", "score"]
