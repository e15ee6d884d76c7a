import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from recordmill.operators import ranks
from recordmill.operators.ordering import running


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    n = 3000
    pdf = pd.DataFrame({
        "g": rng.choice(["hot", "a", "b", None], n, p=[0.7, 0.1, 0.1, 0.1]),
        "s": np.where(rng.random(n) < 0.4, 0.0, rng.integers(0, 200, n) / 7),
        "k": np.arange(n), "v": rng.integers(0, 9, n),
    })
    return spark.createDataFrame(pdf, "g string, s double, k long, v long")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("part", [[], ["g"]])
def test_sliced_equals_plain(frame, part):
    args = dict(number="rn", before={"b": "v"}, upto={"u": "v"}, lowest={"m": "v"})
    order = [F.desc("s"), F.asc("k")]
    assert rows(running(frame, part, order, **args)) == rows(running(frame, part, order, plain_rows=50, **args))


def test_quantiles_and_ranks(frame):
    pdf = frame.toPandas()
    q = ranks.exact_quantiles(frame, [], "s", {"a": 0.05, "b": 0.5, "c": 0.975}).first()
    assert np.allclose([q.a, q.b, q.c], np.quantile(pdf.s, [0.05, 0.5, 0.975]))
    r = ranks.average_ranks(frame, [], "s", "r").select("k", "r").toPandas().sort_values("k")
    assert np.allclose(r.r, pdf.sort_values("k").s.rank())


def test_train_percentile(spark):
    train = spark.createDataFrame([(x,) for x in [1.0, 2.0, 2.0, 4.0]], "s double")
    ev = spark.createDataFrame([(x,) for x in [0.0, 2.0, 3.0, 9.0]], "s double")
    got = {r.s: r.train_pct for r in ranks.train_percentile(train, ev, [], "s").collect()}
    assert got == {0.0: 0.0, 2.0: 0.25, 3.0: 0.75, 9.0: 1.0}
