"""PCA against Spark ML's own, on dense and sparse vectors."""
import numpy as np
import pytest
from pyspark.ml.feature import PCA
from pyspark.ml.linalg import Vectors

from textdrift.operators import learn as le


@pytest.mark.parametrize("sparse", [False, True])
def test_pca_equals_the_general_decomposition(spark, sparse):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 6)) * [5, 3, 2, 1, 0.5, 0]                 # the last column never varies
    x[rng.random(x.shape) < 0.3] = 0
    rows = [(i, Vectors.sparse(6, [(j, v) for j, v in enumerate(r) if v]) if sparse else Vectors.dense(r))
            for i, r in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, ["id", "features"])
    model = PCA(k=3, inputCol="features", outputCol="pca").fit(df)
    projected, explained = le.pca_explained(df, k=3)
    assert explained == pytest.approx(float(sum(model.explainedVariance.toArray())), abs=1e-9)
    want = {r.id: r.pca.toArray() for r in model.transform(df).collect()}
    for r in projected.collect():                                       # an axis may point either way
        assert np.allclose(np.abs(r.pca.toArray()), np.abs(want[r.id]), atol=1e-8)


def test_pca_of_a_wide_table_ends_soon(spark):
    import time
    rng = np.random.default_rng(4)
    rows = [(Vectors.sparse(1500, sorted(rng.choice(1500, 20, replace=False).tolist()), rng.random(20).tolist()),)
            for _ in range(300)]
    start = time.time()
    _, explained = le.pca_explained(spark.createDataFrame(rows, ["features"]), k=50)
    assert 0 < explained < 1 and time.time() - start < 60
