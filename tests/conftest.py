import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cootensor.session import get_session
    s = get_session("local[*]", app="cootensor-tests", shuffle_partitions=8)
    yield s


def to_dense(df, shape, modes=None, value="product"):
    modes = modes or [c for c in df.columns if c != value]
    a = np.zeros(shape)
    for r in df.select(*modes, value).collect():
        a[tuple(int(r[m]) for m in modes)] += r[value]
    return a


def from_dense(spark, a, names=None, value="product", keep_zero=False):
    names = names or [f"_{i + 1}" for i in range(a.ndim)]
    rows = [tuple(int(i) for i in idx) + (float(a[idx]),) for idx in np.ndindex(a.shape)
            if keep_zero or a[idx] != 0]
    schema = ", ".join([f"{n} int" for n in names] + [f"{value} double"])
    return spark.createDataFrame(rows, schema)


def matrix_df(spark, m, value="product"):
    return from_dense(spark, np.asarray(m, dtype=float), ["_1", "_2"], value)
