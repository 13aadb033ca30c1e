"""Commit log: a stopped fit or HOOI goes on where it was and gives the same factors."""

import numpy as np
import pytest
from conftest import from_dense, to_dense

from cootensor.plans import regression as reg
from cootensor.plans.tucker import hooi, lcg_factors
from cootensor.sources.runstore import RunStore


class Stopped(Exception):
    pass


class Killed(RunStore):
    """A store whose run dies while it writes one factor: files are there, the log entry is not."""

    def __init__(self, spark, run_id, at):
        super().__init__(spark, run_id)
        self.at, self.saved = at, []

    def _commit(self, kind, it, mode):
        if kind == "factors" and (it, mode) == self.at:
            raise Stopped
        super()._commit(kind, it, mode)
        if kind == "factors":
            self.saved.append((it, mode))


def test_fit_goes_on_after_a_crash(spark):
    rng = np.random.default_rng(31)
    x, y = rng.uniform(1, 3, size=(3, 4, 6)), rng.uniform(1, 3, size=(2, 3, 6))
    tx, ty = from_dense(spark, x, ["a", "b", "h"]), from_dense(spark, y, ["a", "b", "h"])
    init = [spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(rng.uniform(0.1, 1, s))], "_1 int, _2 int, product double")
            for s in ((2, 4), (3, 5))]
    args = {"n_iter": 2, "precision": None, "route": "local"}
    want, scores = reg.fit(tx, ty, init, **args)
    broken = Killed(spark, None, (1, 1))
    with pytest.raises(Stopped):
        reg.fit(tx, ty, init, store=broken, **args)
    assert broken.committed() == {(0, 0), (0, 1), (1, 0)} and broken.committed("scores") == {(0, 0)}
    again = Killed(spark, broken.run_id, None)
    got, told = reg.fit(tx, ty, init, store=again, **args)
    assert again.saved == [(1, 1)]                      # nothing committed is done again
    for g, w, s in zip(got, want, ((2, 4), (3, 5))):
        np.testing.assert_allclose(to_dense(g, s, ["_1", "_2"]), to_dense(w, s, ["_1", "_2"]), rtol=1e-9)
    np.testing.assert_allclose(told, scores, rtol=1e-9)
    assert again.drop() and not again.committed()


def test_hooi_goes_on_after_a_crash(spark):
    t = from_dense(spark, np.random.default_rng(2).integers(1, 9, size=(4, 3, 3)).astype(float))
    init = lcg_factors(t, [2, 2, 2], seed=5)
    want = hooi(t, init, n_iter=2, route="gram")
    broken = Killed(spark, None, (1, 0))
    with pytest.raises(Stopped):
        hooi(t, init, n_iter=2, route="gram", store=broken)
    again = Killed(spark, broken.run_id, None)
    got = hooi(t, init, n_iter=2, route="gram", store=again)
    assert again.saved == [(1, 0), (1, 1), (1, 2)]
    for g, w, d in zip(got, want, (4, 3, 3)):
        np.testing.assert_allclose(to_dense(g, (2, d), ["_1", "_2"]), to_dense(w, (2, d), ["_1", "_2"]), atol=1e-9)


def test_cuts_are_removed(spark):
    store = RunStore(spark)
    a = store.cut(spark.range(3).toDF("x"))
    b = store.cut(a)
    store.drop_cuts(0, 1)
    assert b.count() == 3
    fs, p = store._fs(store._cuts[1])
    assert fs.exists(p) and store._cuts[0] == ""
