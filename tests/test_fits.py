"""The oracles' fits in SQL against closed forms and stationary points in numpy."""

import duckdb
import numpy as np
import pytest

from cairn.plans import fits


@pytest.fixture
def db():
    return duckdb.connect()


def test_ridge_in_sql_equals_closed_forms(db):
    rng = np.random.default_rng(3)
    x, alphas = rng.normal(size=(40, 5)) * [1, 2, 0.1, 5, 1], [0.1, 1.0, 30.0]
    x[:, 4] = x[:, 0] + 1e-3 * x[:, 4]  # nearly dependent
    y = x @ [1.0, -2, 3, 0.5, 0] + rng.normal(size=40)
    db.execute("CREATE TABLE t (id INT, x DOUBLE[], y DOUBLE)")
    db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, v.tolist(), float(g)) for i, (v, g) in enumerate(zip(x, y, strict=True))])
    body = fits.ridge("r", "t", alphas)
    got = {a: (np.array(w), b) for a, w, b in db.execute(f"WITH RECURSIVE {body} SELECT alpha, w, b FROM r_model").fetchall()}
    errors = {}
    for a in alphas:
        z = x - x.mean(0)
        w = np.linalg.solve(z.T @ z + a * np.eye(5), z.T @ (y - y.mean()))
        np.testing.assert_allclose(got[a][0], w, rtol=1e-8)
        assert got[a][1] == pytest.approx(y.mean() - x.mean(0) @ w)
        left = []
        for i in range(40):  # leave one out, the plain way
            k = np.arange(40) != i
            zk = x[k] - x[k].mean(0)
            wk = np.linalg.solve(zk.T @ zk + a * np.eye(5), zk.T @ (y[k] - y[k].mean()))
            left.append(y[i] - y[k].mean() - (x[i] - x[k].mean(0)) @ wk)
        errors[a] = np.sum(np.square(left))
    told = dict(db.execute(f"WITH RECURSIVE {body} SELECT * FROM r_errors").fetchall())
    assert told == pytest.approx(errors, rel=1e-2)  # the leave-one-out shortcut keeps the mean of all rows in the penalty
    assert db.execute(f"WITH RECURSIVE {body} SELECT alpha FROM r_best").fetchone()[0] == min(told, key=told.get)


def test_platt_in_sql_ends_where_the_gradient_is_zero(db):
    rng = np.random.default_rng(4)
    s = rng.normal(size=200)
    t = (s + rng.normal(size=200) > 0).astype(int)
    db.execute("CREATE TABLE f (s DOUBLE, t INT)")
    db.executemany("INSERT INTO f VALUES (?, ?)", list(zip(s.tolist(), t.tolist(), strict=True)))
    a, b = db.execute(f"WITH RECURSIVE {fits.platt('p', 'f')} SELECT a, b FROM p_model").fetchone()
    error = 1 / (1 + np.exp(-(a * s + b))) - t
    assert abs(error.sum()) < 1e-8 and abs((error * s).sum() + a) < 1e-8
