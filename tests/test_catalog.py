"""Every query of the catalogue that has SQL, against DuckDB."""

import math

import duckdb
import numpy as np
import pytest

from stratavec.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(x):
    x = x.item() if hasattr(x, "item") else x
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    return str(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(tuple(map(plain, r)) for r in frame[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf_dir, db, name):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(db.sql(ORACLES[name]).df())


def test_ivf_recall(spark, sf_dir):
    near = {r.vec_id for r in QUERIES["ivf_topk"](spark, sf_dir).collect()}
    exact = {r.vec_id for r in QUERIES["vec_cosine_topk"](spark, sf_dir).collect()}
    assert len(near & exact) >= 8


def ivf_recall(spark, sf_dir, **kw):
    """Mean share of the 10 nearest, by brute force, that the search finds; of all ids divisible by 20."""
    got = {}
    for r in QUERIES["ivf_topk"](spark, sf_dir, **kw).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    ids, v = zip(*duckdb.sql(f"select vec_id, embedding from '{sf_dir}/embeddings.parquet' order by vec_id").fetchall(), strict=True)
    v = np.array(v, np.float64)
    v /= np.linalg.norm(v, axis=1)[:, None]
    asked = [i for i, x in enumerate(ids) if x % 20 == 0]
    return np.mean([len(got[ids[i]] & {ids[j] for j in np.argsort(-(v @ v[i]), kind="stable")[:10]}) / 10 for i in asked])


def test_ivf_mean_recall(spark, sf_dir):
    assert ivf_recall(spark, sf_dir) >= 0.9
    assert ivf_recall(spark, "/root/testdata/sf0.1") >= 0.9


def test_every_query_is_named_after_its_function():
    assert all(f.__name__ == n for n, f in QUERIES.items())
    assert set(ORACLES) <= set(QUERIES)
