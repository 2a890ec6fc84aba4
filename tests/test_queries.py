"""Every query against its SQL on the small tables, and the entry point."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from corvid.plans.queries import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    rel = duck.execute(SQL[name])
    cols = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(cols)
    order = sorted(cols)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[cols.index(c)]) for c in order) for r in rel.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_voting_iterations_runs_all_categories_and_steps(spark, monkeypatch):
    from corvid.plans import queries

    asked = {}
    monkeypatch.setattr(queries.evaluate, "simulate_voting", lambda clips, seeds, **more: asked.update(more))
    QUERIES["voting_iterations"](spark, str(DATA))
    assert not set(asked) & {"categories", "every", "max_steps", "epochs"}
    monkeypatch.undo()
    few = queries.clips(spark, str(DATA)).where("clip_id < 40")
    got = queries.evaluate.simulate_voting(few, [0], epochs=2).collect()
    by = {}
    for r in got:
        by.setdefault(r.category, []).append(r.t)
    assert len(by) > 2 and all(sorted(t) == list(range(min(t), 21)) for t in by.values())
