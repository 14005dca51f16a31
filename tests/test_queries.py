"""Every registered query of the library against its SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from tagloom.operators import feed
from tagloom.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(v):
    return "~" if v is None or isinstance(v, float) and math.isnan(v) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns
    df.collect()


def test_recommendations_of_all_items(spark, duck, sf):
    """The query over all seeds gives every item what SQL gives."""
    from tagloom.plans import catalogue
    from tagloom.plans.gallery import sql

    whole = catalogue.REC.replace(catalogue.SEEDS, "SELECT id AS seed FROM item")
    exp = duck.sql(sql(f"{whole} SELECT item_id, recommended_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10")).fetchall()
    got = [tuple(r) for r in QUERIES["rec_all"](spark, sf).select("item_id", "recommended_id", "score", "rank").collect()]
    assert sorted(got) == sorted(exp) and len({r[0] for r in got}) > 5 * len({r[0] for r in QUERIES["rec_batch"](spark, sf).collect()})


@pytest.fixture(scope="module")
def far(sf, tmp_path_factory):
    """The smallest tables with vectors of other items than the feed's seeds."""
    at = tmp_path_factory.mktemp("far")
    for f in os.listdir(sf):
        if f != "embeddings.parquet":
            os.symlink(f"{sf}/{f}", at / f)
    duckdb.connect().sql(f"COPY (SELECT * REPLACE (vec_id + 1000000 AS vec_id) FROM '{sf}/embeddings.parquet') TO '{at}/embeddings.parquet'")
    return str(at)


def test_channels_of_seeds_without_vectors(spark, far):
    """Seeds of which none has a vector keep what the tag channel finds."""
    con = duckdb.connect()
    for f in os.listdir(far):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{far}/{f}'")
    exp = con.sql(f"SELECT item_id, score FROM ({ORACLES['feed_merge_channels']})").fetchall()
    got = [tuple(r) for r in QUERIES["feed_merge_channels"](spark, far).select("item_id", "score").collect()]
    assert exp and sorted(got) == sorted(exp)


def test_full_feed_of_seeds_without_vectors(spark, far):
    """The feed goes on by tags where none of its seeds has a vector."""
    rows = QUERIES["feed_full"](spark, far).collect()
    assert rows and len({r["item_id"] for r in rows}) == len(rows)


def test_full_feed_leaves_favourites_in_tables(spark, sf, monkeypatch):
    """The driver gets a bounded part of the kept favourites, and the feed is that of all of them."""
    exp = QUERIES["feed_full"](spark, sf).collect()
    got, select = [], feed.select_seeds
    monkeypatch.setattr(feed, "select_seeds", lambda rows, bucket: (got.append(len(rows)), select(rows, bucket))[1])
    for name in ("BLOCK", "FOLDED"):
        monkeypatch.setattr(feed, name, 4, raising=False)
    assert QUERIES["feed_full"](spark, sf).collect() == exp and max(got, default=0) <= feed.RECENT + feed.SAMPLED


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
