"""Jobs, reads in steps, stored baselines and snapshots on small hand-made rows."""

from __future__ import annotations

from concurrent.futures import Executor, Future

import pytest
from pyspark.sql import functions as F

from tagloom.operators import feed, groups, jobs, similar
from tagloom.sources import scan
from tagloom.streaming.snapshots import Snapshots


def ids(df):
    return [r["id"] for r in df.collect()]


ITEM = "id long, mime_type string, imported_at timestamp"


def items(spark, *mimes):
    time = __import__("datetime").datetime(2024, 1, 1)
    return spark.createDataFrame([(i, m, time) for i, m in enumerate(mimes)], ITEM)


def test_job_status(spark):
    item = items(spark, "image/png", "video/mp4", None, "image/png", "image/svg+xml")
    job = spark.createDataFrame([(0, "PENDING", "PENDING"), (1, "PENDING", "PENDING"), (3, "FAILED", "FAILED"), (4, None, None), (2, "PENDING", "PENDING")], "item_id long, thumbnail_status string, ocr_status string")
    assert tuple(jobs.thumbnail_status(job).first()) == (5, 3, 0, 0, 1, 0)
    assert ids(jobs.thumbnail_queue(item, job)) == [0, 1] and ids(jobs.thumbnail_queue(item, job, 1)) == [0]
    region = spark.createDataFrame([(0,), (0,)], "item_id long")
    assert tuple(jobs.ocr_status(item, job, region).first()) == (1, 0, 1, 2)
    tag = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "id long, name string")
    edges = spark.createDataFrame([(0, 1), (3, 1), (3, 3), (0, 2)], "item_id long, tag_id long")
    pick = lambda **k: ids(jobs.ocr_queue(item, job, tag, edges, **k))
    assert pick() == [0] and pick(retry_failed=True) == [3, 0] and pick(retry_failed=True, limit=0) == [3]
    assert pick(tags=("A ", "b"), retry_failed=True) == [3] and pick(tags=(" ",)) == [0] and pick(tags=("none",)) == []


def test_vector_jobs(spark):
    item = items(spark, "image/png", "image/png", "image/png", "video/mp4", "image/png")
    kind = "item_id long, base_url string, model string, dimensions int, resolution int, status string"
    rows = spark.createDataFrame([(0, "u", "m", 2, 9, "COMPLETE"), (1, "u", "m", 2, 9, "FAILED"), (2, "u", "other", 2, 9, "COMPLETE"), (3, "u", "m", 2, 9, "COMPLETE")], kind)
    config = jobs.VectorConfig("u", "m", 2, 9)
    assert tuple(jobs.vector_status(item, rows, config).first()) == (5, 4, 1, 1, 2, 1)
    assert tuple(jobs.vector_status(item.limit(0), rows, config).first()) == (0, 0, 0, 0, 0, 0)
    assert ids(jobs.vector_queue(item, rows, config, 9)) == [2, 4] and ids(jobs.vector_queue(item, rows, config, 9, after=2)) == [4]
    assert ids(jobs.vector_queue(item, rows, config, 9, retry_failed=True)) == [1]


def test_page_creators_judge_after_the_cut(spark):
    names = [f"{i}" for i in range(1, 9)] + ["real a", "real b", "real c"]
    tag = spark.createDataFrame([(i, n, "ARTIST", 100 - i) for i, n in enumerate(names)] + [(99, "x", "GENERAL", 500)], "id long, name string, category string, post_count long")
    edges = spark.createDataFrame([(1, i) for i in (*range(11), 99)] + [(2, 0)], "item_id long, tag_id long")
    member = spark.createDataFrame([(7, 1), (7, 1), (8, 2)], "group_id long, item_id long")
    assert [tuple(r) for r in groups.page_creators(member, tag, edges).collect()] == [(7, "real a, real b")]


def test_baseline_settings(spark):
    kind = "base_url string, model string, dimensions int, resolution int, generation long, baseline double, sample long"
    settings = spark.createDataFrame([("u", "m", 2, 9, 1, 0.4, 48), ("u", "n", 2, 9, 1, 0.3, 48)], kind)
    config = jobs.VectorConfig("u", "m", 2, 9)
    assert similar.known_baseline(settings, config, 1).first()["baseline"] == 0.4 and similar.known_baseline(settings, config, 2).count() == 0
    estimate = lambda n: spark.createDataFrame([(0.6, n)], "baseline double, sample long")
    assert similar.known_baseline(similar.remember_baseline(settings, estimate(47), config, 2), config, 1).count() == 1
    new = similar.remember_baseline(settings, estimate(48), config, 2)
    assert new.schema == settings.schema and new.count() == 2 and similar.known_baseline(new, config, 2).first()["baseline"] == 0.6


def test_result_page(spark):
    kind = "item_id long, base_url string, model string, dimensions int, resolution int, status string, v array<double>"
    rows = [(i, "u", "m", 2, 9, "COMPLETE", [1.0, i / 10]) for i in range(6)] + [(7, "u", "m", 2, 9, "FAILED", [1.0, 0.0]), (8, "u", "o", 2, 9, "COMPLETE", [1.0, 0.0]), (9, "u", "m", 2, 9, "COMPLETE", None)]
    query = spark.createDataFrame([(0, [1.0, 0.0])], "q_id long, q array<double>")
    page = lambda **k: [(r["item_id"], r["total"]) for r in similar.result_page(spark.createDataFrame(rows, kind), jobs.VectorConfig("u", "m", 2, 9), query, **k).collect()]
    assert page(limit=2) == [(0, 6), (1, 6)] and page(skip=4, exclude_self=True) == [(5, 5)] and page(cap=3, skip=2) == [(2, 3)]
    assert page(min_score=0.98) == [(0, 3), (1, 3), (2, 3)] and page(cap=0) == [(0, 1)]


def test_reads_in_steps(spark):
    df = spark.createDataFrame([(i,) for i in [3, 1, 5, 2, 4, None]], "id long")
    assert [[r["id"] for r in p] for p in scan.pages(df, "id", 2)] == [[1, 2], [3, 4], [5]]
    assert [[r["id"] for r in p] for p in scan.pages(df, "id", 5)] == [[1, 2, 3, 4, 5]] and list(scan.pages(df.limit(0), "id")) == []
    assert [tuple(r) for r in scan.in_order(df, "id", [5, 9, 1, 5]).collect()] == [(5, 0), (1, 2), (5, 3)] and scan.in_order(df, "id", []).count() == 0


def test_fetch_ahead():
    began = []

    def fetch(x):
        began.append(x)
        if x == 3:
            raise ValueError(x)
        return x * 10

    got = scan.ahead(fetch, [1, 2, 3])
    assert next(got) == 10 and next(got) == 20
    with pytest.raises(ValueError):
        next(got)
    assert began == [1, 2, 3] and list(scan.ahead(fetch, [])) == []


class ByHand(Executor):
    """Runs what is due when told to."""

    def __init__(self):
        self.due = []

    def submit(self, f, *args):
        future = Future()
        self.due.append((future, f, args))
        return future

    def work(self):
        due, self.due = self.due, []
        for future, f, args in due:
            try:
                future.set_result(f(*args))
            except Exception as error:
                future.set_exception(error)


def test_snapshots():
    built, hand = [], ByHand()

    def build(bucket):
        built.append(bucket)
        if bucket == 13:
            raise ValueError(bucket)
        return f"feed {bucket} #{len(built)}"

    first = Snapshots(build)
    assert first.read(1) == "feed 1 #1" and first.read(1) == "feed 1 #1"
    with pytest.raises(ValueError):
        Snapshots(build).read(13)
    built.clear()
    s = Snapshots(build, hand)
    s._kept = (0, 1), "old"
    assert s.read(1) == "old" and not hand.due
    assert s.read(2) == s.read(2) == "old" and len(hand.due) == 1  # stale while one build runs
    hand.work()
    assert s.read(2) == "feed 2 #1" and built == [2]
    s.clear()
    assert s.read(2) == "feed 2 #1" and len(hand.due) == 1
    s.clear()  # what was begun before is not kept
    hand.work()
    assert s.read(2) == "feed 2 #1" and len(hand.due) == 1
    hand.work()
    assert s.read(2) == "feed 2 #3"
    assert s.read(13) == "feed 2 #3"
    hand.work()
    assert s.read(13) == "feed 2 #3" and len(hand.due) == 1  # tried again


def test_one_of_each_group_takes_all_candidates(spark):
    ranked = spark.createDataFrame([(i, 1.0 / (i + 1)) for i in range(13_000)], "item_id long, score double")
    member = spark.createDataFrame([(1, 0), (1, 5), (2, 5), (2, 9)], "group_id long, item_id long")
    kept = feed.one_of_each_group(ranked, member)
    assert kept.count() == 12_999 and kept.where(F.col("item_id").isin(0, 5, 9)).count() == 2
