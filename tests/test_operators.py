"""Operators on small hand-made rows."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.functions import listing, titles, urls
from tagloom.functions.tags import META_TAGS, min_score, parse_terms, positive_int, refine, search_meta, tag_category, tag_name, valid_creator, wildcard_error, wildcard_like
from tagloom.functions.vectors import dct_hash, format_vector, hamming, image_hashes, parse_vector, valid_vector
from tagloom.operators import facets, feed, fulltext, groups, ingest, recommend, search, similar, stats, vector_cache
from tagloom.sources import metadata, retry, upsert
from tagloom.streaming import counters


def one(spark, expr_of, *values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", expr_of(F.col("v")).alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]


def test_terms():
    q = parse_terms("Red Plate, -old rod, blu*, -*ring, landscape, -video, -, ,")
    assert (q.include, q.exclude, q.like, q.not_like, q.meta, q.not_meta, q.error) == (["Red Plate"], ["old rod"], ["blu*"], ["*ring"], ["landscape"], ["video"], None)
    assert parse_terms("").empty and parse_terms("*").error and parse_terms("a*").error
    assert wildcard_like(r"a%b_c\*") == r"a\%b\_c\\%" and wildcard_error("ab*") is None
    assert refine(["a", "-B"], "b") == ["a", "b"] and refine(["a"], "A", negated=True) == ["-A"]
    assert [positive_int(x, 48, 100) for x in ("7", "abc", None, "1e9", "-3", "500")] == [7, 48, 48, 1, 1, 100]
    assert [min_score(x) for x in (2.0, -2.0, float("nan"), None)] == [1.0, -1.0, None, None]
    assert search_meta("wide") == ["portrait", "landscape"] and search_meta("WebM") == ["video"] and search_meta("full hd") == ["highres"] and search_meta("gif") == ["animated"] and set(META_TAGS) >= set(search_meta(""))


def test_tag_text(spark):
    raw = ["Artist: Some One", "char:x", "unknown:thing", "plain", "rating:safe", "artist:", None]
    assert one(spark, tag_category, *raw) == ["ARTIST", "CHARACTER", "GENERAL", "GENERAL", "META", "GENERAL", "GENERAL"]
    assert one(spark, tag_name, *raw) == ["Some One", "x", "unknown:thing", "plain", "safe", "artist:", None]
    assert one(spark, valid_creator, "123", "user_abcd1234", "USER abcd1234", "real name", "12a") == [False, False, False, True, True]


def test_titles(spark):
    rows = {"Red Ring 7/10": ("Red Ring", 7), "Red Ring (3)": ("Red Ring", 3), "Red Ring [04]": ("Red Ring", 4), "Red  Ring - Part 2": ("Red Ring -", 2), "Red Ring chapter 5": ("Red Ring", 5), "Red Ring 12": ("Red Ring", 12), "Red Ring": ("Red Ring", 0), "話 その3": ("話", 3), "12/13": ("", 12)}
    assert one(spark, titles.base_title, *rows) == [b for b, _ in rows.values()]
    assert one(spark, titles.title_number, *rows) == [n for _, n in rows.values()]
    long = "x" * 300
    assert one(spark, titles.title_key, "Ab", long)[0] == "ab" and one(spark, titles.title_key, long)[0].startswith("title-sha256:")


def test_urls(spark):
    given = {
        "https://www.pixiv.net/en/artworks/12": ("PIXIV", "12"), "https://www.pixiv.net/member_illust.php?mode=x&illust_id=9": ("PIXIV", "9"),
        "https://i.pximg.net/img/2020/1/77_p0.png": ("PIXIV", "77"), "https://x.com/a/status/5": ("TWITTER", "5"), "https://fav.me/abc1": ("DEVIANTART", "abc1"),
        "https://danbooru.donmai.us/posts/3": ("DANBOORU", "3"), "https://gelbooru.com/index.php?page=post&id=8": ("GELBOORU", "8"), "https://example.com/a": (None, None),
    }
    assert one(spark, urls.source_type, *given) == [k for k, _ in given.values()]
    assert one(spark, urls.source_id, *given) == [i for _, i in given.values()]
    assert one(spark, urls.worth_showing, "https://i.pximg.net/x.png", "https://a.b/api/x", "https://www.site.org/y", "nonsense", None) == [False, False, True, False, False]
    rows = spark.createDataFrame([(1, 0, "https://twitter.com/a/status/5"), (1, 1, "https://x.com/b/status/5"), (1, 2, "https://www.site.org/y"), (1, 3, "https://pbs.twimg.com/z")], "id int, place int, url string")
    assert sorted(r["label"] for r in urls.display_sources(rows).collect()) == ["TWITTER", "site.org"]


def test_vectors(spark):
    assert one(spark, lambda c: hamming(c, F.lit(0)), -1, 0, 5, kind="long") == [64, 0, 2]
    assert one(spark, lambda v: valid_vector(parse_vector(v), 2), "[1,2]", "[1]", "[1,null]", "x") == [True, False, False, None]
    assert one(spark, lambda v: format_vector(parse_vector(v)), "[1,2.5]") == ["[1.0,2.5]"]
    gray = np.random.default_rng(1).integers(0, 256, (32, 32), dtype=np.uint8)
    df = spark.createDataFrame([(1, bytearray(gray.tobytes())), (2, bytearray(b"x")), (3, None)], "id long, pixels binary")
    got = {r["id"]: r["phash"] for r in image_hashes(df).collect()}
    assert got == {1: dct_hash(gray), 2: None, 3: None} and 0 <= got[1] < 1 << 63


@pytest.fixture(scope="module")
def tiny(spark):
    item = spark.createDataFrame([(i, f"{i:02x}", i // 2, w, h, "image/png", o) for i, (w, h, o) in enumerate([(10, 5, "landscape"), (5, 10, "portrait"), (None, None, None), (7, 7, "square"), (2000, None, None)])], "id long, hash string, imported_at int, width int, height int, mime_type string, orientation string")
    tag = spark.createDataFrame([(1, "cat", "GENERAL"), (2, "cat", "ARTIST"), (3, "dog", "GENERAL"), (4, "all", "META"), (5, "123", "ARTIST")], "id long, name string, category string")
    edges = spark.createDataFrame([(0, 1), (0, 2), (0, 4), (1, 1), (1, 3), (1, 4), (3, 3), (3, 4), (3, 5)], "item_id long, tag_id long")
    return item, tag, edges


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_search_semantics(tiny):
    item, tag, edges = tiny
    find = lambda text, **k: ids(search.search(item, tag, edges, parse_terms(text), **k))
    assert find("CAT") == [0, 1] and find("cat, dog") == [1] and find("cat, -dog") == [0]
    assert find("-cat") == [2, 3, 4] and find("nothing") == [] and find("cat, -nothing") == [0, 1] and find("") == []
    assert find("-portrait") == [0, 3] and find("-portrait", null_mode="keep") == [0, 2, 3, 4]
    assert find("highres") == [4] and find("-highres") == [0, 1, 3] and find("-lowres") == [2, 4]
    assert find("do*") == [1, 3] and find("-do*, cat") == [0] and find("zz*, cat") == []
    page = [r["id"] for r in search.newest(item, 1, 3).collect()]
    assert page == [4, 3, 2] and search.newest(item, 10_001).count() == 0
    near = search.neighbours(item, item.where("id = 2")).first()
    assert (near["previous_id"], near["next_id"]) == (3, 1)


def test_facets_semantics(tiny):
    item, tag, edges = tiny
    co = lambda q, **k: {r["name"]: (r["count"], r["remaining"]) for r in facets.cooccurring(item, tag, edges, parse_terms(q), **k).collect()}
    # Items with both tags of one name count twice in the total, but not in each tag's count.
    assert co("cat") == {"all": (2, 1), "dog": (1, 2)}
    assert co("dog") == {"cat": (1, 1)} and co("dog", text="al") == {"all": (2, 0)}
    assert {r["name"]: r["count"] for r in facets.meta_counts(item).collect()}["highres"] == 1
    assert facets.filtered_items(item, tag, edges, parse_terms("-cat")).count() == 1  # only items with a tag


def test_groups_semantics(spark):
    from tagloom.plans.gallery import member_stats

    edges = spark.createDataFrame([(1, 5, 0), (1, 6, 1), (2, 5, 0), (2, 6, 1), (3, 6, 0), (3, 5, 1), (4, 5, 0)], "group_id long, item_id long, position long")
    grp = spark.createDataFrame([(1, "TITLE", "a", "T"), (2, "PIXIV", "b", None), (3, "OTHER", "c", None), (4, "OTHER", "d", None), (5, "OTHER", "e", None)], "id long, source_type string, source_id string, title string")
    grp = grp.join(member_stats(edges), F.col("id") == F.col("group_id"), "left").drop("group_id").fillna({"member_count": 0})
    rows = groups.merged(grp).collect()
    assert [(r["id"], r["ids"], r["titles"], r["post_count"]) for r in rows] == [(1, "1,2,3", "T,,", 2)]
    strips = {r["id"]: (r["title"], r["ids"]) for r in groups.filmstrips(grp, edges).collect()}
    assert strips == {2: ("T", "1,2"), 3: (None, "3"), 4: (None, "4")}
    assert {r["item_id"]: r["group_id"] for r in groups.navigation_group(grp, edges).collect()} == {5: 2, 6: 2}
    assert groups.page_of(groups.reading_order(edges), 1, 9).first()["item_id"] == 6
    assert ids(ingest.orphan_groups(grp, edges)) == [5]


def test_recommendations(spark):
    # 1 shares tags 10 and 11 with 2, and 10 with 3; 4 is in 1's group; tag 13 is on one item only.
    edges = spark.createDataFrame([(1, 10), (1, 11), (1, 13), (2, 10), (2, 11), (3, 10), (3, 12), (4, 10), (4, 11), (5, 12)], "item_id long, tag_id long")
    item = spark.createDataFrame([(i,) for i in range(1, 9)], "id long")
    pairs = spark.createDataFrame([(1, 1), (1, 4)], "group_id long, item_id long")
    rows = recommend.recommend(spark.createDataFrame([(1,), (7,)], "item_id long"), item, edges, pairs).collect()
    assert [(r["item_id"], r["recommended_id"]) for r in sorted(rows, key=lambda r: r["rank"])] == [(1, 2), (1, 3)]
    cache = spark.createDataFrame([(1, 2, 0.5, "2024-01-01 12:00:00"), (9, 2, 0.5, "2023-01-01 00:00:00")], "item_id long, recommended_id long, score double, at string").withColumn("computed_at", F.col("at").cast("timestamp")).drop("at")
    calls = []

    def compute(cold):
        calls.append(sorted(r["item_id"] for r in cold.collect()))
        return cold.select("item_id", F.lit(3).cast("long").alias("recommended_id"), F.lit(1.0).alias("score"))

    answers, new = recommend.cached(spark.createDataFrame([(1,), (9,)], "item_id long"), cache, "2024-01-02 00:00:00", compute)
    assert calls == [[9]] and sorted((r["item_id"], r["recommended_id"]) for r in answers.collect()) == [(1, 2), (9, 3)] and new.count() == 2
    assert recommend.drifted(None, 5) and recommend.drifted(100, 102) and not recommend.drifted(100, 101)
    assert recommend.invalidate(cache, spark.createDataFrame([(2,)], "item_id long")).count() == 0


def test_similar(spark):
    rng = np.random.default_rng(3)
    hashes = [int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, 60)]
    hashes[7] = hashes[3] ^ 5
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hashes)], "item_id long, phash long")
    distance = lambda h: bin((h ^ hashes[3]) & (1 << 64) - 1).count("1")
    got = [(r["item_id"], r["distance"]) for r in similar.near_hashes(df, hashes[3], exclude=3, threshold=28, limit=100).collect()]
    assert got == sorted(((i, distance(h)) for i, h in enumerate(hashes) if i != 3 and distance(h) <= 28), key=lambda x: (x[1], x[0])) and got[0] == (7, 2)
    vec = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(20)] + [(99, [0.0] * 4)], "item_id long, v array<double>")
    base = similar.baseline(vec.where("item_id < 10")).first()
    assert (base["baseline"], base["sample"]) == (0.0, 10)
    top = similar.nearest(vec, vec.where("item_id = 3").select(F.col("item_id").alias("q_id"), F.col("v").alias("q")), cap=5)
    assert top.count() == 5 and top.orderBy(F.desc("score")).first()["item_id"] == 3


def test_feed(spark):
    draw = feed.mulberry32(1)
    assert all(0 <= draw() < 1 for _ in range(100)) and feed.mulberry32(7)() == feed.mulberry32(7)()
    many = [(i, 1 / (i + 1)) for i in range(200)]
    seeds = feed.select_seeds(many, 5)
    assert len(seeds) == 90 and len({i for i, _ in seeds}) == 90 and [i for i, _ in seeds[:30]] == list(range(30)) and min(w for _, w in seeds[30:]) >= 0.25
    assert feed.select_seeds(many[:3], 5) == many[:3]
    assert feed.first_claim([(1, [7]), (2, [7, 8]), (3, [8]), (4, [])]) == [1, 3, 4]
    rows = [(1, 1.0, True, "tag", 50, 0.6), (2, 1.0, True, "tag", 50, 1.4), (3, 1.0, False, "tag", 50, 0.5), (1, 1.0, True, "embedding", 60, 0.5), (3, 1.0, False, "tag", 70, 0.9)]
    ch = spark.createDataFrame(rows, "seed long, weight double, positive boolean, channel string, item_id long, similarity double")
    got = {r["item_id"]: r["score"] for r in feed.merge(ch, spark.createDataFrame([(1,), (60,)], "item_id long")).collect()}
    assert got == {50: pytest.approx(1.0 + 0.6 * 0.8 - 0.8 * 0.5), 60: pytest.approx(0.35)}
    ranked = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.7)], "item_id long, score double")
    pairs = spark.createDataFrame([(7, 1), (7, 2), (8, 2), (8, 3)], "group_id long, item_id long")
    assert sorted(r["item_id"] for r in feed.one_of_each_group(ranked, pairs).collect()) == [1, 3]


def test_collapsed_signals(spark):
    signals = spark.createDataFrame([(1, 30), (2, 20), (3, 10), (9, 5)], "item_id long, at int")
    pairs = spark.createDataFrame([(7, 1), (7, 2), (8, 2), (8, 3)], "group_id long, item_id long")
    claimed: set = set()
    assert sorted(r["item_id"] for r in feed.collapsed(signals, pairs, claimed).collect()) == [1, 3, 9] and claimed == {7, 8}
    assert sorted(r["item_id"] for r in feed.collapsed(signals, pairs, {8}, most=3).collect()) == [1]


def test_collapsed_takes_any_number_of_signals(spark):
    signals = spark.range(100_050).select(F.col("id").alias("item_id"), (-F.col("id")).alias("at"))
    pairs = spark.createDataFrame([(7, 3), (7, 100_049)], "group_id long, item_id long")
    assert feed.collapsed(signals, pairs, set()).count() == 100_049


def test_collapsed_in_rounds(spark, monkeypatch):
    """Rounds keep what the fold keeps, also where a chain of groups needs many and where the fold takes what they leave."""
    rng = np.random.default_rng(11)
    chain = [(i, 100 - i) for i in range(20)]
    some = [(100 + i, int(rng.integers(0, 40))) for i in range(300)]
    signals = spark.createDataFrame([*chain, *some, (900, None), (901, None), (902, 7)], "item_id long, at int")
    member = {(g, i) for i in range(20) for g in (1000 + i, 1001 + i)} | {(int(rng.integers(0, 120)), 100 + i) for i in range(300) for _ in range(i % 3)} | {(2000, 900), (2000, 901), (2000, 77_777)}
    pairs = spark.createDataFrame(sorted(member), "group_id long, item_id long")
    claimed: set = set()
    exp = sorted(r["item_id"] for r in feed.collapsed(signals, pairs, claimed).collect())
    assert 0 < len(exp) < signals.count() and set(range(0, 20, 2)) <= set(exp) and 900 in exp and 901 not in exp
    for folded, rounds in ((0, 30), (0, 2), (40, 30), (10**6, 30)):
        monkeypatch.setattr(feed, "FOLDED", folded)
        monkeypatch.setattr(feed, "ROUNDS", rounds)
        kept = feed.collapsed_all(signals, pairs)
        assert sorted(r["item_id"] for r in kept.collect()) == exp
        assert {g for r in kept.collect() for g in r["groups"] or ()} == claimed
    newest = spark.createDataFrame([(0, 9), (900, 8), (3, 7)], "item_id long, at int")
    assert feed.claimed_among(kept, newest, pairs, 2) == {1000, 1001, 2000}
    none = feed.collapsed_all(signals.limit(0), pairs)
    assert none.count() == 0 and feed.seeds_of(feed.recency_weights(none.withColumn("at", F.lit(None).cast("timestamp")), "2024-01-01"), 5) == []


@pytest.mark.parametrize("n", [3, 91, 1000])
def test_seeds_by_blocks(spark, monkeypatch, n):
    """Draws from blocks are those from the whole list."""
    monkeypatch.setattr(feed, "BLOCK", 7)
    rng = np.random.default_rng(n)
    weight = rng.random(n).round(6).tolist()
    rows = spark.createDataFrame([(i, -(i // 3), w) for i, w in enumerate(weight)], "item_id long, at int, weight double").repartition(5)
    for bucket in (5, 5688000):
        assert feed.seeds_of(rows, bucket) == feed.select_seeds(list(enumerate(weight)), bucket)


def test_nearest_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(40, 6)).round(3)
    vectors = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "item_id long, v array<double>")
    seeds = vectors.selectExpr("item_id AS seed", "v AS q")
    monkeypatch.setattr(similar, "MOST_SEEDS", 15)
    got = {(r["seed"], r["rank"]): r["item_id"] for r in similar.nearest_to_each(vectors, seeds, limit=3).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    score = (unit @ unit.T).round(6)
    exp = {(s, k + 1): i for s in range(40) for k, i in enumerate(sorted((i for i in range(40) if i != s), key=lambda i: (-score[s, i], i))[:3])}
    assert got == exp


def test_vector_cache(spark):
    key = vector_cache.text_key("  red   ring ")
    assert key == vector_cache.text_key("red ring") != vector_cache.image_key("a" * 64, 1024) != vector_cache.image_key("a" * 64, 512)
    for bad in (("A" * 64, 5), ("a" * 64, 0)):
        with pytest.raises((TypeError, ValueError)):
            vector_cache.image_key(*bad)
    kind = "query_hash string, base_url string, model string, dimensions int, query string, embedding array<double>, last_used_at timestamp"
    time = __import__("datetime").datetime(2024, 1, 1)
    cache = spark.createDataFrame([(key, "u", "m", 2, "red ring", [1.0, 2.0], time), (key, "u", "other", 2, "red ring", [5.0, 2.0], time), ("k2", "u", "m", 2, None, [1.0], time)], kind)
    row = vector_cache.lookup(cache, key, "u", "m", 2)
    assert [r["embedding"] for r in row.collect()] == [[1.0, 2.0]] and vector_cache.lookup(cache, "k2", "u", "m", 2).count() == 0
    used = vector_cache.touched(cache, row, "2024-02-01 00:00:00")
    assert used.where("last_used_at > timestamp '2024-01-15 00:00:00'").count() == 1 and used.count() == 3
    new = spark.createDataFrame([(key, "u", "m", 2, "red ring", [7.0, 7.0], time), ("k3", "u", "m", 2, "x", [1.0], time)], kind)
    assert [r["embedding"] for r in vector_cache.lookup(vector_cache.remember(cache, new), key, "u", "m", 2).collect()] == [[7.0, 7.0]]
    assert vector_cache.remember(cache, new).count() == 3


def test_listing_context():
    found = listing.parse({"ctx": "search", "tags": " Red , ,blue", "page": "3"})
    assert (found.tags, found.page) == (("red", "blue"), 3) and found.query() == "ctx=search&tags=red%2Cblue&page=3"
    assert listing.parse({"ctx": "search", "tags": " ,"}) is None and listing.parse({"ctx": "gallery", "sort": "random", "seed": "UPPER"}) is None
    assert listing.parse({"ctx": "gallery", "sort": "random", "seed": "abcd1234", "page": "1"}).seed == "abcd1234"
    assert listing.parse({"ctx": "gallery", "sort": "odd", "page": "x"}).sort == "newest" and listing.parse({}) is None


def test_retry():
    calls, slept = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 4:
            raise retry.UpstreamError(503)
        return "ok"

    assert retry.call(flaky, sleep=slept.append) == "ok" and slept == [0.1, 0.2, 0.4]
    assert max(retry.waits()) == 5.0 and len(retry.waits()) == 10
    with pytest.raises(retry.UpstreamError):
        retry.call(lambda: (_ for _ in ()).throw(retry.UpstreamError(404)), sleep=slept.append)
    assert not retry.worth_retrying(KeyError()) and retry.worth_retrying(retry.UpstreamError(429))


def test_fulltext(spark):
    hit = lambda text, q, **k: one(spark, lambda c: fulltext.matches(fulltext.words(c), q, **k), text)[0]
    assert hit("The background noise", "back") and not hit("The background", "back", prefix=False)
    assert hit("red old ring", '"old ring"') and not hit("old red ring", '"old ring"') and hit("old rings", '"old ring"') and not hit("old rings", '"old ring"', prefix=False)
    assert hit("a cat", "dog or cat") and not hit("a cat and dog", "cat -dog") and not hit(None, "cat") and not hit("cat", "--")
    rank = one(spark, lambda c: fulltext.rank(fulltext.words(c), "red ring"), "red ring", "red x x ring", "ring red ring", "red")
    assert rank == [pytest.approx(0.1), pytest.approx(0.1 / 3), pytest.approx(0.2), 0.0]  # words in between that match nothing weigh less
    either = one(spark, lambda c: fulltext.rank(fulltext.words(c), "red or ring or red ring or big blue -x"), "red ring", "x red red", "big y blue ring", "none", None)
    assert either == [pytest.approx(0.2), pytest.approx(0.2), pytest.approx(0.1 + 0.05), 0.0, None]
    assert one(spark, lambda c: fulltext.headline(c, "back"), "a <b> Background & co")[0] == "a &lt;b&gt; <mark>Back</mark>ground &amp; co"


def test_ingest(spark):
    rows = [
        {"file_id": 1, "hash": "a", "width": 4, "height": 3, "mime": "image/png", "known_urls": ["https://x.com/a/status/5", "https://i.pximg.net/i/77_p2.png"], "tags": {"s": {"display_tags": {"0": ["artist:Bob", "title:Story 3", "Title:story 4", "page:9", "system:x", "", None, "cat", "CAT"], "2": ["old"]}}}, "file_services": {"current": {"s": {"time_imported": 100}}}, "notes": {"n": "hello"}},
        {"file_id": 2, "hash": "b", "tags": {}},
    ]
    raw = spark.createDataFrame([(json.dumps(r),) for r in rows] + [("junk",), (None,)], "value string")
    meta = metadata.parse_metadata(raw)
    assert meta.count() == 2
    assert sorted((r["name"], r["category"]) for r in ingest.tags(meta).collect()) == [("Bob", "ARTIST"), ("CAT", "GENERAL"), ("Title:story 4", "GENERAL"), ("page:9", "GENERAL"), ("title:Story 3", "GENERAL")]
    assert sorted((r["source_type"], r["source_id"], r["position"]) for r in ingest.url_groups(meta).collect()) == [("PIXIV", "77", 3), ("TWITTER", "5", 0)]
    assert [(r["source_id"], r["position"]) for r in ingest.title_groups(meta).collect()] == [("story", 9)]
    got = {r["file_id"]: (r["orientation"], r["imported_at"].timestamp()) for r in ingest.files(meta, "1970-01-02 00:00:00").collect()}
    assert got[1][0] == "landscape" and got[2][0] is None and got[2][1] - got[1][1] == 86_300
    assert ingest.notes(meta).first()["content_hash"] == "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"
    old = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "k int, v int")
    new = spark.createDataFrame([(2, None), (3, 8), (4, 1)], "k int, v int")
    assert {r["k"]: r["change"] for r in ingest.diff(old, new, ["k"], ["v"]).collect()} == {1: "removed", 3: "changed", 4: "added"}
    assert sorted(r["k"] for r in ingest.changed_owners(old, new, "k", ["v"]).collect()) == [1, 3, 4]
    item = spark.createDataFrame([(1, "a"), (2, "b")], "id long, hash string")
    assert ids(ingest.vanished(item, spark.createDataFrame([("a",)], "hash string"))) == [2]
    assert ingest.vanished(item, spark.createDataFrame([], "hash string")).count() == 0


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 0), (1, "z", 0)], "k int, v string, at int")
    as_dict = lambda df: {r["k"]: r["v"] for r in df.collect()}
    assert as_dict(upsert.insert_ignore(old, new, ["k"])) == {1: "a", 2: "b", 3: "d"}
    assert as_dict(upsert.upsert(old, new, ["k"], "at")) == {1: "a", 2: "c", 3: "d"}
    assert as_dict(upsert.replace_keys(old, new, ["k"])) == {1: "z", 2: "c", 3: "d"}
    titled = spark.createDataFrame([(1, None), (2, "x")], "k int, v string")
    assert as_dict(upsert.upsert_if_changed(old, titled, "k", "v")) == {1: "a", 2: "x"}
    path = upsert.publish(old, str(tmp_path / "t"), 1)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(Exception):
        upsert.publish(old, str(tmp_path / "t"), 1)


def test_stats(spark):
    texts = spark.createDataFrame([("abcdefgh",), ("日本語",), ("",)], "content string")
    row = stats.cost(texts).first()
    assert (row["texts"], row["tokens_in"], row["tokens_out"]) == (3, 364, 240)
    boxes = spark.createDataFrame([(1, 0, -5.0, 0.0, 10.0, 10.0, 100.0, 50.0, "a"), (1, 1, 90.0, 40.0, 50.0, 50.0, 100.0, 50.0, "b"), (1, 2, 200.0, 0.0, 5.0, 5.0, 100.0, 50.0, "c"), (1, 3, 0.0, 0.0, 5.0, 5.0, 100.0, 50.0, " ")], "item_id long, reading_order int, x double, y double, width double, height double, image_width double, image_height double, ocr_text string")
    got = [(r["reading_order"], r["x"], r["width"], r["height"]) for r in stats.normalised_boxes(boxes).orderBy("reading_order").collect()]
    assert got == [(0, 0.0, 0.05, 0.2), (1, 0.9, 0.1, 0.2)]


def test_stream_equals_batch(spark, sf, tmp_path):
    spark.read.schema(counters.EVENTS).parquet(f"{sf}/events.parquet").write.parquet(str(tmp_path / "in"))
    got = counters.run_available(spark, str(tmp_path / "in"), counters.view_counts, "views", str(tmp_path / "state"))
    exp = counters.view_counts(spark.read.parquet(str(tmp_path / "in")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))


def test_plans(spark, sf):
    """Filters and columns reach the scan; top pages are taken without a full sort; no cartesian products."""
    from tagloom.plans.gallery import Gallery

    g = Gallery(spark, sf)
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    page = text(search.newest(search.search(g.item, g.tag, g.item_tag, parse_terms("red plate, -old rod")), 2))
    assert "TakeOrderedAndProject" in page and "CartesianProduct" not in page and "p_brand" not in page
    assert "WindowGroupLimit" in text(groups.previews(g.grp_item))


def test_unsound_vectors_are_not_kept(spark):
    cache = spark.createDataFrame([], "query_hash string, base_url string, model string, dimensions int, embedding array<double>, last_used_at timestamp")
    rows = spark.sql("SELECT k AS query_hash, 'u' AS base_url, 'm' AS model, 2 AS dimensions, e AS embedding, timestamp '2024-01-01' AS last_used_at FROM VALUES ('a', array(1D, 2D)), ('b', array(double('inf'), 1D)), ('c', array(double('nan'), 1D)), ('d', array(1D)) AS t(k, e)")
    kept = vector_cache.remember(cache, rows)
    assert [r["query_hash"] for r in kept.collect()] == ["a"]


def test_upsert_of_repeated_keys(spark):
    from tagloom.sources import upsert

    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, v string, w int")
    new = spark.createDataFrame([(1, "c"), (1, "d"), (1, None), (3, "x"), (3, "y")], "k int, v string")
    assert sorted(map(tuple, upsert.upsert_if_changed(old, new, "k", "v").collect()), key=str) == [(1, "d", 5), (2, "b", 6), (3, "y", None)]


def test_stored_relations_follow_their_inputs(spark, tmp_path):
    """A stored relation is built once, and again when the files that it comes from change."""
    from tagloom.sources.store import stored

    built = []

    def build():
        built.append(1)
        return spark.read.parquet(f"{tmp_path}/t.parquet").groupBy().count()

    def now():
        return stored(spark, "test-relation", [f"{tmp_path}/t.parquet"], build).first()["count"]

    spark.range(5).write.parquet(f"{tmp_path}/t.parquet")
    assert (now(), now(), len(built)) == (5, 5, 1)
    spark.range(7).write.mode("overwrite").parquet(f"{tmp_path}/t.parquet")
    assert (now(), now(), len(built)) == (7, 7, 2)


def test_recommendations_in_rounds(spark):
    """Rounds over light and heavy seeds give every item what one plan over all seeds gives."""
    item = spark.range(200)
    pairs = [(i, i % 23) for i in range(200)] + [(i, 100 + i % 31) for i in range(200)] + [(i, 200 + t) for i in range(10) for t in range(20)]
    edges = spark.createDataFrame(pairs, "item_id long, tag_id long")
    members = spark.createDataFrame([(i // 5, i) for i in range(200)] + [(1000 + i % 23, i) for i in range(100)], "group_id long, item_id long")
    got = recommend.recommend_all(item, edges, members, limit=7, round_pairs=500)
    assert {f.split("/")[-2].split("-")[0] for f in got.inputFiles()} == {"light", "heavy"} and any("/light-1/" in f for f in got.inputFiles())
    exp = recommend.recommend(item.withColumnRenamed("id", "item_id"), item, edges, members, limit=7)
    order = lambda df: sorted(tuple(r) for r in df.select("item_id", "recommended_id", "score", "rank").collect())
    assert order(got) == order(exp) and len({r[0] for r in order(got)}) > 100


def test_neighbours_block_by_block(spark, monkeypatch):
    """Blocks are written one after the other, and give what one block gives."""
    rows = [(i, [float(i % 7) + 1, float(i % 5), float(i % 3)]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "item_id long, v array<double>")
    seeds = vectors.selectExpr("item_id AS seed", "v AS q")
    members = spark.createDataFrame([(i // 4, i) for i in range(60)], "group_id long, item_id long")
    rows = lambda: similar.nearest_to_each(vectors, seeds, members, limit=5)
    exp = sorted(tuple(r) for r in rows().collect())
    monkeypatch.setattr(similar, "MOST_SEEDS", 25)
    got = rows()
    assert any("/block-2/" in f for f in got.inputFiles())
    assert sorted(tuple(r) for r in got.collect()) == exp and len(exp) == 300


def test_neighbours_read_vectors_once(spark, monkeypatch):
    """However many blocks the seeds make, the vectors are worked out once."""
    v = np.random.default_rng(5).normal(size=(60, 4))
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "item_id long, v array<double>")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    monkeypatch.setattr(similar, "MOST_SEEDS", 15)
    got = similar.nearest_to_each(rows.mapInArrow(counted, rows.schema), rows.selectExpr("item_id AS seed", "v AS q"), limit=3)
    assert got.count() == 180 and seen.value == 60


@pytest.mark.parametrize("pairs", [1 << 22, 50])
def test_neighbours_of_many_seeds(spark, monkeypatch, pairs):
    """Copies, large groups and odd vectors, in tiles of a few rows, against all pairs one by one."""
    rng = np.random.default_rng(7)
    v = rng.normal(size=(12, 8)).astype(np.float32).astype(float)[rng.integers(0, 12, 300)]
    v[::3] += rng.normal(scale=1e-3, size=(100, 8))
    v[7], v[8], v[9], v[10] = 0, np.nan, v[9] * 1e-155, v[10] * 1e155
    groups = {(0, i) for i in range(120)} | {(1 + i // 4, i) for i in range(100, 300)} | {(900 + i % 3, i) for i in range(0, 300, 11)} | {(5000, 10**6)}
    vectors = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)] + [(400, [1.0, 2.0]), (401, None), (402, [None] * 8)], "item_id long, v array<double>")
    seeds = vectors.where("item_id < 300 OR item_id = 401").selectExpr("item_id AS seed", "v AS q")
    members = spark.createDataFrame(sorted(groups), "group_id long, item_id long")
    for name, n in (("MOST_SEEDS", 170), ("TILE", 32), ("CHUNK", 40), ("TASK_SEEDS", 50), ("PAIRS", pairs)):
        monkeypatch.setattr(similar, name, n)
    got = sorted(tuple(r) for r in similar.nearest_to_each(vectors, seeds, members, limit=6, floor=-0.2).select("seed", "rank", "item_id", "score").collect())
    of = {i: {g for g, j in groups if j == i} for i in range(300)}
    with np.errstate(all="ignore"):
        score = np.round(np.einsum("id,jd->ij", v, v) / (np.sqrt((v * v).sum(axis=1))[:, None] * np.sqrt((v * v).sum(axis=1))), 6)
    exp = []
    for s in range(300):
        best = sorted((-score[s, i], i) for i in range(300) if i != s and not of[s] & of[i] and not np.isnan(score[s, i]))[:6]
        exp += [(s, k + 1, i, -x) for k, (x, i) in enumerate(best) if -x >= -0.2]
    assert got == sorted(exp) and len(got) > 1000


def test_many_seeds_of_several_lengths(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [1.0] * (2 + i % 2)) for i in range(9)], "item_id long, v array<double>")
    monkeypatch.setattr(similar, "MOST_SEEDS", 4)
    with pytest.raises(ValueError, match="one length"):
        similar.nearest_to_each(rows, rows.selectExpr("item_id AS seed", "v AS q"))
    none = rows.selectExpr("item_id AS seed", "CAST(NULL AS array<double>) AS q")
    assert similar.nearest_to_each(rows, none).count() == 0
