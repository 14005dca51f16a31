"""Fingerprints, near-dedup, quality, languages, mixing and urls (operators 5, 8, 9, 10, 4 and 3)."""

from __future__ import annotations

import hashlib
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tagloom.llm import components, ctph, langid, mixing, quality, simhash, urls

from . import cases


# --- 5


def test_neighbours(spark):
    docs = cases.edge_docs(spark)
    rows = ctph.neighbours(docs).collect()
    texts = sorted(((-(1 << 63) if r[0] is None else r[0], hashlib.blake2b((r[1] or "").encode("utf-8", "surrogatepass"), digest_size=8).digest(), r[0], r[1] or "") for r in cases.rows()), key=lambda x: (-x[0], x[1]))
    exp = []
    for k, (_, _, i, t) in enumerate(texts):
        nxt = texts[(k + 1) % len(texts)][3]
        e = ctph.edited(t, nxt)
        f, g = ctph.fingerprint(t), ctph.fingerprint(e)
        exp.append((str(i), len(t), cases.sha(e), f, g, ctph.likeness(f, g), ctph.likeness(f, ctph.fingerprint(nxt))))
    assert sorted((str(r[0]), *r[1:]) for r in rows) == sorted(exp)
    assert ctph.neighbours(cases.empty_docs(spark)).count() == 0
    alone = ctph.neighbours(spark.createDataFrame([(5, "just one text")], "doc_id long, text string")).first()
    assert alone["near_next"] == 1.0


def slow_ctph(text):
    """The fingerprint byte by byte, with a rolling state, and with chunk hashes as plain sums."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return "3::"
    size = 3
    while size * 64 < len(data):
        size *= 2

    def signature(block, most):
        out, window, start, value = [], [0] * 7, 0, 0
        char = lambda v: ctph.ALPHABET[(((v ^ v >> 32) * 0xD6E8FEB86659FD93) % 2**64) >> 58]
        for i, c in enumerate(data):
            window = [*window[1:], c]  # the oldest first
            plain = sum(window)
            weighted = sum((k + 1) * x for k, x in enumerate(window))
            shifted = 0
            for x in window:
                shifted = (shifted << 5 ^ x) % 2**32
            value = (value + (c + 1) * pow(ctph.BASE, i - start, 2**64)) % 2**64
            if (plain + weighted + shifted + 1) % 2**32 % block == 0 and len(out) < most - 1:
                out.append(char(value))
                start, value = i + 1, 0
        return "".join(out) + (char(value) if start < len(data) else ""), len(out)

    def cuts(block):
        return signature(block, 10**9)[1]

    while cuts(size) < 31 and size > 3:
        size //= 2
    return f"{size}:{signature(size, 64)[0]}:{signature(2 * size, 32)[0]}"


def slow_likeness(x, y):
    """Levenshtein distance without substitutions, by the plain table."""
    if x == y:
        return 1.0

    def like(a, b):
        a, b = (re.sub(r"(.)\1{3,}", r"\1\1\1", s) for s in (a, b))
        k = min(7, len(a), len(b))
        if not k or not any(a[i : i + k] in b for i in range(len(a) - k + 1)):
            return 0.0
        row = list(range(len(b) + 1))
        for i, c in enumerate(a):
            new = [i + 1]
            for j, d in enumerate(b):
                new.append(row[j] if c == d else 1 + min(row[j + 1], new[-1]))
            row = new
        return 1 - row[-1] / (len(a) + len(b))

    (bx, *xs), (by, *ys) = x.split(":"), y.split(":")
    same = [like(a, b) for i, a in enumerate(xs) for j, b in enumerate(ys) if int(bx) << i == int(by) << j]
    return max(same, default=0.0)


def test_fingerprints_against_brute_force():
    texts = ["", "a", "abcdefg", "x" * 500, cases.prose(1, 20), cases.prose(2, 400), cases.prose(3, 2500), "é\U0001f600ß " * 300, cases.prose(2, 400)[:1500] + "NEW" + cases.prose(2, 400)[1500:], "\n".join(cases.prose(4, 30) for _ in range(20))]
    found = [ctph.fingerprint(t) for t in texts]
    assert found == [slow_ctph(t) for t in texts]
    for a in found:
        for b in found:
            assert ctph.likeness(a, b) == pytest.approx(slow_likeness(a, b))


def test_fingerprint_is_stable_under_edits():
    text = cases.prose(3, 2000)
    other = text[:4000] + "INSERTED" + text[4000:]
    assert ctph.likeness(ctph.fingerprint(text), ctph.fingerprint(other)) > 0.8
    assert ctph.likeness(ctph.fingerprint(text), ctph.fingerprint("".join(map(chr, np.random.default_rng(1).integers(33, 900, 9000))))) < 0.2
    data = np.frombuffer(text.encode(), np.uint8)
    assert (ctph.rolling(data)[10:] == ctph.rolling(data[4:])[6:]).all()  # seven bytes decide


def test_common_length():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(max(row[j] + (x == y), row[j + 1], new[-1]))
            row = new
        return row[-1]

    rng = np.random.default_rng(0)
    for _ in range(100):
        a, b = ("".join(rng.choice(list("abcd"), int(n))) for n in rng.integers(0, 40, 2))
        assert ctph.common_length(a, b) == slow(a, b)


# --- 8


def slow_fingerprint(t):
    words = re.findall(cases.SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode("utf-8", "surrogatepass"), seed=42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values, most=4):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    values = sorted(root)
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= most:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_near_groups(spark):
    docs = cases.edge_docs(spark)
    fps = [(r[0], slow_fingerprint(r[1])) for r in cases.rows()]
    root = classes([f for _, f in fps])
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    got = sorted((str(r["doc_id"]), r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_groups(docs).collect())
    assert got == sorted((str(i), f, least.get(root[f])) for i, f in fps)
    assert simhash.near_groups(cases.empty_docs(spark)).count() == 0
    kept = simhash.drop_near(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least.values()))


def test_drop_near_edges(spark):
    """A column of maps, repeated rows, and rows without a doc_id; helper tables go with components."""
    rows = [(1, "one two three four five", {"a": 1}), (1, "one two three four five", {"a": 2}), (None, "six seven eight nine", None), (None, "six seven eight nine ten", {}), (2, None, None), (3, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra map<string,int>")
    kept = simhash.drop_near(docs)
    assert kept.columns == docs.columns and sorted(str(tuple(r)) for r in kept.collect()) == sorted(["(1, 'one two three four five', {'a': 1})", "(None, 'six seven eight nine', None)", "(2, None, None)"])


def test_op8_as_registered(spark, tmp_path):
    cases.edge_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    out = simhash.op8_simhash_near_dedup(spark, str(tmp_path))
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((str(r[0]), r[1]) for r in out.collect()) == sorted((str(r[0]), f"{slow_fingerprint(r[1]):016x}") for r in cases.rows())


def test_hubs(spark, monkeypatch):
    """Stars beyond the bound of a heavy node, joined by broadcast, beside a long path."""
    edges = [(0, i) for i in range(1, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + i, 2001 + i) for i in range(20)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {v: 0 if v < 1000 else 1000 if v < 2000 else 2000 for e in edges for v in e}


@pytest.mark.parametrize("bucket", [8192, 40])
def test_links_of_clumps(spark, monkeypatch, bucket):
    """Dense clumps, chains and strangers; with small buckets the blocks are compared too."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(4)
    values = set(map(int, rng.integers(0, 1 << 63, 200)))
    for centre in list(values)[:4]:
        for _ in range(60):
            flips = rng.choice(64, int(rng.integers(1, 6)), replace=False)
            values.add(centre ^ sum(1 << int(b) for b in flips))
    step = int(rng.integers(0, 1 << 62))
    for _ in range(30):
        step ^= sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        values.add(step)
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {r["node"] % (1 << 64): r["root"] for r in components.components(simhash.fingerprint_edges(df, len(signed))).collect()}
    root = classes(values)
    size = {}
    for r in root.values():
        size[r] = size.get(r, 0) + 1
    assert set(got) == {v for v in values if size[root[v]] > 1}
    for a in got:
        assert got[a] == got[next(b for b in got if root[b] == root[a])]
    assert len(set(got.values())) == len({root[v] for v in got})


def test_thresholds_cover_all_links():
    rng = np.random.default_rng(6)
    sample = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    for m in range(2, 6):
        parts = simhash.group_bits(np.abs(rng.normal(size=(64, 64))), m)
        assert sorted(b for p in parts for b in p) == list(range(64))
        for n in (1_000, 10**9):
            cost, chosen = simhash.allocate(parts, n, sample, 5)
            assert cost == float("inf") or sum(t + 1 for t in chosen) == 5


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components.components(edges.limit(0)).count() == 0


# --- 9


def slow_features(t):
    t = t or ""
    words = re.findall(cases.SPACE, t)
    lines = [x for x in t.split("\n") if re.search(cases.SPACE, x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_quality_features(spark):
    docs = cases.edge_docs(spark)
    got = sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.quality_rules(docs).collect())
    exp = [(str(r[0]), *(f := slow_features(r[1])), f[0] < 20 or 100 * f[4] > 30 * f[0]) for r in cases.rows()]
    assert got == sorted(exp)
    assert all(quality.text_features(t)[:5] == slow_features(t) for t in ("a b c d e f g h " * 3, "x\ny\nx\n \nx", "# a\n# a", "w " * 500, "\u2028a\x1cb c"))
    assert quality.quality_rules(cases.empty_docs(spark)).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in quality.quality_rules(docs).collect())


def test_cutoffs_adapt(spark):
    """A source that writes with many symbols keeps its documents; elsewhere such a document stands out."""
    text = lambda i, s: cases.prose(i, 60) + "".join(f" {s}{i + j}" for j in range(30) if s)
    rows = [(i, text(i, "#|"), "en", "code") for i in range(60)] + [(100 + i, text(i, ""), "en", "news") for i in range(60)] + [(999, text(3, "#|"), "en", "news")]
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not kept.pop(999) and all(kept.values())


def rates_of(t):
    n_words, word_chars, symbols, dup, repeat, lines, upper, punct, digits = quality.text_features(t)
    chars = max(word_chars, 1)
    return {"symbol_rate": symbols / chars, "punct_rate": punct / chars, "digit_rate": digits / chars, "upper_rate": upper / chars, "dup_line_rate": dup / max(lines, 1), "repeat_rate": repeat / max(n_words, 1), "word_length": word_chars / max(n_words, 1)}


def brute_cutoffs(values):
    """Cutoffs by sorted values, rounded up to the bounds of bins."""
    import math

    gamma = (1 + quality.ACCURACY) / (1 - quality.ACCURACY)
    bins = sorted(math.ceil(math.log(v) / math.log(gamma)) for v in values if v > 0)
    if len(bins) < quality.LEAST_DOCS:
        return None
    q1, q3, tail = (bins[max(math.ceil(q * len(bins)) - 1, 0)] for q in (0.25, 0.75, quality.TAIL))
    reach = quality.FENCE * max(q3 - q1, 1)
    return gamma ** (q1 - 1 - reach) * (1 - 1e-9), gamma ** min(q3 + reach, tail) * (1 + 1e-9)


def test_kept_against_brute_force(spark, sf):
    """kept of every document against quantiles of sorted values, and most cutoffs are the groups' own."""
    rows = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    good = [r for r in rows if slow_features(r["text"])[0] >= 20 and 100 * slow_features(r["text"])[4] <= 30 * slow_features(r["text"])[0]]
    rate, exp, cuts = {r["doc_id"]: rates_of(r["text"]) for r in good}, set(), set()
    at = {}
    for r in good:
        for key in ((r["lang"], r["source"]), (r["lang"],), ()):
            at.setdefault(key, []).append(rate[r["doc_id"]])
    cut_of = {(key, m): brute_cutoffs([x[m] for x in of]) for key, of in at.items() for m, _, _ in quality.METRICS}
    for r in good:
        ok = True
        for m, _, both in quality.METRICS:
            cut = next((c for key in ((r["lang"], r["source"]), (r["lang"],), ()) if (c := cut_of[key, m])), None)
            v = rate[r["doc_id"]][m]
            if cut:
                cuts.add((m, round(cut[1], 9)))
                ok &= v <= cut[1] and not (both and 0 < v < cut[0])
        if ok:
            exp.add(r["doc_id"])
    got = {r["doc_id"] for r in quality.op9_quality_rules(spark, sf.replace("0.001", "0.01")).where("kept").collect()}
    assert got == exp and 0.8 * len(good) < len(exp) < len(good)
    assert len(cuts) > 2 * len(quality.METRICS)  # cutoffs differ by group


def test_sketches_merge(spark):
    """Sketches of parts add up to that of the whole."""
    rows = spark.createDataFrame([(i, cases.prose(i, 30 + i % 50), "en", "a") for i in range(200)], "doc_id long, text string, lang string, source string")
    f = rows.select("lang", "source", quality.features(F.col("text")).alias("f")).select("lang", "source", "f.*")
    parts = quality.sketches(f.where("n_words % 2 = 0")).unionByName(quality.sketches(f.where("n_words % 2 = 1")))
    merged = parts.groupBy("lang", "source", "metric", "bin").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, quality.sketches(f).select(*merged.columns).collect()))


# --- 10


def test_language_accuracy(spark, sf):
    out = langid.op10_language_id(spark, sf.replace("0.001", "0.01")).join(spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(out) > 150 and (out["lang"] == out["lang_pred"]).mean() >= 0.99 and out["score"].between(0, 1).all()


def test_language_edges(spark):
    docs = cases.edge_docs(spark)
    found = langid.predict(docs, langid.fit(docs)).collect()
    assert len(found) == len(cases.rows())
    got = sorted((str(r["doc_id"]), r["lang_pred"] == "und") for r in found)
    assert got == sorted((str(r[0]), not any(c.isalpha() for c in r[1] or "")) for r in cases.rows())
    nothing = langid.predict(docs, langid.fit(cases.empty_docs(spark))).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}
    assert langid.predict(cases.empty_docs(spark), langid.fit(docs)).count() == 0


def test_bit_slices():
    """The table gives all languages of an n-gram, for more languages than one word has bits."""
    rng = np.random.default_rng(1)
    chosen = [rng.integers(0, 1 << 62, 50).astype(np.uint64) for _ in range(70)]
    filters = langid.Filters([f"l{i:02d}" for i in range(70)], chosen)
    for i in (0, 63, 64, 69):
        counts = langid.popcounts(filters.state(), chosen[i])
        assert counts[i] == pytest.approx(50, abs=0.5) and np.argmax(counts) == i


def test_predictions_against_brute_force(spark):
    """Sets in the place of Bloom filters: the same languages, and nearly the same scores; rare languages are learned too."""
    texts = {"en": "the house of the morning and the river", "de": "das haus am morgen und der fluss", "fr": "la maison du matin et la riviere", "xx": "zqzq"}
    rows = [(i, f"{t} {cases.prose(i, 3) if lang == 'en' else ''} {t.split()[i % len(t.split())]}", lang) for i in range(12) for lang, t in texts.items() if lang != "xx" or i == 0]
    rows.append((12, "the morning", "en"))  # English has the most documents
    docs = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows)], "doc_id long, text string, lang string")
    counts = {}
    for _, text, lang in rows:
        for g in langid.grams(text).tolist():
            counts.setdefault(lang, {}).setdefault(g, 0)
            counts[lang][g] += 1
    rate = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    top = {}
    for c in rate.values():
        for g, r in c.items():
            top[g] = max(r, top.get(g, 0))
    held = {lang: {g: r for g, r in c.items() if r >= langid.TYPICAL * top[g]} for lang, c in rate.items()}
    asked = [t for _, t, _ in rows] + ["the fluss of la maison", "zqzq", "haus river", "ЖЖЖЖ", "123"]
    found = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), langid.fit(docs)).collect()}
    for i, t in enumerate(asked):
        part = {lang: sum(g in c for g in langid.grams(t).tolist()) / sum(c.values()) for lang, c in held.items()}
        if not any(part.values()):
            assert (found[i]["lang_pred"], found[i]["score"]) == (("en", 0.0) if any(c.isalpha() for c in t) else ("und", 0.0))
            continue
        best = min(part, key=lambda x: (-part[x], x))
        assert found[i]["lang_pred"] == best and found[i]["score"] == pytest.approx(part[best] / sum(part.values()), abs=0.01)
    assert found[len(asked) - 4]["lang_pred"] == "xx"


# --- 4


def test_mixing_matches_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = mixing.op4_source_mixing(spark, sf)
    cols = got.columns
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({mixing.op4_sql()})").fetchall())


def test_mixing_rates(spark):
    rows = spark.createDataFrame([(i, "s0" if i % 3 else ("s2" if i % 2 else None), "t") for i in range(30_000)], "doc_id long, source string, text string").withColumn("tl_row", F.lit(1))
    out = mixing.mix(rows, weights={"s0": 3.0, "s2": 0.5}, epochs=2.0)
    assert out.columns == rows.columns
    n = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    for source, weight in (("s0", 3.0), ("s2", 0.5), (None, 1.0)):
        assert n[source] == pytest.approx(60_000 * weight / 4.5, rel=0.05)
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mix(rows.repartition(7), weights={"s0": 3.0, "s2": 0.5}, epochs=2.0).collect()))
    big = mixing.replicate(spark.createDataFrame([(i, "a") for i in range(300)], "doc_id long, source string"), weights={}, epochs=90.0).select("tl_row.doc_id", "tl_copies").distinct().toPandas()["tl_copies"]
    assert big.mean() == pytest.approx(90, rel=0.05) and big.var() == pytest.approx(90, rel=0.35)
    table = spark.createDataFrame([("s0", 3.0), ("s2", 0.5)], "source string, weight double")
    again = mixing.mix(rows, weights=table, epochs=2.0)
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))
    docs = cases.edge_docs(spark)
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(cases.empty_docs(spark)).count() == 0


# --- 3

URLS = [
    "https://WWW.Example.NET/en/1", "http://example.net/de/2?x=/en/", "https://a.example.com/de/3#t", "http://shop.org/fr/", "http://org/fr/x", "ftp://files.org/a", "no scheme at all", "", None,
    "http://x.net", "http://notexample.com/de/1", "https://m.ads-track.example.com/en/7", "http://www.spam-farm.example.org/fr/9", "http://www.spam-farm.example.org/en/9", "https://a.com/setup.EXE", "https://a.com/poker/online/now", "https://a.com/viagra12/x",
    "https://a.com/wp-login.php", "weird\n://h\nost/p\nq?r", "://", "http://adult-x.example.com/es/1", "https://a.com/x?redirect=https://b.casino", "https://a.com/banner/1/popup",
]


def test_urls_against_sql(spark):
    rows = [(i % 20, u) for i, u in enumerate(URLS + URLS[:5])]
    df = spark.createDataFrame([(*r, "n", "t") for r in rows], "page_id long, url string, host string, token string")
    got = urls.judge_urls(df)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    exp = con.sql(f"SELECT {', '.join(got.columns)} FROM ({urls.op3_sql()})").fetchall()
    plain = lambda t: tuple("~" if v is None else v for v in t)
    assert sorted(map(plain, got.collect())) == sorted(map(plain, exp))
    verdicts = {(r["page_id"], r["pattern"]) for r in got.collect()}
    assert (12, "@@||spam-farm.*/fr/") in verdicts or any(p for _, p in verdicts)
    assert urls.judge_urls(df.limit(0)).count() == 0


def test_many_rules_and_a_popular_url(spark, monkeypatch):
    """Thousands of rules, a url that a third of the pages has, and joins by shuffle as by broadcast."""
    rules = [f"||site{i}.example^" for i in range(3000)] + ["@@/free/", "^common^"]
    rows = [(i, "http://site7.example/common/x") for i in range(400)] + [(1000 + i, f"http://site{i}.example/{'free/' if i % 3 else 'common/'}") for i in range(600)] + [(5000 + i, f"http://other{i}.example/free") for i in range(100)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    exp = sorted((i, "allow" if "/free/" in u or "other" in u else "block") for i, u in rows)
    for most in (200_000, 0):
        monkeypatch.setattr(urls, "MOST_ROWS", most)
        assert sorted((r["page_id"], r["verdict"]) for r in urls.judge_urls(df, (), rules).collect()) == exp
    assert {r["verdict"] for r in urls.judge_urls(df, (), ()).collect()} == {"allow"}


def test_rule_tokens():
    for i, line in enumerate(urls.PATTERN_RULES):
        rule = urls.parse_rule(i, line)
        for u in filter(None, URLS):
            if re.search(rule.regex, u.lower()):
                assert set(rule.tokens) <= set(re.findall("[a-z0-9]+", u.lower())), (line, u)
    assert urls.parse_rule(0, "||ads-track.").tokens == ("ads", "track") and urls.parse_rule(0, "/x[0-9]+/").tokens == ()
