"""Personal data and secrets (operators 2 and 7)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tagloom.llm import pii, secrets
from tagloom.llm.spans import digest, listed

from . import cases


def check(df, spans_col, kinds, brute):
    got = sorted((str(r[0]), r[1], r[2]) for r in df.select("doc_id", listed(F.col(spans_col), kinds), digest(F.col(spans_col), kinds)).collect())
    texts = [(r[0], r[1]) for r in cases.rows()]
    exp = sorted((str(i), s, cases.sha(s)) for i, s in ((i, cases.listed(brute(t or ""), kinds)) for i, t in texts))
    assert got == exp


def test_pii_base(spark):
    check(pii.find_personal_data(cases.edge_docs(spark)), "tl_spans", pii.KINDS, cases.pii_spans)
    assert pii.find_personal_data(cases.empty_docs(spark)).count() == 0


def test_secret_base(spark):
    check(secrets.find_secrets(cases.edge_docs(spark)), "tl_strong", secrets.KINDS, cases.secret_spans)
    assert secrets.find_secrets(cases.empty_docs(spark)).count() == 0


def test_links(spark):
    found = {r["doc_id"]: [(s["kind"], s["value"]) for s in r["tl_linked"]] for r in secrets.find_secrets(cases.edge_docs(spark)).collect() if r["doc_id"] in (406, 407)}
    assert (secrets.WEAK, "Zx9Qw8Er7Ty6Ui5Op4As") in found[406] and (secrets.IDENTIFIER, "user_name=bob123") in found[406]
    assert {k for k, _ in found[406]} == {secrets.WEAK, secrets.IDENTIFIER, secrets.ENDPOINT}
    assert found[407] == []  # a weak candidate far from its complement


def test_weak_forms(spark):
    """Secrets after '=', long ones, and ones without all three classes are found beside their complement, and not alone."""
    secrets_ = ["Zx9Qw8Er7Ty6Ui5Op4As", "aB3" + "xY7kLm2pQ9" * 40, "3f2b8c1e-9d47-4a60-b5e3-7c81f0d2a694", "k7w2m9x4q8r1t6y3u5", "JBSWY3DPEHPK3PXPQ2LK7VTN", "q1w2e3r4t5y6u7i8o9p0=="]
    texts = [f"client_id=bob77\nkey={s}\nhost=db.example.com" for s in secrets_]
    texts += [f"AccountName=..;AccountKey={s};server: db.example.com" for s in secrets_] + [f"key={s} and more" for s in secrets_]
    found = {r["doc_id"]: [s["value"] for s in r["tl_linked"] if s["kind"] == secrets.WEAK] for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [found[i] for i in range(len(texts))] == [[s] for s in secrets_] * 2 + [[]] * len(secrets_)


def test_links_inside_long_parts(spark):
    """An identifier in the middle of a url of thousands of characters, beside a secret, lies at no distance from the url."""
    text = "https://h.example.org/" + "a." * 1500 + "?user_name=bob123&key=Zx9Qw8Er7Ty6Ui5Op4As&" + "b." * 1500
    found = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert {(s["kind"], s["value"][:8]) for s in found["tl_linked"]} == {(secrets.ENDPOINT, "https://"), (secrets.IDENTIFIER, "user_nam"), (secrets.WEAK, "Zx9Qw8Er")}


def test_links_against_brute_force(spark):
    texts = [(i, " ".join(("user=u%03d" % j if (i * 7 + j) % 5 == 0 else "Ab1Cd2Ef3Gh4Ij5K%02dLm" % j if (i + j) % 3 == 0 else "https://h%d.example.org" % j if (i * j) % 7 == 3 else "filler word " * ((i + j) % 9)) for j in range(25))) for i in range(20)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = secrets.spotted(df).collect()
    got = {r["doc_id"]: {(s["start"], s["kind"]) for s in r["tl_linked"]} for r in secrets.find_secrets(df).collect()}
    some = 0
    for r in found:
        parts = [(s["start"], s["end"], s["kind"]) for s in (*r["tl_strong"], *r["tl_weak"])]
        exp = set()
        for s in r["tl_weak"]:
            near = {secrets.ROLE_OF_KIND[k] for a, b, k in parts if max(a - s["end"], s["start"] - b, 0) <= secrets.SCOPE}
            need = {secrets.WEAK: bool(near & {secrets.ID, secrets.PLACE}), secrets.IDENTIFIER: secrets.SECRET in near, secrets.ENDPOINT: {secrets.SECRET, secrets.ID} <= near}
            if need[s["kind"]]:
                exp.add((s["start"], s["kind"]))
        assert got[r["doc_id"]] == exp
        some += len(exp)
    assert some > 20


@pytest.mark.parametrize("most", [200_000, 0])
def test_disclosure(spark, monkeypatch, most):
    """A rare word beside an address in several documents gives it away; a common word does not."""
    rows = [(i, f"common words here then zyxxy jane@example.com follows with common words {i}") for i in range(3)]
    rows += [(10 + i, f"common words here then follows with something {i}") for i in range(40)] + [(90, "nothing of note"), (91, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find_personal_data(docs).collect()}
    assert [s["value"] for s in found[0]["tl_terms"]] == ["zyxxy"] and found[10]["tl_terms"] == []
    monkeypatch.setattr(pii, "MOST_ROWS", most)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[1] == "common words here then [...] [email] follows with common words 1"
    assert clean[10] == rows[3][1] and clean[91] is None and len(clean) == len(rows)


@pytest.mark.parametrize("most", [200_000, 0])
def test_disclosure_of_one_document(spark, monkeypatch, most):
    """On a table without copies, each entity stands in one document, and terms go wherever they stand there."""
    common = "common words here then follows with something"
    rows = [(i, f"{common} else") for i in range(40)] + [(50, f"Quuxley {common} " + "filler " * 30 + f"quuxley, o'neil.x@y.com \U0001f600 {common} QUUXLEY."), (51, f"{common} filler plover 10.1.2.3")]
    docs = spark.createDataFrame([*rows, (60, "filler xyzzy"), (60, "filler xyzzy"), (61, None)], "doc_id long, text string")
    monkeypatch.setattr(pii, "MOST_ROWS", most)
    found = {r["doc_id"]: r for r in pii.find_personal_data(docs).collect()}
    text = rows[40][1]
    assert [text[s["start"] : s["end"]] for s in found[50]["tl_terms"]] == ["Quuxley", "quuxley", "QUUXLEY"]
    assert [s["value"] for s in found[51]["tl_terms"]] == ["plover"] and found[60]["tl_terms"] == []
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[50] == f"[...] {common} " + "filler " * 30 + f"[...], o'[email] \U0001f600 {common} [...]."
    assert clean[51] == f"{common} filler [...] [ip]" and clean[60] == "filler xyzzy" and clean[61] is None


def brute_terms(texts):
    """The disclosive terms of each text, from counts over the distinct texts."""
    import math

    words = {t: {w.strip(",") for w in t.split()} for t in texts}
    n, have, pair = len(words), {}, {}
    for own in words.values():
        for w in own:
            have[w] = have.get(w, 0) + 1
        for e in (w for w in own if "@" in w):
            for w in own:
                pair[e, w] = pair.get((e, w), 0) + 1
    out = {}
    for t, own in words.items():
        for w in (w for w in own if "@" not in w):
            for (e, x), both in pair.items():
                bits = math.log2(n / have[e])
                open_ = math.log2(have[w] / both)
                if x == w and bits > 0 and ((e in own and bits - open_ >= pii.DISCLOSURE * bits) or (both >= pii.SUPPORT and open_ <= pii.HIDDEN)):
                    out.setdefault(t, set()).add(w)
    return {t: sorted(out.get(t, ())) for t in texts}


@pytest.mark.parametrize(("most", "hashes"), [(200_000, 200_000), (0, 0), (0, 200_000)])
def test_disclosure_against_brute_force(spark, monkeypatch, most, hashes):
    import random

    monkeypatch.setattr(pii, "MOST_ROWS", most)
    monkeypatch.setattr(pii, "MOST_TEXTS", most)
    monkeypatch.setattr(pii, "MOST_HASHES", hashes)
    monkeypatch.setattr(pii, "MOST_COMPARED", 2 if most else 64)
    rnd = random.Random(5)
    word = lambda: "w" + str(int(rnd.expovariate(0.04))).translate(str.maketrans("0123456789", "abcdefghij")) + "x"
    texts = [(i, " ".join(["the", *(word() for _ in range(25)), "end,"] + [f"u{rnd.randrange(9)}@x.org"] * (i % 3 > 0) + [f"v{i}@y.org"] * (i % 4 == 0))) for i in range(60)]
    texts += texts[:3] + [(100 + i, texts[1][1]) for i in range(4)]  # repeated rows and copies
    exp = brute_terms([t for _, t in texts])
    found = pii.find_personal_data(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], sorted({s["value"].lower() for s in r["tl_terms"]})) for r in found) == sorted((i, exp[t]) for i, t in texts)
    without = [t for _, t in texts if "@" not in t and exp[t]]
    assert 20 < sum(map(len, exp.values())) and without  # some texts without an entity hold terms too


def test_telling_terms_go_everywhere(spark):
    """A note that holds a telling term and no address loses the term; copies of it lend the term no weight."""
    rows = [(i, f"common words here then zyxxy jane@example.com follows with common words {i}") for i in range(3)]
    rows += [(10 + i, f"common words here then follows with something {i}") for i in range(40)] + [(70, "a note on Zyxxy, and (zyxxy) again"), (71, None), (72, "")]
    rows += [(80 + i, "plover words of lone@example.com") for i in range(5)] + [(90, "plover alone")]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[70] == "a note on [...], and ([...]) again" and clean[10] == rows[3][1]
    assert clean[84] == "[...] words of [email]" and clean[90] == "plover alone"  # one distinct text is a chance neighbour


def test_long_texts_are_linear(spark):
    """A text of 1 MB with tens of thousands of matches, overlaps and weak parts."""
    n = 20_000
    text = " ".join(f"{i % 250}.{i % 99}.3.4 a{i}@b.org 0123456789abcdef{i:05x}" for i in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = df.select(pii.base_spans(F.col("text")).alias("s"), "text").select("s", pii.masked(F.col("text"), F.col("s")).alias("m")).first()
    assert sorted((s["start"], s["kind"], s["end"]) for s in found["s"]) == sorted(cases.pii_spans(text)) and len(found["s"]) > n
    assert not cases.pii_spans(found["m"])
    strong = df.select(secrets.base_spans(F.col("text")).alias("s"), "text").select("s", secrets.weak_spans(F.col("text"), F.col("s")).alias("w")).first()
    assert sorted((s["start"], s["kind"], s["end"]) for s in strong["s"]) == sorted(cases.secret_spans(text)) and not strong["w"]


def test_span_helpers(spark):
    """Splicing, overlap and membership against plain loops, over random spans."""
    import random

    from tagloom.llm import spans

    rnd, rows = random.Random(3), []
    for i in range(60):
        text = "".join(rnd.choice("ab\U0001f600é \n") for _ in range(rnd.choice([0, 5, 1023, 1024, 1025, 3000])))
        ends = [sorted((rnd.randint(0, len(text)), rnd.randint(0, len(text)))) for _ in range(rnd.choice([0, 1, 2, 7, 40]))]
        own = [(a, b, rnd.randrange(5), "v") for a, b in ends if a < b]
        rows.append((i, text, own[::2], own[1::2]))
    df = spark.createDataFrame(rows, f"i long, text string, a {spans.SPAN}, b {spans.SPAN}")
    for r in df.select("i", pii.masked(F.col("text"), F.col("a")).alias("m"), pii.blanked(F.col("text"), F.col("a")).alias("n"), spans.apart(F.col("a"), F.col("b")).alias("k")).collect():
        _, text, a, b = rows[r["i"]]
        out, at, blank = "", 0, list(text)
        for s, e, k, _ in sorted(a, key=lambda x: (x[0], -x[1], x[2])):
            if s >= at:
                out += text[at:s] + ("[...]" if pii.KINDS[k] == "term" else f"[{pii.KINDS[k]}]")
            at = max(at, e)
            blank[s:e] = "\0" * (e - s)
        assert r["m"] == out + text[at:] and r["n"] == "".join(blank)
        assert [tuple(x) for x in r["k"]] == [x for x in a if not any(x[0] < y[1] and y[0] < x[1] for y in b)]
    words = spark.createDataFrame([(["b", "d", "f"], x) for x in "abcdefg"] + [([], "a")], "o array<string>, x string")
    assert [r[0] for r in words.select(spans.among(F.col("o"), F.col("x"))).collect()] == [False, True, False, True, False, True, False, False]


def test_registered_queries(spark, tmp_path):
    """op2 and op7 as registered, over the hard cases."""
    path = str(tmp_path)
    cases.edge_docs(spark).write.parquet(f"{path}/documents.parquet")
    texts = [(r[0], r[1] or "") for r in cases.rows()]
    for query, kinds, brute, columns in ((pii.op2_pii, pii.KINDS, cases.pii_spans, ["email", "ip", "card", "phone"]), (secrets.op7_secret_scans, secrets.KINDS, cases.secret_spans, ["assign", "access", "hex"])):
        out = query(spark, path)
        assert out.columns == ["doc_id", *[f"n_{c}" for c in columns], "base_sha256", "spans"]
        got = out.collect()
        exp = sorted((str(i), *[sum(k == c for _, c, _ in brute(t)) for k in range(len(columns))], cases.sha(cases.listed(brute(t), kinds))) for i, t in texts)
        assert sorted((str(r[0]), *r[1:-1]) for r in got) == exp
        for r in got:  # the method only adds
            base = [x for x in r["spans"].split(",") if x.split(":")[0] in columns]
            assert cases.sha(",".join(base)) == r["base_sha256"]


def test_sanitise_edges(spark):
    docs = cases.edge_docs(spark)
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert pii.sanitise(cases.empty_docs(spark)).count() == 0
    for r in out.collect():
        assert not cases.pii_spans(r["text"] or ""), r["text"][:200]
