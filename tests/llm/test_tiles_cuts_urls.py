"""Operators 11 to 13 against brute force and on odd input."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL

from partloom.llm import divergence, fim, queries, urls

COLUMNS = "doc_id long, text string, lang string, source string, n long, term string, block int, band int, own int, kept string"
LONG = "Zebra crossing Nummer über 7 " * 9000
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (5, "one two"), (None, "null id text"), (7, LONG), (8, LONG), (9, "Ünï漢字 🙂 <|e|> tail\n "), (10, "has <S> inside of it"), (11, "123 456")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *(given or ["en", "s"]), 1, "x", 2, 3, 4, "y") for i, t, *given in rows], COLUMNS)


# 11


def brute_audit(rows, least, best):
    docs = [(lang or "", source or "", [w.translate({k: k + 32 for k in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]) for t, lang, source in rows]
    out = []
    for lang in {x for x, _, _ in docs}:
        seen = Counter(w for x, _, ws in docs if x == lang for w in set(ws))
        kept = sorted(w for w, n in seen.items() if n >= least)
        counts = {s: Counter(w for x, y, ws in docs if (x, y) == (lang, s) for w in ws if w in kept) for s in {y for x, y, _ in docs if x == lang}}
        whole = sum(counts.values(), Counter())
        p = lambda c, w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept))
        for s, c in counts.items():
            pairs = [(sum(abs(p(c, w) - p(d, w)) for w in kept), o) for o, d in counts.items() if o != s]
            terms = [(p(c, w) - p(whole, w), w) for w in kept if c[w] and p(c, w) > p(whole, w)]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, best)):
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1) if k <= most]
    return sorted(out)


@pytest.mark.parametrize("terms, band", [(2048, 256), (3, 2), (1, 1)])
def test_audit_equals_brute_force(spark, monkeypatch, terms, band):
    """Whatever the sizes of tiles and bands; groups without terms, languages without kept terms, ties, nulls, repeats."""
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "BAND", band)
    r = random.Random(terms)
    words = ["a", "B", "über", "Über", "漢", "c", "C", "d", "e", "f", "zz", "É"]
    rows = [(" ".join(r.choices(words, range(1, 13), k=r.randint(0, 9))), r.choice(["en", "de", None]), r.choice(["s1", "s2", "s3", "S", None, "é"])) for _ in range(300)]
    rows += [(None, "en", "none"), ("12 34", "en", "digits"), ("once only", "xx", "s1"), ("", "xx", "s2"), *[("a a b", "en", "copies")] * 40, (LONG, "de", "s1")]
    docs = frame(spark, [(k, *x) for k, x in enumerate(rows)])
    got = sorted(tuple(x) for x in divergence.audit(docs, 5, 4).collect())
    assert got == brute_audit(rows, 5, 4)


def test_parts_are_exact():
    r = random.Random(1)
    for _ in range(200):
        kept = r.randint(1, 10**8)
        total = r.randint(0, 8 * 10**15)
        counts = np.array([0, total, r.randint(0, total)], np.int64)
        assert divergence.parts(counts, total, kept).tolist() == [1 + 10**9 * (c + 5) // (total + 5 * kept) for c in counts.tolist()]
    p = np.random.default_rng(0).integers(0, 10**9, (7, 50))
    assert np.array_equal(divergence.pair_sums(p, 2, 6), [[sum(abs(p[i] - p[j])) for j in range(7)] for i in range(2, 6)])


def test_audit_of_no_rows(spark):
    assert divergence.audit(frame(spark, [])).count() == 0


def test_audit_does_not_depend_on_blocks_of_text(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = sorted(tuple(x) for x in divergence.audit(docs).collect())
    assert sorted(tuple(x) for x in divergence.audit(docs.repartition(13)).collect()) == want and len(want) > 100


# 12


def units(text):
    return re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)


def brute_cut(doc_id, text):
    u = units(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(u), "plain", None, None, text
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    return (len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_cut_equals_brute_force(spark):
    r = random.Random(3)
    rows = [*ODD, *((k, "".join(r.choices([" ", "\n", "\x0b", "a", "é", "漢", "🙂", "\xa0", "<", "S>", "\0"], k=r.randint(0, 40)))) for k in range(100, 700))]
    done = fim.fill_in_middle(frame(spark, rows)).withColumn("back", fim.restored(fim.F.col("output"), fim.F.col("form")))
    got = sorted((tuple(x) for x in done.collect()), key=repr)
    assert got == sorted(((i, *brute_cut(i, t or ""), t or "") for i, t in rows), key=repr)
    assert {x[2] for x in got} == {"plain", "psm", "spm"} and fim.fill_in_middle(frame(spark, [])).count() == 0


def test_other_marks_and_rates(spark):
    docs = frame(spark, ODD)
    marks = ("[pre]", "[suf]", "[mid]")
    done = fim.fill_in_middle(docs, seed=7, rate=100, spm=0, marks=marks).withColumn("back", fim.restored(fim.F.col("output"), fim.F.col("form"), marks)).collect()
    assert sorted(x.back for x in done) == sorted(t or "" for _, t in ODD) and {x.form for x in done} == {"plain", "psm"}
    assert all(x.form == "psm" and x.output.startswith("[pre]") for x in done if x.back)


def test_bits_are_selected_by_rank():
    r = random.Random(5)
    for _ in range(300):
        at = sorted(r.sample(range(2000), r.randint(1, 60)))
        assert [fim.select(sum(1 << i for i in at), k + 1) for k in range(len(at))] == at
    for text in ("a", " ", "a ", " a", "ab  cd\n", "é漢 🙂"):
        ends = fim.unit_ends(text.encode())
        cuts = np.cumsum([len(u.encode()) for u in units(text)]) - 1
        assert [k for k in range(len(text.encode())) if ends >> k & 1] == cuts.tolist()


# 13

FORMS = [
    ("http://www.Example.net/a/b.html?utm_source=x&b=2&a=1#top", "example.net/a/b?a=1&b=2"),
    ("https://m.example.net:443/a/b/?a=1&ref=q&b=2", "example.net/a/b?a=1&b=2"),
    ("ftp://user:pw@example.net", "example.net"),
    ("http://example.net/?", "example.net"),
    ("http://example.net:8080/x?gclid&fbclid=1", "example.net:8080/x"),
    ("no scheme", None), ("://", None), (None, None), ("", None), ("http:///path", None), ("x?u=http://in.side/p?q=1", "in.side/p?q=1"),
]


def test_canonical_urls(spark):
    df = spark.createDataFrame([(u, k) for u, k in FORMS], "u string, k string")
    assert all(r.k == r.c for r in df.select("k", urls.canonical(urls.F.col("u")).alias("c")).collect())


def judged(df):
    return Counter((r.page_id, r.host, r.path, r.rule, r.verdict, r.listed) for r in df.collect())


def test_rules_and_odd_pages(spark):
    pages = [(1, "http://a.example.org/es/1"), (2, "http://notexample.org/es/1"), (3, "https://EXAMPLE.org/en/12?x#y"), (4, "http://x.com/fr/"), (5, "http://x.com/de/9"), (6, "http://x.com"), (7, "http://org"), (8, None), (9, ""), (10, "http://x.net/é/" + "y" * 200_000), (None, "http://bad.net/p.html"), (12, "https://www.bad.net/p/#z"), (12, "https://www.bad.net/p/#z"), (13, "bad.net/p"), (14, "http://com/de/")]
    rows = spark.createDataFrame([(i, u, "h", 1, 2, "k", False) for i, u in pages], "page_id long, url string, host string, block int, w0 int, key string, listed boolean")
    listed = spark.createDataFrame([("http://bad.net/p",), ("http://bad.net/p",), (None,), ("",), ("http://x.com/de/9",)], "url string")
    got = judged(urls.judge(rows, listed))
    assert got == Counter([
        (1, "a.example.org", "/es/1", "example.org/es/", "block", None), (2, "notexample.org", "/es/1", "org/", "allow", None), (3, "example.org", "/en/12", "example.org/en/1", "block", None),
        (4, "x.com", "/fr/", "com/fr/", "allow", None), (5, "x.com", "/de/9", "com/de/", "block", None), (6, "x.com", "", None, "allow", False), (7, "org", "", None, "allow", False),
        (8, "", "", None, "allow", False), (9, "", "", None, "allow", False), (10, "x.net", "/é/" + "y" * 200_000, None, "allow", False), (None, "bad.net", "/p.html", None, "block", True),
        (12, "www.bad.net", "/p/", None, "block", True), (12, "www.bad.net", "/p/", None, "block", True), (13, "", "", None, "allow", False), (14, "com", "/de/", "com/de/", "block", None),
    ])
    assert judged(urls.judge(rows, listed.limit(0), ())) == Counter((i, h, p, None, "allow", False) for (i, h, p, *_), n in got.items() for _ in range(n))
    assert urls.judge(rows.limit(0), listed).count() == 0


def test_filter_loses_nothing_and_the_join_removes_the_rest(spark, monkeypatch):
    """Every listed key passes, few others do, and with a saturated or no filter the verdicts are the same."""
    pages = spark.range(3000).selectExpr("id AS page_id", "concat('http://h', id % 7, '.net/', id) AS url").union(spark.range(4000).selectExpr("id + 10000", "'https://www.h1.net/1'"))
    listed = spark.range(0, 3000, 3).selectExpr("concat('https://h', id % 7, '.net/', id, '/?ref=a') AS url").union(spark.sql("SELECT 'http://h1.net/1'"))
    keys = listed.select(urls.canonical(urls.F.col("url")).alias("key"))
    held, blocks = urls.blocked_bloom(keys, "key")
    passed = {r.key for r in urls.may_be_listed(pages.select(urls.canonical(urls.F.col("url")).alias("key")), "key", held, blocks, "maybe").where("maybe").collect()}
    exact = {r.key for r in keys.collect()}
    assert exact <= passed and len(passed - exact) < 60 and held.count() <= blocks
    want = {r.page_id for r in pages.collect() if r.page_id % 3 == 0 and r.page_id < 10000 or r.url.endswith("h1.net/1")}
    for full, most in ((urls.FULL, urls.MOST_BLOCKS), (10**9, 1), (1, 1)):
        monkeypatch.setattr(urls, "FULL", full)
        monkeypatch.setattr(urls, "MOST_BLOCKS", most)
        out = urls.judge(pages, listed)
        assert {r.page_id for r in out.where("verdict = 'block'").collect()} == want and out.count() == 7000


def test_native_plan(spark):
    plan = queries.QUERIES["op13_url_filter"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan) and "ShuffledHashJoin" in plan
