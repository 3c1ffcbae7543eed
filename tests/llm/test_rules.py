"""Quality rules, url filters, licences and the mix, against plain Python."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from respondex.llm import licenses, mixing, quality, url_filter

DOCS = "doc_id long, text string, source string, n_words string, taken string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts):
    rows = [(i, t, f"s{i % 2}" if i % 5 else None, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


TEXTS = [
    None,
    "",
    " \n\t ",
    "of the " * 60,
    "\n".join(["the word is here in a line of text with more words"] * 3 + ["and so on"] * 9),
    " ".join(f"of w{i} the" for i in range(40)),
    " ".join(f"w{i}### the" for i in range(40)),
    " ".join(f"w{i}" for i in range(80)),
    "a b c a b c d\u00e9 b c d\u00e9 \U0001f600 x" + " z" * 60,
    "word " * 20_000,
]


def measured(text):
    words = WORD.findall(text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    places = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            places |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(places),
    )


def test_quality_measures_and_verdicts(spark):
    found = quality.judge(docs(spark, TEXTS)).select("_row.doc_id", "*").drop("_row").collect()
    assert len(found) == len(TEXTS)
    for row in found:
        n, chars, symbols, dup, rep = measured(TEXTS[row.doc_id])
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (
            n, chars, symbols, dup, rep,
        )
        assert row.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (row.base_failed and row.kept)
    assert [r.doc_id for r in found if r.kept] == [5]
    assert {r.doc_id: r.failed for r in found}[6] == "symbols"
    kept = quality.keep_good(docs(spark, TEXTS))
    assert kept.columns == docs(spark, []).columns and kept.count() == 1
    assert quality.keep_good(docs(spark, [])).count() == 0


def test_quality_runs_no_python(spark):
    plan = quality.judge(docs(spark, TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "EvalPython" not in plan and "MapIn" not in plan


URLS = [
    ("http://WWW.Example.COM/en/x", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("http://m.www.example.com/en/", "m.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://m.example.com/en/1?q=/es/", "m.example.com", "/en/1", "example.com/en/", "block"),
    ("https://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
    ("https://a.net/es/#x", "a.net", "/es/", "net/es/", "block"),
    ("https://a.net?es/", "a.net", "", None, "allow"),
    ("https://a.net:80/fr/", "a.net:80", "/fr/", None, "allow"),
    ("https://example.com", "example.com", "", None, "allow"),
    ("a.net/fr/", "", "", None, "allow"),
    ("://", "", "", None, "allow"),
    ("x://y://z/fr/", "y:", "//z/fr/", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
]


def test_urls(spark):
    schema = "page_id long, url string, host string, rule string"
    rows = [(i, u[0], "other", "other") for i, u in enumerate(URLS * 2)]
    judged = url_filter.judge_urls(spark.createDataFrame(rows, schema), url_filter.rule_table(spark))
    got = {r.page_id: (r.url, r.host, r.path, r.rule, r.verdict) for r in judged.collect()}
    assert got == dict(enumerate(URLS * 2))
    empty = spark.createDataFrame([], schema)
    assert url_filter.judge_urls(empty, url_filter.rule_table(spark)).count() == 0
    none = url_filter.rule_table(spark).where("false")
    assert {r.verdict for r in url_filter.judge_urls(judged, none).collect()} == {"allow"}


def test_url_rules_without_slash_and_ties(spark):
    rules = spark.createDataFrame(
        [("a.b", "/x", "allow"), ("a.b", "/x", "block"), ("b", "", "allow"), (None, "/", "block")],
        "host string, path string, verdict string",
    )
    pages = spark.createDataFrame([(1, "h://a.b/xyz"), (1, "h://c.b/xyz"), (None, "h://c")], "page_id long, url string")
    got = {r.url: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {"h://a.b/xyz": ("a.b/x", "block"), "h://c.b/xyz": ("b", "allow"), "h://c": (None, "allow")}


@pytest.mark.parametrize(
    ("expression", "score", "labels"),
    [
        ("MIT", 0.1, ["mit"]),
        ("MIT OR GPL-3.0-only", 0.1, ["mit", "gpl"]),
        ("MIT AND GPL-3.0-only", 0.7, ["mit", "gpl"]),
        ("GPL-2.0 WITH Classpath-exception-2.0", 0.35, ["gpl"]),
        ("MIT OR Apache-2.0 AND LGPL-2.1+", 0.1, ["mit", "apache", "lgpl"]),
        ("(MIT OR Apache-2.0) AND LGPL-2.1+", 0.5, ["mit", "apache", "lgpl"]),
        ("Odd-1.0", 0.5, ["odd-1.0"]),
    ],
)
def test_licence_expressions(expression, score, labels):
    assert licenses.evaluate(expression) == (score, labels)


@pytest.mark.parametrize("bad", ["", "MIT OR", "OR MIT", "(MIT", "MIT)", "MIT MIT", "MIT (GPL)", "()"])
def test_licence_expressions_that_are_none(bad):
    with pytest.raises(ValueError):
        licenses.evaluate(bad)


def test_licence_scan(spark):
    texts = [
        None,
        "",
        "Licensed under CC BY-NC 4.0. cc by, CC-BY cc by",
        "GNU General\nPublic  License; ALL RIGHTS RESERVED!",
        "\u00c4cc by and cc bye, Xgeneral public license",
        "/* SPDX-License-Identifier: MIT OR GPL-2.0 */\nSPDX-License-Identifier: (Apache-2.0",
        "cc by " * 3000,
    ]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, texts * 2)).collect()}
    assert len(got) == 14
    for i, text in enumerate(texts * 2):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        want = sorted(
            (k, label)
            for phrase, label in licenses.BASE_PHRASES.items()
            for k in range(len(words))
            if words[k : k + phrase.count(" ") + 1] == phrase.split()
        )
        assert got[i].n_words == len(words)
        assert sorted((s.word, s.label) for s in got[i].spans if s.base) == want
        assert 0 <= got[i].score <= 1
    assert got[2].labels == ["cc-by", "cc-by-nc"]
    assert got[5].labels == ["apache", "gpl", "mit"] and got[5].score == 0.1
    assert got[5].expressions == ["MIT OR GPL-2.0", "(Apache-2.0"]
    assert got[0].labels == [] and got[0].score == 0
    assert licenses.scan(docs(spark, [])).count() == 0


def plain_targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > 2 * sizes[s]]
        if not over:
            return out | {s: weight[s] * level for s in open_}
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def test_mix_comes_near_its_targets(spark):
    texts = [" ".join(["w"] * (7 * i % 90)) for i in range(900)] + [None, ""] + ["a b c"] * 50
    rows = [(i, t, None if i % 7 == 0 else f"s{i % 5 if i % 3 else 0}", "x", "y") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, DOCS)
    options = {"block": 8, "shard_rows": 50}
    got = mixing.mix(frame, **options).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    source = {r[0]: r[2] for r in rows}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.size == len(WORD.findall(texts[r.doc_id] or ""))
        assert 0 <= r.taken <= 2 * r.size
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
    want = plain_targets(sizes)
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 16
    again = mixing.mix(frame.repartition(5), **options).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    mixed = mixing.mixed_documents(frame, **options)
    assert mixed.columns == frame.columns
    per = mixed.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n"))
    assert {r.source: r.n for r in per.collect()} == dict(taken)


def test_mix_of_a_source_smaller_than_a_block(spark):
    texts = [" ".join(["w"] * 40)] * 100 + [" ".join(["v"] * 10)] * 3
    rows = [(i, t, ("a" if i % 2 else "b") if i < 100 else "tiny", "x", "y") for i, t in enumerate(texts)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    tiny = [r for r in got if r.doc_id >= 100]
    assert abs(sum(r.taken for r in tiny) - tiny[0].target) <= 0.2 * tiny[0].target
    for s in ("a", "b"):
        rows = [r for r in got if r.doc_id < 100 and (r.doc_id % 2 == 1) == (s == "a")]
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 0.05 * rows[0].target


def test_mix_of_little(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    empty = mixing.mix(docs(spark, [None, ""])).collect()
    assert [(r.size, r.taken) for r in empty] == [(0, 0), (0, 0)]


def test_seats_by_highest_quotient(spark):
    weights = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.0}
    rows = [(0, k, w, n) for n in (1, 7, 8) for k, w in weights.items()]
    frame = spark.createDataFrame(rows, "z int, k string, w double, n long")
    got = {(r.n, r.k): r.quota for r in mixing.apportion(frame, ["n"], ["k"], "w", "n").collect()}
    for n in (1, 7, 8):
        seats = Counter()
        for _ in range(n):
            seats[max(weights, key=lambda k: weights[k] / (2 * seats[k] + 1))] += 1
        assert {k: got[n, k] for k in weights} == {k: seats[k] for k in weights}
