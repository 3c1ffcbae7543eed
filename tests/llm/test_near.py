"""Line dedup, MinHash, vectors and components against brute force over all pairs."""

import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from respondex.llm import hashing, line_dedup, minhash, vector_dedup
from respondex.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def groups(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def varied(rng, words, share):
    return [f"n{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def text_family(seed, n=160):
    """Unrelated texts, copies with few and many changes, chains and repeated windows."""
    rng = random.Random(seed)
    texts = [None, "", " \n ", "one two", "one two", "one  two\n", "one two three four five"]
    while len(texts) < n:
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 30, 120]))]
        if rng.random() < 0.2:
            base = base[:6] * 9
        texts.append(" ".join(base))
        for _ in range(rng.randrange(8)):
            base = varied(rng, base, rng.choice([0.0, 0.005, 0.02, 0.05]))
            texts.append(" ".join(base))
    rng.shuffle(texts)
    return texts[:n]


def bag(text):
    words = WORD.findall(text or "")
    if not words:
        return Counter()
    return Counter([tuple(words[i : i + 5]) for i in range(len(words) - 4)] or [tuple(words)])


def bag_links(texts, least=0.8):
    bags = [bag(t) for t in texts]
    for i in range(len(bags)):
        for j in range(i):
            common = (bags[i] & bags[j]).total()
            if bags[i] and common >= least * (bags[i].total() + bags[j].total() - common):
                yield i, j


@pytest.mark.parametrize("bands", [(32, 4), (4, 2)])
def test_near_duplicates(spark, bands):
    texts = text_family(1)
    rows = [(i, t, "x", "y", 0) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, key string, hash string, n int")
    got = {r.doc_id: r for r in minhash.near_duplicates(frame.repartition(5), bands=bands[0], rows=bands[1]).collect()}
    want = groups(len(texts), bag_links(texts))
    assert len(got) == len(texts)
    assert {i: r.n_shingles for i, r in got.items()} == {i: bag(t).total() for i, t in enumerate(texts)}
    # Few bands of few rows make many chance meetings, and lose some links.
    if bands == (32, 4):
        assert [got[i].class_id for i in range(len(texts))] == want
    else:
        assert all(want[got[i].class_id] == want[i] for i in range(len(texts)))
    assert all(got[i].kept == (got[i].class_id == i) for i in got)
    if bands == (32, 4):
        left = minhash.one_of_each(frame)
        assert left.columns == frame.columns
        assert sorted(r.doc_id for r in left.collect()) == sorted(set(want))


def test_near_duplicates_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, None), (1, ""), (None, None), (7, long), (6, long + " x"), (3, "other words")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(frame).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), str(r.class_id), r.kept) for r in got) == sorted(
        [("None", "3", False), ("3", "3", True), ("3", "3", True), ("2", "2", True), ("1", "1", True), ("None", "None", True), ("7", "6", False), ("6", "6", True), ("3", "3", True)]
    )
    assert minhash.one_of_each(frame).count() == 7
    assert minhash.near_duplicates(frame.where("false")).count() == 0


def test_one_row_of_each_class_whatever_the_ids(spark):
    import corpus_pipeline

    long = " ".join(f"w{i}" for i in range(100))
    rows = [(3, "a b c d e f", 1), (3, "a b c d e f", 2), (3, "a b c d e f", 3), (None, "a b c d e f", 4), (None, long, 5), (None, long + " x", 6),
            (None, long, 7), (8, "other words", 8), (8, "more of others", 9), (None, None, 10), (None, "", 11), (1, " ", 12), (1, " ", 13)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(4)
    for left in (minhash.one_of_each(frame, single=True), corpus_pipeline.near_copies(spark, frame, "")):
        assert left.columns == frame.columns
        got = sorted(r.n for r in left.collect())
        assert got[-6:] == [8, 9, 10, 11, 12, 13] and len(got) == 8
        assert got[0] in (1, 2, 3) and got[1] in (5, 6, 7)
    kept = minhash.near_duplicates(frame, single=True).where("kept").collect()
    want = Counter({(3, 3): 1, (None, None): 3, (8, 8): 2, (1, 1): 2})
    assert Counter((r.doc_id, r.class_id) for r in kept) == want
    assert len({r.row for r in minhash.near_duplicates(frame, single=True).collect()}) == len(rows)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(3)
    shingle = hashing.mix(np.arange(300, dtype=np.uint64))
    a, b = rng.integers(0, 6, 300), rng.integers(0, 6, 300)
    b[:200] = a[:200]
    text = np.concatenate([np.zeros(np.count_nonzero(a), int), np.ones(np.count_nonzero(b), int)])
    values = np.concatenate([shingle[a > 0], shingle[b > 0]])
    weight = np.concatenate([a[a > 0], b[b > 0]])
    out = minhash.signatures(3, text, values, weight, 4096)
    assert np.isinf(out[2]).all() and np.isfinite(out[:2]).all()
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((out[0] == out[1]).mean() - truth) < 4 * (truth * (1 - truth) / 4096) ** 0.5


def test_words_by_eights_tell_words_apart():
    rng = random.Random(4)
    texts = ["", " \n", "a", "b a", "x" * 8, "x" * 9, "x" * 64, "x" * 65, "x" * 3000, "é ü\tß", "tail"]
    texts += [" ".join("ab"[rng.randrange(2)] * rng.randrange(1, 80) for _ in range(9)) for _ in range(60)]
    offsets, data = hashing.offsets_of(pa.array(texts))
    hashes, bounds = hashing.words_by_eights(offsets, data)
    words = [w for t in texts for w in WORD.findall(t)]
    assert list(np.diff(bounds)) == [len(WORD.findall(t)) for t in texts]
    assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))
    alone, _ = hashing.words_by_eights(*hashing.offsets_of(pa.array(words)))
    assert (alone == hashes).all()
    assert not len(hashing.words_by_eights(*hashing.offsets_of(pa.array([], pa.string())))[0])


def test_word_hashes_see_words_only():
    texts = pa.array(["a bc", None, "", " a\t\nbc ", "ab c", "a bc\x00"])
    words, bounds = hashing.words_of(*hashing.offsets_of(texts[0:]))
    assert np.diff(bounds).tolist() == [2, 0, 0, 2, 2, 2]
    assert words[:2].tolist() == words[2:4].tolist() != words[4:6].tolist()
    sliced, _ = hashing.words_of(*hashing.offsets_of(texts[3:5]))
    assert sliced.tolist() == words[2:6].tolist()


def plain_lines(rows, threshold=0.8):
    """Texts after dedup, for rows in order of (id, ...)."""
    seen, out = [], []
    for text in rows:
        kept = []
        for line in (text or "").split("\n"):
            words = frozenset(WORD.findall(line))
            hit = any(len(words & x) >= threshold * len(words | x) - 1e-9 for x in seen)
            if words:
                seen.append(words)
            if not (words and hit):
                kept.append(line)
        out.append(None if text is None else "\n".join(kept))
    return out


def test_copies_of_two_near_texts_are_compared_once(spark):
    words = [f"w{i}" for i in range(300)]
    near = " ".join([*words[:299], "other"])
    rows = [(7, " ".join(words))] * 3000 + [(8, near)] * 3000
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    started = time.perf_counter()
    got = minhash.near_duplicates(frame, single=True).collect()
    assert {r.class_id for r in got} == {7} and sum(r.kept for r in got) == 1
    assert time.perf_counter() - started < 100
    assert minhash.one_of_each(frame, single=True).count() == 1


@pytest.mark.parametrize("single", [True, False])
def test_any_column_names_and_repeated_rows(spark, single):
    text = " ".join(f"w{i}" for i in range(30))
    schema = "doc_id long, text string, _id int, _hash string, _near_row string, _row int, row int, hash string, _n string, _text int"
    rest = (5, "h", "n", 6, 7, "g", "m", 8)
    rows = [(2, text, *rest), (3, text, *rest), (2, text, *rest), (None, None, *rest), (9, "alone here", *rest)]
    frame = spark.createDataFrame(rows, schema)
    left = minhash.one_of_each(frame, single=single)
    assert left.columns == frame.columns
    want = [rows[0], rows[3], rows[4]] + ([] if single else [rows[2]])
    assert Counter(map(tuple, left.collect())) == Counter(want)


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.9, 1.0])
def test_line_dedup_at_other_thresholds(spark, threshold):
    rng = random.Random(8)
    lines = ["a b", "a b c", "x", "x y", "p q r", "p q s", "k l m n", "n m l k", "a b c d"]
    lines += [" ".join(rng.sample("abcdefghij", rng.randrange(1, 8))) for _ in range(120)]
    texts = ["\n".join(lines[i : i + 3]) for i in range(0, len(lines), 3)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r._row.doc_id: r.text for r in line_dedup.dedup_lines(frame, threshold=threshold).collect()}
    assert [got[i] for i in range(len(texts))] == plain_lines(texts, threshold)


def test_a_text_of_many_equal_lines(spark):
    text = "\n".join(["the same words once more"] * 300_000 + ["and an end"])
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    started = time.perf_counter()
    row = line_dedup.dedup_lines(frame).first()
    assert row.text == "the same words once more\nand an end" and row.n_removed == 299_999
    assert time.perf_counter() - started < 60


@pytest.mark.parametrize(("offers", "word_sets"), [(3, 1 << 16), (1, 8)])
def test_line_dedup(spark, monkeypatch, offers, word_sets):
    monkeypatch.setattr(line_dedup, "OFFERS", offers)
    monkeypatch.setattr(line_dedup, "WORD_SETS", word_sets)
    rng = random.Random(5)
    lines = [t or "" for t in text_family(2, 220)] + ["a b c d e"] * 9 + ["a b c d", "a b c d e f", "e d c b a"]
    lines += [" ".join(varied(rng, [f"v{i}" for i in range(40)], s)) for s in [0.03, 0.08, 0.12] * 20]
    rng.shuffle(lines)
    texts = [None, "", "\n\n"]
    while lines:
        texts.append("\n".join(lines.pop() for _ in range(min(len(lines), rng.randrange(1, 6)))))
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lines string, n_chars long")
    got = {r._row.doc_id: r for r in line_dedup.dedup_lines(frame.repartition(4)).collect()}
    want = plain_lines(texts)
    assert [got[i].text for i in range(len(texts))] == want
    for i, text in enumerate(texts):
        n = 0 if text is None else text.count("\n") + 1
        assert got[i].n_lines == n
        assert got[i].n_removed == n - (0 if text is None else len(want[i].split("\n"))) or want[i] == ""
    left = {r.doc_id: r for r in line_dedup.deduplicated(frame).collect()}
    gone = {i for i, t in enumerate(texts) if WORD.search(t or "") and not WORD.search(want[i])}
    assert set(left) == set(range(len(texts))) - gone and gone
    assert all(r.text == want[i] for i, r in left.items())
    assert all(r.n_chars == (len(r.text) if r.text != texts[i] else 1) for i, r in left.items())


def test_line_dedup_of_odd_rows(spark):
    rows = [(None, "same line here\nown"), (2, "same line here"), (1, "same line here\nx"), (1, "same line here\nx"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r._row.doc_id, r.text) for r in line_dedup.dedup_lines(frame).collect()]
    assert Counter(got) == Counter([(None, "same line here\nown"), (2, ""), (1, "x"), (1, "x"), (None, None)])
    assert line_dedup.dedup_lines(frame.where("false")).count() == 0
    long = "\n".join(f"w{i} " * 3 + "end" for i in range(20_000))
    got = line_dedup.dedup_lines(spark.createDataFrame([(1, long), (2, long)], "doc_id long, text string")).collect()
    assert {r._row.doc_id: r.text for r in got} == {1: long, 2: ""}


def vector_rows(seed, n=400, width=12):
    rng = np.random.default_rng(seed)
    out = [(900, None, 1), (901, [], 1), (902, [0.0] * width, 1), (903, [1.0, None] + [0.0] * 10, 1), (904, [float("nan")] * width, 1),
           (905, [float("inf")] + [0.0] * 11, 1), (906, [1.0] * width, None), (907, [1.0] * width, None), (908, [1.0, 0.0], 1), (909, [2.0, 0.1], 1), (910, [3e38] * width, 1), (911, [1e-30] * width, 1)]
    while len(out) < n:
        base = rng.normal(size=width)
        for _ in range(rng.integers(1, 30)):
            base = base + rng.normal(size=width) * rng.choice([0, 0.05, 0.12, 0.2])
            out.append((len(out), base.tolist(), int(rng.integers(0, 3))))
    return out


@pytest.mark.parametrize(("cell_rows", "block"), [(1024, 1024), (20, 16)])
def test_near_vectors(spark, cell_rows, block):
    rows = vector_rows(7)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, node string, n int")
    got = {r.vec_id: r for r in vector_dedup.near_vectors(frame.repartition(4), cell_rows=cell_rows, block=block).collect()}
    links = []
    usable = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    for i in usable:
        for j in usable:
            a, b = np.array(rows[i][1]), np.array(rows[j][1])
            if i != j and rows[i][2] == rows[j][2] and len(a) == len(b):
                a, b = a / abs(a).max(), b / abs(b).max()
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.93:
                    links.append((rows[i][0], rows[j][0]))
    counts = Counter(a for a, _ in links)
    want = groups(1000, links)
    assert len(got) == len(rows) and len(links) > 500
    for i, r in got.items():
        assert (r.n_links, r.component_id, r.kept) == (counts[i], want[i], want[i] == i)


def test_near_vectors_of_little(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_dedup.near_vectors(spark.createDataFrame([], schema)).count() == 0
    rows = [(5, [1.0, 2.0], 1), (5, [1.0, 2.0], 1), (None, [2.0, 4.0], 1), (None, None, None)]
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, schema)).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == Counter(
        [(5, 2, 5, True), (5, 2, 5, True), (None, 2, 5, False), (None, 0, None, True)]
    )


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    hub = [(1000 + i, 500) for i in range(200)]
    rows = random.Random(2).sample(chain + hub, len(chain) + len(hub)) + [(7, 7), (3, 4)]
    got = components(spark.createDataFrame(rows, "a long, b long")).collect()
    assert {r.node: r.label for r in got} == {i: 0 for i in range(61)} | {500: 500} | {1000 + i: 500 for i in range(200)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).agg(F.count("*")).first()[0] == 0


def test_words_are_counted_in_order():
    """The table of counts is larger than a cache; it is not walked at random."""
    rng = np.random.default_rng(2)
    at = rng.integers(0, 50, 1000).astype(np.uint32)
    counts = np.zeros(64, np.uint32)
    line_dedup._add(counts, at[:600])
    line_dedup._add(counts, at[600:])
    line_dedup._add(counts, at[:0])
    assert (counts == np.bincount(at, minlength=64)).all()


def test_lines_of_texts_with_gaps():
    texts = ["", "a\nb", "\n", "", "c", "d\n\n", ""]
    edges, bounds = hashing.lines_of(*hashing.offsets_of(pa.array(texts)))
    data = "".join(texts)
    lines = [data[a:b].rstrip("\n") for a, b in zip(edges, edges[1:])]
    assert [lines[a:b] for a, b in zip(bounds, bounds[1:])] == [t.split("\n") for t in texts]


def test_postings_are_sorted_by_one_number(spark):
    """Spark sorts by the group alone; ids, also null ones, and lines are put in order later."""
    rows = [(7, i, line, k, (5 << 32), 1, 3, True) for i, line, k in [(2, 0, 12), (None, 4, 13), (2, 1, 11), (None, 1, 14)]]
    posts = spark.createDataFrame(
        rows, "word long, id long, line int, k1 long, size long, bits0 long, bits1 long, asks boolean"
    )
    many = spark.createDataFrame([], "hot long, halves long")
    found = line_dedup._offers(posts, many, 0.8, None)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Sort \[group#\d+L ASC NULLS FIRST\], false", plan)
    # In order: 14, 13, 12, 11.
    want = {(13, 14), (12, 13), (12, 14), (11, 12), (11, 13), (11, 14)}
    assert {(r.later, r.earlier) for r in found.collect()} == want


def test_prefixes_are_bytes_and_give_all_postings(spark):
    """A set's words move through Spark as one value; the rare word of a line finds nothing."""
    common = "b c d e f g h i j"
    texts = [(1, f"x {common}\nq"), (2, f"x2 {common}"), (3, f"{common} x x x"), (4, "\n")]
    docs = spark.createDataFrame(texts, "id long, text string").selectExpr("id", "xxhash64(text) AS hash", "text")
    wide = line_dedup._prefixed(docs.coalesce(1), 0.8)
    assert not [c for c, kind in wide.dtypes if kind.startswith("array")]
    sets = wide.selectExpr("struct(id, line) AS first", "k1", "n", "words", "skipped").cache()
    posts = line_dedup._posts(sets).collect()
    places = {}
    for r in posts:
        assert r.size >> 32 == 10 and r.line == 0
        places.setdefault(r.word, set()).add((r.id, r.size & 0xFFFFFFFF))
    # Three words of ten are the prefix; "x2" is in one line, "x" in more than one place.
    assert {i for held in places.values() for i, _ in held} == {1, 2}
    assert sorted(p for held in places.values() for i, p in held if i == 2) == [1, 2]
    assert all(len({r[b] for r in posts if r.id == i}) == 1 for i in (1, 2) for b in line_dedup._BITS)
    asked = line_dedup._key_filter(spark.createDataFrame([(posts[0].word,)], "word long"), "word")
    some = {r.word for r in line_dedup._posts(sets, asked).collect()}
    assert posts[0].word in some and some <= set(places)


def test_white_space_is_compared():
    data = np.arange(256, dtype=np.uint8)
    assert set(np.flatnonzero(~hashing._solid(data))) == {9, 10, 11, 12, 13, 32}
    texts = ["a" * n + " b\n" + "c" * (n + 1) for n in range(70)] + ["", "x" * 200, "x" * 201]
    words, bounds = hashing.words_by_eights(*hashing.offsets_of(pa.array(texts)))
    named = [w for t in texts for w in WORD.findall(t)]
    assert bounds[-1] == len(words) == len(named)
    assert len(set(zip(named, words.tolist()))) == len(set(named)) == len(set(words.tolist()))
