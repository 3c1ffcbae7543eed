"""Manifest, fingerprints and hard negatives against plain Python versions."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from respondex.llm import fingerprint, merkle, negatives

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree int, run string, id int, up int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tampered(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def ladder(digests):
    out = [digests]
    while len(out[-1]) > 1:
        below = out[-1]
        out.append([sha("".join(below[i : i + 16])) for i in range(0, len(below), 16)])
    return out


def plain_proofs(rows):
    def order(r):
        return r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])

    def source(r):
        return r["source"] is not None, (r["source"] or "").encode()

    trees = []
    for _, group in groupby(sorted(rows, key=source), key=source):
        group = sorted(group, key=order)
        trees.append((group, ladder([leaf(r, r["text"]) for r in group])))
    top = ladder([levels[-1][0] for _, levels in trees])
    for number, (group, levels) in enumerate(trees):
        for i, r in enumerate(group):
            text = r["text"].translate(LOWER) if r["text"] and tampered(r["doc_id"]) else r["text"]
            held, proof = leaf(r, text), ""
            for tree, place in ((levels, i), (top, number)):
                for level in tree[:-1]:
                    start = place // 16 * 16
                    run, at = level[start : start + 16], place % 16
                    proof += "".join(run[:at] + run[at + 1 :])
                    held = sha("".join([*run[:at], held, *run[at + 1 :]]))
                    place //= 16
            root = top[-1][0]
            yield r["doc_id"], levels[0][i], levels[-1][0], root, sha(proof), held, held == root


def documents(sizes, seed=3):
    rng = random.Random(seed)
    rows = []
    for source, n in sizes.items():
        for _ in range(n):
            text = rng.choice(["Abc", "abc", "", None, "é漢 Wort\n", "X" * 5000])
            lang = rng.choice(["en", None, ""])
            rows.append((len(rows) + 10**6 * rng.randrange(2), text, lang, source, rng.choice([None, 3]), 1, "r", 2, 3))
    rows += [(None, "Null id", "en", "many", 7, 1, "r", 2, 3), (4, "A", None, "many", 1, 1, "r", 2, 3)] * 2
    return rows


def as_dicts(rows):
    names = [c.split()[0] for c in DOCS.split(", ")]
    return [dict(zip(names, r)) for r in rows]


@pytest.mark.parametrize(
    ("sizes", "climbers"),
    [
        ({"many": 300, None: 17, "": 16, "Z": 1, "z": 2, "é": 33} | {f"s{i}": 1 for i in range(20)}, 4096),
        ({"many": 600}, 2),
    ],
)
def test_manifest(spark, monkeypatch, sizes, climbers):
    monkeypatch.setattr(merkle, "CLIMBERS", climbers)
    rows = documents(sizes)
    frame = spark.createDataFrame(rows, DOCS).repartition(5)
    changed = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    got = Counter(tuple(r) for r in merkle.proofs(frame, tampered=changed).collect())
    assert got == Counter(plain_proofs(as_dicts(rows)))
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_little(spark):
    frame = spark.createDataFrame([], DOCS)
    assert merkle.proofs(frame).count() == 0
    one = spark.createDataFrame([(5, "T", "en", "s", 1, 1, "r", 2, 3)], DOCS)
    got = merkle.proofs(one).first()
    assert got.leaf == got.subroot == got.root == got.folded_root and got.proof_sha256 == sha("")
    assert got.verified
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") != "-1"


def test_a_node_serves_a_bounded_number_of_climbers(spark, monkeypatch):
    monkeypatch.setattr(merkle, "CLIMBERS", 4)
    rows = [(i, "t", "en", "hot" if i % 3 else "cold", 1, 1, "r", 2, 3) for i in range(3000)]
    manifest = merkle.manifest_of(spark.createDataFrame(rows, DOCS))
    nodes = manifest.nodes.select("weight", F.ceil(F.col("weight") / merkle.CLIMBERS).alias("parts"))
    assert nodes.agg(F.max("weight")).first()[0] == 125 + 63
    assert nodes.where(F.col("weight") > 4 * F.col("parts")).isEmpty()


def likeness(a, b):
    a, b = Counter(WORD.findall(a or "")), Counter(WORD.findall(b or ""))
    both = (a | b).total()
    return (a & b).total() / both if both else 1.0


def plain_neighbours(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for (i, text), (_, following) in zip(ordered, [*ordered[1:], ordered[0]]):
        text, following = text or "", following or ""
        third = len(text) // 3
        yield i, text, text[: len(text) - third] + following[:third], following


def prose(seed, n):
    rng = random.Random(seed)
    rows = [(3, None), (8, ""), (10, " \n"), (15, "é"), (16, "\U0001f600 a " * 7)]
    words = [f"w{i}" for i in range(300)]
    while len(rows) < n:
        copied = rng.random() < 0.3
        text = rng.choice(rows)[1] if copied else " ".join(rng.choices(words, k=rng.choice([1, 20, 200])))
        rows.append((20 + 7 * len(rows), text))
    return rows


@pytest.mark.parametrize("range_rows", [4, 256])
def test_fingerprints(spark, range_rows):
    rows = prose(4, 120)
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, id int, next string, range string")
    got = {r.doc_id: r for r in fingerprint.compare_neighbours(frame.repartition(3), range_rows=range_rows).collect()}
    assert len(got) == len(rows)
    prints, errors = {}, []
    for i, text, edited, following in plain_neighbours(rows):
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == sha(edited)
        assert prints.setdefault(text if WORD.search(text) else "", r.fingerprint) == r.fingerprint
        assert prints.setdefault(edited if WORD.search(edited) else "", r.edited_fingerprint) == r.edited_fingerprint
        errors += [r.near_edited - likeness(text, edited), r.near_next - likeness(text, following)]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert r.near_edited == 1 or likeness(text, edited) < 1
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.09


def test_fingerprints_run_no_python(spark):
    rows = spark.createDataFrame(prose(4, 20), "id long, text string")
    placed = fingerprint._with_next(rows, 8)
    words = placed.select("range", "place", F.explode(F.split("text", " ")).alias("w")).groupBy("range", "place", F.xxhash64("w").alias("word")).agg(F.count("*").alias("n"))
    plan = fingerprint.samples_of(words, ["range", "place"], ["n"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    # One exchange of the texts; what follows stays in their ranges.
    assert plan.count("Exchange hashpartitioning(range") == 1 == plan.count("Exchange")


def test_fingerprints_of_odd_rows(spark):
    schema = "doc_id long, text string"
    assert fingerprint.compare_neighbours(spark.createDataFrame([], schema)).count() == 0
    one = fingerprint.compare_neighbours(spark.createDataFrame([(1, "abcdef")], schema)).collect()
    assert [(r.n_chars, r.edited_sha256) for r in one] == [(6, sha("abcdab"))]
    rows = [(None, "null id"), (None, None), (7, "same text"), (7, "same text"), (7, "other"), (9, "long " * 200_000)]
    got = fingerprint.compare_neighbours(spark.createDataFrame(rows, schema)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    same = [r.fingerprint for r in got if r.n_chars == 9]
    assert len(same) == 2 and same[0] == same[1]
    assert [r.near_edited for r in got if r.n_chars == 0] == [1.0]
    assert [r.n_chars for r in got if r.doc_id == 9] == [1_000_000]


def test_samples_meet_as_often_as_weights_are_alike(spark):
    # Weights that are no whole numbers, and hundreds of samples.
    weights = {i: (0.3 + i % 7, 0.1 + (i * i) % 5 * (i % 3 > 0)) for i in range(60)}
    rows = [(k, k * 7919, *w) for k, w in weights.items()]
    words = spark.createDataFrame(rows, "k int, word long, a double, b double").withColumn("doc", F.lit(1))
    found = fingerprint.samples_of(words, ["doc"], ["a", "b"], rounds=120, width=8)
    share = found.select(fingerprint.likeness(F.col("fingerprint_0"), F.col("fingerprint_1"), 960)).first()[0]
    want = sum(min(w) for w in weights.values()) / sum(max(w) for w in weights.values())
    assert abs(share - want) < 0.06


@pytest.mark.parametrize("bound", [1, 70_000, 2**40, negatives.MOST])
def test_scores_are_exact(bound):
    rng = np.random.default_rng(2)
    primes = negatives.primes_for(bound)
    assert np.prod([float(p) for p in primes]) > 2 * bound
    for width in (1, 64, 200):
        size = int((bound / width) ** 0.5)
        a = rng.integers(-size, size + 1, (30, width))
        b = np.vstack([rng.integers(-size, size + 1, (20, width)), a[:3], -a[:3]])
        left, right = ([negatives.residues(x, p) for p in primes] for x in (a, b))
        want = np.array([[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a])
        assert (negatives.scores(left, right, primes) == want).all()


def mined(rows):
    """The contract, row by row. Rows: vec_id, vector, label."""
    good = []
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            ints = [int(np.floor(256 * float(np.float32(x)))) for x in v]
            if sum(x * x for x in ints) <= negatives.MOST:
                good.append((i, ints, label))
    last = float("inf")
    out = []
    for a, (i, v, label) in enumerate(good):
        if i is None or i % 10:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), j, m) for b, (j, w, m) in enumerate(good) if b != a and len(w) == len(v)]
        scored.sort(key=lambda s: (-s[0], last if s[1] is None else s[1]))
        for score, j, _ in [s for s in scored if s[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and 80 * score <= 100 * s[0] <= 100 * score][:5]
            out += [(i, j, k + 1, s[1], score, s[0]) for k, s in enumerate(fits)]
    return Counter(out)


def vectors(seed, n=300, width=6):
    rng = np.random.default_rng(seed)
    rows = [
        (None, [0.5] * width, 1), (2, None, 1), (4, [None] + [0.1] * (width - 1), 1), (6, [float("nan")] * width, 1),
        (8, [float("-inf")] * width, 2), (10, [0.5] * width, None), (12, [3e38] * width, 1), (20, [], 1), (22, [], 2),
        (30, [0.0] * width, 1), (32, [0.0] * width, 2), (40, [0.5, 0.25], 0), (41, [0.5, 0.25], 0), (42, [0.5, 0.24], 1),
        (50, [1000.0] * width, 1), (51, [1000.0] * width, 1), (52, [900.0] * width, 2),
    ]
    centres = rng.normal(size=(4, width))
    for i in range(n):
        v = centres[rng.integers(4)] + 0.3 * rng.normal(size=width)
        rows.append((60 + i, np.round(v, 1).tolist(), int(rng.integers(3)) if rng.random() < 0.6 else 0))
    return rows + rows[-40:-30]


@pytest.mark.parametrize(("row_block", "anchor_block"), [(8192, 1024), (37, 5)])
def test_hard_negatives(spark, row_block, anchor_block):
    rows = vectors(3)
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<float>, label int, uid int, i string, chosen int")
    got = negatives.mine(frame.repartition(3), F.col("vec_id") % 10 == 0, row_block=row_block, anchor_block=anchor_block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = Counter(tuple(r) for r in got.collect())
    # Equal scores of rows that share an id are alike; which of them comes is open.
    assert found == mined(rows) and found.total() > 200


def test_hard_negatives_of_little(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert negatives.mine(spark.createDataFrame([], schema), F.col("vec_id") % 10 == 0).count() == 0
    alone = spark.createDataFrame([(10, [1.0], 1), (11, [1.0], 2)], schema)
    assert negatives.mine(alone, F.col("vec_id") % 10 == 0).count() == 0
    three = spark.createDataFrame([(10, [1.0], 1), (11, [1.0], 1), (12, [0.9], 2)], schema)
    got = [tuple(r) for r in negatives.mine(three, F.col("vec_id") % 10 == 0).collect()]
    assert got == [(10, 11, 1, 12, 256 * 256, 230 * 256)]
