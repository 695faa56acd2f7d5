"""Permutation index, hard negatives and the filter audit against brute force, with their defined cases."""

import re
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import filter_audit, hard_negatives, permutation_index, queries

VECTORS = "vec_id long, embedding array<float>, label int, row string, block string, tile string, score string"

def asks():
    return F.col("vec_id") % 100 == 0


def vectors(spark, rows):
    """Rows (vec_id, vector, label) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "x", "y", "z", "s") for i, v, label in rows], VECTORS)


def odd_vectors():
    rng = np.random.default_rng(5)
    rows = [(i, list(np.float32(rng.normal(size=6))), int(rng.integers(3))) for i in range(90, 330)]
    copy = [0.5, 0.25, 0.0, -0.5, 1.0, 0.125]
    rows += [(1000 + i, copy, i % 2) for i in range(120)]  # a third of all rows are one vector
    rows += [(200, copy, 1), (200, copy, 1), (300, copy[:3], 0)]  # repeated rows, a short vector
    rows += [(400, None, 1), (500, [], 1), (600, [0.0] * 6, 1), (700, [float("nan")] * 6, 1), (800, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (900, [float("inf")] * 6, 0), (None, copy, 1), (1100, copy, None)]
    return rows


def usable(rows, zero):
    for n, (i, v, label) in enumerate(rows):
        if i is not None and v is not None and None not in v and np.isfinite(v).all() and (zero or any(v)):
            yield n, i, np.array([*v, *[0.0] * (6 - len(v))], float), label


def plain_nearest(rows, k):
    them = list(usable(rows, zero=False))
    for n, i, v, _ in them:
        if i % 100 == 0:
            found = sorted((float(np.sqrt(((w - v) ** 2).sum())), j) for m, j, w, _ in them if m != n)[:k]
            yield from ((i, r + 1, j, d) for r, (d, j) in enumerate(found))


def rounded(rows):
    return sorted((*r[:3], round(r[3], 9)) for r in rows)


@pytest.mark.parametrize("share, options", [(1.0, {}), (1.0, {"shard": 40, "tile": 3, "pivots": 20, "places": 5}), (0.1, {"least": 10_000})])
def test_whole_ranking_is_exact(spark, share, options):
    rows = odd_vectors()
    got = permutation_index.nearest(vectors(spark, rows), asks(), share=share, **options)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert rounded(got.collect()) == rounded(plain_nearest(rows, 10))


def test_files_give_the_footrule_distance():
    rng = np.random.default_rng(2)
    pivots, rows, query, k = rng.normal(size=(12, 4)), rng.normal(size=(50, 4)), rng.normal(size=(1, 4)), 5
    near, own = permutation_index.nearest_pivots(rows, pivots, k), permutation_index.nearest_pivots(query, pivots, k)[0]
    by = np.argsort(near.ravel(), kind="stable")
    number, place = np.divmod(by, k)
    got = permutation_index.closeness(own, np.searchsorted(near.ravel()[by], np.arange(13)), number, place, 50)
    at = lambda order, p: list(order).index(p) if p in order else k
    assert [k * (k + 1) - 2 * g for g in got] == [sum(abs(at(own, p) - at(r, p)) for p in range(12)) for r in near]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_against_brute_force(spark, sf):
    """On vectors that spread nearly evenly in 64 dimensions, the hardest case there is."""
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    # the floor of candidates is lowered, else it would be half of the smallest table
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in permutation_index.nearest(table, asks(), least=100).collect()}
    known = {r["vec_id"]: np.array(r["embedding"]) for r in table.collect()}
    ids, every = np.array(list(known)), np.stack(list(known.values()))
    hits = 0
    asked = [i for i in known if i % 100 == 0]
    for i in asked:
        far = np.sqrt(((every - known[i]) ** 2).sum(axis=1))
        first = [j for j in np.lexsort((ids, far)) if ids[j] != i][:10]
        hits += sum((i, ids[j]) in got for j in first)
    assert len(got) == 10 * len(asked) and hits >= 0.9 * len(got)
    assert all(abs(score - np.sqrt(((known[i] - known[j]) ** 2).sum())) < 1e-12 for (i, j), score in got.items())


def test_few_rows_and_none(spark):
    few = vectors(spark, [(0, [1.0, 0.0], 0), (5, [0.0, 2.0], 1)])
    assert [tuple(r) for r in permutation_index.nearest(few, asks()).collect()] == [(0, 1, 5, 5**0.5)]
    assert permutation_index.nearest(few.limit(0), asks()).count() == hard_negatives.mine(few.limit(0), asks()).count() == 0
    assert permutation_index.nearest(few.filter("vec_id = 5"), asks()).count() == hard_negatives.mine(few.filter("vec_id = 5"), asks()).count() == 0
    assert permutation_index.nearest(few.filter("vec_id = 0"), asks()).count() == hard_negatives.mine(few.filter("vec_id = 0"), asks()).count() == 0


def plain_negatives(rows):
    them = [(n, i, [int(np.floor(256 * float(np.float32(x)))) for x in v], label) for n, i, v, label in usable(rows, zero=True) if label is not None]
    for n, i, v, label in them:
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for m, j, w, other in them if m != n)
            for p, q, _ in [x for x in scored if x[2] == label][:5]:
                found = [(j, -s) for s, j, other in scored if other != label and 30 * -p <= 100 * -s <= 90 * -p][:10]
                yield from ((i, q, r + 1, j, -p, s) for r, (j, s) in enumerate(found))


@pytest.mark.parametrize("options", [{}, {"block": 30, "tile": 2}])
def test_negatives_by_brute_force(spark, options):
    rows = odd_vectors()
    got = hard_negatives.mine(vectors(spark, rows), asks(), **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == sorted(plain_negatives(rows))


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, list(np.float32(rng.normal(size=6) * 4e4)), i % 3) for i in range(0, 1500, 10)]
    assert sorted(map(tuple, hard_negatives.mine(vectors(spark, rows), asks()).collect())) == sorted(plain_negatives(rows))
    with pytest.raises(ValueError, match="fit a long"):
        hard_negatives.mine(vectors(spark, [(0, [1e30], 0), (1, [1.0], 0)]), asks())


@pytest.mark.parametrize("kind", [np.float32, np.float64, np.int64])
def test_intervals_drop_nothing_that_counts(kind, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SPARSE", 0.5)
    rng = np.random.default_rng(9)
    numbers, anchors = rng.integers(-40, 60, size=(300, 10)), rng.integers(-40, 60, size=(4, 10))
    planes = hard_negatives.Planes(hard_negatives.Planes.pack(numbers, -40, 7), 300, 10, -40, 7)
    lower, upper = np.array([[-2000, 100]] * 4), np.array([[900, 5000]] * 4)
    scores = anchors @ numbers.T
    a, r, s = hard_negatives.in_windows(anchors.astype(kind), planes, slice(0, 300), np.ones((4, 300), bool), lower.astype(kind), upper.astype(kind), 7)
    assert (scores[a, r] == s).all() and len(a) < 300
    for x in range(4):
        for w in range(2):
            inside = lambda y: lower[x, w] <= y <= upper[x, w]
            assert sorted((y for y in s[a == x] if inside(y)), reverse=True)[:7] == sorted((y for y in scores[x] if inside(y)), reverse=True)[:7]


WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = " ".join(f"word{i}" for i in range(250))
DOCS = "doc_id long, text string, source string, words string, signature string, mask string, part string, class string"


def plain_audit(rows, labels):
    good, toxic = ({i for i, *marks in labels if marks[k] == 1 and i is not None} for k in (0, 1))
    parts = {}
    for i, text, source in rows:
        text = text or ""
        words = WORDS.findall(text)
        fails = [
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), any(c in "#$%&*|" for c in text),
            i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows),
        ]
        parts.setdefault(source or "", []).append((i, {x for x, f in zip("ABCDE", fails) if f}))
    for part, docs in parts.items():
        shapley, out = dict.fromkeys("ABCDE", 0), []
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                shapley[x] += len(gone)
                redundant = sum(x in f for _, f in docs) - len(gone)
                out.append((x, (part, order, step, len(left), len(gone), redundant, sum(f == {x} for _, f in docs), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))))
        yield from ((*row, shapley[x]) for x, row in out)


def test_audit_by_brute_force(spark):
    end = "x" * 5000  # texts that differ in late blocks alone
    texts = ["", None, " ", PROSE, PROSE, PROSE + " #", PROSE.upper(), "same " * 300, "SAME", "same", end + "a", end + "b", end + "a", "😀é" * 100, "😀é" * 100, "tab\tand\x0bbreak\x1fno", "a" * 64, "a" * 64, "a" * 65]
    rows = [(n, t, ("s", "t", None, "")[n % 4]) for n, t in enumerate(texts)]
    rows += [(100 + n, PROSE + " copied", "hot") for n in range(40)] + [(None, PROSE, "s"), (None, "only here", "s"), (3, PROSE, "s"), (3, "another text", "u"), (10, PROSE, "u")]
    labels = [(3, 1, 0), (3, 0, 1), (4, 1, None), (101, 1, 1), (None, 1, 1), (7, None, 1), (999, 1, 1)]
    docs = spark.createDataFrame([(*r, "w", "x", "y", "z", "c") for r in rows], DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(filter_audit.masked(docs), marks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == sorted(plain_audit(rows, labels))
    assert filter_audit.audit(filter_audit.masked(docs.limit(0)), marks).count() == 0
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR); CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    assert sorted(con.execute(queries.oracle_sql()["op13_filter_audit"]).fetchall()) == sorted(plain_audit(rows, labels))


def test_colliding_hashes_are_settled_by_texts(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "block_hashes", lambda text: F.array(F.lit(1).cast("long")))
    docs = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "ab"), (4, "ab"), (5, "efg")], "doc_id long, text string")
    signed = docs.select("doc_id", filter_audit.signature(F.col("text")).alias("signature"))
    assert sorted(r["doc_id"] for r in filter_audit.later_copies(docs, signed).collect()) == [3, 4]


@pytest.mark.parametrize("name", ["op11_permutation_search", "op12_hard_negatives"])
def test_queries_by_brute_force(spark, name):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    got = sorted(map(tuple, queries.queries()[name](spark, "/root/testdata/sf0.001").collect()))
    if name.startswith("op11"):
        wanted = {r[:3]: r[3] for r in plain_nearest(rows, 10)}
        assert len(got) == len(wanted) and sum((q, v) in {(a, c) for a, _, c in wanted} for q, _, v, _ in got) >= 0.9 * len(got)
    else:
        moved = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
        assert got == sorted(plain_negatives(moved))
