"""Operator 12 against all pairs."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cellweave.llm import ngram_join
from corpora import corpus, lower, words


def shingles(text, k=5):
    w = words(lower(text))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def plain(rows, percent=80):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            root[find(j)] = find(i)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[find(i)] += [r[0]] if r[0] is not None else []
    return sorted((str(r[0]), len(sets[i]), min(ids[find(i)], default=None)) for i, r in enumerate(rows))


def result(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in df.collect())


LIMITS = {"CHUNK_GRAMS": 300, "LISTED": 40, "HOT_GROUP": 3, "BROADCAST_ROWS": 0, "BLOCK_ROWS": 4, "BLOCK_GRAMS": 200, "FRAGMENT": 64, "SEEN": 2}


@pytest.fixture(params=["usual", "small"])
def limits(request, monkeypatch):
    if request.param == "small":
        for name, value in LIMITS.items():
            monkeypatch.setattr(ngram_join, name, value)


def near_copies(seed=1, groups=6, each=14):
    """Groups of copies with more and more changes, so that links form chains; a passage in many; short texts."""
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    passage, rows = fresh(30), []
    for _ in range(groups):
        text = fresh(rng.choice([6, 20, 80, 200])) + passage * rng.randint(0, 1) + fresh(rng.choice([3, 40]))
        for _ in range(each):
            text = list(text)
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(text))
                text[at : at + rng.randint(0, 1)] = fresh(1)
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + i, " ".join(fresh(10) + passage + fresh(10))) for i in range(20)]
    rows += [(len(rows) + i, t) for i, t in enumerate(["a b c", "A  b\tc", "a b", "a b c d e f", "a b c d e f g", "a b c d e f a b c d e f", "", None])]
    return rows


def test_join(spark, docs, empty, limits):
    rows = [r for r in corpus()]
    assert result(ngram_join.jaccard_components(docs)) == plain(rows)
    assert ngram_join.jaccard_components(empty).count() == 0


def test_near_copies(spark, limits):
    rows = near_copies()
    assert result(ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == plain(rows)


def test_threshold_is_met_exactly(spark):
    """Overlaps of exactly 80 % of the union, and one n-gram less."""
    line = [f"x{i}" for i in range(200)]
    rows = [(0, " ".join(line[:94])), (1, " ".join(line[10:104])), (2, " ".join(line[11:105])), (3, " ".join(line[:40])), (4, " ".join([*line[:36], "y"]))]
    assert ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).count() == 5
    assert result(ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)
    assert plain(rows[:2])[1][2] == 0 and plain([rows[0], rows[2]])[1][2] == 2


def test_sketches_and_prefixes_lose_no_link():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        pool = np.unique(rng.integers(0, 1 << 64, 2 * n + 10, np.uint64))
        a = np.sort(rng.permutation(pool)[:n])
        b = np.unique(np.concatenate([rng.permutation(a)[: max(1, int(n * rng.uniform(0.75, 1)))], rng.permutation(pool)[: int(rng.integers(0, n // 4 + 1))]]))
        both = len(np.intersect1d(a, b))
        linked = 100 * both >= 80 * (len(a) + len(b) - both)
        pick = rng.permutation(pool)[: n // 2]
        order = ngram_join.Order(np.sort(pick), rng.integers(2, 9, len(pick)).astype(np.int32))
        met = bool(len(np.intersect1d(order.prefix(a, 80), order.prefix(b, 80))))
        near = len(ngram_join._candidates([ngram_join.sketch(x) for x in (a, b)], np.array([len(a), len(b)]), 80)[0]) > 0
        assert not linked or (met and near)


def test_overlaps(monkeypatch):
    monkeypatch.setattr(ngram_join, "FRAGMENT", 64)
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 300, int(rng.integers(0, 200)), np.uint64)) for _ in range(30)]
    want = np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])
    assert (ngram_join.overlaps(sets[:12], sets[12:]) == want[:12, 12:]).all()
    off = ~np.eye(30, dtype=bool)
    assert (ngram_join.overlaps(sets)[off] == want[off]).all()


def test_sets():
    texts = [r[1] for r in corpus()]
    got = ngram_join.gram_sets(pa.array(texts))
    assert [len(g) for g in got] == [len(shingles(t)) for t in texts]
    assert ngram_join.set_name(got[0]) == ngram_join.set_name(got[5]) != ngram_join.set_name(got[1])
    assert [ngram_join.prefix_size(n) for n in (1, 4, 5, 6, 10, 100)] == [1, 1, 2, 2, 3, 21]
