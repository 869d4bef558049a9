"""Operators 2, 3 and 8 against plain versions."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from cellweave.llm import mixing, simhash, substring
from cellweave.llm.components import components, local_components
from cellweave.llm.words import hash_words
from corpora import corpus, lower, words


def removed(rows, threshold):
    split = [(r[0], words(r[1])) for r in rows]
    seen = Counter(tuple(w[i : i + threshold]) for _, w in split for i in range(len(w) - threshold + 1))
    out = []
    for doc_id, w in split:
        gone = {i + j for i in range(len(w) - threshold + 1) if seen[tuple(w[i : i + threshold])] > 1 for j in range(threshold)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(doc_id), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in df.collect())


@pytest.mark.parametrize("limit", [substring.SHARD_CONTEXTS, 2])
def test_substrings(spark, docs, empty, limit, monkeypatch):
    monkeypatch.setattr(substring, "SHARD_CONTEXTS", limit)  # 2: almost all anchors are dealt out by longer ones
    assert result(substring.dedup_substrings(docs)) == removed(corpus(), 35)
    assert substring.dedup_substrings(empty).count() == 0


def test_substrings_of_few_symbols(spark):
    """Ties between anchors, periods, overlaps and self-repeats."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices("ab", k=rng.randint(0, 60)))) for i in range(60)] + [(100 + i, "x y " * i) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for threshold, anchor in ((10, 3), (8, 8), (6, 1)):
        assert result(substring.dedup_substrings(docs, threshold, anchor)) == removed(rows, threshold)
    with pytest.raises(ValueError):
        substring.dedup_substrings(docs, 3, 4)


@pytest.mark.parametrize("n", [10, 1000, 5000])
def test_common_passage_in_new_surroundings(spark, n):
    """One passage in ``n`` else different documents, some of which share more than the passage."""
    rng = random.Random(n)
    fresh = lambda k: [f"{rng.getrandbits(40):x}" for _ in range(k)]
    passage, tail = fresh(30), fresh(20)
    rows = [(i, " ".join(fresh(20) + passage + (tail[: i % 20] if i % 3 == 0 else []) + fresh(20))) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(substring.dedup_substrings(docs)) == removed(rows, 35)
    # Rows of the steps: a few for each context, whatever the number of contexts.
    texts = [f"{a} {b}" for a, b in zip((r[1] for r in rows), (r[1] for r in rows), strict=True)]
    dealt = sum(b.num_rows for b in substring._deal_out(35, 24)(iter([pa.RecordBatch.from_arrays([pa.array([1] * n), pa.array(range(n)), pa.array([1] * n), pa.array([" ".join(t.split()[:58]).encode() for t in texts])], ["h", "context", "n", "words"])])))
    assert dealt <= 8 * n


def test_words():
    rng = random.Random(6)
    texts = [r[1] for r in corpus()] + ["", None, "é" * 40 + " É", "a" * 33, "A" * 33, " x"] + ["".join(rng.choices(" \t\nabAB\xe9", k=30)) for _ in range(200)]
    column = pa.array(["left out", *texts])[1:]
    for low in (False, True):
        found = hash_words(column, low)
        want = [words(lower(t) if low else t) for t in texts]
        assert found.sizes.tolist() == [len(w) for w in want]
        flat = [x for w in want for x in w]
        assert len(set(zip(flat, found.hashes.tolist(), strict=True))) == len(set(flat)) == len(set(found.hashes.tolist()))
    assert len(hash_words(pa.array([], pa.string())).sizes) == 0


def test_suffix_automaton():
    rng = random.Random(2)
    for _ in range(30):
        texts = ["".join(rng.choices("abc", k=rng.randint(1, 20))) for _ in range(4)]
        automaton = substring.SuffixAutomaton()
        for t in texts:
            automaton.add(t, 1)
        automaton.finish()
        seen = Counter(t[i : i + 3] for t in texts for i in range(len(t) - 2))
        for t in texts:
            assert automaton.repeated(t, 3) == [i for i in range(len(t) - 2) if seen[t[i : i + 3]] > 1]


def fingerprint(text, shingle=3):
    w = words(lower(text))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + shingle]).encode(), 42) for i in range(max(1, len(w) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, radius):
    prints = sorted(prints)
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= radius:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


def test_simhash(spark, docs, empty):
    prints = [fingerprint(r[1]) for r in corpus()]
    root = linked(set(prints), 3)
    least = defaultdict(list)
    for r, p in zip(corpus(), prints, strict=True):
        least[root[p]] += [r[0]] if r[0] is not None else []
    want = sorted((str(r[0]), f"{p:016x}", min(least[root[p]], default=None)) for r, p in zip(corpus(), prints, strict=True))
    got = sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(docs).collect())
    assert got == want
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(min(x) for x in least.values())
    assert simhash.simhash_components(empty).count() == 0 and simhash.keep_one_of_each(empty).count() == 0


@pytest.mark.parametrize("hot,radius", [(simhash.HOT_BUCKET, 3), (16, 3), (16, 1), (64, 6)])
def test_links_are_exact(spark, hot, radius, monkeypatch):
    """Clusters around shared block patterns: hot buckets, split once and again, and many tiles."""
    monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
    monkeypatch.setattr(simhash, "TILE", 8)
    rng = random.Random(hot)
    centres = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    prints = {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (1 << 64) - 1 for c in centres for _ in range(60)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    edges = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"), radius).collect()
    assert all(((e["u"] ^ e["v"]) & (1 << 64) - 1).bit_count() for e in edges)
    ids = sorted(p for (p,) in signed)
    place = {p: i for i, p in enumerate(ids)}
    found = local_components(len(ids), np.array([place[e["u"]] for e in edges], np.int64), np.array([place[e["v"]] for e in edges], np.int64))
    classes = lambda label: {frozenset(k for k in label if label[k] == x) for x in set(label.values())}
    assert classes({p & (1 << 64) - 1: int(f) for p, f in zip(ids, found, strict=True)}) == classes(linked(prints, radius))


def test_buckets_are_bounded(spark, monkeypatch):
    """All fingerprints under one key: buckets end up small, and copies do not grow with their number."""
    monkeypatch.setattr(simhash, "HOT_BUCKET", 16)
    rng = random.Random(9)
    copies = []
    for n in (500, 2000):
        prints = {rng.getrandbits(48) for _ in range(n)}
        found = simhash._buckets(spark.createDataFrame([(p,) for p in prints], "fp long"), 3)
        assert max(r["count"] for r in found.groupBy("mask", "key").count().collect()) <= 16
        copies.append(found.count() / len(prints))
    assert copies[1] < 1.5 * copies[0]


def test_finer_keys_keep_all_links():
    rng = random.Random(10)
    for mask in (0xFFFF, -(1 << 48), 0x0F0F_00FF, (1 << 60) - 1):
        finer = simhash._finer_keys(mask, 3)
        assert all(m != mask and m & mask == mask for m in finer)
        for _ in range(200):
            change = sum(1 << b for b in rng.sample([i for i in range(64) if not mask >> i & 1], 3))
            assert any(not change & m & (1 << 64) - 1 for m in finer)


def test_longer_keys_keep_all_links():
    for distinct in (10, 1 << 30, 1 << 50):
        for mask_set in (simhash._bucket_keys(3, distinct),):
            for bits in itertools.combinations(range(0, 64, 9), 3):
                change = sum(1 << b for b in bits)
                assert any(not change & mask & (1 << 64) - 1 for mask in mask_set)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = sorted({x for e in edges for x in e})
    place = {n: i for i, n in enumerate(nodes)}
    want = local_components(len(nodes), np.array([place[a] for a, _ in edges]), np.array([place[b] for _, b in edges]))
    for n in nodes:
        assert got.get(n, n) == nodes[want[place[n]]]
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        share = (total - sum(out.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 3 * sizes[s]}
        if not over:
            out |= {s: share * weight[s] for s in open_}
            break
        out |= {s: 3 * sizes[s] for s in over}
        open_ -= over
    return out


@pytest.mark.parametrize("fan_in", [mixing.FAN_IN, 3])
def test_mixing(spark, docs, empty, fan_in, monkeypatch):
    monkeypatch.setattr(mixing, "FAN_IN", fan_in)
    rows = mixing.mix_sources(docs).collect()
    want_size = sorted((str(r[0]), len(words(r[1])), str(r[3])) for r in corpus())
    assert sorted((str(r["doc_id"]), r["size"], str(r["source"])) for r in rows) == want_size
    sizes = Counter()
    for r in corpus():
        sizes[r[3]] += len(words(r[1]))
    goal = targets(sizes)
    taken, partial = Counter(), Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
        rate = r["target"] / r["source_size"]
        assert int(rate) * r["size"] <= r["taken"] <= min(3, int(rate) + 1) * r["size"]
        taken[r["source"]] += r["taken"]
        partial[r["source"]] += bool(r["size"] and r["taken"] % r["size"])
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 1 and partial[s] <= 1
    again = mixing.mix_sources(docs.repartition(5)).collect()
    key = lambda x: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in x)
    assert key(rows) == key(again)
    assert mixing.mix_sources(empty).count() == 0


def test_mixing_is_fair(spark):
    """Over many seeds each document is taken about as often as its source's rate says."""
    rng = random.Random(0)
    rows = [(i, " ".join(["w"] * rng.choice([1, 5, 20, 100])), "ab"[i % 2]) for i in range(400)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for name in "ab":
        own = [r for r in got if r["source"] == name]
        rate = own[0]["target"] / own[0]["source_size"]
        by_size = defaultdict(list)
        for r in own:
            by_size[r["size"]].append(r["taken"] / r["size"])
        assert all(abs(sum(x) / len(x) - rate) < 0.25 for x in by_size.values())


def test_mixing_of_one_row_repeated(spark):
    """A million equal rows are numbered in blocks and come out one by one."""
    rows = spark.range(1_000_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'a b c' AS text", "'s' AS source").unionByName(spark.range(1).selectExpr("id AS doc_id", "'x' AS text", "'t' AS source"))
    got = mixing.mix_sources(rows).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in got} == {"s": 1_000_000, "t": 1}
    numbered = mixing._numbered(spark.createDataFrame([(1, 1), (2, 1024), (3, 1025), (4, 5000)], "doc_id long, count long"))
    assert sorted((r["doc_id"], r["copy"]) for r in numbered.collect()) == [(d, i) for d, n in ((1, 1), (2, 1024), (3, 1025), (4, 5000)) for i in range(n)]
