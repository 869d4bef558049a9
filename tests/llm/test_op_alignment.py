"""Operator 13 against plain loops over tokens."""

import hashlib
import itertools
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from cellweave.llm import alignment
from corpora import corpus


@pytest.fixture(scope="module")
def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.DEFAULT_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.DEFAULT_B)


def plain(rows, encoders):
    """(doc_id, text) to the contract's rows, token by token."""
    a_side, b_side = encoders
    letters = {c: b for c, b in alignment.byte_level_alphabet().items()}
    piece = lambda i: bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode()
    split = []
    for _, text in rows:
        groups = []
        if text:
            a = [(i, bytes(letters[c] for c in a_side.id_to_token(i))) for i in a_side.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, piece(i)) for i in b_side.encode(text)]
            if b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
                ends = [list(itertools.accumulate(len(x) for _, x in side)) for side in (a, b)]
                low = 0
                for end in sorted(set(ends[0]) & set(ends[1])):
                    groups.append([[i for (i, _), e in zip(side, own, strict=True) if low < e <= end] for side, own in zip((a, b), ends, strict=True)])
                    low = end
        split.append(groups)
    count = Counter(p for groups in split for p in {(x, y) for a, b in groups for x in a for y in b})
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for (doc_id, _), groups in zip(rows, split, strict=True):
        links = [(x, y) for a, b in groups for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((str(doc_id), sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out)


def result(df):
    return sorted((str(r["doc_id"]), *(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))) for r in df.collect())


@pytest.mark.parametrize("chunk,small,pairs", [(alignment.CHUNK_BYTES, alignment.SMALL_GROUP, alignment.BROADCAST_PAIRS), (2000, 2, 0)])
def test_alignment(spark, docs, empty, encoders, chunk, small, pairs, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(alignment, "SMALL_GROUP", small)
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", pairs)
    added = [(7000, "<|endoftext|> <s> </s> <unk>"), (7001, " leading  spaces and ﬁ ligature 　 wide"), (7002, "▁ ▁▁x"), (7003, "a" * 900 + " " * 700 + "b"), (7004, "café ẛ̣ é"), (7005, "0x0A <0x0A> \r\n\t\x00\x7f")]
    rows = [(r[0], r[1]) for r in corpus() if len(r[1] or "") < 30_000] + added
    frame = docs.where("text IS NULL OR length(text) < 30000").unionByName(spark.createDataFrame(added, "doc_id long, text string"), allowMissingColumns=True)
    assert result(alignment.align(frame)) == plain(rows, encoders)
    assert alignment.align(empty).count() == 0


def test_expanded_links():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 4, 60), rng.integers(0, 5, 80)
    a_start, b_start = np.array([0, 1, 4, 30, 60]), np.array([0, 1, 2, 50, 80])
    want = Counter((g, (int(x) << 32) | int(y)) for g in range(4) for x in a[a_start[g] : a_start[g + 1]] for y in b[b_start[g] : b_start[g + 1]])
    for limit in (0, 20, 10**6):
        alignment.SMALL_GROUP, kept = limit, alignment.SMALL_GROUP
        got = alignment._expand(a, b, a_start, b_start)
        alignment.SMALL_GROUP = kept
        assert Counter({(int(g), int(p)): int(n) for g, p, n in zip(*got, strict=True)}) == want


def test_same_ids_as_the_file(encoders):
    """The merges run elsewhere than in the file's own library: every code point, every entry, and random mixtures."""
    with open(alignment.DEFAULT_A, encoding="utf-8") as file:
        content = file.read()
    side = alignment.byte_level_side(content)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = [f" a{''.join(p + ' 1' + p + p + 'b  ' + p for p in points[i : i + 40])}\n" for i in range(0, len(points), 40)]
    texts += [" " + t.decode("utf-8", "ignore") for t in side.tokens]
    rng = random.Random(4)
    texts += ["".join(rng.choices("ab \n\t'sE1.,é中\U0001f600́", k=60)) for _ in range(2000)] + [" " * 200_000, " x" + "\n" * 5000 + "y"]
    assert side.encode(texts) == [e.ids for e in encoders[0].encode_batch(texts, add_special_tokens=False)]
    other = json.loads(content)
    other["model"]["merges"] = other["model"]["merges"][::-1]
    assert alignment.byte_level_side(json.dumps(other)).encode([" a b"])
