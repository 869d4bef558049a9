"""Operators 6, 7 and 10, and the pipeline."""

import base64
import gzip
import hashlib
import io
import itertools
import json
import math
import os
import random
import re
import subprocess
import sys
import time
import uuid
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from cellweave.llm import html_text, language_model, mixing, warc
from cellweave.llm.words import hash_words
from corpora import corpus, lower, words
from pyspark.sql import functions as F
from test_op_map import kept_rows
from test_op_pairs import fingerprint, linked


def tokens(text):
    return [*words(lower(text)), "\n"]


held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


@pytest.mark.parametrize("classes", [language_model.MAX_CLASSES, 20])
def test_base_scores(spark, docs, empty, classes, monkeypatch):
    monkeypatch.setattr(language_model, "MAX_CLASSES", classes)
    count = Counter(t for r in corpus() if not held(r[0]) for t in tokens(r[1]))
    n, v = sum(count.values()), len(count)
    want = sorted((str(r[0]), held(r[0]), len(tokens(r[1])), sum(count[t] > 0 for t in tokens(r[1])), n, round(sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(r[1])), 5)) for r in corpus())
    rows = language_model.fit_and_score(docs).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in rows) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)
    assert language_model.fit_and_score(empty).count() == 0


def test_layout_is_no_parameter(spark, docs, monkeypatch):
    """Equal scores however the rows are dealt out, with several shards."""
    monkeypatch.setattr(language_model, "SHARD_TOKENS", 9000)
    frame = docs.select("doc_id", "text").cache()
    of = lambda n: sorted((str(r["doc_id"]), r["score"], r["base_score"]) for r in language_model.fit_and_score(frame.repartition(n)).collect())
    one = of(1)
    for n in (4, 16):
        for a, b in zip(one, of(n), strict=True):
            assert a[0] == b[0] and a[1:] == pytest.approx(b[1:], abs=1e-9)


def test_scoring_is_by_row():
    """Log-probabilities are the same to the last bit in batches of any size, far-off scores among them."""
    rng = np.random.default_rng(8)
    model = language_model.Model(np.concatenate(([50.0], np.sort(rng.zipf(1.3, 3000).clip(5, 10**5))[::-1].astype(float))))
    for level, out in enumerate(model.outputs):
        out += rng.normal(0, 0.3, out.shape).astype(np.float32)
        model.biases[level][::97] += 80
    model.finish()
    ids = rng.integers(0, model.classes, 3000).astype(np.int32)
    places = np.arange(2, len(ids))
    whole = model.log_probabilities(ids, places)
    for step in (1, 2, 3, 17, 1000):
        parts = [model.log_probabilities(ids, places[at : at + step]) for at in range(0, len(places) if step > 3 else 300, step)]
        assert (np.concatenate(parts) == whole[: sum(map(len, parts))]).all()


@pytest.mark.parametrize("kernel", ["Haswell", "Zen", "Sandybridge", "Nehalem"])
def test_scoring_is_by_row_with_the_kernels_of_other_cpus(kernel):
    """The same under matrix kernels that another CPU would get; the library reads the name when it is loaded, so in a process of its own."""
    if "avx2" not in Path("/proc/cpuinfo").read_text():
        pytest.skip("this CPU can't run them")
    code = f"import sys; sys.path[:0] = {sys.path!r}; import test_op_models; test_op_models.test_scoring_is_by_row()"
    subprocess.run([sys.executable, "-c", code], env=os.environ | {"OPENBLAS_CORETYPE": kernel}, check=True, timeout=120)


def test_scores_by_plain_loops(spark):
    """The scores of a small corpus by loops over tokens, classes and groups, from the same start."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{k}" for k in np.minimum(rng.zipf(1.4, 60), 90))) for i in range(60)] + [(60, None), (61, "never seen")]
    got = {r["doc_id"]: r["score"] for r in language_model.fit_and_score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    train = [r for r in rows if not held(r[0])]
    count = Counter(t for r in train for t in tokens(r[1]))
    known = sorted((t for t in count if count[t] >= language_model.MODEL_TOKENS), key=lambda t: (-count[t], int(_hash(t))))
    number = {t: i + 1 for i, t in enumerate(known)}
    others = sum(count.values()) - sum(count[t] for t in known) + 0.5 * (len(count) - len(known) + 1)
    frequency = np.array([others, *(count[t] for t in known)])
    plain = _Plain(frequency)
    keys = {r["doc_id"]: r["k"] for r in spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "xxhash64(cast(doc_id as string), text) as k").collect()}
    end = number["\n"]
    ids, targets = [], []
    for r in sorted(train, key=lambda r: keys[r[0]]):
        ids += [end, end, *(number.get(t, 0) for t in tokens(r[1]))]
        targets += [False, False] + [True] * len(tokens(r[1]))
    plain.step(ids, targets)
    for i, text in rows:
        ids = [end, end, *(number.get(t, 0) for t in tokens(text))]
        want = sum(plain.log10(ids[j - 1], ids[j - 2], ids[j]) for j in range(2, len(ids)))
        want += sum(math.log10((count[t] + 0.5) / others) for t in tokens(text) if t not in number)
        assert got[i] == pytest.approx(want, rel=2e-3, abs=0.02)  # parameters travel in half precision


def _hash(token):
    return language_model.END if token == "\n" else hash_words(pa.array([token])).hashes[0]


class _Plain:
    """Noise-contrastive estimation of one batch, token by token."""

    def __init__(self, frequency):
        start = language_model.Model(frequency)
        self.levels, self.upto, self.random = start.levels, start.upto, start.random
        classes = range(len(frequency))
        self.e = [start.input_of(np.array([c]))[0].astype(float) for c in classes]
        self.t = [[start.output_of(k, np.array([g]))[0].astype(float) for g in range(len(level.log_prior))] for k, level in enumerate(self.levels)]
        self.b = [[0.0] * len(level.log_prior) for level in self.levels]
        self.w = [np.ones(language_model.DIMENSIONS) for _ in range(2)]

    def step(self, ids, targets):
        assert len(ids) <= language_model.BATCH + 2
        noise = language_model.NOISE
        events = [(ids[j], ids[j - 1], ids[j - 2]) for j in range(len(ids)) if targets[j]]
        hidden = [self.e[a] * self.w[0] + self.e[b] * self.w[1] for _, a, b in events]
        back = [0 * h for h in hidden]
        steps = []
        for k, level in enumerate(self.levels):
            drawn = np.minimum(np.searchsorted(self.upto[k], self.random.random(noise) * self.upto[k][-1]), len(self.upto[k]) - 1).tolist()
            own, fake = {}, {}
            for i, (c, _, _) in enumerate(events):
                g = int(level.of_class[c])
                p = 1 / (1 + math.exp(hidden[i] @ self.t[k][g] + self.b[k][g] - math.log(noise)))
                own.setdefault(g, []).append((p, hidden[i]))
                back[i] = back[i] + p * self.t[k][g]
                for x in drawn:
                    q = 1 / (1 + math.exp(-(hidden[i] @ self.t[k][x] + self.b[k][x] - math.log(noise))))
                    fake.setdefault(x, []).append((-q, hidden[i]))
                    back[i] = back[i] - q * self.t[k][x]
            squares = {}
            for part in (own, fake):
                for g, terms in part.items():
                    total, bias = sum(p * h for p, h in terms), sum(p for p, _ in terms)
                    st, sb = squares.get(g, (0.0, 0.0))
                    st, sb = st + float(np.mean(total**2)), sb + bias**2
                    squares[g] = st, sb
                    steps.append((k, g, total * language_model.RATE / math.sqrt(language_model.FIRST_SQUARE + st), bias * language_model.RATE / math.sqrt(language_model.FIRST_SQUARE + sb)))
        into = {}
        for i, (_, a, b) in enumerate(events):
            into[a] = into.get(a, 0) + back[i] * self.w[0]
            into[b] = into.get(b, 0) + back[i] * self.w[1]
        rate = language_model.RATE / 10 / len(events)
        change = [rate * sum(back[i] * self.e[ab[which]] for i, (_, *ab) in enumerate(events)) for which in range(2)]
        for c, total in into.items():
            self.e[c] = self.e[c] + total * language_model.RATE / math.sqrt(language_model.FIRST_SQUARE + float(np.mean(total**2)))
        self.w = [w + d for w, d in zip(self.w, change, strict=True)]
        for k, g, t, b in steps:
            self.t[k][g] = self.t[k][g] + t
            self.b[k][g] += b

    def log10(self, before, earlier, c):
        hidden = self.e[before] * self.w[0] + self.e[earlier] * self.w[1]
        out = 0.0
        low, high = 0, len(self.b[0])
        for k, level in enumerate(self.levels):
            g = int(level.of_class[c])
            mass = {x: math.exp(hidden @ self.t[k][x] + self.b[k][x] + level.log_prior[x]) for x in range(low, high)}
            out += math.log10(mass[g] / sum(mass.values()))
            low, high = int(level.begins[g]), int(level.begins[g + 1])
        return out


def test_learns_what_follows_what(spark):
    """On text with an order the model beats token frequencies on held-out documents."""
    rng = np.random.default_rng(0)

    def text():
        out, at = [], int(rng.integers(20))
        for _ in range(200):
            out.append(f"w{at}")
            at = (at * 3 + int(rng.integers(3))) % 20
        return " ".join(out)

    rows = [(i, text()) for i in range(300)]
    out = [r for r in language_model.fit_and_score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["held_out"]]
    size = sum(r["n_tokens"] for r in out)
    assert sum(r["score"] for r in out) / size > sum(r["base_score"] for r in out) / size + 0.15


@pytest.mark.parametrize("k", [1, 2, 7, 3000])
def test_normalised(k):
    model = language_model.Model(1 / np.arange(1, k + 1))
    ids = np.random.default_rng(2).integers(0, k, 20000).astype(np.int32)
    for at in range(0, len(ids), 4000):
        model.train(ids[at : at + 4000], np.arange(4000) > 1)
    model.finish()
    for a, b in ((0, min(1, k - 1)), (k - 1, k // 2)):
        rows = np.column_stack((np.full(k, b), np.full(k, a), np.arange(k))).astype(np.int32).ravel()
        assert np.exp(model.log_probabilities(rows, np.arange(2, 3 * k, 3))).sum() == pytest.approx(1, abs=1e-4)


def test_rare_tokens_have_embeddings(spark):
    """Beyond the thousand most frequent tokens, too, a token is told apart by what comes before it."""
    rng = np.random.default_rng(1)
    train, tested = [i for i in range(1000) if not held(i)][:200], [i for i in range(1000) if held(i)][:80]
    rows = []
    for i in train:
        parts = [f"f{k}" for k in range(1100) for _ in range(2)] + [f"a{k} b{k}" for k in range(40)]
        rows.append((i, " ".join(parts[k] for k in rng.permutation(len(parts)))))
    rows += [(i, f"a{k % 40} b{(k + k // 40) % 40}") for k, i in enumerate(tested)]  # 40 pairs as learnt, 40 others
    score = {r["doc_id"]: r["score"] for r in language_model.fit_and_score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert np.mean([score[i] for i in tested[:40]]) > np.mean([score[i] for i in tested[40:]]) + 0.2


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site name</h1></header><nav><ul><li><a href=/a>Menu</a></li></ul></nav><div id="cookie-notice">We use cookies</div>
<div class="layout sidebar-left"><main><article><h1>Title &amp; more</h1><p>First   paragraph
 with <b>bold</b> and &eacute;&#x41;.<p>Nd.<div class="ad">Buy now</div><p>Last<br>one.</p><form><input>Send</form>
<section id="comments"><article class="comment"><p>A reader's rather long comment, with several words in it, to say nothing.</p></article></section>
<footer>By me</footer></article></main><aside>Related things</aside></div><footer>&copy; me</footer></body></html>"""


def test_html():
    assert html_text.main_text(PAGE) == "Title & more\nFirst paragraph with bold and éA.\nNd.\nLast one."
    plain = "<div><p>" + "word " * 60 + ".</p></div><ul><li><a href=q>Home</a></li><li><a href=z>Next</a></li></ul>"
    assert html_text.main_text(plain) == ("word " * 60 + ".")
    for odd in (None, "", "<", "<p", "<a href='x", "<!-- open", "</p></p>", "<script>x", "&", "<p title=\"a>b\">t"):
        assert isinstance(html_text.main_text(odd), str)
    assert html_text.main_text("<article><p>" + "x" * 2_000_000 + "</article>") == "x" * 2_000_000


def test_minimum_cut_is_minimal():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        scores = rng.normal(0, 1.5, n).round(2).tolist()
        edges = [(int(a), int(b), float(rng.random())) for a, b in rng.integers(0, n, (n, 2)) if a != b]

        def cost(label, scores=scores, edges=edges):
            return sum(-s if keep and s < 0 else s if not keep and s > 0 else 0 for s, keep in zip(scores, label, strict=True)) + sum(w for a, b, w in edges if label[a] != label[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_text.minimum_cut(scores, edges)) == pytest.approx(best)


@pytest.mark.parametrize(
    "page,text",
    [
        ("<html><head><title>T</title><article><p>The head has no end.</p></article>", "The head has no end."),
        ("<article><p>x = <math><mi>a</mi></math> y</p></article>", "x = a y"),
        ('<article><h2 id="search">Search trees</h2><p class="reply-guide">How to reply.</p><div class="article-share-price">Prices rose.</div></article>', "Search trees\nHow to reply.\nPrices rose."),
        ("<article><p data-hidden-x>Seen.</p><p hidden>Not.</p><p title='hidden'>Seen, too.</p></article>", "Seen.\nSeen, too."),
        ("<div><p>Yes.</p><p>No it was not so.</p></div>", "Yes.\nNo it was not so."),
        ('<article><p>Some words.</p><div class="ad-slot">Buy now!</div></article><div>Outside of it</div>', "Some words."),
    ],
)
def test_html_cases(page, text):
    assert html_text.main_text(page) == text


_PROSE = "The file tells crawlers which sellers may offer the space of a site, and machines read it once a day or so, says the guide."


@pytest.mark.parametrize(
    "page,kept",
    [
        (f'<article class="newsletter-guide"><h1>How to</h1><p>{_PROSE}</p></article>', ["How to", _PROSE]),
        (f'<main><div class="ads-txt"><h1>Ads.txt</h1><p>{_PROSE}</p><p>Short one</p></div></main><div class="ads">buy</div>', ["Ads.txt", _PROSE, "Short one"]),
        (f'<article><p>{_PROSE}</p><div class="newsletter-box">Sign up now</div><p>{_PROSE}</p></article>', [_PROSE, _PROSE]),
        (f'<article><p>{_PROSE}</p><div class="related-posts"><a href=x>Another thing</a></div><p>{_PROSE}</p></article>', [_PROSE, _PROSE]),
        (f'<article class="ads"><p>{_PROSE}</p></article><main><p>{_PROSE}</p></main>', [_PROSE]),
    ],
)
def test_names_are_weak_evidence_in_parts(page, kept):
    assert html_text.main_text(page).split("\n") == kept


def test_cut_decides():
    """A paragraph that is one link goes with its neighbours; a list of links does not."""
    prose = "<p>Some text with a number of words in it, that goes on for a while.</p>"
    page = f"<article>{prose}<p><a href=x>A paragraph, one link</a></p>{prose}<ul>{''.join(f'<li><a href={i}>Link {i}</a>' for i in range(5))}</ul></article>"
    blocks = html_text.blocks_of(page)
    labels = html_text.minimum_cut([b.score for b in blocks], html_text.edges_of(blocks))
    assert labels == [True] * 3 + [False] * 5 and blocks[1].score < 0


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x", "<p><b>" * 50_000 + "z", "<td><div>" * 50_000, "<div>" * 50_000 + "</p></span>" * 50_000, "<ul>" + "<div><li>q" * 30_000], ids=range(5))
def test_deep_pages(page):
    """Linear in the length: a hundred thousand open elements are no burden."""
    start = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - start < 10


def plain_text(page):
    """The main text by trying every labelling of each page's blocks."""
    blocks = html_text.blocks_of(page or "")
    edges = html_text.edges_of(blocks)
    cost = lambda keep: sum(abs(b.score) for b, k in zip(blocks, keep, strict=True) if (b.score > 0) != k) + sum(w for i, j, w in edges if keep[i] != keep[j])
    best = min(itertools.product((False, True), repeat=len(blocks)), key=lambda keep: (round(cost(keep), 9), sum(keep)))
    return "\n".join(b.text for b, k in zip(blocks, best, strict=True) if k)


def test_html_rows(spark, tmp_path):
    rng = random.Random(8)
    part = lambda: rng.choice(["<p>{}</p>", "<p><a href=x>{}</a></p>", "<div class=note>{}</div>", "<div class='share ad'>{}</div>", "<li>{}", "<h2>{}</h2>", "{}<br>"]).format(" ".join("ab" * rng.randint(1, 4) for _ in range(rng.randint(1, 25))))
    pages = ["".join(rng.choice(["", "<nav>", "</nav>", "<article>", "</article>", "<div>"]) + part() for _ in range(rng.randint(1, 9))) for _ in range(60)]
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (3, "v", "")] + [(10 + i, "w", p) for i, p in enumerate(pages)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    table.write.parquet(str(tmp_path / "pages.parquet"))
    got = html_text.op7_html_text(spark, str(tmp_path)).collect()
    want = sorted((str(i), str(u), plain_text(p), len(plain_text(p))) for i, u, p in rows)
    assert sorted((str(r["page_id"]), str(r["url"]), r["text"], r["n_chars"]) for r in got) == want
    clash = table.withColumns({"text": table["url"], "_html": table["url"]})
    assert sorted(r["text"] for r in html_text.extract_text(clash).collect()) == sorted(x[2] for x in want)
    with pytest.raises(ValueError):
        html_text.extract_text(clash, keep=("page_id", "text"))
    assert html_text.extract_text(table.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a.example/x y", PAGE), (2, "http://b.example", "<p>é</p>"), (2, "http://b.example", "<p>é</p>"), (None, None, None), (4, "http://c.example", "")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    responses = warc.responses_from_pages(table)
    made = warc.build_derivatives(responses, "page_id")
    rows = made.collect()
    assert Counter(r["warc_type"] for r in rows) == {"metadata": 5, "conversion": 5}
    source = {r["record_id"]: r for r in responses.collect()}
    for r in rows:
        origin = source[r["refers_to"]]
        assert r["target_uri"] == origin["target_uri"] and r["payload_digest"] == origin["payload_digest"] and r["warc_date"] == origin["warc_date"]
        assert r["block_digest"] == warc.digest(bytes(r["block"])) and r["content_length"] == len(r["block"])
    path = str(tmp_path / "out")
    files = warc.write_warc(made.drop("page_id").repartition(3), path).collect()
    assert sum(r["records"] for r in files) == 10 and {p.name for p in (tmp_path / "out").iterdir()} == {r["file"] for r in files}
    back = warc.read_warc(spark, path)
    key = lambda df: sorted((r["record_id"], r["refers_to"], bytes(r["block"]), str(r["headers"])) for r in df.collect())
    assert key(back) == key(made)
    whole = b"".join(gzip.decompress((tmp_path / "out" / r["file"]).read_bytes()) for r in files)
    for data in (whole, gzip.compress(whole)):  # plain, and as one member
        assert sorted(x[1] for x in warc.parse(io.BytesIO(data))) == sorted(bytes(r["block"]) for r in rows)
    for bad in (b"WARC/1.1\r\nContent-Length: 10\r\n\r\nshort", b"not a record\n"):
        with pytest.raises(ValueError):
            list(warc.parse(io.BytesIO(bad)))
    assert list(warc.parse(io.BytesIO(b""))) == []
    assert warc.build_derivatives(made.drop("page_id")).count() == 0
    assert warc.build_derivatives(responses.limit(0)).count() == 0


def test_warc_repeated_headers(spark, tmp_path):
    """Repeated header names of real responses come through into the envelope, each with all its values."""
    block = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nContent-Type: text/html\r\nSet-Cookie: b=2\r\nLink: <x>\r\nLink: <y>\r\nSet-Cookie: a=1\r\n\r\n<p>t</p>"
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x:1>"), ("WARC-Concurrent-To", "<urn:x:2>"), ("WARC-Concurrent-To", "<urn:x:3>"), ("Content-Length", str(len(block)))]
    (tmp_path / "r.warc").write_bytes(warc.serialise(headers, block))
    made = warc.build_derivatives(warc.read_warc(spark, str(tmp_path / "r.warc"))).where("warc_type = 'metadata'").collect()
    envelope = json.loads(bytes(made[0]["block"]))
    assert envelope["HTTP-Response-Metadata"]["Headers"] == {"Set-Cookie": ["a=1", "b=2", "a=1"], "Content-Type": "text/html", "Link": ["<x>", "<y>"]}
    assert envelope["WARC-Header-Metadata"] == {"WARC-Type": "response", "WARC-Record-ID": "<urn:x:1>", "WARC-Concurrent-To": ["<urn:x:2>", "<urn:x:3>"], "Content-Length": str(len(block))}


def test_warc_small_steps(monkeypatch):
    """Records come out whole wherever the reads fall."""
    rng = random.Random(9)
    want = [([("WARC-Type", "response"), ("X", "y" * rng.randint(0, 30)), ("Content-Length", str(n))], rng.randbytes(n)) for n in (0, 1, 50, 700, 3)]
    members = [warc.serialise(*x) for x in want]
    for data in (b"".join(members), b"".join(map(gzip.compress, members)), gzip.compress(b"".join(members))):
        for step in (1, 7, 64, 5000):
            monkeypatch.setattr(warc._Reader, "STEP", step)
            assert list(warc.parse(io.BytesIO(data))) == want


def test_encoded_bodies():
    page = "<title>é</title><p>Text of some length, text of some length.</p>".encode()
    chunked = lambda data: b"".join(b"%x;q\r\n%s\r\n" % (len(data[i : i + 9]), data[i : i + 9]) for i in range(0, len(data), 9)) + b"0\r\n\r\n"
    raw = zlib.compressobj(wbits=-15)
    cases = [
        ([], page, [], None), (["Content-Encoding: gzip"], gzip.compress(page), ["gzip"], None), (["Content-Encoding: deflate"], zlib.compress(page), ["deflate"], None),
        (["Content-Encoding: Deflate"], raw.compress(page) + raw.flush(), ["deflate"], None), (["Transfer-Encoding: chunked"], chunked(page), ["chunked"], None),
        (["Transfer-Encoding: chunked", "Content-Encoding: gzip"], chunked(gzip.compress(page)), ["chunked", "gzip"], None), (["Content-Encoding: br"], b"\x00\x01", [], "br"),
        (["Content-Encoding: gzip"], gzip.compress(page[:9]) + gzip.compress(page[9:20]) + gzip.compress(page[20:]), ["gzip"], None), (["Content-Encoding: gzip"], gzip.compress(page) + b"junk", ["gzip"], None),
        (["Content-Encoding: gzip"], page, [], "gzip"), (["Content-Encoding: identity"], page, [], None),
    ]
    for heads, body, undone, left in cases:
        block = "\r\n".join(["HTTP/1.1 200 OK", *heads, "Content-Type: text/html"]).encode() + b"\r\n\r\n" + body
        (_, described), *converted = warc.derivatives([("WARC-Record-ID", "<urn:x:1>")], block)
        response = json.loads(described)["HTTP-Response-Metadata"]
        assert (response.get("Decoded", []), response.get("Not-Decoded")) == (undone, left)
        assert [t.decode() for _, t in converted] == ([] if left else ["Text of some length, text of some length."]) and response["HTML-Metadata"]["Title"] == (None if left else "é")
        assert response["Entity-Length"] == len(body) and response["Entity-Digest"] == warc.digest(body)


def _derived(kind: str | None, body: bytes, uri: str = "http://h.example/d/p?q"):
    heads = ["HTTP/1.1 200 OK"] + ([f"Content-Type: {kind}"] if kind is not None else [])
    made = warc.derivatives([("WARC-Record-ID", "<urn:x:1>"), ("WARC-Target-URI", uri)], "\r\n".join(heads).encode() + b"\r\n\r\n" + body)
    return json.loads(made[0][1])["HTTP-Response-Metadata"], [content.decode() for _, content in made[1:]]


def test_encodings_and_types():
    page = "<p>café au lait, s'il vous plaît</p>"
    want = ["café au lait, s'il vous plaît"]
    for kind, body in (
        ('text/html; charset="iso-8859-1"', page.encode("latin-1")), ("text/html; Charset=ISO-8859-1", page.encode("latin-1")), ("text/html; charset = 'cp1252'", page.encode("cp1252")),
        ("text/html", b'<meta charset="iso-8859-1">' + page.encode("latin-1")), ("text/html", b"<meta http-equiv=Content-Type content='text/html; charset=latin1'>" + page.encode("latin-1")),
        ("text/html; charset=latin-1", b"\xef\xbb\xbf" + page.encode()), ("text/html", "\ufeff".encode("utf-16-le") + page.encode("utf-16-le")), ("text/html; charset=no-such", page.encode()),
        ("text/html; charset=hex", page.encode()), (None, page.encode()), ("application/xhtml+xml", page.encode()), ("", page.encode()),
    ):
        assert _derived(kind, body)[1] == want, kind
    for kind in ("image/png", "application/pdf", "application/octet-stream", "IMAGE/GIF; x=y"):
        described, converted = _derived(kind, b"\x89PNG\r\n<p>x</p>")
        assert converted == [] and described["Not-Text"] == kind.split(";")[0].lower() and described["HTML-Metadata"] == {"Title": None, "Links": []}
    assert _derived("text/plain", b"a < b\n<p>") [1] == ["a < b\n<p>"] and _derived("application/ld+json", b'{"a": "<b>"}')[1] == ['{"a": "<b>"}']


def test_titles_and_links():
    page = """<head><TITLE lang=en> A &amp; B\n  c </TITLE><base href="/base/"></head><!-- <a href="no">x</a> --><script>s = '<a href="no">'</script>
      <a data-href="no">x</a><a class=k href="x?a=1&amp;b=2">l</a><A HREF='../up'>m</A><a href=http://o.example/z>n</a><a href="#top"></a><a name=q><area href=m><svg><title>no</title></svg><a href="http://[bad">b</a>"""
    described, _ = _derived("text/html", page.encode())
    assert described["HTML-Metadata"] == {"Title": "A & B c", "Links": [f"http://h.example/{x}" for x in ("base/x?a=1&b=2", "up")] + ["http://o.example/z", "http://h.example/base/#top", "http://h.example/base/m", "http://[bad"]}


@pytest.mark.parametrize("unit", ["<b ", "<a ", "<title>", '<b "', '<b ">x', "<b '\"", "<!", "<!--", "<?", "</", "<script>", '<a href="', "<b a=", "<div>", "<p>", "<li>", "<ul><li>", "&", "eyJ"])
def test_malformed_pages_take_linear_time(unit):
    page = unit * (1_000_000 // len(unit))
    began = time.perf_counter()
    html_text.main_text(page)
    between = time.perf_counter()
    warc.derivatives([], b"HTTP/1.1 200 OK\r\n\r\n" + page.encode())
    assert between - began < 6 and time.perf_counter() - between < 6


def plain_markup(page):
    """Tags by the plain rule: quotes hold together, else up to the next end."""
    out, at = [], 0
    for m in re.finditer(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", page, re.S):
        out.append((page[at : m.start()], (m[2] or "").lower(), bool(m[1]), m[3] or ""))
        at = m.end()
    return [*out, (page[at:], "", False, "")]


def test_markup_against_the_plain_rule():
    rng = random.Random(11)
    for _ in range(3000):
        page = "".join(rng.choices(["<b>", "<i a='>'>", '<u x=">" y>', "</b>", "text", " < ", "<!-- c > -->", "<!d>", "<1>", ">", "<br/>", "<a\nb>"], k=rng.randint(0, 12)))
        assert list(html_text.markup_of(page)) == plain_markup(page)


def test_op10_by_hand(spark, tmp_path):
    """The query's records, put together by hand from each page."""
    pages = [(1, "http://a.example/x y", PAGE), (2, None, "<p>é</p>"), (2, None, "<p>é</p>"), (None, "u", None), (4, "http://c.example", "<div>" * 3000 + "deep")]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("block", F.lit(1)).write.parquet(str(tmp_path / "pages.parquet"))
    want = []
    for ident, url, page in pages:
        data = (page or "").encode()
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(data)}\r\n\r\n".encode()
        sha = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
        source = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(['response', url or '', warc.DATE, sha(data), str(ident)]))}>"
        text = "\n".join(b.text for b in html_text.blocks_of(page or "")).encode()
        title = "T" if page == PAGE else None
        links = ["http://a.example/a"] if page == PAGE else []
        envelope = {
            "WARC-Header-Metadata": {
                "WARC-Type": "response", "WARC-Record-ID": source, "WARC-Target-URI": url or "", "WARC-Date": warc.DATE, "Content-Type": "application/http; msgtype=response",
                "WARC-Payload-Digest": sha(data), "WARC-Block-Digest": sha(head + data), "Content-Length": str(len(head + data)),
            },
            "HTTP-Response-Metadata": {
                "Status": "HTTP/1.1 200 OK", "Headers": {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(data))}, "Entity-Length": len(data), "Entity-Digest": sha(data),
                "HTML-Metadata": {"Title": title, "Links": links},
            },
        }
        for kind, body in (("metadata", envelope), ("conversion", text)):
            made = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, kind + chr(10) + source)}>"
            want.append((str(ident), kind, made, source, url or "", sha(data), str(body)))
    got = [(str(r["page_id"]), r["warc_type"], r["record_id"], r["refers_to"], r["target_uri"], r["payload_digest"], str(json.loads(bytes(r["block"])) if r["warc_type"] == "metadata" else bytes(r["block"]))) for r in warc.op10_warc_derivatives(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from cellweave.llm import decontaminate, secrets

    small = [r[:5] for r in corpus() if len(words(r[1])) < 1000]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(small, schema).write.parquet(str(tmp_path / "documents.parquet"))
    bench = [(0, small[4][1])]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = kept_rows(small)
    root = linked({fingerprint(r[1]) for r in kept}, 3)
    groups = {}
    for r in kept:
        groups.setdefault(root[fingerprint(r[1])], []).append(r)
    kept = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    hits = {r["doc_id"] for r in decontaminate.find_contamination(spark.createDataFrame(kept, schema), spark.createDataFrame(bench, "item_id long, text string")).where(decontaminate.contaminated()).collect()}
    assert hits
    kept = [r for r in kept if r[0] not in hits]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in kept)
    want = mixing.mix_sources(secrets.redact(spark.createDataFrame(kept, schema), length_col="n_chars")).collect()
    key = lambda rows: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in rows)
    assert key(got) == key(want)
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, str(tmp_path)).columns == frame.columns
        assert stage(spark, frame.limit(0), str(tmp_path)).count() == 0
