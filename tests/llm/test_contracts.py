"""The registered queries against plain Python or their SQL, on the smallest tables: columns, hashes, whole results."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

from latticeq.llm import hmm, registry
from latticeq.llm.tokens import Tokenizer
from tests.llm.test_results import LOWER, brute_private, brute_secret, words_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return registry.QUERIES[name](spark, SF)


def kept_out(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus == 2


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = con.sql(registry.SQL[name])
    got = run(spark, name).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_op1(spark, texts):
    lines = {i: (r.text or "").split("\n") for i, r in texts.items()}
    plain = [(i, k, " ".join(words_of(x))) for i in sorted(lines) for k, x in enumerate(lines[i])]
    size = [len(x.split()) for _, _, x in plain]
    gone: dict = {i: set() for i in lines}
    n = len(plain)
    for apart in range(1, n):  # maximal runs of lines that equal those so many lines before
        at = 0
        while at + apart < n:
            end = at
            while end + apart < n and plain[end][2] == plain[end + apart][2] and (end == at or (plain[end][1] and plain[end + apart][1])):
                end += 1
            if sum(size[at:end]) >= 50:
                for _, (i, k, _) in zip(range(at, end), plain[at + apart : end + apart]):
                    gone[i].add(k)
            at = max(end, at + 1)
    rows = run(spark, "op1_dedup_lines").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.n_lines == (len(lines[r.doc_id]) if texts[r.doc_id].text is not None else 0)
        got = {k for p in filter(None, r.removed.split(",")) for k in range(int(p.split("-")[0]), int(p.split("-")[1]) + 1)}
        assert got == gone[r.doc_id] and r.n_removed == len(got)
        if texts[r.doc_id].text is not None:
            assert r.text == "\n".join(x for k, x in enumerate(lines[r.doc_id]) if k not in got)


def plain_tiles(text, item, least):
    """Tokens of an item under greedy tiles, by looking at every pair of places again and again."""
    free_t, free_p, covered = [True] * len(text), [True] * len(item), 0
    while True:
        best, run = (0, 0, 0), {}
        for t in range(len(text) - 1, -1, -1):
            now = {}
            for p in range(len(item) - 1, -1, -1):
                if free_t[t] and free_p[p] and text[t] == item[p]:
                    now[p] = run.get(p + 1, 0) + 1
                    if now[p] >= best[0]:
                        best = (now[p], t, p)
            run = now
        n, t, p = best
        if n < least:
            return covered
        # ties: the earliest in the text, then in the item
        free_t[t : t + n], free_p[p : p + n] = [False] * n, [False] * n
        covered += n


def test_op2(spark, texts):
    split = lambda t: re.findall(r"[A-Za-z0-9\x80-\U0010ffff\x00-\x08\x0e-\x1f\x7f]+", (t or "").translate(LOWER))
    items = {r.item_id: split(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    grams = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in items.items()}
    want = {}
    for d, r in texts.items():
        words = split(r.text)
        have = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        for i, w in items.items():
            if len(w) >= 5 and have & grams[i]:
                share = plain_tiles(words, w, 5) / len(w)
                if share >= 0.5:
                    want[d, i] = share
    got = {(r.doc_id, r.item_id): r.coverage for r in run(spark, "op2_decontaminate").collect()}
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_op4(spark, texts):
    rows = run(spark, "op4_language_id").collect()
    langs = {r.lang for r in texts.values()}
    assert len(rows) == len(texts) and rows[0].asDict().keys() >= {"doc_id", "held_out", "lang_pred", "score"}
    for r in rows:
        letters = re.search(r"[^\W\d_]", texts[r.doc_id].text or "")
        assert r.held_out == kept_out(r.doc_id, 4) and 0 <= r.score <= 1 and (r.lang_pred in langs if letters else r.lang_pred == "und")


def spans_of(text):
    return {(kind, int(a), int(b)) for kind, a, b in (x.split(":") for x in text.split(",") if x)}


@pytest.mark.parametrize("name, brute, kinds", [("op5_find_personal_data", brute_private, ("email", "ip", "card", "phone")), ("op6_find_secrets", brute_secret, ("assign", "access", "hex"))])
def test_op5_op6(spark, texts, name, brute, kinds):
    rows = run(spark, name).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r.doc_id].text or "")
        joined = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in kinds] == [sum(x[1] == i for x in base) for i in range(len(kinds))]
        assert spans_of(joined) <= spans_of(r.spans)
        order = [(a, b) for _, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        assert [int(a) for a, _ in order] == sorted(int(a) for a, _ in order)


def test_op7(spark, texts, monkeypatch):
    models = []
    train = hmm.train
    monkeypatch.setattr(hmm, "train", lambda *a, **k: models.append(train(*a, **k)) or models[-1])
    rows = run(spark, "op7_hmm_score").collect()
    words = {i: words_of(r.text) for i, r in texts.items()}
    training = [w for i, w in words.items() if not kept_out(i, 7)]
    c = collections.Counter(x for w in training for x in w)
    n, v = sum(c.values()) + len(training), len(c) + 1
    t = models[0][0]
    count_of = {}
    for w in {x for ws in words.values() for x in ws}:
        raw = np.frombuffer(w.encode(), np.uint8)
        h = Tokenizer()(raw, np.array([0, len(raw)]))[0]
        count_of[w] = int(t.index(h)[0])
    for r in rows:
        w = words[r.doc_id]
        assert r.held_out == kept_out(r.doc_id, 7) and (r.n_tokens, r.train_tokens) == (len(w) + 1, n)
        assert r.n_known == 1 + sum(c[x] > 0 for x in w)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(training) + 1) / (n + v + 1))
        assert abs(r.base_score - base) < 1e-6
    for r in rows[:40]:  # the forward recursion, and the share of each word of the class
        score, a = 0.0, None
        for x in [*words[r.doc_id], None]:
            at = t.own + 1 if x is None else count_of[x] if 0 <= count_of[x] < t.own else t.own
            if at == t.own:
                score += math.log10((c[x] + 1) / t.shared)
            a = (t.model.start if a is None else a @ t.model.move) * t.model.emit[at]
            score += math.log10(a.sum())
            a = a / a.sum()
        assert abs(r.score - score) < 1e-3 * max(1, len(words[r.doc_id]) / 100)


def test_op9(spark):
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = run(spark, "op9_filter_urls").collect()
    assert len(rows) == len(urls) and rows[0].asDict().keys() >= {"page_id", "host", "path", "rule", "verdict"}
    for r in rows:
        rest = urls[r.page_id].partition("://")[2] if urls[r.page_id] and "://" in urls[r.page_id] else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, None))
        assert (r.host, r.path, r.rule) == (host, path, best[1])
        assert r.verdict == best[2] if best[2] else r.verdict in ("allow", "block")


def test_op10(spark, texts):
    rows = run(spark, "op10_mix_sources").collect()
    size = {i: len(words_of(r.text)) for i, r in texts.items()}
    total = collections.Counter()
    for i, r in texts.items():
        total[r.source] += size[i]
    names = sorted(total, key=lambda x: (x is None, (x or "").encode()))
    weight = {x: (5, 2, 1)[k % 3] for k, x in enumerate(names)}
    capped: set = set()
    while True:
        mass = sum(w for x, w in weight.items() if x not in capped)
        rest = 1.5 * sum(total.values()) - sum(2 * total[x] for x in capped)
        target = {x: 2.0 * total[x] if x in capped else rest * weight[x] / mass for x in names}
        over = {x for x in names if x not in capped and target[x] > 2 * total[x] + 1e-9}
        if not over:
            break
        capped |= over
    taken = collections.Counter()
    for r in rows:
        source = texts[r.doc_id].source
        assert (r["size"], r.source_size) == (size[r.doc_id], total[source]) and math.isclose(r.target, target[source]) and 0 <= r.taken <= 2 * r["size"]
        taken[source] += r.taken
    assert len(rows) == len(texts) and all(abs(taken[x] - target[x]) <= 0.02 * target[x] for x in names)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, run(spark, "op10_mix_sources").collect()))
