"""The numbered operators against brute force, and their defined cases."""

import base64
import hashlib
import itertools
import json
import os
import re
import shutil
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinfold.llm import ann, class_lm, common, components, decontaminate, filters, line_dedup, mixing, ngram_join, pii, prefix_trie, quality, token_files, toxicity, warc
from kinfold.llm.queries import queries
from kinfold.session import materialize

WORD = re.compile("[^\x20\x09-\x0d]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, size long, hash long, word string"


def docs_of(spark, texts, ids=None, sources=None):
    """Documents with further columns of names that operators use inside."""
    ids = ids or list(range(len(texts)))
    rows = [(i, t, "en", s, None if t is None else len(t), "r", 7, 8, "w") for i, t, s in zip(ids, texts, sources or ["a"] * len(texts), strict=True)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \n\t ", "one", "two words", "x " * 30000, "the same text of six words", "the same text of six words", "ünï çödé 日本語 🎉 a b", "A\r\nB\x0bC"]


def words(t):
    return WORD.findall((t or "").translate(AZ))


# --- 1 toxicity


def test_toxicity_finds_held_out_words(spark, data):
    data = data.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    rows = queries()["op1_toxicity"](spark, data).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    marks = {r.doc_id: r.toxic for r in labels.collect()}
    marked = [(r.score, marks[r.doc_id]) for r in rows if r.held_out and r.doc_id in marks]
    pos, neg = (np.array([s for s, y in marked if y == k]) for k in (1, 0))
    assert np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)) > 0.8


def test_toxicity_learns_from_planted_words(spark):
    """A fit on a small table against the risk worked out plainly: its slope is that of the loss, and held-out rows are told apart."""
    rng = np.random.default_rng(6)
    bad, plain = [f"bad{i}" for i in range(8)], [f"word{i}" for i in range(300)]
    texts, toxic = [], []
    for i in range(900):
        toxic.append(i % 6 == 0)
        w = list(rng.choice(plain, 30)) + (list(rng.choice(bad, 3)) if toxic[-1] else [])
        texts.append(" ".join(rng.permutation(w)))
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic) if i % 7 < 3], "doc_id long, toxic int")
    rows = [r for r in toxicity.digest(docs, labels).collect() if r.held_out]
    assert len(rows) > 100 and np.mean([r.predicted == toxic[r.doc_id] for r in rows]) > 0.95


def test_toxicity_needs_no_clean_labels(spark, data):
    """Labels that hold only toxic documents give the same model, and a share near the true one is called toxic."""
    data = data.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    marks = {r.doc_id: r.toxic for r in labels.collect()}
    for marked in (labels, labels.filter("toxic = 1")):
        rows = toxicity.digest(docs, marked).collect()
        pos, neg = (np.array([r.score for r in rows if r.held_out and marks.get(r.doc_id) == k]) for k in (1, 0))
        assert np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)) > 0.85
        assert abs(np.mean([r.predicted for r in rows]) - np.mean(list(marks.values()))) < 0.08
    given = toxicity.toxicity(docs.select("doc_id", "text"), labels, prior=0.12).collect()
    assert abs(np.mean([r.predicted for r in given]) - 0.12) < 0.08


@pytest.mark.parametrize("share", [0.02, 0.1, 0.4])
def test_toxic_share_of_scores(share):
    rng = np.random.default_rng(8)
    n = 8000
    mixed = np.where(rng.random(n) < share, rng.normal(2.5, 1, n), rng.normal(-1, 1, n))
    assert abs(toxicity.toxic_share(rng.normal(2.5, 1, 600), mixed) - share) < 0.25 * share + 0.01


def test_toxicity_slope_is_that_of_the_risk():
    rng = np.random.default_rng(1)
    toxic, z, prior = rng.random(40) < 0.3, rng.normal(size=40), 0.2

    def risk(z):
        loss = np.logaddexp(0, -z[toxic]).mean() * prior
        return loss + np.logaddexp(0, z[~toxic]).mean() - prior * np.logaddexp(0, z[toxic]).mean()

    numeric = np.array([(risk(z + 1e-6 * e) - risk(z - 1e-6 * e)) / 2e-6 for e in np.eye(40)])
    assert np.allclose(toxicity._slope(prior, toxic)(z, np.arange(40)), numeric, atol=1e-6)


def test_toxicity_odd_rows(spark):
    docs = docs_of(spark, ODD, ids=[None, *range(1, 9), 8])
    labels = spark.createDataFrame([(1, 1, 1), (None, 1, 1), (2, 1, None), (2, 0, 0)], "doc_id long, toxic int, score int")
    rows = toxicity.digest(docs, labels).collect()
    assert len(rows) == len(ODD)
    assert toxicity.digest(docs, labels.limit(0)).filter(F.col("score") != toxicity.PRIOR).count() == 0
    assert toxicity.digest(docs.limit(0), labels).count() == 0


def test_risk_is_not_negative():
    slope = toxicity._slope(0.4, np.array([True, False]))
    z = np.array([5.0, -5.0])
    s = slope(z, np.arange(2))
    clean = np.array([-0.4 / (1 + np.exp(-5)), 1 / (1 + np.exp(5))])
    assert np.allclose(s, -clean)


# --- 2 n-gram join


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(s), least.get(find(k))) for k, (i, s) in enumerate(sets)), key=repr)


def near_copy_texts(seed, base=12, copies=9):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary, 30))
    out = []
    for b in range(base):
        w = list(rng.choice(vocabulary, rng.integers(6, 160)))
        for _ in range(rng.integers(1, copies)):
            v = list(w)
            for _ in range(rng.integers(0, max(1, len(w) // 18))):
                v[rng.integers(len(v))] = str(rng.choice(vocabulary))
            out.append(" ".join(v) + (" " + passage if b % 3 == 0 else ""))
    return out


@pytest.mark.parametrize("seed", [1])
def test_ngram_join_is_exact(spark, seed):
    texts = near_copy_texts(seed) + ODD
    docs = docs_of(spark, texts, ids=[None if i == 3 else (i * 37) % 1000 for i in range(len(texts))])
    got = sorted([tuple(r) for r in ngram_join.digest(docs).collect()], key=repr)
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def test_ngram_join_matrix_alone_is_exact(spark, monkeypatch):
    """Without the first round of stars, the matrix must find every link by itself; few tokens are frequent."""
    monkeypatch.setattr(ngram_join, "star_links", lambda placed, *_: placed.select(F.col("cid").alias("a"), F.col("cid").alias("b")).limit(0))
    monkeypatch.setattr(ngram_join, "FREQUENT", 1)
    docs = docs_of(spark, near_copy_texts(5))
    got = sorted([tuple(r) for r in ngram_join.digest(docs).collect()], key=repr)
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def unequal_texts(seed):
    """Links between sets of unequal sizes whose common part is frequent: the larger set holds behind its prefix what is in
    the smaller one's, and a third text (c, p) leads both without linking to either."""
    rng = np.random.default_rng(seed)
    new = iter(f"w{i}" for i in range(10**6))
    take = lambda k: [next(new) for _ in range(k)]
    texts = []
    for _ in range(6):
        c, p = take(int(rng.integers(94, 114))), take(64)
        texts += [c, c + take((len(c) - 4) // 3), c[:-10] + p]
        texts += [c + take(900) for _ in range(14)] + [p + take(5) for _ in range(9)]
        k = int(rng.integers(20, 60))
        texts += [c[:k], c[:k] + take(k // 3), c[:k] + take(k // 3 + 2)]
    order = rng.permutation(len(texts))
    return [" ".join(texts[i]) for i in order]


@pytest.mark.parametrize(("seed", "stars"), [(1, True), (2, True), (3, False)])
def test_ngram_join_of_unequal_sizes(spark, monkeypatch, seed, stars):
    monkeypatch.setattr(ngram_join, "SAMPLE", 1)
    monkeypatch.setattr(ngram_join, "FREQUENT", 12)
    if not stars:
        monkeypatch.setattr(ngram_join, "star_links", lambda placed, *_: placed.select(F.col("cid").alias("a"), F.col("cid").alias("b")).limit(0))
    docs = docs_of(spark, unequal_texts(seed))
    got = sorted([tuple(r) for r in ngram_join.digest(docs).collect()], key=repr)
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def test_ngram_join_empty(spark):
    assert ngram_join.digest(docs_of(spark, ODD).limit(0)).count() == 0
    assert ngram_join.keep_one(docs_of(spark, ["a b", "a b", "c"], ids=[5, 4, 9])).select("doc_id").orderBy("doc_id").collect() == [(4,), (9,)]


def test_keep_one_chooses_rows(spark):
    """Repeated rows, ids with two texts and null ids leave one row of each component."""
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(60)) for k in "abcd")
    rows = [(3, a), (3, a), (3, b), (5, b), (2, b + " more"), (None, a), (None, a + " end"), (None, c), (None, c), (None, c + " end"), (7, d), (7, d + " end"), (None, ""), (None, None), (9, ""), (9, "")]
    docs = docs_of(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    out = ngram_join.keep_one(docs)
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    of = lambda k: [g for g in got if (g[1] or "").startswith(k)]
    assert of("a") == [(3, a)] and of("b") == [(2, b + " more")]
    assert len(of("c")) == 1 and len(of("d")) == 1 and of("c")[0][0] is None
    assert Counter(i for i, t in got if not t) == {None: 2, 9: 1}
    assert ngram_join.keep_one(docs.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 240)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {n: got.get(n, n) for n in root} == root


# --- 3 personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": "[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(v):
    d = [int(c) for c in v if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def fine(kind, v):
    n = sum(c.isdigit() for c in v)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in v.split(".")), "card": 14 <= n <= 19 and luhn(v), "phone": 10 <= n <= 15}[kind]


def brute_private(t):
    return {k: [m.span() for m in re.finditer(p, t or "") if fine(k, m[0])] for k, p in BASE.items()}


PRIVATE = [
    "mail a.b@c.de, x@y.z_w@q.rs and @no.pe é🎉 me@x-y.co.uk.",
    "a@b a@b. a@b.c@d.e q%w+e-@1.2",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3 9999.1.2.3.4",
    "4111 1111 1111 1111 and 4111-1111-1111-1111-0 5 41111111111111 4111111111111111,4041894974608795 1 2",
    "+1 (988) 555-2485 +49.30.123456 +1 2 +123456789012345678 ++1 (499) 555-6503)",
    "é" * 50 + "4041894974608795 " + "日本🎉 37.5.5.200",
    *ODD,
]


def test_pii_base(spark):
    docs = docs_of(spark, PRIVATE)
    rows = {r.doc_id: r for r in pii.digest(docs).collect()}
    for i, t in enumerate(PRIVATE):
        found = brute_private(t)
        order = sorted((s, list(BASE).index(k), e, k) for k, v in found.items() for s, e in v)
        joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in order)
        assert [rows[i][f"n_{k}"] for k in BASE] == [len(found[k]) for k in BASE], t[:80]
        assert rows[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(rows[i].spans.split(","))


def test_pii_whole_table(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in queries()["op3_pii"](spark, data).collect():
        found = brute_private(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(found[k]) for k in BASE]


@pytest.mark.parametrize("seed", ["+1 (743) 555-38{:02d}", "1.2.3.{}", "user{}@mail.example.com", "4111 1111 1111 1111", "{}@mail.example.com"])
def test_pii_whole_seeds(spark, seed):
    """Seeds of every form teach the words before the whole span."""
    cards = ["4111 1111 1111 1111", "5500 0000 0000 0004", "6011 0000 0000 0004", "3530 1113 3330 0000"]
    names = ["ann", "bob", "cyd", "dee", "eva", "fay", "gus", "hal", "ivy", "joe", "kim", "lou"]
    filled = cards * 3 if seed[0] == "4" else [seed.format(n) for n in names] if seed[0] == "{" else [seed.format(i) for i in range(12)]
    texts = [f"please reach them via {v} today" for v in filled] + ["please reach them via user77_mailbox today"]
    rows = {r.doc_id: r for r in pii.digest(docs_of(spark, texts)).collect()}
    start = texts[12].index("user77")
    assert rows[12].spans == f"context:{start}:{start + 14}"


def test_pii_contexts_discover(spark):
    texts = [f"please contact admin at u{i}@mail.example.com today" for i in range(12)] + ["please contact admin at user77_mailbox today", "nothing 12345678 here"]
    rows = {r.doc_id: r for r in pii.digest(docs_of(spark, texts)).collect()}
    start = texts[12].index("user77")
    assert rows[12].spans == f"context:{start}:{start + 14}" and rows[12].n_context == 1
    assert rows[13].spans == ""
    assert pii.digest(docs_of(spark, texts).limit(0)).count() == 0


# --- 4 mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in sizes if s not in capped)
        goal = {s: 3 * sizes[s] if s in capped else rest * weight[s] / w for s in sizes}
        over = {s for s in sizes if s not in capped and goal[s] > 3 * sizes[s]}
        if not over:
            return goal
        capped |= over


def check_mix(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.source_size, r.target].append(r)
        assert 0 <= r.taken <= 3 * r.size
    for (_, target), group in by.items():
        assert abs(target - sum(g.taken for g in group)) <= 4 * mixing.BLOCK


def test_mixing_hits_targets(spark):
    rng = np.random.default_rng(1)
    texts, sources = [], []
    for s, n in (("b", 40), ("a", 3), ("é", 200), (None, 10), ("z", 1), ("empty", 2), ("a2", 900)):
        for _ in range(n):
            texts.append(None if s == "empty" else " ".join(["w"] * int(rng.integers(0, 900))))
            sources.append(s)
    docs = docs_of(spark, texts, ids=[i // 2 for i in range(len(texts))], sources=sources)
    size = Counter()
    for t, s in zip(texts, sources, strict=True):
        size[s] += len(words(t))
    goal = brute_targets(size)
    pieces, out = mixing.mix(docs)
    rows = out.collect()
    assert len(rows) == len(texts)
    check_mix(rows)
    taken = {r.source: r.w for r in pieces.groupBy("source").agg(F.sum("words").alias("w")).collect()}
    for s in goal:
        assert abs(taken.get(s, 0) - goal[s]) <= 4 * mixing.BLOCK
    assert {round(r.target, 6) for r in rows} == {round(g, 6) for g in goal.values()}
    assert sorted(map(tuple, mixing.mix(docs.repartition(7))[1].collect()), key=repr) == sorted(map(tuple, rows), key=repr)
    slots = pieces.groupBy("slot").agg(F.countDistinct("source").alias("n"), F.sum("words").alias("w")).filter("slot < 100").collect()
    assert all(r.n == 1 and r.w <= mixing.BLOCK for r in slots if r.slot < 50)


def test_mixing_follows_its_schedule(spark, monkeypatch):
    """What is taken comes from the slots: with all points at 0 only the first source gives."""
    docs = docs_of(spark, ["w " * 500] * 60, sources=["a", "b", "c"] * 20)
    before = [r.taken for r in mixing.mix(docs)[1].orderBy("doc_id").collect()]
    assert min(before[1::3]) > 0
    monkeypatch.setattr(mixing, "point", lambda slot: F.lit(0.0))
    after = [r.taken for r in mixing.mix(docs)[1].orderBy("doc_id").collect()]
    assert sum(after[::3]) > sum(before[::3]) and not any(after[1::3]) and not any(after[2::3])
    pieces, out = mixing.mix(docs)
    assert sum(after) == pieces.agg(F.sum("words")).first()[0] == 3 * 20 * 500


def test_mixing_empty(spark):
    assert mixing.mix(docs_of(spark, ODD).limit(0))[1].count() == 0
    assert mixing.mix(docs_of(spark, [None, ""]))[1].agg(F.sum("taken")).first()[0] == 0


# --- 5 WARC


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 7)
    bodies = [None, "", "", "short", "exactly7", "seven77", "éé日本🎉" * 9, "WARC/1.1\r\nX-Boundary: no\r\n\r\n" * 3, "dup", "dup", "dup", "x" * 100, "x" * 100, "\r\n\r\n\r\n"]
    ids = [5, 9, 2, None, 7, 8, 20, 21, 31, 30, 30, 41, None, 50]
    pages = spark.createDataFrame([(i, f"http://h/\r\n{i}: x", b) for i, b in zip(ids, bodies, strict=True)], "page_id long, url string, html string")
    rows = warc.round_trip(pages).collect()
    payload = [(b or "").encode() for b in bodies]
    least = {}
    for i, p in zip(ids, payload, strict=True):
        if i is not None:
            least[p] = min(least.get(p, i), i)
    want = []
    for i, p in zip(ids, payload, strict=True):
        again = payload.count(p) > 1 and i != least.get(p)
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", least.get(p) if again else None, True))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)
    big = warc.round_trip(pages, least=10**6).collect()
    assert {r.record_type for r in big} == {"response"} and all(r.intact for r in big)


def test_warc_digests_are_read(spark, monkeypatch):
    """A damaged body shows in the digest that comes back, in its own record and in those that revisit it."""
    monkeypatch.setattr(warc, "CHUNK", 64)
    pages = spark.createDataFrame([(1, "u", "whole " * 30), (2, "u", "short"), (3, "u", "whole " * 30), (4, "u", "fine")], "page_id long, url string, html string")
    read = warc.read_chunks

    def damaged(*a):
        return read(*a).withColumn("body", F.regexp_replace(F.col("body").cast("string"), "ole wh", "OLE WH").cast("binary"))

    monkeypatch.setattr(warc, "read_chunks", damaged)
    rows = {r.page_id: r for r in warc.round_trip(pages.withColumn("extra", F.lit(1)).withColumn("rid", F.lit(2))).collect()}
    assert [rows[i].intact for i in (1, 2, 3, 4)] == [False, True, False, True]
    sound = base64.b32encode(hashlib.sha1(b"whole " * 30).digest()).decode()
    assert rows[1].payload_digest not in (None, sound) and rows[3].payload_digest is None and rows[1].payload_bytes == 180


def test_warc_bodies(spark):
    pages = spark.createDataFrame([(1, "u", "a" * 70000 + "é"), (2, "u", "b")], "page_id long, url string, html string")
    path, boundary = warc.write_archives(pages)
    chunks = warc.read_chunks(spark, path, boundary).collect()
    assert len(chunks) == 3
    one = sorted((c for c in chunks if "WARC-Segment-Number" in c["head"]), key=lambda c: int(c["head"]["WARC-Segment-Number"]))
    assert b"".join(bytes(c.body) for c in one) == ("a" * 70000 + "é").encode()
    assert warc.round_trip(pages.limit(0)).count() == 0


# --- 6 nearest neighbours


def brute_nearest(rows, k=20):
    ok = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in ok:
        if i % 20 == 0:
            out[i] = [j for _, j in sorted((-(v * q).sum(), j) for j, v in ok if j != i)[:k]]
    return out


def test_nearest_recall(spark, data):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    want, vectors, got = brute_nearest(rows), {i: np.array(v, float) for i, v in rows}, defaultdict(dict)
    for r in queries()["op6_nearest"](spark, data).collect():
        got[r.query_id][r["rank"]] = r.vec_id
        assert abs(r.score - (vectors[r.query_id] * vectors[r.vec_id]).sum()) < 1e-12
    assert set(got) == set(want)
    assert np.mean([len(set(got[q].values()) & set(want[q])) / len(want[q]) for q in want]) >= 0.9


def test_nearest_prunes_and_keeps_recall():
    """On 51282 vectors without any structure, a recall of 0.9 from less than a tenth of the rows."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(51282, 64))
    x /= np.sqrt((x**2).sum(1))[:, None]
    index = ann.Shard(ann.Polytope(len(x), 64, 1.0, 1.0), np.arange(len(x)), x)
    asked = np.arange(0, 60 * 20, 20)
    got = index.nearest(asked, x[asked], 20)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -2
    want = np.argsort(-score, 1)[:, :20]
    assert np.mean([len(set(g[1]) & set(w)) / 20 for g, w in zip(got, want, strict=True)]) >= 0.9
    assert index.read / len(asked) < 0.1 * len(x)


@pytest.mark.parametrize("n", [2_000, 16_000, 17_000, 60_000])
def test_nearest_probes_follow_the_recall(n):
    """Where one more hash names a bucket, probes make up for it: neighbours of other queries than the sampled ones are found."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64))
    x /= np.sqrt((x**2).sum(1))[:, None]
    asked = rng.choice(n, 100, replace=False)
    score = x[asked] @ x.T
    score[np.arange(100), asked] = -9
    near = np.argpartition(-score, 20, axis=1)[:, :20]
    index = ann.Polytope(n, 64, 1.0, 1.0)
    assert ann.tune(index, x[asked[:60]], [x[j] for j in near[:60]]) >= 0.95
    probed = index.probed(x[asked[60:]])
    assert np.mean([np.isin(index.places(x[j]), p).any(1).mean() for j, p in zip(near[60:], probed, strict=True)]) >= 0.92


def test_nearest_of_one_row(spark):
    one = spark.createDataFrame([(20, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert ann.digest(one).collect() == []


def test_nearest_turns_and_sums_little(monkeypatch):
    """Butterflies make each rotation once, whatever the rows; only sums that can be among the best are made, and these are the best."""
    turned, sums, hadamard = [], [], ann.hadamard
    monkeypatch.setattr(ann, "hadamard", lambda x: turned.append(len(x)) or hadamard(x))
    x = np.random.default_rng(5).normal(size=(6000, 32))
    index = ann.Polytope(len(x), 32, 10.0, 10.0)
    assert index.hashes == 2
    index.places(x)
    assert sum(turned) <= 3 * index.tables * index.hashes * index.size
    index.probes = 40
    split = np.argpartition
    monkeypatch.setattr(np, "argpartition", lambda s, *a: sums.append(s.shape[1]) or split(s, *a))
    probed = index.probed(x[:50])
    assert max(sums) <= 200 < index.axes**2
    for t, (a, b) in enumerate(index.turned(x[:50], True)):
        signed = [np.stack([c, -c], 2).reshape(50, -1) for c in (a, b)]
        signed = [np.where(c >= np.sort(c, 1)[:, -index.axes][:, None], c, -np.inf) for c in signed]
        every = (signed[0][:, :, None] + signed[1][:, None]).reshape(50, -1)
        best = t * (2 * index.size) ** 2 + np.argsort(-every, 1)[:, : index.probes]
        assert (np.sort(best, 1) == np.sort(probed[:, t * index.probes : (t + 1) * index.probes], 1)).all()



def test_nearest_sample_is_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-4, 5, (300, 7)).astype(float)
    data = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    for (i, q), found in zip([(5, x[5]), (290, x[290])], ann.exact(data, [(5, x[5]), (290, x[290])], 20), strict=True):
        best = sorted((float(v @ q) for j, v in enumerate(x) if j != i), reverse=True)[:20]
        assert [float(v @ q) for v in found] == best


def test_nearest_of_different_lengths(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 1000)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 24)) * rng.uniform(0.5, 2, (3000, 1))
    rows = [(i, [float(v) for v in r], "q", 1) for i, r in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cells string, score int")
    got = defaultdict(set)
    for r in ann.neighbours(frame, frame.filter("vec_id % 20 = 0")).collect():
        got[r.query_id].add(r.vec_id)
    want = brute_nearest([r[:2] for r in rows])
    assert np.mean([len(got[q] & set(want[q])) / 20 for q in want]) >= 0.9


def test_nearest_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (20, [1.0, 0.0]), (21, [1.0, 0.0]), (None, [1.0, 1.0]), (40, [-1.0, 0.5]), (21, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in ann.digest(frame).orderBy("query_id", "rank").collect()]
    assert [(q, k, v) for q, k, v, _ in got] == [(0, 1, 20), (0, 2, 21), (0, 3, 40), (20, 1, 0), (20, 2, 21), (20, 3, 40), (40, 1, 0), (40, 2, 20), (40, 3, 21)]
    assert ann.digest(frame.limit(0)).count() == 0


# --- 7 quality


def test_quality_agrees_with_labels(spark, data):
    data = data.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = queries()["op7_quality"](spark, data).collect()
    marked = [(r.keep, labels[r.doc_id]) for r in rows if r.doc_id in labels]
    assert np.mean([k == bool(y) for k, y in marked]) > 0.9
    assert np.mean([k for k, y in marked if y]) > 0.97


def test_quality_odd_rows(spark):
    kept = quality.keep_good(docs_of(spark, ODD))
    assert kept.columns == docs_of(spark, ODD).columns
    assert kept.filter("text is null or text = ''").count() == 2
    assert quality.digest(docs_of(spark, ODD).limit(0)).count() == 0


def test_label_model_weighs_labellers():
    code = lambda d: int(d, 4)
    counts = {code("0000222"): 900, code("1010022"): 60, code("0001122"): 50, code("0100020"): 40, code("0000022"): 30, code("3333333"): 5}
    posterior, right = quality.label_model(counts)
    assert posterior[code("0000222")] > 0.95 and posterior[code("3333333")] > 0.5
    assert max(posterior[code(c)] for c in ("1010022", "0001122")) < 0.05
    assert quality.label_model({0: 3})[0][0] > 0.5


# --- 8 language model


def test_lm_base_scores(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter()
    for i, t in docs:
        if not held(i):
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    rows = {r.doc_id: r for r in queries()["op8_class_lm"](spark, data).collect()}
    assert len(rows) == len(docs)
    for i, t in docs:
        tokens = [*words(t), None]
        base = sum(np.log10((c[w] + 1) / (n + v + 1)) for w in tokens)
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(tokens), sum(c[w] > 0 for w in tokens), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
    out = [r for r in rows.values() if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_lm_rare_words_by_join(spark, monkeypatch, data):
    whole = {r.doc_id: r for r in queries()["op8_class_lm"](spark, data).collect()}
    monkeypatch.setattr(class_lm, "BROADCAST", 300)
    part = {r.doc_id: r for r in queries()["op8_class_lm"](spark, data).collect()}
    assert all(abs(whole[i].base_score - part[i].base_score) < 1e-6 * max(1, abs(whole[i].base_score)) and whole[i].n_known == part[i].n_known for i in whole)


def test_lm_exchange_raises_likelihood():
    rng = np.random.default_rng(2)
    n = rng.integers(10, 50, (class_lm.TOTAL, class_lm.TOTAL)).astype(float)
    after, before = np.minimum(n[3], 5), np.minimum(n[:, 3], 4)
    after[3] = before[3] = 0
    best, gain = class_lm.best_class(3, after, before, 2.0, n)
    moved = n.copy()
    moved[3] -= after
    moved[:, 3] -= before
    moved[3, 3] -= 2
    moved[best] += after
    moved[:, best] += before
    moved[best, best] += 2
    assert abs(class_lm.likelihood(moved) - class_lm.likelihood(n) - gain) < 1e-6


def test_lm_many_words_move_as_one():
    rng = np.random.default_rng(3)
    n = rng.integers(20, 60, (class_lm.TOTAL, class_lm.TOTAL)).astype(float)
    own = np.array([3, 0, 63, 7])
    after, before = rng.integers(0, 2, (2, 4, class_lm.TOTAL)).astype(float)
    itself = np.array([2.0, 0, 1, 3])
    best, gain = class_lm.best_classes(own, after, before, itself, n)
    for i in range(4):
        one = class_lm.best_class(int(own[i]), after[i], before[i], itself[i], n)
        assert best[i] == one[0] and abs(gain[i] - one[1]) < 1e-6


def test_lm_all_words_have_classes(spark, monkeypatch):
    """Words beyond the start are classed by their neighbours, broadcast or not."""
    rng = np.random.default_rng(4)
    kinds = [[f"{c}{i:03d}" for i in range(900)] for c in "pqr"]
    docs = docs_of(spark, [" ".join(str(rng.choice(kinds[k % 3])) for k in range(60)) for _ in range(300)])
    class_lm.text_batches(spark)
    model, _ = class_lm.train(docs)
    assert len(model.word) > class_lm.HEADS + 300 and all((model.label < class_lm.CLASSES) == (model.n >= class_lm.MIN_COUNT))
    whole = {r.doc_id: r for r in class_lm.digest(docs).collect()}
    monkeypatch.setattr(class_lm, "BROADCAST", 400)
    model, rare = class_lm.train(docs)
    assert all((r.label < class_lm.CLASSES) == (r.n >= class_lm.MIN_COUNT) for r in rare.collect())
    part = {r.doc_id: r for r in class_lm.digest(docs).collect()}
    assert sum(r.score for r in part.values()) > 1.2 * sum(r.score for r in whole.values())


def test_lm_odd_rows(spark):
    rows = class_lm.digest(docs_of(spark, ODD, ids=[None, *range(1, 9), 8])).collect()
    assert len(rows) == len(ODD) and all(r.n_tokens == len(words(t)) + 1 for r, t in zip(sorted(rows, key=lambda r: r.n_tokens), sorted(ODD, key=lambda t: len(words(t))), strict=True))
    assert class_lm.digest(docs_of(spark, ODD).limit(0)).count() == 0
    lone = class_lm.digest(docs_of(spark, ["a b"], ids=[next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)])).first()
    assert (lone.train_tokens, lone.n_known, lone.base_score) == (0, 0, 0.0)


def test_class_lm_forms_of_words():
    """Forms of words with equal upper bits too."""
    rng = np.random.default_rng(2)
    known = rng.integers(0, 2**63, 500).astype(np.uint64)
    form = rng.integers(0, class_lm.FORMS, 502).astype(np.int16)
    for every in (known, np.concatenate([known, known[:2] ^ np.uint64(5)])):
        at = rng.integers(0, len(every), 4000)
        word, first = np.unique(every[at], return_index=True)
        held = [(every[at[:1000]], form[at[:1000]]), (every[at[1000:]], form[at[1000:]])]
        assert (class_lm.forms_of(word, held) == form[at[first]]).all()


def test_class_lm_gives_shuffles_back(spark, data, monkeypatch):
    """The classes of each turn are written, so that its shuffle files go before the next turn."""
    tags, write = [], class_lm.materialize
    monkeypatch.setattr(class_lm, "materialize", lambda df, tag, **k: tags.append(tag) or write(df, tag, **k))
    class_lm.train(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text"))
    assert tags.count("moved") >= 2


def test_class_lm_keeps_little_of_texts(spark, monkeypatch):
    """Only labels beside words that are not broadcast are written, and what was broadcast to learn goes from the disks."""
    docs = docs_of(spark, [f"{'a b c d ' * 20}w{i % 50} w{i % 40} {'d a b ' * 20}v{i}" for i in range(300)])
    monkeypatch.setattr(class_lm, "BROADCAST", 4)
    held, write = {}, class_lm.materialize
    monkeypatch.setattr(class_lm, "materialize", lambda df, tag, **k: held.setdefault(tag, write(df, tag, **k)))
    before = len(os.listdir(spark.sparkContext._temp_dir))
    class_lm.text_batches(spark)
    class_lm.train(docs)
    assert len(os.listdir(spark.sparkContext._temp_dir)) == before
    held.clear()
    assert class_lm.digest(docs).count() == 300
    rows = held["scored"].collect()
    # Three places in two runs: 4 and 3 labels of 144.
    assert {(len(r.rest), tuple(r.at), len(r.labels)) for r in rows} == {(3, (1, 2, 5), 7)}


def test_class_lm_paths_of_open_words():
    """What open words add to a path, by their runs, is what the whole path holds."""
    rng = np.random.default_rng(7)
    model = class_lm.Model()
    model.transition, model.spread = rng.normal(size=(class_lm.TOTAL, class_lm.TOTAL)), rng.normal(size=class_lm.TOTAL)
    count = np.array([0, 1, 5, 0, 40, 3])
    label, open_ = rng.integers(0, class_lm.TOTAL, count.sum()), rng.random(count.sum()) < 0.5
    open_[-3:] = True
    whole = model.path(label, count, open_ & False)
    assert not len(whole[1])
    path, runs, ends, at = model.path(label, count, open_)
    cut = np.concatenate([[0], np.cumsum(count)])
    for i in range(len(count)):
        row, own = runs[ends[i] : ends[i + 1]], label[cut[i] : cut[i + 1]][open_[cut[i] : cut[i + 1]]]
        places = at[open_[: cut[i]].sum() :][: len(own)]
        assert (np.flatnonzero(row < 0) == places).all() and (~row[places] == own).all()
        known = np.where(row < 0, ~row, row)
        more = sum(model.transition[known[k], known[k + 1]] for k in range(len(row) - 1) if row[k] < 0 or row[k + 1] < 0) - model.spread[own].sum()
        assert abs(path[i] + more - whole[0][i]) < 1e-9


# --- 9 decontamination

ITEM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_hits(text, items):
    w = ITEM.findall((text or "").translate(AZ))
    hit, found = set(), set()
    for i, t in items:
        v = ITEM.findall((t or "").translate(AZ))
        n = min(13, len(v))
        windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
        for k in range(len(w) - n + 1 if n else 0):
            if tuple(w[k : k + n]) in windows:
                hit.update(range(k, k + n))
                found.add(i)
    found.discard(None)
    s = ",".join(sorted(map(str, found)))
    return len(w), len(hit), len(found), hashlib.sha256(s.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("most", [10**6, 3])
def test_decontamination(spark, most):
    long = " ".join(f"t{i}" for i in range(30))
    items = [(1, long), (2, "Short, one!"), (2, "short one again"), (None, "no id here"), (3, None), (4, "..."), (11, "ünï 日本"), (5, "SHORT one")]
    texts = [*ODD, f"x {long.upper()}. y", long[20:60], "a short one " + "z " * 200, "a short one", "no id here", "ÜNÏ ünï-日本", f"{long} {long} short one again"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(spark, texts)
    out = decontaminate.decontaminate(docs, bench, most_windows=most)
    got = {r.row.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect()}
    assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}
    assert decontaminate.keep_clean(docs, bench).columns == docs.columns
    assert decontaminate.digest(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.digest(docs.limit(0), bench).count() == 0


def test_decontamination_bitmap(spark):
    """The bitmap grows with the windows, holds each of them and few others."""
    assert [decontaminate._bitmap_bits(n) for n in (0, 1 << 15, (1 << 15) + 1, 10**6, 10**9)] == [1 << 19, 1 << 19, 1 << 20, 1 << 24, 1 << 30]
    r = np.random.default_rng(4)
    known, others = (r.integers(-(2**63), 2**63, 1 << 16, dtype=np.int64) for _ in range(2))
    bits = decontaminate._bitmap_bits(len(known))
    packed = decontaminate._bitmap(spark.createDataFrame([(int(h),) for h in known], "hash long").repartition(5), bits)
    passes = lambda h: np.logical_and(*(packed[at >> 3] >> (7 - (at & 7)) & 1 for at in decontaminate._places(h.view(np.uint64), bits)))
    assert len(packed) == bits // 8 and passes(known).all() and passes(others).mean() < 0.02


# --- 10 line dedup


def brute_repeats(texts, least=line_dedup.MIN_WORDS):
    """Which words of every text stand in runs of ``least`` words that an earlier text holds."""
    split = [WORD.findall(t or "") for t in texts]
    seen, out = set(), []
    for w in split:
        runs = [tuple(w[i : i + least]) for i in range(len(w) - least + 1)]
        gone = [False] * len(w)
        for i, r in enumerate(runs):
            if r in seen:
                gone[i : i + least] = [True] * least
        seen.update(runs)
        out.append(gone)
    return out


def check_repeats(before, after, gone, least=line_dedup.MIN_WORDS):
    """Words went only where an earlier text repeats them, and no such run of ``least`` words is left whole."""
    words, left = WORD.findall(before or ""), WORD.findall(after or "")
    # Where the kept words stood: all free ones stay, in order, so the greedy match from the left is one.
    kept, i = [False] * len(words), 0
    for k, w in enumerate(words):
        if i < len(left) and left[i] == w and (not gone[k] or len(left) - i > sum(1 for x in gone[k:] if not x)):
            kept[k], i = True, i + 1
    assert i == len(left)
    assert all(k or g for k, g in zip(kept, gone, strict=True))
    runs = "".join("x" if k and g else " " for k, g in zip(kept, gone, strict=True)).split()
    assert all(len(r) < least for r in runs), max(map(len, runs))


def passages_in_texts(seed, n=40):
    """Texts that hold passages of 50 words or more across their lines, in any order, moved, twice and changed in places."""
    rng = np.random.default_rng(seed)
    draw = lambda n: [f"w{x}" for x in rng.integers(0, 4000, n)]
    passages = [draw(k) for k in (50, 51, 64, 120, 300)]
    texts = []
    for k in range(n):
        parts = [draw(int(rng.integers(0, 40))) for _ in range(4)]
        for i in rng.choice(5, int(rng.integers(0, 4)), replace=k % 5 == 0):
            p = list(passages[i])
            if k % 7 == 3:
                p[len(p) // 3] = "changed"
            parts.insert(int(rng.integers(0, len(parts) + 1)), p)
        flat = [w for p in parts for w in p]
        texts.append("".join(w + str(rng.choice([" ", " ", " ", " ", "\n", "  ", "\n\n"])) for w in flat))
    return texts


@pytest.mark.parametrize("seed", [4, 5])
def test_line_dedup_finds_passages(spark, seed):
    texts = [*passages_in_texts(seed), *ODD]
    rows = {r.row.doc_id: r for r in line_dedup.line_dedup(docs_of(spark, texts)).collect()}
    for i, gone in enumerate(brute_repeats(texts)):
        check_repeats(texts[i], rows[i].new_text, gone)
        assert rows[i].dropped_words <= sum(gone) and rows[i].dropped_words + len(WORD.findall(rows[i].new_text or "")) == len(gone)
        assert any(gone) or rows[i].new_text == texts[i]
    assert sum(r.dropped_blocks for r in rows.values()) > 20


def test_line_dedup_needs_its_alignment(monkeypatch):
    """Nothing goes but by alignment: without it no block is found."""
    mine = list(range(100, 400))
    lines = line_dedup.Lines(np.array(mine), np.array(range(0, 280, 20)), np.array(mine[:280:20]))
    assert line_dedup.aligned_blocks(lines, lines) == ([(0, 300)], [])

    def nothing(values):
        raise LookupError

    monkeypatch.setattr(line_dedup, "_longest_order", nothing)
    with pytest.raises(LookupError):
        line_dedup.aligned_blocks(lines, lines)


def test_line_dedup_copies(spark):
    text = "\n".join(" ".join(f"l{i}x{j}" for j in range(20)) for i in range(6))
    docs = docs_of(spark, [text, text + "\nnew words", text, None, "", "short\nshort"], ids=[3, 7, 9, None, 1, 2])
    left = {r.doc_id: r for r in line_dedup.without_repeats(docs).collect()}
    assert set(left) == {3, 7, None, 1, 2} and left[7].text == "new words" and left[7].n_chars == 9
    assert line_dedup.without_repeats(docs).columns == docs.columns
    assert line_dedup.digest(docs.limit(0)).count() == 0
    same = docs_of(spark, [text, text], ids=[1, 1])
    assert line_dedup.without_repeats(same).count() == 2


@pytest.mark.parametrize("most", [0, 100])
def test_line_dedup_compares_documents_of_shared_keys(spark, monkeypatch, most):
    """Keys of one row go by plain counts; documents, equal rows and equal ids are told apart for the others only."""
    rows = [(1, 10, [1, 2, 3]), (2, 20, [2, 4]), (2, 21, [2, 5]), (3, 30, [6, 7]), (3, 30, [6, 7]), (4, 40, [5, 8])]
    held, write = {}, line_dedup.materialize
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", most)
    monkeypatch.setattr(line_dedup, "materialize", lambda df, tag, **k: held.setdefault(tag, write(df, tag, **k)))
    pairs = line_dedup._pairs(spark.createDataFrame(rows, "id long, text_hash long, keys array<long>"))
    assert {tuple(r) for r in pairs.collect()} == {(2, 20, 1, 10), (2, 21, 1, 10), (4, 40, 2, 21)}
    assert {r.key for r in held["shared"].collect()} == {2, 5, 6, 7}
    assert {(r["key"], *r["first"]) for r in held["first"].collect()} == {(2, 1, 10), (5, 2, 21)}


def test_line_dedup_writes_few_files(spark, monkeypatch):
    """Tables made without a shuffle are no file for each part of the input, and nothing stays with the executors."""
    texts, count, write = passages_in_texts(6), Counter(), line_dedup.materialize

    def counted(df, tag, **k):
        out = write(df, tag, **k)
        count.update({tag: len(out.inputFiles()) if k.get("files", True) else 0})
        return out

    monkeypatch.setattr(line_dedup, "materialize", counted)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    rows = {r.row.doc_id: r for r in line_dedup.line_dedup(docs_of(spark, texts).repartition(20)).collect()}
    for i, gone in enumerate(brute_repeats(texts)):
        check_repeats(texts[i], rows[i].new_text, gone)
    assert {"keys", "shared", "windows", "aligned"} <= set(count) and sum(count[t] for t in ("keys", "shared", "windows")) == 0
    assert sum(count.values()) <= 20 and spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_line_dedup_long_text(spark):
    """200000 lines and many blocks in linear time."""
    rng = np.random.default_rng(1)
    words = [f"w{x}" for x in rng.integers(0, 10**6, 200_000)]
    other = [w if i % 61 else "x" for i, w in enumerate(words)]
    start = time.time()
    rows = {r.doc_id: r for r in line_dedup.digest(docs_of(spark, ["\n".join(words), "\n".join(other)])).collect()}
    assert rows[1].dropped_blocks > 3000 and sum(w != "x" for w in WORD.findall(rows[1].text)) < 60 and time.time() - start < 60
    assert line_dedup.without_blocks(pa.array([b"a b\nc d e\nf"]), pa.array([[{"a": 3, "b": 4}]], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))))[0].to_pylist() == [b"a b\nc e\nf"]


def test_patience_takes_one_order_first():
    lines = lambda w, at: line_dedup.Lines(np.array(w), np.array(at), np.array([w[i] for i in at]))
    a, b = list(range(60)), list(range(100, 160))
    blocks = lambda *x: line_dedup.aligned_blocks(*x)[0]
    assert sorted(blocks(lines(a + b, [0, 60]), lines(b + a, [0, 60]))) == [(0, 60), (60, 120)]
    assert sorted(blocks(lines(a + [9] + a, [0, 61]), lines(a, [0]))) == [(0, 60), (61, 121)]
    assert line_dedup.aligned_blocks(lines(a[:40] + b[:40], [0, 40]), lines(a[:40] + [7] + b[:40], [0, 41])) == ([], [0, 100])


def test_line_dedup_compares_few_places(monkeypatch):
    """Texts of a few sentences in any order hold each key many times; only what can begin a block is compared with its places."""
    rng = np.random.default_rng(3)
    sentences = [rng.integers(0, 2**62, 20).astype(np.uint64) for _ in range(6)]
    words = np.concatenate([sentences[i] for i in rng.integers(0, 6, 200)])
    lines = lambda w: line_dedup.Lines(w, np.arange(0, len(w), 20), w[::20])
    calls, best = [], line_dedup._best_place
    monkeypatch.setattr(line_dedup, "_best_place", lambda *x: calls.append(1) or best(*x))
    other = np.concatenate([np.concatenate([s, rng.integers(0, 2**62, 20).astype(np.uint64)]) for s in sentences])
    blocks, short = line_dedup.aligned_blocks(lines(words), lines(words))
    assert {w for a, b in blocks for w in range(a, b)} == set(range(len(words))) and not short and len(calls) <= len(blocks)
    calls.clear()
    # Every key is shared, no row of 50 words is.
    assert line_dedup.aligned_blocks(lines(words), lines(np.concatenate([other, other]))) == ([], sorted(int(s[0]) for s in sentences)) and not calls


# --- 11 filter audit


def brute_audit(docs, labels):
    """Rows of (part, order, step, ...) of documents (id, text, source) and labels {id: (quality, toxic)}, filter by filter."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    fails = []
    for i, t, s in docs:
        t = t or ""
        w = WORD.findall(t)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(set(t) & set("#$%&*|")), "E": i is not None and first[t] < i}
        fails.append((s or "", {f for f, b in bad.items() if b}, labels.get(i, (0, 0))))
    out = {}
    for part in {p for p, _, _ in fails}:
        for order in itertools.permutations("ABCDE"):
            left = [(f, lab) for p, f, lab in fails if p == part]
            everyone = list(left)
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[0]]
                left = [x for x in left if letter not in x[0]]
                out[part, "".join(order), step] = [len(left), len(gone), sum(letter in f for f, _ in everyone) - len(gone), sum(f == {letter} for f, _ in everyone), sum(q for _, (q, _) in gone), sum(t for _, (_, t) in gone)]
    shapley = Counter()
    for (part, order, step), row in out.items():
        shapley[part, order[step - 1]] += row[1]
    return {k: (*row, shapley[k[0], k[1][k[2] - 1]]) for k, row in out.items()}


def test_filter_audit(spark):
    rng = np.random.default_rng(4)
    pool = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(pool[: int(rng.integers(40, 400))], int(rng.integers(150, 320)))) for _ in range(60)]
    texts = [t.upper()[: int(k)] + t[int(k) :] + m for t, k, m in zip(texts, rng.integers(0, 60, 60), rng.choice(["", "", " #", " a|b"], 60), strict=True)]
    texts += texts[:9] + ODD + [texts[0]] * 30
    sources = [None if i % 11 == 0 else ("", "a", "b", "c")[i % 4] for i in range(len(texts))]
    ids = [None if i in (5, 63) else 7 if i % 13 == 0 else (i * 37) % 211 for i in range(len(texts))]
    docs = docs_of(spark, texts, ids, sources)
    rows = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 211, 2)] + [(4, None, 1), (4, 0, 0), (None, 1, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    known = {}
    for i, q, t in rows[:-1]:
        known[i] = (max(known.get(i, (0, 0))[0], q or 0), max(known.get(i, (0, 0))[1], t))
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filters.audit(docs, labels, parts_held=2).collect()}
    assert got == brute_audit(list(zip(ids, texts, sources, strict=True)), known)
    assert filters.digest(docs.limit(0), labels).count() == 0 and filters.digest(docs, labels.limit(0)).count() == len(got)


# --- 13 token files


def test_token_blocks():
    rng = np.random.default_rng(2)
    cases = [rng.integers(0, 49408, 5000), np.zeros(7, np.int64), np.array([-5]), rng.integers(-(2**63), 2**63 - 1, 300), np.array([2**63 - 1, -(2**63)]), np.r_[rng.integers(0, 9, 900), 2**40, -3], np.arange(10**6, 10**6 + 64)]
    for values in cases:
        for share in (0.5, 0.9, 1.0):
            data = token_files.encode_block(np.asarray(values, np.int64), share)
            assert token_files.block_bytes(data) == len(data)
            assert np.array_equal(token_files.decode_block(data), values)
    # An outlier costs its own place and bits, not the width of the others.
    assert len(token_files.encode_block(cases[5])) < 900 * 4 / 8 + 60
    assert all(np.array_equal(token_files.unpack(token_files.pack(v, w), len(v), w), v) for w in range(1, 65) for v in [rng.integers(0, 2**w, 77, dtype=np.uint64, endpoint=False) if w < 64 else rng.integers(0, 2**64 - 1, 77, dtype=np.uint64)])


def whole_text_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


HARD = ["<|endoftext|> a<|startoftext|>b", "é Ȩ́ ́x", "don't DON'T 'll x's y'S", "a b c　d \x1c e", "ΑΣ ΣΑΣ\nΣ", 'say "so" " !', "1234567 ①½", "İstanbul ß ﬁ", "👩‍👩‍👧 🇩🇪", "\x01 \x00 \x7f", "ab" * 9000]


@pytest.mark.parametrize("apart", [True, False])
def test_token_files(spark, data, apart):
    table = spark.read.parquet(f"{data}/documents.parquet").select("text").limit(60).collect()
    texts = ODD + HARD + [r.text for r in table] + ["same text"] * 40
    ids = [None if i in (3, 70) else 9 if i >= len(texts) - 40 else (i * 53) % 499 - 100 for i in range(len(texts))]
    docs = docs_of(spark, texts, ids).repartition(3, "doc_id")
    path = token_files.shared_path(spark, "tokens")
    token_files.write_tokens(docs, path, apart=apart, block=64, words_held=400)
    got = sorted(token_files.digests(token_files.read_chunks(spark, path)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(ids, key=lambda i: (i is not None, i))
    expected = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in zip(ids, whole_text_ids(texts), strict=True))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == expected
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    chunks = sorted(token_files.read_chunks(spark, path).collect(), key=lambda r: (r.start, r.chunk_no))
    every = [i for r in chunks for i in r.ids]
    assert len(every) == sum(r.n_tokens for r in got) and max(len(r.ids) for r in chunks) <= 64
    for a, b in ((0, 10), (60, 70), (1000, 1900), (len(every) - 5, len(every) + 9), (5, 5)):
        part = sorted(token_files.read_range(spark, path, a, b).collect())
        assert [i for r in part for i in r.ids] == every[a:b] and (not part or part[0].first == a)


def test_token_files_keep_what_is_committed(spark):
    """A file that is in no manifest is not read; an empty table has no files."""
    docs = docs_of(spark, ["a b", "c"])
    path = token_files.shared_path(spark, "tokens")
    token_files.write_tokens(docs, path)
    folder = path.removeprefix("file://")
    stray = os.path.join(folder, "part-00000-stray.tokens")
    shutil.copy(next(os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".tokens")), stray)
    assert sorted(token_files.digests(token_files.read_chunks(spark, path)).select("doc_id", "start").collect()) == [(0, 0), (1, 3)]
    assert token_files.digest(docs.limit(0)).count() == 0


def test_token_words_are_encoded_as_whole_texts(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    got = sorted(queries()["op13_token_files"](spark, data).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    ids = whole_text_ids([r.text for r in rows])
    start = np.cumsum([0, *map(len, ids)])[:-1].tolist()
    assert [tuple(r) for r in got] == [(r.doc_id, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, s, x in zip(rows, start, ids, strict=True)]


class Counted:
    """A tokenizer that lists the words it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.words = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.words += [w for t in texts for w in t.split()]
        return self.tokenizer.encode_batch_fast(texts, **options)


def encoded(encoder, texts):
    """Lists of ids of the texts."""
    ids, count = encoder.encode(pa.array([t.encode() for t in texts], pa.binary()))
    return [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]


def encoder_of(words_held):
    import public_tokenizers

    out = token_files.Encoder(open(public_tokenizers.path("word_bpe_49k.json")).read(), True, words_held)
    out.tokenizer = Counted(out.tokenizer)
    return out


def test_token_parts_are_encoded_once():
    """Cases of a word and the signs about it cost the tokenizer nothing, and words met again outlive a full table."""
    encoder = encoder_of(10_000)
    stems = [f"{a}{b}stem\xe9" for a in "bcdfg" for b in "aeiou"]
    texts = [form.format(w) for w in stems for form in ("{}", "({}),", "{}.", "{}...42", "{0}-{0}", '"{}"')]
    texts += [t.upper() for t in texts] + [t.capitalize() for t in texts]
    assert encoded(encoder, texts) == whole_text_ids(texts)
    assert len(encoder.tokenizer.words) == len(set(encoder.tokenizer.words)) < 40
    encoder = encoder_of(100)
    often, rare = " ".join(w[:-1] for w in stems), [[" ".join(f"{w[:-1]}{chr(97 + i)}x" for w in stems)] for i in range(12)]
    for texts in rare:
        assert encoded(encoder, [often, *texts]) == whole_text_ids([often, *texts])
    assert len(encoder.tokenizer.words) == 13 * len(stems) and encoder.size <= 100


def test_token_parts_are_those_of_the_tokenizer():
    rng = np.random.default_rng(8)
    signs = [*"abzAZ09'.,!|<>&#-_\"`~ \t\n\v\f\r\0\x1c\x7f", *"\xe9\xc0\xdf\xff\xd7\xf7\xde\xfe\xaa\xb5\xba\xbd\xa0\x85\xc5\xb4", *"\u0301\u0338\u0153\u0152\u4e2d\u0661\u212a\u0130\u017f\ufb01\u3000\u200b", "\u0391\u03a3", "'s", "'LL", "</w>", "<|endoftext|>", "<|startoftext|>", "\U0001f1e9"]
    encoders = [encoder_of(n) for n in (3, 200, 100_000)]
    for k in (3, 6, 12, len(signs)):
        some = [rng.choice(signs, k, replace=False) for _ in range(9)]
        texts = ["".join(rng.choice(some[i % 9], n)) for i, n in enumerate(rng.integers(0, 50, 900))]
        expected = whole_text_ids(texts)
        for encoder in encoders:
            assert [i for j in range(0, 900, 100) for i in encoded(encoder, texts[j : j + 100])] == expected
    # Other tokenizers keep their words whole.
    spec = json.loads(encoders[0].tokenizer.tokenizer.to_str())
    assert token_files.byte_kinds(json.dumps(spec)) is not None
    assert token_files.byte_kinds(json.dumps(spec | {"normalizer": None})) is None
    assert token_files.byte_kinds(json.dumps(spec | {"pre_tokenizer": spec["pre_tokenizer"]["pretokenizers"][1]})) is None
    assert token_files.byte_kinds(json.dumps(spec | {"added_tokens": [spec["added_tokens"][0] | {"content": "abc"}]})) is None


# --- 12 prefix trie


def brute_trie(rows):
    """Nodes of (conv_id, turn, role, text) rows, by dictionary."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest(), text))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        s = (*own.get(base, [])[:h], *own[c][h:])
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
        ends[s].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in members.items()), key=repr)


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_prefix_trie(spark, parts):
    rng = np.random.default_rng(parts)
    rows = [(None, 0, "user", "lost"), (300, None, "user", "é🎉"), (300, 5, None, None), (300, 5, "user", "tie b"), (300, 5, "user", "tie a"), (300, 5, "user", "tie a"), (-7, 0, "a", "b"), (-107, 1, "a", "b"), (0, 9, "", "")]
    for c in range(1, 260):
        n = int(rng.integers(1, 9))
        if c % 3 == 0:  # a third are one conversation, or the beginnings of it
            rows += [(c, t, "user", f"same {t}") for t in range(min(n + 3, 8))]
        else:
            rows += [(c, t, ("user", "bot")[t % 2], f"{rng.integers(0, 3)} x") for t in range(n)]
    rows += [(900, t, "user", f"long {t}") for t in range(300)] + [(901, t, "user", f"long {t}") for t in range(280)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, node string, kind int").repartition(3, "turn")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = sorted((tuple(r) for r in prefix_trie.digest(table).collect()), key=repr)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute_trie(rows)
    assert prefix_trie.digest(table.limit(0)).count() == 0


def test_prefix_trie_stitches_long_runs():
    """Runs of equal conversations over many tasks, with pieces of their ids and paths that end at a border, swept by hand."""
    a, b, c = (hashlib.md5(x).digest() + (5).to_bytes(8) for x in (b"a", b"b", b"c"))
    rows = sorted([([a], i) for i in range(9000)] + [([a, b], 9000 + i) for i in range(5)] + [([a, b, c], 9100), ([b], 9200), ([c, a], 9201), ([c, a], 9202)])
    kinds = {"conv_id": pa.int64(), "turns": pa.list_(pa.binary())}
    results = []
    for cuts in ([], [1], [4000, 8000, 9001], [9000, 9005, 9006, 9007, 9008], list(range(8990, 9009))):
        out, edges = [], [0, *cuts, len(rows)]
        for part, (i, j) in enumerate(itertools.pairwise(edges)):
            with pytest.MonkeyPatch.context() as m:
                m.setattr(prefix_trie.TaskContext, "get", lambda part=part: type("T", (), {"partitionId": lambda self: part})())
                batch = pa.record_batch([pa.array([r[1] for r in rows[i:j]], kinds["conv_id"]), pa.array([r[0] for r in rows[i:j]], kinds["turns"])], list(kinds))
                out += [r for x in prefix_trie._sweep([batch]) for r in x.to_pylist()]
        nodes = [r for r in out if r["kind"] == prefix_trie.DONE]
        edge = sorted((r for r in out if r["kind"] != prefix_trie.DONE), key=lambda r: (r["part"], r["kind"], r["depth"], r["piece"]))
        nodes += [r for x in prefix_trie._stitch([pa.RecordBatch.from_pylist(edge[k : k + 3], prefix_trie.ARROW) for k in range(0, len(edge), 3)]) for r in x.to_pylist()]
        results.append(sorted((r["depth"], r["node"], r["parent"], r["n"], r["least"], r["children"], r["leaves"], r["saved"], r["ends"]) for r in nodes if r["depth"]))
    assert len(results[0]) == 6 and all(r == results[0] for r in results)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_dedup_broadcasts_no_exploded_table(spark, monkeypatch):
    """A table that is small on disk is not broadcast by Spark's own estimate, which leaves out what it is exploded to."""
    rows = [(i, i, [i // 2, 1000 + i]) for i in range(200)]
    table = spark.createDataFrame(rows, "id long, text_hash long, keys array<long>")
    want = {(i, i, i - 1, i - 1) for i in range(1, 200, 2)}
    for most, plan in ((0, "SortMergeJoin"), (1000, "BroadcastHashJoin")):
        monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", most)
        pairs = line_dedup._pairs(table)
        assert plan in plan_of(pairs) and ("Broadcast" in plan_of(pairs)) == bool(most)
        assert {tuple(r) for r in pairs.collect()} == want
    some = materialize(spark.range(50).withColumnRenamed("id", "key"), "some")
    for most, plan in ((49, "SortMergeJoin"), (50, "BroadcastHashJoin")):
        joined = common.sized_join(spark.range(90).withColumnRenamed("id", "key"), some, "key", most=most)
        assert plan in plan_of(joined) and joined.count() == 50


def test_written_tables_broadcast_little_by_themselves(spark, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    from kinfold import session

    seen, write, key = [], DataFrameWriter.parquet, session.AUTO_BROADCAST
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (seen.append(int(spark.conf.get(key))), write(self, *a, **k))[1])
    before = spark.conf.get(key)
    try:
        for value, want in (("10m", session.MOST_AUTO), ("-1", -1), ("64KB", 65536), ("1000b", 1000)):
            spark.conf.set(key, value)
            assert materialize(spark.range(3), "few").count() == 3
            assert seen.pop() == want and spark.conf.get(key) == value
    finally:
        spark.conf.set(key, before)
