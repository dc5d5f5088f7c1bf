"""Operators against plain Python, and the queries against SQL."""

import datetime
import glob
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold import plans
from kinfold.functions import distances, grids, rules
from kinfold.operators import batches, blocks, boxes, clustering, eviction, linalg, lsh, ordering, organize, packing, pairing, pivots, pyramids, radius, simhash
from kinfold.sources import archives, files
from kinfold.streaming import accesses, deltas, upsert

#: Queries that the quick run compares with SQL; KINFOLD_ALL=1 compares all.
QUICK = ["simhash_documents", "dedup_groups", "organize_actions", "rename_plan", "similar_items", "picture_hashes", "fusion_similarity", "validate_items", "bin_pack", "size_budget_evict", "cache_priority_cleanup", "error_stats", "pca_variance", "pca_neighbours", "access_state", "event_pairs", "merged_regions", "level_candidates", "pyramid_search", "level_comparison", "tiled_digest"]


def same(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(same, v))
    return v


@pytest.mark.parametrize("name", sorted(plans.SQL) if os.environ.get("KINFOLD_ALL") else QUICK)
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got, want = plans.QUERIES[name](spark, data), con.sql(plans.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    left = sorted((same(tuple(r[c] for c in columns)) for r in got.collect()), key=repr)
    right = sorted((same(tuple(r[i] for i in at)) for r in want.fetchall()), key=repr)
    assert left == right


def test_pooled_zeros_keep_their_sign(spark, tmp_path):
    """What is negative and rounds to zero is -0.0, as in SQL; equality of numbers does not tell."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = [[-1e-7] * 64, [1e-7] * 64, [0.0] * 64, [-0.25] * 64, [-4e-7 * (-1) ** i for i in range(64)]]
    pq.write_table(pa.table({"vec_id": list(range(5)), "embedding": pa.array(rows, pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    want = {i: repr(v) for i, v in con.sql(plans.SQL["average_pool"]).fetchall()}
    assert "-0.0" in want[0] and "-0.0" in want[4]
    assert {r.vec_id: repr(r.vector) for r in plans.QUERIES["average_pool"](spark, f"file://{tmp_path}").collect()} == want


def test_projected_zeros_keep_their_sign(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    # Every vector and its opposite, and one that is a millionth below the mean along each component.
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 64)) * np.where(np.arange(64) < 4, [5, 4, 3, 2] * 16, 0.1)
    v = np.linalg.eigh(np.cov(np.vstack([x, -x]).T))[1][:, -4:]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(4)])
    rows = [*x.tolist(), *(-x).tolist(), (-1e-6 * v.sum(1)).tolist()]
    pq.write_table(pa.table({"vec_id": list(range(len(rows))), "embedding": pa.array(rows, pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    want = {i: repr(v) for i, v in con.sql(plans.SQL["pca_projection"]).fetchall()}
    assert "-0.0" in want[80]
    assert {r.vec_id: repr(r.reduced) for r in plans.QUERIES["pca_projection"](spark, f"file://{tmp_path}").collect()} == want


def test_queries_without_sql_run(spark, data):
    rows = plans.QUERIES["even_batches"](spark, data).collect()
    assert len({r.id for r in rows}) == len(rows)


def greedy(n, edges):
    before = {i: set() for i in range(n)}
    for a, b in edges:
        before[b].add(a)
    led = []
    for i in range(n):
        if not before[i] & set(led):
            led.append(i)
    return set(led)


@pytest.mark.parametrize("seed", range(3))
def test_leaders_are_greedy(spark, seed):
    rng = np.random.default_rng(seed)
    edges = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 40, (60, 2)) if a != b} | {(i, i + 1) for i in range(41, 60)})
    nodes = {x for e in edges for x in e}
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.id for r in clustering.leaders(frame).collect()}
    assert got == greedy(61, edges) & nodes
    groups = clustering.disjoint_groups(frame).collect()
    assert {r.member for r in groups} == nodes - got
    assert all(r.leader == min(a for a, b in edges if b == r.member and a in got) for r in groups)


def test_near_pairs_are_exhaustive(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**32, (6, 2))
    rows = []
    for i in range(120):
        h, lo = (int(x) for x in base[i % 6])
        for b in rng.integers(0, 64, rng.integers(0, 9)):
            h, lo = (h ^ (1 << int(b)), lo) if b < 32 else (h, lo ^ (1 << (int(b) - 32)))
        rows.append((i, h, lo))
    classes = simhash.classes(spark.createDataFrame(rows, "id long, hi long, lo long"))
    kept = {r.id: (r.hi, r.lo) for r in classes.collect()}
    dist = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(kept[a], kept[b], strict=True))
    want = {(a, b, dist(a, b)) for a in kept for b in kept if a < b and dist(a, b) <= 6}
    assert {tuple(r) for r in simhash.near_pairs(classes, 6).collect()} == want
    assert {tuple(r)[:2] for r in simhash.band_pairs(classes, 4).filter("distance <= 3").collect()} == {(a, b) for a, b, d in want if d <= 3}


def signatures_near(seed, n=160):
    """Signatures around six centres, within eight flipped bits of them, and some anywhere."""
    rng = np.random.default_rng(seed)
    base = [int(x) for x in rng.integers(0, 2**63, 6)]
    rows = []
    for i in range(n):
        v = base[i % 6] if i % 5 else int(rng.integers(0, 2**63)) * 2 + 1
        for b in rng.integers(0, 64, rng.integers(0, 9)):
            v ^= 1 << int(b)
        rows.append((i, v >> 32, v & 0xFFFFFFFF))
    return rows


@pytest.mark.parametrize(("most", "n"), [(0, None), (2, 7), (3, 2), (6, 2), (6, 3), (6, 4), (6, 7), (6, None), (11, 3)])
def test_radius_search_is_exact(spark, most, n):
    rows = signatures_near(most)
    apart = lambda x, y: (x[1] ^ y[1]).bit_count() + (x[2] ^ y[2]).bit_count()
    frame = spark.createDataFrame(rows, "id long, hi long, lo long")
    got = sorted(tuple(r) for r in radius.pairs(frame, most, n, hot=5).collect())
    assert got == sorted((x[0], y[0], apart(x, y)) for x in rows for y in rows if x[0] < y[0] and apart(x, y) <= most)
    # Each pair once, of two tables too, where ids may be the same.
    other = signatures_near(most)[:70] + signatures_near(99, 30)
    got = sorted(tuple(r) for r in radius.within(spark.createDataFrame(other[:70], "id long, hi long, lo long"), frame, most, n).collect())
    assert got == sorted((x[0], y[0], apart(x, y)) for x in other[:70] for y in rows if apart(x, y) <= most)
    assert radius.pairs(frame.limit(0), most, n).count() == 0


def test_radius_is_spread_over_bands():
    for most in range(20):
        for n in range(1, most + 2):
            r = radius.radii(most, n)
            assert sum(x + 1 for x in r) == most + 1 and max(r) - min(r) <= 1
    assert radius.probes(6, 4) == 3 * 17 + 1 and len(set(radius.masks(21, 2))) == 1 + 21 + 210


def test_radius_search_meets_few(spark, data):
    """Candidates of bands of 16 bits, against seven bands with one key each."""
    data = data.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    classes = simhash.classes(simhash.simhash(docs, "doc_id", "text")).cache()
    met = {n: radius.candidates(classes, classes, 6, n).filter("a < b").count() for n in (3, 4, 7)}
    classes.unpersist()
    assert met[3] < met[4] < met[7] / 8


def brute_nearest(queries, rows, k, measure):
    out = []
    for q, x in queries:
        def score(y, x=x):
            if measure == "distance":
                return round(float(np.sqrt(((x - y) ** 2).sum())), 9)
            n = np.sqrt((x**2).sum()) * np.sqrt((y**2).sum())
            return round(float(x @ y / n), 9) if n else 0.0
        best = sorted(((score(y) * (-1 if measure == "cosine" else 1), i) for i, y in rows))[:k]
        out += [(q, r, i, abs(s) if measure == "distance" else -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("measure", ["distance", "cosine"])
def test_nearest_by_pivots_is_exact(spark, measure):
    """Clusters, a third of all rows copies of one vector, ties, zero vectors, rows that take no part."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6)) * 4
    x = [centres[i % 12] + rng.normal(size=6) * 0.2 for i in range(260)] + [centres[0]] * 140 + [np.zeros(6)] * 3 + list(rng.integers(0, 2, (30, 6)).astype(float))
    ids = [int(i) for i in rng.permutation(len(x))]
    odd = [(9001, None), (9002, [float("nan")] * 6), (9003, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 6), (9004, [float("inf")] * 6)]
    frame = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in zip(ids, x, strict=True)] + odd, "id long, vector array<double>").repartition(5)
    rows = list(zip(ids, x, strict=True))

    def check(found, expected):
        got = sorted((r.query_id, r["rank"], r.id, r.score) for r in found.collect())
        assert [g[:3] for g in got] == [e[:3] for e in expected]
        assert np.allclose([g[3] for g in got], [e[3] for e in expected], atol=1e-8)

    check(pivots.nearest(frame, frame, 6, measure, cell_rows=20, block_rows=16), brute_nearest(rows, rows, 6, measure))
    asked = [(10_000 + i, v) for i, v in enumerate([*x[250:255], np.zeros(6), np.ones(6) * 9, np.ones(6) * 9])]
    queries = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in asked], "id long, vector array<double>")
    check(pivots.nearest(queries, frame, 9, measure, cell_rows=20, block_rows=64), brute_nearest(asked, rows, 9, measure))
    assert pivots.nearest(queries, frame.limit(0), 3, measure).count() == 0 and pivots.nearest(frame.limit(0), frame, 3, measure).count() == 0
    # Fewer vectors than are asked for.
    assert pivots.nearest(queries.limit(1), frame.filter("id < 3"), 9, measure).count() == 3


@pytest.mark.parametrize("measure", ["distance", "cosine"])
def test_what_cells_do_not_rule_out_is_swept_in_blocks(spark, monkeypatch, measure):
    """Random directions: no query travels to every cell, and a block returns k rows for each query at most."""
    rng = np.random.default_rng(11)
    x = [*rng.normal(size=(300, 8)), *[np.ones(8)] * 40, np.zeros(8), *(rng.normal(size=(30, 8)) * 1e6), *rng.integers(0, 2, (60, 8)).astype(float)]
    rows = list(enumerate(x))
    frame = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], "id long, vector array<double>").repartition(4)
    seen, swept = [], pivots._swept
    monkeypatch.setattr(pivots, "_swept", lambda *a: (seen.append((*a[2:4], swept(*a))), seen[-1][-1])[1])
    for name, value in (("SWEPT_ROWS", 90), ("SWEEP_ROWS", 70), ("LEAST_SWEEP", 20)):
        monkeypatch.setattr(pivots, name, value)
    got = sorted((r.query_id, r["rank"], r.id, r.score) for r in pivots.nearest(frame, frame, 7, measure, cell_rows=12, block_rows=16).collect())
    want = brute_nearest(rows, rows, 7, measure)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-9, atol=1e-8)
    (q_blocks, v_blocks, answers), = seen
    assert q_blocks > 1 and v_blocks > 1 and answers.groupBy("q_key").count().agg(F.max("count")).first()[0] <= 7 * v_blocks


def test_pivots_rule_out_cells(spark):
    """Of clustered vectors a query meets few; of random directions all."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16)) * 3
    frame = lambda x: spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, vector array<double>")
    near = frame(centres[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 16)) * 0.1)
    _, visits, cells = pivots.search(near, near, 10, "distance", cell_rows=40)
    few = pivots.share(visits, cells)
    _, visits, cells = pivots.search(far := frame(rng.normal(size=(500, 64))), far, 10, "distance", cell_rows=40)
    assert few < 0.1 and pivots.share(visits, cells) <= 1


def test_distances(spark):
    row = spark.range(1).select(
        distances.hex_distance(F.lit("ff00"), F.lit("0f")).alias("hex"),
        distances.hex_distance(F.lit("8000000000000000"), F.lit("0")).alias("top"),
        distances.binary_distance(F.lit("0101"), F.lit("01")).alias("bin"),
        distances.binary_similarity(F.lit("0101"), F.lit("0111")).alias("sim"),
        distances.character_similarity(F.lit("abcd"), F.lit("abxd")).alias("chars"),
        distances.cosine(F.array(*map(F.lit, [1, 2, 3, 4, 5])), F.array(*map(F.lit, [5, 4, 3, 2, 1]))).alias("cos"),
        distances.cosine(F.array(F.lit(0), F.lit(0)), F.array(F.lit(1), F.lit(1))).alias("zero"),
        distances.hash_similarity(F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("int")).alias("none"),
        distances.hash_similarity(F.lit(64), F.lit(56), F.lit(64), normalized=True).alias("far"),
        distances.neighbour_similarity(F.lit(0.0), F.lit(0.0)).alias("self"),
        distances.fusion(F.lit(80.0), F.lit(None).cast("double"), F.lit(60.0)).alias("f"),
        distances.coarse_to_fine([F.lit(95.0)], 90.0).alias("one"),
    ).first()
    assert (row.hex, row.top, row.bin, row.sim, row.chars) == (12, 1, 2, 75.0, 75.0)
    assert math.isclose(row.cos, 35 / 55) and row.zero == 0 and row.none == 0 and row.self == 1 and row.one
    assert math.isclose(row.far, 0, abs_tol=1e-9)
    assert row.f.similarity == round(80 * 0.45 + 60 * 0.55, 1) and row.f.method == "fusion"


def test_grids(spark):
    rng = np.random.default_rng(1)
    g = rng.integers(0, 256, 64).tolist()
    frame = spark.createDataFrame([(g,)], "g array<int>").withColumn("m", grids.mean(F.col("g"))).withColumn("b", grids.block_means(F.col("g")))
    row = frame.select(grids.average_hash(F.col("g"), F.col("m")).alias("a"), grids.difference_hash(F.col("g")).alias("d"), grids.block_hash(F.col("g"), F.col("b")).alias("p"), grids.bilinear(F.col("g"), 8, 8, 4, 4).alias("r"), grids.bilinear(F.col("g"), 8, 8, 8, 8).alias("s"), grids.sobel(F.col("g")).alias("e")).first()
    x = np.array(g).reshape(8, 8)
    bits = lambda flags: sum(1 << i for i, f in enumerate(flags) if f)
    assert row.a & (2**64 - 1) == bits((x >= x.mean()).ravel())
    assert row.d == bits((x[:, :-1] > x[:, 1:]).ravel())
    means = x.reshape(4, 2, 4, 2).mean((1, 3)).repeat(2, 0).repeat(2, 1)
    assert row.p & (2**64 - 1) == bits((x > means).ravel())
    assert row.s == g and len(row.r) == 16 and row.r[0] == g[0] and row.r[-1] == g[-1]
    gx = x[:-2, 2:] - x[:-2, :-2] + 2 * (x[1:-1, 2:] - x[1:-1, :-2]) + x[2:, 2:] - x[2:, :-2]
    gy = x[2:, :-2] + 2 * x[2:, 1:-1] + x[2:, 2:] - x[:-2, :-2] - 2 * x[:-2, 1:-1] - x[:-2, 2:]
    assert np.abs(np.array(row.e) - np.minimum(255, np.hypot(gx, gy)).ravel()).max() <= 0.5


def test_vectors_shrink(spark):
    v = F.sequence(F.lit(0), F.lit(99))
    row = spark.range(1).select(rules.stride_sample(v, 0.2).alias("s"), rules.average_pool(v, 33).alias("p"), rules.gradient_sample(F.array(*map(F.lit, [0, 9, 9, 1, 1, 1])), 4).alias("g")).first()
    assert row.s == list(range(0, 100, 5))
    assert row.p == [np.mean(range(i, min(i + 4, 100))) for i in range(0, 100, 4)]
    assert row.g == [0, 9, 1]


def test_rules(spark):
    rows = [("a.jpg", "x", 5, 100, 100), ("b", "image/png", 5, 99, 100), ("c.txt", "x", 5, 200, 200), ("d.PNG", None, 0, 200, 200), ("e.png", "image/png", 20 * 2**20 + 1, 200, 200), (None, "x", 1, 1, 1), ("f.gif", None, 20 * 2**20, None, 5)]
    frame = spark.createDataFrame(rows, "name string, mime string, size long, w int, h int")
    got = [r.e for r in frame.select(rules.validation_error(*[F.col(c) for c in ("name", "mime", "size", "w", "h")]).alias("e")).collect()]
    assert got == [None, "too_small", "bad_format", "empty", "too_large", "missing", "corrupt"]
    row = spark.range(1).select(rules.format_bytes(F.lit(1536)).alias("b"), rules.format_seconds(F.lit(125)).alias("s"), rules.folder(F.lit("a/b/c.jpg")).alias("f"), rules.mime_of(F.lit("x.HEIC")).alias("m"), grids.round_half_up(F.lit(-2.5)).alias("r"), rules.adaptive_threshold(F.lit(90.0), F.lit("text"), F.lit(1.0), F.lit(0.01), F.lit(1)).alias("t")).first()
    assert (row.b, row.s, row.f, row.m, row.r, row.t) == ("1.50 KB", "2m 5s", "a/b", "image/heic", -2, 98.0)


def test_running_sums(spark):
    rng = np.random.default_rng(2)
    values = rng.integers(0, 50, 300).tolist()
    frame = spark.createDataFrame(list(enumerate(values)), "id long, v long").repartition(5)
    rows = ordering.running(frame, [F.desc("v"), F.col("id")], {"s": "v"}).orderBy("row_no").collect()
    order = sorted(enumerate(values), key=lambda r: (-r[1], r[0]))
    assert [(r.id, r.row_no, r.s) for r in rows] == [(i, k + 1, sum(x for _, x in order[: k + 1])) for k, (i, _) in enumerate(order)]
    assert rows[0].total_rows == 300 and rows[0].total_s == sum(values)


def test_evictions(spark):
    rng = np.random.default_rng(3)
    items = [(i, float(rng.integers(0, 9)), int(rng.integers(1, 30))) for i in range(80)]
    frame = spark.createDataFrame(items, "id long, priority double, size long")
    order, count, size, gone = sorted(items, key=lambda r: (r[1], r[0])), 80, sum(r[2] for r in items), []
    target = size * 0.6
    for i, _, s in order:
        if count - len(gone) <= math.floor(80 * 0.7) and size <= target:
            break
        gone.append(i)
        size -= s
    assert {r.id for r in eviction.least_wanted(frame, 0.7, 0.6).collect()} == set(gone)
    freed, old = 0, []
    for i, _, s in order:
        if freed >= 100:
            break
        freed += s
        old.append(i)
    assert {r.id for r in eviction.oldest_until(frame.withColumnRenamed("priority", "updated"), 100, 10**9).collect()} == set(old)


def greedy_batches(items, most_items, most_bytes):
    out = {}
    for lane in {r[2] for r in items}:
        batch, n, total = 0, 0, 0
        for i, s, _ in sorted((r for r in items if r[2] == lane), key=lambda r: (r[1] or 0, r[0])):
            s = s or 0
            if n and (n >= most_items or total + s > most_bytes):
                batch, n, total = batch + 1, 0, 0
            n, total = n + 1, total + s
            out[i] = batch
    return out


@pytest.mark.parametrize(("lanes", "block_rows", "fan"), [(["a"], 7, 2), (["a", "b"], 8, 3), (["a", "a", "a", "b", "c", None, ""], 6, 2), ([f"l{i}" for i in range(60)], 10, 2), (["a", "b"], 1000, 256)])
def test_packing_in_blocks(spark, lanes, block_rows, fan):
    rng = np.random.default_rng(len(lanes))
    items = [(i, None if i % 41 == 7 else int(rng.integers(0, 60)) if i % 23 else 500, lanes[i % len(lanes)]) for i in range(150)]
    frame = spark.createDataFrame(items, "id long, size long, lane string")
    for most_items, most_bytes in ((5, 120), (1, 10), (6, 10**6)):
        got = packing.packed(frame, most_items, most_bytes, block_rows, fan).collect()
        assert {r.id: r.batch for r in got} == greedy_batches(items, most_items, most_bytes)
        assert sorted((r.id, r.size, r.lane) for r in got) == sorted(items)
    assert packing.packed(frame.limit(0), 5, 120).count() == 0


def test_batches_are_evened(spark):
    moved = {r.id: r.batch for r in batches.evened(spark.createDataFrame([(1, 0, 90), (2, 0, 50), (3, 1, 10), (4, 2, 60)], "id long, batch int, cost long")).collect()}
    assert moved == {1: 1, 2: 0, 3: 1, 4: 2} or moved[1] != 0


def test_blocks_match_whole(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 6))
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<double>")
    got = {(r.query_id, r.id): r.score for r in blocks.compared(frame, frame, "cosine", block_rows=20).collect()}
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert len(got) == 8100 and all(abs(got[i, j] - (n[i] @ n[j])) < 1e-9 for i, j in got)
    top = blocks.compared(frame, frame, "distance", 5, smallest=True, block_rows=20).collect()
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    assert all(r.id == np.argsort(d[r.query_id], kind="stable")[r["rank"] - 1] or r["rank"] == 1 for r in top)


def test_blocks_travel_packed(spark):
    """What is shuffled before two blocks meet is a row for each pair of blocks and side, not one for each vector and block."""
    frame = spark.range(90).select("id", F.array(F.lit(1.0).cast("float"), F.col("id").cast("float")).alias("vector"))
    packed = blocks._packed(frame, 3, 4, "q").collect()
    assert len(packed) == 12 and sum(len(r.ids) for r in packed) == 4 * 90 * 8 and sum(len(r.vectors) for r in packed) == 4 * 90 * 2 * 4
    got = blocks.compared(frame, frame, "dot", block_rows=31, digits=0)
    assert {(r.query_id, r.id): r.score for r in got.collect()} == {(i, j): 1.0 + i * j for i in range(90) for j in range(90)}
    assert blocks.compared(frame.limit(0), frame, "dot").count() == 0
    assert repr(blocks.halves_up(np.array([-4e-7, 4e-7, 0.0000025, -0.0000015, 2.0]), 6).tolist()) == "[-0.0, 0.0, 3e-06, -2e-06, 2.0]"
    with pytest.raises(Exception, match="different lengths"):
        blocks.compared(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, vector array<double>"), frame, "dot").count()


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_distances_are_counted_in_blocks(spark, monkeypatch, block_rows):
    """Pairs of rows stay in the tasks: what they return is some numbers for each pair of blocks."""
    rng = np.random.default_rng(block_rows)
    bits = [int(v) for v in rng.integers(-(2**63), 2**63 - 1, 60)] + [-1, 0, 0, 2**63 - 1]
    rows = [(i % 61, b) for i, b in enumerate(bits)]
    want = {}
    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if a != b:
                k = ((x ^ y) & (2**64 - 1)).bit_count()
                want[k] = want.get(k, 0) + 1
    monkeypatch.setattr(blocks, "compared", None)
    frame = spark.createDataFrame([*rows, (None, 5), (99, None)], "id long, bits long")
    got = blocks.distance_counts(frame, block_rows)
    assert {r.distance: r.pairs for r in got.collect()} == want and got.dtypes == [("distance", "int"), ("pairs", "bigint")]
    assert blocks.distance_counts(frame.limit(0)).count() == 0
    for n, m in ((1, 1), (9, 3), (8, 4)):
        x, y = (rng.integers(0, 2**63, k).astype(np.uint64) for k in (n, m))
        assert blocks.bit_counts(x, y).tolist() == np.bincount(np.bitwise_count(x[:, None] ^ y[None]).ravel(), minlength=65).tolist()


@pytest.mark.parametrize("name", ["hamming_histogram", "hash_distance_histogram"])
def test_histograms_make_no_rows_of_pairs(spark, data, monkeypatch, name):
    monkeypatch.setattr(blocks, "compared", None)
    assert sum(r.pairs for r in plans.QUERIES[name](spark, data).collect()) > 1000


def test_linalg(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(50, 5))
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    c = np.zeros((5, 5))
    for r in linalg.covariance(frame, "v").collect():
        c[r.i, r.j] = r.v
    assert np.allclose(c, np.cov(x.T))
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    found = linalg.principal_components(frame, "v", 3)
    assert np.allclose([r.share for r in found.shares(spark).orderBy("component").collect()], (values / values.sum())[:3])
    assert np.allclose(found.vectors @ found.vectors.T, np.eye(3)) and np.allclose(np.cov(x.T) @ found.vectors.T, found.vectors.T * found.variance)
    odd = frame.union(spark.createDataFrame([(98, None), (99, [1.0, None, 1.0, 1.0, 1.0])], frame.schema))
    got = {r.id: r.p for r in odd.select("id", found.project(F.col("v")).alias("p")).collect()}
    assert got[98] is None and got[99] is None and np.allclose([got[i] for i in range(50)], (x - x.mean(0)) @ found.vectors.T)
    assert np.allclose(linalg.principal_components(odd, "v", 3).vectors, found.vectors)
    with pytest.raises(ValueError, match="vectors"):
        linalg.principal_components(frame.limit(0), "v", 3)
    gram = np.zeros((5, 5))
    for r in linalg.gram(frame, "v").collect():
        gram[r.i, r.j] = r.v
    assert np.allclose(gram, x.T @ x)
    assert len(lsh.probes(8, 2)) == 3


def test_leading_vectors_of_odd_matrices():
    rng = np.random.default_rng(3)
    for values in ([5, 4, 3, 2, 1, 0.5], [2, 2, 2, 1, 1, 0], [1, 0, 0, 0, 0, 0], [0] * 6, [1 + 1e-6, 1, 0.5, 0.4, 0.3, 0.2]):
        u = np.linalg.qr(rng.normal(size=(6, 6)))[0]
        c = u * values @ u.T
        for k in (1, 3, 6):
            got, v = linalg.leading(c, k)
            assert np.allclose(got, values[:k], atol=1e-9) and np.allclose(c @ v, v * got, atol=1e-9) and np.allclose(v.T @ v, np.eye(k))


def test_components_are_saved(spark, tmp_path):
    found = linalg.principal_components(spark.createDataFrame([([float(i % 7), float(i * i % 5), 1.0],) for i in range(20)], "v array<double>"), "v", 2)
    found.save(spark, f"file://{tmp_path}/pca")
    again = linalg.Components.load(spark, f"file://{tmp_path}/pca")
    assert again.total == found.total and all(np.array_equal(getattr(again, a), getattr(found, a)) for a in ("mean", "variance", "vectors"))


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("a.jpg", "b.png", "c.txt"):
        (tmp_path / "in" / n).write_bytes(n.encode())
    got = {r.name: (r.mime, r.size, r.b) for r in files.read_files(spark, f"file://{tmp_path}/in").withColumn("b", files.as_base64(F.col("content"))).collect()}
    assert got == {"a.jpg": ("image/jpeg", 5, "YS5qcGc="), "b.png": ("image/png", 5, "Yi5wbmc=")}
    rows = spark.createDataFrame([(i, i, 10) for i in range(10)], "id long, last_used long, size long")
    files.write_cache(rows, f"file://{tmp_path}/cache", most_bytes=35)
    assert sorted(r.id for r in files.read_cache(spark, f"file://{tmp_path}/cache", "id long, last_used long, size long").collect()) == [7, 8, 9]
    metrics = spark.createDataFrame([("x", {"a": 1.0}), ("y", {"b": 2.0})], "name string, figures map<string,double>")
    files.write_metrics_csv(metrics, f"file://{tmp_path}/csv")
    assert spark.read.option("header", "true").csv(f"file://{tmp_path}/csv").columns == ["name", "a", "b"]
    acted = spark.createDataFrame([(i, "keep" if i % 3 else "delete") for i in range(9)], "id long, action string")
    files.write_organized(acted, rows.select("id", "size"), spark.createDataFrame([("{}",)], "report string"), f"file://{tmp_path}/out", part_rows=4)
    out = spark.read.parquet(f"file://{tmp_path}/out/items")
    assert out.count() == 9 and {r.part for r in out.select("part").distinct().collect()} == {0, 1, 2}


def test_keyed_table_and_stream(spark, tmp_path):
    schema = "id long, v string, at long"
    table = upsert.KeyedTable(spark, f"file://{tmp_path}/table", ["id"], schema)
    assert table.read().count() == 0
    table.upsert(spark.createDataFrame([(1, "a", 1), (2, "b", 1), (1, "c", 2)], schema), ["at"])
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(2, "new", 5), (3, "d", 1)], schema).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
    for _ in range(2):
        query = table.stream(stream, ["at"], f"file://{tmp_path}/checkpoint")
        query.processAllAvailable()
        query.stop()
    assert {r.id: r.v for r in table.read().collect()} == {1: "c", 2: "new", 3: "d"}
    before = table.versions()
    table.upsert(spark.createDataFrame([(9, "again", 1)], schema), ["at"], version=before[-1])
    assert table.versions() == before
    table.delete(spark.createDataFrame([(1,)], "id long"))
    assert {r.id for r in table.read().collect()} == {2, 3}
    assert upsert.maintenance_due(4000, 0, 30) and not upsert.maintenance_due(4000, 0, 3)
    assert [upsert.rebuild_due(n) for n in (0, 49, 50, 250)] == ["none", "none", "update", "rebuild"]


def test_cosine_hash_and_boxes(spark):
    rng = np.random.default_rng(8)
    g = rng.integers(0, 256, (32, 32))
    frame = spark.createDataFrame([(g.ravel().tolist(),)], "g array<int>")
    row = frame.select(grids.cosine_hash(F.col("g")).alias("h"), grids.cosine_hash(F.col("g"), high_first=True).alias("m")).first()
    low = np.zeros((8, 8))
    at = np.arange(32)
    for v in range(8):
        for u in range(8):
            wave = np.cos((2 * at[:, None] + 1) * v * np.pi / 64) * np.cos((2 * at[None] + 1) * u * np.pi / 64)
            low[v, u] = (g * wave).sum() * (1 if u == 0 else 2**0.5) * (1 if v == 0 else 2**0.5) / 32
    flags = low.ravel() > low.ravel()[1:].mean()
    assert row.h == sum(1 << (i - 1) for i in range(1, 64) if flags[i])
    assert row.m == sum(1 << (63 - i) for i in range(1, 64) if flags[i])
    boxes = [(0, 0, 2, 2, 0.5), (1, 1, 3, 3, 0.9), (4, 0, 1, 1, 0.1), (3, 3, 4, 4, 0.2)]
    frame = spark.createDataFrame([([dict(zip(("x", "y", "width", "height", "weight"), b, strict=True)) for b in boxes],)], "b array<struct<x:int,y:int,width:int,height:int,weight:double>>")
    assert [tuple(b) for b in frame.select(grids.merged_boxes(F.col("b")).alias("m")).first().m] == [(0, 0, 7, 7, 0.9)]


def test_delta_table(spark, tmp_path):
    """Against a dictionary: upserts, tombstones, parents, merging, rebuilding, and what is written for few rows."""
    schema = "id long, parent string, v string, at long"
    table = deltas.DeltaTable(spark, f"file://{tmp_path}/t", ["id"], schema, buckets=8)
    frame = lambda rows: spark.createDataFrame(rows, schema)
    state = lambda: {r.id: tuple(r) for r in table.read().collect()}
    assert state() == {} and table.compact() == "none" and table.rebuild() is None
    rng, want = np.random.default_rng(1), {}

    def upsert(ids, batch=None):
        rows = [(None if i == 17 else int(i), f"p{i % 4}", f"v{rng.integers(99)}", k) for k, i in enumerate(ids)]
        want.update({r[0]: r for r in rows})
        table.upsert(frame(rows), ["at"], batch)

    upsert(range(100))
    table.rebuild()
    assert [v.kind for v in table.versions()] == ["base"] and state() == want
    upsert([3, 3, 200, 17])
    written = {f.split("_bucket=")[1].split("/")[0] for f in glob.glob(f"{tmp_path}/t/{table.versions()[-1].name}/*/*.parquet")}
    places = {str(r[0]) for r in frame([(i, "", "", 0) for i in (3, 200, None)]).select(F.pmod(F.xxhash64("id"), F.lit(8))).collect()}
    assert written == places and state() == want
    table.delete(spark.createDataFrame([(5,), (None,), (999,)], "id long"))
    for i in (5, None):
        want.pop(i)
    assert state() == want and table.compact(every=6, times=50) == "none" and table.compact(every=3, times=50) == "update"
    assert [v.kind for v in table.versions()] == ["base", "delta"] and state() == want
    table.delete_children(spark.createDataFrame([("p2",)], "parent string"), "parent")
    want = {k: r for k, r in want.items() if r[1] != "p2"}
    upsert([5, 2])
    assert state() == want
    assert {tuple(r) for r in table.get([(2,), (3,), (6,), (7,)]).collect()} == {want[i] for i in (2, 3, 7)}
    assert table.compact(every=5, times=5) == "rebuild" and [v.kind for v in table.versions()] == ["base"] and state() == want
    assert table.vacuum() > 3 and state() == want and len(os.listdir(f"{tmp_path}/t")) == 1
    # A version without Spark's mark is not there; a batch is applied once, after a rebuild too.
    os.makedirs(f"{tmp_path}/t/v=900.base.0.0")
    assert state() == want
    upsert([1], batch=4)
    table.rebuild()
    assert table.upsert(frame([(1, "x", "again", 9)]), ["at"], batch=4) is None and state() == want


def test_delta_table_cleans_up(spark, tmp_path):
    table = deltas.DeltaTable(spark, f"file://{tmp_path}/t", ["id"], "id long, size long")
    table.upsert(spark.createDataFrame([(i, 10 if i < 50 else 1) for i in range(90)], "id long, size long"), ["size"])
    size, order = F.col("size"), [F.col("id")]
    assert table.clean_up(order, 3, size, 100, 10**6) == 0 and table.clean_up(order, 30, size, 200, 10**6) == 0
    assert table.clean_up(order, 30, size, 100, 10**6) == 20 and table.read().count() == 70
    # 30 rows of 10 bytes and 40 of one: 340 bytes; 0.7 of 400 leaves 280.
    assert table.clean_up(order, 30, size, 1000, 400) == 6
    assert sorted(r.id for r in table.read().collect()) == list(range(26, 90))


def test_delta_table_takes_a_stream(spark, tmp_path):
    schema = "id long, v long"
    table = deltas.DeltaTable(spark, f"file://{tmp_path}/t", ["id"], schema, buckets=4)
    for start in (0, 5, 3):
        spark.createDataFrame([(i, start) for i in range(start, start + 6)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        table.stream(source, ["v"], f"{tmp_path}/checkpoint", every=4, times=2).awaitTermination(1)
        for q in spark.streams.active:
            q.processAllAvailable()
            q.stop()
    assert {r.id: r.v for r in table.read().collect()} == {**{i: 0 for i in range(3)}, **{i: 3 for i in range(3, 9)}, 9: 5, 10: 5}


def test_access_stream(spark, tmp_path):
    """Batches with a hot key, late and incomplete rows, one run for each from the checkpoint; idle keys go and come back."""
    rng = np.random.default_rng(8)
    zero = datetime.datetime(2024, 1, 1)
    at = lambda s: zero + datetime.timedelta(seconds=int(s))
    files = []
    for day in range(2):
        rows = [(int(k) if (k := rng.integers(0, 6)) < 4 else 0, at(day * 86400 + rng.integers(0, 4000)), day * 1000 + i, None if i % 9 == 4 else float(rng.integers(0, 50))) for i in range(400)]
        files.append(rows + [(None, at(5), 7, 1.0), (1, None, 8, 1.0)])
    files[0] += [(9, at(10), 5001, None), (8, at(20), 5002, 2.0), (2, at(30), 5003, 3.0), (2, at(30), 5003, 3.0)]
    files.append([(9, at(86400 + 4100), 6001, 4.0), (0, at(86400 + 10), 6002, 40.0), (3, at(15), 6003, 1.0)])
    schema = "key long, at timestamp, id long, value double"
    want, found = {}, []
    state = accesses.table_of(spark, f"file://{tmp_path}/state", buckets=4)
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        source = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
        changes = accesses.tracked(source, datetime.timedelta(hours=4), "2 hours")
        accesses.start(changes, state, f"file://{tmp_path}/progress", once=True).awaitTermination()
        for r in rows:
            # The row of 3 in the last file is behind the watermark.
            if r[0] is not None and r[1] is not None and r[2] != 6003:
                want.setdefault(r[0], []).append((r[1], r[2], r[3]))
        newest = max(x[0] for v in want.values() for x in v)
        want = {k: v for k, v in want.items() if max(v)[0] > newest - datetime.timedelta(hours=6)}
        out = {}
        for k, v in want.items():
            ring = sorted(v, key=lambda x: x[:2])[-100:]
            recent = [x[2] for x in ring[-10:] if x[2] is not None]
            out[k] = (len(v), ring[-1][0], sum(recent) / len(recent) if recent else None, len(ring), ring[0][0])
        got = {r.key: tuple(r)[1:] for r in state.read().select("key", "uses", "last_used", "mean_value", "kept", "oldest").collect()}
        assert got == out
        found.append(set(got))
    assert 9 in found[0] and 9 not in found[1] and 9 in found[2] and 8 not in found[2]


@pytest.mark.parametrize(("keys", "up"), [(1, 0.5), (1, 0.8), (3, 0.3), (40, 0.5)])
def test_starts_and_ends_pair_as_brackets(spark, keys, up):
    rng = np.random.default_rng(keys)
    rows = [(f"k{k}" if (k := rng.integers(0, keys)) else "k0", int(rng.integers(0, 150)), i, "start" if rng.random() < up else "end") for i in range(300)]
    other = [(None, 3, 900, "start"), ("k0", None, 901, "end"), ("k0", 5, 902, "else")]
    frame = spark.createDataFrame(rows + other, "key string, at long, id long, what string")
    want = []
    for key in {r[0] for r in rows}:
        stack = []
        for _, at, i, what in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3]):
            if what == "start":
                stack.append((i, at))
            else:
                s, t = stack.pop() if stack else (None, None)
                want.append((key, s, i, t, at))
        want += [(key, s, None, t, None) for s, t in stack]
    got = [tuple(r) for r in pairing.paired(frame, F.col("what") == "start", F.col("what") == "end").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert pairing.paired(frame.limit(0), F.col("what") == "start", F.col("what") == "end").count() == 0


def test_archives_are_published_whole(spark, tmp_path):
    path = f"file://{tmp_path}/zips"
    rows = [(i, None if i == 6 else "keep" if i % 3 else "delete", "same.jpg" if i % 2 else f"{i}", None if i == 5 else bytes([i]) * i) for i in range(23)]
    items = spark.createDataFrame(rows, "id long, folder string, name string, content binary")

    def fail(frames):
        for frame in frames:
            if (frame.id == 22).any():
                raise RuntimeError("lost")
            yield frame

    with pytest.raises(Exception, match="lost"):
        archives.write_archives(items.repartition(8).mapInPandas(fail, items.schema), path, part_rows=5)
    with pytest.raises(FileNotFoundError):
        archives.read_archives(spark, path)
    archives.write_archives(items, path, report="{}", part_rows=5)
    got = [tuple(r) for r in archives.read_archives(spark, path).collect()]
    want = sorted(rows, key=lambda r: (r[1] or "other", r[0]))
    assert sorted((part, folder, content) for part, folder, _, content in got) == sorted((k // 5, r[1] or "other", r[3] or b"") for k, r in enumerate(want))
    assert len({r[:3] for r in got}) == 23 and {r[2] for r in got if r[2].startswith("same")} >= {"same.jpg", "same (2).jpg"}
    report = archives.read_report(path)
    assert report["report"] == "{}" and [p["items"] for p in report["parts"]] == [5, 5, 5, 5, 3]
    # A later report takes the place of the first; a writer that is given up leaves nothing.
    archives.write_archives(items.limit(3), path)
    assert archives.read_archives(spark, path).count() == 3
    writer = archives.ZipWriter(f"{path}2", "")
    done = writer.write(iter(spark.createDataFrame([(0, "a", "b", b"c")], archives.ITEM).collect()))
    assert done.parts[0]["items"] == 1 and len(os.listdir(f"{tmp_path}/zips2")) == 1
    writer.abort([done])
    assert not os.listdir(f"{tmp_path}/zips2")
    with pytest.raises(ValueError, match="unique"):
        archives.write_archives(items.union(items), path)


def test_files_that_fail_are_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, c in (("a.jpg", b"ok"), ("b b.png", b"bad"), ("c.gif", b""), ("d.jpg", b"gone")):
        (tmp_path / "in" / n).write_bytes(c)

    def decode(content):
        if content == b"bad":
            raise ValueError("damaged")
        return content.upper()

    found = archives.read_or_error(spark, f"file://{tmp_path}/in", decode=decode)
    (tmp_path / "in" / "d.jpg").unlink()
    got = {r.name: (r.content, r.error and r.error.error, r.mime) for r in found.collect()}
    assert got == {"a.jpg": (b"OK", None, "image/jpeg"), "b b.png": (None, "ValueError", "image/png"), "c.gif": (b"", None, "image/gif"), "d.jpg": (None, "FileNotFoundError", "image/jpeg")}


def closed(rows):
    """Boxes (x, y, width, height, weight) merged one pair at a time."""
    rows = [(x, y, x + w, y + h, v) for x, y, w, h, v in rows]
    again = True
    while again:
        again = False
        for i in range(len(rows)):
            for j in range(i):
                a, b = rows[i], rows[j]
                if a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]:
                    weight = max((v for v in (a[4], b[4]) if v is not None), default=None)
                    rows = [r for k, r in enumerate(rows) if k not in (i, j)] + [(min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]), weight)]
                    again = True
                    break
            if again:
                break
    return sorted(((x, y, r - x, low - y, v) for x, y, r, low, v in rows), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_merged_boxes_are_the_fixpoint(spark, seed):
    """Against merging pair by pair: many small items, one that holds most boxes, sides of all sizes, chains over batches."""
    r = np.random.default_rng(seed)
    rows = []
    for item in range(30):
        for _ in range(int(r.integers(0, 12))):
            rows.append((item, *(float(v) for v in r.integers(-20, 20, 2)), *(float(v) for v in r.integers(1, 8, 2)), float(r.random())))
    for _ in range(350):
        side = float(2.0 ** r.integers(-2, 6))
        rows.append((99, *(float(v) for v in r.uniform(-1500, 1500, 2)), side, side * float(r.uniform(0.2, 1)), float(r.random())))
    # A staircase: each box meets the next only.
    rows += [(77, 2.0 * i, 2.0 * i, 3.0, 3.0, i / 100) for i in range(60)]
    rows += [(None, 0.0, 0.0, 2.0, 2.0, None), (None, 1.0, 1.0, 2.0, 2.0, 0.5), (None, 3.0, 3.0, 1.0, 1.0, None)]
    rows += rows[:20]
    bad = [(1, None, 0.0, 1.0, 1.0, 0.1), (1, 0.0, 0.0, 0.0, 5.0, 0.1), (1, 0.0, 0.0, 1.0, -1.0, 0.1), (1, float("nan"), 0.0, 1.0, 1.0, 0.1), (1, 0.0, float("inf"), 1.0, 1.0, 0.1)]
    schema = "id long, x double, y double, width double, height double, weight double"
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = boxes.merge_boxes(spark.createDataFrame(rows + bad, schema).withColumn("left", F.lit("further"))).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    have, want = {}, {}
    for g in got:
        have.setdefault(g.id, []).append(same((g.x, g.y, g.width, g.height, g.weight)))
    for g in rows:
        want.setdefault(g[0], []).append(g[1:])
    assert {k: sorted(v, key=repr) for k, v in have.items()} == {k: sorted((same(b) for b in closed(v)), key=repr) for k, v in want.items()}
    assert boxes.merge_boxes(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("hot", [4096, 3])
def test_code_pairs_come_once_without_a_shuffle_of_pairs(spark, hot):
    """A pair that meets in several tables is kept in the first; no exchange stands above the join."""
    rng = np.random.default_rng(hot)
    tables = [lsh.Meeting(), lsh.Meeting((0, 1, 2)), lsh.grid_steps(2, 1)]
    cells = rng.integers(-2, 3, (70, 2))
    codes = [[int(rng.integers(0, 9)), int(rng.integers(0, 40)), int(((c + 5) << np.array([0, 30])).sum())] for c in cells]
    meets = [lambda p, q: p == q, lambda p, q: p ^ q in (0, 1, 2), lambda p, q: abs(q - p) <= 1]
    want = {(i, j) for i in range(70) for j in range(i + 1, 70) if any(m(p, q) for m, p, q in zip(meets, codes[i], codes[j], strict=True))}
    frame = spark.createDataFrame(list(enumerate(codes)), "id long, codes array<long>")
    got = lsh.code_pairs(frame, tables, hot)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Exchange" not in plan.partition("Join")[0] and "Aggregate" not in plan
    assert sorted(map(tuple, got.collect())) == sorted(want)
    # Repeated rows, an id of two vectors, none.
    odd = frame.union(frame.limit(9)).union(spark.createDataFrame([(3, codes[60]), (None, codes[1])], frame.schema))
    more = want | {(min(3, j), max(3, j)) for i, j in [(60, k) for k in range(70)] if j != 3 and any(m(p, q) for m, p, q in zip(meets, codes[i], codes[j], strict=True))}
    assert sorted(map(tuple, lsh.code_pairs(odd, tables, hot).collect())) == sorted(more)
    assert lsh.code_pairs(frame.limit(0), tables, hot).count() == 0
    with pytest.raises(ValueError, match="opposite"):
        lsh.Meeting((0, 1), flips=False)


def test_level_candidates(spark):
    """Against plain sets: prefixes shorten only for items with too few others; copies count; empty buckets have no candidates."""
    r = np.random.default_rng(5)
    bits, levels, want = 6, 5, 4
    rows = [(i, int(r.integers(1, 3)), [(t, int(r.integers(0, 1 << bits) if i % 3 else 5)) for t in range(2)]) for i in range(60)] + [(90, 1, []), (91, 1, None)]
    got = lsh.level_candidates(spark.createDataFrame(rows, "id long, copies int, buckets array<struct<table:int,bucket:long>>"), bits, levels, want).collect()
    plain = set()
    live = [x for x in rows if x[2]]
    for i, _, mine in live:
        for level in range(levels):
            mask = (1 << (bits - level)) - 1
            met = [(j, n) for j, n, other in live if j != i for (_, a), (_, b) in zip(mine, other, strict=True) if a & mask == b & mask]
            if sum(n for _, n in met) >= want or level == levels - 1:
                plain |= {(i, j, level) for j, _ in met}
                break
    assert {tuple(g) for g in got} == plain and len(got) == len(plain)
    assert len({g.level for g in got}) > 1


def halved(g, least):
    h, w = (max(min(n, least), (n + 1) // 2) for n in g.shape)
    out = np.zeros((h, w), int)
    for y in range(h):
        for x in range(w):
            ys, xs = [min(2 * y + k, g.shape[0] - 1) for k in (0, 1)], [min(2 * x + k, g.shape[1] - 1) for k in (0, 1)]
            if h == g.shape[0] or w == g.shape[1]:
                raise AssertionError("no level keeps a side")
            out[y, x] = (sum(g[a, b] for a in ys for b in xs) + 2) // 4
    return out


def test_pyramids_and_tiles(spark):
    """Against numpy: odd sides, one pixel, wrong and null pixels, tiles at the rim."""
    import hashlib

    r = np.random.default_rng(3)
    pictures = {1: r.integers(0, 256, (13, 9)), 2: r.integers(0, 256, (16, 16)), 3: r.integers(0, 256, (1, 1)), 4: r.integers(0, 256, (11, 12))}
    rows = [(i, g.shape[1], g.shape[0], g.ravel().tolist()) for i, g in pictures.items()] + [(7, 2, 2, [1]), (8, 2, 2, None), (9, None, 2, [1, 2]), (10, 0, 0, [])]
    frame = spark.createDataFrame(rows, "id long, width int, height int, pixels array<int>")
    got = {(g.id, g.level): (g.width, g.height, g.pixels) for g in pyramids.levels(frame, most=3, least_side=3).collect()}
    want = {}
    for i, g in pictures.items():
        want[i, 2] = g
        for level in (1, 0):
            if max(max(min(n, 3), (n + 1) // 2) for n in g.shape) <= 3:
                break
            g = want[i, level] = halved(g, 3)
    assert got == {k: (g.shape[1], g.shape[0], g.ravel().tolist()) for k, g in want.items()} and (1, 0) in got and (3, 1) not in got
    cut = pyramids.tiles(frame, 5, 2)
    have = {(t.id, t.x, t.y): (t.width, t.height, t.pixels) for t in cut.collect()}
    plain = {}
    for i, g in pictures.items():
        for y in range(0, g.shape[0], 3):
            for x in range(0, g.shape[1], 3):
                part = g[y : y + 5, x : x + 5]
                plain[i, x, y] = (part.shape[1], part.shape[0], part.ravel().tolist())
    assert have == plain
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for row in pyramids.segmented(cut).collect():
        places = sorted((y, x) for i, x, y in plain if i == row.id)
        assert row.tiles == len(places) and row.digest == sha("".join(sha(",".join(map(str, plain[row.id, x, y][2]))) for y, x in places))


def test_search_from_coarse_to_fine(spark):
    """Against a loop: early verdicts, levels that are missing, repeated pairs, one level, none."""
    r = np.random.default_rng(8)
    hashes = {(i, level): int(r.integers(0, 2 ** (4 << level))) & (3 if i % 2 else -1) for i in range(12) for level in range(3) if not (i == 3 and level == 2) and i != 5}
    hashed = spark.createDataFrame([(i, level, 4 << level, h) for (i, level), h in hashes.items()], "id long, level int, bits int, hash long")
    pairs = [(i, j) for i in range(12) for j in range(i)]
    frame = spark.createDataFrame(pairs + pairs[:5], "a long, b long")

    def plain(levels):
        out = {}
        for i, j in pairs:
            passes, at, last = None, None, None
            for level in levels:
                x, y = hashes.get((i, level)), hashes.get((j, level))
                if x is None or y is None:
                    continue
                at, last = level, 100 * (1 - (x ^ y).bit_count() / (4 << level))
                if last < (70 * (0.7 + 0.3 * level / levels[-1]) if len(levels) > 1 else 70):
                    passes = False
                elif last > 75 or level == levels[-1]:
                    passes = True
                if passes is not None:
                    break
            out[i, j] = (at, last, at is not None if passes is None else passes)
        return out

    for levels in ([0, 1, 2], [2]):
        got = pyramids.search(frame, hashed.filter(F.col("level").isin(levels)), 70.0).collect()
        assert len(got) == len(pairs) and {(g.a, g.b): same((g.level, g.similarity, g.passes)) for g in got} == {k: same(v) for k, v in plain(levels).items()}
    assert {g.passes for g in pyramids.search(frame, hashed.limit(0), 70.0).collect()} == {False}


def test_dots_of_columns_are_those_of_rows(spark, data):
    rng = np.random.default_rng(4)
    rows = [([float(v) for v in rng.normal(size=n)], [float(v) for v in rng.normal(size=n)]) for n in [64] * 50 + [3] * 9 + [0]] + [(None, [1.0]), ([1.0], None)]
    frame = spark.createDataFrame(rows, "a array<float>, b array<float>")
    got = frame.select(distances.dots(F.col("a"), F.col("b")).alias("x"), distances.dot(F.col("a"), F.col("b")).alias("y")).collect()
    assert len(got) == 62 and all(r.x == r.y for r in got)
    # No pair of the comparison adds its components in an interpreted lambda.
    plan = plans.QUERIES["level_comparison"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan.lower() and "added(" in plan


def test_comparison_by_level(spark):
    schema = "a int, d int, p int, feature double, raw double"
    rows = [(8, 7, 16, 90.0, 50.0), (8, 7, 16, 10.0, 50.0), (None, None, None, 90.0, 50.0), (None, None, None, None, 50.0), (None, 7, None, None, 50.0), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, schema)
    at = lambda level: [tuple(r.v) for r in frame.select(distances.at_level(level, *[F.col(c) for c in ("a", "d", "p", "feature", "raw")], 90.0).alias("v")).collect()]
    assert [m for _, m in at("basic")] == ["basic_hash", "basic_hash", "fallback_feature", "fallback_feature", "fallback_hash", "no_data"]
    assert [v for v, _ in at("basic")] == [75.0, 75.0, 50.0, 50.0, 87.5, 0.0]
    assert [m for _, m in at("standard")] == ["weighted_hash", "weighted_hash", "fallback_feature", "fallback_feature", "weighted_hash", "no_data"]
    assert [m for _, m in at("advanced")] == ["advanced_hash", "advanced_hash", "fallback_feature", "fallback_feature", "advanced_hash", "no_data"]
    assert [m for _, m in at("professional")] == ["feature_and_hash", "feature_only_low", "feature_only", "fallback_feature", "advanced_hash", "no_data"]
    mean = 8 * 0.25 + 7 * 0.35 + 16 * 0.4
    assert at("professional")[0][0] == pytest.approx(90 * 0.6 + 100 * (1 - mean / 184) * 0.4)
    with pytest.raises(ValueError):
        distances.at_level("utmost", *[F.lit(None)] * 5, 90.0)


def test_small_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    box = lambda x, y, w, h: tuple(F.lit(v) for v in (x, y, w, h))
    assert one(rules.region_weight(F.lit(1.0), F.lit(0.5), box(30, 30, 40, 40), (F.lit(100), F.lit(100)))) == 2.0
    assert one(rules.region_weight(F.lit(1.0), F.lit(0.5), box(0, 0, 10, 10), (F.lit(100), F.lit(100)))) == pytest.approx(1.0)
    assert one(rules.region_weight(F.lit(0.1), F.lit(0.0), box(0, 0, 10, 10), (F.lit(100), F.lit(100)))) == 0.5
    assert one(rules.region_weight(F.lit(None).cast("double"), F.lit(0.5), box(0, 0, 1, 1), (F.lit(9), F.lit(9)))) is None
    assert [one(rules.large_enough(F.lit(a), F.lit(b))) for a, b in ((500, 500), (499, 900), (900, 499), (None, 900))] == [True, False, False, True]
    assert [tuple(one(rules.batch_parameters(F.lit(mb * 1048576.0), F.lit(c), F.lit(g)))) for mb, c, g in ((1, 8, 8), (3, 8, 8), (6, 8, 8), (1, 8, 2), (1, 8, 16), (6, 1, 2))] == [(12, 60), (8, 80), (6, 110), (7, 60), (15, 60), (1, 110)]
    assert [one(rules.released(F.array(F.lit(1.0)), F.lit(s).cast("double"))) for s in (600, 601, None)] == [[1.0], [], [1.0]]
    assert [one(rules.with_tag(t, F.lit(n))) for t, n in ((F.array(F.lit("a")), " a "), (F.lit(None).cast("array<string>"), "b"), (F.array(F.lit("a")), "  "))] == [["a", "a"], ["b"], ["a"]]
    links = spark.createDataFrame([(1, 10), (1, 11), (1, 11), (2, 10), (None, 10), (3, 99)], "id long, feature_id long")
    features = spark.createDataFrame([(10, "x"), (11, "y"), (12, "z")], "feature_id long, v string")
    got = organize.features_of(spark.createDataFrame([(1,), (1,), (3,), (None,)], "id long"), links, features).select("id", "feature_id", "v").collect()
    assert sorted(map(tuple, got)) == [(1, 10, "x"), (1, 11, "y")]
