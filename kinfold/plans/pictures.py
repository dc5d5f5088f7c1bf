"""Pixel kernels, hashes and fusion over 8 x 8 pictures made of the vectors: red, green and blue are a vector's grid read
from three places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import distances, grids, rules
from kinfold.operators import pyramids
from kinfold.operators.boxes import merge_boxes
from kinfold.plans import vectors
from kinfold.plans.registry import SQL, query
from kinfold.session import materialize, ship, table

TURNS = {"r": 0, "g": 21, "b": 42}


def _grids(spark: SparkSession, d: str) -> DataFrame:
    """id, label, grid (gray), mean."""
    df = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", grids.grid_of_vector(F.col("embedding")).alias("grid"))
    return df.withColumn("mean", grids.mean(F.col("grid")))


def _colours(spark: SparkSession, d: str) -> DataFrame:
    return _grids(spark, d).select("id", "grid", *[grids.turned(F.col("grid"), n).alias(c) for c, n in TURNS.items()])


def _hashed(spark: SparkSession, d: str) -> DataFrame:
    """id, a, d, p: average, difference and block hashes as longs."""
    df = _grids(spark, d).withColumn("means", grids.block_means(F.col("grid")))
    return df.select("id", grids.average_hash(F.col("grid"), F.col("mean")).alias("a"), grids.difference_hash(F.col("grid")).alias("d"), grids.block_hash(F.col("grid"), F.col("means")).alias("p"))


GRID = "gr as (select vec_id id, label, list_transform(embedding, lambda e: floor((least(1.0, greatest(-1.0, 4.0 * e::double)) + 1) / 2 * 255 + 0.5)::int) g from embeddings), gm as (select *, list_sum(g)::double / 64 m from gr)"
RGB = "co as (select id, g r, list_concat(g[22:], g[1:21]) gg, list_concat(g[43:], g[1:42]) b from gr)"
INNER = "[" + ", ".join(str(y * 8 + x) for y in range(1, 7) for x in range(1, 7)) + "]"


def _fold(n: int, bit: str) -> str:
    return f"list_sum(list_transform(range(0, {n}), lambda i: case when {bit} then (1::hugeint << i::int) else 0 end))"


def _signed(x: str) -> str:
    return f"(case when {x} >= 9223372036854775808 then {x} - 18446744073709551616 else {x} end)::bigint"


BLOCK = "(g[(i // 16) * 16 + ((i % 8) // 2) * 2 + 1] + g[(i // 16) * 16 + ((i % 8) // 2) * 2 + 2] + g[(i // 16) * 16 + ((i % 8) // 2) * 2 + 9] + g[(i // 16) * 16 + ((i % 8) // 2) * 2 + 10]) / 4.0::double"
AT = "((i // 7) * 8 + i % 7)"
RAW = f"{GRID}, raw as (select id, {_fold(64, 'g[i + 1] >= m')} a, {_fold(56, f'g[{AT} + 1] > g[{AT} + 2]')} d, {_fold(64, f'g[i + 1] > {BLOCK}')} p from gm)"
HASHED = f"{RAW}, h as (select id, {_signed('a')} a, {_signed('d')} d, {_signed('p')} p from raw)"


@query(f"with {RAW} select id, lower(lpad(hex(a::uhugeint), 16, '0')) a_hash, lower(lpad(hex(d::uhugeint), 14, '0')) d_hash, lower(lpad(hex(p::uhugeint), 16, '0')) p_hash from raw")
def picture_hashes(spark: SparkSession, d: str) -> DataFrame:
    return _hashed(spark, d).select("id", grids.hex_of(F.col("a"), 16).alias("a_hash"), grids.hex_of(F.col("d"), 14).alias("d_hash"), grids.hex_of(F.col("p"), 16).alias("p_hash"))


def _against_first(df: DataFrame) -> DataFrame:
    """Every row beside the row with the least id, whose columns end in 0: one row, broadcast."""
    first = df.orderBy("id").limit(1).select(*[F.col(c).alias(f"{c}0") for c in df.columns], F.lit(1).alias("k"))
    return df.withColumn("k", F.lit(1)).join(F.broadcast(first), "k").drop("k")


HAM = "bit_count(xor({0}.{2}, {1}.{2}))"
PAIR = f"{HASHED}, f as (select * from h order by id limit 1), q as (select h.id, case when h.id % 5 = 1 then null else {HAM.format('h', 'f', 'a')} end da, case when h.id % 7 = 1 then null else {HAM.format('h', 'f', 'd')} end dd, {HAM.format('h', 'f', 'p')} dp from h, f)"
WD = "((coalesce(da * 0.25, 0) + coalesce(dd * 0.35, 0) + coalesce(dp * 0.4, 0))::double / (case when da is null then 0 else 0.25 end + case when dd is null then 0 else 0.35 end + case when dp is null then 0 else 0.4 end)::double)"
WB = "(case when da is null then 0 else 64 end + case when dd is null then 0 else 56 end + 64)"


@query(f"""with {PAIR} select id, round({WD}, 6) distance, round(greatest(0, least(100, 100 * (1 - {WD} / {WB}))), 6) similarity,
floor((coalesce((100 - dp * 100.0 / 64) * 0.5, 0) + coalesce((100 - dd * 100.0 / 64) * 0.3, 0) + coalesce((100 - da * 100.0 / 64) * 0.2, 0))::double / (0.5 + case when dd is null then 0 else 0.3 end + case when da is null then 0 else 0.2 end)::double + 0.5)::int vote from q""")
def hash_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Weighted distance and similarities of hashes to the first picture's; some hashes are made missing."""
    both = _against_first(_hashed(spark, d))
    da = F.when(F.col("id") % 5 != 1, distances.bit_distance(F.col("a"), F.col("a0")))
    dd = F.when(F.col("id") % 7 != 1, distances.bit_distance(F.col("d"), F.col("d0")))
    dp = distances.bit_distance(F.col("p"), F.col("p0"))
    return both.select("id", F.round(distances.hash_distance(da, dd, dp), 6).alias("distance"), F.round(distances.hash_similarity(da, dd, dp), 6).alias("similarity"), distances.hash_vote(da, dd, dp).alias("vote"))


WS = "((coalesce(100 * (1 - da / 64.0::double) * 0.2, 0) + coalesce(100 * (1 - dd / 56.0::double) * 0.4, 0) + 100 * (1 - dp / 64.0::double) * 0.4) / (case when da is null then 0 else 0.2 end + case when dd is null then 0 else 0.4 end + 0.4)::double)"


@query(f"""with {PAIR}, lk as (select id, m * 100 / 255 br, (list_max(g) - list_min(g)) * 100 / 255.0::double co from gm), lf as (select br br0, co co0 from lk order by id limit 1)
select q.id, round({WS}, 6) similarity, round({WS} * 0.7 + (100 - abs(br - br0)) * 0.15 + (100 - abs(co - co0)) * 0.15, 6) adjusted from q join lk using (id), lf""")
def adjusted_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Weighted similarity of hashes to the first picture's, and the same with brightness and contrast; some hashes are made missing."""
    looks = _grids(spark, d).select("id", (F.col("mean") * 100 / 255).alias("br"), ((F.array_max("grid") - F.array_min("grid")) * 100 / F.lit(255.0)).alias("co"))
    both = _against_first(_hashed(spark, d).join(looks, "id"))
    da = F.when(F.col("id") % 5 != 1, distances.bit_distance(F.col("a"), F.col("a0")))
    dd = F.when(F.col("id") % 7 != 1, distances.bit_distance(F.col("d"), F.col("d0")))
    dp = distances.bit_distance(F.col("p"), F.col("p0"))
    similarity = distances.weighted_similarity(da, dd, dp)
    adjusted = distances.adjusted_similarity(similarity, (F.col("br"), F.col("br0")), (F.col("co"), F.col("co0")))
    return both.select("id", F.round(similarity, 6).alias("similarity"), F.round(adjusted, 6).alias("adjusted"))


@query(f"with {HASHED} select {HAM.format('x', 'y', 'a')}::int distance, count(*) pairs from h x join h y on x.id < y.id group by 1")
def hash_distance_histogram(spark: SparkSession, d: str) -> DataFrame:
    from kinfold.operators.blocks import distance_counts

    return distance_counts(materialize(_hashed(spark, d), "hashed").select("id", F.col("a").alias("bits")))


@query(f"with {GRID} select id, list_transform(range(0, 8), lambda b: round(len(list_filter(g, lambda p: p * 8 // 256 = b)) / 64.0::double, 6)) bins from gr")
def gray_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _grids(spark, d).select("id", F.transform(grids.histogram(F.col("grid"), 8), lambda x: F.round(x, 6)).alias("bins"))


LBP = f"list_transform({INNER}, lambda i: case when g[i - 7] >= g[i + 1] then 1 else 0 end + case when g[i + 9] >= g[i + 1] then 2 else 0 end + case when g[i] >= g[i + 1] then 4 else 0 end + case when g[i + 2] >= g[i + 1] then 8 else 0 end)"


@query(f"with {GRID}, c as (select id, {LBP} k from gr) select id, list_transform(range(0, 16), lambda b: round(len(list_filter(k, lambda x: x = b)) / 36.0::double, 6)) bins from c")
def texture_patterns(spark: SparkSession, d: str) -> DataFrame:
    return _grids(spark, d).select("id", F.transform(grids.texture(F.col("grid")), lambda x: F.round(x, 6)).alias("bins"))


GX = "(-g[i - 8] + g[i - 6] - 2 * g[i] + 2 * g[i + 2] - g[i + 8] + g[i + 10])"
GY = "(-g[i - 8] - 2 * g[i - 7] - g[i - 6] + g[i + 8] + 2 * g[i + 9] + g[i + 10])"
SOBEL = f"list_transform({INNER}, lambda i: round(least(255, sqrt(({GX} * {GX} + {GY} * {GY})::double)))::int)"


@query(f"with {GRID} select id, {SOBEL} gradient from gr")
def sobel_gradient(spark: SparkSession, d: str) -> DataFrame:
    return _grids(spark, d).select("id", grids.sobel(F.col("grid")).alias("gradient"))


@query(f"with {GRID} select id, list_transform({INNER}, lambda i: round(greatest(0, least(255, g[i + 1] * 3.0 - 0.5 * (g[i - 7] + g[i + 9] + g[i] + g[i + 2])))::double, 6)) sharp from gr")
def sharpen(spark: SparkSession, d: str) -> DataFrame:
    return _grids(spark, d).select("id", F.transform(grids.sharpened(F.col("grid"), 0.5), lambda x: F.round(x, 6)).alias("sharp"))


LAP = "(4 * g[i + 1] - g[i - 7] - g[i + 9] - g[i] - g[i + 2])"
Q1 = f"""q as (select id, least(100, greatest(0, list_sum(list_transform({INNER}, lambda i: sqrt((3 * {LAP} * {LAP})::double))) / 64 / 5)) * 1.2 s, least(100, greatest(0, m / 255 * 100)) b, sqrt(list_sum(list_transform(g, lambda v: (v - m) * (v - m))) / 64) / 255 * 100 c from gm)"""


@query(f"""with {GRID}, {Q1} select id, floor(s + 0.5)::int sharpness, floor(b + 0.5)::int brightness, floor(c + 0.5)::int contrast,
least(100, floor(s * 0.5 + case when b > 50 then (1 - abs(b - 65) / 35) * 100 else b * 1.5 end * 0.25 + case when c > 15 then (1 - abs(c - 25) / 25) * 100 else c * 5 end * 0.25 + 0.5))::int score from q""")
def quality_curves(spark: SparkSession, d: str) -> DataFrame:
    return _grids(spark, d).select("id", grids.quality_by_curves(F.col("grid"), F.col("mean")).alias("q")).select("id", "q.*")


PAIRS2 = [(a, b) for y in (1, 3, 5) for x in (1, 3, 5) for a, b in (((y * 8 + x, y * 8 + x + 2) if x + 2 < 8 else (0, 0)), ((y * 8 + x, (y + 2) * 8 + x) if y + 2 < 8 else (0, 0)))]
EDGES2 = " + ".join(f"case when abs(g[{a + 1}] - g[{b + 1}]) > 20 then 1 else 0 end" for a, b in PAIRS2 if (a, b) != (0, 0))


@query(f"""with {GRID} select id, floor(greatest(0, 100 - abs(m - 128) / 128 * 100) * 0.2 + least(100, sqrt(list_sum(list_transform(g, lambda v: (v - m) * (v - m))) / 64) / 50 * 100) * 0.2 + least(100, ({EDGES2}) / 18.0::double * 200) * 0.3 + {64 / 2073600 * 50!r} * 0.2 + least(100, case when id > 0 then id * 1000 / 1048576.0::double * 25 else 50 end) * 0.1 + 0.5)::int score from gm""")
def quality_samples(spark: SparkSession, d: str) -> DataFrame:
    return _grids(spark, d).select("id", grids.quality_by_samples(F.col("grid"), F.col("mean"), F.col("id") * 1000).alias("score"))


EDGE = f"len(list_filter({INNER}, lambda i: abs(g[i + 1] - g[i + 2]) + abs(g[i + 1] - g[i + 9]) > 30)) / 64.0::double"


@query(f"with {GRID} select id, round({EDGE}, 6) edges from gr")
def edge_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _grids(spark, d).select("id", F.round(grids.edge_ratio(F.col("grid")), 6).alias("edges"))


CHANGE = " + ".join(f"abs({c}[i + 1] - {c}[i - 7]) + abs({c}[i + 1] - {c}[i + 2])" for c in ("r", "gg", "b"))


@query(f"with {GRID}, {RGB} select id, least(100, floor((len(list_filter({INNER}, lambda i: ({CHANGE}) / 6.0::double > 20)) / 64.0::double * 70 + least(1, len(list_distinct(list_transform({INNER}, lambda i: (r[i + 1] // 16) * 256 + (gg[i + 1] // 16) * 16 + b[i + 1] // 16))) / 256.0::double) * 30) * 100 + 0.5))::int complexity from co")
def visual_complexity(spark: SparkSession, d: str) -> DataFrame:
    return _colours(spark, d).select("id", grids.visual_complexity(F.col("r"), F.col("g"), F.col("b")).alias("complexity"))


SKIN = "len(list_filter(range(1, 65), lambda i: r[i] > 60 and gg[i] > 40 and b[i] > 20 and r[i] > gg[i] and r[i] > b[i] and r[i] - least(gg[i], b[i]) > 15 and abs(r[i] - gg[i]) > 15)) / 64.0::double"
STRONG = f"len(list_filter({INNER}, lambda i: {GX} * {GX} + {GY} * {GY} > 2500)) / 64.0::double"
CLASS = f"""{GRID}, {RGB}, st as (select gr.id, {STRONG} e, {EDGE} c, {SKIN} s, list_sum(r)::double / 64 ar, list_sum(gg)::double / 64 ag, list_sum(b)::double / 64 ab from gr join co using (id)),
cl as (select *, case when s > 0.15 and e < 0.3 then 'portrait' when (ab > ar and ag > ar) or (ag > ar * 1.1 and ag > ab and e < 0.2 and s < 0.1) then 'landscape' when e > 0.2 and ar > 200 and ag > 200 and ab > 200 and s < 0.05 then 'document'
 when e > 0.3 and abs(ar - ag) < 30 and abs(ar - ab) < 30 and s < 0.02 then 'text' when e > 0.15 and greatest(ar, ag, ab) - least(ar, ag, ab) > 50 then case when ar > greatest(ag, ab) * 1.2 then 'artwork' else 'graphical' end else 'other' end k from st),
cf as (select *, case when k = 'portrait' then least(0.9, s * 2) when k = 'landscape' then 0.7 + least(ag, ab) / greatest(ar, 1) * 0.2 when k = 'document' then 0.6 + e * 0.4 when k = 'text' then 0.7 + e * 0.3 when k in ('artwork', 'graphical') then 0.6 + e * 0.2 else 0.5 end::double f from cl)"""


@query(f"""with {CLASS} select id, k category, round(f, 6) confidence, round(greatest(70, least(98, 90 + f * (case k when 'portrait' then 5 when 'landscape' then -5 when 'text' then 8 when 'document' then 8 when 'artwork' then -3 else 0 end + case when c > 0.1 then -3 when c < 0.03 then 3 else 0 end + case when id % 3 = 0 then 5 else 0 end)))::double, 6) threshold from cf""")
def class_thresholds(spark: SparkSession, d: str) -> DataFrame:
    df = _colours(spark, d)
    at = lambda c: (lambda i: F.get(F.col(c), i))
    r, g, b = at("r"), at("g"), at("b")
    skin = F.size(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: (r(i) > 60) & (g(i) > 40) & (b(i) > 20) & (r(i) > g(i)) & (r(i) > b(i)) & (r(i) - F.least(g(i), b(i)) > 15) & (F.abs(r(i) - g(i)) > 15))) / 64.0
    strong = F.size(F.filter(_squares(F.col("grid")), lambda v: v > 2500)) / 64.0
    df = df.select("id", strong.alias("e"), grids.edge_ratio(F.col("grid")).alias("c"), skin.alias("s"), *[grids.mean(F.col(c)).alias(f"m{c}") for c in TURNS])
    df = df.select("id", "c", rules.image_class(F.col("e"), F.col("s"), F.col("mr"), F.col("mg"), F.col("mb"), F.lit(1.0)).alias("k"))
    faces = F.when(F.col("id") % 3 == 0, 1).otherwise(0)
    return df.select("id", "k.category", F.round("k.confidence", 6).alias("confidence"), F.round(rules.adaptive_threshold(F.lit(90.0), F.col("k.category"), F.col("k.confidence"), F.col("c"), faces), 6).alias("threshold"))


def _squares(grid):
    """Squared gradients of the inner pixels."""

    def value(at):
        gx = -at(-1, -1) + at(1, -1) - 2 * at(-1, 0) + 2 * at(1, 0) - at(-1, 1) + at(1, 1)
        gy = -at(-1, -1) - 2 * at(0, -1) - at(1, -1) + at(-1, 1) + 2 * at(0, 1) + at(1, 1)
        return gx * gx + gy * gy

    return grids.over_interior(grid, 8, 8, value)


COS = "coalesce(list_cosine_similarity({0}, {1}), 0)"
FUSE = f"""{HASHED}, tx as (select id, {LBP} k from gr), ft as (select gr.id, h.a, h.d, h.p, list_transform(range(0, 8), lambda b: len(list_filter(g, lambda x: x * 8 // 256 = b))::double) hist, list_transform(range(0, 16), lambda b: len(list_filter(k, lambda x: x = b))::double) tex, list_transform(embedding, lambda x: x::double) v
 from gr join h using (id) join tx using (id) join embeddings on vec_id = gr.id),
f0 as (select * from ft order by id limit 1),
lv as (select ft.id, case when ft.id % 3 <> 1 then greatest(0, least(100, 100 * (1 - ({HAM.format('ft', 'f0', 'a')} * 0.25 + {HAM.format('ft', 'f0', 'd')} * 0.35 + {HAM.format('ft', 'f0', 'p')} * 0.4)::double / 184))) end lo,
 case when ft.id % 5 <> 2 then {COS.format('ft.hist', 'f0.hist')} * 100 * 0.6 + {COS.format('ft.tex', 'f0.tex')} * 100 * 0.4 end mi, case when ft.id % 7 <> 3 then {COS.format('ft.v', 'f0.v')} * 100 end hi from ft, f0),
wt as (select *, (case when lo is null then 0.3 else 0 end + case when mi is null then 0.3 else 0 end + case when hi is null then 0.4 else 0 end)::double u, (lo is not null)::int + (mi is not null)::int + (hi is not null)::int n from lv)"""


@query(f"""with {FUSE} select id, coalesce(floor((coalesce(lo, 0) * (0.3 + u / n) + coalesce(mi, 0) * (0.3 + u / n) + coalesce(hi, 0) * (0.4 + u / n)) * 10 + 0.5) / 10, 0) similarity,
case when n = 1 and lo is not null then 'hash' when n = 1 and mi is not null then 'color_texture' when n = 1 and hi is not null then 'deep_learning' else 'fusion' end as method, ((lo is not null)::int + 2 * (mi is not null)::int + 4 * (hi is not null)::int) mask from wt where n > 0""")
def fusion_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Three levels against the first picture; some levels are made missing."""
    low, mid, high = F.col("low"), F.col("mid"), F.col("high")
    both = _levels(spark, d).filter(low.isNotNull() | mid.isNotNull() | high.isNotNull())
    return both.select("id", distances.fusion(low, mid, high).alias("f"), distances.level_mask(low, mid, high).alias("mask")).select("id", "f.*", "mask")


def _levels(spark: SparkSession, d: str) -> DataFrame:
    g = _grids(spark, d)
    features = g.select("id", grids.histogram(F.col("grid"), 8).alias("hist"), grids.texture(F.col("grid")).alias("tex"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    features = materialize(_hashed(spark, d).join(features, "id").join(vectors, "id"), "features")
    both = _against_first(features)
    pair = lambda c: distances.bit_distance(F.col(c), F.col(f"{c}0"))
    near = lambda c: distances.cosine(F.col(c), F.col(f"{c}0")) * 100
    low = F.when(F.col("id") % 3 != 1, distances.hash_similarity(pair("a"), pair("d"), pair("p")))
    mid = F.when(F.col("id") % 5 != 2, distances.mid_level(near("hist"), near("tex")))
    high = F.when(F.col("id") % 7 != 3, near("v"))
    return both.select("id", low.alias("low"), mid.alias("mid"), high.alias("high"))


@query(f"""with {FUSE}, c as (select id, case when hi is not null then greatest(0, least(100, hi)) end fe, lo hs, mi raw from lv)
select id, round(case when fe >= 63 and hs is not null then fe * 0.6 + hs * 0.4 else coalesce(fe, hs, raw, 0) end, 6) similarity, case when fe >= 63 and hs is not null then 'combined' when fe is not null then 'feature' when hs is not null then 'hash' when raw is not null then 'raw_feature' else 'none' end as method from c""")
def cascade_similarity(spark: SparkSession, d: str) -> DataFrame:
    feature = F.when(F.col("high").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("high"))))
    return _levels(spark, d).select("id", distances.cascade(feature, F.col("low"), F.col("mid"), 90.0).alias("c")).select("id", F.round("c.similarity", 6).alias("similarity"), "c.method")


@query(f"""with {FUSE} select id, case when coalesce(lo, 0) < 63 then false when coalesce(lo, 0) > 68 then true when coalesce(mi, 0) < 76.5 then false when coalesce(mi, 0) > 81.5 then true when coalesce(hi, 0) < 90 then false else true end passes from lv""")
def coarse_to_fine(spark: SparkSession, d: str) -> DataFrame:
    levels = [F.coalesce(F.col(c), F.lit(0.0)) for c in ("low", "mid", "high")]
    return _levels(spark, d).select("id", distances.coarse_to_fine(levels, 90.0).alias("passes"))


@query(f"""with {GRID}, so as (select id, {SOBEL} s from gr), px as (select id, unnest(range(0, 36)) k, unnest(s) v from so), c as (select id, (k // 6 + 1) // 2 * 4 + (k % 6 + 1) // 2 cell, sum(v) / 4.0::double a from px group by 1, 2), m as (select id, sum(v) / 64.0::double t from px group by id)
select c.id, cell::int cell, round(least(1, a / (t * 1.5 * 2)), 6) weight from c join m using (id) where a > t * 1.5""")
def salient_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of 2 x 2 pixels whose mean gradient is above one and a half times that of the picture; the rim has none."""
    px = _grids(spark, d).select("id", F.posexplode(grids.sobel(F.col("grid"))).alias("k", "v"))
    cell = (F.floor((F.floor(F.col("k") / 6) + 1) / 2) * 4 + F.floor((F.col("k") % 6 + 1) / 2)).cast("int")
    cells = px.groupBy("id", cell.alias("cell")).agg((F.sum("v") / 4.0).alias("a"))
    means = px.groupBy("id").agg((F.sum("v") / 64.0).alias("mean"))
    above = cells.join(means, "id").filter(F.col("a") > F.col("mean") * 1.5)
    return above.select("id", "cell", F.round(F.least(F.lit(1.0), F.col("a") / (F.col("mean") * 1.5 * 2)), 6).alias("weight"))


@query(f"""with recursive {GRID}, px as (select id, m, unnest(range(0, 64)) k, unnest(g) v from gm),
it as (select id, 0 r, (k % 8)::double l, (k // 8)::double u, (k % 8 + 2)::double rt, (k // 8 + 2)::double dn, least(1, v / (m * 1.5 * 2)) w from px where v > m * 1.5
 union all select id, r, l, u, rt, dn, w from (select *, bool_or(moved) over (partition by id) again from (select id, r, l, u, rt, dn, max(w) w, bool_or(moved) moved from (
 select a.id, a.r + 1 r, min(b.l) l, min(b.u) u, max(b.rt) rt, max(b.dn) dn, max(b.w) w, bool_or(b.l <> a.l or b.u <> a.u or b.rt <> a.rt or b.dn <> a.dn) moved
 from it a join it b on a.id = b.id and a.l < b.rt and b.l < a.rt and a.u < b.dn and b.u < a.dn group by a.id, a.r, a.l, a.u, a.rt, a.dn) group by id, r, l, u, rt, dn)) where again)
select id, l x, u y, rt - l width, dn - u height, round(max(w), 6) weight from it where r = (select max(r) from it o where o.id = it.id) group by id, l, u, rt, dn""")
def merged_regions(spark: SparkSession, d: str) -> DataFrame:
    """Squares of 2 x 2 at the pixels brighter than one and a half times the mean, merged until none overlap."""
    bright = _grids(spark, d).select("id", "mean", F.posexplode("grid").alias("k", "v")).filter(F.col("v") > F.col("mean") * 1.5)
    places = bright.select("id", (F.col("k") % 8).alias("x"), F.floor(F.col("k") / 8).alias("y"), F.lit(2).alias("width"), F.lit(2).alias("height"), F.least(F.lit(1.0), F.col("v") / (F.col("mean") * 1.5 * 2)).alias("weight"))
    return merge_boxes(places).withColumn("weight", F.round("weight", 6))


@query(f"""with {RAW}, hx as (select id, label, lower(lpad(hex(a::uhugeint), 16, '0')) h from raw join gr using (id)), ch as (select label, h[i:i] c, i, id from hx, range(1, 17) t(i)), w as (select label, i, c, sum(case when id % 4 = 0 then 2 else 1 end) s from ch group by 1, 2, 3),
b as (select label, i, arg_max(c, (s, c)) c from w group by 1, 2) select label, string_agg(c, '' order by i) hash from b group by label""")
def voted_hash(spark: SparkSession, d: str) -> DataFrame:
    """For each label, the hash of the characters that weigh most at each place; ties go to the larger character."""
    hashes = _hashed(spark, d).select("id", grids.hex_of(F.col("a"), 16).alias("h")).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id")
    weight = F.when(F.col("id") % 4 == 0, 2).otherwise(1)
    chars = hashes.select("label", weight.alias("w"), F.posexplode(F.split("h", "")).alias("i", "c"))
    sums = chars.groupBy("label", "i", "c").agg(F.sum("w").alias("s"))
    best = sums.groupBy("label", "i").agg(F.max_by("c", F.struct("s", "c")).alias("c"))
    return best.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]), "").alias("hash"))


DIMS = "dm as (select page_id id, (200 + page_id * 37 % 5000)::bigint w, (150 + page_id * 53 % 4000)::bigint h from pages)"


def _dims(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id")
    return table(spark, d, "pages").select(i.alias("id"), (F.lit(200) + i * 37 % 5000).alias("w"), (F.lit(150) + i * 53 % 4000).alias("h"))


@query(f"with {DIMS} select id, round(case when w > h and w > 1920 then 1920 when h > 1920 then w * 1920.0::double / h else w end::double, 6) width, round(case when w > h and w > 1920 then h * 1920.0::double / w when h > 1920 then 1920 else h end::double, 6) height from dm")
def fit_sizes(spark: SparkSession, d: str) -> DataFrame:
    return _dims(spark, d).select("id", grids.fit_inside(F.col("w"), F.col("h"), 1920).alias("f")).select("id", F.round("f.width", 6).alias("width"), F.round("f.height", 6).alias("height"))


@query(f"with {DIMS}, x as (select id, h, w, unnest(range(0, w, 240)) x from dm), t as (select id, x, w, h, unnest(range(0, h, 240)) y from x) select id, x, y, least(256, w - x) width, least(256, h - y) height from t")
def tiles(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of 256 pixels that overlap by 16."""
    xs = _dims(spark, d).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w") - 1, F.lit(240).cast("long"))))
    ys = xs.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h") - 1, F.lit(240).cast("long"))))
    return ys.select("id", "x", "y", F.least(F.lit(256), F.col("w") - F.col("x")).alias("width"), F.least(F.lit(256), F.col("h") - F.col("y")).alias("height"))


@query(f"with {DIMS}, l as (select id, w, h, unnest(range(0, 6)) l from dm) select id, l::int as level, floor(w * power(0.5, l))::bigint width, floor(h * power(0.5, l))::bigint height from l where floor(w * power(0.5, l)) >= 32 and floor(h * power(0.5, l)) >= 32")
def pyramid(spark: SparkSession, d: str) -> DataFrame:
    levels = _dims(spark, d).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(5))))
    scale = F.pow(F.lit(0.5), F.col("level"))
    return levels.select("id", "level", F.floor(F.col("w") * scale).alias("width"), F.floor(F.col("h") * scale).alias("height")).filter("width >= 32 and height >= 32")


@query(f"with {GRID}, {Q1} select id, case when b < 40 then 20 when b > 80 then -10 else 0 end brightness, case when c < 30 then 15 else 0 end contrast, case when s < 50 then 25 else 0 end sharpness from q")
def picture_adjustments(spark: SparkSession, d: str) -> DataFrame:
    df = _grids(spark, d)
    m = F.col("mean")
    edge = grids.total(F.transform(grids.laplacian(F.col("grid")), lambda v: F.sqrt((3 * v * v).cast("double"))))
    df = df.select("id", (F.least(F.lit(100.0), edge / 64 / 5) * 1.2).alias("s"), (m / 255 * 100).alias("b"), (F.sqrt(grids.total(F.transform("grid", lambda v: (v - m) * (v - m))) / 64) / 255 * 100).alias("c"))
    return df.select("id", grids.adjustments(F.col("b"), F.col("c"), F.col("s")).alias("a")).select("id", "a.*")


MSB = f"{GRID}, raw as (select id, {_fold(64, 'g[64 - i] >= m')} a from gm)"


@query(f"with {MSB} select id, lower(lpad(hex(a::uhugeint), 16, '0')) a_hash from raw")
def high_first_hashes(spark: SparkSession, d: str) -> DataFrame:
    """The average hash in the layout with the first pixel in the highest bit."""
    return _grids(spark, d).select("id", grids.hex_of(grids.average_hash(F.col("grid"), F.col("mean"), high_first=True), 16).alias("a_hash"))


@query()
def cosine_hashes(spark: SparkSession, d: str) -> DataFrame:
    """The frequency hash of the pictures at 32 x 32."""
    big = _grids(spark, d).select("id", grids.enlarged(F.col("grid"), 8, 4).alias("big"))
    return big.select("id", grids.hex_of(grids.cosine_hash(F.col("big")), 16).alias("hash"))


# --- pyramids and tiles of the pixels themselves

def _half_sql(of: str, side: int) -> str:
    """The grid of 2 * side pixels a side, halved."""
    at = lambda u, v: f"{of}[(i // {side} * 2 + {v}) * {2 * side} + i % {side} * 2 + {u} + 1]"
    return f"list_transform(range(0, {side * side}), lambda i: (({at(0, 0)} + {at(1, 0)} + {at(0, 1)} + {at(1, 1)} + 2) // 4)::int)"


LEVELED = f"""h4 as (select id, g, {_half_sql('g', 4)} g4 from gr), h2 as (select id, g, g4, {_half_sql('g4', 2)} g2 from h4),
le as (select id, 2 as level, 8 side, g px from h2 union all select id, 1, 4, g4 from h2 union all select id, 0, 2, g2 from h2),
lh as (select id, level, side, px, {_signed('coalesce(list_sum(list_transform(range(0, len(px)), lambda i: case when px[i + 1] * len(px) >= list_sum(px) then (1::hugeint << i::int) else 0 end)), 0)')} hash from le)"""


def _pictures(spark: SparkSession, d: str) -> DataFrame:
    return _grids(spark, d).select("id", F.lit(8).alias("width"), F.lit(8).alias("height"), F.col("grid").alias("pixels"))


def _leveled(spark: SparkSession, d: str) -> DataFrame:
    """id, level, width, pixels, bits, hash of three levels."""
    rows = pyramids.levels(_pictures(spark, d), most=3, least_side=1).withColumn("mean", grids.mean(F.col("pixels")))
    value = F.coalesce(*[F.when(F.col("width") == side, grids.average_hash(F.col("pixels"), F.col("mean"), side)) for side in (8, 4, 2)])
    return rows.select("id", "level", "width", "pixels", F.size("pixels").alias("bits"), value.alias("hash"))


@query(f"with {GRID}, {LEVELED} select id, level, side width, sha256(array_to_string(px, ',')) digest, hash from lh")
def pyramid_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Each level's pixels as a digest, and its average hash."""
    return _leveled(spark, d).select("id", "level", "width", pyramids.digest(F.col("pixels")).alias("digest"), "hash")


TILED = """tp as (select id, g, unnest(range(0, 8, 3)) x from gr), ty as (select id, g, x, unnest(range(0, 8, 3)) y from tp),
td as (select id, x::int x, y::int y, least(4, 8 - x)::int width, least(4, 8 - y)::int height, sha256(array_to_string(flatten(list_transform(range(y, least(y + 4, 8)), lambda r: g[r * 8 + x + 1:r * 8 + least(x + 4, 8)])), ',')) digest from ty)"""


@query(f"with {GRID}, {TILED} select * from td")
def tile_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of 4 x 4 that overlap by one pixel."""
    return pyramids.tiles(_pictures(spark, d), 4, 1).select("id", "x", "y", "width", "height", pyramids.digest(F.col("pixels")).alias("digest"))


@query(f"with {GRID}, {TILED} select id, count(*)::int tiles, sha256(string_agg(digest, '' order by y, x)) digest from td group by id")
def tiled_digest(spark: SparkSession, d: str) -> DataFrame:
    return pyramids.segmented(pyramids.tiles(_pictures(spark, d), 4, 1))


def _candidate_sql() -> str:
    return f"{vectors._asked_sql()}, ca as (select distinct least(a.id, b.id) a, greatest(a.id, b.id) b from {vectors.MET})"


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of distinct sign vectors; those that few others resemble have few."""
    asked = vectors.level_candidates(spark, d)
    return asked.select(F.least("query_id", "vec_id").alias("a"), F.greatest("query_id", "vec_id").alias("b")).distinct()


@query(f"""with {_candidate_sql()}, {GRID}, {LEVELED}, pr as (select a, b, x.level, 100 * (1 - bit_count(xor(x.hash, y.hash)) / len(x.px)::double) v from ca join lh x on x.id = a join lh y on y.id = b and y.level = x.level),
ve as (select a, b, level, v, case when v < 90 * (0.7::double + 0.3::double * level / 2) then false when v > 95 or level = 2 then true end ok from pr)
select a, b, min(level)::int as level, round(arg_min(v, level), 6) similarity, arg_min(ok, level) passes from ve where ok is not null group by a, b""")
def pyramid_search(spark: SparkSession, d: str) -> DataFrame:
    """Candidate pairs of the vectors' longest shared prefixes, decided by their pictures from the coarsest level on."""
    found = pyramids.search(_candidates(spark, d), _leveled(spark, d), 90.0)
    return found.withColumn("similarity", F.round("similarity", 6))


CASC = f"""pq as (select ca.a id1, ca.b id2, {HAM.format('x', 'y', 'a')} da, {HAM.format('x', 'y', 'd')} dd, {HAM.format('x', 'y', 'p')} dp, ca.b % 3 <> 1 hashed, ca.b % 5 <> 2 reduced,
 100 * {COS.format('e.embedding::double[]', 'f.embedding::double[]')} co from ca join h x on x.id = ca.a join h y on y.id = ca.b join embeddings e on e.vec_id = ca.a join embeddings f on f.vec_id = ca.b),
pv as (select *, case when hashed then greatest(0, least(100, 100 * (1 - (da * 0.25 + dd * 0.35 + dp * 0.4)::double / 184))) end hs, case when hashed then greatest(0, least(100, 100 * (1 - dp / 64.0::double))) end bs, case when reduced then greatest(0, least(100, co)) end fe, co raw from pq)"""


@query(f"""with {_candidate_sql()}, {HASHED}, {CASC} select id1 a, id2 b, round(coalesce(bs, raw), 6) basic, round(coalesce(hs, raw), 6) standard,
round(case when fe >= 63 and hs is not null then fe * 0.6 + hs * 0.4 when fe is not null then fe else coalesce(hs, raw) end, 6) professional,
case when fe >= 63 and hs is not null then 'feature_and_hash' when fe >= 63 then 'feature_only' when fe is not null then 'feature_only_low' when hs is not null then 'advanced_hash' else 'fallback_feature' end as method from pv""")
def level_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Candidate pairs compared at three levels; some pictures have no hashes or no reduced vector."""
    ship(spark)
    both = _candidates(spark, d)
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), distances.norm(F.col("embedding")).alias("n"))
    rows = materialize(_hashed(spark, d).join(vectors, "id"), "features")
    for key, end in (("a", "0"), ("b", "1")):
        both = both.join(rows.select(F.col("id").alias(key), *[F.col(c).alias(f"{c}{end}_") for c in ("a", "d", "p", "v", "n")]), key)
    hashed, reduced = F.col("b") % 3 != 1, F.col("b") % 5 != 2
    far = {c: F.when(hashed, distances.bit_distance(F.col(f"{c}0_"), F.col(f"{c}1_"))) for c in ("a", "d", "p")}
    both = both.withColumn("dot", distances.dots(F.col("v0_"), F.col("v1_")))
    near = F.coalesce(F.col("dot") / F.nullif(F.col("n0_") * F.col("n1_"), F.lit(0.0)), F.lit(0.0)) * 100
    both = both.select("a", "b", far["a"].alias("da"), far["d"].alias("dd"), far["p"].alias("dp"), near.alias("raw"), F.when(reduced, F.greatest(F.lit(0.0), F.least(F.lit(100.0), near))).alias("feature"))
    at = lambda level: distances.at_level(level, F.col("da"), F.col("dd"), F.col("dp"), F.col("feature"), F.col("raw"), 90.0)
    out = both.select("a", "b", *[at(level).alias(level) for level in ("basic", "standard", "professional")])
    return out.select("a", "b", *[F.round(f"{c}.similarity", 6).alias(c) for c in ("basic", "standard", "professional")], "professional.method")


# --- regions weighed, small pictures skipped

MERGED = SQL["merged_regions"].removeprefix("with recursive ")
AREA = "width * height / 64"
FAR = "(sqrt(power(x + width / 2 - 4, 2) + power(y + height / 2 - 4, 2)) / sqrt(32.0::double))"


@query(f"""with recursive mr as (with recursive {MERGED})
select id, x, y, width, height, round(least(2.0, greatest(0.5, 1.0::double * case when {AREA} > 0.1 then 1.5::double when {AREA} > 0.05 then 1.3::double else 1 end
 * case when {FAR} < 0.2 then 1.4::double when {FAR} < 0.4 then 1.2::double else 1 end * (0.8::double + 0.4::double * weight))), 6) weight from mr""")
def weighed_regions(spark: SparkSession, d: str) -> DataFrame:
    """The merged regions weighed by area, distance to the centre and confidence."""
    weight = rules.region_weight(F.lit(1.0), F.col("weight"), (F.col("x"), F.col("y"), F.col("width"), F.col("height")), (F.lit(8), F.lit(8)))
    return merged_regions(spark, d).withColumn("weight", F.round(weight, 6))


@query(f"with {DIMS} select id, w >= 500 and h >= 500 examined from dm")
def examined_pictures(spark: SparkSession, d: str) -> DataFrame:
    """Pictures with a side below 500 are not searched for regions."""
    return _dims(spark, d).select("id", rules.large_enough(F.col("w"), F.col("h")).alias("examined"))
