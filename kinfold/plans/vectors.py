"""Vectors: neighbours, similarities, statistics, hashing, compression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import distances, rules
from kinfold.operators import blocks, linalg, lsh, pivots
from kinfold.plans.registry import query
from kinfold.session import materialize, ship, table

LIMIT = 10


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


E = "e as (select vec_id id, list_transform(embedding, lambda x: x::double) v from embeddings)"


@query(f"with {E}, p as (select x.id query_id, y.id id, list_cosine_similarity(x.v, y.v) s from e x join e y on x.id <> y.id), r as (select *, row_number() over (partition by query_id order by s desc, id) rank from p) select query_id, id, round(s, 6) similarity, rank::int rank from r where rank <= {LIMIT}")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    v = _vectors(spark, d)
    near = pivots.nearest(v, v, LIMIT + 1, "cosine").filter("query_id <> id")
    order = W.partitionBy("query_id").orderBy("rank")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= LIMIT).select("query_id", "id", F.round("score", 6).alias("similarity"), "rank")


@query(f"""with {E}, p as (select x.id query_id, y.id id, list_distance(x.v, y.v) s from e x join e y on true), r as (select *, row_number() over (partition by query_id order by s, id) k from p),
f as (select *, max(s) over (partition by query_id) far from r where k <= {2 * LIMIT}),
w as (select query_id, id, case when s = 0 then 1.0 when s >= far then 0.0 else exp(-5 * (s / far) * (s / far)) end similarity from f where query_id <> id),
t as (select *, row_number() over (partition by query_id order by similarity desc, id) rank from w where similarity >= 0.004)
select query_id, id, round(similarity, 6) similarity, rank::int rank from t where rank <= {LIMIT}""")
def similar_items(spark: SparkSession, d: str) -> DataFrame:
    return blocks.similar_items(_vectors(spark, d), LIMIT, 0.004).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"with {E} select x.id i, y.id j, round(list_cosine_similarity(x.v, y.v), 6) similarity from e x join e y on true")
def similarity_matrix(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return blocks.compared(v, v, "cosine", digits=6).select(F.col("query_id").alias("i"), F.col("id").alias("j"), F.col("score").alias("similarity"))


@query(f"""with {E}, q as (select v from e order by id limit 1), s as (select id, list_cosine_similarity(e.v, q.v) c, list_distance(e.v, q.v) d, list_dot_product(e.v, q.v) p from e, q)
select id, round(c, 6) cosine, round(greatest(0, least(1, c)), 6) clamped, round((c + 1) / 2, 6) mapped, round(d, 6) distance, round(100 * exp(-d / 2), 6) near, round(p, 6) product from s""")
def one_against_all(spark: SparkSession, d: str) -> DataFrame:
    """Every vector against the first: one row, broadcast."""
    v = _vectors(spark, d)
    first = v.orderBy("id").limit(1).select(F.col("vector").alias("q"), F.lit(1).alias("k"))
    both = v.withColumn("k", F.lit(1)).join(F.broadcast(first), "k")
    both = both.select("id", distances.cosine(F.col("vector"), F.col("q")).alias("c"), distances.euclidean(F.col("vector"), F.col("q")).alias("d"), distances.dot(F.col("vector"), F.col("q")).alias("p"))
    return both.select("id", rules.rounded(F.col("c"), 6).alias("cosine"), F.round(distances.clamped_cosine(F.col("c")), 6).alias("clamped"), F.round(distances.mapped_cosine(F.col("c")), 6).alias("mapped"), F.round("d", 6).alias("distance"), F.round(distances.distance_similarity(F.col("d"), 2.0), 6).alias("near"), rules.rounded(F.col("p"), 6).alias("product"))


CELLS = "c as (select vec_id i, generate_subscripts(embedding, 1) - 1 j, unnest(embedding)::double v from embeddings)"


@query(f"with {CELLS} select j::int j, round(avg(v), 6) mean, round(stddev_pop(v), 6) std, round(min(v), 6) low, round(max(v), 6) high from c group by j")
def vector_stats(spark: SparkSession, d: str) -> DataFrame:
    return linalg.column_stats(table(spark, d, "embeddings"), "embedding").select("j", *[rules.rounded(F.col(c), 6).alias(c) for c in ("mean", "std", "low", "high")])


@query(f"with {CELLS} select x.j::int i, y.j::int j, round(covar_samp(x.v, y.v), 6) v from c x join c y on x.i = y.i group by 1, 2")
def covariance(spark: SparkSession, d: str) -> DataFrame:
    return linalg.covariance(table(spark, d, "embeddings"), "embedding").select("i", "j", rules.rounded(F.col("v"), 6).alias("v"))


@query(f"with {CELLS} select x.j::int i, y.j::int j, round(sum(x.v * y.v), 6) v from c x join c y on x.i = y.i group by 1, 2")
def gram_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The vectors' matrix, transposed, times itself."""
    return linalg.gram(table(spark, d, "embeddings"), "embedding").select("i", "j", rules.rounded(F.col("v"), 6).alias("v"))


# Components one after the other: the matrix is squared 16 times, so that what is left is the first component; then it is taken away.
COMPONENTS = f"""{CELLS}, co as (select x.j i, y.j j, covar_samp(x.v, y.v) v from c x join c y on x.i = y.i group by 1, 2),
cr as (select i, list(v order by j) r from co group by i), cm as (select list(r order by i) m from cr),
ev(comp, step, m, p, v, lam) as (select 0, 0, m, m, null::double[], null::double from cm union all
 select comp + (step = 16)::int, case when step = 16 then 0 else step + 1 end, m2, case when step = 16 then m2 else list_transform(q, lambda a: list_transform(a, lambda x: x / t)) end, u, l
 from (select *, case when step = 16 then list_transform(range(1, 65), lambda i: list_transform(range(1, 65), lambda j: m[i][j] - l * u[i] * u[j])) else m end m2, list_sum(list_transform(range(1, 65), lambda i: q[i][i])) t
  from (select *, list_dot_product(u, list_transform(m, lambda a: list_dot_product(a, u))) l, case when step < 16 then list_transform(p, lambda a: list_transform(p, lambda b: list_dot_product(a, b))) end q
   from (select *, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w)) * case when abs(list_max(w)) >= abs(list_min(w)) then 1 else -1 end) u
    from (select *, case when step = 16 then p[list_position(list_transform(range(1, 65), lambda i: p[i][i]), list_max(list_transform(range(1, 65), lambda i: p[i][i])))] end w
     from ev where comp < {{k}})))))
, pc as (select comp - 1 component, lam, v from ev where step = 0 and comp > 0)"""

#: Coordinates along the first four components.
REDUCED = COMPONENTS.format(k=4) + """, mu as (select list(mv order by j) mv from (select j, avg(v) mv from c group by j)),
rd as (select vec_id, list_transform(vs, lambda u: list_dot_product(u, list_transform(range(1, 65), lambda i: embedding[i]::double - mv[i]))) r from embeddings, mu, (select list(v order by component) vs from pc))"""


@query(f"with recursive {COMPONENTS.format(k=16)} select component::int component, round(lam / (select sum(v) from co where i = j), 6) share from pc")
def pca_variance(spark: SparkSession, d: str) -> DataFrame:
    shares = linalg.principal_components(table(spark, d, "embeddings"), "embedding", 16).shares(spark)
    return shares.withColumn("share", F.round("share", 6))


def _reduced(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    found = linalg.principal_components(vectors, "embedding", 4)
    return vectors.select("vec_id", found.project(F.col("embedding")).alias("reduced"))


@query(f"with recursive {REDUCED} select vec_id, list_transform(r, lambda x: round(x, 5)) reduced from rd")
def pca_projection(spark: SparkSession, d: str) -> DataFrame:
    return _reduced(spark, d).select("vec_id", F.transform("reduced", lambda x: rules.rounded(x, 5)).alias("reduced"))


@query(f"""with recursive {REDUCED}, z as materialized (select vec_id, r, sqrt(list_dot_product(r, r)) n from rd),
p as (select x.vec_id query_id, y.vec_id, list_dot_product(x.r, y.r) / (x.n * y.n) s from z x, z y),
o as (select query_id, vec_id, s, row_number() over (partition by query_id order by round(s, 9) desc, vec_id) k from p)
select query_id, vec_id, k::int place, round(s, 5) similarity from o where k <= 3""")
def pca_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's three most alike along the first components, itself among them."""
    from kinfold.operators.pivots import nearest

    rows = materialize(_reduced(spark, d).filter("reduced is not null").select(F.col("vec_id").alias("id"), F.col("reduced").alias("vector")), "reduced")
    near = nearest(rows, rows, 3, "cosine")
    return near.select("query_id", F.col("id").alias("vec_id"), F.col("rank").cast("int").alias("place"), F.round("score", 5).alias("similarity"))


@query("select vec_id, list_transform(range(0, 64, 5), lambda i: embedding[i + 1]) vector from embeddings")
def stride_compress(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", rules.stride_sample(F.col("embedding"), 0.2).alias("vector"))


@query("""with s as (select vec_id, embedding v, list_sort(list_transform(range(0, 63), lambda i: {'s': -abs(embedding[i + 2]::double - embedding[i + 1]::double), 'i': i})) g from embeddings),
k as (select vec_id, v, list_sort(list_distinct(list_concat(list_transform(g[1:49], lambda x: x.i), [0::bigint, 63::bigint]))) p from s)
select vec_id, list_transform(p, lambda i: v[i + 1]) vector from k""")
def gradient_compress(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", rules.gradient_sample(F.col("embedding"), 51).alias("vector"))


@query("select vec_id, list_transform(range(0, 10), lambda i: round(list_avg(list_transform(embedding[i * 7 + 1:i * 7 + 7], lambda x: x::double)), 6)) vector from embeddings")
def average_pool(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.transform(rules.average_pool(F.col("embedding"), 10), lambda x: rules.rounded(x, 6)).alias("vector"))


# --- hashing of vectors; the sign bits of a vector as +-1 give whole dot products

PLANES = lsh.signs(4, 8, 64)
GRID = lsh.signs(3, 4, 64, seed=11)
SHIFTS = np.array([[0.5, 1.25, 2.0, 3.5]] * 3)
WIDTH = 12.0


def _signed(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)  # before the functions over it are made
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), lsh.plus_minus(F.transform("embedding", lambda x: (x > 0).cast("int"))).alias("v"))


def _index(spark: SparkSession, d: str) -> DataFrame:
    return _signed(spark, d).select("id", lsh.hyperplane_buckets(F.col("v"), PLANES).alias("buckets"))


def _codes_of(buckets: Column) -> Column:
    return F.transform(buckets, lambda b: b["bucket"])


def _plane_codes(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).select("id", _codes_of(F.col("buckets")).alias("codes"))


def _grid_codes(spark: SparkSession, d: str) -> DataFrame:
    return _signed(spark, d).select("id", lsh.grid_codes(F.col("v"), GRID, SHIFTS, WIDTH).alias("codes"))


PLANE_TABLES = [lsh.Meeting()] * len(PLANES)


S = "s as (select vec_id id, list_transform(embedding, lambda x: case when x > 0 then 1 else -1 end) v from embeddings)"


def _dot_sql(w: np.ndarray) -> str:
    return f"list_dot_product(v::double[], {[float(x) for x in w]}::double[])"


def _plane_sql() -> str:
    rows = [f"select id, {t} tab, {' + '.join(f'case when {_dot_sql(w)} > 0 then {1 << i} else 0 end' for i, w in enumerate(p))} bucket from s" for t, p in enumerate(PLANES)]
    return f"{S}, k as ({' union all '.join(rows)})"


def _grid_sql(probe: int) -> str:
    rows = []
    for t, (p, b) in enumerate(zip(GRID, SHIFTS, strict=True)):
        cell = [f"floor(({_dot_sql(w)} + {float(x)}) / {WIDTH})::int" for w, x in zip(p, b, strict=True)]
        rows.append(f"select id, {t} tab, {' || chr(58) || '.join(cell)} bucket, true own from s")
        for k in range(probe):
            for step in (-1, 1):
                moved = [f"({c} + {step})" if i == k else c for i, c in enumerate(cell)]
                rows.append(f"select id, {t} tab, {' || chr(58) || '.join(moved)} bucket, false own from s")
    return f"{S}, k as ({' union all '.join(rows)})"


@query(f"with {_plane_sql()} select distinct x.id a, y.id b from k x join k y on x.tab = y.tab and x.bucket = y.bucket and x.id < y.id")
def hyperplane_pairs(spark: SparkSession, d: str) -> DataFrame:
    return lsh.code_pairs(_plane_codes(spark, d), PLANE_TABLES)


@query(f"with {_plane_sql()}, n as (select tab, bucket, count(*) n from k group by 1, 2) select tab::int \"table\", count(*) buckets, sum(n)::bigint items, round(avg(n), 6) mean_size, max(n) max_size, min(n) min_size from n group by tab")
def lsh_bucket_stats(spark: SparkSession, d: str) -> DataFrame:
    return lsh.bucket_stats(_index(spark, d)).withColumn("mean_size", F.round("mean_size", 6))


@query(f"with {_plane_sql()} select distinct least(x.id, y.id) a, greatest(x.id, y.id) b from k x join k y on x.tab = y.tab and (x.bucket = y.bucket or xor(x.bucket, y.bucket) in (1, 2)) and x.id <> y.id")
def multiprobe_pairs(spark: SparkSession, d: str) -> DataFrame:
    return lsh.code_pairs(_plane_codes(spark, d), [lsh.Meeting(tuple(lsh.probes(8, 2)))] * len(PLANES))


@query(f"with {_grid_sql(2)} select distinct least(x.id, y.id) a, greatest(x.id, y.id) b from k x join k y on x.tab = y.tab and x.bucket = y.bucket and x.id <> y.id and y.own")
def grid_lsh_pairs(spark: SparkSession, d: str) -> DataFrame:
    return lsh.code_pairs(_grid_codes(spark, d), [lsh.grid_steps(GRID.shape[1], 2)] * len(GRID))


@query(f"with {_plane_sql()}, {_grid_sql(0).replace(S + ', k as', 'k2 as')}, u as (select x.id a, y.id b from k x join k y on x.tab = y.tab and x.bucket = y.bucket and x.id < y.id union select x.id, y.id from k2 x join k2 y on x.tab = y.tab and x.bucket = y.bucket and x.id < y.id) select a, b from u")
def combined_lsh_pairs(spark: SparkSession, d: str) -> DataFrame:
    both = F.concat(_codes_of(lsh.hyperplane_buckets(F.col("v"), PLANES)), lsh.grid_codes(F.col("v"), GRID, SHIFTS, WIDTH))
    return lsh.code_pairs(_signed(spark, d).select("id", both.alias("codes")), PLANE_TABLES + [lsh.Meeting()] * len(GRID))


FOREST, LEVELS, WANT = lsh.signs(4, 12, 64, seed=13), 9, 10


def _forest_sql() -> str:
    one = "s as (select min(vec_id) id, count(*) n, v from (select vec_id, list_transform(embedding, lambda x: case when x > 0 then 1 else -1 end) v from embeddings) group by v)"
    rows = [f"select id, n, {t} tab, {' + '.join(f'case when {_dot_sql(w)} > 0 then {1 << i} else 0 end' for i, w in enumerate(p))} bucket from s" for t, p in enumerate(FOREST)]
    return f"{one}, k as ({' union all '.join(rows)})"


def _asked_sql() -> str:
    """The tables up to q, each id's level, and e, the buckets of all levels."""
    return f"""{_forest_sql()}, e as (select id, n, tab, lv, bucket % (1 << (12 - lv)::int) p from k, range(0, {LEVELS}) t(lv)), z as (select tab, lv, p, sum(n) s from e group by all),
c as (select id, lv, sum(s - n) c from e join z using (tab, lv, p) group by 1, 2), q as (select id, coalesce(min(case when c >= {WANT} then lv end), {LEVELS - 1}) lv from c group by id)"""


MET = "q join e a on a.id = q.id and a.lv = q.lv join e b on a.tab = b.tab and a.lv = b.lv and a.p = b.p and a.id <> b.id"


@query(f"with {_asked_sql()} select distinct a.id query_id, b.id vec_id, a.lv::int as level from {MET}")
def level_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each distinct sign vector from the longest prefixes that hold ten rows; copies follow the first id."""
    rows = _signed(spark, d).groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    index = rows.select("id", "copies", lsh.hyperplane_buckets(F.col("v"), FOREST).alias("buckets"))
    return lsh.level_candidates(index, 12, LEVELS, WANT).select("query_id", F.col("id").alias("vec_id"), "level")
