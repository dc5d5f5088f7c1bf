"""Items, caches, batches and errors: validation, counts, eviction, packing, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.functions import rules
from kinfold.operators import batches, eviction, ordering, organize, packing, pairing
from kinfold.plans.registry import query
from kinfold.session import materialize, table

NOW = "2030-01-01 00:00:00"

# --- pages as files: names, types and sizes with every defect


def _files(spark: SparkSession, d: str) -> DataFrame:
    """id, name, mime, size, width, height; every seventh or so has a defect."""
    i = F.col("page_id")
    ext = F.element_at(F.array(*[F.lit(x) for x in ("jpg", "png", "heic", "txt", "tiff", "GIF")]), (i % 6 + 1).cast("int"))
    name = F.when(i % 29 == 3, F.lit(None)).when(i % 13 == 5, F.concat(F.lit("page"), i.cast("string"))).otherwise(F.concat(F.lit("page"), i.cast("string"), F.lit("."), ext))
    mime = F.when(i % 4 == 0, "image/jpeg").when(i % 4 == 1, "image/x-odd").when(i % 4 == 2, "image/heic")
    size = F.when(i % 17 == 4, 0).when(i % 19 == 6, F.lit(30_000_000)).otherwise(F.length("html")).cast("long")
    return table(spark, d, "pages").select(i.alias("id"), name.alias("name"), mime.alias("mime"), size.alias("size"), F.when(i % 11 != 7, i * 7 % 900).alias("width"), (i * 5 % 700 + 60).alias("height"))


FILES = """fl as (select page_id id, case when page_id % 29 = 3 then null when page_id % 13 = 5 then 'page' || page_id else 'page' || page_id || '.' || (['jpg', 'png', 'heic', 'txt', 'tiff', 'GIF'])[page_id % 6 + 1] end nm,
 case when page_id % 4 = 0 then 'image/jpeg' when page_id % 4 = 1 then 'image/x-odd' when page_id % 4 = 2 then 'image/heic' end mime, case when page_id % 17 = 4 then 0 when page_id % 19 = 6 then 30000000 else length(html) end::bigint size,
 case when page_id % 11 <> 7 then page_id * 7 % 900 end width, page_id * 5 % 700 + 60 height from pages),
ck as (select *, case when nm is null then 'missing' when size > 20971520 then 'too_large' when size <= 0 then 'empty'
 when not coalesce(mime in ('image/jpeg', 'image/heic'), false) and lower(regexp_extract(nm, '\\.([^.]+)$', 1)) not in ('jpg', 'jpeg', 'png', 'webp', 'gif', 'heic', 'heif', 'bmp', 'tif', 'tiff') then 'bad_format' when width is null then 'corrupt' when width < 100 or height < 100 then 'too_small' end error from fl)"""


def _checked(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).withColumn("error", rules.validation_error(F.col("name"), F.col("mime"), F.col("size"), F.col("width"), F.col("height")))


@query(f"with {FILES} select id, error is null valid, error from ck")
def validate_items(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).select("id", F.col("error").isNull().alias("valid"), "error")


CATEGORY = "case error when 'missing' then 'INPUT_ERROR' when 'too_large' then 'PHOTO_SIZE_ERROR' when 'empty' then 'PHOTO_LOAD_ERROR' when 'corrupt' then 'PHOTO_LOAD_ERROR' else 'PHOTO_FORMAT_ERROR' end"


@query(f"with {FILES} select error, {CATEGORY} category, count(*) n from ck where error is not null group by 1, 2")
def validation_error_counts(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).filter("error is not null").groupBy("error", rules.error_category(F.col("error")).alias("category")).agg(F.count("*").alias("n"))


@query("select page_id, array_to_string(string_split(url, '/')[1:-2], '/') folder, string_split(url, '/')[-1] leaf, 'p_' || length(html) || '_' || page_id cache_key, length(html) * 2 + 64 bytes from pages")
def paths_and_keys(spark: SparkSession, d: str) -> DataFrame:
    size = F.length("html")
    return table(spark, d, "pages").select("page_id", rules.folder(F.col("url")).alias("folder"), F.element_at(F.split("url", "/"), -1).alias("leaf"), rules.cache_key(F.lit("p"), size, F.col("page_id")).alias("cache_key"), rules.object_size(F.array(*[F.lit(0)] * 8), F.col("html")).alias("bytes"))


PRIORITY = """pr as (select page_id id, size, fmt, 10 + page_id % 90 comp, w * h px from (select page_id, length(html) * 1000 size, (['jpg', 'png', 'heic', 'raw', 'tiff', 'gif'])[page_id % 6 + 1] fmt, 1000 + page_id * 41 % 5000 w, 900 + page_id * 31 % 4000 h from pages)),
ps as (select id, size, 5 + case when size > 10485760 then -2 when size < 102400 then 1 else 0 end + case when fmt in ('jpg', 'jpeg', 'png') then 2 else 0 end + case when px > 12000000 then -1 else 0 end + case when comp > 70 then -1 else 0 end priority,
 greatest(50, least(10000, floor(size / 1024 / 10 * (0.5 + comp / 100 * 1.5) * case fmt when 'heic' then 3.0 when 'raw' then 4.0 when 'tiff' then 2.0 when 'gif' then 1.5 else 1.0 end + 0.5)))::int est from pr)"""


def _priced(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id")
    fmt = F.element_at(F.array(*[F.lit(x) for x in ("jpg", "png", "heic", "raw", "tiff", "gif")]), (i % 6 + 1).cast("int"))
    size, comp, px = F.length("html") * 1000, 10 + i % 90, (1000 + i * 41 % 5000) * (900 + i * 31 % 4000)
    return table(spark, d, "pages").select(i.alias("id"), size.cast("long").alias("size"), rules.priority(size, fmt, comp, px).alias("priority"), rules.estimated_time(size, comp, fmt).alias("est"))


@query(f"with {PRIORITY} select id, priority, est, row_number() over (order by priority desc, est, id) place from ps")
def priority_order(spark: SparkSession, d: str) -> DataFrame:
    return ordering.running(_priced(spark, d), [F.desc("priority"), F.col("est"), F.col("id")]).select("id", "priority", "est", F.col("row_no").cast("long").alias("place"))


@query(f"with {PRIORITY} select id, ((row_number() over (order by priority desc, size, id) - 1) // 20)::bigint chunk from ps")
def chunk_batches(spark: SparkSession, d: str) -> DataFrame:
    return ordering.chunked(_priced(spark, d), [F.desc("priority"), F.col("size"), F.col("id")], 20).select("id", "chunk")


LANES = "ln as (select doc_id id, n_chars size, source lane, row_number() over (partition by source order by n_chars, doc_id) k from documents)"


@query(f"""with recursive {LANES}, w(lane, k, id, batch, cnt, total) as (select lane, k, id, 0, 1, size::hugeint from ln where k = 1 union all
 select ln.lane, ln.k, ln.id, case when w.cnt >= 8 or w.total + ln.size > 20000 then w.batch + 1 else w.batch end, case when w.cnt >= 8 or w.total + ln.size > 20000 then 1 else w.cnt + 1 end, case when w.cnt >= 8 or w.total + ln.size > 20000 then ln.size else w.total + ln.size end from w join ln on ln.lane = w.lane and ln.k = w.k + 1)
select id, lane, batch::int batch from w""")
def bin_pack(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("size"), F.col("source").alias("lane"))
    return packing.packed(items, 8, 20000).select("id", "lane", "batch")


@query()
def even_batches(spark: SparkSession, d: str) -> DataFrame:
    tasks = _priced(spark, d).select("id", F.pmod("id", F.lit(7)).cast("int").alias("batch"), F.col("est").cast("long").alias("cost"))
    return batches.evened(tasks)


# --- documents with labels: bands, tags, categories, filters


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    """id, name, quality (0 to 100), tags, category, date."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    df = docs.join(labels, "doc_id", "left")
    quality = F.when(F.col("q").isNotNull(), F.col("q") * 50 + F.col("doc_id") % 50)
    tags = F.array_compact(F.array("lang", F.when(F.col("t") == 1, "toxic"), F.when(F.col("n_chars") > 3000, "long")))
    return df.select(F.col("doc_id").alias("id"), F.substring("text", 1, 20).alias("name"), quality.alias("quality"), tags.alias("tags"), F.when(F.col("doc_id") % 9 != 4, F.col("source")).alias("category"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 3600).alias("date"))


TAGGED = "tg as (select doc_id id, substr(text, 1, 20) nm, q * 50 + doc_id % 50 quality, list_filter([lang, case when t = 1 then 'toxic' end, case when n_chars > 3000 then 'long' end], lambda x: x is not null) tags, case when doc_id % 9 <> 4 then source end category, make_timestamp((1700000000 + doc_id * 3600) * 1000000) dt from documents left join (select doc_id, max(quality) q, max(toxic) t from labels group by 1) using (doc_id))"


@query(f"with {TAGGED} select case when quality >= 80 then 'high' when quality >= 60 then 'medium' else 'low' end band, count(*) n from tg group by 1")
def quality_bands(spark: SparkSession, d: str) -> DataFrame:
    return _tagged(spark, d).groupBy(rules.quality_band(F.col("quality")).alias("band")).agg(F.count("*").alias("n"))


@query(f"with {TAGGED} select tag, count(*) n from (select unnest(tags) tag from tg) group by 1")
def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    return _tagged(spark, d).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query(f"with {TAGGED} select category, count(*) n from tg where category is not null group by 1")
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return _tagged(spark, d).filter("category is not null").groupBy("category").agg(F.count("*").alias("n"))


@query(f"with {TAGGED} select id, quality from tg where quality > 60 and list_contains(tags, 'en') and contains(lower(nm), 'th') order by dt desc, id limit 50 offset 10")
def filter_sort_page(spark: SparkSession, d: str) -> DataFrame:
    """Filters, an order and a page of it, which is the feature."""
    spec = [{"type": "quality", "operator": "gt", "value": 60}, {"type": "tag", "value": "en"}, {"type": "name", "value": "th"}]
    return _tagged(spark, d).filter(rules.predicate(spec)).orderBy(F.desc("date"), "id").offset(10).limit(50).select("id", "quality")


@query("select p_partkey, p_name from part where contains(lower(p_name), 'a') and p_size < 10")
def name_search(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(F.contains(F.lower("p_name"), F.lit("a")) & (F.col("p_size") < 10)).select("p_partkey", "p_name")


@query("select event_type label, user_id, list_slice(list_sort(list(round(value, 6)), 'DESC'), 1, 3) top from events where value > 0.1 group by 1, 2")
def top_labels(spark: SparkSession, d: str) -> DataFrame:
    """The three highest values above .1 of every user and type."""
    kept = table(spark, d, "events").filter("value > 0.1")
    order = W.partitionBy("event_type", "user_id").orderBy(F.desc("value"), "event_id")
    top = kept.withColumn("k", F.row_number().over(order)).filter("k <= 3")
    return top.groupBy(F.col("event_type").alias("label"), "user_id").agg(F.sort_array(F.collect_list(F.round("value", 6)), asc=False).alias("top"))


# --- events as the access log of a cache: last access, uses, size

CACHE = "ca as (select user_id id, max(ts) last_used, min(ts) updated, count(*) uses, floor(sum(value) * 100)::bigint size from events group by user_id)"


def _cache(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("id"))
    return e.agg(F.max("ts").alias("last_used"), F.min("ts").alias("updated"), F.count("*").alias("uses"), F.floor(F.sum(F.col("value").cast("decimal(18,6)")) * 100).cast("long").alias("size"))


CACHE = CACHE.replace("sum(value)", "sum(value::decimal(18,6))")


@query(f"with {CACHE} select count(*) items, sum(size)::bigint bytes, round(avg(size), 6) mean_size, min(updated) oldest, max(last_used) newest, count(*) filter (uses > 60) busy, round(count(*) filter (uses > 60) * 1.0::double / count(*), 6) busy_rate from ca")
def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    busy = F.count_if(F.col("uses") > 60)
    return _cache(spark, d).agg(F.count("*").alias("items"), F.sum("size").alias("bytes"), F.round(F.avg("size"), 6).alias("mean_size"), F.min("updated").alias("oldest"), F.max("last_used").alias("newest"), busy.alias("busy"), F.round(F.try_divide(busy.cast("double"), F.count("*").cast("double")), 6).alias("busy_rate"))


@query(f"with {CACHE}, p as (select id, size, sum(size) over (order by updated, id) s, sum(size) over () t from ca) select id, size from p where s - size < greatest(5000, t - 100000 + 5000)")
def size_budget_evict(spark: SparkSession, d: str) -> DataFrame:
    return eviction.oldest_until(_cache(spark, d), 5000, 100_000).select("id", "size")


@query(f"""with {CACHE}, p as (select *, 0.5 * (1 / (greatest(0, (epoch_us(timestamp '{NOW}') - epoch_us(last_used)) / 1e6 / 2592000) + 1)) + 0.3 * ln(uses + 1.0::double) - 0.2 * (size / 1048576.0::double) pr from ca),
o as (select *, row_number() over (order by pr, id) k, count(*) over () n, sum(size) over (order by pr, id) s, sum(size) over () t from p)
select id, round(pr, 6) priority from o where not (n - (k - 1) <= floor(n * 0.7) and t - (s - size) <= t * 0.7)""")
def cache_priority_cleanup(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit(NOW).cast("timestamp")
    scored = _cache(spark, d).withColumn("priority", eviction.priority_score(F.col("last_used"), F.col("uses"), F.col("size").cast("double"), now))
    return eviction.least_wanted(scored, 0.7, 0.7).select("id", F.round("priority", 6).alias("priority"))


@query(f"with {CACHE} select id, last_used from ca order by last_used desc, id limit 25")
def lru_keep(spark: SparkSession, d: str) -> DataFrame:
    return eviction.most_recent(_cache(spark, d), 25).select("id", "last_used")


@query(f"with {CACHE}, z as (select id, case when id % 5 = 2 then 0 else uses end uses, updated from ca), o as (select *, row_number() over (order by uses > 0, updated, id) k, count(*) over () n from z) select id, k::int k from o where k <= floor(n * case when n > 10000 then 0.2 when n < 1000 then 0.05 else 0.1 end) and floor(n * case when n > 10000 then 0.2 when n < 1000 then 0.05 else 0.1 end) >= 5")
def gc_rank(spark: SparkSession, d: str) -> DataFrame:
    cache = _cache(spark, d).withColumn("uses", F.when(F.col("id") % 5 == 2, 0).otherwise(F.col("uses")))
    gone = eviction.unused_first(cache, least=5)
    return ordering.running(gone, [F.col("uses") > 0, F.col("updated"), F.col("id")]).select("id", F.col("row_no").cast("int").alias("k"))


@query(f"with {CACHE}, o as (select *, row_number() over (order by uses, last_used, id) k, count(*) over () n from ca) select id, uses from o where k <= floor(n * 0.25)")
def prune_share(spark: SparkSession, d: str) -> DataFrame:
    return eviction.least_used(_cache(spark, d), 0.25).select("id", "uses")


@query(f"with {CACHE}, n as (select max(ts) now from events) select id from ca, n where epoch_us(last_used) <= epoch_us(now) - 86400000000")
def ttl_prune(spark: SparkSession, d: str) -> DataFrame:
    now = table(spark, d, "events").agg(F.max("ts").alias("now")).first().now
    return eviction.expired(_cache(spark, d).withColumn("updated", F.col("last_used")), F.lit(now), 1).select("id")


@query(f"with {CACHE}, o as (select *, row_number() over (order by last_used, id) k, count(*) over () n from ca) select id from o where k <= n - 40 and id % 10 <> 1")
def surplus_previews(spark: SparkSession, d: str) -> DataFrame:
    items = _cache(spark, d).select("id", F.col("last_used").alias("loaded"), (F.col("id") % 10 == 1).alias("visible"))
    return eviction.surplus(items, 40).select("id")


@query("select user_id, arg_max(event_id, (ts, event_id)) last_event, arg_min(event_id, (ts, event_id)) first_event from events group by user_id")
def first_and_last(spark: SparkSession, d: str) -> DataFrame:
    at = F.struct("ts", "event_id")
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", at).alias("last_event"), F.min_by("event_id", at).alias("first_event"))


@query("select event_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 9 preceding and current row), 6) mean_value, count(*) over (partition by user_id order by ts, event_id rows between 99 preceding and current row) n from events")
def recent_means(spark: SparkSession, d: str) -> DataFrame:
    """The mean of the last ten values and the count of the last hundred of every user."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.round(F.avg("value").over(w.rowsBetween(-9, 0)), 6).alias("mean_value"), F.count("*").over(w.rowsBetween(-99, 0)).alias("n"))


@query("""with o as (select user_id, ts, value, row_number() over (partition by user_id order by ts desc, event_id desc) k from events where user_id is not null and ts is not null),
s as (select user_id, count(*) uses, max(ts) last_used, round(avg(value) filter (k <= 10), 5) mean_value, least(count(*), 100) kept, min(ts) filter (k <= 100) oldest from o group by user_id)
select * from s where last_used > (select max(ts) from events) - interval 24 hours""")
def access_state(spark: SparkSession, d: str) -> DataFrame:
    """Users by a stateful stream over the events: uses, last use and the last accesses, kept in a keyed table; who is 12 hours behind a watermark of 12 hours is forgotten."""
    from datetime import timedelta

    from kinfold.session import scratch, shared_path
    from kinfold.streaming import accesses

    # A stream reads folders, and a pattern where a table is one file.
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    events = events.select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("id"), "value")
    with scratch(spark):
        state = accesses.table_of(spark, shared_path(spark, "state"))
        accesses.start(accesses.tracked(events, timedelta(hours=12), "12 hours"), state, shared_path(spark, "progress"), once=True).awaitTermination()
        moment = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
        rows = state.read().select(F.col("key").alias("user_id"), "uses", moment("last_used"), F.round("mean_value", 5).alias("mean_value"), "kept", moment("oldest"))
        return materialize(rows, "accesses", outlive=True)


@query("""with e as (select user_id, event_id, ts, case event_type when 'view' then 1 else -1 end step from events where event_type in ('view', 'purchase') and user_id is not null and ts is not null),
c as (select *, sum(step) over (partition by user_id order by ts, event_id) tot, row_number() over (partition by user_id order by ts, event_id) k from e),
m as (select x.user_id, x.k, min(y.k) m from c x join c y on x.user_id = y.user_id and y.k > x.k and y.step < 0 and y.tot = x.tot - 1 where x.step > 0 group by 1, 2),
p as (select x.user_id, x.event_id start_event, y.event_id end_event, epoch_us(y.ts) - epoch_us(x.ts) micros from c x left join m on m.user_id = x.user_id and m.k = x.k left join c y on y.user_id = x.user_id and y.k = m.m where x.step > 0)
select * from p union all select user_id, null, event_id, null from c where step < 0 and event_id not in (select end_event from p where end_event is not null)""")
def event_pairs(spark: SparkSession, d: str) -> DataFrame:
    """What a user views, closed by the purchases after it as brackets are, and how long each took."""
    events = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"), "event_type")
    pairs = pairing.paired(events, F.col("event_type") == "view", F.col("event_type") == "purchase")
    return pairs.select(F.col("key").alias("user_id"), F.col("start_id").alias("start_event"), F.col("end_id").alias("end_event"), (F.unix_micros("end_at") - F.unix_micros("start_at")).alias("micros"))


@query("with h as (select e.event_id, o.o_orderkey is not null hit from events e left join (select distinct o_orderkey from orders) o on o.o_orderkey = e.event_id) select hit, count(*) n from h group by hit")
def cache_probe(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.lit(True).alias("k")).distinct()
    probed = table(spark, d, "events").join(known, "event_id", "left")
    return probed.groupBy(F.col("k").isNotNull().alias("hit")).agg(F.count("*").alias("n"))


# --- events as an error log

ERRORS = "er as (select event_id, event_type kind, (['low', 'medium', 'high', 'critical'])[(event_id + length(event_type)) % 4 + 1] severity, event_id % 3 > 0 recoverable, event_id % 4 > 0 has_action, ts from events)"


def _errors(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    severity = F.element_at(F.array(*[F.lit(x) for x in ("low", "medium", "high", "critical")]), ((i + F.length("event_type")) % 4 + 1).cast("int"))
    return table(spark, d, "events").select(i, F.col("event_type").alias("kind"), severity.alias("severity"), (i % 3 > 0).alias("recoverable"), (i % 4 > 0).alias("has_action"), "ts")


@query(f"with {ERRORS} select kind, severity, count(*) n, count(*) filter (recoverable) recoverable from er group by grouping sets ((kind), (severity), ())")
def error_stats(spark: SparkSession, d: str) -> DataFrame:
    _errors(spark, d).createOrReplaceTempView("kinfold_errors")
    return spark.sql("select kind, severity, count(*) n, count_if(recoverable) recoverable from kinfold_errors group by grouping sets ((kind), (severity), ())")


@query(f"with {ERRORS} select kind, count(distinct severity) severities, count(*) filter (recoverable and not has_action) no_action from er group by kind having count(distinct severity) > 1 or count(*) filter (recoverable and not has_action) > 0")
def anti_patterns(spark: SparkSession, d: str) -> DataFrame:
    return _errors(spark, d).groupBy("kind").agg(F.countDistinct("severity").alias("severities"), F.count_if(F.col("recoverable") & ~F.col("has_action")).alias("no_action")).filter("severities > 1 or no_action > 0")


@query(f"with {ERRORS} select event_id, kind, severity from er order by ts desc, event_id desc limit 20")
def error_history(spark: SparkSession, d: str) -> DataFrame:
    return _errors(spark, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "kind", "severity")


# --- timings

@query("with k as (select o_orderpriority, list_sort(list(o_totalprice)) v from orders group by 1) select o_orderpriority, round(list_avg(v[2:-2]), 4) trimmed, len(v)::bigint n from k where len(v) > 2")
def trimmed_mean(spark: SparkSession, d: str) -> DataFrame:
    """The mean without the least and the greatest value, by sums, so that no group is gathered."""
    p = F.col("o_totalprice")
    g = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.sum(p).alias("s"), F.min(p).alias("low"), F.max(p).alias("high"), F.count("*").alias("n")).filter("n > 2")
    return g.select("o_orderpriority", F.round((F.col("s") - F.col("low") - F.col("high")) / (F.col("n") - 2), 4).alias("trimmed"), "n")


@query("select l_orderkey, round(sum(power(1.5, l_linenumber) * l_quantity) / sum(power(1.5, l_linenumber)), 6) progress from lineitem group by 1")
def weighted_progress(spark: SparkSession, d: str) -> DataFrame:
    w = F.pow(F.lit(1.5), F.col("l_linenumber"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(w * F.col("l_quantity")) / F.sum(w), 6).alias("progress"))


@query("select event_type, user_id % 10 batch, count(*) n, round(avg(value), 6) mean_value, round(sum(value) / 1000, 6) per_second from events group by 1, 2")
def batch_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 10).alias("batch")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.sum("value") / 1000, 6).alias("per_second"))


@query("select c_mktsegment, n_name, count(*) n from customer join nation on c_nationkey = n_nationkey group by 1, 2")
def dimension_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Counts by the name of a small dimension."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, d, "customer").join(nation, "c_nationkey").groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("n"))


@query("with old as (select doc_id id, max(quality) v from labels group by 1), nw as (select doc_id id, max((n_chars > 1000)::int) v from documents group by 1) select case when old.id is null then 'added' when nw.id is null then 'kept' when old.v = nw.v then 'same' else 'updated' end as change, count(*) n from old full join nw on old.id = nw.id group by 1")
def upsert_changes(spark: SparkSession, d: str) -> DataFrame:
    """What an upsert of marks read off the documents' sizes changes in the marks of the labels."""
    from kinfold.streaming.upsert import changes

    old = table(spark, d, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("v"))
    new = table(spark, d, "documents").groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("n_chars") > 1000).cast("int")).alias("v"))
    return changes(old, new, ["id"]).groupBy("change").agg(F.count("*").alias("n"))


@query("""with odd as (select source from documents group by source having min(doc_id) % 2 = 1),
l as (select doc_id, max(quality) quality, max(toxic) toxic from labels group by doc_id),
d as (select doc_id, source, lang, n_chars, quality, coalesce(toxic, 0) toxic from documents left join l using (doc_id))
select doc_id id, source parent, case when lang = 'de' then -1 when lang = 'fr' then n_chars else quality end v from d
where lang = 'de' or ((lang = 'fr' or quality is not null) and toxic = 0 and source not in (select source from odd))""")
def keyed_table_state(spark: SparkSession, d: str) -> DataFrame:
    """A keyed table after upserts, tombstones by key and by parent, merging of deltas and a rebuild of the base."""
    from kinfold.session import scratch, shared_path
    from kinfold.streaming.deltas import DeltaTable

    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = lambda df, v: df.select(F.col("doc_id").alias("id"), F.col("source").alias("parent"), v.cast("long").alias("v"), F.col("n_chars").alias("at"))
    with scratch(spark):
        state = DeltaTable(spark, shared_path(spark, "keyed"), ["id"], "id long, parent string, v long, at long", buckets=16)
        state.upsert(rows(docs.join(labels, "doc_id"), F.col("quality")), ["at"])
        state.rebuild()
        state.upsert(rows(docs.filter("lang = 'fr'"), F.col("n_chars")), ["at"])
        state.delete(labels.filter("toxic = 1").select(F.col("doc_id").alias("id")))
        state.update()
        state.delete_children(docs.groupBy(F.col("source").alias("parent")).agg(F.min("doc_id").alias("first")).filter(F.col("first") % 2 == 1).select("parent"), "parent")
        state.upsert(rows(docs.filter("lang = 'de'"), F.lit(-1)), ["at"])
        state.compact()
        state.vacuum()
        return materialize(state.read().select("id", "parent", "v"), "state", outlive=True)


# --- features of chosen items, parameters by size, released vectors, tags


@query("""select o_custkey id, o_orderkey feature_id, l_linenumber::int line, round(l_extendedprice, 2) price from orders join lineitem on l_orderkey = o_orderkey join customer on c_custkey = o_custkey where c_mktsegment = 'BUILDING'""")
def item_features(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the orders of the customers of one segment."""
    wanted = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"))
    mapping = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("feature_id"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("feature_id"), F.col("l_linenumber").cast("int").alias("line"), F.round("l_extendedprice", 2).alias("price"))
    return organize.features_of(wanted, mapping, lines).select("id", "feature_id", "line", "price")


@query("""with m as (select source, count(*) items, avg(length(text)::double * 1000) b from documents group by source)
select source, items, (case when b / 1048576 > 5 then 6 when b / 1048576 > 2 then 8 else 12 end)::int batch_size, floor(50 + b / 1048576 * 10 + 0.5)::int delay from m""")
def batch_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Size of batches and delay for each source, a character taken for a thousand bytes, on eight cores with 8 GB."""
    sizes = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("items"), F.avg(F.length("text").cast("double") * 1000).alias("b"))
    return sizes.select("source", "items", rules.batch_parameters(F.col("b"), F.lit(8), F.lit(8)).alias("p")).select("source", "items", "p.*")


@query("""with n as (select max(ts) t from events), u as (select user_id, max(ts) last from events group by 1)
select vec_id, case when epoch_us(t) - epoch_us(last) > 600000000 then 0 else len(embedding) end::int held from embeddings left join u on user_id = vec_id, n""")
def released_vectors(spark: SparkSession, d: str) -> DataFrame:
    """How much of each vector is held ten minutes after its user's last event, counted from the last of all."""
    events = table(spark, d, "events")
    last = events.groupBy("user_id").agg(F.max("ts").alias("last"))
    # One row.
    now = last.agg(F.max("last").alias("now"))
    idle = (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 1e6
    rows = table(spark, d, "embeddings").join(last, F.col("user_id") == F.col("vec_id"), "left").crossJoin(F.broadcast(now))
    return rows.select("vec_id", F.size(rules.released(F.col("embedding"), idle)).alias("held"))


@query("""select page_id id, list_concat(case when page_id % 3 = 0 then ['old'] else [] end, case when length(html) > 2000 then ['long'] else [] end) tags, case when url like 'https%' then 'secure' end category from pages""")
def tagged_items(spark: SparkSession, d: str) -> DataFrame:
    """A tag for the long pages, a category for those with a secure address."""
    pages = table(spark, d, "pages").withColumn("tags", F.when(F.col("page_id") % 3 == 0, F.array(F.lit("old"))))
    tagged = rules.with_tag(F.col("tags"), F.when(F.length("html") > 2000, F.lit(" long ")).otherwise(F.lit("  ")))
    return pages.select(F.col("page_id").alias("id"), tagged.alias("tags"), F.when(F.col("url").startswith("https"), "secure").alias("category"))
