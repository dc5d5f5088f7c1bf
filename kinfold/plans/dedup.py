"""Near duplicates of documents by SimHash: pairs, groups, what stays and what goes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import rules
from kinfold.operators import clustering, organize, radius, simhash
from kinfold.plans.registry import query
from kinfold.session import materialize, table

#: Hamming distance of similarity 90 and above.
MOST = 6


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return materialize(simhash.classes(simhash.simhash(table(spark, d, "documents"), "doc_id", "text")), "classes")


def _groups(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Signatures of all documents, and (leader, member) over documents: copies of a signature follow its first id."""
    signed = materialize(simhash.simhash(table(spark, d, "documents"), "doc_id", "text"), "signed")
    classes = materialize(simhash.classes(signed), "classes")
    found = clustering.disjoint_groups(materialize(simhash.near_pairs(classes, MOST), "pairs").select("a", "b"))
    heads = classes.select(F.col("id").alias("head"), "hi", "lo").join(found.withColumnRenamed("member", "head"), "head", "left").select("hi", "lo", F.coalesce("leader", "head").alias("leader"))
    members = signed.join(heads, ["hi", "lo"]).select("leader", F.col("id").alias("member")).filter("leader <> member")
    return signed, materialize(members, "groups")


def _items(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source")
    return docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("id"), F.coalesce("quality", F.lit(0)).alias("quality"), "n_chars", F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang")).alias("name"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 3600).alias("taken"))


def _best(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    _, groups = _groups(spark, d)
    items = _items(spark, d)
    best = materialize(organize.best_members(organize.whole_groups(groups), items.select("id", "quality", "n_chars")), "best")
    return items, groups, best


def _word_bits() -> str:
    out = []
    for c, at in (("hi", 1), ("lo", 9)):
        out.append(" + ".join(f"case when 2 * sum((({c} >> {i}) & 1)) > count(*) then {1 << i} else 0 end" for i in range(32)) + f" {c}")
    return ", ".join(out)


SIGNED = f"""
tok as (select doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> ''))) w from documents),
half as (select doc_id, ('0x' || substr(md5(w), 1, 8))::bigint hi, ('0x' || substr(md5(w), 9, 8))::bigint lo from tok),
signed as (select doc_id id, {_word_bits()} from half group by doc_id),
cls as (select min(id) id, hi, lo, count(*) members from signed group by hi, lo),
allp as (select x.id a, y.id b, bit_count(xor(x.hi::bigint, y.hi::bigint)) + bit_count(xor(x.lo::bigint, y.lo::bigint)) dist from cls x join cls y on x.id < y.id),
near as (select a, b, dist from allp where dist <= {MOST})"""
LEADERS = """
nodes as (select row_number() over (order by id) k, id from (select a id from near union select b from near)),
prev as (select b id, list(a) p from near group by b),
walk(k, led) as (select 0::bigint, []::bigint[] union all
  select walk.k + 1, case when list_has_any(coalesce(prev.p, []::bigint[]), walk.led) then walk.led else list_append(walk.led, nodes.id) end
  from walk join nodes on nodes.k = walk.k + 1 left join prev on prev.id = nodes.id),
led as (select unnest(led) id from walk where k = (select max(k) from walk))"""
GROUPS = f"""{SIGNED}, {LEADERS},
heads as (select b head, min(a) leader from near join led on near.a = led.id where b not in (select id from led) group by b),
grp as (select coalesce(heads.leader, cls.id) leader, signed.id member from signed join cls using (hi, lo) left join heads on heads.head = cls.id where signed.id <> coalesce(heads.leader, cls.id)),
whole as (select leader, member from grp union select leader, leader from grp),
items as (select doc_id id, coalesce(quality, 0) quality, n_chars, source || '/doc_' || doc_id || '.' || lang nm from documents left join (select doc_id, max(quality) quality from labels group by doc_id) using (doc_id)),
best as (select leader, arg_max(id, (quality, n_chars, -id)) best, count(*)::bigint size from whole join items on member = id group by leader)"""


@query(f"with {SIGNED} select id doc_id, hi::bigint hi, lo::bigint lo from signed")
def simhash_documents(spark: SparkSession, d: str) -> DataFrame:
    return simhash.simhash(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


BANDS4 = "(x.hi >> 16 = y.hi >> 16 or x.hi & 65535 = y.hi & 65535 or x.lo >> 16 = y.lo >> 16 or x.lo & 65535 = y.lo & 65535)"


@query(f"with {SIGNED} select x.id a, y.id b, (bit_count(xor(x.hi::bigint, y.hi::bigint)) + bit_count(xor(x.lo::bigint, y.lo::bigint)))::int distance from cls x join cls y on x.id < y.id and {BANDS4.replace('x.hi', 'x.hi::bigint').replace('y.hi', 'y.hi::bigint').replace('x.lo', 'x.lo::bigint').replace('y.lo', 'y.lo::bigint')}")
def lsh_band_candidates(spark: SparkSession, d: str) -> DataFrame:
    return simhash.band_pairs(_classes(spark, d), 4)


@query(f"with {SIGNED} select a, b, dist::int distance, round(100 * (1 - dist / 64.0::double), 6) similarity from near")
def near_pairs(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_pairs(_classes(spark, d), MOST).withColumn("similarity", F.round(100 * (1 - F.col("distance") / 64.0), 6))


#: Bands of 16 bits, and how far two signatures within MOST bits may be apart in one of them.
RADII = radius.radii(MOST, 4)
BAND_DISTANCES = ", ".join(f"bit_count({half}) d{b}" for b, half in enumerate(f"xor(x.{c}::bigint, y.{c}::bigint) {cut}" for c in ("hi", "lo") for cut in (">> 16", "& 65535")))


@query(f"""with {SIGNED}, apart as (select dist, {BAND_DISTANCES} from allp join cls x on x.id = a join cls y on y.id = b)
{' union all '.join(f"select {b}::int band, {r}::int radius, {len(radius.masks(16, r))}::int as keys, count(*) filter (d{b} <= {r}) candidates, count(*) filter (d{b} <= {r} and dist <= {MOST}{''.join(f' and d{e} > {RADII[e]}' for e in range(b))}) pairs from apart" for b, r in enumerate(RADII))}""")
def radius_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Of each band of 16 bits: its radius, the keys that a signature asks for, pairs that meet, near pairs first met there."""
    classes = _classes(spark, d).select("id", "hi", "lo")
    met = radius.candidates(classes, classes, MOST, 4).filter("a < b")
    count = met.withColumn("first", radius.first_band(MOST, 4)).groupBy("band").agg(F.count("*").alias("candidates"), F.count_if((F.col("distance") <= MOST) & (F.col("band") == F.col("first"))).alias("pairs"))
    every = spark.createDataFrame([(b, r, len(radius.masks(16, r))) for b, r in enumerate(RADII)], "band int, radius int, keys int")
    return every.join(count, "band", "left").select("band", "radius", "keys", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("pairs", F.lit(0)).alias("pairs"))


@query(f"with {SIGNED} select dist::int distance, count(*) pairs from allp group by dist")
def hamming_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Distances of all pairs of signatures, in blocks."""
    from kinfold.operators.blocks import distance_counts

    return distance_counts(_classes(spark, d).select("id", simhash.whole().alias("bits")))


BANDS4_KEYS = "(select id, 0 band, hi::bigint >> 16 k from cls union all select id, 1, hi::bigint & 65535 from cls union all select id, 2, lo::bigint >> 16 from cls union all select id, 3, lo::bigint & 65535 from cls)"


@query(f"with {SIGNED}, n as (select band, k, count(*) n from {BANDS4_KEYS} group by 1, 2) select band, count(*) buckets, round(avg(n), 6) mean_size, max(n) max_size from n group by band")
def band_bucket_stats(spark: SparkSession, d: str) -> DataFrame:
    return simhash.band_stats(_classes(spark, d), 4).withColumn("mean_size", F.round("mean_size", 6))


@query(f"with {SIGNED}, cand as (select a, b, dist from allp join cls x on x.id = a join cls y on y.id = b where {BANDS4.replace('x.hi', 'x.hi::bigint').replace('y.hi', 'y.hi::bigint').replace('x.lo', 'x.lo::bigint').replace('y.lo', 'y.lo::bigint')}) select (select count(*) from near) exact_pairs, count(*) candidates, count(*) filter (dist <= {MOST}) found from cand")
def lsh_recall(spark: SparkSession, d: str) -> DataFrame:
    classes = _classes(spark, d)
    exact = simhash.near_pairs(classes, MOST).agg(F.count("*").alias("exact_pairs")).withColumn("k", F.lit(1))
    found = simhash.band_pairs(classes, 4).agg(F.count("*").alias("candidates"), F.count_if(F.col("distance") <= MOST).alias("found")).withColumn("k", F.lit(1))
    return exact.join(found, "k").drop("k")


@query(f"with recursive {GROUPS} select leader, member, best, size from whole join best using (leader)")
def dedup_groups(spark: SparkSession, d: str) -> DataFrame:
    _, groups, best = _best(spark, d)
    return organize.whole_groups(groups).join(best, "leader").select("leader", "member", "best", "size")


@query(f"with recursive {SIGNED}, {LEADERS}, b2 as (select a, b from near union select b, a from near) select a leader, b member from b2 join led on b2.a = led.id")
def dedup_groups_overlap(spark: SparkSession, d: str) -> DataFrame:
    pairs = materialize(simhash.near_pairs(_classes(spark, d), MOST), "pairs")
    return clustering.overlapping_groups(pairs.select("a", "b"))


@query(f"with recursive {GROUPS} select (select count(*) from documents) total, coalesce(sum(size - 1), 0)::bigint duplicates, (select count(*) from documents) - coalesce(sum(size - 1), 0)::bigint kept, count(*) as groups, floor(coalesce(sum(size - 1), 0) * 100.0 / (select count(*) from documents) + 0.5)::int percent from best")
def dedup_summary(spark: SparkSession, d: str) -> DataFrame:
    items, _, best = _best(spark, d)
    return organize.summary(items, best)


@query(f"with recursive {GROUPS} select doc_id from documents where doc_id not in (select member from whole)")
def ungrouped_items(spark: SparkSession, d: str) -> DataFrame:
    _, groups = _groups(spark, d)
    return table(spark, d, "documents").select("doc_id").join(organize.whole_groups(groups).select(F.col("member").alias("doc_id")), "doc_id", "left_anti")


@query(f"with recursive {GROUPS} select distinct source, leader from documents join whole on doc_id = member")
def groups_in_batch(spark: SparkSession, d: str) -> DataFrame:
    """The groups that touch each batch of documents; a batch is a source."""
    _, groups = _groups(spark, d)
    whole = organize.whole_groups(groups).withColumnRenamed("member", "doc_id")
    return table(spark, d, "documents").select("doc_id", "source").join(whole, "doc_id").select("source", "leader").distinct()


@query(f"with recursive {GROUPS} select doc_id id, case when leader is null or doc_id = best then 'keep' else 'delete' end as action, leader from documents left join (select member, leader, best from whole join best using (leader)) on doc_id = member")
def organize_actions(spark: SparkSession, d: str) -> DataFrame:
    items, groups, best = _best(spark, d)
    return organize.actions(items, groups, best)


@query(f"""with recursive {GROUPS}, act as (select doc_id id, leader from documents left join (select member, leader, best from whole join best using (leader)) on doc_id = member where leader is null or doc_id = best),
num as (select id, row_number() over (order by leader is null, coalesce(leader, id), id) number from act)
select id, number, 'IMG_' || strftime(make_timestamp((1700000000 + id * 3600) * 1000000), '%Y%m%d') || '_' || left(lpad(number::varchar, 4, '0'), 4) || '.' || string_split(nm, '.')[-1] new_name from num join items using (id)""")
def rename_plan(spark: SparkSession, d: str) -> DataFrame:
    items, groups, best = _best(spark, d)
    return organize.renames(items.select("id", "name", "taken"), organize.actions(items, groups, best))


@query(f"""with recursive {GROUPS} select leader, '{{"group":' || leader || ',"count":' || size || ',"best":"' || nm || '"}}' report from best join items on best = id""")
def organize_report(spark: SparkSession, d: str) -> DataFrame:
    items, groups, best = _best(spark, d)
    return organize.report(None, best, items)


@query(f"with recursive {GROUPS} select leader, ((row_number() over (order by leader) - 1) // 20)::bigint chunk from best")
def group_chunks(spark: SparkSession, d: str) -> DataFrame:
    _, _, best = _best(spark, d)
    return organize.chunks_of_groups(best, 20)


@query(f"with recursive {GROUPS} select leader, count(*) members, round(avg(100 * (1 - (bit_count(xor(x.hi::bigint, y.hi::bigint)) + bit_count(xor(x.lo::bigint, y.lo::bigint))) / 64.0::double)), 6) similarity from grp join signed x on x.id = leader join signed y on y.id = member group by leader")
def group_similarity(spark: SparkSession, d: str) -> DataFrame:
    """The mean similarity of each group's members to its leader."""
    signed, groups = _groups(spark, d)
    from kinfold.functions.distances import bit_distance

    side = lambda p, name: signed.select(F.col("id").alias(name), F.col("hi").alias(f"{p}hi"), F.col("lo").alias(f"{p}lo"))
    both = groups.join(side("x", "leader"), "leader").join(side("y", "member"), "member")
    distance = bit_distance(F.col("xhi"), F.col("yhi")) + bit_distance(F.col("xlo"), F.col("ylo"))
    return both.groupBy("leader").agg(F.count("*").alias("members"), F.round(F.avg(100 * (1 - distance / 64.0)), 6).alias("similarity"))


@query("select sha256(text) digest, count(*) copies, min(doc_id) first_id, max(n_chars) n_chars from documents group by 1 having count(*) > 1")
def exact_duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return docs.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.max("n_chars").alias("n_chars")).filter("copies > 1")


@query("select doc_id, sha256(string_agg(sha256(part), '' order by i)) digest, count(*) parts from (select doc_id, i, part from (select doc_id, unnest(string_split(text, chr(10))) part, generate_subscripts(string_split(text, chr(10)), 1) i from documents)) group by doc_id")
def segmented_digest(spark: SparkSession, d: str) -> DataFrame:
    """A digest of the digests of a text's lines, in order."""
    parts = F.split("text", "\n", -1)
    joined = F.concat_ws("", F.transform(parts, lambda p: F.sha2(p.cast("binary"), 256)))
    return table(spark, d, "documents").select("doc_id", F.sha2(joined.cast("binary"), 256).alias("digest"), F.size(parts).cast("long").alias("parts"))


@query("select doc_id, case when n_chars < 1024 then n_chars || ' B' when n_chars < 1048576 then printf('%.2f', floor(n_chars / 1024.0::double * 100 + 0.5) / 100) || ' KB' else printf('%.2f', floor(n_chars / 1048576.0::double * 100 + 0.5) / 100) || ' MB' end shown, case when n_chars // 60 = 0 then n_chars || 's' else (n_chars // 60) || 'm ' || (n_chars % 60) || 's' end lasting from documents")
def format_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", rules.format_bytes(F.col("n_chars")).alias("shown"), rules.format_seconds(F.col("n_chars")).alias("lasting"))
