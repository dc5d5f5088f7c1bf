"""Personal data by bootstrapped contextual extraction; DataFrame functions only.

Seeds are e-mail addresses, IP addresses, card and phone numbers found by fixed patterns, as whole spans. Every
identifier-like token (letters, digits and a few signs, a digit among them) that overlaps none of them is a candidate. Both
are instances; the words before an instance are its lexical patterns. Rounds over the graph of patterns and instances score both: a pattern by the mean score of its distinct
instances, smoothed; an instance by the chance that any of its patterns is right; seeds stay at 1. Instances of patterns
that enough distinct seeds support, with a score of at least ``ACCEPT``, are new spans of kind ``context``.

Positions are code points, ends exclusive. The patterns are written with look-behinds and possessive repeats, so that no
text makes them run longer than its length; they match what the plain ones do.

Defined cases: null texts are empty; rows are judged one by one, repeated ones alike; spans of different kinds may
overlap; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.session import materialize

# Kinds in their order and their patterns.
KINDS = ("email", "ip", "card", "phone", "context")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![0-9])(?![\x20-][0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
INSTANCE = r"(?<![A-Za-z0-9._%+@-])(?=[A-Za-z._%+@-]*+[0-9])[A-Za-z0-9._%+@-]{8,}+"
#: Code points before an instance that its context is read from.
CONTEXT = 48
ROUNDS = 3
#: Distinct seeds that support a pattern, and the score from which an instance is taken.
SUPPORT, ACCEPT = 3, 0.6
SMOOTHING = 1.0


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, value, before) of every match; ``before`` is the text before it, CONTEXT code points at most."""
    both = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda m, p: F.struct(m.alias("m"), p.alias("p")))
    empty = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,value:string,before:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        before = F.right(F.concat(acc["tail"], x["p"]), F.lit(CONTEXT))
        found = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("value"), before.alias("before"))
        tail = F.right(F.concat(before, x["m"]), F.lit(CONTEXT))
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(end.alias("at"), tail.alias("tail"), F.concat(acc["out"], F.array(found)).alias("out")))

    return F.aggregate(both, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), empty.alias("out")), step, lambda acc: acc["out"])


def _luhn(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")

    def add(acc: Column, i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return acc + F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _small_parts(value: Column) -> Column:
    def fits(part: Column) -> Column:
        short = F.regexp_replace(part, "^0+", "")
        return (F.length(short) < 3) | ((F.length(short) == 3) & (short <= "255"))

    return F.forall(F.split(value, r"\."), fits)


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def base_spans(text: Column) -> dict[str, Column]:
    """Array of spans for each seed kind."""
    digit = text.rlike("[0-9]")
    none = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,value:string,before:string>>")
    return {
        "email": F.when(F.contains(text, F.lit("@")), matches(text, EMAIL)).otherwise(none),
        "ip": F.when(digit, F.filter(matches(text, IP), lambda s: _small_parts(s["value"]))).otherwise(none),
        "card": F.when(digit, F.filter(matches(text, CARD), lambda s: _luhn(s["value"]))).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(matches(text, PHONE), lambda s: _digits(s["value"]).between(10, 15))).otherwise(none),
    }


def _contexts(before: Column) -> Column:
    """Lexical patterns of an instance: the one and the two words before it, with its leading signs."""
    shown = F.regexp_replace(F.lower(before), "[0-9]+", "0")
    one = F.regexp_extract(shown, r"(\S+\s*)$", 1)
    two = F.regexp_extract(shown, r"(\S+\s+\S+\s*)$", 1)
    trim = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.filter(F.array(F.concat(F.lit("1:"), trim(one)), F.concat(F.lit("2:"), trim(two))), lambda c: F.length(c) > 2)


def _of_kind(spans: str, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def _joined(spans: Column) -> Column:
    """kind:start:end of spans (start, kind number, end), comma-joined in their order."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def score_graph(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """value, score of the instances in ``edges`` (pattern, value, seed) that are no seeds."""
    edges = materialize(edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "edges")
    scores = edges.groupBy("value").agg(F.max("seed").cast("double").alias("score"))
    for _ in range(rounds):
        held = edges.join(scores, "value")
        patterns = held.groupBy("pattern").agg((F.sum("score") / (F.count("*") + SMOOTHING)).alias("confidence"), F.sum(F.col("seed").cast("int")).alias("support")).filter(F.col("support") >= SUPPORT)
        # 1 - prod(1 - confidence), by logarithms; a confidence is below 1.
        found = edges.filter(~F.col("seed")).join(patterns, "pattern").groupBy("value").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("found"))
        seeds = edges.groupBy("value").agg(F.max("seed").cast("double").alias("seed_score"))
        scores = materialize(seeds.join(found, "value", "left").select("value", F.greatest("seed_score", F.coalesce("found", F.lit(0.0))).alias("score")), "scores")
    seeds = edges.filter("seed").select("value").distinct()
    return scores.join(seeds, "value", "left_anti")


def find_private(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_context, base_sha256, spans of each row of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", *[c.alias(k) for k, c in base_spans(text).items()], F.when(text.rlike("[0-9]"), matches(text, INSTANCE)).alias("instances"))
    kinds = KINDS[:-1]
    base = F.concat(*[_of_kind(k, i) for i, k in enumerate(kinds)])
    seeds = F.concat(*[F.transform(k, lambda s: F.struct(s["value"].alias("value"), s["before"].alias("before"))) for k in kinds])
    found = found.select("rid", "doc_id", base.alias("base"), seeds.alias("seeds"), *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds], "instances")
    found = materialize(found, "found")
    overlaps = F.exists("base", lambda b: (b["start"] < F.col("i.end")) & (b["end"] > F.col("i.start")))
    instances = found.select("rid", "base", F.explode("instances").alias("i")).filter(~overlaps).select("rid", "i.start", "i.end", F.lower("i.value").alias("value"), "i.before", F.lit(False).alias("seed"))
    sown = found.select(F.explode("seeds").alias("i")).select(F.lower("i.value").alias("value"), "i.before", F.lit(True).alias("seed"))
    edges = instances.select("value", "before", "seed").unionByName(sown).select("value", "seed", F.explode(_contexts(F.col("before"))).alias("pattern"))
    good = score_graph(edges, rounds).filter(F.col("score") >= ACCEPT)
    new = instances.join(good, "value").groupBy("rid").agg(F.collect_list(F.struct("start", F.lit(len(kinds)).alias("kind"), "end")).alias("new"))
    joined = found.drop("instances", "seeds").join(new, "rid", "left")
    every = F.concat("base", F.coalesce("new", F.array().cast("array<struct<start:int,kind:int,end:int>>")))
    counts = [f"n_{k}" for k in kinds]
    return joined.select("doc_id", *counts, F.when(F.col("new").isNotNull(), F.size("new")).otherwise(0).cast("long").alias("n_context"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    return find_private(docs.select("doc_id", "text"))
