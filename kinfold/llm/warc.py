"""WARC archives as a chunked record table.

A payload is a run of chunk rows (record id, chunk number, bytes) of at most ``CHUNK`` bytes, written as WARC 1.1
records: the first chunk as response, the others as continuation segments (WARC-Segment-Number, -Origin-ID,
-Total-Length). Nothing but Spark's text source writes and reads the files, so any store will do; every record begins
with a boundary drawn for the archive set, at which the reader splits, so that a payload may hold anything.

Payloads are cut as they are read from the table, before any shuffle. The digest of a record of one chunk is taken where it
stands; chunks of longer ones meet by record id, in order, and run through one incremental digest, in writing and in
reading, so that no task puts a payload together. What reading reports is what it read, not what headers say.

Defined cases: a null payload is empty; among equal payloads every row with the smallest page_id is a response, the
others revisit it, null ids come last; payloads below ``least`` bytes are all responses; repeated rows are written and
read as rows of their own; further columns, of any name, are ignored; an empty table makes an archive set without records.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import sized_join, text_batches
from kinfold.session import materialize, scratch, shared_path

CHUNK = 1 << 16
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n"
#: Fields that a record carries beside those of the standard.
ID, LENGTH = "X-Page-ID", "X-Payload-Length"


def base32(hexadecimal: Column) -> Column:
    """Base 32 of a 40-digit hexadecimal digest: five hex digits are four digits of base 32."""
    groups = [F.lpad(F.conv(F.substring(hexadecimal, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def classify(digests: DataFrame, least: int = 0) -> DataFrame:
    """rid, record_type, refers_to beside the columns of ``digests`` (rid, page_id, payload_bytes, payload_digest)."""
    firsts = digests.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    joined = digests.join(firsts, "payload_digest", "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("payload_bytes") >= least)
    return joined.select("rid", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"))


def chunks(pages: DataFrame) -> DataFrame:
    """Chunk rows of ``payload``: all other columns, chunk_no from 0, n_chunks, body. An empty payload has one empty chunk."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("payload") / CHUNK)).cast("int")
    cut = pages.withColumn("n_chunks", n).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    return cut.withColumn("body", F.substring(F.col("payload"), F.col("chunk_no") * CHUNK + 1, F.lit(CHUNK))).drop("payload")


def run_digests(rows: DataFrame) -> DataFrame:
    """run, read_bytes, read_digest: length and digest of the chunks (run, number, body) of each run, in order.

    A run is never put together: its chunks stream through one incremental digest.
    """
    ordered = rows.repartition("run").sortWithinPartitions("run", "number").select("run", "body")
    found = ordered.mapInArrow(_digest_runs, f"run {dict(rows.dtypes)['run']}, read_bytes long, read_digest string")
    return found.select("run", "read_bytes", base32(F.col("read_digest")).alias("read_digest"))


def digests(cut: DataFrame) -> DataFrame:
    """rid, page_id, payload_bytes, payload_digest of the chunk rows of records."""
    single = cut.filter("n_chunks = 1").select("rid", "page_id", F.octet_length("body").cast("long").alias("payload_bytes"), base32(F.sha1("body")).alias("payload_digest"))
    runs = run_digests(cut.filter("n_chunks > 1").select(F.col("rid").alias("run"), F.col("chunk_no").alias("number"), "body"))
    heads = cut.filter("n_chunks > 1 and chunk_no = 0").select("rid", "page_id")
    return single.unionByName(heads.join(runs, F.col("rid") == F.col("run")).select("rid", "page_id", F.col("read_bytes").alias("payload_bytes"), F.col("read_digest").alias("payload_digest")))


def _record_id(c: Column, number: Column) -> Column:
    h = F.md5(F.concat_ws(":", c, number.cast("string")).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(END))).otherwise(F.lit(""))


def write_archives(pages: DataFrame, least: int = 0, path: str | None = None) -> tuple[str, str]:
    """Write a record for each row of ``pages`` (page_id, url, html); the path of the archive set and its boundary."""
    spark = pages.sparkSession
    text_batches(spark)
    path, boundary = path or shared_path(spark, "warc"), uuid.uuid4().hex
    with scratch(spark):
        # Payloads are cut before anything else; from here on no row is longer than a chunk.
        rows = pages.select(F.monotonically_increasing_id().alias("rid"), F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
        cut = materialize(chunks(rows), "chunks")
        kinds = materialize(classify(materialize(digests(cut), "digests"), least), "kinds")
        _write(sized_join(cut, kinds, "rid"), path, boundary)
    return path, boundary


def _write(typed: DataFrame, path: str, boundary: str) -> None:
    """Write chunk rows with record_type, refers_to, payload_bytes, payload_digest as records."""
    again = F.col("record_type") == "revisit"
    typed = typed.filter(~again | (F.col("chunk_no") == 0)).withColumn("body", F.when(again, F.lit(b"")).otherwise(F.col("body"))).withColumn("n_chunks", F.when(again, 1).otherwise(F.col("n_chunks")))
    rid = F.concat_ws("-", F.lit(boundary), F.col("rid").cast("string"))
    first, long = F.col("chunk_no") == 0, F.col("n_chunks") > 1
    last = F.col("chunk_no") == F.col("n_chunks") - 1
    kind = F.when(first, F.col("record_type")).otherwise("continuation")
    header = F.concat(
        F.lit(f"WARC/1.1{END}X-Boundary: {boundary}{END}"),
        _field("WARC-Type", kind),
        _field("WARC-Record-ID", _record_id(rid, F.col("chunk_no"))),
        _field("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        _field("WARC-Target-URI", F.when(first, F.regexp_replace("url", "[\\r\\n]", " "))),
        _field("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), "payload_digest"))),
        _field("WARC-Profile", F.when(kind == "revisit", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _field("X-Refers-To-Page-ID", F.col("refers_to")),
        _field("WARC-Segment-Number", F.when(long, F.col("chunk_no") + 1)),
        _field("WARC-Segment-Origin-ID", F.when(~first, _record_id(rid, F.lit(0)))),
        _field("WARC-Segment-Total-Length", F.when(long & last, F.col("payload_bytes"))),
        _field(ID, F.when(first, F.col("page_id"))),
        _field(LENGTH, F.when(first, F.col("payload_bytes"))),
        _field("Content-Length", F.octet_length("body")),
        F.lit(END),
    )
    record = F.concat(header.cast("binary"), F.col("body"))
    typed.select(record.cast("string").alias("value")).write.option("lineSep", END * 2).option("compression", "gzip").text(path)


def read_chunks(spark: SparkSession, path: str, boundary: str) -> DataFrame:
    """Chunk rows of an archive set: head (map of the header's fields) and body."""
    raw = spark.read.option("lineSep", f"WARC/1.1{END}X-Boundary: {boundary}{END}").schema("value string").text(path).filter(F.octet_length("value") > 0)
    head = F.substring_index("value", END * 2, 1)
    parsed = raw.select(F.str_to_map(head, F.lit(END), F.lit(": ")).alias("head"), F.octet_length(head).alias("skip"), F.col("value").cast("binary").alias("value"))
    body = F.substring(F.col("value"), F.col("skip") + len(END * 2) + 1, F.col("head")["Content-Length"].cast("int"))
    return parsed.select("head", body.alias("body"))


def _digest_runs(batches):
    """Bytes and digest of each run of chunks; the chunks come in order."""
    at, size, running = None, 0, None
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            run, body = batch.column("run")[i].as_py(), batch.column("body")[i].as_buffer()
            if run != at:
                if at is not None:
                    out.append((at, size, running.hexdigest()))
                at, size, running = run, 0, hashlib.sha1()
            size += len(body)
            running.update(body)
        yield _runs(out, batch.schema.field("run").type)
    if at is not None:
        yield _runs([(at, size, running.hexdigest())], pa.string() if isinstance(at, str) else pa.int64())


def _runs(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((kind, pa.int64(), pa.string()))], ["run", "read_bytes", "read_digest"])


def read_records(spark: SparkSession, path: str, boundary: str) -> DataFrame:
    """A row for each record: page_id, payload_bytes, payload_digest, record_type, refers_to, intact.

    Length and digest are those of the bytes that were read; a revisit has those of the response that it refers to, null
    where none with its digest was read. intact: they are what the record's header says.
    """
    text_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "128")
    rows = read_chunks(spark, path, boundary)
    field = lambda name: F.col("head")[name]
    first = field("WARC-Type") != "continuation"
    single = first & field("WARC-Segment-Number").isNull()
    fields = [field(ID).cast("long").alias("page_id"), field(LENGTH).cast("long").alias("told_bytes"), F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("told_digest"), field("WARC-Type").alias("record_type"), field("X-Refers-To-Page-ID").cast("long").alias("refers_to")]
    short = rows.filter(single).select(*fields, F.octet_length("body").cast("long").alias("read_bytes"), base32(F.sha1("body")).alias("read_digest"))
    segments = rows.filter(~single)
    origin = F.coalesce(field("WARC-Segment-Origin-ID"), field("WARC-Record-ID"))
    runs = run_digests(segments.select(origin.alias("run"), field("WARC-Segment-Number").cast("int").alias("number"), "body"))
    heads = segments.filter(first).select(field("WARC-Record-ID").alias("run"), *fields).join(runs, "run").drop("run")
    records = materialize(short.unionByName(heads), "records")
    own = records.filter("record_type <> 'revisit'").select("page_id", F.col("read_bytes").alias("payload_bytes"), F.col("read_digest").alias("payload_digest"), "record_type", "refers_to", ((F.col("read_bytes") == F.col("told_bytes")) & (F.col("read_digest") == F.col("told_digest"))).alias("intact"))
    origins = own.filter("intact").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("told_digest"), "payload_bytes").distinct()
    again = records.filter("record_type = 'revisit'").join(origins, ["refers_to", "told_digest"], "left")
    again = again.select("page_id", "payload_bytes", F.when(F.col("payload_bytes").isNotNull(), F.col("told_digest")).alias("payload_digest"), "record_type", "refers_to", F.coalesce(F.col("payload_bytes") == F.col("told_bytes"), F.lit(False)).alias("intact"))
    return own.unionByName(again)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    return read_records(pages.sparkSession, *write_archives(pages, least))


def digest(pages: DataFrame) -> DataFrame:
    return round_trip(pages.select("page_id", "url", "html"), 0)


ORACLE_SQL = """
with p as (select page_id, strlen(coalesce(html, ''))::bigint payload_bytes, sha1(coalesce(html, '')) h from pages),
f as (select h, min(page_id) m, count(*) n from p group by h)
select page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(p.h, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int, 1)), '') payload_digest,
  case when n > 1 and page_id is distinct from m then 'revisit' else 'response' end record_type,
  case when n > 1 and page_id is distinct from m then m end refers_to, true intact
from p join f on p.h = f.h
"""
