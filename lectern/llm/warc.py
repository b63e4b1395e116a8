"""WARC archives: written by Spark's text sink, read back by boundary-chain verification.

Writing. A record is text: header, blank line, HTTP block, payload. The text
sink with CRLF CRLF as line end therefore writes valid archives, committed
task by task, gzipped, of :data:`RECORDS_PER_FILE` records at most. Of equal
payloads of at least :data:`REVISIT_BYTES` bytes the one with the smallest page
id is stored, the others are revisit records that refer to it.

Reading. The magic line may stand inside a payload, so it proves nothing.

1. Tasks cut the archives at the magic line and emit, for each place where it
   stands, the offset and the offset of the successor that its header claims.
   Offsets are sums of segment lengths: inside a split, then over splits.
2. Pointer jumping from offset 0: each round doubles the reach of every pointer
   and of the set of reached places, so a chain of n records takes log2(n)
   rounds of narrow joins. Places never reached are no records.
3. A record whose segment has the claimed length is read in step 1. One that
   holds the magic inside is put together from its segments; only archives that
   have such a record are read again.

Defined results: null html is an empty payload; rows that repeat a page id give
a record each (those of the smallest id are responses all); a null id never
stands for others and, alone among equals, refers to nothing; an empty table
gives an empty archive and no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import durable, shared_dir

MAGIC, CRLF = "WARC/1.1\r\n", "\r\n"
REVISIT_BYTES, RECORDS_PER_FILE = 100, 4096
_ID = "urn:lectern:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def first_of_equals(pages: DataFrame) -> DataFrame:
    """(digest, first): the smallest id of every payload that stands twice or more; combines map-side."""
    large = pages.where(F.octet_length("payload") >= REVISIT_BYTES)
    found = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    return found.where("n > 1").select("digest", "first")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """Write one record per row under ``path``."""
    payload = F.coalesce(pages[html_col].cast("string"), F.lit(""))
    p = pages.select(pages[id_col].cast("long").alias("page_id"), F.coalesce(pages[url_col].cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    p = p.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    p = p.join(first_of_equals(p), "digest", "left")
    revisit = F.coalesce(F.col("first") != F.col("page_id"), F.col("first").isNotNull())
    name = lambda c: F.concat(F.lit(f"<{_ID}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    size = F.octet_length("payload").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size, F.lit(CRLF * 2))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "")
    record = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: "), name(F.col("page_id")), F.lit(f"{CRLF}WARC-Target-URI: "), url,
        F.lit(f"{CRLF}WARC-Date: 2000-01-01T00:00:00Z{CRLF}WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: {_PROFILE}{CRLF}WARC-Refers-To: "), name(F.col("first")))).otherwise(""),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), F.octet_length(block).cast("string"),
        F.lit(CRLF * 2), block)
    p.select(record.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    return path


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """The archives cut at every magic line, in order within (file, block)."""
    text = spark.read.format("text").option("lineSep", MAGIC).load(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), "value")


def _fields(value: Column) -> dict[str, Column]:
    """What a segment's text says, from its first byte after the magic line."""
    head = F.substring_index(value, CRLF * 2, 1)
    field = lambda name: F.nullif(F.regexp_extract(F.concat(F.lit(CRLF), head), rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))
    number = lambda c: F.expr("null").cast("long") if c is None else c.try_cast("long")
    rest = F.substr(value, F.length(head) + 5)
    http = F.substring_index(rest, CRLF * 2, 1)
    page = lambda name: number(F.regexp_extract(field(name), rf"<{_ID}(-?\d+)>", 1))
    body = F.substr(rest, F.length(http) + 5)
    length = number(F.regexp_extract(head, r"(?i)(?:^|\r\n)Content-Length:[ \t]*(\d{1,18})", 1))
    return {
        "has_head": F.contains(value, F.lit(CRLF * 2)), "length": length, "head_bytes": F.octet_length(head) + 4,
        "record_type": field("WARC-Type"), "page_id": page("WARC-Record-ID"), "refers_to": page("WARC-Refers-To"),
        "told_digest": F.regexp_extract(field("WARC-Payload-Digest"), r"sha256:([0-9a-f]{64})", 1),
        "told_bytes": number(F.regexp_extract(http, r"(?i)\r\nContent-Length:[ \t]*(\d{1,18})", 1)),
        # the record ends with two line ends, which are no payload
        "payload": F.substr(body, F.lit(1), F.length(body) - 4),
    }


def _parsed(df: DataFrame) -> DataFrame:
    """Per segment: the claimed size, whether the segment has it, and what a whole record says."""
    f = _fields(F.col("value"))
    size = F.when(f["has_head"], f["head_bytes"] + f["length"] + 4)
    df = df.withColumn("bytes", F.octet_length("value").cast("long")).withColumn("size", size.cast("long"))
    whole = F.coalesce(F.col("size") == F.col("bytes"), F.lit(False))
    stored = f["record_type"] == "response"
    return df.select(
        *(c for c in df.columns if c != "value"), whole.alias("whole"),
        *(F.when(whole, f[c]).alias(c) for c in ("record_type", "page_id", "refers_to")),
        F.when(whole, F.when(stored, F.sha2(f["payload"].cast("binary"), 256)).otherwise(f["told_digest"])).alias("payload_digest"),
        F.when(whole, F.when(stored, F.octet_length(f["payload"])).otherwise(f["told_bytes"])).cast("long").alias("payload_bytes"))


def _placed(segments: DataFrame) -> DataFrame:
    """Add the offset of each segment's magic line in its file (-10: text before the first one)."""
    step = len(MAGIC)
    inside = Window.partitionBy("file", "block").orderBy("seq")
    s = segments.withColumn("rank", F.row_number().over(inside))
    s = s.withColumn("before", F.sum(F.col("bytes") + step).over(inside) - F.col("bytes") - step)
    blocks = s.groupBy("file", "block").agg(F.sum(F.col("bytes") + step).alias("total"))
    over = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select("file", "block", F.coalesce(F.sum("total").over(over), F.lit(0)).alias("base"))
    s = s.join(base, ["file", "block"])
    return s.withColumn("at", F.col("base") + F.col("before") - step).drop("base", "before")


def reachable(candidates: DataFrame, step: int = len(MAGIC)) -> DataFrame:
    """(file, at) of the records on the chain from offset 0, by pointer jumping over (file, at, size)."""
    link = candidates.where("at >= 0").select("file", "at", (F.col("at") + step + F.col("size")).alias("to"), (F.col("at") == 0).alias("reached"))
    most = candidates.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    for _ in range(max(1, most).bit_length()):
        ahead = link.select("file", F.col("at").alias("to"), F.col("to").alias("next"))
        met = link.where(F.col("reached") & F.col("to").isNotNull()).select("file", F.col("to").alias("at"), F.lit(True).alias("met")).distinct()
        link = link.join(ahead, ["file", "to"], "left").join(met, ["file", "at"], "left")
        link = durable(link.select("file", "at", F.col("next").alias("to"), (F.col("reached") | F.coalesce("met", F.lit(False))).alias("reached")), "warc-chain")
    return link.where("reached").select("file", "at")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, record_type, refers_to, payload_bytes and payload_digest of the full payload."""
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    parsed = durable(_placed(_parsed(_segments(spark, path))), "warc-segments")
    chain = reachable(parsed.select("file", "at", "size")).withColumn("real", F.lit(True))
    s = parsed.where("at >= 0").join(chain, ["file", "at"], "left")
    good = s.where("real and whole").select(*columns)
    torn = s.where("real and not whole").select("file").distinct()
    if torn.isEmpty():
        return good
    # records that hold the magic line: their segments, from the archives that have such records
    inner = s.join(torn, "file", "left_semi")
    in_file = Window.partitionBy("file").orderBy("at")
    inner = inner.withColumn("head", F.last(F.when(F.col("real"), F.struct("at", "whole")), True).over(in_file))
    inner = inner.where("not head.whole").select("file", "block", "rank", "at", F.col("head.at").alias("record"))
    again = _segments(spark, path).join(torn, "file", "left_semi")
    again = again.withColumn("rank", F.row_number().over(Window.partitionBy("file", "block").orderBy("seq"))).drop("seq")
    parts = again.join(inner, ["file", "block", "rank"]).groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("parts"))
    joined = parts.select(F.array_join(F.transform("parts", lambda x: x["value"]), MAGIC).alias("value"))
    return good.unionByName(_parsed(joined).where("whole").select(*columns))


def report(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to the shared folder and read the archives back."""
    spark = pages.sparkSession
    return read(spark, write(pages, f"{shared_dir(spark)}/lectern-warc-{uuid.uuid4().hex}"))
