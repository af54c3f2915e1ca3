"""WARC archives (operator 2): written by Spark, read by boundary chains.

Writing: one record per page. Of pages with equal payloads of at least
``least`` bytes, that with the smallest page_id is a response, the others
revisit it; smaller payloads are always responses. A revisit keeps the HTTP
head (with the payload's length) and the payload's digest, but no payload.

Reading: the archive is split wherever the version line stands, which also
happens inside payloads. Each such place is a candidate; its header tells
where its successor must begin. Tasks shorten the chains inside their block of
a file, then pointer jumping over the blocks' entries, starting at the
beginning of each file, finds the records that can be reached. A version line
inside a payload is reached by nothing and goes; the payload it had cut is put
together again. A file that doesn't begin with a record gives none, and after a
record whose successor is no candidate the rest of the file gives none.

Null html is an empty payload, null url gives no target header, null page_id
an empty name (such rows come last among equals, and are responses if no equal
row has an id). Rows that share the smallest id of a payload are all
responses. Line breaks in a url become spaces. No pages give no archive."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vintage.llm.common import cut, staged

VERSION = "WARC/1.1\r\n"
BREAK = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- writing ----------------------------------------------------------------

def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def write_archive(pages: DataFrame, out: str, least: int = 100) -> None:
    """Write ``pages`` (page_id, url, html) as WARC files to the folder ``out``."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).alias("size"),
                        F.sha2(payload.cast("binary"), 256).alias("digest"))
    # the payloads stay where they are if the list of repeated ones is short
    repeated = staged(rows.where(F.col("size") >= least).groupBy("digest")
                      .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
                      .where("n > 1 and first is not null").select("digest", "first"), "repeated")
    rows = rows.join(repeated, "digest", "left")
    revisit = (F.col("first").isNotNull() & (F.col("size") >= least)
               & ~F.col("page_id").eqNullSafe(F.col("first")))
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
                    F.lit("Content-Length: "), F.col("size").cast("string"), F.lit(BREAK))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    head = F.concat(
        F.lit(VERSION), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", name), _line("WARC-Date", F.lit(DATE)),
        F.coalesce(_line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))),
                                 _line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        F.lit("Content-Length: "), length.cast("string"), F.lit(BREAK))
    record = F.concat(head, http, F.when(revisit, "").otherwise(F.col("payload")))
    rows.select(record.alias("value")).write.option("lineSep", BREAK).text(out)


# --- reading ----------------------------------------------------------------

def _field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", F.trim(found))


def _parsed(chunks: DataFrame) -> DataFrame:
    """Reads ``value``, what follows a version line, as a record. Keeps the
    other columns; drops the text."""
    head = F.substring_index("value", BREAK, 1)
    rows = chunks.withColumn("head", head).withColumn("bytes", F.octet_length("value").cast("long"))
    size = F.col("head_bytes")
    rows = (rows.withColumn("head_bytes", F.octet_length("head").cast("long"))
            .withColumn("length", F.regexp_extract(_field(F.col("head"), "Content-Length"), r"^(\d{1,18})$", 1)
                        .try_cast("long")))
    raw = F.col("value").cast("binary")
    rows = rows.withColumn("body", F.substring(raw, (size + 5).cast("int"), F.least(F.col("length"), F.col("bytes")).cast("int")))
    http = F.substring_index(F.col("body").cast("string"), BREAK, 1)
    rows = rows.withColumn("http", http).withColumn(
        "payload", F.substring(F.col("body"), F.octet_length("http") + 5, F.octet_length("body")))
    digest = F.regexp_replace(_field(F.col("head"), "WARC-Payload-Digest"), "^sha256:", "")
    revisit = F.lower(_field(F.col("head"), "WARC-Type")) == "revisit"
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    keep = [c for c in chunks.columns if c != "value"]
    valid = (size < F.col("bytes")) & F.col("length").isNotNull()
    return rows.select(
        *keep, "bytes", F.when(valid, len(VERSION) + size + 4 + F.col("length") + 4).alias("span"),
        (F.col("bytes") >= size + 4 + F.col("length") + 4).alias("whole"),
        page(_field(F.col("head"), "WARC-Record-ID")).alias("page_id"),
        _field(F.col("head"), "WARC-Target-URI").alias("url"),
        F.when(revisit, "revisit").otherwise(_field(F.col("head"), "WARC-Type")).alias("record_type"),
        page(_field(F.col("head"), "WARC-Refers-To")).alias("refers_to"),
        F.when(revisit, _field(F.col("http"), "Content-Length").try_cast("long"))
        .otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, digest).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        (revisit | (digest == F.sha2("payload", 256))).alias("digest_ok"))


def _exits(block: pd.DataFrame) -> pd.DataFrame:
    """The first offset outside its block that each candidate leads to."""
    out: dict[int, int] = {}
    for at, after in sorted(zip(block["at"], block["after"], strict=True), reverse=True):
        out[at] = out.get(after, after)
    return pd.DataFrame({"file": block["file"].iloc[0], "at": list(out), "to": list(out.values())})


def _walked(key, block: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a block that its reached entries lead to."""
    after, seen = dict(zip(block["at"], block["after"], strict=True)), []
    for at in sorted(entries["at"]):
        while at in after:
            seen.append(at)
            at = after.pop(at)
    return pd.DataFrame({"file": key[0], "at": seen})


def reachable(candidates: DataFrame) -> DataFrame:
    """``candidates`` (file, block, at, after) -> (file, at) of the records
    that the chain from offset 0 of each file reaches."""
    exits = cut(candidates.groupBy("file", "block").applyInPandas(_exits, "file string, at long, to long"))
    # only the start of a file and what another block points to can be entered
    targets = exits.select("file", F.col("to").alias("at")).union(
        exits.where("at = 0").select("file", "at")).distinct()
    jump = cut(exits.join(targets, ["file", "at"], "left_semi"))
    reached = jump.where("at = 0").select("file", "at")
    blocks = candidates.groupBy("file").agg(F.countDistinct("block").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(int(blocks).bit_length()):
        reached = reached.union(reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct()
        reached = cut(reached.join(jump.select("file", "at"), ["file", "at"], "left_semi"))
        onward = jump.select("file", F.col("at").alias("to"), F.col("to").alias("further"))
        jump = cut(jump.join(onward, ["file", "to"], "left").select("file", "at", F.coalesce("further", "to").alias("to")))
    entries = reached.join(candidates, ["file", "at"]).select(
        F.col("file").alias("in_file"), F.col("block").alias("in_block"), "at")
    return (candidates.groupBy("file", "block").cogroup(entries.groupBy("in_file", "in_block"))
            .applyInPandas(_walked, "file string, at long"))


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", VERSION).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files below ``path``: page_id, url,
    record_type, refers_to, payload_bytes, payload_digest, digest_ok (the
    payload has the digest that its header names), file, at (offset)."""
    chunks = cut(_parsed(_chunks(spark, path)))
    order = W.partitionBy("file").orderBy("block", "row")
    start = F.sum(F.col("bytes") + len(VERSION)).over(order.rowsBetween(W.unboundedPreceding, -1))
    placed = cut(chunks.withColumn("at", start - len(VERSION)).where("at is not null"))
    found = cut(reachable(placed.where("span is not null")
                          .select("file", "block", "at", (F.col("at") + F.col("span")).alias("after"))))
    result = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "digest_ok", "file", "at"]
    records = placed.join(found, ["file", "at"], "left_semi")
    plain = records.where("whole").select(*result)
    broken = records.where("not whole").select("file", "at").withColumn("owner", F.col("at"))
    if broken.isEmpty():
        return plain
    # parts of a payload that version lines cut: from the record's place to the next record's
    marks = placed.select("file", "block", "row", "at").join(
        found.select("file", "at", F.col("at").alias("owner")), ["file", "at"], "left")
    marks = marks.withColumn("owner", F.last("owner", ignorenulls=True).over(
        W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, 0)))
    parts = staged(marks.join(broken.select("file", "owner"), ["file", "owner"], "left_semi"), "parts")
    texts = _chunks(spark, path).join(parts, ["file", "block", "row"]).groupBy("file", "owner").agg(
        F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts"))
    mended = texts.select("file", F.col("owner").alias("at"),
                          F.array_join(F.transform("parts", lambda p: p["value"]), VERSION).alias("value"))
    return plain.unionByName(_parsed(mended).select(*result))
