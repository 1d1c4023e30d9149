"""Captures of web pages: WARC records, and the resolution of not-modified revisits.

A revisit says that a server answered 304 or that a crawler met the same payload again. It stands for the latest
earlier full response of the same canonical address, found by an as-of join. The revisit's validators (entity tag, by
weak comparison; else modification date; else payload digest) must agree with that response's; then its payload is the
response's, and of its headers those that a 304 may carry replace the stored ones.

Outcomes: `full` (not a revisit), `resolved`, `mismatch` (validators disagree), `unvalidated` (the revisit has no
validator that the response has too; it is not resolved) and `orphan` (no earlier response). Captures of one moment are
ordered by their identifier; of rows equal in both any may come first. Null addresses match nothing; null
times come first, and null identifiers before others of their moment. Repeated rows are resolved alike. An empty table gives no rows. Clashing columns beside those named
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import HOT_KEYS, salted_join
from tokenloom.session import ship

#: Header fields that a 304 response may carry and a cache takes over.
PERMITTED = "cache-control content-location date etag expires last-modified vary".split()
#: Query parameters that track visitors and don't name a page.
TRACKING = r"(?:utm_[a-z_]+|gclid|fbclid|ref|sessionid|phpsessid)"
#: Pieces of a hot address, and rows of it that the borders of pieces are taken from.
PIECES, PROBES = 64, 4096
RECORD = "record_id long, url string, ts long, kind string, status int, headers map<string,string>, payload_digest string"
#: How records begin; the reader cuts files there. No end of it is a beginning of it too: of such marks the text reader
#: may miss one that lies across two of its buffers.
MARK = "WARC/1."


def canonical_url(url: str) -> Column:
    """Scheme and www. removed, host in lower case, no default port, fragment, tracking parameters or last slash; parameters sorted."""
    plain = F.regexp_replace(F.trim(F.col(url)), r"#.*$", "")
    plain = F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(plain, r"^[^/?]*", 0)), r"^www\.", ""), r":(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(plain, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(f"^{TRACKING}(=|$)"))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise(F.lit("")))


def lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names that then agree, the last stands."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.transform(entries, lambda e: e["key"])
    last = F.filter(entries, lambda e, k: ~F.array_contains(F.slice(names, k + 2, F.greatest(F.size(names) - k - 1, F.lit(0))), e["key"]))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def agreement(mine: Column, theirs: Column, digest: Column, their_digest: Column) -> Column:
    """True if the strongest validator that both have agrees, false if it doesn't, null if they share none."""
    def tag(h: Column) -> Column:
        return F.regexp_replace(h["etag"], "^[Ww]/", "")

    return F.coalesce(tag(mine) == tag(theirs), mine["last-modified"] == theirs["last-modified"], digest == their_digest)


def latest_before(rows: DataFrame) -> DataFrame:
    """rows (canonical, order, response) with `found`: the response of the largest smaller order of the same address.

    Addresses with a large share of all rows are cut into pieces by order; of each piece, the last response of the
    pieces before it is carried over, so that no address is sorted in one task.
    """
    counts = rows.where(F.col("canonical").isNotNull()).groupBy("canonical").count()
    total = rows.count()
    hot = counts.where(F.col("count") >= max(256, total // HOT_KEYS)).collect()
    spark = rows.sparkSession
    rows = rows.withColumn("order", F.struct("ts", "record_id"))
    if hot:
        # About PROBES of each hot address, chosen by the hash of their order, say where it is cut: by time and identifier,
        # so that captures of one moment are parted too.
        names = F.broadcast(spark.createDataFrame([(r["canonical"], max(1, r["count"] // PROBES)) for r in hot], "canonical string, every long"))
        probes = rows.join(names, "canonical").where(F.pmod(F.xxhash64("order"), F.col("every")) == 0)
        cuts = probes.groupBy("canonical").agg(F.array_sort(F.collect_set("order")).alias("p"))
        cuts = cuts.select("canonical", F.transform(F.sequence(F.lit(1), F.lit(PIECES - 1)), lambda k: F.col("p")[(k * F.size("p") / PIECES).cast("int")]).alias("cuts"))
        rows = rows.join(F.broadcast(cuts), "canonical", "left")  # one row for each hot address
        rows = rows.withColumn("piece", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("order"))), F.lit(0))).drop("cuts")
    else:
        rows = rows.withColumn("piece", F.lit(0))
    within = Window.partitionBy("canonical", "piece", F.when(F.col("canonical").isNull(), F.xxhash64("record_id", "ts"))).orderBy("order")
    steps = rows.withColumn("here", F.last("response", True).over(within.rowsBetween(Window.unboundedPreceding, -1)))
    if not hot:
        return steps.withColumnRenamed("here", "found")
    ends = rows.where("response is not null").groupBy("canonical", "piece").agg(F.max_by("response", "order").alias("last"))
    every = rows.select("canonical", "piece").distinct().join(ends, ["canonical", "piece"], "left")
    carried = every.withColumn("carried", F.last("last", True).over(Window.partitionBy("canonical").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))).drop("last")
    return steps.join(carried, ["canonical", "piece"], "left").withColumn("found", F.coalesce("here", "carried")).drop("here", "carried")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records (see RECORD) with canonical_url, outcome, refers_to, and the status, headers, payload digest and size that hold.

    payload_bytes, the size of a record's payload, may be among the columns; without it sizes are null.
    """
    size = F.col("payload_bytes") if "payload_bytes" in records.columns else F.lit(None)
    rows = records.select("record_id", "url", F.coalesce("ts", F.lit(-(1 << 62))).alias("ts"), "kind", "status", lower_keys(F.col("headers")).alias("headers"), "payload_digest", size.cast("long").alias("payload_bytes"), canonical_url("url").alias("canonical"))
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    rows = rows.withColumn("response", F.when(full, F.struct("record_id", "headers", "payload_digest", "ts", "payload_bytes")))
    found = latest_before(rows)
    f = F.col("found")
    is_revisit = F.col("kind") == "revisit"
    agree = agreement(F.col("headers"), f["headers"], F.col("payload_digest"), f["payload_digest"])
    outcome = F.when(~is_revisit, "full").when(F.col("canonical").isNull() | f.isNull(), "orphan").when(agree.isNull(), "unvalidated").when(agree, "resolved").otherwise("mismatch")
    found = found.withColumn("outcome", outcome)
    done = F.col("outcome") == "resolved"
    taken = F.map_filter("headers", lambda k, v: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter(f["headers"], lambda k, v: ~F.array_contains(F.map_keys(taken), k)), taken)
    return found.select(
        "record_id", "url", F.col("canonical").alias("canonical_url"), "outcome",
        F.when(done, f["record_id"]).alias("refers_to"),
        F.when(done, F.lit(200)).otherwise(F.col("status")).alias("status"),
        F.when(done, merged).otherwise(F.col("headers")).alias("headers"),
        F.when(done, f["payload_digest"]).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.when(done, f["payload_bytes"]).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
    )


def with_payload(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """resolved with the payload that holds: the record's own, or of a resolved revisit that of the response it refers to.

    records: record_id and payload, identifiers unique. One response may stand behind many revisits: hot ones are split.
    """
    wanted = resolved.withColumn("_of", F.coalesce("refers_to", "record_id"))
    found = salted_join(wanted, records.select(F.col("record_id").alias("_of"), "payload"), ["_of"], "left", seed="record_id")
    return found.drop("_of")


def records(pages: DataFrame) -> DataFrame:
    """WARC records (one text each, column value) of two crawls over all pages.

    At the first a server sends each page, at the second it answers that nothing changed. On every seventh page the
    second answer names another entity tag, on every thirteenth it names none, and for every eleventh there is one
    revisit more, of an address that was never crawled. The second crawl met the pages under other spellings of their
    addresses. A record's number is four times its page's, and 0, 1 or 2 more. Null pages are empty.
    """
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    n = F.coalesce("page_id", F.lit(0))
    kinds = F.when(n % 11 == 10, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1)))
    rows = pages.select("page_id", n.alias("n"), F.regexp_replace("url", r"\s+", "").alias("url"), "html", digest.alias("digest"), F.explode(kinds).alias("crawl"))
    again, n = F.col("crawl") > 0, F.col("n")
    tag = F.concat(F.when(again, "W/").otherwise(""), F.lit('"'), F.substring("digest", 1, 16), F.when(again & (n % 7 == 3), "x").otherwise(""), F.lit('"'))
    first = F.concat_ws("\r\n", F.lit("HTTP/1.1 200 OK"), F.concat(F.lit("ETag: "), tag), F.lit("Content-Type: text/html"), F.lit("Expires: 0"), F.concat(F.lit("Date: "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    second = F.concat_ws("\r\n", F.lit("HTTP/1.1 304 Not Modified"), F.concat(F.lit("Date: later "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))), F.lit("Content-Length: 0"), F.when(n % 13 != 5, F.concat(F.lit("etag: "), tag)))
    block = F.concat(F.when(again, second).otherwise(first), F.lit("\r\n\r\n"), F.when(again, "").otherwise(F.coalesce("html", F.lit(""))))
    spelled = F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("utm_source=again#top"))
    url = F.when(F.col("crawl") == 0, F.col("url")).when(F.col("crawl") == 1, spelled).otherwise(F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit("/never-crawled")))
    date = F.date_format(F.timestamp_seconds(F.when(again, 1706745600).otherwise(1704067200) + F.pmod(n, F.lit(86400))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.when(again, "WARC-Type: revisit").otherwise("WARC-Type: response"),
        F.concat(F.lit("WARC-Record-ID: <urn:record:"), (F.col("page_id") * 4 + F.col("crawl")).cast("string"), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), url), F.concat(F.lit("WARC-Date: "), date),
        F.when(~again, F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"))),
        F.lit("Content-Type: application/http"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return rows.select(F.concat(head, F.lit("\r\n\r\n"), block).alias("value"))


def write_warc(rows: DataFrame, path: str) -> None:
    """Records (value) as compressed WARC files."""
    rows.select("value").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def fields_of(head: bytes) -> dict[str, str]:
    """Header fields, names in lower case."""
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def whole_records(rows: Iterator[tuple[str, bytes, bool, bool]]) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """File, header fields and block of each record, from what lies between marks (file, bytes, whether the split begins and ends its file).

    Headers and payloads may hold the mark: pieces are put together until a record has the length it names. What a file
    cut off at its end leaves of a record is left out; a record cut off by a split, and bytes between records, are errors.
    """
    now, held, last = None, None, True

    def cut() -> None:
        if held is not None and not last:
            raise ValueError(f"a split of {now} ends within a record that holds {MARK!r}; compress the file, so that it isn't split")

    for file, text, begins, ends in rows:
        if file != now:
            cut()
            now, held, last = file, None, ends
            if begins:
                continue  # what stands before the first record
        last = ends
        if held is not None:
            held += MARK.encode() + text
        elif text[:3] in (b"0\r\n", b"1\r\n"):
            held = text
        else:
            continue  # the end of a record that began in the split before
        head, found, block = held.partition(b"\r\n\r\n")
        if not found:
            continue
        fields = fields_of(head)
        size = int(fields.get("content-length") or 0)
        if len(block) >= size:
            if block[size:].strip():
                raise ValueError(f"bytes between records in {now}")
            yield file, fields, block[:size]
            held = None
    cut()


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The response and revisit records of WARC files: file, record, url, date, kind, status, payload_digest, headers, payload.

    Spark's text reader streams and decompresses the files and cuts them between records, so memory holds one batch of
    records and no file; plain files are split among tasks. Set a bound on Arrow batches in bytes, for records may be long.
    """
    ship(spark)
    names = "file record url date kind status payload_digest headers payload".split()
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        pieces = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        for file, fields, block in whole_records(pieces):
            if fields.get("warc-type") not in ("response", "revisit"):
                continue
            head, _, payload = block.partition(b"\r\n\r\n")
            lines = head.decode("latin-1").split("\r\n")
            first = lines[0].split(" ")
            status = int(first[1]) if first[0].startswith("HTTP/") and len(first) > 1 and first[1].isdigit() else None
            headers = {n.strip(): v.strip() for n, _, v in (x.partition(":") for x in lines[1:]) if n}
            rows.append((file, fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-date"), fields["warc-type"], status, fields.get("warc-payload-digest"), list(headers.items()), payload))
            size += len(block)
            if size > 4_000_000 or len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    schema = "file string, record string, url string, date string, kind string, status int, payload_digest string, headers map<string,string>, payload binary"
    lines = spark.read.option("lineSep", MARK).text(path)
    meta = F.col("_metadata")
    begins = meta["file_block_start"] == 0
    ends = meta["file_block_start"] + meta["file_block_length"] >= meta["file_size"]
    return lines.select(meta["file_path"].alias("file"), F.col("value").cast("binary").alias("value"), begins.alias("begins"), ends.alias("ends")).mapInArrow(run, schema)


def captures(found: DataFrame) -> DataFrame:
    """Records as read_warc gives them in the form that revisits are resolved in; numbers stand at the end of record names."""
    return found.select(
        F.regexp_extract("record", r"(\d+)>?$", 1).try_cast("long").alias("record_id"), "url", F.unix_micros(F.to_timestamp("date")).alias("ts"), "kind", "status", "headers",
        F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"),
    )
