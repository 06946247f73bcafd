r"""WARC archives: writing, and reading by verified chains of record boundaries.

Writing needs no Python: a record is a string, and Spark's text writer puts the
blank lines that end a record after it. Reading splits archives at byte offsets
like any text. Every place with a record's magic is a candidate, also ones inside
payloads; its header names the offset of its successor. Real records are those
that the chain from the start of the file reaches. Tasks emit candidates with
their successors and follow them to the end of their split; pointer jumping over
the splits finds where the chain enters each split; from there it is walked.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import join_checked, materialize, null_safe_key, scratch_path, table

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed by RFC 4648.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """The bare base32 SHA-1 of a column's bytes: four times ten hex digits make eight letters."""
    digest, letters = F.sha1(data), []
    for part in range(4):
        forty = F.conv(F.substring(digest, 10 * part + 1, 10), 16, 10).cast("long")
        letters += [F.substring(F.lit(BASE32), F.shiftright(forty, 5 * k).bitwiseAND(31).cast("int") + 1, F.lit(1)) for k in range(7, -1, -1)]
    return F.concat(*letters)


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:tidewell:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def write_warc(pages: DataFrame, path: str, least_revisit: int = 0) -> None:
    """Write a record for every row (page_id, url, html) to uncompressed archives under path.

    The payload is the html in UTF-8, null as empty, in an HTTP response. Of rows
    with equal payloads of at least least_revisit bytes, that with the smallest
    page_id is a response, and the others are revisits of it, without payload. Rows
    that repeat that page_id are responses too; a null page_id is never the
    smallest, and where a group has no other, its rows are all responses. White
    space and control characters are left out of target addresses; a null url
    gives no address. An empty table writes no record. Other columns are not read.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("n", F.octet_length("payload").cast("long")).withColumn("digest", base32_sha1(F.col("payload")))
    groups = rows.where(F.col("n") >= least_revisit).groupBy("digest", "n").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    groups = groups.where((F.col("rows") > 1) & F.col("first").isNotNull()).select(F.col("digest").alias("_digest"), F.col("n").alias("_n"), "first")
    groups = materialize(groups, "warc-groups")  # its size is known then: Spark broadcasts it if small, else shuffles
    # Which rows revisit another is told by narrow rows; payloads meet only their own verdict, spread by page_id.
    narrow = rows.where(F.col("n") >= least_revisit).select("page_id", "digest", "n").join(groups, (F.col("digest") == F.col("_digest")) & (F.col("n") == F.col("_n")))
    verdicts = materialize(narrow.where(~F.col("first").eqNullSafe(F.col("page_id"))).select(*null_safe_key("page_id"), "digest", "n", "first").distinct(), "warc-revisits")
    rows = join_checked(rows.select("*", *null_safe_key("page_id")), verdicts, ["_key_null", "_key", "digest", "n"], "left")
    revisit = F.col("first").isNotNull()
    address = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7F]", "")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), _urn(F.col("page_id")), F.lit(f"\r\nWARC-Date: {DATE}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), address), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _urn(F.col("first")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    rows.select(F.concat(head, block)).write.option("lineSep", END).text(path)


HEADER = re.compile(rb"\A((?:[^\r\n:]+:[^\r\n]*\r\n)+)\r\n")
CANDIDATES = "file string, split long, rel long, size long, succ long, ends long, type string, record_id string, uri string, refers_to string, digest string, said_digest string, said_bytes long, payload_bytes long, body_at long, body_bytes long, chunk binary"


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in head.split(b"\r\n") if line)
    return {k.decode("latin-1").lower(): v.strip().decode("utf-8", "replace") for k, _, v in pairs}


def payload_of(block: bytes, kind: str | None) -> tuple[bytes, int | None]:
    """The payload of a record's block, and the length that its HTTP header states."""
    if kind not in ("response", "revisit") or not block.startswith(b"HTTP/"):
        return block, None
    head, _, body = block.partition(b"\r\n\r\n")
    said = _fields(head.partition(b"\r\n")[2]).get("content-length", "")
    return body, int(said) if said.isdigit() else None


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _candidates(with_payload: bool):
    magic = MAGIC.encode()

    def one(file: str, split: int, rel: int, chunk: bytes, first: bool) -> dict:
        row: dict = {"file": file, "split": split, "rel": -1 if first else rel, "size": len(chunk) + (0 if first else len(magic))}
        if first or not (found := HEADER.match(chunk)):
            return row | {"chunk": chunk}
        fields = _fields(found[1])
        length = fields.get("content-length", "")
        if not length.isdigit() or len(length) > 18:
            return row | {"chunk": chunk}
        start, n = found.end(), int(length)
        kind = fields.get("warc-type")
        row |= {"succ": rel + len(magic) + start + n + len(END), "type": kind, "record_id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"), "said_digest": fields.get("warc-payload-digest"), "body_at": start, "body_bytes": n}
        if len(chunk) == start + n + len(END):
            payload, said = payload_of(chunk[start : start + n], kind)
            row |= {"digest": base32_digest(payload), "said_bytes": said, "payload_bytes": len(payload)}
            return row | {"chunk": payload if with_payload else None}
        return row | {"chunk": chunk}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in CANDIDATES.split(", "))])
        at: tuple | None = None
        split_rows: list[dict] = []
        rel = 0
        for batch in batches:
            files, splits = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(batch.num_rows):
                if at != (files[i], splits[i]):
                    if split_rows:
                        yield _followed(split_rows, rel, schema)
                    at, split_rows, rel = (files[i], splits[i]), [], 0
                # The first piece of a file stands before the first magic; all others stand behind one.
                first = splits[i] == 0 and not split_rows
                row = one(files[i], splits[i], rel, batch.column(2)[i].as_py(), first)
                rel += row["size"]
                split_rows.append(row)
        if split_rows:
            yield _followed(split_rows, rel, schema)

    return run


def _followed(rows: list[dict], total: int, schema: pa.Schema) -> pa.RecordBatch:
    """Adds to every candidate where its chain leaves the split; null if it breaks off inside."""
    place = {r["rel"]: i for i, r in enumerate(rows) if r.get("succ") is not None}
    for i in range(len(rows) - 1, -1, -1):
        r = rows[i]
        succ = r.get("succ")
        if succ is None:
            r["ends"] = None
        elif succ >= total:
            r["ends"] = succ
        else:
            r["ends"] = rows[place[succ]]["ends"] if succ in place else None
    return pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema)


def _walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a split on the chain from where it enters."""
    succ = dict(zip(rows["rel"].tolist(), rows["succ"].tolist(), strict=True))
    at, found = int(rows["enters"].iloc[0]), []
    while at in succ:
        found.append(at)
        at = succ[at]
    return pd.DataFrame({"file": key[0], "split": np.int64(key[1]), "rel": np.array(found, np.int64)})


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Rows of the records in archives under path: file, offset, type, record_id, uri, refers_to, payload_bytes, payload_digest, payload.

    Digest and length are of the full payload: computed, or for a revisit as its
    header states them. payload is null for revisits and unless with_payload. Magic inside payloads starts no record; a file
    whose chain breaks gives the records before the break. Empty files give none.
    """
    lines = spark.read.option("lineSep", MAGIC).text(path)
    pieces = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("chunk"))
    found = materialize(pieces.mapInArrow(_candidates(with_payload), CANDIDATES), "warc-candidates")
    # Absolute offsets: splits follow each other without gaps, so the sizes of the earlier ones add up.
    sizes = found.groupBy("file", "split").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = materialize(sizes.select("file", "split", "total", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "warc-splits")
    records = found.where(F.col("succ").isNotNull())
    nodes = records.join(splits, ["file", "split"]).select("file", "split", (F.col("base") + F.col("rel")).alias("offset"), (F.col("base") + F.col("ends")).alias("to"))
    # Only candidates where a chain can enter a split matter: the first of a file, and ends of others.
    starts = found.where((F.col("split") == 0) & (F.col("rel") < 0)).select("file", F.col("size").alias("offset"))
    entries = starts.unionByName(nodes.where(F.col("to").isNotNull()).select("file", F.col("to").alias("offset"))).distinct()
    jumps = materialize(nodes.join(entries, ["file", "offset"], "left_semi").select("file", "offset", "to"), "warc-jumps")
    reached = materialize(starts.join(jumps, ["file", "offset"], "left_semi").select("file", "offset"), "warc-reached")
    n = reached.count()
    while True:
        step = reached.join(jumps.where(F.col("to").isNotNull()), ["file", "offset"]).select("file", F.col("to").alias("offset")).join(jumps.select("file", "offset"), ["file", "offset"], "left_semi")
        reached = materialize(reached.unionByName(step).distinct(), "warc-reached")
        more = reached.count()
        if more == n:
            break
        n = more
        far = jumps.select("file", F.col("offset").alias("to"), F.col("to").alias("next"))
        jumps = materialize(jumps.join(far, ["file", "to"], "left").select("file", "offset", F.col("next").alias("to")), "warc-jumps")
    enters = reached.join(nodes, ["file", "offset"]).select("file", "split", "offset").join(splits, ["file", "split"]).select("file", "split", (F.col("offset") - F.col("base")).alias("enters"))
    walked = records.select("file", "split", "rel", "succ").join(enters, ["file", "split"]).groupBy("file", "split").applyInPandas(_walk, "file string, split long, rel long")
    real = materialize(walked, "warc-real")
    rows = records.join(real, ["file", "split", "rel"]).join(splits, ["file", "split"]).withColumn("offset", F.col("base") + F.col("rel"))
    rows = rows.select("file", "offset", (F.col("base") + F.col("succ")).alias("next"), *HEAD, "said_bytes", "payload_bytes", "digest", "body_at", "body_bytes", F.col("chunk").alias("payload"))
    out, cut = rows.where(F.col("digest").isNotNull()), rows.where(F.col("digest").isNull())
    if not cut.isEmpty():
        out = out.unionByName(_joined(cut, pieces, splits, with_payload), allowMissingColumns=True)
    revisit = F.col("type") == "revisit"
    digest = F.when(revisit, F.regexp_replace("said_digest", "^sha1:", "")).otherwise(F.col("digest"))
    return out.select("file", "offset", "type", "record_id", "uri", "refers_to", F.when(revisit, F.col("said_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), digest.alias("payload_digest"), F.when(~revisit, F.col("payload")).alias("payload"))


HEAD = ("type", "record_id", "uri", "refers_to", "said_digest")


def _joined(cut: DataFrame, pieces: DataFrame, splits: DataFrame, with_payload: bool) -> DataFrame:
    """Records whose payload holds magic: the pieces up to the successor, put together again.

    Only files with such records are read a second time; a group is one record.
    """
    cut = materialize(cut.drop("payload", "payload_bytes", "said_bytes", "digest"), "warc-cut")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rel = None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                file, split, chunk = (batch.column(k)[i].as_py() for k in range(3))
                if at != (file, split):
                    at, rel, first = (file, split), 0, split == 0
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([split], pa.int64()), pa.array([-1 if first else rel], pa.int64()), pa.array([chunk], pa.binary())], ["file", "split", "rel", "chunk"])
                rel += len(chunk) + (0 if first else len(MAGIC))
                first = False

    again = pieces.mapInArrow(placed, "file string, split long, rel long, chunk binary").join(cut.select("file").distinct(), "file", "left_semi")
    again = again.join(splits, ["file", "split"]).select("file", "split", (F.col("base") + F.col("rel")).alias("at"), "chunk")
    # Pieces meet the records that reach into their split, so no task holds a whole file.
    spans = cut.select("file", "offset", F.col("next").alias("until")).join(splits, "file").where((F.col("base") < F.col("until")) & (F.col("base") + F.col("total") > F.col("offset")))
    again = again.join(spans.select("file", "split", "offset", "until"), ["file", "split"]).where((F.col("at") >= F.col("offset")) & (F.col("at") < F.col("until")))
    held = again.groupBy("file", "offset").agg(F.array_sort(F.collect_list(F.struct("at", F.col("chunk").cast("string").alias("chunk")))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: x["chunk"]), MAGIC)
    joined = cut.join(held.select("file", "offset", text.cast("binary").alias("whole")), ["file", "offset"])
    joined = joined.select("file", "offset", *HEAD, F.expr("substring(whole, cast(body_at + 1 as int), cast(body_bytes as int))").alias("block"))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                payload, said = payload_of(row.pop("block"), row["type"])
                row |= {"said_bytes": said, "payload_bytes": len(payload), "digest": base32_digest(payload), "payload": payload if with_payload else None}
                yield pa.RecordBatch.from_pylist([row], schema)

    names = ["file", "offset", *HEAD, "said_bytes", "payload_bytes", "digest", "payload"]
    kinds = {"offset": pa.int64(), "said_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
    spark_kinds = {"offset": "long", "said_bytes": "long", "payload_bytes": "long", "payload": "binary"}
    return joined.mapInArrow(digested, ", ".join(f"{n} {spark_kinds.get(n, 'string')}" for n in names))


def page_of(urn: Column) -> Column:
    return F.regexp_extract(urn, r"^<urn:tidewell:page:(-?\d+)>$", 1).try_cast("long")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives, and what their records say when read back."""
    path = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    read = read_warc(spark, path, with_payload=False)
    return read.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page_of(F.col("refers_to")).alias("refers_to"))
