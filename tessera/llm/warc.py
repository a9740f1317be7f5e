"""WARC archives: write pages with revisit records, and read archives back by byte ranges.

Reading follows chains of record boundaries. The archive is split at every occurrence of the
record magic, wherever tasks happen to start; each occurrence is a candidate, and its header
gives the offset of its successor. Inside a task the candidates' chains are followed to where
they leave the task's byte range; across ranges, pointer jumping from the start of each file
finds the candidates that are really records. Magic inside a payload is never reached.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import materialise, new_path, table

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
MIN_REVISIT_BYTES = 1000
_DATE = "2026-01-01T00:00:00Z"

_PIECES = (
    "file string, block long, at long, size long, header_bytes long, content_bytes long, exit_at long,"
    " page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, whole boolean"
)


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write one record per row to uncompressed archives below ``path``.

    The payload is the html in UTF-8, empty for null. Of rows with equal payloads of at least
    ``MIN_REVISIT_BYTES`` those with the largest identifier become responses and the others
    revisits without a body; smaller payloads are always responses. A null identifier is the
    smallest. A null url leaves its header out; line ends in a url are percent-encoded.

    Only identifiers and digests are shuffled. The pages themselves are joined to the
    revisits, which Spark broadcasts only if their written table is small.
    """
    own = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_replace(F.col(url_col).cast("string"), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    digests = own.where(F.octet_length("html") >= MIN_REVISIT_BYTES).select("page_id", "digest")
    firsts = digests.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least"), F.count("*").alias("n"), F.count("page_id").alias("known"))
    firsts = firsts.where((F.col("refers_to") != F.col("least")) | ((F.col("known") > 0) & (F.col("known") < F.col("n")))).select("digest", "refers_to")
    revisits = materialise(
        digests.join(firsts, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct(), "revisits"
    )
    r = revisits.select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to", F.lit(True).alias("revisit"))
    placed = own.join(r, own.page_id.eqNullSafe(r.r_id) & (own.digest == r.r_digest), "left")
    is_revisit = F.col("revisit").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(END))
    block = F.when(is_revisit, http).otherwise(F.concat(http, F.col("html")))
    header = F.concat(
        F.lit(MAGIC + "WARC-Type: "),
        F.when(is_revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        _urn(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {_DATE}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), F.col("url")), F.lit("")),
        F.when(is_revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), _urn(F.col("refers_to")), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("block").cast("string"),
        F.lit(END),
    )
    # Every record ends with two line ends, which is what the text sink puts after a row.
    placed.withColumn("block", block).select(F.concat(header, "block").alias("value")).write.option("lineSep", END).text(path)


_FIELD = re.compile(rb"\r\n([!-9;-~]+):[ \t]*([^\r\n]*)")


def _fields(head: bytes) -> dict[bytes, bytes]:
    return {k.lower(): v.strip() for k, v in _FIELD.findall(b"\r\n" + head)}


def _page(urn: bytes | None) -> int | None:
    digits = (urn or b"").removeprefix(b"<urn:page:").removesuffix(b">")
    return int(digits) if digits.lstrip(b"-").isdigit() else None


def _parsed(piece: bytes) -> tuple[int, int, dict[bytes, bytes]] | None:
    """Of the bytes behind a magic: header length with the magic, block length, fields."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = _fields(piece[:end])
    length = fields.get(b"content-length", b"")
    return (len(MAGIC) + end + 4, int(length), fields) if length.isdigit() else None


def _payload(block: bytes) -> bytes:
    """What follows the HTTP header of a block."""
    return block[block.find(b"\r\n\r\n") + 4 :]


def _candidates() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pieces between magics to candidate rows, with where each chain leaves the byte range."""
    names = [x.split()[0] for x in _PIECES.split(", ")]

    def close(rows: list[list]) -> pa.RecordBatch:
        # successors lie behind their candidates, so one backward pass follows all chains
        exits: dict[int, int] = {}
        for row in reversed(rows):
            if row[4] is not None:
                after = row[2] + row[4] + row[5] + 4
                row[6] = exits[row[2]] = exits.get(after, after)
        out = pa.Table.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=names)
        return out.cast(_ARROW).combine_chunks().to_batches()[0]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, pos, rows = None, 0, []
        for batch in batches:
            for file, block, value in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("value")):
                piece = value.as_py()
                if (file, block) != of:
                    if rows:
                        yield close(rows)
                    # what comes first in a file stands before any magic
                    of, rows, pos = (file, block), [], -len(MAGIC) if block == 0 else 0
                size = len(MAGIC) + len(piece)
                row = [file, block, pos, size, None, None, None, None, None, None, None, None, False]
                if pos >= 0 and (head := _parsed(piece)):
                    n, length, fields = head
                    row[4:6] = n, length
                    row[7:10] = _page(fields.get(b"warc-record-id")), fields.get(b"warc-type", b"").decode("latin-1"), _page(fields.get(b"warc-refers-to"))
                    if n + length + 4 == size:
                        body = _payload(piece[n - len(MAGIC) : n - len(MAGIC) + length])
                        digest = hashlib.sha1(body).hexdigest()
                        if row[8] == "revisit":
                            digest = fields.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha1:")
                        row[10:13] = len(body), digest, True
                rows.append(row)
                pos += size
        if rows:
            yield close(rows)

    return scan


_ARROW = pa.schema(
    [
        ("file", pa.string()),
        ("block", pa.int64()),
        ("at", pa.int64()),
        ("size", pa.int64()),
        ("header_bytes", pa.int64()),
        ("content_bytes", pa.int64()),
        ("exit_at", pa.int64()),
        ("page_id", pa.int64()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("whole", pa.bool_()),
    ]
)


def _piece_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with their place in their byte range, as the candidate scan counts it."""
    of, pos = None, 0
    for batch in batches:
        at = []
        for file, block, n in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), pa.compute.binary_length(batch.column("value")).to_pylist()):
            if (file, block) != of:
                of, pos = (file, block), -len(MAGIC) if block == 0 else 0
            at.append(pos)
            pos += len(MAGIC) + n
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(at, pa.int64()), batch.column("value")], names=["file", "block", "at", "value"])


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one byte range: which candidates the chain from its entry reaches, and which record holds each piece."""
    rows = rows.sort_values("start", ignore_index=True)
    starts, after = rows["start"].tolist(), rows["after"].tolist()
    place = {s: i for i, s in enumerate(starts)}
    reached = [False] * len(starts)
    for entry in rows.loc[rows["entry"], "start"]:
        i = place[entry]
        while i is not None and not reached[i]:
            reached[i] = True
            i = place.get(after[i])
    rows["reached"] = reached
    rows["owner"] = rows["start"].where(rows["reached"]).ffill()
    return rows


def _assemble(rows: pd.DataFrame) -> pd.DataFrame:
    """One record from its pieces in order; a group is one record."""
    rows = rows.sort_values("start")
    whole = b"".join(MAGIC.encode() + bytes(v) for v in rows["value"])[len(MAGIC) :]
    n, length, fields = _parsed(whole)
    body = _payload(whole[n - len(MAGIC) : n - len(MAGIC) + length])
    kind = fields.get(b"warc-type", b"").decode("latin-1")
    return pd.DataFrame(
        {
            "page_id": pd.array([_page(fields.get(b"warc-record-id"))], dtype="Int64"),
            "record_type": [kind],
            "refers_to": pd.array([_page(fields.get(b"warc-refers-to"))], dtype="Int64"),
            "payload_bytes": [len(body)],
            "payload_digest": [hashlib.sha1(body).hexdigest() if kind != "revisit" else fields.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha1:")],
        }
    )


def _reached_entries(links: DataFrame) -> DataFrame:
    """Pointer jumping: the starts that are reachable from offset 0 of their file.

    ``links`` has a row for each start that some chain leaves a byte range to, a few per range.
    """
    reached = links.where("start = 0").select("file", "start")
    jump, known = links, -1
    while (n := reached.count()) > known:
        known = n
        ahead = reached.join(jump, ["file", "start"]).select("file", F.col("exit").alias("start"))
        reached = materialise(reached.union(ahead.join(links.select("file", "start"), ["file", "start"], "left_semi")).distinct(), "reached")
        further = jump.select("file", F.col("start").alias("exit"), F.col("exit").alias("further"))
        jump = materialise(jump.join(further, ["file", "exit"]).select("file", "start", F.col("further").alias("exit")), "jump")
    return reached


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, record_type, refers_to, payload_bytes, payload_digest.

    Files must be uncompressed and start with a record. Bytes between a broken record and the
    end of its file are not reached; a record that its file cuts off is left out. A revisit's
    digest is its header's, its payload_bytes those of the response that it refers to.
    An empty folder of archives gives an empty result.
    """
    pieces = (
        spark.read.schema("value string").option("lineSep", MAGIC).text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    )
    found = materialise(pieces.mapInArrow(_candidates(), _PIECES), "candidates")
    # A row per byte range.
    ranges = found.groupBy("file", "block").agg(F.max(F.col("at") + F.col("size")).alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialise(ranges.select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"), F.sum("bytes").over(Window.partitionBy("file")).alias("file_bytes")), "bases")
    placed = found.join(bases, ["file", "block"]).withColumn("start", F.col("base") + F.col("at")).withColumn("exit", F.col("base") + F.col("exit_at"))
    links = placed.where("exit is not null").select("file", "start", "exit")
    targets = links.select("file", F.col("exit").alias("start")).distinct()
    entries = materialise(links.join(targets, ["file", "start"], "left_semi").union(links.where("start = 0")).distinct(), "links")
    reached = _reached_entries(entries).withColumn("entry", F.lit(True))

    marked = (
        placed.where("at >= 0")
        .join(reached, ["file", "start"], "left")
        .select("file", "block", "at", "start", (F.col("start") + F.col("header_bytes") + F.col("content_bytes") + 4).alias("after"), "file_bytes", F.coalesce("entry", F.lit(False)).alias("entry"), "whole", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest")
    )
    walked = materialise(marked.groupBy("file", "block").applyInPandas(_walk, marked.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", reached boolean, owner double"), "walked")
    good = walked.where(F.col("reached") & (F.col("after") <= F.col("file_bytes")))
    columns = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"]

    # Records with magic in their payload: their pieces, which may lie in several ranges.
    broken = good.where(~F.col("whole")).select("file", F.col("start").alias("owner"), F.col("after").alias("until"))
    inside = walked.where(F.col("owner").isNotNull()).select("file", "block", "at", "start", F.col("owner").cast("long").alias("owner")).join(broken, ["file", "owner"])
    # A piece before a range's first record belongs to the last record that starts before it in the file.
    head = F.struct(F.col("start").alias("owner"), F.col("after").alias("until"), "whole")
    heads = good.select("file", F.lit(None).cast("long").alias("block"), F.lit(None).cast("long").alias("at"), "start", head.alias("head"))
    loose = walked.where(F.col("owner").isNull()).select("file", "block", "at", "start", F.lit(None).cast(heads.schema["head"].dataType).alias("head"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ahead = heads.unionByName(loose).withColumn("head", F.last("head", True).over(earlier)).where("block is not null and not head.whole and start < head.until")
    ahead = ahead.select("file", "block", "at", "start", F.col("head.owner").alias("owner"))
    needed = materialise(inside.select("file", "block", "at", "start", "owner").union(ahead.select("file", "block", "at", "start", "owner")), "inside")
    contents = pieces.mapInArrow(_piece_bytes, "file string, block long, at long, value binary").join(needed, ["file", "block", "at"])
    assembled = contents.select("file", "owner", "start", "value").groupBy("file", "owner").applyInPandas(_assemble, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string")
    records = good.where("whole").select(*columns).unionByName(assembled)

    responses = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("full")).distinct()
    revisits = records.where("record_type = 'revisit'").join(responses, ["refers_to", "payload_digest"], "left")
    return records.where("record_type <> 'revisit'").select(*columns).unionByName(revisits.select("page_id", "record_type", "refers_to", F.col("full").alias("payload_bytes"), "payload_digest"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
     q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
FROM q
"""
