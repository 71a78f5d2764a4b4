"""WARC archives whose repeated payloads are written once.

Headers (payload digests, sizes, ids) are grouped by payload digest, which finds
the one record of each group that stays a response; every other record of the
group is written as a revisit with headers of its own, and without its payload.
Records are written by Spark's text writer, one per row, in gzipped WARC 1.1
files. Reading streams each file through a task and cuts it by Content-Length,
then joins revisits to the responses that they refer to.

SHA-1 is what archives state, but texts that collide under it are known; equal
payloads are therefore told by SHA-256 and size as well.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, salted_join, written

# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
END = "\r\n\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: The digits of base 32 as Spark's conv writes them.
CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
SALTS = 16
#: Payload bytes that a reading task gathers before it hands a batch on.
BATCH_BYTES = 8 << 20
RECORD = "page_id long, record_id string, record_type string, target_uri string, refers_to_id string, payload_bytes long, payload_digest string, intact boolean"


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of ``text`` in UTF-8: five hex digits make four of base 32."""
    digest = F.sha1(text)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), CONV32, BASE32)


def _rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    body = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("body"))


def _header(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"sha1": base32_sha1(F.col("body")), "sha256": F.unhex(F.sha2("body", 256)), "size": F.octet_length("body").cast("long")})


def _record_id(page_id: Column, sha256: Column) -> Column:
    """A URN that the page and its payload determine, so that a task that runs again writes the same."""
    h = F.md5(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("-")), F.hex(sha256)))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _uri(page_id: Column, url: Column) -> Column:
    """The address without characters that would end a header line; one made of the page's id where there is none."""
    one_line = F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")
    return F.coalesce(one_line, F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("-"))))


def originals(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One row per payload of ``least_bytes`` or more that several records share: sha256, size, keep_id, keep_uri.

    ``headers`` has page_id, url, sha256 and size. The largest page_id stays; a null one loses against any number.
    """
    place = F.struct("page_id", _uri(F.col("page_id"), F.col("url")).alias("uri"))
    groups = headers.filter(F.col("size") >= least_bytes).groupBy("sha256", "size").agg(F.max(place).alias("keep"), F.count(F.lit(1)).alias("n"))
    return groups.filter("n > 1").select("sha256", "size", F.col("keep.page_id").alias("keep_id"), F.col("keep.uri").alias("keep_uri"))


def write_archives(
    pages: DataFrame, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> str:
    """Write one record per row of ``pages`` into gzipped WARC files, and return their folder.

    * The payload is the html in UTF-8; null is empty. Of records with equal payloads of at least ``least_bytes``
      bytes the one with the largest page_id is a response, the others are revisits of it; smaller ones are all responses.
    * Rows that repeat the largest page_id of a payload are the same record: all of them are responses.
    * A null page_id never wins against a number; records of null ids only are all responses.
    * A null address is written as one made of the page's id; line ends in an address are percent-encoded.
    * An empty table gives a folder without records; other columns are ignored, whatever their names.
    """
    spark = pages.sparkSession
    rows = _rows(pages, id_col, url_col, html_col)
    best = written(originals(_header(rows).drop("body"), least_bytes), "originals")
    full = _header(rows).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    copied = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    known = full.join(copied, ["sha256", "size", "salt"], "left")
    again = F.col("keep_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep_id"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(again, http).otherwise(F.concat(http, "body"))
    length = F.octet_length(http) + F.when(again, 0).otherwise(F.col("size"))
    refers = F.concat(
        line("WARC-Profile", F.lit(IDENTICAL)),
        line("WARC-Refers-To", _record_id(F.col("keep_id"), F.col("sha256"))),
        line("WARC-Refers-To-Target-URI", F.col("keep_uri")),
        line("WARC-Refers-To-Date", F.lit(date)),
    )
    page = F.when(F.col("page_id").isNotNull(), line("X-Page-ID", F.col("page_id").cast("string"))).otherwise("")
    record = F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("sha256"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _uri(F.col("page_id"), F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(again, refers).otherwise(""),
        page,
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        F.lit("Content-Length: "),
        length.cast("string"),
        F.lit(END),
        block,
    )
    folder = new_path(spark, "warc")
    known.select(record.alias("value")).write.text(folder, compression="gzip", lineSep=END)
    return folder


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record begins with {lines[0][:40]!r}")
    return {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}


def _parsed(fields: dict[str, str], block: bytes) -> tuple[dict, bytes]:
    http, _, payload = block.partition(END.encode())
    stated = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in http.decode("utf-8", "replace").split("\r\n")[1:])}
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = fields.get("warc-type")
    row = {
        "page_id": int(fields["x-page-id"]) if "x-page-id" in fields else None,
        "record_id": fields.get("warc-record-id"),
        "record_type": kind,
        "target_uri": fields.get("warc-target-uri"),
        "refers_to_id": fields.get("warc-refers-to"),
        "payload_bytes": int(stated.get("content-length", len(payload))) if kind == "revisit" else len(payload),
        "payload_digest": digest if kind == "revisit" else base64.b32encode(hashlib.sha1(payload).digest()).decode(),
    }
    row["intact"] = kind == "revisit" or not digest or row["payload_digest"] == digest
    return row, payload


def records(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """The records of the gzipped archives in ``folder``, with ``payload`` (binary, null for revisits) if asked for.

    Gzipped files are not split, so a task reads each from its beginning, one piece between blank lines after the other,
    and holds one record besides its batch. Content-Length alone says where a record ends, so payloads may hold anything.
    ``intact`` says whether a response's payload has the digest that its header states.
    """
    schema = RECORD + (", payload binary" if payloads else "")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "intact": pa.bool_(), "payload": pa.binary()}
        rows: list[dict] = []
        held = 0
        end = END.encode()
        file, pieces, have, need, fields = None, [], 0, 0, None

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)

        def done() -> None:
            if fields is not None or b"".join(pieces).strip():
                raise ValueError(f"{file} ends inside a record")

        for part in batches:
            for path, piece in zip(part.column("file").to_pylist(), part.column("value").to_pylist()):
                if path != file:
                    done()
                    file, pieces, have, fields = path, [], 0, None
                pieces.append(piece + end)
                have += len(piece) + len(end)
                while have and (fields is None or have >= need):
                    buffer = b"".join(pieces)
                    if fields is None:
                        head, found, rest = buffer.partition(end)
                        # A last payload that ends in a line end leaves half a blank line, so one too many was put back.
                        if not found or buffer == end:
                            break
                        fields = _fields(head)
                        need = int(fields["content-length"]) + len(end)
                    else:
                        row, payload = _parsed(fields, buffer[: need - len(end)])
                        rest, fields = buffer[need:], None
                        rows.append(row | ({"payload": payload if row["record_type"] == "response" else None} if payloads else {}))
                        held += len(payload) if payloads else 200
                    pieces, have = ([rest], len(rest)) if rest else ([], 0)
                if held >= BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
        done()
        if rows:
            yield batch()

    lines = spark.read.text(folder, lineSep=END)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")).mapInArrow(run, schema)


def resolved(found: DataFrame) -> DataFrame:
    """Records with ``refers_to``: revisits joined to the page whose response they name, null for responses.

    Many revisits of one response are dealt to several tasks. A revisit whose response isn't there has a null ``refers_to``.
    """
    rows = found.select("page_id", "payload_bytes", "payload_digest", "record_type", "target_uri", "refers_to_id", "record_id", "intact")
    responses = rows.filter("record_type = 'response'")
    single = responses.groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max("page_id").alias("refers_to"))
    asked = rows.filter("record_type = 'revisit'")
    named = salted_join(asked, single, "refers_to_id", SALTS)
    lost = asked.join(single, "refers_to_id", "left_anti").withColumn("refers_to", F.lit(None).cast("long"))
    return named.unionByName(lost).unionByName(responses.withColumn("refers_to", F.lit(None).cast("long")))


def report(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archives written and read back: page_id, payload_bytes, payload_digest, record_type, refers_to, intact."""
    found = written(records(pages.sparkSession, write_archives(pages, least_bytes)), "warc-records")
    return resolved(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
