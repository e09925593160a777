"""WARC archives: writing with revisit records and segments, and reading with reassembly.

Writing: every page is a `response` record whose block is an HTTP message with chunked transfer
framing, or, if its payload equals that of a page with a larger id, a `revisit` record that names
that page and holds HTTP headers only. Blocks beyond segment_bytes are cut into segments: the first
stays the response record, the others are `continuation` records that name it. Files are written by
the engine's text writer, gzip-compressed, whose line separator ends each pack of records; with at
most 64 packs of about 1 MB a file. So they can go to any store, and a lost executor leaves no half file.

Reading: files are framed by Content-Length, never by searching. Segments are grouped by origin
identifier, ordered by segment number and checked against the total length; then the chunked
transfer framing is decoded. Payload digests are computed anew and compared with the headers.

Cases: a null payload is an empty one; payloads of zero bytes are compared like others. A null url
gives a record without target URI, control characters and blanks in a url are percent-encoded. Pages
of null id are always responses, and come back with null id. Repeated rows that hold the largest id
of their payload are all responses. An empty table gives an empty result. Lost, repeated or damaged
segments, and blocks of wrong length or digest, give a row with `problem` set and null payload.
Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import Scratch

HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FLUSH = 8 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = 8192) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """Chunk extensions and trailers are allowed and dropped; a framing fault raises ValueError."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            raise ValueError("chunk size")
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk end")
        out.append(body[at : at + n])
        at += n + 2


def record(kind: str, name: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record without the last line end, which the writer adds."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n"


def page_records(page: int | None, serial: str, url: str | None, payload: bytes, top: int | None, segment_bytes: int) -> Iterator[bytes]:
    name = f"<urn:page:{'' if page is None else page}:{serial}>"
    target = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    fields = [("WARC-Target-URI", target), ("WARC-Payload-Digest", "sha1:" + digest(payload)), ("Content-Type", "application/http; msgtype=response")]
    if top is not None:
        block = HTTP_HEAD + b"Content-Length: %d\r\n\r\n" % len(payload)
        yield record("revisit", name, [*fields, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{top}>")], block)
        return
    block = HTTP_HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield record("response", name, [*fields, ("WARC-Segment-Number", "1" if len(parts) > 1 else None)], parts[0])
    for k, part in enumerate(parts[1:], 2):
        total = str(len(block)) if k == len(parts) else None
        yield record("continuation", f"{name[:-1]}:{k}>", [("WARC-Target-URI", target), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(k)), ("WARC-Segment-Total-Length", total)], part)


def with_tops(rows: DataFrame, heavy_share: int = 1000) -> DataFrame:
    """rows(page, payload, ...) with top: the largest page of an equal payload, null for that page itself.

    Payloads of more than a thousandth of all rows, of which there can't be more than a thousand, are
    met by broadcast, and their rows are dealt out evenly in the join that the others need; so no task
    gets a frequent payload, such as the empty one, as a whole. Payloads are shuffled once.
    """
    scratch = Scratch(rows.sparkSession, "warc-tops")
    every = scratch.save(rows.groupBy(F.sha1("payload").alias("sha")).agg(F.max("page").alias("top"), F.count("*").alias("n")), "payloads")
    total = every.agg(F.sum("n")).first()[0] or 0
    heavy = every.where(F.col("n") * heavy_share > total).where("n > 1").select(F.col("sha").alias("heavy_sha"), F.col("top").alias("heavy"))
    light = every.where(F.col("n") * heavy_share <= total).where("n > 1").select(F.col("sha").alias("key"), F.col("top").alias("light"))
    rows = rows.withColumn("sha", F.sha1("payload")).join(F.broadcast(heavy), F.col("sha") == F.col("heavy_sha"), "left")
    key = F.when(F.col("heavy_sha").isNull(), F.col("sha")).otherwise(F.concat(F.lit("#"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(4096))))
    joined = rows.withColumn("key", key).join(light, "key", "left").withColumn("top", F.coalesce("heavy", "light"))
    return joined.withColumn("top", F.when(F.col("page") < F.col("top"), F.col("top")))


#: Records are handed to the writer in packs of about so many bytes; a file has FILE_PACKS packs at most.
PACK, FILE_PACKS = 1 << 20, 64


def write_archive(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", segment_bytes: int = 32768, pack_bytes: int = PACK) -> None:
    """gzip files below path, of about 64 MB before compression at most."""
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    dealt = with_tops(rows)

    def run(batches):
        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for page, url, payload, top in zip(*(batch[c].to_pylist() for c in ("page", "url", "payload", "top")), strict=True):
                for r in page_records(page, f"{part}-{k}", url, payload, top, segment_bytes):
                    held.append(r)
                    size += len(r)
                    if size > pack_bytes:
                        yield pa.record_batch({"record": pa.array([b"\r\n".join(held)], pa.binary())})
                        held, size = [], 0
                k += 1
        if held:
            yield pa.record_batch({"record": pa.array([b"\r\n".join(held)], pa.binary())})

    # A cast of binary to string keeps the bytes, and the text writer writes them as they are.
    records = dealt.select("page", "url", "payload", "top").mapInArrow(run, "record binary").select(F.col("record").cast("string"))
    records.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_PACKS).mode("overwrite").text(path)


def inflated(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file, decompressed piece by piece if it is gzip, of one member or several."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        z = zlib.decompressobj(31)
        while not z.eof:
            piece = z.decompress(data, size)
            data = z.unconsumed_tail
            if not piece and not data:
                break
            yield piece
        data = z.unused_data


def framed(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, by lower-case name, and block of each record."""
    buffer, at = bytearray(), 0

    def more() -> bool:
        nonlocal at
        piece = next(pieces, None)
        if piece is None:
            return False
        del buffer[:at]
        at = 0
        buffer.extend(piece)
        return True

    while True:
        while (end := buffer.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if buffer[at:].strip():
                    yield {"problem": "cut off in a header"}, b""
                return
        lines = bytes(buffer[at:end]).decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        at = end + 4
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = head.get("content-length", "")
        if not lines[0].startswith("WARC/") or not length.isdigit():
            yield head | {"problem": "not a record"}, b""
            return
        while len(buffer) - at < int(length) + 4 and more():
            pass
        block = bytes(buffer[at : at + int(length)])
        yield (head if len(block) == int(length) else head | {"problem": "cut off in a block"}), block
        at = min(at + int(length) + 4, len(buffer))


def decoded(block: bytes) -> tuple[dict[bytes, bytes], bytes]:
    """HTTP headers by lower-case name, and the body without its transfer framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    return fields, dechunked(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body


PAGE = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary, problem string"
PART = "origin string, number int, total long, block binary"
EVERY = f"{PAGE}, said string, {PART}, is_part boolean"


def page_row(head: dict[str, str], block: bytes, with_payload: bool) -> dict:
    row = {"record_id": head.get("warc-record-id"), "record_type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"), "refers_to": head.get("warc-refers-to"), "payload_bytes": None, "payload_digest": None, "payload": None, "problem": head.get("problem")}
    said = head.get("warc-payload-digest", "").rpartition(":")[2] or None
    if row["problem"]:
        return row
    try:
        http, payload = decoded(block)
        if row["record_type"] == "revisit":
            return row | {"payload_bytes": int(http[b"content-length"]) if b"content-length" in http else None, "payload_digest": said}
        found = digest(payload)
        if said and said != found:
            return row | {"problem": "digest"}
        return row | {"payload_bytes": len(payload), "payload_digest": found, "payload": payload if with_payload else None}
    except (ValueError, KeyError) as e:
        return row | {"problem": f"transfer framing: {e}"}


def arrow_type(kind: str) -> pa.DataType:
    return {"boolean": pa.bool_(), "string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[kind]


def batches_of(rows: Iterator[tuple[dict, int]], schema: str) -> Iterator[pa.RecordBatch]:
    """Record batches of about FLUSH bytes or 10,000 rows."""
    kinds, held, size = [x.split() for x in schema.split(", ")], [], 0
    flush = lambda: pa.record_batch({n: pa.array([r.get(n) for r in held], arrow_type(k)) for n, k in kinds})
    for row, n in rows:
        held.append(row)
        size += n
        if size > FLUSH or len(held) >= 10_000:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def read_archive(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """A row for each response and revisit record, with its whole payload decoded."""
    # gzip files can't be split; write_archive bounds them in bytes
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("content")

    def records(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield from framed(inflated(batch["content"][i].as_py()))

    heads = PAGE.replace("payload_bytes long, payload_digest string, payload binary, problem string", "said string")

    def part_row(h: dict, b: bytes) -> dict:
        number, total = h["warc-segment-number"], h.get("warc-segment-total-length", "")
        first = h.get("warc-type") != "continuation"
        name = {"record_id": h.get("warc-record-id"), "record_type": h.get("warc-type"), "target_uri": h.get("warc-target-uri"), "said": h.get("warc-payload-digest")} if first else {}
        return name | {"is_part": True, "origin": h.get("warc-record-id") if first else h.get("warc-segment-origin-id"), "number": int(number) if number.isdigit() else -1, "total": int(total) if total.isdigit() else None, "block": b}

    def run(batches):
        def rows():
            for h, b in records(batches):
                if "warc-segment-number" in h:
                    yield part_row(h, b), len(b)
                elif h.get("warc-type") in ("response", "revisit") or "problem" in h:
                    yield page_row(h, b, with_payload) | {"is_part": False}, len(b) if with_payload else 64

        yield from batches_of(rows(), EVERY)

    def joined(batches):
        def close(name: str, got: list[dict]) -> tuple[dict, int]:
            first, block = got[0], b"".join(x["block"] for x in got)
            total = next((x["total"] for x in got if x["total"] is not None), None)
            head = {"warc-record-id": name, "warc-type": first["record_type"] or "response", "warc-target-uri": first["target_uri"], "warc-payload-digest": first["said"] or ""}
            if [x["number"] for x in got] != list(range(1, len(got) + 1)):
                head["problem"] = "segments missing or repeated"
            elif total != len(block):
                head["problem"] = "total length"
            return page_row(head, block, with_payload), len(block) if with_payload else 64

        def rows():
            name, got = None, []
            for batch in batches:
                for x in batch.to_pylist():
                    if got and x["origin"] != name:
                        yield close(name, got)
                        got = []
                    name = x["origin"]
                    got.append(x)
            if got:
                yield close(name, got)

        yield from batches_of(rows(), PAGE)

    # Each file is unpacked once; what it holds is written, and read for whole records and for segments.
    found = Scratch(spark, "warc-records").save(files.mapInArrow(run, EVERY), "records")
    columns = [x.split()[0] for x in f"{heads}, {PART}".split(", ")]
    segments = found.where("is_part").select(*columns).repartition("origin").sortWithinPartitions("origin", "number")
    return found.where("not is_part").select(*[x.split()[0] for x in PAGE.split(", ")]).union(segments.mapInArrow(joined, PAGE))


def page_id(name) -> F.Column:
    return F.expr(f"try_cast(regexp_extract({name}, '<urn:page:(-?[0-9]+)', 1) as bigint)")


def op2_warc(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch.path("archive"))
    found = read_archive(spark, scratch.path("archive"), with_payload=False)
    scratch.drop("archive")  # what it holds was read by then
    return found.select(page_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_id("refers_to").alias("refers_to"))


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
t AS (SELECT h, max(page_id) AS top FROM p GROUP BY h),
d AS (SELECT DISTINCT h, list_transform(range(40), lambda i: CAST(('0x' || h[i + 1]) AS INTEGER)) AS x FROM p),
s AS (SELECT h, array_to_string(list_transform(range(32), lambda k:
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(range(5), lambda j: ((x[(5 * k + j) // 4 + 1] >> (3 - (5 * k + j) % 4)) & 1) << (4 - j)))::INTEGER]), '') AS name FROM d)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, name AS payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to
FROM p JOIN t USING (h) JOIN s USING (h)
"""
