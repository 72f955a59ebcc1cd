"""WARC archives: writing with segmented, chunked records, and reassembly of segments on reading."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from sondage.llm.common import bitmap, by_bitmap, materialise, prepare
from sondage.sources.files import scratch

# Fixed values of the format.
VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
STATUS = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


class WarcError(ValueError):
    """A record that breaks the format."""


def chunked(payload: bytes, size: int) -> bytes:
    """Payload in chunked transfer framing."""
    parts = []
    for i in range(0, len(payload), size):
        piece = payload[i : i + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of chunked transfer framing; chunk extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise WarcError("chunk size without an end")
        try:
            size = int(body[at:line].split(b";")[0], 16)
        except ValueError:
            raise WarcError("chunk size is no number") from None
        at = line + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise WarcError("chunk is cut short")
        parts.append(body[at : at + size])
        at += size + 2


def fields(head: bytes) -> dict[str, str]:
    """Named fields after the first line; names in lower case."""
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def http_payload(block: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP fields and the payload of a response's whole block."""
    head, gap, body = block.partition(END)
    if not gap:
        raise WarcError("HTTP header without an end")
    found = fields(head)
    return found, unchunked(body) if found.get("transfer-encoding", "").lower() == "chunked" else body


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(kind: str, name: str, date: str, block: bytes, more: dict) -> bytes:
    """A record without the line ends that close it."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{name}>", "WARC-Date": date} | more | {"Content-Length": len(block)}
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in head.items() if v is not None)]
    return b"\r\n".join(lines) + END + block


def segments(name: str, date: str, block: bytes, more: dict, limit: int) -> Iterator[bytes]:
    """A response as one record, or as a first segment and continuations of at most limit bytes."""
    if len(block) <= limit:
        yield record("response", name, date, block, more)
        return
    pieces = [block[i : i + limit] for i in range(0, len(block), limit)]
    yield record("response", name, date, pieces[0], more | {"WARC-Segment-Number": 1})
    for k, piece in enumerate(pieces[1:], 2):
        last = {"WARC-Segment-Total-Length": len(block)} if k == len(pieces) else {}
        yield record("continuation", f"{name}:{k}", date, piece, {"WARC-Segment-Number": k, "WARC-Segment-Origin-ID": f"<{name}>"} | last)


def _clean(url) -> str | None:
    return None if url is None or url != url else "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _packs(segment_bytes: int, chunk_bytes: int, pack_bytes: int, date: str):
    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for part in parts:
            for name, url, payload, sha1, refers in part.itertuples(index=False):
                more = {"WARC-Target-URI": _clean(url), "WARC-Payload-Digest": "sha1:" + base32(bytes.fromhex(sha1)), "Content-Type": "application/http; msgtype=response"}
                if refers is None or refers != refers:
                    block = STATUS + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(bytes(payload), chunk_bytes)
                    made = segments(name, date, block, more, segment_bytes)
                else:
                    block = STATUS + b"Content-Length: %d\r\n\r\n" % len(payload)
                    made = [record("revisit", name, date, block, more | {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{refers}>"})]
                for r in made:
                    held.append(r)
                    size += len(r)
                    if size >= pack_bytes:
                        yield pd.DataFrame({"pack": [END.join(held)]})
                        held, size = [], 0
        if held:
            yield pd.DataFrame({"pack": [END.join(held)]})

    return write


def write_warc(pages: DataFrame, path: str, *, segment_bytes: int = 8192, chunk_bytes: int = 4096, pack_bytes: int = 8_000_000, packs_per_file: int = 8, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record per row of pages (page_id, url, html) to gzip-compressed WARC files under path.

    Of the rows with equal payloads (html in UTF-8; null is empty) that with the
    largest page_id is a response, the others are revisits that refer to it;
    rows that share this largest page_id are all responses, and a null page_id
    is the smallest. Blocks over segment_bytes are written in segments. A
    file has at most packs_per_file * (pack_bytes + segment_bytes) bytes before
    compression, since reading takes a file at once.

    Only (digest, number) is grouped by digest. A bitmap of the digests that
    repeat, of bounded size, says which pages must join them; the others are
    written where they are read. That join has an exchange on both sides, so a
    payload that very many pages share is split.
    """
    prepare(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    name = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(":"), F.lower(F.hex(F.xxhash64("page_id", "url", "html"))))
    rows = pages.select("page_id", name.alias("name"), "url", payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    found = rows.groupBy("sha1").agg(F.max(F.struct("page_id", "name")).alias("top"), F.count(F.lit(1)).alias("n"))
    copies = materialise(found.where("n > 1").select("sha1", F.col("top.page_id").alias("top_id"), F.col("top.name").alias("top_name")), "copies")
    bits = materialise(bitmap(copies, ["sha1"]), "bits")
    refers = F.when(F.col("top_name").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top_id")), F.col("top_name"))
    known = by_bitmap(rows, bits, ["sha1"], True).join(copies, "sha1", "left").select("name", "url", "payload", "sha1", refers.alias("refers"))
    known = known.unionByName(by_bitmap(rows, bits, ["sha1"], False).select("name", "url", "payload", "sha1", F.lit(None).cast("string").alias("refers")))
    packs = known.mapInPandas(_packs(segment_bytes, chunk_bytes, pack_bytes, date), "pack binary")
    # The lines' end closes a record, so the text writer makes whole WARC files of the packs.
    packs.select(F.col("pack").cast("string")).write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", packs_per_file).text(path)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of each record of an archive, whether compressed as a whole, by record, or not."""
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data[:2] == b"\x1f\x8b":
            one = zlib.decompressobj(31)
            parts.append(one.decompress(data) + one.flush())
            data = one.unused_data
        data = b"".join(parts)
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise WarcError("no record where one must begin")
        end = data.find(END, at)
        if end < 0:
            raise WarcError("record header without an end")
        head = fields(data[at:end])
        begin = end + len(END)
        end = begin + int(head["content-length"])
        if end > len(data):
            raise WarcError("record is cut short")
        yield head, data[begin:end]
        at = end + len(END) if data.startswith(END, end) else end


HEAD = "record_id string, target_uri string, record_type string, refers_to string, payload_digest string"
WHOLE = f"{HEAD}, payload_bytes long, payload binary, error string"
PIECE = f"origin string, segment long, total long, block binary, {HEAD}"


def _urn(value: str | None) -> str | None:
    return value and value.strip("<>")


def _head(h: dict[str, str]) -> tuple:
    digest = h.get("warc-payload-digest")
    return _urn(h.get("warc-record-id")), h.get("warc-target-uri"), h.get("warc-type"), _urn(h.get("warc-refers-to")), digest and digest.partition(":")[2]


def _decoded(kind: str, digest: str | None, block: bytes) -> tuple:
    """(digest, bytes, payload, error) of a whole block; a revisit has no payload, and its length and digest as stated."""
    try:
        http, payload = http_payload(block)
    except WarcError as e:
        return digest, None, None, str(e)
    if kind == "revisit":
        return digest, int(http["content-length"]) if "content-length" in http else None, None, None
    real = base32(hashlib.sha1(payload).digest())
    return real, len(payload), payload, None if digest in (None, real) else f"payload digest is not {digest}"


def _parse(whole: bool, step: int = 4_000_000):
    columns = [c.split()[0] for c in (WHOLE if whole else PIECE).split(", ")]

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for part in parts:
            for data in part["content"]:
                for h, block in records(bytes(data)):
                    if h.get("warc-type") not in ("response", "revisit", "continuation") or ("warc-segment-number" in h) == whole:
                        continue
                    head = _head(h)
                    if whole:
                        out.append((*head[:4], *_decoded(head[2], head[4], block)))
                    else:
                        total = h.get("warc-segment-total-length")
                        out.append((_urn(h.get("warc-segment-origin-id")) or head[0], int(h["warc-segment-number"]), int(total) if total else None, block, *head))
                    size += len(block)
                    if size >= step:
                        yield pd.DataFrame(out, columns=columns)
                        out, size = [], 0
        yield pd.DataFrame(out, columns=columns)

    return parse


def _reassemble(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in WHOLE.split(", ")]
    for part in parts:
        out = []
        for r in part.itertuples(index=False):
            pieces = sorted(r.pieces, key=lambda p: p["segment"])
            block = b"".join(bytes(p["block"]) for p in pieces)
            numbers = [p["segment"] for p in pieces]
            if numbers != list(range(1, len(numbers) + 1)):
                known = (r.payload_digest, None, None, f"segments {numbers[:20]} are not all there are")
            elif r.total is None or r.total != r.total or int(r.total) != len(block):
                known = (r.payload_digest, None, None, f"segments have {len(block)} bytes, not {r.total}")
            else:
                known = _decoded(r.record_type, r.payload_digest, block)
            out += [(r.record_id, r.target_uri, r.record_type, r.refers_to, *known)] * int(r.copies)
        yield pd.DataFrame(out, columns=columns)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The response and revisit records of the archives under path: record_id, target_uri, record_type, refers_to,
    payload_digest (bare base32 SHA-1), payload_bytes, payload, error.

    Only segments are shuffled: equal ones of a record written more than once
    are counted, then the segments of an origin are put in order, their total
    length is verified and their chunks are decoded. A record that fails keeps
    its row, without payload and with the reason in `error`. Other kinds of
    records are skipped; a file is read at once.
    """
    prepare(spark)
    files = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    whole = files().mapInPandas(_parse(True), WHOLE)
    pieces = files().mapInPandas(_parse(False), PIECE)
    heads = [c.split()[0] for c in HEAD.split(", ")]
    single = pieces.groupBy("origin", "segment").agg(F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("total", "block", *heads)])
    origins = single.groupBy("origin").agg(
        F.collect_list(F.struct("segment", "block")).alias("pieces"), F.max("total").alias("total"), F.max("copies").alias("copies"),
        *[F.min(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in heads],
    )
    return whole.unionByName(origins.mapInPandas(_reassemble, WHOLE))


def page_id(urn: str):
    """The page_id in a record's name; null if it was null."""
    return F.expr(f"try_cast(split({urn}, ':')[2] AS BIGINT)")


def query(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "archive")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    return read_warc(spark, path).select(page_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_id("refers_to").alias("refers_to"), "error")


#: All columns of query(): base32 is four letters for every five hexadecimal digits of the SHA-1.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload) AS n, sha1(payload) AS h, max(page_id) OVER (PARTITION BY payload) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(5 * (k // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(5 * (3 - k % 4) AS INTEGER)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM d
"""
