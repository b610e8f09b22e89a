"""WARC derivative builder: metadata and plain-text conversion records from responses.

Each response gives two records, in this order: `metadata` (application/warc-fields:
status, source headers, digests) and `conversion` (text/plain: the shown text). Both
refer to the response by WARC-Refers-To and to each other by WARC-Concurrent-To; ids
are name-based, so a recomputed partition gives the same ones. Null payloads give empty blocks, null
addresses no address header, responses without id get one from their content; equal
responses give equal records. Very long payloads are one record each, in the memory of one task. A declared payload digest that doesn't fit is kept and marked.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, unused
from .html_text import visible_text

#: Name space of the record ids.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:codeweave:warc")
RESPONSE = T.StructType().add("record_id", "string").add("target_uri", "string").add("warc_date", "string").add("http_headers", "string").add("payload", "binary").add("payload_digest", "string")
DERIVED = (
    T.StructType().add("record_type", "string").add("record_id", "string").add("refers_to", "string").add("concurrent_to", "string").add("target_uri", "string").add("warc_date", "string")
    .add("source_payload_digest", "string").add("digest_ok", "boolean").add("block_digest", "string").add("content_length", "long").add("block", "string").add("record", "string")
)


_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def digest_matches(declared: str | None, payload: bytes, decoded: bytes) -> bool | None:
    """Whether a declared digest is that of the payload, as stored or without its transfer encoding, by its own algorithm in base 32 or hexadecimal; null if
    the algorithm isn't known, true if nothing is declared."""
    if declared is None:
        return True
    name, _, value = declared.strip().partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        return None
    for data in (payload, decoded):
        made = hashlib.new(name, data).digest()
        if value.strip().rstrip("=").lower() in (made.hex(), base64.b32encode(made).decode().rstrip("=").lower()):
            return True
    return False


def _unchunked(data: bytes) -> bytes:
    out, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0:
        try:
            n = int(data[at:end].split(b";")[0], 16)
        except ValueError:
            return data
        if not n:
            break
        out.append(data[end + 2 : end + 2 + n])
        at = end + 4 + n
    return b"".join(out)


def inflated(data: bytes, kind: int = 47) -> bytes:
    """What can be read of compressed members (kind: zlib's window bits), as far as they are whole or begun."""
    out = []
    while data:
        z = zlib.decompressobj(kind)
        try:
            out.append(z.decompress(data))
            out.append(z.flush())
        except zlib.error:
            break
        if not z.eof or z.unused_data == data:
            break
        data = z.unused_data
    return b"".join(out)


def entity(headers: dict[str, str], payload: bytes) -> tuple[bytes, str]:
    """(payload without its transfer encoding, its text): encodings and charset as the headers, or the page, declare them."""
    plain = _unchunked(payload) if "chunked" in headers.get("transfer-encoding", "").lower() else payload
    body, coding = plain, headers.get("content-encoding", "").lower()
    if "gzip" in coding or "deflate" in coding:
        body = inflated(plain) or inflated(plain, -15) or plain
    found = _CHARSET.search(headers.get("content-type", "")) or _CHARSET.search(body[:2048].decode("latin-1"))
    try:
        return plain, body.decode(found[1] if found else "utf-8", "replace")
    except LookupError:
        return plain, body.decode("utf-8", "replace")


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, '|'.join(parts))}>"


def _one_line(value: str) -> str:
    return " ".join(value.split())


def serialise(headers: list[tuple[str, str | None]], block: str) -> str:
    """A whole record without its last line feed, which a line-wise writer adds."""
    head = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in headers if v)
    return f"WARC/1.0\r\n{head}\r\n{block}\r\n\r"


def derive_one(rid: str | None, uri: str | None, date: str | None, http: str | None, payload: bytes | None, declared: str | None) -> list[tuple]:
    """The two records of one response, as rows of DERIVED."""
    payload = payload or b""
    actual = digest(payload)
    rid = rid or record_id("response", uri or "", actual)
    status, *source = [x.strip() for x in (http or "").replace("\r\n", "\n").split("\n") if x.strip()] or [""]
    plain, page = entity({n.strip().lower(): v.strip() for n, _, v in (h.partition(":") for h in source)}, payload)
    ok = digest_matches(declared, payload, plain)
    text = visible_text(page)
    ids = {k: record_id(k, rid) for k in ("metadata", "conversion")}
    fields = [("http-status-line", status), *((f"source-{n.strip().lower()}", v) for n, _, v in (h.partition(":") for h in source)), ("source-payload-digest", declared or actual), ("payload-digest-check", "unknown algorithm" if ok is None else "match" if ok else f"mismatch {actual}"), ("source-payload-length", str(len(payload))), ("text-length", str(len(text)))]
    blocks = {"metadata": "".join(f"{k}: {_one_line(v)}\r\n" for k, v in fields if v.strip()), "conversion": text}
    out = []
    for kind, other in (("metadata", "conversion"), ("conversion", "metadata")):
        raw = blocks[kind].encode("utf-8", "replace")
        block_digest = digest(raw)
        headers = [
            ("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", rid), ("WARC-Concurrent-To", ids[other]), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date),
            ("WARC-Block-Digest", block_digest), ("Content-Type", "application/warc-fields" if kind == "metadata" else "text/plain; charset=utf-8"), ("Content-Length", str(len(raw))),
        ]
        out.append((kind, ids[kind], rid, ids[other], uri, date, declared or actual, ok, block_digest, len(raw), blocks[kind], serialise(headers, blocks[kind])))
    return out


def derive(responses: DataFrame, *, keep: list[str] | None = None) -> DataFrame:
    """The derived records of responses (columns of RESPONSE; missing ones count as null; of a table with record_type, its responses), after columns `keep` (default: none). One narrow pass."""
    keep = [c for c in keep or [] if c.lower() not in DERIVED.names]
    own = dict(zip(RESPONSE.names, unused(keep, *RESPONSE.names), strict=True))
    if "record_type" in responses.columns:
        responses = responses.where(F.coalesce(F.lower("record_type"), F.lit("response")) == "response")
    source = responses.select(*[F.col(f"`{c}`") for c in keep], *[(F.col(f"`{f.name}`") if f.name in responses.columns else F.lit(None)).cast(f.dataType).alias(own[f.name]) for f in RESPONSE])
    kept = T.StructType(source.schema.fields[: len(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, own["payload"], 4 << 20):
                rows = [r for x in zip(*[batch.column(own[n]).to_pylist() for n in RESPONSE.names], strict=True) for r in derive_one(*x)]
                twice = pa.array([i for i in range(batch.num_rows) for _ in range(2)], pa.int64())
                kinds = [pa.bool_() if f.dataType == T.BooleanType() else pa.int64() if f.dataType == T.LongType() else pa.string() for f in DERIVED]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(twice) for c in keep], *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names=[*keep, *DERIVED.names])

    return source.mapInArrow(run, T.StructType([*kept.fields, *DERIVED.fields]))


def from_pages(pages: DataFrame, *, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Responses as a crawler would have stored the pages, with all columns but the html; ids come from address and payload."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    sha = F.sha1(payload)
    h = F.md5(F.concat_ws("|", F.coalesce(F.col("url"), F.lit("")), sha))
    part = lambda i, n: F.substring(h, i, n)
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in {"html", *RESPONSE.names}]
    return pages.select(
        *kept, F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-"), part(13, 4), F.lit("-"), part(17, 4), F.lit("-"), part(21, 12), F.lit(">")).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n")).alias("http_headers"), payload.alias("payload"), F.lit(None).cast("string").alias("payload_digest"),
    )


def write_warc(derived: DataFrame, path: str, *, compression: str = "none") -> None:
    """WARC files, one for each partition, through Spark's own writer (so any store and any retry works)."""
    derived.select("record").write.option("compression", compression).option("lineSep", "\n").text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; gzip members are opened. A damaged tail ends the records."""
    if data[:2] == b"\x1f\x8b":
        data = inflated(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])}
        n = int(headers.get("Content-Length", 0))
        yield headers, data[end + 4 : end + 4 + n]
        at = end + 4 + n


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: record_type, record_id, target_uri, warc_date, refers_to, http_headers, payload, payload_digest.
    Files are read whole, one at a time in each task, so a file must fit in a worker's memory (1 GB by custom)."""
    schema = "record_type string, record_id string, target_uri string, warc_date string, refers_to string, http_headers string, payload binary, payload_digest string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for h, block in parse_warc(content.as_py()):
                    http, cut, body = block.partition(b"\r\n\r\n") if h.get("WARC-Type") == "response" else (b"", b"", block)
                    rows.append((h.get("WARC-Type"), h.get("WARC-Record-ID"), h.get("WARC-Target-URI"), h.get("WARC-Date"), h.get("WARC-Refers-To"), http.decode("utf-8", "replace") or None, body if cut or not http else b"", h.get("WARC-Payload-Digest")))
                    if len(rows) == 256:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        names = [x.split()[0] for x in schema.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "payload" else pa.string()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)
