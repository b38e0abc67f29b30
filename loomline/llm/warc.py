"""WARC archives: writing, and a sequential reader.

Each record is a gzip member of its own. The reader goes through an archive once: it
inflates member after member from fixed-size reads, frames the record's block by its
Content-Length and verifies both digests.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch, table, tune, utf8

CHUNK = 1 << 20
#: Parts that a payload's rows are dealt over where the payloads that occur again can't be broadcast.
SALTS = 32


def record(kind: str, page_id: str | None, url: str | None, payload: bytes, digest: str, n: int, refers_to: str | None, date: str, row: int = 0, of_row: int = 0) -> bytes:
    """An uncompressed record; a revisit's block has the HTTP header but no payload. row, of_row:
    numbers of the page's row and of that it refers to, which tell rows of one id apart."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{_urn(page_id, row)}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {quote(url, safe=_PRINTED)}"] if url is not None else []),
        *([f"WARC-Refers-To: <{_urn(refers_to, of_row)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if kind == "revisit" else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_PRINTED = "".join(chr(c) for c in range(33, 127))


def _urn(page_id: str | None, row: int) -> str:
    return f"urn:row:{row}" if page_id is None else f"urn:page:{quote(page_id, safe='')}:{row}"


def _page(urn: str | None) -> str | None:
    return unquote(urn[10:-1].rpartition(":")[0]) if urn and urn.startswith("<urn:page:") else None


def read_members(stream) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one at a time.

    Raises ValueError where the stream ends inside a member or a member is damaged.
    """
    inflate, parts, begun = zlib.decompressobj(31), [], False
    data = stream.read(CHUNK)
    while data:
        begun = True
        try:
            parts.append(inflate.decompress(data))
        except zlib.error as e:
            raise ValueError(f"damaged gzip member: {e}") from e
        if inflate.eof:
            yield b"".join(parts)
            data, inflate, parts, begun = inflate.unused_data, zlib.decompressobj(31), [], False
            if data:
                continue
        data = stream.read(CHUNK)
    if begun:
        raise ValueError("the archive ends inside a record")


def parse(member: bytes) -> dict:
    """Headers, block and payload of a record, framed and verified; ValueError if not right."""
    head, found, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    block, end = rest[:n], rest[n:]
    if len(block) != n or end != b"\r\n\r\n":
        raise ValueError("the block does not fit its Content-Length")
    if headers.get("warc-block-digest", "") != "sha256:" + hashlib.sha256(block).hexdigest():
        raise ValueError("block digest mismatch")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = headers["warc-payload-digest"].removeprefix("sha256:")
    if headers["warc-type"] == "response" and (size != len(payload) or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload digest mismatch")
    return {"type": headers["warc-type"], "id": _page(headers["warc-record-id"]), "url": headers.get("warc-target-uri"), "refers_to": _page(headers.get("warc-refers-to")), "size": size, "digest": digest, "payload": payload}


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    dedup_bytes: int = 100,
    archive_bytes: int = 64 << 20,
    date: str = "1970-01-01T00:00:00Z",
    max_broadcast: int = 200_000,
) -> DataFrame:
    """Write a record for each row to .warc.gz files under `path`; return their manifest.

    The manifest has path, records, bytes. Only files it names count: an attempt that was
    lost may leave others. Of records with equal payloads of dedup_bytes or more the
    smallest id is a response and the others revisit it; smaller payloads are all
    responses. Archives are closed at archive_bytes.

    Null payloads count as empty, a null url leaves its header out. A null id is larger
    than any other, so its record revisits any equal payload; if all ids of a payload are
    null, or rows tie on the smallest id, each such row is a response. Record ids have the row's
    number in the input's plan behind the page's id, so repeated and null ids give different ones, and
    a revisit names one response's. No rows, no files.

    Payloads are written where they are read: what is joined to them, a row for each payload that
    occurs twice or more, is broadcast up to max_broadcast rows; beyond that payloads are
    shuffled by digest, each digest dealt over SALTS parts.
    """
    tune(pages.sparkSession)
    rows = pages.select(
        F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), utf8(F.col(payload_col)).alias("_body")
    ).select("*", F.sha2("_body", 256).alias("_sha"), F.length("_body").cast("long").alias("_n"), F.monotonically_increasing_id().alias("_row"))
    firsts = (
        rows.where(F.col("_n") >= dedup_bytes)
        .groupBy("_sha")
        .agg(F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "_row"))).alias("_f"), F.count(F.lit(1)).alias("_c"))
        .where("_c > 1 and _f is not null")
        .select("_sha", F.col("_f._id").alias("_first"), F.col("_f._row").alias("_first_row"))
    )
    firsts = materialise(firsts, "warc-firsts")
    if firsts.count() <= max_broadcast:
        joined = rows.join(F.broadcast(firsts), "_sha", "left")
    else:
        salted = firsts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("_salt", F.pmod("_row", F.lit(SALTS)).cast("int")).join(salted, ["_sha", "_salt"], "left")
    again = ~F.col("_id").eqNullSafe(F.col("_first")) & F.col("_first").isNotNull()
    todo = joined.select(
        F.col("_id").cast("string"),
        "_url",
        F.when(~again, F.col("_body")).otherwise(F.lit(b"")).alias("_body"),
        "_sha",
        "_n",
        F.when(again, F.col("_first")).cast("string").alias("_ref"),
        "_row",
        F.when(again, F.col("_first_row")).alias("_ref_row"),
    )

    def write(batches):
        from pyarrow import fs

        sink = name = None
        store, root = fs.FileSystem.from_uri(path)
        made = count = size = 0
        out: list[tuple] = []
        for batch in batches:
            for page_id, url, body, sha, n, ref, row, ref_row in zip(*batch.columns, strict=True):
                if sink is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    store.create_dir(root, recursive=True)
                    sink, count, size = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                ref = ref.as_py()
                raw = record("response" if ref is None else "revisit", page_id.as_py(), url.as_py(), body.as_py(), sha.as_py(), n.as_py(), ref, date, row.as_py(), ref_row.as_py() or 0)
                deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = deflate.compress(raw) + deflate.flush()
                sink.write(data)
                count, size = count + 1, size + len(data)
                if size >= archive_bytes:
                    sink.close()
                    out.append((f"{path}/{name}", count, size))
                    sink, made = None, made + 1
        if sink is not None:
            sink.close()
            out.append((f"{path}/{name}", count, size))
        if out:
            a, b, c = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.int64()), pa.array(c, pa.int64())], names=["path", "records", "bytes"])

    return materialise(todo.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


def read_warc(manifest: DataFrame, path_col: str = "path", payload: bool = True) -> DataFrame:
    """The records of the archives named in `manifest`, each archive read by one task.

    Columns: path, seq (place in the archive), record_type, page_id (string), url,
    payload_bytes, payload_digest (of the full payload, also of a revisit), refers_to
    (string), payload (empty for a revisit; left out if payload is False). A record that
    breaks its framing or digests fails the job. An empty manifest gives no rows.
    """
    tune(manifest.sparkSession)
    names = ["path", "seq", "record_type", "page_id", "url", "payload_bytes", "payload_digest", "refers_to"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    schema = "path string, seq long, record_type string, page_id string, url string, payload_bytes long, payload_digest string, refers_to string"
    if payload:
        names, kinds, schema = [*names, "payload"], [*kinds, pa.binary()], schema + ", payload binary"

    def read(batches):
        from pyarrow import fs

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for where in b.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(where)
                rows, held = [], 0
                with store.open_input_stream(at, compression=None) as stream:
                    for seq, member in enumerate(read_members(stream)):
                        r = parse(member)
                        row = (where, seq, r["type"], r["id"], r["url"], r["size"], r["digest"], r["refers_to"])
                        rows.append((*row, r["payload"]) if payload else row)
                        held += len(r["payload"]) if payload else 100
                        if held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    # An archive is the unit of reading: deal them out evenly.
    spark = manifest.sparkSession
    tasks = max(1, min(manifest.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return manifest.select(F.col(path_col)).repartition(tasks).mapInArrow(read, schema)


def op7_warc(spark, sf_dir):
    """Writes `pages` as archives and reads them back; edge cases as write_warc() and read_warc() say."""
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    manifest = write_warc(pages, scratch(spark, "warc"))
    return read_warc(manifest, payload=False).select(
        F.col("page_id").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, n::bigint AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM q
"""
