"""Operator 3 - WARC archives, read back by verification of their boundary chains.

Writing: one file per task and at most FILE_BYTES, uncompressed. Of pages with equal payloads (by SHA-1), the one with
the largest id is a response record, the others are revisit records that refer to it.

Reading: files are cut into splits. A task looks for the magic line in its split and emits a candidate for every
place where it begins, with the offset where that record would end - its successor. A payload may hold the magic
too, so candidates prove nothing; per file, pointer jumping from the file's start (next = next[next], with the mark
of what is reached) retains the records on the chain, and the chain must end with the file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._util import filesystem, materialize, new_dir

MAGIC = b"WARC/1.0\r\n"
FILE_BYTES, SPLIT_BYTES = 1 << 30, 1 << 26
#: Digests that are broadcast at most, and copies that make one of them.
HOT, HOT_COPIES = 10_000, 1_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"WARC-Type: {kind}", f"WARC-Date: {DATE}", *[f"{k}: {v}" for k, v in headers], f"Content-Length: {len(block)}"]
    return MAGIC + "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    headers = [("WARC-Record-ID", urn(page_id))]
    if url:
        headers.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")))
    headers.append(("WARC-Payload-Digest", f"sha1:{digest(payload)}"))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(refers_to))]
    headers.append(("Content-Type", "application/http;msgtype=response"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record("revisit" if revisit else "response", headers, http if revisit else http + payload)


def write(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """pages (page_id, url, html) -> (file, size) of archives in folder, written already.

    A null html is an empty payload. Payloads under min_bytes are all responses. Rows that repeat the largest id
    with the same payload are all responses; a null id is below all others; other columns are ignored, whatever their names.
    Only digests are shuffled, unless so many payloads repeat that their digests can't be broadcast; then payloads are dealt by
    their digest, but for those of the HOT most frequent digests, which are broadcast always."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    many = rows.where(F.length("payload") >= min_bytes).groupBy("sha").agg(F.count("*").alias("copies"), F.max("page_id").alias("of"))
    many = materialize(many.where("copies > 1"), "warc-repeats")
    hot = many.where(F.col("copies") > HOT_COPIES).orderBy(F.col("copies").desc(), "sha").limit(HOT)
    hot = F.broadcast(hot.select(F.col("sha").alias("h_sha"), F.col("of").alias("h_of")))
    cold = many.select(F.col("sha").alias("c_sha"), F.col("of").alias("c_of"))
    marked = rows.join(hot, F.col("sha") == F.col("h_sha"), "left")
    found = F.col("h_sha").isNotNull()
    spread = F.concat(F.lit("~"), F.xxhash64("page_id", "url").cast("string"))  # meets no digest
    marked = marked.withColumn("dealt", F.when(found, spread).otherwise(F.col("sha"))).join(cold, F.col("dealt") == F.col("c_sha"), "left")
    of = F.when(found, F.col("h_of")).otherwise(F.col("c_of"))
    revisit = (found | F.col("c_sha").isNotNull()) & ~F.col("page_id").eqNullSafe(of)
    marked = marked.select("page_id", "url", "payload", of.alias("of"), revisit.alias("revisit"))

    def run(batches):
        fs, root = filesystem(folder)
        out, name, size, done = None, "", 0, []

        def end():
            out.close()
            fs.move(f"{root}/.{name}", f"{root}/{name}.warc")
            done.append((f"{name}.warc", size))

        for b in batches:
            for page_id, url, payload, of, again in zip(*[c.to_pylist() for c in b.columns]):
                if out is None:
                    name = uuid.uuid4().hex  # the manifest names the files of the attempt that counts
                    out = fs.open_output_stream(f"{root}/.{name}")
                    head = record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(name)}>"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.0\r\n")
                    size = out.write(head)
                size += out.write(page_record(page_id, url, payload, of, again))
                if size >= file_bytes:
                    end()
                    out = None
        if out is not None:
            end()
        yield pa.RecordBatch.from_pydict({"file": [n for n, _ in done], "size": [s for _, s in done]}, pa.schema([("file", pa.string()), ("size", pa.int64())]))

    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    return materialize(marked.mapInArrow(run, "file string, size long"), "warc-files")


_LENGTH = re.compile(rb"\r\nContent-Length: (\d+)\r\n")


def scan(data: bytes, at: int, end: int, size: int):
    """Candidates (offset, successor, header, position of the block in data) that start before end in a file of that
    size; data begins at offset at. Header None: data ends before the candidate, which needs it up to the successor."""
    pos = 0
    while (pos := data.find(MAGIC, pos)) >= 0 and at + pos < end:
        head = data.find(b"\r\n\r\n", pos)
        if head < 0 and at + len(data) < size:
            yield at + pos, min(size, at + len(data) + (1 << 20)), None, 0
            return
        m = _LENGTH.search(data, pos, head + 2) if head >= 0 else None
        if m and len(m[1]) < 19 and (after := at + head + 8 + int(m[1])) <= size:
            if after - at > len(data):
                yield at + pos, after, None, 0
                return
            yield at + pos, after, data[pos : head + 2], head + 4
        pos += len(MAGIC)


def fields(header: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in header.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)


def jump(offset: np.ndarray, after: np.ndarray, size: int) -> np.ndarray:
    """Which candidates the chain from offset 0 reaches, by pointer jumping. Raises if it doesn't end at size."""
    order = np.argsort(offset)
    o, a = offset[order], after[order]
    n = len(o)
    nxt = np.searchsorted(o, a)
    found = np.append(o, -1)[nxt] == a
    nxt = np.where(a == size, n, np.where(found, nxt, n + 1))  # the end, a candidate, or a break
    nxt = np.append(nxt, [n, n + 1])  # the end and the fault point to themselves
    reached = np.zeros(n + 2, bool)
    if n and o[0] == 0:
        reached[0] = True
    elif size:
        raise ValueError("the file doesn't begin with a record")
    count = 0
    while count != (now := int(reached.sum())):  # what 2^k steps reach, then 2^(k+1)
        count = now
        reached[nxt[np.flatnonzero(reached)]] = True
        nxt = nxt[nxt]
    if reached[n + 1] or (size and not reached[n]):
        raise ValueError("the chain of records is broken")
    out = np.zeros(n, bool)
    out[order] = reached[:n]
    return out


def read(spark: SparkSession, folder: str, files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file, size) -> page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record that a file's
    chain reaches but the warcinfo. Digests of responses are computed from their payloads and must agree with the
    header, or it raises, as it does for a chain that breaks; a revisit has those of its header."""
    n_splits = F.greatest(F.lit(1), F.ceil(F.col("size") / split_bytes)).cast("int")
    splits = files.where("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0), n_splits - 1)).alias("split"))
    parts = max(1, splits.count())
    schema = "file string, size long, offset long, after long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches):
        fs, root = filesystem(folder)
        for b in batches:
            for file, size, split in zip(*[c.to_pylist() for c in b.columns]):
                begin, end = split * split_bytes, min(size, (split + 1) * split_bytes)
                rows = []
                with fs.open_input_file(f"{root}/{file}") as f:
                    start, need = begin, end - begin + ((1 << 16) if end < size else 0)
                    while start < end:
                        f.seek(start)
                        data, short = f.read(need), False
                        for offset, after, header, block in scan(data, start, end, size):
                            if short := header is None:  # read again from this candidate on, as far as it needs
                                start, need = offset, max(after - offset, end - offset + (1 << 16))
                                break
                            rows.append((file, size, offset, after, *parse(header, data[block : after - start - 4])))
                        if not short:
                            break
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], pa_schema)

    names = [c.split()[0] for c in schema.split(", ")]
    pa_schema = pa.schema([(n, pa.string() if n in ("file", "url", "payload_digest", "record_type") else pa.int64()) for n in names])

    def reach(table: pa.Table) -> pa.Table:
        size = table.column("size")[0].as_py()
        kept = table.filter(pa.array(jump(table.column("offset").to_numpy(), table.column("after").to_numpy(), size)))
        if "damaged" in kept.column("record_type").to_pylist():
            raise ValueError("a record's payload is not that of its digest")
        return kept

    found = splits.repartition(parts, "file", "split").mapInArrow(run, schema)
    kept = found.groupBy("file").applyInArrow(reach, schema)
    return kept.where("record_type <> 'warcinfo'").select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")


def parse(header: bytes, block: bytes):
    h = fields(header)
    kind, sha = h.get("WARC-Type", ""), h.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    if kind not in ("response", "revisit"):
        return None, None, None, None, kind, None
    http, _, payload = block.partition(b"\r\n\r\n")
    m = _LENGTH.search(http + b"\r\n")
    size = int(m[1]) if m and len(m[1]) < 19 else -1
    if kind == "response" and (size != len(payload) or digest(payload) != sha):
        kind = "damaged"
    return number(h.get("WARC-Record-ID", "")), h.get("WARC-Target-URI"), size, sha, kind, number(h.get("WARC-Refers-To", ""))


def number(name: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d{1,19})>", name)
    return int(m[1]) if m else None


def archive(pages: DataFrame, min_bytes: int = 0, **sizes) -> DataFrame:
    """Write pages and read them back, one row per page; an empty table gives no file and no row."""
    spark = pages.sparkSession
    folder = new_dir(spark, "warc")
    files = write(pages, folder, min_bytes, sizes.get("file_bytes", FILE_BYTES))
    return read(spark, folder, files, sizes.get("split_bytes", SPLIT_BYTES))
