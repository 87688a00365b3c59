"""Operator 9 - token ids in sorted-string-table shards.

A shard holds documents in ascending order of their keys:

    block*  zstd( u32 n | n x (u8 shared, u8 rest, rest bytes of key) | n x u32 token count | ids )
    index   zstd( per block: first key 9 B, u64 offset, u32 size, u32 documents, u64 tokens before it in the shard )
    bloom   bits, BLOOM_HASHES probes by double hashing of XXH64 of the key
    footer  u64 index offset, u64 index size, u64 bloom offset, u64 bloom size, u64 documents, u64 tokens, u32 width
            of an id in bytes (2 or 4), u32 crc32 of index and bloom, 8 B magic

A key is the document's id as 8 big-endian bytes, sign bit flipped, after a byte that is 1 for a null id (last).
Keys in a block are prefix-compressed; lookup asks the Bloom filter, binary-searches the sparse index, reads one
block. Shards are range partitions; a shard is written under a private name and renamed, so a task that runs twice
leaves one file.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm._util import filesystem, materialize, new_dir

MAGIC = b"CAIRNSST"
FOOTER = struct.Struct("<QQQQQQII8s")
ENTRY = struct.Struct("<9sQIIQ")
#: Byte-level tokenizers write each byte as a printable character: itself where it is one, else from U+0100 on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(sorted({*range(256)} - _SHOWN))}
_BLANK = chr(_BYTE_CHARS[32])
#: The split of byte-level tokenizers, on characters where all libraries agree about letters, digits and spaces.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_LATIN = re.compile("[\t-\r -~\u00a1-\u024f]+")
_BLANK_AFTER_SPACE = re.compile(r"\s ")
BLOCK_BYTES = 1 << 18
BLOOM_BITS_PER_KEY, BLOOM_HASHES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"\x01" + bytes(8) if doc_id is None else b"\x00" + struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return None if key[0] else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class Writer:
    def __init__(self, out, width: int):
        self.out, self.width, self.at, self.docs, self.tokens = out, width, 0, 0, 0
        self.index: list[bytes] = []
        self.hashes: list[bytes] = []
        self.zip = zstandard.ZstdCompressor(level=1)
        self._new()

    def _new(self):
        self.keys, self.counts, self.values, self.size = [], [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian, in the shard's width. Documents come in ascending order of their keys."""
        key = key_of(doc_id)
        self.keys.append(key)
        self.counts.append(len(ids) // self.width)
        self.values.append(ids)
        self.hashes.append(key)
        self.size += len(self.values[-1])
        if self.size >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if not self.keys:
            return
        parts, last = [struct.pack("<I", len(self.keys))], b""
        for k in self.keys:
            shared = next((i for i in range(min(len(k), len(last))) if k[i] != last[i]), len(last))
            parts += [bytes((shared, len(k) - shared)), k[shared:]]
            last = k
        parts += [np.array(self.counts, "<u4").tobytes(), *self.values]
        block = self.zip.compress(b"".join(parts))
        self.index.append(ENTRY.pack(self.keys[0], self.at, len(block), len(self.keys), self.tokens))
        self.out.write(block)
        self.at += len(block)
        self.docs += len(self.keys)
        self.tokens += sum(self.counts)
        self._new()

    def close(self) -> None:
        self.flush()
        bits = max(64, BLOOM_BITS_PER_KEY * len(self.hashes))
        bloom = np.zeros(-(-bits // 8) * 8, np.uint8)
        for i in range(0, len(self.hashes), 4096):
            bloom[[p for k in self.hashes[i : i + 4096] for p in _probes(k, len(bloom))]] = 1
        index, packed = self.zip.compress(b"".join(self.index)), np.packbits(bloom, bitorder="little").tobytes()
        self.out.write(index)
        self.out.write(packed)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), self.docs, self.tokens, self.width, zlib.crc32(packed, zlib.crc32(index)), MAGIC))


class Reader:
    def __init__(self, file):
        self.file = file
        file.seek(file.size() - FOOTER.size)
        a, n, b, m, self.docs, self.tokens, self.width, crc, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        file.seek(a)
        index, bloom = file.read(n), file.read(m)
        if zlib.crc32(bloom, zlib.crc32(index)) != crc or b != a + n:
            raise ValueError("the shard's index is damaged")
        self.index = list(ENTRY.iter_unpack(zstandard.decompress(index)))
        self.bloom = np.unpackbits(np.frombuffer(bloom, np.uint8), bitorder="little")

    def block(self, i: int):
        """(key, ids) of every document of a block."""
        _, at, size, _, _ = self.index[i]
        self.file.seek(at)
        raw = zstandard.decompress(self.file.read(size))
        (n,), p, key, keys = struct.unpack_from("<I", raw), 4, b"", []
        for _ in range(n):
            shared, rest = raw[p], raw[p + 1]
            key = key[:shared] + raw[p + 2 : p + 2 + rest]
            keys.append(key)
            p += 2 + rest
        counts = np.frombuffer(raw, "<u4", n, p).astype(np.int64)
        ids = np.frombuffer(raw, f"<u{self.width}", int(counts.sum()), p + 4 * n).astype("<u4")
        ends = np.cumsum(counts)
        return [(k, ids[e - c : e]) for k, c, e in zip(keys, counts.tolist(), ends.tolist())]

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of all documents with that id; usually one, none if absent."""
        key = key_of(doc_id)
        if not all(self.bloom[p] for p in _probes(key, len(self.bloom))):
            return []
        lo, hi = 0, len(self.index)
        while lo < hi:  # the first block whose first key is not below it; equal keys can begin in the one before
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.index[mid][0] < key else (lo, mid)
        out = []
        for i in range(max(0, lo - 1), len(self.index)):
            if self.index[i][0] > key:
                break
            out += [v for k, v in self.block(i) if k == key]
        return out


class Encoder:
    """Exact ids of a byte-level tokenizer file, as little-endian bytes, with distinct chunks encoded once.

    The pre-tokenizer never joins what stands before a blank that follows a non-blank with that blank, so a text is
    cut there; chunks after white space stay together. Chunks of Latin characters are split as the file's
    pre-tokenizer splits them and go to the library's model word by word; all others go through the whole library."""

    LIMIT = 400_000  # chunks of either generation

    def __init__(self, definition: str, width: int = 4):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.code = {2: "H", 4: "I"}[width]
        d = json.loads(definition)
        pre = d.get("pre_tokenizer") or {}
        self.plain = d.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and d["model"]["type"] == "BPE"
        self.special = [t["content"] for t in d.get("added_tokens") or []]
        self.plain &= len(self.special) == 1 and not self.special[0][:-1].isalpha()
        self.mark = self.special[0] if self.special else ""
        self.model = self.tokenizer.model
        self.words = _Cache(self._word)
        self.tails = _Cache(self._tail)  # by chunks without their first blank

    def _word(self, word: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(_BYTE_CHARS))]).tobytes()

    def _tail(self, key: str) -> bytes:
        if key and self.plain and key.isascii():
            if key.isalpha():
                return array(self.code, [t.id for t in self.model.tokenize(_BLANK + key)]).tobytes()
            if key[-1] in ".," and key[:-1].isalpha():
                return self.tails[key[:-1]] + self.words[key[-1]]
        return self._chunk(" " + key)

    def _chunk(self, chunk: str) -> bytes:
        if self.plain and self.mark not in chunk and _LATIN.fullmatch(chunk):
            return b"".join([self.words[w] for w in _SPLIT.findall(chunk)])
        return array(self.code, self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    @staticmethod
    def chunks(text: str) -> tuple[str, list[str]]:
        """What stands before the first cut, and the rest's chunks without their first blanks."""
        parts = text.split(" ")
        if not _BLANK_AFTER_SPACE.search(text):
            return parts[0], parts[1:]
        out, now = [], parts[0]
        for p in parts[1:]:
            if now and not now[-1].isspace():
                out.append(now)
                now = " " + p
            else:
                now += " " + p
        out.append(now)
        return (out[0], [c[1:] for c in out[1:]]) if len(out) > 1 or not now.startswith(" ") else ("", [now[1:]])

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.plain:  # a normalizer or another pre-tokenizer may look across the cuts
            return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        self.words.age(self.LIMIT // 8)
        self.tails.age(self.LIMIT)
        split = map(self.chunks, texts)
        return [(self._chunk(head) if head else b"") + b"".join(map(self.tails.__getitem__, rest)) for head, rest in split]


class _Cache(dict):
    """Made on demand, in two generations: what wasn't asked for while the younger one filled up is forgotten."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key):
        if (out := self.old.get(key)) is None:
            out = self.make(key)
        self[key] = out
        return out

    def age(self, limit: int) -> None:
        if len(self) > limit:
            self.old = dict(self)
            self.clear()


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(definition: str, width: int) -> Encoder:
    """One per Python worker, so that its tasks share what was encoded before."""
    if (definition, width) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[definition, width] = Encoder(definition, width)
    return _ENCODERS[definition, width]


def write(docs: DataFrame, definition: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, width: int = 4) -> DataFrame:
    """Encode, append end_id and write shards in ascending order of ids -> (shard, docs, tokens), written already.

    Null ids come last, equal ids in the order of a hash of their text; a null text is empty."""
    import os

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(definition)

    def run(batches):
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own, n, end = encoder(shared.value, width), TaskContext.get().partitionId(), end_id.to_bytes(width, "little")
        fs, root = filesystem(folder)
        name = f"{root}/.{n:06d}-{uuid.uuid4().hex}"
        with fs.open_output_stream(name) as out:
            w = Writer(out, width)
            for b in batches:
                for i in range(0, b.num_rows, 256):
                    part = b.slice(i, 256)
                    got = own.encode([t or "" for t in part.column(1).to_pylist()])
                    for doc_id, ids in zip(part.column(0).to_pylist(), got):
                        w.add(doc_id, ids + end)
            w.close()
        fs.move(name, f"{root}/{n:06d}.sst")
        yield pa.RecordBatch.from_pydict({"shard": [n], "docs": [w.docs], "tokens": [w.tokens]}, pa.schema([("shard", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).withColumn("h", F.xxhash64("t"))
    order = [F.col("id").asc_nulls_last(), F.col("h").asc()]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "t")
    return materialize(rows.mapInArrow(run, "shard long, docs long, tokens long"), "sst-manifest")


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards; one task a shard.

    The manifest has a row per shard: a shard's first token is the sum over the shards before it."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    before = F.sum("tokens").over(Window.orderBy("shard")) - F.col("tokens")
    shards = manifest.where("docs > 0").select("shard", before.alias("base"))
    n = manifest.where("docs > 0").count()
    if not n:
        return spark.createDataFrame([], schema)

    def run(batches):
        fs, root = filesystem(folder)
        for b in batches:
            for number, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with fs.open_input_file(f"{root}/{number:06d}.sst") as f:
                    r = Reader(f)
                    for k, entry in enumerate(r.index):
                        docs = r.block(k)
                        n = np.array([len(v) for _, v in docs], np.int64)
                        start = base + entry[4] + np.cumsum(n) - n
                        columns = [pa.array([id_of(x) for x, _ in docs], pa.int64()), pa.array(start), pa.array(n), pa.array([zlib.crc32(v.tobytes()) for _, v in docs], pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.repartition(n).mapInArrow(run, schema)


def token_shards(docs: DataFrame, definition: str, **params) -> DataFrame:
    """Write docs as shards and read them back. Widths of 2 bytes where all ids fit."""
    import json

    folder = new_dir(docs.sparkSession, "sst")
    model = json.loads(definition)
    most = max([*model["model"]["vocab"].values(), *[t["id"] for t in model.get("added_tokens") or []], params.get("end_id", 0)])
    manifest = write(docs, definition, folder, width=2 if most < 1 << 16 else 4, **params)
    return read(docs.sparkSession, folder, manifest)
