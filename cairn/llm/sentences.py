"""Operator 5 - SentencePiece encoding and decoding, batched in numpy; the ids are those of the file's own library.

A piece never holds a blank after another character, so a text falls into chunks (blanks and what follows them) with
independent segmentations; long chunks are cut further, at places that no piece crosses. The distinct parts of a batch are
grouped by length and all of a length advance together: rolling hashes of their substrings probe the sorted hashes of the
pieces, and hits are compared character by character. What follows depends on the kind of the file. For a unigram file it is
a Viterbi pass: maxima over the lengths of the last piece store backpointers, and the path has the largest sum of scores. The
scores of a BPE file are ranks of merges, whose sum means nothing: there no sum of piece costs gives the file's segmentation,
so the words of a length take their best merge (ties to the left) together, step by step, from the same probes. Parts too long
for steps over whole words are merged one by one from a heap. Characters without a piece fall back to bytes.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
BLOOM_BITS = 20
CACHE, STEP = 300_000, 100_000  # chunks of a generation; chunks that are encoded together
#: Chunks longer than LONG are cut where no piece crosses; what is left over MOST is merged from a heap. Array cells a batch.
LONG, MOST, CELLS = 48, 512, 2_000_000
WINDOW = 1 << 16
BLANK = "▁"
NONE = np.iinfo(np.int32).max


def _fields(message: bytes):
    """(number, value) of a protocol buffer's fields; numbers as integers, all else as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            c = message[at]
            at += 1
            out |= (c & 127) << shift
            shift += 7
            if c < 128:
                return out

    while at < len(message):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, message[at : at + size]
            at += size


#: Numbers that the format of model files fixes: fields of the whole, of the trainer's and the normalizer's part; kinds.
_PIECE, _TRAINER, _NORMALIZER, _PIECE_KIND, _MODEL_KIND, _SUFFIX, _CHARSMAP, _PREFIX, _SQUEEZE = 1, 2, 3, 3, 3, 24, 2, 3, 4
_UNIGRAM, _BPE, _USER_DEFINED = 1, 2, 4


@dataclass
class Model:
    """Pieces of a vocabulary in order of their ids; kind is n(ormal), b(yte) or x (never matched).

    bpe: scores rank merges, else they are added up. prefix: a blank is put before a text that isn't empty. proto: the file
    itself, where its normalizer changes texts by more than that; the library's normalizer is then applied first."""

    pieces: list[str]
    scores: list[float]
    kinds: str
    bpe: bool = False
    prefix: bool = True
    proto: bytes | None = None
    ready: dict = field(default_factory=dict, repr=False)

    @classmethod
    def load(cls, path: str) -> Model:
        """A unigram or BPE file. Raises for other kinds, user-defined pieces and blanks as suffixes."""
        import sentencepiece

        with open(path, "rb") as f:
            raw = f.read()
        p = sentencepiece.SentencePieceProcessor(model_proto=raw)
        ids = range(p.get_piece_size())
        kinds = "".join("b" if p.is_byte(i) else "x" if p.is_control(i) or p.is_unknown(i) or p.is_unused(i) else "n" for i in ids)
        whole = list(_fields(raw))
        trainer, norm = (dict(_fields(next((v for f, v in whole if f == n), b""))) for n in (_TRAINER, _NORMALIZER))
        kind = trainer.get(_MODEL_KIND, _UNIGRAM)
        own = any(dict(_fields(v)).get(_PIECE_KIND) == _USER_DEFINED for f, v in whole if f == _PIECE)
        if kind not in (_UNIGRAM, _BPE) or own or trainer.get(_SUFFIX):
            raise ValueError("only unigram and BPE files without user-defined pieces and with blanks as prefixes")
        plain = not norm.get(_CHARSMAP) and not norm.get(_SQUEEZE, 1)
        return cls([p.id_to_piece(i) for i in ids], [p.get_score(i) for i in ids], kinds, kind == _BPE, bool(norm.get(_PREFIX, 1)), None if plain else raw)

    def normalizer(self):
        """The library's, for files whose normalizer does more than to mark blanks."""
        if "normalize" not in self.ready:
            import sentencepiece

            self.ready["normalize"] = sentencepiece.SentencePieceProcessor(model_proto=self.proto).normalize
        return self.ready["normalize"]

    def __getstate__(self):
        return self.__dict__ | {"ready": {}}

    def tables(self) -> dict:
        if "hash" in self.ready:
            return self.ready
        normal = [i for i, k in enumerate(self.kinds) if k == "n"]
        codes = [np.frombuffer(self.pieces[i].encode("utf-32-le", "surrogatepass"), "<u4") for i in normal]
        longest = max(map(len, codes))
        chars = np.zeros((len(normal), longest), np.uint32)
        for r, c in enumerate(codes):
            chars[r, : len(c)] = c
        h = np.array([piece_hash(c) for c in codes], np.uint64)
        order = np.argsort(h, kind="stable")
        ids = np.array(normal, np.int64)[order]
        bloom = np.zeros(1 << BLOOM_BITS, bool)
        bloom[h >> np.uint64(64 - BLOOM_BITS)] = True
        least = min((self.scores[i] for i in normal), default=0.0)
        byte = [0] * 256
        text = [b""] * len(self.pieces)
        for i, k in enumerate(self.kinds):
            if k == "b":
                byte[int(self.pieces[i][3:5], 16)] = i
                text[i] = bytes([int(self.pieces[i][3:5], 16)])
            elif k == "n":
                text[i] = self.pieces[i].replace(BLANK, " ").encode("utf-8", "surrogatepass")
        self.ready |= {"hash": h[order], "chars": chars[order], "ids": ids, "scores": np.array(self.scores)[ids], "longest": longest, "bloom": bloom, "unknown": least - 10.0, "byte": byte, "text": text, "cache": {}, "old": {}}
        rank = np.unique(-np.array(self.scores)[normal], return_inverse=True)[1].astype(np.int32)
        self.ready |= {"ranks": rank[order], "rank": {self.pieces[i]: r for i, r in zip(normal, rank.tolist())}, "id": {self.pieces[i]: i for i in normal}}
        return self.ready


def piece_hash(codes: np.ndarray) -> np.uint64:
    h = np.zeros(1, np.uint64)
    for c in codes.tolist():
        h = (h * BASE + np.uint64(c + 1)) * MIX
    return h[0]


def matches(words: np.ndarray, t: dict):
    """words: n x length code points -> for every length k of a piece (row, column, index of the piece) of all hits."""
    size = words.shape[1]
    w = words.astype(np.uint64)
    h = np.zeros(words.shape, np.uint64)
    for k in range(1, min(size, t["longest"]) + 1):
        h = (h[:, : size - k + 1] * BASE + (w[:, k - 1 :] + np.uint64(1))) * MIX
        row, col = np.nonzero(t["bloom"][h >> np.uint64(64 - BLOOM_BITS)])
        at = np.searchsorted(t["hash"], h[row, col])
        at[at == len(t["hash"])] = 0
        good = t["hash"][at] == h[row, col]
        row, col, at = row[good], col[good], at[good]
        for j in range(k):  # no hit by a collision of hashes
            good = t["chars"][at, j] == words[row, col + j]
            if not good.all():
                row, col, at = row[good], col[good], at[good]
        if k < t["longest"]:
            good = t["chars"][at, k] == 0
            row, col, at = row[good], col[good], at[good]
        yield k, row, col, at


def paths(words: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """words: n x length code points -> (ids n x length, right-aligned, -1 for an unknown character; count n) of the best sum."""
    n, size = words.shape
    score, piece = [None], [None]
    for k, row, col, at in matches(words, t):
        s, p = np.full((n, size - k + 1), -np.inf), np.full((n, size - k + 1), -1, np.int64)
        s[row, col], p[row, col] = t["scores"][at], t["ids"][at]
        if k == 1:
            s[p < 0] = t["unknown"]
        score.append(s)
        piece.append(p)
    best = np.full((size + 1, n), -np.inf)
    best[0] = 0.0
    back = np.zeros((size + 1, n), np.int64)
    for e in range(1, size + 1):
        for k in range(min(e, len(score) - 1), 0, -1):  # of equal sums the longest last piece stays
            sum_ = best[e - k] + score[k][:, e - k]
            more = sum_ > best[e]
            best[e] = np.where(more, sum_, best[e])
            back[e][more] = k
    ids = np.full((n, size), -2, np.int64)
    pos, count, live = np.full(n, size), np.zeros(n, np.int64), np.arange(n)
    while len(live):
        k = back[pos[live], live]
        start = pos[live] - k
        for step in np.unique(k).tolist():
            of = live[k == step]
            ids[of, size - 1 - count[of]] = piece[step][of, pos[of] - step]
        count[live] += 1
        pos[live] = start
        live = live[start > 0]
    return ids, count


def merges(words: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """The same by merges of neighbours: every word takes its best-ranked one, the leftmost of equals, until none is left."""
    n, size = words.shape
    widest = min(size, t["longest"])
    rank = np.full((n, size, widest + 1), NONE, np.int32)
    piece = np.full((n, size, widest + 1), -1, np.int32)
    for k, row, col, at in matches(words, t):
        rank[row, col, k], piece[row, col, k] = t["ranks"][at], t["ids"][at]
    end = np.tile(np.arange(1, size + 1), (n, 1))  # of the symbol that starts here; 0: none does
    before = np.tile(np.arange(-1, size - 1), (n, 1))
    pair = np.full((n, size), NONE, np.int32)
    if size > 1 and widest > 1:
        pair[:, :-1] = rank[:, :-1, 2]
    live = np.arange(n)

    def renew(rows, at):
        """Ranks of the symbols that start at (rows, at) with their right neighbours."""
        e = end[rows, at]
        inner = e < size
        stop = np.where(inner, end[rows, np.minimum(e, size - 1)], 0)
        k = stop - at
        ok = inner & (k <= widest)
        pair[rows, at] = np.where(ok, rank[rows, at, np.where(ok, k, 0)], NONE)

    while len(live):
        at = pair[live].argmin(axis=1)
        more = pair[live, at] < NONE
        live, at = live[more], at[more]
        if not len(live):
            break
        mid = end[live, at]
        stop = end[live, mid]
        end[live, at], end[live, mid], pair[live, mid] = stop, 0, NONE
        inner = stop < size
        before[live[inner], stop[inner]] = at[inner]
        renew(live, at)
        left = before[live, at]
        some = left >= 0
        renew(live[some], left[some])
    row, start = np.nonzero(end)
    count = np.bincount(row, minlength=n)
    ids = np.full((n, size), -2, np.int64)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(size - count, count)
    ids[row, place] = piece[row, start, end[row, start] - start]
    return ids, count


def merge_long(word: str, t: dict) -> np.ndarray:
    """Ids of one long word by the same merges, from a heap; -1 for an unknown character."""
    rank, size = t["rank"], len(word)
    end, before = list(range(1, size + 1)), list(range(-1, size - 1))
    heap = [(r, i, i + 1, i + 2) for i in range(size - 1) if (r := rank.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if end[i] != mid or end[mid] != stop:
            continue
        end[i], end[mid] = stop, 0
        if stop < size:
            before[stop] = i
        for a in (before[i], i):
            if a >= 0 and end[a] < size:
                b = end[end[a]]
                if b - a <= t["longest"] and (r := rank.get(word[a:b])) is not None:
                    heapq.heappush(heap, (r, a, end[a], b))
    return np.array([t["id"].get(word[i:e], -1) for i, e in enumerate(end) if e], np.int64)


def cut(word: str, t: dict) -> list[str]:
    """A long word in parts: cut wherever no piece crosses."""
    codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4")
    cross = np.zeros(len(codes) + 1, np.int32)
    for i in range(0, len(codes), WINDOW):
        for k, _, col, _ in matches(codes[None, i : i + WINDOW + t["longest"] - 1], t):
            col = col[col < WINDOW] + i
            if k > 1:
                np.add.at(cross, col + 1, 1)
                np.add.at(cross, col + k, -1)
    at = np.flatnonzero(np.cumsum(cross) == 0)
    at = [0, *at[(at > 0) & (at < len(codes))].tolist(), len(codes)]
    return [word[a:b] for a, b in zip(at, at[1:])]


def encode_words(words: set[str], model: Model) -> dict[str, bytes]:
    """Words, with their blanks marked -> ids as little-endian int32 bytes."""
    t = model.tables()
    by: dict[int, list[str]] = {}
    out = {}
    for w in words:
        if model.bpe and len(w) > MOST:
            ids = merge_long(w, t)
            out[w] = _with_bytes(np.frombuffer(w.encode("utf-32-le", "surrogatepass"), "<u4"), ids, model)
        else:
            by.setdefault(len(w), []).append(w)
    for size, group in by.items():
        step = max(1, min(20_000, CELLS // (size * min(size + 1, t["longest"] + 1))))
        for i in range(0, len(group), step):
            part = group[i : i + step]
            full = "".join(part).encode("utf-32-le", "surrogatepass")
            codes = np.frombuffer(full, "<u4").reshape(len(part), size)
            ids, count = (merges if model.bpe else paths)(codes, t)
            if (odd := (ids == -1).any(axis=1)).any():
                for r in np.flatnonzero(odd).tolist():
                    out[part[r]] = _with_bytes(codes[r], ids[r, size - count[r] :], model)
            flat = ids[np.arange(size) >= (size - count)[:, None]].astype("<i4").tobytes()
            ends = (4 * np.cumsum(count)).tolist()
            start = 0
            for key, end, o in zip(part, ends, odd.tolist()):
                if not o:
                    out[key] = flat[start:end]
                start = end
    return out


def encode_chunks(keys: list[str], model: Model) -> dict[str, bytes]:
    """Chunks -> ids as little-endian int32 bytes."""
    t = model.tables()
    parts = {k: cut(k, t) for k in keys if len(k) > LONG}
    out = encode_words({w for p in parts.values() for w in p}.union(k for k in keys if len(k) <= LONG), model)
    return out | {k: b"".join([out[w] for w in p]) for k, p in parts.items()}


def _with_bytes(word: np.ndarray, ids: np.ndarray, model: Model) -> bytes:
    t, out, at = model.tables(), [], 0
    for i in ids.tolist():
        if i >= 0:
            out.append(i)
            at += len(model.pieces[i])
        else:
            out.extend(t["byte"][b] for b in chr(word[at]).encode("utf-8", "surrogatepass"))
            at += 1
    return np.array(out, "<i4").tobytes()


_CHUNK = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


def chunks(text: str, model: Model) -> list[str]:
    """Chunks of a text, in order, with blanks as the vocabulary writes them."""
    if not text:
        return []
    if model.proto is not None:
        return _CHUNK.findall(model.normalizer()(text).replace(" ", BLANK))
    text = (BLANK if model.prefix else "") + text.replace(" ", BLANK)
    if BLANK + BLANK in text or text[0] != BLANK or text[-1] == BLANK:
        return _CHUNK.findall(text)
    return [BLANK + k for k in text[1:].split(BLANK)]


def encode(texts: list[str | None], model: Model) -> list[bytes]:
    """Ids of every text as little-endian int32 bytes. Chunks met before are remembered, in two generations: what wasn't met
    while the younger one filled up is forgotten."""
    t = model.tables()
    split = [chunks(x, model) if x else [] for x in texts]
    if len(t["cache"]) > CACHE:
        t["old"], t["cache"] = t["cache"], {}
    got, old, missing = t["cache"], t["old"], []
    for k in set().union(*split):
        if k not in got:
            if (ids := old.get(k)) is None:
                missing.append(k)
            else:
                got[k] = ids
    for i in range(0, len(missing), STEP):
        got |= encode_chunks(missing[i : i + STEP], model)
    return [b"".join([got[k] for k in keys]) for keys in split]


def decode(ids: list[int] | np.ndarray, model: Model) -> str:
    """Text of ids; the blank that was put before it goes; bytes that aren't UTF-8 become U+FFFD."""
    text = model.tables()["text"]
    out = b"".join([text[i] for i in ids])
    return (out[1:] if model.prefix and out[:1] == b" " else out).decode("utf-8", "replace")


def encode_column(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", batch: int = 512) -> DataFrame:
    """(doc_id, ids array<int>, n_tokens long) of every row, repeated rows too. Null and empty texts have no tokens; doc_ids may
    repeat or be null; an empty table gives no rows; other columns are ignored, whatever their names."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                got = encode(part.column(1).to_pylist(), model)
                n = np.array([len(g) // 4 for g in got], np.int64)
                ends = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
                ids = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(got), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(n)], names=["doc_id", "ids", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long")


def round_trip(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", batch: int = 512) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit), text_crc32 of the decoded text, exact: the
    decoded text is the text (null as empty; U+2581 decodes as a blank). One row per row, repeated ones too; doc_ids may repeat
    or be null; an empty table gives no rows; other columns are ignored, whatever their names."""
    import zlib

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                texts = part.column(1).to_pylist()
                got = encode(texts, model)
                back = [decode(np.frombuffer(g, "<i4").tolist(), model) for g in got]
                columns = [
                    part.column(0),
                    pa.array([len(g) // 4 for g in got], pa.int64()),
                    pa.array([zlib.crc32(g) for g in got], pa.int64()),
                    pa.array([zlib.crc32(t.encode()) for t in back], pa.int64()),
                    pa.array([(t or "") == d for t, d in zip(texts, back)]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_crc32", "text_crc32", "exact"])

    schema = "doc_id long, n_tokens long, ids_crc32 long, text_crc32 long, exact boolean"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)
