"""Byte-level BPE with a two-tier lookup.

Tier one is a minimal perfect hash over the whole vocabulary (hash and displace): n keys, n slots, one
displacement for each bucket of about four keys, buckets of one key naming their slot). The byte strings lie one after the other in slot order, so a hit
is confirmed by comparing bytes and gives its rank; one probe, no collisions. It resolves every pre-token that is
itself in the vocabulary, and gives the table of pairs of parts that make a token.

Tier two takes the other pre-tokens: their bytes form a linked list, and a heap holds the rank of every adjacent
pair that is in the vocabulary; the lowest rank (leftmost of equals) is merged until none is left, in
O(n log n) for n bytes, so a pre-token of any length is encoded.

Both tiers feed a cache of pre-tokens, bounded by CACHE entries in each worker. Tasks are independent and
deterministic: a lost executor costs its tasks only. The vocabulary file is read once on the driver and broadcast
(some hundred KB, whatever the input).

Defined cases: null text counts as empty, and has no tokens; a lone byte is always in a byte-level vocabulary, so
every text can be encoded and decodes to itself; of equal ranks the leftmost pair is merged first; a text of any length
is encoded whole, in memory in proportion to it; repeated rows are encoded each for themselves; an empty table gives no
rows; columns that are not named in the arguments are ignored, whatever their names; a name in keep that the result has
already is refused.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, read

#: Pre-tokens that a worker remembers.
CACHE = 600_000
#: Longer pre-tokens are not remembered.
CACHED_BYTES = 64
#: Keys in a bucket of the perfect hash, on average.
BUCKET = 4
MASK = (1 << 64) - 1


def load_ranks(path: str) -> list[bytes]:
    """The byte strings of a .tiktoken file in the order of their ranks; ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def key_hash(token: bytes) -> int:
    """64 bits of a token, the same in every process."""
    return int.from_bytes(hashlib.blake2b(token, digest_size=8).digest(), "little")


def mixed(h: np.ndarray | int, d: np.ndarray | int):
    """h displaced by d: a 64-bit mix, on arrays or numbers."""
    if isinstance(h, np.ndarray):
        with np.errstate(over="ignore"):
            x = h ^ (d * np.uint64(0x9E3779B97F4A7C15))
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            return x ^ (x >> np.uint64(32))
    x = h ^ (d * 0x9E3779B97F4A7C15 & MASK)
    x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & MASK
    return x ^ (x >> 32)


class PerfectHash:
    """token -> rank over a fixed vocabulary."""

    def __init__(self, tokens: list[bytes]):
        n = self.n = len(tokens)
        self.buckets = max(1, n // BUCKET)
        hashes = np.fromiter((key_hash(t) for t in tokens), np.uint64, n)
        if len(np.unique(hashes)) != n:
            raise ValueError("two tokens have the same bytes or the same 64-bit hash")
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(ends)
        taken = np.zeros(n, bool)
        self.displace = [0] * self.buckets
        slot_of = np.zeros(n, np.int64)
        for b in np.argsort(-sizes, kind="stable").tolist():
            members = order[ends[b] : ends[b + 1]]
            if len(members) < 2:
                break  # the rest are single keys, which take the free slots directly
            own, start, tries = hashes[members][:, None], 1, 16
            while True:
                slots = (mixed(own, np.arange(start, start + tries, dtype=np.uint64)[None, :]) % np.uint64(n)).astype(np.int64)
                good = ~taken[slots].any(0)
                good &= (np.diff(np.sort(slots, axis=0), axis=0) > 0).all(0)
                if good.any():
                    break
                start, tries = start + tries, min(4096, tries * 4)
            d = int(np.argmax(good))
            taken[slots[:, d]] = True
            slot_of[members] = slots[:, d]
            self.displace[b] = start + d
        free = iter(np.flatnonzero(~taken).tolist())
        for b in np.flatnonzero(sizes == 1).tolist():
            slot_of[order[ends[b]]] = slot = next(free)
            self.displace[b] = -slot - 1
        by_slot = np.argsort(slot_of)
        self.ranks = by_slot.tolist()
        self.tokens = [tokens[i] for i in by_slot]

    def in_order(self) -> list[bytes]:
        out = [b""] * self.n
        for r, t in zip(self.ranks, self.tokens):
            out[r] = t
        return out

    def rank(self, token: bytes) -> int:
        """The rank of token, or -1."""
        h = key_hash(token)
        d = self.displace[h % self.buckets]
        slot = -d - 1 if d < 0 else mixed(h, d) % self.n
        return self.ranks[slot] if self.tokens[slot] == token else -1


class Encoder:
    def __init__(self, perfect: PerfectHash, pattern: str):
        self.find = regex.compile(pattern).findall
        self.hash = perfect
        tokens = self.tokens = perfect.in_order()
        rank = {t: i for i, t in enumerate(tokens)}.get
        self.single = [perfect.rank(bytes([b])) for b in range(256)]
        #: left id * 2^32 + right id -> id of both together
        self.pairs = {
            a << 32 | b: r
            for r, t in enumerate(tokens)
            for i in range(1, len(t))
            if (a := rank(t[:i])) is not None and (b := rank(t[i:])) is not None
        }
        #: 256 * left byte + right byte -> id of both together, or -1
        self.first = [self.pairs.get(a << 32 | b, -1) for a in self.single for b in self.single]
        self.cache: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a pre-token that is not in the vocabulary: a heap of pairs over linked bytes."""
        pair, first, pop, push = self.pairs.get, self.first, heapq.heappop, heapq.heappush
        ids = list(map(self.single.__getitem__, piece))
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = [first[a << 8 | b] for a, b in zip(piece, piece[1:])]
        ranks.append(-1)
        heap = [r * n + i for i, r in enumerate(ranks) if r >= 0]
        heapq.heapify(heap)
        while heap:
            x = pop(heap)
            r = x // n
            i = x - r * n
            if ranks[i] != r:
                continue  # one of the two has been merged meanwhile
            j = after[i]
            ids[i], ids[j], ranks[j] = r, -1, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                x = ranks[i] = pair(r << 32 | ids[k], -1)
                if x >= 0:
                    push(heap, x * n + i)
            else:
                ranks[i] = -1
            p = before[i]
            if p >= 0:
                x = ranks[p] = pair(ids[p] << 32 | r, -1)
                if x >= 0:
                    push(heap, x * n + p)
        return [x for x in ids if x >= 0]

    def word(self, piece: str) -> bytes:
        """The ids of a pre-token as little-endian unsigned 32-bit integers."""
        raw = piece.encode()
        r = self.hash.rank(raw)
        ids = [r] if r >= 0 else self.merge(raw)
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(raw) <= CACHED_BYTES:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        known, word = self.cache.get, self.word
        return b"".join([known(p) or word(p) for p in self.find(text)])

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


_ENCODERS: dict[str, Encoder] = {}


def encoder(perfect: PerfectHash, pattern: str, name: str) -> Encoder:
    """One encoder for each vocabulary in a worker, with its cache."""
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(perfect, pattern)
    return _ENCODERS[name]


def tokenize(docs: DataFrame, path: str, pattern: str, keep: list[str], text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """keep, n_tokens, ids_sha256, decoded_sha256 and, on demand, token_ids (array of int) for every row of docs."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(PerfectHash(load_ranks(path)))

    def run(texts):
        e = encoder(sent.value, pattern, path)
        out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"token_ids": []} if with_ids else {})
        for t in texts:
            ids = e.encode(t or "")
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(e.decode(ids)).hexdigest())
            if with_ids:
                out["token_ids"].append(np.frombuffer(ids, "<u4").astype(np.int32))
        return out

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return map_texts(docs, keep, schema, run, text_col)


def vocabulary() -> tuple[str, str]:
    """Path and pattern of the public vocabulary that the queries use."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every whole text of documents encoded and decoded again."""
    return tokenize(read(spark, sf_dir, "documents"), *vocabulary(), ["doc_id"], with_ids=False)
