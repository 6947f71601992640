"""Byte-level BPE, encoding and decoding, by a two-tier lookup.

Tier 1: a minimal perfect hash over the vocabulary (hash, displace: every key has a slot of its own in a table with as
many slots as keys) resolves a pre-token that is a vocabulary entry in one probe. Tier 2: any other pre-token is merged
by a heap of candidate pairs over a doubly linked list of its bytes, O(n log n) in its length, so that a megabyte
without a break is no trouble.

Results are those of tiktoken's ``encode_ordinary`` with the same ranks: tiktoken too takes a whole pre-token that is in
the vocabulary as it is, and otherwise merges the lowest rank first, leftmost among equals.

A text is cut at its single spaces first. A piece between two of them, with the space before it, is encoded the same
whatever stands around it, as every pre-token begins at such a space; so pieces are kept in a bounded two-generation
cache, and only new ones reach the two tiers. Pieces that begin or end with other white space are encoded with their
neighbours.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterable
from heapq import heapify, heappop, heappush
from itertools import chain

import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of one generation of the cache of pieces, of which two are held at most: about 300 MB in each worker.
CACHE_ENTRIES = 600_000
#: A longer piece is encoded but not cached.
CACHED_PIECE = 64
_MASK = (1 << 32) - 1


class PerfectHash:
    """Minimal perfect hash from byte strings to their ranks: about 4 keys a bucket, one displacement a bucket.

    A bucket of one key names its slot outright (as a negative displacement), so that the last free slots need no search.
    """

    def __init__(self, ranks: dict[bytes, int]):
        keys = list(ranks)
        n = len(keys)
        self.n, self.buckets = max(n, 1), max(1, (n + 1) // 2)
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        by_bucket: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            by_bucket[(h >> 32) % self.buckets].append(i)
        self.displacement = [0] * self.buckets
        self.key: list[bytes] = [b""] * self.n
        self.rank = [-1] * self.n
        taken = bytearray(self.n)
        for b in sorted(range(self.buckets), key=lambda b: -len(by_bucket[b])):
            members = by_bucket[b]
            if len(members) < 2:
                break
            d = 0
            while True:
                slots = {self._slot(hashes[i], d) for i in members}
                if len(slots) == len(members) and not any(taken[s] for s in slots):
                    break
                d += 1
            self.displacement[b] = d
            for i in members:
                s = self._slot(hashes[i], d)
                taken[s], self.key[s], self.rank[s] = 1, keys[i], ranks[keys[i]]

        free = (s for s in range(self.n) if not taken[s])
        for b, members in enumerate(by_bucket):
            if len(members) == 1:
                s = next(free)
                self.displacement[b], self.key[s], self.rank[s] = -1 - s, keys[members[0]], ranks[keys[members[0]]]

    def _slot(self, h: int, d: int) -> int:
        if d < 0:
            return -1 - d
        x = ((h & _MASK) ^ (d * 0x9E3779B1)) & _MASK
        x = ((x ^ (x >> 15)) * 0x2C1B3C6D) & _MASK
        return (x ^ (x >> 13)) % self.n

    def get(self, token: bytes) -> int:
        """The rank of a vocabulary entry; -1 for any other string."""
        h = xxhash.xxh64_intdigest(token)
        s = self._slot(h, self.displacement[(h >> 32) % self.buckets])
        return self.rank[s] if self.key[s] == token else -1


def merge_bytes(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge a pre-token by a heap of pairs over a linked list of its parts."""
    n, get = len(token), ranks.get
    end = list(range(1, n + 1))  # where the part that begins at i ends; 0 once it is swallowed
    before = list(range(-1, n - 1))
    # a heap entry is one integer: rank, start and stop of a pair side by side
    w = n.bit_length()
    mask = (1 << w) - 1
    heap = [(((r << w) | i) << w) | (i + 2) for i in range(n - 1) if (r := get(token[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        entry = heappop(heap)
        stop, i = entry & mask, (entry >> w) & mask
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue  # one of the two parts has changed since
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := get(token[i : end[stop]])) is not None:
                heappush(heap, (((r << w) | i) << w) | end[stop])
        if (p := before[i]) >= 0 and (r := get(token[p:stop])) is not None:
            heappush(heap, (((r << w) | p) << w) | stop)
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.whole = PerfectHash(self.ranks)
        self.find = regex.compile(pattern).findall
        self.bytes_of = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.digits = [str(i) for i in range(len(self.bytes_of))]
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def pretoken(self, token: str) -> tuple[int, ...]:
        raw = token.encode("utf-8", "surrogatepass")
        rank = self.whole.get(raw)
        return (rank,) if rank >= 0 else tuple(merge_bytes(raw, self.ranks))

    def _kept(self, part: str, make) -> tuple[int, ...]:
        ids = self.young.get(part)
        if ids is None:
            ids = self.old.get(part)
            if ids is None:
                ids = make(part)
            if len(part) <= CACHED_PIECE:
                if len(self.young) >= CACHE_ENTRIES:
                    self.old, self.young = self.young, {}
                self.young[part] = ids
        return ids

    def _piece(self, piece: str) -> tuple[int, ...]:
        if piece[1:].isalpha() and piece[0] == " ":
            return self.pretoken(piece)  # a word alone, as most pieces are
        tokens = self.find(piece)
        young, old, new = self.young.get, self.old.get, self.pretoken
        # a pre-token is often a piece elsewhere; here it is only looked up, so that the cache holds no part twice
        return tuple(chain.from_iterable([young(t) or old(t) or new(t) for t in tokens]))

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text, special tokens being ordinary text."""
        out: list[tuple[int, ...]] = []
        get, kept, piece_of = self.young.get, self._kept, self._piece
        for piece in independent_pieces(text):
            ids = get(piece)
            if ids is None:
                ids = kept(piece, piece_of)
                get = self.young.get
            out.append(ids)
        return list(chain.from_iterable(out))

    def count_pieces(self, pieces: list[str]) -> int:
        """The number of ids of independent pieces."""
        total, get, kept, piece_of = 0, self.young.get, self._kept, self._piece
        for piece in pieces:
            ids = get(piece)
            if ids is None:
                ids = kept(piece, piece_of)
                get = self.young.get
            total += len(ids)
        return total

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


#: A space with other white space beside it, or at either end of the text.
_CROWDED = re.compile(r"\s | \s|^ | $")


def independent_pieces(text: str) -> list[str]:
    """Cut a text into pieces that are encoded independently: at each space between two characters that are no space."""
    if not _CROWDED.search(text):
        first, *rest = text.split(" ")
        return ([first] if first else []) + [f" {x}" for x in rest]
    out = []
    parts = text.split(" ")
    held = [parts[0]]
    last = parts[0][-1:]
    for part in parts[1:]:
        if part and last and not part[0].isspace() and not last.isspace():
            out.append(" ".join(held))
            held = ["", part]
        else:
            held.append(part)
        last = part[-1:] or " "
    out.append(" ".join(held))
    return [x for x in out if x]


@functools.lru_cache(maxsize=2)
def codec(rank_file: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    return Codec(rank_file, pattern)


def encode_decode(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id and digests of the ids and of the decoded bytes, one row for each row of docs.

    A null text counts as empty (no ids); repeated rows and null doc_ids pass through; further columns are ignored. It
    is a map over the rows: no shuffle, and memory is bounded by the cache and one batch.
    """

    def run(batches):
        own = codec(rank_file, pattern)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                ids = own.encode(text or "")
                said = " ".join(map(own.digits.__getitem__, ids))
                rows.append((len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    # as text: pandas has no null among integers
    rows = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))

