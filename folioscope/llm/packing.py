"""Packing documents into sequences by best fit and swap-based local search.

Every document is tokenized whole, gets an end id and, if it is longer than a sequence, is cut into full pieces, the
first piece taking the remainder. Full pieces fill a sequence each, where they are cut. The others are dealt by hash into
groups of bounded size; a group is packed best-fit decreasing and then improved by a local search over its underfull bins: a piece moves
into the fuller bin that it fits, two bins exchange one piece for one, or one for two, whenever that increases the sum of
squared fills, until no bin can be emptied. Groups lose at most about a bin each against one packing of all rows.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import stored

#: Pieces for each group that is packed at once.
GROUP_PIECES = 8192
#: White space from this length on is encoded apart.
LONG_SPACE = 4096
# The characters that Unicode calls white space.
_LONG_SPACE = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG_SPACE},}}")
_PIECES = "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, salt long"
_OUT = "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class _Underfull:
    """The underfull bins of a state of the search as arrays: rooms, fills, pieces, and couples of pieces of one bin."""

    def __init__(self, own: Bins):
        self.bins = np.array([b for b, x in enumerate(own.items) if x and own.fill[b] < own.capacity], dtype=np.int64)
        self.fills = np.array([own.fill[b] for b in self.bins], dtype=np.int64)
        self.rooms = own.capacity - self.fills
        counts = np.array([len(own.items[b]) for b in self.bins], dtype=np.int64)
        self.pieces = np.array([i for b in self.bins for i in own.items[b]], dtype=np.int64)
        self.bin_of = np.repeat(np.arange(len(self.bins)), counts)
        self.sizes = own.sizes[self.pieces]
        after = np.cumsum(counts)[self.bin_of] - np.arange(len(self.pieces)) - 1  # pieces that follow in the bin
        first = np.repeat(np.arange(len(self.pieces)), after)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(after) - after, after)
        self.couples = np.stack([first, second], axis=1)
        self.couple_of = self.bin_of[first]
        self.sums = self.sizes[first] + self.sizes[second]


class Bins:
    """Bins of one capacity under local search. Underfull bins are indexed by fill and their pieces by length."""

    def __init__(self, lengths: Sequence[int], capacity: int):
        self.capacity, self.lengths = capacity, [int(x) for x in lengths]
        self.sizes = np.array(self.lengths, dtype=np.int64)
        self.items: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self) -> None:
        """Best fit decreasing: each piece, longest first, into the fullest bin that takes it."""
        by_room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        rooms: list[int] = []  # sorted distinct rooms that have bins
        for i in sorted(range(len(self.lengths)), key=lambda i: (-self.lengths[i], i)):
            size = self.lengths[i]
            at = bisect_left(rooms, size)
            if at == len(rooms):
                b, room = len(self.items), self.capacity
                self.items.append([])
                self.fill.append(0)
            else:
                room = rooms[at]
                b = by_room[room].pop()
                if not by_room[room]:
                    rooms.pop(at)
            self.items[b].append(i)
            self.fill[b] += size
            if left := room - size:
                if not by_room[left]:
                    insort(rooms, left)
                by_room[left].append(b)

    def count(self) -> int:
        return sum(1 for x in self.items if x)

    def least(self) -> int:
        """A lower bound of the number of bins, which counts that pieces over half a bin never meet (Martello and Toth's L2)."""
        sizes, c = np.sort(np.array(self.lengths, dtype=np.int64)), self.capacity
        ahead = np.concatenate([[0], np.cumsum(sizes)])
        ks = np.unique(np.concatenate([[0], sizes[sizes <= c // 2]]))
        lo, half, hi = np.searchsorted(sizes, ks, "left"), np.searchsorted(sizes, c // 2, "right"), np.searchsorted(sizes, c - ks, "right")
        hi = np.maximum(hi, half)
        small, big = ahead[half] - ahead[lo], ahead[hi] - ahead[half]
        return int((len(sizes) - half + np.maximum(0, -(-(small - ((hi - half) * c - big)) // c))).max(initial=0))

    def search(self) -> None:
        """Empty bins by moves and exchanges, the emptiest first; every step increases the sum of squared fills, so it ends.

        It ends as soon as the count meets the lower bound, or when every underfull bin has been tried. A bin that was tried
        stays shrunk.
        """
        bins, least, tried = self.count(), self.least(), set()
        view = _Underfull(self)
        while bins > least:
            donor = min((b for b in view.bins if b not in tried and self.items[b]), key=lambda b: (self.fill[b], b), default=None)
            if donor is None or len(view.bins) < 2:
                return
            while self.items[donor] and self._step(donor, view):
                view = _Underfull(self)
            tried.add(donor)
            bins -= not self.items[donor]

    def _step(self, donor: int, view: _Underfull) -> bool:
        """One step that shrinks the donor and lets a bin grow beyond the donor's fill; the largest such gain of its kind."""
        theirs = view.bins != donor
        own = np.array([self.lengths[i] for i in self.items[donor]], dtype=np.int64)
        fits = theirs[None, :] & (view.rooms[None, :] >= own[:, None]) & (view.fills[None, :] + own[:, None] > self.fill[donor])
        if fits.any():  # a move, into the bin that leaves least room
            x, y = np.unravel_index(np.where(fits, view.rooms[None, :] - own[:, None], self.capacity).argmin(), fits.shape)
            return self._swap(donor, [self.items[donor][x]], [], int(view.bins[y]))
        one_of = theirs[view.bin_of]
        if (best := self._gain(own, view.sizes, view.bin_of, one_of, view, donor)) is not None:
            x, y = best
            return self._swap(donor, [self.items[donor][x]], [int(view.pieces[y])], int(view.bins[view.bin_of[y]]))
        if (best := self._gain(own, view.sums, view.couple_of, theirs[view.couple_of], view, donor)) is not None:
            x, y = best
            return self._swap(donor, [self.items[donor][x]], view.pieces[view.couples[y]].tolist(), int(view.bins[view.couple_of[y]]))
        i, j = np.triu_indices(len(own), 1)
        if len(i) and (best := self._gain(own[i] + own[j], view.sizes, view.bin_of, one_of, view, donor)) is not None:
            x, y = best
            return self._swap(donor, [self.items[donor][i[x]], self.items[donor][j[x]]], [int(view.pieces[y])], int(view.bins[view.bin_of[y]]))
        return False

    def _gain(self, give: np.ndarray, take: np.ndarray, of: np.ndarray, free: np.ndarray, view: _Underfull, donor: int) -> tuple[int, int] | None:
        """Numbers of what to give and what to take for it. Sizes to give are looked at a few at a time."""
        best, found = 0, None
        step = max(1, (1 << 22) // max(1, len(take)))
        for at in range(0, len(give) if len(take) else 0, step):
            gain = give[at : at + step, None] - take[None, :]
            gain = np.where(free[None, :] & (gain > best) & (gain <= view.rooms[of][None, :]) & (view.fills[of][None, :] + gain > self.fill[donor]), gain, 0)
            x, y = np.unravel_index(gain.argmax(), gain.shape)
            if gain[x, y] > best:
                best, found = int(gain[x, y]), (at + int(x), int(y))
        return found

    def _swap(self, donor: int, give: list[int], take: list[int], b: int) -> bool:
        for i in give:
            self.items[donor].remove(i)
            self.items[b].append(i)
        for i in take:
            self.items[b].remove(i)
            self.items[donor].append(i)
        gain = sum(self.lengths[i] for i in give) - sum(self.lengths[i] for i in take)
        self.fill[b] += gain
        self.fill[donor] -= gain
        return True


def pack_lengths(lengths: Sequence[int], capacity: int) -> list[list[int]]:
    """Bins of indexes into lengths, each of at most capacity in all."""
    bins = Bins(lengths, capacity)
    bins.best_fit()
    bins.search()
    return [x for x in bins.items if x]


class Encoder:
    """The byte-level BPE of a tokenizers file, run by tiktoken's engine, which needs a fifth of the time of that library.

    Both split by the same pattern and merge the lowest rank first, and in such a file a token's id is its rank; the tests
    hold the ids against those of the tokenizers library. As there, the strings of the file's added tokens are these tokens.
    The engine's splitting gives up on very long white space, which is therefore encoded apart from the text around it.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as file:
            own = json.load(file)
        vocabulary, self.special = own["model"]["vocab"], {t["content"]: t["id"] for t in own["added_tokens"]}
        byte_of = byte_characters()
        ranks = {bytes(byte_of[c] for c in token): rank for token, rank in vocabulary.items() if token not in self.special}
        self.engine = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def ids(self, text: str) -> np.ndarray:
        plain = lambda part: self.engine.encode_to_numpy(part, allowed_special="all")
        if len(text) < LONG_SPACE or not (runs := list(_LONG_SPACE.finditer(text))):
            return plain(text)
        parts, at = [], 0
        for run in runs:
            stop = run.end()
            # but for its last character, which goes with what follows, unless the text or its part ends here
            if stop < len(text) and not text.startswith(tuple(self.special), stop):
                stop -= 1
            parts += [plain(text[at : run.start()]), np.array(self.engine._encode_single_piece(text[run.start() : stop].encode()), dtype=np.uint32)]
            at = stop
        return np.concatenate([*parts, plain(text[at:])])


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)


def byte_characters() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes: a byte that prints stands for itself, the
    others take the code points from 256 on in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _cut(tokenizer: str, capacity: int, end_id: int) -> Callable:
    """A map from documents to their pieces; full pieces get a sequence each."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        own, row, full = _encoder(tokenizer), 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].to_numpy(), batch["text"], strict=True):
                ids = own.ids(text or "").astype("<u4").tobytes() + end
                total, start, piece = len(ids) // 4, 0, 0
                while start < total:
                    stop = start + ((total - start) % capacity or capacity) if start == 0 else start + capacity
                    full += stop - start == capacity
                    rows.append((doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]), -full if stop - start == capacity else None, row))
                    start, piece = stop, piece + 1
                row += 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "salt"])
            yield out.assign(sequence_id=pd.array([r[5] for r in rows], dtype="Int64"))

    return run


def _pack(capacity: int) -> Callable:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "ids_crc32", "doc_id", "piece", "salt"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy()
        sequence, offset = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
        for b, items in enumerate(pack_lengths(lengths, capacity)):
            sequence[items] = b
            offset[items] = np.cumsum(lengths[items]) - lengths[items]
        out = pdf[["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
        out["sequence_id"], out["offset"] = sequence + (int(key[0]) << 32), offset
        return out

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece.

    A null or empty text is one piece, the end id. Repeated rows are packed each; a null doc_id stays null; an empty table
    gives no pieces; further columns are ignored. Texts of any length and of any white space are taken whole. Lengths and
    checksums alone are stored and shuffled, never texts or ids, and full pieces not at all. Groups are dealt by a hash of
    the row's place and content, so that equal documents do not meet in one group.
    """
    pieces = stored(docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(_cut(tokenizer, capacity, end_id), _PIECES), "pieces")
    rest = pieces.where("sequence_id is null")
    groups = max(1, -(-rest.count() // group_pieces))
    dealt = rest.withColumn("bin_group", F.pmod(F.xxhash64("salt", "piece", "ids_crc32"), F.lit(groups)))
    packed = dealt.groupBy("bin_group").applyInPandas(_pack(capacity), _OUT)
    full = pieces.where("sequence_id is not null").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.lit(0).cast("long").alias("offset"))
    return full.unionByName(packed).withColumn("doc_id", F.col("doc_id").cast("long"))
