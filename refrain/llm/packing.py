"""Best-fit packing improved by swap-based local search.

Documents become token ids with an end id; only a document longer than a sequence is cut,
into full pieces and a rest. Pieces are dealt at random into blocks of bounded size, and
each block is packed on its own: best-fit decreasing first, then local search among the
bins that are not full. A step of the search moves a piece, exchanges one piece for one,
or two for one, always from an emptier bin into a fuller one, so the sum of squared fills
grows with every step and the search ends. Its aim is to empty bins.

Blocks meet in further rounds: the bins that are not full are dealt anew, whole, into
blocks of the same size, and packed again, until the bound ceil(tokens / capacity) is
reached, one block held them all, or a round saves no bin. Full pieces are bins of their
own and never enter a block.

Defined results: a null text is an empty document (one end id); every row, repeated or
not, is packed; doc_id may be null; an empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, materialize
from .tokenization import ENCODE_BYTES, encoder, joined_ids, slices

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
BLOCK_PIECES = 8192


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in ``lengths``: longest first, each into the fullest bin that still takes it."""
    gaps: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_gaps: list[int] = []
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        at = bisect.bisect_left(open_gaps, n)
        if at < len(open_gaps):
            gap = open_gaps[at]
            b = gaps[gap].pop()
            if not gaps[gap]:
                open_gaps.pop(at)
        else:
            gap, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        rest = gap - n
        if rest:
            if not gaps[rest]:
                bisect.insort(open_gaps, rest)
            gaps[rest].append(b)
    return bins


def squared_fill(bins: list[list[int]], lengths: list[int]) -> int:
    return sum(sum(lengths[i] for i in b) ** 2 for b in bins)


class LocalSearch:
    """Swap-based local search over the underfull bins of one packing.

    Each step takes one piece or two out of a source bin, into a bin that is at least as
    full, against nothing or one shorter piece, and picks the exchange that leaves the
    target the smallest gap.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.capacity = capacity
        self.full, loose = [], []
        for b in bins:
            (self.full if sum(lengths[i] for i in b) == capacity else loose).append(list(b))
        self.bins = loose
        self.pieces = [i for b in loose for i in b]
        self.size = {i: lengths[i] for i in self.pieces}
        self.fill = np.array([sum(lengths[i] for i in b) for b in loose], np.int64)
        # One row per piece, then one per bin for plain moves (nothing comes back).
        self.back = np.array([lengths[i] for i in self.pieces] + [0] * len(loose), np.int64)
        self.home = np.array([k for k, b in enumerate(loose) for _ in b] + list(range(len(loose))), np.int64)
        self.row = {i: r for r, i in enumerate(self.pieces)}

    def _step(self, source: int) -> bool:
        mine = self.bins[source]
        outs = {self.size[i]: [i] for i in mine}
        pairs: dict[int, list[int]] = {}
        for a in range(len(mine)):
            for b in range(a):
                pairs.setdefault(self.size[mine[a]] + self.size[mine[b]], [mine[a], mine[b]])
        gap = (self.capacity - self.fill)[self.home]
        open_rows = np.flatnonzero((gap > 0) & (self.home != source) & (self.fill[self.home] >= self.fill[source]))
        if not len(open_rows):
            return False
        gap, back = gap[open_rows], self.back[open_rows]
        room = gap + back
        best: tuple[int, int, list[int]] | None = None
        for own, swap_only in ((outs, False), (pairs, True)):
            if not own:
                continue
            sizes = np.array(sorted(own), np.int64)
            at = np.searchsorted(sizes, room, "right") - 1
            out = sizes[np.maximum(at, 0)]
            good = (at >= 0) & (out > back)
            if swap_only:
                good &= back > 0
            rest = np.where(good, room - out, self.capacity + 1)
            k = int(rest.argmin())
            if rest[k] <= self.capacity and (best is None or rest[k] < best[0]):
                best = (int(rest[k]), int(open_rows[k]), own[int(out[k])])
        if best is None:
            return False
        _, r, leaving = best
        target = int(self.home[r])
        coming = [self.pieces[r]] if r < len(self.pieces) else []
        for i, old, new in [(i, source, target) for i in leaving] + [(i, target, source) for i in coming]:
            self.bins[old].remove(i)
            self.bins[new].append(i)
            self.home[self.row[i]] = new
            self.fill[old] -= self.size[i]
            self.fill[new] += self.size[i]
        return True

    def run(self) -> list[list[int]]:
        """Passes over the sources, emptiest first, until no step improves or bins are as few as can be."""
        least = -(-int(self.fill.sum()) // self.capacity)
        improved = True
        while improved and sum(map(bool, self.bins)) > least:
            improved, failed = False, set()
            for source in np.argsort(self.fill, kind="stable").tolist():
                if not 0 < self.fill[source] < self.capacity:
                    continue
                kind = tuple(sorted(self.size[i] for i in self.bins[source]))
                if kind in failed:
                    continue
                while self.bins[source] and self._step(source):
                    improved = True
                    failed.clear()
                failed.add(kind)
        return self.full + [b for b in self.bins if b]


def pack_block(lengths: list[int], capacity: int) -> list[list[int]]:
    return LocalSearch(best_fit_decreasing(lengths, capacity), lengths, capacity).run()


def repack(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """The pieces of ``bins`` in fewer bins, or ``bins`` again."""
    found = pack_block(lengths, capacity)
    if len(found) >= len(bins):
        found = LocalSearch(bins, lengths, capacity).run()
    return found if len(found) < len(bins) else bins


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document, with a checksum of their ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in slices(batches, 1, ENCODE_BYTES):
            ids, bounds = joined_ids(*coder.encode(batch.column(1)), end_id)
            data = memoryview(ids).cast("B")
            row, piece, start, length, crc = [], [], [], [], []
            for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                for p, low in enumerate(range(a, b, capacity)):
                    high = min(b, low + capacity)
                    row.append(k)
                    piece.append(p)
                    start.append(low - a)
                    length.append(high - low)
                    crc.append(zlib.crc32(data[4 * low : 4 * high]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return columns(docs, doc_id=(id_col, "long"), text=(text_col, "string")).mapInArrow(cut, PIECE_SCHEMA)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    pieces = materialize(cut_pieces(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces")
    schema = f"{PIECE_SCHEMA}, sequence_id long, offset long, fill long"

    def packed(rows: DataFrame, deal: Column, blocks: int, turn: int) -> DataFrame:
        def fill(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            order = ["length", "doc_id", "piece", "ids_crc32"]
            group = group.sort_values(order, ascending=[False, True, True, True], kind="stable", ignore_index=True)
            lengths = group["length"].tolist()
            if turn:
                bins = repack([b.tolist() for b in group.groupby("sequence_id", sort=True).indices.values()], lengths, capacity)
            else:
                bins = pack_block(lengths, capacity)
            sequence, offset, full = (np.zeros(len(lengths), np.int64) for _ in range(3))
            for s, members in enumerate(bins):
                at = 0
                for i in members:
                    sequence[i], offset[i] = (turn << 56) + (int(key[0]) << 24) + s, at
                    at += lengths[i]
                full[members] = at
            return group.assign(sequence_id=sequence, offset=offset, fill=full).drop(columns="block")

        dealt = rows.withColumn("block", F.pmod(F.xxhash64(deal, F.lit(turn)), F.lit(blocks)).cast("int"))
        return materialize(dealt.groupBy("block").applyInPandas(fill, schema), "packed")

    loose = pieces.filter(F.col("length") < capacity)
    # A row number makes equal rows distinct; blocks are dealt by it, so copies spread evenly.
    blocks, turn = max(1, -(-loose.count() // block_pieces)), 0
    latest = packed(loose.withColumns({c: F.lit(None).cast("long") for c in ("sequence_id", "offset", "fill")}), F.monotonically_increasing_id(), blocks, turn)
    whole, before = latest.filter("1 = 0"), None
    while blocks > 1:
        whole, latest = whole.unionByName(latest.filter(F.col("fill") >= capacity)), latest.filter(F.col("fill") < capacity)
        n, bins, tokens = latest.agg(F.count("*"), F.count_if(F.col("offset") == 0), F.sum("length")).first()
        if not n or bins <= -(-tokens // capacity) or bins == before:
            break
        blocks, turn, before = -(-n // block_pieces), turn + 1, bins
        latest = packed(latest, F.col("sequence_id"), blocks, turn)
    full = pieces.filter(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return whole.unionByName(latest).drop("fill").unionByName(full)
