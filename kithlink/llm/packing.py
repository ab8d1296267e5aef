"""Mixture-controlled packing into sequences of fixed length by deficit round-robin.

Every source is a queue of tokens. A window is a run of sequences; round by round each queue puts its quantum into the
window, the share that the target proportions give it, and what a quantum has beyond whole tokens is carried as a
deficit into the next window. A queue that runs dry leaves its share to the others, in proportion; without given targets
each source's target is its share of all tokens, and all queues run dry together; queues without a target come last.

With carried deficits the state before any window follows from the queues' totals alone, so tasks lay out their own
documents without waiting for each other, and deficits carry over partitions as well as windows. The state is kept in a
balanced tree over the queues: of the first n tokens of a node, its left half has the whole part of its ideal share of
n and the right half the rest, so every window is full to the token and a queue is off its ideal by less than one token
a level. All of it is whole-number arithmetic, exact at any size, in time and memory of the tree's depth for a document.

The driver holds the name and the total of each source, which is what describes a mixture, and of documents nothing.

Windows follow each other without gaps and are cut at every `length` tokens, so that only the last sequence is short.

Defined cases: null text is the end id alone; a null source is the source ''; null doc_ids and repeated rows are packed
like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kithlink.llm.bpe import byte_bpe, crc
from kithlink.llm.common import materialise, text_of

ENCODED = "doc_id long, source string, part int, within long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source_queue int, window_id long"


class Halves:
    """How the first n tokens of a node are shared by its halves while queues run dry one after the other.

    In a phase the left half has `left + (n - all) * wl // w` of n: what its dry queues held, and of the rest its share."""

    def __init__(self, left: list[tuple[int, int]], right: list[tuple[int, int]]):
        """(total, weight) of the queues of each half."""
        queues = sorted([(Fraction(t, w), t, w, True) for t, w in left] + [(Fraction(t, w), t, w, False) for t, w in right])
        dry, dry_left, w, wl = 0, 0, sum(q[2] for q in queues), sum(q[2] for q in queues if q[3])
        self.starts, self.phases = [0], [(0, 0, w, wl)]
        for at, t, weight, is_left in queues:
            dry, w = dry + t, w - weight
            if is_left:
                dry_left, wl = dry_left + t, wl - weight
            start = -(-(dry * at.denominator + at.numerator * w) // at.denominator)
            if w and start > self.starts[-1]:
                self.starts.append(start)
                self.phases.append((dry, dry_left, w, wl))
            elif w:
                self.phases[-1] = dry, dry_left, w, wl
        self.total = dry
        self.at_starts = [self.of(n) for n in self.starts] + [dry_left]
        self.rest_at_starts = [n - x for n, x in zip([*self.starts, dry], self.at_starts)]

    def of(self, n: int) -> int:
        """The left half's part of the first n tokens."""
        dry, left, w, wl = self.phases[bisect_right(self.starts, n) - 1]
        return left + (n - dry) * wl // w

    def when(self, m: int, right: bool) -> int:
        """The least n of which the half has m > 0."""
        k = bisect_left(self.rest_at_starts if right else self.at_starts, m) - 1
        end = self.starts[k + 1] if k + 1 < len(self.starts) else self.total
        dry, left, w, wl = self.phases[k]
        if right:
            n = dry + (m - 1 - dry + left) * w // (w - wl) + 1 if w > wl else end
        else:
            n = dry - (left - m) * w // wl if wl else end
        return min(n, end)


class Tree:
    """Queues with totals and weights of their own."""

    def __init__(self, totals: list[int], weights: list[int]):
        self.total, nodes = sum(totals), {}
        todo = [(0, len(totals))]
        while todo:
            lo, hi = todo.pop()
            if hi - lo > 1:
                mid = (lo + hi) // 2
                nodes[(lo, hi)] = Halves(list(zip(totals[lo:mid], weights[lo:mid])), list(zip(totals[mid:hi], weights[mid:hi])))
                todo += [(lo, mid), (mid, hi)]
        self.size, self.nodes = len(totals), nodes

    def left(self, lo: int, mid: int, hi: int, n: int) -> int:
        return self.nodes[(lo, hi)].of(n)

    def when(self, lo: int, mid: int, hi: int, m: int, right: bool) -> int:
        return self.nodes[(lo, hi)].when(m, right)


class Even:
    """Queues that run dry together: the weights are the totals, and one sum for each queue is enough."""

    def __init__(self, totals: list[int]):
        self.sums = [0, *accumulate(totals)]
        self.total, self.size = self.sums[-1], len(totals)

    def left(self, lo: int, mid: int, hi: int, n: int) -> int:
        s = self.sums
        return n * (s[mid] - s[lo]) // (s[hi] - s[lo])

    def when(self, lo: int, mid: int, hi: int, m: int, right: bool) -> int:
        s = self.sums
        if right:
            return (m - 1) * (s[hi] - s[lo]) // (s[hi] - s[mid]) + 1
        return -(-m * (s[hi] - s[lo]) // (s[mid] - s[lo]))


class Schedule:
    """In which order the queues' tokens are put, and where they lie. Queues without tokens have no place."""

    def __init__(self, totals: list[int], weights: list[float] | None, window: int):
        totals = [int(t) for t in totals]
        self.window, self.total = window, sum(totals)
        some = [i for i, t in enumerate(totals) if t > 0]
        aimed = [i for i in some if weights is not None and weights[i] > 0]
        rest = [i for i in some if weights is None or not weights[i] > 0]
        self.tiers = []  # one after the other
        if aimed:
            most = max(weights[i] for i in aimed)
            self.tiers.append(Tree([totals[i] for i in aimed], [max(1, round(Fraction(weights[i]) / Fraction(most) * (1 << 40))) for i in aimed]))
        if rest:
            self.tiers.append(Even([totals[i] for i in rest]))
        self.place = {q: (0, k) for k, q in enumerate(aimed)} | {q: (len(self.tiers) - 1, k) for k, q in enumerate(rest)}
        self.before_tier = [0, *accumulate(t.total for t in self.tiers)]

    def put(self, queue: int, n: int) -> tuple[int, int]:
        """Of the first n tokens: those of queues before this one, and its own."""
        tier, k = self.place[queue]
        t, before = self.tiers[tier], 0
        for i, other in enumerate(self.tiers):
            if i < tier:
                before += min(n, other.total)
                n = max(0, n - other.total)
        n = min(n, t.total)
        lo, hi = 0, t.size
        while hi - lo > 1:
            mid = (lo + hi) // 2
            x = t.left(lo, mid, hi, n)
            if k < mid:
                hi, n = mid, x
            else:
                lo, n, before = mid, n - x, before + x
        return before, n

    def rank(self, queue: int, pos: int) -> int:
        """How many tokens are put before the queue's token pos."""
        tier, k = self.place[queue]
        t, path, lo, hi = self.tiers[tier], [], 0, self.tiers[tier].size
        while hi - lo > 1:
            mid = (lo + hi) // 2
            path.append((lo, mid, hi))
            lo, hi = (lo, mid) if k < mid else (mid, hi)
        n = pos + 1
        for lo, mid, hi in reversed(path):
            n = t.when(lo, mid, hi, n, k >= mid)
        return self.before_tier[tier] + n - 1

    def runs(self, queue: int, pos: int, n: int):
        """(window, place, tokens) of the queue's tokens pos to pos + n, which lie together in each window."""
        at, end = pos, pos + n
        w = self.rank(queue, pos) // self.window
        while at < end:
            first, last = w * self.window, min((w + 1) * self.window, self.total)
            (b0, p0), (b1, p1) = self.put(queue, first), self.put(queue, last)
            take = min(end, p1) - at
            if take > 0:
                yield w, first + b1 - b0 + at - p0, take
                at += take
            w = w + 1 if at >= p1 else self.rank(queue, at) // self.window


def pack(
    docs: DataFrame, *, length: int = 1024, window_sequences: int = 64, targets: dict[str, float] | None = None,
    source: str = "source", end_id: int = 0, folder: str | None = None,
) -> DataFrame:
    """Pieces of documents and where they lie. targets: weights by source."""

    def encode(batches):
        bpe, part, put = byte_bpe(folder), TaskContext.get().partitionId(), {}
        for b in batches:
            out = {k: [] for k in ("within", "n", "ids")}
            for q, text in zip(b.column(1).to_pylist(), b.column(2)):
                ids = bpe.encode_array(text.as_py(), end_id)
                out["within"].append(put.get(q, 0))
                put[q] = put.get(q, 0) + len(ids)
                out["n"].append(len(ids))
                out["ids"].append(ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else ids.tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([part] * len(b), pa.int32()), pa.array(out["within"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["ids"], pa.binary())],
                names=["doc_id", "source", "part", "within", "n", "ids"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), text_of().alias("text"))
    encoded = materialise(rows.mapInArrow(encode, ENCODED), "pack")
    parts = encoded.groupBy("source", "part").agg(F.sum("n").alias("n"))
    base = parts.select("source", "part", (F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")).alias("base"))
    base = materialise(base, "pack-base")  # its size is known when the join is planned, so a small one needs no shuffle of ids
    totals = dict(sorted((r["source"], r["n"]) for r in parts.groupBy("source").agg(F.sum("n").alias("n")).collect()))  # a row for each source
    queue_of = {s: i for i, s in enumerate(totals)}
    schedule = Schedule(list(totals.values()), [targets.get(s, 0.0) for s in totals] if targets else None, length * window_sequences)
    shared = docs.sparkSession.sparkContext.broadcast((queue_of, schedule))

    def lay(batches):
        queue_of, schedule = shared.value
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source_queue", "window_id")
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        for b in batches:
            cols = {k: [] for k in names}
            for doc_id, s, n, at, data in zip(*(c.to_pylist() for c in b.columns[:4]), b.column(4)):
                q, data, done = queue_of[s], data.as_py(), 0
                width = len(data) // n
                ids = np.frombuffer(data, dtype=f"<u{width}").astype("<u4")
                for w, pos, run in schedule.runs(q, at, n):
                    while run:
                        take = min(run, length - pos % length)
                        for k, v in zip(names, (doc_id, done, take, crc(ids[done : done + take]), n, pos // length, pos % length, q, w)):
                            cols[k].append(v)
                        done, pos, run = done + take, pos + take, run - take
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), kinds)], names=list(names))

    placed = encoded.join(base, ["source", "part"]).select("doc_id", "source", "n", (F.col("base") + F.col("within")).alias("at"), "ids")
    return placed.mapInArrow(lay, PIECES)
