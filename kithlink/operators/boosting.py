"""Boosted trees of all folds in one barrier stage: Spark ML's GBTClassifier (logistic loss, variance, level by level, 32 bins) without
its job for each level of each tree.

Each task holds its share of the rows, binned, and the sums by node and bin that the driver asks for go over a socket; the driver adds them
up, chooses the splits and sends them back. While it works on one fold the tasks work on the next. A restarted stage trains from the
first tree again.

Features are laid together while their bins multiply to `JOINT` at most, so a row is met once for each such group, and of two children only
the smaller one is summed. Gradients are rounded to 1 / `UNIT`, so the sums are whole numbers, the same for any partitioning (up to 2^53).
Differences from GBTClassifier: bins come from all rows, by values rounded to 1 / `GRID`, instead of from about 10,000 sampled rows."""

from __future__ import annotations

import hmac
import secrets
import socket
import struct
import threading
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithlink.config import FEATURE_COLS, Config

BINS, JOINT, UNIT, GRID = 32, 1024, 2.0**20, 2.0**14
#: Rows that make one more task worth while, rows scored at once, bits of a count, seconds that a peer may take.
TASK, BATCH, BITS, WAIT = 1 << 14, 1 << 16, 26, 3600
HELLO = "<qq"


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """(features, rows) of FEATURE_COLS, nulls and NaN as 0."""
    return np.nan_to_num(np.stack([batch[c].to_numpy(zero_copy_only=False).astype(float) for c in FEATURE_COLS]), copy=False)


def find_edges(values: np.ndarray, weights: np.ndarray, most: int = BINS - 1) -> np.ndarray:
    """Between which of the sorted values a bin ends: after each if they are few, else where the weights so far come nearest to equal shares."""
    between = (values[1:] + values[:-1]) / 2
    if len(between) <= most:
        return between
    stride = weights.sum() / (most + 1)
    found, target, so_far = [], stride, np.cumsum(weights)
    for i in range(1, len(values)):
        if abs(so_far[i - 1] - target) < abs(so_far[i] - target):
            found.append(between[i - 1])
            target += stride
    return np.array(found)


def edges_of(rows: DataFrame) -> list[np.ndarray]:
    """The bins' ends of each feature. rows (FEATURE_COLS, weight)."""

    def run(batches):
        held: list[dict[int, int]] = [{} for _ in FEATURE_COLS]
        for b in batches:
            w = np.rint(b["weight"].to_numpy() * UNIT)
            for known, x in zip(held, matrix(b)):
                v, at = np.unique(np.rint(x * GRID).astype(np.int64), return_inverse=True)
                for k, n in zip(v.tolist(), np.bincount(at, w).astype(np.int64).tolist()):
                    known[k] = known.get(k, 0) + n
        for i, known in enumerate(held):
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(known), pa.int32()), pa.array(known, pa.int64()), pa.array(known.values(), pa.int64())], names=["feature", "value", "weight"])

    sums = rows.select(*FEATURE_COLS, "weight").mapInArrow(run, "feature int, value long, weight long")
    t = sums.groupBy("feature", "value").agg(F.sum("weight").alias("weight")).toArrow().sort_by([("feature", "ascending"), ("value", "ascending")])
    f, v, w = (t[c].to_numpy() for c in ("feature", "value", "weight"))
    return [find_edges(v[f == i] / GRID, w[f == i] / UNIT) for i in range(len(FEATURE_COLS))]


class Bins:
    """Features as bins, laid together in groups."""

    def __init__(self, edges: list[np.ndarray]):
        self.edges, self.sizes = edges, [len(e) + 1 for e in edges]
        self.groups: list[list[int]] = []
        self.width: list[int] = []
        for f in sorted(range(len(edges)), key=lambda f: -self.sizes[f]):
            g = next((g for g, n in enumerate(self.width) if n * self.sizes[f] <= JOINT), len(self.groups))
            if g == len(self.groups):
                self.groups.append([])
                self.width.append(1)
            self.groups[g].append(f)
            self.width[g] *= self.sizes[f]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        laid = np.concatenate([np.arange(self.starts[f], self.starts[f + 1]) for g in self.groups for f in g])
        self.back = np.argsort(laid)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(groups, rows) of features (features, rows)."""
        out = np.zeros((len(self.groups), x.shape[1]), np.uint16)
        for code, group in zip(out, self.groups):
            for f in group:
                code *= self.sizes[f]
                code += np.searchsorted(self.edges[f], x[f]).astype(np.uint16)
        return out

    def above(self, f: int, at: int) -> tuple[int, np.ndarray]:
        """The group of feature f, and of which of its codes the bin is above at."""
        g = next(g for g, group in enumerate(self.groups) if f in group)
        each = np.unravel_index(np.arange(self.width[g]), [self.sizes[x] for x in self.groups[g]])
        return g, each[self.groups[g].index(f)] > at

    def by_feature(self, sums: list[np.ndarray]) -> np.ndarray:
        """(k, bins of all features) of sums (k, codes) of each group."""

        def parts(x: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
            if len(sizes) == 1:
                return [x]
            h = len(sizes) // 2
            x = x.reshape(len(x), int(np.prod(sizes[:h])), -1)
            return parts(x.sum(2), sizes[:h]) + parts(x.sum(1), sizes[h:])

        return np.concatenate([p for x, group in zip(sums, self.groups) for p in parts(x, [self.sizes[f] for f in group])], 1)[:, self.back]


def coded(rows: DataFrame, bins: Bins) -> DataFrame:
    """(fold, is_match, weight, codes) of rows with FEATURE_COLS; codes: those of a row's groups, two bytes each."""

    def run(batches):
        for b in batches:
            codes = np.ascontiguousarray(bins.codes(matrix(b)).T)
            wide = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * codes.shape[1]), len(codes), [None, pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([b["fold"], b["is_match"], b["weight"], wide.cast(pa.binary())], names=["fold", "is_match", "weight", "codes"])

    return rows.select("fold", "is_match", "weight", *FEATURE_COLS).mapInArrow(run, "fold int, is_match int, weight double, codes binary")


@dataclass
class Trees:
    """A fold's model. Place 2^d - 1 + p of a tree is node p of depth d: the feature (-1: no split, rows go left) and the last bin on its
    left; values are of the leaves from left to right, gains of the places."""

    bins: Bins
    feature: np.ndarray
    at: np.ndarray
    gain: np.ndarray
    value: np.ndarray
    rate: float

    def importances(self) -> np.ndarray:
        split = self.feature >= 0
        out = np.bincount(self.feature[split], self.gain[split], len(FEATURE_COLS))
        return out / (out.sum() or 1.0)

    def margins(self, codes: np.ndarray) -> np.ndarray:
        """Of codes (groups, rows)."""
        codes, total = codes.astype(np.intp), np.zeros(codes.shape[1])
        depth = (self.value.shape[1] - 1).bit_length()
        lookup = {(f, a): self.bins.above(f, a) for f, a in {*zip(self.feature.ravel().tolist(), self.at.ravel().tolist())} if f >= 0}
        for t in range(len(self.value)):
            leaf = self._leaves(t, codes, depth, lookup)
            total += self.value[t].take(leaf) * (self.rate if t else 1.0)
        return total

    def _leaves(self, t: int, codes: np.ndarray, depth: int, lookup: dict) -> np.ndarray:
        places = [(k, int(f), int(a)) for k, (f, a) in enumerate(zip(self.feature[t], self.at[t])) if f >= 0]
        if depth > 5:
            leaf = np.zeros(codes.shape[1], np.intp)
            node = np.zeros(codes.shape[1], np.intp)
            for d in range(depth):
                right = np.zeros(len(node), bool)
                for k, f, a in places:
                    if (k + 1).bit_length() - 1 == d:
                        g, above = lookup[f, a]
                        rows = np.flatnonzero(node == k)
                        right[rows] = above[codes[g][rows]]
                node, leaf = 2 * node + 1 + right, 2 * leaf + right
            return leaf
        # The leaves that a group's code leaves open, as bits: a row's leaf is the lowest open in all groups.
        masks: dict[int, np.ndarray] = {}
        for k, f, a in places:
            d = (k + 1).bit_length() - 1
            half = 1 << (depth - d - 1)
            left = ((1 << half) - 1) << ((k + 1 - (1 << d)) * 2 * half)
            g, above = lookup[f, a]
            if g not in masks:
                masks[g] = np.full(self.bins.width[g], 0xFFFFFFFF, np.uint32)
            masks[g][above] &= np.uint32(~left & 0xFFFFFFFF)
        if not masks:
            return np.zeros(codes.shape[1], np.intp)
        open_ = None
        for g, m in masks.items():
            x = m.take(codes[g])
            open_ = x if open_ is None else np.bitwise_and(open_, x, out=open_)
        return LOWEST.take(((open_ & (~open_ + np.uint32(1))) * np.uint32(0x077CB531)) >> np.uint32(27))


#: From the upper five bits of a lone bit times the de Bruijn number to the bit's place.
LOWEST = np.zeros(32, np.intp)
LOWEST[[((1 << i) * 0x077CB531 & 0xFFFFFFFF) >> 27 for i in range(32)]] = np.arange(32)


def probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-2 * margin))


def _exactly(s: socket.socket, n: int) -> bytearray:
    out = bytearray(n)
    view = memoryview(out)
    while view:
        got = s.recv_into(view)
        if not got:
            raise ConnectionError("the peer has gone")
        view = view[got:]
    return out


def _receive(s: socket.socket) -> bytearray:
    return _exactly(s, struct.unpack("<q", _exactly(s, 8))[0])


def _send(s: socket.socket, body: bytes) -> None:
    s.sendall(struct.pack("<q", len(body)) + body)


def _small_first(chosen: np.ndarray) -> list[int]:
    """Of the nodes with a split, which child is summed."""
    return [int(side) for f, _, side in chosen if f >= 0]


class Share:
    """A task's rows, in order of folds. Of labels y (1, -1), weights by number."""

    def __init__(self, bins: Bins, cfg: Config, weights: list[float], codes, y, kind, fold):
        by = np.argsort(fold, kind="stable")
        if len(by) >= 1 << BITS:
            raise ValueError("a task can count 2^26 rows; give the stage more tasks")
        self.bins, self.cfg, self.codes, self.y = bins, cfg, np.ascontiguousarray(codes[:, by]), y[by].astype(float)
        kind = kind[by]
        self.w = np.array(weights)[kind] * UNIT
        # Counts of two weights stand in one float.
        self.packed = [np.where(kind == k, 1.0, 0.0) + np.where(kind == k + 1, 2.0**BITS, 0.0) for k in range(0, len(weights), 2)]
        self.kinds, self.ends = len(weights), np.searchsorted(fold[by], np.arange(cfg.n_folds + 1))

    def unpacked(self, x: np.ndarray) -> np.ndarray:
        """(k, words, bins) as (k, kinds, bins)."""
        high = np.floor(x / 2.0**BITS)
        return np.stack([x - high * 2.0**BITS, high], 2).reshape(len(x), -1, x.shape[2])[:, : self.kinds]

    def sums(self, parts: list, what: list[np.ndarray]) -> np.ndarray:
        """(parts, what, bins). parts: rows of each."""
        rows = parts[0] if len(parts) == 1 else np.concatenate(parts)
        what = [x[rows] if isinstance(rows, slice) else x.take(rows) for x in what]
        node = None if len(parts) == 1 else np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        out = []
        for code, width in zip(self.codes, self.bins.width):
            key = code[rows] if isinstance(rows, slice) else code.take(rows)
            if node is not None:
                key = node * width + key
            out.append(np.stack([np.bincount(key, x, len(parts) * width).reshape(len(parts), width) for x in what], 1).reshape(-1, width))
        return self.bins.by_feature(out).reshape(len(parts), len(what), -1)

    def counted(self, parts: list, what: list[np.ndarray]) -> np.ndarray:
        x = self.sums(parts, [*what, *self.packed])
        return np.concatenate([x[:, : len(what)], self.unpacked(x[:, len(what) :])], 1)

    def grow(self, i: int):
        """Yields the sums of fold i's next level, is sent (the trees' next splits, the leaves' values or none)."""
        n, depth = len(self.y), self.cfg.max_depth
        others = [s for s in (slice(0, self.ends[i]), slice(self.ends[i + 1], n)) if s.stop > s.start] or [slice(0, 0)]
        all_rows = np.concatenate([np.arange(s.start, s.stop) for s in others])
        margin, q = np.zeros(n), np.zeros(n)
        for t in range(self.cfg.trees):
            for s in others:
                y = self.y[s]
                q[s] = np.rint(self.w[s] * (4 * y / (1 + np.exp(2 * y * margin[s])) if t else y))
            met = sum((self.counted if t == 0 else self.sums)([s], [q]) for s in others)
            nodes, leaves = [(0, all_rows)], []
            for d in range(depth):
                chosen, values = yield met
                below = []
                for (p, rows), (f, at, _) in zip(nodes, chosen):
                    if f < 0:
                        leaves.append((p << (depth - d), rows))
                    else:
                        g, above = self.above(f, at)
                        right = above.take(self.codes[g].take(rows))
                        below += [(2 * p, rows[~right]), (2 * p + 1, rows[right])]
                nodes = below
                if values is not None:
                    break
                met = self.counted([nodes[2 * k + side][1] for k, side in enumerate(_small_first(chosen))], [q])
            for slot, rows in leaves + [(p << (depth - d - 1), rows) for p, rows in nodes]:
                margin[rows] += values[slot] * (self.cfg.learning_rate if t else 1.0)

    def above(self, f: int, at: int) -> tuple[int, np.ndarray]:
        if not hasattr(self, "_above"):
            self._above = {}
        if (f, at) not in self._above:
            self._above[f, at] = self.bins.above(f, at)
        return self._above[f, at]

    def follow(self, s: socket.socket) -> None:
        """Until all trees stand."""
        depth = self.cfg.max_depth
        folds = dict(enumerate(map(self.grow, range(self.cfg.n_folds))))
        for g in folds.values():
            _send(s, next(g).tobytes())
        while folds:
            for i, g in list(folds.items()):
                body = _receive(s)
                n = 8 * (1 << depth) if body[0] else 0
                chosen = np.frombuffer(body, np.int32, (len(body) - 1 - n) // 4, 1).reshape(-1, 3).tolist()
                values = np.frombuffer(body, float, 1 << depth, len(body) - n) if n else None
                try:
                    _send(s, g.send((chosen, values)).tobytes())
                except StopIteration:
                    del folds[i]


class Grower:
    """The driver's side of a fold: chooses the splits by the added sums, and keeps the trees."""

    def __init__(self, bins: Bins, cfg: Config, weights: list[float]):
        places = (cfg.trees, (1 << cfg.max_depth) - 1)
        self.bins, self.cfg, self.weights = bins, cfg, np.array(weights)
        self.trees = Trees(bins, np.full(places, -1, np.int32), np.zeros(places, np.int32), np.zeros(places), np.zeros((cfg.trees, 1 << cfg.max_depth)), cfg.learning_rate)
        self.of = np.repeat(np.arange(len(bins.sizes)), bins.sizes)
        self.last = np.zeros(len(self.of), bool)
        self.last[bins.starts[1:] - 1] = True

    def best(self, x: np.ndarray):
        """Of nodes (k, gradient and counts, bins): place of the best split or -1, its gain, sums of the left and of the whole."""
        run = np.concatenate([np.zeros((*x.shape[:2], 1)), np.cumsum(x, 2)], 2)
        left = run[:, :, 1:] - run[:, :, self.bins.starts[self.of]]
        whole = run[:, :, self.bins.starts[1]]
        right = whole[:, :, None] - left
        w = [np.einsum("c,kc...->k...", self.weights, s[:, 1:]) for s in (left, right, whole)]
        with np.errstate(divide="ignore", invalid="ignore"):
            score = left[:, 0] ** 2 / w[0] + right[:, 0] ** 2 / w[1]
            gain = score - (whole[:, 0] ** 2 / w[2])[:, None]
        few = (np.minimum(left[:, 1:].sum(1), right[:, 1:].sum(1)) < max(1, self.cfg.min_child)) | self.last | (np.minimum(w[0], w[1]) <= 0)
        gain[few | ~(gain > 1e-12 * score)] = 0  # rounding alone is no gain
        k, at = np.arange(len(x)), gain.argmax(1)
        return np.where(gain[k, at] > 0, at, -1), gain[k, at], left[k, :, at], whole

    def value(self, sums: np.ndarray) -> float:
        w = self.weights @ sums[1:]
        return float(sums[0] / w / UNIT) if w > 0 else 0.0

    def grow(self):
        """Yields the answer to the sums that it is sent."""
        depth, root, answer, t = self.cfg.max_depth, None, None, self.trees
        for k in range(self.cfg.trees):
            x = yield answer
            x = x.reshape(1, -1, len(self.of))
            if root is None:
                root = x[:, 1:]
            x, nodes = x if x.shape[1] > 1 else np.concatenate([x, root], 1), [0]
            for d in range(depth):
                at, gain, left, whole = self.best(x)
                chosen, below, parents = np.full((len(nodes), 3), -1, np.int32), [], []
                for j, p in enumerate(nodes):
                    if at[j] < 0:
                        t.value[k, p << (depth - d)] = self.value(whole[j])
                        continue
                    f = self.of[at[j]]
                    place = (1 << d) - 1 + p
                    t.feature[k, place], t.at[k, place], t.gain[k, place] = f, at[j] - self.bins.starts[f], gain[j]
                    right = whole[j] - left[j]
                    chosen[j] = f, at[j] - self.bins.starts[f], int(right[1:].sum() < left[j, 1:].sum())
                    for side, s in enumerate((left[j], right)):
                        below.append(2 * p + side)
                        if d == depth - 1:
                            t.value[k, below[-1]] = self.value(s)
                    parents.append(x[j])
                done = d == depth - 1 or not below
                answer = struct.pack("b", done) + chosen.tobytes() + (t.value[k].tobytes() if done else b"")
                if done:
                    break
                small = (yield answer).reshape(len(parents), -1, len(self.of))
                sides = _small_first(chosen)
                x, nodes = np.stack([s if side == which else parent - s for s, parent, which in zip(small, parents, sides) for side in (0, 1)]), below
        yield answer


def _lead(listener: socket.socket, secret: bytes, n: int, make, done: list) -> None:
    """Meets the n tasks of an attempt and leads them through all trees; anew with the next attempt's if one goes. done gets the trees, or what went wrong."""
    while not done:
        tasks: dict[int, socket.socket] = {}
        attempt = -1
        try:
            while len(tasks) < n:
                try:
                    s, _ = listener.accept()
                except TimeoutError:
                    continue
                s.settimeout(60)
                s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
                try:
                    hello = _exactly(s, 16 + len(secret))
                except OSError:
                    s.close()
                    continue
                s.settimeout(WAIT)
                which, of = struct.unpack_from(HELLO, hello)
                if not hmac.compare_digest(bytes(hello[16:]), secret) or of < attempt:
                    s.close()
                    continue
                if of > attempt:
                    for old in tasks.values():
                        old.close()
                    tasks, attempt = {}, of
                tasks[which] = s
            growers = make()
            folds = dict(enumerate(g.grow() for g in growers))
            for g in folds.values():
                next(g)
            left = [g.cfg.trees for g in growers]
            while folds:
                for i, g in list(folds.items()):
                    answer = g.send(sum(np.frombuffer(_receive(tasks[k]), float) for k in range(n)))
                    for s in tasks.values():
                        _send(s, answer)
                    left[i] -= answer[0]
                    if not left[i]:
                        del folds[i]
            done.append([g.trees for g in growers])
        except OSError:
            if listener.fileno() < 0:
                return
        except Exception as e:  # the tasks must not wait for a driver that has stopped
            done.append(e)
            listener.close()
        finally:
            for s in tasks.values():
                s.close()


def train(rows: DataFrame, bins: Bins, cfg: Config) -> list[Trees]:
    """A model for each fold, of the rows of the others. rows (fold, is_match, weight, codes as `Bins.codes` has them, row by row)."""
    spark = rows.sparkSession
    sizes = {(r["fold"], r["weight"]): r["n"] for r in rows.groupBy("fold", "weight").agg(F.count("*").alias("n")).collect()}
    total, weights = sum(sizes.values()), sorted({w for _, w in sizes})
    if not all(any(f != i for f, _ in sizes) for i in range(cfg.n_folds)):
        raise ValueError("a fold has no rows to train on")
    n = max(1, min(spark.sparkContext.defaultParallelism, -(-total // TASK)))
    groups, secret = len(bins.groups), secrets.token_bytes(32)
    conf = spark.sparkContext.getConf()
    host = conf.get("spark.driver.host")
    listener = socket.create_server((conf.get("spark.driver.bindAddress", host), 0), backlog=n)
    listener.settimeout(5)  # a closed one doesn't wake who waits
    port, done = listener.getsockname()[1], []

    def run(batches):
        from pyspark import BarrierTaskContext

        task, held = BarrierTaskContext.get(), [[], [], [], []]
        for b in batches:
            codes = np.frombuffer(b"".join(b["codes"].to_pylist()), np.uint16).reshape(-1, groups).T
            got = codes, b["is_match"].to_numpy() * 2 - 1, np.searchsorted(weights, b["weight"].to_numpy()), b["fold"].to_numpy()
            for h, x in zip(held, got):
                h.append(x)
        empty = np.zeros((groups, 0), np.uint16), *(np.zeros(0, np.intp) for _ in range(3))
        share = Share(bins, cfg, weights, *(np.concatenate([*h, e], -1) for h, e in zip(held, empty)))
        attempt = min(map(int, task.allGather(str(task.taskAttemptId()))))  # the same in the stage's tasks, higher in the next attempt's
        with socket.create_connection((host, port), WAIT) as s:
            s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
            s.sendall(struct.pack(HELLO, task.partitionId(), attempt) + secret)
            share.follow(s)
        yield pa.RecordBatch.from_arrays([pa.array([len(share.y)], pa.int64())], names=["n"])

    lead = threading.Thread(target=_lead, args=(listener, secret, n, lambda: [Grower(bins, cfg, weights) for _ in range(cfg.n_folds)], done), daemon=True)
    lead.start()
    try:
        rows.select("fold", "is_match", "weight", "codes").repartition(n).mapInArrow(run, "n long", barrier=True).collect()
        lead.join(WAIT)
    except Exception as e:
        raise (done[0] if done and isinstance(done[0], Exception) else e)
    finally:
        listener.close()
    return done[0]


def scored(rows: DataFrame, keep: list[str], models: list[Trees]) -> DataFrame:
    """keep and raw, the probability: of the model of the row's fold if fold is kept, else the mean over the models."""

    def out(held):
        b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        codes = models[0].bins.codes(matrix(b))
        if "fold" in keep:
            raw, fold = np.zeros(b.num_rows), b["fold"].to_numpy()
            for i, m in enumerate(models):
                raw[fold == i] = probability(m.margins(codes[:, fold == i]))
        else:
            raw = sum(probability(m.margins(codes)) for m in models) / len(models)
        return pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(raw)], names=[*keep, "raw"])

    def run(batches):
        held = []
        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= BATCH:
                yield out(held)
                held = []
        if held:
            yield out(held)

    rows = rows.select(*keep, *FEATURE_COLS)
    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[: len(keep)]) + ", raw double")
