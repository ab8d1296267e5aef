"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The labelled examples are a bounded sample (`SAMPLE` rows, drawn by a hash, about that many), of which about `INDEXED` are
indexed: up to half of them toxic, the others clean, each standing for as many as were drawn for it. A text's vector holds
all its words that any indexed example has, by (1 + ln tf) * idf and scaled to length 1, and beside them with the weight
`EXTRA` its marks, scaled alike. Marks are terms whose spread over the sample's labels is far from chance: words, their
beginnings of 3 to 6 letters, so that inflected and compounded words meet, and each of these again at every rate
(`RATES`) that it reaches in the text, so that a chance hit in a long text isn't taken for a frequent word. So texts
with marks are nearest to examples with the same, and texts without any to those with the same words.

The index holds postings by term, ordered by block of examples, and the largest weight of each term in each block. The
blocks of largest upper bound are scored first, then all whose bound reaches the k best found, so the neighbours are
exact. Their votes, weighted by closeness, are calibrated by monotone regression on votes for each example by the others,
between whose steps, 0 and 1 scores are interpolated.

Cost: the index has about INDEXED examples whatever the corpus, and is all that is broadcast.

Defined cases: null and empty texts, and those that share no word with an example, have no neighbours and the share of
toxic examples as their vote; without labelled rows the score is 0; null labels are no examples; a doc_id that `labels`
has twice counts once, as toxic if any of its rows is; rows that share a doc_id are scored each by itself; an empty table
gives no rows; other columns are ignored, or kept by `keep_clean`.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithlink.llm.common import give_back, materialise, text_of

SAMPLE, INDEXED, NEIGHBOURS, BLOCK, BEGINNINGS, EXTRA = 20_000, 4000, 15, 64, (3, 4, 5, 6), 2.0
#: Rows that `keep_clean` gives out at a time.
GIVEN = 1024
#: Terms of more than one in so many examples have dense rows.
DENSE = 8
#: Examples that a term needs to be tried as a mark: with fewer, none can be told from chance.
TRIED = 4
#: A term found twice or more, and once in so many words, counts again as a term of that rate.
RATES = (256, 128, 64)
EDGES = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "«»“”„‘’…–—¿¡"


def word_terms(word: str) -> tuple[str, ...]:
    w = word.strip(EDGES)
    return (w, *(w[:n] + "*" for n in BEGINNINGS if len(w) > n)) if w else ()


def at_rate(term: str, words: int) -> str:
    return f"{term} {words}"  # no word holds a blank


class Terms:
    """From texts to counts of terms; the terms of a word are looked up once and remembered, up to a bound."""

    def __init__(self, vocabulary: dict[str, int] | None = None, remembered: int = 200_000):
        self.vocabulary, self.remembered, self.words = vocabulary, remembered, {}
        self.plain = None if vocabulary is None else {t.split(" ")[0] for t in vocabulary}
        self.starts = None if vocabulary is None else {t.rstrip("*")[: BEGINNINGS[0]] for t in self.plain}  # most words have none of these

    def of(self, word: str) -> tuple[str, ...]:
        if self.plain is None:
            return word_terms(word)
        w = word.strip(EDGES)
        return tuple(x for x in word_terms(w) if x in self.plain) if w[: BEGINNINGS[0]] in self.starts else ()

    def kept(self, counts: dict, words: int) -> dict:
        """counts of a text of so many words, with terms of rates, by what the vocabulary has for them."""
        out = counts | {at_rate(x, r): 1 for x, n in counts.items() if n > 1 for r in RATES if n * r >= words}
        v = self.vocabulary
        return out if v is None else {v[x]: n for x, n in out.items() if x in v}

    def counts(self, text: str) -> dict:
        return self.of_words(Counter(text.lower().split()))

    def of_words(self, words: Counter) -> dict:
        out: dict = {}
        known = self.words
        for w, n in words.items():
            t = known.get(w)
            if t is None:
                if len(known) >= self.remembered:
                    known.clear()
                t = known[w] = self.of(w)
            for x in t:
                out[x] = out.get(x, 0) + n
        return self.kept(out, words.total())


def _llr(n_bad: int, n_good: int):
    """Log-likelihood ratio, as a column, of a term held by `bad` of n_bad and `good` of n_good examples."""
    n, k = n_bad + n_good, F.col("bad") + F.col("good")

    def part(x, e):
        return F.when(x > 0, x * F.log(x / e)).otherwise(0.0)

    return 2 * (part(F.col("bad"), k * n_bad / n) + part(F.col("good"), k * n_good / n) + part(n_bad - F.col("bad"), (n - k) * n_bad / n) + part(n_good - F.col("good"), (n - k) * n_good / n))


def word_hash(word: str) -> int | None:
    """What stands for a word in the vectors; none for marks of punctuation alone."""
    w = word.strip(EDGES)
    return xxhash.xxh64_intdigest(w) >> 1 if w else None


class Index:
    """Examples as unit vectors in blocks. vectors: (ids, weights) by example; weigh: how many each stands for."""

    def __init__(self, vectors, labels, names, n_terms: int, block: int = BLOCK, weigh=None):
        lead = [int(v[0][np.argmax(v[1])]) if len(v[0]) else -1 for v in vectors]
        self.order = order = sorted(range(len(vectors)), key=lambda i: (lead[i], i))  # alike examples share blocks
        self.vectors = [vectors[i] for i in order]
        self.labels = np.array([labels[i] for i in order], dtype=float)
        self.weigh = np.array([weigh[i] if weigh is not None else 1.0 for i in order], dtype=float)
        self.names = [names[i] for i in order]
        self.block, self.n = block, len(order)
        self.blocks = max(1, -(-self.n // block))
        terms = np.concatenate([v[0] for v in self.vectors] or [np.zeros(0, int)]).astype(np.int32)
        docs = np.repeat(np.arange(self.n, dtype=np.int32), [len(v[0]) for v in self.vectors])
        weights = np.concatenate([v[1] for v in self.vectors] or [np.zeros(0)]).astype(float)
        # Terms of very many examples have a row with a place for each: as exact as postings, and read without places.
        df = np.bincount(terms, minlength=n_terms)
        frequent = np.flatnonzero(df * DENSE > self.n)
        self.row = np.full(n_terms, -1, dtype=np.int32)
        self.row[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), self.n))
        there = self.row[terms] >= 0
        self.dense[self.row[terms[there]], docs[there]] = weights[there]
        terms, docs, weights = terms[~there], docs[~there], weights[~there]
        by = np.argsort(terms, kind="stable")  # docs ascend already
        self.docs, self.weights, terms = docs[by], weights[by], terms[by]
        del by, docs, weights, there
        # Runs of one term in one block: where they begin in the postings, and the largest weight in them.
        run = terms.astype(np.int64) * self.blocks + self.docs // block
        first = np.flatnonzero(np.r_[len(run) > 0, run[1:] != run[:-1]]) if len(run) else np.zeros(0, np.int64)
        self.run_at = np.append(first, len(run)).astype(np.int64)
        self.run_block = (run[first] % self.blocks).astype(np.int32)
        self.run_most = np.maximum.reduceat(self.weights, first) if len(first) else np.zeros(0)
        self.term_at = np.searchsorted(terms[first], np.arange(n_terms + 1))

    @staticmethod
    def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """All places of the ranges of n from start."""
        ends = np.cumsum(n)
        return np.repeat(start - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)

    def _scores(self, runs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        start = self.run_at[runs]
        n = self.run_at[runs + 1] - start
        held = self._spread(start, n)
        return np.bincount(self.docs[held], np.repeat(weights, n) * self.weights[held], self.n)

    def nearest(self, ids: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest positive cosine; ties go to earlier examples."""
        rows = self.row[ids]
        dense = rows >= 0
        scores = weights[dense] @ self.dense[rows[dense]]  # these rows alone: the whole of it doesn't stay in a core's cache
        if without >= 0:
            scores[without] = 0.0
        ids, weights = ids[~dense], weights[~dense]
        start = self.term_at[ids]
        n = self.term_at[ids + 1] - start
        runs, w = self._spread(start, n), np.repeat(weights, n)
        if self.n:
            at = self.run_block[runs]
            bound = np.bincount(at, w * self.run_most[runs], self.blocks) + np.maximum.reduceat(scores, np.arange(0, self.n, self.block))
            # The blocks of largest bound, some more than k examples, set the floor that other blocks have to reach.
            seeds = min(self.blocks, 2 + k // self.block)
            whole = np.zeros(self.blocks, bool)
            whole[np.argpartition(-bound, seeds - 1)[:seeds]] = True
            mine = whole[at]
            scores += self._scores(runs[mine], w[mine])
            if without >= 0:
                scores[without] = 0.0
            done = scores[np.repeat(whole, self.block)[: self.n]]
            floor = np.partition(done, len(done) - k)[len(done) - k] - 1e-9 if len(done) > k else 0.0
            more = ~whole & (bound > 0) & (bound >= floor)
            if more.any():
                mine = more[at]
                scores += self._scores(runs[mine], w[mine])
                if without >= 0:
                    scores[without] = 0.0
            scores[~np.repeat(whole | more, self.block)[: self.n]] = 0.0
            hit = np.flatnonzero(scores > max(floor, 0.0))
        else:
            hit = np.zeros(0, np.int64)
        scores = np.round(scores[hit], 12)
        top = np.lexsort((hit, -scores))[:k]
        return hit[top], scores[top]


def monotone(x: np.ndarray, y: np.ndarray, weigh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Monotone regression of y on x by pooling: (mean x, mean y) of the pools, drawn a little to the mean of all."""
    values, which = np.unique(x, return_inverse=True)
    sums, ns = np.bincount(which, weigh * y, len(values)), np.bincount(which, weigh, len(values))
    pools: list[list[float]] = []
    for at, b, n in zip(values.tolist(), sums.tolist(), ns.tolist()):
        pools.append([n * at, b, n])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last)]
    mean = float((y * weigh).sum() / weigh.sum()) if len(y) else 0.0
    return np.array([p[0] / p[2] for p in pools]), np.array([(p[1] + 0.5 * mean) / (p[2] + 0.5) for p in pools])


def held(counts) -> tuple[np.ndarray, np.ndarray]:
    """Keys, ascending, and their counts; counts: a dict, or two arrays, which take a tenth of its memory."""
    keys, n = (list(counts), list(counts.values())) if isinstance(counts, dict) else counts
    keys, n = np.asarray(keys, dtype=np.int64), np.asarray(n, dtype=np.int32)
    by = np.argsort(keys)
    return keys[by], n[by]


def _ordered(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Compares as the list of (key, count) does; keys aren't negative."""
    return np.stack([keys, counts], axis=1).astype(">i8").tobytes()


class Scorer:
    """marks: the marks' names to ids, words: the words' hashes to the ids after these.

    Pickled, it is the examples' counts alone, some 6 bytes for each of their words; the index is built where it is used. Every
    Python worker holds one, so words are looked up in sorted arrays, and examples' vectors are made again when asked for."""

    def __init__(self, examples: list[tuple], marks: dict[str, int], k: int = NEIGHBOURS, extra: float = EXTRA):
        """examples: (name, label, how many it stands for, counts by mark, counts by word hash), counts as `held` gives them."""
        words: dict[int, int] = {}
        ids, counts = [], []
        for e in examples:
            (marked, n), (hashes, m) = held(e[3]), held(e[4])
            places = [words.setdefault(h, len(marks) + len(words)) for h in hashes.tolist()]
            known = np.array(places, dtype=np.int32)
            by = np.argsort(known)
            ids.append(np.concatenate([marked.astype(np.int32), known[by]]))
            counts.append(np.concatenate([n, m[by]]).astype(np.int32))
        self.__setstate__({
            "k": k, "extra": extra, "marks": marks, "hashes": np.fromiter(words, np.int64, len(words)),
            "lens": np.array([len(x) for x in ids], dtype=np.int32), "ids": np.concatenate(ids or [np.zeros(0, np.int32)]), "counts": np.concatenate(counts or [np.zeros(0, np.int32)]),
            "names": [e[0] for e in examples], "labels": [e[1] for e in examples], "weigh": [e[2] for e in examples],
        })

    def __getstate__(self) -> dict:
        return self.state

    def __setstate__(self, state: dict) -> None:
        self.state, self.k, self.extra, self.marks = state, state["k"], state["extra"], state["marks"]
        by = np.argsort(state["hashes"])
        self.hashes, self.places = state["hashes"][by], (len(self.marks) + by).astype(np.int32)
        n, terms = len(state["names"]), len(self.marks) + len(self.hashes)
        self.idf = np.log((1 + n) / (1 + np.bincount(state["ids"], minlength=terms))) + 1
        self.ends = np.cumsum(state["lens"], dtype=np.int64)
        weigh = np.array(state["weigh"], dtype=float)
        self.prior = float((np.array(state["labels"]) * weigh).sum() / weigh.sum()) if n else 0.0
        self.index = Index([self._example(i) for i in range(n)], state["labels"], state["names"], terms, weigh=weigh)
        del self.index.vectors
        give_back()

    @property
    def words(self) -> dict[int, int]:
        return dict(zip(self.hashes.tolist(), self.places.tolist()))

    def places_of(self, hashed: list[int | None]) -> list[int]:
        """The ids of words by their hashes, -1 if no example has them."""
        if not len(self.hashes):
            return [-1] * len(hashed)
        h = np.array([-1 if x is None else x for x in hashed], dtype=np.int64)  # hashes aren't negative
        at = np.minimum(self.hashes.searchsorted(h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.places[at], -1).tolist()

    def _example(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        x = slice(self.ends[i] - self.state["lens"][i], self.ends[i])
        return self._unit(self.state["ids"][x], self.state["counts"][x])

    def calibration(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where votes lie and the scores there. raw: the vote for each example of the index by the others."""
        if not len(raw):
            return np.zeros(1), np.array([self.prior])
        at, values = monotone(raw, self.index.labels, self.index.weigh)
        return np.r_[0.0, at, 1.0], np.r_[0.0, values, 1.0]

    def _unit(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids ascending: the marks, then the words."""
        w = (1 + np.log(counts)) * self.idf[ids]
        cut = int(np.searchsorted(ids, len(self.marks)))
        for part, weight in ((w[:cut], self.extra), (w[cut:], 1.0)):
            part *= weight / (math.sqrt(float(part @ part)) or 1.0)
        return ids, w / (math.sqrt(float(w @ w)) or 1.0)

    def vector(self, marks: dict[int, int], words: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        n = len(marks) + len(words)
        ids = np.fromiter((*marks, *words), np.int64, n)
        by = np.argsort(ids)
        return self._unit(ids[by], np.fromiter((*marks.values(), *words.values()), float, n)[by])

    def vote(self, ids: np.ndarray, weights: np.ndarray, without: int = -1) -> tuple[float, list]:
        d, s = self.index.nearest(ids, weights, self.k, without)
        if not len(d):
            return self.prior, []
        w = self.index.weigh[d] / (1.05 - np.minimum(s, 1.0))
        # The prior votes too, so that among texts without toxic neighbours those with closer ones score lower.
        return float(((w * self.index.labels[d]).sum() + self.prior) / (w.sum() + 1)), [self.index.names[i] for i in d[:3].tolist()]

    def vote_without(self, i: int) -> float:
        return self.vote(*self._example(self.index.order[i]), without=i)[0]


NOTHING = (-1, ())  # what a word stands for that is in no example and no mark


class Reader:
    """Scores texts; what a word stands for and what a text has come to are remembered, up to a bound, or for one text's words."""

    def __init__(self, model: tuple[Scorer, np.ndarray, np.ndarray], remembered: int = 100_000):
        self.scorer, self.at, self.values = model
        self.remembered, self.marks = remembered, Terms(self.scorer.marks, 0)
        self.of: dict[str, tuple[int, tuple[str, ...]]] = {}
        self.known: dict[int, tuple] = {}

    def counts(self, text: str) -> tuple[dict[int, int], dict[int, int]]:
        words, of, out, marked = Counter(text.lower().split()), self.of, {}, {}
        new = [w for w in words if w not in of]
        if len(of) + len(new) > self.remembered:
            of.clear()
            new = list(words)
        if new:
            for w, i in zip(new, self.scorer.places_of([word_hash(w) for w in new])):
                marks = self.marks.of(w)
                of[w] = (i, marks) if i >= 0 or marks else NOTHING
        for w, n in words.items():
            x = of[w]
            if x is not NOTHING:
                i, marks = x
                if i >= 0:
                    out[i] = out.get(i, 0) + n
                for m in marks:
                    marked[m] = marked.get(m, 0) + n
        return self.marks.kept(marked, words.total()) if marked else marked, out

    def score(self, text: str) -> tuple[float, list]:
        key = xxhash.xxh3_128_intdigest(text)
        if key not in self.known:
            if len(self.known) >= 20_000:
                self.known.clear()
            raw, evidence = self.scorer.vote(*self.scorer.vector(*self.counts(text)))
            self.known[key] = min(max(float(np.interp(raw, self.at, self.values)), 0.0), 1.0), evidence
        return self.known[key]


def train_labels(spark: SparkSession, sf_dir: str, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, toxic) of at most about `sample` labelled rows outside the held-out fold."""
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").where("doc_id is not null and toxic is not null")
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out())
    n = rows.count()
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    return rows


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, *, indexed: int = INDEXED):
    """A broadcast scorer and its calibration. docs (doc_id, text); labels (doc_id, toxic), bounded. Driver: the marks, and the
    counts of the indexed examples."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(labels), "doc_id")
    rows = materialise(rows.withColumn("toxic", (F.col("toxic") != 0).cast("int")), "toxicity-examples")

    def count(batches):
        seen = Terms(remembered=100_000)
        sums: dict[str, list[int]] = {}

        def out():
            a = list(sums)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array([sums[t][0] for t in a], pa.int64()), pa.array([sums[t][1] for t in a], pa.int64())], names=["term", "bad", "good"])

        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1).to_pylist()):
                for t in seen.counts(text.as_py()):
                    sums.setdefault(t, [0, 0])[0 if toxic else 1] += 1
            if len(sums) > 300_000:
                yield out()
                sums.clear()
        if sums:
            yield out()

    n_bad, n_good = (int(x or 0) for x in rows.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    terms = rows.select("text", "toxic").mapInArrow(count, "term string, bad long, good long")
    terms = terms.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(f"bad + good >= {TRIED}")
    terms = materialise(terms, "toxicity-terms")
    # The bar rises with the number of terms tried.
    bar, rate = 2 * math.log(max(terms.count(), 2)) + 4, max(n_bad, 1) / max(1, n_bad + n_good)
    marked = terms.where(F.col("bad") / (F.col("bad") + F.col("good")) > min(0.5, 2 * rate)).where(_llr(max(n_bad, 1), max(n_good, 1)) >= bar)
    marks = {t: i for i, t in enumerate(sorted(r["term"] for r in marked.select("term").collect()))}  # each needs several of SAMPLE rows

    take_bad = min(1.0, indexed / 2 / max(n_bad, 1))
    take_good = min(1.0, (indexed - take_bad * n_bad) / max(n_good, 1))
    drawn = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(1 << 30)) < F.when(F.col("toxic") == 1, take_bad).otherwise(take_good) * (1 << 30)

    def counts(batches):
        seen = Terms(marks)
        for b in batches:
            cs, ws = [], []
            for t in b.column(1):
                words = Counter(t.as_py().lower().split())
                cs.append(seen.of_words(words))
                hashed: dict = {}
                for w, n in words.items():
                    if (h := word_hash(w)) is not None:
                        hashed[h] = hashed.get(h, 0) + n
                ws.append(hashed)
            arrays = [pa.array([list(f(c)) for c in x], pa.list_(kind)) for x, kind in ((cs, pa.int64()), (ws, pa.int64())) for f in (dict.keys, dict.values)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *arrays], names=["doc_id", "toxic", "marks", "marked", "words", "counts"])

    examples = rows.where(drawn).select("doc_id", "text", "toxic").mapInArrow(counts, "doc_id long, toxic int, marks array<bigint>, marked array<bigint>, words array<bigint>, counts array<bigint>")
    got = examples.toArrow()  # about INDEXED rows
    stands = {1: 1 / take_bad, 0: 1 / take_good if take_good else 1.0}
    found = []
    for i in range(got.num_rows):
        name, toxic, *parts = (got.column(k)[i] for k in range(6))
        marked, words = (held([x.values.to_numpy() for x in parts[k : k + 2]]) for k in (0, 2))
        if len(words[0]):
            found.append((name.as_py(), toxic.as_py(), stands[toxic.as_py()], marked, words))
    found.sort(key=lambda e: (_ordered(*e[3]), _ordered(*e[4]), e[1], e[0]))  # ties are broken by what the texts hold
    scorer = Scorer(found, marks)
    del got, found
    shared = spark.sparkContext.broadcast(scorer)

    def votes(batches):
        s = shared.value
        for b in batches:
            at = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.vote_without(i) for i in at], pa.float64())], names=["id", "raw"])

    n = scorer.index.n
    raw = {r["id"]: r["raw"] for r in spark.range(0, n, 1, max(1, min(24, n // 100))).mapInArrow(votes, "id long, raw double").collect()}
    return shared, *scorer.calibration(np.array([raw[i] for i in range(n)]))


SCORES = "doc_id long, score double, predicted int, evidence array<bigint>"


def _scored(docs: DataFrame, shared, at: np.ndarray, values: np.ndarray) -> DataFrame:
    def run(batches):
        reader = Reader((shared.value, at, values))
        for b in batches:
            got = [reader.score(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([int(g[0] >= 0.5) for g in got], pa.int32()), pa.array([g[1] for g in got], pa.list_(pa.int64()))],
                names=["doc_id", "score", "predicted", "evidence"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, SCORES)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence): evidence are the nearest examples."""
    return _scored(docs, *fit(docs, labels)).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted", "evidence")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted to be toxic, with their own columns."""
    shared, at, values = fit(docs, labels)
    text = docs.columns.index("text")

    def run(batches):
        reader = Reader((shared.value, at, values))
        for b in batches:
            for first in range(0, b.num_rows, GIVEN):  # no second copy of a whole batch
                part = b.slice(first, GIVEN)
                yield part.filter(pa.array([reader.score(t.as_py() or "")[0] < 0.5 for t in part.column(text)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
