"""Token counts that follow edits.

A document is cut into leaves at places where no pre-token can cross: before a white-space character that follows a
character of another kind. A binary tree over the leaves holds their token counts as subtree sums. An edit replaces
characters [start, end) of the current text; only the leaves that it touches are encoded again, with neighbours as
boundary context as long as an outer end is no safe place, and the sums on the paths to the root are updated. When an
edit needs more leaves than it touches, the tree is laid out anew from the other leaves' known counts: none of them is
encoded again. No added token of the tokenizer holds white space, so no cut goes through one.

Defined cases: null text is an empty text with no tokens; an edit with null fields changes nothing; start and end are
brought into the text, and start past end is an insertion at start; edits are applied in the order of seq, then start;
edits of unknown documents are ignored; rows that share a doc_id all get that document's edits; an empty table gives
no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithlink.llm.bpe import byte_bpe
from kithlink.llm.common import text_of

LEAF = 512
#: White space of the pre-token pattern that both libraries agree on.
_SAFE = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \t\n\r])")


class CountTree:
    def __init__(self, text: str, encode, leaf: int = LEAF):
        self.encode, self.leaf, self.encoded_chars = encode, leaf, 0
        leaves = self._cut(text)
        self._lay(leaves, [self._count(x) for x in leaves])

    def _count(self, text: str) -> int:
        self.encoded_chars += len(text)
        return len(self.encode(text)) if text else 0

    def _cut(self, text: str) -> list[str]:
        out, at = [], 0
        while len(text) - at > self.leaf:
            m = _SAFE.search(text, at + self.leaf)
            if not m:
                break
            out.append(text[at : m.start()])
            at = m.start()
        return [*out, text[at:]]

    def _lay(self, leaves: list[str], counts: list[int]) -> None:
        self.leaves = leaves
        self.size = 1 << max(0, len(leaves) - 1).bit_length()
        self.counts, self.lens = (np.zeros(2 * self.size, dtype=np.int64) for _ in range(2))
        for t, values in ((self.counts, counts), (self.lens, [len(x) for x in leaves])):
            t[self.size : self.size + len(leaves)] = values
            at = self.size
            while at > 1:
                t[at // 2 : at] = t[at : 2 * at : 2] + t[at + 1 : 2 * at : 2]
                at //= 2

    @property
    def total(self) -> int:
        return int(self.counts[1])

    @property
    def n_chars(self) -> int:
        return int(self.lens[1])

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def _find(self, pos: int) -> tuple[int, int]:
        """The leaf that holds character pos (the last one at the end) and pos in it."""
        i = 1
        while i < self.size:
            i *= 2
            if pos >= self.lens[i] and self.lens[i + 1]:
                pos, i = pos - int(self.lens[i]), i + 1
        return i - self.size, pos

    def _set(self, i: int, text: str, count: int) -> None:
        self.leaves[i] = text
        i += self.size
        self.counts[i], self.lens[i] = count, len(text)
        while i := i // 2:
            for t in (self.counts, self.lens):
                t[i] = t[2 * i] + t[2 * i + 1]

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace [start, end) and return the count of the whole text."""
        start = min(max(start, 0), self.n_chars)
        end = min(max(end, start), self.n_chars)
        (a, off_a), (b, off_b) = self._find(start), self._find(end)
        head, tail = self.leaves[a][:off_a], self.leaves[b][off_b:]
        region, last = head + new + tail, len(self.leaves) - 1
        while a > 0 and not self._safe(self._last(a), region[:1]):
            a -= 1
            region = self.leaves[a] + region
        while b < last and not self._safe(region[-1:], self._first(b)):
            b += 1
            region += self.leaves[b]
        parts = self._cut(region)
        if len(parts) > b - a + 1 and len(region) <= 8 * self.leaf * (b - a + 1):  # some longer leaves rather than another layout
            parts[b - a :] = ["".join(parts[b - a :])]
        if len(parts) > b - a + 1:
            known = self.counts[self.size : self.size + len(self.leaves)].tolist()
            self._lay([*self.leaves[:a], *parts, *self.leaves[b + 1 :]], [*known[:a], *(self._count(x) for x in parts), *known[b + 1 :]])
            return self.total
        for k in range(b - a + 1):
            x = parts[k] if k < len(parts) else ""
            if x != self.leaves[a + k]:
                self._set(a + k, x, self._count(x))
        return self.total

    @staticmethod
    def _safe(left: str, right: str) -> bool:
        return bool(left and right and _SAFE.search(left + right))

    def _last(self, a: int) -> str:
        """The last character before leaf a; leaves may have been emptied."""
        return next((self.leaves[k][-1] for k in range(a - 1, -1, -1) if self.leaves[k]), "")

    def _first(self, b: int) -> str:
        return next((x[0] for x in self.leaves[b + 1 :] if x), "")


COUNTS = "doc_id long, n_tokens long, n_tokens_edited long, n_edits int, n_chars_edited long, n_chars_reencoded long"


def edit_counts(docs: DataFrame, edits: DataFrame | None = None, *, derive=None, folder: str | None = None, leaf: int = LEAF) -> DataFrame:
    """Counts before and after the edits. edits (doc_id, seq, start, end, new), or derive(text) -> [(start, end, new)]."""

    def run(batches):
        bpe = byte_bpe(folder)
        for b in batches:
            rows = []
            for doc_id, held, *given in zip(*b.columns):  # a text at a time
                doc_id, text, given = doc_id.as_py(), held.as_py(), [x.as_py() for x in given]
                tree = CountTree(text, bpe.encode, leaf)
                before, tree.encoded_chars, n = tree.total, 0, 0
                todo = derive(text) if derive else [(e["start"], e["end"], e["new"]) for e in given[0] or []]
                for s, e, new in todo:
                    if s is not None and e is not None and new is not None:
                        tree.edit(s, e, new)
                        n += 1
                rows.append((doc_id, before, tree.total, n, tree.n_chars, tree.encoded_chars))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in COUNTS.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    if edits is not None:
        e = edits.where("doc_id is not null").select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.struct(F.col("seq").cast("long").alias("seq"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("new").cast("string").alias("new")).alias("e"),
        )
        rows = rows.join(e.groupBy("doc_id").agg(F.sort_array(F.collect_list("e")).alias("edits")), "doc_id", "left")
    return rows.mapInArrow(run, COUNTS)


#: The cleaning edits of op9: runs of digits masked, runs of white space narrowed, both from the end backwards so that places stay right.
_CLEAN = re.compile(r"[0-9]{4,}|[ \t]{2,}")


def cleaning_edits(text: str) -> list[tuple[int, int, str]]:
    """A header put in front, then every long number masked and every run of blanks narrowed to one, from the end backwards."""
    found = [(m.start(), m.end(), " " if m[0][0] in " \t" else "[number]") for m in _CLEAN.finditer(text)]
    middle = len(text) // 2
    return [*reversed(found), (0, 0, "Document.\n"), (middle, middle + 16, "")]
