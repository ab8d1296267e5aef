"""SentencePiece encoding that keeps the place of every piece in the original bytes.

Normalisation follows the model's own specification: at each place the longest key of the compiled character map
(a double array over UTF-8 bytes) is replaced, other characters stand as they are; white space is then collapsed,
escaped and given a leading mark as the specification says. While it normalises, it records for every normalised byte
the original byte it came from. The library gives the ids of the whole text; the pieces' normalised lengths are
summed up, and both ends of each piece are projected to original bytes through the recorded alignment.

Runs that no key of the map can begin in are copied at once, as their alignment is the identity with an offset.

Defined cases: null text is an empty text (begin and end id alone); repeated rows stay; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithlink.llm.common import text_of

MARK = "▁".encode()


def _fields(b: bytes):
    def varint(i):
        r = s = 0
        while True:
            x = b[i]
            i, r, s = i + 1, r | (x & 127) << s, s + 7
            if x < 128:
                return r, i

    i = 0
    while i < len(b):
        k, i = varint(i)
        if k & 7 == 0:
            v, i = varint(i)
        elif k & 7 == 2:
            n, i = varint(i)
            v, i = b[i : i + n], i + n
        else:
            n = 8 if k & 7 == 1 else 4
            v, i = b[i : i + n], i + n
        yield k >> 3, v


class CharMap:
    """The compiled character map: size, double array of 32-bit units, then the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + n], dtype="<u4").tolist() if blob else []
        self.values = blob[4 + n :]
        self.first = [bool(self.units) and self._step(0, b) is not None for b in range(256)]

    def _step(self, node: int, byte: int) -> int | None:
        u = self.units[node]
        at = node ^ ((u >> 10) << ((u & (1 << 9)) >> 6)) ^ byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else None

    def longest(self, b: bytes, i: int) -> tuple[int, bytes] | None:
        """Bytes that the longest key at b[i:] takes, and its replacement."""
        found, node, k = None, 0, i
        while k < len(b) and (node := self._step(node, b[k])) is not None:
            k += 1
            u = self.units[node]
            if u >> 8 & 1:
                v = self.units[node ^ ((u >> 10) << ((u & (1 << 9)) >> 6))] & 0x7FFFFFFF
                found = k - i, self.values[v : self.values.index(b"\0", v)]
        return found


class Model:
    def __init__(self, data: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        pieces, norm, trainer = [], {}, {}
        for f, v in _fields(data):
            if f == 1:
                pieces.append(dict(_fields(v)))
            elif f == 2:
                trainer = dict(_fields(v))
            elif f == 3:
                norm = dict(_fields(v))
        self.map = CharMap(norm.get(2, b""))
        self.dummy, self.squeeze, self.escape = bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1))
        self.suffix = bool(trainer.get(24, 0))
        # Control pieces take no bytes, byte pieces one, the unknown piece what is left over.
        self.sizes = np.array([{3: 0, 6: 1, 2: -1}.get(p.get(3, 1), len(p[1])) for p in pieces], dtype=np.int64)

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each (and for their end) the original byte."""
        raw = text.encode()
        if self.map.units or self.squeeze:
            out, at = self._mapped(raw)
        else:
            out, at = raw, np.arange(len(raw) + 1, dtype=np.int64)
        if not out:
            return b"", np.zeros(1, dtype=np.int64)
        space = MARK if self.escape else b" "
        if self.escape and b" " in out:
            is_space = np.frombuffer(out, dtype=np.uint8) == 32
            at = np.append(np.repeat(at[:-1], np.where(is_space, len(MARK), 1)), at[-1])
            out = out.replace(b" ", MARK)
        if self.dummy:
            if self.suffix:
                out, at = out + space, np.append(at, [at[-1]] * len(space))
            else:
                out, at = space + out, np.append([at[0]] * len(space), at)
        return out, at

    def _mapped(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        parts: list[tuple[bytes, int]] = []  # bytes, original place
        i, m = 0, self.map
        while i < len(raw):
            hit = m.longest(raw, i) if m.first[raw[i]] else None
            if hit:
                n, new = hit
            else:
                n = 1 if raw[i] < 0x80 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
                new = raw[i : i + n]
            parts.append((new, i))
            i += n
        if self.squeeze:
            kept, last = [], b" "
            for new, i in parts:
                while last.endswith(b" ") and new.startswith(b" "):
                    new = new[1:]
                if new:
                    kept.append((new, i))
                    last = new
            while kept and kept[-1][0].endswith(b" "):
                new, i = kept.pop()
                if new := new.rstrip(b" "):
                    kept.append((new, i))
            end = kept[-1][1] + len(kept[-1][0]) if kept else 0
            parts = kept
        else:
            end = len(raw)
        at = np.repeat(np.array([i for _, i in parts], dtype=np.int64), [len(n) for n, _ in parts])
        out = b"".join(n for n, _ in parts)
        # A character that stands as it is keeps one place for all of its bytes, as a piece never begins inside it.
        return out, np.append(at, end)

    def spans(self, text: str, ids: np.ndarray) -> np.ndarray:
        """(pieces, 2): first and end byte in the original text."""
        out, at = self.normalise(text)
        sizes = self.sizes[ids]
        if (unknown := sizes < 0).any():
            sizes = self._unknown(out, ids, sizes, unknown)
        ends = np.cumsum(sizes)
        if len(ends) and ends[-1] != len(out):
            raise ValueError("the pieces don't cover the normalised text")
        return np.stack([at[ends - sizes], at[ends]], axis=1)

    def _unknown(self, out: bytes, ids, sizes, unknown) -> np.ndarray:
        sizes, at = sizes.copy(), 0
        for k, i in enumerate(ids.tolist()):
            if unknown[k]:  # up to where the next known piece begins
                nxt = next((self.library.id_to_piece(j).encode() for j in ids[k + 1 :].tolist() if self.sizes[j] > 0), None)
                sizes[k] = (out.index(nxt, at + 1) if nxt else len(out)) - at
            at += sizes[k]
        return sizes


@functools.cache
def model(path: str | None = None) -> Model:
    import public_tokenizers as P

    with open(path or P.path("piece_bpe_32k.model"), "rb") as f:
        return Model(f.read())


ENCODED = "doc_id long, ids array<int>, span_starts array<int>, span_ends array<int>, decoded string"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, spans_sha256 string"


def encode_documents(docs: DataFrame, path: str | None = None, digest: bool = False) -> DataFrame:
    """ids with begin and end, original byte spans, and the text that decode(ids) gives; digest: their hashes only."""

    def run(batches):
        m = model(path)
        for b in batches:
            names = [x.split()[0] for x in (DIGEST if digest else ENCODED).split(", ")]
            cols: list[list] = [[] for _ in names]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py() or ""
                listed = m.library.encode(text, add_bos=True, add_eos=True)
                ids = np.array(listed, dtype="<u4")
                spans = m.spans(text, ids)
                back = m.library.decode(listed)
                if digest:
                    new = len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), int((spans[:, 1].max() if len(spans) else 0)), hashlib.sha256(spans.astype("<u4").tobytes()).hexdigest()
                else:
                    new = listed, spans[:, 0].tolist(), spans[:, 1].tolist(), back
                for c, v in zip(cols, (doc_id, *new)):
                    c.append(v)
            if digest:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            else:
                kinds = [pa.int64(), *[pa.list_(pa.int32())] * 3, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, DIGEST if digest else ENCODED)
