"""Byte-level BPE ids, as the tokenizers library gives them by its plain call with add_special_tokens=False.

That call adds no ids of its own, but reads the file's added tokens in a text, as <|endoftext|>, as those tokens. Their
ids come from the file; the texts between them are encoded each by itself, as the library does.

tiktoken holds the same vocabulary as ranks and is about five times as fast. Both libraries split by the same
pattern; they may differ where their Unicode tables do, so only texts of the scripts below U+0530, whose classes
are old, take tiktoken. All other texts, and any that tiktoken gives up on, take the tokenizers library.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re
import zlib

import numpy as np

_BEYOND = re.compile("[^\x00-ԯ]")
#: Longer runs of white space are left to the tokenizers library: tiktoken backtracks over them.
_LONG_RUN = re.compile(r"\s{2000}")


class ByteBPE:
    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken

        self.json_path, self._tokenizer = json_path, None
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(json_path, encoding="utf-8") as f:
            added = json.load(f).get("added_tokens") or []
        self.added = {t["content"]: t["id"] for t in added}
        #: Tokens that also take blanks or ask for word ends are left to the library.
        self.plain = not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        self._added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        self._encode = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _library(self, text: str) -> list[int]:
        if self._tokenizer is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.json_path)
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> list[int]:
        if self._added is None or not self._added.search(text):
            return self._between(text)
        if not self.plain:
            return self._library(text)
        out: list[int] = []
        for i, x in enumerate(self._added.split(text)):
            out += [self.added[x]] if i % 2 else self._between(x) if x else ()
        return out

    def _between(self, text: str) -> list[int]:
        if (not text.isascii() and _BEYOND.search(text)) or _LONG_RUN.search(text):
            return self._library(text)
        return self._encode(text)

    def encode_array(self, text: str | None, end_id: int | None = None) -> np.ndarray:
        ids = self.encode(text) if text else []
        out = np.empty(len(ids) + (end_id is not None), dtype="<u4")
        out[: len(ids)] = ids
        if end_id is not None:
            out[-1] = end_id
        return out


@functools.cache
def byte_bpe(folder: str | None = None) -> ByteBPE:
    """One per Python worker. folder holds the vocabulary files; unset: that of public_tokenizers."""
    import public_tokenizers as P

    at = (lambda n: os.path.join(folder, n)) if folder else P.path
    return ByteBPE(at("byte_bpe_50k.json"), at("byte_bpe_50k.tiktoken"), P.PATTERN)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
