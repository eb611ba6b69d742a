"""Ids of the word-level BPE tokenizer, with one look-up per word.

The tokenizer drops white space and never joins across it, so a text's ids are
those of its white-space-separated chunks. Each chunk's ids are computed once
and kept (``MOST`` chunks at most, then the memory is emptied). A chunk of
Latin letters, digits and marks is split by the tokenizer's own pattern and its
pieces merged by tiktoken with the same vocabulary and merge order; any other
chunk, and any text with a special token's string or a separator on which the
two white-space sets differ, goes to the tokenizers library itself.
"""

from __future__ import annotations

import json

import numpy as np
import regex

#: Fixed value: the tokenizer's pattern.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_END = b"\xff"  # stands for the end of a word; no UTF-8 text has this byte
MOST = 300_000


def _byte_of() -> dict[str, int]:
    """Byte-level BPE's printable stand-ins for bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class WordBpe(dict):
    """Maps a chunk to its ids as little-endian uint32 bytes."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = [t["content"] for t in model["added_tokens"]]
        vocab, to_byte = model["model"]["vocab"], _byte_of()

        def raw(token: str) -> bytes:
            end = token.endswith("</w>")
            return bytes(to_byte[c] for c in (token[:-4] if end else token)) + (_END if end else b"")

        ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + _END: 256 + b for b in range(256)}
        ids = np.zeros(512 + len(model["model"]["merges"]), "<u4")
        for k, m in enumerate(model["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            ranks[raw(a + b)] = 512 + k
        for token, i in vocab.items():
            if token not in special:
                ids[ranks[raw(token)]] = i
        self._ids = [int(i).to_bytes(4, "little") for i in ids]
        self._merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self._odd = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isascii() or max(chunk) < "ɐ":
            low = chunk.lower()
            pieces = [low] if low.isalpha() else _PIECES.findall(low)
            out = b"".join([self._ids[i] for p in pieces for i in self._merge(p.encode() + _END)])
        else:
            out = self._library(chunk)
        if len(self) >= MOST:
            self.clear()
        self[chunk] = out
        return out

    def encode(self, text: str) -> bytes:
        """All ids of ``text``, without special tokens added, as little-endian uint32."""
        if any(x in text for x in self._odd):
            return self._library(text)
        return b"".join(map(self.__getitem__, text.split()))
