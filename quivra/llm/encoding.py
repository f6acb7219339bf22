"""Token ids of whole texts by the tokenizers library, as little-endian unsigned 32-bit integers.

A tokenizer whose pre-tokenizer always cuts at white space gives, for a text, the ids of its chunks in
order. So each chunk is encoded by the library once per worker and remembered; tests compare with whole texts."""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata

from quivra.llm.common import held

#: Python's \s has \x1c-\x1f beyond Unicode's White_Space; texts with one are encoded as a whole.
_ODD = re.compile("[\x1c-\x1f]")
#: The white-space rules of the byte-level pattern: a single space goes with the word behind it; of a longer run, the last character stands apart.
_BYTE_LEVEL = re.compile(r" ?\S+|\s+(?!\S)|\s")
#: Without these, each space and each line break of a text stands alone between words.
_RUNS = ("  ", " \n", "\n ", "\n\n")
_OTHER_SPACE = re.compile(r"[^\S \n]")
_LONG = 64


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ChunkEncoder:
    """encode(text) -> bytes of ids. At most max_chunks chunks are remembered."""

    def __init__(self, path: str, max_chunks: int = 1_500_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.max_chunks = Tokenizer.from_file(path), max_chunks
        self.model, self.table = self.tokenizer.model, _byte_chars()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.added = [x["content"] for x in spec.get("added_tokens") or []]
        self.kind = self._kind(spec)
        self.known: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    @staticmethod
    def _kind(spec: dict) -> str:
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
            return "bytes"
        parts = pre.get("pretokenizers") or []
        if any(x.get("type") == "Split" and x.get("behavior") == "Removed" and x.get("invert") for x in parts) and {x.get("type") for x in norm.get("normalizers") or []} <= {"NFC", "Replace", "Lowercase"}:
            return "words"
        return ""

    def whole(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        """A word of letters, with at most one mark behind it, goes straight to the library's model."""
        body, mark = (chunk, "") if chunk[-1:].isalpha() else (chunk[:-1], chunk[-1:])
        word = body[1:] if self.kind == "bytes" and body[:1] == " " else body
        if mark not in ("", ".", ",", ";", ":", "!", "?") or not word.isalpha():
            return self.whole(chunk)
        if self.kind == "words":
            if "Σ" in body or not unicodedata.is_normalized("NFC", body) or not (body := body.lower()).isalpha() or not unicodedata.is_normalized("NFC", body):
                return self.whole(chunk)
        if mark:
            return self._one(body) + self._one(mark)
        mapped = body.encode().decode("latin-1").translate(self.table)
        return self._packed([t.id for t in self.model.tokenize(mapped)])

    def _one(self, chunk: str) -> bytes:
        ids = self.known.get(chunk)
        if ids is None:
            ids = self.whole(chunk) if len(chunk) == 1 or not self.kind else self._chunk(chunk)
            if len(chunk) <= _LONG:
                if len(self.known) + len(self.spaced) >= self.max_chunks:
                    self.known.clear()
                    self.spaced.clear()
                self.known[chunk] = ids
        return ids

    def _spaced(self, word: str) -> bytes:
        """The ids of a space and what follows it up to the next space: lines stand apart."""
        first, *lines = word.split("\n")
        ids = self._chunk(" " + first) + b"".join(self._one("\n") + self._one(x) for x in lines)
        if len(word) <= _LONG:
            if len(self.known) + len(self.spaced) >= self.max_chunks:
                self.known.clear()
                self.spaced.clear()
            self.spaced[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not self.kind or _ODD.search(text) or any(x in text for x in self.added):
            return self.whole(text)
        if self.kind == "words":
            words = text.split()
            out = list(map(self.known.get, words))
            if None in out:
                out = [x if x is not None else self._one(w) for x, w in zip(out, words)]
            return b"".join(out)
        if any(x in text for x in _RUNS) or text[:1] in " \n" or text[-1:] in " \n" or _OTHER_SPACE.search(text):
            return b"".join(map(self._one, _BYTE_LEVEL.findall(text)))
        first, *words = text.split(" ")
        out = list(map(self.spaced.get, words))
        if None in out:
            out = [x if x is not None else self._spaced(w) for x, w in zip(out, words)]
        return b"".join([*((self._one("\n") if k else b"") + self._one(x) for k, x in enumerate(first.split("\n"))), *out])


def encoder(path: str, max_chunks: int = 1_500_000) -> ChunkEncoder:
    """One for each worker process and tokenizer file."""
    return held(("tokens", path, max_chunks), lambda: ChunkEncoder(path, max_chunks))
