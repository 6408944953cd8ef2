"""Whole-text encoding with a library tokenizer, split at safe boundaries and memoised by piece.

A BPE never merges across the cuts of its pre-tokenizer, so a text may be cut wherever that is sure to cut:

- byte-level files: before a single space or newline that stands between two characters which aren't white space;
  the piece after it begins with it.
- word files: at spaces and newlines, which their pre-tokenizer drops.
- both: between letters and the punctuation after them, apostrophes aside.

Each distinct piece goes through the tokenizer once as long as a worker remembers it, over the tasks it runs one after the
other; see shared_encoder: words straight to its BPE model, all others through the
whole tokenizer in batches balanced by bytes. Added special tokens hold no white space, so the library still finds them
inside a piece. Files whose normaliser, pre-tokenizer or added tokens differ from these two kinds go through the library
alone, whole texts in batches balanced by bytes.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Pieces whose normal form and pre-tokens are plain to see: letters, then perhaps punctuation.
_PLAIN = re.compile(r"(\n?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


@lru_cache
def known_kind(path: str) -> bool:
    """Whether the cuts hold for a tokenizer file: by its settings, not by its name; read once a worker."""
    with open(path, encoding="utf-8") as f:
        settings = json.load(f)
    model, normal, split = settings["model"], settings["normalizer"], settings["pre_tokenizer"] or {}
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges", "byte_fallback")):
        return False
    if settings.get("truncation") or settings.get("padding") or any(re.search(r"\s", t["content"]) or _PLAIN.fullmatch(t["content"]) or t["normalized"] for t in settings["added_tokens"]):
        return False
    if normal is None:
        return split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not model.get("end_of_word_suffix")
    steps, cuts = normal.get("normalizers", []), split.get("pretokenizers", [])
    if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != ["Split", "ByteLevel"]:
        return False
    pattern = cuts[0]["pattern"].get("Regex", "")
    return steps[1] == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "} and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and r"[\p{L}]+" in pattern and r"[^\s\p{L}\p{N}]+" in pattern and not cuts[1].get("use_regex", True)


class PieceEncoder:
    """Token ids of texts, as little-endian unsigned 32-bit integers, or their number."""

    def __init__(self, path: str, keep_ids: bool, max_pieces: int = 400_000, batch_bytes: int = 1 << 18, longest_kept: int = 256):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cut = Tokenizer.from_file(path), known_kind(path)
        self.spaced = bool(self.tokenizer.encode(" \n ", add_special_tokens=False).ids)
        self.keep_ids, self.max_pieces, self.batch_bytes, self.longest_kept = keep_ids, max_pieces, batch_bytes, longest_kept
        self.known: dict[str, bytes | int] = {"": b"" if keep_ids else 0}  # by piece, without the space before it
        self.marks: dict[str, bytes | int] = {"": self.known[""]}
        self.newline = self._whole("\n") if self.spaced else self.known[""]

    def _whole(self, text: str) -> bytes | int:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return _packed(ids) if self.keep_ids else len(ids)

    def pieces(self, text: str) -> tuple[str, list[str]]:
        """The first piece of a text and those that follow; a space before each of these isn't written."""
        if not self.spaced:
            return "", text.replace("\n", " ").split(" ")
        found = text.split()
        gaps = len(found) - 1
        # Every gap is one space or newline, and none stands at an end.
        if found and len(text) - sum(map(len, found)) == gaps and text.count(" ") + (lines := text.count("\n")) == gaps:
            if lines:
                found = text.replace("\n", " \n").split(" ")
            return found[0], found[1:]
        first, *rest = _SAFE.split(text)
        return first, rest

    def _learn(self, new: set[str]) -> None:
        known, rest = self.known, []
        plain, tokenize, space = _PLAIN.fullmatch, self.model_tokenize, _BYTE_LEVEL[32] if self.spaced else ""
        for piece in new:
            if not (m := plain(piece)):
                rest.append(piece)
                continue
            line, word, mark = m.groups()
            if mark not in self.marks:
                self.marks[mark] = self._whole(mark)
            got = known.get(word) if not line else None
            if got is None:
                # One pre-token, as the byte-level pre-tokenizer writes it.
                if not self.spaced:
                    word = word.lower()
                got = tokenize((space if not line else "") + (word if word.isascii() else "".join(map(_LETTER.__getitem__, word))))
                got = _packed([t.id for t in got]) if self.keep_ids else len(got)
            known[piece] = (self.newline + got if line else got) + self.marks[mark]
        rest.sort(key=len)
        at = 0
        while at < len(rest):
            size, to = 0, at
            while to < len(rest) and (to == at or size + len(rest[to]) < self.batch_bytes):
                size += len(rest[to]) + 8
                to += 1
            texts = [" " + p if self.spaced and p[0] != "\n" else p for p in rest[at:to]]
            for piece, e in zip(rest[at:to], self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                known[piece] = _packed(e.ids) if self.keep_ids else len(e.ids)
            at = to

    @property
    def model_tokenize(self):
        return self.tokenizer.model.tokenize

    def encode(self, texts: list[str]) -> Iterator[bytes | int]:
        """One result per text, in order. Texts are taken together, so pass about a megabyte at a time."""
        if not self.cut:
            for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
                yield _packed(e.ids) if self.keep_ids else len(e.ids)
            return
        if len(self.known) > self.max_pieces:  # short pieces are the common ones
            self.known = {p: v for p, v in self.known.items() if len(p) <= 6}
            if len(self.known) > self.max_pieces // 2:
                self.known = {"": self.marks[""]}
        cut, new = [], set()
        for t in texts:
            first, rest = self.pieces(t)
            values = list(map(self.known.get, rest))
            gaps = [k for k, v in enumerate(values) if v is None] if None in values else []
            new.update([rest[k] for k in gaps])
            cut.append((first, [rest[k] for k in gaps], gaps, values))
        self._learn(new)
        for first, missing, gaps, values in cut:
            for k, piece in zip(gaps, missing, strict=True):
                values[k] = self.known[piece]
            start = self._whole(first) if first else self.marks[""]
            yield start + b"".join(values) if self.keep_ids else start + sum(values)
        for piece in new:  # very long pieces aren't kept
            if len(piece) > self.longest_kept:
                del self.known[piece]

    def grouped(self, texts: list[str | None], group_bytes: int = 1 << 20) -> Iterator[bytes | int]:
        """As encode, with texts grouped by size; null is an empty text."""
        group, size = [], 0
        for t in texts:
            group.append(t or "")
            size += len(group[-1])
            if size >= group_bytes:
                yield from self.encode(group)
                group, size = [], 0
        if group:
            yield from self.encode(group)


_shared: dict[tuple[str, bool], PieceEncoder] = {}


def shared_encoder(path: str, keep_ids: bool) -> PieceEncoder:
    """This worker's encoder for a tokenizer file, with what it has learned in earlier tasks; only the latest file's is kept."""
    if (path, keep_ids) not in _shared:
        _shared.clear()
        _shared[path, keep_ids] = PieceEncoder(path, keep_ids)
    return _shared[path, keep_ids]


def forget() -> None:
    """Lets the encoder go: operators that don't tokenize ask for it before they start."""
    _shared.clear()


def _byte_level() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(256 + k) for k, b in enumerate(other)}


_BYTE_LEVEL = _byte_level()
#: The same for the letters of _PLAIN, as UTF-8.
_LETTER = {c: "".join(_BYTE_LEVEL.get(b, chr(b)) for b in c.encode()) for c in map(chr, range(0x100))}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)
