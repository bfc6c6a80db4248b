"""Token ids by a public tokenizer file.

The vocabulary and merges are those of the tokenizer's JSON file. Where ids
follow the order of merges, as in byte-level BPE files, a vocabulary of ranks
says the same as the merges, and ``tiktoken`` applies it several times faster
than the file's own library with equal ids; other files, and texts that
``tiktoken`` can't split, go through ``tokenizers``. A special token's string in
a text is that token's id, as ``encode(text, add_special_tokens=False)`` reads it.
"""

from __future__ import annotations

import json
from functools import cached_property

import numpy as np
import public_tokenizers
import tiktoken

BYTE_BPE = "byte_bpe_50k.json"
_ENCODERS: dict[str, "Encoder"] = {}


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level BPE writes a byte as its Latin-1 character where that is printable, else as the next code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def merge_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """Token bytes and ids of a byte-level BPE file whose ids rise with its merges, and its added tokens; None for any other file."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    model, split = data["model"], data.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or data.get("normalizer"):
        return None
    vocabulary, byte = model["vocab"], _byte_of_symbol()
    merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if merged != sorted(merged):
        return None
    added = data.get("added_tokens", [])
    if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip")):
        return None
    special = {t["content"]: t["id"] for t in added}
    return {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if t not in special}, special


class Encoder:
    """Encodes texts to arrays of unsigned 32-bit ids."""

    def __init__(self, path: str):
        self._path = path
        found = self._fast_ids = merge_ranks(path)
        self._fast = found and tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=found[0], special_tokens=found[1])

    @cached_property
    def _slow(self):
        """The file's own library, loaded only where it is needed."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self._path)

    @cached_property
    def size(self) -> int:
        """One more than the largest id."""
        known = {**self._fast_ids[0], **self._fast_ids[1]} if self._fast_ids else self._slow.get_vocab(with_added_tokens=True)
        return max(known.values(), default=-1) + 1

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if self._fast:
            try:
                return self._fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # the splitter runs out of stack on runs of some hundred thousand blanks
                pass
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def ended(self, text: str | None, end: int = 0) -> np.ndarray:
        """The ids and the end id."""
        return np.append(self(text), np.uint32(end)).astype("<u4", copy=False)


def encoder(path: str | None = None) -> Encoder:
    """The process's encoder for ``path`` (by default the 50k byte-level BPE)."""
    path = path or public_tokenizers.path(BYTE_BPE)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
