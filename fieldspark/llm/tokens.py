"""Ids of whole texts by the tokenizers library, with the ids of pieces that no merge crosses kept in memory.

The vocabularies split a text by a pattern before any merge, so the ids of a text are those of its pieces one after
the other.  A piece is encoded by the library once, and its ids are reused; a text with characters for which the
pieces are not certain (outside Latin letters, odd white space, special tokens) is encoded by the library as a whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer, pre_tokenizers  # noqa: E402

#: Pieces a worker keeps, and characters of texts that are looked up together.
KEPT_PIECES, BATCH_CHARS = 600_000, 1 << 20
#: Only such characters have the same classes in Python's and in the tokenizers' patterns for sure.
_PLAIN = re.compile(r"[\x09-\x0d\x20-\x7e\xa1-\xac\xae-įı-ňŊ-ž]*")
_SPACED = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Fixed value: the pattern of byte-level vocabularies.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        #: Lower-case words without the spaces between them, or byte-level pieces with the space in front.
        self.words = self.library.normalizer is not None
        steps = json.loads(self.library.to_str())["pre_tokenizer"].get("pretokenizers", [])
        own = [s["pattern"]["Regex"] for s in steps if s["type"] == "Split"]
        self.pattern = regex.compile(own[0] if own else _BYTE_LEVEL)
        # The same merges on pieces that are split already.
        self.merges = Tokenizer(self.library.model)
        self.merges.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.known: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The worker's encoder for this file, with what it knows from earlier tasks."""
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_all(self, texts) -> Iterator[bytes]:
        """The ids of each text, in order."""
        group, size = [], 0
        for t in texts:
            group.append(t or "")
            size += len(group[-1])
            if size >= BATCH_CHARS:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        plain = [bool(_PLAIN.fullmatch(t)) and not any(s in t for s in self.special) for t in texts]
        cut = [
            (t.lower().split() if self.words else _SPACED.findall(t)) if p else [] for t, p in zip(texts, plain, strict=True)
        ]
        if len(self.known) > KEPT_PIECES:
            # The first ones met are the frequent ones.
            self.known = dict(list(self.known.items())[: KEPT_PIECES // 2])
        self._learn([c for c in dict.fromkeys(c for cs in cut for c in cs) if c not in self.known])
        known = self.known
        for t, p, chunks in zip(texts, plain, cut, strict=True):
            yield b"".join([known[c] for c in chunks]) if p else self.whole(t)

    def _learn(self, chunks: list[str]) -> None:
        known = self.known
        pieces = {c: self.pattern.findall(c) for c in chunks}
        new = [p for p in dict.fromkeys(p for ps in pieces.values() for p in ps) if p not in known]
        for p, e in zip(new, self.merges.encode_batch_fast(new, add_special_tokens=False), strict=True):
            known[p] = np.array(e.ids, "<u4").tobytes()
        for c, ps in pieces.items():
            if c not in known:
                known[c] = b"".join([known[p] for p in ps])
