"""Ids of the byte-level BPE vocabulary, batch by batch in Python workers.

The vocabulary file is the one of the ``tokenizers`` library. Its merges are run by tiktoken, which gives the same ids
several times faster; a text that holds the string of a special token goes through ``tokenizers`` itself, as only that
library knows how the file treats it.
"""

from __future__ import annotations

import json

import numpy as np

#: Fixed value: how the vocabulary splits texts before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def printable_bytes() -> dict[str, int]:
    """The characters that stand for bytes in a vocabulary file: visible Latin-1 as it is, the rest from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBPE:
    """Encoder of one worker."""

    def __init__(self, path: str):
        import tiktoken

        self.path, self.own = path, None
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        self.special = [t["content"] for t in data["added_tokens"]]
        chars = printable_bytes()
        ranks = {bytes(chars[x] for x in token): i for token, i in data["model"]["vocab"].items() if token not in self.special}
        self.encoding = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text as little-endian unsigned 32-bit numbers."""
        if any(s in text for s in self.special):
            if self.own is None:
                from tokenizers import Tokenizer

                self.own = Tokenizer.from_file(self.path)
            return np.array(self.own.encode(text, add_special_tokens=False).ids, "<u4")
        return np.asarray(self.encoding.encode_to_numpy(text, disallowed_special=()), "<u4")
