"""Token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes. Where a node has no child for the next byte, its failure link leads to the node of
what remains after the greedy longest-match tokens of its string have been taken off, and a precomputed number says how
many tokens those are. So the number of greedy word pieces of a word follows from one pass over its bytes, and no piece
is ever built. All new words of a batch walk through the automaton together, one byte a step.

Words are those of the vocabulary's own splitting pattern; every single byte is a token, so every word has a count.

Defined results: null text is the empty text with 0 words and 0 tokens. Repeated rows give repeated results; extra
columns are ignored; texts of any length are counted whole.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ladderflow.llm.byte_bpe import PATTERN, printable_bytes
from ladderflow.llm.common import texts, worker_cache


class LongestMatch:
    """The automaton over a set of tokens, which must hold all single bytes."""

    def __init__(self, tokens: list[bytes], cache_words: int = 400_000):
        children: list[dict[int, int]] = [{}]
        is_token = [False]
        for token in tokens:
            node = 0
            for c in token:
                below = children[node].get(c)
                if below is None:
                    below = children[node][c] = len(children)
                    children.append({})
                    is_token.append(False)
                node = below
            is_token[node] = True
        if any(not is_token[children[0].get(c, 0)] for c in range(256)):
            raise ValueError("each single byte must be a token")
        n = len(children)
        fail, pops = [0] * n, [0] * n
        level = [0]
        while level:
            following = []
            for parent in level:
                for c, node in children[parent].items():
                    if is_token[node]:
                        fail[node], pops[node] = 0, 1
                    else:
                        at, taken = fail[parent], pops[parent]
                        while c not in children[at]:
                            at, taken = fail[at], taken + pops[at]
                        fail[node], pops[node] = children[at][c], taken
                    following.append(node)
            level = following
        self.fail, self.pops = np.array(fail), np.array(pops)
        rest = np.zeros(n, np.int64)  # tokens of what a node holds at the end of a word
        at, open_ = np.arange(n), np.arange(n)
        while len(open_):
            rest[open_] += self.pops[at[open_]]
            at[open_] = self.fail[at[open_]]
            open_ = open_[at[open_] != 0]
        self.rest = rest
        edges = sorted((parent * 256 + c, node) for parent, below in enumerate(children) for c, node in below.items())
        self.keys, self.to = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
        self.known: dict[str, int] = {}
        self.limit = cache_words

    def count_words(self, words: list[bytes]) -> np.ndarray:
        """The number of greedy longest-match tokens of each word."""
        order = np.argsort([-len(w) for w in words], kind="stable")
        length = np.array([len(words[i]) for i in order])
        flat = np.frombuffer(b"".join(words[i] for i in order), np.uint8).astype(np.int64)
        begin = np.cumsum(length) - length
        node, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for j in range(int(length.max(initial=0))):
            rows = np.arange(np.searchsorted(-length, -j, side="left"))  # words longer than j stand first
            byte = flat[begin[rows] + j]
            while len(rows):
                key = node[rows] * 256 + byte
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                node[rows[hit]] = self.to[at[hit]]
                rows, byte = rows[~hit], byte[~hit]
                count[rows] += self.pops[node[rows]]
                node[rows] = self.fail[node[rows]]
        out = np.empty(len(words), np.int64)
        out[order] = count + self.rest[node]
        return out

    def learn(self, words: set[str]) -> None:
        new = sorted(words, key=len)
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            self.known.update(zip(part, self.count_words([w.encode("utf-8", "surrogatepass") for w in part]).tolist(), strict=True))


def vocabulary(path: str) -> list[bytes]:
    """The tokens of a byte-level vocabulary file, without special ones."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special, chars = {t["content"] for t in data["added_tokens"]}, printable_bytes()
    return [bytes(chars[x] for x in token) for token in data["model"]["vocab"] if token not in special]


def _run(path: str):
    def run(batches):
        import regex

        split = regex.compile(PATTERN).findall
        automaton = worker_cache(("longest-match", path), lambda: LongestMatch(vocabulary(path)))
        for b in batches:
            words = [split(t) for t in b.column("text").to_pylist()]
            if len(automaton.known) > automaton.limit:
                automaton.known = {}
            known = automaton.known
            automaton.learn({w for ws in words for w in ws if w not in known})
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(ws) for ws in words], pa.int64()), pa.array([sum(map(known.__getitem__, ws)) for ws in words], pa.int64())],
                names=["doc_id", "n_words", "n_tokens"],
            )

    return run


def count_tokens(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens of each whole text."""
    return texts(df, "doc_id").mapInArrow(_run(path), "doc_id long, n_words long, n_tokens long")
