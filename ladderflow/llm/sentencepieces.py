"""SentencePiece encoding and decoding by a batched numpy Viterbi.

A text is cut into words: a run of escaped blanks with the characters up to the next one, over which no piece reaches.
Distinct words of one length advance together through the lattice: for each end position the hashes of all substrings
that end there probe the sorted hashes of the pieces, and a maximum over the candidates stores the backpointer.

The arc weight makes the best path the library's result. In a unigram model it is the piece's score. In a BPE model a
segmentation is the library's exactly if each pair of neighbours, merged by itself, stays as it is; an arc whose pair
does not stay weighs minus infinity, so one path is left, and a maximum finds it. Pairs are merged once and then kept.
Characters without a piece become byte pieces (or the unknown piece, in models without them).

Only models with identity normalisation and a blank put before the text are taken (others raise an error).

Defined results: null text is the empty text, which has no ids. Repeated rows give repeated results; extra columns are
ignored. Decoding the ids of a text gives the text again, whole, unless it holds the escape character U+2581 itself,
which comes back as a blank: then round_trip is false.
"""

from __future__ import annotations

import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ladderflow.llm.common import texts, worker_cache

BLANK = "▁"
WORD = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
LOW_BITS, PAIR_BITS = 18, 21
LOW = np.uint64((1 << LOW_BITS) - 1)
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Pieces:
    """The pieces of a model file and its batched encoder."""

    def __init__(self, path: str, cache_words: int = 300_000):
        import sentencepiece

        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only models with identity normalisation and a blank before the text are taken")
        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.limit, self.words = cache_words, {}
        self.pair_code, self.pair_ok = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.byte_id, self.text_of = np.full(256, -1, np.int64), [b""] * n
        normal = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.text_of[i] = bytes([int(piece[3:5], 16)])
            elif sp.is_control(i):
                pass
            elif sp.is_unknown(i):
                self.text_of[i] = " ⁇ ".encode()
            else:
                self.text_of[i] = piece.replace(BLANK, " ").encode()
                if not sp.is_unused(i):
                    normal.append(i)
        self.unknown = sp.unk_id()
        self.piece = {sp.id_to_piece(i): i for i in normal}
        self.score = np.array([sp.get_score(i) for i in range(n)])
        self.all_pieces, self.names = self.piece, {i: p for p, i in self.piece.items()}
        self.bpe = model.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE
        if self.bpe:  # pieces that no merge makes are never results
            self.piece = {p: i for p, i in self.piece.items() if self.merge(p) == [p]}
        self.sizes = sorted({len(p) for p in self.piece})
        keys = {size: [] for size in self.sizes}
        for p, i in self.piece.items():
            keys[len(p)].append((p, i))
        #: By size: sorted hashes, their pieces, and which low bits of a hash any piece has (most probes end there).
        self.table = {}
        for size, rows in keys.items():
            codes = np.array([[ord(c) for c in p] for p, _ in rows], np.uint64)
            h = next(x for k, x in self._hashes(codes, size) if k == size)[:, 0]
            order = np.argsort(h)
            low = np.zeros(1 << LOW_BITS, bool)
            low[h & LOW] = True
            self.table[size] = h[order], np.array([i for _, i in rows], np.int64)[order], low

    @staticmethod
    def _hashes(codes: np.ndarray, most: int):
        """(size, hashes of all substrings of that size), each size from the one before: row i, column j is
        codes[i, j : j + size]."""
        h = np.zeros(codes.shape, np.uint64)
        for k in range(min(most, codes.shape[1])):
            h = (h[:, : codes.shape[1] - k] ^ (codes[:, k:] + _B1)) * _B2
            h ^= h >> np.uint64(29)
            yield k + 1, h

    def merge(self, text: str) -> list[str]:
        """The BPE merges of one short string, best score first, leftmost on ties."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = self.all_pieces.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.score[piece] > best):
                    best, at = self.score[piece], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stays(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of neighbours stays as it is when merged by itself."""
        codes = left * len(self.text_of) + right
        slot = (codes.astype(np.uint64) * _B1 >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        ok, new = self.pair_ok[slot], np.flatnonzero(self.pair_code[slot] != codes)
        if len(new):  # pairs not met before, or pushed out of their slot by others
            distinct, back = np.unique(codes[new], return_inverse=True)
            known = np.array([self._merges_alone(code) for code in distinct.tolist()], bool)[back]
            ok[new], self.pair_ok[slot[new]], self.pair_code[slot[new]] = known, known, codes[new]
        return ok

    def _merges_alone(self, code: int) -> bool:
        a, b = self.names[code // len(self.text_of)], self.names[code % len(self.text_of)]
        return self.merge(a + b) == [a, b]

    def viterbi(self, words: list[str]) -> list[list[int]]:
        """Ids of words of one length; a character without a piece is -1 - its code point."""
        n, size = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size).astype(np.uint64)
        arcs = {}
        for k, h in self._hashes(codes, self.sizes[-1]):
            if k in self.table:
                keys, ids, low = self.table[k]
                probe = np.nonzero(low[h & LOW])
                if len(probe[0]) or k == 1:
                    found, asked = np.full(h.shape, -1, np.int64), h[probe]
                    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                    found[probe] = np.where(keys[at] == asked, ids[at], -1)
                    arcs[k] = found
        single = arcs.get(1, np.full((n, size), -1))
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, size + 1), np.int64)
        last = np.full((n, size + 1), -1, np.int64)  # the piece that ends here on the best path; -1: none, or no piece
        missing = min(self.score.min(), 0) - 10
        for j in range(1, size + 1):
            for k, ids in arcs.items():
                if k > j:
                    break
                piece, before = ids[:, j - k], best[:, j - k]
                open_ = np.flatnonzero((piece >= 0) & np.isfinite(before))
                if not len(open_):
                    continue
                if self.bpe:
                    previous = last[open_, j - k]
                    pair = np.flatnonzero(previous >= 0)
                    if len(pair):
                        stays = np.ones(len(open_), bool)
                        stays[pair] = self._stays(previous[pair], piece[open_[pair]])
                        open_ = open_[stays]
                    weight = 0.0
                else:
                    weight = self.score[piece[open_]]
                total = before[open_] + weight
                better = total > best[open_, j]
                rows = open_[better]
                best[rows, j], back[rows, j], last[rows, j] = total[better], k, piece[rows]
            lost = np.flatnonzero((single[:, j - 1] < 0) & np.isfinite(best[:, j - 1]) & (best[:, j - 1] + missing > best[:, j]))
            best[lost, j], back[lost, j], last[lost, j] = best[lost, j - 1] + missing, 1, -1
        out: list[list[int]] = [[] for _ in words]
        at, rows = np.full(n, size), np.arange(n)
        while len(rows):
            step, piece = back[rows, at[rows]], last[rows, at[rows]]
            start = at[rows] - step
            piece = np.where(piece < 0, -1 - codes[rows, start].astype(np.int64), piece)
            for i, p in zip(rows.tolist(), piece.tolist(), strict=True):
                out[i].append(p)
            at[rows] = start
            rows = rows[start > 0]
        return [ids[::-1] for ids in out]

    def _finish(self, ids: list[int]) -> np.ndarray:
        """Byte pieces for characters without a piece."""
        done: list[int] = []
        for i in ids:
            if i >= 0:
                done.append(i)
            elif self.byte_id[0] >= 0:
                done += self.byte_id[list(chr(-1 - i).encode("utf-8", "surrogatepass"))].tolist()
            elif not done or done[-1] != self.unknown:
                done.append(self.unknown)
        return np.array(done, "<u4")

    def learn(self, words: set[str]) -> None:
        """Encodes new words, those of equal length together."""
        for size, some in itertools.groupby(sorted(words, key=len), key=len):
            group = list(some)
            step = max(1, 200_000 // size)
            for i in range(0, len(group), step):
                part = group[i : i + step]
                for w, ids in zip(part, self.viterbi(part), strict=True):
                    self.words[w] = self._finish(ids).tobytes()

    def encode_batch(self, batch: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        split = [WORD.findall((BLANK + t).replace(" ", BLANK)) if t else [] for t in batch]
        if len(self.words) > self.limit:
            self.words = {}
        self.learn({w for ws in split for w in ws if w not in self.words})
        return [np.frombuffer(b"".join(map(self.words.__getitem__, ws)), "<u4") for ws in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the blank that encoding puts first."""
        text = b"".join(map(self.text_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _run(path: str):
    def run(batches):
        pieces = worker_cache(("sentencepieces", path), lambda: Pieces(path))
        for b in batches:
            batch = b.column("text").to_pylist()
            ids = pieces.encode_batch(batch)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                    pa.array([pieces.decode(x) == t for x, t in zip(ids, batch, strict=True)]),
                ],
                names=["doc_id", "n_ids", "ids_crc32", "round_trip"],
            )

    return run


def encode(df: DataFrame, path: str) -> DataFrame:
    """doc_id and ids array<int> of each text."""

    def run(batches):
        pieces = worker_cache(("sentencepieces", path), lambda: Pieces(path))
        for b in batches:
            ids = pieces.encode_batch(b.column("text").to_pylist())
            column = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), column], names=["doc_id", "ids"])

    return texts(df, "doc_id").mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of doc_id, ids array<int>; null ids give the empty text."""

    def run(batches):
        pieces = worker_cache(("sentencepieces", path), lambda: Pieces(path))
        for b in batches:
            text = [pieces.decode(np.array(x or [], np.int64)) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of little-endian unsigned 32-bit ids) and whether decoding gives the text again."""
    return texts(df, "doc_id").mapInArrow(_run(path), "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")
