import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ladderflow.llm import packing
from ladderflow.llm.byte_bpe import ByteBPE

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check_plan(histogram, runs, capacity=1024):
    for length, n in histogram.items():
        mine = runs[runs[:, 0] == length]
        assert mine[:, 2].sum() == n
        assert (np.cumsum(mine[:, 2]) - mine[:, 2] == mine[:, 1]).all()
    filled = {}
    for length, _, n, first, offset in runs.tolist():
        for s in range(first, first + n):
            filled.setdefault(s, []).append((offset, length))
    for slots in filled.values():
        end = 0
        for offset, length in sorted(slots):
            assert offset == end
            end += length
        assert end <= capacity
    return len(filled)


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_complete_and_tight(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 1025, 3000) if seed % 2 else np.minimum(1024, rng.geometric(0.004, 3000))
    values, counts = np.unique(lengths, return_counts=True)
    histogram = dict(zip(values.tolist(), counts.tolist(), strict=True))
    n = check_plan(histogram, packing.plan(histogram))
    assert n <= 1.02 * lengths.sum() / 1024 + 2


@pytest.mark.parametrize(("histogram", "optimum"), [({}, 0), ({1024: 3}, 3), ({1: 1}, 1), ({600: 5}, 5), ({512: 7}, 4), ({1: 5000}, 5), ({700: 3, 324: 3}, 3)])
def test_plan_edges(histogram, optimum):
    assert check_plan(histogram, packing.plan(histogram)) == optimum


def test_ids_are_those_of_the_library():
    own, ours = Tokenizer.from_file(PATH), ByteBPE(PATH)
    for text in ["", " ", "Hello  world \n\n x\t é 你好", "a<|endoftext|>b", "don't  stop 123", "x" * 5000, "​　 é"]:
        assert ours.encode(text).tolist() == own.encode(text, add_special_tokens=False).ids


def test_pack(spark):
    texts = ["", None, "word " * 3000, "short one", "short one", "a<|endoftext|>b", "é" * 700]
    df = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, piece string, length int")
    rows = packing.pack(df, PATH).collect()
    own = Tokenizer.from_file(PATH)
    by_seq = {}
    for i, t in enumerate(texts):
        ids = own.encode(t or "", add_special_tokens=False).ids + [2]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.start for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))]
        assert sum(r.length for r in mine) == len(ids) and all(r.length == 1024 for r in mine[1:])
        for r in mine:
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert r.ids_crc32 == zlib.crc32(part.tobytes())
            by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for slots in by_seq.values():
        end = 0
        for offset, length in sorted(slots):
            assert offset == end
            end += length
        assert end <= 1024
    assert not packing.pack(df.limit(0), PATH).collect()
