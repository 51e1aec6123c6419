"""Tokens, counts and packing against the library itself."""

import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm import bpe, packing, token_counts
from tests.llm.help import AWKWARD, BPE, documents, small

LIBRARY = Tokenizer.from_file(BPE)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def mixed_texts(n=400, seed=3):
    rng = random.Random(seed)
    alphabet = ["a", "b", "the", " ", "  ", "\n", "\t", " ", "\x1c", "\x85", "'s", "'", "1", "é", "漢", "!", "<|endoftext|>", "<|endof", "text|>", " ", "﻿", "\U0001f600"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_fast_ids_are_the_library_s(spark):
    tokenizer = bpe.load(BPE)
    assert isinstance(tokenizer, bpe.ByteLevel)
    texts = mixed_texts() + [t or "" for _, t in AWKWARD] + [r.text for r in small(spark, "documents").collect()]
    for text in texts:
        assert np.frombuffer(tokenizer.encode(text), "<u4").tolist() == ids(text), repr(text[:80])
        assert tokenizer.count(text) == len(ids(text))


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 4), (200, 40), (1000, 16)])
def test_chunks_are_spliced_rightly(spark, chunk, overlap):
    tokenizer = bpe.load(BPE)
    texts = ["".join(mixed_texts(300, 9)), "x" * 3000, " " * 2000, "<|endoftext|>" * 200, small(spark, "documents").selectExpr("max_by(text, n_chars)").first()[0][:20_000]]
    for text in texts:
        assert token_counts.count_huge(tokenizer, text, chunk, overlap) == len(ids(text))


LONG_RUNS = ["\n" * 2_000_000, " " * 2_000_000, "x" * 2_000_000, "a b" + "\t" * 50_000 + "c " * 20_000 + "y" * 100_000, "\r\n \u3000" * 200_000]


def test_long_runs_are_counted_and_packed(spark):
    """White space and letters without a blank, through the splicing path and the packer."""
    rows = [*enumerate(LONG_RUNS)]
    docs = documents(spark, rows)
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, BPE).collect()} == {i: len(ids(t)) for i, t in rows}
    assert check_packing(packing.pack(docs, BPE).collect(), rows) < 0.1


def test_counts(spark):
    got = sorted(token_counts.token_counts(documents(spark), BPE).collect(), key=repr)
    want = sorted([(i, len((t or "").encode()), len(ids(t)), len(ids(t)) > 512) for i, t in AWKWARD], key=lambda r: repr(r))
    assert sorted(map(tuple, got), key=repr) == want
    assert token_counts.token_counts(documents(spark, []), BPE).collect() == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_files_go_to_their_library(spark, name):
    path = public_tokenizers.path(name)
    own = sentencepiece.SentencePieceProcessor(model_file=path).encode if name.endswith(".model") else lambda t: Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids
    rows = [r for r in AWKWARD if r[0] != 8]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(documents(spark, rows), path).collect()}
    assert got == {i: len(own(t or "")) for i, t in rows}


def check_packing(rows, docs, window=1024):
    """Every id in exactly one piece, windows gapless and not over-full; gives padding as a share of all."""
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for i, t in docs:
        want[i].append(ids(t) + [0])
    for i, lists in want.items():
        got = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces.pop(i))
        if len(lists) == 1:
            at = 0
            for start, length, crc, total in got:
                assert (start, total) == (at, len(lists[0]))
                assert crc == crc32(np.array(lists[0][start : start + length], "<u4").tobytes())
                at += length
            assert at == len(lists[0])
        else:
            assert sum(g[1] for g in got) == sum(map(len, lists))
    assert not pieces
    used = 0
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window
        used += at
    return 1 - used / (window * len(windows)) if windows else 0


def test_packing(spark):
    docs = small(spark, "documents")
    rows = packing.pack(docs, BPE).collect()
    assert check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()]) < 0.01
    check_packing(packing.pack(documents(spark), BPE).collect(), AWKWARD)
    check_packing(packing.pack(documents(spark), BPE, window=8, with_ids=True).collect(), AWKWARD, 8)
    assert packing.pack(documents(spark, []), BPE).collect() == []


def test_placement_minimises_the_sum_of_squares():
    rng, packer = random.Random(1), packing.SumOfSquares(16)
    for i in range(300):
        size = rng.randrange(1, 16)
        before = packer.counts.copy()

        def after(level):
            n = before.copy()
            n[level] -= level > 0
            if level + size < 16:
                n[level + size] += 1
            return int((n[1:16] ** 2).sum())

        best = min(after(h) for h in range(17 - size) if h == 0 or before[h])
        packer.add((i, 0, size, bytes(4 * size)))
        assert int((packer.counts[1:16] ** 2).sum()) == best
