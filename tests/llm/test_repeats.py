"""Repeated strings and the pipeline against brute force."""

import hashlib
import os
import random

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import packing, suffix_dedup
from tests.llm.help import BPE, SMALL, documents, small
from tests.llm.test_tokens import check_packing


def plain_dedup(rows, span=100):
    """rows: (doc_id, text), ids distinct; doc_id -> (n_bytes, n_removed, n_spans, hash, kept)."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        t = (t or "").encode()
        lost = bytearray(len(t))
        for s in range(len(t) - span + 1):
            w = t[s : s + span]
            if w in seen:
                lost[s : s + span] = b"\1" * span
            seen.add(w)
        kept = bytes(c for c, x in zip(t, lost, strict=True) if not x)
        out[i] = (len(t), sum(lost), len(bytes(lost).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest(), kept)
    return out


def shared_text(seed):
    rng = random.Random(seed)
    passage = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    common = [passage(n) for n in (90, 100, 101, 168, 400, 1500)]
    rows = [(i, "".join(rng.choice(common)[rng.randrange(3) * 5 :] if rng.random() < 0.5 else passage(rng.randrange(200)) for _ in range(rng.randrange(8)))) for i in range(60)]
    rows += [(100, "a" * 500), (101, "ab" * 400), (102, "x" * 99), (103, None), (104, ""), (105, rows[3][1]), (106, "a" * 150), (None, rows[5][1] + "tail"), (-5, "é" * 120)]
    return rows


@pytest.mark.parametrize(("seed", "chunk", "collection", "hot", "file"), [(1, 1 << 20, 16_384, 4096, 4 << 20), (2, 300, 5, 1, 200), (3, 250, 50, 4, 1000), (4, 1 << 20, 16_384, 12, 4 << 20)])
def test_repeats_equal_brute_force(spark, monkeypatch, seed, chunk, collection, hot, file):
    for name, value in (("CHUNK", chunk), ("COLLECTION", collection), ("HOT", hot), ("FILE_BYTES", file)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = shared_text(seed)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(suffix_dedup.deduplicated(documents(spark, rows).repartition(3))).collect()}
    assert got == {i: v[:4] for i, v in plain_dedup(rows).items()}


def test_transform_and_common_prefixes(tmp_path):
    """Against the sorted suffixes of aligned pieces, column by column, over several files."""
    rng = np.random.default_rng(2)
    columns = rng.integers(0, 3, (suffix_dedup.WIDTH, 40), dtype=np.uint8)
    columns[:, 20:] = columns[:, :20]  # equal pieces
    transform = suffix_dedup.Transform(str(tmp_path), columns.dtype, 40)
    suffix_dedup.FILE_BYTES, before = 1000, suffix_dedup.FILE_BYTES
    try:
        suffix_dedup.construct(columns, transform)
    finally:
        suffix_dedup.FILE_BYTES = before
    slices = list(transform.slices())
    assert len(transform.files) > 5 and len(slices) == suffix_dedup.WIDTH
    suffix = lambda i, t: bytes(columns[t:, i])
    for t, (symbols, common) in zip(range(suffix_dedup.WIDTH - 1, -1, -1), slices, strict=True):
        behind = sorted(range(40), key=lambda i: suffix(i, t + 1))
        assert symbols.tolist() == [int(columns[t, i]) for i in behind]
        inorder = sorted(suffix(i, t) for i in range(40))
        assert common.tolist() == [0] + [len(os.path.commonprefix([a, b])) for a, b in zip(inorder, inorder[1:], strict=False)]
    transform.close()
    assert os.listdir(tmp_path) == []


def test_very_long_texts(spark):
    """Megabytes of one letter, of two periods, and of text that occurs in others."""
    rng = random.Random(4)
    prose = "".join(rng.choice("abcdefgh ") for _ in range(3_000_000))
    rows = [(1, "a" * 2_000_000), (2, prose), (3, "x" * 50 + prose[1_000_000:1_700_000] + "y" * 50), (4, "ab" * 700_000)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.digest(suffix_dedup.deduplicated(documents(spark, rows))).collect()}
    assert got == {1: (2_000_000, 1_999_999, 1), 2: (3_000_000, 0, 0), 3: (700_100, 700_000, 1), 4: (1_400_000, 1_399_998, 1)}


def test_repeated_rows_and_empty_tables(spark):
    rng = random.Random(0)
    text = "".join(rng.choice("abc ") for _ in range(300))
    got = suffix_dedup.deduplicated(documents(spark, [(1, text), (1, text), (2, text), (1, text[:150] + "!" * 3)])).collect()
    by = sorted((r.row.doc_id, r.n_bytes, r.n_removed) for r in got)
    assert by[0] == by[1] or by[1] == by[2]  # rows that are the same have the same result
    assert (2, 300, 300) in by
    assert suffix_dedup.deduplicated(documents(spark, [])).collect() == []
    assert suffix_dedup.without_repeats(documents(spark, [])).columns == documents(spark, []).columns


def test_characters_are_cut_whole(spark):
    rows = [(1, "é" * 120), (2, "x" + "é" * 120)]
    kept = {r.doc_id: r.text for r in suffix_dedup.without_repeats(documents(spark, rows)).collect()}
    assert set(kept) == {1, 2} and all(set(t) <= {"é", "x"} for t in kept.values())


def test_pipeline_stages(spark):
    docs = small(spark, "documents")
    kept, sizes = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = corpus_pipeline.written(stage(spark, kept, SMALL), name)
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
        after = {r.doc_id: r.text for r in kept.collect()}
        assert set(after) <= set(before)
        if name == "suffix_array_dedup":
            assert after == {i: v[4].decode("utf-8", "ignore") for i, v in plain_dedup(before.items()).items()}
        else:
            assert all(after[i] == before[i] for i in after)
        sizes.append(len(after))
    assert sizes[0] <= docs.count()  # a dozen toxic labels may be too few to learn from
    assert sizes[1] < sizes[0]
    rows = corpus_pipeline.STAGES[-1][1](spark, kept, SMALL).collect()
    assert check_packing(rows, [(r.doc_id, r.text) for r in kept.collect()]) < 0.02
    whole = corpus_pipeline.run(spark, SMALL)
    assert whole.columns == packing.pack(docs, BPE).columns
    assert check_packing(whole.collect(), [(r.doc_id, r.text) for r in kept.collect()]) < 0.02
