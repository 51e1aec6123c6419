"""Fingerprints, links and leaks against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import decontam, mapped, simhash
from tests.llm.help import AWKWARD, documents, small


def plain_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    up = {i: i for i in fps}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= radius:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {i: find(i) for i in fps}


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in small(spark, "documents").select("doc_id", "text").limit(120).collect()}
    docs |= {9000 + i: t for i, t in enumerate(["", None, "one two", "one two", "ONE two"])}
    got = {r.doc_id: r for r in simhash.near_duplicates(documents(spark, list(docs.items()))).collect()}
    fps = {i: plain_fingerprint(t) for i, t in docs.items()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == brute_components(fps, 2)


def planted(rng, n=400):
    fps = [rng.getrandbits(64) for _ in range(n // 4)]
    while len(fps) < n:
        x = rng.choice(fps)
        for _ in range(rng.randrange(1, 4)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    return sorted(set(fps))


def test_links_lose_nothing(spark):
    rng = random.Random(5)
    fps = planted(rng)
    base = rng.getrandbits(64)
    fps = sorted({*fps, *[base ^ rng.getrandbits(16) for _ in range(300)]})  # a hot shard
    nodes = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp bigint")
    for shard in (2048, 8):
        found = simhash.links(simhash.block_shards(nodes, shard), 2).collect()
        got = brute_components({i: i for i in range(len(fps))}, -1)
        at = {simhash._signed(x): i for i, x in enumerate(fps)}
        up = dict(got)

        def find(i):
            while up[i] != i:
                i = up[i]
            return i

        for r in found:
            x, y = sorted((find(at[r.src]), find(at[r.dst])))
            up[y] = x
        assert {i: find(i) for i in up} == brute_components(dict(enumerate(fps)), 2)


def test_trees_follow_few_edges():
    """One tree for a shard: the groups of brute force, by far fewer distances than all pairs."""
    rng = random.Random(12)
    base = rng.getrandbits(32) << 32
    for n, make in ((2048, lambda: base | rng.getrandbits(32)), (1500, lambda: base | 1 << rng.randrange(32) | 1 << rng.randrange(32) | 1 << rng.randrange(32))):
        members = sorted({make() for _ in range(n)})
        tree = simhash.BKTree()
        found = simhash.shard_links(members, 2, tree)
        assert tree.values == members and len(found) < len(members)
        up = dict(zip(members, members, strict=True))

        def find(i):
            while up[i] != i:
                i = up[i]
            return i

        for a, b in found:
            x, y = sorted((find(a), find(b)))
            up[y] = x
        assert {i: find(i) for i in members} == {members[i]: members[c] for i, c in brute_components(dict(enumerate(members)), 2).items()}
        if n == 2048:
            assert tree.calls < len(members) ** 2 / 4
    assert all(c[(members[i] ^ members[k]).bit_count()] == k for i, c in enumerate(tree.children) for k in c.values())


def test_rows_that_share_an_id(spark):
    copy, other = "a b c d e f g h i j", "quite another text of some words here and there"
    kept = simhash.one_of_each_group(documents(spark, [(1, copy), (5, copy), (5, other), (9, "t"), (9, "t"), (None, copy), (None, "u")]))
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, "u"), (1, copy), (5, other), (9, "t")]
    assert kept.columns == documents(spark).columns


def test_key_files_do_as_a_broadcast(spark, monkeypatch):
    rows = [(i, f"text {i % 700}") for i in range(2000)]
    want = sorted(r.doc_id for r in simhash.one_of_each_group(documents(spark, rows)).collect())
    assert want == list(range(700))
    monkeypatch.setattr(mapped, "BROADCAST_KEYS", 10)
    monkeypatch.setattr(mapped, "FILE_KEYS", 100)
    assert sorted(r.doc_id for r in simhash.one_of_each_group(documents(spark, rows)).collect()) == want


def test_a_lost_file_raises(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mapped, "FILE_KEYS", 8)
    monkeypatch.setattr(mapped, "MAPS", 3)
    folder, bits = mapped.save_keys(spark.createDataFrame([(i << 58,) for i in range(20)], "key bigint"), "keys", 64)
    asked = np.arange(64, dtype=np.uint64) << np.uint64(58)
    arrays = mapped.Arrays(folder, bits, "key")
    assert arrays.has(asked).tolist() == [i < 20 for i in range(64)] and len(arrays.files) <= 3  # empty files included
    mapped.remove(folder, ["key-0000005.npy"])
    for place in (folder, f"file://{folder}"):
        with pytest.raises(FileNotFoundError):
            mapped.Arrays(place, bits, "key").has(asked)


def test_key_files_without_a_mounted_folder(tmp_path):
    """As on an object store: files are fetched by address, a few held at once."""
    folder = f"file://{tmp_path}/keys"
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    for n in range(32):
        part = keys[keys >> np.uint64(59) == n]
        mapped.save(folder, f"key-{n:07d}", part)
        mapped.save(folder, f"key-{n:07d}", part)  # a task that runs again
        mapped.save(folder, f"value-{n:07d}", (part >> np.uint64(8)).astype(np.int64))
    arrays = mapped.Arrays(folder, 5, "key", "value")
    asked = rng.permutation(np.concatenate([keys, keys + np.uint64(1)]))
    assert (arrays.has(asked) == (asked % np.uint64(2) == 0)).all() and len(arrays.files) <= 2 * mapped.HELD
    asked.sort()
    assert (arrays.get(asked, 1)[0] == np.where(asked % np.uint64(2) == 0, asked >> np.uint64(8), 0).astype(np.int64)).all()


def test_awkward_documents(spark):
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(documents(spark)).collect()}
    assert {(1, 1), (5, 1), (2, 2), (3, 2), (4, 2)} <= got
    assert simhash.near_duplicates(documents(spark, [])).collect() == []
    kept = simhash.one_of_each_group(documents(spark))
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 2, 6, 7, 8] and kept.columns == documents(spark).columns


def test_near_texts_are_grouped(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(5000)]
    rows, pairs = [], []
    for i in range(60):
        w = rng.choices(words, k=300)
        rows.append((2 * i, " ".join(w)))
        w[rng.randrange(300)] = "changed"
        rows.append((2 * i + 1, " ".join(w)))
        pairs.append(2 * i)
    got = {r.doc_id: r.component_id for r in simhash.near_text_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[p] == got[p + 1] == p for p in pairs)
    assert len(set(got.values())) >= 60


def shingle_set(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_texts_against_brute_force(spark):
    """Edited copies from well above to well below the threshold: the groups of chains of near pairs, none lost and none more."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    texts = {}
    for _ in range(40):
        base = rng.choices(words, k=200)
        for edits in range(9):
            w = list(base)
            for i in rng.sample(range(200), edits):
                w[i] = f"e{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(w)
    sets = {i: shingle_set(t) for i, t in texts.items()}
    near = [(a, b) for a, b in combinations(texts, 2) if a // 9 == b // 9 and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    up = {i: i for i in texts}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in near:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = {r.doc_id: r.component_id for r in simhash.near_text_groups(spark.createDataFrame([*texts.items()], "doc_id bigint, text string")).collect()}
    assert got == {i: find(i) for i in texts}


def test_near_documents_against_brute_force(spark):
    """All pairs of the small table, rows of every language and length."""
    texts = {r.doc_id: (r.text or "").encode().lower().split() for r in small(spark, "documents").select("doc_id", "text").collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for i, w in texts.items()}
    up = {i: i for i in texts}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(sorted(texts), 2):
        if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    got = {r.doc_id: r.component_id for r in simhash.near_text_groups(small(spark, "documents")).collect()}
    assert got == {i: find(i) for i in texts} and len({*got.values()}) < len(got)


def test_leaks(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu"
    items = [(1, item), (2, "Short one!"), (3, None), (4, "..."), (5, item)]
    rng = random.Random(1)
    noise = lambda n: " ".join(f"n{rng.randrange(999)}" for _ in range(n))
    rows = [
        (1, f"{noise(3000)} {item.upper()}, {noise(50)}"),
        (2, noise(300)),
        (3, f"x short, ONE y {noise(20)}"),
        (4, None),
        (5, ""),
        (6, item.replace("zeta", "other")),
        (7, f"{item.rpartition(' ')[0]}"),
        (None, item),
        (1, item),
    ]
    docs, bench = documents(spark, rows), spark.createDataFrame(items, "item_id int, text string").withColumn("doc_id", F.lit(1))
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_shingles) for r in decontam.leaks(docs, bench).collect()}
    assert got == {(1, 1): (8, 8), (1, 5): (8, 8), (7, 1): (7, 8), (7, 5): (7, 8), (3, 2): (1, 1), (None, 1): (8, 8), (None, 5): (8, 8)}
    kept = decontam.without_leaks(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6] and kept.columns == docs.columns
    mixed = decontam.without_leaks(documents(spark, [(1, noise(30)), (1, item), (1, "short one too")]), bench)
    assert [(r.doc_id, len(r.text.split())) for r in mixed.collect()] == [(1, 30)]
    assert decontam.leaks(documents(spark, []), bench).collect() == []
    assert decontam.leaks(docs, bench.where("false")).collect() == []
    assert decontam.without_leaks(docs, bench.where("false")).count() == len(rows)
    assert decontam.leaks(docs, bench).dtypes == decontam.leaks(docs, bench.where("false")).dtypes


def test_repeated_items_and_null_ids(spark):
    item, other = "alpha beta gamma delta epsilon zeta eta theta iota kappa", "one two three four five six seven"
    items = [(1, item), (1, item), (1, item.upper() + "!"), (None, item), (None, other), (2, item), (2, other), (2, "tiny"), (3, None), (3, None)]
    docs = documents(spark, [(1, f"x {item} y"), (2, other), (3, "a tiny b"), (4, "nothing")])
    got = sorted((r.doc_id, str(r.item_id), r.n_shared, r.n_shingles) for r in decontam.leaks(docs, spark.createDataFrame(items, "item_id int, text string")).collect())
    assert got == [(1, "1", 6, 6), (1, "2", 6, 6), (1, "None", 6, 6), (2, "2", 3, 3), (2, "None", 3, 3), (3, "2", 1, 1)]
    kept = decontam.without_leaks(docs, spark.createDataFrame([(1, item), (1, item)], "item_id int, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]


def test_sketches_miss_nothing(spark):
    rng = random.Random(3)
    items = [(i, " ".join(f"i{i}x{j}" for j in range(rng.randrange(5, 90)))) for i in range(40)]
    rows, want = [], set()
    for i, text in items:
        w = text.split()
        for cut in range(0, len(w), 3):
            rows.append((len(rows), " ".join(w[cut:])))
            n = max(0, len(w) - 4)
            if max(0, len(w) - cut - 4) >= 0.8 * n - 1e-9:
                want.add((rows[-1][0], i))
    got = decontam.leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id int, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def groups_of(spark, texts, **how):
    return {r.doc_id: r.component_id for r in simhash.near_text_groups(spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string"), **how).collect()}


def template(n, common, own, shared):
    """Texts of one template, of which each two from the first on share a few words more."""
    new = iter(range(10**9))
    mine = lambda k: [f"o{next(new)}" for _ in range(k)]
    texts = []
    for _ in range(n // 2):
        both = [f"t{i}" for i in range(common)] + mine(shared)
        texts += [" ".join(both + mine(own - shared)) for _ in range(2)]
    return texts


def test_near_pairs_of_a_template_are_all_found(spark):
    """200 shingles a text, all pairs at 0.786, planted ones at 0.826: no link is sure, and most neighbours fail the check."""
    texts = template(300, 180, 24, 5)
    a, b, c = (shingle_set(texts[i]) for i in (0, 1, 2))
    assert len(a & b) / len(a | b) > 0.82 and 0.78 < len(a & c) / len(a | c) < 0.79
    assert groups_of(spark, texts) == {i: i - i % 2 for i in range(300)}


def test_a_hot_shard_loses_nothing(spark):
    """2400 texts that share shards, more than a shard once held: all pairs at 0.75, planted ones at 0.81."""
    texts = template(2400, 46, 7, 2)
    a, b, c = (shingle_set(texts[i]) for i in (0, 1, 2))
    assert len(a & b) / len(a | b) > 0.8 > len(a & c) / len(a | c)
    assert groups_of(spark, texts) == {i: i - i % 2 for i in range(2400)}


def test_blocks_and_rounds_lose_nothing(spark, monkeypatch):
    """Small blocks and one candidate a round, on edited copies around the threshold: the groups of brute force."""
    monkeypatch.setattr(simhash, "FIRST", 1)
    monkeypatch.setattr(simhash, "GROWTH", 3)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        w = list(base)
        for i in rng.sample(range(120), rng.randrange(8)):
            w[i] = f"e{rng.randrange(40)}"
        texts.append(" ".join(w))
    sets = [shingle_set(t) for t in texts]
    near = {(i, j) for i, j in combinations(range(150), 2) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])}
    want = {i: i for i in range(150)}
    for _ in range(150):
        if all(want[i] == want[j] for i, j in near):
            break
        for i, j in near:
            want[i] = want[j] = min(want[i], want[j])
    assert 1 < len(set(want.values())) < 150
    for block in (2, 7, 2048):
        assert groups_of(spark, texts, block=block) == want


def test_block_pairs():
    """Against a plain loop: limits hold pairs back and say so, sides and components part rows."""
    rng = np.random.default_rng(3)
    group, side, comp = np.sort(rng.integers(0, 4, 60)), rng.integers(0, 2, 60), rng.integers(0, 5, 60)
    n, pos, bits = np.full(60, 10), rng.integers(0, 3, 60), np.zeros((60, 8), np.uint64)
    want = {(i, j) for i, j in combinations(range(60), 2) if group[i] == group[j] and side[i] != side[j] and comp[i] != comp[j] and 10 - max(pos[i], pos[j]) >= 9}
    i, j, more = simhash.block_pairs(group, side, comp, n, pos, bits, 60, 0.8)
    assert {*zip(i.tolist(), j.tolist(), strict=True)} == want and not more
    i, j, more = simhash.block_pairs(group, side, comp, n, pos, bits, 1, 0.8)
    assert {*zip(i.tolist(), j.tolist(), strict=True)} < want and more


def test_short_near_texts_are_all_found(spark):
    """9 and 8 words: 4 of 5 distinct shingles, exactly 0.8."""
    texts = []
    for i in range(300):
        w = [f"s{i}x{j}" for j in range(9)]
        texts += [" ".join(w), " ".join(w[:8])]
    assert groups_of(spark, texts) == {i: i - i % 2 for i in range(600)}


def test_shards_that_end_a_partition(spark):
    nodes = spark.createDataFrame([(i, 5, [1, 2, 100 + i]) for i in range(6)], "fp bigint, n int, first array<bigint>")
    for batch in (10_000, 1, 2, 5):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = {(r.sh, r.fp, r.pos): r.head for r in simhash.text_shards(nodes.union(nodes).coalesce(1), 0.8).collect()}
        assert {*got} == {(k, i, k - 1) for k in (1, 2) for i in range(6)}
        assert all(head == (0 if fp else None) for (sh, fp, _), head in got.items() if sh == 1)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_the_stage_groups_by_fingerprints(spark):
    """Equal fingerprints of texts whose sets of shingles are far apart; near sets whose fingerprints are far apart; and a chain of both."""
    turns = ["a b c " * 1000 + " ".join(f"x{i}y{j}" for j in range(20)) for i in range(2)]
    w = [f"w{i}" for i in range(300)]
    edited = [" ".join(w), " ".join([*w[:100], "changed", *w[101:200], "too", *w[201:]])]
    texts = [*turns, *edited, turns[1] + " z"]
    fps = [plain_fingerprint(t) for t in texts]
    sets = [shingle_set(t) for t in texts]
    near = lambda i, j: 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])
    assert (fps[0] ^ fps[1]).bit_count() <= 2 and not near(0, 1)
    assert (fps[2] ^ fps[3]).bit_count() > 2 and near(2, 3)
    kept = simhash.one_of_each_group(documents(spark, [*enumerate(texts)]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]


def test_the_stage_against_brute_force(spark):
    """All pairs of the small table: chains of fingerprints within two bits and of near sets, no group more or less."""
    texts = {r.doc_id: r.text for r in small(spark, "documents").select("doc_id", "text").collect()}
    words = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for i, w in words.items()}
    want = brute_components({i: plain_fingerprint(t) for i, t in texts.items()}, 2)
    for a, b in combinations(sorted(texts), 2):
        if want[a] != want[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            x, y = sorted((want[a], want[b]))
            want = {i: x if c == y else c for i, c in want.items()}
    kept = simhash.one_of_each_group(small(spark, "documents"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({*want.values()})


def test_small_shards_have_all_pairs(spark):
    """Whatever the batches: of shards of SMALL nodes or fewer each pair is a first candidate, of larger ones those of near places."""
    sizes = {7: 2, 8: 3, 9: simhash.SMALL, 10: simhash.SMALL + 1, 11: 3 * simhash.SMALL, 12: 1}
    rows = [(100 * sh + i, 5, [sh]) for sh, size in sizes.items() for i in range(size)]
    nodes = spark.createDataFrame([*rows, *rows[::2]], "fp bigint, n int, first array<bigint>").coalesce(1)
    for batch in (10_000, 1, 2, 5, 17):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = simhash.text_shards(nodes, 0.8).collect()
        assert sorted((r.sh, r.fp, r.nth) for r in got) == sorted((sh, 100 * sh + i, i) for sh, size in sizes.items() if size > 1 for i in range(size))
        pairs = {(x, r.fp) for r in got for x in [*([] if r.head is None else [r.head]), *r.others]}
        assert pairs == {(100 * sh + i, 100 * sh + j) for sh, size in sizes.items() for i, j in combinations(range(size), 2) if i == 0 or j - i < simhash.SMALL}
        assert sum(len(r.others) + (r.head is not None) for r in got) == len(pairs)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
