"""Kneser-Ney, toxicity, top-k and URL filters."""

import math
import random
import re
from collections import Counter
from functools import lru_cache
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import kneser_ney as kn
from tessera.llm import common, topk, toxicity, urls
from tessera.llm.entry import LLM_ORACLE, op3_kneser_ney, op5_url_filter, op6_toxicity, op7_top_k
from tessera.plans import lineage
from tests.llm.help import AWKWARD, SMALL, documents, small
from tests.oracle import same


def plain_model(texts):
    """The formulas over dictionaries."""
    sents = [(t or "").encode().lower().split() + [None] for t in texts]
    pairs, uni = Counter(), Counter()
    for s in sents:
        uni.update(s)
        pairs.update(zip(["^", *s[:-1]], s, strict=True))
    types, ctx = Counter(w for _, w in pairs), Counter()
    for (v, _), c in pairs.items():
        ctx[v] += c
    d2, d1 = (kn.discounts([sum(1 for x in c.values() if x == k) for k in (1, 2, 3, 4)]) for c in (pairs, types))
    vocabulary, all_types, total = len(uni), len(pairs), sum(uni.values())
    rest = sum(d1[min(x, 3)] for x in types.values()) / all_types if all_types else 1

    def low(w):
        return max(types[w] - d1[min(types[w], 3)], 0) / max(all_types, 1) + rest / (vocabulary + 1)

    def p(v, w):
        if not ctx[v]:
            return low(w)
        back = sum(d2[min(c, 3)] for (a, _), c in pairs.items() if a == v) / ctx[v]
        return max(pairs[v, w] - d2[min(pairs[v, w], 3)], 0) / ctx[v] + back * low(w)

    def score(t):
        s = (t or "").encode().lower().split() + [None]
        base = sum(math.log10((uni[w] + 1) / (total + vocabulary + 1)) for w in s)
        return len(s), sum(w in uni for w in s), total, base, sum(math.log10(p(v, w)) for v, w in zip(["^", *s[:-1]], s, strict=True))

    return score, p, uni


@pytest.mark.parametrize("sample", [1, 1_000_000])
def test_language_model_equals_the_formulas(spark, monkeypatch, sample):
    monkeypatch.setattr(kn, "CHUNK", 500)
    monkeypatch.setattr(kn, "SHARD_BYTES", 2000)
    monkeypatch.setattr(kn, "HOT_SAMPLE", sample)
    monkeypatch.setattr(kn, "HOT_SHARE", 0.05)
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choice("the cat sat on a mat and The dog").lower() if rng.random() < 0.3 else rng.choice("the cat sat on a mat Dog x y z".split()) for _ in range(rng.randrange(30)))) for i in range(150)]
    rows = [r for r in AWKWARD if r[0] != 8] + texts
    score, p, uni = plain_model([t for i, t in rows if i is None or crc32(str(i).encode()) % 7 != 2])
    got = {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in kn.scored(documents(spark, rows)).collect()}
    want = {(i, *score(t)[:3], *(round(x, 6) for x in score(t)[3:])) for i, t in rows}
    assert got == want
    assert abs(sum(p("the", w) for w in uni) + p("the", "never seen") - 1) < 1e-9


def test_language_model_beats_its_base(spark):
    rows = op3_kneser_ney(spark, SMALL).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert kn.scored(documents(spark, [])).collect() == []


def test_voters():
    v = toxicity.Voters(["idiot", "scum"])
    assert v.read(b"You IDIOT, scum!")[1] == [0, 1]
    assert v.read(b"an id10t and s.c.u.m here")[1] == [0, 1]
    assert v.read(b"i d i o t")[0] >> 11 & 1
    assert v.read(b"") == (0, []) and v.read(b"a clean text")[0] == 0


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(4)
    y = rng.random(20_000) < 0.2
    bits = np.zeros((len(y), 16), dtype=int)
    for v, (hit, false) in enumerate([(0.8, 0.02), (0.7, 0.05), (0.6, 0.1), (0.5, 0.05)]):
        bits[:, v] = rng.random(len(y)) < np.where(y, hit, false)
    bits[:, 4] = bits[:, 2] ^ (rng.random(len(y)) < 0.02)  # a copy of voter 2
    votes = bits @ (1 << np.arange(16))
    known = np.where(rng.random(len(y)) < 0.05, y, -1)
    pattern, n = np.unique(np.stack([votes, known]), axis=1, return_counts=True)
    model = toxicity.fit_label_model(pattern[0], pattern[1], n.astype(float))
    assert any({2, 4} <= set(g) for g in model.groups)
    assert abs(model.prior - 0.2) < 0.05
    single = {g[0]: t for g, t in zip(model.groups, model.tables, strict=True) if len(g) == 1}
    assert abs(single[0][1][1] - 0.8) < 0.06 and abs(single[0][0][1] - 0.02) < 0.02
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.95


def toxic_corpus(n=1500):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(3000)]
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        w = rng.choices(words, k=60)
        for _ in range(3 * bad):
            w[rng.randrange(60)] = rng.choice(["blarg", "Snork!", "frobble", "gleep"])
        rows.append((i, " ".join(w)))
        if rng.random() < 0.6:
            labels.append((i, 1, int(bad)))
    return rows, labels, {i for i, t in rows if any(x in t.lower() for x in ("blarg", "snork", "frobble", "gleep"))}


def test_toxicity_on_held_out_rows(spark):
    rows, labels, bad = toxic_corpus()
    docs = documents(spark, rows + [(5000, None), (5001, ""), (None, "fine")])
    marks = spark.createDataFrame([*labels, (7, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = toxicity.scores(docs, marks).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert {r.doc_id for r in got if r.predicted} == bad
    kept = toxicity.without_toxic(docs, marks)
    assert kept.count() == len(rows) + 3 - len(bad) and kept.columns == docs.columns


def test_scores_equal_a_plain_version(spark):
    """Lexicon, votes, posteriors and classifier over lists."""
    rows, labels, _ = toxic_corpus(700)
    learn = {i: y for i, _, y in labels if crc32(str(i).encode()) % 5}
    toxic, clean = ([(i, t) for i, t in rows if learn.get(i) == y] for y in (1, 0))
    words = lambda t: set(re.sub("[^a-z]", " ", t.lower()).split())
    a, b = Counter(w for t in {t for _, t in toxic} for w in words(t)), Counter(w for _, t in clean for w in words(t))
    rate, marks = len(toxic) / (len(toxic) + len(clean)), []
    for w, n in a.items():
        gain = 2 * (n * math.log(n / ((n + b[w]) * rate)) + (b[w] * math.log(b[w] / ((n + b[w]) * (1 - rate))) if b[w] else 0))
        odds = math.log((n + 0.5) / (len(toxic) + 1)) - math.log((b[w] + 0.5) / (len(clean) + 1))
        if n >= 3 and gain >= 20 and odds >= math.log(8):
            marks.append((-gain, w))
    marks = [w for _, w in sorted(marks)]
    assert {"blarg", "snork", "frobble", "gleep"} <= set(marks)
    frame = lambda some: spark.createDataFrame([(t.encode(),) for _, t in some], "text binary")
    assert toxicity.lexicon(frame(toxic), frame(clean)) == marks

    read = [toxicity.Voters(marks).read(t.encode()) for _, t in rows]
    for (_, t), (votes, hits) in zip(rows, read, strict=True):
        assert hits == sorted(marks.index(w) for w in words(t) & set(marks))
        assert all((votes >> k & 1) == any(h % 8 == k for h in hits) for k in range(8)) and (votes >> 8 & 1) == (len(hits) > 1)
    patterns = Counter((v, learn.get(i, -1)) for (i, _), (v, _) in zip(rows, read, strict=True))
    model = toxicity.fit_label_model(*np.array([*patterns]).T, np.array([*patterns.values()], dtype=float))
    x = np.zeros((len(rows), len(marks) + 17))
    for row, (votes, hits) in zip(x, read, strict=True):
        row[hits] = 1
        row[len(marks) : -1] = [votes >> k & 1 for k in range(16)]
        row[-1] = 1
    y, w = model.posterior(np.array([v for v, _ in read])), np.zeros(x.shape[1])
    ridge = np.diag([1.0] * (x.shape[1] - 1) + [1e-3])
    for _ in range(200):  # reweighted least squares
        p = 1 / (1 + np.exp(-x @ w))
        v = np.maximum(p * (1 - p), 1e-9)
        w = np.linalg.solve(x.T * v @ x + ridge, x.T @ (v * (x @ w) + y - p))
    got = {r.doc_id: r.score for r in toxicity.scores(documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    assert np.allclose([got[i] for i, _ in rows], 1 / (1 + np.exp(-x @ w)), atol=1e-4)


def test_toxic_rows_go_by_their_own_text(spark):
    rows, labels, bad = toxic_corpus()
    one = next(i for i in sorted(bad))
    docs = documents(spark, [*rows, (one, "a clean text under the same id")])
    kept = toxicity.without_toxic(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert [r.text for r in kept.where(kept["doc_id"] == one).collect()] == ["a clean text under the same id"]


def test_toxicity_without_labels(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r.predicted for r in toxicity.scores(docs, none).collect()] == [0] * len(AWKWARD)
    assert toxicity.scores(documents(spark, []), none).collect() == []
    assert op6_toxicity(spark, SMALL).count() == small(spark, "documents").count()


def test_labels_of_held_out_rows_are_not_read(spark):
    rows, labels, _ = toxic_corpus(400)
    docs = documents(spark, rows)
    flipped = [(i, q, 1 - t if crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a, b = (sorted(map(tuple, toxicity.scores(docs, spark.createDataFrame(x, "doc_id bigint, quality int, toxic int")).collect())) for x in (labels, flipped))
    assert a == b


def test_top_k_equals_sql(spark):
    same(op7_top_k(spark, SMALL), LLM_ORACLE["op7_top_k"], SMALL)


def test_top_k_awkward_vectors(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(12)]) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(100)]  # copies: ties
    rows += [(2000, None), (2020, [1.0, None]), (2040, [float("nan")] * 12), (2060, [float("inf")] * 12), (2080, []), (2100, [1.0] * 5), (2101, [1.0] * 5), (None, [1.0] * 12), (20, rows[20][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as q", "2 as block", "3 as dim")
    v = topk.quantized(df)
    good = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    for block, query_block in ((8192, 512), (37, 5)):
        got = topk.top_k(v, v.where("vec_id % 20 = 0 and vec_id <> 20"), 7, block, query_block)
        want = set()
        for i, q in good:
            if i % 20 == 0 and i != 20:
                best = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for j, x in good if j != i and len(x) == len(q))[:7]
                want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
        assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()} == want
    assert topk.top_k(v.where("false"), v.where("false")).collect() == []


def test_scores_beyond_64_bits(spark):
    """Exact beyond 2^53, cut to 64 bits beyond that."""
    rows = [(0, [2.0**55, 1.0]), (20, [1.0, 2.0**-6]), (1, [2.0**50, 3.0]), (2, [2.0**50, 2.0]), (3, [-(2.0**56), 0.0]), (4, [2.0**57, 0.0])]
    v = topk.quantized(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    ints = {i: [min(max(math.floor(64 * x), -(2**63)), 2**63 - 1) for x in e] for i, e in rows}
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(v, v.where("vec_id % 20 = 0"), 5).collect()}
    cut = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    want = set()
    for i in (0, 20):
        best = sorted((-cut(sum(a * b for a, b in zip(ints[i], ints[j], strict=True))), j) for j in ints if j != i)
        want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    assert got == want


def test_sums_below_64_bits_count(spark):
    """A query without a threshold keeps rows whose scores are cut to the lowest number."""
    rows = [(0, [2.0**57, 2.0**57]), *((i, [-(2.0**57), -(2.0**57)]) for i in range(1, 4))]
    v = topk.quantized(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    got = [tuple(r) for r in topk.top_k(v, v.where("vec_id = 0"), 5, 2, 2).orderBy("rank").collect()]
    assert got == [(0, i, i, -(2**63)) for i in (1, 2, 3)]


def test_whole_blocks_are_pruned(spark):
    """Vectors around 40 centres: few pairs of blocks are sent, no result is lost."""
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 1, (40, 24))
    x = centres[rng.integers(0, 40, 6000)] + rng.normal(0, 0.05, (6000, 24))
    v = topk.quantized(spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id bigint, embedding array<double>")).persist()
    q = v.where("vec_id % 20 = 0")
    data, asked, turns = topk.arranged(v, q, 10, 64, 8)
    assert data.selectExpr("sum(octet_length(ids)) / 8").first()[0] == 6000
    assert topk.block_pairs(asked, data, turns, 10, False).count() < 0.2 * data.count() * asked.count()
    ints = np.floor(64 * x).astype(np.int64)
    want = set()
    for i in range(0, 6000, 20):
        scores = ints @ ints[i]
        scores[i] = np.iinfo(np.int64).min
        want |= {(i, n + 1, int(j), int(scores[j])) for n, j in enumerate(np.lexsort((np.arange(6000), ~scores))[:10])}
    assert set(map(tuple, topk.top_k(v, q, 10, 64, 8).collect())) == want
    v.unpersist()


def test_bounds_prune():
    """Vectors near a plane: few pairs get an exact score, and none that counts is lost."""
    rng = np.random.default_rng(3)
    lead, turn = rng.normal(0, 60, (4000, 6)), np.linalg.qr(rng.normal(size=(64, 64)))[0]
    x = np.rint(np.hstack([lead, rng.normal(0, 2, (4000, 58))]) @ turn).astype(np.int64)
    block = topk.DataBlock(np.arange(4000), x, np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1])
    q_ids, whole = np.arange(0, 4000, 20), x[::20] @ x.T
    whole[np.arange(200), q_ids] = np.iinfo(np.int64).min
    least = np.sort(whole[:, :1000], axis=1)[:, -20]
    got = list(zip(*(a.tolist() for a in block.search(q_ids, x[::20], least, 20)), strict=True))
    assert got == [(int(i), int(j), int(whole[n, j])) for n, i in enumerate(q_ids) for j in np.lexsort((np.arange(4000), ~whole[n]))[:20]]
    assert block.exact < 0.05 * block.bounded


def plain_rule(host, path):
    fit = [(len(h + p), h + p, verdict) for verdict, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def plain_split(label, counts):
    """The most probable of all splits, by trying them all."""
    total = sum(counts.values())
    price = lambda w: math.log(counts[w] / total) if w in counts else math.log(10 / (total + 10)) - len(w) * math.log(10)
    best = None
    for mask in range(1 << (len(label) - 1)):
        cuts = [0, *[i + 1 for i in range(len(label) - 1) if mask >> i & 1], len(label)]
        words = [label[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
        if (p := sum(map(price, words))) > (best or (-math.inf,))[0]:
            best = p, words
    return best[1]


def plain_verdicts(rows):
    """Rules, exhaustive segmentation and naive Bayes over dictionaries; rows are (page_id, host, path, visible text)."""
    letters = lambda t: [w for w in "".join(c if c.isalpha() else " " for c in t.lower()).split()]
    counts = Counter(w for *_, text in rows for w in letters(text) if len(w) <= 24)
    split = lru_cache(maxsize=None)(lambda x: plain_split(x, counts))
    words = lambda host, path: [w for x in letters(host) + letters(path) for w in split(x)]
    seen, classes = {"block": Counter(), "allow": Counter()}, Counter()
    for _, host, path, _ in rows:
        if verdict := plain_rule(host, path)[1]:
            classes[verdict] += 1
            seen[verdict].update(words(host, path))
    kinds = len({w for _, host, path, _ in rows for w in words(host, path)})
    of = {v: sum(c.values()) + kinds + 1 for v, c in seen.items()}

    def judge(host, path):
        odds = math.log((classes["block"] + 1) / (classes["allow"] + 1))
        odds += sum(math.log((seen["block"][w] + 1) / of["block"]) - math.log((seen["allow"][w] + 1) / of["allow"]) for w in words(host, path))
        return "block" if odds > 0 else "allow"

    return {i: (*plain_rule(host, path)[:1], plain_rule(host, path)[1] or judge(host, path)) for i, host, path, _ in rows}


def test_url_rules(spark):
    cases = {
        "http://A.Example.com/en/7?x": ("a.example.com", "/en/7", "example.com/en/7", "allow"),
        "https://example.net/de/8#/q": ("example.net", "/de/8", "example.net/de/8", "block"),
        "x://notexample.net/de/8": ("notexample.net", "/de/8", "net/de/", "allow"),
        "http://com/en/": ("com", "/en/", "com/en/", "block"),
        "http://b.org?/es/": ("b.org", "", None, None),
        "no address": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "http://É.com/x\ny": ("É.com", "/x\ny", None, None),
        "http://" + "long" * 3000 + "/" + "path" * 3000: ("long" * 3000, "/" + "path" * 3000, None, None),
    }
    rows = [(i, u, "<p>some words win more</p><script>no()</script>") for i, u in enumerate(cases)] + [(99, "http://b.org?/es/", None), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as host", "2 as label", "3 as n", "4 as word", "5 as verdict")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.verdicts(pages).collect()}
    assert len(got) == len(rows)
    for i, want in enumerate(cases.values()):
        assert got[i][:3] == want[:3] and got[i][3] in ((want[3],) if want[3] else ("allow", "block"))
    assert got[99] == got[4] and got[None] == got[6]
    assert urls.verdicts(pages.where("false")).collect() == []


def test_segmentation(spark):
    words = {"spam": 50, "farm": 40, "spa": 30, "m": 5, "free": 60, "bets": 40, "bet": 3, "s": 2}
    counts = spark.createDataFrame([*words.items()], "word string, n bigint")
    names = ["spamfarm", "freebets", "zq", "xfreez", "betsfarmspa", "qqqqfarm", "m"]
    labels = spark.createDataFrame([*enumerate([*names, ""])], "l bigint, label string")
    got = {r.label: r.w for r in urls.segment(labels, counts).join(labels, "l").groupBy("label").agg(F.sort_array(F.collect_list("word")).alias("w")).collect()}
    assert got == {x: sorted(plain_split(x, words)) for x in names}
    assert got["spamfarm"] == ["farm", "spam"] and got["freebets"] == ["bets", "free"] and got["zq"] == ["zq"]


def test_a_label_of_100000_letters(spark):
    long = "spamfarmzq" * 10_000
    pages = spark.createDataFrame([(1, f"http://{long}.info/{long}/{'a/' * 5000}", "<p>spam farm</p>"), (2, "http://farm.com/en/x", "<p>spam</p>"), (3, f"http://{long}.com/en/", None)], "page_id bigint, url string, html string")
    got = {r.page_id: (len(r.host), r.rule, r.verdict) for r in urls.verdicts(pages).collect()}
    assert got == {1: (100_005, None, "block"), 2: (8, "com/en/", "block"), 3: (100_004, "com/en/", "block")}


def url_table(n=400, seed=5):
    """Names run together; their words tell which rule's pages they are like."""
    rng = random.Random(seed)
    bad, good, plain = ["casino", "bets", "pills"], ["garden", "music", "school"], ["the", "blue", "one"]
    rows = []
    for i in range(n):
        kind = rng.choice(["bad", "good"])
        name = "".join(rng.choice(bad if kind == "bad" else good) if k else rng.choice(plain) for k in range(3))
        host, path = rng.choice([(f"{name}.com", "/en/x") if kind == "bad" else (f"{name}.net", "/de/y"), (f"www.{name}.info", "/p/1.html"), (f"{name}.info", "/" + rng.choice(bad if kind == "bad" else good))])
        rows.append((i, host, path, " ".join(rng.choices(bad + good + plain, k=5)), kind))
    return rows


def test_url_verdicts_equal_a_plain_version(spark, monkeypatch):
    rows = url_table()
    pages = spark.createDataFrame([(i, f"http://{host}{path}?q", f"<p>{text}</p>") for i, host, path, text, _ in rows], "page_id bigint, url string, html string")
    want = plain_verdicts([r[:4] for r in rows])
    for rows_broadcast in (500_000, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", rows_broadcast)
        assert {r.page_id: (r.rule, r.verdict) for r in urls.verdicts(pages).collect()} == want
    unruled = [(i, kind) for i, host, path, _, kind in rows if plain_rule(host, path)[0] is None]
    assert sum((want[i][1] == "block") == (kind == "bad") for i, kind in unruled) > 0.95 * len(unruled) > 100


def test_only_counted_tables_are_broadcast(spark, monkeypatch):
    """Spark's estimate of a join's side, a small file, says nothing of the rows made from it: substrings of labels, or copies for each salt."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    small_file = lineage.written(spark.range(1000).selectExpr("id as k", "id * 2 as v"), "small")
    for how in ("inner", "left"):
        joined = common.salted_join(spark.range(3000).withColumnRenamed("id", "k"), small_file, ["k"], how)
        assert "Broadcast" not in plan(joined) and joined.where("v = 2 * k").count() == 1000
    plans = {}
    monkeypatch.setattr(urls, "written", lambda df, label: plans.update({label: plan(df)}) or lineage.written(df, label))
    pages = spark.createDataFrame([(i, f"http://{host}{path}?q", f"<p>{text}</p>") for i, host, path, text, _ in url_table()], "page_id bigint, url string, html string")
    plans["result"] = plan(urls.verdicts(pages))
    assert set(plans) >= {"known-words", "segments", "word-classes", "weights", "judged", "result"}
    assert [x for x, p in plans.items() if "Broadcast" in p] == []


def test_url_query(spark):
    rows = op5_url_filter(spark, SMALL).collect()
    assert len(rows) == small(spark, "pages").count()
    pages = {r.page_id: re.sub(r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ", r.html or "") for r in small(spark, "pages").collect()}
    want = plain_verdicts([(r.page_id, r.host, r.path, pages[r.page_id]) for r in rows])
    assert {r.page_id: (r.rule, r.verdict) for r in rows} == want


def test_words_are_not_cut_by_their_frequency(spark):
    """More than 5000 ordinary words are in more toxic rows than the marking one."""
    rng = random.Random(6)
    words = ["w" + "".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(5100)]
    rows = [(i, f"{i} " + " ".join(w for j, w in enumerate(words) if (i + j) % 5 == 0) + (" blarg" if i % 3 == 0 and rng.random() < 0.12 else "")) for i in range(450)]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(450)]
    bad = {i for i, t in rows if t.endswith("blarg")}
    assert 11 < len(bad) < 20
    got = toxicity.scores(documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    clean = max(r.score for r in got if r.doc_id not in bad)
    assert all(r.score > clean for r in got if r.doc_id in bad)


def test_the_lexicon_holds_every_marking_word(spark):
    """260 words mark toxic rows, one in each row."""
    rows = [(i, f"some plain words {i} here " + (f"mark{'abcdefghijklmnopqrstuvwxyz'[i // 3 % 26]}{'abcdefghij'[i // 78 % 10]}" if i % 3 == 0 else "more")) for i in range(15_600)]
    labels = [(i, 1, int(i % 3 == 0)) for i, _ in rows]
    got = toxicity.scores(documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    assert {r.doc_id for r in got if r.predicted} == {i for i, _, toxic in labels if toxic}


def test_all_labels_are_read(spark, monkeypatch):
    """No bound on labels, and the same by a shuffled join as by a broadcast."""
    rows, labels, bad = toxic_corpus()
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    monkeypatch.setattr(toxicity, "LABEL_ROWS", 10, raising=False)
    got = sorted(map(tuple, toxicity.scores(docs, marks).collect()))
    assert {r[0] for r in got if r[3]} == bad
    monkeypatch.setattr(toxicity, "broadcast_if_small", lambda df, size: df)
    assert sorted(map(tuple, toxicity.scores(docs, marks).collect())) == got
