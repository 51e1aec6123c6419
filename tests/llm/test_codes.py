"""Vector codes, I-Match fingerprints and the divergence audit."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from math import floor

import pytest
from pyspark.sql import functions as F

from tessera.llm import common, divergence, imatch, vector_codes
from tessera.llm.entry import LLM_ORACLE, op11_vector_codes, op12_imatch, op13_divergence
from tests.llm.help import AWKWARD, SMALL, documents, small
from tests.oracle import same

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """The contract over Python's integers, for vectors of one length."""
    kept = [(i, [floor(x * 4096) for x in v], label) for i, v, label in rows]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(kept[0][1])
    spans = [(i * dim // parts, (i + 1) * dim // parts) for i in range(parts)]
    books = [[k[1][a:b] for k in kept[:entries]] for a, b in spans]
    far = lambda x, c: sum((p - q) ** 2 for p, q in zip(x, c, strict=True))
    best = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for n, (a, b) in enumerate(spans):
            mine = defaultdict(list)
            for _, v, _ in kept:
                mine[best(v[a:b], books[n])].append(v[a:b])
            books[n] = [[sum(c) // len(mine[e]) for c in zip(*mine[e], strict=True)] if e in mine else old for e, old in enumerate(books[n])]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    out, labels = [], Counter()
    for i, v, label in kept:
        at = [best(v[a:b], book) for (a, b), book in zip(spans, books, strict=True)]
        error = sum(far(v[a:b], book[e]) for (a, b), book, e in zip(spans, books, at, strict=True))
        labels[label] += error
        out.append((i, "".join(f"{e:02x}" for e in at), error, label))
    top = 2**63 - 1
    return sorted(((i, code, min(error, top), min(labels[label], top), digest) for i, code, error, label in out), key=repr)


def coded(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as dim", "'z' as q", "2 as key", "3 as code", "4 as error")
    return sorted(map(tuple, vector_codes.compressed(df).collect()), key=repr)


def test_codes_equal_sql(spark):
    same(op11_vector_codes(spark, SMALL), LLM_ORACLE["op11_vector_codes"])


@pytest.mark.parametrize("dim", [8, 16, 19, 3])
def test_codes_equal_plain_codes(spark, dim):
    rng = random.Random(dim)
    rows = [(rng.choice([None, *range(60)]), [rng.choice([rng.gauss(0, 1), 0.5]) for _ in range(dim)], rng.choice([None, 1, 2])) for _ in range(90)]
    rows += rows[:7]  # repeated rows and ids
    assert coded(spark, rows) == plain_codes(rows)


def test_codes_are_exact_beyond_64_bits(spark):
    rows = [(i, [float(i % 5) * 1e14, -1e14 * (i % 3), 1.0 * i, 2e14] * 2, i % 2) for i in range(30)]
    assert coded(spark, rows) == plain_codes(rows)


def test_codes_of_few_and_unfit_vectors(spark):
    fine = [(1, [0.1] * 8, None), (2, [0.2] * 8, None), (3, [-0.3] * 8, 1)]
    unfit = [(4, None, 1), (5, [0.1, None] * 4, 1), (6, [float("nan")] * 8, 1), (7, [float("inf")] * 8, None)]
    assert coded(spark, fine + unfit) == plain_codes(fine)
    assert coded(spark, unfit) == []
    other = [(8, [1.0] * 16, 1), (9, [2.0] * 16, 1)]  # of another length: codebooks of their own
    got = {r[0]: r[1:3] + r[4:] for r in coded(spark, fine + other)}
    assert got == {r[0]: r[1:3] + r[4:] for r in plain_codes(fine) + plain_codes(other)}
    assert coded(spark, [(1, [], None)]) == [(1, "00" * 8, 0, 0, hashlib.sha256(b"").hexdigest())]


def test_codes_in_lots(spark, monkeypatch):
    rows = [(i, [float(i * k % 7) for k in range(8 * (1 + i % 3))], 1) for i in range(40)]
    whole = coded(spark, rows)
    monkeypatch.setattr(vector_codes, "NUMBERS", 200)
    assert coded(spark, rows) == whole


def plain_edits(rows):
    rows = sorted({(i is None, i or 0, t or "") for i, t in rows}, key=lambda r: (r[:2], hashlib.sha256(r[2].encode()).digest()[:16]))
    out = {}
    for n, (none, i, t) in enumerate(rows):
        follower, half = rows[(n + 1) % len(rows)][2], len(t) // 2
        out[None if none else i, t] = (len(t), hashlib.sha256((t[: len(t) - half] + follower[:half]).encode()).hexdigest(), follower)
    return out


def test_fingerprints_of_awkward_rows(spark):
    got = imatch.fingerprints(documents(spark)).collect()
    want = plain_edits(AWKWARD)
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted((str(i), *want[i, t or ""][:2]) for i, t in AWKWARD)
    of = {r["doc_id"]: r for r in got}
    assert of[1]["fingerprint"] == of[5]["fingerprint"] and of[2]["fingerprint"] == of[3]["fingerprint"] != of[4]["fingerprint"]
    assert of[2]["near_next"] == 1.0 and all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))


def test_fingerprints_of_nothing_and_one(spark):
    assert imatch.fingerprints(documents(spark, [])).collect() == []
    (row,) = imatch.fingerprints(documents(spark, [(7, "abcd")])).collect()
    assert row["near_next"] == 1.0 and row["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()


def test_fingerprints_over_many_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(-150, 150)]), " ".join(rng.choices("red green blue a b c d e f g".split(), k=rng.randrange(9)))) for _ in range(400)]
    got = imatch.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9)).collect()
    want = plain_edits(rows)
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted((str(i), *want[i, t][:2]) for i, t in rows)


def test_fingerprints_tell_edits_from_other_texts(spark):
    rows = op12_imatch(spark, SMALL).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in small(spark, "documents").collect()}
    assert len(rows) == len(texts) and {r["doc_id"] for r in rows} == texts.keys()
    by_text = defaultdict(set)
    for r in rows:
        by_text[texts[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(s) == 1 for s in by_text.values()) and len({s for (s,) in by_text.values()}) == len(by_text)
    assert sum(r["near_edited"] > r["near_next"] for r in rows) > 0.9 * len(rows)


def test_likeness_equals_its_definition(spark):
    docs = small(spark, "documents").limit(60).select("doc_id", "text")
    rows = imatch.fingerprints(docs).orderBy("doc_id").collect()
    marks = lambda s: {s[i : i + 6] for i in range(0, len(s), 6)}

    def like(x, y):
        if x == y:
            return 1.0
        (_, a, *p), (_, b, *q) = x.split(":"), y.split(":")
        pairs = {0: [(0, 0), (1, 1)], 1: [(1, 0)], -1: [(0, 1)]}.get(int(b) - int(a), [])
        either = sum(len(marks(p[i]) | marks(q[j])) for i, j in pairs)
        return sum(len(marks(p[i]) & marks(q[j])) for i, j in pairs) / either if either else 0.0

    for r, after in zip(rows, rows[1:] + rows[:1], strict=True):
        assert r["near_edited"] == pytest.approx(like(r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(like(r["fingerprint"], after["fingerprint"]))


def test_native_plan(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    plan = imatch.fingerprints(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_audit(rows, min_docs, k):
    docs = [tuple(x or "" for x in r) for r in rows]
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    df, cnt, out = Counter(), Counter(), []
    for lang, source, text in docs:
        for t, n in Counter(terms(text)).items():
            df[lang, t] += 1
            cnt[lang, source, t] += n
    for lang in {d[0] for d in docs}:
        kept = [t for (of, t), n in df.items() if of == lang and n >= min_docs]
        sources = sorted({d[1] for d in docs if d[0] == lang})
        ps = {}
        for s in [None, *sources]:
            c = {t: sum(cnt[lang, x, t] for x in (sources if s is None else [s])) for t in kept}
            ps[s] = {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        for s in sources:
            pairs = [(-sum(abs(ps[s][t] - ps[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            own = [(ps[None][t] - ps[s][t], t.encode()) for t in kept if cnt[lang, s, t] and ps[s][t] > ps[None][t]]
            for part, of in (("pair", sorted(pairs)), ("term", sorted(own)[:k])):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(of, 1)]
    return sorted(out)


def audited(spark, rows, min_docs=1, k=50):
    df = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 as doc_id", "2 as g", "'x' as term", "3 as n", "4 as p", "5 as value")
    return sorted(map(tuple, divergence.audit(df, min_docs, k).collect()))


def test_audit_equals_sql(spark):
    same(op13_divergence(spark, SMALL), LLM_ORACLE["op13_divergence"])


@pytest.mark.parametrize(("min_docs", "k"), [(1, 3), (2, 5), (4, 50), (99, 3)])
def test_audit_equals_plain_audit(spark, min_docs, k):
    rng = random.Random(k)
    words = ["red", "Red", "rED", "é", "É", "a", "ab", "abc", "abcd", "abcde", "abcdf", "b", "漢字", "x1y", "\U0001f600"]
    rows = [(rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", "S", None, "é"]), " ".join(rng.choices(words, k=rng.randrange(12)))) for _ in range(60)]
    rows += [("zz", "lone", None), ("yy", "p", "1 2"), ("yy", "q", ""), *rows[:5]]
    assert audited(spark, rows, min_docs, k) == plain_audit(rows, min_docs, k)


def test_ties_go_by_bytes_however_long(spark):
    long = "z" * 9_001
    terms = [long + c for c in ("a", "b", "é")] + ["z" * n for n in (1, 2, 3, 4)] + ["zé", "aa"]
    rows = [("en", "s", " ".join(terms)), ("en", "t", "other other"), ("en", "u", " ".join(terms[::-1]))]
    for k in (1, 4, 7, 8):
        assert audited(spark, rows, 1, k) == plain_audit(rows, 1, k)


def test_audit_of_nothing(spark):
    assert audited(spark, []) == []


def test_audit_in_shuffled_joins(spark, monkeypatch):
    rows = [("en", f"s{i % 7}", f"w{chr(97 + i % 11)} all u{chr(97 + i % 3)}") for i in range(80)]
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(divergence, "HELD", 5)
    monkeypatch.setattr(divergence, "BLOCK", 8)
    assert audited(spark, rows, 2, 4) == plain_audit(rows, 2, 4)


def test_shares_beyond_64_bits(spark):
    big = spark.createDataFrame([(3 * 10**12, 7 * 10**13, 1000)], "c bigint, n bigint, v bigint")
    assert big.select(divergence.share("c", "n", "v")).first()[0] == 1 + 10**9 * (3 * 10**12 + 5) // (7 * 10**13 + 5000)


def test_lexicon_band(spark):
    docs = documents(spark, [(i, "all " + ("half " if i % 2 else "") + f"own{chr(97 + i)}") for i in range(20)])
    kept = {r["term"] for r in imatch.lexicon(docs, 0.5, 2.0).collect()}
    assert kept == {"half"} and docs.where(F.lit(False)).count() == 0


def test_a_list_of_hashes_is_filtered_once(spark):
    """Each subset would else go through all terms of its text again: the few that any subset holds are a column of their own."""
    terms = spark.createDataFrame([(f"t{i}",) for i in range(40)], "term string")
    texts = spark.createDataFrame([(1, "t1 t2 t3 t4", "t1 t2")], "k int, t0 string, t1 string").withColumn("of", F.struct(F.lit(1).alias("x")))
    plan = imatch.signatures(texts, terms)._jdf.queryExecution().optimizedPlan().toString()
    assert [len(re.findall(rf"\bfilter\(h{i}#", plan)) for i in (0, 1)] == [1, 1]
    assert not re.search(r"filter\(filter\(", plan)
