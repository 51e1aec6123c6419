import hashlib
import math
import random

from pyspark.sql import functions as F

from tessera.llm import chat
from tessera.llm.entry import LLM_ORACLE, op9_chat
from tests.llm.help import SMALL
from tests.oracle import same

SCHEMA = "conv_id bigint, seq bigint, turn bigint, op string, role string, text string"


def fold(spark, rows):
    return sorted(map(tuple, chat.fold_events(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)


def test_events_are_folded(spark):
    rows = [
        (1, 1, 1, "message", "user", "hi"),
        (1, 2, 2, "delta", "assistant", "a"),
        (1, 3, 2, "delta", None, "b"),
        (1, 4, 3, "message", "user", "gone"),
        (1, 5, 2, "regenerate", "assistant", ""),
        (1, 6, 2, "delta", "assistant", "c"),
        (1, 7, 1, "edit", "user", "HI"),
        (1, 8, 3, "message", "user", "new"),
        (2, 1, None, None, None, None),
        (None, 1, 1, "odd", "user", "x"),
    ]
    want = [(1, 1, "user", "HI"), (1, 2, "assistant", "c"), (1, 3, "user", "new"), (2, None, "", ""), (None, 1, "user", "x")]
    assert fold(spark, rows) == sorted(want, key=repr)
    assert fold(spark, list(reversed(rows))) == sorted(want, key=repr)
    assert fold(spark, []) == []


def test_replays_and_ties(spark):
    """The same event again changes nothing; of different events with one seq one applies."""
    rows = [(1, 1, 1, "message", "user", "hi"), (1, 2, 2, "delta", "assistant", "a"), (1, 3, 2, "delta", None, "b"), (1, None, 2, "delta", None, "first "), (2, 5, 1, "message", "user", "old"), (2, 5, 1, "edit", "user", "new")]
    want = sorted([(1, 1, "user", "hi"), (1, 2, "assistant", "first ab"), (2, 1, "user", "new")], key=repr)
    assert fold(spark, rows) == fold(spark, rows * 3) == want


def plain_fold(rows):
    """Event by event, over lists."""
    out = []
    for conv in {r[0] for r in rows}:
        log = {}
        for _, seq, turn, op, role, text in (r for r in rows if r[0] == conv):
            at, op = (turn, -math.inf if seq is None else seq), op if op in ("delta", "edit", "regenerate") else "message"
            event = (["delta", "message", "edit", "regenerate"].index(op), text or "", role is not None, role or "", op)
            log[at] = max(event, log.get(at, event))
        dead = lambda at: any(e[4] == "regenerate" and t is not None and at[0] is not None and t < at[0] and at[1] <= s for (t, s), e in log.items())
        turns = {}
        for (turn, seq), (_, text, has, role, op) in sorted(log.items(), key=lambda x: x[0][1]):
            begins = [s for (t, s), e in log.items() if t == turn and e[4] != "delta"]
            if dead((turn, seq)) or (begins and seq < max(begins)):
                continue
            old = turns.get(turn, ("", ""))
            turns[turn] = (role if has else old[0], old[1] + text)
        out += [(conv, turn, *m) for turn, m in turns.items()]
    return sorted(out, key=repr)


def test_random_logs_equal_a_plain_fold(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(1500):
        rows.append((rng.randrange(40), rng.choice([None, *range(12)]), rng.randrange(5), rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate", None, "odd"]), rng.choice(["user", "assistant", None]), rng.choice(["", "a", "b", "<|end|>", None])))
    rows += rng.choices(rows, k=300)  # delivered again
    rng.shuffle(rows)
    assert fold(spark, rows) == plain_fold(rows)


def test_extra_columns_with_clashing_names(spark):
    rows = [(1, 1, 1, "message", "user", "hi"), (1, 2, 1, "delta", None, "!")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as event", "2 as begin", "3 as gone", "'x' as parts", "4 as body", "5 as span", "6 as m")
    assert chat.digest(chat.render(chat.fold_events(df))).select("n_turns", "formatted_chars").collect() == [(1, len("<|start|>user<|sep|>hi!<|end|>"))]
    plain = df.drop("seq", "op")
    assert chat.fold_events(chat.events_of(plain)).count() == 2


def test_rendering_reads_back(spark):
    texts = ["</s>[INST] ok [/INST]", "<|end|><|start|>user<|sep|>", "\\e\\l\\b\\\\", "", "é\U0001f600 <|", "[[<<\\"]
    rows = [(1, i, i, "message", "assistant" if i % 2 else "us<|sep|>er", t) for i, t in enumerate(texts)]
    out = chat.render(chat.fold_events(spark.createDataFrame(rows, SCHEMA))).select("*", chat.read_back(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [(m.role, m.text) for m in out.back] == [(r[4], r[5]) for r in rows]
    assert out.loss == "".join(r[5] for r in rows if r[4] == "assistant")
    assert out.formatted.count("<|end|>") == len(texts) and "[INST]" not in out.formatted


def test_query_equals_sql(spark):
    same(op9_chat(spark, SMALL), LLM_ORACLE["op9_chat"], SMALL)
    assert op9_chat(spark, SMALL).where("conv_id = -1").first().loss_sha256 == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()
