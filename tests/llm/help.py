"""Small tables with every awkward case."""

import public_tokenizers

BPE = public_tokenizers.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"

AWKWARD = [
    (1, "a b c d e f g h"),
    (2, None),
    (3, ""),
    (4, " \t\n"),
    (5, "a b c d e f g h"),
    (5, "a b c d e f g h"),
    (6, "<|endoftext|> x  y\n z<|endoftext|>"),
    (7, "É漢字   \x85 it's  we'll\r\n\tx 12345 !!! \U0001f600"),
    (8, "word " * 30_000),
    (None, "no id here at all ok"),
]


def documents(spark, rows=AWKWARD, clash=True):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    if clash:  # names that the operators use inside
        df = df.selectExpr("*", "1 as fp", "'z' as hash", "2 as n", "3 as item_id", "4 as h", "5 as count", "array(1L) as keys", "0 as component_id", "'q' as w", "6 as gone", "7 as piece", "8 as score")
    return df


def small(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")
