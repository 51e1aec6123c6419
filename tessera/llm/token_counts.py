"""Token counts of whole texts; huge documents by overlapping chunks that are spliced where both sides provably agree.

A chunk of a huge document is encoded with offsets. Where both the end of one chunk and the beginning of the next have a cut of
the split expression at the same place, everything after it is the same in either: the expression goes from left to right and
remembers nothing over a cut. A cut counts if the left chunk goes on far enough beyond it (the longest added token and two
characters) that its own end cannot have made it. If no cut agrees, the overlap is doubled, at last to the whole text. Files
of tokenizers for which this isn't proven are encoded whole.

Null and empty texts have 0 tokens. Rows stay rows: repeated ids are counted one by one. An empty table gives none. Very long
texts are counted whole; a single word of more than a chunk, such as a run of white space, goes to the library in one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import ByteLevel, Library, load
from tessera.llm.common import documents_of, tidy

CHUNK, OVERLAP = 32_768, 512


def _cuts(tokenizer: ByteLevel, text: str) -> tuple[dict[int, int], int]:
    """Places where the split expression cuts ``text``, each with the number of tokens before it; the number of all."""
    e = tokenizer.own.encode(text, add_special_tokens=False)
    cuts, last = {}, None
    for i, (word, (start, _)) in enumerate(zip(e.word_ids, e.offsets, strict=True)):
        if word != last or word is None:
            cuts.setdefault(start, i)
            last = word
    return cuts, len(e.ids)


def count_huge(tokenizer: Library, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text``, never holding the encoding of more than a chunk, its overlap included."""
    if not isinstance(tokenizer, ByteLevel):
        return tokenizer.count(text)
    margin = max([0, *map(len, tokenizer.specials)]) + 2
    total, start = 0, 0
    left, whole = _cuts(tokenizer, text[: chunk])
    left_from = 0  # tokens of the left chunk that are counted already
    while start + chunk < len(text):
        end, wide = start + chunk, overlap
        while True:
            begin = max(start + 1, end - wide)
            right, right_whole = _cuts(tokenizer, text[begin : begin + chunk])
            agreed = [p for p in range(begin + 1, end - margin + 1) if p - start in left and p - begin in right and left[p - start] >= left_from]
            if agreed or begin == start + 1:
                break
            wide *= 2
        if not agreed:
            return tokenizer.count(text)
        at = agreed[len(agreed) // 2]
        total += left[at - start] - left_from
        left, whole, left_from, start = right, right_whole, right[at - begin], begin
    return total + whole - left_from


def token_counts(docs: DataFrame, path: str, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit); one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for b in batches:
            n = [tokenizer.count(t) if len(t) <= chunk else count_huge(tokenizer, t, chunk, overlap) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    d = documents_of(docs).withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    return d.mapInArrow(tidy(run), "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
