"""Token ids and token counts of whole texts by a public tokenizer file, for use inside tasks.

A byte-level BPE without normaliser cuts a text by a regular expression first and merges inside the cuts only. A blank after
a character that is no white space always begins a new cut, and what the expression finds after a cut does not depend on what
is before it. So the ids of a text are the ids of its blank-led words in turn, and a word need be encoded once per worker. Words
of more than LONG_WORD characters (runs of white space, data without blanks) go to the file's library one by one: the fast
encoder's expressions are not made for them, and they aren't remembered. The ids are those of the library for the file;
tests hold them against it. Files of another kind go to their library directly.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import cached_property, lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words that a worker remembers at most; at that number it begins anew.
MEMO_WORDS = 120_000
#: Characters of a word that the fast encoder takes.
LONG_WORD = 1_000
#: The public split expression of byte-level BPE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BLANK_AFTER_SPACE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) ")


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others, in order, as the code points from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Library:
    """Any tokenizer file through its own library."""

    def __init__(self, path: str):
        self.path, self.specials = path, ()
        if path.endswith(".model"):
            import sentencepiece

            own = sentencepiece.SentencePieceProcessor(model_file=path)
            self.ids = lambda text: array("I", own.encode(text, num_threads=1))
        else:
            self.ids = lambda text: array("I", self.own.encode(text, add_special_tokens=False).ids)

    @cached_property
    def own(self):  # noqa: ANN201
        """The library's tokenizer, loaded when it is first needed."""
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(self.path)
        own.no_truncation()
        own.no_padding()
        return own

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return self.ids(text).tobytes()

    def count(self, text: str) -> int:
        return len(self.ids(text))


class ByteLevel(Library):
    """A byte-level BPE file, word by word; see the head of this module."""

    def __init__(self, path: str, vocab: dict[str, int], specials: dict[str, int]):
        import tiktoken

        super().__init__(path)
        of = _byte_of_symbol()
        ranks = {bytes(of[c] for c in token): i for token, i in vocab.items() if token not in specials}
        self.word_ids = tiktoken.Encoding("words", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.specials = tuple(specials)
        self.special = re.compile("(" + "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")") if specials else None
        self.special_ids = {s: array("I", [i]).tobytes() for s, i in specials.items()}
        self.memo: dict[str, bytes] = {}
        self.sizes: dict[str, int] = {}

    def _words(self, text: str) -> list[str]:
        return _CUT.split(text) if _BLANK_AFTER_SPACE.search(text) else text.split(" ")

    def _word(self, word: str) -> bytes:
        return array("I", self.word_ids(word) if len(word) <= LONG_WORD else self.own.encode(word, add_special_tokens=False).ids).tobytes()

    def _plain(self, text: str) -> bytes:
        words, memo = self._words(text), self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        first, rest = words[0], words[1:]
        long = {}
        for w in set(rest).difference(memo):
            (memo if len(w) < LONG_WORD else long)[w] = self._word(" " + w)
        return self._word(first) + b"".join(map(memo.__getitem__, rest) if not long else (long.get(w) or memo[w] for w in rest))

    def _plain_count(self, text: str) -> int:
        words, sizes = self._words(text), self.sizes
        if len(sizes) > MEMO_WORDS:
            sizes.clear()
        first, rest = words[0], words[1:]
        long = {}
        for w in set(rest).difference(sizes):
            (sizes if len(w) < LONG_WORD else long)[w] = len(self._word(" " + w)) // 4
        return len(self._word(first)) // 4 + sum(map(sizes.__getitem__, rest) if not long else (long.get(w) or sizes[w] for w in rest))

    def encode(self, text: str) -> bytes:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        return b"".join(self.special_ids.get(x) or self._plain(x) for x in self.special.split(text) if x)

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self._plain_count(text)
        return sum(1 if x in self.special_ids else self._plain_count(x) for x in self.special.split(text) if x)


@lru_cache(maxsize=4)
def load(path: str) -> Library:
    """The tokenizer of a file; each worker loads it once."""
    if not path.endswith(".json"):
        return Library(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and spec.get("normalizer") is None
    plain_bpe = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    exact_added = not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if byte_level and plain_bpe and exact_added:
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocab.get("".join(m)) for m in merges]
        if None not in made and made == sorted(made):  # ids follow the order of merges, so they are ranks
            return ByteLevel(path, vocab, {t["content"]: t["id"] for t in added})
    return Library(path)
