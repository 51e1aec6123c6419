"""Removal of repeated 100-byte strings, by column-wise construction of the transforms and common prefixes of collections.

A string is a window of SPAN bytes; the later starts of an equal window lose its bytes. Order is by document (doc_id, then a hash
of the text for rows that share an id), then by start.

1. Anchors. Each window names an anchor: its 32-byte substring with the smallest hash, the leftmost of equals. Equal windows have
   equal anchors at the same place, so windows can be dealt to tasks by anchor and none is lost. Successive windows with one
   anchor make a piece: at most 68 bytes before the anchor to 68 after it.
2. Anchors are counted (pre-aggregated); those that occur once can hold no repeat. The rest are written as sorted files into
   the shared folder, and a second pass over the texts sends only pieces of repeated anchors, each distinct piece of a chunk
   of text once, with the list of its places.
3. The distinct pieces of a task's anchors are the documents of collections. They are laid side by side, aligned at the anchor.
   Each round inserts one symbol of every piece, from the last column to the first, and extends the collection's Burrows-Wheeler
   transform and its array of common prefixes by what belongs to the new suffixes: the inserted symbols in the order of the
   suffixes so far, and, after a stable sort by them, range minima of the last common prefixes between neighbours. Both arrays
   are written round by round to sequential files in the shared folder, so a task holds one round; aligned pieces never
   need the order between suffixes of different columns, so nothing before the last round is read again meanwhile.
4. The files are read once more from their beginning: the transform gives the order of the suffixes back, round by round, and where
   a window can start, runs of common prefixes of at least SPAN are equal windows; the first of them stays.
5. Hot anchors, with more than HOT places (a licence line, a text with many copies), are taken in a pass of their own. The first place
   of each distinct piece is found by partial minima, and all other places of the piece are lost. If an anchor still has
   more than HOT distinct pieces, their windows are dealt on by a 128-bit hash of the whole window, again with partial minima;
   else its pieces go through step 3 with the first places alone. Joins back to places are salted.
6. The removed ranges of a document meet its text in a join, and are cut out. Texts without a removed range don't move.

The textbook method keeps one transform of all suffixes of all documents and needs as many rounds as the longest document has bytes,
each over everything; here a collection needs 168 rounds over its own pieces. Collections end at about COLLECTION pieces.

Null and empty texts keep their 0 bytes. Rows with the same id and text are one document; each such row gets its result. Null ids
come after all others. Long texts are read in overlapping segments of CHUNK bytes. An empty table gives no rows. Nothing is
sampled or capped.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import salted_join, small_batches, tidy
from tessera.llm.mapped import among, keys_of, load_bytes, remove, save_bytes, save_keys, shared_folder
from tessera.plans.lineage import written

SPAN, ANCHOR = 100, 32
REACH = SPAN - ANCHOR  # places of an anchor before its window's last
WIDTH = SPAN + REACH  # columns of a collection; the anchor begins at column REACH
#: Bytes of text that are hashed at once; pieces in a collection; places of an anchor that aren't hot; bytes of a sequential file.
CHUNK, COLLECTION, HOT, FILE_BYTES = 1 << 19, 8_192, 4_096, 4 << 20
_POSITION = np.uint64((1 << 32) - 1)
_TABLE = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, 1 << k, 1 << 64)) for k in range(5)]
_MIX, _SPREAD = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)
PIECES = "anchor bigint, inside int, piece binary, ds array<bigint>, ths array<bigint>, places array<bigint>"
RANGES = "d bigint, th bigint, start bigint, stop bigint"


def pieces(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: for each piece its text, first and last window start, anchor place (all in ``data``), anchor hash."""
    none = np.empty(0, dtype=np.int64)
    if len(data) < SPAN:
        return none, none, none, none, np.empty(0, dtype=np.uint64)
    h = _TABLE[data]
    for k, factor in enumerate(_FACTORS):  # hashes of 2, 4, ... 32 bytes
        step = 1 << k
        h = h[:-step] * factor + h[step:]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    low = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= REACH + 1:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = REACH + 1 - size
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    at = (low & _POSITION).astype(np.int64)  # the anchor of the window that starts here
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(lengths)), lengths)[: len(at)]
    starts = np.flatnonzero(np.arange(len(at)) + SPAN <= ends[text])
    if not len(starts):
        return none, none, none, none, np.empty(0, dtype=np.uint64)
    at, text = at[starts], text[starts]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    last = np.append(new[1:], len(starts)) - 1
    anchor = h[at[new]]
    anchor = (anchor ^ (anchor >> np.uint64(31))) * _SPREAD  # anchors have small hashes; their leading bits shall be even
    return text[new], starts[new], starts[last], at[new], anchor ^ (anchor >> np.uint64(33))


def _chunks(b: pa.RecordBatch) -> Iterator[tuple[list, list, np.ndarray, np.ndarray, list]]:
    """Some texts or segments at a time: ids, text hashes, bytes end to end, lengths, and where in its text each begins.

    A window lies in one segment of its text at least, and begins in one alone.
    """
    ids, hashes, texts = b.column("d").to_pylist(), b.column("th").to_pylist(), b.column("text")
    held: list[tuple[int, int, bytes, int]] = []
    total = 0

    def out() -> tuple[list, list, np.ndarray, np.ndarray, list]:
        return [h[0] for h in held], [h[1] for h in held], np.frombuffer(b"".join(h[2] for h in held), np.uint8), np.array([len(h[2]) for h in held]), [h[3] for h in held]

    for d, th, text in zip(ids, hashes, texts, strict=True):
        text = text.as_buffer()
        for at in range(0, max(text.size - SPAN + 1, 1), CHUNK):
            held.append((d, th, text.slice(at, min(CHUNK + SPAN - 1, text.size - at)).to_pybytes(), at))
            total += len(held[-1][2])
            if total >= CHUNK:
                yield out()
                held, total = [], 0
    if held:
        yield out()


def _ordered_ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of True along each row: row, first and last column."""
    edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


class Transform:
    """Transform and common prefixes of one collection: a slice of each for every round, in sequential files of the shared folder."""

    def __init__(self, folder: str, kind: np.dtype, size: int):
        self.folder, self.kind, self.size = folder, kind, size
        self.label, self.files, self.held = f"{os.getpid()}-{os.urandom(8).hex()}", [], bytearray()

    def append(self, symbols: np.ndarray, common: np.ndarray) -> None:
        self.held += symbols.tobytes()
        self.held += common.tobytes()
        if len(self.held) >= FILE_BYTES:
            self.flush()

    def flush(self) -> None:
        self.files.append(f"{self.label}-{len(self.files):05d}")
        save_bytes(self.folder, self.files[-1], bytes(self.held))
        self.held.clear()

    def slices(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(symbols, common) of each round, from the first on."""
        if self.held:
            self.flush()
        of_symbols = self.size * np.dtype(self.kind).itemsize
        for name in self.files:  # a file holds whole rounds
            data = load_bytes(self.folder, name)
            for at in range(0, len(data), of_symbols + self.size):
                yield np.frombuffer(data, self.kind, self.size, at), np.frombuffer(data, np.uint8, self.size, at + of_symbols)

    def close(self) -> None:
        remove(self.folder, self.files)


def construct(columns: np.ndarray, transform: Transform) -> None:
    """Inserts the symbols of ``columns``, the last first: a row for each of WIDTH columns, 0 where a piece isn't there."""
    m = columns.shape[1]
    order, common = np.arange(m), np.zeros(m, dtype=np.uint8)
    for t in range(WIDTH - 1, -1, -1):
        symbols = columns[t][order]
        moved = np.argsort(symbols, kind="stable")
        inserted = symbols[moved]
        new = np.zeros(m, dtype=np.uint8)
        if m > 1:
            bounds = np.stack([moved[:-1] + 1, moved[1:] + 1], axis=1).ravel()
            least = np.minimum.reduceat(np.append(common, np.uint8(0)), bounds)[::2]
            new[1:] = np.where(inserted[1:] == inserted[:-1], least + 1, 0)
        order, common = order[moved], new
        transform.append(symbols, common)


def first_owners(transform: Transform, start: np.ndarray, stop: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which windows of a collection are first of their kind, read from its files.

    Windows of a piece start in columns ``start`` to ``stop`` (at most REACH); ``rank`` orders the pieces by their first place.
    Returns a row for each piece.
    """
    m = transform.size
    order = np.arange(m)
    owner = np.zeros((m, REACH + 1), dtype=bool)
    for t, (symbols, common) in zip(range(WIDTH - 1, -1, -1), transform.slices(), strict=True):
        order = order[np.argsort(symbols, kind="stable")]
        if t <= REACH:
            here = (start[order] <= t) & (stop[order] >= t)
            group = np.flatnonzero(np.concatenate([[True], common[1:] < SPAN]))
            ranks = np.where(here, rank[order], m)
            least = np.repeat(np.minimum.reduceat(ranks, group), np.diff(np.append(group, m)))
            owner[order[here & (ranks == least)], t] = True
    return owner


def merged(d: np.ndarray, th: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    """Ranges of which none overlaps or touches another of its document."""
    order = np.lexsort((start, th, d))
    d, th, start, stop = d[order], th[order], start[order], stop[order]
    if len(d):
        of = np.cumsum(np.concatenate([[0], (d[1:] != d[:-1]) | (th[1:] != th[:-1])]))
        room = int(stop.max()) + 1
        far = np.maximum.accumulate(stop + of * room) - of * room  # the farthest end so far in its document
        new = np.concatenate([[True], (of[1:] != of[:-1]) | (start[1:] > far[:-1])])
        at = np.flatnonzero(new)
        d, th, start, stop = d[at], th[at], start[at], far[np.append(at[1:], len(far)) - 1]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (d, th, start, stop)], ["d", "th", "start", "stop"])


def _solve(rows: list[tuple[bytes, int, list, list, list]], folder: str) -> pa.RecordBatch:
    """Removed ranges (d, th, start, stop) from distinct-in-chunk pieces: bytes, place of the anchor in it, places."""
    number: dict[tuple[bytes, int], int] = {}
    piece = np.array([number.setdefault((r[0], r[1]), len(number)) for r in rows])
    of = np.repeat(piece, [len(r[2]) for r in rows])
    d, th, at = (np.concatenate([np.asarray(r[k], dtype=np.int64) for r in rows]) for k in (2, 3, 4))
    m = len(number)
    columns = np.zeros((m, WIDTH), dtype=np.uint16)
    start, size = np.empty(m, dtype=np.int64), np.empty(m, dtype=np.int64)
    for i, (data, anchor) in enumerate(number):
        start[i], size[i] = REACH - anchor, len(data)
        columns[i, start[i] : start[i] + len(data)] = np.frombuffer(data, np.uint8)
        columns[i, start[i] : start[i] + len(data)] += 1
    known = np.unique(columns)
    if len(known) <= 256:
        columns = np.searchsorted(known, columns).astype(np.uint8) if known[0] == 0 else (np.searchsorted(known, columns) + 1).astype(np.uint8 if len(known) < 256 else np.uint16)
    by_place = np.lexsort((at, th, d, of))
    firsts = by_place[np.concatenate([[True], of[by_place][1:] != of[by_place][:-1]])]  # the first place of each piece
    rank = np.empty(m, dtype=np.int64)
    rank[np.lexsort((at[firsts], th[firsts], d[firsts]))] = np.arange(m)
    stop = start + size - SPAN
    transform = Transform(folder, columns.dtype, m)
    construct(np.ascontiguousarray(columns.T), transform)
    owner = first_owners(transform, start, stop, rank)
    transform.close()
    t = np.arange(REACH + 1)
    lost = ~owner & (t >= start[:, None]) & (t <= stop[:, None])
    row, a, z = _ordered_ranges(lost)
    later = np.ones(len(of), dtype=bool)
    later[firsts] = False
    p, q = firsts[row], np.flatnonzero(later)
    begin = np.concatenate([at[p] + a - REACH, at[q] + start[of[q]] - REACH])
    end = np.concatenate([at[p] + z - REACH + SPAN, at[q] + start[of[q]] - REACH + size[of[q]]])
    both = np.concatenate([p, q])
    return merged(d[both], th[both], begin, end)


def sent_pieces(keyed: DataFrame, folder: str, bits: int) -> DataFrame:
    """(anchor, inside, piece, ds, ths, places) of anchors in the key files: distinct pieces of a chunk, the place of the anchor in them, places."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = keys_of(folder, bits)
        for b in batches:
            for ids, hashes, data, lengths, offsets in _chunks(b):
                text, first, last, at, anchor = pieces(data, lengths)
                begins = np.cumsum(lengths) - lengths - np.array(offsets, dtype=np.int64)
                raw = data.tobytes()
                places: dict[tuple[int, int, bytes], tuple[list, list, list]] = {}
                rows = np.flatnonzero(wanted.has(anchor))
                for k, i, j, p, t in zip(anchor[rows].view(np.int64).tolist(), first[rows].tolist(), last[rows].tolist(), at[rows].tolist(), text[rows].tolist(), strict=True):
                    d, th, a = places.setdefault((k, p - i, raw[i : j + SPAN]), ([], [], []))
                    d.append(ids[t])
                    th.append(hashes[t])
                    a.append(p - int(begins[t]))
                lists = pa.list_(pa.int64())
                cols = [pa.array([k[0] for k in places], pa.int64()), pa.array([k[1] for k in places], pa.int32()), pa.array([k[2] for k in places], pa.binary()), *(pa.array([v[c] for v in places.values()], lists) for c in range(3))]
                yield pa.RecordBatch.from_arrays(cols, ["anchor", "inside", "piece", "ds", "ths", "places"])

    return keyed.mapInArrow(tidy(send), PIECES)


def solved(sent: DataFrame, folder: str) -> DataFrame:
    """Removed ranges of pieces, by collections of whole anchors."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[bytes, int, list, list, list]] = []
        now = None
        for b in batches:
            for k, *row in zip(*(b.column(c).to_pylist() for c in ("anchor", "piece", "inside", "ds", "ths", "places")), strict=True):
                if k != now and len(rows) >= COLLECTION:
                    yield _solve(rows, folder)
                    rows = []
                now = k
                rows.append(tuple(row))
        if rows:
            yield _solve(rows, folder)

    return sent.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(tidy(solve), RANGES)


def hot_ranges(sent: DataFrame, folder: str) -> DataFrame:
    """Removed ranges of the pieces of hot anchors; see step 5."""
    sent = written(sent, "hot-pieces")
    piece = ["anchor", "inside", "piece"]
    place = F.arrays_zip(F.col("ds").alias("d"), F.col("ths").alias("th"), F.col("places").alias("at"))
    firsts = written(sent.groupBy(*piece).agg(F.min(F.array_min(place)).alias("first")), "hot-firsts")

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(x) for x in b.column("ds").to_pylist()]
            of = np.repeat(np.arange(len(n)), n)
            d, th, at = (np.array([y for x in b.column(c).to_pylist() for y in x], dtype=np.int64) for c in ("ds", "ths", "places"))
            first = [np.array([x[c] for x in b.column("first").to_pylist()], dtype=np.int64)[of] for c in ("d", "th", "at")]
            lost = (d != first[0]) | (th != first[1]) | (at != first[2])
            start = at - b.column("inside").to_numpy()[of]
            yield merged(d[lost], th[lost], start[lost], (start + b.column("size").to_numpy()[of])[lost])

    lost = salted_join(sent, firsts, piece).select("inside", F.octet_length("piece").alias("size"), "ds", "ths", "places", "first").mapInArrow(tidy(others), RANGES)
    kinds = written(firsts.groupBy("anchor").agg(F.count("*").alias("n")), "hot-kinds")
    counted = salted_join(firsts, kinds, ["anchor"])
    few = counted.where(F.col("n") <= HOT).select(*piece, *[F.array(f"first.{c}").alias(name) for c, name in (("d", "ds"), ("th", "ths"), ("at", "places"))])
    lost = lost.unionByName(solved(few, folder))
    if kinds.where(F.col("n") > HOT).isEmpty():
        return lost
    windows = counted.where(F.col("n") > HOT).select("piece", "inside", "first", F.explode(F.sequence(F.lit(0), F.octet_length("piece") - SPAN)).alias("k"))
    window = F.unhex(F.md5(F.substr("piece", F.col("k") + 1, F.lit(SPAN)))).alias("w")
    windows = written(windows.select(window, F.struct("first.d", "first.th", (F.col("first.at") - F.col("inside") + F.col("k")).alias("start")).alias("place")), "hot-windows")
    owners = written(windows.groupBy("w").agg(F.min("place").alias("owner"), F.count("*").alias("n")).where("n > 1").select("w", "owner"), "hot-owners")
    later = salted_join(windows, owners, ["w"]).where("place <> owner").select("place.d", "place.th", "place.start", (F.col("place.start") + SPAN).alias("stop"))
    return lost.unionByName(later)


def removed_ranges(keyed: DataFrame) -> DataFrame:
    """(d, th, start, stop) in bytes, overlapping ones included; ``keyed`` has d, th and text (binary)."""
    transforms = shared_folder(keyed.sparkSession, "transforms")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, lengths, _ in _chunks(b):
                seen, n = np.unique(pieces(data, lengths)[4], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(n.astype(np.int32))], ["anchor", "n"])

    counted = keyed.mapInArrow(tidy(anchors), "anchor bigint, n int").groupBy(F.col("anchor").alias("key")).agg(F.sum("n").alias("n"))
    counted = written(counted.where("n > 1"), "anchors")
    usual, hot = counted.agg(F.count_if(F.col("n") <= HOT), F.count_if(F.col("n") > HOT)).first()
    found = solved(sent_pieces(keyed, *save_keys(counted.where(F.col("n") <= HOT), "usual-anchors", usual)), transforms)
    if not hot:
        return found
    return found.unionByName(hot_ranges(sent_pieces(keyed, *save_keys(counted.where(F.col("n") > HOT), "hot-anchors", hot)), transforms))


def deduplicated(docs: DataFrame, whole_characters: bool = False) -> DataFrame:
    """Each row of ``docs`` (doc_id, text and any other columns) with kept (binary), n_bytes, n_removed and n_spans.

    whole_characters drops, from kept, what is left of a character that was cut.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(docs["text"], F.lit("")).cast("binary")
    d = docs.select(F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row"), F.coalesce(docs["doc_id"].cast("bigint"), F.lit(2**63 - 1)).alias("d"), F.xxhash64(text).alias("th"), text.alias("text"))
    found = removed_ranges(d.select("d", "th", "text"))
    cuts = found.groupBy("d", "th").agg(F.collect_set(F.struct("start", "stop")).alias("cuts")).select(F.col("d").alias("cd"), F.col("th").alias("cth"), F.col("cuts.start").alias("starts"), F.col("cuts.stop").alias("stops"))
    cuts = written(cuts, "cuts")
    key, keys = F.xxhash64(d["d"], d["th"]), cuts.select(F.xxhash64("cd", "cth").alias("key")).distinct()
    joined = among(d, key, keys, "cut-rows").join(cuts, (d["d"] == cuts["cd"]) & (d["th"] == cuts["cth"]), "left").select("row", "text", "starts", "stops")
    none = F.lit(0).cast("bigint")
    whole = among(d, key, keys, "whole-rows", without=True).select("row", F.col("text").alias("kept"), F.octet_length("text").cast("bigint").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [cut_out(t, s, z) for t, s, z in zip(*(b.column(c).to_pylist() for c in ("text", "starts", "stops")), strict=True)]
            sizes = [len(t) for t in b.column("text").to_pylist()]
            if whole_characters:
                out = [(x.decode("utf-8", "ignore").encode() if n else x, n) for x, n in out]
            cols = [b.column("row"), pa.array([o[0] for o in out], pa.binary()), pa.array(sizes, pa.int64()), pa.array([n - len(o[0]) for n, o in zip(sizes, out, strict=True)], pa.int64()), pa.array([o[1] for o in out], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["row", "kept", "n_bytes", "n_removed", "n_spans"])

    schema = joined.select("row").schema.add("kept", "binary").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")
    return joined.mapInArrow(tidy(cut), schema).unionByName(whole)


def cut_out(text: bytes, starts: list[int] | None, stops: list[int] | None) -> tuple[bytes, int]:
    """``text`` without the ranges, and the number of maximal removed runs."""
    if not starts:
        return text, 0
    kept, at, spans, end = [], 0, 0, -1
    for i, j in sorted(zip(starts, stops, strict=True)):
        if i > end:
            kept.append(text[at:i])
            spans += 1
        end = max(end, j)
        at = end
    return b"".join(kept) + text[at:], spans


def digest(result: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    return result.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated strings cut out of their texts; a character of which a byte went goes whole."""
    result = deduplicated(docs, whole_characters=True)
    text = F.col("kept").cast("string")
    columns = [text.alias("text") if c == "text" else F.char_length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns]
    return result.select(*columns)
