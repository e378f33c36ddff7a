"""Removal of repeated strings by column-wise multi-document suffix-array construction.

A byte goes when it lies in a `length`-byte string that also starts elsewhere in the collection.

The collection is cut so that equal strings meet: the least hash among the k-byte substrings of a
`length`-byte window is the same for equal windows, so each run of windows with the same least
hash is one segment and goes to the block of that hash. Segments of equal bytes are counted where
they are found and collapsed; all their windows repeat. Of a hash with two or more different
segments, the segments form a collection of strings, whose Burrows-Wheeler transform and common
prefixes are built column-wise: in each round every string gives one more symbol, from its end
to its start. A round reads transform and prefixes once from front to back: counts of the symbols
passed tell where the new suffixes go (the last-to-first mapping), and the least prefix since a symbol's last
occurrence gives theirs; then it writes both anew with the new rows put in. Both are one
sequence, which is a buffer in memory up to a fixed size and a sequential file in the folder that the cluster shares beyond it. The strings
of a block and the flags of its suffixes are held in memory, which the size of a block bounds. Neighbours that share `length` bytes or more
repeat, and walking the mapping takes them back to places in the texts.

A hash that very many different segments share is not left to one task: its segments are cut once more by longer
substrings, up to whole windows, and meet only those that share these.

Why equal segments are collapsed before: the construction's work is the square of a string's length for each
byte, and most repeats are whole copies, for which counting says the same.

Defined cases: a null text is empty; texts shorter than `length` lose nothing; equal texts lose
the same bytes, and repeated rows count as copies; an empty table gives no rows; further columns are ignored. Texts are known by
a 64-bit hash, and substrings by 64-bit hashes where segments are grouped. A `length` beyond 2^24 - 2 raises ValueError.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accolade.llm import textkit as K
from accolade.llm._shared import scratch, small, stored, table

U64 = np.uint64
LENGTH, SEED_BYTES, MOST_WINDOWS = 200, 150, 256
#: Bytes of a block of segments and of a block of strings; different segments of one hash beyond which it is cut again.
_BLOCK_BYTES, _STRING_BYTES, MOST_SEGMENTS = 8 << 20, 1 << 20, 16_384
#: Entries of a transform that are held in memory, and that are read at once from a file.
_HELD, _PIECE = 4 << 20, 1 << 20
_ENTRY = np.dtype([("seed", "<u8"), ("content", "<u8"), ("text", "<i8"), ("start", "<i4"), ("windows", "<i4"), ("copies", "<i4"), ("inner", "<i4")])


def _window_minima(h: np.ndarray, w: int) -> np.ndarray:
    n = len(h)
    rows = np.full(-(-n // w) * w, U64(2**64 - 1), U64)
    rows[:n] = h
    rows = rows.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def _segments(raw: np.ndarray, at: np.ndarray, length: int, k: int):
    """Row, start, windows, seed hash and content hash of each segment, and whether its seed occurs twice in it, as it must for a window to repeat within."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, none.astype(U64), none.astype(U64), none
    sums = K.prefix_sums(raw)
    begin = np.arange(len(raw) - k + 1)
    h = K.mix((sums.sums[k:] - sums.sums[:-k]) * sums.unscale(begin))
    least = _window_minima(h, length - k + 1)
    row = np.flatnonzero(np.diff(at) >= length)
    change = np.zeros(len(least) + 1, bool)
    change[1:-1] = least[1:] != least[:-1]
    change[at[:-1][row]] = True
    change[at[1:][row] - length + 1] = True
    p = np.flatnonzero(change)
    q = np.r_[p[1:], len(least)]
    owner = np.searchsorted(at[1:], p, "right")
    inside = (p < len(least)) & (q > p)
    inside[inside] &= p[inside] + length <= at[1:][owner[inside]]
    p, q, owner = p[inside], q[inside], owner[inside]
    # A long run of one seed, as periodic text has, is cut; each window stays in exactly one piece.
    pieces = -(-(q - p) // MOST_WINDOWS)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    q = np.minimum(np.repeat(q, pieces), np.repeat(p, pieces) + (nth + 1) * MOST_WINDOWS)
    p, owner = np.repeat(p, pieces) + nth * MOST_WINDOWS, np.repeat(owner, pieces)
    end = q + length - 1
    content = K.mix((sums.sums[end] - sums.sums[p]) * sums.unscale(p) + (end - p).astype(U64))
    seed, w = least[p], length - k + 1
    inner = np.empty(len(p), np.int64)
    for i in range(0, len(p), 20_000):
        j = slice(i, i + 20_000)
        ahead, behind = h[p[j, None] + np.arange(w)] == seed[j, None], h[q[j, None] - 1 + np.arange(w)] == seed[j, None]
        inner[j] = p[j] + ahead.argmax(1) != q[j] - 1 + w - 1 - behind[:, ::-1].argmax(1)
    return owner, p - at[:-1][owner], q - p, seed, content, inner


def _cutter(length: int, k: int, bits: int):
    """Segments by block of their seed; those seen twice in a slice are decided there and pass through (kind 1)."""

    def run(batches):
        seen: dict[int, int] = {}
        for whole in batches:
            for batch in K.slices(whole, "text", 2 << 20):
                texts = batch.column("text_hash").to_pylist()
                # A text's third and later copies in this task add nothing: two have told that it repeats.
                take = []
                for i, t in enumerate(texts):
                    seen[t] = seen.get(t, 0) + 1
                    if seen[t] <= 2:
                        take.append(i)
                batch = batch.take(pa.array(take, pa.int64()))
                raw, at = K.buffers(batch.column("text"))
                row, start, windows, seed, content, inner = _segments(raw, at, length, k)
                x = np.empty(len(row), _ENTRY)
                x["seed"], x["content"], x["start"], x["windows"] = seed, content, start, windows
                x["text"], x["inner"] = batch.column("text_hash").to_numpy()[row], inner
                x = x[np.lexsort((x["content"], x["seed"]))]
                if not len(x):
                    continue
                first = np.flatnonzero(np.r_[True, (x["seed"][1:] != x["seed"][:-1]) | (x["content"][1:] != x["content"][:-1])])
                copies = np.diff(np.r_[first, len(x)])
                known = x[np.repeat(copies > 1, copies)]
                x = x[first]
                x["copies"] = copies
                block = (x["seed"] >> U64(64 - bits)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(block, prepend=-1))
                names = [int(block[i]) for i in cuts]
                packed = [x[i:j].tobytes() for i, j in zip(cuts, [*cuts[1:], len(x)], strict=True)]
                kinds = [0] * len(names)
                for i in range(0, len(known), 50_000):
                    names.append(int(content[i] >> U64(64 - bits)))
                    packed.append(known[i : i + 50_000].tobytes())
                    kinds.append(1)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(kinds, pa.int32()), pa.array(packed, pa.binary())], ["block", "kind", "packed"])

    return run


def _rows(x: np.ndarray, kind: np.ndarray):
    for i in range(0, len(x), 200_000):
        y = x[i : i + 200_000]
        yield pa.RecordBatch.from_arrays([pa.array(kind[i : i + 200_000]), pa.array(y["seed"].copy().view("<i8")), *[pa.array(np.ascontiguousarray(y[c])) for c in ("text", "start", "windows")]], ["kind", "seed", "text_hash", "start", "windows"])


def _group(batches):
    """Of each block: segments whose bytes repeat (kind 1), and one segment of each content of the seeds with several contents, or whose seed occurs twice in it (kind 0, or 2 if it repeats as well)."""

    def flush(parts):
        x = np.frombuffer(b"".join(parts), _ENTRY)
        x = x[np.lexsort((x["start"], x["text"], x["content"], x["seed"]))]
        new_seed = np.r_[True, x["seed"][1:] != x["seed"][:-1]]
        new_content = new_seed | np.r_[True, x["content"][1:] != x["content"][:-1]]
        first = np.flatnonzero(new_content)
        size = np.diff(np.r_[first, len(x)])
        repeats = np.add.reduceat(x["copies"], first) > 1
        found = x[np.repeat(repeats & (size > 0), size)]
        yield from _rows(found, np.ones(len(found), np.int32))
        seeds = np.cumsum(new_seed[first]) - 1
        several = (np.bincount(seeds)[seeds] > 1) | ((x["inner"][first] > 0) & ~repeats)
        # What repeats as a whole still has to meet the others of its seed.
        left = x[first[several]]
        yield from _rows(left, np.where(repeats[several], 2, 0).astype(np.int32))

    now, parts = None, []
    for batch in batches:
        for block, kind, packed in zip(batch.column("block").to_pylist(), batch.column("kind").to_pylist(), batch.column("packed").to_pylist(), strict=True):
            if kind:
                x = np.frombuffer(packed, _ENTRY)
                yield from _rows(x, np.ones(len(x), np.int32))
                continue
            if block != now and parts:
                yield from flush(parts)
                parts = []
            now = block
            parts.append(packed)
    if parts:
        yield from flush(parts)


def _extract(length: int):
    """The bytes of segments at given places of a text, once for each text of a task."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            seeds, texts, starts, kinds, hot, strings = [], [], [], [], [], []
            for text, key, at in zip(batch.column("text"), batch.column("text_hash").to_pylist(), batch.column("at").to_pylist(), strict=True):
                if key in seen:
                    continue
                seen.add(key)
                data = text.as_buffer().to_pybytes()
                for x in at:
                    seeds.append(x["seed"])
                    texts.append(key)
                    starts.append(x["start"])
                    kinds.append(x["kind"])
                    hot.append(x["hot"])
                    strings.append(data[x["start"] : x["start"] + x["windows"] + length - 1])
            yield pa.RecordBatch.from_arrays([pa.array(seeds, pa.int64()), pa.array(texts, pa.int64()), pa.array(starts, pa.int32()), pa.array(kinds, pa.int32()), pa.array(hot, pa.bool_()), pa.array(strings, pa.binary())], ["seed", "text_hash", "start", "kind", "hot", "string"])

    return run


class _Sequence:
    """Transform and common prefixes of a round: symbol + 256 * prefix for each row, written once in order and read in pieces."""

    def __init__(self, kind, folder: str | None, held: int = _HELD, piece: int = _PIECE):
        self.kind, self.folder, self.held, self.piece = kind, folder, held, piece
        self.parts, self.size, self.out, self.path = [], 0, None, None

    def append(self, x: np.ndarray) -> None:
        self.size += len(x)
        if self.out is None and (self.size <= self.held or self.folder is None):
            self.parts.append(x)
            return
        if self.out is None:
            self.files, base = pafs.FileSystem.from_uri(self.folder)
            self.files.create_dir(base, recursive=True)
            self.path = f"{base}/{uuid.uuid4().hex}"
            self.out = self.files.open_output_stream(self.path, compression=None)
            for p in self.parts:
                self.out.write(p.tobytes())
            self.parts = []
        self.out.write(x.tobytes())

    def done(self) -> _Sequence:
        if self.out is not None:
            self.out.close()
        elif len(self.parts) > 1:
            self.parts = [np.concatenate(self.parts)]
        return self

    def read(self):
        if self.path is None:
            yield from self.parts
            return
        with self.files.open_input_stream(self.path, compression=None) as source:
            while data := source.read(self.piece * self.kind.itemsize):
                yield np.frombuffer(data, self.kind)

    def delete(self) -> None:
        if self.path is not None:
            self.files.delete_file(self.path)


def _least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minima of values[lo:hi], ranges of at least one of which starts or ends ascend; values has one element more than any range needs."""
    ends = np.empty(2 * len(lo), np.int64)
    # What reduceat takes from an end to the next start on the way is all in all one pass over the values.
    ends[::2], ends[1::2] = lo, hi
    return np.minimum.reduceat(values, ends)[::2] if len(lo) else values[:0]


def _look(sequence: _Sequence, place: np.ndarray, symbol: np.ndarray, totals: np.ndarray, prefixes: bool = True):
    """One pass over a sequence, which has `totals` of each symbol, for rows `place`, ascending, that hold `symbol`.

    For each row: the number of earlier rows with its symbol, the least prefix from the last of these on, and
    the least prefix up to the next one; 0 where there is none.
    """
    most = np.iinfo(sequence.kind).max >> 8
    nth, before, behind = np.empty(len(place), np.int64), np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    passed, since, waits, ahead = np.zeros(256, np.int64), np.full(256, most), np.full(256, -1), np.full(256, most)
    several, base = sequence.path is not None, 0
    for piece in sequence.read():
        n, codes = len(piece), piece.astype(np.uint8)
        tails, counts = np.argsort(codes, kind="stable"), np.bincount(codes, minlength=256) if several else totals
        starts = np.cumsum(counts) - counts
        lcp = np.empty(n + 1, np.uint8 if most < 256 else np.uint32)
        lcp[:n], lcp[n] = piece >> 8, most
        i, j = np.searchsorted(place, (base, base + n))
        rows, mine = place[i:j] - base, symbol[i:j]
        by = np.argsort(codes[rows], kind="stable")
        sorted_rows, places = rows[by], np.empty(len(rows), np.int64)
        first = 0
        for c, n_rows in enumerate(np.bincount(mine, minlength=256).tolist()):
            if n_rows:
                some = slice(first, first + n_rows)
                places[some] = starts[c] + np.searchsorted(tails[starts[c] : starts[c] + counts[c]], sorted_rows[some])
                first += n_rows
        at = np.empty(len(rows), np.int64)
        at[by] = places
        begin, end = starts[mine], starts[mine] + counts[mine]
        nth[i:j] = passed[mine] + at - begin
        if prefixes:
            if several:
                for c in np.flatnonzero(waits >= 0):
                    ahead[c] = min(ahead[c], lcp[: (tails[starts[c]] + 1 if counts[c] else n)].min())
                    if counts[c]:
                        behind[waits[c]], waits[c] = ahead[c], -1
            has = at > begin
            prior = np.where(has, tails[np.maximum(at - 1, 0)] + 1, 0)
            least = _least(lcp, prior, rows + 1).astype(np.int64)
            before[i:j] = np.where(has, least, np.where(passed[mine] > 0, np.minimum(least, since[mine]), 0))
            has = np.flatnonzero(at + 1 < end)
            behind[i:j][has] = _least(lcp, rows[has] + 1, tails[at[has] + 1] + 1)
            if several:
                for k in np.flatnonzero(at + 1 == end):
                    waits[mine[k]], ahead[mine[k]] = i + k, lcp[rows[k] + 1 : n].min(initial=most)
                for c in range(256):
                    last = tails[starts[c] + counts[c] - 1] + 1 if counts[c] else 0
                    since[c] = min(lcp[last:n].min(initial=most), most if counts[c] else since[c])
        passed += counts
        base += n
    return nth, before, behind


def repeated_windows(strings: list[bytes], length: int, folder: str | None = None, held: int = _HELD, piece: int = _PIECE) -> list[np.ndarray]:
    """For each string, which of its `length`-byte windows also start elsewhere in the strings.

    Symbols are the bytes plus one, 0 is the end of a string (255 is no byte of UTF-8 text). Ends
    are ordered by string. Common prefixes count up to `length`. Sequences of more than `held` rows are files in `folder`.
    """
    if not 0 < length < (1 << 24) - 1:
        raise ValueError(f"length must be from 1 to {(1 << 24) - 2}")
    kind, m = np.dtype("<u2" if length < 255 else "<u4"), len(strings)
    size = np.array([len(s) for s in strings], np.int64)
    top = int(size.max(initial=0))
    # The symbol of each string before its last j ones.
    by_end = np.zeros((top + 1, m), np.uint8)
    for i, s in enumerate(strings):
        by_end[: size[i], i] = np.frombuffer(s, np.uint8)[::-1] + 1
    now = _Sequence(kind, folder, held, piece)
    now.append(by_end[0].astype(kind))
    now.done()
    counts = np.bincount(by_end[0], minlength=256)
    # Strings in the order of their latest rows, and these rows.
    order, place = np.arange(m), np.arange(m)
    for j in range(1, top + 1):
        live = size[order] >= j
        order, place = order[live], place[live]
        symbol = by_end[j - 1, order].astype(np.int64)
        nth, before, behind = _look(now, place, symbol, counts)
        by = np.argsort(by_end[j - 1, order], kind="stable")
        order, symbol, nth = order[by], symbol[by], nth[by]
        place = (np.cumsum(counts) - counts)[symbol] + nth + (m - counts[0])
        # Where there is an earlier or later row with the symbol, that is shared and what follows it.
        before = np.where(nth == 0, 0, np.minimum(before[by] + 1, length))
        behind = np.where(nth + 1 == counts[symbol], 0, np.minimum(behind[by] + 1, length))
        into = place - np.arange(len(place))
        rows = (by_end[j, order] + (before << 8)).astype(kind)
        follows = np.empty(len(into), bool)
        follows[:-1], follows[-1:] = into[1:] != into[:-1], True
        following, base = _Sequence(kind, folder, held, piece), 0
        for x in now.read():
            a, b = np.searchsorted(into, (base, base + len(x)))
            if base + len(x) == now.size:
                b = len(into)
            at = into[a:b] - base
            x = x if x.flags.writeable else x.copy()
            is_next = follows[a:b] & (at < len(x))
            to = at[is_next]
            x[to] = (x[to] & 255) + (behind[a:b][is_next] << 8).astype(kind)
            following.append(np.insert(x, at, rows[a:b]))
            base += len(x)
        now.delete()
        now = following.done()
        counts += np.bincount(by_end[j, order], minlength=256)
    return _walk(now, by_end, size, length, counts)


def _walk(sequence: _Sequence, by_end: np.ndarray, size: np.ndarray, length: int, counts: np.ndarray) -> list[np.ndarray]:
    """From each string's end to its start over the mapping of all rows; which windows share `length` bytes with a neighbour."""
    m, starts = len(size), np.cumsum(counts) - counts
    whole = sequence.path is None
    lcp = [(p >> 8) >= length for p in sequence.read()]
    near = np.append(np.concatenate(lcp), False) if lcp else np.zeros(1, bool)
    near[:-1] |= near[1:]
    row_of = None
    if whole and m:
        tails = np.argsort((sequence.parts[0] & 255).astype(np.uint8), kind="stable")
        row_of = np.empty(len(tails), np.int32)
        row_of[tails] = np.arange(len(tails))
    flags = np.zeros(by_end.shape, bool)
    order, row = np.arange(m), np.arange(m)
    for j in range(1, len(by_end)):
        live = size[order] >= j
        order, row = order[live], row[live]
        if whole:
            row = row_of[row]
        else:
            symbol = by_end[j - 1, order].astype(np.int64)
            row = starts[symbol] + _look(sequence, row, symbol, counts, prefixes=False)[0] - counts[0] + m
            by = np.argsort(symbol, kind="stable")
            order, row = order[by], row[by]
        if j >= length:
            flags[j, order] = near[row]
    sequence.delete()
    return [flags[length : n + 1, i][::-1].copy() if n >= length else np.zeros(0, bool) for i, n in enumerate(size)]


def _construct(length: int, folder: str):
    """Runs of repeated windows of the strings; blocks come one after another."""

    def flush(texts, starts, kinds, strings):
        keys, begin, windows = [], [], []
        for text, start, kind, flags in zip(texts, starts, kinds, repeated_windows(strings, length, folder), strict=True):
            if kind == 0 and flags.any():
                edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    keys.append(text)
                    begin.append(start + a)
                    windows.append(b - a)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(begin, pa.int32()), pa.array(windows, pa.int32())], ["text_hash", "start", "windows"])

    def run(batches):
        now, held = None, ([], [], [], [])
        for batch in batches:
            for block, *rest in zip(*[batch.column(c).to_pylist() for c in ("block", "text_hash", "start", "kind", "string")], strict=True):
                if block != now and held[0]:
                    yield flush(*held)
                    held = ([], [], [], [])
                now = block
                if held[0] and (held[0][-1], held[1][-1]) == tuple(rest[:2]):
                    continue  # the same segment from another task's copy of the text
                for h, v in zip(held, rest, strict=True):
                    h.append(v)
        if held[0]:
            yield flush(*held)

    return run


def _remove(length: int):
    def run(batches):
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            lists = batch.column("at")
            bounds, runs = lists.offsets.to_numpy(), lists.values
            begin, windows = (runs.field(c).to_numpy(zero_copy_only=False) for c in ("start", "windows"))
            for i, text in enumerate(batch.column("text")):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                a, b = (bounds[i], bounds[i + 1]) if lists[i].is_valid else (0, 0)
                order = a + np.argsort(begin[a:b], kind="stable")
                first, last = begin[order], begin[order] + windows[order] + (length - 1)
                # A span begins where all earlier runs have ended.
                reach = np.maximum.accumulate(last) if len(last) else last
                fresh = np.flatnonzero(np.r_[True, first[1:] > reach[:-1]]) if len(first) else first
                spans = list(zip(first[fresh].tolist(), reach[np.r_[fresh[1:] - 1, len(reach) - 1]].tolist(), strict=True)) if len(first) else []
                kept, end = hashlib.sha256(), 0
                for x, y in spans:
                    kept.update(data[end:x])
                    end = y
                kept.update(data[end:])
                for c, v in zip(columns, (len(data), sum(y - x for x, y in spans), len(spans), kept.hexdigest()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


_SPAN = "text_hash long, start int, windows int"


def _spans(keyed: DataFrame, length: int, k: int, folder: str) -> DataFrame:
    """(text_hash, start, windows): runs of repeated windows of the texts (text_hash, text), text being string or binary."""
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(6, int(total * 2 // (length - k + 1) * _ENTRY.itemsize // _BLOCK_BYTES).bit_length())
    cut = keyed.mapInArrow(_cutter(length, k, bits), "block long, kind int, packed binary").repartition(1 << bits, "block").sortWithinPartitions("block")
    found = stored(cut.mapInArrow(_group, "kind int, seed long, text_hash long, start int, windows int"), "suffix-segments")
    repeats, open_ = found.where("kind = 1").select("text_hash", "start", "windows"), found.where("kind != 1")
    if k == length:  # a hash is a whole window: all its segments are equal
        return repeats
    hot = stored(open_.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") > MOST_SEGMENTS).select("seed", F.lit(True).alias("hot")), "suffix-hot")
    seeds = hot.count()
    if seeds:
        open_ = stored(open_.join(small(hot, seeds), "seed", "left").withColumn("hot", F.col("hot").isNotNull()), "suffix-open")
    else:
        open_ = open_.withColumn("hot", F.lit(False))
    wanted = stored(open_.groupBy("text_hash").agg(F.collect_list(F.struct("seed", "start", "windows", "kind", "hot")).alias("at")), "suffix-wanted")
    count, bytes_ = open_.agg(F.count("*"), F.coalesce(F.sum(F.col("windows") + length - 1), F.lit(0))).first()
    strings = keyed.join(small(wanted, count, 48), "text_hash").mapInArrow(_extract(length), "seed long, text_hash long, start int, kind int, hot boolean, string binary")
    if seeds:
        strings = stored(strings, "suffix-strings")
    blocks = max(6, int(bytes_ // _STRING_BYTES) + 1)
    few = strings.where("not hot").withColumn("block", F.pmod(F.xxhash64("seed"), F.lit(blocks)))
    built = few.repartition(blocks, "block").sortWithinPartitions("block", "seed", "text_hash", "start").mapInArrow(_construct(length, folder), _SPAN)
    runs = repeats.union(stored(built, "suffix-runs"))
    if seeds:
        # Segments of a crowded hash, once each, are the texts of a collection cut by longer substrings.
        crowded = strings.where("hot").select("text_hash", "start", "string").dropDuplicates(["text_hash", "start"])
        crowded = stored(crowded.select(F.xxhash64("text_hash", "start").alias("key"), F.col("text_hash").alias("of"), F.col("start").alias("offset"), "string"), "suffix-crowded")
        inner = _spans(crowded.select(F.col("key").alias("text_hash"), F.col("string").alias("text")), length, (k + length + 1) // 2, folder)
        inner = inner.withColumnRenamed("text_hash", "key").join(crowded.select("key", "of", "offset"), "key")
        runs = runs.union(inner.select(F.col("of").alias("text_hash"), (F.col("offset") + F.col("start")).alias("start"), "windows"))
    return runs


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = SEED_BYTES) -> DataFrame:
    """(text_hash, start, windows): runs of repeated windows of the texts of docs, known by xxhash64 of the text."""
    keyed = docs.select(F.xxhash64("text").alias("text_hash"), "text").where(F.octet_length("text") >= length)
    return _spans(keyed, length, k, scratch(docs.sparkSession, "suffix-files"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = SEED_BYTES) -> DataFrame:
    """The query's columns for every row of (doc_id, text)."""
    spans = stored(repeated_spans(docs, length, k).groupBy("text_hash").agg(F.collect_list(F.struct("start", "windows")).alias("at")), "suffix-spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return rows.join(spans, "text_hash", "left").select("doc_id", "text", "at").mapInArrow(_remove(length), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
