"""N-gram Jaccard join as a blocked sparse matrix product with accumulated overlap counts.

The corpus is a sparse matrix of distinct n-gram sets by word n-grams. Its columns are cut into
blocks by hash range; each block arrives as packed arrays of (hash, set, set size, position). A
block's product with itself gives, for pairs of sets, the number of its columns that both have;
these counts are added up over all blocks, and a pair is discarded when its count and what can
still be shared outside the counted columns stay below the bound that both sizes give:

* a set enters with the first n - ceil(t n) + 1 n-grams of a fixed global order only (n-grams
  that a count of hash buckets shows to be frequent come last). Of two sets one leaves that part first, so
  outside the counted columns they share at most as many as that one has left, and a pair must have
  t (a + b) / (1 + t) in all;
* sizes must be within the threshold of each other;
* the two positions of a shared n-gram bound the overlap on both sides of it.

What is left is counted exactly on whole sets. So that a group of thousands of near copies does not
become all its pairs, a product of columns with one set each comes first: in each column the set whose
n-grams most others share; of these pairs each set tries the one with the
highest count. The components of the links found so are put back into the columns, and the second, complete product
leaves out pairs within a component only. For it, columns whose heaviest set lies in one component are one group: two sets that share
many columns meet in one task, which adds up their counts and passes on one row for the pair, and only if that count, what the two
sets' columns in other groups can add and what is not counted reach the bound. A group of many sets is cut into tiles, so no task holds more than two tiles of a group; the first product streams.

A set is known by a 64-bit digest of its sorted n-gram hashes, so equal texts are one vertex whatever their
doc_id, and rows that repeat a doc_id with other texts stay apart.

Defined cases: a null or blank text has size 0 and no link, its own id is its component; equal
sets are linked whatever the order or repetition of rows; of rows that share a doc_id each has its own
text's size and component; links also run through rows with a null doc_id, which get the smallest known doc_id that they
reach, or null; an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accolade.llm import textkit as K
from accolade.llm._shared import components, drop_stored, small, stored, table

#: Hash prefixes that are counted to find frequent n-grams, and how many of them the order may name. The table has a fixed size.
_BUCKET_BITS, _HOT_BUCKETS = 20, 65_536
#: Sets of a group of columns that one tile holds, and counts of pairs that a task adds up before it passes them on: more than pairs of two tiles.
_TILE, _HELD = 512, 600_000
_U64 = np.uint64


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> _U64(64 - _BUCKET_BITS)).astype(np.int32)


def _binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def _sets(batches: Iterator[pa.RecordBatch], n: int):
    """(batch, n-gram hashes, bounds of rows) for slices of a moderate size."""
    for whole in batches:
        for batch in K.slices(whole, "text"):
            raw, at = K.buffers(batch.column("text"))
            h, bounds, _ = K.shingles(raw, at, n)
            yield batch, h, bounds


def _vertex(u: np.ndarray) -> int:
    """The name of a set, from its sorted hashes."""
    return int.from_bytes(hashlib.blake2b(u.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sizes(n: int):
    """Size and vertex of each row's set."""

    def run(batches):
        for batch, h, bounds in _sets(batches, n):
            sets = [np.unique(h[bounds[i] : bounds[i + 1]]) for i in range(batch.num_rows)]
            sizes, names = [len(u) for u in sets], [_vertex(u) if len(u) else None for u in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(names, pa.int64())], ["doc_id", "text_hash", "size", "vertex"])

    return run


def _hot_counter(n: int):
    """Buckets that a task saw far more often than chance would give, with their counts."""

    def run(batches):
        seen, total = np.zeros(1 << _BUCKET_BITS, np.int32), 0
        for _, h, _ in _sets(batches, n):
            seen += np.bincount(_bucket(h), minlength=len(seen)).astype(np.int32)
            total += len(h)
        mean = total / len(seen)
        hot = np.flatnonzero(seen > mean + 5 * np.sqrt(mean) + 2)
        if len(hot):
            yield pa.RecordBatch.from_arrays([pa.array(hot), pa.array(seen[hot].astype(np.int64))], ["bucket", "n"])

    return run


def _hot_ranks(docs: DataFrame, n: int) -> np.ndarray:
    """A rank for each bucket: 0, or the count's magnitude for the frequent ones. At most _HOT_BUCKETS small rows reach the driver."""
    rows = docs.select("text").mapInArrow(_hot_counter(n), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "bucket").limit(_HOT_BUCKETS).collect()
    ranks = np.zeros(1 << _BUCKET_BITS, np.uint8)
    for r in rows:
        ranks[r["bucket"]] = min(255, int(4 * np.log2(1 + r["n"])))
    return ranks


def _prefix(u: np.ndarray, ranks: np.ndarray, percent: int) -> np.ndarray:
    size = len(u)
    rank = ranks[_bucket(u)]
    if rank.any():
        u = u[np.argsort(rank, kind="stable")]
    return u[: size - -(-percent * size // 100) + 1]


_HEAD = np.dtype([("h", "<u8"), ("doc", "<i8"), ("size", "<i4"), ("pos", "<i4")])


def _blocker(n: int, ranks: np.ndarray, percent: int, bits: int):
    """Cuts the first n-grams of each distinct set into blocks of columns: one packed row for each block that a slice touches."""

    def run(batches):
        seen: set[int] = set()
        for batch, grams, bounds in _sets(batches, n):
            names, sizes, first = [], [], []
            for i in range(batch.num_rows):
                u = np.unique(grams[bounds[i] : bounds[i + 1]])
                name = _vertex(u) if len(u) else None
                # A task passes on one of equal sets.
                if name is not None and name not in seen:
                    seen.add(name)
                    names.append(name)
                    sizes.append(len(u))
                    first.append(_prefix(u, ranks, percent))
            if not names:
                continue
            docs, sizes = np.array(names, np.int64), np.array(sizes, np.int32)
            count = np.array([len(u) for u in first], np.int64)
            h = np.concatenate(first)
            row = np.repeat(np.arange(len(docs)), count)
            pos = (np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count)).astype("<i4")
            block = (h >> _U64(64 - bits)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order], prepend=-1))
            at, packed = [], []
            for i, j in zip(cuts, [*cuts[1:], len(order)], strict=True):
                o = order[i:j]
                at.append(int(block[o[0]]))
                packed.append(b"".join((h[o].tobytes(), docs[row[o]].tobytes(), sizes[row[o]].tobytes(), pos[o].tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), _binary(packed)], ["block", "packed"])

    return run


def _unpack(parts: list[bytes]) -> np.ndarray:
    out = np.empty(sum(len(p) for p in parts) // _HEAD.itemsize, _HEAD)
    i = 0
    for p in parts:
        m = len(p) // _HEAD.itemsize
        x = out[i : i + m]
        x["h"], x["doc"] = np.frombuffer(p, "<u8", m), np.frombuffer(p, "<i8", m, 8 * m)
        x["size"], x["pos"] = np.frombuffer(p, "<i4", m, 16 * m), np.frombuffer(p, "<i4", m, 20 * m)
        i += m
    return out


def _shared_columns(batches):
    """The entries of a block whose column holds two sets or more, each set once; blocks come one after another."""

    def flush(parts):
        x = _unpack(parts)
        x = x[np.lexsort((x["doc"], x["h"]))]
        x = x[np.r_[True, (x["h"][1:] != x["h"][:-1]) | (x["doc"][1:] != x["doc"][:-1])]]
        first = np.flatnonzero(np.r_[True, x["h"][1:] != x["h"][:-1]])
        length = np.diff(np.r_[first, len(x)])
        x = x[np.repeat(length > 1, length)]
        for i in range(0, len(x), 200_000):
            y = x[i : i + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(y["h"].copy().view("<i8")), *[pa.array(np.ascontiguousarray(y[c])) for c in ("doc", "size", "pos")]], ["h", "doc", "size", "pos"])

    now, parts = None, []
    for batch in batches:
        for block, packed in zip(batch.column("block").to_pylist(), batch.column("packed").to_pylist(), strict=True):
            if block != now and parts:
                yield from flush(parts)
                parts = []
            now = block
            parts.append(packed)
    if parts:
        yield from flush(parts)


def _may_reach(x: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and positions of a shared column leave room for enough overlap: o >= t (a + b) / (1 + t), t in percent."""
    a, b, p, q = x["size"][i], x["size"][j], x["pos"][i], x["pos"][j]
    most = np.minimum(p, q) + 1 + np.minimum(a - p, b - q) - 1
    return (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & ((100 + percent) * most >= percent * (a + b))


class _Counts:
    """Overlap counts of pairs that a task has found; what exceeds the bound is passed on, to be added up with the other tasks'."""

    _NAMES = ("a", "b", "size_a", "size_b", "n")

    def __init__(self, most: int = 400_000):
        self.most, self.held, self.parts = most, 0, []

    def add(self, x: np.ndarray, i: np.ndarray, j: np.ndarray):
        """One column more for the pairs x[i], x[j]."""
        self.parts.append([x["doc"][i], x["doc"][j], x["size"][i], x["size"][j], np.ones(len(i), np.int64)])
        self.held += len(i)
        if self.held > self.most:
            self._sum()
            if self.held > self.most // 2:
                yield from self.rest()

    def _sum(self):
        a, b, size_a, size_b, n = (np.concatenate([p[k] for p in self.parts]) for k in range(5))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
        self.parts = [[a[first], b[first], size_a[order][first], size_b[order][first], np.add.reduceat(n[order], first) if len(a) else n]]
        self.held = len(first)

    def rest(self):
        if self.parts:
            self._sum()
            columns, (self.held, self.parts) = self.parts[0], (0, [])
            for i in range(0, len(columns[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000].astype(np.int64)) for c in columns], list(self._NAMES))


_PAIR = "a long, b long, size_a long, size_b long, n long"
_ENTRY = np.dtype([("h", "<i8"), ("doc", "<i8"), ("size", "<i8"), ("pos", "<i8"), ("comp", "<i8"), ("side", "<i8"), ("tile", "<i8"), ("out", "<i8")])


def _entries(batch: pa.RecordBatch) -> np.ndarray:
    x = np.zeros(batch.num_rows, _ENTRY)
    for name in batch.schema.names:
        x[name] = batch.column(name).to_numpy(zero_copy_only=False)
    return x


class _TileCounts:
    """Overlap counts of pairs by tile; a tile's pairs are passed on when it has ended, if columns elsewhere and what is not counted leave room."""

    def __init__(self, percent: int, most: int):
        self.percent, self.most, self.held, self.parts = percent, most, 0, []

    def add(self, x: np.ndarray, i: np.ndarray, j: np.ndarray, now: int):
        """One column more for the pairs x[i], x[j]; `now` is the tile that may go on."""
        self.parts.append([x["tile"][i], x["doc"][i], x["doc"][j], x["size"][i], x["size"][j], np.minimum(x["out"][i], x["out"][j]), np.ones(len(i), np.int64)])
        self.held += len(i)
        if self.held > self.most:
            yield from self.rest(now)

    def rest(self, now: int | None = None):
        if not self.parts:
            return
        columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        order = np.lexsort((columns[2], columns[1], columns[0]))
        columns = [c[order] for c in columns]
        new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:3]])
        first = np.flatnonzero(np.r_[True, new][: len(order)])
        n = np.add.reduceat(columns[6], first) if len(first) else columns[6]
        columns = [*[c[first] for c in columns[:6]], n]
        ended = columns[0] != now if now is not None else np.ones(len(n), bool)
        self.parts = [[c[~ended] for c in columns]]
        self.held = int((~ended).sum())
        _, a, b, size_a, size_b, out, n = (c[ended] for c in columns)
        left = -(-np.maximum(size_a, size_b) * self.percent // 100) - 1
        may = (100 + self.percent) * (n + out + left) >= self.percent * (size_a + size_b)
        columns = [c[may] for c in (a, b, size_a, size_b, n)]
        for i in range(0, len(columns[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000].astype(np.int64)) for c in columns], list(_Counts._NAMES))


def _stars(percent: int):
    """Counts (set, first set of a column) where the two lie in different components; the input is sorted by column, the first set foremost."""

    def run(batches):
        found, hub = _Counts(), np.zeros(0, _ENTRY)
        for batch in batches:
            # The last column's first set stands before what may be the rest of that column.
            x = np.concatenate([hub, _entries(batch)])
            if not len(x):
                continue
            starts = np.r_[True, x["h"][1:] != x["h"][:-1]]
            first = np.flatnonzero(starts)[np.cumsum(starts) - 1]
            i = np.flatnonzero(x["comp"] != x["comp"][first])
            i = i[_may_reach(x, first[i], i, percent)]
            yield from found.add(x, i, first[i])
            hub = x[first[-1] : first[-1] + 1]
        yield from found.rest()

    return run


def _groups(batches):
    """Whole columns of tiles, in runs of many: only the last column of a batch is carried over."""
    left = np.zeros(0, _ENTRY)
    for batch in batches:
        x = np.concatenate([left, _entries(batch)])
        if len(x):
            cut = len(x) - int(((x["h"] == x["h"][-1]) & (x["tile"] == x["tile"][-1])).sum())
            left = x[cut:]
            if cut:
                yield x[:cut]
    if len(left):
        yield left


def _across(percent: int, at_once: int = 500_000):
    """Counts of all pairs of a tile that share a column, lie in different components and, where two tiles of a group meet, on different sides."""

    def run(batches):
        found = _TileCounts(percent, _HELD)
        for x in _groups(batches):
            first = np.flatnonzero(np.r_[True, (x["h"][1:] != x["h"][:-1]) | (x["tile"][1:] != x["tile"][:-1])])
            size = np.diff(np.r_[first, len(x)])
            later = np.repeat(first + size, size) - np.arange(len(x)) - 1
            rounds = (np.cumsum(later) - later) // at_once
            for part in np.split(np.arange(len(x)), np.flatnonzero(np.diff(rounds)) + 1):
                i = np.repeat(part, later[part])
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later[part]) - later[part], later[part])
                keep = (x["comp"][i] != x["comp"][j]) & ((x["side"][i] < 0) | (x["side"][i] != x["side"][j]))
                i, j = i[keep], j[keep]
                keep = _may_reach(x, i, j, percent)
                i, j = i[keep], j[keep]
                swap = x["doc"][i] > x["doc"][j]
                yield from found.add(x, np.where(swap, j, i), np.where(swap, i, j), x["tile"][part[-1]])
        yield from found.rest()

    return run


def _whole_sets(n: int):
    def run(batches):
        seen: set[int] = set()
        for batch, h, bounds in _sets(batches, n):
            names, out = [], []
            for i in range(batch.num_rows):
                u = np.unique(h[bounds[i] : bounds[i + 1]])
                name = _vertex(u)
                if name not in seen:
                    seen.add(name)
                    names.append(name)
                    out.append(u.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), _binary(out)], ["vertex", "grams"])

    return run


def _count_overlaps(percent: int):
    """Exact overlaps of pairs; keeps those at the threshold or above."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("grams_a"), batch.column("grams_b"), strict=True):
                u, v = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = np.concatenate([u, v])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(u) + len(v) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _summed(partial: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose counts, added up over all blocks, leave room for enough overlap in what was not counted."""
    pairs = partial.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("size_a").alias("size_a"), F.max("size_b").alias("size_b"))
    left = F.ceil(F.greatest("size_a", "size_b") * percent / 100) - 1
    return pairs.where((100 + percent) * (F.col("n") + left) >= percent * (F.col("size_a") + F.col("size_b"))).select("a", "b")


def ngram_links(docs: DataFrame, n: int = 5, percent: int = 75, block_bytes: int = 8 << 20) -> tuple[DataFrame, DataFrame]:
    """Sizes and links of documents (doc_id, text).

    Returns (sized, links): `sized` has doc_id, size and vertex, the name of the row's set, for every
    row; `links` holds pairs (a, b) of vertices with 100 * overlap >= percent * union, enough
    of them to connect all that are linked.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    ranks = _hot_ranks(docs, n)
    sized = stored(docs.mapInArrow(_sizes(n), "doc_id long, text_hash long, size long, vertex long"), "ngram-sets")
    entries = sized.agg(F.sum("size")).first()[0] or 0
    bits = max(6, int(entries * (100 - percent) // 100 * _HEAD.itemsize // block_bytes).bit_length())
    blocks = docs.select("text").mapInArrow(_blocker(n, ranks, percent, bits), "block long, packed binary").repartition(1 << bits, "block").sortWithinPartitions("block")
    shared = stored(blocks.mapInArrow(_shared_columns, "h long, doc long, size int, pos int"), "ngram-columns")

    def confirm(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs, "ngram-pairs")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("vertex")).distinct()
        # One text of each vertex, whichever it is.
        wanted = stored(sized.join(wanted, "vertex").groupBy("vertex").agg(F.min("text_hash").alias("text_hash")).select("text_hash").distinct(), "ngram-wanted")
        whole = docs.join(small(wanted, wanted.count()), "text_hash", "left_semi").select("text").mapInArrow(_whole_sets(n), "vertex long, grams binary").dropDuplicates(["vertex"])
        whole = stored(whole, "ngram-whole")
        side = lambda s: whole.select(F.col("vertex").alias(s), F.col("grams").alias(f"grams_{s}"))
        links = stored(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_count_overlaps(percent), "a long, b long"), "ngram-links")
        drop_stored(pairs, wanted, whole)
        return links

    def open_columns(placed: DataFrame) -> DataFrame:
        """Columns that more than one component meets in, and the group they belong to: the component of their heaviest set."""
        counted = placed.groupBy("h").agg(F.max_by("comp", F.struct("weight", "doc")).alias("group"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        return stored(counted.where("low != high").select("h", "group"), "ngram-open")

    # A set's weight is the number of its n-grams' other sets: that of a group's middle is the highest.
    widths = shared.groupBy("h").agg(F.count("*").alias("width"))
    weights = stored(shared.join(widths, "h").groupBy("doc").agg(F.sum("width").alias("weight")), "ngram-weights")
    placed = stored(shared.join(small(weights, weights.count()), "doc").withColumn("comp", F.col("doc")), "ngram-placed")
    entries = placed.repartition("h").sortWithinPartitions("h", F.desc("weight"), "doc").select("h", "doc", "size", "pos", "comp")
    counts = entries.mapInArrow(_stars(percent), _PAIR).groupBy("a", "b").agg(F.sum("n").alias("n"))
    links = confirm(counts.groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b")))
    roots = stored(components(links), "ngram-roots")
    joined = placed.drop("comp").join(small(roots, roots.count()).withColumnRenamed("node", "doc"), "doc", "left")
    joined = stored(joined.select("h", "doc", "size", "pos", "weight", F.coalesce("root", "doc").alias("comp")), "ngram-placed")
    drop_stored(placed, roots)
    placed = joined
    open_ = open_columns(placed)
    grouped = stored(placed.join(small(open_, open_.count()), "h").select("group", "h", "doc", "size", "pos", "comp"), "ngram-open-columns")
    # How many columns a set has in other groups.
    of = lambda *c: F.count("*").over(Window.partitionBy(*c))
    outside = stored(grouped.withColumn("own", of("doc", "group")).withColumn("out", of("doc") - F.col("own")).drop("own"), "ngram-grouped")
    drop_stored(grouped)
    grouped = outside
    groups = stored(grouped.groupBy("group").agg(F.ceil(F.approx_count_distinct("doc") / _TILE).cast("long").alias("tiles")), "ngram-tiles")
    tiled = grouped.join(small(groups, groups.count()), "group").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("tiles"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    tiled = tiled.select(F.xxhash64("group", low, high).alias("tile"), "h", "doc", "size", "pos", "comp", "out", F.when(low == high, F.lit(-1)).otherwise((F.col("own") == high).cast("int")).cast("long").alias("side"))
    rest = confirm(_summed(tiled.repartition("tile").sortWithinPartitions("tile", "h").mapInArrow(_across(percent), _PAIR), percent))
    drop_stored(shared, weights, placed, open_, grouped, groups)
    return sized, links.union(rest)


def vertex_groups(links: DataFrame) -> DataFrame:
    """(vertex, root) of the vertices that have links."""
    return components(links).select(F.col("node").alias("vertex"), "root")


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of documents (doc_id, text)."""
    sized, links = ngram_links(docs, n, percent)
    vertices = sized.where("vertex is not null").groupBy("vertex").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    vertices = stored(vertices.join(vertex_groups(links), "vertex", "left").select("vertex", "least", "rows", "root"), "ngram-vertices")
    linked = vertices.where("root is not null").groupBy("root").agg(F.min("least").alias("component"))
    linked = vertices.join(linked, "root").select("vertex", "component")
    alone = vertices.where("root is null and rows > 1").select("vertex", F.col("least").alias("component"))
    # Of vertices that neither a link nor a second row has, the row's own id is the component.
    named = stored(linked.union(alone), "ngram-named")
    rows = sized.join(small(named, named.count()), "vertex", "left")
    return rows.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


#: Exact, by counting shared shingles of all pairs of documents in DuckDB.
SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
      GROUP BY 1, 2 HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (
  WITH RECURSIVE reach(x, y) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT reach.x, l.b FROM reach JOIN (SELECT a, b FROM p UNION ALL SELECT b, a FROM p) l ON l.a = reach.y
  ) SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.c AS component_id FROM s JOIN r ON r.x = s.doc_id
"""
