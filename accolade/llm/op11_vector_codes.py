"""Product quantisation of vectors, with codebooks learned by delta-maintained Lloyd rounds.

Components become integers, vectors are cut into equal parts, and each part position has a codebook of its own.
Two things are kept between rounds, both as tables in the shared folder: every vector's entries of the round
before, and the sums and counts of the parts of each entry, as whole numbers. A round reads the
vectors with their entries, assigns anew, and writes them again together with what changed: for a part whose entry is
another one now, minus its components at the old entry and plus them at the new one, added up within a task. Only those
contributions are shuffled, at most two entries' worth of numbers for each entry and task, however many vectors there are,
and the first round, in which every part is new, is the same step from empty sums. Sums are exact, so the
order of additions does not matter, and a part that stays where it is costs nothing beyond its assignment.

The driver holds codebooks only: entries times dimensions numbers.

Distances are products of matrices where all their numbers are whole numbers below 2^53 and so exact, and Python's
integers otherwise; an error that no long holds is null, and so is a label's sum of such. A finite component of 2^53 or more after scaling makes the query fail
with a message that says so.

Defined cases: rows whose vector is null or holds null or non-finite components go; so do vectors whose
length is not that of the kept vector with the smallest id, or cannot be cut into the parts. Repeated ids and
rows are vectors of their own (equal ids are ordered by their components, null ids come last). With fewer vectors than entries there are
as many entries as vectors; an empty table gives an empty result. Rows without a label add up as one label. Further columns do
not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_schema

from accolade.llm._shared import drop_stored, small, stored, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Scaled components are below this.
LARGEST = 1 << 53
#: Vectors that a task works on at once, and shares that a label's sum is repeated in where it cannot be broadcast.
ROWS, SHARES = 2048, 64
_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Codebooks:
    """entries[p][e] are the whole-number components of entry e at part position p."""

    entries: list[list[list[int]]]

    @property
    def sha256(self) -> str:
        """Digest of all components by part, entry and place, decimal and joined by commas."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()

    @property
    def width(self) -> int:
        return len(self.entries[0][0]) if self.entries and self.entries[0] else 0


def _assign(vectors: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part and its squared distance (rows x parts); of equals the first."""
    parts, width = len(books.entries), books.width
    code, off = np.zeros((len(vectors), parts), np.int64), np.zeros((len(vectors), parts), object)
    for p, book in enumerate(books.entries if len(vectors) else []):
        own, entries = vectors[:, p * width : (p + 1) * width], np.array(book, np.int64).reshape(len(book), width)
        if width * (2 * max(int(np.abs(own).max(initial=0)), int(np.abs(entries).max(initial=0)))) ** 2 < 2**53:
            own, entries = own.astype(np.float64), entries.astype(np.float64)
            far = (own * own).sum(1)[:, None] - 2 * (own @ entries.T) + (entries * entries).sum(1)[None, :]
        else:
            far = np.stack([((own.astype(object) - entry.astype(object)) ** 2).sum(1) for entry in entries], 1)
        code[:, p] = far.argmin(1)
        off[:, p] = far[np.arange(len(own)), code[:, p]]
    return code, off


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, length)


def _moved(books: Codebooks, names: list[str], schema: pa.Schema) -> Callable:
    """One round: vectors with their entries, then one row of contributions for each entry of a part that gained or lost in this task."""
    parts, width = len(books.entries), books.width

    def run(batches):
        gains: dict[tuple[int, int], list[int]] = {}
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                vectors = _matrix(batch.column("ints"), parts * width)
                code, _ = _assign(vectors, books)
                before = batch.column("code").to_pylist()
                had = np.array([c is not None for c in before], bool)
                old = np.frombuffer(b"".join(c if c is not None else bytes(parts) for c in before), np.uint8).reshape(-1, parts)
                for p in range(parts):
                    moved = (code[:, p] != old[:, p]) | ~had
                    for entries, sign, rows in ((code[:, p], 1, moved), (old[:, p], -1, moved & had)):
                        for e in np.unique(entries[rows]):
                            here = vectors[rows & (entries == e), p * width : (p + 1) * width]
                            gain = gains.setdefault((p, int(e)), [0] * (width + 1))
                            for at, x in enumerate((len(here), *here.sum(0, dtype=object if np.abs(here).max(initial=0) >= 2**40 else None))):
                                gain[at] += sign * int(x)
                columns = {n: batch.column(n) for n in names} | {"code": pa.array([bytes(c) for c in code.astype(np.uint8)], pa.binary())}
                yield pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(batch.num_rows, f.type) for f in schema], schema=schema)
        found = [(*k, at, Decimal(x)) for k, gain in sorted(gains.items()) for at, x in enumerate(gain) if x]
        columns = {n: pa.array([r[i] for r in found], schema.field(n).type) for i, n in enumerate(("part", "entry", "at", "gain"))}
        yield pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(len(found), f.type) for f in schema], schema=schema)

    return run


def _coded(books: Codebooks, schema: pa.Schema) -> Callable:
    """The last assignment: code and error of each vector."""

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                code, off = _assign(_matrix(batch.column("ints"), len(books.entries) * books.width), books)
                errors = [sum(map(int, row)) for row in off.tolist()]
                columns = [pa.array([bytes(c) for c in code.astype(np.uint8)], pa.binary()), pa.array([e if e <= _LONG else None for e in errors], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), *columns], schema=schema)

    return run


def usable_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and ints, the components times scale rounded down, of rows whose vector has finite components only."""
    good = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    scaled = lambda x: F.floor(x.cast("double") * F.lit(float(scale)))
    checked = lambda x: F.when(F.abs(x.cast("double") * float(scale)) < float(LARGEST), scaled(x)).otherwise(F.raise_error(F.lit(f"a vector's component times {scale} is beyond {LARGEST}")).cast("long"))
    return vectors.where(F.col("embedding").isNotNull() & good).select("vec_id", "label", F.transform("embedding", checked).alias("ints"))


def learn_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error) of every usable row of (vec_id, embedding, label), and the codebooks; code has a byte for each part."""
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part, so a codebook has 1 to 256 entries")
    kept = usable_vectors(vectors, scale)
    order = [F.col("vec_id").asc_nulls_last(), "ints"]
    first = kept.orderBy(*order).limit(1).select(F.size("ints")).collect()
    length = first[0][0] if first else 0
    kept = kept.where((F.size("ints") == length) & F.lit(length % parts == 0))
    seeds = [r["ints"] for r in kept.orderBy(*order).limit(entries).collect()]
    width = length // parts
    books = Codebooks([[list(seed[p * width : (p + 1) * width]) for seed in seeds] for p in range(parts)])
    state, sums, frames = kept.withColumn("code", F.lit(None).cast("binary")), None, []
    round_schema = S.StructType([*state.schema.fields, *S._parse_datatype_string("part int, entry int, at int, gain decimal(38,0)").fields])
    for _ in range(rounds if seeds else 0):
        done = stored(state.mapInArrow(_moved(books, ["vec_id", "label", "ints"], to_arrow_schema(round_schema)), round_schema), "codes")
        gains = done.where("part is not null").select("part", "entry", "at", "gain")
        gains = gains if sums is None else gains.unionByName(sums)
        total = stored(gains.groupBy("part", "entry", "at").agg(F.sum("gain").cast("decimal(38,0)").alias("gain")), "sums")
        if frames:
            drop_stored(*frames)
        frames, sums = [done, total], total
        books = _next_books(books, total)
        state = done.where("part is null").select("vec_id", "label", "ints", "code")
    out_schema = S.StructType([*[f for f in kept.schema.fields if f.name != "ints"], S.StructField("code", S.BinaryType()), S.StructField("error", S.LongType())])
    return state.mapInArrow(_coded(books, to_arrow_schema(out_schema)), out_schema), books


def _next_books(books: Codebooks, sums: DataFrame) -> Codebooks:
    """Each entry the mean of its parts, rounded down; an entry without parts stays. sums has at most entries times (dimensions + parts) rows."""
    held: dict[tuple[int, int], dict[int, int]] = {}
    for r in sums.collect():
        held.setdefault((r["part"], r["entry"]), {})[r["at"]] = int(r["gain"])
    mean = lambda p, e, entry: [h.get(i + 1, 0) // h[0] for i in range(len(entry))] if (h := held.get((p, e), {})).get(0) else entry
    return Codebooks([[mean(p, e, entry) for e, entry in enumerate(book)] for p, book in enumerate(books.entries)])


def decode_codes(codes: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """codes with embedding, the vector that each code stands for; a null code gives null."""
    parts = F.array(*[F.array(*[F.array(*[F.lit(x / scale) for x in entry]).cast("array<double>") for entry in book]) for book in books.entries])
    numbers = F.transform(F.sequence(F.lit(0), F.lit(len(books.entries) - 1)), lambda p: F.conv(F.hex(F.substring("code", p + 1, F.lit(1))), 16, 10).cast("int"))
    return codes.withColumn("embedding", F.when(F.col("code").isNotNull(), F.flatten(F.zip_with(parts, numbers, lambda book, e: F.get(book, e)))))


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes (stored before, as it is read twice) with label_error, the errors of equal labels added up, rows without a label together.

    Sums are added up within tasks first. The sums are broadcast where they were counted and are few; else each sum stands in
    SHARES rows and a label's vectors are dealt over them, so that a label may hold any share of the rows.
    """
    sums = stored(codes.groupBy("label").agg(F.when(F.count_if(F.col("error").isNull()) == 0, F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long")).alias("label_error")), "labels")
    n = sums.count()
    shares = 1 if small(sums, n) is not sums else SHARES
    spread = sums.select(F.col("label").alias("_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("_share"))
    own = codes.withColumn("_own", F.pmod(F.xxhash64("vec_id", "code"), F.lit(shares)).cast("int"))
    return own.join(small(spread, n), F.col("label").eqNullSafe(F.col("_label")) & (F.col("_own") == F.col("_share")), "left").drop("_label", "_share", "_own")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = learn_codes(table(spark, sf_dir, "embeddings"))
    codes = with_label_error(stored(codes, "coded"))
    return codes.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))


def _sql() -> str:
    """Two rounds over whole tables, unrolled."""
    assign = """a{r} AS MATERIALIZED (SELECT vec, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
  SELECT v.vec, v.part, c.entry, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{r} c ON v.part = c.part AND v.pos = c.pos GROUP BY ALL) GROUP BY vec, part)"""
    update = """c{n} AS MATERIALIZED (SELECT c.part, c.entry, c.pos, CASE WHEN m.n IS NULL THEN c.x ELSE CAST(floor((m.s - ((m.s % m.n) + m.n) % m.n) / m.n) AS BIGINT) END AS x FROM c{r} c LEFT JOIN (
  SELECT a.part, a.entry, v.pos, sum(v.x) AS s, count(*) AS n FROM a{r} a JOIN v ON v.vec = a.vec AND v.part = a.part GROUP BY ALL) m ON m.part = c.part AND m.entry = c.entry AND m.pos = c.pos)"""
    return f"""
WITH k AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
u AS (SELECT vec, len(embedding) // {PARTS} AS w, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM k),
v AS MATERIALIZED (SELECT vec, i // w AS part, i % w AS pos, CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT) AS x FROM u),
c0 AS MATERIALIZED (SELECT part, vec AS entry, pos, x FROM v WHERE vec < {ENTRIES}),
{", ".join(assign.format(r=r) + ", " + update.format(r=r, n=r + 1) for r in range(ROUNDS))},
{assign.format(r=ROUNDS)},
s AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c{ROUNDS}),
o AS (SELECT vec, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec)
SELECT k.vec_id, o.code, o.error, CAST(sum(o.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, s.codebooks_sha256 FROM k JOIN o USING (vec), s
"""


SQL = _sql()
