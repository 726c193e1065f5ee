"""Nearest neighbours by inner product over randomly rotated one-bit codes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.llm.common import cut, partitions, written

SEED = 20
#: Bits of a code; shorter vectors are padded with zeros before the rotation, longer ones take their length.
BITS = 256
#: Bits of a query's component beside the codes.
QUERY_BITS = 6
#: Half width of the error bounds, in standard deviations of the estimate's error; and how many of the standard deviations of
#: a residual's product with a query, were it of random direction, the best of a cell may reach.
EPSILON, REACH = 2.4, 4.0
#: Rows the centres are fitted to, at most; rows of a cell, as long as a cell has 16 of those at least.
SAMPLE_ROWS, CELL_ROWS = 16_384, 1024
#: Rows that a task holds, of one cell or of several, and queries of a block of queries.
BLOCK_ROWS, BLOCK_QUERIES = 65_536, 16_384
#: Estimates that a task makes: a part's queries are dealt to so many tasks that none has many more.
TASK_ESTIMATES = 1 << 24


@dataclass
class Codes:
    packed: np.ndarray  # (n, bits / 64) of 64-bit words
    align: np.ndarray  # inner product of each unit residual with its code
    length: np.ndarray  # of each residual
    cell: np.ndarray


def words_of(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1).view(np.uint64)


class Rotation:
    """Codes of residuals to the nearest centre, under one random rotation."""

    def __init__(self, centres: np.ndarray, bits: int = BITS, seed: int = SEED) -> None:
        dim = centres.shape[1]
        self.centres, self.bits = centres, max(bits, -(-dim // 64) * 64)
        turned, upper = np.linalg.qr(np.random.default_rng(seed).standard_normal((self.bits, self.bits)))
        self.matrix = (turned * np.sign(np.diag(upper)))[:, :dim]

    def encode(self, vectors: np.ndarray) -> Codes:
        far = (self.centres**2).sum(axis=1)[None, :] - 2 * vectors @ self.centres.T
        cell = far.argmin(axis=1)
        rest = vectors - self.centres[cell]
        length = np.sqrt((rest**2).sum(axis=1))
        turned = (rest / np.where(length > 0, length, 1)[:, None]) @ self.matrix.T
        align = np.abs(turned).sum(axis=1) / np.sqrt(self.bits)
        return Codes(words_of(turned > 0), np.where(align > 0, align, 1), length, cell)

    def estimate(self, codes: Codes, queries: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
        """(queries, rows) inner products as estimated from the packed bits, and the half width of their bounds.

        <x, q> = <centre, q> + length * <o, q> for the unit residual o; <o, q> is estimated without bias by
        <code, q> / <code, o>, with an error of about sqrt((1 - <code, o>^2) / (bits - 1)) / <code, o>. A query's
        turned components are rounded to QUERY_BITS bits; then <code, q> is a sum of counts of common bits, one for
        each plane of the query's bits."""
        turned = queries @ self.matrix.T / np.sqrt(self.bits)
        low = turned.min(axis=1)
        step = np.maximum((turned.max(axis=1) - low) / ((1 << QUERY_BITS) - 1), 1e-300)
        level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
        ones = np.bitwise_count(codes.packed).sum(axis=1, dtype=np.int64)
        common = np.zeros((len(queries), len(codes.packed)))
        for b in range(QUERY_BITS):
            plane = words_of(level >> b & 1)
            for k in range(plane.shape[1]):
                common += np.bitwise_count(plane[:, k, None] & codes.packed[None, :, k]) * float(1 << b)
        whole = low * self.bits + step * level.sum(axis=1)
        dot = 2 * (low[:, None] * ones[None, :] + step[:, None] * common) - whole[:, None]
        scale = codes.length / codes.align
        guess = dot * scale + (queries @ self.centres.T)[:, codes.cell]
        norm = np.sqrt((queries**2).sum(axis=1))
        spread = np.sqrt(np.maximum(0, 1 - codes.align**2) / (self.bits - 1)) * norm[:, None]
        return guess, epsilon * scale * np.sqrt(spread**2 + (step**2 / 12)[:, None]) + 1e-9 * norm[:, None] * (codes.length + 1)


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision; equal rows get equal products, whatever is beside them."""
    return (rows * query).sum(axis=1)


def nearest_in_block(
    rotation: Rotation, ids: np.ndarray, vectors: np.ndarray, codes: Codes, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray,
    cells: list[list[int]], k: int, epsilon: float,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the cells that each query asks, which come sorted, the block's k nearest rows that reach the query's floor, its own
    row excluded. Rows whose upper bound reaches the floor and the k-th best exact product among those that look best
    are compared exactly."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(ids[:0], ids[:0], np.empty(0))]
    for own, query, least, asked in zip(query_ids, queries, floor, cells, strict=True):
        bounds = zip(np.searchsorted(codes.cell, asked, "left").tolist(), np.searchsorted(codes.cell, asked, "right").tolist(), strict=True)
        rows = np.concatenate([np.arange(x, z) for x, z in bounds])
        rows = rows[ids[rows] != own]
        if not len(rows):
            continue
        part = Codes(codes.packed[rows], codes.align[rows], codes.length[rows], codes.cell[rows])
        guess, half = (x[0] for x in rotation.estimate(part, query[None, :], epsilon))
        if len(rows) > k:
            best = rows[np.argpartition(-guess, k - 1)[:k]]
            least = max(least, products(vectors[best], query).min())
        rows = rows[guess + half >= least]
        score = products(vectors[rows], query)
        order = np.lexsort((ids[rows], -score))[:k]
        order = order[score[order] >= least]
        out.append((np.full(len(order), own), ids[rows][order], score[order]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def usable(vector: Column) -> Column:
    """Not null, zero or holding null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def centres_of(sample: np.ndarray, number: int, seed: int = SEED, rounds: int = 10) -> np.ndarray:
    """k-means on the sample."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[:number]].copy()
    for _ in range(rounds):
        cell = ((centres**2).sum(axis=1)[None, :] - 2 * sample @ centres.T).argmin(axis=1)
        for c in range(len(centres)):
            if (cell == c).any():
                centres[c] = sample[cell == c].mean(axis=0)
    return centres


def matrix(column: pa.ChunkedArray | pa.ListArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(-1, dim)


ASKED = "query_id long, v array<double>, floor double, part int, cells array<int>, rows long"
FOUND = "query_id long, vec_id long, score double"


def parts_of(counts: np.ndarray, block_rows: int) -> np.ndarray:
    """Cells in turn go to a part until it has block_rows rows; a cell with more has a part of its own."""
    part, size, out = 0, 0, np.zeros(len(counts), np.int32)
    for c, n in enumerate(counts.tolist()):
        if size and size + n > block_rows:
            part, size = part + 1, 0
        out[c], size = part, size + n
    return out


def search(
    table: DataFrame, is_query: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding",
    epsilon: float = EPSILON, bits: int = BITS, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that is_query picks its k nearest among all other rows,
    by inner product in double precision on the original vectors; equals go by the smaller id.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an id. Where
    vectors differ in length only those of the most frequent length take part, the longest of equals. Of rows with one
    id the smallest vector counts. Fewer than k candidates come back all; an empty table gives an empty result.

    The rotation is drawn from a seed, the centres of the cells are fitted to SAMPLE_ROWS rows at most; every row is
    encoded once and kept by its cell. A query first asks the cells whose centres are best until these have some
    hundred rows; the k-th best product there is its floor. Then it asks all cells whose best row could reach the
    floor: the centre's product and REACH standard deviations of what the longest residual adds. In a cell only rows
    whose upper bound reaches the floor and the k-th exact product of their block are compared exactly. What is missed
    is what the bounds miss; nothing limits the number of cells or rows that a query may ask. A task holds a part: some
    cells with block_rows rows together; larger cells and the queries of a part are split into blocks, so its memory is
    bounded whatever one cell's share of the rows.
    """
    spark = table.sparkSession
    rows = table.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("v"), is_query.alias("q"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = sizes["dim"] if sizes else 1
    rows = cut(
        rows.where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").cast("array<double>").alias("v"), F.max("q").alias("q"))
    )
    n = rows.count()
    span = 1 << 30
    place = F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(span))
    likely = rows.where(place < min(span, 2 * span * SAMPLE_ROWS // max(n, 1) + 1))
    picked = likely.orderBy(place, "vec_id").limit(SAMPLE_ROWS).select("v").collect()
    sample = np.array([r.v for r in picked], np.float64).reshape(-1, dim)
    number = max(1, min(-(-n // cell_rows), len(sample) // 16))
    centres = centres_of(sample, number) if len(sample) else np.zeros((1, dim))
    held = spark.sparkContext.broadcast(Rotation(centres, bits))  # SAMPLE_ROWS / 16 centres at most

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = held.value.encode(matrix(batch.column("v"), dim))
            yield pa.record_batch(
                [batch.column("vec_id"), batch.column("v"), pa.array(codes.cell.astype(np.int32)), pa.array([x.tobytes() for x in codes.packed], pa.binary()), pa.array(codes.align), pa.array(codes.length)],
                names=["vec_id", "v", "cell", "code", "align", "length"],
            )

    coded = written(
        rows.select("vec_id", "v").mapInArrow(encode, "vec_id long, v array<double>, cell int, code binary, align double, length double"), "codes"
    )
    counts, longest = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in coded.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("length")).collect():  # a row per cell
        counts[r["cell"]], longest[r["cell"]] = r["n"], r["length"]
    part_of = parts_of(counts, block_rows)
    held_cells = spark.sparkContext.broadcast((counts, longest, part_of))
    wide = min(1.0, REACH / np.sqrt(dim))

    def ask(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
        own, (count, length, part_of) = held.value, held_cells.value
        for batch in batches:
            queries = matrix(batch.column("v"), dim)
            dots = queries @ own.centres.T
            dots[:, count == 0] = -np.inf
            norm = np.sqrt((queries**2).sum(axis=1))
            order = np.argsort(-dots, axis=1, kind="stable")
            before = np.cumsum(count[order], axis=1) - count[order]
            near = np.zeros(dots.shape, bool)
            np.put_along_axis(near, order, before < 10 * k, axis=1)
            if not first:
                floor = batch.column("floor").to_numpy(zero_copy_only=False)
                near = ~near & (dots + wide * norm[:, None] * length + 1e-9 >= floor[:, None])
            query, cell = np.nonzero(near & (count > 0))
            order = np.lexsort((cell, part_of[cell], query))
            query, cell = query[order], cell[order]
            part = part_of[cell]
            start = np.flatnonzero(np.r_[True, (query[1:] != query[:-1]) | (part[1:] != part[:-1])]) if len(query) else np.empty(0, np.int64)
            out = batch.take(pa.array(query[start]))
            floors = pa.array(np.full(len(start), -np.inf)) if first else out.column("floor")
            cells = pa.ListArray.from_arrays(pa.array(np.r_[start, len(query)].astype(np.int32)), pa.array(cell.astype(np.int32)))
            asked = pa.array(np.add.reduceat(count[cell], start) if len(start) else start)
            yield pa.record_batch(
                [out.column("vec_id"), out.column("v"), floors, pa.array(part[start]), cells, asked], names=["query_id", "v", "floor", "part", "cells", "rows"]
            )

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if left.num_rows and right.num_rows:
            left = left.sort_by([("cell", "ascending"), ("vec_id", "ascending")])
            number = lambda t, c: t[c].to_numpy()
            packed = np.frombuffer(b"".join(left["code"].to_pylist()), np.uint64).reshape(left.num_rows, -1)
            codes = Codes(packed, number(left, "align"), number(left, "length"), number(left, "cell"))
            found = nearest_in_block(
                held.value, number(left, "vec_id"), matrix(left["v"], dim), codes, number(right, "query_id"), matrix(right["v"], dim),
                number(right, "floor"), right["cells"].to_pylist(), k, epsilon,
            )
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    rows_of = np.bincount(part_of, counts).astype(np.int64)
    cells = F.broadcast(spark.createDataFrame(list(enumerate(part_of.tolist())), "cell int, part int"))  # a row per cell

    def met(asked: DataFrame) -> DataFrame:
        plan = []
        for r in asked.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows")).collect():  # a row per part
            blocks = partitions(spark, int(rows_of[r["part"]]), block_rows)
            plan.append((r["part"], blocks, max(partitions(spark, r["n"], block_queries), partitions(spark, r["rows"], TASK_ESTIMATES * blocks))))
        plan = F.broadcast(spark.createDataFrame(plan, "part int, blocks int, turns int"))  # a row per part
        deal = lambda c, count: F.pmod(F.xxhash64(c, F.lit(1)), count).cast("int")
        every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
        base = coded.join(cells, "cell").join(plan, "part").withColumn("block", deal("vec_id", "blocks")).withColumn("turn", every("turns"))
        queries = asked.join(plan, "part").withColumn("turn", deal("query_id", "turns")).withColumn("block", every("blocks"))
        meeting = ["part", "block", "turn"]
        return base.drop("blocks", "turns").groupBy(*meeting).cogroup(queries.drop("blocks", "turns").groupBy(*meeting)).applyInArrow(run, FOUND)

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    queries = rows.where("q").select("vec_id", "v")
    start = cut(best(met(cut(queries.mapInArrow(lambda b: ask(b, True), ASKED)))).drop("rank"), narrow=True)
    floors = start.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    floored = queries.join(floors.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").select("vec_id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    more = met(cut(floored.mapInArrow(lambda b: ask(b, False), ASKED)))
    return best(start.unionByName(more)).select("query_id", "rank", "vec_id", "score")
