"""Operator 12: vector code compression, its codebooks trained over metric trees of the anchors hierarchy.

Each component c becomes floor(SCALE * c), and a vector is cut into PARTS
consecutive parts. The codebook of a part position starts as that part of the
ENTRIES smallest vec_ids; ROUNDS times every part goes to its nearest entry
and every entry becomes the floor of the mean of its parts; then parts are
assigned for good.

Vectors are laid into chunks of at most CHUNK rows (fewer if they are long).
For each part position a chunk gets a tree of balls, built middle-out: about
sqrt(n) anchors, each new one the point farthest from its own anchor, which
takes over the points that are nearer to it (none that is nearer to its anchor
than half the anchors' distance); the anchors' balls are joined pairwise into
the upper tree, smallest first, and each anchor's points are divided in the
same way below it. A ball keeps its centre, radius, count and sums. The trees
are written once to the shared folder.

A round is one pass over the trees. A ball inherits the candidate entries of
the ball above and drops those that are farther than its best one from
everywhere in the ball; with one left, it is wholly owned and its cached sums
and count are added; what reaches a leaf is compared exactly, in whole
numbers, with the candidates that are left. One row per entry and task leaves
the pass; Spark adds them up, and the codebooks (PARTS x ENTRIES entries) are
all that comes to the driver.

Defined results: vectors that are null, or hold a null or non-finite
component, take no part. Vectors of each length have codebooks of their own
(at most MAX_LENGTHS lengths); a length that PARTS doesn't divide is filled
up with zeros, which change no distance. Rows of one vec_id are taken by
their vector, null ids come last; fewer rows than ENTRIES give fewer entries.
Entries without parts stay. Repeated rows count as often as they come. An
error, or sum of errors, beyond a long is null. Empty tables give an empty
result. Other columns are dropped.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import stage
from .vectors import PORTION, exact, fits_long, floored, largest, matrices

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Rows of a chunk at most; points that a ball must have to be divided.
CHUNK, LEAF = 8192, 32
#: Codebooks go to the driver, one set for each length of vectors.
MAX_LENGTHS = 16
#: Labels whose sums of errors are broadcast at most; more are joined by a shuffle, each dealt out to SALTS tasks.
BROADCAST_LABELS, SALTS = 1_000_000, 32
#: Share of a distance that its rounding stays below.
ROUNDING = 1e-9
#: Sums are kept as two numbers, of the bits above and below this one, so that neither can leave 64 bits.
HALF = 32


@dataclass
class Tree:
    """Balls over the points of one part position of a chunk, numbered from the root; a ball's points are order[start:end]."""
    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    children: np.ndarray  # balls x 2; -1 in a leaf
    centre: np.ndarray
    radius: np.ndarray
    high: np.ndarray      # the sums of the points' bits above HALF, and of those below
    low: np.ndarray


@dataclass
class _Ball:
    centre: np.ndarray
    radius: float
    count: int
    below: list[_Ball] = field(default_factory=list)
    points: np.ndarray | None = None


def _distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - to) ** 2).sum(axis=-1))


def anchored(points: np.ndarray, wanted: int) -> np.ndarray:
    """The anchor number of each point."""
    owner = np.zeros(len(points), np.int64)
    away = _distances(points, points[0])
    pivots = [0]
    while len(pivots) < wanted:
        far = int(away.argmax())
        if away[far] == 0:
            break
        gap = _distances(points[pivots], points[far])
        near = np.flatnonzero(away > gap[owner] / 2)  # no other point can be nearer to the new anchor
        new = _distances(points[near], points[far])
        taken = new < away[near]
        owner[near[taken]], away[near[taken]] = len(pivots), new[taken]
        pivots.append(far)
    return owner


def _joined(balls: list[_Ball]) -> _Ball:
    """One ball over all, pairs joined by the smallest ball that holds them."""
    centres, radii = np.stack([b.centre for b in balls]), np.array([b.radius for b in balls])

    def cost(i: int) -> np.ndarray:
        apart = _distances(centres, centres[i])
        return np.maximum((apart + radii + radii[i]) / 2, np.maximum(radii, radii[i]))

    costs = np.stack([cost(i) for i in range(len(balls))])
    costs[np.arange(len(balls)), np.arange(len(balls))] = np.inf
    last = 0
    for _ in range(len(balls) - 1):
        i, j = sorted(divmod(int(costs.argmin()), len(balls)))
        a, b = balls[i], balls[j]
        centre = (a.centre * a.count + b.centre * b.count) / (a.count + b.count)
        radius = max(float(_distances(x.centre, centre)) + x.radius for x in (a, b))
        balls[i] = _Ball(centre, radius, a.count + b.count, [a, b])
        centres[i], radii[i] = centre, radius
        new = np.where(np.isinf(costs[i]), np.inf, cost(i))
        costs[i], costs[:, i] = new, new
        costs[j], costs[:, j] = np.inf, np.inf
        last = i
    return balls[last]


def _ball(points: np.ndarray, own: np.ndarray) -> _Ball:
    """The ball over points[own], divided down to leaves."""
    mine = points[own]
    if len(own) > LEAF:
        owner = anchored(mine, int(np.ceil(len(own) ** 0.5)))
        if owner.any():
            order = np.argsort(owner, kind="stable")
            groups = np.split(order, np.flatnonzero(np.diff(owner[order])) + 1)
            return _joined([_ball(points, own[g]) for g in groups])
    centre = mine.mean(axis=0)
    return _Ball(centre, float(_distances(mine, centre).max()), len(own), points=own)


def build(whole: np.ndarray) -> Tree:
    """The tree over whole-number points (one row each, one at least)."""
    order, start, end, children, centre, radius, laid = [], [], [], [], [], [], 0
    todo = [(_ball(whole.astype(float), np.arange(len(whole))), -1, 0)]
    while todo:  # depth first, so that a ball's points lie together
        ball, above, side = todo.pop()
        me = len(start)
        if above >= 0:
            children[above][side] = me
        start.append(laid)
        end.append(laid + ball.count)
        children.append([-1, -1])
        centre.append(ball.centre)
        radius.append(ball.radius)
        if ball.points is None:
            todo += [(ball.below[1], me, 1), (ball.below[0], me, 0)]
        else:
            order.append(ball.points)
            laid += len(ball.points)
    order = np.concatenate(order)
    edges = np.zeros((2, len(whole) + 1, whole.shape[1]), np.int64)
    np.cumsum(whole[order] >> HALF, axis=0, out=edges[0, 1:])
    np.cumsum(whole[order] & ((1 << HALF) - 1), axis=0, out=edges[1, 1:])
    start, end = np.array(start), np.array(end)
    return Tree(order.astype(np.int32), start, end, np.array(children), np.stack(centre), np.array(radius),
                edges[0, end] - edges[0, start], edges[1, end] - edges[1, start])


@dataclass
class Assigned:
    """What one pass down a tree gives."""
    balls: np.ndarray    # wholly owned balls and their entries
    owners: np.ndarray
    points: np.ndarray   # points of other leaves and their entries
    nearest: np.ndarray


def _nearest(points: np.ndarray, entries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """The nearest candidate of each point, exactly; ties to the lower number."""
    out = np.empty(len(points), np.int64)
    most = largest(points) + largest(entries)
    a, b = (exact(m, most * most * max(points.shape[1], 1)) for m in (points, entries))
    step = max(PORTION // max(candidates.shape[1] * max(points.shape[1], 1), 1), 1)
    for at in range(0, len(points), step):
        p, e = np.nonzero(candidates[at:at + step])
        distance = ((a[at:at + step][p] - b[e]) ** 2).sum(axis=1)
        first = np.flatnonzero(np.diff(p, prepend=-1))
        least = np.repeat(np.minimum.reduceat(distance, first), np.diff(np.append(first, len(p))))
        best = np.flatnonzero(distance == least)
        best = best[np.flatnonzero(np.diff(p[best], prepend=-1))]
        out[at + p[best]] = e[best]
    return out


def assign(tree: Tree, whole: np.ndarray, entries: np.ndarray) -> Assigned:
    """Every point's nearest entry: balls with one candidate left as a whole, the others' points one by one."""
    near = entries.astype(float)
    gaps = _distances(near[:, None], near[None])
    first = np.zeros(len(entries), bool)  # of equal entries the first gets all
    first[np.unique(entries, axis=0, return_index=True)[1]] = True
    at, candidates = np.zeros(1, np.int64), first[None]
    owned, owners, leaves, left = [], [], [], []
    while len(at):
        square = ((tree.centre[at][:, None] - near[None]) ** 2).sum(axis=2)
        best = np.where(candidates, square, np.inf).argmin(axis=1)
        least = square[np.arange(len(at)), best][:, None]
        reach = 2 * tree.radius[at][:, None] * gaps[best]
        # farther than the best one from everywhere in the ball, beyond rounding
        size = np.abs(tree.centre[at]).max(axis=1, initial=0)[:, None] + np.abs(near).max(initial=0)
        candidates = candidates & (square - least <= reach + ROUNDING * (square + least + reach + size * size))
        single = candidates.sum(axis=1) == 1
        leaf = tree.children[at, 0] < 0
        owned.append(at[single])
        owners.append(best[single])
        leaves.append(at[leaf & ~single])
        left.append(candidates[leaf & ~single])
        on = ~leaf & ~single
        at, candidates = tree.children[at[on]].ravel(), np.repeat(candidates[on], 2, axis=0)
    leaf = np.concatenate(leaves)
    counts = tree.end[leaf] - tree.start[leaf]
    places = np.repeat(tree.start[leaf] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    points = tree.order[places]
    nearest = _nearest(whole[points], entries, np.repeat(np.concatenate(left), counts, axis=0))
    return Assigned(np.concatenate(owned), np.concatenate(owners), points, nearest)


def _entry_of(tree: Tree, found: Assigned) -> np.ndarray:
    """The entry of each point of the chunk."""
    out = np.empty(len(tree.order), np.int64)
    out[found.points] = found.nearest
    counts = tree.end[found.balls] - tree.start[found.balls]
    places = np.repeat(tree.start[found.balls] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    out[tree.order[places]] = np.repeat(found.owners, counts)
    return out


def _parts(matrix: np.ndarray) -> np.ndarray:
    """rows x PARTS x width, filled up with zeros."""
    width = -(-matrix.shape[1] // PARTS)
    filled = np.zeros((len(matrix), PARTS * width), np.int64)
    filled[:, :matrix.shape[1]] = matrix
    return filled.reshape(len(matrix), PARTS, width)


def _smallest(matrix: np.ndarray) -> np.ndarray:
    """The matrix in the smallest type that holds it."""
    most = largest(matrix)
    return matrix.astype(next(t for t, bits in ((np.int16, 15), (np.int32, 31), (np.int64, 64)) if most < 1 << bits))


def _chunk_rows(size: int) -> int:
    return max(min(CHUNK, PORTION // max(size, 1)), 1)


def chunks(rows: DataFrame) -> DataFrame:
    """size, vec_id and label (arrays) and a chunk with its trees, of rows(vec_id, label, x)."""
    label_type = rows.schema["label"].dataType
    schema = f"size int, vec_id array<bigint>, label array<{label_type.simpleString()}>, chunk binary"
    names, arrow_label = ["size", "vec_id", "label", "chunk"], to_arrow_type(label_type)

    def packed(size: int, tables: list[pa.Table], found: list[np.ndarray]) -> pa.RecordBatch:
        own, whole = pa.concat_tables(tables), _parts(np.concatenate(found))
        data = pickle.dumps((_smallest(whole), [build(whole[:, p]) for p in range(PARTS)]))
        listed = [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own[c].combine_chunks().cast(t))
                  for c, t in (("vec_id", pa.int64()), ("label", arrow_label))]
        return pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), *listed, pa.array([data], pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[list[pa.Table], list[np.ndarray]]] = {}
        for batch in batches:
            plain = pa.table({c: batch.column(c) for c in ("vec_id", "label")})
            for size, at, matrix in matrices(batch.column("x")):
                tables, found = waiting.setdefault(size, ([], []))
                most = _chunk_rows(size)
                while len(at):
                    room = most - sum(map(len, found))
                    tables.append(plain.take(pa.array(at[:room])))
                    found.append(matrix[:room])
                    at, matrix = at[room:], matrix[room:]
                    if sum(map(len, found)) == most:
                        yield packed(size, tables, found)
                        tables.clear()
                        found.clear()
        for size, (tables, found) in waiting.items():
            if found:
                yield packed(size, tables, found)

    return rows.mapInArrow(run, schema)


def first_codebooks(rows: DataFrame) -> dict[int, np.ndarray]:
    """PARTS x entries x width for each length of vectors: the parts of the ENTRIES smallest vec_ids."""
    sizes = [r["size"] for r in rows.select(F.size("x").alias("size")).distinct().limit(MAX_LENGTHS + 1).collect()]
    if len(sizes) > MAX_LENGTHS:
        raise ValueError(f"vectors of more than {MAX_LENGTHS} lengths")
    found = {}
    for size in sizes:
        smallest = rows.filter(F.size("x") == size).orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).collect()
        found[size] = _parts(np.array([r["x"] for r in smallest], np.int64).reshape(len(smallest), size)).transpose(1, 0, 2)
    return found


def _round(trees: DataFrame, books: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The codebooks after one more round."""
    spark = trees.sparkSession
    sent = spark.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # the two sums' components, then the count
        for batch in batches:
            for size, data in zip(batch.column("size").to_pylist(), batch.column("chunk"), strict=True):
                whole, own = pickle.loads(data.as_py())
                book = sent.value[size]
                width = book.shape[2]
                total = sums.setdefault(size, np.zeros((*book.shape[:2], 2 * width + 1), np.int64))
                for p, tree in enumerate(own):
                    points = whole[:, p].astype(np.int64)
                    found = assign(tree, points, book[p])
                    balls = np.concatenate([tree.high[found.balls], tree.low[found.balls],
                                            (tree.end - tree.start)[found.balls, None]], axis=1)
                    single = points[found.points]
                    single = np.concatenate([single >> HALF, single & ((1 << HALF) - 1),
                                             np.ones((len(single), 1), np.int64)], axis=1)
                    np.add.at(total[p], found.owners, balls)
                    np.add.at(total[p], found.nearest, single)
        for size, total in sums.items():
            used = np.argwhere(total[:, :, -1] > 0)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(used), size, np.int32)), pa.array(used[:, 0].astype(np.int32)),
                pa.array(used[:, 1].astype(np.int32)), pa.array(total[used[:, 0], used[:, 1]].tolist(), pa.list_(pa.int64()))],
                ["size", "part", "entry", "sums"])

    parts = trees.select("size", "chunk").mapInArrow(run, "size int, part int, entry int, sums array<bigint>")
    cells = (parts.select("size", "part", "entry", F.posexplode("sums").alias("i", "v"))
             .groupBy("size", "part", "entry", "i").agg(F.sum("v").alias("v")).toPandas())
    new = {size: book.copy() for size, book in books.items()}
    for (size, part, entry), own in cells.sort_values("i").groupby(["size", "part", "entry"]):
        *v, count = own["v"].tolist()
        new[size][part, entry] = [((h << HALF) + low) // count for h, low in zip(v[:len(v) // 2], v[len(v) // 2:], strict=True)]
    return new


def train(trees: DataFrame, books: dict[int, np.ndarray], rounds: int = ROUNDS) -> dict[int, np.ndarray]:
    for _ in range(rounds):
        books = _round(trees, books)
    return books


def sha256_of(book: np.ndarray) -> str:
    """Of the components in decimals, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def _coded(trees: DataFrame, books: dict[int, np.ndarray]) -> DataFrame:
    """vec_id, label, code, error, codebooks_sha256 of every row."""
    sent = trees.sparkSession.sparkContext.broadcast((books, {size: sha256_of(b) for size, b in books.items()}))
    label_type = trees.schema["label"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                size = batch.column("size")[i].as_py()
                whole, own = pickle.loads(batch.column("chunk")[i].as_py())
                book, digest = sent.value[0][size], sent.value[1][size]
                codes, error = np.empty((len(whole), PARTS), np.uint8), 0
                most = (largest(whole) + largest(book)) ** 2 * max(size, 1)
                for p, tree in enumerate(own):
                    points = whole[:, p].astype(np.int64)
                    entry = _entry_of(tree, assign(tree, points, book[p]))
                    codes[:, p] = entry
                    error = error + ((exact(points, most) - exact(book[p], most)[entry]) ** 2).sum(axis=1)
                text = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id")[i].values, batch.column("label")[i].values,
                    pa.array([text[a:a + 2 * PARTS] for a in range(0, len(text), 2 * PARTS)]),
                    pa.array([int(e) if fits_long(int(e)) else None for e in error], pa.int64()),
                    pa.array([digest] * len(whole))], ["vec_id", "label", "code", "error", "codebooks_sha256"])

    return trees.mapInArrow(run, f"vec_id bigint, label {label_type.simpleString()}, code string, error bigint, codebooks_sha256 string")


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with the sum of error over the rows of the same label (nulls together) as label_error."""
    number = F.sum(F.col("error").cast("decimal(38,0)"))
    fits = number.between(F.lit(-2 ** 63).cast("decimal(38,0)"), F.lit(2 ** 63 - 1).cast("decimal(38,0)"))
    totals = stage(coded.groupBy(F.col("label").alias("of")).agg(
        F.when((F.count("error") == F.count("*")) & fits, number).cast("bigint").alias("label_error")))
    if totals.count() <= BROADCAST_LABELS:
        return coded.join(F.broadcast(totals), coded["label"].eqNullSafe(totals["of"])).drop("of", "label")
    salted = coded.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    totals = totals.withColumn("salted", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return salted.join(totals, salted["label"].eqNullSafe(totals["of"]) & (salted["salt"] == totals["salted"])).drop(
        "of", "label", "salt", "salted")


def encode(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of vectors(vec_id, embedding, label)."""
    rows = floored(vectors, SCALE, "vec_id", "label")
    trees = stage(chunks(rows))
    books = train(trees, first_codebooks(rows))
    out = with_label_error(stage(_coded(trees, books)))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
