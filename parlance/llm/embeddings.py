"""Near copies among vectors by an epsilon grid order join.

Two vectors link at a cosine of 0.9 or more, that is at a distance of at most sqrt(0.2) between their unit vectors. Unit
vectors are projected on the leading principal axes, which never makes a distance longer; cells of that width along the
axes, in lexicographic order, put the vectors in a sequence. The sequence is cut into intervals of 2,048 with
their bounding boxes. Starting from a few long intervals, pairs are refined level by level into pairs of shorter ones, and a pair
is dropped as soon as its boxes are further apart than two linked vectors can be. What remains is compared exactly, in
pieces of 256 that are skipped by their boxes in the same way. The later intervals of the pairs are broadcast, 16 MB at
once, and the earlier ones compared with them where they lie, so no vector is shuffled for a pair. Products along the leading axes,
with the lengths of what is left, bound the cosine from above; vectors they don't keep apart are compared whole. A task returns
counts and a spanning forest of links, never the links themselves.

Equal vectors are one class and count by their number. Defined cases: vectors that are null, empty, zero or hold a null or
non-finite component link with nothing and are their own component; vectors of different length never link; rows that
repeat a vec_id are vectors of their own; a null vec_id doesn't name a component.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.llm.columns import stored, table
from parlance.llm.graph import components, spanning

COSINE = 0.9
FAR = float(np.sqrt(2 - 2 * COSINE)) + 1e-9
AXES = 4
BOX = 16
INTERVAL = 2048
PIECE = 256
FAN = 8
COLUMNS = 1024
FEW = 4096
STRAYS = 4.5
ROUND = 16 << 20


def _given(data, dim: int, n: int) -> np.ndarray:
    """Vectors from their bytes, as they were given: a float takes 4 bytes, a double 8."""
    return np.frombuffer(data, np.float32 if len(data) == 4 * dim * n else np.float64).reshape(n, dim)


def _units(given: np.ndarray) -> np.ndarray:
    x = given.astype(np.float64)
    x /= np.abs(x).max(1)[:, None]  # the square of a tiny or huge component would be lost
    x /= np.sqrt((x * x).sum(1))[:, None]
    return x


def _unit(batches):
    """(vec_id, node, dim, vector): the vector as given and the digest of its unit vector; nothing in place of vectors that can't link."""
    for batch in batches:
        column = batch.column("embedding")
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        values, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths)  # a null component is a NaN
        nodes, dims, vectors = [None] * len(lengths), np.zeros(len(lengths), np.int64), [None] * len(lengths)
        for d in np.unique(lengths[lengths > 0]).tolist():
            at = np.flatnonzero(lengths == d)
            x = values[(ends[at] - d)[:, None] + np.arange(d)]
            long = np.abs(x).max(1)
            good = np.isfinite(long) & (long > 0)
            at, x = at[good], x[good]
            dims[at] = d
            for i, v, u in zip(at.tolist(), x, _units(x)):
                nodes[i], vectors[i] = hashlib.blake2b(u, digest_size=16).digest(), v.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(nodes, pa.binary()), pa.array(dims), pa.array(vectors, pa.binary())],
                                         ["vec_id", "node", "dim", "vector"])


def _matrix(column, dim: int) -> np.ndarray:
    return _units(_given(b"".join(column.to_pylist()), dim, len(column)))


def _moments(batches):
    total: dict[int, list] = {}
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for d in np.unique(dims).tolist():
            x = _matrix(batch.column("vector").filter(pa.array(dims == d)), d)
            t = total.setdefault(d, [0, 0.0, 0.0])
            t[0], t[1], t[2] = t[0] + len(x), t[1] + x.sum(0), t[2] + x.T @ x
    for d, (n, s, q) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([n]), pa.array([s.tobytes()], pa.binary()), pa.array([q.tobytes()], pa.binary())], ["dim", "n", "s", "q"])


def _added(rows: pa.Table) -> pa.Table:
    add = lambda c: sum(np.frombuffer(x, np.float64) for x in rows.column(c).to_pylist()).tobytes()
    return pa.table({"dim": rows.column("dim").slice(0, 1), "n": pa.array([sum(rows.column("n").to_pylist())]), "s": pa.array([add("s")], pa.binary()), "q": pa.array([add("q")], pa.binary())})


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length, leading orthonormal axes as columns, BOX where there are as many, and more where it takes more
    to tell most pairs apart; one small matrix per partition is summed."""
    schema = "dim long, n long, s binary, q binary"
    rows = classes.select("dim", "vector").mapInArrow(_moments, schema).groupBy("dim").applyInArrow(_added, schema).collect()
    out = {}
    for r in rows:
        s, q = np.frombuffer(r["s"], np.float64), np.frombuffer(r["q"], np.float64).reshape(r["dim"], r["dim"])
        spread, axes = np.linalg.eigh(q / r["n"] - np.outer(s, s) / r["n"] ** 2)
        spread, axes = np.maximum(spread[::-1], 0), axes[:, ::-1]
        square = (s / r["n"] @ axes) ** 2
        # The bound of two vectors' cosine after each axis: its mean, and how far it strays from that.
        mean = 1 - np.cumsum(spread)
        strays = np.sqrt(np.cumsum(spread * (spread + 2 * square)))
        enough = np.flatnonzero(mean + STRAYS * strays <= COSINE)
        out[r["dim"]] = np.ascontiguousarray(axes[:, :max(BOX, int(enough[0]) + 1 if len(enough) else len(spread))])
    return out


def _cells(axes: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                at = _matrix(part.column("vector"), d) @ axes[d][:, :AXES]
                cell = np.floor(at / FAR).astype(np.int64)
                cells = [pa.array(cell[:, k]) if k < cell.shape[1] else pa.array(np.zeros(len(at), np.int64)) for k in range(AXES)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "dim", "many", "vector")), *cells, pa.array(at[:, 0])],
                                                 ["node", "dim", "many", "vector", *(f"c{k}" for k in range(AXES)), "along"])
    return run


def _cut(axes: dict[int, np.ndarray]):
    """Intervals of a sorted partition: their boxes and their vectors."""
    def run(batches):
        from pyspark import TaskContext

        part, number, kept, size = TaskContext.get().partitionId(), 0, [], 0

        def out(rows: pa.Table):
            d = rows.column("dim")[0].as_py()
            at = _matrix(rows.column("vector"), d) @ axes[d][:, :BOX]
            nodes, matrix = (b"".join(rows.column(c).to_pylist()) for c in ("node", "vector"))
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([d], pa.int64()),
                pa.array([at.min(0).tolist()], pa.list_(pa.float64())), pa.array([at.max(0).tolist()], pa.list_(pa.float64())), pa.array([nodes], pa.binary()),
                pa.array([rows.column("many").to_pylist()], pa.list_(pa.int64())), pa.array([matrix], pa.binary()), pa.array([len(nodes) + len(matrix)], pa.int64())], _CUT)

        for batch in batches:
            dims = batch.column("dim").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            for a, b in zip(edges, edges[1:]):
                while a < b:
                    if kept and kept[0].column("dim")[0].as_py() != dims[a]:
                        yield out(pa.Table.from_batches(kept))
                        number, kept, size = number + 1, [], 0
                    take = min(b - a, INTERVAL - size)
                    kept.append(batch.slice(a, take))
                    a, size = a + take, size + take
                    if size == INTERVAL:
                        yield out(pa.Table.from_batches(kept))
                        number, kept, size = number + 1, [], 0
        if kept:
            yield out(pa.Table.from_batches(kept))
    return run


_CUT = ["part", "number", "dim", "low", "high", "nodes", "many", "matrix", "bytes"]
_CUT_SQL = "part long, number long, dim long, low array<double>, high array<double>, nodes binary, many array<long>, matrix binary, bytes long"


def intervals(classes: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """The sequence in epsilon grid order, cut; `id` numbers the intervals from 0 without holes.

    Vectors are written once, FAN intervals to a file; the numbers are put beside them when they are read.
    """
    order = ["dim", *(f"c{k}" for k in range(AXES)), "along", "node"]
    files = -(-classes.count() // (FAN * INTERVAL))
    cells = classes.mapInArrow(_cells(axes), "node binary, dim long, many long, vector binary, " + ", ".join(f"c{k} long" for k in range(AXES)) + ", along double")
    cut = stored(cells.repartitionByRange(max(1, files), *order).sortWithinPartitions(*order).mapInArrow(_cut(axes), _CUT_SQL), "vector-intervals")
    counts = cut.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    before = stored(before.select("part", F.coalesce("before", F.lit(0)).alias("before")), "vector-before")
    return cut.join(F.broadcast(before), "part").withColumn("id", F.col("before") + F.col("number")).drop("number", "before")


def _apart(low_a, high_a, low_b, high_b):
    """The square of the least distance between two boxes."""
    gap = F.zip_with(F.zip_with(low_a, high_b, lambda p, q: p - q), F.zip_with(low_b, high_a, lambda p, q: p - q), lambda p, q: F.greatest(p, q, F.lit(0.0)))
    return F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)


def close_pairs(cut: DataFrame, n: int) -> DataFrame:
    """(a, b), a <= b: intervals that may hold linked vectors, by refining pairs of longer intervals."""
    levels = [cut.select("id", "dim", "low", "high")]
    while n > FAN:
        n = -(-n // FAN)
        fold = lambda c, f: F.filter(F.array(*[f(F.get(c, F.lit(k))) for k in range(BOX)]), lambda x: x.isNotNull()).alias(c)
        # min and max skip the null of a box of several lengths; the count doesn't.
        one_length = F.when((F.count("dim") == F.count("*")) & (F.min("dim") == F.max("dim")), F.min("dim")).alias("dim")
        levels.append(stored(levels[-1].groupBy(F.floor(F.col("id") / FAN).alias("id")).agg(one_length, fold("low", F.min), fold("high", F.max)), "vector-level"))
    pairs = None
    for boxes in reversed(levels):
        named = lambda s: boxes.select(F.col("id").alias(s), F.floor(F.col("id") / FAN).alias(f"up_{s}"), F.col("dim").alias(f"dim_{s}"), F.col("low").alias(f"low_{s}"), F.col("high").alias(f"high_{s}"))  # noqa: E731, B023
        left, right = named("a"), named("b")
        if pairs is None:  # at most FAN intervals
            both = left.withColumn("one", F.lit(0)).join(right.withColumn("one", F.lit(0)), "one")
        else:
            both = pairs.select(F.col("a").alias("up_a"), F.col("b").alias("up_b")).join(left, "up_a").join(right, "up_b")
        near = F.coalesce(F.col("dim_a") == F.col("dim_b"), F.lit(True)) & (
            F.col("dim_a").isNull() | F.col("dim_b").isNull() | (_apart(F.col("low_a"), F.col("high_a"), F.col("low_b"), F.col("high_b")) <= FAR * FAR))
        pairs = stored(both.where(F.col("a") <= F.col("b")).where(near).select("a", "b"), "vector-pairs")
    return pairs


class Held:
    """Intervals of one length of vectors that a task compares others with, laid end to end, and the boxes of their pieces."""

    def __init__(self, rows: list, axes: np.ndarray, piece: int):
        dim = rows[0]["dim"]
        each = [_given(r["matrix"], dim, len(r["many"])) for r in rows]
        starts = np.cumsum([0, *(len(x) for x in each)]).tolist()
        self.base = dict(zip((r["id"] for r in rows), starts))
        self.given = np.concatenate(each)
        self.nodes = np.concatenate([_digests(r["nodes"]) for r in rows])
        self.many = np.concatenate([np.array(r["many"], np.int64) for r in rows])
        self.links = np.zeros(starts[-1], np.int64)
        self.screen = np.empty((starts[-1], axes.shape[1] + 1), np.float32)
        pieces = []
        for r, x, start in zip(rows, each, starts):
            placed = _placed(_units(x), axes)
            self.screen[start:start + len(x)] = placed
            pieces += [(r["id"], start + i, start + i + len(at), *_box(at)) for i, at in _pieces(placed, piece)]
        self.of, self.start, self.end, self.low, self.high = map(np.array, zip(*pieces))

    def close(self, at: np.ndarray, wanted: np.ndarray, most: int):
        """Positions of the pieces that are wanted and may hold what links with rows `at`, as ranges of at most so many."""
        low, high = _box(at)
        gap = np.maximum(0, np.maximum(low - self.high, self.low - high))
        k = np.flatnonzero(wanted & ((gap * gap).sum(1) <= FAR * FAR))
        for run in np.split(k, np.flatnonzero(np.diff(k) > 1) + 1) if len(k) else ():
            first, last = int(self.start[run[0]]), int(self.end[run[-1]])
            for start in range(first, last, most):
                yield start, min(start + most, last)


def _digests(nodes) -> np.ndarray:
    return np.frombuffer(nodes, np.uint8).reshape(-1, 16)


def _box(placed: np.ndarray):
    at = placed[:, :-1][:, :BOX]
    return at.min(0), at.max(0)


def _pieces(at: np.ndarray, piece: int):
    return [(i, at[i:i + piece]) for i in range(0, len(at), piece)]


def _placed(unit: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit vectors along the axes, and the length of what is left. The product of two such rows is at least that of the vectors."""
    at = unit @ axes
    return np.column_stack([at, np.sqrt(np.maximum(0, 1 - (at * at).sum(1)))])


def _named(nodes: np.ndarray, at: np.ndarray) -> pa.Array:
    found = np.ascontiguousarray(nodes[at])
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.arange(0, 16 * len(at) + 1, 16, dtype=np.int32)), pa.py_buffer(found)])


def _batch(a: pa.Array, b: pa.Array | None, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a, pa.nulls(len(a), pa.binary()) if b is None else b, pa.array(n)], ["a", "b", "n"])


def _forest(e: np.ndarray, f: np.ndarray):
    """The pairs that make a spanning forest; e and f are numbers of different things."""
    own, one = np.unique(e, return_inverse=True)
    other, two = np.unique(f, return_inverse=True)
    some, _ = spanning(len(own) + len(other), one, two + len(own))
    return e[some], f[some]


def _thinned(both: np.ndarray):
    """Of the pairs (e, f) that a matrix marks those of a spanning forest: the first of each row and column, and what these leave apart."""
    rows, columns = np.flatnonzero(both.any(1)), np.flatnonzero(both.any(0))
    e, f = np.concatenate([rows, both[:, columns].argmax(0)]), np.concatenate([both[rows].argmax(1), columns])
    _, label = spanning(sum(both.shape), e, f + len(both))
    apart = np.nonzero(both & (label[:len(both), None] != label[len(both):]))
    return _forest(np.concatenate([e, apart[0]]), np.concatenate([f, apart[1]]))


def _compared(axes: dict[int, np.ndarray], sent):
    """Counts of links, and a spanning forest of them, between each interval and those of `sent`, a broadcast list, that may be close.

    Products along the leading axes, as floats with room for their rounding, say which pairs may link; those are compared as doubles.
    """
    def linked(h: Held, x, screen, many, own, ranges, count, room):
        """Adds up the links between a piece and ranges of what is held, and gives pairs (e, f) that join what they join; own: where the piece itself is held."""
        few, n = [], 0
        for first, last in ranges:
            product = np.matmul(screen, h.screen[first:last].T, out=room[:len(screen), :last - first])
            may = product >= np.float32(COSINE - (screen.shape[1] + 8) * 2.0 ** -22)
            rows = np.flatnonzero(may.any(1))
            may = may[rows]
            these = np.count_nonzero(may)
            if these > FEW:
                both = x @ _units(h.given[first:last]).T >= COSINE
                both &= np.arange(first, last) > own + np.arange(len(x))[:, None]  # each pair once
                weight = both.astype(np.float64)  # whole numbers below 2 ** 53
                count += (weight @ h.many[first:last]).astype(np.int64)
                h.links[first:last] += (many @ weight).astype(np.int64)
                e, f = _thinned(both)
                yield e, f + first
            elif these:
                e, f = np.nonzero(may)
                few.append((rows[e], f + first))
                n += these
            if few and (n > FEW or last == ranges[-1][1]):
                e, f = map(np.concatenate, zip(*few))
                fits = (f > e + own) & (np.einsum("ij,ij->i", x[e], _units(h.given[f])) >= COSINE)
                e, f = e[fits], f[fits]
                np.add.at(count, e, h.many[f])
                np.add.at(h.links, f, many[e])
                yield _forest(e, f)
                few, n = [], 0

    def run(batches):
        held, room = {}, np.empty((PIECE, COLUMNS), np.float32)
        for batch in batches:
            for own in batch.to_pylist():
                d = own["dim"]
                if d not in held:
                    held[d] = Held([r for r in sent.value if r["dim"] == d], axes[d], PIECE)
                h, many, nodes = held[d], np.array(own["many"], np.int64), _digests(own["nodes"])
                x = _units(_given(own["matrix"], d, len(many)))
                base = h.base.get(own["id"], -len(x))  # where it is held itself
                wanted, count, pairs = np.isin(h.of, own["near"]), np.zeros(len(x), np.int64), []
                for i, at in _pieces(_placed(x, axes[d]), PIECE):
                    ranges, part = list(h.close(at, wanted & (h.start >= base + i), COLUMNS)), slice(i, i + PIECE)
                    pairs += [(e + i, f) for e, f in linked(h, x[part], at.astype(np.float32), many[part], base + i, ranges, count[part], room)]
                if pairs:
                    e, f = _forest(*map(np.concatenate, zip(*pairs)))
                    yield _batch(_named(nodes, e), _named(h.nodes, f), np.zeros(len(e), np.int64))
                    hit = np.flatnonzero(count)
                    yield _batch(_named(nodes, hit), None, count[hit])
        for h in held.values():
            hit = np.flatnonzero(h.links)
            yield _batch(_named(h.nodes, hit), None, h.links[hit])
    return run


def compared(cut: DataFrame, pairs: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """(a, b, n): links of a spanning forest as (a, b), and numbers of links as (a, null, n) that add up.

    The later intervals of the pairs are broadcast, at most ROUND bytes at once and in as many passes as that takes; the earlier ones
    are read where they lie. So no vector is shuffled or written for a pair.
    """
    spark, found = cut.sparkSession, []

    def passed(first, last):
        held = cut.where(F.col("part").between(first["part"], last["part"]) & F.col("id").between(first["id"], last["id"]))
        sent = spark.sparkContext.broadcast([r.asDict() for r in sorted(held.select("id", "dim", "nodes", "many", "matrix").collect(), key=lambda r: r["id"])])
        near = pairs.where(F.col("b").between(first["id"], last["id"])).groupBy(F.col("a").alias("id")).agg(F.collect_list("b").alias("near"))
        own = cut.where(F.col("part") <= last["part"]).join(F.broadcast(near), "id").select("id", "dim", "nodes", "many", "matrix", "near")
        out = stored(own.mapInArrow(_compared(axes, sent), "a binary, b binary, n long"), "vector-links")
        sent.destroy()
        return out

    sizes = sorted(cut.select("id", "part", "bytes").collect())  # a row for each interval
    while sizes:
        room = max(1, int(np.searchsorted(np.cumsum([r["bytes"] for r in sizes]), ROUND, "right")))
        found.append(passed(sizes[0], sizes[room - 1]))
        sizes = sizes[room:]
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], "a binary, b binary, n long")


def links(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of vectors."""
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    units = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")).mapInArrow(
        _unit, "vec_id long, node binary, dim long, vector binary")
    rows = stored(units.select("vec_id", "node"), "vector-rows")
    classes = stored(units.where("node IS NOT NULL").groupBy("node").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("many"), F.first("dim").alias("dim"), F.first("vector").alias("vector")), "vector-classes")
    axes = principal_axes(classes)
    cut = intervals(classes.drop("rep"), axes)
    found = compared(cut, close_pairs(cut, cut.count()), axes)
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    named = classes.select("node", "rep", "many").join(roots, "node", "left").join(counts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("rep").alias("smallest"))
    labels = named.join(smallest, "root").select("node", "smallest", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("links"))
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("smallest"))
    return rows.join(labels, "node", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op2_embedding_links(spark, sf_dir):
    """Links and component of every vector."""
    return links(table(spark, sf_dir, "embeddings"))


SQL = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS q FROM embeddings),
ok AS (SELECT vec_id, x, sqrt(q) AS norm FROM v WHERE x IS NOT NULL AND len(x) = len(list_filter(x, lambda e: e IS NOT NULL AND isfinite(e))) AND q > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.9)
"""
SQL = "WITH RECURSIVE" + SQL[4:] + """, walk AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT walk.a, e.b FROM walk JOIN e ON walk.b = e.a),
low AS (SELECT a, min(b) AS component_id FROM walk GROUP BY a), n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id"""
