"""Documents alike in their word shingles, by a grouped prefix join.

A document's set is that of its distinct five-word shingles (A-Z folded; the whole sequence if it is shorter). Sets are
ordered by one global order, rare shingles first, and two sets of a Jaccard similarity of 0.75 share a shingle in
their prefixes of n - ceil(0.75 n) + 1. Documents with equal sets are one class; classes with the same size and
prefix are one group, and only groups are joined on prefix shingles. Pairs of groups are expanded to their classes, and
those are verified on whole sets.

Nothing emits pairs of documents. Classes are dealt into blocks of bounded size in which alike ones lie together (by
the group most of their shared prefix leads to, their hub). Only components are returned, so links are found in two rounds.
The first verifies each block by itself, one class of each hub as a guest, which joins most of a crowd of near copies over
all its blocks in a row per class. The second takes only shingles whose groups lie in different components and holds what is
one component in a cell of a block against the other cells; pairs are skipped only where both ends share a component
already. A task verifies one pair of blocks by a matrix product and returns a spanning forest of the links. The order
rests on counts of the 131,072 most frequent shingles, a list of fixed length that decides what work is done, never a result.

Shingles are 64-bit hashes, sets 128-bit digests. Defined cases: null and empty texts have an empty set, link
with nothing and are components of their own; rows that repeat are each reported; component_id is the smallest doc_id
reachable, where null ids don't count (null if there is no other).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import words as W
from parlance.llm.columns import groups, stored, table, texts
from parlance.llm.graph import components, forest

PERCENT = 75
FREQUENT = 1 << 17
_SEEN = 4
_BLOCK = 200
_SLICE = 1 << 21
BAND = 1.08
_U = np.uint64
#: Rare shingles up to this hash, a fifth of them; a prefix of a quarter of a set mostly reaches beyond.
REGION = _U(int(0.2 * 2**64))


def sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, value, bounds): the distinct shingles of each row, sorted."""
    data, offsets = W.buffers(column)
    hashes, _, _, bounds = W.words(data, offsets)
    row, value = W.distinct_by_row(*W.shingles(hashes, bounds))
    return row, value, np.searchsorted(row, np.arange(len(offsets)))


def _sums(value: np.ndarray, bounds: np.ndarray, salt: int) -> np.ndarray:
    total = np.concatenate([np.zeros(1, _U), np.cumsum(W.mix(value ^ _U(salt)))])
    return total[bounds[1:]] - total[bounds[:-1]]


def digests(value: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """128 bits for each set, whatever its order."""
    pair = np.stack([_sums(value, bounds, 0x51ED270B), _sums(value, bounds, 0x7A3D91C5)], 1)
    return [x.tobytes() for x in np.ascontiguousarray(pair)]


def _count(batches):
    """Shingles in many documents of a partition; what was seen once is forgotten when the list grows long."""
    values, counts, fresh, size = np.empty(0, _U), np.empty(0, np.int64), [], 0

    def merged():
        every = np.concatenate([values, *fresh])
        weight = np.concatenate([counts, np.ones(len(every) - len(values), np.int64)])
        out, place = np.unique(every, return_inverse=True)
        return out, np.bincount(place, weight, len(out)).astype(np.int64)

    for batch in batches:
        for part in W.slices(batch, most=_SLICE):
            fresh.append(sets(part.column("text"))[1])
            size += len(fresh[-1])
            if size > 1 << 21:
                values, counts = merged()
                values, counts = values[counts > 1], counts[counts > 1]
                fresh, size = [], 0
    values, counts = merged()
    keep = counts >= _SEEN
    yield pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), pa.array(counts[keep])], ["h", "n"])


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and their counts; at most FREQUENT."""
    rows = docs.select("text").mapInArrow(_count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(FREQUENT).toPandas()
    h = rows["h"].to_numpy(np.int64).view(_U)
    order = np.argsort(h)
    return h[order], rows["n"].to_numpy(np.int64)[order]


def _prefixes(known: np.ndarray, counts: np.ndarray):
    def run(batches):
        met: set[bytes] = set()
        for batch in batches:
            for part in W.slices(batch, most=_SLICE):
                row, value, bounds = sets(part.column("text"))
                size = np.diff(bounds)
                weight = np.zeros(len(value), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, value), len(known) - 1)
                    weight = np.where(known[at] == value, counts[at], 0)
                order = np.lexsort((value, weight, row))
                ranked = value[order]
                place = np.arange(len(value)) - np.repeat(bounds[:-1], size)
                length = size - (size * PERCENT + 99) // 100 + 1
                chosen = place < np.repeat(length, size)
                prefix = ranked[chosen]
                ends = np.concatenate([[0], np.cumsum(np.where(size > 0, length, 0))])
                # How much of a set lies beyond a region that its prefix covers; all of it where the prefix ends before.
                inner = np.concatenate([[0], np.cumsum((weight == 0) & (value < REGION))])
                last = bounds[:-1][size > 0] + length[size > 0] - 1
                covered = np.zeros(len(size), bool)
                covered[size > 0] = (weight[order][last] > 0) | (ranked[last] >= REGION)
                rest = size - np.where(covered, inner[bounds[1:]] - inner[bounds[:-1]], 0)
                group = W.mix(_sums(prefix, ends, 0x3C6EF372) ^ size.astype(_U))
                nodes = digests(value, bounds)
                lists = []
                for i, node in enumerate(nodes):
                    again = node in met
                    lists.append([] if again else prefix[ends[i]:ends[i + 1]].view(np.int64))
                    met.add(node)
                    if len(met) > 1 << 20:
                        met = set()
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("text_hash"), pa.array(size, pa.int64()), pa.array(nodes, pa.binary()), pa.array(group.view(np.int64)),
                    pa.array(rest, pa.int64()), pa.array(covered), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "text_hash", "n", "node", "gid", "rest", "covered", "prefix"])
    return run


_PREFIXES = "doc_id long, text_hash long, n long, node binary, gid long, rest long, covered boolean, prefix array<long>"


def shared_tokens(rows: DataFrame) -> DataFrame:
    """(token, gid, low): prefix shingles of several groups, and the smallest group that has each."""
    tokens = rows.select(F.explode("prefix").alias("token"), "gid")
    several = tokens.groupBy("token").agg(F.min("gid").alias("low"), F.max("gid").alias("high")).where("low < high").drop("high")
    return stored(tokens.join(several, "token").distinct(), "jaccard-shared")


def blocks(classes: DataFrame, shared: DataFrame) -> DataFrame:
    """Adds `block`, `hub` and `common` to classes: about _BLOCK of them lie together.

    A group's hub is the group that is the smallest of most of its shared shingles (`common` of them), which alike groups have
    in common for the most part; it lies where its hub lies. A crowded range is split by digest. Where a class lies decides
    cost, not results.
    """
    hubs = shared.groupBy("gid", "low").agg(F.count("*").alias("c")).groupBy("gid").agg(F.max(F.struct("c", "low")).alias("top"))
    hubs = hubs.select("gid", F.col("top.low").alias("hub"), F.col("top.c").alias("common"))
    keyed = classes.join(hubs, "gid", "left").withColumn("hub", F.coalesce("hub", "gid")).withColumn("key", F.shiftrightunsigned(F.xxhash64("hub"), 1))
    weight = 1 + F.col("n") / 2000
    total = classes.agg(F.sum(weight).alias("w")).first()["w"] or 1.0
    ranges = max(1, int(total / _BLOCK))
    dealt = keyed.withColumn("range", F.floor(F.col("key") / (float(1 << 63) / ranges)).cast("long"))
    split = dealt.groupBy("range").agg(F.ceil(F.sum(weight) / (1.5 * _BLOCK)).alias("ways"))
    return dealt.join(split, "range").withColumn("block", F.col("range") * (1 << 24) + F.pmod(F.xxhash64("node"), F.col("ways"))).drop("range", "ways", "key")


def _band(n):
    return F.floor(F.log(n) / float(np.log(BAND))).cast("int")


def _fit(x1: str, x2: str, y1: str, y2: str):
    """Whether sets of x1 to x2 and y1 to y2 shingles may be alike by their sizes."""
    return (100 * F.col(x2) >= PERCENT * F.col(y1)) & (100 * F.col(y2) >= PERCENT * F.col(x1))


def _enough(common, x1, x2, y1, y2, rest):
    """Whether sets of x1 to x2 and y1 to y2 shingles may be alike if their prefixes share `common` of them.

    Alike sets of x and y overlap by o >= (x + y) * 0.75 / 1.75. At most x - o of the shingles of one are missing in the other,
    and of the two prefixes the one that ends first lies within the reach of the other, so the prefixes share at least
    o - ceil(0.75 x) + 1, x being its size. What two prefixes that cover the region don't show of their overlap lies
    beyond it: at most `rest`, the smaller one (null where a prefix ends within the region, which says nothing of that kind).
    """
    shown = common * (100 * (100 + PERCENT))
    ends = F.least(PERCENT * (100 * y1 - PERCENT * x2), PERCENT * (100 * x1 - PERCENT * y2)) + (100 + PERCENT)
    beyond = 100 * (PERCENT * (x1 + y1) - (100 + PERCENT) * rest)
    return (shown >= ends) & F.coalesce(shown >= beyond, F.lit(True))


def _rest(name: str):
    return F.when(F.col("covered"), F.col("rest")).alias(name)


def stars(classes: DataFrame) -> DataFrame:
    """(b1, b2, node, held): what the first round verifies, each block by itself.

    In a block lie the classes that may be alike to their hub, with one class of that hub as a guest, and those of groups of
    several classes with one class of the group. So one row per class joins most of a crowd, wherever its blocks lie.
    """
    by_group = classes.groupBy("gid").agg(F.count("*").alias("members"), F.min(F.struct("node", "held", "n", _rest("r"))).alias("f"))
    by_group = stored(by_group.select("gid", "members", "f.node", "f.held", "f.n", "f.r"), "jaccard-groups")
    hub = by_group.select(F.col("gid").alias("hub"), F.col("node").alias("guest"), F.col("held").alias("guest_held"), F.col("n").alias("m"), F.col("r").alias("hub_rest"))
    leaves = classes.where("hub <> gid").join(hub, "hub")
    leaves = leaves.where(_fit("n", "n", "m", "m") & _enough(F.col("common"), F.col("n"), F.col("n"), F.col("m"), F.col("m"), F.when(F.col("covered") & F.col("hub_rest").isNotNull(), F.least("rest", "hub_rest"))))
    crowd = by_group.where("members > 1").select("gid", F.col("node").alias("guest"), F.col("held").alias("guest_held"))
    columns = ["block", "node", "held", "guest", "guest_held"]
    both = leaves.select(*columns).union(classes.join(crowd, "gid").select(*columns))
    each = both.select("block", F.explode(F.array(F.struct("node", "held"), F.struct(F.col("guest").alias("node"), F.col("guest_held").alias("held")))).alias("c"))
    return stored(each.select(F.col("block").alias("b1"), F.col("block").alias("b2"), "c.node", "c.held").distinct(), "jaccard-stars")


def jobs(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """(b1, b2, node, held): what the second round verifies, for each pair of blocks.

    Whatever may link two components of the first round is there; pairs within one need no row. A cell: the groups of
    one block and size band, by whether their prefixes cover the region. A piece: those of one component in a cell. Pieces
    are held against cells.
    """
    part = F.xxhash64("root")
    classes = classes.withColumn("part", part).withColumn("band", _band(F.col("n"))).withColumn("cell", F.xxhash64("block", "band", "covered")).withColumn("piece", F.xxhash64("cell", "part"))
    classes = stored(classes, "jaccard-pieces")

    def sizes(key: str, letter: str):
        return classes.groupBy(key).agg(F.min("n").alias(f"{letter}1"), F.max("n").alias(f"{letter}2"), F.max(_rest("r")).alias(f"{letter}_rest"))

    # What the filter asks of pieces and cells goes along, so that it meets the counts where they are made.
    places = classes.select("gid", "part", "cell", "piece", "block").distinct().join(sizes("piece", "x"), "piece").join(sizes("cell", "y"), "cell")
    found = shared.select("token", "gid").join(places, "gid").drop("gid").distinct()
    across = found.groupBy("token").agg(F.min("part").alias("p1"), F.max("part").alias("p2")).where("p1 < p2").select("token")
    entries = stored(found.join(across, "token"), "jaccard-entries")
    to = entries.groupBy("token", F.col("cell").alias("to"), F.col("block").alias("to_block"), "y1", "y2", "y_rest").agg(F.min("part").alias("p1"), F.max("part").alias("p2"))
    other = (F.col("p1") != F.col("part")) | (F.col("p2") != F.col("part"))
    met = entries.drop("cell", "y1", "y2", "y_rest").join(to, "token").where(other & _fit("x1", "x2", "y1", "y2"))
    met = met.groupBy("piece", "to").agg(F.count("*").alias("common"), *[F.first(c).alias(c) for c in ("block", "to_block", "x1", "x2", "x_rest", "y1", "y2", "y_rest")])
    rest = F.when(F.col("x_rest").isNotNull() & F.col("y_rest").isNotNull(), F.least("x_rest", "y_rest"))
    near = met.where(_enough(F.col("common"), F.col("x1"), F.col("x2"), F.col("y1"), F.col("y2"), rest)).select("piece", "block", F.col("to_block").alias("to"))
    # Members of one group share the whole prefix; those of several components are compared wherever they lie.
    own = places.join(places.groupBy("gid").agg(F.min("part").alias("p1"), F.max("part").alias("p2")).where("p1 < p2").select("gid"), "gid")
    lying = own.groupBy("gid", F.col("block").alias("to")).agg(F.min("part").alias("p1"), F.max("part").alias("p2"))
    near = near.union(own.join(lying, "gid").where(other).select("piece", "block", "to"))
    pairs = near.select(F.least("block", "to").alias("b1"), F.greatest("block", "to").alias("b2"), "piece").distinct()
    members = pairs.join(classes.select("piece", "node", "held"), "piece").select("b1", "b2", "node", "held")
    several = members.groupBy("b1", "b2").agg(F.count("*").alias("all")).where("all > 1").drop("all")
    return stored(members.join(several, ["b1", "b2"]), "jaccard-members")


def _columns(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(list, column) of every value that several lists share, by column."""
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    _, place, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    use = times[place] > 1
    owner, column = owner[use], number[place[use]]
    order = np.argsort(column, kind="stable")
    return owner[order], column[order]


def _common(lists: list[np.ndarray]) -> np.ndarray:
    """How many values each pair of lists shares, by products of slabs of a 0/1 matrix."""
    owner, column = _columns(lists)
    shared = np.zeros((len(lists), len(lists)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
        a, b = np.searchsorted(column, [low, low + 8192])
        part = np.zeros((len(lists), int(column[b - 1]) - low + 1), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        shared += part @ part.T
    return shared.astype(np.int64)


def _once(rows: pa.Table) -> pa.Table:
    """Each node of a group once; a document that is there twice brings its set twice."""
    first = {n: i for i, n in enumerate(rows.column("node").to_pylist())}
    return rows.take(pa.array(list(first.values())))


def _verified(batches):
    """A spanning forest of the links among the sets of each pair of blocks."""
    for rows in groups(batches, ["b1", "b2"]):
        rows = _once(rows)
        nodes = rows.column("node").to_pylist()
        lists = [np.frombuffer(x, _U) for x in rows.column("values").to_pylist()]
        size = np.array([len(x) for x in lists], np.int64)
        both = _common(lists)
        linked = 100 * both >= PERCENT * (size[:, None] + size[None, :] - both)
        np.fill_diagonal(linked, False)
        found = forest(linked)
        yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in found], pa.binary()), pa.array([nodes[j] for _, j in found], pa.binary())], ["a", "b"])


def _values(batches):
    """The set of each text whose digest is the one asked for, once."""
    met: set[bytes] = set()
    for batch in batches:
        for part in W.slices(batch, most=_SLICE):
            _, value, bounds = sets(part.column("text"))
            asked, keep = part.column("node").to_pylist(), []
            for i, d in enumerate(digests(value, bounds)):
                if d == asked[i] and d not in met:
                    keep.append(i)
                    met.add(d)
            yield pa.RecordBatch.from_arrays([pa.array([asked[i] for i in keep], pa.binary()), pa.array([value[bounds[i]:bounds[i + 1]].tobytes() for i in keep], pa.binary())], ["node", "values"])


def links(docs: DataFrame, members: DataFrame, name: str) -> DataFrame:
    """(a, b): enough links to join what is alike among the members (b1, b2, node, held) of each pair of blocks."""
    asked = members.select("node", F.col("held.doc_id").alias("id"), F.col("held.text_hash").alias("hash")).distinct().hint("merge")  # no bound on their number
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    held = docs.join(asked, same).select("node", "text").mapInArrow(_values, "node binary, values binary")
    dealt = members.select("b1", "b2", "node").join(held, "node").repartition("b1", "b2").sortWithinPartitions("b1", "b2")
    return stored(dealt.mapInArrow(_verified, "a binary, b binary"), name)


def _rooted(classes: DataFrame, edges: DataFrame, at: str) -> DataFrame:
    """classes with `root` moved along the components of edges between values of the column `at`."""
    roots = components(edges).withColumnRenamed("root", "top").withColumnRenamed("node", at)
    return classes.join(roots, at, "left").withColumn("root", F.coalesce("top", at)).drop("top")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, root, text_hash), one row per row of docs.

    root names the component where ids don't (null for empty sets), text_hash tells rows with one doc_id apart.
    """
    docs = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    order = frequent(docs)
    rows = stored(docs.mapInArrow(_prefixes(*order), _PREFIXES), "jaccard-prefixes")
    # A row that holds the set of a class: by id and text, since ids may be null or repeat.
    classes = rows.where("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.max(F.struct("doc_id", "text_hash")).alias("held"), F.first("n").alias("n"), F.first("gid").alias("gid"),
        F.first("rest").alias("rest"), F.first("covered").alias("covered"))
    shared = shared_tokens(rows)
    classes = stored(blocks(stored(classes, "jaccard-classes"), shared), "jaccard-blocks")
    classes = stored(_rooted(classes, links(docs, stars(classes), "jaccard-star-links"), "node"), "jaccard-rooted")
    found = links(docs, jobs(shared, classes), "jaccard-links")
    ends = classes.select("node", "root")
    found = found.join(ends.toDF("a", "x"), "a").join(ends.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return _labelled(rows, stored(_rooted(classes, found, "root").select("node", "rep", "root"), "jaccard-named"))


def _labelled(rows: DataFrame, named: DataFrame) -> DataFrame:
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = named.join(smallest, "root").select("node", "root", "component_id")
    return rows.join(labels, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "root", "text_hash")


def op3_jaccard_join(spark, sf_dir):
    """The component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("root", "text_hash")
