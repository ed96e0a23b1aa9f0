"""Ranked lexical search for many queries at once: what they share is summed once for a document.

A score is a sum over terms, so it can be put together from partial sums. The items' term sets are mined for sets that
several of them share: terms asked by the same items become one set, then pairs of sets that occur together in most items are
joined, round by round. The result is a graph whose leaves are terms, whose inner nodes are partial accumulators with two parts each,
and whose roots are the items. For a block of documents every node that any of them touches is computed once,
level by level, and all items that need it read it from there.

The texts are read once for a group of items: each document leaves the asked terms it holds with their counts, and each slice
its totals. From those come the exact statistics and then the scores. A task keeps the best K rows of each item, a window takes the best of
those. Items are dealt by hash into groups of about PAIRS (item, term) pairs, which bounds what is broadcast; more items
than that make more passes. Within a task BLOCK cells of accumulators are held at once.

Terms are compared by their bytes, scores are 64-bit integers. Defined cases: a null text has no terms; rows with the same item_id are
one item, whose terms are those of all its rows; repeated documents are ranked each; a null doc_id comes after all others
of its score; items without terms, and documents without any of an item's terms, give no row.
"""

from __future__ import annotations

import pickle
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm import words as W
from parlance.llm.columns import stored, table
from parlance.llm.vocabulary import Terms, same

K = 50
PAIRS = 1 << 17
BLOCK = 1 << 21
SLICE = 1 << 22
NEAR = 12  # how far apart two sets may stand in an item, ordered by how many items ask them, to be joined
SCALE, SLOPE = 1_000_000_000, 50  # fixed values of the score
_POSTINGS = "doc_id long, n long, terms array<int>, times array<int>, docs long, words long"


def _item_terms(batches):
    for batch in batches:
        for part in W.slices(batch, most=SLICE):
            terms = Terms(part.column("text"), W.NOT_LETTERS)
            if not len(terms):
                continue
            row, kind = np.divmod(np.unique(terms.row * len(terms) + terms.kind), len(terms))
            yield pa.RecordBatch.from_arrays([part.column("item_id").take(pa.array(row)), pa.array(terms.bytes(kind), pa.binary()).cast(pa.string()),
                                              pa.array(terms.hash[kind].view(np.int64))], ["item_id", "term", "h"])


class _Graph:
    """Nodes 0 to `leaves` - 1 are terms; node `leaves` + i is the sum of left[i] and right[i]."""

    def __init__(self, leaves: int):
        self.leaves, self.left, self.right, self.level = leaves, [], [], [0] * leaves

    def join(self, a: int, b: int) -> int:
        self.left.append(a)
        self.right.append(b)
        self.level.append(max(self.level[a], self.level[b]) + 1)
        return len(self.level) - 1

    def joined(self, nodes: list[int]) -> int:
        """One node for the sum of several, no deeper than needed."""
        while len(nodes) > 1:
            nodes = [self.join(*nodes[i:i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
        return nodes[0]


def shared_sums(item: np.ndarray, term: np.ndarray, leaves: int) -> tuple[_Graph, dict[int, int]]:
    """The graph for distinct (item, term) pairs, and the root of each item."""
    graph = _Graph(leaves)
    order = np.lexsort((item, term))
    item, term = item[order], term[order]
    cuts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.empty(0, np.int64)
    alike = defaultdict(list)
    for a, b in zip(cuts, [*cuts[1:], len(term)]):
        alike[tuple(item[a:b].tolist())].append(int(term[a]))
    asked = {graph.joined(terms): len(items) for items, terms in alike.items()}
    sets: dict[int, set[int]] = defaultdict(set)
    for node, items in zip(asked, alike):
        for i in items:
            sets[i].add(node)
    while True:
        together = defaultdict(list)
        for i, nodes in sets.items():
            line = sorted(nodes, key=lambda x: (-asked[x], x))
            for at, a in enumerate(line):
                for b in line[at + 1:at + 1 + NEAR]:
                    together[a, b].append(i)
        often = sorted(((-len(items), pair) for pair, items in together.items() if len(items) > 1))
        if not often:
            break
        busy: dict[int, set[int]] = defaultdict(set)
        for _, (a, b) in often:
            where = [i for i in together[a, b] if not busy[i] & {a, b}]
            if len(where) > 1:
                node = graph.join(a, b)
                asked[node] = len(where)
                for i in where:
                    busy[i] |= {a, b}
                    sets[i] -= {a, b}
                    sets[i].add(node)
    return graph, {i: graph.joined(sorted(nodes, key=lambda x: graph.level[x])) for i, nodes in sets.items()}


def _plan(pairs: pa.Table) -> pa.Table:
    """One row: the terms of a group of items in the order of their hashes, and the pickled graph."""
    names, place = np.unique(pairs.column("term").to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
    hashes = np.empty(len(names), np.int64)
    hashes[place] = pairs.column("h").to_numpy()
    by_hash = np.argsort(hashes.view(np.uint64), kind="stable")
    rank = np.empty(len(names), np.int64)
    rank[by_hash] = np.arange(len(names))
    graph, roots = shared_sums(pairs.column("item").to_numpy(), rank[place], len(names))
    level = np.array(graph.level)
    steps = [np.flatnonzero(level == n) for n in range(1, level.max() + 1)] if len(level) else []
    blob = pickle.dumps((graph.leaves, np.array(graph.left, np.int64), np.array(graph.right, np.int64), steps,
                         np.array(list(roots), np.int64), np.array(list(roots.values()), np.int64)))
    return pa.table({"deal": pairs.column("deal").slice(0, 1), "terms": pa.array([names[by_hash].tolist()], pa.list_(pa.string())), "hashes": pa.array([hashes[by_hash].tolist()], pa.list_(pa.int64())),
                     "graph": pa.array([blob], pa.binary())})


def _postings(asked):
    """Documents as the asked terms they hold; one row of totals for each slice."""
    def run(batches):
        names, hashes = asked.value
        hashes = hashes.view(np.uint64)
        data = np.frombuffer(b"".join(names), np.uint8)
        length = np.array([len(n) for n in names], np.int64)
        start = np.cumsum(length) - length
        for batch in batches:
            for part in W.slices(batch, most=SLICE):
                terms = Terms(part.column("text"), W.NOT_LETTERS)
                n = np.bincount(terms.row, minlength=part.num_rows)
                number = np.full(len(terms), -1, np.int64)
                if len(terms):
                    at = np.searchsorted(hashes, terms.hash)
                    low = np.minimum(at, len(hashes) - 1)
                    open_ = np.flatnonzero(hashes[low] == terms.hash)
                    at = low[open_]
                    while len(open_):  # asked terms of one hash stand side by side
                        fits = length[at] == terms.length[open_]
                        fits[fits] = same(data, start[at[fits]], terms.data, terms.start[open_[fits]], length[at[fits]])
                        number[open_[fits]] = at[fits]
                        open_, at = open_[~fits], at[~fits] + 1
                        more = (at < len(hashes)) & (hashes[np.minimum(at, len(hashes) - 1)] == terms.hash[open_])
                        open_, at = open_[more], at[more]
                found = number[terms.kind]
                hit = found >= 0
                pairs, times = np.unique(terms.row[hit] * len(names) + found[hit], return_counts=True)
                row, found = np.divmod(pairs, len(names))
                rows, first = np.unique(row, return_index=True)
                bounds = pa.array(np.append(first, len(row)).astype(np.int32))
                size = len(rows) + 1
                blank = pa.nulls(size, pa.int64())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (found, times)]
                ids = pa.concat_arrays([part.column("doc_id").take(pa.array(rows)), pa.nulls(1, pa.int64())])
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([*n[rows].tolist(), None], pa.int64()),
                     *(pa.concat_arrays([x, pa.nulls(1, x.type)]) for x in lists),
                     *(pa.concat_arrays([blank[:-1], pa.array([int(x)])]) for x in ((n > 0).sum(), n.sum()))],
                    ["doc_id", "n", "terms", "times", "docs", "words"])
    return run


class _Best:
    """The K best rows of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.least, self.rows, self.waiting = k, np.ones(items, np.int64), [], 0
        self.room = max(4 * items * k, 1 << 16)

    def add(self, scores: np.ndarray, doc: np.ndarray, nameless: np.ndarray) -> None:
        item, at = np.nonzero(scores >= self.least[:, None])
        self.rows.append((item, scores[item, at], doc[at], nameless[at]))
        self.waiting += len(item)
        if self.waiting > self.room:
            self.prune()

    def prune(self) -> None:
        item, score, doc, nameless = (np.concatenate(x) for x in zip(*self.rows))
        order = np.lexsort((doc, nameless, -score, item))
        item, score, doc, nameless = item[order], score[order], doc[order], nameless[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = place < self.k
        last = place == self.k - 1
        self.least[item[last]] = score[last]
        self.rows, self.waiting = [(item[keep], score[keep], doc[keep], nameless[keep])], int(keep.sum())


def _scored(plan, k: int):
    """(item, doc_id, score): the best rows of each item in the partition."""
    def run(batches):
        blob, weight, docs, words = plan.value
        leaves, left, right, steps, items, roots = pickle.loads(blob)
        nodes = leaves + len(left)
        best = _Best(len(items), k)
        block = int(np.clip(BLOCK // max(nodes, 1), 16, 4096))
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                lists = part.column("terms")
                size = lists.value_lengths().to_numpy()
                term, times = lists.flatten().to_numpy(), part.column("times").flatten().to_numpy().astype(np.int64)
                n = part.column("n").to_numpy()
                row = np.repeat(np.arange(part.num_rows), size)
                m = 100 - SLOPE + (SLOPE * n * docs) // words
                value = weight[term] * ((SCALE * times) // (1000 * times + 20 * m[row]))
                touched = np.zeros(nodes, bool)
                touched[term] = True
                for step in steps:
                    touched[step] = touched[left[step - leaves]] | touched[right[step - leaves]]
                place = np.where(touched, np.cumsum(touched) - 1, touched.sum())  # the last row stays 0
                sums = np.zeros((int(touched.sum()) + 1, part.num_rows), np.int64)
                sums[place[term], row] = value
                for step in steps:
                    step = step[touched[step]]
                    sums[place[step]] = sums[place[left[step - leaves]]] + sums[place[right[step - leaves]]]
                ids = part.column("doc_id")
                best.add(sums[place[roots]], ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        if best.rows:
            best.prune()
            item, score, doc, nameless = best.rows[0]
            yield pa.RecordBatch.from_arrays([pa.array(items[item]), pa.array(doc, mask=nameless), pa.array(score)], ["item", "doc_id", "score"])
    return run


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, equal scores by ascending doc_id."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pairs = items.mapInArrow(_item_terms, "item_id long, term string, h long").distinct()
    pairs = stored(pairs, "item-terms")
    groups = max(-(-pairs.count() // PAIRS), 1)
    names = stored(pairs.select("item_id").distinct().select("item_id", F.monotonically_increasing_id().alias("item")), "items")
    dealt = F.pmod(F.xxhash64("item_id"), F.lit(groups)).cast("int")
    numbered = pairs.join(names.withColumnRenamed("item_id", "id"), F.col("item_id").eqNullSafe(F.col("id"))).select("item", "term", "h", dealt.alias("deal"))
    plans = stored(numbered.groupBy("deal").applyInArrow(_plan, "deal int, terms array<string>, hashes array<long>, graph binary"), "search-plans")
    found = spark.createDataFrame([], "item long, doc_id long, score long")
    for group in range(groups):
        found = found.unionByName(_search(docs, plans.where(F.col("deal") == group), k))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _search(docs: DataFrame, plan: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    row = plan.first()
    if row is None:
        return spark.createDataFrame([], "item long, doc_id long, score long")
    asked = spark.sparkContext.broadcast(([t.encode() for t in row["terms"]], np.array(row["hashes"], np.int64)))
    rows = stored(docs.mapInArrow(_postings(asked), _POSTINGS), "postings")
    totals = rows.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    # Not more rows than the plan has terms.
    weights = df.select("term", F.floor(1000 * F.log((2 * F.lit(totals["docs"]) + 2) / (2 * F.col("df") + 1))).alias("w")).collect()
    weight = np.zeros(len(row["terms"]), np.int64)
    for r in weights:
        weight[r["term"]] = r["w"]
    sent = spark.sparkContext.broadcast((bytes(row["graph"]), weight, totals["docs"], totals["words"]))
    held = rows.where(F.col("terms").isNotNull()).select("doc_id", "n", "terms", "times")
    return held.mapInArrow(_scored(sent, k), "item long, doc_id long, score long")


def op11_ranked_search(spark, sf_dir):
    """The 50 best documents for each benchmark item."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
t AS (SELECT count(*) FILTER (len(w) > 0) AS docs, sum(len(w))::BIGINT AS words FROM d),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, t GROUP BY term, docs),
part AS (SELECT tf.r, d.doc_id, tf.term, weights.w * (({SCALE} * tf) // (1000 * tf + 20 * (100 - {SLOPE} + (({SLOPE} * len(d.w) * docs) // words)))) AS s
    FROM tf JOIN d ON d.r = tf.r JOIN weights ON weights.term = tf.term, t),
scores AS (SELECT item_id, part.r, doc_id, sum(s)::BIGINT AS score FROM part JOIN asked ON asked.term = part.term GROUP BY ALL HAVING sum(s) > 0),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM scores)
SELECT * FROM ranked WHERE rank <= {K}"""
