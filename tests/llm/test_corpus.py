"""Operators over a whole corpus: ranked search, divergence of sources, mixing to target weights."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from parlance.llm import divergence, mixing, ranked_search, vocabulary
from parlance.llm import words as W
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string"
ODD = [(None, None, None, None), (9001, "", "en", ""), (9002, " \n\t ", None, "b"), (9003, "ONE two", "en", None), (9003, "ONE two", "en", None),
       (9003, "ONE two", "de", "b"), (None, "one TWO", "en", "a"), (9006, "x" * 70000, "en", "a"), (9007, "é É ß straße", "fr", "é"), (9008, "one " * 30000, "en", "hot")]


def corpus(seed, n):
    r = random.Random(seed)
    words = ["w%s%d" % (a, k) for a in "abé" for k in range(40)] + ["One", "two", "É", "x-y"]
    return [(i, " ".join(r.choice(words[:r.choice([5, 30, len(words)])]) for _ in range(int(r.lognormvariate(3, 1.2)))), r.choice(["en", "en", "de"]),
             r.choice(["hot", "hot", "hot", "a", "b", "c", "d", "e"])) for i in range(n)] + ODD


def frame(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema)
    return df.selectExpr("*", "1 AS n", "'x' AS term", "2 AS size", "3 AS h", "'y' AS part", "4 AS g", "5 AS item", "6 AS rank", "7 AS cell").repartition(4)


def twin(sql, **tables):
    con = duckdb.connect()
    for name, (rows, columns) in tables.items():
        con.register(f"{name}_", pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(columns)}))
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_")
    result = con.execute(sql)
    return [c[0] for c in result.description], result.fetchall()


DOCS = (("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()))
ITEMS = (("item_id", pa.int64()), ("text", pa.string()))


def same_rows(df, names, want):
    got = sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*names).collect()), key=repr)
    assert got == sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in want), key=repr)


def test_terms_with_one_hash(monkeypatch):
    """Terms are what their bytes are, also where every hash is the same."""
    monkeypatch.setattr(W, "pieces_hash", lambda data, starts, ends, fold=False: np.zeros(len(starts), np.uint64))
    terms = vocabulary.Terms(pa.array(["b a B", None, "", "a ab"]), W.NOT_LETTERS)
    assert [terms.bytes(terms.kind[i:i + 1])[0] for i in range(5)] == [b"b", b"a", b"b", b"a", b"ab"]
    assert terms.row.tolist() == [0, 0, 0, 3, 3]
    shard = divergence._build(pa.table({"lang": ["l"] * 3, "shards": [1] * 3, "shard": [0] * 3, "term": ["a", "b", "c"], "h": [0, 0, 0]}))
    held = divergence.Shard(7, shard.column("blob")[0].as_py())
    names = shard.column("terms")[0].as_py()
    slots = held.slots(terms, np.arange(len(terms)))
    assert [names[s - 7] if s >= 0 else None for s in slots] == [x.decode() if x != b"ab" else None for x in terms.bytes(np.arange(len(terms)))]


@pytest.mark.parametrize("pairs", [1 << 17, 40])
def test_ranked_search(spark, monkeypatch, pairs):
    monkeypatch.setattr(ranked_search, "PAIRS", pairs)
    monkeypatch.setattr(ranked_search, "BLOCK", 1 << 12)
    rows, r = corpus(1, 700), random.Random(2)
    texts = [t for _, t, _, _ in rows if t]
    items = [(i, " ".join(r.choice(texts).split()[:r.choice([1, 4, 12])])) for i in range(40)]
    items += [(100, None), (101, ""), (102, "nowhere"), (3, "one é"), (3, "one é"), (None, "two One"), items[5], (103, "one " * 5000)]
    got = ranked_search.ranked_search(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS score", "3 AS item"))
    names, want = twin(ranked_search.SQL, documents=(rows, DOCS), benchmark=(items, ITEMS))
    same_rows(got, names, want)
    assert max(Counter(row.item_id for row in got.collect()).values()) == ranked_search.K


def test_ranked_search_by_hand(spark):
    """Scores against a plain loop over documents and terms."""
    rows, items = corpus(5, 120), [(1, "wa1 wa2 WA3 two two"), (2, "É wé4 nowhere")]
    lists = [re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", brute.lower(t)) for _, t, _, _ in rows]
    count, length = sum(map(bool, lists)), sum(map(len, lists))
    want = []
    for item, text in items:
        scores = []
        for (doc, *_), terms in zip(rows, lists):
            score, m = 0, 50 + (50 * len(terms) * count) // length
            for t in set(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", brute.lower(text))):
                w = math.floor(1000 * math.log((2 * count + 2) / (2 * sum(t in x for x in lists) + 1)))
                score += w * (10**9 * terms.count(t) // (1000 * terms.count(t) + 20 * m)) if t in terms else 0
            scores += [(-score, doc is None, doc)] if score > 0 else []
        want += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:50])]
    same_rows(ranked_search.ranked_search(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")), ["item_id", "rank", "doc_id", "score"], want)


def test_shared_sums():
    """Every root adds up exactly its item's terms, and shared sets are summed once."""
    r = random.Random(3)
    common = [r.sample(range(300), 12) for _ in range(4)]
    sets = [sorted({*r.choice(common), *r.choice(common), *r.sample(range(300), 3)}) for _ in range(60)]
    item, term = (np.array(x) for x in zip(*((i, t) for i, s in enumerate(sets) for t in s)))
    graph, roots = ranked_search.shared_sums(item, term, 300)
    held = [Counter([n]) for n in range(300)]
    for a, b in zip(graph.left, graph.right):
        held.append(held[a] + held[b])
    assert [held[roots[i]] for i in range(60)] == [Counter(s) for s in sets]
    assert len(graph.left) < sum(len(s) - 1 for s in sets) / 2


@pytest.mark.parametrize("small", [False, True])
def test_source_divergence(spark, monkeypatch, small):
    if small:  # many shards, several rounds, full tables of slots and blocks of few terms
        for name, value in (("SHARD", 10), ("ROUND", 4000), ("SLOTS", 60), ("MATRIX", 40), ("SLICE", 1 << 12)):
            monkeypatch.setattr(divergence, name, value)
    rows = corpus(7, 900)
    names, want = twin(divergence.SQL, documents=(rows, DOCS))
    same_rows(divergence.source_divergence(frame(spark, rows)), names, want)
    assert {w[names.index("part")] for w in want} == {"pair", "term"}


def test_shares_of_large_counts():
    """Exact where a product of counts passes 64 bits."""
    r = random.Random(4)
    for _ in range(200):
        total, volume = r.randrange(1, 10**14), r.randrange(1, 10**8)
        count = r.randrange(total + 1)
        got = divergence._shares(np.array([count]), np.array([total]), volume)[0]
        assert got == 1 + 10**9 * (count + 5) // (total + 5 * volume)


@pytest.mark.parametrize("cell", [1 << 12, 7])
def test_source_mix(spark, monkeypatch, cell):
    monkeypatch.setattr(mixing, "CELL", cell)
    rows = corpus(8, 3000)
    names, want = twin(mixing.SQL, documents=(rows, DOCS))
    mix = mixing.mixed(frame(spark, rows))
    same_rows(mix, names, want)
    again = mixing.mixed(frame(spark, rows).repartition(3))
    assert sorted(mix.collect(), key=repr) == sorted(again.collect(), key=repr)


def test_mix_meets_its_targets(spark):
    rows = corpus(9, 4000)
    got = mixing.mixed(frame(spark, rows)).collect()
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len(brute.word_list(t))
    assert len(got) == len(rows) and all(r.source_size == size[r.source] and r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in got)
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    free, target = set(order), {}
    while True:  # share, stop what is above, share the rest again
        rest = sum(size.values()) - sum(target.values())
        above = {s for s in free if rest * weight[s] / sum(weight[x] for x in free) > 3 * size[s]}
        if not above:
            break
        target |= {s: 3 * size[s] for s in above}
        free -= above
    target |= {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.target == pytest.approx(target[r.source])
    longest = Counter()
    for r in got:
        longest[r.source] = max(longest[r.source], r.size)
    for s in order:
        few = sum(r.source == s for r in got) < 50
        assert abs(taken[s] - target[s]) <= (longest[s] if few else max(0.02 * target[s], 64)), s


def test_equal_documents_are_drawn_by_luck(spark):
    """Within a stratum of equal documents every one is drawn about as often as the others, over many hashes."""
    rows = [(i, "w " * 100 + str(i), "en", "ab"[i % 2]) for i in range(4000)]
    picked = [r for r in mixing.mixed(frame(spark, rows)).collect() if r.source == "a" and r.copies]
    assert len(picked) == pytest.approx(2000 * 2 / 3, abs=2)  # weights 1 and 2 share 4,000 documents of one size
    low = sum(r.doc_id < 2000 for r in picked)
    assert abs(low - len(picked) / 2) < 60


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert ranked_search.ranked_search(docs, items).count() == 0
    assert ranked_search.ranked_search(docs, spark.createDataFrame([(1, "one")], "item_id long, text string")).count() == 0
    assert ranked_search.ranked_search(frame(spark, ODD), items).count() == 0
    assert divergence.source_divergence(docs).count() == 0
    assert mixing.mixed(docs).count() == 0
    blank = spark.createDataFrame([(1, None, "en", "a"), (2, " ", "en", "b")], SCHEMA)
    assert sorted((r.lang, r.source, r.item, r.value, r["rank"]) for r in divergence.source_divergence(blank).collect()) == [("en", "a", "b", 0, 1), ("en", "b", "a", 0, 1)]
    assert [(r.size, r.target, r.taken) for r in mixing.mixed(blank).collect()] == [(0, 0.0, 0)] * 2
