"""Operators on pairs: embeddings, shingle sets, benchmark items, repeated passages."""

import random

import numpy as np
import pytest

from parlance.llm import decontamination, embeddings, jaccard, suffixes
from parlance.llm.graph import spanning
from tests.llm import brute

ODD = [(9000, None), (9001, ""), (9002, " \n "), (9003, "one two"), (9004, "ONE  Two"), (9005, "é É"), (None, "one two"), (9006, "x" * 3000), (9003, "one two")]


def frame(spark, rows, schema="doc_id long, text string"):
    """With further columns whose names an operator might use itself."""
    df = spark.createDataFrame(rows, schema)
    return df.selectExpr("*", "'a' AS key", "1 AS n", "'x' AS node", "2 AS gid", "3 AS h", "4 AS block", "5 AS item", "6 AS row").repartition(4)


def near_copies(seed, n):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + str(r.randrange(50))
    base = [[word() for _ in range(r.randrange(3, 80))] for _ in range(15)]
    rows = []
    for i in range(n):
        x = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            k = r.randrange(len(x) + 1)
            x[k:k + r.choice([0, 1, 1, 2])] = [word() for _ in range(r.choice([0, 1, 1, 2]))]
        rows.append((i * 3 + 1, " ".join(x)))
    return rows


def sorted_rows(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("block", [200, 5])
def test_jaccard(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "_BLOCK", block)
    rows = near_copies(4, 300) + ODD
    got = jaccard.near_duplicates(frame(spark, rows)).collect()
    want = [(d, *x) for (d, _), x in zip(rows, brute.jaccard(rows))]
    # An empty set is a component of its own, whatever the id.
    assert sorted_rows((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted_rows((d, n, c if n else d) for d, n, c in want)


def test_jaccard_nested_sets(spark):
    """Pairs of a text and a longer one that holds it: one prefix may cover the region of rare shingles, the other not."""
    r = random.Random(12)
    rows = []
    for i in range(4000):
        n = r.randrange(6, 46)
        words = ["p%dw%d" % (i, k) for k in range(n + r.randrange(n // 3 + 1) + 4)]
        rows += [(2 * i, " ".join(words[:n + 4])), (2 * i + 1, " ".join(words))]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = []
    for (a, x), (b, y) in zip(rows[::2], rows[1::2]):
        want += [(d, *z) for d, z in zip((a, b), brute.jaccard([(a, x), (b, y)]))]
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == sorted(want)


def test_jaccard_crowd_and_null_ids(spark, monkeypatch):
    """A crowd of near copies over many blocks, some of them linked and some not, and many documents without an id."""
    monkeypatch.setattr(jaccard, "_BLOCK", 50)
    r = random.Random(5)
    base = ["w%d" % r.randrange(10**6) for _ in range(60)]
    rows = []
    for i in range(2000):
        x = list(base)
        for _ in range(1 if i % 2 else 3):
            x[r.randrange(60)] = "m%d" % r.randrange(10**6)
        rows.append((i, " ".join(x)))
    lost = [" ".join("n%d" % r.randrange(10**6) for _ in range(20)) for _ in range(240)]
    rows += [(None, x) for x in lost] + [(None, x + " more") for x in lost] + [(None, lost[0])] * 20
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    want = [(d, *x) for (d, _), x in zip(rows, brute.jaccard(rows))]
    assert sorted_rows((x.doc_id, x.n_shingles, x.component_id) for x in got) == sorted_rows(want)
    roots = {}
    for x in got:
        if x.doc_id is None:
            roots.setdefault(x.root, []).append(x.n_shingles)
    assert len(roots) == 240 and sorted(len(v) for v in roots.values())[-2:] == [2, 22]


def test_jaccard_empty(spark):
    assert jaccard.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("salt", [4096, 3])
def test_suffixes(spark, monkeypatch, salt):
    monkeypatch.setattr(suffixes, "SALT", salt)
    r = random.Random(5)
    parts = ["".join(r.choice("abcd é") for _ in range(r.randrange(150, 700))) for _ in range(10)]
    rows = []
    for i in range(150):
        text = ""
        for _ in range(r.randrange(5)):
            p = r.choice(parts)
            a = r.randrange(len(p))
            x = p[a:a + r.randrange(600)]
            if x and r.random() < 0.4:
                k = r.randrange(len(x))
                x = x[:k] + r.choice("abcdé") + x[k + 1:]
            text += x + "".join(r.choice("abcd") for _ in range(r.randrange(50)))
        rows.append((i, text))
    rows += [*ODD, (1002, "a" * 3000), (1003, "ab" * 400), (1004, "x" * 199), (1005, "x" * 200), (1006, rows[5][1]), (1007, "abc" * 300 + "q" + "abc" * 100),
             (1008, "prefix " + "auxle " * 36 + "suffix" * 3)]
    got = suffixes.without_repeats(frame(spark, rows)).collect()
    want = [(d, *x) for (d, _), x in zip(rows, brute.repeats(rows))]
    assert sorted_rows((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == sorted_rows(want)


def test_suffixes_sorts_copies_once(spark):
    r = random.Random(13)
    passage = "".join(r.choice("abcdefgh ") for _ in range(300))
    rows = [(i, "head " + passage + " middle " + passage) for i in range(60)] + [(100, passage + " tail"), (101, "y" * 250)]
    df = frame(spark, rows)
    asked, _ = suffixes.repeated_spans(df.selectExpr("doc_id", "text"))
    keys = [x.key for x in asked.select("key").collect()]
    assert len(keys) == len(set(keys)) >= 2
    want = [(d, *x) for (d, _), x in zip(rows, brute.repeats(rows))]
    got = suffixes.without_repeats(df).collect()
    assert sorted_rows((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == sorted_rows(want)


def test_suffixes_empty(spark):
    assert suffixes.without_repeats(frame(spark, [])).count() == 0


def test_equal_strings_orders_deep_groups():
    r = np.random.default_rng(1)
    data = r.integers(97, 99, 4000).astype(np.uint8)
    data[1000:1400], data[2000:2400], data[3000:3300] = data[:400], data[100:500], data[50:350]
    at = np.arange(len(data) - 199)
    same = suffixes.equal_strings(data, at, np.zeros(len(at), np.int64))
    strings = [data[a:a + 200].tobytes() for a in at]
    assert all(strings[i] == strings[j] for i, j in enumerate(same))
    assert len(set(same.tolist())) == len(set(strings))


def test_decontamination(spark):
    r = random.Random(6)
    items = [(i, " ".join(r.choice("abcdefgh") + str(r.randrange(40)) for _ in range(r.randrange(1, 60)))) for i in range(40)]
    items += [(41, None), (42, ""), (43, items[3][1]), (44, "one two"), (None, items[5][1])]
    docs = list(ODD)
    for d in range(150):
        text = " ".join("w" + str(r.randrange(500)) for _ in range(r.randrange(60)))
        for _ in range(r.randrange(3)):
            w = items[r.randrange(40)][1].split()
            a = r.randrange(max(1, len(w) // 3))
            text += " " + " ".join(w[a:]).upper() + " " + " ".join("v" + str(r.randrange(500)) for _ in range(r.randrange(40)))
        docs.append((d % 140, text))
    got = decontamination.contained(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS h")).collect()
    assert {(x.doc_id, x.item_id, x.n_item, x.n_shared) for x in got} == brute.contained(docs, items)
    assert all(x.containment == x.n_shared / x.n_item for x in got)


def test_decontamination_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontamination.contained(frame(spark, ODD), none).count() == 0
    assert decontamination.contained(frame(spark, []), some).count() == 0


def vectors(seed, n, dim):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(12, dim))
    return [(i, (centres[g.integers(12)] + g.normal(size=dim) * g.choice([0.05, 0.3, 1.0])).astype(np.float32).tolist()) for i in range(n)]


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "INTERVAL", 40)
    monkeypatch.setattr(embeddings, "PIECE", 16)
    rows = vectors(3, 400, 24) + [(i + 500, v) for i, (_, v) in enumerate(vectors(3, 30, 24))] + [(1000 + i, v) for i, (_, v) in enumerate(vectors(9, 50, 7))]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [1.0, None] + [0.0] * 22), (2004, [float("nan")] * 24), (2005, [float("inf")] * 24),
             (2006, [1e-30] * 24), (2007, [1e30] * 24), (None, [1e30] * 24), (2007, [1e30] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS label", "2 AS node", "3 AS id", "4 AS a").repartition(3)
    got = embeddings.links(df).collect()

    def good(v):
        return v and None not in v and np.isfinite(v).all() and any(v)
    unit = [np.array(v, np.float64) / np.abs(v).max() if good(v) else None for _, v in rows]
    unit = [u / np.sqrt(u @ u) if u is not None else None for u in unit]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9]
    low = brute.least_reachable([d for d, _ in rows], pairs)
    count = np.zeros(len(rows), int)
    for i, j in pairs:
        count[i] += 1
        count[j] += 1
    want = [(d, int(n), c, d == c and d is not None) for (d, _), n, c in zip(rows, count, low)]
    assert sorted_rows((x.vec_id, x.n_links, x.component_id, x.kept) for x in got) == sorted_rows(want)


def test_embeddings_in_passes(spark, monkeypatch):
    """The same rows whether the intervals are held at once or a few at a time, and whether few or many pairs may link."""
    monkeypatch.setattr(embeddings, "INTERVAL", 40)
    monkeypatch.setattr(embeddings, "PIECE", 16)
    g = np.random.default_rng(5)
    far = g.normal(size=(500, 64))
    near = far[g.integers(0, 40, 500)] + g.normal(size=(500, 64)) * g.choice([0.05, 0.45], size=(500, 1))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(np.concatenate([far, near]))] + [(1000 + i, v) for i, v in vectors(6, 300, 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    count = {}
    for dim in (64, 7):
        ids, x = zip(*[(i, v) for i, v in rows if len(v) == dim])
        x = np.array(x) / np.linalg.norm(x, axis=1)[:, None]
        count.update(zip(ids, ((x @ x.T >= 0.9).sum(1) - 1).tolist()))
    want = sorted_rows(embeddings.links(df).collect())
    assert {x.vec_id: x.n_links for x in want} == count
    for name, value in (("ROUND", 30_000), ("FEW", 0), ("COLUMNS", 50)):
        monkeypatch.setattr(embeddings, name, value)
        assert sorted_rows(embeddings.links(df.selectExpr("vec_id", "cast(embedding AS array<double>) AS embedding")).collect()) == want


def test_spanning():
    """Forests of edges, and of the pairs that a matrix marks, join what all pairs join, with no pair more than it takes."""
    g = np.random.default_rng(2)
    for _ in range(200):
        both = g.random(g.integers(1, 14, 2)) < g.choice([0.1, 0.2, 0.6])
        n, (e, f) = sum(both.shape), np.nonzero(both)
        want = brute.least_reachable(range(n), zip(e.tolist(), (f + len(both)).tolist()))
        some, label = spanning(n, e, f + len(both))
        thin = embeddings._thinned(both)
        for one, two in ((e[some], f[some]), thin):
            assert both[one, two].all() and len(one) == n - len(set(want))
            assert brute.least_reachable(range(n), zip(one.tolist(), (two + len(both)).tolist())) == want
        assert label.tolist() == want


def test_embeddings_shuffle_follows_the_vectors(spark, monkeypatch):
    """64 intervals that are all close to each other: their vectors are not shuffled once per pair."""
    monkeypatch.setattr(embeddings, "INTERVAL", 40)
    g = np.random.default_rng(8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(g.normal(size=(2560, 64)).astype(np.float32))], "vec_id long, embedding array<float>").repartition(3)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    seen = {}

    def look():
        files = disk.getAllFiles()
        seen.update((f.getName(), f.length()) for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_"))
    look()
    before, write = set(seen), embeddings.stored
    monkeypatch.setattr(embeddings, "stored", lambda *x: (write(*x), look())[0])  # files of one step may be gone after the next
    assert embeddings.links(df).where("n_links = 0 AND kept").count() == 2560
    look()
    assert 0 < sum(size for name, size in seen.items() if name not in before) < 6 * 2560 * 64 * 8


def test_embeddings_levels_of_two_lengths(spark):
    """Three levels; the box that spans both lengths is the first of its eight."""
    rows = [(i, d, [0.0] * d, [0.0] * d) for i in range(128) for d in [8 if i < 68 else 16]]
    cut = spark.createDataFrame(rows, "id long, dim long, low array<double>, high array<double>")
    got = {(x.a, x.b) for x in embeddings.close_pairs(cut, len(rows)).collect()}
    assert got == {(a, b) for a in range(128) for b in range(a, 128) if (a < 68) == (b < 68)}


def test_embeddings_empty(spark):
    assert embeddings.links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
