"""Removal of passages that occur elsewhere, by deep-shallow sorting of suffixes.

A byte goes if a string of 200 bytes that covers it also starts anywhere else, in the same text or another. Sorting
all suffixes of a corpus is out of reach, so a filter comes first that loses nothing: equal 200-byte strings have equal
smallest 80-byte grams (by hash), and only runs of strings whose smallest gram occurs at least twice go on. Suffixes
with one smallest gram are then sorted together: by their gram and first bytes (the shallow part), and the groups of
long common prefixes left over as a blind trie does it, by looking only at the place where a member first
departs from the first of its group. Members that don't depart within 200 bytes are equal.

Copies of a whole text are one text from the start, known by their number. Runs with equal bytes are one run. A gram in
more than 4,096 texts is dealt into salted parts that are sorted by themselves; strings that are alone in their
part are then counted across parts by their fingerprint. Results don't depend on the parts.

Defined cases: a null text is an empty one; texts under 200 bytes lose nothing; rows that repeat are copies of each
other, as are different ids with one text. A text is known by its 64-bit hash and length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.llm import words as W
from parlance.llm.columns import stored, table, texts

LENGTH = 200
GRAM = 80
WIDTH = LENGTH - GRAM + 1
SALT = 4096
_SEGMENT = 1 << 21
_BUFFER = 1 << 20
_U = np.uint64


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... , count[i] numbers each."""
    base = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return base + np.arange(len(base))


def smallest_grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every place with LENGTH bytes from it on, the smallest hash of the grams within them; and the hash of every gram."""
    n = len(data) - LENGTH + 1
    out, every = np.empty(max(0, n), _U), np.empty(max(0, len(data) - GRAM + 1), _U)
    for low in range(0, n, _SEGMENT):
        part = data[low:min(len(data), low + _SEGMENT + LENGTH - 1)]
        up, down = W.powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum(W._PLAIN[part] * up[:-1], out=sums[1:])
        v = W.mix((sums[GRAM:] - sums[:-GRAM]) * down[:len(part) - GRAM + 1])
        every[low:low + len(v)] = v
        size = -(-len(v) // WIDTH) * WIDTH
        grid = np.full(size, ~_U(0))
        grid[:len(v)] = v
        grid = grid.reshape(-1, WIDTH)
        ahead = np.minimum.accumulate(grid, 1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
        m = len(part) - LENGTH + 1
        out[low:low + m] = np.minimum(back[:m], ahead[WIDTH - 1:WIDTH - 1 + m])
    return out, every


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first place, last place, gram, whether it is there twice) of every run of places with one smallest gram."""
    least, every = smallest_grams(data)
    if not len(least):
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, _U), np.empty(0, bool)
    valid = np.zeros(len(data) + 1, np.int64)
    size = np.diff(offsets)
    long = size >= LENGTH
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[1:][long] - LENGTH + 1, -1)
    valid = np.cumsum(valid)[:len(least)] > 0
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets[:-1]] = True
    start = valid.copy()
    start[1:] &= (least[1:] != least[:-1]) | ~valid[:-1] | fresh[1:len(least)]
    first = np.flatnonzero(start)
    stop = valid.copy()
    stop[:-1] &= (least[1:] != least[:-1]) | ~valid[1:] | fresh[1:len(least)]
    last = np.flatnonzero(stop)
    size = last - first + WIDTH
    times = np.add.reduceat(every[_spread(first, size)] == np.repeat(least[first], size), np.cumsum(size) - size, dtype=np.int64) if len(first) else first
    return np.searchsorted(offsets, first, "right") - 1, first, last, least[first], times > 1


def _grams(batches):
    """(gram, text, n): smallest grams of each text and how often they head a run; n > 1 too if one run holds it twice."""
    met: set[int] = set()
    for batch in batches:
        for part in W.slices(batch, most=1 << 21):
            keys = part.column("key").to_numpy()
            new = np.array([k not in met for k in keys.tolist()], bool)
            met.update(keys.tolist())
            if len(met) > 1 << 21:
                met = set()
            part = part.filter(pa.array(new))
            row, _, _, gram, twice = runs(*W.buffers(part.column("text")))
            order = np.lexsort((gram, row))
            row, gram, twice = row[order], gram[order], twice[order]
            head = np.ones(len(row), bool)
            head[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
            at = np.flatnonzero(head)
            n = np.diff(np.append(at, len(row))) + (np.add.reduceat(twice, at) > 0 if len(at) else 0)
            yield pa.RecordBatch.from_arrays([pa.array(gram[at].view(np.int64)), pa.array(keys[new][row[at]]), pa.array(n, pa.int64())], ["gram", "key", "n"])


def _contexts(batches):
    """The bytes of every run whose gram is shared, with its place in the text."""
    for batch in batches:
        for part in W.slices(batch, most=1 << 21):
            data, offsets = W.buffers(part.column("text"))
            row, first, last, gram, _ = runs(data, offsets)
            asked = part.column("grams").to_pylist()
            wanted = np.array([g["gram"] for x in asked for g in x], np.int64)
            ways = np.array([g["ways"] for x in asked for g in x], np.int64)
            of = np.repeat(np.arange(len(asked)), [len(x) for x in asked])
            order = np.lexsort((wanted, of))
            wanted, ways, of = wanted[order], ways[order], of[order]
            # Both sides as one sortable pair: the row, then the gram.
            pair = np.array(list(zip(of.tolist(), wanted.tolist())), dtype=[("r", np.int64), ("g", np.int64)])
            mine = np.empty(len(row), pair.dtype)
            mine["r"], mine["g"] = row, gram.view(np.int64)
            place = np.minimum(np.searchsorted(pair, mine), max(0, len(pair) - 1))
            hit = np.flatnonzero(pair[place] == mine) if len(pair) and len(mine) else np.empty(0, np.int64)
            raw = data.tobytes()
            keys = part.column("key").to_numpy()
            yield pa.RecordBatch.from_arrays([
                pa.array(gram[hit].view(np.int64)), pa.array(keys[row[hit]] % ways[place[hit]]), pa.array(ways[place[hit]]), pa.array(keys[row[hit]]),
                pa.array(first[hit] - offsets[row[hit]]), pa.array([raw[a:b + LENGTH] for a, b in zip(first[hit].tolist(), last[hit].tolist())], pa.binary())],
                ["gram", "salt", "ways", "key", "start", "bytes"])


_CONTEXTS = "gram long, salt long, ways long, key long, start long, bytes binary"


def equal_strings(data: np.ndarray, at: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each place, the index of the first place of its group (in sorted order) with the same `length` bytes from it on."""
    n = len(at)
    same = np.arange(n)
    if n < 2:
        return same
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.zeros(len(data), _U)
    for k in range(8):
        word = (word << _U(8)) | padded[k:k + len(data)]
    # Shallow: the group and the first five bytes, in one machine word.
    head = (group.astype(_U) << _U(40)) | (word[at] >> _U(24))
    order = np.argsort(head, kind="stable")
    cut = np.flatnonzero(np.diff(head[order])) + 1
    part = np.repeat(np.arange(len(cut) + 1), np.diff(np.concatenate([[0], cut, [n]])))
    depth = np.full(n, 5, np.int64)
    while len(order):
        # Deep: groups of two and more, each against its first member.
        size = np.bincount(part)
        keep = size[part] > 1
        order, part, depth = order[keep], part[keep], depth[keep]
        if not len(order):
            break
        first = np.ones(len(part), bool)
        first[1:] = part[1:] != part[:-1]
        lead = order[first][np.cumsum(first) - 1]
        common = depth.copy()
        live = np.flatnonzero(~first)
        common[first] = length
        while len(live):
            a, b = word[np.minimum(at[order[live]] + common[live], len(data) - 1)], word[np.minimum(at[lead[live]] + common[live], len(data) - 1)]
            differ = a ^ b
            whole = differ == 0
            stop = live[~whole]
            if len(stop):
                # Leading zero bytes of what differs.
                top = differ[~whole]
                equal = np.zeros(len(top), np.int64)
                for k in range(1, 8):
                    equal += (top >> _U(64 - 8 * k)) == 0
                common[stop] += equal
            live = live[whole]
            common[live] += 8
            live = live[common[live] < length]
        common = np.minimum(common, length)
        full = common >= length
        same[order[full]] = lead[full]
        order, part, lead, common = order[~full], part[~full], lead[~full], common[~full]
        if not len(order):
            break
        branch = (part * (length + 1) + common) * 256 + data[at[order] + common]
        turn = np.argsort(branch, kind="stable")
        order, branch, depth = order[turn], branch[turn], common[turn] + 1
        part = np.cumsum(np.concatenate([[0], np.diff(branch) != 0]))
    return same


def _repeated(rows: pa.Table):
    """Spans of repeated bytes in complete groups of runs; fingerprints of strings whose gram lies in several parts."""
    gram, salt, key, start = (rows.column(c).to_numpy() for c in ("gram", "salt", "key", "start"))
    ways = rows.column("ways").to_numpy()
    pairs = np.unique(np.stack([gram, salt, key, start], 1), axis=0, return_index=True)[1]  # a copy of a text may come along
    rows = rows.take(pa.array(pairs))
    gram, salt, key, start, ways = gram[pairs], salt[pairs], key[pairs], start[pairs], ways[pairs]
    column = rows.column("bytes").combine_chunks().cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)
    low, size = offsets[:-1], np.diff(offsets)
    group = np.unique(np.stack([gram, salt], 1), axis=0, return_inverse=True)[1].ravel()
    _, lead, kind, many = np.unique(np.stack([group, size, W.pieces_hash(data, low, offsets[1:]).view(np.int64)], 1), axis=0, return_index=True, return_inverse=True, return_counts=True)
    kind = kind.ravel()
    # One run for each kind; a group of one kind holds more to find only where that is a single run, which may repeat itself.
    kinds = np.bincount(group[lead], minlength=int(group.max()) + 1 if len(group) else 0)
    count = size[lead] - LENGTH + 1
    look = (kinds[group[lead]] > 1) | (many == 1) | (ways[lead] > 1)
    chosen = np.flatnonzero(look)
    at = _spread(low[lead[chosen]], count[chosen])
    owner = np.repeat(chosen, count[chosen])
    same = equal_strings(data, at, group[lead[owner]])
    twice = np.bincount(same, minlength=len(at))[same] > 1 if len(at) else np.empty(0, bool)
    twice |= many[owner] > 1
    spans = {"key": [], "low": [], "high": []}

    def add(k, a, b):
        spans["key"].append(k), spans["low"].append(a), spans["high"].append(b)

    whole = many[kind] > 1
    add(key[whole], start[whole], start[whole] + size[whole])
    # Found strings of a kind as maximal stretches, then for each of its runs.
    place = at - low[lead[owner]]
    found = np.flatnonzero(twice & (many[owner] == 1))
    if len(found):
        head = np.ones(len(found), bool)
        head[1:] = (owner[found][1:] != owner[found][:-1]) | (place[found][1:] - place[found][:-1] > LENGTH)
        h = np.flatnonzero(head)
        tail = np.append(h[1:], len(found)) - 1
        run = lead[owner[found[h]]]
        add(key[run], start[run] + place[found[h]], start[run] + place[found[tail]] + LENGTH)
    yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(spans[c])) for c in ("key", "low", "high")), *(pa.nulls(sum(map(len, spans["key"])), pa.int64()) for _ in range(2))], _SPANS)
    salted = np.flatnonzero(ways[lead[owner]] > 1)
    if len(salted):
        salted = salted[(same[salted] == salted) | ~twice[salted]]  # one string of each kind in this part
        salted = salted[np.argsort(at[salted], kind="stable")]
        one = W.pieces_hash(data, at[salted], at[salted] + LENGTH)
        two = W.pieces_hash(data, at[salted] + 1, at[salted] + LENGTH) ^ W.mix(data[at[salted]].astype(_U))
        run = lead[owner[salted]]
        begin = start[run] + place[salted]
        alone = ~twice[salted]
        yield pa.RecordBatch.from_arrays([pa.array(key[run], mask=~alone), pa.array(begin), pa.array(begin + LENGTH), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], _SPANS)


_SPANS = ["key", "low", "high", "one", "two"]
_SPANS_SQL = "key long, low long, high long, one long, two long"


def _sorted_groups(batches):
    """Hands complete groups (one gram and salt) of a sorted partition on, many at a time."""
    kept: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for i in range(0, batch.num_rows, 2048):
            part = batch.slice(i, 2048)
            if size > _BUFFER:
                # Rows of the last group met so far wait for the rest of it; only the new rows are looked at.
                last = kept[-1]
                seam = pa.Table.from_batches([last.slice(last.num_rows - 1), part])
                g, s = seam.column("gram").to_numpy(), seam.column("salt").to_numpy()
                ends = np.flatnonzero((g[1:] != g[:-1]) | (s[1:] != s[:-1]))
                if len(ends):
                    yield from _repeated(pa.Table.from_batches([*kept, part.slice(0, int(ends[-1]))]))
                    kept = [part.slice(int(ends[-1]))]
                    size = kept[0].column("bytes").nbytes
                    continue
            kept.append(part)
            size += part.column("bytes").nbytes
    if kept:
        yield from _repeated(pa.Table.from_batches(kept))


def _removed(batches):
    for batch in batches:
        out = []
        for key, text, spans in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "spans"))):
            data, kept, at, gone, n, end = text.encode(), [], 0, 0, 0, -1
            for low, high in sorted((s["low"], s["high"]) for s in spans):
                if low > end:
                    n += 1
                    kept.append(data[at:low])
                    end = low
                gone += max(0, high - end)
                end = at = max(end, high)
            kept.append(data[at:])
            out.append((key, gone, n, hashlib.sha256(b"".join(kept)).hexdigest()))
        k, g, n, h = zip(*out) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(g, pa.int64()), pa.array(n, pa.int64()), pa.array(h, pa.string())], ["key", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, text) of texts that share a gram, and (key, low, high): spans of theirs that occur elsewhere, copies of the whole text aside."""
    keyed = docs.select(F.xxhash64("text", F.length("text")).alias("key"), "text").where(F.octet_length("text") >= LENGTH)
    once = keyed.dropDuplicates(["key"])  # copies are dropped before the shuffle too, and the join needs no other
    each = Window.partitionBy("gram")
    grams = keyed.mapInArrow(_grams, "gram long, key long, n long")
    shared = grams.select("gram", "key", "n", F.min("key").over(each).alias("a"), F.max("key").over(each).alias("b"), F.max("n").over(each).alias("m"), F.count("*").over(each).alias("all"))
    shared = shared.where("a < b OR m > 1").select("key", F.struct("gram", F.ceil(F.col("all") / SALT).alias("ways")).alias("g"))
    lists = shared.groupBy("key").agg(F.collect_set("g").alias("grams"))
    asked = stored(once.join(lists.hint("merge"), "key"), "suffix-texts")
    contexts = asked.mapInArrow(_contexts, _CONTEXTS)
    dealt = contexts.repartition("gram", "salt").sortWithinPartitions("gram", "salt")
    found = stored(dealt.mapInArrow(_sorted_groups, _SPANS_SQL), "suffix-spans")
    alike = Window.partitionBy("one", "two")
    across = found.where("one IS NOT NULL").withColumn("n", F.count("*").over(alike)).where("n > 1 AND key IS NOT NULL").select("key", "low", "high")
    return asked.select("key", "text"), found.where("one IS NULL").select("key", "low", "high").union(across)


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per row of docs."""
    docs = texts(docs)
    asked, spans = repeated_spans(docs)
    lists = spans.groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    cut = asked.join(lists, "key").mapInArrow(_removed, "key long, n_removed long, n_spans long, kept_sha256 string")
    rows = stored(docs.select("doc_id", F.xxhash64("text", F.length("text")).alias("key"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole")), "suffix-rows")
    copies = rows.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1")
    every = rows.join(copies, "key", "left").join(cut, "key", "left")
    copied = F.col("copies").isNotNull() & (F.col("n_bytes") >= LENGTH)
    zero = F.lit(0).cast("long")
    return every.select(
        "doc_id", "n_bytes", F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(copied, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"))


def op10_suffix_dedup(spark, sf_dir):
    """What remains of every document without repeated passages."""
    return without_repeats(table(spark, sf_dir, "documents"))
