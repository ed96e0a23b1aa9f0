"""Toxic passages by maximum-scoring segments over token log-odds.

Tokens are runs of letters, digits and non-ASCII bytes, A-Z folded. Their log-odds between toxic and clean training
documents take the corpus as an informative Dirichlet prior and are lowered by their own uncertainty; a token stands
for itself and, where that says more, for its first four bytes. All other tokens score a small negative
constant. The linear scan of Ruzzo and Tompa then finds every maximal segment of a text, and a segment's
score becomes a Karlin-Altschul extreme-value score. What a document's segments add up to is calibrated to a
probability by monotone regression on the labelled rows.

Weights live in hash tables of 2 x 2**18 slots, so what is broadcast has the same size for any corpus; the
calibration is a table of 400 bins. Every labelled row counts, copies of one text once.

Defined cases: a null text is an empty one and gets the score of a text without toxic tokens; a document with
several label rows is toxic if one says so; without labels every score is 0. Rows that repeat are scored each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import words as W
from parlance.llm.columns import stored, table, texts

SLOTS = 1 << 18
HEAD = 4
PRIOR = 500.0
CAUTION = 2.0
DRIFT = -0.5
LOW, STEP, BINS = -30.0, 0.25, 400
THRESHOLD = 0.3


@dataclass
class Model:
    weight: np.ndarray   # (2, SLOTS): whole tokens, heads
    decay: float         # Karlin-Altschul lambda
    scale: float         # Karlin-Altschul K
    curve: np.ndarray    # probability by bin


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _slots(column: pa.Array):
    data, offsets = W.buffers(column)
    hashes, starts, ends, bounds = W.words(data, offsets, W.NOT_LETTERS)
    heads = W.pieces_hash(data, starts, np.minimum(ends, starts + HEAD), True)
    mask = np.uint64(SLOTS - 1)
    return (hashes & mask).astype(np.int64), (heads & mask).astype(np.int64), starts, ends, bounds


def _counts(batches):
    """Documents in which a slot occurs, by class; slots of heads come after those of tokens."""
    seen = np.zeros((2, 2 * SLOTS), np.int64)
    for batch in batches:
        for part in W.slices(batch):
            tokens, heads, _, _, bounds = _slots(part.column("text"))
            row = np.repeat(np.arange(part.num_rows), np.diff(bounds))
            toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
            for base, slot in ((0, tokens), (SLOTS, heads)):
                pair = np.unique(row * SLOTS + slot)
                is_toxic = toxic[pair // SLOTS]
                for c in (0, 1):
                    seen[c, base:base + SLOTS] += np.bincount(pair[is_toxic == c] % SLOTS, minlength=SLOTS)
    at = np.flatnonzero(seen.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[1, at]), pa.array(seen[0, at])], ["slot", "toxic", "clean"])


def segments(score: np.ndarray, bounds: np.ndarray) -> list[list[tuple[float, int, int]]]:
    """All maximal-scoring segments of each row: (score, first, last token).

    Only tokens with a positive score are walked; what lies between is a difference of sums.
    """
    sums = np.empty(len(score), np.float64)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):  # each row from zero, so that its neighbours don't matter
        np.cumsum(score[a:b], dtype=np.float64, out=sums[a:b])
    at = np.flatnonzero(score > 0)
    rows = np.searchsorted(bounds, at, "right") - 1
    before = np.where(at > bounds[rows], sums[at - 1], 0.0)
    out: list[list[tuple[float, int, int]]] = [[] for _ in range(len(bounds) - 1)]
    row, open_ = -1, []
    for i, r, left, right in zip(at.tolist(), rows.tolist(), before.tolist(), sums[at].tolist()):
        if r != row:
            row, open_ = r, out[r]
        item = [left, right, i, i]
        while True:
            j = len(open_) - 1
            while j >= 0 and open_[j][0] >= item[0]:
                j = open_[j][4]
            if j < 0 or open_[j][1] >= item[1]:
                open_.append((*item, j))
                break
            item = [open_[j][0], item[1], open_[j][2], item[3]]
            del open_[j:]
    return [[(b - a, first, last) for a, b, first, last, _ in found] for found in out]


def _scanned(weight: np.ndarray):
    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            for part in W.slices(batch):
                tokens, heads, starts, ends, bounds = _slots(part.column("text"))
                score = np.maximum(weight[0][tokens], weight[1][heads])
                stutter = np.zeros(len(tokens), bool)
                stutter[1:] = tokens[1:] == tokens[:-1]
                stutter[bounds[:-1][bounds[:-1] < len(tokens)]] = False  # the token before is another text's
                score[stutter] = DRIFT  # a stutter says nothing new
                found = segments(score, bounds)
                base = W.buffers(part.column("text"))[1].tolist()
                spans = [[{"start": int(starts[a]) - base[r], "end": int(ends[b]) - base[r], "score": float(s)} for s, a, b in segs]
                         for r, segs in enumerate(found)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(np.diff(bounds)), pa.array(spans, kind)],
                                                 ["doc_id", "text_hash", "n_tokens", "segments"])
    return run


_SCANNED = "doc_id long, text_hash long, n_tokens long, segments array<struct<start:long,end:long,score:double>>"


def _lambda(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(lambda * score)) = 1."""
    if not (scores > 0).any() or (scores * share).sum() >= 0:
        return 1.0
    low, high = 1e-6, 20.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if (share * np.exp(np.minimum(mid * scores, 700))).sum() < 1 else (low, mid)
    return max(low, 0.05)


def _curve(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Monotone regression over the bins (pool adjacent violators), shrunk a little to the base rate."""
    base = (toxic.sum() + 1e-9) / max(1.0, (toxic + clean).sum())
    blocks: list[list[float]] = []
    for t, n in zip(toxic, toxic + clean):
        blocks.append([t, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * max(blocks[-1][1], 1e-12) >= blocks[-1][0] * max(blocks[-2][1], 1e-12):
            t2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), (t + base) / (n + 1)) for t, n, k in blocks])


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of docs that may be learned from, with their label. Labels have no bound, so they are never broadcast."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    return docs.where(~held_out()).join(marks.hint("merge"), "doc_id")


def training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the labelled rows, copies of one text once; texts are shuffled once, by their id."""
    marks = labelled(docs.select("doc_id", F.xxhash64("text").alias("h"), F.char_length("text").alias("n")), labels)
    once = marks.groupBy("h", "n").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    return docs.where(~held_out()).join(once.hint("merge"), "doc_id").where("h = xxhash64(text)").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and (doc_id, n_tokens, segments) of every document under it."""
    docs = texts(docs)
    seen = training(docs, labels).mapInArrow(_counts, "slot long, toxic long, clean long").groupBy("slot").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    seen = stored(seen, "toxic-slots")
    totals = {r["head"]: r for r in seen.groupBy((F.col("slot") >= SLOTS).alias("head")).agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).collect()}
    rows = seen.where("toxic > 0").toPandas()  # at most 2 x SLOTS rows
    weight = np.full(2 * SLOTS, DRIFT, np.float32)
    for head, total in totals.items():
        part = rows[(rows["slot"] >= SLOTS) == head]
        t, c = part["toxic"].to_numpy(float), part["clean"].to_numpy(float)
        all_t, all_c = float(total["t"]), float(total["c"])
        prior = PRIOR * (t + c + 1) / (all_t + all_c + 1)
        odds = np.log((t + prior) / (all_t + PRIOR - t - prior)) - np.log((c + prior) / (all_c + PRIOR - c - prior))
        weight[part["slot"].to_numpy(int)] = np.maximum(DRIFT, odds - CAUTION * np.sqrt(1 / (t + prior) + 1 / (c + prior)) + DRIFT)
    weight = weight.reshape(2, SLOTS)
    token = rows[rows["slot"] < SLOTS]
    clean_total = float(totals[False]["c"]) if False in totals else 0.0
    share = token["clean"].to_numpy(float) / max(clean_total, 1.0)
    score = weight[0][token["slot"].to_numpy(int)].astype(float)
    decay = _lambda(np.append(score, DRIFT), np.append(share, max(0.0, 1 - share.sum())))
    found = stored(docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_scanned(weight), _SCANNED), "toxic-segments")
    marked = labelled(found, labels)
    # The Gumbel location of the clean rows gives K; then the calibration bins.
    best = F.array_max(F.transform("segments", lambda x: x["score"]))
    place = marked.where("toxic = 0 AND size(segments) > 0").agg(F.avg(decay * best - F.log("n_tokens")).alias("m")).first()["m"]
    model = Model(weight, decay, float(np.exp((place or 0.0) - 0.5772)), np.zeros(BINS))
    bins = marked.groupBy(_bin(model).alias("bin")).agg(F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("t"), F.count("*").alias("n")).toPandas()
    toxic, every = np.zeros(BINS), np.zeros(BINS)
    toxic[bins["bin"]], every[bins["bin"]] = bins["t"], bins["n"]
    model.curve = _curve(toxic, every - toxic) if every.sum() else np.zeros(BINS)
    return model, found


def _evidence(model: Model):
    """-log of the expected number of chance segments as good as each."""
    chance = F.log(F.greatest(F.col("n_tokens"), F.lit(1))) + float(np.log(model.scale))
    return F.transform("segments", lambda x: x["score"] * model.decay - chance)


def _bin(model: Model):
    """The calibration bin of a document: its best segment, and what the other significant ones add."""
    each = _evidence(model)
    best = F.array_max(each)
    total = best + F.aggregate(each, F.lit(0.0), lambda a, x: a + F.greatest(x, F.lit(0.0))) - F.greatest(best, F.lit(0.0))
    value = F.coalesce(F.greatest(total, F.lit(LOW + STEP)), F.lit(LOW))
    return F.least(F.lit(BINS - 1), F.floor((value - LOW) / STEP)).cast("int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages, passages, text_hash), one row per document row.

    text_hash tells rows with one doc_id apart. passages: the segments beyond chance (fewer than one expected as good), in bytes of the UTF-8 text.
    """
    model, found = fit(docs, labels)
    score = F.element_at(F.array(*[F.lit(float(p)) for p in model.curve]), _bin(model) + 1)
    chance = F.log(F.greatest(F.col("n_tokens"), F.lit(1))) + float(np.log(model.scale))
    passages = F.filter("segments", lambda x: x["score"] * model.decay > chance)
    return found.select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"),
                        F.size(passages).cast("long").alias("n_passages"), passages.alias("passages"), "text_hash")


def op9_toxicity(spark, sf_dir):
    """Scores of every document, fitted on labels whose rows aren't held out."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("passages", "text_hash")
