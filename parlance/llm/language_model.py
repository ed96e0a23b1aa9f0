"""Log10 probabilities of texts under a hashed maximum-entropy model with a class-factored softmax.

Tokens are words (A-Z folded) and one end of text. Words fall into 32 classes by the magnitude of their training count,
and log P(token) = log P(class | the two tokens before) + log P(token | class). The second factor is the unigram
share within the class. The first is a softmax over classes; its features are the token before, the one before that (a
skip) and the pair, hashed into tables of fixed size. Every partition runs gradient steps over its own training
documents from the common weights; the results are averaged feature by feature, weighted by how often each was
seen, for EPOCHS rounds. Batches of tokens are scored as gathers from the tables.

Exact counts of all words are needed where a text is scored, and the vocabulary has no bound. So texts are dealt into
blocks of about 8 MB; each block asks for the counts of its own distinct words (a shuffle by word, then back
by block), and stores every text as two bytes a token, which training and scoring read.

Words are 64-bit hashes. Defined cases: a null text is an empty one, which still has its end token; rows that
repeat count and are scored each; a null doc_id is never held out; without training rows every word is unseen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.llm import words as W
from parlance.llm.columns import stored, table, texts

CLASSES = 32
BUCKETS = 1 << 11
PAIRS = 1 << 13
FEATURES = 2 * BUCKETS + PAIRS
EPOCHS = 2
RATE = 1.0
BLOCK_BYTES = 8 << 20
_SLICE = 1 << 21
_STEP = 1 << 14
_CHUNKS = 32
_END = np.uint64(0x0E0D0E0D0E0D0E0D)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, the end of each text included, and the bounds of the texts."""
    data, offsets = W.buffers(column)
    hashes, _, _, bounds = W.words(data, offsets)
    return np.insert(hashes, bounds[1:], _END), bounds + np.arange(len(bounds))


def classes_of(count: np.ndarray, volume: float) -> np.ndarray:
    """0 for the most frequent words; each further class is half as frequent."""
    return np.clip(np.floor(np.log2(max(volume, 1.0) / (count + 0.1))) - 3, 0, CLASSES - 1).astype(np.int64)


def _vocabulary(batches):
    """(block, h, c): distinct words of the blocks in a partition and how often they occur in training rows.

    A block lies in one partition, sorted by block, so each of its words comes once and one block is held at a time.
    """
    block, words, counts = None, np.empty(0, np.uint64), np.empty(0, np.int64)

    def one():
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(words), block, np.int64)), pa.array(words.view(np.int64)), pa.array(counts)], ["block", "h", "c"])

    for batch in batches:
        for part in W.slices(batch, most=_SLICE):
            tokens, bounds = _tokens(part.column("text"))
            row = np.repeat(np.arange(part.num_rows), np.diff(bounds))
            at = part.column("block").to_numpy()[row]
            train = ~part.column("held").to_numpy(zero_copy_only=False)[row]
            for b in np.unique(at).tolist():
                if b != block:
                    if block is not None:
                        yield one()
                    block, words, counts = b, np.empty(0, np.uint64), np.empty(0, np.int64)
                here = at == b
                weight = np.concatenate([counts, train[here]])
                words, place = np.unique(np.concatenate([words, tokens[here]]), return_inverse=True)
                counts = np.bincount(place, weight, len(words)).astype(np.int64)
    if block is not None:
        yield one()


_ENCODED = pa.schema([("doc_id", pa.int64()), ("held", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                      ("log_counts", pa.float64()), ("stream", pa.binary()), ("mass", pa.list_(pa.float64())), ("types", pa.list_(pa.int64()))])


def _encoder(volume: float):
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        h = words.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        h, c = h[order], words.column("c").to_numpy()[order]
        kind = classes_of(c, volume)
        logs = np.log10(c + 0.1)
        first = words.column("first").to_numpy(zero_copy_only=False)[order] & (c > 0)
        out = {n: [] for n in _ENCODED.names}
        for batch in docs.combine_chunks().to_batches():
            for part in W.slices(batch, most=_SLICE):
                tokens, bounds = _tokens(part.column("text"))
                at = np.searchsorted(h, tokens)
                stream = (kind[at] * BUCKETS + (tokens & np.uint64(BUCKETS - 1)).astype(np.int64)).astype(np.uint16)
                known = np.concatenate([[0], np.cumsum(c[at] > 0)])
                low, high = bounds[:-1], bounds[1:]
                out["doc_id"] += part.column("doc_id").to_pylist()
                out["held"] += part.column("held").to_pylist()
                out["n_tokens"] += (high - low).tolist()
                out["n_known"] += (known[high] - known[low]).tolist()
                out["log_counts"] += np.add.reduceat(logs[at], low).tolist()
                out["stream"] += [stream[a:b].tobytes() for a, b in zip(low, high)]
        n = len(out["doc_id"])
        out["mass"], out["types"] = [None] * n, [None] * n
        # One row more for the words that this block stands for: what each class holds.
        extra = {"held": None, "n_tokens": None, "n_known": None, "log_counts": None, "stream": None, "doc_id": None,
                 "mass": np.bincount(kind[first], c[first], CLASSES).tolist(), "types": np.bincount(kind[first], minlength=CLASSES).tolist()}
        return pa.table({k: pa.array(v + [extra[k]], _ENCODED.field(k).type) for k, v in out.items()}, schema=_ENCODED)
    return run


_ENCODED_SQL = "doc_id long, held boolean, n_tokens long, n_known long, log_counts double, stream binary, mass array<double>, types array<long>"


def encode(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """Every text as class and hash of its tokens, with sums over its counts; rows with `mass` hold parts of the class sizes. And the class of unseen words."""
    docs = texts(docs)
    volume = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    blocks = max(1, -(-volume // block_bytes))
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"), "doc_id", "text", held_out().alias("held")).repartition(blocks, "block")
    asked = dealt.sortWithinPartitions("block").mapInArrow(_vocabulary, "block long, h long, c long")
    word = Window.partitionBy("h")
    counted = asked.select("block", "h", F.sum("c").over(word).alias("c"), (F.row_number().over(word.orderBy("block")) == 1).alias("first"))
    return stored(dealt.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(_encoder(volume / 5), _ENCODED_SQL), "lm-encoded"), int(classes_of(np.zeros(1), volume / 5)[0])


def _features(stream: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class, three feature numbers) of every token of several texts laid end to end."""
    word = (stream % BUCKETS).astype(np.int64)
    one, two = np.zeros_like(word), np.zeros_like(word)
    one[1:], two[2:] = word[:-1], word[:-2]
    start = bounds[:-1]
    one[start] = 0
    two[start] = 0
    two[start[np.diff(bounds) > 1] + 1] = 0
    pair = (one * 0x9E3B + two * 0x1F35 + ((one ^ (two << 3)) >> 2)) % PAIRS
    return (stream // BUCKETS).astype(np.int64), np.stack([one, BUCKETS + two, 2 * BUCKETS + pair])


def _odds(weights: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Probabilities of the classes."""
    z = weights[at[0]] + weights[at[1]] + weights[at[2]] + bias
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


def _streams(batch: pa.RecordBatch):
    data = [np.frombuffer(x, np.uint16) for x in batch.column("stream").to_pylist()]
    size = np.array([len(x) for x in data], np.int64)
    i = 0
    total = np.cumsum(size)
    while i < len(data):  # a few MB of tokens at a time
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + (1 << 19), "right")))
        yield i, j, np.concatenate(data[i:j]), np.concatenate([[0], np.cumsum(size[i:j])])
        i = j


def _learner(weights: np.ndarray, bias: np.ndarray):
    def run(batches):
        own, seen = weights.copy(), np.zeros(FEATURES, np.float32)
        for batch in batches:
            for _, _, stream, bounds in _streams(batch):
                kind, at = _features(stream, bounds)
                for low in range(0, len(kind), _STEP):
                    part = at[:, low:low + _STEP]
                    slope = _odds(own, bias, part)
                    slope[np.arange(part.shape[1]), kind[low:low + _STEP]] -= 1
                    for f in part.astype(np.uint16):
                        order = np.argsort(f, kind="stable")
                        f = f[order]
                        first = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
                        ids = f[first]
                        seen[ids] += np.diff(np.append(first, len(f)))
                        own[ids] -= RATE * np.add.reduceat(slope[order], first) / (seen[ids] + 10)[:, None]
        step = FEATURES // _CHUNKS
        moved = own * seen[:, None]
        yield pa.RecordBatch.from_arrays([
            pa.array(range(_CHUNKS), pa.int64()),
            pa.array([moved[k * step:(k + 1) * step].tobytes() for k in range(_CHUNKS)], pa.binary()),
            pa.array([seen[k * step:(k + 1) * step].tobytes() for k in range(_CHUNKS)], pa.binary())], ["chunk", "moved", "seen"])
    return run


def _summed(rows: pa.Table) -> pa.Table:
    moved = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in rows.column("moved").to_pylist())
    seen = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in rows.column("seen").to_pylist())
    return pa.table({"chunk": rows.column("chunk").slice(0, 1), "moved": pa.array([moved.astype(np.float32).tobytes()], pa.binary()),
                     "seen": pa.array([seen.astype(np.float32).tobytes()], pa.binary())})


def train(encoded: DataFrame, bias: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after `epochs` rounds of local steps and averages; sums go through groups of 64 partitions."""
    weights = np.zeros((FEATURES, CLASSES), np.float32)
    rows = encoded.where("NOT held").select("stream")
    step = FEATURES // _CHUNKS
    for _ in range(epochs):
        parts = rows.mapInArrow(_learner(weights, bias), "chunk long, moved binary, seen binary")
        parts = parts.withColumn("some", (F.spark_partition_id() / 64).cast("int")).groupBy("chunk", "some").applyInArrow(_summed, "chunk long, moved binary, seen binary")
        for r in parts.groupBy("chunk").applyInArrow(_summed, "chunk long, moved binary, seen binary").collect():  # FEATURES x CLASSES numbers
            n = np.frombuffer(r["seen"], np.float32)
            w = np.frombuffer(r["moved"], np.float32).reshape(step, CLASSES)
            weights[r["chunk"] * step:(r["chunk"] + 1) * step] = np.where(n[:, None] > 0, w / np.maximum(n, 1)[:, None], 0)
    return weights


def _scorer(weights: np.ndarray, bias: np.ndarray, log_size: np.ndarray):
    def run(batches):
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for i, j, stream, bounds in _streams(batch):
                kind, at = _features(stream, bounds)
                each = -log_size[kind]
                for low in range(0, len(kind), _STEP):
                    k = kind[low:low + _STEP]
                    p = _odds(weights, bias, at[:, low:low + _STEP])[np.arange(len(k)), k]
                    each[low:low + _STEP] += np.log10(np.maximum(p, 1e-30))
                score[i:j] = np.add.reduceat(each, bounds[:-1])
            keep = [batch.column(c) for c in ("doc_id", "held", "n_tokens", "n_known", "log_counts")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(score)], ["doc_id", "held", "n_tokens", "n_known", "log_counts", "score"])
    return run


def scores(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of docs."""
    rows, unseen = encode(docs, block_bytes)
    encoded, parts = rows.where("stream IS NOT NULL").drop("mass", "types"), rows.where("mass IS NOT NULL")
    sizes = parts.select(*[F.sum(F.col("mass")[k]).alias(f"m{k}") for k in range(CLASSES)], *[F.sum(F.col("types")[k]).alias(f"t{k}") for k in range(CLASSES)]).first()
    mass = np.array([sizes[f"m{k}"] or 0.0 for k in range(CLASSES)])
    types = np.array([sizes[f"t{k}"] or 0 for k in range(CLASSES)])
    total, distinct = mass.sum(), types.sum()
    size = mass + 0.1 * types
    size[unseen] += 0.1  # one type for all unseen words
    bias = np.log(np.maximum(size, 1e-9) / size.sum()).astype(np.float32)
    weights = train(encoded, bias)
    base = float(np.log10(total + 0.1 * (distinct + 1)))
    scored = encoded.mapInArrow(_scorer(weights, bias, np.log10(np.maximum(size, 1e-9))),
                                "doc_id long, held boolean, n_tokens long, n_known long, log_counts double, score double")
    return scored.select("doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"),
                         (F.col("log_counts") - F.col("n_tokens") * base).alias("base_score"), (F.col("score") + F.col("log_counts")).alias("score"))


def op8_language_model(spark, sf_dir):
    """Base and model scores of every document."""
    return scores(table(spark, sf_dir, "documents"))
