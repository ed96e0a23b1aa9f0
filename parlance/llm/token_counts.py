"""Token counts of whole texts, huge documents in overlapping chunks that run as rows of their own.

A boundary of the text is stable when a character other than the space mark is followed by one: no piece of the
vocabulary holds the mark after another character (checked when the model is loaded), so no merge crosses such a place
and the tokens on either side don't depend on each other. A document of more than CHUNK characters is cut into
chunks that overlap their neighbours; the overlap is widened until it holds a stable boundary. Each chunk is
encoded with the offsets of its tokens, and counts those between its first stable boundary at or after its own start
and that of the next chunk. Alignment is checked: the tokens must cover the bytes of the chunk, and both boundaries must be
ends of tokens. Documents with a chunk that fails (a model that changes lengths, say) are encoded again, the overlaps of what
fails doubled until both ends are proven; where that takes the whole text, its own tokens are the answer. A model whose
pieces hold the mark elsewhere has no stable boundaries, and its documents are one chunk each.

The model file is read where tasks run; its path is a parameter. Defined cases: a null text is an empty one without
tokens; every row is counted, repeated ones too; a document without any stable boundary is one chunk.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import words as W
from parlance.llm.columns import stored, table, texts

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
CHUNK = 1 << 16
OVERLAP = 256
MARK = "▁"
#: The mark and the space are one symbol to the tokenizer; a place between another character and one of them is stable.
STABLE = re.compile(f"(?<=[^ {MARK}])(?=[ {MARK}])")


class Counter:
    def __init__(self, path: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.splices = not any(MARK in n.lstrip(MARK) for n in names)
        self.bytes_of = np.array([1 if self.pieces.is_byte(i) else len(n.replace(MARK, " ").encode()) for i, n in enumerate(names)])

    def count(self, texts_: list[str]) -> list[int]:
        return [len(x) for x in self.pieces.encode(texts_, num_threads=1)]

    def ends(self, text: str) -> tuple[np.ndarray, int]:
        """Byte offsets in the text, its marks as spaces, at which tokens end; the number of tokens."""
        ids = np.array(self.pieces.encode(text.replace(MARK, " "), num_threads=1), np.int64)
        return np.cumsum(self.bytes_of[ids]) - 1, len(ids)  # the encoder puts one mark before the text

    def between(self, text: str, low: int, high: int) -> int | None:
        """Tokens of text[low:high] in the encoding of the whole; None if either is no end of a token or the tokens don't cover the text."""
        ends, n = self.ends(text)
        plain = text.replace(MARK, " ")
        if n and ends[-1] != len(plain.encode()):
            return None
        first, last = len(plain[:low].encode()), len(plain[:high].encode())
        i = 0 if low == 0 else int(np.searchsorted(ends, first)) + 1
        j = n if high == len(text) else int(np.searchsorted(ends, last)) + 1
        if (low and (i > n or ends[i - 1] != first)) or (high < len(text) and (j > n or ends[j - 1] != last)):
            return None
        return j - i


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def next_stable(text: str, at: int) -> int:
    """The first stable boundary at or after a place, else the end; looks in windows that double."""
    width = OVERLAP
    while at < len(text):
        found = STABLE.search(text, max(1, at), min(len(text), at + width) + 1)
        if found:
            return found.start()
        if at + width >= len(text):
            break
        width *= 2
    return len(text)


def stretches(text: str, size: int) -> list[tuple[int, int]]:
    """What each chunk owns, between stable boundaries at least `size` apart."""
    cuts = [0]
    while cuts[-1] < len(text):
        cuts.append(next_stable(text, cuts[-1] + size))
    return list(zip(cuts, cuts[1:]))


def overlapped(text: str, a: int, b: int, width: int) -> tuple[int, int]:
    """A stretch with `width` characters more before it and, up to a stable boundary, after it."""
    return max(0, a - width), next_stable(text, b + width) if b < len(text) else b


def chunks(text: str, size: int = CHUNK):
    """(text with overlap, place of the first own character, place after the last own one) of every chunk."""
    for a, b in stretches(text, size):
        low, high = overlapped(text, a, b, OVERLAP)
        yield text[low:high], a - low, b - low


def widened(own: Counter, text: str, size: int = CHUNK) -> int:
    """Tokens of a text some chunk of which failed; each overlap doubles until both its ends are proven or it is the whole text."""
    total = 0
    for a, b in stretches(text, size):
        width, n = OVERLAP, None
        while n is None:
            low, high = overlapped(text, a, b, width)
            if (low, high) == (0, len(text)) and (a, b) != (low, high):
                return own.count([text])[0]
            n = own.between(text[low:high], a - low, b - low) if (a, b) != (0, len(text)) else own.count([text])[0]
            width *= 2
        total += n
    return total


def token_counts(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_tokens), one row per row of docs."""
    docs = texts(docs)
    long = F.char_length("text") > chunk

    def whole(batches):
        own = counter(path)
        for batch in batches:
            for part in W.slices(batch):
                size = np.diff(W.buffers(part.column("text"))[1])
                n = own.count([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    def cut(batches):
        own = counter(path)
        for batch in batches:
            for row, doc, sha, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "hash", "text"))):
                parts = chunks(text, chunk) if own.splices else [(text, 0, len(text))]
                for piece, low, high in parts:
                    yield pa.RecordBatch.from_pylist([{"row": row, "doc_id": doc, "hash": sha, "piece": piece, "low": low, "high": high}], schema=_CUT)

    def spliced(batches):
        own = counter(path)
        for batch in batches:
            for x in batch.to_pylist():
                n = own.between(x["piece"], x["low"], x["high"]) if (x["low"], x["high"]) != (0, len(x["piece"])) else own.count([x["piece"]])[0]
                size = len(x["piece"][x["low"]:x["high"]].encode())
                yield pa.RecordBatch.from_pylist([{"row": x["row"], "doc_id": x["doc_id"], "hash": x["hash"], "n_bytes": size, "n_tokens": n}], schema=_DONE)

    def again(batches):
        own = counter(path)
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                n = widened(own, text, chunk)
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([len(text.encode())]), pa.array([n], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = "doc_id long, n_bytes long, n_tokens long"
    short = docs.where(~long).mapInArrow(whole, counted)
    huge = docs.where(long).withColumn("hash", F.sha2("text", 256))
    pieces = huge.withColumn("row", F.monotonically_increasing_id()).mapInArrow(cut, "row long, doc_id long, hash string, piece string, low long, high long")
    pieces = pieces.repartition("row", "low", F.crc32("piece"))
    done = pieces.mapInArrow(spliced, "row long, doc_id long, hash string, n_bytes long, n_tokens long").groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("hash").alias("hash"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"), F.bool_and(F.col("n_tokens").isNotNull()).alias("aligned"))
    done = stored(done, "tokens-huge")  # one row per huge document
    result = short.unionByName(done.where("aligned").select("doc_id", "n_bytes", "n_tokens"))
    failed = done.where("NOT aligned").select(F.col("doc_id").alias("id"), "hash").distinct()
    if failed.isEmpty():
        return result
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (huge["hash"] == failed["hash"])
    return result.unionByName(huge.join(failed, same, "left_semi").select("doc_id", "text").mapInArrow(again, counted))


_CUT = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("hash", pa.string()), ("piece", pa.string()), ("low", pa.int64()), ("high", pa.int64())])
_DONE = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("hash", pa.string()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def op5_token_counts(spark, sf_dir):
    """Bytes, tokens and whether the limit of a context is passed, for every document."""
    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
