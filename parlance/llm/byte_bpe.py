"""Byte-level BPE: encoding in two tiers, and decoding.

Each match of the split pattern is encoded by itself. First tier: a minimal perfect hash over the vocabulary resolves
a pre-token that is a token already, for all distinct pre-tokens of a batch at once; a hit is confirmed on its
bytes. Second tier: a heap of mergeable neighbours over linked bytes applies the merges in rank order, leftmost first,
in n log n steps for a pre-token of n bytes. Pre-tokens that repeat within a batch are encoded once.

The vocabulary file is read where tasks run; its path is a parameter. Defined cases: a null text is an empty one, which
has no tokens and decodes to no bytes; every row is encoded, repeated ones too.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from parlance.llm import words as W
from parlance.llm.columns import table, texts
from parlance.llm.perfect_hash import PerfectHash

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens a task remembers between batches.
_KEPT = 1_000_000


class Tokenizer:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern).findall
        self.token = {i: t for t, i in ranks.items()}
        self.names = {i: str(i) for i in self.token}
        self.single = {b: ranks.get(bytes([b])) for b in range(256)}
        self.known = list(ranks)
        self.ids = np.fromiter(ranks.values(), np.int64, len(ranks))
        self.table = PerfectHash(_hashes(self.known))
        # Every way a token falls into two tokens: (left id, right id) -> merged id, which is its rank.
        self.merge = {}
        for t, i in ranks.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    self.merge[a, b] = i
        self.kept: dict[str, tuple[int, ...]] = {}

    def slow(self, data: bytes) -> list[int]:
        """Merges by a heap of (rank, place) over a linked list of symbols."""
        ids = [self.single[b] for b in data]
        n, merge = len(ids), self.merge.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i) for i in range(n - 1) if (m := merge((ids[i], ids[i + 1]))) is not None]
        heapify(heap)
        while heap:
            m, i = heappop(heap)
            j = after[i]
            if ids[i] is None or j >= n or merge((ids[i], ids[j])) != m:
                continue  # one of the two has gone into another merge
            ids[i], ids[j] = m, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := merge((m, ids[k]))) is not None:
                    heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := merge((ids[h], m))) is not None:
                heappush(heap, (r, h))
        return [x for x in ids if x is not None]

    def encode(self, texts_: list[str]) -> list[list[int]]:
        parts = [self.split(t) for t in texts_]
        fresh = [t for t in dict.fromkeys(chain.from_iterable(parts)) if t not in self.kept]
        if len(self.kept) + len(fresh) > _KEPT:
            fresh = list(dict.fromkeys(chain.from_iterable(parts)))
            self.kept = {}
        data = [t.encode() for t in fresh]
        place = self.table.find(_hashes(data)).tolist()
        ids, known, slow, kept = self.ids.tolist(), self.known, self.slow, self.kept
        for text, raw, p in zip(fresh, data, place):
            kept[text] = (ids[p],) if p >= 0 and known[p] == raw else tuple(slow(raw))
        get = kept.__getitem__
        return [list(chain.from_iterable(map(get, p))) for p in parts]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def _hashes(items: list[bytes]) -> np.ndarray:
    ends = np.cumsum(np.fromiter(map(len, items), np.int64, len(items)))
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(items) else ends
    return W.pieces_hash(np.frombuffer(b"".join(items), np.uint8), starts, ends)


@lru_cache(2)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    return Tokenizer(path, pattern)


def _batches(parts, path: str, pattern: str):
    """(columns of doc ids, lists of ids) for a few MB of text at a time."""
    own = tokenizer(path, pattern)
    for batch in parts:
        for part in W.slices(batch, most=1 << 22):
            yield part, own, own.encode([t or "" for t in part.column("text").to_pylist()])


def encoded(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids): the token ids of every text."""
    def run(batches):
        for part, _, ids in _batches(batches, path, pattern):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, bytes) of (doc_id, ids); a null list is an empty one."""
    def run(batches):
        own = tokenizer(path, pattern)
        for batch in batches:
            data = [own.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "bytes"])
    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded and decoded in one pass; with the ids themselves if asked."""
    def run(batches):
        for part, own, all_ids in _batches(batches, path, pattern):
            names = own.names.__getitem__
            out = [part.column("doc_id"), pa.array(map(len, all_ids), pa.int64()),
                   pa.array([hashlib.sha256(",".join(map(names, ids)).encode()).hexdigest() for ids in all_ids], pa.string()),
                   pa.array([hashlib.sha256(own.decode(ids)).hexdigest() for ids in all_ids], pa.string())]
            columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                out, columns = [*out, pa.array(all_ids, pa.list_(pa.int32()))], [*columns, "ids"]
            yield pa.RecordBatch.from_arrays(out, columns)
    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)


def op4_byte_bpe(spark, sf_dir):
    """Token counts and hashes of ids and decoded bytes for every document."""
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
