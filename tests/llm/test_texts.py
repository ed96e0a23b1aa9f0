"""Operators on single texts: secrets, tokens, personal data, language model, toxicity."""

import base64
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken

from parlance.llm import byte_bpe, language_model, personal, secrets, token_counts, toxicity
from parlance.llm.perfect_hash import PerfectHash
from tests.llm import brute

ODD = [(900, None), (901, ""), (902, " \n "), (None, "token: abcdef123"), (903, "same"), (903, "same"), (904, "é 😀 \u0000 日本語"), (905, "word " * 30000)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' AS rules", "1 AS gram", "2 AS n_tokens", "'b' AS spans", "3 AS held", "4 AS stream", "5 AS h", "6 AS row").repartition(3)


def soup(parts, seed, n, longest=14):
    r = random.Random(seed)
    return [(i, "".join(r.choice(parts) for _ in range(r.randrange(longest)))) for i in range(n)]


def by_row(rows, answers):
    return sorted(((d, *a) for (d, _), a in zip(rows, answers)), key=repr)


def test_secrets(spark, monkeypatch):
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIkey", "=", ":", " ", '"', "'", "abc", "abcdef", "x=y", "AKIA", "ABCDEFGH12345678", "AKIAAKIA", "0123456789abcdef", "deadbeef",
             "é😀", "-", "ghp_" + "a" * 36, "eyJhbGciOiJI.eyJzdWIiOiIx", "\n"]
    rows = soup(parts, 1, 1500) + ODD + [(950, "token" + " " * 50000 + ":"), (951, "a" * 100000), (952, "AKIA" * 20000)]
    monkeypatch.setattr(secrets, "table", lambda *_: frame(spark, rows))
    got = secrets.op1_secret_scan(spark, "").collect()
    answers = [(*c, brute.sha(j)) for c, j in (brute.secrets(t) for _, t in rows)]
    assert sorted(((x.doc_id, x.n_assign, x.n_access, x.n_hex, x.base_sha256) for x in got), key=repr) == by_row(rows, answers)
    more = [x.spans for x in got]
    assert any("github:" in s for s in more) and any("jwt:" in s for s in more)


def test_trigram_queries():
    assert secrets.trigrams(secrets.BASE["hex"]) is None
    assert secrets.trigrams("AKIA[A-Z0-9]{16,}") == [frozenset({"aki", "kia"})]
    assert {frozenset({"tok", "oke", "ken"}), frozenset({"sec", "ecr", "cre", "ret"})} <= set(secrets.trigrams(secrets.ASSIGN))
    for rule, pattern in secrets.RULES.items():
        for hit in re.findall(r"\S+", {"github": "ghs_" + "1" * 36, "slack": "xoxp-1234567890", "google": "AIza" + "b" * 35}.get(rule, "")):
            assert any(all(g in hit.lower() for g in clause) for clause in secrets.trigrams(pattern))


def test_secrets_empty(spark):
    assert secrets.secrets(frame(spark, [])).count() == 0


def test_personal_data(spark, monkeypatch):
    parts = ["1", "22", "4111 1111 1111 1111", "4111111111111111", "+1 (988) 555-2485", "+", ".", "-", " ", "a@b.c", "x.y@z-w.co.uk", "_d@e.f", "@", "192.168.1.1", "256.1.1.1",
             "1.2.3.4.5.6.7.8", "é😀", "abc", "(", ")", "000.0.0.0255", "me (at) site (dot) org", "DE89370400440532013000"]
    rows = soup(parts, 2, 2000) + ODD + [(950, "a" * 100000 + "@"), (951, "1" * 50000), (952, "a@" + "b." * 20000 + "c"), (953, "1 " * 50000)]
    monkeypatch.setattr(personal, "table", lambda *_: frame(spark, rows))
    got = personal.op6_personal_data(spark, "").collect()
    answers = [(*c, brute.sha(j)) for c, j in (brute.personal(t) for _, t in rows)]
    assert sorted(((x.doc_id, x.n_email, x.n_ip, x.n_card, x.n_phone, x.base_sha256) for x in got), key=repr) == by_row(rows, answers)
    base = {x.doc_id: x.spans for x in got}
    for d, t in rows:
        if d is not None and d < 900:  # base spans stay among all spans
            joined = brute.personal(t)[1]
            assert set(joined.split(",")) - {""} <= set(base[d].split(","))


def test_boosted_trees_separate():
    x = np.array([[g, d, l, 0, 0, 0, 0, 0, 0] for g in range(2) for d in range(20) for l in (0, 1)])
    y = ((x[:, 1] >= 12) & (x[:, 2] == 1)).astype(float)
    trees = personal.boosted(x, y, np.full(len(y), 50.0))
    score = sum(personal._value(t, x) for t in trees)
    assert score[y == 1].min() > score[y == 0].max()


def test_personal_data_empty(spark):
    assert personal.personal_data(frame(spark, [])).count() == 0


def tokenizer():
    path = P.path(byte_bpe.VOCABULARY)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark):
    path, want = tokenizer()
    rows = soup(["the ", "abc", "日本", "é", "1", "\n", "  ", "😀", "<|endoftext|>", "'ll", "zzzzqqqq", "\t"], 3, 400, 40) + [(d, t) for d, t in ODD if d != 904] + [(906, "日本語\u0000"), (907, "a" * 3000 + "ab" * 2000)]
    got = byte_bpe.round_trip(frame(spark, rows), path, keep_ids=True).collect()
    ids = [want.encode_ordinary(t or "") for _, t in rows]
    answers = [(len(x), brute.sha(",".join(map(str, x))), brute.sha(t or "")) for x, (_, t) in zip(ids, rows)]
    assert sorted(((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in got), key=repr) == by_row(rows, answers)
    assert sorted(x.ids for x in got) == sorted(ids)
    back = byte_bpe.decoded(byte_bpe.encoded(frame(spark, rows), path), path).collect()
    assert sorted(bytes(x.bytes).decode() for x in back) == sorted(t or "" for _, t in rows)
    assert byte_bpe.encoded(frame(spark, []), path).count() == 0


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    table = PerfectHash(keys)
    assert (table.find(keys) == np.arange(5000)).all()
    assert (table.find(keys + np.uint64(1)) >= 0).sum() == 0
    assert len(table.fingerprint) == 5000 and sum(int(a.sum()) for a, _ in table.levels) == 5000


@pytest.mark.parametrize("chunk", [40, 1 << 16])
def test_token_counts(spark, monkeypatch, chunk):
    monkeypatch.setattr(token_counts, "OVERLAP", 16)
    rows = soup(["the ", "a", " ", "  ", "▁", "日本", "é", "\n", "😀", "hello ", "un", "\t", "    ", "x▁y", "<s>", "<0x41>"], 4, 300, 60) + [(d, t) for d, t in ODD if d != 904]
    rows += [(906, "日" * 500), (907, " " * 700), (908, "w" * 1000 + " " + "v" * 900)]
    pieces = sentencepiece.SentencePieceProcessor(model_file=P.path(token_counts.MODEL))
    got = token_counts.token_counts(frame(spark, rows), P.path(token_counts.MODEL), chunk).collect()
    answers = [(len((t or "").encode()), len(pieces.encode(t or ""))) for _, t in rows]
    assert sorted(((x.doc_id, x.n_bytes, x.n_tokens) for x in got), key=repr) == by_row(rows, answers)
    assert token_counts.token_counts(frame(spark, []), P.path(token_counts.MODEL)).count() == 0


def collapsing(folder) -> str:
    """The same model, but told to fold runs of spaces, so that tokens no longer cover the bytes of a text."""
    data = open(P.path(token_counts.MODEL), "rb").read()
    at = data.rindex(b"\x20\x00")  # remove_extra_whitespaces of the normalizer
    path = folder / "collapsing.model"
    path.write_bytes(data[:at] + b"\x20\x01" + data[at + 2:])
    return str(path)


def test_token_counts_widened(spark, tmp_path):
    path = collapsing(tmp_path)
    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    assert pieces.encode("a  b") == pieces.encode("a b")
    rows = soup(["the ", "a", " ", "   ", "日本 ", "é", "😀", "hello "], 8, 60, 80) + [(None, "two  spaces " * 30), (None, "two  spaces " * 30), (70, "one space " * 40), (71, None)]
    own = token_counts.Counter(path)
    assert any(own.between(*c) is None for _, t in rows for c in token_counts.chunks(t or "", 40))
    got = token_counts.token_counts(frame(spark, rows), path, 40).collect()
    answers = [(len((t or "").encode()), len(pieces.encode(t or ""))) for _, t in rows]
    assert sorted(((x.doc_id, x.n_bytes, x.n_tokens) for x in got), key=repr) == by_row(rows, answers)


def test_overlaps_double(monkeypatch):
    """An alignment that needs 1,000 characters beyond a stretch is found without the whole text; one that never holds takes the whole."""
    own = token_counts.counter(P.path(token_counts.MODEL))
    text = "some words of a long text " * 1030
    seen = []

    class Late:
        count = staticmethod(own.count)

        def between(self, piece, low, high):
            seen.append(len(piece))
            return own.between(piece, low, high) if min(low or 1000, len(piece) - high or 1000) >= 1000 else None

    assert token_counts.widened(Late(), text, 5000) == own.count([text])[0]
    assert max(seen) < len(text) // 2 and len(seen) > 10
    monkeypatch.setattr(Late, "between", lambda *_: None)
    assert token_counts.widened(Late(), text, 5000) == own.count([text])[0]


def test_language_model(spark):
    r = random.Random(7)
    rows = [(i, " ".join(r.choice(["the", "Cat", "sat", "on", "a", "mat"] + ["w%d" % k for k in range(60)]) for _ in range(r.randrange(40)))) for i in range(300)] + ODD[:-1]
    got = language_model.scores(frame(spark, rows), block_bytes=4000).collect()
    tokens = [brute.word_list(t) + [None] for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows]
    c = Counter(x for ts, h in zip(tokens, held) if not h for x in ts)
    n, under = sum(c.values()), sum(c.values()) + 0.1 * (len(c) + 1)
    answers = [(h, len(ts), sum(c[x] > 0 for x in ts), n, round(sum(math.log10((c[x] + 0.1) / under) for x in ts), 6)) for ts, h in zip(tokens, held)]
    assert sorted(((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got), key=repr) == by_row(rows, answers)
    assert all(math.isfinite(x.score) and x.score <= 0 for x in got)
    assert language_model.scores(frame(spark, [])).count() == 0


def test_language_model_learns_context(spark):
    """Alternating words are likelier under the model than under the counts alone."""
    rows = [(i, "ping pong " * 40 + "rare%d" % (i % 7)) for i in range(200)]
    got = language_model.scores(frame(spark, rows)).collect()
    assert sum(x.score for x in got) > sum(x.base_score for x in got) + 100


def test_segments_are_all_maximal():
    """Against the definition: segments of positive score that no other within or around them beats."""
    r = random.Random(8)
    for _ in range(200):
        s = np.array([r.choice([-3, -2, -1, 1, 2, 3]) * 1.0 for _ in range(r.randrange(1, 14))])
        got = toxicity.segments(s, np.array([0, len(s)]))[0]
        left, want = [(0, len(s))], []
        while left:
            a, b = left.pop()
            every = [(s[i:j + 1].sum(), -(j - i), -i, i, j) for i in range(a, b) for j in range(i, b)]
            if every and max(every)[0] > 0:
                _, _, _, i, j = max(every)
                want.append((float(s[i:j + 1].sum()), i, j))
                left += [(a, i), (j + 1, b)]
        assert sorted(x[0] for x in got) == sorted(x[0] for x in want)


def test_segments_of_rows_are_independent():
    score = np.full(5_000_003, toxicity.DRIFT, np.float32)
    score[-3:] = 1.337
    got = toxicity.segments(score, np.array([0, 5_000_000, len(score)]))
    alone = toxicity.segments(score[-3:], np.array([0, 3]))[0][0][0]
    assert got == [[], [(alone, 5_000_000, 5_000_002)]]
    assert alone == pytest.approx(3 * 1.337, abs=1e-6)


def test_toxicity_of_neighbouring_copies():
    rows = ["vile", "vile", "", "vile", "plain vile vile", "vile"]
    weight = np.full((2, toxicity.SLOTS), toxicity.DRIFT, np.float32)
    slot = toxicity._slots(pa.array(["vile"]))[0][0]
    weight[0, slot] = 2.0
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array(range(6), pa.int64()), pa.array(rows)], ["doc_id", "text_hash", "text"])
    found = [x for out in toxicity._scanned(weight)([batch]) for x in out.column("segments").to_pylist()]
    assert [[(x["start"], x["end"], x["score"]) for x in f] for f in found] == [[(0, 4, 2.0)], [(0, 4, 2.0)], [], [(0, 4, 2.0)], [(6, 10, 2.0)], [(0, 4, 2.0)]]


def test_toxicity(spark):
    r = random.Random(9)
    plain = ["w%d" % k for k in range(400)]
    rows, labels = [], []
    for i in range(900):
        words = [r.choice(plain) for _ in range(r.randrange(3, 60))]
        bad = r.random() < 0.2
        for _ in range(r.randrange(1, 4) if bad else 0):
            words.insert(r.randrange(len(words)), r.choice(["nasty", "vile", "awful"]) + r.choice(["", "!", "er"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows += ODD
    marks = spark.createDataFrame([*labels, (5, labels[5][1]), (None, 1), (7, None)], "doc_id long, toxic int").selectExpr("*", "1 AS quality", "2 AS h")
    got = toxicity.toxicity(frame(spark, rows), marks).collect()
    assert len(got) == len(rows)
    held = [x for x in got if x.held_out and x.doc_id < 900]
    assert held and all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got if x.doc_id is not None)
    right = sum(x.predicted == labels[x.doc_id][1] for x in held)
    assert right / len(held) > 0.97
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got)


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity(frame(spark, ODD), none).collect()
    assert len(got) == len(ODD) and {x.score for x in got} == {0.0}
    some = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity(frame(spark, []), some).count() == 0
