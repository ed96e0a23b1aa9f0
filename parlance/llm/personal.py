"""Personal data: generators propose overlapping spans, boosted trees select among them.

Base kinds (email, ip, card, phone) are patterns with checks, and their spans always stay. Generators with a high
recall propose more: written-out addresses, any number of 7 to 19 digits, account numbers. A candidate gets features of its
format (digits, groups, sign, Luhn sum, octets, domain) and context (a telling word before it, glued to a word). Gradient-
boosted trees of depth two learn which candidates look like spans that pass the base checks; their training rows are
the counts of distinct feature values, at most 26,880 by construction, so every candidate counts and nothing large
leaves Spark. On documents held out by a hash of their id the score of each generator is calibrated: the lowest threshold
at which 95 % of the accepted are right; a generator that never reaches that adds nothing. Trees are applied as
column expressions.

Defined cases: a null text is an empty one; rows that repeat are each reported; without candidates no trees are
grown and only base spans are returned. Places are code points, ends exclusive.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm import spans as S
from parlance.llm.columns import stored, table, texts

#: The base kinds in their order. Possessive forms match the same text in linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be worth running.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]",
        "mail": r"(?:@|[(\[]at[)\]])", "number": r"[0-9](?:[\x20().-]{0,2}[0-9]){6}", "account": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}"}
GENERATORS = {
    "mail": r"[A-Za-z0-9._%+-]{1,64}\x20?(?:@|[(\[]at[)\]])\x20?[A-Za-z0-9-]{1,64}(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]{1,64}){1,8}",
    "number": r"[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,18}(?![0-9])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
}
TELLING = r"(?i)(?:e-?mail|phone|tel|call|mobile|fax|card|visa|account|iban|ssn|contact|server|host)[^a-z]{0,8}$"
BEFORE = 24
FEATURES = ["gen", "digits", "luhn", "plus", "groups", "telling", "glued", "octets", "domain"]
LEVELS = [3, 20, 2, 2, 5, 2, 2, 2, 2]
ROUNDS, SHRINK, PRECISION = 24, 0.3, 0.95
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
OCTETS = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def luhn(digits: Column) -> Column:
    """Whether the check sum of a string of digits holds."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((n - i) % 2 == 1, F.substring(digits, i, F.lit(1)).cast("int") * 2).otherwise(F.substring(digits, i, F.lit(1)).cast("int")))
    total = F.aggregate(each, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x))
    return F.when(n > 0, total % 10 == 0).otherwise(F.lit(False))


def _passes(kind: str):
    """The check of a base kind, for one span."""
    def check(span: Column) -> Column:
        own = S.digits(span["hit"])
        if kind == "ip":
            return span["hit"].rlike(OCTETS)
        if kind == "card":
            return F.when(F.length(own).between(12, 19), luhn(own)).otherwise(F.lit(False))
        return F.length(own).between(9, 15) if kind == "phone" else F.lit(True)
    return check


def _found(kind: str, pattern: str) -> Column:
    text = F.col("text")
    return F.when(text.rlike(HINT[kind]), S.find(text, pattern)).otherwise(S.no_spans())


def _candidate(gen: int, right: Column):
    """Features of a span as small integers, and whether it is a base span."""
    def of(s: Column) -> Column:
        hit = s["hit"]
        own = S.digits(hit)
        ahead = F.substring(F.col("text"), F.greatest(F.lit(1), (s["start"] - BEFORE + 1).cast("int")), F.least(F.lit(BEFORE), s["start"].cast("int")))
        flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(gen).alias("gen"), F.least(F.length(own), F.lit(19)).alias("digits"),
            flag(F.length(own).between(12, 19) & luhn(own)).alias("luhn"), flag(F.startswith(hit, F.lit("+"))).alias("plus"),
            F.least(F.size(F.split(hit, r"[\x20().-]+")) - 1, F.lit(4)).alias("groups"), flag(ahead.rlike(TELLING)).alias("telling"),
            flag(ahead.rlike(r"[A-Za-z0-9]$")).alias("glued"), flag(hit.rlike(OCTETS)).alias("octets"), flag(hit.rlike(r"@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z]{2}$")).alias("domain"),
            flag(F.exists(right, lambda b: (b["start"] == s["start"]) & (b["end"] == s["end"]))).alias("y"))
    return of


def proposals(docs: DataFrame) -> DataFrame:
    """(doc_id, fold, one array of base spans per kind, cands): found in one pass, without the texts."""
    found = texts(docs).select("doc_id", "text", *[_found(k, p).alias(f"_{k}") for k, p in (BASE | GENERATORS).items()])
    found = found.select("doc_id", "text", *[F.filter(f"_{k}", _passes(k)).alias(k) for k in BASE], *[f"_{g}" for g in GENERATORS])
    found = found.withColumn("right", F.concat(*BASE))
    cands = [F.transform(f"_{g}", _candidate(i, F.col("right"))) for i, g in enumerate(GENERATORS)]
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).cast("int")
    return found.select("doc_id", fold.alias("fold"), *BASE, F.concat(*cands).alias("cands"))


def boosted(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> list[tuple]:
    """Trees of depth two by Newton steps on the log loss; rows of x stand for n candidates each."""
    score, trees = np.full(len(y), 0.0), []

    def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray):
        total = g[rows].sum() ** 2 / (h[rows].sum() + 1)
        gain, at = 1e-6, None
        for f in range(x.shape[1]):
            for cut in range(1, LEVELS[f]):
                left = rows & (x[:, f] < cut)
                right = rows & ~left
                if left.any() and right.any():
                    more = g[left].sum() ** 2 / (h[left].sum() + 1) + g[right].sum() ** 2 / (h[right].sum() + 1) - total
                    if more > gain:
                        gain, at = more, (f, cut)
        return at

    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        g, h = n * (y - p), n * p * (1 - p)
        step = lambda rows: float(SHRINK * g[rows].sum() / (h[rows].sum() + 1))  # noqa: E731, B023

        def grow(rows: np.ndarray, depth: int):
            at = best(rows, g, h) if depth else None  # noqa: B023
            if at is None:
                score[rows] += step(rows)  # noqa: B023
                return step(rows)  # noqa: B023
            left = rows & (x[:, at[0]] < at[1])
            return (*at, grow(left, depth - 1), grow(rows & ~left, depth - 1))

        trees.append(grow(np.ones(len(y), bool), 2))
    return trees


def _as_column(tree, span: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    f, cut, low, high = tree
    return F.when(span[FEATURES[f]] < cut, _as_column(low, span)).otherwise(_as_column(high, span))


def _value(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, cut, low, high = tree
    return np.where(x[:, f] < cut, _value(low, x), _value(high, x))


def fit(found: DataFrame) -> tuple[list[tuple], list[float | None]]:
    """The trees, and each generator's threshold on their sum (None: nothing is accepted)."""
    every = found.select("fold", F.explode("cands").alias("c")).groupBy("fold", *[F.col(f"c.{f}").alias(f) for f in FEATURES], F.col("c.y").alias("y")).agg(F.count("*").alias("n"))
    rows = np.array([tuple(r) for r in every.collect()], np.int64).reshape(-1, len(FEATURES) + 3)
    fold, x, y, n = rows[:, 0], rows[:, 1:-2], rows[:, -2].astype(float), rows[:, -1].astype(float)
    train = fold == 0
    if not train.any() or y[train].min() == y[train].max():
        return [], [None] * len(GENERATORS)
    trees = boosted(x[train], y[train], n[train])
    score = sum(_value(t, x) for t in trees)
    limits: list[float | None] = []
    for g in range(len(GENERATORS)):
        own = np.flatnonzero((fold == 1) & (x[:, 0] == g))
        own = own[np.argsort(-score[own])]
        right = np.cumsum(y[own] * n[own]) / np.maximum(1, np.cumsum(n[own]))
        last = np.append(np.diff(score[own]) != 0, True) if len(own) else np.empty(0, bool)
        good = np.flatnonzero((right >= PRECISION) & last)
        limits.append(float(score[own[good[-1]]]) if len(good) else None)
    return trees, limits


def _accepted(trees: list[tuple], gen: int, limit: float | None):
    """Whether a candidate of one generator is no base span and reaches the generator's threshold."""
    def keep(c: Column) -> Column:
        if limit is None:
            return F.lit(False)
        return (c["gen"] == gen) & (c["y"] == 0) & (sum((_as_column(t, c) for t in trees), F.lit(0.0)) >= limit - 1e-9)
    return keep


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, one array of spans per base kind and generator): start, end; a generator's spans are those the trees add."""
    found = stored(proposals(docs), "personal-proposals")
    trees, limits = fit(found)
    out = [F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in BASE]
    for g, (name, limit) in enumerate(zip(GENERATORS, limits)):
        out.append(F.transform(F.filter("cands", _accepted(trees, g, limit)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(name))
    return found.select("doc_id", *out)


def op6_personal_data(spark, sf_dir):
    """Counts, the hash of the base spans and all spans of every document."""
    found = personal_data(table(spark, sf_dir, "documents"))
    kinds = [*BASE, *GENERATORS]
    every = [S.labelled(F.col(k), i) for i, k in enumerate(kinds)]
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(S.joined(every[:len(BASE)], kinds), 256).alias("base_sha256"), S.joined(every, kinds).alias("spans"))
