"""Secrets by a trigram inverted index.

From each rule's pattern a Boolean trigram query is derived: an OR of ANDs of three-character strings that any
match must hold, in lower case. An index of postings (trigram, document) for the trigrams that queries mention is built from the
whole texts; a rule's postings are intersected clause by clause, and only the documents left are searched with the
pattern itself. A rule without a mandatory trigram searches every document.

Defined cases: a null text is an empty one; rows that repeat are each reported; a null doc_id is kept as a key of its
own; no spans give an empty string and the hash of one.
"""

from __future__ import annotations

from itertools import product
from re import _constants as C
from re import _parser as P

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import spans as S
from parlance.llm.columns import stored, table, texts

_MOST = 64


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The base kinds, in their order, then further well-known forms of credentials.
ASSIGN = ("(" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key")
          + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
BASE = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
MORE = {
    "pem": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----",
    "github": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "google": r"AIza[A-Za-z0-9_-]{35}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}",
}
RULES = BASE | MORE
LEAST = 6


def trigrams(pattern: str) -> list[frozenset[str]] | None:
    """The pattern's query: any clause with all its trigrams. None: no trigram is mandatory."""
    return _query(list(P.parse(pattern)))


def _strings(op, value) -> set[str] | None:
    """All strings of one part of a pattern, in lower case, if they are few."""
    if op is C.LITERAL:
        return {chr(value).lower()}
    if op is C.IN and all(o is C.LITERAL for o, _ in value):
        return {chr(v).lower() for _, v in value}
    if op is C.SUBPATTERN:
        return _product(list(value[3]))
    if op is C.BRANCH:
        parts = [_product(list(x)) for x in value[1]]
        return None if any(x is None for x in parts) else set().union(*parts)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[1] is not C.MAXREPEAT and value[1] <= 8:
        one = _product(list(value[2]))
        if one is None:
            return None
        out: set[str] = set()
        for n in range(value[0], value[1] + 1):
            if len(one) ** n > _MOST:
                return None
            out |= {"".join(x) for x in product(one, repeat=n)}
        return out
    return None


def _product(parts) -> set[str] | None:
    out = {""}
    for op, value in parts:
        more = _strings(op, value)
        if more is None or len(out) * len(more) > _MOST:
            return None
        out = {a + b for a in out for b in more}
    return out


def _of(strings: set[str]) -> list[frozenset[str]] | None:
    if any(len(s) < 3 for s in strings):
        return None
    clauses = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
    return [c for c in clauses if not any(d < c for d in clauses)]


def _query(parts) -> list[frozenset[str]] | None:
    """The AND over runs of parts with few strings; what lies between them asks for nothing."""
    found, run = [], {""}
    for op, value in [*parts, (None, None)]:
        more = _strings(op, value) if op else None
        if more is not None and len(run) * len(more) <= _MOST:
            run = {a + b for a in run for b in more}
            continue
        found.append(_of(run))
        run = more or {""}
        if more is None and op in (C.SUBPATTERN, C.BRANCH):
            inner = [_query(list(value[3]))] if op is C.SUBPATTERN else [_query(list(x)) for x in value[1]]
            found.append(None if any(q is None for q in inner) else [c for q in inner for c in q])
        elif more is None and op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] > 0:
            found.append(_query(list(value[2])))
    out: list[frozenset[str]] | None = None
    for q in found:
        if q and (out is None or len(out) * len(q) <= _MOST):
            out = q if out is None else [a | b for a in out for b in q]
    return out


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, doc_id): the index, for the trigrams that some query mentions."""
    low = F.lower("text")
    return docs.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(low.contains(g), F.lit(g)) for g in grams]))).alias("gram"))


def candidates(docs: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(doc_id, rules): which rules with a trigram query may match in a document."""
    spark = docs.sparkSession
    rows = [(name, n, gram, len(clause)) for name, p in rules.items() for n, clause in enumerate(trigrams(p) or []) for gram in sorted(clause)]
    if not rows:
        return docs.select("doc_id").limit(0).withColumn("rules", F.array().cast("array<string>"))
    asked = spark.createDataFrame(rows, "rule string, clause int, gram string, size int")
    index = stored(postings(docs, sorted({r[2] for r in rows})), "trigram-postings")
    whole = index.join(F.broadcast(asked), "gram").groupBy("doc_id", "rule", "clause", "size").agg(F.count_distinct("gram").alias("n")).where("n = size")
    return whole.groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def secrets(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """(doc_id, one array of spans per rule): start, end in code points and the hit itself."""
    docs = texts(docs)
    maybe = candidates(docs, rules).withColumnRenamed("doc_id", "key")
    held = docs.join(maybe, F.col("doc_id").eqNullSafe(F.col("key")), "left").drop("key")
    out = ["doc_id"]
    for name, pattern in rules.items():
        found = S.find(F.col("text"), pattern)
        if name == "assign":
            found = F.filter(found, lambda s: F.char_length(F.regexp_extract(s["hit"], pattern, 2)) >= LEAST)
        ready = F.array_contains("rules", name) if trigrams(pattern) else F.col("text").rlike(pattern)
        out.append(F.when(ready, found).otherwise(S.no_spans()).alias(name))
    return held.select(*out)


def op1_secret_scan(spark, sf_dir):
    """Counts, the hash of the base spans and all spans of every document."""
    found = secrets(table(spark, sf_dir, "documents"))
    kinds = list(RULES)
    every = [S.labelled(F.col(k), i) for i, k in enumerate(kinds)]
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(S.joined(every[:len(BASE)], kinds), 256).alias("base_sha256"), S.joined(every, kinds).alias("spans"))


def _sql() -> str:
    cols, out = [], []
    for i, (k, p) in enumerate(RULES.items()):
        p = "'" + p.replace("'", "''") + "'"
        keep = f"len(regexp_extract(h[n], {p}, 2)) >= {LEAST}" if k == "assign" else "true"
        cols.append(f"""list_transform(list_filter(range(1, len({k}_h) + 1), lambda n: {keep.replace('h[n]', f'{k}_h[n]')}),
            lambda n: {{'s': list_sum(list_transform({k}_g[1:n], lambda g: length(g)))::BIGINT + coalesce(list_sum(list_transform({k}_h[1:n - 1], lambda g: length(g))), 0)::BIGINT,
                        'r': {i}, 'l': length({k}_h[n])}}) AS {k}""")
        out.append(f"regexp_extract_all(t, {p}) AS {k}_h, string_split_regex(t, {p}) AS {k}_g")
    names = "[" + ", ".join(f"'{k}'" for k in RULES) + "]"
    text = lambda xs: f"array_to_string(list_transform(list_sort(flatten([{', '.join(xs)}])), lambda x: concat({names}[x.r + 1], ':', x.s, ':', x.s + x.l)), ',')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT doc_id, {', '.join(out)} FROM d),
s AS (SELECT doc_id, {', '.join(cols)} FROM m)
SELECT doc_id, {', '.join(f"len({k})::BIGINT AS n_{k}" for k in BASE)}, sha256(coalesce({text(BASE)}, '')) AS base_sha256, coalesce({text(RULES)}, '') AS spans FROM s"""


SQL = _sql()
