"""Known names behind an @: the lookup, the mention edges, and text without them.

A name may hold several words. Every beginning of what follows an @ that ends where a name may end and is as long as some
name is looked up. The lengths of names are one row for all chats, so that no row is sent to its chat for them. Edges are counted per
sender and set of beginnings before the names are looked up. Where rows are kept, the sets they ask for, each once a chat, are joined with the
chat's spellings, and a row gets the map of those it holds. No row meets all names of its chat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.operators.enrich import spoken

_AT = r"(?U)(?<![\w@])@"
# What may follow a name: not more name characters; a possessive or punctuation is fine.
_NAME_END = r"(?U)^(?![\w@]|-\w|'(?!s\b))"


def name_lookup(people: DataFrame, aliases: DataFrame | None = None, keys=("chat_id",), everyone: DataFrame | None = None) -> DataFrame:
    """(keys, variant, target, listed): every spelling that points at exactly one person.

    Full names and aliases are exact and beat first names, which are derived; a spelling that
    several people share is left out, and an ambiguous exact one is not replaced by a guess.
    `aliases` is (alias_key, canonical) over all chats. Aliases count for `everyone` who writes in a
    chat, also below the minimum that makes a participant; such targets are not `listed`.
    """
    keys = list(keys)
    first = F.regexp_extract("sender", r"(?U)^\s*(\S+)", 1)
    spellings = F.array(F.struct(F.lower("sender").alias("variant"), F.lit(0).alias("tier")), F.struct(F.lower(first).alias("variant"), F.lit(1).alias("tier")))
    own = people.select(*keys, F.col("sender").alias("target"), (first != F.col("sender")).alias("derives"), F.inline(spellings))
    tiers = own.where((F.col("tier") == 0) | F.col("derives")).select(*keys, "variant", "target", F.lit(True).alias("listed"), "tier")
    if aliases is not None:
        known = people.select(*keys, F.col("sender").alias("canonical"), F.lit(True).alias("listed"))
        if everyone is not None:
            known = known.unionByName(everyone.select(*keys, F.col("sender").alias("canonical"), F.lit(False).alias("listed")))
        known = known.groupBy(*keys, "canonical").agg(F.max("listed").alias("listed"))
        extra = aliases.where(~F.col("alias_key").contains("@")).join(known, "canonical")
        tiers = tiers.unionByName(extra.select(*keys, F.lower(F.trim("alias_key")).alias("variant"), F.col("canonical").alias("target"), "listed", F.lit(0).alias("tier")))
    owner = F.struct("target", "listed")
    owners = tiers.where(F.col("variant") != "").groupBy(*keys, "variant").agg(
        F.min("tier").alias("_best"),
        *(F.min(F.when(F.col("tier") == t, owner)).alias(f"_a{t}") for t in (0, 1)),
        *(F.max(F.when(F.col("tier") == t, owner)).alias(f"_z{t}") for t in (0, 1)),
    )
    low = F.when(F.col("_best") == 0, F.col("_a0")).otherwise(F.col("_a1"))
    high = F.when(F.col("_best") == 0, F.col("_z0")).otherwise(F.col("_z1"))
    return owners.where(low["target"] == high["target"]).select(*keys, "variant", low["target"].alias("target"), low["listed"].alias("listed"))


def _with_tries(rows: DataFrame, lookup: DataFrame, column: str) -> DataFrame:
    """Adds `_parts`: what lies before the first @ and then each piece that follows one, with the names `tries` it may begin with. Null
    in rows without an @."""
    sizes = lookup.agg(F.collect_set(F.length("variant")).alias("_sizes"))
    tagged = F.contains(F.col(column), F.lit("@"))

    def tries(piece: Column) -> Column:
        begins = F.transform(F.sequence(F.lit(1), F.least(F.length(piece), F.array_max("_sizes"))), lambda n: F.struct(n.alias("n"), F.lower(F.left(piece, n)).alias("variant")))
        # Four characters are as far as the pattern looks.
        fits = F.filter(begins, lambda t: F.array_contains("_sizes", F.length(t["variant"])) & F.substr(piece, t["n"] + 1, F.lit(4)).rlike(_NAME_END))
        return F.when((F.length(piece) > 0) & (F.size("_sizes") > 0), fits)

    parts = F.transform(F.split(F.col(column), _AT), lambda piece, i: F.struct(piece.alias("piece"), F.when(i > 0, tries(piece)).alias("tries")))
    return rows.crossJoin(F.broadcast(sizes)).withColumn("_parts", F.when(tagged, parts)).drop("_sizes")


def _with_names(rows: DataFrame, lookup: DataFrame, keys, column: str) -> DataFrame:
    """Adds `_parts` and `_names`, the owners of those names tried that are names of the chat, by spelling."""
    cut = _with_tries(rows, lookup, column)
    cut = cut.withColumn("_tried", F.array_sort(F.array_distinct(F.flatten(F.transform(
        F.filter("_parts", lambda p: p["tries"].isNotNull()), lambda p: p["tries"]["variant"])))))
    asked = cut.select(*keys, "_tried").distinct()
    entry = F.struct("variant", F.struct("target", "listed").alias("owner"))
    # Of the outer form Spark makes no filter that would work the beginnings out a second time.
    known = asked.withColumn("variant", F.explode_outer("_tried")).join(lookup, [*keys, "variant"])
    names = known.groupBy(*keys, "_tried").agg(F.map_from_entries(F.collect_list(entry)).alias("_names"))
    return cut.join(names, [*keys, "_tried"], "left").drop("_tried")


def _longest(part: Column) -> Column:
    """The longest of the names tried that is one, null without any."""
    known = F.when(F.col("_names").isNotNull(), F.filter(part["tries"], lambda t: F.map_contains_key(F.col("_names"), t["variant"])))
    return F.array_max(known)


def mention_edges(enriched: DataFrame, lookup: DataFrame, keys=("chat_id",)) -> DataFrame:
    """(keys, src, dst, cnt): who mentions which participant, and how often."""
    keys = list(keys)
    rows = spoken(enriched).where(F.contains(F.col("analysis_text"), F.lit("@")))
    cut = _with_tries(rows.select(*keys, "sender", "analysis_text"), lookup, "analysis_text")
    said = cut.select(*keys, F.col("sender").alias("src"), F.explode(F.transform("_parts", lambda p: p["tries"])).alias("_tries"))
    said = said.groupBy(*keys, "src", "_tries").agg(F.count("*").alias("cnt"))
    tried = said.select(*keys, "src", "_tries", "cnt", F.inline("_tries")).join(lookup, [*keys, "variant"])
    # The longest of the names tried that is one.
    owners = tried.groupBy(*keys, "src", "_tries").agg(F.max(F.struct("n", "target", "listed", "cnt")).alias("_hit"))
    edges = owners.select(*keys, "src", "_hit.*").where("listed")
    return edges.groupBy(*keys, "src", F.col("target").alias("dst")).agg(F.sum("cnt").alias("cnt"))


def mention_totals(edges: DataFrame, keys=("chat_id",)) -> DataFrame:
    """Mentions given and received per person."""
    sides = edges.select(*keys, F.inline(F.array(
        F.struct(F.col("src").alias("sender"), F.col("cnt").alias("given"), F.lit(0).cast("long").alias("received")),
        F.struct(F.col("dst").alias("sender"), F.lit(0).cast("long").alias("given"), F.col("cnt").alias("received")),
    )))
    return sides.groupBy(*keys, "sender").agg(
        F.sum("given").alias("mentions_given"), F.sum("received").alias("mentions_received"),
    )


def without_mentions(enriched: DataFrame, lookup: DataFrame, keys=("chat_id",)) -> DataFrame:
    """Adds `lexical_text` with known names (several words too) and other @tags taken out, and
    its word count. Rows without an @ pass straight through."""
    keys = list(keys)
    named = _with_names(enriched, lookup, keys, "analysis_text")
    cut = F.transform("_parts", lambda p: F.struct(p["piece"].alias("piece"), _longest(p)["n"].alias("n")))
    rest = F.transform(cut, lambda p, i: F.when(i == 0, p["piece"]).when(
        p["n"].isNotNull(), F.concat(F.lit(" "), F.substr(p["piece"], p["n"] + 1))).otherwise(F.concat(F.lit("@"), p["piece"])))
    bare = F.when(F.contains(F.col("analysis_text"), F.lit("@")), F.array_join(rest, "")).otherwise(F.col("analysis_text"))
    lexical = named.withColumn("lexical_text", tx.lexical_text(bare)).drop("_names", "_parts")
    return lexical.withColumn("word_count", tx.word_count(F.col("lexical_text")))
