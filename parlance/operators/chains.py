"""Repeat chains: one message, or a cycle of messages, said again back to back.

Exact runs are window work. The full rule (cycles, one-typo matches, tolerated interruptions) is
a greedy scan over a sequence. Before it runs, Spark keeps only the stretches that a chain can touch; the
scan itself (`chain_scan`) goes cell by cell and hands its state over, so neither a long chat nor a long chain is one group.
Chains that overlap are then settled, the longest first.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import times as tm
from parlance.functions.identity import folded, without_placeholders, without_signs
from parlance.model import Profile
from parlance.operators.chain_scan import SCAN_ROWS, chains_of, scan
from parlance.operators.enrich import spoken
from parlance.operators.ordering import CELL_ROWS, dense_position, previous_row, running_max, top_k
from parlance.session import materialize

RANGE = 1 << 13
FINE = 64
#: Overlapping chains that one task settles; larger clusters are broken up by rounds first.
TOGETHER = 1 << 15


def chain_texts(enriched: DataFrame, keys=("chat_id",)) -> DataFrame:
    """(keys, seq, ts, sender, text, norm): the rows chains are looked for in. System rows
    are not among them; placeholders are, with an empty `norm` that matches nothing."""
    rows = spoken(enriched).select(*keys, "seq", "ts", "sender", "text", "is_real_text")
    # Only texts that need Unicode folding go through Python, as they stand: no text is shuffled for it.
    real = F.col("is_real_text")
    folds = real & F.col("text").rlike(r"[^\x00-\x7f]")
    same = F.when(folds, folded(F.when(folds, F.col("text")))).otherwise(F.lower("text"))
    bare = rows.withColumn("_bare", F.when(real, without_signs(same)))
    forms = bare.withColumn("norm", F.when(real, without_placeholders(F.col("_bare"))).otherwise(""))
    return forms.drop("is_real_text", "_bare")


def chain_rows(enriched: DataFrame, keys=("chat_id",), cell_rows: int = CELL_ROWS) -> DataFrame:
    """The same with `pos`, the place in the sequence."""
    return dense_position(chain_texts(enriched, keys), "pos", keys, cell_rows)


def exact_runs(rows: DataFrame, profile: Profile, keys=("chat_id",), cell_rows: int = CELL_ROWS) -> DataFrame:
    """Runs of one text back to back: at least the minimum length and number of people."""
    keys = list(keys)
    lined = previous_row(rows.select(*keys, "seq", "ts", "sender", "norm"), ["norm"], keys, cell_rows)
    starts = (F.col("norm") == "") | F.col("prev").isNull() | (F.col("prev.norm") != F.col("norm"))
    marked = lined.withColumn("_start", F.when(starts, F.col("seq"))).drop("prev")
    runs = running_max(marked, "_start", "run", keys, cell_rows).where(F.col("norm") != "")
    people = runs.groupBy(*keys, "run", "sender").agg(
        F.count("*").alias("_n"), F.min("ts").alias("_a"), F.max("ts").alias("_z"), F.first("norm").alias("norm"))
    found = people.groupBy(*keys, "run").agg(
        F.first("norm").alias("norm"), F.sum("_n").alias("length"), F.count("*").alias("people"),
        F.min("_a").alias("start_ts"), F.max("_z").alias("end_ts"))
    return found.where((F.col("length") >= profile.chain_min_length) & (F.col("people") >= profile.chain_min_participants))


def _letters(text):
    return F.split(text, "")


def _close(a, b, min_len: int):
    """Both can match one pattern text: equal, or each within one typo of it, so within two typos of each other. A
    swap of neighbours is one typo and two edits: a distance of 4 takes two swaps, which leave the letters as
    they are, one of 3 a swap and an edit, which brings in or takes away one letter at most."""
    fuzzy = (F.least(F.length(a), F.length(b)) >= min_len) & (F.abs(F.length(a) - F.length(b)) <= 2)
    edits = F.levenshtein(a, b, 4)
    one_letter = (F.size(F.array_except(_letters(a), _letters(b))) <= 1) & (F.size(F.array_except(_letters(b), _letters(a))) <= 1)
    typos = (F.when(edits < 0, False).when(edits <= 2, True).when(F.abs(F.length(a) - F.length(b)) > 1, False)
             .when(edits == 3, one_letter).otherwise(F.sort_array(_letters(a)) == F.sort_array(_letters(b))))
    return F.when((a == "") | (b == ""), False).when(a == b, True).when(fuzzy, typos).otherwise(False)


def partners(rows: DataFrame, profile: Profile, keys=("chat_id",), cell_rows: int = CELL_ROWS) -> DataFrame:
    """(keys, seq, p): positions and the cycles for which a row has a partner of its slot within reach."""
    keys = list(keys)
    reach = profile.chain_tolerance + 1
    far = profile.chain_max_cycle * reach
    # Cells of positions, each with the first rows of the next one, let `lead` run per cell. A row is compared with many: by
    # bytes Spark would put few large cells into few tasks, so cells are small and the number of tasks is given.
    step = max(min(cell_rows, RANGE), far)
    here = F.expr(f"pos div {step}")
    halo = F.when((F.col("pos") % step < far) & (F.col("pos") >= step), here - 1)
    cut = rows.select(*keys, "pos", "norm", F.explode(F.array_compact(F.array(here, halo))).alias("cell"))
    cut = cut.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "cell")
    ahead = Window.partitionBy(*keys, "cell").orderBy("pos")
    near = cut.withColumn("_next", F.array(*(
        F.coalesce(_close(F.col("norm"), F.lead("norm", d).over(ahead), profile.chain_min_fuzzy_len), F.lit(False))
        for d in range(1, far + 1)
    ))).where(F.expr(f"pos div {step}") == F.col("cell"))
    fits = F.array_compact(F.array(*(
        F.when(F.exists(F.slice("_next", p, p * reach - p + 1), lambda hit: hit), p) for p in range(1, profile.chain_max_cycle + 1))))
    return near.select(*keys, F.col("pos").alias("seq"), F.explode(fits).alias("p"))


def chain_blocks(rows: DataFrame, profile: Profile, keys=("chat_id",), cell_rows: int = CELL_ROWS) -> DataFrame:
    """Rows that a chain could touch.

    In a chain of cycle p every member but the last p has a partner of the same slot between p
    and p * (tolerance + 1) rows on, at least p members have one, and members follow each other
    within tolerance + 1 rows. So per p: rows with such a partner, islands of them with small
    gaps and at least p rows; an island reaches p * (tolerance + 1) rows further. Overlapping
    islands of all p form a stretch. No chain crosses a stretch's edge.
    """
    keys = list(keys)
    reach = profile.chain_tolerance + 1
    # Each step below reads its input twice, so the narrow tables between them are written out.
    flagged = materialize(partners(rows, profile, keys, cell_rows), "partners")
    per_p = [*keys, "p"]
    gaps = previous_row(flagged, ["seq"], per_p, cell_rows)
    fresh = F.col("prev").isNull() | (F.col("seq") - F.col("prev.seq") > reach)
    opened = materialize(gaps.withColumn("_a", F.when(fresh, F.col("seq"))).drop("prev"), "islands")
    isles = running_max(opened, "_a", "isle", per_p, cell_rows)
    spans = isles.groupBy(*per_p, "isle").agg(F.count("*").alias("_n"), F.max("seq").alias("_z")).where(F.col("_n") >= F.col("p"))
    spans = spans.groupBy(*keys, F.col("isle").alias("seq")).agg(F.max(F.col("_z") + F.col("p") * reach).alias("_end"))
    spans = materialize(spans, "spans")
    opened = clusters(spans, keys, cell_rows)
    blocks = opened.groupBy(*keys, "cluster").agg(F.max("_reach").alias("_until"))
    # Rows meet the stretches that touch their cell of FINE rows; a stretch is cut twice, so that no row lists many cells.
    far_cells = F.explode(F.sequence(F.expr(f"cluster div {cell_rows}"), F.expr(f"_until div {cell_rows}")))
    cut = blocks.select(*keys, F.col("cluster").alias("_a"), F.col("_until").alias("_z"), far_cells.alias("_far"))
    low, high = F.greatest("_a", F.col("_far") * cell_rows), F.least("_z", F.col("_far") * cell_rows + cell_rows - 1)
    cut = cut.select(*keys, "_a", "_z", F.explode(F.sequence(F.floor(low / FINE), F.floor(high / FINE))).alias("_cell"))
    # The last row of a far cell and the first of the next may share a fine cell.
    return rows.withColumn("_cell", F.expr(f"pos div {FINE}")).join(cut.distinct(), [*keys, "_cell"]).where(
        F.col("pos").between(F.col("_a"), F.col("_z"))).drop("_cell", "_a", "_z")


def clusters(spans: DataFrame, keys, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Spans (keys, seq, _end), one a `seq`, with `cluster`, the start of the stretch of overlapping spans they lie in, and
    `_reach`, the furthest end so far."""
    ends = materialize(running_max(spans, "_end", "_reach", keys, cell_rows), "reach")
    tops = previous_row(ends, ["_reach"], keys, cell_rows)
    opens = F.col("prev").isNull() | (F.col("prev._reach") < F.col("seq"))
    merged = materialize(tops.select(*keys, "seq", F.when(opens, F.col("seq")).alias("_open"), "_reach"), "overlaps")
    return running_max(merged, "_open", "cluster", keys, cell_rows)


def _longest_first(found: pd.DataFrame) -> pd.DataFrame:
    """Chains of one cluster that do not overlap: the longest, then the smaller cycle, then the earlier."""
    taken, chosen = [], []
    order = found.sort_values(["members", "cycle_length", "first_pos"], ascending=[False, True, True])
    for row, span in zip(order.index, zip(order["first_pos"], order["last_pos"])):
        i = bisect_left(taken, span)
        if (i == 0 or taken[i - 1][1] < span[0]) and (i == len(taken) or taken[i][0] > span[1]):
            insort(taken, span)
            chosen.append(row)
    return found.loc[chosen]


def _settled(chains: DataFrame, keys) -> DataFrame:
    """Greedy choice in each cluster; clusters that begin close to each other share a call."""
    def choose(part: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([_longest_first(c) for _, c in part.groupby("cluster")])

    sized = chains.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "cluster")))
    rest = sized.where(F.col("_n") > 1).drop("_n").withColumn("_range", F.expr(f"cluster div {RANGE}"))
    schema = rest.schema
    return sized.where(F.col("_n") == 1).drop("_n").unionByName(rest.groupBy(*keys, "_range").applyInPandas(choose, schema).drop("_range"))


def _round(chains: DataFrame, keys, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """(chosen, still open): chains that come before all they overlap are chosen, what overlaps those is out."""
    cells = F.explode(F.sequence(F.expr(f"first_pos div {cell_rows}"), F.expr(f"last_pos div {cell_rows}")))
    name = [*keys, "cycle_length", "start"]

    def beaten(part: pd.DataFrame) -> pd.DataFrame:
        order = part.sort_values(["members", "cycle_length", "first_pos"], ascending=[False, True, True])
        a, z = order["first_pos"].to_numpy(), order["last_pos"].to_numpy()
        order["hit"] = [bool(((a[:i] <= z[i]) & (z[:i] >= a[i])).any()) for i in range(len(a))]
        return order

    def met(part: pd.DataFrame) -> pd.DataFrame:
        best = part[part["best"]]
        a, z = best["first_pos"].to_numpy(), best["last_pos"].to_numpy()
        part["hit"] = [bool(((a <= last) & (z >= first)).any()) for first, last in zip(part["first_pos"], part["last_pos"])]
        return part

    cut = chains.withColumn("_cell", cells)
    hits = cut.withColumn("hit", F.lit(False))
    hits = hits.groupBy(*keys, "_cell").applyInPandas(beaten, hits.schema).groupBy(*name).agg((~F.max("hit")).alias("best"))
    judged = materialize(chains.join(hits, name), "chain-round")
    cut = judged.withColumn("_cell", cells).withColumn("hit", F.lit(False))
    out = cut.groupBy(*keys, "_cell").applyInPandas(met, cut.schema).groupBy(*name).agg(F.max("hit").alias("hit"))
    left = judged.join(out, name).where(~F.col("hit") & ~F.col("best"))
    return judged.where("best").select(*chains.columns), materialize(left.select(*chains.columns), "chain-round")


def apart(chains: DataFrame, keys=("chat_id",), cell_rows: int = CELL_ROWS) -> DataFrame:
    """Of chains that overlap the longest stays, then that with the smaller cycle, then the earlier."""
    keys = list(keys)
    chosen, left = [], chains
    while True:
        spans = left.groupBy(*keys, F.col("first_pos").alias("seq")).agg(F.max("last_pos").alias("_end"))
        marks = clusters(spans, keys, cell_rows).select(*keys, F.col("seq").alias("first_pos"), "cluster")
        marked = left.join(marks, [*keys, "first_pos"])
        sizes = marked.groupBy(*keys, "cluster").agg((F.count("*") > TOGETHER).alias("large"))
        marked = materialize(marked.join(sizes, [*keys, "cluster"]), "chain-clusters")
        chosen.append(_settled(marked.where(~F.col("large")).drop("large"), keys).drop("cluster").select(*chains.columns))
        large = marked.where("large").select(*chains.columns)
        if large.isEmpty():
            return reduce(DataFrame.unionByName, chosen)
        best, left = _round(large, keys, min(cell_rows, 1024))
        chosen.append(best)


def find_chains(rows: DataFrame, profile: Profile, keys=("chat_id",), cell_rows: int = CELL_ROWS,
                scan_rows: int = SCAN_ROWS) -> tuple[DataFrame, DataFrame]:
    """The chains of every sequence (keys, cycle_length, start, members, first_pos, last_pos), and the stretches of rows that
    are their members (keys, cycle_length, start, from, to), none longer than a cell."""
    keys = list(keys)
    pieces = scan(chain_blocks(rows, profile, keys, cell_rows), profile, keys, scan_rows)
    chains = materialize(apart(materialize(chains_of(pieces, profile, keys), "chain-candidates"), keys, cell_rows), "chains")
    name = [*keys, "cycle_length", "start"]
    runs = pieces.join(chains.select(*name), name, "left_semi").select(*name, F.inline("runs"))
    return chains, runs


def ranked_chains(chains: DataFrame, profile: Profile, keys=("chat_id",)) -> DataFrame:
    """The top chains per sequence: longest, then smaller cycle, then earliest."""
    order = [F.desc("members"), F.asc("cycle_length"), F.asc("first_pos")]
    return top_k(chains, list(keys), order, profile.chain_top_n, "place")


def chain_report(rows: DataFrame, chains: DataFrame, runs: DataFrame, profile: Profile, keys=("chat_id",), cell_rows: int = CELL_ROWS) -> DataFrame:
    """Report rows of the top chains: repetitions, times, participants, interruptions, pattern and
    the first messages shown."""
    keys = list(keys)
    totals = chains.groupBy(*keys).agg(F.count("*").alias("total_found"))
    top = materialize(ranked_chains(chains, profile, keys), "top-chains")
    on = [*keys, "first_pos"]
    # A row meets the top chains of its cell; those of a chat do not overlap, so it lies in one of them at most.
    spans = top.select(*on, "last_pos", "cycle_length", "start", F.explode(F.sequence(F.expr(f"first_pos div {cell_rows}"), F.expr(f"last_pos div {cell_rows}"))).alias("_cell"))
    near = rows.withColumn("_cell", F.expr(f"pos div {cell_rows}")).join(spans, [*keys, "_cell"])
    near = near.where(F.col("pos").between(F.col("first_pos"), F.col("last_pos"))).drop("_cell")
    name = [*keys, "cycle_length", "start"]
    members = runs.join(top.select(*name), name, "left_semi").select(*name, F.explode(F.sequence("from", "to")).alias("pos"), F.lit(True).alias("member"))
    held = near.join(members, [*name, "pos"], "left").fillna(False, ["member"])
    held = materialize(held.select(*on, "cycle_length", "pos", "ts", "sender", "text", "member"), "chain-rows")
    people = held.groupBy(*on, "member", "sender").agg(F.count("*").alias("n"), F.min("pos").alias("_p"))
    person = F.struct((-F.col("n")).alias("k"), "_p", F.col("sender").alias("name"), F.col("n").alias("count"))
    tally = people.groupBy(*on).agg(*(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("member") == m, person))),
                    lambda e: F.struct(e["name"].alias("name"), e["count"].alias("count"))).alias(name)
        for m, name in ((True, "participants"), (False, "interrupted_by"))
    ))
    shown_rows = held.where(F.col("pos") < F.col("first_pos") + profile.chain_max_shown_messages)
    entry = F.struct("pos", F.col("ts").alias("at"), "sender", "text", (~F.col("member")).alias("interruption"))
    shown = shown_rows.groupBy(*on).agg(F.array_sort(F.collect_list(entry)).alias("messages"))
    times = held.groupBy(*on).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("span"))
    first_members = F.slice(F.filter("messages", lambda m: ~m["interruption"]), F.lit(1), F.col("cycle_length").cast("int"))
    report = top.join(times, on).join(tally, on).join(shown, on).join(totals, keys)
    return report.select(
        *keys, "place", F.col("members").alias("length"), "cycle_length",
        (F.col("members") / F.col("cycle_length")).alias("repetitions"), "start_ts", "end_ts",
        (tm.epoch_seconds(F.col("end_ts")) - tm.epoch_seconds(F.col("start_ts"))).alias("duration_seconds"),
        "participants", (F.col("span") - F.col("members")).alias("interruptions"), "interrupted_by",
        F.transform(first_members, lambda m: F.struct(m["sender"].alias("sender"), m["text"].alias("text"))).alias("pattern"),
        "messages", "span", (F.col("span") > profile.chain_max_shown_messages).alias("messages_truncated"), "total_found",
    )
