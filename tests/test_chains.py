import random

import pandas as pd
import pytest

from parlance.functions.fuzzy import similar
from parlance.model import Profile
from parlance.operators import chain_scan as cs
from parlance.operators import chains as ch

RULES = Profile()
LETTERS = "abcdefghilnoxyz0123456789"


def one_typo(word):
    """Every string one edit or one adjacent swap away from `word`, over the letters the tests use."""
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return ({a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in LETTERS}
            | {a + c + b[1:] for a, b in cuts if b for c in LETTERS} | {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1})


def alike(a, b):
    if not a or not b or a == b:
        return bool(a) and a == b
    return min(len(a), len(b)) >= 4 and b in one_typo(a)


def by_hand(texts, senders, tolerance=1, longest=8, fewest=3):
    """The chain rules, step by step, on a whole sequence."""
    cache = {}

    def same(a, b):
        if (a, b) not in cache:
            cache[a, b] = alike(a, b)
        return cache[a, b]

    found = []
    for p in range(1, longest + 1):
        i = 0
        while i + p < len(texts):
            cycle, at, slot, members = texts[i:i + p], i + p - 1, 0, list(range(i, i + p))
            grown = all(cycle)
            while grown:
                grown = False
                for j in range(at + 1, min(at + 2 + tolerance, len(texts))):
                    if same(cycle[slot % p], texts[j]):
                        members.append(j)
                        at, slot, grown = j, slot + 1, True
                        break
            if not all(cycle) or len(members) < 2 * p:
                i += 1
                continue
            after = members[-1] + 1
            at, slot, grown = i, -1, True
            while grown:
                grown = False
                for j in range(at - 1, max(at - 2 - tolerance, -1), -1):
                    if same(cycle[slot % p], texts[j]):
                        members.insert(0, j)
                        at, slot, grown = j, slot - 1, True
                        break
            i = after
            shorter = any(p % q == 0 and all(same(cycle[k], cycle[k + q]) for k in range(p - q)) for q in range(1, p))
            people = {senders[m] for m in members}
            if len(members) >= fewest and not shorter and (len(people) > 1 or p > 1):
                found.append((-len(members), p, members[0], members))
    taken, out = set(), []
    for _, p, _, members in sorted(found, key=lambda c: c[:3]):
        span = set(range(members[0], members[-1] + 1))
        if not span & taken:
            taken |= span
            out.append((p, members))
    return out


def whole_scan(texts, senders, rules=RULES):
    """The walk over one sequence as a single cell, chains that overlap settled."""
    cell = cs.Cell(range(len(texts)), texts, senders, 0, max(len(texts), 1), rules)
    rows = [r for p in range(1, rules.chain_max_cycle + 1) for r in cs._walked(cell, 0, p, 0, [])]
    found = {}
    for _, p, kind, start, _, _, n, first, last, runs, people, dull in rows:
        if kind == "piece":
            found.setdefault((p, start), []).append((n, first, last, runs, set(people), dull))
    table = []
    for (p, start), pieces in found.items():
        members = sorted(i for x in pieces for run in x[3] for i in range(run["from"], run["to"] + 1))
        people = set().union(*(x[4] for x in pieces))
        if not any(x[5] for x in pieces) and len(members) >= rules.chain_min_length and (len(people) > 1 or p > 1):
            table.append((p, len(members), members[0], members[-1], members))
    chosen = ch._longest_first(pd.DataFrame(table, columns=["cycle_length", "members", "first_pos", "last_pos", "list"]))
    return [(p, m) for p, m in zip(chosen["cycle_length"], chosen["list"])]


def spread_scan(spark, chats, rules=RULES, **sizes):
    """{chat: chains as (cycle, members)} by the whole Spark plan."""
    data = [(c, i, s, t) for c, (texts, senders) in chats.items() for i, (t, s) in enumerate(zip(texts, senders))]
    rows = spark.createDataFrame(data, "chat_id long, pos long, sender string, norm string").repartition(4)
    chains, runs = ch.find_chains(rows, rules, **sizes)
    got = {}
    for r in chains.join(runs, ["chat_id", "cycle_length", "start"]).collect():
        got.setdefault(r.chat_id, {}).setdefault((r.cycle_length, r.first_pos, r.last_pos, r.members), []).extend(range(r["from"], r["to"] + 1))
    for c, found in got.items():
        assert all(len(m) == n and min(m) == a and max(m) == z for (_, a, z, n), m in found.items())
    return {c: sorted((p, sorted(m)) for (p, *_), m in found.items()) for c, found in got.items()}


def sequence(rng, n, kinds):
    words = ["", "hi", "ho", "abcd", "abdc", "abce", "abcdef", "gggg", "hhhhh"][:kinds]
    texts = []
    while len(texts) < n:
        if rng.random() < 0.3:
            cycle = [rng.choice(words) for _ in range(rng.randint(1, 4))]
            texts += cycle * rng.randint(2, 4)
        else:
            texts.append(rng.choice([*words, f"lone{len(texts)}xyz"]))
    return texts[:n], [rng.choice("ABC") for _ in range(n)]


def test_scan_equals_the_rules_by_hand():
    rng = random.Random(3)
    for _ in range(250):
        texts, senders = sequence(rng, rng.randint(2, 40), rng.randint(3, 9))
        assert whole_scan(texts, senders) == by_hand(texts, senders)


def long_sequence(rng, n):
    """Long stretches of cycles with interruptions, typos and words that belong to two interleaved chains."""
    texts = []
    while len(texts) < n:
        cycle = [rng.choice(["hi", "ho", "abcd", "abdc", "gggg"]) for _ in range(rng.randint(1, 4))]
        for _ in range(rng.randint(1, 60)):
            texts += [rng.choice(["x", "abce"]) if rng.random() < 0.02 else t for t in cycle]
            if rng.random() < 0.05:
                texts.append(rng.choice(["hi", f"lone{len(texts)}"]))
    return texts[:n], [rng.choice("ABC") if rng.random() < 0.5 else "A" for _ in range(n)]


@pytest.mark.parametrize("cell_rows", [16, 1 << 17])
def test_blocks_lose_no_chain(spark, cell_rows):
    rng = random.Random(11)
    chats = {c: sequence(rng, 260, 9) for c in range(6)}
    got = spread_scan(spark, chats, cell_rows=cell_rows)
    for c, (texts, senders) in chats.items():
        assert got.get(c, []) == sorted(by_hand(texts, senders))


@pytest.mark.parametrize("together", [1 << 15, 2])
def test_state_crosses_cells(spark, monkeypatch, together):
    """Chains over many cells, walks back into earlier cells, and clusters settled in rounds."""
    monkeypatch.setattr(ch, "TOGETHER", together)
    rng = random.Random(21)
    chats = {c: long_sequence(rng, 700) for c in range(8)}
    chats[8] = ((["b", "a"] * 150 + ["a", "a", "a"]), ["A", "B", "C"] * 101)  # 'a' reaches back through the chain of 'b'
    chats[9] = (["hi"] * 500, ["A", "B"] * 250)
    chats[10] = ([], [])
    got = spread_scan(spark, chats, cell_rows=64, scan_rows=32)
    for c, (texts, senders) in chats.items():
        assert got.get(c, []) == sorted(by_hand(texts, senders)), c


def test_wrong_guesses_are_walked_again(spark, monkeypatch):
    """Without a lead-in every cell inside a chain begins in the wrong state."""
    monkeypatch.setattr(cs.Cell, "entry", lambda self, p: (self.low, []))
    rng = random.Random(22)
    chats = {c: long_sequence(rng, 300) for c in range(3)}
    got = spread_scan(spark, chats, cell_rows=64, scan_rows=32)
    for c, (texts, senders) in chats.items():
        assert got.get(c, []) == sorted(by_hand(texts, senders)), c


def test_close_holds_whatever_matches_one_pattern(spark):
    """Any two texts within a typo of a third pass; unrelated words of four letters don't."""
    rng = random.Random(23)
    pairs = []
    for _ in range(400):
        word = "".join(rng.choice("abcdxy") for _ in range(rng.randint(4, 7)))
        near = sorted(w for w in one_typo(word) if len(w) >= 4)
        pairs.append((rng.choice(near), rng.choice(near)))
    df = spark.createDataFrame([*pairs, ("abcd", "wxyz"), ("abcd", "wbyz")], "a string, b string")
    got = {(r.a, r.b): r.c for r in df.select("a", "b", ch._close(df.a, df.b, 4).alias("c")).collect()}
    assert all(got[x] for x in pairs) and not got["abcd", "wxyz"] and not got["abcd", "wbyz"]


def test_non_ascii_texts_fold_once(spark):
    texts = ["Straße", "STRASSE", "ｈｉ", "hi", "É!", "é", "é"]
    rows = spark.createDataFrame([(0, i, "A", t, False, True, False, False, False) for i, t in enumerate(texts)],
                                 "chat_id long, seq long, sender string, text string, is_system boolean, is_real_text boolean, is_media boolean, is_deleted boolean, is_call boolean")
    rows = rows.selectExpr("*", "timestamp_ntz'2024-01-01 10:00:00' AS ts", "true AS counted")
    got = [r.norm for r in ch.chain_rows(rows).orderBy("pos").collect()]
    assert got == ["strasse", "strasse", "hi", "hi", "é", "é", "é"]


def test_no_text_is_shuffled_to_be_folded(spark):
    """Texts are folded where they stand, in one reading of the rows; only the order in cells moves them."""
    rows = [(0, 0, "A", "É!", True), (0, 1, "B", "É <Media omitted>", False), (0, 2, "A", "Image omitted", True), (0, 3, "B", "AB, c", True)]
    rows = spark.createDataFrame(rows, "chat_id long, seq long, sender string, text string, is_real_text boolean")
    found = ch.chain_rows(rows.selectExpr("*", "false AS is_system", "timestamp_ntz'2024-01-01 10:00:00' AS ts"))
    assert "hashpartitioning(text" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.pos, r.norm) for r in found.orderBy("pos").collect()] == [(0, "é"), (1, ""), (2, ""), (3, "ab c")]


def test_small_cells_share_a_call(spark):
    assert (cs.cells_together(16), cs.cells_together(cs.SCAN_ROWS), cs.cells_together(1 << 20)) == (cs.SCAN_ROWS // 16, 1, 1)


def test_runs_need_no_positions(spark):
    rows = spark.createDataFrame([(0, i, s, t, True) for i, (s, t) in enumerate(["Ax", "Bx", "Ay"])],
                                 "chat_id long, seq long, sender string, text string, is_real_text boolean")
    texts = ch.chain_texts(rows.selectExpr("*", "false AS is_system", "timestamp_ntz'2024-01-01 10:00:00' AS ts"))
    assert "pos" not in texts.columns
    assert [(r.run, r.norm, r.length, r.people) for r in ch.exact_runs(texts, RULES.override(chain_min_length=2)).collect()] == [(0, "x", 2, 2)]


def test_similar_column(spark):
    words = ["", "hi", "ho", "hello", "hlelo", "hell", "helloo", "jello", "ehllo", "olleh", "abcd", "badc"]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for r in pairs.select("a", "b", similar(pairs.a, pairs.b).alias("s")).collect():
        assert r.s == cs.similar(r.a, r.b, 4)
    assert cs.similar("hello", "hlelo", 4) and not cs.similar("hi", "ho", 4)


def test_report(spark):
    texts = ["x", "hi", "Hi!", "hi", "other", "HI", "y"]
    senders = ["A", "A", "B", "A", "B", "A", "B"]
    data = [(0, i, i, s, t, t.lower().strip("!")) for i, (t, s) in enumerate(zip(texts, senders))]
    rows = spark.createDataFrame(data, "chat_id long, pos long, seq long, sender string, text string, norm string")
    rows = rows.selectExpr("*", "timestamp_ntz'2024-01-01 10:00:00' + make_dt_interval(0, 0, CAST(pos AS INT)) AS ts")
    found, runs = ch.find_chains(rows, RULES)
    r = ch.chain_report(rows, found, runs, RULES).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.length, r.cycle_length, r.span, r.interruptions, r.duration_seconds, r.total_found) == (4, 1, 5, 1, 240, 1)
    assert [(p["name"], p["count"]) for p in r.participants] == [("A", 3), ("B", 1)]
    assert [(p["name"], p["count"]) for p in r.interrupted_by] == [("B", 1)]
    assert [m.text for m in r.messages] == ["hi", "Hi!", "hi", "other", "HI"]
    assert [p.text for p in r.pattern] == ["hi"]


def test_partners_of_a_chat_are_sought_in_many_tasks(spark):
    """A chat within one large cell is still the work of several tasks, with the same partners as in any other cells."""
    n = 9 * ch.RANGE
    rows = spark.range(n).selectExpr("id div 1000000 AS chat_id", "id AS pos", "concat('text ', (id * id) % 7) AS norm")
    found = ch.partners(rows, RULES)
    assert found.selectExpr("spark_partition_id() AS t").distinct().count() > 1
    narrow = ch.partners(rows, RULES, cell_rows=500)
    assert found.count() == narrow.count() > 0 and found.exceptAll(narrow).isEmpty()
