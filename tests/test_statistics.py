import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.model import MESSAGES, Profile, choose_sections
from parlance.operators import enrich as en
from parlance.operators import mentions as mn
from parlance.operators import people as pe
from parlance.operators import segments as sg
from parlance.operators import terms as te
from parlance.plans.bundle import bundle

T0 = dt.datetime(2024, 1, 1, 9, 0)


def messages(spark, rows):
    """(days or minutes offset, sender, text) rows."""
    return spark.createDataFrame([(0, i, T0 + off, s, t, s is None) for i, (off, s, t) in enumerate(rows)], MESSAGES)


def minutes(n):
    return dt.timedelta(minutes=n)


def test_placeholders(spark):
    texts = ["<Media omitted>", "image omitted", "<Media omitted> look at this", "Waiting for this message. This may take a while.",
             "[forwarded] news", "plain  text\nhere", "fixed <This message was edited>", "This message was deleted", "Missed voice call",
             "a video call later", "voice call", "[UNPARSED - review this line] junk"]
    got = en.enrich(messages(spark, [(minutes(i), "A", t) for i, t in enumerate(texts)])).orderBy("seq").collect()
    assert [r.analysis_text for r in got] == ["", "", "look at this", "", "news", "plain text here", "fixed", "This message was deleted",
                                              "Missed voice call", "a video call later", "voice call", ""]
    assert [r.is_media for r in got] == [True] * 3 + [False] * 9
    assert [r.is_real_text for r in got] == [False, False, True, False, True, True, True, False, False, True, False, False]
    assert got[6].is_edited and got[7].is_deleted and got[8].is_call and got[10].is_call and not got[9].is_call


def test_words_of_any_script(spark):
    df = spark.createDataFrame([("Don’t stoṕ señor مرحبا x2 a_b",)], "t string")
    assert df.select(tx.tokens(F.col("t"))).first()[0] == ["don't", "stoṕ", "señor", "مرحبا", "x", "a", "b"]


def test_laughs(spark):
    df = spark.createDataFrame([("haha LOL loool lmaooo class \U0001F602\U0001F602 hahahah",)], "t string")
    p = Profile()
    loose = tx.laugh_pattern(p.laugh_words, p.laugh_regex_patterns)
    strict = tx.laugh_pattern(p.laugh_words, p.laugh_regex_patterns, True)
    assert df.select(tx.count_matches(F.col("t"), loose)).first()[0] == 7
    assert df.select(tx.count_matches(F.col("t"), strict)).first()[0] == 5


@pytest.mark.parametrize("text, target, rest", [
    ("hi @Alice Smith, ok", "Alice Smith", "hi  , ok"),
    ("@alice smith's plan", "Alice Smith", " 's plan"),
    ("@Bob-ish no", None, "-ish no"),
    ("@Bob- yes", "Bob Jones", " - yes"),
    ("@Jonas who", None, "who"),
    ("me@Bob Jones no", None, "me Jones no"),
    ("@Maria hi", "Maria", " hi"),
    ("@Maria Lopez hi", "Maria Lopez", " hi"),
])
def test_mentions(spark, text, target, rest):
    names = ["Alice Smith", "Bob Jones", "Jonas K", "Jonas P", "Maria", "Maria Lopez"]
    rows = en.enrich(messages(spark, [(minutes(i), n, "x") for i, n in enumerate(names)] + [(minutes(9), "Alice Smith", text)]))
    lookup = mn.name_lookup(en.participants(rows))
    edges = mn.mention_edges(rows, lookup).collect()
    assert [(e.src, e.dst, e.cnt) for e in edges] == ([("Alice Smith", target, 1)] if target else [])
    clean = mn.without_mentions(rows, lookup).where("seq = 6").first().lexical_text
    assert " ".join(clean.split()) == " ".join(rest.split())


def test_same_minute_keeps_order_and_own_gaps_do_not_count(spark):
    rows = en.enrich(messages(spark, [(minutes(0), "A", "x"), (minutes(0), "A", "y"), (minutes(0), "B", "z"), (minutes(200), "A", "w"), (minutes(203), "A", "v")]))
    got = {r.sender: (r.double_texts, r.conversation_starts) for r in pe.turn_taking(rows, Profile(), cell_rows=2).collect()}
    assert got == {"A": (2, 1), "B": (0, 0)}


def test_person_stats_read_written_rows_alone(spark):
    from parlance.plans.catalog.people import stats
    assert all("/person-rows-" in f for f in stats(spark, "/root/testdata/sf0.001").inputFiles())


def test_person_counts_shuffle_a_person_once_a_task(spark):
    rows = [(days(d) + minutes(60 * h), s, "so it is!") for d in range(3) for h, s in ((1, "A"), (2, "A"), (2, None), (1, "B"))]
    lex = en.with_lexical(en.enrich(messages(spark, rows).withColumn("is_system", F.lit(False))))
    counts = pe._counts_and_peak(lex, Profile())
    grouped = re.findall(r"HashAggregate\(keys=\[(.*?)\], functions=\[(.*?)\]", counts._jdf.queryExecution().executedPlan().toString())
    assert grouped and all("sum(" not in f for keys, f in grouped if "date#" in keys)
    got = {r.sender: (r.total_messages, r.active_days, r.exclamation_count, r.peak_hour, r.first_message, r.last_message) for r in counts.collect()}
    last = T0 + days(2)
    assert got == {"A": (6, 3, 6, 10, T0 + minutes(60), last + minutes(120)), "B": (3, 3, 3, 10, T0 + minutes(60), last + minutes(60)),
                   None: (3, 3, 3, 11, T0 + minutes(120), last + minutes(120))}


def days(n):
    return dt.timedelta(days=n)


def test_burst_and_steady(spark):
    rows = [(days(0) + minutes(i), "A", "this is a burst") for i in range(7)]
    rows += [(days(d), "B", "steady as always") for d in range(4)]
    lex = en.with_lexical(en.enrich(messages(spark, rows)))
    people = en.participants(lex)
    spans = te.window_days(lex)
    uses = te.phrase_uses(lex, Profile())
    top = te.repeated_phrases(te.day_index(uses), uses, spans, people, Profile()).collect()
    assert [(r.display, r.cnt, r.days, r.top_sayer) for r in top] == [("steady as always", 4, 4, "B")]
    words = te.day_index(te.word_uses(lex, Profile()))
    owned = te.signatures(words, spans, people, Profile(signature_min_messages=1)).collect()
    assert {(r.sender, r.term, r.dominance_pct) for r in owned} == {("B", "steady", 100.0)}


def test_segments(spark):
    quiet = [(days(d), "A", "hm") for d in range(60)]
    busy = [(days(20 + d) + minutes(i), "B", "exam") for d in range(14) for i in range(12)]
    table = sg.segment_table(messages(spark, sorted(quiet + busy)), Profile()).orderBy("seg_no").collect()
    assert [r.type for r in table] == ["filler", "miniarc", "filler"]
    spike = table[1]
    assert (spike.label, spike.name, spike.description) == ("Mini-arc 1", "Miniarc-1", "")
    assert sum(r.n_messages for r in table) == len(quiet) + len(busy)
    assert [c.sender for c in spike.top_contributors] == ["B", "A"] and spike.distinctive[0].sender == "B"
    assert sum(r.duration_days for r in table) == 60


def test_bundle_over_slices(spark):
    rows = [(days(d) + minutes(i), "AB"[i % 2], f"hello @{'BA'[i % 2]} about exams {d % 3}") for d in range(40) for i in range(6)]
    msgs = en.enrich(messages(spark, rows))
    table = sg.segment_table(msgs, Profile(rolling_window_days=3))
    base = te.baseline_counts(spark.createDataFrame([("hello about things",)], "text string"))
    out = bundle(msgs, Profile(last_period_days=10), table, baseline=base)
    assert {r.slice: r.total_messages for r in out["overall"].collect()} == {"full": 240, "last": 60}
    assert out["distinctive_words"].where("slice = 'full' AND term = 'exams'").count() == 1
    assert {(r.src, r.dst): r.cnt for r in out["mention_edges"].where("slice = 'full'").collect()} == {("A", "B"): 120, ("B", "A"): 120}
    assert out["leaderboards"].where("slice = 'last'").count() == 40
    for name, df in out.items():
        assert df.columns and df.limit(1).collect() is not None, name


def test_profile():
    p = Profile().extend(swear_words=["drat"]).override(TOP_N=5, night_owl_hours=[1, 4])
    assert p.swear_words[-1] == "drat" and p.top_n == 5 and p.night_owl_hours == (1, 4)
    assert Profile.from_settings({"extend": {"_comment": 1, "LAUGH_WORDS": ["xd"]}, "override": {"CHAIN_TOLERANCE": 0}}).chain_tolerance == 0
    assert p.loose().min_repeat_count == 2
    with pytest.raises(ValueError):
        Profile().override(TOPN=3)
    with pytest.raises(ValueError):
        Profile().extend(TOP_N=[3])
    assert choose_sections("words, Chains") == ["words", "chains"] and len(choose_sections(None)) == 10
    with pytest.raises(ValueError):
        choose_sections("nope")


def test_aliases_of_filtered_people(spark):
    """Taken out of the text, counted for nobody; shared with such a person an alias names no one."""
    rows = [(minutes(i), "Ann", "x") for i in range(3)] + [(minutes(5), "Robert", "y"), (minutes(6), "Ann", "@Robert Smith said @Bo and @Annie")]
    msgs = en.enrich(messages(spark, rows))
    aliases = spark.createDataFrame([("Robert Smith", "Robert"), ("Bo", "Robert"), ("Bo", "Ann"), ("Annie", "Ann")], "alias_key string, canonical string")
    lookup = mn.name_lookup(en.participants(msgs, 2), aliases, everyone=en.participants(msgs))
    assert [(e.src, e.dst, e.cnt) for e in mn.mention_edges(msgs, lookup).collect()] == [("Ann", "Ann", 1)]
    clean = mn.without_mentions(msgs, lookup).where("seq = 4").first().lexical_text
    assert clean.split() == ["said", "and"]


def test_default_baseline(spark):
    from parlance.sources.tables import PLAIN_LINES, TEMPLATES, TOPICS, default_baseline

    counts = {r.term: r.base_cnt for r in te.baseline_counts(default_baseline(spark)).collect()}
    assert counts["music"] == len(TEMPLATES) and default_baseline(spark).count() == len(PLAIN_LINES) + len(TEMPLATES) * len(TOPICS)


def test_rows_meet_the_names_they_try_only(spark):
    """In a chat of many names a row gets those that its mentions begin with."""
    rows = [(minutes(i), f"User {i}", "x") for i in range(300)] + [(minutes(400), "User 1", "@User 12 and @User 7's, @User 999 no")]
    msgs = en.enrich(messages(spark, rows))
    lookup = mn.name_lookup(en.participants(msgs))
    row = mn._with_names(msgs, lookup, ["chat_id"], "analysis_text").where("contains(text, '@')").first()
    assert set(row["_names"]) == {"user 12", "user 7"}
    assert {(e.dst, e.cnt) for e in mn.mention_edges(msgs, lookup).collect()} == {("User 12", 1), ("User 7", 1)}


def test_no_row_goes_to_its_chat_for_the_lengths_of_names(spark):
    """Else the texts of a hot chat would be the work of one task."""
    rows = [(minutes(i), f"User {i}", "x") for i in range(30)] + [(minutes(40), "User 1", "@User 12 and @User 7, @User 12")] * 2
    msgs = en.enrich(messages(spark, rows))
    lookup = mn.name_lookup(en.participants(msgs))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found in (mn.mention_edges(msgs, lookup), mn.without_mentions(msgs, lookup)):
            assert not re.search(r"hashpartitioning\(chat_id#\d+L?, \d+\)", found._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(e.src, e.dst, e.cnt) for e in mn.mention_edges(msgs, lookup).collect()} == {("User 1", "User 12", 4), ("User 1", "User 7", 2)}
    assert mn.mention_edges(msgs, lookup.where("false")).count() == 0


def test_uses_of_a_term_on_a_day_meet_once(spark):
    """Days are marked where uses are counted: one shuffle of the uses and one of their terms. Of the last minute the earliest row counts."""
    rows = [(minutes(i), s, "pear") for i, s in ((0, "A"), (1, "B"), (1, "A"), (1500, "B"), (1500, "B"), (1500, "A"))] + [(minutes(2), "B", "plum")]
    index = te.day_index(te.word_uses(en.with_lexical(en.enrich(messages(spark, rows))), Profile()))
    terms = te.term_index(index)
    assert terms._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    pear = terms.where("term = 'pear'").first()
    assert (pear.cnt, pear.days, pear.person_days, pear.first_seq) == (6, 2, 4, 0)
    said = te.with_sayers(terms, index).where("term = 'pear'").first()
    assert (said.first_by, said.last_by) == ("A", "B")


def test_filters_on_real_text_work_out_little(spark):
    texts = ["hm", " ", "", "⁦⁩  ", "<Media omitted>", "<Media omitted> look", "This message was deleted", "Missed voice call", "call me", "⁦x"]
    msgs = messages(spark, [(minutes(i), "A", t) for i, t in enumerate(texts)])
    real = en.enrich(msgs).orderBy("seq").collect()
    assert [r.is_real_text for r in real] == [True, False, False, False, False, True, False, False, True, True]
    plan = en.worded(en.enrich(msgs)).select("chat_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("upper(") == 1


def test_texts_are_shuffled_and_not_their_uses(spark):
    """Terms are counted and their days marked where a chat's day lies, for words as for phrases; a filter works no form out twice."""
    rows = [(minutes(i), s, "a pear and a pear") for i, s in ((0, "A"), (1, "B"), (1, "A"), (1500, "B"), (1500, "A"))]
    lex = en.with_lexical(en.enrich(messages(spark, rows)))
    for uses in (te.word_uses(lex, Profile()), te.phrase_uses(lex, Profile())):
        plan = te.day_index(uses)._jdf.queryExecution().executedPlan().toString()
        assert re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan) and len(re.findall("Exchange hashpartitioning", plan)) == 1
        assert plan.index("HashAggregate") < plan.index("Generate") < plan.index("Exchange hashpartitioning")
        assert re.search(r"Exchange hashpartitioning\(chat_id#\d+L?, date#\d+, \d+\)", plan)
    optimized = te.phrase_uses(lex, Profile())._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("lower(") == 1
    phrases = te.day_index(te.phrase_uses(lex, Profile()))
    best = te.repeated_phrases(phrases, te.displays(lex), te.window_days(lex), en.participants(lex), Profile(min_repeat_count=2, min_repeat_days=2)).first()
    assert (best.display, best.cnt, best.days, best.first_by, best.last_by, best.top_sayer) == ("a pear and a pear", 5, 2, "A", "B", "A")
