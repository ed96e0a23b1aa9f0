"""Words and phrases: indexes, distinctive words, repeated phrases, signatures, fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.functions.fuzzy import similar
from parlance.functions.scoring import scaled_half_days, scaled_min_days, spread_weight
from parlance.model import Profile
from parlance.operators import enrich as en
from parlance.operators import terms as te
from parlance.operators.slices import slice_participants, sliced
from parlance.plans import views
from parlance.plans.catalog.registry import query
from parlance.session import materialize

D = views.sql_enriched("documents")
# Documents repeat themselves less than chats do, so whole texts need a lower bar.
PROFILE = Profile(extra_stopwords=("that", "with", "this", "dass", "avec"), min_repeat_count=4, signature_min_messages=10)
PHRASES = Profile(min_repeat_count=2, min_repeat_days=2, signature_min_messages=10)
SMALL = Profile(extra_stopwords=(), last_period_days=14, last_period_min_word_length=4, last_period_min_repeat_count=3)


def rows(spark, sf):
    """Documents with flags and lexical text; a query reads and works out what it uses."""
    return en.with_lexical(en.enrich(views.documents(spark, sf)))


def baseline(spark, sf):
    return te.baseline_counts(views.table(spark, sf, "benchmark"))


def word_index(texts):
    return te.day_index(te.word_uses(texts, PROFILE))


def phrase_index(texts):
    return te.day_index(te.phrase_uses(texts, PHRASES))


def tokens_sql(column: str) -> str:
    return f"list_transform(regexp_extract_all({column}, {views.WORD_SQL}), lambda x: lower(replace(x, '’', '''')))"


def phrase_sql(column: str) -> str:
    bare = f"lower(regexp_replace({column}, {views.EMOJI_SQL}, '', 'g'))"
    return f"trim(regexp_replace(regexp_replace({bare}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


WORDS = D + f""", u AS (SELECT chat_id, sender, ts, seq, date, term FROM (SELECT *, UNNEST({tokens_sql('lexical_text')}) AS term FROM e WHERE is_real_text AND NOT is_system)
    WHERE length(term) >= 4 AND term NOT IN ('that', 'with', 'this', 'dass', 'avec'))"""
SENT = D + f""", u AS (SELECT * FROM (SELECT chat_id, sender, ts, seq, date, {phrase_sql('lexical_text')} AS term,
    substr(trim(regexp_replace(lexical_text, '\\s+', ' ', 'g')), 1, 200) AS display FROM e WHERE is_real_text AND NOT is_system) WHERE length(term) >= 8)"""
INDEX = """, pd AS (SELECT DISTINCT chat_id, term, sender, date FROM u),
    t AS (SELECT u.chat_id, u.term, COUNT(*) AS cnt, COUNT(DISTINCT date) AS days, MIN(ts) AS first_ts, MAX(ts) AS last_ts,
        arg_min(sender, seq) AS first_by FROM u GROUP BY 1, 2),
    y AS (SELECT chat_id, term, COUNT(*) AS person_days FROM pd GROUP BY 1, 2),
    z AS (SELECT chat_id, term, sender AS last_by FROM u QUALIFY ROW_NUMBER() OVER (PARTITION BY chat_id, term ORDER BY ts DESC, seq) = 1),
    q AS (SELECT chat_id, term, sender, COUNT(*) AS cnt, COUNT(DISTINCT date) AS days FROM u GROUP BY 1, 2, 3),
    i AS (SELECT * FROM t JOIN y USING (chat_id, term) JOIN z USING (chat_id, term)),
    wd AS (SELECT chat_id, COUNT(DISTINCT date) AS window_days FROM e WHERE is_real_text AND NOT is_system GROUP BY 1)"""
PEOPLE = """, p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY chat_id ORDER BY n DESC, sender) AS rank FROM
    (SELECT chat_id, sender, COUNT(*) AS n FROM e WHERE NOT is_system GROUP BY 1, 2)),
    s AS (SELECT q.*, p.n FROM q JOIN p USING (chat_id, sender) QUALIFY ROW_NUMBER() OVER (PARTITION BY chat_id, term ORDER BY days DESC, cnt DESC, rank) = 1)"""


def eligible_sql(count: int, days: int) -> str:
    return f""", el AS (SELECT i.*, LEAST({days}, window_days) AS min_days, LEAST(5.0, GREATEST(1.0, window_days / 4)) AS half_days FROM i JOIN wd USING (chat_id)
    WHERE cnt >= {count} AND days >= LEAST({days}, window_days)),
    w AS (SELECT *, days / (days + half_days) AS weight FROM el)"""


@query(D + f", u AS (SELECT chat_id, UNNEST({tokens_sql('text')}) AS term FROM e) SELECT chat_id, term, COUNT(*) AS n FROM u GROUP BY 1, 2")
def tokens(spark, sf):
    terms = rows(spark, sf).select("chat_id", F.explode(tx.tokens(F.col("text"))).alias("term"))
    return terms.groupBy("chat_id", "term").agg(F.count("*").alias("n"))


@query(D + f"SELECT chat_id, seq, {phrase_sql('text')} AS phrase FROM e")
def phrase_forms(spark, sf):
    return rows(spark, sf).select("chat_id", "seq", tx.phrase_form(F.col("text")).alias("phrase"))


@query(WORDS + INDEX + " SELECT chat_id, term, cnt, days, person_days, first_ts, first_by, last_ts, last_by FROM i")
def word_index_terms(spark, sf):
    index = materialize(word_index(rows(spark, sf)), "words")
    return te.with_sayers(te.term_index(index), index)


@query(WORDS + INDEX + " SELECT * FROM q")
def word_index_people(spark, sf):
    return te.person_index(word_index(rows(spark, sf)))


@query(SENT + INDEX + ", f AS (SELECT chat_id, term, arg_min(display, seq) AS display FROM u GROUP BY 1, 2) "
       "SELECT chat_id, term, cnt, days, person_days, first_ts, first_by, last_ts, last_by, display FROM i JOIN f USING (chat_id, term)")
def phrase_index_terms(spark, sf):
    texts = rows(spark, sf)
    index = materialize(phrase_index(texts), "phrases")
    return te.with_sayers(te.with_display(te.term_index(index), te.displays(texts)), index)


@query(WORDS + " SELECT chat_id, COUNT(DISTINCT term) AS vocab_overall FROM u GROUP BY 1")
def chat_vocabulary(spark, sf):
    return te.vocabulary_size(word_index(rows(spark, sf)))


@query(WORDS + INDEX + " SELECT chat_id, LEAST(3, window_days) AS min_days, LEAST(5.0, GREATEST(1.0, window_days / 4))::DOUBLE AS half_days, "
       "window_days / (window_days + 5.0)::DOUBLE AS weight FROM wd")
def spread_settings(spark, sf):
    spans = te.window_days(rows(spark, sf))
    return spans.select("chat_id", scaled_min_days(3, F.col("window_days")).alias("min_days"), scaled_half_days(5, F.col("window_days")).alias("half_days"),
                        spread_weight(F.col("window_days"), F.lit(5.0)).alias("weight"))


@query(WORDS + INDEX + eligible_sql(4, 3) + " SELECT chat_id, term, cnt, days, CAST(weight AS DOUBLE) AS weight FROM w")
def eligible_words(spark, sf):
    texts = rows(spark, sf)
    table = te.eligible(te.term_index(word_index(texts)), te.window_days(texts), PROFILE)
    return table.select("chat_id", "term", "cnt", "days", "weight")


_BASE_TEXT = "regexp_replace(text, '@\\w+', ' ', 'g')"
BASE = f""", b0 AS (SELECT UNNEST({tokens_sql(_BASE_TEXT)}) AS term FROM benchmark),
    b AS (SELECT term, COUNT(*) AS base_cnt FROM b0 GROUP BY 1), bt AS (SELECT SUM(base_cnt) AS base_total, COUNT(*) AS base_vocab FROM b)"""


@query("WITH x AS (SELECT 1)" + BASE + " SELECT * FROM b")
def baseline_words(spark, sf):
    return baseline(spark, sf)


@query(WORDS + INDEX + PEOPLE + eligible_sql(4, 3) + BASE + """, tt AS (SELECT chat_id, COUNT(*) AS total_uses FROM u GROUP BY 1),
    sc AS (SELECT w.*, (cnt / total_uses) / ((COALESCE(base_cnt, 0) + 1) / (base_total + base_vocab)::BIGINT) AS vs_baseline
        FROM w JOIN tt USING (chat_id) CROSS JOIN bt LEFT JOIN b ON w.term = b.term),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY chat_id ORDER BY vs_baseline * weight DESC, cnt DESC, term) AS rank FROM sc)
    SELECT r.chat_id, rank, r.term, r.cnt, r.days, vs_baseline, s.sender AS top_sayer, s.cnt AS top_sayer_count, first_by, first_ts, last_by, last_ts
    FROM r LEFT JOIN s ON r.chat_id = s.chat_id AND r.term = s.term WHERE rank <= 15""")
def distinctive_words(spark, sf):
    texts = rows(spark, sf)
    index = materialize(word_index(texts), "words")
    return te.distinctive_words(index, te.window_days(texts), en.participants(texts), baseline(spark, sf), PROFILE)


@query(SENT + INDEX + PEOPLE + eligible_sql(2, 2) + """, f AS (SELECT chat_id, term, arg_min(display, seq) AS display FROM u GROUP BY 1, 2),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY chat_id ORDER BY cnt * weight DESC, cnt DESC, length(term) DESC, term) AS rank FROM w)
    SELECT r.chat_id, rank, f.display, r.term, r.cnt, r.days, s.sender AS top_sayer, s.cnt AS top_sayer_count, first_by, first_ts, last_by, last_ts
    FROM r LEFT JOIN s ON r.chat_id = s.chat_id AND r.term = s.term JOIN f ON r.chat_id = f.chat_id AND r.term = f.term WHERE rank <= 15""")
def repeated_phrases(spark, sf):
    texts = rows(spark, sf)
    index = materialize(phrase_index(texts), "phrases")

    def shown(wanted):  # only texts that are shown are worked out again
        few = views.documents(spark, sf).join(wanted, ["chat_id", "seq"], "left_semi")
        return te.displays(en.with_lexical(en.enrich(few)))

    return te.repeated_phrases(index, shown, te.window_days(texts), en.participants(texts), PHRASES)


def signature_sql(count: int) -> str:
    return f""", o AS (SELECT w.*, s.sender, s.cnt AS pc, s.days AS own FROM w JOIN s ON w.chat_id = s.chat_id AND w.term = s.term
        WHERE s.days >= min_days AND s.cnt >= {count} AND s.n >= 10),
    k AS (SELECT *, 100 * own / person_days AS dominance_pct, 100 * own / person_days * (own / (own + half_days)) AS rank_score FROM o),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY chat_id, sender ORDER BY rank_score DESC, pc DESC, term) AS rank FROM k)
    SELECT chat_id, sender, rank, term, pc AS person_count, cnt AS total_count, own AS person_days, person_days AS total_days, dominance_pct,
    CAST(rank_score AS DOUBLE) AS rank_score, first_by, first_ts, last_by, last_ts FROM r WHERE rank <= 15"""


@query(WORDS + INDEX + PEOPLE + eligible_sql(4, 3) + signature_sql(4))
def signature_words(spark, sf):
    texts = rows(spark, sf)
    index = materialize(word_index(texts), "words")
    return te.signatures(index, te.window_days(texts), en.participants(texts), PROFILE)


@query(SENT + INDEX + PEOPLE + eligible_sql(2, 2) + signature_sql(2))
def signature_phrases(spark, sf):
    texts = rows(spark, sf)
    index = materialize(phrase_index(texts), "phrases")
    return te.signatures(index, te.window_days(texts), en.participants(texts), PHRASES)


# Fingerprints of the last two weeks against the whole chat.
@query(D + f""", x AS (SELECT chat_id, MAX(date) - 13 AS a FROM e GROUP BY 1),
    u0 AS (SELECT chat_id, sender, ts, seq, date, UNNEST({tokens_sql('lexical_text')}) AS term FROM e WHERE is_real_text AND NOT is_system),
    al AS (SELECT chat_id, term, COUNT(*) AS base_cnt FROM u0 WHERE length(term) >= 4 GROUP BY 1, 2),
    bt AS (SELECT chat_id, SUM(base_cnt)::BIGINT AS base_total, COUNT(*) AS base_vocab FROM al GROUP BY 1),
    u AS (SELECT u0.* FROM u0 JOIN x USING (chat_id) WHERE length(term) >= 4 AND date >= a)
    """ + INDEX.replace("FROM e WHERE is_real_text", "FROM e JOIN x USING (chat_id) WHERE date >= a AND is_real_text")
       + PEOPLE.replace("FROM e WHERE NOT is_system", "FROM e JOIN x USING (chat_id) WHERE date >= a AND NOT is_system") + eligible_sql(3, 3)
       + """, tt AS (SELECT chat_id, COUNT(*) AS total_uses FROM u GROUP BY 1),
    sc AS (SELECT w.*, base_cnt, (w.cnt / total_uses) / ((base_cnt + 1) / (base_total + base_vocab)) AS vs FROM w JOIN tt USING (chat_id) JOIN bt USING (chat_id)
        JOIN al ON w.chat_id = al.chat_id AND w.term = al.term),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY chat_id ORDER BY vs * weight DESC, cnt DESC, term) AS rank FROM sc)
    SELECT r.chat_id, 'last' AS slice, rank, r.term, r.cnt AS count_in_slice, r.days AS days_in_slice, base_cnt AS count_in_archive, vs AS vs_archive,
    s.sender AS top_sayer, s.cnt AS top_sayer_count, first_by, first_ts, last_by, last_ts
    FROM r LEFT JOIN s ON r.chat_id = s.chat_id AND r.term = s.term WHERE rank <= 15""")
def slice_fingerprint(spark, sf):
    keys = ["chat_id", "slice"]
    read = ("seq", "ts", "date", "sender", "is_system", "is_real_text", "lexical_text")
    cut = materialize(sliced(rows(spark, sf), SMALL).select(*keys, *read), "sliced")
    index = materialize(te.day_index(te.word_uses(cut, SMALL.loose(), keys=keys), keys), "words")
    return te.fingerprints(index, te.window_days(cut, keys), slice_participants(cut, 1), SMALL)


# Words next to forms of themselves: as they are, two letters swapped, one dropped, added or
# replaced, and two changes at once.
_FORMS = ("w", "concat(substr(w, 2, 1), substr(w, 1, 1), substr(w, 3))", "substr(w, 2)", "concat(w, 'x')",
          "concat('#', substr(w, 2))", "concat('##', substr(w, 3))", "concat(substr(w, 2, 1), substr(w, 1, 1), substr(w, 3), 'x')")


@query("WITH w AS (SELECT DISTINCT UNNEST(string_split(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' ')) AS w FROM benchmark), x AS ("
       + " UNION ALL ".join(f"SELECT w AS a, {f} AS b, {i} AS form FROM w" for i, f in enumerate(_FORMS))
       + """), s AS (SELECT *, length(a) AS la, length(b) AS lb, levenshtein(a, b) AS d, damerau_levenshtein(a, b) AS dd FROM x)
    SELECT a, b, form, CASE WHEN la = 0 OR lb = 0 THEN false WHEN a = b THEN true WHEN LEAST(la, lb) < 4 OR ABS(la - lb) > 1 THEN false
        ELSE d = 1 OR (d = 2 AND dd = 1 AND la = lb) END AS alike FROM s""")
def one_typo_forms(spark, sf):
    words = views.table(spark, sf, "benchmark").select(F.explode(F.split(F.regexp_replace(F.lower("text"), "[^a-z ]", ""), " ")).alias("w")).distinct()
    pairs = words.select(F.col("w").alias("a"), F.posexplode(F.array(*map(F.expr, _FORMS))).alias("form", "b"))
    return pairs.select("a", "b", "form", similar(F.col("a"), F.col("b")).alias("alike"))


@query("""WITH t AS (SELECT DISTINCT source AS label FROM documents), o AS (SELECT DISTINCT lang AS label FROM documents)
    SELECT term FROM (SELECT regexp_replace(label, '[^a-z]', '', 'g') AS term FROM t) WHERE length(term) > 1
    UNION SELECT label FROM o WHERE length(label) > 1 AND label NOT IN (SELECT lower(UNNEST(regexp_extract_all(text, '\\p{L}+'))) FROM benchmark)""")
def name_stopwords(spark, sf):
    docs = views.table(spark, sf, "documents")
    # Sources as names (digits are no letters), their languages as aliases.
    people = docs.groupBy(F.regexp_replace("source", "[0-9]", "").alias("name")).agg(F.collect_set("lang").alias("aliases"))
    return te.name_stopwords(people, baseline(spark, sf))
