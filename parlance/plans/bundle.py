"""Every report table, for the whole chat and for its slices, from one pass per table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from parlance.model import SECTIONS, Profile
from parlance.operators import chains, mentions, people, summary, terms
from parlance.operators.slices import slice_participants, sliced
from parlance.session import materialize


def bundle(enriched: DataFrame, profile: Profile, segments: DataFrame | None = None, aliases: DataFrame | None = None,
           baseline: DataFrame | None = None, stopwords: DataFrame | None = None, min_messages: int = 10,
           sections=None) -> dict[str, DataFrame]:
    """Result tables keyed by (chat_id, slice). `sections` picks which ones are built."""
    chosen = set(sections or SECTIONS)
    keys = ["chat_id", "slice"]
    cut = sliced(enriched, profile, segments if "arcs" in chosen else None)
    if "lastperiod" not in chosen:
        cut = cut.where(cut["slice"] != "last")
    who = materialize(slice_participants(cut, min_messages), "participants")
    everyone = slice_participants(cut, 1) if aliases is not None else None
    lookup = materialize(mentions.name_lookup(who, aliases, keys, everyone), "names")
    rows = materialize(mentions.without_mentions(cut, lookup, keys), "sliced")
    daily = summary.daily_counts(rows, keys)
    out: dict[str, DataFrame] = {"participants": who}
    if "overview" in chosen:
        out["overall"] = summary.overall(daily, keys)
    if "timing" in chosen:
        out |= {"per_day": summary.per_day(daily, keys), "by_hour": summary.by_hour(rows, keys),
                "by_weekday": summary.by_weekday(rows, keys), "by_month": summary.by_month(rows, keys),
                "heatmap": summary.heatmap(rows, keys), "peaks": summary.peaks(rows, keys)}
    edges = mentions.mention_edges(rows, lookup, keys)
    if "mentions" in chosen:
        out |= {"mention_edges": edges, "mention_totals": mentions.mention_totals(edges, keys)}
    if chosen & {"individuals", "leaderboards"}:
        stats = materialize(people.person_stats(rows, who, profile, edges, keys), "person_stats")
        out |= {"person_stats": stats, "leaderboards": people.leaderboards(stats, keys),
                "top_emojis": people.top_emojis(rows, keys)}
    if "words" in chosen:
        rules, spans = profile.per_slice(), terms.window_days(rows, keys)
        words = materialize(terms.day_index(terms.word_uses(rows, rules, stopwords, keys), keys), "words")
        said = terms.displays(rows, keys)
        phrases = materialize(terms.day_index(terms.phrase_uses(rows, rules, keys), keys), "phrases")
        out["repeated_phrases"] = terms.repeated_phrases(phrases, said, spans, who, rules, keys)
        out["signature_words"] = terms.signatures(words, spans, who, rules, keys)
        out["signature_phrases"] = terms.signatures(phrases, spans, who, rules, keys)
        if baseline is not None:
            out["distinctive_words"] = terms.distinctive_words(words, spans, who, baseline, rules, keys)
        if "arcs" in chosen:
            # The fingerprint compares like with like, so the whole chat is indexed by the loose rules too.
            loose = profile.loose()
            word_days = materialize(terms.day_index(terms.word_uses(rows, loose, stopwords, keys), keys), "loose-words")
            phrase_days = materialize(terms.day_index(terms.phrase_uses(rows, loose, keys), keys), "loose-phrases")
            out["fingerprint_words"] = terms.fingerprints(word_days, spans, who, profile)
            out["fingerprint_phrases"] = terms.fingerprints(phrase_days, spans, who, profile, uses=said)
    if "funfacts" in chosen:
        gaps = summary.reply_gaps(rows, keys)
        out |= {"busiest_days": summary.extreme_days(daily, keys), "quietest_days": summary.extreme_days(daily, keys, most=False),
                "media_days": summary.media_days(daily, keys), "streaks": summary.streaks(daily, keys),
                "silences": summary.silences(rows, keys), "longest_messages": summary.longest_messages(rows, keys),
                "quickest_replies": summary.quickest_replies(gaps, keys), "median_reply_gap": summary.median_reply_gap(gaps, keys)}
    if "chains" in chosen:
        sequence = materialize(chains.chain_rows(rows, keys), "sequence")
        found, runs = chains.find_chains(sequence, profile, keys)
        out["chains"] = chains.chain_report(sequence, found, runs, profile, keys)
    return out
