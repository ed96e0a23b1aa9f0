"""Text expressions: cleaning, flags, tokens, phrase forms. All of them stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: marks, placeholder grammars and character classes ----
INVISIBLE_MARKS = "\u200e\u200f\ufeff\u202a\u202b\u202c\u202d\u202e"
ISOLATES = "[\u2066-\u2069]"
NOT_BLANK = "(?U)[^\\s\u2066-\u2069]"
EDITED_SUFFIX = r"(?iU)\s*<This message was edited>\s*$"
MEDIA_KINDS = r"media|image|video|gif|sticker|audio|voice(?:\s+message)?|album|contact\s+card|document"
MEDIA = (
    r"(?iU)<\s*(?:unknown|album)\s+message\s*>"
    rf"|<\s*(?:forwarded\s+)?(?:{MEDIA_KINDS})\s+omitted\s*>"
    rf"|(?:^|\s)(?:forwarded\s+)?(?:{MEDIA_KINDS})\s+omitted(?:$|\s)"
)
FORWARDED = r"(?iU)\[\s*forwarded\s*\]"
WAITING = r"(?iU)waiting for this message(?:\s*\.?\s*this may take a while\.?)?"
UNPARSED = r"(?imUd)^\s*\[UNPARSED\s*-\s*review this line\].*$"
DELETED = r"(?iU)this message was deleted|you deleted this message"
CALL = r"(?iU)missed voice call|missed video call|^\s*voice call\s*$|^\s*video call\s*$"
INGEST_MEDIA_PARTS = (
    "<media omitted>",
    "image omitted",
    "video omitted",
    "audio omitted",
    "sticker omitted",
    "gif omitted",
    "document omitted",
    "this message was deleted",
    "you deleted this message",
    "missed voice call",
    "missed video call",
)
TRANSCRIPT_MEDIA_PARTS = (
    "image omitted",
    "video omitted",
    "audio omitted",
    "sticker omitted",
    "gif omitted",
    "media omitted",
)
PLACEHOLDER_PART = "waiting for this message"
SYSTEM_EVENT_LABEL = (
    r"(?iU)\s(?:changed|added|removed|joined|created|deleted|pinned|unpinned|"
    r"turned|updated|reset|invited|was added|were added)\b"
    r"|^(?:you|messages and calls)\b.*\b(?:changed|added|removed|created|encrypted)\b"
)
WORD_CHARS = r"[\p{L}\p{Nl}\p{No}\x{0300}-\x{036f}\x{0610}-\x{061a}\x{064b}-\x{065f}\x{0670}]"
WORD = rf"{WORD_CHARS}+(?:['’]{WORD_CHARS}+)*"
TAG = r"(?U)@\w+"
# Bold, italic and struck text; only a line feed ends a line.
MARKUP = ((r"(?d)\*(.*?)\*", "b"), (r"(?d)_(.*?)_", "i"), (r"(?d)~(.*?)~", "strike"))
EMOJI_CHAR = (
    r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}"
    r"\x{2190}-\x{21FF}\x{2B00}-\x{2BFF}]"
)
# Every placeholder and notice holds one of these, so that plain text skips the patterns above.
NOTICE_PARTS = ("OMITTED", "MESSAGE", "FORWARDED", "UNPARSED", "CALL")
# The same, found letter by letter: no other character is a form of these first letters, so a plain class can stand before the rest.
NOTICE_HINT = f"(?=[{''.join(sorted({c for p in NOTICE_PARTS for c in p[0] + p[0].lower()}))}])(?iU:{'|'.join(p.lower() for p in NOTICE_PARTS)})"


def squeeze(c: Column) -> Column:
    """Every run of whitespace as one space, none at the ends."""
    # Single spaces are most of all whitespace and stay as they are.
    return F.trim(F.regexp_replace(c, r"(?U)\s{2,}|[\s&&[^ ]]", " "))


def strip(c: Column) -> Column:
    """No whitespace of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_line(c: Column) -> Column:
    """A raw line without invisible direction marks."""
    return F.translate(c, INVISIBLE_MARKS, "")


def strip_isolates(c: Column) -> Column:
    return F.regexp_replace(c, ISOLATES, "")


def may_be_notice(text: Column) -> Column:
    """A quick search that every edited, media, deleted, call or other marked text passes. Upper case costs many times as much as the
    pattern, so only texts that hold a part in some case are put into it. Filters copy it with the text it reads, so the upper-case text
    is bound once and not written out for each part."""
    def held(upper: Column) -> Column:
        hit = F.contains(upper, F.lit(NOTICE_PARTS[0]))
        for part in NOTICE_PARTS[1:]:
            hit = hit | F.contains(upper, F.lit(part))
        return hit
    return text.rlike(NOTICE_HINT) & F.transform(F.array(F.upper(text)), held)[0]


def is_edited(text: Column) -> Column:
    return text.rlike(EDITED_SUFFIX)


def without_edited_suffix(text: Column) -> Column:
    return F.regexp_replace(text, EDITED_SUFFIX, "")


def is_media(text: Column) -> Column:
    return text.rlike(MEDIA)


def is_deleted(text: Column) -> Column:
    return text.rlike(DELETED)


def is_call(text: Column) -> Column:
    return text.rlike(CALL)


def analysis_text(text: Column, marked: Column, typed: Column | None = None) -> Column:
    """The text that statistics look at: placeholders and markers out, whitespace squeezed.
    `marked` tells which texts may hold any; of those `typed` is read, if given."""
    cleared = F.regexp_replace(text if typed is None else typed, ISOLATES, "")
    for pattern in (MEDIA, FORWARDED, WAITING, UNPARSED):
        cleared = F.regexp_replace(cleared, pattern, " ")
    return squeeze(F.when(marked, cleared).otherwise(F.regexp_replace(text, ISOLATES, "")))


def is_blank(text: Column) -> Column:
    """Nothing but whitespace and isolates, so that an unmarked text leaves no analysis text."""
    return ~text.rlike(NOT_BLANK)


def lexical_text(analysis: Column) -> Column:
    """Analysis text without line breaks (also written out as backslash-n) and @tags."""
    lines = F.replace(F.replace(analysis, F.lit("\\n"), F.lit(" ")), F.lit("\n"), F.lit(" "))
    return F.when(F.contains(lines, F.lit("@")), F.regexp_replace(lines, TAG, " ")).otherwise(lines)


def is_ingest_media(msg: Column) -> Column:
    """Media, deleted or call line, as ingest counts them."""
    return F.lower(msg).rlike("|".join(INGEST_MEDIA_PARTS))


def is_placeholder(msg: Column) -> Column:
    """A stand-in for a message that had not synced when it was exported."""
    return F.lower(msg).contains(PLACEHOLDER_PART)


def is_system_label(label: Column) -> Column:
    """A sender label that is really the head of an event text."""
    return label.rlike(SYSTEM_EVENT_LABEL)


def words(text: Column) -> Column:
    """Words as written, in any script, inner apostrophes included."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def tokens(text: Column) -> Column:
    """Lower-case words with straight apostrophes."""
    return words(F.lower(F.replace(text, F.lit("’"), F.lit("'"))))


def phrase_form(text: Column) -> Column:
    """The form under which two whole messages are the same phrase."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(text, f"{EMOJI_CHAR}+", "")), r"[^\p{L}\p{N}_\s]+", " ")
    return squeeze(bare)


def emojis(text: Column) -> Column:
    """Every emoji character of the text."""
    return F.regexp_extract_all(text, F.lit(EMOJI_CHAR), F.lit(0))


def _longest_first(parts) -> str:
    return "|".join(sorted(set(parts), key=lambda p: (-len(p), p)))


def _quoted(word: str) -> str:
    return re.escape(word.lower())


def word_list_pattern(entries) -> str:
    """Whole-word, case-insensitive pattern over a word list, longest entry first."""
    return rf"(?iU)\b(?:{_longest_first(_quoted(w) for w in entries)})\b"


def laugh_pattern(entries, stretches, strict_boundaries: bool = False) -> str:
    """Laugh words and stretch patterns. Entries without letters or digits (emoji) match alone
    unless `strict_boundaries` asks for word boundaries around them too."""
    wordy = [w for w in entries if strict_boundaries or re.search(r"\w", w)]
    bare = [w for w in entries if w not in wordy]
    alternatives = [rf"\b(?:{_longest_first([*map(_quoted, wordy), *stretches])})\b"]
    alternatives += [_quoted(w) for w in bare]
    return "(?iU)" + "|".join(alternatives)


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def is_question(text: Column, starters) -> Column:
    """Holds a question mark or begins with a question word."""
    asks = text.contains("?")
    if starters:
        head = _longest_first(_quoted(w) for w in starters)
        asks = asks | text.rlike(rf"(?iU)^\s*(?:{head})\b")
    return asks


def is_shout(text: Column) -> Column:
    """At least four characters, all upper case, with letters in it."""
    return (F.length(text) >= 4) & (text == F.upper(text)) & (text != F.lower(text)) & text.rlike(r"\p{L}")


def count_char(text: Column, char: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))).cast("long")


def chat_markup(text: Column) -> Column:
    """Inline chat markup as tags, everything else escaped."""
    out = text
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    for pattern, tag in MARKUP:
        out = F.regexp_replace(out, pattern, f"<{tag}>$1</{tag}>")
    return F.replace(out, F.lit("\n"), F.lit("<br/>"))
