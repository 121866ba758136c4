"""Text measures, keyword classification and short extracts, as SQL expressions."""

from __future__ import annotations

from . import fixed
from .sql import any_of, array, case, lit, struct


def _all_but(chars: str, highest: int) -> str:
    """Character class of everything else up to `highest`; letters come first and so match at once."""
    ranges, low = [], 0
    for code in [*sorted(map(ord, chars)), highest + 1]:
        if low < code <= highest + 1:
            ranges.append((low, code - 1))
        low = code + 1
    ranges.sort(key=lambda r: not r[0] <= ord("a") <= r[1])
    return "[" + "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in ranges) + "]"


_ASCII_WORD = _all_but("".join(c for c in fixed.WHITESPACE if ord(c) < 128), 127) + "+"
_WORD = _all_but(fixed.WHITESPACE, 0x10FFFF) + "+"


def strip(text: str) -> str:
    """Trim every Unicode white-space character, as Python does, not just blanks."""
    return f"btrim({text}, {lit(fixed.WHITESPACE)})"


def word_count(text: str) -> str:
    """Words between white space of any kind; plain ASCII text takes a simpler pattern."""
    ascii_only = f"octet_length({text}) = length({text})"
    return f"IF({ascii_only}, regexp_count({text}, {lit(_ASCII_WORD)}), regexp_count({text}, {lit(_WORD)}))"


def line_count(text: str) -> str:
    return f"(length({text}) - length(replace({text}, '\\n', '')) + 1)"


def text_stats(text: str) -> str:
    return struct(total_characters=f"length({text})", total_words=word_count(text), total_lines=line_count(text))


def has_word(lowered: str, word: str, whole_word: bool = False) -> str:
    if whole_word:
        return f"{lowered} RLIKE {lit(rf'\b{word}\b')}"
    return f"contains({lowered}, {lit(word)})"


def type_scores(text: str, whole_word: bool = False, lowered: str | None = None) -> dict[str, str]:
    """Number of distinct keywords found, per document type.

    `lowered` names a column that already holds the text in lower case.
    """
    lowered = lowered or f"lower({text})"
    return {
        name: "(" + " + ".join(f"int({has_word(lowered, w, whole_word)})" for w in words) + ")"
        for name, words in fixed.TYPE_KEYWORDS.items()
    }


def detect_document_type(text: str, whole_word: bool = False, lowered: str | None = None) -> str:
    """Type with most keywords; on a tie the one listed first; without any hit `general`."""
    scores = type_scores(text, whole_word, lowered)
    ranked = [struct(score=score, rank=str(-place), name=lit(n)) for place, (n, score) in enumerate(scores.items())]
    ranked.append(struct(score="0", rank="1", name="'general'"))
    return f"greatest({', '.join(ranked)}).name"


def categorize_document(text: str, lowered: str | None = None) -> str:
    """First category of which any keyword occurs."""
    lowered = lowered or f"lower({text})"
    hits = [(any_of(has_word(lowered, w) for w in words), lit(name)) for name, words in fixed.CATEGORY_KEYWORDS.items()]
    return case(hits, "'general'")


def detect_validation_type(field_names: str, text: str, lowered: str | None = None) -> str:
    """Type the validator assumes: by indicator fields first, then by words of the text."""
    lowered = lowered or f"lower({text})"
    by_key = [(f"arrays_overlap({field_names}, {array(keys)})", lit(n)) for n, keys in fixed.VALIDATION_KEYS.items()]
    by_word = [(any_of(has_word(lowered, w) for w in ws), lit(n)) for n, ws in fixed.VALIDATION_WORDS.items()]
    return case(by_key + by_word, "'general'")


def route_analysis(requested: str, text: str, lowered: str | None = None) -> str:
    """Analysis type to report: `auto` is detected from the text, others stand."""
    return f"IF({requested} = 'auto', {detect_document_type(text, lowered=lowered)}, {requested})"


def analysis_branch(analysis_type: str) -> str:
    """Branch that handles an analysis type; types without one share the general branch."""
    known = ", ".join(lit(b) for b in fixed.ANALYSIS_BRANCHES)
    return f"IF({analysis_type} IN ({known}), {analysis_type}, 'general')"


def summarize_truncate(text: str, limit: int = 300) -> str:
    return f"IF(length({text}) > {limit}, concat(substring({text}, 1, {limit}), '...'), {text})"


def key_points(text: str, limit: int = 5) -> str:
    """Bullet lines and lines that say `important`, longer than 20 characters, first few."""
    lines = f"transform(split({text}, '\\n'), s -> {strip('s')})"
    wanted = "length(s) > 20 AND (startswith(s, '-') OR startswith(s, '•') OR contains(lower(s), 'important'))"
    bare = strip("ltrim('- •', s)")
    return f"slice(transform(filter({lines}, s -> {wanted}), s -> {bare}), 1, {limit})"


def classify_element(text: str) -> str:
    """heading, title, paragraph or text, from length and letters of one recognised line."""
    bare = strip(text)
    plain = f"replace({bare}, ' ', '') RLIKE {lit(r'^[\p{L}\p{N}]+\z')}"
    return case(
        [
            (f"length({bare}) < 100 AND upper({bare}) = {bare} AND lower({bare}) <> {bare}", "'heading'"),
            (f"length({bare}) < 50 AND {plain}", "'title'"),
            (f"contains({text}, '\\n') OR length({bare}) > 200", "'paragraph'"),
        ],
        "'text'",
    )
