"""Text scalars as Column functions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE_END = r"[.!?](?=\s|$)"
TOKENS_PER_WORD = 1.3
# Stop words, token, number and quantity patterns, and abbreviations that end no sentence.
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "of", "on", "or", "that", "the", "their", "this", "to", "was", "were", "with"]
CONTENT_TOKEN = r"[A-Za-z0-9]+(?:[.,:/-][A-Za-z0-9]+)*"
EXACT_NUMBER = r"\b\d[\d.,:/%-]*"
QUANTITY = r"(?i)(?<![A-Za-z0-9])(?:[$€£]\s*)?[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:\([A-Za-z]\))?(?:\s*(?:%|percent(?:age)?(?:\s+points?)?))?(?![A-Za-z0-9])"
ABBREVIATIONS = (r"(?i)\b(?:D\.Phil|M\.D|Ph\.D)\.", r"\b(?:[A-Za-z]\.){2,}", r"(?i)\b(?:al|Art|cf|Ch|Dr|e\.g|Eq|etc|Fig|i\.e|Jr|Mr|Mrs|Ms|No|p|pp|Prof|Sec|Sr|St|Vol|vs)\.")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def est_tokens(text: Column, rate: float = TOKENS_PER_WORD) -> Column:
    """Half-even rounding, as Python's round()."""
    return F.bround(n_words(text) * F.lit(rate), 0).cast("long")


def to_words(tokens: Column, rate: float = TOKENS_PER_WORD) -> Column:
    return F.greatest(F.lit(1), F.floor(tokens / F.lit(rate))).cast("long")


def chunk_fixed(text: Column, size: int, step: int) -> Column:
    """Windows of `size` words every `step`, with the white space between words as it was.

    The text is cut once, into pieces of `step` words; a window is some whole pieces and the first words of the next, so no word is looked at alone.
    """
    words = lambda n: rf"(?:\S++\s*+){{1,{n}}}+"  # noqa: E731  possessive: no window takes the stack
    whole, more = divmod(size, step)

    def windows(pieces: Column) -> Column:
        n = (F.size(pieces) - 1) * step + F.regexp_count(F.element_at(pieces, -1), F.lit(r"\S+"))
        starts = F.sequence(F.lit(0), F.ceil(F.greatest(n - size, F.lit(0)) / step).cast("int"))

        def window(k: Column) -> Column:
            parts = F.array_join(F.slice(pieces, k + 1, whole), "") if whole else F.lit("")
            if more:
                parts = F.concat(parts, F.coalesce(F.regexp_extract(F.get(pieces, k + whole), "^" + words(more), 0), F.lit("")))
            return F.rtrim(parts, F.lit(" \t\n\x0b\f\r"))

        return F.when(F.size(pieces) > 0, F.transform(starts, window)).otherwise(F.array().cast("array<string>"))

    # bound to a name, so that the cut isn't made again for each window
    return F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(words(step)), F.lit(0))), windows), F.lit(0))


def compact(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def first_line(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, r"([^\s][^\n]*)", 1))


def derive_title(text: Column, limit: int = 120) -> Column:
    """The first line if short, else its first sentence, else a cut with an ellipsis."""
    line = first_line(text)
    sentence = F.regexp_extract(line, r"^(.*?[.!?])(?:\s|$)", 1)
    cut = F.concat(F.rtrim(F.substring(line, 1, limit)), F.lit("…"))
    return F.when(F.length(line) <= limit, line).when((sentence != "") & (F.length(sentence) <= limit + 40), sentence).otherwise(cut)


def budget_cut(text: Column, tokens: int) -> Column:
    """At most tokens * 5 characters, back to the last line end if there is one after the start."""
    n = tokens * 5
    prefix = F.substring(text, 1, n)
    at = F.length(prefix) - F.length(F.substring_index(prefix, "\n", -1)) - 1
    return F.when(F.length(text) <= n, text).when(at > 0, F.substring(prefix, F.lit(1), at)).otherwise(prefix)


def snippet(text: Column, limit: int) -> Column:
    """White space collapsed, cut at a space, with '...'."""
    flat = compact(text)
    head = F.substring(flat, 1, limit)
    at = F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1
    cut = F.when(at > 0, F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(cut), F.lit("...")))


def content_tokens(text: Column) -> Column:
    toks = F.regexp_extract_all(F.lower(text), F.lit(CONTENT_TOKEN), F.lit(0))
    return F.array_distinct(F.filter(toks, lambda t: (F.length(t) > 1) & ~t.isin(STOPWORDS)))


def spans(text: Column, least: int = 24) -> Column:
    """Lines with white space collapsed, cut into sentences before a capital or digit, of at least `least` characters; the whole text if none."""
    lines = F.transform(F.split(text, r"\n+"), compact)
    parts = F.flatten(F.transform(lines, lambda s: F.split(s, r"(?<=[.!?])\s+(?=[A-Z0-9])")))
    found = F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s) >= least)
    whole = compact(text)
    return F.when(F.size(found) > 0, found).when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))


def quantities(text: Column) -> Column:
    """Numbers, sums and percentages as written, without repeats."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(QUANTITY), F.lit(0)), compact))


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(EXACT_NUMBER), F.lit(0)))


def span_score(claim: Column, span: Column) -> Column:
    """Shared content tokens over the geometric mean of both sets' sizes, plus .35 of the claim's numbers found."""
    a, b = content_tokens(claim), content_tokens(span)
    na, nb = numbers(claim), numbers(span)
    overlap = F.size(F.array_intersect(a, b)) / F.sqrt(F.greatest(F.lit(1), F.size(a) * F.size(b)).cast("double"))
    bonus = F.when(F.size(F.array_intersect(na, nb)) > 0, 0.35).otherwise(0.0)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(overlap + bonus)


def fingerprint(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(compact(text)), r"[.!?]+$", ""))


def many_sentences(text: Column) -> Column:
    """Whether a sentence end is followed by more, abbreviations aside."""
    for pattern in ABBREVIATIONS:
        text = F.regexp_replace(text, pattern, "X")
    return text.rlike(r"""[.!?]["')\]]*\s+\S""")


def slug(text: Column, n: int = 5) -> Column:
    head = F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, n), "-")
    return F.regexp_replace(F.lower(head), r"[^a-z0-9-]+", "")


def markers(text: Column) -> Column:
    """Ids in square brackets, several to a bracket allowed, without repeats."""
    inner = F.regexp_extract_all(text, F.lit(r"\[((?:shard_\w+)(?:\s*[,;]\s*shard_\w+)*)\]"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(inner, lambda s: F.split(s, r"\s*[,;]\s*"))))


def without_markers(text: Column) -> Column:
    bare = F.regexp_replace(text, r"\s*\[(?:shard_\w+)(?:\s*[,;]\s*shard_\w+)*\]", "")
    return F.trim(F.regexp_replace(bare, r"\s+([.,;:!?])", "$1"))


def parse_grade(text: Column) -> Column:
    """The last '##final score: n', 0 to 3, else null."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"##\s*final score\s*:\s*([0-3])\b"), F.lit(1))
    return F.get(found, F.size(found) - 1).cast("int")


def strip_markdown(text: Column) -> Column:
    for pattern, by in ((r"(?s)```.*?```", " "), (r"(?m)^#+\s*", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"(?m)^\s*[-*]\s+", ""), (r"\s+", " ")):
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


def contains_term(text: Column, term: Column) -> Column:
    """Whole-term containment: white space collapsed, letter case ignored, no letter or digit on either side."""
    quoted = F.regexp_replace(compact(F.lower(term)), r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    return F.rlike(compact(F.lower(text)), F.concat(F.lit(r"(?<![\p{L}\p{N}])"), quoted, F.lit(r"(?![\p{L}\p{N}])")))


# Query shapes of a bracketed Boolean language: (^ and), (+ or), "phrase", << >> (# proximity).
def and_arity(q: Column) -> Column:
    groups = F.regexp_extract_all(q, F.lit(r"\(\^([^()]*)\)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(groups, lambda g: F.size(F.filter(F.split(g, r"\s+"), lambda w: w != "")))), F.lit(0))


def has_phrase(q: Column) -> Column:
    return q.rlike('"[^"]+"')


def has_or(q: Column) -> Column:
    return q.contains("(+ ")


def has_proximity(q: Column) -> Column:
    return q.contains("<<") | q.contains(">>") | q.contains("(# ")


def has_entity(q: Column) -> Column:
    return F.exists(F.regexp_extract_all(q, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda t: t.rlike("[A-Z]"))


def n_atoms(q: Column) -> Column:
    return F.regexp_count(q, F.lit("[A-Za-z0-9]+"))


def shape(q: Column) -> Column:
    a = and_arity(q)
    return F.when(has_or(q), "anchor+OR").when(has_phrase(q), "phrase-bearing").when(a >= 3, "multi-AND").when(a <= 1, "single-facet").otherwise("other")


# Patterns and weights of the document quality score. Alternatives share one word boundary, and are tried only behind a letter that one begins with.
QUALITY = {
    "figures": r"(?=[\d$€£¥])(?:(?<![\w.])(?:\d{1,3}(?:,\d{3})+(?![\d,.])|\d+(?:\.\d+)?\s?(?:%|percent|per cent))|[$€£¥]\s?\d)",
    "years": r"\b(?:1[89]\d{2}|20[0-2]\d)\b",
    "units": r"(?i)\b\d+(?:\.\d+)?\s?(?:kg|km|cm|mm|mg|ml|GHz|MHz|GB|TB|kW|MW|°C|°F|mph|km/h|years?|months?|days?|hours?)\b",
    "cites": r"(?i)\b(?=[adeijpv])(?:et al\.|doi:|ISBN\b|vol\.\s?\d+|pp?\.\s?\d+|Journal of\b|Proceedings of\b|arXiv\b)|\(\d{4}\)",
    "insts": r"\b(?=[A-FILMNOSUW])(?:University|Institute|Laborator(?:y|ies)|Ministry|Department of|Commission|Bureau|Agency|Foundation|Association|Society|WHO|CDC|NIH|NASA|OECD|IMF|IEEE|NIST|FDA|EPA)\b",
    "seo": r"(?i)\b(?=[cefiklrtwy])(?:in this (?:article|post|guide|blog)\b|we will (?:delve|explore|dive)\b|keep reading\b|read on\b|let'?s (?:dive|get started|explore)\b|click here\b|you might be (?:thinking|wondering)\b|frequently asked questions\b|the ultimate guide\b|everything you need to know\b|in conclusion\b)",
    "you": r"(?i)\b(?:you|your|you'?re|you'?ll)\b",
    "llm": r"(?i)\b(?=[cdeimnprtu])(?:delve\b|delving\b|tapestry\b|navigat(?:e|ing) the complexit|testament to\b|in today'?s (?:fast-paced|digital|modern) world\b|it'?s (?:important|worth) (?:to )?not(?:e|ing)\b|multifaceted\b|plays a (?:crucial|pivotal|vital) role\b|captivating\b|realm of\b|unlock(?:ing)? the (?:power|potential|secrets)\b|embark on a journey\b|ever-(?:evolving|changing) landscape\b)",
}
QUALITY_CREDIT = {"figures": (0.30, 4.0), "years": (0.20, 4.0), "units": (0.15, 2.0), "cites": (0.20, 1.5), "insts": (0.15, 2.0)}
QUALITY_PENALTY = {"seo": (0.45, 2.0), "you": (0.25, 20.0), "llm": (0.45, 2.0)}
QUALITY_BASE, QUALITY_GAIN, QUALITY_CAP = 0.15, 0.85, 0.85


def quality_rates(text: Column) -> dict[str, Column]:
    """Occurrences of each pattern per 1000 words."""
    n = F.greatest(n_words(text), F.lit(1))
    return {k: 1000.0 * F.regexp_count(text, F.lit(p)) / n for k, p in QUALITY.items()}


def quality_score(rates: dict[str, Column]) -> Column:
    part = lambda table: sum((w * F.least(rates[k] / s, F.lit(1.0)) for k, (w, s) in table.items()), F.lit(0.0))
    score = QUALITY_BASE + QUALITY_GAIN * part(QUALITY_CREDIT) - F.least(part(QUALITY_PENALTY), F.lit(QUALITY_CAP))
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3)


def quality_band(score: Column) -> Column:
    return F.when(score < 0.20, "<0.20").when(score < 0.45, "0.20-0.45").when(score < 0.70, "0.45-0.70").otherwise(">=0.70")


def quality_reasons(rates: dict[str, Column]) -> Column:
    """What the score rests on, in words."""
    r = rates
    found = F.array_compact(
        F.array(
            F.when((r["figures"] > 0) | (r["units"] > 0), F.format_string("%.1f figures/1k, %.1f units/1k", r["figures"], r["units"])),
            F.when(r["cites"] > 0, F.format_string("%.1f citation-shaped/1k", r["cites"])),
            F.when(r["insts"] > 0, F.format_string("%.1f named institutions/1k", r["insts"])),
            F.when(r["seo"] > 0, F.format_string("SEO register (%.1f/1k)", r["seo"])),
            F.when(r["llm"] > 0, F.format_string("LLM tells (%.1f/1k)", r["llm"])),
            F.when(r["you"] > 12, F.format_string("heavily second-person (%.0f/1k)", r["you"])),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("no strong signal either way")))
