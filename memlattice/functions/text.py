"""Tokens, keyword scores, segments and categories of texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that keyword scoring leaves out.
SEARCH_STOPWORDS = (
    "the a an in on at to for of and or is are was were be been being have has had do does did will would could should "
    "may might this that these those it its with from by as not but also more than such which can"
).split()
#: Words that keyword extraction leaves out.
EXTRACT_STOPWORDS = "the a an is are was were be been 이 가 은 는 을 를 의 에 에서".split()
#: Words that dimension keywords leave out.
DIMENSION_STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might must can "
    "이 가 은 는 을 를 의 에 에서 와 과"
).split()
#: Segment categories by first match, their patterns and weights.
CATEGORIES = (
    ("causal", r"\b(because|therefore|thus|hence|so)\b", "때문에|따라서|그러므로", 0.3),
    ("conditional", r"\b(if|when|unless|condition)\b", "만약|조건|경우", 0.2),
    ("procedural", r"\b(how to|steps|process|method)\b", "방법|절차|과정", 0.25),
    ("definitional", r"\b(is|are|was|were|definition)\b", "은|는|이다|정의", 0.15),
)
#: Task types by first match.
TASKS = (
    ("search", "search|find|look|검색|찾"),
    ("create", "create|make|build|생성|만들"),
    ("fix", "fix|debug|repair|수정|고치"),
    ("explain", "explain|describe|설명"),
    ("analyze", "analyze|분석"),
)
#: Dimension categories by prefix, in order.
DIMENSION_PREFIXES = (
    ("sem", "semantic"), ("syn", "syntactic"), ("ctx", "contextual"), ("rel", "relational"), ("abs", "abstract"),
    ("temp", "temporal"), ("cause", "causal"), ("goal", "goal-oriented"), ("prob", "probabilistic"),
)
SPACE = r"[\s\x{0B}\x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def words(text: Column) -> Column:
    """Non-empty parts between white space."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower case; what is neither an ASCII word character nor Hangul separates."""
    return words(F.regexp_replace(F.lower(text), r"[^a-z0-9_\s가-힣ㄱ-ㅎㅏ-ㅣ]", " "))


def search_text(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " ")


def search_terms(query: Column) -> Column:
    stop = F.array(*map(F.lit, SEARCH_STOPWORDS))
    return F.filter(words(search_text(query)), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def occurrences(text: Column, term: Column) -> Column:
    """Places where ``term`` begins in ``text``, overlapping ones included."""
    return F.regexp_count(text, F.concat(F.lit("(?=\\Q"), term, F.lit("\\E)")))


def keyword_score(terms: Column, content: Column) -> Column:
    """Mean over the terms of 0.5 + 0.5 · n / (n + 1.5) for n occurrences (0 without any), at most 1."""
    text = search_text(content)
    one = lambda t: F.when(occurrences(text, t) > 0, 0.5 + 0.5 * occurrences(text, t) / (occurrences(text, t) + 1.5)).otherwise(0.0)
    total = F.aggregate(F.transform(terms, one), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(terms) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), total / F.size(terms)))


def keyword_weight(query: Column) -> Column:
    """The share of the keyword score in a hybrid score, by the words of the query."""
    n = F.size(words(query))
    return F.when(n <= 3, 0.15).when(n <= 7, 0.25).otherwise(0.35)


def segments(text: Column) -> Column:
    """Sentences of paragraphs, trimmed, of at least 10 characters."""
    parts = F.flatten(F.transform(F.split(text, r"\n\n+"), lambda p: F.split(p, rf"(?<=[.!?。！？]){SPACE}+")))
    trimmed = F.transform(parts, lambda s: F.regexp_replace(s, rf"^{SPACE}+|{SPACE}+$", ""))
    return F.filter(trimmed, lambda s: F.length(s) >= 10)


def category(segment: Column) -> Column:
    out = F
    for name, english, korean, _ in CATEGORIES:
        hit = F.lower(segment).rlike(english) | segment.rlike(korean)
        out = out.when(hit, name)
    return out.otherwise("general")


def importance(segment: Column, kind: Column, accesses: Column) -> Column:
    weight = F
    for name, _, _, w in CATEGORIES:
        weight = weight.when(kind == name, w)
    n = F.size(F.split(segment, SPACE + "+"))
    return F.least(F.lit(1.0), 0.5 + weight.otherwise(0.0) + F.least(F.lit(0.2), n / 100) + F.least(F.lit(0.1), F.coalesce(accesses, F.lit(0)) / 100))


def keywords(text: Column, stopwords: list[str] = EXTRACT_STOPWORDS) -> Column:
    """The first ten words of more than two characters that aren't stop words; repeats stay."""
    clean = F.regexp_replace(F.lower(text), r"[^a-z0-9_\s가-힣]", "")
    stop = F.array(*map(F.lit, stopwords))
    return F.slice(F.filter(words(clean), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)), 1, 10)


def keyword_importance(keyword: Column, context: Column) -> Column:
    n = F.regexp_count(F.lower(context), F.concat(F.lit("\\Q"), F.lower(keyword), F.lit("\\E")))
    return 0.7 * F.least(F.lit(1.0), n / 10) + 0.3 * F.least(F.lit(1.0), F.length(keyword) / 10)


def task_type(text: Column) -> Column:
    out = F
    for name, pattern in TASKS:
        out = out.when(F.lower(text).rlike(pattern), name)
    return out.otherwise("general")


def dimension_category(name: Column) -> Column:
    out = F
    for prefix, kind in DIMENSION_PREFIXES:
        out = out.when(name.startswith(prefix), kind)
    return out.otherwise("extended")


def preview(text: Column, length: int = 220) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("…"))).otherwise(text)


def shown_bytes(n: Column) -> Column:
    """A byte count in B, KB, MB or GB with one decimal."""
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1 << 20, F.format_string("%.1f KB", n / 1024)).when(n < 1 << 30, F.format_string("%.1f MB", n / (1 << 20))).otherwise(F.format_string("%.1f GB", n / (1 << 30)))
