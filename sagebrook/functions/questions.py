"""Classifying and rewriting questions, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import strip



def is_detail(q: Column) -> Column:
    return P.any_of(strip(q), P.DETAIL)


def is_comparison(q: Column) -> Column:
    return P.any_of(strip(q), P.COMPARISON)


def is_narrow(q: Column) -> Column:
    return P.any_of(strip(q), P.NARROW)


def is_exhaustive(q: Column) -> Column:
    return P.any_of(strip(q), P.EXHAUSTIVE)


def is_specific(q: Column) -> Column:
    return P.any_of(strip(q), P.SPECIFIC)


def is_follow_up(q: Column) -> Column:
    return P.any_of(strip(q), P.FOLLOW_UP)


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?iU){pattern}"), F.lit(1))


def article_numbers(q: Column) -> Column:
    """Numbers of the articles that a question asks for, in order, each once."""
    own = strip(q)
    mentions = F.contains(own, F.lit("مادة")) | F.contains(F.lower(own), F.lit("article"))
    bare = F.when(mentions, _all(own, r"\b(\d{1,3})\b")).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(_all(own, P.ARTICLE_ASKED), _all(own, P.ARTICLE_ASKED_EN), bare))


def chapter_labels(q: Column) -> Column:
    return F.array_distinct(F.transform(_all(strip(q), P.CHAPTER_ASKED), strip))


def is_structural(q: Column) -> Column:
    return (F.size(article_numbers(q)) > 0) | (F.size(chapter_labels(q)) > 0)


def wants_focus(q: Column) -> Column:
    return is_detail(q) & ~is_comparison(q) & ~is_narrow(q) & ~is_structural(q)


def query_type(q: Column) -> Column:
    return (
        F.when(strip(q) == "", "unknown")
        .when(is_structural(q), "structural")
        .when(is_comparison(q), "comparison")
        .when(is_exhaustive(q), "exhaustive_list")
        .when(is_detail(q), "detail")
        .otherwise("factual")
    )


def retrieval_limit(q: Column, default: int) -> Column:
    wide = F.when(is_exhaustive(q), 30).when(is_structural(q), 24).when(is_detail(q), 20).otherwise(default)
    return F.greatest(F.lit(default), wide)


def expansion_limit(q: Column, candidates: int, multiplier: int) -> Column:
    """How many rows each derived question fetches."""
    broad = is_detail(q) | is_comparison(q) | is_structural(q)
    by = F.when(broad, F.lit(max(5, multiplier))).otherwise(F.lit(multiplier))
    return F.greatest(F.lit(12), F.floor(F.lit(candidates) / by).cast("int"))


def article_context_limit(q: Column) -> Column:
    return F.when(is_exhaustive(q), 18).otherwise(12)


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ ?؟]+|[ ?؟]+$", "")


def section_expansions(q: Column) -> Column:
    own = strip(q)
    first = _bare(F.regexp_replace(own, f"(?iU){P.QUESTION_PREFIX}", ""))
    base = F.when(first != "", first).otherwise(own)
    second = _bare(F.regexp_replace(base, f"(?iU){P.CONVERSATION_PREFIX}", ""))
    out = F.filter(F.array_distinct(F.array(first, second)), lambda x: (x != "") & (x != own))
    return F.when(is_detail(own), out).otherwise(F.array().cast("array<string>"))


def comparison_expansions(q: Column) -> Column:
    """The two things that a question compares."""
    own = strip(q)

    def side(n: int) -> Column:
        return F.when(own.rlike(f"(?iU){P.COMPARED_AR}"), F.regexp_extract(own, f"(?iU){P.COMPARED_AR}", n)).otherwise(F.regexp_extract(own, f"(?iU){P.COMPARED_EN}", n))

    out = F.array_distinct(F.filter(F.array(_bare(side(1)), _bare(side(2))), lambda x: x != ""))
    return F.when(is_comparison(own), out).otherwise(F.array().cast("array<string>"))


def structural_expansions(q: Column) -> Column:
    articles = F.flatten(F.transform(article_numbers(q), lambda n: F.array(F.concat(F.lit("مادة "), n), F.concat(F.lit("( مادة"), n))))
    return F.concat(articles, F.transform(chapter_labels(q), lambda c: F.concat(F.lit("الفصل "), c)))


def expansions(q: Column) -> Column:
    """All derived questions, trimmed, each once, without the question itself."""
    every = F.transform(F.concat(section_expansions(q), comparison_expansions(q), structural_expansions(q)), strip)
    return F.filter(F.array_distinct(every), lambda x: (x != "") & (x != strip(q)))


def cites_article(text: Column, number: Column) -> Column:
    """Whether a text cites the article of this number; white space doesn't count."""
    packed = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")
    return F.regexp_like(packed, F.concat(F.lit(f"(?iU){P.ARTICLE_AR}\\(?"), number, F.lit(r"\b")))


def cited_articles(text: Column) -> Column:
    return F.array_distinct(_all(F.coalesce(text, F.lit("")), P.ARTICLE_CITED))


def cites_chapter(text: Column, label: Column) -> Column:
    quoted = F.concat(F.lit(r"\Q"), label, F.lit(r"\E\b"))
    return F.regexp_like(F.coalesce(text, F.lit("")), F.concat(F.lit(r"(?iU)(?:الفصل|الباب|القسم|chapter|section|part)\s+"), quoted))


def starts_other_article(text: Column, number: Column) -> Column:
    first = F.get(cited_articles(F.substring(strip(text), 1, 220)), 0)
    return F.coalesce(first != number, F.lit(False))


def starts_other_chapter(text: Column, label: Column) -> Column:
    return F.exists(_all(F.substring(strip(text), 1, 220), P.CHAPTER_HEADER), lambda c: (strip(c) != "") & (strip(c) != label))


def structural_boost(text: Column, q: Column) -> Column:
    """What a text gains for citing the articles and chapters asked for, and loses for beginning
    with other articles."""

    def of_article(n: Column) -> Column:
        other = F.coalesce(F.get(cited_articles(text), 0) != n, F.lit(False))
        return F.when(cites_article(text, n), 0.35).when(other, -0.2).otherwise(0.0)

    articles = F.aggregate(F.transform(article_numbers(q), of_article), F.lit(0.0), lambda s, x: s + x)
    chapters = F.aggregate(F.transform(chapter_labels(q), lambda c: F.when(cites_chapter(text, c), 0.25).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    return articles + chapters
