"""Scalar functions of texts and chunk metadata, as columns."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import patterns as P


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def strip(text: Column) -> Column:
    """Without white space at either end; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def match_form(text: Column, *, compose: bool = True) -> Column:
    """The form in which terms and texts are compared: compatibility characters resolved (unless
    they are known to be), diacritics removed, digits, confused letters and letter variants made
    one, marks turned into spaces, in lower case."""
    out = F.coalesce(text, F.lit(""))
    out = nfkc(out) if compose else out
    out = F.regexp_replace(out, P.DIACRITICS, "")
    for old, new in (P.DIGITS, P.CONFUSED, P.UNIFIED):
        out = F.translate(out, old, new)
    out = F.regexp_replace(out, r"(?U)[^\w\s]", " ")
    return F.lower(strip(F.regexp_replace(out, r"(?U)\s+", " ")))


def query_terms(text: Column) -> Column:
    """Distinct words of three letters or more, numbers of up to four digits, quoted phrases."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(F.regexp_replace(text, "(?U)[^\\w\\s\u0600-\u06ff\u0750-\u077f]", " "), r"(?U)\s+"), lambda w: F.length(w) >= 3)
    numbers = F.regexp_extract_all(text, F.lit(r"(?U)\b(\d{1,4})\b"), F.lit(1))
    phrases = F.transform(F.regexp_extract_all(text, F.lit("[«\"']([^»\"']{4,})[»\"']"), F.lit(1)), strip)
    return F.array_distinct(F.concat(words, numbers, F.filter(phrases, lambda p: p != "")))


def recall_terms(query: Column) -> Column:
    """The query's terms as they are compared: in their form, and as they are if of digits."""
    return F.transform(query_terms(query), lambda x: F.struct(match_form(x, compose=False).alias("form"), F.when(x.rlike(r"^\d+$"), x).alias("digits")))


def recall_of(text: Column, terms: Column, *, compose: bool = True) -> Column:
    """lexical_recall() for ``recall_terms`` that are there already, so that a long query's are made
    once, not for each text."""
    form = F.array(match_form(text, compose=compose))
    held = F.transform(form, lambda t: F.size(F.filter(terms, lambda x: F.contains(t, x["form"]) | F.coalesce(F.contains(text, x["digits"]), F.lit(False)))))
    share = F.element_at(held, 1) / F.size(terms)
    return F.when((F.size(terms) > 0) & (F.length(F.coalesce(text, F.lit(""))) > 0), share).otherwise(0.0)


def lexical_recall(text: Column, query: Column, *, compose: bool = True) -> Column:
    """The share of the query's terms that the text holds, in the form for comparisons; a term of
    digits may also stand in the text as it is."""
    terms = query_terms(query)
    form = F.array(match_form(text, compose=compose))
    held = F.transform(form, lambda t: F.size(F.filter(terms, lambda x: F.contains(t, match_form(x, compose=False)) | (x.rlike(r"^\d+$") & F.contains(text, x)))))
    share = F.element_at(held, 1) / F.size(terms)
    return F.when((F.size(terms) > 0) & (F.length(F.coalesce(text, F.lit(""))) > 0), share).otherwise(0.0)


def clean_extracted(text: Column) -> Column:
    """Text from pages without lone page numbers, hard line breaks, split words and blank lines."""
    out = nfc(F.coalesce(text, F.lit("")))
    for pattern, new in P.CLEANING:
        out = F.regexp_replace(out, pattern, new)
    lines = F.filter(F.transform(F.split(out, "\n"), strip), lambda line: line != "")
    return strip(F.array_join(lines, "\n"))


def numbered_segments(text: Column) -> Column:
    """The items of a text that numbers them, ``1. ...``; a text with fewer than two is whole."""
    own = strip(text)
    parts = F.split(own, r"(?U)(?:^|\s)\d+\.\s+")
    numbers = F.regexp_extract_all(own, F.lit(r"(?U)(?:^|\s)(\d+)\.\s+"), F.lit(1))
    bodies = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), strip)
    items = F.filter(F.zip_with(numbers, bodies, lambda n, b: F.when(b != "", F.concat(n, F.lit(". "), b))), lambda s: s.isNotNull())
    whole = F.when(own == "", F.array().cast("array<string>")).otherwise(F.array(own))
    return F.when(F.size(items) >= 2, items).otherwise(whole)


def focused(text: Column, query: Column, *, compose: bool = True) -> Column:
    """The numbered item that holds most of the query's terms, if that is a quarter of them and
    three quarters of what the whole text holds; else the text. The first of equals is taken."""
    items = numbered_segments(text)
    scored = F.transform(items, lambda s, i: F.struct(lexical_recall(s, query, compose=False).alias("score"), (-i).alias("at"), s.alias("item")))
    best = F.array_max(scored)
    enough = best["score"] >= F.greatest(F.lit(0.25), lexical_recall(text, query, compose=compose) * 0.75)
    return F.when((F.size(items) > 1) & enough, best["item"]).otherwise(F.coalesce(text, F.lit("")))


def human_file_name(name: Column) -> Column:
    """The last part of a path, without a prefix of up to 16 letters and digits before ``_``."""
    base = F.element_at(F.split(F.regexp_replace(name, r"\\", "/"), "/"), -1)
    rest = F.regexp_extract(base, r"(?sU)^[\p{L}\p{N}]{1,16}_(.+)$", 1)
    return F.when(rest != "", rest).otherwise(base)


def source_label(file_name: Column, page: Column, lang: Column) -> Column:
    """``name — page n``; a page 0 or none is left out, and without both it says so."""
    arabic = F.lower(lang).startswith("ar")
    number = F.try_to_number(page.cast("string"), F.lit("9999999999")).cast("long")
    word = F.when(arabic, "صفحة").otherwise("page")
    numbered = F.when(F.coalesce(number, F.lit(0)) != 0, F.concat(word, F.lit(" "), number.cast("string")))
    name = human_file_name(F.when(file_name != "", file_name))
    none = F.when(arabic, "مصدر غير معروف").otherwise("unknown source")
    return F.coalesce(F.concat(name, F.lit(" — "), numbered), name, numbered, none)


def clean_file_name(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r"(?U)[^\w.]", "")


def question_language(text: Column, default: str = "en") -> Column:
    return F.when(F.coalesce(text, F.lit("")).rlike("[\u0600-\u06ff]"), "ar").otherwise(default)


def text_language(text: Column) -> Column:
    """ar or en by letter counts; null for texts of under ten characters and for a tie."""
    own = strip(text)
    arabic = F.regexp_count(own, F.lit("[\u0600-\u06ff\u0750-\u077f]"))
    latin = F.regexp_count(own, F.lit("[A-Za-z]"))
    return (
        F.when(F.length(own) < 10, None)
        .when((arabic >= 3) & (arabic >= latin), "ar")
        .when((arabic >= 1) & (latin == 0), "ar")
        .when((latin >= 3) & (latin > arabic), "en")
        .when(arabic > latin, "ar")
    )


def parsed_answer(raw: Column) -> tuple[Column, Column]:
    """A model's reply as its text (null if blank) and whether it asks for clarification."""
    own = strip(raw)
    asks = F.upper(own).startswith(P.CLARIFICATION)
    body = strip(F.regexp_replace(F.substring(own, len(P.CLARIFICATION) + 1, 1 << 30), r"^[ \t:\-\n]+", ""))
    text = F.when(own == "", None).when(asks & (body != ""), body).otherwise(own)
    return text, asks


def cut_then_strip(text: Column, most: int) -> Column:
    return strip(F.substring(text, 1, most))


def strip_then_cut(text: Column, most: int) -> Column:
    return F.substring(strip(text), 1, most)


def tags(text: Column, most: int = 5) -> Column:
    """The first tags of a comma-separated list, trimmed, empty ones left out."""
    return F.slice(F.filter(F.transform(F.split(text, ","), strip), lambda t: t != ""), 1, most)


#: What a file is tagged with where no model could say; own wording.
FALLBACK_TAGS = ("document", "text", "untagged")


def tags_or_fallback(text: Column, most: int = 5) -> Column:
    """The same; the fallback tags of a null list."""
    return F.coalesce(tags(text, most), F.array(*[F.lit(t) for t in FALLBACK_TAGS]))


def unique_file_name(name: Column, *of: Column) -> Column:
    """A clean file name behind twelve letters and digits that follow from what it is of."""
    return F.concat(F.substring(F.sha2(F.concat_ws("/", *of), 256), 1, 12), F.lit("_"), clean_file_name(name))


def without_nulls(entries: Column) -> Column:
    """A map without its null values."""
    return F.map_filter(entries, lambda _, v: v.isNotNull())


def merged(left: Column, right: Column) -> Column:
    """Both maps' entries; of a key in both that of the right one."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def recognised_language(pages: Column, stated: Column, default: str, most: int = 5000) -> Column:
    """The language in which a file's pages (their texts in order) are to be recognised: of the
    start of all text, else of the first three pages of which one can be told, else the stated one,
    else the default."""
    sample = F.substring(F.array_join(F.filter(pages, lambda p: p.isNotNull()), "\n"), 1, most)
    each = F.filter(F.transform(F.slice(pages, 1, 3), text_language), lambda x: x.isNotNull())
    return F.coalesce(text_language(sample), F.get(each, 0), F.when(stated.isin("ar", "en"), stated), F.lit(default))


def needs_continuation(text: Column) -> Column:
    """Whether a chunk ends with a header that announces what comes in the next one."""
    own = strip(text)
    tail = P.any_of(own, [P.HEADER_TAIL, P.STEP_TAIL, P.ITEM_TAIL, P.ORDINAL_EN])
    return own.endswith(":") & (tail | match_form(own).rlike(P.ORDINAL_AR))


def chunk_params(length: Column, size: int, overlap: int, least: int = 200, most: int = 1000) -> tuple[Column, Column]:
    """Chunk size and overlap for a text of a length: longer texts have larger chunks. Halves round
    to even."""
    scale = F.when(length <= 600, 0.6).when(length <= 1500, 0.75).when(length <= 4000, 1.0).when(length <= 12000, 1.15).otherwise(1.3)
    own = F.greatest(F.lit(least), F.least(F.lit(most), F.bround(F.lit(size) * scale).cast("int")))
    ratio = F.when(length <= 1500, 0.15).otherwise(0.18)
    over = F.greatest(F.lit(20), F.least(F.bround(own * ratio).cast("int"), F.floor(own / 3).cast("int"), (F.lit(overlap) * scale).cast("int")))
    whole = (length <= least) | (own >= length)
    size_of = F.when(length <= 0, max(1, size)).when(whole, length).otherwise(own).cast("int")
    return size_of, F.when(length <= 0, max(0, overlap)).when(whole, 0).otherwise(over).cast("int")


_BOUNDARY = re.compile(f"(?={P.BOUNDARY})", re.IGNORECASE)


def structural_parts(text: str | None, least: int = 80) -> list[str]:
    """A text cut before its chapter, section and article headers. A part under ``least`` characters
    takes the next one in, unless that begins with a header."""
    own = (text or "").strip()
    if len(own) <= least:
        return [own] if own else []
    cuts = [0, *(m.start() for m in _BOUNDARY.finditer(own) if m.start()), len(own)]
    out: list[str] = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = own[a:b].strip()
        if out and len(out[-1]) < least and not _BOUNDARY.search(part):
            out[-1] += f"\n{part}"
        elif part:
            out.append(part)
    return out if len(out) > 1 else [own]


def recursive_split(text: str, size: int, overlap: int) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the coarsest separator that is there: blank
    line, line, sentence, word, character; each takes over up to ``overlap`` characters of pieces
    from the one before it."""

    def pieces(own: str, separators: tuple[str, ...]) -> list[str]:
        if len(own) <= size:
            return [own]
        sep = next(s for s in separators if s == "" or s in own)
        rest = separators[separators.index(sep) + 1 :]
        if sep == "":
            return [own[i : i + size] for i in range(0, len(own), size)]
        parts = own.split(sep)
        parts = [p + sep for p in parts[:-1]] + [parts[-1]]
        return [q for p in parts if p for q in (pieces(p, rest) if len(p) > size else [p])]

    out: list[str] = []
    held: list[str] = []
    total = 0
    for piece in pieces(text, ("\n\n", "\n", ". ", " ", "")):
        if held and total + len(piece) > size:
            out.append("".join(held).strip())
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.pop(0))
        held.append(piece)
        total += len(piece)
    out.append("".join(held).strip())
    return [x for x in out if x]
