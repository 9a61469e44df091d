"""Patterns and words that questions and texts are matched against, English and
Arabic, as regular expressions that Java, RE2 and Python read alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALEF = "[اأإآٱ]"
YA = "[يىi]"
TA = "[ةه]"
WHAT_AR = f"(?:ايه|{ALEF}?يه|اى|{ALEF}?ى)"
ARTICLE_AR = "م[ـ]?ادة"
DIFFERENCE_AR = r"(?:ال?\s*فرق\s+بين|لفرق\s+بين|ما\s+(?:ال?\s*فرق|ال?\s*ف(?:ر|د)ق)\s+بين)"
ORDINAL = (
    "(?:ال)?(?:اول|اولى|أول|أولى|ثاني|ثانية|ثان|ثالث|ثالثة|رابع|رابعة|خامس|خامسة|سادس|سادسة"
    r"|سابع|سابعة|ثامن|ثامنة|تاسع|تاسعة|عاشر|عاشرة|\d+)"
)

DETAIL = [
    r"\b(criteria|rules|procedures|requirements|list|items|steps|conditions|details|features|benefits|components)\b",
    rf"\b(معايير|قواعد|{ALEF}?جراءات|شروط|فئات|تفاصيل|قائمة|خطوات|مزايا|عناصر)\b",
    r"(ما\s+(?:هي|هى)|اذكر|عدد|list|enumerate)",
    rf"(?:^|\s)(?:ايه|{ALEF}?يه|اى|{ALEF}?ى|قول{YA}|قولى|how|what|why)\s",
]
COMPARISON = [r"\bdifference\s+between\b", r"\bcompare\b", r"\bvs\.?\b", DIFFERENCE_AR]
NARROW = [
    r"\b(what\s+type|what\s+kind|when|which\s+table|which\s+section|formula|how\s+much|how\s+many)\b",
    r"(?:نوع|نوعها|امتى|إمتى|متى|موعد|جدول\s+ك(?:ام|م)|في\s+(?:جدول|بند|مادة)|معاد(?:لة|له)|كم\s|أ(?:ي|ى)\s+(?:جدول|مادة|بند))",
    rf"(?:^|\s){WHAT_AR}\s*(?:نوع|موعد|جدول|معاد)",
    rf"نوع(?:ها|ه)?\s*{WHAT_AR}",
]
EXHAUSTIVE = [
    r"(?:اذكر|عدد|list|enumerate)\s+(?:كل\s+)?(?:شروط|بنود|عناصر|items|conditions|requirements)",
    rf"(?:كل\s+)?(?:شروط|بنود|عناصر)\s+(?:ال?\s*{ARTICLE_AR}|article)",
    r"\b(?:all|every)\b.*\b(?:conditions|requirements|items|criteria)\b",
]
# Arabic words beside a digit aren't listed: the digit is enough.
SPECIFIC = [
    r"\d",
    r"\b(section|chapter|paragraph|part|step|item|appendix|table|figure|clause|schedule)\b",
    r"\b(قسم|فصل|فقرة|بند|ملحق|جدول|خطوة)\b",
    r"[«»\"'].+?[«»\"']",
]
FOLLOW_UP = [
    r"\b(it|its|that|this|those|these|same|above|mentioned|previous|earlier|there)\b",
    r"(?:^|\s)(?:ده|دي|دا|دول|ه(?:و|ي)|هما|هم)\b|"
    r"(?:ال(?:سابق|مذكور|موض(?:ح|وح)|سابق(?:ة)?)|(?:اللي|الذي)\s+(?:فات|قلت|ذكرت|قصد))",
    r"^(?:و|also|plus|additionally|كمان|أيضاً|además)\s",
]

QUESTION_PREFIX = rf"^(?:ما\s+(?:هي|هى)|{WHAT_AR}\s+(?:هي|هى)|what\s+are\s+the|tell\s+me|how|why)\s+"
CONVERSATION_PREFIX = rf"^(?:قول{YA}|قولى|اذكر|عدد)\s+"
COMPARED_AR = DIFFERENCE_AR + r"\s+(.+?)\s+(?:و|with|and|vs\.?)\s*(.+?)(?:\?|؟|$)"
COMPARED_EN = r"(?:difference\s+between|compare)\s+(.+?)\s+(?:and|with|vs\.?)\s*(.+?)(?:\?|$)"

ARTICLE_CITED = rf"(?:\(\s*)?{ARTICLE_AR}\s*\(?\s*(\d+)"
ARTICLE_ASKED = rf"(?:ال?\s*{ARTICLE_AR}|article)\s*(?:رقم\s*)?\(?\s*(\d+)"
ARTICLE_ASKED_EN = r"\barticle\s+(\d+)\b"
CHAPTER_HEADER = rf"(?:الفصل|الباب|القسم)\s+({ORDINAL})"
CHAPTER_ASKED = rf"(?:ال?\s*(?:فصل|باب|قسم)|chapter|section|part)\s+(?:رقم\s+)?({ORDINAL})"
BOUNDARY = rf"(?:(?:الفصل|الباب|القسم)\s+{ORDINAL}\b|(?:chapter|section|part|article)\s+\d+\b|(?:\(\s*)?{ARTICLE_AR}\s*\(?\s*\d+)"

HEADER_TAIL = (
    rf"(?:{ALEF}?و?ولا|ثان(?:يا|ية)|ثالث(?:{ALEF}|{TA})|رابع(?:{ALEF}|{TA})|خامس(?:{ALEF}|{TA})"
    r"|first|second|third|fourth|fifth|\d+[\-\.\)])\s*:[^\n]*\s*$"
)
STEP_TAIL = r"step\s+\d+\s*:"
ITEM_TAIL = r"(?:^|\s)\d+[\.\)]\s+[^:]+:\s*$"
ORDINAL_AR = "(?:اولا|ثانيا|ثالثا|رابعا|خامس)"
ORDINAL_EN = r"\b(?:first|second|third|fourth|fifth)\b"

#: Fixed values, in their order: what is replaced in text from pages, and by what.
ARABIC = "\u0600-\u06ff\u0750-\u077f"
CLEANING = (
    (r"\r\n?", "\n"),
    (r"(?mU)^\s*\d{1,3}\s*$", ""),
    (rf"(?<=[{ARABIC}A-Za-z0-9])[\r\n]+(?=[{ARABIC}A-Za-z0-9])", " "),
    (rf"(?U)(?<=\s[{ARABIC}]) (?=[{ARABIC}]{{1,3}}(?:\s|$|[،.:\)]))", ""),
    (r"(?U)(?<=\s[A-Za-z]) (?=[A-Za-z]{1,3}(?:\s|$|[,.:;)]))", ""),
    (r"\n{3,}", "\n\n"),
    (r"(?U)[^\S\n]+", " "),
)

CLARIFICATION = "CLARIFICATION_NEEDED"

#: Letters that recognition of Arabic print confuses with Latin ones, and digits, with what they become.
CONFUSED = ("iIoOaAeErR", "ييووااههرر")
DIGITS = ("۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "01234567890123456789")
UNIFIED = ("أإآٱىة", "اااايه")
DIACRITICS = "[\u0610-\u061a\u064b-\u065f\u0670\u0640]"


def any_of(text: Column, patterns: list[str]) -> Column:
    """Whether any pattern is found, letter case aside."""
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(f"(?iU){p}")
    return F.coalesce(out, F.lit(False))


def any_of_sql(text: str, patterns: list[str]) -> str:
    """The same for DuckDB."""
    quoted = [p.replace("'", "''") for p in patterns]
    return "(" + " OR ".join(f"regexp_matches({text}, '(?i){p}')" for p in quoted) + ")"
