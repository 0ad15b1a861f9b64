"""Sentence units of documents by cascading tables of break and no-break rules.

A rule is a pair of regular expressions, one for what stands before a place
and one for what follows it, and says whether a sentence ends there. At each
place that could end one (after terminal marks with their closing marks, or at
a blank between Thai words) the rules are tried in order, and the first that
matches decides. The order is: the table of the document's language, those of
the other languages, then the table common to all; so a wrong or missing
language costs little. Lines never share a unit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Classes of marks.
BLANK = r"[\s\u00ad\u200b\u2060\ufeff]"
CLOSING = r"[\"'”’»“‘›)\]}）」』】》〉］｣]"
CLOSERS = rf"{CLOSING}*(?:«(?!\w)|[ \u00a0\u202f]»(?!\w))?"
OPENING = r"[\"'“‘«»„‚‹(\[{（「『【《〈［｢¿¡–—-]"
FULL_STOPS = "。！？｡"
OTHER_STOPS = "।॥።፧؟។៕။"
LINE_BREAKS = r"\r\n|[\n\r\v\f\u0085\u2028\u2029]"


class Rule(NamedTuple):
    """Whether a sentence ends at a place with ``before`` on its left and ``after`` on its right."""

    breaks: bool
    before: str
    after: str = ""


def never_after(*abbreviations: str, then: str = "") -> Rule:
    """No sentence ends after one of these abbreviations, written without their last period."""
    return Rule(False, rf"(?<![\p{{L}}\p{{M}}\p{{N}}])(?:{'|'.join(abbreviations)})\.", then)


#: What follows an abbreviation that is a word as well (art, cap, fig): a number, Roman ones included, or a single letter.
NUMBER = rf"{BLANK}*[(\[]?(?:\p{{N}}|[IVXLC]+\b|\p{{Lu}}\b|\p{{Ll}}\b)"

#: Abbreviations that need a continuation, and speech tags of scripts without capitals.
TABLES: dict[str, list[Rule]] = {
    "en": [
        never_after("Mr", "Mrs", "Ms", "Dr", "Prof", "St", "Gen", "Capt", "Lt", "Sgt", "Col", "Maj", "Rev", "Hon", "Gov", "Sen", "Rep", "Mt", "Messrs"),
        never_after(r"e\.\s?g", r"i\.\s?e", "cf", "vs", "viz", "approx", "esp", "incl", "resp", r"et\s+al"),
        never_after("Sec", "sec", "Fig", "fig", "Figs", "figs", "Eq", "eq", "Ch", "ch", "vol", "Vol", "pp", "ed", "eds", "apt", "Apt", "No", "Nos", "p", "no", "Art", "Rm", "Ste", then=NUMBER),
        never_after("Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sept", "Sep", "Oct", "Nov", "Dec", then=rf"{BLANK}*\p{{N}}"),
        never_after("Jr", "Sr", then=rf"{BLANK}+(?!(?:He|She|It|They|The|A|An|This|That|These|We|I|You|In|On|At|But|And|His|Her|When|There)\b)\p{{Lu}}"),
    ],
    "de": [
        never_after("Hr", "Fr", "Dr", "Prof", "St", "Nr", "Hrsg", "bzw", "ca", "vgl", "inkl", "evtl", "ggf", "sog", "geb", "gest", "bspw", "zzgl", "Mio", "Mrd"),
        never_after("Bd", "Abb", "Abs", "Art", "Str", "Tel", "Kap", "Jan", "Febr", "Aug", "Sept", "Okt", "Nov", "Dez", then=NUMBER),
        never_after(r"z\.\s?B", r"z\.\s?T", r"d\.\s?h", r"u\.\s?a", r"u\.\s?U", r"i\.\s?d\.\s?R", r"o\.\s?ä", r"v\.\s?a", r"s\.\s?o"),
        never_after("z", "d", "u", "i", "o", "v", "s", then=rf"{BLANK}+(?:B|T|h|a|U|d|R|ä|o)\."),
        Rule(False, r"(?<!\w)(?:[Aa]m|[Vv]om|[Zz]um|[Bb]eim|[Aa]b|[Bb]is|[Ss]eit|[Dd]er|[Dd]en|[Dd]em|[Ii]m)\s\d{1,2}\.", rf"{BLANK}+\p{{Lu}}"),
        Rule(False, r"(?<!\w)\d{1,2}\.", rf"{BLANK}+(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\b"),
    ],
    "fr": [
        never_after("MM", "Mme", "Mmes", "Mlle", "Mgr", "Me", "Dr", "Pr", "St", "Ste", "env", "cf", r"p\.\s?ex", r"c\.-\S{1,2}-d", "boul", "tél", "éd"),
        never_after("art", "fig", "vol", "chap", then=NUMBER),
        never_after("av", "apr", then=rf"{BLANK}+J\.-C"),
        never_after("p", then=rf"{BLANK}+(?:ex\.|\p{{N}})"),
    ],
    "es": [
        never_after("Sr", "Sra", "Srta", "Sres", "Dr", "Dra", "Ing", "Lic", "Prof", "Dña", "Ud", "Uds", "Vd", "Avda", r"p\.\s?ej", "cf", "aprox"),
        never_after("núm", "pág", "págs", "art", "fig", "vol", "cap", then=NUMBER),
        never_after("EE", then=rf"{BLANK}*UU\."),
        never_after("p", then=rf"{BLANK}+(?:ej\.|\p{{N}})"),
    ],
    "ru": [
        Rule(True, r"(?<!\p{L})т\.\s?[дп]\.", rf"{BLANK}+{OPENING}*\p{{Lu}}"),
        never_after("проф", "акад", "ул", "им", "св", "напр", "см", "ср", "гл", "стр", "рис", "ок", "тов", "гр", "просп", "пер", "пл", "обл", r"т\.\s?е", r"т\.\s?к", r"т\.\s?н"),
        never_after("г", "д", "т", "с", "п", then=rf"{BLANK}+(?:\p{{Lu}}|\p{{N}}|[дпекн]\.)"),
    ],
    "el": [
        never_after("κ", "κα", "κκ", "Δρ", "Καθ", "αρ", "σελ", "δηλ", "βλ", "πρβλ", "εικ", "κεφ", r"π\.\s?χ", r"λ\.\s?χ", r"π\.\s?Χ", r"μ\.\s?Χ"),
        Rule(True, rf"\p{{Greek}}\p{{M}}*[»”\"’)]?[;;]{CLOSING}*", rf"(?:{BLANK}+{OPENING}*[^\p{{Ll}}\s]|{BLANK}*$)"),
    ],
    "hi": [
        Rule(False, r"\p{Devanagari}\."),
        Rule(False, rf"[?!।]{CLOSING}+", rf"{BLANK}*(?:उसने|उन्होंने|उन्होने)\s+\p{{L}}[\p{{L}}\p{{M}}]*\s*[।,]"),
    ],
    "ar": [
        never_after("ص", "د", "أ", "م", "ج", "ط", "ت", "هـ", "ق"),
        Rule(False, rf"[.?!؟]{CLOSING}+", rf"{BLANK}*(?:و|ف)?(?:قال|قالت|سأل|سألت|كتب|كتبت|أجاب|أجابت|صاح)\b"),
    ],
    "am": [
        Rule(False, r"\p{Ethiopic}\."),
        Rule(False, rf"[?!።፧]{CLOSING}+", rf"{BLANK}*(?:አለ|አለች|አሉ|ጠየቀ|ጠየቀች|ጻፈ|ጻፈች)\b"),
    ],
    "zh": [Rule(False, rf"[{FULL_STOPS}?!]{CLOSING}+", r"(?:他|她|他们|她们|我)(?:说|问|道|答|喊|写)(?:道)?[。，,.]")],
    "ja": [Rule(False, rf"[{FULL_STOPS}?!…]*{CLOSING}+", rf"{BLANK}*(?:と|って)(?!{BLANK})")],
    "th": [
        Rule(False, r"ๆ", BLANK),
        Rule(True, r"\p{Thai}", rf"{BLANK}+\p{{Thai}}"),
    ],
}

#: The table that closes every cascade.
COMMON: list[Rule] = [
    Rule(False, r"^\s*[(\[]?(?:\p{N}{1,3}|\p{L})[.)]+"),
    Rule(False, rf"(?:\.\.+|…)[.…]*{CLOSERS}", rf"(?!{BLANK}*{OPENING}*{BLANK}?\p{{Lu}})"),
    Rule(True, rf"[{FULL_STOPS}]{CLOSING}*"),
    Rule(False, r"(?<![\p{L}\p{M}\p{N}])(?:\p{Lu}\.[-\s]?)*\p{Lu}\."),
    Rule(False, "", rf"{BLANK}*{OPENING}*{BLANK}?\p{{Ll}}"),
    Rule(False, "", rf"{BLANK}*[,;:،؛、，；：]"),
    Rule(True, rf"[{OTHER_STOPS}]{CLOSING}*"),
    Rule(True, rf"[.!?…]{CLOSERS}", rf"{BLANK}*\s"),
    Rule(True, r"\p{Ll}\p{L}[.!?]", r"\p{Lu}[\p{L}\s]"),
    Rule(True, rf"[.!?…]{CLOSING}+", rf"{OPENING}*\p{{Lu}}"),
    Rule(True, r"\p{Arabic}{2}\.", r"\p{Arabic}"),
]

#: Places where a sentence may end: after these marks.
_PLACES = regex.compile(rf"[.!?…{FULL_STOPS}{OTHER_STOPS}]+{CLOSERS}|(?<=\p{{Greek}}\p{{M}}*[»”\"’)]?)[;;]{CLOSING}*|\p{{Thai}}(?=\s)")
_LINES = regex.compile(rf"(?:(?!{LINE_BREAKS}).)+", regex.DOTALL)


@lru_cache(maxsize=64)
def cascade(language: str) -> tuple[regex.Pattern, tuple[bool, ...]]:
    """The rules in order for a language, as one alternation, and what each decides."""
    order = ([language] if language in TABLES else []) + [name for name in TABLES if name != language]
    rules = [rule for name in order for rule in TABLES[name]] + COMMON
    parts = [(f"(?<={r.before})" if r.before else "") + (f"(?={r.after})" if r.after and not r.after.startswith("(?!") else r.after) + "()" for r in rules]
    return regex.compile("|".join(parts)), tuple(r.breaks for r in rules)


def language_of(tag: str | None) -> str:
    """The language part of a tag such as ``en-GB`` or ``ZH``; empty for null."""
    return regex.split(r"[-_]", tag.strip().lower())[0] if tag else ""


def units(text: str | None, tag: str | None = None) -> list[tuple[int, int]]:
    """Start and end, in characters, of each sentence unit of ``text``."""
    if not text:
        return []
    deciding, decision = cascade(language_of(tag))
    found = []
    for line in _LINES.finditer(text):
        first, whole = line.start(), line.group()
        begin = 0
        for place in _PLACES.finditer(whole):
            at = place.end()
            rule = deciding.match(whole, at)
            if rule is not None and decision[rule.lastindex - 1]:
                add_unit(found, whole, begin, at, first)
                begin = at
        add_unit(found, whole, begin, len(whole), first)
    return found


def add_unit(found: list[tuple[int, int]], line: str, begin: int, end: int, offset: int) -> None:
    """Append the part of the line without the blanks around it, unless nothing is left."""
    part = line[begin:end]
    bare = part.strip()
    if bare:
        start = begin + len(part) - len(part.lstrip())
        found.append((offset + start, offset + start + len(bare)))


def unit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [units(text, tag) for text, tag in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
        places = np.array([p for f in found for p in f], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(owner)), pa.array(places[:, 0]), pa.array(places[:, 1])], names=["key", "start_char", "end_char"]
        )


def sentence_units(documents: DataFrame, key: str, text: str, language: str | None = None) -> DataFrame:
    """``key, start_char, end_char``: the sentence units of every row, whole texts, no shuffle.

    Places count Unicode characters from 0. Null, empty and blank texts have no
    unit; a null or unknown language is no error. Rows with one key each give
    their own units; other columns are ignored.
    """
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.selectExpr(f"`{key}` AS key", f"`{text}` AS text", f"`{language}` AS language" if language else "CAST(NULL AS STRING) AS language")
    return rows.mapInArrow(unit_batches, f"key {kind}, start_char long, end_char long").withColumnRenamed("key", key)
