"""Cleaning, folding and parsing of text columns: Column in, Column out.

Everything here stays in the JVM. Entities of HTML 4 and numeric ones are unescaped here; letters of
Latin, Greek and Cyrillic lose their marks by a translation table that follows from the Unicode
database. What a table cannot do, canonical composition, other entities and other scripts, is in
`normal.py`; texts of plain ASCII do not need it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache, reduce
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks a value as absent, as pointing elsewhere, and a title as no work.
PLACEHOLDERS = [
    "", "-", "--", "—", "–", "n/a", "na", "tba", "tbd", "unknown", "none", "unreleased",
    "not known", "see below", "see distribution", "various", "citation needed",
]
CROSS_REFERENCES = ["see below", "see distribution", "see credits", "various", "multiple"]
NON_TITLE_MARKERS = [
    "list of", "category:", "template:", "wikipedia:", "portal:", "help:", "file:", "draft:", "cinema of", "film industry",
]
MONTHS = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
]
NAMESPACES = ["Wikipedia", "Category", "Template", "Help", "File", "Portal", "Special", "Talk", "Draft", "User", "Module", "MediaWiki"]

# The patterns of what cleaning removes.
CITATION = r"(?i)\[\s*(?:\d+|[a-z]|note\s*\d+|citation needed|clarify|sic)\s*\]"
EDIT = r"(?i)\[\s*edit\s*\]|\(\s*edit\s*\)"
EMPTY_BRACKET = r"\[\s*\]"
ISO_PAREN = r"\(\s*\d{4}-\d{2}-\d{2}\s*\)"
SEPARATORS = r"(?i)\s*(?:[\n\r|·•;]|,|\band\b)\s*"
SEPARATES = r"(?i)[\n\r|·•;,]|and"  # what any separator holds
CAPTION = r"(?i)^(?:songs?|scores?|background\s+score|music|bgm|original\s+score|soundtrack|composer|lyrics?)\s*[:\-]?$"
CREDIT = r"(?i)^\s*(?:produced\s+by|production(?:\s+house)?|banner)\s*[:\-]?\s*"
QUALIFIER = r"(?i)\s*\((?:\d{4}\s+)?(?:[A-Za-z]+\s+)?film\)\s*$"
AGGREGATE = r"(?i)(?:^|/)(?:list_of|lists_of)|(?:^|\b)(?:list of|lists of)\b|\b(?:filmography|discography|characters|episodes)\b"
AGGREGATE_TITLE = r"(?i)^(?:list of |lists of )|\b(?:filmography|discography|characters|episodes|awards and nominations)\b"
YEAR_WORD = r"\b(?:19|20)\d{2}\b"

WHITE = r"(?U)\s+"
#: Short texts that cleaning leaves alone: the plainest characters, with single spaces between words.
PLAIN, SHORT = r"\A(?:[\w#.'/]++(?: [\w#.'/]++)*+)?\z", 200
WORDS = r"\A\w++(?: \w++)*+\z"
MARKED = r"[^\x00-\x7F]"


def replaced(c: Column, *pairs: tuple[str, str]) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, p[0], p[1]), pairs, c)


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c computed once, however often f names it; otherwise each nested step would multiply the plan."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def unless_plain(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), or c itself where it is PLAIN, as most names and labels are; f must leave those alone."""
    return bound(c, lambda x: F.when((F.octet_length(x) <= SHORT) & x.rlike(PLAIN), x).otherwise(f(x)))


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, WHITE, " "))


def stripped(c: Column, characters: str) -> Column:
    """c without any of the characters at its ends."""
    return F.btrim(c, F.lit(characters))


#: What a strip without arguments takes off: every white space.
SPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def trimmed(c: Column) -> Column:
    return stripped(c, SPACE)


@cache
def _entities() -> str:
    """Names and characters, the common ones first, as a map is searched from its start."""
    common = ["amp", "nbsp", "lt", "gt", "quot", "apos"]
    codes = name2codepoint | {"apos": 39}
    return ",".join(f"{name}:{chr(codes[name])}" for name in [*common, *sorted(codes.keys() - set(common))]).replace("'", "\\'")


def unescaped(c: Column) -> Column:
    """c with numeric entities and those of HTML 4 read, each closed by a semicolon."""
    named = F.expr(f"str_to_map('{_entities()}', ',', ':')")

    def numbered(name: Column) -> Column:
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substr(name, F.lit(3)), 16, 10)).otherwise(F.substr(name, F.lit(2))).try_cast("int")
        sound = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.when(sound, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).when(code.isNotNull(), "\ufffd")

    def read(x: Column, i: Column) -> Column:
        name = F.regexp_extract(x, r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        spelled = bound(name, lambda n: F.concat(F.when(n.startswith("#"), numbered(n)).otherwise(F.try_element_at(named, n)), F.substr(x, F.length(n) + 2)))
        return F.when(i == 0, x).otherwise(F.coalesce(spelled, F.concat(F.lit("&"), x)))

    return bound(c, lambda x: F.when(x.contains("&"), F.array_join(F.transform(F.split(x, "&"), read), "")).otherwise(x))


@cache
def _marks() -> tuple[str, str]:
    """Letters with marks and what they are without; marks by themselves stand last and have no partner."""
    pairs = []
    for code in [*range(0xA0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        plain = "".join(ch for ch in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(ch))
        if len(plain) == 1 and plain != chr(code):
            pairs.append((chr(code), plain))
    loose = "".join(chr(code) for code in range(0x300, 0x370) if unicodedata.combining(chr(code)))
    return "".join(a for a, _ in pairs) + loose, "".join(b for _, b in pairs)


def bare(c: Column) -> Column:
    """c without the marks of Latin, Greek and Cyrillic letters."""
    return bound(c, lambda x: F.when(x.rlike(MARKED), F.translate(x, *_marks())).otherwise(x))


def clean_text(c: Column) -> Column:
    """C1. Null gives the empty string."""
    return unless_plain(F.coalesce(c, F.lit("")), lambda x: cleaned(unescaped(x)))


def cleaned(c: Column) -> Column:
    """C1 of a text whose entities are read."""
    text = F.translate(F.coalesce(c, F.lit("")), "\u00a0\u200b\u200e", " ")
    text = replaced(text, (CITATION, " "), (EDIT, " "), (EMPTY_BRACKET, " "), (ISO_PAREN, " "))
    return F.trim(stripped(squeezed(text), " ,;|·•–—-"))


def is_placeholder(c: Column) -> Column:
    """C2."""
    return bound(stripped(F.lower(clean_text(c)), " ."), lambda text: text.isin(PLACEHOLDERS) | ~text.rlike(r"[\p{L}\p{N}]"))


def is_cross_reference(c: Column) -> Column:
    """C3."""
    return F.coalesce(stripped(F.lower(clean_text(c)), " .").isin(CROSS_REFERENCES), F.lit(False))


def clean_name(c: Column) -> Column:
    """C4."""

    def named(x: Column) -> Column:
        text = F.trim(F.regexp_replace(clean_text(x), r"\s*\([^)]*\)\s*$", ""))
        text = F.regexp_replace(text, r"(?i)\s+[-–—]\s+(?:as|guest|cameo|special appearance).*$", "")
        return F.trim(stripped(F.trim(F.ltrim(text, F.lit("*•-–— "))), " ,;|"))

    return unless_plain(F.coalesce(c, F.lit("")), named)


def split_values(c: Column) -> Column:
    """Array of cleaned values; separators act before white space is squeezed."""
    text = unless_plain(F.coalesce(c, F.lit("")), lambda x: replaced(F.translate(unescaped(x), "\u00a0", " "), (CITATION, " "), (EDIT, " ")))
    parts = bound(text, lambda x: F.when(x.rlike(SEPARATES), F.split(x, SEPARATORS)).otherwise(F.array(x)))
    return F.filter(F.transform(parts, clean_name), lambda x: (x != "") & ~is_placeholder(x))


def split_camel_run(c: Column) -> Column:
    """C6."""
    text = clean_text(c)
    parts = F.filter(F.transform(F.split(text, "(?<=[a-z])(?=[A-Z])"), lambda x: F.trim(x)), lambda x: x != "")
    return parts


def key(c: Column) -> Column:
    """A comparison key of Latin letters and digits."""
    return F.trim(F.regexp_replace(bare(F.lower(clean_text(c))), "[^a-z0-9]+", " "))


def label_key(c: Column) -> Column:
    """C9; words with single spaces between them, as most labels are, only lose their capitals."""
    whole = lambda x: squeezed(stripped(F.translate(F.lower(clean_text(x)), ":", " "), " ."))
    return bound(c, lambda x: F.when(x.rlike(WORDS), F.lower(x)).otherwise(whole(x)))


def display_title(c: Column) -> Column:
    """C10."""
    return F.trim(F.regexp_replace(clean_text(c), QUALIFIER, ""))


def name_key(c: Column) -> Column:
    """Case, marks, punctuation and spacing do not count, all scripts stay."""

    def folded(x: Column) -> Column:
        return F.regexp_replace(F.translate(bare(F.lower(trimmed(x))), "'’", ""), r"(?U)[^\p{L}\p{N}]+", " ")

    plain = lambda x: F.regexp_replace(F.translate(F.lower(x), "'", ""), "[^a-z0-9]+", " ")
    return F.trim(bound(F.coalesce(c, F.lit("")), lambda x: F.when(x.rlike(MARKED), folded(x)).otherwise(plain(x))))


def search_key(c: Column) -> Column:
    """C11: as C12, with "&" read as "and"."""
    return name_key(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit(" and ")))


def ordered_distinct(values: Column, keys: Column) -> Column:
    """The values whose key stands at no earlier place."""
    # An array of one holds both lists while they are compared, so that neither is computed again for each value.
    both = F.array(F.arrays_zip(values.alias("v"), keys.alias("k")))
    first = lambda a: F.filter(a, lambda x, i: F.array_position(a["k"], x["k"]) == i + 1)
    return F.get(F.transform(both, lambda a: F.transform(first(a), lambda x: x["v"])), F.lit(0))


def dedupe_names(values: Column) -> Column:
    """C7 over cleaned names, placeholders dropped."""
    cleaned = F.filter(F.transform(values, clean_name), lambda x: (x != "") & ~is_placeholder(x))
    return bound(cleaned, lambda v: F.when(F.size(v) == 1, v).otherwise(ordered_distinct(v, F.transform(v, key))))


def multi_values(c: Column) -> Column:
    """S3: a pipe string as trimmed, non-empty values, each once whatever its case."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), trimmed), lambda x: x != "")
    return ordered_distinct(parts, F.transform(parts, F.lower))


def plain_values(c: Column) -> Column:
    """As S3, repeats kept."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), trimmed), lambda x: x != "")


def parse_year(c: Column, above: int = 1900, below: int = 2100) -> Column:
    """Whole numbers strictly between the bounds."""
    text = trimmed(c.cast("string"))
    year = F.when(text.rlike(r"^[+-]?[0-9]{1,9}$"), text.try_cast("int"))
    return F.when((year > above) & (year < below), year)


def title_to_url(title: Column, base: str) -> Column:
    """C14: spaces become underscores; what may stand in a path is not escaped."""
    slug = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for escaped, char in (("%3A", ":"), ("%2F", "/"), ("%28", "("), ("%29", ")"), ("%27", "'"), ("%2C", ","), ("%21", "!"), ("%26", "&"), ("%24", "$"), ("%7E", "~"), ("*", "%2A")):
        slug = F.replace(slug, F.lit(escaped), F.lit(char))
    return F.concat(F.lit(base), slug)


def url_to_title(url: Column) -> Column:
    """C14, the way back; a plus sign stands for itself."""
    path = F.regexp_replace(F.regexp_replace(url, "^[a-z]+://[^/]*", ""), "[?#].*$", "")
    slug = F.when(path.contains("/wiki/"), F.regexp_extract(path, "(?s)^.*/wiki/(.*)$", 1)).otherwise(F.ltrim(path, F.lit("/")))
    return F.replace(F.try_url_decode(F.replace(slug, F.lit("+"), F.lit("%2B"))), F.lit("_"), F.lit(" "))


def is_article_url(url: Column, host: str = "https://en.wikipedia.org") -> Column:
    """An article below host/wiki/, real namespaces excepted."""
    text = F.trim(F.coalesce(url, F.lit("")))
    slug = F.regexp_replace(text, "^.*?/wiki/", "")
    return text.rlike(rf"^\Q{host}\E/wiki/\S+$") & ~slug.rlike(rf"(?i)^(?:{'|'.join(NAMESPACES)})_?:")


def is_non_work(title: Column) -> Column:
    """C16."""
    marked = lambda text: reduce(lambda a, b: a | b, [text.contains(m) for m in NON_TITLE_MARKERS])
    return bound(F.trim(F.lower(F.coalesce(title, F.lit("")))), lambda text: (text == "") | marked(text) | text.isin(MONTHS) | text.rlike(r"^(?:19|20)\d{2}$"))


def is_month_or_day(c: Column) -> Column:
    """Blank, a number, or a month's name or its beginning, however spaced."""
    months = lambda text: reduce(lambda a, b: a | b, [text.startswith(m[:3]) & (F.length(text) <= len(m)) for m in MONTHS])
    return bound(F.lower(F.regexp_replace(c, WHITE, "")), lambda text: (text == "") | text.rlike("^[0-9]+$") | months(text))


def strip_credit(c: Column) -> Column:
    """C17."""
    text = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), CREDIT, ""))
    return bound(text, lambda x: F.when(is_placeholder(x), "").otherwise(x))


def drop_captions(values: Column) -> Column:
    """C18."""
    return F.filter(values, lambda x: ~F.trim(x).rlike(CAPTION))


def iso_date(c: Column) -> Column:
    """The first ISO date, or the empty string."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"\d{4}-\d{2}-\d{2}", 0)


def year_in(c: Column) -> Column:
    """The first year from 1900 to 2099 that stands as a word, or null."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), YEAR_WORD, 0).try_cast("int")


def query_parts(query: Column) -> Column:
    """C20: struct<text, year>: a year filters, unless nothing else is left."""
    rest = search_key(F.regexp_replace(query, YEAR_WORD, ""))
    year = year_in(query)
    used = year.isNotNull() & (rest != "")
    return F.struct(F.when(used, rest).otherwise(search_key(query)).alias("text"), F.when(used, year).alias("year"))


def is_aggregate(name: Column, url: Column) -> Column:
    """V2: a list or index page, by its name or its address."""
    slug = F.regexp_replace(F.coalesce(url, F.lit("")), "^.*?/wiki/", "")
    return F.coalesce(name, F.lit("")).rlike(AGGREGATE) | slug.rlike(AGGREGATE)


def is_plausible(target: Column, wanted: Column) -> Column:
    """A redirect that still names what was asked for."""
    found, asked = key(display_title(target)), key(display_title(wanted))
    fits = (found == asked) | found.startswith(F.concat(asked, F.lit(" ")))
    return F.coalesce(~target.rlike(AGGREGATE_TITLE) & (found != "") & (asked != "") & fits, F.lit(False))
