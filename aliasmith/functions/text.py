"""Text normalization, n-grams, encodings and wiki markup as column expressions.

Diacritics are folded by a translation table, one lookup a character inside the JVM, instead of
canonical decomposition in Python. Characters that decompose into more than one base character
(Hangul syllables and a few others) stay composed, on both sides of any comparison alike;
nfd_strip_exact decomposes these too, in a pandas UDF.
"""

from __future__ import annotations

import functools
import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_SPACE = r"[\p{Space}\p{Cntrl}]+"
_PUNCT = r"\p{Punct}+"
_MARKS = r"[\x{300}-\x{36F}\p{Lm}\p{Sk}]+"
#: Letters beyond U+FFFF count as separators, like everything that isn't a letter or decimal digit.
_SEPARATORS = r"[[\P{L}&&\P{Nd}]\x{10000}-\x{10FFFF}]+"
_TOKEN = r"(?:(?![\x{10000}-\x{10FFFF}])[\p{L}\p{Nd}])+"
INTENT_STOPWORDS = ("the", "of", "a", "at", "in")
CENTROID_STOPWORDS = ("of", "the", "in", "at", "on", "for")
SITE_STOPWORDS = ("wiki", "com", "www")


def normalize(c: Column) -> Column:
    """Lower-cased runs of letters and digits with a space between; diacritics stay."""
    return F.trim(F.lower(F.translate(F.regexp_replace(c, _SEPARATORS, " "), "İ", "i")))


def tokens(c: Column) -> Column:
    """Tokens of the normalized text; an empty array if there are none."""
    return F.array_remove(F.split(normalize(c), " "), "")


def normalize_with_spans(c: Column) -> Column:
    """array<struct<text, start, end>>: the tokens and where they lie in the raw text."""
    found = F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(0))
    # what stands between the tokens; a last gap may follow
    gaps = F.split(c, _TOKEN, -1)
    pairs = F.arrays_zip(found.alias("word"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,start:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = (acc["at"] + F.length(x["gap"])).cast("int")
        end = (start + F.length(x["word"])).cast("int")
        span = F.struct(F.lower(F.translate(x["word"], "İ", "i")).alias("text"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(pairs, empty, step, lambda acc: acc["out"])


@functools.cache
def _folding() -> tuple[str, str]:
    """Characters that decompose into one base character and combining diacritical marks, and these bases."""
    out = {}
    for i in range(0x00C0, 0x30000):
        c = chr(i)
        d = unicodedata.normalize("NFD", c)
        if d != c:
            base = [x for x in d if not 0x300 <= ord(x) <= 0x36F]
            if len(base) == 1:
                out[c] = base[0]
    return "".join(out), "".join(out.values())


def strip_marks(c: Column) -> Column:
    """Text without combining diacritical marks, modifier letters and modifier symbols."""
    return F.regexp_replace(F.translate(c, *_folding()), _MARKS, "")


@F.pandas_udf(StringType())
def nfd_strip_exact(s: pd.Series) -> pd.Series:
    """strip_marks by full canonical decomposition (a pandas UDF)."""

    def strip(x: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFD", x) if not (0x300 <= ord(c) <= 0x36F or unicodedata.category(c) in ("Lm", "Sk")))

    return s.map(strip, na_action="ignore")


def fold(c: Column) -> Column:
    """Punctuation and white space to a space, then marks off, lower-cased, trimmed."""
    return F.trim(F.lower(strip_marks(F.regexp_replace(F.regexp_replace(c, _PUNCT, " "), _SPACE, " "))))


def normalize_text(c: Column, fold_marks: bool = True) -> Column:
    """Marks off first, if asked for, then punctuation and white space to a space: ^ and ` vanish and leave no space."""
    c = strip_marks(c) if fold_marks else c
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(c, _PUNCT, " "), _SPACE, " ")))


def normalize_regexp(c: Column) -> Column:
    """White space to a space, marks off, lower-cased, trimmed; punctuation stays."""
    return F.trim(F.lower(strip_marks(F.regexp_replace(c, _SPACE, " "))))


def normalize_regexp_copy(c: Column) -> Column:
    """Punctuation removed, white space to a space, lower-cased, trimmed."""
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(c, _PUNCT, ""), _SPACE, " ")))


def intent_part(query: Column, entity: Column) -> Column:
    """What is left of a query without the canonical name of its url-encoded entity."""
    name = F.replace(F.regexp_replace(entity, r"(.*?)(%28)(.*?)(%29.*)", "$1"), F.lit("%3A"), F.lit(""))
    name = normalize(F.regexp_replace(name, "[^A-Za-z0-9]", " "))
    for w in INTENT_STOPWORDS:
        name = F.regexp_replace(name, f" {w} ", " ")
        query = F.regexp_replace(query, f" {w} ", " ")
    return F.when(name == "", query).otherwise(F.replace(query, name, F.lit("")))


def encode(c: Column) -> Column:
    return F.url_encode(c)


def decode(c: Column) -> Column:
    return F.try_url_decode(c)


def capitalize_first(c: Column) -> Column:
    """First letter a to z in upper case; an empty text stays."""
    return F.when(c.rlike("^[a-z]"), F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))).otherwise(c)


@F.pandas_udf(StringType())
def html_unescape_twice(s: pd.Series) -> pd.Series:
    """Character references resolved, and those that this yields (a pandas UDF; texts without & pass through)."""
    return s.map(lambda x: html.unescape(html.unescape(x)) if "&" in x else x, na_action="ignore")


def chunk(parts: Column, first: Column | int, last: Column | int) -> Column:
    """Tokens first to last, both included and counted from 0, joined by spaces."""
    first, last = (F.lit(x) if isinstance(x, int) else x for x in (first, last))
    return F.array_join(F.slice(parts, first + 1, last - first + 1), " ")


def trigrams(parts: Column) -> Column:
    """Of every token: itself, the pair and the triple that begin there, joined by _, in that order but for the last two tokens, whose pair comes first."""
    n = F.size(parts)
    at = lambda i: F.get(parts, i)
    body = F.transform(F.when(n > 2, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")), lambda i: F.array(at(i), F.concat_ws("_", at(i), at(i + 1)), F.concat_ws("_", at(i), at(i + 1), at(i + 2))))
    tail = F.when(n > 1, F.array(F.concat_ws("_", at(n - 2), at(n - 1)), at(n - 2), at(n - 1))).when(n == 1, F.array(at(F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.flatten(body), tail)


def context_words(parts: Column) -> Column:
    """First token, then each further token and its pair with the one before."""
    rest = F.transform(F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array(F.get(parts, i), F.concat_ws("_", F.get(parts, i - 1), F.get(parts, i))))
    return F.concat(F.slice(parts, 1, 1), F.flatten(rest))


def letter_pairs(word: Column) -> Column:
    """Pairs of neighbouring characters; none for words of fewer than two."""
    return F.when(F.length(word) > 1, F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.substring(word, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def word_letter_pairs(c: Column) -> Column:
    """Letter pairs of all words of the upper-cased text."""
    return F.flatten(F.transform(F.split(F.upper(c), r"\s"), letter_pairs))


def lexical_similarity(a: Column, b: Column) -> Column:
    """2 x common letter pairs / all of them, counted with multiplicity; NaN if neither has any."""
    x, y = word_letter_pairs(a), word_letter_pairs(b)
    times = lambda arr, v: F.size(F.filter(arr, lambda w: w == v))
    common = F.aggregate(F.array_distinct(x), F.lit(0), lambda acc, v: acc + F.least(times(x, v), times(y, v)))
    total = F.size(x) + F.size(y)
    return F.when(total > 0, F.try_divide(F.lit(2.0) * common, total.cast("double"))).otherwise(F.lit(float("nan")))


def prepend_wiki(c: Column) -> Column:
    return F.concat(F.lit("_wiki_"), c)


def strip_wiki(c: Column) -> Column:
    """Without the first six characters, the prefix that prepend_wiki puts."""
    return F.substring(c, 7, 1 << 30)


def plain_text(markup: Column) -> Column:
    """Wiki markup without comments, templates, references, tables and tags; links become their anchors."""
    c = F.regexp_replace(markup, r"(?s)<!--.*?-->|<ref[^>]*>.*?</ref>|<ref[^>]*/>|\{\|.*?\|\}", "")
    for _ in range(3):  # templates in templates
        c = F.regexp_replace(c, r"\{\{[^{}]*\}\}", "")
    c = F.regexp_replace(c, r"\[\[[A-Za-z]+:[^\[\]]*\]\]", "")
    c = F.regexp_replace(c, r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", "$1")
    c = F.regexp_replace(c, r"\[https?://\S+ ?([^\]]*)\]", "$1")
    return F.regexp_replace(F.regexp_replace(c, r"'{2,}|<[^>]*>", ""), r"(?m)^=+\s*(.*?)\s*=+\s*$", "$1")


def first_paragraph(markup: Column) -> Column:
    """Words of the first line of text, lower-cased; leading {...} and [...] are skipped, and a last line that isn't ended doesn't count."""
    lead = F.regexp_replace(plain_text(markup), r"^(?:\s+|\{[^}]*\}|\[[^\]]*\])+", "")
    line = F.regexp_extract(lead, r"^([^\n]+)\n", 1)
    return F.array_join(F.regexp_extract_all(F.lower(line), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0)), " ")


def link_targets(markup: Column) -> Column:
    """Targets of the links in a page in order, each once; links with a colon are other things."""
    return F.array_distinct(F.transform(F.regexp_extract_all(markup, F.lit(r"\[\[([^\[\]|:#]+)(?:#[^\[\]|]*)?(?:\|[^\[\]]*)?\]\]"), F.lit(1)), lambda x: F.replace(F.trim(x), F.lit(" "), F.lit("_"))))


def count_object(c: Column, literal: str) -> Column:
    """Times that a literal occurs without overlap; 0 if the text begins with it."""
    size = F.size(F.split(c, "\\Q" + literal + "\\E", -1)) - 1
    return F.when(c.startswith(literal), F.lit(0)).otherwise(size)


def is_number(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[-+]?\d*\.?\d+$"), F.lit(False))
