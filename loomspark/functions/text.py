"""Expressions over one text. All are native; nulls give null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English words that are no keywords.
COMMON_WORDS = tuple(
    "the and that this with from have been were will would could should about which their there these those other into some than then when what where while after before between through during"
    " without within also just only very more most such each every both many much any all own same".split()
)
#: CJK signs that are no part of keywords.
CJK_STOPS = "的了是在我有和就不人都一这中大为上个到说们会着也很把那你他她它与及或等之于而以其，。！？、；：\"\"（）【】《》—…·"
CJK = "\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{3000}-\\x{303F}\\x{3040}-\\x{309F}\\x{30A0}-\\x{30FF}\\x{AC00}-\\x{D7AF}\\x{FF00}-\\x{FFEF}"


def chars_no_space(text: Column) -> Column:
    """Characters that are no Unicode white space."""
    return F.length(F.regexp_replace(text, r"(?U)\s", "")).cast("bigint")


def lines_of(text: Column) -> Column:
    """Lines as an array: parted at LF, without one CR before it, and without an empty one at the end."""
    whole = F.split(text, "\n")
    cut = F.when(text == "", F.array().cast("array<string>")).when(F.endswith(text, F.lit("\n")), F.slice(whole, 1, F.greatest(F.size(whole) - 1, F.lit(0)))).otherwise(whole)
    return F.when(F.contains(text, F.lit("\r")), F.transform(cut, lambda x: F.regexp_replace(x, r"\r$", ""))).otherwise(cut)


def line_count(text: Column) -> Column:
    """Number of such lines, without making them."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", F.lit(0)).otherwise(breaks + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("bigint")


def english_words(text: Column) -> Column:
    """Runs of two or more ASCII letters and digits."""
    return F.regexp_count(text, F.lit("[A-Za-z0-9]{2,}")).cast("bigint")


def utf8_cut(text: Column, size: Column | int) -> Column:
    """The longest start of a text of at most ``size`` bytes that doesn't part a character."""
    n = F.lit(size) if isinstance(size, int) else size
    raw = text.cast("binary")
    starts = [F.substring(raw, F.lit(1), F.greatest(n - k, F.lit(0)).cast("int")).cast("string") for k in range(4)]
    cut = F.coalesce(*(F.when(F.is_valid_utf8(s), s) for s in starts))
    return F.when(F.octet_length(text) <= n, text).otherwise(cut)


def preview(text: Column, size: int = 60) -> Column:
    """The first line that is neither blank nor a comment, trimmed, cut to ``size`` characters and ``...``; null if none."""
    line = F.try_element_at(F.filter(F.transform(lines_of(text), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: (x != "") & ~F.startswith(x, F.lit("<!--"))), F.lit(1))
    return F.when(F.length(line) > size, F.concat(F.substring(line, 1, size), F.lit("..."))).otherwise(line)


def dots(text: Column) -> Column:
    """Dots in an id."""
    return F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))


def keywords(text: Column, most: int = 5) -> Column:
    """Up to ``most`` keywords: English words of four signs or more that aren't common, in their first spelling and order,
    then CJK runs of three, two and four signs over the CJK signs of the text without stops."""
    words = F.regexp_extract_all(text, F.lit("([A-Za-z0-9]{4,})"), F.lit(1))
    words = F.filter(words, lambda w: ~F.lower(w).isin(*COMMON_WORDS))
    first = F.aggregate(
        words,
        F.array().cast("array<string>"),
        lambda acc, w: F.when((F.size(acc) >= most) | F.exists(acc, lambda x: F.lower(x) == F.lower(w)), acc).otherwise(F.concat(acc, F.array(w))),
    )
    cjk = F.translate(F.regexp_replace(text, f"[^{CJK}]", ""), CJK_STOPS, "")
    signs = F.regexp_extract_all(cjk, F.lit("(?s)."), F.lit(0))
    none = F.array().cast("array<string>")

    def grams(x: Column, k: int) -> Column:
        return F.when(F.size(x) >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(x, i, k), ""))).otherwise(none)

    # bound to a name by way of an array of one: what stands inside a lambda is evaluated for every element
    of_signs = F.element_at(F.transform(F.array(signs), lambda x: F.concat(grams(x, 3), grams(x, 2), grams(x, 4))), 1)
    return F.slice(F.array_distinct(F.concat(first, of_signs)), 1, most)
