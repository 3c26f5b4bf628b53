"""Text functions as Spark columns. All stay in the JVM but `nfc` and `casefold`, which Spark lacks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Typographic ligatures and their letters.
LIGATURES = (
    ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"),
    ("Ĳ", "IJ"), ("ĳ", "ij"), ("Œ", "OE"), ("œ", "oe"), ("Æ", "AE"), ("æ", "ae"),
)

SPACE = "(?U)\\s"


@pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@pandas_udf(StringType())
def _casefold(text: pd.Series) -> pd.Series:
    return text.map(str.casefold, na_action="ignore")


def nfc(text: Column) -> Column:
    """NFC. Text without characters from U+0300 on is composed already and does not go to Python."""
    return F.coalesce(_nfc(F.when(text.rlike("[^\\x{0}-\\x{2ff}]"), text)), text)


def casefold(text: Column) -> Column:
    return _casefold(text)


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.when(text.rlike("(?U)^\\s|\\s$"), F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")).otherwise(text)


def is_tidy(text: Column) -> Column:
    """True only for texts that normalize_text and fold_ligatures leave as they are: letters and marks of Latin-1 without
    ligatures, with single spaces between them. One look instead of some twenty passes; the pattern runs through the text
    without a choice, as one that looks for what is wrong takes about ten times as long."""
    spaced = text.contains("  ") | text.startswith(" ") | text.endswith(" ")
    return text.rlike("\\A[ -~\\xa1-\\xc5\\xc7-\\xe5\\xe7-\\xff]*+\\z") & ~spaced


def clean_controls(text: Column) -> Column:
    """Line ends become \\n, form feeds too; other C0 controls but the tab, and DEL, go."""
    text = F.regexp_replace(text, "\\r\\n?|\\f", "\n")
    return F.regexp_replace(text, "[\\x00-\\x08\\x0b\\x0e-\\x1f\\x7f]", "")


def has_controls(text: Column) -> Column:
    return text.rlike("[\\x00-\\x08\\x0b\\x0e-\\x1f\\x7f]")


def tidy_lines(text: Column) -> Column:
    """Lines without trailing blanks, blank runs as one space, the whole stripped."""
    text = F.regexp_replace(text, "[ \\t]+(?=\\n|\\z)", "")
    return strip(F.regexp_replace(text, "[ \\t]+", " "))


def normalize_text(text: Column, compose: bool = True) -> Column:
    return tidy_lines(clean_controls(nfc(text) if compose else text))


def normalize_title(title: Column) -> Column:
    title = F.regexp_replace(nfc(title), "[\\x00-\\x08\\x0b\\x0e-\\x1f\\x7f]", "")
    return strip(F.regexp_replace(F.regexp_replace(title, "[\\f\\n\\r]", " "), "[ \\t]+", " "))


def fold_ligatures(text: Column) -> Column:
    for ligature, letters in LIGATURES:
        text = F.replace(text, F.lit(ligature), F.lit(letters))
    return text


def split_blocks(text: Column) -> Column:
    """Parts between blank lines, stripped, without empty ones."""
    several = F.transform(F.split(text, "\\n[ \\t]*\\n+"), strip)
    return F.filter(F.when(text.contains("\n"), several).otherwise(F.array(strip(text))), lambda part: part != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("(?U)\\S+"))


def words(text: Column) -> Column:
    """Word tokens that join to the text: each word with the white space after it; leading white space goes to the first;
    a text of white space only is one token."""
    found = F.regexp_extract_all(text, F.lit("(?U)^\\s*\\S+\\s*|\\S+\\s*"), F.lit(0))
    return F.when((F.size(found) == 0) & (text != ""), F.array(text)).otherwise(found)


def characters(text: Column) -> Column:
    """Code points."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def comparison_key(token: Column, normalize_whitespace: bool = True, ignore_case: bool = False, ignore_punctuation: bool = False) -> Column:
    """What tokens are compared by; what is shown never changes."""
    if normalize_whitespace:
        token = strip(token)
    if ignore_case:
        token = casefold(token)
    if ignore_punctuation:
        token = F.regexp_replace(token, "\\p{P}", "")
    return token


def _median(sorted_numbers: Column) -> Column:
    n = F.size(sorted_numbers)
    upper, lower = F.get(sorted_numbers, F.floor(n / 2).cast("int")), F.get(sorted_numbers, F.floor((n - 1) / 2).cast("int"))
    return (upper + lower) / 2


def looks_like_verse(text: Column) -> Column:
    """Three lines or more, short (median 45 at most) and of even length; the last may be shorter."""
    lines = F.filter(F.split(text, "\\n"), lambda line: line.rlike("(?U)\\S"))
    lengths = F.transform(lines, F.length)
    median = _median(F.array_sort(lengths))
    uneven = F.exists(F.slice(lengths, 1, F.size(lengths) - 1), lambda n: n < median * 0.55)
    even = (F.array_max(lengths) - F.array_min(lengths)) < median * 0.6
    return F.when(F.size(lines) < 3, False).otherwise((median > 0) & (median <= 45) & ~uneven & even)


def verse_lines(text: Column) -> Column:
    """The stripped lines of a verse passage (upper median of words a line: 3 or more), else null."""
    lines = F.filter(F.transform(F.split(text, "\\n"), strip), lambda line: line != "")
    counts = F.array_sort(F.transform(lines, word_count))
    enough = F.get(counts, F.floor(F.size(counts) / 2).cast("int")) >= 3
    return F.when(text.contains("\n"), F.when(looks_like_verse(text) & enough, lines))


def reflow(text: Column) -> Column:
    """Lines broken for layout joined by spaces. Verse stays; in a block of four lines or more, nothing is joined to a
    line that is still much shorter than the median."""
    lines = F.split(text, "\\n")
    full = F.filter(lines, lambda line: line.rlike("(?U)\\S"))
    median = F.when(F.size(full) >= 4, _median(F.array_sort(F.transform(full, F.length))))

    def step(done: Column, line: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat_ws(" ", last, line)))
        alone = F.concat(done, F.array(line))
        return F.when((F.size(done) == 0) | F.coalesce(F.length(last) < median * 0.55, F.lit(False)), alone).otherwise(joined)

    joined = F.array_join(F.aggregate(F.transform(full, strip), F.array().cast("array<string>"), step), "\n")
    return F.when((F.size(lines) < 2) | looks_like_verse(text), text).otherwise(joined)
