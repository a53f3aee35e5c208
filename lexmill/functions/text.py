"""Turkish-safe normalisation, tokens and line helpers as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Upper case that must be mapped before lower(), and letters that fold to ASCII.
UPPER = ("İIŞĞÜÖÇ", "iışğüöç")
FOLD = ("şğüöçıâîû", "sguociaiu")
COMBINING_DOT = "\u0307"

# Words that carry no topic, in normalised form.
STOP_WORDS = tuple(
    """
    ne nedir nasil nerede neresi nereden neye niye nicin kim kimdir kimler hangi kac kacta kacinci
    mi mu midir var yok vardir mevcut ve veya ile ama fakat ancak icin gibi kadar sonra once simdi
    bu su o bir birkac her hepsi tum butun diger baska ben sen biz siz onlar benim senin bizim sizin onun
    olan olarak olur oldu olmak yapmak etmek almak vermek da de ki dan den ta te tan ten
    zaman tarih tarihi tarihleri universite universitesi universitede universiteye
    """.split()
)

#: Characters that NFKC leaves alone whatever stands beside them; anything else sends the string to the normaliser.
PLAIN = r"\x00-\x9F\xA1-\xA7\xA9\xAB-\xAE\xB0\xB1\xB6\xB7\xBB\xBF-ıĴ-ľŁ-ňŊ-ž‐‒-―‘-‟†-•′‹›€"

# Classes ask first whether a character is plain ASCII, which settles most of them.
ODD = rf"[[^\x00-\x7E]&&[^{PLAIN}]]"
_WHITE = r"\t-\r\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"  # white space but the blank
_SPACE = rf"[[^\x21-\x7E]&&[ {_WHITE}]]"
_OTHER_SPACE = rf"[[^\x20-\x7E]&&[{_WHITE}]]"
WORD = rf"[\x21-\x7E[[^\x20-\x7E]&&[^{_WHITE}]]]+"
WHITE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(c: Column) -> Column:
    """Unicode NFKC. Strings of plain characters stay in the JVM; the Arrow function sees nulls in their place."""
    odd = c.rlike(ODD)
    return F.when(odd, _nfkc(F.when(odd, c))).otherwise(c)


def by_form(df: DataFrame, text: str, make: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """make(rows, compatibility) over the rows of df whose text NFKC leaves alone and over the others, united: only the
    others meet an Arrow operator, and plain rows are never buffered for it."""
    odd = F.coalesce(F.col(text).rlike(ODD), F.lit(False))
    return make(df.filter(~odd), False).unionByName(make(df.filter(odd), True))


def lower_tr(c: Column, compatibility: bool = True) -> Column:
    """Lower case by Turkish rules. compatibility=False leaves out NFKC, for text known to be in that form."""
    base = nfkc(c) if compatibility else c
    return F.replace(F.lower(F.translate(base, *UPPER)), F.lit(COMBINING_DOT), F.lit(""))


def fold_tr(c: Column) -> Column:
    return F.translate(c, *FOLD)


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, f" {_SPACE}+|{_OTHER_SPACE}{_SPACE}*", " "))


def normalize_tr(c: Column, compatibility: bool = True) -> Column:
    return squeeze(fold_tr(lower_tr(c, compatibility)))


def tokens_of(normalized: Column, stop_words: bool = True) -> Column:
    """Tokens of a normalised column; with stop_words, none of STOP_WORDS and none of one character."""
    if not stop_words:
        return F.regexp_extract_all(normalized, F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(F.regexp_extract_all(normalized, F.lit("[a-z0-9]{2,}"), F.lit(0)), lambda t: ~t.isin(*STOP_WORDS))


def tokenize_tr(c: Column, stop_words: bool = True, compatibility: bool = True) -> Column:
    return tokens_of(normalize_tr(c, compatibility), stop_words)


def words_of(c: Column) -> Column:
    """Words between white space; null gives null, blank an empty array."""
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(c, F.lit(WHITE))


def lines_of(c: Column) -> Column:
    return F.split(c, "\n", -1)


def filled_lines(c: Column) -> Column:
    return F.filter(lines_of(c), lambda s: strip(s) != "")


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """regexp_extract with null for no match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def any_substring(c: Column, parts) -> Column:
    """Whether c holds one of the literal parts."""
    found = F.lit(False)
    for p in parts:
        found = found | c.contains(p)
    return found
