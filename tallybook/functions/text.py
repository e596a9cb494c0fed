"""Text normalisation for matching and duplicate keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters counted as white space.
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
               "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
SPACES = r"(?U)\s+"


def squeeze(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, " ")


def trimmed(text: Column) -> Column:
    """Strip all leading and trailing white space (not only blanks)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def stripped(name: str) -> Column:
    """`trimmed` of a plain column: between two visible ASCII characters there is nothing to strip,
    so only other texts are held against the list. Not for expressions, as it reads three times."""
    text = F.col(name)
    # texts compare by bytes, so the first character needs no copy
    return F.when((text >= "!") & (text < "\x7f")
                  & F.substring(text, -1, 1).between("!", "~"), text).otherwise(trimmed(text))


def bound(value: Column, use) -> Column:
    """use(value), with `value` computed once however often `use` refers to it."""
    return F.transform(F.array(value), use)[0]


def computed_once(df: DataFrame, *columns: Column) -> DataFrame:
    """Add columns so that later filters on them do not copy their expressions.

    A filter on a plain projected column is pushed below the projection, which repeats long
    parsing expressions; a generated row of one struct keeps them in one place.
    """
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def blank_to_null(text: Column) -> Column:
    return F.nullif(trimmed(text), F.lit(""))


def collapsed_lower(text: Column) -> Column:
    """The whole text in lower case with inner white space collapsed; null becomes ''."""
    return F.trim(squeeze(F.lower(F.coalesce(text, F.lit("")))))


def lowered(name: str) -> Column:
    """A column's text in lower case, for `collapsed`; null becomes ''."""
    return F.lower(F.coalesce(F.col(name), F.lit("")))


def collapsed(name: str) -> Column:
    """`collapsed_lower` of a plain column that holds a text in lower case: texts of visible ASCII
    and blanks need no search for other white space. Not for expressions, as it reads four times."""
    text = F.col(name)
    return F.trim(F.when(text.rlike("[^!-~ ]"), squeeze(text))
                  .when(F.contains(text, F.lit("  ")), F.regexp_replace(text, " {2,}", " "))
                  .otherwise(text))


def digits_only(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\D", "")


def normalize_match_text(text: Column) -> Column:
    """Lower-case words separated by single blanks; everything but letters and digits is a gap.

    This is the JVM form, exact for text that lower() and casefold() treat alike (all ASCII);
    with_match_text() adds the Unicode fold for the rest.
    """
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


_ASCII = r"^\p{ASCII}*$"


def _unicode_fold(text: Column) -> Column:
    """Compatibility normal form and case fold, which Spark has no built-in for; null stays."""
    # nested, so that it is pickled by value and executors need no copy of this package
    def fold(texts: pd.Series) -> pd.Series:
        import unicodedata

        folded = texts.astype(object)
        present = folded.notna()
        folded[present] = [unicodedata.normalize("NFKC", t).casefold() for t in folded[present]]
        return folded

    return F.pandas_udf(fold, returnType=T.StringType())(text)


def with_match_text(df: DataFrame, source: str, target: str) -> DataFrame:
    """Add the normalised text of `source`. Meant for distinct texts: only non-ASCII ones carry
    a value through the Arrow round trip, all others stay in the JVM."""
    needs_fold = ~F.coalesce(F.col(source), F.lit("")).rlike(_ASCII)
    folded = _unicode_fold(F.when(needs_fold, F.col(source)))
    return df.withColumn(target, normalize_match_text(F.coalesce(folded, F.col(source))))


def keyword_list(csv: Column) -> Column:
    """Normalised, non-empty, distinct keywords of a comma list, in order."""
    parts = F.transform(F.split(F.coalesce(csv, F.lit("")), ","), normalize_match_text)
    return F.array_distinct(F.filter(parts, lambda k: k != ""))


def keywords_csv(csv: Column) -> Column:
    """The comma list rewritten in normal form; null when nothing is left."""
    return F.nullif(F.array_join(keyword_list(csv), ", "), F.lit(""))


def contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    """True when any phrase occurs in the text; plain searches beat one long alternation."""
    found = F.contains(text, F.lit(phrases[0]))
    for phrase in phrases[1:]:
        found = found | F.contains(text, F.lit(phrase))
    return found
