"""Text expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode White_Space characters, one by one and as a regex
# class that Java and RE2 both read.
WHITE_SPACE = (
    "\t\n\v\f\r \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def trim_space(text: Column) -> Column:
    """Strip all leading and trailing white space (plain ``trim`` strips spaces only).

    Looks at the ends of the text alone, however long it is.
    """
    return F.btrim(text, F.lit(WHITE_SPACE))


def words(text: Column) -> Column:
    """The white-space separated words, in order, without empty ones."""
    return F.filter(F.split(text, rf"{SPACE}+"), lambda w: w != "")


def fold_ascii(text: Column) -> Column:
    """Trim, then lower-case A-Z only, so that other alphabets stay as they are."""
    return F.translate(trim_space(text), UPPER, LOWER)
