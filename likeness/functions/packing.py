"""Columns in fewer bytes, for shuffles that carry whole rows; both ways exact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys of digits and these signs take half a byte a character; the sixteenth half fills up odd lengths.
_SIGNS = "|-.: "
CUT, _MARK = "\x1f", "\x1e"


def short_key(c: Column) -> Column:
    """A string key as bytes: equal keys and only those have equal bytes, and NULL stays NULL."""
    plain = F.translate(c, _SIGNS, "abcde")
    halves = F.unhex(F.concat(plain, F.when(F.length(c) % 2 == 1, F.lit("f")).otherwise(F.lit(""))))
    # No packed key begins with two fillers, so others are told by that byte.
    return F.when(c.rlike(r"\A[0-9|\-.: ]+\z"), halves).otherwise(F.concat(F.unhex(F.lit("ff")), c.cast("binary")))


def long_key(c: Column) -> Column:
    """The key that :func:`short_key` made bytes of."""
    halves = F.hex(c)
    plain = F.translate(F.rtrim(halves, F.lit("F")), "ABCDE", _SIGNS)
    return F.when(F.startswith(halves, F.lit("FF")), F.substring(c, 2, 1 << 30).cast("string")).otherwise(plain)


def joined_texts(columns: Sequence[Column]) -> Column:
    """String columns as one text; NULL and blank stay apart, and any text may be in them."""

    def one(c: Column) -> Column:
        marked = F.replace(F.replace(c, F.lit(_MARK), F.lit(f"{_MARK}0")), F.lit(CUT), F.lit(f"{_MARK}1"))
        return F.coalesce(marked, F.lit(f"{_MARK}2"))

    return F.concat_ws(CUT, *[one(c) for c in columns])


def split_texts(text: Column, n: int) -> list[Column]:
    """The ``n`` columns that :func:`joined_texts` joined."""
    parts = F.split(text, CUT, -1)

    def one(part: Column) -> Column:
        plain = F.replace(F.replace(part, F.lit(f"{_MARK}1"), F.lit(CUT)), F.lit(f"{_MARK}0"), F.lit(_MARK))
        return F.when(part != F.lit(f"{_MARK}2"), plain)

    return [one(F.get(parts, F.lit(i))) for i in range(n)]
