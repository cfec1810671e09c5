"""Query names: suspicious-name test and the numbered chunk label."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

# Words that mark a name as suspicious, and the shape of a chunk label
# (session id, index, total, chunk).
KEYWORDS = ("exfill", "data", "leak")
CHUNK_PATTERN = "^([0-9]+)-([0-9]+)-([0-9]+)-([^\n]+)"

_LARGEST_INDEX = 9223372036854775807


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(value: Column, words: Sequence[str]) -> Column:
    return any_of([value.contains(word) for word in words])


def clean_qname(qname: Column) -> Column:
    return F.rtrim(qname, F.lit("."))


def is_suspicious(qname: Column, keywords: Sequence[str] = KEYWORDS) -> Column:
    return contains_any(F.lower(qname), keywords)


def first_label(qname: Column) -> Column:
    return F.substring_index(qname, ".", 1)


def has_parent(qname: Column) -> Column:
    return qname.contains(".")


def parent_domain(qname: Column, labels: int = 2) -> Column:
    """The last labels of the name, e.g. exfill.local."""
    return F.substring_index(qname, ".", -labels)


def _whole_number(text: Column) -> Column:
    # An index past the long range can never be part of a complete session; it saturates.
    return F.coalesce(text.try_cast("bigint"), F.lit(_LARGEST_INDEX))


def is_chunk_name(qname: Column) -> Column:
    return has_parent(qname) & first_label(qname).rlike(CHUNK_PATTERN)


def chunk_fields(qname: Column) -> dict[str, Column]:
    """session_id, idx, total and chunk of a name for which is_chunk_name holds.

    The first three parts hold digits only, so the label splits at its first three dashes.
    """
    parts = F.split(first_label(qname), "-", 4)
    part = [F.get(parts, F.lit(i)) for i in range(4)]
    return {
        # Never NULL here; saying so keeps the plans of joined branches alike.
        "session_id": F.coalesce(part[0], F.lit("")), "idx": _whole_number(part[1]), "total": _whole_number(part[2]),
        "chunk": F.substring_index(part[3], "\n", 1),
    }
