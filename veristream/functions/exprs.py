"""Scalar expressions over Columns.  All are built-in functions except :func:`decision_literal`."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The base32 alphabet in lower case, and the timestamp query around its 32-byte SHA-256 digest (DER).
BASE32 = "abcdefghijklmnopqrstuvwxyz234567"
QUERY_HEAD, QUERY_TAIL = "30390201013031300d060960864801650304020105000420", "0101ff"


def linf(vector: Column) -> Column:
    """Largest absolute lane; infinite for an empty or null vector and where a lane is null or not a number."""
    n = F.array_max(F.transform(vector, lambda x: F.coalesce(F.abs(x.cast("double")), F.lit(float("inf")))))
    return F.when(n.isNull() | F.isnan(n), F.lit(float("inf"))).otherwise(n)


def linf_distance(a: Column, b: Column) -> Column:
    """Largest absolute difference over the common lanes, subtracted in the vectors' own type."""
    k = F.least(F.size(a), F.size(b))
    return F.array_max(F.zip_with(F.slice(a, F.lit(1), k), F.slice(b, F.lit(1), k), lambda x, y: F.abs(x - y))).cast("double")


def is_finite(x: Column) -> Column:
    """Whether there is a number and it is finite: never null."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def fixed6(x: Column) -> Column:
    """Text with six decimals: rounded first, because formatting alone rounds ties another way."""
    return F.format_string("%.6f", F.round(x, 6))


def le32(n: Column) -> Column:
    """Four bytes of an unsigned 32-bit number, lowest first."""
    h = F.lpad(F.hex(n.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    return F.unhex(F.concat(*(F.substring(h, at, 2) for at in (7, 5, 3, 1))))


def from_le32(b: Column) -> Column:
    h = F.hex(b)
    return F.conv(F.concat(*(F.substring(h, at, 2) for at in (7, 5, 3, 1))), 16, 10).cast("long")


def deterministic_id(prefix: str, *parts: Column) -> Column:
    """Prefix and base32 of the first 15 bytes of the SHA-256 of the parts, joined by NUL."""
    h = F.sha2(F.concat_ws("\0", *parts), 256)
    letters = []
    for at in (1, 11, 21):  # groups of 40 bits
        group = F.conv(F.substring(h, at, 10), 16, 10).cast("long")
        letters += [F.substring(F.lit(BASE32), (F.shiftright(group, 35 - 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for k in range(8)]
    return F.concat(F.lit(prefix), *letters)


def chain_start(session: Column, domain: str = "frames@1:") -> Column:
    """First link of a session's chain (hex); ``domain`` separates kinds of chains."""
    return F.sha2(F.concat(F.lit(domain), session.cast("string")), 256)


def chain_next(previous: Column, payload_sha256: Column, frame_id: Column) -> Column:
    """Next link (hex): the hash of the link before, the payload's hash and the frame id."""
    return F.sha2(F.concat(F.unhex(previous), F.unhex(payload_sha256), le32(frame_id)), 256)


def timestamp_query(digest: Column) -> Column:
    """The 59 bytes of a timestamp query for a SHA-256 digest in hex; null for a digest of another length."""
    return F.when(F.length(digest) == 64, F.unhex(F.concat(F.lit(QUERY_HEAD), digest, F.lit(QUERY_TAIL))))


def generalized_time(blob: Column) -> Column:
    """The first well-formed GeneralizedTime in a binary, as RFC 3339 text; null without one."""
    t = F.regexp_extract(F.decode(blob, "ISO-8859-1"), "\\x18\\x0f([0-9]{14})Z", 1)
    part = lambda at, n: F.substring(t, at, n)
    return F.when(t != "", F.concat(part(1, 4), F.lit("-"), part(5, 2), F.lit("-"), part(7, 2), F.lit("T"), part(9, 2), F.lit(":"), part(11, 2), F.lit(":"), part(13, 2), F.lit("Z")))


def shortened(text: Column, limit: int = 100) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def typed_number(text: Column, kind: Column) -> Column:
    """The number that an object of a decimal or integer type states; null for other types."""
    return F.when(kind.isin("literal:decimal", "literal:integer"), text.try_cast("double"))


def merged(base: Column, over: Column) -> Column:
    """Both maps' entries, those of ``over`` winning."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)


@F.pandas_udf(StringType())
def decision_literal(action: pd.Series, confidence: pd.Series) -> pd.Series:
    """Compact JSON with Python's shortest number text, which no built-in function writes for small doubles."""
    return pd.Series([json.dumps({"action": a, "confidence": None if pd.isna(c) else c}, separators=(",", ":")) for a, c in zip(action, confidence, strict=True)], dtype=object)
