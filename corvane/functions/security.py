"""Signed messages and key strings."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType


def signature(secret: str):
    """A column function (payload, seconds) -> hex HMAC-SHA256 of "seconds.payload"; null stays null."""

    @F.pandas_udf(StringType())
    def sign(payload: pd.Series, at: pd.Series) -> pd.Series:
        key = secret.encode()
        return pd.Series([None if p is None or t != t else hmac.new(key, f"{int(t)}.{p}".encode(), hashlib.sha256).hexdigest() for p, t in zip(payload, at)], dtype=object)

    return sign


def verified(secret: str, tolerance: int = 300):
    """A column function (payload, seconds, signature, now) -> whether the signature holds and is no older or newer than ``tolerance`` seconds; false with a null."""

    @F.pandas_udf(BooleanType())
    def check(payload: pd.Series, at: pd.Series, given: pd.Series, now: pd.Series) -> pd.Series:
        key = secret.encode()
        out = []
        for p, t, g, n in zip(payload, at, given, now):
            ok = p is not None and g is not None and t == t and n == n and abs(n - t) <= tolerance
            out.append(bool(ok and hmac.compare_digest(hmac.new(key, f"{int(t)}.{p}".encode(), hashlib.sha256).hexdigest(), g)))
        return pd.Series(out, dtype=bool)

    return check


#: Fixed value: the namespace of names that are urls (RFC 4122).
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def point_id(name: Column) -> Column:
    """Version 5 UUID of a name, stable across writers."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128))))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12))
