"""Union feeds with keyset pages."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = 1


def feed(arms: dict[str, DataFrame], wanted: set[str] | None = None) -> DataFrame:
    """The arms of the wanted types, one below the other, each with its name as `type`."""
    rows = [df.withColumn("type", F.lit(name)) for name, df in arms.items() if wanted is None or name in wanted]
    if not rows:
        first = next(iter(arms.values()))
        return first.withColumn("type", F.lit(None).cast("string")).limit(0)
    out = rows[0]
    for df in rows[1:]:
        out = out.unionByName(df)
    return out


def after(order: list[tuple[str, bool]], values: list) -> Column:
    """Rows beyond `values` in an order of (column, ascending) with mixed directions; no column may be null."""
    out, equal = F.lit(False), F.lit(True)
    for (name, ascending), value in zip(order, values, strict=True):
        beyond = F.col(name) > F.lit(value) if ascending else F.col(name) < F.lit(value)
        out = out | (equal & beyond)
        equal = equal & (F.col(name) == F.lit(value))
    return out


def page(df: DataFrame, order: list[tuple[str, bool]], size: int, cursor: list | None = None) -> DataFrame:
    """The next `size` rows and one more, which shows that there is another page."""
    rows = df.filter(after(order, cursor)) if cursor is not None else df
    return rows.orderBy(*[F.asc(c) if up else F.desc(c) for c, up in order]).limit(size + 1)


def scope_hash(scope: dict) -> str:
    return hashlib.sha256(json.dumps(scope, sort_keys=True, default=str).encode()).hexdigest()[:16]


def encode_cursor(values: list, scope: dict) -> str:
    raw = json.dumps({"v": VERSION, "scope": scope_hash(scope), "at": values}, default=str, separators=(",", ":"))
    return base64.urlsafe_b64encode(raw.encode()).decode().rstrip("=")


def decode_cursor(cursor: str, scope: dict) -> list:
    """The values of a cursor; ValueError if it is of another version or scope, or no cursor."""
    try:
        held = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        version, owner, values = held["v"], held["scope"], held["at"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("not a cursor") from e
    if version != VERSION or owner != scope_hash(scope):
        raise ValueError("a cursor of another version or scope")
    return values
