"""Finding columns under other names, flattening, ordering. All on the driver, from schemas alone."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exact(columns: Sequence[str], candidates: Iterable[str], required: bool = False) -> str | None:
    """The first candidate that is a column."""
    found = next((c for c in candidates if c in columns), None)
    if found is None and required:
        raise KeyError(f"none of {list(candidates)} in {list(columns)}")
    return found


def any_case(columns: Sequence[str], candidates: Iterable[str]) -> str | None:
    """The column that equals the first matching candidate in any case."""
    by_lower = {c.lower(): c for c in reversed(columns)}
    return next((by_lower[c.lower()] for c in candidates if c.lower() in by_lower), None)


def canonical(columns: Sequence[str], candidates: Iterable[str]) -> str | None:
    """The first column whose letters and digits are those of a candidate."""
    bare = lambda s: re.sub("[^a-z0-9]", "", s.lower())
    wanted = {bare(c) for c in candidates}
    return next((c for c in columns if bare(c) in wanted), None)


def scored(columns: Sequence[str], must_any: Sequence[str] = (), avoid_any: Sequence[str] = (), prefer_any: Sequence[str] = ()) -> str | None:
    """The column with the best score: ten for each preferred part, less one for each dot and a little for length; ties to the later name."""
    best: tuple[float, str] | None = None
    for name in columns:
        low = name.lower()
        if (must_any and not any(m in low for m in must_any)) or any(a in low for a in avoid_any):
            continue
        points = 10 * sum(p in low for p in prefer_any) - low.count(".") - len(low) / 200
        best = max(best, (points, name)) if best else (points, name)
    return best[1] if best else None


def rename_missing(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename old to new where old is there and new is not."""
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns and new not in df.columns})


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Struct fields as dotted columns; arrays and maps as JSON text."""

    def walk(c: Column, kind: T.DataType, name: str) -> Iterable[Column]:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                yield from walk(c.getField(f.name), f.dataType, f"{name}{sep}{f.name}")
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            yield F.to_json(c).alias(name)
        else:
            yield c.alias(name)

    return df.select(*[x for f in df.schema.fields for x in walk(F.col(f"`{f.name}`"), f.dataType, f.name)])


def reorder(df: DataFrame, first: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """Preferred columns that are there, then the rest."""
    head = [c for c in first if c in df.columns and c not in drop]
    return df.select(*head, *[c for c in df.columns if c not in head and c not in drop])


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    """Every column but ``keep`` under a prefix, so that a join clashes on nothing."""
    return df.select(*[F.col(f"`{c}`") if c in keep else F.col(f"`{c}`").alias(prefix + c) for c in df.columns])


def add_rate_if_absent(df: DataFrame, name: str, num: str, den: str) -> DataFrame:
    """A rate column, only where it is missing and its counts are there."""
    if name in df.columns or num not in df.columns or den not in df.columns:
        return df
    return df.withColumn(name, F.try_divide(F.col(num).cast("double"), F.col(den).cast("double")))
