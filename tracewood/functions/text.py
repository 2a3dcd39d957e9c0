"""String expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t"


def trimmed(c: Column | str) -> Column:
    """Without outer blanks and tabs."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(c, F.lit(BLANKS))


def global_symbol(c: Column | str) -> Column:
    """The trimmed symbol, or null where it is null, empty or local to one file."""
    t = trimmed(c)
    return F.when((t != "") & ~t.startswith("local "), t)


def plain_class_name(c: Column) -> Column:
    """Last plain name of a written base: without type arguments, qualifiers and outer blanks; null if nothing remains."""
    bare = c
    for _ in range(5):  # innermost brackets first, so arguments may nest five deep; deeper ones are cut below
        bare = F.regexp_replace(bare, r"<[^<>]*>|\[[^\[\]]*\]|\([^()]*\)", "")
    bare = F.regexp_replace(bare, r"[<\[(].*$", "")
    name = F.regexp_extract(bare, r"([^\s.:/\\#]+)\s*$", 1)
    return F.when(name != "", name)


def fingerprint(*cols: Column | str) -> list[Column]:
    """Two 64-bit hashes of a composite value; nulls are told from absent parts, so (null, x) and (x, null) differ."""
    cols = [F.col(c) if isinstance(c, str) else c for c in cols]
    parts = [p for c in cols for p in (c.isNull(), c)]
    return [F.xxhash64(*parts), F.xxhash64(F.lit(0x5EED), *reversed(parts))]


def latest(df, key: str, stamp: str):
    """Present state of each key: the row with the latest stamp (nulls last); equal stamps fall back to the row's own hash."""
    from pyspark.sql import Window

    order = [F.col(stamp).desc_nulls_last(), F.xxhash64(*[F.col(c) for c in df.columns]).asc()]
    mark = "_latest_rank"
    while mark in df.columns:
        mark += "_"
    return df.withColumn(mark, F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col(mark) == 1).drop(mark)
