"""Scalar rules on ids, labels, depths and text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper bounds of depth bins and the names of the layers between them.
LAYERS = [(100, "L1"), (300, "L2/3"), (500, "L4"), (800, "L5")]


def group_id(x: Column) -> Column:
    """'b1' and 'B-1' become 'B-1'; anything else, and null, stays."""
    ok = x.rlike(r"^\s*[A-Za-z]-?\d+\s*$")
    return F.when(ok, F.upper(F.regexp_replace(F.trim(x), r"^([A-Za-z])-?(\d+)$", "$1-$2"))).otherwise(x)


def layer(depth: Column) -> Column:
    """Layer of a depth; null or negative depths have none."""
    out = F.when(depth.isNull() | (depth < 0), F.lit(None).cast("string"))
    for top, name in LAYERS:
        out = out.when(depth < top, name)
    return out.otherwise("L6")


def natural_key(x: Column) -> Column:
    """A key that sorts digits as numbers: each run of digits padded to twelve."""
    parts = F.regexp_extract_all(x, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 12, "0")).otherwise(F.lower(p))), "")


def path_part(x: Column) -> Column:
    """Letters, digits, dots, dashes and underscores; anything else becomes one underscore."""
    return F.regexp_replace(F.trim(x), r"[^A-Za-z0-9._-]+", "_")


def settings(x: Column) -> Column:
    """A map from lines `key=value`; a single line without `=` is the version."""
    return F.when(x.contains("="), F.str_to_map(F.trim(x), F.lit("\n"), F.lit("="))).otherwise(F.create_map(F.lit("version"), F.trim(x)))


def split_id(x: Column, sep: str = "--") -> Column:
    """Two parts around the separator; null if there aren't exactly two."""
    parts = F.split(x, sep)
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("loc"), parts[1].alias("acq")))


def standard_label(raw: Column, aliases: dict[str, str]) -> Column:
    """Trimmed, upper-cased and mapped; null for what isn't known."""
    table = F.create_map(*[F.lit(v) for pair in aliases.items() for v in pair])
    return F.try_element_at(table, F.upper(F.trim(raw)))


def pair_key(a: Column, b: Column, sep: str = "+") -> Column:
    """Both ids in order, joined."""
    return F.concat_ws(sep, F.array_sort(F.array(a.cast("string"), b.cast("string"))))


def name_timestamp(x: Column) -> Column:
    """The first `YYYYMMDD_HHMMSS` in a name."""
    return F.try_to_timestamp(F.regexp_extract(x, r"(\d{8}_\d{6})", 1), F.lit("yyyyMMdd_HHmmss"))
