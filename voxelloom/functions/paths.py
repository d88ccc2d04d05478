"""Column functions on paths, names, parameters and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def join_list(c, sep=",") -> Column:
    return F.array_join(_c(c), sep)


def default(*cols) -> Column:
    """First value that is neither NULL nor the empty string."""
    return F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in cols])


def last_segment(c) -> Column:
    return F.element_at(F.split(_c(c), "/"), -1)


def stem(c) -> Column:
    """Name up to the last dot; the whole name when there is none."""
    return F.regexp_replace(_c(c), r"\.[^.]*$", "")


def extension(c) -> Column:
    """Text after the last dot, or '' when there is none."""
    return F.regexp_extract(_c(c), r"\.([^.]*)$", 1)


def base_name(c) -> Column:
    """File name without folders and without the last extension."""
    return stem(last_segment(c))


def parent(c) -> Column:
    return F.regexp_replace(_c(c), r"/[^/]*$", "")


def replace_dots(c, by="_") -> Column:
    return F.replace(_c(c), F.lit("."), F.lit(by))


def contains(c, text) -> Column:
    return F.contains(_c(c), F.lit(text))


def after(c, prefix: str) -> Column:
    """Text that follows a literal prefix (up to white space)."""
    return F.regexp_extract(_c(c), rf"\Q{prefix}\E(\S*)", 1)


def token(c, sep: str, index: int, lower=True) -> Column:
    """One token; index 1 is the first, -1 the last."""
    t = F.element_at(F.split(_c(c), rf"\Q{sep}\E"), index)
    return F.lower(t) if lower else t


def vector(c) -> Column:
    """'1.0,1.0,6.5' or '.5,.5' -> array<double> in the order written."""
    return F.transform(F.split(_c(c), ","), lambda s: F.trim(s).cast("double"))


def vector_zyx(c) -> Column:
    """Comma lists are written x,y,z; arrays are kept z,y,x."""
    return F.reverse(vector(c))


def merge_maps(left, right) -> Column:
    """Union of two maps; where both have a key the right side wins."""
    return F.map_zip_with(_c(left), _c(right), lambda k, a, b: F.coalesce(b, a))


def render_map(c, sep="\n") -> Column:
    """`k=v` entries in key order."""
    entries = F.array_sort(F.map_entries(_c(c)))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), sep)


def points_name(name, sample_id) -> Column:
    """Name of a points file: the given one, else <id>-points.csv."""
    return default(name, F.concat(_c(sample_id), F.lit("-points.csv")))
