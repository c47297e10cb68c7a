"""Paths as columns.

Five ways to normalise stand side by side, because they differ in what ``..`` does; an
operator names the one that it follows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NO_STRINGS = "cast(array() as array<string>)"


def segments(path: Column) -> Column:
    """The non-empty components that are not ``.``."""
    return F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))


def from_segments(segs: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(segs, "/"))


def normalise_popping(path: Column) -> Column:
    """``..`` removes the component before it, and stops at the root."""

    def step(done: Column, s: Column) -> Column:
        return F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))

    return from_segments(F.aggregate(segments(path), F.expr(_NO_STRINGS), step))


def normalise_dropping(path: Column) -> Column:
    """``..`` is left out."""
    return from_segments(F.filter(segments(path), lambda s: s != ".."))


def normalise_keeping(path: Column) -> Column:
    """``..`` stays as a component."""
    return from_segments(segments(path))


def normalise_outer(path: Column) -> Column:
    """Slashes at both ends are trimmed and one put in front; nothing inside changes."""
    return F.concat(F.lit("/"), F.trim(path, F.lit("/")))


def parent(path: Column) -> Column:
    """The directory of a normalised path; the root has none."""
    cut = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(path == "/", F.lit(None)).otherwise(F.when(cut == "", "/").otherwise(cut))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def join(directory: Column, name: Column) -> Column:
    return F.when(F.endswith(directory, F.lit("/")), F.concat(directory, name)).otherwise(F.concat(directory, F.lit("/"), name))


def ancestors(path: Column) -> Column:
    """The strict ancestors of a normalised path but for the root, from the top down."""
    segs = segments(path)
    return F.when(F.size(segs) > 1, F.transform(F.sequence(F.lit(1), F.size(segs) - 1), lambda n: from_segments(F.slice(segs, 1, n)))).otherwise(F.expr(_NO_STRINGS))


def under(path: Column, top: Column) -> Column:
    """Whether path is top or lies in its subtree."""
    return (top == "/") | (path == top) | F.startswith(path, F.concat(top, F.lit("/")))


def depth(path: Column) -> Column:
    return F.size(segments(path))


def separator(kind: Column) -> Column:
    """A format's own separator."""
    return F.when(kind.isin("hfs", "hfs+"), ":").when(kind.isin("fat32", "exfat", "ntfs"), "\\").otherwise("/")


def _swaps(kind: Column) -> Column:
    return kind.isin("hfs", "hfs+")


def to_canonical(path: Column, kind: Column, style: str = "native") -> Column:
    """A path in a format's own style as a slash path; names there may hold ``/``, which becomes ``:``."""
    if style == "unix":
        return path
    sep = separator(kind)
    parts = F.filter(F.split(F.translate(path, "\\", "\x01"), F.when(sep == "\\", "\x01").otherwise(sep)), lambda s: s != "")
    parts = F.transform(parts, lambda s: F.when(_swaps(kind), F.translate(s, "/", ":")).otherwise(F.translate(s, "\x01", "\\")))
    lead = F.when(F.startswith(path, sep), "/").otherwise("")
    return F.when(sep == "/", path).when(path.isin("", "/") | (F.size(parts) == 0), "/").otherwise(F.concat(lead, F.array_join(parts, "/")))


def display_name(name: Column, kind: Column, style: str = "native") -> Column:
    return name if style == "unix" else F.when(_swaps(kind), F.translate(name, ":", "/")).otherwise(name)


def display_path(path: Column, kind: Column, style: str = "native") -> Column:
    if style == "unix":
        return path
    sep = separator(kind)
    parts = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.when(_swaps(kind), F.translate(s, ":", "/")).otherwise(s))
    return F.when(sep == "/", path).otherwise(F.concat(sep, F.aggregate(parts, F.lit(""), lambda a, s: F.when(a == "", s).otherwise(F.concat(a, sep, s)))))


def member_name(path: Column) -> Column:
    """A path as an archive stores it, without leading slashes."""
    return F.ltrim(path, F.lit("/"))


def fits_header(path: Column) -> Column:
    """Whether a member name fits a 100-byte name field, or splits into a 155-byte prefix and it."""
    n = F.octet_length(path)
    cut = F.exists(F.when(n > 100, F.sequence(F.lit(1), F.length(path) - 1)).otherwise(F.expr("cast(array() as array<int>)")),
                   lambda i: (F.substring(path, i, F.lit(1)) == "/") & (F.octet_length(F.substring(path, F.lit(1), i - 1)) <= 155) & (F.octet_length(F.substring(path, F.lit(1), i - 1)) > 0) & (n - F.octet_length(F.substring(path, F.lit(1), i)) <= 100))
    return (n <= 100) | cut


def truncate_left(path: Column, budget: int) -> Column:
    """The last characters of a path that doesn't fit, behind an ellipsis."""
    if budget == 0:
        return F.when(path.isNotNull(), "")
    keep = budget - 1
    return F.when(F.length(path) <= budget, path).otherwise(F.concat(F.lit("…"), F.right(path, F.lit(keep)) if keep else F.lit("")))
