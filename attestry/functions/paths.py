"""Path columns: normal form, ancestor prefixes, globs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def normalize_path(col: Column | str) -> Column:
    """Mapping form: trimmed, forward slashes, no leading ``./`` (one) and no trailing slashes."""
    c = F.trim(F.col(col) if isinstance(col, str) else col)
    c = F.translate(c, "\\", "/")
    c = F.regexp_replace(c, r"^\./", "")
    return F.regexp_replace(c, r"/+$", "")


def posix_path(col: Column | str) -> Column:
    """Output form: forward slashes and nothing else."""
    return F.translate(F.col(col) if isinstance(col, str) else col, "\\", "/")


def normalize_root(col: Column | str) -> Column:
    """Coverage-root form: no slash at either end, no doubled slashes; the whole tree is ``""``."""
    c = posix_path(F.trim(F.col(col) if isinstance(col, str) else col))
    c = F.regexp_replace(F.regexp_replace(c, r"^/+", ""), r"/+$", "")
    return F.regexp_replace(c, r"/{2,}", "/")


def path_prefixes(col: Column | str, with_self: bool = True) -> Column:
    """Ancestor prefixes of a slash path, shortest first."""
    c = F.col(col) if isinstance(col, str) else col
    parts = F.split(c, "/")
    n = F.size(parts) if with_self else F.size(parts) - 1
    steps = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def parent_path(col: Column | str) -> Column:
    """Directory part of a path, ``""`` at the top."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, r"/?[^/]*$", "")


def base_name(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.substring_index(c, "/", -1)


def extension(col: Column | str) -> Column:
    """Lower-case extension with its dot, ``""`` if the base name has none (dot files have none)."""
    return F.lower(F.regexp_extract(base_name(col), r"^.+(\.[^.]*)$", 1))


def depth(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.size(F.split(c, "/"))


def is_glob(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.contains("*")


def _segment_regex(seg: str) -> str:
    if seg == "*":
        return "[^/]+"
    out, i = [], 0
    while i < len(seg):
        ch = seg[i]
        if ch == "*":
            while i + 1 < len(seg) and seg[i + 1] == "*":
                i += 1
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif ch == "[" and "]" in seg[i + 2:]:
            end = seg.index("]", i + 2)
            body = seg[i + 1:end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            i = end
        elif ch == "{" and "," in seg[i:] and "}" in seg[i:]:
            end = seg.index("}", i)
            out.append("(?:" + "|".join(_segment_regex(p) for p in seg[i + 1:end].split(",")) + ")")
            i = end
        else:
            out.append(re.sub(r"([.^$+(){}\[\]|\\])", r"\\\1", ch))
        i += 1
    return "".join(out)


def glob_to_regex(glob: str) -> str:
    """Anchored regex of a glob: ``*`` stays in a segment, ``**`` as a segment crosses them."""
    segs = glob.split("/")
    out = []
    for i, seg in enumerate(segs):
        last = i == len(segs) - 1
        if seg == "**":
            out.append(".+" if last else "(?:[^/]+/)*")
        else:
            out.append(_segment_regex(seg) + ("" if last else "/"))
    return "^" + "".join(out) + "$"


@F.pandas_udf(StringType())
def glob_regex(globs: pd.Series) -> pd.Series:
    """Regex of each glob of a mapping table; the table is small next to the files."""
    return globs.map(lambda g: None if g is None else glob_to_regex(g))


def static_prefix(col: Column | str) -> Column:
    """Leading segments of a glob before its first ``*`` segment, ``""`` if there are none."""
    c = F.col(col) if isinstance(col, str) else col
    head = F.regexp_extract(c, r"^([^*]*)", 1)
    return F.when(head.contains("/"), F.regexp_replace(head, r"/[^/]*$", "")).otherwise("")


def unit_of_node(node: Column | str) -> Column:
    return F.concat(F.lit("node:"), F.col(node) if isinstance(node, str) else node)


def unit_of_file(path: Column | str) -> Column:
    return F.concat(F.lit("file:"), posix_path(path))


def split_key(key: Column | str) -> tuple[Column, Column]:
    """Kind and target of a ``kind:target`` key; the target may hold colons itself."""
    c = F.col(key) if isinstance(key, str) else key
    return F.substring_index(c, ":", 1), F.regexp_replace(c, r"^[^:]*:", "")


def observation_key(kind: str | Column, target: Column) -> Column:
    return F.concat(F.lit(kind) if isinstance(kind, str) else kind, F.lit(":"), target)
