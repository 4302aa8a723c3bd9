"""Text columns: line ends, digests, canonical JSON, XML escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "missing"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalize_eol(col: Column | str) -> Column:
    """CRLF and lone CR become LF."""
    return F.regexp_replace(_c(col), "\r\n?", "\n")


def sha256_text(col: Column | str) -> Column:
    return F.sha2(F.encode(_c(col), "UTF-8"), 256)


def content_hash(col: Column | str) -> Column:
    """Digest of text with line ends made equal."""
    return sha256_text(normalize_eol(col))


def json_string(col: Column | str) -> Column:
    """A JSON string literal; control escapes in lower-case hex."""
    raw = F.to_json(F.struct(_c(col).alias("v")))
    plain = F.substring(raw, F.lit(6), F.length(raw) - 6)
    # the writer gives upper-case hex; escaped backslashes are put aside first, so that what is left of \u00 is an escape
    mark = "\ue000"
    aside = F.replace(F.replace(plain, F.lit(mark), F.lit(mark + "0")), F.lit("\\\\"), F.lit(mark + "1"))
    for high in "01":
        for low in "ABCDEF":
            aside = F.replace(aside, F.lit(f"\\u00{high}{low}"), F.lit(f"\\u00{high}{low.lower()}"))
    back = F.replace(F.replace(aside, F.lit(mark + "1"), F.lit("\\\\")), F.lit(mark + "0"), F.lit(mark))
    return F.when(plain.contains("\\u00"), back).otherwise(plain)


def json_object(**fields: Column) -> Column:
    """JSON object text from ready-made JSON values: keys in code-point order, null values left out."""
    parts = [
        F.when(value.isNotNull(), F.concat(F.lit(f'"{key}":'), value))
        for key, value in sorted(fields.items())
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def escape_xml(col: Column | str, attribute: bool = False) -> Column:
    """Entities for markup characters and for control characters other than tab, LF and CR."""
    c = _c(col)
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit("<"), F.lit("&lt;"))
    c = F.replace(c, F.lit(">"), F.lit("&gt;"))
    if attribute:
        c = F.replace(c, F.lit('"'), F.lit("&quot;"))
    plain = c
    for code in (*range(0x0, 0x9), 0xB, 0xC, *range(0xE, 0x20)):
        c = F.replace(c, F.lit(chr(code)), F.lit(f"&#x{code:02x};"))
    return F.when(plain.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), c).otherwise(plain)


def utf16_length(col: Column | str) -> Column:
    """Length in UTF-16 units: astral characters count twice."""
    c = _c(col)
    return (F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("long")


def tail_truncate(col: Column | str, max_bytes: int = 1 << 20) -> Column:
    """Newest part of a text within a byte limit, cut at a ``## [`` entry, else at a line start.

    Without either the tail begins wherever the limit falls; bytes of a character cut in two become U+FFFD.
    """
    c = _c(col)
    raw = F.encode(c, "UTF-8")
    tail = F.substring(raw, F.octet_length(raw) - max_bytes + 1, F.lit(max_bytes)).cast("string")
    entry, line = F.instr(tail, "\n## ["), F.instr(tail, "\n")
    start = F.when(entry > 0, entry).otherwise(line) + 1
    return F.when(F.octet_length(c) > max_bytes, F.make_valid_utf8(F.substring(tail, start, F.length(tail)))).otherwise(c)
