"""Line deduplication by a deletion-neighbourhood join.

Two lines within one edit share a variant: a line itself, or what is left of it without one character. Lines
emit their variants as hashed keys, equal variants meet, the edit distance is verified on the lines, and a line
goes if one like it stands earlier. A substitution leaves the same variant with the gap in the same place; an
insertion or deletion makes the variant of one line the whole of the other. Both need only the earliest line of
a key, so a key that very many lines share costs one row for each of them, never pairs.

Equal lines are one before anything else. A line can only be within one edit of another if one half of it, and all
but one of its eighths, are whole in the other, so only lines that share such stretches with a different line emit
variants.

Order is that of ids (null last), then of a hash of the text, then of lines. Defined results: lines are compared
trimmed of ASCII white space at their ends; blank lines stay and are not compared; lines under ``min_chars`` characters
are compared for equality only; rows that repeat both id and text count as one document and share its fate; null
texts stay null; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import mix64, running_total, slices, table
from attestry.operators.keyed import cut_lineage

MIN_CHARS = 20
#: An odd factor and its inverse modulo 2**64: places of characters in the hash of a variant.
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)
ORDER = ["nulls", "doc_id", "mark", "line_no"]


def variant_hashes(line: str) -> tuple[np.ndarray, int]:
    """Hash of the line without each of its characters in turn, and of the line itself."""
    letters = mix64(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
    with np.errstate(over="ignore"):
        factors = np.full(len(letters), STEP, np.uint64)
        factors[:1] = 1
        powers = np.cumprod(factors)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * powers)])
        without = sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(BACK)
    return mix64(without), int(mix64(sums[-1]))


def occurrences(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``nulls, doc_id, mark, line_no, line``: the lines that are compared, trimmed, with their place in the order."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.select(F.col("doc_id").isNull().cast("int").alias("nulls"), "doc_id", doc_mark(F.col("text")).alias("mark"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.withColumn("line", F.btrim("line", F.lit(" \t\r\x0b\x0c"))).filter("line <> ''")


def doc_mark(text: Column) -> Column:
    return F.xxhash64(F.lit(11), text)


def line_key(line: str | Column) -> list[Column]:
    """128 bits of hash."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2")]


def halves() -> Column:
    """Keys of the stretches of a ``line``, one of which a line one edit away has whole.

    For a pair of lengths m and m or m + 1 the stretches are those of the shorter: its first half, or the rest at
    the end, in long lines cut back to multiples of 8 characters, so that most neighbouring lengths have the same
    two. A line is the shorter, or the longer, of its pair.
    """
    keys = []
    for m in (F.col("size"), F.col("size") - 1):
        step = F.when(m < 64, 1).otherwise(8)
        start = (F.floor(m / (2 * step)) * step).cast("int")
        rest = (F.floor((m - start) / step) * step).cast("int")
        keys += [F.xxhash64(F.lit("start"), F.substring("line", F.lit(1), start)), F.xxhash64(F.lit("end"), F.substring("line", (F.col("size") - rest + 1).cast("int"), rest))]
    return F.array_distinct(F.array(*keys))


def all_but_one(lines: DataFrame, pieces: int = 8) -> DataFrame:
    """``h1, key``: keys of a line without one of its pieces; lines one edit apart share one of them.

    The pieces are those of the shorter line of a pair; what stands before the piece left out is taken from the
    start of a line, what stands after it from its end.
    """
    keys = []
    for m in (F.col("size"), F.col("size") - 1):
        for j in range(pieces):
            before, after = F.floor(m * j / pieces).cast("int"), (m - F.floor(m * (j + 1) / pieces)).cast("int")
            keys.append(F.xxhash64(F.lit(j), m, F.substring("line", F.lit(1), before), F.substring("line", (F.col("size") - after + 1).cast("int"), after)))
    return lines.select("h1", F.explode(F.array(*keys)).alias("key"))


def sharing(keyed: DataFrame, key: str) -> DataFrame:
    """``h1`` of the lines that have a key in common with a different line."""
    # all lines of a key are equal, or some differ: the smallest and the largest tell
    some = keyed.groupBy(key).agg(F.min("h1").alias("_lo"), F.max("h1").alias("_hi")).filter("_lo <> _hi").select(key)
    return keyed.join(some, key).select("h1").distinct()


#: Bits of the bitmap that keeps most other lines out of the join for texts: one megabyte, whatever the data.
SIEVE = 1 << 23


def sieved(lines: DataFrame, near: DataFrame) -> DataFrame:
    """``lines`` without most of those whose ``h1`` is not in ``near``; none that is in it goes.

    The bitmap has a fixed size, so it can be sent to every task; if ``near`` outgrows it, fewer lines are kept out.
    """
    slot = F.pmod(F.col("h1"), F.lit(SIEVE)) + 1
    maps = near.groupBy(F.bitmap_bucket_number(slot).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("_bits"))
    place = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = lines.withColumn("_bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(maps), "_bucket")
    return hit.filter(F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1).drop("_bucket", "_bits")


def variants(lines: DataFrame) -> DataFrame:
    """``variant, gap, rank``: one row for each character left out, and one with gap -1 for the line itself."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            columns: list[list[np.ndarray]] = [[], [], []]
            for row, line in enumerate(batch.column("line").to_pylist()):
                without, whole = variant_hashes(line)
                columns[0].append(np.append(without, np.uint64(whole)).view(np.int64))
                columns[1].append(np.append(np.arange(len(without)), -1))
                columns[2].append(np.full(len(without) + 1, row))
            if columns[0]:
                take = pa.array(np.concatenate(columns[2]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(columns[0])), pa.array(np.concatenate(columns[1]), pa.int32()), batch.column("rank").take(take)],
                    ["variant", "gap", "rank"],
                )

    return lines.select("line", "rank").mapInArrow(work, "variant long, gap int, rank long")


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``nulls, doc_id, mark, line_no``: the lines of which an earlier one is equal or one edit away.

    Runs jobs while the plan is built: the first occurrences and the lines that share a half are written.
    """
    found = occurrences(docs, doc_id, text)
    size = F.length("line").alias("size")
    narrow = found.select("line", size, *line_key("line"), *ORDER)
    stretches = F.when(F.col("size") >= min_chars, halves()).alias("halves")
    keyed = cut_lineage(narrow.select("h1", "h2", *ORDER, stretches))
    firsts = cut_lineage(keyed.groupBy("h1", "h2").agg(F.min(F.struct(*ORDER)).alias("first"), F.count("*").alias("times")))
    near = cut_lineage(sharing(keyed.select("h1", F.explode("halves").alias("half")), "half"))
    # the text of those lines, at their first place only
    at_first = sieved(narrow.withColumn("place", F.struct(*ORDER)), near)
    firsts_near = near.join(firsts, "h1").select("h1", "h2", F.col("first").alias("place"))
    close = at_first.select("h1", "h2", "place", "line", "size").join(firsts_near, ["h1", "h2", "place"]).dropDuplicates(["h1", "h2"])
    close = cut_lineage(close.withColumn("one", F.lit(1).cast("long")))
    # of them those that have all but an eighth in common with another, numbered in order
    closer = close.join(sharing(all_but_one(close), "key"), "h1", "left_semi")
    ranked = running_total(closer.select("place.*", "h1", "h2", "line", "one"), [*ORDER, "h1"], "one", "rank").select("rank", "h1", "h2", "line")
    ranked = cut_lineage(ranked)
    all_ = cut_lineage(variants(ranked))

    holes = all_.filter("gap >= 0")
    # substitution: the same variant with the gap in the same place; the earliest of a key is enough
    same_gap = holes.groupBy("variant", "gap").agg(F.min("rank").alias("other"), F.count("*").alias("_n")).filter("_n > 1")
    by_gap = holes.join(same_gap, ["variant", "gap"]).filter("other < rank").select("rank", "other")
    # insertion or deletion: the variant of one line is the whole of the other
    whole = all_.filter("gap < 0").select("variant", F.col("rank").alias("other"))
    meets = holes.join(whole, "variant").select("rank", "other")
    longer = meets.filter("other < rank")
    shorter = meets.filter("rank < other").groupBy(F.col("other").alias("_w")).agg(F.min("rank").alias("other")).withColumnRenamed("_w", "rank")
    pairs = by_gap.union(longer).union(shorter.select("rank", "other")).distinct()
    texts = ranked.select("rank", "line")
    checked = pairs.join(texts, "rank").join(texts.select(F.col("rank").alias("other"), F.col("line").alias("earlier")), "other")
    late = checked.filter(F.levenshtein("line", "earlier", 1) >= 0).select("rank").distinct()
    gone = late.join(ranked.select("rank", "h1", "h2"), "rank").select("h1", "h2", F.lit(True).alias("like_earlier"))

    fate = firsts.join(gone, ["h1", "h2"], "left").filter("times > 1 or like_earlier")
    hit = keyed.select("h1", "h2", *ORDER).join(fate, ["h1", "h2"]).filter(F.coalesce("like_earlier", F.lit(False)) | (F.struct(*ORDER) > F.col("first")))
    return hit.select(*ORDER).distinct()


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the text that is left and with ``lines_in, lines_dropped``, in place of columns of these names; no document goes."""
    gone = cut_lineage(dropped_lines(docs, min_chars, doc_id, text))
    per_doc = gone.groupBy("nulls", "doc_id", "mark").agg(F.collect_list("line_no").alias("_gone"))  # at most the lines of one document
    per_doc = per_doc.select(F.coalesce("doc_id", F.lit(0)).alias("_k"), F.col("nulls").alias("_n"), F.col("mark").alias("_m"), "_gone")
    ids, whole = F.col(doc_id).cast("long"), F.col(text).cast("string")
    kept = [c for c in docs.columns if c.lower() not in ("lines_in", "lines_dropped")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), whole.alias("_text"), F.coalesce(ids, F.lit(0)).alias("_k"), ids.isNull().cast("int").alias("_n"), doc_mark(whole).alias("_m"))
    joined = rows.join(per_doc, ["_k", "_n", "_m"], "left")
    lines = F.split("_text", "\n")
    left = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains("_gone", i)), "\n")
    new = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(left)
    same = [new.alias(c) if c.lower() == text.lower() else F.col(f"_row.`{c}`") for c in kept]
    return joined.select(*same, F.when(F.col("_text").isNull(), 0).otherwise(F.size(lines)).alias("lines_in"), F.coalesce(F.size("_gone"), F.lit(0)).alias("lines_dropped"))


def op3_line_dedup(spark, folder: str) -> DataFrame:
    found = dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "lines_in", "lines_dropped", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))
