"""Joins, groups and loops that hold up when one key carries a third of the rows."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.functions.paths import glob_regex, is_glob, normalize_path, static_prefix

SALTS_CONF = "attestry.skew.salts"


def salts_of(df: DataFrame) -> int:
    """How many ways a hot key is split: ``attestry.skew.salts``, else the number of shuffle partitions up to 64."""
    partitions = df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")
    return int(df.sparkSession.conf.get(SALTS_CONF, str(max(1, min(64, int(partitions))))))


def salt_of(df: DataFrame, n: int) -> Column:
    """A salt that depends on the row alone, so a retried task gives the same one."""
    atomic = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))]
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in atomic]), F.lit(n)).cast("int")


#: Estimated bytes up to which a side is broadcast by ``salted_join``, and bytes that its copies for the salts may take.
BROADCAST_BYTES = 512 * 1024
COPIES_BYTES = 16 * 1024 * 1024
#: Bytes read for each shuffle partition of a job that writes a table, bytes shuffled to one after joining small ones, most partitions.
PARTITION_BYTES = 16 * 1024 * 1024
SHUFFLED_BYTES = 16 * 1024 * 1024
MOST_PARTITIONS = 4096


def estimated_bytes(df: DataFrame) -> int:
    """Size that the planner expects, from the files read; unknown sizes are very large. Runs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def read_bytes(df: DataFrame) -> int:
    """Bytes of files and local rows that a plan reads, those read twice counted twice; unknown sizes are left out. Runs no job."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)


def parts_of(df: DataFrame) -> int:
    """One shuffle partition for each ``PARTITION_BYTES`` that a plan reads."""
    return min(read_bytes(df) // PARTITION_BYTES, MOST_PARTITIONS)


def dealt_by(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` dealt by ``keys`` to ``parts_of`` partitions, for a group-by in a final plan; as they are if the session has as many anyway."""
    parts = parts_of(rows)
    return rows.repartition(parts, *keys) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def _bytes(text: str) -> int:
    number, unit = re.fullmatch(r"(-?\d+)([kmgt]?)b?", text.strip().lower()).groups()
    return int(number) * 1024 ** " kmgt".index(unit or " ")


@contextmanager
def small_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Inside, the planner broadcasts a side by itself only up to ``BROADCAST_BYTES``; for jobs that run at once."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    # a session may have a lower limit or none at all, which stays
    if _bytes(before) > BROADCAST_BYTES:
        spark.conf.set(name, str(BROADCAST_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def sized_shuffles(rows: DataFrame) -> Iterator[None]:
    """Settings for the job that writes ``rows``, which runs inside: ``small_broadcasts``, and small shuffle partitions.

    There is one for each ``PARTITION_BYTES`` that the plan reads, and at least as many as the session asks for, so that
    a task holds no more as tables grow; those joined again take ``SHUFFLED_BYTES`` at most.
    """
    conf = rows.sparkSession.conf
    size, first = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = {name: conf.get(name, None) for name in (size, first)}
    if _bytes(conf.get(size)) > SHUFFLED_BYTES:
        conf.set(size, str(SHUFFLED_BYTES))
    parts = parts_of(rows)
    if parts > int(before[first] or conf.get("spark.sql.shuffle.partitions")):
        conf.set(first, str(parts))
    try:
        with small_broadcasts(rows.sparkSession):
            yield
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


def shuffled_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join of two data-sized sides by a shuffle of both, unless one is tiny."""
    if estimated_bytes(right) <= BROADCAST_BYTES or (how == "inner" and estimated_bytes(left) <= BROADCAST_BYTES):
        return left.join(right, on, how)
    return left.join(right.hint("merge"), on, how)


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join of a data-sized side with one that should be catalogue-sized.

    A tiny side is broadcast as it is. Else rows of ``big`` with one key spread over salts and ``small`` is repeated
    once per salt, by a shuffle; salts are as many as keep the copies within ``COPIES_BYTES``, so a side that has grown
    with the data is not copied at all and its hot keys are left to the skew handling of adaptive execution. Sizes are
    those of compressed files and say little about memory, so the planner may not broadcast what it thinks is small.
    Each row of ``big`` meets each row of ``small`` once, so inner, left, left_semi and left_anti keep their meaning.
    """
    size = estimated_bytes(small)
    if size <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), on, how)
    other = estimated_bytes(big) if how == "inner" else None
    if other is not None and other <= BROADCAST_BYTES:
        return F.broadcast(big).join(small, on, how)
    n = min(salts_of(big), COPIES_BYTES // size)
    if n <= 1:
        return big.join(small.hint("merge"), on, how)
    left = big.withColumn("_salt", salt_of(big, n))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return left.join(right.hint("merge"), [*on, "_salt"], how).drop("_salt")


def weighted_join(big: DataFrame, small: DataFrame, on: list[str], weight: str, how: str = "inner", parts: int = 256) -> DataFrame:
    """Equi-join with a written table that has one row per key and, in ``weight``, how many rows of ``big`` have it.

    A key with more than one part in ``parts`` of all rows is split in proportion to its weight, every other one
    stays whole: ``small`` grows by less than ``2 * parts`` rows, and the list of split keys, which is broadcast,
    has fewer than ``parts``. ``weight`` is not in the result.
    """
    total = small.agg(F.sum(weight)).first()[0] or 0
    split = F.ceil(F.col(weight) * parts / F.lit(float(max(total, 1)))).cast("int")
    n = F.when(F.col(weight) * parts > total, split).otherwise(F.lit(1))
    heavy = small.filter(F.col(weight) * parts > total).select(*on, n.alias("_n"))
    hashed = F.xxhash64(*[F.col(f"`{f.name}`") for f in big.schema.fields if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))])
    left = big.join(F.broadcast(heavy), on, "left").withColumn("_salt", F.coalesce(F.pmod(hashed, F.col("_n")), F.lit(0)).cast("int")).drop("_n")
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1))).drop(weight)
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors reach, from ``spark.checkpoint.dir``; a local session without one gets a temporary one."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="attestry-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame, done: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Write a loop state to the shared folder and go on from the table.

    The loss of an executor then costs no earlier round, and the planner knows the size of the state, so a
    small one is broadcast and a large one is not. ``done`` are earlier states that nothing reads from here on;
    their folders go once this one is written. Other frames among them are left alone.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/attestry-state/{uuid.uuid4().hex}"
    for scope in _SCOPES.get():
        scope.append(path)
    with sized_shuffles(df):
        df.write.parquet(path)
    give_back(spark, [p for p in (getattr(d, "_state_path", None) for d in done) if p])
    state = spark.read.schema(df.schema).parquet(path)
    state._state_path = path
    return state


#: Lists that take down the folders of states, one for each open scope.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def states() -> Iterator[list[str]]:
    """Folders of the states written inside, for the caller to give back when nothing reads them any more."""
    mine: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), mine))
    try:
        yield mine
    finally:
        _SCOPES.reset(token)


def give_back(spark: SparkSession, folders: Iterable[str]) -> None:
    """Delete folders below the shared one; those that are gone are passed over."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def entry_keys(entries: DataFrame, entry: str = "entry") -> DataFrame:
    """Entries in normal form with their join key and, for globs, their regex. Empty entries are dropped."""
    e = entries.withColumn(entry, normalize_path(entry)).filter(F.col(entry) != "")
    glob = is_glob(entry)
    return e.withColumn("_key", F.when(glob, static_prefix(entry)).otherwise(F.col(entry))).withColumn(
        "_regex", F.when(glob, glob_regex(F.when(glob, F.col(entry))))
    )


def path_keys(files: DataFrame, path: str = "path") -> DataFrame:
    """One row per ancestor prefix of a path, the root ``""`` and the path itself included."""
    from attestry.functions.paths import path_prefixes

    return files.withColumn("_key", F.explode(F.concat(F.array(F.lit("")), path_prefixes(path))))


def entry_matches_file(files: DataFrame, entries: DataFrame, path: str = "path", entry: str = "entry") -> DataFrame:
    """Every (file, entry) match: exact, directory or glob.

    Files are spread over their prefixes and meet the entries by equality; a glob meets the files below its
    static prefix and is tested there by regex.
    """
    keyed = entry_keys(entries, entry)
    found = salted_join(path_keys(files, path), keyed, ["graph_id", "_key"])
    return found.filter(F.col("_regex").isNull() | F.expr(f"`{path}` rlike `_regex`")).drop("_key", "_regex")


def set_digest(rows: DataFrame, keys: list[str], line: Column, name: str = "digest", mark: str | None = None) -> DataFrame:
    """Order-free digest of the lines of each group, with one definition at every size.

    Lines fall into blocks by the first three hex digits of their sha256. A block's digest is that of its sorted
    lines joined by newlines; the group's is that of its ``block:digest`` lines, sorted and joined by newlines. A
    task holds one block of a group, not the group. With ``mark``, ``_marked`` says whether that line is in the group.
    """
    lines = rows.select(*keys, line.alias("_line"))
    block = F.substring(F.sha2(F.encode("_line", "UTF-8"), 256), 1, 3)
    joined = lambda c: F.sha2(F.encode(F.array_join(F.array_sort(F.collect_list(c)), "\n"), "UTF-8"), 256)
    has = [] if mark is None else [F.bool_or(F.col("_line") == mark).alias("_marked")]
    per_block = lines.groupBy(*keys, block.alias("_block")).agg(joined("_line").alias("_d"), *has)
    any_ = [] if mark is None else [F.bool_or("_marked").alias("_marked")]
    return per_block.groupBy(*keys).agg(joined(F.concat_ws(":", "_block", "_d")).alias(name), *any_)


def first_by(rows: DataFrame, keys: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """The row of each group that comes first in ``order``; a plain aggregate with partial combine."""
    ranked = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*keep), ranked).alias("_first"))
    return picked.select(*keys, "_first.*")


def top_n(rows: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per group.

    Ranks within salts first: each salted part passes on at most ``n`` rows, so a hot group is never ranked
    whole in one task.
    """
    from pyspark.sql import Window

    salts = salts_of(rows)
    part = rows.withColumn("_salt", salt_of(rows, salts))
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
    w2 = Window.partitionBy(*keys).orderBy(*order)
    cut = part.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= n).drop("_r", "_salt")
    return cut.withColumn(rank, F.row_number().over(w2)).filter(F.col(rank) <= n)


def running_total(rows: DataFrame, order: list[str], amount: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``amount`` over each row and all before it, in the order given.

    Rows are dealt by range, written, and summed inside each range; one number per range crosses ranges.
    """
    from pyspark.sql import Window

    ranged = cut_lineage(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    # one row per range: as many as there are shuffle partitions, whatever the data
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.sum(amount).alias("_size"))
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn(name, F.sum(amount).over(inside))
    return summed.join(F.broadcast(starts), "_range").withColumn(name, F.col(name) + F.col("_start")).drop("_range", "_start")
