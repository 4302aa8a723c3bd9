"""Packing along a space-filling curve: documents with like tokens lie near each other and share sequences.

Each document becomes token ids; its hashed token counts are projected to a few dimensions, whose place on a
Hilbert curve is a number. Documents are laid end to end in the order of that number and cut every ``length``
tokens, so only the last sequence can need padding.

Defined results: a null text is an empty one and gives its end mark alone; documents with equal keys (repeated
rows) follow by id, then by row; columns of any name besides those asked for are not looked at; no rows give no
pieces.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import mix64, running_total, slices, table
from attestry.operators.keyed import cut_lineage

DIMS, BITS = 4, 10
END = 0
_CODERS: dict = {}


def coder(path: str, pattern: str):
    """The byte-level BPE of a rank file; one per Python worker. Its ids equal those of the JSON form but for added tokens."""
    if path not in _CODERS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _CODERS[path] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _CODERS[path]


def exact_coder(path: str):
    """The vocabulary in its JSON form and the tokens added to it, which are matched in texts; one per Python worker."""
    if path not in _CODERS:
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        _CODERS[path] = made, [t.content for t in made.get_added_tokens_decoder().values()]
    return _CODERS[path]


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each row of ``points`` (whole numbers below 2**bits) on the Hilbert curve of that many dimensions."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of the sub-cubes, from the largest down
        p = q - 1
        for i in range(n):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(turned, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def directions(vocabulary: int, dims: int = DIMS) -> np.ndarray:
    """One signed unit per token and dimension: hashing to a vector and projecting it, in one table."""
    cells = mix64(np.arange(vocabulary * dims, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return np.where((cells >> np.uint64(63)).astype(bool), 1.0, -1.0).reshape(vocabulary, dims)


def place(ids: np.ndarray, table_: np.ndarray) -> np.ndarray:
    """The document's vector (token counts under a square root, length one) in a few dimensions, as whole numbers."""
    kinds, counts = np.unique(ids, return_counts=True)
    weights = np.sqrt(counts)
    flat = (weights @ table_[kinds]) / max(np.sqrt((weights**2).sum()), 1.0)
    return np.clip(((flat + 3.0) / 6.0 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)


def tokenise(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", exact: str | None = None) -> DataFrame:
    """``doc_id, row, key, n, ids``: ids of the whole text and the end mark as two bytes each, little-endian.

    With ``exact``, the JSON form of the vocabulary, an added token that stands in a text gets its one id, as
    ``Tokenizer.encode`` gives it; without, it is a text like any other.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary = coder(path, pattern).encode_ordinary
        slow, added = exact_coder(exact) if exact else (None, [])

        def encode(value: str) -> list[int]:
            # the slower library only where the two differ
            return slow.encode(value, add_special_tokens=False).ids if any(t in value for t in added) else ordinary(value)

        dirs = directions(1 << 16)
        for batch in slices(batches):
            kept, places, sizes = [], [], []
            for value in batch.column(1).to_pylist():
                ids = np.array([*encode(value or ""), END], np.uint16)
                places.append(place(ids[:-1], dirs))
                kept.append(ids.astype("<u2").tobytes())
                sizes.append(len(ids))
            keys = hilbert_key(np.array(places)) if places else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "row", "key", "n", "ids"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(work, "doc_id long, row long, key long, n long, ids binary")


def checksum(ids: bytes) -> int:
    """CRC of ids of two bytes each as little-endian 32-bit numbers."""
    return zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes())


def pack(
    docs: DataFrame, path: str, pattern: str, length: int = 1024, doc_id: str = "doc_id", text: str = "text", exact: str | None = None, digests: bool = False
) -> DataFrame:
    """Pieces: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``, with the ids of each piece as two bytes each.

    Token ids are written once to the shared folder; only ``row, key, n`` are sorted, and the place of each
    document is joined back. With ``digests`` a piece has ``ids_crc32``, as ``digest`` gives it, in place of the ids: its
    ids then never leave the task that cuts them, and a task has one Python worker, not two.
    """
    name, kind, of = ("ids_crc32", pa.int64(), checksum) if digests else ("ids", pa.binary(), bytes)
    coded = cut_lineage(tokenise(docs, path, pattern, doc_id, text, exact))
    order = coded.select("doc_id", "row", "key", "n")
    placed = running_total(order, ["key", "doc_id", "row"], "n", "at").select("row", "at")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[] for _ in range(7)]
            for key, n, ids, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids", "at")), strict=True):
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(length - offset, n - start)
                    for column, value in zip(out, (key, start, size, of(ids[2 * start : 2 * (start + size)]), n, sequence, offset), strict=True):
                        column.append(value)
                    start += size
            kinds = [pa.int64(), pa.int64(), pa.int64(), kind, pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "start", "length", name, "doc_tokens", "sequence_id", "offset"])

    return coded.select("row", "doc_id", "n", "ids").join(placed, "row").mapInArrow(
        cut, f"doc_id long, start long, length long, {name} {'long' if digests else 'binary'}, doc_tokens long, sequence_id long, offset long"
    )


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC of their ids as little-endian 32-bit numbers in place of the ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [checksum(v) for v in batch.column("ids").to_pylist()]
            columns = [pa.array(sums, pa.int64()) if name == "ids" else batch.column(name) for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, ["ids_crc32" if name == "ids" else name for name in batch.schema.names])

    return pieces.mapInArrow(work, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def vocabulary() -> tuple[str, str]:
    """Path of the public rank file and the pattern that splits a text."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def exact_vocabulary() -> str:
    """Path of the same vocabulary in its JSON form."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_packing(spark, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), *vocabulary(), exact=exact_vocabulary(), digests=True)
