"""Encoding with a merge-type SentencePiece vocabulary by an agenda of adjacent symbol pairs, and decoding.

A text in normal form is a row of one-character symbols. All adjacent pairs whose joined text is in the vocabulary
stand on an agenda ordered by score, then by place; the first is merged, and the pairs it makes join the agenda,
until it is empty. A symbol that is no piece becomes its bytes. Each Arrow batch is encoded by the library as well,
and ``agrees`` says for each row whether both give the same ids.

Where no piece of the vocabulary has two characters side by side, no merge crosses the place between them. Texts
are cut there, and a worker remembers the ids of cuts it has met, up to a bound.

Defined results: a null text is an empty one, and an empty text has no ids and decodes to an empty text; very long
texts are encoded whole, in time that grows as n log n without a place to cut; each row is encoded by itself, so
repeated rows and ties between equal scores (the leftmost pair goes first) give equal ids; columns besides the two
asked for are not looked at, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import slices, table

#: Cuts whose ids a worker remembers; texts of any number are encoded alike.
REMEMBERED = 1 << 18
#: Stretches up to these many characters take their merges side by side, longer ones have a heap of their own.
WIDTHS = (6, 10, 16, 32)
BITS = 21  # of a symbol's number: a piece, or a character behind the pieces
MASK, NONE = (1 << BITS) - 1, 1 << 62
SPACE = "▁"  # how pieces write a space
_VOCABULARIES: dict[str, MergeVocabulary] = {}


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


class MergeVocabulary:
    """Pieces of a merge-type model with byte fallback, and the library's processor for the same file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = sp = SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        if any(sp.is_unused(i) for i in ids) or sum(sp.is_byte(i) for i in ids) != 256:
            raise ValueError("the vocabulary needs pieces for all bytes and none that is unused")
        usual = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.ids = {sp.id_to_piece(i): i for i in usual}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        places = {s: n for n, s in enumerate(sorted({sp.get_score(i) for i in usual}, reverse=True))}
        self.order = {p: places[sp.get_score(i)] for p, i in self.ids.items()}
        self._pieces = list(ids)
        self._codes = np.arange(0x110000, dtype=np.int64) + len(ids)  # a character that is no piece has a number behind the pieces
        for p, i in self.ids.items():
            if len(p) == 1:
                self._codes[ord(p)] = i
        code = lambda s: self.ids.get(s, self._codes[ord(s)] if len(s) == 1 else -1)
        pairs = {(code(p[:k]), code(p[k:])): self.order[p] << BITS | i for p, i in self.ids.items() for k in range(1, len(p))}
        made = sorted((int(a) << BITS | int(b), m) for (a, b), m in pairs.items() if a >= 0 and b >= 0)
        self._keys, self._made = np.array(made, np.int64).reshape(-1, 2).T.copy()
        self._cuts = self._pattern([p for p in self.ids if len(p) > 1])
        self._known: dict[str, bytes] = {}

    @staticmethod
    def _pattern(pieces: list[str]) -> re.Pattern | None:
        """Stretches that no merge leaves: characters that occur in longer pieces, from one space to the next; any other stands alone."""
        if any(a != SPACE and b == SPACE for p in pieces for a, b in zip(p, p[1:], strict=False)):
            return None
        inner = "".join(re.escape(c) for c in sorted(set("".join(pieces)) - {SPACE}))
        return re.compile(f"{SPACE}*[{inner}]+|{SPACE}+|.", re.DOTALL)

    def merge(self, text: str) -> bytes:
        """Packed ids of a stretch: the best pair of the agenda is merged until none is left."""
        symbols, order, end = list(text), self.order, len(text)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        agenda = [(order[p], i, p) for i, p in enumerate(map(str.__add__, symbols, symbols[1:])) if p in order]
        heapify(agenda)
        while agenda:
            _, i, piece = heappop(agenda)
            j = after[i]
            if j == end or not symbols[i] or symbols[i] + symbols[j] != piece:
                continue  # one of the two was merged meanwhile
            symbols[i], symbols[j] = piece, ""
            after[i] = k = after[j]
            if k != end:
                before[k] = i
                if (right := piece + symbols[k]) in order:
                    heappush(agenda, (order[right], i, right))
            if (h := before[i]) >= 0 and (left := symbols[h] + piece) in order:
                heappush(agenda, (order[left], h, left))
        out: list[int] = []
        for s in symbols:
            if s:
                found = self.ids.get(s)
                out.extend([self.bytes[b] for b in s.encode()] if found is None else [found])
        return _packed(out)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Score's place and piece that two symbols make, as one number each; ``NONE`` where they make no piece."""
        key = left << BITS | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((self._keys[at] == key) & (left >= 0) & (right >= 0), self._made[at], NONE)

    def merge_all(self, cuts: list[str], width: int) -> list[bytes]:
        """Packed ids of stretches of ``width`` characters at most: a row of symbols and an agenda each, one merge a row and round."""
        chars = np.frombuffer("".join(c.ljust(width, "\0") for c in cuts).encode("utf-32-le"), np.uint32).reshape(-1, width)
        length = np.fromiter(map(len, cuts), np.int64, len(cuts))
        place = np.arange(width)
        symbols = np.where(place < length[:, None], self._codes[chars], -1)
        agenda = self._pairs(symbols[:, :-1], symbols[:, 1:])
        done, rows = symbols.copy(), np.arange(len(cuts))
        while len(rows):
            best = (agenda >> BITS).argmin(1)  # the first of equal scores
            made = agenda[np.arange(len(rows)), best]
            live = made < NONE
            done[rows[~live]] = symbols[~live]
            rows, symbols, agenda, best, made = rows[live], symbols[live], agenda[live], best[live], made[live] & MASK
            every, stays = np.arange(len(rows)), place <= best[:, None]
            symbols = np.where(stays, symbols, self._shifted(symbols, -1))
            symbols[every, best] = made
            agenda = np.where(stays[:, :-1], agenda, self._shifted(agenda, NONE))
            agenda[every, best] = self._pairs(made, symbols[every, best + 1])
            inner = np.flatnonzero(best)
            agenda[inner, best[inner] - 1] = self._pairs(symbols[inner, best[inner] - 1], made[inner])
        flat, ends = done[done >= 0].astype(np.int32).tobytes(), (4 * np.cumsum((done >= 0).sum(1))).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        for i in np.flatnonzero((done >= len(self._pieces)).any(1)).tolist():
            out[i] = _packed([x for s in done[i][done[i] >= 0].tolist() for x in self._spell(s)])
        return out

    @staticmethod
    def _shifted(rows: np.ndarray, last: int) -> np.ndarray:
        """Each row without its first entry, and ``last`` at its end."""
        out = np.full_like(rows, last)
        out[:, :-1] = rows[:, 1:]
        return out

    def _spell(self, symbol: int) -> list[int]:
        """The id of a piece, or those of a character's bytes."""
        return [symbol] if symbol < len(self._pieces) else [self.bytes[b] for b in chr(symbol - len(self._pieces)).encode()]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        known = self._known
        cut = [self._cuts.findall(n) if self._cuts else [n] for n in map(self.library.normalize, texts)]
        fresh = sorted(set(chain.from_iterable(cut)).difference(known), key=len)
        at = 0
        for width in WIDTHS:
            end = bisect_right(fresh, width, at, key=len)
            if end > at:
                known.update(zip(fresh[at:end], self.merge_all(fresh[at:end], width), strict=True))
            at = end
        known.update((c, self.merge(c)) for c in fresh[at:])
        out = [np.frombuffer(b"".join(map(known.__getitem__, c)), np.int32) for c in cut]
        for c in fresh[max(0, REMEMBERED - len(known) + len(fresh)) :] if len(known) > REMEMBERED else fresh[at:]:
            known.pop(c)
        return out


def vocabulary(path: str) -> MergeVocabulary:
    """The vocabulary of a model file; one per Python worker."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = MergeVocabulary(path)
    return _VOCABULARIES[path]


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids, decoded, agrees``: ids of each text, the text they decode to, and whether the library gives the same ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = words.encode(texts)
            library = words.library.encode(texts, num_threads=1)
            agrees = [np.array_equal(a, np.array(b, np.int32)) for a, b in zip(found, library, strict=True)]
            same = [b if equal else a.tolist() for equal, a, b in zip(agrees, found, library, strict=True)]
            decoded = words.library.decode(same, num_threads=1)
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(ends, np.concatenate([*found, np.zeros(0, np.int32)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())], ["doc_id", "ids", "decoded", "agrees"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, ids array<int>, decoded string, agrees boolean")


def model() -> str:
    """Path of the public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op13_sentencepiece(spark, folder: str) -> DataFrame:
    written = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return encode(table(spark, folder, "documents"), model()).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(written, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "agrees",
    )
