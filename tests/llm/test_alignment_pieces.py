"""Alignment and piece encoding against loops over plain Python and the libraries."""

import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attestry.llm import alignment, packing, pieces
from attestry.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, copies int, key string, ids string, a int"
EMPTY = hashlib.sha256(b"").hexdigest()


def loops(docs: list[tuple[int, str | None]]) -> set[tuple]:
    """The contract of the alignment by plain loops, with the JSON form of the first vocabulary."""
    import sentencepiece
    from tokenizers import Tokenizer

    left = Tokenizer.from_file(packing.exact_vocabulary())
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=pieces.model())
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies write as themselves
    byte = {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in keep)}

    def spell(i):
        p = right.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if right.is_byte(i) else p.replace("▁", " ").encode()

    rows, count = [], Counter()
    for doc, text in docs:
        a = left.encode(" " + text, add_special_tokens=False).ids if text else []
        b = right.encode(text) if text else []
        in_a, in_b = [bytes(byte[c] for c in left.id_to_token(i)) for i in a], [spell(i) for i in b]
        if not text or b"".join(in_a) != (" " + text).encode() or b"".join(in_b) != (" " + text).encode():
            rows.append((doc, [], [], [], []))
            continue
        ends_a, ends_b = [sum(map(len, in_a[: k + 1])) for k in range(len(a))], [sum(map(len, in_b[: k + 1])) for k in range(len(b))]
        links = [(i, j) for i, x in zip(a, ends_a, strict=True) for j, y in zip(b, ends_b, strict=True) if x == y]
        groups, start = [], 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            groups.append(",".join(str(i) for i, e in zip(a, ends_a, strict=True) if start < e <= cut) + "|" + ",".join(str(i) for i, e in zip(b, ends_b, strict=True) if start < e <= cut))
            start = cut
        count.update(links)
        rows.append((doc, a, b, groups, links))
    best: dict[int, int] = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    digest = lambda groups: hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
    return Counter((doc, len(a), len(b), len(g), len(l), sum(count[x] == best[x[1]] for x in l), sum(count[x] for x in l), digest(g)) for doc, a, b, g, l in rows)


def aligned(spark, docs) -> Counter:
    found = alignment.align(spark.createDataFrame([(*d, 7, "k", "i", 1) for d in docs], SCHEMA), *packing.vocabulary(), pieces.model())
    return Counter(tuple(r) for r in found.collect())


def test_alignment_equals_loops(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if len(r.text or "") < 3000]
    docs += [
        (9001, None), (9002, ""), (9003, " "), (9004, "a <|endoftext|> b <s> </s> <0x41>"), (9005, "literal ▁ mark"), (9006, "same text"), (9007, "same text"),
        (9008, "same text"), (9006, "same text"), (None, "no id"), (9009, "\x00\t\r\n  é é 😀 　𝕏"), (9010, "x" * 3000), (9011, "word " * 1500),
    ]
    assert aligned(spark, docs) == loops(docs)


def test_alignment_of_a_text_that_most_documents_have(spark):
    """One key of the join back is split; each document still has one row."""
    docs = [(k, "the copy that most have") for k in range(600)] + [(1000 + k, f"text {k}") for k in range(50)]
    assert aligned(spark, docs) == loops(docs)


def test_alignment_without_rows(spark):
    assert aligned(spark, []) == Counter()
    assert aligned(spark, [(1, None)]) == Counter([(1, 0, 0, 0, 0, 0, 0, "")])


def test_alignment_query_covers_the_table(spark):
    found = QUERIES["op12_alignment"](spark, "/root/testdata/sf0.001").collect()
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(r.doc_id for r in found) == sorted(r.doc_id for r in table.select("doc_id").collect())
    assert {r.n_links == r.n_groups and r.n_best <= r.n_links for r in found} == {True}


def test_piece_query_equals_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model())
    expected = set()
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = library.encode(r.text or "")
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        expected.add((r.doc_id, len(ids), *digests, True))
    assert {tuple(r) for r in QUERIES["op13_sentencepiece"](spark, "/root/testdata/sf0.001").collect()} == expected


def test_pieces_of_edge_cases(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model())
    texts = [None, "", " ", "  a  b ", "\x00", "<s> <0x0A> ▁x", "a\r\n\tb", "é é 😀 　 ​", "x" * 40_000, "ab" * 20_000, " " * 5_000, "x" * 40_000]
    rows = pieces.encode(spark.createDataFrame([(k, t, 7, "k", "i", 1) for k, t in enumerate(texts)], SCHEMA), pieces.model()).collect()
    assert {r.doc_id: (r.ids, r.decoded, r.agrees) for r in rows} == {k: (library.encode(t or ""), library.decode(library.encode(t or "")), True) for k, t in enumerate(texts)}
    assert pieces.encode(spark.createDataFrame([], SCHEMA), pieces.model()).collect() == []


def test_long_and_short_stretches_merge_alike():
    words = pieces.vocabulary(pieces.model())
    cuts = sorted({p[:32] for p in list(words.ids)[::3]} | {"▁", "▁▁▁▁▁▁", "é", "😀x", "▁thequickbrown"}, key=len)
    assert words.merge_all(cuts, 32) == [words.merge(c) for c in cuts]


def test_remembered_stretches_are_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    words = pieces.MergeVocabulary(pieces.model())
    texts = [f"word{k} and some more words{k * 7}" for k in range(200)]
    assert [x.tolist() for k in range(0, 200, 20) for x in words.encode(texts[k : k + 20])] == words.library.encode(texts)
    assert len(words._known) <= 50


@pytest.fixture(scope="module")
def words():
    return pieces.vocabulary(pieces.model())


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=60), st.text(alphabet="ab▁ \n.éß'1", max_size=80)))
def test_any_text_encodes_as_the_library_does(words, text):
    text = text.encode("utf-8", "ignore").decode()
    assert words.encode([text])[0].tolist() == words.library.encode(text)
