"""Piece ids and texts against the library, text by text."""

import hashlib
import random

import pytest
import sentencepiece

from riskframe.llm import sentence_pieces
from riskframe.llm.queries import op13_sentence_pieces

ALPHABET = ["a", "b", " ", "  ", "▁", "\n", "é", "中", "😀", "\0", "the", "<s>", "　", "word", ".", "\t", "</s>", "<0x0A>"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.model())


@pytest.mark.parametrize("part", [1 << 20, 7])
def test_ids_are_the_library_s(library, monkeypatch, part):
    monkeypatch.setattr(sentence_pieces, "PART", part)
    monkeypatch.setattr(sentence_pieces, "ENTRIES", 500)
    rnd = random.Random(part)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 14))) for _ in range(5000)] + ["x" * 5000 + " y" * 3000, " " * 100, "ab " * 40]
    found = sentence_pieces.Pieces(sentence_pieces.model()).ids(texts)
    for text, ids in zip(texts, found, strict=True):
        assert memoryview(ids).cast("i").tolist() == library.encode(text, add_eos=True), text


def test_encode_and_decode(spark, library):
    rows = [(1, "One two", 5, "q"), (1, "One two", 6, "r"), (None, "  no id ", 0, ""), (4, None, 0, None), (5, "", 1, ""), (6, "long " * 200_000, 1, ""), (7, "▁raw\u0000\n", 1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id long, ids string").repartition(2)
    encoded = sentence_pieces.encode_pieces(df)
    want = sorted((str(d), library.encode(t or "", add_eos=True)) for d, t, *_ in rows)
    assert sorted((str(r.doc_id), r.ids) for r in encoded.collect()) == want
    decoded = sentence_pieces.decode_pieces(encoded).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in decoded) == sorted((str(d), library.decode(library.encode(t or "", add_eos=True))) for d, t, *_ in rows)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [264, None, 1, 2, 28705, 264]), (4, [1, 13])], "doc_id long, ids array<int>")
    found = {r.doc_id: r.decoded for r in sentence_pieces.decode_pieces(odd).collect()}
    assert found == {1: "", 2: "", 3: library.decode([264, 1, 2, 28705, 264]), 4: library.decode([1, 13])}
    assert sentence_pieces.encode_pieces(df.limit(0)).count() == 0


def test_query_over_whole_table(spark, library, tmp_path):
    rows = [(k, t) for k, t in enumerate(["", None, "a  b", "Ünï 中 😀", "tail "])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in op13_sentence_pieces(spark, str(tmp_path)).collect():
        ids = library.encode(rows[r.doc_id][1] or "", add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
