"""SentencePiece ids of whole texts by a table of distinct chunks, and the texts of ids.

No piece of the model may hold a whitespace marker behind another character, which is checked when it is loaded. A piece then
never reaches from one marked word (a run of markers and what follows up to the next one) into the next, so the words of a
text are segmented independently: each distinct one once by the library, and ids are joined back by position. The table of a
Python worker is kept from batch to batch and begun anew when it is full, so memory depends on no corpus.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskframe.llm.common import held, in_batches

MARKER = "▁"
#: Entries of a table before it is begun anew, and the longest chunk (in characters or ids) that it remembers.
ENTRIES, REMEMBERED = 300_000, 64
#: A long text is taken in parts of about so many characters, so that its chunks are not all held at once.
PART = 1 << 20
CHUNK = re.compile(" +[^ ]*")


def model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """Encoding and decoding with one model."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(k) for k in range(self.library.get_piece_size())]
        if any(MARKER in p.lstrip(MARKER) for p in pieces):
            raise ValueError("a piece of this model reaches across a whitespace marker")
        self.head = self.library.encode("a")
        if self.library.encode("a  b ") != [*self.head, *self.library.encode(" b"), *self.lone()]:
            raise ValueError("this model does not mark every space")
        self.table: dict[str, bytes] = {}

    def lone(self) -> list[int]:
        """Ids of a marker without a word."""
        return self.library.encode("a ")[len(self.head) :]

    def segmented(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks, which begin with a space. The library puts the first one itself before what is not empty."""
        encoded = iter(self.library.encode([c[1:] for c in chunks if c != " "], num_threads=1))
        return [array("i", self.lone() if c == " " else next(encoded)).tobytes() for c in chunks]

    def looked_up(self, chunks: list[str]) -> list[bytes]:
        found = list(map(self.table.get, chunks))
        if None in found:
            missing = list({c for c, v in zip(chunks, found, strict=True) if v is None})
            fresh = dict(zip(missing, self.segmented(missing), strict=True))
            found = [fresh[c] if v is None else v for c, v in zip(chunks, found, strict=True)]
            if len(self.table) > ENTRIES:
                self.table = {}
            self.table.update((c, v) for c, v in fresh.items() if len(c) <= REMEMBERED)
        return found

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text and the end id, as little-endian 32-bit integers. Distinct chunks are looked up once for all texts of about PART characters."""
        out, waiting, of, size = [[] for _ in texts], [], [], 0

        def put() -> None:
            found, at = self.looked_up([c for chunks in waiting for c in chunks]), 0
            for k, chunks in zip(of, waiting, strict=True):
                out[k].append(b"".join(found[at : at + len(chunks)]))
                at += len(chunks)

        for k, text in enumerate(texts):
            for part in parts(text):
                waiting.append(CHUNK.findall(part))
                of.append(k)
                size += len(part)
                if size >= PART:
                    put()
                    waiting, of, size = [], [], 0
        put()
        end = array("i", [self.library.eos_id()]).tobytes()
        return [b"".join([*x, end]) for x in out]


def parts(text: str) -> Iterator[str]:
    """A text with its first marker, in parts that are cut only before a run of spaces."""
    if not text:
        return
    text = " " + text.replace(MARKER, " ")
    at = 0
    while len(text) - at > PART:
        cut = re.compile("(?<=[^ ]) ").search(text, at + PART)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def pieces(path: str) -> Pieces:
    return held(path, lambda: Pieces(path))


def encode_pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id_col, ids): the ids of each whole text by the library, and the end id.

    A null or empty text has the end id alone. Every row has one, also if its id repeats or is null; an empty table
    gives none. Other columns are ignored. A text and its ids are one cell each; more is not held of a long text.
    """
    path = path or model()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pieces(path).ids([t or "" for t in batch.column(1).to_pylist()])
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4")))
        return pa.RecordBatch.from_arrays([batch.column(0), ids], ["id", "ids"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return in_batches(source, run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode_pieces(rows: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id_col, ids_col, decoded): the text that the library's decode gives for each list of ids.

    No ids or a null list give an empty text; a null id in a list is left out. An id that the model has not got fails, as it
    does in the library.
    """
    path = path or model()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [pieces(path).library.decode([k for k in ids or [] if k is not None]) for ids in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["id", "ids", "decoded"])

    source = rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return in_batches(source, run, "id long, ids array<int>, decoded string").toDF(id_col, ids_col, "decoded")


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)
