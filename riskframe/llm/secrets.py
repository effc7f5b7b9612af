"""Secrets in texts: fixed patterns, and random strings by the token-efficiency test.

Text that a byte-pair vocabulary was made for needs few tokens for its characters; random strings need many.
Unbroken runs of at least 16 key characters are encoded with tiktoken, letter-only ones too, and those with
few characters for each token are reported as kind ``random``, after known digests, identifiers, numbers, addresses
and what a fixed pattern has found already are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskframe.llm.common import Work, held, in_batches, keep_ids
from riskframe.llm.tokens import vocabulary

# The base patterns, in the order of their kinds.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: The same as runs of [0-9a-f] that are long enough.
HEX = re.compile(r"[0-9a-f]{32,}")

LEAST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LETTERS = re.compile(r"[A-Za-z+/_=-]+")
#: What stands between signs of assignment, with the padding at its end.
PART = re.compile(r"[^=]+=*")
#: Characters for each token below which a candidate is random.
EFFICIENCY = 2.2
#: Hexadecimal lengths of common digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
DIGESTS = frozenset({32, 40, 56, 64, 96, 128})
HEX_ANY = re.compile(r"[0-9a-fA-F]+")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Words of letters with a number at their end, joined by - _ or /, or in camel case: names in code, versions, slugs, paths.
IDENTIFIER = re.compile(r"/?(?:[A-Z]?[a-z]{3,}|[A-Z]{3,}|[a-z]{1,2}|\d{1,8})(?:[-_/]*(?:[A-Z]?[a-z]{3,}|[A-Z]{3,}|[a-z]{1,2}(?=[-_/=]|$)|\d{1,8}(?=[-_/=]|$)))*=*")
#: A word that is as long as a key. It may be one, so an identifier with it is left to the ratio.
LONG = re.compile(r"[a-z]{15,}|[A-Z]{15,}")
#: Numbers, rules, and letters that are spelled one by one or in pairs.
PLAIN = re.compile(r"[0-9+/_=-]+|[+/_=-]*(?:[A-Za-z]{1,2}[+/_=-]+)+[A-Za-z]{0,2}")

def encoding(path: str):
    """The tiktoken encoding of this Python worker."""

    def make():
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    return held(path, make)


def known(candidate: str) -> bool:
    """Digests, identifiers and numbers, which are no secrets though some are random."""
    if PLAIN.fullmatch(candidate) or UUID.fullmatch(candidate) or (len(candidate) in DIGESTS and HEX_ANY.fullmatch(candidate)):
        return True
    return bool(IDENTIFIER.fullmatch(candidate)) and not LONG.search(candidate)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed patterns; in code points."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def random_spans(text: str, base: list[tuple[int, int, int]], encode, efficiency: float) -> list[tuple[int, int, int]]:
    found = []
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if known(s) or any(a < m.end() and m.start() < b for a, _, b in base):
            continue
        # letters only may be a name and its value: each is tested if it is as long as a key
        parts = PART.findall(s) if LETTERS.fullmatch(s) else [s]
        if any(len(p) >= LEAST and not known(p) and len(p) < efficiency * len(encode(p)) for p in parts):
            found.append((m.start(), 3, m.end()))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", efficiency: float = EFFICIENCY, path: str | None = None) -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, n_random, base_sha256, spans) for every row of docs.

    spans: ``kind:start:end`` of all kinds, by start and then kind, joined by commas; in code points, the end exclusive.
    base_sha256: the digest of the same string of the three fixed kinds. A null text is empty: no spans, the digest of nothing.
    Repeated rows get a row each, an empty table gives none; other columns are ignored.
    """
    path = path or vocabulary("byte_bpe_50k.tiktoken")

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoding(path).encode_ordinary
        rows = []
        for text in batch.column(1).to_pylist():
            base = base_spans(text or "")
            more = random_spans(text or "", base, encode, efficiency)
            counts = [0, 0, 0]
            for _, kind, _ in base:
                counts[kind] += 1
            rows.append((*counts, len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more))))
        numbers, digests, spans = list(zip(*rows, strict=True))[:4], [r[4] for r in rows], [r[5] for r in rows]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in numbers), pa.array(digests), pa.array(spans)], [id_col, "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    source = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    return in_batches(source, scan, f"`{id_col}` long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def redacted(docs: DataFrame, *, text_col: str = "text", mark: str = "[SECRET]", efficiency: float = EFFICIENCY, path: str | None = None) -> DataFrame:
    """docs with every span of its text replaced by ``mark``; all other columns and rows stay. Null texts stay null."""
    path = path or vocabulary("byte_bpe_50k.tiktoken")
    names = docs.columns
    at = names.index(text_col)

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoding(path).encode_ordinary
        texts = []
        for text in batch.column(at).to_pylist():
            if text:
                base = base_spans(text)
                done, parts = 0, []
                for start, _, end in sorted(base + random_spans(text, base, encode, efficiency)):
                    if start >= done:
                        parts += [text[done:start], mark]
                    done = max(done, end)
                text = "".join(parts) + text[done:]
            texts.append(text)
        return batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return in_batches(docs, clean, docs.schema)


def drop_secret_documents(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without those in which a secret was found; the columns stay."""
    gone = Work(docs.sparkSession, "secret-gone").save(find_secrets(docs, id_col=id_col, **options).where("spans <> ''").select(id_col), "gone")
    return keep_ids(docs, gone, id_col, "left_anti").select(*docs.columns)
