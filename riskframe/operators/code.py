"""Literals in code that hide something: encoded payloads, literals of high entropy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from riskframe.functions import text as tx
from riskframe.shipping import ship

# Literals that may be a payload, what evaluates one, how near that must be, entropies in bits a character from
# which a literal counts, and what known files begin with in base64.
BLOB = r"(['\"`])([A-Za-z0-9+/=_-]{400,}|(?:\\x[0-9a-fA-F]{2}){150,}+)\1"
SINK = r"(?<![A-Za-z0-9_])eval\s*\(|(?<![A-Za-z0-9_])Function\s*\(|(?<![A-Za-z0-9_])runIn(?:New|This)?Context\s*\(|(?<![A-Za-z0-9_])compileFunction\s*\("
NEAR = 400
BLOB_ENTROPY, HEX_ENTROPY, LITERAL_ENTROPY = 5.2, 4.5, 5.8
LITERAL = r"(['\"`])([^'\"`\s\\]{128,})\1"
KNOWN_FILES = ("iVBOR", "R0lGOD", "/9j/", "AGFzbQ", "d09GR", "T1RUTw", "AAEAAA", "PHN2Zy", "data:", "sha256-", "sha384-", "sha512-")


def bits(value: bytes) -> float:
    """Entropy in bits of the characters of a text in UTF-8; that of escapes is that of the bytes they stand for."""
    if value.startswith(b"\\x"):
        codes = np.frombuffer(bytes.fromhex(value.replace(b"\\x", b"").decode()), np.uint8)
    elif value.isascii():
        codes = np.frombuffer(value, np.uint8)
    else:
        codes = np.unique(np.frombuffer(value.decode(errors="replace").encode("utf-32-le"), "<u4"), return_inverse=True)[1]
    counts = np.bincount(codes)
    p = counts[counts > 0] / len(codes)
    return max(0.0, -float((p * np.log2(p)).sum()))


@F.arrow_udf(ArrayType(DoubleType()))
def entropies(values: pa.Array) -> pa.Array:
    """bits of each text of lists of texts."""
    return pa.array([row and [bits(x) for x in row] for row in values.cast(pa.list_(pa.binary())).to_pylist()], pa.list_(pa.float64()))


def quoted(text: Column, pattern: str) -> Column:
    """matches of a literal; what is between its quotes is cut out of the match, not searched for again."""
    inner = lambda m: m["matched"].substr(F.lit(2), F.length(m["matched"]) - 2)
    return F.transform(tx.matches(text, pattern), lambda m: F.struct(m["start"].alias("start"), m["line"].alias("line"), m["matched"].alias("matched"), inner(m).alias("value")))


def blobs(text: Column) -> Column:
    """array<struct<start, line, length, value, hex, sink>>: long literals of base64 or hexadecimal escapes.

    sink is the first evaluation within NEAR characters, or null; escapes without one are no rule's and are left out.
    """

    def row(m: Column) -> Column:
        escapes = m["value"].startswith("\\x")
        first = F.greatest(m["start"] - NEAR, F.lit(0))
        # the literal itself has no bracket, so no evaluation: a quote stands for it
        around = F.concat(text.substr(first + 1, m["start"] - first), F.lit('"'), text.substr(m["start"] + F.length(m["matched"]) + 1, F.lit(NEAR)))
        sink = tx.once(F.regexp_replace(F.regexp_extract(around, f"({SINK})", 1), r"\s*\($", ""), lambda x: F.when(x != "", x))
        return F.struct(m["start"].alias("start"), m["line"].alias("line"), F.length(m["value"]).alias("length"), m["value"].alias("value"), escapes.alias("hex"), sink.alias("sink"))

    return F.filter(F.transform(quoted(text, BLOB), row), lambda b: b["sink"].isNotNull() | ~b["hex"])


def packed_payloads(found: Column) -> Column:
    """Of blobs those of high entropy beside an evaluation."""
    return F.filter(found, lambda b: b["sink"].isNotNull() & (b["entropy"] >= F.when(b["hex"], HEX_ENTROPY).otherwise(BLOB_ENTROPY)))


def first_of(found: Column) -> Column:
    """struct<count, start, line, length, entropy> of a text's literals, or null without any."""
    return tx.once(found, lambda f: F.when(F.size(f) > 0, F.struct(F.size(f).alias("count"), *(F.get(f, F.lit(0))[c].alias(c) for c in ("start", "line", "length", "entropy")))))


def encoded_blob(found: Column) -> Column:
    """The number of blobs of base64 and high entropy with no evaluation beside them, and the first."""
    return first_of(F.filter(found, lambda b: b["sink"].isNull() & ~b["hex"] & (b["entropy"] >= BLOB_ENTROPY)))


def literals(text: Column) -> Column:
    """array<struct<start, line, length, value>>: long literals that are no known files."""
    found = F.filter(quoted(text, LITERAL), lambda m: ~F.exists(F.array(*map(F.lit, KNOWN_FILES)), lambda p: F.startswith(m["value"], p)))
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["line"].alias("line"), F.length(m["value"]).alias("length"), m["value"].alias("value")))


def high_entropy_literal(found: Column) -> Column:
    """Of literals the number of those above LITERAL_ENTROPY, and the first."""
    return first_of(F.filter(found, lambda r: r["entropy"] > LITERAL_ENTROPY))


def measured(found: Column, entropy: Column, *names: str) -> Column:
    """start, line, length, the named and the entropy of blobs or literals."""
    return F.zip_with(found, entropy, lambda x, h: F.struct(*(x[c].alias(c) for c in ("start", "line", "length", *names)), h.alias("entropy")))


FINDING = "struct<rule_id:string,line:int,start:int,length:int,entropy:double,n:int,detail:string>"


def code_findings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *keep, rule_id, line, start, length, entropy, n, detail): what a text's code hides, one row for each payload and one for each other rule.

    Rules: packed-payload (detail: the evaluation), encoded-blob, high-entropy-literal, names (of an obfuscator), escapes (detail: the
    reason). A text is read by one projection and is in no shuffle; a null text has no findings. Only long literals go to Python,
    where their characters are counted in one pass.
    """
    ship(docs.sparkSession)
    text = F.col(text_col)
    none = F.lit(None)

    def row(rule: str, s: Column | None, n: Column, detail: Column) -> Column:
        get = lambda name, kind: s[name] if s is not None else none.cast(kind)
        cells = (F.lit(rule).alias("rule_id"), get("line", "int").alias("line"), get("start", "int").alias("start"), get("length", "int").alias("length"), get("entropy", "double").alias("entropy"), n.cast("int").alias("n"), detail.alias("detail"))
        return F.struct(*cells)

    nothing = F.array().cast(f"array<{FINDING}>")
    one = lambda rule, found: tx.once(found, lambda s: F.when(s.isNotNull(), F.array(row(rule, s, s["count"], none.cast("string")))).otherwise(nothing))
    values = F.concat(F.transform("__blobs", lambda x: x["value"]), F.transform("__literals", lambda x: x["value"]))
    n = F.size("__blobs")
    blob = measured(F.col("__blobs"), F.slice("__bits", 1, n), "hex", "sink")
    literal = measured(F.col("__literals"), F.slice("__bits", n + 1, F.size("__literals")))
    payloads = tx.once(blob, lambda b: F.concat(F.transform(packed_payloads(b), lambda x: row("packed-payload", x, F.lit(1), x["sink"])), one("encoded-blob", encoded_blob(b))))
    found = F.concat(
        F.coalesce(payloads, nothing),
        one("high-entropy-literal", high_entropy_literal(literal)),
        F.when(F.col("__names"), F.array(row("names", None, F.lit(1), none.cast("string")))).otherwise(nothing),
        F.when(F.col("__escapes").isNotNull(), F.array(row("escapes", None, F.lit(1), F.col("__escapes")))).otherwise(nothing),
    )
    read = docs.where(text.isNotNull()).select(id_col, *keep, blobs(text).alias("__blobs"), literals(text).alias("__literals"), tx.obfuscator_names(text).alias("__names"), tx.escape_density(text).alias("__escapes"))
    read = read.withColumn("__bits", entropies(values))
    # not inline: for that one Spark adds filters on the array, which compute it again
    return read.select(id_col, *keep, F.inline_outer(found)).where("rule_id is not null")
