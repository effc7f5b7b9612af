"""Toxicity by a weighted lexicon: Aho-Corasick matches after folding homoglyphs and digit substitutions.

The lexicon is learned from labelled rows: whole words and word beginnings whose presence tells toxic documents
from others weigh their (smoothed) log-odds. A text's score is a logistic function of its summed weights over the
root of its length. Phrases in which a word of the lexicon is harmless are exceptions and count for nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskframe.llm.common import Work, bounded, sliced
from riskframe.shipping import ship

# Letters of other scripts that look like Latin ones, and signs that stand for letters.
HOMOGLYPHS = str.maketrans(
    {
        "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
        "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "в": "b", "м": "m", "н": "h", "т": "t", "к": "k", "г": "r",
        "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x",
        "ı": "i", "ɡ": "g", "ɩ": "i", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m", "​": "", "‌": "", "‍": "", "­": "", "⁠": "",
    }
)
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"})
FOREIGN = re.compile("[" + "".join(map(chr, HOMOGLYPHS)) + "！-～\U0001d400-\U0001d7ff]")
#: Signs between letters, or digits before at least two letters.
SIGNED = re.compile(r"(?<=[^\W\d_])[0134578@$!|]+(?=[^\W\d_])|(?<![\w@$!|])[0134578]+(?=[^\W\d_]{2})")
WORDS = re.compile(r"[^\W\d_]{3,}")
#: English phrases that are no insult though a word of them may be in a lexicon. A parameter of ``Lexicon``: they are not learned, since
#: labelled rows hold too few of them; other languages and lexicons need their own.
EXCEPTIONS = ("class clown", "clown fish", "rodeo clown", "trash can", "trash bin", "stupid question", "pond scum", "sore loser")
PREFIXES = range(4, 9)
#: At most so many labelled rows of each class are learned from; those with the smallest hash of their id.
SAMPLE = {1: 4000, 0: 8000}
#: Entries of a lexicon at most; toxic documents an entry must be in (two may be chance); log-odds it must have (20 times as common in
#: toxic documents as in others) and may weigh at most, so that one rare word does not outweigh all others.
ENTRIES, LEAST, ODDS, MOST = 5000, 3, 3.0, 6.0
#: Part of the toxic documents that an entry must be in to be a strong one: those are learned first, and what they
#: explain teaches no weak ones, so that words which merely stand beside an insult are left out.
SHARE = 0.12


def folded(text: str | None) -> str:
    """Lower case, look-alike letters as Latin ones, signs between letters as the letters they stand for."""
    s = (text or "").lower()
    if not s.isascii() and FOREIGN.search(s):
        import unicodedata

        s = unicodedata.normalize("NFKC", s).lower().translate(HOMOGLYPHS)
    return SIGNED.sub(lambda m: m[0].translate(SIGNS), s)


def features(text: str | None) -> set[str]:
    """Whole words (with a final space) and word beginnings of a text."""
    words = set(WORDS.findall(folded(text)))
    return {w + " " for w in words} | {w[:n] for w in words for n in PREFIXES if len(w) > n}


@dataclass
class Lexicon:
    """Weights of whole words (with a final space) and of word beginnings; the logistic curve's slope and offset."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 1.0
    offset: float = -3.0

    def automaton(self):
        import ahocorasick

        built = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            key = entry.rstrip(" ")
            whole, start = built.get(key, (0.0, 0.0))
            built.add_word(key, (weight, start) if entry.endswith(" ") else (whole, weight))
        sized = [(k, (len(k), *v)) for k, v in built.items()]
        built = ahocorasick.Automaton()
        for key, value in sized:
            built.add_word(key, value)
        built.make_automaton()
        calm = ahocorasick.Automaton()
        for phrase in self.exceptions:
            calm.add_word(phrase, len(phrase))
        calm.make_automaton()
        return built if len(built) else None, calm if len(calm) else None


def strength(text: str | None, built, calm) -> float:
    """The summed weights of a text's matches at the beginnings of words, over the root of its hundreds of words."""
    s = folded(text)
    if not s or built is None:
        return 0.0
    found: dict[int, float] = {}
    end = len(s)
    for last, (size, whole, start) in built.iter(s):
        first = last - size + 1
        if first and s[first - 1].isalpha():
            continue
        at_end = last + 1 == end or not s[last + 1].isalpha()
        weight = max(start, whole if at_end else 0.0)
        found[first] = max(found.get(first, 0.0), weight)
    if found and calm is not None:
        for last, size in calm.iter(s):
            for first in [k for k in found if last - size < k <= last]:
                del found[first]
    return sum(found.values()) / max(1.0, math.sqrt((s.count(" ") + 1) / 100))


def chosen(counts: list[tuple[str, int, int]], positives: int, negatives: int) -> dict[str, float]:
    """Entries that tell, without those that a longer one explains or a shorter one covers."""
    odds = {f: math.log((p + 0.5) / (positives + 1)) - math.log((n + 1) / (negatives + 2)) for f, p, n in counts}
    counts_of = {f: p for f, p, _ in counts}
    good = {f for f in odds if odds[f] >= ODDS}
    longest: Counter[str] = Counter()
    for f in good:
        stem = f.rstrip(" ")
        for n in PREFIXES:
            if n < len(stem) or (n == len(stem) and f.endswith(" ")):
                longest[stem[:n]] = max(longest[stem[:n]], counts_of[f])
    out: dict[str, float] = {}
    for f in sorted(good, key=lambda f: (len(f), f)):
        if not f.endswith(" ") and longest[f] >= 0.8 * counts_of[f]:
            continue  # one longer entry is nearly all of it
        stem = f.rstrip(" ")
        if any(stem[:n] in out for n in PREFIXES if n < len(stem)):
            continue
        out[f] = min(odds[f], MOST)
    return out


def fitted(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton's method, both lightly held."""
    a, b = 1.0, -3.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p)
        g = np.array([((y - p) * x).sum() - 0.02 * a, (y - p).sum() - 0.002 * b])
        h = np.array([[(w * x * x).sum() + 0.02, (w * x).sum()], [(w * x).sum(), w.sum() + 0.002]])
        step = np.linalg.solve(h, g)
        size = np.abs(step).max()
        a, b = np.array([a, b]) + step * min(1.0, 2.0 / max(size, 1e-9))
        if size < 1e-8:
            break
    return max(float(a), 0.0), float(b)


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: dict[int, int] = SAMPLE) -> Lexicon:
    """A lexicon from docs(id_col, text_col) and labels(id_col, label_col); other labels than 0 and 1 and null ids are left out.

    The sample is drawn from labels alone, so no text moves but its own. What reaches the driver is bounded: at most
    ENTRIES counts, and a strength and label for each row of the sample. An id with both labels has the larger.
    Without rows of both classes the lexicon is empty and scores rest on its offset alone.
    """
    work = Work(docs.sparkSession, "toxicity")
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    marks = marks.groupBy("id").agg(F.max("label").alias("label"))
    parts = [marks.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(n) for k, n in sample.items()]
    drawn = work.save(parts[0].unionByName(parts[1]), "drawn")
    # as many ids as the sample at most
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id").select("id", "text", "label")
    rows = work.save(rows, "sample")
    size = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not (size.get(0) and size.get(1)):
        return Lexicon()

    # entries of many toxic documents first; others must tell documents that those leave unexplained
    strong = Lexicon(chosen(counted(rows, None, size, max(LEAST, SHARE * size[1])), size[1], size[0]))
    weak = chosen(counted(rows, strong, size, LEAST), size[1], size[0])
    lexicon = Lexicon(weak | strong.weights)
    pairs = strengths(rows, lexicon, ["label"]).select("strength", "label").collect()
    lexicon.slope, lexicon.offset = fitted(np.array([r[0] for r in pairs]), np.array([r[1] for r in pairs], float))
    return lexicon


def counted(rows: DataFrame, known: Lexicon | None, size: dict[int, int], least: float) -> list[tuple[str, int, int]]:
    """(entry, toxic documents, others) of the best entries of rows(id, text, label), without toxic documents that known explains."""

    def count(batches):
        counts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
        built, calm = known.automaton() if known else (None, None)

        def row():
            names = list(counts[0].keys() | counts[1].keys())
            arrays = [pa.array(names, pa.string()), pa.array([counts[1][n] for n in names], pa.int64()), pa.array([counts[0][n] for n in names], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["feature", "p", "n"])

        for batch in (part for whole in batches for part in sliced(whole)):
            for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if label == 1 and strength(text, built, calm) > 0:
                    continue
                counts[label].update(features(text))
                if len(counts[0]) + len(counts[1]) > 2_000_000:
                    yield row()
                    counts = (Counter(), Counter())
        yield row()

    ship(rows.sparkSession)
    bounded(rows.sparkSession)
    found = rows.coalesce(12).mapInArrow(count, "feature string, p long, n long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).where(F.col("p") >= least)
    odds = F.log((F.col("p") + 0.5) / (size[1] + 1)) - F.log((F.col("n") + 1) / (size[0] + 2))
    top = found.withColumn("odds", odds).where(F.col("odds") >= ODDS).orderBy(F.desc(F.col("odds") * F.sqrt("p")), "feature").limit(ENTRIES).collect()
    return [(r["feature"], r["p"], r["n"]) for r in top]


def strengths(rows: DataFrame, lexicon: Lexicon, extra: list[str]) -> DataFrame:
    """id, the columns extra, and the strength of text."""

    def scan(batches):
        built, calm = lexicon.automaton()
        for batch in (part for whole in batches for part in sliced(whole)):
            found = [strength(t, built, calm) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(found, pa.float64())], ["id", *extra, "strength"])

    ship(rows.sparkSession)
    bounded(rows.sparkSession)
    source = rows.select("id", "text", *extra)
    kinds = dict(source.dtypes)
    return source.mapInArrow(scan, ", ".join(["id long", *(f"{c} {kinds[c]}" for c in extra), "strength double"]))


def toxicity(docs: DataFrame, lexicon: Lexicon, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, predicted) for every row of docs: a score from 0 to 1, and 1 if it is at least 0.5.

    Null and empty texts have no match and get the score of strength 0. A null id stays null. Repeated rows get a row each,
    an empty table none. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    score = 1 / (1 + F.exp(-(F.lit(lexicon.slope) * F.col("strength") + F.lit(lexicon.offset))))
    out = strengths(rows, lexicon, []).withColumn("score", score)
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "strength")


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from: a fifth, by the CRC-32 of the id's digits."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
