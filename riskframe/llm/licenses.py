"""License texts in documents: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Texts are reduced to letters and digits in lower case, with their places kept. Every run of GRAM characters has a hash, and
in each WINDOW of them the smallest is a fingerprint, so that any match of GRAM + WINDOW - 1 characters shares
one. The templates' fingerprints form an inverted index; what a document shares with it says which template may stand
where. There the words of template and text are aligned within a band. Templates that are worded alike have telling words (a
name, a version) which must be among those that are matched. Words that a template does not have, such as a copyright line or
comment signs between lines, cost the alignment little.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskframe.llm.common import in_batches, mix64
from riskframe.llm.license_texts import NOTICES, TELLING, TEXTS

TEMPLATES = TEXTS | NOTICES
#: Characters of a hashed run; runs of a window.
GRAM, WINDOW = 10, 5
#: Words by which an alignment may leave its diagonal; part of a template's words that must be matched.
BAND, COVERAGE = 8, 0.7
#: Part of a template's fingerprints that must be shared near a diagonal for an alignment. Where COVERAGE of the words are there in
#: order, whole runs of them are, and with them far more fingerprints.
SHARED = 0.05
#: Characters of all templates together at most: their index goes to every task.
MOST = 16_000_000
WORDS = re.compile(r"[^\W_]+(?:\.\d+)*")


def reduced(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the letters and digits of a text in lower case (ASCII), and their places."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    upper = (codes >= 65) & (codes <= 90)
    codes = np.where(upper, codes + 32, codes)
    kept = np.flatnonzero(((codes >= 97) & (codes <= 122)) | ((codes >= 48) & (codes <= 57)) | (codes > 160))
    return codes[kept].astype(np.uint64), kept


def fingerprints(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed hashes of a text and their places in it."""
    codes, places = reduced(text)
    n = len(codes) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(GRAM):
        h *= np.uint64(1_000_003)
        h += codes[j : j + n]
    h = mix64(h)
    if n <= WINDOW:
        chosen = np.array([int(h.argmin())])
    else:
        least = h[: n - WINDOW + 1].copy()
        for j in range(1, WINDOW):
            np.minimum(least, h[j : n - WINDOW + 1 + j], out=least)
        # a run is chosen if it is the smallest of a window that it is in
        hit = np.zeros(n, bool)
        for j in range(WINDOW):
            hit[j : n - WINDOW + 1 + j] |= h[j : n - WINDOW + 1 + j] == least
        chosen = np.flatnonzero(hit)
    return h[chosen], places[chosen]


class Index:
    """The inverted index of templates, with their words."""

    def __init__(self, templates: dict[str, str], telling: dict[str, tuple[str, ...]]):
        if sum(map(len, templates.values())) > MOST:
            raise ValueError(f"templates of more than {MOST} characters together")
        self.names = sorted(templates)
        self.words = [[w.lower() for w in WORDS.findall(templates[n])] for n in self.names]
        self.telling = [[i for w in telling.get(n, ()) for i in [self.words[k].index(w)]] for k, n in enumerate(self.names)]
        rows, self.least = [], []
        for k, name in enumerate(self.names):
            starts = np.array([m.start() for m in WORDS.finditer(templates[name])])
            hashes, places = fingerprints(templates[name])
            self.least.append(max(1, int(SHARED * len(hashes))))
            rows += [(int(h), k, int(np.searchsorted(starts, p, "right") - 1)) for h, p in zip(hashes, places, strict=True)]
        rows.sort()
        self.hashes = np.array([r[0] for r in rows], np.uint64)
        self.of = np.array([(r[1], r[2]) for r in rows], np.int64).reshape(-1, 2)

    def matches(self, text: str, coverage: float) -> list[tuple[str, float, int, int]]:
        """(name, coverage, start, end) of the templates in a text, none overlapping another; those with the most matched words first chosen."""
        hashes, places = fingerprints(text)
        if not len(hashes) or not len(self.hashes):
            return []
        low, high = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        hits = np.flatnonzero(high > low)
        if not len(hits):
            return []
        found = list(WORDS.finditer(text))
        starts = np.array([m.start() for m in found])
        n = (high - low)[hits]
        at = np.repeat(low[hits] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        template, place = self.of[at].T
        diagonal = np.repeat(np.searchsorted(starts, places[hits], "right") - 1, n) - place
        order = np.lexsort((diagonal, template))
        template, diagonal = template[order], diagonal[order]
        # a gap between diagonals that no band bridges parts places where a template may stand
        cut = np.flatnonzero((np.diff(template) != 0) | (np.diff(diagonal) > BAND)) + 1
        out: list[tuple[str, float, int, int, int]] = []
        for which, near in zip(np.split(template, cut), np.split(diagonal, cut), strict=True):
            k = int(which[0])
            if len(near) < self.least[k]:
                continue
            last = None
            for d in np.unique(near):
                if last is not None and d - last <= BAND // 2:
                    continue
                last = d
                if best := align(self.words[k], found, int(d)):
                    matched, first, final = best
                    if len(matched) >= coverage * len(self.words[k]) and matched.issuperset(self.telling[k]):
                        out.append((self.names[k], len(matched) / len(self.words[k]), found[first].start(), found[final].end(), len(matched)))
        chosen: list[tuple[int, int, float, str]] = []
        for name, part, start, end, _ in sorted(out, key=lambda m: (-m[1] * m[4], m[2], m[0])):
            i = bisect.bisect(chosen, (start,))
            if (i == 0 or chosen[i - 1][1] <= start) and (i == len(chosen) or end <= chosen[i][0]):
                chosen.insert(i, (start, end, part, name))
        return [(name, part, start, end) for start, end, part, name in chosen]


def align(template: list[str], found: list[re.Match], diagonal: int) -> tuple[frozenset[int], int, int] | None:
    """The best local alignment near a diagonal: the template's words that are matched, first and last matched word of the text.

    A match gives 2, a difference or gap takes 1.
    """
    n, width = len(template), 2 * BAND + 1
    ids: dict[str, int] = {}
    want = np.array([ids.setdefault(w, len(ids)) for w in template])
    words = np.array([ids.get(found[k][0].lower(), -1) if 0 <= (k := diagonal - BAND + j) < len(found) else -1 for j in range(n + width)])
    same = want[:, None] == words[np.arange(n)[:, None] + np.arange(width)]
    score = np.zeros((n + 1, width + 2), np.int64)
    step = np.arange(width)
    for i in range(n):
        above = score[i]
        best = np.maximum(above[1 : width + 1] + np.where(same[i], 2, -1), above[2 : width + 2] - 1)
        # a gap in the template: what stands left in the same row, less one for each step
        best = np.maximum.accumulate(np.maximum(best, 0) + step) - step
        score[i + 1, 1 : width + 1] = best
    i, j = np.unravel_index(int(score[1:, 1 : width + 1].argmax()), (n, width))
    if score[i + 1, j + 1] <= 0:
        return None
    matched, ends = set(), []
    while i >= 0 and 0 <= j < width and score[i + 1, j + 1] > 0:
        here = score[i + 1, j + 1]
        if here == score[i, j + 1] + (2 if same[i, j] else -1):
            if same[i, j]:
                matched.add(int(i))
                ends.append(int(i + j))
            i -= 1
        elif j + 1 < width and here == score[i, j + 2] - 1:
            i, j = i - 1, j + 1
        elif j > 0 and here == score[i + 1, j] - 1:
            j -= 1
        else:
            if same[i, j]:
                matched.add(int(i))
                ends.append(int(i + j))
            break
    if not ends:
        return None
    shift = diagonal - BAND
    return frozenset(matched), min(ends) + shift, max(ends) + shift


def find_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, telling: dict[str, tuple[str, ...]] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(id_col, license, coverage, start, end): one row for each template found in a text.

    coverage is the part of the template's words that the text has in order, which include its ``telling`` words; start and end
    are code points, the end exclusive. Of templates that overlap the one that covers most counts.
    A null or empty text has none, and a text without a license gives no row. Repeated rows repeat theirs. Other columns are ignored.
    """
    index = Index(TEMPLATES if templates is None else templates, (TELLING if templates is None else {}) if telling is None else telling)

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(doc, *m) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text for m in index.matches(text, coverage)]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "license", "coverage", "start", "end"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return in_batches(source, scan, "id long, license string, coverage double, start long, end long").withColumnRenamed("id", id_col)
