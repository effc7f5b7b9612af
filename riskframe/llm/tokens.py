"""Token ids of whole texts under the byte-level BPE vocabulary, with a cache of space-separated chunks."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from riskframe.llm.common import held

#: Chunks whose ids a Python worker remembers: the first ones that recur in a batch.
CACHED = 100_000
#: Words that are encoded as one text.
RUN = 500
#: A chunk begins at a space after a character that is no white space: no token reaches across such a place.
PLACE = re.compile(r"(?<=\S)(?= )")
#: White space before a space; a text without any, and without two spaces in a row or one at its ends, is cut at each space.
ODD_SPACE = [chr(c) + " " for c in range(0x110000) if c != 32 and re.match(r"\s", chr(c))]

#: The same as a pattern that Arrow can search for.
ODD_PLACE = "[" + "".join(x[0] for x in ODD_SPACE) + " ] |^ | $"
#: Texts whose words are looked up together.
TOGETHER = 2_000


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids(text): the ids by ``tokenizers`` as little-endian unsigned 32-bit bytes. No special tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        #: Ids of chunks, which begin with a space that is left out here, and of what else stood at the start of a text.
        self.cache: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        #: Whether an id begins with a space.
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[k for token, k in vocab.items() if token.startswith("\u0120")]] = True

    def encoded(self, chunks: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def after_spaces(self, words: list[str]) -> list[bytes]:
        """ids of words with a space before each, which hold none themselves and end with no white space.

        They are encoded as texts of RUN words: no token reaches across the spaces, so each begins where an id begins with one.
        """
        runs = [words[at : at + RUN] for at in range(0, len(words), RUN)]
        out: list[bytes] = []
        for run, e in zip(runs, self.tokenizer.encode_batch_fast([" " + " ".join(x) for x in runs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) != len(run):
                raise ValueError("a token reaches across a space between words")
            raw, bounds = ids.tobytes(), (4 * np.r_[starts, len(ids)]).tolist()
            out += [raw[a:b] for a, b in zip(bounds, bounds[1:])]
        return out

    def fresh(self, new: list[str], space: str) -> dict[str, bytes]:
        """ids of chunks that no cache has."""
        if not space:
            return dict(zip(new, self.encoded(new), strict=True))
        # the last word of a text may end with white space
        words, last = [c for c in new if c and not c[-1].isspace()], [c for c in new if not c or c[-1].isspace()]
        return dict(zip(words, self.after_spaces(words), strict=True)) | dict(zip(last, self.encoded([space + c for c in last]), strict=True))

    def filled(self, keys: list[str], found: list[bytes | None], cache: dict[str, bytes], space: str, often: np.ndarray | None = None) -> list[bytes]:
        """found with the ids of the keys that the cache lacks; of counted keys only those that recur are remembered."""
        new = dict.fromkeys(c for c, x in zip(keys, found, strict=True) if x is None)
        fresh = self.fresh(list(new), space)
        kept = [keys[k] for k in np.flatnonzero(often)] if often is not None else new
        for c in (c for c in kept if c in fresh and len(c) < 64):
            if len(cache) >= CACHED:
                break
            cache[c] = fresh[c]
        return [fresh[c] if x is None else x for c, x in zip(keys, found, strict=True)]

    def ids(self, text: str) -> bytes:
        parts = text.split(" ")
        if "" in parts or any(x in text for x in ODD_SPACE):
            keys = [x for x in PLACE.split(text) if x]
            found = list(map(self.others.get, keys))
            return b"".join(self.filled(keys, found, self.others, "") if None in found else found)
        first, keys = parts[0], parts[1:]
        found = list(map(self.cache.get, keys))
        if None in found:
            found = self.filled(keys, found, self.cache, " ")
        head = self.others.get(first)
        if head is None:
            head = self.filled([first], [None], self.others, "")[0]
        return head + b"".join(found)


    def batch(self, texts: pa.Array):
        """ids of each text of an Arrow array, in order; a null is empty.

        The words of TOGETHER texts at a time are numbered by Arrow, so each different one is looked up once.
        """
        for at in range(0, len(texts), TOGETHER):
            part = pc.fill_null(texts.slice(at, TOGETHER), "")
            odd = pc.match_substring_regex(part, ODD_PLACE).to_numpy(zero_copy_only=False)
            plain = part.filter(pa.array(~odd))
            found = iter(self.plain(plain)) if len(plain) else iter(())
            for k in range(len(part)):
                yield self.ids(part[k].as_py()) if odd[k] else next(found)

    def plain(self, texts: pa.Array) -> list[bytes]:
        """ids of texts that are cut at each space."""
        words = pc.split_pattern(texts, " ")
        starts = words.offsets.to_numpy() - words.offsets[0].as_py()
        numbered = words.flatten().dictionary_encode()
        keys = numbered.dictionary.to_pylist()
        found = list(map(self.cache.get, keys))
        which = numbered.indices.to_numpy().astype(np.int64)
        if None in found:
            found = self.filled(keys, found, self.cache, " ", np.bincount(which, minlength=len(keys)) > 1)
        # the first word of a text has no space before it
        heads = [x.as_py() for x in words.flatten().take(pa.array(starts[:-1]))]
        first = list(map(self.others.get, heads))
        if None in first:
            first = self.filled(heads, first, self.others, "")
        every = found + first
        pool = np.frombuffer(b"".join(every), "<u4")
        sizes = np.fromiter(map(len, every), np.int64, len(every)) // 4
        places = np.cumsum(sizes) - sizes
        which[starts[:-1]] = len(found) + np.arange(len(heads))
        n = sizes[which]
        end = np.cumsum(n)
        ids = pool[np.repeat(places[which] - (end - n), n) + np.arange(int(end[-1]))]
        bounds = np.r_[0, end][starts]
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker."""
    return held(path, lambda: Encoder(path))
