"""The corpus operators over documents, against brute force, with nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from riskframe.llm import licenses, mixing, near_dedup, packing, pii, quality, secrets, token_scan, tokens, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, id long, key string, component string, u double"


def texts(seed=0):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    sentence = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    out = [None, "", " \n\t ", "one", "one two three", "ONE  two\nthree", sentence(4), sentence(6000)]
    base = [sentence(60) for _ in range(10)]
    out += base + base[:4] + [base[0].upper(), base[1] + "\n"]
    for b in base:
        words = b.split()
        for k in (1, 3, 6, 9):
            changed = list(words)
            for _ in range(k):
                changed[rnd.randrange(len(changed))] = rnd.choice(vocabulary)
            out.append(" ".join(changed))
    # a hot group of near copies
    words = base[5].split()
    for _ in range(120):
        changed = list(words)
        for _ in range(rnd.randint(0, 5)):
            changed[rnd.randrange(len(changed))] = rnd.choice(vocabulary)
        out.append(" ".join(changed))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for k, t in enumerate(texts()):
        rows.append((k * 3, t, ["en", "de", None][k % 3], [None, "a", "b", "b", "b"][k % 5], 1, 5, 7, "x", "y", 0.5))
    rows += [rows[10], rows[11], (None, "no id at all", "en", "a", 1, 1, 1, "", "", 0.0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    words = WORD.findall((text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def test_near_duplicates(docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 50)  # so that groups of several blocks occur
    found = near_dedup.near_duplicates(docs).collect()
    rows = docs.collect()
    assert len(found) == len(rows)
    sets = defaultdict(set)
    for r in rows:
        if r.doc_id is not None:
            sets[r.doc_id].add(shingles(r.text))
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]) and top(a) != top(b):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == top(r.doc_id) and r.kept == (r.doc_id == r.component_id)
            assert r.n_shingles in {len(s) for s in sets[r.doc_id]}
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, {r.doc_id for r in found if r.kept}))


def test_near_duplicates_of_long_texts(spark):
    """Texts of more shingles than a sketch is made for: pairs of a similarity near 0.75 on both sides."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    rows, base = [], [word() for _ in range(600)]
    for k in range(60):
        # n changed words, far from each other, change 5 n of 596 shingles
        changed = list(base)
        for j in range(10 + k % 16):
            changed[5 + 35 * j if j < 16 else 20 + 35 * (j - 16)] = word()
        rows.append((k, " ".join([word() for _ in range(600 * (k % 3 == 2))] + changed)))
    sets = {k: shingles(t) for k, t in rows}
    near = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert near and all(got[a] == got[b] for a, b in near)


def test_pigeonhole():
    rnd = np.random.default_rng(1)
    a = rnd.integers(0, 2**16, near_dedup.LANES).astype(np.uint16)
    for _ in range(200):
        b = a.copy()
        at = rnd.choice(near_dedup.LANES, near_dedup.MAX_DISTANCE, replace=False)
        b[at] += 1
        import pyarrow as pa

        from riskframe.llm.common import to_binary

        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), to_binary(np.stack([a, b]))], ["id", "signature"])
        keys = near_dedup.keyed(batch)["key"].to_numpy().reshape(2, -1)
        assert (keys[0] == keys[1]).any()


def base_quality(text):
    words = WORD.findall(text or "")
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality(docs, nothing):
    by_id = defaultdict(set)
    for r in docs.collect():
        by_id[r.doc_id].add(base_quality(r.text))
    found = quality.quality(docs).collect()
    assert len(found) == docs.count()
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) in by_id[r.doc_id]
        assert r.kept is not None and not (r.kept and r.base_failed)
    assert quality.quality(nothing).count() == 0


def test_quality_rejects_outliers(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9)))
    clean = [" ".join(word() for _ in range(rnd.randint(60, 200))) for _ in range(300)]
    junk = [" ".join(word() + "***" for _ in range(80)) for _ in range(20)]
    shout = [" ".join(word().upper() + "!!" for _ in range(80)) for _ in range(20)]
    rows = [(k, t, "en", "s" if k % 2 else None) for k, t in enumerate(clean + junk + shout)]
    found = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(found[k] for k in range(300)) and not any(found[k] for k in range(300, 340))


def test_quality_against_plain_estimates(spark):
    """Verdicts and cutoffs of two groups against a covariance-determinant search over all rows, many random starts, no bands."""
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, n)))
    rows = []
    for k in range(700):
        source, n = "ab"[k % 2], rnd.randint(60, 120)
        words = [word(9 if source == "a" else 5) for _ in range(n)]
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(n)] = "#" * rnd.randint(1, 3) + word(4)
        if k % 10 == 0:
            words = [w.upper() + "$%&" for w in words]
        rows.append((k, " ".join(words), "en", source))
    found = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    again = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows[::-1], "doc_id long, text string, lang string, source string").repartition(7)).collect()}
    assert found == again  # to the last bit
    # the part of a chi-squared variable of 7 degrees that lies below the 0.75 quantile of one of 5, by the trapezoid rule
    grid = np.linspace(0, 6.62568, 200_001)
    density = grid**2.5 * np.exp(-grid / 2) / (2**3.5 * 3.32335097)
    factor = 0.75 / float(((density[1:] + density[:-1]) / 2 * np.diff(grid)).sum())
    floor = np.diag(np.array([0.08, 0.08, 0.08, 0.08, 0.06]) ** 2)

    def plain(x):
        """The covariance of least determinant over three quarters of the rows, from 200 random starts."""
        rng, best = np.random.default_rng(12), (np.inf, None, None)
        for _ in range(200):
            near = rng.choice(len(x), 6, replace=False)
            for _ in range(40):
                center, cov = x[near].mean(axis=0), np.cov(x[near].T, bias=True) * factor + floor
                off = x - center
                near = np.argsort((off @ np.linalg.inv(cov) * off).sum(axis=1))[: int(np.ceil(0.75 * len(x)))]
            center, cov = x[near].mean(axis=0), np.cov(x[near].T, bias=True) * factor + floor
            best = min(best, (np.linalg.slogdet(cov)[1], center.tolist(), cov.tolist()))
        return np.array(best[1]), np.array(best[2])

    def mixed(n, own, wide):
        w = n / (n + 200)
        off = own[0] - wide[0]
        return w * own[0] + (1 - w) * wide[0], w * own[1] + (1 - w) * wide[1] + w * (1 - w) * off[:, None] * off[None]

    x = {k: np.array(vector(t)) for k, t, _, _ in rows}
    every = plain(np.array(list(x.values())))
    distances = {}
    for source in "ab":
        ids = [k for k, _, _, s in rows if s == source]
        center, cov = mixed(len(ids), plain(np.array([x[k] for k in ids])), mixed(len(x), every, every))
        for k in ids:
            distances[k] = float(np.sqrt((x[k] - center) @ np.linalg.inv(cov) @ (x[k] - center)))
    for k, d in distances.items():
        assert not found[k].base_failed and abs(found[k].distance - d) <= 0.1 * d + 0.2, (k, d, found[k])
        assert found[k].kept == (d <= found[k].cutoff) == (k % 10 != 0)


def test_quality_of_small_groups(spark):
    """Each source has its say, however few rows it has; long texts and a group of one."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9)))
    rows = [(k, " ".join(word() for _ in range(rnd.randint(60, 200))), "en", f"s{k % 40}") for k in range(400)]
    rows += [(1000, " ".join(word() for _ in range(60_000)), "de", "alone"), (1001, " ".join(word() + "**" for _ in range(90)), "en", "s3")]
    found = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [k for k, r in found.items() if not r.kept] == [1001]
    same = {r.doc_id: r.distance for r in quality.quality(spark.createDataFrame([(k, t, lang, "one") for k, t, lang, _ in rows], "doc_id long, text string, lang string, source string")).collect()}
    assert sum(abs(found[k].distance - same[k]) > 1e-3 for k in same) > 0.75 * len(same)  # the estimates are by source


def vector(text):
    n, chars, symbols, again, repeated, _ = base_quality(text)
    lines = len([x for x in text.split("\n") if WORD.search(x)])
    upper = sum("A" <= c <= "Z" for c in text)
    return [np.log(chars / n), np.log1p(10 * symbols / n), np.sqrt(repeated / n), np.sqrt(again / lines), np.sqrt(upper / chars)]


def test_valley():
    bands = np.arange(40, 200)
    n = np.where(bands < 120, 200 - bands, np.where(bands > 150, 5, 0))
    assert 2 ** (119 / 32) < quality.valley(bands[n > 0], n[n > 0]) < 2 ** (151 / 32)
    assert quality.valley(np.array([-10, 0, 10]), np.array([5, 9, 5])) >= quality.CHI2_FAR**0.5  # no tail at all


def test_low_quality_rows_that_repeat_an_id(spark):
    good = " ".join(f"word{k}x" for k in range(80))
    rows = [(1, good, "en", "s"), (1, "short", "en", "s"), (None, good, None, None), (None, "short", None, None), (2, None, "en", "s")]
    kept = quality.drop_low_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert sorted(map(str, kept)) == sorted(map(str, [spark.createDataFrame([r], "doc_id long, text string, lang string, source string").first() for r in (rows[0], rows[2])]))


def brute_secrets(text, encode):
    """Spans by other means: each start of a kind is tried in turn."""
    spans, at = [], 0
    key = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
    while at < len(text):
        m = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if text[at : at + len(w)].lower() == w), None)
        if m:
            i = at + len(m)
            i += i < len(text) and text[i] in "\"'"
            while i < len(text) and text[i] == " ":
                i += 1
            if i < len(text) and text[i] in ":=":
                i += 1
                while i < len(text) and text[i] == " ":
                    i += 1
                i += i < len(text) and text[i] in "\"'"
                j = i
                while j < len(text) and text[j] in key:
                    j += 1
                if j > i:
                    if j - i >= 8:
                        spans.append((at, 0, j))
                    at = j
                    continue
        at += 1
    for kind, chars, least in ((1, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16), (2, "0123456789abcdef", 32)):
        at = 0
        while at < len(text):
            begin = at + 4 if kind == 1 and text[at : at + 4] == "AKIA" else at
            j = begin
            while j < len(text) and text[j] in chars and (kind == 2 or begin > at):
                j += 1
            if j > begin:
                if j - at >= least:
                    spans.append((at, kind, j))
                at = j
            else:
                at += 1
    return sorted(spans)


def test_secrets_against_brute_force(spark):
    rnd = random.Random(12)
    bits = ["password", "Token", "api_key", "APIKEY", "secret", "AKIA", "=", ":", " ", "\"", "'", "abcdef", "0123456789", "ABCDEFGHIJKLMNOP", "é", "\n", "a1b2c3d4e5f60718", "x9Kq7vTz2LmW8pRd4sYb", "."]
    rows = [(k, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25)))) for k in range(600)]
    rows += [(None, "token=abcdefghij"), (1, rows[1][1]), (700, "word " * 100_000 + "secret=abcdefghijk")]
    encode = secrets.encoding(secrets.vocabulary("byte_bpe_50k.tiktoken")).encode_ordinary
    docs = spark.createDataFrame([(k, t, 3) for k, t in rows], "doc_id long, text string, spans long")
    found = sorted((str(r.doc_id), r.spans, r.base_sha256) for r in secrets.find_secrets(docs).collect())
    want = []
    for k, t in rows:
        base = brute_secrets(t, encode)
        more = secrets.random_spans(t, base, encode, secrets.EFFICIENCY)
        want.append((str(k), secrets.joined(sorted(base + more)), hashlib.sha256(secrets.joined(base).encode()).hexdigest()))
    assert found == sorted(want)


def test_secrets(spark, nothing):
    key = "x9Kq7vTz2LmW8pRd4sYb"
    cases = {
        "password = 'abcdefgh'": (1, 0, 0, 0),
        "password: short": (0, 0, 0, 0),
        "token=token:abcdefghij": (0, 0, 0, 0),
        "API_KEY=0123456789ab, api-key=zzzzzzzzzz": (1, 0, 0, 0),
        "AKIAABCDEFGHIJKL and AKIASHORT": (0, 1, 0, 0),
        "f" * 32 + " " + "a" * 31: (0, 0, 1, 0),
        "é " + key: (0, 0, 0, 1),
        "123e4567-e89b-12d3-a456-426614174000 getUserAccountById2 some-long-slug-with-words-2024": (0, 0, 0, 0),
        None: (0, 0, 0, 0),
        "": (0, 0, 0, 0),
    }
    rows = [(k, t) for k, t in enumerate(cases)]
    found = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, want in enumerate(cases.values()):
        assert (found[k].n_assign, found[k].n_access, found[k].n_hex, found[k].n_random) == want, rows[k]
    assert found[0].spans == "assign:0:20" and found[6].spans == "random:2:22"
    assert found[0].base_sha256 == hashlib.sha256(b"assign:0:20").hexdigest() and found[9].base_sha256 == hashlib.sha256(b"").hexdigest()
    hidden = {r.doc_id: r.text for r in secrets.redacted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert hidden[0] == "[SECRET]'" and hidden[8] is None and hidden[1] == "password: short"
    assert secrets.find_secrets(nothing).count() == 0


def test_secrets_of_letters_only(spark):
    keys = ["QwXzKvTbLmRpNdYsHjGf", "qzxkvjwpqhtrbnmdlfys", "Xqzkvbnmwprtylkj", "QZXKVJWPQHTRBNMDLFYS", "QwXz/KvTb+LmRpNdYsHjGf==", "api-key=QwXzKvTbLmRpNdYsHjGf"]
    words = ["internationalization", "Donaudampfschifffahrtsgesellschaft", "UnitedStatesOfAmerica", "getUserAccountById", "lorem-ipsum-dolor-sit-amet", "W-A-S-H-I-N-G-T-O-N", "a" * 31, "-" * 40, "1234567890" * 3]
    rows = [(k, f"see {s} here") for k, s in enumerate(keys + words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in secrets.find_secrets(docs).collect()}
    assert found == {k: f"random:4:{4 + len(s)}" if s in keys else "" for k, s in enumerate(keys + words)}
    hidden = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    assert hidden == {k: "see [SECRET] here" if s in keys else t for (k, t), s in zip(rows, keys + words, strict=True)}


def test_toxicity(spark, nothing):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randint(3, 9)))
    rows, labels = [], []
    for k in range(400):
        words = [word() for _ in range(60)]
        if k % 4 == 0:
            words[rnd.randrange(60)] = rnd.choice(["vilewort", "grumbix", "nastulo" + word()])
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 4 == 0)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, marks.where("doc_id % 5 <> 0"))
    scored = {r.doc_id: r for r in toxicity.toxicity(docs, lexicon).collect()}
    held = [k for k in range(400) if k % 5 == 0]
    assert sum(scored[k].predicted == int(k % 4 == 0) for k in held) >= 0.95 * len(held)
    odd = spark.createDataFrame([(1, "a v1lew0rt b"), (2, "а vilеwоrt"), (3, None), (4, ""), (5, "pond vilewort rose")], "doc_id long, text string")
    lexicon.exceptions = ("vilewort rose",)
    got = {r.doc_id: r for r in toxicity.toxicity(odd, lexicon).collect()}
    assert got[1].predicted == got[2].predicted == 1 and got[3].score == got[4].score == got[5].score and got[5].predicted == 0
    assert toxicity.toxicity(nothing, toxicity.learn(nothing, marks)).count() == 0
    assert {r.h for r in docs.select(toxicity.held_out().alias("h"), "doc_id").collect() if (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) != r.h} == set()


def test_packing(docs, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs).collect()
    ids = defaultdict(list)
    for r in docs.collect():
        ids[r.doc_id].append(np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4"))
    total = defaultdict(int)
    for r in rows:
        assert any(r.doc_tokens == len(x) and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        total[r.doc_id] += r.length
    assert total == {k: sum(map(len, v)) for k, v in ids.items()}
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(nothing).count() == 0


def test_patterns():
    rnd = random.Random(2)
    histogram = {rnd.randint(1, 64): rnd.randint(1, 500) for _ in range(60)}
    packed = packing.patterns(histogram, 64)
    used = defaultdict(int)
    for lengths, count in packed:
        assert sum(lengths) <= 64 and count > 0
        for n in lengths:
            used[n] += count
    assert used == histogram
    words = sum(n * c for n, c in histogram.items())
    assert sum(c for _, c in packed) * 64 < 1.1 * words + 64
    runs = packing.places(packed)
    for n in histogram:
        ranks = sorted((low, high) for m, low, high, *_ in runs if m == n)
        assert ranks[0][0] == 0 and ranks[-1][1] == histogram[n] - 1 and all(a[1] + 1 == b[0] for a, b in zip(ranks, ranks[1:]))


def test_patterns_like_item_by_item():
    """The histogram's form gives the packs that placing one piece after the other into the emptiest pack gives."""
    rnd = random.Random(1)
    for _ in range(200):
        length = rnd.choice([16, 50, 100])
        histogram = {n: rnd.randint(1, 6) for n in rnd.sample(range(1, length + 1), rnd.randint(1, 15))}
        rooms = []
        for n in sorted(histogram, reverse=True):
            for _ in range(histogram[n]):
                if rooms and max(rooms) >= n:
                    rooms[rooms.index(max(rooms))] -= n
                else:
                    rooms.append(length - n)
        got = sorted(length - sum(lengths) for lengths, count in packing.patterns(histogram, length) for _ in range(count))
        assert got == sorted(rooms)


def test_padding_is_little():
    rnd = random.Random(9)
    histogram = defaultdict(int)
    for _ in range(20_000):
        histogram[min(1024, int(rnd.expovariate(1 / 300)) + 1)] += 1
    packed = packing.patterns(histogram, 1024)
    assert sum(n * c for n, c in histogram.items()) > 0.9 * 1024 * sum(c for _, c in packed)


def test_mixing(docs, nothing):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    by_source = defaultdict(list)
    names = {r.doc_id: r.source for r in docs.collect()}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        by_source[names[r.doc_id]].append(r)
    total = sum(r.size for r in rows)
    targets = {s: v[0].target for s, v in by_source.items()}
    assert abs(sum(targets.values()) - total) < 1e-6 * total
    for source, found in by_source.items():
        assert all(r.source_size == sum(x.size for x in found) for r in found)
        assert targets[source] <= 3 * found[0].source_size
        assert abs(sum(r.taken for r in found) - targets[source]) <= max(r.size for r in found)
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix(nothing).count() == 0
    assert mixing.mixed(docs).columns == docs.columns


def mixed_by_hand(docs, target):
    """Words taken of docs(id, size): certain copies, then draws in Pareto order that fit, then the one that fits the rest best."""
    size = sum(n for _, n in docs)
    whole = int(target // size) if size else 0
    rest, certain = target - whole * size, set()
    while True:
        words = sum(n for i, n in docs if i in certain)
        squares = sum(n * n for i, n in docs if i not in certain)
        rate = (rest - words) / squares if squares else 0.0
        over = {i for i, n in docs if i not in certain and n * rate >= 1 and n > 0}
        if not over:
            break
        # the largest first, as the others' chances grow by them
        most = max(n for i, n in docs if i in over)
        certain |= {i for i, n in docs if i in over and n == most}
    taken = {i: n * (whole + (i in certain)) for i, n in docs}
    used, left = 0, []
    for ratio, i, n in sorted(((u := (int(hashlib.sha256(f"mix:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13) / (1 - u) / (rate * n / (1 - rate * n)), i, n) for i, n in docs if i not in certain and n * rate > 0):
        if used + n <= rest - words:
            used += n
            taken[i] += n
        else:
            left.append((ratio, i, n))
    gap = rest - words - used
    last = min(((abs(n - gap), ratio, i, n) for ratio, i, n in left if abs(n - gap) < gap), default=None)
    if last:
        taken[last[2]] += last[3]
    return taken


def test_mixing_like_by_hand(spark):
    """Sources with one document of 40% of their words, with many like ones, and with very different ones."""
    rnd = random.Random(3)
    rows = []
    for s in range(12):
        sizes = [rnd.randint(1, 20) for _ in range(60)] if s % 3 else [int(rnd.paretovariate(1)) for _ in range(60)]
        rows += [(1000 * s + k, "w " * n, f"s{s:02}") for k, n in enumerate([*sizes, sum(sizes) * 2 // 3])]
    rows += [(20_000 + k, "w " * n, None) for k, n in enumerate([1, 2, 3, 50])] + [(30_000, None, "t"), (30_001, "", "t")]
    found = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    by_source = defaultdict(list)
    for i, text, source in rows:
        by_source[source].append((i, len(text or "") // 2))
    for docs in by_source.values():
        want = mixed_by_hand(docs, found[docs[0][0]].target)
        assert {i: found[i].taken for i in want} == want
        assert abs(sum(want.values()) - found[docs[0][0]].target) <= max(1, 0.01 * found[docs[0][0]].target)


def test_chances_grow_with_size(spark):
    """Over many seeds a document twice as long is drawn about twice as often."""
    rows = [(k, "w " * (10 if k % 2 else 20), "ab"[k // 60]) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    extra = defaultdict(int)
    for seed in range(4):
        for r in mixing.mix(docs, seed=f"s{seed}", weights=(3, 5)).collect():
            extra[r.size] += r.taken // r.size - int(r.target // r.source_size)
    assert 1.4 < extra[20] / extra[10] < 2.8


def test_repeated_rows_are_mixed_once_each(spark):
    rows = [(1, "a b c", "s", 1), (1, "a b c", "s", 2), (None, "d e", None, 3), (None, "d e", None, 3), (2, "", "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    words = sum(r.taken for r in mixing.mix(docs).collect())
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and sum(len(r.text.split()) for r in mixed.collect()) == words


def test_targets_are_capped(spark):
    sizes = {"a": 10, "b": 1000, "c": 1000, None: 50}
    rows = mixing.source_targets(spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")).collect()
    weight = dict(zip(["a", "b", "c", None], (5, 2, 1, 5)))
    target, left = {}, sum(sizes.values())
    free = set(sizes)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
        left -= sum(target[s] for s in over)
        free -= over
    target |= share
    assert {r.source: pytest.approx(r.target) for r in rows} == target


def test_token_counts(docs, nothing, spark, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_scan, "SPAN", 3)  # so that a shard has several spans
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids))
    for options in ({"block": 64}, {"block": 1000, "width": 4}):
        got = defaultdict(list)
        for r in token_scan.document_token_counts(docs, **options).collect():
            assert r.ended
            got[r.doc_id].append(r.n_tokens)
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert token_scan.document_token_counts(nothing).count() == 0


def test_flat_token_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_scan, "SPAN", 4)
    rnd = np.random.default_rng(0)
    for name, n in (("a.bin", 1000), ("b.bin", 37), ("c.bin", 0)):
        ids = rnd.integers(0, 6, n).astype("<u2")
        ids[ids == 5] = 7
        ids.tofile(tmp_path / name)
    blocks = token_scan.read_token_files(spark, str(tmp_path), block=10)
    rows = sorted(token_scan.count_tokens(blocks, end=0).collect())
    want = []
    for name in ("a.bin", "b.bin"):
        ids = np.fromfile(tmp_path / name, "<u2")
        start = ordinal = 0
        for end in np.flatnonzero(ids == 0):
            want.append((name, ordinal, start, int(end) - start, True))
            start, ordinal = int(end) + 1, ordinal + 1
        if start < len(ids):
            want.append((name, ordinal, start, len(ids) - start, False))
    assert [(r.shard.rpartition("/")[2], r.ordinal, r.start, r.n_tokens, r.ended) for r in rows] == sorted(want)
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="no multiple"):
        token_scan.read_token_files(spark, str(tmp_path)).count()


def test_pii(spark, docs, nothing):
    mentions = "Mail ann.lee@corp.example.com or Ann.Lee@corp.example.com. Call +1 (743) 555-3824, (743) 555-3824. Card 4111 1111 1111 1111, 10.1.2.3. Frau Müller and Mr. John Smith, г-жа Иванова. GB82 WEST 1234 5698 7654 32 078-05-1120"
    rows = [(1, mentions, 9), (2, "again ann.lee@corp.example.com", 9), (3, None, 9), (4, "", 9), (5, "no 12 such 3 things", 9), (6, mentions, 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_entities long")
    got = {r.doc_id: r for r in pii.replace_entities(frame).collect()}
    assert got[3].text is None and got[4].text == "" and got[5].text == rows[4][1] and got[5].n_entities == 0
    assert got[1].text == got[6].text and got[1].n_entities >= 9
    out = got[1].text
    for private in ("ann.lee", "555-3824", "4111", "10.1.2.3", "Müller", "John Smith", "Иванова", "5698", "078-05"):
        assert private not in out
    emails = re.findall(r"[\w.]+@[\w.]+\.com", out)
    assert len(emails) == 2 and emails[0] == emails[1].lower() and emails[0] in got[2].text
    card = re.search(r"Card (\d{4} \d{4} \d{4} \d{4}),", out)[1].replace(" ", "")
    assert sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(card)) % 10 == 0
    phones = re.search(r"Call \+1 (\(\d{3}\) \d{3}-\d{4}), (\(\d{3}\) \d{3}-\d{4})\.", out)
    assert phones and phones[1] == phones[2]
    iban = re.search(r"GB\d\d \w{4} \d{4} \d{4} \d{4} \d\d", out)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert re.search(r"Frau [A-Z][a-z]+ and Mr\. [A-Z][a-z]+ [A-Z][a-z]+, г-жа [А-Я][а-я]+\.", out)
    assert {r.text for r in pii.replace_entities(frame, key="other").collect()} != {r.text for r in got.values()}
    assert pii.replace_entities(docs).drop("n_entities").columns == docs.columns
    assert pii.replace_entities(nothing).count() == 0


def test_surrogates_differ(spark):
    rows = [(k, f"10.0.{k // 250}.{k % 250} and 0{k:02d}-11-{1000 + k}") for k in range(600)]
    got = pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.text.split(" and ")[0] for r in got}) == 600


def test_people_and_domains_keep_their_identity(spark):
    texts = [
        "Dr Smith met Mr Smith. Mr. John Smith left; Smith's dog stayed with John.",
        "John Smith and Frau Smith",
        "Mrs Anne-Marie Weber-Klein, then Weber",
        "ann@mail7.example.com Bob@Mail7.example.com ann@example.com ann@other.org",
        "г-жа Иванова и Иван Петров, г-н Иванова",
    ]
    rows = pii.replace_entities(spark.createDataFrame(list(enumerate(texts)), "k long, text string")).collect()
    out = {r.k: r.text for r in rows}
    m = re.fullmatch(r"Dr (\w+) met Mr (\w+)\. Mr\. (\w+) (\w+) left; (\w+)'s dog stayed with (\w+)\.", out[0])
    assert m and m[1] == m[2] == m[4] == m[5] != "Smith" and m[3] == m[6] != "John"
    assert out[1] == f"{m[3]} {m[1]} and Frau {m[1]}" and m[3] in pii.GIVEN["male", "latin"]
    w = re.fullmatch(r"Mrs (\w+)-(\w+) (\w+)-(\w+), then (\w+)", out[2])
    assert w and w[3] == w[5] != "Weber" and w[1] != "Anne"
    mail = re.fullmatch(r"(\S+)@(\w+)\.(\w+)\.com (\S+)@(\w+)\.(\w+)\.com (\S+)@(\w+)\.com (\S+)@(\w+)\.org", out[3])
    assert mail and mail[2] == mail[5].lower() and mail[3] == mail[6] == mail[8] != "example" and mail[4][0].isupper() and mail[10] != mail[8]
    c = re.fullmatch(r"г-жа (\w+) и (\w+) (\w+), г-н (\w+)", out[4])
    assert c and c[1] == c[4] != "Иванова" and c[2] in pii.GIVEN["male", "cyrillic"]


def test_surrogates_over_a_table(spark):
    """Brute force: a mention's surrogate is a function of its entity, different entities stay different, no real one is used."""
    rnd = random.Random(4)
    family = ["".join(rnd.choice(pii.SYLLABLES["latin"]) for _ in range(4)).capitalize() for _ in range(250)]  # real names that look like made ones
    given = pii.GIVEN["male", "latin"] + pii.GIVEN["female", "latin"]
    rows, real = [], []
    for k in range(500):
        f, g, ssn = rnd.choice(family), rnd.choice(given), f"{rnd.randint(1, 99):03d}-{rnd.randint(1, 99):02d}-{rnd.randint(1, 9999):04d}"
        mail = f"{rnd.choice('abc')}@{rnd.choice('xyz')}.net"
        real.append((g, f, ssn, mail))
        rows.append((k, f"{g} {f} | {ssn} | {mail}"))
    made = [(*r.text.split(" | ")[0].split(" "), *r.text.split(" | ")[1:]) for r in sorted(pii.replace_entities(spark.createDataFrame(rows, "k long, text string")).collect(), key=lambda r: r.k)]
    for column in range(4):
        pairs = {(a[column].lower(), b[column].lower()) for a, b in zip(real, made, strict=True)}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
        if column != 3:
            assert {a for a, _ in pairs}.isdisjoint({b for _, b in pairs})
    names = {x[k].lower() for x in real for k in (0, 1)}
    assert names.isdisjoint({x[k].lower() for x in made for k in (0, 1)})


def test_long_texts_of_pii(spark):
    rows = [(1, "x@" + "a." * 50_000 + "com"), (2, "1 " * 100_000), (3, "Mr " * 50_000), (4, "word " * 100_000 + "x@y.de")]
    got = {r.doc_id: r for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[4].n_entities == 1 and "x@y.de" not in got[4].text and len(got) == 4


def test_licenses(spark, nothing):
    apache = licenses.TEMPLATES["Apache-2.0/notice"]
    changed = "é Copyright 2020\n# " + licenses.TEMPLATES["MIT"].replace("copy", "xerox").replace(" of ", " of\n# ")
    rows = [(1, "x " + apache + " y"), (2, "released under THE MIT license; more"), (3, None), (4, ""), (5, "the license of words"), (6, changed), (2, "released under THE MIT license; more"), (None, apache), (8, "word " * 200_000 + apache)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    found = licenses.find_licenses(docs).collect()
    got = {r.doc_id: r for r in found}
    assert sorted(map(str, (r.doc_id for r in found))) == sorted(map(str, (1, 2, 2, 6, None, 8)))
    assert (got[1].license, got[1].start, got[1].end, got[1].coverage) == ("Apache-2.0/notice", 2, 1 + len(apache), 1.0)
    assert got[2].license == "MIT/notice" and got[6].license == "MIT" and 0.9 < got[6].coverage < 1 and got[8].start == 1_000_000
    assert licenses.find_licenses(nothing).count() == 0


def test_licenses_that_are_worded_alike(spark):
    texts = ["Released under the BSD License.", "licensed under the GNU General Public License, version 2.", "Licensed under CC BY-ND 4.0.", "Licensed under CC BY 4.0.", "Released under the Foo License.", "This work is licensed under the GNU General Public License, version 1."]
    got = {r.doc_id: r.license for r in licenses.find_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "BSD/notice", 1: "GPL-2.0/notice", 2: "CC-BY-ND-4.0/notice"}
    index = licenses.Index(licenses.TEMPLATES, licenses.TELLING)
    for name, text in licenses.TEMPLATES.items():
        assert [m[0] for m in index.matches(f"some words {text} and others", 0.7)] == [name]


def brute_alignment(template, words):
    """The best local alignment's score, over all cells."""
    best, above = 0, [0] * (len(words) + 1)
    for t in template:
        row = [0]
        for j, w in enumerate(words):
            row.append(max(0, above[j] + (2 if t == w else -1), above[j + 1] - 1, row[j] - 1))
        best, above = max(best, *row), row
    return best


def test_alignment_against_brute_force():
    rnd = random.Random(2)
    for _ in range(100):
        template = [rnd.choice("abcdefgh") * 2 for _ in range(25)]
        words = [w for w in template if rnd.random() < 0.9]
        for _ in range(2):
            words.insert(rnd.randrange(len(words)), "zz")
        text = " ".join(["qq"] * 5 + words + ["qq"] * 5)
        found = list(licenses.WORDS.finditer(text))
        matched, first, last = licenses.align(template, found, 5)
        # inside the band the best path is found: its matched words make up the score, less the changes
        full = brute_alignment(template, [m[0] for m in found])
        assert 2 * len(matched) >= full and [m[0] for m in found[first : first + 1]] != ["qq"] and first <= last


def test_toxic_lexicon_against_brute_force(spark):
    rnd = random.Random(7)
    stems = ["vilewort", "grumb", "nast"]
    lexicon = toxicity.Lexicon({"vilewort ": 4.0, "grumb": 3.0, "nast": 2.0, "nasty ": 5.0}, exceptions=("grumb cake", "nasty weather"))
    bits = [*stems, "nasty", "grumbling", "vileworts", "cake", "weather", "a", ".", "word", "GRUMB", "vi1ewort", "n4sty"]
    rows = [(k, " ".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30)))) for k in range(300)] + [(None, "grumb"), (1, "grumb"), (400, "word " * 100_000 + "nast")]
    got = sorted((str(r.doc_id), round(r.strength, 9)) for r in toxicity.toxicity(spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double"), lexicon).collect())

    def by_hand(text):
        s = toxicity.folded(text)
        total = 0.0
        for m in re.finditer(r"[^\W\d_]+", s):
            word = m[0]
            weights = [w for e, w in lexicon.weights.items() if (word == e[:-1] if e.endswith(" ") else word.startswith(e))]
            calm = any(p in s[max(0, m.start() - len(p)) : m.start() + len(p)] and any(i <= m.start() < i + len(p) for i in range(len(s)) if s.startswith(p, i)) for p in lexicon.exceptions)
            if weights and not calm:
                total += max(weights)
        return total / max(1.0, ((s.count(" ") + 1) / 100) ** 0.5)

    assert got == sorted((str(k), round(by_hand(t), 9)) for k, t in rows)


def test_recurring_words_are_encoded_once(monkeypatch):
    """Also where a batch has more different words than are remembered."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "CACHED", 3)
    path = tokens.vocabulary()
    ours, library = tokens.Encoder(path), Tokenizer.from_file(path)
    library.encode_special_tokens = True
    texts = [f"first{k} the word{k} of <|endoftext|> a\n.\tb the été{k}́ of" + "\n" * (k % 3) for k in range(1200)] + ["", "x  y", " z ", "\n", "alone", "the\x1c of"]
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in ours.batch(pa.array([*texts, None]))]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in [*texts, ""]]
    assert set(ours.cache) <= {"the", "of", "<|endoftext|>", "a\n.\tb"} and len(ours.cache) == 3
