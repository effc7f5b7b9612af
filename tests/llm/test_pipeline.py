"""The pipeline: each stage against brute force on what its predecessor kept."""

import random
from collections import defaultdict

import corpus_pipeline
from riskframe.llm import secrets
from tests.llm.test_documents import WORD, base_quality, shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark):
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choice("abcdefghijk") for _ in range(rnd.randint(2, 9))) for _ in range(500)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    texts = [prose(rnd.randint(60, 120)) for _ in range(60)]
    texts += texts[:5] + [t + " " + prose(3) for t in texts[5:10]]
    texts += [None, "", "too short", texts[0].replace(" ", "*** "), prose(70) + " password=abcdefghijk end"]
    docs = spark.createDataFrame([(k, t, "en", "ab"[k % 2], len(t or "")) for k, t in enumerate(texts)], SCHEMA)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = kept.collect()
        kept = spark.createDataFrame(stage(spark, kept, "").collect(), SCHEMA)
        after = kept.collect()
        assert kept.columns == docs.columns
        if name == "quality rules":
            ids = {r.doc_id for r in after}
            assert set(range(70)) <= ids and ids.isdisjoint({70, 71, 72, 73})
            assert all(not base_quality(r.text)[5] for r in after)
        elif name == "near duplicates":
            sets = {r.doc_id: shingles(r.text) for r in before}
            near = defaultdict(set)
            for a in sets:
                for b in sets:
                    if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                        near[b].add(a)
            assert {r.doc_id for r in after} == {i for i in sets if not near[i]}
        elif name == "secret scans":
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
            assert all(not secrets.base_spans(r.text) and r.n_chars == len(r.text) for r in after)
        else:
            words = lambda rows: sum(len(WORD.findall(r.text)) for r in rows)
            assert {r.doc_id for r in after} <= {r.doc_id for r in before}
            assert abs(words(after) - words(before)) <= 0.02 * words(before)
    packed = corpus_pipeline.STAGES[4][1](spark, kept, "").collect()
    total = defaultdict(int)
    for r in packed:
        total[r.sequence_id] += r.length
    assert max(total.values()) <= 1024 and {r.doc_id for r in packed} == {r.doc_id for r in kept.collect()}


def test_stages_of_odd_rows(spark):
    """Empty tables, nulls, repeated rows and ids, long texts, and columns whose names the stages use themselves."""
    good = " ".join(f"word{k}x" for k in range(80))
    other = " ".join(f"thing{k}y" for k in range(90))
    rows = [(1, good, None, None, None), (1, good, "en", "a", 5), (1, other, "en", "a", 5), (None, good, "en", "a", 5), (None, None, None, None, None), (2, "", "en", "b", 0), (3, other * 2000, "en", "b", 9), (4, None, "en", "b", 0)]
    extra = [(*r, 7, "k", 1, 2, 3.0) for r in rows]
    schema = SCHEMA + ", id long, key string, size long, component_id long, kept double"
    docs = spark.createDataFrame(extra, schema)
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, frame, "")
            n = after.count()
            if name != "packing":
                assert after.columns == frame.columns
            if frame.isEmpty():
                assert n == 0
    kept = corpus_pipeline.keep_one_of_each(spark, docs, "").collect()
    # one row of id 1, of which 3 is a near copy, all rows without an id, and one of each other document
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "4", "None", "None"]


def test_run(spark, tmp_path):
    rows = [(k, f"word{k} " * 60, "en", "s", 400) for k in range(5)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
