import random
from collections import Counter

import corpus_pipeline
from geoloom.llm.shared import stored


def test_stages(spark):
    base = "the cat and the dog walk along a river while people talk about weather in town "
    rows = [(i, f"{base} number{i} {base} item{i % 50} other{i}" if i % 4 else f"BUY!! NOW!! $$$ ||| {i} !! " * 9, "en", f"s{i % 3}", 0) for i in range(400)]
    rows += [(1000, rows[1][1], "en", "s0", 0), (1001, "write to a.b@x.org about the weather in town and the river that people walk along", "en", "s1", 0), (1002, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    path = stored(spark.createDataFrame([(i, 1 if i % 4 else 0, 0) for i in range(0, 200)], "doc_id long, quality int, toxic int"), "labels")._geoloom_path
    sf_dir = path + "-dir"
    spark.read.parquet(path).write.mode("overwrite").parquet(f"{sf_dir}/labels.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, sf_dir), "test-stage")
        seen.append((name, docs.count(), after.count()))
        if name != "packing":
            assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "PII":
            assert not after.where("text like '%a.b@x.org%'").count()
        if name == "n-gram Jaccard join":
            assert after.select("doc_id").distinct().count() == after.count() and not after.where("doc_id = 1000").count()
        docs = after
    assert seen[0][2] < seen[0][1] and seen[3][2] != seen[3][1] and "sequence_id" in docs.columns


def _words(seed, n=60):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(500)}" for _ in range(n))


def test_one_of_each_group_stays(spark):
    a, b, c = _words(1), _words(2), _words(3)
    rows = [(4, a, "x"), (2, f"{a} more", "y"), (2, f"{a} more", "y"), (None, a, "z"), (5, b, "x"), (5, c, "x"), (None, "", None), (None, None, None), (7, "", "x"), (7, "", "x"), (None, _words(4), "x")]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string, component string"), "docs")
    out = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in out) == sorted([(2, f"{a} more"), (5, min(b, c, key=lambda t: _hash(spark, t))), (0, ""), (0, ""), (7, ""), (7, ""), (0, _words(4))])
    assert out[0].asDict().keys() == {"doc_id", "text", "component"}
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def _hash(spark, text):
    return spark.createDataFrame([(text,)], "t string").selectExpr("xxhash64(t)").first()[0]


def test_mixture_keeps_columns_and_counts(spark):
    rows = [(i, _words(i, 5 + i % 20), f"s{i % 3}", i, None) for i in range(600)] + [(1, _words(1, 6), "s1", 7, 7), (1, _words(1, 6), "s1", 7, 7), (None, _words(9, 9), None, 1, 1), (900, None, "s0", 1, 1)]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string, source string, size int, copies int"), "docs")
    out = corpus_pipeline.mixture(spark, docs, "").collect()
    assert out[0].asDict().keys() == {"doc_id", "text", "source", "size", "copies"}
    words, taken = Counter(), Counter()
    for _, t, s, *_ in rows:
        words[s] += len((t or "").split())
    for r in out:
        taken[r.source] += len(r.text.split())
    assert all(taken[s] <= 2 * words[s] for s in words) and abs(sum(taken.values()) - 1.5 * sum(words.values())) <= 4 * 30
    assert {r.doc_id for r in out} <= {r[0] for r in rows}
    assert corpus_pipeline.mixture(spark, docs.limit(0), "").count() == 0
