"""The pipeline on a small corpus of which every stage's decisions are known."""

import random

import corpus_pipeline
from stratagraph.llm import vocab


def corpus(rng):
    common = "the of and to in that is was for on as with by at from".split()
    body = lambda n=120: " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("bcdlmnrst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(n))
    passage = "seven grey herons walked across the frozen harbour before anyone had thought to count them twice"
    rude = "wretch lout oaf dolt cad".split()
    docs, labels, kind = [], [], {}

    def add(k, text, quality=None, toxic=None):
        kind[len(docs)] = k
        if quality is not None:
            labels.append((len(docs), quality, toxic))
        docs.append((len(docs), text, "en", f"src{len(docs) % 3}", len(text)))

    for k in range(300):
        add("clean", body(), *((1, 0) if k % 2 else ()))
    for k in range(60):
        w = body().split()
        for at in rng.sample(range(len(w)), 8):
            w[at] = rng.choice(rude)
        add("toxic", " ".join(w), *((1, 1) if k % 2 else ()))
    for k in range(60):
        add("junk", " ".join(x + "$$$" for x in body().split()), *((0, 0) if k % 2 else ()))
    for k in range(20):
        add("copy", docs[k][1] + " also")
    for _ in range(10):
        add("leak", body(60) + " " + passage + " " + body(60))
    return docs, labels, kind, passage


def test_every_stage(spark, tmp_path):
    docs, labels, kind, passage = corpus(random.Random(8))
    sf = str(tmp_path)
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    at = spark.read.parquet(f"{sf}/documents.parquet")
    columns, left = at.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf)
        assert at.columns == columns
        at.write.parquet(f"{sf}/{name}")
        at = spark.read.parquet(f"{sf}/{name}")
        left[name] = {}
        for r in at.collect():
            left[name][kind[r.doc_id]] = left[name].get(kind[r.doc_id], 0) + 1
    assert left["toxicity"] == {"clean": 300, "junk": 60, "copy": 20, "leak": 10}
    assert left["quality rules"] == {"clean": 300, "copy": 20, "leak": 10}
    assert left["near-duplicates"] == {"clean": 300, "leak": 10}
    assert left["decontamination"] == {"clean": 300}
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == {k for k, v in kind.items() if v == "clean"}
    assert sum(r.n_tokens for r in packed) == sum(len(vocab.encoding().encode(d[1])) for d in docs if kind[d[0]] == "clean")


def test_empty_tables(spark, tmp_path):
    sf = str(tmp_path)
    for name, schema in (("documents", "doc_id bigint, text string, lang string, source string, n_chars bigint"), ("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{sf}/{name}.parquet")
    assert not corpus_pipeline.run(spark, sf).collect()
