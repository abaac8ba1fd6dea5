"""Stages of the corpus pipeline against brute force."""

import re
from collections import Counter

import corpus_pipeline
from tallyworks.llm import quality
from tallyworks.llm.store import stage

from .test_pairs_and_sets import brute_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contaminated(text, items, width=10):
    words = words_of(text)
    for item in map(words_of, items):
        n = min(width, len(item))
        windows = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)} if item else set()
        if any(tuple(words[i : i + n]) in windows for i in range(len(words) - n + 1)):
            return True
    return False


def test_leaks_stage_drops_whole_short_items(spark, docs, corpus, tmp_path):
    """Items of 1 to 7 words count when a text holds them in full, as in op8."""
    items = ["one TWO", " ".join(corpus[0][9][1].split()[3:10]), " ".join(corpus[0][7][1].split()[5:25]), None, "!!"]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.leaks_stage(spark, docs, str(tmp_path))
    want = [r[0] for r in corpus[0] if not contaminated(r[1], items)]
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(i or -1 for i in want)
    assert not {7, 9, 404, 405} & set(want) and 403 in want


def test_run_stage_by_stage(spark, docs, labels, corpus, tmp_path):
    """Each stage on what its predecessor kept, and run() on the whole."""
    items = ["one TWO", " ".join(corpus[0][7][1].split()[5:25])]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now, out = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, function in corpus_pipeline.STAGES:
        now = stage(function(spark, now, str(tmp_path)), f"test-{name.replace(' ', '-')}")
        out[name] = [(r.doc_id, r.text) for r in now.collect()] if name != "sharding" else [r.doc_id for r in now.collect()]
    scores = quality.score_quality(docs, labels).where("score >= 0.3").collect()
    assert Counter(i for i, _ in out["quality"]) == Counter(r.doc_id for r in scores)
    least = {c for i, _, c in brute_components(out["quality"], 5, 80, 100) if i is not None}
    assert Counter(i for i, _ in out["near copies"] if i is not None) == Counter(least)
    assert Counter(out["benchmark leaks"]) == Counter(r for r in out["near copies"] if not contaminated(r[1], items))
    assert out["mixing"] and set(out["mixing"]) <= set(out["benchmark leaks"])
    assert Counter(out["sharding"]) == Counter(i for i, _ in out["mixing"])
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == Counter(out["sharding"])
