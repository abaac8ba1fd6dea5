"""Joins, dedup, sharding and scans against brute force."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyworks.llm import components, decontaminate, exact_dedup, licenses, ngram_jaccard, sharding

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute_components(rows, width, num, den):
    keyed = [(r[0], shingle_set(r[1], width)) for r in rows]
    parent = list(range(len(keyed)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, (_, a) in enumerate(keyed):
        for j in range(i):
            b = keyed[j][1]
            both = len(a & b)
            if a and b and den * both >= num * (len(a) + len(b) - both):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (k, _) in enumerate(keyed):
        least[find(i)].append(k)
    ids = {c: min((x for x in v if x is not None), default=None) for c, v in least.items()}
    return Counter((k, len(s), ids[find(i)]) for i, (k, s) in enumerate(keyed))


@pytest.mark.parametrize(("width", "num"), [(4, 85), (5, 80), (3, 60)])
def test_jaccard_components(docs, corpus, width, num):
    rule = ngram_jaccard.Threshold(width, num, 100)
    got = ngram_jaccard.jaccard_components(docs, rule).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(corpus[0], width, num, 100)


@pytest.mark.parametrize(("width", "num", "part"), [(4, 85, 500), (5, 80, 3)])
def test_jaccard_counts_links(docs, corpus, monkeypatch, width, num, part):
    """Every link between rows counts, inside components and of copies too, in one block or several."""
    monkeypatch.setattr(ngram_jaccard, "PART_SETS", part)
    got = ngram_jaccard.jaccard_components(docs, ngram_jaccard.Threshold(width, num, 100), links_too=True).collect()
    sets, want = [shingle_set(r[1], width) for r in corpus[0]], Counter()
    for i, a in enumerate(sets):
        both = [(len(a & b), len(a | b)) for j, b in enumerate(sets) if j != i and a and b]
        want[(corpus[0][i][0], sum(100 * x >= num * y for x, y in both))] += 1
    assert Counter((r.doc_id, r.n_links) for r in got) == want and max(r.n_links for r in got) > 4


def test_jaccard_keeps_one(docs, corpus, none):
    kept = ngram_jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    want = {c for k, _, c in brute_components(corpus[0], 5, 80, 100) if k is not None}
    assert Counter(r.doc_id for r in kept.collect() if r.doc_id is not None) == Counter(want)
    assert ngram_jaccard.keep_one(none).count() == 0


def test_jaccard_keeps_one_of_repeated_keys(spark):
    """A key over unrelated texts loses only the rows whose own text is linked."""
    texts = {t: " ".join(f"{t}{i}" for i in range(60)) for t in "abcde"}
    near = {t: x + " more" for t, x in texts.items()}
    rows = [(1, texts["a"], 1), (1, texts["b"], 2), (1, texts["a"], 3), (1, near["b"], 4), (2, near["a"], 5), (2, texts["c"], 6)]
    rows += [(3, near["b"], 7), (3, texts["d"], 8), (4, near["d"], 9), (5, texts["e"], 10), (6, texts["e"], 11), (None, texts["a"], 12)]
    kept = ngram_jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, n int"))
    got = [(r.doc_id, r.text[0]) for r in kept.collect()]
    assert Counter(got) == Counter([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (5, "e"), (None, "a")])


def test_jaccard_copies_meet_at_the_text_that_they_are_of(spark, monkeypatch):
    """Copies that only their text links are joined to it by a star, not compared with each other."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 301):
        copy = list(base)
        for at in rng.sample(range(0, 150, 10), 3):
            copy[at + 5] = f"edit{i}"
        rows.append((i, " ".join(copy)))
    left = []
    pairwise = ngram_jaccard._pairwise
    monkeypatch.setattr(ngram_jaccard, "_pairwise", lambda *a: left.append(a[0].count()) or pairwise(*a))
    got = ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 5, 80, 100)
    assert {r.component_id for r in got} == {0} and not left


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.floats(0, 0.3), st.integers(0, 10**6))
def test_signatures_never_miss(size, change, seed):
    """Any two sets over the threshold share a key, whatever their sizes."""
    import numpy as np

    rule = ngram_jaccard.Threshold(5, 80, 100)
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 1 << 62, size, dtype=np.uint64))
    b = np.unique(np.where(rng.random(len(a)) < change, rng.integers(0, 1 << 62, len(a), dtype=np.uint64), a))
    b = b[: max(1, len(b) - int(rng.integers(0, 1 + size // 10)))]
    both = len(np.intersect1d(a, b))
    if 100 * both >= 80 * (len(a) + len(b) - both) and len(a) + len(b) > 2 * both:
        x, y = ngram_jaccard.signatures([a, b], rule)
        assert set(x.tolist()) & set(y.tolist())


def test_components(spark):
    edges = [(5, 6), (6, 7), (1, 7), (20, 21), (22, 21), (30, 31)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in (1, 5, 6, 7)} == {1} and {got[i] for i in (20, 21, 22)} == {20}
    assert {got[i] for i in range(100, 141)} == {100}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_exact_dedup(spark, docs, corpus, none):
    got = exact_dedup.dedup(docs).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in corpus[0]:
        groups[norm(r[1])].append(r[0])
    want = Counter()
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.dedup(none).count() == 0


def test_index_is_persistent(spark, docs, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    first = exact_dedup.dedup_batch(docs.where("doc_id < 100"), index, "a").where("kept").count()
    again = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    second = exact_dedup.dedup_batch(docs, again, "b")
    assert second.where("kept").count() + first == again.rows().count() == docs.select(exact_dedup.digest(F.col("text"))).distinct().count()


def test_decontamination(spark, corpus, docs, none):
    bench = [(1, " ".join(corpus[0][7][1].split()[5:25])), (2, "one TWO"), (3, None), (10, "!!"), (4, " ".join(corpus[0][7][1].split()[10:21]))]
    found = {}
    for r in decontaminate.find_contamination(docs, spark.createDataFrame(bench, "item_id long, text string")).collect():
        found.setdefault(r.doc_id, r)
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    for row in corpus[0]:
        words, hit, items = word(row[1]), set(), set()
        for item, text in bench:
            w = word(text)
            n = min(10, len(w))
            for k in range(len(w) - n + 1) if w else ():
                for i in range(len(words) - n + 1):
                    if words[i : i + n] == w[k : k + n]:
                        hit.update(range(i, i + n))
                        items.add(item)
        r = found[row[0]]
        assert (r.n_words, r.n_hit, sorted(r["items"])) == (len(words), len(hit), sorted(items))
        assert sum(len(word(row[1][s.start : s.end])) for s in r.spans) == len(hit)
    kept = decontaminate.clean(docs, spark.createDataFrame(bench, "item_id long, text string"))
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in corpus[0] if not found[r[0]].n_hit)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(docs, empty).where("n_hit > 0").count() == 0
    assert decontaminate.find_contamination(none, empty).count() == 0
    parts = decontaminate.find_contamination(docs, spark.createDataFrame(bench, "item_id long, text string"), part_bytes=60)
    assert Counter((r.doc_id, r.n_hit) for r in parts.collect() if r.n_hit) == Counter(
        (r[0], found[r[0]].n_hit) for r in corpus[0] if found[r[0]].n_hit
    )


def test_sharding(docs, corpus, none):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == len(corpus[0])
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40 and r.law == "key"
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    by_id = {r.doc_id: r for r in rows}
    for i, text, *_ in corpus[0]:
        data = (text or "").encode()
        assert (by_id[i].size, by_id[i].text_crc32) == (len(data) + 16, zlib.crc32(data))
    assert sharding.shard_documents(none).count() == 0


def brute_shard(i, tree, appended=()):
    """The descent in plain Python."""

    def draw(node, weight):
        h = xxhash.xxh64_intdigest(struct.pack("<q", node), xxhash.xxh64_intdigest(struct.pack("<q", i), 42))
        return -math.log(((h >> 11) + 0.5) / 2**53) / weight

    at, first = 0, None
    for kind, fanout, weights in zip((1, 2, 3), (10**9, tree.racks_per_region, tree.shards_per_rack), tree.level_weights(), strict=True):
        children = range(at * fanout, min(at * fanout + fanout, len(weights)))
        best = min((draw((kind << 40) + c, weights[c]), c) for c in children)
        first, at = first or best, best[1]
    return min([(first[0], -1, at), *[(draw((4 << 40) + k, w), k, tree.shards + k) for k, w in enumerate(appended)]])[2]


def shards_of(spark, n, tree):
    rows = sharding.assign(spark.range(n).withColumn("text", F.lit("x")), tree, "id")
    return {r.id: (r.shard, r.grown_shard) for r in rows.collect()}


def test_tree_descends(spark):
    """Placement is that of the descent, grown too, and not that of the smallest of all draws."""
    for tree in (sharding.Tree(40), sharding.Tree(7, 2, 2, (1.0, 1.0, 4.0, 1.0, 1.0, 2.0, 0.5), (3.0,))):
        got = shards_of(spark, 400, tree)
        assert got == {i: (brute_shard(i, tree, tree.appended), brute_shard(i, tree, (*tree.appended, 1.0))) for i in range(400)}
    flat = {i: min(range(40), key=lambda c: xxhash.xxh64_intdigest(struct.pack("<q", (3 << 40) + c), xxhash.xxh64_intdigest(struct.pack("<q", i), 42))) for i in range(400)}
    assert sum(flat[i] != s for i, (s, _) in shards_of(spark, 400, sharding.Tree(40)).items()) > 300


def test_weights_decide(spark):
    tree = sharding.Tree(6, 2, 2, (1.0, 1.0, 4.0, 1.0, 1.0, 2.0))
    place = lambda n, t: {i: s for i, (s, _) in shards_of(spark, n, t).items()}
    counts = Counter(place(20_000, tree).values())
    for level, of in zip(tree.level_weights(), (4, 2, 1), strict=True):
        for node, weight in enumerate(level):
            assert math.isclose(sum(n for s, n in counts.items() if s // of == node), 2_000 * weight, rel_tol=0.1)
    a, b = place(5_000, tree), place(5_000, sharding.Tree(6, 2, 2, (1.0, 1.0, 4.0, 1.0, 1.0, 3.0)))
    assert all(b[i] // 4 == 1 for i in a if a[i] != b[i])  # into the region that grew only
    assert all(b[i] == 5 for i in a if a[i] // 4 == 1 and a[i] != b[i])  # and inside it into the shard that grew
    grown = shards_of(spark, 20_000, tree.grown(5.0).grown(5.0))
    counts = Counter(s for s, _ in grown.values())
    assert all(math.isclose(counts[s], 20_000 * 5 / 20, rel_tol=0.1) for s in (6, 7))


def test_licenses(spark, corpus, none):
    lines = list(licenses.TEMPLATES.values())
    texts = [f"{r[1]} {lines[k % len(lines)]} tail words here" for k, r in enumerate(corpus[0][:60])]
    texts += ["", None, "MIT", lines[4].replace("sublicense", "resell"), " ".join(lines[4].split()[:20]), lines[0] + " " + lines[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("license", F.lit("clash"))
    got = {(r.doc_id, r.license): (r.containment, r.first_word) for r in licenses.scan_licenses(docs).collect()}

    def hashes(text):
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    want = {}
    for i, text in enumerate(texts):
        h = hashes(text)
        for name, template in licenses.TEMPLATES.items():
            s = set(hashes(template))
            step = math.ceil(len(s) / 4)
            shares = [(len(s & set(h[a : a + len(s) + step])) / len(s), -a) for a in range(0, len(h), step)]
            if shares and max(shares)[0] >= 0.8:
                want[(i, name)] = (max(shares)[0], -max(shares)[1])
    assert got == want and len(want) >= 60
    own = spark.createDataFrame([("own", " ".join(lines[4].split()[:20])), (None, "x"), ("empty", None)], "license string, text string")
    assert {r.license for r in licenses.scan_licenses(docs, own).collect()} == {"own"}
    worst = min(licenses.least_similarity(s) for s in range(1, 400))
    assert worst == 0.5 and (1 - worst) ** len(licenses.band_seeds(list(range(1, 400)))) <= licenses.MISS
    assert licenses.scan_licenses(none).count() == 0


def test_matcher_against_windows():
    """Occurrences of whole windows, items shorter than a window and repeated words."""
    rng = random.Random(3)
    for _ in range(400):
        width = rng.choice([1, 2, 3, 5, 10])
        items = [(i, " ".join(rng.choices("abc", k=rng.randint(0, 14)))) for i in range(3)]
        words = decontaminate.words_of(" ".join(rng.choices("abcz", [5, 5, 5, 1], k=rng.randint(0, 40))))
        hit, ids = set(), set()
        for item, text in items:
            own = decontaminate.words_of(text)
            n = min(width, len(own))
            for k in range(len(own) - n + 1 if n else 0):
                for i in range(len(words) - n + 1):
                    if words[i : i + n] == own[k : k + n]:
                        hit.update(range(i, i + n))
                        ids.add(item)
        found = decontaminate.Matcher(items, width).scan(words)
        assert {x for a, b in decontaminate.hit_runs(found) for x in range(a, b)} == hit and {x for *_, x in found} == ids


def test_long_sketches_fold():
    rule, rng = ngram_jaccard.Threshold(5, 80, 100), np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:3700], rng.integers(0, 1 << 63, 200, dtype=np.uint64)]))
    long, same, short = (ngram_jaccard.wide_sketches([x], rule)[0] for x in (a, b, a[:40]))
    assert short is None and 0 < ngram_jaccard.flips(long, same) <= len(np.setxor1d(a, b))
    half = ngram_jaccard.parity_bits(b, np.array([len(b)]), len(long) // 2)[0]
    assert ngram_jaccard.flips(long, half) == ngram_jaccard.flips(half, long) <= len(np.setxor1d(a, b))
    assert ngram_jaccard.flips(long, ngram_jaccard.parity_bits(a, np.array([len(a)]), 8)[0]) == 0
