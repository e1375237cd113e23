"""Operators over the whole corpus, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import documents, none, prose, rows
from pyspark.sql import functions as F

from termloom.llm import anchors, jaccard, merging, mixing, repeats, sharding, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bag(rows_, *columns):
    return Counter(tuple(r[c] for c in columns) for r in rows_)


# --- mixing --------------------------------------------------------------------


def plain_targets(sizes: dict, weights=(3, 1, 2), share=1.5, cap=2):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: cap * sizes[s] for s in over}
        left -= sum(cap * sizes[s] for s in over)
        open_ -= over
    return target


def test_mixture(spark):
    got = mixing.mixed(documents(spark)).collect()
    size = lambda r: len(WORD.findall(r[1] or ""))
    assert bag(got, "doc_id", "source", "size") == Counter((r[0], r[3], size(r)) for r in rows())
    sizes = defaultdict(int)
    for r in rows():
        sizes[r[3]] += size(r)
    targets, taken = plain_targets(sizes), defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(targets[r.source]) and r.source_size == sizes[r.source]
        assert r.taken == r["copies"] * r["size"] and r.copies in (0, 1, 2)
        taken[r.source] += r.taken
    largest = max(r["size"] for r in got)
    assert all(abs(taken[s] - targets[s]) <= largest for s in sizes)
    again = mixing.mixed(documents(spark, 7)).collect()
    assert bag(got, "doc_id", "source", "taken") == bag(again, "doc_id", "source", "taken")
    assert mixing.mixed(none(spark)).count() == 0


def test_mixture_of_equal_rows_and_row_copies(spark):
    docs = spark.range(3000).selectExpr(
        "if(id < 2000, 7, id) as doc_id", "if(id < 2000, 'same text here', concat('text ', id)) as text",
        "if(id < 2500, 'a', 'b') as source", "id as size", "'x' as row", "'y' as u",
    )
    rows_ = mixing.mixed(docs).collect()
    for source in ("a", "b"):
        own = [r for r in rows_ if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 3
    mixture = mixing.mixture(docs)
    assert mixture.columns == docs.columns
    assert mixture.count() == sum(r.copies for r in rows_)


def test_pareto_order_follows_probabilities(spark):
    """Documents with twice the preference come about twice as often."""
    docs = spark.range(4000).selectExpr(
        "id as doc_id", "repeat('w ', cast(if(id % 2 = 0, 100, 99) as int)) as text", "if(id < 3000, 'big', 'small') as source"
    )
    own = [r for r in mixing.mixed(docs).collect() if r.source == "small" or r.source == "big"]
    for source in ("big", "small"):
        even = [r.copies for r in own if r.source == source and r["size"] == 100]
        odd = [r.copies for r in own if r.source == source and r["size"] == 99]
        assert np.mean(even) > np.mean(odd)


# --- top-k ---------------------------------------------------------------------


def plain_top(vectors, k):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in vectors
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in {(i, tuple(v)) for i, v in ok if i % 50 == 0}:
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v)))
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


def test_top_k_with_ties_and_bad_vectors(spark):
    rng = random.Random(6)
    vectors = [(i, [rng.choice([-1.0, 0.0, 0.25, 0.5]) for _ in range(4)]) for i in range(400)]
    vectors += [(None, [1.0] * 4), (401, None), (402, [1.0, None, 1.0, 1.0]), (403, [float("nan")] * 4), (404, [float("inf")] * 4)]
    vectors += [(450, [1.0, 1.0]), (451, [0.5, 1.0]), (500, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, score int").repartition(5)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0).collect()
    assert {tuple(r) for r in got} == plain_top(vectors, topk.K) and len(got) == len(plain_top(vectors, topk.K))
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_over_several_blocks_and_large_values(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 3)
    rng = random.Random(8)
    vectors = [(i, [rng.uniform(-3e4, 3e4) for _ in range(3)]) for i in range(0, 600, 2)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()} == plain_top(vectors, topk.K)


# --- near duplicates --------------------------------------------------------------


def shingles(text):
    words = WORD.findall(text or "")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_links(given):
    """Text -> number of links, and a class number, over different texts."""
    texts = [t for t in dict.fromkeys(given) if shingles(t)]
    sets = [shingles(t) for t in texts]
    links, root = [0] * len(texts), list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if 9 * shared >= 4 * (len(sets[a]) + len(sets[b])):
                links[a] += 1
                links[b] += 1
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    return {t: (links[i], root[i]) for i, t in enumerate(texts)}


def check_near(docs, given):
    plain = plain_links([t for _, t in given])
    least = {}
    for doc, text in given:
        if shingles(text) and doc is not None:
            root = plain[text][1]
            least[root] = min(doc, least.get(root, doc))
    expected = Counter(
        (doc, least.get(plain[text][1]), plain[text][0]) if shingles(text) else (doc, doc, 0) for doc, text in given
    )
    assert bag(jaccard.near_duplicates(docs).collect(), "doc_id", "class_id", "n_links") == expected


def test_near_duplicates_with_awkward_rows(spark):
    check_near(documents(spark), [(r[0], r[1]) for r in rows()])
    assert jaccard.near_duplicates(none(spark)).count() == 0


def test_shingles_of_few_words_in_a_slice(spark):
    words = "one two three four five".split()
    few = [" ".join(words[:n]).encode() for n in range(6)]
    sizes = [0, 1, 1, 1, 1, 1]
    assert [len(own) for text in few for own in jaccard.shingle_sets([text])] == sizes
    together = list(jaccard.shingle_sets(few))
    for text, size, own in zip(few, sizes, together):
        long_text = (b"word " * jaccard.SLICE_BYTES)[: jaccard.SLICE_BYTES]
        assert [len(x) for x in jaccard.shingle_sets([long_text, text])][1:] == [size]
        assert np.array_equal(next(jaccard.shingle_sets([text])), own)
    docs = spark.createDataFrame([(1, "two words"), (2, "two  words"), (3, "now three words")], "doc_id long, text string").coalesce(1)
    got = bag(jaccard.near_duplicates(docs).collect(), "doc_id", "class_id", "n_links")
    assert got == Counter({(1, 1, 1): 1, (2, 1, 1): 1, (3, 3, 0): 1})
    alone = spark.createDataFrame([(1, "two words")], "doc_id long, text string")
    assert bag(jaccard.near_duplicates(alone).collect(), "doc_id", "class_id", "n_links") == Counter({(1, 1, 0): 1})


def test_near_duplicates_in_a_large_group(spark, monkeypatch):
    """Squares smaller than the group: every link is still counted once."""
    monkeypatch.setattr(jaccard, "NODE_SQUARE", 4)
    monkeypatch.setattr(jaccard, "SET_SQUARE", 3)
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    given = []
    for i in range(40):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(150)] = f"z{rng.randrange(10**6)}"
        given.append((i, " ".join(words)))
    given += [(100 + i, prose(rng, 80)) for i in range(20)] + [(5, given[5][1])]
    check_near(spark.createDataFrame(given, "doc_id long, text string").repartition(5), given)


def test_one_of_each_class_stays(spark):
    docs = documents(spark)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    classes = {r.class_id for r in jaccard.near_duplicates(docs).collect()} - {None}
    ids = [r.doc_id for r in kept.collect() if shingles(r.text)]
    bare = {r[0] for r in rows() if not shingles(r[1])}
    assert len(ids) == len(set(ids)) and set(ids) == classes - bare
    assert Counter(r.doc_id for r in kept.collect() if not shingles(r.text)) == Counter(bare)
    assert jaccard.one_of_each(none(spark)).count() == 0


def test_own_depth_follows_from_the_possible_similarities():
    from fractions import Fraction

    for n in range(1, 40):
        possible = [Fraction(k, n + m - k) for m in range(1, 2 * n + 2) for k in range(1, min(n, m) + 1) if not k == n == m]
        least = min((s for s in possible if s >= Fraction(4, 5)), default=None)
        found = jaccard.least_similarity(n)
        assert (found is None) == (least is None) and (least is None or abs(found - float(least)) < 1e-12)
        depth = jaccard.own_depth(n)
        if least is not None:
            assert jaccard.recall(depth, similarity=found) >= jaccard.TARGET_RECALL or depth == 1
            assert depth == jaccard.DEPTH or jaccard.recall(depth + 1, similarity=found) < jaccard.TARGET_RECALL
    assert jaccard.own_depth(3) is None and jaccard.own_depth(10_000) == jaccard.prefix_depth()


def test_node_edges_connect_all_candidates():
    rng = np.random.default_rng(3)
    for trial in range(40):
        n = int(rng.integers(2, 60))
        groups = rng.integers(0, max(1, n // 3), n)
        bases = rng.integers(0, 256, (n, jaccard.TREES * jaccard.DEPTH), dtype=np.uint8)
        sketches = bases[groups]
        noise = rng.random(sketches.shape) < rng.choice([0.0, 0.1, 0.25, 0.6], n)[:, None]
        sketches = np.where(noise, rng.integers(0, 256, sketches.shape, dtype=np.uint8), sketches)
        labels = np.concatenate([np.ones((n, 4), dtype=np.uint32), rng.integers(0, 2, (n, 4), dtype=np.uint32)], axis=1)
        labels = labels[np.lexsort(labels.T[::-1])]
        depth = rng.choice([4, 4, 5, 7], n)
        pairs = []
        for i in range(n):
            for j in range(i + 1, n):
                shared = next((k for k in range(8) if labels[i, k] != labels[j, k]), 8)
                if shared >= max(depth[i], depth[j]) and (sketches[i] == sketches[j]).sum() >= jaccard.sketches_agree():
                    pairs.append((i, j))
        expected = dict(jaccard.spanning(n, np.array([a for a, _ in pairs], dtype=int), np.array([b for _, b in pairs], dtype=int)))
        made = jaccard.node_edges(labels, depth, sketches)
        found = dict(jaccard.spanning(n, np.array([a for a, _ in made], dtype=int), np.array([b for _, b in made], dtype=int)))
        assert found == expected and len(made) == len(expected)


def test_nodes_cut_by_ranges_stay_whole(spark, monkeypatch):
    """A group of near copies that fills many ranges of the sorted labels and many squares."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        own = list(words)
        own[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(jaccard, "NODE_SQUARE", 64)
    monkeypatch.setattr(jaccard, "SET_SQUARE", 64)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert {r.class_id for r in made} == {0} and {r.n_links for r in made} == {399}


def test_prefix_is_shortened_until_the_recall_is_reached():
    depth = jaccard.prefix_depth()
    assert jaccard.recall(depth) >= jaccard.TARGET_RECALL > jaccard.recall(depth + 1)


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).selectExpr("lpad(id, 4, '0') as a", "lpad(id + 1, 4, '0') as b").unionByName(
        spark.createDataFrame([("9001", "9002"), ("9003", "9003")], "a string, b string")
    )
    got = {r.node: r.root for r in jaccard.components(edges, "chain").collect()}
    assert got == {f"{i:04d}": "0000" for i in range(1, 61)} | {"9002": "9001"}


# --- repeated passages ---------------------------------------------------------------


def plain_removal(texts):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def removal(docs):
    def finish(text, runs):
        return len(text), sum(b - a for a, b in runs), len(runs), hashlib.sha256(repeats.kept_bytes(text, runs)).hexdigest()

    got = repeats.applied(docs, finish, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return bag(got.collect(), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_repeats_with_awkward_rows(spark):
    given = rows()
    expected = Counter((r[0], *e) for r, e in zip(given, plain_removal([r[1] for r in given])))
    assert removal(documents(spark)) == expected
    assert repeats.without_repeats(none(spark)).count() == 0


@pytest.mark.parametrize("block", [1 << 22, 700])
def test_repeats_of_shared_passages(spark, monkeypatch, block):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)
    rng = random.Random(12)
    letters = "abcdefghij éß"
    text = lambda n: "".join(rng.choices(letters, k=n))
    passages = [text(n) for n in (150, 190, 210, 260, 400, 900)]
    given = []
    for i in range(60):
        parts = [text(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(passages)
            cut = rng.randint(0, 60)
            parts += [passage[cut : len(passage) - rng.randint(0, 60)], text(rng.randint(0, 200))]
        given.append((i, "".join(parts)))
    given += [(100, "ab" * 300), (101, "x" * 199), (102, "y" * 200), (103, "z" * 201), (104, text(3000) * 2)]
    expected = Counter((d, *e) for (d, _), e in zip(given, plain_removal([t for _, t in given])))
    assert removal(spark.createDataFrame(given, "doc_id long, text string").repartition(6)) == expected


def test_stretches_hold_every_string_once(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 101, n, dtype=np.uint8) for n in (0, 199, 200, 201, 5000, 1234)]
    data, ends = np.concatenate(texts), np.cumsum([len(t) for t in texts])
    for most in (1 << 22, 1500):
        monkeypatch.setattr(repeats, "MOST_BYTES", most)
        first, count, *_ = repeats.all_stretches(data, ends)
        starts = np.concatenate([np.arange(f, f + c) for f, c in zip(first, count)])
        expected = np.concatenate([np.arange(e - len(t), max(e - len(t), e - anchors.LENGTH + 1)) for t, e in zip(texts, ends)])
        assert sorted(starts.tolist()) == expected.tolist()


def test_merge_of_front_coded_runs():
    rng = random.Random(5)
    for _ in range(60):
        runs = [sorted({bytes(rng.choices(b"ab", k=rng.randint(0, 8))) for _ in range(rng.randint(0, 20))}) for _ in range(rng.randint(1, 9))]
        got = list(merging.merged([merging.front_coded(r, [False] * len(r)) for r in runs]))
        expected = sorted(x for r in runs for x in r)
        assert [g[0] for g in got] == expected
        assert [g[1] for g in got] == [merging.shared(a, b) for a, b in zip([b"", *expected], expected)]


# --- shards ------------------------------------------------------------------------


def check_shards(docs, given, apart=0):
    got = sharding.sharded(docs).collect()
    raw = [(t or "").encode() for _, t in given]
    assert bag(got, "doc_id", "size", "text_crc32") == Counter((d, len(b) + 1, zlib.crc32(b)) for (d, _), b in zip(given, raw))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(own) == list(range(len(own))) for own in slots.values()) and set(slots) <= set(range(8))
    where = defaultdict(set)
    for r in got:
        where[r.group].add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) == apart
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    return sizes


def test_shards_of_awkward_rows(spark):
    check_shards(documents(spark), [(r[0], r[1]) for r in rows()])
    assert sharding.sharded(none(spark)).count() == 0


def test_shards_with_a_third_in_one_group(spark):
    given = [(None if i < 500 else i, "same text here " * 10 if i < 1000 else f"text {i} " * 10) for i in range(3000)]
    sizes = check_shards(spark.createDataFrame(given, "doc_id long, text string").repartition(5), given, apart=1)
    assert max(sizes.values()) < 1.1 * min(sizes.values())
