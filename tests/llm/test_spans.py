"""Decontamination, phrases and periodic runs against brute force, on awkward rows."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import helpers
import pyarrow as pa
import pytest

from termloom.llm import periods, phrases, winnowing
from termloom.llm.wordcut import BLANKS, flat, sliced, words_in

ITEMS = "item_id long, text string, row string, hits string, t string"


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def plain_hits(docs, items):
    windows = {}
    for item, text in items:
        ws = bench_words(text)
        t = min(10, len(ws))
        for i in range(len(ws) - t + 1 if t else 0):
            windows.setdefault(tuple(ws[i : i + t]), set()).add(item)
    out = []
    for doc, text in docs:
        ws = bench_words(text)
        hit, found = set(), set()
        for t in {len(w) for w in windows}:
            for i in range(len(ws) - t + 1):
                if (w := tuple(ws[i : i + t])) in windows:
                    hit |= set(range(i, i + t))
                    found |= windows[w]
        found = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(ws), len(hit), len(found), tuple(found)))
    return Counter(out)


def hits_of(frame):
    return Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"])) for r in frame.collect())


@pytest.fixture(scope="module")
def leaking():
    rng = random.Random(5)
    some = [helpers.prose(rng, rng.randint(11, 40)) for _ in range(12)]
    items = [(i, t) for i, t in enumerate(some)]
    items += [(0, some[0]), (99, some[0]), (None, some[1]), (50, None), (51, " .,"), (52, "Zebra"), (53, "four words of ÉTÉ"), (10, "a a a a a a a a a a a a")]
    texts = [None, "", "zebra zebra", "ZEBRA", "four WORDS of été", "four words of ÉTÉ four words of ÉTÉ", "a " * 30, "a " * 9]
    for i in range(60):
        ws = helpers.prose(rng, rng.randint(0, 60)).split()
        other = rng.choice(some).split()
        a = rng.randint(0, len(other) - 1)
        part = other[a : a + rng.randint(6, 14)]
        at = rng.randint(0, len(ws))
        texts.append(" ".join(ws[:at] + part + ws[at:]).upper() if i % 3 else "\n".join(ws[:at] + part + ws[at:] + part))
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, some[2]), (7, some[2]), (7, some[2])]
    return docs, items


def test_decontamination_equals_brute_force(spark, leaking):
    docs, items = leaking
    rows = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, fp long, items string").repartition(3)
    bench = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in items], ITEMS)
    assert hits_of(winnowing.contaminated(rows, bench)) == plain_hits(docs, items)


@pytest.mark.parametrize("setting, value", [("MOST_BITS", 64), ("BROADCAST_BYTES", -1)])
def test_decontamination_bounds_change_nothing(spark, leaking, monkeypatch, setting, value):
    docs, items = leaking
    monkeypatch.setattr(winnowing, setting, value)
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    made = winnowing.contaminated(rows, bench)
    assert hits_of(made) == plain_hits(docs, items)


def test_decontamination_of_empty_tables(spark, leaking):
    docs, items = leaking
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert winnowing.contaminated(rows.limit(0), bench).collect() == []
    assert {r.n_hit for r in winnowing.contaminated(rows, bench.limit(0)).collect()} == {0}


def test_decontamination_of_a_long_dense_text(spark, leaking):
    _, items = leaking
    text = " ".join([items[3][1], "other words here"] * 14000)
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    begun = time.time()
    assert hits_of(winnowing.contaminated(rows, bench)) == plain_hits([(1, text)], items)
    assert len(text) > 800_000 and time.time() - begun < 60


def test_decontamination_runs_no_python(spark, leaking):
    docs, items = leaking
    made = winnowing.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    plan = made._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def plain_phrases(rows, least=10, percent=50, top=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(ws)
            for k in (1, 2, 3):
                for i in range(len(ws) - k + 1):
                    counts[lang, tuple(ws[i : i + k])] += 1
    out = []
    cands = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    for (lang, p), a in cands.items():
        if any(
            lg == lang and len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q)))
            for (lg, q), b in cands.items()
        ):
            continue
        score, k = min((10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    ranked, rank = [], Counter()
    for lang, score, a, p, l, r in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            ranked.append((lang, rank[lang], p.decode(), -a, l, r, totals[lang], -score))
    return Counter(ranked)


def phrase_rows():
    rng = random.Random(9)
    rows = []
    for i in range(250):
        lang = [None, "en", "de", "und", "é"][i % 5]
        words = [rng.choice(["Alpha", "beta", "\x0bgamma", "délta", "x", "y"]) for _ in range(rng.randint(0, 40))]
        rows.append((lang, "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n"]) for w in words)))
    return rows + [("en", None), ("en", ""), (None, " , "), ("en", "the the " * 3000), ("en", "the the " * 3000)]


def phrases_of(frame):
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return Counter(tuple(r[n] for n in names) for r in frame.collect())


@pytest.mark.parametrize("block, bucket, entries", [(6 << 20, 4 << 20, 1_000_000), (2_000, 1_000, 50)])
def test_phrases_equal_brute_force(spark, monkeypatch, block, bucket, entries):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", block)
    monkeypatch.setattr(phrases, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(phrases, "MERGE_ENTRIES", entries)
    rows = phrase_rows()
    docs = spark.createDataFrame([(a, b, 1, "q") for a, b in rows], "lang string, text string, n long, word string").repartition(5)
    assert phrases_of(phrases.top_phrases(*phrases.collocations(docs))) == plain_phrases(rows)
    assert phrases_of(phrases.top_phrases(*phrases.collocations(docs), 3)) == plain_phrases(rows, top=3)


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 40)
    texts = ["é b, c d. " * 20, "no mark " * 30, "short", None, "a,b" + " c" * 50 + ",d" + " e" * 30]
    batch = pa.RecordBatch.from_arrays([pa.array(["x"] * 5), pa.array(texts)], names=["lang", "text"])
    made = [t for b in phrases.cut_at_marks([batch]) for t in b.column("text").to_pylist()]
    pieces = lambda ts: Counter(p for t in ts for p in re.split(r"[.,;:!?\x0A-\x0D]", t or "") if p.strip())
    assert pieces(made) == pieces(texts) and len(made) > 8
    assert all(len(t.encode()) <= 41 for t in made if "," in t[:-1] or "." in t[:-1])


def test_phrases_of_an_empty_table(spark):
    assert phrases.top_phrases(*phrases.collocations(helpers.none(spark))).collect() == []


def test_scores_pass_64_bits(spark):
    got = spark.sql(
        "select (1000000 * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div "
        "(cast(l as decimal(15,0)) * cast(r as decimal(15,0))) s from values (99999999999999L, 100000000000003L, 100000000000007L) t(a, l, r)"
    ).first().s
    assert got == 10**6 * 99999999999999**2 // (100000000000003 * 100000000000007)


def plain_runs(ws):
    out = []
    for q in range(1, len(ws) // 4 + 1):
        i = 0
        while i + q < len(ws):
            j = i
            while j + q < len(ws) and ws[j] == ws[j + q]:
                j += 1
            n = j - i + q
            smaller = any(all(ws[t] == ws[t + p] for t in range(i, i + n - p)) for p in range(1, q))
            if j > i and n >= max(6, 4 * q) and not smaller:
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc, text, order_of=None):
    ws = (text or "").encode().split()
    order = order_of(doc, len(ws)) if order_of and ws else None
    ws = ws if order is None else [ws[i] for i in order]
    runs = plain_runs(ws)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()
    kept = b" ".join(w for i, w in enumerate(ws) if i not in gone)
    digests = hashlib.sha256(lines).hexdigest(), hashlib.sha256(kept).hexdigest()
    return (doc, len(runs), s, n, q, runs and 1000 * n // q or None, *digests, len(ws))


def periodic_rows():
    rng = random.Random(11)
    texts = [None, "", " \n", "a", "a " * 5, "a " * 6, "é\tb\x0bé b é b é b é  b"]
    for _ in range(300):
        words = []
        while len(words) < rng.randint(0, 70):
            words += [rng.choice(rng.choice(["ab", "abcdef"])) for _ in range(rng.randint(1, 9))] * rng.choice([1, 1, 2, 4, 5, 7])
        texts.append(" ".join(words))
    return [(i, t) for i, t in enumerate(texts)] + [(None, "b " * 9), (3, "b " * 9), (3, "b " * 9)]


def runs_rows(frame):
    return Counter(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("order_of", [None, periods.looped])
@pytest.mark.parametrize("size, at_once", [(2 << 20, 1 << 18), (300, 7)])
def test_runs_equal_brute_force(spark, monkeypatch, order_of, size, at_once):
    monkeypatch.setattr(periods, "BATCH_BYTES", size)
    monkeypatch.setattr(periods, "WORDS_AT_ONCE", at_once)
    rows = periodic_rows()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, start long, n_runs long").repartition(3)
    assert runs_rows(periods.periodic_runs(docs, order_of)) == Counter(plain_row(*r, order_of) for r in rows)


def test_looped_words_follow_the_rule():
    doc = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 10 == 0)
    g = zlib.crc32(str(doc).encode()) // 10
    n = 37
    a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
    assert list(periods.looped(doc, n)) == [a + (i - a) % p if i >= a else i for i in range(n)]


def test_runs_of_long_texts_take_seconds():
    for text, run in [("a b c " * 200_000, (0, 600_000, 3)), (" ".join(str(i % 5000) for i in range(400_000)), (0, 400_000, 5000))]:
        begun = time.time()
        made = periods.described(pa.array([text]), [1])
        assert (made["start"][0], made["length"][0], made["period"][0]) == run and time.time() - begun < 30


def test_runs_of_an_empty_table(spark):
    assert periods.periodic_runs(helpers.none(spark)).collect() == []


def test_words_end_with_their_text():
    texts = pa.array(["ab", None, "", "cd ", " e", "f"])
    data, offsets = flat(texts.slice(1))
    words = words_in(data, offsets, BLANKS)
    assert [bytes(words.data[a:b]) for a, b in zip(words.starts, words.ends)] == [b"cd", b"e", b"f"]
    assert words.text.tolist() == [2, 3, 4]
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    assert [b.num_rows for b in sliced([batch], 3)] == [4, 2]
