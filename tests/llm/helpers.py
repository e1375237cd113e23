"""Small awkward tables for all operators: nulls, empty and long texts, copies, repeated rows, clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rank int, label string, words string"


def prose(rng: random.Random, n: int) -> str:
    words = ["the", "of", "and", "ha", "stone", "river", "lamp", "über", "niño", "été", "wheel", "in", "to", "paper"]
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def rows(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    texts = [None, "", " \n ", "one", "a b c d", "a b c d", "日本語 テキスト", "x" * 3000, "line\nline\nline\nother\n"]
    long_text = prose(rng, 4000)
    base = prose(rng, 120)
    near = base.split(" ")
    near[50] = "changed"
    texts += [long_text, base, base, " ".join(near), base.replace(" ", "  "), prose(rng, 60) + "\n" + base]
    texts += [prose(rng, rng.randint(1, 90)) for _ in range(25)]
    texts += ['token = "cf1d64a9a4cd9723e1f4eafc27395915e6868ffa" x', "Released under the MIT License.\n" + prose(rng, 12)]
    out = [(i, t, "en", ["b", "a", None][i % 3], len(t or ""), 1, 2, "l", "w") for i, t in enumerate(texts)]
    out += [(None, base, None, "c", None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return out + [out[10], out[10], out[0]]


def documents(spark, parts: int = 4):
    return spark.createDataFrame(rows(), SCHEMA).repartition(parts)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
