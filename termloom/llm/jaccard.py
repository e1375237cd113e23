"""N-gram Jaccard join: MinHash LSH forest over sorted prefix tries, followed by exact verification.

The shingles of a text are its runs of five words (a shorter text has one, all its words). Texts with equal shingle sets
are one *class* from the start, so copies are never compared. Each class has a signature, cut into ``TREES`` labels of
``DEPTH`` MinHash values. The labels of a tree, in sorted order, are its prefix trie: labels with a common prefix are neighbours.

A class looks for partners among those that share its whole label, and the prefix is shortened, a value at a time, until the
chance that some tree shows a partner reaches the target recall. How far that is follows from the class itself: with few shingles
only some similarities above the threshold are possible at all, the least of which may be well above it (a set of four can
have 0.8 or 1, one of three only 1), so its prefix may stay longer. A pair counts as met where it shares the longer of its two prefixes.

A task holds a range of the sorted labels. In each node of the trie it joins neighbours first, from whole labels to shorter prefixes, and then
compares what is not yet connected: pairs whose signatures agree as those of texts at the threshold do (within 4.5 standard
deviations) are connected. So a large group of near copies costs little more than its chain of neighbours. It reports only edges that span what
it connected. Nodes at the ends of a range may go on in the next one; their members meet again in squares of
``NODE_SQUARE`` by ``NODE_SQUARE``, a task's group each.

Connected classes are verified exactly: their shingle sets
meet in squares, where all pairs are counted by products of incidence matrices and never listed. A square reports each
class's number of links and the edges that span its links. What leaves a group is thus linear in its members.

Connected components alternate large-star and small-star steps on edge tables in the shared folder; the rows of a node with
very many edges are spread over ``STAR_SPREAD`` tasks.

Cases: a null or empty text has no shingles, no links, and a class of its own. Repeated rows and copies share a class. Links count
different texts of similarity 0.8 or more (also those with the same shingles), not rows. ``class_id`` is the smallest ``doc_id`` of the class, null if
all its ids are null. Only ``doc_id`` and ``text`` are read. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.anchors import _TABLES, mixed, powers
from termloom.llm.common import column, parts, small_batches, stored, table

N_WORDS = 5
LINK = (4, 9)  # similarity 0.8: shared / (a + b) of at least 4 / 9
THRESHOLD = 0.8
TREES, DEPTH = 20, 8
TARGET_RECALL = 0.9999
NODE_SQUARE = 1024
SET_SQUARE = 256
STAR_SPREAD = 16
LABEL_BYTES = 2 * DEPTH  # 16 bits of each value
MANY = 200  # shingles; from here on the threshold itself is taken as the least similarity
SLICE_BYTES = 1 << 18
_FACTORS = np.random.default_rng(5_802).integers(1, 1 << 63, size=TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
Batches = Iterator[pa.RecordBatch]


def recall(depth: int, trees: int = TREES, similarity: float = THRESHOLD) -> float:
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(similarity: float = THRESHOLD, target: float = TARGET_RECALL) -> int:
    """The longest prefix that reaches the target recall at a similarity."""
    depth = DEPTH
    while depth > 1 and recall(depth, similarity=similarity) < target:
        depth -= 1
    return depth


@cache
def least_similarity(n: int) -> float | None:
    """The least similarity from the threshold up that a set of n shingles can have with another set; None: only an equal one."""
    best = None
    for m in range(1, 2 * n + 2):
        # The fewest shared shingles that reach the threshold with m others.
        shared = -(-LINK[0] * (n + m) // LINK[1])
        if shared <= min(n, m) and (shared < n or m > n):
            similarity = shared / (n + m - shared)
            best = similarity if best is None else min(best, similarity)
    return best


@cache
def own_depth(n: int) -> int | None:
    """How long the prefixes of a set of n shingles may stay; None if it can have no partner."""
    if n >= MANY:
        return prefix_depth()
    least = least_similarity(n)
    return None if least is None else prefix_depth(least)


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    held: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        held.append(text)
        size += len(text) + 1
        if size >= SLICE_BYTES or i == len(texts) - 1:
            yield from _sets_of(held)
            held, size = [], 0


def _sets_of(texts: list[bytes]) -> Iterator[np.ndarray]:
    data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    inside = ~_GAP[data]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLES[0][data] * up[: len(data)], out=total[1:])
    words = mixed((total[stop] - total[begin]) * down[begin] + (stop - begin).astype(np.uint64))
    text_of = np.searchsorted(ends, begin, side="right")
    counts = np.bincount(text_of, minlength=len(texts))
    first = np.cumsum(counts) - counts
    # Windows that begin in a text and end in it; a text of one to four words has one window with all.
    step = np.uint64(0x9FB21C651E98DF25)
    n = len(words)
    grams = np.zeros(n, dtype=np.uint64)
    for k in range(min(N_WORDS, n)):
        grams[: n - k] = grams[: n - k] * step + words[k:] if k else words
    whole = np.arange(n) + N_WORDS <= (first + counts)[text_of] if n else np.zeros(0, dtype=bool)
    values, owner = mixed(grams[whole]), text_of[whole]
    short = np.flatnonzero((counts > 0) & (counts < N_WORDS))
    for t in short:
        h = np.uint64(counts[t])
        with np.errstate(over="ignore"):
            for w in words[first[t] : first[t] + counts[t]]:
                h = h * step + w
        values, owner = np.append(values, mixed(np.array([h]))), np.append(owner, t)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.append(True, (values[1:] != values[:-1]) | (owner[1:] != owner[:-1]))[: len(values)]
    values, owner = values[new], owner[new]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    for a, b in zip(cuts, cuts[1:]):
        yield values[a:b]


def signature(shingles: np.ndarray) -> np.ndarray:
    """``TREES`` x ``DEPTH`` MinHash values of 32 bits."""
    out = np.empty(len(_FACTORS), dtype=np.uint32)
    for k, factor in enumerate(_FACTORS):
        out[k] = ((shingles * factor) >> np.uint64(32)).min()
    return out


def as_batch(names: str, kinds: list, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)], names=names.split()
    )


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and x, a hash of the text, which together name a row's content."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("x"))


def described(docs: DataFrame) -> DataFrame:
    """doc_id, x, set (of the shingles' hash; null without shingles), text (hash), depth and labels (end to end)."""

    def describe(batches: Batches) -> Batches:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
        for batch in parts(batches):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            rows = []
            for doc, x, text, own in zip(
                batch.column("doc_id").to_pylist(), batch.column("x").to_pylist(), texts, shingle_sets(texts)
            ):
                if not len(own):
                    rows.append((doc, x, None, None, None, None))
                    continue
                depth = own_depth(len(own))
                values = signature(own) if depth else np.empty(0, dtype=np.uint32)
                hashes = xxhash.xxh3_128_digest(own.tobytes()), xxhash.xxh3_128_digest(text)
                rows.append((doc, x, *hashes, depth, (values & np.uint32(0xFFFF)).astype(">u2").tobytes()))
            yield as_batch("doc_id x set text depth labels", kinds, rows)

    columns = "doc_id long, x long, set binary, text binary, depth int, labels binary"
    return keyed(docs).mapInArrow(describe, columns)


def squares(size: Column, side: int, of: Column) -> Column:
    """The squares that a member of a group of this size takes part in: (i, j) with i <= j, as structs."""
    n = F.greatest(F.lit(1), F.ceil(size / side)).cast("int")
    own = F.pmod(F.xxhash64(of, size), n.cast("long")).cast("int")
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j"), own.alias("own")),
    )


def grouped(batches: Batches, keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Groups of rows that follow one another with equal keys."""
    last, held = None, []
    for batch in parts(batches):
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != last and held:
                yield last, held
                held = []
            last = key
            held.append(row)
    if held:
        yield last, held


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each of n items to the first of its component."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v in zip(a.tolist(), b.tolist()):
        u, v = find(u), find(v)
        if u != v:
            parent[max(u, v)] = min(u, v)
    return [(i, find(i)) for i in range(n) if find(i) != i]


def sketches_agree() -> float:
    """How many bytes of two sketches agree at least, if the texts reach the threshold."""
    expected = THRESHOLD + (1 - THRESHOLD) / 256
    n = TREES * DEPTH
    return n * (expected - 4.5 * (expected * (1 - expected) / n) ** 0.5)


def node_edges(labels: np.ndarray, depth: np.ndarray, sketches: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect the members of a trie node that are candidates of each other.

    ``labels``: a row of values for each member, in sorted order. Neighbours are joined along ever shorter prefixes;
    then the members outside of the largest group are compared with all others.
    """
    n, least = len(labels), sketches_agree()
    same = np.cumprod(labels[1:] == labels[:-1], axis=1).sum(axis=1)
    a = np.arange(n - 1)
    met = (same >= np.maximum(depth[1:], depth[:-1])) & ((sketches[1:] == sketches[:-1]).sum(axis=1) >= least)
    chain = a[met][np.argsort(-same[met], kind="stable")]
    root = np.arange(n)
    for i, j in spanning(n, chain, chain + 1):
        root[i] = j
    count = np.bincount(root, minlength=n)
    for i in np.flatnonzero(root != count.argmax()):
        others = np.flatnonzero(root != root[i])
        if not len(others):
            break
        others = others[(sketches[others] == sketches[i]).sum(axis=1) >= least]
        shared = np.cumprod(labels[others] == labels[i], axis=1).sum(axis=1)
        others = others[shared >= np.maximum(depth[others], depth[i])]
        for old in np.unique(root[others]):
            root[root == old] = root[i]
    first: dict[int, int] = {}
    return [(i, first[r]) for i, r in enumerate(root.tolist()) if first.setdefault(r, i) != i]


def candidate_edges(classes: DataFrame) -> DataFrame:
    """a, b: edges that connect the classes which share a prefix as long as both need, and have like sketches."""
    shortest = prefix_depth()
    label = lambda tree, length: F.substring(F.col("labels"), tree * LABEL_BYTES + 1, F.lit(length))
    trees = F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)),
        lambda t: F.struct(t.alias("tree"), F.xxhash64(t, label(t, LABEL_BYTES // DEPTH * shortest)).alias("node")),
    )
    places = classes.filter("depth IS NOT NULL").select("set", F.inline(trees))
    nodes = places.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1").select("node")
    # Merge joins at every size: the plan does not change with the number of classes.
    shared = (
        places.join(nodes.hint("merge"), "node")
        .join(classes.select("set", "depth", "labels").hint("merge"), "set")
        .select("node", "tree", "set", "depth", "labels", label(F.col("tree"), LABEL_BYTES).alias("label"))
    )
    order = ["tree", "label", "set"]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    columns = "node long, depth int, label binary, labels binary, a binary, b binary"

    def matrices(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        values = np.frombuffer(b"".join(r["label"] for r in rows), dtype=">u2").reshape(len(rows), -1)
        whole = np.frombuffer(b"".join(r["labels"] for r in rows), dtype=np.uint8).reshape(len(rows), -1)
        return values, np.array([r["depth"] for r in rows]), whole[:, 1::2]  # the low byte of each value is the sketch

    def edges(rows: list[dict]) -> list[tuple[bytes, bytes]]:
        return [(rows[i]["set"], rows[j]["set"]) for i, j in node_edges(*matrices(rows))] if len(rows) > 1 else []

    def in_range(batches: Batches) -> Batches:
        """Edges of the nodes inside of a range of sorted labels; the members of its first and last node, with their set as ``a``."""
        out: list[tuple] = []
        names = "node depth label labels a b"
        first, held = True, None
        for (node,), rows in grouped(batches, ["node"]):
            if first:
                out += [(node, r["depth"], r["label"], r["labels"], r["set"], None) for r in rows]
                first = False
                continue
            if held:
                out += [(None, None, None, None, *edge) for edge in edges(held)]
            held = rows
            if len(out) >= 20_000:
                yield as_batch(names, kinds, out)
                out = []
        if held:
            out += [(held[0]["node"], r["depth"], r["label"], r["labels"], r["set"], None) for r in held]
        yield as_batch(names, kinds, out)

    sorted_labels = shared.repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(sorted_labels.mapInArrow(in_range, columns), "jaccard-forest")

    ends = found.filter("node IS NOT NULL").select("node", "depth", "label", "labels", F.col("a").alias("set"))
    sizes = ends.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
    dealt = ends.join(sizes.hint("merge"), "node").select(
        "node", "depth", "label", "labels", "set", F.inline(squares(F.col("size"), NODE_SQUARE, F.col("set")))
    )
    dealt = dealt.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j", "label", "set")

    def in_square(batches: Batches) -> Batches:
        out: list[tuple] = []
        for _, rows in grouped(batches, ["node", "i", "j"]):
            out += edges(rows)
            if len(out) >= 20_000:
                yield as_batch("a b", [pa.binary(), pa.binary()], out)
                out = []
        yield as_batch("a b", [pa.binary(), pa.binary()], out)

    inside = found.filter("node IS NULL").select("a", "b")
    return inside.unionByName(dealt.mapInArrow(in_square, "a binary, b binary")).distinct()


def components(edges: DataFrame, purpose: str) -> DataFrame:
    """node, root: the smallest node of the component, for all nodes but the roots themselves."""
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), purpose)
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if before == state or not state["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        spread = F.explode(F.sequence(F.lit(0), F.lit(STAR_SPREAD - 1)))
        arms = both.filter("v > u").withColumn("arm", F.pmod(F.xxhash64("v"), F.lit(STAR_SPREAD)).cast("int"))
        large = arms.join(least.withColumn("arm", spread), ["u", "arm"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u")
        hung = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        now = stored(hung.unionByName(root.select("u", F.col("m").alias("v"))).distinct(), purpose)


def verified(docs: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """set, other, links: each square's number of linked texts of a class, and the edges that span its links.

    ``members``: set, ``group``, size (of the group), texts (of the class), doc_id and x of a row that has the text.
    """
    wanted = members.select(F.col("doc_id").alias("d"), F.col("x").alias("x2"), "set", group, "size", "texts")
    # A merge join at every size: the plan does not change with the number of members.
    found = keyed(docs).join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("x") == F.col("x2")))

    def sets(batches: Batches) -> Batches:
        done: set[bytes] = set()
        for batch in parts(batches):
            rows = [row for row in batch.to_pylist() if row["set"] not in done and not done.add(row["set"])]
            texts = [row["text"].encode("utf-8", "surrogatepass") for row in rows]
            made = [(row["set"], own.tobytes()) for row, own in zip(rows, shingle_sets(texts))]
            yield as_batch("set shingles", [pa.binary(), pa.binary()], made)

    # Repeated rows give a set once from each task that has some.
    shingles = found.select("set", "text").mapInArrow(sets, "set binary, shingles binary")
    once = stored(shingles.groupBy("set").agg(F.first("shingles").alias("shingles")), "jaccard-sets")
    dealt = (
        members.select("set", group, "texts", F.explode(squares(F.col("size"), SET_SQUARE, F.col("set"))).alias("q"))
        .join(once, "set")
        .select("set", group, "texts", "shingles", F.col("q.i").alias("i"), F.col("q.j").alias("j"), F.col("q.own").alias("own"))
        .repartition(group, "i", "j")
        .sortWithinPartitions(group, "i", "j")
    )

    def count(batches: Batches) -> Batches:
        out = []
        kinds = [pa.binary(), pa.binary(), pa.int64()]
        for (_, i, j), rows in grouped(batches, [group, "i", "j"]):
            linked = links([np.frombuffer(r["shingles"], dtype="<u8") for r in rows])
            side = np.array([r["own"] for r in rows])
            if i != j:
                linked &= side[:, None] != side[None, :]
            numbers = linked @ np.array([r["texts"] for r in rows], dtype=np.int64)
            a, b = np.nonzero(np.triu(linked))
            root = dict(spanning(len(rows), a, b))
            for k, row in enumerate(rows):
                if numbers[k]:
                    out.append((row["set"], rows[root.get(k, k)]["set"], int(numbers[k])))
            if len(out) >= 20_000:
                yield as_batch("set other links", kinds, out)
                out = []
        yield as_batch("set other links", kinds, out)

    return dealt.mapInArrow(count, "set binary, other binary, links long")


def links(sets: list[np.ndarray]) -> np.ndarray:
    """Which pairs of shingle sets reach the threshold (not a set with itself)."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.append(True, values[1:] != values[:-1])
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1  # only shingles of several sets count
    kept = often[column]
    owner, column = owner[kept], (np.cumsum(often) - 1)[column[kept]]
    shared = np.zeros((n, n))
    width = 8192
    for low in range(0, int(often.sum()), width):
        some = slice(*np.searchsorted(column, [low, low + width]))
        incidence = np.zeros((n, width), dtype=np.float32)
        incidence[owner[some], column[some] - low] = 1
        shared += incidence @ incidence.T
    np.fill_diagonal(shared, 0)
    return shared * LINK[1] >= LINK[0] * (sizes[:, None] + sizes[None, :])


def joined(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows (doc_id, x, set), and of each set its class: set, class_id, n_links, first (the least doc_id and x of the class)."""
    rows = stored(described(docs), "jaccard-rows")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "x")
    classes = stored(
        rows.filter("set IS NOT NULL")
        .groupBy("set", "text")
        .agg(F.min(place).alias("place"), *[F.first(c).alias(c) for c in ("depth", "labels")])
        .groupBy("set")
        .agg(
            F.count("*").alias("texts"),
            F.min("place").alias("place"),
            *[F.first(c).alias(c) for c in ("depth", "labels")],
        ),
        "jaccard-classes",
    )
    near = components(candidate_edges(classes), "jaccard-near")
    roots = near.unionByName(near.select(F.col("root").alias("node"), "root").distinct())
    sizes = roots.groupBy("root").agg(F.count("*").alias("size"))
    members = (
        roots.join(sizes, "root")
        .join(classes.select(F.col("set").alias("node"), "texts", "place"), "node")
        .select(F.col("node").alias("set"), "root", "size", "texts", F.col("place.doc_id").alias("doc_id"), F.col("place.x").alias("x"))
    )
    checked = stored(verified(docs, stored(members, "jaccard-members"), "root"), "jaccard-links")
    counts = checked.groupBy("set").agg(F.sum("links").alias("links"))
    final = components(checked.select(F.col("set").alias("a"), F.col("other").alias("b")), "jaccard-final")
    named = (
        classes.select("set", "texts", "place")
        .join(final.withColumnRenamed("node", "set"), "set", "left")
        .join(counts, "set", "left")
        .select(
            "set",
            F.coalesce("root", "set").alias("root"),
            "place",
            (F.col("texts") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        )
    )
    leaders = named.groupBy("root").agg(F.min("place").alias("first"))
    by_set = named.join(leaders, "root").select("set", "first", F.col("first.doc_id").alias("class_id"), "n_links")
    return rows.select("doc_id", "x", "set"), stored(by_set, "jaccard-by-set")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links of every row."""
    rows, by_set = joined(docs)
    with_class = rows.filter("set IS NOT NULL").join(by_set, "set").select("doc_id", "class_id", "n_links")
    alone = rows.filter("set IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return with_class.unionByName(alone)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows without near duplicates: of each class the one with the least doc_id; every row without words stays once."""
    rows, by_set = joined(docs)
    firsts = by_set.select(F.col("first.doc_id").alias("d"), F.col("first.x").alias("x2")).distinct()
    bare = rows.filter("set IS NULL").select(F.col("doc_id").alias("d"), F.col("x").alias("x2")).distinct()
    keep = firsts.unionByName(bare).distinct()
    packed = docs.select(
        F.col("doc_id").cast("long").alias("d"),
        F.xxhash64("text").alias("x2"),
        F.struct(*[column(c) for c in docs.columns]).alias("row"),
    )
    # Rows with equal id and text are one document; the first aggregation happens before anything moves.
    once = packed.groupBy("d", "x2").agg(F.first("row").alias("row"))
    kept = once.join(
        keep.withColumnsRenamed({"d": "e", "x2": "y"}), F.col("d").eqNullSafe(F.col("e")) & (F.col("x2") == F.col("y")), "left_semi"
    )
    return kept.select("row.*")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))
