"""Byte-level BPE as a recursive query over token-position rows.

Each partition splits its texts into pieces and encodes the different pieces once, in an in-process
DuckDB. A piece is a row for each token position. A step of the recursion joins neighbouring
tokens with the merge table (every split of a vocabulary entry into two entries, ranked by the entry),
finds the lowest rank of each piece, and contracts its leftmost pair. The fixpoint is reached when no pair of
a piece is in the merge table. Ordered aggregation puts ids together, and their bytes again for decoding.

Pieces of more than ``SHORT_BYTES`` would take as many steps as they have tokens. For them a step contracts
all pairs of the lowest rank, from the left and without overlap, if none of the pairs that this opens has so low a
rank: then one at a time would come to the same. Otherwise it contracts the leftmost. Their recursion runs
at most ``LEVELS`` deep and starts again from its last rows, which bounds its memory to ``LEVELS`` times the rows.

Cases: a null text is an empty text with no ids. Special tokens are ordinary text. Only ``doc_id`` and ``text``
are read; repeated rows give equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from termloom.llm.common import per_text, table
from termloom.llm.vocabulary import Remembered, pieces, read_ranks, slices

LEVELS = 24
CHUNK_BYTES = 1_000_000
SHORT_BYTES = 64
SLICE_CHARS = 6_000_000

# One pair a step: for the many short pieces. A piece's tokens are a list that the step takes apart into
# position rows and, after the join with the merge table, puts together again around the contracted pair.
SHORT = """
WITH RECURSIVE step(level, w, ts) AS (
    SELECT 0, w, ts FROM start
  UNION ALL
    SELECT s.level + 1, s.w, list_concat(s.ts[:(best.low % 65536) - 1], [(best.low // 65536)::INT], s.ts[(best.low % 65536) + 2:])
    FROM step s JOIN (
      SELECT w, min(m.rank::BIGINT * 65536 + p.place) AS low
      FROM (SELECT w, unnest(ts[:-2]) AS a, unnest(ts[2:]) AS b, generate_subscripts(ts[2:], 1) AS place FROM step) p
      JOIN merges m ON m.pair = p.a::BIGINT * 65536 + p.b
      GROUP BY w) best ON best.w = s.w
)
SELECT w, arg_max(ts, level) AS ts FROM step GROUP BY w
"""
# All pairs of the lowest rank in one step, where that comes to the same as one at a time: for long pieces.
# ``calm``: no pair that the contraction opens to its left or right has so low a rank.
LONG = f"""
WITH RECURSIVE step(level, w, i, t) AS (
    SELECT 0, w, i, t FROM start
  UNION ALL
    SELECT level + 1, w, i, CASE WHEN done THEN rank ELSE t END FROM (
      SELECT *, lag(done, 1, false) OVER (PARTITION BY w ORDER BY place) AS swallowed FROM (
        SELECT *, taken AND (place = first OR all_calm) AS done FROM (
          SELECT q.*, min(place) FILTER (taken) OVER (PARTITION BY q.w) AS first,
                 bool_and(coalesce(l.rank > q.rank, true) AND coalesce(r.rank > q.rank, true))
                   FILTER (taken) OVER (PARTITION BY q.w) AS all_calm
          FROM (
            SELECT *, CASE WHEN lag(taken, 2, false) OVER (PARTITION BY w ORDER BY place) THEN rank
                      ELSE lag(t) OVER (PARTITION BY w ORDER BY place) END AS before,
                   lead(t, 2) OVER (PARTITION BY w ORDER BY place) AS after
            FROM (
              SELECT *, hit AND row_number() OVER (PARTITION BY w, hit, place - nth ORDER BY place) % 2 = 1 AS taken FROM (
                SELECT *, sum(hit::INT) OVER (PARTITION BY w ORDER BY place) AS nth FROM (
                  SELECT *, coalesce(rank = least_rank, false) AS hit FROM (
                    SELECT p.*, m.rank, min(m.rank) OVER (PARTITION BY w) AS least_rank FROM (
                      SELECT *, lead(t) OVER (PARTITION BY w ORDER BY i) AS next,
                             row_number() OVER (PARTITION BY w ORDER BY i) AS place
                      FROM step WHERE level < {LEVELS}) p
                    LEFT JOIN merges m ON m.pair = p.t::BIGINT * 65536 + p.next)
                  WHERE least_rank IS NOT NULL)))) q
          LEFT JOIN merges l ON q.taken AND l.pair = q.before::BIGINT * 65536 + q.rank
          LEFT JOIN merges r ON q.taken AND r.pair = q.rank::BIGINT * 65536 + q.after)))
    WHERE NOT swallowed
)
SELECT w, i, t FROM step QUALIFY level = max(level) OVER (PARTITION BY w)
"""
OPEN = """
SELECT DISTINCT w FROM (SELECT w, t, lead(t) OVER (PARTITION BY w ORDER BY i) AS next FROM ended) p
JOIN merges m ON m.pair = p.t::BIGINT * 65536 + p.next
"""


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """pair, rank: each split of an entry into two entries a and b, as a * 65536 + b."""
    rows = []
    for entry, rank in ranks.items():
        for cut in range(1, len(entry)):
            a, b = ranks.get(entry[:cut]), ranks.get(entry[cut:])
            if a is not None and b is not None:
                rows.append((a * 65536 + b, rank))
    return pa.table({"pair": pa.array([p for p, _ in rows], pa.int64()), "rank": pa.array([r for _, r in rows], pa.int32())})


class Coder:
    """Encodes and decodes pieces with one vocabulary of less than 65,536 entries."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        if max(ranks.values()) >= 65536:
            raise ValueError("the vocabulary has ids of 65,536 or more")
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        given = merge_table(ranks)  # noqa: F841  (named in the next statement)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        entries = pa.table({"id": list(ranks.values()), "bytes": pa.array(list(ranks), pa.binary())})  # noqa: F841
        self.db.execute("CREATE TABLE vocabulary AS SELECT id::INT AS id, hex(bytes) AS bytes FROM entries")

    def fixpoint(self, coded: list[bytes]) -> None:
        """Leaves the final tokens of the pieces in the table ``tokens``."""
        lengths = np.array([len(c) for c in coded])
        ends = np.cumsum(lengths)
        tokens = self.byte_ids[np.frombuffer(b"".join(coded), dtype=np.uint8)]
        if lengths.max() <= SHORT_BYTES:
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(tokens))
            given = pa.table({"w": np.arange(len(coded), dtype=np.int32), "ts": lists})  # noqa: F841
            self.db.execute("CREATE OR REPLACE TABLE start AS SELECT * FROM given")
            self.db.execute(
                f"CREATE OR REPLACE TABLE tokens AS SELECT w, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM ({SHORT})"
            )
            return
        given = pa.table(  # noqa: F841
            {
                "w": np.repeat(np.arange(len(coded), dtype=np.int32), lengths),
                "i": (np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)).astype(np.int32),
                "t": tokens,
            }
        )
        self.db.execute("CREATE OR REPLACE TABLE start AS SELECT * FROM given")
        self.db.execute("CREATE OR REPLACE TABLE tokens (w INT, t INT, i INT)")
        while True:
            self.db.execute(f"CREATE OR REPLACE TABLE ended AS {LONG}")
            self.db.execute(f"CREATE OR REPLACE TABLE unready AS {OPEN}")
            self.db.execute("INSERT INTO tokens SELECT w, t, i FROM ended WHERE w NOT IN (FROM unready)")
            if not self.db.execute("SELECT count(*) FROM unready").fetchone()[0]:
                return
            self.db.execute("CREATE OR REPLACE TABLE start AS FROM ended WHERE w IN (FROM unready)")

    def made_of(self, words: list[str]) -> list[tuple[str, str]]:
        """Of each piece: its ids joined by blanks, and the text that they decode to."""
        coded = [word.encode("utf-8", "surrogatepass") for word in words]
        out: list = [None] * len(words)
        for short in (True, False):
            group: list[int] = []
            size = 0
            for at, one in enumerate(coded):
                if (len(one) <= SHORT_BYTES) == short:
                    group.append(at)
                    size += len(one)
                    if size >= CHUNK_BYTES:
                        self.fill(out, words, coded, group)
                        group, size = [], 0
            if group:
                self.fill(out, words, coded, group)
        return out

    def fill(self, out: list, words: list[str], coded: list[bytes], group: list[int]) -> None:
        self.fixpoint([coded[at] for at in group])
        made = self.db.execute(
            "SELECT string_agg(t::VARCHAR, ' ' ORDER BY i), unhex(string_agg(bytes, '' ORDER BY i)) "
            "FROM tokens JOIN vocabulary ON id = t GROUP BY w ORDER BY w"
        ).fetchall()
        for name in ("start", "tokens", "ended", "unready"):
            self.db.execute(f"DROP TABLE IF EXISTS {name}")
        for at, (ids, decoded) in zip(group, made, strict=True):
            # The text of a good round trip is the piece itself and takes no memory of its own.
            out[at] = ids, words[at] if decoded == coded[at] else decoded.decode()


@cache
def remembered(path: str) -> Remembered:
    """One for each worker process and vocabulary."""
    return Remembered(Coder(path).made_of, most=500_000)


def rested(path: str) -> None:
    """At the end of a task: a worker that waits for other work holds no pieces."""
    remembered(path).forget()


def coded_texts(texts: list[str], path: str) -> Iterator[tuple[str, int, str]]:
    """(ids joined by blanks, number of ids, decoded text) of each text."""
    memory = remembered(path)
    for some in slices(texts, SLICE_CHARS):
        for made in memory.of([pieces(text) for text in some]):
            ids = " ".join([m[0] for m in made])
            yield ids, ids.count(" ") + 1 if ids else 0, "".join([m[1] for m in made])


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (decimal, joined by blanks), n_tokens and the decoded text of each row."""
    return per_text(docs, lambda texts: list(coded_texts(texts, path)), "ids string, n_tokens long, decoded string", 4096, lambda: rested(path))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, n_tokens, and whether decoding the ids gives the text again."""

    def rows(texts: list[str]) -> list[tuple]:
        made = coded_texts(texts, path)
        return [(ids, n, int(decoded == text)) for text, (ids, n, decoded) in zip(texts, made)]

    return per_text(docs, rows, "ids string, n_tokens long, round_trip long", 4096, lambda: rested(path))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and sha256 of the ids joined by blanks and of the decoded bytes."""

    def rows(texts: list[str]) -> list[tuple]:
        return [
            (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
            for ids, n, decoded in coded_texts(texts, path)
        ]

    return per_text(docs, rows, "n_tokens long, ids_sha256 string, decoded_sha256 string", 4096, lambda: rested(path))


def default_ranks() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_ranks())
