"""Byte-level BPE encoding and decoding by DuckDB recursive queries in each partition (operator 5).

A worker splits texts into words by the pattern and looks words up among those it has encoded. The
new ones of a batch go to an in-process DuckDB as token-position rows (word, place, token). One step of
the recursive query joins each adjacent pair to the merge table and contracts each word's pairs of least rank, from the
left and without overlap; words with no pair left stop. Decoding aggregates the tokens' bytes in order of place. Both
directions are per distinct word, the texts are the concatenation.

A contraction makes only pairs of higher ranks in a vocabulary whose every token is what its own bytes contract to (which a
test holds), so taking all places of the least pair in one step is the same as taking them one by one. A query has a bounded number
of steps. What is not finished then is cut where the two tokens' bytes are in no token of the vocabulary: nothing can
join across such a place, so the parts are words of their own in the next query, each with its own least pair.
Memory: a query's rows times its steps are bounded, and the table of words is emptied when it passes CACHE_WORDS.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import arrow_texts, slices

CACHE_WORDS, CACHE_BYTES = 800_000, 64 << 20
#: Words and bytes of one query (a longer word is alone), and the most rows times steps that it holds.
GROUP, GROUP_BYTES, STEP_ROWS = 20_000, 1 << 18, 4 << 20

#: tok: word, place, token. Rows of a word that still changes are rewritten each step; a word's result is its last step.
#: A pair is taken if it stands at an odd place in its run of pairs that could be, so that those taken do not overlap. Only words
#: where two such pairs overlap need their places counted (the last branch); elsewhere each is taken.
CONTRACT = """
WITH RECURSIVE steps(step, word, place, token) AS (
    SELECT 0, word, place, token FROM tok
  UNION ALL
    (WITH met AS MATERIALIZED (
      SELECT step, word, place, token, n, made, min(made) OVER (PARTITION BY word ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS best, lag(made) OVER (PARTITION BY word ORDER BY place) AS before
      FROM (
        SELECT q.step, q.word, q.place, q.token, q.n, m.token AS made
        FROM (SELECT step, word, place, token, lead(token) OVER w AS r, row_number() OVER w AS n FROM steps WHERE step < $steps WINDOW w AS (PARTITION BY word ORDER BY place)) q
        LEFT JOIN merges m ON m.l = q.token AND m.r = q.r
      )
    ), runs AS MATERIALIZED (SELECT DISTINCT word FROM met WHERE made = best AND before = best)
    SELECT step + 1, word, place, CASE WHEN made = best THEN best ELSE token END
    FROM met WHERE best IS NOT NULL AND before IS DISTINCT FROM best AND word NOT IN (SELECT word FROM runs)
  UNION ALL
    SELECT step + 1, word, place, CASE WHEN taken THEN best ELSE token END
    FROM (
      SELECT *, lag(taken, 1, false) OVER (PARTITION BY word ORDER BY place) AS gone
      FROM (
        SELECT step, word, place, token, best, made = best AND (n - coalesce(max(CASE WHEN made IS DISTINCT FROM best THEN n END) OVER (PARTITION BY word ORDER BY place), 0)) % 2 = 1 AS taken
        FROM met WHERE word IN (SELECT word FROM runs)
      )
    ) WHERE NOT coalesce(gone, false))
)
SELECT word, place, token, step FROM steps JOIN (SELECT word, max(step) AS step FROM steps GROUP BY word) USING (word, step) ORDER BY word, place
"""
#: Bytes of each word, in order of place.
DECODE = "SELECT word, string_agg(bytes, '' ORDER BY place) AS hexed FROM done JOIN vocab USING (token) GROUP BY word ORDER BY word"


def merge_table(ranks: dict[bytes, int]) -> np.ndarray:
    """(left id, right id, merged id) of every way to cut a token into two tokens: the pairs that contraction by rank can meet."""
    rows = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    return np.array(rows, np.int64).reshape(-1, 3)


class Codec:
    """Words to ids and ids to bytes by one DuckDB in memory, single-threaded as a task is."""

    def __init__(self, ranks_path: str, pattern: str):
        import duckdb
        import regex

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern).findall
        self.tokens = {r: t for t, r in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.neighbours = np.zeros((256, 256), bool)  # bytes that follow each other in some token
        for t in ranks:
            at = np.frombuffer(t, np.uint8)
            self.neighbours[at[:-1], at[1:]] = True
        self.inner: np.ndarray | None = None
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB"})
        m = merge_table(ranks)
        self.db.register("m_in", pa.table({"l": m[:, 0], "r": m[:, 1], "token": m[:, 2]}))
        self.db.register("v_in", pa.table({"token": pa.array(list(ranks.values()), pa.int64()), "bytes": [t.hex() for t in ranks]}))
        self.db.execute("CREATE TABLE merges AS SELECT l, r, token FROM m_in; CREATE TABLE vocab AS SELECT * FROM v_in")
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.held = 0

    def learn(self, words: list[str]) -> None:
        """Encode and decode new distinct words and keep (ids as little-endian 32-bit, decoded bytes)."""
        raw = [w.encode("utf-8", "replace") for w in words]
        ends = np.cumsum([len(r) for r in raw])
        begin = 0
        while begin < len(raw):
            end = max(begin + 1, min(begin + GROUP, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + GROUP_BYTES, "right"))))
            n = np.array([len(r) for r in raw[begin:end]])
            data = np.frombuffer(b"".join(raw[begin:end]), np.uint8)
            word, place, token = self.contract(np.repeat(np.arange(len(n)), n), data)
            self.db.register("done", pa.table({"word": word, "place": place, "token": token}))
            got = self.db.execute(DECODE).to_arrow_table()
            self.db.unregister("done")
            order = np.argsort(place)  # places ascend from word to word
            ids, first = token[order].astype("<u4").tobytes(), (4 * np.searchsorted(word[order], np.arange(len(n) + 1))).tolist()
            for i, hexed in zip(got.column("word").to_pylist(), got.column("hexed").to_pylist(), strict=True):
                pair = (ids[first[i] : first[i + 1]], bytes.fromhex(hexed))
                self.held += len(pair[0]) + len(pair[1])
                self.known[words[begin + i]] = pair
            begin = end

    def contract(self, word: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, place, token) of the words' tokens. data: their bytes, word: which each byte is of, ascending."""
        place, token = np.arange(len(data)), self.byte_ids[data]
        cut = np.flatnonzero((word[1:] != word[:-1]) | ~self.neighbours[data[:-1], data[1:]]) + 1
        done = []
        while len(place):
            part = np.zeros(len(place), np.int32)
            part[cut] = 1
            part = np.cumsum(part, dtype=np.int32)
            steps = int(max(4, min(64, STEP_ROWS // len(place))))
            self.db.register("tok", pa.table({"word": part, "place": place.astype(np.int32), "token": token}))
            got = self.db.execute(CONTRACT, {"steps": steps}).to_arrow_table()
            self.db.unregister("tok")
            part, place, token, step = (got.column(c).to_numpy() for c in ("word", "place", "token", "step"))
            rest = step == steps
            done.append((place[~rest], token[~rest]))
            part, place, token = part[rest], place[rest].astype(np.int64), token[rest]
            cut = np.flatnonzero((part[1:] != part[:-1]) | ~self.joinable(token[:-1], token[1:])) + 1
        place, token = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return word[place], place, token

    def joinable(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the bytes of the two tokens follow each other in any token. Compared by 64-bit hashes: a chance hit only delays a cut."""
        if not len(left):
            return np.zeros(0, bool)
        if self.inner is None:
            self.inner = np.unique(np.fromiter((xxhash.xxh64_intdigest(t[i:j]) for t in self.tokens.values() for i in range(len(t)) for j in range(i + 2, len(t) + 1)), np.uint64))
        tokens = self.tokens
        want = np.fromiter((xxhash.xxh64_intdigest(tokens[a] + tokens[b]) for a, b in zip(left.tolist(), right.tolist(), strict=True)), np.uint64, len(left))
        at = np.minimum(np.searchsorted(self.inner, want), len(self.inner) - 1)
        return self.inner[at] == want

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids, decoded bytes) of each text."""
        if len(self.known) > CACHE_WORDS or self.held > CACHE_BYTES:
            self.known.clear()
            self.held = 0
        cut = [self.split(t) for t in texts]
        new = {w for words in cut for w in words}.difference(self.known)
        if new:
            self.learn(sorted(new, key=lambda w: (len(w), w)))
        known, out = self.known, []
        for words in cut:
            pairs = [known[w] for w in words]
            out.append((b"".join([p[0] for p in pairs]), b"".join([p[1] for p in pairs])))
        return out


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def public_codec() -> Codec:
    import public_tokenizers as P

    return codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def encoded(docs: DataFrame, make: Callable[[], Codec] = public_codec) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and decoded (the bytes the ids stand for).

    Null and empty texts have no ids; repeated rows come repeatedly; other columns are ignored.
    """
    return _mapped(docs, make, "doc_id long, ids binary, decoded binary", pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())]), lambda ids, decoded: (ids, decoded))


def encoded_digest(docs: DataFrame, make: Callable[[], Codec] = public_codec) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what encoded() gives, without moving the ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return _mapped(docs, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", schema, lambda ids, decoded: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))


def _mapped(docs: DataFrame, make: Callable[[], Codec], ddl: str, schema: pa.Schema, row: Callable) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = make()
        for whole in batches:
            for b in slices(whole, "text", 4 << 20):
                cols = list(zip(*(row(*x) for x in c.encode(arrow_texts(b.column("text")))), strict=True))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(v, t) for v, t in zip(cols, schema.types[1:], strict=True))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ddl)
