"""Byte-level BPE encoding and decoding by recursive DuckDB queries, one database in each Python worker.

Texts are split by the tokenizer's pattern; each distinct piece is encoded once. A recursive query holds one row for each
token and position of its words, joins neighbours with the merge table, contracts each word's leftmost pair of least
rank, and ends when no word has a pair. Tokens of a word are decoded by an ordered aggregation over the vocabulary.
Encoded pieces are kept in two generations of bounded size, so frequent ones stay and memory doesn't grow.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of words encoded by one query, which bound its memory; pieces that are kept in a generation; bytes of text that
#: are worked on together.
CHUNK, KEPT, GROUP = 1 << 17, 200_000, 2 << 20
#: A recursive query takes as many rounds over all tokens of a word as it has merges, so words of more bytes than this
#: (unbroken runs of letters, digits or signs) are merged by a heap, in the same order, instead.
LONG = 256

_ENCODE = """
WITH RECURSIVE s(w, pos, tok, done) AS (
  SELECT w, pos, tok, false FROM init
  UNION ALL
  (WITH c AS MATERIALIZED (SELECT w, pos, tok FROM s WHERE NOT done),
        best AS (SELECT a.w, min(m.rank::BIGINT * 65536 + a.pos) AS low
                 FROM c a JOIN c b ON b.w = a.w AND b.pos = a.pos + 1 JOIN merges m ON m.pair = a.tok::BIGINT * 16777216 + b.tok GROUP BY a.w)
   SELECT c.w, CASE WHEN pos > low % 65536 THEN pos - 1 ELSE pos END, CASE WHEN pos = low % 65536 THEN (low // 65536)::INT ELSE tok END, low IS NULL
   FROM c LEFT JOIN best USING (w) WHERE low IS NULL OR pos <> low % 65536 + 1)
)
SELECT w, pos, tok FROM s WHERE done
"""
_DECODE = "SELECT w, list(tok ORDER BY pos) AS ids, string_agg(b, '' ORDER BY pos) AS b FROM ({}) JOIN vocabulary v ON v.id = tok GROUP BY w ORDER BY w"


#: An encoded piece: ids joined by blanks, their number, the decoded bytes, and the ids as 32-bit numbers.
Piece = tuple[str, int, bytes, bytes]


def _piece(ids: list[int], decoded: bytes) -> Piece:
    return " ".join(map(str, ids)), len(ids), decoded, np.array(ids, np.int32).tobytes()


class Codec:
    """The merge table and vocabulary of a rank file in a DuckDB database, and the pieces that were encoded last."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pairs = [(a << 24 | b, r) for token, r in self.ranks.items() for i in range(1, len(token)) if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None]
        self.bytes = {r: token for token, r in self.ranks.items()}
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.split = regex.compile(pattern).findall
        # queries are small enough for memory, so nothing is spilled to the worker's own disk
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        rows_ = pa.table({"pair": pa.array([p for p, _ in pairs], pa.int64()), "rank": pa.array([r for _, r in pairs], pa.int32())})
        self.db.execute("CREATE TABLE merges AS SELECT * FROM rows_")
        rows_ = pa.table({"id": pa.array(list(self.bytes), pa.int32()), "b": [x.hex() for x in self.bytes.values()]})
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM rows_")
        self.young: dict[str, Piece] = {}
        self.old: dict[str, Piece] = {}

    def _encode(self, words: list[str]) -> Iterator[tuple[str, Piece]]:
        every = [w.encode() for w in words]
        ends = np.cumsum([len(x) for x in every])
        cuts = np.flatnonzero(np.diff(ends // CHUNK)) + 1 if len(ends) else ends
        for a, b in zip([0, *cuts], [*cuts, len(words)], strict=True):
            part, raw = words[a:b], every[a:b]
            if not raw:
                continue
            n = np.array([len(x) for x in raw])
            w = np.repeat(np.arange(len(raw)), n)
            init = pa.table({"w": w, "pos": np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), "tok": self.byte[np.frombuffer(b"".join(raw), np.uint8)]})
            self.db.register("init", init)
            for w, ids, b in self.db.execute(_DECODE.format(_ENCODE)).fetchall():
                yield part[w], _piece(ids, bytes.fromhex(b))

    def _merge(self, word: bytes) -> list[int]:
        """The merges of one long word: a heap of (rank, place) gives the leftmost pair of least rank."""
        tokens: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))

        def pair(i: int) -> int | None:
            return self.ranks.get(tokens[i] + tokens[after[i]]) if after[i] < len(word) else None

        heap = [(r, i) for i in range(len(word)) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if tokens[i] is None or pair(i) != r:
                continue
            j = after[i]
            tokens[i], tokens[j], after[i] = tokens[i] + tokens[j], None, after[j]
            if after[i] < len(word):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := pair(k)) is not None:
                    heapq.heappush(heap, (r, k))
        return [self.ranks[t] for t in tokens if t is not None]

    def learn(self, pieces: Iterable[str]) -> None:
        """After this every one of the pieces is in ``young``."""
        if len(self.young) > KEPT:
            self.old, self.young = self.young, {}
        new = []
        for p in pieces:
            if p not in self.young:
                if (known := self.old.get(p)) is not None:
                    self.young[p] = known
                elif len(p) > LONG // 4 and len(raw := p.encode()) > LONG:
                    ids = self._merge(raw)
                    self.young[p] = _piece(ids, b"".join(self.bytes[i] for i in ids))
                else:
                    new.append(p)
        self.young.update(self._encode(new))

    def encode(self, texts: Iterable[str]) -> Iterator[list[Piece]]:
        """For each text its encoded pieces."""
        held: list[list[str]] = []
        size = 0
        for text in [*texts, None]:
            if text is not None:
                held.append(self.split(text))
                size += len(text)
            if held and (text is None or size > GROUP):
                self.learn({p for pieces in held for p in pieces})
                for pieces in held:
                    yield [self.young[p] for p in pieces]
                held, size = [], 0

    def decode(self, rows: list[list[int]]) -> list[bytes]:
        """Bytes of lists of ids; an unknown id raises ValueError."""
        n = np.array([len(x) for x in rows], np.int64)
        ids = np.array([i for x in rows for i in x], np.int32)
        if len(ids) and not set(np.unique(ids).tolist()) <= self.bytes.keys():
            raise ValueError("an id isn't in the vocabulary")
        self.db.register("given", pa.table({"w": np.repeat(np.arange(len(rows)), n), "pos": np.arange(n.sum()), "tok": ids}))
        out = [b""] * len(rows)
        for w, _, b in self.db.execute(_DECODE.format("SELECT w, pos, tok FROM given")).fetchall():
            out[w] = bytes.fromhex(b)
        return out


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _texts(batch: pa.RecordBatch, text: str) -> list[str]:
    return [x or "" for x in batch.column(text).to_pylist()]


def _lists(ids: list[bytes]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with ``ids``, the tokens of each whole text, in place of the text.

    Ids are those the rank file gives, with no special tokens: strings that look like such are ordinary text. Null and
    empty texts have no ids. Every row is encoded by itself, so repeated rows and other columns pass through as they
    are; an input column named ids is replaced. No shuffle.
    """
    kept = [c for c in docs.columns if c not in (text, "ids")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            ids = _lists([b"".join([e[3] for e in x]) for x in c.encode(_texts(batch, text))])
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], ids], [*kept, "ids"])

    schema = docs.select(*kept).schema.add("ids", T.ArrayType(T.IntegerType()))
    return docs.select(*kept, text).mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """rows with ``bytes``, what the ids stand for, in place of the ids; null and empty lists give no bytes."""
    kept = [c for c in rows.columns if c not in (ids, "bytes")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            out = c.decode([x or [] for x in batch.column(ids).to_pylist()])
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], pa.array(out, pa.binary())], [*kept, "bytes"])

    return rows.select(*kept, ids).mapInArrow(run, rows.select(*kept).schema.add("bytes", "binary"))


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """The ``keep`` columns, ``n_tokens, ids_sha256, decoded_sha256`` and, if wanted, ``ids``: encode, decode and hash in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            n, ids, back, raw = [], [], [], []
            for x in c.encode(_texts(batch, text)):
                n.append(sum([e[1] for e in x]))
                ids.append(hashlib.sha256(" ".join([e[0] for e in x]).encode()).hexdigest())
                back.append(hashlib.sha256(b"".join([e[2] for e in x])).hexdigest())
                if with_ids:
                    raw.append(b"".join([e[3] for e in x]))
            columns = [*[batch.column(k) for k in keep], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [_lists(raw)] * with_ids, [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    schema = docs.select(*keep).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
