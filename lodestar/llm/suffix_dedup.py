"""Substring dedup by suffix structures: bytes of long strings that occur more than once go.

Every window of LENGTH bytes has an anchor, the string of ANCHOR bytes in it of the least hash, so equal windows have
equal anchors at the same place. Only anchors found at two places matter. The windows that an anchor owns in a text are
one stretch; stretches of the same anchor are gathered, a run-length index is built over them, and matching statistics
streamed over it mark the windows that occur elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import checkpoint, n_partitions, small_or_not
from lodestar.llm.runindex import RunIndex
from lodestar.llm.shingles import as_bytes, bounds, mix, powers, whole_groups

#: Production parameters: bytes of a window, bytes of an anchor.
LENGTH, ANCHOR = 400, 64
#: Stretches of an anchor that are indexed together; anchors with more are settled by the hashes of their windows.
MOST = 8192
#: Bytes of distinct stretches in an index.
BLOCK = 1 << 20
_PLACE = np.uint64((1 << 28) - 1)


def _prefix(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(0x9E37)) * up, out=total[1:])
    return total


def _hashes(total: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of ``size`` bytes, from their prefix sums."""
    n = len(total) - size
    return mix((total[size:] - total[:n]) * powers(n)[1])


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Least value of each w consecutive ones: from blocks' minima to the left and to the right."""
    n = len(v)
    m = -(-n // w) * w
    padded = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = v
    rows = padded.reshape(-1, w)
    right = np.minimum.accumulate(rows, axis=1).ravel()
    left = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[: n - w + 1], right[w - 1 : n])


def owned(data: np.ndarray, length: int, anchor: int, segment: int = 1 << 27) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's hash, first window, last window) of each stretch of a text of at least ``length`` bytes.

    Places fit in 28 bits: longer texts are looked at in segments that share all but one byte of a window.
    """
    out: tuple[list, list, list] = ([], [], [])
    for begin in range(0, len(data) - length + 1, segment):
        h = _hashes(_prefix(data[begin : begin + segment + length - 1]), anchor)
        v = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        at = (_sliding_min(v, length - anchor + 1) & _PLACE).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        for x, y in zip(out, (h[at[first]].view(np.int64), begin + first, begin + np.concatenate((first[1:] - 1, [len(at) - 1]))), strict=True):
            x.append(y)
    return tuple(np.concatenate(x) for x in out)


def _anchors(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column("text"))
            texts, hashes, firsts, lasts = [], [], [], []
            for i in range(batch.num_rows):
                one = data[offsets[i] : offsets[i + 1]]
                if len(one) >= length:
                    h, a, b = owned(one, length, anchor)
                    texts.extend([hashlib.md5(one).digest()] * len(h))
                    hashes.append(h)
                    firsts.append(a)
                    lasts.append(b)
            if texts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(texts, pa.binary()), pa.array(np.concatenate(firsts)), pa.array(np.concatenate(lasts))], ["anchor", "key", "first", "last"])

    return run


def _stretches(length: int):
    """The bytes of each stretch (hot anchors': left out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column("text"))
            out: tuple[list, list, list, list] = ([], [], [], [])
            for i, (key, hits) in enumerate(zip(batch.column("key").to_pylist(), batch.column("hits").to_pylist(), strict=True)):
                one = data[offsets[i] : offsets[i + 1]]
                for hit in hits:
                    if not hit["hot"]:
                        for x, y in zip(out, (hit["anchor"], key, hit["first"], one[hit["first"] : hit["last"] + length].tobytes()), strict=True):
                            x.append(y)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.binary(), pa.int64(), pa.binary()), strict=True)], ["anchor", "key", "first", "bytes"])

    return run


def _windows(length: int):
    """128-bit hashes of each window that a hot anchor owns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column("text"))
            for i, (key, hits) in enumerate(zip(batch.column("key").to_pylist(), batch.column("hits").to_pylist(), strict=True)):
                one = data[offsets[i] : offsets[i + 1]]
                for hit in hits:
                    if hit["hot"]:
                        part = one[hit["first"] : hit["last"] + length]
                        a, b = _hashes(_prefix(part), length), _hashes(_prefix(part ^ np.uint8(0xA5)), length)
                        n = len(a)
                        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array([key] * n, pa.binary()), pa.array(np.arange(n) + hit["first"])], ["a", "b", "key", "at"])

    return run


def _indexed(length: int):
    """Where windows occur elsewhere among the stretches of the same anchors: (key, from, to) in bytes of the text."""

    def settle(rows: list[tuple[bytes, int, bytes]]) -> Iterator[tuple[bytes, int, int]]:
        places: dict[bytes, list[tuple[bytes, int]]] = {}
        for key, first, stretch in rows:
            places.setdefault(stretch, []).append((key, first))
        t = np.frombuffer(b"\xff".join([*places, b""]), np.uint8)  # no text holds the byte FF
        found = RunIndex(t).matches() >= length
        at = 0
        for stretch, where in places.items():
            n = len(stretch) - length + 1
            if len(where) > 1:
                runs = [(0, n)]
            else:
                edges = np.flatnonzero(np.diff(np.concatenate(([0], found[at : at + n].view(np.int8), [0]))))
                runs = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
            for key, first in where:
                for a, b in runs:
                    yield key, first + a, first + b - 1 + length
            at += len(stretch) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            out = list(settle(held))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], ["key", "from", "to"])

        for table in whole_groups(batches, "anchor"):
            at = bounds(table.column("anchor").to_numpy())
            keys, firsts, stretches = (table.column(c).to_pylist() for c in ("key", "first", "bytes"))
            for a, b in zip(at[:-1], at[1:], strict=True):
                rows = list(dict.fromkeys(zip(keys[a:b], firsts[a:b], stretches[a:b], strict=True)))
                if len(rows) < 2:
                    continue
                if len(distinct := set(stretches[a:b])) == 1:  # an index of one stretch only says what is known
                    n = len(rows[0][2])
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[1] + n for r in rows], pa.int64())], ["key", "from", "to"])
                    continue
                held.extend(rows)
                size += sum(map(len, distinct))
                if size >= BLOCK:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = as_bytes(batch.column("text"))
        out: tuple[list, list, list, list, list] = ([], [], [], [], [])
        for i, marks in enumerate(batch.column("marks").to_pylist()):
            one = data[offsets[i] : offsets[i + 1]]
            edge = np.zeros(len(one) + 1, np.int64)
            for m in marks or ():
                edge[m["from"]] += 1
                edge[min(m["to"], len(one))] -= 1
            gone = np.cumsum(edge)[:-1] > 0 if len(one) else np.zeros(0, bool)
            starts = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
            kept = one[~gone].tobytes()
            for x, y in zip(out, (len(one), int(gone.sum()), len(starts) // 2, hashlib.sha256(kept).hexdigest(), starts.tolist()), strict=True):
                x.append(y)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, k) for x, k in zip(out, kinds, strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, most: int = MOST) -> DataFrame:
    """One row per row of docs: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed``.

    A byte is removed if a string of ``length`` bytes that covers it also starts at another place, in the same text or
    another; strings are judged on the input and don't cross texts. removed has the edges of the removed runs in bytes:
    from, to (exclusive), and so on. Texts are their UTF-8 bytes; null is empty; texts shorter than ``length`` stay.
    Rows of equal texts are copies of each other whatever their ids, null or repeated ids included. Empty tables give
    no rows.

    Copies of a whole text are settled by its hash, and one of them stands for all in the index, so groups of copies
    are no burden. Anchors with more than ``most`` stretches, such as a passage in a third of all texts has, are settled
    by 128-bit hashes of their windows, which are counted before they are shuffled.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = rows.select("doc_id", "text", F.unhex(F.md5("text")).alias("key"))
    anchors = rows.select("text").mapInArrow(_anchors(length, anchor), "anchor long, key binary, first long, last long")
    place = F.xxhash64("key", "first")
    twice = anchors.groupBy("anchor").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("anchor")
    # as a checkpoint it is broadcast if small, and else meets the anchors in a join whose hot partitions can be split
    twice = small_or_not(checkpoint(twice), F.lit(16))
    hits = checkpoint(anchors.join(twice, "anchor", "left_semi").distinct())
    hot = checkpoint(hits.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("anchor", F.lit(True).alias("hot")))
    marked = hits.join(small_or_not(hot, F.lit(24)), "anchor", "left")
    by_text = marked.groupBy("key").agg(F.collect_list(F.struct("anchor", "first", "last", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("hits"))
    groups = checkpoint(keyed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).join(by_text, "key", "full").select("key", "doc_id", "n", "hits").filter("n > 1 or hits is not null"))
    with_hits = groups.filter("hits is not null").select(F.col("key").alias("__key"), F.col("doc_id").alias("__id"), "hits")
    sources = keyed.join(with_hits, (F.col("key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id"))).select("key", "text", "hits")
    parts = 2 * n_partitions(docs.sparkSession)
    stretches = sources.mapInArrow(_stretches(length), "anchor long, key binary, first long, bytes binary")
    marks = stretches.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_indexed(length), "key binary, from long, to long")
    if not hot.isEmpty():
        windows = sources.filter(F.exists("hits", lambda x: x["hot"])).mapInArrow(_windows(length), "a long, b long, key binary, at long").distinct()
        place = F.xxhash64("key", "at")
        again = windows.groupBy("a", "b").agg(F.min(place).alias("x"), F.max(place).alias("y")).filter("x <> y").select("a", "b")
        marks = marks.unionByName(windows.join(again, ["a", "b"], "left_semi").select("key", F.col("at").alias("from"), (F.col("at") + length).alias("to")))
    copies = groups.filter("n > 1").select("key", F.lit(0).cast("long").alias("from"), F.lit(1 << 40).alias("to"))
    short = F.octet_length("text") < length
    all_marks = checkpoint(marks.unionByName(copies).groupBy("key").agg(F.collect_list(F.struct("from", "to")).alias("marks")))
    out = keyed.join(all_marks, "key", "left").select("doc_id", "text", F.when(~short, F.col("marks")).alias("marks"))
    schema = out.select("doc_id").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string").add("removed", T.ArrayType(T.LongType()))
    return out.mapInArrow(_cut, schema)
