"""Substring dedup by sliding sentence spans: a sentence goes if a span of consecutive sentences that holds it came before.

Sentences are cut finely, at commas, semicolons, colons and line ends too, so that a passage put into a text shares only
a clause with what stands around it. A span is bounded in words rather than in sentences alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import n_partitions
from lodestar.llm.shingles import hashes_at, mix, pieces, powers, word_places

#: Production parameters: a span has at least so many sentences and words, or fewer sentences but LONG words.
SPAN, WORDS, LONG = 3, 20, 50
#: Spans that a task looks at together before they are shuffled.
CHUNK = 1 << 20
#: The marks after which a sentence ends, and the bytes of line ends.
MARKS, BREAKS = b".!?,;:", b"\r\n"
_MARK, _BREAK = np.isin(np.arange(256), list(MARKS)), np.isin(np.arange(256), list(BREAKS))


class _Sentences:
    """The sentences of some texts: ``first`` and ``last`` word of each (last exclusive), and where each text's begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.starts, self.ends = word_places(data, offsets)
        n = len(self.starts)
        self.words = np.searchsorted(self.starts, offsets)
        over = np.zeros(n + 1, bool)
        over[self.words[1:]] = True  # place k: a sentence ends before word k
        if n:
            breaks = np.concatenate(([0], np.cumsum(_BREAK[data])))
            after = np.concatenate((self.starts[1:], [len(data)]))
            over[1:] |= _MARK[data[self.ends - 1]] | (breaks[after] > breaks[self.ends])
        over[0] = False
        cuts = np.flatnonzero(over)
        self.first, self.last = np.concatenate(([0], cuts[:-1])) if len(cuts) else cuts, cuts
        self.at = np.searchsorted(self.first, self.words)

    def spans(self, span: int, words: int, long: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first sentence, last sentence) of every span, numbered over all texts: the shortest from each sentence."""
        i = np.arange(len(self.first))
        text = np.searchsorted(self.at, i, "right") - 1
        begin, end = self.at[text], self.at[text + 1] - 1
        reach = lambda n: np.searchsorted(self.last, self.first + n)
        j = np.minimum(np.maximum(i + span - 1, reach(words)), reach(long))
        whole = (end - begin + 1 < span) & (i == begin) & (self.words[text + 1] - self.words[text] >= words)
        j = np.where(whole, np.minimum(j, end), j)
        ok = j <= end
        return text[ok], i[ok], j[ok]

    def hashes(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of the words of sentences i to j."""
        h = hashes_at(self.data, self.starts, self.ends)
        up, down = powers(len(h) + 1)
        a, b = self.first[i], self.last[j]
        out = []
        for x in (h, mix(h ^ np.uint64(0x5851F42D4C957F2D))):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * up[:-1], dtype=np.uint64)))
            out.append(mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64)))
        return out[0].view(np.int64), (out[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


_ROW = ["key", "more", "gone", "id", "t", "from", "to"]
_SCHEMA = "key long, more int, gone boolean, id long, t long, from int, to int"


def _rows(key, more, gone, id, t, first, last) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((key, more, gone, id, t, first, last), kinds, strict=True)], _ROW)


def _again(key: list[np.ndarray], place: list[np.ndarray], before: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows: which have the key of the row before them, and which of these stand at another place than the key's first.

    before: the key and first place that the rows go on from; it is set to those of the last row.
    """
    n = len(key[0])
    again = np.ones(n, bool)
    again[1:] = np.logical_and.reduce([x[1:] == x[:-1] for x in key])
    again[:1] = bool(before) and [x[0] for x in key] == before[: len(key)]
    first = np.maximum.accumulate(np.where(again, -1, np.arange(n)))
    firsts = [np.where(first < 0, before[len(key) + k] if before else 0, x[first]) for k, x in enumerate(place)]
    if before is not None and n:
        before[:] = [*[x[-1] for x in key], *[x[-1] for x in firsts]]
    return again, again & np.logical_or.reduce([x != y for x, y in zip(place, firsts, strict=True)])


def _spans(span: int, words: int, long: int):
    """Of each span the first place among CHUNK spans of the partition; the other places there as places to remove."""

    def settled(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        key, more, id, t, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        tied = np.concatenate((same, [False])) | np.concatenate(([False], same))
        alone, order = order[~tied], order[tied]
        order = order[np.lexsort((first[order], t[order], id[order], more[order], key[order]))]
        again, other = _again([x[order] for x in (key, more)], [x[order] for x in (id, t, first)])
        stay, gone = np.concatenate((alone, order[~again])), order[other]
        yield _rows(key[stay], more[stay], np.zeros(len(stay), bool), id[stay], t[stay], first[stay], last[stay])
        if len(gone):
            # runs of sentences to remove that touch are one
            gone = gone[np.lexsort((last[gone], first[gone], t[gone], id[gone]))]
            i, h, a, b = id[gone], t[gone], first[gone], last[gone]
            other = np.concatenate(([True], (i[1:] != i[:-1]) | (h[1:] != h[:-1])))
            upto = np.maximum.accumulate(b.astype(np.int64) + np.cumsum(other) * (1 << 32)) % (1 << 32)
            begin = np.flatnonzero(other | np.concatenate(([True], a[1:] > upto[:-1] + 1)))
            end = np.concatenate((begin[1:] - 1, [len(gone) - 1]))
            by_text = mix(mix(i[begin].view(np.uint64)) ^ h[begin].view(np.uint64)).view(np.int64)
            yield _rows(by_text, np.zeros(len(begin), np.int32), np.ones(len(begin), bool), i[begin], h[begin], a[begin], upto[end])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            ids, hashes = batch.column("id").to_numpy(), batch.column("t").to_numpy()
            for row, data, offsets in pieces(batch.column("text")):
                s = _Sentences(data, offsets)
                text, i, j = s.spans(span, words, long)
                if not len(i):
                    continue
                key, more = s.hashes(i, j)
                held.append((key, more, ids[row + text], hashes[row + text], i - s.at[text], j - s.at[text]))
                size += len(i)
                if size >= CHUNK:
                    yield from settled(held)
                    held, size = [], 0
        if held:
            yield from settled(held)

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows the places to remove: all but the first place of each span, and those known before."""
    before: list = []
    for batch in batches:
        if batch.num_rows:
            key, more, gone, *place = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "more", "gone", "id", "t", "from"))
            _, other = _again([key, gone, more], place, before)
            yield batch.select(["id", "t", "from", "to"]).filter(pa.array(other | gone))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes the marked sentences out of each text, with the white space after them."""
    for batch in batches:
        marks = batch.column("marks").to_pylist()
        n, removed, texts = [], [], []
        for row, data, offsets in pieces(batch.column("text")):
            s = _Sentences(data, offsets)
            for k in range(len(offsets) - 1):
                a, b = s.at[k], s.at[k + 1]
                n.append(int(b - a))
                if not marks[row + k]:
                    removed.append(0)
                    texts.append(data[offsets[k] : offsets[k + 1]].tobytes())
                    continue
                stay = np.ones(b - a, bool)
                for m in marks[row + k]:
                    stay[m["from"] : m["to"] + 1] = False
                edges = np.concatenate((s.starts[s.first[a:b]], offsets[k + 1 : k + 2]))
                parts = [data[offsets[k] : edges[0]], *[data[x:y] for x, y in zip(edges[:-1][stay], edges[1:][stay], strict=True)]]
                removed.append(int((~stay).sum()))
                texts.append(b"".join(x.tobytes() for x in parts))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_sentences", "n_removed", "text"])


def remove_repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, words: int = WORDS, long: int = LONG) -> DataFrame:
    """One row per row of docs: ``doc_id, n_sentences, n_removed, text``, the text without the removed sentences.

    A sentence ends after a word that ends in one of . ! ? , ; : or that a line end follows. From every sentence the
    shortest run of consecutive sentences that holds ``words`` words in at least ``span`` sentences, or ``long`` words
    in fewer, is hashed (96 bits); a text of fewer sentences is a run as a whole if it has ``words`` words. Runs are
    equal if their words are, with A-Z lower-cased, whatever white space stands between them. The first of equal runs is
    the one of the least (doc_id, text hash, place); sentences that any other run covers are removed, with the white
    space after them. Texts of which nothing is removed stay as they are. Null texts have no sentences and give an empty
    text. Ids must be whole numbers; rows without one come last, and rows that repeat an id with another text are told
    apart by their text's hash; of rows that are equal in both each counts as the same place, so they don't remove one
    another. Empty tables give no rows.

    A task settles the runs it finds repeatedly itself, as any but its own first place goes whatever others find. So a run is
    shuffled once for each task, by its hash, and one in a third of all documents is no burden to any.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole.alias("text"), F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1)).alias("id"), F.xxhash64(whole).alias("t"))
    parts = n_partitions(docs.sparkSession)
    found = rows.select("id", "t", "text").mapInArrow(_spans(span, words, long), _SCHEMA)
    found = found.repartition(parts, "key").sortWithinPartitions("key", "gone", "more", "id", "t", "from").mapInArrow(_later, "id long, t long, from int, to int")
    marks = found.distinct().groupBy("id", "t").agg(F.collect_list(F.struct("from", "to")).alias("marks"))
    out = rows.join(marks, ["id", "t"], "left").select("doc_id", "text", "marks")
    return out.mapInArrow(_cut, out.select("doc_id").schema.add("n_sentences", "long").add("n_removed", "long").add("text", "string"))
