"""MinHash near-duplicates by a chosen-path set similarity join.

Every distinct shingle set gets minwise tokens. A tree branches the sets by a chosen token, level after level, until a
node is small; small nodes are compared exhaustively, first by their tokens, then on full sets. Independent trees are
repeated until a pair at the threshold is found with the wanted probability: a pair of similarity s shares the first
node of a tree with probability s, so n trees miss it with (1 - s) ** n, at most MISS at the threshold.

First nodes are dealt out by Spark; one with up to CROWD sets branches on within its task, so a set is one row for each
tree however deep the tree goes there. A pair comes along to a deeper level only with a chance of about its similarity,
so a large node is branched anew, by other tokens, as often as its depth asks for (``_repeats``), and no deeper than
DEPTH levels, below which all pairs are compared.

Two trees are walked first, and the links in them contracted to components. The large nodes of the other trees only
compare sets of different components, so a group of near copies costs its size for each tree and not its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import checkpoint, n_partitions, small_or_not
from lodestar.llm.components import components
from lodestar.llm.shingles import as_bytes, bounds, mix, shingle_sets, whole_groups

SIZE = 5
#: 100 * intersection >= percent * union links two sets; PERCENT is the contract of op10.
PERCENT = 85
#: Tokens of a set; sets of a node that are compared exhaustively, and that a task branches on; levels of branching;
#: trees that are walked before links are contracted, and sets that each block of such a tree's deepest nodes shares.
TOKENS, NODE, CROWD, DEPTH, FIRST, PIVOTS = 64, 300, 8192, 12, 2, 8
#: Levels by which Spark itself branches a node of more than CROWD sets; below them it is cut into pairs of blocks.
LEVELS = 4
#: Chance to miss a pair at the threshold in the first nodes of all trees, and within large nodes.
MISS, MISS_DEEP = 0.15**20, 1e-3
_A = np.random.default_rng(7).integers(0, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(8).integers(0, 2**63, TOKENS, dtype=np.uint64)


def _trees(percent: int) -> int:
    """Trees that miss a pair at the threshold with a chance of at most MISS."""
    return 1 if percent >= 100 else min(TOKENS, int(np.ceil(np.log(MISS) / np.log(1 - percent / 100) - 1e-9)))


def _least(percent: int) -> int:
    """Equal tokens below which pairs aren't compared: four standard deviations below the threshold."""
    s = percent / 100
    return int(np.ceil(TOKENS * (s - 4 * (s * (1 - s) / TOKENS) ** 0.5)))


def _tokens(s: np.ndarray) -> np.ndarray:
    out = np.full(TOKENS, 2**64 - 1, np.uint64)
    for i in range(0, len(s), 8192):
        np.minimum(out, (s[i : i + 8192, None] * _A + _B).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def _repeats(percent: int, depth: int) -> int:
    """How often a large node is branched anew if it went ``depth`` levels down, for a miss of at most MISS_DEEP.

    Tokens of a pair at the threshold agree with a frequency that varies around it, as there are only TOKENS of them;
    half a standard deviation less is reckoned with.
    """
    s = percent / 100
    s -= 0.5 * (s * (1 - s) / TOKENS) ** 0.5
    return int(np.ceil(np.log(MISS_DEEP) / (np.log1p(-(s**depth)) * s * _trees(percent)))) if s < 1 else 1


def _vertex(s: np.ndarray) -> bytes:
    """128 bits that stand for a whole set; none for the empty one."""
    if not len(s):
        return b""
    h = [mix(s ^ np.uint64(c)).sum() + np.uint64(len(s)) for c in (0x5851F42D4C957F2D, 0x9FB21C651E98DF25)]
    return mix(np.array(h, np.uint64)).tobytes()


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, hs, ts = [], [], []
            for s in shingle_sets(batch.column("text"), size):
                ns.append(len(s))
                hs.append(_vertex(s))
                ts.append(_tokens(s).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(ns, pa.int64()), pa.array(hs, pa.binary()), pa.array(ts, pa.binary())], ["doc_id", "t", "n", "h", "tokens"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    data, offsets = as_bytes(column)
    return data[offsets[0] : offsets[-1]].view(np.uint32).reshape(-1, TOKENS)


def _first_level(trees: int):
    """The node of each set at the first level of each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, v = _matrix(batch.column("tokens")), batch.column("v").to_numpy()
            for tree in range(trees):
                key = mix(m[:, tree * TOKENS // trees].astype(np.uint64) + (np.uint64(tree + 1) << np.uint64(40)))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(v), tree, np.int32)), pa.array(v)], ["key", "tree", "v"])

    return run


def _next_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The node of each set one level deeper: the path so far chooses the next token."""
    for batch in batches:
        m, path = _matrix(batch.column("tokens")), batch.column("key").to_numpy().view(np.uint64)
        chosen = (mix(path ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(TOKENS)).astype(np.int64)
        path = mix(path + m[np.arange(len(m)), chosen].astype(np.uint64) + (chosen.astype(np.uint64) << np.uint64(33)))
        yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), batch.column("tree"), batch.column("v")], ["key", "tree", "v"])


def _sized(nodes: DataFrame) -> DataFrame:
    """nodes (key, tree, v) with their number of sets, n, without those of one set."""
    return checkpoint(nodes.join(nodes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "key"))


def _nodes(sets: DataFrame, percent: int) -> DataFrame:
    """``key, tree, v, n``: the first nodes of all trees, in place of those of more than CROWD sets what they branch into."""
    found = _sized(sets.select("v", "tokens").mapInArrow(_first_level(_trees(percent)), "key long, tree int, v long"))
    nodes, last = found.filter(F.col("n") <= CROWD), found.filter(F.col("n") > CROWD)
    for _ in range(LEVELS):
        if last.isEmpty():
            return nodes
        found = _sized(last.join(sets.select("v", "tokens"), "v").mapInArrow(_next_level, "key long, tree int, v long"))
        nodes, last = nodes.unionByName(found.filter(F.col("n") <= CROWD)), found.filter(F.col("n") > CROWD)
    blocks = F.ceil(F.col("n") / (CROWD // 2))
    block = F.pmod(F.xxhash64("v"), blocks)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda x: F.xxhash64("key", F.least(x, block), F.greatest(x, block)))
    return nodes.unionByName(last.select(F.explode(pairs).alias("key"), "tree", "v", F.lit(CROWD).cast("long").alias("n")))


def _parts(link: np.ndarray) -> np.ndarray:
    """The least member that each row of a symmetric matrix of links reaches."""
    label = np.arange(len(link))
    while True:
        new = np.where(link, label[None, :], len(link)).min(axis=1)
        new = np.minimum(label, new)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _leaves(m: np.ndarray, root: np.ndarray, seed: int, first: bool, node: int) -> Iterator[tuple[int, np.ndarray]]:
    """(depth, rows) of the small nodes that a large one branches into; rows of a single root are left out.

    Of a node that is large even at DEPTH all pairs meet in some leaf; if ``first``, blocks only share PIVOTS rows.
    """
    stack = [(np.arange(len(m)), np.uint64(seed), np.arange(TOKENS), 0)]
    while stack:
        at, path, left, depth = stack.pop()
        if (root[at] == root[at[0]]).all():
            continue
        if len(at) <= node:
            yield depth, at
        elif depth == DEPTH or not len(left):
            at = at[np.argsort(root[at], kind="stable")]
            half = max(1, node // 2)
            parts = [at[i : i + half] for i in range(0, len(at), half)]
            if first:
                yield from ((depth, np.union1d(at[:: -(-len(at) // PIVOTS)], p)) for p in parts)
            else:
                yield from ((depth, np.concatenate((p, q))) for i, p in enumerate(parts) for q in parts[i + 1 :])
        else:
            chosen = int(mix(np.array([path ^ np.uint64(0xA0761D6478BD642F)]))[0] % np.uint64(len(left)))
            token = m[at, left[chosen]]
            order = np.argsort(token, kind="stable")
            cuts = bounds(token[order])
            rest = np.delete(left, chosen)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a > 1:
                    stack.append((at[order[a:b]], mix(np.array([path + np.uint64(token[order[a]])]))[0], rest, depth + 1))


def _linked(m: np.ndarray, n: np.ndarray, root: np.ndarray, percent: int, least: int) -> np.ndarray:
    """Which sets their tokens may link, of those with different roots."""
    same = np.zeros((len(m), len(m)), np.int16)
    for t in range(TOKENS):
        same += m[:, t, None] == m[None, :, t]
    return (root[:, None] != root) & (same >= least) & (100 * np.minimum(n[:, None], n) >= percent * np.maximum(n[:, None], n))


def _likely(percent: int, first: bool, node: int):
    """In each node the groups of sets that their tokens may link; the same group has the same name in every tree.

    Sets of the same root are linked already and not compared.
    """

    def groups_of(m: np.ndarray, n: np.ndarray, root: np.ndarray, key: int) -> Iterator[np.ndarray]:
        """Places of the sets of each group of a node."""
        least = _least(percent)
        if len(m) == 2:
            if root[0] != root[1] and (m[0] == m[1]).sum() >= least and 100 * n.min() >= percent * n.max():
                yield np.arange(2)
            return
        deepest, again = 0, 0
        while True:
            for depth, at in _leaves(m, root, (key + again * 0x9E3779B97F4A7C15) % 2**64, first, node):
                deepest = max(deepest, depth)
                label = _parts(_linked(m[at], n[at], root[at], percent, least))
                yield from (g for x in np.unique(label) if len(g := at[label == x]) > 1)
            again += 1
            if first or not deepest or again >= _repeats(percent, deepest):
                return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key"):
            keys, v, n, root = (table.column(c).to_numpy() for c in ("key", "v", "n", "root"))
            m = _matrix(table.column("tokens"))
            names, members, roots = [], [], []
            at = bounds(keys)
            with np.errstate(over="ignore"):
                for a, b in zip(at[:-1], at[1:], strict=True):
                    for g in groups_of(m[a:b], n[a:b], root[a:b], int(keys[a])) if b - a > 1 else ():
                        g = a + g[np.argsort(v[a + g], kind="stable")]
                        name = mix((mix(v[g].view(np.uint64)) * np.uint64(0x9FB21C651E98DF25)).sum(keepdims=True))
                        names.append(np.repeat(name.view(np.int64), len(g)))
                        members.append(v[g])
                        roots.append(root[g])
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (names, members, roots)], ["name", "v", "root"])

    return run


def _full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("v"), pa.array([s.tobytes() for s in shingle_sets(batch.column("text"), size)], pa.binary())], ["v", "items"])

    return run


def _confirmed(percent: int):
    """Links confirmed on full sets, as many as hold each group together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "name"):
            keys, v, root = (table.column(c).to_numpy() for c in ("name", "v", "root"))
            data, offsets = as_bytes(table.column("items"))
            at, left, right = bounds(keys), [], []
            for a, b in zip(at[:-1], at[1:], strict=True):
                _, which = np.unique(v[a:b], return_index=True)
                rows = [int(a + i) for i in which]
                sets = [data[offsets[i] : offsets[i + 1]].view(np.uint64) for i in rows]
                n = np.array([len(s) for s in sets])
                _, ids = np.unique(np.concatenate(sets), return_inverse=True)
                begin = np.concatenate(([0], np.cumsum(n)[:-1]))
                part, mark = np.unique(root[rows], return_inverse=True)[1], np.zeros(int(ids.max()) + 1, np.int64)
                for i in range(len(rows) - 1):
                    own = ids[begin[i] : begin[i] + n[i]]
                    mark[own] = 1
                    both = np.add.reduceat(mark[ids], begin)
                    mark[own] = 0
                    for j in np.flatnonzero((100 * both >= percent * (n + n[i] - both)) & (part != part[i])):
                        if part[j] != part[i]:
                            left.append(v[rows[i]])
                            right.append(v[rows[j]])
                            low, high = sorted((part[i], part[j]))
                            part[part == high] = low
                    if not part.any():
                        break
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def _labelled(docs: DataFrame, doc_id: str, text: str, size: int, percent: int) -> DataFrame:
    """``doc_id, t, n, root`` for each row of docs: the text's hash, the size of its set, and what stands for its component.

    root is null where a row is linked with nothing by definition: its set is empty or its id null.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("t"))
    base = checkpoint(rows.mapInArrow(_sketches(size), "doc_id long, t binary, n long, h binary, tokens binary"))
    known = base.filter("n > 0 and doc_id is not null")
    # what equal sets have is equal, so whichever row comes first will do; numbers are fixed by the checkpoint
    sets = known.groupBy("h").agg(F.min(F.struct("doc_id", "t")).alias("rep"), F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    sets = checkpoint(sets.select(F.monotonically_increasing_id().alias("v"), "h", "rep.doc_id", "rep.t", "n", "tokens"))
    parts = 2 * n_partitions(docs.sparkSession)

    def links_in(nodes: DataFrame, roots: DataFrame | None) -> DataFrame:
        near = nodes.select("key", "v").join(sets.select("v", "n", "tokens"), "v")
        near = near.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v")) if roots is not None else near.withColumn("root", F.col("v"))
        likely = near.select("key", "v", "root", "n", "tokens").repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_likely(percent, roots is None, NODE), "name long, v long, root long")
        likely = checkpoint(likely.distinct())
        wanted = likely.select("v").distinct().join(sets.select("v", "doc_id", "t"), "v").select("v", F.col("doc_id").alias("__id"), F.col("t").alias("__t"))
        wanted = small_or_not(checkpoint(wanted), F.lit(48))
        # rows that are equal in id and text have the same set
        full = rows.join(wanted, (F.col("doc_id") == F.col("__id")) & (F.col("t") == F.col("__t"))).select("v", "text").mapInArrow(_full_sets(size), "v long, items binary")
        return likely.join(full, "v").select("name", "v", "root", "items").repartition(parts, "name").sortWithinPartitions("name").mapInArrow(_confirmed(percent), "a long, b long")

    nodes = _nodes(sets, percent)
    large = F.col("n") > NODE
    roots = components(links_in(nodes.filter(~large | (F.col("tree") < FIRST)), None))
    nodes = nodes.filter(large & (F.col("tree") >= FIRST))
    if not nodes.isEmpty():
        more = links_in(nodes, roots)
        roots = components(roots.select(F.col("v").alias("a"), F.col("root").alias("b")).unionByName(more))
    labels = sets.select("v", "h").join(roots, "v", "left").select("h", F.coalesce("root", "v").alias("root"))
    out = base.select("doc_id", "t", "n", "h").join(labels, "h", "left")
    return out.select("doc_id", "t", "n", F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: ``doc_id, n_shingles, component_id, kept``.

    A text's set: its distinct ``size``-word shingles, A-Z lower-cased; the whole sequence if it has fewer words; empty
    without words or text. Sets with 100 * intersection >= percent * union are linked, and component_id is the least id
    that links reach. Empty sets are linked with nothing. Equal sets (by 128 bits) are linked, and stand for one vertex,
    so large groups of copies are no burden. Rows without an id are never linked: their component is null and they are
    kept. Rows that repeat an id are copies if their texts are equal, and else count as documents of their own. Ids must
    be whole numbers. An empty table gives no rows.
    """
    rows = checkpoint(_labelled(docs, doc_id, text, size, percent))
    least = rows.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(least, "root", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the least id, and of rows of that id the least text hash.

    Rows without an id all stay; texts without words are linked with nothing; of rows that are equal in id and text one
    stays. A row is told by id and text, so a document that shares its id with a copy stays. Columns pass through.
    """
    found = checkpoint(_labelled(docs, doc_id, text, size, percent))
    grouped = found.filter("root is not null")
    best = checkpoint(grouped.groupBy("root").agg(F.min(F.struct("doc_id", "t")).alias("best")))
    gone = grouped.join(best, "root").filter(F.struct("doc_id", "t") != F.col("best")).select(F.col("doc_id").alias("__id"), F.col("t").alias("__t")).distinct()
    own = F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))
    gone = small_or_not(checkpoint(gone), F.lit(40))
    left = docs.withColumn("__own", own).join(gone, (F.col(doc_id).cast("long") == F.col("__id")) & (F.col("__own") == F.col("__t")), "left_anti")
    if not found.filter("doc_id is not null").groupBy("doc_id", "t").count().filter("count > 1").isEmpty():
        known = left.filter(F.col(doc_id).isNotNull()).dropDuplicates([doc_id, "__own"])
        left = left.filter(F.col(doc_id).isNull()).unionByName(known)
    return left.select(*docs.columns)
