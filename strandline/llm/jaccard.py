"""N-gram Jaccard join over a MinHash LSH forest, with exact verification.

1. A document is the set of hashes of its k-word shingles. Documents with equal sets are one node.
2. Each of `trees` prefix tries has a key for each node: the tree's number and DEEPEST levels of one MinHash byte each,
   in one integer. All keys are sorted, over all tasks, so that a trie's nodes are runs of neighbours with a common prefix.
3. The matched prefix of two neighbours begins at the deepest level and is shortened level by level, as far as the
   nodes' target recall asks for: with prefixes of d levels a pair of similarity s meets in some trie with probability
   1 - (1 - s^d)^trees. That length follows from each node itself: a set of n shingles cannot have every similarity, and
   its least possible one from the threshold on decides. Sets too small to be similar to any other enter no trie.
   Neighbours whose prefix is long enough for either of them are linked to the head of their run; no pairs are made.
   (Lengths that follow from what a node has met so far would not do: tries with many neighbours are those in which
   its copies are met, so that stopping there, or shortening others, loses the pairs that are sought.)
4. Connected components of the links hold all candidate pairs. The sets of a component's nodes are dealt into blocks of
   bounded size, and every pair of blocks is verified exactly in one task, as products of membership matrices: a
   component of any size is spread over many tasks. A task returns each node's number of links and a spanning star of
   what it has linked.
5. The verified links' components are the classes.

Copies of one text that are more than a HOT_SHARE-th of all rows, of which there are fewer than HOT_SHARE, get their
class by broadcast, and rows without words get none, so no task has all rows of a node.

Edge cases: null or empty texts (no words) have no links and are classes of their own; a text of fewer than k
words is one shingle of all its words; rows of one doc_id with other texts are separate nodes, and a null
doc_id is never a class's id unless all its ids are null; repeated rows are copies, linked to each other; an
empty table gives no rows; ``jaccard_join`` reads only the named columns, ``one_of_each`` carries all, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, cut, grams, hash_spans, mix, named, parts, spans, table, tidy
from .components import components

WORDS, THRESHOLD = 5, 0.8
#: Tries, 256 at most, and levels of a key: with the tree's number, eight bytes.
TREES, DEEPEST, RECALL = 40, 7, 0.99999
#: Shingles of a block.
BLOCK = 500_000
#: Nodes with more than a so-manieth of all rows are joined by broadcast: there are fewer than so many.
HOT_SHARE = 1000
#: Up to so many shingles a set's least possible similarity is looked up; above, it is as good as the threshold.
SMALL_SETS = 256


def prefix_depth(similarity: float = THRESHOLD, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL) -> int:
    """The longest prefix with which a pair of this similarity meets in some trie with probability `recall`, shortened level by level."""
    for depth in range(deepest, 0, -1):
        if 1 - (1 - similarity**depth) ** trees >= recall:
            return depth
    return 1


def least_similarity(n: int, threshold: float = THRESHOLD) -> float | None:
    """The least similarity, from the threshold on, that a set of n elements can have with another one that is not equal."""
    found = []
    for gone in range(n):
        new = math.floor((n - gone) / threshold - n + 1e-9)
        if new < 0:
            break
        if gone or new:
            found.append((n - gone) / (n + new))
    return min(found, default=None)


def needs(threshold: float, trees: int, deepest: int, recall: float) -> np.ndarray:
    """Prefix length for sets of 0, 1, ... SMALL_SETS elements and more; 0 for those that are similar to none."""
    out = [0]
    for n in range(1, SMALL_SETS):
        s = least_similarity(n, threshold)
        out.append(0 if s is None else prefix_depth(s, trees, deepest, recall))
    return np.array([*out, prefix_depth(threshold, trees, deepest, recall)], np.int8)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one row's after the other's, and the rows' bounds."""
    n = len(offsets) - 1
    start, end, row = spans(data, offsets)
    words = hash_spans(data, start, end)
    whole = grams(words, k)
    inside = row[: len(whole)] == row[k - 1 :] if len(whole) else np.zeros(0, bool)
    values, own = whole[inside], row[: len(whole)][inside]
    counts = np.bincount(row, minlength=n)
    first = np.cumsum(counts) - counts
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        made = np.array([grams(words[first[i] : first[i] + counts[i]], int(counts[i]))[0] for i in short], np.uint64)
        values, own = np.concatenate([values, made]), np.concatenate([own, short])
    order = np.lexsort((values, own))
    values, own = values[order], own[order]
    if len(values):
        new = np.concatenate([[True], (values[1:] != values[:-1]) | (own[1:] != own[:-1])])
        values, own = values[new], own[new]
    return values, np.searchsorted(own, np.arange(n + 1))


def set_keys(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set; 0 for empty ones."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(0xA5A5A5A5)), dtype=np.uint64)])
    out = mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64))
    return np.where(np.diff(bounds) > 0, np.maximum(out, 1), 0)


def trie_keys(values: np.ndarray, bounds: np.ndarray, trees: int, deepest: int, seed: int = 5) -> np.ndarray:
    """A key for each row with a set (in order) and each tree: the tree, and `deepest` bytes, in the high bytes of an integer."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    out = np.zeros((len(full), trees), np.uint64)
    if not len(full):
        return out
    at = bounds[:-1][full]
    x = (values >> np.uint64(32)).astype(np.uint32)
    draw = np.random.default_rng(seed).integers(1, 1 << 32, (trees, deepest, 2), dtype=np.uint64).astype(np.uint32)
    for t in range(trees):
        out[:, t] = t
        for level in range(deepest):
            hashed = (x ^ draw[t, level, 0]) * (draw[t, level, 1] | np.uint32(1))
            low = np.minimum.reduceat(hashed, at).astype(np.uint64)
            out[:, t] = out[:, t] << np.uint64(8) | mix(low + np.uint64(t * 64 + level)) >> np.uint64(56)
    return out << np.uint64(8 * (7 - deepest))


def nodes_of(docs: DataFrame, k: int, trees: int, deepest: int, need: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """doc_id, node (null without words), n (shingles), need (prefix length), keys (a trie key of each tree, where need is above 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, data, offsets in chunks(batch.column(1)):
                values, bounds = shingle_sets(data, offsets, k)
                node, sizes = set_keys(values, bounds).view(np.int64), np.diff(bounds)
                own = need[np.minimum(sizes, len(need) - 1)]
                made = trie_keys(values, bounds, trees, deepest)[own[sizes > 0] > 0]
                at = np.concatenate([[0], np.cumsum(own > 0)]).astype(np.int32) * trees
                keys = pa.ListArray.from_arrays(pa.array(at), pa.array(made.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(node, mask=sizes == 0), pa.array(sizes, pa.int64()), pa.array(own, pa.int8()), keys], names=["doc_id", "node", "n", "need", "keys"])

    texts = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    return texts.mapInArrow(tidy(run), "doc_id long, node long, n long, need byte, keys array<long>")


def common_levels(keys: np.ndarray) -> np.ndarray:
    """Levels of the common prefix of each key and the next one; -1 for keys of two trees."""
    x = (keys[1:] ^ keys[:-1]).view(np.uint64)
    level = np.full(len(x), -1, np.int64)
    for byte in range(8):
        level += x < np.uint64(1 << 8 * (7 - byte)) if byte < 7 else x == 0
    return level


def forest_links(nodes: DataFrame) -> DataFrame:
    """a, b, level of nodes(node, need, keys): each node linked to the head of a run of neighbours in the sorted tries whose
    common prefixes are as long as one of the two neighbours needs. level: of the prefix that it has in common with the one before it."""
    spark = nodes.sparkSession
    tries = nodes.where("need > 0").select("node", "need", F.explode("keys").alias("key"))
    # The node is part of the order, so that a prefix that a third of all nodes have is spread as well.
    tries = tries.repartitionByRange(parts(spark), "key", "node").sortWithinPartitions("key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, head, last, first = context.partitionId() if context else 0, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            node, need, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "need", "key"))
            if last is None:
                first = (int(node[0]), int(need[0]), int(key[0]))
                node_, need_, key_ = node, need, key
            else:
                node_, need_, key_ = (np.concatenate([[x], y]) for x, y in zip(last, (node, need, key), strict=True))
            level = common_levels(key_)
            joined = level >= np.minimum(need_[1:], need_[:-1])
            start = np.concatenate([[True], ~joined])
            heads = node_[np.flatnonzero(start)][np.cumsum(start) - 1]
            if head is not None:  # the first run goes on with the head that it has
                heads[: int(np.argmin(joined)) + 1 if not joined.all() else len(heads)] = head
            at = np.flatnonzero(joined) + 1
            yield _links(node_[at], heads[at], level[at - 1], part)
            head, last = heads[-1], (node_[-1], need_[-1], key_[-1])
        if last is not None:
            yield _border(part, -1, *first, first[0])
            yield _border(part, -2, *map(int, last), int(head))

    def _links(a, b, level, part):
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(level, pa.int32()), pa.array(np.full(len(a), part), pa.int32()), none, none], names=names)

    def _border(part, kind, node, need, key, head):
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((node, head, kind, part, need, key), (f for f in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())), strict=True)], names=names)

    names = ["a", "b", "level", "part", "need", "key"]
    found = cut(tries.mapInArrow(tidy(run), "a long, b long, level int, part int, need long, key long"))
    # Two rows of each task: where a run goes on in the next task, its heads are linked.
    borders = sorted((r.part, -r.level, r) for r in found.where("level < 0").collect())
    more, before, root = [], None, None
    for _, _, r in borders:
        if r.level == -1:
            if before is not None:
                level = int(common_levels(np.array([before.key, r.key], np.int64))[0])
                if level >= min(before.need, r.need):
                    more.append((r.a, root, level))
        else:
            # A task that is all one run hands the root on.
            first = next(x for p, _, x in borders if p == r.part and x.level == -1)
            goes_on = r.b == first.a and more and more[-1][0] == first.a
            before, root = r, more[-1][1] if goes_on else r.b
    links = found.where("level >= 0").select("a", "b", "level")
    return links.union(spark.createDataFrame(more, "a long, b long, level int")) if more else links


def links_among(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix: which sets of `left` and of `right` (positions) have at least the threshold's Jaccard similarity."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1  # a shingle of one set is in no intersection
    used = np.cumsum(times > 1) - 1
    column, owner = used[column[shared]], owner[shared]
    both = np.zeros((len(left), len(right)), np.float64)
    width = max(1, min(int(used[-1]) + 1 if len(used) else 1, max(256, 24_000_000 // max(1, len(sets)))))
    place = np.argsort(column, kind="stable")
    column, owner = column[place], owner[place]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        both += m[left] @ m[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - both
    return both >= threshold * union - 1e-9


def _spread(linked: np.ndarray) -> np.ndarray:
    """Least position linked to each, over a symmetric matrix."""
    label = np.arange(len(linked))
    while True:
        fresh = np.minimum(label, np.where(linked, label[None, :], len(label)).min(1))
        fresh = fresh[fresh]
        if (fresh == label).all():
            return label
        label = fresh


def verified(sets: DataFrame, threshold: float) -> DataFrame:
    """sets(component, i, j, node, block, copies, items), sorted by component, i and j within partitions: node, hub, links."""

    def group(rows: list) -> pa.RecordBatch:
        rows = list({r[1]: r for r in rows}.values())  # rows of one doc_id may hold a node more than once
        (i, j), sets_ = rows[0][0][1:], [np.frombuffer(r[4], np.uint64) for r in rows]
        node, block, copies = (np.array([r[c] for r in rows], np.int64) for c in (1, 2, 3))
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        hub, links = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        if len(left) and len(right):
            near = links_among(sets_, left, right, threshold)
            if i == j:
                np.fill_diagonal(near, False)
                links[left] = near @ copies[left]
                hub = _spread(near)
            else:
                links[left], links[right] = near @ copies[right], near.T @ copies[left]
                whole = np.zeros((len(rows), len(rows)), bool)
                whole[np.ix_(left, right)] = near
                hub = _spread(whole | whole.T)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[hub]), pa.array(links)], names=["node", "hub", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            cols = [batch.column(c) for c in ("component", "i", "j", "node", "block", "copies", "items")]
            for c, i, j, node, block, copies, items in zip(*(x.to_pylist() for x in cols), strict=True):
                if (c, i, j) != key:
                    if held:
                        yield group(held)
                    held, key = [], (c, i, j)
                held.append((key, node, block, copies, items))
        if held:
            yield group(held)

    return sets.mapInArrow(tidy(run), "node long, hub long, links long")


def classes(docs: DataFrame, threshold: float = THRESHOLD, k: int = WORDS, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """rows(doc_id, node), and facts(node, least_id, copies, class_id, n_links, first) of each node; first: the one node of its class that holds the class's id."""
    spark = docs.sparkSession
    found = cut(nodes_of(docs, k, trees, deepest, needs(threshold, trees, deepest, recall), id_col, text_col))
    rows = found.select("doc_id", "node")
    # Copies differ in no key: they are reduced before anything is shuffled.
    nodes = found.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("need").alias("need"), F.max("keys").alias("keys"))
    nodes = cut(nodes)
    candidates = cut(components(forest_links(nodes).select("a", "b")).join(nodes.select("node", "least_id", "copies", "n"), "node"))
    sizes = candidates.groupBy("component").agg(F.ceil(F.sum("n") / F.lit(block)).cast("int").alias("blocks"))
    placed = candidates.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, data, offsets in chunks(batch.column("text")):
                values, bounds = shingle_sets(data, offsets, k)
                node = pa.array(set_keys(values, bounds).view(np.int64))
                raw = pa.array([values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
                part = batch.slice(first, n)
                out = pa.RecordBatch.from_arrays([part.column("component"), part.column("node"), part.column("blocks"), part.column("block"), part.column("copies"), raw], names=["component", "node", "blocks", "block", "copies", "items"])
                yield out.filter(pa.compute.equal(part.column("node"), node))

    texts = docs.select(named(id_col).cast("long").alias("least_id"), named(text_col).alias("text"))
    # A node is met by its least doc_id, or by itself where all of its doc_ids are null.
    needed = ("component", "node", "blocks", "block", "copies", "text")
    unnamed = with_node(texts.where("least_id IS NULL").select("text"), k, "text").dropDuplicates(["node"])
    whole_texts = texts.join(placed, "least_id").select(*needed).union(unnamed.join(placed.where("least_id IS NULL"), "node").select(*needed))
    sets = whole_texts.mapInArrow(tidy(items), "component long, node long, blocks int, block int, copies long, items binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = sets.withColumn("other", other).select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block", "copies", "items")
    dealt = paired.repartition(parts(spark), "component", "i", "j").sortWithinPartitions("component", "i", "j", "node")
    checked = cut(verified(dealt, threshold))
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(checked.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    whole = linked.join(nodes.select("node", "least_id"), "node")
    least = F.struct(F.col("least_id").isNull(), "least_id", "node")
    heads = whole.groupBy("component").agg(F.min("least_id").alias("class_id"), F.min_by("node", least).alias("head"))
    named_ = whole.join(heads, "component").select("node", "class_id", (F.col("node") == F.col("head")).alias("first"))
    facts = nodes.select("node", "least_id", "copies").join(named_, "node", "left").join(links, "node", "left")
    facts = facts.select("node", "least_id", "copies", F.coalesce("class_id", "least_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("first", F.lit(True)).alias("first"))
    return rows, cut(facts)


def with_node(docs: DataFrame, k: int, text_col: str) -> DataFrame:
    """docs with the column `node` (null without words) before its own."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    schema = T.StructType([T.StructField("node", T.LongType())] + [T.StructField(n, f.dataType) for n, f in zip(names, docs.schema, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, data, offsets in chunks(batch.column(at)):
                values, bounds = shingle_sets(data, offsets, k)
                node = pa.array(set_keys(values, bounds).view(np.int64), mask=np.diff(bounds) == 0)
                yield pa.RecordBatch.from_arrays([node, *batch.slice(first, n).columns], names=["node", *names])

    out = docs.select(*(named(c).alias(n) for c, n in zip(docs.columns, names, strict=True))).mapInArrow(tidy(run), schema)
    return out.select("node", *(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, k: int = WORDS, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, n_links for each row: the least doc_id of its class, and the number of other documents with at
    least the threshold's similarity."""
    rows, facts = classes(docs, threshold, k, trees, deepest, recall, block, id_col, text_col)
    hot_rows = rows.count() // HOT_SHARE
    facts = facts.select("node", "class_id", "n_links", "copies")
    hot, cold = F.broadcast(facts.where(F.col("copies") > hot_rows).drop("copies")), facts.where(F.col("copies") <= hot_rows).drop("copies")
    with_words = rows.where("node IS NOT NULL")
    none = rows.where("node IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    there, others = with_words.join(hot, "node"), with_words.join(hot, "node", "left_anti").join(cold, "node")
    found = there.unionByName(others).select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.col("n_links").cast("long").alias("n_links"))
    return found.unionByName(none)


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, k: int = WORDS, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class, with all its columns: of the least doc_id (null last), of repeated ids the row of the least hash of its
    columns. Rows without words are classes of their own and all stay."""
    _, facts = classes(docs, threshold, k, id_col=id_col, text_col=text_col, **options)
    label = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    firsts = facts.where("first").select("node", label(F.col("least_id")).alias("_label"))
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.select(*(named(c).alias(n) for c, n in zip(docs.columns, names, strict=True)))
    keyed = with_node(plain, k, names[docs.columns.index(text_col)]).withColumn("_label", label(F.col(names[docs.columns.index(id_col)]).cast("long")))
    # By node and id, so that copies of a text are spread; rows that repeat both are told apart below.
    kept = keyed.join(firsts, ["node", "_label"], "left_semi")
    text = names[docs.columns.index(text_col)]
    order = W.partitionBy("node", "_label").orderBy(F.xxhash64(text), F.xxhash64(F.to_json(F.struct(*(n for n in names if n != text)))))
    one = kept.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    every = one.select(*names).union(keyed.where("node IS NULL").select(*names))
    return every.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
u AS (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
g AS (SELECT DISTINCT doc_id, sh FROM u),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE c >= 0.8 * (nx.n + ny.n - c) - 1e-9),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x, min(y) AS class_id FROM r GROUP BY x),
k AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links FROM documents JOIN m ON doc_id = m.x LEFT JOIN k ON doc_id = k.x
"""
