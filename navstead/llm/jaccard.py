"""Exact n-gram Jaccard join by prefix trees, reduced to components.

1. A count-min sketch over all documents' n-grams (fixed size) gives one global order: rare
   n-grams first, then by hash.  Any fixed order is right; the sketch makes prefixes selective.
2. Equal sets form one class; only its smallest doc_id goes on.
3. Similar sets share an n-gram of their prefixes (size - least overlap + 1).  Postings of
   prefixes, cut by size bands, are compared by parity bitmaps whose distance bounds the overlap
   from above, so no similar pair is lost.  What remains forms candidate clusters.
4. Inside a cluster the ordered sets form a prefix tree.  A probe walks it, carries the overlap of
   the shared path and leaves a subtree when the n-grams left cannot reach the least overlap.
5. Clusters over a bound are cut in chunks.  Chunks are joined within themselves first; then only
   sets outside the cluster's largest component meet all others, so a group of near copies is
   connected without its pairs.

Defined cases: no words or null text: empty set, linked with nothing; fewer words than n: the whole
sequence is the only n-gram; a null doc_id links with nothing and has a null component; rows that
repeat a doc_id are one node; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .graph import components
from .marks import with_mark

SLOT_BITS, BLOCK_SLOTS = 20, 1024
CHUNK_SETS, CHUNK_TOKENS, CHUNK_POSTINGS = 1000, 2_000_000, 1024
SEGMENT = 32
EDGES = "a long, b long"


def ngram_hashes(text: str | None, n: int) -> np.ndarray:
    """Distinct 64-bit hashes of the word n-grams of a text, sorted."""
    words = (text or "").encode().lower().split()  # on bytes: ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest(w) for w in words], dtype=np.uint64)
    if len(h) < n:
        return np.array([digest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    mixed = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        mixed = (mixed + h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def slots(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def least_overlap(size: int, percent: int) -> int:
    """Fewest common n-grams with any similar set: 100 * common >= percent * union >= percent * size."""
    return -(-percent * size // 100)


def parity_bits(grams: np.ndarray) -> np.ndarray:
    """Parity of the number of n-grams per bit, at least one bit per two n-grams; 512 bits at least."""
    width = 512
    while width < len(grams):
        width *= 2
    counts = np.bincount((grams & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little")


def order_sketch(docs: DataFrame, n: int) -> np.ndarray:
    """Binary logarithm of the n-gram count per sketch slot, over all documents; 2**SLOT_BITS bytes.

    Tasks pass their counts on in blocks of slots, which are added up block by block.
    """
    blocks = (1 << SLOT_BITS) // BLOCK_SLOTS

    def listed(counts: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(counts) + 1, BLOCK_SLOTS), pa.int32()), pa.array(counts))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(total, slots(ngram_hashes(text.as_py(), n)), 1)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), listed(total)], names=["block", "counts"])

    def added(table: pa.Table) -> pa.Table:
        total = sum(c.flatten().to_numpy().reshape(-1, BLOCK_SLOTS).sum(axis=0) for c in table.column("counts").chunks)
        bits = np.floor(np.log2(np.maximum(total, 1))).astype(np.uint8)
        return pa.table([pa.array([table.column("block")[0].as_py()], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["block", "bits"])

    sums = docs.select("text").mapInArrow(count, "block int, counts array<long>").groupBy("block").applyInArrow(added, "block int, bits binary")
    out = np.zeros((blocks, BLOCK_SLOTS), np.uint8)
    for r in sums.collect():  # bounded by the sketch
        out[r.block] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def ordered(grams: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    return grams[np.argsort(sketch[slots(grams)], kind="stable")]  # equal counts stay in order of hash


def set_table(docs: DataFrame, n: int, percent: int, sketch) -> DataFrame:
    """(doc_id, size, digest, prefix, bits) per document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, prefixes, bits = [], [], [], []
            for text in batch.column(1):
                grams = ngram_hashes(text.as_py(), n)
                sizes.append(len(grams))
                digests.append(xxhash.xxh3_128_digest(grams.tobytes()))
                prefixes.append(ordered(grams, sketch.value)[: len(grams) - least_overlap(len(grams), percent) + 1].view(np.int64) if len(grams) else np.empty(0, np.int64))
                bits.append(parity_bits(grams).tobytes())
            columns = [batch.column(0), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "size", "digest", "prefix", "bits"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, size int, digest binary, prefix array<long>, bits binary")


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component under the edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        after = after[after]
        if np.array_equal(after, label):
            return label
        label = after


def folded(bits: list[bytes], width: int) -> np.ndarray:
    """Bitmaps of one width: halves of a wider one are joined by exclusive or, which keeps parities."""
    out = np.empty((len(bits), width // 8), np.uint64)
    for i, b in enumerate(bits):
        x = np.frombuffer(b, np.uint64)
        while len(x) > width // 8:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[i] = x
    return out


def compatible(sizes: np.ndarray, bits: list[bytes], left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of left and right indices that bitmaps and sizes do not rule out."""
    found_a, found_b = [], []
    width = min(len(b) for b in bits)
    maps = folded(bits, width)
    for i in left:
        total = sizes[i] + sizes[right]
        least = -(-percent * total // (100 + percent))  # common n-grams that the threshold asks for
        ok = right[least <= np.minimum(sizes[i], sizes[right])]
        if len(ok):
            apart = np.bitwise_count(maps[ok] ^ maps[i]).sum(axis=1, dtype=np.int64)
            total = sizes[i] + sizes[ok]
            ok = ok[total - apart >= 2 * -(-percent * total // (100 + percent))]
            found_a.append(np.full(len(ok), i))
            found_b.append(ok)
    none = np.empty(0, np.int64)
    return np.concatenate(found_a or [none]), np.concatenate(found_b or [none])


def grouped_batches(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of one key at a time, from batches sorted by the keys; a group is bounded by its chunk."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        cut = [rest.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cut], axis=0)) + 1
        for a, b in zip(np.r_[0, change[:-1]], change, strict=True) if len(change) else ():
            yield rest.slice(a, b - a)
        rest = rest.slice(change[-1]) if len(change) else rest
    if rest is not None and rest.num_rows:
        yield rest


def stars(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to its component's first node: connected alike, without the pairs."""
    label = local_components(len(ids), a, b)
    inner = np.flatnonzero(label != np.arange(len(ids)))
    return ids[inner], ids[label[inner]]


def edge_batch(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([x[i] for x in found] or [np.empty(0, np.int64)]).astype(np.int64) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def candidate_edges(sets: DataFrame, percent: int) -> DataFrame:
    """Star edges of the candidate graph over classes (row, doc_id, size, prefix, bits), one row per class.

    A band holds sizes within a factor of the threshold; a set is at home in its own and visits the
    next, so every compatible pair meets with at least one of the two at home.  Postings name sets by
    ``row``: a doc_id may be the first of several classes, and what repeats would cancel in a signature.
    """
    tokens = sets.select("row", "size", F.explode("prefix").alias("token"))
    shared = tokens.withColumn("df", F.count("*").over(Window.partitionBy("token"))).where("df > 1")  # postings travel once
    ratio = percent / 100
    band = F.floor(F.log(F.col("size").cast("double")) / -float(np.log(ratio)) + 1e-9).cast("int")
    placed = cut_lineage(shared.withColumn("own", band).select("row", "token", F.explode(F.array(F.struct(F.col("own").alias("band"), F.lit(True).alias("home")), F.struct((F.col("own") + 1).alias("band"), F.lit(False).alias("home")))).alias("x")).select("row", "token", "x.*"))
    buckets = placed.groupBy("token", "band").agg(
        F.count_if("home").alias("homes"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("row", "home")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(7), "home", "row")).alias("s2"),
    ).where("homes > 0 AND n > 1")
    # n-grams of the same sets form the same pairs: one of them is enough
    once = buckets.groupBy("homes", "n", "s1", "s2").agg(F.min(F.struct("token", "band")).alias("k")).select("k.token", "k.band", F.ceil(F.col("n") / CHUNK_POSTINGS).cast("int").alias("chunks"))
    spot = F.pmod(F.xxhash64(F.lit(3), "row"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    posted = placed.join(once, ["token", "band"]).withColumn("mine", spot).withColumn("other", other)
    # chunk i meets chunk j once, in block (low, high)
    posted = posted.select("row", "token", "band", "home", "mine", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))
    rows = posted.join(sets.select("row", "doc_id", "size", "bits"), "row").drop("row")
    keys = ["token", "band", "low", "high"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for t in grouped_batches(batches, keys):
            if t.num_rows < 2:
                continue
            ids, sizes, home, mine = (t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("doc_id", "size", "home", "mine"))
            bits = t.column("bits").to_pylist()
            sizes = sizes.astype(np.int64)
            low, high = t.column("low")[0].as_py(), t.column("high")[0].as_py()
            left = np.flatnonzero(home & (mine == low))
            right = np.flatnonzero(mine == high)
            a, b = compatible(sizes, bits, left, right, percent)
            if low != high:
                c, d = compatible(sizes, bits, np.flatnonzero(home & (mine == high)), np.flatnonzero(mine == low), percent)
                a, b = np.r_[a, c], np.r_[b, d]
            apart = ids[a] != ids[b]
            if apart.any():
                found.append(stars(ids, a[apart], b[apart]))
            if sum(len(x[0]) for x in found) > 100_000:
                yield edge_batch(found)
                found = []
        yield edge_batch(found)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "doc_id").mapInArrow(meet, EDGES)  # one order, so one star


class PrefixTree:
    """Sets in global order as a compressed prefix tree of dense token numbers."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets = sets
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">i8").tobytes())  # these bytes sort as the numbers do
        self.root = self._node(order, 0)

    def _node(self, members: list[int], depth: int) -> tuple:
        """(begin, tokens, sizes' bounds, members that end here, children) of members that agree up to depth."""
        stack: list[tuple] = []
        root = (np.empty(0, np.int64), 0, 0, [], stack)
        todo = [(members, depth, stack)]
        while todo:
            group, d, into = todo.pop()
            at = 0
            while at < len(group):
                first = self.sets[group[at]]
                end = at + 1
                while end < len(group) and len(self.sets[group[end]]) > d and self.sets[group[end]][d] == first[d]:
                    end += 1
                same = group[at:end]
                stop = min(d + SEGMENT, min(len(self.sets[i]) for i in same))
                if len(same) > 1:  # members are sorted: the first and the last differ earliest
                    x, y = self.sets[same[0]][d:stop], self.sets[same[-1]][d:stop]
                    differ = np.flatnonzero(x != y)
                    stop = d + int(differ[0]) if len(differ) else stop
                sizes = [len(self.sets[i]) for i in same]
                leaves, kids = [i for i in same if len(self.sets[i]) == stop], []
                into.append((first[d:stop], min(sizes), max(sizes), leaves, kids))
                inner = [i for i in same if len(self.sets[i]) > stop]
                if inner:
                    todo.append((inner, stop, kids))
                at = end
        return root

    def similar(self, probe: np.ndarray, universe: int, percent: int) -> list[int]:
        """Members similar to the probe, by one walk that shares overlaps along paths."""
        has = np.zeros(universe, bool)
        has[probe] = True
        size, found = len(probe), []
        walk = [(child, 0, 0) for child in self.root[4]]
        while walk:
            (tokens, smallest, largest, leaves, kids), depth, common = walk.pop()
            if 100 * smallest * percent > 10_000 * size or percent * size > 100 * largest:
                continue
            common += int(np.count_nonzero(has[tokens]))
            depth += len(tokens)
            for i in leaves:
                if 100 * common >= percent * (size + depth - common):
                    found.append(i)
            # best case below: every n-gram left is common, and the union keeps what the path has missed
            if kids and 100 * min(common + largest - depth, size) >= percent * (size + depth - common):
                walk.extend((kid, depth, common) for kid in kids)
        return found


def tree_links(sets: list[np.ndarray], built: np.ndarray, probes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Similar (probe, built) index pairs of sets whose tokens are in global order."""
    flat = np.concatenate(sets)
    _, first, dense = np.unique(flat, return_index=True, return_inverse=True)
    parts = np.split(dense.ravel(), np.cumsum([len(s) for s in sets])[:-1])
    tree = PrefixTree([parts[i] for i in built])
    a, b = [], []
    for i in probes:
        near = tree.similar(parts[i], len(first), percent)
        a += [i] * len(near)
        b += near
    return np.array(a, np.int64), built[np.array(b, np.int64)]


def joined_blocks(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Star edges of similar sets within each block; ``built`` sets form the tree, all probe it."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped_batches(batches, keys):
            ids, built = (t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("doc_id", "built"))
            at = np.flatnonzero(built)
            if len(at) and t.num_rows > 1:
                tokens = t.column("tokens").combine_chunks()
                sets = np.split(tokens.flatten().to_numpy(), np.cumsum(tokens.value_lengths().to_numpy())[:-1])
                a, b = tree_links(sets, at, np.arange(len(ids)), percent)
                apart = ids[a] != ids[b]
                yield edge_batch([stars(ids, a[apart], b[apart])])
        yield edge_batch([])

    chosen = rows.select(*keys, "doc_id", "built", "tokens")
    return chosen.repartition(*keys).sortWithinPartitions(*keys, "doc_id").mapInArrow(join, EDGES)


def chunked(rows: DataFrame, group: str) -> DataFrame:
    """``chunks`` per group from its sets and n-grams, and the ``chunk`` of each set."""
    size = F.size("tokens")
    count = rows.groupBy(group).agg(F.greatest(F.ceil(F.count("*") / CHUNK_SETS), F.ceil(F.sum(size) / CHUNK_TOKENS)).cast("int").alias("chunks"))
    return rows.join(count, group).withColumn("chunk", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.col("chunks")).cast("int"))


def cluster_links(rows: DataFrame, percent: int) -> DataFrame:
    """Edges that connect the similar sets of each cluster; rows (cluster, doc_id, tokens)."""
    rows = cut_lineage(chunked(rows, "cluster"))
    every = F.lit(True)
    edges = cut_lineage(joined_blocks(rows.withColumn("built", every), ["cluster", "chunk"], percent))
    wide = rows.where("chunks > 1").drop("chunks", "chunk")
    if wide.isEmpty():
        return edges

    def labelled(found: DataFrame) -> DataFrame:
        label = components(found).withColumnRenamed("node", "doc_id")
        return wide.join(label, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))

    left = None
    while True:  # the first members of the components, chunk by chunk, until they fit one chunk or link no more
        firsts = cut_lineage(chunked(labelled(edges).where("doc_id = component").select("cluster", "doc_id", "tokens"), "cluster"))
        now = firsts.count()
        if left is not None and now > 0.8 * left:
            break
        left = now
        edges = cut_lineage(edges.union(joined_blocks(firsts.withColumn("built", every), ["cluster", "chunk"], percent)))
    part = cut_lineage(labelled(edges))
    largest = part.groupBy("cluster", "component").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max(F.struct("n", "component")).alias("x")).select("cluster", F.col("x.component").alias("main"))
    outside = chunked(part.join(largest, "cluster").where("component <> main").select("cluster", "doc_id", "tokens"), "cluster").withColumnRenamed("chunk", "block")
    blocks = outside.select("cluster", F.col("chunks").alias("blocks")).distinct()
    probing = chunked(wide, "cluster").join(blocks, "cluster").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    width = chunked(wide, "cluster").select("cluster", F.col("chunks").alias("width")).distinct()
    built = outside.join(width, "cluster").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    columns = ["cluster", "chunk", "block", "doc_id", "tokens"]
    both = probing.select(*columns, F.lit(False).alias("built")).union(built.select(*columns, every.alias("built")))
    return edges.union(joined_blocks(both, ["cluster", "chunk", "block"], percent))


def ngram_jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: components of similarity of ``percent`` or more."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = docs.sparkSession.sparkContext.broadcast(order_sketch(texts, n))  # 2**SLOT_BITS bytes
    every = cut_lineage(set_table(texts, n, percent, sketch).withColumn("row", F.monotonically_increasing_id()))
    some = every.where("doc_id IS NOT NULL AND size > 0")
    classes = cut_lineage(some.groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("x")).select("digest", "x.*"))
    sets = some.join(classes.select("row"), "row")
    clusters = components(candidate_edges(sets, percent)).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [ordered(ngram_hashes(x.as_py(), n), sketch.value).view(np.int64) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(grams, pa.list_(pa.int64()))], names=["cluster", "doc_id", "tokens"])

    near = with_mark(texts, clusters).where("_listed").drop("_listed")  # the other texts are not shuffled
    chosen = near.join(clusters, "doc_id").select("cluster", "doc_id", "text")
    links = cluster_links(chosen.mapInArrow(tokens, "cluster long, doc_id long, tokens array<long>"), percent)
    twice = some.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("doc_id")
    member = some.select("doc_id", "digest").join(classes.select("digest", F.col("doc_id").alias("first")), "digest")
    versions = member.join(twice, "doc_id").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))  # rows that repeat a doc_id
    found = components(links.union(versions)).select(F.col("node").alias("first"), "component")
    firsts = classes.select("digest", F.col("doc_id").alias("first")).join(found, "first", "left").select("digest", F.coalesce("component", "first").alias("component"))
    return every.select("doc_id", "size", "digest").join(firsts, "digest", "left").select(
        "doc_id", F.col("size").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("doc_id"))).alias("component_id"),
    )
