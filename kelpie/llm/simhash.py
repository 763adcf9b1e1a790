"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits; bit i is 1 where it is 1 in over half of the XXH64 values (seed 42) of a text's word
shingles. Fingerprints within the radius r are linked. For the search, position i of a fingerprint gets a nonzero
vector phi(i) of r + 1 bits, and every nonzero vector v gives a mask: the positions with <phi(i), v> = 1 (mod 2).
The phi of r differing positions span at most r dimensions, so some v is orthogonal to them all: under its mask
the pair is equal. So each pair within the radius meets in one of the 2**(r+1) - 1 tables, with certainty.

Scale: fingerprints are collapsed first, so exact copies are one row in the search. A bucket of more than `block`
fingerprints is split into blocks, and each pair of blocks is a group of its own: every pair is still compared,
by bit counts over at most two blocks, and no task holds a larger group. A group gives a spanning forest of its
links, never all pairs. Components come from edges only: up to AT_ONCE of them are grouped in one task, more by
alternating large and small stars.

Defined results: null or empty texts have fingerprint 0 and are linked like any other (similar() links texts without
words to each other only); very long texts are read whole; repeated rows and ties give a row each; a row with a null
id takes part, and its component is the smallest id that is not null; ids have to be integers; an empty table gives
an empty result. Only the id and the text are read, so other columns cannot clash; keep_one() passes them on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.llm.common import cut, integer_id, map_rows, sized, text_or_empty

SEED = 42
STEP = 1 << 15
#: Edges that one task groups: 16 MB of node ids. Below that, rounds of shuffles would be tasks without rows for the most part.
AT_ONCE = 1 << 20


def fingerprint(text: bytes, shingle: int) -> int:
    """Unsigned 64-bit fingerprint. bytes.lower() touches A-Z only and bytes.split() cuts at ASCII white space."""
    words = text.lower().split()
    if not words:
        return 0
    n, hashed = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        some = range(at, min(n, at + STEP))
        h = np.fromiter((hashed(b" ".join(words[i : i + shingle]), SEED) for i in some), "<u8", len(some))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def rows(batch: dict) -> Iterator[tuple]:
        for i, text in zip(batch["doc_id"], batch["text"], strict=True):
            yield i, signed(fingerprint(text, shingle))

    source = docs.select(integer_id(docs, id_col).alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    return map_rows(source, "doc_id long, fp long", rows)


def masks(radius: int, bits: int = 64) -> list[int]:
    """The 2**(radius+1) - 1 covering masks."""
    n = (1 << radius + 1) - 1
    phi = [1 + i % n for i in range(bits)]
    return [signed(sum(1 << i for i in range(bits) if (phi[i] & v).bit_count() & 1)) for v in range(1, n + 1)]


def forest(fp: np.ndarray, block: np.ndarray, node: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Spanning links of one group: within a block if it has one, else between its two blocks."""
    m = len(fp)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
    if block.min() != block.max():
        near &= block[:, None] != block[None, :]
    np.fill_diagonal(near, True)
    label = np.arange(m)
    while True:
        lower = np.where(near, label[None, :], m).min(1)
        lower = np.minimum(lower, lower[lower])
        if (lower == label).all():
            break
        label = lower
    roots = {}
    for k, at in enumerate(label):
        roots.setdefault(int(at), []).append(node[k])
    for members in roots.values():
        least = min(members)
        for other in members:
            if other != least:
                yield least, other


def links(nodes: DataFrame, radius: int = 3, block: int = 512) -> DataFrame:
    """Edges (u, v), u < v, that connect the same nodes as all pairs of nodes (node, fp) within the radius.

    Nodes that are equal in fp should be one row.
    """
    tables = [F.struct(F.lit(t).cast("short").alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m in enumerate(masks(radius))]
    spread = nodes.select("node", "fp", F.explode(F.array(*tables)).alias("b")).select("b.t", "b.key", "node", "fp")
    sizes = spread.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    n_blocks = F.ceil(F.col("n") / block).cast("int")
    met = in_blocks(spread.join(sizes, ["t", "key"]).withColumn("nb", n_blocks), "fp", "node")
    # at most two blocks: a bounded list
    groups = with_block_pairs(met).groupBy("t", "key", "p").agg(F.collect_list(F.struct("fp", "own", "node")).alias("m")).where(F.size("m") > 1)
    x, y = F.col("m")[0], F.col("m")[1]
    # most buckets hold two: built-in functions decide these
    two = groups.where(F.size("m") == 2).where(F.bit_count(x["fp"].bitwiseXOR(y["fp"])) <= radius)
    few = two.select(F.least(x["node"], y["node"]).alias("u"), F.greatest(x["node"], y["node"]).alias("v"))

    def decide(members: pa.StructArray) -> Iterator[tuple[int, int]]:
        fp = members.field("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        return forest(fp, members.field("own").to_numpy(zero_copy_only=False), members.field("node").to_pylist(), radius)

    return few.where("u < v").unionByName(linked(groups.where(F.size("m") > 2), decide)).distinct()


def in_blocks(members: DataFrame, *by: str) -> DataFrame:
    """The members of buckets, each dealt to one, own, of its bucket's nb blocks."""
    return members.withColumn("own", F.when(F.col("nb") > 1, F.pmod(F.xxhash64(*by), F.col("nb"))).otherwise(0).cast("int"))


def with_block_pairs(members: DataFrame) -> DataFrame:
    """A row for each member and each pair p of blocks its block is in."""
    pairs = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda c: F.struct(F.least(c, F.col("own")).alias("i"), F.greatest(c, F.col("own")).alias("j")))
    return members.withColumn("p", F.explode(pairs))


def linked(groups: DataFrame, decide: Callable[[pa.StructArray], Iterator[tuple[int, int]]]) -> DataFrame:
    """The edges (u, v) that decide() finds among the members m of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for m in batch.column("m"):
                for a, b in decide(m.values):
                    u.append(a)
                    v.append(b)
                if len(u) > 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
                    u, v = [], []
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return groups.select("m").mapInArrow(run, "u long, v long")


def with_least(rows: DataFrame, key: str, value: str, n_rows: int) -> DataFrame:
    """The rows with m, the least value of their key.

    Keys with a thousandth of all rows or more, so a thousand at most, are looked up in a broadcast: no task gets all
    rows of such a key.
    """
    many = F.lit(max(256, n_rows // 1000))
    least = rows.groupBy(key).agg(F.min(value).alias("m"), F.count(F.lit(1)).alias("c"))
    hubs = F.broadcast(least.where(F.col("c") >= many).drop("c"))
    return rows.join(hubs, key).unionByName(rows.join(hubs, key, "left_anti").join(least.where(F.col("c") < many).drop("c"), key))


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of the edges, and for each the least node that the edges connect it to."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, up = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        x, y = up[a], up[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[up]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up != up[up]).any():
            up = up[up]


def grouped(edges: DataFrame, at_once: int) -> DataFrame:
    """(node, component): each partition's edges, at_once at a time, as the groups that they connect by themselves."""

    def group(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        nodes, least = least_reached(rows["u"].to_numpy(), rows["v"].to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], ["node", "component"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= at_once:
                yield group(held)
                held, n = [], 0
        if n:
            yield group(held)

    return edges.select("u", "v").mapInArrow(run, "node long, component long")


def components(edges: DataFrame, max_rounds: int = 60, at_once: int = AT_ONCE) -> DataFrame:
    """(node, component) for every node with an edge: component is the smallest node it can reach. A computed (cut) table.

    What a task has of the edges is reduced to its groups first. Up to at_once edges are then grouped in one task;
    more by alternating large and small stars: each round is cut by a reliable checkpoint, and the driver sees one row
    of counts. Partial minima are taken before every shuffle.
    """
    own = grouped(edges.where("u <> v"), max(1, at_once)).where("component < node")
    edges = cut(own.select(F.col("component").alias("u"), F.col("node").alias("v")))
    state, n = None, edges.count()
    if n <= at_once:
        return cut(grouped(edges.coalesce(1), max(1, at_once)))
    edges = cut(edges.distinct())
    for _ in range(max_rounds):
        # large star: every neighbour above a node is hung on the least of its neighbourhood
        both = edges.union(edges.select("v", "u"))
        large = with_least(both, "u", "v", 2 * n).where("v > u").select(F.least("u", "m").alias("u"), "v").where("u <> v").distinct()
        # small star: a node and its lower neighbours are hung on the least of them
        lower = with_least(large, "v", "u", n)
        small = lower.select(F.col("m").alias("u"), F.col("u").alias("v")).union(lower.select(F.col("m").alias("u"), "v")).where("u <> v").distinct()
        edges = cut(small)
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1000003), F.countDistinct("v")).first()
        if seen == state or seen[0] == 0 or (seen[0] == seen[2] and edges.alias("a").join(edges.alias("b"), F.col("a.v") == F.col("b.u"), "left_semi").isEmpty()):
            return cut(edges.select(F.col("v").alias("node"), F.col("u").alias("component")).union(edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()))
        state, n = seen, seen[0]
    raise RuntimeError("the components did not settle")


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row."""
    fps = cut(fingerprints(docs, shingle, id_col, text_col))
    return with_components(fps, radius)


def with_components(fps: DataFrame, radius: int) -> DataFrame:
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")))
    found = components(links(nodes.where("node is not null").select("node", "fp"), radius))
    # a document whose fingerprint nobody shares or is linked to is its own component: only the rest is joined
    known = nodes.join(found, "node", "left").where("n > 1 or component is not null").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(known, "fp", "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


#: The search for similar texts: fingerprints of WORDS x 64 bits over the distinct shingles, in them SEARCHED parts of
#: PART bits, PARTS to a word, and for each part the masks that cover RADIUS. Pairs within SEARCHED * (RADIUS + 1) - 1 = 27
#: of these 140 bits meet with certainty, others by chance: of pairs at a Jaccard similarity of 0.8, which differ in some
#: 21, a share of 0.00005 does not meet (simulated for over 30 shingles; 0.001 for 4 shingles against 5).
WORDS, PARTS, SEARCHED, PART, RADIUS = 3, 3, 7, 20, 3
COVER = masks(RADIUS, PART)
#: Differing bits of linked fingerprints: at a similarity of 0.8 they are 29 of 192 with a deviation of 5, of unrelated
#: texts 96 with a deviation of 7.
NEAR = 54
#: Constants that make further hashes of one: odd multipliers.
MIX = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64) | 1 for k in range(1, WORDS)], np.uint64)


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """The sorted hashes of the distinct word shingles; a shorter text is one shingle, one without words has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    runs = {hashed(b" ".join(words[i : i + shingle])) for i in range(n)}
    return np.sort(np.fromiter(runs, "<u8", len(runs)))


def set_key(own: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(own.tobytes())
    return signed(h >> 64), signed(h & (1 << 64) - 1)


def wide_fingerprint(own: np.ndarray) -> list[int]:
    """The WORDS signed words of a set's fingerprint: SimHash of the hashes, and of further hashes made of them."""
    ones = np.zeros((WORDS, 64), np.int64)
    for at in range(0, len(own), STEP):
        h = own[None, at : at + STEP] * MIX[:, None]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
        for k, x in enumerate((own[at : at + STEP], *h)):
            ones[k] += np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(own), axis=1, bitorder="little").view("<i8")[:, 0].tolist()


def near_in_buckets(bucket: np.ndarray, fp: np.ndarray, most: int) -> np.ndarray:
    """For each place the least place it is connected to by pairs that share a bucket and differ in at most most bits.

    Buckets are runs.
    """
    up = np.arange(len(bucket))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    left, step = np.arange(len(bucket)), 0
    while True:
        step += 1
        left = left[left < len(bucket) - step]
        left = left[bucket[left] == bucket[left + step]]
        near = left[sum(np.bitwise_count(x[left] ^ x[left + step]).astype(np.int16) for x in fp) <= most]
        if len(near):
            near = near[up[near] != up[near + step]]
            for i in near.tolist():
                a, b = root(i), root(i + step)
                up[max(a, b)] = min(a, b)
            while len(near) and (up != up[up]).any():
                up = up[up]
        if not len(left):
            return up


def wide_links(nodes: DataFrame, least: int = 1 << 16) -> DataFrame:
    """Edges (u, v), u < v, that connect the same nodes as all pairs that meet in a table and differ in at most NEAR bits.

    nodes: node, f0, f1, ... A table's buckets are read as runs of sorted rows, some least rows at a time; a bucket's
    fingerprints have to fit a task, their pairs have not.
    """
    words = [f"f{k}" for k in range(WORDS)]
    masked = lambda part: F.transform(F.array(*[F.lit(m) for m in COVER]), lambda m: part.bitwiseAND(m.cast("long")))
    keys = F.concat(*[masked(F.shiftrightunsigned(F.col(words[k // PARTS]), k % PARTS * PART)) for k in range(SEARCHED)])
    spread = nodes.select("node", *words, F.posexplode(keys).alias("t", "key")).select((F.col("t").cast("long") * (1 << PART) + F.col("key")).alias("bucket"), "node", *words)

    def edges(rows: pa.Table) -> pa.RecordBatch:
        bucket, node = rows["bucket"].to_numpy(), rows["node"].to_numpy()
        group = near_in_buckets(bucket, np.stack([rows[f].to_numpy().view(np.uint64) for f in words]), NEAR)
        # the least node of a group is mostly the same in all tables, and so are the edges
        least_node = node.copy()
        np.minimum.at(least_node, group, node)
        u = least_node[group]
        return pa.RecordBatch.from_arrays([pa.array(u[u != node]), pa.array(node[u != node])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, wanted = 0, least
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < wanted:
                continue
            rows = pa.Table.from_batches(held)
            bucket = rows["bucket"].to_numpy()
            last = int(np.searchsorted(bucket, bucket[-1]))
            if last:
                yield edges(rows.slice(0, last))
            # the last run may go on; a long one is not joined again with every batch
            held, n = rows.slice(last).to_batches(), n - last
            wanted = max(least, 2 * n)
        if n:
            yield edges(pa.Table.from_batches(held))

    found = spread.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "u long, v long")
    return found.distinct()


def alike(sets: list[np.ndarray], block: list[int], node: list[int], similarity: float) -> Iterator[tuple[int, int]]:
    """Spanning links of one group by exact Jaccard similarity: within a block if it has one, else between its two.

    Only pairs that are connected already are not compared.
    """
    crossing = len(set(block)) > 1
    left = list(range(len(sets)))
    while left:
        reached = [left.pop()]
        while reached:
            i, rest = reached.pop(), []
            for j in left:
                a, b = sorted((len(sets[i]), len(sets[j])))
                close = not (crossing and block[i] == block[j]) and a >= similarity * b - 1e-9
                if close:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    close = both >= similarity * (a + b - both) - 1e-9
                if close:
                    reached.append(j)
                    yield min(node[i], node[j]), max(node[i], node[j])
                else:
                    rest.append(j)
            left = rest


def similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, block: int = 256, most: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) by Jaccard similarity of word shingles.

    A pair at a similarity of 0.8 over five-word shingles differs in some ten bits of a 64-bit SimHash, far beyond a
    radius that tables can cover. So fingerprints are of WORDS words, and the radius is covered in each of their parts.
    Fingerprints that meet in a table and are near are linked; the components of these links are the candidates, and
    the shingles themselves decide every pair in one. Only members of components have their shingles moved, in blocks
    of about `block` texts and `most` shingles at most.
    """
    source = docs.select(integer_id(docs, id_col).alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))

    def profile(batch: dict) -> Iterator[tuple]:
        for i, text in zip(batch["doc_id"], batch["text"], strict=True):
            own = shingles(text, shingle)
            yield i, *set_key(own), len(own), *wide_fingerprint(own)

    def read(batch: dict) -> Iterator[tuple]:
        for text in batch["text"]:
            own = shingles(text, shingle)
            yield *set_key(own), own.view(np.int64)

    same = ["h1", "h2"]
    words = [f"f{k}" for k in range(WORDS)]
    profiles = cut(map_rows(source, "doc_id long, h1 long, h2 long, size int, " + ", ".join(f"{f} long" for f in words), profile))
    nodes = cut(profiles.groupBy(*same).agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("size", *words)]))
    # texts without words are one node, and similar to nothing else
    near = components(wide_links(nodes.where("node is not null and size > 0").select("node", *words)))
    linked_up = cut(nodes.select("node", *same, "size").join(sized(near, 1 << 26), "node"))
    blocks = linked_up.groupBy("component").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("size") / most)).cast("int").alias("nb"))
    several = linked_up.join(sized(cut(blocks.where("nb > 1")), 1 << 26), "component", "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
    members = in_blocks(several, *same).select(F.col("component").alias("key"), *same, "node", "nb", "own")
    wanted = linked_up.select(F.col("node").alias("doc_id"))
    sets = map_rows(source.join(sized(wanted, 1 << 26), "doc_id", "left_semi"), "h1 long, h2 long, shingles array<long>", read, 256).dropDuplicates(same)
    groups = with_block_pairs(members).join(sets, same).groupBy("key", "p").agg(F.collect_list(F.struct("own", "node", "shingles")).alias("m")).where(F.size("m") > 1)

    def decide(members: pa.StructArray) -> Iterator[tuple[int, int]]:
        own = [x.values.to_numpy(zero_copy_only=False) for x in members.field("shingles")]
        return alike(own, members.field("own").to_pylist(), members.field("node").to_pylist(), similarity)

    found = components(linked(groups, decide).where("u < v"))
    known = cut(nodes.join(sized(found, 1 << 26), "node", "left").where("n > 1 or component is not null").select(*same, F.coalesce("component", "node").alias("component_id")))
    return profiles.select("doc_id", *same).join(sized(known, 1 << 26), same, "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all their columns, without those of a component of similar() but the one with the smallest id.

    Of rows that repeat that id all stay. Rows without an id stay.
    """
    found = similar(docs, shingle, similarity, id_col=id_col, text_col=text_col)
    gone = cut(found.where("doc_id <> component_id").select("doc_id"))
    keyed = docs.select(F.struct("*").alias("doc"), integer_id(docs, id_col).alias("doc_id"))
    return keyed.join(sized(gone, 1 << 26), "doc_id", "left_anti").select("doc.*")
