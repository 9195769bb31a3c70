"""Near-duplicate documents by SimHash fingerprints and BK-trees.

Texts with the same fingerprint are one node from the start. Two fingerprints at most RADIUS bits apart agree on
BLOCKS - RADIUS or more of BLOCKS blocks of bits, so each is put, for every such choice of blocks, in the shard of the
bits it has there: linked fingerprints meet in a shard. A shard's fingerprints form a BK-tree, whose children are keyed
by their Hamming distance to the parent, and all of them are searched for in it together, following only edges whose key
is within the radius of the distance to the node. What a shard gives is a star for each of its linked groups, not
all pairs; stars are then joined to components.

The trees are not broadcast from the driver: together they hold the fingerprints of all documents, which may not be
gathered there and have no bound. The shuffle brings each tree the queries of its shard instead. A shard with
more than SHARD_MOST fingerprints is sharded again, RESHARD times at most, by its other bits: cut into one block more than the
radius, linked fingerprints agree on one of these too, so nothing is lost. What is still too large, being alike in nearly all bits, is
cut into parts, and each pair of parts is a shard of its own: a tree of one part searched for the fingerprints of the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_names, join_few, join_unique, map_texts
from .components import connected_components

SHINGLE, SEED, RADIUS, BLOCKS = 4, 42, 4, 6
SHARD_MOST, RESHARD = 8192, 2

_BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.float64)


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of the word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = len(words)
    if n <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: n - shingle + 1]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bits set in over half the hashes, as a signed 64-bit number; 0 for a text without words."""
    h = shingle_hashes(text, shingle)
    if not len(h):
        return 0
    parts = h.view(np.uint8).reshape(-1, 8)
    if len(h) < 64:
        ones = np.unpackbits(parts, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(parts[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


def _make():
    return lambda texts: ((fingerprint(t),) for t in texts)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints: single words, or rows of words."""
    d = np.bitwise_count(a ^ b)
    return d.sum(-1, dtype=np.int64) if a.ndim > 1 else d.astype(np.int64)


class BKTree:
    """A BK-tree of distinct fingerprints (words, or rows of words) under Hamming distance."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.nodes: list[tuple[int, list[tuple[int, int]]]] = []  # a fingerprint's number; (distance, child) for each child
        todo = [(np.arange(len(prints)), None, 0)] if len(prints) else []
        while todo:
            members, parent, key = todo.pop()
            number, root, rest = len(self.nodes), int(members[0]), members[1:]
            self.nodes.append((root, []))
            if parent is not None:
                self.nodes[parent][1].append((key, number))
            if len(rest):
                d = distance(prints[rest], prints[root])
                order = np.argsort(d, kind="stable")
                for part in np.split(rest[order], np.flatnonzero(np.diff(d[order])) + 1):
                    todo.append((part, number, int(distance(prints[part[:1]], prints[root])[0])))

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each fingerprint that has queries within radius: its number and theirs."""
        todo = [(0, np.arange(len(queries)))] if self.nodes else []
        while todo:
            number, asked = todo.pop()
            root, children = self.nodes[number]
            d = distance(queries[asked], self.prints[root])
            near = asked[d <= radius]
            if len(near):
                yield root, near
            for key, child in children:
                if len(part := asked[np.abs(d - key) <= radius]):
                    todo.append((child, part))


class Groups:
    """Which of n things are linked; things are joined many at a time."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, members: np.ndarray) -> None:
        own = self.of[members]
        least = own.min()
        if (own != least).any():
            self.of[np.isin(self.of, own)] = least


def linked(prints: np.ndarray, role: np.ndarray, radius: int, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A star for each group of two or more that links of radius make: the places of (members, centres).

    role 0 all: each fingerprint is searched for among all. Else those of role 1 among those of role -1. Pairs whose rows
    of seen agree anywhere are no links.
    """
    trees, asked = (np.flatnonzero(role < 0), np.flatnonzero(role > 0)) if role.any() else (np.arange(len(prints)),) * 2
    groups = Groups(len(prints))
    for root, near in BKTree(prints[trees]).search(prints[asked], radius):
        if seen is not None:
            near = near[~(seen[asked[near]] == seen[trees[root]]).any(1)]
        groups.join(np.append(asked[near], trees[root]))
    rest = np.flatnonzero(groups.of != np.arange(len(prints)))
    return rest, groups.of[rest]


def block_masks(blocks: int, radius: int) -> list[int]:
    """Masks of the bits of each choice of blocks - radius blocks."""
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    own = [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(x) for x in combinations(own, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def finer_masks(mask: int, pieces: int) -> list[int]:
    """mask with, in turn, each of as many pieces of the bits that it lacks."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [round(len(free) * k / pieces) for k in range(pieces + 1)]
    return [mask | sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]


def large_shards(keyed: DataFrame, shard_most: int) -> DataFrame:
    """shard and n of the shards with more rows than shard_most."""
    return checkpointed(keyed.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > shard_most))


def links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard_most: int = SHARD_MOST) -> DataFrame:
    """Edges a, b that connect all of the distinct fingerprints fp within radius of each other."""
    masks = block_masks(blocks, radius)
    literal = lambda ms: F.array(*[F.lit(_signed(m)) for m in ms])
    keyed = prints.select("fp", F.posexplode(literal(masks)).alias("way", "mask")).select("fp", "way", F.xxhash64("way", F.col("fp").bitwiseAND(F.col("mask"))).alias("shard"))
    done: list[DataFrame] = []
    for level in range(1, RESHARD + 1):
        large = large_shards(keyed, shard_most)
        if large.isEmpty():
            break
        masks = [f for m in masks for f in finer_masks(m, radius + 1)]
        marked = checkpointed(join_few(keyed, large, "shard"))
        done.append(marked.where("n IS NULL").select("fp", "shard"))
        ways = F.transform(F.sequence(F.lit(0), F.lit(radius)), lambda k: F.col("way") * (radius + 1) + k)
        keyed = marked.where("n IS NOT NULL").select("fp", F.explode(ways).alias("way"))
        keyed = keyed.select("fp", "way", F.xxhash64(F.lit(level), "way", F.col("fp").bitwiseAND(F.get(literal(masks), F.col("way")))).alias("shard"))
    keyed = reduce(DataFrame.unionByName, done, keyed.select("fp", "shard"))
    return shard_links(keyed.select("shard", F.col("fp").alias("node"), F.array("fp").alias("bits")), 1, radius, shard_most)


def units_of(keyed: DataFrame, shard_most: int) -> DataFrame:
    """keyed (shard, node and more) with role: 0 in a shard to search whole; a larger shard is cut, and in each pair of parts -1 is the tree's and 1 the queries'."""
    large = large_shards(keyed, shard_most)
    more = [c for c in keyed.columns if c not in ("shard", "node")]
    units = keyed.select("shard", "node", F.lit(0).alias("role"), *more)
    if not large.isEmpty():
        parts = large.select("shard", F.ceil(F.col("n") / shard_most).cast("int").alias("parts"))
        dealt = join_few(keyed, parts, "shard").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.expr("cast(pmod(xxhash64(node, 7), parts) as int)"))
        pairs = dealt.select("node", *more, "shard", "parts", "part", F.explode(F.expr("sequence(0, parts - 1)")).alias("other"))
        name = F.when(F.col("parts") == 1, F.col("shard")).otherwise(F.xxhash64("shard", F.least("part", "other"), F.greatest("part", "other")))
        units = pairs.select(name.alias("shard"), "node", F.signum(F.col("part") - F.col("other")).cast("int").alias("role"), *more)
    return units


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of rows sorted by the first of them, in runs that hold all rows of each of its values."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in names)
        if held is not None:
            rows = tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        if last:
            yield tuple(x[:last] for x in rows)
        held = tuple(x[last:].copy() for x in rows)
    if held is not None:
        yield held


def shard_links(keyed: DataFrame, words: int, radius: int, shard_most: int = SHARD_MOST) -> DataFrame:
    """Edges a, b between nodes that connect all within radius of each other in some shard. keyed: shard, node, bits (array of words)."""
    units = units_of(keyed, shard_most)
    flat = units.select("shard", "node", "role", *[F.get("bits", F.lit(k)).alias(f"w{k}") for k in range(words)])
    names = flat.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shard. role: 0 tree and query, -1 tree, 1 query."""

        def give(shard: np.ndarray, node: np.ndarray, role: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]))
            sizes = np.diff(cuts)
            pairs = cuts[:-1][sizes == 2]
            near = distance(prints[pairs], prints[pairs + 1]) <= radius  # a tree of a root and one edge
            out = [(node[pairs[near]], node[pairs[near] + 1])]
            for k in np.flatnonzero(sizes > 2):
                s = slice(cuts[k], cuts[k + 1])
                members, centres = linked(prints[s], role[s], radius)
                out.append((node[s][members], node[s][centres]))
            a, b = (np.concatenate([x[i] for x in out]) for i in range(2))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for shard, node, role, *bits in whole_groups(batches, names):
            yield give(shard, node, role, bits[0].view(np.uint64) if words == 1 else np.stack(bits, axis=1).view(np.uint64))

    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return flat.repartition(n, "shard").sortWithinPartitions("shard", "node").mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """id_col, fp (the fingerprint, signed) and component_id (the least id reachable by links), for each row of df.

    Null and empty texts have fingerprint 0, which is linked like any other. Rows with a null id are linked too; if a
    component has no other rows its component_id is null. Rows that share an id are rows of their own.
    """
    docs = checkpointed(map_texts(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", _make, "fp long"))
    prints = checkpointed(docs.groupBy("fp").agg(F.min("id").alias("first")))
    classes = component_firsts(prints.withColumnRenamed("fp", "node"), links(prints.select("fp"), radius)).withColumnRenamed("node", "fp")
    return join_unique(docs, classes, "fp", docs.count()).select(F.col("id").alias(id_col), "fp", F.col("least").alias("component_id"))


def component_firsts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and least (the least `first` of its component) for each row of nodes (node, first). Components, and groups of copies, may be of any size."""
    found = connected_components(edges)
    labelled = checkpointed(nodes.join(found, "node", "left").select("node", "first", F.coalesce("label", "node").alias("label")))
    least = labelled.groupBy("label").agg(F.min("first").alias("least"))
    return join_unique(labelled, least, "label", labelled.count()).select("node", "least")


# -- near copies by similarity -------------------------------------------------------------------------------------------

#: Near copies are texts whose sets of five-word shingles have a similarity (Jaccard) of COPY_SIMILARITY hundredths or more.
COPY_SHINGLE, COPY_SIMILARITY = 5, 80
#: 256 bits in 4 words. Candidates are taken within SEARCH_RADIUS and then compared exactly. At 0.8 the cosine is 0.89, which makes
#: 39 bits differ, give or take 6; with four and five shingles 48.
COPY_WORDS, SEARCH_RADIUS = 4, 80
#: Anchors of a text: the least of its shingle hashes under as many mixings. Two texts of similarity 0.8 share one but for 0.2 ** 6.
#: A shard of one anchor that is too large is sharded again by as many others.
ANCHORS = 6
_MIX = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64) | 1 for k in range(2 * ANCHORS)], np.uint64)


def copy_hashes(text: bytes) -> np.ndarray:
    """A row of 8 * COPY_WORDS bytes for each distinct shingle. A text of fewer than five words has one shingle; one without words none."""
    words = text.lower().split()
    if not words:
        return np.zeros((0, 8 * COPY_WORDS), np.uint8)
    n = len(words)
    joined = b" ".join(words)
    if n <= COPY_SHINGLE:
        pieces = [joined]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: n - COPY_SHINGLE + 1]
        pieces = [joined[a:b] for a, b in zip(starts.tolist(), ends[COPY_SHINGLE - 1 :].tolist(), strict=True)]
    pieces = list(set(pieces))  # similarity is of sets
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(p, 1) + digest(p, 2) for p in pieces]), np.uint8).reshape(len(pieces), 8 * COPY_WORDS)


def shingle_set(h: np.ndarray) -> np.ndarray:
    """The shingles' first words, sorted."""
    return np.sort(np.ascontiguousarray(h[:, :8]).view(np.uint64)[:, 0])


def _print_of(h: np.ndarray) -> tuple[list[int], list[int]]:
    if not len(h):
        return [0] * COPY_WORDS, []
    if len(h) < 64:
        ones = np.unpackbits(h, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(h[:, k], minlength=256) @ _BITS for k in range(h.shape[1])])
    bits = np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)
    first = np.ascontiguousarray(h[:, :8]).view(np.uint64)[:, 0]
    mixed = (first[:, None] ^ (first[:, None] >> np.uint64(29))) * _MIX
    return bits.tolist(), (mixed ^ (mixed >> np.uint64(32))).min(0).view(np.int64).tolist()


def copy_print(text: bytes) -> tuple[list[int], list[int]]:
    """(four words of the 256-bit fingerprint, anchors), signed. A text without words has no anchors."""
    return _print_of(copy_hashes(text))


def _make_copies():
    def work(texts: list[bytes]):
        for t in texts:
            h = copy_hashes(t)
            yield *_print_of(h), _signed(xxhash.xxh64_intdigest(shingle_set(h).tobytes())), _signed(xxhash.xxh64_intdigest(t, 42))

    return work


def _make_sets():
    def work(texts: list[bytes]):
        for t in texts:
            s = shingle_set(copy_hashes(t)).tobytes()
            yield _signed(xxhash.xxh64_intdigest(s)), s

    return work


def alike(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the other sets are near copies of the first. All are sorted and not empty."""
    sizes = np.array([len(x) for x in others])
    flat = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    both = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
    return 100 * both >= COPY_SIMILARITY * (len(one) + sizes - both)


def copies_among(prints: np.ndarray, role: np.ndarray, sets: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """As linked, but links are the pairs within radius that are alike; pairs already in one group are not compared."""
    groups, sizes = Groups(len(prints)), np.array([len(x) for x in sets])
    cut = bool(role.any())
    for root in np.flatnonzero(role < 0) if cut else range(len(prints)):
        asked = np.flatnonzero((role > 0) & (groups.of != groups.of[root])) if cut else root + 1 + np.flatnonzero(groups.of[root + 1 :] != groups.of[root])
        least, most = np.minimum(sizes[asked], sizes[root]), np.maximum(sizes[asked], sizes[root])
        asked = asked[100 * least >= COPY_SIMILARITY * most]
        asked = asked[distance(prints[asked], prints[root]) <= radius]
        if len(asked) and (same := alike(sets[root], [sets[k] for k in asked])).any():
            groups.join(np.append(asked[same], root))
    rest = np.flatnonzero(groups.of != np.arange(len(prints)))
    return rest, groups.of[rest]


def copy_candidates(prints: DataFrame, radius: int, shard_most: int) -> DataFrame:
    """unit, node and role: nodes that links of radius join in a shard of one anchor. A pair meets in the shard of the first anchor that it shares.

    prints: node, bits, anchors.
    """
    first, finer = F.slice("anchors", 1, ANCHORS), F.slice("anchors", ANCHORS + 1, ANCHORS)
    keyed = prints.select("node", "bits", first.alias("anchors"), F.posexplode(first).alias("k", "anchor")).select(F.xxhash64("k", "anchor").alias("shard"), "node", "k", "bits", "anchors")
    large = large_shards(keyed, shard_most)
    if not large.isEmpty():
        marked = checkpointed(join_few(keyed, large, "shard"))
        again = marked.where("n IS NOT NULL").drop("n").join(prints.select("node", F.posexplode(finer).alias("j", "anchor")), "node")
        keyed = marked.where("n IS NULL").drop("n").unionByName(again.withColumn("shard", F.xxhash64("shard", "j", "anchor")).drop("j", "anchor"))
    part = lambda c, name, n: [F.get(c, F.lit(k)).alias(f"{name}{k}") for k in range(n)]
    flat = units_of(keyed, shard_most).select("shard", "node", "role", "k", *part("bits", "w", COPY_WORDS), *part("anchors", "a", ANCHORS))
    names = flat.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, node, role, at, *words in whole_groups(batches, names):
            prints, anchors = np.stack(words[:COPY_WORDS], axis=1).view(np.uint64), np.stack(words[COPY_WORDS:], axis=1)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]))
            sizes = np.diff(cuts)
            pairs = cuts[:-1][sizes == 2]
            met = ((anchors[pairs] == anchors[pairs + 1]) & (np.arange(ANCHORS) < at[pairs][:, None])).any(1)
            pairs = pairs[~met & (distance(prints[pairs], prints[pairs + 1]) <= radius)]
            out = [(np.concatenate([pairs, pairs + 1]), np.concatenate([pairs, pairs]))]
            for k in np.flatnonzero(sizes > 2):
                s = slice(cuts[k], cuts[k + 1])
                members, centres = linked(prints[s], role[s], radius, anchors[s, : at[cuts[k]]])
                ends = np.unique(centres)
                out.append((cuts[k] + np.concatenate([members, ends]), cuts[k] + np.concatenate([centres, ends])))
            members, centres = (np.concatenate([x[i] for x in out]).astype(np.int64) for i in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shard[members], node[centres], node[members], role[members])], names=["shard", "centre", "node", "role"])

    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = flat.repartition(n, "shard").sortWithinPartitions("shard", "node").mapInArrow(run, "shard long, centre long, node long, role int")
    return found.select(F.xxhash64("shard", "centre").alias("unit"), "node", "role")


def copy_links(units: DataFrame, radius: int) -> DataFrame:
    """Edges a, b that connect the near copies of each unit. units: unit, node, role, bits, shingles (a sorted set, as bytes)."""
    flat = units.select("unit", "node", "role", "shingles", *[F.get("bits", F.lit(k)).alias(f"w{k}") for k in range(COPY_WORDS)])
    names = flat.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, node, role, sets, *words in whole_groups(batches, names):
            prints = np.stack(words, axis=1).view(np.uint64)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(unit)) + 1, [len(unit)]))
            out = [(node[:0], node[:0])]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b - a > 1:
                    members, centres = copies_among(prints[a:b], role[a:b], [np.frombuffer(x, np.uint64) for x in sets[a:b]], radius)
                    out.append((node[a:b][members], node[a:b][centres]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out])) for i in range(2)], names=["a", "b"])

    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return flat.repartition(n, "unit").sortWithinPartitions("unit", "node").mapInArrow(run, "a long, b long")


def copy_classes(df: DataFrame, id_col: str, text_col: str, radius: int, shard_most: int) -> tuple[DataFrame, DataFrame]:
    """docs (id, key: a hash of the text, node: one of its set of shingles) for each row of df, and node and least (the least id and key of its group)."""
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    docs = checkpointed(map_texts(source, "id", "text", _make_copies, "bits array<long>, anchors array<long>, node long, key long"))
    prints = docs.groupBy("node").agg(F.min(F.struct("id", "key")).alias("first"), F.min("bits").alias("bits"), F.min("anchors").alias("anchors"))
    prints = checkpointed(prints)
    units = checkpointed(copy_candidates(prints.select("node", "bits", "anchors"), radius, shard_most))
    asked = prints.join(units.select("node").distinct(), "node", "left_semi")
    # one text of each node: that of its least id, so that many copies don't meet; rows that share id and text give one set
    wanted = asked.select("node", F.col("first.id").alias("w_id"), F.col("first.key").alias("w_key"))
    keyed = source.withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    named = checkpointed(docs.select("id", "key", "node").distinct().join(wanted, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("key") == F.col("w_key")), "left_semi"))
    texts = keyed.join(named.select(F.col("id").alias("w_id"), F.col("key").alias("w_key")), F.col("id").eqNullSafe(F.col("w_id")) & (F.col("key") == F.col("w_key")), "left_semi").dropDuplicates(["id", "key"])
    sets = map_texts(texts, "key", "text", _make_sets, "node long, shingles binary").select("node", "shingles").dropDuplicates(["node"])
    edges = copy_links(units.join(asked.select("node", "bits"), "node").join(sets, "node"), radius)
    return docs, component_firsts(prints.select("node", "first"), edges)


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = SEARCH_RADIUS, shard_most: int = SHARD_MOST) -> DataFrame:
    """id_col and component_id for each row of df: texts whose sets of five-word shingles have a similarity of 0.8 or more are linked.

    As near_duplicates, with what a radius of four bits in 64 is too small for. Texts with the same set are one node. Candidates
    are pairs within radius in 256 bits, found by BK-trees in shards of texts that share an anchor, a shingle whose hash is
    least. Only their shingles are then brought together, and each link is a similarity counted exactly. Texts without words
    (null and empty ones among them) are all linked. Rows that share an id are rows of their own; a null id is a group's only if it has no other.
    A pair at 0.8 shares no anchor once in 16,000 times; it is more than radius apart far less often.
    """
    docs, classes = copy_classes(df, id_col, text_col, radius, shard_most)
    return join_unique(docs.select("id", "node"), classes, "node", docs.count()).select(F.col("id").alias(id_col), F.col("least.id").alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each group of near copies: that with the least id, and of several texts with that id one of them.

    Different texts with the same id stay, unless they are near copies. Rows that share id and text are copies like others: one stays. Rows with a null id all stay.
    """
    docs, classes = copy_classes(df.select(id_col, text_col).where(F.col(id_col).isNotNull()), id_col, text_col, SEARCH_RADIUS, SHARD_MOST)
    i, k = free_names(df, "kept_id", "kept_key")
    kept = classes.select(F.col("least.id").alias(i), F.col("least.key").alias(k)).distinct()
    key = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = df.where(F.col(id_col).isNotNull())
    rows = rows.join(kept, (rows[id_col] == kept[i]) & (key == kept[k]))
    return rows.dropDuplicates([i, k]).select(*[rows[c] for c in df.columns]).unionByName(df.where(F.col(id_col).isNull()))
