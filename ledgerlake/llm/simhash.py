"""Near duplicates by SimHash, with vantage-point trees for the pairs.

Two fingerprints that differ in at most r of 64 bits agree in one of four 16-bit parts but for
r // 4 bits. Each part has a vantage-point tree over its Hamming space. A node splits by distance
from its vantage point; a search for everything within a radius skips a side that the triangle
inequality rules out. Leaves are the shards. A fingerprint stands in its own leaf of each tree and
in the leaves that its ball reaches (those with a higher number; the others come to it), so each
linked pair meets in a leaf, where whole fingerprints are compared.

Why parts: in 64 dimensions nearly all distances from a vantage point lie within 4 of the median,
and a search of radius 4 would visit three quarters of a tree, so nothing would be pruned.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.components import components
from ledgerlake.llm.scratch import drop, written

PARTS, WIDTH = 4, 16
VALUES = 1 << WIDTH
#: Fingerprints drawn to place the splits; what the trees find doesn't depend on the draw.
SAMPLE = 50_000
FINGERPRINTS_PER_LEAF = 256
BLOCK = 8192


def fingerprint(words: list[bytes], shingle: int) -> int:
    """SimHash of lower-cased words: a bit is 1 if it is set in over half of the shingles' hashes."""
    import xxhash

    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hashed(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    return majority(np.array([hashed(joined[s:e], 42) for s, e in spans], dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; zero of none."""
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 16384):
        bits = np.unpackbits(hashes[at : at + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def simhash(text: Column | str, shingle: int = 4) -> Column:
    """Fingerprint, as a signed long, of the words (runs without ASCII white space) of a whole text.

    A to Z are lower-cased. Fewer words than a shingle make one shingle; no words, or a null text,
    make fingerprint zero.
    """

    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        prints = np.empty(len(texts), np.uint64)
        for row, value in enumerate(texts):
            prints[row] = fingerprint((value.as_py() or "").encode("utf-8", "replace").lower().split(), shingle)
        return pa.array(prints.view(np.int64))

    return of(text)


def hex_of(fp: Column | str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


class Tree:
    """A vantage-point tree over all values of a part: the home leaf of each, and the leaves its ball reaches."""

    def __init__(self, drawn: np.ndarray, depth: int, radius: int, seed: int) -> None:
        self.radius, self.rng = radius, np.random.default_rng(seed)
        self.home = np.zeros(VALUES, np.int32)
        self.leaves = 0
        self.reached: list[tuple[np.ndarray, int]] = []
        every = np.arange(VALUES, dtype=np.uint16)
        self._grow(drawn, every, every, depth)
        values = np.concatenate([v for v, _ in self.reached])
        leaves = np.concatenate([np.full(len(v), leaf, np.int32) for v, leaf in self.reached])
        keep = leaves > self.home[values]
        values, leaves = values[keep], leaves[keep]
        order = np.lexsort((leaves, values))
        self.others = leaves[order]
        self.first = np.searchsorted(values[order], np.arange(VALUES + 1))

    def _grow(self, drawn: np.ndarray, own: np.ndarray, visiting: np.ndarray, depth: int) -> None:
        """drawn: the sample's values here; own: all values whose home is below; visiting: those whose ball may reach below."""
        if not len(own):
            return
        if not depth or len(own) == 1:
            self.home[own] = self.leaves
            # The leaf's own check: does a value here lie within the radius at all? A large leaf takes all.
            near = np.full(len(visiting), len(own) > 2048)
            for at in range(0, len(own) if len(own) <= 2048 else 0, 256):
                near |= (np.bitwise_count(visiting[:, None] ^ own[None, at : at + 256]) <= self.radius).any(axis=1)
            self.reached.append((visiting[near], self.leaves))
            self.leaves += 1
            return
        vantage = (drawn if len(drawn) else own)[self.rng.integers(len(drawn) or len(own))]
        of_drawn, of_own, of_visiting = (np.bitwise_count(x ^ vantage).astype(np.int16) for x in (drawn, own, visiting))
        split = int(np.median(of_drawn if len(drawn) else of_own))
        if (of_own <= split).all():
            split -= 1
        self._grow(drawn[of_drawn <= split], own[of_own <= split], visiting[of_visiting - self.radius <= split], depth - 1)
        self._grow(drawn[of_drawn > split], own[of_own > split], visiting[of_visiting + self.radius > split], depth - 1)


def link_leaf(prints: np.ndarray, most: int) -> np.ndarray:
    """For each fingerprint of a leaf the place of the first one of its component there."""
    label = np.arange(len(prints))
    for at in range(0, len(prints), 128):
        close = np.bitwise_count(prints[at : at + 128, None] ^ prints[None, at:]) <= most
        for row in np.flatnonzero(close.sum(axis=1) > 1):
            own = label[at:][close[row]]
            if (own != own[0]).any():
                found = np.unique(own)
                label[np.isin(label, found)] = found[0]
    return label


def near_links(prints: DataFrame, most: int = 4, fingerprints_per_leaf: int = FINGERPRINTS_PER_LEAF, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of `prints` (column fp) whose closure is that of all pairs
    within `most` bits. A leaf gives a star for each of its components, so a dense group of m gives m links.

    A leaf with more than `block` rows is cut into blocks, and each two blocks meet in a group of their own.
    """
    if most // PARTS > 1:
        raise ValueError("at most 7 bits")
    distinct = prints.count()
    drawn = prints.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    depth = min(WIDTH, max(0, math.ceil(math.log2(max(1, distinct / fingerprints_per_leaf)))))
    trees = [
        Tree(((drawn >> np.uint64(WIDTH * p)) & np.uint64(VALUES - 1)).astype(np.uint16), depth, most // PARTS, p) for p in range(PARTS)
    ]
    base = np.cumsum([0, *[t.leaves for t in trees]]).astype(np.int32)
    tables = [(t.home, t.first, t.others) for t in trees]

    def stand(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            shards, rows = [], []
            for p, (home, first, others) in enumerate(tables):
                part = ((fp.view(np.uint64) >> np.uint64(WIDTH * p)) & np.uint64(VALUES - 1)).astype(np.int64)
                n = first[part + 1] - first[part]
                row = np.repeat(np.arange(len(fp)), n)
                within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                shards += [home[part] + base[p], others[first[part][row] + within] + base[p]]
                rows += [np.arange(len(fp)), row]
            shards, rows = np.concatenate(shards), np.concatenate(rows)
            for at in range(0, len(shards), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(shards[at : at + 100_000], pa.int32()), pa.array(fp[rows[at : at + 100_000]], pa.int64())], names=["shard", "fp"])

    standing = written(prints.select("fp").mapInArrow(stand, "shard int, fp bigint"))
    full = standing.groupBy("shard").count().where(F.col("count") > block)
    full = full.select(F.col("shard").alias("large"), F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    dealt = standing.join(full, standing["shard"] == full["large"], "left").drop("large")
    own = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    dealt = dealt.withColumn("own", own).withColumn("other", other)
    dealt = dealt.select("shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")

    def link(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)], axis=1)
            turns = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            cuts = [0, *turns.tolist(), batch.num_rows]
            for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
                if e <= s:
                    continue
                if held and (k or tuple(keys[s]) != held_key):
                    yield from stars(held)
                    held = []
                held_key = tuple(keys[s])
                held.append(batch.column(3).slice(s, e - s))
        if held:
            yield from stars(held)

    def stars(columns):
        fp = np.concatenate([c.to_numpy(zero_copy_only=False) for c in columns])
        if len(fp) > 1:
            label = link_leaf(fp.view(np.uint64), most)
            linked = np.flatnonzero(label != np.arange(len(fp)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[label[linked]])], names=["a", "b"])

    groups = dealt.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j")
    links = written(groups.mapInArrow(link, "a bigint, b bigint"))
    drop(standing)
    return links


def near_components(fingerprints: DataFrame, key: str = "doc_id", most: int = 4) -> DataFrame:
    """(fp, root, component_id): for each fingerprint of a table (key, fp) its component and the least key in that.

    Equal fingerprints are one node from the start, so copies are never paired. A null key is no
    least key; a component of null keys only has a null id. An empty table has no rows.
    """
    nodes = written(fingerprints.groupBy("fp").agg(F.min(key).alias("least")))
    links = near_links(nodes, most)
    roots = written(components(links, "a", "b"))
    drop(links)
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return written(rooted.join(least, "root").select("fp", "root", "component_id"))


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 4, most: int = 4) -> DataFrame:
    """One row of each component of near copies: that with the least key, nulls last, and among rows of that key
    the least by the hash of the row. Rows equal in all columns are one. Texts without words, null ones
    among them, have fingerprint zero and are one group."""
    own = docs.columns
    marked = docs.select("*", simhash(text, shingle).alias("__fp"), F.xxhash64(*[f"`{c}`" for c in own]).alias("__row"))
    prints = written(marked.select(F.col(f"`{key}`").alias("__key"), "__fp", "__row"))
    found = near_components(prints.select(F.col("__key"), F.col("__fp").alias("fp")), "__key", most)
    return least_rows(docs, prints.join(found, prints["__fp"] == found["fp"]), key)


def least_rows(docs: DataFrame, rooted: DataFrame, key: str) -> DataFrame:
    """The first row of each root of `rooted` (__key, __row, root): that with the least key, nulls last, then the least __row."""
    own = docs.columns
    first = F.min(F.struct(F.col("__key").isNull().alias("last"), F.col("__key").alias("key"), F.col("__row").alias("row")))
    keep = written(rooted.groupBy("root").agg(first.alias("first")).select("first.key", "first.row"))
    kept = docs.withColumn("__row", F.xxhash64(*[f"`{c}`" for c in own]))
    kept = kept.join(keep, kept[f"`{key}`"].eqNullSafe(keep["key"]) & (kept["__row"] == keep["row"]), "left_semi")
    return kept.dropDuplicates([key, "__row"]).drop("__row")
