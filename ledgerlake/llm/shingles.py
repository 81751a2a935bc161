"""Near copies by the Jaccard similarity of word shingles: SimHash fingerprints and MinHash bands for the candidates,
whole shingle sets for the links.

A document is the set of its shingles' hashes; equal sets are one node. The SimHash fingerprints of the
sets meet in vantage-point trees (`simhash.near_links`), and what hangs together within BITS bits is one
bucket. At a similarity of 0.8 two fingerprints differ in some ten bits, more than the trees find, so a
node also stands in one bucket for each of BANDS groups of ROWS min-hashes. Two sets of similarity s share
one of these but for a chance of (1 - s^ROWS)^BANDS, which is 4 in a million at 0.8 and less above. Buckets
with the same members are one. In a bucket, sets are compared whole, so every link holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm import simhash
from ledgerlake.llm.components import components
from ledgerlake.llm.scratch import drop, written

BANDS, ROWS = 24, 4
#: Bits within which fingerprints meet: the most that the trees over 16-bit parts find.
BITS = 7
#: Shingles of a block: a bucket with more is cut into blocks, and each two blocks meet in a group of their own.
BLOCK = 400_000
#: A table of up to so many longs travels to all tasks.
BROADCAST = 1_000_000

_DRAWN = np.random.default_rng(8)
FACTORS = _DRAWN.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
SHIFTS = _DRAWN.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64)
MIX = _DRAWN.integers(0, 2**64, (BANDS, ROWS), np.uint64) | np.uint64(1)
OWN = _DRAWN.integers(0, 2**64, BANDS, np.uint64)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted hashes of the shingles of a whole text. Words are runs without ASCII white space, A to Z are
    lower-cased; fewer words than a shingle make one shingle, no words make none."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([hashed(joined, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    return np.unique(np.array([hashed(joined[s:e], 42) for s, e in spans], np.uint64))


def band_keys(own: np.ndarray) -> np.ndarray:
    """One number for each band of a set; none for the empty set."""
    if not len(own):
        return np.empty(0, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 1024):
        np.minimum(least, (own[at : at + 1024] * FACTORS + SHIFTS).min(axis=1), out=least)
    mixed = (least.reshape(BANDS, ROWS) * MIX).sum(axis=1, dtype=np.uint64) + OWN
    return mixed ^ (mixed >> np.uint64(31))


def node_of(own: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(own.tobytes(), 42) if len(own) else 0


def sketch(text: Column | str, shingle: int) -> Column:
    """(node, size, fp, bands) of a text: the hash of its set, the size of that, its fingerprint, and its band keys."""

    @F.arrow_udf("struct<node: bigint, size: int, fp: bigint, bands: array<bigint>>")
    def of(texts: pa.Array) -> pa.Array:
        nodes, prints, sizes, bands = np.empty(len(texts), np.uint64), np.empty(len(texts), np.uint64), np.empty(len(texts), np.int32), []
        for row, value in enumerate(texts):
            own = shingle_set(value.as_py(), shingle)
            nodes[row], sizes[row], prints[row] = node_of(own), len(own), simhash.majority(own)
            bands.append(band_keys(own).view(np.int64))
        ends = np.cumsum([0, *map(len, bands)]).astype(np.int32)
        flat = np.concatenate([np.empty(0, np.int64), *bands])
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
        return pa.StructArray.from_arrays([pa.array(nodes.view(np.int64)), pa.array(sizes), pa.array(prints.view(np.int64)), lists], names=["node", "size", "fp", "bands"])

    return of(text)


def link_sets(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set the place of the first one of its component; links are pairs with that Jaccard similarity or more."""
    label, sizes = np.arange(len(sets)), np.array([len(s) for s in sets])
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum([0, *sizes])
    marked = np.zeros(len(names), bool)
    for row in range(len(sets) - 1):
        # The smaller of two sets has at least that share of the larger; what is linked already needs no test.
        most, least = np.maximum(sizes[row], sizes[row + 1 :]), np.minimum(sizes[row], sizes[row + 1 :])
        if not ((label[row + 1 :] != label[row]) & (least >= similarity * most - 1e-6)).any():
            continue
        own = ids[starts[row] : starts[row + 1]]
        marked[own] = True
        both = np.add.reduceat(marked[ids[starts[row + 1] :]], starts[row + 1 : -1] - starts[row + 1], dtype=np.int64)
        marked[own] = False
        near = row + 1 + np.flatnonzero(both / (sizes[row] + sizes[row + 1 :] - both) >= similarity)
        found = np.unique(label[[row, *near]])
        if len(found) > 1:
            label[np.isin(label, found)] = found[0]
    return label


def _travels(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST else df


def fingerprint_buckets(nodes: DataFrame) -> DataFrame:
    """(node, size, bucket) of nodes (node, size, fp) whose fingerprint hangs together with another one, or is another node's too."""
    prints = written(nodes.where("size > 0").groupBy("fp").agg(F.count(F.lit(1)).alias("n")))
    links = simhash.near_links(prints, BITS)
    roots = written(components(links, "a", "b"))
    drop(links)
    met = prints.join(roots, prints["fp"] == roots["node"], "left").where("n > 1 OR root IS NOT NULL")
    met = written(met.select(F.col("fp").alias("own"), F.xxhash64(F.coalesce("root", "fp"), F.lit("fingerprint")).alias("bucket")))
    drop(prints)
    drop(roots)
    found = written(nodes.where("size > 0").join(_travels(met), F.col("fp") == F.col("own")).select("node", "size", "bucket"))
    drop(met)
    return found


def near_links(docs: DataFrame, nodes: DataFrame, text: str, shingle: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between nodes whose closure is that of all similar pairs that share a bucket. A group gives
    a star for each of its components, so m near copies give m links for a bucket.

    docs: texts with __row; nodes: (node, size, fp, bands, row), where row names a document with that set.
    """
    alike = fingerprint_buckets(nodes)
    standing = alike.unionByName(nodes.select("node", "size", F.explode("bands").alias("bucket")))
    members = standing.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("size").cast("bigint")).alias("shingles"), F.min("node").alias("lo"), F.max("node").alias("hi"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sign"),
    )
    one = members.where("n > 1").groupBy("n", "shingles", "lo", "hi", "sign").agg(F.min("bucket").alias("shared"))
    shared = written(one.select("shared", F.ceil(F.col("shingles") / block).cast("int").alias("blocks")))
    met = written(standing.join(_travels(shared), F.col("bucket") == F.col("shared")).select("bucket", "blocks", "node"))
    asked = written(nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", "row"))

    def sets_of(batches):
        for batch in batches:
            own = [shingle_set(value.as_py(), shingle).tobytes() for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["node", "set"])

    texts = docs.select("__row", F.col(f"`{text}`").alias("__text"))
    rows = texts.join(_travels(asked), texts["__row"] == asked["row"]).select("node", "__text")
    sets = written(rows.mapInArrow(sets_of, "node bigint, set binary").dropDuplicates(["node"]))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node")

    def link(batches):
        held: list[tuple[int, np.ndarray]] = []
        held_key = None
        for batch in batches:
            for *key, node, own in zip(*[batch.column(c).to_pylist() for c in range(5)]):
                if key != held_key:
                    yield from stars(held)
                    held, held_key = [], key
                held.append((node, np.frombuffer(own, np.uint64)))
        yield from stars(held)

    def stars(held):
        if len(held) > 1:
            names = np.array([node for node, _ in held], np.int64)
            label = link_sets([own for _, own in held], similarity)
            linked = np.flatnonzero(label != np.arange(len(label)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(names[linked]), pa.array(names[label[linked]])], names=["a", "b"])

    groups = dealt.join(sets, "node").select("bucket", "i", "j", "node", "set").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    links = written(groups.mapInArrow(link, "a bigint, b bigint"))
    for table in (alike, shared, met, asked, sets):
        drop(table)
    return links


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, similarity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """One row of each component of near copies, which are texts whose shingle sets have that Jaccard similarity or
    more. The row is chosen, and repeated rows and null keys are treated, as in `simhash.deduplicated`. Texts
    without words, null ones among them, are one group."""
    marked = docs.withColumn("__row", F.xxhash64(*[f"`{c}`" for c in docs.columns]))
    found = marked.select(F.col(f"`{key}`").alias("__key"), "__row", sketch(F.col(f"`{text}`"), shingle).alias("s"))
    prints = written(found.select("__key", "__row", "s.*"))
    nodes = written(prints.groupBy("node", "size", "fp", "bands").agg(F.min("__row").alias("row")))
    links = near_links(marked, nodes, text, shingle, similarity, block)
    drop(nodes)
    roots = written(components(links, "a", "b"))
    drop(links)
    own = prints.select("__key", "__row", F.col("node").alias("own"))
    rooted = own.join(roots, own["own"] == roots["node"], "left").select("__key", "__row", F.coalesce("root", "own").alias("root"))
    return simhash.least_rows(docs, rooted, key)
