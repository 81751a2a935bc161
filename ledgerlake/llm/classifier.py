"""A quality classifier of supervised subword embeddings.

A document is the average of learned vectors of its words and of their character n-grams, hashed to
a fixed number of rows; a softmax over that average gives the label. It is trained by stochastic
gradient descent in numpy, on a bounded sample of labelled documents. Averaging and softmax are
linear up to the end, so for scoring every row of the table becomes one number, and a word the sum
of its rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.scratch import written

#: The most labelled documents to learn from: those least by hash of their id.
LABELLED = 4000
LABELLED_FEATURES = 1 << 26  # at most 8 bytes each on the driver; short of it unless texts average above 2,800 characters
BUCKETS = 1 << 16
DIMENSIONS = 16
EPOCHS = 5
RATE = 0.5
SHORTEST, LONGEST = 3, 5
CACHED_WORDS = 300_000
LONGEST_CACHED = 64
FACTOR = np.uint32(0x9E3779B1)


def rows_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of words (at least one), and for each row the number of its word.

    A word gives its own row and those of its character n-grams, with angle marks around it. Case
    stays: it tells. Hashes are polynomials over code points, worked out for all words at once.
    """
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(w) + 2 for w in words])
    starts = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(words)), lengths)
    powers = np.cumprod(np.full(lengths.max(), FACTOR, np.uint32), dtype=np.uint32)
    hashes, owners = [np.add.reduceat(codes * powers[np.arange(len(codes)) - starts[word]], starts)], [np.arange(len(words))]
    for n in range(SHORTEST, LONGEST + 1):
        if len(codes) < n:
            break
        h = np.full(len(codes) - n + 1, n, np.uint32)
        for k in range(n):
            h = h * FACTOR + codes[k : len(codes) - n + 1 + k]
        inside = word[: len(h)] == word[n - 1 :]
        hashes.append(h[inside])
        owners.append(word[: len(h)][inside])
    h = np.concatenate(hashes)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return (h % np.uint32(BUCKETS)).astype(np.int64), np.concatenate(owners)


def units(text: str) -> list[str]:
    """The words of a text; one that follows itself is told from others."""
    words = text.split()
    return [w if w != b else f"\x02{w[:1]}" for w, b in zip(words, ["", *words])]


def counted_rows(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a text and how often each occurs; at most as many as there are buckets."""
    counts = np.zeros(BUCKETS, np.int64)
    found = units(text or "")
    for at in range(0, len(found), 16384):
        counts += np.bincount(rows_of(found[at : at + 16384])[0], minlength=BUCKETS)
    rows = np.flatnonzero(counts)
    return rows.astype(np.int32), counts[rows].astype(np.float32)


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], classes: int = 2, dimensions: int = DIMENSIONS, epochs: int = EPOCHS,
          rate: float = RATE, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, output weights and bias, by one step per document with a falling rate."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dimensions, 1 / dimensions, (BUCKETS, dimensions)).astype(np.float32)
    out = np.zeros((dimensions, classes), np.float32)
    bias = np.log(np.array([1 + sum(y == k for *_, y in samples) for k in range(classes)], np.float32))
    bias -= bias.max()
    steps, step = max(1, epochs * len(samples)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(samples)):
            rows, counts, y = samples[k]
            if len(rows):
                share = counts / counts.sum()
                hidden = share @ table[rows]
                logits = hidden @ out + bias
                chance = np.exp(logits - logits.max())
                chance /= chance.sum()
                chance[y] -= 1
                now = rate * (1 - step / steps)
                back = out @ chance
                out -= now * np.outer(hidden, chance)
                bias -= 0.1 * now * chance
                # The average passes a share of the step to each row; scaled so that a row in one document of many still moves.
                table[rows] -= (now * math.sqrt(len(rows))) * share[:, None] * back
            step += 1
    return table, out, bias


@dataclass
class Scorer:
    """The trained model for two labels, folded to one number a row: the document's logit is their average."""

    weights: np.ndarray
    bias: float

    def words(self, words: list[str]) -> dict[str, complex]:
        """Sum and number of the rows of each word, as the two parts of one complex number."""
        rows, owner = rows_of(words)
        totals = np.bincount(owner, self.weights[rows], len(words)) + 1j * np.bincount(owner, minlength=len(words))
        return dict(zip(words, totals.tolist()))

    def logits(self, texts, known: dict[str, complex]) -> np.ndarray:
        """The logit of each text; `known` keeps words between calls."""
        out = np.empty(len(texts))
        for k, value in enumerate(texts):
            found = units(value.as_py() or "")
            new = list({w for w in found if w not in known})
            for at in range(0, len(new), 16384):
                known.update(self.words(new[at : at + 16384]))
            total = sum([known[w] for w in found], 0j)
            out[k] = (total.real / total.imag if found else 0.0) + self.bias
            for w in new:
                if len(w) > LONGEST_CACHED:
                    del known[w]
            if len(known) > CACHED_WORDS:
                known.clear()
        return out


def is_held_out(key: Column) -> Column:
    """A fifth of all keys, by CRC-32 of the key as text; none for a null key."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", most: int = LABELLED) -> Scorer:
    """A scorer for label 1 against 0, from at most `most` labelled keys that aren't held out.

    A key with two different labels, a null key and any label but 0 and 1 are left out. Different
    texts of a key each count, the same one counts once, and there are at most `most` in all. Of those, in the
    order of a hash, the first are taken whose features, at most six a character and `BUCKETS` a text, come to
    `LABELLED_FEATURES`; so neither a key with very many rows nor long texts fill the driver. Without
    labelled documents every score is one half.
    """
    own = labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__y")).where("__key is not null and __y in (0, 1)")
    own = own.where(~is_held_out(F.col("__key"))).groupBy("__key").agg(F.min("__y").alias("__y"), F.max("__y").alias("__z")).where("__y = __z")
    drawn = written(own.orderBy(F.xxhash64("__key"), "__key").limit(most).select("__key", "__y"))

    @F.arrow_udf("struct<rows: binary, counts: binary>")
    def features(texts: pa.Array) -> pa.Array:
        found = [counted_rows(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays(
            [pa.array([r.tobytes() for r, _ in found], pa.binary()), pa.array([c.tobytes() for _, c in found], pa.binary())], names=["rows", "counts"]
        )

    own = docs.select(F.col(key).alias("__id"), F.xxhash64(F.col(text)).alias("__h"), F.col(text).alias("__text"))
    met = own.join(F.broadcast(drawn), F.col("__id") == F.col("__key")).groupBy("__key", "__h").agg(
        F.min("__y").alias("__y"), F.max(F.coalesce(F.length("__text"), F.lit(0))).alias("__n")
    )
    first = met.orderBy(F.xxhash64("__key"), "__key", "__h").limit(most).withColumn("__n", F.least(6 * F.col("__n").cast("bigint"), F.lit(BUCKETS)))
    upto = F.sum("__n").over(Window.orderBy(F.xxhash64("__key"), "__key", "__h").rowsBetween(Window.unboundedPreceding, 0))
    picked = written(first.withColumn("__upto", upto).where(F.col("__upto") <= LABELLED_FEATURES).select("__key", F.col("__h").alias("__hash"), "__y"))
    chosen = own.join(F.broadcast(picked), (F.col("__id") == F.col("__key")) & (F.col("__h") == F.col("__hash")))
    once = chosen.select("__key", "__h", "__y", features("__text").alias("f")).groupBy("__key", "__h").agg(F.first("__y").alias("__y"), F.first("f").alias("f"))
    rows = once.select("__key", "__y", "f.rows", "f.counts").toLocalIterator()
    samples = [(r["__key"], np.frombuffer(r["rows"], np.int32), np.frombuffer(r["counts"], np.float32), r["__y"]) for r in rows]
    samples.sort(key=lambda s: (str(s[0]), s[1].tobytes(), s[2].tobytes()))
    if not samples:
        return Scorer(np.zeros(BUCKETS, np.float32), 0.0)
    table, out, bias = train([s[1:] for s in samples])
    return Scorer(table @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def scored(docs: DataFrame, scorer: Scorer, text: str = "text", name: str = "score") -> DataFrame:
    """The rows with the chance of label 1 by the whole text. A null text is empty and gets the common chance.
    `name` takes the place of a column of that name."""

    known: dict[str, complex] = {}  # of a task

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(1 / (1 + np.exp(-np.clip(scorer.logits(texts, known), -500, 500))), pa.float64())

    return docs.withColumn(name, score(F.col(text)))
