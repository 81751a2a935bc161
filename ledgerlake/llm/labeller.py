"""Main text of web pages by a recurrent labeller of blocks.

A bidirectional LSTM in numpy reads the blocks of a page in order. A block is the average of learned
vectors of its hashed tag path, the average of those of its hashed words, and a few figures. The
network labels every block with the whole page in view. It is trained here, on pages that a grammar
of page layouts writes together with the labels.
"""

from __future__ import annotations

import functools
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.blocks import Block, blocks_of
from ledgerlake.llm.layouts import sample_page

PATHS, WORDS, DIM, HIDDEN, FIGURES = 2048, 1024, 16, 20, 6
PAGES, EPOCHS, BATCH, RATE, SEED = 1600, 8, 8, 0.01, 7
#: Averages are taken as if so many more rows of zeros were there, so that a single word says little.
SHRUNK = 4
CELLS_AT_ONCE = 100_000
NO_DIGITS = str.maketrans("", "", "0123456789")


@functools.lru_cache(maxsize=200_000)
def row(kind: str, unit: str, rows: int) -> int:
    return zlib.crc32(f"{kind}{unit}".encode("utf-8", "replace")) % rows


def path_rows(path: tuple[str, ...]) -> list[int]:
    """Rows of the names on a path, of the innermost three by place, and of neighbouring pairs."""
    tags = [n for n in path if n[0] != "."]
    near = [f"{k}{n}" for k, n in enumerate(reversed(tags[-3:]))]
    return [row("p", n, PATHS) for n in {*path, *near, *map(">".join, zip(tags, tags[1:]))}] or [0]


def figures(block: Block, place: float) -> list[float]:
    text = block.text
    n = len(text)
    return [
        np.log1p(n) / 12, block.linked / n, (n - len(text.translate(NO_DIGITS))) / n,
        place, 1 - place, 1.0,
    ]


@dataclass
class Page:
    """The blocks of a page as numbers: rows of paths and of words, one after another, with how many each block has."""

    bags: dict[str, tuple[np.ndarray, np.ndarray]]
    figures: np.ndarray


def numbers_of(blocks: list[Block]) -> Page:
    last = max(1, len(blocks) - 1)
    bags = {}
    for name, rows in (("path", [path_rows(b.path) for b in blocks]), ("word", [[row("w", w, WORDS) for w in b.text.lower().split()] for b in blocks])):
        lengths = np.array([len(r) for r in rows])
        bags[name] = np.fromiter(chain.from_iterable(rows), np.int64, lengths.sum()), lengths
    return Page(bags, np.array([figures(b, k / last) for k, b in enumerate(blocks)], np.float32))


def averaged(rows: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> np.ndarray:
    return np.add.reduceat(table[rows], np.cumsum(lengths) - lengths, axis=0) / (lengths[:, None] + SHRUNK)


def spread(rows: np.ndarray, lengths: np.ndarray, d: np.ndarray, size: int) -> np.ndarray:
    """The gradient of a table from that of the averages of its rows."""
    order = np.argsort(rows, kind="stable")
    owner = np.repeat(np.arange(len(lengths)), lengths)[order]
    found, starts = np.unique(rows[order], return_index=True)
    out = np.zeros((size, d.shape[1]), np.float32)
    out[found] = np.add.reduceat((d / (lengths[:, None] + SHRUNK))[owner], starts, axis=0)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def run_lstm(x: np.ndarray, mask: np.ndarray, w: np.ndarray, keep: bool):
    """States over (time, direction, page, input); masked steps hand the state on. What training needs is kept."""
    steps, ways, pages, _ = x.shape
    h, c = np.zeros((ways, pages, HIDDEN), np.float32), np.zeros((ways, pages, HIDDEN), np.float32)
    states, kept, one = np.empty((steps, ways, pages, HIDDEN), np.float32), [], np.ones((ways, pages, 1), np.float32)
    for t in range(steps):
        joined = np.concatenate([x[t], h, one], axis=2)
        gates = joined @ w
        three = sigmoid(gates[..., : 3 * HIDDEN])
        i, f, o = (three[..., k * HIDDEN : (k + 1) * HIDDEN] for k in range(3))
        g = np.tanh(gates[..., 3 * HIDDEN :])
        new_c = f * c + i * g
        squashed = np.tanh(new_c)
        m = mask[t][..., None]
        if keep:
            kept.append((joined, i, f, o, g, c, squashed, m))
        c = m * new_c + (1 - m) * c
        h = m * o * squashed + (1 - m) * h
        states[t] = h
    return states, kept


def back_lstm(d_states: np.ndarray, kept, w: np.ndarray, width: int):
    """Gradients of the weights and the inputs."""
    d_w, d_x = np.zeros_like(w), np.zeros((*d_states.shape[:3], width), np.float32)
    d_h, d_c = np.zeros_like(d_states[0]), np.zeros_like(d_states[0])
    turned = w.transpose(0, 2, 1)
    for t in range(len(kept) - 1, -1, -1):
        joined, i, f, o, g, c, squashed, m = kept[t]
        d_h = d_h + d_states[t]
        own = d_h * m
        d_new = own * o * (1 - squashed**2) + d_c * m
        d_gates = np.concatenate([d_new * g * i * (1 - i), d_new * c * f * (1 - f), own * squashed * o * (1 - o), d_new * i * (1 - g**2)], axis=2)
        d_w += joined.transpose(0, 2, 1) @ d_gates
        d_joined = d_gates @ turned
        d_x[t] = d_joined[..., :width]
        d_h = d_joined[..., width:-1] + d_h * (1 - m)
        d_c = d_new * f + d_c * (1 - m)
    return d_w, d_x


class Labeller:
    WIDTH = 2 * DIM + FIGURES

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        small = lambda *shape: rng.normal(0, 0.15, shape).astype(np.float32)
        # Both directions stand in one array: forward, then backward.
        self.w = {
            "path": small(PATHS, DIM), "word": 0.3 * small(WORDS, DIM), "lstm": small(2, self.WIDTH + HIDDEN + 1, 4 * HIDDEN),
            "out": small(2 * HIDDEN + self.WIDTH + 1, 1),
        }

    def padded(self, pages: list[Page]):
        """(time, page, input) and its mask."""
        steps = max(len(p.figures) for p in pages)
        x, mask = np.zeros((steps, len(pages), self.WIDTH), np.float32), np.zeros((steps, len(pages)), np.float32)
        for k, page in enumerate(pages):
            n = len(page.figures)
            x[:n, k] = np.concatenate([averaged(*page.bags["path"], self.w["path"]), averaged(*page.bags["word"], self.w["word"]), page.figures], axis=1)
            mask[:n, k] = 1
        return x, mask

    def forward(self, x, mask, keep=False):
        states, kept = run_lstm(np.stack([x, x[::-1]], axis=1), np.stack([mask, mask[::-1]], axis=1), self.w["lstm"], keep)
        top = np.concatenate([states[:, 0], states[::-1, 1], x, np.ones((*mask.shape, 1), np.float32)], axis=2)
        return sigmoid(top @ self.w["out"])[:, :, 0], top, kept

    def gradients(self, pages: list[Page], labels):
        x, mask = self.padded(pages)
        chance, top, kept = self.forward(x, mask, keep=True)
        wanted = np.zeros_like(mask)
        for k, own in enumerate(labels):
            wanted[: len(own), k] = own
        d = ((chance - wanted) * mask / mask.sum())[:, :, None].astype(np.float32)
        d_top = d @ self.w["out"].T
        out = {"out": np.einsum("tpk,tpj->kj", top, d)}
        d_states = np.stack([d_top[:, :, :HIDDEN], d_top[::-1, :, HIDDEN : 2 * HIDDEN]], axis=1)
        out["lstm"], d_both = back_lstm(d_states, kept, self.w["lstm"], self.WIDTH)
        d_x = d_both[:, 0] + d_both[::-1, 1] + d_top[:, :, 2 * HIDDEN : -1]
        for name, part in (("path", slice(0, DIM)), ("word", slice(DIM, 2 * DIM))):
            rows, lengths = (np.concatenate([p.bags[name][k] for p in pages]) for k in range(2))
            own = np.concatenate([d_x[: len(p.figures), k, part] for k, p in enumerate(pages)])
            out[name] = spread(rows, lengths, own, len(self.w[name]))
        return out

    def fit(self, pages, labels, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> "Labeller":
        """Adam over shuffled batches of pages of like length."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        order = sorted(range(len(pages)), key=lambda k: len(pages[k].figures))
        batches = [order[a : a + BATCH] for a in range(0, len(order), BATCH)]
        step, steps = 0, epochs * len(batches)
        for _ in range(epochs):
            for b in rng.permutation(len(batches)):
                step += 1
                now = rate * (1 - 0.9 * step / steps)
                for k, g in self.gradients([pages[p] for p in batches[b]], [labels[p] for p in batches[b]]).items():
                    np.clip(g, -1, 1, out=g)
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    self.w[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
                self.w["word"] *= 1 - now  # so that only words that help keep a weight
        return self

    def labels(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Whether each block of each page is main text. Pages of like length run side by side."""
        out = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            n = 1
            while at + n < len(order) and n < 256 and (n + 1) * len(pages[order[at + n]]) <= CELLS_AT_ONCE:
                n += 1
            own = order[at : at + n]
            chance = self.forward(*self.padded([numbers_of(pages[k]) for k in own]))[0]
            for k, p in enumerate(own):
                out[p] = chance[: len(pages[p]), k] >= 0.5
            at += n
        return out


@functools.lru_cache(maxsize=2)
def trained(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """A labeller fitted to `pages` pages of the layout grammar. The same arguments give the same one."""
    rng = np.random.default_rng(seed)
    found = [sample_page(rng) for _ in range(pages)]
    kept = [(numbers_of(b), y) for b, y in ((blocks_of(h), y) for h, y in found) if b and len(b) == len(y)]
    return Labeller(seed).fit([x for x, _ in kept], [y for _, y in kept], epochs, seed=seed)


def extracted(pages: DataFrame, model: Labeller, html: str = "html", name: str = "text") -> DataFrame:
    """The rows with the main text of each page: its main blocks in order, joined by line feeds.

    A null or empty page, and one without main blocks, has an empty text. `name` takes the place of a
    column of that name.
    """

    @F.arrow_udf("string")
    def main_text(column: pa.Array) -> pa.Array:
        out: list[str] = []
        for at in range(0, len(column), 512):
            found = [blocks_of(v.as_py()) for v in column.slice(at, 512)]
            for blocks, labels in zip(found, model.labels(found)):
                out.append("\n".join(b.text for b, y in zip(blocks, labels) if y))
        return pa.array(out, pa.string())

    return pages.withColumn(name, main_text(F.col(html)))
