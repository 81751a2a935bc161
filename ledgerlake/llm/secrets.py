"""Secrets by fixed patterns, and by automata whose grammar is inferred from the matched credentials.

The matches of the patterns are labelled credentials. A prefix tree of a bounded sample of each
kind, over classes of characters, is merged state by state where the counts are statistically
compatible (Hoeffding's bound), which leaves a probabilistic automaton of the kind's format. Every
other run of credential characters in every text, from the shortest labelled length on, is then scored: the log-likelihood of its
format under the best automaton against that of ordinary text, a chain of character classes counted
over the whole corpus.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



#: Credentials per kind that an automaton is learned from: those least by hash, and of at most so many characters.
LABELLED_PER_KIND, LONGEST_LABELLED = 1000, 256
#: No labelled credential is shorter. Scores of short runs are kept, as words come again.
SHORTEST, CACHED_SCORES = 12, 100_000
ALPHA = 0.05
#: Bits by which a run's format must be likelier as a credential's than as ordinary text.
MARGIN = 24.0
KINDS = ("assign", "access", "hex", "grammar")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
KEYWORDS = ("passw", "secret", "token", "api")

#: Character classes: 0 what no run holds, digits, hexadecimal and other letters in both cases, marks.
CLASSES = np.zeros(256, np.uint8)
for _number, _chars in enumerate(("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", "=", "-"), 1):
    CLASSES[list(_chars.encode())] = _number
N_CLASSES = 11


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential) of the fixed patterns, in order of place and then of kind.

    Matches are leftmost and don't overlap within a kind; an assignment whose value has fewer than
    12 characters is used up and dropped. The other two patterns match whole runs, of which only
    those of 18 and 16 characters or more count, so they can ask for that length at once.
    """
    spans = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        spans += [(*m.span(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(*m.span(), "access", m[0]) for m in ACCESS.finditer(text)]
    spans += [(*m.span(), "hex", m[0]) for m in HEX.finditer(text)]
    spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return spans


def covered(start: int, end: int, spans: list[tuple[int, int, str]]) -> bool:
    """Spans, in order of their start, leave nothing of start to end."""
    for s, e, _ in spans:
        if s > start or start >= end:
            break
        start = max(start, e)
    return start >= end


def classes_of(text: str) -> np.ndarray:
    return CLASSES[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]


@dataclass
class State:
    n: int = 0
    ends: int = 0
    counts: dict[int, int] = field(default_factory=dict)
    to: dict[int, "State"] = field(default_factory=dict)


def prefix_tree(words) -> State:
    root = State()
    for word in words:
        at = root
        at.n += 1
        for c in word:
            at.counts[c] = at.counts.get(c, 0) + 1
            at = at.to.setdefault(c, State())
            at.n += 1
        at.ends += 1
    return root


def compatible(a: State, b: State, alpha: float) -> bool:
    """Do the two states, and those after them, end and go on alike, within Hoeffding's bound?"""
    spread = math.sqrt(0.5 * math.log(2 / alpha))
    pairs = [(a, b)]
    while pairs:
        a, b = pairs.pop()
        if not a.n or not b.n:
            continue
        bound = spread * (a.n**-0.5 + b.n**-0.5)
        if abs(a.ends / a.n - b.ends / b.n) > bound:
            return False
        for c in a.counts.keys() | b.counts.keys():
            if abs(a.counts.get(c, 0) / a.n - b.counts.get(c, 0) / b.n) > bound:
                return False
            if c in a.to and c in b.to and a.to[c] is not b.to[c]:
                pairs.append((a.to[c], b.to[c]))
    return True


def fold(into: State, tree: State) -> None:
    """Add a tree's counts to a state, and its branches to those of the state."""
    pairs = [(into, tree)]
    while pairs:
        a, b = pairs.pop()
        a.n += b.n
        a.ends += b.ends
        for c, k in b.counts.items():
            a.counts[c] = a.counts.get(c, 0) + k
            if c in a.to:
                pairs.append((a.to[c], b.to[c]))
            else:
                a.to[c] = b.to[c]


def infer(words, alpha: float = ALPHA) -> State:
    """The automaton of a sample: red states are settled, blue ones hang from them; the commonest blue
    state is merged with the first compatible red one, or else becomes red."""
    root = prefix_tree(words)
    red = [root]
    while True:
        settled = {id(s) for s in red}
        blue = [(child.n, -k, c, parent, child) for k, parent in enumerate(red) for c, child in parent.to.items() if id(child) not in settled]
        if not blue:
            return root
        _, _, c, parent, child = max(blue, key=lambda b: (b[0], b[1], -b[2]))
        match = next((r for r in red if compatible(r, child, alpha)), None)
        if match is None:
            red.append(child)
        else:
            parent.to[c] = match
            fold(match, child)


def frozen(root: State) -> tuple[np.ndarray, np.ndarray]:
    """Log2 probability of each class and of the end (last column), and the next state, by state. Unseen ones are rare."""
    states, number = [root], {id(root): 0}
    for s in states:
        for _, t in sorted(s.to.items()):
            if id(t) not in number:
                number[id(t)] = len(states)
                states.append(t)
    chance = np.full((len(states), N_CLASSES + 1), 0.05)
    after = np.zeros((len(states), N_CLASSES), np.int64)
    for i, s in enumerate(states):
        for c, k in s.counts.items():
            chance[i, c] += k
            after[i, c] = number[id(s.to[c])]
        chance[i, -1] += s.ends
    return np.log2(chance / chance.sum(axis=1, keepdims=True)), after


@dataclass
class Model:
    automata: list[tuple[np.ndarray, np.ndarray]]
    ordinary: np.ndarray  # log2 probability of a class after another
    shortest: int = SHORTEST
    scores: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"scores": {}}

    def kept_score(self, run: str) -> float:
        if len(run) > 40:
            return self.score(run)
        found = self.scores.get(run)
        if found is None:
            if len(self.scores) >= CACHED_SCORES:
                self.scores.clear()
            found = self.scores[run] = self.score(run)
        return found

    def score(self, run: str) -> float:
        """Bits in favour of a credential; minus infinity if there is no automaton."""
        found = classes_of(run)
        steps = np.concatenate([[0], found, [0]])
        usual = self.ordinary[steps[:-1], steps[1:]].sum()
        best = -math.inf
        for chance, after in self.automata:
            at, total = 0, 0.0
            for c in found.tolist():
                total += chance[at, c]
                at = after[at, c]
            best = max(best, total + chance[at, -1])
        return best - usual

    def spans(self, text: str, margin: float) -> list[tuple[int, int, str]]:
        """All spans of a text: those of the patterns, and every run that they don't cover whole and that scores the margin.

        A run of which they cover a part is a span as a whole; theirs stay.
        """
        spans = [s[:3] for s in base_spans(text)]
        fixed = list(spans)
        if self.automata:
            for m in RUN.finditer(text):
                start, end = m.span()
                if end - start >= self.shortest and not covered(start, end, fixed) and self.kept_score(m[0]) >= margin:
                    spans.append((start, end, "grammar"))
        spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
        return spans


def learn(docs: DataFrame, text: str = "text", per_kind: int = LABELLED_PER_KIND, alpha: float = ALPHA) -> Model:
    """Automata from at most `per_kind` different credentials of each kind, and class pairs of all texts.

    Null and empty texts count as empty; repeated rows add to the pairs and give no new credential. An
    empty table, or one without credentials, has no automata: then nothing but the patterns is found.
    Columns other than `text` aren't read. At most 1000 credentials a kind are ranked, a limit that Spark
    applies before it shuffles; they and the counts of the pairs come to the driver.
    """
    per_kind = min(per_kind, LABELLED_PER_KIND)

    def gather(batches):
        for batch in batches:
            kinds, values, pairs = [], [], np.zeros(N_CLASSES * N_CLASSES, np.int64)
            for value in batch.column(0):
                own = value.as_py() or ""
                found = classes_of(f" {own} ").astype(np.int64)
                pairs += np.bincount(found[:-1] * N_CLASSES + found[1:], minlength=len(pairs))
                for _, _, kind, credential in base_spans(own):
                    if len(credential) <= LONGEST_LABELLED:
                        kinds.append(kind)
                        values.append(credential)
            numbers = np.flatnonzero(pairs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*kinds, *["pair"] * len(numbers)], pa.string()), pa.array([*values, *map(str, numbers)], pa.string()),
                 pa.array([*[1] * len(kinds), *pairs[numbers].tolist()], pa.int64())],
                names=["kind", "value", "n"],
            )

    seen = docs.select(text).mapInArrow(gather, "kind string, value string, n bigint").groupBy("kind", "value").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value"))
    rows = seen.withColumn("rank", rank).where(F.col("rank") <= LABELLED_PER_KIND).orderBy("kind", "rank").collect()
    counts = np.full(N_CLASSES * N_CLASSES, 0.5)
    for row in rows:
        if row["kind"] == "pair":
            counts[int(row["value"])] += row["n"]
    counts = counts.reshape(N_CLASSES, N_CLASSES)
    automata = []
    for kind in KINDS[:3]:
        words = [classes_of(r["value"]).tolist() for r in rows if r["kind"] == kind and r["rank"] <= per_kind]
        if words:
            automata.append(frozen(infer(words, alpha)))
    labelled = [len(r["value"]) for r in rows if r["kind"] != "pair" and r["rank"] <= per_kind]
    return Model(automata, np.log2(counts / counts.sum(axis=1, keepdims=True)), max(SHORTEST, min(labelled, default=SHORTEST)))


def scan(docs: DataFrame, model: Model, text: str = "text", margin: float = MARGIN) -> DataFrame:
    """The rows with `secrets`, an array of (start, end, kind) in code points, end exclusive, by place and kind.

    A null or empty text has none. `secrets` takes the place of a column of that name.
    """
    struct = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    @F.arrow_udf("array<struct<start: bigint, end: bigint, kind: string>>")
    def found(texts: pa.Array) -> pa.Array:
        rows = [[{"start": s, "end": e, "kind": k} for s, e, k in model.spans(t.as_py() or "", margin)] for t in texts]
        return pa.array(rows, pa.list_(struct))

    return docs.withColumn("secrets", found(F.col(text)))


def redacted(docs: DataFrame, model: Model, text: str = "text", margin: float = MARGIN) -> DataFrame:
    """The rows with every secret in the text replaced by a mark of its kind; overlapping ones by one mark. Nulls stay."""

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        out = []
        for value in texts:
            own = value.as_py()
            spans = model.spans(own, margin) if own else []
            if spans:
                kept, at, k = [], 0, 0
                while k < len(spans):
                    start, end, kind = spans[k]
                    k += 1
                    while k < len(spans) and spans[k][0] < end:
                        end = max(end, spans[k][1])
                        k += 1
                    kept += [own[at:start], f"[{kind} secret]"]
                    at = end
                own = "".join([*kept, own[at:]])
            out.append(own)
        return pa.array(out, pa.string())

    return docs.withColumn(text, clean(F.col(text)))


def digest(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts by kind, and spans as text, of the rows of `scan`."""
    s = F.col("secrets")
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = written(F.filter(s, lambda x: x["kind"] != "grammar"))
    return docs.select(key, *[count(k) for k in KINDS], F.sha2(base, 256).alias("base_sha256"), written(s).alias("spans"))
