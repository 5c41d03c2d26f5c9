"""Toxic spans by a linear-chain conditional random field."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from fathomline.llm.common import WORD, text_slices

PREFIXES = (3, 4, 5, 6)
SEGMENT = 48  # words of a training chain
EDGE = "\"'.,;:!?()[]{}<>*_~`¡¿«»„“”‚‘’…-"
THRESHOLD = 0.3
CACHE = 200_000


def shape(word: str) -> str:
    return word.strip(EDGE).lower()


def features(word: str) -> list[str]:
    """The word itself, marked off, and its beginnings: stems carry endings of any kind."""
    return ["=" + word, *[word[:n] for n in PREFIXES if len(word) > n]] if word else []


@dataclass
class Model:
    """Weights of the chain (state 1 is toxic) and of the score that is made of its marginals."""

    weights: dict[str, float]
    bias: float
    begin: float
    moves: np.ndarray  # exp of the weight of going from state i to state j
    scale: tuple[float, float, float]

    def emission(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(shape(word)))

    def score(self, peak: np.ndarray, mass: np.ndarray) -> np.ndarray:
        a, b, c = self.scale
        return 1 / (1 + np.exp(-np.clip(a + b * peak + c * np.log(mass + 1e-9), -30, 30)))


def forward_backward(e: np.ndarray, bounds: np.ndarray, begin: float, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log odds of state 1 from the left, from the right, at each position of chains laid end to end.

    All chains advance together, the longest first, so that step t touches only
    those with more than t positions. With two states the odds say it all.
    """
    starts, sizes = bounds[:-1], np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    alive = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")  # chains longer than t
    left, right = np.empty_like(e), np.zeros_like(e)
    (a00, a01), (a10, a11) = moves
    x = None
    for t, n in enumerate(alive):
        at = starts[:n] + t
        x = begin + e[at] if t == 0 else np.log((a01 + a11 * x[:n]) / (a00 + a10 * x[:n])) + e[at]
        left[at] = x
        x = np.exp(np.clip(x, -30, 30))
    y = np.zeros(0)
    for t in range(len(alive) - 1, 0, -1):
        n = alive[t]
        at = starts[:n] + t
        y = np.concatenate([y, np.zeros(n - len(y))]) + e[at]
        y = np.exp(np.clip(y, -30, 30))
        y = np.log((a10 + a11 * y) / (a00 + a01 * y))
        right[at - 1] = y
    return left, right, left + right


def _sums(values: np.ndarray, bounds: np.ndarray, how) -> np.ndarray:
    return how.reduceat(values, bounds[:-1]) if len(bounds) > 1 else np.zeros(0)


def document_evidence(logits: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Highest marginal (as log odds) and expected number of toxic words of each chain."""
    p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
    return _sums(np.clip(logits, -12, 12), bounds, np.maximum), _sums(p, bounds, np.add)


class Coded:
    """Texts as word numbers, and the features of each distinct word once."""

    def __init__(self, texts: list[str]):
        split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pa.array(texts, pa.string())))
        coded = split.flatten().dictionary_encode()
        shapes = [shape(w) for w in coded.dictionary.to_pylist()]
        number = {s: i for i, s in enumerate(dict.fromkeys(shapes))}
        self.bounds = split.offsets.to_numpy().astype(np.int64)
        self.words = np.array([number[s] for s in shapes], np.int64)[coded.indices.to_numpy()]
        known: dict[str, int] = {}
        lists = [[known.setdefault(f, len(known)) for f in features(s)] for s in number]
        self.names = list(known)
        self.counts = np.array([len(x) for x in lists], np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.flat = np.array([i for x in lists for i in x], np.int64)

    def document(self, i: int) -> np.ndarray:
        return self.words[self.bounds[i]:self.bounds[i + 1]]

    def features(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each feature of each word, the word's place and the feature's number."""
        counts = self.counts[words]
        ends = np.cumsum(counts)
        at = np.repeat(self.first[words] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
        return np.repeat(np.arange(len(words)), counts), self.flat[at]


def telling_features(coded: Coded, rows: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Whether a feature stands in toxic documents of ``rows`` more often than chance would let any feature do."""
    seen = np.zeros((2, len(coded.names)))
    for i in rows:
        seen[int(toxic[i]), np.unique(coded.features(np.unique(coded.document(i)))[1])] += 1
    rate = float(np.mean(toxic[rows]))
    if not 0 < rate < 1:
        return np.zeros(len(coded.names), bool)
    a, n = seen[1], seen.sum(axis=0)
    q = np.clip(a / np.maximum(n, 1), 1e-12, 1 - 1e-12)
    # Bound on the log of one over the chance of so many among n.
    surprise = n * (q * np.log(q / rate) + (1 - q) * np.log((1 - q) / (1 - rate)))
    return (a > 9 * seen[0]) & (q > rate) & (surprise >= math.log(10 * max(int((a > 0).sum()), 1)))


def _train_chain(chains: list[np.ndarray], labels: list[np.ndarray], coded: Coded, telling: np.ndarray, rounds: int = 120):
    """Weights that make the labels likely: Adam on the whole penalised likelihood, all chains at once."""
    bounds = np.concatenate([[0], np.cumsum([len(c) for c in chains])])
    words, y = np.concatenate(chains), np.concatenate(labels).astype(np.float64)
    owner, flat = coded.features(words)
    used = np.flatnonzero((np.bincount(flat, minlength=len(coded.names)) >= 3) | telling)
    column = np.full(len(coded.names), -1)
    column[used] = np.arange(len(used))
    known = column[flat] >= 0
    owner, flat = owner[known], column[flat[known]]
    first = bounds[:-1]
    inner = np.setdiff1d(np.arange(len(words)), bounds[1:] - 1)  # positions with a follower
    n = len(used)
    theta = np.zeros(n + 2 + 3)  # features, bias, begin, three moves against staying clean
    theta[n] = -3.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    seen_moves = [((1 - y[inner]) * y[inner + 1]).sum(), (y[inner] * (1 - y[inner + 1])).sum(), (y[inner] * y[inner + 1]).sum()]
    penalty = np.full_like(theta, 0.05)
    for step in range(1, rounds + 1):
        moves = np.exp(np.array([[0.0, theta[n + 2]], [theta[n + 3], theta[n + 4]]]))
        e = theta[n] + np.bincount(owner, theta[flat], len(words))
        left, right, logit = forward_backward(e, bounds, theta[n + 1], moves)
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        # Joint of neighbours: left odds of the one, move, emission and right odds of the other.
        odds = np.exp(np.clip(left[inner], -30, 30)), np.exp(np.clip(e[inner + 1] + right[inner + 1], -30, 30))
        joint = [moves[0, 1] * odds[1], moves[1, 0] * odds[0], moves[1, 1] * odds[0] * odds[1]]
        total = 1.0 + joint[0] + joint[1] + joint[2]
        slope = p - y
        grad = np.concatenate([
            np.bincount(flat, slope[owner], n), [slope.sum(), slope[first].sum()],
            [(j / total).sum() - s for j, s in zip(joint, seen_moves)],
        ]) + penalty * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta -= 0.25 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    moves = np.exp(np.array([[0.0, theta[n + 2]], [theta[n + 3], theta[n + 4]]]))
    kept = {coded.names[f]: float(theta[i]) for i, f in enumerate(used) if abs(theta[i]) >= 0.02}
    return kept, float(theta[n]), float(theta[n + 1]), moves


def _fit_scale(peak, mass, y, weight, rounds: int = 400) -> tuple[float, float, float]:
    """Logistic regression of the label on a document's evidence."""
    x = np.stack([np.ones(len(y)), peak, np.log(mass + 1e-9)], axis=1)
    theta = np.array([0.0, 0.5, 0.0])
    for _ in range(rounds // 20):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (weight * (p - y)) + 0.3 * (theta - [0.0, 0.5, 0.0])
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(3)
        theta = theta - np.clip(np.linalg.solve(hess, grad), -2, 2)
    return tuple(float(t) for t in theta)


def fit(texts: list[str], toxic: list[bool], weight: np.ndarray | None = None) -> Model:
    """A model of labelled documents.

    Labels are given for documents only. A word of a toxic document gets a toxic
    label if one of its features stands in toxic documents beyond chance; all
    other words are clean. The chain is trained on these labels, on three
    quarters of the documents; its scale on the others.
    """
    if not any(toxic) or all(toxic):
        return Model({}, -30.0 if not any(toxic) else 0.0, 0.0, np.ones((2, 2)), (30.0 if any(toxic) else -30.0, 0.0, 0.0))
    coded, y = Coded(texts), np.array(toxic)
    part = np.arange(len(texts)) % 4 != 3
    telling = telling_features(coded, np.flatnonzero(part), y)
    owner, flat = coded.features(np.arange(len(coded.counts)))
    toxic_word = np.zeros(len(coded.counts), bool)
    toxic_word[owner[telling[flat]]] = True
    chains, labels, clean = [], [], []
    for i in np.flatnonzero(part):
        words = coded.document(i)
        marks = toxic_word[words] & y[i]
        for begin in range(0, len(words), SEGMENT):
            end = begin + SEGMENT
            if marks[begin:end].any():
                chains.append(words[begin:end])
                labels.append(marks[begin:end])
            else:
                clean.append(words[begin:end])
    step = max(1, len(clean) // max(3 * len(chains), 200))
    chains, labels = chains + clean[::step], labels + [np.zeros(len(c), bool) for c in clean[::step]]
    weights, bias, begin, moves = _train_chain(chains, labels, coded, telling)
    model = Model(weights, bias, begin, moves, (0.0, 1.0, 0.0))
    value = np.array([weights.get(f, 0.0) for f in coded.names])
    emission = bias + np.bincount(owner, value[flat], len(coded.counts))
    peak, mass = document_evidence(forward_backward(emission[coded.words], coded.bounds, begin, moves)[2], coded.bounds)
    rest = ~part if (~part).any() else part
    w = np.ones(len(texts)) if weight is None else weight
    model.scale = _fit_scale(peak[rest], mass[rest], y[rest].astype(float), w[rest])
    return model


def learn(docs: DataFrame, labels: DataFrame, n_toxic: int = 400, n_clean: int = 1600, max_chars: int = 20_000) -> Model:
    """A model of a bounded sample of ``labels`` (doc_id, toxic) and their ``docs`` (doc_id, text).

    At most ``n_toxic`` and ``n_clean`` labels, the first in the order of a hash
    of the id; texts longer than ``max_chars`` are not learned from. The sample's
    ids, at most n_toxic + n_clean, are sent to the scan of the documents.

    Defined results: labels without an id or a mark say nothing; of several
    labels of an id toxic counts; of several documents with an id the least text
    is learned from, so the sample is bounded however often an id stands there;
    without any labelled document the model is neutral.
    """
    marked = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(
        F.max((F.col("toxic") != 0).cast("int")).alias("toxic")
    ).withColumn("at", F.xxhash64("id"))
    counts = {r[0]: r[1] for r in marked.groupBy("toxic").count().collect()}
    picked = marked.where("toxic = 1").orderBy("at", "id").limit(n_toxic).union(
        marked.where("toxic = 0").orderBy("at", "id").limit(n_clean)
    )
    held = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("id")).where(F.length("text") <= max_chars)
    # One text for each id, chosen within the tasks first.
    rows = held.groupBy("at", "doc_id", "toxic").agg(F.min("text").alias("text"))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["at"], r["doc_id"], r["text"]))
        toxic = [bool(r["toxic"]) for r in sample]
        # The sample may hold more toxic documents than the labels do; its rows are weighed to make up for that.
        share = {c: counts.get(c, 0) / max(sum(t == bool(c) for t in toxic), 1) for c in (0, 1)}
        total = sum(counts.values()) or 1
        weight = np.array([share[int(t)] for t in toxic]) * (len(sample) / total)
        m = fit([r["text"] for r in sample], toxic, weight)
        yield pa.RecordBatch.from_pydict({
            "names": [list(m.weights)], "weights": [list(m.weights.values())],
            "numbers": [[m.bias, m.begin, *m.moves.ravel().tolist(), *m.scale]],
        })

    # One task learns from the bounded sample; the driver gets the weights.
    learned = rows.repartition(1).mapInArrow(train, "names array<string>, weights array<double>, numbers array<double>").first()
    if learned is None:  # no labelled rows, no task
        return fit([], [])
    names, weights, numbers = learned
    return Model(dict(zip(names, weights)), numbers[0], numbers[1], np.array(numbers[2:6]).reshape(2, 2), tuple(numbers[6:]))


def score_documents(docs: DataFrame, model: Model, keep: float | None = None) -> DataFrame:
    """Scores whole texts of ``docs`` (doc_id, text).

    Returns doc_id, score and spans (begin and end in characters, probability of
    the surest word) of neighbouring words that are more likely toxic than not.
    With ``keep`` given, returns instead the rows of ``docs``, with all their
    columns, whose score is below it.

    Defined results: a null or empty text is scored as one neutral word; ids
    play no part; repeated rows are scored alike; an empty table gives none.
    """
    schema = "doc_id bigint, score double, spans array<struct<begin:int,end:int,probability:double>>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            for part in text_slices(batch):
                if len(known) > CACHE:
                    known = {}
                split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(part.column("text"), "")))
                bounds = split.offsets.to_numpy().astype(np.int64)
                bounds -= bounds[0]
                words = split.flatten().dictionary_encode()
                distinct = words.dictionary.to_pylist()
                for w in distinct:
                    if w not in known:
                        known[w] = model.emission(w)
                e = np.array([known[w] for w in distinct])[words.indices.to_numpy()]
                logits = forward_backward(e, bounds, model.begin, model.moves)[2]
                score = model.score(*document_evidence(logits, bounds))
                if keep is not None:
                    yield part.filter(pa.array(score < keep))
                    continue
                hot = logits > 0
                spans: list[list] = [[] for _ in range(len(score))]
                for i in np.unique(np.searchsorted(bounds, np.flatnonzero(hot), side="right") - 1):
                    spans[i] = _spans(part.column("text")[int(i)].as_py() or "", logits[bounds[i]:bounds[i + 1]])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(score), pa.array(spans, pa.list_(pa.struct(
                        [("begin", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])))],
                    names=["doc_id", "score", "spans"],
                )

    if keep is not None:
        return docs.mapInArrow(work, docs.schema)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(work, schema)


def _spans(text: str, logits: np.ndarray) -> list[dict]:
    """Runs of words with positive log odds, as character offsets."""
    found: list[dict] = []
    before = -2
    for i, word in enumerate(re.finditer(WORD, text)):
        if logits[i] <= 0:
            continue
        p = 1 / (1 + math.exp(-min(logits[i], 30.0)))
        if i == before + 1:
            found[-1] |= {"end": word.end(), "probability": max(p, found[-1]["probability"])}
        else:
            found.append({"begin": word.start(), "end": word.end(), "probability": p})
        before = i
    return found


