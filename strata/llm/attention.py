"""A small causal self-attention model over subword ids, in numpy.

One head attends from each position to the inputs before it, in overlapping windows: a block
of ``STRIDE`` positions sees itself and the ``STRIDE`` inputs before it, so every token is
scored once. Blocks begin with their text, so a score depends on the text and the model alone. Embeddings are principal components of the tokens' counted predecessors. The
output shifts the logits of the next token's class; the counted probabilities of classes and
of tokens within a class, given the input, complete a proper distribution over all ids.
"""

from __future__ import annotations

import uuid

import numpy as np
import zstandard

STRIDE, WIDTH, CLASSES = 16, 16, 24
SPAN = 2 * STRIDE
#: Positions scored together.
BATCH = 128 * STRIDE
#: Weight of the token frequencies against an input's own counts.
BACKOFF = 50.0


class Tables:
    """What is counted: bounded by the vocabulary and the number of input rows, not by the corpus."""

    def __init__(self, counts: list[bytes], unigrams: np.ndarray, row_of: np.ndarray):
        """``counts`` holds each row's counts as compressed 64-bit integers."""
        size = len(unigrams)
        self.row_of, self.counts = row_of, counts
        self.base = base = (unigrams + 1.0) / (unigrams.sum() + size)
        logs = np.stack([np.log1p(self.row(r)).astype(np.float32) for r in range(len(counts))])
        basis = np.linalg.eigh((logs @ logs.T).astype(np.float64))[1][:, -WIDTH:].astype(np.float32)
        vectors = logs.T @ basis
        del logs
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-3
        self.vectors = vectors.astype(np.float32)
        self.classes = _clusters(self.vectors, unigrams)
        self.mass = np.bincount(self.classes, base, CLASSES)
        rows = map(self.row, range(len(counts)))
        self.prior = np.stack([np.log(np.maximum(1e-30, self._by_class(own) / (own.sum(dtype=np.float64) + BACKOFF))) for own in rows]).astype(np.float32)
        self.name = uuid.uuid4().hex

    def row(self, r: int) -> np.ndarray:
        """What follows the inputs of row ``r``, counted."""
        return np.frombuffer(zstandard.decompress(self.counts[r]), np.int64)

    def _by_class(self, own: np.ndarray) -> np.ndarray:
        return np.bincount(self.classes, own, CLASSES) + BACKOFF * self.mass

    @property
    def within(self) -> np.ndarray:
        """Log probability of each token within its class, by input row."""
        if self.name not in _opened:
            _opened.clear()
            # Most counts are 0, so they travel compressed; a worker process opens them once.
            table = np.empty((len(self.counts), len(self.base)), np.float16)
            share = BACKOFF * self.base
            for r in range(len(self.counts)):
                own = self.row(r)
                table[r] = np.log(((own + share) / self._by_class(own)[self.classes]).astype(np.float32))
            _opened[self.name] = table
        return _opened[self.name]


#: The table that this process has opened.
_opened: dict[str, np.ndarray] = {}


def forget() -> None:
    """Drop the opened table, before work that does not need it."""
    _opened.clear()


def _clusters(vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted k-means; the start is the heaviest tokens furthest from each other."""
    weights = np.sqrt(weights + 0.1)
    centres = [vectors[np.argmax(weights)]]
    far = np.full(len(vectors), np.inf)
    for _ in range(CLASSES - 1):
        far = np.minimum(far, ((vectors - centres[-1]) ** 2).sum(1))
        centres.append(vectors[np.argmax(far * weights)])
    centres = np.array(centres)
    for _ in range(15):
        label = np.argmin((centres**2).sum(1) - 2 * vectors @ centres.T, axis=1)
        for c in range(CLASSES):
            own = label == c
            if own.any():
                centres[c] = np.average(vectors[own], axis=0, weights=weights[own])
    return label.astype(np.int16)


def start(seed: int = 8) -> np.ndarray:
    """First weights; with these the model gives the counted probabilities."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(0, 0.5, 3 * WIDTH * WIDTH), np.zeros(WIDTH * CLASSES + STRIDE * SPAN)]
    return np.concatenate(parts).astype(np.float32)


#: Where the maps to queries, keys, values and classes end in the weights.
_CUTS = np.cumsum([WIDTH * WIDTH] * 3 + [WIDTH * CLASSES]).tolist()


def _unpack(weights: np.ndarray):
    shape, (a, b, c, d) = (WIDTH, WIDTH), _CUTS
    maps = weights[:a].reshape(shape), weights[a:b].reshape(shape), weights[b:c].reshape(shape)
    return *maps, weights[c:d].reshape(WIDTH, CLASSES), weights[d:].reshape(STRIDE, SPAN)


#: A position sees inputs up to its own (which is the token before the one to predict).
_FUTURE = np.arange(SPAN)[None, :] > np.arange(STRIDE)[:, None] + STRIDE
_NEVER = np.float32(-1e4)


def slots(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where tokens of texts of these lengths stand, each text in blocks of its own, and which blocks begin one.

    What fills the last block of a text comes after its tokens, so none of them sees it.
    """
    blocks = -(-lengths // STRIDE)
    before = np.cumsum(blocks) - blocks
    first = np.zeros(int(blocks.sum()), bool)
    first[before[lengths > 0]] = True
    shift = before * STRIDE - (np.cumsum(lengths) - lengths)
    return np.arange(int(lengths.sum())) + np.repeat(shift, lengths), first


def _pairs(flat: np.ndarray) -> np.ndarray:
    """Each block but the first with the one before it, as a view of what lies in ``flat`` anyway."""
    down, right = flat.strides
    return np.ndarray((len(flat) // STRIDE - 1, SPAN, flat.shape[1]), flat.dtype, flat, 0, (STRIDE * down, down, right))


def _blocks(across: np.ndarray) -> np.ndarray:
    """A column for each position as a matrix for each block, in place."""
    return across.reshape(len(across), -1, STRIDE).transpose(1, 0, 2)


def _attend(queries: np.ndarray, x: np.ndarray, x2: np.ndarray, place: np.ndarray, first: np.ndarray):
    """Weights of attention before they are divided by their sums, the sums, and the mean input they give.

    ``queries`` is the map to queries times the transposed map to keys, so they meet the inputs
    themselves. Weights have a column for each position: products of small matrices are twice as
    fast where none of them runs along the rows of both.
    """
    scores = np.matmul(x2, _blocks(queries.T @ x[STRIDE:].T))
    scores += np.ascontiguousarray(np.where(_FUTURE, _NEVER, place).T)
    scores[first, :STRIDE] = _NEVER
    if scores.max(initial=0) > 60:
        np.minimum(scores, 60, out=scores)
    np.exp(scores, out=scores)
    sums = np.ones((1, SPAN), scores.dtype) @ scores
    means = np.matmul(scores.transpose(0, 2, 1), x2)
    means /= sums.transpose(0, 2, 1)
    return scores, sums, means.reshape(-1, WIDTH)


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums along the last axis, which stays; a product is faster than a reduction of short rows."""
    return x @ np.ones((x.shape[-1], 1), x.dtype)


def token_scores(tables: Tables, weights: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """Natural log probability of every token; texts follow one another and each ends with ``end``."""
    out, within = np.empty(len(tokens), np.float32), tables.within
    inputs = np.concatenate([[end], tokens[:-1]])  # before a text stands the end of another
    at, first = slots(lengths)
    ids = np.full(STRIDE * (len(first) + 1), end, inputs.dtype)  # a block before all others
    ids[STRIDE + at] = inputs
    wq, wk, wv, wo, place = _unpack(weights)
    queries, shift = wq @ wk.T, wv @ wo
    size = within.shape[1]
    for b in range(0, len(first), BATCH // STRIDE):
        e = min(len(first), b + BATCH // STRIDE)
        x = tables.vectors.take(ids[b * STRIDE : (e + 1) * STRIDE], axis=0)
        low, high = np.searchsorted(at, [b * STRIDE, e * STRIDE])
        means = _attend(queries, x, _pairs(x), place, first[b:e])[2].take(at[low:high] - b * STRIDE, axis=0)
        rows, target = tables.row_of.take(inputs[low:high]), tokens[low:high]
        logits = tables.prior.take(rows, axis=0)
        logits += means @ shift
        chosen = logits.ravel().take(np.arange(0, logits.size, CLASSES) + tables.classes.take(target))
        np.exp(logits, out=logits)
        out[low:high] = chosen - np.log(_sums(logits)[:, 0]) + within.ravel().take(rows * size + target)
    return out


def loss_gradient(tables: Tables, weights: np.ndarray, inputs: np.ndarray, targets: np.ndarray, first: np.ndarray):
    """Loss of the class predictions summed over some blocks, and its gradient.

    ``inputs`` hold a block more, the one before the first; a target below 0 is none. All maps are
    linear, so keys, values and heads need not be formed: attention meets the inputs, and what the
    weights share is multiplied once for all blocks.
    """
    wq, wk, wv, wo, place = _unpack(weights)
    queries, shift = wq @ wk.T, wv @ wo
    x = tables.vectors.take(inputs, axis=0)
    x2 = _pairs(x)
    attention, sums, means = _attend(queries, x, x2, place, first)
    delta = tables.prior.take(tables.row_of.take(inputs[STRIDE:]), axis=0)
    delta += means @ shift
    np.exp(delta, out=delta)
    delta /= _sums(delta)
    real = targets >= 0
    at = np.flatnonzero(real)
    at = at * CLASSES + tables.classes.take(targets.take(at))
    chosen = delta.ravel().take(at)
    loss = -np.log(chosen + 1e-30).sum(dtype=np.float64)
    delta.ravel()[at] = chosen - 1
    delta[~real] = 0
    d_shift = means.T @ delta
    # Both are divided by the sums of attention here, where there are fewer numbers than in the scores.
    across = shift @ delta.T
    across /= sums.reshape(-1)
    means *= delta @ shift.T
    means = _sums(means).reshape(sums.shape)
    means /= sums
    d_scores = np.matmul(x2, _blocks(across))
    d_scores -= means
    d_scores *= attention
    d_queries = x[STRIDE:].T @ np.matmul(d_scores.transpose(0, 2, 1), x2).reshape(-1, WIDTH)
    d_place = (np.ones(len(d_scores), d_scores.dtype) @ d_scores.reshape(len(d_scores), -1)).reshape(SPAN, STRIDE).T
    parts = [d_queries @ wk, d_queries.T @ wq, d_shift @ wo.T, wv.T @ d_shift, np.where(_FUTURE, 0, d_place)]
    return loss, np.concatenate([p.ravel() for p in parts]).astype(np.float64)


class Adam:
    def __init__(self, size: int, rate: float):
        self.rate, self.t = rate, 0
        self.m, self.v = np.zeros(size, np.float32), np.zeros(size, np.float32)

    def step(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.01 * (gradient**2 - self.v)
        m, v = self.m / (1 - 0.9**self.t), self.v / (1 - 0.99**self.t)
        return weights - self.rate * m / (np.sqrt(v) + 1e-8)
