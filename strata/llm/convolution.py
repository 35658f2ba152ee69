"""A convolutional text classifier in numpy: hashed words, filters of several widths, max pooling.

A word is the sum of the vectors of its hashed features: itself and its first ``PREFIXES`` bytes.
A filter of width w is summed over each run of w words, words after the last being zero; its
greatest value in a text, or 0 if that is below, feeds a logistic output. As a filter is linear in
the words, its parts are computed once for each distinct word of a batch and looked up per place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from strata.llm.common import U64, Rolling, lower, mixed, spans_gather, text_bytes, word_hashes, word_spans

#: Rows of the hashed table; the row behind them is zero, for words too short for a feature.
BUCKETS = 1 << 16
DIMS = 8
WIDTHS = (1, 2, 3)
FILTERS = 12
#: Lengths in bytes of the prefixes that are features of a word.
PREFIXES = (3, 4, 5, 6, 7)
#: Places whose filters are computed at a time.
PLACES = 1 << 15

#: Features of fewer training texts count as never seen.
LEAST_TEXTS = 3
#: Times that every text is learned from, more often where that are fewer than ``TURNS`` batches.
EPOCHS = 3
TURNS = 100
BATCH = 32
RATE = 0.01
DECAY = 1e-4

#: Words are runs of letters and of bytes beyond ASCII.
_GAPS = np.ones(256, bool)
_GAPS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False

_STEPS = np.cumsum([0, *WIDTHS])


class Texts:
    """Texts as places: the numbers of their words, then as many zeros as a filter looks ahead.

    ``features`` has a row for each distinct word, and one of none at the end that stands for zeros.
    """

    def __init__(self, column: pa.Array):
        data, offsets = text_bytes(column)
        data = lower(data)
        begins, ends, before = word_spans(data, offsets, _GAPS)
        keys, first, number = np.unique(word_hashes(data, begins, ends), return_index=True, return_inverse=True)
        self.features = np.vstack([_features(data, begins[first], ends[first], keys), np.full((1, 1 + len(PREFIXES)), BUCKETS)])
        self.words = np.diff(before)
        #: Filters start at every word, and once in a text without words.
        starts, ahead = np.maximum(self.words, 1), max(WIDTHS) - 1
        after = np.cumsum(starts + ahead)
        self.begins = after - starts - ahead
        self.ends = self.begins + starts
        self.places = np.full(int(after[-1]) if len(after) else 0, len(keys), np.int32)
        self.places[np.arange(len(number)) + np.repeat(self.begins - before[:-1], self.words)] = number

    def __len__(self) -> int:
        return len(self.words)

    def common(self) -> np.ndarray:
        """Whether each row of the hashed table stands for a feature of enough texts."""
        return self.holders() >= LEAST_TEXTS

    def holders(self) -> np.ndarray:
        """How many texts have a feature that each row of the hashed table stands for."""
        counts = np.zeros(BUCKETS + 1, np.int64)
        for low, high in zip(self.begins.tolist(), self.ends.tolist(), strict=True):
            counts[np.unique(self.features[np.unique(self.places[low:high])])] += 1
        counts[BUCKETS] = 0
        return counts


def _features(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Rows of the hashed table for some words: the word itself and its prefixes."""
    out = np.full((len(keys), 1 + len(PREFIXES)), BUCKETS, np.int64)
    out[:, 0] = mixed(keys) % U64(BUCKETS)
    sizes = ends - begins
    rolling = Rolling(data[spans_gather(begins, sizes)])
    own = np.cumsum(sizes) - sizes
    for k, size in enumerate(PREFIXES, 1):
        long = np.flatnonzero(sizes >= size)
        out[long, k] = mixed(rolling.runs(own[long], own[long] + size) + U64(k)) % U64(BUCKETS)
    return out


class Classifier:
    """Weights, and what is computed with them."""

    NAMES = ("table", "filters", "bias", "out", "base")

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.table = np.zeros((BUCKETS + 1, DIMS), np.float32)
        self.table[:BUCKETS] = rng.normal(0, 0.1, (BUCKETS, DIMS))
        #: For each width and each of its words, from word vectors to filter values.
        self.filters = rng.normal(0, 0.5, (sum(WIDTHS), DIMS, FILTERS)).astype(np.float32)
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out = rng.normal(0, 0.3, (len(WIDTHS), FILTERS)).astype(np.float32)
        self.base = np.zeros(1, np.float32)

    def parts(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of words, and their share in each filter at each offset."""
        vectors = self.table[features].sum(axis=1)
        return vectors, np.einsum("wd,odf->owf", vectors, self.filters)

    def values(self, parts: np.ndarray, places: np.ndarray, width: int, low: int, high: int) -> np.ndarray:
        """The filters of WIDTHS[width] at the places from ``low`` to ``high``."""
        step = _STEPS[width]
        out = parts[step][places[low:high]]
        for k in range(1, WIDTHS[width]):
            out += parts[step + k][places[low + k : high + k]]
        return out + self.bias[width]

    def pooled(self, texts: Texts) -> np.ndarray:
        """The greatest value of each filter in each text, 0 at least: (texts, widths, filters)."""
        _, parts = self.parts(texts.features)
        found = np.zeros((len(texts), len(WIDTHS), FILTERS), np.float32)
        last = int(texts.ends[-1]) if len(texts) else 0
        for low in range(0, last, PLACES):
            high = min(low + PLACES, last)
            # Texts that have a place in this slice, and their places there.
            b, e = np.searchsorted(texts.ends, low, "right"), np.searchsorted(texts.begins, high)
            if b == e:
                continue
            first, upto = np.maximum(texts.begins[b:e], low) - low, np.minimum(texts.ends[b:e], high) - low
            cuts = np.stack([first, upto], 1).ravel()
            for width in range(len(WIDTHS)):
                values = self.values(parts, texts.places, width, low, high)
                values = np.vstack([values, np.zeros((1, FILTERS), np.float32)])  # the last cut may be the end
                best = np.maximum.reduceat(values, cuts, axis=0)[::2]
                found[b:e, width] = np.maximum(found[b:e, width], best)
        return found

    def scores(self, texts: Texts) -> np.ndarray:
        """Probability of label 1 of each text."""
        return _logistic(np.einsum("twf,wf->t", self.pooled(texts).astype(float), self.out.astype(float)) + float(self.base[0]))

    def gradients(self, texts: Texts, chosen: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, dict]:
        """Loss over the chosen texts, and its gradients; those of the table by row."""
        spans = [np.arange(texts.begins[t], texts.ends[t] + max(WIDTHS) - 1) for t in chosen]
        places = np.concatenate(spans)
        used, places = np.unique(texts.places[places], return_inverse=True)
        vectors, parts = self.parts(texts.features[used])
        sizes = np.array([len(s) for s in spans])
        lows = np.cumsum(sizes) - sizes
        highs = lows + sizes - (max(WIDTHS) - 1)

        pooled = np.zeros((len(chosen), len(WIDTHS), FILTERS), np.float32)
        peaks = np.zeros(pooled.shape, np.int64)
        for width in range(len(WIDTHS)):
            for t, (low, high) in enumerate(zip(lows.tolist(), highs.tolist(), strict=True)):
                values = self.values(parts, places, width, low, high)
                peaks[t, width] = values.argmax(axis=0) + low
                pooled[t, width] = np.maximum(values.max(axis=0), 0)
        logits = np.einsum("twf,wf->t", pooled, self.out) + self.base[0]
        chance = _logistic(logits.astype(float))
        loss = -np.sum(weights * (labels * np.log(chance + 1e-12) + (1 - labels) * np.log(1 - chance + 1e-12)))
        error = (weights * (chance - labels)).astype(np.float32)

        slope = error[:, None, None] * self.out * (pooled > 0)  # of each filter at its peak
        found = {
            "out": np.einsum("t,twf->wf", error, pooled),
            "base": error.sum(keepdims=True),
            "bias": slope.sum(axis=0),
            "filters": np.zeros_like(self.filters),
        }
        moved = np.zeros_like(vectors)
        every = np.arange(FILTERS)
        for width, size in enumerate(WIDTHS):
            for k in range(size):
                at = places[peaks[:, width] + k]  # (texts, filters)
                step = _STEPS[width] + k
                found["filters"][step] = np.einsum("tfd,tf->df", vectors[at], slope[:, width])
                share = slope[:, width, :, None] * self.filters[step].T[every]
                np.add.at(moved, at.ravel(), share.reshape(-1, DIMS))
        words = np.flatnonzero(np.abs(moved).any(axis=1))
        rows, back = np.unique(texts.features[used[words]], return_inverse=True)
        table = np.zeros((len(rows), DIMS), np.float32)
        np.add.at(table, back.ravel(), np.repeat(moved[words], 1 + len(PREFIXES), axis=0))
        real = rows < BUCKETS
        return float(loss), found | {"table": (rows[real], table[real])}

    def fit(
        self, column: pa.Array, labels: np.ndarray, epochs: int | None = None, seed: int = 1,
        common: np.ndarray | None = None, counts: np.ndarray | None = None,
    ) -> Classifier:
        """Train on texts in shuffled batches; both labels weigh alike.

        Features of fewer than ``LEAST_TEXTS`` texts are zero, in training and after. Which these
        are and the number of texts of each label may be given, where the texts are a part of all.
        """
        texts, rng = Texts(column), np.random.default_rng(seed)
        common = texts.common() if common is None else common
        texts.features[~common[texts.features]] = BUCKETS
        counts = np.bincount(labels, minlength=2) if counts is None else counts
        weights = (counts.sum() / (2 * np.maximum(counts, 1)))[labels]
        first = {name: np.zeros_like(getattr(self, name)) for name in self.NAMES}
        second = {name: np.zeros_like(getattr(self, name)) for name in self.NAMES}
        turn = 0
        for _ in range(epochs or max(EPOCHS, -(-TURNS * BATCH // len(labels)))):
            order = rng.permutation(len(labels))
            for b in range(0, len(order), BATCH):
                chosen = order[b : b + BATCH]
                _, slopes = self.gradients(texts, chosen, labels[chosen], weights[chosen] / len(chosen))
                turn += 1
                for name, slope in slopes.items():
                    rows, slope = slope if name == "table" else (slice(None), slope)
                    own = getattr(self, name)
                    m, v = first[name], second[name]
                    m[rows] = 0.9 * m[rows] + 0.1 * slope
                    v[rows] = 0.999 * v[rows] + 0.001 * slope**2
                    step = m[rows] / (1 - 0.9**turn) / (np.sqrt(v[rows] / (1 - 0.999**turn)) + 1e-8)
                    own[rows] -= RATE * (step + DECAY * own[rows])
        self.table[~common] = 0
        return self

    def packed(self) -> bytes:
        """The weights, to be sent to tasks."""
        return b"".join(getattr(self, name).tobytes() for name in self.NAMES)

    def share(self, start: Classifier, texts: int) -> np.ndarray:
        """What these weights, trained on ``texts`` texts from ``start``, add to an average over parts.

        Rows of the table count where the texts changed them, so a rare word is not thinned out by
        parts that lack it. Shares are added up and given to ``average``.
        """
        moved = texts * (self.table != start.table).any(axis=1)
        dense = [getattr(self, name).ravel() for name in self.NAMES[1:]]
        table = (self.table * moved[:, None].astype(float)).ravel()
        return np.concatenate([table, moved, *(x.astype(float) * texts for x in dense), [texts]])

    def average(self, shares: np.ndarray) -> Classifier:
        """These weights, replaced by the average that summed shares stand for."""
        at = BUCKETS + 1
        table, moved, dense, texts = shares[: at * DIMS].reshape(at, DIMS), shares[at * DIMS :][:at], shares[at * (DIMS + 1) : -1], shares[-1]
        found = Classifier.opened(np.concatenate([self.table.ravel(), dense / max(texts, 1)]).astype(np.float32).tobytes())
        rows = moved > 0
        found.table = self.table.copy()
        found.table[rows] = table[rows] / moved[rows, None]
        return found

    @classmethod
    def opened(cls, body: bytes) -> Classifier:
        self, at = cls.__new__(cls), 0
        shapes = ((BUCKETS + 1, DIMS), (sum(WIDTHS), DIMS, FILTERS), (len(WIDTHS), FILTERS), (len(WIDTHS), FILTERS), (1,))
        for name, shape in zip(cls.NAMES, shapes, strict=True):
            size = int(np.prod(shape))
            setattr(self, name, np.frombuffer(body, np.float32, size, at).reshape(shape))
            at += size * 4
        return self


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))
