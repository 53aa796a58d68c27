"""Quality by compression: zstandard dictionaries of good and of bad labelled text, and the normalised difference of compressed sizes.

Both dictionaries are zstandard's own training, on all windows of the class's samples. Each text is compressed whole, in windows, with either
one. With g and b the bytes with the good and the bad one, (b - g) / (b + g) and (b - g) over the window's own length say which class's text
it resembles; both are taken over the whole text and at quantiles of its windows. These differences, and nothing else but the reach of the
text (one over the root of its length), go through a logistic calibration to a score. It is fitted out of fold: a training row's
differences come from dictionaries that were trained on the other ``FOLDS - 1`` folds.

Bounds: ``PER_CLASS`` training rows a class, the size of the dictionaries. Within the sample nothing is left out.

Edge cases: null and empty texts are one empty window; without labels of both classes every score is the share of label 1 (0.5 where
there is no label at all); null ids are kept and count as not held out; repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from tesserae.llm import compression
from tesserae.llm.compression import Fold, Logistic

WINDOW, DICTIONARY_BYTES, SEGMENT, PER_CLASS, FOLDS = 200, 65_536, 24, 1500, 4


@dataclass
class Model:
    good: bytes
    bad: bytes
    logistic: Logistic

    def features(self) -> Callable[[list[bytes]], np.ndarray]:
        import zstandard

        chosen = dict(window_log=18, hash_log=16, chain_log=16, search_log=3, min_match=4, target_length=16, strategy=zstandard.STRATEGY_GREEDY)
        good, bad = compression.compressor(self.good, False, **chosen), compression.compressor(self.bad, False, **chosen)

        def of(texts: list[bytes]) -> np.ndarray:
            out = np.empty((len(texts), 10))
            for i, x in enumerate(texts):
                parts = compression.windows(x, WINDOW, 0)
                g = np.array([len(good(w)) for w in parts], float)
                b = np.array([len(bad(w)) for w in parts], float)
                n = np.array([len(w) + 16 for w in parts], float)
                low, high, size = (b - g).sum(), (b + g).sum(), n.sum()
                out[i] = low / high, *np.quantile((b - g) / (b + g), (0, 0.1, 0.25, 0.5, 1)), low / size, *np.quantile((b - g) / n, (0.1, 0.9)), 1 / np.sqrt(size)
            return out

        return of

    def scorer(self) -> Callable[[list[bytes]], np.ndarray]:
        of, logistic = self.features(), self.logistic
        return lambda texts: logistic.score(of(texts))


def _dictionary(texts: list[bytes]) -> bytes:
    return compression.train([w for x in texts for w in compression.windows(x, WINDOW, 0)], DICTIONARY_BYTES, SEGMENT)


def fit(samples: dict[int, list[bytes]], prior: float) -> Model:
    good, bad = samples[1], samples[0]
    if not good or not bad:
        known = bool(good or bad)
        return Model(b"", b"", Logistic(weight=np.array([np.log((prior + 1e-3) / (1 - prior + 1e-3))])) if known else Logistic())
    texts, label = [*good, *bad], np.array([1] * len(good) + [0] * len(bad))
    fold, x = compression.fold_of(texts, FOLDS), np.zeros((len(texts), 10))
    for k in range(FOLDS):
        own = np.flatnonzero(fold == k)
        built = [_dictionary([texts[i] for i in np.flatnonzero((fold != k) & (label == y))]) for y in (1, 0)]
        if len(own):
            x[own] = Model(*built, Logistic()).features()([texts[i] for i in own])
    return Model(_dictionary(good), _dictionary(bad), Logistic.fit(x, label, prior))


#: crc32(doc_id) mod 5 = 0 is held out.
FOLD = Fold(5, 0)


def learn(docs: DataFrame, labels: DataFrame, fold: Fold = FOLD, per_class: int = PER_CLASS) -> Model:
    return fit(*compression.sample(docs, labels, "quality", fold, per_class))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fold: Fold = FOLD, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted (1: good) for every row of docs."""
    return compression.scores(docs, learn(docs, labels, fold, per_class).scorer, fold, threshold)


def good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that the model finds good, their columns as they were."""
    return compression.keep_documents(docs, model.scorer, lambda s: s >= threshold)
