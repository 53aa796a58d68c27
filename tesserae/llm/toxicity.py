"""Toxicity by compression distance: windows shrink further with a dictionary of toxic text than with one of ordinary text.

Both dictionaries are zstandard's own training. The ordinary one is trained on all windows of the ordinary samples. Toxic words stand thinly
in text that is otherwise like any other, so a dictionary trained on whole toxic texts is an ordinary one; the toxic dictionaries are
therefore trained on stretches of toxic text that ordinary text lacks: runs inside words, made of overlapping pieces of ``SIZES`` bytes that
toxic samples hold in many contexts (preceding words, so that copies of one text count once) and ordinary samples hardly ever. A run
is a training sample as often as it has contexts. Pieces of more than GRAM bytes have parts that ordinary text holds too, so they train a
second toxic dictionary, noisier than the first.

All compressors hold the ordinary dictionary's content, followed by a toxic one's or by as many inert bytes, so equal matches cost the
same and a window's difference is what the toxic dictionary saves. Matches are at least GRAM bytes long, and windows short enough that
zstandard leaves literals as they are: the difference of a window without toxic runs is nearly always 0.

Per document and toxic dictionary the greatest difference, the sum of the positive ones against the root of the number of windows, and how
many windows save two and four bytes or more go through a logistic calibration to a score. It is fitted out of fold: a training row's
differences come from toxic dictionaries that were trained on the other ``FOLDS - 1`` folds.

Bounds: ``PER_CLASS`` training rows a class, the dictionary sizes. Within the sample nothing is left out.

Edge cases: null and empty texts are one empty window and get the score of a text without toxic runs; without labels of both classes
every score is the share of label 1 (0.5 where there is no label at all); null ids are kept and count as not held out; labels are never
read for a score. Repeated rows get equal scores.
"""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from tesserae.llm import compression
from tesserae.llm.compression import Fold, Logistic

WINDOW, OVERLAP, GRAM = 76, 16, 5
SIZES = (5, 6, 7, 8, 9, 10, 12)
PER_CLASS, FOLDS = 1500, 4
#: Sizes of the dictionaries, and the lengths of the pieces that the trainer chooses for them.
ORDINARY_BYTES, TOXIC_BYTES, ORDINARY_SEGMENT, TOXIC_SEGMENT = 4096, 3072, 64, 16
PAD = 10
_MARKS = b".,;:!?\"'()"
#: No text holds it; it ends both dictionaries and starts every window, which so always has a match and is never stored as it is.
PRIME = bytes(range(0x80, 0x98))


def _contexts(texts: list[bytes]) -> dict[bytes, int]:
    """For each word the number of different words before it."""
    seen: dict[bytes, set[bytes]] = defaultdict(set)
    for x in texts:
        before = b""
        for w in x.lower().split():
            w = w.strip(_MARKS)
            seen[w].add(before)
            before = w
    return {w: len(s) for w, s in seen.items()}


def _pieces(words: dict[bytes, int], among: set[bytes] | None = None) -> Counter[bytes]:
    """Contexts of every piece of the words, of all ``SIZES``; ``among``: of these only."""
    out: Counter[bytes] = Counter()
    for w, n in words.items():
        s = b" " + w + b" "
        own = {s[i : i + size] for size in SIZES for i in range(len(s) - size + 1)}
        for g in own if among is None else own & among:
            out[g] += n
    return out


def _total(counts: list[dict[bytes, int]]) -> Counter[bytes]:
    out: Counter[bytes] = Counter()
    for c in counts:
        out.update(c)
    return out


class Counts:
    """Words of toxic texts, and the pieces of theirs and of ordinary texts' words, by fold."""

    def __init__(self, toxic: list[bytes], ordinary: list[bytes], folds: int) -> None:
        split = lambda texts: [[x for x, f in zip(texts, compression.fold_of(texts, folds)) if f == k] for k in range(folds)]
        self.texts = [len(part) for part in split(toxic)]
        self.words, others = ([_contexts(part) for part in split(texts)] for texts in (toxic, ordinary))
        self.sizes = [(sum(w.values()), sum(o.values())) for w, o in zip(self.words, others)]
        # Only pieces of enough contexts can be chosen.
        least = 3 + (len(toxic) - max(self.texts)) / 60
        among = {g for g, n in _pieces(_total(self.words)).items() if n >= least}
        self.pieces, self.there = ([_pieces(w, among) for w in part] for part in (self.words, others))
        self.many, self.there_many = _total(self.pieces), _total(self.there)

    def runs(self, without: int | None = None) -> tuple[Counter[bytes], Counter[bytes]]:
        """Runs of the shortest pieces and of the others, with their contexts; ``without``: a fold that is left out."""
        used = [k for k in range(len(self.texts)) if k != without]
        least = 3 + sum(self.texts[k] for k in used) / 60
        rate = sum(self.sizes[k][0] for k in used) / max(1, sum(self.sizes[k][1] for k in used))
        only: set[bytes] = set()
        for g, n in sorted(((g, n) for g, n in self.many.items() if n >= least), key=lambda x: (len(x[0]), x[0])):
            here, there = n, self.there_many[g]
            if without is not None:
                here, there = here - self.pieces[without][g], there - self.there[without][g]
            if here >= least and there * rate <= 0.02 * here and not any(g[i : i + k] in only for k in SIZES if k < len(g) for i in range(len(g) - k + 1)):
                only.add(g)
        words = _total([self.words[k] for k in used])
        return tuple(_runs(words, {g for g in only if (len(g) == GRAM) == short}) for short in (True, False))


def _runs(words: dict[bytes, int], only: set[bytes]) -> Counter[bytes]:
    """What overlaps inside a word is one run."""
    runs: Counter[bytes] = Counter()
    padded = [b" " + w + b" " for w in words]
    text, starts = b"\n".join(padded), np.cumsum([0, *(len(s) + 1 for s in padded)])
    hits = set()
    for g in only:
        at = text.find(g)
        while at >= 0:
            hits.add(at)
            at = text.find(g, at + 1)
    for k in np.unique(np.searchsorted(starts, sorted(hits), "right") - 1).tolist():
        s, start, stop = padded[k], 0, -1
        n = words[s[1:-1]]
        for i in range(len(s)):
            long = next((k for k in SIZES if s[i : i + k] in only), 0)
            if long and i > stop - GRAM + 1:
                if stop > 0:
                    runs[s[start:stop]] += n
                start, stop = i, i + long
            elif long:
                stop = max(stop, i + long)
        if stop > 0:
            runs[s[start:stop]] += n
    return runs


def train_toxic(runs: Counter[bytes]) -> bytes:
    """A dictionary trained on the runs, each as often as it has contexts.

    The trainer goes through its samples in stretches and chooses the piece of each that holds most of what is frequent. The samples are
    shuffled and repeated, so that each stretch holds them all in proportion, and followed by drawn bytes that no text holds, so that
    the pieces begin and end where runs do and what lies between two runs is none.
    """
    draw, samples = random.Random(5), []
    once = [r for r in sorted(runs) for _ in range(runs[r])]
    if not once:
        return b""
    for _ in range(max(1, -(-100 * TOXIC_BYTES // sum(len(r) + PAD for r in once)))):
        samples += [r + bytes(draw.choices(range(0xF5, 0x100), k=PAD)) for r in once]
    draw.shuffle(samples)
    return compression.content(compression.train(samples, TOXIC_BYTES, TOXIC_SEGMENT))


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    longer: bytes
    logistic: Logistic

    def features(self) -> Callable[[list[bytes]], np.ndarray]:
        import zstandard

        chosen = dict(window_log=15, hash_log=14, chain_log=14, search_log=6, min_match=GRAM, target_length=64, strategy=zstandard.STRATEGY_GREEDY)
        inert = b"\xff" * max(len(self.toxic), len(self.longer))
        made = [compression.compressor(self.ordinary + inert[len(d) :] + d + PRIME, True, **chosen) for d in (inert, self.toxic, self.longer) if d or d is inert]

        def of(texts: list[bytes]) -> np.ndarray:
            out = np.zeros((len(texts), 8))
            for i, x in enumerate(texts):
                parts = [PRIME + w for w in compression.windows(x.lower(), WINDOW, OVERLAP)]
                sizes = [np.array([len(c(w)) for w in parts]) for c in made]
                for k, with_runs in enumerate(sizes[1:]):
                    gain = np.maximum(0, sizes[0] - with_runs)
                    out[i, 4 * k : 4 * k + 4] = gain.max(), gain.sum() / len(gain) ** 0.5, np.log1p((gain >= 2).sum()), np.log1p((gain >= 4).sum())
            return out

        return of

    def scorer(self) -> Callable[[list[bytes]], np.ndarray]:
        of, logistic = self.features(), self.logistic
        return lambda texts: logistic.score(of(texts))


def fit(samples: dict[int, list[bytes]], prior: float) -> Model:
    toxic, ordinary = samples[1], samples[0]
    base = compression.content(compression.train([w for x in ordinary for w in compression.windows(x.lower(), 256, 0)], ORDINARY_BYTES, ORDINARY_SEGMENT))
    if not toxic or not ordinary:
        known = bool(toxic or ordinary)
        return Model(base, b"", b"", Logistic(weight=np.array([np.log((prior + 1e-3) / (1 - prior + 1e-3))])) if known else Logistic())
    counts = Counts(toxic, ordinary, FOLDS)
    texts, label = [*toxic, *ordinary], np.array([1] * len(toxic) + [0] * len(ordinary))
    fold, x = compression.fold_of(texts, FOLDS), np.zeros((len(texts), 8))
    for k in range(FOLDS):
        own = np.flatnonzero(fold == k)
        if len(own):
            x[own] = Model(base, *map(train_toxic, counts.runs(k)), Logistic()).features()([texts[i] for i in own])
    return Model(base, *map(train_toxic, counts.runs()), Logistic.fit(x, label, prior))


#: crc32(doc_id) mod 3 = 1 is held out.
FOLD = Fold(3, 1)


def learn(docs: DataFrame, labels: DataFrame, fold: Fold = FOLD, per_class: int = PER_CLASS) -> Model:
    return fit(*compression.sample(docs, labels, "toxic", fold, per_class))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fold: Fold = FOLD, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted (1: toxic) for every row of docs."""
    return compression.scores(docs, learn(docs, labels, fold, per_class).scorer, fold, threshold)


def clean(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that the model doesn't find toxic, their columns as they were."""
    return compression.keep_documents(docs, model.scorer, lambda s: s < threshold)
