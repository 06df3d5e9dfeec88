"""Toxicity by compression distance.

Two Zstandard dictionaries are trained, one on toxic and one on ordinary text. A text
is cut into short windows, each window is compressed with both, and the bytes saved
by the toxic dictionary against the ordinary one are its gain. A document is judged
by how many of its windows gain more than each of a few thresholds; a logistic
calibration on labelled documents turns these counts into a score.

Both dictionaries begin with the same words, the most frequent of both classes, so that what ordinary language saves
cancels out; the rest of each is what significantly more documents of its class hold.
Windows are followed by a primer that both dictionaries hold, so a frame always has a
match and is never stored raw; the gain is then what the dictionaries' own segments save.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from tapeforge.llm.common import filter_rows, map_rows

# Bounds of the sample the model is fitted on, and shape parameters.
FIT_DOCS = 2500        # labelled documents per class, the first in a hash order
WINDOW, OVERLAP = 40, 14
THRESHOLDS = (2, 3, 4, 5, 6)
MIN_DOCS = 4           # documents of the class that must hold a segment, whatever the class's size
SIGNIFICANT = 6.0      # standard errors between the classes' shares of documents that hold it
LIFT = 4.0             # how much larger the share is in the class
DICTIONARY = 16384     # bytes of a dictionary, half of them for words frequent in both classes
PRIMER = b"<<0123456789|9876543210|abcdefghij|ABCDEFGHIJ>>"


def normalised(text: str | None) -> bytes:
    """UTF-8, lower case, words parted by single spaces."""
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").split())


def _prefixes(word: bytes) -> list[bytes]:
    """Word beginnings, and a short word with its end, which is needed for a match of some length."""
    return [word[:k] for k in range(4, min(len(word), 8) + 1)] + ([word + b" "] if len(word) < 7 else [])


class _Side:
    """What one class's texts hold. A word in the same company (the words beside it) counts once, and for the first
    document that has it, so copies and repeated lines add nothing."""

    def __init__(self, texts: list[bytes]):
        self.ids: dict[bytes, int] = {}
        parts = []
        for t in texts:
            w = t.split()
            parts.append(np.fromiter((self.ids.setdefault(x, len(self.ids)) for x in w), np.uint64, len(w)) + 1)
        word = np.concatenate([np.r_[p, [0]] for p in parts] or [np.empty(0)]).astype(np.uint64)
        doc = np.repeat(np.arange(len(parts)), [len(p) + 1 for p in parts])
        key = word * np.uint64(0x9E3779B97F4A7C15) + np.roll(word, 1) * np.uint64(0xC2B2AE3D27D4EB4F) + np.roll(
            word, -1) * np.uint64(0x165667B19E3779F9)
        first = np.unique(key, return_index=True)[1]
        first = first[word[first] > 0]
        word, doc = word[first].astype(np.int64) - 1, doc[first]
        self.words, self.docs = len(word), len(np.unique(doc))
        self.count = np.bincount(word, minlength=len(self.ids))
        self.times: Counter = Counter()
        for w, i in self.ids.items():
            for p in _prefixes(w):
                self.times[p] += int(self.count[i])
        order = np.argsort(word, kind="stable")
        self.doc_of = doc[order]
        self.ends = np.cumsum(self.count)

    def documents(self, wanted: set[bytes]) -> dict[bytes, int]:
        """Documents that hold each of some word beginnings."""
        held: dict[bytes, set[int]] = {}
        for w, i in self.ids.items():
            for p in _prefixes(w):
                if p in wanted:
                    held.setdefault(p, set()).update(self.doc_of[self.ends[i] - self.count[i]:self.ends[i]].tolist())
        return {p: len(d) for p, d in held.items()}


def _typical(own: _Side, other: _Side) -> list[bytes]:
    """Word beginnings that significantly more documents of one class hold, most significant first; as short as they are
    still typical, or as long as most of their occurrences allow."""
    often = {p for p, n in own.times.items() if n >= MIN_DOCS }
    here, there = own.documents(often), other.documents(often)

    def z(a: int, b: int) -> float:
        pooled = (a + b) / (own.docs + other.docs)
        return (a / own.docs - b / other.docs) / ((pooled * (1 - pooled) + 1e-9) * (1 / own.docs + 1 / other.docs)) ** 0.5

    score = {}
    for p, a in here.items():
        b = there.get(p, 0)
        if a >= MIN_DOCS and a / own.docs >= LIFT * (b + 0.5) / other.docs and (v := z(a, b)) >= SIGNIFICANT:
            score[p] = v
    out: dict[bytes, float] = {}
    for p, v in score.items():
        if not p.endswith(b" ") and any(p[:k] in score for k in range(4, len(p))):
            continue
        n = own.times[p]
        while more := [e for e in score if len(e) == len(p) + 1 and e.startswith(p) and own.times[e] >= 0.8 * n]:
            p = max(more, key=lambda e: (own.times[e], e))
        out[b" " + p] = v
    return sorted(out, key=lambda s: (-out[s], s))


def _fill(segments: list[bytes], size: int) -> bytes:
    """Whole segments, first ones first, as long as they fit; the first comes last, nearest to what is compressed."""
    taken, used = [], 0
    for s in segments:
        if used + len(s) <= size:
            taken.append(s)
            used += len(s)
    return b"".join(reversed(taken))


def _dictionaries(sides: list[_Side], size: int) -> list[bytes]:
    """The ordinary and the toxic dictionary, by the same procedure: the words most frequent in both classes, so that what both
    save cancels out, and behind them the beginnings typical of the one class against the other."""
    if not (sides[0].docs and sides[1].docs):
        return [b"", b""]
    shares = [{w: side.count[i] / side.words for w, i in side.ids.items()} for side in sides]
    common = sorted(((-min(v, shares[1].get(w, 0)), w) for w, v in shares[0].items() if len(w) >= 4))
    background = _fill([b" " + w + b" " for v, w in common[:size // 16] if v], size // 2)
    return [background + _fill(_typical(sides[k], sides[1 - k]), size - len(background)) for k in (0, 1)]


@dataclass
class ToxicityModel:
    """Contents of the two dictionaries, and the calibration."""

    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def _compressors(self):
        if not hasattr(self, "_pair"):
            shape = zstandard.ZstdCompressionParameters(
                strategy=zstandard.STRATEGY_LAZY2, min_match=5, window_log=17, hash_log=15, chain_log=14, search_log=5,
                write_content_size=False, write_checksum=False, write_dict_id=False,
                format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            self._pair = [zstandard.ZstdCompressor(compression_params=shape, dict_data=zstandard.ZstdCompressionDict(
                d + PRIMER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress for d in (self.ordinary, self.toxic)]
        return self._pair

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_pair"}

    def features(self, text: str | None) -> np.ndarray:
        """Largest gain, mean of the three largest, mean, then number (log) and share of windows per threshold."""
        ordinary, toxic = self._compressors()
        b, step = normalised(text), WINDOW - OVERLAP
        gains = np.fromiter(
            (len(ordinary(w)) - len(toxic(w))
             for w in (b" " + b[i:i + WINDOW] + b" " + PRIMER for i in range(0, max(1, len(b) - OVERLAP), step))),
            np.int32)
        out = [gains.max(), np.sort(gains)[-3:].mean(), gains.mean()]
        for t in THRESHOLDS:
            n = int((gains >= t).sum())
            out += [np.log1p(n), n / len(gains)]
        return np.array(out, float)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts]).reshape(len(texts), -1)
        z = np.c_[np.ones(len(x)), (x - self.mean) / self.scale] @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 5.0) -> np.ndarray:
    """Penalised maximum likelihood by Newton's method; the first column is the intercept."""
    w, penalty = np.zeros(x.shape[1]), ridge * np.r_[1e-3, np.ones(x.shape[1] - 1)]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str | None], labels: list[int], share: float | None = None, dictionary: int = DICTIONARY) -> ToxicityModel:
    """Dictionaries from two of three texts, calibration on the third, which they haven't seen.

    ``share`` is that of label 1 among all labelled documents, if it differs from the sample's: the calibration is
    shifted to it. Without labels of both classes the score is the share of label 1 (a half without any labels).
    """
    y = np.array(labels, float)
    train = [i for i in range(len(texts)) if i % 3]
    rest = [i for i in range(len(texts)) if not i % 3]
    sides = [[normalised(texts[i]) for i in train if labels[i] == c] for c in (0, 1)]
    sides = [_Side(side) for side in sides]
    ordinary, content = _dictionaries(sides, dictionary)
    size = 3 + 2 * len(THRESHOLDS)
    model = ToxicityModel(ordinary, content, np.zeros(size), np.ones(size), np.zeros(size + 1))
    odds = lambda p: np.log(np.clip(p, 1e-3, 1 - 1e-3) / (1 - np.clip(p, 1e-3, 1 - 1e-3)))
    sampled = y.mean() if len(y) else 0.5
    model.weights[0] = odds(sampled if share is None else share)
    if len(set(y[rest].tolist())) == 2:
        x = np.array([model.features(texts[i]) for i in rest])
        model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        model.weights = _logistic(np.c_[np.ones(len(x)), (x - model.mean) / model.scale], y[rest])
        if share is not None:
            model.weights[0] += odds(share) - odds(y[rest].mean())
    return model


def learn(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> ToxicityModel:
    """Fit on labelled documents: at most ``fit_docs`` per class, the first by a hash of doc_id.

    ``labels`` has (doc_id, toxic). Null labels and null doc_ids are ignored, and so are
    documents whose labels contradict each other. Of rows that repeat a doc_id one text is used, that with the least hash.
    """
    known = (labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id")
             .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).where("toxic = _most").drop("_most"))
    share = known.agg(F.avg("toxic")).first()[0]
    order = F.xxhash64("doc_id")
    picked = known.where("toxic = 1").orderBy(order, "doc_id").limit(fit_docs).unionAll(
        known.where("toxic = 0").orderBy(order, "doc_id").limit(fit_docs))
    named = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = named.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).collect()
    rows.sort(key=lambda r: (r.doc_id * 2654435761 % 2**32, r.doc_id, r.text or ""))
    return fit([r.text for r in rows], [r.toxic for r in rows], share)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) for every row; null and empty texts are one empty window and get the score of that.

    Texts of any length are scored whole, window by window. Repeated rows each get a row; other columns are ignored.
    """
    packed = cloudpickle.dumps(model)
    holder: dict[str, ToxicityModel] = {}

    def run(b):
        m = holder.get("m") or holder.setdefault("m", cloudpickle.loads(packed))
        return [b.column(0), m.scores(b.column(1).to_pylist())]

    return map_rows(docs.select("doc_id", "text"), "doc_id long, score double", run)


def reject(docs: DataFrame, model: ToxicityModel, threshold: float) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    packed = cloudpickle.dumps(model)
    holder: dict[str, ToxicityModel] = {}

    def keep(b):
        m = holder.get("m") or holder.setdefault("m", cloudpickle.loads(packed))
        return (m.scores(b.column(b.schema.get_field_index("text")).to_pylist()) < threshold).tolist()

    return filter_rows(docs, keep)
