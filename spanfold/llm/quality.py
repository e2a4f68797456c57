"""Quality scores learned from preference pairs (Bradley-Terry).

Each document has a vector of text statistics.  Pairs of a preferred and a rejected labelled
document give feature differences; logistic loss on them learns one weight for each feature, so a
document's score is its strength.  A quantile of the training scores becomes the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanfold.llm.common import as_bytes, in_batches, long_id, spaced_words

#: The threshold's place on the 0..1 scale.
THRESHOLD = 0.7
#: Labelled documents that the fit sees at most, those of the smallest id hash.
MAX_LABELLED = 20_000
#: Preference pairs drawn from them.
PAIRS = 60_000

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "symbol": b"#*$%&|<>",
    "shout": b"!?", "stop": b".,;:", "bracket": b"()[]{}\"'`", "space": b" \t\n\r\x0b\x0c",
}
_MASKS = np.array([[c in chars for c in range(256)] for chars in _CLASSES.values()], dtype=np.float64).T
N_FEATURES = len(_CLASSES) + 9


def features(text: bytes | None) -> list[float]:
    """Statistics of a whole text, most of them shares between 0 and 1; a null text is empty."""
    text = text or b""
    words = spaced_words(text)
    n, size = max(1, len(words)), max(1, len(text))
    shares = (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _MASKS / size).tolist()
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = shares[0] + shares[1] or 1.0
    distinct = len(set(words))
    return [
        *shares,
        shares[0] / letters,
        math.log1p(len(words)) / 10,
        min(1.0, sum(map(len, words)) / n / 20),
        distinct / n,
        math.log1p(distinct) / math.log1p(n),
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        float(not words),
        float(len(words) < 50),
    ]


@dataclass(frozen=True)
class Ranking:
    """Weights over standardised features, and the score that separates."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    cut: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; THRESHOLD where a document's strength equals the cut."""
        strength = ((x - np.array(self.mean)) / np.array(self.scale)).clip(-8, 8) @ np.array(self.weights)
        z = (strength - self.cut).clip(-30, 30) + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-z))


def differences(z: np.ndarray, label: np.ndarray, pairs: int, seed: int) -> np.ndarray:
    """Features of a preferred document less those of a rejected one, for ``pairs`` drawn pairs."""
    good, bad, rng = np.flatnonzero(label == 1), np.flatnonzero(label == 0), np.random.default_rng(seed)
    return z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]


def bradley_terry(d: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights of the least mean logistic loss on differences, plus half the ridge times their squares, by Newton steps."""
    w = np.zeros(d.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(d @ w).clip(-30, 30)))
        gradient = d.T @ (p - 1) / len(d) + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_pairs(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, seed: int = 17) -> Ranking:
    """Bradley-Terry strengths; the cut is the score quantile of fewest mistakes.

    With labels of one class only there is nothing to prefer: all weights are zero and the cut
    lets everything (only 1) or nothing (only 0) pass; no label at all lets everything pass.
    """
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        cut = 10.0 if len(bad) else -10.0
        return Ranking(tuple(mean), tuple(scale), (0.0,) * len(mean), cut)
    z = ((x - mean) / scale).clip(-8, 8)
    w = bradley_terry(differences(z, label, pairs, seed))
    strength = z @ w
    levels = np.unique(np.quantile(strength, np.linspace(0, 1, 2001)))
    middles = (levels[:-1] + levels[1:]) / 2 if len(levels) > 1 else levels
    order = np.sort(strength[bad]), np.sort(strength[good])
    mistakes = (len(bad) - np.searchsorted(order[0], middles)) + np.searchsorted(order[1], middles)
    best = np.flatnonzero(mistakes == mistakes.min())
    return Ranking(tuple(mean), tuple(scale), tuple(w), float(middles[best[len(best) // 2]]))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(x.as_py()) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.float64()))], names=["label", "x"])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Ranking:
    """Learn from ``labels`` (doc_id, label 0 or 1) at most ``max_labelled`` labelled documents.

    Rows without an id or with another label are not used; repeated labels count once; of documents
    that share an id the text of least hash counts.  So the driver gets a vector for each chosen
    label at most, however often its id stands in ``docs``.
    """
    known = labels.select(long_id(labels), F.col("label").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").distinct()
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_labelled)  # a top-k: its rows are bounded
    texts = docs.select(long_id(docs), as_bytes("text").alias("text"))
    chosen = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = in_batches(chosen.select("label", "text")).mapInArrow(_vectors, "label int, x array<double>").collect()
    x = np.array([r.x for r in rows], dtype=np.float64).reshape(-1, N_FEATURES)
    order = np.lexsort(x.T) if len(x) else []  # row order must not matter
    return fit_pairs(x[order], np.array([r.label for r in rows], dtype=int)[order])


def _score(ranking: Ranking):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column("_text")], dtype=np.float64).reshape(-1, N_FEATURES)
            score = ranking.scores(x)
            rest = batch.drop_columns(["_text"])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32), pa.int32())],
                names=[*rest.schema.names, "score", "predicted"],
            )

    return run


def score(docs: DataFrame, ranking: Ranking, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of every row of ``docs`` with its score and prediction; no shuffle.

    Null and empty texts get the score of an empty text.  Equal texts get equal scores.
    """
    names = [f"_k{i}" for i in range(len(keep))]  # so no column of the input can clash
    picked = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], as_bytes("text").alias("_text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    found = in_batches(picked).mapInArrow(_score(ranking), f"{kinds}, score double, predicted int")
    return found.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "score", "predicted")


def keep_accepted(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """The rows of ``docs``, in its own columns, whose score reaches the threshold; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = docs_names.index("text")
        for batch in batches:
            x = np.array([features((t.as_py() or "").encode()) for t in batch.column(at)], dtype=np.float64).reshape(-1, N_FEATURES)
            yield batch.filter(pa.array(ranking.scores(x) >= THRESHOLD))

    docs_names = list(docs.columns)
    return in_batches(docs).mapInArrow(run, docs.schema)


def held_out(column: str = "doc_id") -> F.Column:
    """The rows whose labels are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Learns ``labels.quality`` from rows that are not held out.  A null id is not held out.
    """
    known = labels.where(~held_out()).select("doc_id", F.col("quality").alias("label"))
    ranking = fit(docs, known, max_labelled)
    scored = score(docs, ranking, ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
