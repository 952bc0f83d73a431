"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier on its posteriors.

1. Voters. Words and word starts (4 to 8 bytes) are counted in a bounded sample of labelled texts, counts kept where
   they are made and summed by Spark; those that lean towards toxic texts become lexicon voters, to which a few fixed
   pattern voters are added. A voter votes "toxic" where it fires and else abstains.
2. Label model. Expectation maximisation over the sample's votes estimates each voter's firing rates in both classes;
   voters whose votes are correlated (phi of 0.8 or more, e.g. a word and its own start) share one vote's weight.
3. Classifier. A logistic regression on the same votes is trained on the posteriors and scores every whole text.

The sample's bound is a parameter (``sample`` rows of each label, lowest hash of doc_id first); the votes of at most
2 * sample texts and at most ``voters`` voters reach the driver. Scores read the text alone.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomctx.llm.stage import raw_text, small_batches
from loomctx.llm.textkernel import blocks

STARTS = range(4, 9)
#: Letters, digits and all bytes of longer characters make words; A-Z are lower-cased.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
PATTERNS = ("shouting", "exclaiming", "second_person")
_SECOND = (b" you ", b" your ", b" tu ", b" du ", b" vous ", b" usted ")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo ``folds``, equals ``fold``; null ids aren't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def _words(body: bytes) -> set[bytes]:
    return set(body.translate(_TABLE).split())


def _features(words: set[bytes]) -> set[bytes]:
    """Words, and starts marked with a ``*`` (which is in no word)."""
    return words.union(*({w[:k] + b"*" for w in words if len(w) > k} for k in STARTS)) if words else words


def _patterns(body: bytes) -> list[str]:
    letters = sum(body.count(bytes([c])) for c in range(65, 91)) if len(body) > 20 else 0
    out = [PATTERNS[0]] if letters * 2 > len(body) and letters > 10 else []
    out += [PATTERNS[1]] if body.count(b"!") * 50 > len(body) and body.count(b"!") > 2 else []
    flat = b" " + body.translate(_TABLE) + b" "
    return out + ([PATTERNS[2]] if sum(flat.count(s) for s in _SECOND) > 2 else [])


class Lexicon:
    """Finds voters' words and starts in a text: one lookup for each distinct word of four bytes or more."""

    def __init__(self, voters: list[bytes]):
        self.index = {v: i for i, v in enumerate(voters)}
        self.short = {v for v in voters if len(v.rstrip(b"*")) < 4}
        self.heads = {v[:4] for v in voters if v not in self.short}

    def votes(self, body: bytes) -> set[int]:
        words, index = _words(body), self.index
        out = {index[w] for w in words & self.short} if self.short else set()
        for w in words:
            if w[:4] in self.heads:
                if (i := index.get(w)) is not None:
                    out.add(i)
                for k in STARTS:
                    if len(w) > k and (i := index.get(w[:k] + b"*")) is not None:
                        out.add(i)
        return out | {index[p.encode() + b"!"] for p in _patterns(body) if p.encode() + b"!" in index}


def _count(batches):
    counts: Counter = Counter()
    for batch in batches:
        for body, toxic in zip(batch.column("body").to_pylist(), batch.column("toxic").to_pylist()):
            counts.update((f, toxic) for f in _features(_words(body or b"")))
    if counts:
        yield pa.RecordBatch.from_pydict({"feature": pa.array([f for f, _ in counts], pa.binary()), "toxic": pa.array([t for _, t in counts], pa.int32()), "n": pa.array(counts.values(), pa.int64())})


def _vote(voters: list[bytes]):
    def kernel(batches):
        lexicon = Lexicon(voters)
        for batch in batches:
            votes = [sorted(lexicon.votes(b or b"")) for b in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(votes, pa.list_(pa.int32()))], names=["toxic", "votes"])

    return kernel


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 10) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of each row, weight of each voter, prior log-odds). votes: rows x voters, 0 or 1.

    The labels start the estimate and stay as one observation among the votes (weight 2); rates are smoothed.
    """
    v = votes.astype(np.float64)
    posterior = np.where(labels == 1, 0.9, 0.1)
    centred = v - v.mean(0)
    scale = np.sqrt((centred**2).sum(0)) + 1e-12
    phi = (centred / scale).T @ (centred / scale)
    share = 1 / np.maximum(1, (phi >= 0.8).sum(1))
    for _ in range(rounds):
        p, q = posterior, 1 - posterior
        fires = ((p @ v) + 0.1) / (p.sum() + 1), ((q @ v) + 0.1) / (q.sum() + 1)
        weight = share * np.log(fires[0] / fires[1])
        prior = float(np.log((p.sum() + 1) / (q.sum() + 1)))
        posterior = 1 / (1 + np.exp(-np.clip(prior + v @ weight + np.where(labels == 1, 2.0, -2.0), -30, 30)))
    return posterior, weight, prior


def linear_classifier(votes: np.ndarray, posterior: np.ndarray, steps: int = 300, rate: float = 0.5, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression with soft labels; Adam, deterministic."""
    v = votes.astype(np.float64)
    weight = 1 / len(v)
    w, b = np.zeros(v.shape[1]), 0.0
    m, s = np.zeros(v.shape[1] + 1), np.zeros(v.shape[1] + 1)
    for t in range(1, steps + 1):
        error = weight * (1 / (1 + np.exp(-(v @ w + b))) - posterior)
        g = np.append(v.T @ error + decay * w, error.sum())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        step = rate * 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def calibrated(margins: np.ndarray, labels: np.ndarray) -> float:
    """Shift of the bias that puts 0.5 in the middle of the gap with the best F1 on the training rows."""
    order = np.argsort(-margins, kind="stable")
    m, hits = margins[order], np.cumsum(labels[order] == 1)
    f1 = 2 * hits / (np.arange(1, len(m) + 1) + max(1, int((labels == 1).sum())))
    f1[:-1][m[:-1] == m[1:]] = -1  # no gap there
    k = int(np.argmax(f1))
    return -float((m[k] + m[min(k + 1, len(m) - 1)]) / 2)


def _score(voters: list[bytes], weights: list[float], bias: float):
    def kernel(batches):
        lexicon, w = Lexicon(voters), weights
        for batch in batches:
            ids, bodies = batch.column("doc_id"), [x or b"" for x in batch.column("body").to_pylist()]
            for first, run in blocks(bodies):
                margin = np.array([bias + sum(w[i] for i in lexicon.votes(x)) for x in run])
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(run)), pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30))))], names=["doc_id", "score"])

    return kernel


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, voters: int = 512, folds: int = 5, fold: int = 0) -> tuple[list[bytes], list[float], float]:
    """Voters, their weights and the bias, from labelled rows outside the held-out fold.

    Rows without a label, id or text of their own are not used; of several labels of one id the toxic one counts. With no
    labels, or labels of one class, there are no voters and every score is 0.5 or that class's side.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"), folds, fold)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).union(known.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = raw_text(docs).join(F.broadcast(chosen), "doc_id")  # at most 2 * sample ids
    n = dict.fromkeys((0, 1), 0) | {r["toxic"]: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    if not n[0] or not n[1]:
        return [], [], (2.0 if n[1] else -2.0) if n[0] or n[1] else 0.0
    spec = {t: F.sum(F.when(F.col("toxic") == t, F.col("n")).otherwise(0)) for t in (0, 1)}
    counted = rows.select("body", "toxic").mapInArrow(_count, "feature binary, toxic int, n long").groupBy("feature").agg(spec[1].alias("pos"), spec[0].alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (n[1] + 1)) - F.log((F.col("neg") + 0.5) / (n[0] + 1))
    least = max(3, n[1] // 200)
    best = counted.withColumn("odds", odds).where((F.col("pos") >= least) & (F.col("odds") >= 3.0)).orderBy((F.col("odds") * F.col("pos")).desc(), "feature").limit(voters - len(PATTERNS))
    names = [bytes(r["feature"]) for r in best.collect()] + [p.encode() + b"!" for p in PATTERNS]
    cast = rows.select("body", "toxic").mapInArrow(_vote(names), "toxic int, votes array<int>").collect()  # at most 2 * sample rows
    if not cast:
        return [], [], 0.0
    cast.sort(key=lambda r: (r["toxic"], r["votes"]))
    matrix = np.zeros((len(cast), len(names)), np.float32)
    for i, r in enumerate(cast):
        matrix[i, r["votes"]] = 1
    known_labels = np.array([r["toxic"] for r in cast])
    posterior, _, _ = label_model(matrix, known_labels)
    weights, bias = linear_classifier(matrix, posterior)
    return names, [float(x) for x in weights], bias + calibrated(matrix @ weights + bias, known_labels)


def toxicity(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``; null and empty texts get the bias's score.

    Repeated rows are each scored; other columns are not read; an empty table gives an empty result.
    """
    names, weights, bias = fit(docs, labels, **parameters)
    scored = raw_text(docs).mapInArrow(_score(names, weights, bias), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), parameters.get("folds", 5), parameters.get("fold", 0)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _drop(voters: list[bytes], weights: list[float], bias: float):
    def kernel(batches):
        lexicon = Lexicon(voters)
        for batch in batches:
            bodies = batch.column("text").cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([bias + sum(weights[i] for i in lexicon.votes(b or b"")) < 0 for b in bodies], pa.bool_()))

    return kernel


def not_toxic(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that ``toxicity`` predicts 0 for, with all their columns; scored and dropped in one pass, by row, so ids don't matter."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_drop(*fit(docs, labels, **parameters)), docs.schema)
