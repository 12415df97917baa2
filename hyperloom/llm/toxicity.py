"""Toxicity by multiple-instance learning over sentences.

Only documents have labels. A document is toxic if some sentence is, so the
sentences' probabilities combine by noisy-or: 1 - prod(1 - p). Each p is a
logistic score over hashed features of the sentence's words (the word and its
leading letters, so that unseen forms of a known stem score too), and the weights
are trained from document labels through the noisy-or. The same sentence scores
then locate what offends.

The model is fitted on a bounded sample of labelled rows (``MOST_POSITIVE`` and
``MOST_NEGATIVE`` rows, chosen by hash, of ``MOST_BYTES`` bytes of text for each
kind; toxic ones weigh more, as they are fewer); scoring is one pass over all texts
and needs no shuffle. A sentence without evidence has a small probability, the leak,
in training; scores leave it out, so that long texts without evidence score 0.

Defined cases: a null or empty text has no sentence and scores 0; null ids and
repeated rows are scored one by one; repeated and very long sentences count as any
other, the first of equal ones; of sentences that score alike the first is located;
labels that are null are not learned from, repeated labels count once, as toxic if
one is; with no labels of one kind all scores are 0;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table

MOST_POSITIVE, MOST_NEGATIVE = 3000, 5000
#: Of each kind's sampled texts; a text that doesn't fit is passed over.
MOST_BYTES = 16_000_000
DIMENSIONS = 1 << 18
EPOCHS, LEAST_STEPS, RATE, BATCH, LEAST_DOCS, RIDGE = 30, 1000, 1.0, 128, 3, 1e-5
#: A sentence without evidence has this logit, fixed.
BIAS = -8.0
#: The kinds' ratio to this power is the weight of a toxic document.
BALANCE = 0.75
THRESHOLD = 0.7
LONGEST = 400
REMEMBERED = 500_000

SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
WORD = re.compile(r"\w+")


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Spans of sentences; a very long one is cut at spaces."""
    for m in SENTENCE.finditer(text):
        a, b = m.span()
        while b - a > LONGEST + 100:
            cut = text.find(" ", a + LONGEST, b)
            if cut < 0:
                break
            yield a, cut
            a = cut
        yield a, b


def instances(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """(start, end, words) of each sentence that has words, repeated sentences once: saying
    something again adds no evidence, neither for a word nor for a sentence."""
    seen = set()
    for a, b in sentences(text):
        part = text[a:b].strip().lower()
        if part not in seen:
            seen.add(part)
            ws = set(WORD.findall(part))
            if ws:
                yield a, b, ws


def features(word: str) -> list[int]:
    """Hashed features of a lower-case word."""
    keys = {f"={word}", *(f"^{word[:n]}" for n in (3, 4, 5, 6) if len(word) > n)}
    return [xxhash.xxh3_64_intdigest(k) % DIMENSIONS for k in sorted(keys)]


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scorer(self):
        known: dict[str, float] = {}

        def word_score(w: str) -> float:
            s = known.get(w)
            if s is None:
                if len(known) > REMEMBERED:
                    known.clear()
                s = known[w] = float(self.weights[features(w)].sum())
            return s

        def score(text: str) -> list[tuple[int, int, float]]:
            """(start, end, logit) of each instance."""
            return [(a, b, self.bias + sum(map(word_score, ws))) for a, b, ws in instances(text)]

        return score


def softplus(z):
    return np.logaddexp(0.0, z)


def noisy_or(logits, leak: float | None = None) -> float:
    """1 - prod(1 - sigmoid(z)), each factor over that of the logit ``leak`` if one is given."""
    z = np.asarray(logits, dtype=np.float64)
    total = softplus(z).sum() - (0.0 if leak is None else len(z) * softplus(leak))
    return float(-np.expm1(-max(total, 0.0)))


def loss(z: np.ndarray, owner: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Weighted log loss of the noisy-or over the documents' sentence logits z; owner: a sentence's document."""
    total = np.bincount(owner, softplus(z), len(y))
    return float((weight * np.where(y == 1, -np.log(-np.expm1(-total)), total)).sum())


def slopes(z: np.ndarray, owner: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The derivative of ``loss`` by each sentence's logit."""
    total = np.maximum(np.bincount(owner, softplus(z), len(y)), 1e-30)
    by_total = np.where(y == 1, -1.0 / np.expm1(np.minimum(total, 50.0)), 1.0) * weight
    return by_total[owner] / (1.0 + np.exp(-z))


def fit(ids: list[np.ndarray], ends: list[np.ndarray], y: np.ndarray, weight: np.ndarray, seed: int = 2) -> Model:
    """ids[d]: features of document d, sentence after sentence; ends[d]: where each sentence ends."""
    n = len(y)
    seen = np.zeros(DIMENSIONS, dtype=np.int32)
    for x in ids:
        seen[np.unique(x)] += 1
    usable = seen >= LEAST_DOCS
    w, g2 = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-2)
    bias = BIAS
    rng = np.random.default_rng(seed)
    epochs = max(EPOCHS, LEAST_STEPS * BATCH // max(n, 1)) if n and 0 < y.sum() < n else 0
    mean, counted = np.zeros(DIMENSIONS), 0
    for epoch in range(epochs):
        order = rng.permutation(n)
        for s in range(0, n, BATCH):
            docs = [d for d in order[s : s + BATCH] if len(ends[d])]
            if not docs:
                continue
            flat = np.concatenate([ids[d] for d in docs])
            base = np.concatenate([[0], np.cumsum([len(ids[d]) for d in docs])])
            stop = np.concatenate([ends[d] + base[k] for k, d in enumerate(docs)])
            start = np.concatenate([[0], stop[:-1]])
            owner = np.repeat(np.arange(len(docs)), [len(ends[d]) for d in docs])
            z = bias + np.add.reduceat(w[flat], start)
            dz = slopes(z, owner, y[docs], weight[docs]) / len(docs)
            grad = np.bincount(flat, np.repeat(dz, stop - start), DIMENSIONS)
            at = np.flatnonzero((grad != 0) & usable)
            grad = grad[at] + RIDGE * w[at]
            g2[at] += grad * grad
            w[at] -= RATE * grad / np.sqrt(g2[at])
        # The mean of the later epochs depends less on the order of documents than the last one.
        if 2 * epoch >= epochs:
            mean, counted = mean + w, counted + 1
    w = mean / max(counted, 1)
    w[~usable] = 0.0
    return Model(w.astype(np.float32), float(bias))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, y) of at most MOST_POSITIVE and MOST_NEGATIVE labelled documents, by hash order, within MOST_BYTES each."""
    one = labels.groupBy("doc_id").agg(F.max("toxic").alias("y")).where("y IS NOT NULL AND doc_id IS NOT NULL")
    by_hash = F.xxhash64(F.lit(2), "doc_id")
    kinds = ((1, "y = 1", MOST_POSITIVE), (0, "y <> 1", MOST_NEGATIVE))
    parts = [one.where(cond).orderBy(by_hash, "doc_id").limit(most).select("doc_id", F.lit(y).alias("y")) for y, cond, most in kinds]
    # At most MOST_POSITIVE + MOST_NEGATIVE rows of two numbers: a proven bound for broadcast and driver.
    sizes = docs.join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id").groupBy("doc_id", "y").agg(F.sum(F.octet_length("text")).alias("n"))
    chosen, used = [], {0: 0, 1: 0}
    for r in sizes.orderBy(by_hash, "doc_id").collect():
        if used[r["y"]] + (r["n"] or 0) <= MOST_BYTES:
            used[r["y"]] += r["n"] or 0
            chosen.append((r["doc_id"], r["y"]))
    return docs.sparkSession.createDataFrame(chosen, T.StructType([one.schema["doc_id"], T.StructField("y", T.IntegerType())]))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """From docs (doc_id, text) and labels (doc_id, toxic); the sample's features go to the driver as packed integers."""
    sample = _sample(docs, labels)

    def run(batches):
        for batch in slices(batches):
            packed, stops = [], []
            known: dict[str, list[int]] = {}
            for t in batch.column(1).to_pylist():
                flat: list[int] = []
                ends = []
                for _, _, ws in instances(t or ""):
                    for w in sorted(ws):
                        f = known.get(w)
                        if f is None:
                            f = known[w] = features(w)
                        flat += f
                    ends.append(len(flat))
                packed.append(np.array(flat, dtype=np.int32).tobytes())
                stops.append(np.array(ends, dtype=np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), pa.array(stops, pa.binary())], ["y", "ids", "ends"])

    rows = docs.join(F.broadcast(sample), "doc_id").select("y", "text").mapInArrow(run, "y int, ids binary, ends binary").collect()
    rows.sort(key=lambda r: (r["y"], bytes(r["ends"]), bytes(r["ids"])))
    y = np.array([r["y"] for r in rows], dtype=np.int64)
    ids = [np.frombuffer(r["ids"], dtype=np.int32) for r in rows]
    ends = [np.frombuffer(r["ends"], dtype=np.int32) for r in rows]
    positive = max(1, int(y.sum()))
    return fit(ids, ends, y, np.where(y == 1, ((len(y) - positive) / positive) ** BALANCE, 1.0))


def score(docs: DataFrame, model: Model, doc_id="doc_id", text="text") -> DataFrame:
    """Rows (doc_id, score, n_sentences, n_offending, worst_start, worst_end)."""

    def run(batches):
        scorer = model.scorer()
        for batch in slices(batches):
            out = []
            for t in batch.column(1).to_pylist():
                found = scorer(t or "")
                worst = max(found, key=lambda x: x[2], default=None)
                hit = worst is not None and worst[2] >= 0
                out.append((noisy_or([z for _, _, z in found], model.bias), len(found), sum(z >= 0 for _, _, z in found), worst[0] if hit else None, worst[1] if hit else None))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True))],
                ["doc_id", "score", "n_sentences", "n_offending", "worst_start", "worst_end"],
            )

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double, n_sentences long, n_offending long, worst_start long, worst_end long")


def locate(docs: DataFrame, model: Model, least: float = 0.5, doc_id="doc_id", text="text") -> DataFrame:
    """Rows (doc_id, start, end, p, sentence) for every sentence with p >= least."""
    cut = float(np.log(least) - np.log1p(-least))

    def run(batches):
        scorer = model.scorer()
        for batch in slices(batches):
            out = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += [(d, a, b, float(1 / (1 + np.exp(-z))), t[a:b]) for a, b, z in scorer(t or "") if z >= cut]
            if out:
                kinds = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "start", "end", "p", "sentence"])

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, start long, end long, p double, sentence string")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    df = score(docs, train(docs, labels))
    return df.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_sentences", "n_offending", "worst_start", "worst_end")
