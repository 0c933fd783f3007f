"""Language identification by averaged hashed subword embeddings and a linear softmax.

Subwords are runs of three and four bytes of a lower-cased word with its edges, hashed
into buckets. A text's vector is the mean of its subwords' embeddings. Embeddings and
softmax are trained by stochastic gradient descent in numpy on a bounded sample; a
second sample calibrates the temperature and the score below which a text is rejected.
For scoring, embeddings and softmax fold into one table of logits per bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railweave.llm.common import scan, stratified

UNKNOWN = "und"
BUCKETS, DIMENSIONS = 1 << 15, 16
#: Documents in the training and in the calibration sample; the rest of the corpus is only scored.
TRAIN_DOCS, CALIBRATION_DOCS = 3000, 1000
EPOCHS, STEP, SEED = 6, 4.0, 7
#: Scores are rejected at which guesses are right less often than this part of the way from chance to certainty.
ABOVE_CHANCE = 0.2
#: What rejecting must gain on the calibration documents, so that a few odd ones decide nothing.
EVIDENCE = 5.0
HELD_OUT = 2

_LETTER = regex.compile(r"\p{L}")
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def held_out(doc_id):
    """Documents never learned from: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == HELD_OUT, F.lit(False))


def subwords(text: str) -> np.ndarray:
    """Buckets of all subwords of a whole text."""
    data = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
    space = _SPACES[data]
    code = np.where(space, np.uint32(32), data.astype(np.uint32))
    three = code[:-2] | code[1:-1] << np.uint32(8) | code[2:] << np.uint32(16)
    inside = ~space[1:-1]
    four = three[:-1] | code[3:] << np.uint32(24)
    found = np.concatenate([three[inside], four[inside[:-1] & inside[1:]] ^ np.uint32(0x5BD1E995)])
    found = found * np.uint32(0x9E3779B1)
    found ^= found >> np.uint32(15)
    return (found * np.uint32(0x85EBCA77)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


@dataclass
class Model:
    """langs: what was learned. logits: a row per bucket. threshold: lowest accepted score."""

    langs: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def scores(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, scores = [], np.zeros(len(texts))
        for k, text in enumerate(texts):
            found = subwords(text) if text and self.langs and _LETTER.search(text) else ()
            if not len(found):
                langs.append(UNKNOWN)
                continue
            chance = softmax((self.logits[found].mean(axis=0, dtype=np.float64) + self.bias) / self.temperature)
            best = int(np.argmax(chance))
            langs.append(self.langs[best])
            scores[k] = chance[best]
        return langs, scores


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(samples: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """samples: language, distinct buckets and their shares of the text."""
    langs = sorted({x for x, _, _ in samples})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(SEED)
    embedding = rng.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    weights, bias = np.zeros((DIMENSIONS, len(langs))), np.zeros(len(langs))
    place = {x: k for k, x in enumerate(langs)}
    steps = EPOCHS * len(samples)
    for n in range(steps):
        if n % len(samples) == 0:
            order = rng.permutation(len(samples))
        lang, found, share = samples[order[n % len(samples)]]
        rate = STEP * (1 - n / steps)
        mean = share @ embedding[found]
        error = softmax(mean @ weights + bias)
        error[place[lang]] -= 1
        back = weights @ error
        weights -= rate * np.outer(mean, error)
        bias -= 0.01 * rate * error
        embedding[found] -= rate * share[:, None] * back
    return Model(langs, (embedding @ weights).astype(np.float32), bias)


def calibrate(model: Model, samples: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """Temperature of least loss, then the threshold above which accepting pays.

    With r the required share of right guesses, an accepted text counts 1 - r if right
    and -r if wrong. The threshold is the lowest whose sum is less than EVIDENCE below
    the largest. So wrong labels at all scores and texts in two languages reject nothing,
    and for each wrong text that is rejected at most r / (1 - r) right ones go with it.
    """
    samples = [x for x in samples if x[0] in model.langs]
    if not samples:
        return model
    raw = np.array([share @ model.logits[found] + model.bias for _, found, share in samples])
    truth = np.array([model.langs.index(x) for x, _, _ in samples])
    losses = {t: -np.log(np.maximum(softmax(raw / t)[np.arange(len(raw)), truth], 1e-12)).mean() for t in np.geomspace(0.25, 8, 41)}
    model.temperature = float(min(losses, key=losses.get))
    chance = softmax(raw / model.temperature)
    score, right = chance.max(axis=1), chance.argmax(axis=1) == truth
    order = np.argsort(-score)
    required = (1 - ABOVE_CHANCE) / len(model.langs) + ABOVE_CHANCE
    gain = np.cumsum(right[order] - required)
    whole = np.append(np.diff(score[order]) < 0, True)  # equal scores are accepted together
    lowest = int(np.flatnonzero(whole & (gain > gain[whole].max() - EVIDENCE))[-1])
    # if even the last one may be accepted, nothing that is at least as likely as any other guess is rejected
    model.threshold = 1 / len(model.langs) if lowest == len(order) - 1 else float(score[order[lowest]])
    return model


def _samples(docs: DataFrame, n: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Subword counts of at most n documents, dealt evenly over languages; texts without letters drop out."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, counts = [], []
        for text in batch.column("text").to_pylist():
            found, count = np.unique(subwords(text), return_counts=True)
            kept.append(found.astype(np.uint16).tobytes())
            counts.append(count.astype(np.uint32).tobytes())
        return pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(kept, pa.binary()), pa.array(counts, pa.binary())], ["lang", "found", "count"])

    chosen = stratified(docs.select("doc_id", "text", "lang"), "lang", n).filter(F.col("text").rlike(r"\p{L}")).select("lang", "text")
    out = []
    for row in scan(chosen, run, "lang string, found binary, count binary").collect():
        found, count = np.frombuffer(row["found"], np.uint16).astype(np.int64), np.frombuffer(row["count"], np.uint32).astype(np.float64)
        if len(found):
            out.append((row["lang"], found, count / count.sum()))
    return sorted(out, key=lambda x: (x[0], x[1].tobytes(), x[2].tobytes()))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", train_docs: int = TRAIN_DOCS, calibration_docs: int = CALIBRATION_DOCS) -> Model:
    """Learn from labelled documents that are not held out; a quarter of them by id calibrates."""
    labelled = (docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
                .filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))))
    last = F.crc32(F.col("doc_id").cast("string")) % 4 == 1
    return calibrate(train(_samples(labelled.filter(~last), train_docs)), _samples(labelled.filter(last), calibration_docs))


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score (calibrated, 0 to 1), accepted.

    A null text, or one without letters, is ``und`` with score 0 and rejected, and so is
    everything if nothing was learned. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = shared.value
        langs, scores = known.scores(batch.column("text").to_pylist())
        accepted = [x != UNKNOWN and s >= known.threshold for x, s in zip(langs, scores, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())], ["doc_id", "lang_pred", "score", "accepted"])

    return scan(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, lang_pred string, score double, accepted boolean")


def accepted_only(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents, all columns as they were, whose language is recognised."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    place = names.index(text)
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = shared.value
        langs, scores = known.scores(batch.column(place).to_pylist())
        return batch.filter(pa.array([x != UNKNOWN and s >= known.threshold for x, s in zip(langs, scores, strict=True)], pa.bool_()))

    return scan(plain, run, plain.schema, text=f"c{place}").toDF(*names)
