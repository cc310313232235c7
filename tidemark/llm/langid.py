"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by gradient descent in numpy.

Subwords are the runs of two, three and four bytes of the lower-cased text that don't cross white space (which may stand at
their ends, so that starts and ends of words show). A text is the mean of its subwords' embeddings. As all that is linear,
the trained embeddings are multiplied with the softmax weights once, and a prediction adds up one short row per subword.

The model learns from a bounded sample: SAMPLE_DOCS labelled rows with the least hashes of their ids, SNIPPETS stretches
of each, spread evenly over the whole text and taken on the executors. Every fifth row is left out of training and calibrates, by its stretches and its whole text
(scored on the executors too): a temperature makes the mean score the share of right ones,
and texts whose score is below a threshold that KEEP of the calibration texts pass are rejected. Predictions read whole texts.

A null text, or one without a letter, is "und" with score 0. Without any labelled row to learn from, every text is. Rows with
a null id or a null label aren't learned from; labels are compared as they are. Rows that repeat an id or text are rows of their own. Very long texts are
read in blocks. An empty table gives no rows. Extra columns are carried along by predicted(), or left out by its parameter keep.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .words import SPACE, blocks

BUCKETS = 1 << 16
DIMENSIONS = 12
SAMPLE_DOCS = 4000
SNIPPET_BYTES, SNIPPETS = 200, 6
EPOCHS, BATCH, RATE = 4, 128, 2.0
KEEP = 0.999
SEED = 7
UNKNOWN = "und"
_FACTOR = np.uint32(2654435761)


def subwords(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of lower-cased texts (BUCKETS: crosses white space, to be ignored), and where each text's start."""
    joined = b"".join(b" " + t + b"   " for t in texts)
    data = np.frombuffer(joined, np.uint8)
    space = SPACE[data]
    n = len(data) - 3
    four = data[:n].astype(np.uint32) | data[1 : n + 1].astype(np.uint32) << np.uint32(8) | data[2 : n + 2].astype(np.uint32) << np.uint32(16) | data[3:].astype(np.uint32) << np.uint32(24)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    out = np.empty((n, 3), np.int32)
    inner = ~space[1 : n + 1]
    for k, (mask, ok) in enumerate(((0xFFFF, ~(space[:n] & space[1 : n + 1])), (0xFFFFFF, inner), (0xFFFFFFFF, inner & ~space[2 : n + 2]))):
        out[:, k] = np.where(ok, ((four & np.uint32(mask)) * _FACTOR + np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)) * _FACTOR >> shift, BUCKETS)
    starts = np.zeros(len(texts), np.int64)
    np.cumsum([len(t) + 4 for t in texts[:-1]], out=starts[1:])
    return out, starts


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # a row per bucket: what it adds to each label; the last: of nothing
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """Of lower-cased texts in UTF-8, of any length."""
        sums, counts = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts))
        for at, some in blocks(texts, 1 << 18):
            found, starts = subwords(some)
            total, n = np.zeros((len(some), len(self.labels))), np.zeros(len(some))
            starts = np.minimum(starts, len(found) - 1)
            for k in range(3):
                total += np.add.reduceat(self.table[found[:, k]], starts, axis=0, dtype=np.float64)
                n += np.add.reduceat(found[:, k] < BUCKETS, starts, dtype=np.int64)
            np.add.at(sums, at, total)
            np.add.at(counts, at, n)
        return sums / np.maximum(counts, 1)[:, None] + self.bias

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        return _softmax(self.logits(texts) / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def normal(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _snippets(text: bytes) -> list[bytes]:
    """Stretches spread evenly over the text, so that short texts are learned too."""
    if len(text) <= SNIPPET_BYTES:
        return [text]
    starts = np.linspace(0, len(text) - SNIPPET_BYTES, min(SNIPPETS, len(text) // SNIPPET_BYTES)).astype(int)
    return [text[s : s + (SNIPPET_BYTES >> (k % 3))] for k, s in enumerate(starts)]


def train(rows: list[tuple[str, str]], seed: int = SEED) -> Model:
    """From (text, label) pairs in a fixed order."""
    rows = [(normal(text), label) for text, label in rows if has_letter(text)]
    model = learned([(_snippets(text), label) for text, label in rows], seed)
    if model.labels:
        held = held_out(rows)
        calibrate(model, [(_snippets(text), label, len(text)) for text, label in held], model.logits([text for text, _ in held]))
    return model


def held_out(rows: list) -> list:
    return [r for k, r in enumerate(rows) if k % 5 == 4] or rows


def learned(rows: list[tuple[list[bytes], str]], seed: int = SEED) -> Model:
    """Not calibrated, from the snippets and labels of rows in a fixed order."""
    labels = sorted({label for _, label in rows})
    if not labels:
        return Model([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0))
    examples = [(s, labels.index(label)) for k, (snippets, label) in enumerate(rows) if k % 5 != 4 or len(rows) < 5 for s in snippets]
    random = np.random.default_rng(seed)
    embedding = random.normal(0, 0.1, (BUCKETS + 1, DIMENSIONS)).astype(np.float32)
    embedding[BUCKETS] = 0
    weights, bias = np.zeros((DIMENSIONS, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    weights[:] = random.normal(0, 0.3, weights.shape)
    steps, total = 0, EPOCHS * -(-len(examples) // BATCH)
    for _ in range(EPOCHS):
        order = random.permutation(len(examples))
        for a in range(0, len(order), BATCH):
            batch = [examples[k] for k in order[a : a + BATCH]]
            found, starts = subwords([t for t, _ in batch])
            owner = np.repeat(np.arange(len(batch)), np.diff(np.append(starts, len(found))))
            flat, owner = found.ravel(), np.repeat(owner, 3)
            real = flat < BUCKETS
            flat, owner = flat[real], owner[real]
            counts = np.maximum(np.bincount(owner, minlength=len(batch)), 1)
            mean = np.stack([np.bincount(owner, embedding[flat, d], len(batch)) for d in range(DIMENSIONS)], axis=1) / counts[:, None]
            error = _softmax(mean @ weights + bias)
            error[np.arange(len(batch)), [y for _, y in batch]] -= 1
            rate = RATE * (1 - steps / total) / len(batch)
            back = error @ weights.T / counts[:, None]
            weights -= rate * (mean.T @ error)
            bias -= rate * error.sum(axis=0)
            used, place = np.unique(flat, return_inverse=True)
            for d in range(DIMENSIONS):
                embedding[used, d] -= rate * len(batch) * np.bincount(place, back[owner, d], len(used))
            steps += 1
    model = Model(labels, (embedding @ weights).astype(np.float32), bias.astype(np.float64))
    model.table[BUCKETS] = 0
    return model


def calibrate(model: Model, held: list[tuple[list[bytes], str, int]], whole: np.ndarray) -> None:
    """On rows left out, whole and in snippets: snippets, label and bytes of each, and the logits of the whole texts."""
    parts = [(s, model.labels.index(y)) for snippets, y, size in held if size > SNIPPET_BYTES for s in dict.fromkeys(snippets)]
    logits = np.concatenate([whole, model.logits([s for s, _ in parts])]) if parts else whole
    truth = np.array([model.labels.index(y) for _, y, _ in held] + [y for _, y in parts])
    # The temperature at which the mean score is the (smoothed) share of texts that are right.
    right = ((logits.argmax(axis=1) == truth).sum() + 0.5) / (len(truth) + 1)
    model.temperature = float(min(np.geomspace(0.02, 50, 120), key=lambda t: abs(_softmax(logits / t).max(axis=1).mean() - right)))
    best = _softmax(logits / model.temperature).max(axis=1)
    model.threshold = float(min(0.5, np.quantile(best, 1 - KEEP)))


def fold(id_col: str = "doc_id") -> Column:
    """A null id counts as the text "null"."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary"))


def fit(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    """A model from the sample of labelled rows (of those where learn holds)."""
    labelled = docs.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    if learn is not None:
        labelled = labelled.where(learn)
    rows = labelled.select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(id_col).cast("string").alias("id"), F.col(label_col).alias("label"), F.col(text_col).alias("text"))
    small_batches(docs.sparkSession)
    # Hashes are ranked first, so that few texts but the sample's are looked at.
    last = rows.select("h").orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    if last is None:
        return train([])
    rows = rows.where(F.col("h") <= last)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normal(t) if has_letter(t) else None for t in batch.column(3).to_pylist()]
            snippets = pa.array([None if t is None else _snippets(t) for t in texts], pa.list_(pa.binary()))
            digest = pa.array([None if t is None else hashlib.md5(t).hexdigest() for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], digest, snippets, pa.array([len(t or b"") for t in texts], pa.int64())], names=["h", "id", "label", "digest", "snippets", "size"])

    found = rows.mapInArrow(short, "h long, id string, label string, digest string, snippets array<binary>, size long")
    sample = [r for r in found.orderBy("h", "id", "label", "digest").limit(SAMPLE_DOCS).collect() if r["digest"] is not None]
    model = learned([([bytes(s) for s in r["snippets"]], r["label"]) for r in sample])
    held = held_out(sample)
    if not held:
        return model
    shared = docs.sparkSession.sparkContext.broadcast((model, {(r["h"], r["digest"]) for r in held}))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, wanted = shared.value
        hashes, done = {h for h, _ in wanted}, set()
        for batch in batches:
            for h, text in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
                if h in hashes and has_letter(text := text.as_py()) and (key := (h, hashlib.md5(own := normal(text)).hexdigest())) in wanted - done:
                    done.add(key)
                    yield pa.RecordBatch.from_pydict({"h": [key[0]], "digest": [key[1]], "logits": pa.array([model.logits([own])[0]], pa.list_(pa.float64()))})

    whole = {(r["h"], r["digest"]): r["logits"] for r in rows.mapInArrow(scored, "h long, digest string, logits array<double>").collect()}
    calibrate(model, [([bytes(s) for s in r["snippets"]], r["label"], r["size"]) for r in held], np.array([whole[r["h"], r["digest"]] for r in held]))
    return model


def predicted(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (all of docs) with lang_pred, score and rejected. Without keep, columns of docs with these names are replaced."""
    shared, columns = docs.sparkSession.sparkContext.broadcast(model), keep if keep is not None else [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    text_at = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            label, score, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
            some = [k for k, t in enumerate(texts) if model.labels and has_letter(t)]
            if some:
                p = model.probabilities([normal(texts[k]) for k in some])
                for k, best, value in zip(some, p.argmax(axis=1), p.max(axis=1), strict=True):
                    label[k], score[k], rejected[k] = model.labels[best], float(min(1.0, value)), bool(value < model.threshold)
            yield pa.RecordBatch.from_arrays([*batch.columns[:text_at], pa.array(label), pa.array(score), pa.array(rejected)], names=[*columns, "lang_pred", "score", "rejected"])

    small_batches(docs.sparkSession)
    unused = "text" + "_" * max([0, *map(len, columns)])  # longer than any other name
    chosen = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(text_col).alias(unused))
    schema = docs.select(*[F.col(f"`{c}`") for c in columns]).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return chosen.mapInArrow(run, schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, fold() % 3 != 1)
    out = predicted(docs.select("doc_id", "text", (fold() % 3 == 1).alias("held_out")), model, keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")
