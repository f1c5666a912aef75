"""Toxicity: a convolutional classifier over hashed word embeddings, trained in numpy on all labelled documents.

A word's embedding is the sum of the rows that its hash and the hashes of its first letters
point to, so unseen forms of a known stem are recognised. Filters of several widths run over the words, each
keeps its largest response in the text, and a logistic layer weighs these. Thresholds are
calibrated for each language, which is itself guessed from the words.

A few labelled documents are trained in the driver. More are encoded once; words are counted, minibatches run and
probabilities taken in tasks, whose parameters are averaged after each round.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tillbook.llm.common import SLICE_ROWS, add_columns, map_batches, map_slices, words, written
from tillbook.llm.language import held_out
from tillbook.operators.reduction import reduced

#: Labelled documents of each class up to which they are trained in the driver; with more, tasks train.
COLLECTED_PER_CLASS = 3000
#: Hash values; a value that occurs in fewer training documents than LEAST_DOCUMENTS has no embedding.
BUCKETS, LEAST_DOCUMENTS = 2**22, 5
#: First letters (bytes) of a word that are hashed besides the whole word.
STEMS = (4, 5)
SIZE, WIDTHS, FILTERS = 16, (1, 2, 3), 8
EPOCHS, MINIBATCH, RATE = 6, 32, 0.1
#: Share of the labelled sample that is kept from training to set thresholds.
CALIBRATION = 0.25
#: A language with fewer calibration documents of either class takes the threshold of all.
LEAST_CALIBRATION = 15
#: Hash values where tasks train: what a task or the driver holds of the model is bounded by them.
SHARED_BUCKETS = 2**18
#: Documents that a task trains on in a round, at least, and that it holds at once.
TRAINER, HELD = 1024, 2048
#: Rows of embeddings that a task returns at once.
RETURNED = 4096
#: Steps in which probabilities are counted for the thresholds.
BINS = 10_000
#: Words handled at once; longer texts go through in pieces.
PIECE = 32_768
_CACHED = 400_000
#: A word's hashes, or rows of embeddings, as bytes: what a cache keeps of it, and what joins to an array at once.
_CODES = f"{1 + len(STEMS)}i"


def hashes(word: bytes, buckets: int = BUCKETS) -> tuple[int, ...]:
    """Bucket of the word and of each of its stems."""
    stems = (zlib.crc32(word[:n], n) % buckets if len(word) >= n else 0 for n in STEMS)
    return (zlib.crc32(word) % buckets, *stems)


class Places:
    """The row of each kept bucket, from 1 on: a sorted array, as every worker holds one and a dict takes 25 times its size."""

    def __init__(self, kept: list[int]):
        self.kept = array("i", kept)

    def __contains__(self, bucket: int) -> bool:
        return self.get(bucket, 0) > 0

    def get(self, bucket: int, default: int) -> int:
        at = bisect_left(self.kept, bucket)
        return at + 1 if at < len(self.kept) and self.kept[at] == bucket else default


@dataclass
class Model:
    """Everything a score needs. Row 0 of the embeddings is that of unknown hashes, all zero."""

    row_of: Places
    embeddings: np.ndarray  # rows x SIZE
    filters: list[np.ndarray]  # for each width: width x SIZE x FILTERS
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float
    language_logs: np.ndarray  # rows x languages
    thresholds: np.ndarray  # for each language
    buckets: int = BUCKETS

    def rows(self, word: bytes) -> bytes:
        return struct.pack(_CODES, *(self.row_of.get(h, 0) for h in hashes(word, self.buckets)))

    def pooled(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each piece; pieces follow each other in ``rows``.

        A window may reach beyond the end of its piece only over padding, which the caller puts
        between pieces.
        """
        embedded = self.embeddings[rows].sum(axis=1)
        out = []
        for width, weights, bias in zip(WIDTHS, self.filters, self.biases, strict=True):
            response = embedded @ weights[0]
            for step in range(1, width):
                response[:-step] += embedded[step:] @ weights[step]
            out.append(np.maximum.reduceat(response, starts, axis=0) + bias)
        return np.concatenate(out, axis=1)

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0) @ self.weights + self.bias


def _calibrated(probability: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """Scores that reach 0.5 where the probability reaches the threshold, in order and from 0 to 1."""
    below = 0.5 * probability / threshold
    above = 0.5 + 0.5 * (probability - threshold) / (1 - threshold)
    return np.clip(np.where(probability < threshold, np.minimum(below, np.nextafter(0.5, 0)), above), 0, 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _joined(codes: list[bytes]) -> np.ndarray:
    """A row for each word of its hashes or rows of embeddings."""
    return np.frombuffer(b"".join(codes), np.int32).reshape(-1, 1 + len(STEMS))


def predict(model: Model, texts: list[str | None], cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """Probability and guessed language of each text; its whole words in pieces that overlap by a window."""
    overlap = max(WIDTHS) - 1
    padding = [bytes(struct.calcsize(_CODES))] * overlap
    n_filters = FILTERS * len(WIDTHS)
    best = np.full((len(texts), n_filters), -np.inf, np.float32)
    language = np.zeros((len(texts), model.language_logs.shape[1]))
    rows: list[bytes] = []
    starts: list[int] = []
    owners: list[int] = []

    def flush() -> None:
        if not rows:
            return
        index = _joined(rows)
        np.maximum.at(best, np.array(owners), model.pooled(index, np.array(starts)))
        sums = np.add.reduceat(model.language_logs[index[:, 0]], np.array(starts), axis=0)
        np.add.at(language, np.array(owners), sums)
        rows.clear(), starts.clear(), owners.clear()

    if len(cache) > _CACHED:
        cache.clear()
    for number, text in enumerate(texts):
        found = words(text)
        for start in range(0, max(1, len(found)), PIECE):
            if len(rows) > PIECE:
                flush()
            starts.append(len(rows))
            owners.append(number)
            for word in found[start : start + PIECE + overlap]:
                known = cache.get(word)
                if known is None:
                    known = cache[word] = model.rows(word)
                rows.append(known)
            rows.extend(padding)
    flush()
    guessed = language.argmax(axis=1) if language.shape[1] else np.zeros(len(texts), np.int64)
    return _sigmoid(model.logit(best)), guessed


def _parameters(model: Model) -> list[np.ndarray]:
    """All that is trained but the bias, the embeddings first."""
    return [model.embeddings, *model.filters, *model.biases, model.weights]


def _memory(model: Model) -> list[np.ndarray]:
    """What Adagrad keeps of each parameter at the start, the bias last."""
    return [*(np.full(x.shape, 1e-2, np.float32) for x in _parameters(model)), np.full(1, 1e-2)]


def _grow(
    docs: list[np.ndarray], labels: np.ndarray, model: Model, rng: np.random.Generator, kept: list[np.ndarray], epochs: int = EPOCHS
) -> None:
    """Adagrad over minibatches; only the window that each filter pooled gets a gradient. ``kept`` goes on from call to call."""
    memory = {id(x): m for x, m in zip(_parameters(model), kept, strict=False)}

    def step(parameter: np.ndarray, gradient: np.ndarray, at=slice(None)) -> None:
        memory[id(parameter)][at] += gradient**2
        parameter[at] -= RATE * gradient / np.sqrt(memory[id(parameter)][at])

    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for first in range(0, len(order), MINIBATCH):
            chosen = order[first : first + MINIBATCH]
            starts = np.cumsum([0, *(len(docs[i]) for i in chosen[:-1])])
            rows = np.concatenate([docs[i] for i in chosen])
            embedded = model.embeddings[rows].sum(axis=1)
            responses, pooled = [], []
            ends = np.append(starts[1:], len(rows))
            for weights, bias in zip(model.filters, model.biases, strict=True):
                response = embedded @ weights[0]
                for j in range(1, len(weights)):
                    response[:-j] += embedded[j:] @ weights[j]
                responses.append(np.stack([s + response[s:e].argmax(axis=0) for s, e in zip(starts, ends, strict=True)]))
                pooled.append(response[responses[-1], np.arange(FILTERS)] + bias)
            hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
            error = (_sigmoid(hidden @ model.weights + model.bias) - labels[chosen]).astype(np.float32) / len(chosen)
            to_hidden = error[:, None] * model.weights * (hidden > 0)
            step(model.weights, hidden.T @ error)
            kept[-1][0] += float(error.sum()) ** 2
            model.bias -= RATE * float(error.sum()) / np.sqrt(kept[-1][0])
            touched, changes = [], []
            for k, (weights, bias) in enumerate(zip(model.filters, model.biases, strict=True)):
                back = to_hidden[:, k * FILTERS : (k + 1) * FILTERS]
                gradient = np.zeros_like(weights)
                for j in range(len(weights)):
                    at = np.minimum(responses[k] + j, len(rows) - 1)  # docs x filters
                    gradient[j] = np.einsum("df,dfs->sf", back, embedded[at])
                    touched.append(rows[at].reshape(-1, rows.shape[1]))
                    changes.append((back[:, :, None] * weights[j].T[None]).reshape(-1, SIZE))
                step(weights, gradient)
                step(bias, back.sum(axis=0))
            index = np.concatenate(touched)
            unique, place = np.unique(index, return_inverse=True)
            total = np.zeros((len(unique), SIZE), np.float32)
            change = np.concatenate(changes)
            for column in range(index.shape[1]):
                np.add.at(total, place.reshape(index.shape)[:, column], change)
            total[unique == 0] = 0
            step(model.embeddings, total, unique)


def _begun(kept: list[int], seen: list, n: list[int], languages: int, rng: np.random.Generator, buckets: int = BUCKETS) -> Model:
    """A model before its training: of the kept buckets, in how many of the n documents of either class each was seen."""
    embeddings = rng.normal(0, 0.05, (len(kept) + 1, SIZE)).astype(np.float32)
    embeddings[0] = 0
    shares = [np.array(seen[c], float) + 0.5 for c in (0, 1)]
    odds = np.log(shares[1] / (n[1] + 1)) - np.log(shares[0] / (n[0] + 1))
    embeddings[1:, 0] = np.clip(odds / np.sqrt(1 / shares[0] + 1 / shares[1]) / 3, -2, 2)
    filters = [rng.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    for weights in filters:
        weights[0, 0, : FILTERS // 2] = 1.0
    return Model(
        Places(kept),
        embeddings,
        filters,
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32),
        0.0,
        np.zeros((len(kept) + 1, languages)),
        np.full(max(1, languages), 0.5),
        buckets,
    )


def train(texts: list[str], labels: list[int], languages: list[str | None], seed: int = 0) -> Model | None:
    """A model of these labelled texts; None if they aren't of both classes."""
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(seed)
    toxic = np.array(labels, np.float32)
    hashed = [np.array([hashes(w) for w in words(t)] or [(0,) * (1 + len(STEMS))], np.int64) for t in texts]
    hashed = [np.concatenate((h, np.full((max(WIDTHS) - 1, h.shape[1]), -1))) for h in hashed]
    apart = rng.random(len(texts)) < CALIBRATION
    if len(set(toxic[~apart])) < 2:
        apart[:] = False
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for h, label, off in zip(hashed, labels, apart, strict=True):
        if not off:
            seen[label].update(np.unique(h).tolist())
    kept = sorted(b for b in set(seen[0]) | set(seen[1]) if b >= 0 and seen[0][b] + seen[1][b] >= LEAST_DOCUMENTS)
    n = [max(1, int((toxic[~apart] == c).sum())) for c in (0, 1)]
    names = sorted({x for x in languages if x is not None})
    model = _begun(kept, [[seen[c][bucket] for bucket in kept] for c in (0, 1)], n, len(names), rng)
    lookup = np.array(kept, np.int64)

    def to_rows(h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(lookup, h)
        at[at == len(lookup)] = 0
        return np.where(lookup[at] == h, at + 1, 0) if len(lookup) else np.zeros_like(h)

    docs = [to_rows(h) for h in hashed]
    for column, name in enumerate(names):
        counts = np.ones(len(kept) + 1)
        for doc, language in zip(docs, languages, strict=True):
            if language == name:
                np.add.at(counts, np.unique(doc[:, 0]), 1)
        model.language_logs[:, column] = np.log(counts / (1 + sum(x == name for x in languages)))
    model.language_logs[0] = 0
    _grow([d for d, off in zip(docs, apart, strict=True) if not off], toxic[~apart], model, rng, _memory(model))
    checked = [i for i, off in enumerate(apart) if off] or list(range(len(texts)))
    probability, guessed = predict(model, [texts[i] for i in checked], {})
    truth = toxic[checked]
    everywhere = _threshold(probability, truth)
    for language in range(len(model.thresholds)):
        own = guessed == language
        enough = min((truth[own] == c).sum() for c in (0, 1)) >= LEAST_CALIBRATION
        model.thresholds[language] = _threshold(probability[own], truth[own]) if enough else everywhere
    return model


def _threshold(probability: np.ndarray, truth: np.ndarray) -> float:
    """Midway in the gap, between two neighbouring probabilities, of most right answers with both classes weighed equally."""
    order = np.argsort(probability, kind="stable")
    sorted_p, sorted_t = probability[order], truth[order]
    weights = np.where(sorted_t == 1, 1 / max(1, (truth == 1).sum()), 1 / max(1, (truth == 0).sum()))
    right = np.cumsum(np.where(sorted_t == 0, weights, 0)) + (weights * (sorted_t == 1)).sum() - np.cumsum(np.where(sorted_t == 1, weights, 0))
    best = np.flatnonzero(right >= right.max() - 1e-12)
    gaps = [(sorted_p[i + 1] if i + 1 < len(sorted_p) else 1.0) - sorted_p[i] for i in best]
    i = int(best[int(np.argmax(gaps))])
    after = sorted_p[i + 1] if i + 1 < len(sorted_p) else 1.0
    return float(np.clip((sorted_p[i] + after) / 2, 0.02, 0.98))


def learn(documents: DataFrame, labels: DataFrame, per_class: int = COLLECTED_PER_CLASS) -> Model | None:
    """A model of all labelled documents; None without both labels.

    A document with several labels counts as toxic if one says so; null labels and texts are left out. Of rows
    that share an id, that with the least text counts. With up to ``per_class`` documents of either label,
    their texts come to the driver and are trained there. With more, all of them are trained in tasks, and what
    the driver gets is bounded by SHARED_BUCKETS and the languages.
    """
    rated = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id"))
    rated = rated.agg(F.max((F.col("toxic") > 0).cast("int")).alias("_toxic"))
    counts = {r["_toxic"]: r["count"] for r in rated.groupBy("_toxic").count().collect()}
    few = max(counts.values(), default=0) <= per_class
    rows = documents.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("_id"), "text", "lang")
    # only rows with a label are shuffled
    rows = rows.join(F.broadcast(rated), "_id") if few else reduced(rows, rated, "_id").join(rated, "_id")
    first = rows.groupBy("_id").agg(F.min(F.struct("text", "lang", "_toxic")).alias("row"))
    if not few:
        return _trained_in_tasks(first.select("_id", "row.*"), EPOCHS * 2 * per_class)
    labelled = first.select("_id", "row.*").collect()
    labelled.sort(key=lambda r: r["_id"])
    return train([r["text"] for r in labelled], [r["_toxic"] for r in labelled], [r["lang"] for r in labelled])


# ---- training in tasks


def _chance(purpose: str) -> Column:
    """A number from 0 to 1 for each document."""
    return F.pmod(F.xxhash64(F.lit(purpose), "_id"), F.lit(2**32)) / F.lit(2.0**32)


def _encoded(labelled: DataFrame) -> DataFrame:
    """(_id, _toxic, lang, codes): buckets of each word and its stems, one after the other, and padding of -1."""

    def make():
        cache: dict = {}
        padding = np.full((max(WIDTHS) - 1, 1 + len(STEMS)), -1, np.int32)

        def codes(text: str) -> np.ndarray:
            if len(cache) > _CACHED:
                cache.clear()
            for word in (found := words(text)):
                if word not in cache:
                    cache[word] = struct.pack(_CODES, *hashes(word, SHARED_BUCKETS))
            rows = _joined([cache[word] for word in found] or [bytes(struct.calcsize(_CODES))])
            return np.concatenate((rows, padding)).ravel()

        def run(batch: pa.RecordBatch) -> dict[str, list]:
            kept = {name: batch.column(name) for name in ("_id", "_toxic", "lang")}
            return kept | {"codes": [codes(text) for text in batch.column("text").to_pylist()]}

        return run

    return map_slices(labelled, "_id long, _toxic int, lang string, codes array<int>", make)


def _documents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, str | None, np.ndarray]]:
    """(_id, toxic, lang, codes of words by row) of each encoded document."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(start, SLICE_ROWS)
            codes = (x.values.to_numpy().reshape(-1, 1 + len(STEMS)) for x in part.column("codes"))
            yield from zip(*(part.column(c).to_pylist() for c in ("_id", "_toxic", "lang")), codes, strict=True)


def _batch_of(schema: StructType, columns: list) -> pa.RecordBatch:
    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def _counted(encoded: DataFrame, learnt: Column, names: list[str]) -> np.ndarray:
    """A row for each bucket that enough documents learnt from hold: the bucket, how many of either class hold it or a stem of it, and how
    many of each language, calibration documents included, hold the word."""
    schema = StructType.fromDDL("kind int, bucket int, n long")
    column = {name: i for i, name in enumerate(names, 2)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}

        def add(kind: int, buckets: np.ndarray) -> None:
            counts.setdefault(kind, np.zeros(SHARED_BUCKETS, np.int64))[buckets[buckets >= 0]] += 1

        for batch in batches:
            learns = batch.column("learnt").to_pylist()
            for learn, (_, toxic, lang, codes) in zip(learns, _documents_of(iter([batch])), strict=True):
                if learn:
                    add(toxic, np.unique(codes))
                if lang in column:
                    add(column[lang], np.unique(codes[:, 0]))
        for kind, found in counts.items():
            buckets = np.flatnonzero(found)
            yield _batch_of(schema, [np.full(len(buckets), kind), buckets, found[buckets]])

    parts = map_batches(encoded.withColumn("learnt", learnt), run, schema)
    sums = [F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(f"n{kind}") for kind in range(2 + len(names))]
    found = parts.groupBy("bucket").agg(*sums).where(F.col("n0") + F.col("n1") >= LEAST_DOCUMENTS).toArrow()
    table = np.stack([column.to_numpy() for column in found.columns], axis=1)
    return table[np.argsort(table[:, 0])]


def _lookup(model: Model) -> np.ndarray:
    """The row of each bucket; that of padding, -1, is 0."""
    rows = np.zeros(model.buckets + 1, np.int32)
    kept = np.array(model.row_of.kept, np.int32)
    rows[kept] = np.arange(1, len(kept) + 1)
    return rows


def _packed(arrays: list[np.ndarray]) -> np.ndarray:
    """Small arrays one after the other, in rows as long as an embedding and its memory."""
    flat = np.concatenate([np.ravel(x) for x in arrays]).astype(np.float32)
    return np.pad(flat, (0, -len(flat) % (2 * SIZE))).reshape(-1, 2 * SIZE)


def _rows_of(schema: StructType, rows: np.ndarray, n: int, values: np.ndarray) -> pa.RecordBatch:
    """A batch of rows with their values, which are lists of one length, without an object for each."""
    ends = pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32())
    parts = pa.ListArray.from_arrays(ends, pa.array(values.ravel(), pa.float32()))
    return pa.RecordBatch.from_arrays(
        [pa.array(rows, pa.int32()), pa.array(np.full(len(rows), n), pa.int64()), parts.cast(to_arrow_schema(schema).field("parts").type)],
        schema=to_arrow_schema(schema),
    )


def _round(encoded: DataFrame, model: Model, memory: list[np.ndarray], number: int) -> None:
    """Train on the documents in tasks, each for itself, and average what they changed by their documents.

    An embedding is averaged over the tasks that changed it. Rows below 0 carry the other parameters. A task returns
    its rows some at a time, so neither the worker nor the executor holds them all as one batch.
    """
    spark = encoded.sparkSession
    # training doesn't ask for languages
    sent = spark.sparkContext.broadcast((replace(model, language_logs=np.zeros((0, 0))), memory))
    schema = StructType.fromDDL("row int, n long, parts array<float>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, begun_memory = sent.value
        own = replace(
            begun, embeddings=begun.embeddings.copy(), filters=[x.copy() for x in begun.filters],
            biases=[x.copy() for x in begun.biases], weights=begun.weights.copy(),
        )
        kept = [x.copy() for x in begun_memory]
        lookup, rng, n = _lookup(own), None, 0
        docs: list[np.ndarray] = []
        toxic: list[int] = []
        for doc_id, label, _, codes in _documents_of(batches):
            rng = rng or np.random.default_rng((number, doc_id % 2**32))
            docs.append(lookup[codes])
            toxic.append(label)
            n += 1
            if len(docs) == HELD:
                _grow(docs, np.array(toxic, np.float32), own, rng, kept, 1)
                docs, toxic = [], []
        if docs:
            _grow(docs, np.array(toxic, np.float32), own, rng, kept, 1)
        if n:
            changed = np.flatnonzero((kept[0] != begun_memory[0]).any(axis=1))
            rest = _packed([*_parameters(own)[1:], np.array([own.bias]), *kept[1:]])
            yield _rows_of(schema, -1 - np.arange(len(rest)), n, rest)
            for start in range(0, len(changed), RETURNED):
                some = changed[start : start + RETURNED]
                yield _rows_of(schema, some, n, np.concatenate((own.embeddings[some], kept[0][some]), axis=1))

    parts = map_batches(encoded, run, schema)
    means = [(F.sum(F.col("parts")[i].cast("double") * F.col("n")) / F.sum("n")).alias(f"x{i}") for i in range(2 * SIZE)]
    found = parts.groupBy("row").agg(*means).toArrow()
    sent.destroy()
    if not found.num_rows:
        return
    rows, values = found["row"].to_numpy(), np.stack([found[f"x{i}"].to_numpy() for i in range(2 * SIZE)], axis=1)
    inner = rows >= 0
    model.embeddings[rows[inner]], memory[0][rows[inner]] = values[inner, :SIZE], values[inner, SIZE:]
    flat = values[~inner][np.argsort(-rows[~inner])].ravel()
    bias = np.zeros(1)
    for array in (*_parameters(model)[1:], bias, *memory[1:]):
        array[...] = flat[: array.size].reshape(array.shape)
        flat = flat[array.size :]
    model.bias = float(bias[0])


def _judged(model: Model, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Probability and guessed language of documents given by rows of embeddings, long ones in pieces that overlap by a window."""
    overlap = max(WIDTHS) - 1
    pieces = [(k, doc[at : at + PIECE + overlap]) for k, doc in enumerate(docs) for at in range(0, max(1, len(doc) - overlap), PIECE)]
    padding = np.zeros((overlap, 1 + len(STEMS)), np.int64)  # between pieces, as no window may reach into the next
    best = np.full((len(docs), FILTERS * len(WIDTHS)), -np.inf, np.float32)
    language = np.zeros((len(docs), model.language_logs.shape[1]))
    some: list[tuple[int, np.ndarray]] = []
    for place, piece in enumerate(pieces, 1):
        some.append(piece)
        if place == len(pieces) or sum(len(rows) for _, rows in some) > PIECE:
            owners, index = np.array([k for k, _ in some]), np.concatenate([x for _, rows in some for x in (rows, padding)])
            starts = np.cumsum([0, *(len(rows) + overlap for _, rows in some[:-1])])
            np.maximum.at(best, owners, model.pooled(index, starts))
            for k, rows in some:
                language[k] += model.language_logs[rows[:-overlap, 0]].sum(axis=0)
            some = []
    guessed = language.argmax(axis=1) if language.shape[1] else np.zeros(len(docs), np.int64)
    return _sigmoid(model.logit(best)), guessed


def _set_thresholds(encoded: DataFrame, model: Model) -> None:
    """Thresholds from the probabilities of all these documents, counted in BINS steps."""
    sent = encoded.sparkSession.sparkContext.broadcast(model)

    def make():
        lookup = _lookup(sent.value)

        def run(batch: pa.RecordBatch) -> dict[str, list]:
            docs = list(_documents_of(iter([batch])))
            probability, guessed = _judged(sent.value, [lookup[codes] for *_, codes in docs])
            return {"guessed": guessed, "bin": np.floor(probability * BINS).astype(int), "toxic": [d[1] for d in docs]}

        return run

    found = map_slices(encoded, "guessed int, bin int, toxic int", make).groupBy("guessed", "bin", "toxic").count().collect()
    sent.destroy()
    counts = np.zeros((len(model.thresholds), BINS + 1, 2))
    for r in found:
        counts[r["guessed"], r["bin"], r["toxic"]] += r["count"]
    everywhere = _counted_threshold(counts.sum(axis=0))
    for language, own in enumerate(counts):
        enough = own.sum(axis=0).min() >= LEAST_CALIBRATION
        model.thresholds[language] = _counted_threshold(own) if enough else everywhere


def _counted_threshold(counts: np.ndarray) -> float:
    """``_threshold`` for documents of either class (columns) counted in steps of probability (rows)."""
    held = np.flatnonzero(counts.sum(axis=1))
    clean, toxic = (counts[held] / np.maximum(1, counts.sum(axis=0))).T
    right = np.cumsum(clean) + toxic.sum() - np.cumsum(toxic)
    best = np.flatnonzero(right >= right.max() - 1e-12)
    ends, nexts = held + 1, np.append(held[1:], BINS)
    i = best[int(np.argmax((nexts - ends)[best]))]
    return float(np.clip((ends[i] + max(nexts[i], ends[i])) / 2 / BINS, 0.02, 0.98))


def _trained_in_tasks(labelled: DataFrame, visits: int, seed: int = 0) -> Model | None:
    """The same model as ``train``'s of (_id, text, lang, _toxic), none of which come to the driver.

    Each document not kept for calibration is trained on in one of the EPOCHS rounds at least, and in more while
    ``visits`` in all are not reached.
    """
    encoded = written(_encoded(labelled), "encoded")
    apart = _chance("apart") < CALIBRATION
    sizes = {(r["_toxic"], r["apart"]): r["count"] for r in encoded.groupBy("_toxic", apart.alias("apart")).count().collect()}
    if len({c for c, _ in sizes}) < 2:
        return None
    learnt, checked = ~apart, apart
    if not all((c, False) in sizes for c in (0, 1)) or not any(off for _, off in sizes):
        learnt, checked = F.lit(True), F.lit(True)
        sizes = {(c, False): sum(n for (k, _), n in sizes.items() if k == c) for c in (0, 1)}
    n = [sizes[c, False] for c in (0, 1)]
    of_language = encoded.where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n"), F.sum("_toxic").alias("toxic"))
    # a language with fewer documents has no threshold of its own, so there is no need to guess it
    enough = of_language.where(f"least(toxic, n - toxic) >= {LEAST_CALIBRATION}")
    names = {r["lang"]: r["n"] for r in enough.collect()}
    names = dict(sorted(names.items()))
    rng = np.random.default_rng(seed)
    counts = _counted(encoded, learnt, list(names))
    model = _begun(counts[:, 0].tolist(), [counts[:, 1], counts[:, 2]], n, len(names), rng, SHARED_BUCKETS)
    for column, total in enumerate(names.values()):
        model.language_logs[1:, column] = np.log((counts[:, 3 + column] + 1) / (1 + total))
    memory = _memory(model)
    share = min(1.0, max(1.0, visits / sum(n)) / EPOCHS)
    trainers = max(1, int(sum(n) * share / TRAINER))
    for number in range(EPOCHS):
        turn = F.pmod(_chance("turn") + F.lit(number / EPOCHS), F.lit(1.0)) < share
        _round(encoded.where(learnt & turn).coalesce(trainers), model, memory, number)
    _set_thresholds(encoded.where(checked), model)
    return model


def score(documents: DataFrame, model: Model | None) -> DataFrame:
    """The documents with score and predicted, from the whole text alone.

    Null and empty texts are scored as texts without words. Without a model (labels of one
    class, or none) every score is 0. predicted is 1 from a score of 0.5 on. Repeated rows each get
    their result; columns named score or predicted are replaced. One pass without a shuffle;
    the model's size is bounded by the documents it was trained on in the driver, or else by SHARED_BUCKETS.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        cache: dict = {}

        def run(batch: pa.RecordBatch) -> dict[str, list]:
            if sent.value is None:
                return {"score": [0.0] * batch.num_rows, "predicted": [0] * batch.num_rows}
            probability, guessed = predict(sent.value, batch.column("text").to_pylist(), cache)
            scores = _calibrated(probability.astype(float), sent.value.thresholds[guessed])
            return {"score": scores, "predicted": (scores >= 0.5).astype(np.int32)}

        return run

    return add_columns(documents, "score double, predicted int", make)
