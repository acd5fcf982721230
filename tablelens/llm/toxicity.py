"""Toxicity by classifier chains.

Categories are predicted one after the other. Each has a linear (logistic) model over the words and word
beginnings that a document holds, and over the probabilities of the categories before it. While fitting, those
earlier probabilities are out-of-fold predictions, so a later model learns from what it will see, not from
fits to the same rows.

The chain is fitted on a bounded sample: the ``max_rows`` labelled documents with the least hashes (all, if
there are fewer). Their features come from whole texts, made on the executors; only feature hashes of the
sample reach the driver. For each category the features most associated with it (chi-square, at most
``max_features``) are kept, chosen inside each fold. Scoring covers every document, whole; what is sent to
the executors is the chosen features with one weight a category, bounded by ``max_features``.

Defined results: a null or empty text has no features and scores by the intercepts; labels that are null
don't count, repeated labels of a document count as their maximum; with no labels, or of one kind only, a
category's probability is the labels' mean (0 without any); repeated rows are scored each; an empty table
gives no rows; a column of the input that is called like a result must not be in ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.llm.chunks import Remembered, release
from tablelens.llm.common import by_bytes, text_bytes

PUNCTUATION = ".,;:!?\"'()[]{}<>*#$%&/\\-_=+|~`«»„“”‚‘’…¿¡"
STARTS = (3, 4, 5)
FOLDS = 5


def word_features(word: bytes) -> list[int]:
    """Hashes of a word (lower-cased, without surrounding punctuation) and of its beginnings."""
    w = word.decode("utf-8", "replace").lower().strip(PUNCTUATION)
    if not w:
        return []
    names = ["=" + w] + [w[:k] for k in STARTS if len(w) > k]
    return [xxhash.xxh32_intdigest(n.encode()) for n in names]


@dataclass
class Linear:
    features: np.ndarray  # ascending: numbers while fitting, hashes afterwards
    weights: np.ndarray
    earlier: np.ndarray   # weights of the earlier categories' probabilities
    intercept: float


@dataclass
class Rows:
    """Documents as sets of features: a run of ``sizes[i]`` feature numbers for each."""
    flat: np.ndarray
    sizes: np.ndarray

    def take(self, keep: np.ndarray) -> Rows:
        return Rows(self.flat[np.repeat(keep, self.sizes)], self.sizes[keep])


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def numbered(hashes: np.ndarray, sizes: np.ndarray, least: int = 3) -> tuple[Rows, np.ndarray]:
    """Features numbered in the order of their hashes, without those of fewer than ``least`` documents."""
    names, at = np.unique(hashes, return_inverse=True)
    kept = np.bincount(at, minlength=len(names)) >= least
    number = np.cumsum(kept) - 1
    stays = kept[at]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return Rows(number[at[stays]], np.bincount(owner[stays], minlength=len(sizes))), names[kept]


def choose(rows: Rows, y: np.ndarray, most: int, least_chi2: float = 10.83) -> np.ndarray:
    """The features whose presence is most associated with ``y``, in ascending order."""
    on = np.bincount(rows.flat).astype(float)
    both = np.bincount(rows.flat, weights=np.repeat(y, rows.sizes))
    n, pos = len(y), y.sum()
    spread = on * (n - on) * pos * (n - pos)
    chi2 = np.where(spread > 0, n * (both * n - on * pos) ** 2 / np.maximum(spread, 1), 0)
    kept = np.flatnonzero(chi2 >= least_chi2)
    return np.sort(kept[np.argsort(-chi2[kept], kind="stable")[:most]])


def _design(rows: Rows, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) numbers of the chosen features present."""
    if not len(features):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(features, rows.flat), len(features) - 1)
    hit = features[at] == rows.flat
    return np.repeat(np.arange(len(rows.sizes)), rows.sizes)[hit], at[hit]


def fit_linear(rows: Rows, earlier: np.ndarray, y: np.ndarray, most: int, ridge: float = 0.05, steps: int = 150) -> Linear:
    """Ridge logistic regression by accelerated gradient steps, each coefficient at its own scale."""
    k, mean = earlier.shape[1], float(y.mean()) if len(y) else 0.0
    if not 0 < mean < 1:
        return Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(k), 40.0 * (2 * mean - 1))
    features = choose(rows, y, most)
    doc, col = _design(rows, features)
    n, m = len(y), len(features)
    per_doc = np.bincount(doc, minlength=n) + 1.0 + earlier.sum(axis=1)
    rate_w = 1 / (0.25 * np.bincount(col, weights=per_doc[doc], minlength=m) + ridge)
    rate_e = 1 / (0.25 * (earlier * per_doc[:, None]).sum(axis=0) + ridge)
    rate_b = 1 / (0.25 * per_doc.sum())
    w, e, b = np.zeros(m), np.zeros(k), float(np.log(mean / (1 - mean)))
    vw, ve, vb, t = w, e, b, 1.0
    for _ in range(steps):
        z = np.bincount(doc, weights=vw[col], minlength=n) + earlier @ ve + vb
        r = _sigmoid(z) - y
        nw = vw - rate_w * (np.bincount(col, weights=r[doc], minlength=m) + ridge * vw)
        ne, nb = ve - rate_e * (earlier.T @ r + ridge * ve), vb - rate_b * r.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        c = (t - 1) / t2
        vw, ve, vb = nw + c * (nw - w), ne + c * (ne - e), nb + c * (nb - b)
        w, e, b, t = nw, ne, nb, t2
    return Linear(features, w, e, float(b))


def predict(model: Linear, rows: Rows, earlier: np.ndarray) -> np.ndarray:
    doc, col = _design(rows, model.features)
    z = np.bincount(doc, weights=model.weights[col], minlength=len(rows.sizes)) if len(doc) else np.zeros(len(rows.sizes))
    return _sigmoid(z + earlier @ model.earlier + model.intercept)


def fit_chain(hashes: np.ndarray, sizes: np.ndarray, labels: np.ndarray, folds: np.ndarray, most: int) -> tuple[list[Linear], np.ndarray]:
    """Models in chain order, and the out-of-fold probabilities. ``labels``: (rows, categories)."""
    rows, names = numbered(hashes, sizes)
    n, c = labels.shape
    out = np.zeros((n, c))
    models = []
    for k in range(c):
        y, before = labels[:, k].astype(float), out[:, :k]
        for f in range(FOLDS):
            held = folds == f
            if held.any():
                part = fit_linear(rows.take(~held), before[~held], y[~held], most)
                out[held, k] = predict(part, rows.take(held), before[held])
        full = fit_linear(rows, before, y, most)
        models.append(replace(full, features=names[full.features]))
    return models, out


def training_rows(docs: DataFrame, labels: DataFrame, categories: list[str], max_rows: int, id_col: str,
                  text_col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature hashes (a run for each row) and their numbers, labels and folds of the bounded sample."""
    known = labels.where(F.col(f"`{id_col}`").isNotNull()).dropna(subset=categories)
    known = known.groupBy(F.col(f"`{id_col}`").alias("__id")).agg(*[F.max(c).cast("int").alias(f"y{k}") for k, c in enumerate(categories)])
    mark = F.xxhash64("__id", F.lit(5))
    sample = known.withColumn("mark", mark).orderBy("mark", "__id").limit(max_rows)
    cols = ["mark", *[f"y{k}" for k in range(len(categories))]]
    # at most max_rows short rows: small enough to send to every task
    joined = text_bytes(docs, id_col, text=text_col).join(F.broadcast(sample), F.col(f"`{id_col}`") == F.col("__id")).select(*cols, "__text")
    schema = ", ".join(["mark long", *[f"y{k} int" for k in range(len(categories))], "features array<long>"])

    def run(batches):
        release()
        known_words = Remembered(lambda ws: [word_features(w) for w in ws])
        for batch in by_bytes(batches, "__text", 8 << 20):
            out = []
            for t in batch.column("__text").to_pylist():
                ws = set(t.split())
                known_words.learn(ws)
                out.append(sorted({h for w in ws for h in known_words[w]}))
                known_words.forget_long()
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in cols], pa.array(out, pa.list_(pa.int64()))], names=[*cols, "features"])

    t = joined.mapInArrow(run, schema).toArrow().sort_by("mark")
    lists = t.column("features").combine_chunks()
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    y = np.stack([t.column(f"y{k}").to_numpy() for k in range(len(categories))], axis=1)
    folds = t.column("mark").to_numpy().view(np.uint64) % np.uint64(FOLDS)
    return flat.astype(np.uint32), sizes.astype(np.int64), y, folds.astype(int)


def score(docs: DataFrame, models: list[Linear], categories: list[str], keep: list[str], text_col: str = "text") -> DataFrame:
    """(keep ..., p_<category> ...) of every row. The text goes to the tasks once, also where it is kept."""
    features = np.unique(np.concatenate([m.features for m in models])) if models else np.zeros(0, np.uint32)
    weights = np.zeros((len(features), len(models)))
    for k, m in enumerate(models):
        weights[np.searchsorted(features, m.features), k] = m.weights
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((features, weights, [(m.earlier, m.intercept) for m in models]))
    kept = text_col in keep
    df = docs.select(*[F.col(f"`{c}`") for c in keep]) if kept else text_bytes(docs, *keep, text=text_col)
    source = text_col if kept else "__text"
    schema = T.StructType([*[df.schema[c] for c in keep], *[T.StructField(f"p_{c}", T.DoubleType()) for c in categories]])

    def run(batches):
        release()
        features, weights, links = sent.value
        place = {h: i for i, h in enumerate(features.tolist())}

        def known_places(words):
            return [np.array([place[h] for h in word_features(w) if h in place], np.int32).tobytes() for w in words]

        known = Remembered(known_places)
        for batch in by_bytes(batches, source, 8 << 20):
            out = np.zeros((batch.num_rows, len(links)))
            for i, t in enumerate(batch.column(source).cast(pa.binary()).to_pylist()):
                t = t or b""
                ws = set(t.split())
                known.learn(ws)
                on = np.unique(np.frombuffer(b"".join(map(known.__getitem__, ws)), np.int32))
                known.forget_long()
                z = weights[on].sum(axis=0)
                for k, (earlier, intercept) in enumerate(links):
                    out[i, k] = _sigmoid(z[k] + out[i, :k] @ earlier + intercept)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(out[:, k]) for k in range(len(links))]], names=schema.names)

    return df.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, categories: list[str], max_rows: int = 8_000, max_features: int = 1_000,
             id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Fit the chain on labelled documents and score all: (keep ..., p_<category> ...); ``keep``: id_col."""
    models, _ = fit_chain(*training_rows(docs, labels, categories, max_rows, id_col, text_col), max_features)
    return score(docs, models, categories, keep or [id_col], text_col)
