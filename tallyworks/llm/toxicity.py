"""Toxicity: a small convolutional text classifier, trained in numpy.

A token's embedding is the sum of hashed embeddings of the whole word and of its first four
and six bytes. Filters of several widths run over the token sequence, each keeps its maximum
over the whole text, and a logistic layer weighs the maxima. The output is calibrated on
labelled texts that the training did not use; thresholds for a wanted precision are found for
each language there (they decide a column of its own; the score itself sees only the text).

Edge cases: null, empty and wordless texts have maxima of 0 and get the score that the bias
gives; texts shorter than a filter are padded; repeated rows score alike; with one class only
among the labels the score is the mean label (0.5 without labels); extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .labelled import fold, labelled_sample
from .store import release, stage
from .wordhash import U, chunks, mix, salt, span_hashes, words

#: Labelled rows that training and calibration use at most.
MOST_LABELLED = 5_000
#: Words of whole labelled texts that reach the driver at most; rows beyond are not used for the fit.
MOST_WORDS = 8_000_000
BUCKETS = 1 << 15
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Bytes that make up words: letters, digits and all bytes beyond ASCII.
_IN_WORD = np.array([chr(b).isalnum() if b < 0x80 else True for b in range(256)])
_VIEWS = (None, 4, 6)
#: Tokens convolved at once.
_BLOCK = 1 << 15


def token_ids(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bucket of each token in each view, first token of each text and one more)."""
    for row, data, offsets in chunks(column):
        starts, ends, first = words(data, offsets, _IN_WORD)
        views = []
        for i, size in enumerate(_VIEWS):
            stops = ends if size is None else np.minimum(ends, starts + size)
            hashes = span_hashes(data, starts, stops) if len(data) else np.zeros(0, U)
            views.append((mix(hashes ^ salt(8, i)) >> U(64 - 15)).astype(np.int32))
        yield row, np.stack(views, axis=1), first


@dataclass
class Model:
    embed: np.ndarray  # views x buckets x DIM
    filters: list[np.ndarray]  # for each width: width x DIM x FILTERS
    filter_bias: np.ndarray
    out: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def embedded(self, ids: np.ndarray) -> np.ndarray:
        x = self.embed[0][ids[:, 0]]
        for v in range(1, len(_VIEWS)):
            x = x + self.embed[v][ids[:, v]]
        return x

    def maxima(self, ids: np.ndarray, first: np.ndarray, at: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Maximum of each filter over each text (0 at least), and where it was."""
        texts = len(first) - 1
        top = np.zeros((texts, len(WIDTHS) * FILTERS), np.float32)
        where = np.full(top.shape, -1, np.int64) if at else None
        for a, b in _blocks(first):
            lo, hi = first[a], first[b]
            if lo == hi:
                continue
            x = self.embedded(ids[lo:hi])
            some = np.flatnonzero(np.diff(first[a : b + 1]) > 0)
            cuts, ends = first[a:b][some] - lo, first[a + 1 : b + 1][some] - lo
            taps = np.concatenate([tap.T for f in self.filters for tap in f]) @ x.T
            at_tap = 0
            for i, width in enumerate(WIDTHS):
                y = taps[at_tap : at_tap + FILTERS]
                for k in range(1, width):
                    part = taps[at_tap + k * FILTERS : at_tap + (k + 1) * FILTERS]
                    for back in range(k):  # no filter reaches into the next text
                        part[:, np.minimum(cuts + back, hi - lo - 1)] = 0
                    y[:, : hi - lo - k] += part[:, k:]
                at_tap += width * FILTERS
                y += self.filter_bias[i * FILTERS : (i + 1) * FILTERS, None]
                best = np.maximum.reduceat(y, cuts, axis=1).T
                cols = slice(i * FILTERS, (i + 1) * FILTERS)
                top[a + some, cols] = np.maximum(best, 0)
                if at:
                    for n, (t, s, e) in enumerate(zip(some.tolist(), cuts.tolist(), ends.tolist(), strict=True)):
                        where[a + t, cols] = np.where(best[n] > 0, y[:, s:e].argmax(axis=1) + s + lo, -1)
        return top, where

    def score(self, top: np.ndarray) -> np.ndarray:
        z = self.slope * (top @ self.out + self.bias) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _blocks(first: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about _BLOCK tokens."""
    a, texts = 0, len(first) - 1
    while a < texts:
        b = int(np.searchsorted(first, first[a] + _BLOCK, "right")) - 1
        b = min(max(b, a + 1), texts)
        yield a, b
        a = b


def _new_model(rng: np.random.Generator) -> Model:
    return Model(
        (rng.standard_normal((len(_VIEWS), BUCKETS, DIM)) * 0.1).astype(np.float32),
        [(rng.standard_normal((w, DIM, FILTERS)) * 0.4).astype(np.float32) for w in WIDTHS],
        np.zeros(len(WIDTHS) * FILTERS, np.float32),
        (np.abs(rng.standard_normal(len(WIDTHS) * FILTERS)) * 0.5).astype(np.float32),
        -1.0,
    )


class _Adam:
    def __init__(self, shape: tuple[int, ...], rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0, rate

    def step(self, target: np.ndarray, grad: np.ndarray, rows=slice(None)) -> None:
        self.t += 1
        self.m[rows] = 0.9 * self.m[rows] + 0.1 * grad
        self.v[rows] = 0.99 * self.v[rows] + 0.01 * grad**2
        m, v = self.m[rows] / (1 - 0.9**self.t), self.v[rows] / (1 - 0.99**self.t)
        target[rows] -= self.rate * m / (np.sqrt(v) + 1e-6)


def train(ids: list[np.ndarray], y: np.ndarray, epochs: int = 5, batch: int = 64, rate: float = 0.02, seed: int = 3) -> Model:
    """Adam on the logistic loss; gradients flow to the tokens under each maximum only."""
    rng = np.random.default_rng(seed)
    model = _new_model(rng)
    if not len(y) or y.min() >= 0.5 or y.max() < 0.5:
        mean = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        model.out[:] = 0
        model.bias = float(np.log(mean / (1 - mean)))
        return model
    held = np.arange(len(y)) % 5 == 4
    rows = np.flatnonzero(~held)
    model.bias = float(np.log(np.clip(y.mean(), 0.02, 0.98) / (1 - np.clip(y.mean(), 0.02, 0.98))))
    n_filters = len(WIDTHS) * FILTERS
    steps = {
        "embed": [_Adam((BUCKETS, DIM), rate) for _ in _VIEWS], "filters": [_Adam(f.shape, rate / 4) for f in model.filters],
        "fb": _Adam((n_filters,), rate / 4), "out": _Adam((n_filters,), rate / 4), "bias": _Adam((1,), rate / 4),
    }
    for epoch in range(epochs):
        rng.shuffle(rows)
        for start in range(0, len(rows), batch):
            part = rows[start : start + batch]
            flat = np.concatenate([ids[i] for i in part])
            sizes = np.array([len(ids[i]) for i in part])
            first = np.concatenate([[0], np.cumsum(sizes)])
            top, where = model.maxima(flat, first, at=True)
            p = 1 / (1 + np.exp(-np.clip(top @ model.out + model.bias, -30, 30)))
            error = ((p - y[part]) / len(part)).astype(np.float32)
            d_top = error[:, None] * model.out[None, :]
            d_top[where < 0] = 0
            grad_out = top.T @ error
            text, filt = np.nonzero(d_top)
            tok, amount = where[text, filt], d_top[text, filt]
            d_tokens: list[tuple[np.ndarray, np.ndarray]] = []
            end = first[text + 1]
            for i, width in enumerate(WIDTHS):
                own = filt // FILTERS == i
                f_in = filt[own] % FILTERS
                grad = np.zeros_like(model.filters[i])
                for k in range(width):
                    inside = tok[own] + k < end[own]
                    t, f, a = tok[own][inside] + k, f_in[inside], amount[own][inside]
                    x = model.embedded(flat[t])
                    np.add.at(grad[k].T, f, x * a[:, None])
                    d_tokens.append((t, model.filters[i][k].T[f] * a[:, None]))
                steps["filters"][i].step(model.filters[i], grad)
            steps["fb"].step(model.filter_bias, np.bincount(filt, weights=amount, minlength=n_filters).astype(np.float32))
            steps["out"].step(model.out, grad_out + 1e-4 * model.out)
            bias = np.array([model.bias], np.float32)
            steps["bias"].step(bias, np.array([error.sum()], np.float32))
            model.bias = float(bias[0])
            t = np.concatenate([d[0] for d in d_tokens])
            g = np.concatenate([d[1] for d in d_tokens])
            for v in range(len(_VIEWS)):
                touched, inverse = np.unique(flat[t, v], return_inverse=True)
                total = np.zeros((len(touched), DIM), np.float32)
                np.add.at(total, inverse, g)
                steps["embed"][v].step(model.embed[v], total, touched)
    _calibrate(model, [ids[i] for i in np.flatnonzero(held)], y[held])
    return model


def _tops(model: Model, ids: list[np.ndarray]) -> np.ndarray:
    flat = np.concatenate([*ids, np.zeros((0, len(_VIEWS)), np.int32)])
    return model.maxima(flat, np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64))[0]


def _calibrate(model: Model, ids: list[np.ndarray], y: np.ndarray) -> None:
    """Platt scaling on texts that training did not see."""
    if not len(y) or y.min() >= 0.5 or y.max() < 0.5:
        return
    z = _tops(model, ids) @ model.out + model.bias
    a, b = 1.0, 0.0
    target = np.where(y > 0.5, (np.sum(y > 0.5) + 1) / (np.sum(y > 0.5) + 2), 1 / (np.sum(y < 0.5) + 2))
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([((p - target) * z).sum(), (p - target).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a - step[0], b - step[1]
    model.slope, model.shift = float(max(a, 0.05)), float(b)


def language_thresholds(scores: np.ndarray, y: np.ndarray, langs: list[str | None], precision: float = 0.9, default: float = 0.3) -> dict[str, float]:
    """For each language the lowest threshold that keeps ``precision`` on labelled texts."""
    out = {}
    for lang in {x for x in langs if x is not None}:
        own = np.array([x == lang for x in langs])
        order = np.argsort(-scores[own], kind="stable")
        right = np.cumsum(y[own][order] > 0.5) / np.arange(1, own.sum() + 1)
        ok = np.flatnonzero(right >= precision)
        out[lang] = float(scores[own][order][ok[-1]]) if len(ok) else default
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "toxic", most: int = MOST_LABELLED, key: str = "doc_id", text: str = "text", lang: str | None = None) -> Model:
    """Train on at most ``most`` labelled rows and MOST_WORDS words; with ``lang``, find thresholds by language too.

    The driver gets token buckets of whole texts (6 bytes a word), in the order of a hash of the key
    until the bound on words is reached.
    """
    sample = labelled_sample(docs, labels, label, held_out, most, key, text, lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, ids, first in token_ids(batch.column(1)):
                n = len(first) - 1
                packed = [ids[a:b].astype(np.uint16).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                rest = [batch.column(i).slice(row, n) for i in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([rest[0], pa.array(packed, pa.binary()), *rest[1:]], names=["k", "ids", "y", "lang"])

    columns = [F.col(key), F.col("text"), F.col("y"), (F.col("also") if lang else F.lit(None)).cast("string").alias("lang")]
    kind = sample.schema[key].dataType.simpleString()
    packed = stage(sample.select(*columns).mapInArrow(run, f"k {kind}, ids binary, y double, lang string"), "toxic-sample")
    sizes = packed.select("k", (F.octet_length("ids") / F.lit(2 * len(_VIEWS))).alias("n"))  # at most ``most`` rows
    upto = Window.orderBy(F.xxhash64("k", F.lit("sample")), "k").rowsBetween(Window.unboundedPreceding, 0)
    fits = sizes.withColumn("sum", F.sum("n").over(upto)).where(F.col("sum") <= MOST_WORDS).select("k")
    table = packed.join(F.broadcast(fits), "k").toArrow().sort_by([("k", "ascending"), ("ids", "ascending")])
    release(packed)
    ids = [np.frombuffer(b, np.uint16).reshape(-1, len(_VIEWS)).astype(np.int32) for b in table.column("ids").to_pylist()]
    y = table.column("y").to_numpy()
    model = train(ids, y)
    if lang is not None and len(y):
        held = np.arange(len(y)) % 5 == 4
        scores = model.score(_tops(model, [ids[i] for i in np.flatnonzero(held)]))
        model.thresholds = language_thresholds(scores, y[held], [x for x, h in zip(table.column("lang").to_pylist(), held, strict=True) if h])
    return model


def score_texts(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", also: str | None = None) -> DataFrame:
    """key and score of every row, and the column ``also`` as it is: one scan of whole texts, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), *([F.col(also).cast("string").alias("a")] if also else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, ids, first in token_ids(batch.column(1)):
                scores = shared.value.score(shared.value.maxima(ids, first)[0])
                passed = [batch.column(i).slice(row, len(scores)) for i in range(len(batch.columns)) if i != 1]
                yield pa.RecordBatch.from_arrays([*passed, pa.array(scores.astype(np.float64))], names=out_names)

    out_names = ["k", *["a"] * bool(also), "score"]
    kind = rows.schema["k"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"k {kind}, {'a string, ' * bool(also)}score double")
    return scored.select(F.col("k").alias(key), *([F.col("a").alias(also)] if also else []), "score")


def score_toxicity(
    docs: DataFrame, labels: DataFrame, folds: int = 4, fold_out: int = 2, key: str = "doc_id", text: str = "text", lang: str | None = None
) -> DataFrame:
    """key, held_out and score of every row.

    With ``lang``, also threshold and flagged: the score against the threshold calibrated for
    the row's language. The score itself depends on the text only.
    """
    held_out = fold(key, folds) == F.lit(fold_out)
    model = fit_toxicity(docs, labels, held_out, key=key, text=text, lang=lang)
    scored = score_texts(docs, model, key, text, lang)
    more = []
    if lang is not None:
        scored = flag_by_language(scored, model, lang)
        more = ["threshold", F.col("toxic").alias("flagged")]
    return scored.select(key, held_out.alias("held_out"), "score", *more)


def flag_by_language(scored: DataFrame, model: Model, lang: str = "lang", default: float = 0.3) -> DataFrame:
    """``scored`` (with score and a language column) plus threshold, and toxic: at or over the threshold of its language."""
    level = F.lit(default)
    for name, value in sorted(model.thresholds.items()):
        level = F.when(F.col(lang) == F.lit(name), F.lit(value)).otherwise(level)
    return scored.withColumn("threshold", level).withColumn("toxic", F.col("score") >= F.col("threshold"))
