"""Mixing sources to target weights, with soft domain membership.

A multinomial logistic classifier on hashed words, fitted on a bounded labelled sample, gives
every document a posterior over domains. Rates r_d >= 0 are then fitted so that the expected
tokens of each domain, sum_d r_d * tokens_d * p_dk, meet targets T_k, by projected gradient on

    1/2 * sum_k ((sum_d r_d tokens_d p_dk - T_k) / T)^2

from r = 1. A step changes r_d by -p_d . (S residual), with tokens_d as the metric, so long and
short documents of one kind get one rate; S is the inverse of the K x K Gram matrix while that
lowers the loss, then 1 over its largest eigenvalue. The rates are a pure function of the residuals so
far, a list of one vector an iteration, so each pass over the staged posteriors recomputes them and sums K numbers a
partition; nothing that grows with the corpus is sent to the driver.

Sampling turns a rate into whole copies: floor(rate), and one more if a hash of the key is
below the rest.

Edge cases: null and empty texts have no tokens, the prior as posterior, and count as one
token; null keys hash like any constant; repeated rows share a rate; without labelled rows,
or with an empty table, rates are 1; a target of 0 thins a domain as far as the posteriors
allow (such targets, that no rates meet, are approached slowly: the fit warns and tells its residual); extra columns pass through.
"""

from __future__ import annotations

import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .store import free_name, limited_semi, stage
from .wordhash import U, chunks, mix, salt, span_hashes, words

#: Labelled rows that the domain classifier uses at most, and domains at most.
MOST_LABELLED = 4_000
MOST_DOMAINS = 64
#: Domain of all labels beyond the MOST_DOMAINS - 1 most frequent ones.
REST = "other domains"
BITS = 11


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, mean of hashed word and ending counts, words) of runs of texts."""
    size = 1 << BITS
    for row, data, offsets in chunks(column):
        starts, ends, first = words(data, offsets)
        texts, n = len(offsets) - 1, np.diff(first)
        x = np.zeros((texts, size), np.float32)
        if len(data):
            of = np.repeat(np.arange(texts), n)
            for view, (a, b) in enumerate(((starts, ends), (np.maximum(starts, ends - 3), ends))):
                bucket = (mix(span_hashes(data, a, b) ^ salt(9, view)) >> U(64 - BITS)).astype(np.int64)
                x += np.bincount(of * size + bucket, minlength=texts * size).reshape(texts, size)
        x = np.sqrt(x)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        yield row, x, n


@dataclass
class DomainModel:
    domains: list[str]
    weights: np.ndarray  # features x domains
    bias: np.ndarray

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        if not self.domains:
            return np.zeros((len(x), 0))
        z = x @ self.weights + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit_softmax(x: np.ndarray, y: np.ndarray, domains: list[str], steps: int = 120, decay: float = 1e-5) -> DomainModel:
    """Full-batch accelerated gradient on the softmax loss."""
    k = len(domains)
    onehot = np.eye(k, dtype=np.float32)[y]
    share = onehot.mean(axis=0) if len(y) else np.full(k, 1 / max(k, 1))
    model = DomainModel(domains, np.zeros((x.shape[1], k), np.float32), np.log(np.maximum(share, 1e-6)).astype(np.float32))
    look, t = model.weights.copy(), 1.0
    for _ in range(steps if len(y) else 0):
        p = DomainModel(domains, look, model.bias).posteriors(x)
        grad = x.T @ (p - onehot) / len(y) + decay * look
        model.bias = model.bias - 1.0 * (p - onehot).mean(axis=0)
        new = look - 4.0 * grad
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        look = new + (before - 1) / t * (new - model.weights)
        model.weights = new
    return model


def named_domains(labels: list[str], most: int = MOST_DOMAINS) -> list[str]:
    """The labels, with all but the ``most`` - 1 most frequent ones as REST if there are more than ``most``."""
    counts = Counter(labels)
    if len(counts) <= most:
        return labels
    kept = set(sorted(counts, key=lambda d: (-counts[d], d))[: most - 1])
    return [d if d in kept else REST for d in labels]


def fit_domains(docs: DataFrame, table: DataFrame, label: str, most: int = MOST_LABELLED, key: str = "doc_id", text: str = "text") -> DomainModel:
    """Fit on at most ``most`` labelled rows of ``table`` (key, label), taken by a hash of the key."""
    rows = table.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(F.col(label).cast("string")).alias("y"))
    rows = stage(rows.orderBy(F.xxhash64(key, F.lit("domains")), key).limit(most), "domain-sample")
    texts = limited_semi(docs.select(F.col(key), F.col(text).alias("t")), rows.select(key), key).groupBy(key).agg(F.min("t").alias("t"))
    texts = texts.join(F.broadcast(rows), key).select("t", "y")  # one text a key, so the sample stays bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, x, _ in features(batch.column(0)):
                at = [np.flatnonzero(v).astype(np.int32) for v in x]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(row, len(x)), pa.array([a.tobytes() for a in at], pa.binary()),
                        pa.array([v[a].tobytes() for v, a in zip(x, at, strict=True)], pa.binary()),
                    ],
                    names=["y", "at", "v"],
                )

    got = texts.mapInArrow(run, "y string, at binary, v binary").toArrow().sort_by([("y", "ascending"), ("at", "ascending"), ("v", "ascending")])
    labels = named_domains(got.column("y").to_pylist())
    domains = sorted(set(labels))
    x = np.zeros((got.num_rows, 1 << BITS), np.float32)
    for i, (at, v) in enumerate(zip(got.column("at").to_pylist(), got.column("v").to_pylist(), strict=True)):
        x[i, np.frombuffer(at, np.int32)] = np.frombuffer(v, np.float32)
    return fit_softmax(x, np.array([domains.index(d) for d in labels], np.int64), domains)


def memberships(docs: DataFrame, model: DomainModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, tokens and p (posterior over model.domains); one scan, written to the shared folder."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, x, n in features(batch.column(1)):
                p = shared.value.posteriors(x).astype(np.float64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(p)), pa.array(np.maximum(n, 1)), flat], names=[key, "tokens", "p"]
                )

    kind = docs.schema[key].dataType.simpleString()
    return stage(docs.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {kind}, tokens long, p array<double>"), "memberships")


def _rates(p: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Rates after the steps in ``path`` (steps x domains), each projected to >= 0."""
    r = np.ones(len(p))
    for move in path:
        r = np.maximum(r - p @ move, 0.0)
    return r


def _sum_over(members: DataFrame, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens by domain at the rates of ``path``, and the token-weighted Gram matrix."""
    k = path.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, gram = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            tokens = batch.column(0).to_numpy().astype(float)
            p = batch.column(1).flatten().to_numpy().reshape(-1, k)
            totals += (_rates(p, path) * tokens) @ p
            gram += (p * tokens[:, None]).T @ p
        yield pa.RecordBatch.from_arrays([pa.array([*totals, *gram.ravel()]), pa.array(np.arange(k + k * k))], names=["v", "i"])

    rows = members.select("tokens", "p").mapInArrow(run, "v double, i long").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(k + k * k)
    for r in rows:
        out[r.i] = r.v
    return out[:k], out[k:].reshape(k, k)


@dataclass
class Mix:
    domains: list[str]
    path: np.ndarray
    targets: np.ndarray
    totals: list[np.ndarray]

    @property
    def residual(self) -> float:
        """The largest miss of a target, as a share of all expected tokens."""
        if not len(self.targets):
            return 0.0
        return float(np.abs(self.totals[-1] - self.targets).max() / max(self.totals[0].sum(), 1e-9))

    def rate(self, p: str = "p") -> Column:
        """The rate as a column over posteriors: the same steps, in JVM code."""
        r = F.lit(1.0)
        for move in self.path:
            dot = sum((F.col(p)[i] * F.lit(float(m)) for i, m in enumerate(move)), F.lit(0.0))
            r = F.greatest(r - dot, F.lit(0.0))
        return r


def fit_rates(members: DataFrame, domains: list[str], weights: dict[str, float], budget: float | None = None, steps: int = 30, tolerance: float = 1e-3) -> Mix:
    """Rates whose expected domain totals meet ``weights`` (shares; missing domains have 0).

    ``budget`` is the total of expected tokens afterwards, by default as many as there are. A fit
    that misses its targets (they may be out of reach) warns; ``Mix.residual`` tells by how much.
    The weight of REST is its own, or that of all names that are no domain by themselves.
    """
    k = len(domains)
    path = np.zeros((0, k))
    if k == 0:
        return Mix(domains, path, np.zeros(0), [])
    if REST in domains and REST not in weights:
        weights = {**weights, REST: sum(w for d, w in weights.items() if d not in domains)}
    share = np.array([max(0.0, float(weights.get(d, 0.0))) for d in domains])
    totals, gram = _sum_over(members, path)
    all_tokens = totals.sum()
    if all_tokens <= 0 or share.sum() <= 0:
        return Mix(domains, path, totals, [totals])
    targets = share / share.sum() * (all_tokens if budget is None else budget)
    steepest = float(np.linalg.eigvalsh(gram)[-1])
    scaled = np.linalg.inv(gram + 1e-6 * steepest * np.eye(k))
    history, newton = [totals], True
    for _ in range(steps):
        residual = history[-1] - targets
        if np.abs(residual).max() <= tolerance * all_tokens:
            break
        tried = np.vstack([path, scaled @ residual if newton else residual / steepest])
        totals, _ = _sum_over(members, tried)
        if newton and np.linalg.norm(totals - targets) >= np.linalg.norm(residual):
            newton = False  # many rates are at 0: go on with plain gradient steps
            continue
        path = tried
        history.append(totals)
    fit = Mix(domains, path, targets, history)
    if fit.residual > tolerance:
        warnings.warn(f"targets missed by up to {fit.residual:.2%} of all tokens after {len(path)} steps", stacklevel=2)
    return fit


def tempered(totals: dict[str, float], power: float) -> dict[str, float]:
    """Target weights between the natural shares (power 1) and equal ones (power 0)."""
    return {d: max(t, 0.0) ** power for d, t in totals.items()}


def rate_documents(
    docs: DataFrame, table: DataFrame, label: str, weights: dict[str, float] | None = None, power: float = 0.0,
    budget: float | None = None, key: str = "doc_id", text: str = "text",
) -> tuple[DataFrame, Mix]:
    """(key, tokens, p, rate) of every row, and the fit.

    Without ``weights`` the targets are the corpus' own shares to ``power``: equal shares by default.
    """
    model = fit_domains(docs, table, label, key=key, text=text)
    members = memberships(docs, model, key, text)
    if weights is None:
        now = _sum_over(members, np.zeros((0, len(model.domains))))[0] if model.domains else []
        weights = tempered(dict(zip(model.domains, now, strict=True)), power)
    fit = fit_rates(members, model.domains, weights, budget)
    return members.withColumn("rate", fit.rate() if model.domains else F.lit(1.0)), fit


def copies(rate: Column, key: Column) -> Column:
    """Whole copies of a row: floor(rate), and one more by a hash draw below the rest."""
    draw = F.shiftrightunsigned(F.xxhash64(key, F.lit("mixing")), 11).cast("double") / F.lit(float(1 << 53))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix_documents(docs: DataFrame, table: DataFrame, label: str, power: float = 0.7, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` as often as their sampled copies, columns unchanged.

    Posteriors are recomputed beside the rows, so whole texts are not shuffled.
    """
    model = fit_domains(docs, table, label, key=key)
    if not model.domains:
        return docs
    members = memberships(docs, model, key)
    now = _sum_over(members, np.zeros((0, len(model.domains))))[0]
    fit = fit_rates(members, model.domains, tempered(dict(zip(model.domains, now, strict=True)), power))
    shared, path, at = docs.sparkSession.sparkContext.broadcast(model), fit.path, docs.schema.fieldNames().index("text")
    rate, n, copy = (free_name(c, docs) for c in ("rate", "n", "copy"))
    rated = StructType([*docs.schema.fields, StructField(rate, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rates = [_rates(shared.value.posteriors(x).astype(np.float64), path) for _, x, _ in features(batch.column(at))]
            rates = pa.array(np.concatenate([*rates, np.zeros(0)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, rates], names=[*batch.schema.names, rate])

    dealt = docs.mapInArrow(run, rated).withColumn(n, copies(F.col(rate), F.col(key)))
    more = F.explode(F.sequence(F.lit(1), F.col(n)))
    return dealt.where(F.col(n) >= 1).withColumn(copy, more).select(*docs.columns)
