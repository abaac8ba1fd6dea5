"""Quality classifier: a sparse ensemble of rules.

Statistics of the whole text go into boosted shallow trees; every path of a tree is a
conjunctive rule; a lasso-penalised logistic regression weighs the rules, most to zero; the
others become one Spark column expression over the statistics.

Edge cases: null and empty texts have all statistics 0 and get the score that the rules give
these; repeated rows score alike; without both classes among the labels the score is the mean
label (0.5 without labels); extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import fold, labelled_sample
from .wordhash import NOT_BLANK, chunks, span_hashes, words

#: Labelled rows that the fit uses at most.
MOST_LABELLED = 8_000

#: Classes of bytes that are counted (fixed values); all other bytes are class "other".
BYTE_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "blank": b" \t\r\x0b\x0c",
    "newline": b"\n",
    "stop": b".",
    "comma": b",;:",
    "shout": b"!?",
    "bar": b"|\\/",
    "symbol": b"#$%&*@^~+=<>",
    "bracket": b"()[]{}",
    "quote": b"'\"`-_",
    "high": bytes(range(0x80, 0x100)),
}
_CLASS = np.full(256, len(BYTE_CLASSES), np.int64)
for _i, _bytes in enumerate(BYTE_CLASSES.values()):
    _CLASS[list(_bytes)] = _i

_ODD, _PLAIN = (
    np.isin(_CLASS, [list(BYTE_CLASSES).index(c) for c in names])
    for names in (("shout", "bar", "symbol"), ("lower", "upper", "high"))
)

STATISTICS = [
    "log_bytes", "log_words", *[f"share_{c}" for c in BYTE_CLASSES], "share_other", "word_length",
    "words_a_line", "distinct_words", "distinct_lines", "symbol_words", "bare_words", "long_words",
]

_NEWLINE = np.arange(256) != 0x0A


def _distinct_share(hashes: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Distinct hashes over all hashes, of each text; 0 without any."""
    out = np.zeros(texts)
    cuts = np.searchsorted(owner, np.arange(texts + 1))
    for i in range(texts):
        if (n := cuts[i + 1] - cuts[i]) > 0:
            out[i] = len(np.unique(hashes[cuts[i] : cuts[i + 1]])) / n
    return out


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text."""
    out = [np.zeros((0, len(STATISTICS)))]
    for _, data, offsets in chunks(column):
        texts, sizes = len(offsets) - 1, np.diff(offsets)
        owner = np.repeat(np.arange(texts), sizes)
        kinds = _CLASS[data]
        n = len(BYTE_CLASSES) + 1
        counts = np.bincount(owner * n + kinds, minlength=texts * n).reshape(texts, n)
        starts, ends, first = words(data, offsets)
        n_words = np.diff(first)
        of = np.repeat(np.arange(texts), n_words)
        lengths = ends - starts
        odd_before, plain_before = (np.concatenate([[0], np.cumsum(x[data])]) for x in (_ODD, _PLAIN))
        has_odd = odd_before[ends] > odd_before[starts]
        has_plain = plain_before[ends] > plain_before[starts]
        per = lambda x: np.bincount(of, weights=x, minlength=texts)  # noqa: B023, E731
        l_starts, l_ends, l_first = words(data, offsets, _NEWLINE)
        n_lines = np.diff(l_first)
        some = np.maximum(n_words, 1)
        stats = [
            np.log1p(sizes), np.log1p(n_words), *(counts / np.maximum(sizes, 1)[:, None]).T, per(lengths) / some,
            n_words / np.maximum(n_lines, 1),
            _distinct_share(span_hashes(data, starts, ends), of, texts) if len(data) else np.zeros(texts),
            _distinct_share(span_hashes(data, l_starts, l_ends), np.repeat(np.arange(texts), n_lines), texts) if len(data) else np.zeros(texts),
            per(has_odd) / some, per(~has_plain) / some, per(lengths > 20) / some,
        ]
        out.append(np.column_stack(stats))
    return np.concatenate(out)


def stat_prefix(docs: DataFrame) -> str:
    """``_stat_``, with underscores in front until no column of ``docs`` starts with it."""
    prefix = "_stat_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    return prefix


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one column for each statistic, named by ``stat_prefix(docs)``; one scan, no shuffle."""
    prefix = stat_prefix(docs)
    names = [f"{prefix}{s}" for s in STATISTICS]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = statistics(batch.column(batch.schema.get_field_index(text)))
            more = [pa.array(np.ascontiguousarray(stats[:, i])) for i in range(stats.shape[1])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


# --- fitting, in numpy --------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """All of (statistic, is greater than, threshold) hold."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        return reduce(np.logical_and, [(x[:, f] > t) == up for f, up, t in self.terms])

    def column(self, prefix: str = "_stat_") -> Column:
        terms = [F.col(f"{prefix}{STATISTICS[f]}") > F.lit(t) for f, _, t in self.terms]
        return reduce(Column.__and__, [c if up else ~c for c, (_, up, _) in zip(terms, self.terms, strict=True)])


@dataclass
class RuleEnsemble:
    bias: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self, prefix: str = "_stat_") -> Column:
        """Probability of label 1, as a column over the statistics."""
        total = F.lit(float(self.bias))
        for rule, weight in self.rules:
            total = total + F.when(rule.column(prefix), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-sum((w * r.holds(x) for r, w in self.rules), np.full(len(x), self.bias))))


def _tree_paths(binned: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, depth: int, leaf: int, features: np.ndarray):
    """Grow one regression tree; gives (terms, rows, value) of every node but the root."""
    nodes = [((), np.arange(len(gradient)))]
    found = []
    for level in range(depth):
        below = []
        for terms, rows in nodes:
            best = (1e-6, None, None)
            g_all, h_all = gradient[rows].sum(), hessian[rows].sum()
            for f in features:
                n = len(cuts[f]) + 1
                b = binned[rows, f]
                count = np.cumsum(np.bincount(b, minlength=n))[:-1]
                g = np.cumsum(np.bincount(b, weights=gradient[rows], minlength=n))[:-1]
                h = np.cumsum(np.bincount(b, weights=hessian[rows], minlength=n))[:-1]
                ok = (count >= leaf) & (len(rows) - count >= leaf)
                if ok.any():
                    gain = np.where(ok, g**2 / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all**2 / (h_all + 1), 0)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], f, k)
            if best[1] is None:
                continue
            _, f, k = best
            up = binned[rows, f] > k
            for side in (False, True):
                part = rows[up == side]
                node = ((*terms, (int(f), side, float(cuts[f][k]))), part)
                below.append(node)
                found.append((*node, -gradient[part].sum() / (hessian[part].sum() + 1), level == depth - 1))
        nodes = below
    return found


def fit_rules(
    x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, leaf: int = 10, penalty: float = 3e-4, steps: int = 250, seed: int = 7
) -> RuleEnsemble:
    """Boosted trees to rules, then proximal-gradient lasso on the logistic loss."""
    if not len(y) or y.min() >= 0.5 or y.max() < 0.5:
        mean = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return RuleEnsemble(float(np.log(mean / (1 - mean))))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0.005, 0.995, 64))) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)])
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        chosen = rng.choice(x.shape[1], max(3, x.shape[1] // 2), replace=False)
        rows = rng.random(len(y)) < 0.7
        for terms, _, value, last in _tree_paths(binned[rows], cuts, (p - y)[rows], (p * (1 - p))[rows], depth, leaf, chosen):
            rule = Rule(tuple(sorted(terms)))
            rules.setdefault(rule)
            if last:
                margin += 0.3 * value * rule.holds(x)
    names = list(rules)
    if not names:
        return fit_rules(x, np.full(len(y), y.mean() * 0.49))
    a = np.column_stack([r.holds(x) for r in names]).astype(np.float32)
    scale = np.maximum(a.std(axis=0), 0.02)
    mean = a.mean(axis=0)
    z = (a - mean) / scale
    step = 4 * len(y) / np.linalg.norm(z, 2) ** 2
    w = v = np.zeros(len(names), np.float32)
    bias, t = float(np.log(y.mean() / (1 - y.mean()))), 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(z @ v + bias))) - y
        bias -= float(4 * error.mean())
        u = v - step * (z.T @ error) / len(y)
        new = (np.sign(u) * np.maximum(np.abs(u) - step * penalty, 0)).astype(np.float32)
        t, last_t = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v = new + (last_t - 1) / t * (new - w)
        w = new
    weights = w / scale
    kept = [(r, float(k)) for r, k in zip(names, weights, strict=True) if k != 0]
    return RuleEnsemble(bias - float((weights * mean).sum()), kept)


def fit_quality(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "quality", most: int = MOST_LABELLED, key: str = "doc_id", text: str = "text") -> RuleEnsemble:
    """Fit on at most ``most`` labelled rows; only their statistics reach the driver."""
    sample = with_statistics(labelled_sample(docs, labels, label, held_out, most, key, text))
    table = sample.select("y", *[f"_stat_{s}" for s in STATISTICS]).toArrow()
    x = np.column_stack([table.column(f"_stat_{s}").to_numpy() for s in STATISTICS])
    y = table.column("y").to_numpy()
    order = np.lexsort([*x.T, y])  # the order of the rows must not matter
    return fit_rules(x[order], y[order])


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, fold_out: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out and score of every row."""
    held_out = fold(key, folds) == F.lit(fold_out)
    model = fit_quality(docs, labels, held_out, key=key, text=text)
    return with_statistics(docs.select(key, text), text).select(key, held_out.alias("held_out"), model.score().alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, fold_out: int = 0) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, columns unchanged."""
    model = fit_quality(docs, labels, fold("doc_id", folds) == F.lit(fold_out))
    return with_statistics(docs).where(model.score(stat_prefix(docs)) >= F.lit(threshold)).select(*docs.columns)
