"""Language identification by compression.

Each language has a raw-content zstandard dictionary made from its training texts. A text is
compressed whole with every dictionary; the one that leaves the fewest bytes names the
language. If the runner-up is nearly as small, the prediction is marked as rejected.

Edge cases: null texts and texts without a letter are ``und`` with score 0; ties go to the
first language by name; repeated rows get the same result; without training texts every text
is ``und``; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .labelled import fold
from .store import stage

#: Training texts of each language, and bytes of each dictionary, at most.
TEXTS_A_LANGUAGE = 160
DICTIONARY_BYTES = 48 << 10
#: Bytes of one run of words that goes into a dictionary.
PIECE_BYTES = 160
#: Languages that one model holds at most (the dictionaries are broadcast).
MOST_LANGUAGES = 500
LEVEL = 6
UNKNOWN = "und"

#: ASCII bytes that are no letter become blanks, so that layout says nothing.
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def reduced(text: str) -> bytes:
    """The bytes of a whole text that are compressed."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())


def spread(data: bytes, share: int) -> bytes:
    """About ``share`` bytes of ``data``, in runs of whole words that lie evenly over all of it."""
    if len(data) <= share:
        return data
    runs = []
    for at in np.linspace(0, len(data) - PIECE_BYTES, max(1, share // PIECE_BYTES)).astype(int).tolist():
        run = data[at : at + PIECE_BYTES]
        runs.append(run[run.find(b" ") + 1 : run.rfind(b" ") if b" " in run.strip() else None])
    return b" ".join(runs)


@dataclass(frozen=True)
class Dictionaries:
    """Raw dictionary content by language."""

    content: dict[str, bytes]
    margin: float = 0.01

    def compressors(self) -> list[tuple[str, object]]:
        import zstandard

        out = []
        for lang in sorted(self.content):
            raw = zstandard.ZstdCompressionDict(self.content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=LEVEL)
            packer = zstandard.ZstdCompressor(dict_data=raw, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)
            out.append((lang, packer))
        return out


def classify(text: str | None, packers: list[tuple[str, object]], margin: float) -> tuple[str, float, bool]:
    """(language, score from 0 to 1, rejected) of one whole text."""
    if not text or not packers or not any(c.isalpha() for c in text):
        return UNKNOWN, 0.0, True
    data = reduced(text)
    sizes = np.array([len(p.compress(data)) for _, p in packers], float)
    best = int(sizes.argmin())
    bits = (sizes - sizes[best]) / (1 + 0.01 * sizes[best])
    score = float(1 / np.exp(-bits).sum())
    others = np.delete(sizes, best)
    rejected = bool(len(others) and others.min() - sizes[best] < margin * sizes[best])
    return packers[best][0], score, rejected


def fit_dictionaries(
    docs: DataFrame, held_out: Column, lang: str = "lang", key: str = "doc_id", text: str = "text",
    texts: int = TEXTS_A_LANGUAGE, size: int = DICTIONARY_BYTES,
) -> Dictionaries:
    """Dictionaries from at most ``texts`` training texts a language, taken by a hash of the key.

    Of a text, runs of words spread evenly over its whole length are taken, twice its share of
    ``size`` in all; equal contributions (copies) count once. A key with several texts has its smallest.
    """
    rows = docs.where(F.col(lang).isNotNull() & ~held_out & F.col(key).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(key).alias("k"), F.col(lang).cast("string").alias("l"), F.col(text).alias("t"))
    order = Window.partitionBy("l").orderBy(F.xxhash64("k", F.lit("dictionary")), "k")
    chosen = stage(rows.select("k", "l", F.row_number().over(order).alias("n")).where(F.col("n") <= texts), "lang-sample")
    if chosen.select("l").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; raise MOST_LANGUAGES if dictionaries of all still fit a worker")
    found = rows.join(F.broadcast(chosen.groupBy("k", "l").agg(F.min("n").alias("n"))), ["k", "l"])
    found = found.groupBy("k", "l").agg(F.min("n").alias("n"), F.min("t").alias("t")).select("l", "n", "t")
    share = max(64, 2 * size // texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = pa.array([spread(reduced(t), share) for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), data], names=["l", "n", "data"])

    taken = found.mapInArrow(run, "l string, n int, data binary").toArrow().sort_by([("l", "ascending"), ("n", "ascending"), ("data", "ascending")])
    pieces: dict[str, dict[bytes, None]] = {}
    for name, data in zip(taken.column("l").to_pylist(), taken.column("data").to_pylist(), strict=True):
        pieces.setdefault(name, {}).setdefault(data)
    return Dictionaries({k: b" ".join(reversed(v))[-size:] for k, v in pieces.items() if any(v)})


def predict_languages(docs: DataFrame, model: Dictionaries, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score and rejected of every row; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = shared.value.compressors()
        for batch in batches:
            found = [classify(v.as_py(), packers, shared.value.margin) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()), pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_()),
                ],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    schema = "doc_id long, lang_pred string, score double, rejected boolean"
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def identify(docs: DataFrame, folds: int = 3, fold_out: int = 1, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Fit outside the held-out fold, predict every row."""
    held_out = fold(key, folds) == F.lit(fold_out)
    model = fit_dictionaries(docs, held_out, lang, key, text)
    return predict_languages(docs, model, key, text).select(
        "doc_id", (fold("doc_id", folds) == F.lit(fold_out)).alias("held_out"), "lang_pred", "score", "rejected"
    )
