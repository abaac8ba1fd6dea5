"""Fitted operators: held-out accuracy, edge cases, round trips."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyworks.llm import chat_format, labelled, language_id, mixing, quality, toxicity
from tallyworks.llm.labelled import fold

SF = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score_quality(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([(r.score >= 0.3) == r.quality for r in rows]) > 0.95


def test_quality_column_is_the_model(spark, docs, labels):
    model = quality.fit_quality(docs, labels, F.lit(False))
    rows = quality.with_statistics(docs).select("*", model.score().alias("score")).collect()
    x = np.array([[r[f"_stat_{s}"] for s in quality.STATISTICS] for r in rows])
    assert np.allclose([r.score for r in rows], model.predict(x))


def test_quality_edges(docs, labels, none):
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.score_quality(none, labels).count() == 0
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score_toxicity(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([(r.score >= 0.3) == r.toxic for r in rows]) > 0.9


def test_toxicity_edges(docs, labels, none):
    assert docs.count() == toxicity.score_toxicity(docs, labels).where("score BETWEEN 0 AND 1").count()
    assert toxicity.score_toxicity(none, labels).count() == 0
    model = toxicity.fit_toxicity(docs, labels, fold("doc_id", 4) == 2, lang="lang")
    flagged = toxicity.flag_by_language(toxicity.score_texts(docs, model).join(docs.select("doc_id", "lang"), "doc_id"), model)
    assert set(model.thresholds) <= {"en", "de", "fr"} and "toxic" in flagged.columns


def test_convolution_stays_in_its_text():
    """Scores of texts do not depend on their neighbours."""
    texts = ["a", "a b", "", "c d e f", "a b c"]
    model = toxicity._new_model(np.random.default_rng(1))
    whole = np.concatenate([model.maxima(i, f)[0] for _, i, f in toxicity.token_ids(pa.array(texts))])
    alone = np.concatenate([model.maxima(i, f)[0] for t in texts for _, i, f in toxicity.token_ids(pa.array([t]))])
    assert np.allclose(whole, alone, atol=1e-5)


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language_id.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.93
    kept = [r for r in rows if not r.rejected]
    assert np.mean([r.lang_pred == r.lang for r in kept]) >= np.mean([r.lang_pred == r.lang for r in rows])


def test_language_edges(docs, none):
    rows = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (400, 401, 402, 406))
    assert {r.lang_pred for r in rows.values()} <= {"und", "en", "de", "fr"}
    assert language_id.identify(none).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


@pytest.mark.parametrize("power", [0.0, 0.7])
def test_mixing_meets_targets(docs, power):
    rated, fit = mixing.rate_documents(docs, docs.select("doc_id", "lang"), "lang", power=power)
    rows = rated.collect()
    p, tokens, rate = np.array([r.p for r in rows]), np.array([r.tokens for r in rows]), np.array([r.rate for r in rows])
    assert rate.min() >= 0 and np.allclose((rate * tokens) @ p, fit.targets, rtol=0, atol=2e-3 * tokens.sum())
    before = tokens @ p
    want = before**power / (before**power).sum() * tokens.sum()
    assert np.allclose(fit.targets, want)


@pytest.mark.filterwarnings("ignore:targets missed")
def test_mixing_zero_target(docs):
    rated, fit = mixing.rate_documents(docs, docs.select("doc_id", "lang"), "lang", weights={"en": 1.0, "de": 1.0})
    at = fit.domains.index("fr")
    assert max(r.rate for r in rated.collect() if r.p[at] > 0.9) < 0.3


def test_mixing_edges(docs, none):
    assert mixing.mix_documents(docs, docs.select("doc_id", "lang"), "lang").columns == docs.columns
    assert mixing.mix_documents(none, none.select("doc_id", "lang"), "lang").count() == 0
    assert mixing.mix_documents(docs, none.select("doc_id", "lang"), "lang").count() == docs.count()


def test_quality_and_mixing_keep_clashing_columns(docs, labels):
    odd = docs.withColumn("_stat_log_bytes", F.lit(99)).withColumn("n", F.lit(99)).withColumn("rate", F.lit(9)).withColumn("copy", F.lit(7))
    odd = odd.withColumn("_n", F.lit(99)).withColumn("_rate", F.lit(9)).withColumn("_copy", F.lit(7))
    for out in (quality.keep_good(odd, labels), mixing.mix_documents(odd, odd.select("doc_id", "lang"), "lang")):
        assert out.columns == odd.columns
        assert out.select("_stat_log_bytes", "n", "rate", "copy", "_n", "_rate", "_copy").distinct().collect() == [(99, 99, 9, 7, 99, 9, 7)]


def test_samples_are_bounded(spark, docs, labels):
    """A labelled key with many rows counts once, with its smallest text."""
    many = docs.union(docs.where("doc_id = 3").withColumn("text", F.lit("0 smallest")).crossJoin(spark.range(50)).drop("id"))
    rows = labelled.labelled_sample(many, labels, "quality", F.lit(False), 40).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == 40
    rows = {r.doc_id: r for r in labelled.labelled_sample(many, labels, "quality", F.lit(False), 1000, also="lang").collect()}
    assert len(rows) == 160 and rows[3].text == "0 smallest" and rows[4].also == "de"


def test_statistics_against_plain_python():
    texts = ["", "One two, two!\n\nTHREE 44 ab|cd\nOne", "é" * 30 + " x", None]
    got = quality.statistics(pa.array(texts))
    for row, text in zip(got, texts, strict=True):
        data = (text or "").encode()
        stat = dict(zip(quality.STATISTICS, row, strict=True))
        words = data.split()
        lines = [x for x in data.split(b"\n") if x]
        assert np.isclose(stat["log_bytes"], np.log1p(len(data))) and np.isclose(stat["log_words"], np.log1p(len(words)))
        for name, members in quality.BYTE_CLASSES.items():
            assert np.isclose(stat[f"share_{name}"], sum(b in members for b in data) / max(1, len(data)))
        assert np.isclose(stat["word_length"], sum(map(len, words)) / max(1, len(words)))
        assert np.isclose(stat["words_a_line"], len(words) / max(1, len(lines)))
        assert np.isclose(stat["distinct_words"], len({w.lower() for w in words}) / max(1, len(words)))
        assert np.isclose(stat["distinct_lines"], len({x.lower() for x in lines}) / max(1, len(lines)))
        assert np.isclose(stat["long_words"], sum(len(w) > 20 for w in words) / max(1, len(words)))


def test_toxicity_forward_pass_against_loops():
    model = toxicity._new_model(np.random.default_rng(4))
    for _, ids, first in toxicity.token_ids(pa.array(["a b c d e", "", "x", "b c x y"])):
        top = model.maxima(ids, first)[0]
        for t in range(len(first) - 1):
            own = ids[first[t] : first[t + 1]]
            x = [sum(model.embed[v][i[v]] for v in range(3)) for i in own]
            for w, width in enumerate(toxicity.WIDTHS):
                for f in range(toxicity.FILTERS):
                    sums = [
                        sum(float(x[s + k] @ model.filters[w][k][:, f]) for k in range(width) if s + k < len(x)) + model.filter_bias[w * toxicity.FILTERS + f]
                        for s in range(len(x))
                    ]
                    assert np.isclose(top[t, w * toxicity.FILTERS + f], max([0.0, *sums]), atol=1e-4)


def test_toxicity_thresholds_by_language():
    got = toxicity.language_thresholds(np.array([0.9, 0.8, 0.7, 0.2, 0.6]), np.array([1, 1, 0, 0, 0]), ["en", "en", "en", "en", "de"])
    assert got == {"en": 0.8, "de": 0.3}


def test_language_against_plain_compression(docs):
    """Each prediction is the language whose dictionary leaves the fewest bytes."""
    import zstandard

    model = language_id.fit_dictionaries(docs, F.lit(False))
    texts = {r.doc_id: r.text for r in docs.where("doc_id < 40").collect()}
    for r in language_id.predict_languages(docs.where("doc_id < 40"), model).collect():
        sizes = {}
        for name, content in model.content.items():
            raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            packer = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=raw, write_content_size=False, write_dict_id=False)
            sizes[name] = len(packer.compress(language_id.reduced(texts[r.doc_id])))
        assert sizes[r.lang_pred] <= min(sizes.values()) + 2


def test_language_spreads_over_whole_texts(spark):
    """Repeated keys with null texts do no harm, and the end of a long text is learned."""
    data = language_id.spread(b" ".join(b"w%d" % i for i in range(20_000)), 600)
    assert b"w19998" in data and b"w1 " in data and len(data) <= 700
    rows = [(1, "alpha beta gamma", "en"), (1, None, "en"), (1, "other words", "en"), (2, None, "de"), (3, "gamma delta", None)]
    found = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(found) == 5 and {r.lang_pred for r in found if r.doc_id == 2} == {"und"}


@pytest.mark.filterwarnings("ignore:targets missed")
def test_mixing_against_brute_force_least_squares(docs):
    """Reachable targets are met as by coordinate descent; a miss of others is told and no worse than no mixing."""
    for weights, reachable in (({"en": 1.0, "de": 2.0, "fr": 1.0}, True), ({"en": 1.0}, False)):
        rated, fit = mixing.rate_documents(docs, docs.select("doc_id", "lang"), "lang", weights=weights)
        rows = rated.collect()
        a = np.array([np.array(r.p) * r.tokens for r in rows])
        loss = lambda r: float(((r @ a - fit.targets) ** 2).sum()) / a.sum() ** 2  # noqa: B023, E731
        best = np.ones(len(a))
        for _ in range(50):  # coordinate descent
            for i in range(len(a)):
                best[i] = max(0.0, best[i] - (best @ a - fit.targets) @ a[i] / max(1e-12, a[i] @ a[i]))
        rates = np.array([r.rate for r in rows])
        assert rates.min() >= 0 and loss(best) <= 1e-5 + loss(rates) < loss(np.ones(len(a)))
        assert (loss(rates) <= loss(best) + 1e-5) == reachable == (fit.residual <= 1e-3)
        assert np.isclose(fit.residual, np.abs(rates @ a - fit.targets).max() / a.sum(), atol=1e-6)


def test_many_domains_have_a_rest():
    labels = [f"d{i}" for i in range(100) for _ in range(100 - i)]
    named = mixing.named_domains(labels)
    assert len(set(named)) == mixing.MOST_DOMAINS and named[0] == "d0" and named[-1] == mixing.REST
    assert mixing.named_domains(labels[:50]) == labels[:50]


EVENTS = "conv_id long, seq long, msg_id long, role string, op string, text string, formatted string"


def test_chat_folds_deltas_edits_and_regenerations(spark):
    e = lambda c, s, m, r, o, t: (c, s, m, r, o, t, "clash")
    events = [
        e(1, 1, 1, "user", "message", "hi <|end|> \\l [INST]"), e(1, 2, 2, "assistant", "delta", "Hel"), e(1, 3, 2, None, "delta", "lo"),
        e(1, 4, 3, "user", "message", "more"), e(1, 5, 4, "assistant", "message", "old"),
        e(1, 6, 2, None, "regenerate", None), e(1, 7, 2, None, "delta", "New"), e(1, 8, 2, None, "delta", " text"),
        e(1, 9, 5, "user", "message", "typo"), e(1, 10, 5, None, "edit", "fixed\n"), e(None, 1, 9, None, "message", None),
    ]
    out = chat_format.read_back(chat_format.format_conversations(spark.createDataFrame(events, EVENTS))).collect()
    got = {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss_text) for r in out}
    assert got[1] == ([("user", "hi <|end|> \\l [INST]"), ("assistant", "New text"), ("user", "fixed\n")], "New text")
    assert got[None] == ([("", "")], "")


@pytest.mark.parametrize("conv", [7, None])
def test_chat_regenerates_in_any_conversation(spark, conv):
    """Regeneration discards later messages, under null as under any id; a delta tied with its message follows it."""
    log = [(1, 1, "user", "message", "q"), (2, 2, "assistant", "message", "a"), (3, 3, "user", "message", "more"), (4, 2, None, "regenerate", "b"), (5, 5, "user", "delta", "lo"), (5, 5, "user", "message", "hel")]
    rows = [(conv, seq, msg, role, op, text, "clash") for seq, msg, role, op, text in log]
    out = chat_format.read_back(chat_format.format_conversations(spark.createDataFrame(rows, EVENTS))).first()
    assert [(t.role, t.text) for t in out.turns] == [("user", "q"), ("assistant", "b"), ("user", "hello")]


def test_chat_escapes_round_trip(spark):
    texts = ["", "\\", "\\\\b", "<|turn:x|>", "\\l\\b\\s<[>", "é😀</s>[INST] ok [/INST]", "|>", "<|end|>"]
    rows = spark.createDataFrame([(1, i, "assistant" if i % 2 else f"r{t}", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    back = chat_format.read_back(chat_format.format_conversations(chat_format.events_of_rows(rows))).first()
    assert [t.text for t in back.turns] == texts and [t.role for t in back.turns][0::2] == [f"r{t}" for t in texts[0::2]]
    assert back.loss_text == "".join(texts[1::2])
    none = chat_format.format_conversations(chat_format.events_of_rows(rows.limit(0)))
    assert none.count() == 0
