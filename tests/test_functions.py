"""Pure functions against hand-made cases."""

import json
import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyworks.functions import scalars
from tallyworks.functions.cron import Cron
from tallyworks.functions.scalars import (
    available_tokens,
    backoff_seconds,
    decode_json,
    json_contains,
    metadata_contains,
    unique_key,
    valid_tags,
    visible,
)
from tallyworks.functions.topics import topic_matches, topic_regex
from tallyworks.operators import worker

#: One case for each rule of a pattern: whole words, one word, any number of words at either end or between, literals.
TOPICS = [
    ("ship.sent", "ship.sent", True), ("ship.sent", "shipXsent", False), ("ship.sent", "ship.sent.x", False), ("ship.sent", "ship.sent\n", False),
    ("ship.*", "ship.north", True), ("ship.*", "ship", False), ("ship.*", "ship.north.late", False), ("*.late", "north.late", True),
    ("ship.#", "ship", True), ("ship.#", "ship.north.late", True), ("ship.#", "shipping", False), ("#.late", "late", True),
    ("#.late", "ship.north.late", True), ("#.late", "translate", False), ("ship.#.late", "ship.late", True), ("ship.#.late", "ship.a.b.late", True),
    ("ship.#.late", "ship.later", False), ("#", "", True), ("#", "two\nlines", True), ("no#end", "no.way.to.end", True), ("1+1", "111", False), ("[q]", "[q]", True),
]


@pytest.mark.parametrize(("pattern", "topic", "want"), TOPICS)
def test_topic_regex(pattern, topic, want):
    assert bool(re.match(topic_regex(pattern).replace(r"\z", r"\Z"), topic)) is want


def test_topic_columns(spark):
    df = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(TOPICS)], "i int, topic string")
    for i, (pattern, _, want) in enumerate(TOPICS):
        assert df.where(F.col("i") == i).select(topic_matches(F.col("topic"), pattern)).first()[0] is want, TOPICS[i]


LEAF = st.one_of(st.none(), st.booleans(), st.integers(-3, 3), st.sampled_from(["u", "v"]))
VALUE = st.recursive(LEAF, lambda v: st.one_of(st.lists(v, max_size=3), st.dictionaries(st.sampled_from("klm"), v, max_size=3)), max_leaves=8)


def part_of(data, value):
    """Something that ``value`` contains: members left out, elements dropped, repeated and turned round."""
    if isinstance(value, dict):
        return {k: part_of(data, v) for k, v in value.items() if data.draw(st.booleans())}
    if isinstance(value, list):
        kept = [part_of(data, v) for v in value if data.draw(st.booleans())]
        return list(reversed(kept)) + kept[:1]
    return value


@given(st.data(), VALUE)
@settings(max_examples=200, deadline=None)
def test_json_contains_its_parts(data, value):
    have = decode_json(json.dumps(value))
    assert json_contains(have, decode_json(json.dumps(part_of(data, value))))
    if isinstance(value, dict):
        assert not json_contains(have, {**have, "other": True})


def test_json_contains_by_value_and_kind():
    contains = lambda a, b: json_contains(decode_json(a), decode_json(b))
    assert contains('{"w": 250}', '{"w": 2.5e2}') and contains('{"w": 0}', '{"w": -0.0}')  # numbers go by value
    assert not contains('{"w": 7}', '{"w": "7"}') and not contains('{"w": true}', '{"w": 1}')  # and never by their text
    assert contains('["u", 4]', "4") and not contains('{"w": [4]}', '{"w": 4}')  # a bare scalar only at the top
    assert not contains('["u"]', '["u", "v"]') and not contains("{}", "[]")


def test_metadata_paths_agree(spark):
    texts = ['{"a": 1, "t": {"x": "y"}}', '{"a": 1.0}', '{"a": "1"}', '{"a": 2}', "{}", None, '{"a": [1]}']
    df = spark.createDataFrame([(t,) for t in texts], "m string")
    for wanted in ({"a": 1}, {"t": {"x": "y"}}, {"a": [1]}):
        got = [r[0] for r in df.select(metadata_contains("m", wanted)).collect()]
        target = decode_json(json.dumps(wanted))
        assert [bool(g) for g in got] == [t is not None and json_contains(decode_json(t), target) for t in texts]


def test_json_number_bounds():
    decode_json('{"a": 1e131071}')
    for bad in ('{"a": 1e131072}', '{"a": 1e-16384}'):
        with pytest.raises(ValueError):
            decode_json(bad)


def test_unique_keys():
    now = datetime(2031, 4, 2, 7, 51, tzinfo=timezone.utc)
    assert unique_key() == "*"
    assert unique_key({"z": 1, "a": [1, 2]}) == 'a={"a":[1,2],"z":1}'
    assert unique_key(queue="print", period=timedelta(hours=1), now=now) == "q=print\np=2031-04-02T07:00:00Z"
    with pytest.raises(ValueError):
        unique_key("x" * 2000)


def test_backoff_and_tokens(spark):
    df = spark.createDataFrame([(a,) for a in (1, 2, 5, 30)], "a int")
    assert [r[0] for r in df.select(backoff_seconds(F.col("a"))).collect()] == [6, 21, 630, 86400]
    rows = spark.createDataFrame([(5.0, 2, 0.0)], "rate double, burst int, tokens double")
    at = lambda s: F.lit(f"2024-01-01 00:00:0{s}").cast("timestamp_ntz")
    tokens = available_tokens(F.col("rate"), F.col("burst"), F.col("tokens"), at(0), at(1))
    assert rows.select(tokens).first()[0] == 2.0


def test_visible(spark):
    df = spark.createDataFrame([(x,) for x in (9, 10, 12, 15, 20)], "x long")
    snap = F.struct(F.lit(10).alias("xmin"), F.lit(20).alias("xmax"), F.array(F.lit(12).cast("long")).alias("xip"))
    assert [r[0] for r in df.select(visible(F.col("x"), snap)).collect()] == [True, True, False, True, False]


def test_tags():
    assert valid_tags(["a", "b", "a"]) == ["a", "b"]
    for bad in ([""], ["a\n"], ["x" * 256], [str(i) for i in range(65)]):
        with pytest.raises(ValueError):
            valid_tags(bad)


def utc(*x):
    return datetime(*x, tzinfo=timezone.utc)


def brute_minutes(minutes, hours, days, months, weekdays, either, start, n):
    """The first matches later than ``start``, minute by minute; ``either``: a day of month or a weekday is enough."""
    at, out = start.replace(second=0, microsecond=0) + timedelta(minutes=1), []
    while len(out) < n:
        by = [at.day in days, at.isoweekday() % 7 in weekdays]
        if at.minute in minutes and at.hour in hours and at.month in months and (any(by) if either else all(by)):
            out.append(at)
        at += timedelta(minutes=1)
    return out


ANY_H, ANY_D, ANY_M, ANY_W = range(24), range(1, 32), range(1, 13), range(7)


@pytest.mark.parametrize(
    ("spec", "rule"),
    [
        ("7,37 * * * *", ({7, 37}, ANY_H, ANY_D, ANY_M, ANY_W, False)),
        ("5-50/15 4 * * *", ({5, 20, 35, 50}, {4}, ANY_D, ANY_M, ANY_W, False)),
        ("10 6 * * TUE,SAT", ({10}, {6}, ANY_D, ANY_M, {2, 6}, False)),
        ("0 22 3 * WED", ({0}, {22}, {3}, ANY_M, {3}, True)),  # both restricted: either is enough
        ("0 0 */9 * SUN", ({0}, {0}, {1, 10, 19, 28}, ANY_M, {0}, True)),  # a step restricts too
        ("15 3 ? JUN 7", ({15}, {3}, ANY_D, {6}, {0}, False)),
        ("@daily", ({0}, {0}, ANY_D, ANY_M, ANY_W, False)),
    ],
)
def test_cron_against_every_minute(spec, rule):
    start = utc(2031, 5, 28, 13, 22, 9)
    cron, at = Cron(spec), start
    for want in brute_minutes(*rule, start, 5):
        at = cron.after(at)
        assert at == want


def test_cron_follows_the_clock_of_its_zone():
    """Helsinki leaves summer time on 2031-10-26, 04:00 becoming 03:00, and enters it on 2031-03-30."""
    zone = ZoneInfo("Europe/Helsinki")
    cron = Cron("CRON_TZ=Europe/Helsinki 20 3 * * *")
    first = cron.after(datetime(2031, 10, 25, 12, tzinfo=zone))
    assert [first, cron.after(first)] == [utc(2031, 10, 26, 0, 20), utc(2031, 10, 26, 1, 20)]  # the hour comes twice
    assert cron.after(datetime(2031, 3, 29, 12, tzinfo=zone)) == utc(2031, 3, 31, 0, 20)  # and is left out in spring
    assert Cron("0 0 29 2 *").after(utc(2033, 1, 1)) == utc(2036, 2, 29)
    assert Cron("*/25 * * * * *").after(utc(2031, 1, 1, 0, 0, 26)) == utc(2031, 1, 1, 0, 0, 50)


def test_cron_rejects():
    """Too few or many fields, values beyond their bounds, empty steps, turned ranges and unknown names."""
    fields = ["1", "2", "3", "4", "5"]
    bad = [" ".join(fields[:n]) for n in range(5)] + [" ".join([*fields, "6", "7"])]
    for i, value in enumerate(["61", "25", "32", "14", "9"]):
        bad.append(" ".join([*fields[:i], value, *fields[i + 1 :]]))
    bad += [" ".join([v, *fields[1:]]) for v in ("*/0", "9-4", "x", "-1", "1,,2", "*/y")] + ["@never", "TZ=Nowhere/Land 1 2 3 4 5"]
    for spec in bad:
        with pytest.raises(ValueError):
            Cron(spec)


def test_cron_slots_are_never_cut_silently():
    cron = Cron("* * * * *")
    assert len(list(cron.slots(utc(2031, 1, 1), utc(2031, 1, 1, 0, 5), 5))) == 5
    with pytest.raises(ValueError):
        list(cron.slots(utc(2031, 1, 1), utc(2031, 1, 1, 0, 6), 5))


def test_canonical_keys_agree(spark):
    """The column form of a unique key is the one of Python values."""
    args = [{"z": 1, "a": [1, {"y": None, "b": "é"}]}, {}, {"k": True}]
    df = spark.createDataFrame([(json.dumps(a), "mail") for a in args], "args string, queue string")
    got = [r[0] for r in df.select(scalars.unique_key_column(F.col("args"), F.col("queue"))).collect()]
    assert got == [unique_key(a, "mail") for a in args]


def test_merges_positions_and_small_ints(spark):
    row = spark.createDataFrame([('{"a": 1, "b": {"c": 2}}', '{"b": 3}', None, "12:7", "12:x")], "a string, b string, n string, p string, q string")
    got = row.select(
        scalars.merged_objects(F.col("a"), F.col("b")), scalars.merged_objects(F.col("b"), F.col("a")), scalars.merged_objects(F.col("n"), F.col("b")),
        scalars.parse_position(F.col("p")), scalars.parse_position(F.col("q")),
    ).first()
    assert [json.loads(x) for x in got[:3]] == [{"a": 1, "b": 3}, {"a": 1, "b": {"c": 2}}, {"b": 3}]
    assert got[3] == (12, 7) and got[4] is None
    with pytest.raises(Exception, match="16-bit"):
        spark.range(40_000).select(scalars.small_int(F.col("id")).alias("x")).agg(F.max("x")).collect()


def test_codec_round_trip():
    for value in ({"a": [1, "é"]}, [], "text", None):
        assert worker.decode(worker.encode(value)) == worker.decode(worker.encode(value, packed=True)) == value


def test_middleware_order():
    log = []

    def wrap(name):
        def outer(handler):
            def run(job):
                log.append(name)
                return handler(job)

            return run

        return outer

    assert worker.guarded(worker.chained(lambda job: ("ok", job["id"], None), [wrap("first"), wrap("second")]))({"id": "1"}) == ("ok", "1", None)
    assert log == ["first", "second"]
    assert worker.guarded(lambda job: job["none"])({})[0] == "error"
