"""Phases and kinds of data outputs, from values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import market, network


def push(data: bytes) -> bytes:
    return b"\x6a" + bytes([len(data)]) + data


SCRIPTS = [
    (b"\x6a\x5d\x02ab", "runes"), (b"\x6a", "empty"), (b"\x6a\x00\x51", "empty"), (b"\x6a\x05abc", "empty"), (push(b"omni" + bytes(16)), "omni"),
    (b"\x6a\x00\x51\x04omni", "omni"), (b"\x6a\x4c\x04omni", "omni"), (b"\x6a\x4d\x04\x00omni", "omni"), (b"\x6a\x4e\x04\x00\x00\x00omni", "omni"), (b"\x6a\x4d\x04", "empty"),
    (push(b"X2" + bytes(30)), "stacks"), (push(b"X1"), "stacks"), (push(b"id;"), "blockstack"), (push(b"CC"), "colu"), (push(b"OA\x01\x00"), "open_assets"), (push(b"OA\x02\x00"), "unknown"), (push(b"SPK"), "coinspark"),
    (push(b"POET"), "poet"), (push(b"DOCPROOF" + bytes(32)), "docproof"), (push(bytes.fromhex("0588960d73d71901") + bytes(24)), "opentimestamps"), (push(b"Factom!!"), "factom"), (push(b"EW "), "eternity_wall"),
    (push(b"m\x07hi"), "memo"), (push(b"m\x0chi"), "memo"), (push(b"m\x08hi"), "unknown"), (push(b"BP"), "bitproof"), (push(b"ASCRIBE\x00"), "ascribe"), (push(b"Stampery"), "stampery"), (push(b"EPOBC"), "epobc"),
    (b"\x6a\x4c\x50" + bytes(80), "veriblock"), (push(bytes(36)), "komodo"), (push(bytes(20)), "bare_hash"), (push(bytes(32)), "bare_hash"), (push(b"a line of words"), "text"), (push(b"abc"), "unknown"),
    (push(b"abcdefghi\x00"), "text"), (push(b"abcdefgh\x00\x00"), "unknown"), (None, None),
]


def test_kinds_of_data_outputs(spark):
    df = spark.createDataFrame([(i, bytearray(s) if s is not None else None) for i, (s, _) in enumerate(SCRIPTS)], "i int, script binary")
    found = {r.i: r.kind for r in df.select("i", network.op_return_kind(F.col("script")).alias("kind")).collect()}
    assert [found[i] for i in range(len(SCRIPTS))] == [k for _, k in SCRIPTS]


PRICES = [
    ((100, 70, 80, 50, 60), "raging_bull"), ((100, 70, 80, 60, 90), "bull"), ((90, 70, 60, 80, 100), "cautious_bull"), ((40, 80, 60, 100, 20), "hopeful_bull"), ((90, 70, 60, 100, 80), "early_bull"),
    ((90, 70, 100, 60, 80), "weak_bull"), ((70, 80, 100, 60, 40), "limbo"), ((40, 80, 60, 100, 70), "deep_bear"), ((40, 80, 100, 60, 50), "bear"), ((60, 80, 100, 50, 70), "early_bear"),
    ((70, 50, 50, 50, 100), "cautious_bull"), ((100, 70, 80, 60, None), "bull"), ((90, 95, 80, 60, None), "early_bull"), ((70, 60, 80, 50, None), "weak_bull"), ((70, 75, 80, 50, None), "early_bear"), ((40, 80, 100, 60, None), "bear"),
    ((50, 60, 80, 100, None), "deep_bear"), ((85, 90, 80, 100, None), "cautious_bull"), ((None, 1, 1, 1, 1), None),
]


def test_phases(spark):
    df = spark.createDataFrame([(i, *p) for i, (p, _) in enumerate(PRICES)], "i int, price long, whole long, short long, long long, average long")
    found = {r.i: r.phase for r in df.select("i", market.sentiment(*map(F.col, ("price", "whole", "short", "long", "average"))).alias("phase")).collect()}
    assert [found[i] for i in range(len(PRICES))] == [k and market.PHASES[k] for _, k in PRICES]


def test_json_is_stamped_and_bounded(spark, monkeypatch):
    import json

    from ledgerloom.plans import catalogue

    df = spark.createDataFrame([(3, 7), (4, None)], "idx long, price long")
    made = json.loads(catalogue.as_json(df, ["price"], "height").first().json)
    assert list(made) == ["version", "index", "type", "start", "end", "stamp", "data"] and made["data"] == [7, None] and made["stamp"].endswith("Z")
    monkeypatch.setattr(catalogue, "MOST_CELLS", 1)
    with pytest.raises(ValueError):
        catalogue.as_json(df, ["price"], "height")
