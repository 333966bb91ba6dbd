"""Scripts against a plain loop, signature operations and features by hand."""

import random

from pyspark.sql import functions as F

from ledgerloom.plans import scripts as S


def plain(b):
    """(legacy, accurate, pushes, push_only, last, multisig) by one loop over the instructions."""
    i, out, whole = 0, [], True
    while i < len(b):
        c = b[i]
        head, width = (1, 0) if c < 76 else ({76: 2, 77: 3, 78: 5}.get(c, 1), {76: 1, 77: 2, 78: 4}.get(c, 0))
        if c > 78:
            out.append(c)
            i += 1
            continue
        if i + head > len(b):
            whole = False
            break
        n = c if c < 76 else int.from_bytes(b[i + 1 : i + 1 + width], "little")
        if i + head + n > len(b):
            whole = False
            break
        out.append(b[i + head : i + head + n])
        i += head + n
    legacy = accurate = number = 0
    for x in out:
        if isinstance(x, bytes):
            number = 0
        elif x in (172, 173):
            legacy, accurate = legacy + 1, accurate + 1
        elif x in (174, 175):
            legacy, accurate = legacy + 20, accurate + (number or 20)
        else:
            number = x - 80 if 81 <= x <= 96 else 0
    ops = [x for x in out if not isinstance(x, bytes)]
    last = out[-1] if whole and out and isinstance(out[-1], bytes) else None
    keys = [isinstance(x, bytes) for x in out[1:-2]]
    multisig = whole and len(out) > 2 and not isinstance(out[0], bytes) and 81 <= out[0] <= 96 and all(keys) and out[-1] == 174 and not isinstance(out[-2], bytes)
    multisig = multisig and out[0] - 80 <= len(keys) and (not 81 <= out[-2] <= 96 or out[-2] - 80 == len(keys))
    return legacy, accurate, len(out) - len(ops), whole and all(x <= 96 for x in ops), last, bool(multisig)


def push(b):
    return bytes([len(b)]) + b if len(b) < 76 else b"\x4c" + bytes([len(b)]) + b if len(b) < 256 else b"\x4d" + len(b).to_bytes(2, "little") + b


def test_walk_against_a_loop(spark):
    rng = random.Random(2)
    piece = lambda: rng.choice([bytes([rng.choice([0, 79, 81, 82, 96, 97, 106, 172, 173, 174, 175, 255])]), push(rng.randbytes(rng.choice([0, 1, 33, 75, 76, 255, 256]))), rng.randbytes(2), b"\x4e\x02\0\0\0ab"])
    have = [b"".join(piece() for _ in range(rng.randrange(8))) for _ in range(600)]
    have += [rng.randbytes(rng.randrange(60)) for _ in range(300)] + [b"\x4c", b"\x4d\x01", b"\x4e\xff\xff\xff\xff", b"\x4e\x01\0\0", b"\x52\xae\xac", b"\x05ab", b"\x6a" * 20_000]
    for m, n, said in [(1, 2, 2), (2, 1, 1), (1, 2, 3), (2, 3, 3), (16, 16, 16), (1, 1, 17)]:
        have.append(bytes([80 + m]) + push(b"k" * 33) * n + bytes([80 + said]) + b"\xae")
    got = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(have)], "i long, s binary").repartition(4).select("i", S.walk(F.col("s")).alias("w")).collect()
    for r in got:
        w = r.w
        assert (w.legacy, w["accurate"], w.pushes, w.push_only, None if w["last"] is None else bytes(w["last"]), w.multisig) == plain(have[r.i]), have[r.i].hex()[:200]
    assert len(got) == len(have) and spark.range(1).select(S.walk(F.lit(None).cast("binary")).alias("w")).first().w.legacy == 0


KEY, HASH, LONG = b"\2" * 33, b"h" * 20, b"s" * 32
TYPES = {
    "empty": b"", "p2a": b"\x51\x02Ns", "p2wpkh": b"\0\x14" + HASH, "p2sh": b"\xa9\x14" + HASH + b"\x87", "p2pkh": b"\x76\xa9\x14" + HASH + b"\x88\xac", "p2wsh": b"\0\x20" + LONG,
    "p2tr": b"\x51\x20" + LONG, "p2pk33": push(KEY) + b"\xac", "p2pk65": push(b"\4" * 65) + b"\xac", "op_return": b"\x6a\x02\n\n\xac", "p2ms": b"\x51" + push(KEY) * 2 + b"\x52\xae", "unknown": b"\xac\xae",
}


def test_types_operations_and_features(spark):
    outs = [(k, t, bytearray(s), 100) for k, (t, s) in enumerate(TYPES.items())]
    df = spark.createDataFrame(outs, "tx_idx long, want string, script binary, sats long")
    assert all(r.want == r.got for r in df.select("want", S.output_type(F.col("script")).alias("got")).collect())
    made = {"p2pkh": 1, "p2pk33": 1, "p2pk65": 1, "p2ms": 20, "op_return": 1, "unknown": 21}
    two = b"\x52" + push(KEY) * 3 + b"\x53\xae"
    inputs = {  # number: coinbase, type spent, script, witness, cost
        100: (True, None, b"\xac\x01a", None, 4), 101: (False, "p2pkh", push(b"sig") + push(KEY), [], 0), 102: (False, "unknown", b"\xac", [], 4),
        103: (False, "p2sh", b"\0" + push(b"sig") + push(two), [], 12), 104: (False, "p2sh", push(TYPES["p2wpkh"]), [b"s", KEY], 1), 105: (False, "p2sh", push(TYPES["p2wsh"]), [b"s", two], 3),
        106: (False, "p2wpkh", b"", [b"s", KEY], 1), 107: (False, "p2wsh", b"", [b"", b"s", two], 3), 108: (False, "p2tr", b"", [b"s" * 64, b"\x50annex"], 0), 109: (False, "p2wsh", b"", [], 0),
        110: (False, "p2sh", b"\x51\x61", [], 0), 111: (False, "p2sh", b"\x61" + push(TYPES["p2wpkh"]), [b"s", KEY], 0), 112: (False, "p2tr", None, [b"\x50"], 0),
    }
    ins = spark.createDataFrame([(t, c, k, s if s is None else bytearray(s), w and [bytearray(x) for x in w]) for t, (c, k, s, w, _) in inputs.items()], "tx_idx long, is_coinbase boolean, prev_type string, script_sig binary, witness array<binary>")
    cost = {r.tx_idx: r.sigops for r in S.signature_operations(ins, df).collect()}
    assert cost == {t: x[-1] for t, x in inputs.items()} | {k: 4 * made.get(t, 0) for k, t, *_ in outs}
    bit = lambda *names: sum(1 << S.FEATURES[n] for n in names)
    mask = {r.tx_idx: r["mask"] for r in S.features(ins, df).collect()}
    assert mask[108] == bit("p2tr", "annex") and mask[112] == bit("p2tr") and mask[100] == 0 and mask[103] == bit("p2sh")
    assert mask[7] == mask[8] == bit("p2pk", "dust_output") and mask[9] == bit("op_return") and mask[0] == bit("empty", "dust_output")
    count = S.features_by_block(spark.createDataFrame([(1, m) for m in mask.values()], "height long, mask int")).first()
    assert (count.p2pk, count.p2sh, count.annex) == (2, 6, 1)
