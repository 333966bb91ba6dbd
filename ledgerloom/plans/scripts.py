"""Scripts of inputs and outputs: their instructions, signature operations, types, and features of transactions as bit masks.

A script is walked by one fold over its bytes in the JVM: bytes within a push are passed over, and each costs the same whatever
the script's length. Null scripts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import once
from .network import dust

#: Features of transactions by their bit.
FEATURES = {"p2pk": 0, "p2ms": 1, "p2pkh": 2, "p2sh": 3, "p2wpkh": 4, "p2wsh": 5, "p2tr": 6, "p2a": 7, "op_return": 8, "empty": 9, "unknown": 10, "annex": 14, "dust_output": 21}
#: Shapes of output scripts in hexadecimal digits, the first that fits counts.
SHAPES = {
    "empty": "^$", "p2a": "^51024E73$", "p2wpkh": "^0014.{40}$", "p2sh": "^A914.{40}87$", "p2pkh": "^76A914.{40}88AC$", "p2wsh": "^0020.{64}$",
    "p2tr": "^5120.{64}$", "p2pk33": "^21.{66}AC$", "p2pk65": "^41.{130}AC$", "op_return": "^6A",
}
#: Weight units of a byte that isn't witness data.
SCALE = 4


def walk(script: Column) -> Column:
    """What the instructions of a script (binary) say, up to one that is cut off.

    A struct: ``legacy`` (signature operations, 20 for each multiple check), ``accurate`` (as many as the number just before a
    multiple check says), ``pushes``, ``push_only`` (no other opcode above 0x60, none cut off), ``last`` (the data of the last
    instruction, null if that is no push) and ``multisig`` (whether it is m keys, n keys and a multiple check).
    """
    script = F.coalesce(script, F.lit(b""))
    long = lambda n: F.lit(n).cast("long")
    length = F.length(script).cast("long")
    byte = lambda at: F.conv(F.hex(F.substring(script, at.cast("int"), F.lit(1))), 16, 10).cast("long")
    numbers = ["next", "number", "legacy", "accurate", "barred", "pushes", "at", "size", "stage", "least", "keys"]
    start = F.struct(*(long(1 if n == "next" else 0).alias(n) for n in numbers))

    def step(s: Column, i: Column) -> Column:
        def to(**new: Column) -> Column:
            return F.struct(*(new.get(n, s[n]).alias(n) for n in numbers))

        def read(code: Column) -> Column:
            little = sum((byte(i + k) * 256 ** (k - 1) for k in (2, 3, 4)), byte(i + 1))
            size = F.when(code < 76, code).when(code == 76, byte(i + 1)).when(code == 77, byte(i + 1) + 256 * byte(i + 2)).otherwise(little)
            first = i + F.when(code < 76, long(1)).when(code == 76, long(2)).when(code == 77, long(3)).otherwise(long(5))
            in_keys = s["stage"] == 1
            push = once(size, lambda n: F.when(first + n - 1 <= length, to(next=first + n, number=long(0), pushes=s["pushes"] + 1, at=first, size=n, stage=F.when(in_keys, long(1)).otherwise(long(-1)), keys=s["keys"] + in_keys.cast("long"))).otherwise(to(next=length + 1, barred=long(1), at=long(0), stage=long(-1))))
            number = F.when(code.between(81, 96), code - 80).otherwise(long(0))
            single, many = code.isin(172, 173), code.isin(174, 175)
            counted = F.when(s["number"] > 0, s["number"]).otherwise(long(20))
            closes = ((number == 0) | (number == s["keys"])) & (s["least"] <= s["keys"])
            stage = F.when((s["stage"] == 0) & (number > 0), long(1)).when(in_keys & closes, long(2)).when((s["stage"] == 2) & (code == 174), long(3)).otherwise(long(-1))
            op = to(
                next=i + 1, number=F.when(single | many, s["number"]).otherwise(number), at=long(0), stage=stage,
                legacy=s["legacy"] + F.when(single, long(1)).when(many, long(20)).otherwise(long(0)),
                accurate=s["accurate"] + F.when(single, long(1)).when(many, counted).otherwise(long(0)),
                barred=F.when(code > 96, long(1)).otherwise(s["barred"]), least=F.when(s["stage"] == 0, number).otherwise(s["least"]),
            )
            return F.when(code > 78, op).otherwise(push)

        return F.when(i < s["next"], s).otherwise(once(byte(i), read))

    def result(s: Column) -> Column:
        last = F.when(s["at"] > 0, F.substring(script, s["at"].cast("int"), s["size"].cast("int")))
        return F.struct(s["legacy"].alias("legacy"), s["accurate"].alias("accurate"), s["pushes"].alias("pushes"), (s["barred"] == 0).alias("push_only"), last.alias("last"), (s["stage"] == 3).alias("multisig"))

    places = F.when(length > 0, F.sequence(long(1), length)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(places, start, step, result)


def output_type(script: Column) -> Column:
    """The type of an output by its script; only what looks like several keys is walked."""
    digits = F.hex(F.coalesce(script, F.lit(b"")))
    kind = F
    for name, shape in SHAPES.items():
        kind = kind.when(F.rlike(digits, F.lit(shape)), name)
    return kind.when(F.rlike(digits, F.lit("^(5[1-9A-F]|60).*AE$")) & walk(script)["multisig"], "p2ms").otherwise("unknown")


def _per_input() -> Column:
    """(legacy, redeem, witness) signature operations of an input with column ``walked``."""
    walked, kind = F.col("walked"), F.col("prev_type")
    redeem = F.hex(walked["last"])
    nested = (kind == "p2sh") & walked["push_only"] & walked["last"].isNotNull()
    keyed = (kind == "p2wpkh") | (nested & F.rlike(redeem, F.lit("^0014.{40}$")))
    scripted = (kind == "p2wsh") | (nested & F.rlike(redeem, F.lit("^0020.{64}$")))
    legacy = F.when(F.col("is_coinbase") | ~walked["push_only"], walked["legacy"]).otherwise(0)
    redeemed = F.when(~F.col("is_coinbase") & (kind == "p2sh") & walked["last"].isNotNull(), walk(walked["last"])["accurate"]).otherwise(0)
    last = F.try_element_at("witness", F.lit(-1))
    witness = F.when(F.col("is_coinbase"), 0).when(keyed, 1).when(scripted & last.isNotNull(), walk(last)["accurate"]).otherwise(0)
    return F.struct(legacy.alias("legacy"), redeemed.alias("redeem"), F.coalesce(witness, F.lit(0)).alias("witness"))


def signature_operations(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(tx_idx, sigops): the cost in signature operations of each transaction.

    ``inputs``: tx_idx, is_coinbase, prev_type (of the output spent, as ``output_type`` names it; null for a coinbase), script_sig,
    witness (array of binary). ``outputs``: tx_idx, script. A coinbase's script counts as it stands; other inputs' scripts
    only where they don't just push. Redeem scripts count four times, witness scripts once. Taproot counts nothing.
    """
    spent = inputs.withColumn("prev_type", F.coalesce("prev_type", F.lit(""))).withColumn("walked", walk(F.col("script_sig"))).select("tx_idx", _per_input().alias("n"))
    spent = spent.select("tx_idx", (SCALE * (F.col("n.legacy") + F.col("n.redeem")) + F.col("n.witness")).alias("cost"))
    kind = output_type(F.col("script"))
    made = outputs.withColumn("kind", kind)
    own = F.when(F.col("kind").isin("p2pkh", "p2pk33", "p2pk65"), 1).when(F.col("kind") == "p2ms", 20).when(F.col("kind").isin("op_return", "unknown"), walk(F.col("script"))["legacy"]).otherwise(0)
    made = made.select("tx_idx", (SCALE * own).cast("long").alias("cost"))
    return spent.unionByName(made).groupBy("tx_idx").agg(F.sum("cost").alias("sigops"))


def _bit(kind: Column) -> Column:
    """The bit of an output's type; both kinds of plain keys share one."""
    bits = F.create_map(*(F.lit(x) for name, bit in FEATURES.items() for x in (name, 1 << bit)))
    return F.coalesce(F.try_element_at(bits, F.regexp_replace(kind, "^p2pk(33|65)$", "p2pk")), F.lit(0))


def features(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(tx_idx, mask): FEATURES of each transaction, types of what it spends and makes, an annex, an output below its type's limit.

    ``inputs``: tx_idx, prev_type, witness. ``outputs``: tx_idx, script, sats. An annex is the last of several items of a Taproot
    input's witness that begins with 0x50.
    """
    last = F.try_element_at("witness", F.lit(-1))
    annexed = F.coalesce((F.col("prev_type") == "p2tr") & (F.size("witness") > 1) & (F.hex(F.substring(last, 1, 1)) == "50"), F.lit(False))
    spent = inputs.select("tx_idx", _bit(F.col("prev_type")).bitwiseOR(F.when(annexed, 1 << FEATURES["annex"]).otherwise(0)).alias("bits"))
    made = outputs.select("tx_idx", "sats", output_type(F.col("script")).alias("kind"))
    made = made.select("tx_idx", _bit(F.col("kind")).bitwiseOR(F.when(dust(F.col("kind"), F.col("sats")), 1 << FEATURES["dust_output"]).otherwise(0)).alias("bits"))
    return spent.unionByName(made).groupBy("tx_idx").agg(F.bit_or("bits").alias("mask"))


def features_by_block(masks: DataFrame, group: str = "height") -> DataFrame:
    """(group, a column for each of FEATURES): how many transactions have it."""
    return masks.groupBy(group).agg(*(F.count_if(F.col("mask").bitwiseAND(F.lit(1 << bit)) != 0).alias(name) for name, bit in FEATURES.items()))
