"""Block, transaction, mining and output series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import windows as Win
from ..operators.ordered import in_rows

DAY = 86_400
#: Fixed values of the network.
TARGET_BLOCKS_A_DAY, RETARGET, HALVING, FIRST_SUBSIDY, MAX_WEIGHT = 144, 2016, 210_000, 5_000_000_000, 4_000_000
#: Outputs below these sats are dust, by type.
DUST = {"p2pk65": 672, "p2pk33": 576, "p2pkh": 546, "p2sh": 540, "p2wpkh": 294, "p2wsh": 330, "p2tr": 330, "p2a": 240, "empty": 471}


def intervals(blocks: DataFrame, ts: str = "ts", idx: str = "idx") -> DataFrame:
    """Seconds since the block before, by raw times; 0 for the first, and where time went back."""
    return in_rows(blocks, 1, lambda w: {"interval": F.coalesce(F.greatest(F.col(ts) - F.lag(ts).over(w), F.lit(0)), F.lit(0))}, None, idx)


def retarget(height: Column) -> dict[str, Column]:
    """Blocks to the next retarget and to the next halving, and days at the target rate."""
    to_retarget, to_halving = RETARGET - height % RETARGET, HALVING - height % HALVING
    return {"blocks_to_retarget": to_retarget, "blocks_to_halving": to_halving, "days_to_retarget": to_retarget / TARGET_BLOCKS_A_DAY, "days_to_halving": to_halving / TARGET_BLOCKS_A_DAY}


def adjustments(blocks: DataFrame, difficulty: str = "difficulty", idx: str = "idx") -> DataFrame:
    """(epoch, difficulty, adjustment): each epoch's difficulty against that before it, NaN for the first."""
    epochs = blocks.groupBy(F.floor(F.col(idx) / RETARGET).alias("epoch")).agg(F.min_by(difficulty, idx).alias("difficulty"))
    before = F.lag("difficulty").over(W.partitionBy().orderBy("epoch"))  # a row an epoch
    return epochs.withColumn("adjustment", F.coalesce(S.divide(F.col("difficulty"), before) - 1, F.lit(math.nan)))


def project_adjustment(first_ts: int, last_ts: int, blocks: int) -> dict[str, float]:
    """What the next retarget would be at the pace so far: mean seconds a block (whole), the change in percent, seconds left."""
    if blocks == 0:
        return {"time_avg": 600.0, "change": 0.0, "remaining": RETARGET * 600.0}
    elapsed = max(1, last_ts - first_ts)
    average = elapsed // blocks
    return {"time_avg": float(average), "change": (blocks * 600 / elapsed - 1) * 100, "remaining": float((RETARGET - blocks) * average)}


def subsidy_at(height: Column) -> Column:
    """50 bitcoin, halved (cut off) every HALVING blocks."""
    return F.call_function("shiftright", F.lit(FIRST_SUBSIDY), F.least(F.floor(height / HALVING), F.lit(63)).cast("int"))


def hash_rate(blocks: DataFrame, difficulty: str = "difficulty", days: tuple[int, ...] = (7,)) -> DataFrame:
    """Blocks of the last day over the target x the hash rate of the difficulty; its means, its high and drawdown, and its low
    without zeros."""
    counted = Win.rolling_time(blocks.withColumn("_one", F.lit(1)), DAY, "_one", ["count"])
    rated = counted.withColumn("hash_rate", F.col("count") / TARGET_BLOCKS_A_DAY * S.difficulty_to_hash_rate(F.col(difficulty))).drop("count", "_one")
    for d in days:
        rated = Win.rolling_time(rated, d * DAY, "hash_rate", ["average"]).withColumnRenamed("average", f"hash_rate_sma_{d}d")
    return Win.extremes(rated, "hash_rate", skip_zero=True).withColumnsRenamed({"ath": "hash_rate_ath", "atl": "hash_rate_atl", "drawdown": "hash_rate_drawdown"})


def block_sizes(blocks: DataFrame, weight: str = "weight", seconds: int = DAY) -> DataFrame:
    """Blocks (idx, ts, weight) with ``vbytes`` (quarters of the weight, rounded down), ``fullness`` (share of the largest weight),
    and the sum of vbytes over the last ``seconds`` (``vbytes_sum``) and the average weight (``weight_average``)."""
    b = blocks.withColumns({"vbytes": F.floor(F.col(weight) / 4).cast("long"), "fullness": F.col(weight) / MAX_WEIGHT})
    b = Win.rolling_time(b, seconds, "vbytes", ["sum"]).withColumnRenamed("sum", "vbytes_sum")
    return Win.rolling_time(b, seconds, weight, ["average"]).withColumnRenamed("average", "weight_average")


def rewards(coinbase: DataFrame, fees: DataFrame, height: str = "height") -> DataFrame:
    """coinbase (height, coinbase), fees (height, fees): with the subsidy, what is unclaimed, and the fees' share. A coinbase
    below the fees fails."""
    both = coinbase.join(fees, height, "left").na.fill(0, ["fees"]).withColumn("subsidy", S.unsigned_sub(F.col("coinbase"), F.col("fees")))
    return both.withColumns({"unclaimed": subsidy_at(F.col(height)) - F.col("subsidy"), "fee_share": S.ratio(F.col("fees"), F.col("coinbase"))})


def transaction_fees(txs: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Per transaction input and output value, fee (0 for a coinbase) and fee rate. ``txs``: tx_idx, vsize, is_coinbase."""
    paid = inputs.groupBy("tx_idx").agg(F.sum("sats").alias("input_value"))
    made = outputs.groupBy("tx_idx").agg(F.sum("sats").alias("output_value"))
    t = txs.join(paid, "tx_idx", "left").join(made, "tx_idx", "left").na.fill(0, ["input_value", "output_value"])
    fee = F.when(F.col("is_coinbase"), F.lit(0)).otherwise(F.col("input_value") - F.col("output_value"))
    return t.withColumn("fee", fee).withColumn("fee_rate", S.ratio(F.col("fee"), F.col("vsize")))


def patterns(txs: DataFrame, sides: DataFrame) -> DataFrame:
    """Per transaction whether it is a consolidation, a batch payout, or a likely coinjoin.

    ``txs``: tx_idx, is_coinbase, has_token. ``sides``: tx_idx, side (in or out), sats, addr. Consolidation: inputs are 5 x
    outputs or more; payout: outputs are 5 x inputs or more, no coinbase; coinjoin: 5 or more of both, neither of those, no token,
    no address twice, and distinct values that aren't 0, and zeros, at most half of all.
    """
    own = sides.groupBy("tx_idx").agg(
        F.count_if(F.col("side") == "in").alias("n_in"), F.count_if(F.col("side") == "out").alias("n_out"), F.count("addr").alias("n_addr"), F.count_distinct("addr").alias("n_distinct"),
        F.count_distinct(F.when(F.col("sats") != 0, F.col("sats"))).alias("n_values"), F.count_if(F.col("sats") == 0).alias("n_zero"),
    )
    t = txs.join(own, "tx_idx", "left").na.fill(0)
    i, o = F.col("n_in"), F.col("n_out")
    consolidation = (i >= 5 * o) & (o > 0) & ~F.col("is_coinbase")
    payout = (o >= 5 * i) & ~F.col("is_coinbase") & (i > 0)
    joined = (i >= 5) & (o >= 5) & ~consolidation & ~payout & ~F.col("has_token") & (F.col("n_addr") == F.col("n_distinct")) & (2 * (F.col("n_values") + F.col("n_zero")) <= i + o)
    return t.select("tx_idx", consolidation.alias("consolidation"), payout.alias("batch_payout"), joined.alias("coinjoin"))


def dust(output_type: Column, sats: Column) -> Column:
    """Whether an output is below its type's limit; types without one are never dust."""
    limits = F.create_map(*(F.lit(x) for kv in DUST.items() for x in kv))
    return F.coalesce(sats < F.try_element_at(limits, output_type), F.lit(False))


def nonstandard(height: Column, version: Column, n_op_return: Column, op_return_size: Column, n_dust: Column, weight: Column, size: Column) -> Column:
    """Whether relay policy of the time would refuse a transaction."""
    data = F.when(height < 921_000, (n_op_return > 1) | (op_return_size > 83)).otherwise(op_return_size > 100_000)
    dusty = F.when(height < 892_500, n_dust > 0).otherwise(n_dust > 1)
    odd = F.when(height <= 863_500, ~version.between(1, 2)).otherwise(~version.between(1, 3))
    return data | dusty | odd | (weight > 400_000) | (size < 65)


#: How the first data of a data output begin, by kind, as patterns of hexadecimal digits; the first that fits
#: counts.
DATA_KINDS = {
    "omni": b"omni".hex(), "stacks": f"({b'X2'.hex()}|{b'X1'.hex()})", "blockstack": b"id".hex(), "colu": b"CC".hex(), "open_assets": b"OA\x01\x00".hex(), "coinspark": b"SPK".hex(),
    "poet": b"POET".hex(), "docproof": b"DOCPROOF".hex(), "opentimestamps": "0588960d73d71901", "factom": b"Factom!!".hex(), "eternity_wall": b"EW".hex(), "memo": "6d(0[1-7]|0c)",
    "bitproof": b"BP".hex(), "ascribe": b"ASCRIBE\0".hex(), "stampery": b"Stampery".hex(), "epobc": b"EPOBC".hex(),
}


def first_data(script: Column) -> Column:
    """The hexadecimal digits of the first push of a data output that isn't empty; empty where there is none or it is cut off."""
    # Behind the first opcode, what pushes nothing: empty pushes and other opcodes.
    return S.once(F.regexp_replace(F.lower(F.hex(script)), r"^..(?:00|4c00|4d0000|4e00000000|(?:4f|[5-9a-f].))*+", ""), _first_push)


def _first_push(rest: Column) -> Column:
    """The data of the push that hexadecimal digits begin with; empty where it is cut off."""
    digits = lambda *at: F.conv(F.concat(*(F.substring(rest, a, 2) for a in at)), 16, 10).cast("long")
    code = F.substring(rest, 1, 2)
    head = F.when(code == "4c", 4).when(code == "4d", 6).when(code == "4e", 10).otherwise(2)
    size = F.when(code == "4c", digits(3)).when(code == "4d", digits(5, 3)).when(code == "4e", digits(9, 7, 5, 3)).otherwise(digits(1))
    return F.when((F.length(rest) > head) & (F.length(rest) >= head + 2 * size), F.substring(rest, head + 1, (2 * size).cast("int"))).otherwise("")


def op_return_kind(script: Column) -> Column:
    """The kind of a data output from its script (binary), by the first rule that fits; null for a null script."""
    return S.once(script, lambda s: S.once(first_data(s), lambda data: _kind_of(s, data)))


def _kind_of(script: Column, data: Column) -> Column:
    n, size = F.length(data) / 2, F.length(script) - 1
    printable = F.length(F.regexp_replace(F.decode(F.unhex(data), "ISO-8859-1"), r"[^\x20-\x7e]", ""))
    kind = F.when(F.hex(F.substring(script, 2, 1)) == "5D", "runes").when(data == "", "empty")
    for name, pattern in DATA_KINDS.items():
        kind = kind.when(F.rlike(data, F.lit(f"^{pattern}")), name)
    kind = kind.when(size == 82, "veriblock").when(size.between(36, 38), "komodo").when(n.isin(20, 32), "bare_hash")
    kind = kind.when((n >= 4) & (printable * 10 >= n * 9), "text").otherwise("unknown")
    return F.when(script.isNotNull(), kind)


def by_type(rows: DataFrame, group: str, kind: str) -> DataFrame:
    """(group, kind, n, share) of rows per group and kind."""
    counts = rows.groupBy(group, kind).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(group)))
