"""Secret scans over an incremental blob ledger.

A document (or any version of a file) is a path that points at a blob, the SHA-256 of its text. The ledger holds, for each
(blob, rule version) that was ever scanned, the spans found. A run scans only the pairs that the ledger lacks, each blob
once however many paths share it, adds them to the ledger, and joins the findings back to all paths. Rules are regular
expressions; positions come from splitting the text at the matches, so everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: What may stand between the lines of a key: blanks and line ends, also escaped ones, quotes, commas, marks of comments.
_BETWEEN = r"""(?:[\s"',>#*|]|\\[nrt]?)*+"""
#: A line of a key without its end: long runs of base64, and shorter ones that fill a line.
_LONG, _SHORT = r"[A-Za-z0-9+/]{16,}+={0,2}", r"[A-Za-z0-9+/]++={0,2}"
_LINE = rf"""(?:{_BETWEEN}{_LONG}|[\t\x20"',]*+(?:\\r|\r)?(?:\\n|\n)[\t\x20"'>#*|]*+{_SHORT}(?=[\t\x20"',]*+(?:[\r\n\\]|(?![\s\S]))))"""
_FIELD = rf"{_BETWEEN}(?:Proc-Type|DEK-Info|Version|Comment|Charset|Hash|MessageID):[^\n\\]*+"
_KEY = "[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
#: A private key up to its END, whatever is between; where another BEGIN or END or nothing follows, its fields and lines of
#: base64. Repetitions are possessive, so long keys cost no stack.
PEM = rf"-----BEGIN {_KEY}(?:[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END {_KEY}|(?:{_FIELD})*+(?:(?:{_LINE})++(?:[\t\x20]++{_SHORT})?+)?+)"

#: Kind, pattern, the group that a match is judged by, the characters that group needs. In this order ties are listed.
RULES = (
    ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # as [0-9a-f]+ of 24 or more: a greedy run is maximal either way
    ("pem", PEM, 0, 1),
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28),
)
#: The kinds of the contract; the others are what the method adds.
BASE = ("assign", "access", "hex")
#: The version of each rule; goes up when its pattern changes. Then every blob is scanned again by that rule alone.
VERSIONS = {"assign": 1, "access": 1, "hex": 1, "pem": 2, "forge": 1, "jwt": 1}
#: Matches that a fold appends to one array; the arrays are then joined, so that time doesn't grow with the square of matches.
FOLDED = 512
#: Bytes of findings up to which they are sent to all tasks, so that texts needn't be shuffled to them.
BROADCAST = 32 << 20

SPAN = "array<struct<start:bigint,rule:int,stop:bigint,kind:string>>"
#: ``pairs``: the rule versions (``kind:version``) by which the blob was scanned in a run; ``spans``: all that they found.
LEDGER = f"blob binary, pairs array<string>, spans {SPAN}"


def spans_of(text: Column, rule: int) -> Column:
    """The spans of one rule in a text, in code points: leftmost matches that don't overlap, without those that fail."""
    kind, pattern, group, least = RULES[rule]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)  # n matches leave n + 1 gaps
    pairs = F.arrays_zip(matches.alias("m"), F.slice(gaps, 1, F.size(matches)).alias("g"))
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(pairs) / FOLDED).cast("int")), lambda k: F.slice(pairs, k * FOLDED + 1, FOLDED))
    nothing = F.array().cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["g"])
        end = begin + F.length(x["m"])
        judged = F.regexp_extract(x["m"], pattern, group) if group else x["m"]
        span = F.struct(begin.cast("bigint").alias("start"), F.lit(rule).alias("rule"), end.cast("bigint").alias("stop"), F.lit(kind).alias("kind"))
        return F.struct(end.cast("bigint").alias("at"), F.when(F.length(judged) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def part(acc: Column, own: Column) -> Column:
        folded = F.aggregate(own, F.struct(acc["at"].alias("at"), nothing.alias("out")), step)
        return F.transform(F.array(folded), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))[0]

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    found = F.aggregate(parts, start, part, lambda acc: F.flatten(acc["out"]))
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(nothing)


def rule_versions() -> list[str]:
    """The pairs' halves of today: kind:version of every rule, as listed."""
    return [f"{kind}:{VERSIONS[kind]}" for kind, *_ in RULES]


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """(blob, text, pairs) to LEDGER rows: each text is scanned by the rules that its ``pairs`` name."""
    due = lambda i: F.array_contains("pairs", rule_versions()[i])
    spans = F.array_sort(F.concat(*(F.when(due(i), spans_of(F.col("text"), i)).otherwise(F.array().cast(SPAN)) for i in range(len(RULES)))))
    return blobs.select("blob", "pairs", spans.alias("spans"))


def known_of(ledger: DataFrame) -> DataFrame:
    """(blob, pairs, spans), a row a blob: of today's rule versions those it was scanned by, and what they found. Rows of other
    versions, and pairs that a ledger holds twice, count for nothing."""
    versions = rule_versions()
    today = F.array(*map(F.lit, versions))
    # A span's place among today's rules; 0 for kinds that are gone.
    place = lambda s: F.array_position(F.array(*(F.lit(kind) for kind, *_ in RULES)), s["kind"])
    own = ledger.select("blob", F.array_intersect("pairs", today).alias("pairs"), "spans").filter(F.size("pairs") > 0)
    fitting = F.filter("spans", lambda s: F.array_contains("pairs", F.concat_ws(":", s["kind"], F.try_element_at(F.create_map(*(F.lit(x) for k, v in VERSIONS.items() for x in (k, str(v)))), s["kind"]))))
    placed = F.transform(fitting, lambda s: F.struct(s["start"].alias("start"), (place(s) - 1).cast("int").alias("rule"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    rows = own.select("blob", "pairs", placed.alias("spans"))
    merged = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    return rows.groupBy("blob").agg(merged("pairs").alias("pairs"), F.array_sort(merged("spans")).alias("spans"))


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def ledger_of(df: DataFrame, ledger: DataFrame | None = None, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(LEDGER rows for the blobs of ``df`` and of ``ledger``, the rows among them that this run added)."""
    texts = df.select(blob_of(F.col(f"`{text}`")).alias("blob"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    today = F.array(*map(F.lit, rule_versions()))
    if ledger is None:
        added = cut(scan_blobs(texts.dropDuplicates(["blob"]).withColumn("pairs", today)))
        return added, added
    known = cut(known_of(ledger))
    seen = known.select("blob", F.col("pairs").alias("_seen"))
    # Copies go before the join, each task its own first, so that a text that very many paths share is no hot key.
    unseen = texts.dropDuplicates(["blob"]).join(seen, "blob", "left").select("blob", "text", F.array_except(today, F.coalesce("_seen", F.array().cast("array<string>"))).alias("pairs"))
    added = cut(scan_blobs(unseen.filter(F.size("pairs") > 0)))
    return known.unionByName(added), added


def scan(df: DataFrame, ledger: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings of every path: the key, ``blob`` and ``spans``; the ledger rows that this run added).

    ``ledger``: LEDGER rows of earlier runs, or None. Null texts are empty texts; an empty text has no spans. Repeated rows
    and null keys stay as they are, other columns are ignored, no rows give no rows.
    """
    return scan_runs([df], ledger, key, text)


def scan_runs(runs: list[DataFrame], ledger: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """As ``scan``, for paths that come in several runs, the oldest first: each run scans what the ledger lacks after those
    before it, and in the end the findings are joined back to the paths of all runs."""
    known, added, paths = ledger, None, None
    for df in runs:
        known, new = ledger_of(df, known, text)
        added = new if added is None else added.unionByName(new)
        own = df.select(F.col(f"`{key}`").alias("path"), blob_of(F.col(f"`{text}`")).alias("blob"))
        paths = own if paths is None else paths.unionByName(own)
    # A blob that was scanned by some rules in one run and by others later has several rows.
    found = known.filter(F.size("spans") > 0)
    found = found.select("blob", "spans") if ledger is None else known_of(found).select("blob", "spans")
    # Blobs without findings needn't be joined. A blob that very many paths share is one key of a sort-merge join, whose
    # long side adaptive execution splits.
    joined = paths.join(found, "blob", "left")
    return joined.select(F.col("path").alias(key), "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans")), added


def digest(spans: Column) -> Column:
    """kind:start:end, by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redact(df: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``df`` with every found span of its text replaced by ``mask``; overlapping spans are masked as one.

    Rows are matched by blob, so null and repeated keys do no harm. Other columns and null texts stay; ``n_chars``, where
    there is one, becomes the new length (0 for a null text).
    """
    known, _ = ledger_of(df, text=text)
    found = known.filter(F.size("spans") > 0).select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans"))
    size = found.select(F.sum(100 + 60 * F.size("_spans"))).first()[0] or 0
    found = F.broadcast(found) if size <= BROADCAST else found
    whole = F.col(f"`{text}`")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(whole, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(gap, F.lit(mask)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), out.alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(whole, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1)))

    clean = F.when(F.col("_spans").isNull(), whole).otherwise(F.aggregate("_spans", start, step, finish))
    joined = df.withColumn("_of", blob_of(whole)).join(found, F.col("_of") == F.col("_blob"), "left")
    out = joined.select(*(clean.alias(c) if c == text else F.col(f"`{c}`") for c in df.columns))
    return out.withColumn("n_chars", F.coalesce(F.length(text), F.lit(0)).cast("long")) if "n_chars" in df.columns else out
