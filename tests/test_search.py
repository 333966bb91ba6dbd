"""Search over posting lists against the same rules written out name by name."""

import random
import re

from ledgerloom.plans import search as S


def place(size, turn):
    last = size - 3
    if turn == 0:
        return 0
    if turn == 1 and last > 0:
        return last
    if turn == 2 and last > 1:
        return last // 2
    if last <= 2:
        return None
    at = max(last // 2 - (turn - 2) // 2, 0) if turn % 2 else last // 2 + (turn - 2) // 2
    return at if 0 < at < last and at != last // 2 else None


def plain(names, query, limit=100, budget=6):
    split = lambda t: [w for w in re.split(r"[_\- :/]", t) if w]
    text = "".join(c for c in query.strip() if c.isascii()).lower()
    of = {n: split(n) for n in names}
    begins = {n: {w[:i] for w in ws for i in range(1, len(w) + 1)} | {(a + b)[:i] for a, b in zip(ws, ws[1:], strict=False) for i in range(len(a) + 1, len(a + b) + 1)} for n, ws in of.items()}
    grams = {n: {w[i : i + 3] for w in ws for i in range(len(w) - 2)} for n, ws in of.items()}
    longest = max(len(x) for n in names for x in begins[n])
    wants = list(dict.fromkeys(w for w in split(text) if len(w) <= longest + 4))
    if not wants or len(wants) > max(map(len, of.values())) + 2 or len(text) > max(map(len, names)) + 6:
        return []
    known = [w for w in wants if any(w in begins[n] for n in names)]
    typos = [w for w in wants if w not in known and len(w) >= 3][:budget]
    pool = {n for n in names if known and all(w in begins[n] for w in known)}
    probes = []
    for turn in range(budget):
        for w in typos:
            at = place(len(w), turn)
            if at is not None and w[at : at + 3] not in probes and len(probes) < budget:
                probes.append(w[at : at + 3])
    hits = [g for g in probes if any(g in grams[n] for n in names)]
    least = max(-(-len(hits) // 2), 2)
    score = {n: sum(g in grams[n] for g in hits) + bool(pool) for n in (pool or names) if pool or len(n) >= len(text) - 3}
    fuzzy = {n: s for n, s in score.items() if s >= least and typos}
    found = fuzzy or dict.fromkeys(pool or {n for n in names if any(w in begins[n] for w in known)}, 0)

    def rank(n):
        hit = at = 0
        for w in of[n]:
            if hit < len(wants) and w.startswith(wants[hit]):
                hit += 1
            elif not hit:
                at += 1
        return -hit, -found[n], at, len(n), n

    return sorted(found, key=rank)[:limit]


def test_search_against_the_rules_written_out(spark):
    rng = random.Random(4)
    parts = ["price", "supply", "realized", "cap", "hash", "rate", "dominance", "sth", "lth", "utxo", "count", "in", "profit", "loss", "24h", "sum"]
    names = sorted({"_".join(rng.sample(parts, rng.randint(1, 4))) for _ in range(250)} | {"file_name", "file_size", "created_at", "updated_at"})
    queries = ["file name", "filename", "filenme", "dom", "hashrate", "suply", "suply price", "pric zzz", "zzz", "", "  Realized-Cap ", "sth suply", "dominence", "x" * 200, "in", "rate hash price cap sum loss in", "pröfit", "relized captal", "price price"]
    for _ in range(120):
        w = list(rng.choice(names).replace("_", rng.choice(["_", " ", ""])))
        if rng.random() < 0.6 and len(w) > 3:
            w.pop(rng.randrange(len(w)))
        queries.append("".join(w))
    df = spark.createDataFrame([(n,) for n in names + names[:3]] + [(None,)], "name string")
    asked = spark.createDataFrame([(q,) for q in queries + [None]], "query string")
    got = {}
    for r in S.search(df, asked, limit=12).orderBy("query", "nth").collect():
        got.setdefault(r.query, []).append(r.name)
    want = {q: x for q in set(queries) if (x := plain(names, q, 12))}
    assert got == want and len(want) > 80
    assert got["filename"][:1] == ["file_name"] and got["filenme"][0].startswith("file_")
    assert S.search(df.limit(0), asked).count() == 0
