"""Search among names by words, beginnings of words, two words written as one, and words with a typo.

Names are looked up by posting lists, never scanned: a list for each beginning of a word, or of two neighbouring words written
together from the second's first letter on, and a list for each three letters in a row. Many queries are answered by one job.

A query's words that begin some word are known. A name fits if it has all of them (or, if no name has, any). Words of three or more
letters that begin nothing are taken for typos: up to ``budget`` runs of three letters, from their ends and middles, score the names
that have them, among those that fit the known words, if any do. Names are ranked by how many of the query's words begin words of
the name, in order; by that score; by how early they begin; by length; and by alphabet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lineage import cut

#: What parts words, names a query gives, runs of three letters tried, and the least score.
PARTS, LIMIT, BUDGET, LEAST = r"[_\- :/]+", 100, 6, 2


def words(text: Column) -> Column:
    return F.filter(F.split(text, PARTS), lambda w: F.length(w) > 0)


def postings(names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((term, name), (gram, name), (name, words)) of distinct lower-case names (name), written once."""
    own = cut(names.select("name").filter("name is not null").distinct().withColumn("words", words(F.col("name"))))
    beginnings = lambda w, at: F.transform(F.sequence(at, F.length(w)), lambda n: F.substring(w, F.lit(1), n))
    single = F.flatten(F.transform("words", lambda w: beginnings(w, F.lit(1))))
    pairs = F.when(F.size("words") > 1, F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words")), lambda a, b: F.struct(a.alias("a"), F.concat(a, b).alias("ab"))))
    double = F.coalesce(F.flatten(F.transform(pairs, lambda p: beginnings(p["ab"], F.length(p["a"]) + 1))), F.array().cast("array<string>"))
    terms = cut(own.select("name", F.explode(F.array_distinct(F.concat(single, double))).alias("term")))
    grams = F.flatten(F.transform(F.filter("words", lambda w: F.length(w) >= 3), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))))
    return terms, cut(own.select("name", F.explode(F.array_distinct(grams)).alias("gram"))), own


def _place(size: Column, turn: Column) -> Column:
    """Where a word's run of three letters of a turn begins, from 0: first, last, middle, then outwards from the middle; null if there
    is no new one."""
    last = size - 3
    mid, off = F.floor(last / 2), F.floor((turn - 2) / 2)
    later = F.when(turn % 2 == 1, F.greatest(mid - off, F.lit(0))).otherwise(mid + off)
    later = F.when((last > 2) & (later > 0) & (later < last) & (later != mid), later)
    return F.when(turn == 0, 0).when((turn == 1) & (last > 0), last).when((turn == 2) & (last > 1), mid).otherwise(later).cast("int")


def _prepared(queries: DataFrame, own: DataFrame) -> DataFrame:
    """(query, size, wants: its distinct words in order), without queries that are longer than any name could answer."""
    longest = own.agg(
        F.max(F.length("name")).alias("_name"), F.max(F.size("words")).alias("_words"),
        F.max(F.greatest(F.array_max(F.transform("words", lambda w: F.length(w))), F.coalesce(F.array_max(F.zip_with("words", F.slice("words", 2, F.size("words")), lambda a, b: F.length(a) + F.length(b))), F.lit(0)))).alias("_word"),
    )
    text = F.lower(F.regexp_replace(F.trim("query"), r"[^\x00-\x7F]", ""))
    q = queries.select("query").filter("query is not null").distinct().withColumn("_text", text).crossJoin(F.broadcast(longest))  # one row
    q = q.withColumn("wants", F.array_distinct(F.filter(words(F.col("_text")), lambda w: F.length(w) <= F.col("_word") + 4)))
    fine = (F.length("_text") <= F.col("_name") + 6) & F.size("wants").between(1, F.col("_words") + 2)
    return cut(q.filter(fine).select("query", F.length("_text").alias("size"), "wants"))


def _ranked(found: DataFrame, own: DataFrame, limit: int) -> DataFrame:
    """(query, nth, name) of (query, wants, name, score)."""
    start = F.struct(F.lit(0).alias("hits"), F.lit(0).alias("at"))

    def step(acc: Column, w: Column) -> Column:
        hit = F.coalesce(F.startswith(w, F.get("wants", acc["hits"])), F.lit(False))
        return F.when(hit, F.struct((acc["hits"] + 1).alias("hits"), acc["at"].alias("at"))).when(acc["hits"] == 0, F.struct(acc["hits"].alias("hits"), (acc["at"] + 1).alias("at"))).otherwise(acc)

    rows = found.join(own, "name").withColumn("_fit", F.aggregate("words", start, step))
    order = [F.desc("_fit.hits"), F.desc("score"), F.asc("_fit.at"), F.length("name"), "name"]
    nth = F.row_number().over(W.partitionBy("query").orderBy(*order))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= limit).select("query", "nth", "name")


def search(names: DataFrame, queries: DataFrame, limit: int = LIMIT, budget: int = BUDGET, least: int = LEAST) -> DataFrame:
    """(query, nth from 1, name) for each distinct query (query) over names (name, lower case). Null and empty queries, and those
    that fit nothing, have no rows."""
    terms, grams, own = postings(names)
    asked = _prepared(queries, own)
    each = asked.select("query", F.posexplode("wants").alias("_at", "term"))
    has = terms.select("term").distinct()
    known = cut(each.join(has, "term", "left_semi"))
    fits = known.join(terms, "term").groupBy("query", "name").agg(F.count("*").alias("_n"))
    most = known.groupBy("query").agg(F.count("*").alias("_all"))
    fits = cut(fits.join(most, "query").select("query", "name", (F.col("_n") == F.col("_all")).alias("all")))
    pooled = fits.filter("all").select("query").distinct().withColumn("pooled", F.lit(True))
    pool = fits.filter("all").select("query", "name")

    typos = each.join(has, "term", "left_anti").filter(F.length("term") >= 3).groupBy("query").agg(F.slice(F.sort_array(F.collect_list(F.struct("_at", "term"))), 1, budget).alias("_t"))
    turn = lambda t: F.transform("_t", lambda x: F.substring(x["term"], _place(F.length(x["term"]), t) + 1, F.lit(3)))
    tries = F.slice(F.array_distinct(F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(budget - 1)), turn)))), 1, budget)
    probes = cut(typos.select("query", F.explode(tries).alias("gram")).join(grams.select("gram").distinct(), "gram", "left_semi"))
    least_score = asked.join(probes.groupBy("query").agg(F.count("*").alias("_hits")), "query").select("query", "size", F.greatest(F.ceil(F.col("_hits") / 2), F.lit(least)).alias("_least"))
    hits = probes.join(grams, "gram").groupBy("query", "name").agg(F.count("*").alias("_n"))
    scored = hits.join(least_score, "query").join(pooled, "query", "left").join(pool.withColumn("_in", F.lit(True)), ["query", "name"], "left")
    score = F.when(F.col("pooled"), F.when(F.col("_in"), F.col("_n") + 1)).when(F.length("name") >= F.col("size") - 3, F.col("_n"))
    fuzzy = cut(scored.withColumn("score", score).filter("score >= _least").select("query", "name", "score"))

    plain = fits.join(pooled, "query", "left").filter("all or pooled is null").join(fuzzy.select("query").distinct(), "query", "left_anti")
    every = fuzzy.unionByName(plain.select("query", "name", F.lit(0).cast("long").alias("score")))
    return _ranked(every.join(asked.select("query", "wants"), "query"), own, limit)
