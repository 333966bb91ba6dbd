"""SentencePiece, language ID, quality rules and HTML extraction."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import html_extraction as H
from ledgerloom.llm import language_id as L
from ledgerloom.llm import pieces as P
from ledgerloom.llm import quality_rules as Q
from ledgerloom.llm.queries import tokenizer_file

MODEL = tokenizer_file("piece_bpe_32k.model")
ODD = ["", " ", "  a  b\n c ", "x\ny", " \nz", "a \n b", "é ﬁ　x\t​\x00<s> 日本語𝄞  😀😀", "x" * 1000 + "abcthe" * 200, "▁a ▁ b", "the quick brown fox", "end ", "a\r\nb", "\n\n\n", "theaeati " * 3]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    parts = ["th", "er", "on", "an", "re", "é", "ß", "ción", ".", ",", " ", " ", " ", "\n", "A", "9", "日"]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(300))) for _ in range(200)]


def test_pieces_equal_the_library_and_round_trip(spark, texts):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=MODEL)
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(None, None, 0)]
    coded = P.encode(spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3), MODEL)
    back = {r.doc_id: r.text for r in P.decode(coded, MODEL).collect()}
    for r in coded.collect():
        if r.doc_id is None:
            assert r.ids == [] and back[None] == ""
            continue
        t = texts[r.doc_id]
        assert list(r.ids) == sp.encode(t), t
        assert r.decodes == (back[r.doc_id] == t) == ("▁" not in t), t
    assert P.encode(coded.limit(0).select("doc_id", F.lit("").alias("text")), MODEL).count() == 0


def test_suffix_ranges_find_every_occurrence():
    m = P.Model(MODEL)
    text = "the then théa thethe".encode()
    packed = m.occurrences(text)
    got = {(int(x >> (P.START + P.WIDE)), int(x & ((1 << P.START) - 1))) for x in packed}
    want = {(i, int(k)) for k in m.ids for i in range(len(text)) if text.startswith(m.pieces[k], i)}
    assert got == want


# ------------------------------------------------------------------------------------------------------------- language ID


def naive(e, first, t, s):
    out, at = [], 0
    bounds = [i for i, f in enumerate(first) if f] + [len(e)]
    for a, b in zip(bounds, bounds[1:]):
        alpha, beta = [np.exp(s + e[a])], [np.ones(e.shape[1])]
        for i in range(a + 1, b):
            alpha.append(alpha[-1] @ np.exp(t) * np.exp(e[i]))
        for i in range(b - 1, a, -1):
            beta.append(np.exp(t) @ (np.exp(e[i]) * beta[-1]))
        for x, y in zip(alpha, reversed(beta)):
            out.append(x * y / (x * y).sum())
        at = b
    assert at == len(e)
    return np.array(out)


@pytest.mark.parametrize("n", [1, 2, 17, 60])
def test_forward_backward_in_blocks(n):
    rng = np.random.default_rng(n)
    e, t, s = rng.normal(size=(n, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    first = rng.random(n) < 0.2
    first[0] = True
    assert np.allclose(L.forward_backward(e, first, t, s), naive(e, first, t, s))


def words(lang, n, rng):
    stems = {"aa": ["the", "ing", "and", "er"], "bb": ["der", "ung", "ich", "st"], "cc": ["ción", "que", "los", "ado"]}[lang]
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_languages_held_out_mixed_and_empty(spark):
    rng = random.Random(1)
    rows = [(i, words(lang, rng.randint(20, 60), rng), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(1000, None, "aa"), (1001, "", None), (1002, "12 !! 9", "bb"), (1003, words("aa", 30, rng) + " " + words("bb", 30, rng), None), (None, words("cc", 30, rng), "cc"), (5, words("cc", 40, rng), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1)).repartition(3)
    crf = L.learn(df, 20)
    assert crf.labels == ["aa", "bb", "cc"]
    got = {}
    for r in L.identify(df, crf).select("*", L.held_out(F.col("doc_id")).alias("held_out")).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.score, r.held_out))
    out = [(i, lang) for i, _, lang in rows[:180] if got[i][0][2]]
    assert out and all(any(g[0] == lang for g in got[i]) for i, lang in out)
    assert got[1000][0][:2] == got[1001][0][:2] == got[1002][0][:2] == ("und", 0.0)
    assert got[None][0][0] == "cc" and got[None][0][2] is False and all(0 <= x[1] <= 1 for v in got.values() for x in v)
    runs = L.label_words(df.filter("doc_id = 1003"), crf).first().runs
    assert [r.lang for r in runs] == ["aa", "bb"] and abs(runs[0].words - 30) <= 1
    assert L.identify(df.limit(0), crf).count() == 0


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    crf = L.learn(df)
    assert L.identify(df, crf).first().lang_pred == "und"


# ----------------------------------------------------------------------------------------------------------- quality rules


def naive_statistics(text):
    ws = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    wins = Counter(zip(ws, ws[1:], ws[2:]))
    covered = {j for i in range(len(ws) - 2) if wins[tuple(ws[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_statistics_against_plain_code():
    rng = random.Random(3)
    parts = ["a", "b", "é", "日本", "#", "|x", " ", "  ", "\n", "\t", "\xa0", "\x85", "A."]
    for t in ["", "\n", "a b a b a b", "x\nx\n \n x"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(200))) for _ in range(300)]:
        assert Q.statistics(t.encode())[:5] == naive_statistics(t), t


def path_length(forest, t, row):
    at = 0
    while forest.feature[t, at] >= 0:
        at = forest.left[t, at] + (row[forest.feature[t, at]] >= forest.split[t, at])
    return forest.path[t, at]


def test_forest_against_walking_each_tree():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(300, 4))
    rows[:, 3] = 0
    forest = Q.grow(rows, np.concatenate([rows, [[0, 0, 0, 2]]]), trees=20)
    some = np.concatenate([rows[:20], [[0, 0, 0, 2.0]]])
    want = [2 ** -(np.mean([path_length(forest, t, r) for t in range(20)]) / forest.expected) for r in some]
    got = Q.anomaly(forest, some)
    assert np.allclose(got, want) and got[-1] > got[:-1].max()  # a value that no row has stands out


def test_junk_goes_and_clean_text_stays(spark):
    rng = random.Random(6)

    def clean():
        return "\n".join(" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(12)) + "." for _ in range(rng.randint(6, 20)))

    good = [(i, clean()) for i in range(200)]
    bad = [(1000 + i, " ".join(w + rng.choice(["***", "$$$", "&&&"]) for w in clean().split())) for i in range(40)]
    rows = good + bad + [(2000, None), (2001, ""), (2002, "same words here " * 40), (None, clean()), (3, good[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("quality", F.lit("x")).repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in range(100)] + [(1000 + i, 0) for i in range(10)] + [(None, 0), (5, None)], "doc_id long, quality int")
    got = [(r.doc_id, r.kept, r.base_failed) for r in Q.judge(df, labels).collect()]
    assert len(got) == len(rows)
    kept = Counter(d for d, k, _ in got if k)
    assert sum(kept[i] > 0 for i in range(200)) >= 197 and kept[3] == 2 and kept[None] == 1
    assert sum(kept[1000 + i] for i in range(40)) == 0
    assert {d for d, _, b in got if b} >= {2000, 2001, 2002} and not any(kept[d] for d in (2000, 2001, 2002))
    assert Q.judge(df.limit(0), labels).count() == 0
    assert Q.judge(df.filter("doc_id < 50")).filter("kept").count() > 40  # without labels


def test_margins_are_of_all_rows_that_pass(spark, monkeypatch):
    rng = random.Random(12)
    words = ["the", "ing", "on", "era", "anneal", "rest"]
    texts_ = [" ".join("".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(60, 200))) + "." for _ in range(300)]
    texts_ += ["too short", "# $ % & " * 3 + texts_[0], texts_[1].upper(), "x" * 5000 + " " + texts_[2], "1234 " * 3 + texts_[3], ("Line one.\n" * 2 + texts_[4]) * 2]
    df = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string").repartition(5)
    stats = [Q.statistics(t.encode()) for t in texts_]
    passed = np.array([s for s in stats if s[0] >= 50 and 100 * s[4] <= 50 * s[0]], np.int64)
    every = Q.shape(dict(zip((*Q.BASE, *Q.MORE), passed.T, strict=True)))
    seen, grow = [], Q.grow
    monkeypatch.setattr(Q, "FIT_ROWS", 8)
    monkeypatch.setattr(Q, "grow", lambda rows, around: seen.append((rows, around)) or grow(rows, around))
    Q.calibrate(df, None, "doc_id", "text", "quality")
    (rows, around) = seen[0]
    assert len(rows) == 8 and (around.min(0) == every.min(0)).all() and (around.max(0) == every.max(0)).all()


# -------------------------------------------------------------------------------------------------------- HTML extraction

ARTICLE = "First paragraph of a longer article, with words &amp; more words. It goes on for a while."


def page(i, rng):
    body = "".join(f"<p>{words('aa', rng.randint(8, 60), rng)}, {words('aa', 9, rng)}.</p>" for _ in range(rng.randint(2, 8)))
    return f"<html><head><title>T</title><script>var a='<p>x</p>'</script></head><body><nav><ul><li><a href=#>One</a><li><a href=#>Two</a></ul></nav><div class=ad>{words('bb', 8, rng)}</div><article><h1>{words('aa', 5, rng)}</h1>{body}</article><footer>&copy; {i}</footer></body></html>"


@pytest.fixture(scope="module")
def trees():
    rng = random.Random(9)
    return H.fit([page(i, rng) for i in range(40)])


def text_of(trees, markup):
    nodes, runs = H.parse(markup)
    return H.main_text(nodes, runs, H.decode(nodes, H.scores(trees, H.features(nodes, runs))))


def test_articles_come_out_whole(trees):
    import html
    import re

    rng = random.Random(10)
    for i in range(30):
        p = page(i, rng)
        inner = re.search("<article>(.*)</article>", p)[1]
        assert text_of(trees, p) == " ".join(html.unescape(re.sub("<[^>]+>", " ", inner)).split())


def test_other_layouts(trees):
    rng = random.Random(11)
    more = "".join(f"<p>{words('aa', 40, rng)}, {words('aa', 20, rng)}.</p>" for _ in range(4))
    p = f"<body><div class='site-header'><p>Site</p></div><div class=wrapper><div class='post-content'><p>{ARTICLE}</p>{more}<div class=ad>Buy</div></div><section class=comments><p>I liked it a lot.</p></section><aside class=sidebar><p>Other pages</p></aside></div>"
    got = text_of(trees, p)
    assert got.startswith("First paragraph") and "words & more" in got
    assert not any(x in got for x in ("Site", "Buy", "liked", "Other pages"))


def plain(markup):
    import re

    return re.sub(r"<(/?)(?:article|nav|footer)\b[^>]*>", r"<\1div>", markup)


@pytest.mark.parametrize("marked", [True, False])
def test_pages_without_telling_tags(trees, marked):
    import html
    import re
    from collections import Counter

    rng = random.Random(13)
    learned = trees if marked else H.fit([plain(page(i, rng)) for i in range(40)])
    hit = found = want = 0
    for i in range(40):
        p = page(i, rng)
        truth = Counter(html.unescape(re.sub("<[^>]+>", " ", re.search("<article>(.*)</article>", p)[1])).split())
        got = Counter(text_of(learned, plain(p)).split())
        hit, found, want = hit + (truth & got).total(), found + got.total(), want + truth.total()
    assert hit / found >= 0.98 and hit / want >= 0.95


@pytest.mark.parametrize("odd", ["<a ", '<a ">', "<!", "<!--", "<script>", "<script x='", "</x", "<b><hr>", "<p>"])
def test_long_broken_pages_take_time_in_proportion(odd):
    import time

    began = time.perf_counter()
    H.parse("<article><p>One." + odd * (1_000_000 // len(odd)))
    assert time.perf_counter() - began < 8


def test_query_on_whole_pages(spark, tmp_path):
    import html
    import re

    from ledgerloom.llm.queries import op8_html_extraction

    rng = random.Random(14)
    rows = [(i, f"u{i}", page(i, rng)) for i in range(60)] + [(100, None, None), (101, "v", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in op8_html_extraction(spark, str(tmp_path)).collect()}
    for i, url, p in rows:
        want = " ".join(html.unescape(re.sub("<[^>]+>", " ", re.search("<article>(.*)</article>", p)[1])).split()) if p else ""
        assert (got[i].url, got[i].text, got[i].n_chars) == (url, want, len(want))


def test_decoding_never_contradicts(trees):
    rng = np.random.default_rng(2)
    nodes, _ = H.parse("<div><p>a<p>b<div><p>c</div></div><section><p>d</section>")
    for _ in range(50):
        states = H.decode(nodes, np.log(rng.dirichlet([1, 1, 1], len(nodes))))
        for n, s in zip(nodes[1:], states[1:]):
            assert s >= states[n.parent]


def test_inline_markup_and_broken_pages(trees):
    nodes, runs = H.parse("<p>a<b>b</b>c<br>d &lt;e&gt; 1 < 2<!-- x --><style>q</style>")
    assert H.main_text(nodes, runs, [H.MAIN] * len(nodes)) == "abc d <e> 1 < 2"
    assert [text_of(trees, x) for x in ("", "</div></p>", "<script>var x", "<!-- x")] == [""] * 4
    assert all(isinstance(text_of(trees, x), str) for x in ("<", "<p", "<p <b", "<div class='"))


def test_extract_handles_odd_rows(spark, trees):
    rng = random.Random(12)
    rows = [(1, "u", page(1, rng)), (1, "u", page(1, rng)), (None, None, None), (2, "v", ""), (3, "w", "<p>" + "x " * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(0))
    got = H.extract(df, trees).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (None, 2)] == ["", ""]
    assert H.extract(df.limit(0), trees).count() == 0
    assert math.isfinite(H.learn(df).bias.sum())


def test_threshold_heeds_bad_labels(spark):
    rows = [(0.30, True)] * 10 + [(0.40, True), (0.35, False), (0.60, False), (0.9, None)]
    df = spark.createDataFrame([(a, g, False) for a, g in rows] + [(0.45, False, True)], "anomaly double, good boolean, base_failed boolean")
    step = 1.5 / Q.STEPS  # the middle is cut off to a whole level
    assert 0.40 < Q.threshold(df) < 0.60 and abs(Q.threshold(df) - 0.50) <= step
    assert abs(Q.threshold(df.filter("good or anomaly < 0.4")) - 0.40) <= step
    assert Q.threshold(df.limit(0)) == Q.WITHOUT_LABELS
