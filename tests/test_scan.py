"""Golden rows of the scan, and its edges."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from commentscan.config import ScanConfig
from commentscan.functions import lexicon as L
from commentscan.functions.automaton import Automaton
from commentscan.operators import scan as S
from commentscan.operators.models import Batched, Learned
from commentscan.plans.scan_queries import QUERIES, phrase_row

# The sample comments and the phrase that the scan must handle.
SAMPLES = ["Great post!", "This is awful", "I disagree", "Please be kind", "Usual suspects", "I hate you", "AFD", "88"]
GOLDEN = [
    ("Great post!", 0.0, False, False), ("This is awful", 0.5, False, False), ("I hate you", 0.7, False, True), ("fuck you", 0.9, True, True),
    ("whatever", 0.7, False, True), ("my skills", 0.9, True, True), ("dumb trash", 0.8, True, True), ("you people", 0.6, False, False), ("kill yourself", 1.0, True, True),
]


def comments(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "comment_id long, text string")


def decided(spark, texts, hate=(), safe=(), **more):
    rows = S.decide(comments(spark, texts), phrase_row(spark, hate, safe), **more).collect()
    return {r["text"]: r for r in rows}


def test_golden_comments(spark):
    texts = [g[0] for g in GOLDEN]
    plain = decided(spark, texts)
    asked = decided(spark, texts, config=ScanConfig(use_opinion=True), opinion=S.keyword_opinion)
    for text, score, flagged, later in GOLDEN:
        assert round(plain[text]["score"], 2) == score
        assert plain[text]["flagged"] == flagged
        assert asked[text]["flagged"] == later
    assert [asked[t]["asked"] for t in ("dumb trash", "you people", "fuck you")] == [True, True, False]
    assert round(asked["I hate you"]["score"], 2) == 0.85


def test_sample_source_with_and_without_a_phrase(spark):
    assert not any(r["flagged"] for r in decided(spark, SAMPLES).values())
    found = decided(spark, SAMPLES, hate=("awful",))
    assert [t for t, r in found.items() if r["flagged"]] == ["This is awful"]
    assert found["This is awful"]["score"] == 1.0


@pytest.mark.parametrize(
    ("text", "hate", "safe", "score", "flagged", "override"),
    [
        ("kill yourself pal bro", ("pal",), ("bro",), 1.0, True, "hate"),
        ("pal", (), ("pal",), 0.0, False, "safe"),
        ("fuck you pal", (), ("pal",), 0.5, False, "safe"),
        ("this has zzz_unique_phrase", ("zzz_unique_phrase",), (), 0.8, True, "hate"),
        ("any", ("",), (" ",), 0.0, False, None),
    ],
)
def test_overrides(spark, text, hate, safe, score, flagged, override):
    row = decided(spark, [text], hate, safe)[text]
    assert (round(row["score"], 2), row["flagged"], row["override"]) == (score, flagged, override)


def test_null_text_is_not_flagged(spark):
    row = S.decide(comments(spark, [None]), phrase_row(spark)).first()
    assert row["score"] == 0 and row["flagged"] is False


def test_band_ends_in_single_precision(spark):
    scores = spark.createDataFrame([(0.6,), (0.8,), (0.59,), (0.81,)], "s double").select(F.col("s"), S.borderline(F.col("s").cast("float"), 0.8).alias("b"))
    assert {r["s"]: r["b"] for r in scores.collect()} == {0.6: True, 0.8: True, 0.59: False, 0.81: False}


def test_opinion_json(spark):
    raw = ['{"label":"hate","score":1.7}', "{}", "oops", '{"label":"x","score":"0.5"}', None]
    got = [tuple(r["o"]) for r in spark.createDataFrame([(r,) for r in raw], "j string").select(S.parse_opinion(F.col("j")).alias("o")).collect()]
    assert got == [("hate", 1.0), ("unknown", 0.0), ("unknown", 0.0), ("x", 0.5), ("unknown", 0.0)]


def test_opinion_sees_only_borderline_rows(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("float")
    def opinion(texts: pd.Series) -> pd.Series:
        seen.add(int(texts.notna().sum()))
        return texts.map(lambda t: 0.1 if t else None).astype("float32")

    done = decided(spark, ["I hate you", "fine", "fuck you"], config=ScanConfig(use_opinion=True), opinion=opinion)
    assert seen.value == 1 and sum(r["asked"] for r in done.values()) == 1


def test_new_flags_keep_repeats_and_blank_separators(spark):
    found = comments(spark, ["a\x01b", "c", "c", "d"])
    known = spark.createDataFrame([("a b",), ("d",)], "text string")
    assert [r["text"] for r in S.not_known(found, known).collect()] == ["c", "c"]


def test_scanning_twice_adds_nothing(spark):
    found = S.decide(comments(spark, ["fuck you", "kill it", "hello"]), phrase_row(spark)).filter("flagged")
    assert found.count() == 2 and S.not_known(found, found.select("text")).count() == 0


def test_lexicon_keeps_first_place_and_last_phrases(spark):
    rows = [(1, " AWFUL ", "hate"), (2, "awful", "hate"), (3, "  ", "hate"), (4, "ok", "safe"), (5, "x", "hate"), (6, "awful", "hate")]
    labels = spark.createDataFrame(rows, "seq long, text string, label string")
    assert {(r["polarity"], r["phrase"], r["seq"]) for r in L.build_lexicon(labels).collect()} == {("hate", "awful", 1), ("hate", "x", 5), ("safe", "ok", 4)}
    assert {r["phrase"] for r in L.build_lexicon(labels, cap=1).collect()} == {"awful", "ok"}  # pushed out by x, then added again
    log = spark.createDataFrame([(k, t, "hate") for k, t in enumerate("abca")], "seq long, text string, label string")
    assert {(r["phrase"], r["seq"]) for r in L.build_lexicon(log, cap=2).collect()} == {("c", 2), ("a", 3)}
    arrays = L.phrase_arrays(L.build_lexicon(labels)).first()
    assert arrays["hate"] == ["awful", "x"] and arrays["safe"] == ["ok"]


def test_the_newest_phrases_are_those_first_labelled_last(spark, tmp_path):
    """A phrase that was pushed out and is labelled again stays where it was: the query agrees with its SQL."""
    log = spark.createDataFrame([(1, "A", "hate"), (2, "b", "hate"), (3, "c", "hate"), (4, "a ", "hate"), (5, " ", "hate"), (3, "d", "hate"), (6, None, "safe"), (7, "s", "safe"), (8, "s", "safe")], "seq long, text string, label string")
    rows = lambda cap: {tuple(r) for r in L.newest_phrases(log, cap).collect()}
    assert rows(2) == {("hate", "c", 3), ("hate", "d", 3), ("safe", "s", 7)} and rows(1) == {("hate", "c", 3), ("safe", "s", 7)}
    assert rows(9) == {("hate", "a", 1), ("hate", "b", 2), ("hate", "c", 3), ("hate", "d", 3), ("safe", "s", 7)}
    n = 1100
    docs = [(k, f"text {k % (n - 50)}") for k in range(n)]  # the first 50 come again, after they were pushed out
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 0, 1) for k in range(n)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    query, sql = QUERIES["build_lexicon"]
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(map(tuple, query(spark, str(tmp_path)).collect())) == sorted(con.execute(sql).fetchall())


def test_config_is_clamped():
    assert ScanConfig(threshold=0.2, max_per_url=9999, interval_minutes=1).clamped() == ScanConfig(threshold=0.5, max_per_url=5000, interval_minutes=15)


def test_blank_and_short_phrases_in_the_join(spark):
    lexicon = spark.createDataFrame([("hate", p) for p in (" ", "", "a", "ab", "abc", "abcd", "xyz")] + [("safe", "c")], "polarity string, phrase string")
    got = {r["comment_id"]: (r["n_hate_hits"], r["n_safe_hits"]) for r in L.phrase_hits(comments(spark, ["ABCD", "", None, "ab", "a b c"]), lexicon).collect()}
    assert got == {0: (4, 1), 1: (0, 0), 2: (0, 0), 3: (2, 0), 4: (1, 1)}
    assert {r["n_hate_hits"] for r in L.phrase_hits(comments(spark, ["x", None]), lexicon.limit(0)).collect()} == {0}


def test_a_failing_model_counts_nothing_and_says_why(spark):
    def model(text):
        if "bad" in text:
            raise ValueError("cannot read")
        return 0.9

    for more in ({"model": S.guarded(model), "config": ScanConfig(use_model=True)}, {"opinion": S.guarded(model), "config": ScanConfig(use_opinion=True)}):
        rows = decided(spark, ["you people bad", "you people", "kill bad", "a pal bad", "die bad"], hate=("pal",), **more)
        failed = rows["you people bad"]
        assert (failed["flagged"], round(failed["score"], 2), failed["error"]) == (False, 0.6, "cannot read")
        assert rows["you people"]["flagged"] and rows["you people"]["error"] is None
        assert all(rows[t]["flagged"] for t in ("kill bad", "a pal bad", "die bad"))  # by the rules, and by the phrase
    df = S.decide(comments(spark, ["bad", "trash pal", "fine'"]), phrase_row(spark, (), ("pal",)), ScanConfig(use_model=True), S.guarded(model))
    lines = {r["text"]: r["line"] for r in S.decision_log(df).collect()}
    assert lines["bad"] == "scan:decision score=0.00 flagged=false error=cannot read text='bad'"
    assert lines["trash pal"] == "scan:decision score=0.90 flagged=false override=safe text='trash pal'"
    assert lines["fine'"] == "scan:decision score=0.90 flagged=true text='fine''"


def test_comments_that_could_not_be_read_are_not_flagged(spark):
    rows = spark.createDataFrame([(1, "kill", None), (2, "kill", "no page")], "comment_id long, text string, failure string")
    done = S.decision_log(S.decide(rows, phrase_row(spark))).collect()
    assert [(r["comment_id"], r["flagged"]) for r in done] == [(1, True), (2, False)] and done[1]["line"] == "scan:error no page"


@pytest.mark.parametrize("answer", [None, float("nan"), 0.0, -3.0])
def test_no_opinion_raises_nothing(spark, answer):
    @F.pandas_udf("float")
    def column(texts: pd.Series) -> pd.Series:
        return pd.Series([answer] * len(texts), dtype="float32")

    for opinion in (lambda t: F.lit(answer).cast("float"), S.guarded(lambda t: answer), column, Batched(lambda: lambda texts: [answer] * len(texts))):
        for kind in ("opinion", "model"):
            rows = decided(spark, ["hate", "toxic", "die"], config=ScanConfig(use_opinion=kind == "opinion", use_model=kind == "model"), **{kind: opinion})
            assert {t: (round(r["score"], 2), r["flagged"]) for t, r in rows.items()} == {"hate": (0.7, False), "toxic": (0.6, False), "die": (0.8, True)}


def test_batched_opinions(spark):
    """One load a worker, only borderline rows reach Python, a batch that fails is asked again row by row."""
    loads, seen = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)

        def score(texts):
            seen.add(len(texts))
            if any("bad" in t for t in texts):
                raise ValueError("cannot read")
            return [0.9] * len(texts)

        return score

    texts = [f"hate {k}" for k in range(50)] + [f"fine {k}" for k in range(500)] + ["hate bad", "kill bad"]
    rows = decided(spark, texts, config=ScanConfig(use_opinion=True), opinion=Batched(load, size=10))
    assert len(rows) == len(texts) and all(rows[f"hate {k}"]["flagged"] for k in range(50))
    assert (rows["hate bad"]["flagged"], rows["hate bad"]["error"]) == (False, "cannot read")
    assert (rows["kill bad"]["flagged"], rows["kill bad"]["asked"]) == (True, False)
    assert 51 <= seen.value <= 51 + 10 and 1 <= loads.value <= 4


def test_opinions_that_take_too_long_or_never_load(spark):
    import time

    def slow(texts):
        if "slow" in texts[0] or len(texts) > 1:
            time.sleep(30)
        return [0.9] * len(texts)

    def broken():
        raise OSError("no such file")

    config, began = ScanConfig(use_opinion=True), time.time()
    rows = decided(spark, ["hate", "hate slow"], config=config, opinion=Batched(lambda: slow, seconds=0.5))
    assert time.time() - began < 25
    assert rows["hate"]["flagged"] and rows["hate slow"]["error"] == "no answer in 0.5 s" and not rows["hate slow"]["flagged"]
    rows = decided(spark, ["hate", "kill"], config=config, opinion=Batched(broken))
    assert rows["hate"]["error"] == "no such file" and rows["kill"]["flagged"]
    rows = decided(spark, ["hate 1", "hate 2"], config=config, opinion=Batched(lambda: lambda texts: [0.9][: 2 - len(texts)]))
    assert all(r["flagged"] for r in rows.values())  # short answers to both, right ones to each


def test_a_learned_model_equals_a_plain_refit(spark, tmp_path):
    """The same words, fitted by Newton's method in numpy."""
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(30)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 8))) for _ in range(120)]
    label = [("hate" if ("w1" in t.split()) + (k % 7 == 0) > 0 else "safe") for k, t in enumerate(texts)]
    rows = spark.createDataFrame([*zip(texts, label, strict=True), (None, "hate"), ("w1", None), ("w1", "other")], "text string, label string")
    model = Learned.fit(rows, penalty=0.05)
    x = np.array([[w in t.split() for w in words] for t in texts], float)
    y = np.array([v == "hate" for v in label], float)
    # The penalty applies to columns in units of their standard deviation.
    scale = x.std(0, ddof=1)
    z = np.hstack([x / np.where(scale > 0, scale, 1), np.ones((len(x), 1))])
    ridge, b = np.diag([0.05] * len(words) + [0]), np.zeros(len(words) + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) / len(x) + ridge, z.T @ (p - y) / len(x) + ridge @ b)
    want = 1 / (1 + np.exp(-z @ b))
    model.save(str(tmp_path / "model"))
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None, " "])], "comment_id long, text string")
    got = sorted(Learned.load(str(tmp_path / "model")).answers(df).collect(), key=lambda r: r["comment_id"])
    assert max(abs(r["_score"] - w) for r, w in zip(got, want)) < 1e-3
    assert [(r["text"], r["_score"]) for r in got[-2:]] == [(None, None), (" ", None)]
    scanned = S.decide(df, phrase_row(spark), ScanConfig(use_model=True), model=model)
    assert {r["comment_id"] for r in scanned.filter("flagged").collect()} == {r["comment_id"] for r in got if (r["_score"] or 0) >= 0.8}


def test_columns_with_clashing_names(spark):
    odd = comments(spark, ["kill", None]).selectExpr("*", "1 as hate", "2 as safe", "3 as _hate", "4 as _key", "5 as _held", "6 as `a.b`", "7 as score", "8 as error", "9 as hate_hits")
    done = S.decide(odd, phrase_row(spark), ScanConfig(use_model=True), S.guarded(lambda t: 0.1))
    assert [(r["hate"], r["safe"], r["_hate"], r["_key"], r["a.b"], r["flagged"]) for r in done.collect()] == [(1, 2, 3, 4, 6, True), (1, 2, 3, 4, 6, False)]
    assert [r["verdict"] for r in S.quick_check(odd, phrase_row(spark)).collect()] == ["Harmful", "Okay"]
    known = comments(spark, ["kill"])
    assert S.not_known(done, known).count() == 1 and not any(r["fresh"] for r in S.with_fresh(done, known).collect())
    assert [r["fresh"] for r in S.with_fresh(done).collect()] == [True, False] and S.with_fresh(done, known).columns == [*done.columns, "fresh"]


def test_automaton_finds_what_a_plain_search_finds():
    rng = random.Random(1)
    for _ in range(150):
        letters = rng.choice(["ab", "abc é", "xyzß日"])
        phrases = list({"".join(rng.choices(letters, k=rng.choice((1, 2, 3, 5, 12, 13, 20)))).encode() for _ in range(rng.randrange(1, 30))})
        texts = ["".join(rng.choices(letters, k=rng.choice((0, 1, 5, 40, 600, 1500)))).encode() for _ in range(rng.randrange(1, 8))]
        cuts, data = np.cumsum([0, *map(len, texts)]), np.frombuffer(b"".join(texts), np.uint8)
        got = Automaton(phrases).occurrences(data, cuts)
        assert list(zip(*(g.tolist() for g in got), strict=True)) == sorted((k, j) for k, t in enumerate(texts) for j, p in enumerate(phrases) if p in t)


def test_phrase_hits_of_many_phrases_and_long_texts(spark, monkeypatch):
    """Linear in the text; a hundred thousand phrases; a lexicon in several broadcasts and passes; null and repeated ids."""
    import time

    rng = random.Random(2)
    phrases = list({f"x{rng.randrange(10**6)} y{rng.randrange(10)}" for _ in range(100_000)})
    rows = [("hate" if k % 2 else "safe", p) for k, p in enumerate(phrases)] + [("hate", phrases[0]), ("other", "q"), ("hate", None)]
    lexicon = spark.createDataFrame(pd.DataFrame(rows, columns=["polarity", "phrase"]))
    few = rng.sample(phrases, 40)
    took = []
    for n in (50_000, 400_000):
        long = ("Filler é words " * n)[: n // 2] + " ".join(few).upper() + ("z y0 x1 " * n)[: n // 2]
        df = spark.createDataFrame([(None, long), (None, "none"), (7, few[0]), (7, None)], "comment_id long, text string")
        want = [sum(phrases.index(p) % 2 == odd for p in few) for odd in (1, 0)]
        began = time.time()
        got = L.phrase_hits(df, lexicon).collect()
        took.append(time.time() - began)
        assert [r["comment_id"] for r in got] == [None, None, 7, 7] and [*got[0]][1:] == want and [*got[1]][1:] == [*got[3]][1:] == [0, 0]
        assert sum([*got[2]][1:]) >= 1
    assert took[1] < took[0] * 8 + 10
    monkeypatch.setattr(L, "HEADS", 300_000)
    monkeypatch.setattr(L, "TOGETHER", 2)
    assert sorted(map(repr, L.phrase_hits(df, lexicon).collect())) == sorted(map(repr, got))


def test_trim_is_linear_in_inner_blanks(spark):
    import time

    began = time.time()
    df = spark.createDataFrame([("\u00a0 a" + " " * 1_000_000 + "b \t\n",), (" " * 1_000_000,), ("",)], "t string").select(L.T.trim_all(F.col("t")).alias("t"))
    assert sorted(len(r["t"]) for r in df.collect()) == [0, 0, 1_000_002]
    assert time.time() - began < 20
