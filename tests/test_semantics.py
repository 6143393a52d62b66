"""Small cases with results worked out by hand, and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import stats as S
from corpusloom.functions import text as T
from corpusloom.functions import udfs as U
from corpusloom.operators import agreement, contracts, dedup, models, privacy, sampling, upsert
from corpusloom.plans.text_plans import transform
from corpusloom.sources import pages, records


def one(df):
    return df.first()


def test_paired_cells(spark):
    df = spark.createDataFrame([(2975, 61, 992, 158)], "a long, b long, c long, d long")
    p = S.paired(*[F.col(c) for c in "abcd"])
    r = one(df.select(*[v.alias(k) for k, v in p.items()]))
    assert (r["eligible_n"], r["first_n"], r["second_n"]) == (4186, 3967, 1053)
    assert round(100 * r["difference"], 2) == 69.61


def test_wilson(spark):
    low, high = S.wilson(F.lit(3967), F.lit(4186))
    r = one(spark.range(1).select(low.alias("l"), high.alias("h")))
    assert (round(r.l, 6), round(r.h, 6)) == (0.940518, 0.954027)
    low, _ = S.wilson(F.lit(0), F.lit(0))
    assert math.isnan(one(spark.range(1).select(low.alias("l"))).l)


def test_proportion_raises(spark):
    with pytest.raises(Exception, match="count outside"):
        spark.range(1).select(S.proportion(F.col("id") + 2, F.lit(1))).collect()


@pytest.mark.parametrize(("text", "out"), [("a　 b", "a b"), ("\x1c a \x1f", "a"), ("", ""), ("  ", ""), ("a\u0085b", "a b")])
def test_collapse_whitespace(spark, text, out):
    assert one(spark.createDataFrame([(text,)], "t string").select(T.collapse_whitespace(F.col("t")).alias("r"))).r == out


def test_cjk_length_and_rules(spark):
    df = spark.createDataFrame([("合成标题", ), ("ＡＢ合",)], "t string")
    config = {"minimum_semantic_cjk_length": 2, "rules": [{"id": "n", "kind": "unicode_normalize", "form": "NFKC"}, {"id": "m", "kind": "character_map", "mapping": {"合": "集", "ab": "x"}}]}
    rows = transform(df, "t", config).collect()
    assert [r.semantic_cjk_length for r in rows] == [4, 1]
    assert [r.record_validity for r in rows] == ["valid", "excluded_short"]
    assert rows[1].final_text == "AB集" and [a.rule_id for a in rows[1].transform_audit] == ["n", "m"]
    with pytest.raises(ValueError, match="unsupported"):
        transform(df, "t", {"minimum_semantic_cjk_length": 0, "rules": [{"id": "x", "kind": "other"}]})


def test_spans():
    assert [s[3] for s in U.innermost_spans("『a(b)c』 [ ] {d}")] == ["a(b)c", "b", "d"]
    assert U.outer_spans(U.innermost_spans("(a[b)c]"))[1]
    assert U.outer_spans(U.innermost_spans("『a(b)c』"))[0][0][3] == "a(b)c"
    spans = U.code_spans("SyntheticLabelAB-123 description")
    assert spans and "code_pattern" in spans[0][3]


def test_exact_spans():
    span = lambda a, b, x, y: {"start": a, "end": b, "expected": x, "replacement": y}
    assert U.exact_spans("abcdef", [span(0, 2, "ab", "X"), span(2, 4, "cd", "")]) == "Xef"
    for bad in ([span(0, 4, "abcd", ""), span(3, 6, "def", "")], [span(0, 2, "xx", "")], [span(4, 9, "ef", "")]):
        with pytest.raises(ValueError):
            U.exact_spans("abcdef", bad)


def test_locators(spark):
    df = spark.createDataFrame([("write a@b.example.org or @handle_1", )], "t string")
    kinds = {r.category for r in privacy.findings(df, "t", privacy.GATE, []).collect()}
    assert {"email", "social_handle", "domain"} <= kinds
    # glued to an ideograph there is no word boundary
    glued = spark.createDataFrame([("字a@b.example.org",)], "t string")
    assert "email" not in {r.category for r in privacy.findings(glued, "t", {"email": privacy.GATE["email"]}, []).collect()}


def test_gate_after_remediation(spark):
    df = spark.createDataFrame([("1", "mail a@b.org now")], "id string, t string")
    assert one(privacy.gate(df, "t").where("category = 'all'")).findings > 0
    decisions = spark.createDataFrame([("1", 5, 12, "a@b.org", "X")], "id string, start int, end int, expected string, replacement string")
    kept, _ = privacy.remediated(df, decisions, "id", "t")
    assert one(privacy.gate(kept, "t").where("category = 'all'")).findings == 0


def test_hamilton_and_sample(spark):
    rows = [(f"r{i}", f"s{i % 2}", f"b{i % 3}") for i in range(12)]
    df = spark.createDataFrame(rows, "id string, s string, b string")
    back = spark.createDataFrame(rows[::-1], "id string, s string, b string").repartition(3)
    ids = lambda d: sorted(r.id for r in sampling.stratified(d, 6, ["s", "b"], 7, "id").collect())
    assert ids(df) == ids(back) and len(ids(df)) == 6
    assert sampling.bounded_hamilton({"a": 10, "b": 30, "c": 60}, 20, {"a": 1, "b": 1, "c": 1}) == {"a": 2, "b": 6, "c": 12}
    assert sampling.duplicate_ids(spark.createDataFrame([("a",), ("a",), ("",)], "id string"), "id").count() == 2


def test_enriched_shortfall(spark):
    df = spark.createDataFrame([("a", "g")], "id string, g string")
    with pytest.raises(Exception, match="fewer rows"):
        sampling.enriched(df, "g", {"g": 2}, 1, "id").collect()


def test_waves_use_the_frame_once(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}") for i in range(30)], "id long, s string")
    rows = sampling.waves(df, ["s"], [5, 10, 15], 1, "id").collect()
    assert sorted(r.id for r in rows) == list(range(30)) and [sum(r.wave == w for r in rows) for w in (1, 2, 3)] == [5, 10, 15]


def test_numbered(spark):
    df = spark.range(1000).withColumn("k", F.sha2(F.col("id").cast("string"), 256)).repartition(7)
    rows = dedup.numbered(df.select("k"), ["k"]).collect()
    assert [r.corpus_index for r in sorted(rows, key=lambda r: r.k)] == list(range(1, 1001))


def test_dedup_canonical(spark):
    df = spark.createDataFrame([("second", "t", "2026-01-02"), ("first", "t", "2026-01-01"), ("x", "u", "2026-01-01")], "id string, text string, at string")
    rows = {r.id: r for r in dedup.flag_exact(df, "text", ["at", "id"]).collect()}
    assert rows["first"].is_canonical and not rows["second"].is_canonical and rows["first"].duplicate_group_size == 2


def test_agreement(spark):
    # labels of two coders over four items
    df = spark.createDataFrame([("1", "a", "a"), ("2", "b", "b"), ("3", "a", "b"), ("4", "c", "c")], "i string, x string, y string")
    r = one(agreement.summary(df, "x", "y"))
    assert r.exact_agreement_rate == 0.75 and round(r.kappa, 6) == 0.636364
    flat = spark.createDataFrame([("a", "a")] * 3, "x string, y string")
    assert one(agreement.summary(flat, "x", "y")).kappa == 1.0
    r = one(agreement.summary(flat, "x", "y", undefined="null"))
    assert r.kappa is None and r.kappa_status == "undefined_no_marginal_variation"
    assert agreement.confusion(df, "x", "y").count() == 9


def test_exact_tests():
    assert U.mcnemar_exact(0, 0) == (1.0, 0.0)
    assert round(U.mcnemar_exact(1, 5)[0], 6) == 0.21875
    assert round(U.fisher_exact(3, 4, 1, 4), 6) == 0.485714
    assert math.isnan(U.fisher_exact(0, 0, 1, 4))


def test_bh(spark):
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate((0.01, 0.04, 0.03, float("nan")))], "family string, i int, p double")
    q = {r.i: r.q for r in S.bh_adjusted(df, "p", "family", "i").collect()}
    assert round(q[0], 6) == 0.03 and round(q[1], 6) == 0.04 and round(q[2], 6) == 0.04 and math.isnan(q[3])


def test_firth_separated():
    """Finite estimates under complete separation, symmetric by construction."""
    x = np.array([[1.0, 0.0], [1.0, 1.0]])
    ten = np.array([10.0, 10.0])
    for climb in (models.newton, models.lbfgs):
        fit = climb(models.Grouped(x, np.array([0.0, 10.0]), ten))
        assert round(fit.beta[1] + 2 * fit.beta[0], 5) == 0 and round(fit.beta[0], 5) == round(math.log(0.5 / 10.5), 5)
    low, high, p = models.profile_interval(x, np.array([3.0, 7.0]), models.firth(x, np.array([3.0, 7.0]), ten), 1, ten)
    assert low < 1.6 < high and 0.05 < p < 0.2


def test_corrections(spark):
    base = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, v int")
    e = spark.createDataFrame([("a", 1, "save", 2, "why"), ("b", 1, "save", 2, "why"), ("b", 2, "reset", None, "undo"), ("c", 1, "save", 1, " ")], "k string, revision int, action string, v int, reason string")
    rows = {r.k: r for r in upsert.corrections(base, e, "k", "v").collect()}
    assert (rows["a"].current, rows["b"].current, rows["b"].active) == (2, 1, False) and not rows["c"].valid


def test_contract_unknown_key_and_long_span(spark):
    c = contracts.Contract(enums={"f": ("x", "y")}, reasons=None, adjudication=None)
    ok = '{"f":"x","evidence":[{"span":"ab","supports":[{"field":"f","code":"x"}]}]}'
    raw = [ok, ok.replace('"f":"x",', '"f":"x","g":1,', 1), ok.replace('"ab"', '"' + "a" * 161 + '"'), ok.replace('"f":"x",', '"f":"z",', 1), "not json"]
    df = spark.createDataFrame([(r, "ab" + "a" * 200) for r in raw], "raw string, title string")
    found = [r.violations for r in contracts.validated(df, c, "raw", "title").collect()]
    assert found[0] == [] and "keys" in found[1] and "evidence_span" in found[2] and "enum:f" in found[3] and found[4] == ["json"]


def test_page_items(spark):
    html = '<a class="item" href="/record/alpha"> Alpha </a><a class="item" href="/record/alpha">again</a><a class="item" href="/r"><img alt="By image"></a><a href="/page/3" rel="next">3</a><a href="/page/2">2</a>'
    df = spark.createDataFrame([("https://example.invalid/list", html)], "url string, html string")
    assert [(r.url, r.title) for r in pages.items(df, ["item"]).orderBy("position").collect()] == [("https://example.invalid/record/alpha", "Alpha"), ("https://example.invalid/r", "By image")]
    assert one(pages.next_pages(df)).next_url == "https://example.invalid/page/2"
    bare = spark.createDataFrame([("https://example.invalid/", '<a href="/x">A long title</a><a href="/y">no</a>')], "url string, html string")
    assert [r.title for r in pages.items(bare, ["item"]).collect()] == ["A long title"]


def test_guarded_sink(spark):
    with pytest.raises(ValueError, match="not to be published"):
        records.guarded(spark.createDataFrame([("x",)], "text string"))


def test_firth_gradient_and_failures():
    from corpusloom.operators import models

    rng = np.random.default_rng(3)
    x = np.column_stack([np.ones(12), rng.integers(0, 2, 12), rng.normal(size=12)])
    n = rng.integers(1, 9, 12).astype(float)
    design = models.Grouped(x, np.floor(n * rng.random(12)), n)
    beta = np.array([0.2, -0.4, 0.7])
    for j in range(3):
        e = np.eye(3)[j] * 1e-6
        assert design.at(beta)[1][j] == pytest.approx((design.at(beta + e)[0] - design.at(beta - e)[0]) / 2e-6, rel=1e-5)
    a, b = models.newton(design), models.lbfgs(design)
    assert a.beta == pytest.approx(b.beta, abs=1e-5) and models.newton(models.Grouped(x, design.y, n, {1: 0.3})).beta[1] == 0.3
    twice = models.Grouped(x[:, [0, 1, 1]], design.y, n)
    for climb in (models.newton, models.lbfgs):
        with pytest.raises(models.FitError):
            climb(twice)
    with pytest.raises(models.FitError):
        models.newton(design, rounds=1)
    with pytest.raises(models.FitError):
        models.Grouped(np.full((2, 1), np.nan), n[:2], n[:2])
    assert all(math.isnan(v) for v in models.controlled(x, n, n).values()) and all(math.isnan(v) for v in models.controlled(x[:3], n[:3] * 0 + 1, n[:3] * 0 + 2).values())


def test_bootstrap_draws_rows_within_treatment_999_times(spark):
    import numpy as np

    import __spark_entry__ as entry
    from corpusloom.operators import models

    x = np.array([[1, 0, 0], [1, 0, 1], [1, 1, 0], [1, 1, 1]], float)
    n, y = np.array([20, 1, 30, 2], float), np.array([5, 1, 12, 0], float)
    sizes = set()
    for i in range(50):
        design, hits, drawn = models.resampled(x, y, n, np.random.default_rng(i))
        assert [drawn[design[:, 1] == t].sum() for t in (0, 1)] == [21, 32] and (hits <= drawn).all() and (drawn > 0).all()
        assert np.linalg.matrix_rank(design) == design.shape[1]
        sizes.add(tuple(drawn))
    assert len(sizes) > 1
    row = entry.queries()["sta_39"](spark, "/root/testdata/sf0.001").first()
    assert row.successful + row.failures == 999 and row.successful > 900 and row.low <= row.estimate <= row.high
