"""Multi-label sets over orders, confusion and lookup tables over items."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import labelling
from gaugeworks.plans.rounding import rounded
from gaugeworks.registry import query
from gaugeworks.sources.adapters import ITEMS, SETS, items, order_sets

CLASSES = f"""WITH {SETS}, e AS (SELECT key, gold, pred, unnest(list_distinct(list_concat(gold, pred))) AS class FROM os),
    c AS (SELECT class, count(*) FILTER (list_contains(gold, class) AND list_contains(pred, class)) AS tp, count(*) FILTER (NOT list_contains(gold, class) AND list_contains(pred, class)) AS fp,
          count(*) FILTER (list_contains(gold, class) AND NOT list_contains(pred, class)) AS fn, count(*) FILTER (list_contains(gold, class)) AS n_gold, count(*) FILTER (list_contains(pred, class)) AS n_pred FROM e GROUP BY class)"""


@query("agg23_class_counts", f"{CLASSES} SELECT * FROM c")
def agg23(spark, sf_dir):
    return labelling.class_counts(order_sets(spark, sf_dir))


@query("agg28_class_report", f"""{CLASSES} SELECT class, tp, fp, fn, n_gold, n_pred, round(n_pred / nullif(n_gold, 0), 6) AS emission, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
    round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def agg28(spark, sf_dir):
    return rounded(labelling.class_report(order_sets(spark, sf_dir)), "emission", "precision", "recall", "f1")


@query("agg25_macro_f1", f"""{CLASSES}, m AS (SELECT avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) AS macro_f1, count(*) AS n_classes FROM c WHERE n_gold > 0),
    w AS (SELECT count(*) AS n, count(*) FILTER (pred IS NULL) AS n_illegal, avg((gold = pred)::INT) AS exact_set_acc FROM os)
    SELECT n, n_illegal, round(exact_set_acc, 6) AS exact_set_acc, round(macro_f1, 6) AS macro_f1, n_classes FROM w, m""")
def agg25(spark, sf_dir):
    return rounded(labelling.macro_f1(order_sets(spark, sf_dir)), "exact_set_acc", "macro_f1")


@query("agg26_recall_by_size", f"""WITH {SETS} SELECT len(gold) AS n_gold, count(*) AS n, round(avg(len(list_intersect(gold, pred)) / len(gold)), 6) AS recall,
    round(avg((len(list_intersect(gold, pred)) = len(gold))::INT), 6) AS contained, round(avg(len(pred)), 6) AS mean_pred FROM os GROUP BY len(gold)""")
def agg26(spark, sf_dir):
    return rounded(labelling.set_recall_by_size(order_sets(spark, sf_dir)), "recall", "contained", "mean_pred")


@query("agg27_error_taxonomy", f"""WITH {SETS}, s AS (SELECT len(list_filter(gold, lambda x: NOT list_contains(pred, x))) AS m, len(list_filter(pred, lambda x: NOT list_contains(gold, x))) AS e, len(list_intersect(gold, pred)) AS i FROM os)
    SELECT CASE WHEN m = 0 AND e = 0 THEN 'exact' WHEN e = 0 THEN 'subset' WHEN m = 0 THEN 'superset' WHEN m = 1 AND e = 1 THEN 'swap' WHEN i = 0 THEN 'disjoint' ELSE 'other' END AS kind, count(*) AS n FROM s GROUP BY 1""")
def agg27(spark, sf_dir):
    return labelling.error_taxonomy(order_sets(spark, sf_dir))


@query("agg31_set_confusion", f"WITH {SETS} SELECT gold[1] AS gold, CASE WHEN len(pred) = 0 THEN 'none' ELSE array_to_string(pred, ', ') END AS pred, count(*) AS n FROM os WHERE len(gold) = 1 GROUP BY ALL")
def agg31(spark, sf_dir):
    rows = order_sets(spark, sf_dir).filter(F.size("gold") == 1)
    named = F.when(F.size("pred") == 0, "none").otherwise(F.array_join("pred", ", "))
    return rows.groupBy(F.col("gold")[0].alias("gold"), named.alias("pred")).agg(F.count(F.lit(1)).alias("n"))


@query("agg32_confusion", f"WITH {ITEMS}, c AS (SELECT template, answer, pred, count(*) AS n FROM ev GROUP BY ALL) SELECT template, answer, pred, n, round(n / sum(n) OVER (PARTITION BY template, answer), 6) AS p FROM c")
def agg32(spark, sf_dir):
    return rounded(labelling.confusion(items(spark, sf_dir), ["template"], "answer", "pred"), "p")


@query("agg32_confusion_summary", f"""WITH {ITEMS}, c AS (SELECT template, answer, pred, count(*) AS n FROM ev GROUP BY ALL),
    t AS (SELECT template, answer, arg_max(pred, n * 1000 - pred) AS mode, sum(n) AS n, sum(n) FILTER (answer = pred) AS r FROM c GROUP BY ALL)
    SELECT template, sum(n)::BIGINT AS n, round(coalesce(sum(r), 0) / sum(n), 6) AS accuracy, count(*) = count(DISTINCT mode) AS injective, sum(n) < 30 AS underpowered FROM t GROUP BY template""")
def agg32_summary(spark, sf_dir):
    return rounded(labelling.confusion_summary(items(spark, sf_dir), ["template"], "answer", "pred"), "accuracy")


@query("agg33_lookup_gain", f"""WITH {ITEMS}, c AS (SELECT template, pred, answer, count(*) AS n FROM ev GROUP BY ALL), b AS (SELECT template, pred, max(n) AS best, sum(n) AS n, coalesce(sum(n) FILTER (pred = answer), 0) AS r FROM c GROUP BY ALL),
    d AS (SELECT template, sum(n)::BIGINT AS n, sum(r) / sum(n) AS acc, sum(best) / sum(n) AS acc_lut FROM b GROUP BY template)
    SELECT template, n, round(acc, 6) AS acc, round(acc_lut, 6) AS acc_lut, round(acc_lut - acc, 6) AS gain FROM d""")
def agg33(spark, sf_dir):
    return rounded(labelling.lookup_gain(items(spark, sf_dir), ["template"], "pred", "answer"), "acc", "acc_lut", "gain")


@query("agg34_transfer_gain", f"""WITH {ITEMS}, c AS (SELECT template, pred, answer, count(*) AS n FROM ev WHERE dist = 'ID' GROUP BY ALL), l AS (SELECT template, pred, arg_max(answer, n * 1000 - answer) AS best FROM c GROUP BY ALL),
    j AS (SELECT ev.template, ev.pred, answer, best FROM ev LEFT JOIN l ON ev.template = l.template AND ev.pred = l.pred WHERE dist = 'OOD'),
    d AS (SELECT template, count(*) AS n, avg((pred = answer)::INT) AS acc, avg(coalesce(best = answer, false)::INT) AS acc_lut, count(*) FILTER (best IS NULL) AS n_unseen FROM j GROUP BY template)
    SELECT template, n, round(acc, 6) AS acc, round(acc_lut, 6) AS acc_lut, n_unseen, round(acc_lut - acc, 6) AS gain FROM d""")
def agg34(spark, sf_dir):
    rows = items(spark, sf_dir)
    done = labelling.transfer_gain(rows.filter("dist = 'ID'"), rows.filter("dist = 'OOD'"), ["template"], "pred", "answer")
    return rounded(done, "acc", "acc_lut", "gain")


@query("agg29_concentration", f"""WITH {ITEMS}, s AS (SELECT video, count(*) FILTER (correct_a = 0)::BIGINT AS mass FROM ev GROUP BY video), p AS (SELECT video, mass, row_number() OVER o AS rank, sum(mass) OVER o AS running, sum(mass) OVER () AS total FROM s WHERE mass > 0
    WINDOW o AS (ORDER BY mass DESC, video ROWS UNBOUNDED PRECEDING)) SELECT video, mass, rank, running::BIGINT AS running, total::BIGINT AS total, running - mass < total / 2 AS in_half FROM p""")
def agg29(spark, sf_dir):
    return labelling.concentration(items(spark, sf_dir), "video", (F.col("correct_a") == 0).cast("long"))


@query("agg30_counterfactual", f"""WITH {ITEMS}, w AS (SELECT avg(correct_a) AS base, avg(CASE WHEN fmt = 'number' THEN 1.0 ELSE correct_a END) AS s1, avg(CASE WHEN k % 7 < 2 THEN 1.0 ELSE correct_a END) AS s2 FROM ev)
    SELECT 'numbers' AS scenario, round(s1, 6) AS accuracy, round(s1 - base, 6) AS headroom FROM w UNION ALL SELECT 'templates', round(s2, 6), round(s2 - base, 6) FROM w""")
def agg30(spark, sf_dir):
    done = labelling.counterfactual(items(spark, sf_dir), {"numbers": F.col("fmt") == "number", "templates": F.col("k") % 7 < 2}, "correct_a")
    return rounded(done, "accuracy", "headroom")


@query("agg42_route", f"""WITH {ITEMS}, c AS (SELECT fmt, dist, count(*) AS n, count(*) FILTER (correct_a = 1 AND correct_b = 1) AS "both", count(*) FILTER (correct_a = 1 AND correct_b = 0) AS only_a,
    count(*) FILTER (correct_a = 0 AND correct_b = 1) AS only_b, count(*) FILTER (correct_a = 0 AND correct_b = 0) AS neither FROM ev GROUP BY ALL)
    SELECT *, CASE WHEN only_b > only_a THEN 'b' ELSE 'a' END AS routed, round(("both" + greatest(only_a, only_b)) / n, 6) AS routed_acc, round((n - neither) / n, 6) AS oracle, round(least(only_a, only_b) / n, 6) AS headroom FROM c""")
def agg42(spark, sf_dir):
    return rounded(labelling.route(items(spark, sf_dir), ["fmt", "dist"]), "routed_acc", "oracle", "headroom")
