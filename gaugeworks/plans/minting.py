"""Minted negatives, probes of both arms, and splits by quotas and mass."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import gates, minting, quotas
from gaugeworks.registry import query
from gaugeworks.sources.adapters import ITEMS, items, read

#: Event types, and two classes that no frame is asked to count (fixed values).
VOCABULARY = ("click", "error", "purchase", "signup", "view", "logout", "refund")
RULE = minting.MintRule(dose_ratio=5.0, max_per_frame=2, seed=42)


def frame_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions on frames, a user's events of one template: classes shown, counts, pairs, sameness."""
    k = F.col("k")
    kind = F.when(F.col("fmt") == "fo_class", "names").when(F.col("fmt") == "number", "count").when(k % 2 == 0, "both").otherwise("all_same")
    return items(spark, sf_dir).select(
        F.concat_ws("-", "video", "template").alias("frame"),
        F.when(F.col("template").isin("T5", "T6"), "OOD").otherwise("ID").alias("side"),
        kind.alias("kind"),
        F.col("grp").alias("a"),
        F.element_at(minting.literal(VOCABULARY), (F.floor(k / 2) % 7 + 1).cast("int")).alias("b"),
        F.col("answer").alias("n"),
        F.when(k % 2 == 0, F.floor(k / 6) % 3 == 0).otherwise(F.floor(k / 6) % 2 == 0).alias("yes"),
    )


WORDS = ", ".join(f"'{c}'" for c in VOCABULARY)
QUESTIONS = f"""{ITEMS}, fq AS (SELECT video || '-' || template AS frame, CASE WHEN template IN ('T5', 'T6') THEN 'OOD' ELSE 'ID' END AS side,
    CASE WHEN fmt = 'fo_class' THEN 'names' WHEN fmt = 'number' THEN 'count' WHEN k % 2 = 0 THEN 'both' ELSE 'all_same' END AS kind,
    grp AS a, [{WORDS}][(k // 2) % 7 + 1] AS b, answer AS n, CASE WHEN k % 2 = 0 THEN (k // 6) % 3 = 0 ELSE (k // 6) % 2 = 0 END AS yes FROM ev),
    inv AS (SELECT frame, any_value(side) AS side, coalesce(list_sort(list(DISTINCT a) FILTER (kind = 'names' OR kind = 'count' AND n > 0)), []) AS named FROM fq GROUP BY frame)"""

MINTED = f"""{QUESTIONS}, shown AS (SELECT DISTINCT frame, unnest([a, b]) AS c FROM fq WHERE kind = 'both' AND yes),
    rep AS (SELECT inv.frame, list_sort(list_distinct(list_concat(named, coalesce(list(c) FILTER (c IS NOT NULL), [])))) AS named FROM inv LEFT JOIN shown USING (frame) GROUP BY inv.frame, named),
    gone AS (SELECT frame, CASE WHEN list_contains(named, a) THEN b ELSE a END AS c FROM fq JOIN rep USING (frame) WHERE kind = 'both' AND NOT yes AND list_contains(named, a) <> list_contains(named, b)
        UNION SELECT frame, c FROM (SELECT frame, named, unnest([{WORDS}]) AS c FROM fq JOIN rep USING (frame) WHERE kind = 'all_same' AND yes AND len(named) = 1) WHERE NOT list_contains(named, c)),
    asked AS (SELECT a AS c, count(*) AS n FROM fq WHERE kind = 'count' GROUP BY a),
    w AS (SELECT c, n, 1.0 + 5.0 * (n = max(n) OVER ())::INT + 2.0 * (n < 100)::INT AS w FROM asked),
    cand AS (SELECT frame, named, x.c, w.w IS NOT NULL AS seen, pow(('0x' || substr(md5('42|mint|' || frame || '|' || x.c), 1, 8))::UBIGINT / 4294967296.0, 1.0 / coalesce(w.w, 1.0)::DOUBLE) AS score
        FROM (SELECT frame, named, unnest([{WORDS}]) AS c FROM rep WHERE len(named) > 0) x LEFT JOIN w ON w.c = x.c WHERE NOT list_contains(named, x.c)),
    size AS (SELECT round_even((SELECT sum(n) FROM asked) / 5.0, 0)::BIGINT AS target, count(*) FILTER (seen) AS n_seen, count(*) FILTER (NOT seen) AS n_unseen FROM cand),
    quota AS (SELECT *, least(round_even(target * 0.1::DOUBLE, 0)::BIGINT, n_unseen) AS q_unseen FROM size),
    picked AS (SELECT cand.*, row_number() OVER (PARTITION BY seen ORDER BY score DESC, frame, c) AS p FROM cand),
    kept AS (SELECT frame, c, named, seen, row_number() OVER (PARTITION BY frame ORDER BY c) AS place FROM picked, quota WHERE p <= CASE WHEN seen THEN least(target - q_unseen, n_seen) ELSE q_unseen END),
    minted AS (SELECT kept.frame, kept.c AS class, 0 AS answer, array_to_string(named, ', ') AS named, seen AS seen_class, CASE WHEN gone.c IS NULL THEN 'closure' ELSE 'binary' END AS evidence
        FROM kept LEFT JOIN gone ON gone.frame = kept.frame AND gone.c = kept.c WHERE place <= 2)"""


@query("smp17_mint_negatives", f"WITH {MINTED} SELECT * FROM minted")
def smp17(spark, sf_dir):
    return minting.mint(frame_questions(spark, sf_dir), VOCABULARY, RULE).rows


@query("gat17_dose_and_mix_gate", f"WITH {MINTED}, plurals AS (SELECT upper(a[1]) || lower(a[2:]) || CASE WHEN regexp_matches(a, '(s|sh|ch|x|z)$') THEN 'es' ELSE 's' END AS noun, count(*) AS n FROM fq WHERE kind = 'count' GROUP BY ALL) SELECT class AS name, 'minted' AS what, count(*) AS n FROM minted GROUP BY class UNION ALL SELECT noun, 'asked', n FROM plurals")
def gat17(spark, sf_dir):
    questions = frame_questions(spark, sf_dir)
    made = minting.mint(questions, VOCABULARY, RULE)
    rows = minting.written(made.rows, "minted")
    minting.dose_holds(rows, made.target)
    gates.class_mix(rows, "class")
    asked = minting.plurals_match(questions.filter("kind = 'count'").select(minting.plural(F.col("a")).alias("noun")), "noun", VOCABULARY)
    mix = rows.groupBy(F.col("class").alias("name")).agg(F.lit("minted").alias("what"), F.count(F.lit(1)).alias("n"))
    return mix.unionByName(asked.select(F.col("noun").alias("name"), F.lit("asked").alias("what"), "n"))


@query("smp14_closure_inventory", f"WITH {QUESTIONS} SELECT frame, len(named) AS present, 7 - len(named) AS absent FROM inv")
def smp14(spark, sf_dir):
    inventory = minting.closure_inventory(frame_questions(spark, sf_dir))
    return inventory.select("frame", F.size("named").alias("present"), F.size(F.array_except(minting.literal(VOCABULARY), F.col("named"))).alias("absent"))


@query("smp14_probe_set", f"""WITH {QUESTIONS}, u AS (SELECT frame, side, named, list_filter([{WORDS}], lambda x: NOT list_contains(named, x)) AS others, row_number() OVER (PARTITION BY side ORDER BY md5('0|probe|' || frame), frame) AS p FROM inv WHERE len(named) > 0 AND len(named) < 7),
    d AS (SELECT *, ('0x' || substr(md5('0|absent|' || frame), 1, 8))::UBIGINT / 4294967296.0 AS ua, ('0x' || substr(md5('0|present|' || frame), 1, 8))::UBIGINT / 4294967296.0 AS up FROM u WHERE p <= 60),
    q AS (SELECT frame, side, named, unnest([{{'arm': 'absent', 'c': others[floor(ua * len(others))::INT + 1]}}, {{'arm': 'present', 'c': named[floor(up * len(named))::INT + 1]}}]) AS q FROM d)
    SELECT frame, side, q.c AS class, q.arm AS arm, unnest(['number', 'binary']) AS fmt, array_to_string(named, ', ') AS named FROM q""")
def smp14_probe(spark, sf_dir):
    questions = frame_questions(spark, sf_dir)
    frames = questions.groupBy("frame").agg(F.min("side").alias("side"))
    return minting.probe_set(questions, frames, VOCABULARY, "side", 60)


SHARES = {"train": 0.6, "val_id": 0.2, "test_id": 0.2}


@query("smp04_split_with_shift", """WITH RECURSIVE o AS (SELECT o_custkey AS cluster, count(*) AS m FROM orders GROUP BY 1),
    c AS (SELECT c_nationkey AS stratum, c_custkey AS cluster, coalesce(m, 0) AS m FROM customer LEFT JOIN o ON cluster = c_custkey),
    n AS (SELECT stratum, count(*) AS n, round_even(count(*) * 0.2::DOUBLE, 0)::BIGINT AS q FROM c WHERE stratum <> 3 GROUP BY stratum),
    r AS (SELECT c.*, n - 2 * q AS q0, q AS q1, q AS q2, row_number() OVER (PARTITION BY stratum ORDER BY m DESC, md5('4|split|' || cluster), cluster) AS rn FROM c JOIN n USING (stratum)),
    g AS (SELECT stratum, 0::BIGINT AS rn, NULL::BIGINT AS cluster, 0::BIGINT AS m, NULL::INT AS pick, 0::BIGINT AS g0, 0::BIGINT AS g1, 0::BIGINT AS g2, 0::BIGINT AS m0, 0::BIGINT AS m1, 0::BIGINT AS m2 FROM n
        UNION ALL
        SELECT stratum, rn, cluster, m, pick, g0 + (pick = 0)::INT, g1 + (pick = 1)::INT, g2 + (pick = 2)::INT, m0 + m * (pick = 0)::INT, m1 + m * (pick = 1)::INT, m2 + m * (pick = 2)::INT FROM (
            SELECT *, CASE WHEN o0 AND d0 >= d1 AND d0 >= d2 THEN 0 WHEN o1 AND d1 >= d2 THEN 1 ELSE 2 END AS pick FROM (
                SELECT *, CASE WHEN o0 THEN 3 * dealt - shared * m0 ELSE -1e18 END AS d0, CASE WHEN o1 THEN dealt - shared * m1 ELSE -1e18 END AS d1, CASE WHEN o2 THEN dealt - shared * m2 ELSE -1e18 END AS d2 FROM (
                    SELECT r.stratum, r.rn, r.cluster, r.m, g0, g1, g2, m0, m1, m2, g0 < q0 AS o0, g1 < q1 AS o1, g2 < q2 AS o2, 3 * (g0 < q0)::INT + (g1 < q1)::INT + (g2 < q2)::INT AS shared,
                           m0 * (g0 < q0)::INT + m1 * (g1 < q1)::INT + m2 * (g2 < q2)::INT + r.m AS dealt
                    FROM g JOIN r ON r.stratum = g.stratum AND r.rn = g.rn + 1))))
    SELECT stratum, cluster, m, ['train', 'val_id', 'test_id'][pick + 1] AS split FROM g WHERE rn > 0 UNION ALL SELECT stratum, cluster, m, 'val_ood' FROM c WHERE stratum = 3""")
def smp04(spark, sf_dir):
    masses = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cluster")).agg(F.count(F.lit(1)).alias("m"))
    customers = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("stratum"), F.col("c_custkey").alias("cluster"))
    clusters = customers.join(masses, "cluster", "left").select("stratum", "cluster", F.coalesce("m", F.lit(0)).alias("m"))
    shifted = clusters.filter("stratum = 3")
    if shifted.isEmpty():
        raise ValueError("no cluster is of the stratum that is left out")
    dealt = quotas.mass_split(clusters.filter("stratum <> 3"), "cluster", "m", SHARES, "train", "stratum", seed=4)
    return dealt.unionByName(shifted.withColumn("split", F.lit("val_ood")))


@query("smp06_mass_balanced", f"""WITH RECURSIVE {ITEMS}, c AS (SELECT video, count(*) FILTER (grp = 'click') AS n_clip, count(*) FILTER (grp = 'view') AS n_bag FROM ev GROUP BY video),
    t AS (SELECT count(*) AS n, count(*) * 3 // 10 AS h FROM c),
    r AS (SELECT video, n_clip, n_bag, n_clip + n_bag AS m, row_number() OVER (ORDER BY n_clip + n_bag DESC, md5('42|split|' || video), video) AS rn FROM c),
    g AS (SELECT 0::BIGINT AS rn, NULL::VARCHAR AS video, NULL::BOOLEAN AS hold, 0::BIGINT AS g0, 0::BIGINT AS g1, 0::BIGINT AS m0, 0::BIGINT AS m1
        UNION ALL
        SELECT rn, video, hold, g0 + (NOT hold)::INT, g1 + hold::INT, m0 + m * (NOT hold)::INT, m1 + m * hold::INT FROM (
            SELECT r.rn, r.video, r.m, g0, g1, m0, m1, g0 >= n - h OR g1 < h AND (n - h) * (m0 + m1 + r.m) - n * m0 < h * (m0 + m1 + r.m) - n * m1 AS hold FROM g, t, r WHERE r.rn = g.rn + 1))
    SELECT video, n_clip, n_bag, m AS n_pos, CASE WHEN hold THEN 'hold' ELSE 'train' END AS split FROM g JOIN r USING (rn, video)""")
def smp06(spark, sf_dir):
    of = [F.count_if(F.col("grp") == grp).alias(name) for grp, name in (("click", "n_clip"), ("view", "n_bag"))]
    clusters = items(spark, sf_dir).groupBy("video").agg(*of).withColumn("n_pos", F.col("n_clip") + F.col("n_bag"))
    n = clusters.count()
    hold = n * 3 // 10
    counts = {"train": n - hold, "hold": hold}
    shares = {name: Fraction(c, max(n, 1)) for name, c in counts.items()}
    split = minting.written(quotas.mass_split(clusters, "video", "n_pos", shares, "train", counts=counts, seed=42), "split")
    quotas.counts_hold(split, counts)
    return quotas.drift_at_most(split, "hold", float(shares["hold"]), {"n_pos": 0.03, "n_clip": 0.06, "n_bag": 0.06})
