"""URL filter: explicit rules, and a tree of path templates judged by labelled purity.

For every host the paths make a tree of segments.  Segments that vary are generalised to
wildcards (digits at once; any segment, where a node has many rare children), sibling
branches whose shares of bad evidence don't differ significantly are merged, and a
template is rejected when its smoothed share of bad evidence is above one half.

DataFrame functions only; every step is a grouped sum of narrow rows with partial
aggregation, each level of the tree is written once, and frequent keys are joined on
the map side, so neither a host with very many pages nor a path with them is one task.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import split_join
from .storage import materialise

#: Rules of the query: verdict, host and path prefix.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Host and path words that label a page as bad where no rule does, their plurals and -ing forms too (fixed values).
BAD_WORDS = tuple(
    "adult bet betting blackjack camgirl casino cialis gamble gambling hentai jackpot keygen malware milf "
    "payday phish pills poker porn porno roulette sexcam spam spyware viagra warez xrated xxx".split()
)
DEPTH = 3
#: A node with more children than this has its rare ones (below the share) taken as one wildcard.
MAX_CHILDREN = 20
RARE_SHARE = 0.05
#: Branches are merged unless they differ at this two-sided normal deviate (five in a hundred).
DEVIATE = 1.96
#: Smoothing: share and weight of the pages that every template is taken to have had before.
PRIOR_BAD = 0.1
PRIOR_PAGES = 2.0
REJECT_ABOVE = 0.5
#: A labelled page weighs this many parts, one without a label so few, and on the good side.
PARTS, UNLABELLED_PARTS = 10, 1
UNLABELLED_WEIGHT = UNLABELLED_PARTS / PARTS


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def first_fit(host: Column, path: Column, rules, value) -> Column:
    """``value(verdict, rule)`` of the longest rule that fits, else null; for rule lists of some hundreds."""
    found = F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        of_host, slash, of_path = rule.partition("/")
        fits = ((host == of_host) | F.endswith(host, F.lit("." + of_host))) & F.startswith(path, F.lit(slash + of_path))
        found = F.when(fits, F.lit(value(verdict, rule))).otherwise(found)
    return found


def segments(path: Column, depth: int = DEPTH) -> list[Column]:
    """The first ``depth`` segments with digit runs as ``*`` (empty where there are none); the last holds all that follow."""
    parts = F.filter(F.split(F.regexp_replace(path, r"[0-9]+", "*"), "/"), lambda x: x != "")
    first = [F.coalesce(F.get(parts, F.lit(k)), F.lit("")) for k in range(depth - 1)]
    return [*first, F.array_join(F.slice(parts, F.lit(depth), F.greatest(F.size(parts), F.lit(1))), "/")]


def bad_words(host: Column, path: Column) -> Column:
    pattern = "(^|[^a-z])(" + "|".join(BAD_WORDS) + ")(s|es|ing)?([^a-z]|$)"
    return F.rlike(F.concat(host, F.lit(" "), F.lower(path)), F.lit(pattern))


def generalise(leaves: DataFrame, level: int, n_leaves: int) -> DataFrame:
    """Replaces column ``s<level>`` of the tree's leaves by ``t<level>``: wildcards for rare and for similar children.

    A node's children are of two kinds, those with mostly bad evidence and the others;
    only children of one kind share a wildcard, ``*`` for the clean and ``*!`` for the bad.
    """
    parent, own = ["host", *(f"t{k}" for k in range(1, level))], f"s{level}"
    children = leaves.groupBy(*parent, own).agg(*(F.sum(c).alias(c) for c in ("pages", "weight", "bad")), F.count(F.lit(1)).alias("n_leaves"))
    children = children.withColumn("is_bad", 2 * F.col("bad") > F.col("weight"))
    of_kind = lambda c, kind: F.coalesce(F.sum(F.when(F.col("is_bad") == kind, F.col(c))), F.lit(0))
    nodes = children.groupBy(*parent).agg(
        F.count(F.lit(1)).alias("node_children"),
        F.sum("pages").alias("node_pages"),
        *(of_kind(c, kind).alias(f"{name}_{c}") for kind, name in ((True, "bad"), (False, "clean")) for c in ("weight", "bad")),
    )
    with_node = split_join(children, nodes.withColumn("n_children", F.col("node_children")), parent, "n_children", [own], n_leaves)
    kind_weight, kind_bad = (F.when(F.col("is_bad"), F.col(f"bad_{c}")).otherwise(F.col(f"clean_{c}")) for c in ("weight", "bad"))
    rare = (F.col("node_children") > MAX_CHILDREN) & (F.col("pages") < F.lit(RARE_SHARE) * F.col("node_pages"))
    rest, rest_bad = kind_weight - F.col("weight"), kind_bad - F.col("bad")
    pooled = F.try_divide(kind_bad, kind_weight)
    one = F.lit(1.0)
    spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(one, F.col("weight")) + F.try_divide(one, rest)))
    gap = F.abs(F.try_divide(F.col("bad"), F.col("weight")) - F.try_divide(rest_bad, rest))
    similar = F.when(rest > 0, (gap == 0) | (gap < F.lit(DEVIATE) * spread)).otherwise(F.lit(False))
    wildcard = F.when(F.col("is_bad"), "*!").otherwise("*")
    named = F.when((F.col(own) != "") & (rare | similar), wildcard).otherwise(F.col(own))
    chosen = with_node.select(*parent, own, "n_leaves", named.alias(f"t{level}"))
    return materialise(split_join(leaves, chosen, [*parent, own], "n_leaves", ["host", *(f"s{k}" for k in range(1, DEPTH + 1))], n_leaves), "url-leaves")


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, label: Column | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, template, labelled, bad_share.

    ``label`` is 1 for a page known as bad, 0 for a good one, else null.  By default a
    rule's verdict is its pages' label, and bad words label the pages that no rule fits.
    A page without a label is weak evidence for good: ``UNLABELLED_WEIGHT`` of a labelled
    one, so a few bad pages among very many do not condemn the rest.  The verdict is the
    rule's, else the template's: its smoothed share of bad evidence against one half.

    A null url, or one without ``://``, has an empty host and path and shares one
    template with the others of its kind.  Repeated rows and null ids are rows like any
    other; an empty table gives an empty result; other columns are not looked at.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), *([] if label is None else [label.cast("int").alias("given")]))
    host, path = F.col("host"), F.col("path")
    verdict = first_fit(host, path, rules, lambda v, r: v)
    usual = F.when(verdict.isNotNull(), (verdict == "block").cast("int")).when(bad_words(host, path), F.lit(1))
    rows = rows.select(
        "page_id",
        "host",
        "path",
        first_fit(host, path, rules, lambda v, r: r).alias("rule"),
        verdict.alias("by_rule"),
        (usual if label is None else F.col("given")).alias("label"),
        *(s.alias(f"s{k}") for k, s in enumerate(segments(path), 1)),
    )
    keys = ["host", *(f"s{k}" for k in range(1, DEPTH + 1))]
    n_pages, n_labelled, n_bad = F.count(F.lit(1)), F.count("label"), F.coalesce(F.sum("label"), F.lit(0))
    weight = PARTS * n_labelled + (n_pages - n_labelled) * F.lit(UNLABELLED_PARTS)
    leaves = rows.groupBy(*keys).agg(n_pages.alias("pages"), n_labelled.alias("labelled"), weight.alias("weight"), (PARTS * n_bad).alias("bad"))
    leaves = materialise(leaves, "url-leaves")
    n_leaves = leaves.count()
    for level in range(1, DEPTH + 1):
        leaves = generalise(leaves, level, n_leaves)
    whole = ["host", *(f"t{k}" for k in range(1, DEPTH + 1))]
    templates = leaves.groupBy(*whole).agg(*(F.sum(c).alias(f"of_{c}") for c in ("labelled", "weight", "bad")), F.count(F.lit(1)).alias("n_leaves"))
    share = (F.col("of_bad") + F.lit(PRIOR_BAD * PRIOR_PAGES * PARTS)) / (F.col("of_weight") + F.lit(PRIOR_PAGES * PARTS))
    template = F.concat(F.lit("/"), F.array_join(F.filter(F.array(*whole[1:]), lambda x: x != ""), "/"))
    templates = templates.select(*whole, "n_leaves", template.alias("template"), F.col("of_labelled"), F.round(share, 9).alias("bad_share"))
    judged = split_join(leaves, templates, whole, "n_leaves", keys, n_leaves)
    judged = materialise(judged.select(*keys, "pages", "template", F.col("of_labelled").alias("labelled"), "bad_share"), "url-judged")
    return split_join(rows, judged, keys, "pages", ["page_id", "path"], n_leaves).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("by_rule", F.when(F.col("bad_share") > REJECT_ABOVE, "block").otherwise("allow")).alias("verdict"),
        "template",
        "labelled",
        "bad_share",
    )


def oracle() -> str:
    """The same in SQL, over the view ``pages``."""

    def cases(value) -> str:
        out = "NULL"
        for verdict, rule in sorted(RULES, key=lambda r: (len(r[1]), r[1])):
            of_host, slash, of_path = rule.partition("/")
            out = f"CASE WHEN (host = '{of_host}' OR ends_with(host, '.{of_host}')) AND starts_with(path, '{slash}{of_path}') THEN '{value(verdict, rule)}' ELSE {out} END"
        return out

    words = "|".join(BAD_WORDS)
    sql = rf"""
        WITH u AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
                   coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        v AS (SELECT *, {cases(lambda v, r: r)} AS rule, {cases(lambda v, r: v)} AS by_rule,
                     list_filter(string_split(regexp_replace(path, '[0-9]+', '*', 'g'), '/'), lambda x: x <> '') AS parts FROM u),
        r AS (
            SELECT page_id, host, path, rule, by_rule,
                   CASE WHEN by_rule IS NOT NULL THEN (by_rule = 'block')::INT
                        WHEN regexp_matches(host || ' ' || lower(path), '(^|[^a-z])({words})(s|es|ing)?([^a-z]|$)') THEN 1 END AS label,
                   coalesce(parts[1], '') AS s1, coalesce(parts[2], '') AS s2, array_to_string(parts[3:], '/') AS s3
            FROM v),
        l0 AS (
            SELECT host, s1, s2, s3, count(*) AS pages, count(label) AS labelled,
                   {PARTS} * count(label) + {UNLABELLED_PARTS} * (count(*) - count(label)) AS weight, {PARTS} * coalesce(sum(label), 0) AS bad
            FROM r GROUP BY ALL)"""
    for k in range(1, DEPTH + 1):
        parent = ", ".join(["host", *(f"t{j}" for j in range(1, k))])
        sql += f""",
        c{k} AS (SELECT *, 2 * b > w AS k FROM (SELECT {parent}, s{k}, sum(pages) AS p, sum(weight) AS w, sum(bad) AS b FROM l{k - 1} GROUP BY ALL)),
        n{k} AS (SELECT *, count(*) OVER node AS nc, sum(p) OVER node AS np, sum(w) OVER kind AS kw, sum(b) OVER kind AS kb
                 FROM c{k} WINDOW node AS (PARTITION BY {parent}), kind AS (PARTITION BY {parent}, k)),
        g{k} AS (
            SELECT {parent}, s{k}, CASE WHEN s{k} <> '' AND ((nc > {MAX_CHILDREN} AND p < {RARE_SHARE}::DOUBLE * np)
                OR (kw - w > 0 AND (abs(b / w - (kb - b) / (kw - w)) = 0 OR
                    abs(b / w - (kb - b) / (kw - w)) < {DEVIATE}::DOUBLE * sqrt(kb / kw * (1 - kb / kw) * (1 / w + 1 / (kw - w))))))
                THEN CASE WHEN k THEN '*!' ELSE '*' END ELSE s{k} END AS t{k}
            FROM n{k}),
        l{k} AS (SELECT * FROM l{k - 1} JOIN g{k} USING ({parent}, s{k}))"""
    return sql + f""",
        t AS (SELECT host, t1, t2, t3, sum(labelled) AS ol, sum(weight) AS ow, sum(bad) AS ob FROM l3 GROUP BY ALL),
        j AS (
            SELECT host, s1, s2, s3, '/' || array_to_string(list_filter([t1, t2, t3], lambda x: x <> ''), '/') AS template, ol AS labelled,
                   round((ob + {PRIOR_BAD * PRIOR_PAGES * PARTS}::DOUBLE) / (ow + {PRIOR_PAGES * PARTS}::DOUBLE), 9) AS bad_share
            FROM l3 JOIN t USING (host, t1, t2, t3))
        SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN bad_share > {REJECT_ABOVE} THEN 'block' ELSE 'allow' END) AS verdict,
               template, labelled, bad_share
        FROM r JOIN j USING (host, s1, s2, s3)"""
