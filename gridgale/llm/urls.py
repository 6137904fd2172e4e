"""URL filter: fixed rules first, then a path-template tree per host judged by labelled purity.

1. A rule (host, path, verdict) fits its host and all subdomains when the path starts with the rule's;
   the longest rule wins.
2. For the rest, paths become shapes (runs of digits are one variable), and equal shapes of a host one row
   with its labelled pages and how many of these are good. Level by level, a branch keeps its own name only
   where it is the single child or its share of good pages differs from its siblings' by more than ``Z``
   standard errors; all similar branches merge into the wildcard ``*``. A branch that holds one shape is a
   template at once, so the levels are as many as the longest way that two shapes of a host share, and one more.
3. A template's purity is shrunk to its host's and that to the global share (``PULL`` pseudo-pages each);
   templates below ``PURE`` are blocked.

A page's label is the one of the document whose number ends its path. Everything is DataFrame work on
urls alone; pages meet their host only in sums, so a hot host costs one row per shape and task.

Defined cases: a null url, or one without ``://``, has an empty host and path and is judged by the
template of that; labels that are null don't count, repeated ones count as bad if one is; without labels
all templates have purity 1; rows without ``page_id`` and repeated rows each get a row; extra columns are
ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridgale.llm.common import staged, table

RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)
Z, MIN_LABELS, PULL, PURE = 3, 5, 10, 0.5


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest) + 1), "^[^?#]*", 0)
    return (
        F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit("")),
        F.coalesce(path, F.lit("")),
    )


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return name, verdict


def labelled_documents(labels: DataFrame) -> DataFrame:
    good = (F.coalesce(F.min("quality"), F.lit(1)) >= 1) & (F.coalesce(F.max("toxic"), F.lit(0)) < 1)
    return labels.where("quality IS NOT NULL OR toxic IS NOT NULL").groupBy(
        F.col("doc_id").alias("number")
    ).agg(good.cast("long").alias("good"))


def _level(shapes: DataFrame, level: int) -> DataFrame:
    """Extend each shape's template by its next segment or by the wildcard that it merges into."""
    here = shapes.withColumn("_seg", F.get("segs", F.lit(level)))
    nodes = here.where("_seg IS NOT NULL").groupBy("host", "template", "_seg").agg(
        F.sum("labelled").alias("n"), F.sum("good").alias("g"), F.count("*").alias("shapes")
    )
    parents = nodes.groupBy("host", "template").agg(
        F.count("*").alias("children"), F.sum("n").alias("all_n"), F.sum("g").alias("all_g")
    )
    n, g = F.col("n").cast("double"), F.col("g").cast("double")
    rest_n, rest_g = F.col("all_n") - n, F.col("all_g") - g
    # Two shares differ by more than Z standard errors of their common share, without a division.
    apart = (g * rest_n - rest_g * n) * (g * rest_n - rest_g * n) * F.col("all_n") > (
        Z * Z * F.col("all_g") * (F.col("all_n") - F.col("all_g")) * n * rest_n
    )
    own = (F.col("children") == 1) | ((n >= MIN_LABELS) & (rest_n >= MIN_LABELS) & apart)
    names = nodes.join(parents, ["host", "template"]).select(
        "host", "template", "_seg", F.when(own, F.col("_seg")).otherwise("*").alias("_name"),
        (own & (F.col("shapes") == 1)).alias("_alone"),
    )
    joined = here.join(names, ["host", "template", "_seg"], "left")
    rest = F.array_join(F.slice("segs", level + 1, F.greatest(F.size("segs") - level, F.lit(0))), "/")
    name = F.when(F.col("_alone"), rest).otherwise(F.col("_name"))
    return joined.select(
        "host", "shape", "labelled", "good", F.when(F.col("_alone"), F.array().cast("array<string>")).otherwise(F.col("segs")).alias("segs"),
        F.when(F.col("_name").isNull(), F.col("template")).otherwise(F.concat_ws("/", "template", name)).alias("template"),
    )


def templates(seen: DataFrame, documents: DataFrame) -> DataFrame:
    """(host, shape, template, purity) from pages' (host, shape, number) and documents' (number, good)."""
    met = seen.join(documents, "number", "left")
    shapes = staged(
        met.groupBy("host", "shape").agg(
            F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")
        ).withColumns({
            "segs": F.array_remove(F.split("shape", "/"), ""), "template": F.lit(""),
        }), "shapes",
    )
    row = shapes.agg(F.max(F.size("segs")), F.sum("labelled"), F.sum("good")).first()
    overall = row[2] / row[1] if row[1] else 1.0
    deepest, level = row[0] or 0, 0
    while level < deepest:
        shapes = staged(_level(shapes, level), "shapes")
        deepest, level = shapes.agg(F.max(F.size("segs"))).first()[0], level + 1

    def pulled(to: Column) -> Column:
        return (F.col("g") + PULL * to) / (F.col("n") + PULL)

    sums = shapes.groupBy("host", "template").agg(F.sum("labelled").alias("n"), F.sum("good").alias("g"))
    hosts = sums.groupBy("host").agg(F.sum("n").alias("n"), F.sum("g").alias("g")).select(
        "host", pulled(F.lit(float(overall))).alias("_host_purity")
    )
    judged = sums.join(hosts, "host").select("host", "template", pulled(F.col("_host_purity")).alias("purity"))
    return shapes.select("host", "shape", "template").join(judged, ["host", "template"])


def judged(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity), one row per row of ``pages``."""
    host, path = split_url(F.col("url"))
    own = pages.select("page_id", host.alias("host"), path.alias("path")).withColumns({
        "shape": F.regexp_replace("path", "[0-9]+", "{n}"),
        "number": F.expr("try_cast(regexp_extract(path, '/([0-9]{1,18})([.][a-z]+)?/?$', 1) AS bigint)"),
    })
    found = templates(own.select("host", "shape", "number"), labelled_documents(labels))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_template = F.when(F.col("purity") >= PURE, "allow").otherwise("block")
    return own.join(found, ["host", "shape"]).select(
        "page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, by_template).alias("verdict"),
        F.concat(F.col("host"), F.col("template")).alias("template"), F.round("purity", 9).alias("purity"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def _rule_sql() -> tuple[str, str]:
    name = verdict = ""
    for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1])):
        fits = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
        name += f" WHEN {fits} THEN '{h}{p}'"
        verdict += f" WHEN {fits} THEN '{v}'"
    return f"CASE{name} END", f"CASE{verdict} END"


_NAME, _VERDICT = _rule_sql()
SQL = rf"""
WITH RECURSIVE rests AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rests),
own AS (
  SELECT page_id, translate(raw, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
shaped AS (
  SELECT *, regexp_replace(path, '[0-9]+', '{{n}}', 'g') AS shape,
    TRY_CAST(regexp_extract(path, '/([0-9]{{1,18}})([.][a-z]+)?/?$', 1) AS BIGINT) AS number FROM own),
docs AS (
  SELECT doc_id AS number, CAST(coalesce(min(quality), 1) >= 1 AND coalesce(max(toxic), 0) < 1 AS BIGINT) AS good
  FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
shapes0 AS (
  SELECT host, shape, list_filter(string_split(shape, '/'), lambda x: x <> '') AS segs,
    count(good) AS labelled, coalesce(sum(good), 0) AS good, '' AS template
  FROM shaped LEFT JOIN docs USING (number) GROUP BY host, shape),
deepest AS (SELECT max(len(segs)) AS levels FROM shapes0),
walk AS (
  SELECT 0 AS level, host, shape, segs, labelled, good, template FROM shapes0
  UNION ALL
  SELECT level + 1, host, shape, segs, labelled, good, CASE WHEN seg IS NULL THEN template
    ELSE template || '/' || CASE WHEN children = 1 OR (n >= {MIN_LABELS} AND an - n >= {MIN_LABELS}
      AND (g * (an - n) - (ag - g) * n) * (g * (an - n) - (ag - g) * n) * an > {Z * Z} * ag * (an - ag) * n * (an - n))
      THEN seg ELSE '*' END END
  FROM (
    SELECT *, CAST(sum(labelled) OVER s AS DOUBLE) AS n, CAST(sum(good) OVER s AS DOUBLE) AS g,
      CAST(sum(labelled) FILTER (seg IS NOT NULL) OVER p AS DOUBLE) AS an,
      CAST(sum(good) FILTER (seg IS NOT NULL) OVER p AS DOUBLE) AS ag, count(DISTINCT seg) OVER p AS children
    FROM (SELECT walk.*, segs[level + 1] AS seg FROM walk, deepest WHERE level < levels)
    WINDOW s AS (PARTITION BY host, template, seg), p AS (PARTITION BY host, template))),
overall AS (SELECT CASE WHEN sum(labelled) > 0 THEN sum(good)::DOUBLE / sum(labelled) ELSE 1 END AS share FROM shapes0),
sums AS (SELECT host, template, sum(labelled) AS n, sum(good) AS g FROM walk, deepest WHERE level = levels GROUP BY ALL),
host_purity AS (
  SELECT host, (sum(g) + {PULL} * share) / (sum(n) + {PULL}) AS hp FROM sums, overall GROUP BY host, share),
purity AS (SELECT host, template, (g + {PULL} * hp) / (n + {PULL}) AS purity FROM sums JOIN host_purity USING (host))
SELECT page_id, host, path, {_NAME} AS rule,
  coalesce({_VERDICT}, CASE WHEN purity >= {PURE}::DOUBLE THEN 'allow' ELSE 'block' END) AS verdict,
  host || template AS template, round(purity, 9) AS purity
FROM shaped JOIN (SELECT host, shape, template FROM walk, deepest WHERE level = levels) USING (host, shape) JOIN purity USING (host, template)
"""
