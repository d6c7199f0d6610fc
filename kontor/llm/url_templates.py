"""URL filtering by path-template trees (operator 4).

Given rules decide first. For every other URL, the tree of its host does. Paths become shapes (runs of digits and long
hexadecimal strings are variable by form); level by level, a node with many children gives up its rare ones for a
wildcard. Labelled templates under one parent, by ascending rate, join the branch before them unless their rates differ
by more than chance would make the pooled ones. Templates without labels join the branch of their siblings where there is
only one, and are a branch of their own otherwise, so that they never tie branches together. A branch's purity is its
labelled rate of bad pages, smoothed by the whole table's rate; a template is rejected when its branch has LEAST labels
or more and its purity reaches LIMIT.

Scale: pages are combined to one row for each host and shape, in the map first, so that a host with a third of all pages
is as many rows as it has shapes. The tree grows over that table by joins on (host, prefix), one round for each level
that has crowded nodes, however deep, through written tables whose joins adaptive execution can split. Siblings are at
most CHILDREN once a level is done, and so is each list of them.

Defined results: a null url, or one without ://, has an empty host and path; hosts without labels reject
nothing; repeated rows are judged each and count as often as they occur; null keys are judged like any
other; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.llm import scratch

#: (verdict, host and path): a rule fits its host and all subdomains where the path starts with its path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: A node with more children gives up those below this share of its pages.
CHILDREN, SHARE = 32, 0.05
#: Weight of the prior, standard errors within which branches merge, and the purity at which a branch is rejected.
PRIOR, ERRORS, LIMIT = 4.0, 1.96, 0.5
#: Labels that a branch must have to be rejected.
LEAST = 5
WILDCARD = "*"


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, i), F.lit("")) for i in (1, 2))
    return F.translate(host, ascii_uppercase, ascii_lowercase), path


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    """The segments of a path, variable ones by form replaced; a slash at the end stays with its segment."""
    parts = F.split(F.regexp_replace(F.substring(path, 2, 1 << 30), r"(?<=[^/])/\z", "\u0001"), "/", -1)
    return F.transform(parts, lambda s: F.translate(F.regexp_replace(F.regexp_replace(s, r"\b[0-9A-Fa-f-]{16,}\b", "%"), "[0-9]+", "#"), "\u0001", "/"))


def _prefix(level: int | Column) -> Column:
    return F.xxhash64(F.slice("template", F.lit(1), F.lit(level)))


def _children(found: DataFrame, first: int) -> DataFrame:
    """(host, level, prefix, child, pages) of the levels from `first`."""
    levels = F.when(F.size("template") > first, F.sequence(F.lit(first), F.size("template") - 1))
    rows = found.select("host", "template", "pages", F.explode(levels).alias("level"))
    rows = rows.select("host", "level", _prefix(F.col("level")).alias("prefix"), F.get("template", F.col("level")).alias("child"), "pages")
    return rows.groupBy("host", "level", "prefix", "child").agg(F.sum("pages").alias("pages"))


def templates(shapes: DataFrame) -> DataFrame:
    """(host, shape, pages, labelled, bad) with `template`: the shape with wildcards for variable children."""
    found, level = scratch.written(shapes.withColumn("template", F.col("shape")), "shapes"), 0
    while True:
        children = scratch.written(_children(found, level), "children")
        many = children.groupBy("host", "level", "prefix").agg(F.count("*").alias("n"), F.sum("pages").alias("of")).where(F.col("n") > CHILDREN)
        many = scratch.written(many, "nodes")
        # Wildcards of a level change what the levels below it hold: the uppermost one comes first.
        if (level := many.agg(F.min("level")).first()[0]) is None:
            return found
        rare = children.join(many.where(F.col("level") == level), ["host", "level", "prefix"]).where((F.col("pages") < SHARE * F.col("of")) & (F.col("child") != WILDCARD))
        rare = rare.select("host", "prefix", "child", F.lit(True).alias("rare"))
        rows = found.withColumn("prefix", _prefix(level)).withColumn("child", F.get("template", F.lit(level))).join(rare, ["host", "prefix", "child"], "left")
        wild = F.transform("template", lambda s, i: F.when((i == level) & F.col("rare"), F.lit(WILDCARD)).otherwise(s))
        found = scratch.written(rows.withColumn("template", wild).drop("prefix", "child", "rare"), "shapes")
        level += 1


_BRANCH = "struct<labelled: bigint, bad: bigint, members: array<array<string>>>"


def _merged(prior: float) -> Column:
    """Of `known`, the labelled siblings by ascending rate (rate, template, labelled, bad): branches (labelled, bad, members)."""

    def rate(x: Column) -> Column:
        return (x["bad"] + F.lit(PRIOR * prior)) / (x["labelled"] + F.lit(PRIOR))

    def alone(x: Column) -> Column:
        return F.struct(x["labelled"].alias("labelled"), x["bad"].alias("bad"), F.array(x["template"]).alias("members"))

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        w, v = x["labelled"] + F.lit(PRIOR), last["labelled"] + F.lit(PRIOR)
        pooled = (rate(x) * w + rate(last) * v) / (w + v)
        apart = rate(x) - rate(last) > ERRORS * F.sqrt(pooled * (1 - pooled) * (1 / w + 1 / v))
        both = F.struct((last["labelled"] + x["labelled"]).alias("labelled"), (last["bad"] + x["bad"]).alias("bad"), F.concat(last["members"], F.array(x["template"])).alias("members"))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(both))
        return F.when((F.size(done) == 0) | F.coalesce(apart, F.lit(True)), F.concat(done, F.array(alone(x)))).otherwise(joined)

    return F.aggregate("known", F.array().cast(f"array<{_BRANCH}>"), step)


def branches(found: DataFrame) -> DataFrame:
    """(host, template, branch, purity, known): sibling templates with their merged branch (0: no labels, more than one branch) and its labels."""
    rows = found.groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in ("pages", "labelled", "bad")))
    rows = scratch.written(rows.withColumn("parent", F.slice("template", F.lit(1), F.greatest(F.size("template") - 1, F.lit(0)))), "templates")
    whole = rows.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("labelled"), F.lit(0)).alias("labelled")).first()
    prior = (whole["bad"] + 1) / (whole["labelled"] + 2)
    rate = (F.col("bad") + F.lit(PRIOR * prior)) / (F.col("labelled") + F.lit(PRIOR))
    labelled = F.when(F.col("labelled") > 0, F.struct(rate.alias("rate"), "template", "labelled", "bad"))
    siblings = rows.groupBy("host", "parent").agg(F.sort_array(F.collect_list(labelled)).alias("known"), F.collect_list(F.when(F.col("labelled") == 0, F.col("template"))).alias("unknown"))
    siblings = siblings.withColumn("merged", _merged(prior))
    one, nothing = F.get("merged", F.lit(0)), F.lit(0).cast("long")
    joined = F.struct(one["labelled"].alias("labelled"), one["bad"].alias("bad"), F.concat(one["members"], F.col("unknown")).alias("members"))
    apart = F.struct(nothing.alias("labelled"), nothing.alias("bad"), F.col("unknown").alias("members"))
    every = F.when(F.size("merged") == 1, F.array(F.lit(None).cast(_BRANCH), joined.cast(_BRANCH))).otherwise(F.concat(F.array(apart.cast(_BRANCH)), F.col("merged")))
    found = siblings.select("host", F.posexplode(every).alias("branch", "own")).where("own IS NOT NULL")
    purity = (F.col("own.bad") + F.lit(PRIOR * prior)) / (F.col("own.labelled") + F.lit(PRIOR))
    return found.select("host", F.explode("own.members").alias("template"), "branch", purity.alias("purity"), F.col("own.labelled").alias("known"))


def judged(pages: DataFrame, labels: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, label_key: str | None = None) -> DataFrame:
    """Every page with host, path, rule, verdict and template. labels: (label_key, bad boolean); label_key is a column of (key, host, path) or an expression over them."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    rule, said = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("said", said).withColumn("shape", shape(F.col("path")))
    known = labels.select(F.col(labels.columns[0]).alias("_label"), F.col(labels.columns[1]).alias("_bad")).where("_label IS NOT NULL AND _bad IS NOT NULL")
    known = known.groupBy("_label").agg(F.max("_bad").alias("_bad"))
    marked = rows.withColumn("_label", F.expr(label_key or "key")).where("_label IS NOT NULL").join(known, "_label")
    zero = F.lit(0).cast("long")
    counted = rows.select("host", "shape", F.lit(1).cast("long").alias("pages"), zero.alias("labelled"), zero.alias("bad")).union(
        marked.select("host", "shape", zero, F.lit(1).cast("long"), F.col("_bad").cast("long"))
    )
    found = templates(counted.groupBy("host", "shape").agg(*(F.sum(c).alias(c) for c in ("pages", "labelled", "bad"))))
    verdicts = found.select("host", "shape", "template").join(branches(found), ["host", "template"])
    verdicts = scratch.written(verdicts.select("host", "shape", "template", "purity", "known"), "verdicts")
    own = F.when((F.col("purity") >= LIMIT) & (F.col("known") >= LEAST), "block").otherwise("allow")
    return rows.join(verdicts, ["host", "shape"], "left").select(
        F.col("key").alias(key), "host", "path", "rule", F.coalesce("said", own).alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity"
    )


def op4_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document whose number its path names: bad if of low quality or toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    number = "try_cast(nullif(regexp_extract(path, '^/[^/]+/([0-9]+)', 1), '') AS BIGINT)"
    found = judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), labels, label_key=number)
    return found.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


#: Levels of the tree in the SQL, which cannot loop: more than the paths of `pages` have.
SQL_LEVELS = 6


def _level_sql(level: int) -> str:
    """The steps of one level of the tree: t{level} becomes t{level + 1}."""
    prefix = f"template[1:{level}]"
    return f"""
children{level} AS (SELECT host, {prefix} AS prefix, template[{level + 1}] AS child, sum(pages) AS pages FROM t{level} WHERE len(template) > {level} GROUP BY ALL),
nodes{level} AS (SELECT host, prefix, sum(pages) AS whole FROM children{level} GROUP BY host, prefix HAVING count(*) > {CHILDREN}),
rare{level} AS (SELECT c.host, c.prefix, c.child FROM children{level} c JOIN nodes{level} n ON c.host = n.host AND c.prefix = n.prefix WHERE c.pages < CAST({SHARE} AS DOUBLE) * n.whole AND c.child <> '{WILDCARD}'),
t{level + 1} AS (
  SELECT t.host, t.shape, t.pages, t.labelled, t.bad, CASE WHEN r.child IS NULL THEN t.template ELSE list_concat(list_concat(t.template[1:{level}], ['{WILDCARD}']), t.template[{level + 2}:]) END AS template
  FROM (SELECT *, {prefix} AS prefix, template[{level + 1}] AS child FROM t{level}) t LEFT JOIN rare{level} r ON t.host = r.host AND t.prefix = r.prefix AND t.child = r.child),"""


def _rule_sql(answer: int) -> str:
    fits = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}')"
    return "CASE " + " ".join(f"WHEN {fits.format(*rule[1].split('/', 1))} THEN '{rule[answer]}'" for rule in sorted(RULES, key=lambda r: -len(r[1]))) + " END"


OP4_SQL = rf"""
WITH RECURSIVE parsed AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{ascii_uppercase}', '{ascii_lowercase}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), parts AS (
  SELECT *, {_rule_sql(1)} AS rule, {_rule_sql(0)} AS said, string_split(regexp_replace(substr(path, 2), '([^/])/$', '\1' || chr(1)), '/') AS p,
         TRY_CAST(nullif(regexp_extract(path, '^/[^/]+/([0-9]+)', 1), '') AS BIGINT) AS number
  FROM parsed
), shaped AS (
  SELECT page_id, host, path, rule, said, number,
         list_transform(p, lambda s: replace(regexp_replace(regexp_replace(s, '\b[0-9A-Fa-f-]{{16,}}\b', '%', 'g'), '[0-9]+', '#', 'g'), chr(1), '/')) AS shape
  FROM parts
), known AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id
), t0 AS (
  SELECT s.host, s.shape, count(*) AS pages, count(k.doc_id) AS labelled, coalesce(sum(k.bad), 0) AS bad, s.shape AS template
  FROM shaped s LEFT JOIN known k ON k.doc_id = s.number GROUP BY s.host, s.shape
), {"".join(map(_level_sql, range(SQL_LEVELS)))}
templates AS (
  SELECT host, template, sum(labelled) AS labelled, sum(bad) AS bad, template[1:len(template) - 1] AS parent FROM t{SQL_LEVELS} GROUP BY host, template
), whole AS (
  SELECT CAST(coalesce(sum(bad), 0) + 1 AS DOUBLE) / CAST(coalesce(sum(labelled), 0) + 2 AS DOUBLE) AS prior FROM templates
), ordered AS (
  SELECT t.*, prior, row_number() OVER (PARTITION BY host, parent ORDER BY (CAST(bad AS DOUBLE) + CAST({PRIOR} AS DOUBLE) * prior) / (CAST(labelled AS DOUBLE) + CAST({PRIOR} AS DOUBLE)), template) AS n
  FROM templates t, whole WHERE labelled > 0
), folded AS (
  SELECT host, parent, template, n, CAST(1 AS BIGINT) AS branch, CAST(labelled AS DOUBLE) AS in_branch, CAST(bad AS DOUBLE) AS bad_in_branch FROM ordered WHERE n = 1
  UNION ALL
  SELECT host, parent, template, n, branch + apart, labelled + CASE WHEN apart = 1 THEN 0 ELSE in_branch END, bad + CASE WHEN apart = 1 THEN 0 ELSE bad_in_branch END
  FROM (
    SELECT *, CASE WHEN rate - last_rate > CAST({ERRORS} AS DOUBLE) * sqrt((rate * w + last_rate * v) / (w + v) * (1 - (rate * w + last_rate * v) / (w + v)) * (1 / w + 1 / v)) THEN 1 ELSE 0 END AS apart
    FROM (
      SELECT o.host, o.parent, o.template, o.n, f.branch, f.in_branch, f.bad_in_branch, CAST(o.labelled AS DOUBLE) AS labelled, CAST(o.bad AS DOUBLE) AS bad, o.labelled + CAST({PRIOR} AS DOUBLE) AS w, f.in_branch + CAST({PRIOR} AS DOUBLE) AS v,
             (o.bad + CAST({PRIOR} AS DOUBLE) * o.prior) / (o.labelled + CAST({PRIOR} AS DOUBLE)) AS rate, (f.bad_in_branch + CAST({PRIOR} AS DOUBLE) * o.prior) / (f.in_branch + CAST({PRIOR} AS DOUBLE)) AS last_rate
      FROM folded f JOIN ordered o ON o.host = f.host AND o.parent = f.parent AND o.n = f.n + 1
    )
  )
), named AS (
  SELECT t.host, t.parent, t.template, t.labelled, t.bad, coalesce(f.branch, CASE WHEN b.most = 1 THEN 1 ELSE 0 END) AS branch
  FROM templates t LEFT JOIN folded f ON f.host = t.host AND f.template = t.template LEFT JOIN (SELECT host, parent, max(branch) AS most FROM folded GROUP BY host, parent) b ON b.host = t.host AND b.parent = t.parent
), judged AS (
  SELECT host, template, sum(labelled) OVER (PARTITION BY host, parent, branch) AS known,
         (CAST(sum(bad) OVER (PARTITION BY host, parent, branch) AS DOUBLE) + CAST({PRIOR} AS DOUBLE) * prior) / (CAST(sum(labelled) OVER (PARTITION BY host, parent, branch) AS DOUBLE) + CAST({PRIOR} AS DOUBLE)) AS purity
  FROM named, whole
)
SELECT s.page_id, s.host, s.path, s.rule, coalesce(s.said, CASE WHEN j.purity >= {LIMIT} AND j.known >= {LEAST} THEN 'block' ELSE 'allow' END) AS verdict, '/' || array_to_string(t.template, '/') AS template, j.purity
FROM shaped s JOIN t{SQL_LEVELS} t ON t.host = s.host AND t.shape = s.shape JOIN judged j ON j.host = t.host AND j.template = t.template
"""
