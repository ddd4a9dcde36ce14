"""URL filters: fixed rules first, then a path-template tree per host.

Rules are ``host/path-prefix``; a rule fits its host and all subdomains if the
url's path starts with its path, and the longest that fits decides.

Other urls are judged by templates. Level by level, to the end of the longest
path, the segments below a node of a host's tree are counted. A node with many
different segments that hardly recur is variable: its segments become ``*``. Of
the others, those whose labelled share of bad pages does not differ from their
siblings' pooled share (a two-proportion test at Z) are merged into ``*`` too, and
those that differ stay branches. A template is rejected when its share of bad
pages, smoothed by PRIOR pages of the corpus's share, is REJECT or more; without
labels that is never so.

The test's value is at most the root of the labelled pages, and nothing where all
are good or all bad. So a node with fewer than Z * Z labelled pages, or of one
kind, has wildcards only from there on, and is finished at once. A node with one
branch goes on where its paths part. Rounds so grow with the branchings that
labels can tell, not with the length of paths.

All work is on distinct (host, path) with partial sums; a host with a third of
all rows is dealt by its paths, and joins split on skew.

A null url, or one without ``://``, has an empty host and path and is allowed
unless a rule says otherwise. Repeated rows are judged each. Null labels and
labels of other documents count for nothing. Empty segments are skipped, and urls
and paths may be of any length. An empty table gives an empty result. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import shared_table

WIDE, RECUR = 20, 3.0
Z = 1.96
PRIOR = 10.0
REJECT = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null. Rules are kept by host, so each of a host's suffixes is one lookup."""
    by_host: dict[str, list[str]] = {}
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        by_host.setdefault(rule.partition("/")[0], []).append(rule)
    if not by_host:
        return F.lit(None).cast("string")
    known = F.create_map(*[x for h, own in by_host.items() for x in (F.lit(h), F.array(*map(F.lit, own)))])
    labels = F.split(host, "\\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.flatten(F.transform(suffixes, lambda s: F.filter(F.coalesce(F.try_element_at(known, s), F.array().cast("array<string>")), lambda r: path.startswith(F.substr(r, F.length(s) + 1)))))
    return F.get(F.array_sort(fitting, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0)), 0)


def _shared_start(a: Column, b: Column) -> Column:
    """How many segments two paths have in common from their start."""
    parted = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False))
    return F.when(parted > 0, parted - 1).otherwise(F.size(a)).cast("int")


def path_templates(paths: DataFrame) -> DataFrame:
    """host, path, template for (host, path, n, labelled, bad): one row per distinct host and path."""
    segments = F.filter(F.split("path", "/", -1), lambda s: s != "")
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
    columns = "host", "path", "n", "labelled", "bad"
    now = shared_table(paths.select(*columns, segments.alias("segments"), F.lit("").alias("template"), F.lit(0).alias("level")))
    done = []
    while True:
        nodes = now.where("size(segments) > level").groupBy("host", "template").agg(F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
        told = shared_table(nodes.where(f"all_labelled >= {Z * Z} and all_bad > 0 and all_bad < all_labelled").select("host", "template", F.lit(True).alias("told")))
        marked = now.join(told, ["host", "template"], "left").withColumn("told", F.col("told").isNotNull() & (F.size("segments") > F.col("level")))
        done.append(marked.where("not told").select(*columns, F.concat("template", F.repeat(F.lit("/*"), F.size("segments") - F.col("level"))).alias("template")))
        if not told.take(1):
            break
        live = shared_table(marked.where("told").drop("told").withColumn("segment", F.get("segments", F.col("level"))))
        branches = shared_table(live.groupBy("host", "template", "segment").agg(*sums, F.min("segments").alias("low"), F.max("segments").alias("high")))
        nodes = branches.groupBy("host", "template").agg(
            F.count("*").alias("width"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "bad")], _shared_start(F.min("low"), F.max("high")).alias("shared")
        )
        nodes = shared_table(nodes)
        variable = (F.col("width") >= WIDE) & (F.col("all_n") < RECUR * F.col("width"))
        others, other_bad = F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
        pooled = F.try_divide("all_bad", "all_labelled")
        error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), "labelled") + F.try_divide(F.lit(1.0), others)))
        z = F.abs(F.try_divide("bad", "labelled") - F.try_divide(other_bad, others)) / F.nullif(error, F.lit(0.0))
        # Only branches that keep their name are looked up; all others are the wildcard.
        kept = shared_table(branches.join(nodes.drop("shared"), ["host", "template"]).where(~variable & (z >= Z)).select("host", "template", "segment", F.col("segment").alias("name")))
        lone = shared_table(nodes.where("width = 1").select("host", "template", "shared"))
        name = F.concat(F.lit("/"), F.coalesce("name", F.lit("*")))
        now = shared_table(
            live.join(kept, ["host", "template", "segment"], "left")
            .join(lone, ["host", "template"], "left")
            .select(
                *columns,
                "segments",
                F.concat("template", F.when(F.col("shared").isNull(), name).otherwise(F.repeat(F.lit("/*"), F.col("shared") - F.col("level")))).alias("template"),
                F.coalesce("shared", F.col("level") + 1).alias("level"),
            )
        )
    return reduce(DataFrame.unionByName, done)


def judged(pages: DataFrame, labels: DataFrame, rules: dict[str, str]) -> DataFrame:
    """page_id, host, path, rule, verdict, template, bad_share; ``labels`` has doc_id (the number that ends a path) and bad."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    number = F.expr("try_cast(nullif(regexp_extract(path, '([0-9]+)[^0-9/]*/?$', 1), '') as bigint)")
    marks = labels.where("doc_id is not null and bad is not null").groupBy(F.col("doc_id").alias("number")).agg(F.max(F.col("bad").cast("long")).alias("bad"))
    distinct = urls.groupBy("host", "path").agg(F.count("*").alias("n")).withColumn("number", number)
    paths = distinct.join(marks, "number", "left").select("host", "path", "n", F.col("bad").isNotNull().cast("long").alias("labelled"), F.coalesce("bad", F.lit(0)).cast("long").alias("bad"))
    named = shared_table(path_templates(paths))
    total = named.agg(F.sum("bad"), F.sum("labelled")).first()
    share = (total[0] / total[1]) if total[1] else 0.0
    purity = (F.sum("bad") + F.lit(PRIOR * share)) / (F.sum("labelled") + F.lit(PRIOR))
    templates = shared_table(named.groupBy("host", "template").agg(purity.alias("bad_share")))
    shares = shared_table(named.join(templates, ["host", "template"]).select("host", "path", "template", "bad_share"))
    rule = rule_for(F.col("host"), F.col("path"), rules)
    verdicts = reduce(lambda c, r: c.when(F.col("rule") == r, F.lit(rules[r])), rules, F.when(F.lit(False), F.lit("")))
    by_tree = F.when(F.col("bad_share") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))
    return urls.join(shares, ["host", "path"]).withColumn("rule", rule).select("page_id", "host", "path", "rule", F.coalesce(verdicts, by_tree).alias("verdict"), "template", "bad_share")
