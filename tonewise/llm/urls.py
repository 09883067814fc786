"""URL filters: host and path rules, and a path-template tree for the rest.

DataFrame functions only. A rule is a host with a path; it fits that host and
its subdomains where the path starts with the rule's, and the longest wins.
Urls that a rule judges are the labels of the method, which judges the others:

Per host a tree of path templates is grown, one segment a level. At a node a
segment that enough of its urls have stays as it is. Other segments are
generalised to their shape (digits to ``#``) where enough urls have that, else
to ``*``. Sibling segments whose shares of blocked and of allowed urls don't
differ significantly (two-proportion tests at ``Z``) are merged into one branch.
A leaf is a template; its purity is the smoothed share of blocked among its
labelled urls, (blocked + strength * prior) / (labelled + strength), and a
purity of ``reject`` or more blocks it. A template without labels has the
prior, so it passes.

Levels are not taken one by one. Where the longest path of a node is the only
frequent branch for some levels, all of them are taken at once, as in a radix
tree: urls that end on it are done, urls that leave it get the token of the place
where they do. Then the node branches by an ordinary level: grouped counts and
joins; what it keeps of a node (at most 1 / ``share`` segments and shapes) is
small, and a host with a third of all urls is pre-aggregated and its join side
can be split. Of a node with fewer urls than ``least`` no segment can be frequent:
each of its remaining segments is ``*`` at once. So a round passes all levels up to
the next at which two segments are frequent, however deep; none is cut off. Two
traps side by side, with two frequent segments at each level, still take a round a
level.

Defined cases: a null url, or one without ``://``, has an empty host and path
and is judged as a host of its own. Empty segments are skipped. Repeated rows
count as often as they stand. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonewise.llm.common import discard, saved, shared_dir

#: (verdict, host, path) of the registered query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
Z = 1.96
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): see the contract of the rules."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def judged(rules, host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. Rules are a short list that the caller gives."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = F.endswith(F.concat(F.lit("."), host), F.lit("." + h)) & F.startswith(path, F.lit(p))
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _frequent(live: DataFrame, part: str, share: float, least: int) -> DataFrame:
    """(host, tpl, part, n, bad, good): what enough urls of a node have in ``part``."""
    counts = [F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good")]
    each = live.groupBy("host", "tpl", part).agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    total = each.groupBy("host", "tpl").agg(counts[0].alias("total"))
    return each.join(total, ["host", "tpl"]).where((F.col("n") >= least) & (F.col("n") >= share * F.col("total"))).drop("total")


def _differ(x: str) -> Column:
    """Whether the share of ``x`` differs significantly from that of the sibling before."""
    n0, k0 = F.col("before.n"), F.col(f"before.{x}")
    p = (F.col(x) + k0) / (F.col("n") + n0)
    gap = F.abs(F.col(x) / F.col("n") - k0 / n0)
    return gap > Z * F.sqrt(p * (1 - p) * (1 / F.col("n") + 1 / n0))


def _merged(literals: DataFrame) -> DataFrame:
    """(host, tpl, seg, token): frequent segments with the branch that they are merged into."""
    node = Window.partitionBy("host", "tpl")  # 1 / share rows at most
    order = node.orderBy(F.col("bad") / F.col("n"), F.col("good") / F.col("n"), "seg")
    rows = literals.withColumn("before", F.lag(F.struct("n", "bad", "good")).over(order))
    new = F.when(F.col("before").isNull(), True).otherwise(_differ("bad") | _differ("good"))
    rows = rows.withColumn("branch", F.sum(new.cast("int")).over(order))
    names = F.array_sort(F.collect_set("seg").over(Window.partitionBy("host", "tpl", "branch")))
    return rows.select("host", "tpl", "seg", F.array_join(names, "|").alias("token"))


NODE = ["host", "tpl"]


def _trunks(live: DataFrame, share: float, least: int, made: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(urls, ends): the urls of nodes of ``least`` or more, told by where they leave their node's longest path, and for each node the level up to which that path is its only branch.

    ``l`` is how many segments a url has in common with the longest path, ``seg``
    its next one (null: it ends), ``trunk`` the shape that the path has there.
    """
    longest = live.groupBy(*NODE).agg(F.count("*").alias("many"), F.max_by("segs", F.size("segs")).alias("path")).where(F.col("many") >= least)
    rows = live.join(longest.select(*NODE, "path"), NODE)
    other = F.array_position(F.zip_with("segs", "path", lambda x, y: x.eqNullSafe(y)), False)
    met = F.when(other == 0, F.size("segs")).otherwise(other - 1).cast("int")
    rows = rows.select("rid", *NODE, "bad", "good", "segs", "path", met.alias("l"))
    shape = lambda x: F.regexp_replace(x, "[0-9]+", "#")
    rows = rows.select("rid", *NODE, "bad", "good", "segs", "l", F.get("segs", F.col("l")).alias("seg"), shape(F.get("path", F.col("l"))).alias("trunk"))
    rows = saved(rows.withColumn("shape", shape(F.col("seg"))), "urls-met")
    groups = rows.groupBy(*NODE, "l", "seg").agg(F.count("*").alias("n"))
    off = F.col("seg").isNotNull()
    levels = groups.groupBy(*NODE, "l").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(off, F.col("n"))), F.lit(0)).alias("off"), F.coalesce(F.max(F.when(off, F.col("n"))), F.lit(0)).alias("most"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*NODE).orderBy("l").rowsBetween(1, Window.unboundedFollowing)), F.lit(0))  # a row a level
    levels = saved(levels.withColumn("on", below).withColumn("total", F.col("on") + F.col("off")), "urls-levels")
    enough = lambda n: (F.col(n) >= least) & (F.col(n) >= share * F.col("total"))
    ends = levels.where(~enough("on") | enough("most")).groupBy(*NODE).agg(F.min("l").alias("stop"))
    # Off the path a shape may be frequent, the path's own segment counted where it has the same.
    shapes = rows.where(off).groupBy(*NODE, "l", "shape").agg(F.count("*").alias("n"), F.any_value("trunk").alias("trunk"))
    shapes = shapes.join(levels.select(*NODE, "l", "on", "total"), [*NODE, "l"])
    shapes = shapes.withColumn("n", F.col("n") + F.when(F.col("shape") == F.col("trunk"), F.col("on")).otherwise(0))
    known = saved(shapes.where(enough("n")).select(*NODE, "l", "shape", F.lit(True).alias("known")), "urls-shapes")
    made += [rows, levels, known]
    rows = rows.join(ends, NODE).join(known, [*NODE, "l", "shape"], "left")
    return rows.withColumn("known", F.coalesce("known", F.lit(False))), ends


def _along(k: Column) -> Column:
    """The template of a url after ``k`` segments of its own as they stand."""
    return F.array_join(F.concat(F.array("tpl"), F.slice("segs", 1, k)), "/")


def templates(urls: DataFrame, share: float = 0.02, least: int = 5) -> DataFrame:
    """``urls`` (rid, host, path, bad, good) with their template ``tpl``, as a table made by ``saved``."""
    segs = F.filter(F.split("path", "/"), lambda s: s != "")
    live = saved(urls.select("rid", "host", "bad", "good", segs.alias("segs"), F.lit("").alias("tpl")), "urls-live")
    columns, done = ["rid", "host", "tpl", "bad", "good"], f"{shared_dir(urls.sparkSession)}/tonewise/urls-templates-{uuid.uuid4().hex}"
    live.where(F.size("segs") == 0).select(*columns).write.parquet(done)
    while live.limit(1).count():
        made = [live]
        live = live.where(F.size("segs") > 0)
        nodes = live.groupBy(*NODE).agg(F.count("*").alias("many")).where(F.col("many") < least).select(*NODE)
        few = live.join(nodes, NODE, "left_semi").withColumn("tpl", F.concat("tpl", F.repeat(F.lit("/*"), F.size("segs"))))
        rows, _ = _trunks(live, share, least, made)
        rows = saved(rows, "urls-rows")
        made.append(rows)
        l, stop, size = F.col("l"), F.col("stop"), F.size("segs")
        ended = rows.where((l == size) & (l <= stop)).withColumn("tpl", _along(l))
        token = F.when(F.col("known"), F.concat(F.lit("{"), "shape", F.lit("}"))).otherwise(F.lit("*"))
        left = rows.where((l < size) & (l < stop)).withColumn("tpl", F.concat(_along(l), F.lit("/"), token))
        left = left.withColumn("segs", F.slice("segs", l + 2, F.greatest(size - l - 1, F.lit(0))))
        # At the end of its path a node branches: one ordinary level.
        rest = rows.where((size > stop) & (l >= stop)).withColumn("tpl", _along(stop)).withColumn("segs", F.slice("segs", stop + 1, size - stop))
        rest = rest.withColumn("seg", F.get("segs", F.lit(0))).withColumn("shape", F.regexp_replace("seg", "[0-9]+", "#"))
        literal = saved(_merged(_frequent(rest, "seg", share, least)), "urls-segments")
        shape = saved(_frequent(rest, "shape", share, least).select(*NODE, "shape", F.lit(True).alias("common")), "urls-common")
        made += [literal, shape]
        size = F.size("segs")
        small = rest.groupBy(*NODE).agg(F.count("*").alias("many")).where(F.col("many") < least).select(*NODE, F.lit(True).alias("small"))
        rest = rest.join(small, NODE, "left").join(literal, [*NODE, "seg"], "left").join(shape, [*NODE, "shape"], "left")
        branch = F.coalesce("token", F.when(F.col("common"), F.concat(F.lit("{"), "shape", F.lit("}"))), F.lit("*"))
        every = F.repeat(F.lit("/*"), size)
        rest = rest.withColumn("tpl", F.when(F.col("small"), F.concat("tpl", every)).otherwise(F.concat(F.col("tpl"), F.lit("/"), branch)))
        rest = rest.withColumn("segs", F.when(F.col("small"), F.array().cast("array<string>")).otherwise(F.slice("segs", 2, F.greatest(size - 1, F.lit(0)))))
        further = saved(left.select(*columns, "segs").unionByName(rest.select(*columns, "segs")), "urls-live")
        over = [few, ended, further.where(F.size("segs") == 0)]
        reduce(DataFrame.unionByName, [x.select(*columns) for x in over]).write.mode("append").parquet(done)
        live = saved(further.where(F.size("segs") > 0), "urls-live")
        discard(further, *made)
    out = urls.sparkSession.read.schema(live.select(*columns).schema).parquet(done)
    discard(live)
    out._saved_at = done
    return out


def verdicts(pages: DataFrame, rules=RULES, strength: float = 2.0, prior: float = 0.1, reject: float = 0.6, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, template, purity."""
    host, path = parts(F.col(url_col).cast("string"))
    base = pages.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = judged(rules, F.col("host"), F.col("path"))
    base = base.withColumn("rule", rule).withColumn("ruled", verdict)
    bad, good = (F.coalesce(F.col("ruled") == x, F.lit(False)).cast("long") for x in ("block", "allow"))
    base = saved(base.withColumn("bad", bad).withColumn("good", good), "urls-judged")
    leaves = templates(base.select("rid", "host", "path", "bad", "good"))
    purity = (F.sum("bad") + strength * prior) / (F.sum("bad") + F.sum("good") + strength)
    pure = saved(leaves.groupBy("host", "tpl").agg(purity.alias("purity")), "urls-purity")
    found = leaves.join(pure, ["host", "tpl"]).select("rid", "tpl", "purity")
    own = F.when(F.col("purity") >= reject, "block").otherwise("allow")
    return base.join(found, "rid").select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), F.col("tpl").alias("template"), "purity"
    )


def report(pages: DataFrame) -> DataFrame:
    return verdicts(pages)
