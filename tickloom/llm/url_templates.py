"""URL filters: given rules first, then a path-template tree learned for each host.

Everything is DataFrame and SQL work. Segments that look variable (numbers, hexadecimal ids) and segments
of which a node has many rare ones become wildcards; sibling branches whose labelled shares do not differ
significantly from each other are merged; a template is rejected where its smoothed labelled purity falls
under a threshold. The labels are the verdicts of the rules, so the tree carries what the rules say about
some addresses of a template to the others. Statistics are aggregated by host and path before any level of
the tree is built, so a host with a third of all pages is a few rows by then.

Paths may have any number of segments. What all paths of a node begin with is passed in one step, and a path
that is alone in its node is done, so the rounds are as many as the tree has branchings one under another.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import checkpointed, join_by_key

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("com", "/", "allow"),
    UrlRule("example.com", "/en/", "block"),
    UrlRule("www.example.com", "/en/", "allow"),
    UrlRule("net", "/es/", "block"),
    UrlRule("net", "/fr/", "block"),
)


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next / ? or #, A-Z lower-cased; empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...], what: str = "name") -> Column:
    """Name (or verdict) of the longest rule that fits, the first given of equally long ones; else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(getattr(rule, what))).otherwise(out)
    return out


def segments_of(path: Column) -> Column:
    """The path's segments, numbers and ids replaced by wildcards."""

    def shape(s: Column) -> Column:
        return (
            F.when(s.rlike(r"^\d+$"), F.lit("{n}"))
            .when(s.rlike(r"^\d+\.\w{1,5}$"), F.concat(F.lit("{n}"), F.regexp_extract(s, r"\.\w+$", 0)))
            .when(s.rlike(r"^(?=.*\d)[0-9a-fA-F-]{8,}$"), F.lit("{x}"))
            .otherwise(s)
        )

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), shape)


def _tail(skip: Column) -> Column:
    """The segments left after the first `skip`."""
    return F.when(F.size("left") > skip, F.slice("left", skip + 1, F.size("left"))).otherwise(F.slice("left", 1, 0))


def _grow(paths: DataFrame, total: int, children: int, share: float, least: int, z: float) -> DataFrame:
    """One branching of every node: what its paths share is passed, and the next segment gets the token it stands for.

    `paths` has `total` rows: at (host, template), segs, left, n, good, bad. Hot nodes are joined by broadcast.
    """
    node = paths.groupBy("at").agg(F.min("left").alias("low"), F.max("left").alias("high"), F.count("*").alias("paths"))
    same = F.size(F.filter(F.sequence(F.lit(1), F.size("low")), lambda k: F.slice("low", 1, k) == F.slice("high", 1, k)))
    node = node.select("at", "paths", same.alias("same"), F.slice("low", 1, same).alias("passed"))
    more = F.when(F.size("passed") > 0, F.concat("at.template", F.lit("/"), F.array_join("passed", "/"))).otherwise(F.col("at.template"))
    paths = join_by_key(paths, node, "at", "paths", total).withColumns({"at": F.struct("at.host", more.alias("template")), "left": _tail(F.col("same"))}).drop("same", "passed")
    paths = paths.withColumn("key", F.struct("at", F.try_element_at("left", F.lit(1)).alias("seg")))
    nodes = paths.where("key.seg is not null").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n", "good", "bad")), F.count("*").alias("paths"))
    parents = nodes.groupBy("key.at").agg(F.count("*").alias("kids"), F.sum("n").alias("all_n"))
    # a node may have very many segments; what is asked of it is two numbers
    nodes = join_by_key(nodes.withColumn("at", F.col("key.at")), parents.withColumn("rows", F.col("kids")), "at", "rows", total)
    nodes = nodes.withColumns({"rare": (F.col("kids") > children) & (F.col("n") < share * F.col("all_n")), "seg": F.col("key.seg")})
    # at most the greater of `children` and 1 / `share` siblings are left; in the order of their labelled shares those
    # that do not differ significantly from the one before are one branch with it
    rank = Window.partitionBy("at").orderBy(F.col("good") / (F.col("good") + F.col("bad")), "seg")
    own = F.col("good") + F.col("bad")
    other, before = F.lag(own).over(rank), F.lag("good").over(rank)
    pooled = (F.col("good") + before) / (own + other)
    apart = F.abs(F.col("good") / own - before / other) > z * F.sqrt(pooled * (1 - pooled) * (1 / own + 1 / other))
    told = nodes.where(~F.col("rare") & (own >= least)).withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int"))
    told = told.withColumn("branch", F.sum("apart").over(rank)).withColumn("many", F.count("*").over(Window.partitionBy("at", "branch")))
    merged = told.where("many > 1").select("key", F.concat(F.lit("{like"), F.col("branch"), F.lit("}")).alias("like"))
    token = F.when(F.col("rare"), F.lit("{any}")).otherwise(F.coalesce("like", "seg"))
    named = nodes.join(merged, "key", "left").select("key", token.alias("token"), "paths")
    grown = join_by_key(paths.where("key.seg is not null"), named, "key", "paths", total)
    grown = grown.withColumns({"at": F.struct("at.host", F.concat("at.template", F.lit("/"), F.col("token")).alias("template")), "left": _tail(F.lit(1))})
    columns = ["at", "segs", "left", "n", "good", "bad"]
    return grown.select(columns).union(paths.where("key.seg is null").select(columns))


def _templates(paths: DataFrame, children: int, share: float, least: int, z: float) -> DataFrame:
    """host, segs, template, n, good, bad for every path of `paths` (host, segs, n, good, bad)."""
    ends = F.when(F.size("left") > 0, F.concat("at.template", F.lit("/"), F.array_join("left", "/"))).otherwise(F.col("at.template"))
    rest, done = paths.select(F.struct("host", F.lit("").alias("template")).alias("at"), "segs", F.col("segs").alias("left"), "n", "good", "bad"), []
    total = paths.count()
    while total:
        # a path without segments left, or alone in its node, has its template
        alone = rest.groupBy("at").agg(F.count_if(F.size("left") > 0).alias("open"), F.count("*").alias("paths"))
        marked = checkpointed(join_by_key(rest, alone, "at", "paths", total).withColumn("ends", (F.size("left") == 0) | (F.col("open") == 1)).drop("open"))
        done.append(marked.where("ends").select("at.host", "segs", ends.alias("template"), "n", "good", "bad"))
        rest = marked.where("not ends").drop("ends")
        total = rest.count()
        rest = _grow(rest, total, children, share, least, z)
    return reduce(DataFrame.union, done) if done else paths.select("host", "segs", F.lit("").alias("template"), "n", "good", "bad")


def judge(
    pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, children: int = 20, share: float = 0.05, least: int = 5, z: float = 1.96, weight: float = 4.0, purity: float = 0.5
) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for every row.

    `children`/`share`: a node with more than so many segments turns those rarer than this share into one
    wildcard. `least`: labels without which a branch is not merged and a template not rejected. `z`: how
    far branches may differ and still be merged. `weight`: labels that the overall good
    share counts for when a template's purity is smoothed. Null and relative addresses have an empty host
    and path, no rule and the verdict of their (empty) template, allow. Repeated rows each have theirs;
    extra columns are ignored.
    """
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    fits, verdict = (rule_of(F.col("host"), F.col("path"), rules, x) for x in ("name", "verdict"))
    rows = rows.select("page_id", "host", "path", fits.alias("rule"), verdict.alias("ruled"), segments_of(F.col("path")).alias("segs"))
    paths = rows.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad"))
    paths = checkpointed(paths)
    tree = _templates(paths, children, share, least, z)
    prior = paths.agg(F.sum("good") / F.nullif(F.sum(F.col("good") + F.col("bad")), F.lit(0))).first()[0]
    key = F.struct("host", "template").alias("key")
    leaves = tree.groupBy(key).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.count("*").alias("paths"))
    smooth = (F.col("good") + weight * F.lit(0.5 if prior is None else float(prior))) / (F.col("good") + F.col("bad") + weight)
    leaves = leaves.select("key", "paths", smooth.alias("purity"), F.when((F.col("good") + F.col("bad") >= least) & (smooth < purity), "block").otherwise("allow").alias("learned"))
    known = join_by_key(tree.select(key, F.struct("host", "segs").alias("at"), "n"), leaves, "key", "paths", paths.count())
    known = known.select("at", F.col("key.template").alias("template"), "purity", "learned", "n")
    judged = join_by_key(rows.withColumn("at", F.struct("host", "segs")), known, "at", "n", rows.count())
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", "learned").alias("verdict"), "template", "purity")
