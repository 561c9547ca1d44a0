"""URL filters: rule lists first, then a per-host tree of path templates judged by smoothed labelled purity.

DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialised

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """text is host, then path from its slash on, such as net/de/."""

    action: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


#: The rules that the query is to apply.
RULES = (Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("allow", "net/de/"), Rule("block", "example.net/de/8"), Rule("block", "org/es/"))


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is no :// or the url is null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """From the host's end up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Text of the longest rule whose host is the url's or a parent of it and whose path begins the url's; else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.text)).otherwise(out)
    return out


@dataclass(frozen=True)
class Tree:
    """Parameters of the template tree.

    A branch stands apart if it has `labels` labelled urls or more and its share of good ones differs from that of its
    siblings together by more than `z` standard errors. Of a node's branches, those that don't stand apart are one
    wildcard. Those that do are taken by their shares: while one is not apart from the one before by the same test of two
    proportions, both are one, since they are alike, though not like the rest. Variable segments, such as numbers, have
    few labels each and so are generalised; a large branch of another kind among them is not. Purity is the share of good
    urls, smoothed by `weight` urls of the host's own smoothed purity, which is smoothed by as many of the corpus's.
    Templates under `least` are rejected. Paths may be of any depth.
    """

    labels: int = 8
    z: float = 2.0
    weight: float = 4.0
    least: float = 0.5


#: Parts that rows of one key are spread over where what they are joined with is too large to be broadcast, and that size.
SPREAD, BROADCAST_BYTES = 16, 8 << 20


def looked_up(rows: DataFrame, small: DataFrame, on: list[str], spread: str) -> DataFrame:
    """rows, left joined with small, which has a row per key and is read more than once. Broadcast if its counted size
    allows it; else each of its rows meets SPREAD parts of its key's rows, which are told by the column spread."""
    texts = [F.length(c) for c, kind in small.dtypes if kind == "string"]
    size = small.agg(F.sum(sum(texts, F.lit(64)))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(small), on, "left")
    every = small.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return rows.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(SPREAD)).cast("int")).join(every, [*on, "_part"], "left").drop("_part")


def templates(urls: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """(host, path, template, n, lab, fine) of the distinct paths of urls (host, path, good 1/0/null).

    Only distinct paths with their counts walk down the tree, level by level. Nothing stands apart at or below a node of
    `labels` labelled urls or fewer, so its paths are settled there, each deeper segment a wildcard: the rounds go as deep
    as well-labelled nodes do, not as deep as the longest path.
    """
    rows = urls.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.count("good").alias("lab"), F.coalesce(F.sum("good"), F.lit(0)).alias("fine"))
    rows = rows.withColumn("segs", F.filter(F.split("path", "/"), lambda x: x != "")).withColumn("template", F.lit(""))
    live, settled, d = materialised(rows, "paths"), [], 0
    keep = ["host", "path", "n", "lab", "fine", "segs", "template"]
    while not live.isEmpty():
        below = live.withColumn("seg", F.get("segs", F.lit(d)))
        node = below.where("seg IS NOT NULL").groupBy("host", "template").agg(F.sum("lab").alias("all_l"), F.sum("fine").alias("all_f"))
        below = looked_up(below, materialised(node.where(F.col("all_l") > tree.labels), "nodes"), ["host", "template"], "path")
        busy = F.col("seg").isNotNull() & F.col("all_l").isNotNull()
        below = looked_up(below, materialised(_apart(below.where(busy), tree), "branches"), ["host", "template", "seg"], "path")
        name = F.when(busy, F.concat("template", F.lit("/"), F.coalesce("_as", F.lit("*")))).otherwise(F.concat("template", F.repeat(F.lit("/*"), F.greatest(F.size("segs") - d, F.lit(0)))))
        below = materialised(below.withColumn("template", name).select(*keep, (~busy).alias("_settled")), "paths")
        settled.append(below.where("_settled").select(*keep))
        live, d = below.where("NOT _settled").select(*keep), d + 1
    return reduce(DataFrame.unionByName, settled, live).drop("segs")


def _differ(l1: Column, f1: Column, l2: Column, f2: Column, pooled: Column, z: float) -> Column:
    """Whether f1 of l1 and f2 of l2 are shares more than z standard errors apart."""
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), l1) + F.try_divide(F.lit(1.0), l2)))
    return F.coalesce(F.abs(F.try_divide(f1, l1) - F.try_divide(f2, l2)) > z * error, F.lit(False))


def _apart(rows: DataFrame, tree: Tree) -> DataFrame:
    """(host, template, seg, _as): what segments that stand apart from their siblings are called in templates."""
    keys, l, f = ["host", "template"], F.col("all_l"), F.col("all_f")
    child = rows.groupBy(*keys, "seg").agg(F.sum("lab").alias("lab"), F.sum("fine").alias("fine"), F.max("all_l").alias("all_l"), F.max("all_f").alias("all_f"))
    child = child.where((F.col("lab") >= tree.labels) & (l > F.col("lab")))
    child = child.where(_differ(F.col("lab"), F.col("fine"), l - F.col("lab"), f - F.col("fine"), (f + 1) / (l + 2), tree.z))
    child = materialised(child.select(*keys, "seg", "lab", "fine"), "apart")
    # Branches of equal counts are one row here, so a node of many branches is a short list.
    shares = child.groupBy(*keys, "lab", "fine").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(*keys).orderBy(F.col("fine") / F.col("lab"), "lab")
    l0, f0 = F.lag("lab").over(w), F.lag("fine").over(w)
    new = _differ(F.col("lab"), F.col("fine"), l0, f0, (F.col("fine") + f0 + 1) / (F.col("lab") + l0 + 2), tree.z)
    shares = shares.withColumn("_new", new.cast("int")).withColumn("alike", F.sum("_new").over(w))
    shares = shares.withColumn("k", F.sum("k").over(Window.partitionBy(*keys, "alike")))
    name = F.when(F.col("k") > 1, F.concat(F.lit("*"), F.col("alike").cast("string"))).otherwise(F.col("seg"))
    return child.join(shares, [*keys, "lab", "fine"]).select(*keys, "seg", name.alias("_as"))


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, tree: Tree = Tree()) -> DataFrame:
    """Every row's id, host, path, rule and verdict, and the template with its purity and labelled urls.

    labels: (id, good), good 1 or 0; several of one id: the worst counts. A url that no rule fits is blocked if its
    template's smoothed purity is under tree.least. Urls without labels anywhere near have the corpus's purity. Null
    urls, and urls without ://, have an empty host and path and are judged as one template. Repeated rows stay; an empty
    table gives none. Only the two named columns of pages are read.
    """
    url = F.col("_u")
    lab = labels.select(F.col(labels.columns[0]).alias("_id"), F.col(labels.columns[1]).alias("_g")).where("_id is not null").groupBy("_id").agg(F.min("_g").cast("int").alias("good"))
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("_u"))
    rows = rows.select("id", url_host(url).alias("host"), url_path(url).alias("path")).join(lab, F.col("id") == F.col("_id"), "left").drop("_id")
    rows = materialised(rows, "urls")
    paths = templates(rows, tree)
    by_template = paths.groupBy("host", "template").agg(F.sum("lab").alias("lab"), F.sum("fine").alias("fine"))
    by_host = by_template.groupBy("host").agg(F.sum("lab").alias("hl"), F.sum("fine").alias("hf"))
    all_l, all_f = by_host.agg(F.sum("hl"), F.sum("hf")).first()
    prior = ((all_f or 0) + 1) / ((all_l or 0) + 1)
    w = F.lit(tree.weight)
    host_purity = (F.col("hf") + w * F.lit(min(prior, 1.0))) / (F.col("hl") + w)
    purity = (F.col("fine") + w * F.col("hp")) / (F.col("lab") + w)
    hosts = materialised(by_host.select("host", host_purity.alias("hp")), "hosts")
    known = looked_up(by_template, hosts, ["host"], "template").select("host", "template", purity.alias("purity"), F.col("lab").alias("n_labelled"))
    paths = looked_up(paths.select("host", "path", "template"), materialised(known, "templates"), ["host", "template"], "path")
    rows = rows.join(paths, ["host", "path"]).withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    action = F.lit(None).cast("string")
    for r in rules:
        action = F.when(F.col("rule") == r.text, F.lit(r.action)).otherwise(action)
    own = F.when(F.col("purity") < tree.least, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce(action, own).alias("verdict"), "template", "purity", "n_labelled")


def op2_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are labelled by the quality label of the document that their url's number names."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    number = F.expr(r"try_cast(nullif(regexp_extract(url, '^[^?#]*?/([0-9]{1,18})(?:[^0-9?#/][^?#/]*)?/?(?:[?#].*)?$', 1), '') as bigint)")
    named = pages.select("page_id", number.alias("doc_id")).join(labels, "doc_id").select("page_id", "good")
    return judge(pages, named)
