"""URL filter by path templates, in DataFrame functions only.

Each host has a tree of path templates over its distinct URLs; how often a URL occurs plays no part. A path segment that
is a number, a long hexadecimal string or a date becomes a wildcard by its shape, keeping a file ending. From the root
down, a segment at a place in the tree, that is below a host and the segments before, is rare if it holds no more than
one in ``CHILDREN`` of the URLs there; where at least ``CHILDREN`` different ones are rare, they become a wildcard. So
a place has less than twice ``CHILDREN`` branches, whatever the size of its host. From the leaves up, siblings are then merged if they are statistically alike: a test of two proportions holds each sibling's rate of
block labels against that of the others together, with their numbers of labels (chi-square up to ``ALIKE``). Fewer than
``LEAST`` labels on either side are no evidence of likeness: such a sibling stays by itself, and where nothing of it is labelled
the rate of all decides. Where all siblings are alike, or there is only one, and nothing below them stays apart, their parent takes their place and meets its own siblings; else
the alike ones are one branch (``+``) and each of the others stays by itself. Paths may be of any depth.

Labels come from rules; a branch is rejected if its smoothed purity, (blocked + WEIGHT * rate of all) / (labelled +
WEIGHT), is at least ``REJECT``.

The first step reduces the pages to numbers for each host and shape, so a hot host is a few rows; pages meet their
templates in a join that the engine can split. The levels run one after another on these small tables, each written to
the shared folder; a template begins at the level where another one of its host first leaves it, so one long path adds no level.
A segment that itself begins with ``*``, ``+`` or a backslash has a backslash before it.

Edge cases: a null URL, or one without ``://``, has an empty host and path and belongs to the template of those; equal
URLs get equal verdicts; where no URL has a label, all are allowed; other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import store

CHILDREN, ALIKE, LEAST, WEIGHT, REJECT = 16, 3.84, 5, 4.0, 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: shapes of segments that vary.
VARIABLE = r"^([0-9]+|[0-9a-f]{8,}|[0-9]{4}-[0-9]{2}(-[0-9]{2})?)(\.[a-z]+)?$"


def host_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; rules are (verdict, host, path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    """The segments of a path, wildcards by shape."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(F.rlike(F.lower(s), F.lit(VARIABLE)), F.concat(F.lit("*"), F.regexp_extract(s, r"(\.[a-z]+)?$", 0))).when(F.rlike(s, F.lit(r"^[*+\\]")), F.concat(F.lit("\\"), s)).otherwise(s))


def _head(t: str, k: int) -> Column:
    """The first k segments as text."""
    return F.array_join(F.slice(t, 1, k), "/")


def generalised(leaf: DataFrame) -> DataFrame:
    """Adds ``t`` to (host, shape, urls): the segments of ``shape`` with wildcards where a place has many children."""
    size = leaf.groupBy("host", F.size("shape").alias("size")).agg(F.count("*").alias("c"))
    # a place at depth k needs CHILDREN shapes of its host that are longer than k
    upto = size.withColumn("longer", F.sum("c").over(Window.partitionBy("host").orderBy(F.desc("size")))).where(F.col("longer") >= CHILDREN).agg(F.max("size")).first()[0] or 0

    rows = leaf.withColumn("t", F.col("shape"))
    for k in range(upto):
        child = rows.where(F.size("t") > k).groupBy("host", _head("t", k).alias("above"), F.get("t", F.lit(k)).alias("s")).agg(F.sum("urls").alias("n"))
        whole = child.groupBy("host", "above").agg(F.sum("n").alias("n_all"))
        often = F.col("n") * CHILDREN > F.col("n_all")
        place = child.join(whole, ["host", "above"]).groupBy(F.col("host").alias("p_host"), F.col("above").alias("p_above")).agg(F.count_if(~often).alias("rare"), F.collect_list(F.when(often, F.col("s"))).alias("p_often"))
        place = place.where(F.col("rare") >= CHILDREN).drop("rare")
        rows = rows.join(place, (F.col("host") == F.col("p_host")) & (_head("t", k) == F.col("p_above")), "left")
        wild = F.concat(F.slice("t", 1, k), F.array(F.lit("*")), F.slice("t", k + 2, 1 << 30))
        rows = rows.withColumn("t", F.when((F.size("t") > k) & ~F.array_contains("p_often", F.get("t", F.lit(k))), wild).otherwise(F.col("t")))
        rows = store.kept(rows.drop("p_host", "p_above", "p_often"), "url-wild")
    return rows


def alike(b: Column, n: Column, b_all: Column, n_all: Column) -> Column:
    """Whether b of n is no other rate than that of the rest of b_all of n_all, by a test of two proportions; few of either tell nothing."""
    b, n, b_all, n_all = (c.cast("double") for c in (b, n, b_all, n_all))
    apart = b * (n_all - n) - (b_all - b) * n
    return (n >= LEAST) & (n_all - n >= LEAST) & (apart * apart * n_all <= ALIKE * n * (n_all - n) * b_all * (n_all - b_all))


def _leaves(templates: DataFrame) -> DataFrame:
    """Adds ``node``: of each template the part up to where its host's other templates have left it. Up to there a branch has one
    child only, which takes its parent's place without a test."""
    order = Window.partitionBy("host").orderBy("t")
    shared = lambda other: F.coalesce(F.array_position(F.zip_with("t", other, lambda a, b: F.coalesce(a == b, F.lit(False))), F.lit(False)) - 1, F.lit(0))
    # sorted, the next ones share most
    near = templates.withColumns({"one": F.lag("t").over(order), "two": F.lead("t").over(order)})
    whole = lambda other: F.when((shared(other) < 0) & F.col(other).isNotNull(), F.size("t")).otherwise(F.greatest(shared(other), F.lit(0)))
    keep = F.greatest(whole("one"), whole("two")) + 1
    return near.withColumn("node", F.slice("t", F.lit(1), F.least(F.size("t"), keep.cast("int")))).drop("one", "two")


def merged(templates: DataFrame) -> DataFrame:
    """(host, t, template) for (host, t, blocked, labelled): the branch that each template belongs to in the end."""
    df = store.kept(_leaves(templates).withColumn("fixed", F.lit(False)), "url-leaves")
    deepest = df.agg(F.max(F.size("node"))).first()[0] or 0
    for d in range(deepest, 0, -1):
        here = ~F.col("fixed") & (F.size("node") == d)
        own = df.where(here).groupBy("host", "node").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).withColumn("above", _head("node", d - 1))
        whole = own.groupBy("host", "above").agg(F.sum("b").alias("b_all"), F.sum("l").alias("l_all"), F.count("*").alias("siblings"))
        apart = df.where(F.col("fixed") & (F.size("node") >= d)).select("host", _head("node", d - 1).alias("above")).distinct().withColumn("apart", F.lit(True))
        own = own.join(whole, ["host", "above"]).withColumn("alike", (F.col("siblings") == 1) | alike(F.col("b"), F.col("l"), F.col("b_all"), F.col("l_all")))
        every = own.groupBy("host", "above").agg(F.every("alike").alias("every")).join(apart, ["host", "above"], "left")
        verdict = own.select("host", "above", "node", "alike").join(every, ["host", "above"])
        verdict = verdict.select(F.col("host").alias("v_host"), F.col("node").alias("v_node"), "alike", (F.col("every") & F.col("apart").isNull()).alias("up"))
        df = df.join(verdict, here & (F.col("host") == F.col("v_host")) & (F.col("node") == F.col("v_node")), "left")
        above = F.slice("node", 1, d - 1)
        node = F.when(F.col("up"), above).when(F.col("alike"), F.concat(above, F.array(F.lit("+")))).otherwise(F.col("node"))
        df = df.select("host", "t", "blocked", "labelled", node.alias("node"), (F.col("fixed") | ~F.coalesce("up", F.lit(True))).alias("fixed"))
        df = store.kept(df, "url-merged")
    return df.select("host", "t", "blocked", "labelled", F.concat(F.lit("/"), F.array_join("node", "/")).alias("template"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity and merged (templates in the branch) of every row."""
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), shape(F.col("path")).alias("shape"))
    urls = rows.select("host", "path", "shape", "ruled").distinct()
    leaf = urls.groupBy("host", "shape").agg(F.count("*").alias("urls"), F.count_if(F.col("ruled") == "block").alias("blocked"), F.count("ruled").alias("labelled"))
    leaf = generalised(store.kept(leaf, "url-leaf"))
    templates = store.kept(leaf.groupBy("host", "t").agg(*(F.sum(c).alias(c) for c in ("blocked", "labelled"))), "url-tree")
    total = templates.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).first()
    prior = F.lit(float(total["b"] / total["l"]) if total["l"] else 0.0)
    branch = merged(templates)
    purity = (F.sum("blocked") + WEIGHT * prior) / (F.sum("labelled") + WEIGHT)
    judged = branch.groupBy("host", "template").agg(purity.alias("purity"), F.count("*").alias("merged"))
    found = leaf.select("host", "shape", "t").join(branch.select("host", "t", "template"), ["host", "t"]).join(judged, ["host", "template"])
    found = found.select(F.col("host").alias("f_host"), F.col("shape").alias("f_shape"), "template", "purity", "merged")
    out = rows.join(found, (F.col("host") == F.col("f_host")) & (F.col("shape") == F.col("f_shape")), "left")
    own = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "template", "purity", "merged")
