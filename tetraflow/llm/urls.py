"""URL filter: explicit rules first, then a path-template tree, in DataFrame functions only.

The tree. Each url becomes a host and path segments. Segments that look like
identifiers (numbers, hexadecimal, dates, long mixed strings) turn into ``*``
at once, so what is grouped is a raw template, not a url. Level by level, the
rare children of a parent turn into ``*`` where they are many; frequent ones
stay as they are. Below DEPTH a subtree ends in ``**`` where its labels are all
bad, all good or none, as deeper levels add nothing there. Then
branches below one parent are merged where they are statistically alike: both
carry labels and their shares of bad labels differ by less than a two-proportion
z-test can tell. A template is rejected if the lower bound of its smoothed
purity, (bad + a) / (labelled + a + b) less one standard error, reaches the
threshold. A template without labels takes the evidence of its nearest
ancestor, the host at last, that has some.

Labels: a column of the caller's (1 bad, 0 good, null unknown); where there is
none, the urls on which a rule decides are the labelled rows: blocked ones are
bad, allowed ones good. So a host most of whose judged urls are blocked is
rejected in the templates that no rule speaks of.

Skew: all urls of a host collapse to raw templates by partial aggregation
before the first shuffle; the levels work on templates only. Only rejected
templates meet the urls again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tetraflow.llm._shared import stage

#: The explicit rules: verdict, host, path. A rule fits the host and its subdomains.
RULES: tuple[tuple[str, str, str], ...] = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
MAX_RULES = 2000
DEPTH = 5
MANY_CHILDREN, RARE_SHARE = 24, 0.05
PRIOR_BAD, PRIOR_GOOD = 1.0, 3.0
REJECT_AT, ALIKE_Z = 0.8, 1.0
_VARIABLE = r"^(?:[0-9]+|[0-9a-f]{8,}|[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?|(?=.*[0-9])[A-Za-z0-9_~-]{16,})(?:\.[A-Za-z0-9]{1,5})?$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def explicit_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The text and verdict of the longest rule that fits, or nulls, as expressions; for a list of bounded length."""
    rule = verdict = F.lit(None).cast("string")
    for what, name, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):  # the longest is asked first
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def ruled(urls: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """``urls`` (host, path, ...) with rule and by_rule, the longest rule that fits and its verdict, or nulls.

    Up to MAX_RULES rules are compared with every url in place; more are a
    table that each distinct (host, path) meets by its host and parent domains.
    """
    if len(rules) <= MAX_RULES:
        rule, verdict = explicit_rule(F.col("host"), F.col("path"), rules)
        return urls.withColumn("rule", rule).withColumn("by_rule", verdict)
    table = urls.sparkSession.createDataFrame(list(rules), "what string, name string, start string")
    labels = F.split("host", r"\.", -1)
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    once = urls.select("host", "path").distinct()
    met = once.select("host", "path", F.explode(F.array_distinct(domains)).alias("name")).join(table, "name").where(F.col("path").startswith(F.col("start")))
    longest = F.max(F.struct((F.length("name") + F.length("start")).alias("n"), "what", "name", "start"))
    best = met.groupBy("host", "path").agg(longest.alias("r"))
    best = best.select("host", "path", F.concat("r.name", "r.start").alias("rule"), F.col("r.what").alias("by_rule"))
    return urls.join(best, ["host", "path"], "left")


def _raw_segments(path: Column, depth: int | None = None) -> Column:
    parts = F.filter(F.split(path, "/", -1), lambda s: s != "")
    if depth is not None:
        parts = F.when(F.size(parts) > depth, F.concat(F.slice(parts, 1, depth), F.array(F.lit("**")))).otherwise(parts)
    return F.transform(parts, lambda s: F.when(s.rlike(_VARIABLE), "*").otherwise(s))


def template_tree(urls: DataFrame) -> DataFrame:
    """(host, raw, template, n, bad, labelled) for each raw template of ``urls`` (host, raw, bad).

    ``raw`` is an array of segments, ``bad`` 1, 0 or null. A child is frequent
    if it has more than RARE_SHARE of its parent's urls, or of those that such
    children leave; MANY_CHILDREN or more that are not turn into ``*``.
    """
    tree = urls.groupBy("host", "raw").agg(F.count("*").alias("n"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"), F.count("bad").alias("labelled"))
    tree = stage(tree.withColumn("template", F.lit("")).withColumn("open", F.lit(True)), "url-tree")
    node, level = ["host", "template"], 0
    while True:
        segment = F.get("raw", F.lit(level))
        below = tree.where(F.col("open") & segment.isNotNull())
        if below.isEmpty():
            return tree.drop("open")
        if level >= DEPTH:
            mixed = below.groupBy(*node).agg(F.sum("bad").alias("b"), F.sum("labelled").alias("m")).where("b > 0 and b < m").select(*node, F.lit(True).alias("mixed"))
            tree = tree.join(mixed, node, "left")
            ends = F.col("open") & segment.isNotNull() & F.col("mixed").isNull()
            tree = tree.withColumn("template", F.when(ends, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))).withColumn("open", F.col("open") & ~ends).drop("mixed")
            tree = stage(tree, "url-tree")
            below = tree.where(F.col("open") & segment.isNotNull())
        child = below.groupBy(*node, segment.alias("segment")).agg(F.sum("n").alias("n"))
        many = child.groupBy(*node).agg(F.count("*").alias("children"), F.sum("n").alias("all")).where(F.col("children") >= MANY_CHILDREN)
        child = child.join(many.drop("children"), node).withColumn("few", F.col("n") <= RARE_SHARE * F.col("all"))
        rest = child.groupBy(*node).agg(F.sum(F.when(F.col("few"), F.col("n")).otherwise(0)).alias("rest"))
        rare = F.col("few") & (F.col("n") <= RARE_SHARE * F.col("rest"))
        loose = child.join(rest, node).groupBy(*node).agg(F.count_if(rare).alias("rare"), F.collect_list(F.when(~rare, F.col("segment"))).alias("frequent"))  # 40 of them at most
        tree = tree.join(loose.where(F.col("rare") >= MANY_CHILDREN).select(*node, "frequent"), node, "left")
        named = F.when(F.col("frequent").isNotNull() & ~F.array_contains("frequent", segment), "*").otherwise(segment)
        here = F.col("open") & segment.isNotNull()
        tree = tree.withColumn("template", F.when(here, F.concat("template", F.lit("/"), named)).otherwise(F.col("template"))).drop("frequent")
        tree = stage(tree, "url-tree")  # each level reads the one before several times
        level += 1


def _inherited(leaf: DataFrame) -> DataFrame:
    """(host, template, b0, m0): for each template without labels those of its nearest ancestor that has any below it."""
    steps = F.split("template", "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(steps, 1, k), "/").alias("above")))
    each = leaf.select("host", "template", "bad", "labelled", F.inline(above))
    known = each.where("labelled > 0").groupBy("host", "above").agg(F.sum("bad").alias("b0"), F.sum("labelled").alias("m0"))
    near = each.where("labelled = 0").join(known, ["host", "above"]).groupBy("host", "template").agg(F.max(F.struct("k", "b0", "m0")).alias("x"))
    return near.select("host", "template", "x.b0", "x.m0")


def judged_templates(tree: DataFrame, reject_at: float = REJECT_AT) -> DataFrame:
    """(host, template, branch, purity, rejected): templates with the merged evidence of branches alike.

    Below each parent, labelled templates are sorted by their share of bad
    labels; neighbours whose shares a two-proportion z-test cannot tell apart
    form one branch and pool their labels. A template without labels joins no
    branch; it has the purity of its nearest ancestor with labels, or the prior
    if there is none.
    """
    leaf = tree.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "labelled")])
    leaf = leaf.withColumn("parent", F.regexp_extract("template", r"(?s)^(.*)/[^/]*$", 1))
    some = leaf.where("labelled > 0").withColumn("share", F.col("bad") / F.col("labelled"))
    order = Window.partitionBy("host", "parent").orderBy("share", "template")
    before = some.withColumn("bad0", F.lag("bad").over(order)).withColumn("labelled0", F.lag("labelled").over(order))
    pooled = (F.col("bad") + F.col("bad0") + 1) / (F.col("labelled") + F.col("labelled0") + 2)
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / F.col("labelled0")))
    apart = F.abs(F.col("bad") / F.col("labelled") - F.col("bad0") / F.col("labelled0")) > ALIKE_Z * error
    branch = before.withColumn("branch", F.sum(F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0)).over(order))
    pool = Window.partitionBy("host", "parent", "branch")
    branch = branch.select("host", "template", "branch", F.sum("bad").over(pool).alias("b"), F.sum("labelled").over(pool).alias("m"))
    total = F.coalesce("m", F.lit(0)) + PRIOR_BAD + PRIOR_GOOD
    purity = (F.coalesce("b", F.lit(0)) + PRIOR_BAD) / total
    branch = branch.unionByName(_inherited(leaf).select("host", "template", F.lit(None).cast("long").alias("branch"), F.col("b0").alias("b"), F.col("m0").alias("m")))
    out = leaf.select("host", "template").join(branch, ["host", "template"], "left").withColumn("purity", purity)
    return out.select("host", "template", "branch", "purity", (purity - F.sqrt(purity * (1 - purity) / total) >= reject_at).alias("rejected"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, label: str | None = None, reject_at: float = REJECT_AT) -> DataFrame:
    """(page_id, host, path, rule, verdict, template) for each row of ``pages``.

    Needs page_id and url (and the column ``label`` if named: 1 bad, 0 good,
    null unknown); other columns are ignored. A null url, or one without
    ``://``, has empty host and path and is allowed unless labels reject its
    empty template. Rows repeat as they come, null ids included; an empty
    table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    marked = F.col(label).cast("int") if label else F.lit(None).cast("int")
    base = pages.select("page_id", host.alias("host"), path.alias("path"), marked.alias("label"))
    base = ruled(base, rules).withColumn("raw", _raw_segments(F.col("path")))
    bad = F.col("label") if label else F.when(F.col("by_rule") == "block", 1).when(F.col("by_rule") == "allow", 0)
    tree = template_tree(base.select("host", "raw", bad.alias("bad")))
    rejected = judged_templates(tree, reject_at).where("rejected").select("host", "template")
    reject = tree.join(rejected, ["host", "template"]).select("host", "raw", "template")
    key = F.concat_ws("/", "raw")
    reject = reject.select("host", key.alias("k"), "template")
    out = base.withColumn("k", key).join(reject, ["host", "k"], "left")
    by_method = F.when(F.col("template").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"), "template")
