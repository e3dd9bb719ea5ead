"""URL filters: stated host and path rules, and token rules mined from labels by FP-growth. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the production query: (verdict, host, path).
RULES = (
    ("block", "com", "en/"),
    ("allow", "example.com", "en/7"),
    ("allow", "net", "de/"),
    ("block", "example.net", "de/8"),
    ("block", "org", "es/"),
)
#: Stated rules up to this many are compared in one expression; more are joined by host.
MOST_RULES = 512
#: Where no labelled url has more frequent tokens than this, FP-growth counts all combinations, up to 2 ** 14 of a url; else ``_free_sets`` counts those that a rule can come from.
MOST_ITEMS = 14
#: Labelled urls that a mined rule rests on at least.
MIN_COUNT = 10


def host_of(url):
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    after = _after_scheme(url)
    return F.coalesce(F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url):
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url):
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def stated(host, path, rules=RULES):
    """(verdict, rule) of the longest stated rule that fits, or null: its host is the url's or a parent, its path starts the url's."""
    hit = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(f"{r[1]}/{r[2]}"), r)):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(f"/{rule_path}")
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(f"{rule_host}/{rule_path}").alias("rule"))
        hit = F.when(fits, value) if hit is None else hit.when(fits, value)
    if hit is None:
        return F.lit(None).cast("struct<verdict:string,rule:string>")
    return hit


def with_hits(urls: DataFrame, rules=RULES) -> DataFrame:
    """``urls`` (url, host, path) with hit, as ``stated`` gives it; many rules are joined on the parent domains of as many labels as some rule has."""
    if len(rules) <= MOST_RULES:
        return urls.withColumn("hit", stated(F.col("host"), F.col("path"), rules))
    table = urls.sparkSession.createDataFrame([(h, v, p, f"{h}/{p}") for v, h, p in rules], "_host string, verdict string, _path string, rule string")
    labels = sorted({h.count(".") + 1 for _, h, _ in rules})
    parents = F.explode(F.array_distinct(F.array(*[F.substring_index("host", ".", -k) for k in labels])))
    fits = urls.select("url", "path", parents.alias("_host")).join(table, "_host").where(F.col("path").startswith(F.concat(F.lit("/"), "_path")))
    best = fits.groupBy("url").agg(F.max_by(F.struct("verdict", "rule"), F.struct(F.length("rule"), F.col("verdict") == "allow", "rule")).alias("hit"))
    return urls.join(best.withColumnRenamed("url", "_u"), F.col("url") == F.col("_u"), "left").drop("_u")


def tokens(url, host, path):
    """The set of tokens of a url: each label of the host by its place from the end, each path segment by its place with digits as 0, each query key, the scheme."""
    numbered = lambda kind, parts: F.transform(parts, lambda x, i: F.concat(F.lit(kind), (i + 1).cast("string"), F.lit(":"), x))
    labels = numbered("d", F.reverse(F.filter(F.split(host, r"\."), lambda s: s != "")))
    segments = numbered("p", F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.regexp_replace(s, r"\d+", "0")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.concat(F.lit("q:"), F.regexp_extract(s, r"^[^=]*", 0)))
    secure = F.when(F.coalesce(url, F.lit("")).startswith("https:"), F.array(F.lit("s:https"))).otherwise(F.array(F.lit("s:other")))
    return F.array_distinct(F.concat(labels, segments, keys, secure))


def heads(labelled: DataFrame, least: float) -> DataFrame:
    """(token, head, n): the tokens in ``least`` labelled urls or more, each with the first of those that occur in the same urls throughout.

    The table is bounded by the mean number of tokens over the support, whatever the number of urls.
    """
    rows = labelled.select(F.xxhash64("tokens").alias("h"), F.explode("tokens").alias("token"))
    told = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).where(F.col("n") >= least)
    first = told.groupBy("n", "s").agg(F.min("token").alias("head"))
    return told.join(first, ["n", "s"]).select("token", "head", "n")


def _baskets(labelled: DataFrame, kept: DataFrame) -> DataFrame:
    """(verdict, t): the frequent tokens of each labelled url, all of them, as their heads, and its verdict."""
    rows = labelled.withColumn("row", F.monotonically_increasing_id())
    items = rows.select("row", F.explode("tokens").alias("token")).join(kept.where("token = head").select("token"), "token").groupBy("row").agg(F.array_sort(F.collect_list("token")).alias("t"))
    return rows.select("row", "verdict").join(items, "row", "left").select("verdict", F.coalesce("t", F.array().cast("array<string>")).alias("t"))


def _all_sets(baskets: DataFrame, share: float, partitions: int) -> DataFrame:
    """(items, verdict, both, all): all token combinations with a frequent verdict, and those with it and in all, by FP-growth."""
    rows = baskets.select(F.array_append("t", F.concat(F.lit("v:"), "verdict")).alias("items"))
    found = cut(FPGrowth(itemsCol="items", minSupport=share, **({"numPartitions": partitions} if partitions else {})).fit(rows).freqItemsets)
    verdicts = found.select("freq", F.filter("items", lambda x: x.startswith("v:")).alias("v"), F.array_sort(F.filter("items", lambda x: ~x.startswith("v:"))).alias("items")).where(F.size("items") > 0)
    both = verdicts.where(F.size("v") == 1).select("items", F.expr("substring(v[0], 3)").alias("verdict"), F.col("freq").alias("both"))
    return both.join(verdicts.where(F.size("v") == 0).select("items", F.col("freq").alias("all")), "items")


def _free_sets(baskets: DataFrame, least: float) -> DataFrame:
    """(items, verdict, both, all) as ``_all_sets``, without combinations whose rules a shorter one replaces anyway: of urls of any length, level by level.

    A combination in as many urls as a part of it has the part's rules. One that only one verdict has is surest, so that
    none longer beats it. Neither is made longer, nor is one in fewer than ``least`` urls of each verdict. Equal urls are counted, not repeated.
    """
    rows = cut(baskets.groupBy("t", "verdict").agg(F.count(F.lit(1)).alias("n")).withColumn("b", F.monotonically_increasing_id()))
    seen = rows.select("b", "verdict", "n", F.array().cast("array<string>").alias("head"), F.explode("t").alias("last"))
    levels, grown, k = [], None, 1
    while True:
        told = seen.groupBy("head", "last", "verdict").agg(F.sum("n").alias("both")).groupBy("head", "last").agg(F.sum("both").alias("all"), F.collect_list(F.struct("verdict", "both")).alias("told"))
        told = told.where(F.array_max(F.transform("told", lambda x: x["both"])) >= least).select("head", "last", F.concat("head", F.array("last")).alias("items"), "all", "told")
        if grown is not None:
            parts = told.select("items", "all", F.explode(F.transform("items", lambda x: F.array_remove("items", x))).alias("part")).join(grown.select(F.col("items").alias("part"), F.col("all").alias("more")), "part")
            free = parts.where(F.col("more") > F.col("all")).groupBy("items").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == k).select("items")
            told = told.join(free, "items")
        told = cut(told)
        levels.append(told)
        grown = told.where(F.size("told") > 1)
        if grown.isEmpty():
            break
        own = cut(seen.join(grown.select("head", "last"), ["head", "last"]))
        pairs = own.join(own.select("b", "head", F.col("last").alias("next")), ["b", "head"]).where(F.col("last") < F.col("next"))
        seen, k = pairs.select("b", "verdict", "n", F.concat("head", F.array("last")).alias("head"), F.col("next").alias("last")), k + 1
    found = reduce(DataFrame.unionByName, levels).select("items", "all", F.explode("told").alias("x")).select("items", "x.verdict", "x.both", "all")
    return found.where(F.col("both") >= least)


def mine(labelled: DataFrame, *, min_support: float = 0.002, min_count: int = MIN_COUNT, min_confidence: float = 0.9, min_lift: float = 1.05, partitions: int = 0) -> tuple[DataFrame, DataFrame]:
    """(items, verdict, confidence, support, n): token combinations that tell the verdict, of all frequent tokens of a url; and the heads of the frequent tokens (see ``heads``), which the items are.

    ``labelled`` has tokens (array<string>) and verdict ('block' or 'allow'; rows without one are left out). FP-growth over
    the tokens that reach the support and the verdict, or for long urls ``_free_sets``, with the same rules; the support is a share of the labelled urls, and never fewer than ``min_count`` of them; rules with enough support and confidence that beat the verdict's own share by
    ``min_lift`` stay, and of two rules with the same verdict, one with a subset of the other's tokens and
    at least its confidence replaces the longer.
    """
    labelled = cut(labelled.where(F.col("verdict").isNotNull()).select("tokens", "verdict"))
    total = labelled.count()
    empty = "items array<string>, verdict string, confidence double, support double, n int"
    if not total:
        return labelled.sparkSession.createDataFrame([], empty), labelled.sparkSession.createDataFrame([], "token string, head string, n long")
    least = max(min_support * total, min_count)
    kept = cut(heads(labelled, least))
    baskets = cut(_baskets(labelled, kept))
    # a hair below, so that a count of just the least is not lost to rounding
    if (baskets.agg(F.max(F.size("t"))).first()[0] or 0) <= MOST_ITEMS:
        both = _all_sets(baskets, min(1.0, max(0.0, (least - 1e-6) / total)), partitions)
    else:
        both = _free_sets(baskets, least - 1e-6)
    share = baskets.groupBy("verdict").agg((F.count(F.lit(1)) / total).alias("share"))
    rules = both.join(share, "verdict").withColumn("confidence", F.col("both") / F.col("all"))
    rules = rules.where((F.col("confidence") >= min_confidence) & (F.col("confidence") >= F.least(F.lit(1.0), min_lift * F.col("share"))))
    rules = cut(rules.select("items", "verdict", "confidence", (F.col("both") / total).alias("support"), F.size("items").alias("n")))
    # a longer rule goes if one with fewer of its tokens says the same at least as surely; matched by the index too
    return rules.join(_covered(rules), ["items", "verdict"], "left_anti").where(F.col("support") * total >= least - 1e-6), kept


def _covered(rules: DataFrame) -> DataFrame:
    short = rules.select(F.col("items").alias("part"), "verdict", F.col("confidence").alias("c"), F.col("n").alias("m"), F.element_at("items", 1).alias("token"))
    long = rules.select("items", "verdict", "confidence", "n", F.explode("items").alias("token"))
    pairs = long.join(short, ["token", "verdict"]).where((F.col("m") < F.col("n")) & (F.col("c") >= F.col("confidence")))
    return pairs.where(F.size(F.array_except("part", "items")) == 0).select("items", "verdict").distinct()


def judged(urls: DataFrame, rules: DataFrame, kept: DataFrame, *, default: str = "allow") -> DataFrame:
    """``urls`` (url, tokens) with mined_verdict: of the rules whose tokens a url has all, the surest, then the longest, then the commonest.

    A token counts as its head in ``kept``, so that a url with any of the tokens that one stood for in mining is matched.

    An inverted index lists each rule under its rarest token; a url looks up its own tokens there and checks
    the other tokens of what it finds. Urls without a fitting rule get ``default``.
    """
    count = rules.select(F.explode("items").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("k"))
    listed = rules.select("*", F.explode("items").alias("token")).join(count, "token")
    index = listed.groupBy("items", "verdict").agg(F.min(F.struct("k", "token")).alias("key"), F.first("confidence").alias("confidence"), F.first("support").alias("support"))
    index = cut(index.select(F.col("key.token").alias("token"), "items", "verdict", "confidence", "support"))
    own = urls.select("url", F.explode("tokens").alias("token")).join(kept, "token").groupBy("url").agg(F.collect_set("head").alias("tokens"))
    looked = own.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("items", "tokens")) == 0)
    best = F.max_by("verdict", F.struct("confidence", F.size("items"), "support", "verdict", F.array_join("items", " ")))
    told = looked.groupBy(F.col("url").alias("_u")).agg(best.alias("v"))
    return urls.join(told, F.col("url").eqNullSafe(F.col("_u")), "left").select(*urls.columns, F.coalesce("v", F.lit(default)).alias("mined_verdict"))


def untaught(tokens_, rule):
    """The tokens of a url that a stated rule has decided without those of the rule's own host and path, which can teach nothing but the rule."""
    own = F.filter(tokens(F.lit(None).cast("string"), F.substring_index(rule, "/", 1), F.substring(rule, F.instr(rule, "/"), F.length(rule))), lambda t: ~t.startswith("s:"))
    return F.array_except(tokens_, own)


def filter_urls(pages: DataFrame, *, rules=RULES, min_support: float = 0.002, min_count: int = MIN_COUNT, min_confidence: float = 0.9) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, mined_verdict) for every row of ``pages``.

    The urls that a stated rule decides are the labelled ones. FP-growth mines them, without the tokens of the rule's own host and path, for token combinations; the stated rule
    decides where one fits, and the mined rules judge all other urls, none of which they have seen. Where no mined rule fits either, the
    verdict is allow. A url is judged once however often it occurs. A null url, or one without ``://``, has an empty
    host and path and is judged by its scheme token alone; repeated rows and ids give one row each; an empty table
    gives none. Other columns are not read.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    urls = rows.groupBy("url").agg(F.count(F.lit(1)).alias("times")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    urls = with_hits(urls, rules).withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))
    urls = cut(urls.select("url", "host", "path", "hit", "tokens"))
    labelled = urls.where("hit is not null").select(untaught(F.col("tokens"), F.col("hit.rule")).alias("tokens"), F.col("hit.verdict").alias("verdict"))
    mined, kept = mine(labelled, min_support=min_support, min_count=min_count, min_confidence=min_confidence)
    decided = judged(urls.where("hit is null").select("url", "tokens"), mined, kept).select(F.col("url").alias("u"), "mined_verdict")
    told = urls.select("url", "host", "path", "hit").join(decided, F.col("url").eqNullSafe(F.col("u")), "left").drop("u")
    told = told.select(F.col("url").alias("u"), "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", "mined_verdict").alias("verdict"), "mined_verdict")
    return rows.join(told, F.col("url").eqNullSafe(F.col("u"))).drop("u")
