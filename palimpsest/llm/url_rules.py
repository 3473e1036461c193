"""URL filters from association rules, in DataFrame operations only.

Labelled urls become baskets of tokens (host labels, path segments, file endings,
query keys) with their label; FP-growth finds the frequent combinations, and rules
"tokens -> block" are kept by support, confidence and lift, less those that rest on
too few urls (the lower bound of the confidence, at 95 %, decides) and those that a
shorter rule with at least their confidence implies. An inverted index of the
rules, each under its rarest token, finds the rules of a url: equi-joins of the
distinct urls' tokens with the index, then a containment test. Rules of any number
of tokens are kept.

Fixed rules of (host, path) come first; the longest that fits decides.

Defined results: a url that is null or has no "://" has an empty host and path, no
tokens, no rule, and is allowed; repeated rows are judged alike; an empty table
gives an empty table; without a usable label no rule is mined.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import stored

#: Verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

SUPPORT, CONFIDENCE, LIFT = 0.002, 0.6, 1.5
#: The least lower bound of a rule's confidence, and the normal deviate of that bound.
SUREST_OF, DEVIATE = 0.5, 1.96
#: Up to so many rules the index is broadcast; beyond, it is joined by shuffle.
BROADCAST_RULES = 20_000
BLOCK = "label:block"


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end; A-Z in lower case."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.substring_index(F.substring_index(F.substring_index(after, "/", 1), "?", 1), "#", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to "?", "#" or the end."""
    after = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    bare = F.substring_index(F.substring_index(after, "?", 1), "#", 1)
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(bare, "^[^/]*(/[\\s\\S]*)$", 1)).otherwise(F.lit(""))


def tokens_of() -> Column:
    """Distinct tokens of columns host, path and url."""
    labels = F.transform(F.filter(F.split("host", "\\."), lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x))
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    segments = F.transform(parts, lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "#")))
    query = F.when(F.instr("url", "?") > 0, F.regexp_extract("url", "\\?([^#]*)", 1)).otherwise(F.lit(""))
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1)))
    scheme = F.array(F.concat(F.lit("scheme:"), F.lower(F.substring_index("url", "://", 1))))
    return F.when(F.instr("url", "://") > 0, F.array_distinct(F.concat(scheme, labels, segments, keys))).otherwise(F.array().cast("array<string>"))


def parsed(pages: DataFrame) -> DataFrame:
    """The distinct urls with host, path and tokens."""
    urls = pages.select(pages["url"].alias("url")).distinct()
    return urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).withColumn("tokens", tokens_of())


def fits(host: str, path: str) -> Column:
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.startswith("path", F.lit(path))


def fixed_rule(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in reversed(ordered):
        rule = F.when(fits(host, path), host + path).otherwise(rule)
        verdict = F.when(fits(host, path), kind).otherwise(verdict)
    return rule, verdict


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad): a page's path ends in the number of the document that it shows, but for a file ending or a slash; low quality or toxic is bad."""
    urls = parsed(pages).where("host <> ''").withColumn("doc_id", F.regexp_extract("path", "/([0-9]+)(?:\\.[A-Za-z]+)?/?$", 1).try_cast("bigint"))
    marks = labels.groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(F.max(F.when((labels["quality"] == 0) | (labels["toxic"] == 1), 1).otherwise(0)).alias("bad"))
    return urls.where("doc_id is not null").join(marks, "doc_id").select("url", "tokens", "bad")


def lower_bound(share: Column, n: Column, z: float = DEVIATE) -> Column:
    """Wilson's lower bound of a share seen in ``n`` cases."""
    middle = share + z * z / (2 * n)
    return (middle - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def mine(marked: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT) -> DataFrame:
    """(rule_id, tokens, confidence, support): what blocks, mined by FP-growth from ``marked`` (tokens, bad)."""
    baskets = stored(
        marked.where(F.size("tokens") > 0).select(F.when(F.col("bad") == 1, F.concat("tokens", F.array(F.lit(BLOCK)))).otherwise(F.col("tokens")).alias("items")), "url-baskets"
    )
    empty = "rule_id long, tokens array<string>, confidence double, support double"
    n = baskets.count()
    if n == 0:
        return marked.sparkSession.createDataFrame([], empty)
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    blocks = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCK) & (F.col("lift") >= lift))
    sure = blocks.where(lower_bound(F.col("confidence"), F.round(F.col("support") * n / F.col("confidence"))) >= SUREST_OF)
    rules = stored(sure.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support").withColumn("rule_id", F.xxhash64("tokens")), "url-rules")
    # A rule goes if a shorter one, whose tokens it holds, is at least as sure. The shorter one's rarest token leads to it.
    token = F.explode("tokens").alias("token")
    seen = rules.select(token).groupBy("token").agg(F.count("*").alias("seen"))
    keys = rules.select("rule_id", token).join(seen, "token").groupBy("rule_id").agg(F.min_by("token", F.struct("seen", "token")).alias("token"))
    short = rules.join(keys, "rule_id").select(F.col("tokens").alias("less"), F.col("confidence").alias("sure"), "token")
    long = rules.select("rule_id", "tokens", "confidence", token)
    implied = (
        long.join(short, "token")
        .where((F.size("less") < F.size("tokens")) & (F.col("sure") >= F.col("confidence")) & (F.size(F.array_except("less", "tokens")) == 0))
        .select("rule_id")
        .distinct()
    )
    return rules.join(implied, "rule_id", "left_anti")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined): for each url of ``urls`` (url, tokens) that some rule blocks, its surest rule."""
    counts = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("seen"))
    spread = rules.select("rule_id", "tokens", "confidence", F.explode("tokens").alias("token"))
    keyed = spread.join(counts, "token", "left").groupBy("rule_id").agg(
        F.first("tokens").alias("needs"), F.first("confidence").alias("confidence"), F.min_by("token", F.struct(F.coalesce("seen", F.lit(0)), "token")).alias("token")
    )
    index = stored(keyed, "url-rule-index")
    if index.count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    hits = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("needs", "tokens")) == 0)
    return hits.groupBy("url").agg(F.max_by(F.array_join("needs", " "), F.struct("confidence", "rule_id")).alias("mined"))


def url_filter(pages: DataFrame, marked: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and, beyond, the mined rule that fits."""
    urls = stored(parsed(pages), "urls")
    found = matched(urls, mine(marked))
    rule, verdict = fixed_rule(rules)
    judged = (
        urls.join(found, "url", "left")
        .withColumn("rule", rule)
        .withColumn("verdict", F.coalesce(verdict, F.when(F.col("mined").isNotNull(), "block").otherwise("allow")))
        .select("url", "rule", "verdict", "mined")
    )
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"))
    return (
        rows.join(judged, rows["url"].eqNullSafe(judged["url"]), "left")
        .select("page_id", rows["url"], "rule", "verdict", "mined")
        .withColumn("host", host_of(F.col("url")))
        .withColumn("path", path_of(F.col("url")))
        .select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), "mined")
    )
