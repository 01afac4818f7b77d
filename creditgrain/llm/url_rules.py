"""URL filtering by association rules, with DataFrame functions and Spark ML only.

A url becomes a set of tokens (scheme, host, its last two labels, its first label,
path words, query keys). FP-growth mines the token combinations of the blocked pages,
so only sets with the label are listed, and every combination found is counted again over
all labelled pages. Those on ``SUPPORT`` blocked pages, of which the share ``CONFIDENCE``
is blocked and, by the lower end of its interval, more than of all pages, become rules.
Support is a number of pages, so more labels only add rules. A page is matched through an
inverted index: every rule is filed under its rarest token, so a page looks up only the
rules of its own tokens and checks the other tokens of each.

No token of a page is left out. What keeps the listing short changes no verdict: tokens on
the same labelled pages are one item, which a url has if it has any of them; and a token
that is a rule by itself is in no longer one, as a page with that is matched already. What
is left are combinations of tokens of which none tells enough alone; urls that share many
such tokens in many mixtures take time that grows with the number of those mixtures.

Pages are labelled by the row of ``labels`` with their number: bad quality or toxic
text means block. Explicit (host, path) rules come first, the longest one winning.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from creditgrain.session import store

from .common import table

SUPPORT = 4
CONFIDENCE = 0.6
Z = 1.64  # standard errors below the share of blocked pages
# Fixed values: (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or NULLs."""
    name = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = (
            (host == rule_host) | F.concat(F.lit("."), host).endswith("." + rule_host)
        ) & F.substring(path, 1, len(rule_path)).eqNullSafe(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a url in order; numbers count as one word."""
    text = F.coalesce(url, F.lit(""))
    host, path = host_of(text), path_of(text)
    labels = F.split(host, r"\.")
    word = lambda w: F.regexp_replace(F.lower(w), "[0-9]+", "0")
    marked = lambda mark, values: F.transform(F.filter(values, lambda v: v != ""), lambda v: F.concat(F.lit(mark), v))
    keys = F.transform(F.split(F.regexp_extract(text, r"\?([^#]*)", 1), "&"), lambda v: F.substring_index(v, "=", 1))
    return F.array_sort(
        F.array_distinct(
            F.concat(
                marked("scheme:", F.array(F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)))),
                marked("host:", F.array(host)),
                marked("site:", F.array(F.substring_index(host, ".", -2))),
                marked("first:", F.slice(labels, 1, 1)),
                marked("path:", F.transform(F.split(path, "/"), word)),
                marked("key:", keys),
            )
        )
    )


def held_rules(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Each of the token sets (column ``tokens``, others stay) with each rule whose tokens it holds."""
    words = rules.select("rule", F.explode("rule").alias("token"))
    uses = sets.select(F.explode("tokens").alias("token")).groupBy("token").count()
    rarest = words.join(uses, "token").groupBy("rule").agg(F.min_by("token", F.struct("count", "token")).alias("token"))
    return (
        sets.select("*", F.explode("tokens").alias("token"))
        .join(rarest, "token")
        .where(F.size(F.array_except("rule", "tokens")) == 0)
        .drop("token")
    )


def stand_ins(labelled: DataFrame, support: int = SUPPORT) -> DataFrame:
    """token, item: the tokens on ``support`` blocked pages, and the first of all that are on the same labelled pages.

    Pages are compared by sums of the halves of a hash, which count repeated pages too.
    """
    mark = F.xxhash64("page")
    stats = (
        labelled.select("block", mark.alias("mark"), F.explode("tokens").alias("token"))
        .groupBy("token")
        .agg(
            F.count(F.lit(1)).alias("pages"),
            F.count_if("block").alias("blocked"),
            F.sum(F.shiftright("mark", 32)).alias("high"),
            F.sum(F.col("mark").bitwiseAND(F.lit((1 << 32) - 1))).alias("low"),
        )
        .where(F.col("blocked") >= support)
    )
    return stats.select("token", F.min("token").over(Window.partitionBy("pages", "blocked", "high", "low")).alias("item"))


def with_items(sets: DataFrame, stands: DataFrame) -> DataFrame:
    """The distinct token sets (``tokens``) that have any item, with their ``items``."""
    words = sets.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token"))
    return words.join(stands, "token").groupBy("tokens").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _telling_items(words: DataFrame, support: int, telling: int) -> DataFrame:
    """The ``telling`` tokens of the highest confidence of each blocked page, one of those that always stand together."""
    bad = F.when(F.col("block"), F.col("page"))
    stats = words.groupBy("token").agg(
        F.count(F.lit(1)).alias("pages"), F.count(bad).alias("blocked"), F.bit_xor(bad).alias("mark"), F.sum(bad % (1 << 31)).alias("sum")
    )
    # Tokens with equal marks are on the same blocked pages: the one on the fewest others stands for them.
    alone = stats.where(F.col("blocked") >= support).groupBy("blocked", "mark", "sum").agg(F.min(F.struct("pages", "token")).alias("least"))
    share = (F.col("blocked") / F.col("least.pages")).alias("share")
    return (
        words.where("block")
        .join(alone.select(F.col("least.token").alias("token"), share), "token")
        .groupBy("page")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("share")).alias("order"), "token"))).alias("all"))
        .select(F.slice("all.token", 1, telling).alias("items"))
    )


def mine(labelled: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, telling: int | None = None) -> DataFrame:
    """Rules (rule, pages, blocked) that imply block: their tokens, and the labelled and blocked pages that hold them.

    ``labelled`` has ``tokens``, a boolean ``block`` and ``page``, an integer of its own for
    each page. It is read several times and had better be stored. Empty input: no rules.
    Of rules that hold a token which is one by itself only that token is listed. A caller may
    ask for less, rules among each page's ``telling`` tokens of the highest confidence, which
    lists all of those; ties between tokens go to the first by their text.
    """
    none = labelled.sparkSession.createDataFrame([], "rule array<string>, pages long, blocked long")
    total, blocked = labelled.agg(F.count(F.lit(1)), F.count_if("block")).first()
    if blocked < support:
        return none
    n, p = F.col("pages"), F.col("blocked") / F.col("pages")
    low = (p + Z * Z / (2 * n) - Z * F.sqrt((p * (1 - p) + Z * Z / (4 * n)) / n)) / (1 + Z * Z / n)
    tells = (F.col("blocked") >= support) & (p >= confidence) & (low > blocked / total)
    words = labelled.select("page", "block", F.explode("tokens").alias("token"))
    alone = none
    if telling is not None:
        items = _telling_items(words, support, telling)
    else:
        bad = F.when(F.col("block"), F.col("page"))
        stats = words.groupBy("token").agg(F.count(F.lit(1)).alias("pages"), F.count(bad).alias("blocked"), F.count_distinct(bad).alias("apart"))
        stats = store(stats.where(F.col("apart") >= support).withColumn("tells", tells), "url-tokens")
        alone = stats.where("tells").select(F.array("token").alias("rule"), "pages", "blocked")
        items = words.where("block").join(stats.where("not tells").select("token"), "token").groupBy("page").agg(F.collect_set("token").alias("items"))
        items = store(items.where(F.size("items") > 1).select("items"), "url-items")
    if not items.limit(1).count():
        return alone
    wanted = (support - 0.5) / max(1, items.count())
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, wanted)).fit(items).freqItemsets
    candidates = found.select(F.array_sort("items").alias("rule"))
    sets = labelled.groupBy("tokens").agg(F.count(F.lit(1)).alias("pages"), F.count_if("block").alias("blocked"))
    counted = held_rules(sets, candidates).groupBy("rule").agg(F.sum("pages").alias("pages"), F.sum("blocked").alias("blocked"))
    return alone.unionByName(counted.where(tells))


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """The token sets (column ``tokens``) that hold all tokens of some rule."""
    return held_rules(sets.select("tokens"), rules).select("tokens").distinct()


def filter_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules=RULES,
    support: int = SUPPORT,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """A row per page: page_id, host, path, rule, verdict, mined.

    ``mined`` says whether an association rule matched. A NULL url or one without
    ``://`` has empty host and path, fits no rule, and is allowed unless a mined
    rule matches its tokens. Without labels nothing is mined. Of explicit rules of equal
    length the later one wins; repeated pages are judged alike and each give a row.
    """
    base = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    tokenised = base.withColumn("tokens", tokens_of(F.col("url")))
    marks = labels.groupBy(F.col("doc_id").cast("bigint").alias("page_id")).agg(
        F.max(F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("block")
    )
    page = F.xxhash64("page_id", "url").alias("page")
    labelled = store(tokenised.join(marks, "page_id").select("tokens", "block", page), "labelled-pages")
    sets = store(with_items(tokenised, stand_ins(labelled, support)), "token-sets")
    # Pages without an item count among all pages.
    itemised = labelled.join(sets, "tokens", "left").select(F.coalesce("items", F.array().cast("array<string>")).alias("tokens"), "block", "page")
    mined = store(mine(store(itemised, "labelled-items"), support, confidence), "url-rules")
    held = held_rules(sets.withColumnsRenamed({"tokens": "url_tokens", "items": "tokens"}), mined)
    matched = held.select(F.col("url_tokens").alias("tokens")).distinct().withColumn("mined", F.lit(True))
    name, says = rule_of(F.col("host"), F.col("path"), rules)
    return (
        tokenised.join(matched, "tokens", "left")
        .select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.coalesce("mined", F.lit(False)).alias("mined"))
        .select(
            "page_id",
            "host",
            "path",
            name.alias("rule"),
            F.coalesce(says, F.when(F.col("mined"), "block").otherwise("allow")).alias("verdict"),
            "mined",
        )
    )


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
