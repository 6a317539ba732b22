"""URL filter by association rules; DataFrame functions only.

Explicit rules on host and path come first. For the urls that none fits, FP-growth mines frequent combinations of url
tokens together with the label of the page (the page's row in `labels`: bad if toxic or of low quality), and the rules
"tokens imply bad" that stay after pruning by support, confidence, lift over the share of bad pages and significance are
matched by an inverted index: a rule is posted under its rarest token, a url looks up its own tokens, and the other tokens
are verified. A rule that a shorter one implies fires for no further url, so it is left out.

Tokens that stand in the same labelled pages (say all those of one long url) have the same support in any combination, so
they are one item of the mining and any of them fires its rules: the rules fire for the same urls as all combinations would.
Combinations are mined from the bad pages alone, without the items that are rules themselves, and down to the support at which
a rule that is always right could still be significant; every item of a page takes part. Their confidence is counted on all
labelled pages.

`labels` is the only table that tells bad pages: its doc_id is taken as a page_id. Where the two number different things, the
rules say nothing about pages.
"""

from __future__ import annotations

import math
import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, written

#: (rule, allow or block); host and path in one, the longest that fits decides.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
SUPPORT = 0.002
#: Labelled pages that a frequent combination has, at least, where SUPPORT asks for fewer.
LEAST = 5
CONFIDENCE = 0.6
LIFT = 1.5
#: The share of bad pages lies so many standard errors below what a rule reaches (Wilson's bound), so that chance passes few of very many combinations;
#: for a combination so do the shares of its single items.
SIGNIFICANT = 4.0
_URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ? or #, A-Z lower-cased; empty where there is no ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def explicit(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls: a rule fits its host and all subdomains if the path starts with the rule's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):
        cut = text.index("/")
        fits = ((host == text[:cut]) | host.endswith("." + text[:cut])) & path.startswith(text[cut:])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column) -> Column:
    """Distinct lower-case runs of letters and digits of at least two characters, after the scheme."""
    rest = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"(?s)\A[a-z0-9+.-]*://", "")
    return F.array_sort(F.array_distinct(F.filter(F.split(rest, r"[^\p{L}\p{N}]+"), lambda x: F.length(x) >= 2)))


def lower_bound(hit: Column, n: Column, z: float = SIGNIFICANT) -> Column:
    """Wilson's lower bound of a share of which hit of n were counted."""
    p = hit / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def shortest(rules: DataFrame) -> DataFrame:
    """rules (antecedent, ...) without those that have another one's antecedent as a proper part."""
    rules = rules.withColumn("size", F.size("antecedent"))
    parts = rules.select(F.col("antecedent").alias("part"), F.col("size").alias("less"), F.element_at("antecedent", 1).alias("posted"))
    longer = rules.where("size > 1").select("antecedent", "size", F.explode("antecedent").alias("posted")).join(parts, "posted").where((F.col("less") < F.col("size")) & (F.size(F.array_except("part", "antecedent")) == 0))
    return rules.join(longer.select("antecedent").distinct(), "antecedent", "left_anti").drop("size")


def mine(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT, significant: float = SIGNIFICANT) -> tuple[DataFrame, DataFrame]:
    """Pruned rules (rule_id, antecedent, confidence, support, posted) that tell bad pages, and (token, item), the item of each token that a rule may have.

    The antecedent is an array of items, each named by its first token; posted is its rarest item. pages (page_id, url)
    learn from labels (doc_id, quality, toxic) of the same id; a page with several labels is bad if one is, a page that
    repeats counts as often. No labelled or no bad page gives no rules. Ties of rarity go by the token.
    """
    spark = pages.sparkSession
    marks = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)).alias("bad"))
    learnt = pages.select("page_id", "url").join(marks, "page_id").select(F.monotonically_increasing_id().alias("n"), "bad", tokens_of(F.col("url")).alias("tokens"))
    learnt = written(learnt, "labelled-urls")
    total, bad = learnt.agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0))).first()
    least = max(support * total, LEAST)
    # Tokens of the same pages have the same counts and the same two sums of the pages' hashes.
    hashed = lambda seed: F.sum(F.xxhash64(F.lit(seed), "n").cast("decimal(20,0)"))
    same = learnt.select("n", "bad", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("freq"), F.sum("bad").alias("bad"), hashed(1).alias("a"), hashed(2).alias("b"))
    same = same.where(F.col("freq") >= least)
    named = written(same.join(same.groupBy("freq", "bad", "a", "b").agg(F.min("token").alias("item")), ["freq", "bad", "a", "b"]).select("token", "item", "freq", "bad"), "url-tokens")
    single = named.where("token = item")
    schema = "rule_id long, antecedent array<string>, confidence double, support double, posted string"
    if not bad or bad == total:
        return spark.createDataFrame([], schema), named.select("token", "item")
    base = bad / total
    good = lambda hit, n, over: (hit >= least) & (hit / n >= confidence) & (hit / n >= lift * base) & (lower_bound(hit, n, significant) > over)
    figures = lambda hit, n: ((hit / n).alias("confidence"), (hit / total).alias("support"))
    ones = single.where(good(F.col("bad"), F.col("freq"), F.lit(base))).select(F.array("item").alias("antecedent"), *figures(F.col("bad"), F.col("freq")))
    # The bound of a rule that is right k times of k is k / (k + z^2): with fewer it isn't above the base.
    enough = max(least, significant * significant * base / (1 - base))
    rest = named.where(F.col("bad") >= enough).join(ones.select(F.col("antecedent")[0].alias("item")), "item", "left_anti").select("token", "item")
    of = written(learnt.select("n", "bad", F.explode("tokens").alias("token")).join(rest, "token").select("n", "bad", "item").distinct(), "url-items")
    own = of.groupBy("n", "bad").agg(F.array_sort(F.collect_set("item")).alias("items"))
    taught = own.where("bad = 1").select("items")
    # Half a page less than whole ones, so that rounding can't ask for one more.
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (math.ceil(enough) - 0.5) / max(taught.count(), 1)), minConfidence=0.0).fit(taught)
    # The mining knows the bad pages that have a combination; how many pages have it at all is counted here.
    sets = model.freqItemsets.where(F.size("items") > 1).select(F.array_sort("items").alias("antecedent")).withColumn("posted", F.element_at("antecedent", 1))
    met = own.select("bad", "items", F.explode("items").alias("posted")).join(sets, "posted").where(F.size(F.array_except("antecedent", "items")) == 0)
    many = met.groupBy("antecedent").agg(F.count("*").alias("freq"), F.sum("bad").alias("bad")).where(good(F.col("bad"), F.col("freq"), F.lit(base)))
    # What one of its items tells alone is no merit of the combination.
    alone = many.select("antecedent", F.explode("antecedent").alias("item")).join(single.select("item", (F.col("bad") / F.col("freq")).alias("share")), "item").groupBy("antecedent").agg(F.max("share").alias("share"))
    many = many.join(alone, "antecedent").where(lower_bound(F.col("bad"), F.col("freq"), significant) > F.col("share"))
    many = shortest(written(many.select("antecedent", *figures(F.col("bad"), F.col("freq"))), "url-combinations"))
    rules = written(ones.union(many).withColumn("rule_id", F.xxhash64("antecedent")), "url-rules")
    rarest = rules.select("rule_id", F.explode("antecedent").alias("item")).join(single.select("item", "freq"), "item").groupBy("rule_id").agg(F.min(F.struct("freq", "item"))["item"].alias("posted"))
    return rules.join(rarest, "rule_id").select("rule_id", "antecedent", "confidence", "support", "posted"), named.select("token", "item")


def fired(urls: DataFrame, rules: DataFrame, named: DataFrame) -> DataFrame:
    """(url, confidence, n_rules, antecedent) for the distinct urls of a column `url` in which rules of mine() fire; antecedent is the most confident one, of these the last in order."""
    own = urls.select("url").where("url is not null").distinct().select("url", F.explode(tokens_of(F.col("url"))).alias("token"))
    own = own.join(named, "token").groupBy("url").agg(F.collect_set("item").alias("items"))
    met = own.select("url", "items", F.explode("items").alias("posted")).join(rules, "posted").where(F.size(F.array_except("antecedent", "items")) == 0)
    best = F.max(F.struct("confidence", F.array_join("antecedent", " ").alias("antecedent")))
    return met.groupBy("url").agg(best.alias("best"), F.count("*").alias("n_rules")).select("url", F.col("best.confidence").alias("confidence"), "n_rules", F.col("best.antecedent").alias("antecedent"))


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """pages (page_id, url) with host, path, rule, verdict, mined (the tokens of the mined rule, if one blocks) and confidence.

    A null url, or one without ://, has an empty host and path; without any rule that fires the verdict is allow.
    """
    own = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = explicit(F.col("host"), F.col("path"), rules)
    own = own.select("*", rule.alias("rule"), verdict.alias("told"))
    hits = fired(own.where("told is null"), *mine(pages, labels, support, confidence))
    mined = F.when(F.col("told").isNull(), F.col("antecedent"))
    return own.join(hits, "url", "left").select("page_id", "host", "path", "rule", F.coalesce("told", F.when(mined.isNotNull(), "block"), F.lit("allow")).alias("verdict"), mined.alias("mined"), F.when(mined.isNotNull(), F.col("confidence")).alias("confidence"))


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return judge(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"))
