"""URL filter: prefix rules first, then association rules mined with FP-growth (operator 4)."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.session import cut_lineage

# Fixed values: (verdict, host, path) of the given rules.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

MIN_SUPPORT = 0.002  # of the labelled urls
MIN_COUNT = 20  # labelled urls that hold all tokens of a rule
MIN_CONFIDENCE = 0.7
BAD = "label:bad"


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, rest after the path); empty without `://`."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, r"(?s)^[^?#]*(.*)$", 1)


def prefix_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule whose host is the url's or above it and whose path begins the url's; else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # longer ones are asked first
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def url_tokens(host: Column, path: Column, tail: Column) -> Column:
    """Distinct tokens: every domain suffix, host words, path words with numbers as one kind, query keys, shape."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(labels, lambda x, i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))
    host_words = F.transform(F.filter(F.split(host, r"[.-]"), lambda x: x != ""), lambda x: F.concat(F.lit("word:"), x))
    parts = F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    steps = F.transform(parts, lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, r"\p{N}+", "0")))
    keys = F.transform(F.regexp_extract_all(tail, F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("key:"), F.lower(x)))
    shape = F.array(F.when(F.instr(tail, "#") > 0, F.lit("has:fragment")).otherwise(F.when(path.endswith("/"), F.lit("has:folder")).otherwise(F.lit("has:file"))))
    return F.array_distinct(F.concat(suffixes, host_words, steps, keys, shape))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (tokens, confidence, n) for bad urls from rows (tokens, bad).

    All tokens that are frequent enough to be in a rule enter mining. Tokens that are on the
    same urls are one item, so the words of a template do not span all their subsets; its
    rules are given for each of the tokens. A rule goes if a part of it has its confidence
    already. Subsets grow with two to the number of items that are on the same frequent urls.
    """
    rows = cut_lineage(labelled.select(F.monotonically_increasing_id().alias("_row"), "tokens", "bad"))
    total = rows.agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("int")).alias("k")).first()
    n, k = total["n"], total["k"] or 0
    schema = "tokens array<string>, confidence double, n bigint"
    spark = labelled.sparkSession
    least = max(min_count, min_support * n)
    if not k or n < least:
        return spark.createDataFrame([], schema)
    single = rows.select("_row", "bad", F.explode("tokens").alias("token"))
    # two hashes of the set of rows: equal for tokens that are on the same rows
    rows_of = [F.bit_xor(F.xxhash64(F.lit(k), "_row")).alias(f"h{k}") for k in (1, 2)]
    often = single.groupBy("token").agg(F.count("*").alias("c"), *rows_of).filter(F.col("c") >= least)
    classes = cut_lineage(often.groupBy("c", "h1", "h2").agg(F.min("token").alias("token"), F.sort_array(F.collect_list("token")).alias("members")).select("token", "members"))
    picked = single.join(classes.select("token"), "token").groupBy("_row", "bad").agg(F.collect_list("token").alias("_l"))
    items = picked.select(F.when(F.col("bad"), F.concat("_l", F.array(F.lit(BAD)))).otherwise(F.col("_l")).alias("items"))
    # support of a rule counts its bad urls; confidence and count are checked on the rules below
    model = FPGrowth(itemsCol="items", minSupport=max(1e-9, least * min_confidence / n), minConfidence=min_confidence).fit(items)
    rules = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BAD)))
    rules = rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", F.round(F.col("support") * n / F.col("confidence")).cast("bigint").alias("n")).filter(F.col("n") >= least)
    rules = cut_lineage(rules)
    # a part of a rule shares its first token of the part's list: inverted index on that token
    part = rules.select(F.col("tokens").alias("_p"), F.col("confidence").alias("_c"), F.element_at("tokens", 1).alias("_k"))
    whole = rules.select("*", F.explode("tokens").alias("_k"))
    covered = whole.join(part, "_k").filter((F.size("_p") < F.size("tokens")) & (F.col("_c") >= F.col("confidence")) & (F.size(F.array_except("_p", "tokens")) == 0))
    rules = rules.join(covered.select("tokens").distinct(), "tokens", "left_anti")
    # a rule for each choice of a token from each of its items
    each = rules.select("tokens", "confidence", "n", F.explode("tokens").alias("token")).join(classes, "token").groupBy("tokens", "confidence", "n").agg(F.collect_list("members").alias("_m"))
    choices = F.aggregate("_m", F.array(F.array().cast("array<string>")), lambda done, own: F.flatten(F.transform(done, lambda d: F.transform(own, lambda t: F.concat(d, F.array(t))))))
    return each.select(F.explode(choices).alias("tokens"), "confidence", "n").select(F.array_sort("tokens").alias("tokens"), "confidence", "n")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, confidence) of the surest rule that each row (url, tokens) meets, by an inverted index.

    A rule is filed under its rarest token among the urls, so a common token is nobody's key
    unless a rule has nothing rarer.
    """
    posted = urls.select("url", F.explode("tokens").alias("token"))
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    often = posted.join(wanted, "token").groupBy("token").agg(F.count("*").alias("c"))
    filed = rules.select("tokens", "confidence", F.explode("tokens").alias("token")).join(often, "token")
    filed = filed.groupBy("tokens", "confidence").agg(F.min_by("token", F.struct("c", "token")).alias("token")).withColumnRenamed("tokens", "_rule")
    hits = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(filed, "token")
    return hits.filter(F.size(F.array_except("_rule", "tokens")) == 0).groupBy("url").agg(F.max("confidence").alias("confidence"))


def filter_urls(pages: DataFrame, labels: DataFrame, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """Verdict of every url: key, host, path, rule, verdict, confidence.

    The longest prefix rule decides; other urls are blocked if they meet a mined rule
    (`confidence` is that of the surest one), else allowed. A labelled url is bad if its label
    row (same key) says toxic 1 or quality 0. One row per input row. Null urls and urls
    without `://` have empty host and path, no tokens but their shape, and are judged like
    others; repeated rows are judged each; a null key is kept but never labelled; without
    labels nothing is mined and the method allows; an empty table gives none; other columns,
    and page texts, are not read.
    """
    host, path, tail = split_url(F.col("_u"))
    rows = pages.select(F.col(key).alias("_k"), F.coalesce(F.col(url), F.lit("")).alias("_u"))
    rows = rows.select("_k", F.col("_u").alias("url"), host.alias("host"), path.alias("path"), url_tokens(host, path, tail).alias("tokens"))
    known = labels.select(F.col("doc_id").alias("_k"), F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False)).alias("bad"))
    known = known.filter("_k is not null").groupBy("_k").agg(F.max("bad").alias("bad"))
    mined = cut_lineage(mine_rules(rows.join(known, "_k").select("tokens", "bad")))
    found = match_rules(rows.select("url", "tokens").distinct(), mined)
    judged = rows.join(found, "url", "left").withColumn("_p", prefix_rule(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(F.col("_k").alias(key), "host", "path", F.col("_p.rule").alias("rule"), F.coalesce(F.col("_p.verdict"), method).alias("verdict"), "confidence")
