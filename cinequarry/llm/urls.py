"""URL filter: host and path rules, then the ratio of two character models.

DataFrame functions only: no Python runs on executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, salt_of

#: (rule, verdict): host, then a path that the url's path has to start with.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: Characters of context at most.
ORDER = 4
#: Weight of the shorter context's estimate within a longer one's.
BACKOFF = 2.0
#: Possible characters: those of ASCII, one for all others.
ALPHABET = 129
#: Log ratios of single places are held in whole 1 / SCALE, so a sum doesn't depend on its order.
SCALE = 1_000_000
#: Grams that are found by a broadcast table: the most frequent ones. All others meet their row over a shuffle, where none is then frequent.
FREQUENT = 16_384
#: Thresholds are tried at whole multiples of 1 / STEPS.
STEPS = 100


def split_url(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null and without ``://``."""
    url = F.col(url) if isinstance(url, str) else url
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, of equals the first given; null if none fits."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in reversed(sorted(rules, key=lambda r: -len(r[0]))):
        h, _, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(f"/{p}"))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def grams(url: Column) -> Column:
    """For each character of a url and its end, the character after its ORDER predecessors
    (array<string>). Digits are one character, so are all beyond ASCII; the start is padded."""
    text = F.translate(F.regexp_replace(F.coalesce(url, F.lit("")), r"[^\x00-\x7F]", "\u0080"), "\u0002\u0003123456789", "\u0001\u0001000000000")
    padded = F.concat(F.lit("\u0002" * ORDER), text, F.lit("\u0003"))
    return F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{ORDER + 1}}}))"), F.lit(1))


def trains(url: Column) -> Column:
    """Half of the urls train the models, the other half calibrates the threshold."""
    return F.substring(F.md5(F.coalesce(url, F.lit(""))), 1, 1) < "8"


def log_ratios(counted: DataFrame) -> DataFrame:
    """(gram, lr: long): SCALE * (log p(accepted) - log p(rejected)) of each gram's last
    character after its others, for grams (gram, allow, block) with their counts.

    The estimate with a longer context takes in that of the shorter one by BACKOFF; a
    context that was never seen leaves the shorter one's as it is, so orders vary from
    place to place. Counts of shorter contexts are sums of the longer ones'. All of it is
    joins of counted tables, which grow with what the urls hold."""
    sums = [F.sum("allow").alias("allow"), F.sum("block").alias("block")]
    tables = [counted.select("gram", "allow", "block")]
    for n in range(ORDER, 0, -1):
        tables.append(tables[-1].groupBy(F.substring("gram", 2, n).alias("gram")).agg(*sums))
    below: DataFrame | None = None
    for n, table in enumerate(reversed(tables)):
        context, rest = F.substring("gram", 1, n), F.substring("gram", 2, n)
        totals = table.groupBy(context.alias("context")).agg(F.sum("allow").alias("all_allow"), F.sum("block").alias("all_block"))
        df = table.withColumn("context", context).join(totals, "context")
        if below is None:
            df = df.withColumns({"p_allow": F.lit(1.0 / ALPHABET), "p_block": F.lit(1.0 / ALPHABET)})
        else:
            df = df.withColumn("rest", rest).join(below, "rest")
        mixed = lambda k: ((F.col(k) + F.col(f"p_{k}") * BACKOFF) / (F.col(f"all_{k}") + BACKOFF)).alias(f"p_{k}")
        below = df.select(F.col("gram").alias("rest"), mixed("allow"), mixed("block"))
    return below.select(F.col("rest").alias("gram"), F.round(F.log(F.col("p_allow") / F.col("p_block")) * SCALE).cast("long").alias("lr"))


def threshold(scores: DataFrame) -> float:
    """The least score of an accepted url: where the mean of both classes' shares judged
    right is best over the histogram of scores (verdict, score), in steps of 1 / STEPS; halfway
    down to the next lower score. With urls of one kind only nothing is blocked."""
    by = scores.groupBy(F.floor(F.col("score") * STEPS).alias("s")).agg(F.count_if(F.col("verdict") == "allow").alias("allow"), F.count_if(F.col("verdict") == "block").alias("block"))
    below, whole = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()  # a row for each step that occurs
    by = by.select("s", F.lag("s").over(Window.orderBy("s")).alias("last"), *[F.coalesce(F.sum(k).over(below), F.lit(0)).alias(f"u_{k}") for k in ("allow", "block")], *[F.sum(k).over(whole).alias(f"n_{k}") for k in ("allow", "block")])
    right = (F.col("n_allow") - F.col("u_allow")) / F.col("n_allow") + F.col("u_block") / F.col("n_block")
    best = by.where("n_allow > 0 and n_block > 0").select(right.alias("right"), "s", "last").orderBy(F.desc("right"), "s").first()
    if best is None:
        return float("-inf")
    return (best.s if best.last is None else (best.s + best.last + 1) / 2) / STEPS


def scored(urls: DataFrame) -> tuple[DataFrame, float]:
    """(url, score: double) of distinct urls (url, verdict: allow, block or null) that don't
    train the models, and the threshold of the half of the judged ones among them.

    Grams are counted over all urls of the training half; a url's score is the mean of its
    places' log ratios. The most frequent grams, of which every url may hold some, are looked
    up in a broadcast table of FREQUENT rows; all others are joined over a shuffle."""
    urls = urls.withColumn("g", grams(F.col("url"))).withColumn("trains", trains(F.col("url")) & F.col("verdict").isNotNull())
    each = materialize(urls.select("url", "verdict", "trains", F.size("g").alias("n"), F.explode("g").alias("gram")), "url-grams")
    here = lambda v: F.count_if(F.col("trains") & (F.col("verdict") == v)).alias(v)
    counted = materialize(each.groupBy("gram").agg(here("allow"), here("block"), F.count(F.lit(1)).alias("times")), "gram-counts")
    told = materialize(log_ratios(counted).join(counted.select("gram", "times"), "gram"), "gram-ratios")
    top = materialize(told.orderBy(F.desc("times"), "gram").limit(FREQUENT).select("gram", "lr"), "frequent-grams")
    wanted = each.where(~F.col("trains")).select("url", "verdict", "n", "gram")
    looked = wanted.join(F.broadcast(top), "gram", "left")
    rare = looked.where("lr is null").drop("lr").join(told.select("gram", "lr"), "gram")
    found = looked.where("lr is not null").select("url", "verdict", "n", "lr").union(rare.select("url", "verdict", "n", "lr"))
    sums = materialize(found.groupBy("url", "verdict", "n").agg(F.sum("lr").alias("lr")).select("url", "verdict", (F.col("lr") / F.col("n") / SCALE).alias("score")), "url-scores")
    return sums.select("url", "score"), threshold(sums.where("verdict is not null"))


def judge(pages: DataFrame, url_col: str = "url", id_col: str = "page_id", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """``pages`` with host, path, rule (null if none fits), verdict (allow or block) and
    score (double: mean log ratio of the two models, null for urls that trained them).

    The rule's verdict stands; other urls are allowed from the calibrated threshold on.
    Models and threshold come from the urls that rules decide: one half of them, by a hash
    of the url, trains, the other calibrates. A null url and one without ``://`` have an
    empty host and path, no rule, and are judged by the models like any other. Equal urls
    are judged once and joined back by (url, salt of the id), as one may hold a third of
    all rows. Other columns pass through; columns of
    these names are replaced, and those named _url, _salt and _r dropped."""
    host, path = split_url(url_col)
    df = pages.drop(*{"_url", "_salt", "_r"} - {url_col}).withColumn("host", host).withColumn("path", path)
    df = df.withColumn("_r", rule_for(F.col("host"), F.col("path"), rules)).withColumn("_url", F.coalesce(F.col(url_col), F.lit("")))
    df = df.withColumn("_salt", salt_of(F.col(id_col)))
    met = materialize(df.groupBy(F.col("_url").alias("url"), F.col("_r.verdict").alias("verdict"), "_salt").agg(F.count(F.lit(1)).alias("rows")), "urls-met")
    scores, least = scored(met.select("url", "verdict").distinct())
    scores = met.select("url", "_salt").distinct().join(scores, "url").select(F.col("url").alias("_url"), "_salt", "score")
    df = df.drop("score").join(scores, ["_url", "_salt"], "left")
    by_model = F.when(F.col("score") >= F.lit(least), "allow").otherwise("block")
    df = df.withColumn("rule", F.col("_r.rule")).withColumn("verdict", F.coalesce(F.col("_r.verdict"), by_model))
    return df.drop("_r", "_url", "_salt")
