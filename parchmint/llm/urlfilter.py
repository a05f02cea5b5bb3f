"""10. URL filter, in DataFrame functions only: rules by host suffix and path prefix, else logistic regression on n-grams.

The features of a URL are the hashed 3- to 5-grams of its host (between ^ and $) and the 3- and 4-grams of its path, apart from
one another, as a set. The model is fitted to a small labelled table (a DataFrame of url and blocked): the examples' common
features are counted by a join on the bucket, gradient steps of the dual coefficients run in one aggregate() over that small
matrix, and the coefficients are summed to a weight per bucket. Only the weights (2**BITS numbers) are broadcast, as a constant.

Defined results: a null url, or one without "://", has an empty host and path, no rule, and the verdict of the method for no
features (allow). Repeated rows are judged alike; other columns of the input pass through, except those named as a result.
A URL of any length is read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.llm.common import prefixed, read, restored

#: Rules (host, path, verdict); of those that fit, the longest wins.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Labelled hosts and paths: 1 is to be blocked.
EXAMPLES = (
    ("http://free-casino.example/slots", 1), ("https://casino-bonus.example/win-big", 1), ("http://online-bets.example/odds", 1),
    ("https://www.best-bets.example/free", 1), ("http://win-jackpot.example/play", 1), ("https://poker-win.example/", 1),
    ("http://cheap-pills.example/buy", 1), ("https://www.pills-online.example/order", 1), ("http://cheap-meds.example/no-rx", 1),
    ("http://buy-cheap.example/sale", 1), ("https://spam-links.example/farm", 1), ("http://link-farm.example/page", 1),
    ("http://spam-mail.example/list", 1), ("https://ads-server.example/click", 1), ("http://ads-track.example/pixel", 1),
    ("http://track-click.example/ads", 1), ("https://adult-cams.example/xxx", 1), ("http://xxx-video.example/hot", 1),
    ("http://free-loans.example/payday", 1), ("https://payday-loan.example/apply", 1), ("http://malware-site.example/download.exe", 1),
    ("http://warez-crack.example/keygen", 1), ("https://click-bait.example/win", 1), ("http://free-gift.example/claim", 1),
    ("http://casino-online.example/en/12", 1), ("https://www.royal-casino.example/fr/7", 1), ("http://casino-play.example/", 1),
    ("https://big-win.example/de/31", 1), ("http://spam-blast.example/en/4", 1), ("https://seo-spam.example/es/9", 1),
    ("http://content-farm.example/en/55", 1), ("https://click-farm.example/en/8", 1), ("http://adult-chat.example/en/6", 1),
    ("https://adult-video.example/fr/2", 1), ("http://sports-bets.example/en/1", 1), ("http://diet-pills.example/de/3", 1),
    ("https://pop-ads.example/en/77", 1), ("http://user-track.example/en/5", 1), ("https://cheap-watches.example/es/1", 1),
    ("https://www.mathematics.example/en/12", 0), ("http://the-gazette.example/en/4", 0), ("https://m.northern.example/de/8", 0),
    ("http://blog.weathered.example/fr/5", 0), ("https://other.example/es/33", 0), ("http://thanks.example/en/90", 0),
    ("https://www.thicket.example/en/71", 0), ("http://m.earth.example/en/19", 0), ("https://brother.example/fr/66", 0),
    ("http://blog.ethics.example/de/2", 0), ("https://www.method.example/en/45", 0), ("http://mother.example/es/7", 0),
    ("https://www.university.example/research", 0), ("https://docs.python-guide.example/tutorial", 0), ("http://www.museum.example/history", 0),
    ("https://blog.gardening.example/roses", 0), ("https://news.herald.example/world", 0), ("http://library.example/catalogue", 0),
    ("https://en.encyclopedia.example/wiki/river", 0), ("https://www.weather.example/forecast", 0), ("http://recipes.kitchen.example/soup", 0),
    ("https://forum.cycling.example/thread", 0), ("https://www.government.example/law", 0), ("http://m.travel.example/cities", 0),
    ("https://science.journal.example/article", 0), ("https://www.orchestra.example/concerts", 0), ("http://blog.thoughts.example/notes", 0),
    ("https://m.stories.example/tales", 0), ("http://www.theatre.example/plays", 0), ("https://health.clinic.example/advice", 0),
    ("https://school.district.example/parents", 0), ("http://www.thesaurus.example/words", 0), ("https://another.example/index.html", 0),
    ("https://blog.nation.example/page?id=1", 0), ("http://www.thread.example/en/1", 0), ("https://station.example/fr/2", 0),
)
BITS = 15
#: Gradient steps, their size and the weight of the quadratic penalty.
STEPS = 150
RATE = 0.3
PENALTY = 0.002
THRESHOLD = 0.5
_RESULTS = ("host", "path", "rule", "verdict", "score")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; A-Z lower-cased."""
    rest = F.when(url.contains("://"), F.expr(f"substring({_name(url)}, instr({_name(url)}, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _name(c: Column) -> str:
    return "`__url`"


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    rest = F.when(url.contains("://"), F.expr(f"substring({_name(url)}, instr({_name(url)}, '://') + 3)")).otherwise(F.lit(""))
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def parsed(rows: DataFrame, url: str = "url") -> DataFrame:
    """`rows` with host and path."""
    keep = [f"`{c}`" for c in rows.columns if c not in _RESULTS]
    named = rows.select(*keep, F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("__url"))
    return named.withColumns({"host": host_of(F.col("__url")), "path": path_of(F.col("__url"))}).drop("__url")


def _grams(text: Column, n: int, kind: str) -> Column:
    at = F.sequence(F.lit(1), F.char_length(text) - (n - 1))
    grams = F.transform(at, lambda i: F.pmod(F.xxhash64(F.lit(f"{kind}{n}"), F.substring(text, i, F.lit(n))), F.lit(1 << BITS)).cast("int"))
    return F.when(F.char_length(text) >= n, grams).otherwise(F.array().cast("array<int>"))


def features(host: Column, path: Column) -> Column:
    """The set of buckets, in order."""
    h, p = F.concat(F.lit("^"), host, F.lit("$")), path
    found = F.concat(*(_grams(h, n, "h") for n in (3, 4, 5)), *(_grams(p, n, "p") for n in (3, 4)))
    return F.when(F.char_length(host) + F.char_length(path) > 0, F.array_sort(F.array_distinct(found))).otherwise(F.array().cast("array<int>"))


#: Distinct labelled urls that are fitted, at most; of more, those first by a hash. Their matrix has the square of it.
LABELLED = 1000


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(u, int(b)) for u, b in EXAMPLES], "url string, blocked int")


def fit(labelled: DataFrame) -> tuple[dict[int, float], float]:
    """(weight by bucket, intercept) of the logistic regression. The matrix of common features of the LABELLED urls, at most, is one row."""
    rows = parsed(labelled.select("url", "blocked")).select("host", "path", "blocked").distinct()
    # By a hash of the row, so that a rerun takes the same ones.
    rows = rows.orderBy(F.xxhash64("host", "path", "blocked")).limit(LABELLED)
    rows = rows.withColumn("f", features(F.col("host"), F.col("path"))).withColumn("norm", F.sqrt(F.greatest(F.size("f"), F.lit(1))))
    rows = rows.select(F.xxhash64("host", "path", "blocked").alias("i"), F.col("blocked").cast("double").alias("y"), "norm", "f")
    flat = rows.select("i", "norm", F.explode("f").alias("b"))
    common = flat.toDF("i", "ni", "b").join(flat.toDF("j", "nj", "b"), "b").groupBy("i", "j").agg((F.count("*") / F.first(F.col("ni") * F.col("nj"))).alias("k"))
    kernel = common.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "k"))).alias("row"))
    one = rows.join(kernel, "i").agg(F.array_sort(F.collect_list(F.struct("i", "y", "norm", "row")), lambda a, b: F.signum((a["i"] > b["i"]).cast("int") - (a["i"] < b["i"]).cast("int")).cast("int")).alias("e"))
    one = one.select("e", F.transform("e", lambda r: F.transform("e", lambda c: F.coalesce(F.try_element_at(r["row"], c["i"]), F.lit(0.0)) + 1.0)).alias("gram"), F.transform("e", lambda r: r["y"]).alias("y"))
    step = (
        f"aggregate(sequence(1, {STEPS}), transform(y, v -> 0D), (a, s) -> zip_with(a, zip_with(y, gram, (v, g) -> "
        f"v - 1 / (1 + exp(-aggregate(zip_with(a, g, (p, q) -> p * q), 0D, (m, t) -> m + t)))), (p, e) -> p * (1 - {RATE * PENALTY}) + {RATE} * e))"
    )
    solved = one.select("e", F.expr(step).alias("a"))
    coefficients = solved.select(F.explode(F.arrays_zip("a", F.transform("e", lambda r: r["i"]).alias("i"), F.transform("e", lambda r: r["norm"]).alias("norm"))).alias("z")).select("z.a", "z.i", "z.norm")
    weights = flat.select("i", "b").join(coefficients, "i").groupBy("b").agg(F.sum(F.col("a") / F.col("norm")).alias("w"))
    found = weights.unionByName(coefficients.agg(F.lit(-1).alias("b"), F.sum("a").alias("w"))).collect()
    got = {r["b"]: r["w"] for r in found}
    return {b: w for b, w in got.items() if b >= 0}, got.get(-1) or 0.0


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as text, its verdict), null where none fits. A rule fits its host and all subdomains, and paths that start with its own."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def filter_urls(pages: DataFrame, model: tuple[dict[int, float], float], url: str = "url", rules=RULES) -> DataFrame:
    """`pages` with host, path, rule, verdict and score (the model's probability that the url is to be blocked). No shuffle."""
    weights, intercept = model
    # Folded to one constant array by the optimizer.
    table = F.split(F.lit(",".join(repr(float(weights.get(b, 0.0))) for b in range(1 << BITS))), ",").cast("array<double>")
    rows = parsed(prefixed(pages), f"__in_{url}")
    rows = rows.withColumn("__f", features(F.col("host"), F.col("path")))
    total = F.aggregate("__f", F.lit(0.0), lambda a, b: a + F.get(table, b)) / F.sqrt(F.greatest(F.size("__f"), F.lit(1)))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    score = F.when(F.size("__f") > 0, 1 / (1 + F.exp(-(total + F.lit(intercept))))).otherwise(F.lit(0.0))
    rows = rows.withColumns({"__out_host": F.col("host"), "__out_path": F.col("path"), "__out_rule": rule, "__out_score": score})
    method = F.when(F.col("__out_score") >= THRESHOLD, "block").otherwise("allow")
    return restored(rows.withColumn("__out_verdict", F.coalesce(verdict, method)), pages, _RESULTS)


def op10_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, fit(labelled_urls(spark))).drop("url")
