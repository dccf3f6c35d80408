"""URL filter: written rules first, else a logistic regression on hashed character n-grams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = 4096
LENGTHS = (3, 4, 5)
STRENGTH = 0.01

#: Verdict, host and path of the rules; a host stands for its subdomains too.
RULES: tuple[tuple[str, str, str], ...] = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

#: The labelled URLs, made up for this table.
UNWANTED = (
    "http://www.cheap-pills.example.com/en/12?page=2&ref=x",
    "https://cheap-pills.example.org/fr/7.html",
    "http://buy-cheap-pills-online.example.com/order",
    "https://discount-pills.example.com/en/pharmacy/99",
    "http://pills-pharmacy.example.org/buy/viagra",
    "https://spam-farm.example.org/en/728?utm_source=feed",
    "http://www.spam-farm.example.com/en/41",
    "http://link-farm.example.com/links/page2.html",
    "https://seo-link-farm.example.org/out?to=1",
    "http://spam-links.example.com/free/backlinks",
    "http://online-casino.example.com/en/bonus",
    "https://casino-bonus.example.org/poker/slots",
    "http://best-casino-slots.example.com/jackpot",
    "https://free-poker.example.com/casino/win",
    "http://adult-cams.example.com/xxx/live",
    "https://xxx-videos.example.org/porn/5",
    "http://hot-porn.example.com/adult/77.html",
    "https://adult-dating.example.org/xxx/join",
    "http://fast-loans.example.com/payday/apply",
    "https://payday-loans-now.example.org/cheap/credit",
    "http://replica-watches.example.com/cheap/rolex",
    "https://cheap-replica.example.org/buy/now",
    "http://click-bait.example.com/win/prize/1",
    "https://free-prize.example.org/win/click.html",
    "http://ads-track.example.com/en/3?page=2&ref=x",
    "https://m.ads-track.example.org/de/81/",
    "http://ad-tracker.example.com/click/track.html",
    "https://www.free-bets.example.com/fr/55#top",
    "http://blog.free-bets.example.org/sports/bet",
    "https://blog.casino-win.example.com/en/20.html",
    "http://m.casino-win.example.org/es/64/",
    "https://adult-x.example.com/en/18",
    "http://blog.adult-x.example.org/fr/6#top",
    "http://malware-download.example.com/crack/keygen",
    "https://warez-crack.example.org/keygen/free",
)
WANTED = (
    "https://en.encyclopedia.example.org/wiki/Water",
    "https://www.university.example.org/research/papers/12",
    "http://library.example.com/en/catalogue/554.html",
    "https://blog.gardening.example.com/en/853/",
    "http://blog.travel.example.org/fr/960",
    "https://m.weather.example.com/en/474.html",
    "https://news.example.org/es/671?utm_source=feed",
    "http://www.museum.example.com/en/369#top",
    "https://docs.software.example.org/manual/index.html",
    "https://forum.cooking.example.com/en/thread/77",
    "http://www.school.example.com/de/533/",
    "https://blog.thother.example.com/en/148.html",
    "https://www.thering.example.org/en/797#top",
    "http://tionand.example.org/en/328/",
    "https://m.ththou.example.com/es/25#top",
    "https://government.example.org/law/1999/14",
    "http://health.example.com/en/advice/sleep",
    "https://recipes.example.com/fr/825?page=2&ref=x",
    "https://www.theatre.example.org/en/471",
    "http://history.example.com/es/777?page=2&ref=x",
    "https://science.example.org/en/685",
    "http://sport.example.com/en/676",
    "https://music.example.org/en/770#top",
    "https://photo.example.com/en/gallery/9",
    "http://maths.example.org/de/612?utm_source=feed",
    "https://blog.thesth.example.com/en/12?page=2&ref=x",
    "http://m.ingtion.example.org/de/7.html",
    "https://www.ththan.example.com/en/41",
    "http://blog.erthes.example.org/fr/55#top",
    "https://m.ondthe.example.com/en/20/",
    "http://www.atthre.example.com/es/64?utm_source=feed",
    "https://ther-free.example.org/en/81.html",
    "http://winter.example.com/en/64/",
    "https://farm.example.org/en/3#top",
    "https://books.example.com/en/334/",
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first `://` up to `/`, `?`, `#`; then up to `?`, `#`. Empty if there is none."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Verdict and name of the longest rule that fits, else null. The list of rules is written by hand."""
    verdict = name = F.lit(None).cast("string")
    for kind, of, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        verdict = F.when(fits, kind).otherwise(verdict)
        name = F.when(fits, of + start).otherwise(name)
    return verdict, name


def buckets(characters: dict[int, str]) -> Column:
    """Distinct hashed character n-grams, told apart by what they are part of.

    `characters`: columns with the characters of the host (0) and the path (1).
    Each n-gram reads its elements of the array, so a long url takes time linear in its length.
    """

    def grams(column: str, n: int, kind: int) -> Column:
        last = F.size(column) - n
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

        def bucket(i: Column) -> Column:
            gram = F.concat(*(F.get(F.col(column), i + j) for j in range(n)))
            return F.pmod(F.xxhash64(F.lit(kind), gram), F.lit(FEATURES)).cast("int")

        return F.transform(starts, bucket)

    return F.array_distinct(F.concat(*(grams(c, n, kind) for kind, c in characters.items() for n in LENGTHS)))


def labelled_urls(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(u).alias("url"), F.lit(y).alias("label")) for y, us in ((1.0, UNWANTED), (0.0, WANTED)) for u in us]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _with_buckets(urls: DataFrame) -> DataFrame:
    host, path = host_and_path(F.col("url").cast("string"))
    split = urls.withColumns({"host": host, "path": path})
    whole = {"in_host": F.concat(F.lit("."), "host", F.lit("/")), "in_path": F.col("path")}
    every = {name: F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)) for name, text in whole.items()}
    # Written as columns of their own: an n-gram then reads the array instead of cutting the text again.
    cut = split.withColumns(every)
    return cut.withColumn("buckets", buckets({0: "in_host", 1: "in_path"})).drop(*every)


def fit(labelled: DataFrame) -> tuple[list[float], float]:
    """Weights of the buckets and bias, from a small table `url, label` (1: unwanted)."""
    rows = _with_buckets(labelled.select("url", "label"))
    ones = F.transform(F.sequence(F.lit(0), F.lit(FEATURES - 1)), lambda i: F.array_contains("buckets", i).cast("double"))
    table = rows.select("label", array_to_vector(ones).alias("features")).coalesce(1)
    model = LogisticRegression(regParam=STRENGTH, standardization=False, maxIter=60).fit(table)
    return model.coefficients.toArray().tolist(), float(model.intercept)


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """`page_id, host, path, rule, score, verdict` of each row of `pages`.

    A rule decides where one fits, else a `score` of 0.5 or more blocks. A url
    that is null or has no `://` has an empty host and path and no rule; the
    classifier judges it by its bias alone. Repeated rows are judged each.
    """
    weights, bias = fit(labelled)
    held = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    rows = _with_buckets(pages.select("page_id", "url"))
    verdict, rule = rule_of(F.col("host"), F.col("path"), rules)
    total = F.aggregate(
        F.col("buckets"), F.lit(bias), lambda s, b: s + F.get(held, b)
    )
    scored = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("given"), (1 / (1 + F.exp(-total))).alias("score"))
    guess = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", "score", F.coalesce("given", guess).alias("verdict"))
