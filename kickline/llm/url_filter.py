"""URL filter: host and path rules first, a logistic regression on character n-grams for the rest.

The n-grams of host and path, told apart, are hashed into BUCKETS columns by built-in functions, for the small
labelled table and for the urls alike; the weights become an array literal of the scoring query.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kickline.llm.common import aside, restored, table
from kickline.llm.registry import query

#: (verdict, host, path): a rule fits its host and all subdomains under its path; the longest wins (fixed values).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
BUCKETS = 4096
GRAMS = (3, 4, 5)
STEPS, RATE, RIDGE = 400, 20.0, 1e-4

#: Words of which the labelled table is made by rule unless another table is given: every word of a label alone and before
#: some others of its label. Domains, subdomains and paths rotate alike over both labels, so that they say nothing.
BLOCKED_WORDS = """
casino poker roulette slots jackpot bingo lotto betting bets wager bookie gambling adult porn xxx sexy escort nude dating webcam cams
pills pharma meds viagra cialis steroid weightloss diet slim keto crypto forex bitcoin loan loans payday credit debt cash money rich
prize lottery reward bonus win wins winner cheap discount replica fake rolex gift free instant easy fast quick click clicks popup
adserver ads tracker tracking banner traffic seo backlink link spam warez crack keygen nulled serial torrent phish verify hack profit
deals offers sale buy online club vip royal 24 777 4u xx zone
"""
ALLOWED_WORDS = """
city river mountain garden forest harbour village island castle bridge church street market winter summer morning country family
history science nature animal marine biology physics alpine medical dental legal music philharmonic theatre cinema guitar piano poetry
english german travel cycling hiking sailing chess football tennis birdwatching weather climate energy solar water kitchen baking bakery
cooking coffee organic farmers teacher student children parent brother leather quilting knitting northern southern western eastern
national regional public civic modern ancient digital software python code data map street corner smith jones miller anderson
library museum school college university press journal times review archive guide forum society institute centre station gallery
studio works house notes world circle today shop books art photo radio
stadt garten wetter schule reise buch wandern verein zeitung jardin ecole maison voyage lecture histoire monde ciudad escuela
viaje biblioteca libros salud tierra revista
"""
#: How far apart the second word of a name is from the first in its list.
STEPS_APART = (1, 3, 8, 17, 29, 44, 63, 85)
DOMAINS = ("{}.com", "{}.org", "{}.net", "{}.info", "{}.co.uk", "{}.de", "{}.hosting.com", "{}.pages.net", "{}.sites.org", "{}.example.org", "{}.example.net", "{}.example.com")
SUBDOMAINS = ("", "www.", "m.", "blog.")
PATHS = ("/", "/en/2377.html", "/de/45?page=2&ref=x", "/fr/8011/", "/es/15977#top", "/news/2021/05/article", "/index.php")
#: Parts of the table held out in turn to set the cut-off, and what a false alarm weighs against a miss there.
FOLDS, FALSE_ALARM = 5, 3.0
#: A-Z and a-z, to lower-case these letters only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without :// or for null."""
    at = F.coalesce(F.instr(F.col(url), "://"), F.lit(0))
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    return (F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host + path, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def grams(host: Column, path: Column) -> Column:
    """Distinct buckets of the character n-grams of host and path."""
    parts = [("h", F.concat(F.lit("."), host, F.lit("/"))), ("p", F.translate(path, UPPER, LOWER))]

    def bucket(part: str):
        return lambda g: F.pmod(F.xxhash64(F.lit(part), g), F.lit(BUCKETS)).cast("int")
    found = [F.transform(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)), bucket(part)) for part, text in parts for n in GRAMS]
    return F.array_distinct(F.concat(*found))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url, label (1: block) and the words of the name, by which parts are held out."""
    rows = []
    for label, words in ((1, BLOCKED_WORDS.split()), (0, ALLOWED_WORDS.split())):
        for i, one in enumerate(words):
            for k, step in enumerate((0, *STEPS_APART)):
                two = words[(i + step) % len(words)] if step else ""
                name = DOMAINS[(i + k * 5) % len(DOMAINS)].format(one + ("-" if two and (i + k) % 2 else "") + two)
                rows.append((f"https://{SUBDOMAINS[(i // 2 + k) % len(SUBDOMAINS)]}{name}{PATHS[(i + k) % len(PATHS)]}", label, [one, two] if two else [one]))
    return spark.createDataFrame(rows, "url string, label int, words array<string>")


def _regression(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Both labels weigh the same, whatever their numbers of rows."""
    w, b = np.zeros(BUCKETS, x.dtype), 0.0
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())).astype(x.dtype)
    for _ in range(STEPS):
        error = (1 / (1 + np.exp(-(x @ w + b))) - y).astype(x.dtype) * weight
        w, b = w - RATE * (x.T @ error + RIDGE * w), float(b - RATE * error.sum())
    return w, b


def cut_off(z: np.ndarray, y: np.ndarray) -> float:
    """The logit in the middle of the gap with the smallest miss rate plus FALSE_ALARM times the false-alarm rate; of ties the middle one."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    misses = np.concatenate([[0], np.cumsum(y)]) / y.sum()
    alarms = 1 - np.concatenate([[0], np.cumsum(1 - y)]) / (1 - y).sum()
    cuts = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    cost = misses + FALSE_ALARM * alarms
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    return float(cuts[best[len(best) // 2]])


def fit(labelled: DataFrame, url: str = "url", label: str = "label", apart: str | None = None) -> tuple[np.ndarray, float]:
    """Weights and intercept from a small table of urls; label 1 is block, null labels are left out.

    Even chances lie at the cut-off that is best for names kept out of the fit. The words of a name (the array column
    `apart`, or the host as one word) fall into FOLDS parts; a name with all its words in one part is scored by a
    regression on the names without any word of this part.
    """
    host, path = host_and_path(url)
    parts = F.transform(F.col(apart) if apart else F.array(host), lambda x: F.pmod(F.xxhash64(x), F.lit(FOLDS)).cast("int"))
    rows = labelled.filter(F.col(label).isNotNull()).select(grams(host, path).alias("x"), F.col(label).alias("y"), parts.alias("p")).collect()  # the small table
    if len({r["y"] for r in rows}) < 2:
        return np.zeros(BUCKETS), 4.0 if rows and rows[0]["y"] else -4.0
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        x[i, r["x"]] = 1 / np.sqrt(max(1, len(r["x"])))
    y, of = np.array([r["y"] for r in rows], np.float32), [set(r["p"] or ()) for r in rows]
    z, known = np.zeros(len(rows)), np.zeros(len(rows), bool)
    for p in range(FOLDS):
        out, rest = np.array([s == {p} for s in of]), np.array([p not in s for s in of])
        if out.any() and len(set(y[rest])) == 2:
            w, b = _regression(x[rest], y[rest])
            z[out], known[out] = x[out] @ w + b, True
    w, b = _regression(x, y)
    cut = cut_off(z[known], y[known]) if len(set(y[known])) == 2 else 0.0
    return w.astype(float), b - cut


def block_score(host: Column, path: Column, model: tuple[np.ndarray, float]) -> Column:
    weights, bias = model
    table_of = F.expr(f"cast(split('{','.join(f'{x:.9g}' for x in weights)}', ',') as array<double>)")
    found = grams(host, path)
    total = F.aggregate(F.transform(found, lambda g: F.get(table_of, g)), F.lit(0.0), lambda a, x: a + x)
    return 1 / (1 + F.exp(-(total / F.sqrt(F.greatest(F.size(found), F.lit(1))) + bias)))


def judge(pages: DataFrame, model: tuple[np.ndarray, float], url: str = "url", rules=RULES) -> DataFrame:
    """All columns of `pages` plus _host, _path, _rule, _verdict and _score (null where a rule decides).

    A null url or one without :// has an empty host and path and is judged by the regression. Every
    row comes back, repeated rows too; an empty table gives an empty table. Columns may have any names but those of the result.
    """
    host, path = host_and_path("_text")
    parts = aside(pages, url).select("*", host.alias("_host"), path.alias("_path"))
    rule, said = rule_of(F.col("_host"), F.col("_path"), rules)
    ruled = parts.select("*", rule.alias("_rule"), said.alias("_said"))
    scored = ruled.withColumn("_score", F.when(F.col("_rule").isNull(), block_score(F.col("_host"), F.col("_path"), model)))
    verdict = F.coalesce("_said", F.when(F.col("_score") >= 0.5, "block").otherwise("allow"))
    return scored.withColumn("_verdict", verdict).select(*restored(pages.columns, url), "_host", "_path", "_rule", "_score", "_verdict")


@query("op5_url_filter")
def op5_url_filter(spark, sf_dir):
    out = judge(table(spark, sf_dir, "pages").select("page_id", "url"), fit(labelled_urls(spark), apart="words"))
    return out.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"),
                      F.col("_verdict").alias("verdict"), F.col("_score").alias("score"))
