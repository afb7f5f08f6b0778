"""URL filter: prefix rules first, a character language-model ratio for the rest.

Two smoothed variable-order Markov models are learned from the URLs that rules accept and reject: interpolated
counts of up to four characters (Witten-Bell: a context passes to its shorter
context the share of its distinct successors).  A URL's score is the mean log-likelihood
difference a character; it is blocked below a threshold calibrated on
rule-judged URLs that the models did not see.

Everything is DataFrame operations.  URLs are first reduced to distinct normal
forms (host and path, digits as 0) with their numbers of accepted and rejected rows, so a host with a
third of all rows is one row with a weight; grams are then counted over distinct forms, and each distinct
gram is scored once.  Joins go against written tables, which lets Spark split frequent grams over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Store

#: (verdict, host/path prefix); the longest that fits wins.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
GRAM = 4
ALPHABET = 256  # characters that the models' uniform base spreads over
MISBLOCKED = 0.01
CHUNK = 256
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule: str, host: Column, path: Column) -> Column:
    at = rule.index("/")
    return ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])


def rule_of(rules, host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, of equally long ones the first; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, r in reversed(sorted(rules, key=lambda x: -len(x[1]))):
        fits = _fits(r, host, path)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _grams(forms: DataFrame) -> DataFrame:
    """Adds `gram`: every character with the GRAM - 1 before it, start and end marks included.

    Forms are cut into overlapping chunks first, so the work is linear in their length."""
    padded = F.concat(F.lit("\x01" * (GRAM - 1)), F.col("form"), F.lit("\x02"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.char_length("form") / CHUNK).cast("int")),
                         lambda k: F.substr(padded, k * CHUNK + 1, F.lit(CHUNK + GRAM - 1)))
    return (forms.withColumn("chunk", F.explode(chunks))
            .withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length("chunk") - (GRAM - 1)))))
            .withColumn("gram", F.substr("chunk", F.col("at"), F.lit(GRAM))).drop("chunk", "at")
            .filter(F.char_length("gram") == GRAM))


def _model(counted: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """(grams of every length with their weight in each class, contexts with weight and distinct successors)."""
    lengths = F.array(*[F.right("gram", F.lit(j)) for j in range(1, GRAM + 1)])
    grams = store.write(counted.select(F.explode(lengths).alias("g"), "n_allow", "n_block").groupBy("g")
                        .agg(F.sum("n_allow").alias("ca"), F.sum("n_block").alias("cb")), "grams")
    contexts = (grams.withColumn("ctx", F.expr("left(g, char_length(g) - 1)")).groupBy("ctx")
                .agg(F.sum("ca").alias("na"), F.sum("cb").alias("nb"), F.count_if(F.col("ca") > 0).alias("ta"), F.count_if(F.col("cb") > 0).alias("tb")))
    return grams, store.write(contexts, "contexts")


def _gram_scores(needed: DataFrame, grams: DataFrame, contexts: DataFrame) -> DataFrame:
    """(gram, delta): log-likelihood of the last character under the accepted model less that under the rejected."""
    parts = needed.select("gram", F.explode(F.array(*[
        F.struct(F.lit(j).alias("j"), F.right("gram", F.lit(j)).alias("g"), F.expr(f"left(right(gram, {j}), {j - 1})").alias("ctx"))
        for j in range(1, GRAM + 1)])).alias("x")).select("gram", "x.*")
    looked = parts.join(grams, "g", "left").join(contexts, "ctx", "left")
    at = lambda c, j: F.max(F.when(F.col("j") == j, F.coalesce(F.col(c), F.lit(0)).cast("double"))).alias(f"{c}{j}")
    rows = looked.groupBy("gram").agg(*[at(c, j) for c in ("ca", "cb", "na", "nb", "ta", "tb") for j in range(1, GRAM + 1)])
    p = {}
    for m in "ab":
        p[m] = F.lit(1.0 / ALPHABET)
        for j in range(1, GRAM + 1):
            c, n, t = F.col(f"c{m}{j}"), F.col(f"n{m}{j}"), F.col(f"t{m}{j}")
            p[m] = F.when(n > 0, (c + t * p[m]) / (n + t)).otherwise(p[m])
    return rows.select("gram", (F.log(p["a"]) - F.log(p["b"])).alias("delta"))


def _threshold(seen: DataFrame, misblocked: float) -> float:
    """The highest threshold, 0 at most, that blocks at most `misblocked` of the accepted calibration rows."""
    bins = (seen.filter("n_allow > 0").groupBy(F.floor(F.col("score") * 1000).alias("bin")).agg(F.sum("n_allow").alias("n"))
            .orderBy("bin").collect())  # scores lie within log(ALPHABET * ...) of 0, so some ten thousand bins
    total, below = sum(r.n for r in bins), 0
    for r in bins:
        below += r.n
        if below > misblocked * total:
            return min(0.0, r.bin / 1000)
    return 0.0


def filter_urls(pages: DataFrame, *, url_col: str = "url", rules=RULES, misblocked: float = MISBLOCKED) -> DataFrame:
    """Adds host, path, rule, verdict (allow or block) and score (the model's, null where a rule decides) to each row.

    Null URLs and those without `://` have empty host and path and are judged by the model as the empty form.  If
    rules accept or reject nothing to learn from, the model allows everything.  Texts are read whole; repeated rows repeat; an
    empty table gives an empty result; columns with one of the five names are replaced."""
    store = Store(pages.sparkSession, "urlfilter")
    url = F.col(url_col).cast("string")
    kept = pages.drop("rule", "verdict", "score")
    rows = kept.withColumns({"host": host_of(url), "path": path_of(url)})
    rule, verdict = rule_of(rules, F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": rule, "verdict": verdict})
    form = F.regexp_replace(F.concat("host", "path"), "[0-9]", "0")
    forms = store.write(rows.select(form.alias("form"), "verdict").groupBy("form").agg(
        F.count_if(F.col("verdict") == "allow").alias("n_allow"), F.count_if(F.col("verdict") == "block").alias("n_block"),
        F.count_if(F.col("verdict").isNull()).alias("n_open")).withColumn("form_id", F.monotonically_increasing_id()), "forms")
    calibrates = F.substring(F.md5(F.col("form").cast("binary")), 1, 1).isin("0", "1", "2")  # 3 of 16 forms
    counted = store.write(_grams(forms.filter((F.col("n_allow") + F.col("n_block") > 0) & ~calibrates)).groupBy("gram")
                          .agg(F.sum("n_allow").alias("n_allow"), F.sum("n_block").alias("n_block")), "counted")
    learned = counted.agg(F.sum("n_allow").alias("a"), F.sum("n_block").alias("b")).first()
    if not (learned.a and learned.b):
        return rows.withColumns({"verdict": F.coalesce("verdict", F.lit("allow")), "score": F.lit(None).cast("double")})
    grams, contexts = _model(counted, store)
    judged = _grams(forms.filter((F.col("n_open") > 0) | calibrates)).select("form_id", "gram")  # no text on a gram's row
    scores = store.write(_gram_scores(judged.select("gram").distinct(), grams, contexts), "gram-scores")
    by_form = judged.join(scores, "gram").groupBy("form_id").agg(F.round(F.avg("delta"), 9).alias("score"))
    by_form = store.write(by_form.join(forms, "form_id").withColumn("calibrates", calibrates), "scores")
    threshold = _threshold(by_form.filter("calibrates"), misblocked)
    scored = by_form.filter("n_open > 0").select(F.col("form").alias("__form"), F.col("score").alias("__score"))
    open_form = F.when(F.col("verdict").isNull(), form)
    return (rows.join(scored, open_form == F.col("__form"), "left")
            .withColumn("verdict", F.coalesce("verdict", F.when(F.col("__score") < threshold, "block").otherwise("allow")))
            .withColumn("score", F.col("__score")).drop("__form", "__score"))
