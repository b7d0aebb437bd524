"""URL filters with DataFrame functions only: host and path rules, then a character model ratio.

URLs that a rule decides teach two character models, one of allowed and one of blocked
URLs. A model counts, for contexts of no to ORDER characters, how often each character
follows; the chances of longer contexts are smoothed with those of shorter ones (Witten
and Bell): a character that a context has not seen costs the context's own share of
unseen ones, t / (n + t) for t distinct of n characters, times its chance after the
shorter context. The other URLs are judged by the mean over their characters of the
difference of log-likelihoods, against a threshold from cross-validation: each labelled
URL is scored by models of the FOLDS - 1 folds that it is not in.

Characters are folded to SYMBOLS classes, so a model has SYMBOLS**(ORDER + 1) rows at
most, whatever the input, and each row holds the ratios of all folds' models. Counts and
levels are written once each; larger models than BROADCAST rows meet URLs in a join.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.store import keep, shared_folder

#: (host, path, verdict); a rule fits its host and all subdomains, if the path starts with its path; the longest wins.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
# Letters, digits and signs that have a class of their own; all else shares one.
OWN = "abcdefghijklmnopqrstuvwxyz0123456789/.-"
SYMBOLS = len(OWN) + 1
ORDER = 3
#: Folds of the labelled URLs; model FOLDS learns from all.
FOLDS = 4
#: Rows of a level that are broadcast: some 50 bytes each.
BROADCAST = 2_000_000
#: Bins of the calibration histogram, over scores from -SPAN to SPAN.
BINS, SPAN = 2000, 5.0


def host_path(url: Column) -> tuple[Column, Column]:
    """Both empty without ://, and for null."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_columns(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _codes(url: Column) -> Column:
    """Classes of a URL's characters, after ORDER leading zeros."""
    own = F.lit(OWN)
    lowered = F.translate(url, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    one = lambda c: F.instr(own, c)
    return F.concat(F.array_repeat(F.lit(0), ORDER), F.transform(F.filter(F.split(lowered, ""), lambda c: c != ""), one))


def _grams(urls: DataFrame) -> DataFrame:
    """(url, ..., gram): ORDER + 1 classes as one number, for each character."""
    exploded = urls.where(F.length("url") > 0).withColumn("codes", _codes(F.col("url")))
    number = reduce(lambda n, j: n * SYMBOLS + F.get(F.col("codes"), F.col("i") + j), range(ORDER + 1), F.lit(0))
    return exploded.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("codes") - ORDER - 1))).withColumn("gram", number.cast("long")).drop("codes", "i")


def fold(url: Column) -> Column:
    return F.pmod(F.crc32(url.cast("binary")), F.lit(FOLDS)).cast("int")


def _counts(labelled: DataFrame, folder: str) -> DataFrame:
    """(level, g, a0.., b0..): uses of the last level + 1 classes in allowed and blocked URLs, in all folds but one and, last, in all."""
    grams = _grams(labelled.withColumn("fold", fold(F.col("url"))))
    level = F.explode(F.array(*(F.struct(F.lit(o).alias("level"), (F.col("gram") % SYMBOLS ** (o + 1)).alias("g")) for o in range(ORDER + 1))))
    uses = lambda v, word: F.sum(F.when((F.col("verdict") == word) & (F.col("fold") != v), F.col("n")).otherwise(0))
    # the full gram stands for its ends, so that a task sends each once
    counted = grams.groupBy("gram", "fold", "verdict").agg(F.sum("n").alias("n")).select("fold", "verdict", "n", level.alias("x")).select("x.*", "fold", "verdict", "n")
    return keep(counted.groupBy("level", "g").agg(*(uses(v, word).alias(f"{x}{v}") for x, word in (("a", "allow"), ("b", "block")) for v in range(FOLDS + 1))), folder)


class Model(NamedTuple):
    """By context length: (g, r0, r1, ...) ratios of seen grams; and (c, e0, e1, ...) ratios of contexts' shares of unseen characters."""

    ratios: list[DataFrame]
    escapes: list[DataFrame]


def model(labelled: DataFrame, folder: str) -> Model:
    """The log-likelihood of allowed less that of blocked, by the models of (url, verdict, n) rows without each fold, and of all."""
    counts, models = _counts(labelled, folder), [f"{x}{v}" for x in "ab" for v in range(FOLDS + 1)]
    chance, ratios, escapes = None, [], []
    for order in range(ORDER + 1):
        level = counts.where(F.col("level") == order).withColumn("c", F.floor(F.col("g") / SYMBOLS))
        context = Window.partitionBy("c")  # a context has SYMBOLS rows at most
        for m in models:
            level = level.withColumn(f"n_{m}", F.sum(m).over(context)).withColumn(f"t_{m}", F.sum((F.col(m) > 0).cast("int")).over(context))
        if chance is not None:
            shorter = chance.select(F.col("g").alias("s"), *(F.col(f"q_{m}").alias(f"p_{m}") for m in models))
            level = level.join(shorter, F.col("g") % SYMBOLS**order == F.col("s"))
        p = lambda m: F.col(f"p_{m}") if chance is not None else F.lit(1.0 / SYMBOLS)
        # a context that a model has not seen leaves the chance to the shorter one
        smooth = lambda m: F.when(F.col(f"n_{m}") > 0, (F.col(m) + F.col(f"t_{m}") * p(m)) / (F.col(f"n_{m}") + F.col(f"t_{m}"))).otherwise(p(m))
        unseen = lambda m: F.when(F.col(f"n_{m}") > 0, F.log(F.col(f"t_{m}") / (F.col(f"n_{m}") + F.col(f"t_{m}")))).otherwise(0.0)
        done = keep(
            level.select("g", "c", *(smooth(m).alias(f"q_{m}") for m in models), *((unseen(f"a{v}") - unseen(f"b{v}")).alias(f"e{v}") for v in range(FOLDS + 1))), folder
        )
        ratios.append(done.select("g", *((F.log(f"q_a{v}") - F.log(f"q_b{v}")).alias(f"r{v}") for v in range(FOLDS + 1))))
        escapes.append(done.select("c", *(f"e{v}" for v in range(FOLDS + 1))).distinct())
        chance = done
    return Model(ratios, escapes)


def _scores(urls: DataFrame, learned: Model) -> DataFrame:
    """(url, verdict, score) of distinct (url, verdict) rows: the mean ratio over the characters, labelled URLs by the models without their fold."""
    at = F.when(F.col("verdict").isNull(), F.lit(FOLDS)).otherwise(fold(F.col("url")))
    grams = _grams(urls.select("url", "verdict", at.alias("v")))
    pick = lambda x: F.element_at(F.array(*(F.col(f"{x}{v}") for v in range(FOLDS + 1))), F.col("v") + 1)
    total = F.lit(None).cast("double")
    for order in range(ORDER + 1):
        for table, key, column, name in ((learned.ratios[order], "g", "r", f"ratio{order}"), (learned.escapes[order], "c", "e", f"escape{order}")):
            code = F.col("gram") % SYMBOLS ** (order + 1)
            table = table if table.count() > BROADCAST else F.broadcast(table)
            grams = grams.join(table, (code if key == "g" else F.floor(code / SYMBOLS)) == F.col(key), "left").withColumn(name, pick(column)).drop(key, *(f"{column}{v}" for v in range(FOLDS + 1)))
        # the longest context that has seen the character; those that have not cost their escapes
        total = F.coalesce(f"ratio{order}", F.coalesce(F.col(f"escape{order}"), F.lit(0.0)) + F.coalesce(total, F.lit(0.0)))
    return grams.groupBy("url", "verdict").agg(F.avg(total).alias("score"))


def threshold(scores: DataFrame) -> float | None:
    """The score that parts (score, verdict) rows with the least mean error of the classes; None where one is missing. BINS rows at most reach the driver."""
    at = F.floor((F.greatest(F.lit(-SPAN), F.least(F.lit(SPAN), F.col("score"))) + SPAN) / (2 * SPAN) * BINS).cast("int")
    rows = sorted(scores.groupBy(at.alias("at")).agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b")).collect())
    good, bad = sum(r.a for r in rows), sum(r.b for r in rows)
    if not good or not bad:
        return None
    best, found, a, b = 2.0, (0.0, 0.0), 0, 0
    cuts = [(r["at"], r.a, r.b) for r in rows]
    for k, (i, x, y) in enumerate(cuts):
        # everything below bin i is blocked; the threshold lies in the middle of the gap before it
        error = a / good + (bad - b) / bad
        if error < best:
            best, found = error, (cuts[k - 1][0] + 1 if k else i, i)
        a, b = a + x, b + y
    return sum(found) / 2 / BINS * 2 * SPAN - SPAN


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, score (null where a rule decides, or for want of characters).

    A null or empty url has an empty host and path, no rule, and is allowed; so is every
    URL that no rule decides where the labelled ones are not of both classes. A URL is
    scored once and whole, however long, and however many rows repeat it. A score that
    equals the threshold allows. An empty table gives no rows; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = host_path(F.col("url"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("host", host).withColumn("path", path).withColumn("rule", rule).withColumn("ruled", verdict)
    folder = shared_folder(pages.sparkSession)
    urls = keep(rows.groupBy("url", F.col("ruled").alias("verdict")).agg(F.count(F.lit(1)).alias("n")), folder)
    learned = model(urls.where("verdict is not null"), folder)
    scores = keep(_scores(urls, learned), folder)
    limit = threshold(scores.where("verdict is not null"))
    out = rows.join(scores.where("verdict is null").drop("verdict"), "url", "left")
    judged = F.lit("allow") if limit is None else F.when(F.col("score") < limit, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", judged).alias("verdict"), "score")
