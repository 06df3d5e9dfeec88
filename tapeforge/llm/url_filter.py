"""URL filtering: explicit rules, and gradient-boosted trees on lexical features for the rest.

Features are built-in expressions on the URL alone, plus how often the labelled URLs of
the host's suffix are blocked. The trees are trained from labelled URLs; in the query
those are the URLs that a rule decides.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tapeforge.session import cut_lineage

FIT_URLS = 100_000      # labelled URLs that the trees are fitted on, the first in a hash order
MIN_SHARE = 0.001       # of the labelled URLs that a suffix needs for a statistic of its own: 1000 suffixes at most
TREES, DEPTH, SEED = 10, 3, 17
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a host, a slash and the beginning of the path, e.g. ``example.org/es/``."""

    verdict: str
    pattern: str


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without one."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host_col: Column, path_col: Column, rules: Sequence[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, nulls if none does. The rules are a written policy, so they
    become one expression; a rule fits its host and all subdomains."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):
        name, slash, begin = r.pattern.partition("/")
        fits = ((host_col == name) | host_col.endswith("." + name)) & path_col.startswith(slash + begin)
        out = F.when(fits, F.struct(F.lit(r.pattern).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


FEATURES = ["url_length", "host_length", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "labels",
            "longest_token", "non_ascii", "suffix_rate"]


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def lexical(urls: DataFrame) -> DataFrame:
    """``urls`` (with url, host, path) and the lexical features; a null url counts as empty."""
    u = F.coalesce("url", F.lit(""))
    chars = F.split(F.col("_u"), "")
    n = F.greatest(F.length("_u"), F.lit(1))
    # One pass over the sorted characters: runs of equal ones are the counts.
    runs = F.regexp_extract_all(F.array_join(F.array_sort(chars), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))
    entropy = F.aggregate(runs, F.lit(0.0), lambda s, r: s - F.length(r) / n * F.log2(F.length(r) / n))
    tokens = F.split(F.col("_u"), r"[^A-Za-z0-9]+")
    out = urls.withColumn("_u", u)
    return out.select(
        "*", F.length("_u").cast("double").alias("url_length"), F.length("host").cast("double").alias("host_length"),
        F.size(F.filter(F.split("path", "/"), lambda s: s != "")).cast("double").alias("depth"),
        (_count(F.col("_u"), "[0-9]") / n).alias("digit_ratio"), F.when(F.col("_u") == "", 0.0).otherwise(entropy).alias("entropy"),
        (F.when(F.instr("_u", "?") > 0, 1).otherwise(0) + _count(F.col("_u"), "&")).cast("double").alias("parameters"),
        _count(F.col("host"), "-").cast("double").alias("hyphens"), F.size(F.split("host", r"\.")).cast("double").alias("labels"),
        F.array_max(F.transform(tokens, F.length)).cast("double").alias("longest_token"),
        _count(F.col("_u"), r"[^\x00-\x7F]").cast("double").alias("non_ascii"),
        F.regexp_extract("host", r"([^.]*)$", 1).alias("_suffix")).drop("_u")


@dataclass
class UrlModel:
    trees: GBTClassificationModel | None
    rates: dict[str, float]   # share of blocked labelled URLs by suffix
    share: float              # and of all

    def suffix_rate(self) -> Column:
        out = F.lit(self.share)
        if self.rates:
            table = F.create_map(*[F.lit(v) for kv in sorted(self.rates.items()) for v in kv])
            out = F.coalesce(F.try_element_at(table, F.col("_suffix")), out)
        return out


def learn(labelled: DataFrame, fit_urls: int = FIT_URLS) -> UrlModel:
    """Fit on (url, host, path, blocked 0/1); null labels are ignored. With one class only, or none, there are no trees
    and the share of blocked labels decides. Suffix statistics are of all labelled URLs."""
    rows = cut_lineage(lexical(labelled.where("blocked in (0, 1)")))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("b")).first()
    share = (total.b or 0) / total.n if total.n else 0.0
    if not total.n or total.b in (0, total.n):
        return UrlModel(None, {}, share)
    counts = (rows.groupBy("_suffix").agg(F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("b"))
              .where(F.col("n") >= MIN_SHARE * total.n).collect())  # 1 / MIN_SHARE rows at most
    model = UrlModel(None, {r["_suffix"]: (r.b + 20 * share) / (r.n + 20) for r in counts}, share)
    if total.n > fit_urls:
        top = F.pmod(F.xxhash64("url"), F.lit(1 << 20))
        rows = rows.where(top < int((1 << 20) * fit_urls / total.n))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(
        rows.withColumn("suffix_rate", model.suffix_rate())).select("features", F.col("blocked").cast("double").alias("label"))
    model.trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, maxBins=64).fit(rows)
    return model


def block_probability(urls: DataFrame, model: UrlModel) -> DataFrame:
    """``urls`` (url, host, path) with ``probability`` to be blocked."""
    rows = lexical(urls).withColumn("suffix_rate", model.suffix_rate())
    if model.trees is None:
        scored = rows.withColumn("_p", F.lit(model.share))
    else:
        scored = model.trees.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
        scored = scored.withColumn("_p", vector_to_array("probability")[1])
    return scored.select(*[F.col(c) for c in urls.columns], F.col("_p").alias("probability"))


def verdicts(pages: DataFrame, rules: Sequence[Rule], threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, probability) for every row of ``pages`` (page_id, url).

    The longest fitting rule decides; elsewhere a URL is blocked if the trees, trained on the URLs that rules decide,
    give it ``threshold`` at least. A null url, or one without ://, has an empty host and path, fits no rule and is
    judged by its features like any other. Repeated rows each get a row; extra columns are ignored.
    """
    urls = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    urls = urls.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    known = urls.where("_r is not null").select("url", "host", "path", (F.col("_r.verdict") == "block").cast("int").alias("blocked"))
    scored = block_probability(urls, learn(known))
    own = F.when(F.col("probability") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("_r.rule").alias("rule"),
                         F.coalesce("_r.verdict", own).alias("verdict"), "probability")
