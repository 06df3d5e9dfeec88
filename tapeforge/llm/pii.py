"""Personal data by weak supervision, in built-in functions only.

Regular expressions propose candidate spans. Four labelers vote on each (1, 0 or -1): the
strict pattern, a checksum or range test, a gazetteer (name suffixes, card issuers,
calling codes, reserved address blocks) and the words before it. Expectation
maximisation over the counts of vote patterns in the whole corpus estimates each
labeler's reliability without any labels; a logistic span classifier is then trained
on the resulting probabilities. The strict spans always stay; candidates that the
classifier trusts and that pass their structural test are added.

The corpus is only ever reduced to counts per vote pattern, some hundred rows whatever
its size; those go to the driver and come back as constants in an expression.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tapeforge.llm.common import unused
from tapeforge.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
VOTERS = ("strict", "check", "gazetteer", "context")
TRUST = 0.95   # probability from which a candidate is added
CONTEXT = 32   # characters before a span that are searched for cue words
BLOCK = 256

# Strict patterns. Possessive repeats and the look-behind keep them linear: a local part or number that
# fails at its first character fails at all others. \G lets a match begin where the last one ended.
_LOCAL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
STRICT = {
    "email": _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Looser forms whose matches are candidates only.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]++"
             r"(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:(?:\[\.\]|\(\.\))[0-9]{1,3}+){3}(?![0-9])"
          r"|(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){7}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])",
}
HINT = r"[0-9@]| dot |[\(\[](?:at|dot)[\)\]]"

# Gazetteers and cue words.
SUFFIXES = "com org net edu gov info biz io de fr es uk it nl eu us ca au jp cn in br ch at be pl se no"
CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
RESERVED = r"^(?:0\.|10\.|127\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|192\.168\.|22[4-9]\.|2[345][0-9]\.)"
CUES = {
    "email": r"(?i)\b(?:mail|email|e-mail|contact|write to|from|cc)\b",
    "ip": r"(?i)\b(?:ip|address|host|server|login|client)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|dial)\b",
}
AGAINST = r"(?i)(?:token|version|serial|order|invoice|sku|hash|isbn|build|id)\W*$"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _located(text: Column, pattern: str) -> Column:
    """Array of (start, end, s) of all matches, code points, end exclusive.

    The pieces between matches come from ``split`` by the same pattern. Positions are
    running sums, taken in two levels so that thousands of matches stay cheap.
    """
    p = F.lit(pattern)

    def sums(x: Column) -> Column:
        step = F.transform(x["m"], lambda s, i: F.length(F.get(x["p"], i)) + F.length(s))
        return _let(F.struct(x["m"].alias("m"), x["p"].alias("p"), step.alias("step")), blocks)

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda s, v: s + v)

    def blocks(x: Column) -> Column:
        count = F.ceil(F.size(x["m"]) / BLOCK).cast("int")
        each = F.transform(F.sequence(F.lit(0), count - 1),
                           lambda b: total(F.slice(x["step"], b * BLOCK + 1, F.lit(BLOCK))))
        return _let(F.struct(x["m"].alias("m"), x["p"].alias("p"), x["step"].alias("step"), each.alias("each")), bases)

    def bases(x: Column) -> Column:
        base = F.transform(x["each"], lambda _, b: total(F.slice(x["each"], F.lit(1), b)))
        return _let(F.struct(x["m"].alias("m"), x["p"].alias("p"), x["step"].alias("step"), base.alias("base")), placed)

    def placed(x: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            at = (F.get(x["base"], F.floor(i / BLOCK).cast("int"))
                  + total(F.slice(x["step"], F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))
                  + F.length(F.get(x["p"], i)))
            return F.struct(at.alias("start"), (at + F.length(s)).alias("end"), s.alias("s"))

        return F.transform(x["m"], one)

    both = F.struct(F.regexp_extract_all(text, p, F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    none = F.array().cast("array<struct<start:int,end:int,s:string>>")
    return _let(both, lambda x: F.when(F.size(x["m"]) > 0, sums(x)).otherwise(none))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _octets_fit(s: Column) -> Column:
    parts = F.transform(F.regexp_extract_all(s, F.lit("[0-9]+"), F.lit(0)), lambda x: F.ltrim(x, F.lit("0")))
    return F.forall(parts, lambda x: (F.length(x) <= 3) & (F.coalesce(x.try_cast("int"), F.lit(0)) <= 255))


def _tests(kind: str, s: Column) -> tuple[Column, Column, Column]:
    """(fits the contract, passes the structural test, is known to the gazetteer) of a candidate."""
    if kind == "email":
        last = F.lower(F.regexp_extract(s, r"([A-Za-z0-9-]+)$", 1))
        labels = ~s.rlike(r"\.\.|@[.-]|-\.|\.-") & last.rlike("[A-Za-z]")
        return F.lit(True), labels, last.isin(*SUFFIXES.split())
    if kind == "ip":
        plain = F.regexp_replace(s, r"[\[\]()]", "")
        fits = F.when(s.contains(":"), F.lit(True)).otherwise(_octets_fit(s))
        return fits, fits, ~plain.rlike(RESERVED)
    digits = _digits(s)
    if kind == "card":
        luhn = F.call_function("luhn_check", digits)
        return luhn & F.length(digits).between(16, 19), luhn & F.length(digits).between(13, 19), digits.rlike(ISSUERS)
    fits = F.length(digits).between(8, 15)
    code = F.regexp_extract(s, r"^\+([0-9]+)", 1)
    known = ~s.startswith("+") | F.exists(F.array(*[F.lit(c) for c in CODES.split()]), lambda c: code.startswith(c))
    return fits, fits, known


def _kind(text: Column, kind: str) -> Column:
    """Candidates of one kind in order: (kind, start, end, base, fits, strict, check, gazetteer, context, apart)."""

    def labelled(found: Column, strict: bool) -> Column:
        def one(x: Column) -> Column:
            base, check, known = _tests(kind, x["s"])
            near = F.substring(text, F.greatest(x["start"] - CONTEXT + 1, F.lit(1)), F.least(x["start"], F.lit(CONTEXT)))
            context = F.when(near.rlike(AGAINST), -1).when(near.rlike(CUES[kind]), 1).otherwise(0)
            apart = ~F.substring(text, x["start"], F.when(x["start"] > 0, 1).otherwise(0)).rlike("[A-Za-z0-9]$")
            sign = lambda c: F.when(c, 1).otherwise(-1)
            return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
                            (F.lit(strict) & base).alias("base"), check.alias("fits"),
                            F.lit(1 if strict else 0).alias("strict"), sign(check).alias("check"),
                            sign(known).alias("gazetteer"), context.alias("context"), apart.alias("apart"),
                            F.least(F.floor((x["end"] - x["start"]) / 6), F.lit(4)).cast("int").alias("size"),
                            F.least(F.length(F.regexp_replace(x["s"], "[A-Za-z0-9]", "")), F.lit(5)).alias("marks"))

        return F.transform(found, one)

    strict = labelled(_located(text, STRICT[kind]), True)
    if kind == "card":  # shorter and longer numbers are no candidates
        strict = F.filter(strict, lambda x: x["base"] | (x["end"] - x["start"]).between(13, 37))
    if kind not in LOOSE:
        return strict
    return _let(strict, lambda held: F.concat(held, F.filter(
        labelled(_located(text, LOOSE[kind]), False),
        lambda x: ~F.exists(held, lambda h: (h["start"] < x["end"]) & (x["start"] < h["end"])))))


CANDIDATE = ("array<struct<kind:string,start:int,end:int,base:boolean,fits:boolean,strict:int,check:int,"
             "gazetteer:int,context:int,apart:boolean,size:int,marks:int>>")
SCALE = {"apart": 1, "size": 4, "marks": 5}
SHAPES = ("apart", "size", "marks")  # what the classifier sees of a span and no labeler votes on


def candidates(text: str = "text") -> Column:
    """All candidate spans of a text with their votes. Null and empty texts have none."""
    t = F.col(text)
    found = F.concat(*[_kind(t, k) for k in KINDS])
    return F.when(t.rlike(HINT), found).otherwise(F.array()).cast(CANDIDATE)


# --- reliabilities and classifier, on counts --------------------------------------------

@dataclass
class SpanModel:
    """Per kind: intercept and a weight for each vote, then for the shape: standing apart, length and separators."""

    weights: dict[str, list[float]]
    reliability: dict[str, dict[str, float]]  # estimated accuracy of each voter that did vote

    def probability(self, x: Column) -> Column:
        out = F.lit(0.0)
        for kind, w in self.weights.items():
            z = F.lit(w[0])
            for name, v in zip(VOTERS, w[1:]):
                z = z + F.lit(v) * x[name]
            for name, v in zip(SHAPES, w[1 + len(VOTERS):]):
                z = z + F.lit(v / SCALE[name]) * x[name].cast("int")
            out = F.when(x["kind"] == kind, 1 / (1 + F.exp(-z))).otherwise(out)
        return out


def _em(counts: dict[tuple[int, ...], float], rounds: int = 50) -> tuple[dict[tuple[int, ...], float], dict[str, float]]:
    """Probability of each vote pattern to be personal data, and the voters' accuracies."""
    # Voters that say the same on every pattern are one witness, and count once between them.
    columns = [tuple(v[k] for v in counts) for k in range(len(VOTERS))]
    say = [1 / columns.count(c) for c in columns]
    post = {v: min(max(0.5 + 0.25 * sum(s * x for s, x in zip(say, v)), 0.05), 0.95) for v in counts}
    accuracy = {}
    for _ in range(rounds):
        weight = [sum(n * (p if y else 1 - p) for (v, n), p in zip(counts.items(), post.values())) for y in (0, 1)]
        prior = (weight[1] + 1) / (weight[0] + weight[1] + 2)
        table = []
        for k in range(len(VOTERS)):
            given: list[dict[int, float]] = [defaultdict(lambda: 1.0), defaultdict(lambda: 1.0)]
            for v, n in counts.items():
                given[1][v[k]] += n * post[v]
                given[0][v[k]] += n * (1 - post[v])
            table.append([{a: given[y][a] / (weight[y] + 3) for a in (-1, 0, 1)} for y in (0, 1)])
            right = table[k][1][1] * prior + table[k][0][-1] * (1 - prior)
            wrong = table[k][1][-1] * prior + table[k][0][1] * (1 - prior)
            accuracy[VOTERS[k]] = right / (right + wrong)
        for v in counts:
            odds = math.log(prior / (1 - prior)) + sum(
                say[k] * math.log(table[k][1][v[k]] / table[k][0][v[k]]) for k in range(len(VOTERS)))
            post[v] = 1 / (1 + math.exp(-max(min(odds, 30), -30)))
    return post, accuracy


def _logistic(rows: list[tuple[list[float], float, float]], rounds: int = 400, ridge: float = 0.01) -> list[float]:
    """Weights of (features, target, count) rows by gradient descent on the mean loss."""
    w = [0.0] * len(rows[0][0])
    total = sum(n for _, _, n in rows)
    for _ in range(rounds):
        grad = [ridge * x for x in w]
        for f, y, n in rows:
            z = sum(a * b for a, b in zip(w, f))
            e = (1 / (1 + math.exp(-max(min(z, 30), -30))) - y) * n / total
            for k, a in enumerate(f):
                grad[k] += e * a
        w = [a - 1.0 * g for a, g in zip(w, grad)]
    return w


def learn(found: DataFrame) -> SpanModel:
    """Fit on a table with a ``candidates`` column. Counts are by kind, votes and shape."""
    x = found.select(F.explode("candidates").alias("x"))
    # Votes and shapes have few values each, so this is some thousand rows at most, whatever the corpus.
    rows = x.groupBy(*[F.col(f"x.{c}").alias(c) for c in ("kind", *VOTERS, *SHAPES)]).count().collect()
    model = SpanModel({}, {})
    for kind in KINDS:
        counts: dict[tuple[int, ...], float] = defaultdict(float)
        own = sorted((tuple(r[v] for v in VOTERS), tuple(int(r[f]) / SCALE[f] for f in SHAPES), r["count"]) for r in rows if r["kind"] == kind)
        for v, _, n in own:
            counts[v] += n
        if not own:
            continue
        post, model.reliability[kind] = _em(counts)
        model.weights[kind] = _logistic([([1.0, *map(float, v), *shape], post[v], n) for v, shape, n in own])
    return model


# --- results ----------------------------------------------------------------------------

def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def spans(model: SpanModel, found: str = "candidates") -> Column:
    """Base spans and trusted candidates, by kind as listed and then start."""
    trusted = F.filter(F.col(found), lambda x: x["base"] | (x["fits"] & (model.probability(x) >= TRUST)))
    order = lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)
    ordered = _let(trusted, lambda t: F.concat(*[F.array_sort(F.filter(t, _of_kind(k)), order) for k in KINDS]))
    return F.transform(ordered, lambda x: F.struct(x["kind"], x["start"], x["end"], x["base"]))


def _listed(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of ``docs``.

    The counts and the digest are of base spans; ``spans`` lists all. Null and empty texts have
    none; texts of any length are searched whole; repeated rows each get a row; other columns
    are ignored. The candidates are written once, without the texts.
    """
    found = cut_lineage(docs.select("doc_id", candidates().alias("candidates")))
    marked = found.select("doc_id", spans(learn(found)).alias("all"))
    marked = marked.select("doc_id", "all", F.filter("all", lambda x: x["base"]).alias("base"))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return marked.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
                         _listed(F.col("all")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets, e.g. [EMAIL]; ``n_chars``, if
    present, is brought up to date. Of overlapping spans the first names the whole stretch. Null stays null."""
    held_in, all_in, cut_in = (unused(n, docs.columns) for n in ("_found", "_all", "_cut"))
    model = learn(docs.select(candidates().alias("candidates")))
    kind_of = F.struct(F.lit(0).alias("upto"), F.array().cast("array<struct<start:int,end:int,kind:string>>").alias("held"))

    def merge(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc["held"], F.lit(-1))
        longer = F.concat(F.slice(acc["held"], F.lit(1), F.size(acc["held"]) - 1), F.array(F.struct(
            last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["kind"].alias("kind"))))
        more = F.concat(acc["held"], F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
        held = F.when(x["start"] < acc["upto"], longer).otherwise(more)
        return F.struct(F.greatest(acc["upto"], x["end"]).alias("upto"), held.alias("held"))

    by_start = F.array_sort(F.transform(F.col(all_in), lambda x: F.struct(x["start"], x["end"], x["kind"])))
    merged = F.aggregate(by_start, kind_of, merge, lambda acc: acc["held"])
    out = docs.select("*", candidates().alias(held_in))
    out = out.withColumn(all_in, spans(model, held_in)).withColumn(cut_in, merged)

    def kept(cut: Column) -> Column:
        before = F.transform(cut, lambda x, i: F.concat(
            F.substring(F.col("text"), F.when(i == 0, 0).otherwise(F.get(cut, i - 1)["end"]) + 1,
                        x["start"] - F.when(i == 0, 0).otherwise(F.get(cut, i - 1)["end"])),
            F.lit("["), F.upper(x["kind"]), F.lit("]")))
        rest = F.substring(F.col("text"), F.element_at(cut, -1)["end"] + 1, F.length("text"))
        return F.concat(F.array_join(before, ""), rest)

    text = F.when(F.size(cut_in) > 0, kept(F.col(cut_in))).otherwise(F.col("text"))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(cut_in) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(
            docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
