"""Personal-data spans: fixed base patterns, and boosted trees over wider proposals, all as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pii_model as model

KINDS = model.KINDS
#: The base patterns with possessive repeats, which give the same leftmost matches in time linear in the text: a start
#: inside a run of characters can't match where the start of the run doesn't. \G allows a start just after a match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheaper tests than the patterns' own, by their place in BASE and PROPOSED: all parts of a row must be in the text, a part being one
#: of the strings named; DIGITS stands for a run of eight digits at most three characters apart, which is looked for once.
DIGITS = r"[0-9](?:[^0-9]{0,3}+[0-9]){7}"
HOLDS = {
    "email": [["@"]], "ip": [["."]], "card": [["DIGITS"]], "phone": [["+"]],
    0: [["at)", "at]", "at}"]], 1: [[" at "], [" dot "]], 2: [[":"]], 3: [["::"]], 4: [["DIGITS"]], 5: [["DIGITS"]], 6: [["DIGITS"]], 7: [["=", ":"]],
}
#: Tests that every text with a base match passes.
GATES = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
IP_VALID = rf"^{PART}\.{PART}\.{PART}\.{PART}$"
#: High-recall proposals by kind: pairs of a pattern and a cheap test that every text with a match passes. Repeats end where
#: the formats do: 64 characters of a mailbox, 63 of a label, 127 labels of a host, 19 digits of a card, 15 of a phone number.
_LABEL = r"[A-Za-z0-9-]{1,63}+"
PROPOSED = (
    ("email", rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+\x20?(?:\(at\)|\[at\]|\{{at\}})\x20?{_LABEL}(?:\x20?(?:\.|\(dot\)|\[dot\]|\{{dot\}})\x20?{_LABEL}){{0,126}}", r"[(\[{]at[)\]}]"),
    ("email", rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+\x20at\x20{_LABEL}(?:\x20dot\x20{_LABEL}){{1,126}}", r"\x20at\x20[A-Za-z0-9-]{1,63}+\x20dot\x20"),
    ("ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", r":[0-9A-Fa-f]{1,4}:"),
    ("ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])", r"[0-9A-Fa-f]::[0-9A-Fa-f]"),
    ("card", r"(?<![0-9])[0-9]{4}[.\x20/_-]{1,3}[0-9]{4,6}[.\x20/_-]{1,3}[0-9]{4,5}(?:[.\x20/_-]{1,3}[0-9]{1,4})?(?![0-9])", r"[0-9]{4}[.\x20/_-]"),
    ("phone", r"(?<![0-9+.-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])", r"[0-9)][\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3}"),
    ("phone", r"(?<![0-9A-Za-z+.-])[0-9]{9,12}(?![0-9A-Za-z]|[.-][0-9])", r"[0-9]{9}"),
    ("secret", r"(?<=(?i:token|secret|password|passwd|api[_-]key|apikey|access[_-]key)\x20{0,2}[:=]\x20{0,2}[\"']{0,1})[A-Za-z0-9+/_.=-]{16,}+", r"(?i)(?:token|secret|password|passwd|key)\x20{0,2}[:=]"),
)
SPAN = "array<struct<start:int,kind:int,end:int,hit:string>>"


def _count(c: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(c, pattern, ""))


def luhn(digits: Column) -> Column:
    """For one digit or more; each second digit from the right is doubled."""
    n = F.char_length(digits)
    worth = lambda i: F.when((n - 1 - i) % 2 == 1, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substring(digits, i + 1, F.lit(1)).cast("int") + 1)).otherwise(F.substring(digits, i + 1, F.lit(1)).cast("int"))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def _holds(rows: list[list[str]]) -> Column:
    part = lambda p: F.col("_digits") if p == "DIGITS" else F.contains("text", F.lit(p))
    return reduce(and_, [reduce(or_, map(part, row)) for row in rows])


def _found(df: DataFrame, name: str, kind: str, pattern: str, gate: str, holds: list[list[str]]) -> DataFrame:
    """df with column `name`: the leftmost non-overlapping matches with their places in code points, from the lengths of
    the pieces between them."""
    none = F.array().cast("array<string>")
    df = df.withColumn("_go", _holds(holds) & F.col("text").rlike(gate))
    df = df.withColumn("_hits", F.when(F.col("_go"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn("_gaps", F.when(F.size("_hits") > 0, F.split("text", pattern, -1)).otherwise(none))
    pairs = F.arrays_zip(F.col("_hits").alias("hit"), F.slice("_gaps", F.lit(1), F.size("_hits")).alias("gap"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["hit"])
        one = F.struct(start.alias("start"), F.lit(model.PROPOSED_KINDS.index(kind)).alias("kind"), end.alias("end"), x["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    placed = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])
    return df.withColumn(name, F.when(F.size("_hits") > 0, placed).otherwise(F.array().cast(SPAN)))


def _valid(kind: str, span: Column) -> Column:
    digits = F.regexp_replace(span["hit"], "[^0-9]", "")
    n = F.char_length(digits)
    return {"email": F.lit(True), "ip": span["hit"].rlike(IP_VALID), "card": F.when((n >= 12) & (n <= 19), luhn(digits)).otherwise(False), "phone": (n >= 9) & (n <= 15)}[kind]


def _test(kind: str):
    return lambda span: _valid(kind, span)


def features(text: Column, span: Column) -> list[Column]:
    """The columns of pii_model.features, in its order."""
    hit = span["hit"]
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.char_length(digits)
    first = F.greatest(F.lit(0), span["start"] - model.CONTEXT)
    before, after = F.substring(text, first + 1, span["start"] - first), F.substring(text, span["end"] + 1, F.lit(1))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return [
        span["kind"].cast("double"), n.cast("double"), F.char_length(hit).cast("double"), _count(hit, "[0-9A-Za-z]").cast("double"),
        F.when((n >= 12) & (n <= 19), flag(luhn(digits))).otherwise(0.0),
        F.when(before.rlike(model.FOR), 1.0).when(before.rlike(model.AGAINST), -1.0).otherwise(0.0),
        flag(hit.rlike(model.DATED)), _count(hit, "[^.]").cast("double"),
        flag(before.rlike("[0-9A-Za-z]$") | after.rlike("^[0-9A-Za-z]")),
        F.size(F.regexp_extract_all(hit, F.lit(model.DOT), F.lit(0))).cast("double"), _count(hit, "[^A-Za-z]").cast("double"), flag(hit.rlike(model.OPENS)), _count(hit, "[^A-Z]").cast("double"),
    ]


def _score(x: Column, trees: list) -> Column:
    """x: an array of features."""
    at = lambda f, cut, a, b: F.when(F.get(x, F.lit(f)) <= cut, a).otherwise(b)
    out = F.lit(0.0)
    for f, cut, low, high in trees:
        out = out + at(f, cut, at(low[0], low[1], F.lit(low[2]), F.lit(low[3])), at(high[0], high[1], F.lit(high[2]), F.lit(high[3])))
    return out


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def find_spans(docs: DataFrame) -> DataFrame:
    """docs' doc_id and text (null: empty) with arrays base, spans and secrets of struct (start, kind, end, hit), by start, then
    kind, spans holding the others; no rows for an empty table, and texts of any length are searched whole.

    base: matches of the base patterns that pass their tests; a failing match is dropped and not retried. Proposals of
    the wider patterns are scored by boosted trees on format and context; one is added where its score reaches its
    kind's calibrated threshold and it overlaps neither a base span nor an added one of higher score (of equal scores, the one of
    the kind named first, then the first, then the longest is added). spans: base and what is added. Repeated rows are
    judged one by one; other columns are ignored. One pass over the text in its own task: nothing is shuffled."""
    df = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("_digits", F.col("text").rlike(DIGITS))
    for k in KINDS:
        df = _found(df, f"_base_{k}", k, BASE[k], GATES[k], HOLDS[k])
        df = df.withColumn(f"_base_{k}", F.filter(f"_base_{k}", _test(k)))
    for i, (k, pattern, gate) in enumerate(PROPOSED):
        df = _found(df, f"_more_{i}", k, pattern, gate, HOLDS[i])
    df = df.withColumn("base", F.array_sort(F.concat(*[F.col(f"_base_{k}") for k in KINDS])))
    df = df.withColumn("_more", F.concat(*[F.col(f"_more_{i}") for i in range(len(PROPOSED))]))
    fit = model.fitted()
    limits = F.array(*[F.lit(t) for t in fit["thresholds"]])
    df = df.withColumn("_more", F.filter("_more", lambda s: ~F.exists("base", lambda b: _overlap(s, b))))
    df = df.withColumn("_more", F.transform("_more", lambda s: F.struct(s.alias("span"), F.array(*features(F.col("text"), s)).alias("x"))))
    df = df.withColumn("_more", F.transform("_more", lambda s: F.struct(_score(s["x"], fit["trees"]).alias("score"), s["span"].alias("span"))))
    df = df.withColumn("_more", F.filter("_more", lambda s: s["score"] >= F.get(limits, s["span"]["kind"])))
    spans = F.array_sort(F.concat("base", best(F.col("_more"))))
    secret = model.PROPOSED_KINDS.index("secret")
    return df.select("doc_id", "text", "base", spans.alias("spans")).withColumn("secrets", F.filter("spans", lambda s: s["kind"] == secret))


def best(scored: Column) -> Column:
    """The spans of (score, span) that stay: from the best on, each that overlaps none kept before it."""
    order = F.array_sort(F.transform(scored, lambda s: F.struct(-s["score"], s["span"]["kind"], s["span"]["start"], -s["span"]["end"], s["span"].alias("span"))))
    keep = lambda kept, s: F.when(F.exists(kept, lambda k: _overlap(k, s["span"])), kept).otherwise(F.concat(kept, F.array(s["span"])))
    return F.aggregate(order, F.array().cast(SPAN), keep)


def _listed(spans: str) -> Column:
    names = F.array(*map(F.lit, model.PROPOSED_KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_<kind> (base spans), base_sha256, spans (all), secrets (those among them, listed likewise), n_found."""
    out = find_spans(docs)
    of = lambda i: lambda s: s["kind"] == i
    counts = [F.size(F.filter("base", of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"), _listed("secrets").alias("secrets"), F.size("spans").cast("long").alias("n_found"))


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and text with every span replaced by its kind in brackets; overlapping spans become one, of the first's kind. Null texts
    come out empty, texts without spans as they are; repeated rows and rows without doc_id each come out, an empty table gives no
    rows, and other columns are ignored, whatever their names."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in model.PROPOSED_KINDS])

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.get(names, s["kind"]))).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(F.col("spans"), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.char_length("text"))))
    return find_spans(docs).select("doc_id", whole.alias("text"))
