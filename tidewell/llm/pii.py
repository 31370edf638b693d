"""Personal data by bootstrapped contextual extraction (native).

Seeds are e-mail addresses, IP addresses, card numbers and phone numbers found by pattern.
Every token with a digit or an at sign is an instance; the word before it, over spaces and line
ends, is its lexical pattern (the first token of a text has none). Words and tokens may be of any
length: beyond ``LONG`` characters their digests stand for them in the graph. On the graph of patterns and instances, scores are passed back and forth: a
pattern is as good as the share of its instances that score, an instance scores by the
patterns it appears in. Patterns that are both reliable and clearly better than the
average token - ``LIFT`` times its rate - then name unseen instances with
``DIGITS`` digits or more as identifiers of kind ``context``. Base spans always stay.

The texts are scanned once; what is written holds spans and short tokens only.

Defined results: a null or empty text has no spans; repeated rows and rows with one id
each get their own result; a null id stays null; an empty table gives no rows. Only the
named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import labelled, located
from .storage import keyed, written

#: A match begins where a run of its first class does, or where the match before it ends.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Numbers of under 16 digits never count, and end where the longer ones do.
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A word and the gap after it; the token ahead is not taken, so that it can be the word before the next one.
CONTEXT = r"(?<![^\x09-\x0D\x20])[^\x09-\x0D\x20]++[\x09-\x0D\x20]++(?=([^\x09-\x0D\x200-9@]*+[0-9@][^\x09-\x0D\x20]*+))"
KINDS = ("email", "ip", "card", "phone", "context")
ROUNDS, RELIABLE, LIFT, SUPPORT, DIGITS = 3, 0.6, 1.5, 5, 4
#: Characters beyond which a digest names a word or token in the graph; of a stretch of text in which spans meet.
LONG, STRETCH = 64, 128
_SPANS = "array<struct<k:int,start:int,end:int,kind:string>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _is_ip(match: Column) -> Column:
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))


def _is_card(match: Column) -> Column:
    digits = _digits(match)
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, F.ascii(c) - 48).when(F.ascii(c) < 53, 2 * (F.ascii(c) - 48)).otherwise(2 * (F.ascii(c) - 48) - 9))
    return F.length(digits).between(16, 19) & (F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0)


def _is_phone(match: Column) -> Column:
    return F.length(_digits(match)).between(8, 15)


def base_spans(text: Column) -> Column:
    """Spans of the four seed kinds, by kind, then start."""
    digit = text.rlike("[0-9]")
    found = (
        located(text, EMAIL, text.contains("@")),
        F.filter(located(text, IP, digit), lambda s: _is_ip(s["match"])),
        F.filter(located(text, CARD, digit), lambda s: _is_card(s["match"])),
        F.filter(located(text, PHONE, text.contains("+")), lambda s: _is_phone(s["match"])),
    )
    return F.concat(*[labelled(kind, i, x) for i, (kind, x) in enumerate(zip(KINDS, found, strict=False))])


def _named(x: Column) -> Column:
    return F.when(F.length(x) <= LONG, x).otherwise(F.sha2(x, 256))


def _occurrences(text: Column) -> Column:
    """(pattern, instance, digits, start, end) of each token with a digit or an at sign that follows a word."""
    able = text.rlike("[0-9@]")
    tokens = F.when(able, F.regexp_extract_all(text, F.lit(CONTEXT), F.lit(1))).otherwise(F.array().cast("array<string>"))

    def one(s: Column, token: Column) -> Column:
        core = F.regexp_replace(token, r"""^[("'\[{]++|[.,;:!?)"'\]}]++$""", "")
        start = s["end"] + F.length(F.regexp_extract(token, r"""^[("'\[{]*+""", 0))
        word = F.lower(F.regexp_replace(F.regexp_extract(s["match"], r"^[^\x09-\x0D\x20]++", 0), r"""^[("'\[{]++|[.,;!?)"'\]}]++$""", ""))
        return F.struct(_named(word).alias("pattern"), _named(core).alias("instance"), F.length(_digits(core)).alias("digits"), start.alias("start"), (start + F.length(core)).alias("end"))

    found = F.zip_with(located(text, CONTEXT, able), F.coalesce(tokens, F.array().cast("array<string>")), one)
    return F.filter(found, lambda o: (o["pattern"] != "") & (o["instance"] != ""))


def score(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """``edges(pattern, instance, seed)``, distinct, to (pattern, reliability, support) and (instance, score)."""
    scores = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score"))
    patterns = None
    for k in range(rounds):
        rated = edges.select("pattern", "instance", "seed").join(written(scores, "scores"), "instance")
        good = F.sum("score")
        patterns = rated.groupBy("pattern").agg((good / (F.count("*") + 1)).alias("reliability"), F.sum(F.col("seed").cast("long")).alias("support"))
        patterns = written(patterns, "patterns")
        if k < rounds - 1:
            able = edges.join(patterns.filter(F.col("support") >= SUPPORT), "pattern")
            heard = able.groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - F.col("reliability"))))).alias("heard"))
            seeds = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("seed"))
            # an unseen instance is worth half of what its patterns promise
            scores = seeds.join(heard, "instance", "left").select("instance", F.greatest("seed", 0.5 * F.coalesce("heard", F.lit(0.0))).alias("score"))
    return patterns, scores


def _with_seeds(near: DataFrame, base: DataFrame) -> DataFrame:
    """Which occurrences overlap a base span: both meet in stretches of ``STRETCH`` characters, so a text with very many of each costs no pairs."""

    def dealt(spans: DataFrame, start: str, end: str) -> DataFrame:
        return spans.select("_key", F.col("start").alias(start), F.col("end").alias(end), F.explode(F.sequence(F.floor(F.col("start") / STRETCH), F.floor((F.col("end") - 1) / STRETCH))).alias("stretch"))

    met = dealt(near, "o", "p").join(dealt(base, "b", "c"), ["_key", "stretch"]).filter("b < p and c > o")
    seeds = met.select("_key", F.col("o").alias("start")).distinct().withColumn("seed", F.lit(True))
    return near.join(seeds, ["_key", "start"], "left").select("_key", "pattern", "instance", "digits", "start", "end", F.coalesce("seed", F.lit(False)).alias("seed"))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, spans): the seed spans, and these with the spans that context adds."""
    rows, _ = keyed(docs, doc_id, text)
    content = F.coalesce(F.col(text), F.lit(""))
    seen = written(rows.select("_key", "doc_id", base_spans(content).alias("base"), _occurrences(content).alias("near")), "seen")
    near = written(_with_seeds(seen.select("_key", F.inline("near")), seen.select("_key", F.inline("base"))), "near")
    edges = written(near.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "edges")
    patterns, scores = score(edges)
    rate = edges.agg(F.avg(F.col("seed").cast("double"))).first()[0] or 0.0
    sure = patterns.filter((F.col("support") >= SUPPORT) & (F.col("reliability") >= RELIABLE) & (F.col("reliability") >= LIFT * rate)).select("pattern")
    unseen = near.filter(~F.col("seed") & (F.col("digits") >= DIGITS)).join(sure, "pattern")
    one = F.struct(F.lit(4).alias("k"), "start", "end", F.lit("context").alias("kind"))
    added = unseen.groupBy("_key").agg(F.array_sort(F.collect_set(one)).alias("added"))
    base = F.transform("base", lambda s: F.struct(s["k"].alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    out = seen.select("_key", "doc_id", base.alias("base")).join(added, "_key", "left")
    return out.select("doc_id", "base", F.concat("base", F.coalesce("added", F.array().cast(_SPANS))).alias("spans"))
