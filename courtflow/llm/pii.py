"""Personal data: fixed patterns, and patterns of context learnt from what they find.
DataFrame functions only.

Base kinds (email, ip, card, phone) are found by regular expressions over every whole text. A
span's place comes from splitting the text at the same matches and adding up lengths. The
expressions are written so that a failing run of characters is given up at once (possessive
runs that start where a run starts or where the last match ended), with the same matches as
the plain forms, so very long texts take linear time.

Contextual extraction is bootstrapped. Instances are words that hold a digit or an @; those
that overlap a base span are the seeds; those of the form of a base kind that fail its test
(a number that is no card number) are ordinary and never found. The word before and the word after an instance are its
lexical patterns. In each round a pattern's confidence is the mean score of its instances,
lowered for patterns with few of them, and an instance's score is 1 for seeds and else the
noisy-or of its patterns' confidences. After the rounds, instances that follow or precede
patterns of high confidence and enough distinct seeds become spans of kind ``id``.

Scale: texts are read once and never shuffled; the pattern-instance graph has one row per distinct
pair, combined before its shuffle, and its joins are plain equi-joins whose hot keys Spark splits.
Found words go back to their documents by a row key in a stored table; only rows that have
undecided words take part in that join.

Edge cases: null and empty texts have no span; a repeated row is a row of its own; overlapping
spans of different kinds all stay; redaction merges them and keeps columns of any name; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtflow.llm.common import cut_lineage, query, table, text_of

#: kind: (a test that is cheap and fails for most texts, the pattern), in listed order.
PATTERNS = {
    "email": ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": ("[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("[0-9]", r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
KINDS = list(PATTERNS)
FOUND = "id"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
IP = rf"^{BYTE}(?:\.{BYTE}){{3}}$"
#: A word with a digit or @, from its start on.
INSTANCE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Characters next to an instance in which its context word is sought.
REACH = 64


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(total, i):
        d = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _valid(kind: str, text: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return text.rlike(IP)
    n = F.length(_digits(text))
    if kind == "phone":
        return n.between(10, 15)
    return F.when(n.between(14, 19), _luhn(_digits(text))).otherwise(False)


def _places(matches: Column, pieces: Column) -> Column:
    """(start, end, text) of the matches; ``pieces`` are what lies between them."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("spans"))

    def step(acc, i):
        start = acc["at"] + F.length(F.get(pieces, i))
        match = F.get(matches, i)
        end = start + F.length(match)
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), match.alias("text")))).alias("spans"))

    every = F.when(F.size(matches) > 0, F.sequence(F.lit(0), F.size(matches) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(every, zero, step, lambda acc: acc["spans"])


def _rejected(kind: str, text: Column) -> Column:
    """Of the right form, but not valid: an ordinary number."""
    if kind == "card":
        return F.length(_digits(text)).between(14, 19) & ~_valid(kind, text)
    return ~_valid(kind, text)


def _rejected_spans(kind: str) -> Column:
    return F.filter(F.col(f"__w_{kind}"), lambda s: _rejected(kind, s["text"]))


def _valid_spans(kind: str, rank: int) -> Column:
    spans = F.filter(F.col(f"__w_{kind}"), lambda s: _valid(kind, s["text"]))
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _word(text: Column, last: bool) -> Column:
    """The context word at the near end of the text next to an instance."""
    near = F.right(text, F.lit(REACH)) if last else F.left(text, F.lit(REACH))
    word = F.regexp_extract(near, r"([^\x20\x09-\x0D]++)[\x20\x09-\x0D]*$" if last else r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)", 1)
    return F.lower(F.regexp_replace(word, r"[.,;:!?]+$", ""))


def parse(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and: row (key), spans (of base kinds, in order), n_<kind>, words (the instances
    with start, end, text, before, after, known, open)."""
    d = docs.select(*keep, text_of(docs).alias("__t"))
    nothing = F.array().cast("array<string>")
    for kind, (test, pattern) in PATTERNS.items():
        p = F.lit(pattern)
        d = d.withColumn(f"__m_{kind}", F.when(F.col("__t").rlike(test), F.regexp_extract_all("__t", p, F.lit(0))).otherwise(nothing))
    d = d.withColumn("__m_word", F.when(F.col("__t").rlike("[0-9@]"), F.regexp_extract_all("__t", F.lit(INSTANCE), F.lit(0))).otherwise(nothing))
    for kind, pattern in [*((k, p) for k, (_, p) in PATTERNS.items()), ("word", INSTANCE)]:
        d = d.withColumn(f"__p_{kind}", F.when(F.size(f"__m_{kind}") > 0, F.split("__t", pattern, -1)))
    d = d.drop("__t")
    for rank, kind in enumerate(KINDS):
        d = d.withColumn(f"__w_{kind}", _places(F.col(f"__m_{kind}"), F.col(f"__p_{kind}")))
        d = d.withColumn(f"__s_{kind}", _valid_spans(kind, rank))
        d = d.withColumn(f"n_{kind}", F.size(f"__s_{kind}").cast("long"))
    d = d.withColumn("spans", F.array_sort(F.concat(*[F.col(f"__s_{k}") for k in KINDS])))
    d = d.withColumn("__rejected", F.concat(*[_rejected_spans(k) for k in KINDS]))
    pieces, matches = F.col("__p_word"), F.col("__m_word")

    def instance(s, i):
        known = F.exists("spans", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        ordinary = F.exists("__rejected", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), _word(F.get(pieces, i), True).alias("before"),
            _word(F.get(pieces, i + 1), False).alias("after"), known.alias("known"),
            (~known & ~ordinary).alias("open"),
        )

    d = d.withColumn("words", F.transform(_places(matches, pieces), instance))
    names = [*keep, "spans", *[f"n_{k}" for k in KINDS], "words"]
    return d.select(*names, F.monotonically_increasing_id().alias("row"))


def _patterns_of(word: Column) -> Column:
    both = F.array(F.concat(F.lit("< "), word["before"]), F.concat(F.lit("> "), word["after"]))
    return F.filter(both, lambda p: F.length(p) > 2)


def confident_patterns(parsed: DataFrame, rounds: int = 3, least_confidence: float = 0.8, least_seeds: int = 4) -> DataFrame:
    """(pattern, confidence) of the patterns to trust, from the pattern-instance graph."""
    words = parsed.select(F.explode("words").alias("w")).select(F.col("w.text").alias("text"), F.col("w.known").alias("known"), F.col("w.open").alias("open"), F.explode(_patterns_of(F.col("w"))).alias("pattern"))
    edges = words.groupBy("pattern", "text").agg(F.max("known").alias("known"), F.max("open").alias("open"))
    edges = cut_lineage(edges, "pii-graph")
    scored = edges.withColumn("score", F.col("known").cast("double"))
    patterns = None
    for n in range(rounds):
        # half an instance more that is not personal: few instances give little confidence
        patterns = scored.groupBy("pattern").agg(
            (F.sum("score") / (F.count(F.lit(1)) + F.lit(0.5))).alias("confidence"), F.sum(F.col("known").cast("long")).alias("seeds")
        )
        if n < rounds - 1:
            patterns = cut_lineage(patterns, "pii-patterns")
            miss = F.sum(F.log1p(-F.least("confidence", F.lit(1 - 1e-9))))
            instances = edges.filter(F.col("open") & ~F.col("known")).join(patterns.select("pattern", "confidence"), "pattern").groupBy("text").agg((1 - F.exp(miss)).alias("belief"))
            belief = F.when(F.col("known"), 1.0).when(F.col("open"), F.coalesce("belief", F.lit(0.0))).otherwise(0.0)
            scored = edges.join(instances, "text", "left").select("pattern", "text", "known", belief.alias("score"))
    return patterns.filter((F.col("confidence") >= least_confidence) & (F.col("seeds") >= least_seeds)).select("pattern", "confidence")


def find(docs: DataFrame, keep: list[str], **learning) -> DataFrame:
    """``keep`` and: spans (base ones, in order), all_spans (with those of kind ``id``),
    n_<kind> of the base kinds."""
    parsed = cut_lineage(parse(docs, keep), "pii-parsed")
    trusted = confident_patterns(parsed, **learning)
    open_words = F.filter("words", lambda w: w["open"])
    asked = parsed.select("row", F.explode(open_words).alias("w")).select("row", F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.explode(_patterns_of(F.col("w"))).alias("pattern"))
    found = asked.join(trusted.select("pattern"), "pattern").groupBy("row").agg(
        F.collect_set(F.struct("start", F.lit(len(KINDS)).alias("rank"), "end", F.lit(FOUND).alias("kind"))).alias("found")
    )
    undecided = F.exists("words", lambda w: w["open"])
    out = [*keep, *[f"n_{k}" for k in KINDS], "spans"]
    some = parsed.filter(undecided).join(found, "row", "left").select(*out, F.coalesce("found", F.slice("spans", 1, 0)).alias("found"))
    some = some.withColumn("all_spans", F.array_sort(F.concat("spans", "found"))).drop("found")
    rest = parsed.filter(~undecided).select(*out, F.col("spans").alias("all_spans"))
    return some.unionByName(rest)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind, as in [EMAIL]; overlaps merge into the first."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc, s):
        between = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        mark = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        apart = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, F.concat(acc["parts"], F.array(between, mark))).otherwise(acc["parts"]).alias("parts")
        )

    done = F.aggregate(spans, zero, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact(docs: DataFrame, text: str = "text", **learning) -> DataFrame:
    """``docs`` with personal data in the text replaced; same columns, same rows."""
    columns = docs.columns
    # one struct, so that no column of theirs has the name of one made here
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("kept"), F.col(text).alias("text"))
    found = find(packed, ["kept"], **learning)
    masked = redacted(F.col("kept").getField(text), F.col("all_spans"))
    return found.select(*[masked.alias(c) if c == text else F.col("kept").getField(c).alias(c) for c in columns])


@query("op4_pii")
def op4(spark, sf_dir):
    found = find(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2(spans_text(F.col("spans")), 256).alias("base_sha256"), spans_text(F.col("all_spans")).alias("spans")
    )
