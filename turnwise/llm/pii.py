"""Operator 7: personal data, from fixed patterns and from contexts they bootstrap.

The base finds four kinds by pattern and check.  Its finds are seeds: the words around
them become lexical patterns, patterns and the identifier-like strings in the same
contexts form a graph, and Spark scores it in turns: a pattern by how many of its
strings are known and how many contradict, a string by the patterns it stands in, until
no string is new.  Strings that high-confidence patterns point at become spans too.
DataFrame functions only.

Texts are scanned once, into narrow rows of finds; places come from running sums over
the lengths between finds, so the work is linear in a text of any length.

Defined cases: a null text is an empty one; equal rows give equal results; a document
without finds has zero counts, the digest of the empty string and empty ``spans``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.llm.common import saved, text_of

#: The kinds in their order, and their patterns.  Quantifiers are
#: possessive where that gives the same matches, so long runs need no deep recursion,
#: and a match starts where a run starts (or the last match ended), so they need no
#: second look.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this cannot hold the kind.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}

#: Identifier-like strings, among which patterns may discover new spans: without spaces,
#: with an at sign or at least seven digits; and runs of digit groups joined by single
#: spaces (or a hyphen between two), dots, hyphens and brackets.  A word before ``:`` or
#: ``=`` is context.
LOOSE = r"(?<!\S)[^\s@0-9]*+(?:@|[0-9][^\s0-9@]*+(?:[0-9][^\s0-9@]*+){6}|[0-9][^\s@]*+@)\S*+"
_LEAD = r"(?:[^\s\p{L}\p{N}@]*+\p{L}[\p{L}_.-]*+[:=])?+[^\s\p{L}\p{N}@]*+"
_GROUP = r"[0-9]++(?:[().-]{1,2}+[0-9]++)*+(?=[^\s\p{L}\p{N}@]*+(?!\S))"
RUN = (
    rf"(?<!\S){_LEAD}(?=(?:[().-]*+(?:\x20(?:-\x20)?+\(?+)?+[0-9]){{7}})"
    rf"{_GROUP}(?:\)?+\x20(?:-\x20)?+\(?+{_GROUP})++"
)
#: Digits a run may have.
RUN_DIGITS = (7, 19)
#: Characters of context on either side.
CONTEXT = 60


def _finds(kind: str) -> Column:
    """Per match: characters since the last one, the match, and what stands around it."""
    pieces = F.col(f"_{kind}_between")
    return F.transform(
        F.col(f"_{kind}_found"),
        lambda m, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("number"),
            F.char_length(pieces[i]).alias("gap"),
            m.alias("value"),
            F.right(pieces[i], F.lit(CONTEXT)).alias("left"),
            F.left(pieces[i + 1], F.lit(CONTEXT)).alias("right"),
        ),
    )


def found_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and all raw matches with their places, one row per match."""
    patterns = dict(PATTERNS, loose=LOOSE, run=RUN)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), text_of().alias("_text"))
    rows = rows.where(F.col("_text").rlike("[0-9@]"))
    for kind, pattern in patterns.items():
        may = F.contains(F.col("_text"), F.lit(NEEDS.get(kind, "")))
        none = F.array().cast("array<string>")
        rows = rows.withColumn(
            f"_{kind}_found", F.when(may, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(none)
        ).withColumn(
            f"_{kind}_between", F.when(F.size(f"_{kind}_found") > 0, F.split("_text", pattern)).otherwise(none)
        )
    rows = rows.select("doc_id", "text_hash", F.concat(*map(_finds, patterns)).alias("finds"))
    # equal rows have equal finds; one of them is enough
    rows = rows.where(F.size("finds") > 0).dropDuplicates(["doc_id", "text_hash"])
    rows = rows.select("doc_id", "text_hash", F.inline("finds"))
    before = Window.partitionBy("doc_id", "text_hash", "kind").orderBy("number")
    end = F.sum(F.col("gap") + F.char_length("value")).over(before.rowsBetween(Window.unboundedPreceding, 0))
    return (
        rows.withColumn("end", end)
        .withColumn("start", F.col("end") - F.char_length("value"))
        .drop("number", "gap")
    )


def _luhn(digits: Column) -> Column:
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.coalesce(d.cast("int"), F.lit(0)) * (F.lit(1) + i % 2),
    )
    total = F.aggregate(doubled, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x))
    return total % 10 == 0


def is_valid() -> Column:
    """The checks of the base on columns kind and value."""
    value, kind = F.col("value"), F.col("kind")
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.char_length(digits)
    # more than nine characters of a part: too large (leading zeros are cut off first)
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    small = F.forall(parts, lambda p: F.when(F.char_length(p) > 3, False).otherwise(p.cast("int") <= 255))
    return (
        (kind == "email")
        | ((kind == "ip") & small)
        | ((kind == "card") & n.between(14, 19) & F.when(n.between(14, 19), _luhn(digits)).otherwise(False))
        | ((kind == "phone") & n.between(10, 15))
    )


def _words(side: str) -> Column:
    """Words of the context, nearest first, without digits and punctuation at the ends."""
    words = F.filter(
        F.transform(
            F.split(F.lower(F.col(side)), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}]+|[^\p{L}]+$", "")
        ),
        lambda w: w != "",
    )
    return F.reverse(words) if side == "left" else words


def contexts() -> Column:
    """Lexical patterns of a string: the word before, the two before, and both sides."""
    before, after = _words("left"), _words("right")
    one, two, right = F.get(before, F.lit(0)), F.get(before, F.lit(1)), F.get(after, F.lit(0))
    return F.filter(
        F.array(
            F.concat(F.lit("L:"), one),
            F.concat(F.lit("LL:"), two, F.lit(" "), one),
            F.concat(F.lit("LR:"), one, F.lit(" _ "), right),
        ),
        lambda x: x.isNotNull(),
    )


def _loose_kind() -> Column:
    """What an identifier-like string looks like, by its characters."""
    value = F.col("value")
    digits = F.char_length(F.regexp_replace(value, "[^0-9]", ""))
    letters = value.rlike(r"\p{L}")
    return (
        F.when(value.contains("@"), "email")
        .when(letters, F.lit(None))
        .when((F.regexp_count(value, F.lit(r"\.")) >= 3) & ~value.contains(" "), "ip")
        .when(digits >= 13, "card")
        .when(digits.between(7, 12), "phone")
    )


def _contradictions(graph: DataFrame) -> DataFrame:
    """Per pattern and kind, how many distinct strings speak against the kind.

    Strings whose characters fit no kind speak against all of them, and finds of the base
    against a kind that they only look like.  Unknown strings that fit say nothing, nor do
    finds that look like another kind.
    """
    loose, looks = F.col("kind") == "loose", F.col("looks")
    odd = {k: F.when(loose, looks.isNull()).otherwise((looks == k) & (F.col("kind") != k)) for k in KINDS}
    flags = [F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(k) for k, c in odd.items()]
    sums = graph.groupBy("pattern", "value").agg(*flags).groupBy("pattern").agg(*(F.sum(k).alias(k) for k in KINDS))
    return sums.select("pattern", F.explode(F.create_map(*(x for k in KINDS for x in (F.lit(k), F.col(k))))).alias("kind", "against"))


def discovered(
    finds: DataFrame, rounds: int | None = None, min_seeds: int = 5, min_confidence: float = 0.9
) -> DataFrame:
    """doc_id, text_hash, kind, start, end of spans that trusted patterns point at.

    ``finds``: base spans (kind) and identifier-like strings (kind ``loose``) that touch
    none.  A pattern counts for a kind by its distinct strings known to be of it, with
    ``min_seeds`` at least, against those that contradict; a string is of a kind when a
    trusted pattern of that kind holds it and its characters fit.  A string's score is
    set when it is found, so sums only grow, and the turns end when no string is new, or
    after ``rounds``.
    """
    graph = finds.select(
        "kind", "value", _loose_kind().alias("looks"), F.explode(contexts()).alias("pattern")
    )
    graph = saved(graph.distinct())
    pairs = graph.select("pattern", "value").distinct()
    loose = graph.where("kind = 'loose'").select("pattern", "value", "looks")
    against = saved(_contradictions(graph))
    fresh = known = graph.where("kind <> 'loose'").select("value", "kind", F.lit(1.0).alias("score")).distinct()
    hits, number = None, 0
    while True:
        gain = pairs.join(fresh, "value").select("pattern", "kind", "score")
        sums = gain if hits is None else hits.withColumnRenamed("hits", "score").unionAll(gain)
        hits = saved(sums.groupBy("pattern", "kind").agg(F.sum("score").alias("hits")))
        trusted = saved(
            hits.where(F.col("hits") >= min_seeds)
            .join(against, ["pattern", "kind"])
            .withColumn("confidence", F.col("hits") / (F.col("hits") + F.col("against")))
            .where(F.col("confidence") >= min_confidence)
            .select("pattern", F.col("kind").alias("looks"), "confidence")
        )
        number += 1
        if number == rounds:
            break
        fresh = saved(
            loose.join(trusted, ["pattern", "looks"])
            .groupBy("value", F.col("looks").alias("kind"))
            .agg(F.max("confidence").alias("score"))
            .join(known, ["value", "kind"], "left_anti")
        )
        if fresh.isEmpty():
            break
        known = saved(known.unionAll(fresh.select(*known.columns)))
    strings = finds.where("kind = 'loose'").select(
        "doc_id", "text_hash", "start", "end", _loose_kind().alias("looks"), F.explode(contexts()).alias("pattern")
    )
    found = (
        strings.join(trusted, ["pattern", "looks"])
        .select("doc_id", "text_hash", F.col("looks").alias("kind"), "start", "end")
        .distinct()
    )
    # a string inside a run that is found as a whole is part of it
    outer = Window.partitionBy("doc_id", "text_hash").orderBy("start", F.desc("end"))
    reach = F.max("end").over(outer.rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("reach", reach).where("reach IS NULL OR reach < end").drop("reach")


def _trimmed(rows: DataFrame) -> DataFrame:
    """Identifier-like strings without the punctuation and the word before ``:`` around them."""
    lead = F.regexp_extract("value", f"^{_LEAD}", 0)
    rest = F.expr("substr(value, char_length(_lead) + 1)")
    value = F.regexp_replace(rest, r"[^\p{L}\p{N}]++$", "")
    bracket = F.col("_lead").endswith("(") & F.col("_value").rlike(r"^[0-9]++\)")
    n_lead = F.char_length("_lead") - bracket.cast("int")
    loose = F.col("kind").isin("loose", "run")
    trimmed = rows.withColumn("_lead", lead).withColumn("_value", value).withColumn("_n", n_lead)
    trimmed = trimmed.select(
        "doc_id",
        "text_hash",
        F.when(loose, "loose").otherwise(F.col("kind")).alias("kind"),
        (F.col("start") + F.when(loose, F.col("_n")).otherwise(0)).alias("start"),
        F.when(loose, F.concat(F.when(bracket, "(").otherwise(""), "_value")).otherwise(F.col("value")).alias("value"),
        F.when(loose, F.right(F.concat("left", F.expr("left(value, _n)")), F.lit(CONTEXT))).otherwise(F.col("left")).alias("left"),
        "right",
    )
    return trimmed.withColumn("end", F.col("start") + F.char_length("value")).where(F.char_length("value") > 0)


def find_personal_data(
    docs: DataFrame, rounds: int | None = None, min_seeds: int = 5, min_confidence: float = 0.9
) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, text_hash) and the spans: doc_id, text_hash, kind, start, end, base."""
    rows = found_rows(docs)
    digits = F.char_length(F.regexp_replace("value", "[^0-9]", ""))
    wanted = (F.col("kind") == "loose") | ((F.col("kind") == "run") & digits.between(*RUN_DIGITS))
    rows = _trimmed(rows.where(wanted | is_valid()))
    # strings that touch a base span are part of it: compare with the nearest on both sides
    by_doc = Window.partitionBy("doc_id", "text_hash").orderBy("start", "end", "kind")
    base = F.col("kind") != "loose"
    last = F.max(F.when(base, F.col("end"))).over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    following = F.min(F.when(base, F.col("start"))).over(by_doc.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("last", last).withColumn("following", following)
    apart = (F.coalesce("last", F.lit(-1)) <= F.col("start")) & (
        F.col("following").isNull() | (F.col("following") >= F.col("end"))
    )
    finds = saved(rows.where(base | apart).drop("last", "following"))
    more = discovered(finds, rounds, min_seeds, min_confidence)
    keys = ["doc_id", "text_hash", "kind", "start", "end"]
    spans = finds.where(base).select(*keys, F.lit(True).alias("base"))
    spans = spans.unionAll(more.select(*keys, F.lit(False).alias("base")))
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash")), spans


def _joined(only_base: bool) -> Column:
    order = F.struct(
        F.col("start"),
        F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("place"),
        F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("text"),
    )
    listed = F.collect_list(F.when(F.col("base"), order)) if only_base else F.collect_list(order)
    return F.array_join(F.transform(F.array_sort(listed), lambda x: x["text"]), ",")


def personal_data_report(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, counts of the base, base_sha256 and spans."""
    rows, spans = find_personal_data(docs, **options)
    counts = [F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS]
    found = saved(
        spans.groupBy("doc_id", "text_hash").agg(*counts, _joined(True).alias("base_spans"), _joined(False).alias("spans"))
    )
    found = found.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    rows = rows.join(
        found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left"
    )
    return rows.select(
        "doc_id",
        *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
