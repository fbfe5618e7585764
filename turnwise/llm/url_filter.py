"""Operator 4: URL rules, and trust that flows along links for hosts no rule names.

Hosts are nodes, links between pages of different hosts are edges.  Personalised
PageRank spreads trust from hosts with allowed pages along the links, and distrust from
hosts with blocked pages against them.  A page without a rule gets its host's verdict.
DataFrame functions only; a host pair is one weighted edge before anything is joined.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no
rule, sends and gets no links and is allowed; equal rows stay separate rows; null html
has no links; a host without links or seeds is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import lower_ascii, saved

#: The rules (host, path, verdict).  The list is part of the plan, so it is
#: bounded by what its author writes, not by the data.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)(?:href|src)\s*+=\s*+["']?(?:[a-z][a-z0-9+.-]*+:)?//([^/?#"'\s<>]++)"""


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(url, _URL, 1)), F.regexp_extract(url, _URL, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null; block wins a tie."""
    name = verdict = F.lit(None).cast("string")
    for r_host, r_path, r_verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "block")):
        fits = ((host == r_host) | host.endswith("." + r_host)) & path.startswith(r_path)
        name = F.when(fits, r_host + r_path).otherwise(name)
        verdict = F.when(fits, r_verdict).otherwise(verdict)
    return name, verdict


def judged_by_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.withColumn("rule", name).withColumn("ruled", verdict)


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, share: the part of a host's outgoing links, and back: of dst's incoming."""
    host, _ = split_url(F.col("url"))
    links = pages.select(
        host.alias("src"),
        F.explode(F.regexp_extract_all(F.col("html"), F.lit(_LINK), F.lit(1))).alias("dst"),
    )
    links = links.select("src", lower_ascii(F.col("dst")).alias("dst")).where("src <> '' and src <> dst")
    edges = saved(links.groupBy("src", "dst").agg(F.count("*").alias("n")))
    out = saved(edges.groupBy("src").agg(F.sum("n").alias("n_out")))
    into = saved(edges.groupBy("dst").agg(F.sum("n").alias("n_in")))
    return saved(
        edges.join(out, "src")
        .join(into, "dst")
        .select("src", "dst", (F.col("n") / F.col("n_out")).alias("share"), (F.col("n") / F.col("n_in")).alias("back"))
    )


def host_scores(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 8) -> DataFrame:
    """host, trust, distrust.  ``seeds``: host, good, bad (0 to 1).

    Scores are in units of the seed: a lone host keeps exactly its own.  Each round
    moves one narrow row per edge and sums on both sides of the shuffle.
    """
    scores = seeds.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    zero = F.lit(0.0)
    for number in range(rounds):
        forward = edges.join(scores, edges["src"] == scores["host"]).select(
            F.col("dst").alias("host"), (F.col("share") * F.col("trust") * damping).alias("trust"), zero.alias("distrust")
        )
        backward = edges.join(scores, edges["dst"] == scores["host"]).select(
            F.col("src").alias("host"), zero.alias("trust"), (F.col("back") * F.col("distrust") * damping).alias("distrust")
        )
        own = seeds.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
        scores = (
            own.unionAll(forward)
            .unionAll(backward)
            .groupBy("host")
            .agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        )
        if number % 2 or number == rounds - 1:
            scores = saved(scores)
    return scores


def settled_scores(
    seeds: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, most_rounds: int = 300
) -> DataFrame:
    """Like :func:`host_scores`, until no host's score grows by more than ``tolerance``.

    A round moves what the last one added and adds what arrives, so it ends by itself on
    a graph without cycles.  Raises if the rounds do not suffice, rather than stop early.
    """
    scores = step = seeds.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    zero = F.lit(0.0)
    sums = (F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    for _ in range(most_rounds):
        forward = edges.join(step, edges["src"] == step["host"]).select(
            F.col("dst").alias("host"), (F.col("share") * F.col("trust") * damping).alias("trust"), zero.alias("distrust")
        )
        backward = edges.join(step, edges["dst"] == step["host"]).select(
            F.col("src").alias("host"), zero.alias("trust"), (F.col("back") * F.col("distrust") * damping).alias("distrust")
        )
        moved = forward.unionAll(backward).groupBy("host").agg(*sums)
        step = saved(moved.where("trust > 0 or distrust > 0"))
        largest = step.agg(F.max(F.greatest("trust", "distrust"))).first()[0]
        if largest is None:
            return scores
        scores = saved(scores.unionAll(step).groupBy("host").agg(*sums))
        if largest <= tolerance:
            return scores
    raise RuntimeError("trust and distrust did not settle")


def judge_urls(
    pages: DataFrame, rules=RULES, damping: float = 0.85, rounds: int | None = 8, distrust: float = 0.5
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    A host is blocked when its distrust reaches ``distrust`` and exceeds its trust.
    ``rounds`` is how far scores travel; None lets them travel until they settle.
    """
    ruled = saved(judged_by_rules(pages, rules))
    share = lambda what: F.avg((F.coalesce("ruled", F.lit("")) == what).cast("double"))
    seeds = saved(
        ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad"))
    )
    edges = host_edges(pages)
    scores = settled_scores(seeds, edges, damping) if rounds is None else host_scores(seeds, edges, damping, rounds)
    bad = (F.col("distrust") >= distrust) & (F.col("distrust") > F.col("trust"))
    return ruled.join(scores, "host", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", F.when(bad, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
