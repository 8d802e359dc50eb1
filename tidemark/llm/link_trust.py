"""URL verdicts from path rules and from trust and distrust spread over links between hosts.

Pages that a rule judges are seeds: allowed pages give their host trust, blocked
pages give it distrust, one unit a page.  Personalised PageRank carries trust
along links; distrust goes against them, to hosts that link to blocked ones.
A host whose distrust exceeds ``threshold`` times its trust is blocked.
All steps are DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch

#: (verdict, host, path); a rule covers its host and all subdomains.
Rule = tuple[str, str, str]
MAX_RULES = 500
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
ABSOLUTE_LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]*)"""


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z folded; else empty."""
    host = F.regexp_extract(url, URL_PARTS, 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits as struct(length, rule, verdict), or null.

    Equally long rules are ordered by their text, the greatest wins.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules are compiled into the plan")
    fits = [
        F.when(
            ((host == h) | host.endswith(f".{h}")) & path.startswith(p),
            F.struct(
                F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")
            ),
        )
        for v, h, p in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast(
        "struct<length:int,rule:string,verdict:string>"
    )


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): absolute links between different hosts, counted."""
    return (
        pages.select(
            host_of(F.col("url")).alias("src"),
            F.explode(F.regexp_extract_all("html", F.lit(ABSOLUTE_LINK), 1)).alias("dst"),
        )
        .select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
        .filter("src <> '' AND dst <> '' AND src <> dst")
        .groupBy("src", "dst")
        .agg(F.count("*").cast("double").alias("weight"))
    )


def spread(
    seeds: DataFrame,
    edges: DataFrame,
    scratch: Scratch,
    *,
    damping: float = 0.85,
    tolerance: float = 1e-9,
    rounds_per_table: int = 5,
) -> DataFrame:
    """Scores (host, kind, score) after personalised PageRank from ``seeds`` (host, kind, mass).

    Kind ``trust`` follows edges, kind ``distrust`` goes against them.  Mass that
    reaches a host without edges in its direction ends there.  Rounds go on until
    ``rounds_per_table`` of them change no host's score by more than ``tolerance``
    times that score, whatever the size of the corpus; a host that is reached for
    the first time changes by all of it.  As each round carries ``damping`` times
    the change of the one before, that takes about log(tolerance) / log(damping)
    rounds (127) beyond the longest way, and fewer without circles of links.
    """
    if not 0 < damping < 1:
        raise ValueError("damping lies between 0 and 1")
    ways = edges.select(
        F.lit("trust").alias("kind"), F.col("src").alias("at"), F.col("dst").alias("to"), "weight"
    ).union(edges.select(F.lit("distrust"), "dst", "src", "weight"))
    total = ways.groupBy("kind", "at").agg(F.sum("weight").alias("total"))
    ways = scratch.save(
        ways.join(total, ["kind", "at"]).select(
            F.col("kind").alias("way"), "at", "to", (F.col("weight") / F.col("total") * damping).alias("share")
        ),
        "ways",
    )
    base = seeds.select("host", "kind", (F.col("mass") * (1 - damping)).alias("score"))
    state = base
    for i in count():
        before = state
        for _ in range(rounds_per_table):
            moved = state.join(
                ways, (F.col("host") == F.col("at")) & (F.col("kind") == F.col("way"))
            ).select(F.col("to").alias("host"), "kind", (F.col("score") * F.col("share")).alias("score"))
            state = (
                base.union(moved).groupBy("host", "kind").agg(F.sum("score").alias("score"))
            )
        state = scratch.save(state, f"state-{i}")
        moving = (
            state.select("host", "kind", "score", F.lit(0.0).alias("old"))
            .union(before.select("host", "kind", F.lit(0.0), "score"))
            .groupBy("host", "kind")
            .agg(F.sum("score").alias("score"), F.sum("old").alias("old"))
            .filter(F.abs(F.col("score") - F.col("old")) > F.col("score") * tolerance)
        )
        done = not moving.take(1)
        scratch.drop(f"state-{i - 1}")
        if done:
            return state


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    *,
    threshold: float = 1.0,
    damping: float = 0.85,
    tolerance: float = 1e-9,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust), a row for each row of ``pages``.

    ``rule`` is host and path of the longest rule that fits, or null; it decides.
    Other pages get their host's verdict: ``block`` when its distrust exceeds
    ``threshold`` times its trust, else (equal scores and unknown hosts too)
    ``allow``.  Scores are rounded to nine places before they are compared.

    A null url, or one without ``://``, has empty host and path, no links and the
    verdict ``allow``.  Null html has no links.  Repeated pages count as often as
    they occur; columns besides page_id, url and html are not read.  An empty
    table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "link-trust")
    judged = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    judged = scratch.save(
        judged.withColumn("best", rule_of(F.col("host"), F.col("path"), rules)).select(
            "page_id",
            "host",
            "path",
            F.col("best.rule").alias("rule"),
            F.col("best.verdict").alias("by_rule"),
        ),
        "judged",
    )
    seeds = scratch.save(
        judged.filter("by_rule IS NOT NULL AND host <> ''")
        .groupBy("host", F.when(F.col("by_rule") == "allow", "trust").otherwise("distrust").alias("kind"))
        .agg(F.count("*").cast("double").alias("mass")),
        "seeds",
    )
    edges = scratch.save(host_edges(pages), "edges")
    scores = spread(seeds, edges, scratch, damping=damping, tolerance=tolerance)

    def of(kind: str) -> Column:
        return F.round(F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)), 9)

    hosts = scores.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))
    known = judged.join(hosts, "host", "left").fillna(0.0, ["trust", "distrust"])
    by_host = F.when(F.col("distrust") > F.col("trust") * threshold, "block").otherwise("allow")
    return known.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("by_rule", by_host).alias("verdict"),
        "trust",
        "distrust",
    )


def oracle(rules: Sequence[Rule], damping: float = 0.85, rounds: int = 150) -> str:
    """DuckDB SQL for (page_id, host, path, rule, verdict) of :func:`judge_urls` on the view ``pages``.

    SQL runs a fixed number of rounds; 150 leave less than 1e-10 of a circle's mass.
    """
    listed = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    fold = f"'{UPPER}', '{LOWER}'"
    link = ABSOLUTE_LINK.replace("'", "''")
    steps = ["s0 AS MATERIALIZED (SELECT host, kind, score FROM base)"]
    for i in range(1, rounds + 1):
        steps.append(
            f"s{i} AS MATERIALIZED (SELECT host, kind, sum(score) AS score FROM (SELECT * FROM base UNION ALL "
            f"SELECT w.dst, w.kind, s.score * w.share FROM s{i - 1} s JOIN ways w ON s.host = w.here AND s.kind = w.kind) "
            "GROUP BY ALL)"
        )
    return f"""
WITH r(v, h, p) AS (VALUES {listed}),
parts AS (SELECT page_id, html,
  translate(coalesce(regexp_extract(url, '{URL_PARTS}', 1), ''), {fold}) AS host,
  coalesce(regexp_extract(url, '{URL_PARTS}', 2), '') AS path FROM pages),
pairs AS (SELECT DISTINCT host, path FROM parts),
best AS (SELECT host, path, max({{'n': length(h || p), 'rule': h || p, 'verdict': v}}) AS b
  FROM pairs JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL),
judged AS MATERIALIZED (SELECT parts.page_id, parts.host, parts.path, b.rule AS rule, b.verdict AS by_rule
  FROM parts LEFT JOIN best ON parts.host = best.host AND parts.path = best.path),
base AS MATERIALIZED (SELECT host, CASE WHEN by_rule = 'allow' THEN 'trust' ELSE 'distrust' END AS kind,
  count(*) * {1 - damping}::DOUBLE AS score FROM judged WHERE by_rule IS NOT NULL AND host <> '' GROUP BY ALL),
raw AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), {fold}) AS dst FROM parts),
edges AS MATERIALIZED (SELECT src, dst, count(*)::DOUBLE AS weight FROM raw
  WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
both_ways AS (SELECT 'trust' AS kind, src AS here, dst, weight FROM edges
  UNION ALL SELECT 'distrust', dst, src, weight FROM edges),
ways AS MATERIALIZED (SELECT kind, here, dst, weight / sum(weight) OVER (PARTITION BY kind, here) * {damping} AS share FROM both_ways),
{", ".join(steps)},
hosts AS (SELECT host, round(coalesce(sum(score) FILTER (kind = 'trust'), 0), 9) AS trust,
  round(coalesce(sum(score) FILTER (kind = 'distrust'), 0), 9) AS distrust FROM s{rounds} GROUP BY ALL)
SELECT page_id, judged.host, path, rule,
  coalesce(by_rule, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN hosts ON judged.host = hosts.host"""
