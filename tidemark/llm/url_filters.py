"""URL filters: host and path rules, and for hosts no rule fits link-graph propagation. DataFrame functions only.

Edges join a page's host with the hosts its absolute links name, and every host with its parent domain in either direction
(a site's own hosts vouch for each other) up to the domain that was registered: no edge leads to a suffix such as com or co.uk, under
which unrelated sites lie. Personalised PageRank runs from trusted seeds along the edges; distrust runs from
blocked seeds along reversed edges. Both go on until no host's rank changes by more than TOLERANCE of itself within ROUNDS rounds, and
so reach every host that links reach. Seeds are hosts, weighed by their pages that rules allow or block. A host whose distrust
exceeds THRESHOLD times its trust is blocked; a host that neither reaches is allowed.

Edge cases: null url, or no `://`: host and path empty, no rule, allowed; a rule without fitting path is no rule; repeated
pages are judged each; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Fixed rules: verdict, host, path prefix.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
DAMPING = 0.85
#: Rounds between two stores, and the largest relative change within them at which ranks are final: what is to come after it is then
#: below 1.3 % of a rank, as changes shrink by DAMPING with each round.
ROUNDS = 6
TOLERANCE = 0.02
THRESHOLD = 1.0
#: Suffixes of two labels under which domains are registered: a generic label before a country's.
SUFFIX = r"^(?:ac|co|com|edu|go|gob|gov|gouv|mil|ne|net|nom|or|org|sch)\.[a-z]{2}$"
LINK = r"""(?i)href\s*=\s*["']?https?://([^/"'?#\s>:]+)"""


def lower_ascii(c):
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: str = "url"):
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.expr(f"substring(coalesce(`{url}`, ''), instr(coalesce(`{url}`, ''), '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def longest_rule(host, path):
    """The fitting rule with the longest host, then path, as struct(rule, verdict); null if none fits."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(RULES, key=lambda r: (len(r[1] + r[2]))):
        found = F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def spread(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank of each kind: seeds(kind, host, w) over edges(kind, a, b, share), share of what a hands on to b. Kinds don't
    meet; they go through the same rounds. -> (kind, host, rank)"""
    start = seeds.groupBy("kind", "host").agg(F.sum("w").alias("w")).where("w > 0")
    whole = start.groupBy(F.col("kind").alias("kind_")).agg(F.sum("w").alias("total"))  # a row for each kind
    start = stored(start.join(F.broadcast(whole), F.col("kind") == F.col("kind_")).select("kind", "host", (F.col("w") / F.col("total")).alias("w")))
    again = start.select("kind", "host", (F.col("w") * (1 - DAMPING)).alias("rank"))
    rank = start.select("kind", "host", F.col("w").alias("rank"))
    while True:
        last = rank.select(F.col("kind").alias("last_kind"), F.col("host").alias("last_host"), F.col("rank").alias("last"))
        for _ in range(rounds):
            passed = rank.join(edges, (rank["kind"] == edges["edge_kind"]) & (rank["host"] == edges["a"]))
            passed = passed.select("kind", F.col("b").alias("host"), (F.col("rank") * F.col("share") * DAMPING).alias("rank"))
            rank = passed.unionByName(again).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        rank = stored(rank)
        # a host reached only now has changed by all its rank
        change = F.abs(F.col("rank") - F.coalesce("last", F.lit(0.0))) / F.col("rank")
        met = rank.join(last, (F.col("kind") == F.col("last_kind")) & (F.col("host") == F.col("last_host")), "left")
        worst = met.where("rank > 0").agg(F.max(change).alias("worst")).first()["worst"]
        if worst is None or worst <= tolerance:
            return rank


def judged(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, host, path, rule, verdict."""
    host, path = host_and_path()
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    based = split.withColumn("found", longest_rule(F.col("host"), F.col("path")))
    links = pages.select(host.alias("a"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(LINK), F.lit(1)))).alias("b")).select("a", lower_ascii(F.col("b")).alias("b"))
    links = links.where("a <> '' and b <> '' and a <> b").groupBy("a", "b").agg(F.count("*").cast("double").alias("n"))
    hosts = stored(based.where("host <> ''").groupBy("host").agg(F.sum(F.when(F.col("found.verdict") == "allow", 1.0).otherwise(0.0)).alias("trusted"), F.sum(F.when(F.col("found.verdict") == "block", 1.0).otherwise(0.0)).alias("blocked")))
    parent = hosts.select(F.col("host").alias("a"), F.expr("substring(host, instr(host, '.') + 1)").alias("b")).where("instr(a, '.') > 0 and instr(b, '.') > 0").where(~F.rlike(F.col("b"), F.lit(SUFFIX)))
    near = parent.unionByName(parent.select(F.col("b").alias("a"), F.col("a").alias("b"))).select("a", "b", F.lit(1.0).alias("n"))
    edges = stored(links.unionByName(near).groupBy("a", "b").agg(F.sum("n").alias("n")))

    # trust goes along the links, distrust against them
    both = edges.select(F.lit("trust").alias("edge_kind"), "a", "b", "n").unionByName(edges.select(F.lit("distrust").alias("edge_kind"), F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    out = both.groupBy(F.col("edge_kind").alias("kind_"), F.col("a").alias("from_")).agg(F.sum("n").alias("all_"))
    both = both.join(out, (F.col("edge_kind") == F.col("kind_")) & (F.col("a") == F.col("from_")))
    both = stored(both.select("edge_kind", "a", "b", (F.col("n") / F.col("all_")).alias("share")))
    seeds = hosts.select(F.lit("trust").alias("kind"), "host", F.col("trusted").alias("w")).unionByName(hosts.select(F.lit("distrust").alias("kind"), "host", F.col("blocked").alias("w")))
    rank = spread(seeds, both)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind)
    said = stored(rank.groupBy(F.col("host").alias("h")).agg(of("trust"), of("distrust")))
    open_ = F.when(F.coalesce("distrust", F.lit(0.0)) > THRESHOLD * F.coalesce("trust", F.lit(0.0)), "block").otherwise("allow")
    ranks = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust")]
    verdict = F.coalesce("found.verdict", open_).alias("verdict")
    return based.join(said, F.col("host") == F.col("h"), "left").select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict, *ranks)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))
