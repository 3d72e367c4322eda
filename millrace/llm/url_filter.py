"""URL verdicts: rules first, and for all other pages trust and distrust propagated over the host graph.

Hosts of pages that an allow rule fits are trusted seeds, hosts of pages that a block rule fits are blocked seeds. Both seed
vectors are weighted by pages and sum to one, so that trust and distrust are compared on one scale. Personalised PageRank from
the trusted seeds runs along host edges, and from the blocked seeds against them (who links to a blocked host is suspect). A
host whose distrust exceeds its trust is blocked.

Host edges are links between hosts found in the pages, counted, and edges both ways between a host and the domain that
contains it. Everything is DataFrame code: links are folded to host edges by partial aggregation, rounds are joins and sums,
several to a job, whose results are written out, and the edges of a host with very many of them are spread over salts, so no
key is hot. What is left to move after k rounds is at most 0.85**k of a seed vector's mass of one: ``ROUNDS`` rounds leave less than
``TOLERANCE``, whatever the graph.

Defined cases: null URLs and those without ``://`` have empty host and path, fit no rule and are allowed; null html has no
links; hosts the graph does not reach have neither trust nor distrust and are allowed, as are those where both are equal (to a
billionth); repeated rows count as pages of their own and are returned each; an empty table gives no rows; very long html is
read whole; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, materialise

DAMPING = 0.85
#: Share of the seeds' mass that may still be moving at the end, and the rounds that follow from it.
TOLERANCE = 1e-4
ROUNDS = math.ceil(math.log(TOLERANCE) / math.log(DAMPING))
#: Rounds of one job, between two written tables.
AT_ONCE = 6
#: Distrust must exceed trust by this factor, so that sums added in another order give the same verdict.
MARGIN = 1 + 1e-9
#: Edges of one host that stay together; a host with more is spread over salts.
EDGES_TOGETHER = 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: An address in double quotes, in single quotes or without.
_HREF = r"""(?i)\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """The host after the first ``://``, A-Z lower-cased; empty where there is none."""
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.coalesce(F.when(F.locate("://", url) > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.coalesce(F.when(F.locate("://", url) > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def matched_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct (``text``, ``verdict``) of the longest rule that fits, else null. Rules are a short list: one expression."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    cases = [(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))) for r in ordered]
    return reduce(lambda case, x: case.when(*x), cases[1:], F.when(*cases[0])) if cases else F.lit(None).cast("struct<text:string,verdict:string>")


def judged(pages: DataFrame, url_col: str, rules: tuple[Rule, ...], keep: list[str]) -> DataFrame:
    """``keep`` with host, path, rule and the rule's verdict."""
    parsed = pages.select(*keep, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    parsed = parsed.withColumn("m", matched_rule(F.col("host"), F.col("path"), rules))
    return parsed.select(*keep, "host", "path", F.col("m.text").alias("rule"), F.col("m.verdict").alias("ruled"))


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``src``, ``dst`` and ``w``: links between different hosts, and one edge each way between a host and its domain."""
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(_HREF), F.lit(1))).alias("link"))
    links = links.withColumn("link", F.trim(F.regexp_replace("link", "^[\"']|[\"']$", "")))
    target = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    linked = links.select("src", host_of(target).alias("dst")).where("src <> '' AND dst <> '' AND src <> dst")
    linked = materialise(linked.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w")), "host-links")
    hosts = pages.select(host_of(F.col(url_col)).alias("host")).union(linked.select("dst")).where("host <> ''").distinct()
    parts = F.split("host", r"\.")
    up = hosts.select(F.explode(F.expr("transform(sequence(0, greatest(size(split(host, '[.]')) - 3, -1) + 1), i -> i)")).alias("i"), parts.alias("p")).where(F.size("p") >= F.col("i") + 3)
    name = lambda at: F.array_join(F.slice("p", at + 1, F.size("p")), ".")
    up = up.select(name(F.col("i")).alias("low"), name(F.col("i") + 1).alias("high")).distinct()
    both = up.select(F.explode(F.array(F.struct(F.col("low").alias("src"), F.col("high").alias("dst")), F.struct(F.col("high").alias("src"), F.col("low").alias("dst")))).alias("e")).select("e.src", "e.dst", F.lit(1.0).alias("w"))
    return materialise(linked.unionByName(both).groupBy("src", "dst").agg(F.sum("w").alias("w")), "host-edges")


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """Personalised PageRank: ``kind``, ``host`` and ``rank`` after ``rounds`` rounds. ``edges`` (``kind``, ``src``, ``dst``, ``w``)
    hold a graph for each kind, ``seeds`` (``kind``, ``host``, ``w``) its teleport vector, which sums to one."""
    out = edges.groupBy("kind", "src").agg(F.sum("w").alias("total"), (1 + F.floor(F.count("*") / EDGES_TOGETHER)).cast("int").alias("salts"))
    out = materialise(out, "host-degrees")
    shared = edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.lit(damping) * F.col("w") / F.col("total")).alias("share"), F.pmod(F.xxhash64("dst"), F.col("salts")).cast("int").alias("salt"))
    shared = materialise(shared, "host-shares")
    salts = materialise(out.select("kind", F.col("src").alias("host"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")), "host-salts")
    hosts = out.count() + seeds.count()
    fresh = seeds.select("kind", "host", (F.col("w") * (1 - damping)).alias("rank"))
    now, stored = seeds.select("kind", "host", F.col("w").alias("rank")), None
    for k in range(1, rounds + 1):
        spread = now.join(salts, ["kind", "host"]).withColumnRenamed("host", "src")
        moved = shared.join(spread, ["kind", "src", "salt"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share")).alias("rank"))
        now = fresh.unionByName(moved).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if k % AT_ONCE == 0 or k == rounds:
            now, last = materialise(now, "host-ranks", hosts), stored
            if last is not None:
                discard(last)
            stored = now
    return now


def verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule``, ``verdict``, ``trust`` and ``distrust`` of every page."""
    ruled = judged(pages, url_col, rules, [id_col])
    counts = ruled.where("host <> '' AND ruled IS NOT NULL").groupBy("host", "ruled").agg(F.count("*").cast("double").alias("w"))
    counts = materialise(counts, "host-seeds")
    weights = counts.groupBy("ruled").agg(F.sum("w").alias("all"))
    seeds = materialise(counts.join(weights, "ruled").select(F.col("ruled").alias("kind"), "host", (F.col("w") / F.col("all")).alias("w")), "host-teleport")
    edges = host_edges(pages, url_col, html_col)
    both = edges.withColumn("kind", F.lit("allow")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w", F.lit("block").alias("kind")))
    ranks = propagate(both, seeds)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0))
    hosts = materialise(ranks.groupBy("host").agg(of("allow").alias("trust"), of("block").alias("distrust")), "host-verdicts")
    joined = ruled.join(hosts, "host", "left")
    trust_of, distrust_of = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    own = F.when(distrust_of > trust_of * MARGIN, "block").otherwise("allow")
    return joined.select(id_col, "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), trust_of.alias("trust"), distrust_of.alias("distrust"))


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    return verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    """The same rounds as one recursion: a step moves what arrived in the last one, and a rank is what arrived in all of them."""
    ordered = sorted(RULES, key=lambda r: (-len(r.text), r.text))
    fits = lambda r: f"(host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}')"
    case = lambda what: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{what(r)}'" for r in ordered) + " END"
    cut = "CASE WHEN instr({u}, '://') > 0 THEN substr({u}, instr({u}, '://') + 3) END"
    host = lambda u: f"coalesce(translate(regexp_extract({cut.format(u=u)}, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '')"
    href = _HREF.replace("'", "''")
    ctes = [
        f"p AS (SELECT page_id, html, {host('url')} AS host, coalesce(regexp_extract({cut.format(u='url')}, '^[^/?#]*([^?#]*)', 1), '') AS path FROM pages)",
        f"r AS (SELECT page_id, host, path, {case(lambda r: r.text)} AS rule, {case(lambda r: r.verdict)} AS ruled FROM p)",
        f"l AS (SELECT host AS src, unnest(regexp_extract_all(html, '{href}', 1)) AS link FROM p)",
        """t AS (SELECT src, trim(regexp_replace(link, '^["'']|["'']$', '', 'g'), ' ') AS link FROM l)""",
        "k AS (SELECT src, CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END AS link FROM t)",
        f"d AS (SELECT src, {host('link')} AS dst FROM k)",
        "links AS (SELECT src, dst, count(*) AS w FROM d WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL)",
        "hosts AS (SELECT host FROM p WHERE host <> '' UNION SELECT dst FROM links)",
        "parts AS (SELECT string_split(host, '.') AS q FROM hosts)",
        "steps AS (SELECT q, unnest(range(0, len(q) - 2)) AS i FROM parts)",
        "up AS (SELECT DISTINCT array_to_string(q[i + 1:], '.') AS low, array_to_string(q[i + 2:], '.') AS high FROM steps)",
        "e AS MATERIALIZED (SELECT src, dst, CAST(sum(w) AS DOUBLE) AS w FROM (SELECT * FROM links UNION ALL SELECT low, high, 1 FROM up UNION ALL SELECT high, low, 1 FROM up) GROUP BY ALL)",
        f"g AS MATERIALIZED (SELECT 'allow' AS kind, src, dst, {DAMPING} * w / sum(w) OVER (PARTITION BY src) AS share FROM e"
        f" UNION ALL SELECT 'block', dst, src, {DAMPING} * w / sum(w) OVER (PARTITION BY dst) FROM e)",
        "c AS (SELECT ruled AS kind, host, CAST(count(*) AS DOUBLE) AS w FROM r WHERE host <> '' AND ruled IS NOT NULL GROUP BY ALL)",
        "seed AS MATERIALIZED (SELECT kind, host, w / sum(w) OVER (PARTITION BY kind) AS w FROM c)",
        "v AS (SELECT kind, 0 AS k, host, w AS rank FROM seed UNION ALL"
        f" SELECT v.kind, v.k + 1, g.dst, sum(v.rank * g.share) FROM v JOIN g ON g.kind = v.kind AND g.src = v.host WHERE v.k < {ROUNDS} GROUP BY v.kind, v.k, g.dst)",
        f"ranks AS (SELECT kind, host, sum(rank * CASE WHEN k < {ROUNDS} THEN {1 - DAMPING} ELSE 1 END) AS rank FROM v GROUP BY ALL)",
    ]
    own = f"CASE WHEN coalesce(b.rank, 0) > coalesce(a.rank, 0) * {MARGIN!r} THEN 'block' ELSE 'allow' END"
    return (
        "WITH RECURSIVE " + ",\n".join(ctes) + f"\nSELECT r.page_id, r.host, r.path, r.rule, coalesce(r.ruled, {own}) AS verdict "
        "FROM r LEFT JOIN ranks a ON a.host = r.host AND a.kind = 'allow' LEFT JOIN ranks b ON b.host = r.host AND b.kind = 'block'"
    )


ORACLE = _oracle()
