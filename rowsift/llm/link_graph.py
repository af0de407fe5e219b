"""URL verdicts by rules and by trust propagated over the host graph.

DataFrame functions only. Every url is split into host and path, matched
against the rules (longest that fits wins), and urls without a rule get the
verdict of their host:

* edges run from the host of a page to the hosts its html links to, counted
  once per page; links inside a host are no evidence and are left out;
* *trust* is personalised PageRank from the hosts with allowed pages, along
  links; *distrust* is personalised PageRank from the hosts with blocked
  pages, against links (who links to a blocked host is suspect);
* both are shares that sum to one. A host is blocked when its distrust exceeds
  ``threshold`` times the sum of its trust and its share of all pages, so a
  host needs markedly more distrust than its size explains.

Rank leaves a host in proportion to its link counts; hosts without links
return theirs to the seeds. Every iteration is a join and a grouped sum over
the table of distinct edges, pre-summed in each task; ranks are cut from their
history by a checkpoint in the shared folder. A host with a third of all pages
is one row of the edge and rank tables, and pages meet their host's verdict by
a join that Spark broadcasts below its limit and splits when skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsift.session import ensure_checkpoint_dir

#: host/path -> verdict
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
ITERATIONS = 12
DAMPING = 0.7
THRESHOLD = 1.5
#: The host of a link, with a scheme or relative to the page's (``//host/``). No two runs of
#: blanks adjoin, so a search is linear in the text; classes are spelled out, so that Spark and SQL agree.
_GAP = r"[ \t\n\f\r]*"
LINK = (r"(?:[hH][rR][eE][fF]|[sS][rR][cC])" + _GAP + "=" + _GAP + r"""(?:["']""" + _GAP + ")?"
        r"""(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^ \t\n\f\r"'>/?#]+)""")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(_lower(F.regexp_substr(_after_scheme(url), F.lit(r"^[^/?#]*"))), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict) -> Column:
    """The longest rule that fits: its host or a subdomain, and a path that begins with the rule's."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r), r))[::-1]:
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _verdict(rule: Column, rules: dict) -> Column:
    out = F.lit(None).cast("string")
    for name, verdict in rules.items():
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def propagate(edges: DataFrame, seeds: DataFrame, *, iterations: int = ITERATIONS, damping: float = DAMPING) -> DataFrame:
    """Personalised PageRank: ``(host, rank)`` from ``edges(src, dst, n)`` and ``seeds(host, mass)``.

    ``mass`` need not sum to one; without any mass all ranks are absent (an
    empty table). Ranks sum to one up to rounding.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    start = (seeds.where("mass > 0")
             .select("host", (F.col("mass") / seeds.agg(F.sum("mass")).scalar()).alias("restart"))).checkpoint()
    out_links = edges.groupBy("src").agg(F.sum("n").alias("out"))
    steps = edges.join(out_links, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("w")).checkpoint()
    sources = steps.select("src").distinct()
    rank = start.select("host", F.col("restart").alias("rank"))
    for _ in range(iterations):
        moved = (steps.join(rank, steps["src"] == rank["host"]).groupBy("dst")
                 .agg(F.sum(F.col("w") * F.col("rank")).alias("got")))
        # what flows along no link goes back to the seeds
        flown = (rank.join(sources, rank["host"] == sources["src"], "left_semi")
                 .agg(F.coalesce(F.sum("rank"), F.lit(0.0)))).scalar()
        rank = (moved.join(start, moved["dst"] == start["host"], "full_outer")
                .select(F.coalesce("dst", "host").alias("host"),
                        (damping * F.coalesce("got", F.lit(0.0))
                         + (1 - damping * flown) * F.coalesce("restart", F.lit(0.0))).alias("rank"))).checkpoint()
    return rank


def judge_urls(pages: DataFrame, rules: dict | None = None, *, page_id: str = "page_id", url: str = "url",
               html: str = "html", iterations: int = ITERATIONS, damping: float = DAMPING,
               threshold: float = THRESHOLD) -> DataFrame:
    """``page_id, host, path, rule, verdict`` per row of ``pages``.

    ``rule`` is null where none fits; then the verdict is that of the host,
    ``allow`` for a url without host (null, or no ``://``). A null html has no
    links, one of any length is searched whole in time linear in it; repeated
    rows each give a row and count as pages; an empty table gives an empty one;
    further columns are not read.
    """
    rules = RULES if rules is None else rules
    ensure_checkpoint_dir(pages.sparkSession)
    link = F.col(f"`{url}`").cast("string")
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), host_of(link).alias("host"),
                        path_of(link).alias("path"), F.col(f"`{html}`").cast("string").alias("html"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("ruled", _verdict(F.col("rule"), rules))
    hosts = (rows.where("host <> ''").groupBy("host")
             .agg(F.count(F.lit(1)).alias("pages"),
                  F.sum(F.when(F.col("ruled") == "allow", 1).otherwise(0)).alias("allowed"),
                  F.sum(F.when(F.col("ruled") == "block", 1).otherwise(0)).alias("blocked"))).checkpoint()
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1)), _lower))
    edges = (rows.where("host <> '' AND html IS NOT NULL").select(F.col("host").alias("src"), F.explode(found).alias("dst"))
             .where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))).checkpoint()
    trust = propagate(edges, hosts.select("host", F.col("allowed").alias("mass")), iterations=iterations, damping=damping)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = propagate(back, hosts.select("host", F.col("blocked").alias("mass")), iterations=iterations, damping=damping)
    share = F.col("pages") / hosts.agg(F.sum("pages")).scalar()
    judged = (hosts.join(trust.select("host", F.col("rank").alias("trust")), "host", "left")
              .join(distrust.select("host", F.col("rank").alias("distrust")), "host", "left")
              .select("host", F.when(F.coalesce("distrust", F.lit(0.0)) > threshold
                                     * (F.coalesce("trust", F.lit(0.0)) + share), "block")
                      .otherwise("allow").alias("of_host"))).checkpoint()
    slim = rows.select("page_id", "host", "path", "rule", "ruled")
    return (slim.join(judged, "host", "left")
            .select("page_id", "host", "path", "rule", F.coalesce("ruled", "of_host", F.lit("allow")).alias("verdict")))


def judge_sql(rules: dict | None = None, *, iterations: int = ITERATIONS, damping: float = DAMPING,
              threshold: float = THRESHOLD) -> str:
    """The same judgement in DuckDB SQL over ``pages``, the iterations written out.

    It knows links with a scheme only, so it agrees where no link is ``//host/``.
    """
    rules = RULES if rules is None else rules

    def fits(rule):
        name, _, rest = rule.partition("/")
        return f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}')"

    order = sorted(rules, key=lambda r: (-len(r), r))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for r in order) + " END"
    ruled = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in rules.items()) + " END"
    link = LINK.replace("'", "''")
    parts = [
        "u AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest "
        "FROM pages)",
        f"h AS (SELECT page_id, html, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '') AS host, "
        "coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u)",
        f"r AS (SELECT *, {rule} AS rule FROM h)",
        f"p AS (SELECT *, {ruled} AS ruled FROM r)",
        "hosts AS (SELECT host, count(*) AS pages, count(*) FILTER (ruled = 'allow') AS allowed, "
        "count(*) FILTER (ruled = 'block') AS blocked FROM p WHERE host <> '' GROUP BY host)",
        "l AS (SELECT host AS src, unnest(list_distinct(list_transform("
        f"regexp_extract_all(html, '{link}', 1), lambda x: translate(x, '{_UPPER}', '{_LOWER}')))) AS dst FROM p "
        "WHERE host <> '' AND html IS NOT NULL)",
        "edges AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> dst GROUP BY src, dst)",
    ]
    for way, src, dst, mass in (("t", "src", "dst", "allowed"), ("d", "dst", "src", "blocked")):
        parts += [
            f"{way}_start AS (SELECT host, {mass} / sum({mass}) OVER () AS restart FROM hosts WHERE {mass} > 0)",
            f"{way}_steps AS (SELECT {src} AS src, {dst} AS dst, n / sum(n) OVER (PARTITION BY {src}) AS w FROM edges)",
            f"{way}0 AS (SELECT host, restart AS rank FROM {way}_start)"]
        for k in range(iterations):
            parts.append(
                f"{way}{k + 1} AS MATERIALIZED (SELECT coalesce(m.dst, s.host) AS host, {damping!r} * coalesce(got, 0) "
                f"+ (1 - {damping!r} * flown) * coalesce(restart, 0) AS rank FROM "
                f"(SELECT dst, sum(w * rank) AS got FROM {way}_steps JOIN {way}{k} ON src = host GROUP BY dst) m "
                f"FULL JOIN {way}_start s ON m.dst = s.host CROSS JOIN (SELECT coalesce(sum(rank), 0) AS flown FROM {way}{k} "
                f"WHERE host IN (SELECT src FROM {way}_steps)) f)")
    return ("WITH " + ",\n".join(parts) + f"""
SELECT page_id, p.host, path, rule, coalesce(ruled, CASE WHEN coalesce(d.rank, 0) >
  {threshold!r} * (coalesce(t.rank, 0) + x.pages / (SELECT sum(pages) FROM hosts)) THEN 'block' ELSE 'allow' END, 'allow') AS verdict
FROM p LEFT JOIN hosts x ON x.host = p.host LEFT JOIN t{iterations} t ON t.host = p.host
LEFT JOIN d{iterations} d ON d.host = p.host""")
