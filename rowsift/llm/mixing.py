"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed over cells (source, language, topic). Raking multiplies the
weight of each cell by target share over present share of its source, then of
its language, then of its topic, and starts again, until no factor moves by
more than ``tolerance`` or ``sweeps`` is reached. Documents are then sampled
with a probability in proportion to the factor of their cell.

A probability cannot pass one. Cells that would need more are held at one, and
the others are raked anew to what the targets leave for them, until none
passes one (up to ``rounds`` times). What no sample can reach, because a value
has too few tokens even when all of them are kept, shows in ``margins``.

Targets are stated per margin either as a power (shares go as the tokens of a
value to that power, so 1 keeps the mix and 0 levels it) or as a dictionary
of shares; values that it does not list divide what it leaves over among them
in proportion to their tokens.

All of it are grouped sums and joins over the table of cells, written once
per sweep; a table measured at up to ``DRIVER_CELLS`` cells is raked by numpy
on the driver with the same steps. Documents are read once for their sizes and
once to be sampled. A source that holds a third of all rows is pre-summed in each task before
anything is shuffled, and rows meet their cell's factor by a join that Spark
broadcasts only when the table of cells, written before, is below its limit.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_or_empty

MARGINS = ("source", "lang", "topic")
NONE = "(none)"
WORD = r"[^\x20\x09-\x0D]+"
#: Exact in a double, and in SQL engines without unsigned hashes.
HASH_DIGITS = 12
#: Tables of up to this many cells (measured; 40 bytes each) are raked on the driver.
DRIVER_CELLS = 200_000
#: Most times that cells are held at probability one and the others raked again.
ROUNDS = 4


def words(text: str = "text") -> Column:
    """Words of a text (null: none): the token measure of the queries."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def form(text: str = "text", n_words: Column | None = None) -> Column:
    """A document's kind by its form, used as topic: table, note, article or long read."""
    n = words(text) if n_words is None else n_words
    return (F.when(F.contains(text_or_empty(text), F.lit(" | ")), "table")
            .when(n < 100, "note").when(n < 800, "article").otherwise("long"))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by the key and the seed (MD5 digits)."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, HASH_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / float(16 ** HASH_DIGITS)


def _draw_keys(rows: DataFrame, doc_id: str) -> tuple[DataFrame, Column]:
    """``rows`` with what the draw needs, and the key of each row's draw: its
    id, or its place in the table where the id is null or repeated."""
    ids = rows.select(F.col(doc_id).cast("string").alias("_ipf_id")).where(F.col("_ipf_id").isNotNull())
    again = staged(ids.groupBy("_ipf_id").count().where("count > 1").select("_ipf_id", F.lit(True).alias("_ipf_again")), "repeated-ids")
    rows = rows.withColumn("_ipf_id", F.col(doc_id).cast("string")).withColumn("_ipf_row", F.monotonically_increasing_id())
    if again.isEmpty():
        rows = rows.withColumn("_ipf_again", F.lit(None).cast("boolean"))
    else:
        rows = rows.join(again, "_ipf_id", "left")
    own = F.concat(F.coalesce("_ipf_id", F.lit("")), F.lit(":row "), F.col("_ipf_row").cast("string"))
    return rows, F.when(F.col("_ipf_id").isNull() | F.col("_ipf_again").isNotNull(), own).otherwise(F.col("_ipf_id"))


def _targets(cells: DataFrame, margin: str, rule) -> DataFrame:
    """``(margin, share)`` for the values that have tokens."""
    present = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0")
    if isinstance(rule, dict):
        pairs = [x for v, s in rule.items() for x in (F.lit(v), F.lit(float(s)))]
        listed = F.element_at(F.create_map(*pairs), F.col(margin))
        left = max(0.0, 1.0 - sum(rule.values()))
        rest = present.agg(F.sum(F.when(listed.isNull(), F.col("t")))).scalar()
        raw = present.select(margin, F.coalesce(listed, F.lit(left) * F.col("t") / rest).alias("raw"))
    else:
        raw = present.select(margin, F.pow("t", F.lit(float(rule))).alias("raw"))
    return raw.select(margin, (F.col("raw") / raw.agg(F.sum("raw")).scalar()).alias("share"))


def _sweep(now: DataFrame, goals: dict) -> DataFrame:
    """One round over the margins; held cells stay and take their part of each goal."""
    step = now.withColumn("moved", F.lit(0.0))
    weight = F.col("tokens") * F.col("factor")
    for m, goal in goals.items():
        sums = (step.groupBy(m).agg(F.sum(F.when(~F.col("held"), weight)).alias("free"),
                                    F.coalesce(F.sum(F.when(F.col("held"), weight)), F.lit(0.0)).alias("fixed"))
                .join(goal, m).where("free > 0")
                .select(m, (F.greatest(F.col("goal") - F.col("fixed"), F.lit(0.0)) / F.col("free")).alias("ratio")))
        step = (step.join(sums, m, "left")
                .withColumn("ratio", F.when(F.col("held"), 1.0).otherwise(F.coalesce("ratio", F.lit(1.0))))
                .withColumn("factor", F.col("factor") * F.col("ratio"))
                .withColumn("moved", F.greatest("moved", F.abs(F.col("ratio") - 1)))
                .drop("ratio"))
    return step


def _rake_frame(cells, goals: dict, ceiling: float | None, sweeps: int, tolerance: float, rounds: int):
    """The same steps in numpy over a small table of cells."""
    tokens = cells["tokens"].to_numpy(dtype=np.float64)
    factor, held = np.ones(len(cells)), np.zeros(len(cells), bool)
    codes, wanted = {}, {}
    for m, goal in goals.items():
        names, codes[m] = np.unique(cells[m].to_numpy(dtype=object).astype(str), return_inverse=True)
        wanted[m] = np.array([goal.get(n, np.nan) for n in names])
    for again in range(rounds + 1):
        if again:
            above = ~held & (factor > ceiling)
            if not above.any():
                break
            held |= above
            factor[above] = ceiling
        for _ in range(sweeps):
            moved = 0.0
            for m, at in codes.items():
                w = tokens * factor
                free = np.bincount(at, np.where(held, 0.0, w), len(wanted[m]))
                fixed = np.bincount(at, np.where(held, w, 0.0), len(wanted[m]))
                with np.errstate(divide="ignore", invalid="ignore"):
                    ratio = np.maximum(wanted[m] - fixed, 0.0) / free
                ratio = np.where((free > 0) & ~np.isnan(wanted[m]), ratio, 1.0)[at]
                ratio = np.where(held, 1.0, ratio)
                factor = factor * ratio
                moved = max(moved, float(np.abs(ratio - 1).max(initial=0.0)))
            if moved <= tolerance:
                break
        if ceiling is None:
            break
    return factor, held


def rake(cells: DataFrame, targets: dict, *, ceiling: float | None = None, sweeps: int = 12, tolerance: float = 1e-9,
         rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (the margins, ``tokens``) with the columns ``factor`` and ``held``.

    Sum of tokens * factor equals the sum of tokens; each margin's shares of it
    meet its target up to ``tolerance`` where the cells allow it. A value with
    target share zero gets factor zero. Cells without tokens keep factor one.
    With a ``ceiling`` no factor passes it: cells that would are ``held`` there.
    """
    margins = list(targets)
    total = cells.agg(F.sum("tokens").cast("double")).scalar()
    goals = {m: staged(_targets(cells, m, rule).select(m, (F.col("share") * total).alias("goal")), f"target-{m}")
             for m, rule in targets.items()}
    plain = cells.select(*margins, "tokens")
    if 0 < cells.count() <= DRIVER_CELLS:  # measured
        small = plain.toPandas()
        wanted = {m: {r[0]: r[1] for r in g.collect()} for m, g in goals.items()}  # no more values than cells
        small["factor"], small["held"] = _rake_frame(small, wanted, ceiling, sweeps, tolerance, rounds)
        kinds = ", ".join(f"{m} string" for m in margins)
        out = cells.sparkSession.createDataFrame(small, f"{kinds}, tokens long, factor double, held boolean")
        return _capped(staged(out, "cells"), ceiling)
    now = staged(plain.withColumn("factor", F.lit(1.0)).withColumn("held", F.lit(False)).withColumn("moved", F.lit(0.0)), "cells")
    for again in range(rounds + 1):
        if again:
            above = ~F.col("held") & (F.col("factor") > ceiling)
            if now.where(above).isEmpty():
                break
            now = now.withColumn("above", above).withColumn("held", F.col("held") | F.col("above")).withColumn(
                "factor", F.when(F.col("above"), F.lit(float(ceiling))).otherwise(F.col("factor"))).drop("above")
        for _ in range(sweeps):
            now = staged(_sweep(now, goals).select(*margins, "tokens", "factor", "held", "moved"), "cells")
            if (now.agg(F.max("moved")).first()[0] or 0.0) <= tolerance:
                break
        if ceiling is None:
            break
    return _capped(now.drop("moved"), ceiling)


def _capped(cells: DataFrame, ceiling: float | None) -> DataFrame:
    if ceiling is None:
        return cells
    return (cells.withColumn("held", F.col("held") | (F.col("factor") > ceiling))
            .withColumn("factor", F.least("factor", F.lit(float(ceiling)))))


def margins(cells: DataFrame, fitted: DataFrame, targets: dict) -> DataFrame:
    """``margin, value, target, expected`` shares, to see which targets the data cannot reach."""
    out = None
    whole = fitted.agg(F.sum(F.col("tokens") * F.col("factor"))).scalar()
    for m, rule in targets.items():
        got = fitted.groupBy(m).agg(F.sum(F.col("tokens") * F.col("factor")).alias("got"))
        one = (_targets(cells, m, rule).join(got, m, "left")
               .select(F.lit(m).alias("margin"), F.col(m).alias("value"), F.col("share").alias("target"),
                       (F.coalesce("got", F.lit(0.0)) / whole).alias("expected")))
        out = one if out is None else out.unionByName(one)
    return out


def _sized(docs: DataFrame, tokens: Column | None, topic: Column | None, text: str, source: str, lang: str) -> DataFrame:
    own = form(text, F.col("_ipf_tokens") if tokens is None else None)
    return (docs.withColumn("_ipf_tokens", words(text) if tokens is None else tokens)
            .withColumn("_ipf_topic", F.coalesce(own if topic is None else topic, F.lit(NONE)))
            .withColumn("_ipf_source", F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(NONE)))
            .withColumn("_ipf_lang", F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(NONE))))


def mix(docs: DataFrame, targets: dict, *, rate: float, seed: int = 0, doc_id: str = "doc_id", text: str = "text",
        source: str = "source", lang: str = "lang", tokens: Column | None = None, topic: Column | None = None,
        keep_columns: bool = False, sweeps: int = 12, tolerance: float = 1e-9, rounds: int = ROUNDS) -> DataFrame:
    """Calibrate the mix of ``docs`` and sample it at an expected ``rate`` of the tokens.

    Returns ``doc_id, source, lang, topic, n_tokens, factor, probability,
    kept`` per row of ``docs``, or with ``keep_columns`` the sampled rows with
    the columns of ``docs``. ``probability`` is rate * factor; a cell that
    would need more than one is kept whole and the others make up for it. The
    draw of a row depends on seed and id; rows whose id is null or repeated
    draw each for itself, by their place in the table. A null margin is the
    value ``(none)``, a null text has no tokens, a text of any length counts
    whole; an empty table gives an empty one.
    """
    if rate <= 0:
        raise ValueError("rate must be positive")
    sized = _sized(docs, tokens, topic, text, source, lang)
    own = {m: f"_ipf_{m}" for m in MARGINS}
    slim = [F.col(c).alias(m) for m, c in own.items()]
    if not keep_columns:
        sized = staged(sized.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), "_ipf_tokens", *own.values()), "sizes")
    cells = staged(sized.select("_ipf_tokens", *slim).groupBy(*MARGINS)
                   .agg(F.sum("_ipf_tokens").alias("tokens")), "cells")
    fitted = rake(cells, {m: targets[m] for m in MARGINS}, ceiling=1.0 / rate, sweeps=sweeps, tolerance=tolerance, rounds=rounds)
    factor = fitted.select(*[F.col(m).alias(own[m]) for m in MARGINS], F.col("factor").alias("_ipf_factor"))
    keyed, draw = _draw_keys(sized, f"`{doc_id}`" if keep_columns else "doc_id")
    joined = (keyed.join(factor, list(own.values()))
              .withColumn("_ipf_p", F.least(F.lit(1.0), F.lit(float(rate)) * F.col("_ipf_factor"))))
    kept = uniform(draw, seed) < F.col("_ipf_p")
    if keep_columns:
        return joined.where(kept).select(*[F.col(f"`{c}`") for c in docs.columns])
    return joined.select("doc_id", *slim, F.col("_ipf_tokens").alias("n_tokens"), F.col("_ipf_factor").alias("factor"),
                         F.col("_ipf_p").alias("probability"), kept.alias("kept"))


def mix_sql(targets: dict, *, rate: float, seed: int, sweeps: int, rounds: int = ROUNDS) -> str:
    """The same mix in DuckDB SQL over ``documents``, the sweeps written out one by one.

    Ids of ``documents`` are there and differ, so a draw goes by the id alone."""
    top = repr(float(1.0 / rate))
    q = lambda v: "'" + str(v).replace("'", "''") + "'"
    parts = [f"""sized AS (SELECT doc_id, coalesce(text, '') AS body, coalesce(source, '{NONE}') AS source,
  coalesce(lang, '{NONE}') AS lang,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents)""",
             """d AS (SELECT *, CASE WHEN contains(body, ' | ') THEN 'table' WHEN n_tokens < 100 THEN 'note'
  WHEN n_tokens < 800 THEN 'article' ELSE 'long' END AS topic FROM sized)""",
             """c0 AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens, 1.0::DOUBLE AS factor,
  false AS held, true AS go FROM d GROUP BY ALL)""",
             "total AS (SELECT sum(tokens) AS total FROM c0)"]
    for m, rule in targets.items():
        if isinstance(rule, dict):
            listed = "CASE " + m + " " + " ".join(f"WHEN {q(v)} THEN {float(s)!r}::DOUBLE" for v, s in rule.items()) + " END"
            left = max(0.0, 1.0 - sum(rule.values()))
            parts += [f"p_{m} AS (SELECT {m}, sum(tokens) AS t, {listed} AS s FROM c0 GROUP BY {m} HAVING sum(tokens) > 0)",
                      f"r_{m} AS (SELECT {m}, coalesce(s, {left!r}::DOUBLE * t / sum(t) FILTER (s IS NULL) OVER ()) AS raw FROM p_{m})"]
        else:
            parts.append(f"r_{m} AS (SELECT {m}, pow(sum(tokens), {float(rule)!r}::DOUBLE) AS raw FROM c0 GROUP BY {m} "
                         "HAVING sum(tokens) > 0)")
        parts.append(f"g_{m} AS (SELECT {m}, raw / sum(raw) OVER () * total AS goal FROM r_{m}, total)")
    at = "c0"
    for again in range(rounds + 1):
        if again:
            parts.append(f"h{again} AS MATERIALIZED (SELECT source, lang, topic, tokens, least(factor, {top}) AS factor, "
                         f"held OR factor > {top} AS held, bool_or(NOT held AND factor > {top}) OVER () AS go FROM {at})")
            at = f"h{again}"
        for k in range(sweeps):
            for m in targets:
                name = f"c{again}_{k + 1}_{m}"
                parts.append(
                    f"{name} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, c.held, c.go, c.factor * CASE WHEN go AND NOT held "
                    f"AND free > 0 THEN coalesce(greatest(goal - fixed, 0) / free, 1.0) ELSE 1.0 END AS factor FROM {at} c JOIN "
                    f"(SELECT {m}, coalesce(sum(tokens * factor) FILTER (NOT held), 0) AS free, "
                    f"coalesce(sum(tokens * factor) FILTER (held), 0) AS fixed FROM {at} GROUP BY {m}) x USING ({m}) "
                    f"LEFT JOIN g_{m} USING ({m}))")
                at = name
    u = f"('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, {HASH_DIGITS}))::BIGINT / {float(16 ** HASH_DIGITS)!r}"
    return ("WITH " + ",\n".join(parts) + f"""
SELECT doc_id, source, lang, topic, n_tokens, round(least(factor, {top}), 6) AS factor,
  round(least(1.0, {float(rate)!r} * factor), 6) AS probability,
  {u} < least(1.0, {float(rate)!r} * factor) AS kept
FROM d JOIN {at} USING (source, lang, topic)""")
