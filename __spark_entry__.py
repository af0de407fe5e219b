"""

Every query reads the driver's tables at ``sf_dir`` (whole tables, whole
texts) and returns a DataFrame; ``oracle_sql()`` holds the same query in
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsift.files import listing, rename
from rowsift.functions import (
    NOTES_FIELD,
    VERDICT_FIELD,
    extract_json,
    normalize_term,
    notes,
    text_value,
    verdict,
    verdict_raw,
)
from rowsift.operators import (
    RunLog,
    build_match_requests,
    build_requests,
    distinct_values,
    evaluate_rules,
    explode_records,
    filter_any_term,
    filter_contains,
    filter_related,
    keep_columns,
    match_count,
    match_values,
    merge_verdicts,
    observe_count,
    parse_matches,
    parse_replies,
    records_to_table,
    render_records,
    score_requests,
    with_row_id,
)
from rowsift.plans import analyze
from rowsift.plans.reviewers import (
    PRICE_LIMIT,
    advising_reviewer,
    first_answers,
    first_scorer,
    length_scorer,
    price_reviewer,
    same_initial,
    second_answers,
    second_scorer,
)
from rowsift.session import shared_dir
from rowsift.sources import (
    add_table,
    append_json,
    assemble_document,
    list_columns,
    list_tables,
    read_json,
    read_many,
    read_table,
    write_json,
    write_results,
    write_table,
)

try:  # the training-data package and its pipeline are optional
    import corpus_pipeline as _corpus
    from rowsift.llm import queries as _llm
except ImportError:
    _corpus = _llm = None

SMOKE_DIR = "/root/testdata/sf0.001"
TABLES = ["benchmark", "conversations", "customer", "documents", "embeddings", "events",
          "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier"]

# Parameters of the registered queries (shared by Spark code and oracle SQL).
GUIDELINE_CONV = 0          # which assembled conversation serves as the guideline
M3_BATCH = 50
LINE_RULES = [              # M5 rules over lineitem
    (1, "l_quantity", "ge", "10", "small quantity"),
    (2, "l_discount", "le", "0.05", "discount above 5%"),
    (3, "l_returnflag", "eq", "N", "returned or flagged"),
]
ORDER_RULES = [             # P1 rules over orders
    (1, "o_totalprice", "ge", "50000", "order value under 50000"),
    (2, "o_orderstatus", "eq", "F", "order not finished"),
]
STREAM_RULES = [(1, "p_size", "ge", "10", "too small"), (2, "p_brand", "eq", "Brand#1", "other brand")]
RELATED = [("purchase", "Purchase", "the term itself"),
           ("purchase", "signup", "a signup precedes a purchase"),
           ("purchase", "click", "a click can lead to a purchase"),
           ("refund", "error", "unrelated term")]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _q(s: str) -> str:
    """A DuckDB string literal (newlines spelled as chr(10))."""
    parts = s.replace("'", "''").split("\n")
    return " || chr(10) || ".join(f"'{p}'" for p in parts)


# ---------------------------------------------------------------- sources

def q_s1_read_table(spark, sf):
    return read_table(spark, sf, "customer")


def q_s2_list_tables(spark, sf):
    return list_tables(spark, sf)


def q_s3_list_columns(spark, sf):
    return list_columns(read_table(spark, sf, "part"))


def q_s4_read_many(spark, sf):
    df = read_many(spark, f"{sf}/lineitem*.parquet")
    name = F.regexp_extract("source_file", r"(lineitem[^/]*\.parquet)", 1)  # of the full path
    return df.withColumn("source_file", name).groupBy("source_file").agg(F.count(F.lit(1)).alias("n_rows"),
                                         F.max("l_orderkey").alias("max_orderkey"))


def q_s4_read_many_files(spark, sf):
    """Three tables of equal columns read as one, each row with its file's folder."""
    base = shared_dir(spark, "s4")
    part = _t(spark, sf, "part")
    for k in range(3):
        write_table(part.where(F.col("p_partkey") % 3 == k), base, f"parts_{k}")
    df = read_many(spark, [f"{base}/parts_{k}" for k in range(3)])
    folder = F.regexp_extract("source_file", r"/(parts_[0-9])/[^/]*$", 1)
    return df.withColumn("source_file", folder).select("source_file", "p_partkey", "p_name")


def q_s5_assemble_document(spark, sf):
    conv = _t(spark, sf, "conversations")
    return assemble_document(conv, doc="conv_id", page_no="turn", text="text")


# ---------------------------------------------------------------- expressions

def q_e1_text_value(spark, sf):
    p = _t(spark, sf, "part")
    return p.select("p_partkey", text_value("p_size").alias("p_size_text"))


def q_e2_normalize_term(spark, sf):
    c = _t(spark, sf, "customer")
    padded = F.concat(F.lit("\t "), F.col("c_mktsegment"), F.lit(" \n"))
    return c.select("c_custkey", normalize_term(padded, lower=True).alias("term"))


def q_e3_keep_columns(spark, sf):
    p = filter_contains(_t(spark, sf, "part"), "p_name", "gear")
    return keep_columns(p, "p_partkey", "p_name", "p_size")


# ---------------------------------------------------------------- filters

def q_f1_filter_contains(spark, sf):
    return filter_contains(_t(spark, sf, "part"), "p_name", "WIDGET|bolt")


def q_f1_filter_contains_literal(spark, sf):
    return filter_contains(_t(spark, sf, "part"), "p_brand", "brand#1", literal=True)


def q_f2_filter_any_term(spark, sf):
    return filter_any_term(_t(spark, sf, "part"), "p_name", ["BOLT", "ring"])


def q_f1_filter_contains_dotted(spark, sf):
    part = _t(spark, sf, "part").withColumnRenamed("p_name", "Dx.name")
    return filter_contains(part, "Dx.name", "WIDGET|bolt").withColumnRenamed("Dx.name", "p_name")


LONG_TERMS = ["BOLT", "ring", "cog", "axle", "Valve", "spring", "washer", "gasket", "hinge", "lever"]
MANY_BRANDS = [f"brand#{i}" for i in range(2, 400, 3)]


def q_f2_filter_any_term_long_list(spark, sf):
    return filter_any_term(_t(spark, sf, "part"), "p_name", LONG_TERMS)


def q_f2_filter_any_term_many(spark, sf):
    """More terms than are tested inline: the keyed join, from a list."""
    return filter_any_term(_t(spark, sf, "part"), "p_brand", MANY_BRANDS)


def q_f2_filter_any_term_frame(spark, sf):
    docs, bench = _t(spark, sf, "documents"), _t(spark, sf, "benchmark").select(F.col("text").alias("value"))
    return filter_any_term(docs, "text", bench).select("doc_id", "lang", "n_chars")


def q_f2_filter_any_term_qgram(spark, sf):
    """Values of two words have no interior word: the join goes by grams."""
    docs = _t(spark, sf, "documents")
    starts = _t(spark, sf, "benchmark").select(F.regexp_substr("text", F.lit(r"^\S+ \S+")).alias("value"))
    return filter_any_term(docs, "text", starts, max_list_values=0).select("doc_id", "lang", "n_chars")


def q_f3_filter_related(spark, sf):
    return filter_related(_t(spark, sf, "part"), "p_name", "small", matches=["ring"])


def q_f3_filter_related_no_matches(spark, sf):
    return filter_related(_t(spark, sf, "part"), "p_name", "small", matches=[])


def _related_df(spark):
    return spark.createDataFrame(RELATED, "term string, value string, explanation string")


def q_f3_filter_related_frame(spark, sf):
    ev = _t(spark, sf, "events")
    values = distinct_values(ev, "event_type", order_by="event_id", limit=None)
    matches = match_values(values, "purchase", _related_df(spark))
    kept = filter_related(ev, "event_type", "purchase", matches=matches)
    return kept.select("event_id", "user_id", "event_type", "value")


def q_f4_distinct_values(spark, sf):
    return distinct_values(_t(spark, sf, "part"), "p_name", order_by="p_partkey", limit=20)


def q_f5_match_values_table(spark, sf):
    ev = _t(spark, sf, "events")
    values = distinct_values(ev, "event_type", order_by="event_id", limit=None)
    return match_values(values, "purchase", _related_df(spark))


def q_f5_match_values_stored(spark, sf):
    """A store of answers: half of the values asked before; the second matcher is only asked about the others."""
    store = shared_dir(spark, "f5-store")
    names = distinct_values(_t(spark, sf, "customer"), "c_name", order_by=None, limit=None)
    old = F.substring("value", -1, 1).cast("int") < 5
    match_values(names.where(old), "old", first_answers, store=store)
    return match_values(names, "old", second_answers, store=store)


def q_f5_match_values_callable(spark, sf):
    ev = _t(spark, sf, "events")
    values = distinct_values(ev, "event_type", order_by="event_id", limit=None)
    return match_values(values, "sale", same_initial)


def q_f6_with_row_id(spark, sf):
    o = filter_contains(_t(spark, sf, "orders"), "o_orderpriority", "urgent")
    return with_row_id(o, "o_orderkey").select(
        "row_id", "o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")


def q_f6_with_row_id_multi(spark, sf):
    """Many range partitions."""
    rows = _t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return with_row_id(rows, "o_orderkey", rows_per_part=500)


def q_f6_input_order(spark, sf):
    """No key: ids in the order of the file (``orders`` lies in the order of its key)."""
    return with_row_id(_t(spark, sf, "orders"), rows_per_part=700).select("row_id", "o_orderkey", "o_custkey")


def q_f6_ties(spark, sf):
    """A key of five values: ties keep the order of the file."""
    rows = _t(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return with_row_id(rows, "o_orderpriority", rows_per_part=700)


def q_f7_match_count(spark, sf):
    return match_count(filter_contains(_t(spark, sf, "part"), "p_name", "gear"))


# ---------------------------------------------------------------- requests & scoring

def q_m1_build_match_requests(spark, sf):
    values = distinct_values(_t(spark, sf, "part"), "p_name", order_by="p_partkey", limit=None)
    return build_match_requests(values, "gear", "p_name", batch=20)


def q_m2_render_records(spark, sf):
    return render_records(_t(spark, sf, "customer"), row_id="c_custkey")


def q_m2_render_records_dotted(spark, sf):
    c = _t(spark, sf, "customer").withColumnRenamed("c_name", "Dose (mg.)")
    return render_records(c.select("c_custkey", "`Dose (mg.)`"), row_id="c_custkey")


def _m3_requests(spark, sf):
    c = filter_contains(_t(spark, sf, "customer"), "c_mktsegment", "building")
    kept = with_row_id(c, "c_custkey")
    conv = _t(spark, sf, "conversations")
    guide = assemble_document(conv, doc="conv_id", page_no="turn", text="text") \
        .where(F.col("conv_id") == GUIDELINE_CONV)
    return build_requests(render_records(kept), guide, "building", "c_mktsegment", batch=M3_BATCH)


def q_m3_build_requests(spark, sf):
    return _m3_requests(spark, sf).select(
        "batch_id", "n_records", F.element_at("row_ids", 1).alias("first_row_id"), "prompt")


def q_m4_score_requests(spark, sf):
    return score_requests(_m3_requests(spark, sf), length_scorer).select("batch_id", "response", "error")


M3_BYTES = 8192


def q_m3_requests_by_size(spark, sf):
    """Records of a few bytes to over 100 kB, packed under a budget of bytes."""
    docs = with_row_id(_t(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    records = render_records(docs.select("row_id", F.col("text").alias("t")))
    out = build_requests(records, "", "t", "text", batch=20, max_bytes=M3_BYTES, whole=False)
    return out.select("batch_id", "n_records", F.element_at("row_ids", -1).alias("last_row_id"),
                      F.octet_length("body").cast("long").alias("n_bytes"), F.md5("body").alias("body_md5"))


def q_m4_score_requests_stored(spark, sf):
    """Replies by content: every other request was answered by an earlier run, with another scorer."""
    store = shared_dir(spark, "m4-store")
    requests = _m3_requests(spark, sf)
    score_requests(requests.where("batch_id % 2 = 0"), first_scorer, store=store, wave=3)
    return score_requests(requests, second_scorer, store=store, wave=3).select("batch_id", "response", "error")


def q_m5_evaluate_rules(spark, sf):
    li = _t(spark, sf, "lineitem")
    rules = spark.createDataFrame(LINE_RULES, "rule_id int, column string, op string, value string, note string")
    return evaluate_rules(li, rules).select("l_orderkey", "l_linenumber", "verdict", "notes")


MANY_RULES = 2000


def q_m5_many_rules(spark, sf):
    rules = [(i, "s_acctbal", "ge", str(5 * i - 1000), f"r{i}") for i in range(MANY_RULES)]
    return evaluate_rules(_t(spark, sf, "supplier"), rules).select("s_suppkey", "verdict", "notes")


# ---------------------------------------------------------------- replies

def _r1_reply(k):
    shape = k % 4
    return (F.when(shape == 0, F.format_string('Sure: [{"id":%d,"Meets Guidelines":" TRUE "}] done', k))
            .when(shape == 1, F.format_string('See [1]. [{"id":%d}]', k))
            .when(shape == 2, F.format_string("no json for %d", k))
            .otherwise(F.format_string('Result {"id":%d,"Meets Guidelines":"false"} end', k)))


def q_r1_extract_json(spark, sf):
    c = _t(spark, sf, "customer")
    return c.select("c_custkey", extract_json(_r1_reply(F.col("c_custkey"))).alias("json_text"))


def q_r2_parse_matches(spark, sf):
    p = _t(spark, sf, "part")
    k = F.col("p_partkey") % 3
    reply = (F.when(k == 0, F.format_string('x {"matches":["%s","%s"],"explanation":"%s"} y',
                                            "p_name", "p_brand", "p_type"))
             .when(k == 1, F.format_string('{"matches":"%s"}', "p_name"))
             .otherwise(F.lit("no json")))
    out = parse_matches(p.select("p_partkey", reply.alias("response")))
    return out.select("p_partkey", F.array_join("matches", "|").alias("matches_text"), "explanation")


def q_r3_explode_records(spark, sf):
    c = _t(spark, sf, "customer")
    items = F.transform(F.sequence(F.lit(1), F.col("c_custkey") % 3 + 1),
                        lambda i: F.format_string('{"id":%d,"part":%d}', F.col("c_custkey"), i))
    reply = F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    ex = explode_records(c.select(F.col("c_custkey").alias("batch_id"), reply.alias("response")))
    return ex.select("batch_id", F.col("pos").cast("long").alias("pos"),
                     F.try_variant_get("record", "$.id", "bigint").alias("record_id"),
                     F.try_variant_get("record", "$.part", "bigint").alias("part"))


def _r4_field(k):
    shape = k % 6
    return (F.when(shape == 0, F.lit('"Meets Guidelines":" TRUE ",'))
            .when(shape == 1, F.lit('"Meets Guidelines":"Partially",'))
            .when(shape == 2, F.lit('"Meets Guidelines":true,'))
            .when(shape == 3, F.lit('"Meets Guidelines":null,'))
            .when(shape == 4, F.lit('"Meets Guidelines":1,'))
            .otherwise(F.lit("")))


def q_r4_standardize_verdict(spark, sf):
    c = _t(spark, sf, "customer")
    reply = F.concat(F.lit("["), F.lit("{"), _r4_field(F.col("c_custkey")),
                     F.format_string('"id":%d,"Notes on Compliance":"segment %s"}', "c_custkey",
                                     "c_mktsegment"), F.lit("]"))
    ex = explode_records(c.select("c_custkey", reply.alias("response")), keep=("c_custkey",))
    return ex.select("c_custkey", verdict("record").alias("verdict"),
                     verdict_raw("record").alias("verdict_raw"), notes("record").alias("notes"))


def _r5_reply(k):
    shape = k % 7
    return (F.when(shape == 0, F.format_string('[{"id":%d,"Meets Guidelines":"True"}]', k))
            .when(shape == 1, F.lit(""))
            .when(shape == 2, F.format_string("nothing for %d", k))
            .when(shape == 3, F.format_string('{"id":%d}', k))
            .when(shape == 4, F.lit("[]"))
            .when(shape == 5, F.format_string('[{"id":%d}, "x"]', k))
            .otherwise(F.format_string('[{"id":%d} oops', k)))


def q_r5_quarantine(spark, sf):
    c = _t(spark, sf, "customer")
    tagged = parse_replies(c.select("c_custkey", _r5_reply(F.col("c_custkey")).alias("response")))
    return tagged.select("c_custkey", "reason")


def q_r6_records_to_table(spark, sf):
    c = _t(spark, sf, "customer")
    even = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))
    odd = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"),
                             F.col("c_acctbal").alias("balance")))
    rec = F.when(F.col("c_custkey") % 2 == 0, even).otherwise(odd)
    recs = c.select(F.parse_json(rec).alias("record"))
    return records_to_table(recs)


def q_r6_records_mixed_types(spark, sf):
    """A key of text and numbers, and numbers longer than a double holds."""
    c = _t(spark, sf, "customer")
    dose = F.when(F.col("c_custkey") % 2 == 0, F.lit('"N/A"')).otherwise((F.col("c_custkey") % 7).cast("string"))
    rec = F.format_string('{"id":%d,"dose":%s,"big":12345678901234%06d,"seen":{"a":[%d]}}',
                          F.col("c_custkey"), dose, F.col("c_custkey"), F.col("c_nationkey"))
    out = records_to_table(c.select(F.parse_json(rec).alias("record")))
    return out.withColumn("big", F.col("big").cast("string"))


def q_r6_case_keys(spark, sf):
    """Keys that differ only in case make a table that can be written and read."""
    c = _t(spark, sf, "customer")
    rec = F.when(F.col("c_custkey") % 2 == 0, F.format_string('{"id":%d,"Name":"%s"}', "c_custkey", "c_name")).otherwise(
        F.format_string('{"id":%d,"name":"%s","NAME":%d}', "c_custkey", "c_mktsegment", "c_nationkey"))
    src = shared_dir(spark, "r6")
    write_table(records_to_table(c.select(F.parse_json(rec).alias("record"))), src, "cases")
    return read_table(spark, src, "cases")


def q_r7_merge_verdicts(spark, sf):
    c = _t(spark, sf, "customer").withColumn("row_id", F.col("c_custkey"))
    judged = (c.where(F.col("c_acctbal") > 5000)
              .select("row_id", (F.col("c_nationkey") % 2 == 0).alias("verdict"),
                      F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("notes")))
    return merge_verdicts(c, judged).select("c_custkey", "c_name", "verdict", "notes")


# ---------------------------------------------------------------- sinks

def q_k1_write_json(spark, sf):
    df = filter_contains(_t(spark, sf, "part"), "p_name", "gear")
    path = write_json(df, shared_dir(spark, "k1") + "/gear.json")
    return read_json(spark, path, schema=df.schema)


def q_k2_append_json(spark, sf):
    part = _t(spark, sf, "part")
    path = shared_dir(spark, "k2") + "/parts.json"
    write_json(filter_contains(part, "p_name", "gear").select("p_partkey", "p_name"), path)
    append_json(filter_contains(part, "p_name", "bolt").select("p_partkey", "p_name", "p_size"), path)
    return read_json(spark, path, schema="p_partkey long, p_name string, p_size int")


def q_k2_append_file(spark, sf):
    """The target is one single file of JSON lines."""
    base = shared_dir(spark, "k2f")
    part = _t(spark, sf, "part").select("p_partkey", "p_name")
    part.where("p_partkey % 2 = 0").coalesce(1).write.json(f"{base}/made")
    name = next(n for n, _ in listing(spark, f"{base}/made") if n.endswith(".json"))
    rename(spark, f"{base}/made/{name}", f"{base}/parts.json")
    append_json(part.where("p_partkey % 2 = 1").withColumn("p_odd", F.lit(True)), f"{base}/parts.json")
    return read_json(spark, f"{base}/parts.json")


def q_k2_append_types(spark, sf):
    """Four adds of different columns and types, one made twice; read by the types of the ledger."""
    path = shared_dir(spark, "k2t") + "/items.json"
    c = _t(spark, sf, "customer")
    adds = [c.select("c_custkey", F.col("c_nationkey").alias("x"), F.lit(None).cast("string").alias("later")),
            c.select("c_custkey", F.col("c_acctbal").alias("x")),
            c.select("c_custkey", F.struct(F.col("c_nationkey").alias("n")).alias("s"), F.lit(True).alias("later")),
            c.select("c_custkey", F.struct(F.col("c_name").alias("n"), F.array("c_nationkey").alias("list")).alias("s"))]
    for k, rows in enumerate(adds):
        for _ in range(2 if k == 1 else 1):
            append_json(rows, path, add_id=f"add-{k}")
    out = read_json(spark, path)
    return out.select("c_custkey", "later", F.col("s.list").getItem(0).alias("s_first"), F.col("s.n").alias("s_n"), "x")


def q_k3_write_table(spark, sf):
    df = filter_related(_t(spark, sf, "part"), "p_name", "small", matches=["ring"])
    src = shared_dir(spark, "k3")
    path = write_table(df, src, "related_parts")
    return spark.read.parquet(path)


def q_k3_csv_round_trip(spark, sf):
    df = filter_contains(_t(spark, sf, "part"), "p_name", "gear").select("p_partkey", "p_name", "p_size", "p_retailprice")
    src = shared_dir(spark, "k3csv")
    write_table(df, src, "gears", format="csv")
    return read_table(spark, src, "gears", format="csv", schema=df.schema)


def q_k4_add_table(spark, sf):
    df = filter_contains(_t(spark, sf, "part"), "p_name", "widget")
    src = shared_dir(spark, "k4")
    used = [add_table(df, src, "widgets") for _ in range(3)]
    return spark.read.parquet(f"{src}/{used[-1]}").withColumn("table_name", F.lit(used[-1]))


def q_k5_write_results(spark, sf):
    df = filter_contains(_t(spark, sf, "customer"), "c_mktsegment", "machinery")
    out = write_results(df, shared_dir(spark, "k5"), "customer.parquet", "customer",
                        "c_mktsegment", option="new_file")
    return spark.read.parquet(out["table_path"]).withColumn("table_name", F.lit(out["table_name"]))


def q_k5_write_results_json(spark, sf):
    """The JSON half of both outputs, read back."""
    df = filter_contains(_t(spark, sf, "customer"), "c_mktsegment", "machinery")
    out = write_results(df, shared_dir(spark, "k5j"), "customer.parquet", "customer",
                        "c_mktsegment", option="same_file")
    return read_json(spark, out["json_path"], schema=df.schema)


def q_k6_run_log(spark, sf):
    log = RunLog()
    part = _t(spark, sf, "part")
    kept, obs = observe_count(filter_contains(part, "p_name", "gear"))
    kept.write.format("noop").mode("overwrite").save()
    n = obs.get["rows"]
    log.add("filter", f"Found {n} records where p_name contains 'gear'", n)
    return log.to_df(spark).drop("ts")


# ---------------------------------------------------------------- end to end

def _p1_select(df):
    return df.select("row_id", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                     "o_orderpriority", VERDICT_FIELD, NOTES_FIELD)


def q_p1_analyze_rules(spark, sf):
    review = analyze(spark, sf, "orders", "o_orderpriority", "urgent", order_by="o_orderkey",
                     scorer=ORDER_RULES, out_dir=shared_dir(spark, "p1"))
    return _p1_select(review.result)


def q_p1_analyze_callable(spark, sf):
    conv = _t(spark, sf, "conversations")
    review = analyze(spark, sf, "orders", "o_orderpriority", "urgent", order_by="o_orderkey",
                     scorer=price_reviewer, out_dir=shared_dir(spark, "p1c"),
                     pages=conv, guideline_doc=GUIDELINE_CONV, doc_col="conv_id",
                     page_col="turn", text_col="text")
    return _p1_select(review.result)


def q_p1_analyze_extra_fields(spark, sf):
    """A source with its own ``notes`` and ``row_id``; a scorer that adds a field."""
    src = shared_dir(spark, "p1x")
    orders = _t(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority",
                                            F.concat(F.lit("note "), "o_orderkey").alias("notes"),
                                            (F.col("o_custkey") + 1000).alias("row_id"))
    write_table(orders, src, "orders")
    review = analyze(spark, src, "orders", "o_orderpriority", "urgent", order_by="o_orderkey",
                     scorer=advising_reviewer, out_dir=src, pages=_t(spark, sf, "conversations"),
                     guideline_doc=GUIDELINE_CONV, doc_col="conv_id", page_col="turn", text_col="text")
    return review.result.select("row_id_1", "o_orderkey", "notes", "row_id", VERDICT_FIELD, NOTES_FIELD, "Recommendation")


def q_p1_analyze_run(spark, sf):
    """A run with an id, taken up again after it was done: the second finds every step."""
    base, conv = shared_dir(spark, "p1r"), _t(spark, sf, "conversations")
    for _ in range(2):
        review = analyze(spark, sf, "orders", "o_orderpriority", "urgent", order_by=None, scorer=price_reviewer,
                         out_dir=f"{base}/out", pages=conv, guideline_doc=GUIDELINE_CONV, doc_col="conv_id",
                         page_col="turn", text_col="text", run_id="orders", run_folder=f"{base}/runs", max_bytes=4096)
    return _p1_select(review.result)


def q_p1_stream_append(spark, sf):
    """The streaming review into a JSON set and a table; the stream is started twice from the beginning,
    and the second time nothing is added. The rows of both targets."""
    from rowsift.streaming import review_stream_append
    base = shared_dir(spark, "stream-append")
    for k in range(2):
        q = review_stream_append(spark, sf, "p_name", "widget", STREAM_RULES, "parts", f"{base}/parts.json", base, "parts",
                                 log_path=f"{base}/log", checkpoint=f"{base}/progress-{k}", file_glob="part.parquet")
        q.awaitTermination()
    cols = ["p_partkey", "p_name", "p_size", "verdict", "notes"]
    added = read_json(spark, f"{base}/parts.json").select(*cols).withColumn("target", F.lit("json"))
    rows = spark.read.parquet(f"{base}/parts").select(*cols).withColumn("target", F.lit("table"))
    log = spark.read.parquet(f"{base}/log").select(F.lit(None).cast("long").alias("p_partkey"), F.col("step").alias("p_name"),
                                                   F.lit(None).cast("int").alias("p_size"), F.lit(None).cast("boolean").alias("verdict"),
                                                   "message", F.lit("log"))
    return added.withColumn("p_size", F.col("p_size").cast("int")).union(rows).union(log)


def q_p1_review_stream(spark, sf):
    """P1's stateless part (F1 + M5) as a Structured Streaming query over the
    part table's file, run to completion with an available-now trigger."""
    from rowsift.streaming import review_stream
    base = shared_dir(spark, "stream")
    q = review_stream(spark, sf, "p_name", "widget", STREAM_RULES, sink=f"{base}/out",
                      checkpoint=f"{base}/progress", file_glob="part.parquet")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("p_partkey", "p_name", "p_size", "verdict", "notes")


# ---------------------------------------------------------------- contract

def entry(spark: SparkSession) -> DataFrame:
    """Flagship: parts whose name relates to 'widget', numbered, rules-judged."""
    part = _t(spark, SMOKE_DIR, "part")
    kept = with_row_id(filter_related(part, "p_name", "widget", matches=["gizmo"]), "p_partkey")
    rules = [(1, "p_size", "ge", "10", "too small"), (2, "p_brand", "eq", "Brand#1", "other brand")]
    return evaluate_rules(kept, rules).select("row_id", "p_partkey", "p_name", "p_size",
                                              "p_brand", "verdict", "notes")


def own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries of the review library itself; each has an oracle."""
    return {name[2:]: fn for name, fn in globals().items() if name.startswith("q_") and callable(fn)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    more = {**_llm.QUERIES, "pipeline": _corpus.run} if _llm else {}
    return {**own_queries(), **more}


_PART_COLS = "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice"


def _oracle_m3_head() -> str:
    from rowsift.operators.requests import REVIEW_HEAD, REVIEW_MID
    return REVIEW_HEAD, REVIEW_MID.format(column="c_mktsegment", term="building")


def oracle_sql() -> dict[str, str]:
    more = dict(_llm.ORACLE_SQL) if _llm else {}
    if _corpus and _corpus.ORACLE_SQL:
        more["pipeline"] = _corpus.ORACLE_SQL
    return {**_own_oracle_sql(), **more}


def _own_oracle_sql() -> dict[str, str]:
    from rowsift.operators.requests import BLOCK_ROWS, MATCH_HEAD, REVIEW_TAIL
    rev_head, rev_mid = _oracle_m3_head()
    m3 = f"""
        WITH kept AS (
            SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS row_id
            FROM customer WHERE regexp_matches(c_mktsegment, 'building', 'i')),
        rec AS (
            SELECT row_id, to_json({{'c_custkey': c_custkey, 'c_name': c_name,
                'c_nationkey': c_nationkey, 'c_acctbal': c_acctbal,
                'c_mktsegment': c_mktsegment, 'row_id': row_id}}) AS record FROM kept),
        guide AS (
            SELECT string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS g
            FROM conversations WHERE conv_id = {GUIDELINE_CONV}),
        req AS (
            SELECT row_id // {M3_BATCH} AS batch_id, count(*) AS n_records,
                   min(row_id) AS first_row_id,
                   string_agg(record, chr(10) ORDER BY row_id) AS recs
            FROM rec GROUP BY 1)
        SELECT batch_id, n_records, first_row_id,
               {_q(rev_head)} || g || {_q(rev_mid)} || recs || {_q(REVIEW_TAIL)} AS prompt
        FROM req, guide"""
    r1_reply = """CASE c_custkey % 4
            WHEN 0 THEN 'Sure: [{"id":' || c_custkey || ',"Meets Guidelines":" TRUE "}] done'
            WHEN 1 THEN 'See [1]. [{"id":' || c_custkey || '}]'
            WHEN 2 THEN 'no json for ' || c_custkey
            ELSE 'Result {"id":' || c_custkey || ',"Meets Guidelines":"false"} end' END"""
    r5_reply = """CASE c_custkey % 7
            WHEN 0 THEN '[{"id":' || c_custkey || ',"Meets Guidelines":"True"}]'
            WHEN 1 THEN ''
            WHEN 2 THEN 'nothing for ' || c_custkey
            WHEN 3 THEN '{"id":' || c_custkey || '}'
            WHEN 4 THEN '[]'
            WHEN 5 THEN '[{"id":' || c_custkey || '}, "x"]'
            ELSE '[{"id":' || c_custkey || '} oops' END"""
    r4_field = """CASE c_custkey % 6
            WHEN 0 THEN '"Meets Guidelines":" TRUE ",'
            WHEN 1 THEN '"Meets Guidelines":"Partially",'
            WHEN 2 THEN '"Meets Guidelines":true,'
            WHEN 3 THEN '"Meets Guidelines":null,'
            WHEN 4 THEN '"Meets Guidelines":1,'
            ELSE '' END"""
    p1_rules_verdict = "(coalesce(o_totalprice >= 50000, false) OR coalesce(o_orderstatus = 'F', false))"
    p1_rules_notes = ("concat_ws('; ', CASE WHEN NOT coalesce(o_totalprice >= 50000, false) "
                      "THEN 'order value under 50000' END, CASE WHEN NOT coalesce(o_orderstatus = 'F', false) "
                      "THEN 'order not finished' END)")
    stream = """SELECT p_partkey, p_name, p_size,
            (coalesce(p_size >= 10, false) OR coalesce(p_brand = 'Brand#1', false)) AS verdict,
            concat_ws('; ', CASE WHEN NOT coalesce(p_size >= 10, false) THEN 'too small' END,
                            CASE WHEN NOT coalesce(p_brand = 'Brand#1', false) THEN 'other brand' END) AS notes
            FROM part WHERE regexp_matches(p_name, 'widget', 'i')"""
    p1_kept = """SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id
                 FROM orders WHERE regexp_matches(o_orderpriority, 'urgent', 'i')"""
    return {
        "s1_read_table": "SELECT * FROM customer",
        "s2_list_tables": "SELECT table_name FROM (VALUES "
                          + ", ".join(f"('{t}')" for t in TABLES) + ") AS v(table_name)",
        "s3_list_columns": """SELECT * FROM (VALUES (0, 'p_partkey', 'bigint'), (1, 'p_name', 'string'),
            (2, 'p_brand', 'string'), (3, 'p_type', 'string'), (4, 'p_size', 'int'),
            (5, 'p_retailprice', 'double')) AS v(ordinal, name, type)""",
        "s4_read_many": """SELECT 'lineitem.parquet' AS source_file, count(*) AS n_rows,
            max(l_orderkey) AS max_orderkey FROM lineitem""",
        "s4_read_many_files": "SELECT 'parts_' || p_partkey % 3 AS source_file, p_partkey, p_name FROM part",
        "s5_assemble_document": """SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text
            FROM conversations GROUP BY conv_id""",
        "e1_text_value": "SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size_text FROM part",
        "e2_normalize_term": r"""SELECT c_custkey,
            lower(regexp_replace(chr(9) || ' ' || c_mktsegment || ' ' || chr(10), '^\s+|\s+$', '', 'g')) AS term
            FROM customer""",
        "e3_keep_columns": """SELECT p_partkey, p_name, p_size FROM part
            WHERE regexp_matches(p_name, 'gear', 'i')""",
        "f1_filter_contains": f"SELECT {_PART_COLS} FROM part WHERE regexp_matches(p_name, 'WIDGET|bolt', 'i')",
        "f1_filter_contains_literal": f"SELECT {_PART_COLS} FROM part WHERE contains(lower(p_brand), 'brand#1')",
        "f1_filter_contains_dotted": f"SELECT {_PART_COLS} FROM part WHERE regexp_matches(p_name, 'WIDGET|bolt', 'i')",
        "f2_filter_any_term_long_list": f"""SELECT {_PART_COLS} FROM part
            WHERE len(list_filter({[t.lower() for t in LONG_TERMS]}, lambda t: contains(lower(p_name), t))) > 0""",
        "f2_filter_any_term_many": f"""SELECT {_PART_COLS} FROM part
            WHERE len(list_filter({MANY_BRANDS}, lambda t: contains(lower(p_brand), t))) > 0""",
        "f2_filter_any_term": f"""SELECT {_PART_COLS} FROM part
            WHERE contains(lower(p_name), 'bolt') OR contains(lower(p_name), 'ring')""",
        "f2_filter_any_term_frame": """SELECT doc_id, lang, n_chars FROM documents d
            WHERE EXISTS (SELECT 1 FROM benchmark b WHERE contains(lower(d.text), lower(b.text)))""",
        "f2_filter_any_term_qgram": r"""SELECT doc_id, lang, n_chars FROM documents d
            WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT lower(regexp_extract(text, '^\S+ \S+')) AS v FROM benchmark
                                         WHERE regexp_matches(text, '^\S+ \S+')) b WHERE contains(lower(d.text), b.v))""",
        "f3_filter_related": f"""SELECT {_PART_COLS} FROM part
            WHERE regexp_matches(p_name, 'small', 'i') OR contains(lower(p_name), 'ring')""",
        "f3_filter_related_no_matches": f"SELECT {_PART_COLS} FROM part WHERE regexp_matches(p_name, 'small', 'i')",
        "f3_filter_related_frame": """SELECT event_id, user_id, event_type, value FROM events e
            WHERE regexp_matches(event_type, 'purchase', 'i')
               OR EXISTS (SELECT 1 FROM (VALUES ('Purchase'), ('signup'), ('click')) AS m(v)
                          WHERE contains(lower(e.event_type), lower(m.v)))""",
        "f4_distinct_values": """SELECT p_name AS value, min(p_partkey) AS first_seen FROM part
            GROUP BY p_name ORDER BY first_seen LIMIT 20""",
        "f5_match_values_table": """SELECT 'purchase' AS term, d.value, r.explanation
            FROM (SELECT DISTINCT event_type AS value FROM events) d
            JOIN (VALUES ('purchase', 'Purchase', 'the term itself'),
                         ('purchase', 'signup', 'a signup precedes a purchase'),
                         ('purchase', 'click', 'a click can lead to a purchase'),
                         ('refund', 'error', 'unrelated term')) AS r(term, value, explanation)
              ON lower(d.value) = lower(r.value) AND lower(r.term) = 'purchase'""",
        "f5_match_values_stored": """SELECT DISTINCT 'old' AS term, c_name AS value,
            CASE WHEN right(c_name, 1)::INT < 5 THEN 'first' ELSE 'second' END AS explanation FROM customer
            WHERE right(c_name, 1)::INT % 2 = 0""",
        "f5_match_values_callable": """SELECT DISTINCT 'sale' AS term, event_type AS value,
            'same first letter' AS explanation FROM events WHERE lower(left(event_type, 1)) = 's'""",
        "f6_with_row_id": """SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id,
            o_orderkey, o_custkey, o_orderpriority, o_totalprice
            FROM orders WHERE regexp_matches(o_orderpriority, 'urgent', 'i')""",
        "f6_with_row_id_multi": """SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id,
            o_orderkey, o_custkey FROM orders""",
        "f6_input_order": """SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, o_orderkey, o_custkey FROM orders""",
        "f6_ties": """SELECT row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS row_id, o_orderkey, o_orderpriority
            FROM orders""",
        "f7_match_count": "SELECT count(*) AS rows_kept FROM part WHERE regexp_matches(p_name, 'gear', 'i')",
        "m1_build_match_requests": f"""
            WITH v AS (SELECT p_name AS value, min(p_partkey) AS first_seen FROM part GROUP BY 1),
            r AS (SELECT value, row_number() OVER (ORDER BY first_seen) - 1 AS rid FROM v)
            SELECT rid // 20 AS batch_id, count(*) AS n_values,
                   {_q(MATCH_HEAD.format(column='p_name', term='gear'))}
                   || string_agg(value, chr(10) ORDER BY rid) AS prompt
            FROM r GROUP BY 1""",
        "m2_render_records": """SELECT c_custkey, to_json({'c_custkey': c_custkey, 'c_name': c_name,
            'c_nationkey': c_nationkey, 'c_acctbal': c_acctbal, 'c_mktsegment': c_mktsegment}) AS record
            FROM customer""",
        "m2_render_records_dotted": """SELECT c_custkey,
            to_json({'c_custkey': c_custkey, 'Dose (mg.)': c_name}) AS record FROM customer""",
        "m5_many_rules": f"""SELECT s_suppkey, coalesce(s_acctbal >= -1000, false) AS verdict,
            coalesce((SELECT string_agg('r' || i, '; ' ORDER BY i) FROM range({MANY_RULES}) t(i)
                      WHERE NOT coalesce(s_acctbal >= 5 * i - 1000, false)), '') AS notes FROM supplier""",
        "m3_build_requests": m3,
        "m3_requests_by_size": f"""
            WITH k AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, text AS t FROM documents),
            r AS (SELECT row_id, to_json({{'row_id': row_id, 't': t}})::VARCHAR AS record FROM k),
            z AS (SELECT *, strlen(record) + 1 AS size, row_id // {BLOCK_ROWS} AS block, strlen(record) + 1 > {M3_BYTES // 2} AS big FROM r),
            p AS (SELECT *, sum(CASE WHEN big THEN 0 ELSE size END) OVER (PARTITION BY block ORDER BY row_id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS place FROM z),
            c AS (SELECT *, CASE WHEN big THEN -1 ELSE place // {M3_BYTES // 2} END AS cell,
                      CASE WHEN big THEN row_id ELSE -1 END AS alone FROM p),
            t AS (SELECT *, (row_number() OVER (PARTITION BY block, cell, alone ORDER BY row_id) - 1) // 20 AS turn FROM c)
            SELECT min(row_id) AS batch_id, count(*) AS n_records, max(row_id) AS last_row_id,
                   (sum(size) - 1)::BIGINT AS n_bytes, md5(string_agg(record, chr(10) ORDER BY row_id)) AS body_md5
            FROM t GROUP BY block, cell, alone, turn""",
        "m4_score_requests_stored": f"""SELECT batch_id, CASE WHEN batch_id % 2 = 0 THEN 'first:' ELSE 'second:' END || length(prompt)
            AS response, NULL::VARCHAR AS error FROM ({m3})""",
        "m4_score_requests": f"""SELECT batch_id,
            CASE WHEN length(prompt) % 2 = 0 THEN 'ok:' || length(prompt) END AS response,
            CASE WHEN length(prompt) % 2 = 1 THEN 'ValueError: odd length' END AS error
            FROM ({m3})""",
        "m5_evaluate_rules": """SELECT l_orderkey, l_linenumber,
            (coalesce(l_quantity >= 10, false) OR coalesce(l_discount <= 0.05, false)
             OR coalesce(l_returnflag = 'N', false)) AS verdict,
            concat_ws('; ',
              CASE WHEN NOT coalesce(l_quantity >= 10, false) THEN 'small quantity' END,
              CASE WHEN NOT coalesce(l_discount <= 0.05, false) THEN 'discount above 5%' END,
              CASE WHEN NOT coalesce(l_returnflag = 'N', false) THEN 'returned or flagged' END) AS notes
            FROM lineitem""",
        "r1_extract_json": rf"""WITH r AS (SELECT c_custkey, {r1_reply} AS reply FROM customer),
            s AS (SELECT c_custkey, regexp_extract(reply, '(?s)\[.*\]') AS arr,
                         regexp_extract(reply, '(?s)\{{.*\}}') AS obj FROM r)
            SELECT c_custkey,
              CASE WHEN arr <> '' THEN (CASE WHEN json_valid(arr) THEN arr END)
                   WHEN obj <> '' THEN (CASE WHEN json_valid(obj) THEN obj END) END AS json_text
            FROM s""",
        "r2_parse_matches": r"""WITH r AS (SELECT p_partkey, CASE p_partkey % 3
                WHEN 0 THEN 'x {"matches":["' || p_name || '","' || p_brand || '"],"explanation":"' || p_type || '"} y'
                WHEN 1 THEN '{"matches":"' || p_name || '"}'
                ELSE 'no json' END AS reply FROM part),
            o AS (SELECT p_partkey, regexp_extract(reply, '(?s)\{.*\}') AS obj FROM r),
            v AS (SELECT p_partkey, CASE WHEN obj <> '' AND json_valid(obj) THEN obj END AS js FROM o)
            SELECT p_partkey,
              CASE WHEN js IS NOT NULL AND json_type(coalesce(js, '{}'), '$.matches') = 'ARRAY'
                   THEN array_to_string(CAST(json_extract(coalesce(js, '{}'), '$.matches') AS VARCHAR[]), '|')
                   END AS matches_text,
              CASE WHEN js IS NOT NULL AND json_type(coalesce(js, '{}'), '$.matches') = 'ARRAY'
                   THEN json_extract_string(coalesce(js, '{}'), '$.explanation') END AS explanation
            FROM v""",
        "r3_explode_records": """SELECT c_custkey AS batch_id, CAST(i - 1 AS BIGINT) AS pos,
            c_custkey AS record_id, CAST(i AS BIGINT) AS part
            FROM customer, range(1, c_custkey % 3 + 2) AS t(i)""",
        "r4_standardize_verdict": rf"""WITH r AS (SELECT c_custkey, c_mktsegment, {r4_field} AS f FROM customer),
            j AS (SELECT c_custkey, c_mktsegment, ('{{' || f || '"id":' || c_custkey ||
                   ',"Notes on Compliance":"segment ' || c_mktsegment || '"}}') AS rec FROM r)
            SELECT c_custkey,
              CASE json_type(rec, '$."Meets Guidelines"')
                WHEN 'VARCHAR' THEN lower(regexp_replace(json_extract_string(rec, '$."Meets Guidelines"'),
                                                         '^\s+|\s+$', '', 'g')) = 'true'
                WHEN 'BOOLEAN' THEN CAST(json_extract_string(rec, '$."Meets Guidelines"') AS BOOLEAN)
                WHEN 'NULL' THEN NULL
                ELSE (CASE WHEN json_type(rec, '$."Meets Guidelines"') IS NULL THEN false END) END AS verdict,
              CASE WHEN json_type(rec, '$."Meets Guidelines"') NOT IN ('VARCHAR', 'BOOLEAN', 'NULL')
                   THEN CAST(json_extract(rec, '$."Meets Guidelines"') AS VARCHAR) END AS verdict_raw,
              json_extract_string(rec, '$."Notes on Compliance"') AS notes
            FROM j""",
        "r5_quarantine": rf"""WITH r AS (SELECT c_custkey, {r5_reply} AS reply FROM customer),
            s AS (SELECT c_custkey, reply, regexp_extract(reply, '(?s)\[.*\]') AS arr,
                         regexp_extract(reply, '(?s)\{{.*\}}') AS obj FROM r),
            j AS (SELECT c_custkey, reply,
                    CASE WHEN arr <> '' THEN (CASE WHEN json_valid(arr) THEN arr END)
                         WHEN obj <> '' THEN (CASE WHEN json_valid(obj) THEN obj END) END AS js FROM s)
            SELECT c_custkey,
              CASE WHEN reply IS NULL OR trim(reply) = '' THEN 'empty reply'
                   WHEN js IS NULL THEN 'no valid json'
                   WHEN json_type(js) <> 'ARRAY' THEN 'not a list'
                   WHEN json_array_length(js) = 0 THEN 'empty list'
                   WHEN len(list_filter(CAST(json_extract(js, '$[*]') AS JSON[]),
                                        lambda e: json_type(e) <> 'OBJECT')) > 0 THEN 'non-object element'
              END AS reason
            FROM j""",
        "r6_records_to_table": """SELECT CASE WHEN c_custkey % 2 = 1 THEN c_acctbal END AS balance,
            c_custkey AS id,
            CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name,
            CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END AS segment
            FROM customer""",
        "r6_records_mixed_types": """SELECT '12345678901234' || lpad(c_custkey::VARCHAR, 6, '0') AS big,
            CASE WHEN c_custkey % 2 = 0 THEN 'N/A' ELSE (c_custkey % 7)::VARCHAR END AS dose, c_custkey AS id,
            '{"a":[' || c_nationkey || ']}' AS seen FROM customer""",
        "r6_case_keys": """SELECT CASE WHEN c_custkey % 2 = 1 THEN c_nationkey::BIGINT END AS "NAME",
            CASE WHEN c_custkey % 2 = 0 THEN c_name END AS "Name_1", c_custkey AS id,
            CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END AS name_2 FROM customer""",
        "r7_merge_verdicts": """SELECT c_custkey, c_name,
            CASE WHEN c_acctbal > 5000 THEN c_nationkey % 2 = 0 ELSE false END AS verdict,
            CASE WHEN c_acctbal > 5000 THEN 'nation ' || c_nationkey END AS notes
            FROM customer""",
        "k1_write_json": f"SELECT {_PART_COLS} FROM part WHERE regexp_matches(p_name, 'gear', 'i')",
        "k2_append_json": """SELECT p_partkey, p_name, CAST(NULL AS INTEGER) AS p_size FROM part
                WHERE regexp_matches(p_name, 'gear', 'i')
            UNION ALL
            SELECT p_partkey, p_name, p_size FROM part WHERE regexp_matches(p_name, 'bolt', 'i')""",
        "k2_append_file": """SELECT p_name, CASE WHEN p_partkey % 2 = 1 THEN true END AS p_odd, p_partkey FROM part""",
        "k2_append_types": """SELECT c_custkey, NULL::BOOLEAN AS later, NULL::BIGINT AS s_first, NULL::VARCHAR AS s_n,
                c_nationkey::DOUBLE AS x FROM customer
            UNION ALL SELECT c_custkey, NULL, NULL, NULL, c_acctbal FROM customer
            UNION ALL SELECT c_custkey, true, NULL, c_nationkey::VARCHAR, NULL FROM customer
            UNION ALL SELECT c_custkey, NULL, c_nationkey, c_name, NULL FROM customer""",
        "k3_write_table": f"""SELECT {_PART_COLS} FROM part
            WHERE regexp_matches(p_name, 'small', 'i') OR contains(lower(p_name), 'ring')""",
        "k3_csv_round_trip": """SELECT p_partkey, p_name, p_size, p_retailprice FROM part
            WHERE regexp_matches(p_name, 'gear', 'i')""",
        "k5_write_results_json": "SELECT * FROM customer WHERE regexp_matches(c_mktsegment, 'machinery', 'i')",
        "k4_add_table": f"""SELECT {_PART_COLS}, 'widgets_2' AS table_name FROM part
            WHERE regexp_matches(p_name, 'widget', 'i')""",
        "k5_write_results": """SELECT *, 'customer_by_c_mktsegment_Analyzed' AS table_name FROM customer
            WHERE regexp_matches(c_mktsegment, 'machinery', 'i')""",
        "k6_run_log": """SELECT 'filter' AS step,
            'Found ' || count(*) || ' records where p_name contains ''gear''' AS message,
            count(*) AS rows FROM part WHERE regexp_matches(p_name, 'gear', 'i')""",
        "p1_analyze_rules": f"""SELECT row_id, o_orderkey, o_custkey, o_orderstatus, o_totalprice,
            o_orderpriority, {p1_rules_verdict} AS "Meets Guidelines",
            {p1_rules_notes} AS "Notes on Compliance" FROM ({p1_kept})""",
        "p1_analyze_extra_fields": f"""SELECT row_id AS row_id_1, o_orderkey, 'note ' || o_orderkey AS notes,
            o_custkey + 1000 AS row_id, o_totalprice > {PRICE_LIMIT} AS "Meets Guidelines",
            CASE WHEN o_totalprice > {PRICE_LIMIT} THEN 'price above limit'
                 ELSE 'price at or below limit' END AS "Notes on Compliance",
            CASE WHEN o_totalprice > {PRICE_LIMIT} THEN 'accept' END AS "Recommendation" FROM ({p1_kept})""",
        "p1_analyze_run": f"""SELECT row_id, o_orderkey, o_custkey, o_orderstatus, o_totalprice,
            o_orderpriority, o_totalprice > {PRICE_LIMIT} AS "Meets Guidelines",
            CASE WHEN o_totalprice > {PRICE_LIMIT} THEN 'price above limit'
                 ELSE 'price at or below limit' END AS "Notes on Compliance"
            FROM ({p1_kept})""",
        "p1_stream_append": f"""WITH r AS ({stream})
            SELECT *, 'json' AS target FROM r UNION ALL SELECT *, 'table' FROM r
            UNION ALL SELECT NULL, 'batch 0', NULL, NULL, count(*) || ' rows of parts added', 'log' FROM r""",
        "p1_review_stream": stream,
        "p1_analyze_callable": f"""SELECT row_id, o_orderkey, o_custkey, o_orderstatus, o_totalprice,
            o_orderpriority, o_totalprice > {PRICE_LIMIT} AS "Meets Guidelines",
            CASE WHEN o_totalprice > {PRICE_LIMIT} THEN 'price above limit'
                 ELSE 'price at or below limit' END AS "Notes on Compliance"
            FROM ({p1_kept})""",
    }
