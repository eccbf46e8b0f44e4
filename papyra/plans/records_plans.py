"""Queries over records, texts, sheets and tables in the folder of a store."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyra.functions import records as rec
from papyra.functions import scoring
from papyra.functions import text as tx
from papyra.operators import relational, sensitive, tables
from papyra.plans.registry import query, stored, table

# --- joins -------------------------------------------------------------------


@query("SELECT d.doc_id, d.lang, CASE WHEN l.quality = 1 THEN 'good' END AS quality FROM documents d LEFT JOIN (SELECT * FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id")
def metadata_left_join(spark, d):
    """Documents without approved metadata stay, with null metadata."""
    approved = relational.scan(table(spark, d, "labels"), {"quality": 1}, ["doc_id", "quality"])
    return table(spark, d, "documents").select("doc_id", "lang").join(approved, "doc_id", "left").withColumn("quality", F.when(F.col("quality") == 1, "good"))


@query("SELECT DISTINCT user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))")
def membership_semi(spark, d):
    own = relational.scan(table(spark, d, "customer"), {"c_mktsegment": ["BUILDING", "MACHINERY"]}).select(F.col("c_custkey").alias("user_id"))
    return relational.members(table(spark, d, "events").select("user_id").distinct(), own, ["user_id"])


@query("SELECT c_custkey, c_name, event_id FROM customer JOIN (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id) e ON c_custkey = user_id")
def index_join_latest(spark, d):
    from papyra.streaming import events as ev

    last = ev.newest(table(spark, d, "events"), "user_id", "ts", "event_id").select(F.col("user_id").alias("c_custkey"), "event_id")
    return table(spark, d, "customer").select("c_custkey", "c_name").join(last, "c_custkey")


@query("""WITH r AS (SELECT s_suppkey, s_name || '_v2.docx' AS file, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey END AS nation FROM supplier),
b AS (SELECT lower(split_part(c_name, '#', 2)) AS base, min(c_nationkey) AS n FROM customer GROUP BY 1), i AS (SELECT l_suppkey, min(l_orderkey)::INTEGER AS n FROM lineitem GROUP BY 1)
SELECT r.s_suppkey, r.file, coalesce(r.nation, b.n, i.n) AS nation FROM r LEFT JOIN b ON b.base = replace(split_part(lower(r.file), '#', 2), '_v2.docx', '') LEFT JOIN i ON i.l_suppkey = r.s_suppkey""")
def backfill_join(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", F.concat("s_name", F.lit("_v2.docx")).alias("file"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_nationkey")).alias("nation"))
    known = table(spark, d, "customer").select(F.lower(F.split_part("c_name", F.lit("#"), F.lit(2))).alias("base"), "c_nationkey")
    items = table(spark, d, "lineitem").select("l_suppkey", F.col("l_orderkey").cast("int").alias("n"))
    base = F.split_part(relational.base_name(F.col("file"), ["_v2"]), F.lit("#"), F.lit(2))
    return relational.backfilled(rows, "nation", (known, base, "base", "c_nationkey"), (items, F.col("s_suppkey"), "l_suppkey", "n"))


@query("SELECT k.doc_id, d.source FROM (SELECT DISTINCT l_orderkey AS doc_id FROM lineitem) k LEFT JOIN documents d ON d.doc_id = k.doc_id")
def id_mapping(spark, d):
    keys = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"))
    return relational.mapped(keys, table(spark, d, "documents"), "doc_id", "source")


@query("""WITH g AS (SELECT o_orderkey, o_custkey, max(o_totalprice) AS grade FROM orders GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey, grade FROM lineitem LEFT JOIN g ON o_custkey = l_suppkey AND o_orderkey = coalesce(CASE WHEN l_linenumber > 2 THEN l_orderkey END, l_partkey)""")
def composite_left_join(spark, d):
    graded = table(spark, d, "orders").groupBy("o_orderkey", "o_custkey").agg(F.max("o_totalprice").alias("grade"))
    own = F.coalesce(F.when(F.col("l_linenumber") > 2, F.col("l_orderkey")), F.col("l_partkey"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return relational.by_keys(rows, graded, {"o_orderkey": own, "o_custkey": "l_suppkey"}, "left").select("l_orderkey", "l_linenumber", "l_partkey", "grade")


@query("SELECT d.doc_id, d.n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL AND d.n_chars > 500")
def null_filter_scan(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "n_chars", "quality")
    return relational.text_scan(relational.scan(rows, {"quality": None}), "SELECT doc_id, n_chars FROM {df} WHERE n_chars > :least", least=500)


# --- aggregates --------------------------------------------------------------


@query("SELECT source, bool_or(n_chars > 5000) AS any_long, bool_and(length(text) > 100) AS all_text, count(*) AS n FROM documents GROUP BY source")
def any_all(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.bool_or(F.col("n_chars") > 5000).alias("any_long"), F.bool_and(F.length("text") > 100).alias("all_text"), F.count("*").alias("n"))


@query("SELECT conv_id, arg_min(text, turn) FILTER (role = 'assistant' AND length(text) > 40) AS text FROM conversations GROUP BY conv_id")
def first_valid_answer(spark, d):
    return relational.first_valid(table(spark, d, "conversations"), ["conv_id"], "text", "turn", (F.col("role") == "assistant") & (F.length("text") > 40))


@query("SELECT user_id, round(avg((event_type <> 'error')::INT::DOUBLE), 6) AS ratio, avg((event_type <> 'error')::INT::DOUBLE) >= 0.6 AS passed FROM events GROUP BY user_id")
def success_gate(spark, d):
    ok = F.avg((F.col("event_type") != "error").cast("double"))
    return table(spark, d, "events").groupBy("user_id").agg(F.round(ok, 6).alias("ratio"), (ok >= 0.6).alias("passed"))


@query("SELECT event_type, count(*) AS calls, round(avg(value), 4) AS mean, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.95) AS most, count(*) FILTER (value > 100) AS slow FROM events GROUP BY event_type")
def call_log(spark, d):
    """Latencies of logged calls, with exact percentiles: values are few enough for a group's counts to stay small."""
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count("*").alias("calls"), F.round(F.avg("value"), 4).alias("mean"), F.expr("percentile_disc(0.5) within group (order by value)").alias("median"),
        F.expr("percentile_disc(0.95) within group (order by value)").alias("most"), F.count_if(F.col("value") > 100).alias("slow"))


@query("SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus, nullif(l_linenumber::VARCHAR, '1') AS line FROM lineitem")
def full_row_dedup(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", F.nullif(F.col("l_linenumber").cast("string"), F.lit("1")).alias("line")).dropDuplicates()


@query("SELECT conv_id, turn, list(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)::VARCHAR AS previous FROM conversations")
def context_lists(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-5, -1)
    listed = F.collect_list(F.length("text")).over(w)
    text = F.when(F.size(listed) > 0, F.concat(F.lit("["), F.array_join(listed.cast("array<string>"), ", "), F.lit("]")))
    return table(spark, d, "conversations").select("conv_id", "turn", text.alias("previous"))


# --- texts -------------------------------------------------------------------

_TITLE = "array_to_string(list_transform(regexp_extract_all({c}, '[A-Za-z]+|[^A-Za-z]+'), lambda x: upper(x[1]) || lower(x[2:])), '')"


@query(f"""SELECT p_partkey, {_TITLE.format(c="p_name || '-2nd'")} AS titled, 'Part ' || p_name || ', type ' || p_type || '.' AS sentence, left(p_name || ' of ' || p_type, 20) || '.docx' AS stem,
 '<b>Kinds</b><br><ul><li>' || p_type || '</li><li>a &lt; b</li></ul>' AS listed, ends_with(p_name, 'bolt') AS is_bolt, p_size AS sheet_row, (ascii('A') - 64) * 26 + p_size % 26 + 1 AS sheet_col,
 regexp_replace(p_name || chr(8226) || 'é', '[^ -~é]', '', 'g') AS plain, length(p_name) - length(replace(p_name, ' ', '')) + 1 AS tokens FROM part""")
def text_forms(spark, d):
    cell = F.concat(F.lit("A"), F.chr(65 + F.col("p_size") % 26), F.col("p_size"))
    row, col = tx.letters_number(cell)
    name = F.col("p_name")
    return table(spark, d, "part").select(
        "p_partkey", tx.titled(F.concat(name, F.lit("-2nd"))).alias("titled"), tx.sentence(("Part", name), ("type", F.col("p_type")), ("none", F.lit(" "))).alias("sentence"),
        tx.short_stem(F.concat(name, F.lit(" of "), "p_type", F.lit(".docx"))).alias("stem"), tx.html_list("Kinds", F.array("p_type", F.lit("a < b"))).alias("listed"),
        name.endswith("bolt").alias("is_bolt"), row.alias("sheet_row"), col.alias("sheet_col"), tx.plain_text(F.concat(name, F.lit("•é"))).alias("plain"), tx.token_count(name).alias("tokens"))


@query("""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines, strpos(text, ' the ') AS place FROM documents)
SELECT doc_id, CASE WHEN place > 0 THEN substr(text, greatest(1, place - 40), place + 45 - greatest(1, place - 40)) END AS around, right(lines[1], 50) || chr(10) || coalesce(lines[2], '') || chr(10) || left(coalesce(lines[3], ''), 50) AS line,
 trim(regexp_replace(lines[1], '[ \t\r]+', ' ', 'g')) AS first FROM l""")
def context_windows(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.split("text", "\n").alias("lines"))
    return docs.select("doc_id", tx.around(F.col("text"), F.lit(" the ")).alias("around"), tx.line_around(F.col("lines"), F.lit(2)).alias("line"), F.trim(F.regexp_replace(F.get("lines", F.lit(0)), "[ \t\r]+", " ")).alias("first"))


@query("""SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN date_trunc('second', ts) - INTERVAL 330 MINUTE END AS parsed,
 CASE WHEN event_id % 9 <> 0 THEN strftime(ts - INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') || ' UTC' END AS stamp,
 CASE WHEN event_id % 9 = 0 THEN 'unreadable date: on day ' || event_id END AS error FROM events""")
def zoned_dates(spark, d):
    said = F.concat(F.date_format("ts", "EEE MMM dd HH:mm:ss"), F.lit(" IST "), F.date_format("ts", "yyyy"))
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("on day "), "event_id")).otherwise(said).alias("said"))
    at, error = rec.any_time(F.col("said"))
    return e.select("event_id", at.cast("timestamp_ntz").alias("parsed"), rec.stamp(at).alias("stamp"), error.alias("error"))


@query("""SELECT event_id, props AS whole, json_extract(props, '$.k')::VARCHAR AS k, nullif(replace('string' || CASE WHEN event_id % 2 = 0 THEN '' ELSE event_id::VARCHAR END, 'string', ''), '') AS id FROM events""")
def json_values(spark, d):
    """Values that stay JSON, and placeholders that become null."""
    k = F.to_json(F.variant_get(F.parse_json("props"), "$.k", "variant"))
    text = F.concat(F.lit("string"), F.when(F.col("event_id") % 2 == 0, "").otherwise(F.col("event_id").cast("string")))
    return table(spark, d, "events").select("event_id", F.col("props").alias("whole"), k.alias("k"), F.nullif(F.replace(text, F.lit("string"), F.lit("")), F.lit("")).alias("id"))


@query("SELECT event_id, 'rules' AS source, 't' || event_id AS text, event_type AS label FROM events UNION ALL SELECT event_id, 'model', 'm' || event_id, 'x' FROM events WHERE event_id % 3 = 0")
def nested_items(spark, d):
    """Items of nested responses that have all required keys."""
    text = lambda mark: F.concat(F.lit(mark), F.col("event_id"))
    good = F.create_map(F.lit("text"), text("t"), F.lit("label"), F.col("event_type"))
    part = F.create_map(F.lit("text"), text("m"), F.lit("label"), F.when(F.col("event_id") % 3 == 0, "x").otherwise(""))
    bad = F.create_map(F.lit("text"), text("b"), F.lit("other"), F.lit("y"))
    rows = table(spark, d, "events").select("event_id", F.create_map(F.lit("rules"), F.array(good, bad), F.lit("model"), F.array(part)).alias("r"))
    item = rows.select("event_id", F.explode(rec.flat_items(F.col("r"), ["text", "label"])).alias("i"))
    return item.select("event_id", *(F.col("i")[c].alias(c) for c in ("source", "text", "label")))


@query('SELECT p_partkey AS "P PARTKEY", p_name AS "P NAME", coalesce(nullif(p_type, \'PROMO\'), \'\') AS "P TYPE" FROM part')
def upper_headers(spark, d):
    """Fewer columns, sentinels replaced, headers in capitals."""
    p = table(spark, d, "part").drop("p_brand", "p_size", "p_retailprice").replace("PROMO", "", ["p_type"])
    return p.toDF(*rec.upper_names(p.columns))


@query("""WITH f AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'a/' || p_name || '.docx' WHEN 1 THEN 'a/.' || p_name WHEN 2 THEN '__MACOSX/' || p_name WHEN 3 THEN 'x/~$' || p_name || '.pptx' WHEN 4 THEN 'in/' || p_name || '.ZIP' ELSE p_name || '.TXT' END AS name FROM part)
SELECT p_partkey, name, lower(list_last(string_split(name, '.'))) AS suffix FROM f WHERE p_partkey % 6 IN (0, 5)""")
def wanted_files(spark, d):
    from papyra.sources import documents as sources

    n, k = F.col("p_name"), F.col("p_partkey") % 6
    name = F.when(k == 0, F.concat(F.lit("a/"), n, F.lit(".docx"))).when(k == 1, F.concat(F.lit("a/."), n)).when(k == 2, F.concat(F.lit("__MACOSX/"), n)).when(k == 3, F.concat(F.lit("x/~$"), n, F.lit(".pptx"))).when(k == 4, F.concat(F.lit("in/"), n, F.lit(".ZIP"))).otherwise(F.concat(n, F.lit(".TXT")))
    f = table(spark, d, "part").select("p_partkey", name.alias("name")).filter(sources.wanted(F.col("name")))
    return f.select("p_partkey", "name", sources.suffix(F.col("name")).alias("suffix"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'EMAIL' WHEN p_partkey % 3 = 1 THEN 'SSN' END AS label FROM part")
def full_value_cells(spark, d):
    k = F.col("p_partkey")
    value = F.when(k % 3 == 0, F.concat(F.lit("u"), k, F.lit("@x.org"))).when(k % 3 == 1, F.lit("123-45-6789")).otherwise(F.concat(F.lit("call 123-45-6789 or u@x.org "), k))
    return table(spark, d, "part").select("p_partkey", sensitive.full_value_label(value).alias("label"))


@query("SELECT p_partkey, '<KIND> is ' || replace(p_name, split_part(p_name, ' ', 2), '<NOUN>') || ' (kept)' AS masked FROM part")
def masked_text(spark, d):
    noun = F.split_part("p_name", F.lit(" "), F.lit(2))
    item = lambda t, label, score: F.struct(t.alias("text"), F.lit(label).alias("label"), F.lit(score).alias("score"))
    text = F.concat(F.lit("K.(1) is "), "p_name", F.lit(" (kept)\n  "), noun)
    items = F.array(item(F.lit("K"), "LETTER", 0.9), item(F.lit("K.(1"), "KIND", 0.9), item(noun, "NOUN", 0.8), item(F.lit("kept"), "NO", 0.5))
    return table(spark, d, "part").select("p_partkey", F.replace(sensitive.mask(text, items), F.lit("<KIND>)"), F.lit("<KIND>")).alias("masked"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, min(CASE WHEN v = 1 THEN 0 ELSE l_discount END) AS score FROM (SELECT *, max(CASE WHEN l_discount = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY l_partkey, l_suppkey) AS v FROM lineitem) GROUP BY ALL HAVING min(CASE WHEN v = 1 THEN 0 ELSE l_discount END) > 0.05")
def veto_items(spark, d):
    items = table(spark, d, "lineitem").withColumn("score", F.col("l_discount"))
    out = sensitive.veto(items, ["l_partkey", "l_suppkey"]).groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.min("score").alias("score"))
    return out.filter("score > 0.05")


@query("SELECT p_partkey, p_size % 2 = 0 AS cleared FROM part")
def control_tables(spark, d):
    header = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("Author"), F.lit("Version"))).otherwise(F.array(F.lit("Item"), F.col("p_retailprice").cast("string")))
    return sensitive.without_controls(table(spark, d, "part").select("p_partkey", header.alias("header")), "header", ["author", "reviewer", "version"]).select("p_partkey", "cleared")


@query("SELECT p_partkey, 0.2::DOUBLE * (p_size % 101) + 0.3::DOUBLE * (p_partkey % 101) + 0.5::DOUBLE * (p_size * 2) AS score FROM part")
def deck_scores(spark, d):
    return table(spark, d, "part").select("p_partkey", rec.deck_score((F.col("p_size") % 101).cast("double"), (F.col("p_partkey") % 101).cast("double"), (F.col("p_size") * 2).cast("double")).alias("score"))


# --- sheets ------------------------------------------------------------------

_SHEET = "SELECT l_orderkey::VARCHAR AS sheet, l_linenumber::INTEGER AS r, (l_partkey % 4 + 1)::INTEGER AS c, min(l_quantity)::INTEGER::VARCHAR AS value FROM lineitem GROUP BY ALL"


def _cells(spark, d):
    own = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("int").alias("row"), (F.col("l_partkey") % 4 + 1).cast("int").alias("col"))
    return own.agg(F.min("l_quantity").alias("value")).select(F.col("l_orderkey").cast("string").alias("sheet"), "row", "col", F.col("value").cast("int").cast("string").alias("value"))


def _stored_cells(spark, d):
    """Cells that are read more than once, so that no task holds their groups beside the sorts of a join."""
    return stored(_cells(spark, d), "cells")


@query(f"""WITH cells AS ({_SHEET}), s AS (SELECT sheet, max(r) AS mr, max(c) AS mc FROM cells GROUP BY sheet),
g AS (SELECT sheet, r, unnest(range(1, mc + 1)) AS c FROM (SELECT sheet, mc, unnest(range(1, mr + 1)) AS r FROM s))
SELECT sheet, r::INTEGER AS row, c::INTEGER AS col, coalesce(value, '') AS value FROM g LEFT JOIN cells USING (sheet, r, c)""")
def sheet_grid(spark, d):
    return tables.full_grid(_stored_cells(spark, d)).select("sheet", "row", "col", "value")


@query(f"WITH cells AS ({_SHEET}), m AS (SELECT sheet, r AS r0, c AS c0, value FROM cells WHERE c = 1 AND r % 2 = 1), a AS (SELECT sheet, r0 + i AS r, c0 + j AS c, value FROM m, (VALUES (0), (1)) x(i), (VALUES (0), (1), (2)) y(j)) SELECT sheet, r::INTEGER AS row, c::INTEGER AS col, value FROM a UNION ALL SELECT sheet, r, c, value FROM cells ANTI JOIN a USING (sheet, r, c)")
def merged_cells(spark, d):
    cells = _stored_cells(spark, d)
    merged = cells.filter("col = 1 and row % 2 = 1").select("sheet", F.col("row").alias("row0"), F.col("col").alias("col0"), (F.col("row") + 1).alias("row1"), (F.col("col") + 2).alias("col1"))
    return tables.spread_merged(cells, merged).select("sheet", "row", "col", "value")


@query(f"WITH cells AS ({_SHEET}) SELECT sheet, r AS row, string_agg(value, '~' ORDER BY c) AS line, count(*) FILTER (c = 1) > count(*) FILTER (c <> 1) AS header FROM cells GROUP BY sheet, r")
def sheet_rows(spark, d):
    return tables.rows_text(_cells(spark, d).withColumn("is_header", F.col("col") == 1), ["sheet"]).select("sheet", "row", "line", "header")


@query(f"WITH cells AS ({_SHEET}) SELECT sheet, r + 1 AS row, CASE c WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'x' ELSE 'x_dup_1' END AS name, value FROM cells")
def sheet_records(spark, d):
    """Rows under a header in which a name stands twice."""
    cells = _stored_cells(spark, d)
    header = cells.select("sheet").distinct().select("sheet", F.lit(1).alias("row"), F.inline(F.array(*(F.struct(F.lit(k + 1).alias("col"), F.lit(n).alias("value")) for k, n in enumerate("abxx")))))
    return tables.table_records(cells.withColumn("row", F.col("row") + 1).unionByName(header))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
p AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM l)
SELECT doc_id, count(*) FILTER (lower(trim(before)) IN ('', 'revision history')) AS after_marks FROM p GROUP BY doc_id""")
def marked_lines(spark, d):
    hits = F.size(F.filter(rec.after_mark(F.split("text", "\n"), ["", "revision history"]), lambda x: x)).cast("long")
    return table(spark, d, "documents").select("doc_id", hits.alias("after_marks"))


# --- events ------------------------------------------------------------------


@query("SELECT 'r' || event_id AS request, event_type AS kind, user_id AS user, value::VARCHAR AS amount, ts IS NOT NULL AS logged FROM events")
def envelope_log(spark, d):
    """Messages encoded and decoded again; every second has its payload inside its payload."""
    from papyra.streaming import events as ev

    e = table(spark, d, "events")
    header = F.struct(F.col("event_type").alias("eventType"), F.concat(F.lit("r"), F.col("event_id")).alias("requestId"))
    payload = F.struct(F.col("user_id").alias("user"), F.col("value").cast("string").alias("amount"))
    plain, nested = ev.encode(header, payload), ev.encode(header, F.struct(payload.alias("payload")))
    messages = e.select(F.when(F.col("event_id") % 2 == 0, plain).otherwise(nested).alias("value"), "ts")
    logged = ev.log_rows(messages, "user: bigint, amount: string", F.col("ts"))
    return logged.select("request", "kind", "payload.user", "payload.amount", F.col("at").isNotNull().alias("logged"))


@query("SELECT event_id, user_id, value, CASE WHEN k = 1 THEN 'ACCEPTED' ELSE 'GENERATED' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)")
def feedback_latest(spark, d):
    """A decision goes to the latest request of its user."""
    from papyra.streaming import events as ev

    e = table(spark, d, "events").withColumn("status", F.lit("GENERATED"))
    decisions = e.select("user_id").distinct().withColumn("decision", F.lit("ACCEPTED"))
    return ev.decide_latest(e, decisions, "user_id", "ts", "event_id").select("event_id", "user_id", "value", "status")


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS current FROM events")
def replaced_versions(spark, d):
    from papyra.streaming import events as ev

    return ev.replaced(table(spark, d, "events"), "user_id", "ts", "event_id").select("event_id", "user_id", "current")


@query("""WITH f AS (SELECT user_id, count(*) FILTER (event_type = 'view') > 0 AS a, count(*) FILTER (event_type = 'click') > 0 AS b, count(*) FILTER (event_type = 'purchase') > 0 AS c FROM events GROUP BY user_id)
SELECT user_id, array_to_string(list_filter([CASE WHEN NOT a THEN 'scan' END, CASE WHEN NOT b AND user_id % 2 = 0 THEN 'redaction' END, CASE WHEN NOT c AND user_id % 2 = 0 THEN 'upload' END], lambda x: x IS NOT NULL), ',') AS stages FROM f""")
def stage_states(spark, d):
    """What is left to do of a request: finished stages come from its events; without sensitive items redaction and upload go."""
    from papyra.streaming import events as ev

    stage = F.create_map(*map(F.lit, ("view", "scan", "click", "redaction", "purchase", "upload")))[F.col("event_type")]
    state = table(spark, d, "events").groupBy("user_id").agg(F.collect_set(stage).alias("finished"))
    left = ev.stages_left(F.col("finished"), ["scan", "redaction", "upload"], F.col("user_id") % 2 == 0, F.lit(False))
    return state.select("user_id", F.array_join(left, ",").alias("stages"))


# --- stored tables -----------------------------------------------------------


@query("SELECT r_regionkey, r_name, 'snapshot' AS part FROM region UNION ALL SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'NEW' ELSE r_name END, 'now' FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 77, 'MORE', 'now' UNION ALL SELECT r_regionkey, r_name, 'json' FROM region WHERE r_regionkey < 2")
def table_cycle(spark, d):
    """Bulk insert, snapshot, update, delete, append and rebuild of a stored table, and a JSON copy of its first version."""
    from papyra.session import shared_folder
    from papyra.sources.stores import Table, write_json

    root, region = shared_folder(spark, "table"), table(spark, d, "region")
    own = Table(spark, f"{root}/t", "r_regionkey int, r_name string")
    own.append(region)
    kept = own.snapshot(f"{root}/snapshot")
    own.rebuild(relational.update(own.read(), {"r_regionkey": 1}, {"r_name": "NEW"}))
    own.delete(r_regionkey=2)
    own.append(spark.createDataFrame([(77, "MORE")], "r_regionkey int, r_name string"))
    write_json(region.filter("r_regionkey < 2"), f"{root}/json")
    again = spark.read.schema("r_regionkey int, r_name string").json(f"{root}/json")
    return kept.withColumn("part", F.lit("snapshot")).unionByName(own.read().withColumn("part", F.lit("now"))).unionByName(again.withColumn("part", F.lit("json")))


@query("SELECT n_name, n_nationkey AS number FROM nation WHERE n_nationkey > (SELECT max(n_nationkey) FROM nation WHERE n_regionkey = 1)")
def pending_migrations(spark, d):
    from papyra.sources.stores import pending

    n = table(spark, d, "nation").select(F.concat(F.lpad(F.col("n_nationkey").cast("string"), 6, "0"), F.lit("_"), "n_name").alias("name"), "n_name", "n_regionkey")
    return pending(n, n.filter("n_regionkey = 1")).select("n_name", "number")
