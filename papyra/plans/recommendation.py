"""Queries of search and recommendation: catalogue, templates, decisions, scores, grades."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.functions import scoring
from papyra.functions import text as tx
from papyra.operators import chunking, joins, relational, search
from papyra.plans.registry import query, table

# --- the composed query: requests, their best offers, templates, acceptance, score, label, priority

#: Fixed values of the query: weight of offer, similarity and acceptance by method.
_WEIGHTS = [("offerbased", 0.5, 0.3, 0.2), ("search", 0.0, 0.7, 0.3)]
_WEIGHTS_SQL = "(VALUES " + ", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for m, a, b, c in _WEIGHTS) + ") w(method, w_offer, w_sim, w_acc)"

_ITEMS = "SELECT l_orderkey AS request, l_suppkey AS project, l_returnflag AS status, l_quantity AS offer_score, l_extendedprice AS similarity, p_brand AS practice, p_type AS family, p_size AS offer FROM lineitem JOIN part ON l_partkey = p_partkey"
_TEMPLATES = "SELECT p_brand AS t_practice, p_type AS t_family, p_size AS t_offer, min(p_partkey) AS template FROM part GROUP BY ALL UNION ALL SELECT 'NONE', 'NONE', 0, -1"


@query(f"""WITH items AS ({_ITEMS}), templates AS ({_TEMPLATES}),
matched AS (SELECT i.*, t.template FROM items i JOIN templates t ON practice = t_practice AND family = t_family AND offer = t_offer AND status IN ('A', 'R')),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request, template ORDER BY offer_score DESC, similarity DESC, project, status) AS k FROM (SELECT DISTINCT * FROM matched)) WHERE k = 1),
accepted AS (SELECT template, nullif(count(*) FILTER (status = 'A'), 0) / count(*)::DOUBLE AS ratio FROM matched GROUP BY template),
joined AS (SELECT b.*, ratio, CASE WHEN status = 'A' THEN 'offerbased' ELSE 'search' END AS method FROM best b LEFT JOIN accepted USING (template)),
stats AS (SELECT method AS m, min(offer_score) AS lo, max(offer_score) AS ho, min(similarity) AS ls, max(similarity) AS hs, min(ratio) AS la, max(ratio) AS ha FROM joined GROUP BY method),
scaled AS (SELECT *, coalesce((offer_score - lo) / nullif(ho - lo, 0), 0) * 100 AS o, coalesce((similarity - ls) / nullif(hs - ls, 0), 0.01::DOUBLE) * 100 AS s, coalesce((ratio - la) / nullif(ha - la, 0), 0.01::DOUBLE) * 100 AS a FROM joined JOIN stats ON m = method),
scored AS (SELECT *, (w_offer * CASE WHEN w.method = 'offerbased' THEN o ELSE 0 END + w_sim * s + w_acc * a) * (0.95::DOUBLE + 0.05::DOUBLE * least(s, a) / 100) AS score FROM scaled JOIN {_WEIGHTS_SQL} ON w.method = scaled.method)
SELECT request, template, project, round(score, 4) AS score,
 CASE WHEN round(score, 4) > 90 THEN 'Very High' WHEN round(score, 4) > 75 THEN 'High' WHEN round(score, 4) > 50 THEN 'Medium' WHEN round(score, 4) > 25 THEN 'Low' WHEN round(score, 4) > -1 THEN 'Very Low' END AS relevance,
 'P' || (CASE status WHEN 'A' THEN 0 ELSE 12 END + CASE WHEN round(s, 6) > 75 THEN 3 WHEN round(s, 6) > 40 THEN 2 ELSE 1 END) AS priority
FROM scored""")
def recommendation(spark, d):
    part = table(spark, d, "part")
    items = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("request"), F.col("l_suppkey").alias("project"), F.col("l_returnflag").alias("status"), F.col("l_quantity").alias("offer_score"),
        F.col("l_extendedprice").alias("similarity"), F.col("p_brand").alias("practice"), F.col("p_type").alias("family"), F.col("p_size").alias("offer"))
    templates = part.groupBy("p_brand", "p_type", "p_size").agg(F.min("p_partkey").alias("template"))
    templates = templates.unionByName(spark.createDataFrame([("NONE", "NONE", 0, -1)], templates.schema))
    matched = relational.by_keys(items.filter(F.col("status").isin("A", "R")), templates, {"p_brand": "practice", "p_type": "family", "p_size": "offer"})
    order = [F.col("offer_score").desc(), F.col("similarity").desc(), F.col("project"), F.col("status")]
    best = relational.best(matched.distinct(), ["request", "template"], order)
    ratio = relational.ratio(matched, ["template"], F.col("status") == "A", F.lit(True))
    joined = best.join(ratio, "template", "left").withColumn("method", F.when(F.col("status") == "A", "offerbased").otherwise("search"))
    for value, out, default in (("offer_score", "o", 0.0), ("similarity", "s", 0.01), ("ratio", "a", 0.01)):
        joined = relational.scaled_by_group(joined, ["method"], value, out, default, few=True)
    weights = spark.createDataFrame(_WEIGHTS, "method string, w_offer double, w_sim double, w_acc double")
    offer = F.when(F.col("method") == "offerbased", F.col("o")).otherwise(0.0)
    score = F.round(scoring.blended([(F.col("w_offer"), offer), (F.col("w_sim"), F.col("s")), (F.col("w_acc"), F.col("a"))], F.col("s"), F.col("a")), 4)
    scored = joined.join(F.broadcast(weights), "method").withColumn("score", score)
    grade = F.when(F.col("status") == "A", "A").otherwise("E")
    return scored.select("request", "template", "project", "score", scoring.relevance(F.col("score")).alias("relevance"), scoring.priority(grade, scoring.similarity_level(F.round("s", 6))).alias("priority"))


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), t AS (SELECT *, CASE WHEN vec_id % 3 = 0 THEN 'f' || vec_id || '.docx' ELSE 'f' || vec_id || '.pptx' END AS filename FROM embeddings WHERE label IN (1, 2, 3, 4, 5)),
s AS (SELECT q.vec_id AS chunk, t.label AS template, t.vec_id AS place, list_cosine_similarity(t.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM q, t WHERE filename LIKE '%.docx'),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY round(score, 12) DESC, place) AS k FROM s WHERE score > 0.02) WHERE k <= 5),
sizes AS (SELECT label, count(*) AS total FROM embeddings GROUP BY label)
SELECT template, min(chunk) AS first_chunk, count(*) AS matches, round(max(score), 6) AS best, round(avg(score), 6) AS mean, round(count(*) * 100.0 / max(total), 6) AS coverage FROM top JOIN sizes ON label = template GROUP BY template""")
def template_vectors(spark, d):
    e = table(spark, d, "embeddings")
    name = F.concat(F.lit("f"), F.col("vec_id"), F.when(F.col("vec_id") % 3 == 0, ".docx").otherwise(".pptx"))
    templates = e.filter(F.col("label").isin(1, 2, 3, 4, 5)).withColumn("filename", name).filter(F.col("filename").endswith(".docx"))
    chunks = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("chunk"), "embedding")
    near = search.nearest_of(chunks, templates.withColumnRenamed("vec_id", "place"), 5, ["chunk"], "place", above=0.02)
    sizes = e.groupBy("label").agg(F.count("*").alias("total"))
    hits = near.join(templates.select(F.col("vec_id").alias("place"), "label"), "place").join(sizes, "label").withColumnRenamed("label", "template")
    out = chunking.template_hits(hits, [], "template", "chunk", "total", "similarity")
    return out.select("template", "first_chunk", "matches", F.round("best", 6).alias("best"), F.round("mean", 6).alias("mean"), F.round("coverage", 6).alias("coverage"))


@query()
def template_search(spark, d):
    """Each document's template by vectors of its chunks, then by the fuzzy ratio; templates are the documents whose id 20 divides."""
    from papyra.functions.embedding import hashed

    chunks = chunking.stored_chunks(table(spark, d, "documents"), hashed)
    return chunking.search_templates(chunks, chunks.filter("doc_id % 20 = 0"))


_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"""WITH names AS (SELECT name, {_GRAMS} AS g FROM (SELECT DISTINCT p_name AS name FROM part)), choices AS (SELECT name, {_GRAMS} AS g FROM (SELECT DISTINCT p_type || ' ' || p_brand AS name FROM part UNION SELECT DISTINCT s_name FROM supplier)),
s AS (SELECT a.name, b.name AS choice, len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))::DOUBLE AS score FROM names a, choices b)
SELECT name, choice, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, choice) AS k FROM s WHERE score > 0) WHERE k = 1""")
def best_choice(spark, d):
    """The most similar entry of a whole catalogue, by a join on trigrams."""
    part = table(spark, d, "part")
    names = part.select(F.col("p_name").alias("name")).distinct()
    choices = part.select(F.concat_ws(" ", "p_type", "p_brand").alias("choice")).union(table(spark, d, "supplier").select("s_name")).distinct()
    pairs = joins.fuzzy_pairs(names, choices, "name", "choice", 0.0)
    return relational.best(pairs, ["name"], [F.col("similarity").desc(), F.col("choice")]).select("name", "choice", F.round("similarity", 6).alias("score"))


@query()
def best_token_set(spark, d):
    """The best entry of a whole catalogue by the token-set ratio: misspelled names, and names with more words."""
    from papyra.operators.choices import best_choices

    part = table(spark, d, "part")
    texts = part.select(F.regexp_replace("p_name", "^(.)(.)", "$2$1").alias("text")).union(part.select(F.concat_ws(" ", "p_brand", "p_type", "p_name"))).distinct()
    choices = part.select(F.col("p_name").alias("choice")).union(part.select(F.concat_ws(" ", "p_type", "p_name")))
    return best_choices(texts, choices, "text", "choice").withColumn("score", F.round("score", 6))


@query("""WITH t AS (SELECT conv_id, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations),
p AS (SELECT a.conv_id, least(a.n, b.n) * 100.0::DOUBLE / greatest(a.n, b.n) AS score FROM t a JOIN t b ON b.conv_id = a.conv_id + 1 AND a.place = b.place)
SELECT conv_id, count(*) AS pairs, coalesce(round(avg(score), 2), 0) AS mean FROM p GROUP BY conv_id""")
def positional_scores(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    both = relational.positional(t, t.withColumn("conv_id", F.col("conv_id") - 1), ["conv_id"], "turn")
    score = F.least("n", "other_n") * 100.0 / F.greatest("n", "other_n")
    return both.groupBy("conv_id").agg(F.count("*").alias("pairs"), scoring.mean_score(score).alias("mean"))


@query("SELECT conv_id, role, count(*) AS n, max(length(text)) AS best, string_agg(text, '. ' ORDER BY turn) AS reasons FROM conversations GROUP BY conv_id, role HAVING max(length(text)) > 0")
def offer_consolidation(spark, d):
    """The reasons of each role of a conversation, joined in order."""
    c = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.max(F.length("text")).cast("long").alias("best"), F.collect_list(F.struct("turn", "text")).alias("t")).filter("best > 0")
    return c.select("conv_id", "role", "n", "best", F.array_join(F.transform(F.array_sort("t"), lambda x: x["text"]), ". ").alias("reasons"))


@query("""WITH w AS (SELECT doc_id, n_chars, list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda x: x <> '') AS words, string_split(text, chr(10)) AS lines FROM documents),
e AS (SELECT *, list_filter(words, lambda x: regexp_matches(x, '[0-9#*]')) AS bad, len(list_filter(lines, lambda x: regexp_matches(x, '[#*]'))) AS bad_lines FROM w)
SELECT doc_id, coalesce(round(greatest(0, 100 - len(list_distinct(bad)) * 100.0::DOUBLE / nullif(len(words), 0)), 2), 100) AS distinct_accuracy,
 round(0.6::DOUBLE * coalesce((len(lines) - bad_lines) * 100.0::DOUBLE / nullif(len(lines), 0), 0) + 0.4::DOUBLE * coalesce((len(words) - len(bad)) * 100.0::DOUBLE / nullif(len(words), 0), 0), 2) AS weighted,
 (n_chars % 101 + n_chars % 97)::DOUBLE / 2 AS kpi_mean,
 CASE WHEN (n_chars % 101 + n_chars % 97) / 2.0 >= 80 THEN 'Very High' WHEN (n_chars % 101 + n_chars % 97) / 2.0 >= 70 THEN 'High' WHEN (n_chars % 101 + n_chars % 97) / 2.0 >= 60 THEN 'Medium' WHEN (n_chars % 101 + n_chars % 97) / 2.0 >= 50 THEN 'Low' ELSE 'Very Low' END AS grade FROM e""")
def grading(spark, d):
    words, lines = F.filter(F.split("text", r"[ \t\r\n]+"), lambda x: x != ""), F.split("text", "\n")
    rows = table(spark, d, "documents").select("doc_id", "n_chars", words.alias("words"), lines.alias("lines"))
    bad, bad_lines = F.filter("words", lambda x: x.rlike("[0-9#*]")), F.size(F.filter("lines", lambda x: x.rlike("[#*]")))
    mean, grade = scoring.kpi_grade(F.create_map(F.lit("clarity"), (F.col("n_chars") % 101).cast("double"), F.lit("depth"), (F.col("n_chars") % 97).cast("double")))
    return rows.select(
        "doc_id", scoring.distinct_accuracy(bad, F.size("words")).alias("distinct_accuracy"),
        scoring.weighted_accuracy(F.size("lines"), bad_lines, F.size("words"), F.size(bad)).alias("weighted"), mean.alias("kpi_mean"), grade.alias("grade"))


@query("SELECT p_partkey, p_retailprice FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45) ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def undecided_top(spark, d):
    decided = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return relational.excluding(table(spark, d, "part"), decided, ["p_partkey"], [F.col("p_retailprice").desc(), F.col("p_partkey")], 20).select("p_partkey", "p_retailprice")


@query("SELECT vec_id, label, round(similarity, 6) AS similarity FROM (SELECT e.vec_id, e.label, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q WHERE e.vec_id NOT IN (SELECT doc_id FROM labels) AND e.vec_id % 7 <> 0) WHERE similarity > 0.01 ORDER BY similarity DESC, vec_id LIMIT 10")
def undecided_vectors(spark, d):
    """A search over a stored vector table, without what has been deleted from it or decided."""
    from papyra.session import shared_folder
    from papyra.sources.stores import VectorStore

    e = table(spark, d, "embeddings")
    store = VectorStore(spark, shared_folder(spark, "vectors"), lambda text: F.from_json(text, "array<float>"))
    rows = e.select(F.col("vec_id").cast("string").alias("id"), F.to_json("embedding").alias("content"), F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("old"), (F.col("vec_id") % 7 == 0).cast("string")).alias("metadata"))
    store.add(rows)
    store.add(rows.filter("metadata['label'] = '3'"))
    store.delete(old="true")
    decided = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"))
    got = store.search(e.filter("vec_id = 1"), 10, above=0.01, without=decided)
    return got.select(F.col("id").cast("long").alias("vec_id"), F.col("metadata")["label"].cast("int").alias("label"), F.round("similarity", 6).alias("similarity"))


@query("SELECT label AS name, count(*) AS chunks FROM (SELECT label::VARCHAR AS label FROM embeddings) GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM embeddings")
def chunk_counts(spark, d):
    e = table(spark, d, "embeddings")
    return e.groupBy(F.col("label").cast("string").alias("name")).agg(F.count("*").alias("chunks")).unionByName(e.agg(F.count("*").alias("chunks")).select(F.lit("all").alias("name"), "chunks"))


@query("""SELECT a.l_orderkey AS doc_id, a.l_linenumber AS line, count(*) AS copies FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_returnflag = 'R' AND b.l_orderkey = a.l_orderkey
 AND greatest(0, least(a.l_quantity + 10, b.l_quantity + 12) - greatest(a.l_quantity, b.l_quantity)) * greatest(0, least(a.l_linenumber + 2, b.l_linenumber + 3) - greatest(a.l_linenumber, b.l_linenumber)) / 20.0 >= 0.25) GROUP BY ALL""")
def spatial_anti_lines(spark, d):
    own = table(spark, d, "lineitem")
    box = lambda df, w, h: df.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + w).alias("x1"), F.col("l_linenumber").cast("double").alias("top"), (F.col("l_linenumber") + F.lit(float(h))).alias("bottom"))
    return joins.outside_boxes(box(own, 10, 2), box(own.filter("l_returnflag = 'R'"), 12, 3)).groupBy("doc_id", "line").agg(F.count("*").alias("copies"))
