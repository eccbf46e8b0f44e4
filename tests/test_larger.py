"""What larger tables showed: joins, lists, searches and streams whose cost must follow their input."""

import pytest


def joins_of(df):
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        df.sparkSession.conf.unset("spark.sql.adaptive.enabled")


def test_clusters_send_no_side_through_the_driver(spark):
    from papyra.operators import tables

    cells = spark.createDataFrame([("a", 1, 1, "x", True), ("a", 1, 2, "y", False), ("a", 9, 9, "z", False)], "sheet string, row int, col int, value string, is_header boolean")
    out = tables.cell_clusters(cells)
    plan = joins_of(out)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted((r["row"], r["col"], r["cluster"]) for r in out.collect()) == [(1, 1, 0), (1, 2, 0), (9, 9, 1)]


def test_a_list_far_larger_than_an_automaton_is_taken_whole(spark, monkeypatch):
    from papyra.operators import dictionary

    docs = spark.createDataFrame([(k, f"Alpha beta, x@y.org #{k} alphabet c++ Customer#{k:03d}.", "alpha" if k % 2 else None) for k in range(40)], "doc_id long, text string, title string")
    words = [("alpha", "A"), ("alpha beta", "AB"), ("beta", "B"), ("x@y.org", "MAIL"), ("c++", "C"), ("++", "PLUS"), ("org", "O")]
    listed = spark.createDataFrame(words + [(f"customer#{k:03d}", "NAME") for k in range(20, 900)], "item string, label string")
    whole = lambda: sorted(dictionary.redact_listed(docs, listed, ["text", "title"]).collect())
    counts = lambda: sorted(dictionary.mentions(docs, listed, "doc_id", "text", "item").collect())
    one, n = whole(), counts()
    assert one[21]["text"] == "<AB>, <MAIL> #21 alphabet <C> <NAME>." and one[21]["title"] == "<A>" and one[19]["text"].endswith("Customer#019.")
    own = dictionary.present(docs, ["text", "title"], listed, "item", True, True)
    assert own.count() == len(words) + 20 and dictionary.needed(own, True, 20_000) == 1
    assert sorted(dictionary.redact_listed(docs, listed, ["text", "title"], cells=20_000).collect()) == one  # the whole list takes more
    monkeypatch.setattr(dictionary, "CELLS", 300)
    assert dictionary.needed(own, True) > 3
    assert whole() == one and counts() == n


def test_quantiles_by_sketches_are_exact(spark):
    from pyspark.sql import functions as F

    from papyra.operators import metrics

    rows = [("a", k % 9973 / 7.0) for k in range(60_000)] + [("b", 5.0)] * 30 + [(None, 1.0), (None, 2.0), ("c", None), ("a", None)]
    calls = spark.createDataFrame(rows, "kind string, value double")
    stored = metrics.merged(metrics.sketches(calls, ["kind"], "value", k=64), ["kind"], k=64)  # coarse: its bounds miss at first
    ranks = {"low_": 0.0, "median": 0.5, "most": 0.95, "all": 1.0}
    got = {r["kind"]: r for r in metrics.exact_quantiles(calls, stored, ["kind"], "value", ranks, margin=0.0005).collect()}
    want = calls.groupBy("kind").agg(*(F.expr(f"percentile_disc({r}) WITHIN GROUP (ORDER BY value)").alias(n) for n, r in ranks.items())).collect()
    assert len(got) == 4 and {r["kind"]: tuple(got[r["kind"]][n] for n in ranks) for r in want} == {r["kind"]: tuple(r)[1:] for r in want}


def test_references_need_their_semicolon_where_asked(spark):
    from papyra.sources import documents

    page = b"<p>a &amp;&amp;&amp; b&amp</p><p>&#233;&#xe9; &ampx; &copy 1 &nosuch; &amp;lt;</p>"
    assert [x for _, x in documents.html_lines(page, loose=False)] == ["a &&& b&amp", "éé &ampx; &copy 1 &nosuch; &lt;"]
    assert [x for _, x in documents.html_lines(page)][0] == "a &&& b&"
    files = spark.createDataFrame([("a.html", bytearray(page))], "path string, content binary")
    assert [r["text"] for r in documents.read_lines(files, loose=False).orderBy("line_no").collect()][0] == "a &&& b&amp"


def test_scaling_by_few_groups_shuffles_no_rows(spark):
    from papyra.operators import relational

    rows = spark.range(1000).selectExpr("id", "case when id % 100 = 0 then 'a' when id % 100 = 1 then null else 'n' end AS g", "id AS v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in joins_of(relational.scaled_by_group(rows, ["g"], "v", "s"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert relational.scaled_by_group(rows, ["g"], "v", "s").filter("g = 'n' AND id = 999").first()["s"] == 100.0


def test_a_small_request_asks_its_state_three_times():
    from papyra.streaming.stateful import Barrier

    calls, values = [], {}

    class State:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, what):
            def run(*args):
                calls.append((self.name, what))
                if what == "get":
                    return values.get(self.name)
                if what == "update":
                    values[self.name] = args[0]
                if what == "updateValue":
                    values.setdefault("keys", set()).add(args[0])
                return args[0] in values.get("keys", ()) if what == "containsKey" else None

            return run

    class Handle:
        getMapState = getValueState = staticmethod(lambda name, *_: State(name))
        registerTimer = staticmethod(lambda at: calls.append(("timer", at)))
        deleteTimer = staticmethod(lambda at: calls.append(("gone", at)))

    class Times:
        getCurrentWatermarkInMs = staticmethod(lambda: 0)

    b = Barrier(75_000, 3_600_000)
    b.init(Handle)
    rows = lambda idx, of: iter([{"idx": i, "total": of, "ms": 1_000} for i in idx])
    assert list(b.handleInputRows((7,), rows([1, 2, 2, 9], 4), Times)) == [] and len(calls) == 3
    got = [tuple(r) for r in b.handleInputRows((7,), rows([3, 4, 1], 4), Times)]
    assert got == [(7, 4, 4, True)] and list(b.handleInputRows((7,), rows([4], 4), Times)) == []
    values.clear()
    got = [tuple(r) for r in b.handleInputRows((8,), rows([*range(1, 201), 150, 62, 63], 200), Times)]
    assert got == [(8, 200, 200, True)]


def test_nearest_of_sorts_only_what_may_be_kept(spark, monkeypatch):
    import numpy as np

    from papyra.operators import search

    r = np.random.default_rng(1)
    vectors = [(k, [float(x) for x in r.integers(-2, 3, 4)]) for k in range(300)] + [(900, None), (901, [0.0] * 4)]
    rows = spark.createDataFrame(vectors, "id long, embedding array<double>")
    store = rows.withColumnRenamed("id", "other")

    def unit(v):
        n = np.linalg.norm(v)
        return None if not n else np.array(v) / n

    for above in (None, 0.9, 2.0):
        got = sorted((x["id"], x["other"], x["rank"]) for x in search.nearest_of(rows.filter("id % 7 = 0"), store, 4, ["id"], "other", above=above, block=64).withColumn("similarity", search.F.round("similarity", 9)).collect())
        near = search.nearest_of(rows.filter("id % 7 = 0"), store, 4, ["id"], "other", above=above, block=64).collect()
        best = {}
        for a, v in vectors:
            if a % 7 == 0 and v and (u := unit(v)) is not None:
                best[a] = sorted((float(u @ w) for _, x in vectors if x and (w := unit(x)) is not None and (above is None or u @ w > above)), reverse=True)[:4]
        mine = {}
        for x in near:
            mine.setdefault(x["id"], []).append(x["similarity"])
        assert {a: np.round(sorted(v, reverse=True), 6).tolist() for a, v in mine.items()} == {a: np.round(v, 6).tolist() for a, v in best.items() if v}
        assert len(got) == len(near)


def test_ratios_count_to_the_end_only_what_may_reach_the_bound(monkeypatch):
    import random

    from papyra.functions import fuzzy

    r = random.Random(3)
    texts = ["", "a", *("".join(r.choices("abc de", k=r.randint(1, 200))) for _ in range(40))]
    texts += [t[: len(t) // 2] + "x" + t[len(t) // 2 + r.randint(1, 20) :] for t in texts]
    whole = {(a, b): fuzzy.ratio_of(a, b) for a in texts for b in texts}
    for least in (0.0, 55.0, 80.0, 100.0):
        got = {(a, b): v for a, b, v in fuzzy.ratios(sorted(set(texts)), sorted(set(texts)), least)}
        assert got == {p: v for p, v in whole.items() if v >= least}
    steps, a, b = [], "ab" * 2000, "cd" * 2000 + "ab" * 300
    class Seen(dict):  # noqa: E306
        def get(self, c, other):
            steps.append(c)
            return super().get(c, other)
    assert fuzzy.lcs(a, b, Seen(fuzzy.places(a)), 3600.0) == -1 and len(steps) < 1200


def test_merged_ranges_meet_their_values_before_they_become_cells(spark):
    from papyra.operators import tables
    from papyra.plans.catalogue import QUERIES

    cells = spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 2, "y"), ("a", 5, 5, "z"), ("b", 1, 1, "w"), ("b", 4, 4, "v")], "sheet string, row int, col int, value string")
    merged = spark.createDataFrame([("a", 1, 1, 2, 2), ("a", 2, 2, 2, 3), ("b", 3, 3, 4, 4)], "sheet string, row0 int, col0 int, row1 int, col1 int")
    out = tables.spread_merged(cells, merged)
    want = [("a", r, c, "x") for r in (1, 2) for c in (1, 2)] + [("a", 2, 2, "y"), ("a", 2, 3, "y"), ("a", 5, 5, "z"), ("b", 1, 1, "w")]
    assert sorted(map(tuple, out.collect())) == sorted(want)  # ranges that overlap give a cell each; one without a value clears its cells
    filled = joins_of(out).split("LeftAnti")[0]
    assert filled.index("Generate") < filled.index("Join")
    plan = joins_of(QUERIES["merged_cells"](spark, "/root/testdata/sf0.001"))
    assert "Aggregate" not in plan and "lineitem" not in plan  # cells are made once, not in the tasks that join them


def test_calls_for_requests_are_one_join(spark):
    from papyra.operators import generation

    kind = "request long, project long, template long, offer_score double, similarity double, acceptance double"
    offers = spark.createDataFrame([(1, 7, 3, 5.0, 2.0, 40.0), (1, 7, 3, 5.0, 2.0, 40.0), (1, 6, 3, 5.0, 2.0, 40.0), (1, 9, 4, 1.0, 1.0, None), (2, 8, 3, 1.0, 1.0, 40.0)], kind)
    rows = [(1, 7, 3, 5.0, 2.0, 10.0, "offerbased", "ACCEPTED"), (1, 7, 3, 5.0, 2.0, 10.0, "offerbased", "REJECTED"), (2, 5, 9, 1.0, 1.0, 30.0, "search", "GENERATED")]
    name = generation.define(spark, offers, spark.createDataFrame(rows, f"{kind}, method string, status string"), "one_join")
    calls = spark.createDataFrame([(1, False), (1, True), (2, True), (2, None), (3, False), (None, True)], "request long, refine boolean")
    out = generation.generate(calls, name, calls["refine"])
    assert joins_of(out).count("Join ") == 2  # the calls' and that of the decided templates
    got = sorted((tuple(r) for r in out.collect()), key=str)
    new = [(False, 1, 6, 3, 5.0, 2.0, 40.0, "offerbased", "GENERATED"), (False, 1, 9, 4, 1.0, 1.0, None, "offerbased", "GENERATED")]
    old = [(True, *r[:5], 50.0 if r[2] == 3 else 30.0, *r[6:]) for r in rows]
    assert got == sorted(new + old, key=str)


def test_unrelated_texts_of_one_alphabet_are_ruled_out_together(spark, monkeypatch):
    import random

    from papyra.functions import fuzzy
    from papyra.operators import chunking

    r = random.Random(11)
    syllables = ["".join(r.choices("etaoinshrdlu", k=r.randint(2, 4))) for _ in range(40)]
    text = lambda n: " ".join("".join(r.choices(syllables, k=r.randint(1, 3))) for _ in range(n))

    def changed(t, share):
        out = list(t)
        for k in r.sample(range(len(t)), int(len(t) * share)):
            out[k] = r.choice(["", "x", "e", out[k] + "n", "\U0001f600"])
        return "".join(out)

    templates = [text(r.choice([3, 40, 120, 160])) for _ in range(30)]
    texts = [changed(r.choice(templates), r.choice([0.05, 0.15, 0.2, 0.25, 0.3])) for _ in range(60)] + [text(r.choice([3, 40, 120, 160])) for _ in range(30)] + [templates[0], "", "x" * 300, "漢字" * 90]
    counted = []
    lcs = fuzzy.lcs
    monkeypatch.setattr(fuzzy, "lcs", lambda *a: counted.append(a[:2]) or lcs(*a))
    got = {(a, b): v for a, b, v in fuzzy.ratios(texts, templates, 80.0)}
    assert len(counted) < 150  # of 2,820 pairs
    near = {(a, b): fuzzy.ratio_of(a, b) for a in texts for b in templates}
    assert got == {p: v for p, v in near.items() if v >= 80} and 30 < len(got) and any(v < 82 for v in got.values())
    monkeypatch.setattr(fuzzy, "PAIRS", 7)
    monkeypatch.setattr(fuzzy, "LOOK", 5)
    assert got == {(a, b): v for a, b, v in fuzzy.ratios(texts, templates, 80.0)}
    monkeypatch.setattr(chunking, "TEXTS", 8)
    monkeypatch.setattr(chunking, "TEMPLATES", 8)
    a, b = (spark.createDataFrame([(x,) for x in sorted(set(t))], "norm string") for t in (texts, templates))
    out = chunking.rated_pairs(a, b, 80.0)
    assert "CartesianProduct" in joins_of(out) and {(x["norm"], x["template_norm"]): x["ratio"] for x in out.collect()} == got


def test_searched_templates_shuffle_no_text_for_a_pair(spark, monkeypatch):
    import random

    from papyra.functions import fuzzy
    from papyra.functions.embedding import hashed
    from papyra.operators import chunking, search

    r = random.Random(12)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randint(3, 8))) for _ in range(60)]
    base = [" ".join(r.choices(words, k=80)) for _ in range(24)]
    rows = [(20 * k, 0, 1, t) for k, t in enumerate(base)] + [(20 * k + 1, 0, 1, t.replace("e", "", 9)) for k, t in enumerate(base)] + [(2, 0, 2, " ".join(r.choices(words, k=80))), (2, 1, 2, None)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_idx int, tot_chunks int, content string").withColumn("embedding", hashed("content"))
    templates = chunks.filter("doc_id % 20 = 0")
    found = lambda: sorted(map(tuple, chunking.search_templates(chunks, templates).collect()))
    one = found()
    assert {(d, t) for d, t, *_ in one} >= {(20 * k + 1, 20 * k) for k in range(24)}
    assert not [x for x in joins_of(chunking.search_templates(chunks, templates)).splitlines() if "Exchange" in x and "t_norm" in x or "Join" in x and "place" in x]
    monkeypatch.setattr(chunking, "PLACES", 5)
    assert found() == one
    counted, lcs = [], fuzzy.lcs
    monkeypatch.setattr(fuzzy, "lcs", lambda *a: counted.append(a[:2]) or lcs(*a))
    pairs = [(x[3], y) for x in rows if x[3] for y in base]
    got = fuzzy.reached(*map(list, zip(*pairs, strict=True)), 80.0)
    assert len(counted) < 60 and [v if v >= 80 else None for v in (fuzzy.ratio_of(*p) for p in pairs)] == [None if v != v else v for v in got]
    scaled = spark.createDataFrame([(k, [0.1 * (k + 1), 0.3 * (k + 1), 0.7 * (k + 1)]) for k in range(40)], "k int, embedding array<double>")
    near = search.nearest_of(scaled, scaled.withColumnRenamed("k", "o"), 3, ["k"], "o").collect()
    assert {(x["o"], x["rank"]) for x in near} == {(0, 1), (1, 2), (2, 3)}  # equal ones by key, whatever their rounding


def test_sheets_that_fit_a_task_are_shuffled_once(spark, monkeypatch):
    import random

    import numpy as np

    from papyra.operators import tables

    def brute(points):
        apart = lambda p, q: abs(p[0] - q[0]) + abs(p[1] - q[1])
        near = [min((apart(p, q) for q in points if q != p), default=0) for p in points]
        reach, label, n = int(max(1, 1.5 * float(np.median(near)))), {}, 0
        for p in points:
            if p not in label:
                todo, label[p] = [p], n
                while todo:
                    one = todo.pop()
                    for q in points:
                        if q not in label and apart(one, q) <= reach:
                            label[q] = n
                            todo.append(q)
                n += 1
        return label

    r = random.Random(8)
    sheets = [[(r.randint(-w, w), r.randint(0, w)) for _ in range(r.choice([1, 2, 3, 30, 120]))] for w in (4, 20, 60) for _ in range(15)]
    want = {(k, *p): c for k, own in enumerate(sheets) for p, c in brute(sorted(set(own))).items()}
    rows = [(k, *p, "x") for k, own in enumerate(sheets) for p in own] + [(99, None, 1, "x"), (None, 1, 1, "x"), (0, 900, 900, " ")]
    cells = spark.createDataFrame(rows, "page long, row int, col int, value string")
    of = lambda df: {(x["page"], x["row"], x["col"]): x["cluster"] for x in df.collect()}
    out = tables.cell_clusters(cells, "page")
    assert joins_of(out).count("Exchange hashpartitioning") == 2  # of the cells, and of the sheets' sizes
    assert of(out) == want and out.count() == sum(map(len, sheets)) and out.columns == ["page", "row", "col", "value", "cluster"]
    monkeypatch.setattr(tables, "DISTANCES", 50)
    flat = [np.array([p[k] for own in sheets for p in own]) for k in (0, 1)]
    assert tables.clusters_of_sheets(*flat, np.array([len(s) for s in sheets])).tolist() == [want[(k, *p)] for k, own in enumerate(sheets) for p in own]
    monkeypatch.setattr(tables, "SHEET", 25)  # larger sheets go cell by cell
    assert of(tables.cell_clusters(cells, "page")) == want


def test_a_bucket_of_requests_is_read_and_written_once_a_batch(spark, tmp_path):
    import random
    import time

    import pandas as pd
    from pyspark.sql import Row

    from papyra.streaming.stateful import Barriers, barrier

    calls, values = [], {}

    class State:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, what):
            def run(*args):
                calls.append((self.name, what))
                if what == "update":
                    values[self.name] = args[0]
                return values.get(self.name) if what == "get" else None

            return run

    class Handle:
        getMapState = getValueState = staticmethod(lambda name, *_: State(name))
        registerTimer = staticmethod(lambda at: calls.append(("timer", at)))
        deleteTimer = staticmethod(lambda at: calls.append(("gone", at)))

    class Times:
        getCurrentWatermarkInMs = staticmethod(lambda: 0)

    b = Barriers(75_000, 3_600_000)
    b.init(Handle)
    rows = [Row(request_id=k, idx=i, total=2, ts=None, ms=1_000 + k) for k in range(500) for i in ((1, 2) if k % 5 == 0 else (1, 1))]
    assert {tuple(x) for x in b.handleInputRows((3,), iter(rows), Times)} == {(k, 2, 2, True) for k in range(0, 500, 5)}
    assert calls == [("requests", "get"), ("timer", 76_001), ("requests", "update")]

    # buckets and single requests report the same, over batches in which requests complete, expire, are forgotten and come again
    r = random.Random(5)
    at = lambda s: (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)).to_pydatetime()
    source = tmp_path / "in"
    source.mkdir()
    for k, begin in enumerate((0, 50, 300, 5000, 20_000, 40_000)):
        parts = [(q, r.randint(1, n + 1), n, at(begin + r.randint(0, 40))) for q in r.sample(range(40), 25) for n in (1 + q % 4,) for _ in range(3)] + [(77, i, 66, at(begin)) for i in range(14 * k + 1, 14 * k + 15)]
        spark.createDataFrame(parts, "request_id long, idx long, total long, ts timestamp").coalesce(1).write.parquet(f"{source}/{k}")
        time.sleep(0.05)
    got = []
    for buckets in (0, 3):
        stream = spark.readStream.schema("request_id long, idx long, total long, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
        barrier(stream, buckets=buckets).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/marks{buckets}").trigger(availableNow=True).start(f"{tmp_path}/out{buckets}").awaitTermination()
        got.append(sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out{buckets}").collect())))
    assert got[0] == got[1] and len({x[3] for x in got[0]}) == 2 and len(got[0]) > 40
