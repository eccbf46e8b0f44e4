"""Dictionary search, vector index, choices, clusters, sequential functions, streams, the table function, sketches and archives against brute force."""

import random
import time
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from papyra.functions.fuzzy import token_set_of
from papyra.operators import chunking, choices, dictionary, generation, graph, metrics, sensitive, sequential, tables, vector_index
from papyra.sources import documents, office
from papyra.streaming.routed import DEAD, RoutedWrites
from papyra.streaming.stateful import barrier

SF = "/root/testdata/sf0.01"


def at_bounds(text: str, a: int, b: int) -> bool:
    word = lambda c: c.isalnum() or c == "_"
    return not (a > 0 and word(text[a - 1]) and word(text[a])) and not (b < len(text) and word(text[b - 1]) and word(text[b]))


def brute_places(texts, items, fold, bounded):
    out = []
    for k, t in enumerate(texts):
        low = dictionary.folded(t or "", fold)
        for i, item in enumerate(items):
            own = dictionary.folded(item, fold)
            at = low.find(own) if own else -1
            while at >= 0:
                if not bounded or at_bounds(low, at, at + len(own)):
                    out.append((k, at, at + len(own), i))
                at = low.find(own, at + 1)
    return sorted(out)


@pytest.mark.parametrize("stretch", [dictionary.STRETCH, 5])
@pytest.mark.parametrize("fold, bounded", [(True, True), (True, False), (False, False), (False, True)])
def test_automaton_finds_all_places(monkeypatch, stretch, fold, bounded):
    monkeypatch.setattr(dictionary, "STRETCH", stretch)
    r = random.Random(1)
    items = ["a", "ab", "abab", "Ba", "b a", "éa", "x_1", "1", "a-b", "日本", "ba b", "İ", "@a"]
    texts = [None, "", *("".join(r.choices(["a", "b", "A", "é", " ", "-", "_", "x", "1", "日", "本", "İ", "@"], k=r.randint(0, 60))) for _ in range(150))]
    found = dictionary.Automaton(items, fold, bounded).find(texts)
    assert sorted(map(tuple, found[["text", "start", "end", "item"]].values.tolist())) == brute_places(texts, items, fold, bounded)
    assert dictionary.Automaton([], fold, bounded).find(texts).empty
    assert found["text"].is_monotonic_increasing


def test_redaction_by_the_automaton_is_redaction_one_by_one(spark):
    r = random.Random(2)
    items = [("alpha", "A"), ("alpha beta", "AB"), ("Beta", "B"), ("x@y.org", "MAIL"), ("c++", "C")]
    pool = ["alpha", "Alpha", "beta", "BETA", "x@y.org", "C++", "other", "alphabet", "\n", "é"]
    rows = [(k, " ".join(r.choices(pool, k=r.randint(0, 25))), r.choice(["alpha", None, "none"])) for k in range(120)] + [(500, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, title string")
    listed = spark.createDataFrame(items, "item string, label string")
    got = {x["doc_id"]: x for x in dictionary.redact_listed(docs, listed, ["text", "title"]).collect()}
    for k, text, title in rows:
        want, log = sensitive.redact_one(text, items)
        assert got[k]["text"] == want and got[k]["title"] == sensitive.redact_one(title, items)[0]
        assert [(x["text"], x["placeholder"]) for x in got[k]["redactions"] if x["field"] == "text"] == [(a, b) for a, b, _ in log]
    with pytest.raises(ValueError):
        dictionary.redact_listed(docs, listed, ["text"], cells=40)
    one = {tuple(x) for x in dictionary.mentions(docs, listed, "doc_id", "text", "item").collect()}
    many = {tuple(x) for x in dictionary.mentions(docs, listed, "doc_id", "text", "item", cells=100).collect()}
    assert one == many and len(one) > 50
    assert dictionary.redact_listed(docs, listed.limit(0), ["text"]).filter(F.size("redactions") > 0).count() == 0
    assert dictionary.mentions(docs, listed.limit(0), "doc_id", "text", "item").collect() == []


def test_needs_of_patterns_lose_no_match(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert set(sensitive.NEEDS) < set(sensitive.PATTERNS)
    assert {tuple(x) for x in sensitive.detect(docs).collect()} == {tuple(x) for x in sensitive.detect(docs, patterns=dict(sensitive.PATTERNS)).collect()}


def test_vector_index_reads_few_cells_and_loses_nothing(spark, tmp_path):
    r = np.random.default_rng(1)
    middles = r.normal(0, 1, (20, 16))
    rows = [(k, (middles[k % 20] + r.normal(0, 0.05, 16)).tolist()) for k in range(2000)] + [(5000, [0.0] * 16), (5001, None), (5002, middles[0].tolist()), (5003, (2 * middles[0]).tolist())]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    index = vector_index.VectorIndex(spark, f"file://{tmp_path}/index", "id").build(df.filter("id < 900"), pivots=24).add(df.filter("id >= 900"))
    asked = df.filter("id % 100 = 1 or id = 5000 or id = 5003")
    got = defaultdict(list)
    for x in index.search(asked, 12, "id").orderBy("query", "rank").collect():
        got[x["query"]].append((x["id"], round(x["similarity"], 9)))
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v is not None and any(v)}
    for q in [*(k for k in range(2000) if k % 100 == 1), 5003]:
        want = sorted(((i, round(float(unit[q] @ u), 9)) for i, u in unit.items()), key=lambda x: (-x[1], x[0]))[:12]
        assert got[q] == want
    assert 5000 not in got and 0 < index.read["searched"] < 0.3 * index.read["pairs"]


def test_vector_index_in_blocks_with_copies_and_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 9)
    monkeypatch.setattr(vector_index, "CHUNK", 7)
    r = np.random.default_rng(2)
    some = r.normal(0, 1, (30, 8))
    rows = [(f"k{k:04}", some[k % 30 if k < 200 else 3].tolist()) for k in range(400)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>").repartition(16)
    index = vector_index.VectorIndex(spark, f"file://{tmp_path}/index", "id").build(df, pivots=6)
    folders = list((tmp_path / "index" / "vectors").glob("cell=*"))
    assert sum(1 for f in folders for _ in f.glob("*.parquet")) <= len(folders) + 4  # not one for each cell and task
    got = defaultdict(list)
    for x in index.search(df.filter("id like '%3'"), 5, "id").orderBy("query", "rank").collect():
        got[x["query"]].append((x["id"], round(x["similarity"], 9)))
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    assert len(got) == 40
    for q, own in got.items():
        assert own == sorted(((i, round(float(unit[q] @ u), 9)) for i, u in unit.items()), key=lambda x: (-x[1], x[0]))[:5]


def test_best_choices_match_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(choices, "TEXTS", 7)
    monkeypatch.setattr(choices, "CHOICES", 11)
    r = random.Random(3)
    words = ["red", "blue", "bolt", "bold", "ring", "large", "small", "rod", "iron", "the"]
    names = sorted({" ".join(r.choices(words, k=r.randint(1, 4))) for _ in range(60)})
    texts = sorted({" ".join(r.choices([*words, "rin", "lrage"], k=r.randint(1, 4))) for _ in range(50)})
    got = {x["text"]: (x["choice"], x["score"]) for x in choices.best_choices(spark.createDataFrame([(t,) for t in [*texts, None, "", texts[0]]], "text string"), spark.createDataFrame([(n,) for n in [*names, None]], "choice string"), "text", "choice").collect()}
    for t in texts:
        want = min(((-token_set_of(t, n), n) for n in names))
        assert got[t] == (want[1], -want[0]), t
    block = choices.Catalogue(names)
    for t in texts:
        bounds = block.bounds(sorted(set(t.split())))
        assert all(b >= token_set_of(t, n) - 1e-9 for b, n in zip(bounds, block.choices, strict=True))
    high = choices.best_choices(spark.createDataFrame([("zzz qqq",)], "text string"), spark.createDataFrame([("red",)], "choice string"), "text", "choice", least=50.0)
    assert high.collect() == []


def test_best_token_set_query_matches_all_pairs(spark):
    from papyra.plans.catalogue import QUERIES

    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()
    known = {p["p_name"] for p in part} | {f"{p['p_type']} {p['p_name']}" for p in part}
    got = QUERIES["best_token_set"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) > 100
    for x in got:
        want = min(((-token_set_of(x["text"], n), n) for n in known))
        assert (x["choice"], x["score"]) == (want[1], round(-want[0], 6))


def test_clusters_of_cells_match_brute_force(spark):
    r = random.Random(4)
    sheets = {"one": [(5, 5)], "two": [(1, 1), (1, 90)], "dense": [(i, j) for i in range(12) for j in range(9)], "far": [(i * 40, j * 40) for i in range(4) for j in range(4)] + [(0, 1), (1, 0)]}
    for k in range(8):
        sheets[f"r{k}"] = list({(r.randint(0, 60), r.randint(0, 60)) for _ in range(r.choice([3, 20, 150]))})
        sheets[f"b{k}"] = list({(a + r.randint(0, 4), b + r.randint(0, 6)) for a, b in [(0, 0), (9, 30), (200, 7)] for _ in range(25)})
    rows = [(s, i, j, "x") for s, own in sheets.items() for i, j in own] + [("one", 9, 9, " "), ("one", 8, 8, None)]
    cells = spark.createDataFrame(rows, "sheet string, row int, col int, value string")
    got = {(x["sheet"], x["row"], x["col"]): x["cluster"] for x in tables.cell_clusters(cells).collect()}
    want = {(s, *p): c for s, own in sheets.items() for p, c in zip(sorted(own), tables.clusters_of(sorted(own)), strict=True)}
    assert got == want and len(set(want.values())) > 3


def test_components(spark):
    r = random.Random(5)
    edges = {tuple(sorted(r.sample(range(300), 2))) for _ in range(200)} | {(k, k + 1) for k in range(400, 460)}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = {x["node"]: x["component"] for x in graph.components(spark.createDataFrame(sorted(edges), "u int, v int")).collect()}
    assert got == {x: find(x) for x in up}
    assert graph.components(spark.createDataFrame([], "u int, v int")).collect() == []


def test_headers_and_records_of_sheets(spark):
    cells = [("s", 1, 1, "a"), ("s", 1, 3, "b"), ("s", 2, 1, "p"), ("s", 2, 2, "q"), ("s", 2, 3, "r"), ("s", 3, 2, "5"), ("t", 4, 1, "x"), ("t", 4, 2, "x"), ("t", 6, 2, "1"), ("u", 1, 1, "only")]
    got = sorted(map(tuple, tables.table_records(spark.createDataFrame(cells, "sheet string, row int, col int, value string")).collect()))
    assert got == [("s", 3, "a q", "5"), ("t", 6, "x_dup_1", "1")]


def test_packing_and_slides_follow_their_order(spark):
    r = random.Random(6)
    rows = [(g, k, " ".join("w" * 3 for _ in range(r.randint(0, 30)))) for g in range(5) for k in range(40)]
    df = spark.createDataFrame(rows, "g int, k int, text string").withColumn("size", F.length("text")).repartition(4)
    packed, slides = defaultdict(dict), defaultdict(dict)
    for x in sequential.pack(df, "g", "k", "size", 200).collect():
        packed[x["g"]][x["k"]] = x["batch"]
    for x in sequential.slide_chunks(df, "g", "k", "text", 50, 5).collect():
        slides[x["g"]][x["k"]] = x["chunk"]
    for g in range(5):
        own = [t for a, _, t in rows if a == g]
        assert [packed[g][k] for k in range(40)] == chunking.packed([len(t) for t in own], 200)
        want = {k: c for c, ks in enumerate(chunking.slide_chunks(own, 50, 5)) for k in ks}
        assert slides[g] == want


def test_lines_go_column_by_column(spark):
    words = [(1, 1, 0.0, 10.0, 5.0, "a"), (1, 1, 12.0, 20.0, 6.0, "b"), (1, 1, 100.0, 110.0, 1.0, "right"), (1, 1, 0.0, 9.0, 9.5, "c"), (1, 1, 12.0, 20.0, 8.5, "d"), (2, 1, 3.0, 4.0, 1.0, "z")]
    got = tables.column_lines(spark.createDataFrame(words, "doc_id int, page int, x0 double, x1 double, top double, text string")).orderBy("doc_id", "page", "col", "line").collect()
    assert [(x["doc_id"], x["col"], x["line"], x["top"], x["text"]) for x in got] == [(1, 0, 0, 5.0, "a b"), (1, 0, 1, 8.5, "c d"), (1, 1, 0, 1.0, "right"), (2, 0, 0, 1.0, "z")]


# --- streams ---------------------------------------------------------------


def test_replays_and_failures_leave_tables_as_they_are(spark, tmp_path):
    routed, broken = RoutedWrites(spark, f"file://{tmp_path}/out"), [True]

    @routed.on("a", readable=F.col("v") > 0)
    def firsts(rows):
        return rows.select("id")

    @routed.on("b", "c")
    def others(rows):
        if broken[0]:
            raise RuntimeError("lost between two handlers")
        return rows.select("id", (F.col("v") * 2).alias("w"))

    rows = [(1, "a", 1), (2, "a", 0), (3, "b", 2), (4, "c", 3), (5, "x", 1), (6, None, 1), (7, "a", None)]
    batch = spark.createDataFrame(rows, "id int, event_type string, v int")
    with pytest.raises(RuntimeError):
        routed(batch, 0)
    assert routed.ledger.done(0, "firsts") and not routed.ledger.done(0, "others")
    broken[0] = False
    for _ in range(3):
        routed(batch, 0)
    routed(spark.createDataFrame([(8, "b", 1)], batch.schema), 1)
    routed(batch, 0)
    assert sorted(x["id"] for x in routed.table("firsts").collect()) == [1]
    assert sorted(tuple(x) for x in routed.table("others").collect()) == [(3, 4), (4, 6), (8, 2)]
    assert sorted(x["id"] for x in routed.table(DEAD).collect()) == [2, 5, 6, 7]


def test_barrier_reports_once_and_forgets(spark, tmp_path):
    ts = lambda s: (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)).to_pydatetime()
    batches = [
        [(1, 1, 2, ts(0)), (1, 1, 2, ts(1)), (2, 1, 3, ts(0)), (3, 9, 2, ts(0)), (3, 1, 2, ts(0))],
        [(1, 2, 2, ts(20)), (9, 1, 1, ts(30))],
        [(1, 2, 2, ts(40)), (9, 1, 1, ts(40)), (7, 1, 2, ts(300))],  # repeated parts of reported requests; event time passes the wait of 2 and 3
        [(2, 2, 3, ts(310)), (2, 3, 3, ts(310)), (7, 2, 2, ts(5000))],  # 2 has been reported and is remembered
        [(8, 1, 1, ts(9000))],
    ]
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "request_id long, idx long, total long, ts timestamp").coalesce(1).write.parquet(f"{source}/{k}")
        time.sleep(0.05)
    stream = spark.readStream.schema("request_id long, idx long, total long, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    query = barrier(stream, "75 seconds", "1 hour").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/marks").trigger(availableNow=True).start(str(out))
    query.awaitTermination()
    got = sorted(tuple(x) for x in spark.read.parquet(str(out)).collect())
    assert got == [(1, 2, 2, True), (2, 3, 1, False), (3, 2, 1, False), (7, 2, 2, True), (8, 1, 1, True), (9, 1, 1, True)]
    state = spark.read.format("statestore").option("stateVarName", "parts").load(f"{tmp_path}/marks")
    assert {r["key"]["request_id"] for r in state.select("key").distinct().collect()} <= {7, 8}  # the others' state is gone


# --- table function, sketches, archives -------------------------------------


def test_generated_recommendations_and_their_writer(spark):
    offers = spark.createDataFrame([(1, 10, 5, 2.0, 1.0, 30.0), (1, 11, 5, 3.0, 1.0, 30.0), (2, 12, 6, 1.0, 1.0, None)], "request long, project long, template long, offer_score double, similarity double, acceptance double")
    stored = spark.createDataFrame([(1, 10, 5, 2.0, 1.0, 7.0, "offerbased", "ACCEPTED"), (3, 10, 5, 2.0, 1.0, 7.0, "offerbased", "REJECTED"), (3, 9, 6, 2.0, 1.0, 8.0, "search", "ACCEPTED"), (2, 9, 6, 2.0, 1.0, 8.0, "offerbased", "GENERATED")], "request long, project long, template long, offer_score double, similarity double, acceptance double, method string, status string")
    name = generation.define(spark, offers, stored, "generated_for_test")
    requests = spark.createDataFrame([(1,), (2,), (4,)], "request int")
    got = generation.generate(requests, name)
    assert sorted(tuple(x)[1:6] + tuple(x)[6:] for x in got.collect()) == [(1, 11, 5, 3.0, 1.0, 30.0, "offerbased", "GENERATED"), (2, 12, 6, 1.0, 1.0, None, "offerbased", "GENERATED")]
    refined = {(x["request"], x["template"]): x["acceptance"] for x in generation.generate(spark.createDataFrame([(1,), (2,), (3,)], "request int"), name, F.lit(True)).collect()}
    assert refined == {(1, 5): 50.0, (3, 5): 50.0, (3, 6): 8.0, (2, 6): 8.0}
    assert [x["project"] for x in spark.sql(f"SELECT project FROM {name}(1)").collect()] == [11]
    after = generation.written(stored, requests, got).select("request", "project").collect()
    assert sorted(map(tuple, after)) == [(1, 11), (2, 12), (3, 9), (3, 10)]


def test_sketches_merge_within_their_bound(spark):
    r = random.Random(7)
    rows = [(k % 3, k % 40, r.lognormvariate(0, 2)) for k in range(60_000)]
    df = spark.createDataFrame(rows, "kind int, hour int, v double")
    ranks = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    stored = metrics.sketches(df, ["kind", "hour"], "v", k=400)
    for parts in (stored, stored.orderBy(F.col("hour").desc()).repartition(7)):
        for x in metrics.quantiles(metrics.merged(parts, ["kind"], k=400), ranks).collect():
            own = np.sort([v for k, _, v in rows if k == x["kind"]])
            assert (x["calls"], x["low"], x["high"]) == (len(own), own[0], own[-1])
            for name, rank in ranks.items():
                assert abs(np.searchsorted(own, x[name]) / len(own) - rank) < 0.02


def test_archives_by_member(spark, tmp_path):
    good = office.zipped({"a/one.txt": b"1" * 60, "two.xlsx": office.workbook({"S & T": [["x", None, "<y>"], []], "U": [["1"]]}), ".hidden": b"", "in.zip": b""})
    (tmp_path / "good.zip").write_bytes(good)
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    hurt = bytearray(good)
    hurt[39:44] = b"\0" * 5  # inside the first member's data
    (tmp_path / "hurt.zip").write_bytes(bytes(hurt))
    for part in (1, 1 << 20):
        got = {(x["archive"], x["path"]): (x["content"], x["supported"], x["error"]) for x in office.archives(spark, f"file://{tmp_path}", part_bytes=part).collect()}
        assert set(got) == {("good.zip", "a/one.txt"), ("good.zip", "two.xlsx"), ("hurt.zip", "a/one.txt"), ("hurt.zip", "two.xlsx"), ("bad.zip", None)}
        assert bytes(got["good.zip", "a/one.txt"][0]) == b"1" * 60 and got["good.zip", "two.xlsx"][1:] == (True, None)
        assert got["bad.zip", None][2] and got["hurt.zip", "a/one.txt"][2] and got["hurt.zip", "two.xlsx"][2] is None
    assert office.archives(spark, f"file://{tmp_path}/good.zip", content=False).filter("content is null").count() == 2
    cells = office.workbook_cells(office.archives(spark, f"file://{tmp_path}/good.zip").filter("path = 'two.xlsx'")).collect()
    assert sorted(tuple(x)[1:5] for x in cells) == [("S & T", 1, 1, "x"), ("S & T", 1, 3, "<y>"), ("U", 1, 1, "1")]
    assert [office.column_letters(n) for n in (1, 26, 27, 52, 703)] == ["A", "Z", "AA", "AZ", "AAA"]


def test_archives_are_written_and_read_in_parts(spark, tmp_path):
    rows = [(f"n{k % 3}.zip", f"b/{k}.txt", str(k).encode()) for k in range(900)] + [("n0.zip", ".hidden", b"")]
    root = f"file://{tmp_path}"
    assert office.write_archives(spark.createDataFrame(rows, "archive string, path string, content binary").repartition(5), root) == 901
    got = office.archives(spark, root, part_bytes=100).collect()
    assert sorted((x["archive"], x["path"], bytes(x["content"])) for x in got) == sorted(rows[:-1]) and not any(x["error"] for x in got)
    own = office.ArchiveReader(root, True, 100).partitions()
    assert len(own) > 20 and sum(p.n for p in own) == 901 and sum(p.length for p in own) < 901 * 70  # no entry is read by two tasks, and no name goes through the driver
    table = (tmp_path / "n1.zip").read_bytes()
    (tmp_path / "n1.zip").write_bytes(b"some program" + table)  # of an archive that unpacks itself
    (tmp_path / "n2.zip").write_bytes((tmp_path / "n2.zip").read_bytes().replace(b"PK\1\2", b"PK\1\3"))
    again = office.archives(spark, root, part_bytes=100).collect()
    assert sorted((x["archive"], x["path"], bytes(x["content"])) for x in again if not x["error"]) == sorted(r for r in rows[:-1] if r[0] != "n2.zip")
    assert [(x["archive"], x["path"]) for x in again if x["error"]] == [("n2.zip", None)]


def test_small_workbooks_share_a_frame(spark):
    book = office.workbook({"S": [["x", "y"], ["z"]]})
    frames = office.workbook_cells(spark.createDataFrame([(str(k), book) for k in range(200)], "path string, content binary").coalesce(1))
    got = [tuple(r) for r in frames.collect()]
    assert sorted(got) == sorted((str(k), "S", r, c, v, None) for k in range(200) for r, c, v in ((1, 1, "x"), (1, 2, "y"), (2, 1, "z")))
    many = spark.range(50).select(F.col("id").cast("string").alias("path"), office.sheet_book(F.array(F.array(F.lit("a"), F.lit(None).cast("string")), F.array(F.lit("<b>"))), "T", ["h"]).alias("content"))
    assert office.workbook_cells(many).groupBy("row", "col", "value").count().orderBy("row").collect() == [(1, 1, "h", 50), (2, 1, "a", 50), (3, 1, "<b>", 50)]


def test_lines_of_broken_pages():
    assert [x for _, x in documents.html_lines(b"<nav>no<p>no</nav>a<br>b<p>c &amp; d<nav> open")] == ["a", "b", "c & d open"]
    assert documents.html_lines(b"<script>x</script><aside>y<aside>z</aside>w") == [("body", "w")]
    for unit in (b"<a ", b'<p "', b"<nav>", b"<div></p>"):
        began = time.process_time()
        documents.html_lines(unit * (1_000_000 // len(unit)))
        assert time.process_time() - began < 8


def test_template_search_finds_what_all_pairs_find(spark):
    """Recall of the search by vectors against the exact comparison of all chunks with all templates."""
    from papyra.functions.embedding import hashed

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id")
    chunks = chunking.stored_chunks(docs, hashed)
    templates = chunks.filter("doc_id % 20 = 0")
    searched = {x["doc_id"]: x["template_id"] for x in chunking.search_templates(chunks, templates).collect()}
    exact = chunking.match_templates(chunks.drop("embedding"), templates.drop("embedding"), coverage=0.0).collect()
    strong = [x for x in exact if x["doc_id"] in searched]
    assert len(strong) >= 0.9 * len(searched) and Counter(searched[x["doc_id"]] == x["template_id"] for x in strong)[True] >= 0.9 * len(strong)


def test_positional_ratios_match_brute_force(spark):
    from papyra.functions.fuzzy import ratio_of
    from papyra.plans.catalogue import QUERIES

    of = defaultdict(list)
    for x in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect():
        of[x["conv_id"]].append(x["text"])
    got = {x["conv_id"]: (x["pairs"], x["mean"]) for x in QUERIES["positional_ratios"](spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == {c for c in of if c + 1 in of}
    for c, (pairs, mean) in got.items():
        want = [ratio_of(a, b) for a, b in zip(of[c], of[c + 1])]
        assert pairs == len(want) and abs(mean - sum(want) / len(want)) < 0.0051
