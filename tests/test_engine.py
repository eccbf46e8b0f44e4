"""The catalogue against its SQL, and the functions and operators that SQL does not reach."""

import glob
import io
import os
import zipfile

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyra.functions import fuzzy, scoring
from papyra.functions import text as tx
from papyra.operators import chunking, joins, relational, sensitive, tables
from papyra.plans import catalogue
from papyra.sources import documents as sources
from papyra.streaming import events as ev

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_its_sql(spark, duck, name):
    a, b = catalogue.QUERIES[name](spark, SF).toPandas(), duck.sql(catalogue.ORACLE_SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    left, right = (x[cols].astype(str).sort_values(cols).values.tolist() for x in (a, b))
    assert left == right


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_other_queries_have_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 50


# --- functions ---------------------------------------------------------------


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.text("abcé ", max_size=30), st.text("abcé ", max_size=30))
def test_lcs_and_ratio(a, b):
    assert fuzzy.lcs(a, b) == slow_lcs(a, b)
    assert fuzzy.ratio_of(a, a) == 100.0 and fuzzy.ratio_of(a, b) == fuzzy.ratio_of(b, a)
    assert 0 <= fuzzy.token_set_of(a, b) <= 100


def test_fuzzy_nulls():
    assert fuzzy.ratio_of(None, "a") is None and fuzzy.token_set_of("the cat sat", "cat the") == 100.0


def test_text_functions(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a|b| |a", "x [start]mid[end] y", None, "AB", "<a&\"b\">")], "p string, m string, n string, c string, h string")
    r = df.select(tx.pipe_list(F.col("p")).alias("p"), tx.between_marks(F.col("m"), "[start]", "[end]").alias("m"), tx.blank_to(F.col("n"), "d").alias("n"), tx.column_number(F.col("c")).alias("c"), tx.escape_html(F.col("h")).alias("h"), tx.concat_some("n", "c").alias("cc"), tx.one_space(F.lit(" a \n b\0 ")).alias("s")).first()
    assert r == (["a", "b"], "mid", "d", 28, "&lt;a&amp;&quot;b&quot;&gt;", "AB", "a b")


def test_scores(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(25.0,), (25.5,), (100.0,), (-1.0,), (None,)], "x double")
    got = df.select(scoring.relevance(F.col("x")).alias("a"), scoring.relevance(F.col("x"), True).alias("b"), scoring.right_closed(F.col("x"), [0, 25, 100], ["lo", "hi"]).alias("c"), scoring.similarity_level(F.col("x")).alias("d")).collect()
    assert [tuple(r) for r in got] == [("Very Low", "Very Low", "lo", "Low"), ("Low", None, "hi", "Low"), ("Very High", "Very High", "hi", "High"), (None, None, None, "Low"), (None, None, None, "Low")]


# --- relational --------------------------------------------------------------


def test_filters_raise_and_keep_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    with pytest.raises(ValueError):
        relational.scan(df, {"nope": 1})
    with pytest.raises(ValueError):
        relational.delete(df, {})
    with pytest.raises(ValueError):
        relational.update(df, {}, {"v": "x"})
    with pytest.raises(ValueError):
        relational.scan(df, limit=1)
    assert relational.scan(df, {"v": None}).collect()[0]["k"] == 2
    assert [r["k"] for r in relational.delete(df, {"v": "a"}).collect()] == [2]
    assert {r["k"]: r["v"] for r in relational.update(df, {"v": "a"}, {"v": "b"}).collect()} == {1: "b", 2: None}


def test_upsert_and_constant(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "c", 2), (2, "d", 4)], "k int, v string, at int")
    assert {r["k"]: r["v"] for r in relational.upsert(old, new, ["k"], "at").collect()} == {1: "c", 2: "b"}
    assert relational.with_constant(old, old.limit(0).select("v").withColumnRenamed("v", "w")).count() == 0


def test_fuzzy_pairs_miss_nothing(spark):
    import random

    r = random.Random(1)
    names = ["".join(r.choices("abc ", k=r.randint(0, 9))) for _ in range(60)]
    df = spark.createDataFrame([(n,) for n in names], "x string")

    def grams(s):
        return {p[i : i + 3] for w in s.split() for p in [f"  {w} "] for i in range(len(p) - 2)}

    for above in (0.0, 0.3, 0.75):
        want = {(a, b) for a in set(names) for b in set(names) if grams(a) and grams(b) and len(grams(a) & grams(b)) / len(grams(a) | grams(b)) > above}
        got = {(x["x"], x["y"]) for x in joins.fuzzy_pairs(df, df.withColumnRenamed("x", "y"), "x", "y", above).collect()}
        assert got == want


# --- sensitive text ------------------------------------------------------------


def test_redaction():
    text = "Mail Ann Lee or Ann; ann@x.org, not annex."
    out, log = sensitive.redact_one(text, [("Ann", "NAME"), ("Ann Lee", "NAME2"), ("ann@x.org", "EMAIL")])
    assert out == "Mail <NAME2> or <NAME>; <EMAIL>, not annex." and [x[0] for x in log] == ["Ann Lee", "Ann", "ann@x.org"]
    assert sensitive.redact_one(None, [("a", "b")]) == (None, []) and sensitive.redact_one("a", None) == ("a", [])
    assert sensitive.redact_one("it’s x", [("it's", "Q")])[0] == "<Q> x"


# --- chunks, tables, readers -----------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.text("ab \n", max_size=300), st.integers(5, 40))
def test_chunks_fit(text, size):
    for c in chunking.split_text(text, size, 3):
        assert 0 < len(c) <= size and c == c.strip()


def test_chunk_kinds():
    assert chunking.split_text("one two three four", 9, 4) == ["one two", "two three", "four"] or all(len(c) <= 9 for c in chunking.split_text("one two three four", 9, 4))
    assert chunking.heading_chunks("# A\nx\n## B\ny", 50, 0) == [("A", "x"), ("A > B", "y")]
    assert chunking.slide_chunks(["a b c d e f", "one", "g h i j k", "l m n o p q r"], 12) == [[0, 2], [3]]
    assert chunking.packed([5, 5, 1, 20, 1], 10) == [0, 0, 1, 2, 3]


def test_tables():
    assert tables.clusters_of([(1, 1), (1, 2), (9, 9), (9, 10), (2, 1)]) == [0, 0, 1, 1, 0] and tables.clusters_of([]) == []
    assert tables.records([["Name", ""], ["First", "Last"], ["a", "b"], ["c"]]) == [{"Name First": "a", "Name Last": "b"}, {"Name First": "c"}]
    assert tables.unique_names(["a", "a", "b", "a"]) == ["a", "a_dup_1", "b", "a_dup_2"]


def test_denoised_lines(spark):
    lines = ["one two three", "one two three", "x", " one two three ", "Page 3 of 4", "Copyright by us all", "four five six", "all is confidential", "a . ................ 3", "one two three"]
    kept = spark.createDataFrame([(lines,), ([],), (None,)], "l array<string>").select(tables.denoised_lines(F.col("l"))).collect()
    assert [r[0] for r in kept] == [["one two three", "four five six", "one two three"], [], None]


def test_sheet_operators(spark):
    cells = spark.createDataFrame([("s", 1, 1, "x"), ("s", 2, 2, "y")], "sheet string, row int, col int, value string")
    merged = spark.createDataFrame([("s", 1, 1, 1, 2)], "sheet string, row0 int, col0 int, row1 int, col1 int")
    assert sorted(tuple(r) for r in tables.spread_merged(cells, merged).collect()) == [("s", 1, 1, "x"), ("s", 1, 2, "x"), ("s", 2, 2, "y")]
    assert tables.full_grid(cells).count() == 4
    words = spark.createDataFrame([(1, 1, 5.0, 10.0, "b"), (1, 1, 1.0, 11.0, "a"), (1, 1, 1.0, 14.0, "c")], "doc_id long, page int, x0 double, top double, text string")
    assert [r["text"] for r in tables.word_lines(words).orderBy("line").collect()] == ["a b", "c"]
    sized = spark.createDataFrame([(1, k, n) for k, n in enumerate([5, 5, 1])], "g int, k int, n int")
    assert [r["batch"] for r in chunking.pack(sized, "g", "k", "n", 10).orderBy("k").collect()] == [0, 0, 1]


def zipped(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in files.items():
            z.writestr(n, t)
    return out.getvalue()


def test_readers(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="p"'
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    docx = zipped({"word/document.xml": f"<w:document {w}><w:p><w:t>Hello</w:t></w:p><w:tbl><w:tr><w:tc><w:p><w:t>a</w:t></w:p></w:tc><w:tc><w:p><w:t>b</w:t></w:p></w:tc></w:tr></w:tbl></w:document>", "word/footer1.xml": f"<w:ftr {w}><w:p><w:t>foot</w:t></w:p></w:ftr>"})
    pptx = zipped({"ppt/slides/slide1.xml": f'<p:sld {a}><p:sp><a:off x="1" y="900000"/><a:p><a:t>low</a:t></a:p></p:sp><p:sp><p:ph type="title"/><a:p><a:t>Title</a:t></a:p></p:sp></p:sld>'})
    xlsx = zipped({"xl/sharedStrings.xml": f"<sst {s}><si><t>shared</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {s}><cols><col min="3" max="3" hidden="1"/></cols><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="AB2"><v>5</v></c><c r="C1"><v>9</v></c></row></sheetData></worksheet>'})
    files = [("a.docx", docx), ("b.pptx", pptx), ("c.xlsx", xlsx), ("d.txt", b"x" * 60 + b"\n\n y "), ("e.txt", b"short"), ("f.bin", b"?"), ("g.html", b"<nav>no</nav><p>yes &amp; so</p>")]
    rows = sources.read_lines(spark.createDataFrame([(n, bytearray(d)) for n, d in files], "path string, content binary")).collect()
    got = {}
    for r in rows:
        got.setdefault(r["path"], []).append(r["text"] if r["error"] is None else "ERROR")
    assert got == {"a.docx": ["Hello", "a | b", "foot"], "b.pptx": ["Title", "low"], "c.xlsx": ["1,1: shared", "2,28: 5"], "d.txt": ["x" * 60, "y"], "e.txt": ["ERROR"], "f.bin": ["ERROR"], "g.html": ["yes & so"]}
    archive = zipped({"ok/a.txt": "1", "__MACOSX/a.txt": "2", ".hidden": "3", "in.zip": "4", "b.bin": "5"})
    members = sources.archive_members(spark.createDataFrame([("z.zip", bytearray(archive)), ("bad.zip", bytearray(b"no zip"))], "path string, content binary")).collect()
    assert [(r["archive"], r["path"], r["supported"], r["error"] is None) for r in members] == [("z.zip", "ok/a.txt", True, True), ("z.zip", "b.bin", False, True), ("bad.zip", None, False, False)]


def test_parts_of_office_files():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:p="p"'
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rels = lambda **k: "<Relationships>" + "".join(f'<Relationship Id="{i}" Target="{t}"/>' for i, t in k.items()) + "</Relationships>"
    docx = zipped({
        "word/document.xml": f'<w:document {w} {a.split()[0]}><w:p><w:t>One</w:t><a:blip r:embed="i1"/></w:p><w:altChunk r:id="c1"/><w:tbl><w:tr><w:tc><w:p><w:t>out</w:t></w:p><w:tbl><w:tr><w:tc><w:p><w:t>in</w:t></w:p></w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl><w:p><w:t>Two</w:t></w:p></w:document>',
        "word/_rels/document.xml.rels": rels(c1="part.html", i1="media/image1.png"), "word/part.html": "<p>from the web</p>",
    })
    assert sources.docx_lines(docx) == [("body", "One"), ("picture", "image1.png"), ("web", "from the web"), ("table", "out"), ("table", "in"), ("body", "Two")]
    table = "<p:graphicFrame><p:xfrm><a:off x='0' y='5000000'/></p:xfrm><a:tbl><a:tr><a:tc><a:p><a:t>k</a:t></a:p></a:tc><a:tc><a:p><a:t>v</a:t></a:p></a:tc></a:tr></a:tbl></p:graphicFrame>"
    group = "<p:grpSp><p:x><a:off x='0' y='900000'/><a:chOff x='0' y='0'/></p:x><p:sp><a:off x='0' y='0'/><a:p><a:t>inside</a:t></a:p></p:sp></p:grpSp>"
    pptx = zipped({
        "ppt/slides/slide1.xml": f"<p:sld {a}><p:cSld><p:spTree>{table}{group}<p:pic><a:off x='0' y='0'/><a:blip r:embed='i'/></p:pic></p:spTree></p:cSld></p:sld>",
        "ppt/slides/_rels/slide1.xml.rels": rels(i="../media/p.png", n="../notesSlides/notesSlide1.xml"), "ppt/notesSlides/notesSlide1.xml": f"<p:n {a}><p:sp><a:p><a:t>say this</a:t></a:p></p:sp></p:n>", "ppt/slides/slide2.xml": "<broken",
    })
    assert sources.pptx_lines(pptx) == [("slide 1", "[IMAGE: p.png]"), ("slide 1", "inside"), ("slide 1", "k | v"), ("notes 1", "say this"), ("slide 2 damaged", "ppt/slides/slide2.xml")]
    xlsx = zipped({
        "xl/workbook.xml": f'<workbook {s}><sheets><sheet name="Plan" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": rels(r1="worksheets/sheet1.xml"),
        "xl/styles.xml": f'<styleSheet {s}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row><c r="A1" t="inlineStr"><is><t>wide</t></is></c><c r="A2" s="1"><v>45292</v></c><c r="B2" s="2"><v>45292.5</v></c><c r="C2"><v>7</v></c></row></sheetData><mergeCells><mergeCell ref="A1:C1"/></mergeCells></worksheet>',
    })
    assert sources.xlsx_cells(xlsx) == [("Plan", 1, 1, "wide"), ("Plan", 1, 2, "wide"), ("Plan", 1, 3, "wide"), ("Plan", 2, 1, "2024-01-01"), ("Plan", 2, 2, "2024-01-01T12:00:00"), ("Plan", 2, 3, "7")]
    assert sources.markdown("a.xlsx", xlsx) == "## Plan\n\n| wide | wide | wide |\n| --- | --- | --- |\n| 2024-01-01 | 2024-01-01T12:00:00 | 7 |"
    page = b"<nav>no</nav><h2>Head</h2><p>Text &amp; more<ul><li>one</li><li>two</li></ul><table><tr><th>a</th><th>b</th></tr><tr><td>1|2</td></tr></table>"
    assert sources.markdown("p.html", page) == "## Head\n\nText & more\n\n- one\n\n- two\n\n| a | b |\n| --- | --- |\n| 1\\|2 |  |"
    assert sources.markdown("d.docx", docx).split("\n\n")[-2:] == ["| out |\n| --- |\n| in |", "Two"]


# --- streams -------------------------------------------------------------------


def test_envelope_and_stages(spark):
    from pyspark.sql import functions as F

    rows = ['{"header": {"eventType": "a"}, "payload": {"uuid": "1"}}', '{"header": {"eventType": "b"}, "payload": {"payload": {"uuid": "2"}}}', "bad"]
    got = spark.createDataFrame([(r,) for r in rows], "v string").select(ev.envelope(F.col("v"), "struct<uuid: string>").alias("e")).select("e.header.eventType", "e.payload.uuid").collect()
    assert [tuple(r) for r in got] == [("a", "1"), ("b", "2"), (None, None)]
    rule = {"download": True, "redaction": True, "upload": True, "grading": False}
    order = ["download", "redaction", "upload", "grading"]
    assert ev.enabled_stages(rule, {"download"}, order) == ["redaction", "upload"]
    assert ev.enabled_stages(rule, set(), order, sensitive=False) == ["download"]
    assert ev.enabled_stages(rule, set(), order, sensitive=False, converted=True) == ["download", "upload"]


def test_completeness_stream(spark, tmp_path):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    parts = [("r1", 1, 2, t), ("r1", 2, 2, t), ("r1", 2, 2, t), ("r2", 2, 2, t)]
    spark.createDataFrame(parts, "request_id string, idx int, total int, ts timestamp").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([("r3", 1, 1, t + dt.timedelta(hours=1))], "request_id string, idx int, total int, ts timestamp").write.mode("append").parquet(str(tmp_path / "a"))
    stream = spark.readStream.schema("request_id string, idx int, total int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "a"))
    q = ev.completeness(stream).writeStream.format("memory").queryName("done").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["request_id"], r["complete"]) for r in spark.table("done").collect()}
    assert ("r1", True) in got and ("r3", True) in got and ("r2", True) not in got


def test_router(spark):
    seen = {}
    router = ev.Router({"old": "a"})
    router.on("a")(lambda df: seen.update(a=df.count()))
    router.dead = lambda df: seen.update(dead=df.count())
    router(spark.createDataFrame([("a",), ("old",), ("z",), (None,)], "event_type string"), 0)
    assert seen == {"a": 2, "dead": 2}


def test_records(spark):
    from pyspark.sql import functions as F

    from papyra.functions import records as rec

    df = spark.createDataFrame([("{'a': 1, 'b': None}", ["Version", "Date"], ["x1", "22"]), ("no [", ["version", "9999"], [""])], "line string, h array<string>, g array<string>")
    got = df.select(rec.literal_map("line").alias("m"), rec.control_table(F.col("h"), ["version"]).alias("c"), rec.control_table(F.col("g"), ["version"]).alias("d")).collect()
    assert [tuple(r) for r in got] == [({"a": "1", "b": "None"}, True, False), (None, False, False)]
    times = spark.createDataFrame([("2024-01-02 03:04:05",), ("02/01/2024 03:04",), ("Jan 2, 2024",), ("never",)], "t string").select(rec.parsed_time(F.col("t")).cast("string").alias("t")).collect()
    assert [r["t"] for r in times] == ["2024-01-02 03:04:05", "2024-01-02 03:04:00", "2024-01-02 00:00:00", None]
    junk = spark.createDataFrame([("Recommendation engines compare documents thoroughly",), ("x~ || ## %% q zz ;; ::::::: ==",)], "t string").select(rec.junk_score(F.col("t")).alias("j")).collect()
    assert junk[0]["j"] < 0.5 < junk[1]["j"]


def test_templates_match_brute_force(spark):
    import random

    from papyra.functions.fuzzy import ratio_of
    from papyra.operators import chunking

    r = random.Random(4)
    word = lambda: "".join(r.choices("etaoinshrdlu", k=r.randint(3, 9)))
    texts = [" ".join(word() for _ in range(r.choice([3, 12, 60]))) for _ in range(40)]
    changed = [" ".join("x" + w[1:] if k % 3 == 0 else w for k, w in enumerate(t.split())) for t in texts[:20]]
    rows = [(k, 0, 1, t) for k, t in enumerate([*texts, *changed, " " + texts[3].upper(), None])]
    chunks = spark.createDataFrame(rows, "doc_id int, chunk_idx int, tot_chunks int, content string")
    best = {}
    for d, _, _, x in rows:
        for t, _, _, y in rows[:40:2]:
            v = ratio_of(x and x.strip(" ").lower(), y.strip(" ").lower())
            if v is not None and d != t and v >= 80:
                best[d] = min(best.get(d, (-v, t)), (-v, t))
    got = {x["doc_id"]: (-x["best"], x["template_id"]) for x in chunking.match_templates(chunks, chunks.filter("doc_id < 40 and doc_id % 2 = 0")).collect()}
    assert got == best and {40, 42, 44} <= set(best)


def test_near_hashes_match_brute_force(spark):
    import random

    from papyra.operators import joins

    r = random.Random(6)
    hashes = [r.getrandbits(63) for _ in range(30)]
    rows = [(r.choice("ab"), k, r.choice(hashes) ^ sum(1 << r.randrange(63) for _ in range(r.randint(0, 4)))) for k in range(300)] + [(None, 900, 1), ("a", 901, None)]
    got = joins.near_hashes(spark.createDataFrame(rows, "g string, k int, h long"), "g", "k", "h", 5).collect()
    far = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    want = {(g, a, b, far(x, y)) for g, a, x in rows[:300] for f, b, y in rows[:300] if g == f and a != b and far(x, y) < 5}
    assert {tuple(x) for x in got} == want and len(got) == len(want) > 300


def test_whole_tables_of_hashes_and_changes(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_orderstatus").collect()
    by = {}
    for key, status in orders:
        by.setdefault(status, []).append(key)
    far = lambda a, b: ((a % 1000 * 37) ^ (b % 1000 * 37)).bit_count()
    want = {(g, k, *min((far(k, o), o) for o in near)) for g, keys in by.items() for k in keys if (near := [o for o in keys if o < k and far(k, o) < 5])}
    assert {(r["grp"], r["key"], r["distance"], r["nearest"]) for r in catalogue.QUERIES["hamming_join"](spark, SF).collect()} == want
    assert catalogue.QUERIES["field_change_capture"](spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_template_search_matches_brute_force(spark):
    import random

    from papyra.functions.embedding import embedded, hashed
    from papyra.functions.fuzzy import ratio_of

    r = random.Random(5)
    word = lambda: "".join(r.choices("etaoinshrdlu", k=r.randint(3, 9)))
    base = [" ".join(word() for _ in range(40)) for _ in range(12)]
    rows = [(k, i, 2, base[(2 * k + i) % 12]) for k in range(6) for i in range(2)]
    rows += [(10 + k, i, 2, base[(2 * k + i) % 12].replace("e", "o", 3)) for k in range(6) for i in range(2)] + [(30, 0, 1, None), (31, 0, 1, "")]
    df = spark.createDataFrame(rows, "doc_id int, chunk_idx int, tot_chunks int, content string").withColumn("filename", F.concat(F.lit("f"), "doc_id", F.when(F.col("doc_id") == 2, ".pptx").otherwise(".docx"))).withColumn("embedding", hashed("content"))
    got = {x["doc_id"]: (x["template_id"], x["matches"], x["first_chunk"]) for x in chunking.search_templates(df, df.filter("doc_id < 6"), ending=".docx").collect()}
    want = {}
    cos = lambda x, y: sum(p * q for p, q in zip(embedded(x), embedded(y), strict=True))
    for d in {x[0] for x in rows}:
        hits = {}
        for _, i, _, x in (q for q in rows if q[0] == d and q[3]):
            near = sorted(((-cos(x, y), t, j, y) for t, j, _, y in rows if t < 6 and t != 2))[:5]
            ok = [(-ratio_of(x, y), t) for c, t, j, y in near if -c > 0.55 and t != d and ratio_of(x, y) >= 80]
            if ok:
                hits.setdefault(min(ok)[1], []).append(i)
        full = [(-len(v), t, min(v)) for t, v in hits.items() if len(v) / 2 * 100 >= 70]
        if full:
            want[d] = (min(full)[1], -min(full)[0], min(full)[2])
    assert got == want and set(want) == {10, 11, 13, 14, 15}


def test_vector_searches_leave_out_what_has_no_vector(spark):
    from papyra.operators import search

    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0]), (5, [-1.0, 0.0])]
    e = spark.createDataFrame(rows, "k int, embedding array<float>").repartition(3)
    many = {(r["query"], r["k"], r["rank"]) for r in search.top_k_many(e, e, 2, "k", "k", block=2).collect()}
    assert many == {(1, 1, 1), (1, 4, 2), (4, 4, 1), (4, 1, 2), (5, 5, 1), (5, 4, 2)}
    near = {(r["k"], r["o"], r["rank"]) for r in search.nearest_of(e, e.withColumnRenamed("k", "o"), 2, ["k"], "o", above=0.0, block=2).collect()}
    assert near == {(1, 1, 1), (1, 4, 2), (4, 4, 1), (4, 1, 2), (5, 5, 1)}
    assert search.top_k_many(e, e.limit(0), 2, "k", "k").count() == search.nearest_of(e, e.limit(0), 2, ["k"], "k").count() == 0


def test_best_choice_and_chunks_by_head(spark):
    from papyra.functions.fuzzy import token_set_of

    names = ["data storage", "storage of data", "cloud", "server care", None]
    rows, choices = spark.createDataFrame([(n,) for n in names], "x string"), ["data storage array", "care for a server", "cloud", "desktop"]
    got = {r["x"]: r["y"] for r in chunking.extract_one(rows, spark.createDataFrame([(c,) for c in choices], "y string"), "x", "y").collect()}
    assert got == {n: min((-token_set_of(n, c), c) for c in choices)[1] for n in names if n}
    docs = spark.createDataFrame([(1, "# A\none two\n## B\nthree"), (2, None), (3, "")], "doc_id long, text string")
    heads = chunking.chunk_by(docs, lambda t: chunking.heading_chunks(t, 100, 0)).collect()
    assert [(r["doc_id"], r["chunk_idx"], r["tot_chunks"], r["head"], r["content"]) for r in heads] == [(1, 0, 2, "A", "one two"), (1, 1, 2, "A > B", "three")]
    slides = spark.createDataFrame([("d", k, "w " * n) for k, n in enumerate([6, 3, 6, 20, 5])], "deck string, slide int, text string")
    assert [(r["slide"], r["chunk"]) for r in chunking.slide_groups(slides, "deck", "slide", "text", 12).orderBy("slide").collect()] == [(0, 0), (2, 0), (3, 1), (4, 2)]


def test_chunks_lose_nothing(spark):
    texts = ["para one\n\npara two\nline " + "x" * 300 + " end", "a b c " * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in chunking.chunk(docs, 50, 0).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "content"))).alias("c")).collect():
        assert "".join(x["content"] for x in r["c"]).replace(" ", "").replace("\n", "") == texts[r["doc_id"]].replace(" ", "").replace("\n", "")


def test_stored_tables_and_files(spark, tmp_path):
    from papyra.functions.embedding import hashed
    from papyra.sources import stores

    own = stores.Table(spark, f"file://{tmp_path}/t", "k int, v string")
    own.append(spark.createDataFrame([("1", "a"), ("2", "b")], "k string, v string"))
    with pytest.raises(ValueError):
        own.delete()
    own.delete(k=1)
    assert [tuple(r) for r in own.read().collect()] == [(2, "b")] and own.read(0).count() == 2
    own.append(spark.createDataFrame([("c", 3)], "v string, k int"))
    assert own.version() == 1 and sorted(r["k"] for r in own.read().collect()) == [2, 3]
    own.forget()
    assert own.files.list(f"file://{tmp_path}/t") == ["current", "v1"]
    store = stores.VectorStore(spark, f"file://{tmp_path}/v", hashed)
    store.add(spark.createDataFrame([("a", "red apple", {"d": "1"}), ("b", "green pear", {"d": "2"}), ("c", "red pear", {"d": "2"})], "id string, content string, metadata map<string,string>"))
    query = spark.createDataFrame([("red apple",)], "q string").select(hashed("q").alias("embedding"))
    assert [r["id"] for r in store.search(query, 1).collect()] == ["a"]
    assert store.search(query, 3, without=spark.createDataFrame([("a",)], "id string"), d=["2"]).count() == 2
    assert {r["d"]: r["chunks"] for r in store.counts("d").collect()} == {"1": 1, "2": 2}
    store.delete(d="2")
    store.delete(spark.createDataFrame([("zz",)], "id string"))
    assert [r["id"] for r in store.ids().collect()] == ["a"]
    with pytest.raises(ValueError):
        store.delete()
    files = stores.Files(spark)
    (tmp_path / "one.txt").write_text("é")
    files.upload(str(tmp_path / "one.txt"), f"file://{tmp_path}/f/two.txt")
    assert files.exists(f"file://{tmp_path}/f/two.txt") and "two.txt" in files.list(f"file://{tmp_path}/f") and files.text(f"file://{tmp_path}/f/two.txt") == "é"
    files.download(f"file://{tmp_path}/f/two.txt", str(tmp_path / "three.txt"))
    assert files.delete(f"file://{tmp_path}/f/two.txt") and not files.exists(f"file://{tmp_path}/f/two.txt") and (tmp_path / "three.txt").read_text() == "é"
    rows = spark.createDataFrame([("a", "1", True), ("b", "2", False)], "name string, val string, isactive boolean")
    assert stores.settings(rows, {"a": "0", "b": "0"}) == {"a": "1", "b": "0"}


def test_report_has_all_fields_quoted(spark, tmp_path):
    sources.write_report(spark.createDataFrame([(1, 'a "b", c'), (2, None)], "k int, v string").coalesce(1), str(tmp_path / "r"))
    (part,) = (tmp_path / "r").glob("part-*.csv")
    assert part.read_text().splitlines() == ['"k","v"', '"1","a \\"b\\", c"', '"2",""']


def test_nul_characters_go_from_nested_values(spark):
    df = spark.createDataFrame([(["a\0", None], {"k": "\0b"}, (1, "c\0c"))], "a array<string>, m map<string,string>, s struct<i: int, t: string>")
    got = df.select(*(tx.without_nul(F.col(f.name), f.dataType).alias(f.name) for f in df.schema)).first()
    assert got["a"] == ["a", None] and got["m"] == {"k": "b"} and tuple(got["s"]) == (1, "cc")


def test_masks_and_control_tables(spark):
    items = [("Ada", "NAME", 0.9), ("Ada L.", "FULL", 0.9), ("low", "NO", 0.5), ("", "NO", 1.0)]
    df = spark.createDataFrame([("ada l. and Ada low\nAda\nAdam", items), (None, items)], "t string, i array<struct<text: string, label: string, score: double>>")
    assert [r[0] for r in df.select(sensitive.mask(F.col("t"), F.col("i"))).collect()] == ["<FULL> and <NAME> low\nAdam".replace("<FULL> and", "<NAME> l. and"), None]


def test_redaction_in_one_pass_is_redaction_of_what_is_found(spark):
    texts = ["mail a.b@x.org or call +1 555 123 4567, Password: hunter2\nserver name: db-1 and db-1 again", None, "", "ip 10.0.0.1 999.1.1.1 Cookie: a=b; c", "nothing"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").union(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    two = sensitive.redact(docs, sensitive.detect(docs).select("doc_id", "text", "label")).select("doc_id", "redacted", F.size("redactions").alias("n"))
    one = sensitive.redact_patterns(docs).select("doc_id", "redacted", F.size("redactions").alias("n"))
    rows = lambda df: sorted((r["doc_id"], r["redacted"] or "", r["n"]) for r in df.collect() if r["doc_id"] > 4)
    assert rows(one) == rows(two)
    got = sensitive.redact_patterns(docs.limit(5)).orderBy("doc_id").collect()
    assert got[0]["redacted"] == "mail <EMAIL> or call <PHONE>, Password: <PASSWORD>\nserver name: <SERVER> and <SERVER> again" and got[3]["redacted"].startswith("ip <IP> ")


def test_messages_of_streams(spark, tmp_path):
    m = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "id string, v int").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    assert ev.once(m, ["id"], "ts", "1 hour").count() == 2
    text = spark.range(1).select(ev.failure(F.lit("r1"), "E1", "sorry", F.lit("trace")).alias("v")).first()["v"]
    assert '"error_code":"E1"' in text and '"requestId":"r1"' in text
    assert ev.in_seconds("75 seconds") == 75 and ev.in_seconds("1 hour") == 3600


def test_late_parts_do_not_report_twice(spark, tmp_path):
    import datetime as dt

    t, schema = dt.datetime(2024, 1, 1), "request_id string, idx int, total int, ts timestamp"
    later = lambda **k: t + dt.timedelta(**k)
    batches = [[("r1", 1, 2, t), ("r2", 1, 1, t)], [("x", 1, 1, later(minutes=10))], [("y", 1, 1, later(minutes=11))], [("r1", 2, 2, later(minutes=11)), ("r2", 1, 1, later(minutes=11))], [("z", 1, 1, later(hours=9))], [("z2", 1, 1, later(hours=9))]]
    src = tmp_path / "in"
    q = None
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        if q is None:
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
            q = ev.completeness(stream).writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
    q.stop()
    got = [(r["request_id"], r["complete"]) for r in spark.table("late").collect() if r["request_id"] in ("r1", "r2")]
    assert sorted(got) == [("r1", False), ("r2", True)]


def test_reasons_are_joined_whole(spark):
    from pyspark.sql import functions as F

    turns = spark.read.parquet(f"{SF}/conversations.parquet").filter("conv_id is not null").select("conv_id", "turn", F.concat("role", F.lit(": "), "text").alias("t")).collect()
    by = {}
    for x in turns:
        by.setdefault(x["conv_id"], []).append((x["turn"], x["t"]))
    got = {x["conv_id"]: x["joined"] for x in catalogue.QUERIES["reason_concat"](spark, SF).collect()}
    assert got == {k: " | ".join(t for _, t in sorted(v, key=lambda p: (p[0], p[1] or "")) if t is not None) for k, v in by.items()}
    assert any(len(t or "") > 60 for v in by.values() for _, t in v)
