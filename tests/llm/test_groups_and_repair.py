"""Conversation repair, centroid clustering and SetSketch near-duplicates against brute force."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict
from functools import cache

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.llm import centroids, conversation_repair as repair, queries, set_sketch

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_centroids", "op13_set_sketch"])
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE_SQL[name])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


# --- 11 --------------------------------------------------------------------


def said(edits: str, codes) -> list[set[int]] | None:
    """The states that the edits can end in, and their cost, by following all of them."""
    states, at, cost = {0}, 0, 0
    for letter in edits:
        code = None if letter == "I" else codes[at]
        new = set()
        for s in states:
            to = {2} if s != 2 else {3}
            if letter == "D":
                new.add(s)
            elif letter == "I" or (letter == "R" and code // 4 != 1):
                new |= to
            elif letter == "K" and code // 4 != 1:
                new |= to & {code % 4} | ({1} if s == 0 and code % 4 == 1 else set())
        states = new
        cost += {"I": 5, "D": 2, "R": 1, "K": 0}[letter] + (5 if letter in "KR" and code // 4 == 2 else 0)
        at += letter != "I"
    return cost if states & {0, 3} and at == len(codes) else None


def test_edits_are_the_cheapest_and_least_of_all():
    every = [(e, e.count("I")) for n in range(7) for e in map("".join, itertools.product("DIKR", repeat=n)) if e.count("I") <= 2]
    by_reads = defaultdict(list)
    for e, inserts in every:
        by_reads[len(e) - inserts].append(e)
    r = random.Random(1)
    for n in range(4):
        some = list(itertools.product(range(12), repeat=n))
        for codes in some if n < 3 else r.sample(some, 150):
            want = min((c, e) for e in by_reads[n] if (c := said(e, codes)) is not None)
            assert repair.cheapest(bytes(codes)) == want, codes


@cache
def recursion(codes: tuple, state: int, inserts: int = 3) -> tuple:
    """(cost, edits) from the front, letter by letter."""
    out = [(0, "")] if not codes and state in (0, 3) else []
    to = 3 if state == 2 else 2

    def put(letter, cost, rest):
        if rest:
            out.append((cost + rest[0], letter + rest[1]))

    if inserts:
        put("I", 5, recursion(codes, to, inserts - 1))
    if codes:
        fault, initial = divmod(codes[0], 4)
        put("D", 2, recursion(codes[1:], state))
        if fault != 1:
            extra = 5 if fault == 2 else 0
            put("R", 1 + extra, recursion(codes[1:], to))
            if initial == to or (state == 0 and initial == 1):
                put("K", extra, recursion(codes[1:], initial))
    return min(out, default=())


def brute(rows: list[tuple]) -> tuple:
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) of (turn, role, text) in order."""
    space = " \t\n\x0b\x0c\r"
    counts, codes, seen = [0, 0, 0], [], set()
    initials = [r[1][:1] for r in rows]
    for _, role, text in rows:
        kind = 0 if not text.strip(space) else 1 if (role, text) in seen else 2 if text.rstrip(space)[-1] not in ".!?" else None
        seen.add((role, text))
        if kind is not None:
            counts[kind] += 1
        codes.append("sua".find(role[:1] or "x") + 1 + 4 * {None: 0, 0: 1, 1: 1, 2: 2}[kind])
    for k in range(len(codes), 0, -20):  # from the end, so that the recursion stays shallow
        for state in range(4):
            recursion(tuple(codes[k:]), state)
    cost, audit = recursion(tuple(codes), 0)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    out, own, first = [], iter(rows), 0
    for letter in audit:
        _, role, text = (None, "", "") if letter == "I" else next(own)
        if letter == "D":
            continue
        if letter == "K" and not out and role[:1] == "s":
            first = 1
        if letter != "K":
            role = ("user", "assistant")[(len(out) - first) % 2]
        out.append(f"{role}:{text}")
    return gaps, *counts, sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


@pytest.mark.parametrize("most", [(repair.ROWS, repair.BYTES), (3, repair.BYTES), (1, 10), (7, 25)])
def test_repair_over_tasks_and_segments(spark, most):
    r = random.Random(2)
    texts = ["Yes.", "No!", "  ", "", "cut", "Why? ", "Yes.", "\x1c", "é.\n", None]
    rows = []
    for conv in [*range(40), None]:
        for turn in range(r.choice([0, 1, 2, 5, 9, 30])):
            rows.append((conv, None if r.random() < 0.05 else turn + 3 * (r.random() < 0.1), r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), r.choice(texts) if r.random() < 0.5 else f"text {r.random()}.", r.random() > 0.05, "clash"))
    rows += [(99, 1, "user", "dropped", False, "x"), (7, 2, "user", "again.", True, "x"), (7, 2, "user", "again.", True, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, live boolean, code string").repartition(5)
    got = {x["conv_id"]: tuple(x)[1:] for x in repair.repair(df, F.col("live"), *most).collect()}
    own = defaultdict(list)
    for conv, turn, role, text, live, _ in rows:
        own[conv] += [(turn, " " if role is None else role, " " if text is None else text)] if live else []
    assert got.keys() == own.keys()
    for conv, held in own.items():
        held.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2][:40], hashlib.sha256(x[2].encode()).hexdigest()))
        assert got[conv] == brute(held), (conv, held)


def test_one_long_conversation_over_many_tasks(spark):
    r = random.Random(4)
    rows = [(1, t, r.choice(["user", "assistant"]), r.choice(["same.", f"t{t}.", f"t{t}", " "])) for t in range(600)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(6)
    (got,) = repair.repair(df, most_rows=50).collect()
    assert tuple(got)[1:] == brute([x[1:] for x in rows])


def test_damage_and_empty_tables(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(30) for t in range(6)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = defaultdict(int)
    for c, t, role, text in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", " " if text is None else text
        new = (c, t, "user" if h == 4 else role, "" if h == 1 else text.translate({46: None, 33: None, 63: None}) if h == 2 else text)
        want[new] += 0 if h == 0 else 2 if h == 3 else 1
    got = defaultdict(int)
    for x in repair.damaged(df).collect():
        if x["live"]:
            got[tuple(x)[:4]] += 1
    assert got == {k: n for k, n in want.items() if n}
    assert repair.repair(df.limit(0)).collect() == []
    (gone,) = repair.repair(df.limit(1), F.lit(False)).collect()
    assert tuple(gone)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# --- 12 --------------------------------------------------------------------


def lloyd(vectors: list[tuple], k: int, rounds: int) -> dict:
    kept = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v.tolist()) for i, v in kept if i is not None)[:k]
    c = np.array([v for _, v in first])
    points = np.array([v for _, v in kept])
    for n in range(rounds + 1):
        d = np.square(points[:, None, :] - c[None]).sum(axis=2)
        own = d.argmin(axis=1)
        if n < rounds:
            c = np.array([points[own == j].sum(axis=0) // (own == j).sum() if (own == j).any() else c[j] for j in range(len(c))])
    near = d.min(axis=1)
    return sorted(((i, int(j), int(x), int(near[own == j].sum()), int(near.sum()), hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest()) for (i, _), j, x in zip(kept, own, near)), key=str)


@pytest.mark.parametrize("block", [centroids.BLOCK, 37])
def test_clusters_match_all_distances(spark, block):
    r = np.random.default_rng(5)
    middles = r.normal(0, 1, (12, 64))
    rows = [(k, (middles[k % 12] + r.normal(0, 0.2, 64)).tolist()) for k in range(700)]
    rows += [(2000 + k, [0.25] * 64) for k in range(300)]  # one very common vector
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1])]  # repeats, and a vector without an id
    rows += [(3000, None), (3001, []), (3002, [0.0] * 63), (3003, [float("nan")] * 64), (3004, [0.0] * 63 + [None]), (3005, [float("inf")] + [0.0] * 63), (3006, [-20000.0] * 64)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "vec_id long, embedding array<double>, cluster string").repartition(3)
    got = sorted((tuple(x) for x in centroids.cluster(df, block=block).collect()), key=str)
    assert got == lloyd(rows, centroids.K, centroids.ROUNDS)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(k, [float(k % 3)] * 64) for k in range(7)], "vec_id int, embedding array<float>")
    assert sorted((tuple(x) for x in centroids.cluster(df).collect()), key=str) == lloyd([(k, [float(k % 3)] * 64) for k in range(7)], 40, 5)
    assert centroids.cluster(df.limit(0)).collect() == []
    assert centroids.cluster(df.withColumn("embedding", F.lit(None).cast("array<float>"))).collect() == []
    assert centroids.cluster(df.limit(0)).columns == centroids.cluster(df).columns


def test_whole_nodes_are_assigned_and_ties_go_to_the_smaller_number():
    r = np.random.default_rng(6)
    points = np.concatenate([r.integers(-8, 9, (3000, 64)) + 1000 * r.integers(0, 5, (3000, 1)), np.zeros((200, 64), int)])
    c = np.concatenate([np.arange(5)[:, None] * 1000 + np.zeros((5, 64), int), np.full((1, 64), 500), np.full((1, 64), 1000)])
    tree = centroids.Tree.unpack(centroids.Tree.of(points).pack(), 64)
    kinds, got = set(), np.full(len(points), -1)
    for node, a, b, nearest in tree.assign(c):
        kinds.add((node >= 0, b - a > centroids.LEAF))
        got[a:b] = nearest
    assert (True, True) in kinds  # nodes above a leaf went whole
    assert (got == np.square(tree.points[:, None] - c[None]).sum(axis=2).argmin(axis=1)).all()
    assert 6 not in got  # equal to centroid 1
    big = r.integers(-centroids.LIMIT, centroids.LIMIT, (50, 64))
    assert (centroids.distances(big, big[:9]) == np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in big[:9]] for x in big])).all()


# --- 13 --------------------------------------------------------------------


def words(text) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(text, size=2) -> set:
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def jaccard_components(rows) -> dict:
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return {(k, i): (len(sets[i]), least.get(find(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)}


def variants(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("etaoinsh", k=5)) for _ in range(600)]
    out = []
    for _ in range(n):
        base = r.choices(vocabulary, k=r.choice([12, 40, 150]))
        for _ in range(r.choice([1, 3, 8])):
            own = list(base)
            for _ in range(r.choice([0, 1, 2, len(base) // 18, len(base) // 11])):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("tile", [1 << 20, 2000])
def test_set_sketch_groups(spark, monkeypatch, tile):
    monkeypatch.setattr(set_sketch.forest, "TILE_BYTES", tile)
    texts = [*variants(1, 60), None, "", " \n ", "one", "One", "two words", "two  WORDS", "a b a b a b", "b a b a", "x" * 5000, "x" * 5000, " ".join(f"w{k}" for k in range(9000)), " ".join(f"w{k}" for k in range(8500))]
    rows = [(k * 2, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(*x, "clash", "clash") for x in rows] + [(None, texts[0], "c", "c")], "doc_id long, text string, label string, node string").repartition(4)
    got = {x["doc_id"]: (x["n_shingles"], x["component"]) for x in set_sketch.groups(df).collect()}
    want = {k: v for (k, _), v in jaccard_components([*rows, (None, texts[0])]).items()}
    assert got == want
    assert set_sketch.groups(df.limit(0)).collect() == []


def test_set_sketch_with_borderline_members(spark):
    """One large group whose members are all close to the threshold: no member is lost, none added."""
    r = random.Random(8)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for k in range(250):
        own = list(base)
        for _ in range(r.randint(2, 4)):
            own[r.randrange(60)] = f"n{r.randrange(10_000)}"
        rows.append((k, " ".join(own)))
    got = {x["doc_id"]: (x["n_shingles"], x["component"]) for x in set_sketch.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: v for (k, _), v in jaccard_components(rows).items()}


def test_registers_merge_and_tell_the_similarity():
    r = np.random.default_rng(3)
    one, two = r.integers(0, 1 << 63, 4000, dtype=np.uint64), r.integers(0, 1 << 63, 1000, dtype=np.uint64)
    sketch = lambda x: set_sketch.registers(np.unique(x), np.zeros(1, np.int64))[0]
    assert (set_sketch.merged(sketch(one), sketch(two)) == sketch(np.concatenate([one, two]))).all()
    assert sketch(one).min() > 0 and sketch(one).max() < set_sketch.TOP
    a, b = sketch(one), sketch(np.concatenate([one[:3600], two[:400]]))  # similarity 3600 / 4400
    more, less = np.array([(a > b).sum()]), np.array([(a < b).sum()])
    half = np.array([0.5])
    at = [set_sketch.rises(more, less, set_sketch.REGISTERS - more - less, half, half, x)[0] for x in (0.5, 0.7, 0.93)]
    assert at == [True, True, False]
