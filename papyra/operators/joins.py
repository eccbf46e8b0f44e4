"""Joins on likeness: trigrams, Hamming distance, containment and overlapping boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.functions.text import trigrams


def fuzzy_pairs(left: DataFrame, right: DataFrame, a: str, b: str, above: float) -> DataFrame:
    """(a, b, similarity): pairs of distinct texts with a trigram similarity above the bound (0 or more), without comparing all pairs.

    Two texts above it share a trigram in the prefixes of both, the first ones in the order of their
    hashes, as many as can be missing from the other text and one more; those are joined on equality,
    and the candidates are then compared in full.
    """

    def side(df: DataFrame, c: str, name: str) -> DataFrame:
        grams = df.select(F.col(c).alias(name)).filter(F.col(name).isNotNull()).distinct().withColumn(f"g_{name}", F.array_sort(F.transform(trigrams(F.col(name)), lambda g: F.xxhash64(g))))
        n = F.size(f"g_{name}")
        return grams.withColumn(f"p_{name}", F.slice(f"g_{name}", F.lit(1), F.greatest(F.lit(0), (n - F.ceil(n * above) + 1).cast("int"))))

    x, y = side(left, a, "a"), side(right, b, "b")
    found = x.select("a", F.explode("p_a").alias("g")).join(y.select("b", F.explode("p_b").alias("g")), "g").select("a", "b").distinct()
    both = found.join(x.select("a", "g_a"), "a").join(y.select("b", "g_b"), "b")
    shared = F.size(F.array_intersect("g_a", "g_b"))
    return both.select(F.col("a").alias(a), F.col("b").alias(b), (shared / (F.size("g_a") + F.size("g_b") - shared)).alias("similarity")).filter(F.col("similarity") > above)


def varying_blocks(df: DataFrame, hash_: str, count: int) -> list[list[int]]:
    """The bits of a 64-bit hash that are not the same in all rows, dealt into ``count`` blocks, the most even ones first."""
    n, *ones = df.agg(F.count(hash_), *(F.sum(F.getbit(hash_, F.lit(b))) for b in range(64))).first()
    bits = sorted((b for b in range(64) if ones[b] and ones[b] < n), key=lambda b: (abs(2 * ones[b] - n), b))
    return [bits[k::count] for k in range(count)]


def near_hashes(df: DataFrame, by: str, key: str, hash_: str, within: int) -> DataFrame:
    """(key, other, distance): for each row, pairs in its group with hashes that differ in fewer than ``within`` bits.

    The bits that vary in the table are dealt into ``within`` blocks; hashes that differ in fewer bits agree in one of them. Bits that
    are the same everywhere are in no block, as they would make all pairs meet. Blocks meet on the distinct hashes of a group, so
    rows with equal hashes cost no comparisons.
    """
    rows = df.select(by, key, hash_).distinct()
    value = lambda bits: sum((F.shiftleft(F.getbit(hash_, F.lit(b)).cast("long"), i) for i, b in enumerate(bits)), F.lit(0).cast("long"))
    blocks = F.array(*(F.struct(F.lit(k).alias("k"), value(bits).alias("v")) for k, bits in enumerate(varying_blocks(rows, hash_, within))))
    points = rows.select(by, hash_).distinct().select(by, F.col(hash_).alias("x"), F.explode(blocks).alias("block"))
    distance = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
    near = points.join(points.withColumnRenamed("x", "y"), [by, "block"]).filter(distance < within).select(by, "x", "y", distance.alias("distance")).distinct()
    a, b = (rows.select(by, F.col(key).alias(k), F.col(hash_).alias(h)) for k, h in (("key", "x"), ("other", "y")))
    return a.join(near, [by, "x"]).join(b, [by, "y"]).filter("key <> other").select(by, "key", "other", "distance").distinct()


def nearest_earlier(df: DataFrame, by: str, key: str, hash_: str, within: int) -> DataFrame:
    """(by, key, nearest, distance): for each row the row of its group with a smaller key whose hash differs in the fewest bits, fewer than ``within``.

    Rows with one hash stand for it by their smallest key, so a row meets the near hashes of its group and not
    their rows; of equally near ones the smallest key counts. Rows without one are left out.
    """
    firsts = df.groupBy(by, hash_).agg(F.min(key).alias("least"))
    near = near_hashes(firsts, by, "least", hash_, within).select(by, F.col("key").alias("least"), F.col("other").alias("nearest"), "distance")
    own = firsts.select(by, "least", F.col("least").alias("nearest"), F.lit(0).alias("distance"))
    rows = df.select(by, key, hash_).distinct().join(firsts, [by, hash_]).select(by, key, "least")
    met = rows.join(near.unionByName(own), [by, "least"]).filter(F.col("nearest") < F.col(key))
    best = met.groupBy(by, key).agg(F.min(F.struct("distance", "nearest")).alias("x"))
    return best.select(by, key, "x.nearest", "x.distance")


def containing(words: DataFrame, texts: DataFrame, word: str, text: str) -> DataFrame:
    """Words that contain a text, case and all: rows of words beside the rows of texts, found by one automaton over all texts."""
    from papyra.operators.dictionary import mentions

    held = words.select(F.col(word).alias("__word")).distinct()
    found = mentions(held.select("__word", F.col("__word").alias("__text")), texts, "__word", "__text", text, fold=False, bounded=False).select("__word", "item")
    return words.join(found, F.col(word) == F.col("__word")).join(texts, F.col("item") == F.col(text)).drop("__word", "item")


def outside_boxes(lines: DataFrame, boxes: DataFrame, share: float = 0.25, on: tuple[str, ...] = ("doc_id", "page"), band: float = 64.0) -> DataFrame:
    """Lines of which less than ``share`` of the area lies under any box of their page; columns x0, top, x1, bottom.

    Lines and boxes of a page meet in the bands of ``band`` height that both reach into, so a page of many lines and boxes is no
    single group and its pairs are those of one height. Lines in the same place are looked at once.
    """
    place = [*on, "x0", "top", "x1", "bottom"]
    bands = lambda df: df.withColumn("__band", F.explode(F.sequence(F.floor(F.least("top", "bottom") / band), F.floor(F.greatest("top", "bottom") / band))))
    own = bands(lines.select(*place).dropna().distinct())
    other = bands(boxes.select(*on, *(F.col(c).alias(f"b_{c}") for c in place[-4:])).withColumnsRenamed({"b_top": "top", "b_bottom": "bottom"})).withColumnsRenamed({"top": "b_top", "bottom": "b_bottom"})
    side = lambda low, high: F.greatest(F.lit(0.0), F.least(F.col(high), F.col(f"b_{high}")) - F.greatest(F.col(low), F.col(f"b_{low}")))
    area = (F.col("x1") - F.col("x0")) * (F.col("bottom") - F.col("top"))
    under = F.try_divide(side("x0", "x1") * side("top", "bottom"), area) >= share
    covered = own.join(other, [*on, "__band"]).filter(under).select(*place).distinct()
    return lines.join(covered, place, "left_anti").select(*lines.columns)
