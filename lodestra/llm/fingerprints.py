"""SimHash document fingerprints in DataFrame operations only.

A text's terms are its runs of five words (all its words, if fewer); a term's weight is how often it
occurs. Each term's two 64-bit hashes vote, with that weight, on 128 signed bits; the fingerprint is the
sign of each sum, as 32 hex digits. The votes are counted in packed lanes: sixteen masked sums a hash hold
four 16-bit counters each, and a text is counted in pieces of fewer terms than a lane can hold.

edited_fingerprints() needs each document's successor by doc_id. Equal rows collapse first, with their number, so
that no group of copies meets in one task. Keys without texts (id and text hash) are sorted into ranges, a window
inside each range finds neighbours, and one row a range carries over its ends. Then a text moves once, to its own key,
and of each text only the part that its predecessor's edit takes moves once more.

within() finds all fingerprints within a Hamming radius of given ones by permuted block tables: with
`blocks` blocks and at most `radius` wrong bits, blocks - radius blocks are right, so there is one table
for every choice of that many blocks, keyed by their bits. Pairs meet in the first table they share.

near_classes() covers edited copies: five-word terms at Jaccard similarity 0.8 differ in 19 bits on average
(deviation 4), so its radius is NEAR_RADIUS. No choice of blocks is selective at 28 of 128 bits; the asked
fingerprints, 16 bytes each, are broadcast and every fingerprint is compared with each of them.

Defined results: null texts count as empty; a text without words has the fingerprint 0. A null doc_id sorts
first. Rows with equal ids are ordered by the text's hash. In a table of one row the row follows itself. An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestra.llm.common import inner_id, outer_id, partitions, settled

TERM_WORDS, BITS, RADIUS, BLOCKS = 5, 128, 6, 8
NEAR_RADIUS = 28
_LANES, _PIECE = 16, 32_000
_SPACE = r"[\x20\x09-\x0D]+"


def with_terms(rows: DataFrame, keys: list[str], texts: dict[str, str]) -> DataFrame:
    """keys and, for each text, the array of its term hashes: one for every run of TERM_WORDS words, or one
    for all words, if they are fewer. The steps are columns of their own: an expression inside a lambda
    would be computed anew for every element."""
    words = rows.select(*keys, *(F.array_remove(F.split(F.col(t), _SPACE), "").alias(name) for name, t in texts.items()))
    hashed = words.select(*keys, *(F.transform(name, lambda w: F.xxhash64(w)).alias(name) for name in texts))
    return hashed.select(*keys, *(_terms(name).alias(name) for name in texts))


def _terms(hashes: str) -> Column:
    n = F.size(hashes)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(n - TERM_WORDS, F.lit(0))), lambda i: F.xxhash64(*[F.get(F.col(hashes), i + k) for k in range(TERM_WORDS)]))
    return F.when(n == 0, F.array().cast("array<bigint>")).when(n < TERM_WORDS, F.array(F.xxhash64(hashes))).otherwise(runs)


def _lanes() -> list[Column]:
    """The packed sums over the column __h and over a second hash of it."""
    mask = F.lit(sum(1 << (16 * j) for j in range(4)))
    both = [F.col("__h"), F.col("__g")]
    return [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(mask)) for h in both for i in range(_LANES)]


def _half(parts: str, n: str, half: int) -> Column:
    """64 signs from a list of packed sums: bit b is set if more than half the votes are for it."""
    return F.expr(f"""
        aggregate(sequence(0, 63), 0L, (bits, b) -> bits | if(
            2 * aggregate({parts}, 0L, (s, x) -> s + (shiftrightunsigned(element_at(x, {1 + _LANES * half} + b % {_LANES}), {_LANES} * (b div {_LANES})) & 65535L)) > {n},
            shiftleft(1L, b), 0L))""")


def _hex(high: str, low: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def fingerprint_rows(rows: DataFrame, keys: list[str], texts: dict[str, str]) -> DataFrame:
    """rows has `keys`, which tell rows apart and by whose first it is partitioned, and columns of text.
    texts names, for each column to make (two longs, <name>_1 and <name>_2), the column of text."""
    # inline() and a plain column keep the arrays themselves out of the rows that posexplode() makes.
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("__kind"), F.col(name).alias("__terms")) for k, name in enumerate(texts)]))
    kinds = with_terms(rows, keys, texts).select(*keys, each)
    terms = kinds.select(*keys, "__kind", F.posexplode_outer("__terms").alias("__at", "__h"))
    terms = terms.withColumn("__piece", F.floor(F.coalesce(F.col("__at"), F.lit(0)) / _PIECE)).withColumn("__g", F.xxhash64("__h", F.lit(1)))
    terms = terms.withColumn("__g", F.when(F.col("__h").isNotNull(), F.col("__g")))
    pieces = terms.groupBy(*keys, "__kind", "__piece").agg(F.count("__h").alias("__n"), *(c.alias(f"__s{i}") for i, c in enumerate(_lanes())))
    packed = F.array(*[F.coalesce(F.col(f"__s{i}"), F.lit(0)) for i in range(2 * _LANES)])
    whole = pieces.select(*keys, "__kind", "__n", packed.alias("__p")).groupBy(*keys).agg(
        *(x for k, name in enumerate(texts) for x in (F.collect_list(F.when(F.col("__kind") == k, F.col("__p"))).alias(f"__p_{name}"), F.sum(F.when(F.col("__kind") == k, F.col("__n")).otherwise(0)).alias(f"__n_{name}")))
    )
    return whole.select(*keys, *(_half(f"__p_{name}", f"__n_{name}", h).alias(f"{name}_{h + 1}") for name in texts for h in (0, 1)))


_KEY = ["__id", "__h1", "__h2"]


def neighbours(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """For each distinct key of rows(__id, __h1, __h2, __text): n (the text's length), copies, and the keys after and
    before it (after, before; the latter with its n) in the order of keys, the last one followed by the first."""
    light = rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("copies"), F.first(F.char_length("__text")).alias("n"))
    # Written, so that the ranges are the same for all their readers.
    ranges = settled(spark, light.repartitionByRange(partitions(spark), *_KEY).withColumn("__r", F.spark_partition_id()))
    inside = Window.partitionBy("__r").orderBy(*_KEY)
    key, sized = F.struct(*_KEY), F.struct(*_KEY, "n")
    ends = ranges.groupBy("__r").agg(F.min(key).alias("f"), F.max(sized).alias("l"))
    # One row a range: as many as the session has shuffle partitions.
    by, all_ = Window.orderBy("__r"), Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("__r", F.coalesce(F.lead("f").over(by), F.min("f").over(all_)).alias("f"), F.coalesce(F.lag("l").over(by), F.max("l").over(all_)).alias("l"))
    near = ranges.select("*", F.lead(key).over(inside).alias("x"), F.lag(sized).over(inside).alias("y")).join(ends, "__r")
    return near.select(*_KEY, "n", "copies", F.coalesce("x", "f").alias("after"), F.coalesce("y", "l").alias("before"))


def edited_texts(docs: DataFrame) -> DataFrame:
    """__id, __h1, __h2, own (the text), new (the edited text), n_chars, after (the next document's key), same (the next
    document is an equal row) and rows (how many rows this stands for)."""
    spark = docs.sparkSession
    rows = docs.select(inner_id().alias("__id"), F.coalesce("text", F.lit("")).alias("__text"))
    rows = rows.select("__id", F.xxhash64("__text").alias("__h1"), F.xxhash64(F.lit(1), "__text").alias("__h2"), "__text")
    texts = rows.groupBy(*_KEY).agg(F.first("__text").alias("own"))
    placed = texts.join(neighbours(spark, rows), _KEY)
    taken = placed.select(*(F.col(f"before.{k}").alias(k) for k in _KEY), F.substring("own", F.lit(1), F.floor(F.col("before.n") / 2).cast("int")).alias("taken"))
    half = F.floor(F.col("n") / 2).cast("int")
    kept = F.substring("own", F.lit(1), F.col("n") - half)
    kinds = F.array(F.struct(F.lit(False).alias("same"), F.lit(1).cast("long").alias("rows"), F.col("taken")))
    more = F.array(F.struct(F.lit(True).alias("same"), (F.col("copies") - 1).alias("rows"), F.substring("own", F.lit(1), half).alias("taken")))
    both = placed.join(taken, _KEY).withColumn("x", F.explode(F.when(F.col("copies") > 1, F.concat(kinds, more)).otherwise(kinds)))
    return both.select(*_KEY, "own", F.concat(kept, F.col("x.taken")).alias("new"), F.col("n").cast("long").alias("n_chars"), "after", "x.same", "x.rows")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next: the
    share of equal bits with the edited text's and with the next document's fingerprint."""
    spark = docs.sparkSession
    rows = edited_texts(docs).withColumn("edited_sha256", F.sha2("new", 256))
    after = [F.col(f"after.{k}").alias(f"next{k}") for k in _KEY]
    rows = rows.select(*_KEY, "same", "rows", "n_chars", "edited_sha256", *after, "own", "new")
    found = settled(spark, fingerprint_rows(rows, rows.columns[:-2], {"own": "own", "new": "new"}))
    others = found.where("not same").select(*(F.col(k).alias(f"next{k}") for k in _KEY), F.col("own_1").alias("next_1"), F.col("own_2").alias("next_2"))
    found = found.join(others, [f"next{k}" for k in _KEY])
    found = found.withColumns({f"next_{h}": F.when(F.col("same"), F.col(f"own_{h}")).otherwise(F.col(f"next_{h}")) for h in (1, 2)})
    found = found.withColumn("__turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))

    def like(other: str) -> Column:
        return 1 - sum(F.bit_count(F.col(f"own_{h}").bitwiseXOR(F.col(f"{other}_{h}"))) for h in (1, 2)) / F.lit(float(BITS))

    return found.select(
        outer_id("__id").alias("doc_id"), "n_chars", "edited_sha256", _hex("own_1", "own_2").alias("fingerprint"), _hex("new_1", "new_2").alias("edited_fingerprint"),
        like("new").alias("near_edited"), like("next").alias("near_next"),
    )


def _long(digits: str, at: int) -> Column:
    """Sixteen hex digits from place `at` on as a long."""
    part = [F.conv(F.substring(digits, at + 8 * i, 8), 16, 10).cast("long") for i in (0, 1)]
    return F.shiftleft(part[0], 32).bitwiseOR(part[1])


def _masks(blocks: int) -> list[tuple[int, int]]:
    """The bits of each block, in the high and in the low half, as signed longs."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    wide = [((1 << (BITS - a)) - 1) ^ ((1 << (BITS - b)) - 1) for a, b in zip(cuts, cuts[1:])]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [(signed(w >> 64), signed(w & (1 << 64) - 1)) for w in wide]


def within(queries: DataFrame, fingerprints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """query and fingerprint, both distinct strings of hex digits, and their distance, for every pair of
    different ones at most `radius` bits apart. Null fingerprints are in no pair. A table row is three longs:
    the two halves of a fingerprint and the hash of its right blocks, whose low bits name the table."""
    if not 0 <= radius < blocks:
        raise ValueError("there must be more blocks than wrong bits")
    masks = _masks(blocks)
    tables = list(combinations(range(blocks), blocks - radius))
    low = (1 << (len(tables) - 1).bit_length()) - 1

    def keyed(df: DataFrame, x: str, y: str, k: str) -> DataFrame:
        one = df.where(F.col("fingerprint").isNotNull()).select(_long("fingerprint", 1).alias(x), _long("fingerprint", 17).alias(y)).distinct()

        def key(t: int, chosen: tuple[int, ...]) -> Column:
            high_bits, low_bits = (sum(masks[i][h] for i in chosen) for h in (0, 1))
            return F.xxhash64(F.lit(t), F.col(x).bitwiseAND(F.lit(high_bits).cast("long")), F.col(y).bitwiseAND(F.lit(low_bits).cast("long"))).bitwiseAND(F.lit(~low)).bitwiseOR(F.lit(t))

        return one.select(x, y, F.explode(F.array(*[key(t, c) for t, c in enumerate(tables)])).alias(k))

    q, f = keyed(queries, "qx", "qy", "qk"), keyed(fingerprints, "fx", "fy", "fk")
    x, y = F.col("qx").bitwiseXOR(F.col("fx")), F.col("qy").bitwiseXOR(F.col("fy"))
    distance = F.bit_count(x) + F.bit_count(y)
    right = [(x.bitwiseAND(F.lit(h).cast("long")) == 0) & (y.bitwiseAND(F.lit(w).cast("long")) == 0) for h, w in masks]
    first = F.coalesce(*[F.when(_all([right[i] for i in c]), F.lit(t)) for t, c in enumerate(tables)])
    met = q.join(f, (F.col("qk") == F.col("fk")) & (distance > 0) & (distance <= radius) & (first == F.col("qk").bitwiseAND(F.lit(low))))
    return met.select(_hex("qx", "qy").alias("query"), _hex("fx", "fy").alias("fingerprint"), distance.alias("distance"))


def near_classes(queries: DataFrame, fingerprints: DataFrame, radius: int = NEAR_RADIUS) -> DataFrame:
    """query and near, for each distinct fingerprint of queries: the classes of equal fingerprints at most `radius`
    bits away as (distance, fingerprint, n_docs), the nearest first, its own included. The documents of a class are
    the rows with its fingerprint."""
    halves = lambda x, y: [_long("fingerprint", 1).alias(x), _long("fingerprint", 17).alias(y)]
    asked = queries.where(F.col("fingerprint").isNotNull()).select(*halves("qx", "qy")).distinct()
    classes = fingerprints.where(F.col("fingerprint").isNotNull()).groupBy(*halves("fx", "fy")).agg(F.count(F.lit(1)).alias("n_docs"))
    distance = F.bit_count(F.col("qx").bitwiseXOR(F.col("fx"))) + F.bit_count(F.col("qy").bitwiseXOR(F.col("fy")))
    met = classes.join(F.broadcast(asked), distance <= radius).select("qx", "qy", F.struct(distance.alias("distance"), _hex("fx", "fy").alias("fingerprint"), "n_docs").alias("x"))
    return met.groupBy("qx", "qy").agg(F.array_sort(F.collect_list("x")).alias("near")).select(_hex("qx", "qy").alias("query"), "near")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
