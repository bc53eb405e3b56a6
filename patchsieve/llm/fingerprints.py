"""Order MinHash fingerprints: signatures that follow edit distance, in DataFrame functions only.

A text's tokens (runs without white space, cut at 12 code points, so that unspaced scripts have tokens
too) give k-mers of three tokens; the k-mer's occurrences are numbered. Every numbered k-mer is hashed
once; the upper bits of the hash choose one of 64 orders (one permutation, cut into bins, stands for
independent permutations). Each order keeps its two least k-mers, puts them back into text order and
hashes the pair; an order with fewer takes what it lacks from the next order that has k-mers. Texts that share k-mers in another order share no pair, unlike with plain MinHash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patchsieve.llm.common import let, written

K, ORDER_BITS = 3, 6
TOKEN = r"[^\x20\x09-\x0D]{1,12}"
LEAST_KEY = -(1 << 63)


def with_signature(df: DataFrame, text: str, out: str) -> DataFrame:
    """`df` with an array of longs: for every order, order << 32 | hash of its pair.

    A text of one k-mer has that k-mer in its order only, a text without tokens has none.

    The steps are columns of their own, each used more than once by the next, so that Spark computes
    each once; long arrays are sorted in generated code.
    """
    kept = [c for c in df.columns if c != out]
    step = df.withColumn("om_t", F.transform(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t)))
    n = F.coalesce(F.size("om_t"), F.lit(0))
    kmers = F.when(n >= K, F.transform(
        F.sequence(F.lit(0), F.greatest(n - K, F.lit(0))), lambda i: F.xxhash64(*(F.get("om_t", i + j) for j in range(K))))
    ).when(n > 0, F.array(F.xxhash64("om_t"))).otherwise(F.array().cast("array<bigint>"))
    step = step.select(*kept, F.coalesce(kmers, F.array().cast("array<bigint>")).alias("om_h"))
    # the lower bits of a packed long hold a k-mer's place, as many as the text needs
    bits = F.coalesce(F.length(F.bin(F.size("om_h").cast("long"))), F.lit(1))
    step = step.withColumn("om_m", F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)
    step = step.withColumn("om_n", F.bitwise_not("om_m"))

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.col("om_m")).cast("int")

    def pack(h: Column, place: Column) -> Column:
        return h.bitwiseAND(F.col("om_n")).bitwiseOR(place)

    def order(x: Column) -> Column:
        return F.shiftright(x, 64 - ORDER_BITS)

    size = F.size("om_h")
    step = step.withColumn("om_s", F.sort_array(F.transform("om_h", lambda h, i: pack(h, i.cast("long")))))
    # occurrence numbers, run by run of equal k-mers; most texts repeat none
    same = lambda i: F.get("om_s", i).bitwiseAND(F.col("om_n")) == F.get("om_s", i - 1).bitwiseAND(F.col("om_n"))
    repeats = F.size(F.array_distinct("om_h")) < size
    empty = F.array().cast("array<int>")
    step = step.withColumn("om_f", F.when(repeats, F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | ~same(i))).otherwise(empty))
    number = F.flatten(F.transform("om_f", lambda s, j: F.sequence(F.lit(0), F.coalesce(F.get("om_f", j + 1), size) - s - 1)))
    step = step.withColumn("om_o", F.when(F.size("om_f") > 0, number).otherwise(empty))
    hashed = lambda x, n: pack(F.xxhash64(F.get("om_h", place(x)), n), x.bitwiseAND(F.col("om_m")))
    step = step.withColumn("om_q", F.sort_array(F.when(
        F.size("om_o") > 0, F.transform("om_s", lambda x, i: hashed(x, F.coalesce(F.get("om_o", i), F.lit(0))))
    ).otherwise(F.transform("om_s", lambda x: hashed(x, F.lit(0))))))

    # where the order changes stands its least k-mer; an order starts there or, if it has none, where the next one
    # does, and the last orders at the first again
    filled = F.size("om_q")
    step = step.withColumn("om_g", F.when(filled > 1, F.filter(
        F.sequence(F.lit(0), filled - 1), lambda i: (i == 0) | (order(F.get("om_q", i)) != order(F.get("om_q", i - 1))))).otherwise(empty))
    at = lambda j: order(F.get("om_q", F.get("om_g", j))).cast("int")
    half = 1 << ORDER_BITS - 1
    starts = F.flatten(F.transform("om_g", lambda g, j: F.array_repeat(g, at(j) - F.when(j > 0, at(j - 1)).otherwise(-half - 1))))
    step = step.withColumn("om_b", F.when(filled > 1, F.concat(
        starts, F.array_repeat(F.lit(0), half - 1 - at(F.size("om_g") - 1)))).otherwise(empty))

    def entry(order: Column, hashed: Column) -> Column:
        return F.shiftleft(order.cast("long"), 32).bitwiseOR(hashed.bitwiseAND(F.lit((1 << 32) - 1)))

    def pair(one: Column, two: Column) -> Column:
        a, b = place(one), place(two)
        return F.xxhash64(F.get("om_h", F.least(a, b)), F.get("om_h", F.greatest(a, b)))

    pairs = F.transform("om_b", lambda i, k: entry(k, pair(F.get("om_q", i), F.get("om_q", F.when(i + 1 < filled, i + 1).otherwise(0)))))
    only = F.get("om_q", F.lit(0))
    entries = F.when(filled > 1, pairs).when(filled == 1, F.array(entry(order(only) + half, F.xxhash64(F.get("om_h", place(only)))))).otherwise(
        F.array().cast("array<bigint>"))
    return step.select(*kept, entries.alias(out))


def signature_text(signature: Column) -> Column:
    """Ten hexadecimal digits for each order."""
    return F.concat_ws("", F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal orders among those that either text has; 1 for two texts without tokens."""
    either = F.size(F.array_union(F.transform(a, lambda x: F.shiftright(x, 32)), F.transform(b, lambda x: F.shiftright(x, 32))))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def _below(cuts: str, key: Column, most: int, equal: bool) -> Column:
    """How many of the sorted `cuts` are less than `key` (or equal), by binary search."""
    def moved(step: int) -> Callable[[Column], Column]:
        def move(p: Column) -> Column:
            cut = F.get(cuts, p + (step - 1))
            return p + F.when(cut <= key if equal else cut < key, step).otherwise(0)

        return move

    at, step = F.lit(0), 1 << most.bit_length() - 1
    while step:
        at, step = let(at, moved(step)), step // 2
    return at


def with_next(documents: DataFrame, derive: Callable[[DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    """Each row with next_<column> of the row that follows by descending doc_id; the last is followed by the first.

    `documents` has doc_id, text and text_key, by which rows of one id are ordered. Rows are dealt to ranges
    of near equal counts; the first row of a range also goes to the range before it. Texts are shuffled
    once; `derive` adds further columns where they then lie.
    """
    spark = documents.sparkSession
    ranges = 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce("doc_id", F.lit(LEAST_KEY))
    keys = written(documents.select(key.alias("key"), "text_key"), "keys")
    cuts = F.percentile_approx("key", [n / ranges for n in range(1, ranges)], F.lit(max(10_000, 10 * ranges))).alias("cuts")
    cuts = keys.agg(F.coalesce(cuts, F.array().cast("array<bigint>")).alias("cuts"))  # one row

    def ranged(rows: DataFrame) -> DataFrame:
        low, high = _below("cuts", F.col("key"), ranges, False), _below("cuts", F.col("key"), ranges, True)
        # an id that fills several ranges is spread over them by its texts
        share = F.shiftrightunsigned("text_key", 1).cast("double") / float(1 << 63)
        return rows.crossJoin(F.broadcast(cuts)).withColumns({"low": low, "high": high}).withColumn(
            "range", F.least("high", F.col("low") + F.floor(share * (F.col("high") - F.col("low") + 1))).cast("int")).drop("low", "high", "cuts")

    # of its rows the first is the largest; at most one row per range, so one task is enough
    firsts = ranged(keys).groupBy("range").agg(F.max(F.struct("key", F.shiftrightunsigned("text_key", 1).alias("u"), "text_key")).alias("first"))
    whole = Window.orderBy("range")
    firsts = firsts.select("range", F.col("first.key").alias("first_key"), F.col("first.text_key").alias("first_text"),
                           F.coalesce(F.lead("range").over(whole), F.min("range").over(Window.partitionBy())).alias("before"))
    rows = ranged(documents.withColumn("key", key)).join(F.broadcast(firsts), "range")
    is_first = (F.col("key") == F.col("first_key")) & (F.col("text_key") == F.col("first_text"))
    own, guest = (F.struct(F.col(c).alias("range"), F.lit(g).alias("guest")) for c, g in (("range", 0), ("before", 1)))
    dealt = rows.withColumn("to", F.explode(F.when(is_first, F.array(own, guest)).otherwise(F.array(own))))
    dealt = derive(dealt.select("doc_id", "key", "text_key", "to.range", "to.guest", "text").repartition("range"))
    following = Window.partitionBy("range").orderBy("guest", F.desc("key"), F.desc(F.shiftrightunsigned("text_key", 1)), F.desc("text_key"))
    return dealt.withColumns({f"next_{c}": F.lead(c).over(following) for c in columns}).where("guest = 0").select(
        "doc_id", *columns, *(f"next_{c}" for c in columns))


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row.

    The edited text has its last third replaced by the begin of the next document's text, by descending
    doc_id, null ids last, the last followed by the first; rows of one id follow by a hash of their text.
    Null texts count as empty; they and texts of white space have the empty fingerprint. More columns are
    ignored. An empty table gives no rows.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    rows = with_next(docs, lambda df: with_signature(df, "text", "signature"), ["text", "signature"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - third), F.col("next_text").substr(F.lit(1), third))
    rows = rows.select(
        "doc_id", n.cast("long").alias("n_chars"), "signature", "next_signature", edited.alias("edited"))
    rows = with_signature(rows, "edited", "edited_signature")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        signature_text(F.col("signature")).alias("fingerprint"), signature_text(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"))
