"""Order MinHash fingerprints with DataFrame functions only.

A text is cut into tokens of up to 8 characters that are not white space; its k-mers are runs of `k` tokens, numbered by occurrence
so that repeats differ. Each of `permutations` hash functions (one hash with a seed for each) orders the k-mers, and so does each in reverse: the
`picks` first ones of an ordering are put back into the order in which they stand in the text, and the hash of that tuple is one
element of the signature, two for each function. An element of two texts is equal if the same k-mers come first in both and stand in
the same order; the share of equal elements therefore falls with edit distance and with reordering.

Defined cases: null text counts as empty; texts without tokens share one signature; a text of fewer k-mers than `picks` uses
all it has. Equal texts have equal signatures. Extra columns are ignored by the query and kept by `fingerprints`. Positions are
exact for every text: Spark's arrays of longs hold fewer than 2^28. A row holds an array of longs for each function while it is worked on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored

POS_BITS, HASH_BITS = 28, 35
_POS, _HASH = (1 << POS_BITS) - 1, (1 << HASH_BITS) - 1


def _pack(hashed: Column, pos: Column) -> Column:
    return F.shiftleft(hashed.bitwiseAND(F.lit(_HASH)), POS_BITS).bitwiseOR(pos)


def with_signature(df: DataFrame, text: str, out: str, k: int = 2, picks: int = 2, permutations: int = 12) -> DataFrame:
    """df with `out`: array of 2 * permutations longs. The steps are separate projections, each used more than once by the next."""
    names = df.columns
    d = df.withColumn("__t", F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\S{1,8}"), F.lit(0)))
    mer = lambda t, i: F.xxhash64(t, *(F.coalesce(F.get("__t", i + j), F.lit("")) for j in range(1, k)))
    d = d.withColumn("__a", F.sort_array(F.transform("__t", lambda t, i: _pack(mer(t, i), i.cast("long")))))
    d = d.withColumn("__h", F.transform("__a", lambda x: F.shiftright(x, POS_BITS)))
    # sorted, equal k-mers stand together in the order of the text: the occurrence number is the distance to the first of them,
    # which is found by steps of halving length
    def again(x: Column, i: Column) -> Column:
        same = lambda j: (j >= 0) & (F.get("__h", j) == F.shiftright(x, POS_BITS))
        steps = F.array(*(F.lit(1 << p) for p in range(POS_BITS, -1, -1)))
        first = F.aggregate(steps, i, lambda at, step: F.when(same(at - step), at - step).otherwise(at))
        return F.when(same(i - 1), i - first).otherwise(F.lit(0)).cast("long")

    d = d.withColumn("__s", F.transform("__a", lambda x, i: _pack(F.xxhash64(F.shiftright(x, POS_BITS), again(x, i)), x.bitwiseAND(F.lit(_POS))))).withColumn("__n", F.size("__s"))

    def element(at: str, first: Column) -> Column:
        """Hash of the picks k-mers from `first` on in the ordering `at`, as they stand in the text."""
        picked = F.slice(at, first, picks)
        in_text = F.sort_array(F.transform(picked, lambda x: F.shiftleft(x.bitwiseAND(F.lit(_POS)), HASH_BITS).bitwiseOR(F.shiftright(x, POS_BITS))))
        return F.xxhash64(F.transform(in_text, lambda x: x.bitwiseAND(F.lit(_HASH))))

    ordered = lambda n: F.sort_array(F.transform("__s", lambda x: _pack(F.xxhash64(F.lit(n), F.shiftright(x, POS_BITS)), x.bitwiseAND(F.lit(_POS)))))
    d = d.withColumns({f"__o{n}": ordered(n) for n in range(permutations)})
    starts = [F.lit(1), F.greatest(F.lit(1), F.col("__n") - picks + 1)]
    some = F.array(*(element(f"__o{n}", first) for n in range(permutations) for first in starts))
    return d.withColumn(out, F.when(F.col("__n") > 0, some).otherwise(F.array_repeat(F.lit(0).cast("long"), 2 * permutations))).select(*names, out)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal elements of two signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)


def written(sig: Column) -> Column:
    """The signature as text: 8 hex digits for each element."""
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def fingerprints(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """docs with `signature` (array of longs) and `fingerprint` (the same as text)."""
    return with_signature(docs, text, "signature", **how).withColumn("fingerprint", written(F.col("signature")))


def _ring(rows: DataFrame) -> DataFrame:
    """Stored: for each key (o, h), in order and as a ring, the row before it: (o, h, prev_o, prev_h, prev_n). The keys are dealt out by
    range, so that no task holds more than its share; only the first and last key of each range meet in one place."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // 1_000_000))
    dealt = stored(rows.repartitionByRange(parts, "o", "h").withColumn("pid", F.spark_partition_id()))
    key = F.struct("o", "h", "n")
    w = Window.partitionBy("pid").orderBy("o", "h")
    ends = dealt.groupBy("pid").agg(F.max(key).alias("last"))
    over = Window.orderBy("pid")  # one row per range
    ends = ends.select("pid", F.coalesce(F.lag("last").over(over), F.last("last").over(over.rowsBetween(0, Window.unboundedFollowing))).alias("before"))
    got = dealt.withColumn("prev", F.lag(key).over(w)).join(F.broadcast(ends), "pid")
    prev = F.coalesce("prev", "before")
    out = stored(got.select("o", "h", prev["o"].alias("prev_o"), prev["h"].alias("prev_h"), prev["n"].alias("prev_n")))
    drop_stored(dealt)
    return out


def edited_likeness(docs: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_<id>) of every row.

    The next document is the one that follows by descending id (null ids last; rows of one id by a hash of their text; equal
    rows are one document), in a ring. Its first third goes to the document before it. Signatures of the texts are made once and stored
    without them; each text is shuffled once, and a third of it a second time."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.select(F.col(id).alias("id"), t.alias("t"))
    # ascending in o is descending in the id
    base = base.withColumns({"o": F.bitwise_not(F.coalesce(F.col("id").cast("long"), F.lit(-(2**63)))), "h": F.xxhash64("t", F.col("id").isNull())})
    signed = stored(with_signature(base, "t", "sig", **how).select("o", "h", F.length("t").alias("n"), "sig"))
    keys = stored(signed.groupBy("o", "h").agg(F.max("n").alias("n"), F.count("*").alias("copies")))
    ring, copied = _ring(keys.select("o", "h", "n")), keys.where("copies > 1").limit(1).count() > 0
    drop_stored(keys)
    sigs = signed.select("o", "h", "sig")
    sigs = sigs.dropDuplicates(["o", "h"]) if copied else sigs
    given = base.join(ring, ["o", "h"]).join(sigs, ["o", "h"]).select(
        F.col("prev_o").alias("o"), F.col("prev_h").alias("h"), F.expr("left(t, int(prev_n div 3))").alias("lent"), F.col("sig").alias("next_sig"), F.col("id").alias("next_id")
    )
    if copied:
        given = given.groupBy("o", "h").agg(F.first("lent").alias("lent"), F.first("next_sig").alias("next_sig"), F.first("next_id").alias("next_id"))
    d = base.join(given, ["o", "h"]).join(sigs, ["o", "h"])
    n = F.length("t")
    d = d.withColumn("n_chars", n.cast("long")).withColumn("edited", F.expr("concat(left(t, int(length(t) - length(t) div 3)), lent)"))
    d = d.select("id", "n_chars", "edited", "sig", "next_sig", "next_id")
    d = with_signature(d, "edited", "edited_sig", **how)
    return d.select(
        F.col("id").alias(id), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written(F.col("sig")).alias("fingerprint"), written(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"), F.col("next_id").alias(f"next_{id}"),
    )
