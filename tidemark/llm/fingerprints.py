"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

A text's terms are its lower-cased words between white space and common marks, weighted by their counts. For each of SAMPLES samples a term has r and c from Gamma(2, 1) and b from U(0, 1), drawn
from hashes of the term. With t = floor(ln(weight) / r + b) the term's value is ln a = ln c - r * (t - b + 1), and the
sample is the (term, t) of the least value: two texts agree in it with their generalised Jaccard similarity.

Variates are computed for each distinct term of a text, from hashes of the term's own 64-bit hash: only equal terms
share them (two of a billion different terms would share a hash with a chance of 1 in 37).

Texts move once: rows are dealt to id buckets, which follow one another in id order, and all further steps keep to
the bucket. The next document of a bucket's last row is the first row of the following bucket.

A null text counts as empty; texts without words share one fingerprint, that of no terms. Equal ids come in order of the
text's hash, null ids last. The only row of a table is its own next document. Repeated rows stay, extra columns are
ignored, an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 32
RANGES = 64
MARKS = "\n\t\r.,;:!?()\"'"
ROWS_A_BUCKET, BUCKETS_A_GROUP = 100, 1000


def variates(term: Column, k: int) -> tuple[Column, Column, Column]:
    """r, ln c and b of sample k for a term, given by its hash: numbers from parts of two further hashes."""
    first, second = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    u = lambda x, start, bits: (F.shiftrightunsigned(x, start).bitwiseAND(F.lit((1 << bits) - 1)).cast("double") + 0.5) * 2.0**-bits
    r = -F.log(u(first, 0, 21) * u(first, 21, 21))
    ln_c = F.log(-F.log(u(second, 0, 32) * u(second, 32, 32)))
    return r, ln_c, u(first, 42, 22)


def id_bucket(docs: DataFrame, rows_a_bucket: int = ROWS_A_BUCKET) -> Column:
    """A bucket number that falls as doc_id rises: RANGES quantile ranges, each cut evenly; null ids come last, cut by ``place_hash``.

    Differences are taken as doubles, which any long fits in and which keep the order.
    """
    n, n_null, cuts = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.percentile_approx("doc_id", [k / RANGES for k in range(RANGES + 1)], 10000)).head()
    cuts = sorted(set(cuts or [0]))
    steps, null_steps = (max(1, -(-x // rows_a_bucket)) for x in (-(-n // RANGES), n_null))
    bounds = F.array(*(F.lit(c).cast("long") for c in cuts))
    k = F.greatest(F.size(F.filter(bounds, lambda c: c <= F.col("doc_id"))), F.lit(1))
    low, high = F.element_at(bounds, k).cast("double"), F.coalesce(F.try_element_at(bounds, k + 1).cast("double"), F.lit(cuts[-1] + 1.0))
    inner = F.floor((F.col("doc_id").cast("double") - low) * steps / F.greatest(high - low, F.lit(1.0)))
    inner = F.least(F.greatest(inner, F.lit(0)), F.lit(steps - 1))
    number = F.lit(len(cuts) * steps + steps).cast("long") - k * steps - inner
    of_null = F.lit((len(cuts) + 1) * steps + 1).cast("long") + F.floor((F.col("place_hash").cast("double") + 2.0**63) * (null_steps / 2.0**64))
    return F.when(F.col("doc_id").isNull(), of_null).otherwise(number)


def following(buckets: DataFrame) -> DataFrame:
    """(bucket) -> (bucket, after): the next number there is; after the last comes the first.

    Numbers fall into groups of BUCKETS_A_GROUP, each one task; only the groups' first and last numbers, one row each,
    come together.
    """
    grouped = buckets.withColumn("group", F.floor(F.col("bucket") / BUCKETS_A_GROUP))
    inside = grouped.withColumn("after", F.lead("bucket").over(Window.partitionBy("group").orderBy("bucket")))
    ends = grouped.groupBy("group").agg(F.min("bucket").alias("first"), F.max("bucket").alias("bucket"))
    order = Window.orderBy("bucket")
    least = F.min("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    between = ends.select("bucket", F.coalesce(F.lead("first").over(order), least).alias("between"))
    return inside.join(between, "bucket", "left").select("bucket", F.coalesce("after", "between").alias("after"))


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, place, doc_id, text, next_text, last) of every row, by descending doc_id; after the last comes the first.

    last: the row is the last of its bucket, and its next document is the following bucket's first.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("place_hash", F.xxhash64("text"))
    rows = rows.withColumn("bucket", id_bucket(rows))
    w = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), "place_hash", "text")
    placed = rows.select("bucket", "doc_id", "text", F.row_number().over(w).alias("place"), F.lead("text").over(w).alias("own_next"))
    heads = placed.filter("place = 1").select(F.col("bucket").alias("after"), F.col("text").alias("head"))
    heads = following(rows.select("bucket").distinct()).join(heads, "after").select("bucket", "head")
    last = F.col("own_next").isNull().alias("last")
    return placed.join(heads, "bucket").select("bucket", "place", "doc_id", "text", F.coalesce("own_next", "head").alias("next_text"), last)


def terms(text: Column) -> Column:
    """Lower-cased words between white space and common marks, with empty strings in between."""
    return F.split(F.translate(F.lower(text), MARKS, " " * len(MARKS)), " ")


def signatures(rows: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """rows (keys, text) -> (keys, signature): array of ``samples`` longs, null for a text without words.

    No shuffle beyond one by the first key.
    """
    words = rows.select(*keys, F.explode(terms(F.col("text"))).alias("term"))
    # The empty strings between words stay as one null term a text, which has no values.
    weighed = words.select(*keys, F.when(F.col("term") != "", F.xxhash64("term")).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"))
    both = weighed.withColumn("ln_w", F.when(F.col("term").isNotNull(), F.log("n")))

    def value(k: int) -> Column:
        r, ln_c, b = variates(F.col("term"), k)
        t = F.floor(F.col("ln_w") / r + b)
        ln_a = ln_c - r * (t - b + 1)
        # The value in the upper bits decides, (term, t) in the lower ones name the sample.
        name = F.col("term").bitwiseXOR(F.shiftleft(F.pmod(t, F.lit(1 << 20)), 16)).bitwiseAND(F.lit((1 << 36) - 1))
        return F.shiftleft(F.floor((F.greatest(ln_a, F.lit(-250.0)) + 256) * (1 << 18)), 36).bitwiseOR(name)

    least = [F.min(value(k)).alias(f"s{k}") for k in range(samples)]
    signature = F.when(F.col("s0").isNotNull(), F.array(*(f"s{k}" for k in range(samples))))
    return both.groupBy(*keys).agg(*least).select(*keys, signature.alias("signature"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / F.lit(float(samples))


def fingerprint(signature: Column) -> Column:
    """Nine hexadecimal digits a sample: the (term, t) of each."""
    return F.concat_ws("", F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit((1 << 36) - 1)))), 9, "0")))


def compared(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness: see the columns at the end.

    Every step up to the last join keeps to the rows' buckets.
    """
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    keys = ["bucket", "place"]
    side = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    sides = F.array(side(0, F.col("text")), side(1, edited), F.when(F.col("last"), side(2, F.col("next_text"))))
    each = rows.select(*keys, F.explode(sides).alias("x")).filter("x is not null").select(*keys, "x.kind", "x.text")
    signed = signatures(each, [*keys, "kind"], samples)
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("signature")))
    pivoted = signed.groupBy(*keys).agg(of(0).alias("own"), of(1).alias("edited"), of(2).alias("head"))
    w = Window.partitionBy("bucket").orderBy("place")
    # Texts without words keep their row and their place; only the last row of a bucket has no lead, and only it has a head.
    with_lead = pivoted.select(*keys, "own", "edited", F.coalesce(F.lead("own").over(w), "head").alias("next"))
    facts = rows.select(*keys, "doc_id", "n_chars", F.sha2(edited.cast("binary"), 256).alias("edited_sha256"))
    nothing = F.array_repeat(F.lit(-1).cast("long"), samples)
    out = facts.join(with_lead, keys, "left").withColumns({c: F.coalesce(c, nothing) for c in ("own", "edited", "next")})
    return out.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited"), samples).alias("near_edited"), likeness(F.col("own"), F.col("next"), samples).alias("near_next"),
    )
