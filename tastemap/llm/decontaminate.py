"""Benchmark decontamination by verified word windows; DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, row_key, written

#: A word is a run of digits, letters a-z and characters beyond ASCII, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: Bits of the window filter, a table of fixed size whatever the benchmark.
FILTER_BITS = 22
#: Windows that are still broadcast; larger benchmarks are joined by shuffle.
BROADCAST_WINDOWS = 200_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(f"{WORD}+"), 0)


def _joined(hashes: Column, ahead: Column, by: int) -> Column:
    """Hash of each entry with the entry of ``ahead`` that lies ``by`` places on; past the end it is no use."""
    return F.zip_with(hashes, F.slice(ahead, by + 1, F.greatest(F.size(ahead) - by, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def window_hashes(df: DataFrame, source: str, n: int) -> DataFrame:
    """Adds ``h{n}``: a hash of the ``n`` words from each position on, built from hashes of doubled widths."""
    out = df.withColumn("h1", F.transform(source, lambda w: F.xxhash64(w)))
    width, have = 1, {1: "h1"}
    while 2 * width <= n:
        out = out.withColumn(f"p{2 * width}", _joined(F.col(have[width]), F.col(have[width]), width))
        width *= 2
        have[width] = f"p{width}"
    rest, done, name = n - width, width, have[width]
    while rest:
        width = max(w for w in have if w <= rest)
        out = out.withColumn(f"q{done + width}", _joined(F.col(name), F.col(have[width]), done))
        name, done, rest = f"q{done + width}", done + width, rest - width
    made = [c for c in out.columns if c not in df.columns and c != name]
    return out.withColumn(f"w{n}", F.col(name)).drop(*made, name)


def benchmark_windows(benchmark: DataFrame, n: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """The distinct windows of the items: size, hash, words joined by blanks, and the items that hold them.

    An item of fewer than ``n`` words, but not none, is one window of its size. An item id that repeats is one
    item with all its texts.
    """
    w = F.col("words")
    items = benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("words")).filter(F.size("words") > 0)
    items = items.withColumn("n", F.least(F.size("words"), F.lit(n)))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)
    spread = items.withColumn("at", F.explode(starts)).select("item", "n", F.slice(w, F.col("at"), F.col("n")).alias("words"))
    windows = spread.groupBy("n", F.array_join("words", " ").alias("window")).agg(F.collect_set("item").alias("items"), F.first("words").alias("words"))
    sizes = [r["n"] for r in windows.select("n").distinct().orderBy("n").collect()]  # at most n numbers
    parts = [window_hashes(windows.filter(F.col("n") == size), "words", size).select("n", F.element_at(f"w{size}", 1).alias("h"), "window", "items") for size in sizes]
    out = parts[0] if parts else windows.select("n", F.lit(0).cast("long").alias("h"), "window", "items").limit(0)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _filter_words(windows: DataFrame) -> DataFrame:
    """One row: the window hashes as a bitmap of 2**FILTER_BITS bits, in 64-bit words."""
    spark = windows.sparkSession
    slot = F.expr(f"h & {(1 << FILTER_BITS) - 1}L")
    bits = windows.select(slot.alias("s")).groupBy(F.expr("cast(s div 64 as int)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("b"))
    places = spark.range(0, 1 << FILTER_BITS - 6, 1, 8).select(F.col("id").cast("int").alias("w"))
    dense = places.join(bits, "w", "left").select("w", F.coalesce("b", F.lit(0)).alias("b"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("bits"))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """k (row key), doc_id, n_words, the merged hit ``spans`` (first word, end), n_hit and the sorted item ids.

    Every window of every document is hashed and looked up in a bitmap of fixed size, which travels as one
    value; the few that pass are joined with the benchmark's windows by hash and compared word by word. The
    windows are broadcast up to BROADCAST_WINDOWS of them, beyond that the join shuffles the passing ones.

    Null or empty texts have no words and no hits. Rows equal in id and text are one document in the join, and
    each is returned. An empty benchmark hits nothing. Other columns are not read.
    """
    windows = written(benchmark_windows(benchmark, n, item, item_text))
    sizes = [r["n"] for r in windows.select("n").distinct().orderBy("n").collect()]
    count = windows.count()
    rows = docs.select(row_key(doc, text).alias("k"), F.col(doc).alias("doc_id"), words(F.col(text)).alias("words"))
    none = F.array().cast("array<struct<at:int,n:int,h:long,window:string>>")
    if sizes:
        bits = _filter_words(windows).scalar()
        rows = rows.withColumn("bits", bits)
        found = []
        for size in sizes:
            rows = window_hashes(rows, "words", size)
            places = F.when(F.size("words") >= size, F.sequence(F.lit(1), F.size("words") - size + 1)).otherwise(F.array().cast("array<int>"))
            found.append(_passing(places, F.col(f"w{size}"), size))
        rows = rows.withColumn("passing", F.concat(*found))
    else:
        rows = rows.withColumn("passing", none)
    rows = written(rows.select("k", "doc_id", F.size("words").cast("long").alias("n_words"), "passing"))
    passing = rows.filter(F.size("passing") > 0).select("k", F.explode("passing").alias("p")).select("k", "p.*")
    if count <= BROADCAST_WINDOWS:
        windows = F.broadcast(windows)
    true = passing.join(windows, ["n", "h", "window"]).select("k", F.struct("at", (F.col("at") + F.col("n")).alias("end")).alias("span"), "items")
    by_doc = true.groupBy("k").agg(F.array_sort(F.collect_set("span")).alias("raw"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    spans = F.aggregate("raw", F.array().cast("array<struct<at:int,end:int>>"), _merged)
    by_doc = by_doc.select("k", "items", spans.alias("spans"))
    out = rows.drop("passing").join(by_doc, "k", "left")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["at"])
    return out.select(
        "k", "doc_id", "n_words", "spans", F.coalesce(n_hit, F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _passing(places: Column, hashes: Column, size: int) -> Column:
    """The places whose window hash passes the bitmap, with hash and words."""
    some = F.filter(places, lambda at: _passes(F.element_at(hashes, at), F.col("bits")))
    window = lambda at: F.array_join(F.slice("words", at, F.lit(size)), " ")
    return F.transform(some, lambda at: F.struct(at.alias("at"), F.lit(size).alias("n"), F.element_at(hashes, at).alias("h"), window(at).alias("window")))


def _passes(h: Column, bits: Column) -> Column:
    slot = h.bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    word = F.element_at(bits, F.shiftright(slot, 6).cast("int") + 1)
    return F.getbit(word, slot.bitwiseAND(F.lit(63)).cast("int")) == 1


def _merged(spans: Column, s: Column) -> Column:
    """Appends a span, or lengthens the last one if they touch; the spans come in order."""
    last = F.element_at(spans, -1)
    longer = F.struct(last["at"].alias("at"), F.greatest(last["end"], s["end"]).alias("end"))
    front = F.slice(spans, 1, F.size(spans) - 1)
    return F.when((F.size(spans) > 0) & (F.try_element_at(spans, F.lit(-1))["end"] >= s["at"]), F.concat(front, F.array(longer))).otherwise(F.concat(spans, F.array(s)))


def without_spans(docs: DataFrame, found: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the hit words, and what parts them from the next word, taken out of the text."""
    marks = found.filter("n_hit > 0").select("k", "spans").dropDuplicates(["k"])
    rows = docs.withColumn("k", row_key(doc, text)).join(marks, "k", "left")
    # A-Z belong to words here: the text itself is not lower-cased.
    pieces = F.regexp_extract_all(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), 0)
    lead = F.regexp_extract(text, r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    kept = F.filter(pieces, lambda p, i: ~F.exists("spans", lambda s: (s["at"] <= i + 1) & (i + 1 < s["end"])))
    return rows.withColumn(text, F.when(F.col("spans").isNotNull(), F.concat(lead, F.array_join(kept, ""))).otherwise(F.col(text))).drop("k", "spans")


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))
