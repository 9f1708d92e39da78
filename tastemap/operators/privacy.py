"""Scrubbing of direct identifiers, reviewed replacements and rewrites, and reviewed edits."""
from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.text import compatibility_form, literal
from ..session import cut_lineage
from .ranking import global_positions

# Placeholders, identifier patterns in their order, and calendar and path patterns. A pattern looks at
# the first characters of its matches before it looks behind, so that it leaves most places of a text at once.
PLACEHOLDER_NAMES = [
    "PERSON", "PET", "PATH", "LOCATION", "ORGANIZATION", "URL", "ACCOUNT", "EMAIL", "PHONE", "ADDRESS", "DATE", "COORDINATES", "IDENTIFIER", "PRIVATE_TEXT",
]
IDENTIFIERS = [
    ("email", r"(?i)[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    ("url", r"(?i)(?=[hw])(?:https?://|www\.)[^\s<>\[\]]+", "[URL]"),
    ("account", r"(?=@)(?<!\w)@[\w.]+", "[ACCOUNT]"),
    ("coordinates", r"(?=[-\d])(?<![\w.])-?\d{1,2}\.\d{4,}\s*,\s*-?\d{1,3}\.\d{4,}(?!\d)", "[COORDINATES]"),
    ("date", r"(?=\d)(?<!\d)(?:\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{4})(?!\d)", "[DATE]"),
    ("phone", r"(?=[+(\d])(?<!\w)(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)", "[PHONE]"),
    ("identifier", r"(?=[+abcdefABCDEF\d][\dabcdefABCDEF]{9})(?<!\w)(?:\+?\d{10,}|[a-fA-F0-9]{32,64})(?!\w)", "[IDENTIFIER]"),
    ("address", r"(?i)(?=\d)\b\d{1,6}\s+(?:[A-Za-z]+\s+){1,5}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr)\b(?:\.?\s*(?:Apt|Suite|Unit)\s*[\w-]+)?", "[ADDRESS]"),
]
CALENDAR = [
    ("private_path", r"(?:[A-Za-z]:[\\/]|/(?:home|Users)/)[^\s<>&]+", "[PATH]"),
    ("date", r"\[(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])\d{2}\]", "[DATE]"),
    ("date", r"(?=[01])(?<!\w)(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?:19|20)\d{2}(?!\w)", "[DATE]"),
    ("date", r"(?=\d)(?<!\d)\d{1,2}/\d{1,2}/\d{2}(?!\d)", "[DATE]"),
    ("date", r"(?i)(?=[JFMASOND][aepuco][nbrylgptvc])\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\.?\s+\d{1,2}(?:st|nd|rd|th)?(?:\s*[-–]\s*\d{1,2})?(?:,?\s+\d{4})?\b", "[DATE]"),
    ("date", r"(?i)(?=\d)\b\d{1,2}(?:st|nd|rd|th)?\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)(?:\s+\d{4})?\b", "[DATE]"),
]
# End of fixed values.

PLACEHOLDER = r"\[(?:" + "|".join(PLACEHOLDER_NAMES) + r")\]"
AROUND_PLACEHOLDER = rf"(?<=\])(?<={PLACEHOLDER})|(?={PLACEHOLDER})"
#: Characters of which a match has one; texts without them are not searched.
NEEDED = {"email": "@", "private_path": "/\\"}


def in_jvm(pattern: str) -> str:
    """Spell word characters and digits out: Unicode letters, numbers and the underscore."""
    return "(?U)" + pattern.replace(r"\w", r"[\p{L}\p{N}_]").replace(r"\d", r"\p{Nd}")


def _may_match(text: Column, name: str) -> Column:
    """Whether a text has what each match of the pattern needs."""
    return functools.reduce(lambda a, b: a | b, [text.contains(c) for c in NEEDED[name]])


def _replace_all(text: Column, patterns) -> Column:
    for name, pattern, placeholder in patterns:
        change = functools.partial(F.regexp_replace, pattern=F.lit(in_jvm(pattern)), replacement=F.lit(placeholder))
        if name in NEEDED:
            # One lambda argument, so that the text so far is computed once.
            text = F.get(F.transform(F.array(text), lambda t: F.when(_may_match(t, name), change(t)).otherwise(t)), F.lit(0))  # noqa: B023
        else:
            text = change(text)
    return text


def outside_placeholders(text: Column, change) -> Column:
    """Apply a change to the pieces between existing placeholders."""
    pieces = F.split(text, AROUND_PLACEHOLDER)
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(f"^{PLACEHOLDER}$"), p).otherwise(change(p))), "")


def mask_identifiers(text: Column) -> Column:
    """Identifier patterns in order, outside placeholders."""
    return outside_placeholders(text, lambda p: _replace_all(p, IDENTIFIERS))


def drop_marker(text: Column) -> Column:
    """A hash sign right before a placeholder goes."""
    return F.regexp_replace(text, r"#(?=\[)", "")


def mask_calendar(text: Column) -> Column:
    return _replace_all(text, CALENDAR)


def masked(text: Column, calendar: bool = False) -> Column:
    """Rule-free scrub: normal form, identifiers, markers, and on request calendar dates and paths."""
    out = drop_marker(mask_identifiers(compatibility_form(text)))
    return mask_calendar(out) if calendar else out


def placeholder_hits(before: Column, after: Column, names: list[str]) -> list[Column]:
    """Replacements by placeholder. No pattern can swallow a placeholder, so counts only grow."""
    return [
        (F.regexp_count(after, F.lit(rf"\[{n}\]")) - F.regexp_count(before, F.lit(rf"\[{n}\]"))).alias(n.lower()) for n in names
    ]


#: Counters of a scrub and the placeholder each pattern leaves.
COUNTED = {**{name: placeholder[1:-1] for name, _, placeholder in IDENTIFIERS}, "private_path": "PATH"}


def _counted(before: Column, after: Column, names: list[str]) -> dict[str, Column]:
    hits = placeholder_hits(before, after, [COUNTED[n] for n in names])
    return dict(zip(names, hits))


@functools.lru_cache(maxsize=1 << 14)
def _term_pattern(term: str) -> re.Pattern:
    """A placeholder, or the term between word boundaries in any case."""
    return re.compile(rf"(?P<held>{PLACEHOLDER})|(?<!\w)(?i:{re.escape(term)})(?!\w)")


@pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.IntegerType())]))
def replace_terms(text: pd.Series, rules: pd.Series) -> pd.DataFrame:
    """Each text under its own rules, in their order, and the number of replacements; placeholders are stepped over."""

    def changed(value, found):
        total = 0
        for rule in found:
            hits = 0

            def put(m, new=rule["replacement"]):
                nonlocal hits
                hits += not m["held"]
                return m.group() if m["held"] else new

            value = _term_pattern(rule["form"]).sub(put, value)
            total += hits
        return value, total

    return pd.DataFrame([(t, 0) if r is None or t is None else changed(t, r) for t, r in zip(text, rules)], columns=["text", "n"]).astype({"n": "int32"})


def _words(text: Column) -> Column:
    """Distinct words of a text, alike for all that a pattern without case takes for equal."""
    return F.array_distinct(F.regexp_extract_all(F.upper(F.translate(text, "İ", "I")), F.lit(r"[\p{L}\p{N}_]+"), 0))


def _term_rules(rules: DataFrame, handles: list[str]) -> DataFrame:
    """Replacement rules with normal form, rank (shared, own, handle), first word and the words they insert."""
    spark = rules.sparkSession
    given = rules.filter("kind = 'replace'").select("scope", "term", "replacement", F.when(F.col("scope").isNull(), 0).otherwise(1).alias("rank"))
    named = spark.createDataFrame([(None, h, "[ACCOUNT]", 2) for h in dict.fromkeys(handles) if h], "scope string, term string, replacement string, rank int")
    inserted = _words(F.regexp_replace("replacement", PLACEHOLDER, " "))
    one = given.union(named).withColumn("form", compatibility_form(F.col("term")))
    return one.withColumn("word", F.coalesce(F.get(_words(F.col("form")), F.lit(0)), F.lit(""))).withColumn("inserted", inserted)


def _rules_by_word(rules: DataFrame) -> DataFrame:
    """Rules that a word of a text can bring into play: those that begin with it, and those that begin with what they insert.

    Any word of a term stands alone where the term matches, so its first one finds it. A term without words
    comes under the empty word.
    """
    start = rules.select("scope", "word", F.col("word").alias("first"), "term", "form", "replacement", "rank", "inserted")
    if start.filter("size(inserted) > 0").isEmpty():
        return start
    start = cut_lineage(start)
    found = new = start
    while True:
        by = new.select(F.col("scope").alias("s"), "word", F.explode("inserted").alias("first")).distinct()
        more = by.join(start.drop("word"), "first").filter("s is null or scope is null or s = scope")
        more = more.withColumn("scope", F.coalesce("scope", "s")).select(*start.columns)
        known = found.select(F.col("scope").alias("_s"), F.col("word").alias("_w"), F.col("term").alias("_term"), F.col("rank").alias("_r"))
        same = F.col("scope").eqNullSafe(F.col("_s")) & (F.col("word") == F.col("_w")) & (F.col("term") == F.col("_term")) & (F.col("rank") == F.col("_r"))
        new = cut_lineage(more.distinct().join(known, same, "left_anti"))
        if new.isEmpty():
            return found
        found = found.union(new)


def scrub(texts: DataFrame, rules: DataFrame | None = None, handles: list[str] = (), calendar: bool = True, column: str = "text", counts: bool = False) -> DataFrame:
    """Scrub ``column`` of rows with ``user_id``.

    ``rules``: reviewed ``(scope, kind, term, replacement)``; scope is a user or null for all, kind is ``replace``
    (a term) or ``rewrite`` (a whole scrubbed text). For equal terms a user's rule beats a shared one, and a
    handle beats both. All terms that apply to a text run in one order, the longest first (ties by term), each on
    the text as the one before has left it. An empty term, or one without replacement, is an error.

    Rules of any number meet the texts in a join on words; a text carries only those it has a word of. Rewrites
    are joined by hash and compared. Adds ``scrubbed``, ``was_rewritten``, and with ``counts`` a struct ``hits``: the
    replacements by pattern, ``keyword`` (terms), ``reviewed_rewrite`` and ``changed`` of the row, counted in the same pass.
    """
    out = texts.withColumn("_p", compatibility_form(F.col(column))).withColumn("_m", mask_identifiers(F.col("_p")))
    out = out.withColumn("_t", drop_marker(F.col("_m"))).withColumn("was_rewritten", F.lit(False)).withColumn("_keyword", F.lit(0))
    found = list(dict.fromkeys(n for n, _, _ in IDENTIFIERS))
    if counts:
        out = out.withColumn("hits", F.struct(*[c.alias(n) for n, c in _counted(F.col("_p"), F.col("_m"), found).items()]))
    out = out.drop("_p", "_m")
    if rules is None and not handles:
        return _finished(out.withColumn("_c", drop_marker(F.col("_t"))), calendar, column, counts)
    if rules is None:
        rules = texts.sparkSession.createDataFrame([], "scope string, kind string, term string, replacement string")
    else:
        if not rules.filter("term is null or replacement is null or (kind = 'replace' and term = '')").isEmpty():
            raise ValueError("a rule needs a term and a replacement")
        once = rules.filter("kind = 'rewrite'").groupBy(F.col("scope").alias("_scope"), F.col("term").alias("_term")).agg(F.max("replacement").alias("_new")).withColumn("_k", F.xxhash64("_term"))
        common, own = once.filter("_scope is null").select("_k", "_term", "_new"), once.filter("_scope is not null").toDF("_own_scope", "_own_term", "_own_new", "_own_k")
        out = out.withColumn("_k", F.xxhash64("_t"))
        out = out.join(common, (out["_k"] == common["_k"]) & (out["_t"] == common["_term"]), "left").drop(common["_k"])
        out = out.join(own, (out["_k"] == own["_own_k"]) & (out["_t"] == own["_own_term"]) & (out["user_id"] == own["_own_scope"]), "left")
        chosen = F.coalesce("_own_new", "_new")
        out = out.withColumn("was_rewritten", chosen.isNotNull()).withColumn("_t", F.coalesce(_replace_all(chosen, IDENTIFIERS), "_t"))
        out = out.drop("_k", "_term", "_new", "_own_scope", "_own_term", "_own_new", "_own_k")
    terms = _rules_by_word(_term_rules(rules, handles))
    # One key for user and text, so that rows without a user meet the shared rules as well.
    out = out.withColumn("_key", F.md5(F.concat(F.coalesce(F.concat(F.lit("="), F.col("user_id").cast("string")), F.lit("~")), F.lit("\n"), "_t")))
    said = out.select("_key", "user_id", F.explode(F.array_union(_words(F.col("_t")), F.array(F.lit("")))).alias("word"))
    hits = said.join(terms, "word").filter("scope is null or scope = user_id")
    hits = hits.groupBy("_key", "term", "form").agg(F.max(F.struct("rank", "replacement"))["replacement"].alias("replacement"))
    by_text = hits.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct((-F.length("term")).alias("place"), "term", "form", "replacement"))).alias("_rules"))
    out = out.join(by_text, "_key", "left").withColumn("_replaced", replace_terms("_t", "_rules")).withColumn("_keyword", F.col("_replaced.n"))
    return _finished(out.withColumn("_c", drop_marker(F.col("_replaced.text"))).drop("_key", "_rules", "_replaced"), calendar, column, counts)


def _finished(out: DataFrame, calendar: bool, column: str, counts: bool) -> DataFrame:
    """The calendar step, and the counters of all steps."""
    out = out.withColumn("scrubbed", mask_calendar(F.col("_c")) if calendar else F.col("_c"))
    if counts:
        late = _counted(F.col("_c"), F.col("scrubbed"), ["date", "private_path"])
        known = {n: F.col(f"hits.{n}") for n in COUNTED if n != "private_path"}
        sums = {**known, "date": known["date"] + late["date"], "private_path": late["private_path"], "keyword": F.col("_keyword"), "reviewed_rewrite": F.col("was_rewritten").cast("int"), "changed": (~F.col(column).eqNullSafe(F.col("scrubbed"))).cast("int")}
        out = out.withColumn("hits", F.struct(*[c.cast("long").alias(n) for n, c in sums.items()]))
    return out.drop("_t", "_c", "_keyword")


def residual_patterns(text: Column) -> Column:
    """Names of patterns that still match a released text."""
    hits = [F.when(_may_match(text, n) & text.rlike(in_jvm(p)) if n in NEEDED else text.rlike(in_jvm(p)), n) for n, p, _ in [*IDENTIFIERS, *CALENDAR]]
    return F.array_distinct(F.array_compact(F.array(*hits)))


def proposal_rows(edits: DataFrame, records: DataFrame) -> DataFrame:
    """Proposed edits ``(batch, edits array<struct<id, spans array<struct<find, replace, reason>>>>)`` as rows."""
    flat = edits.select("batch", F.posexplode("edits").alias("edit_index", "e")).select("batch", "edit_index", F.col("e.id").alias("record_id"), F.posexplode("e.spans").alias("span_index", "s"))
    key = F.concat_ws("_", F.col("batch"), F.col("edit_index"), F.col("span_index"))
    return flat.select(key.alias("key"), "record_id", "s.find", "s.replace", "s.reason").join(records, "record_id", "left")


def checked_proposals(proposals: DataFrame) -> DataFrame:
    """Proposals with the reason they are set aside for, null when valid.

    A span must occur literally in its record, change something, and touch no placeholder.
    """
    text, find = F.col("text"), F.col("find")
    whole = F.size(F.split(text, literal(find), -1)) - 1
    # A hit that touches a placeholder vanishes or breaks when placeholders turn into a mark.
    bare = F.regexp_replace(text, PLACEHOLDER, "￼")
    clear = F.size(F.split(bare, literal(find), -1)) - 1
    reason = (
        F.when(text.isNull(), "unknown_record")
        .when(find.isNull() | (find == "") | (F.instr(text, find) == 0) | F.col("replace").isNull(), "nonliteral_or_invalid_span")
        .when(find == F.col("replace"), "no_change")
        .when(whole != clear, "protected_placeholder")
    )
    return proposals.withColumn("validation_reason", reason)


@pandas_udf(T.StringType())
def rewrite_once(text: pd.Series, edits: pd.Series) -> pd.Series:
    """Literal replacements in one pass, longest first, so that inserted text is not touched again."""

    def run(value, pairs):
        table = {p["find"]: p["replacement"] for p in pairs}
        pattern = "|".join(re.escape(t) for t in sorted(table, key=lambda t: (-len(t), t)))
        return re.sub(pattern, lambda m: table[m.group()], value)

    return pd.Series([run(t, e) for t, e in zip(text, edits)], dtype="object")


def decided(proposals: DataFrame, decisions: DataFrame, overrides: DataFrame) -> DataFrame:
    """Proposals with the action in force. Decisions must cover the proposals exactly; overrides must exist."""
    both = proposals.join(decisions.select("key", "action", F.col("reason").alias("decision_reason"), F.lit(True).alias("_d")), "key", "full_outer")
    over = overrides.select("key", F.col("action").alias("_oa"), F.col("replace").alias("_or"), F.col("reason").alias("_on"), F.lit(True).alias("_o"))
    joined = both.join(over, "key", "full_outer")
    problem = (
        F.when(F.col("_o") & F.col("_d").isNull() & F.col("find").isNull(), "unknown_override")
        .when(F.col("_d").isNull() | F.col("find").isNull(), "incomplete_coverage")
    )
    return joined.select(
        "key", "record_id", "text", "find", F.coalesce("_or", "replace").alias("replacement"), F.coalesce("_oa", "action").alias("action"),
        F.coalesce("_on", "decision_reason").alias("reason"), F.col("_o").isNotNull().alias("overridden"), problem.alias("problem"),
    )


def edit_conflicts(actions: DataFrame) -> DataFrame:
    """Texts for which one term was given several replacements."""
    accepted = actions.filter("action = 'accept' and problem is null")
    return accepted.groupBy("text", "find").agg(F.countDistinct("replacement").alias("n")).filter("n > 1")


def compiled_rewrites(actions: DataFrame) -> DataFrame:
    """Exact-text rewrite rules from accepted edits; a text has few accepted spans."""
    accepted = actions.filter("action = 'accept' and problem is null and instr(text, find) > 0")
    spans = accepted.select("text", "find", "replacement").distinct().groupBy("text").agg(F.collect_list(F.struct("find", "replacement")).alias("edits"))
    return spans.select("text", rewrite_once("text", "edits").alias("rewritten")).filter("text != rewritten")


def review_batches(records: DataFrame, tokens: Column, max_rows: int = 200, max_tokens: int = 16000, block: int = 8192) -> DataFrame:
    """``records`` with ``batch``, the number of the review batch each belongs to in order of ``record_id``.

    A batch takes consecutive records while it holds at most ``max_rows`` rows and ``max_tokens`` tokens; a record
    above the limit is a batch of its own. Every record points to the one that would start the next batch if a
    batch started with it; that follows from running sums alone. Inside a block of consecutive records the pointers
    are followed at once, so that each possible entry of a block (its first ``max_rows`` records at most) points to an
    entry of a later block. The entries taken from the first record on are found by doubling these pointers: the
    rounds grow with the logarithm of the blocks, and no task holds more than one block.
    """
    sized = records.withColumn("_n", F.coalesce(tokens, F.lit(0)).cast("long"))
    placed = cut_lineage(global_positions(sized, ["record_id"], "_p", {"_before": "_n"}).withColumn("_b", F.expr(f"_p div {block}")))
    steps = cut_lineage(_next_starts(placed.select("_b", "_p", "_before", "_n"), max_rows, max_tokens, block))
    exits = steps.groupBy("_b").applyInArrow(_block_exits(max_rows, block), "_p long, _to long")
    entries = _taken_entries(cut_lineage(exits.filter("_to is not null")))
    starts = steps.join(entries.select(F.expr(f"_p div {block}").alias("_b"), F.col("_p").alias("_entry")), "_b", "left")
    marked = cut_lineage(starts.groupBy("_b").applyInArrow(_block_starts, "_b long, _p long, _start boolean"))
    counts = marked.groupBy("_b").agg(F.sum(F.col("_start").cast("long")).alias("_s"))
    offsets = global_positions(counts, ["_b"], "_i", {"_earlier": "_s"}).select("_b", "_earlier")
    inside = W.partitionBy("_b").orderBy("_p").rowsBetween(W.unboundedPreceding, 0)
    numbered = marked.join(offsets, "_b").select("_p", (F.col("_earlier") + F.sum(F.col("_start").cast("long")).over(inside) - 1).alias("batch"))
    return placed.join(numbered, "_p").drop("_b", "_p", "_before", "_n")


def _next_starts(placed: DataFrame, max_rows: int, max_tokens: int, block: int) -> DataFrame:
    """(_b, _p, _next): the record that starts the next batch after one that starts with ``_p``.

    The running sum before a record is its sum of all earlier ones, so the last record whose sum lies within
    ``max_tokens`` of this one is the first that may not fit. A block borrows the first rows of the next one.
    """
    after = placed.filter(F.col("_p") % block < max_rows + 1).filter(F.col("_p") >= block).withColumn("_b", F.col("_b") - 1)
    tail = placed.agg(F.max_by(F.struct("_b", "_p", "_before", "_n"), "_p").alias("t")).filter("t is not null")  # a place behind the last record
    tail = tail.select(F.explode(F.array(F.col("t._b"), F.col("t._b") - 1)).alias("_b"), (F.col("t._p") + 1).alias("_p"), (F.col("t._before") + F.col("t._n")).alias("_before"), F.lit(0).cast("long").alias("_n"))
    near = placed.withColumn("_own", F.lit(True)).unionByName(after.unionByName(tail).withColumn("_own", F.lit(False)))
    fits = W.partitionBy("_b").orderBy("_before").rangeBetween(0, max_tokens)
    reach = F.greatest(F.col("_p") + 1, F.max("_p").over(fits))
    return near.withColumn("_next", F.least(F.col("_p") + max_rows, reach)).filter("_own").select("_b", "_p", "_next")


def _block_exits(max_rows: int, block: int):
    def exits(table: pa.Table) -> pa.Table:
        """Where the way from each possible entry leaves the block; the block's end is settled first."""
        p, after = (table.column(c).to_numpy() for c in ("_p", "_next"))
        order = np.argsort(p)
        p, after = p[order], after[order]
        leave = after.copy()
        for k in range(len(p) - 1, -1, -1):
            if after[k] <= p[-1]:
                leave[k] = leave[after[k] - p[0]]
        # The last block is not full; its ways lead nowhere.
        to = pa.array(leave[:max_rows], mask=np.full(min(max_rows, len(p)), len(p) < block))
        return pa.table({"_p": pa.array(p[:max_rows]), "_to": to})

    return exits


def _taken_entries(jumps: DataFrame) -> DataFrame:
    """Entries on the way from record 0: those reached double with each round, as do the steps of a pointer."""
    taken = jumps.sparkSession.range(1).select(F.col("id").alias("_p"))
    while not jumps.isEmpty():
        found = taken.join(jumps, "_p").select(F.col("_to").alias("_p"))
        taken = cut_lineage(taken.union(found).distinct())
        far = jumps.select(F.col("_p").alias("_to"), F.col("_to").alias("_far"))
        jumps = cut_lineage(jumps.join(far, "_to").select("_p", F.col("_far").alias("_to")))
    return taken


def _block_starts(table: pa.Table) -> pa.Table:
    """Which records of a block start a batch, from the block's entry on."""
    b, p, after, entry = (table.column(c).to_numpy() for c in ("_b", "_p", "_next", "_entry"))
    order = np.argsort(p)
    b, p, after = b[order], p[order], after[order]
    start = np.zeros(len(p), bool)
    at = entry[0]  # nan where a batch spans the whole block
    while at <= p[-1]:
        start[int(at - p[0])] = True
        at = after[int(at - p[0])]
    return pa.table({"_b": pa.array(b), "_p": pa.array(p), "_start": pa.array(start)})


def review_records(posts: DataFrame, labels: DataFrame, captions: DataFrame) -> DataFrame:
    """record_id, kind and text: the distinct scrubbed texts of posts, labels and captions in the order they are first seen.

    Each input has user_id, position and text; a user's posts come first, then labels, then captions. The id says
    nothing of the user.
    """
    kinds = [(posts, "post"), (labels, "label"), (captions, "caption")]
    rows = [df.select("user_id", F.lit(rank).alias("rank"), "position", F.lit(kind).alias("kind"), masked(F.col("text")).alias("text")) for rank, (df, kind) in enumerate(kinds)]
    first = distinct_texts(functools.reduce(DataFrame.unionByName, rows), ["user_id", "rank", "position"])
    placed = global_positions(first, ["first_seen", "kind", "text"], "_at")
    return placed.select(F.format_string("r%06d", "_at").alias("record_id"), "kind", "text")


def distinct_texts(texts: DataFrame, order: list[str]) -> DataFrame:
    """Distinct (kind, scrubbed text) with where it is first seen, for review."""
    return texts.groupBy("kind", "text").agg(F.min(F.struct(*order)).alias("first_seen"))


# Forbidden artifacts of a release package and secrets in its files.
FORBIDDEN_PARTS = ["private", "outputs", "results", "artifacts", "archive", "archives", "logs", "tmp", ".venv", "__pycache__", ".pytest_cache", "node_modules"]
FORBIDDEN_SUFFIXES = ["pyc", "pyo", "zip", "gz", "tar", "jpg", "jpeg", "png", "webp", "gif", "pdf", "mp4"]
SECRET = r"(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|sk-[A-Za-z0-9_-]{20,}|-----BEGIN (?:RSA |OPENSSH |EC )?PRIVATE KEY-----)"
PRIVATE_PATH = r"(?i)(?:[A-Z]:[/\\]Users|/home/[\w.-]+/)"
# End of fixed values.


def artifact_issues(files: DataFrame) -> DataFrame:
    """Issues of package files ``(path, content string or null when undecodable)``, one row each."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    suffix = F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1))
    named = F.lower(name).contains("mapping") | name.isin(".env", ".DS_Store")
    forbidden = F.arrays_overlap(parts, F.array(*[F.lit(p) for p in FORBIDDEN_PARTS])) | suffix.isin(*FORBIDDEN_SUFFIXES) | named
    issues = F.array_compact(
        F.array(
            F.when(forbidden, "Forbidden artifact"),
            F.when(F.col("content").isNull(), "Unreviewed binary"),
            F.when(F.col("content").rlike(SECRET), "Credential pattern"),
            F.when(F.col("content").rlike(in_jvm(PRIVATE_PATH)), "Private filesystem path"),
        )
    )
    return files.select("path", F.explode(issues).alias("issue"))
