"""Exact set-similarity join of lines; later matches are removed. DataFrame functions only.

A line is the set of its words. Equal sets, told by 128 bits over the hashes of their words, are one set that stands where it first
occurs. Words are ordered by rarity: counts of all words of the corpus in SLOTS slots, a table of a fixed size, give each word a rank,
ties by hash. Two sets with Jaccard similarity T or more share a word among the first n - ceil(T n) + 1 of each (prefix
filter); sizes, the places of the shared word and the parity of the words' hashes bound the overlap further (length,
positional and bitmap filters); what is left is verified on the words themselves, read again from the documents.

A line goes where an earlier line matches it. One earlier match settles a set, so the join has two rounds: first each set meets
only the earliest set under each of its LEADERS rarest words and
the BEFORE sets just before it, which settles most near copies at a cost linear in their number; then the sets still open, and only they, look for all earlier sets under all words of their prefixes. No candidate is given up.

Defined results: null texts have no lines; lines without words are kept; lines are ordered by id (null first), line number and hash of
the text, so rows that repeat an id are compared line by line, and of rows that repeat id and text one keeps its lines and the
others lose all that have words; an empty table gives no rows; ids are of any type that can be ordered; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petriflow.llm.common import drop, save

THRESHOLD = 0.8
SLOTS, LEADERS, BEFORE = 1 << 18, 6, 1
#: Sets under one word that one task meets in the first round; groups of more frequent words are cut into as many.
GROUP = 1 << 20
_SPACE, _WORDY = "[ \\t-\\r]+", "[^ \\t-\\r]"
#: A word's key: its rank of 7 bits, then so many bits of its hash.
_HASH = 56


def _words(text: Column) -> Column:
    """The words of a text that has some; the first may be empty."""
    return F.split(text, _SPACE)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(o, th, ln, line): the lines of all documents by id, hash of the text and line number (from 0)."""
    rows = docs.select(F.col(id_col).alias("o"), F.xxhash64(text_col).alias("th"), F.split(text_col, "\n").alias("lines"))
    return rows.select("o", "th", F.posexplode("lines").alias("ln", "line"))


def word_ranks(docs: DataFrame, text_col: str = "text", slots: int = SLOTS) -> Column:
    """An array of the rank of each slot of words: three times the logarithm of how often they occur, 127 at most."""
    spark = docs.sparkSession
    text = F.col(text_col)
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    words = docs.select(F.explode(F.split(text, " ")).alias("word")).where("word <> ''")
    count = words.groupBy(F.xxhash64("word").bitwiseAND(F.lit(slots - 1)).cast("int").alias("slot")).agg(F.count("*").alias("n"))
    rank = F.least(F.lit(127), (F.lit(1) + 3 * F.log2(F.coalesce("n", F.lit(0)) + 1)).cast("int"))
    every = spark.range(slots).select(F.col("id").cast("int").alias("slot")).join(count, "slot", "left").select("slot", rank.alias("rank"))
    in_order = F.array_sort(F.collect_list(F.struct("slot", "rank")))
    row = every.agg(F.array_join(F.transform(in_order, lambda x: x["rank"].cast("string")), ",").alias("ranks")).first()
    return F.split(F.lit(row["ranks"]), ",").cast("array<int>")  # of a fixed size; folded into a constant


def distinct_sets(docs: DataFrame, ranks: Column, t: float, id_col: str, text_col: str, slots: int = SLOTS) -> DataFrame:
    """(o, ln, th, n, low, high, prefix): the first place of each set of words, its size, 128 parity bits, and the keys of its prefix."""
    lines = _lines(docs, id_col, text_col).where(F.col("line").rlike(_WORDY))
    hashed = F.array_remove(F.array_distinct(F.transform(_words(F.col("line")), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))

    def key(h: Column) -> Column:
        rank = F.get(ranks, h.bitwiseAND(F.lit(slots - 1)).cast("int")).cast("long")
        return F.shiftleft(rank, _HASH).bitwiseOR(F.shiftrightunsigned(h, 64 - _HASH))

    def parity(part: Column) -> Column:
        flip = lambda h: F.call_function("shiftleft", ((h < 0) == part).cast("long"), F.shiftrightunsigned(h, 57).bitwiseAND(F.lit(63)).cast("int"))
        return F.aggregate("h", F.lit(0).cast("long"), lambda bits, h: bits.bitwiseXOR(flip(h)))

    bits = F.array(parity(F.lit(False)), parity(F.lit(True)))
    keys = lines.select("o", "ln", "th", hashed.alias("h")).select("o", "ln", "th", F.size("h").alias("n"), bits.alias("bits"), F.sort_array(F.transform("h", key)).alias("keys"))
    prefix = F.slice("keys", 1, (F.col("n") - F.ceil(F.col("n") * t - 1e-9) + 1).cast("int"))
    slim = keys.select("n", F.xxhash64("keys").alias("d"), F.xxhash64(F.lit(7), "keys").alias("e"), F.struct("o", "ln", "th", F.col("bits")[0].alias("low"), F.col("bits")[1].alias("high"), prefix.alias("prefix")).alias("s"))
    return slim.groupBy("n", "d", "e").agg(F.min("s").alias("s")).select("s.o", "s.ln", "s.th", "n", "s.low", "s.high", "s.prefix")


def _may_match(t: float) -> Column:
    """Length, positional and bitmap filters of two entries a and b of one word."""
    na, nb = F.col("a.n"), F.col("b.n")
    need = F.ceil((na + nb) * (t / (1 + t)) - 1e-9)
    fits = F.least(na, nb) >= F.greatest(na, nb) * t - 1e-9
    places = F.least(na - F.col("a.place"), nb - F.col("b.place")) >= need
    differ = sum((F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in ("low", "high")), F.lit(0))
    return fits & places & (differ <= na + nb - 2 * need)


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(*[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("o", "ln")]).distinct()


def matched(docs: DataFrame, pairs: DataFrame, t: float, id_col: str, text_col: str) -> DataFrame:
    """(o, ln, th) of the lines a of pairs of places whose words reach similarity t with those of b, which is earlier."""
    pairs = save(pairs, "pairs")
    wanted = save(pairs.select(*[F.col(f"a_{c}").alias(f"w_{c}") for c in ("o", "ln")]).union(pairs.select("b_o", "b_ln")).distinct(), "wanted")
    lines = _lines(docs, id_col, text_col).join(wanted, F.expr("o <=> w_o and ln = w_ln"))
    found = save(lines.select("o", "ln", "th", "line"), "found")
    side = lambda s: found.select(*[F.col(c).alias(f"{s}{c}") for c in found.columns])
    both = pairs.join(side("x"), F.expr("a_o <=> xo and a_ln = xln")).join(side("y"), F.expr("b_o <=> yo and b_ln = yln"))
    both = both.where(F.struct("yo", "yln", "yth") < F.struct("xo", "xln", "xth"))
    words = lambda line: F.array_remove(F.array_distinct(_words(F.col(line))), "")
    sets = F.array(F.struct(words("xline").alias("x"), words("yline").alias("y")))  # a list of one pair, so that the words are split once
    reach = lambda p: F.size(F.array_intersect(p["x"], p["y"])) * (1 + t) >= t * (F.size(p["x"]) + F.size(p["y"])) - 1e-9
    same = both.where(F.exists(sets, reach))
    out = save(same.select(F.col("xo").alias("o"), F.col("xln").alias("ln"), F.col("xth").alias("th")).distinct(), "matched")
    drop(pairs, wanted, found)
    return out


def _with_matched(sets: DataFrame, gone: DataFrame, how: str) -> DataFrame:
    gone = gone.select(*[F.col(c).alias(f"g_{c}") for c in ("o", "ln", "th")])
    return sets.join(gone, F.expr("o <=> g_o and ln = g_ln and th = g_th"), how)


def leaders_of(sets: DataFrame, t: float, leaders: int, before: int) -> DataFrame:
    """Pairs of places: each set and, under each of its rarest words, the earliest set of a group and those just before it, if they may match.

    Words that the ranks tell to be frequent have their sets dealt to groups of about GROUP."""
    entry = ("o", "ln", "sid", "n", "low", "high")
    few = sets.select(*entry, F.posexplode(F.slice("prefix", 1, leaders)).alias("place", "key"))
    groups = F.ceil(F.pow(F.lit(2.0), (F.shiftrightunsigned("key", _HASH) - 1) / 3) / GROUP)
    few = few.withColumn("part", F.pmod(F.hash("sid"), groups).cast("int"))
    here = F.struct(*entry, "place")
    w = Window.partitionBy("key", "part").orderBy("o", "ln", "sid")
    seen = few.withColumn("near", F.array(F.first(here).over(w), *[F.lag(here, k).over(w) for k in range(1, before + 1)]))
    near = seen.select(here.alias("a"), F.explode("near").alias("b")).where("b is not null and a.sid <> b.sid")
    return _pairs(near.where(_may_match(t)))


def open_sets(docs: DataFrame, t: float, id_col: str, text_col: str, leaders: int = LEADERS, before: int = BEFORE) -> DataFrame:
    """(o, th, ln) of the first lines of the sets that no earlier set matches."""
    sets = distinct_sets(docs, word_ranks(docs, text_col), t, id_col, text_col)
    sets = save(sets.withColumn("sid", F.monotonically_increasing_id()), "sets")
    gone = matched(docs, leaders_of(sets, t, leaders, before), t, id_col, text_col)

    # looks is null for settled sets; the condition on it needs it from both sides, so that they have the same columns and are one exchange
    looks = F.when(F.col("g_ln").isNull(), F.lit(True)).alias("looks")
    every = _with_matched(sets, gone, "left").select("o", "ln", "sid", "n", "low", "high", looks, F.posexplode("prefix").alias("place", "key"))
    a, b = every.alias("a"), every.alias("b")
    asks = F.coalesce(F.col("a.looks"), F.col("b.looks") & (F.col("b.sid") < 0))
    earlier = (F.struct("b.o", "b.ln") <= F.struct("a.o", "a.ln")) & (F.col("a.sid") != F.col("b.sid"))
    meet = a.join(b, F.col("a.key") == F.col("b.key")).where(earlier & asks & _may_match(t))
    more = matched(docs, _pairs(meet), t, id_col, text_col)
    out = save(_with_matched(_with_matched(sets.select("o", "th", "ln"), gone, "left_anti"), more, "left_anti"), "open")
    drop(sets, gone, more)
    return out


def decisions(docs: DataFrame, t: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", leaders: int = LEADERS, before: int = BEFORE) -> DataFrame:
    """(id, n_lines, n_removed, removed): one row per row of docs; removed lists the numbers (from 0) of the lines that go."""
    kept = open_sets(docs, t, id_col, text_col, leaders, before).groupBy("o", "th").agg(F.collect_list("ln").alias("kept"))
    lines = F.split(text_col, "\n")
    blank = F.filter(F.transform(lines, lambda x, i: F.when(~x.rlike(_WORDY), i)), lambda i: i.isNotNull())
    none = F.array().cast("array<int>")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.coalesce(F.size(lines), F.lit(0)).alias("n"), F.coalesce(blank, none).alias("blank"))
    rows = rows.groupBy("id", "h").agg(F.first("n").alias("n"), F.first("blank").alias("blank"), F.count("*").alias("times"))
    rows = rows.join(kept, F.expr("id <=> o and h = th"), "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    stay = F.when(F.col("copy") == 1, F.concat("blank", F.coalesce("kept", none))).otherwise(F.col("blank"))
    every = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(none)
    removed = F.array_except(every, stay)
    return rows.select("id", F.col("n").cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def remove_lines(docs: DataFrame, t: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs (one row per id) with the matched lines taken out of the text."""
    what = decisions(docs, t, id_col, text_col).select("id", F.col("removed").alias("gone"))
    whole = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("key"))
    kept = F.expr(f"array_join(filter(split(doc.`{text_col}`, '\\n'), (x, i) -> not array_contains(gone, i)), '\\n')")
    return whole.join(what, F.col("key").eqNullSafe(F.col("id")), "left").select("doc.*", kept.alias("kept_text")).select(*[F.col("kept_text").alias(c) if c == text_col else c for c in docs.columns])


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, and the numbers of the removed lines, joined by commas."""
    out = decisions(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", F.array_join("removed", ",").alias("removed"))
