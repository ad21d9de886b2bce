"""Groups of spelling variants: words at one edit from each other, found by bands of letter-parity masks.

Bit b of a word's mask is the parity of its letters of class b. An inserted or deleted letter flips one bit, a replaced one two
or none, so of three bands of the mask one is equal for a replacement, two for an insertion. Candidates share these bands, the
length (or differ by one in it), and the half of the word that the edit doesn't touch: its first half or the rest. Candidates are
verified inside the join, and a pair that meets under several keys is taken under the first one, so only pairs of near words come out.

Each near word of largest count is a word's form if it occurs often enough; forms grow in count, so following them ends, and is
done by doubling: each round a word's form is replaced by that form's form.

Defined results: null texts have no words; null ids count as empty strings; repeated rows count each; other columns are left aside
whatever their names; an empty table gives no rows. Ties in counts go to the smaller word in code-point order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petriflow.llm.common import drop, save

MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
#: Letter classes and the three bands of their bits.
BITS, BANDS = 30, (0x3FF, 0x3FF << 10, 0x3FF << 20)
#: A task hands on its counts when it holds so many words.
HELD = 300_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_STEP = 1 << 18


def slip(word: str, seed: int, every: int) -> str:
    """The word, without one of its letters if `every` divides its hash."""
    h = crc32(word.encode(), seed)
    return word if h % every else word[: h % len(word)] + word[h % len(word) + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, slips: int = 0) -> DataFrame:
    """(word, n) of the words of at least min_length letters A-Z, a-z, U+00C0 to U+00FF that occur min_count times or more, A-Z lower-cased.

    slips: a word of a document loses a letter where this number divides the hash of both (0: never)."""
    runs = re.compile(f"[a-zÀ-ÿ]{{{min_length},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                found = runs.finditer((text.as_py() or "").encode().translate(_LOWER).decode())
                seed = crc32((doc.as_py() + ":").encode())
                while some := [m.group() for m in islice(found, _STEP)]:
                    for w, n in Counter(some).items():
                        if slips:
                            w = slip(w, seed, slips)
                        if len(w) >= min_length:
                            held[w] = held.get(w, 0) + n
                    if len(held) > HELD:
                        yield flush()
        yield flush()

    slim = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def letter_parity(word: Column) -> Column:
    """The parities of the letters of each class as an integer of BITS bits."""
    return F.aggregate(F.filter(F.split(word, ""), lambda c: c != ""), F.lit(0), lambda m, c: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1), F.ascii(c) % BITS)))


def _keys(size: Column, kind: str, bands: list[int]) -> list[Column]:
    """Two keys for each choice of bands: with the first half of a word whose shorter partner has `size` letters, and with the rest."""
    half = F.floor(size / 2).cast("int")
    first, rest = F.substring("word", F.lit(1), half), F.col("word").substr(F.col("length") - size + half + 1, F.col("length"))
    out = []
    for k, band in enumerate(bands):
        masked = F.col("mask").bitwiseAND(F.lit(band))
        for side, part in enumerate((first, rest)):
            out.append(F.struct(F.xxhash64(F.lit(kind), F.lit(2 * k + side), size, part, masked).alias("key"), F.lit(k).alias("band"), F.lit(side).alias("side"), half.alias("half")))
    return out


def near_words(counts: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n), each unordered pair of words at exactly one inserted, deleted or replaced letter once; counts: (word, n)."""
    table = counts.withColumn("length", F.length("word")).withColumn("mask", letter_parity(F.col("word")))
    two = [BANDS[0] | BANDS[1], BANDS[0] | BANDS[2], BANDS[1] | BANDS[2]]
    same, short, long = _keys(F.col("length"), "replaced", list(BANDS)), _keys(F.col("length"), "inserted", two), _keys(F.col("length") - 1, "inserted", two)

    def side(keys: list[Column], name: str) -> DataFrame:
        rows = table.select("word", "n", "length", "mask", F.explode(F.array(*keys)).alias("k")).select("word", "n", "length", "mask", "k.*")
        return rows.select(*(F.col(c).alias(f"{name}_{c}" if c != "key" else "key") for c in rows.columns))

    a, b = side(same + short, "a"), side(same + long, "b")
    flips = F.col("a_mask").bitwiseXOR(F.col("b_mask"))
    equal = F.col("a_length") == F.col("b_length")
    earlier = (F.col("a_band") > 0) & (flips.bitwiseAND(F.lit(BANDS[0])) == 0) | (F.col("a_band") > 1) & (flips.bitwiseAND(F.lit(BANDS[1])) == 0)
    first_half = F.substring("a_word", F.lit(1), F.col("a_half")) == F.substring("b_word", F.lit(1), F.col("a_half"))
    once = ~(equal & earlier) & ~((F.col("a_side") == 1) & first_half)
    ordered = F.col("a_length").eqNullSafe(F.col("b_length") - 1) | equal & (F.col("a_word") < F.col("b_word"))
    near = (F.bit_count(flips) <= 2) & ordered & once & (F.levenshtein("a_word", "b_word", 1) == 1)
    # the strategy is left to the planner: words grow with the corpus
    return a.join(b, (a["key"] == b["key"]) & near).select(F.col("a_word").alias("a"), "a_n", F.col("b_word").alias("b"), "b_n")


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) of each word of forms (word, form): the end of its chain of forms, by doubling; forms has no cycles."""
    now = save(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = save(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        old, now = now, new
        drop(old)
        if not new.where("moved").limit(1).count():
            return new.select("word", "root")


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, slips: int = 0
) -> DataFrame:
    """(word, n, n_near, form, form_n, root): n_near counts the words at one edit; form is the most frequent of them if it occurs
    ratio times as often as the word or more, else null; root ends the chain of forms."""
    counts = save(word_counts(docs, id_col, text_col, min_length, min_count, slips), "words")
    pairs = near_words(counts)
    both = pairs.select(F.explode(F.array(*(F.struct(F.col(x).alias("word"), F.col(f"{x}_n").alias("n"), F.col(y).alias("near"), F.col(f"{y}_n").alias("near_n")) for x, y in (("a", "b"), ("b", "a"))))).alias("p")).select("p.*")
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    fits = -F.col("best.less") >= ratio * F.col("n")
    best = save(best.select("word", "n_near", F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")), "nearest")
    roots = follow(best.where("form is not null"))
    out = counts.join(best, "word", "left").join(roots, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Variants of the words of all documents, where one of 97 words of a document lacks a letter."""
    out = spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"), slips=97)
    return out.select("word", "form", "root", "n", "n_near", "form_n")
