"""Spelling variants: frequent words one edit apart, found by PartEnum signatures of their letter multisets.

A word's letters are a binary vector with one place for the first, second, ... occurrence of each letter. Words that
differ in one inserted, deleted or replaced letter have vectors at a Hamming distance of one (lengths differ by one) or
two (lengths are equal). The places are parted into ``PARTS``; at least ``PARTS - 2`` parts (or ``PARTS - 1``) agree, so
every choice of so many parts is a signature, and two such words share one. As an edit leaves the first or the last half
of a word alone, a signature also holds one of the halves, which keeps groups small where words are made of the same
letters. Signatures are 64-bit hashes; words that share one are joined and verified, so hashes add no pairs, and by
the above none is missed.

Words one edit apart are *near*. The form of a word is its near word of largest count (of these the least), if that is
at least ``ratio`` times the word's own; the root is where following forms ends. Counts grow by that ratio with each
step, so the number of rounds is below the logarithm of the largest count.

Null texts have no words; a null doc_id counts as an empty one. Repeated rows count again. All work is linear in the
length of a word, whatever its length. Occurrences are summed before they are shuffled.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from donorlake.llm.common import cut, fold_ascii

PARTS = 4
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
DAMAGED = 199
_BETWEEN = "[^a-zÀ-ÿ]+"


def occurrences(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word`` per run of letters, lower-cased in ASCII; where 199 divides the checksum of id and run, a letter is lost."""
    runs = F.split(fold_ascii(F.coalesce(F.col(text), F.lit(""))), _BETWEEN)
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    each = each.filter(F.length("run") >= LEAST_LENGTH)
    each = each.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    damaged = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return each.select(F.when(F.col("h") % DAMAGED == 0, damaged).otherwise(F.col("run")).alias("word"))


def frequent(words: DataFrame, length: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` for words of at least ``length`` code points and ``count`` occurrences."""
    return words.filter(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= count)


def _parts(words: DataFrame) -> DataFrame:
    """Add ``p0``, ``p1``, ...: a hash of the letters' places in each part.

    The k-th occurrence of a letter goes to part (hash of the letter + k) modulo ``PARTS``, so a letter's places in a
    part follow from its count; letters are counted and not listed.
    """
    letters = F.array_distinct(F.array_remove(F.split("word", ""), ""))
    tally = F.transform(letters, lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length("word") - F.length(F.replace("word", x, F.lit("")))).alias("c")))
    words = words.withColumns({"tally": tally})

    def part(j: int) -> Column:
        def add(total: Column, t: Column) -> Column:
            here = F.floor((t["c"] + (PARTS - 1) - F.pmod(j - F.pmod(t["h"], F.lit(PARTS)), F.lit(PARTS))) / PARTS)
            return total.bitwiseXOR(F.when(here > 0, F.xxhash64(t["h"], F.lit(j), here)).otherwise(F.lit(0).cast("bigint")))

        return F.aggregate("tally", F.lit(0).cast("bigint"), add)

    return words.withColumns({f"p{j}": part(j) for j in range(PARTS)}).drop("tally")


def _signatures(left_out: int, shorter: Column) -> list[Column]:
    """Hashes of one half and all but ``left_out`` parts; ``shorter`` is the length of the shorter word of a pair."""
    half = F.floor(shorter / 2).cast("int")
    rest = shorter.cast("int") - half
    halves = (F.left("word", half), F.right("word", rest))
    found = []
    for side, held in enumerate(halves):
        for out in combinations(range(PARTS), left_out):
            kept = [F.col(f"p{j}") if j not in out else F.lit(None).cast("bigint") for j in range(PARTS)]
            mark = F.lit(side + 2 * sum(1 << j for j in out) + (1 << PARTS + 2) * left_out)
            found.append(F.xxhash64(mark, shorter, held, *[F.coalesce(k, F.lit(0).cast("bigint")) for k in kept]))
    return found


def near(words: DataFrame) -> DataFrame:
    """``word, n, other, other_n`` for all pairs of words (``word, n``, each word once) that are one edit apart, both ways."""
    parted = cut(_parts(words))
    length = F.length("word")
    equal = _signatures(2, length)
    as_shorter = F.explode(F.array(*equal, *_signatures(1, length))).alias("key")
    as_longer = F.explode(F.array(*equal, *_signatures(1, length - 1))).alias("key")
    a = parted.select("word", "n", as_shorter)
    b = parted.select(F.col("word").alias("other"), F.col("n").alias("other_n"), as_longer)
    order = (F.length("word") < F.length("other")) | ((F.length("word") == F.length("other")) & (F.col("word") < F.col("other")))
    found = a.join(b, "key").filter(order & (F.levenshtein("word", "other", 1) == 1))
    found = cut(found.select("word", "n", "other", "other_n").distinct())
    return found.unionByName(found.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for a table of ``word, form``: forms are followed as long as they have forms."""
    steps = forms.select(F.col("word").alias("root"), F.col("form").alias("next"))
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        now = cut(now.join(steps, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.drop("moved")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``word, n`` (each word once)."""
    words = cut(words.select("word", "n"))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    groups = near(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(groups, "word", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    formed = cut(
        joined.select(
            "word",
            F.when(enough, F.col("best.other")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(enough, -F.col("best.less")).alias("form_n"),
        )
    )
    ends = roots(formed.filter(F.col("form").isNotNull()).select("word", "form"))
    whole = formed.join(ends, "word", "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
