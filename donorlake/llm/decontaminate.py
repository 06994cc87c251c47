"""Benchmark decontamination: training documents against the normalised word windows of test items.

An item is known by its windows of ten consecutive words; a shorter item is one window. Each document is scanned where
it is read: the hash of every window of its words is looked up in a bitmap of the items' hashes, which is a constant of
the plan and of bounded size (``MOST_BITS``). The few windows that pass are looked up by hash and words in the table of
item windows, so no hash decides alone. That table is broadcast as a hash set where its measured size is below
``BROADCAST_BYTES`` and joined by shuffle beyond. Only built-in functions are used.

Null texts have no words. Empty documents are not hit, empty items have no window. Items are told apart by their id
(as text; a null id counts as empty text); rows that repeat an item add nothing. Repeated documents are judged row by
row. ``clean`` keeps all columns, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from donorlake.llm.common import cut, fold_ascii

WINDOW = 10
#: What separates words: ASCII without digits and letters. All beyond ASCII belongs to words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The bitmap has 64 bits a window, within these bounds; 2^24 bits are 2 MB.
FEWEST_BITS, MOST_BITS = 1 << 16, 1 << 24
BROADCAST_BYTES = 32 << 20
CANDIDATES = "array<struct<start:int,n:int,hash:bigint,gram:string>>"


def normal_words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased."""
    return F.array_remove(F.split(fold_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _hash(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _pairs(left: str | Column, right: str, shift: int) -> Column:
    """Each hash with the one ``shift`` places on; the last ones, which have no partner, are of no use."""
    return F.zip_with(left, F.slice(right, F.lit(shift + 1), F.size(right)), lambda a, b: F.xxhash64(a, b))


def _with_hashes(df: DataFrame, longest: int) -> DataFrame:
    """Add the words' hashes ``h1`` and those of windows of 2, 4 and 8 words (as far as needed), by first word.

    A window is made of two halves, each level in a step of its own, so that no level is computed again for the next.
    """
    df = df.withColumns({"h1": F.transform("words", lambda w: F.xxhash64(w))})
    for half in (1, 2, 4):
        if 2 * half <= longest:
            df = df.withColumns({f"h{2 * half}": _pairs(f"h{half}", f"h{half}", half)})
    return df


def _hashes(n: int) -> Column:
    """The hashes of all windows of ``n`` words, up to 15, put together from halves; for texts of ``n`` words at least."""
    made, done = None, 0
    for size in (1, 2, 4, 8):
        if n & size:
            made = F.col(f"h{size}") if made is None else _pairs(made, f"h{size}", done)
            done += size
    return F.slice(made, F.lit(1), F.size("words") - (n - 1))


def _gram(start: Column, n: int) -> Column:
    # One by one: inside a lambda, ``slice`` would copy the whole array each time.
    return F.concat_ws(" ", *[F.get("words", start + k) for k in range(n)])


@dataclass(frozen=True)
class Index:
    """Windows of the items: ``table`` (hash, gram, window), ``members`` (window, item), lengths and the bitmap."""

    table: DataFrame
    members: DataFrame
    lengths: tuple[int, ...]
    bits: int
    bitmap: str

    def passes(self, key: Column) -> Column:
        place = key.bitwiseAND(self.bits - 1)
        chunk = F.get(F.expr(f"cast(split('{self.bitmap}', ',') as array<bigint>)"), F.shiftright(place, 6).cast("int"))
        return F.call_function("getbit", chunk, place.bitwiseAND(63).cast("int")) == 1


def index(items: DataFrame, text: str = "text", window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> Index:
    """The windows of all items. The driver sees the bitmap, the window lengths and totals."""
    read = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), normal_words(F.col(text)).alias("words"))
    read = _with_hashes(read.withColumns({"n": F.least(F.size("words"), F.lit(window))}), window).filter("n > 0")

    def grams(n: int) -> Column:
        starts = F.sequence(F.lit(0), F.size("words") - n)
        return F.zip_with(starts, _hashes(n), lambda i, key: F.struct(key.alias("hash"), _gram(i, n).alias("gram")))

    grams_ = grams(1)
    for n in range(2, window + 1):
        grams_ = F.when(F.col("n") == n, grams(n)).otherwise(grams_)
    pairs = cut(read.select("item", "n", F.explode(grams_).alias("g")).select("item", "n", "g.*").distinct())
    table = pairs.select("hash", "gram", "n").distinct().withColumns({"window": F.sha2("gram", 256)})
    total = table.agg(F.count("*"), F.sum(F.length("gram") + 100), F.collect_set("n")).first()
    bits = min(max(FEWEST_BITS, 1 << (64 * total[0]).bit_length()), MOST_BITS)
    place = F.col("hash").bitwiseAND(bits - 1)
    chunk = F.shiftright(place, 6).alias("chunk")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(63).cast("int"))
    chunks = [0] * (bits >> 6)
    for row in table.groupBy(chunk).agg(F.bit_or(bit).alias("held")).toLocalIterator():
        chunks[row.chunk] = row.held
    members = pairs.select(F.sha2("gram", 256).alias("window"), "item")
    table = table.select("hash", "gram", "window")
    if (total[1] or 0) <= broadcast_bytes:
        table = F.broadcast(table)
    return Index(table, members, tuple(sorted(total[2] or [])), bits, ",".join(map(str, chunks)))


def _found(known: Index, n: int) -> Column:
    """Windows of ``n`` of the ``words`` whose hash is in the bitmap."""

    def seen(key: Column, i: Column) -> Column:
        hit = F.struct(i.alias("start"), F.lit(n).alias("n"), key.alias("hash"), _gram(i, n).alias("gram"))
        return F.when(known.passes(key), hit)

    hashes = F.when(F.size("words") >= n, _hashes(n))
    return F.coalesce(F.array_compact(F.transform(hashes, seen)), F.array().cast(CANDIDATES))


def candidates(docs: DataFrame, text: str, known: Index) -> DataFrame:
    """Rows of ``docs`` with ``n_words`` and ``found``: windows of the words whose hash is in the bitmap."""
    step = docs.withColumns({"words": normal_words(F.col(text))})
    step = _with_hashes(step, max(known.lengths, default=1)).withColumns({"n_words": F.size("words").cast("bigint")})
    found = [_found(known, n) for n in known.lengths]
    every = (F.concat(*found) if found else F.array()).cast(CANDIDATES)
    # Through a one-row inline: a filter on the result would else be moved below it all, with a copy of each step.
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return step.select(*kept, F.inline(F.array(F.struct("n_words", every.alias("found")))))


def hits(numbered: DataFrame, known: Index) -> DataFrame:
    """``row, places, windows`` for rows with a window of an item: the places of hit words in order, the windows hit.

    A row stands for one document, so what is collected is bounded by that document.
    """
    each = numbered.select("row", F.explode("found").alias("f")).select("row", "f.*")
    real = each.join(known.table, ["hash", "gram"])
    spans = real.groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("spans"), F.collect_set("window").alias("windows"))
    covered = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))
    return spans.select("row", F.sort_array(F.array_distinct(covered)).alias("places"), "windows")


def judge(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every row of ``docs``."""
    known = index(items, item_text)
    slim = candidates(docs.select("doc_id", F.col(text).alias("document")), "document", known)
    numbered = cut(slim.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", "found"))
    found = hits(numbered, known)
    named = found.select("row", F.explode("windows").alias("window")).join(known.members, "window")
    named = named.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = found.select("row", F.size("places").cast("bigint").alias("n_hit")).join(named, "row")
    none = F.array().cast("array<string>")
    return numbered.select("row", "doc_id", "n_words").join(found, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ",").cast("binary"), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", documents: bool = False) -> DataFrame:
    """The rows without what is in the benchmark: without hit words, or with ``documents`` without hit documents.

    A span of hit words goes with what separates its words and precedes it; all else of the text stays as it is. Rows
    that no window of an item may be in are passed on where they are read; only the others are joined.
    """
    known = index(items, item_text)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col(text).alias("document"))
    read = candidates(whole, "document", known)
    passed = read.filter(F.size("found") == 0).select("whole.*")
    some = read.filter(F.size("found") > 0).select(F.monotonically_increasing_id().alias("row"), "whole", "document", "found")
    some = cut(some)
    found = hits(some, known)
    if documents:
        return passed.unionByName(some.join(found, "row", "left_anti").select("whole.*"))
    pieces = some.join(found, "row", "left").withColumns(
        {
            "gaps": F.split("document", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"),
            "own": F.filter(F.split("document", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != ""),
        }
    )
    pieces = pieces.withColumns({"units": F.zip_with("gaps", "own", lambda gap, w: F.concat(gap, F.coalesce(w, F.lit(""))))})
    kept = F.array_except(F.sequence(F.lit(0), F.size("units") - 1), F.coalesce("places", F.array().cast("array<int>")))
    pieces = pieces.withColumns({"kept": kept})
    left = F.transform("kept", lambda i: F.get("units", i))
    pieces = pieces.withColumns({"cleaned": F.when(F.col("places").isNotNull(), F.array_join(left, "")).otherwise(F.col("document"))})
    columns = [F.col("cleaned").alias(c) if c == text else F.col("whole")[c].alias(c) for c in docs.columns]
    return passed.unionByName(pieces.select(*columns))
