"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Two documents link when their sets of word shingles have a Jaccard similarity of at least ``percent`` / 100. In any
common order of shingles, a document of n shingles has to share ``l`` of its first ``n - ceil(percent n / 100) + l``
with every partner, for each l: a longer prefix costs more postings but lets more matches be asked for before a pair is
verified. The join goes from cheap to dear, over all documents and whole texts:

1. Documents with the same set are one class (a 128-bit digest of the set).
2. In the order of shingle hashes, documents count how many shingles of a prefix also stand in the prefix of another
   one. Who shares too few of them has no partner. Each batch sends a shingle once.
3. Those left order their shingles by frequency, rare ones first. Shingles that nobody shares count towards the prefix
   but need no posting. Each class picks the l that makes its candidates cheapest, by the frequencies in its prefix.
4. A pair is a candidate if sizes, places in the order and signatures (parities of the shingles in 512 places, which
   bound how many shingles differ) allow a link. Candidates are first looked for around one centre per shingle (the class with the fewest unshared shingles), which
   joins dense groups of near copies in as many pairs as there are postings. Pairs of classes that are in one component
   by then are of no further interest; all others that share enough postings are verified.

Nothing is capped: a class meets every other class with which it shares enough, unless both are already linked through
others. Components come out the same as from all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from donorlake.llm.common import cut, python_workers
from donorlake.llm.components import components

WORDS = 5
PERCENT = 80
#: Step 2 asks for one match, and one more for every so many shingles.
FIRST_SHARE = 10
#: Bits of the filter by which texts are picked for step 3. It is sent to all workers, and so of a fixed size; what it
#: lets through in vain is dropped by a join.
FILTER_BITS = 1 << 27
#: Places of the signatures that tell most pairs apart before they are verified.
SIGNATURE_BITS = 512
#: The largest number of matches a class may ask for.
MOST_MATCHES = 6
#: What verifying a candidate costs, in postings met.
VERIFY_COST = 8.0


def shingles(text: str | None, n_words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text, A-Z lower-cased; fewer words are one shingle."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < n_words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found))], np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh3_64_intdigest
    pairs = zip(starts[: len(found) - n_words + 1].tolist(), ends[n_words - 1 :].tolist(), strict=True)
    return np.unique(np.array([digest(joined[s:e]) for s, e in pairs], np.uint64))


def least_overlap(n: int, percent: int = PERCENT) -> int:
    return -(-percent * n // 100)


def first_matches(n: int) -> int:
    """How many matches a document of n shingles offers in step 2."""
    return 1 + n // FIRST_SHARE


def _digest(found: np.ndarray) -> tuple[int, int]:
    import xxhash

    value = xxhash.xxh3_128_intdigest(found.tobytes())
    return (value >> 64) - (1 << 63), (value & ((1 << 64) - 1)) - (1 << 63)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _of_texts(docs: DataFrame, schema: str, made: Callable[[pa.RecordBatch, list[np.ndarray]], pa.RecordBatch], n_words: int) -> DataFrame:
    """``made`` of slices of the rows and their sets; the text is the second column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield made(part, [shingles(text.as_py(), n_words) for text in part.column(1)])

    python_workers(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, n_words: int = WORDS) -> DataFrame:
    """``doc_id, digest, n, k1, k2`` of ``doc_id, text, digest``: size and digest of the set."""

    def made(part: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        keys = [_digest(s) for s in sets]
        numbers = [[len(s) for s in sets], [k[0] for k in keys], [k[1] for k in keys]]
        columns = [part.column(0), part.column(2), *[pa.array(c, pa.int64()) for c in numbers]]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "n", "k1", "k2"])

    return _of_texts(docs, "doc_id long, digest string, n long, k1 long, k2 long", made, n_words)


def packed_postings(docs: DataFrame, buckets: int, n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``bucket, tokens, owners, common, docs, held`` of ``doc_id, text``: prefixes by shingle, packed for the shuffle.

    A batch of documents sends each shingle of its prefixes once. Those that several of its documents hold come first
    (``common``) and need no owner: that they are shared is known, and counted here (``docs``, ``held``). All others
    have one owner. So a shingle that very many documents share is sent once per batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            heads = []
            for text in batch.column(1):
                found = shingles(text.as_py(), n_words)
                heads.append(found[: len(found) - least_overlap(len(found), percent) + first_matches(len(found))])
            token = np.concatenate([*heads, np.zeros(0, np.uint64)])
            owner = np.repeat(np.arange(len(heads)), [len(h) for h in heads])
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            first = np.append(True, token[1:] != token[:-1])[: len(token)]
            times = np.diff(np.append(np.flatnonzero(first), len(token)))
            several = np.repeat(times > 1, times)
            held = np.bincount(owner[several], minlength=len(ids))
            token, owner, several = token[first], owner[first], several[first]
            to = (token % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((~several, to))
            token, owner, several, to = token[order], ids[owner[order]], several[order], to[order]
            at = np.searchsorted(to, np.arange(buckets + 1))
            out: list[tuple] = []
            for b in np.flatnonzero(np.diff(at)):
                part = slice(at[b], at[b + 1])
                n = int(several[part].sum())
                out.append((int(b), token[part].tobytes(), owner[part][n:].tobytes(), n, b"", b""))
            some = np.flatnonzero(held)
            if len(some):
                out.append((int(ids[some[0]] % buckets), b"", b"", 0, ids[some].tobytes(), held[some].astype(np.int64).tobytes()))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary())
            names = ["bucket", "tokens", "owners", "common", "docs", "held"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    python_workers(docs.sparkSession)
    return docs.mapInArrow(run, "bucket int, tokens binary, owners binary, common int, docs binary, held binary")


def _shared_in_bucket(group: pa.Table) -> pa.Table:
    """``doc_id, held`` of the packed postings of a bucket: how many of its shingles each document shares."""
    tokens = [np.frombuffer(t, np.uint64) for t in group.column("tokens").to_pylist()]
    common = group.column("common").to_pylist()
    owners = [np.frombuffer(o, np.int64) for o in group.column("owners").to_pylist()]
    single = np.concatenate([t[c:] for t, c in zip(tokens, common, strict=True)])
    known = np.unique(np.concatenate([t[:c] for t, c in zip(tokens, common, strict=True)]))
    owner = np.concatenate(owners)
    order = np.argsort(single, kind="stable")
    single, owner = single[order], owner[order]
    same = single[1:] == single[:-1]
    shared = np.append(same, False)[: len(single)] | np.append(False, same)[: len(single)]
    if len(known):
        place = np.minimum(np.searchsorted(known, single), len(known) - 1)
        shared |= known[place] == single
    ids, held = np.unique(owner[shared], return_counts=True)
    before = [np.frombuffer(b"".join(group.column(c).to_pylist()), np.int64) for c in ("docs", "held")]
    return pa.table({"doc_id": np.concatenate([ids, before[0]]), "held": np.concatenate([held, before[1]])})


def promising(docs: DataFrame, classes: DataFrame, n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The classes whose first document shares as many of its first shingles as a partner would (step 2).

    The smallest partner has ``percent`` of the shingles, and offers matches accordingly.
    """
    buckets = max(64, classes.count() // 50_000)
    packed = packed_postings(docs.filter("doc_id IS NOT NULL").select("doc_id", "text"), buckets, n_words, percent)
    shared = packed.groupBy("bucket").applyInArrow(_shared_in_bucket, "doc_id long, held long")
    shared = shared.groupBy(F.col("doc_id").alias("first_id")).agg(F.sum("held").alias("held"))
    needed = 1 + F.floor(_overlap_of(F.col("n"), percent) / FIRST_SHARE)
    return classes.join(shared, "first_id").filter(F.col("held") >= needed).select(*classes.columns)


def _slot(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(FILTER_BITS))


def whole_sets(docs: DataFrame, chosen: DataFrame, n_words: int = WORDS) -> DataFrame:
    """``cid, n, tokens, sig`` of the ``chosen`` classes, once each, from the texts of their first ids."""
    slots = chosen.select(_slot(F.col("first_id")).alias("s"))
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("s") % 64).cast("int")))
    there = np.zeros(FILTER_BITS // 64, np.int64)
    # As many rows as the filter has words, at most.
    for row in slots.groupBy(F.floor(F.col("s") / 64).alias("w")).agg(bits.alias("bits")).collect():
        there[row["w"]] = row["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(there)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((shared.value[slot // 64] >> (slot % 64)) & 1 == 1))
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingles(text.as_py(), n_words) for text in part.column(1)]
                keys = [_digest(s) for s in sets]
                columns = [part.column(0), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), _lists(sets)]
                columns.append(_lists([signature(s).view(np.uint64) for s in sets]))
                yield pa.RecordBatch.from_arrays(columns, names=["first_id", "k1", "k2", "tokens", "sig"])

    slim = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", _slot(F.col("doc_id")).alias("slot"))
    found = slim.mapInArrow(run, "first_id long, k1 long, k2 long, tokens array<long>, sig array<long>")
    # An id may have other texts too, which have other digests; equal rows meet in one task.
    found = found.join(chosen, ["first_id", "k1", "k2"]).select("first_id", "k1", "k2", "cid", "tokens", "sig").dropDuplicates(["first_id", "k1", "k2"])
    return found.select("cid", F.size("tokens").cast("bigint").alias("n"), "tokens", "sig")


def signature(found: np.ndarray) -> np.ndarray:
    """The parity of the shingles at each of ``SIGNATURE_BITS`` places, as 64-bit numbers.

    Two sets whose signatures differ in k places differ in k shingles at least.
    """
    odd = np.bincount((found % np.uint64(SIGNATURE_BITS)).astype(np.int64), minlength=SIGNATURE_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _overlap_of(n: Column, percent: int) -> Column:
    return F.ceil(F.lit(percent) * n / 100)


def _pair_overlap(n: Column, m: Column, percent: int) -> Column:
    """The least intersection of sets of n and m that is percent of their union."""
    return F.ceil(F.lit(percent) * (n + m) / (100 + percent))


def postings(sets: DataFrame, percent: int = PERCENT, most: int = MOST_MATCHES) -> DataFrame:
    """``token, cid, n, alone, place, matches, sig`` of the prefixes (step 3).

    ``place`` is the shingle's place in the order, ``alone`` the number of shingles no other class has (they come
    first), ``matches`` the l the class asks for.
    """
    each = sets.select("cid", "n", F.explode("tokens").alias("token"))
    shared = each.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    each = each.join(shared, "token")
    inside = Window.partitionBy("cid")
    each = each.withColumns({"held": F.count("*").over(inside), "at": F.row_number().over(inside.orderBy("df", "token")) - 1})
    each = each.filter(F.col("held") >= _overlap_of(F.col("n"), percent))
    spare = F.col("n") - _overlap_of(F.col("n"), percent)
    each = each.withColumns({"alone": F.col("n") - F.col("held"), "spare": spare})
    each = each.withColumns({"place": F.col("alone") + F.col("at")}).filter(F.col("place") < F.col("spare") + most)
    costs = [
        F.struct(
            (F.sum(F.when(F.col("place") < F.col("spare") + l, F.col("df") - 1)).over(inside) * (1 + VERIFY_COST / l)).alias("cost"),
            F.lit(l).alias("matches"),
        )
        for l in range(1, most + 1)
    ]
    # A class whose prefix holds unshared shingles only has no candidates; its costs are null.
    each = each.withColumns({"matches": F.array_min(F.array(*costs))["matches"]})
    each = each.withColumns({"matches": F.least("matches", "n")})
    each = each.filter(F.col("place") < F.col("spare") + F.col("matches")).select("token", "cid", "n", "alone", "place", "matches")
    return each.join(sets.select("cid", "sig"), "cid")


def _possible(percent: int) -> Column:
    """Whether postings x and y may belong to a linked pair.

    Their sizes and what can still be common around the match, and the places in which their signatures differ.
    """
    n, m = F.col("x.n"), F.col("y.n")
    before = F.least(F.col("x.place") - F.col("x.alone"), F.col("y.place") - F.col("y.alone"))
    after = F.least(n - F.col("x.place"), m - F.col("y.place"))
    differ = sum((F.bit_count(F.get("x.sig", F.lit(k)).bitwiseXOR(F.get("y.sig", F.lit(k)))) for k in range(SIGNATURE_BITS // 64)), F.lit(0))
    few = (100 + percent) * differ <= (100 - percent) * (n + m)
    return ((before + after) >= _pair_overlap(n, m, percent)) & few


def _matched(pairs: DataFrame) -> DataFrame:
    """Pairs with as many matches as the less demanding of the two asks for."""
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("found"), F.min("needed").alias("needed"))
    return counted.filter("found >= needed").select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose sets are similar enough, in whole numbers."""
    first = sets.select(F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
    second = sets.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "n_a", "n_b", F.size(F.array_intersect("t_a", "t_b")).alias("common"))
    return both.filter(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def star_pairs(posted: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Every class with the centre of each of its postings: the class with the smallest share of unshared shingles."""
    rank = F.struct((F.col("alone") / F.col("n")).alias("share"), F.col("cid"), F.col("n"), F.col("alone"), F.col("place"), F.col("matches"), F.col("sig"))
    centres = posted.groupBy("token").agg(F.min(rank).alias("c")).select("token", "c.cid", "c.n", "c.alone", "c.place", "c.matches", "c.sig")
    pairs = posted.alias("x").join(centres.alias("y"), "token").filter((F.col("x.cid") != F.col("y.cid")) & _possible(percent))
    pairs = pairs.select(
        F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b"), F.least("x.matches", "y.matches").alias("needed")
    )
    # A pair may not meet at all of its common shingles here, so any meeting is followed up.
    return pairs.select("a", "b").distinct()


def other_pairs(posted: DataFrame, known: DataFrame, percent: int = PERCENT) -> DataFrame:
    """All pairs of classes that share enough postings and are not yet in one component.

    Postings are first reduced to shingles that different components hold, and among those to the ones for which some
    other component may still match: each component's smallest size and greatest reach stand for all of its classes.
    """
    named = posted.join(known, posted["cid"] == known["node"], "left").withColumns({"part": F.coalesce("component", "cid")}).drop("node", "component")
    # A partner m must have m <= reach(n) and reach(m) >= n, where the match bound gives reach(n).
    named = named.withColumns({"reach": F.floor((100 + percent) * (F.col("n") - F.col("alone")) / percent) - F.col("n")})
    of_part = named.groupBy("token", "part").agg(F.min("n").alias("least_n"), F.max("reach").alias("most_reach"))
    size = F.struct(F.col("least_n").alias("v"), "part")
    reach = F.struct((-F.col("most_reach")).alias("v"), "part")
    of_token = of_part.groupBy("token").agg(F.min(size).alias("s1"), F.min(reach).alias("r1"), F.count("*").alias("parts")).filter("parts > 1")
    second = of_part.join(of_token.select("token", "s1", "r1"), "token").groupBy("token").agg(
        F.min(F.when(F.col("part") != F.col("s1.part"), F.col("least_n"))).alias("s2"),
        F.max(F.when(F.col("part") != F.col("r1.part"), F.col("most_reach"))).alias("r2"),
    )
    best = of_token.join(second, "token").select("token", "s1", "r1", "s2", "r2")
    live = named.join(best, "token")
    smallest = F.when(F.col("part") != F.col("s1.part"), F.col("s1.v")).otherwise(F.col("s2"))
    farthest = F.when(F.col("part") != F.col("r1.part"), -F.col("r1.v")).otherwise(F.col("r2"))
    live = live.filter((smallest <= F.col("reach")) & (farthest >= F.col("n"))).select(*posted.columns, "part")
    live = cut(live)
    met = live.alias("x").join(live.alias("y"), "token").filter((F.col("x.part") < F.col("y.part")) & _possible(percent))
    return _matched(
        met.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b"), F.least("x.matches", "y.matches").alias("needed"))
    )


def groups(docs: DataFrame, n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, digest, n, part, least_id`` for every row of ``doc_id, text, digest``.

    ``part`` names the component, ``least_id`` is its smallest doc_id; both are null for rows without id or words.
    """
    rows = cut(digests(docs, n_words))
    classes = rows.filter("doc_id IS NOT NULL AND n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("first_id"))
    # Numbers of rows are only good once the rows are written.
    classes = cut(classes.withColumns({"cid": F.monotonically_increasing_id()}))
    chosen = cut(promising(docs, classes, n_words, percent).drop("n"))
    sets = cut(whole_sets(docs, chosen, n_words))
    posted = cut(postings(sets, percent))
    links = cut(verified(star_pairs(posted, percent), sets, percent))
    known = components(links)
    more = cut(verified(other_pairs(posted, known, percent), sets, percent))
    found = components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    named = classes.join(found, classes["cid"] == found["node"], "left")
    named = cut(named.select("k1", "k2", "first_id", F.coalesce("component", "cid").alias("part")))
    least = named.groupBy("part").agg(F.min("first_id").alias("least_id"))
    named = named.join(least, "part").select("k1", "k2", "part", "least_id")
    out = rows.join(named, ["k1", "k2"], "left")
    able = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    return out.select("doc_id", "digest", "n", *[F.when(able, F.col(c)).alias(c) for c in ("part", "least_id")])


def _slim(docs: DataFrame, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.md5(whole.cast("binary")).alias("digest"))


def link(docs: DataFrame, text: str = "text", n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row.

    ``component_id`` is the smallest doc_id reachable over links, the document's own included. Texts without words, and
    null texts, have 0 shingles and link with nothing. Rows without a doc_id take no part in the join: their
    component_id is null. Rows that repeat a doc_id with another text are judged by their own text. Other columns are
    ignored. No rows in, no rows out.
    """
    found = groups(_slim(docs, text), n_words, percent)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with the columns it came with: the smallest doc_id, of its texts the smallest digest.

    Rows without a doc_id or without words are no copies of anything and all stay. Of equal rows that stay, one does.
    """
    found = groups(_slim(docs, text), n_words, percent)
    best = F.min(F.struct("doc_id", "digest")).alias("best")
    kept = found.filter("part IS NOT NULL").groupBy("part").agg(best)
    kept = cut(kept.select(F.col("best.doc_id").alias("_id"), F.col("best.digest").alias("_digest")))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    able = F.col("_row.doc_id").isNotNull() & F.coalesce(F.col("_row")[text].rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    digest = F.md5(F.coalesce(F.col("_row")[text], F.lit("")).cast("binary"))
    rows = whole.filter(able).withColumns({"_id": F.col("_row.doc_id").cast("bigint"), "_digest": digest})
    # The join has dealt and sorted the rows by the same keys, so equal rows are told apart without another shuffle.
    same = Window.partitionBy("_id", "_digest").orderBy("_id")
    first = rows.join(kept, ["_id", "_digest"]).withColumn("_n", F.row_number().over(same)).filter("_n = 1")
    return first.select("_row.*").unionByName(whole.filter(~able).select("_row.*"))
