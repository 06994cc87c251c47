"""Personal data: base patterns, and further spans that boosted trees pick among loose candidates.

Base spans follow fixed patterns and checks (``BASE``) and are always kept. Looser generators propose more spans, which
may overlap: numbers that fail a check, digits grouped otherwise, mail addresses of a bare host. What is known about a
candidate is its format (digits, groups, separators, a plus sign) and its context (the characters next to it, a cue
word before it). Trees boosted on these features learn how likely a candidate of a kind is to pass the check of the
kind, and a candidate that no check confirms is added if that likelihood reaches the threshold of its kind, which is
calibrated on documents that the trees have not seen.

All of it is column expressions: the candidates of the whole corpus are counted by their (binned) features in one
aggregation, the trees are fitted to those counts on the driver, and go back into the plan as CASE expressions. The
table of counts is bounded by the number of feature values, ``MOST_CELLS``, not by the corpus.

Null texts count as empty: no spans. Positions are in code points, ends exclusive. Repeated rows are treated one by one,
other columns are kept by ``redact``. Patterns use possessive loops and start at the edge of a run only, so very long
runs of digits or letters take linear time and no stack. Places are running sums, made in as many passes as the number
of matches has bits; context comes from the pieces of text next to a match. So a text takes time in proportion to its
length, but for that factor.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from donorlake.llm.common import cut

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "A-Za-z0-9._%+-"
# What counts as personal data beyond doubt, leftmost and without overlap per kind.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What the generators propose.
LOOSE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++\x20?(?:@|\((?:at|AT)\)|\[(?:at|AT)\])\x20?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:[.:][0-9]{1,3}+){2,7}+",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){11,18}+",
    "phone": r"(?<![0-9])(?:\+|00|\()?[0-9](?:[\x20().-]{0,2}[0-9]){6,15}+",
}
# Words that announce a kind.
CUES = {
    "email": r"(?i)(mail|contact|kontakt|correo|courriel)",
    "ip": r"(?i)(\bip\b|host|server|addr|client)",
    "card": r"(?i)(card|visa|master|carte|karte|kredit|tarjeta|konto|account)",
    "phone": r"(?i)(tel|phone|call|fax|mobil|handy|rufen|llam)",
}
CUE_REACH = 24
FEATURES = ("n_digits", "n_groups", "n_separators", "plus", "before", "after", "cue")
#: Numbers of digits are told apart by these lower bounds, groups and separators up to ``MOST_GROUPS``.
DIGITS = (4, 7, 10, 11, 12, 13, 14, 15, 16, 17, 20)
MOST_GROUPS = 3
#: What the check of a kind looks at, and trees must not.
HIDDEN = {
    "email": ("n_separators",),
    "ip": ("n_digits", "n_groups", "n_separators"),
    "card": ("n_digits",),
    "phone": ("n_digits", "plus"),
}
#: The combinations of feature values, by kind and half.
MOST_CELLS = 2 * len(KINDS) * (len(DIGITS) + 1) * (MOST_GROUPS + 1) ** 2 * 2 * 5 * 5 * 2
ROUNDS = 40
RATE = 0.3
PRECISION = 0.95
#: A threshold is only set on at least so many unseen candidates.
LEAST_SEEN = 40


def _found(regex: str, text: str, gate: Column) -> tuple[Column, Column]:
    """The matches, and the pieces of text around them."""
    none = F.array().cast("array<string>")
    whole = F.col(text)
    return (
        F.when(gate, F.regexp_extract_all(whole, F.lit(regex), F.lit(0))).otherwise(none),
        F.when(gate, F.split(whole, regex, -1)).otherwise(none),
    )


def _running(numbers: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running sums or maxima of numbers from 0 on: each pass merges in what is 1, 2, 4, ... places before."""
    passes = F.ceil(F.log2(F.size(numbers).cast("double"))).cast("int")
    steps = F.when(F.size(numbers) > 1, F.sequence(F.lit(0), passes - 1)).otherwise(F.array().cast("array<int>"))

    def add(sums: Column, k: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1), k)
        before = F.concat(F.array_repeat(F.lit(0), step), F.slice(sums, F.lit(1), F.size(sums) - step))
        return F.zip_with(sums, before, merge)

    return F.aggregate(steps, numbers, add)


def _beside(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns by a one-row inline, so that a lambda that reads one finds it made and does not make it each time."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _placed(matches: str, gaps: str, ends: str) -> Column:
    """Matches with their places and what is next to them: array of struct<s, e, found, before, after>.

    Context reaches back to the start of the match before, and on to the end of the match behind.
    """

    def place(found: Column, i: Column) -> Column:
        end, gap, rest = F.get(ends, i), F.get(gaps, i), F.get(gaps, i + 1)
        before = F.when(F.length(gap) >= CUE_REACH, gap).otherwise(F.concat(F.coalesce(F.get(matches, i - 1), F.lit("")), gap))
        after = F.when(rest != "", rest).otherwise(F.coalesce(F.get(matches, i + 1), F.lit("")))
        return F.struct(
            (end - F.length(found)).alias("s"),
            end.alias("e"),
            found.alias("found"),
            F.right(before, F.lit(CUE_REACH)).alias("before"),
            F.left(after, F.lit(1)).alias("after"),
        )

    return F.transform(matches, place)


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]+", "")


def passes(kind: str, found: Column) -> Column:
    """Whether a match of the base pattern of a kind is personal data beyond doubt."""
    digits = _digits(found)
    if kind == "ip":
        # The first digits of a part are zeros, or it has three at most.
        parts = F.transform(F.split(found, r"\."), lambda part: F.regexp_replace(part, r"\A0+(?=[0-9])", ""))
        return F.forall(parts, lambda part: (F.length(part) < 3) | ((F.length(part) == 3) & (part <= "255")))
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _character(c: Column) -> Column:
    """0 none, 1 blank, 2 letter, 3 digit, 4 other."""
    return (
        F.when(c == "", 0)
        .when(c.rlike(r"\A\s"), 1)
        .when(c.rlike(r"\A\p{L}"), 2)
        .when(c.rlike(r"\A[0-9]"), 3)
        .otherwise(4)
    )


def _binned(number: Column) -> Column:
    """How many of the bounds of ``DIGITS`` a number reaches."""
    return F.size(F.filter(F.array(*[F.lit(d) for d in DIGITS]), lambda least: least <= number))


def _candidate(kind: str, span: Column) -> Column:
    found = span["found"]
    strict = found.rlike(r"\A" + BASE[kind].removeprefix(r"(?<![0-9])") + r"\z") & passes(kind, found)
    features = {
        "n_digits": _binned(F.length(_digits(found))),
        "n_groups": F.least(F.size(F.split(found, "[^0-9]+")) - 1, F.lit(MOST_GROUPS)),
        "n_separators": F.least(F.length(F.regexp_replace(found, "[A-Za-z0-9]+", "")), F.lit(MOST_GROUPS)),
        "plus": found.startswith("+").cast("int"),
        "before": _character(F.right(span["before"], F.lit(1))),
        "after": _character(span["after"]),
        "cue": span["before"].rlike(CUES[kind]).cast("int"),
    }
    shown = [(F.lit(0) if name in HIDDEN[kind] else value).alias(name) for name, value in features.items()]
    return F.struct(F.lit(KINDS.index(kind)).alias("kind"), span["s"].alias("s"), span["e"].alias("e"), strict.alias("strict"), *shown)


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows, with ``_base`` (struct<s, kind, e>, in order) and ``_candidates`` (with their features).

    The columns have to be free; ``redact`` and ``find`` see to that.
    """
    out = docs.withColumns({"_text": F.coalesce(F.col(text), F.lit(""))})
    gates = {"email": F.col("_text").rlike(r"@|\((?:at|AT)\)|\[(?:at|AT)\]")} | dict.fromkeys(KINDS[1:], F.col("_text").rlike("[0-9]"))
    out = out.withColumns({f"_g_{kind}": gate for kind, gate in list(gates.items())[:2]})
    steps = {}
    for name, patterns in (("b", BASE), ("l", LOOSE)):
        for kind in KINDS:
            gate = F.col("_g_email" if kind == "email" else "_g_ip")
            steps[f"_{name}m_{kind}"], steps[f"_{name}g_{kind}"] = _found(patterns[kind], "_text", gate)
    out = out.withColumns(steps)
    lists = [f"{name}%s_{kind}" for name in ("_b", "_l") for kind in KINDS]

    def lengths(matches: str, gaps: str) -> Column:
        return F.transform(matches, lambda found, i: F.length(found) + F.length(F.get(gaps, i)))

    out = out.withColumns({x % "n": lengths(x % "m", x % "g") for x in lists})
    out = out.withColumns({x % "e": _running(F.col(x % "n"), lambda x, y: x + y) for x in lists})
    out = out.withColumns({x % "": _placed(x % "m", x % "g", x % "e") for x in lists})

    def sure(kind: str) -> Column:
        good = F.filter(f"_b_{kind}", lambda span: passes(kind, span["found"]))
        return F.transform(good, lambda span: F.struct(span["s"].alias("s"), F.lit(KINDS.index(kind)).alias("kind"), span["e"].alias("e")))

    def proposed(kind: str) -> Column:
        return F.transform(f"_l_{kind}", lambda span: _candidate(kind, span))

    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.sort_array(F.concat(*map(sure, KINDS))).alias("_base"),
        F.concat(*map(proposed, KINDS)).alias("_candidates"),
    )


# --- the model -----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Split:
    """Left if the feature is at most ``cut``; ``low`` and ``high`` are splits or values."""

    feature: int
    cut: int
    low: Split | float
    high: Split | float


@dataclass(frozen=True)
class Model:
    """Trees and threshold by kind; a kind without a threshold adds no spans."""

    start: tuple[float, ...]
    trees: tuple[tuple[Split, ...], ...]
    thresholds: tuple[float | None, ...]


def _grow(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray, depth: int) -> Split | float:
    """A regression tree by greatest gain; ``gradient`` and ``weight`` are sums over each cell."""
    total_g, total_w = gradient[rows].sum(), weight[rows].sum()
    best, gain = None, 1e-6
    for f in range(x.shape[1]) if depth else ():
        values = x[rows, f]
        for at in np.unique(values)[:-1]:
            low = values <= at
            g, w = gradient[rows][low].sum(), weight[rows][low].sum()
            won = g * g / (w + 1) + (total_g - g) ** 2 / (total_w - w + 1) - total_g**2 / (total_w + 1)
            if won > gain:
                best, gain = (f, int(at), low), won
    if best is None:
        return float(total_g / (total_w + 1))
    f, at, low = best
    return Split(f, at, _grow(x, gradient, weight, rows[low], depth - 1), _grow(x, gradient, weight, rows[~low], depth - 1))


def _value(tree: Split | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, Split):
        return np.full(len(x), tree)
    return np.where(x[:, tree.feature] <= tree.cut, _value(tree.low, x), _value(tree.high, x))


def boost(x: np.ndarray, n: np.ndarray, good: np.ndarray, rounds: int = ROUNDS, depth: int = 2) -> tuple[float, tuple[Split, ...], np.ndarray]:
    """Logistic gradient boosting on cells: features, how many candidates, how many of them good. Gives log odds."""
    share = (good.sum() + 0.5) / (n.sum() + 1)
    start = float(np.log(share / (1 - share)))
    score, trees, rows = np.full(len(x), start), [], np.arange(len(x))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, good - n * p, n * p * (1 - p), rows, depth)
        if not isinstance(tree, Split):
            break
        trees.append(tree)
        score = score + RATE * _value(tree, x)
    return start, tuple(trees), score


def threshold(p: np.ndarray, n: np.ndarray, good: np.ndarray, precision: float = PRECISION) -> float | None:
    """The lowest score from which on at least ``precision`` of the candidates are good, if any."""
    order = np.argsort(-p, kind="stable")
    seen, right = n[order].cumsum(), good[order].cumsum()
    last = np.append(p[order][1:] != p[order][:-1], True) if len(p) else np.zeros(0, bool)
    fine = last & (seen >= LEAST_SEEN) & (right >= precision * seen)
    return float(p[order][np.flatnonzero(fine)[-1]]) if fine.any() else None


def learn(found: DataFrame, precision: float = PRECISION) -> Model:
    """Fit to the candidates of half of the documents (by checksum), calibrate on the other half.

    Candidates are counted by their features on Spark; the driver sees the counts.
    """
    half = F.pmod(F.xxhash64(F.col("_candidates").cast("string")), F.lit(2)).alias("half")
    each = found.filter(F.size("_candidates") > 0).select(half, F.explode("_candidates").alias("c"))
    cells = each.groupBy("half", "c.kind", *[f"c.{name}" for name in FEATURES])
    cells = cells.agg(F.count("*").alias("n"), F.sum(F.col("c.strict").cast("int")).alias("good"))
    rows = cells.orderBy("half", "kind", *FEATURES).collect()
    table = np.array([list(row) for row in rows], dtype=np.int64).reshape(-1, len(FEATURES) + 4)
    starts, trees, cuts = [], [], []
    for kind in range(len(KINDS)):
        seen = table[table[:, 1] == kind]
        fit, held = seen[seen[:, 0] == 0], seen[seen[:, 0] == 1]
        start, grown, _ = boost(fit[:, 2:-2], fit[:, -2], fit[:, -1])
        p = start + RATE * sum((_value(t, held[:, 2:-2]) for t in grown), np.zeros(len(held)))
        starts.append(start)
        trees.append(grown)
        cuts.append(threshold(p, held[:, -2], held[:, -1], precision))
    return Model(tuple(starts), tuple(trees), tuple(cuts))


def _compiled(tree: Split | float, c: Column) -> Column:
    if not isinstance(tree, Split):
        return F.lit(tree)
    return F.when(c[FEATURES[tree.feature]] <= tree.cut, _compiled(tree.low, c)).otherwise(_compiled(tree.high, c))


def _score(model: Model, kind: int, c: Column) -> Column:
    score = F.lit(model.start[kind])
    for tree in model.trees[kind]:
        score = score + RATE * _compiled(tree, c)
    return score


def _overlaps(spans_: Column, c: Column) -> Column:
    """Whether a span overlaps one of a list that is in order and has no overlaps: of those that start ahead of its end
    only the last has to be looked at, and it is found by halving."""
    none = F.struct(F.lit(0).alias("low"), F.size(spans_).alias("high"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans_) + 1.0)).cast("int"))

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        ahead = (state["low"] < state["high"]) & (F.get(spans_, middle)["s"] < c["e"])
        low = F.when(ahead, middle + 1).otherwise(state["low"])
        return F.struct(low.alias("low"), F.when(ahead, state["high"]).otherwise(middle).alias("high"))

    last = F.get(spans_, F.aggregate(steps, none, halve)["low"] - 1)
    return F.coalesce(last["e"] > c["s"], F.lit(False))


def chosen(found: DataFrame, model: Model) -> DataFrame:
    """Replace ``_candidates`` by ``_added``: candidates that reach their threshold and touch no base span of the kind."""
    by_kind = F.array(*[_of_kind(k) for k in range(len(KINDS))])
    found = _beside(found, _by_kind=by_kind)

    def wanted(c: Column) -> Column:
        hit = F.lit(False)
        for kind, least in enumerate(model.thresholds):
            if least is not None:
                hit = hit | ((c["kind"] == kind) & (_score(model, kind, c) >= least))
        return ~c["strict"] & hit & ~_overlaps(F.get("_by_kind", c["kind"]), c)

    added = F.transform(F.filter("_candidates", wanted), lambda c: F.struct(c["s"].alias("s"), c["kind"].alias("kind"), c["e"].alias("e")))
    return found.withColumns({"_added": F.sort_array(added)}).drop("_candidates", "_by_kind")


def _of_kind(kind: int) -> Column:
    return F.filter("_base", lambda b: b["kind"] == kind)


def _written(spans_: Column) -> Column:
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["s"].cast("string"), s["e"].cast("string"))), ",")


def find(docs: DataFrame, text: str = "text", precision: float = PRECISION) -> DataFrame:
    """``doc_id``, the number of base spans by kind, ``base_sha256``, ``spans`` (base and added) and ``n_added``."""
    slim = docs.select("doc_id", F.col(text).alias("_document"))
    found = cut(spans(slim, "_document").drop("_document"))
    picked = chosen(found, learn(found, precision))

    def count(kind: str) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == KINDS.index(kind))).cast("bigint").alias(f"n_{kind}")

    return picked.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(_written(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.sort_array(F.concat("_base", "_added"))).alias("spans"),
        F.size("_added").cast("bigint").alias("n_added"),
    )


#: Up to so many spans a text is cut span by span, each time from its start; beyond, it is taken apart once.
FEW = 32


def _replaced_few(names: Column) -> Column:
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(F.col("_document"), state["at"] + 1, F.greatest(s["s"] - state["at"], F.lit(0)))
        fresh = s["s"] >= state["at"]
        mark = F.when(fresh, F.get(names, s["kind"])).otherwise("")
        return F.struct(F.greatest(state["at"], s["e"]).alias("at"), F.concat(state["out"], gap, mark).alias("out"))

    done = F.aggregate("_all", first, step)
    return F.concat(done["out"], F.substring(F.col("_document"), done["at"] + 1, F.length("_document")))


def _replaced_many(names: Column) -> Column:
    """Letters outside of all spans and the marks of the spans that start behind all before them, in order of place.

    ``_letters`` are those of the text, ``_reach`` is how far the spans up to each one go.
    """
    fresh = F.filter("_all", lambda s, i: s["s"] >= F.coalesce(F.get("_reach", i - 1), F.lit(0)))
    marks = F.transform(fresh, lambda s: F.struct(s["s"].alias("p"), s["kind"].alias("kind")))
    covered = F.flatten(F.transform("_all", lambda s: F.sequence(s["s"], s["e"] - 1)))
    outside = F.array_except(F.sequence(F.lit(0), F.size("_letters") - 1), covered)
    letters = F.transform(outside, lambda p: F.struct(p.alias("p"), F.lit(-1).alias("kind")))
    text = lambda x: F.when(x["kind"] < 0, F.get("_letters", x["p"])).otherwise(F.get(names, x["kind"]))
    return F.array_join(F.transform(F.sort_array(F.concat(letters, marks)), text), "")


def redact(docs: DataFrame, text: str = "text", precision: float = PRECISION, marks: Sequence[str] = KINDS) -> DataFrame:
    """The rows with every span, base or added, replaced by its kind in angle brackets. Null texts stay null.

    Spans that overlap are replaced together, under the kind of the first.
    """
    found = spans(docs.select(F.col(text).alias("_document")), "_document")
    model = learn(cut(found.drop("_document")), precision)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_document"))
    picked = chosen(spans(whole, "_document"), model)
    picked = picked.withColumns({"_all": F.sort_array(F.concat("_base", "_added"))})
    names = F.array(*[F.lit(f"<{mark}>") for mark in marks])
    ends = F.transform("_all", lambda s: s["e"])
    many = F.size("_all") > FEW
    reach = F.when(many, _running(ends, lambda x, y: F.greatest(x, y)))
    picked = _beside(picked, _reach=reach, _letters=F.when(many, F.split("_document", "")))
    clean = F.when(many, _replaced_many(names)).when(F.size("_all") > 0, _replaced_few(names)).otherwise(F.col("_document"))
    picked = picked.withColumns({"_clean": clean})
    return picked.select(*[F.col("_clean").alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns])
