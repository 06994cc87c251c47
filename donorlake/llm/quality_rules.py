"""Quality rules: a table of thresholds, compiled into one projection over each text.

Every measure is a built-in column expression over the text and its word list, so a document is judged where it is read,
without a shuffle. A rule names a measure and the range it has to be in.

Null and blank texts have no words and every count is 0; they are rejected (``min_words``). Repeated rows are judged
one by one. Extra columns of the input are kept; a column of the same name as a measure is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from donorlake.llm.common import fold_ascii, words

# Frequent function words of the languages a corpus holds.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his from are this or an at which",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus au sur ne se pas ce il avec",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus",
}
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``measure`` has to lie in [least, most]; ``per`` divides it by another measure first (0 where that is 0)."""

    name: str
    measure: str
    per: str | None = None
    least: float | None = None
    most: float | None = None

    def passed(self) -> Column:
        value = F.col(self.measure).cast("double")
        if self.per:
            value = F.when(F.col(self.per) > 0, value / F.col(self.per)).otherwise(0.0)
        checks = []
        if self.least is not None:
            checks.append(value >= self.least)
        if self.most is not None:
            checks.append(value <= self.most)
        return checks[0] if len(checks) == 1 else checks[0] & checks[1]


#: The base rules: whoever breaks one is out, whatever the other rules say. The second is checked in whole numbers.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

RULES = (
    Rule("mean_word_length", "word_chars", per="n_words", least=2.0, most=14.0),
    Rule("symbols_per_word", "n_symbols", per="n_words", most=0.2),
    Rule("duplicate_lines", "n_dup_lines", per="n_lines", most=0.5),
    Rule("letters", "n_letters", per="word_chars", least=0.7),
    Rule("upper_case", "n_upper", per="n_letters", most=0.5),
    Rule("stop_words", "n_stop_words", per="n_words", least=0.04),
)


def _length(text: Column) -> Column:
    return F.length(text).cast("bigint")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures the rules speak of.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_lines`` (lines with a word), ``n_dup_lines``
    (of those, the ones equal to an earlier line), ``n_repeat_words`` (words in three-word windows found twice or more),
    ``n_letters``, ``n_upper`` (upper-case letters), ``n_stop_words``.

    Repeated windows are found by sorting one number per window: its hash with the lowest bits replaced by its
    position, as many bits as positions need. Neighbours that agree in the hash are compared word by word.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    stops = sorted(set(" ".join(STOP_WORDS.values()).split()))
    step = docs.withColumns({"_text": whole}).withColumns(
        {
            "_words": words(F.col("_text")),
            "_lines": F.filter(F.split(F.col("_text"), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    step = step.withColumns({"n_words": F.size("_words").cast("bigint")})
    step = step.withColumns({"_positions": F.call_function("shiftleft", F.lit(1).cast("bigint"), F.ceil(F.log2(F.col("n_words") + 1)).cast("int"))})

    def window(i: Column) -> Column:
        at = [F.get("_words", i + k) for k in range(3)]
        return F.xxhash64(*at).bitwiseAND(-F.col("_positions")).bitwiseOR(i.cast("bigint"))

    windows = F.when(F.col("n_words") >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")), window)))
    step = step.withColumns({"_windows": windows})

    def position(key: Column) -> Column:
        return key.bitwiseAND(F.col("_positions") - 1).cast("int")

    def same(key: Column, other: Column) -> Column:
        equal = key.bitwiseAND(-F.col("_positions")) == other.bitwiseAND(-F.col("_positions"))
        for k in range(3):
            equal = equal & (F.get("_words", position(key) + k) == F.get("_words", position(other) + k))
        return F.coalesce(equal, F.lit(False))

    twice = F.filter("_windows", lambda key, i: same(key, F.get("_windows", i - 1)) | same(key, F.get("_windows", i + 1)))
    step = step.withColumns({"_starts": F.sort_array(F.transform(twice, position))})
    covered = F.aggregate(
        F.transform("_starts", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_starts", i + 1) - p, F.lit(3)))),
        F.lit(0).cast("bigint"),
        lambda total, x: total + x,
    )
    letters = F.regexp_replace("_text", r"\P{L}+", "")
    measures = {
        "n_words": F.col("n_words"),
        "word_chars": _length(F.array_join("_words", "")),
        "n_symbols": _length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")),
        "n_lines": F.size("_lines").cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "n_repeat_words": F.coalesce(covered, F.lit(0).cast("bigint")),
        "n_letters": _length(letters),
        "n_upper": _length(F.regexp_replace("_text", r"\P{Lu}+", "")),
        "n_stop_words": F.size(F.filter("_words", lambda w: fold_ascii(w).isin(stops))).cast("bigint"),
    }
    # Through a one-row inline: a filter on a measure would else be moved below it all, with a copy of each step.
    others = [F.col(f"`{c}`") for c in docs.columns if c not in measures]
    return step.select(*others, F.inline(F.array(F.struct(*[m.alias(name) for name, m in measures.items()]))))


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows with their measures, ``base_failed``, ``broken`` (names of the other rules broken) and ``kept``."""
    measured = measure(docs, text)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    broken = F.array_compact(F.array(*[F.when(~rule.passed(), F.lit(rule.name)) for rule in rules]))
    return measured.withColumns({"base_failed": base, "broken": broken}).withColumns(
        {"kept": ~F.col("base_failed") & (F.size("broken") == 0)}
    )


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that pass every rule, with the columns they came with."""
    whole = docs.withColumns({"_row": F.struct(*[F.col(f"`{c}`") for c in docs.columns])}).select("_row", F.col(text).alias("_judged"))
    return judge(whole, "_judged", rules).filter("kept").select("_row.*")
