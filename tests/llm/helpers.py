"""Small inputs with all that may go wrong in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, size long, key string, token string"

PROSE = (
    "The river ran past the old mill and into the valley where the farmers of the town kept their fields and the "
    "children played by the water until it was late, and on most days a boat with goods for the market came by. "
    "It is said that this was the first road in the country to be built by the people who used it, for they had "
    "no one to ask and not much time to wait before the rain of the autumn came and the paths were mud again."
)


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows of (doc_id, text, lang, source), with further columns whose names the operators use themselves."""
    whole = [(i, t, lang, src, len(t or ""), 7, 8, "k", "t") for i, t, lang, src in rows]
    return spark.createDataFrame(whole, SCHEMA)


def odd_rows() -> list[tuple]:
    long = " ".join(f"word{k % 977}" for k in range(30_000))
    return [
        (1, PROSE, "en", "a"),
        (2, PROSE, "en", "a"),
        (2, PROSE, "en", "a"),
        (3, PROSE.replace("river", "stream"), "en", "b"),
        (4, None, None, None),
        (5, "", "en", None),
        (6, " \t\n ", "fr", "b"),
        (7, "one two", "en", "b"),
        (8, long, None, "c"),
        (9, "x" * 60_000, "en", "c"),
        (10, "1" * 50_000, "en", "c"),
        (None, PROSE, "en", "a"),
        (None, None, None, None),
        (3, "another text under an id that is taken", "en", "b"),
    ]
