"""Quality rules: a table of thresholds compiled into one projection, without user functions.

A rule names a measured ratio and the range in which it passes; ``compiled`` turns the table
into one Boolean column and one array with the names of the rules that failed. All measures
are column expressions over one row, so nothing is shuffled.

Null, empty and blank texts have no words and fail the base rule. Ratios over nothing are 0. The
stop-word ratio is taken with the list of the row's ``lang``; it is null, and its rule is not applied,
where the language has no list or is not stated. Repeated rows are judged alike; columns beside
``text`` and ``lang`` are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.llm.common import ROW, SPACES, named, unpacked, whole_row, words

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "[#*$%&|<>]"

# Frequent function words of the languages that have a list.
STOP_WORDS = {
    "en": "a and are as at be by for from in is it of on or that the this to was with".split(),
    "fr": "au de des du en est et il la le les ne par pas pour que qui sur un une".split(),
    "es": "al con de del el en es la las lo los no para por que se su un una y".split(),
    "de": "als auf das dem den der die ein eine im in ist mit nicht sich sie und von zu".split(),
}


@dataclass(frozen=True)
class Rule:
    """A measure passes between ``low`` and ``high``, both included; a null one, and fewer words than
    ``from_words``, pass."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


RULES = (
    Rule("long_enough", "n_words", low=10),
    Rule("short_enough", "n_words", high=1_000_000),
    Rule("word_length", "mean_word_chars", low=2.0, high=15.0),
    Rule("symbols", "symbols_per_word", high=0.3),
    Rule("stop_words", "stop_word_ratio", low=0.05, from_words=50),
    Rule("repeated_lines", "dup_line_ratio", high=0.3),
)


def _ratio(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))


def _among(own: list[str]):
    return lambda word: word.isin(own)


def measured(docs: DataFrame, payload: list[Column]) -> DataFrame:
    """The payload and all measures of each row.

    Each step is a projection of its own, because a lambda that held the expression of the
    words or windows would compute them again for every element.
    """
    text = F.coalesce(named(docs, "text"), F.lit(""))
    lang = named(docs, "lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(*payload, text.alias("body"), lang.alias("language"))
    kept = [c for c in rows.columns if c not in ("body", "language")]
    listed = F.when(F.col("language").isin(list(STOP_WORDS)), F.split(F.lower("body"), r"[^\p{L}]+"))
    rows = rows.select(
        *kept, "body", "language", listed.alias("letters"), words(F.col("body")).alias("words"),
        F.filter(F.split("body", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0).alias("lines"),
    )
    counted = [
        F.when(F.col("language") == name, F.size(F.filter("letters", _among(own))))
        for name, own in STOP_WORDS.items()
    ]
    windows = F.transform(
        F.slice("words", 1, F.greatest(F.size("words") - (WINDOW - 1), F.lit(0))),
        lambda word, i: F.xxhash64(word, *[F.get("words", i + k) for k in range(1, WINDOW)]),
    )
    rows = rows.select(
        *kept, F.coalesce(*counted).alias("stop_words"), windows.alias("windows"),
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        (F.length("body") - F.length(F.regexp_replace("body", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
    )
    measures = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "stop_words"]
    # Most texts repeat no window; only the others are sorted to find which.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    rows = rows.select(*kept, *measures, F.when(repeats, F.array_sort(placed)).alias("sorted"))
    same = lambda k, x: F.coalesce(F.get("sorted", k)["w"] == x["w"], F.lit(False))
    starts = F.array_sort(
        F.transform(F.filter("sorted", lambda x, k: same(k - 1, x) | same(k + 1, x)), lambda x: x["i"])
    )
    rows = rows.select(*kept, *measures, starts.alias("starts"))
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, s: F.struct(
            (a["n"] + s + WINDOW - F.greatest(s, a["upto"])).alias("n"), (s + WINDOW).alias("upto")
        ),
    )["n"]
    rows = rows.select(*kept, *measures, F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"))
    return rows.withColumns({
        "stop_word_ratio": F.try_divide(F.col("stop_words").cast("double"), F.col("n_words")),
        "mean_word_chars": _ratio("word_chars", "n_words"),
        "symbols_per_word": _ratio("n_symbols", "n_words"),
        "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
    })


def compiled(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Whether all rules pass, and the names of those that do not."""
    failed = []
    for rule in rules:
        fails = F.lit(False)
        if rule.low is not None:
            fails = fails | (F.col(rule.measure) < F.lit(rule.low))
        if rule.high is not None:
            fails = fails | (F.col(rule.measure) > F.lit(rule.high))
        fails = F.coalesce(fails, F.lit(False))
        failed.append(F.when(fails & (F.col("n_words") >= rule.from_words), F.lit(rule.name)))
    names = F.array_compact(F.array(*failed))
    return F.size(names) == 0, names


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judge(docs: DataFrame, payload: list[Column], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The payload, the measures, ``base_failed``, ``kept`` and ``failed_rules`` of each row."""
    passed, failed = compiled(rules)
    return measured(docs, payload).withColumns(
        {"base_failed": base_failed(), "kept": ~base_failed() & passed, "failed_rules": failed}
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    Rows leave by a generator instead of a filter: a filter would be pushed below the
    projections and carry the whole computation of its verdict into one expression.
    """
    judged = judge(docs, [whole_row(docs).alias(ROW)], rules)
    passed = F.when(F.col("kept"), F.array(ROW))
    return unpacked(judged.select(F.explode(passed).alias(ROW)), docs.columns)
