"""Quality rules: a table of thresholds compiled into one projection. Spark's own functions only, no join and no shuffle.

Counts of words, characters, symbols, stop words, capitals and lines are taken once for each text; each rule bounds the ratio of two counts (or one count) from
below or above. Words that lie in a repeated window are found by sorting the text's windows: equal ones become neighbours, and the places that they start at,
in order again, give the words that they cover. A text whose windows have different hashes has none, and isn't sorted.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm.common import WORD

SYMBOLS = "#*$%&|<>"
WINDOW = 3

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by this are at "
    "der die und den von zu das mit sich des auf für ist im nicht dem ein eine "
    "de la le et les en un du une que par est pour dans qui pas sur "
    "el y los del se las por con no para una su es al lo"
).split()

#: name -> count, count that it is divided by (None: the count itself), lowest and highest value that pass, ends included. Texts that fail BASE fail whatever the rest says.
BASE = {
    "few_words": ("n_words", None, 50, None),
    "repeated_words": ("n_repeat_words", "n_words", None, 0.5),
}
RULES = {
    "word_length": ("word_chars", "n_words", 2.5, 12),
    "symbols": ("n_symbols", "n_words", None, 0.1),
    "words_without_letter": ("n_alpha_words", "n_words", 0.7, None),
    "stop_words": ("n_stop_words", "n_words", 0.01, None),
    "capitals": ("n_capitals", "word_chars", None, 0.5),
    "repeated_lines": ("n_dup_lines", "n_lines", None, 0.5),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_alpha_words", "n_stop_words", "n_capitals", "n_lines")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value being computed once."""
    return F.transform(F.array(value), use)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)


def covered(windows: Column, width: int) -> Column:
    """windows: what stands at each place -> the number of words within windows that stand at two places or more."""

    def neighbours(s: Column) -> Column:
        """s: (window, place) in order"""
        again = F.filter(s, lambda x, i: F.coalesce((x["w"] == F.get(s, i - 1)["w"]) | (x["w"] == F.get(s, i + 1)["w"]), x["w"] == F.get(s, i - 1)["w"], x["w"] == F.get(s, i + 1)["w"], F.lit(False)))
        places = F.array_sort(F.transform(again, lambda x: x["at"]))
        return let(places, lambda p: total(F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(x - F.get(p, k - 1), F.lit(width))).cast("long"))))

    return let(F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("at")))), neighbours)


def n_repeat_words(words: Column, width: int = WINDOW) -> Column:
    """Words in windows of width words that are found twice or more in the text, the first place included. Windows may overlap.

    Windows whose hashes all differ all differ: only a text with two equal hashes is looked at window by window.
    """
    starts = F.sequence(F.lit(0), F.size(words) - width)
    at = lambda i: [F.get(words, i + k) for k in range(width)]
    hashes = F.transform(starts, lambda i: F.xxhash64(*at(i)))
    exact = let(F.transform(starts, lambda i: F.concat_ws(" ", *at(i))), lambda w: covered(w, width))
    none = F.lit(0).cast("long")
    return F.when(F.size(words) < width, none).when(let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h)), none).otherwise(exact)


def counts(text: Column) -> Column:
    """A struct of COUNTS. Null counts as the empty text. Words and lines are taken from the text once."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    alpha = r"(?:^|(?<=[ \t-\r]))[^ \t-\r\p{L}]*+\p{L}"

    def of(words: Column, lines: Column) -> Column:
        found = {
            "n_words": F.size(words),
            "word_chars": total(F.transform(words, lambda w: F.length(w).cast("long"))),
            "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": n_repeat_words(words),
            "n_alpha_words": F.regexp_count(text, F.lit(alpha)),
            "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))),
            "n_capitals": F.regexp_count(text, F.lit(r"\p{Lu}")),
            "n_lines": F.size(lines),
        }
        return F.struct(*[found[k].cast("long").alias(k) for k in COUNTS])

    return let(F.struct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"), lines.alias("l")), lambda x: of(x["w"], x["l"]))


def fails(rule: tuple[str, str | None, float | None, float | None]) -> Column:
    """A rule as a condition on counts, without a division: a ratio to zero fails nothing."""
    of, by, low, high = rule
    x, y = F.col(of).cast("double"), F.lit(1.0) if by is None else F.col(by).cast("double")
    bounds = [x < y * low] if low is not None else []
    bounds += [x > y * high] if high is not None else []
    return reduce(lambda a, b: a | b, bounds, F.lit(False))


def judge(df: DataFrame, text: str = "text", rules: dict | None = None) -> DataFrame:
    """Adds COUNTS (long), base_failed boolean, kept boolean and failed array<string>, the names of the failed rules in the order of the table; they replace columns of these names.

    A null or empty text has no words and fails few_words. Rows are judged one by one, so ties and repeated rows don't matter; an empty table stays empty. Very
    long texts: the windows of one text are held in memory, some ten times its size.
    """
    table = {**BASE, **(RULES if rules is None else rules)}
    kept = df.drop(*[c for c in (*COUNTS, "base_failed", "kept", "failed") if c != text])
    own = "__counts"
    while own in kept.columns:
        own += "_"
    counted = kept.withColumn(own, counts(F.col(text))).select(*kept.columns, f"{own}.*")
    names = F.array_compact(F.array(*[F.when(fails(rule), F.lit(name)) for name, rule in table.items()]))
    base = reduce(lambda a, b: a | b, [fails(rule) for rule in BASE.values()])
    return counted.withColumns({"failed": names, "base_failed": base}).withColumn("kept", F.size("failed") == 0)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every whole text of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = judge(docs)
    return out.select("doc_id", *COUNTS, "base_failed", "kept", F.array_join("failed", ",").alias("failed"))


def _sql() -> str:
    def fails(rule) -> str:
        of, by, low, high = rule
        y = "1.0::DOUBLE" if by is None else f"{by}::DOUBLE"
        return " OR ".join([f"{of}::DOUBLE < {y} * {low}::DOUBLE"] * (low is not None) + [f"{of}::DOUBLE > {y} * {high}::DOUBLE"] * (high is not None))

    words = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
    listed = ", ".join(f"'{w}'" for w in STOP_WORDS)
    names = ", ".join(f"CASE WHEN {fails(rule)} THEN '{name}' END" for name, rule in {**BASE, **RULES}.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, {words} AS w FROM d),
g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS pos, w FROM w WHERE len(w) >= 3),
h AS (SELECT rid, pos, w[pos] || ' ' || w[pos + 1] || ' ' || w[pos + 2] AS win FROM g),
r AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, win) AS n FROM h),
p AS (SELECT DISTINCT rid, unnest([pos, pos + 1, pos + 2]) AS pos FROM r WHERE n > 1),
c AS (SELECT rid, count(*) AS n FROM p GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
a AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
      (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
      coalesce(n, 0)::BIGINT AS n_repeat_words, len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}')))::BIGINT AS n_alpha_words,
      len(list_filter(w, lambda x: regexp_full_match(lower(x), '{"|".join(STOP_WORDS)}')))::BIGINT AS n_stop_words,
      len(regexp_extract_all(t, '\p{{Lu}}'))::BIGINT AS n_capitals, len(lines)::BIGINT AS n_lines
      FROM d JOIN w USING (rid) JOIN l USING (rid) LEFT JOIN c USING (rid))
SELECT *, ({" OR ".join(fails(r) for r in BASE.values())}) AS base_failed, len(list_filter([{names}], lambda x: x IS NOT NULL)) = 0 AS kept, array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), ',') AS failed FROM a
"""


SQL = _sql()
