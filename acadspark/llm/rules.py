"""Quality rules, line by line first: only DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acadspark.functions.steps import let, once

SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
GRAM = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of words
MOST_LOST = 50  # per cent of word characters

# Line rules.
PUNCTUATION = "!\"#$%&()*+,./:;<=>?@[]^_`{|}~-"
MOST_PUNCTUATION = 50  # per cent of a line's characters
NAVIGATION = r"(?i)^[^.!?]{0,80}(\||»|›|•)[^.!?]{0,80}(\||»|›|•)[^.!?]{0,80}$"
BOILERPLATE = (
    r"(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie policy|accept (all )?cookies|enable javascript|"
    r"click here|sign up for|subscribe to our|skip to (main )?content|back to top|share on (facebook|twitter)|follow us on)")
MOST_BOILERPLATE = 300  # a longer line is prose that mentions such words


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, SPACE, "")).cast("long")


def count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def line_fails(line: Column) -> Column:
    """Whether a line that has a word breaks the punctuation, the navigation or the boilerplate rule."""
    marks = count_of(line, PUNCTUATION) * 100 > word_chars(line) * MOST_PUNCTUATION
    stock = line.rlike(BOILERPLATE) & (F.length(line) <= MOST_BOILERPLATE)
    return (word_chars(line) > 0) & (marks | line.rlike(NAVIGATION) | stock)


def repeated_words(grams: Column, gram: int = GRAM) -> Column:
    """Words in windows whose hash stands at two places or more: equal hashes are neighbours once sorted; the places found,
    in order, each cover ``gram`` words up to the next place."""

    def places(s: Column) -> Column:
        same = lambda e, j: (e["h"] == F.get(s, j - 1)["h"]) | (e["h"] == F.get(s, j + 1)["h"])
        return F.sort_array(F.array_compact(F.transform(s, lambda e, j: F.when(same(e, j), e["i"]))))

    def covered(a: Column) -> Column:
        steps = F.transform(a, lambda v, k: F.least(F.lit(gram), F.coalesce(F.get(a, k + 1) - v, F.lit(gram))).cast("long"))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda x, y: x + y)

    marked = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(let(let(marked, places), covered))


def judged(rows: DataFrame) -> DataFrame:
    """``rows`` (id, text) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, cleaned, n_bad_lines, kept.

    Lines are judged first: one that is mostly punctuation, reads like navigation or holds a stock phrase is removed. Then
    a document falls if the base rules fail or more than MOST_LOST per cent of its word characters went with its lines.
    A null text has no words and fails. Rows are judged one by one: no shuffle, memory of one text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = rows.select("id", text.alias("text"), F.array_remove(F.split(text, SPACES), "").alias("words"), F.split(text, "\n").alias("lines"))
    cut = once(cut, "words", "lines")
    windows = F.when(F.size("words") >= GRAM, F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (GRAM - 1))), lambda i: F.xxhash64(F.slice("words", i, GRAM)))).otherwise(F.array().cast("array<bigint>"))
    good = F.filter("lines", lambda x: ~line_fails(x))
    worded = F.filter("lines", lambda x: word_chars(x) > 0)
    step = once(cut.select(
        "id", "text", F.size("words").cast("long").alias("n_words"), windows.alias("grams"), good.alias("good"), F.size("lines").alias("n_lines"), worded.alias("worded")),
        "grams", "good", "worded")
    done = once(step.select(
        "id", "n_words", word_chars(F.col("text")).alias("word_chars"), count_of(F.col("text"), SYMBOLS).alias("n_symbols"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("grams")).alias("n_repeat_words"),
        F.array_join("good", "\n").alias("cleaned"), (F.col("n_lines") - F.size("good")).cast("long").alias("n_bad_lines")), "n_repeat_words", "cleaned", "word_chars")
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    left = word_chars(F.col("cleaned")) * 100 >= F.col("word_chars") * (100 - MOST_LOST)
    return done.select("*", failed.alias("base_failed"), (~failed & left).alias("kept"))


def rules_report(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every row of ``docs``."""
    return judged(docs.select(F.col("doc_id").alias("id"), "text")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_bad_lines")


def cleaned_documents(docs: DataFrame) -> DataFrame:
    """Documents that are kept, without their failing lines; other columns as they were, n_chars counted anew."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = judged(docs.select(whole.alias("id"), "text")).filter("kept")
    return kept.select(*[with_text(docs, c, F.col("cleaned"), F.col("id")[c]) for c in docs.columns])


def with_text(docs: DataFrame, name: str, text: Column, old: Column) -> Column:
    """Column ``name`` of a row whose text became ``text``."""
    if name == "text":
        return text.alias("text")
    return (F.length(text).cast(docs.schema[name].dataType) if name == "n_chars" else old).alias(name)


def _sql() -> str:
    space = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    chars = lambda x: f"length(translate({x}, {space}, ''))"
    marks = lambda x, c: f"(length({x}) - length(translate({x}, '{c}', '')))"
    fails = f"""({chars('line')} > 0 AND ({marks('line', PUNCTUATION)} * 100 > {chars('line')} * {MOST_PUNCTUATION}
      OR regexp_matches(line, '{NAVIGATION}') OR (regexp_matches(line, '{BOILERPLATE}') AND length(line) <= {MOST_BOILERPLATE})))"""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, list_filter(string_split_regex(t, '[ \\t-\\r]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT rid, i, array_to_string(ws[i:i + {GRAM - 1}], ' ') AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - {GRAM - 2})) AS i FROM w)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM r, range({GRAM}) AS x(k) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
f AS (SELECT rid, line, {chars('line')} AS chars, {fails} AS bad FROM l),
s AS (SELECT rid, count(*) FILTER (chars > 0) - count(DISTINCT line) FILTER (chars > 0) AS n_dup_lines,
  sum(CASE WHEN bad THEN 0 ELSE chars END) AS left_chars, count(*) FILTER (bad) AS n_bad_lines FROM f GROUP BY rid),
a AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST({chars('t')} AS BIGINT) AS word_chars, CAST({marks('t', SYMBOLS)} AS BIGINT) AS n_symbols,
  n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, left_chars, n_bad_lines
  FROM d JOIN w USING (rid) JOIN s USING (rid) LEFT JOIN c USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND left_chars * 100 >= word_chars * {100 - MOST_LOST} AS kept, n_bad_lines
FROM a"""


SQL = _sql()
