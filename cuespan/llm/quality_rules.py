"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

A rule is (name, metric, low, high); a document breaks it where the metric is outside [low, high].
Adding or changing rows of the table changes the compiled projection; no user function runs and
nothing is shuffled, so the work is one pass over the scan at any size.

Defined cases: null or empty text has no words and fails the base rule; repeated rows and null ids
are judged row by row; ties don't arise; columns of any names may stand beside; a very long text is one row's work,
read in linear time but for a sort of its windows where some repeat; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, fenced, space_words

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "der", "die", "das", "und", "le", "la", "de", "et", "el", "que", "les", "en"]

#: name, metric, lowest and highest value allowed (None: open). Metrics are ratios of whole numbers, as n / d.
RULES = [
    ("too_few_words", "n_words", 50, None),
    ("repeated_phrases", "100 * n_repeat_words / n_words", None, 50),
    ("symbols", "100 * n_symbols / word_chars", None, 5),
    ("repeated_lines", "100 * n_dup_lines / n_lines", None, 30),
    ("capitals", "100 * n_capitals / word_chars", None, 50),
    ("few_distinct_words", "100 * n_distinct / n_words", 15, None),
    ("word_length_low", "word_chars / n_words", 2, None),
    ("word_length_high", "word_chars / n_words", None, 40),
    ("stop_words", "100 * n_stop / n_words", None, 80),
]

#: What the pipeline drops. Repeated lines weigh by their characters, and two are needed; distinct words may
#: grow as slowly as three times the root of all words, which equals 15 % at 400 words. op9's SQL fixes RULES.
FAIR = {
    "repeated_lines": ("if(n_dup_lines >= 2, 100 * n_dup_chars, 0L) / line_chars", None, 30),
    "few_distinct_words": ("if(n_distinct * n_distinct >= 9 * n_words, 15 * n_words, 100 * n_distinct) / n_words", 15, None),
}
FAIR_RULES = [(name, *FAIR.get(name, rest)) for name, *rest in RULES]


def metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs as a struct column `row`, and one column for each metric."""
    t = F.coalesce(F.col("row")[text], F.lit(""))
    df = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    df = df.select("row", space_words(t).alias("w"), F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"))
    n = F.size("w")
    h = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    chars = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.length(x)).cast("long")
    left = lambda chars: F.length(t) - F.length(F.regexp_replace(t, chars, ""))
    df = df.select(
        "row",
        "lines",
        h.alias("h"),
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, SPACES, "")).cast("long").alias("word_chars"),
        left("[#*$%&|<>]+").cast("long").alias("n_symbols"),
        left("[A-Z]+").cast("long").alias("n_capitals"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.size(F.filter("w", lambda x: x.isin(STOP_WORDS))).cast("long").alias("n_stop"),
        F.size("lines").cast("long").alias("n_lines"),
        chars("lines").alias("line_chars"),
    )
    keep = [c for c in df.columns if c not in ("h", "lines")]
    # windows with their places, sorted by window: equal ones are neighbours. Sorted only where some window repeats.
    placed = F.when(F.size("h") > F.size(F.array_distinct("h")), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    df = df.select(*keep, (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), (F.col("line_chars") - chars(F.array_distinct("lines"))).alias("n_dup_chars"), placed.alias("s"))
    twice = F.filter("s", lambda x, k: (x.h == F.get("s", k - 1).h) | (x.h == F.get("s", k + 1).h))
    df = df.select(*keep, "n_dup_lines", "n_dup_chars", F.sort_array(F.transform(twice, lambda x: x.i)).alias("p"))
    covered = F.aggregate(F.transform("p", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("p", k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return df.select(*keep, "n_dup_lines", "n_dup_chars", fenced(F.coalesce(covered, F.lit(0)).cast("long")).alias("n_repeat_words"))


def _breaks(metric: str, low, high) -> Column:
    """Compared in whole numbers: n / d beyond a bound is n beyond bound * d; d = 0 breaks nothing."""
    num, _, den = metric.partition(" / ")
    a, b = F.expr(num), F.expr(den or "1")
    out = F.lit(False)
    out = out | (a < low * b) if low is not None else out
    return out | (a > high * b) if high is not None else out


def judge(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """`row`, the metrics, base_failed (the first two rules), broken (names of broken rules) and kept."""
    df = metrics(docs, text)
    broken = F.array_compact(F.array(*[F.when(_breaks(m, lo, hi), F.lit(name)) for name, m, lo, hi in rules]))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.select("*", base.alias("base_failed"), broken.alias("broken")).select("*", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", rules=FAIR_RULES) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns."""
    return judge(docs, text, rules).where("kept").select("row.*")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .common import table

    d = judge(table(spark, sf_dir, "documents"))
    return d.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: The metrics of the table `src`, as DuckDB SQL.
METRICS_SQL = rf"""
w as (select *, {WORDS_SQL} as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from src),
tri as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from w where len(w) >= 3),
tri2 as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as c from tri),
rep as (select doc_id, count(distinct i + j) as n from tri2, (select unnest([0, 1, 2]) as j) where c > 1 group by doc_id),
m as (select w.*, cast(len(w.w) as bigint) as n_words,
 cast(length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
 cast(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
 cast(length(regexp_replace(coalesce(text, ''), '[^A-Z]+', '', 'g')) as bigint) as n_capitals,
 cast(len(list_distinct(w.w)) as bigint) as n_distinct,
 cast(len(list_filter(w.w, lambda x: x in ({", ".join(repr(x) for x in STOP_WORDS)}))) as bigint) as n_stop,
 cast(len(lines) as bigint) as n_lines, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
 cast(coalesce(rep.n, 0) as bigint) as n_repeat_words from w left join rep using (doc_id)),
judged as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
 not ((n_words < 50 or 100 * n_repeat_words > 50 * n_words)
  or 100 * n_symbols > 5 * word_chars or 100 * n_dup_lines > 30 * n_lines or 100 * n_capitals > 50 * word_chars
  or 100 * n_distinct < 15 * n_words or word_chars < 2 * n_words or word_chars > 40 * n_words or 100 * n_stop > 80 * n_words) as kept from m)"""

SQL = f"with src as (select * from documents), {METRICS_SQL} select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept from judged"
