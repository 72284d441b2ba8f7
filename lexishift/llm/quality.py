"""Quality rules: a table of thresholds compiled into one Spark projection.

Every metric is a built-in Spark expression over one row, so nothing shuffles and nothing leaves the JVM.

Defined results: a null text counts as empty (no words, no lines); a null ``doc_id`` stays null; repeated
rows give repeated results; an empty table gives an empty result; other columns are kept, but for one named
``_verdict`` by :func:`verdicts`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexishift.llm.storage import carried, restored

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

# Common function words of the four languages the corpus is written in.
STOP_WORDS = (
    "the and of to in is that a for it was on with as be by at this are from or an "
    "le la les de des et en un une du que est pour dans qui sur pas au avec "
    "der die das und von zu mit den ist im ein eine auf dem nicht des sich "
    "el los las y del que en un una por con para su al lo se no es"
).split()


@dataclass(frozen=True)
class Rule:
    """``metric`` must lie in [low, high]; a null bound is open. A null metric passes."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The threshold table: the base, and the method's own verdict.
BASE_RULES = (Rule("enough_words", "n_words", low=50), Rule("repeated_words", "repeat_ratio", high=0.5))
RULES = (
    Rule("mean_word_length", "mean_word_length", low=1.5, high=20.0),
    Rule("symbols_per_word", "symbols_per_word", high=0.25),
    Rule("stop_word_ratio", "stop_word_ratio", low=0.005),
    Rule("dup_line_ratio", "dup_line_ratio", high=0.6),
    Rule("words_with_letter", "alpha_ratio", low=0.5),
)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also where the body is a nested lambda."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the array.

    Windows are sorted with their place, so equal ones are neighbours; each repeated window then counts the
    words that the window before it has not counted. O(n log n) in the words of one text.
    """
    window = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    marked = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(window(i).alias("h"), i.alias("i")))

    def places(rows: Column) -> Column:
        near = lambda x, k: F.coalesce(F.get(rows, k)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(rows, lambda x, k: near(x, k - 1) | near(x, k + 1)), lambda x: x["i"]))

    covered = lambda at: F.aggregate(
        F.transform(at, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return F.when(F.size(words) >= 3, let(F.array_sort(marked), lambda rows: let(places(rows), covered))).otherwise(F.lit(0).cast("long"))


def metrics_of(text: Column) -> Column:
    """All metrics of a text as one struct. One expression, so a filter on it can be pushed without computing it anew."""

    def build(words: Column) -> Column:
        n = F.size(words).cast("long")
        return let(
            F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)),
            lambda lines: F.struct(
                n.alias("n_words"),
                F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
                (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                repeated_words(words).alias("n_repeat_words"),
                F.size(F.filter(words, lambda w: F.lower(w).isin(sorted(set(STOP_WORDS))))).cast("long").alias("n_stop_words"),
                F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_alpha_words"),
                F.size(lines).cast("long").alias("n_lines"),
            ),
        )

    return let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), build)


def rule_columns(q: Column) -> dict[str, Column]:
    """The metrics that rules name, as expressions over the metrics struct."""
    per = lambda part, whole: F.when(q[whole] > 0, q[part] / q[whole])
    return {
        "n_words": q["n_words"],
        "mean_word_length": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "stop_word_ratio": per("n_stop_words", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "repeat_ratio": per("n_repeat_words", "n_words"),
        "alpha_ratio": per("n_alpha_words", "n_words"),
    }


def compile_rules(rules, q: Column) -> Column:
    """One boolean expression: all rules hold."""
    metrics, ok = rule_columns(q), F.lit(True)
    for r in rules:
        m = metrics[r.metric]
        if r.low is not None:
            ok = ok & F.coalesce(m >= F.lit(r.low), F.lit(True))
        if r.high is not None:
            ok = ok & F.coalesce(m <= F.lit(r.high), F.lit(True))
    return ok


def verdicts(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """``docs`` with a struct ``_verdict``: ``metrics``, ``base_failed`` and ``kept``."""

    def judge(q: Column) -> Column:
        failed = ~compile_rules(BASE_RULES, q)
        return F.struct(q.alias("metrics"), failed.alias("base_failed"), (~failed & compile_rules(rules, q)).alias("kept"))

    return docs.withColumn("_verdict", let(metrics_of(F.coalesce(F.col(text), F.lit(""))), judge))


def quality_filter(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only."""
    return restored(verdicts(carried(docs, text=text), "text", rules).filter("_verdict.kept"), docs)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    v = F.col("_verdict")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return verdicts(docs).select("doc_id", *[v["metrics"][c].alias(c) for c in counts], v["base_failed"].alias("base_failed"), v["kept"].alias("kept"))


def oracle_op10() -> str:
    words = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    mean, sym, stop, dup, alpha = RULES
    return rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
e as (select r, unnest(ws) as w, unnest(range(len(ws))) as i from w),
g as (select r, i, w || ' ' || lead(w) over o || ' ' || lead(w, 2) over o as k from e window o as (partition by r order by i)),
rep as (select r, i from (select r, i, k, count(*) over (partition by r, k) as n from g where k is not null) where n >= 2),
cov as (select distinct r, i + j as p from rep, (select unnest([0, 1, 2]) as j)),
nr as (select r, count(*) as n from cov group by r),
m as (select w.r, doc_id, len(ws)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
  coalesce(nr.n, 0)::bigint as n_repeat_words, len(list_filter(ws, lambda x: lower(x) in ({words}))) as ns,
  len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) as na, len(ls) as nl from w left join nr on nr.r = w.r),
v as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (not base_failed and word_chars::double / n_words between {mean.low} and {mean.high} and n_symbols::double / n_words <= {sym.high}
   and ns::double / n_words >= {stop.low} and n_dup_lines::double / nl <= {dup.high} and na::double / n_words >= {alpha.low}) as kept from v"""
