"""Quality rules: a threshold table compiled into one projection of ratios, without user functions.

Every measure is a whole number and every rule compares whole-number products, so the verdict
does not depend on how an engine rounds. Null text counts as empty: no words, base_failed, not kept.
Repeated rows are judged alike, row by row; an empty table gives an empty result; other columns of
the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import SPACES

WINDOW = 8
SYMBOLS = "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Frequent function words of the languages in scope.
STOP_WORDS = (
    "the of and to in is that it for was on are as with by this be or from at "
    "der die das und ist von den mit zu nicht ein eine im auf sich "
    "le la les de des et un une du que qui dans pour est sur par "
    "el los las en se del con para al es su una no lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """Keeps a text if low <= 1000 * part / whole <= high (in thousandths; a whole of 0 passes).

    spare: so many parts too few or too many are let pass, for short texts.
    """

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None
    spare: int = 0

    def sql(self) -> str:
        tests = []
        if self.low is not None:
            tests.append(f"1000 * ({self.part} + {self.spare}) >= {self.low} * {self.whole}")
        if self.high is not None:
            tests.append(f"1000 * ({self.part} - {self.spare}) <= {self.high} * {self.whole}")
        return f"({' AND '.join(tests)})"


#: The threshold table; measures are the columns of `measure`.
RULES = (
    Rule("mean word length", "word_chars", "n_words", 1500, 15000),
    Rule("symbols in words", "n_symbols", "word_chars", high=100, spare=2),
    Rule("exclamations a word", "n_exclaims", "n_words", high=300, spare=3),
    Rule("stop words", "n_stop_words", "n_words", low=10, spare=2),
    Rule("repeated lines", "n_dup_lines", "n_lines", high=500, spare=1),
)
BASE_FAILED = "(n_words < 20 OR 100 * n_repeat_words > 30 * n_words)"


def verdict_sql(rules: tuple[Rule, ...] = RULES) -> str:
    return " AND ".join([f"NOT {BASE_FAILED}", *(r.sql() for r in rules)])


def _removed(text: str, chars: str) -> str:
    return f"length({text}) - length(translate({text}, '{chars}', ''))"


def measure(docs: DataFrame) -> DataFrame:
    """The measures of each text: doc_id and whole-number columns.

    Windows are compared by the 64-bit hash of their words' hashes within one text.
    """
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t"))
    df = df.withColumn("_w", F.filter(F.split("_t", f"[{SPACES}]+"), lambda w: w != ""))
    df = df.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(f"[^{SPACES}]")))
    df = df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    window = ", ".join(f"_h[i + {k}]" for k in range(WINDOW))
    df = df.withColumn("_v", F.expr(f"CASE WHEN size(_h) > {WINDOW} THEN transform(sequence(0, size(_h) - {WINDOW}), i -> xxhash64({window})) END"))
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    df = df.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        F.expr(_removed("_t", SYMBOLS)).cast("long").alias("n_symbols"),
        F.expr(_removed("_t", "!")).cast("long").alias("n_exclaims"),
        F.expr(f"size(filter(_w, w -> translate(w, '{UPPER}', '{LOWER}') IN ({stop})))").cast("long").alias("n_stop_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        # Only texts with a repeated window pay for sorting.
        F.expr("CASE WHEN _v IS NOT NULL AND size(array_distinct(_v)) < size(_v) THEN sort_array(transform(_v, (h, i) -> struct(h, i))) END").alias("_s"),
    )
    df = df.withColumn("_r", F.expr("sort_array(transform(filter(transform(_s, (x, j) -> IF((j > 0 AND get(_s, j - 1).h = x.h) OR get(_s, j + 1).h = x.h, x.i, NULL)), p -> p IS NOT NULL), p -> p))"))
    covered = f"aggregate(transform(_r, (p, j) -> least({WINDOW}, coalesce(get(_r, j + 1) - p, {WINDOW}))), 0L, (a, b) -> a + b)"
    return df.withColumn("n_repeat_words", F.coalesce(F.expr(covered), F.lit(0).cast("long"))).drop("_s", "_r")


def judge(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds base_failed, kept and the names of the broken rules."""
    broken: list[Column] = [F.when(~F.expr(r.sql()), F.lit(r.name)) for r in rules]
    return measured.withColumns({
        "base_failed": F.expr(BASE_FAILED),
        "kept": F.expr(verdict_sql(rules)),
        "broken_rules": F.array_join(F.array_compact(F.array(*broken)), ", "),
    })


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of docs (doc_id, text) with its measures and verdict."""
    return judge(measure(docs), rules)


OUTPUT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_quality_rules(spark, sf_dir):
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(*OUTPUT, "broken_rules")


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    broken = ", ".join(f"CASE WHEN NOT {r.sql()} THEN '{r.name}' END" for r in RULES)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, t,
        list_filter(regexp_split_to_array(t, '[{SPACES}]+'), lambda w: w <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACES}]')) AS l FROM d),
v AS (SELECT *, CASE WHEN len(w) >= {WINDOW} THEN list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ')) ELSE [] END AS win FROM a),
g AS (SELECT *, list_transform(list_grade_up(win), lambda x: x::INT) AS o FROM v),
r AS (SELECT *, list_sort(list_filter(list_transform(range(1, len(o) + 1), lambda j: CASE WHEN win[o[j]] = win[o[j - 1]] AND j > 1 OR win[o[j]] = win[o[j + 1]] THEN o[j] END), lambda p: p IS NOT NULL)) AS p FROM g),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words,
        length(translate(t, {space}, ''))::BIGINT AS word_chars,
        (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
        (length(t) - length(translate(t, '!', '')))::BIGINT AS n_exclaims,
        len(list_filter(w, lambda x: translate(x, '{UPPER}', '{LOWER}') IN ({stop})))::BIGINT AS n_stop_words,
        len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(list_sum(list_transform(range(1, len(p) + 1), lambda j: least({WINDOW}, coalesce(p[j + 1] - p[j], {WINDOW})))), 0)::BIGINT AS n_repeat_words FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {BASE_FAILED} AS base_failed, {verdict_sql()} AS kept,
       array_to_string(list_filter([{broken}], lambda x: x IS NOT NULL), ', ') AS broken_rules FROM m"""


SQL = {"op7_quality_rules": _sql()}
