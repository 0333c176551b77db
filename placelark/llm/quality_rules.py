"""Quality rules: a short-circuit cascade, ordered by rejections per cost as estimated on a sample. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelark.llm.common import WS, table

#: The estimate's sample: so many rows, expected, drawn uniformly from all.
SAMPLE_ROWS = 1000
#: Words of the windows whose repeats count.
WINDOW = 8
bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  evaluates value once


def words_of(text: Column) -> Column:
    """Runs of other characters than ASCII white space."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[ \\t-\\r]+"))


def repeated_words(words: Column, n: int = WINDOW) -> Column:
    """Words in n-word windows found twice or more. Words are hashed once, windows from their words' hashes; equal neighbours in
    the sorted windows are repeats; their starts, in order, cover n words each less what the start before covers."""

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))

    def starts(a: Column) -> Column:
        same = F.filter(a, lambda x, j: (x["h"] == F.get(a, j - 1)["h"]) | (x["h"] == F.get(a, j + 1)["h"]))
        return F.array_sort(F.transform(same, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(p, F.struct(F.lit(-n).alias("last"), F.lit(0).cast("long").alias("sum")), lambda acc, x: F.struct(x.alias("last"), (acc["sum"] + F.least(x - acc["last"], F.lit(n))).alias("sum")))["sum"]

    def count(w: Column) -> Column:
        at = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(bind(at, lambda a: bind(starts(a), covered)))

    return F.when(F.size(words) < n, F.lit(0).cast("long")).otherwise(bind(F.transform(words, lambda w: F.xxhash64(w)), lambda h: bind(windows(h), count)))


def lines_of(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WS)) != "")


def word_chars(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, "[ \\t-\\r]+", "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long")


@dataclass(frozen=True)
class Rule:
    """A rule rejects a row for which rejects(text, words) is true. `cost` are its passes over a text's characters or words, by kind
    of pass: what the estimate multiplies by the sample's sizes, so that the order doesn't depend on a clock."""

    name: str
    rejects: Callable[[Column, Column], Column]
    per_char: float = 0.0
    per_word: float = 0.0


def _duplicate_lines(t: Column, _: Column) -> Column:
    return bind(lines_of(t), lambda x: (F.size(x) >= 5) & ((F.size(x) - F.size(F.array_distinct(x))) * 10 > F.size(x) * 4))


def _capitals(t: Column, _: Column) -> Column:
    return bind(F.regexp_replace(t, "[^\\p{L}]+", ""), lambda x: (F.char_length(x) > 50) & (F.char_length(F.regexp_replace(x, "[^\\p{Lu}]+", "")) * 10 > F.char_length(x) * 7))


def _few_words(_: Column, w: Column) -> Column:
    # a twentieth of the words, and from 2,000 on the root of five times the words: vocabulary grows with the root of a text's length
    n = F.size(w).cast("long")
    return bind(F.size(F.array_distinct(w)).cast("long"), lambda d: (n >= 20) & (d * 20 < n) & (d * d < n * 5))


#: The base rules, which the contract fixes, and the method's. Costs by kind: a regular expression's pass over the characters 1, a split
#: into lines 2, a set of words 2 a word, windows with their sort 12 a word.
BASE = [
    Rule("too_short", lambda t, w: F.size(w) < 20),
    Rule("repeats", lambda t, w: repeated_words(w) * 100 > F.size(w) * 30, per_word=12.0),
]
RULES = [
    Rule("symbols", lambda t, w: n_symbols(t) * 10 > word_chars(t), per_char=2.0),
    Rule("duplicate_lines", _duplicate_lines, per_char=2.0),
    Rule("long_words", lambda t, w: word_chars(t) > F.size(w) * 40, per_char=1.0),
    Rule("capitals", _capitals, per_char=2.0),
    Rule("no_letters", lambda t, w: F.char_length(F.regexp_replace(t, "[^\\p{L}]+", "")) * 4 < word_chars(t), per_char=2.0),
    Rule("few_words", _few_words, per_word=2.0),
]


def order_rules(docs: DataFrame, rules: list[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> list[tuple[Rule, float, float]]:
    """(rule, share rejected, cost a row) by rejections per cost, from one pass over a uniform sample of about sample_rows rows.

    The order decides the cost alone: the verdict is the same for every order. Equal ratios go by name.
    """
    n = docs.count()  # of row counts in file footers, where files have them
    share = min(1.0, sample_rows / n) if n else 1.0
    sample = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).sample(False, share, seed) if share < 1 else docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    verdicts = bind(words_of(F.col("t")), lambda w: F.struct(F.size(w).alias("n"), *[r.rejects(F.col("t"), w).alias(f"r{i}") for i, r in enumerate(rules)]))
    seen = sample.select(F.char_length("t").alias("c"), verdicts.alias("v")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("c").alias("c"), F.sum("v.n").alias("w"), *[F.count_if(F.col("v")[f"r{i}"]).alias(f"r{i}") for i in range(len(rules))]
    ).first()
    rows = max(1, seen["n"])
    found = [(r, seen[f"r{i}"] / rows, (1 + r.per_char * (seen["c"] or 0) + r.per_word * (seen["w"] or 0)) / rows) for i, r in enumerate(rules)]
    return sorted(found, key=lambda x: (-(x[1] / x[2]), x[2], x[0].name))


def _cascade(t: Column, w: Column, ordered: list[tuple[Rule, float, float]]) -> Column:
    """The name of the first rule that rejects. A CASE evaluates no branch behind its first true one, and measures are inside the branches."""
    case = None
    for r, _, _ in ordered:
        case = (F if case is None else case).when(r.rejects(t, w), F.lit(r.name))
    return case


def verdicts(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, rules: list[Rule] | None = None) -> DataFrame:
    """docs with rejected_by (the first rule in the cascade's order that rejects, a base rule or another) and kept. No measure is made but those that the
    cascade comes to."""
    ordered = order_rules(docs, [*BASE, *(RULES if rules is None else rules)], text_col, sample_rows)
    t = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.drop(*[c for c in ("rejected_by", "kept") if c != text_col]).withColumn("rejected_by", bind(words_of(t), lambda w: _cascade(t, w, ordered)))
    return out.withColumn("kept", F.col("rejected_by").isNull())


def apply_rules(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, rules: list[Rule] | None = None) -> DataFrame:
    """docs with the measures n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, base_failed, rejected_by and kept.

    A row that fails the base is rejected by `base`; the cascade of the other rules judges the rest alone. A null text is an empty
    one, which fails the base. Rows are judged one by one, texts whole: ties, repeated rows and ids don't matter, and an empty
    table gives no rows. Columns of docs named like a result are replaced.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", "kept", "_m"]
    docs = docs.drop(*[c for c in new if c != text_col])
    ordered = order_rules(docs, RULES if rules is None else rules, text_col, sample_rows)
    t = F.coalesce(F.col(text_col), F.lit(""))

    def measures(w: Column) -> Column:
        return bind(repeated_words(w), lambda r: F.struct(F.size(w).cast("long").alias("n_words"), r.alias("n_repeat_words"), F.when((F.size(w) < 20) | (r * 100 > F.size(w) * 30), F.lit("base")).otherwise(_cascade(t, w, ordered)).alias("rejected_by")))

    out = docs.withColumn("_m", bind(words_of(t), measures)).withColumn("n_words", F.col("_m.n_words")).withColumn("word_chars", word_chars(t)).withColumn("n_symbols", n_symbols(t))
    out = out.withColumn("n_dup_lines", bind(lines_of(t), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")).withColumn("n_repeat_words", F.col("_m.n_repeat_words"))
    return out.withColumn("base_failed", F.col("_m.rejected_by").eqNullSafe(F.lit("base"))).withColumn("rejected_by", F.col("_m.rejected_by")).withColumn("kept", F.col("rejected_by").isNull()).drop("_m")


def op9_quality(spark, sf_dir):
    out = apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The base and the rules in SQL: a verdict doesn't depend on the cascade's order.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
d AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
s AS (SELECT doc_id, start, array_to_string(w[start:start + 7], ' ') AS words FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS start FROM d)),
r AS (SELECT doc_id, start, count(*) OVER (PARTITION BY doc_id, words) AS n FROM s),
p AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(generate_series(start, start + 7)) AS pos FROM r WHERE n > 1) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct,
             CAST(length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS BIGINT) AS letters, CAST(length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS BIGINT) AS capitals
      FROM d LEFT JOIN p USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > word_chars OR (n_lines >= 5 AND 10 * n_dup_lines > 4 * n_lines) OR word_chars > 40 * n_words
            OR (letters > 50 AND 10 * capitals > 7 * letters) OR 4 * letters < word_chars OR (20 * n_distinct < n_words AND n_distinct * n_distinct < 5 * n_words)) AS kept
FROM b"""
