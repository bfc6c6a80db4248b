"""Quality rules whose cutoffs carry a certificate against false rejection (DataFrame functions only).

Every document gets four scores (higher is worse). For each stratum (``lang``)
and rule, cutoffs are tested from the loosest to the tightest against the
labelled good documents (``labels.quality = 1``): a cutoff is certified while
the exact binomial test rejects "its false-rejection rate is above the rule's
share of ``alpha``". Testing in a fixed sequence needs no correction within a
rule; across rules and strata the level ``delta`` is divided by their number
(Bonferroni). The shares of ``alpha`` add up over the rules, so with
probability 1 - ``delta`` no stratum loses more than ``alpha`` of its good
documents. Of the certified cutoffs the one with most labelled bad documents
net of ``price`` times the good ones is used; ties take the loosest, and a
stratum without a certificate rejects nothing beyond the base rules.

Defined cases: a null or empty text has no words and fails the base rule;
null ``lang`` is a stratum of its own; labels with null or contradictory
values, or without a document, are ignored; repeated rows are judged alike;
an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import plain, read_table, restored, stored, words_of

#: Scores that carry a learnt cutoff; each is a ratio, tested at k / GRID.
RULES = ("symbols", "dup_lines", "repeats", "short_lines")
GRID = 100
_P = "_q_"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_short_lines")


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base counts of :data:`FEATURES` in columns ``_q_<name>``.

    All are array functions of the row, so there is no shuffle. Repeated
    three-word windows are found by sorting (hash, position) pairs.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    blank_free = lambda lines: F.filter(lines, lambda l: F.btrim(l, F.lit(" \t\n\x0b\f\r")) != F.lit(""))
    out = docs.withColumns({
        _P + "w": words_of(F.col(text)),
        _P + "l": blank_free(F.split(body, "\n")),
        _P + "n_symbols": (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("long"),
    })
    w, n = F.col(_P + "w"), F.size(_P + "w")
    grams = F.transform(w, lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    out = out.withColumns({
        _P + "g": F.sort_array(F.slice(grams, F.lit(1), F.greatest(n - 2, F.lit(0)))),
        _P + "n_words": n.cast("long"),
        _P + "word_chars": F.length(F.array_join(w, "")).cast("long"),
        _P + "n_lines": F.size(_P + "l").cast("long"),
        _P + "n_dup_lines": (F.size(_P + "l") - F.size(F.array_distinct(_P + "l"))).cast("long"),
        _P + "n_short_lines": F.size(F.filter(_P + "l", lambda l: F.length(l) < 20)).cast("long"),
    })
    g = F.col(_P + "g")
    again = F.filter(g, lambda x, i: (x["h"] == F.get(g, i - 1)["h"]) | (x["h"] == F.get(g, i + 1)["h"]))
    covered = F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    out = out.withColumn(_P + "n_repeat_words", F.size(covered).cast("long"))
    return out.drop(_P + "w", _P + "l", _P + "g")


def base_failed() -> Column:
    n = F.col(_P + "n_words")
    return (n < 50) | (100 * F.col(_P + "n_repeat_words") > 50 * n)


def _level(rule: str) -> Column:
    """The largest grid step (0 to GRID) that the rule's score reaches."""
    part, whole = {
        "symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"),
        "repeats": ("n_repeat_words", "n_words"), "short_lines": ("n_short_lines", "n_lines"),
    }[rule]
    p, q = F.col(_P + part), F.col(_P + whole)
    return F.least(F.lit(GRID), F.when(q > 0, F.floor(p * GRID / q)).otherwise(0)).cast("int")


def _ln_factorial(n: Column) -> Column:
    x = n.cast("double")
    stirling = x * F.log(x) - x + 0.5 * F.log(2 * F.pi() * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5)))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(stirling)


def binomial_tail(n: Column, k: Column, p: float, terms: int = 4000) -> Column:
    """P(Binomial(n, p) <= k) for k below n * p (1 otherwise: no certificate is possible).

    Terms are added from k downwards; what is left after ``terms`` of them is
    bounded by its geometric series, so the value is never too small.
    """
    top = F.exp(_ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    ratio = lambda i: i * (1 - p) / ((n - i + 1) * p)
    steps = F.when((k < n * p) & (k > 0), F.sequence(F.lit(0).cast("long"), F.least(k, F.lit(terms)) - 1)).otherwise(F.array().cast("array<bigint>"))
    acc = F.aggregate(
        steps,
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda a, j: F.struct((a["t"] * ratio(k - j)).alias("t"), (a["s"] + a["t"] * ratio(k - j)).alias("s")),
    )
    rest = F.when(k > terms, acc["t"] / (1 - ratio(k - terms))).otherwise(0.0)
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), top * (acc["s"] + rest)))


def cutoffs(featured: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05, price: float = 10.0) -> DataFrame:
    """One row per stratum with a certificate: ``stratum`` and the grid step ``cut_<rule>`` of each rule (null: none)."""
    known = (
        labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("z"))
        .where("doc_id is not null and q = z and q in (0, 1)").select(F.col("doc_id").alias("_id"), "q")
    )
    levels = F.array(*[F.struct(F.lit(r).alias("rule"), _level(r).alias("level")) for r in RULES])
    cells = (
        featured.where(~base_failed())
        .select(F.col("doc_id").alias("_id"), F.col(stratum).cast("string").alias("stratum"), levels.alias("_levels"))
        .join(known, "_id")
        .select("stratum", "q", F.explode("_levels").alias("x"))
        .groupBy("stratum", "x.rule", "x.level").agg(F.sum("q").alias("good"), F.sum(1 - F.col("q")).alias("bad"))
    )
    cells = stored(cells, "quality-cells")
    tests = max(1, cells.select("stratum").distinct().count()) * len(RULES)
    group = Window.partitionBy("stratum", "rule")
    down = group.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    # cutoffs between two occupied steps act alike; the occupied step itself stands for them
    table = (
        cells.withColumns({"n": F.sum("good").over(group), "k": F.sum("good").over(down), "hit": F.sum("bad").over(down)})
        .where("level > 0")
    )
    tail = binomial_tail(F.col("n"), F.col("k"), alpha / len(RULES))
    best = (
        table.withColumn("ok", (F.col("n") > 0) & (tail <= delta / tests))
        .withColumn("ok", F.min("ok").over(down))
        .where("ok").withColumn("gain", F.col("hit") - price * F.col("k"))
        .where("gain > 0")
        .groupBy("stratum", "rule").agg(F.max(F.struct("gain", "level"))["level"].alias("level"))
    )
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("level"))).alias("cut_" + r) for r in RULES])


def judged(featured: DataFrame, cuts: DataFrame, stratum: str = "lang") -> DataFrame:
    """Adds ``_q_base_failed`` and ``_q_kept``; ``cuts`` has one row per stratum and is joined under Spark's size check."""
    c = cuts.select(F.col("stratum").alias("_q_s"), *[F.col("cut_" + r).alias("_q_cut_" + r) for r in RULES])
    over = F.lit(False)
    for r in RULES:
        over = over | F.coalesce(_level(r) >= F.col("_q_cut_" + r), F.lit(False))
    out = featured.join(c, F.col(stratum).cast("string").eqNullSafe(F.col("_q_s")), "left")
    return out.withColumn("_q_base_failed", base_failed()).withColumn("_q_kept", ~base_failed() & ~over).drop("_q_s", *["_q_cut_" + r for r in RULES])


def apply_rules(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """``docs`` with features and verdict. Features are computed once and written; the cutoffs are learnt from them."""
    featured = stored(with_features(docs), "quality-features")
    return judged(featured, stored(cutoffs(featured, labels, **params), "quality-cutoffs"))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    featured = stored(with_features(docs.select("doc_id", "lang", "text")).drop("text"), "quality-features")
    cuts = stored(cutoffs(featured, read_table(spark, sf_dir, "labels")), "quality-cutoffs")
    names = FEATURES[:5]
    return judged(featured, cuts).select("doc_id", *[F.col(_P + n).alias(n) for n in names], F.col("_q_base_failed").alias("base_failed"), F.col("_q_kept").alias("kept"))


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; the columns stay as they are."""
    used = ("doc_id", "lang", "text")
    return restored(apply_rules(plain(docs, *used), read_table(spark, sf_dir, "labels")).where("_q_kept"), docs, *used)


#: Base counts, the exact binomial tail by sums of its terms, and the fixed sequence of tests.
ORACLE = r"""
with d as (select doc_id, lang, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as a, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
i as (select doc_id, unnest(range(1, len(a) - 1)) as i, a from w),
g as (select doc_id, i, count(*) over (partition by doc_id, a[i:i + 2]) as n from i),
r as (select doc_id, count(distinct i + j) as n_repeat_words from g, range(3) q(j) where n > 1 group by doc_id),
f as (select doc_id, lang, len(a) as n_words, length(array_to_string(a, '')) as word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) as n_symbols,
  len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, len(l) as n_lines, len(list_filter(l, lambda x: length(x) < 20)) as n_short_lines
  from w left join r using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  [least(100, case when word_chars > 0 then n_symbols * 100 // word_chars else 0 end), least(100, case when n_lines > 0 then n_dup_lines * 100 // n_lines else 0 end),
   least(100, case when n_words > 0 then n_repeat_words * 100 // n_words else 0 end), least(100, case when n_lines > 0 then n_short_lines * 100 // n_lines else 0 end)] as levels from f),
y as (select doc_id, min(quality) as q from labels group by doc_id having min(quality) = max(quality) and min(quality) in (0, 1)),
z as (select lang, q, k as rule, levels[k] as level from b join y using (doc_id), range(1, 5) r(k) where not base_failed),
c as (select lang, rule, level, sum(q) as good, sum(1 - q) as bad from z group by all),
n as (select count(*) * 4 as tests from (select distinct lang from c)),
s as (select *, sum(good) over (partition by lang, rule) as n, sum(good) over (partition by lang, rule order by level desc) as k, sum(bad) over (partition by lang, rule order by level desc) as hit from c),
p as (select s.*, k < n * 0.0125 and n > 0 and
  list_sum(list_transform(range(0, k::bigint + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.0125) + (n - j) * ln(0.9875)))) <= 0.05 / tests as ok from s, n where level > 0),
o as (select *, bool_and(ok) over (partition by lang, rule order by level desc) as certified from p),
m as (select lang, rule, max(struct_pack(gain := hit - 10 * k, level := level)).level as cut from o where certified and hit - 10 * k > 0 group by all)
select b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not exists (select 1 from m where m.lang is not distinct from b.lang and b.levels[m.rule] >= m.cut) as kept
from b
"""
