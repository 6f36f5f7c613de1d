"""Operator 8: quality rules as learned decision lists, in DataFrame expressions only.

Statistics of each text are one native expression over its words and lines, without a
shuffle.  Rules are learnt by sequential covering: a rule grows threshold by threshold on
one part of the labelled rows to single out bad documents, is pruned from its end on the
other part, and the rows that it covers leave before the next rule.  The ordered rules
become a chain of Spark conditionals; the first that fires decides.

Learning uses a bounded sample of labelled rows (``per_label`` of each label, the first by
a hash of doc_id); only their statistics, some numbers a row, reach the driver.

Defined results: a null or empty text has no words, fails the base rule and isn't kept.
Words are runs outside the six ASCII white-space characters; lines end at \\n.  Labels that
are null or contradict each other for one document are not learnt from.
"""

from __future__ import annotations

from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Least words, and largest percentage of words in repeated three-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SPACE = r"[\x20\x09-\x0D]+"

# Names bound by a one-element transform are evaluated once, whatever uses them.
STATISTICS = r"""
get(transform(array(filter(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), x -> x <> '')), w -> named_struct(
  'n_words', cast(size(w) AS bigint),
  'word_chars', cast(char_length(array_join(w, '')) AS bigint),
  'n_upper', cast(aggregate(w, 0, (a, x) -> a + if(upper(x) = x AND lower(x) <> x, 1, 0)) AS bigint),
  'n_repeat_words', if(size(w) < 4, 0L, get(transform(array(transform(sequence(0, size(w) - 3), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)))), h ->
    if(size(array_distinct(h)) = size(h), 0L,
      get(transform(array(sort_array(transform(h, (x, i) -> struct(x AS h, i AS i)))), s ->
        get(transform(array(sort_array(transform(
            filter(transform(s, (e, k) -> if(get(s, k - 1).h = e.h OR get(s, k + 1).h = e.h, e.i, -1)), i -> i >= 0), i -> i))), p ->
          aggregate(transform(p, (v, k) -> least(3, coalesce(get(p, k + 1) - v, 3))), 0L, (a, x) -> a + x)), 0)), 0))), 0))
)), 0)
"""
LINES = r"""
get(transform(array(filter(split(coalesce(text, ''), '\n'), l -> l RLIKE '[^\\x20\\x09-\\x0D]')), l -> named_struct(
  'n_lines', cast(size(l) AS bigint), 'n_dup_lines', cast(size(l) - size(array_distinct(l)) AS bigint))), 0)
"""
SYMBOLS = r"cast(char_length(text) - char_length(regexp_replace(text, '[#*$%&|<>]', '')) AS bigint)"

#: Features of the rules, by name, from the statistics.
FEATURES = {
    "n_words": "cast(n_words AS double)",
    "mean_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "dup_lines": "cast(n_dup_lines AS double)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each text."""
    found = docs.select("doc_id", F.expr(STATISTICS).alias("s"), F.expr(LINES).alias("l"), F.coalesce(F.expr(SYMBOLS), F.lit(0).cast("long")).alias("n_symbols"))
    return found.select("doc_id", "s.n_words", "s.word_chars", "n_symbols", "l.n_dup_lines", "s.n_repeat_words", "l.n_lines", "s.n_upper")


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")


# ------------------------------------------------------------------ learning


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.feature] >= self.threshold if self.above else row[self.feature] < self.threshold

    def column(self) -> Column:
        left = F.expr(FEATURES[self.feature])
        return left >= self.threshold if self.above else left < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction, and whether documents it fires on are bad."""

    conditions: tuple[Condition, ...]
    bad: bool = True

    def holds(self, row: dict[str, float]) -> bool:
        return all(c.holds(row) for c in self.conditions)


Row = tuple[dict[str, float], bool]


def candidates(rows: list[Row], most: int = 24) -> list[Condition]:
    """Thresholds between the quantiles of each feature."""
    out = []
    for name in FEATURES:
        values = sorted({r[name] for r, _ in rows})
        step = max(1, len(values) / most)
        cuts = {round((values[i - 1] + values[i]) / 2, 6) for i in sorted({int(k * step) for k in range(1, most + 1)} | {1, len(values) - 1}) if 0 < i < len(values)}
        out += [Condition(name, above, t) for t in sorted(cuts) for above in (True, False)]
    return out


def grow(rows: list[Row], longest: int) -> list[Condition]:
    """Adds the condition with the best information gain until no good row is covered."""
    from math import log2

    covered, conditions = rows, []
    score = lambda bad, all_: log2((bad + 0.5) / (all_ + 1))
    while len(conditions) < longest:
        bad = sum(y for _, y in covered)
        if bad == len(covered) or not bad:
            break
        best, gain = None, 0.0
        for c in candidates(covered):
            kept = [y for r, y in covered if c.holds(r)]
            hit = sum(kept)
            if hit and (g := hit * (score(hit, len(kept)) - score(bad, len(covered)))) > gain + 1e-9:
                best, gain = c, g
        if best is None:
            break
        conditions.append(best)
        covered = [x for x in covered if best.holds(x[0])]
    return conditions


def prune(conditions: list[Condition], rows: list[Row]) -> list[Condition]:
    """Drops conditions from the end while the share of bad rows among the covered doesn't fall."""

    def worth(cut: list[Condition]) -> float:
        hit = [y for r, y in rows if all(c.holds(r) for c in cut)]
        return (sum(hit) + 0.5) / (len(hit) + 1)

    best = conditions
    for n in range(len(conditions) - 1, 0, -1):
        if worth(conditions[:n]) >= worth(best):
            best = conditions[:n]
    return best


def learn(rows: list[Row], longest: int = 3, most: int = 12, purity: float = 0.9, least: int = 4) -> list[Rule]:
    """Sequential covering: rules for bad documents, each at least ``purity`` pure on all rows left."""
    rules: list[Rule] = []
    left = rows
    while len(rules) < most and sum(y for _, y in left) >= least:
        growing, pruning = [r for i, r in enumerate(left) if i % 3], left[::3]
        conditions = grow(growing, longest)
        if not conditions:
            break
        conditions = prune(conditions, pruning)
        rule = Rule(tuple(conditions))
        hit = [y for r, y in left if rule.holds(r)]
        if len(hit) < least or sum(hit) < purity * len(hit):
            break
        rules.append(rule)
        left = [x for x in left if not rule.holds(x[0])]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True to keep: an ordered chain of conditionals."""
    chain = None
    for rule in rules:
        fires = rule.conditions[0].column()
        for c in rule.conditions[1:]:
            fires = fires & c.column()
        chain = F.when(fires, F.lit(not rule.bad)) if chain is None else chain.when(fires, F.lit(not rule.bad))
    return F.lit(True) if chain is None else chain.otherwise(F.lit(True))


def labelled(docs: DataFrame, labels: DataFrame, per_label: int) -> list[Row]:
    """Features of the bounded sample, good rows and bad ones, in the order of a hash of doc_id."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high")
    parts = [known.where(F.col("low") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label).select("doc_id").collect() for y in (0, 1)]
    bad = {r.doc_id for r in parts[0]}
    chosen = docs.sparkSession.createDataFrame([(r.doc_id,) for p in parts for r in p], "doc_id long")
    few = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * per_label rows
    # the base rule is applied here: as a filter in the plan it would sink below the join and be computed for every document
    rows = statistics(few).select("doc_id", "n_repeat_words", *(F.expr(e).alias(n) for n, e in FEATURES.items())).collect()
    rows = [r for r in rows if r.n_words >= MIN_WORDS and 100 * r.n_repeat_words <= MAX_REPEAT_PERCENT * r.n_words]
    return [({n: float(r[n]) for n in FEATURES}, r.doc_id in bad) for r in sorted(rows, key=lambda r: (xxhash.xxh3_64_intdigest(b"%d" % r.doc_id), r))]


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, statistics, base_failed and kept of each document."""
    return statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules)))


def op8_quality_rules(spark: SparkSession, sf_dir: str, per_label: int = 3000) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    rules = learn(labelled(docs, common.table(spark, sf_dir, "labels"), per_label))
    return judged(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
