"""Operator 9: benchmark decontamination by template canonicalisation.

Words become lower-case literals; numbers, names (title-case words; a run of them is one)
and units become typed placeholders.  Whether a title-case word that begins a sentence is a
name can't be seen, so there are two templates: one has it as a literal, the other as a
name of its own, which joins the names behind it if the text has it title-case within a
sentence, too.  Windows of ``WINDOW`` tokens of the benchmark, as either template and as
plain words, are hashed and equi-joined with the windows of all documents.  A filter of
fixed size keeps windows that can't match out of the shuffle; the join decides.

Matches of a document and an item on one alignment must fill the slots consistently: equal
values of the item stand for equal values in the document.  So a question whose numbers and
names are exchanged throughout is caught, and a chance mixture isn't.  A pair is
contaminated if the consistent alignments cover at least ``MIN_COVER`` of the item's
windows, or ``MIN_RUN`` windows of one alignment.

Defined results: items of fewer than ``WINDOW`` tokens match as a whole if they have at
least ``LEAST`` tokens, and never otherwise; windows with fewer than ``LITERALS`` literals
(half the tokens of a short item) are weak: they count only on an alignment that has
another window.  Null or empty texts match nothing, rows with a null id are left out.
Repeated document rows give one pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, LITERALS, LEAST = 8, 4, 5
MIN_COVER, MIN_RUN = 0.5, 13
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]|\d+(?:[.,]\d+)*")
#: Unit words and number words: fixed values.
UNITS = frozenset(
    """mm cm m km mg g kg t ml l s ms min h hr hrs inch inches ft foot feet yard yards mile miles meter meters metre metres
    kilometer kilometers kilometre kilometres gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres
    second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros
    usd eur gbp percent degree degrees kmh mph hz khz mhz ghz watt watts volt volts joule joules""".split()
)
NUMBERS = frozenset(
    """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen
    nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion""".split()
)
MARKS = frozenset(".!?\n")
LITERAL, NUMBER, UNIT, TITLE, MARK = range(5)
#: Hashes of the placeholders; no word has a space.
SLOTS = {kind: xxhash.xxh3_64_intdigest(b" slot %d" % kind) for kind in (NUMBER, UNIT, TITLE)}
U64 = np.uint64
#: What windows are made of: templates with literal or with named sentence starts, and plain words.
TEMPLATE, PLAIN, NAMED = FAMILIES = range(3)


class Tokens(dict):
    """Token -> row of its kind and hash; remembers tokens up to a fixed number."""

    LIMIT = 500_000

    def __init__(self) -> None:
        self.kinds, self.hashes = np.zeros(1024, np.int8), np.zeros(1024, U64)

    def __missing__(self, token: str) -> int:
        at = self[token] = len(self)
        if at == len(self.kinds):
            self.kinds, self.hashes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.kinds, self.hashes))
        low = token.lower()
        if token in MARKS:
            kind = MARK
        elif low in NUMBERS or token[0].isdigit():
            kind = NUMBER
        elif low in UNITS:
            kind = UNIT
        else:
            kind = TITLE if low != token and len(token) > 1 and token.istitle() else LITERAL
        self.kinds[at], self.hashes[at] = kind, xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass"))
        return at

    def of_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, kinds, sentence starts and text numbers of all words (not marks) of the texts, one after the other."""
        if len(self) > self.LIMIT:
            self.clear()
        row = self.__getitem__
        parts = [np.fromiter(map(row, found := TOKEN.findall(t)), np.int64, len(found)) if t else np.empty(0, np.int64) for t in texts]
        at = np.concatenate(parts) if parts else np.empty(0, np.int64)
        sizes = np.array([len(p) for p in parts], np.int64)
        kinds, hashes = self.kinds[at], self.hashes[at]
        starts = np.ones(len(kinds), bool)
        starts[1:] = kinds[:-1] == MARK
        starts[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        keep = kinds != MARK
        return hashes[keep], kinds[keep], starts[keep], np.repeat(np.arange(len(texts)), sizes)[keep]

    def of(self, text: str | None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """The words of one text, their hashes, kinds and sentence starts."""
        words = [t for t in TOKEN.findall(text) if t not in MARKS] if text else []
        return (words, *self.of_many([text])[:3])


def canonical(hashes: np.ndarray, kinds: np.ndarray, starts: np.ndarray, owner: np.ndarray, named: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template tokens: hashes, whether literal, first word and the word behind the last of each.

    ``named``: title-case words that begin a sentence are names, otherwise literals.
    """
    title = kinds == TITLE
    opening = title & starts
    if not named:
        kinds, title = np.where(opening, LITERAL, kinds), title & ~starts
    first = np.ones(len(kinds), bool)
    first[1:] = ~title[1:] | ~title[:-1] | starts[1:]
    if named:  # does a sentence's first word belong to the name behind it?
        lead = np.flatnonzero(opening[:-1] & ~first[1:])
        if len(lead):
            key = common.mix(hashes + owner.astype(U64) * U64(0x9E3779B97F4A7C15))
            first[lead[~np.isin(key[lead], key[title & ~starts])] + 1] = True
    begin = np.flatnonzero(first)
    out = hashes[begin].copy()
    for kind, h in SLOTS.items():
        out[kinds[begin] == kind] = h
    return out, kinds[begin] == LITERAL, begin, np.append(begin[1:], len(kinds))


def hashed(tokens: np.ndarray, literal: np.ndarray, size: int, family: int) -> tuple[np.ndarray, np.ndarray]:
    """Window hashes and which of the windows have literals enough."""
    h = common.windows(tokens, size) ^ U64(family * 0x5851F42D4C957F2D + size)
    total = np.concatenate([[0], np.cumsum(literal)])
    return h, total[size:] - total[: len(h)] >= (LITERALS if size >= WINDOW else -(-size // 2))


def windows_of(parts: tuple, sizes: list[int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None, np.ndarray | None]]:
    """(family, size, hashes, good, literal, begin, end) of each family."""
    hashes = parts[1]
    plain = np.ones(len(hashes), bool)
    for family in FAMILIES:
        tokens, literal, *places = (hashes, plain, None, None) if family == PLAIN else template(parts, family)
        for size in sizes:
            yield (family, size, *hashed(tokens, literal, size, family), None if family == PLAIN else literal, *places)


def template(parts: tuple, family: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A template of the one text of ``parts``."""
    return canonical(*parts[1:], np.zeros(len(parts[1]), np.int64), family == NAMED)


def slot_values(words: list[str], at: int, size: int, literal: np.ndarray | None, begin: np.ndarray | None, end: np.ndarray | None) -> list[str]:
    """What stands in the slots of a window, in order."""
    if literal is None:
        return []
    return [" ".join(words[begin[i] : end[i]]).lower() for i in range(at, at + size) if not literal[i]]


WINDOW_TYPES = "item_id long, family int, h long, at long, total long, slots array<string>"


def item_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens = Tokens()
    for ids, texts in common.rows(batches, "item_id", "text"):
        out: list[tuple] = []
        for item, text in zip(ids, texts, strict=True):
            parts = tokens.of(text)
            sizes = {PLAIN: len(parts[0])} | {f: len(template(parts, f)[0]) for f in (TEMPLATE, NAMED)}
            for family, n in sizes.items():
                if item is None or n < LEAST:
                    continue
                for f, size, h, good, *slots in windows_of(parts, [min(WINDOW, n)]):
                    if f == family and good.any():
                        out += [(item, f, int(x), i, len(h), slot_values(parts[0], i, size, *slots)) for i, x in enumerate(h.view(np.int64))]
        yield batch_of(out, WINDOW_TYPES)


def batch_of(made: list[tuple], types: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    fields = [x.split() for x in types.split(", ")]
    columns = zip(*made, strict=True) if made else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


HIT_TYPES = "doc_id long, family int, h long, doc_at long, strong boolean, doc_slots array<string>"


def near(places: np.ndarray, strong: np.ndarray, reach: int) -> np.ndarray:
    """Which places are less than ``reach`` from one of ``strong`` (both in order)."""
    return np.searchsorted(strong, places - reach, "right") < np.searchsorted(strong, places + reach)


def document_batches(batches: Iterator[pa.RecordBatch], wanted: np.ndarray, sizes: list[int], reach: int) -> Iterator[pa.RecordBatch]:
    """The windows of documents that the filter lets through, weak ones within an item's length of another.

    Windows of a whole batch are hashed at once, those across two texts left out.  Slots are
    looked up only in texts with a hit.
    """
    tokens = Tokens()
    for batch in common.gathered(batches, "text", 1 << 19):
        for ids, texts in common.rows([batch], "doc_id", "text"):
            hashes, kinds, starts, owner = tokens.of_many(texts)
            found: list[tuple[int, int, int, int, int, bool]] = []
            for family in FAMILIES:
                h, is_literal, begin = (hashes, np.ones(len(hashes), bool), slice(None)) if family == PLAIN else canonical(hashes, kinds, starts, owner, family == NAMED)[:3]
                own = owner[begin]
                first = np.searchsorted(own, np.arange(len(texts)))
                for size in sizes:
                    keys, good = hashed(h, is_literal, size, family)
                    if not len(keys):
                        continue
                    hit = np.flatnonzero((own[: len(keys)] == own[size - 1 :]) & common.in_filter(wanted, keys))
                    strong = hit[good[hit]]
                    hit = hit[good[hit] | near(hit, strong, reach)]
                    found += [(int(own[i]), family, int(keys[i : i + 1].view(np.int64)[0]), int(i - first[own[i]]), size, bool(good[i])) for i in hit]
            out: list[tuple] = []
            last, parts, slots = (-1, 0), None, {}
            for text, family, key, at, size, strong in sorted(found):
                if (text, family) != last:
                    if text != last[0]:
                        parts, slots = tokens.of(texts[text]), {}
                    last = text, family
                    if family != PLAIN:
                        slots = template(parts, family)[1:]
                out.append((ids[text], family, key, at, strong, slot_values(parts[0], at, size, *slots) if family != PLAIN else []))
            yield batch_of(out, HIT_TYPES)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, coverage, windows, run, exact of each contaminated pair."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    items = common.written(benchmark.select("item_id", "text").mapInArrow(item_batches, WINDOW_TYPES).distinct(), "benchmark-windows")
    # items shorter than a window need windows of their own length
    short = benchmark.select("text").mapInArrow(short_sizes, "n int").distinct().collect()  # three sizes at most
    sizes = [WINDOW, *sorted(r.n for r in short)]
    wanted = spark.sparkContext.broadcast(common.filter_of(items.select("h")))
    reach = items.agg(F.max("total")).first()[0] or 0
    hits = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(common.tidy(lambda b: document_batches(b, wanted.value, sizes, reach)), HIT_TYPES)
    joined = hits.join(items, ["h", "family"]).select("doc_id", "item_id", "family", (F.col("doc_at") - F.col("at")).alias("shift"), "at", "total", "strong", F.arrays_zip("slots", "doc_slots").alias("pairs"))
    # one alignment holds at most the item's windows, so its sets are bounded by the item
    strong = lambda c: F.when(F.col("strong"), F.col(c))
    aligned = joined.groupBy("doc_id", "item_id", "family", "shift").agg(
        F.collect_set("at").alias("places"), F.collect_set(strong("at")).alias("strong_places"), F.max("total").alias("total"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"), F.array_distinct(F.flatten(F.collect_set(strong("pairs")))).alias("strong_pairs"),
    ).where(F.size("strong_places") > 0)
    consistent = lambda c: F.size(F.array_distinct(F.transform(c, lambda p: p["slots"]))) == F.size(c)
    # weak windows add to an alignment, but don't spoil one that is consistent without them
    aligned = aligned.where(consistent("strong_pairs")).withColumn("whole", consistent("pairs"))
    aligned = aligned.select("doc_id", "item_id", "family", "total", F.when(F.col("whole"), F.col("places")).otherwise(F.col("strong_places")).alias("places"), F.when(F.col("whole"), F.col("pairs")).otherwise(F.col("strong_pairs")).alias("pairs"))
    same = F.forall("pairs", lambda p: p["slots"] == p["doc_slots"])
    good = aligned.select("doc_id", "item_id", "family", "total", F.size("places").alias("run"), same.alias("exact"), F.explode("places").alias("at"))
    family = good.groupBy("doc_id", "item_id", "family").agg(F.count_distinct("at").alias("windows"), F.max("run").alias("run"), F.max("total").alias("total"), F.bool_or("exact").alias("exact"))
    best = family.withColumn("coverage", F.col("windows") / F.col("total")).where((F.col("coverage") >= MIN_COVER) | (F.col("run") >= MIN_RUN))
    return best.groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"), F.max("windows").alias("windows"), F.max("run").alias("run"), F.bool_or((F.col("family") == PLAIN) | F.col("exact")).alias("exact"))


def short_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens = Tokens()
    for (texts,) in common.rows(batches, "text"):
        found = set()
        for text in texts:
            parts = tokens.of(text)
            found |= {n for n in (len(parts[0]), *(len(template(parts, f)[0]) for f in (TEMPLATE, NAMED))) if LEAST <= n < WINDOW}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int32())], names=["n"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, without a contaminated pair."""
    return docs.join(matches(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
