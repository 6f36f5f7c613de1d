"""Operator 12: phrase collocations from sketched candidates and guarded automata.

Texts are lower-cased (A-Z), split at ``. , ; : ! ?`` and line ends into pieces, and those at
spaces and tabs into words.  Everything is per language.

1. Sketch.  One counting pass for words, one for pairs, one for phrases of three and four.  Words
   are counted by 64-bit hash.  Longer ones are hashed to ``WIDTH`` cells, and cells that collide
   add up, so the sum of a cell is an upper bound of each of its n-grams' counts.  Cells are summed by Spark as a sparse table;
   those of ``LEAST`` or more go to a filter.  A phrase is only counted if all shorter phrases
   inside it passed, which no phrase of ``LEAST`` occurrences can fail.
2. Automata.  Each shard (a language's part of some ``SHARD_BYTES`` of texts) compiles the phrases that
   pass all filters into Aho-Corasick automata, with a space as guard on either side, and scans
   its texts; matches may overlap.  Words by themselves are only parts of candidates; their
   counts are known from the first pass.  An automaton holds at most ``AUTOMATON_CHARS`` characters:
   more patterns make further automata and scans.
3. Sums.  Counts of shards are summed by phrase, and only then the threshold holds: counts are
   exact, whatever the sketch let through.
4. Scores, containment and ranking are joins and a window over the candidates alone.

Defined results: a null or empty text has no words; a null lang is ``und``; rows that repeat a
doc_id, or have none, count each; an empty table gives no rows; a language without candidates
has no rows.  Ties of the score fall to the larger count, then to the phrase in byte order.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.skew import join_splittable
from . import common

U64 = np.uint64
LEAST, LONGEST, TOP = 30, 4, 2000
#: Cells of the sketch; only those in use are stored.
WIDTH = 1 << 40
SHARD_BYTES, AUTOMATON_CHARS = 4 << 20, 2 << 20
#: What separates pieces; all become a full stop, which no word holds.
MARK = b"."
PIECES = bytes.maketrans(b",;:!?\n\x0b\x0c\r", MARK * 9)
BREAK = U64(common.WordHashes()[MARK])


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text, with a mark between pieces."""
    return text.lower().translate(PIECES).replace(MARK, b" . ").split() if text else []


class Shard:
    """The words of some texts, one after the other, with marks between pieces and texts."""

    def __init__(self, texts: list[bytes | None], langs: list[str], hashes: common.WordHashes):
        self.words: list[bytes] = []
        lengths = []
        for text in texts:
            before = len(self.words)
            self.words += words_of(text)
            self.words.append(MARK)
            lengths.append(len(self.words) - before)
        self.hashed = hashes.of(self.words)
        self.inner = self.hashed != BREAK
        seeds = {lang: hashes[b"lang " + lang.encode("utf-8", "surrogatepass")] for lang in set(langs)}
        self.seed = np.repeat(np.array([seeds[x] for x in langs], U64), lengths)

    def grams(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hash of the ``n`` words from each of the places ``at`` on, which lie in a text."""
        out = np.zeros(len(at), U64)
        for k in range(n):
            out = common.mix(out * U64(0x9E3779B97F4A7C15) + self.hashed[at + k] + U64(k + 1))
        return out + self.seed[at]

    def passing(self, filters: dict[int, np.ndarray], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length up to ``longest``: the places whose words lie in a piece and pass the filters of all shorter lengths, and of their own if there is one, and their hashes."""
        good = self.inner
        for n in range(1, min(longest, len(self.hashed)) + 1):
            if n > 1:
                good = good[:-1] & good[1:]
            at = np.flatnonzero(good)
            grams = self.grams(at, n)
            if n in filters:
                keep = common.in_filter(filters[n], cells(grams) if n > 1 else grams)
                good = np.zeros(len(good), bool)
                at, grams = at[keep], grams[keep]
                good[at] = True
            yield n, at, grams


def cells(grams: np.ndarray) -> np.ndarray:
    """Hash of the sketch's cell of each n-gram."""
    return common.mix(common.mix(grams) & U64(WIDTH - 1))


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes | None], list[str]]]:
    for batch in common.gathered(batches, "text", SHARD_BYTES):
        texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
        yield texts, ["und" if x is None else x for x in batch.column(batch.schema.get_field_index("lang")).to_pylist()]


def sketch_batches(batches: Iterator[pa.RecordBatch], lengths: tuple[int, ...], filters: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(h, n): cells of the windows of ``lengths`` words whose shorter phrases pass, counted within a shard."""
    hashes = common.WordHashes()
    for texts, langs in shards(batches):
        shard = Shard(texts, langs, hashes)
        for k, at, grams in shard.passing(filters, max(lengths)):
            if k in lengths and len(at):
                h, n = np.unique(cells(grams) if k > 1 else grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])


def automata(patterns: list[str]) -> Iterator[ahocorasick.Automaton]:
    """Guarded automata over the patterns, each of bounded size; values are positions in ``patterns``."""
    made, size = ahocorasick.Automaton(), 0
    for k, phrase in enumerate(patterns):
        made.add_word(f" {phrase} ", k)
        size += len(phrase) + 2
        if size > AUTOMATON_CHARS:
            made.make_automaton()
            yield made
            made, size = ahocorasick.Automaton(), 0
    if size:
        made.make_automaton()
        yield made


def matches(patterns: list[str], text: str) -> np.ndarray:
    """Occurrences of each pattern between guards, overlaps included."""
    out = np.zeros(len(patterns), np.int64)
    for automaton in automata(patterns):
        found = np.fromiter(map(itemgetter(1), automaton.iter(text)), np.int64)
        out += np.bincount(found, minlength=len(patterns))
    return out


def count_batches(batches: Iterator[pa.RecordBatch], filters: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, f, first, last) of the phrases that pass, counted within a shard; first and last are hashes of its outer words.

    The row of the empty phrase counts all words.
    """
    hashes = common.WordHashes()
    for texts, langs in shards(batches):
        for lang in sorted(set(langs)):
            mine = [t for t, x in zip(texts, langs, strict=True) if x == lang]
            shard = Shard(mine, [lang] * len(mine), hashes)
            scanned = b" " + b" ".join(shard.words) + b" "
            behind = np.cumsum(np.fromiter(map(len, shard.words), np.int64, len(shard.words)) + 1)
            begin = np.append(0, behind[:-1]) + 1
            patterns: list[str] = []
            outer: list[list[np.ndarray]] = [[np.zeros(1, U64)], [np.zeros(1, U64)]]
            for n, at, grams in shard.passing(filters, LONGEST):
                if n > 1:
                    at = at[np.unique(grams, return_index=True)[1]]
                    patterns += [scanned[a:b].decode("utf-8", "surrogatepass") for a, b in zip(begin[at].tolist(), behind[at + n - 1].tolist(), strict=True)]
                    for k, side in enumerate(outer):
                        side.append(shard.grams(at + k * (n - 1), 1))
            counts = np.append(int(shard.inner.sum()), matches(patterns, scanned.decode("utf-8", "surrogatepass")))
            columns = [pa.array([lang], pa.string()).take(pa.array(np.zeros(len(counts), np.int32))), pa.array(["", *patterns], pa.string()), pa.array(counts), *(pa.array(np.concatenate(side).view(np.int64)) for side in outer)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "f", "first", "last"])


# ---------------------------------------------------------------- joins over the candidates


def counted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exact counts: lang, phrase, f, first, last of phrases of two to LONGEST words with LEAST occurrences (and all words: the empty phrase); h, f of words."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    tables = common.Workspace(spark, "phrases")
    texts = docs.select("text", "lang")
    filters: dict = {}
    heavy: list[DataFrame] = []
    for lengths in ((1,), (2,), (3, 4)):
        known = dict(filters)
        found = texts.mapInArrow(common.tidy(lambda b, lengths=lengths, known=known: sketch_batches(b, lengths, {k: v.value for k, v in known.items()})), "h long, n long")
        heavy.append(tables.write(found.groupBy("h").agg(F.sum("n").alias("f")).where(F.col("f") >= LEAST), f"cells{lengths[0]}"))
        filters |= dict.fromkeys(lengths, spark.sparkContext.broadcast(common.filter_of(heavy[-1].select("h"))))
    tables.drop(*heavy[1:])
    common.release(spark)
    found = texts.mapInArrow(common.tidy(lambda b: count_batches(b, {k: v.value for k, v in filters.items()})), "lang string, phrase string, f long, first long, last long")
    sums = found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"), F.min("first").alias("first"), F.min("last").alias("last"))
    return tables.write(sums.where((F.col("f") >= LEAST) | (F.col("phrase") == "")), "counts"), heavy[0]


def scored(counts: DataFrame, words: DataFrame) -> DataFrame:
    """lang, phrase, size, a, l, r, score of each candidate, by its lowest-scoring cut.

    The parts of all cuts meet the counts in one join: a part of one word by its hash, a longer one
    by language and text.
    """
    phrases = counts.where("phrase <> ''").withColumn("size", F.size(F.split("phrase", " ")))
    known = words.select(F.lit("").alias("in_lang"), F.lit("").alias("part"), "h", F.col("f").alias("n"))
    known = known.unionByName(phrases.select(F.col("lang").alias("in_lang"), F.col("phrase").alias("part"), F.lit(0).cast("long").alias("h"), F.col("f").alias("n")))
    cuts = phrases.select("lang", "phrase", "size", F.col("f").alias("a"), "first", "last", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    left = F.expr("IF(k = 1, struct(0 AS side, '' AS in_lang, '' AS part, first AS h), struct(0 AS side, lang AS in_lang, substring_index(phrase, ' ', k) AS part, 0L AS h))")
    right = F.expr("IF(k = size - 1, struct(1 AS side, '' AS in_lang, '' AS part, last AS h), struct(1 AS side, lang AS in_lang, substring_index(phrase, ' ', k - size) AS part, 0L AS h))")
    sides = cuts.select("lang", "phrase", "size", "a", "k", F.explode(F.array(left, right)).alias("x")).select("lang", "phrase", "size", "a", "k", "x.*")
    met = join_splittable(sides, known, ["in_lang", "part", "h"]).select("lang", "phrase", "size", "a", "k", "side", "n").repartition("lang", "phrase")
    both = met.groupBy("lang", "phrase", "size", "a", "k").agg(F.max(F.expr("IF(side = 0, n, NULL)")).alias("l"), F.max(F.expr("IF(side = 1, n, NULL)")).alias("r"))
    both = both.withColumn("score", F.expr("(CAST(a AS DECIMAL(20,0)) * 2000000) div (CAST(l AS DECIMAL(20,0)) + r)"))
    best = both.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "size")).alias("best"))
    return best.select("lang", "phrase", "best.size", "best.a", "best.l", "best.r", "best.score")


def contained(candidates: DataFrame) -> DataFrame:
    """lang, phrase, most: the largest count of a longer candidate around each phrase that lies in one."""
    words = candidates.where("size > 2").select("lang", "a", "size", F.split("phrase", " ").alias("w"))
    inner = words.select("lang", "a", "w", F.explode(F.expr("flatten(transform(sequence(2, size - 1), n -> transform(sequence(1, size - n + 1), i -> array_join(slice(w, i, n), ' '))))")).alias("phrase"))
    return inner.groupBy("lang", "phrase").agg(F.max("a").alias("most"))


def ranked(counts: DataFrame, words: DataFrame) -> DataFrame:
    """The first TOP candidates of each language that no longer one covers."""
    candidates = scored(counts, words)
    longer = counts.where("phrase <> ''").select("lang", F.col("f").alias("a"), F.size(F.split("phrase", " ")).alias("size"), "phrase")
    free = join_splittable(candidates, contained(longer), ["lang", "phrase"], "left")
    free = free.where(F.expr("most IS NULL OR CAST(most AS DECIMAL(20,0)) * 100 < CAST(a AS DECIMAL(20,0)) * 80"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    top = free.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    total = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return top.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of ``docs`` (text, lang)."""
    return ranked(*counted(docs))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), words AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), grams AS (
  SELECT lang, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS phrase FROM words, range(1, 5) t(n) WHERE len(w) >= n
), f AS (SELECT lang, n AS size, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY 1
), candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 30
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, (2000000 * c.a::HUGEINT // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM candidates c, range(1, 4) t(k)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')
  WHERE k < c.size
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, a, unnest(list_transform(range(1, size - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS phrase FROM candidates, range(2, 4) t(n) WHERE n < size
), longest AS (SELECT lang, phrase, max(a) AS most FROM inside GROUP BY ALL
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, encode(b.phrase)) AS rank, b.phrase, b.a, b.l, b.r, t.n, b.score
FROM best b JOIN totals t ON t.lang = b.lang LEFT JOIN longest m ON m.lang = b.lang AND m.phrase = b.phrase
WHERE m.most IS NULL OR 100 * m.most::HUGEINT < 80 * b.a::HUGEINT
QUALIFY rank <= 2000
"""
