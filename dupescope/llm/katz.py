"""Operator 3: Katz backoff language model with Good-Turing discounts.

The text is cut into blocks of documents, and blocks and n-gram tables talk in messages of
packed arrays, so that what is shuffled is each block's distinct n-grams, not its tokens:

1. Every block sends its distinct n-grams (sorted 64-bit keys, with their counts in
   training documents) of each order to the part that a key's top bits name.  A part is what
   ``PART_BYTES`` of text hold, and a task of its own, so its size doesn't grow with the input.
2. Each part sums its keys, stores its share of the n-gram table, and answers every
   message with the total counts and with which keys the message *owns* (each key has one
   owner).  Frequent n-grams come once a block, so no part is hot.
3. Counts of counts give the Good-Turing discounts: a handful of numbers.
4. Each block evaluates its documents from the answers, recursively from the highest order.
   For the n-grams it owns it sends, per context, the discounted mass and the lower-order
   mass; for backed-off tokens it asks for the weight of their context.
5. Parts sum these masses to the backoff weight of every context, exactly normalised, store
   them beside the counts, and answer.  Documents' scores are finished from that table.

A message holds one key at least, so there are never more messages than a plain grouping of
the blocks' distinct n-grams would shuffle rows; up to some terabytes they are far fewer.

Model.  c(ctx) counts ctx as a history.  A seen n-gram has d(c) * c / c(ctx); otherwise
alpha(ctx) times the probability one order lower, with alpha(ctx) = (1 - sum of seen
probabilities) / (1 - sum of their lower-order probabilities), and 1 for a context never
seen.  At order one the mass that discounting frees is that of one unknown token.
d(r) is Katz's formula for r <= 5 and (r - 0.1) / r above, so that every context leaves
mass; where counts of counts don't give 0 < d < 1, absolute discounting with 0.5.

Defined results: words are split at ASCII white space with A-Z in lower case, each text
(null: empty) ends in one end token, and begins after a start symbol that is only
history.  Rows with a null doc_id count as training rows.  Without training tokens the
scores are those of the unknown token, probability 1.  Texts are never cut; a text larger
than a block is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BEGIN, END = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" begin", b" end"))  # no word has a space
#: Text bytes of a block.
BLOCK_BYTES = 6 << 20
#: Text bytes whose n-grams make a part.
PART_BYTES = 12 << 20
#: Counts up to which Katz's discount holds.
SMALL = 5
U64 = np.uint64


# ------------------------------------------------------------------ packed arrays


def pack(values: np.ndarray) -> bytes:
    """Byte planes apart, so that the empty high bytes vanish."""
    values = np.ascontiguousarray(values)
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), 1)


def unpack(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return pack(np.diff(keys, prepend=U64(0)))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, U64), dtype=U64)


def parts_of(keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, begin, end) of sorted keys: the parts are ranges of the top bits."""
    edges = (np.arange(1, parts, dtype=object) * (1 << 64) // parts).astype(U64)
    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    return [(p, b, e) for p, (b, e) in enumerate(zip(cuts, cuts[1:], strict=False)) if e > b]


# ------------------------------------------------------------------ blocks


class Block:
    """The n-gram keys of some documents; ``order`` n-grams at most."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray, train: np.ndarray, order: int):
        # flat: word hashes with the end token; here each document gets order - 1 start symbols
        pad, n = order - 1, len(lengths)
        full = lengths + pad
        starts = np.cumsum(full) - full
        self.tokens = np.empty(int(full.sum()), U64)
        self.doc = np.repeat(np.arange(n, dtype=np.int32), full)
        place = (np.arange(len(self.tokens)) - starts[self.doc]).astype(np.int32)  # within the document
        self.tokens[place < pad] = BEGIN
        self.tokens[place >= pad] = flat
        self.valid = place >= pad
        self.order, self.train = order, train
        self.index: dict[int, np.ndarray] = {}  # place -> number among the places whose n-gram counts
        self.keys: dict[int, np.ndarray] = {}  # distinct, sorted
        self.first: dict[int, np.ndarray] = {}  # a place of each distinct key
        self.which: dict[int, np.ndarray] = {}  # that number -> distinct key
        self.count: dict[int, np.ndarray] = {}  # in training documents
        for k in range(1, order + 1):
            at = np.flatnonzero(self.valid if k == order and order > 1 else place >= max(pad - 1, 0))
            grams = common.windows(self.tokens, k)[at - (k - 1)]
            self.keys[k], first, which = np.unique(grams, return_index=True, return_inverse=True)
            self.which[k] = which.astype(np.int32)
            self.first[k] = at[first].astype(np.int32)
            self.index[k] = np.full(len(self.tokens), -1, np.int32)
            self.index[k][at] = np.arange(len(at), dtype=np.int32)
            self.count[k] = np.bincount(self.which[k], weights=train[self.doc[at]], minlength=len(self.keys[k])).astype(np.int64)


def start_key(k: int) -> np.uint64:
    """The n-gram of start symbols alone: a context, never a token."""
    return common.windows(np.full(k, BEGIN, U64), k)[0]


def block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(block id, doc ids, held out, hashes, lengths, train) of each block of a task."""
    hashes = common.WordHashes()
    held: list[tuple] = []
    size = number = 0
    task = TaskContext.get().partitionId()

    def flush() -> tuple:
        lengths = np.array([len(x[2]) for x in held], np.int64)
        out = np.array([x[1] for x in held], bool)
        flat = np.concatenate([x[2] for x in held])
        # equal blocks differ by their place; every pass over the same table sees the same blocks
        name = xxhash.xxh3_64_intdigest(repr([task, number, *(x[0] for x in held)]).encode() + lengths.tobytes() + flat[:64].tobytes())
        return int(np.uint64(name).view(np.int64)), [x[0] for x in held], out, flat, lengths, ~out

    for batch in common.slices(batches, "text", BLOCK_BYTES):
        more = batch.column(batch.schema.get_field_index("text")).nbytes
        if held and size + more > BLOCK_BYTES:
            yield flush()
            held, size, number = [], 0, number + 1
        size += more
        for ids, texts, outs in common.rows([batch], "doc_id", "text", "held_out"):
            for doc_id, text, out in zip(ids, texts, outs, strict=True):
                held.append((doc_id, out, np.append(hashes.of(common.lower_words(text)), END)))
    if held:
        yield flush()


ASK_TYPES = "part int, k int, block long, n long, keys binary, counts binary"


def ask_batches(batches: Iterator[pa.RecordBatch], order: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Step 1: the messages of each block."""
    for name, _, _, flat, lengths, train in block_batches(batches):
        block = Block(flat, lengths, train, order)
        for k in range(1, order + 1):
            keys, counts = block.keys[k], block.count[k].astype(np.uint32)
            made = [(p, k, name, e - b, pack_keys(keys[b:e]), pack(counts[b:e])) for p, b, e in parts_of(keys, parts)]
            yield arrow(made, ASK_TYPES)


KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}


def arrow(made: list[tuple], types: str) -> pa.RecordBatch:
    fields = [x.split() for x in types.split(", ")]
    columns = zip(*made, strict=True) if made else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), KINDS[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


TABLE_TYPES = "kind string, k int, part int, block long, keys binary, counts binary, owned binary"


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[list[dict]]:
    """Rows that agree in ``keys`` and lie next to each other."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (key := tuple(row[k] for k in keys)) != now:
                if held:
                    yield held
                now, held = key, []
            held.append(row)
    if held:
        yield held


def in_parts(messages: DataFrame, parts: int, *order: str) -> DataFrame:
    """The messages, one part a task, sorted."""
    return messages.repartitionById(parts, "part").sortWithinPartitions("k", "part", *order)


def sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2: one part of one order at a time: its table, and the answer to each message."""
    for rows in runs(batches, "k", "part"):
        k, part = rows[0]["k"], rows[0]["part"]
        keys = [unpack_keys(r["keys"]) for r in rows]
        every, first, which = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        counts = np.concatenate([unpack(r["counts"], np.uint32) for r in rows])
        total = np.bincount(which, weights=counts, minlength=len(every)).astype(np.int64)
        owner = np.zeros(len(which), bool)
        owner[first] = total > 0
        seen = total > 0
        yield arrow([("table", k, part, None, pack_keys(every[seen]), pack(total[seen]), None)], TABLE_TYPES)
        begin = 0
        for r, own in zip(rows, keys, strict=True):
            end = begin + len(own)
            yield arrow([("answer", k, part, r["block"], None, pack(total[which[begin:end]]), pack(np.packbits(owner[begin:end])))], TABLE_TYPES)
            begin = end


# ------------------------------------------------------------------ discounts


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, r, n, tokens): n-grams by count up to SMALL + 1; r = 0 is for larger counts."""
    for ks, keys, counts in common.rows(batches, "k", "keys", "counts"):
        made = []
        for k, raw, packed in zip(ks, keys, counts, strict=True):
            c = unpack(packed, np.int64)[unpack_keys(raw) != start_key(k)]
            for r in range(SMALL + 2):
                hit = c[c == r] if r else c[c > SMALL + 1]
                made.append((k, r, len(hit), int(hit.sum())))
        yield arrow(made, "k int, r int, n long, tokens long")


class Discounts:
    """d(r) by order, and the sizes of the training text."""

    def __init__(self, rows: list[tuple[int, int, int, int]], order: int):
        n = {(k, r): c for k, r, c, _ in rows}
        self.tokens = sum(t for k, _, _, t in rows if k == 1)
        self.types = sum(c for k, _, c, _ in rows if k == 1)
        self.small = {k: self.katz([n.get((k, r), 0) for r in range(SMALL + 2)]) for k in range(1, order + 1)}
        mass = sum(r * n.get((1, r), 0) * self.small[1][r - 1] for r in range(1, SMALL + 1))
        large = [(c, t) for k, r, c, t in rows if k == 1 and (r == 0 or r > SMALL)]
        mass += sum(t - 0.1 * c for c, t in large)
        self.unknown = 1 - mass / self.tokens if self.tokens else 1.0

    @staticmethod
    def katz(n: list[int]) -> np.ndarray:
        r = np.arange(1, SMALL + 1)
        absolute = (r - 0.5) / r
        if not all(n[1:]):
            return absolute
        common_term = (SMALL + 1) * n[SMALL + 1] / n[1]
        if common_term >= 1:
            return absolute
        d = np.array([((i + 1) * n[i + 1] / (i * n[i]) - common_term) / (1 - common_term) for i in r])
        return d if ((d > 0) & (d < 1)).all() else absolute

    def mass(self, k: int, c: np.ndarray) -> np.ndarray:
        """d(c) * c."""
        return np.where(c > SMALL, c - 0.1, self.small[k][np.clip(c, 1, SMALL) - 1] * c)


# ------------------------------------------------------------------ scoring


BLOCK_TYPES = "block long, n long, ids binary, has_id binary, out binary, tokens binary, words binary, lengths binary"
#: Of documents: their columns, packed.  By order k: asked are the keys asked for, and for each backed-off token which of them and which document.
DOC_COLUMNS = ("ids", "has_id", "out", "lengths", "known", "base", "score")
SCORED_TYPES = "kind string, k int, part int, block long, keys binary, seen binary, lower binary, which binary, doc binary, " + ", ".join(f"{c} binary" for c in DOC_COLUMNS)


def text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block in one compact row: local word numbers and the words' hashes."""
    for name, ids, out, flat, lengths, _ in block_batches(batches):
        words, local = np.unique(flat, return_inverse=True)
        known = np.array([i is not None for i in ids])
        yield arrow([(name, len(ids), pack(np.array([i or 0 for i in ids], np.int64)), pack(known), pack(out), pack(local.astype(np.uint32)), pack_keys(words), pack(lengths))], BLOCK_TYPES)


def score_block(left: pa.Table, right: pa.Table, order: int, parts: int, model: Discounts) -> pa.Table:
    """Step 4 for one block: partial scores, masses, questions."""
    made: list[tuple] = []
    row_of = lambda kind, k, part, block, **x: (kind, k, part, block, *(x.get(c) for c in ("keys", "seen", "lower", "which", "doc", *DOC_COLUMNS)))
    if not left.num_rows or not right.num_rows:
        raise RuntimeError("blocks and answers differ: the documents changed between two passes; write them to a table first")
    answers = sorted(right.to_pylist(), key=lambda r: (r["k"], r["part"]))
    for row in left.to_pylist():
        lengths = unpack(row["lengths"], np.int64)
        local = unpack(row["tokens"], np.uint32)
        out = unpack(row["out"], bool)
        block = Block(unpack_keys(row["words"])[local], lengths, ~out, order)
        total, owned = {}, {}
        for k in range(1, order + 1):
            got = [a for a in answers if a["k"] == k]
            counts = [unpack(a["counts"], np.int64) for a in got]
            total[k] = np.concatenate(counts)
            owned[k] = np.concatenate([np.unpackbits(unpack(a["owned"], np.uint8), count=len(c)).astype(bool) for a, c in zip(got, counts, strict=True)])
            if len(total[k]) != len(block.keys[k]):
                raise RuntimeError("a block's answers don't fit it: the documents changed between two passes; write them to a table first")
        places = np.flatnonzero(block.valid)
        doc, docs = block.doc[places], len(lengths)
        one = total[1][block.which[1][block.index[1][places]]]
        adds = lambda x: np.bincount(doc, weights=x, minlength=docs)
        with np.errstate(divide="ignore"):
            base = adds(np.log10((one + 0.5) / (model.tokens + 0.5 * (model.types + 1))))
            low = np.where(one > 0, model.mass(1, one) / max(1, model.tokens), model.unknown)
            log_p, open_ = np.zeros(len(places)), np.ones(len(places), bool)
            asked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for k in range(order, 1, -1):
                c = total[k][block.which[k][block.index[k][places]]]
                before = block.which[k - 1][block.index[k - 1][places - 1]]
                history = total[k - 1][before]
                hit = open_ & (c > 0)
                log_p[hit] += np.log10(model.mass(k, c[hit]) / history[hit])
                back = open_ & (c == 0) & (history > 0)
                asked[k] = np.unique(block.keys[k - 1][before[back]], return_inverse=True) + (doc[back],)
                open_ &= ~hit
            log_p[open_] += np.log10(low[open_])
        known = np.bincount(doc, weights=one > 0, minlength=docs).astype(np.int64)
        for k, (keys, which, at) in asked.items():
            made.append(row_of("asked", k, None, row["block"], which=pack(which.astype(np.uint32)), doc=pack(at.astype(np.uint32))))
            made += [row_of("ask", k, p, row["block"], keys=pack_keys(keys[b:e])) for p, b, e in parts_of(keys, parts)]
        made.append(row_of("docs", None, None, row["block"], ids=row["ids"], has_id=row["has_id"], out=row["out"], lengths=row["lengths"], known=pack(known), base=pack(base), score=pack(adds(log_p))))
        for k in range(2, order + 1):
            own = np.flatnonzero(owned[k] & (total[k] > 0) & (block.keys[k] != start_key(k)))  # start symbols follow nothing
            place = block.first[k][own]
            context = block.which[k - 1][block.index[k - 1][place - 1]]
            seen = model.mass(k, total[k][own]) / total[k - 1][context]
            if k == 2:
                c = total[1][block.which[1][block.index[1][place]]]
                lower = model.mass(1, c) / model.tokens
            else:  # the shorter n-gram was seen too
                c = total[k - 1][block.which[k - 1][block.index[k - 1][place]]]
                shorter = total[k - 2][block.which[k - 2][block.index[k - 2][place - 1]]]
                lower = model.mass(k - 1, c) / shorter
            contexts, inverse = np.unique(context, return_inverse=True)
            keys = block.keys[k - 1][contexts]
            s, q = (np.bincount(inverse, weights=x, minlength=len(contexts)) for x in (seen, lower))
            made += [row_of("mass", k, p, row["block"], keys=pack_keys(keys[b:e]), seen=pack(s[b:e]), lower=pack(q[b:e])) for p, b, e in parts_of(keys, parts)]
    return pa.Table.from_batches([arrow(made, SCORED_TYPES)])


WEIGHT_TYPES = "kind string, k int, part int, block long, keys binary, weights binary"


def weigh_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 5: log10 backoff weights of all contexts of one part of one order, and of those that were asked for."""
    for rows in runs(batches, "k", "part"):
        k, part = rows[0]["k"], rows[0]["part"]
        masses = [r for r in rows if r["kind"] == "mass"]
        every, weight = np.empty(0, U64), np.empty(0)
        if masses:
            every, which = np.unique(np.concatenate([unpack_keys(r["keys"]) for r in masses]), return_inverse=True)
            seen, lower = (np.bincount(which, weights=np.concatenate([unpack(r[c], np.float64) for r in masses])) for c in ("seen", "lower"))
            weight = np.log10((1 - seen) / (1 - lower))
            yield arrow([("weight", k, part, None, pack_keys(every), pack(weight))], WEIGHT_TYPES)
        for r in rows:
            if r["kind"] == "ask":
                keys = unpack_keys(r["keys"])
                value = np.zeros(len(keys))
                if masses:
                    at = np.minimum(np.searchsorted(every, keys), len(every) - 1)
                    value = np.where(every[at] == keys, weight[at], 0.0)
                yield arrow([("reply", k, part, r["block"], None, pack(value))], WEIGHT_TYPES)


RESULT_TYPES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def finish_block(left: pa.Table, right: pa.Table, train_tokens: int) -> pa.Table:
    """Adds the weights of backed-off tokens to their documents' scores."""
    made: list[tuple] = []
    rows = left.to_pylist()
    answers = sorted(right.to_pylist(), key=lambda r: (r["k"], r["part"]))
    for row in (r for r in rows if r["kind"] == "docs"):
        column = {c: unpack(row[c], kind) for c, kind in zip(DOC_COLUMNS, (np.int64, bool, bool, np.int64, np.int64, np.float64, np.float64), strict=True)}
        score = column["score"].copy()
        for asked in (r for r in rows if r["kind"] == "asked"):
            which, doc = unpack(asked["which"], np.uint32), unpack(asked["doc"], np.uint32)
            if len(which):
                weights = np.concatenate([unpack(r["weights"], np.float64) for r in answers if r["k"] == asked["k"]])
                score += np.bincount(doc, weights=weights[which], minlength=len(score))
        ids = [i if has else None for i, has in zip(column["ids"].tolist(), column["has_id"].tolist(), strict=True)]
        made += zip(ids, *(column[c].tolist() for c in ("out", "lengths", "known")), [train_tokens] * len(ids), column["base"].tolist(), score.tolist(), strict=True)
    return pa.Table.from_batches([arrow(made, RESULT_TYPES)])


def score(docs: DataFrame, order: int = 2, tables: str | None = None) -> DataFrame:
    """One row per document: its tokens and log10 probabilities under the base and the Katz model.

    ``docs``: doc_id, text, held_out (boolean); a table that reads alike each time.
    ``tables``: folder for the model: n-gram counts in ``counts`` (kind = 'table') and log10
    backoff weights of every context in ``backoff`` (kind = 'weight'), partitioned by order.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    docs = docs.select("doc_id", "text", "held_out")
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-text_bytes // PART_BYTES) or 1
    path = tables or common.shared_dir(spark, "katz-tables")
    counts, backoff, scored = f"{path}/counts", f"{path}/backoff", f"{path}/scored"
    asks = in_parts(docs.mapInArrow(common.tidy(lambda b: ask_batches(b, order, parts)), ASK_TYPES), parts, "block")
    asks.mapInArrow(common.tidy(sum_batches), TABLE_TYPES).write.partitionBy("kind", "k").parquet(counts)
    del asks
    common.release(spark)
    stored = spark.read.schema(TABLE_TYPES).parquet(counts)
    rows = stored.where("kind = 'table'").select("k", "keys", "counts").mapInArrow(count_batches, "k int, r int, n long, tokens long").groupBy("k", "r").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).collect()
    model = Discounts([tuple(r) for r in rows], order)

    texts = docs.mapInArrow(common.tidy(text_batches), BLOCK_TYPES)
    answers = stored.where("kind = 'answer'").select("block", "k", "part", "counts", "owned")
    found = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda a, b: score_block(a, b, order, parts, model), SCORED_TYPES)
    found.write.partitionBy("kind").parquet(scored)
    common.remove(spark, f"{counts}/kind=answer")
    del texts, answers, found
    common.release(spark)
    found = spark.read.schema(SCORED_TYPES).parquet(scored)
    messages = in_parts(found.where("kind IN ('ask', 'mass')").select("kind", "k", "part", "block", "keys", "seen", "lower"), parts, "kind", "block")
    messages.mapInArrow(common.tidy(weigh_batches), WEIGHT_TYPES).write.partitionBy("kind", "k").parquet(backoff)
    for kind in ("ask", "mass"):
        common.remove(spark, f"{scored}/kind={kind}")
    del found, messages
    common.release(spark)
    replies = spark.read.schema(WEIGHT_TYPES).parquet(backoff).where("kind = 'reply'").select("k", "part", "block", "weights")
    left = spark.read.schema(SCORED_TYPES).parquet(scored).select("kind", "k", "block", "which", "doc", *DOC_COLUMNS)
    return left.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(lambda a, b: finish_block(a, b, model.tokens), RESULT_TYPES)


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs.withColumn("held_out", F.coalesce(common.crc_fold("doc_id", 5) == 1, F.lit(False))))
