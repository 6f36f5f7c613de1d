"""Operator 5: language identification by a bidirectional gated recurrent network.

The network reads the bytes of the whole lower-cased text, white space included, so words
are seen with those beside them.  A forward and a backward GRU give every byte position a
distribution over the learned languages, and a document's probabilities are the mean over
all its positions.  A text of more than ``SEGMENT + 2 * CONTEXT`` bytes is read in segments
of ``SEGMENT`` positions; each is run with ``CONTEXT`` or more bytes of its neighbours on
either side, which bring the states in but aren't pooled, so that every position counts once.

Sequences of many texts are run side by side, longest first; at every step those that go
on are a prefix of the rows, so nothing is padded.  Gates and candidates use
x / (1 + |x|) in place of the hyperbolic tangent: it takes a third of the time.

Learning is plain numpy: backpropagation through time and Adam, on a bounded sample of
labelled rows: about ``per_language`` documents of each language, chosen by a hash of
doc_id, and ``windows_per_doc`` stretches of ``TRAIN_BYTES`` bytes of each, chosen by hash.

Defined results: ``und`` with score 0 for a null text and for one without a letter; also
for every text if no labelled row exists.  Null labels are never learnt from.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Positions of a segment that are pooled, and bytes read before and behind it.
SEGMENT, CONTEXT = 480, 16
#: Bytes of a training sequence.
TRAIN_BYTES = 96
HIDDEN = 8
#: Sequences that are run side by side.
ROWS = 4096
#: Text bytes handed to the network at a time.
BATCH_BYTES = 4 << 20
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
GATES = "zrn"


def lowered(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def has_letter(text: str | None) -> bool:
    """Numerals such as one half are word characters too, but no letters."""
    found = LETTER.search(text) if text else None
    while found and not found[0].isalpha():
        found = LETTER.search(text, found.end())
    return found is not None


def squash(x: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
    """x / (1 + |x|), in place."""
    room = np.abs(x, out=room)
    room += np.float32(1)
    x /= room
    return x


def gate(x: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
    """The same between 0 and 1, in place."""
    squash(x, room)
    x += np.float32(1)
    x *= np.float32(0.5)
    return x


def step_of(flat: np.ndarray, size: int, at: int, rows: int) -> np.ndarray:
    """The (size, rows) block of a step whose positions begin at ``at``."""
    return flat[size * at : size * (at + rows)].reshape(size, rows)


def slope(y: np.ndarray) -> np.ndarray:
    """Derivative of ``squash`` where it gives y."""
    return (1 - np.abs(y)) ** 2


@dataclass
class BiGru:
    """For each direction d and gate g: bytes' table x (256 x H) and recurrent matrix u (H x H); output v and c."""

    languages: list[str]
    params: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 11) -> BiGru:
        rng = np.random.default_rng(seed)
        new = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        params = {}
        for d in "fb":
            for g in GATES:
                params["x" + d + g] = new(256, hidden, scale=0.5)
                params["u" + d + g] = new(hidden, hidden, scale=hidden**-0.5)
            params["v" + d] = new(hidden, len(languages), scale=hidden**-0.5)
        params["c"] = np.zeros(len(languages), np.float32)
        return cls(languages, params)

    def states(self, x: np.ndarray, d: str, keep: list) -> np.ndarray:
        """States (T, B, H) of one direction over bytes x (B, T) in reading order, for learning."""
        p = self.params
        h = np.zeros((len(x), len(p["u" + d + "z"])), p["c"].dtype)
        out = np.empty((x.shape[1], *h.shape), h.dtype)
        for t in range(x.shape[1]):
            z, r = (gate(p["x" + d + g][x[:, t]] + h @ p["u" + d + g]) for g in "zr")
            b = h @ p["u" + d + "n"]
            n = squash(p["x" + d + "n"][x[:, t]] + r * b)
            keep.append((h, z, r, n, b))
            h = n + z * (h - n)
            out[t] = h
        return out

    def run(self, x: np.ndarray, alive: np.ndarray, d: str) -> np.ndarray:
        """What one direction says of each position: for each step (L, rows), one after the other.

        Bytes x stand step by step, too, those of step t for the first ``alive[t]`` rows.
        """
        p = self.params
        xs, us, v = [p["x" + d + g] for g in GATES], [p["u" + d + g] for g in GATES], np.ascontiguousarray(p["v" + d].T)
        out = np.empty(len(v) * len(x), np.float32)
        h = np.zeros((int(alive[0]) if len(alive) else 0, v.shape[1]), np.float32)
        room = [np.empty_like(h) for _ in range(5)]
        at = 0
        for k in alive.tolist():
            if k < len(h):
                h, room = h[:k], [a[:k] for a in room]
            z, r, n, b, spare = room
            now = x[at : at + k]
            for g, u, a in zip(xs[:2], us[:2], (z, r), strict=True):
                np.take(g, now, axis=0, out=a, mode="clip")
                np.matmul(h, u, out=b)
                a += b
                gate(a, spare)
            np.take(xs[2], now, axis=0, out=n, mode="clip")
            np.matmul(h, us[2], out=b)
            b *= r
            n += b
            squash(n, spare)
            h -= n
            h *= z
            h += n
            np.matmul(v, h.T, out=step_of(out, len(v), at, k))
            at += k
        return out

    def pooled(self, source: np.ndarray, begins: np.ndarray, lengths: np.ndarray, skips: np.ndarray, cores: np.ndarray) -> np.ndarray:
        """Sums of the distributions over languages at the pooled positions of sequences of ``source``, longest first: (rows, L)."""
        size = len(self.languages)
        steps = np.arange(int(lengths[0]) if len(lengths) else 0)
        alive = np.searchsorted(-lengths, -steps, "left")  # rows that are longer than each step
        first = (np.cumsum(alive) - alive).astype(np.int32)  # where a step's positions begin
        if equal := len(lengths) > 0 and lengths[0] == lengths[-1]:
            x = source[begins + steps[:, None]]
            forward = self.run(x.reshape(-1), alive, "f")
            backward = self.run(x[::-1].reshape(-1), alive, "b")
        else:
            row = np.arange(int(alive.sum()), dtype=np.int32) - np.repeat(first, alive)
            step = np.repeat(steps.astype(np.int32), alive)
            last = lengths.astype(np.int32)[row] - 1 - step  # the same position, counted from the end
            forward = self.run(source[begins[row] + step], alive, "f")
            found = self.run(source[begins[row] + last], alive, "b")
            backward = np.stack([found[size * first[last] + k * alive[last] + row] for k in range(size)])
        out = np.zeros((size, len(lengths)), np.float32)
        ends, bias = skips + cores, self.params["c"][:, None]
        for t, k, at in zip(steps.tolist(), alive.tolist(), first.tolist(), strict=True):
            p = step_of(forward, size, at, k)
            p += step_of(backward, size, len(x) * k - at - k, k) if equal else backward[:, at : at + k]
            p += bias
            np.clip(p, -30, 30, out=p)
            np.exp(p, out=p)
            p /= p.sum(axis=0)
            if skips[:k].max() > t or t >= ends[:k].min():
                p *= (skips[:k] <= t) & (t < ends[:k])
            out[:, :k] += p
        return out.T

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the positions and its gradient, by backpropagation through time."""
        p, steps = self.params, x.shape[1]
        kept: dict[str, list] = {"f": [], "b": []}
        views = {"f": x, "b": x[:, ::-1]}
        states = {d: self.states(views[d], d, kept[d]) for d in "fb"}
        logits = states["f"] @ p["vf"] + states["b"][::-1] @ p["vb"] + p["c"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        rows = np.arange(len(y))
        loss = float(-np.log(prob[:, rows, y] + 1e-9).mean())
        out = prob
        out[:, rows, y] -= 1
        out /= out.shape[0] * out.shape[1]
        grads = {"c": out.sum(axis=(0, 1))}
        for d in "fb":
            error = out if d == "f" else out[::-1]
            grads["v" + d] = np.tensordot(states[d], error, axes=((0, 1), (0, 1)))
            above = error @ p["v" + d].T
            dh = np.zeros_like(above[0])
            into, back = ({g: np.empty_like(above) for g in GATES} for _ in range(2))
            for t in range(steps - 1, -1, -1):
                h, z, r, n, b = kept[d][t]
                dh = dh + above[t]
                dn = dh * (1 - z) * slope(n)
                into["n"][t], back["n"][t] = dn, dn * r  # the reset gate stands behind the matrix
                into["z"][t] = back["z"][t] = dh * (h - n) * slope(2 * z - 1) / 2
                into["r"][t] = back["r"][t] = dn * b * slope(2 * r - 1) / 2
                dh = dh * z + sum(back[g][t] @ p["u" + d + g].T for g in GATES)
            before = np.stack([k[0] for k in kept[d]])
            seen = views[d].T.reshape(-1)
            order = np.argsort(seen, kind="stable")
            found, cuts = np.unique(seen[order], return_index=True)
            for g in GATES:
                grads["u" + d + g] = np.tensordot(before, back[g], axes=((0, 1), (0, 1)))
                grads["x" + d + g] = np.zeros_like(p["x" + d + g])
                grads["x" + d + g][found] = np.add.reduceat(into[g].reshape(len(seen), -1)[order], cuts, axis=0)
        return loss, grads

    def sums(self, texts: list[bytes]) -> np.ndarray:
        """For each text the sum of its positions' distributions: (texts, L)."""
        out = np.zeros((len(texts), len(self.languages)))
        owner, begins, lengths, skips, cores = segments(np.array([len(t) for t in texts], np.int64))
        source = np.frombuffer(b"".join(texts), np.uint8)
        order = np.argsort(-lengths, kind="stable")
        for k in range(0, len(order), ROWS):
            part = order[k : k + ROWS]
            np.add.at(out, owner[part], self.pooled(source, begins[part], lengths[part], skips[part], cores[part]))
        return out


def segments(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, length, positions before the pooled ones, pooled positions) of each sequence over texts that lie one after the other."""
    counts = np.where(sizes <= SEGMENT + 2 * CONTEXT, np.minimum(sizes, 1), -(-sizes // SEGMENT))
    owner = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    whole, size = counts[owner] == 1, sizes[owner]
    core = np.where(whole, 0, number * SEGMENT)
    end = np.where(whole, size, np.minimum(core + SEGMENT, size))
    # sequences of long texts have one length: those at either end of a text take more of its inside
    full = np.minimum(size, SEGMENT + 2 * CONTEXT)
    begin = np.minimum(np.maximum(core - CONTEXT, 0), size - full)
    return owner, (np.cumsum(sizes) - sizes)[owner] + begin, full, core - begin, end - core


def train(samples: list[tuple[bytes, str]], epochs: int = 4, least_steps: int = 200, batch: int = 192, rate: float = 0.03, seed: int = 5) -> BiGru:
    """Adam over (bytes, language) samples, in batches of equal length; more epochs where these are fewer than ``least_steps``."""
    languages = sorted({lang for _, lang in samples})
    model = BiGru.fresh(languages)
    code = {lang: i for i, lang in enumerate(languages)}
    by_length: dict[int, list[tuple[bytes, int]]] = defaultdict(list)
    for stretch, lang in samples:
        if stretch:
            by_length[len(stretch)].append((stretch, code[lang]))
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.params.items()}
    v2 = {k: np.zeros_like(v) for k, v in model.params.items()}
    step = 0
    each = sum(-(-len(s) // batch) for s in by_length.values())
    epochs = max(epochs, -(-least_steps // max(1, each)))
    total = epochs * each
    for _ in range(epochs if len(languages) > 1 and each else 0):
        cuts = []
        for length, found in sorted(by_length.items()):
            order = rng.permutation(len(found))
            cuts += [(length, [found[i] for i in order[b : b + batch]]) for b in range(0, len(found), batch)]
        for k in rng.permutation(len(cuts)):
            length, part = cuts[k]
            x = np.frombuffer(b"".join(s for s, _ in part), np.uint8).reshape(len(part), length)
            _, grads = model.gradients(x, np.array([y for _, y in part]))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            step += 1
            now = rate * (1 - step / (total + 1)) ** 0.5
            for name, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m[name] = 0.9 * m[name] + 0.1 * g
                v2[name] = 0.999 * v2[name] + 0.001 * g * g
                model.params[name] -= (now * (m[name] / (1 - 0.9**step)) / (np.sqrt(v2[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def sample(docs: DataFrame, per_language: int, windows_per_doc: int) -> list[tuple[bytes, str]]:
    """(bytes, language) of the bounded sample: first counts by language, then one pass that keeps documents by hash."""
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(common.crc_fold("doc_id", 5) != 0).select("doc_id", "lang", "text")
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])
    unit = (F.xxhash64("doc_id").bitwiseAND((1 << 52) - 1) / float(1 << 52)).cast("double")
    chosen = known.where(unit < share[F.col("lang")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, langs, texts in common.rows(batches, "doc_id", "lang", "text"):
            found = []
            for doc_id, lang, text in zip(ids, langs, texts, strict=True):
                raw = lowered(text)
                room = max(0, len(raw) - TRAIN_BYTES) + 1
                begins = sorted({xxhash.xxh3_64_intdigest(b"%d %d" % (doc_id, i)) % room for i in range(windows_per_doc)})
                found += [(doc_id, at, lang, raw[at : at + TRAIN_BYTES]) for at in begins]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else ((),) * 4, (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["doc_id", "at", "lang", "stretch"])

    got = chosen.mapInArrow(common.tidy(work), "doc_id long, at long, lang string, stretch binary").toArrow()
    return [(x, lang) for _, _, lang, x in sorted(zip(*(got[c].to_pylist() for c in ("doc_id", "at", "lang", "stretch")), strict=True))]


def predict_texts(texts: list[str | None], model: BiGru | None) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    raw = [lowered(t) if model and has_letter(t) else b"" for t in texts]
    if not model:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    pooled = model.sums(raw)
    best = pooled.argmax(axis=1)
    scores = pooled[np.arange(len(raw)), best] / np.array([max(1, len(x)) for x in raw])
    langs = [model.languages[i] if x else UNKNOWN for i, x in zip(best.tolist(), raw, strict=True)]
    return langs, np.clip(scores, 0, 1).tolist()


def predict_batches(batches: Iterator[pa.RecordBatch], model: BiGru | None) -> Iterator[pa.RecordBatch]:
    for batch in common.gathered(batches, "text", BATCH_BYTES):
        for ids, texts in common.rows([batch], "doc_id", "text"):
            langs, scores = predict_texts(texts, model)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])


def fit(docs: DataFrame, per_language: int = 400, windows_per_doc: int = 2) -> BiGru | None:
    common.bound_batches(docs.sparkSession)
    samples = sample(docs, per_language, windows_per_doc)
    return train(samples) if samples else None


def predict(docs: DataFrame, model: BiGru | None) -> DataFrame:
    """doc_id, lang_pred, score of each document; no shuffle.  The model is some tens of kB."""
    common.bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(common.tidy(lambda b: predict_batches(b, shared.value)), "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: BiGru | None, least: float = 0.3) -> DataFrame:
    """The documents, all columns, whose language is known with a score of ``least`` or more."""
    common.bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.gathered(batches, "text", BATCH_BYTES):
            langs, scores = predict_texts(batch.column(batch.schema.get_field_index("text")).to_pylist(), shared.value)
            yield batch.filter(pa.array([p != UNKNOWN and s >= least for p, s in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(common.tidy(work), docs.schema)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held_out = F.coalesce(common.crc_fold("doc_id", 5) == 0, F.lit(False))
    return predict(docs, fit(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
