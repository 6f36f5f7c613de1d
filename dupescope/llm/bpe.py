"""Operator 1: byte-pair encoding and decoding with a pair occurrence index.

All distinct words of a batch lie one after the other in one array of symbols.  An
index maps every adjacent pair that has a merge rule to all its positions; the active
ranks are taken in ascending order, each rank's merges are applied at all its positions
at once, and only the lists of the pairs beside a merge are updated.

Defined results: a null or empty text has no tokens and decodes to ''.  Strings of
special tokens inside a text become their ids, as the tokenizers library does when it
isn't told otherwise.  Symbols that the vocabulary lacks are dropped when it has no
unknown token.  Texts are never cut, however long.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import unicodedata
from array import array
from collections.abc import Collection, Iterable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from . import common

#: Words remembered between batches of a task.
CACHE_WORDS = 200_000
#: Text bytes of one batch whose distinct words share an index.
BATCH_BYTES = 6 << 20


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else 256 upwards."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class PairIndexBpe:
    """Encoder and decoder of a word-end BPE vocabulary (see ``from_file``)."""

    #: Below this character all Unicode versions agree on letters, numbers and lower case.
    SETTLED = "\u0530"

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str, pattern: str, specials: dict[str, int], path: str | None = None):
        self.path = path
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in specials.items()}
        self.digits = {i: str(i) for i in self.names}
        self.specials = specials
        self.special_ids = set(specials.values())
        self.opening = os.path.commonprefix(list(specials))  # a text without it has no special token
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        # the six ASCII and the other white-space characters, by property: \s of some engines has more
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        signs = byte_symbols()
        self.bytes = {s: b for b, s in enumerate(signs)}
        self.inner = np.array([vocab.get(s, -1) for s in signs], dtype=np.int32)
        self.last = np.array([vocab.get(s + suffix, -1) for s in signs], dtype=np.int32)
        self.base = max(self.names) + 2
        self.left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        self.right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        first: dict[int, int] = {}
        for rank, token in enumerate(self.made.tolist()):
            first.setdefault(token, rank)
        if any(first.get(x, -1) >= rank for rank, pair in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True)) for x in pair):
            raise ValueError("a merge rule uses a token that only a later rule makes")
        keys = self.left * self.base + self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = np.append(keys[self.order], np.iinfo(np.int64).max)

    @classmethod
    def from_file(cls, path: str) -> PairIndexBpe:
        """A tokenizer file: BPE, NFC + white space + lower case, pieces by a pattern, byte level."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        return cls(model["vocab"], merges, model["end_of_word_suffix"] or "", pattern, {t["content"]: t["id"] for t in spec["added_tokens"]}, path)

    @cached_property
    def library(self) -> Tokenizer:
        """The tokenizers library's reader of the same file; loaded when a text needs its tables of Unicode."""
        return Tokenizer.from_file(self.path)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; the number of rules where there is none."""
        key = a.astype(np.int64) * self.base + b
        at = np.searchsorted(self.keys, key)
        found = self.keys[at] == key
        return np.where(found, self.order[np.minimum(at, len(self.order) - 1)], len(self.order))

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word."""
        ids, ends = self.merged(words)
        return [ids[begin:end].tolist() for begin, end in zip([0, *ends], ends, strict=False)]

    def merged(self, words: Collection[str]) -> tuple[array, array]:
        """The token ids of all words, one after the other, through one pair occurrence index over them; where each word's end."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(x) for x in raw], dtype=np.int64)
        text = np.frombuffer(b"".join(raw), dtype=np.uint8)
        owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        sym = self.inner[text]
        ends = np.cumsum(sizes)[sizes > 0] - 1
        sym[ends] = self.last[text[ends]]
        known = sym >= 0
        sym, owner = sym[known], owner[known]
        word_ends = np.cumsum(np.bincount(owner, minlength=len(words)))
        n = len(sym)
        if not n:
            return array("i"), array("i", bytes(4 * len(words)))
        # position n stands for "none": its symbol is in no rule
        sym = np.append(sym, np.int32(self.base - 1))
        same = owner[1:] == owner[:-1]
        place = np.arange(n, dtype=np.int32)
        after, before = (np.full(n + 1, n, np.int32) for _ in range(2))
        after[: n - 1][same] = place[1:][same]
        before[1:n][same] = place[: n - 1][same]
        del text, known, same, raw, sizes, ends, owner, place
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            rank = self.ranks(sym[at], sym[after[at]])
            keep = rank < len(self.order)
            if not keep.any():
                return
            at, rank = at[keep], rank[keep]
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            begin = 0
            for r, end in zip(rank[np.append(0, cuts)].tolist(), [*cuts.tolist(), len(rank)], strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(at[begin:end])
                begin = end

        for begin in range(0, n, 1 << 18):
            add(np.arange(begin, min(begin + (1 << 18), n), dtype=np.int32))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = int(self.left[r]), int(self.right[r])
            at = at[(sym[at] == a) & (sym[after[at]] == b)]
            if a == b and len(at) > 1:  # runs: from the left, without overlap
                kept, used = [], -1
                for p, q in zip((at := np.unique(at)).tolist(), after[at].tolist(), strict=True):
                    if p != used:
                        kept.append(p)
                        used = q
                at = np.array(kept, np.int32)
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            sym[at], sym[gone] = self.made[r], -1
            after[at], before[beyond] = beyond, at
            add(np.concatenate([before[at], at]))
        alive = sym[:n] >= 0
        ends = np.append(0, np.cumsum(alive))[word_ends]
        return array("i", sym[:n][alive].tobytes()), array("i", ends.astype(np.int32).tobytes())

    def pieces(self, text: str) -> list[str | int]:
        """Special ids and words of a text, in order, after NFC and lower-casing."""
        parts = self.special.split(text) if self.special and self.opening in text else [text]
        out: list[str | int] = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(self.specials[part])
            elif part and self.path and max(part) >= self.SETTLED:
                # its own tables of Unicode say what a letter is
                plain = self.library.normalizer.normalize_str(part)
                out += [bytes(map(self.bytes.__getitem__, w)).decode("utf-8", "surrogatepass") for w, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]
            elif part:
                # letter by letter: no rule for a final sigma
                plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += (plain,) if plain.isalpha() else self.words.findall(plain)
        return out

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        """Token ids of each text."""
        cut = [self.pieces(t) for t in texts]
        distinct = list({p for pieces in cut for p in pieces if isinstance(p, str)})
        ids = dict(zip(distinct, self.encode_words(distinct), strict=True))
        return [[i for p in pieces for i in ((p,) if isinstance(p, int) else ids[p])] for pieces in cut]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_many([text or ""])[0]

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by one space, as a tokenizer without a decoder does."""
        return " ".join([self.names[i] for i in ids])


def chunks(text: str | None) -> list[str]:
    """Runs between spaces, tabs and line ends: no word and no special token crosses one."""
    return [c for c in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if c] if text else []


class ChunkLines:
    """Ids and decoded text of chunks whose words share one index (``add`` them, then ``merge``).

    Tokens are kept as numbers; a chunk's two strings are made when they are asked for, so
    that those of a whole batch never exist at once.
    """

    def __init__(self, model: PairIndexBpe):
        self.model = model
        #: pieces of the chunks that are neither a word nor a word and a mark
        self.cut: dict[str, Sequence[str | int]] = {}
        self.words: set[str | int] = set()

    @staticmethod
    def plain(chunk: str) -> tuple[str, ...] | None:
        if chunk.isascii():
            if chunk.isalpha():  # one word
                return (chunk.lower(),)
            if chunk[-1] in ".,!?;:" and chunk[:-1].isalpha():  # a word and a mark
                return chunk[:-1].lower(), chunk[-1]
        return None

    def add(self, chunks: Iterable[str]) -> None:
        for chunk in chunks:
            if (pieces := self.plain(chunk)) is None:
                pieces = self.cut[chunk] = tuple(self.model.pieces(chunk))
            self.words.update(pieces)

    def merge(self) -> None:
        self.at = {word: i for i, word in enumerate(self.words - self.model.special_ids)}
        del self.words
        self.ids, self.ends = self.model.merged(self.at.keys())

    def of(self, chunk: str) -> tuple[str, str]:
        """The chunk's ids and its decoded text; both are '' if it has no token."""
        found: list[int] = []
        for piece in self.plain(chunk) or self.cut[chunk]:
            if isinstance(piece, int):
                found.append(piece)
            else:
                i = self.at[piece]
                found += self.ids[self.ends[i - 1] if i else 0 : self.ends[i]]
        if len(found) == 1:
            return self.model.digits[found[0]], self.model.names[found[0]]
        return " ".join(map(self.model.digits.__getitem__, found)), " ".join(map(self.model.names.__getitem__, found))


class Digests:
    """n_tokens, ids_sha256, decoded_sha256 of texts.

    A chunk that several texts of a batch hold is remembered for the next batches; the many
    that one text holds are forgotten with the text.
    """

    def __init__(self, model: PairIndexBpe):
        self.model = model
        self.ids: dict[str, str] = {}
        self.decoded: dict[str, str] = {}

    def of(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        lines, again = self.lines(texts)
        out = [self.digest(text, lines, again) for text in texts]
        if len(self.ids) > CACHE_WORDS:
            self.forget(again.intersection(self.ids))
        return out

    def lines(self, texts: list[str | None]) -> tuple[ChunkLines, set[str]]:
        """The chunks of the texts that aren't remembered, and those of them that several texts hold."""
        new: set[str] = set()
        again: set[str] = set()
        for text in texts:
            found = set(chunks(text)).difference(self.ids)
            again.update(found & new)
            new |= found
        lines = ChunkLines(self.model)
        lines.add(new)
        del new
        lines.merge()
        return lines, again

    def digest(self, text: str | None, lines: ChunkLines, again: set[str]) -> tuple[int, str, str]:
        ids, decoded = self.ids, self.decoded
        cut = chunks(text)
        found = set(cut).difference(ids)
        for chunk in found:
            ids[chunk], decoded[chunk] = lines.of(chunk)
        blank = {c for c in found if not ids[c]}  # chunks without a token
        if blank:
            cut = [c for c in cut if c not in blank]
        line = " ".join(map(ids.__getitem__, cut))
        beyond = " ".join(map(decoded.__getitem__, cut))
        self.forget(blank.union(found - again))
        return line.count(" ") + 1 if line else 0, hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(beyond.encode()).hexdigest()

    def forget(self, chunks: set[str]) -> None:
        for chunk in chunks:
            del self.ids[chunk], self.decoded[chunk]


def digest_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    digests = Digests(PairIndexBpe.from_file(path))
    for batch in common.gathered(batches, "text", BATCH_BYTES):
        doc_ids, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text"))
        texts = texts.to_pylist()
        del batch  # its bytes are in the texts now
        counts, first, second = zip(*digests.of(texts), strict=True) if texts else ((), (), ())
        del texts
        yield pa.RecordBatch.from_arrays([doc_ids, pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per document; no shuffle, memory bounded by a batch and the word cache."""
    common.bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(common.tidy(lambda batches: digest_batches(batches, path)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = PairIndexBpe.from_file(path)
    for batch in common.slices(batches, "text", BATCH_BYTES):
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        found = model.encode_many([t or "" for t in texts])
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "ids"])


def decode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = PairIndexBpe.from_file(path)
    for doc_ids, ids in common.rows(batches, "doc_id", "ids"):
        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array([model.decode(x or []) for x in ids], pa.string())], names=["doc_id", "text"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the token ids of each text."""
    common.bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(common.tidy(lambda b: encode_batches(b, path)), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the decoded text of each row of ``encode``'s result."""
    common.bound_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(common.tidy(lambda b: decode_batches(b, path)), "doc_id long, text string")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(common.table(spark, sf_dir, "documents"), vocabulary_path())
