"""Operator 7: secrets by patterns and by password guess cost.

Three base patterns give the spans of kinds ``assign``, ``access`` and ``hex``.  The
method adds kind ``guess``: values that stand in a credential context (a wider set of
key words, separators and quoting than the base pattern) are cut into words, dates,
repeats, keyboard walks and brute-force characters so that the guesses an attacker
needs, as a sum of log10 costs, are fewest.  A value that even then costs
``MIN_GUESSES_LOG10`` or more is a secret.

The dictionary is learnt: words of letters, ranked by the number of different texts that hold them
outside of credential values, counted over every document's whole text; the first ``DICTIONARY``
of that ranking stand behind a few fixed password words.  So a secret is not learnt from its own
copies, however many documents repeat it.  The dictionary is some hundred kB, and is broadcast.

Defined results: a null or empty text has no spans (and the SHA-256 of '' as base
digest).  Offsets are code points, end exclusive.  An added span that lies within a
base span is left out, and so is a value that only names where the secret comes from
(``${NAME}``, ``<your password>``, ``****``).  Spans sort by start, then kind in the order of KINDS,
then end.  Values are costed whole, however long.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "guess")
#: log10 of the guesses from which a credential value counts as a secret.
MIN_GUESSES_LOG10 = 10.0

# re.ASCII: ignoring case folds A-Z only
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CONTEXT = re.compile(
    # a cue, up to three more parts of the name, a separator, a value
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|auth|signing|encryption)[_-]?key|auth|credentials?)(?:[_-][A-Za-z0-9]{1,20}){0,3}["']?\x20*(?:=>|:=|[:=])\x20*(?:"([^"\n]{6,})"|'([^'\n]{6,})'|([^\s"',;<>]{6,}))"""
    r"""|bearer\x20+([A-Za-z0-9._~+/=-]{16,})""",
    re.ASCII | re.IGNORECASE,
)
#: Other places of a value: user info of an address, a flag of a command, a sentence.
PLACES = (
    CONTEXT,
    re.compile(r"""[a-z][a-z0-9+.-]{1,20}://[^\s:/@"']{1,100}:([^\s/@"']{6,})@""", re.ASCII | re.IGNORECASE),
    re.compile(r"""(?<![A-Za-z0-9])--?(?:password|passwd|pass|pwd|passphrase|secret|token|(?:api|access|private)[_-]?key)\x20+(?:"([^"\n]{6,})"|'([^'\n]{6,})'|([^\s"',;<>-][^\s"',;<>]{5,}))""", re.ASCII | re.IGNORECASE),
    re.compile(r"""\b(?:password|passphrase|passcode|secret|token|(?:api|access|private)[\x20_-]?key)\x20+is:?\x20+(?:"([^"\n]{6,})"|'([^'\n]{6,})'|([^\s"',;<>]{6,}))""", re.ASCII | re.IGNORECASE),
)
#: Values that name a secret or stand for one.
PLACEHOLDER = re.compile(r"\$\{[^}]*\}|\$\([^)]*\)|\$[A-Za-z_]\w*|\{\{.*\}\}|\{\w+\}|<[^>]*>|%\w+%|\[[A-Za-z_ -]*\]|(.)\1*", re.ASCII | re.DOTALL)
#: Every match of ASSIGN or PLACES holds one of these.
CUES = ("pass", "pwd", "secret", "token", "key", "auth", "credential", "bearer", "://")

#: Common password words: fixed values, ordered by how soon they are guessed.
WORDS = """password letmein welcome admin qwerty dragon monkey master shadow sunshine princess football baseball
superman batman trustno iloveyou login hello freedom whatever secret test guest root user default changeme
example token love summer winter spring autumn server database oracle mysql postgres system manager access
private public internal company office account service client hunter ranger buster soccer hockey killer george
charlie andrew michelle jessica daniel thomas jordan pepper ginger cookie flower orange banana computer internet""".split()
#: Learnt words at most, their letters, and the different texts that must hold one.
DICTIONARY, WORD_LETTERS, WORD_DOCUMENTS = 20_000, (4, 20), 5
WORD = re.compile(f"[a-z]{{{WORD_LETTERS[0]},}}")
#: Characters of a text that are searched for words at once; a piece ends at a character that no word has.
PIECE, NO_LETTER = 1 << 20, re.compile(r"[\x00-\x40]")
#: Words counted in a task before their counts go to the exchange.
HELD_WORDS = 500_000
#: Usual replacements of letters: fixed values.
LEET = str.maketrans("0134578@$!", "oieastbasi")
#: Rows of neighbouring keys, and the usual sequences: fixed values.
WALKS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "0123456789", "abcdefghijklmnopqrstuvwxyz")
NEXT = {a + b for w in WALKS for a, b in zip(w, w[1:], strict=False)} | {b + a for w in WALKS for a, b in zip(w, w[1:], strict=False)}
DATES = [re.compile(f"(?=({x}))", re.ASCII) for x in (r"(?:19|20)\d\d[-/.]?\d\d[-/.]?\d\d", r"\d\d[-/.]?\d\d[-/.]?(?:19|20)\d\d", r"(?:19|20)\d\d")]
#: Runs whose characters have one brute-force cost.
RUN = re.compile(r"\d+|[A-Z]?[a-z]+|[A-Z]+|.", re.DOTALL)
VOWEL = re.compile(r"[aeiouy]", re.ASCII | re.IGNORECASE)
#: log10 cost of a brute-force character: digit, letter of a run of three or more with a
#: word's share of vowels (letters that read like a word carry little each), other letter,
#: anything else.
DIGIT, LETTER, MIXED, SYMBOL = 1.0, 0.6, math.log10(52), math.log10(33)
#: log10 cost of opening one more segment: the attacker doesn't know where it begins.
OPEN = 0.3
#: Longest block of a repeat.
MOST_PERIOD = 8


def is_date(text: str) -> bool:
    digits = re.sub(r"\D", "", text)
    if len(digits) == 4:
        return True
    for y, m, d in ((digits[:4], digits[4:6], digits[6:]), (digits[4:], digits[2:4], digits[:2]), (digits[4:], digits[:2], digits[2:4])):
        try:
            date(int(y), int(m), int(d))
        except ValueError:
            continue
        return 1900 <= int(y) <= 2099
    return False


def lowered(value: str) -> str:
    low = value.lower()
    if len(low) != len(value):  # a letter whose lower case is longer: no patterns across it
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in value)
    return low


class Dictionary:
    """log10 ranks of words: fixed password words first, then learnt ones in their order."""

    def __init__(self, learnt: list[str] = ()):
        self.rank = {w: math.log10(i + 2) for i, w in enumerate(dict.fromkeys([*WORDS, *learnt]))}
        self.longest = max(map(len, self.rank))


PLAIN = Dictionary()


class Starts:
    """Starts of a segment that costs ``base`` + log10(its length), whatever its start and end, for the shortest path.

    Such a cost is concave in the length, so that of two starts the earlier one, once it is
    better, stays so.  ``held`` has those that may still win, the best of now last: time is
    linear in the number of starts.
    """

    def __init__(self):
        self.held: list[tuple[int, float]] = []

    @staticmethod
    def overtakes(a: tuple[int, float], b: tuple[int, float]) -> float:
        """The end from which the earlier start a is the better one."""
        ratio = 10 ** min(300.0, b[1] - a[1])
        return (ratio * b[0] - a[0]) / (ratio - 1) if ratio > 1 else math.inf

    def best_to(self, j: int, new: tuple[int, float]) -> tuple[float, int]:
        """The least cost to the end ``j``, and its start; ``new`` (start, cost so far) is one that becomes possible with j."""
        held, total = self.held, lambda s: s[1] + math.log10(j - s[0])
        while len(held) > 1 and total(held[-2]) <= total(held[-1]):
            held.pop()
        if not held or total(new) < total(held[-1]):
            while held and self.overtakes(held[-1], new) >= (self.overtakes(held[-2], held[-1]) if len(held) > 1 else math.inf):
                held.pop()
            held.append(new)
        return total(held[-1]), held[-1][0]


class Runs:
    """Keyboard walks of three or more characters and repeats of a block of up to eight, of any start and end."""

    def __init__(self, value: str):
        self.value, self.low = value, lowered(value)
        self.walk_begin, self.walks = 0, Starts()
        #: by period: where the run of equal blocks began, and the starts by their remainder
        self.begins = [0] * (MOST_PERIOD + 1)
        self.repeats = [[Starts() for _ in range(p)] for p in range(MOST_PERIOD + 1)]

    def best_to(self, j: int, opened: Callable[[int], float]) -> tuple[float, int, str]:
        """The least cost of a path to ``j`` whose last segment is a walk or repeat, where that begins, and which it is; for j = 1, 2, ... in order."""
        best = (math.inf, 0, "")
        if j > 1 and self.low[j - 2 : j] not in NEXT:
            self.walk_begin, self.walks = j - 1, Starts()
        if (new := j - 3) >= self.walk_begin:
            cost, begin = self.walks.best_to(j, (new, opened(new) + 1.5))
            best = (cost, begin, "walk")
        for p in range(1, min(MOST_PERIOD, j - 1) + 1):
            if self.value[j - 1] != self.value[j - 1 - p]:
                self.begins[p], self.repeats[p] = j - p, [Starts() for _ in range(p)]
            new = j - p * least_times(p)
            if new >= self.begins[p]:
                block = sum(brute(self.value, new, new + p)) - math.log10(p)
                cost, begin = self.repeats[p][j % p].best_to(j, (new, opened(new) + block))
                best = min(best, (cost, begin, "repeat"))
        return best


def least_times(period: int) -> int:
    return 3 if period == 1 else 2


def segments(value: str, words: Dictionary = PLAIN) -> list[list[tuple[int, float, str]]]:
    """For each start the words and dates (end, log10 guesses, kind) that begin there."""
    low, n = lowered(value), len(value)
    plain = low.translate(LEET)
    found: list[list[tuple[int, float, str]]] = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i + 4, min(n, i + words.longest) + 1):
            word = low[i:j]
            cost = words.rank.get(word)
            if cost is None and (cost := words.rank.get(plain[i:j])) is not None:
                cost += 0.6  # with replacements
            if cost is not None:
                found[i].append((j, cost + (0.3 if value[i:j] != word else 0), "word"))
    for pattern in DATES:
        for m in pattern.finditer(value):
            if is_date(m[1]):
                found[m.start()].append((m.start() + len(m[1]), 2.0 if len(m[1]) == 4 else 4.6, "date"))
    return found


def brute(value: str, begin: int, end: int) -> list[float]:
    """log10 cost of each character by brute force."""
    out: list[float] = []
    for m in RUN.finditer(value, begin, end):
        run = m[0]
        vowels = len(VOWEL.findall(run))
        each = DIGIT if run[0].isdigit() else SYMBOL if not run[0].isalpha() else LETTER if len(run) > 2 and 0.2 <= vowels / len(run) <= 0.7 else MIXED
        out += [each] * len(run)
    return out


def guess_cost(value: str, words: Dictionary = PLAIN) -> tuple[float, list[tuple[int, int, str]]]:
    """The least log10 number of guesses, and a segmentation that has it.

    A shortest path over the value's positions, each in two states: the last segment is brute
    force, which goes on a character at a time and is opened once, or it is a pattern.  Every
    segment but the first costs ``OPEN``.  Time is linear in the length.
    """
    n = len(value)
    patterns, single, runs = segments(value, words), brute(value, 0, n), Runs(value)
    forced, closed = [math.inf] * (n + 1), [0.0, *[math.inf] * n]
    #: where the segment that ends in a position begins, by state, and the pattern's kind
    forced_from, closed_from = [0] * (n + 1), [(0, "")] * (n + 1)
    opened = lambda i: min(forced[i], closed[i]) + (OPEN if i else 0)
    for i in range(n + 1):
        if i:
            cost, begin, kind = runs.best_to(i, opened)
            if cost < closed[i]:
                closed[i], closed_from[i] = cost, (begin, kind)
        if i == n:
            break
        fresh = closed[i] + (OPEN if i else 0)
        forced[i + 1], forced_from[i + 1] = (forced[i] + single[i], forced_from[i]) if forced[i] <= fresh else (fresh + single[i], i)
        for end, cost, kind in patterns[i]:
            if (total := opened(i) + cost) < closed[end]:
                closed[end], closed_from[end] = total, (i, kind)
    cut: list[tuple[int, int, str]] = []
    j, after_forced = n, False
    while j:
        if forced[j] < closed[j] and not after_forced:
            i, kind = forced_from[j], "brute"
        else:
            i, kind = closed_from[j]
        after_forced = kind == "brute"
        cut.append((i, j, kind))
        j = i
    return min(forced[n], closed[n]), cut[::-1]


def find_base(text: str | None, cued: bool = True) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the base patterns."""
    if not text:
        return []
    out = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if cued:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    return out


def cued(text: str) -> bool:
    low = text.lower()
    return any(c in low for c in CUES)


def values(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the values that stand where a credential may stand, each once."""
    seen = set()
    for pattern in PLACES:
        for m in pattern.finditer(text):
            span = next(m.span(g) for g in range(1, pattern.groups + 1) if m[g] is not None)
            if span not in seen:
                seen.add(span)
                yield span


def find_guess(text: str, base: list[tuple[int, int, str]], least: float, words: Dictionary) -> list[tuple[int, int, str]]:
    """Spans of credential values whose guess cost reaches ``least``."""
    out = []
    for begin, end in values(text):
        value = text[begin:end]
        if not any(b <= begin and end <= e for b, e, _ in base) and not PLACEHOLDER.fullmatch(value) and guess_cost(value, words)[0] >= least:
            out.append((begin, end, "guess"))
    return out


def find(text: str | None, least: float = MIN_GUESSES_LOG10, words: Dictionary = PLAIN) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and all spans of a text, each in order."""
    if not text:
        return [], []
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    near = cued(text)
    base = sorted(find_base(text, near), key=order)
    added = find_guess(text, base, least, words) if near else []
    return base, sorted(base + added, key=order)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{b}:{e}" for b, e, k in spans)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each covered stretch replaced by one ``[SECRET]``."""
    parts, at = [], 0
    for begin, end, _ in sorted(spans):
        if begin >= at:
            parts += [text[at:begin], "[SECRET]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def distinct_words(text: str) -> set[str]:
    """The words of a whole text that the dictionary may hold; memory grows with the distinct ones."""
    found: set[str] = set()
    begin, most = 0, WORD_LETTERS[1]
    while begin < len(text):
        cut = NO_LETTER.search(text, begin + PIECE)
        end = cut.end() if cut else len(text)
        found.update(WORD.findall(text[begin:end].lower()))
        begin = end
    return {w for w in found if len(w) <= most}


def outside_values(text: str) -> str:
    """The text with a space in place of each credential value and each base span."""
    if not cued(text):
        return HEX.sub(" ", text)
    gone = sorted([*values(text), *(m.span(2) for m in ASSIGN.finditer(text)), *((b, e) for b, e, k in find_base(text, False))])
    parts, at = [], 0
    for begin, end in gone:
        if begin > at:
            parts.append(text[at:begin])
        at = max(at, end)
    return " ".join([*parts, text[at:]])


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, texts that hold it outside of credential values), in parts that add up."""
    part = lambda c: pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], names=["w", "n"])
    counts: Counter[str] = Counter()
    for (texts,) in common.rows(batches, "text"):
        for text in texts:
            counts.update(distinct_words(outside_values(text)))
            if len(counts) > HELD_WORDS:
                yield part(counts)
                counts = Counter()
    yield part(counts)


def kept_batches(batches: Iterator[pa.RecordBatch], bitset: np.ndarray, inside: bool) -> Iterator[pa.RecordBatch]:
    """Rows whose ``h`` is in the filter, or those where it isn't."""
    for batch in batches:
        h = batch.column(batch.schema.get_field_index("h")).to_numpy(zero_copy_only=False).view(np.uint64)
        yield batch.filter(pa.array(common.in_filter(bitset, h) == inside))


def different_texts(docs: DataFrame, tables: common.Workspace) -> DataFrame:
    """text: each text of documents with an id once.

    Texts whose hash occurs once need no shuffle; a filter finds them, and what it takes for a
    copy is grouped by its digest, one text a task and group before the exchange.
    """
    texts = docs.where("doc_id is not null and text is not null").select("text", F.xxhash64("text").alias("h"))
    copied = tables.write(texts.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "copied")
    held = tables.spark.sparkContext.broadcast(common.filter_of(copied))
    tables.drop(copied)
    side = lambda inside: texts.mapInArrow(common.tidy(lambda b: kept_batches(b, held.value, inside)), texts.schema).select("text")
    once = side(True).groupBy(F.md5("text").alias("digest")).agg(F.first("text").alias("text")).select("text")
    return side(False).unionByName(once)


def learn_words(docs: DataFrame) -> list[str]:
    """The dictionary of all documents, words of most different texts first, ties by word.

    Counts are exact.  How many words have each count is asked first (distinct counts are at most
    the root of twice their sum), so that only words that may be among the first reach the driver.
    """
    common.bound_batches(docs.sparkSession)
    tables = common.Workspace(docs.sparkSession, "secrets")
    parts = different_texts(docs, tables).mapInArrow(common.tidy(count_batches), "w string, n long")
    counts = tables.write(parts.groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= WORD_DOCUMENTS), "words")
    least, above = WORD_DOCUMENTS, 0
    for n, words in sorted(map(tuple, counts.groupBy("n").count().collect()), reverse=True):
        least, above = n, above + words
        if above >= DICTIONARY:
            break
    found = [r.w for r in counts.where(F.col("n") >= least).orderBy(F.desc("n"), "w").limit(DICTIONARY).collect()]
    tables.drop(counts)
    return found


def scan_batches(batches: Iterator[pa.RecordBatch], least: float, words: Dictionary) -> Iterator[pa.RecordBatch]:
    for ids, texts in common.rows(batches, "doc_id", "text"):
        out: list[list] = [[] for _ in range(5)]
        for text in texts:
            base, every = find(text, least, words)
            for column, kind in zip(out, KINDS, strict=False):
                column.append(sum(k == kind for *_, k in base))
            out[3][-1:] = [hashlib.sha256(joined(base).encode()).hexdigest()]
            out[4].append(joined(every))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in out[:3]), *(pa.array(c, pa.string()) for c in out[3:])], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def shared_words(docs: DataFrame) -> Broadcast:
    common.bound_batches(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(Dictionary(learn_words(docs)))


def scan(docs: DataFrame, least: float = MIN_GUESSES_LOG10) -> DataFrame:
    """One row per document with its spans; of the texts only counts of words are shuffled."""
    words = shared_words(docs)
    return docs.select("doc_id", "text").mapInArrow(common.tidy(lambda b: scan_batches(b, least, words.value)), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_texts(docs: DataFrame, least: float = MIN_GUESSES_LOG10) -> DataFrame:
    """``docs`` with every secret span replaced; rows without secrets keep their text."""
    words = shared_words(docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            new = [redact(t, s) if t and (s := find(t, least, words.value)[1]) else t for t in texts]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    out = docs.mapInArrow(common.tidy(work), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
