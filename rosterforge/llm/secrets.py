"""Secret scans: fixed patterns, and the guess cost of values that stand where credentials stand."""

from __future__ import annotations

import functools
import hashlib
import math
import re

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop_written, map_texts, whole, written

# The patterns of the base kinds, in the order in which the kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "guess")
ASSIGN_LEAST = 6
#: Where a value is looked at by its guess cost: after more names than the base kinds know, and with more characters in the value. A value in quotes that close on its line is all between them.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|credentials?|auth(?:orization)?|private[_-]?key|access[_-]?key|client[_-]?secret)"""
    r"""["']?\x20*(?::=|=>|[:=])\x20*(?:bearer\x20+|basic\x20+)?"""
    r"""(?:"((?:[^"\\\n]|\\.)+)"|'((?:[^'\\\n]|\\.)+)'|["']?([^\s"'`<>,;(){}\[\]|]+))""",
    re.IGNORECASE | re.ASCII,
)
NEAR = re.compile(r"pass|pwd|secret|token|key|credential|auth", re.IGNORECASE | re.ASCII)
#: A value of fewer guesses (log10) is left alone: a word of the language, a date, a repeat, a placeholder. Words and marks alone, without a digit or a capital inside, need more: they are
#: names, addresses and options unless there are several of them.
LEAST_GUESSES, LEAST_OF_WORDS, LEAST_CHARACTERS = 8.0, 15.0, 8
#: The words of the corpus that are known, at most, those in most documents and in LEAST_SEEN or more; they cost their rank, after those of WORDS.
KNOWN, LEAST_SEEN = 50_000, 3
#: log10 of the guesses for letters between other characters that sound like a word, though it is not known; for a mark between words.
LIKE, MARK = 5.0, 0.7

# Common words of passwords and of configuration texts, most common first.
WORDS = (
    "password the and for you that this with from have not are was but all can your key user admin test example none null true false "
    "value name string here changeme default letmein welcome secret token login root guest master access public private system server "
    "client service account love dragon monkey shadow sunshine princess football baseball superman batman hello summer winter spring "
    "autumn monday friday january march april june july august october qwerty trustno starwars iloveyou whatever freedom michael "
    "jennifer jordan hunter ranger thomas robert daniel andrew joshua matthew charlie house green blue black white red orange yellow "
    "silver gold computer internet mobile phone email mail data base file link config setting option required optional your insert "
    "replace placeholder sample demo temp dummy unknown enter reset forgot invalid expired http https www com org net html"
).split()
RANK = {w: i + 1 for i, w in reversed(list(enumerate(WORDS)))}
LONGEST_WORD = 24
CORPUS_WORD = re.compile(rf"\b[a-z]{{3,{LONGEST_WORD}}}\b", re.ASCII)
#: Letters of one case, or with a capital at the begin, between other characters, and whether they sound like a word.
RUN = re.compile(r"(?<![A-Za-z])(?:[A-Z]?[a-z]{3,23}|[A-Z]{4,24})(?![a-z])", re.ASCII)
SOUNDS = re.compile(r"[^aeiouy]{0,3}(?:[aeiouy]{1,3}[^aeiouy]{1,4})*[aeiouy]{0,3}", re.IGNORECASE)
PLAIN = re.compile(r"[^\W\d_]?[^\d_A-Z]*(?:[\W_]+[^\W\d_]?[^\d_A-Z]*)*")
# Rows of keys.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("4@3105$7", "aaeiosst")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)?\d\d")


@functools.cache
def neighbours() -> frozenset[tuple[str, str]]:
    """Pairs of keys of which one lies next to the other in a row, or in the next row."""
    near = set()
    for r, row in enumerate(ROWS):
        for k, a in enumerate(row):
            for other, at in ((row, k + 1), *((ROWS[r + 1], j) for j in (k - 1, k) if r + 1 < len(ROWS))):
                if 0 <= at < len(other):
                    near |= {(a, other[at]), (other[at], a)}
    return frozenset(near)


def spread(value: str) -> float:
    """log10 of the guesses for one character of a value without any pattern: of the classes that occur in it."""
    classes = ((r"[a-z]", 26), (r"[A-Z]", 26), (r"[0-9]", 10), (r"[^a-zA-Z0-9]", 33))
    return math.log10(sum(n for c, n in classes if re.search(c, value)) or 1)


def segments(value: str, ranks: dict[str, int] = RANK) -> dict[int, list[tuple[int, float]]]:
    """By start: length and log10 guesses of the parts of a value that follow a pattern: known words (in capitals or with digits for letters too), letters that sound like a word, single marks between words,
    dates, repeats, sequences and keyboard walks."""
    lower = value.lower()
    plain = lower.translate(LEET)
    if len(lower) != len(value):  # a few characters are longer in lower case
        lower = plain = value
    n = len(value)
    found = _runs(lower, neighbours())
    add = lambda i, size, cost: found.setdefault(i, []).append((size, cost))
    for i in range(n):
        for size in range(3, min(LONGEST_WORD, n - i) + 1):
            part = lower[i : i + size]
            capital = 0.0 if value[i : i + size] == part else 0.5
            if (rank := ranks.get(part)) is not None:
                add(i, size, math.log10(rank + 1) + capital)
            elif plain[i : i + size] != part and (rank := ranks.get(plain[i : i + size])) is not None:
                add(i, size, math.log10(rank + 1) + 0.5 + capital)
        if value[i].isdigit() and (m := DATE.match(value, i)):
            add(i, m.end() - i, 2.1 if len(m[0]) == 4 else 4.6)
        if 0 < i < n - 1 and not value[i].isalnum() and value[i - 1].isalnum() and value[i + 1].isalnum():
            add(i, 1, MARK)
        if value.startswith("://", i):
            add(i, 3, MARK)
    for m in RUN.finditer(value):
        if SOUNDS.fullmatch(m[0]) and re.search("[aeiouyAEIOUY]", m[0]):
            add(m.start(), len(m[0]), LIKE)
    return found


def guess_cost(value: str, ranks: dict[str, int] = RANK) -> float:
    """log10 of the guesses that find the value: the least over all ways to cut it into segments and spans without pattern.

    least[i] is that of the first i characters. Segments are known by their start; a span without pattern grows by one character, so the time is in proportion to the length.
    The empty value costs 0.
    """
    each, n, parts = spread(value), len(value), segments(value, ranks)
    least, brute = [math.inf] * (n + 1), [math.inf] * (n + 1)
    least[0] = 0.0
    for i in range(n):
        # a further segment doubles the guesses, for where it begins
        base = least[i] + (math.log10(2) if i else 0.0)
        brute[i + 1] = min(brute[i], base) + each
        least[i + 1] = min(least[i + 1], brute[i + 1])
        for size, cost in parts.get(i, ()):
            least[i + size] = min(least[i + size], base + cost)
    return least[n]


def _runs(text: str, near: frozenset[tuple[str, str]]) -> dict[int, list[tuple[int, float]]]:
    """By start: length and log10 guesses of maximal repeats (of units of 1 to 4 characters), sequences (abc, 321) and keyboard walks."""
    runs: dict[int, list[tuple[int, float]]] = {}
    n = len(text)

    def stretches(holds: list[bool], gap: int, least: int, cost) -> None:
        """Runs of places k at which text[k] goes with text[k - gap]."""
        begin = None
        for k in range(gap, n + 1):
            if k < n and holds[k]:
                begin = k if begin is None else begin
            elif begin is not None:
                if (size := k - begin + gap) >= least:
                    runs.setdefault(begin - gap, []).append((size, cost(size)))
                begin = None

    for unit in range(1, 5):
        stretches([k >= unit and text[k] == text[k - unit] for k in range(n)], unit, max(3, 2 * unit), lambda s, u=unit: 1.4 * u + math.log10(s))
    for step in (1, -1):
        stretches([k > 0 and ord(text[k]) - ord(text[k - 1]) == step and text[k].isalnum() and text[k - 1].isalnum() for k in range(n)], 1, 3, lambda s: 1.0 + math.log10(s))
    stretches([k > 0 and (text[k - 1], text[k]) in near for k in range(n)], 1, 4, lambda s: 1.6 + 0.35 * s)
    return runs


def word_ranks(docs: DataFrame, text: str = "text", most: int = KNOWN, least: int = LEAST_SEEN) -> dict[str, int]:
    """The ranks of WORDS and after them of the corpus's words, by the number of documents that have them. All documents are counted; the words above a number of documents, in steps of quarter powers of 2, that
    leaves `most` of them or fewer go to the driver."""

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                seen.update(set(CORPUS_WORD.findall(x.lower())))
                if len(seen) > 300_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
                    seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    counts = docs.select(whole(docs[text]).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts.where(F.col("n") >= least).withColumn("step", F.floor(F.log2("n") * 4)), "secret-words")
    steps = {r.step: r.words for r in counts.groupBy("step").agg(F.count("*").alias("words")).collect()}
    bound, total = max(steps, default=-1) + 1, 0
    while bound > 0 and total + steps.get(bound - 1, 0) <= most:
        bound -= 1
        total += steps.get(bound, 0)
    found = [w for _, w in sorted((-r.n, r.word) for r in counts.where(F.col("step") >= bound).select("word", "n").collect())]  # `most` words
    drop_written(counts)
    return {w: k for k, w in reversed(list(enumerate([*RANK, *(w for w in found if w not in RANK)], 1)))}


def needed(value: str) -> float:
    """The guesses from which a value is a secret."""
    return LEAST_OF_WORDS if PLAIN.fullmatch(value) else LEAST_GUESSES


def secrets(text: str, ranks: dict[str, int] = RANK) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], list[tuple[int, int, float]]]:
    """(start, kind's number, end) of the base kinds, those and the guessed values, and (start, end, guess cost) of each value in a credential context."""
    base, values = [], []
    if NEAR.search(text):
        base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
        values = [(*m.span(m.lastindex), guess_cost(m[m.lastindex], ranks)) for m in CONTEXT.finditer(text)]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    more = [(a, 3, b) for a, b, cost in values if b - a >= LEAST_CHARACTERS and cost >= needed(text[a:b])]
    return base, sorted(base + more), values


def spans(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess, max_guess_cost.

    Spans are kind:start:end in code points, end exclusive, by start and then kind, joined by commas. Base kinds: assign (a name, then a
    value of at least 6 characters), access and hex; a match of a kind begins after the one before. Kind guess: a value in a credential
    context whose guess cost reaches LEAST_GUESSES, or LEAST_OF_WORDS if it is words and marks only. The words that are known come from all the table's texts. max_guess_cost: of all such values, null
    where there is none. A null text counts as empty: no spans, the digest of the empty string. Repeated rows give repeated rows, an empty table none; further columns are left out.
    """

    shared = docs.sparkSession.sparkContext.broadcast(word_ranks(docs, text))  # KNOWN words

    def make(texts: list[str]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "max_guess_cost")}
        for x in texts:
            base, every, values = secrets(x, shared.value)
            kinds = [kind for _, kind, _ in every]
            row = [*(kinds.count(k) for k in range(3)), hashlib.sha256(spans(base).encode()).hexdigest(), spans(every), kinds.count(3), max((c for *_, c in values), default=None)]
            for name, value in zip(out, row, strict=True):
                out[name].append(value)
        return out

    return map_texts(docs, make, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, max_guess_cost double", key, text)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))
