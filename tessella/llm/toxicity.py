"""Toxicity of text that may be disguised: a noisy channel, then a score.

A disguised token is read as what a channel made of a word: letters written as
digits or signs, stretched letters, marks between letters, letters set apart by
spaces.  The token's lattice of possible letters is decoded by a Viterbi search
that keeps the best path of each state, under a character model (trigrams of all documents)
mixed with the words of the labelled sample.  The restored words are scored.
A word cut by spaces into pieces of more than one letter is not put together:
in running text any three short words would be.
"""

from __future__ import annotations

import math
import re
import string
import sys
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.labelled import SAMPLE, one_per_family, with_labels
from tessella.llm.words import U, Words, blocks, given, lean, returned, tune, utf8

# Which letters a sign may stand for; "" means that it may be a mere mark.
CHANNEL = {
    "0": "oо", "1": "il", "2": "z", "3": "eз", "4": "aч", "5": "s", "6": "gbб", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i",
}
MARKS = set(".-_*~'`^:,;/\\=#%&\"?")
EDGE = ".,;:!?\"'()[]{}<>«»…-–—*#%&~`/\\|_=+^$@"
BEFORE, AFTER = "\"'([{«¿¡", ".,;:!?\"')]}»…"  # marks at a word's ends that are never letters

LONGEST, STEP = 32, 8  # runs of equal characters that are read at once; from one reading of a longer token to the next
SUBSTITUTE, STRETCH, MARK, PLAIN = math.log(0.05), math.log(0.05), math.log(0.05), math.log(0.9)
OTHER = 59  # the code of a letter of any other script
LETTERS = OTHER + 1
ODD = re.compile(r"[a-zß-öø-ÿа-яі0-9@$!|€£¡+(<][^\s]*[0-9@$!|€£¡+(<.\-_*~'`^:,;/\\=#%&\"?а-яі]|[0-9@$!|€£¡+(<а-яі][^\s]*[a-z]|([a-z])\1\1")
TWICE = re.compile(r"([^\W\d_])\1")
RUN = re.compile(r"(.)\1*", re.S)

KEPT = 100_000  # readings that a worker remembers
LEAST_DOCS, LEAST_P, Z = 4, 0.5, 1.96


def _letter_codes() -> np.ndarray:
    """The code of each code point: 1-26 for a-z, with their accents off, 27-58 for the Cyrillic alphabet, OTHER for other letters, 0 for what is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for point in range(sys.maxunicode + 1):
        c = chr(point)
        if not c.isalpha():
            continue
        if point > 0x24F and not 0x400 <= point < 0x460 and not 0x1E00 <= point < 0x1F00:
            out[point] = OTHER
            continue
        base = unicodedata.normalize("NFD", c.lower())[0]
        out[point] = ord(base) - 96 if "a" <= base <= "z" else ord(base) - ord("а") + 27 if "а" <= base <= "я" else 19 if base == "ß" else OTHER
    return out


CODES = _letter_codes()
CODE_OF = CODES.tobytes()  # indexed one by one, faster than an array


@dataclass
class Model:
    """tri: log probability of a letter's code (0 for the edge) after two others; words: log probability of known words; toxic: word -> probability; base: of a text without such words."""

    tri: np.ndarray
    words: dict[str, float] = field(default_factory=dict)
    toxic: dict[str, float] = field(default_factory=dict)
    base: float = 0.5

    def __post_init__(self):
        self.table = self.tri.tolist()
        self.seen: dict[str, str] = {}
        self.read: dict[bytes, list[str]] = {}
        self.begun: tuple[int, frozenset[str]] = (0, frozenset([""]))
        self.headed: tuple[int, np.ndarray] = (-1, np.zeros(0, U))

    def __getstate__(self):
        return self.__dict__ | {"seen": {}, "read": {}, "begun": (0, frozenset([""])), "headed": (-1, np.zeros(0, U))}

    def starts(self) -> frozenset[str]:
        """All beginnings of known words, made anew once the words change."""
        if self.begun[0] != len(self.words):
            self.begun = len(self.words), frozenset(w[:k] for w in self.words for k in range(len(w) + 1)) | {""}
        return self.begun[1]

    def heads(self) -> np.ndarray:
        """What Cores.heads() gives for the toxic words, in order, made anew once their number changes; the greatest number stands at the end."""
        if self.headed[0] != len(self.toxic):
            raw = [RUN.sub(r"\1", w).encode()[:8].ljust(8, b"\0") for w in self.toxic]
            self.headed = len(self.toxic), np.r_[np.unique(np.frombuffer(b"".join(raw), "<u8")), ~U(0)]
        return self.headed[1]

    def said(self, word: bytes) -> list[str]:
        """The readings of a word; those of the last words are kept."""
        got = self.read.get(word)
        if got is None:
            if len(self.read) >= KEPT:
                self.read.clear()
            got = self.read[word] = readings(word.decode("utf-8", "replace"), self)
        return got

    def restore(self, token: str) -> str:
        """The likeliest word behind a token; the token itself where no lattice applies."""
        if token not in self.seen:
            if len(self.seen) >= KEPT:
                self.seen.clear()
            self.seen[token] = viterbi(token, self)
        return self.seen[token]


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters the strings it may stand for, with the channel's log probability."""
    out = []
    for run in RUN.finditer(token):
        c, n = run.group(1), run.end() - run.start()
        letters = (c if c.isalpha() else "") + CHANNEL.get(c, "")
        options = []
        for letter in letters:
            cost = PLAIN if letter == c else SUBSTITUTE
            if n <= 2:
                options.append((letter * n, cost * n))
            if n >= 2:
                options += [(letter, cost + STRETCH), *([(letter * 2, 2 * cost + STRETCH)] if n > 2 else [])]
        if c in MARKS or c in "!|+<(" or not letters:
            options.append(("", MARK * n if c in MARKS else MARK * 2 * n))
        out.append(options)
    return out


def viterbi(token: str, model: Model) -> str:
    """The best path through a token's lattice, and at the end words of the sample are preferred; the best path lives of each last two letters, and of each beginning of a known word."""
    starts, code = model.starts(), CODE_OF
    paths = {(0, 0, ""): (0.0, "")}
    for options in lattice(token):
        grown: dict[tuple[int, int, str | None], tuple[float, str]] = {}
        for (a, b, start), (score, text) in paths.items():
            for piece, cost in options:
                s, x, y = score + cost, a, b
                for letter in piece:
                    k = code[ord(letter)]
                    s += model.table[x][y][k]
                    x, y = y, k
                whole = text + piece
                state = (x, y, whole if start is not None and whole in starts else None)
                if state not in grown or grown[state] < (s, whole):
                    grown[state] = (s, whole)
        paths = grown
        if not paths:
            return token
    ends = [(s, text, x, y) for (x, y, _), (s, text) in paths.items()]
    channel = lambda p: p[0] + model.table[p[2]][p[3]][0]
    best = max(ends, key=lambda p: (max(channel(p), model.words[p[1]] + SUBSTITUTE * 3) if p[1] in model.words else channel(p), p[1]))
    return best[1] or token


def strip(word: str) -> str:
    """A word without the marks around it; signs of three or more in a row count as marks, a single one at an edge may be a letter."""
    core = re.sub(r"^(\W|_)\1{2,}|(\W|_)\2{2,}$", "", word).rstrip(AFTER).lstrip(BEFORE)
    return core if any(c.isalnum() for c in core) else ""


def _among(signs: str) -> np.ndarray:
    """For each byte whether it is one of the signs of one byte."""
    return np.isin(np.arange(256), [ord(c) for c in signs if c.isascii()])


def _before(flags: np.ndarray) -> np.ndarray:
    """How many flags are set before each place, the end included."""
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=out[1:])
    return out


TRIMMED = 3  # marks of a kind that Cores takes off an end
MARK_BEFORE, MARK_AFTER, SMALL = _among(BEFORE), _among(AFTER), _among(string.ascii_lowercase)
SIGN = _among("".join(map(chr, range(128)))) & ~_among(string.ascii_letters + string.digits)


class Cores:
    """What the bytes of words tell of their cores, for all words of a block at once.

    letters: the word has LONGEST bytes at most, and strip() leaves a-z and À-ÿ
    only; once: and none of them twice in a row, so that the core is all that
    readings() gives; begin, end: where the core lies.  A word without
    ``letters`` has to be read.
    """

    def __init__(self, words: Words):
        data = np.frombuffer(words.buf, np.uint8)
        letter = SMALL[data]
        self.again = np.r_[False, data[1:] == data[:-1]] & letter
        two = np.flatnonzero(data[:-1] == 0xC3)  # of the letters À-ÿ the first of two bytes
        second = data[two + 1]
        letter[two] = letter[two + 1] = ((second & 0xC0) == 0x80) & (second != 0x97) & (second != 0xB7)  # not × and ÷
        self.again[two[1:]] = self.again[two[1:] + 1] = (np.diff(two) == 2) & (second[1:] == second[:-1])
        self.buf, self.data = words.buf, data
        begin, end = words.start.copy(), words.end.copy()
        last = data[end - 1]
        three = SIGN[last] & (data[end - 2] == last) & (data[end - 3] == last)
        for _ in range(TRIMMED):
            end -= three & (data[end - 1] == last)
        for _ in range(TRIMMED):
            begin += MARK_BEFORE[data[begin]]
            end -= MARK_AFTER[data[end - 1]]
        end = np.maximum(begin, end)
        self.begin, self.end = begin, end
        others, self.agains = _before(~letter), _before(self.again)
        self.letters = (begin < end) & (words.end - words.start <= LONGEST) & (others[end] == others[begin])
        self.once = self.letters & (self.agains[end] == self.agains[begin])

    def text(self, i: int) -> str:
        return self.buf[self.begin[i] : self.end[i]].decode()

    def heads(self) -> np.ndarray:
        """Each core's first eight bytes as a number, with one letter for several equal ones in a row, and zeros after its end."""
        raw = self.data[~self.again].tobytes() + bytes(8)
        begin, end = self.begin - self.agains[self.begin], self.end - self.agains[self.end]
        eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
        return eight[begin] & (~U(0) >> (U(64) - U(8) * np.clip(end - begin, 1, 8).astype(U)))


def readings(word: str, model: Model) -> list[str]:
    """What a word may say: its core, the words between the marks in it, and the word restored from it; of more than LONGEST characters also the toxic words in it, and of more than LONGEST runs those in overlapping windows."""
    long = len(word) > LONGEST
    if long:  # what is longer than three is stretched all the same
        word = re.sub(r"(.)\1{3,}", r"\1\1\1", word, flags=re.S)
    core = strip(word)
    if not core:
        return []
    bare = core.strip(EDGE)
    out = [bare] if bare.isalpha() else [x for x in re.split(r"[\W\d_]+", bare) if len(x) > 2]
    if core in model.toxic:
        return [core]
    runs = [m.start() for m in RUN.finditer(core)] if len(core) > LONGEST else []
    if len(runs) > LONGEST:
        if model.toxic:
            for k in range(0, len(runs) - LONGEST + STEP, STEP):
                piece = model.restore(core[runs[k] : runs[k + LONGEST] if k + LONGEST < len(runs) else len(core)])
                out += [x for x in model.toxic if x in piece]
    elif not bare.isalpha() or ODD.search(core) or (TWICE.search(core) and bare not in model.words):
        out.append(model.restore(core))
        if long:
            out += [x for x in model.toxic if x in out[-1]]
    return out


def spelled(words: Words) -> dict[int, list[tuple[int, int]]]:
    """Of each text that has any, the runs of three or more words of one character, of however many bytes."""
    rest = _before((np.frombuffer(words.buf, np.uint8) & 0xC0) == 0x80)  # bytes that carry a character on
    single = words.end - words.start - rest[words.end] + rest[words.start] == 1
    new = np.zeros(len(single) + 1, bool)  # another text begins, or none
    new[words.first] = True
    first = np.flatnonzero(single & (new[:-1] | ~np.r_[False, single][:-1]))
    last = np.flatnonzero(single & (new[1:] | ~np.r_[single, False][1:])) + 1
    long = last - first >= 3
    out: dict[int, list[tuple[int, int]]] = {}
    for k, i, j in zip((np.searchsorted(words.first, first[long], "right") - 1).tolist(), first[long].tolist(), last[long].tolist(), strict=True):
        out.setdefault(k, []).append((i, j))
    return out


def found_words(texts: list[str | None], model: Model, wanted: bool) -> list[set[str]]:
    """For each text the restored words; if ``wanted``, only those that the model holds for toxic.  Each different word of a block is read once.

    Not read are words whose core is all that they say and, if ``wanted``,
    those of letters only that no toxic word can be behind: the channel makes
    such letters but fewer in a row, and no toxic word begins like them.
    """
    words = Words([utf8(x) for x in texts])
    cores, chosen = Cores(words), np.arange(len(words.hash))
    if wanted:
        toxic, own = model.heads(), cores.heads()
        chosen = np.flatnonzero(~cores.letters | (toxic[np.searchsorted(toxic[:-1], own)] == own))
    _, at, which = np.unique(words.hash[chosen], return_index=True, return_inverse=True)
    said: list[list[str]] = []
    for i in chosen[at].tolist():
        got = [cores.text(i)] if cores.once[i] else model.said(words.text(i))
        said.append([x for x in got if x in model.toxic] if wanted and got else got)
    telling = np.array([bool(x) for x in said], bool)
    use = telling[which] if len(which) else np.zeros(0, bool)
    out, apart = [], spelled(words)
    bounds = np.searchsorted(chosen, words.first).tolist()
    for text, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        mine = {x for k in set(which[a:b][use[a:b]].tolist()) for x in said[k]}
        for i, j in apart.get(text, ()):
            joined = b"".join(words.text(k) for k in range(i, j)).decode("utf-8", "replace")
            for k in range(0, len(joined), STEP):  # overlapping pieces, so that any word of a run is whole in one
                piece = model.restore(joined[k : k + LONGEST])
                mine.update(x for x in model.toxic if x in piece) if wanted else mine.add(piece)
        out.append(mine)
    return out


def letter_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams over all whole texts, a table of fixed size."""
    size = LETTERS**3

    def run(batches):
        total = np.zeros(size, np.int64)
        for block in blocks(batches):
            points = np.frombuffer(" ".join(x or "" for x in block["text"]).encode("utf-32-le", "surrogatepass"), "<u4")
            c = np.r_[CODES[points], 0, 0].astype(np.int32)  # capitals have the codes of their small letters
            total += np.bincount((c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:], minlength=size)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"gram": at, "n": total[at]})

    out = np.zeros(size)
    rows = docs.select("text").mapInPandas(lean(run), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out[rows["gram"].to_numpy(np.int64)] = rows["n"]
    return out.reshape(LETTERS, LETTERS, LETTERS)


def letter_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of the third letter, trigrams mixed with bigrams and single letters."""
    share = lambda x: (x + 0.01) / (x + 0.01).sum(axis=-1, keepdims=True)
    bi, uni = counts.sum(axis=0), counts.sum(axis=(0, 1))
    return np.log(0.6 * share(counts) + 0.3 * share(bi)[None] + 0.1 * share(uni)[None, None])


def lower_bound(k: float, n: float, z: float = Z) -> float:
    """Wilson's lower bound of a proportion."""
    p = k / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    """Learns the character model from all documents, the words from at most ``bound`` labelled ones, one of each family of near copies: else the rare words of a toxic text with many copies would look toxic.

    A word is held for toxic if it stands in at least LEAST_DOCS documents of
    the sample and the lower bound of its toxic part is at least LEAST_P; the
    bound is then its probability.  Without labels no word is.
    """
    spark = docs.sparkSession
    tune(spark)
    model = Model(letter_model(letter_counts(docs)))

    def run(batches):
        total: dict[str, list[int]] = {}
        for block in blocks(batches):
            for label, mine in zip(block["label"], found_words(block["text"].tolist(), model, False), strict=True):
                for word in mine:
                    if 3 <= len(word) <= LONGEST:
                        total.setdefault(word, [0, 0])[int(label > 0)] += 1
                total.setdefault("", [0, 0])[int(label > 0)] += 1
        yield pd.DataFrame([(w, a, b) for w, (a, b) in total.items()], columns=["word", "clean", "toxic"])

    sample = one_per_family(with_labels(docs, labels, "toxic", bound))
    counts = sample.mapInPandas(lean(run), "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rows = counts.where(F.col("clean") + F.col("toxic") >= LEAST_DOCS).collect()  # words of several documents of the bounded sample
    n = next((r["clean"] + r["toxic"] for r in rows if r["word"] == ""), 0)
    rows = [r for r in rows if r["word"]]
    seen = sum(r["clean"] + r["toxic"] for r in rows)
    model.words = {r["word"]: math.log((r["clean"] + r["toxic"]) / seen) for r in rows}
    for r in rows:
        p = lower_bound(r["toxic"], r["clean"] + r["toxic"])
        if p >= LEAST_P:
            model.toxic[r["word"]] = p
    model.read.clear()
    if n:
        model.base = _base(sample, model)
    model.seen.clear()
    model.read.clear()
    return model


def _base(sample: DataFrame, model: Model) -> float:
    """The toxic part of the sample's documents without toxic words; what remains there is the labels' noise."""

    def run(batches):
        for block in blocks(batches):
            none = [not x for x in found_words(block["text"].tolist(), model, True)]
            yield pd.DataFrame({"label": block["label"].to_numpy()[none]})

    n, k = sample.mapInPandas(lean(run), "label int").agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    return min(0.5, (k + 1) / (n + 2))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text, ... -> doc_id, score, words: 1 - (1 - base) times the product of 1 - p over the toxic words of the whole text.

    Null and empty texts have the base score; null ids stay null; repeated rows
    give repeated rows; other columns are ignored; an empty table gives an
    empty table.
    """
    tune(docs.sparkSession)
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = kept.value
        for block in blocks(batches):
            found = found_words(block["text"].tolist(), m, True)
            value = [1 - (1 - m.base) * math.prod(1 - m.toxic[w] for w in sorted(x)) for x in found]
            yield pd.DataFrame({"doc_id": block["doc_id"], "score": value, "words": [",".join(sorted(x)) for x in found]})

    return returned(given(docs, "text").mapInPandas(lean(run), "doc_id string, score double, words string"))


def toxic_column(model: Model, docs: DataFrame) -> Column:
    """The score as a column of ``docs``, for filters that keep all columns, whatever their names.  Null and empty texts have the base score; each row has its own, repeated or not."""
    kept = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        m = kept.value
        out = []
        for block in blocks([pd.DataFrame({"text": texts})]):
            out += [1 - (1 - m.base) * math.prod(1 - m.toxic[w] for w in sorted(x)) for x in found_words(block["text"].tolist(), m, True)]
        return pd.Series(out, dtype="float64")

    return of(F.col("text"))
