"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is any value that is assigned to a telling name or stands before
the host of a URL (user:value@host), and a value of 16 or more letters, digits
and signs that has both letters and digits or that a provider's prefix marks; a
leading NAME= is not part of it.  The forest sees its length, how likely its character
transitions are in words, how much of it a dictionary covers, the path it
comes from and the words beside it.  It is trained on labelled findings, given
by the caller or made by rule (:func:`labelled_findings`).
"""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.packing import byte_letters
from tessella.llm.words import given, lean, returned, tune

FINDINGS = "doc_id string, start long, length int, kind string, score double, secret boolean, digest string"
THRESHOLD = 0.5
NEAR = 6  # neighbouring words on each side that a candidate is seen with, whole ones
BOUND = 20_000  # labelled findings that the driver takes from a table
MARKER = "<secret>"

# Names that announce a secret, words that speak against one, prefixes of public providers' keys.
TELLING = ["token", "secret", "passwd", "password", "api_key", "apikey", "auth", "bearer", "credential", "private_key", "access_key"]
AGAINST = ["example", "sample", "dummy", "commit", "sha256", "sha1", "md5", "checksum", "uuid", "isbn", "revision", "integrity"]
PREFIXES = ["AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "AIza", "npm_", "eyJ"]
TEST_PATHS = ["test", "example", "fixture", "mock", "doc"]

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{16,}(?![A-Za-z0-9+/_=.@-])")
ASSIGNED = re.compile(r"(?:" + "|".join(TELLING) + r")[\w-]*[\"']?\s*(?:=|:|=>)\s*[\"']?$", re.I)
NAMED = re.compile(r"(?:" + "|".join(TELLING) + r")[\w-]{0,40}[\"']?\s{0,40}(?:=>|=|:)\s{0,40}", re.I)
VALUE = re.compile(r"\"([^\"\n]*)\"|'([^'\n]*)'|((?:(?![;,&][\w-]+[=:])\S)+)")
LOGIN = re.compile(r"://[^\s/:@]{0,80}:$")
LOGINS = re.compile(r"://[^\s/:@]{0,80}:([^\s/@]+)@")
TOKEN = re.compile(r"[^\s=:]+")
ALPHABET = "abcdefghijklmnopqrstuvwxyz"

FEATURES = ("length", "transitions", "dictionary", "digits", "upper", "entropy", "signs", "repeats", "hex", "prefix", "assigned", "telling", "against", "path", "quoted")


@lru_cache(maxsize=2)
def dictionary(path: str | None) -> frozenset[str]:
    """Words of four or more letters among the pieces of a byte-level vocabulary file; empty without a file."""
    if not path:
        return frozenset()
    letter = byte_letters()
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = (bytes(letter[c] for c in w if c in letter).decode("utf-8", "ignore").strip().lower() for w in vocab)
    return frozenset(w for w in words if len(w) >= 4 and w.isascii() and w.isalpha())


@lru_cache(maxsize=2)
def transitions(path: str | None) -> np.ndarray:
    """Log probabilities of a letter after another in the dictionary's words; 0 in rows and columns stands for any other character."""
    n = np.full((27, 27), 0.1)
    for w in sorted(dictionary(path)):
        c = [ord(x) - 96 for x in w]
        for a, b in zip([0, *c], [*c, 0], strict=True):
            n[a, b] += 1
    return np.log(n / n.sum(axis=1, keepdims=True))


def covered(value: str, words: frozenset[str]) -> float:
    """The part of a value's characters that its longest dictionary words, taken from the left, cover."""
    low, at, n = value.lower(), 0, 0
    while at < len(low):
        for size in range(min(16, len(low) - at), 3, -1):
            if low[at : at + size] in words:
                n, at = n + size, at + size
                break
        else:
            at += 1
    return n / max(1, len(low))


def describe(value: str, before: str, after: str, path: str | None, vocabulary: str | None) -> list[float]:
    """The features of a candidate, in the order of FEATURES."""
    low, n = value.lower(), len(value)
    table = transitions(vocabulary)
    codes = [ord(c) - 96 if c in ALPHABET else 0 for c in low]
    count = [value.count(c) / n for c in set(value)]
    near = {w.strip("\"'=:,.;()[]{}<>") for w in re.split(r"[\s=:]+", (before + " " + after).lower())}
    path = (path or "").lower()
    return [
        float(n),
        float(np.mean([table[a, b] for a, b in zip(codes, codes[1:], strict=False)])) if n > 1 else 0.0,
        covered(value, dictionary(vocabulary)),
        sum(c.isdigit() for c in value) / n,
        sum(c.isupper() for c in value) / n,
        -sum(p * math.log2(p) for p in count),
        sum(not c.isalnum() for c in value) / n,
        max(len(m.group(0)) for m in re.finditer(r"(.)\1*", value)) / n,
        float(all(c in "0123456789abcdef" for c in low)),
        float(value.startswith(tuple(PREFIXES))),
        float(bool(ASSIGNED.search(before)) or (after[:1] == "@" and bool(LOGIN.search(before)))),
        float(any(name in w for w in near for name in TELLING)),
        float(any(w in AGAINST for w in near)),
        float(any(w in path for w in TEST_PATHS)),
        float(before[-1:] in "\"'" and before != ""),
    ]


class Neighbours:
    """The stretches of NEAR whole words before and after a place of a text; only what lies there is read."""

    def __init__(self, text: str):
        self.text = text

    def before(self, at: int) -> str:
        reach = 256
        while True:
            low = max(0, at - reach)
            starts = [m.start() for m in TOKEN.finditer(self.text, low, at)]
            if len(starts) > NEAR:  # the first one may be cut
                return self.text[starts[-NEAR] : at]
            if not low:
                return self.text[:at]
            reach *= 4

    def after(self, at: int) -> str:
        words = list(islice(TOKEN.finditer(self.text, at), NEAR))
        return self.text[at : words[-1].end() if len(words) == NEAR else len(self.text)]


def candidates(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind of what may be a secret in a whole text."""
    given_to: dict[int, int] = {}
    for m in NAMED.finditer(text):
        v = VALUE.match(text, m.end())
        if not v:
            continue
        start, end = v.span(v.lastindex)
        if v.lastindex == 3:
            value = text[start:end]
            start += len(value) - len(value.lstrip("\"'([{"))
            end -= len(value) - len(value.rstrip(".,;:\"')]}"))
        if start < end and text[start:end].strip():
            given_to[start] = end
    for m in LOGINS.finditer(text):
        given_to[m.start(1)] = m.end(1)
    out, last = [], 0
    for start, end in sorted(given_to.items()):
        if start >= last:
            out.append((start, end, "prefix" if text.startswith(tuple(PREFIXES), start) else "assigned"))
            last = end
    starts, ends = [a for a, _, _ in out], [b for _, b, _ in out]
    near = Neighbours(text)
    for m in CANDIDATE.finditer(text):
        value = m.group(0).rstrip(".-_/")
        name = value.rstrip("=").rfind("=") + 1
        start, value = m.start() + name, value[name:]
        k = bisect_right(ends, start)
        if len(value) < 16 or (k < len(starts) and starts[k] < start + len(value)):
            continue
        prefixed = value.startswith(tuple(PREFIXES))
        both = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
        assigned = bool(ASSIGNED.search(near.before(start)))
        if prefixed or assigned or both:
            out.append((start, start + len(value), "prefix" if prefixed else "assigned" if assigned else "mixed"))
    return sorted(out)


def labelled_findings(n: int = 3000, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """(value, before, after, path, label) by rule: random values in telling places are secrets; sums, ids, names, placeholders and random values that are said to be harmless are not."""
    r = random.Random(seed)
    alnum = ALPHABET + ALPHABET.upper() + "0123456789"
    text = lambda k, of: "".join(r.choice(of) for _ in range(k))
    syllables = ["an", "er", "on", "th", "ing", "est", "ion", "ar", "de", "lo", "mi", "ra", "con", "ver", "ment", "ist", "pro", "al", "un", "ter"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(r.randint(2, 5)))
    values = [
        lambda: text(r.choice([32, 40, 48, 64]), "0123456789abcdef"),
        lambda: text(r.choice([32, 40, 64]), "0123456789ABCDEF"),
        lambda: text(r.randint(20, 60), alnum),
        lambda: text(r.randint(24, 60), alnum + "+/") + r.choice(["", "=", "=="]),
        lambda: r.choice(PREFIXES) + text(r.randint(16, 40), alnum),
    ]
    out = []
    for i in range(n):
        path = r.choice(["src/app.py", "config/settings.yml", "web", "src3", "deploy/env", "forum", "notes.txt"])
        if i % 2:
            name = r.choice(TELLING)
            name = r.choice([name, name.upper(), name.title()])
            join = r.choice([" = ", "=", ": ", " => ", '="', ' = "', ": '", ' = "'])
            out.append((r.choice(values)(), f"{prose()} {name}{join}", r.choice(['" ', "' ", " ", "\n"]) + prose(), path, 1))
            if out[-1][0].startswith(tuple(PREFIXES)) and r.random() < 0.5:
                out[-1] = (out[-1][0], prose() + " ", " " + prose(), path, 1)
            continue
        kind = r.randrange(8)
        before, after = prose() + " ", " " + prose()
        if kind == 0:
            value, before = text(r.choice([32, 40, 64]), "0123456789abcdef"), f"{prose()} {r.choice(['commit', 'sha256', 'md5', 'checksum', 'revision'])}{r.choice([' ', ': ', '='])}"
        elif kind == 1:
            value, before = "-".join(text(k, "0123456789abcdef") for k in (8, 4, 4, 4, 12)), f"{prose()} {r.choice(['uuid', 'id', 'request'])}{r.choice([' ', ': ', '='])}"
        elif kind == 2:
            value = "".join(word() for _ in range(5))[: r.randint(16, 30)] + str(r.randint(1, 99))
        elif kind == 3:
            value, before = r.choice(["x" * 20, "your_token_here_123", "0123456789abcdef", "changeme-changeme-1", "1234567890123456", "xxxx-xxxx-xxxx-0000"]), f"{prose()} {r.choice(TELLING)} = \""
        elif kind == 4:
            value = "/".join(word() for _ in range(4)) + f"/{r.randint(1, 2000)}.html"
        elif kind == 5:
            value = f"{r.randint(2000, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}T{r.randint(10, 23)}-{r.randint(10, 59)}-00Z"
        elif kind == 6:
            value, path = r.choice(values)(), r.choice(["tests/fixtures.py", "docs/example.md", "test/mock_keys.py"])
            before = f"{r.choice(['example', 'sample', 'dummy'])} {r.choice(TELLING)} = \""
        else:
            value = "_".join(word() for _ in range(r.randint(3, 5))) + f"_{r.randint(0, 99)}"
        out.append((value if len(value) >= 16 else value + "0" * (16 - len(value)), before, after, path, 0))
    return out + short_findings(n // 2, seed + 1)


def short_findings(n: int, seed: int) -> list[tuple[str, str, str, str, int]]:
    """The same for what stands after a telling name or in a URL and is short or has signs: passwords are secrets; words, names, numbers and placeholders are not."""
    r = random.Random(seed)
    letters, digits, signs = ALPHABET + ALPHABET.upper(), "0123456789", "!@#$%^&*?+-_."
    text = lambda k, of: "".join(r.choice(of) for _ in range(k))
    words = "the this of is was be see note new next last first value field page user name none null true false required change house water under about people other small order group number system table author title section between please enter your here required optional string default secret password token".split()
    prose = lambda: " ".join(r.choice(words) for _ in range(r.randint(2, 5)))

    def mixed(k: int, of: str) -> str:
        return "".join(r.sample(text(k - 2, of) + r.choice(digits) + r.choice(letters), k))

    secret = [
        lambda: mixed(r.randint(6, 15), letters + digits),
        lambda: mixed(r.randint(6, 24), letters + digits + signs),
        lambda: r.choice(words).title() + text(r.randint(1, 4), digits) + text(r.randint(1, 2), signs),
        lambda: r.choice(words).replace("a", "@").replace("o", "0").replace("s", "$").title() + text(r.randint(1, 3), digits + signs) + r.choice(digits) + r.choice("!#x"),
    ]
    harmless = [
        lambda: r.choice(words),
        lambda: r.choice(words).title(),
        lambda: text(r.randint(1, 4), digits),
        lambda: r.choice(["<secret>", "********", "...", "${TOKEN}", "{{token}}", "<token>", "os.environ", "None", "string,", "xxxxxx", "changeme", "get_token()", "self.token"]),
        prose,
    ]
    out = []
    for i in range(n):
        path = r.choice(["src/app.py", "config/settings.yml", "web", "src3", "deploy/env", "forum", "notes.txt"])
        if i % 2 and r.random() < 0.2:
            out.append((r.choice(secret)().replace("@", "!"), f"{prose()} {r.choice(['https', 'postgres', 'amqp'])}://{r.choice(words)}:", f"@{r.choice(words)}.net {prose()}", path, 1))
            continue
        name = r.choice(TELLING)
        name = r.choice([name, name.upper(), name.title()])
        before, after = f"{prose()} {name}{r.choice([' = ', '=', ': ', ':', ' => ', '=' + chr(34), ' = ' + chr(34), ': ' + chr(39)])}", " " + prose()
        if before[-1] in "\"'":
            after = before[-1] + after
        out.append((r.choice(secret if i % 2 else harmless)(), before, after, path, i % 2))
    return out


@dataclass
class Forest:
    """Trees as arrays: a row's next node is left or right by feature <= threshold; leaves have feature -1 and a value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def probability(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth + 1):
            f = self.feature[at]
            down = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
            at = np.where(f < 0, at, down)
        return self.value[at].mean(axis=1)


def grow(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, least: int = 3, cuts: int = 24, seed: int = 5) -> Forest:
    """Gini trees on bootstrap samples; each split tries the root of the number of features, at up to ``cuts`` quantiles."""
    rng = np.random.default_rng(seed)
    nodes: list[list[float]] = []
    tries = max(1, round(math.sqrt(x.shape[1])) + 1)

    def node(rows: np.ndarray, level: int) -> int:
        me = len(nodes)
        p = float(y[rows].mean())
        nodes.append([-1, 0.0, me, me, p])
        if level == depth or len(rows) < 2 * least or p in (0.0, 1.0):
            return me
        best = (p * (1 - p) * len(rows) - 1e-9, -1, 0.0)
        for f in rng.choice(x.shape[1], tries, replace=False):
            v = x[rows, f]
            edges = np.unique(np.quantile(v, np.linspace(0, 1, cuts + 2)[1:-1]))
            go = v[:, None] <= edges[None, :]
            n = go.sum(axis=0)
            k = (go & (y[rows] == 1)[:, None]).sum(axis=0)
            rest, total = len(rows) - n, int(y[rows].sum())
            cost = k * (n - k) / np.maximum(1, n) + (total - k) * (rest - total + k) / np.maximum(1, rest)
            cost = np.where((n < least) | (rest < least), np.inf, cost)
            j = int(cost.argmin())
            if cost[j] < best[0]:
                best = (float(cost[j]), int(f), float(edges[j]))
        if best[1] >= 0:
            go = x[rows, best[1]] <= best[2]
            nodes[me][0], nodes[me][1] = best[1], best[2]
            nodes[me][2] = node(rows[go], level + 1)
            nodes[me][3] = node(rows[~go], level + 1)
        return me

    roots = [node(rng.integers(0, len(y), len(y)), 0) for _ in range(trees)]
    table = np.array(nodes)
    return Forest(table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64), table[:, 4], np.array(roots), depth)


def fit(findings: list[tuple[str, str, str, str, int]] | None = None, vocabulary: str | None = None) -> Forest:
    """A forest from labelled findings, (value, before, after, path, label) each; by default those made by rule."""
    rows = findings if findings is not None else labelled_findings()
    x = np.array([describe(v, b, a, p, vocabulary) for v, b, a, p, _ in rows])
    return grow(x, np.array([label for *_, label in rows], float))


def findings_of(table: DataFrame, bound: int = BOUND) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings of a table (value, before, after, path, label) for :func:`fit`: at most ``bound`` of them, which ones a hash of the value decides.  Rows without value or label are left out; other nulls count as empty."""
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("before", "after", "path")]
    rows = table.where("value is not null and value <> '' and label is not null").select("value", *text, F.col("label").cast("int").alias("label"))
    return [tuple(r) for r in rows.orderBy(F.xxhash64("value"), "value", "before").limit(bound).collect()]


def judged(text: str, path: str | None, forest: Forest, vocabulary: str | None) -> list[tuple[int, int, str, float]]:
    """start, end, kind, score of each candidate of a whole text."""
    found = candidates(text)
    if not found:
        return []
    near = Neighbours(text)
    x = np.array([describe(text[a:b], near.before(a), near.after(b), path, vocabulary) for a, b, _ in found])
    return [(a, b, kind, float(p)) for (a, b, kind), p in zip(found, forest.probability(x), strict=True)]


def scan(docs: DataFrame, forest: Forest, vocabulary: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text, source -> one row per candidate: where it stands (characters from 0), its kind, score and verdict, and its SHA-256 in place of the value.

    source is the path; null is a path without a word.  Null and empty texts
    have no candidate; repeated rows give repeated findings; other columns are
    ignored.
    """
    tune(docs.sparkSession)
    names = [x.split()[0] for x in FINDINGS.split(",")]

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text, path in zip(batch["doc_id"], batch["text"], batch["source"], strict=True):
                for a, b, kind, p in judged(text or "", path, forest, vocabulary):
                    out.append((doc_id, a, b - a, kind, p, p >= threshold, hashlib.sha256(text[a:b].encode("utf-8", "surrogatepass")).hexdigest()))
            yield pd.DataFrame(out, columns=names)

    return returned(given(docs, "text", "source").mapInPandas(lean(run), FINDINGS))


def redact(docs: DataFrame, forest: Forest, vocabulary: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """All documents and columns, with each secret in the text replaced by MARKER; n_chars follows where it exists.  Null texts stay null, empty ones empty; repeated rows each; an empty table gives an empty table."""
    tune(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series, paths: pd.Series) -> pd.Series:
        out = []
        for text, path in zip(texts, paths, strict=True):
            if text:
                for a, b, _, p in reversed(judged(text, path, forest, vocabulary)):
                    if p >= threshold:
                        text = text[:a] + MARKER + text[b:]
            out.append(text)
        return pd.Series(out, dtype=object)

    kept = docs.withColumn("text", clean(F.col("text"), F.col("source")))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept
