"""Personal data: fixed patterns, and a skip-chain conditional random field that adds spans.

Nodes of the field are the tokens that hold a digit, an @ or a + ; every other token has the
label "other" and no node. A node has hashed shape features. Neighbouring nodes share a chain potential; a token
that occurs again (equal, or similar: same mail domain, same leading digits) shares a skip potential with its next
occurrence, so a document has at most two skip links a node. Loopy belief propagation makes the labels of a document agree.

The weights are fitted by pseudo-likelihood, with the spans of the fixed patterns as labels, on at most
``SAMPLE`` different texts, those of least hash, so copies of a text don't change the sample. Without any such document no span is added. A token whose label is
not "other" with probability ``MIN_BELIEF`` adds a span, unless a base span overlaps it.

Null and empty texts have no spans. Repeated rows give repeated results, extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlake.llm.common import least_different, map_texts

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
SAMPLE = 2_000
SAMPLE_CHARS = 20_000
MIN_BELIEF = 0.9
ROUNDS = 8
BITS = 12

# The patterns of the base spans, written so that no start is tried twice.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\S+")
_TRIM = "\"'.,;:!?()[]{}<>|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number from 0, end) of the fixed patterns."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(d := p.lstrip("0")) <= 3 and int(d or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return out


def nodes(text: str) -> list[tuple[int, int, str]]:
    """(start, end, token) of the tokens that may be part of personal data, without outer punctuation."""
    if not (_DIGIT.search(text) or "@" in text or "+" in text):
        return []
    out = []
    for m in _TOKEN.finditer(text):
        token = m[0]
        if "@" in token or "+" in token or _DIGIT.search(token):
            cut = token.lstrip(_TRIM)
            start = m.end() - len(cut)
            cut = cut.rstrip(_TRIM)
            if cut:
                out.append((start, start + len(cut), cut))
    return out


def shape(token: str) -> str:
    """Runs of digits and letters with their lengths (up to six), other characters as they are."""
    return re.sub(r"[0-9]+|[^\W\d_]+", lambda m: ("9" if m[0][0].isdigit() else "a") + str(min(len(m[0]), 6)), token)[:60]


def features(token: str) -> list[int]:
    digits = len(_DIGIT.findall(token))
    names = [
        f"s{shape(token)}", f"k{re.sub('[0-9]+', '', shape(token))[:20]}", f"d{min(digits, 24)}", f"@{token.count('@')}",
        f".{min(token.count('.'), 4)}", f"+{token[0] == '+'}", f"-{min(token.count('-'), 4)}", f"a{any(c.isalpha() for c in token)}", "bias",
    ]
    return [xxhash.xxh64_intdigest(n) >> (64 - BITS) for n in names]


def likeness_keys(token: str) -> list[str]:
    """Tokens with a key in common are equal (first key) or similar (second)."""
    keys = ["=" + token.lower()]
    if "@" in token:
        keys.append("@" + token.lower().rpartition("@")[2])
    elif len(d := "".join(_DIGIT.findall(token))) >= 6:
        keys.append(f"#{d[:6]}")
    return keys


def edges(tokens: list[str]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(chain links, skip links) between the nodes of a document; a skip link leads to the next occurrence."""
    seen: dict[str, int] = {}
    skip = set()
    for i, token in enumerate(tokens):
        for key in likeness_keys(token):
            if key in seen and seen[key] != i - 1:
                skip.add((seen[key], i))
            seen[key] = i
    return [(i, i + 1) for i in range(len(tokens) - 1)], sorted(skip)


class Field:
    """Weights of the field: unary (features x labels), and one symmetric-in-use table for each kind of link."""

    def __init__(self):
        self.unary = np.zeros((2**BITS, len(LABELS)))
        self.links = [np.zeros((len(LABELS), len(LABELS))) for _ in range(2)]

    def fit(self, texts: list[str], epochs: int = 60, rate: float = 0.5, ridge: float = 1e-3) -> Field:
        """Pseudo-likelihood: every node given the labels of its neighbours, by AdaGrad."""
        feats, labels, pairs, offset = [], [], ([], []), 0
        for text in texts:
            found = nodes(text)
            base = base_spans(text)
            labels += [next((k + 1 for a, k, b in base if a < e and b > s), 0) for s, e, _ in found]
            feats += [features(t) for _, _, t in found]
            for kind, links in enumerate(edges([t for *_, t in found])):
                pairs[kind].extend((a + offset, b + offset) for a, b in links)
            offset += len(found)
        if not feats:
            return self
        x, y = np.array(feats), np.array(labels)
        hot = np.eye(len(LABELS))[y]
        squares = [np.full(w.shape, 1e-6) for w in (self.unary, *self.links)]
        pairs = [np.array(p, np.int64).reshape(-1, 2) for p in pairs]
        for _ in range(epochs):
            scores = self.unary[x].sum(axis=1)
            for w, p in zip(self.links, pairs):
                np.add.at(scores, p[:, 1], w[y[p[:, 0]]])
                np.add.at(scores, p[:, 0], w.T[y[p[:, 1]]])
            prob = np.exp(scores - scores.max(axis=1, keepdims=True))
            gap = hot - prob / prob.sum(axis=1, keepdims=True)
            grad = np.zeros_like(self.unary)
            np.add.at(grad, x.ravel(), np.repeat(gap, x.shape[1], axis=0))
            grads = [grad]
            for p in pairs:
                g = np.zeros((len(LABELS), len(LABELS)))
                np.add.at(g, y[p[:, 0]], gap[p[:, 1]])
                back = np.zeros_like(g)
                np.add.at(back, y[p[:, 1]], gap[p[:, 0]])
                grads.append(g + back.T)
            for w, g, s in zip((self.unary, *self.links), grads, squares):
                g = g / len(y) - ridge * w
                s += g * g
                w += rate * g / np.sqrt(s)
        return self

    def beliefs(self, tokens: list[list[str]]) -> np.ndarray:
        """Label probabilities of all nodes of some documents, by loopy message passing."""
        flat = [t for doc in tokens for t in doc]
        if not flat:
            return np.zeros((0, len(LABELS)))
        unary = self.unary[np.array([features(t) for t in flat])].sum(axis=1)
        pairs, offset = ([], []), 0
        for doc in tokens:
            for kind, links in enumerate(edges(doc)):
                pairs[kind].extend((a + offset, b + offset) for a, b in links)
            offset += len(doc)
        both = [np.array(p, np.int64).reshape(-1, 2) for p in pairs]
        # Every link carries one message each way: forward ones first, then backward ones.
        src = np.concatenate([p[:, 0] for p in both] + [p[:, 1] for p in both])
        dst = np.concatenate([p[:, 1] for p in both] + [p[:, 0] for p in both])
        table = np.concatenate(
            [np.broadcast_to(w, (len(p), *w.shape)) for w, p in zip(self.links, both)]
            + [np.broadcast_to(w.T, (len(p), *w.shape)) for w, p in zip(self.links, both)]
        )
        n = len(src) // 2
        back = np.concatenate((np.arange(n, 2 * n), np.arange(n)))
        message = np.zeros((2 * n, len(LABELS)))
        total = unary.copy()
        for _ in range(ROUNDS if n else 0):
            given = total[src] - message[back]
            fresh = np.logaddexp.reduce(given[:, :, None] + table, axis=1)
            message = 0.5 * message + 0.5 * (fresh - fresh.max(axis=1, keepdims=True))
            total = unary.copy()
            np.add.at(total, dst, message)
        prob = np.exp(total - total.max(axis=1, keepdims=True))
        return prob / prob.sum(axis=1, keepdims=True)


def spans(texts: list[str], field: Field) -> list[list[tuple[int, int, int, bool]]]:
    """(start, kind, end, base) of base spans and of those that the field adds, by start, then kind."""
    found = [nodes(t) for t in texts]
    belief = field.beliefs([[t for *_, t in f] for f in found])
    best, sure = belief.argmax(axis=1), belief.max(axis=1)
    out, at = [], 0
    for text, tokens in zip(texts, found):
        base = base_spans(text)
        more, reach, i = [], -1, 0
        ordered = sorted(base)
        for n, (s, e, _) in enumerate(tokens, at):
            # Base spans that start before this token ends; the furthest end tells of an overlap.
            while i < len(ordered) and ordered[i][0] < e:
                reach = max(reach, ordered[i][2])
                i += 1
            if best[n] and sure[n] >= MIN_BELIEF and reach <= s:
                more.append((s, int(best[n]) - 1, e, False))
        at += len(tokens)
        out.append(sorted([(*b, True) for b in base] + more))
    return out


def learn(documents: DataFrame, text_col: str = "text", size: int = SAMPLE) -> Field:
    """Fit the field on at most ``size`` different texts that hold an @, a + or a digit.

    Of a text the sample takes the words up to three away from such a word, ``SAMPLE_CHARS`` characters at most.
    """
    rows = documents.filter(F.col(text_col).rlike("[0-9@+]"))
    words = F.regexp_extract_all(text_col, F.lit(r"\S++\s*+"), F.lit(0))
    marked = F.transform(words, lambda w: F.struct(w.alias("w"), w.rlike("[0-9@+]").alias("hit")))

    def near(m: Column) -> Column:
        beside = lambda i: F.slice(m, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3)) + 4)
        kept = F.transform(m, lambda x, i: F.when(F.exists(beside(i), lambda y: y["hit"]), x["w"]))
        return F.array_join(F.filter(kept, lambda w: w.isNotNull()), "")

    # The words are bound to a variable: an expression inside a lambda is worked out again for every element.
    cut = F.substring(F.transform(F.array(marked), near)[0], 1, SAMPLE_CHARS)
    return Field().fit(least_different(rows, F.col(text_col), cut, size))


def scan(documents: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and found: array of (kind, start, end, base) by start, then kind; code points, end exclusive."""
    shared = documents.sparkSession.sparkContext.broadcast(field)
    item = T.StructType(
        [
            T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType()),
        ]
    )

    def run(texts: list[str]) -> list[pa.Array]:
        rows = [
            [{"kind": KINDS[k], "start": a, "end": b, "base": own} for a, k, b, own in found]
            for found in spans(texts, shared.value)
        ]
        kinds = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
        return [pa.array(rows, pa.list_(kinds))]

    slim = documents.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    found = map_texts(slim, "__text", [T.StructField("found", T.ArrayType(item))], run)
    return found.withColumnRenamed("__id", id_col)
