"""Toxicity by a weighted lexicon and one Aho-Corasick pass over folded text.

Folding: compatibility forms, accents, look-alike letters of other scripts and digits or signs in words become the Latin
letters they stand for. The lexicon holds whole words and word beginnings; it is seeded with a fixed list, and terms and
weights are learned from labelled documents. Exception phrases cover the hits inside them. The weights that hit are
normalised by the length of the text, and a logistic curve over the normalised weight gives the score.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fitted, holdout, in_slices, kept_rows, labelled_sample

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
#: Bounds of the labelled sample that is fitted, in one task.
MOST_DOCUMENTS, MOST_BYTES = 6000, 1 << 16
#: Normalised weight that saturates: a hit of weight 3 in a text of some 200,000 characters.
ENOUGH = 0.2
#: Characters that every text has besides its own when weight is taken by the thousand.
SHORT = 200
#: Insults that need no evidence.
SEED = "idiot idiots moron morons imbecile stupid scum loser losers pathetic worthless disgusting trash clown retard bastard dumbass scumbag vermin".split()
#: Phrases in which such words are harmless.
EXCEPTIONS = "clown fish|clown car|trash can|trash bin|trash bag|trash collection|circus clown|class clown|sore loser award|stupid question|idiot proof|idiot board|loser bracket".split("|")
#: Look-alike letters of other scripts, and digits and signs, with the Latin letters they imitate.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "ø": "o", "đ": "d", "ð": "d", "ħ": "h", "ł": "l", "ŧ": "t",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "m", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}
_SIGNED = regex.compile(r"[\p{L}\d@$!|+]*[\d@$!|+][\p{L}\d@$!|+]*")
_LETTER = regex.compile(r"\p{L}")
_ODD = regex.compile(r"[^\x00-\u017F]")
_FOLD, _DIGITS = str.maketrans(LOOKALIKES), str.maketrans(DIGITS)
_SIGN = regex.compile(r"[0-9@$!|+]")
_WORD = regex.compile(r"[^\W\d_]+")
#: Accented Latin letters, U+00C0 to U+017F, and the letters below their accents.
_ACCENTED = regex.compile(r"[\u00C0-\u017F]")
_PLAIN = {c: "".join(x for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x) != "Mn").translate(_FOLD) for c in map(chr, range(0xC0, 0x180))}


def fold(text: str) -> str:
    """Lower case with look-alikes, accents, compatibility forms and substituted digits as plain letters.

    Signs around a word stay, for they mostly are punctuation; a word that may begin with a substituted sign is repeated
    with that read as a letter, after the text and a line end for each.
    """
    text = text.lower()
    if _ODD.search(text):
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not (unicodedata.category(c) in ("Mn", "Cf"))).lower().translate(_FOLD)
    text = _ACCENTED.sub(lambda m: _PLAIN[m[0]], text)
    if not _SIGN.search(text):
        return text
    also: list[str] = []

    def letters(m) -> str:
        """A word with digits or signs in it as letters; signs around it, and numbers, stay."""
        if not _LETTER.search(m[0]):
            return m[0]
        ended = m[0].rstrip("!|+$@")
        inner = ended.lstrip("!|+")
        if len(inner) < len(ended):
            also.append("\n" + ended.translate(_DIGITS))
        return ended[: len(ended) - len(inner)] + inner.translate(_DIGITS) + m[0][len(ended) :]

    text = _SIGNED.sub(letters, text)
    return text + "".join(also)


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)  # whole words
    stems: dict[str, float] = field(default_factory=dict)  # beginnings of words
    exceptions: list[str] = field(default_factory=list)
    slope: tuple[float, ...] = (-4.0, 2.0, 6.0, 0.0)  # constant, normalised weight, its saturated part, weight by the thousand characters
    _automaton: object = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for kind, terms in ((0, self.words), (1, self.stems), (2, dict.fromkeys(self.exceptions, 0.0))):
                for term, weight in terms.items():
                    self._automaton.add_word(term, [*self._automaton.get(term, []), (kind, len(term), weight)])
            self._automaton.make_automaton()
        return self._automaton

    def hits(self, text: str) -> tuple[float, int]:
        """Summed weights of the hits and their number, on folded text."""
        found, covered, automaton = {}, [], self.automaton()
        if not len(automaton):
            return 0.0, 0
        for end, entries in automaton.iter(text):
            for kind, size, weight in entries:
                start = end - size + 1
                if start and text[start - 1].isalpha():
                    continue
                if kind != 1 and end + 1 < len(text) and text[end + 1].isalpha():
                    continue
                if kind == 2:
                    covered.append((start, end))
                else:
                    found[start] = max(weight, found.get(start, weight))
        # Merged, the spans are in order and apart from each other, so the last one that begins before a hit decides.
        spans: list[list[int]] = []
        for a, b in sorted(covered):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(b, spans[-1][1])
            else:
                spans.append([a, b])
        begins = [a for a, _ in spans]
        kept = [w for at, w in found.items() if not (k := bisect_right(begins, at)) or spans[k - 1][1] < at]
        return sum(kept), len(kept)

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Weighted hits normalised by the logarithm of the text's length, that saturated, and the weight by the thousand characters."""
        if not text:
            return 0.0, 0.0, 0.0
        weight = self.hits(fold(text))[0]
        density = weight / math.log2(8 + len(text) / 6)
        return min(density, 4.0), min(1.0, density / ENOUGH), min(1000 * weight / (len(text) + SHORT), 20.0)

    def score(self, text: str | None) -> float:
        z = self.slope[0] + sum(s * f for s, f in zip(self.slope[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _terms(text: str, rate: float) -> set[tuple[str, str]]:
    """Whole words, and beginnings of 4 to 6 letters of longer words, that occur `rate` times by the thousand characters."""
    words, found = Counter(_WORD.findall(text)), Counter()
    for w, n in words.items():
        found["w", w] += n
        for k in (4, 5, 6):
            if len(w) > k:
                found["s", w[:k]] += n
    return {x for x, n in found.items() if 1000 * n >= rate * len(text)}


def fit(samples: list[tuple[str | None, int]], least: int = 5, clear: float = 3.0, rate: float = 1.2) -> Model:
    """Lexicon and curve from labelled texts; without any the seed and fixed weights serve.

    Terms are learned from toxic texts that the lexicon so far doesn't explain: again and again the one that the most of
    them share, if at least `least` do and next to no clean text has it as often. Terms rarer than `rate` by the thousand
    characters of a text do not count there, for words of insults also stand in harmless texts. Equal texts count once.
    """
    model = Model({w: 3.0 for w in SEED}, {}, list(EXCEPTIONS))
    folded = [(fold(t or ""), y) for t, y in dict(samples).items()]
    toxic, clean = ([t for t, y in folded if bool(y) == kind] for kind in (True, False))
    if not toxic or not clean:
        return model
    odds = lambda a, b: math.log((a + 0.5) / (len(toxic) + 1)) - math.log((b + 0.5) / (len(clean) + 1))
    in_toxic, in_clean = (Counter(w for t in texts for w in set(SEED).intersection(_WORD.findall(t))) for texts in (toxic, clean))
    for word in SEED:
        if in_toxic[word] + in_clean[word] >= 2 * least:
            model.words[word] = max(0.0, min(6.0, odds(in_toxic[word], in_clean[word])))
    open_texts = [_terms(t, rate) for t in toxic if model.hits(t)[0] < 1.0]
    shared = {x for x, n in Counter(x for terms in open_texts for x in terms).items() if n >= least}
    seen = Counter(x for t in clean for x in _terms(t, rate) & shared) if shared else Counter()
    shared = {x for x in shared if odds(sum(x in terms for terms in open_texts), seen[x]) >= clear}
    while open_texts:
        counts = Counter(x for terms in open_texts for x in terms & shared)
        # Of equal terms the longest beginning, which says the most.
        term, n = max(counts.items(), key=lambda c: (c[1], len(c[0][1]), c[0]), default=(None, 0))
        if n < least:
            break
        (model.words if term[0] == "w" else model.stems)[term[1]] = min(6.0, odds(n, seen[term]))
        open_texts = [terms for terms in open_texts if term not in terms]
    model._automaton = None
    x = np.array([(1.0, *model.features(t)) for t in dict(samples)])
    y = np.array([float(y > 0) for _, y in folded])
    w, ridge = np.zeros(x.shape[1]), 0.02
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ x @ w + ridge / 2 * w @ w
    for _ in range(60):  # Newton's method, with shorter steps where one overshoots
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        size = next((0.5**k for k in range(12) if loss(w + 0.5**k * step) < loss(w)), 0.0)
        if not size:
            break
        w = w + size * step
    model.slope = tuple(float(v) for v in w)
    return model


def train(documents: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1) -> Model:
    """Fits on at most MOST_DOCUMENTS labelled texts outside the held-out fold."""
    return fitted(labelled_sample(documents, labels, "toxic", ~holdout("doc_id", modulus, remainder), MOST_DOCUMENTS, MOST_BYTES), fit)


def score(documents: DataFrame, model: Model, threshold: float = 0.7, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """One row a document with its score and whether it is predicted toxic.

    Null and empty texts have no hits and take the curve's lowest score. Repeated rows keep a row each; a null id counts
    as not held out; an empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            scores = [model.score(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], [f.split()[0] for f in SCHEMA.split(", ")])

    return documents.select("doc_id", holdout("doc_id", modulus, remainder).alias("held_out"), "text").mapInArrow(run, SCHEMA)


def keep_clean(documents: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows that are not predicted toxic, each judged by its own text, with all their columns."""
    return kept_rows(documents, lambda texts: [model.score(t.as_py()) < threshold for t in texts])
