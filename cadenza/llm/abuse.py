"""Abusive, hateful or sexual content (problem 8): boosted trees over dense features of passages, calibrated by isotonic regression."""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A short general lexicon, starts of words by kind in English, German, French and Spanish, without accents. It is not
#: fitted to any table; what a corpus says in its own words is learned from its judgements (see Learned).
LEXICON = {
    "insult": """idiot moron imbecil stupid dumb loser scum pathetic worthless disgusting coward bastard bitch asshole whore slut retard
        dumm trottel depp arschloch hurensohn wichser schlampe abschaum versager
        connard connasse salope pute abruti ordure cretin encul
        estupid tont cabron puta gilipoll basura escoria asqueros""",
    "harm": """kill murder strangl stab rape choke shoot hang
        umbring erschlag erschiess verreck erwurg
        tuer creve etrangl egorg
        matar muerete ahorc degoll""",
    "group": """subhuman vermin cripple foreigner immigrant
        untermensch ungeziefer auslander kruppel
        vermine etranger infirme
        alimana extranjer tullid""",
    "sexual": """naked nude nipple tits cock pussy dick fuck porn orgasm horny
        nackt titten schwanz fick muschi geil
        nichon bite baise seins
        tetas polla follar desnud""",
}
#: Words of the second and the first person.
YOU = "you your yours yourself du dich dir dein deine deinen deiner deinem tu te toi ton ta tes vous ti tus usted eres"
ME = "i me my mine myself ich mich mir mein meine je moi mon ma mes yo mi mis soy"
KINDS = tuple(LEXICON)
#: Letters of other scripts and signs that stand for Latin letters.
LOOKALIKE = str.maketrans("аеорсухіјѕԁмткнвαερουικν", "aeopcyxijsdmtkhbaepouikv")
SIGNS = str.maketrans("0134578@$!|+€", "oieastbasilte")
_FOREIGN = re.compile("[Ͱ-ԯ]")
_ZERO = re.compile("[­᠎​-‏‪-‮⁠-⁤﻿]")
_TAG = re.compile(r"<[^<>]{1,60}>|&[a-z]{2,6};")
_SPELLED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][ .\-_*·]{1,2}){2,}[^\W\d_](?![^\W\d_])")
_SINGLE = re.compile(r"[ .\-_*·][^\W\d_][ .\-_*·]{1,2}[^\W\d_](?![^\W\d_])")  # in every word spelled out
_INNER = re.compile(r"[.\-_*·'’|/\\](?<=[^\W_].)[.\-_*·'’|/\\]*(?=[^\W_])")
_SIGN = re.compile(r"[\d@$!|+€](?:(?<=\d)(?:(?<=[^\W\d_].)|(?=[^\W\d_]))|(?<=\D)(?=\w)(?:(?<=\w.)|(?=[^\W\d_])))")  # next to a letter
_RUN = re.compile(r"([a-z])\1\1+")
_WORD = re.compile(r"[^\W_]+")
_UNIT = re.compile(r"[^\W_]+|\n")
_BREAK = re.compile(r"(?<=[.!?…])\s+|\n+")
_BROKEN = re.compile("[ÃÂâ][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")
_ACCENT = re.compile("[̀-ͯ]")


def plain(text: str) -> tuple[str, str, list[int]]:
    """(raw, bare, hidden): the whole text and its one plain spelling, a passage per line, and how many signs of each hide words.

    Markup, broken encoding, zero-width signs, look-alike letters, words spelled out or cut by signs, signs for letters, drawn-out letters and
    accents are undone; both texts have the same number of lines.
    """
    if _BROKEN.search(text):
        try:
            text = text.encode("cp1252").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            pass
    raw = text if text.isascii() else unicodedata.normalize("NFKC", text)
    if "<" in raw or "&" in raw:
        raw = _TAG.sub(" ", raw)
    raw = _BREAK.sub("\n", raw).replace("\r", " ")
    clean = raw if raw.isascii() else _ZERO.sub("", raw)
    low = clean.lower()
    latin = low.translate(LOOKALIKE) if not low.isascii() and _FOREIGN.search(low) and re.search("[a-z]", low) else low
    base = latin if latin.isascii() else _ACCENT.sub("", unicodedata.normalize("NFKD", latin.replace("ß", "ss")))
    x = _SPELLED.sub(lambda m: "".join(_WORD.findall(m[0])), base) if _SINGLE.search(base) else base
    x = _SIGN.sub(lambda m: m[0].translate(SIGNS), _INNER.sub("", x))
    x = _RUN.sub(r"\1", x)
    hidden = [max(0, len(a) - len(b)) for a, b in zip(base.split("\n"), x.split("\n"))]
    if clean is not raw or latin is not low:
        hidden = [h + len(r) - len(c) + sum(map(str.__ne__, a, b)) for h, r, c, a, b in zip(hidden, raw.split("\n"), clean.split("\n"), low.split("\n"), latin.split("\n"))]
    return raw, x, hidden


class _Words(dict):
    """word -> number; for each number a hash of the word and of its start, and in bits which lists it is in."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.hash, self.start, self.bits = [0], [0], [0]
        self["\n"] = 0

    def __missing__(self, w: str) -> int:
        h = lambda s: int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        self.hash.append(h(w))
        self.start.append(h(f"{w[:5]}*") if len(w) > 5 else 0)
        self.bits.append(sum(1 << i for i, p in enumerate(_STARTS) if p.match(w)) | (w in _YOU) << 4 | (w in _ME) << 5)
        self[w] = n = len(self.hash) - 1
        return n


_STARTS = [re.compile("|".join(sorted(LEXICON[k].split(), key=len, reverse=True))) for k in KINDS]
_YOU, _ME = frozenset(YOU.split()), frozenset(ME.split())
_words = _Words()
_classes: list[np.ndarray] = []


def _kinds_of_signs() -> np.ndarray:
    """For each sign of the basic plane: 1 letter, 2 capital, 4 neither letter, digit nor blank."""
    if not _classes:
        s = [chr(i) for i in range(1 << 16)]
        _classes.append(np.array([c.isalpha() + 2 * c.isupper() + 4 * (not (c.isalnum() or c.isspace())) for c in s], np.uint8))
    return _classes[0]


@dataclass
class Passages:
    """Passages of documents as flat arrays: per passage its document, capitals, punctuation, obfuscation and words; per word its passage, hashes and lists."""

    docs: int
    doc: np.ndarray
    shape: np.ndarray  # passages x (capitals, punctuation, obfuscation)
    count: np.ndarray
    at: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, texts: Sequence[str | None]) -> Passages:
        """Every passage with a word, of the whole texts."""
        if len(_words) > 2_000_000:
            _words.clear()
        got = [plain(t) if t else ("", "", [0]) for t in texts]
        raw = "".join(f"{g[0]}\n" for g in got)
        code = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), "<u4")
        sign = np.where(code < 1 << 16, _kinds_of_signs()[np.minimum(code, (1 << 16) - 1)], 1)
        ends = np.flatnonzero(code == 10)
        begin = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        upto = lambda b: np.concatenate([[0], np.cumsum((sign & b) > 0)])
        letters, caps, other = ((c := upto(b))[ends] - c[begin] for b in (1, 2, 4))
        n = [len(g[2]) for g in got]
        doc = np.repeat(np.arange(len(got)), n)
        hidden = np.fromiter((h for g in got for h in g[2]), float, len(doc))
        shape = np.stack([caps / np.maximum(letters, 1), other / np.maximum(ends - begin, 1), hidden / np.maximum(ends - begin, 1)], 1)
        ids = np.fromiter(map(_words.__getitem__, _UNIT.findall("".join(f"{g[1]}\n" for g in got))), np.int64)
        line = np.cumsum(ids == 0) - (ids == 0)
        ids, line = ids[ids > 0], line[ids > 0]
        count = np.bincount(line, minlength=len(doc))
        keep = count > 0
        new = np.cumsum(keep) - 1
        look = lambda v, t: np.array(v, t)[ids]
        return cls(len(got), doc[keep], shape[keep], count[keep], new[line], look(_words.hash, np.uint64), look(_words.start, np.uint64), look(_words.bits, np.uint8))

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """(key, passage) of every word, start of a word, and run of two and three words."""
        h, at = self.hash, self.at
        with np.errstate(over="ignore"):
            two = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
            three = two[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] if len(h) > 2 else h[:0]
        in2, in3, long = at[:-1] == at[1:], at[:-2] == at[2:], self.start > 0
        return np.concatenate([h, self.start[long], two[in2], three[in3] if len(three) else three]), np.concatenate([at, at[long], at[:-1][in2], at[:-2][in3] if len(three) else at[:0]])


class Learned:
    """Log-odds of grams in passages that are abusive, from judged documents; looked up in a sorted table."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray) -> None:
        o = np.argsort(keys)
        self.keys, self.weights = keys[o], weights[o].astype(np.float32)
        self.seen = np.zeros(1 << 18, bool)
        self.seen[(self.keys >> np.uint64(46)).astype(np.int64)] = True

    def of(self, key: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key), np.float32)
        if len(self.keys):
            at = np.flatnonzero(self.seen[(key >> np.uint64(46)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.keys, key[at]), len(self.keys) - 1)
            out[at] = np.where(self.keys[place] == key[at], self.weights[place], 0)
        return out


#: Features of a passage; a document has the greatest of each, those of its likeliest passage, and the last four of its own.
PASSAGE = (*KINDS, "you", "near_you", "me", "capitals", "punctuation", "obfuscation", "learned_mean", "learned_sum", "learned_top", "words")
FEATURES = [*[f"max_{f}" for f in PASSAGE], *[f"top_{f}" for f in PASSAGE], "hit_density", "you_density", "passages", "capitals_all"]


def likelihood(w: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """How likely each of ``n`` passages is abusive by its grams' weights: their sum, damped by how many there are."""
    return np.bincount(at, w, n) / np.sqrt(np.bincount(at, minlength=n) + 8.0)


def features(p: Passages, learned: Learned) -> np.ndarray:
    """Documents x FEATURES; all 0 for a text without words."""
    out = np.zeros((p.docs, len(FEATURES)))
    n = len(p.doc)
    if not n:
        return out
    per = lambda mask: np.bincount(p.at[mask], minlength=n)
    has = [(p.bits >> i & 1).astype(bool) for i in range(6)]
    hit = (p.bits & 15) > 0
    near = np.zeros(n)
    you, hits = np.flatnonzero(has[4]), np.flatnonzero(hit)
    if len(you) and len(hits):
        place = np.searchsorted(you, hits)
        for side in (np.maximum(place - 1, 0), np.minimum(place, len(you) - 1)):
            ok = p.at[you[side]] == p.at[hits]
            np.maximum.at(near, p.at[hits[ok]], 1 / (1 + np.abs(hits[ok] - you[side][ok])))
    key, at = p.grams()
    w = learned.of(key)
    top = np.zeros(n)
    np.maximum.at(top, at, w)
    total = likelihood(w, at, n)
    f = np.stack([*[per(has[i]) for i in range(4)], per(has[4]), near, per(has[5]), *p.shape.T, np.bincount(at, w, n) / np.bincount(at, minlength=n), total, top, p.count], 1).astype(float)
    first = np.flatnonzero(np.diff(p.doc, prepend=-1))
    own = p.doc[first]
    k = len(PASSAGE)
    out[own, :k] = np.maximum.reduceat(f, first, axis=0)
    likely = total + 0.5 * (f[:, :4].sum(1) > 0) + 0.5 * near
    order = np.lexsort((-likely, p.doc))
    out[own, k : 2 * k] = f[order[first]]
    add = lambda v: np.add.reduceat(v, first)
    words = add(f[:, -1])
    out[own, 2 * k :] = np.stack([add(f[:, :4].sum(1)) / words, add(f[:, 4]) / words, np.log1p(add(np.ones(n))), add(p.shape[:, 0] * f[:, -1]) / words], 1)
    return out


def learn(p: Passages, y: np.ndarray, fold: np.ndarray, folds: int, rounds: int = 3, least: int = 2, prior: float = 1.0) -> list[Learned]:
    """Learned tables for each fold, from the other folds' documents, and a last one from all.

    Only documents are judged, not passages. So first every passage of a judged document counts as it; then, ``rounds`` times, of a flagged
    document only its likeliest passage by the weights so far (of other folds) counts as abusive, and all passages of documents not flagged as not.
    """
    key, at = p.grams()
    uniq, key = np.unique(key, return_inverse=True)
    pair = np.unique(at * len(uniq) + key) if len(uniq) else np.empty(0, np.int64)  # each gram once in a passage
    at, key = pair // max(len(uniq), 1), pair % max(len(uniq), 1)
    doc_y, doc_fold = y[p.doc] > 0, fold[p.doc]
    unit = np.ones(len(p.doc))  # how much each passage counts
    tables: list[Learned] = []
    for r in range(rounds + 1):
        counts = np.zeros((2, folds, len(uniq)))
        mass = np.zeros((2, folds))
        for v in (0, 1):
            for k in range(folds):
                own = (doc_fold == k) & (doc_y == bool(v)) & (unit > 0)
                g = own[at]
                counts[v, k] = np.bincount(key[g], minlength=len(uniq))
                mass[v, k] = own.sum()
        tables = []
        score = np.zeros(len(p.doc))
        for k in [*range(folds), None]:
            neg, pos = (c.sum(0) - (0 if k is None else c[k]) for c in counts)
            m0, m1 = (max(m.sum() - (0 if k is None else m[k]), 1.0) for m in mass)
            rate = float(np.clip(m1 / (m0 + m1), 0.01, 0.99))
            q = (pos + prior * rate) / (pos + neg + prior)
            w = np.clip(np.log(q / (1 - q)) - np.log(rate / (1 - rate)), -4, 4)
            w[(pos + neg < least) | (np.abs(w) < 0.3)] = 0
            tables.append(Learned(uniq[w != 0], w[w != 0]))
            if k is not None and r < rounds:
                g = (doc_fold == k)[at]
                score += likelihood(w[key[g]], at[g], len(p.doc))
        if r < rounds:
            best = np.full(p.docs, -np.inf)
            np.maximum.at(best, p.doc, score)
            unit = np.where(doc_y, score >= best[p.doc], 1.0)
    return tables


@dataclass
class Trees:
    """Gradient-boosted regression trees of the logistic loss on binned features, in flat arrays."""

    cuts: list[np.ndarray]
    base: float
    rate: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # feature, bin, value of each node of a full tree

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: int = 12, ridge: float = 2.0) -> Trees:
        """Level by level: one histogram of a level's nodes, features and bins gives all splits at once."""
        if not len(y):
            return cls([np.empty(0)] * x.shape[1], 0.0, rate, [])
        m = x.shape[1]
        self = cls([np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T], float(np.log((y.sum() + 1) / ((1 - y).sum() + 1))), rate, [])
        b = self._bins(x)
        cell = b + np.arange(m) * bins
        raw = np.full(len(y), self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), int)
            feat, at, val = np.full(2 ** (depth + 1) - 1, -1), np.zeros(2 ** (depth + 1) - 1, int), np.zeros(2 ** (depth + 1) - 1)
            for level in range(depth + 1):
                low, wide = 2**level - 1, 2**level
                live = node >= low
                k = node[live] - low
                sg, sh, sn = (np.bincount(k, v, wide) for v in (g[live], h[live], np.ones(live.sum())))
                val[low : low + wide] = sg / (sh + ridge)
                if level == depth:
                    break
                place = (cell[live] + (k * m * bins)[:, None]).ravel()
                hist = lambda v: np.cumsum(np.bincount(place, v, wide * m * bins).reshape(wide, m, bins), axis=2)[:, :, :-1]
                n, cg, ch = hist(None), hist(np.repeat(g[live], m)), hist(np.repeat(h[live], m))
                tg, th, tn = sg[:, None, None], sh[:, None, None], sn[:, None, None]
                gain = np.where((n >= least) & (tn - n >= least), cg**2 / (ch + ridge) + (tg - cg) ** 2 / (th - ch + ridge) - tg**2 / (th + ridge), 0).reshape(wide, -1)
                best = gain.argmax(1)
                split = gain[np.arange(wide), best] > 1e-6
                feat[low : low + wide], at[low : low + wide] = np.where(split, best // (bins - 1), -1), best % (bins - 1)
                f = feat[node]
                go = live & (f >= 0)
                node[go] = 2 * node[go] + 2 - (b[np.flatnonzero(go), f[go]] <= at[node[go]])
            self.trees.append((feat, at, val))
            raw += rate * val[node]
        return self

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T)], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, out, rows = self._bins(x), np.full(len(x), self.base), np.arange(len(x))
        for feat, at, val in self.trees:
            node = np.zeros(len(x), int)
            while (inner := feat[node] >= 0).any():
                f = np.where(inner, feat[node], 0)
                node = np.where(inner, np.where(b[rows, f] <= at[node], 2 * node + 1, 2 * node + 2), node)
            out += self.rate * val[node]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps of least squares through (score, y) by pooling violators: (mean scores, probabilities), the knots of the calibration."""
    o = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of y, weight, sum of scores
    for s, v in zip(score[o], y[o]):
        blocks.append([float(v), 1.0, float(s)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], a)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([(b[0] + 0.5) / (b[1] + 1) for b in blocks])


@dataclass
class Model:
    learned: Learned
    trees: Trees
    steps: tuple[np.ndarray, np.ndarray]

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        return self.probability(features(Passages.of(texts), self.learned))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.raw(x), *self.steps) if len(self.steps[0]) else np.full(len(x), 0.0)


def fit(texts: Sequence[str], labels: np.ndarray, folds: int = 5) -> Model:
    """Trees, learned lexicon and calibration from labelled texts; everything a text's own label could leak into is made from other folds.

    Texts that begin alike (copies, edits) are in one fold.
    """
    p = Passages.of(list(texts))
    y = np.asarray(labels, float)
    fold = np.array([zlib.crc32(" ".join(_WORD.findall(plain(t or "")[1])[:6]).encode("utf-8", "surrogatepass")) % folds for t in texts], int)
    tables = learn(p, y, fold, folds)
    x = np.zeros((len(y), len(FEATURES)))
    for k in range(folds):
        own = fold == k
        if own.any():
            x[own] = features(p, tables[k])[own]
    out = np.zeros(len(y))
    for k in range(folds):
        if (fold == k).any() and (fold != k).any():
            out[fold == k] = Trees.fit(x[fold != k], y[fold != k]).raw(x[fold == k])
    return Model(tables[-1], Trees.fit(x, y), isotonic(out, y))


def labelled(docs: DataFrame, labels: DataFrame, most: int = 8000) -> pd.DataFrame:
    """(text, y): up to about ``most`` judged documents, by hash, with the majority of their raters' distinct judgements.

    The bound is on the classifier's training sample only. Ties count as flagged; null judgements don't count.
    """
    j = labels.where("flagged in (0, 1)").select("doc_id", "rater", "flagged").distinct().groupBy("doc_id").agg((F.avg("flagged") >= 0.5).cast("int").alias("y"))
    n = j.count()
    if n > most:
        j = j.where(F.pmod(F.xxhash64(F.lit("labelled"), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    return docs.select("doc_id", "text").join(j, "doc_id").select("text", "y").toPandas()


def score(docs: DataFrame, model: Model, keep: Sequence[str]) -> DataFrame:
    """(<keep>, score, flagged): the calibrated probability that the document has such a passage; flagged from 0.5 on.

    Whole texts are read. Null, empty and wordless texts score by the features of an empty text.
    """
    b = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = b.value
        for pdf in batches:
            p = m.score(pdf["__text"].tolist())
            yield pdf.drop(columns="__text").assign(score=p, flagged=p >= 0.5)

    return docs.select(*keep, F.col("text").alias("__text")).mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keep) + ", score double, flagged boolean")
