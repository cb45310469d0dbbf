"""Language ID by a linear-chain conditional random field over the words of a text.

Every word is a position of the chain and every language a label. Features of a word are its affixes, its character
n-grams, its own form (lexicon) and its shape; labels of neighbouring words are tied by learned transitions, so a text
may switch language and each word still gets its marginal probability by forward-backward.
"""

from __future__ import annotations

import functools
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlight.llm.common import blocks, columns, crc_fold, resident, texts_of
from weftlight.llm.pretokens import Cache

#: Buckets of hashed features, training texts for each language, passes over them.
BUCKETS, TEXTS, EPOCHS = 1 << 16, 250, 6
#: Texts of at most so many characters are preferred for training, which bounds what comes to the driver.
TEXT_CHARS = 8000
#: A text of at least so many words in which the likeliest language has less than this share is in no language of the model.
LEAST_SHARE, LEAST_WORDS = 0.4, 8
#: Label of a text without letters.
UNKNOWN = "und"
_ASCII_TOKEN = re.compile(r"[A-Za-z]+(?:'[A-Za-z]+)*")
_TOKEN = regex.compile(r"\p{L}+(?:['’]\p{L}+)*")


def tokens(text: str) -> list[str]:
    """Runs of letters (Unicode's categories L) with inner apostrophes; numerals of any kind are none."""
    return _ASCII_TOKEN.findall(text) if text.isascii() else _TOKEN.findall(text)


def _hashed(parts: list[np.ndarray], salt: int) -> np.ndarray:
    h = np.full(len(parts[0]), salt * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for p in parts:
        h = (h ^ p) * np.uint32(2654435761)
        h ^= h >> np.uint32(15)
    return h & np.uint32(BUCKETS - 1)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every feature: bias, form, shape, affixes and n-grams of one to three characters, ends marked."""
    n = len(words)
    low = [w.lower() for w in words]
    code = np.frombuffer("".join([f"^{w}$" for w in low]).encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, low), np.int64, n)
    end = np.cumsum(size + 2)
    start = end - size - 2
    owner = np.repeat(np.arange(n), size + 2)
    left = end[owner] - np.arange(len(code))  # characters from here to the closing mark, it included
    every = np.arange(n)
    shape = np.array([2 if w.isupper() else 1 if w.islower() else 0 for w in words], np.uint32)
    form = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in low], np.uint32)
    words_of, buckets = [every, every, every], [np.zeros(n, np.uint32), _hashed([shape], 1), _hashed([form], 2)]
    for k in (1, 2, 3):
        at = np.flatnonzero(left >= k)
        words_of.append(owner[at])
        buckets.append(_hashed([code[at + j] for j in range(k)], 10 + k))
        long = np.flatnonzero(size >= k)
        for kind, first in ((20, start[long] + 1), (30, end[long] - 1 - k)):
            words_of.append(long)
            buckets.append(_hashed([code[first + j] for j in range(k)], kind + k))
    return np.concatenate(words_of), np.concatenate(buckets).astype(np.int64)


@dataclass
class Crf:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x L
    transitions: np.ndarray  # L x L

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.languages)), np.float32)
        owner, bucket = word_features(words)
        n = len(words)
        scale = 1 / np.sqrt(np.bincount(owner, minlength=n))
        return np.stack([np.bincount(owner, self.weights[bucket, j], n) * scale for j in range(len(self.languages))], axis=1).astype(np.float32)


def forward_backward(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray, width: int = 2048, messages: bool = False):
    """Marginals (n, L) of chains laid end to end; `first` marks where a chain begins.

    With messages also the forward messages and the backward ones times the scores' exponentials, for pair marginals.

    The whole row is cut into equal segments that advance in step. A first pass multiplies each segment's matrices, so
    the message that enters every segment is known exactly; a second passes messages forward and backward. The work per
    word is a few array operations whatever the lengths of the chains.
    """
    n, k = scores.shape
    if not n:
        return np.zeros((0, k))
    steps = -(-n // max(1, min(width, n // 64 or 1)))
    segments = -(-n // steps)
    pad = steps * segments - n
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    e = np.concatenate([e, np.ones((pad, k))]).reshape(segments, steps, k)
    start = np.concatenate([first, np.ones(pad, bool)]).reshape(segments, steps)
    t = np.exp(transitions - transitions.max())
    # alpha' = (alpha t, or its sum spread evenly where a chain begins) * e
    even = np.full((k, k), 1.0 / k)

    def into(s, m):
        """m (.., k) carried over the edge into position s of every segment."""
        out = m @ t
        begin = start[:, s]
        if begin.any():
            out[begin] = m[begin] @ even
        return out

    def back(s, m):
        out = m @ t.T
        begin = start[:, s]
        if begin.any():
            out[begin] = m[begin] @ even
        return out

    def normal(m):
        return m / m.sum(axis=tuple(range(1, m.ndim)), keepdims=True)

    fwd = np.broadcast_to(np.eye(k), (segments, k, k)).copy()
    for s in range(steps):
        fwd = normal(into(s, fwd) * e[:, s, None, :])
    alpha, beta = np.empty((segments, k)), np.empty((segments, k))
    m = np.full(k, 1.0 / k)
    for g in range(segments):
        alpha[g] = m
        m = m @ fwd[g]
        m /= m.sum()
    m = np.full(k, 1.0 / k)
    for g in range(segments - 1, -1, -1):
        beta[g] = m
        m = fwd[g] @ m
        m /= m.sum()
    a, b = np.empty((segments, steps, k)), np.empty((segments, steps, k))
    m = alpha
    for s in range(steps):
        m = normal(into(s, m) * e[:, s])
        a[:, s] = m
    m = beta
    for s in range(steps - 1, -1, -1):
        b[:, s] = m
        m = normal(back(s, m * e[:, s]))
    p = (a * b).reshape(-1, k)[:n]
    p /= p.sum(axis=1, keepdims=True)
    return (p, a.reshape(-1, k)[:n], (b * e).reshape(-1, k)[:n]) if messages else p


def train(texts: list[tuple[str, str]], epochs: int = EPOCHS, rate: float = 0.5, decay: float = 1e-5, seed: int = 0) -> Crf:
    """Fit by stochastic gradient ascent (AdaGrad) on the conditional likelihood of whole label chains.

    Training chains are texts of one language; pairs of them are joined end to end, so the model also sees switches and
    learns how rare they are.
    """
    languages = sorted({lang for lang, _ in texts})
    rng = np.random.default_rng(seed)
    k = len(languages)
    chains = []
    for lang, text in texts:
        w = tokens(text)
        if w:
            chains.append((languages.index(lang), w))
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, ws in chains for w in ws))}
    owner, bucket = word_features(list(vocabulary)) if vocabulary else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.argsort(owner, kind="stable")
    bucket, ends = bucket[order], np.cumsum(np.bincount(owner, minlength=len(vocabulary)))
    weights, trans = np.zeros((BUCKETS, k)), np.zeros((k, k))
    gw, gt = np.full((BUCKETS, k), 1e-3), np.full((k, k), 1e-3)
    for _ in range(epochs):
        order = rng.permutation(len(chains))
        for lo in range(0, len(order), 32):
            batch = [chains[i] for i in order[lo : lo + 32]]
            ws = [w for _, c in batch for w in c]
            y = np.repeat([lang for lang, _ in batch], [len(c) for _, c in batch])
            first = np.zeros(len(ws), bool)
            at = np.cumsum([0, *[len(c) for _, c in batch]])[:-1]
            first[at[::2]] = True  # every second text goes on where another ends
            ids = np.array([vocabulary[w] for w in ws])
            size = np.diff(ends, prepend=0)[ids]
            begin = np.cumsum(size) - size
            flat = bucket[np.repeat(ends[ids] - size - begin, size) + np.arange(size.sum())]
            scale = np.repeat(1 / np.sqrt(size), size)
            scores = np.add.reduceat(weights[flat] * scale[:, None], begin, axis=0)
            p, ahead, behind = forward_backward(scores, first, trans, messages=True)
            err = -p
            err[np.arange(len(y)), y] += 1
            used, place = np.unique(flat, return_inverse=True)
            push = np.repeat(err, size, axis=0) * scale[:, None]
            grad = np.stack([np.bincount(place, push[:, j], len(used)) for j in range(k)], axis=1) / len(y) - decay * weights[used]
            gw[used] += grad**2
            weights[used] += rate * grad / np.sqrt(gw[used])
            inner = ~first[1:]
            edge = ahead[:-1, :, None] * np.exp(trans)[None] * behind[1:, None, :]
            edge /= edge.sum(axis=(1, 2), keepdims=True)
            g = -edge[inner].sum(axis=0)
            np.add.at(g, (y[:-1][inner], y[1:][inner]), 1)
            g = g / len(y) - decay * trans
            gt += g**2
            trans += rate * g / np.sqrt(gt)
    return Crf(languages, weights.astype(np.float32), trans)


def training_texts(docs: DataFrame, per_language: int = TEXTS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """A bounded sample of labelled whole texts: of each language the per_language rows first in the order of a hash of the id.

    Texts of at most TEXT_CHARS characters come before longer ones. The rows of each language and length are counted, and
    only those whose hash lies below a cutoff that lets about twice the wanted number pass are ranked (a cutoff that lets
    too few pass is raised); so no task or driver sees more however large a language is. Then the chosen texts are fetched,
    one a hash: of rows that share language and id (null ids too) the text last in order, picked before the driver sees any.
    """
    rows = docs.filter(docs[lang_col].isNotNull() & docs[text_col].isNotNull()).select(docs[lang_col].cast("string").alias("lang"), docs[text_col].alias("text"), F.xxhash64(docs[id_col].cast("string")).alias("h"))
    light = rows.select("lang", (F.length("text") > TEXT_CHARS).alias("long"), F.pmod("h", F.lit(1 << 30)).alias("u"), "h")
    counts = {(r["lang"], r["long"]): r["count"] for r in light.groupBy("lang", "long").count().collect()}
    need = {(lang, long): max(0, per_language - (counts.get((lang, False), 0) if long else 0)) for lang, long in counts}
    cut = {g: min(1 << 30, -(-(2 * need[g] + 200) * (1 << 30) // n)) for g, n in counts.items() if need[g]}
    spark, chosen = docs.sparkSession, []
    while cut:
        table = spark.createDataFrame([(*g, c) for g, c in cut.items()], "lang string, long boolean, cut long")
        got: dict[tuple, set] = {}
        for r in light.join(F.broadcast(table), ["lang", "long"]).filter("u < cut").select("lang", "long", "u", "h").distinct().collect():
            got.setdefault((r["lang"], r["long"]), set()).add((r["u"], r["h"]))
        done = [g for g, c in cut.items() if c >= 1 << 30 or len(got.get(g, ())) >= need[g]]
        chosen += [(g[0], h) for g in done for _, h in sorted(got.get(g, ()))[: need[g]]]
        cut = {g: min(1 << 30, 4 * c) for g, c in cut.items() if g not in done}
    if not chosen:
        return []
    wanted = F.broadcast(spark.createDataFrame(sorted(set(chosen)), "lang string, h long"))
    got = rows.join(wanted, ["lang", "h"]).groupBy("lang", "h").agg(F.max("text").alias("text")).collect()
    return sorted((r["lang"], r["text"]) for r in got)


def predict(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """All columns of docs, and lang_pred, score (and with spans: switches array<struct<word int, lang string>>).

    A text's language is the one with the largest sum of word marginals, weighted by word length; the score is its share
    (0 to 1). Null, empty and letterless texts are `und` with score 0. Marginals are computed for a block of texts at a
    time, so long texts need no more memory than their words. Repeated rows are predicted alike, an empty table gives no
    row; columns of docs may have any name, lang_pred and score too, as the new ones are the last.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kinds = ", ".join(f"`_{i}` {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    at = docs.columns.index(text_col)
    names = [f"_{i}" for i in range(len(docs.columns))]
    extra = "lang_pred string, score double" + (", switches array<struct<word:int,lang:string>>" if spans else "")

    def run(batches):
        resident("language")
        m = shared.value
        k = len(m.languages)
        met: list[str] = []

        def number(word):
            met.append(word)
            return len(met) - 1

        cache = Cache(number, 200_000)
        table = np.empty((0, k + 1), np.float32)
        for b in blocks(batches, 2 << 20):
            texts = [tokens(t) for t in texts_of(b, f"_{at}")]
            sizes = np.array([len(t) for t in texts], np.int64)
            got = np.concatenate([np.fromiter(map(cache.__getitem__, t), np.int64, len(t)) for t in texts]) if len(texts) else np.empty(0, np.int64)
            new = met[len(table) :]
            if new:
                table = np.concatenate([table, np.concatenate([m.emissions(new), np.array([[len(w)] for w in new], np.float32)], axis=1)])
            pred, score, spanned = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            full = np.flatnonzero(sizes)
            if len(full):
                start = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
                first = np.zeros(len(got), bool)
                first[start] = True
                e = table[got]
                p = forward_backward(e[:, :k].astype(np.float64), first, m.transitions)
                share = np.add.reduceat(p * e[:, k:], start, axis=0)
                share /= share.sum(axis=1, keepdims=True)
                best = share.argmax(axis=1)
                for i, row, lang in zip(full.tolist(), share, best.tolist(), strict=True):
                    pred[i], score[i] = m.languages[lang], float(min(1.0, row[lang]))
                if spans:
                    label = p.argmax(axis=1)
                    turn = first.copy()
                    turn[1:] |= label[1:] != label[:-1]
                    owner = np.repeat(full, sizes[full])
                    begin = np.repeat(start, sizes[full])
                    for j in np.flatnonzero(turn).tolist():
                        spanned[owner[j]].append({"word": int(j - begin[j]), "lang": m.languages[label[j]]})
            out = [pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            if spans:
                out.append(pa.array(spanned, pa.list_(pa.struct([("word", pa.int32()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays([*b.columns, *out], names=[*names, "lang_pred", "score", *(["switches"] if spans else [])])
            if len(met) > 400_000:  # emissions are kept for a bounded number of words
                met.clear()
                cache = Cache(number, 200_000)
                table = table[:0]

    flat = docs.toDF(*names).mapInArrow(run, f"{kinds}, {extra}")
    return flat.toDF(*docs.columns, "lang_pred", "score", *(["switches"] if spans else []))


def fit(docs: DataFrame, per_language: int = TEXTS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Crf | None:
    """The model of the labelled rows of docs; None if there are none."""
    texts = training_texts(docs, per_language, id_col, text_col, lang_col)
    return _fit(tuple(texts))


def recognised(docs: DataFrame, model: Crf | None, least: float = LEAST_SHARE, words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, in whose text the model finds a language.

    Null, empty and letterless texts go, and texts of at least `words` words of which the likeliest language has a share
    (score) below `least`: they are in another language or in several alike. Shorter texts say too little to be turned down.
    Without a model (no labelled rows) every text with a letter stays. Repeated rows fare alike; an empty table gives none.
    """
    if model is None:
        return docs.filter(docs[text_col].rlike(r"\p{L}"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    found = predict(docs.toDF(*names), model, names[docs.columns.index(id_col)], text)
    short = F.regexp_count(F.col(text), F.lit(r"\p{L}+(?:['’]\p{L}+)*")) < words
    return found.filter((F.col("lang_pred") != UNKNOWN) & ((F.col("score") >= least) | short)).select(*names).toDF(*docs.columns)


@functools.lru_cache(2)
def _fit(texts: tuple) -> Crf | None:
    model = train(list(texts)) if texts else None
    return model


def identify(docs: DataFrame, held_out: int = 5, per_language: int = TEXTS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, held_out, lang_pred, score) per row, learnt from rows whose crc32 fold of the id is not 0.

    The model sees nothing but texts. Null ids fold as the empty string. Without any labelled row every text is `und` with
    score 0. Repeated rows are predicted alike; further columns are dropped; an empty table gives no row.
    """
    fold = crc_fold(docs[id_col], held_out) == 0
    model = fit(docs.filter(~fold), per_language, id_col, text_col, lang_col)
    d = columns(docs, id_col, text_col).withColumn("_h", crc_fold(id_col, held_out) == 0)
    out = predict(d, model, id_col, text_col) if model else d.select("*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return out.select(id_col, F.col("_h").alias("held_out"), "lang_pred", "score")


