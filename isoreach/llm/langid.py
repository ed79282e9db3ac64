"""Language of documents: scripts narrow the candidates, words are scored by byte n-grams, and Viterbi with a switching penalty labels spans.

The model is a table of log probabilities of hashed n-grams: BUCKETS rows, a
column for each language. It is summed over all training rows of a sample of
about FIT_ROWS, as many of each language, drawn by a hash of the id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoreach.llm.common import crc_rest, map_arrow

BUCKETS = 1 << 15
#: Rows that the model is fitted on, about, shared equally by the languages; and those that a language has at least, where there are as many.
FIT_ROWS, LEAST_ROWS = 20_000, 500
#: Nats that a change of language costs; what n-grams that overlap are divided by.
PENALTY, OVERLAP = 16.0, 3.0
#: Words whose scores a task remembers.
CACHE = 200_000
#: First code points of script ranges and the script that begins there.
RANGES = [(0x41, 1), (0x250, 1), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x700, 0), (0x900, 7), (0x980, 8), (0xA00, 0), (0xE00, 9), (0xE80, 0), (0x10A0, 10), (0x1100, 11), (0x1200, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 12), (0x3100, 0), (0x3400, 13), (0xA000, 0), (0xAC00, 11), (0xD7B0, 0), (0xF900, 13), (0xFB00, 1), (0xFB50, 6), (0xFE00, 0), (0x20000, 13)]
_STARTS = [a for a, _ in RANGES]
SCRIPTS = 14
_LETTERS = regex.compile(r"\p{L}+")


def script(ch: str) -> int:
    """The script of a letter; 0 for others."""
    from bisect import bisect

    i = bisect(_STARTS, ord(ch))
    return RANGES[i - 1][1] if i else 0


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 2- to 4-grams of the bytes of ' word ', and which word each is of."""
    raw = [b" %b " % w.encode() for w in words]
    n = np.array([len(r) for r in raw])
    b = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    of = np.repeat(np.arange(len(raw)), n)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(b))  # bytes to the word's end
    out, who = [], []
    for size in (2, 3, 4):
        h = np.full(max(0, len(b) - size + 1), size * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for j in range(size):
            h = (h ^ b[j : len(b) - size + 1 + j]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        ok = left[: len(h)] >= size
        out.append((h & np.uint32(BUCKETS - 1))[ok])
        who.append(of[: len(h)][ok])
    return np.concatenate(out), np.concatenate(who)


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def bare(word: str) -> str:
    """Its letters."""
    return "".join(_LETTERS.findall(word))


def _more(held: list[np.ndarray], n: int, rows: np.ndarray) -> None:
    """Puts rows behind the first n of an array that grows by doubling."""
    if not held or n + len(rows) > len(held[0]):
        out = np.zeros((max(2 * n, n + len(rows)), rows.shape[1]), rows.dtype)
        if held:
            out[:n] = held[0][:n]
        held[:] = [out]
    held[0][n : n + len(rows)] = rows


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x langs
    uses: np.ndarray  # SCRIPTS x langs: whether a language is written in it
    penalty: float = PENALTY
    _seen: dict[str, int] = field(default_factory=dict, repr=False)
    _rows: list[np.ndarray] = field(default_factory=list, repr=False)
    _n: int = field(default=0, repr=False)
    _m: int = field(default=0, repr=False)
    _place: dict[str, int] = field(default_factory=dict, repr=False)
    _fits: list[np.ndarray] = field(default_factory=list, repr=False)

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(words x langs scores, whether a word has letters)."""
        if len(self._seen) > CACHE:
            self._seen, self._rows, self._n = {}, [], 0
        seen = self._seen
        if new := list({w for w in words if w not in seen}):
            plain = [bare(w) for w in new]
            lettered = [i for i, p in enumerate(plain) if p]
            for i, p in enumerate(plain):
                if not p:
                    seen[new[i]] = 0
            if lettered:
                g, who = _grams([plain[i] for i in lettered])
                s = np.zeros((len(lettered), len(self.langs)), np.float32)
                for k in range(len(self.langs)):
                    s[:, k] = np.bincount(who, weights=self.table[g, k], minlength=len(lettered))
                s /= OVERLAP
                s -= s.max(1, keepdims=True)
                can = self.uses[[script(plain[i][0]) for i in lettered]]
                s = np.where(can, s, np.where(can.any(1, keepdims=True), -1e3, 0)).astype(np.float32)
                _more(self._rows, self._n, s)
                for j, i in enumerate(lettered):
                    seen[new[i]] = 1 + self._n + j
                self._n += len(s)
        idx = np.array([seen[w] for w in words], np.int64)
        rows = self._rows[0] if self._rows else np.zeros((1, len(self.langs)), np.float32)
        return np.where((idx > 0)[:, None], rows[np.maximum(idx - 1, 0)], np.float32(0)), idx > 0

    def path(self, s: np.ndarray) -> np.ndarray:
        """The best language of each word: Viterbi.

        A path that leaves the best language of the whole and comes back pays a
        penalty more than it has stretches, and one that ends elsewhere as many;
        so none pays where no stretch of one language gains over the penalty.
        One that never has the best language pays one less than its stretches:
        two gain no more than the best beginning and end that meet, and more
        than two no more than any beginning and end and a stretch between for
        each penalty beyond the second. Where none of these pays, the path is
        the best language throughout.
        """
        total = s.sum(0, dtype=np.float64)
        best = int(total.argmax())
        gain = np.cumsum(s.astype(np.float64) - s[:, best : best + 1], axis=0)
        low = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
        most = (gain - low).max() if len(s) else 0
        if most <= self.penalty:
            head, tail = np.delete(gain, best, 1), np.delete(gain[-1] - gain, best, 1)  # up to a word, and after it
            if len(s) < 2 or not head.size:
                return np.full(len(s), best)
            head, tail = head[:-1].max(1), tail[:-1].max(1)
            if (head + tail).max() <= self.penalty and head.max() + tail.max() <= 2 * self.penalty - most:
                return np.full(len(s), best)
        back = np.empty(s.shape, np.int16)
        v = np.zeros(s.shape[1])
        keep = np.arange(s.shape[1])
        for t in range(len(s)):
            top = int(v.argmax())
            stay = v >= v[top] - self.penalty
            back[t] = np.where(stay, keep, top)
            v = np.where(stay, v, v[top] - self.penalty) + s[t]
        out = np.empty(len(s), np.int64)
        k = int(v.argmax())
        for t in range(len(s) - 1, -1, -1):
            out[t] = k
            k = int(back[t, k])
        return out

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(first word, word after the last, language) over the words of a text."""
        words = words_of(text)
        if not words or not self.langs:
            return []
        s, has = self.scores(words)
        if not has.any():
            return []
        p = self.path(s)
        cut = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), len(p)]
        return [(a, b, self.langs[p[a]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of most lettered words, and their share times the certainty that it leads the others; und without letters."""
        words = words_of(text)
        if not words or not self.langs:
            return "und", 0.0
        s, has = self.scores(words)
        if not has.any():
            return "und", 0.0
        p = self.path(s)[has]
        count = np.bincount(p, minlength=len(self.langs))
        k = int(count.argmax())
        total = s[has].sum(0, dtype=np.float64)
        others = np.delete(total, k)
        sure = 1 / (1 + np.exp(np.clip(others.max() - total[k], -50, 50))) if len(others) else 1.0
        share = count[k] / len(p)
        return self.langs[k], float(share * max(sure, 0.5 if share > 0.5 else sure))

    def known(self, text: str | None) -> float:
        """The share of lettered words that have a candidate language by script and whose n-grams the text's language has learned, on average, better than chance; of the language that has most."""
        count = Counter(words_of(text))
        if not count or not self.langs:
            return 0.0
        place, fits = self.fits(list(count))
        weight = np.fromiter(count.values(), np.float64, len(count))[place >= 0]
        if not len(weight):
            return 0.0
        return float((weight[:, None] * fits[place[place >= 0]]).sum(0).max() / weight.sum())

    def fits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each word its row, -1 without letters; and the rows: whether a word can be of a language and its n-grams are learned there, on average, better than chance. Words met are kept."""
        if len(self._place) > CACHE:
            self._place, self._fits, self._m = {}, [np.zeros((0, len(self.langs)), bool)], 0
        place = self._place
        new = {w: bare(w) for w in words if w not in place}
        if kinds := [p for p in new.values() if p]:
            can = self.uses[[script(p[0]) for p in kinds]]
            g, who = _grams(kinds)
            # nats of an n-gram over one that was never seen and all are as likely
            gain = self.table[g] + np.log(BUCKETS)
            n = np.bincount(who, minlength=len(kinds))
            each = np.stack([np.bincount(who, weights=gain[:, k], minlength=len(kinds)) / n for k in range(len(self.langs))], 1)
            _more(self._fits, self._m, can & (each > 0))
        for w, p in new.items():
            place[w] = self._m if p else -1
            self._m += bool(p)
        return np.fromiter(map(place.__getitem__, words), np.int64, len(words)), self._fits[0] if self._fits else np.zeros((0, len(self.langs)), bool)


def fit(docs: DataFrame, train: Column | None = None, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", fit_rows: int = FIT_ROWS) -> Model:
    """Learn from rows with a language and a text, of those where ``train`` holds. No rows give a model without languages."""
    d = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), (F.lit(True) if train is None else train).alias("ok")).filter("ok AND lang IS NOT NULL")
    by = sorted(d.groupBy("lang").count().collect(), key=lambda r: r["lang"])
    langs = [r["lang"] for r in by]
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((SCRIPTS, 0), bool))
    rows = max(LEAST_ROWS, fit_rows // len(langs))
    shares = d.sparkSession.createDataFrame([(r["lang"], int(1_000_000_000 * min(1.0, rows / r["count"]))) for r in by], "lang string, share long")
    chosen = d.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000_000)) < F.col("share")).select("text", "lang")
    place = {k: i for i, k in enumerate(langs)}

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if lang in place:
                words.setdefault(lang, Counter()).update(words_of(text))
        for lang, count in words.items():
            plain: Counter = Counter()
            for w, n in count.items():
                if p := bare(w):
                    plain[p] += n
            if plain:
                names = list(plain)
                g, who = _grams(names)
                weight = np.array([plain[w] for w in names], np.float64)
                sums = np.bincount(g, weights=weight[who], minlength=BUCKETS + SCRIPTS)
                sums += np.bincount([BUCKETS + script(w[0]) for w in names], weights=weight, minlength=BUCKETS + SCRIPTS)
                at = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), place[lang], np.int32)), pa.array(at.astype(np.int32)), pa.array(sums[at])], ["lang", "bucket", "n"])

    # at most BUCKETS + SCRIPTS rows of each language come to the driver
    rows = map_arrow(chosen, run, "lang int, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros((BUCKETS + SCRIPTS, len(langs)))
    count[rows["bucket"].to_numpy(), rows["lang"].to_numpy()] = rows["n"].to_numpy()
    grams, scripts = count[:BUCKETS], count[BUCKETS:]
    table = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * BUCKETS)).astype(np.float32)
    return Model(langs, table, scripts > 0.01 * np.maximum(scripts.sum(0), 1))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row; a null or letterless text is und with score 0."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = [model.predict(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([o[0] for o in out]), pa.array([o[1] for o in out])], ["doc_id", "lang_pred", "score"])

    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): fitted on documents whose crc32 of the id isn't a multiple of five, predicted for all. A null id is never trained on and isn't held out. Repeated rows count as often in training and have a row each; texts may be of any length; other columns play no part."""
    model = fit(docs, crc_rest("doc_id", 5) != 0)
    return predict(docs, model).select("doc_id", F.coalesce(crc_rest("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
