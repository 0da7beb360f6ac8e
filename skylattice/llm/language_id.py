"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams by language are summed by Spark over the training rows; the matrix of log
probabilities (buckets x languages, a size fixed by parameters) is broadcast. A batch of texts becomes a
sparse matrix of counts (text, bucket), and its product with the log probabilities is the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import mix, sliced, trained_on

#: The model is fitted on a hash sample of about so many labelled rows (all, if there are fewer), of each
#: language its part of them, so that a rare one keeps all its rows.
TRAIN_ROWS = 20_000
BUCKETS = 1 << 16
ORDERS = (2, 3)
#: Languages that a model may have; with more, fitting is refused, since the matrix has BUCKETS floats for each.
MAX_LANGUAGES = 500
#: Characters whose n-grams are counted at once, and numbers of the dense product made at once.
PIECE, CELLS = 1 << 18, 1 << 22


def _letters() -> np.ndarray:
    """Code point below 65536 -> itself if a letter, else a blank."""
    return np.array([i if chr(i).isalpha() else 32 for i in range(0x10000)], dtype=np.uint64)


class Grams:
    """Bucket numbers of the character n-grams of texts."""

    def __init__(self, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS):
        self.buckets, self.orders, self.letter = buckets, orders, _letters()

    def of(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Piece by piece: the text and the bucket of each n-gram. An n-gram lies in one text, which has a blank at either end."""
        wrapped = [f" {t.lower()} " for t in texts]
        codes = np.frombuffer("".join(wrapped).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum([len(w) for w in wrapped])
        for n in self.orders:
            for at in range(0, len(codes) - n + 1, PIECE):
                part = codes[at : at + PIECE + n - 1]
                part = np.where(part < 0x10000, self.letter[np.minimum(part, 0xFFFF)], part)
                code = part[: len(part) - n + 1].copy()
                for i in range(1, n):
                    code *= np.uint64(0x1FFFF)
                    code += part[i : len(part) - n + 1 + i]
                code = (mix(code + np.uint64(n)) % np.uint64(self.buckets)).astype(np.int64)
                start = at + np.arange(len(code))
                text = np.searchsorted(ends, start, side="right")
                inside = start + n <= ends[text]
                yield text[inside], code[inside]

    def counts(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Piece by piece the sparse matrix of counts: text, bucket, number; texts ascend."""
        for text, code in self.of(texts):
            both, many = np.unique(text * self.buckets + code, return_counts=True)
            yield both // self.buckets, both % self.buckets, many


@dataclass
class LanguageModel:
    languages: list[str]
    log_prob: np.ndarray  # buckets x languages, float32
    prior: np.ndarray

    def score(self, grams: Grams, texts: list[str]) -> tuple[list[str], np.ndarray]:
        total = np.tile(self.prior, (len(texts), 1))
        step = max(1, CELLS // len(self.languages))
        for text, bucket, many in grams.counts(texts):
            for at in range(0, len(text), step):
                rows = self.log_prob[bucket[at : at + step]] * many[at : at + step, None]
                some, first = np.unique(text[at : at + step], return_index=True)
                total[some] += np.add.reduceat(rows, first, axis=0)
        best = total.argmax(axis=1)
        spread = np.exp(total - total.max(axis=1, keepdims=True))
        return [self.languages[i] for i in best], (spread.max(axis=1) / spread.sum(axis=1))


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> LanguageModel | None:
    """Learns from rows with text, a language, and an id that :func:`trained_on` admits; None if there are none.

    Rows without an id are never learnt from; rows that repeat an id all are.
    """
    able = docs.where(trained_on(id_col) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    able = able.select(F.xxhash64(F.col(id_col)).alias("at"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    there = able.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if not there:
        return None
    if len(there) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in column {lang_col}")
    languages = [r["lang"] for r in there]
    wanted = train_rows / len(languages)
    share = F.create_map(*(F.lit(x) for r in there for x in (r["lang"], round(min(1.0, wanted / r["n"]) * (1 << 20)))))
    sample = able.where(F.pmod("at", F.lit(1 << 20)) < share[F.col("lang")]).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, held = Grams(), {}
        for b in sliced(batches, limit=1 << 20):
            langs = np.array(b.column(1).to_pylist(), dtype=object)
            for lang in set(langs):
                texts = [t for t, k in zip(b.column(0).to_pylist(), langs, strict=True) if k == lang]
                for _, code in grams.of(texts):
                    held[lang] = held.get(lang, 0) + np.bincount(code, minlength=BUCKETS)
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at].astype(np.int64))], ["lang", "bucket", "n"])

    sums = sample.mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((BUCKETS, len(languages)))
    place = {lang: i for i, lang in enumerate(languages)}
    counts[sums["bucket"].to_numpy(int), sums["lang"].map(place).to_numpy(int)] = sums["n"].to_numpy(float)
    log_prob = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * BUCKETS)).astype(np.float32)
    prior = np.log(np.array([next(r["n"] for r in there if r["lang"] == k) for k in languages], dtype=float))
    return LanguageModel(languages, log_prob, prior - np.log(np.exp(prior).sum()))


def identify_language(docs: DataFrame, model: LanguageModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Without a model one is fitted on ``docs``. A text that is null or has no letter is ``und`` with
    score 0, as are all texts if there was nothing to learn from. Equal scores: the language first in
    the alphabet. Only the text decides; repeated rows each get a row, and a row without an id is scored
    too, as not held out; other columns are ignored. An empty table gives an empty result.
    """
    model = model or fit_languages(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, m = Grams(), shared.value
        for b in sliced(batches, limit=1 << 20):
            texts = b.column(1).to_pylist()
            known = [i for i, t in enumerate(texts) if m is not None and t and any(c.isalpha() for c in t)]
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            if known:
                got, score = m.score(grams, [texts[i] for i in known])
                scores[known] = score
                for i, lang in zip(known, got, strict=True):
                    langs[i] = lang
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    out = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(~trained_on("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")
