"""Toxicity: a support vector machine on the subsequence string kernel with Nystroem landmarks.

The kernel of two words counts the subsequences of three characters that they share, each weighted by
``DECAY`` to the length it spans, gaps included, up to ``SPAN`` characters; so an insult with an
inserted character still shares most of them. Landmark words give the Nystroem map
K(w, landmarks) K(landmarks, landmarks)^-1/2, in which a linear machine is trained. Its decision is a
sum over landmarks of the kernel, hence over subsequences: the machine is kept as one weight for each
hashed subsequence, and texts are scored word by word in numpy. A text is as toxic as its worst word.

Labels are on texts, and some are wrong, so words are labelled in turns: those that are far more frequent in
toxic texts are witnesses; then, in toxic texts without one, the worst word if the machine so far finds it
like them; words of clean texts are none. Part of the labelled texts is kept from this for the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import mix, sliced, trained_on

#: The machine is fitted on a hash sample of about so many labelled texts (all, if there are fewer).
TRAIN_TEXTS = 4_000
#: So many characters of a labelled text's distinct words are learnt from at most; with TRAIN_TEXTS this bounds what the driver gets.
TRAIN_CHARS = 100_000
LANDMARKS, TURNS, DECAY, SPAN = 240, 3, 0.7, 5
#: A telling word is in so large a part of the toxic texts at least, and so many times as frequent there as in clean ones.
TELLING, RATIO = 0.01, 4.0
#: Decision from which a word is like the telling ones; errors on held-out texts within SLACK of the fewest count as equal.
ALIKE, SLACK = 0.2, 0.002
#: The threshold lies at least so far below the decisions for the words that tell most.
MARGIN = 0.05
TABLE = 1 << 20
#: Characters whose subsequences are added up at a time.
BLOCK = 1 << 17
THRESHOLD = 0.7
#: Offsets of the second and third character of a subsequence.
_GAPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_BREAK = np.zeros(0x10000, dtype=bool)
_BREAK[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x2028, 0x2029]] = True


class WordFeatures:
    """Characters of all words of some texts, each word between two blanks, and its subsequences."""

    def __init__(self, texts: list[str]):
        joined = [f" {t.lower()} " for t in texts]
        codes = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        gap = _BREAK[np.minimum(codes, 0xFFFF)]
        first = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
        last = np.flatnonzero(~gap & np.concatenate([gap[1:], [True]])) + 1
        # one blank before and after belongs to the word: its first and last letters count as such
        self.start, self.end = first - 1, last + 1
        self.codes = np.where(gap, np.uint32(32), codes).astype(np.uint64)
        self.text = np.searchsorted(np.cumsum([len(j) for j in joined]), self.start, side="right")

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """For each word the sum of ``weights`` over its subsequences, over the norm of the word."""
        total = np.zeros(len(self.start))
        for words, part in self.blocks():
            for slot, at, size in part.slots():
                run = np.concatenate([[0.0], np.cumsum(weights[slot] * at, dtype=float)])
                total[words] += part.within(run, size)
        return total / np.sqrt(np.maximum(self.norms(), 1e-9))

    def blocks(self) -> Iterator[tuple[slice, WordFeatures]]:
        """The words again in blocks of about BLOCK characters, or one word: what sums need beside them has a bound."""
        at = 0
        while at < len(self.start):
            first = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, first + BLOCK, side="right")))
            part = object.__new__(WordFeatures)
            part.codes, part.text = self.codes[first : self.end[to - 1]], self.text[at:to]
            part.start, part.end = self.start[at:to] - first, self.end[at:to] - first
            yield slice(at, to), part
            at = to

    def slots(self) -> Iterator[tuple[np.ndarray, float, int]]:
        """For each pair of gaps: slot of the subsequence from each character, its weight, its span."""
        c, n = self.codes, len(self.codes)
        for a, b in _GAPS:
            m = n - b
            if m > 0:
                code = c[:m] | c[a : a + m] << np.uint64(21) | c[b : b + m] << np.uint64(42)
                yield (mix(code) & np.uint64(TABLE - 1)).astype(np.int32), DECAY ** (b + 1), b

    def within(self, run: np.ndarray, span: int) -> np.ndarray:
        """Differences of running sums over the starts that keep the span inside the word."""
        to = np.maximum(self.end - span, self.start)
        return run[np.minimum(to, len(run) - 1)] - run[np.minimum(self.start, len(run) - 1)]

    def norms(self) -> np.ndarray:
        """The kernel of a word with itself, but for subsequences that occur twice in it."""
        size = (self.end - self.start).astype(float)
        return sum(np.maximum(size - b, 0) * DECAY ** (2 * (b + 1)) for _, b in _GAPS)

    def rows(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Slots and weights of each word, normed."""
        parts = [(slot, w, b) for slot, w, b in self.slots()]
        norm = np.sqrt(np.maximum(self.norms(), 1e-9))
        out = []
        for i, (s, e) in enumerate(zip(self.start, self.end, strict=True)):
            slot = np.concatenate([p[0][s : max(e - p[2], s)] for p in parts]) if parts else np.zeros(0, np.int32)
            weight = np.concatenate([np.full(max(e - p[2] - s, 0), p[1]) for p in parts]) if parts else np.zeros(0)
            out.append((slot, weight / norm[i]))
        return out


def _dense(rows: list[tuple[np.ndarray, np.ndarray]], columns: np.ndarray) -> np.ndarray:
    """The rows as a matrix over the given slots."""
    out = np.zeros((len(rows), len(columns)))
    for i, (slot, weight) in enumerate(rows):
        at = np.searchsorted(columns, slot)
        ok = (at < len(columns)) & (columns[np.minimum(at, len(columns) - 1)] == slot)
        np.add.at(out[i], at[ok], weight[ok])
    return out


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 2000.0, steps: int = 500) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, clean words weighted fourfold in sum, by accelerated gradient descent."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    weight = cost * np.where(y > 0, 1.0 / max((y > 0).sum(), 1), 4.0 / max((y < 0).sum(), 1))
    w = v = np.zeros(x1.shape[1])
    rate = 1 / (1 + 2 * float(np.linalg.eigvalsh((x1 * weight[:, None]).T @ x1)[-1]))
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x1 @ v))
        grad = v - 2 * x1.T @ (weight * y * slack)
        new = v - rate * grad
        v = new + t / (t + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


@dataclass
class ToxicityModel:
    weights: np.ndarray  # one for each slot of a subsequence
    bias: float
    slope: float
    centre: float  # decision at which the score is THRESHOLD

    def decide(self, texts: list[str]) -> np.ndarray:
        """The largest decision value of a word of each text; that of no word at all where there is none."""
        words, out = WordFeatures(texts), np.full(len(texts), -2.0)
        if len(words.start):
            np.maximum.at(out, words.text, words.sums(self.weights) + self.bias)
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        z = self.slope * (self.decide(texts) - self.centre) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_on(texts: list[str], toxic: np.ndarray) -> ToxicityModel | None:
    """The machine for labelled texts; None unless there are both kinds, and words that tell them apart.

    Every fifth text of a kind is kept from training, and moves the threshold if it asks for another one.
    """
    if toxic.sum() == 0 or toxic.all():
        return None
    apart = np.zeros(len(texts), dtype=bool)
    for kind in (True, False):
        of = np.flatnonzero(toxic == kind)
        if len(of) >= 50:
            apart[of[4::5]] = True
    model = _machine([t for t, x in zip(texts, apart, strict=True) if not x], toxic[~apart])
    if model is None or not apart.any():
        return model
    top, true = model.decide([t for t, x in zip(texts, apart, strict=True) if x]), toxic[apart]
    cuts = np.unique(np.concatenate([top, [model.centre]]))
    cuts = np.unique(np.concatenate([(cuts[1:] + cuts[:-1]) / 2, [model.centre]]))
    errors = np.array([2.0 * ((top >= c) & ~true).sum() + ((top < c) & true).sum() for c in cuts])
    good = cuts[errors <= errors.min() + SLACK * len(top)]
    model.centre = float(good[np.argmin(np.abs(good - model.centre))])  # the one nearest to half way
    return model


def copies(bags: list[np.ndarray], words: list[str]) -> np.ndarray:
    """A number for each bag of words; copies and near copies of a text share one.

    Texts whose two least hashes of long words agree, under either of two hash functions, are taken as copies.
    """
    size = np.array([len(w) for w in words], dtype=int)
    parent = list(range(len(bags)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for seed in (1, 2):
        first: dict[tuple[int, ...], int] = {}
        hashes = mix(np.arange(len(words), dtype=np.uint64) + np.uint64(seed << 32))
        for i, bag in enumerate(bags):
            some = bag[size[bag] >= 7] if (size[bag] >= 7).sum() > 1 else bag
            key = tuple(np.sort(hashes[some])[:2].tolist())
            parent[root(i)] = root(first.setdefault(key, i))
    return np.array([root(i) for i in range(len(bags))], dtype=int)


def telling_words(n_toxic: np.ndarray, n_clean: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Which words are so much more frequent in toxic texts than in clean ones that mislabelled texts don't explain it."""
    least = (n_toxic - 1.5 * np.sqrt(n_toxic)) / toxic
    most = (n_clean + 1.5 * np.sqrt(n_clean) + 1) / clean
    return np.flatnonzero((n_toxic >= np.maximum(3, TELLING * toxic)) & (least > RATIO * most))


def _machine(texts: list[str], toxic: np.ndarray) -> ToxicityModel | None:
    """The machine trained on all these texts, its threshold half way between the telling words and the clean ones."""
    held: dict[str, int] = {}
    bags: list[np.ndarray] = []
    for t in texts:
        bags.append(np.array(sorted({held.setdefault(w, len(held)) for w in t.lower().split()}), dtype=int))
    words = list(held)
    n_toxic, n_clean = np.zeros(len(words)), np.zeros(len(words))
    # however many copies of a text there are, they are one witness of a kind
    of, texts_of = copies(bags, words), []
    for kind, count in ((True, n_toxic), (False, n_clean)):
        mine = np.flatnonzero(toxic == kind)
        pairs = np.unique(np.concatenate([[of[i] * len(words) + bags[i]] for i in mine if len(bags[i])] or [np.zeros((1, 0), dtype=int)], axis=1)[0])
        count += np.bincount(pairs % max(1, len(words)), minlength=len(words))
        texts_of.append(len(np.unique(of[mine])))
    telling = telling_words(n_toxic, n_clean, *texts_of)
    if not len(telling):
        return None
    features = WordFeatures(words)  # one word a text, so words and rows agree
    rng = np.random.default_rng(5)
    clean = np.setdiff1d(np.flatnonzero(n_clean > 0), telling)
    clean = clean[np.argsort(mix(clean.astype(np.uint64) + np.uint64(99)))]
    common = clean[np.argsort(-n_clean[clean], kind="stable")[:600]]
    positive, worst = telling, clean[:0]
    for turn in range(TURNS):
        negative = np.unique(np.concatenate([clean[:1200], common, worst]))
        both = np.concatenate([positive, negative])
        rows = WordFeatures([words[i] for i in both]).rows()
        y = np.where(np.arange(len(both)) < len(positive), 1.0, -1.0)
        frequent = np.argsort(-n_toxic[positive], kind="stable")[: LANDMARKS // 2]
        marks = np.unique(np.concatenate([frequent, len(positive) + rng.permutation(len(negative))[: LANDMARKS - len(frequent)]]))
        columns = np.unique(np.concatenate([rows[i][0] for i in marks]))
        land = _dense([rows[i] for i in marks], columns)
        kernel = np.concatenate([_dense(rows[i : i + 128], columns) @ land.T for i in range(0, len(rows), 128)])
        values, vectors = np.linalg.eigh(land @ land.T)
        able = values > 1e-6 * values.max()
        root = vectors[:, able] / np.sqrt(values[able])
        w, bias = train_svm(kernel @ root, y)
        weights = np.zeros(TABLE, dtype=np.float32)
        weights[columns] = (root @ w) @ land
        value = features.sums(weights) + bias
        # witnesses: where a toxic text has no telling word, its worst one, if it is much like one and in no clean text
        telltale = set(telling.tolist())
        others = [bag[np.argmax(value[bag])] for bag, y in zip(bags, toxic, strict=True) if y and len(bag) and telltale.isdisjoint(bag.tolist())]
        others = np.array([i for i in others if value[i] > ALIKE and n_clean[i] == 0], dtype=int)
        positive = np.union1d(telling, others)
        # negatives: the clean words that look worst so far; those that look like telling ones may be mislabelled, and count by their number
        looks = clean[np.argsort(-value[clean], kind="stable")[:2000]]
        worst = looks[(value[looks] < ALIKE) | (n_clean[looks] > 3 * n_toxic[looks] + 1)][:600]
    low, high = float(np.quantile(value[clean], 0.999)), float(np.quantile(value[telling], 0.05))
    return ToxicityModel(weights, bias, 4.0, float(np.clip((low + high) / 2, -0.5, high - MARGIN)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_texts: int = TRAIN_TEXTS) -> ToxicityModel | None:
    """Learns from labelled texts whose id :func:`trained_on` admits; labels (doc_id, toxic), null labels don't count."""
    known = labels.where(trained_on("doc_id") & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, train_texts / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < round(share * (1 << 20)))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(trained_on("doc_id") & F.col("text").isNotNull())
    texts = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < round(share * (1 << 20)))
    # of a very long text the distinct words are all that counts, up to TRAIN_CHARS of them; scoring reads whole texts
    sample = texts.join(known.hint("shuffle_hash"), "doc_id").select("doc_id", "toxic", F.substring(F.array_join(F.array_distinct(F.split(F.lower("text"), r"\s+")), " "), 1, TRAIN_CHARS).alias("words"))
    rows = sample.toPandas().sort_values(["doc_id", "words"], kind="stable")
    return fit_on(rows["words"].tolist(), rows["toxic"].to_numpy(int) == 1) if len(rows) else None


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    A null or empty text scores as one without words; without a model every score is 0. Only the text
    decides; repeated rows each get a row, and a row without an id is scored too, as not held out; other
    columns are ignored. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, limit=1 << 20):
            texts = [t or "" for t in b.column(1).to_pylist()]
            score = shared.value.score(texts) if shared.value is not None else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], ["doc_id", "score"])

    out = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, score double")
    return out.select("doc_id", F.coalesce(~trained_on("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel | None, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text scores THRESHOLD or more; all columns as they were.

    Each row is judged by its own text: rows that repeat an id, or have none, go or stay by themselves,
    and null and empty texts stay. An empty table stays empty.
    """
    shared, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, text_col, 1 << 20):
            texts = [t or "" for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            keep = shared.value.score(texts) < THRESHOLD if shared.value is not None else np.ones(len(texts), dtype=bool)
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)
