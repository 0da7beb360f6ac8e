"""Personal data: base patterns, and candidates selected by boosted trees.

High-recall generators propose overlapping spans: whatever may be an address, all runs of groups of
digits, and tokens that may be a secret. Trees score them by their format and context, and a threshold
for each kind, calibrated on held-out candidates, selects those to redact. What the base patterns find
always stays.

The trees are fitted on the candidates of all documents, and thresholds calibrated on them. Texts are not
labelled, so labels are made: spans that the base patterns confirm are personal data, so are long tokens
that are assigned to a name for a secret, and so are spans of ours that are put between the words of each document in writings that the base patterns don't know
(spelled-out signs, other separators, no plus, keys and passwords); numbers, versions, dates and names of
ours that are none, and all other candidates, are not. Proposals and examples are written once, as small
whole numbers; the fit adds up histograms of them in Spark's tasks, and the scoring reads them again.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.boosting import BINS, Boosted
from skylattice.llm.common import discard, sliced, written

KINDS = ("email", "ip", "card", "phone")
#: The trees also select keys, tokens and passwords; no base pattern finds these.
ADDED = (*KINDS, "secret")
#: Made spans and look-alikes that are put into each document, beside its own candidates; more into each of a few, so that there are MADE_ALL.
MADE, MADE_ALL = 2, 20_000
#: One document of so many calibrates.
HELD = 4
PRECISION = 0.98

#: The base patterns of the task, written so that no search starts inside a run that has failed.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Generators. Signs of an address: itself, in brackets, or spelled out between blanks.
_AT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: ?(?:@|\(at\)|\[at\]|\{at\}) ?| at | AT )[A-Za-z0-9-]{1,64}(?:(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?| dot | DOT )[A-Za-z0-9-]{1,64}){1,5}")
_HAS_AT = re.compile(r"@|[(\[{]at[)\]}]| at | AT ")
#: A run of digits and separators; its groups, up to GROUPS of them in a row, make the candidates.
_RUN = re.compile(r"[+(]?[0-9](?:(?:\[\.\]|[ ().\-/_ ]){0,3}[0-9])++")
_GROUP = re.compile(r"[0-9]+")
GROUPS = 6
#: A long token with letters and digits.
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{10,512}={0,2}")
_LETTER = re.compile(r"[A-Za-z]")
_CUES = {
    "email": re.compile(r"e-?mail|contact|write to|@", re.I),
    "ip": re.compile(r"\bip\b|host|server|address", re.I),
    "card": re.compile(r"card|visa|master|credit|payment", re.I),
    "phone": re.compile(r"phone|tel|call|fax|mobile", re.I),
    "secret": re.compile(r"key|token|secret|passw|pwd|auth|bearer|credential", re.I),
}
#: Confirms a token as a secret where the trees learn: what stands before it assigns it to a name for one.
_ASSIGNED = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?\Z", re.I)
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UPPER_ALNUM = re.compile(r"[A-Z0-9]+")
#: What a candidate is made of: digits, capitals, small letters, signs; candidates have no letters beyond ASCII.
_CLASSES = {i: "0" if chr(i).isdigit() else "A" if chr(i).isupper() else "a" if chr(i).islower() else "." for i in range(128)} | {0xA0: "."}
_SAME = re.compile(r"0+|[Aa]+|\.+")
_ALNUM_END, _NOT_ALNUM = re.compile(r"[A-Za-z0-9]*\Z"), re.compile(r"[^A-Za-z0-9]")
_AT_WORD, _DOT_WORD = re.compile(r"[(\[{ ](?:at|AT)[)\]} ]"), re.compile(r"[(\[{ ](?:dot|DOT)[)\]} ]")
_DIGIT_BEFORE, _DIGIT_AFTER = re.compile(r"[0-9][ .\-/)]\Z"), re.compile(r"[ .\-/(]?[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by kind as listed, then start; leftmost and non-overlapping in each kind."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", m.end() if m else at + 1)
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := re.sub(r"[ -]", "", m[0])) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def candidates(text: str) -> list[Span]:
    """Overlapping proposals: address-like spans, groups of digits in a row as each kind of number, long tokens."""
    out: list[Span] = []
    if _HAS_AT.search(text):
        out += [("email", m.start(), m.end()) for m in _AT.finditer(text)]
    for m in _RUN.finditer(text):
        if m.end() - m.start() < 7:
            continue
        groups = [(g.start(), g.end()) for g in _GROUP.finditer(text, m.start(), m.end())]
        for i in range(len(groups)):
            digits = 0
            for j in range(i, min(len(groups), i + GROUPS)):
                digits += groups[j][1] - groups[j][0]
                start, end, parts = groups[i][0], groups[j][1], j - i + 1
                if digits > 19:
                    break
                if parts == 4 and digits <= 12:
                    out.append(("ip", start, end))
                if digits >= 13:
                    out.append(("card", start, end))
                if 7 <= digits <= 15:
                    lead = start
                    while lead > 0 and text[lead - 1] in "+(" and start - lead < 2:
                        lead -= 1
                    out.append(("phone", lead, end))
    for m in _TOKEN.finditer(text):
        if _LETTER.search(m[0]):
            out.append(("secret", m.start(), m.end()))
    return out


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    kind, start, end = span
    body, before, after = text[start:end], text[max(0, start - 32) : start], text[end : end + 1]
    numbers = _GROUP.findall(body)
    groups, digits = [len(g) for g in numbers], "".join(numbers)
    letters = body.translate(_CLASSES)
    last = _ALNUM_END.search(body)[0]
    separators = set(_NOT_ALNUM.findall(body))
    return [
        float(ADDED.index(kind)), len(body), len(digits), letters.count("A"), letters.count("a"), len(set(body)) / max(1, len(body)), (len(_SAME.findall(letters)) - 1) / max(1, len(body)),
        len(groups), max(groups, default=0), min(groups, default=0), groups[0] if groups else 0, groups[-1] if groups else 0,
        body.count("."), body.count("-"), body.count(" "), body.count("(") + body.count("["), body.count("/"), body.count("@"), len(separators),
        len(last) if last.isalpha() else 0, float(bool(_AT_WORD.search(body))), float(bool(_DOT_WORD.search(body))),
        float(body[:1] == "+"), float(len(digits) >= 13 and luhn(digits)), max((int(g) for g in numbers if len(g) < 5), default=9999),
        float(bool(_HEX.fullmatch(body))), float(bool(_UPPER_ALNUM.fullmatch(body))),
        float(before[-1:].isalnum()), float(before[-1:] in "+-./(@#$€_"), float(before[-1:] in "=:\"'"), float(bool(_DIGIT_BEFORE.search(before[-2:]))),
        float(bool(_CUES[kind].search(before))), float(after.isalnum()), float(after in "-/_%"), float(bool(_DIGIT_AFTER.match(text[end : end + 2]))),
    ]


def _letters(rng: random.Random, n: int, alphabet: str) -> str:
    return "".join(rng.choices(alphabet, k=n))


def _card(rng: random.Random, n: int, valid: bool = True) -> str:
    digits = _letters(rng, n - 1, "0123456789")
    good = next(c for c in "0123456789" if luhn(digits + c))
    return digits + (good if valid else str((int(good) + rng.randrange(1, 10)) % 10))


def made_span(rng: random.Random) -> tuple[str, str]:
    """A kind and a made piece of personal data, mostly in a writing that the base patterns don't know."""
    small, alnum = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    kind = rng.choice(ADDED)
    if kind == "email":
        name = _letters(rng, rng.randrange(3, 9), small) + rng.choice(["", "", ".", "_"]) + _letters(rng, rng.randrange(1, 6), small + "0123456789")
        host = [_letters(rng, rng.randrange(3, 9), small) for _ in range(rng.choice([1, 1, 2]))] + [rng.choice(["com", "org", "net", "de", "fr", "io", "co", "edu", "info"])]
        at, dot = rng.choice([(" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "."), (" at ", " dot "), (" AT ", " DOT "), (" @ ", "."), (" (at) ", "."), ("{at}", "{dot}"), ("@", " . ")])
        return kind, name + at + dot.join(host)
    if kind == "ip":
        return kind, rng.choice(["[.]", " . ", "-", " ", "."]).join(str(rng.randrange(256)) for _ in range(4))
    if kind == "card":
        digits = _card(rng, 16)
        groups = [digits[i : i + 4] for i in range(0, 16, 4)]
        return kind, rng.choice([".", "/", "  ", "_", " ", " - ", "-", ""]).join(groups)
    if kind == "phone":
        a, b, c = (_letters(rng, n, "23456789") for n in (3, 3, 4))
        cc = str(rng.choice([1, 33, 34, 44, 49]))
        return kind, rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{cc} {a} {b} {c}", f"{cc} ({a}) {b}-{c}", f"0{a} {b}{c}", f"{cc}-{a}-{b}-{c}", f"+{cc}/{a}/{b}{c}", f"+{cc} ({a}) {b}-{c}", f"({a}) {b} {c}"])
    hexed, capitals = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    value = rng.choice([lambda: _letters(rng, 4, capitals[:26]) + _letters(rng, 16, capitals), lambda: _letters(rng, rng.choice([18, 20, 32, 40, 64]), hexed), lambda: _letters(rng, rng.randrange(16, 45), alnum), lambda: rng.choice(["sk-", "ghp_", "xoxb-", "pk_live_"]) + _letters(rng, rng.randrange(24, 41), alnum), lambda: _letters(rng, 40, alnum + "+/")])()
    return kind, value if any(c.isdigit() for c in value) and any(c.isalpha() for c in value) else value + "7k"


def made_other(rng: random.Random) -> str:
    """What looks a little like personal data and is none."""
    number = lambda a, b: str(rng.randrange(a, b))
    word = lambda: _letters(rng, rng.randrange(3, 9), "abcdefghijklmnopqrstuvwxyz")
    return rng.choice([
        lambda: f"{number(1990, 2030)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}", lambda: f"{rng.randrange(1, 29):02d}.{rng.randrange(1, 13):02d}.{number(1950, 2030)}",
        lambda: f"{rng.randrange(24):02d}:{rng.randrange(60):02d}:{rng.randrange(60):02d}", lambda: f"{number(1990, 2030)}-{number(1990, 2030)}", lambda: f"{number(1, 20)}.{number(0, 30)}.{number(0, 99)}",
        lambda: number(10**6, 10**9), lambda: number(10**9, 10**12), lambda: f"{number(1, 999)},{number(100, 999)},{number(100, 999)}", lambda: f"{number(1, 10**6)}.{number(10, 99)}",
        lambda: f"{number(1, 300)} {number(1, 300)} {number(1, 300)}", lambda: f"{number(300, 999)}.{number(300, 999)}.{number(300, 999)}.{number(300, 999)}",
        lambda: _card(rng, rng.randrange(13, 20), valid=False), lambda: " ".join(_card(rng, 16, valid=False)[i : i + 4] for i in range(0, 16, 4)),
        lambda: f"pp. {number(1, 500)}-{number(1, 500)}", lambda: f"{word()} at {word()} dot", lambda: f"{word()} at {word()}", lambda: f"ISBN 978-{number(0, 9)}-{number(10, 99)}-{number(100000, 999999)}-{number(0, 9)}",
        lambda: f"{word()}-{word()}-{number(1, 99)}", lambda: f"{word()}_{number(1, 999)}_{word()}", lambda: f"/{word()}/{word()}/{number(1, 99)}/{word()}", lambda: f"{word()}{number(1, 9)}{word()}{word()}",
        lambda: f"v{number(1, 9)}.{number(1, 9)}.{number(1, 99)}-{word()}", lambda: f"{number(1, 9)} {number(1, 9)} {number(10, 99)} {number(1, 9)} {number(100, 999)}",
    ])()


#: Features of a candidate.
_WIDTH = 35
#: Where the bins of features end. Counts and lengths; parts of one; the largest number of up to four digits.
_COUNTS = np.array([*range(21), 22, 24, 28, 32, 39, 40, 48, 64, 128, 256], dtype=float)
_SHARES = np.arange(1, BINS) / BINS
_NUMBERS = np.array([9, 12, 19, 31, 59, 99, 127, 199, 255, 299, 365, 499, 599, 799, 999, 1499, 1899, 1949, 1989, 2030, 2099, 4999, 9998], dtype=float)


def binned(text: str, spans: list[Span]) -> bytes:
    """The features of candidates of a text, a byte for each."""
    out = []
    for i in range(0, len(spans), 2048):
        x = np.array([features(text, c) for c in spans[i : i + 2048]], dtype=float)
        z = np.searchsorted(_COUNTS, x).astype(np.uint8)
        z[:, 0] = x[:, 0]
        z[:, 5:7], z[:, 24] = np.searchsorted(_SHARES, x[:, 5:7]), np.searchsorted(_NUMBERS, x[:, 24])
        out.append(z.tobytes())
    return b"".join(out)


def _packed(spans: list[Span]) -> bytes:
    return np.array([(ADDED.index(k), s, e) for k, s, e in spans], dtype=np.int32).tobytes()


def _unpacked(packed: bytes) -> list[Span]:
    return [(ADDED[k], s, e) for k, s, e in np.frombuffer(packed, dtype=np.int32).reshape(-1, 3).tolist()]


@dataclass
class PiiModel:
    trees: Boosted
    thresholds: dict[str, float]

    def passing(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of candidates, and whether they pass their kind's threshold."""
        p = self.trees.probability(x)
        return p, p >= np.array([self.thresholds[k] for k in ADDED])[x[:, 0]]

    def select(self, text: str, base: list[Span]) -> list[Span]:
        """Candidates that pass their kind's threshold and overlap neither the base spans nor better ones."""
        able = candidates(text)
        p, passed = self.passing(np.frombuffer(binned(text, able), dtype=np.uint8).reshape(-1, _WIDTH))
        return _best([able[i] for i in np.flatnonzero(passed)], p[passed], base)


def _best(able: list[Span], p: np.ndarray, base: list[Span]) -> list[Span]:
    """Of the given candidates the likeliest, then longest, then first ones, that overlap neither ``base`` nor each other."""
    if not able:
        return []
    taken = np.zeros(max(e for _, _, e in [*able, *base]), dtype=bool)
    for _, s, e in base:
        taken[s:e] = True
    out: list[Span] = []
    for i in sorted(range(len(able)), key=lambda i: (-p[i], able[i][1] - able[i][2], able[i][1], able[i][0])):
        _, s, e = able[i]
        if not taken[s:e].any():
            taken[s:e] = True
            out.append(able[i])
    return out


def _examples(text: str, base: list[Span], able: list[Span], seed: int, made_spans: int) -> tuple[bytes, list[bool]]:
    """Features and labels of the candidates of a text, then of made spans between its words."""
    ends = {(k, s): e for k, s, e in base}
    # the generators' ends may differ from the base pattern's by a sign or a bracket
    y = [any(abs(ends.get((k, s + d), -9) - e) <= 1 for d in range(-4, 5)) or (k == "secret" and e - s >= 12 and bool(_ASSIGNED.search(text[max(0, s - 32) : s]))) for k, s, e in able]
    x = [binned(text, able)]
    rng = random.Random(seed)
    for _ in range(made_spans):
        kind, value = made_span(rng) if rng.random() < 0.6 else ("", made_other(rng))
        at = text.find(" ", rng.randrange(len(text))) + 1
        cue = rng.choice(["", "", "", {"email": "mail ", "ip": "host ", "card": "card ", "phone": "tel. ", "secret": rng.choice(["key=", 'token = "', "password=", "api_key: "])}.get(kind, rng.choice(["no. ", "id ", "order ", "id=", "see "]))])
        end = '"' if cue.endswith('"') else rng.choice(["", "", ".", ","])
        beside = [made_span(rng)[1] + " " if rng.random() < 0.15 else "" for _ in range(2)]
        lead = text[max(0, at - 60) : at] + beside[0] + cue
        made, start = lead + value + end + " " + beside[1] + text[at : at + 60], len(lead)
        near = [c for c in candidates(made) if c[1] < start + len(value) and start < c[2]]
        x.append(binned(made, near))
        y += [c == (kind, start, start + len(value)) for c in near]
    return b"".join(x), y


def propose(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", made: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, base, able, x, y. Base spans and candidates; features and labels of these and of made spans.

    Labels of the documents that calibrate have 2 added.
    """
    made = max(MADE, math.ceil(MADE_ALL / max(1, docs.count()))) if made is None else made
    text = F.col(text_col)
    seed, held = F.xxhash64(F.col(id_col), F.substring(text, 1, 100)), F.pmod(F.xxhash64(text), F.lit(HELD)) == HELD - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, limit=1 << 20):
            out: list[list[bytes]] = [[], [], [], []]
            for t, seed, held in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                base, able = (base_spans(t), candidates(t)) if t else ([], [])
                x, y = _examples(t, base, able, seed, made) if t else (b"", [])
                for o, v in zip(out, (_packed(base), _packed(able), x, (np.array(y, dtype=np.uint8) + 2 * held).astype(np.uint8).tobytes()), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(o, pa.binary()) for o in out)], ["doc_id", "base", "able", "x", "y"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), seed.alias("seed"), held.alias("held"))
    return rows.mapInArrow(run, "doc_id bigint, base binary, able binary, x binary, y binary")


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8)
    x = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint8)
    return x.reshape(-1, _WIDTH), y & 1, y >= 2


def fit_proposed(table: DataFrame) -> PiiModel:
    """Fits on all examples of a written table of :func:`propose`; documents that are held out calibrate."""
    examples = table.where(F.length("y") > 0).select("x", "y")
    trees = Boosted(groups=len(ADDED), trees=20, depth=5).fit(examples, _rows)
    found = trees.thresholds(examples, _rows, PRECISION) if trees.grown else [2.0] * len(ADDED)
    return PiiModel(trees, {k: max(0.5, t) for k, t in zip(ADDED, found, strict=True)})


def fit_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", made: int | None = None) -> PiiModel:
    """Fits on the candidates of all of ``docs``, whole texts, and on ``made`` made spans or look-alikes in each of them (None: MADE, more where documents are few)."""
    table = written(propose(docs, id_col, text_col, made), "pii")
    model = fit_proposed(table)
    discard(table)
    return model


def written_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (ADDED.index(x[0]), x[1], x[2])))


def find_pii(docs: DataFrame, model: PiiModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The counts and the digest are those of the base spans; ``spans`` has these and the n_added spans
    that the trees add (of the same kinds, or "secret"), which overlap no base span. Positions are code
    points. A null text counts as empty; repeated rows and rows without an id each get a row; other
    columns are ignored. Of candidates that overlap, the likeliest is added, then the longest, then the
    first. Without ``model`` one is fitted on all of ``docs`` first, by way of a
    table in the shared folder. An empty table gives an empty result.
    """
    if model is None:
        table = written(propose(docs, id_col, text_col), "pii")
        model = fit_proposed(table)
    else:
        table = propose(docs, id_col, text_col, made=0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "x", 8 << 20):
            counts, digests, spans, added = [], [], [], []
            packed = b.column(2).to_pylist()
            sizes = np.array([len(a) // 12 for a in packed], dtype=np.int64)
            # a document's own candidates come first in its features
            p, passed = shared.value.passing(np.concatenate([np.frombuffer(x, np.uint8, n * _WIDTH) for x, n in zip(b.column(3).to_pylist(), sizes, strict=True)] or [np.zeros(0, np.uint8)]).reshape(-1, _WIDTH))
            at = 0
            for held, able, n in zip(b.column(1).to_pylist(), packed, sizes, strict=True):
                base, more = _unpacked(held), []
                some = np.flatnonzero(passed[at : at + n])
                if len(some):
                    proposed = _unpacked(able)
                    more = _best([proposed[i] for i in some], p[at + some], base)
                at += n
                kinds = [k for k, _, _ in base]
                counts.append([kinds.count(k) for k in KINDS])
                digests.append(hashlib.sha256(written_spans(base).encode()).hexdigest())
                spans.append(written_spans(base + more))
                added.append(len(more))
            n = np.array(counts, dtype=np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(n[:, i]) for i in range(len(KINDS))), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"
    return table.select("doc_id", "base", "able", "x").mapInArrow(run, schema)


def redact(docs: DataFrame, model: PiiModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text: the texts with every found span replaced by its kind in brackets; null stays null."""
    model = model or fit_pii(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(t: str | None) -> str | None:
        if t is None:
            return None
        base = base_spans(t)
        out, at = [], 0
        for k, s, e in sorted(base + shared.value.select(t, base), key=lambda x: (x[1], -x[2])):
            if e > at:
                out += [t[at : max(s, at)], f"[{k}]"]
                at = e
        return "".join([*out, t[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([clean(t) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, text string")
