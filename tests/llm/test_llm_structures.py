"""Merkle manifests, conversation repair and secret scans against plain versions of their contracts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skylattice.llm import conversation_repair as repair
from skylattice.llm import merkle_manifest as merkle
from skylattice.llm import queries, secret_scan, toxicity
from skylattice.llm.common import text_bytes

DATA = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.collect())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def with_clashes(df, names):
    return df.select("*", *[F.lit(7).alias(c) for c in names if c not in df.columns]).repartition(3)


# Merkle manifests


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def sides(levels, i):
    for level in levels[:-1]:
        low = i - i % 8
        yield "".join(level[low:i]), "".join(level[i + 1 : low + 8])
        i //= 8


def manifest(rows):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(((r[0] is not None, r[0] or 0, leaf(r)), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda x: x[0])
    trees = {g: tree([x[0][2] for x in groups[g]]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    for k, g in enumerate(names):
        for i, (_, r) in enumerate(groups[g]):
            path = [*sides(trees[g], i), *sides(top, k)]
            own = folded = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                folded = leaf((*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4])))
            for a, b in path:
                folded = sha(a + folded + b)
            yield r[0], own, trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), folded, folded == top[-1][0]


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def made(n, langs):
    pick = random.Random(n)
    return [(i, "s", pick.choice(langs), 3, f"Text {i}") for i in range(n)]


@pytest.mark.parametrize(
    "rows, levels",
    [
        ([], 4),
        (made(1, ["en"]), 4),
        (made(8, ["en"]), 4),
        (made(9, ["en"]), 4),
        (made(500, ["en", "de", None, "", "é"]) + [(5, None, None, None, None)] * 3 + [(None, "x", "en", 1, "A"), (None, "", "en", 0, "")], 4),
        (made(4097, ["en"] * 9 + ["fr"]), 4),
        (made(600, ["en"] * 9 + ["fr", "z"]), 1),  # four stages
        (made(100, [f"l{i}" for i in range(90)]), 1),
    ],
)
def test_manifest(spark, rows, levels):
    docs = with_clashes(spark.createDataFrame(rows, DOCS), ("leaf", "digest", "grp", "idx", "n", "pos", "level", "path", "chunk", "root"))
    assert rows_of(merkle.merkle_manifest(docs, levels=levels)) == sorted(str(r) for r in manifest(rows))


def test_manifest_of_the_whole_table(spark):
    docs = queries.table(spark, DATA, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    assert rows_of(queries.op11_merkle_manifest(spark, DATA)) == sorted(str(r) for r in manifest([tuple(r) for r in docs.collect()]))


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 100, 513])
def test_positions_are_those_of_a_postorder_walk(n):
    order, height = [], merkle.height(n)

    def walk(level, idx):
        if level:
            below = -(-n // 8 ** (level - 1))
            for child in range(8 * idx, min(8 * idx + 8, below)):
                walk(level - 1, child)
        order.append((level, idx))

    walk(height, 0)
    assert [merkle.position(n, *node) for node in order] == list(range(len(order)))


# conversation repair


def damaged(rows):
    for conv, turn, role, text in rows:
        one = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else one(role), "" if kind == 1 else one(text)
        text = re.sub("[.!?]", "", text) if kind == 2 else text
        yield from [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def faults_of(rows):
    seen, out = set(), ""
    for role, text in rows:
        solid = text.strip(SPACE)
        out += "b" if not solid else "d" if (role, text) in seen else "." if solid[-1] in ".!?" else "t"
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Tries every sequence of edits that costs no more than the best one so far."""
    best = (3 * len(rows), "D" * len(rows), [])

    def go(i, lines, cost, audit, last):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(rows) and last in ("", "a"):
            best = min(best, (cost, audit, lines))
        fits = {"u": last in ("", "s", "a"), "a": last == "u", "s": last == "" and not lines}
        names = {"u": "user", "a": "assistant"}
        for r in names:
            if fits[r]:
                go(i, [*lines, f"{names[r]}:"], cost + 2, audit + "I", r)
        if i == len(rows):
            return
        (role, text), extra = rows[i], int(faults[i] == "t")
        go(i + 1, lines, cost + 3, audit + "D", last)
        if faults[i] in "bd":
            return
        if fits.get(role[:1]):
            go(i + 1, [*lines, f"{role}:{text}"], cost + extra, audit + "K", role[0])
        for r in names:
            if fits[r]:
                go(i + 1, [*lines, f"{names[r]}:{text}"], cost + 2 + extra, audit + "R", r)

    go(0, [], 0, "", "")
    return best


def repaired(talks):
    convs = {r[0]: [] for r in talks}
    for r in damaged(talks):
        convs[r[0]].append(r)
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        turns, pairs = [r[1] for r in rows if r[1] is not None], [r[2:] for r in rows]
        faults = faults_of(pairs)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:], strict=False))
        cost, audit, lines = cheapest(pairs, faults)
        yield conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *map(faults.count, "bdt"), illegal, cost, audit, sha("\n".join(lines))


TALKS = "conv_id long, turn long, role string, text string"


def test_repair(spark):
    pick, talks = random.Random(3), []
    for conv in [None, *range(120)]:
        for t in range(pick.randint(1, 6)):
            turn = pick.choice([t, t, t, None, t + 2])
            role = pick.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            talks.append((conv, turn, role, pick.choice(["a.", "b!", "c", "", "  ", None, "x?\n", "a.", f"n{t}.", "long " * 2000])))
    frame = with_clashes(spark.createDataFrame(talks, TALKS), ("block", "kind", "audit", "cost", "whole", "key", "keys", "n", "place"))
    assert rows_of(repair.repair_conversations(frame)) == sorted(str(r) for r in repaired(talks))
    assert repair.repair_conversations(spark.createDataFrame([], TALKS)).collect() == []


def test_repair_of_the_whole_table(spark):
    talks = [tuple(r) for r in queries.table(spark, DATA, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.op12_conversation_repair(spark, DATA)) == sorted(str(r) for r in repaired(talks))


def test_repair_of_a_conversation_over_many_blocks(spark):
    pick = random.Random(4)
    talks = [(1, t, pick.choice(["user", "assistant"]), f"{pick.choice('abcdefgh')}{pick.randint(0, 9000)}{pick.choice(['.', ''])}") for t in range(4000)]
    (got,) = repair.repair_conversations(spark.createDataFrame(talks, TALKS).repartition(5)).collect()
    rows = [r[2:] for r in damaged(talks)]
    faults = faults_of(rows)
    whole = repair.parse("".join(r[0][0] for r in rows), faults)
    assert (got["cost"], got["audit"]) == min((cost + repair.TAILS[k][0], audit + repair.TAILS[k][1]) for k, (cost, audit) in whole.items())
    assert [got["blank"], got["duplicate"], got["truncated"]] == [faults.count(f) for f in "bdt"]
    assert got["repaired_sha256"] == sha("\n".join(repair._lines(0, got["audit"], *map(list, zip(*rows, strict=True)))))


# secret scans

RULES = secret_scan.BASE + secret_scan.ADDED
#: The base rules as the contract writes them; lengths are judged after a match.
PLAIN = {"access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
PARTS = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", "api", " ", "  ", "=", ":", '"', "'", "abc", "0123456789abcdef", "deadbeef", "AKIA", "ABCD1234", "XYZ", "\n", "é", "漢", "hunter2hunter2", "-", "_", ".", "/", "eyJ", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "ghp_", "a" * 40, "://", "http", "user", "@", "xoxb-", "AIza", "sk_live_", "A" * 300, "f" * 3000, ","]


def secrets(text):
    found = []
    for number, rule in enumerate(RULES):
        for m in re.finditer(PLAIN.get(rule.kind, rule.pattern), text or ""):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), number, m.end()))
    return sorted(found)


def secret_row(doc_id, text):
    spans = secrets(text)
    shown = lambda some: ",".join(f"{RULES[k].kind}:{s}:{e}" for s, k, e in some)
    base = [x for x in spans if x[1] < 3]
    return doc_id, *[sum(x[1] == k for x in base) for k in range(3)], sha(shown(base)), shown(spans)


@pytest.fixture(scope="module")
def scanner():
    out = secret_scan.Scanner(RULES)
    out.prepare()
    return out


def test_automaton_on_random_texts(scanner):
    pick = random.Random(1)
    for _ in range(400):
        texts = ["".join(pick.choice(PARTS) for _ in range(pick.randint(0, 14))) for _ in range(8)]
        scanner.FEW, scanner.PIECE = pick.choice([0, 2, 24]), pick.choice([7, 50, 1024])
        raw, offsets = text_bytes(pa.array(texts))
        found = scanner.scan(raw, offsets)
        for i, text in enumerate(texts):
            assert secret_scan._code_points(raw[offsets[i] : offsets[i + 1]], found.get(i, [])) == secrets(text)


def test_a_match_that_is_too_short_uses_up_its_text(scanner):
    for text in ("token=abctoken: hunter2hunter2", "token==abcdefghijkl", "token='x' secret = 'abcdefghijklmnop'", "AKIAAKIA" + "B" * 10):
        raw, offsets = text_bytes(pa.array([text]))
        assert scanner.scan(raw, offsets).get(0, []) == secrets(text)


def test_automaton_is_minimal(scanner):
    for automaton in (scanner.back, scanner.ahead):
        _, block = np.unique(automaton.masks, return_inverse=True)
        while True:
            _, finer = np.unique(np.column_stack([block, block[automaton.table]]), axis=0, return_inverse=True)
            if finer.max() == block.max():
                break
            block = finer.reshape(-1)
        assert len(np.unique(block)) == len(automaton.masks)


def test_secrets(spark):
    rows = [(1, "token = 'abcdefghijkl1'"), (1, "token = 'abcdefghijkl1'"), (None, "ghp_" + "x" * 36), (2, None), (3, ""), (4, "é " * 50_000 + "0123456789abcdef" * 9000)]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"), ("spans", "n_hex", "kind", "base_sha256"))
    assert rows_of(secret_scan.find_secrets(docs)) == sorted(str(secret_row(*r)) for r in rows)
    assert secret_scan.find_secrets(docs.where("false")).collect() == []


def test_secrets_of_the_whole_table(spark):
    docs = queries.table(spark, DATA, "documents").select("doc_id", "text").collect()
    assert rows_of(queries.op13_secret_scan(spark, DATA)) == sorted(str(secret_row(*r)) for r in docs)


def test_manifest_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    answer = con.sql(queries.oracle_sql()["op11_merkle_manifest"])
    df = queries.op11_merkle_manifest(spark, DATA)
    assert answer.columns == df.columns
    assert rows_of(df) == sorted(str(tuple(r)) for r in answer.fetchall())


def test_toxicity_sums_do_not_depend_on_what_stands_beside_a_word():
    """Neither their value nor, but for a bound, their memory: running sums start again with each block of words."""
    import tracemalloc

    rng = np.random.default_rng(3)
    weights = rng.normal(size=toxicity.TABLE).astype(np.float32)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(1, 14, 30_000)]
    features = toxicity.WordFeatures([" ".join(words[:20_000]), "", " ".join(words[20_000:])])
    tracemalloc.start()
    together = features.sums(weights)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12e6  # of all characters at once: 18 MB and more
    some = range(0, 30_000, 601)
    assert np.allclose([toxicity.WordFeatures([words[i]]).sums(weights)[0] for i in some], together[list(some)], rtol=1e-9, atol=1e-9)
