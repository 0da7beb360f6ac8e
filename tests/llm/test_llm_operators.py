"""Each operator against a plain version, on hand-made and hard rows: nulls, empty and long texts, ties, repeats, other columns."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from brute import contaminated, exact, near, repeats, shared
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skylattice.llm import boosting, bpe, decontaminate, exact_dedup, language_id, near_dedup, pii, substring_dedup, suffix_dedup, toxicity, url_filter

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n long, h long, word string, label long, place int, seed long, size int"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark, texts):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, 7, 7, "x", 1, 3, 9, 5) for i, t in texts.items()], SCHEMA).repartition(3)


def rows(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def hard_texts():
    rng = random.Random(4)
    words = ["of", "the", "a", "stone", "river", "é", "ßtraße", "中文", "x1", "UP", "up"]
    make = lambda n: " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(n))
    base, passage = make(120), make(40)
    texts = {0: base, 1: base, 2: base.replace(" ", "\n", 3), 3: f"{make(20)} {passage} {make(30)}", 4: f"{passage} {make(15)}", 5: make(10) + passage, 6: None, 7: "", 8: " \t\n", 9: "one", 10: "One", 11: "the the " * 60, 12: "the the " * 61, 13: "a" * 900}
    for i in range(20, 40):
        w = base.split(" ")
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
        texts[i] = " ".join(w)
    texts[41] = base + " " + make(4000) + " " + passage
    for i in range(50, 58):
        texts[i] = make(rng.randrange(1, 7))
    return texts


@pytest.fixture(scope="module")
def texts():
    return hard_texts()


@pytest.mark.parametrize("length,span,cut,seed", [(400, 256, 16, None), (40, 24, 4, None), (40, 32, 16, None), (400, 160, 16, 97)])
def test_suffix_dedup(spark, texts, length, span, cut, seed):
    out = suffix_dedup.remove_repeats(table(spark, texts), length, span, cut, seed=seed)
    assert rows(out.drop("n_seeds")) == repeats(texts, length)
    seeds, removed = ({r["doc_id"]: r[c] for r in out.collect()} for c in ("n_seeds", "n_removed"))
    shorter = repeats(texts, seed or length - span + 1)
    assert all(seeds[i] > 0 for i in texts if removed[i])  # a repeated string takes its anchor along
    assert all(shorter[i][1] > 0 for i in texts if seeds[i])  # a seed is a repeated string of its own length


@pytest.mark.parametrize("window", [13, 8])
def test_substring_dedup(spark, texts, window):
    assert rows(substring_dedup.remove_shared(table(spark, texts), window)) == shared(texts, window)


def test_difference_cover():
    period, cover = substring_dedup.PERIOD, substring_dedup.COVER
    assert all(any((i + d) % period in cover and (j + d) % period in cover for d in range(period)) for i in range(period) for j in range(period))


@pytest.mark.parametrize("size", [1, 2, 5])
def test_near_dedup(spark, texts, size):
    assert rows(near_dedup.near_duplicates(table(spark, texts), size)) == near(texts, size)


def test_near_dedup_of_a_large_group(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    texts = {}
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 8)):
            w[rng.randrange(80)] = f"v{rng.randrange(10_000)}"
        texts[i] = " ".join(w)
    assert rows(near_dedup.near_duplicates(table(spark, texts), 2)) == near(texts, 2)


@pytest.mark.parametrize("rare", [False, True])
def test_near_dedup_of_texts_of_common_lines(spark, rare):
    """Every shared shingle is in a long list that one component dominates; with ``rare``, a pair shares one more of its own."""
    rng = random.Random(17)
    lines = [" ".join(["s", *(f"{c}{i}" for c in "abcde"), "s"]) for i in range(30)]
    chosen = [[*lines, f"q{i} s"] for i in range(200)]
    for i in range(150):
        some = rng.sample(lines, 12)
        chosen.append([*some, f"p{i}"] if rare else some)
        if i < 60:
            chosen.append([*chosen[-1][:5], f"s x{i} s", *chosen[-1][6:]])
    texts = {i: "\n".join(c) for i, c in enumerate(chosen)}
    want = near(texts, 2)
    assert sum(not kept for _, _, kept in want.values()) >= 199 + 60
    assert rows(near_dedup.near_duplicates(table(spark, texts), 2)) == want


def test_exact_dedup(spark, texts):
    assert rows(exact_dedup.exact_dedup(table(spark, texts))) == exact(texts)


def test_exact_dedup_with_colliding_keys(spark, texts):
    got = exact_dedup.exact_dedup(table(spark, texts), key_bits=3, capacity=4, max_depth=4)
    assert rows(got) == exact(texts)


def test_directory_doubles_where_it_is_full(spark):
    keys = spark.range(4000).select(F.xxhash64("id").alias("h")).union(spark.range(3000).select(F.lit(1).cast("long").alias("h")))
    got = exact_dedup.directory(keys, 600, 6).collect()
    assert len(got) == 64
    depth = {r["slot"]: r["local_depth"] for r in got}
    assert depth[0] == 6 and depth[63] < 6
    assert {r["bucket"] for r in got} <= set(range(64))


@pytest.mark.parametrize("operator", ["suffix", "substring", "near", "exact"])
def test_repeated_and_missing_ids(spark, operator):
    same = [(1, "a b c d e f g h i j k l m n"), (1, "a b c d e f g h i j k l m n"), (2, None), (2, "x"), (None, "a b c d e f g h i j k l m n")]
    df = spark.createDataFrame(same, "doc_id long, text string")
    run = {"suffix": lambda: suffix_dedup.remove_repeats(df, 20, 12, 4), "substring": lambda: substring_dedup.remove_shared(df), "near": lambda: near_dedup.near_duplicates(df, 2), "exact": lambda: exact_dedup.exact_dedup(df)}[operator]
    got = run().collect()
    assert len(got) == len(same)
    by = [r for r in got if r["doc_id"] == 1]
    assert by[0] == by[1]


@pytest.mark.parametrize("operator", ["suffix", "substring", "near", "exact", "bpe", "pii", "language", "toxicity", "bench", "url"])
def test_empty_tables(spark, operator):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels, bench, pages = spark.createDataFrame([], "doc_id long, toxic int"), spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "page_id long, url string")
    run = {
        "suffix": lambda: suffix_dedup.remove_repeats(docs), "substring": lambda: substring_dedup.remove_shared(docs), "near": lambda: near_dedup.near_duplicates(docs), "exact": lambda: exact_dedup.exact_dedup(docs),
        "bpe": lambda: bpe.bpe_digest(docs, VOCABULARY), "pii": lambda: pii.find_pii(docs), "language": lambda: language_id.identify_language(docs),
        "toxicity": lambda: toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)), "bench": lambda: decontaminate.contaminated(docs, bench), "url": lambda: url_filter.filter_urls(pages),
    }[operator]
    assert run().collect() == []


def test_bpe_equals_the_library(spark, texts):
    library = Tokenizer.from_file(VOCABULARY)
    ours = bpe.Bpe(VOCABULARY, cache=50)
    rng = random.Random(1)
    odd = list("ab 1'sé́\n\t\x85\xa0 ²½中文🙂\x1c_-.​٠Ⅷªº　﻿") + ["<|endoftext|>", "'ll", "'S", "  "]
    for text in [*(t for t in texts.values() if t), *("".join(rng.choices(odd, k=rng.randrange(1, 25))) for _ in range(3000))]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == ids
        assert ours.decode(ids) == library.decode(ids, skip_special_tokens=False)
        ours.digests([text, ""])
    docs = table(spark, texts)
    back = rows(bpe.bpe_decode(bpe.bpe_encode(docs, VOCABULARY), VOCABULARY))
    assert back == {i: (t or "",) for i, t in texts.items()}
    digests = rows(bpe.bpe_digest(docs, VOCABULARY))
    from brute import sha

    for i, t in texts.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert digests[i] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_pii_base_equals_the_patterns():
    import re

    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda t: re.sub("[^0-9]", "", t)
    ok = {"email": lambda t: True, "ip": lambda t: all(int(p) <= 255 for p in t.split(".")), "card": lambda t: 13 <= len(digits(t)) <= 19 and pii.luhn(digits(t)), "phone": lambda t: 9 <= len(digits(t)) <= 15}
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choices("ab1230.@@+- ().-9é", k=rng.randrange(60)))
        assert pii.base_spans(text) == [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, text) if ok[k](m[0])]


@pytest.fixture(scope="module")
def pii_model(spark):
    return pii.fit_pii(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_pii_adds_what_the_base_patterns_miss(spark, pii_model):
    """Made spans, none of which a base pattern finds, between words of texts that the trees have not seen there."""
    rng = random.Random(77)
    words = "the river ran past a quiet mill and nobody in town could say how old it was or who had built it".split()
    hit, total, false = {k: 0 for k in pii.ADDED}, {k: 0 for k in pii.ADDED}, 0
    for _ in range(2000):
        w = rng.choices(words, k=24)
        at = rng.randrange(4, 20)
        kind, value = pii.made_span(rng)
        lead = " ".join(w[:at]) + " "
        text, other = (lead + v + " " + " ".join(w[at:]) for v in (value, pii.made_other(rng)))
        base = pii.base_spans(text)
        if not base:
            total[kind] += 1
            hit[kind] += any(k == kind and s < len(lead) + len(value) and len(lead) < e for k, s, e in pii_model.select(text, base))
        false += bool(pii_model.select(other, pii.base_spans(other)))
    assert all(hit[k] >= 0.9 * total[k] > 50 for k in pii.ADDED), (hit, total)
    assert false <= 20


def test_pii_adds_spans_and_keeps_base_ones(spark, pii_model):
    texts = {1: "call (415) 555-2671 now", 2: None, 3: "mail a.b@c-d.org, 10.0.0.1", 4: "", 5: "write to jane (at) example (dot) org soon", 6: 'token = "8f3b1c9d7e2a4b6c8d0e1f2a3b4c5d6e7f809112"', 7: "version 4.0. of 2019-03-04 and 1,234,567 rows", 8: "word " * 20_000 + "+1 (415) 555-2671"}
    docs = table(spark, texts).union(table(spark, {3: texts[3]})).union(spark.createDataFrame([(None, "ip 10.0.0.1", *[None] * 7)], SCHEMA))
    got = [tuple(r) for r in pii.find_pii(docs, pii_model).collect()]
    assert len(got) == 10 and sum(r[0] == 3 for r in got) == 2 and sum(r[0] is None for r in got) == 1
    by = {r[0]: r[1:] for r in got}
    assert by[3][:4] == (1, 1, 0, 0) and by[3][5] == "email:5:16,ip:18:26" and by[2][:4] == (0, 0, 0, 0) and by[2][5] == by[4][5] == by[7][5] == ""
    assert by[None][5] == "ip:3:11" and by[8][5] == "phone:100000:100017"
    assert by[1][5] == "phone:5:19" and by[1][6] == 1 and by[5][5] == "email:9:36" and by[6][5] == "secret:9:49"
    clean = rows(pii.redact(docs, pii_model))
    assert clean[3] == ("mail [email], [ip]",) and clean[2] == (None,) and clean[1] == ("call [phone] now",)


def test_pii_fit_does_not_depend_on_the_order_of_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    one, two = (pii.fit_pii(d) for d in (docs.repartition(3), docs.orderBy(F.desc("doc_id"))))
    assert one.thresholds == two.thresholds and all((a == b).all() for x, y in zip(one.trees.grown, two.trees.grown, strict=True) for a, b in zip(x, y, strict=True))


def test_pii_fit_takes_every_candidate_of_whole_texts(spark):
    """Histograms and thresholds of the fit against those of all candidates of all documents, counted one by one."""
    rng = random.Random(9)
    texts = {i: "word " * rng.randrange(1, 9) + " and ".join(rng.choice([pii.made_span(rng)[1], pii.made_other(rng), "mail a.b@c.org", "+1 (415) 555-2671"]) for _ in range(4)) for i in range(900)}
    texts |= {1000: "word " * 6000 + "mail to zed@example.org", 1001: None, 1002: "", 1003: "no number at all"}
    found = pii.propose(table(spark, texts), made=0)
    got = {r["doc_id"]: r for r in found.collect()}
    plain = {i: pii.candidates(t or "") for i, t in texts.items()}
    assert all(pii._unpacked(got[i]["able"]) == plain[i] and len(got[i]["y"]) == len(plain[i]) for i in texts)
    assert got[1000]["y"] in (b"\1", b"\3") and plain[1000][0][1] > 30_000
    made = {r["doc_id"]: r for r in pii.propose(table(spark, texts), made=3).collect()}
    assert all(made[i]["x"].startswith(got[i]["x"]) and len(made[i]["y"]) > len(got[i]["y"]) for i in texts if texts[i])
    rows = [(x, y & 1, y >= 2) for r in got.values() for x, y in zip(np.frombuffer(r["x"], np.uint8).reshape(-1, 35), r["y"], strict=True)]
    x, y, held = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    examples = found.select("x", "y").repartition(7)
    trees = boosting.Boosted(groups=5, trees=2, depth=2).fit(examples, pii._rows)
    none = np.full((5, 3), -1)
    sums = boosting.added_up(examples, boosting.Boosted(groups=5)._counter(pii._rows, none, none, 0)).reshape(2, 35, 5, boosting.BINS)
    for j in range(35):
        for k in range(5):
            mine = (x[:, 0] == k) & ~held
            assert (sums[1, j, k] == np.bincount(x[mine, j], minlength=32) * boosting.UNIT // 4).all()
            assert (sums[0, j, k] == (np.bincount(x[mine, j], y[mine] - 0.5, 32) * boosting.UNIT).astype(int)).all()
    p = trees.probability(x)
    for k, cut in enumerate(trees.thresholds(examples, pii._rows, 0.5)):
        mine = (x[:, 0] == k) & held
        able = [c for c in np.floor(p[mine] * boosting.STEPS) / boosting.STEPS if (p[mine] >= c).sum() >= 20 and y[mine][p[mine] >= c].mean() >= 0.5]
        assert cut == min(able, default=2.0)
    assert len(set(np.round(p, 6))) > 5


def test_pii_fit_knows_rare_writings_of_all_documents(spark):
    """Candidates in one document of ten, most of them after 20,000 characters; a cut or a sample loses what they say."""
    rng = random.Random(5)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    secrets = {i: "word " * (5000 if i % 20 else 5) + f'token = "{digits(4)}-{digits(4)}-abcd" and ref {digits(4)}-{digits(4)}-abcd on' for i in range(0, 2000, 10)}
    docs = spark.createDataFrame([(i, secrets.get(i, "a word")) for i in range(2000)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(docs).collect()}
    assert len(got) == 2000 and all(got[i] == f"secret:{t.index('token') + 9}:{t.index('token') + 23}" for i, t in secrets.items())


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify_language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "le la des une où être" * 5000)], "doc_id long, text string")
    model = language_id.fit_languages(docs)
    assert [r["lang_pred"] for r in language_id.identify_language(odd, model).orderBy("doc_id").collect()] == ["und", "und", "und", "fr"]


def test_language_ngrams_stay_in_their_text():
    grams = language_id.Grams()
    alone = [sorted(code.tolist()) for _, code in grams.of(["abc"])]
    together = [sorted(code[text == 1].tolist()) for text, code in grams.of(["xyz", "abc", ""])]
    assert alone == together and [len(x) for x in alone] == [4, 3]


def test_language_pieces_make_no_difference(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model, texts = language_id.fit_languages(docs), [r[0] or "" for r in docs.select("text").limit(40).collect()]
    whole = model.score(language_id.Grams(), texts)
    monkeypatch.setattr(language_id, "PIECE", 37)
    monkeypatch.setattr(language_id, "CELLS", 50)
    cut = model.score(language_id.Grams(), texts)
    assert whole[0] == cut[0] and np.allclose(whole[1], cut[1], atol=1e-3)
    by_hand = np.tile(model.prior, (len(texts), 1))
    for i, t in enumerate(texts):
        for _, code in language_id.Grams().of([t]):
            by_hand[i] += model.log_prob[code].sum(axis=0)
    assert [model.languages[i] for i in by_hand.argmax(axis=1)] == whole[0]


def test_a_rare_language_is_learnt_and_too_many_are_refused(spark, monkeypatch):
    rows_ = [(i, f"the house of stone and the river {i}", "en") for i in range(3000)] + [(5000 + i, "zwolf boxkampfer jagen viktor quer", "de") for i in range(12)]
    docs = spark.createDataFrame([*rows_, (None, "zwolf jagen quer", "de"), (7, None, "en"), (8, "x", None)], "doc_id long, text string, lang string")
    model = language_id.fit_languages(docs, train_rows=200)
    got = {r["doc_id"]: r for r in language_id.identify_language(docs, model).collect()}
    assert got[5003]["lang_pred"] == "de" and got[5]["lang_pred"] == "en" and got[None]["lang_pred"] == "de" and not got[None]["held_out"] and got[7]["lang_pred"] == "und"
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError):
        language_id.fit_languages(docs)


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels)
    got = toxicity.score_toxicity(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    hit, true = got["predicted"] == 1, got["toxic"] == 1
    assert (hit & true).sum() / true.sum() >= 0.85 and (hit & ~true).sum() / (~true).sum() <= 0.03
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "You idiot"), (4, "word " * 20_000)], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(odd, model).collect()}
    assert score[1] == score[2] < 0.5 and score[3] >= 0.7 and score[4] < 0.7
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"])


def test_string_kernel_tolerates_an_inserted_character():
    def row(word):
        slot, weight = toxicity.WordFeatures([word]).rows()[0]
        out = np.zeros(toxicity.TABLE)
        np.add.at(out, slot, weight)
        return out

    base = row("stupid")
    assert base @ base == pytest.approx(1.0, abs=0.05)
    assert base @ row("stu-pid") > 0.4 > 0.1 > base @ row("meadow")


def test_decontamination(spark):
    rng = random.Random(5)
    make = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    items = {i: make(30) for i in range(5)}
    changed = list(items[1])
    for k in (4, 11, 17, 26):
        changed[k] = "other"
    texts = {0: " ".join(make(50) + items[0] + make(50)), 1: "  " + " ".join(changed).upper() + "\n", 2: " ".join(make(200)), 3: None, 4: "", 5: " ".join(items[2][:14] + make(40)), 6: " ".join(items[3][i] if i % 2 else "no" for i in range(30)), 7: " ".join(make(20_000) + items[4])}
    docs = table(spark, texts)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(9, None), (10, "too short")], "item_id long, text string")
    want = {(0, 0), (1, 1), (7, 4)}
    for limit in (decontaminate.BROADCAST_SEEDS, 0):
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench, broadcast_seeds=limit).collect()}
        assert want <= got <= want | {(5, 2)}
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert {2, 3, 4, 6} <= kept and not kept & {0, 1, 7}


def test_decontamination_equals_all_alignments(spark):
    docs, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    rng = random.Random(8)
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i, item in enumerate(items.values()):  # items with substituted words, and parts of items
        words = (item or "").split()
        changed = [w if rng.random() > 0.15 else "zzz" for w in words]
        texts[10_000 + i] = " ".join(["pre", *changed, "post"])
        texts[20_000 + i] = " ".join(words[len(words) // 3 :])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for limit in (decontaminate.BROADCAST_SEEDS, 0):
        got = {(r["doc_id"], r["item_id"]): (r["n_agree"], r["n_window"]) for r in decontaminate.contaminated(df, bench, broadcast_seeds=limit).collect()}
        assert got == contaminated(texts, items)
    assert len(got) > 30


def test_a_mask_hits_whatever_a_window_accepts():
    from itertools import combinations
    from math import ceil

    masks = [sum(1 << i for i, bit in enumerate(mask) if bit == "1") for mask in decontaminate.MASKS]
    for span in range(decontaminate.SPAN, decontaminate.WINDOW + 1):
        seeds = [mask << at for mask in masks for at in range(span - decontaminate.SPAN + 1)]
        for changed in combinations(range(span), span - ceil(span * decontaminate.AGREE)):
            wrong = sum(1 << i for i in changed)
            assert any(not seed & wrong for seed in seeds), (span, changed)


def test_decontamination_of_short_items(spark):
    make = lambda n, name: [f"{name}{i}" for i in range(n)]
    eleven = make(11, "e")
    changed = [w if i not in (4, 6) else "other" for i, w in enumerate(eleven)]
    five = make(5, "f")
    texts = {0: make(30, "x") + changed + make(30, "y"), 1: make(3, "x") + five, 2: [*five[:4], "other"], 3: ["Single"], 4: None, 5: [""], 6: five[1:] + make(9, "x")}
    docs = table(spark, {i: w and " ".join(w) for i, w in texts.items()})
    bench = spark.createDataFrame([(1, " ".join(eleven)), (2, " ".join(five)), (3, "single"), (4, None), (5, " ")], "item_id long, text string")
    for limit in (decontaminate.BROADCAST_SEEDS, 0):
        got = {(r["doc_id"], r["item_id"], r["n_agree"], r["n_window"]) for r in decontaminate.contaminated(docs, bench, broadcast_seeds=limit).collect()}
        assert got == {(0, 1, 9, 11), (1, 2, 5, 5), (3, 3, 1, 1)}


def test_url_rules(spark):
    urls = ["http://a.b.org/x", "https://ORG/", "http://example.org/es/1", "http://m.example.org/en/1932#t", "http://x.com/fr/1?q", "http://x.com/de/", "http://x.com", "http://notorg/", "http://forg/x", None, "no scheme/org/", "http://adult-x.net/", "http://casino.org/", "a://b://c.org/d", "http://x.org", "http://x.org/ES/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages).collect()}
    want = [("org/", "allow"), ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "block"), ("org/", "allow"), (None, "allow"), (None, "allow"), ("org/", "allow")]
    assert [got[i] for i in range(len(urls))] == want
