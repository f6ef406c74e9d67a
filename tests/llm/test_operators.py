"""Small fixtures with nulls, empty and long texts, repeated rows, and clashing column names, against brute force."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loomset.llm import common, cotraining, idfiles, jaccard, langid, lattice, lines, mixing, neighbours, packing, rules

WORD = re.compile(r"[^\x20\x09-\x0d]+").findall
BASE = " ".join(f"alpha{i} beta{i} gamma" for i in range(30))
TEXTS = [
    (1, BASE, "en", "a", 1), (2, BASE + " tail", "en", "a", 1), (3, BASE.upper(), "de", "b", None), (4, "", "en", None, 0), (5, None, None, "a", 0), (6, "  \n\t ", "fr", "b", 5),
    (7, "one two three", "en", "a", 3), (8, "one two three", "en", "b", 3), (8, "one two three", "en", "b", 3), (9, "día über naïve don't 12,345 \n same line here now ok\n same line here now ok", "es", "c", 9),
    (None, "nobody knows this one at all", "en", "c", 1), (10, " ".join(f"w{i % 977}" for i in range(30_000)), "en", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rank long, row string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, 0, "x") for r in TEXTS], SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().lower().split()


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(TEXTS) and mixing.mix(empty).count() == 0
    by = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source_size"], r["target"]] += r["taken"]
    assert all(abs(t - target) <= 1 for (_, target), t in by.items())
    total = sum(len(WORD(t[1] or "")) for t in TEXTS)
    assert abs(sum(r["taken"] for r in got) - 1.5 * total) <= 4
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert sum(len(WORD(r["text"] or "")) for r in out.collect()) == sum(r["taken"] for r in got)


@pytest.mark.parametrize("top", [1, 2, 60, 5000, 50_000, 2**33, 2**64 - 1])
def test_word_aligned_codes(top):
    rng = np.random.default_rng(top % 97)
    for n in (0, 1, 61, 4096, 9001):
        a = rng.integers(0, top, n, dtype=np.uint64, endpoint=True)
        w, offsets = idfiles.encode(a)
        assert (idfiles.decode(w) == a).all()
        assert (idfiles.decode_range(w, offsets, n // 3, n // 2) == a[n // 3 : n // 2]).all()


def test_token_files(spark, docs, empty, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    idfiles.write_ids(docs, f"file://{tmp_path}/ids", path)
    got = sorted(idfiles.read_ids(spark, f"file://{tmp_path}/ids").collect(), key=lambda r: r["start"])
    tok, start = Tokenizer.from_file(path), 0
    want = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0))
    for r, t in zip(got, want, strict=True):
        ids = [*tok.encode(t[1] or "", add_special_tokens=False).ids, 1]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (t[0], start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4"))
        start += len(ids)
    idfiles.write_ids(empty, f"file://{tmp_path}/none", path)
    assert idfiles.read_ids(spark, f"file://{tmp_path}/none").count() == 0


def test_packing(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack(docs, path).collect()
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    tok = Tokenizer.from_file(path)
    assert sum(r["length"] for r in got) == sum(len(tok.encode(t[1] or "").ids) + 1 for t in TEXTS)
    assert packing.pack(empty, path).count() == 0


def test_line_dedup(spark, docs, empty):
    out = lines.dedup_lines(docs)
    assert out.count() == len(TEXTS) and lines.deduped(empty).count() == 0
    long = " ".join(f"word{i}" for i in range(90))
    near = long.replace("word40", "wort40")
    d = spark.createDataFrame([(2, f"{near}\nmine"), (1, f"{long}\nother"), (3, f"Other!\n{long}\n***\n***"), (4, None), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["removed"]) for r in lines.dedup_lines(d).select("doc.doc_id", "doc.text", "removed").collect()}
    assert got[1] == (f"{long}\nother", []) and got[3] == ("***\n***", [0, 1]) and got[4] == (None, []) and got[5] == ("", [])
    hashes = lambda t: [r["x"] for r in spark.createDataFrame([(w,) for w in t.split()], "w string").select(F.xxhash64("w").alias("x")).collect()]
    def sim(h):
        return sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))
    close = bin(sim(hashes(long)) ^ sim(hashes(near))).count("1") <= lines.DISTANCE
    assert got[2] == (("mine", [0]) if close else (f"{near}\nmine", []))


def test_jaccard(docs, empty):
    got = jaccard.similar(docs, size=4, percent=85).collect()
    assert jaccard.similar(empty).count() == 0
    sets = []
    for t in TEXTS:
        w = words(t[1])
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    group = list(range(len(TEXTS)))
    for i, j in itertools.combinations(group.copy(), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 85 * len(a | b):
            x, y = group[i], group[j]
            group = [x if g == y else g for g in group]
    least = {g: min((TEXTS[i][0] for i in range(len(TEXTS)) if group[i] == g and TEXTS[i][0] is not None), default=None) for g in set(group)}
    want = Counter((TEXTS[i][0], len(sets[i]), least[group[i]]) for i in range(len(TEXTS)))
    assert Counter(tuple(r) for r in got) == want


def test_jaccard_chain(spark):
    """A large group of near copies: links between all must be found without listing all pairs."""
    body = [f"t{i}" for i in range(120)]
    rows = [(k, " ".join(body[:k] + [f"x{k}"] + body[k + 1 :])) for k in range(0, 120, 3)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["component_id"] for r in jaccard.similar(d, size=4, percent=85).collect()} == {0}


def test_lattice(docs, empty):
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    got = lattice.lattice_score(docs, ~held, public_tokenizers.path("piece_bpe_32k.model")).collect()
    train = [t for t in TEXTS if t[0] is None or zlib.crc32(str(t[0]).encode()) % 7 != 2]
    c = Counter(w for t in train for w in [*words(t[1]), None])
    n, v = sum(c.values()), len(c)
    want = sorted((sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words(t[1]), None]), len(words(t[1])) + 1) for t in TEXTS)
    for r, (b, k) in zip(sorted(got, key=lambda r: (r["base_score"], r["n_tokens"])), want, strict=True):
        assert r["n_tokens"] == k and math.isclose(r["base_score"], b, rel_tol=1e-9) and r["train_tokens"] == n and -1e9 < r["score"] <= 0
    assert lattice.lattice_score(empty, ~held, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_lattice_sums_all_segmentations():
    p = lattice.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    own = {t: i for i, t in enumerate(p.texts) if i not in set(p.byte_ids.tolist())}

    def brute(t):
        if not t:
            return 1.0
        return sum(math.exp(p.logp[own[t[:k]]]) * brute(t[k:]) for k in range(1, len(t) + 1) if t[:k] in own)

    assert math.isclose(p.words([b"thing"], p.logp)[0], math.log(brute("▁thing")), rel_tol=1e-9)


def test_classifier(spark, docs, empty):
    rows = [(i, ("BUY NOW!! " if i % 3 == 0 else "quiet prose about things ") * 20 + ("idiot moron " if i % 5 == 0 else "") + f"n{i}", "en", f"s{i % 4}", 100) for i in range(240)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in cotraining.score(d, cotraining.fit(d, labels)).collect()}
    assert all(got[i]["kept"] == (i % 3 != 0 and i % 5 != 0) for i in range(200, 240))
    kept = cotraining.kept_documents(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == len(TEXTS)
    assert cotraining.kept_documents(empty, labels).count() == 0


def test_rules(docs, empty):
    got = rules.judge(rules.counts(docs)).collect()
    want = Counter()
    for t in TEXTS:
        text = t[1] or ""
        w = WORD(text)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        full = [x for x in text.split("\n") if WORD(x)]
        want[t[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in got) == want
    assert not any(r["kept"] for r in got if r["base_failed"]) and rules.judge(rules.counts(empty)).count() == 0


def test_language(docs, empty):
    trees = langid.Trees({"en": ["the cat and the dog sat on the mat with this and that"], "de": ["der hund und die katze sitzen auf der matte mit diesem und jenem"]})
    got = {r["doc_id"]: r for r in langid.identify(docs, trees).collect()}
    assert got[5]["lang_pred"] == got[4]["lang_pred"] == got[6]["lang_pred"] == "und" and got[5]["score"] == 0
    coder = langid.Coder(trees)
    assert coder("die katze und").argmin() == 0 and coder("the cat and").argmin() == 1
    one = sum(np.array(trees.bits(b" the"[max(0, i - 4) : i], b" the "[i])) for i in range(1, 5))
    assert np.allclose(coder("the")[0] - 0, one[0])
    assert langid.identify(empty, trees).count() == 0
    assert all(r["lang_pred"] == "und" for r in langid.identify(docs, langid.learn(docs.limit(0))).collect())


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 16)).astype(float)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(400, x[3].tolist(), 0), (401, None, 0), (402, [0.0] * 16, 0), (403, [float("nan")] * 16, 0), (404, [1.0, 2.0], 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = neighbours.nearest(d, lambda i: i % 50 == 0).collect()
    u = np.concatenate([x, x[3:4]])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 401, 50):
        s = u @ u[q]
        s[q] = -9
        best = np.lexsort((np.arange(401), -s))[:5]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(math.isclose(r["score"], s[r["vec_id"]], rel_tol=1e-9) for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(best.tolist()))
    assert hits >= 0.9 * 45
    assert neighbours.nearest(d.limit(0), lambda i: i % 50 == 0).count() == 0


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_similarity_of_words_is_that_of_the_joined_line(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        a = [rng.choice("an ban cat door eel ä long-ish".split()) for _ in range(rng.randint(1, 30))]
        b = [w if rng.random() < 0.85 else rng.choice(["x", "ban", "catalogue"]) for w in a]
        for _ in range(rng.randint(0, 3)):
            b.insert(rng.randint(0, len(b)), "new")
        rows.append((i, a, b))
    got = {r["i"] for r in lines.similar_words(spark.createDataFrame(rows, "i int, wa array<string>, wb array<string>"), 80).collect()}
    want = set()
    for i, a, b in rows:
        x, y = " ".join(a), " ".join(b)
        if _distance(x, y) <= max(len(x), len(y)) * 20 // 100:
            want.add(i)
    assert got == want and 0 < len(want) < 60


def test_equal_rows_that_repeat_do_not_overflow_lanes(spark):
    text = " ".join(f"word{i}" for i in range(100))
    d = spark.createDataFrame([(1, text)] * 5 + [(2, text), (3, "other words here")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["removed"]) for r in lines.dedup_lines(d).select("doc.doc_id", "removed").collect())
    assert got == [(1, [])] * 5 + [(2, [0]), (3, [])]
    sims = lines.with_simhash(lines._lines(d, "doc_id", "text")).where("at.doc_id < 3").select("sim").distinct()
    assert sims.count() == 1


def test_further_orders_rule_out_no_link():
    rng = np.random.default_rng(3)
    ruled_out = 0
    for _ in range(300):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.where(rng.random(len(a)) < rng.choice([0.0, 0.05, 0.1, 0.5]), rng.integers(0, 1 << 63, len(a)).astype(np.uint64), a))
        pa_, pb_ = (np.frombuffer(jaccard.prefixes(x, 85), np.uint32) for x in (a, b))
        may = jaccard.may_link(pa_, len(a), pb_, len(b), 85)
        assert may or not jaccard.linked(a, b, 85)
        ruled_out += not may
    assert ruled_out > 30


def test_line_dedup_finds_lines_of_edit_similarity(spark):
    """Recall of removed lines against brute force; with words, short and long, replaced, left out and put in."""
    rng = random.Random(8)
    made = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice([2, 3, 6, 8, 9])))
    common, rows = ["the", "of", "and", "to"], []
    for i in range(240):
        a = [rng.choice(common) if rng.random() < 0.3 else made() for _ in range([rng.randint(5, 9), rng.randint(10, 25), rng.randint(26, 60)][i % 3])]
        b = list(a)
        for _ in range(max(1, len(a) * rng.choice([4, 8, 12, 16]) // 100)):
            at = rng.randrange(len(b))
            b[at : at + 1] = rng.choice([[made()], [], [b[at], made()]])
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    similar = {i for i in range(1, 480, 2) if _distance(rows[i - 1][1], rows[i][1]) <= max(len(rows[i - 1][1]), len(rows[i][1])) * 20 // 100}
    got = {r["i"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("size(removed) > 0").select("doc.doc_id").toDF("i").collect()}
    assert got <= similar and len(similar) > 150
    assert len(got) >= 0.95 * len(similar), f"{len(got)} of {len(similar)}"


def _copies(rng, n, words, edits):
    """Copies of copies of one text, with words replaced, left out and put in."""
    made = [[f"w{rng.randrange(400)}" for _ in range(words)]]
    while len(made) < n:
        w = list(made[0] if rng.random() < 0.7 else rng.choice(made))
        for _ in range(rng.randrange(edits + 1)):
            i = rng.randrange(len(w))
            w[i : i + rng.choice((1, 1, 0, 2))] = [f"x{rng.randrange(10_000)}"] * rng.choice((1, 1, 0))
        made.append(w)
    return [" ".join(w) for w in made]


def _brute_components(texts, size, percent):
    sets = [set(zip(*(t.split()[i:] for i in range(size)))) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("size,percent,seed", [(4, 85, 1), (5, 80, 2)])
def test_jaccard_large_groups_of_copies(spark, size, percent, seed):
    rng = random.Random(seed)
    texts = _copies(rng, 160, 60, 5) + _copies(rng, 60, 40, 3) + [f"only {i} here is {i} said" for i in range(20)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=size, percent=percent).collect()}
    want = _brute_components(texts, size, percent)
    assert [got[i] for i in range(len(texts))] == want and 30 < len(set(want)) < 220


def test_what_a_link_shares_as_seen_from_a_third_set():
    rng = random.Random(5)
    counts = np.zeros(jaccard.BUCKETS, np.int64)
    seen = 0
    for _ in range(1500):
        percent, size = rng.choice((80, 85)), rng.choice((1, 3))
        texts = _copies(rng, 14, rng.randrange(8, 80), rng.randrange(1, 9))
        sets = [jaccard.shingles(t.encode(), size) for t in texts]
        for s in sets:
            np.add.at(counts, (s & np.uint64(jaccard.BUCKETS - 1)).astype(np.int64), 1)
        r = rng.choice(sets)
        for x, y in rng.sample(list(itertools.combinations(sets, 2)), 12):
            if (np.array_equal(x, y) or not jaccard.linked(x, y, percent)) or (jaccard.linked(x, r, percent) and jaccard.linked(y, r, percent)):
                continue
            (tx, qx), (ty, qy) = (jaccard.apart(s, r, counts, percent) for s in (x, y))
            both = {t: a for t, a in zip(tx.tolist(), qx)}
            assert any(t in both and not (both[t] and b) for t, b in zip(ty.tolist(), qy))
            seen += 1
    assert seen > 100


def test_one_of_each_group_keeps_one_row(spark):
    rows = [(1, BASE), (1, BASE), (1, "something else altogether is written here today"), (None, BASE + " x"), (None, BASE + " x"), (None, None), (None, None), (5, "   ")]
    got = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([(None, BASE + " x"), (1, rows[2][1]), (None, None), (None, None), (5, "   ")], key=str)


def test_line_dedup_finds_pairs_within_long_lists(spark):
    """Lines that share a passage and little else, with copies among them: long lists that are narrowed."""
    rng = random.Random(3)
    passage = [f"shared{i}" for i in range(14)]
    made = lambda n: [f"v{rng.randrange(100_000)}" for _ in range(n)]
    rows = []
    for i in range(150):
        a = made(10) + passage + made(10)
        b = list(a)
        for _ in range(rng.choice([1, 2, 3])):
            b[rng.randrange(len(b))] = made(1)[0]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    got = {r["i"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("size(removed) > 0").select("doc.doc_id").toDF("i").collect()}
    assert got <= set(range(1, 300, 2)) and len(got) >= 145


@pytest.mark.parametrize("name,spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_ids_of_texts_that_name_added_tokens(name, spaced):
    from loomset.llm.tokens import ids_of

    rng, path = random.Random(4), public_tokenizers.path(name)
    whole, ids = Tokenizer.from_file(path), ids_of(path, spaced)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "end", " of", "\n", "  ", "Ünder", "don't", "12", "<", "É"]
    for _ in range(400):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(9)))
        assert ids(t).tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_texts_without_letters_have_no_language():
    assert not any(map(langid._letter, ["", "² ½ Ⅷ _ 12 ٣"])) and all(map(langid._letter, ["12 a", "ß", "中"]))


def test_classifier_lessons_are_means_of_every_unlabelled_document(spark):
    rows = [(i, ("bad words here " if i % 3 == 0 else "good prose there ") * 3 + f"n{i % 7}", "en", f"s{i % 3}", 50) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    views = cotraining.Views([b"bad", b"good", b"here", b"n1"], ["lang=en", "source=s0", "source=s1"])
    r = np.random.default_rng(1)
    known, blank = cotraining.CoTrained(np.array([0.0, 1.0])), cotraining.CoTrained(np.array([0.0, 0.0]))
    known.w, known.cal = [r.normal(size=w + 1) * 3 for w in views.widths], [(1.5, 0.2), (2.0, -0.3)]
    got = cotraining.lessons(cotraining.features(d, views), views, [known, blank])
    bins = len(cotraining.BINS) + 1
    for v in (0, 1):
        sums, docs = np.zeros((2 * bins, views.widths[v])), np.zeros(2 * bins)
        for x in rows:
            x = views.content(x[1]), views.meta(x[2:])
            s = [a * ((f[1].astype(np.float32) * w[f[0]]).sum() + w[-1]) + b for f, w, (a, b) in zip(x, known.w, known.cal)]
            p = 1 / (1 + math.exp(-s[1 - v]))
            if p >= cotraining.CONFIDENT or p <= 1 - cotraining.CONFIDENT:
                g = int(p > 0.5) * bins + np.digitize(s[v], cotraining.BINS)
                sums[g, x[v][0]] += x[v][1]
                docs[g] += 1
        lesson, verdicts, weights = got[0][v]
        assert (weights == docs).all() and docs.sum() > 0 and (verdicts == np.arange(2 * bins) // bins).all()
        means = np.zeros_like(sums)
        means[lesson.at, lesson.col] = lesson.val
        assert np.allclose(means * docs[:, None], sums, atol=1e-2)
        assert got[1][v][2].sum() == 0


def test_classifier_with_repeated_ids_long_texts_and_null_labels(spark):
    text = lambda i: ("BUY NOW!! " if i % 2 else "quiet prose ") * (20_000 if i == 6 else 10)
    rows = [(i % 40, text(i), None, "s", None, "x") for i in range(80)] + [(7, text(7), "en", None, 1, "y")] * 50 + [(None, text(1), "en", "s", 1, "z")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(40)] + [(3, None, 1), (None, 1, 1), (9, 0, None)], "doc_id long, quality int, toxic int")
    model = cotraining.fit(d, labels, labelled=30)
    got = cotraining.score(d, model).collect()
    assert len(got) == len(rows) and not model[2].known
    kept = Counter((r["doc_id"], r["kept"]) for r in got)
    assert kept[7, False] == 52 and kept[6, True] == 2 and kept[None, False] == 1
    again = cotraining.score(d.repartition(7), cotraining.fit(d.repartition(7), labels, labelled=30)).collect()
    assert sorted((r["quality"], r["toxic"]) for r in again) == sorted((r["quality"], r["toxic"]) for r in got)


def test_rules_verdicts_follow_each_group(spark):
    """kept by hand: fences from exact quantiles of each group."""
    r = random.Random(4)
    rows = []
    for g, (lang, source) in enumerate([("en", "a"), ("en", None), (None, "a"), ("de", "rare")]):
        for i in range(8 if source == "rare" else 120):
            n, mean = r.randrange(10, 90), 4 + g + r.random()
            n = 5 if i == 3 else n
            rep = r.choice([0, 0, 0, n // 12, n // 7, n // 4])
            rows.append((len(rows), lang, source, int(n * mean), r.choice([0, 0, 0, 0, n // 10]), n if i % 40 == 5 else r.randrange(n // 20 + 2), n // 5 + 2, r.choice([0, 0, 0, 1, n // 6]), n, rep))
    names = "doc_id lang source word_chars n_symbols n_upper n_lines n_dup_lines n_words n_repeat_words".split()
    d = spark.createDataFrame(rows, ", ".join(f"{c} {'string' if c in ('lang', 'source') else 'long'}" for c in names))
    got = {x["doc_id"]: x for x in rules.judge(d).collect()}
    dicts = [dict(zip(names, x)) for x in rows]
    for x in dicts:
        x.update(symbol_rate=x["n_symbols"] / x["word_chars"], upper_rate=x["n_upper"] / x["word_chars"], dup_line_rate=x["n_dup_lines"] / x["n_lines"], repeat_rate=x["n_repeat_words"] / x["n_words"], word_length=x["word_chars"] / x["n_words"])
        x["failed"] = x["n_words"] < 10 or 100 * x["n_repeat_words"] > 20 * x["n_words"]
    usual = [x for x in dicts if x["n_words"] >= 10]
    quantile = lambda v, q: sorted(v)[max(math.ceil(q * len(v)) - 1, 0)]
    reasons = Counter()
    for x in dicts:
        for same in (lambda y: (y["lang"], y["source"]) == (x["lang"], x["source"]), lambda y: y["lang"] == x["lang"], lambda y: True):
            group = [y for y in usual if same(y)]
            if len(group) >= rules.MIN_GROUP:
                break
        ok = True
        for rate, (below, above) in rules.MIDDLES.items():
            lo, mid, hi = (quantile([y[rate] for y in group], q) for q in rules.QUARTILES)
            gap = rules.SPREAD * min(mid - lo, hi - mid)
            bad = x[rate] > mid + gap + above or (below is not None and x[rate] < mid - gap - below)
            reasons[rate] += bad
            ok &= not bad
        for rate, slack in rules.TAILS.items():
            mid, far = (quantile([y[rate] for y in group if not y["failed"]], q) for q in rules.FAR)
            reasons[rate] += x[rate] > 2 * far - mid + slack and not x["failed"]
            ok &= x[rate] <= 2 * far - mid + slack
        assert got[x["doc_id"]]["kept"] == (ok and not x["failed"]) and got[x["doc_id"]]["base_failed"] == x["failed"]
    assert reasons["symbol_rate"] and reasons["upper_rate"]
    few, rules.FEW_GROUPS = rules.FEW_GROUPS, 1
    try:
        assert {x["doc_id"]: x["kept"] for x in rules.judge(d).collect()} == {k: x["kept"] for k, x in got.items()}
    finally:
        rules.FEW_GROUPS = few


def test_lattice_score_is_the_product_of_its_words(spark):
    p = lattice.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["The cat sat", "a  thing\n", None, "the cat"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    train = [0, 3]
    got = {r["doc_id"]: r for r in lattice.lattice_score(d, F.col("doc_id").isin(train), public_tokenizers.path("piece_bpe_32k.model")).collect()}
    n = sum(len(words(texts[i])) + 1 for i in train)
    end = (len(train) + 1) / (n + 2)
    known = {w for i in train for w in words(texts[i])}
    for i, t in enumerate(texts):
        w = words(t)
        want = sum(math.log1p(-end) + p.words([x.encode()], p.logp)[0] for x in w) + math.log(end)
        assert math.isclose(got[i]["score"], want / math.log(10), rel_tol=1e-9) and got[i]["n_known"] == sum(x in known for x in w) + 1
    adapted = lattice.lattice_score(d, F.col("doc_id").isin(train), public_tokenizers.path("piece_bpe_32k.model"), passes=1, whole_words=True).collect()
    assert {r["doc_id"]: r["score"] > got[r["doc_id"]]["score"] for r in adapted}[3]


def test_lattice_query_learns_the_words_of_held_out_rows(spark, tmp_path):
    rng = random.Random(5)
    spelled = ["".join(rng.choice(("ka", "qu", "zo", "xi", "vel", "thr")) for _ in range(4)) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(spelled, k=60)) + f" new{i}" if i else None) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = lattice.op7_lattice_scores(spark, str(tmp_path)).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 200 and held and all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    # Words met in training cost what they cost the base; the one new word of a row is spelled.
    assert all(r["score"] > 1.15 * r["base_score"] for r in held)


def test_languages_of_long_or_copied_texts_are_learned(spark):
    en, de = "the cat and the dog sat on the mat ", "der hund und die katze auf der matte "
    rows = [(i, en * 3, "en") for i in range(300)] + [(300, en * 2 + "more", "en"), (301, de * 2000, "de"), (302, None, "fr"), (303, "x", None)]
    trees = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 5000)
    assert trees.langs == ["de", "en"]
    # Copies count once; of the long text, one stretch of 5,000 characters.
    assert sum(trees.at[1][b"a"].values()) <= 30 and 4000 < sum(trees.at[0][b""].values()) <= 5010
    coder = langid.Coder(trees)
    assert coder("die katze und").argmin() == 0 and coder("the cat and").argmin() == 1


@pytest.fixture(scope="module")
def crowded(spark):
    """Lines that share a passage, in pairs that differ by a letter in most other words; those that go by a comparison of every two that share a key."""
    rng = random.Random(11)
    passage, rows = [f"shared{i}" for i in range(14)], []
    made = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))
    for i in range(120):
        a = [made() for _ in range(10)] + passage + [made() for _ in range(10)]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(w if w in passage or rng.random() < 0.1 else f"{w[:-1]}z" for w in a))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    w = F.split("text", " ")
    keyed = lines.with_simhash(lines._lines(d, "doc_id", "text")).select(F.col("at.doc_id").alias("doc_id"), "sim", lines.band_keys().alias("keys"))
    each = keyed.join(d, "doc_id").withColumn("p", F.array_distinct(F.transform(w, lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))))
    x, y = each.toDF(*[f"x_{c}" for c in each.columns]), each.toDF(*[f"y_{c}" for c in each.columns])
    most = F.floor(F.greatest(F.length("x_text"), F.length("y_text")) * 0.2)
    links = x.join(y, (F.col("x_doc_id") < F.col("y_doc_id")) & F.arrays_overlap("x_keys", "y_keys")).where(F.bit_count(F.col("x_sim").bitwiseXOR(F.col("y_sim"))) <= lines.DISTANCE)
    links = links.where((F.size(F.array_intersect("x_p", "y_p")) * 100 >= lines.ALIKE[0] * F.greatest(F.size("x_p"), F.size("y_p"))) & (F.levenshtein("x_text", "y_text") <= most))
    first = {}
    root = lambda i: i if first.get(i, i) == i else root(first[i])
    for r in links.select("x_doc_id", "y_doc_id").collect():
        a, b = sorted((root(r[0]), root(r[1])))
        first[b] = a
    return d, {i for i, _ in rows if root(i) != i}


def test_only_lists_of_several_lines_are_joined(crowded, monkeypatch):
    least, made = [], lines.listed_members

    def watched(rows, info):
        least.append(rows.groupBy("t").count().agg(F.min("count")).first()[0])
        return made(rows, info)

    monkeypatch.setattr(lines, "listed_members", watched)
    lines.removed_lines(crowded[0])
    assert len(least) == 2 and all(n is None or n > 1 for n in least)


def test_line_dedup_loses_no_pair_of_a_long_list(crowded):
    d, want = crowded
    got = {r["i"] for r in lines.dedup_lines(d).where("size(removed) > 0").select(F.col("doc.doc_id").alias("i")).collect()}
    assert got == want and len(want) > 20


def test_pipeline_line_dedup_loses_no_pair_of_a_long_list(spark, crowded):
    d, want = crowded
    left = corpus_pipeline.line_dedup(spark, d, "").select("doc_id", "text").collect()
    assert {r["doc_id"] for r in left if r["text"] == ""} == want


@pytest.mark.parametrize("stage,tag", [(corpus_pipeline.line_dedup, "line-removed"), (corpus_pipeline.near_duplicates, "gone")])
def test_pipeline_stages_leave_little_on_disk(spark, docs, stage, tag):
    before = len(common._written)
    out = stage(spark, docs, "")
    left = [path for _, path in common._written[before:] if Path(path.removeprefix("file://")).exists()]
    assert [Path(p).name.rsplit("-", 1)[0] for p in left] == [tag] and out.count() > 0


def test_scratch_folders_go_with_their_scope(spark):
    exists = lambda d: Path(d.inputFiles()[0].removeprefix("file://")).exists()
    with common.Scratch():
        with common.Scratch() as inner:
            kept = inner.keep(common.cut(spark.range(3), "one"), "two")
        assert kept.count() == 3 and exists(kept)
        path = common._written[-1][1]
    assert [Path(p.removeprefix("file://")).exists() for _, p in common._written[-2:]] == [False, False] and path.rsplit("/", 1)[1].startswith("two")


def test_stretches_that_differ_by_case_are_merged_once():
    from loomset.llm.tokens import Ids

    path = public_tokenizers.path("word_bpe_49k.json")
    ids, tok, made = Ids(path, False), Tokenizer.from_file(path), []
    ids.of_piece.make = lambda p, make=ids.of_piece.make: made.append(p) or make(p)
    texts = ["Word WORD word, wörd WÖRD's don't", "a\tB\x0bc\x0cA1b2 12,345", "é" * 1500 + " " + "Ab1" * 900, "word’s Word"]
    assert all(ids(t).tolist() == tok.encode(t, add_special_tokens=False).ids for t in texts)
    assert made.count("word") == 1 and len([s for s in (*ids.of_lowered, *ids.of_stretch) if s.lower() == "word"]) == 2  # one of a text that isn't plain


def test_line_dedup_makes_each_pair_of_open_lists_once(spark):
    texts = [f"one two three four five six seven eight nine w{i} x{i} y{i}" for i in range(90)]
    d = spark.createDataFrame([(i, x.split(" ")) for i, x in enumerate(texts)], "k long, w array<string>")
    # Lists of all 90 and of the first 40, in which no two lines are of one component.
    listed = d.select("k", F.explode(F.when(F.col("k") < 40, F.expr("array(7L, 5L)")).otherwise(F.expr("array(7L)"))).alias("t"))
    members = listed.select("t", "k", F.when(F.col("t") == 7, 90).otherwise(40).alias("c"), F.length(F.lit(texts[0])).cast("long").alias("n"), F.lit(0).cast("long").alias("sim"), F.col("k").alias("component"), (F.col("k") > 0).alias("far"))
    members = members.join(lines._signatures(d).join(listed.groupBy("k").agg(F.collect_set("t").alias("ts")), "k"), "k")
    out = lines._across(members, lambda x, y: F.bit_count(x["sim"].bitwiseXOR(y["sim"])) <= lines.DISTANCE, 80)
    assert sorted((r["b"], r["a"]) for r in out.collect()) == list(itertools.combinations(range(90), 2))
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]  # nothing has to put repeated pairs together


def test_edit_similarity_of_long_lines_is_that_of_brute_force(spark):
    rng, rows = random.Random(5), []
    made = lambda n: ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(n)]
    for i in range(240):
        passage, a = made(rng.randint(0, 25)), made(40)
        at = rng.randint(0, 40)
        a = a[:at] + passage + a[at:]
        share = rng.choice([0.05, 0.25, 0.3, 0.35, 0.4, 0.9])
        b = [x if x in passage or rng.random() > share else made(1)[0] for x in a]
        cut = rng.randint(0, 8)
        rows.append((i, a, b[cut:] if i % 3 else b[: len(b) - cut]))
    d = spark.createDataFrame(rows, "i int, wa array<string>, wb array<string>")
    xa, xb = F.array_join("wa", " "), F.array_join("wb", " ")
    want = {r["i"] for r in d.where(F.levenshtein(xa, xb) <= F.floor(F.greatest(F.length(xa), F.length(xb)) * 20 / 100)).collect()}
    assert {r["i"] for r in lines.similar_words(d, 80).collect()} == want and 40 < len(want) < 200


def test_classifier_makes_no_objects_of_rare_words():
    import tracemalloc

    import pyarrow as pa

    rows = pa.chunked_array([pa.array([[f"w{i}_{j}".encode() for j in range(100)] + [b"often"] * (i % 2) for i in range(1000)], pa.list_(pa.binary()))] * 2)
    rare = pa.chunked_array([rows.chunk(0)])
    tracemalloc.start()
    got = cotraining._frequent(rare)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [b"often"] and peak < 1 << 20
    assert cotraining._frequent(rows.slice(0, 0)) == [] and cotraining._numbered(rare, {b"often": 4}).to_pylist()[:3] == [[], [4], []]


def test_line_dedup_needs_few_pairs_of_copies_that_a_central_line_keeps_apart(spark, monkeypatch):
    """Two groups of copies in the same lists: the central line is of one group, so that no line of the other links with it."""
    of = lambda name, i: " ".join(f"{name}{j}" if j != i % 20 else f"new{i}" for j in range(20))
    texts = [of("left", i) for i in range(20)] + [of("rite", i) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, t string")
    n = F.length("t").cast("long").alias("n")
    classes = docs.select(F.col("row").alias("k"), F.col("row").alias("k2"), F.struct(F.col("row").alias("doc_id"), "row", F.lit(0).alias("line")).alias("at"), n, F.lit(0).cast("long").alias("sim"), *[F.lit(7).cast("long").alias(p) for p in lines._PACKED])
    pairs, links = [], lines._links
    monkeypatch.setattr(lines, "_links", lambda found, new, percent: pairs.append(new.count()) or links(found, new, percent))
    got = lines._settled(docs, classes, 80).select("node", "component").collect()
    assert {r["node"]: r["component"] for r in got} == {i: 0 if i < 20 else 20 for i in range(80)}
    assert sum(pairs) < 10 * len(texts)
