"""Operators on small tables: against plain Python, libraries, round trips, held-out accuracy; and odd input."""

import base64
import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessella.llm import bpe, common, cotrain, flac, langid, neardup, packing, perplexity, preference, queries, transducer, warc
from tessella.llm.common import new_folder, table
from tessella.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Rows with nulls, empty and long texts, repeated rows and ids, columns that clash with those of results.
ODD = [
    (1, None, None, "s", 0, True),
    (2, "", "en", None, None, None),
    (3, "   \n\t ", "en", "s", 3, False),
    (4, "word", "de", "s", 4, True),
    (5, "a b c d e f " * 4000, "en", "s", 48000, True),
    (6, "The same words in the same order, twice in this table.", "en", "s", 1, True),
    (7, "the SAME words in the same order, twice in this table.", None, "s", 1, True),
    (7, "the SAME words in the same order, twice in this table.", None, "s", 1, True),
    (None, "Words of a row without an id are words as well, are they not?", "en", "s", 1, True),
    (9, "x" * 70000, "xx", "s", 1, True),
    (10, "日本語 مرحبا 😀 <|endoftext|> it's 　 \x01 é", "ja", "s", 1, True),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, length int, score string, id int, digest string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, "s", 2, "d") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark, odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(sf):
    return dict(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(sets):
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sets}


def test_near_duplicates_equal_brute_force(spark, sf, docs):
    sets = {i: shingles(t) for i, t in docs.items()}
    want = components(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op1_minhash_near_dedup(spark, sf).collect()}
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_near_duplicates_in_chains_and_families(spark):
    """A family whose members are linked in a chain only, spread about the threshold."""
    random.seed(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for j in random.sample(range(60), i % 5):
            w[j] = f"x{random.randint(0, 9)}"
        rows.append((i, " ".join(w)))
    for i in range(60, 90):  # a drifting chain
        base[i - 60] = f"y{i}"
        rows.append((i, " ".join(base)))
    sets = {i: shingles(t) for i, t in rows}
    want = components(sets)
    for block in (1024, 4):
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
        assert got == want


def test_near_duplicates_odd(odd, none):
    got = neardup.near_duplicates(odd).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert len(got) == len(ODD) and by[1][0].n_shingles == 0 and by[1][0].component_id == 1
    assert by[7][0].component_id == 6 and not by[7][0].kept and by[6][0].kept
    assert by[None][0].component_id is None and by[None][0].kept
    assert neardup.near_duplicates(none).count() == 0


def test_join_of_hot_keys(spark):
    rows = [(i, "hot" if i % 3 else None if i % 2 else f"k{i}") for i in range(3000)]
    counts = collections.Counter(k for _, k in rows if k and k != "k600")
    left = spark.createDataFrame(rows, "id int, k string")
    right = spark.createDataFrame([(k, n, len(k)) for k, n in counts.items()], "k string, n long, size int")
    got = common.join_counted(left, right, "k", "n", share=10)
    assert sorted((r.id, r.k or "", r.size) for r in got.collect()) == sorted((i, k or "", len(k) if k in counts else None) for i, k in rows) and got.columns == ["k", "id", "size"]
    assert common.join_counted(left.limit(0), right.limit(0), "k", "n").count() == 0


def test_components(spark):
    e = spark.createDataFrame([(a, a + 1) for a in range(40) if a != 20] + [(7, 7), (50, 45)], "u long, v long")
    got = {r.node: r.label for r in connected_components(e).collect()}
    assert got == {**{a: 0 for a in range(21)}, **{a: 21 for a in range(21, 41)}, 50: 45, 45: 45}


def test_co_training(spark, sf, odd, none):
    rows = {r.doc_id: r for r in queries.op2_co_training_quality(spark, sf).collect()}
    assert len(rows) == duckdb.sql(f"select count(*) n from '{sf}/documents.parquet'").fetchall()[0][0]
    some = table(spark, sf, "labels")
    got = cotrain.classify_quality(odd, some, carry=True)
    assert got.count() == len(ODD) and got.select("carried.*").columns == odd.columns
    empty = cotrain.classify_quality(odd, some.limit(0)).collect()
    assert all(r.kept and r.score is None for r in empty)
    assert cotrain.classify_quality(none, some).count() == 0
    strange = spark.createDataFrame([(4, 0), (4, 1), (5, None), (6, 2), (9, 1), (10, 1), (None, 1)], "doc_id long, quality int")
    rows = {r.doc_id: r.score for r in cotrain.classify_quality(odd, strange).collect()}
    assert rows[4] < min(rows[9], rows[10]) and len(rows) == len({r[0] for r in ODD})


def test_carried_texts_go_to_workers_once(spark, odd):
    known = spark.createDataFrame([(4, 0), (5, 0), (6, 1), (9, 1), (10, 1)], "doc_id long, quality int")
    plain, carried = cotrain.classify_quality(odd, known), cotrain.classify_quality(odd, known, carry=True)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.score)
    assert sorted(plain.collect(), key=key) == sorted(carried.drop("carried").collect(), key=key)
    again = cotrain.classify_quality(carried.select("carried.*").withColumn("text", F.encode("text", "utf-8")), known, carry=True)  # not a column of strings
    assert sorted(plain.collect(), key=key) == sorted(again.drop("carried").collect(), key=key)
    sent = carried._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[1].split("\n")[1]
    assert "carried" in sent and " AS text#" not in sent and "text#" not in sent.split("struct(")[0]
    assert carried.select("carried.*").exceptAll(odd).isEmpty() and odd.exceptAll(carried.select("carried.*")).isEmpty()


def test_batches_bounded_by_bytes(spark):
    common.ship(spark)

    def size(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([batch.nbytes], pa.int64())], names=["n", "b"])

    got = spark.range(0, 600, 1, 1).select(F.repeat(F.lit("x"), 50_000).alias("text")).mapInArrow(size, "n long, b long").collect()
    assert sum(r.n for r in got) == 600 and max(r.b for r in got) <= 9 << 20


def _auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    good = y > 0
    return (rank[good].mean() - (good.sum() - 1) / 2) / (~good).sum()


@pytest.mark.parametrize("split", range(4))
def test_co_training_on_labels_held_out(spark, split):
    path = "/root/testdata/sf0.01"
    labels = table(spark, path, "labels")
    half = F.crc32(F.concat(F.lit(f"{split}-"), F.col("doc_id").cast("string"))) % 2 == 0
    got = {r.doc_id: r.score for r in cotrain.classify_quality(table(spark, path, "documents"), labels.where(half)).collect()}
    held = [(got[r.doc_id], r.quality) for r in labels.where(~half).collect() if r.doc_id in got]
    score, y = np.array([s for s, _ in held]), np.array([q for _, q in held])
    assert ((score >= 0.5) == (y > 0)).mean() > max(y.mean(), 1 - y.mean()) and _auc(score, y) >= 0.9
    assert len(np.unique(score.round(6))) > 0.5 * len(score)


@pytest.mark.parametrize("case", ["separable", "tiny", "reversed", "flat"])
def test_calibration_is_a_finite_rising_line(case):
    rng = np.random.default_rng(0)
    y = (np.arange(90) % 6 > 0).astype(float)
    raw = {"separable": y * 50 - 20, "tiny": rng.normal(size=90) + 9e4, "reversed": -y + rng.normal(size=90) * 0.1, "flat": np.zeros(90)}[case]
    if case == "tiny":
        raw, y = raw[:7], y[:7]
    view = cotrain.View(np.zeros(1), np.zeros(1), 0.0, np.zeros(1), np.ones(1))
    cotrain.calibrate(view, raw, y)
    z = raw * view.slope + view.shift
    assert 0 < view.slope < np.inf and np.isfinite(view.shift)
    if case != "tiny":
        assert np.abs(z).max() < 6 and abs(cotrain._sigmoid(z).mean() - y.mean()) < 0.1


def test_pseudo_labels_teach_the_other_view(spark):
    """Only the texts tell quality among the labels; among the rest the source follows it, which the metadata view can
    learn from pseudo-labels alone. Copies of one text count once."""
    rng = random.Random(4)
    good, bad = ["river", "stone", "meadow", "light", "evening"], ["buy", "cheap", "click", "winner", "casino"]
    rows, labels = [], []
    for i in range(900):
        y = i % 2
        text = " ".join(rng.choice(good if y else bad) for _ in range(40))
        labelled = i < 90
        rows.append((i, text, "en", "web" if labelled else "press" if y else "spam", 200))
        if labelled:
            labels.append((i, y))
    rows += [(10_000 + i, "river stone meadow light evening " * 8, "en", "copies", 200) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    given = spark.createDataFrame(labels, "doc_id long, quality int")
    one = {r.doc_id: r.meta_score for r in cotrain.classify_quality(docs, given, rounds=0, confidence=0.8).collect()}
    more = {r.doc_id: r.meta_score for r in cotrain.classify_quality(docs, given, rounds=2, confidence=0.8).collect()}
    rest = range(100, 900)
    y = np.array([i % 2 for i in rest])
    assert abs(_auc(np.array([one[i] for i in rest]), y) - 0.5) < 0.1
    assert _auc(np.array([more[i] for i in rest]), y) > 0.9


def test_language(spark, sf, odd, none):
    lang = dict(duckdb.sql(f"select doc_id, lang from '{sf}/documents.parquet'").fetchall())
    rows = queries.op3_language_id(spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in rows)
    got = {r.doc_id: r for r in langid.identify_languages(odd).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[1].score == 0.0 and not got[None].held_out
    assert langid.identify_languages(none).count() == 0


def test_draw_counts_different_texts_and_holds_each_label(spark):
    word = lambda a, i: " ".join(a[(i * 7 + j * j) % len(a)] * (1 + (i + j) % 3) for j in range(12)) + f" {a[i % 5]}{i}"
    copies = [(i, "the same text again and again", "en") for i in range(5000)]
    mixed = [(10_000 + i, word("abcdefghi" if i % 2 else "rstuvwxyz", i), "aa" if i % 2 else "rr") for i in range(80)]
    schema = "doc_id long, text string, lang string"
    always = F.lit(True)
    assert {"aa", "rr"} <= set(langid.fit(spark.createDataFrame(copies + mixed, schema), always, sample=60).labels)
    rare = [(20_000, "qqq kkk qqq", "qq")]
    many = [(30_000 + i, word("abcdefghi", i), "aa") for i in range(600)]
    assert langid.fit(spark.createDataFrame(many + rare, schema), always, sample=5).labels == ["aa", "qq"]


def test_language_model_equals_brute_force(spark):
    """Counts, TF-IDF weights, the leader's steps and predictions, one number at a time."""
    rng = random.Random(9)
    words = {"aa": ["kala", "muna", "tiri", "Éto"], "bb": ["strunz", "pfeffer", "knall", "über"]}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(rng.randint(3, 9))) + f" {i}!", x) for i, x in enumerate(("aa", "bb") * 40)]
    rows += [rows[0], (99, None, "aa"), (98, "kala", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True), epochs=2)

    def terms(text):
        plain = " " + re.sub(r"[^\W\d_]+|.", lambda m: m[0] if m[0][0].isalpha() else "\0", text.lower()) + " "
        plain = re.sub("\0+", " ", plain)
        n = collections.Counter()
        for order in (1, 2, 3):
            for i in range(len(plain) - order + 1):
                h = order * 0x27D4EB2F & 0xFFFFFFFF
                for j, m in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)[:order]):
                    h = (h ^ ord(plain[i + j])) * m & 0xFFFFFFFF
                    h ^= h >> 15
                n[h % langid.BUCKETS] += 1
        return n

    known = [(t, x) for _, t, x in rows if t is not None and x is not None]
    df = collections.Counter(b for t, _ in known for b in terms(t))
    idf = {b: np.log((1 + len(known)) / (1 + df[b])) + 1 for b in range(langid.BUCKETS)}
    assert np.allclose(model.idf, [idf[b] for b in range(langid.BUCKETS)])

    def weights(text):
        w = {b: (1 + np.log(n)) * idf[b] for b, n in terms(text).items()}
        norm = np.sqrt(sum(v * v for v in w.values()))
        return {b: v / norm for b, v in sorted(w.items())}

    places = {(r.text, r.lang): r.p for r in docs.select("text", "lang", F.xxhash64("text", "lang").alias("p")).collect()}
    drawn = sorted({k: places[k] for k in known}.items(), key=lambda x: x[1])
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(b, c):
        v = z[b, c]
        return -np.sign(v) * max(abs(v) - 0.05, 0) / ((1.0 + np.sqrt(n[b, c])) / 0.5 + 1.0)

    learn = [i for i, (_, place) in enumerate(drawn) if place % 5]
    for epoch in range(2):
        for i in np.random.default_rng(epoch).permutation(learn).tolist():
            (text, lang), x = drawn[i][0], None
            x = {**weights(text), langid.BUCKETS: 1.0}
            w = {(b, c): weight(b, c) for b in x for c in (0, 1)}
            score = [sum(v * w[b, c] for b, v in x.items()) for c in (0, 1)]
            e = np.exp(np.array(score) - max(score))
            p = e / e.sum()
            for c in (0, 1):
                for b, v in x.items():
                    g = v * (p[c] - (c == (lang == "bb")))
                    z[b, c] += g - (np.sqrt(n[b, c] + g * g) - np.sqrt(n[b, c])) / 0.5 * w[b, c]
                    n[b, c] += g * g
    for c in (0, 1):
        assert np.allclose(model.weights[:, c], [weight(b, c) for b in range(langid.BUCKETS)], atol=1e-9) and model.bias[c] == pytest.approx(weight(langid.BUCKETS, c))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for i, t, _ in rows:
        if t is None:
            assert got[i].lang_pred == "und"
            continue
        score = np.array([sum(v * weight(b, c) for b, v in weights(t).items()) + weight(langid.BUCKETS, c) for c in (0, 1)]) / model.temperature
        e = np.exp(score - score.max())
        assert got[i].lang_pred == ("aa", "bb")[int(score.argmax())] and got[i].score == pytest.approx(float((e / e.sum()).max()))


def test_leader_gives_sparse_weights():
    leader = langid.ProximalLeader(50, 2, 0.5, 1.0, 0.5, 1.0)
    rng = np.random.default_rng(0)
    for _ in range(300):
        y = int(rng.integers(0, 2))
        leader.learn(np.array([y, *rng.integers(2, 50, 3)]), np.array([1.0, 0.1, 0.1, 0.1]), y)
    w = leader.weights()
    assert w[0, 0] > 0 > w[1, 0] and (w[2:] == 0).mean() > 0.5


def test_quality_counts(spark, sf, docs, odd, none):
    def brute(x):
        x = x or ""
        w = WORD.findall(x)
        c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        seen, dup = set(), 0
        for line in x.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        return len(w), sum(map(len, w)), sum(x.count(s) for s in "#*$%&|<>"), dup, len(hit)

    for r in queries.op4_quality_rules(spark, sf).collect():
        n = brute(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r.base_failed and r.kept)
    got = perplexity.quality_rules(odd, carry=True)
    assert got.count() == len(ODD) and got.select("carried.*").columns == odd.columns
    assert sorted((r.doc_id or 0, r.n_words) for r in got.collect()) == sorted((r[0] or 0, len(WORD.findall(r[1] or ""))) for r in ODD)
    assert perplexity.quality_rules(none).count() == 0


def test_rare_gibberish_is_rejected(spark, sf):
    rng = random.Random(5)
    made = ["abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz", "abcdefghijklmnopqrstuvwxyz0123456789", "zxqjkvwZXQJKVW0123456789"]
    noise = [(9_000_000 + i, " ".join("".join(rng.choice(a) for _ in range(rng.randint(3, 9))) for _ in range(80)), "en") for i, a in enumerate(made)]
    noise.append((9_000_009, noise[0][1], "en"))  # a copy does not make it likely
    letters = "абвгдежзиклмнопрстуфхцчшыэюя"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(40)]
    russian = [(9_300_000 + i, " ".join(rng.choice(words) for _ in range(100)), "ru") for i in range(150)]
    noise += [(9_400_000 + i, " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(100)), "ru") for i in range(10)]
    prose = table(spark, sf, "documents").select("doc_id", "text", "lang")
    rows = prose.unionByName(spark.createDataFrame([*noise, *russian, (9_500_000, "xq zj kw", "zz")], prose.schema))  # zz: no band
    got = {r.doc_id: r for r in perplexity.quality_rules(rows).collect()}
    assert all(not got[i].base_failed and not got[i].kept and got[i].deviation < -20 for i, _, _ in noise)
    assert sum(got[i].kept for i, _, _ in russian) >= 145 and got[9_500_000].deviation is None
    passed = [r for i, r in got.items() if i < 9_000_000 and not r.base_failed]
    assert sum(r.kept for r in passed) >= 0.95 * len(passed) > 100


def test_every_language_has_a_band(spark):
    rng = random.Random(3)
    rows = []
    for x in range(19):  # each with words of its own, from few to many; the last ones have fewest rows
        words = ["".join(rng.choice("aeioubcdfghlmnprst") for _ in range(rng.randint(3, 8))) for _ in range(8 * (x % 4 + 1) ** 3)]
        rows += [(len(rows) + i, " ".join(rng.choice(words) for _ in range(120)), f"l{x:02}" if x else None) for i in range(31 - x)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in perplexity.quality_rules(docs).collect()}
    by = collections.defaultdict(list)
    for i, _, lang in rows:
        if not got[i].base_failed:
            by[lang].append(got[i].deviation)
    assert len(by) > 15 and all(abs(sorted(d)[len(d) // 2]) < 1 for d in by.values())
    for few in (0, 3000):  # entries that go to every task: the others are looked up in slices
        assert {r.doc_id: r for r in perplexity.quality_rules(docs, everywhere=few).collect()} == got


def test_no_language_with_a_band(spark):
    got = perplexity.quality_rules(spark.createDataFrame([(1, "three short words", "en"), (2, None, "en")], "doc_id long, text string, lang string")).orderBy("doc_id").collect()
    assert [(r.kept, r.deviation) for r in got] == [(False, None), (False, None)] and got[0].perplexity > 1 and got[1].perplexity is None


def brute_kneser_ney(texts):
    """Mean charges of texts of one language, by dictionaries of strings."""

    def fold(t):
        out = []
        for i, c in enumerate(t):
            if c in "\n\r":
                out.append("\n")
            elif c.isspace() or ord(c) < 32:
                out.append(" ")
            elif c.isdecimal():
                out.append("0")
            else:
                out.append(c if i and c.isupper() and t[i - 1].isupper() else c.lower())
        return "\0" * 4 + "".join(out)

    spelled = [fold(t) for t in texts]
    n, owners = [collections.Counter() for _ in range(6)], [collections.defaultdict(set) for _ in range(6)]
    for raw, t in zip(texts, spelled, strict=True):
        for i in range(len(t) - 4):
            g = t[i : i + 5]
            n[5][g] += 1
            for k in range(1, 6):
                owners[k][g[5 - k :]].add(raw)
    for k in range(4, 0, -1):
        for g in n[k + 1]:
            n[k][g[1:]] += 1
    p, charge = [{} for _ in range(6)], [{} for _ in range(6)]
    for k in range(1, 6):
        c = collections.Counter(n[k].values())
        if c[1] and c[2]:
            y = c[1] / (c[1] + 2 * c[2])
            d = [1 - 2 * y * c[2] / c[1], 2 - 3 * y * c[3] / c[2], 3 - 4 * y * c[4] / c[3] if c[3] else 1.5]
            d = [min(max(x, 0.1), m - 0.05) for m, x in zip((1, 2, 3), d, strict=True)]
        else:
            d = [0.5] * 3
        total, freed, known = collections.Counter(), collections.Counter(), collections.defaultdict(set)
        for g, x in n[k].items():
            total[g[:-1]] += x
            freed[g[:-1]] += d[min(x, 3) - 1]
            known[g[:-1]] |= owners[k][g]
        for g, x in n[k].items():
            w = freed[g[:-1]] / total[g[:-1]]
            shorter = p[k - 1][g[1:]] if k > 1 else 1 / (len(n[1]) + 1)
            p[k][g] = (x - d[min(x, 3) - 1]) / total[g[:-1]] + w * shorter
            below = charge[k - 1][g[1:]] if k > 1 else np.log(shorter)
            charge[k][g] = np.log(p[k][g]) if len(owners[k][g]) > 1 else (np.log(w) if len(known[g[:-1]]) > 1 else 0.0) + below
    return p, n, [sum(charge[5][t[i : i + 5]] for i in range(len(t) - 4)) / (len(t) - 4) for t in spelled]


def test_kneser_ney_equals_brute_force(spark, docs):
    texts = [t for t in docs.values() if t][:40] + ["the cat SAT on the mat.\r\n\tThe dog sat, 12 times.", "日本語の文章です。 日本語。", "x", "x", "aaaaaaaa"]
    p, n, want = brute_kneser_ney(texts)
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.perplexity for r in perplexity.quality_rules(rows).collect()}
    assert all(got[i] == pytest.approx(np.exp(-m), rel=1e-4) for i, m in enumerate(want))
    model = perplexity.kneser_ney(perplexity.count_grams(rows))
    found = {r.gram: (r.n, r.p) for r in model.collect()}
    assert set(found) == set(n[5]) and all(found[g] == (n[5][g], pytest.approx(p[5][g])) for g in found)


def test_stored_model_is_sorted_hash_arrays(spark):
    rows = spark.createDataFrame([("the cat sat on the mat", "x"), ("the cat ran", "y")], "text string, lang string")
    stored = perplexity.store_model(perplexity.kneser_ney(perplexity.count_grams(rows)), 3).collect()
    assert all((e := [x.key for x in r.entries]) == sorted(e) and all(k >> 61 == r.slice for k in e) for r in stored) and len(stored) > 4


def test_runs_of_many_characters_equal_those_of_few():
    """The sort of packed numbers and that of hashes give the same counts."""
    rng = random.Random(1)
    few = ["".join(rng.choice("abc \n") for _ in range(rng.randint(0, 200))) for _ in range(30)]
    many = [*few, "".join(map(chr, range(0x4E00, 0x4E00 + 9000)))]

    def counted(texts, upto):
        r = perplexity.gram_runs(texts)
        return {(tuple(r.chars[g].tolist()), t): n for g, t, n in zip(r.gram.tolist(), r.text.tolist(), r.n.tolist(), strict=True) if t < upto}

    a, b = counted(few, 30), counted(many, 30)
    assert a == b and sum(a.values()) == sum(map(len, few))


def test_preferences(spark, sf):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello there"), (2, 0, "user", "hi"), (2, 1, "assistant", "go away now please"), (3, 0, "user", "hi"), (3, 1, "assistant", "a"), (4, 0, None, None), (None, 0, "user", "x")]
    got = {r.pair_id: r for r in preference.spans_as_text(preference.format_preferences(preference.pair_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")))).collect()}
    assert got[1].chosen_id == 2 and got[1].rejected_id == 1 and got[1].prompt == "<|user|>\nhi<|end|>\n" and got[1].n_prompt_turns == 1
    a, b = map(int, got[1].chosen_loss.split("-"))
    assert got[1].chosen_text[a:b] == "go away now please<|end|>\n" and got[1].rejected_text == "<|assistant|>\nhello there<|end|>\n"
    assert got[3].rejected_id is None and got[3].rejected_text is None and got[3].chosen_text == "<|assistant|>\na<|end|>\n"
    assert got[4].prompt == "<||>\n<|end|>\n" and None in got
    named = spark.createDataFrame([(f"c{i}", t, r, x) for i in (3, 1, 2) for t, r, x in ((0, "user", "hi"), (1, "assistant", "a" * i))] + [(None, 0, "user", "hi")], "conv_id string, turn int, role string, text string")
    paired = preference.pair_conversations(named)
    got = {r.pair_id: r for r in preference.format_preferences(paired.withColumn("prompt", F.lit(7)).withColumn("mine", F.lit("m"))).collect()}
    assert set(got) == {None, "c2"} and got["c2"].chosen_id == "c3" and got[None].rejected_id is None and got["c2"].prompt == "<|user|>\nhi<|end|>\n" and got["c2"].mine == "m"
    many = [(i * 10**12, t, r, f"{i}" * t) for i in range(300) for t, r in ((0, "user"), (1, "assistant"))]
    paired = preference.pair_conversations(spark.createDataFrame(many, "conv_id long, turn int, role string, text string")).collect()
    assert sorted((r.pair_id, *sorted((r.chosen_id, r.rejected_id))) for r in paired) == [(i * 10**12, i * 10**12, (i + 1) * 10**12) for i in range(0, 300, 2)]
    long = "x" * 300_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 1, "assistant", long)]
    r = preference.format_preferences(preference.pair_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))).collect()[0]
    assert r.n_prompt_turns == 2 and len(r.chosen_text) == 300_000 + 22 and len(r.prompt) > 600_000
    empty = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert preference.format_preferences(preference.pair_conversations(empty)).count() == 0


def test_preference_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    rel = con.sql(preference.PREFERENCE_SQL)
    got = queries.op5_preference_formatting(spark, sf)
    assert sorted(map(repr, (tuple(r[c] for c in rel.columns) for r in got.collect()))) == sorted(map(repr, rel.fetchall()))


TRICKY = ["", "  a  b\n\n c", "it's we'll 'S ''re 'r 'v' 'lx 'll're", "\x00\x01 a\x00b", "日本語 مرحبا 😀😀", "a" * 3000, "　x y", "1234567890" * 50, "a<|endoftext|>b <|endoftext|><|endoftext|> 'r", "'", " 's x", "ΑΣ Σ İI"]


def tricky():
    rng = random.Random(7)
    parts = ["'", "s", "r", "e", "l", "v", " ", " ", "\n", "a", "B", "1", "!", ".", ",", "é", "É", "　", "\t", "😀", "The", "ing", "\x01", "<|endoftext|>"]
    return TRICKY + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(800)]


def test_token_counts(spark, sf, docs, odd, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [*tricky(), None, *docs.values()]
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    count = transducer.TokenCounter(path)
    assert count.count_batch(texts).tolist() == want
    count.merger.max_states = 50  # forgets, with the same results
    assert sum((count.count_batch(texts[a : a + 100]).tolist() for a in range(0, len(texts), 100)), []) == want
    got = transducer.token_counts(odd).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_bytes, r.over_limit) for r in got) == sorted((r[0] or 0, n := len(library.encode(r[1] or "", add_special_tokens=False).ids), len((r[1] or "").encode()), n > 1024) for r in ODD)
    assert transducer.token_counts(none).count() == 0


def test_splitter_scan_does_not_depend_on_chunks():
    rng = np.random.default_rng(3)
    classes = rng.integers(0, transducer.CLASSES, 5000).astype(np.uint8)
    assert all((transducer.split_chunks(classes, n) == transducer.split_chunks(classes, 5000)).all() for n in (1, 7, 64))


def test_counting_machine_does_not_depend_on_chunks():
    """Long pre-tokens span many chunks, whose maps are composed; the states that come in are few or many."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    merger = transducer.counter(path).merger
    rng = random.Random(2)
    words = ["a" * 700, "ab" * 400 + "c", "".join(rng.choice("abcdefghijklmnop") for _ in range(900)), "x", "-=" * 300, "é" * 300, "the", "aaab" * 111]
    for chunk in (1, 3, 16, 64, 512):
        for warm in (0, 5, 48):
            raw = [w.encode() for w in words]
            begins = np.cumsum([0, *map(len, raw)])[:-1]
            deltas = merger.count(np.frombuffer(b"".join(raw), np.uint8), begins, chunk, warm)
            got = np.add.reduceat(deltas.astype(np.int64), begins).tolist()
            assert got == [len(library.encode(w, add_special_tokens=False).ids) for w in words]


def check_packing(rows, size, want):
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for places in seqs.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= size
    return len(seqs)


def pieces(texts, size):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, t in texts:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for p, at in enumerate(range(0, len(ids), size)):
            part = ids[at : at + size]
            yield i, p, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())


def test_packing(spark, sf, docs, odd, none):
    rows = queries.op7_best_fit_packing(spark, sf).collect()
    n = check_packing(rows, 4096, list(pieces(docs.items(), 4096)))
    assert n <= 1.03 * -(-sum(r.length for r in rows) // 4096) + 1
    check_packing(packing.best_fit_packing(odd).collect(), 4096, list(pieces([(r[0] or 0, r[1]) for r in ODD], 4096)))
    assert packing.best_fit_packing(none).count() == 0
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    assert [x.tolist() for x in packing.encoder(path).encode(pa.array(tricky()))] == [library.encode(t, add_special_tokens=False).ids for t in tricky()]
    assert packing.reads_words(path)
    small = packing.WordIds(path, max_kept=50)  # forgets, with the same results
    assert [x.tolist() for a in range(0, 812, 100) for x in small.encode(pa.array(tricky()[a : a + 100]))] == [library.encode(t, add_special_tokens=False).ids for t in tricky()]
    other = public_tokenizers.path("byte_bpe_50k.json")  # of another kind: whole texts go to the library
    library = Tokenizer.from_file(other)
    assert not packing.reads_words(other)
    assert [x.tolist() for x in packing.encoder(other).encode(pa.array(tricky()))] == [library.encode(t, add_special_tokens=False).ids for t in tricky()]
    same = odd.limit(0).unionByName(odd.sparkSession.createDataFrame([(None, "hot text", "en", "s", 1, True, 1, "s", 2, "d")] * 300, SCHEMA))
    assert check_packing(packing.best_fit_packing(same, size=64).collect(), 64, [(0, 0, 0, 3, zlib.crc32(np.array([*Tokenizer.from_file(path).encode("hot text").ids, 1], "<u4").tobytes()))] * 300) == 15


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_every_piece(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 1001, 600) if seed else np.full(600, 1000)
    hist = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
    large = {x: c for x, c in hist.items() if x > 125}
    begins, places, n = packing.plan_large(large, 1000, 12)
    runs = np.array(sorted(places.runs.get(0, [])), np.int64).reshape(-1, 4)
    load = collections.Counter()
    for x, b, c in begins:
        at, r = packing._locate(runs, np.arange(b, b + c))
        for s in (runs[at, 1] + r // runs[at, 2]).tolist():
            load[s] += x
    assert max(load.values(), default=0) <= 1000 and sum(load.values()) == sum(x * c for x, c in large.items()) and set(load) <= set(range(n))
    free = collections.Counter(1000 - v for v in load.values())
    small = {x: c for x, c in hist.items() if x <= 125}
    fill, opened = packing.plan_small(dict(free), small, 1000, n)
    used = collections.Counter()
    for x, t in fill.items():
        t = np.array(t, np.int64).reshape(-1, 5)
        at, r = packing._locate(t, np.arange(small[x]))
        for origin, number in zip(t[at, 1].tolist(), (t[at, 2] + r // t[at, 3]).tolist(), strict=True):
            used[origin, number] += x
    assert all(v <= (1000 if o < 0 else o) and (o < 0 or k < free[o]) for (o, k), v in used.items())


def test_warc(spark, sf):
    rows = [(1, "u", "a" * 200), (2, None, "a" * 200), (3, "http://x/\r\nEvil: 1", "b" * 50), (4, "u", "b" * 50), (5, "u", None), (6, "u", "x\r\n\r\nWARC/1.1\r\n" * 20), (7, "é", "ü" * 50), (7, "é", "ü" * 50), (None, "u", "a" * 200)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, record_type string")
    got = collections.defaultdict(list)
    for r in warc.deduplicate_archives(pages).collect():
        got[r.page_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert (got[2][0].record_type, got[2][0].refers_to, got[2][0].payload_bytes) == ("revisit", 1, 200) and got[None][0].refers_to == 1
    assert got[3][0].record_type == got[4][0].record_type == got[5][0].record_type == "response" and len(got[7]) == 2
    for i, _, html in rows:
        assert got[i][0].payload_digest == hashlib.sha256((html or "").encode()).hexdigest()
    folder = new_folder(spark, "test")
    warc.write_archives(pages, warc.resolve_revisits(pages), folder)
    back = {r.id: r for r in warc.read_archives(spark, folder).collect()}
    assert bytes(back[6].payload) == rows[5][2].encode() and back[2].payload is None and back[2].stored_bytes == 0
    assert warc.deduplicate_archives(pages.limit(0)).count() == 0
    with pytest.raises(warc.MalformedArchive):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))
    whole = b"".join(b"WARC/1.1\r\nContent-Length: %d\r\nX: y\r\n\r\n%s\r\n\r\n" % (n, b"z" * n) for n in (0, 5, 3_000_000, 1))
    import gzip

    members = gzip.compress(whole[:2_000_000]) + gzip.compress(whole[2_000_000:])
    for raw in (whole, gzip.compress(whole), members):
        assert [len(b) for _, b in warc.parse_records(raw)] == [0, 5, 3_000_000, 1]
    for raw in (members[:-9], members[:100], whole[:-1]):
        with pytest.raises(warc.MalformedArchive):
            list(warc.parse_records(raw))


def test_warc_strange_ids_and_sizes(spark):
    ids = ["x\r\nContent-Length: 1", "null", None, "", "a b+c%20>", "ü"]
    rows = [(i, "u", "p" * (150 if n % 2 else 10)) for n, i in enumerate(ids)] + [("big", "u", "q" * 70_000), ("big2", "u", "q" * 70_000), ("huge", None, "r" * 1_100_000)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    folder = new_folder(spark, "test")
    got = {r.page_id: r for r in warc.deduplicate_archives(pages, folder=folder).collect()}
    assert set(got) == {r[0] for r in rows} and got["big2"].refers_to == "big" and got["huge"].payload_bytes == 1_100_000
    same = sorted(i for n, i in enumerate(ids) if n % 2)
    assert all((got[i].record_type, got[i].refers_to) == (("response", None) if i == same[0] else ("revisit", same[0])) for i in same)
    records = warc.read_archives(spark, folder, "string").collect()
    assert sorted((r.id or "-", bytes(r.payload).decode()) for r in records if r.payload is not None) == sorted((r[0] or "-", r[2]) for r in rows if got[r[0]].record_type == "response")
    raw = [r.content for r in spark.read.format("binaryFile").load(f"{folder}/part-*").collect()]
    heads = [(h, b) for x in raw for h, b in warc.parse_records(bytes(x))]
    assert len(raw) >= 3 and all(b.startswith(b"HTTP/1.1 200 OK\r\n") and h["content-type"].startswith("application/http") for h, b in heads if h["warc-type"] == "response")


def test_flac_round_trips_and_damage():
    rng = np.random.default_rng(2)
    payloads = [b"", b"\0" * 64, b"a" * 9000, bytes(range(256)) * 30, rng.bytes(5000), b"x", (np.sin(np.arange(9000) / 9) * 100 + 128).astype(np.uint8).tobytes(), b"some prose, some more prose. " * 300]
    streams = flac.encode_streams(payloads)
    assert flac.decode_streams(streams) == payloads
    assert [flac.encode_streams([p])[0] for p in payloads] == streams  # whatever else is in a batch
    assert len(streams[6]) < 0.6 * len(payloads[6])
    for i in random.Random(1).sample(range(120, len(streams[7])), 60):
        bad = bytearray(streams[7])
        bad[i] ^= 4
        with pytest.raises(flac.CorruptStream):
            flac.decode_streams([bytes(bad)])


def _by_hand(parts: list[tuple[int, int]], samples: bytes) -> bytes:
    """A stream of one frame of len(samples) with the given subframe bits, as (value, width)."""
    n = len(samples)
    body = "".join(format(v & (1 << w) - 1, f"0{w}b") for v, w in parts)
    body += "0" * (-len(body) % 8)
    head = bytes([0xFF, 0xF8, 0x74, 2, 0]) + (n - 1).to_bytes(2, "big")
    c8 = int(flac.crc_lanes(np.frombuffer(head, np.uint8), np.array([0]), np.array([len(head)]), flac._CRC8, 8)[0])
    frame = head + bytes([c8]) + int(body, 2).to_bytes(len(body) // 8, "big")
    c16 = int(flac.crc_lanes(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]), flac._CRC16, 16)[0])
    info = n.to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | n).to_bytes(8, "big") + hashlib.md5(bytes(b ^ 0x80 for b in samples)).digest()
    return flac.MARKER + b"\x80" + len(info).to_bytes(3, "big") + info + frame + c16.to_bytes(2, "big")


def test_flac_partitions_escapes_and_wasted_bits():
    x = [5, -3, 40, 7, -100, 2, 0, 9]
    rice = [((v << 1 if v >= 0 else -2 * v - 1), 3) for v in x[:4]]
    parts = [(8 << 1, 8), (0, 2), (1, 4), (3, 4)]  # fixed, order 0; two partitions, the first with parameter 3
    for u, k in rice:
        parts += [(1, (u >> k) + 1), (u, k)]
    parts += [(15, 4), (8, 5), *((v, 8) for v in x[4:])]  # the second escaped, 8 bits each
    payload = bytes((v + 128) & 255 for v in x)
    assert flac.decode_streams([_by_hand(parts, payload)]) == [payload]
    y = [4, -8, 100, 0]
    wasted = [(1 << 1 | 1, 8), (1, 2), *((v >> 2, 6) for v in y)]  # verbatim, two bits wasted
    payload = bytes((v + 128) & 255 for v in y)
    assert flac.decode_streams([_by_hand(wasted, payload)]) == [payload]


def test_media(spark, odd, none):
    media = flac.to_media(odd)
    rows = {r.doc_id: r for r in flac.read_media(media).collect()}
    for i, text, *_ in ODD:
        assert bytes(rows[i].payload) == flac.media_payload(text)
    blocks = flac.read_pcm(media.where("doc_id = 5"), samples=1000).orderBy("block").collect()
    assert b"".join(bytes(b.pcm) for b in blocks) == flac.media_payload(ODD[4][1]) and blocks[3].first_sample == 3000
    assert flac.media_digests(flac.media_blocks(odd)).count() == len(ODD) and flac.media_digests(flac.media_blocks(none, parts=2)).count() == 0 and flac.read_media(flac.to_media(none)).count() == 0


def test_byte_bpe(spark, sf, docs, odd, none):
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert ranks == {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in queries.op10_byte_level_bpe(spark, sf).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == bpe.expected_digest(docs[r.doc_id], library.encode_ordinary(docs[r.doc_id] or ""))
    own = bpe.ByteBPE(ranks, public_tokenizers.PATTERN, max_kept=100)
    for t, ids in zip(tricky(), own.encode_batch(tricky()), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t) and own.decode(ids) == t.encode()
    got = bpe.byte_bpe(odd).collect()
    assert sorted(bytes(r.decoded) for r in got) == sorted((r[1] or "").encode() for r in ODD)
    assert bpe.byte_bpe(none).count() == 0


def test_media_query_writes_pcm_blocks(spark, sf, odd, docs, monkeypatch):
    written = collections.defaultdict(list)

    def keep(df, tag, **options):
        written[tag].append(common.stash(df, tag, **options))
        return written[tag][-1]

    monkeypatch.setattr(flac, "stash", keep)
    monkeypatch.setattr(flac, "drop_stash", lambda df: None)
    got = {r.doc_id: r for r in queries.op9_flac_media(spark, sf).collect()}
    rows = [r for part in written["pcm"] for r in part.collect()]
    media = {r.doc_id: bytes(r.media) for part in written["media"] for r in part.collect()}
    assert len(rows) == len(docs) == len(got) == len(media) and len(written["pcm"]) == 4
    for r in rows:
        payload = flac.media_payload(docs[r.doc_id])
        assert [(b.first_sample, bytes(b.pcm)) for b in r.blocks] == [(i, payload[i : i + 4096]) for i in range(0, len(payload), 4096)]
        g, x = got[r.doc_id], np.frombuffer(payload, np.uint8).astype(int) - 128
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len((docs[r.doc_id] or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (g.media_bytes, g.media_sha256) == (len(media[r.doc_id]), hashlib.sha256(media[r.doc_id]).hexdigest())
        assert g.feature == f"n={len(x)};sum={x.sum()};energy={(x * x).sum()};crossings={((x[1:] < 0) != (x[:-1] < 0)).sum()}"


def test_pipeline(spark, sf, odd):
    import corpus_pipeline as c

    docs = table(spark, sf, "documents")
    rules = c.quality_rules_stage(spark, docs, sf)
    want = {r.doc_id for r in perplexity.quality_rules(docs).where("kept").collect()}
    assert {r.doc_id for r in rules.collect()} == want and rules.columns == docs.columns
    kept = c.near_dedup_stage(spark, docs, sf)
    groups = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups.values())) and kept.columns == docs.columns
    assert [n for n, _ in c.STAGES] == ["quality_rules", "quality_classifier", "near_dedup", "packing"]
    final = {r.doc_id for r in c.run(spark, sf).collect()}
    assert final and final <= want
    assert c.near_dedup_stage(spark, odd, sf).count() == len({r[0] for r in ODD}) - 1
    assert c.quality_classifier_stage(spark, odd, sf).columns == odd.columns


@pytest.mark.parametrize("place", range(4))
def test_pipeline_stages_on_empty_and_odd_tables(spark, sf, odd, none, place):
    import corpus_pipeline as c

    name, stage = c.STAGES[place]
    empty = stage(spark, none, sf)
    assert empty.count() == 0
    long = odd.where("doc_id = 9").withColumn("text", F.expr("repeat('plain words of a very long text without an end, ', 20000)"))
    rows = odd.unionByName(long)
    got = stage(spark, rows, sf)
    if name == "packing":
        assert {r.doc_id for r in got.select("doc_id").collect()} == {r[0] for r in ODD} and got.columns == empty.columns
        return
    assert got.columns == empty.columns == odd.columns
    found = collections.Counter(map(repr, got.collect()))
    assert all(n <= m for n, m in zip(found.values(), (collections.Counter(map(repr, rows.collect()))[k] for k in found), strict=True))
    ids = {r.doc_id for r in got.collect()}
    if name == "quality_rules":
        assert not ids & {1, 2, 3, 4, 5}  # without words, too few, and one sentence again and again
    if name == "near_dedup":
        assert {1, 2, 3, 6, None} <= ids and 7 not in ids
    if name == "quality_classifier":  # no label of these documents, or of one class only
        assert got.count() == rows.count()


def test_columns_of_any_name_pass_through(spark, sf, odd):
    import corpus_pipeline as c

    names = ["a.b", "two words", "a`b", "ключ", "carried", "text_score", "id", "lang.x", "1", "_text", "_kept"]
    rows = odd.drop("id")
    for n in names:
        rows = rows.withColumn(n, F.lit(n))
    rows = rows.where("doc_id in (5, 9, 10)").unionByName(rows.where("doc_id = 10").withColumn("text", F.lit(" ".join(f"word{i}" for i in range(99)))))
    for _, stage in c.STAGES[:3]:
        got = stage(spark, rows, sf)
        assert got.columns == rows.columns and all(r[n] == n for r in got.collect() for n in names)
    pairs = preference.pair_conversations(spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn int, role string, text string"))
    got = preference.format_preferences(pairs.withColumn("a.b", F.lit(1)).withColumn("c d", F.lit(2))).collect()[0]
    assert got["a.b"] == 1 and got["c d"] == 2


def test_pipeline_follows_brute_force(spark, sf, docs):
    """From what the first two stages keep: one of each group by all pairs, and pieces by the library."""
    import corpus_pipeline as c

    all_docs = table(spark, sf, "documents")
    kept = c.quality_classifier_stage(spark, c.quality_rules_stage(spark, all_docs, sf), sf).select("doc_id").collect()
    sets = {r.doc_id: shingles(docs[r.doc_id]) for r in kept}
    want = {i for i, root in components(sets).items() if i == root}
    check_packing(c.run(spark, sf).collect(), 4096, list(pieces([(i, docs[i]) for i in want], 4096)))


def test_word_spans_cross_no_text():
    from tessella.llm.textkit import flat, word_spans

    texts = ["ab cd", "", None, "ef", " g h "]
    buf, off = flat(pa.array(texts))
    starts, ends, first = word_spans(buf, off)
    assert [bytes(buf[a:b]).decode() for a, b in zip(starts, ends, strict=True)] == ["ab", "cd", "ef", "g h"] and first.tolist() == [0, 2, 2, 2, 3, 4]
