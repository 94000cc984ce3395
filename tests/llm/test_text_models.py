"""Language ID, toxicity, LM scoring, SentencePiece coding, token counts."""

import collections
import math
import random
import time
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import common, langid, lmscore, spiece, tokencount, toxicity
from loomspark.llm.queries import QUERIES
from tests.conftest import SF
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, score double, lang_pred string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, None, "s", 1.0, "x") for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " \n", "1234 !?", "a", "É", "word " * 30_000, "x" * 20_000, "same", "same"]
BIG = "/root/testdata/sf0.01"


# ---------------------------------------------------------------- language ID


@pytest.fixture(scope="module")
def language_model(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    return langid.fit(docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1"))


def test_languages_of_held_out_texts(spark):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{BIG}/documents.parquet").collect()}
    got = QUERIES["op1_language_id"](spark, BIG).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(docs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang_pred"] == docs[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_texts_have_languages(spark, language_model):
    got = langid.identify(frame(spark, ODD), language_model).orderBy("doc_id").collect()
    assert [r["lang_pred"] == "und" for r in got] == [True] * 4 + [False] * 6
    assert got[0]["score"] == 0.0 and got[8][1:] == got[9][1:]
    kept = langid.drop_unidentified(frame(spark, ODD), language_model, 0.0)
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")] and kept.count() == 6
    assert langid.identify(frame(spark, []), language_model).count() == 0


def test_no_labels(spark):
    model = langid.fit(frame(spark, ["a b c"]))
    assert langid.identify(frame(spark, ["a b c"]), model).first()[1:] == ("und", 0.0)


def test_draws_are_bounded_whatever_the_ids(spark):
    """100,000 rows with null ids, one id, or one text: what comes to the driver keeps its bound."""
    n = 100_000
    for id_, text in [("null", "concat('wort ', id)"), ("7L", "concat('wort ', id)"), ("id", "'ein wort'")]:
        docs = spark.range(n).selectExpr(f"cast({id_} as long) as doc_id", f"{text} as text", "if(id % 10 = 0, 'fr', 'de') as lang")
        sample, languages, bound = langid.draw(docs, 1000, 20_000)
        got = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
        assert languages == ["de", "fr"] and bound == 1000
        assert got == {"de": 1, "fr": 1} if "id" not in text else all(1000 <= got[c] <= 1700 for c in languages)
        marks = docs.selectExpr("doc_id", "if(lang = 'fr', 1, 0) as toxic").filter("doc_id is not null").distinct()
        sample, want = toxicity.draw(docs, marks, 4000, 100_000)
        got = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
        if id_ == "null":
            assert got == {} and want == {0: 0, 1: 0}
        else:
            assert all(min(want[k], 1) <= got[k] <= 1.4 * want[k] + 1 for k in got) and sum(want.values()) <= 4000


def test_repeated_ids_change_no_prediction(spark):
    """The fits take texts, not ids: null ids and one id for all give the model of distinct ids."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    one = langid.identify(docs, langid.fit(docs)).collect()
    for id_ in ("null", "7"):
        model = langid.fit(docs.withColumn("doc_id", F.expr(f"cast({id_} as long)")))
        assert langid.identify(docs, model).collect() == one


def test_families_come_first(language_model):
    assert set(language_model.families) == {"germanic", "romance"} and len(language_model.pairs) == 2


def test_features_stay_inside_texts():
    raw = np.frombuffer(b"abcabcx", np.uint8)
    both = langid.features(raw, np.array([0, 3, 3, 7]))
    assert np.allclose(both[0], langid.features(raw[:3], np.array([0, 3]))[0]) and not both[1].any()


# ---------------------------------------------------------------- toxicity


def test_toxic_texts_are_told_apart(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = [r for r in QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.1").collect()]
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    pos, neg = ([r for r in held if labels[r["doc_id"]] == k] for k in (1, 0))
    assert sum(r["predicted"] for r in pos) >= 0.75 * len(pos) and sum(r["predicted"] for r in neg) <= 0.03 * len(neg)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_odd_texts_have_scores(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = toxicity.score(frame(spark, ODD), model).orderBy("doc_id").collect()
    assert len(got) == len(ODD) and got[0]["score"] == got[1]["score"] == got[3]["score"] and got[8]["score"] == got[9]["score"]
    kept = toxicity.drop_toxic(frame(spark, [*ODD, "you idiot, worthless moron and scum"]), model)
    assert {r["doc_id"] for r in kept.collect()} >= set(range(4)) and kept.filter("doc_id = 10").count() == 0
    assert toxicity.score(frame(spark, []), model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(frame(spark, ODD), none).collect()} == {0.0}


def test_thresholds_see_every_label_at_its_own_mix(spark):
    """Half of the rows of a word are toxic in the sample that trains, a tenth of them in the labels: it is no ground to flag a text."""
    rng = random.Random(2)
    filler = lambda: " ".join("".join(rng.choice("aeioulnrst") for _ in range(6)) for _ in range(6))
    rows = [(i, filler() + (" murk" if i % 2 else ""), "xx", int(i % 20 == 1)) for i in range(4000)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    got = []
    for bound in (500_000, 0):  # both ways of joining the labels
        model = toxicity.fit(docs, labels, max_rows=400, broadcast_rows=bound)
        got.append((model.shift, model.default_shift))
        flagged = toxicity.score(docs, model).filter(F.col("score") >= toxicity.THRESHOLD).count()
        assert flagged < 100  # 2,000 rows have the word and 200 of them are toxic
    assert got[0] == got[1]


def test_no_key_is_lost_to_another():
    rng = np.random.default_rng(1)
    known = np.unique(np.r_[rng.integers(0, 1 << 63, 5000, dtype=np.int64).astype(np.uint64), np.arange(50, dtype=np.uint64)])
    slots = toxicity.Slots(known)
    assert sorted(slots(known)) == list(range(1, len(known) + 1))
    assert not slots(known ^ np.uint64(1 << 40)).any() and not toxicity.Slots(known[:0])(known).any()


def test_long_labelled_texts_teach_too(spark):
    """All toxic texts are far longer than the window."""
    random.seed(8)
    words = [f"w{i}" for i in range(50)]
    words = ["".join(random.choices("abcdefgh", k=6)) for _ in words]
    make = lambda bad: " ".join(random.choices(words, k=300) if not bad else random.choices([*words, "vile"], k=300))
    rows = [(i, make(i % 2), "en") for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels, window=1500)
    assert model.ready and (model.slots[0].size > 40)


def test_filters_equal_look_ups():
    """The trained network and its frozen tables give the same logits."""
    rng = np.random.default_rng(0)
    docs = [[rng.integers(0, 50, k).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(3)] for k in (0, 1, 2, 9)]
    docs = [[d[0]] * 3 for d in docs]
    m = toxicity.train(lambda p: [d[p] for d in docs] * 6, np.array([0, 1, 0, 1] * 6, np.float32), ["a", "b"] * 12, np.arange(24))
    flat, of = [np.concatenate([d[p] for d in docs]) for p in range(3)], np.repeat(np.arange(4), [0, 1, 2, 9])
    z, _ = m.logits(m.rows(flat), of, 4)
    assert np.allclose(z, m.forward(m.rows(flat), of, 4) @ m.out + m.bias, atol=1e-4)


# ---------------------------------------------------------------- LM scoring


def test_base_scores_equal_brute_force(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()] + ODD
    docs = frame(spark, texts).withColumn("trained", F.col("doc_id") % 7 != 2).repartition(3)
    got = {r["doc_id"]: r for r in lmscore.score(docs, lmscore.fit(docs.filter("trained"))).collect()}
    tokens = {i: [*brute.words(t), None] for i, t in enumerate(texts)}
    c = collections.Counter(w for i, t in tokens.items() if i % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(texts)
    for i, t in tokens.items():
        assert got[i]["n_tokens"] == len(t) and got[i]["n_known"] == sum(w in c for w in t) and got[i]["train_tokens"] == n
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert got[i]["score"] < 0
    held = [r for i, r in got.items() if i % 7 == 2]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_equal_brute_force(spark, monkeypatch):
    """With so many bits that no probe errs, the score is that of the exact counts, put into levels."""
    monkeypatch.setattr(lmscore, "ENTRY_BITS", 400)
    random.seed(12)
    words = [f"w{i}" for i in range(25)]
    texts = [" ".join(random.choices(words, weights=range(25, 0, -1), k=random.randint(0, 60))) for _ in range(90)] + [None, "unseen words", "w1 Unseen W1"]
    docs = frame(spark, texts).withColumn("trained", F.col("doc_id") < 70).repartition(3)
    got = {r["doc_id"]: r["score"] for r in lmscore.score(docs, lmscore.fit(docs.filter("trained"))).collect()}
    ends = lambda x: [*brute.words(x), "</s>"]
    one = collections.Counter(w for t in texts[:70] for w in ends(t))
    two = collections.Counter(b for t in texts[:70] for b in zip(["<s>", *ends(t)], ends(t)))
    level = lambda c: float(lmscore._MIDDLE[lmscore.level(np.array([c]))][0])
    v, z = len(one), sum(map(level, one.values()))
    for i, t in enumerate(texts):
        total, before = 0.0, "<s>"
        for w in ends(t):
            c, u, uw = level(one[w]), 70.0 if before == "<s>" else level(one[before]), level(two[before, w])
            p = (c - 0.5 if c else 0.5 * v) / z
            total += math.log10(0.3 * min(uw, u, c) / u + 0.7 * p if u else p)
            before = w
        assert got[i] == pytest.approx(total, abs=1e-9)


def test_ids_of_scored_texts(spark):
    rows = spark.createDataFrame([("7", "a b", True), (None, "a", False)], "doc_id string, text string, trained boolean")
    assert {r["doc_id"] for r in lmscore.score(rows, lmscore.fit(rows.filter("trained"))).collect()} == {7, None}


def test_counts_from_probes(spark):
    text = " ".join(w for k, w in enumerate(["a", "b", "c", "d"]) for _ in range(5**k))
    m = lmscore.fit(frame(spark, [text]).select("text"))
    tok, of = lmscore.tokens(np.frombuffer(b"a b c d never", np.uint8), np.array([0, 13]))
    got = m.count(tok)
    for c, true in zip(got, (1, 5, 25, 125, 0, 1)):
        level = lmscore.level(np.array([true]))[0]
        assert c == lmscore._MIDDLE[level] and (not true or 0.7 < c / true < 1.45)
    assert m.n_tokens == 157 and m.n_distinct == 5


@pytest.mark.parametrize("segment_bytes", [1 << 25, 1 << 9])
def test_filter_grows_with_its_ngrams(spark, monkeypatch, segment_bytes):
    """Short words, nearly all bigrams distinct: many n-grams a byte of text, in few or in many segments."""
    monkeypatch.setattr(lmscore, "SEGMENT_BYTES", segment_bytes, raising=False)
    rng = random.Random(5)
    texts = [" ".join(f"{rng.randrange(1296):x}" for _ in range(400)) for _ in range(200)]
    docs = frame(spark, texts).withColumn("trained", F.col("doc_id") % 4 != 0)
    m = lmscore.fit(docs.filter("trained").select("text"))
    tokens = [[w.encode() for w in t.split()] + [None] for t in texts]
    one, two = collections.Counter(), collections.Counter()
    for i, t in enumerate(tokens):
        if i % 4:
            one.update(t)
            two.update(zip([0, *t], t))
    quantised = lambda c: lmscore._MIDDLE[lmscore.level(np.array([c]))[0]]
    z = sum(quantised(c) for c in one.values())
    got = {r["doc_id"]: r["score"] for r in lmscore.score(docs, m).collect()}
    off = 0.0
    for i, t in enumerate(tokens):
        want = 0.0
        for u, w in zip([0, *t], t):
            cw, cu = quantised(one[w]), quantised(one[u]) if u != 0 else 150
            p1 = (cw - 0.5 if cw else 0.5 * len(one)) / z
            want += math.log10(0.3 * min(quantised(two[u, w]), cu, cw) / cu + 0.7 * p1 if cu else p1)
        off += abs(got[i] - want)
    assert off / sum(map(len, tokens)) < 0.005


def test_lm_of_nothing(spark):
    empty = frame(spark, []).withColumn("trained", F.lit(True))
    m = lmscore.fit(empty.select("text"))
    assert m.n_tokens == 0 and lmscore.score(empty, m).count() == 0
    r = lmscore.score(frame(spark, [None]).withColumn("trained", F.lit(False)), m).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (1, 0, 0, 0.0)


def test_small_blocks_change_nothing(spark, monkeypatch):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": texts})
    whole = list(lmscore._blocks(iter([batch])))
    monkeypatch.setattr(lmscore, "BLOCK_WORDS", 50)
    monkeypatch.setattr(common, "CHUNK_BYTES", 500)
    parts = list(lmscore._blocks(iter([batch])))
    assert len(parts) > 20 and np.array_equal(np.concatenate([p[1] for p in parts]), np.concatenate([p[1] for p in whole]))


@pytest.mark.parametrize("segment_bytes", [1 << 25, 1 << 11])
def test_fitting_and_scoring_at_once_change_nothing(spark, monkeypatch, segment_bytes):
    monkeypatch.setattr(lmscore, "SEGMENT_BYTES", segment_bytes)
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()] + ODD
    docs = frame(spark, texts).select(F.when(F.col("doc_id") != 3, F.col("doc_id")).alias("doc_id"), "text", F.when(F.col("doc_id") != 5, F.col("doc_id") % 7 != 2).alias("trained")).repartition(3, "doc_id")
    rows = lambda found: sorted(map(tuple, found.collect()), key=str)
    got = rows(lmscore.fit_score(docs))
    assert len(got) == len(texts) and got == rows(lmscore.score(docs, lmscore.fit(docs.filter("trained"))))
    untaught = docs.withColumn("trained", F.lit(False))
    assert rows(lmscore.fit_score(untaught)) == rows(lmscore.score(untaught, lmscore.fit(untaught.filter("trained"))))
    assert lmscore.fit_score(docs.limit(0)).count() == 0


def test_ngrams_are_shuffled_once(spark):
    """The n-grams were shuffled for the filter and again for the probes, with the filter: 3.93 times the input, 4.23 on disk."""
    plan = QUERIES["op5_lm_scoring"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Union" not in plan and "ExistingRDD" not in plan


def test_frequent_tokens_have_small_numbers():
    at = np.random.default_rng(1).permutation(5000)[np.minimum(np.random.default_rng(2).zipf(1.3, 50_000), 5000) - 1]
    _, at, seen = np.unique(at, return_inverse=True, return_counts=True)
    packed = lmscore._pack(np.argsort(lmscore._by_count(seen))[at])
    assert np.array_equal(lmscore._by_count(seen)[lmscore._unpack(packed).astype(np.int64)], at)
    assert len(packed) + len(lmscore._pack(seen)) < 0.9 * len(lmscore._pack(at))


# ---------------------------------------------------------------- SentencePiece

CHARS = ["a", "b", "the", " ", "  ", "▁", "é", "日本", "\n", "🙂", "x" * 60, "\0", "of", "ing "]


@pytest.fixture(scope="module")
def vocabulary():
    return spiece.vocabulary(spiece.default_model())


def best_by_brute_force(v, codes, literal):
    """Highest score over all segmentations, by dynamic programming on strings, ties to the longer last piece."""
    text = "".join(map(chr, codes))
    best = [(0, [])]
    for end in range(1, len(text) + 1):
        c = text[end - 1]
        top = (best[end - 1][0] + spiece.BYTE_SCORE * len(c.encode()), best[end - 1][1] + spiece.byte_ids(v, c))
        for start in range(end - 1, max(-1, end - v.longest - 1), -1):
            got = v.score.get(text[start:end])
            if got and not literal[start:end].any() and best[start][0] + got[0] >= top[0]:
                top = (best[start][0] + got[0], best[start][1] + [got[1]])
        best.append(top)
    return best[-1][1]


def test_ids_equal_brute_force_and_come_back(vocabulary):
    random.seed(3)
    texts = ["".join(random.choices(CHARS, k=random.randint(0, 25))) for _ in range(150)] + ["x" * 500 + " y", " " * 70]
    flat, n = spiece.encode_batch(vocabulary, texts)
    at = np.r_[0, np.cumsum(n)]
    raw, off = spiece.decode_batch(vocabulary, flat, n)
    for i, t in enumerate(texts):
        codes = np.array([ord(c) for c in t], np.uint32)
        literal = codes == 0x2581
        codes[codes == 32] = 0x2581
        ids = flat[at[i] : at[i + 1]].tolist()
        assert ids == best_by_brute_force(vocabulary, codes, literal)
        assert raw[off[i] : off[i + 1]].tobytes().decode() == t


def test_window_is_bounded_and_commits_early(vocabulary):
    random.seed(4)
    texts = ["".join(random.choices("abcdefgthinger\u2581\u65e5", k=k)) for k in (3_000, 500, 70, 33, 32, 16, 1)]
    codes = np.array([spiece.LITERAL if c == "\u2581" else ord(c) for c in "".join(texts)], np.int64)
    length = np.array([len(t) for t in texts])
    first = np.cumsum(length) - length
    w = spiece.Windows(vocabulary, codes, first, length)
    w.run()
    assert w.most_kept <= 8 * vocabulary.longest < 500
    assert len(w.out) > 2 * 3_000 / w.most_kept  # ids are given out all along the way
    flat, n = spiece.viterbi(vocabulary, codes, first, length)
    at = np.r_[0, np.cumsum(n)]
    for i, t in enumerate(texts):
        plain = np.array([ord(c) for c in t], np.uint32)
        assert flat[at[i] : at[i + 1]].tolist() == best_by_brute_force(vocabulary, plain, plain == 0x2581)


def ids_by_rows(v, text):
    """Ids of the best path, by a row of dynamic programming for each character."""
    text = text.replace(" ", "\u2581")
    best, back = [0], [None]
    for end, c in enumerate(text, 1):
        options = [(best[end - 1] + spiece.BYTE_SCORE * len(c.encode()), 0, None)]
        for k in range(1, min(v.longest, end) + 1):
            if got := v.score.get(text[end - k : end]):
                options.append((best[end - k] + got[0], k, got[1]))
        score, k, i = max(options, key=lambda o: o[:2])
        best.append(score)
        back.append((k, i))
    out, end = [], len(text)
    while end:
        k, i = back[end]
        out += [i] if k else spiece.byte_ids(v, text[end - 1])[::-1]
        end -= k or 1
    return out[::-1]


def test_runs_are_coded_by_their_period(vocabulary):
    random.seed(6)
    units = [" ", "-", "=", "*", ".", "a", "0", "\n", "-=", "ab", "_-", "--=", "the", "\U0010ffff", "\u65e5"]
    texts = [u * n for u in units for n in (1, 17, 100, 199, 255, 256, 257, 300, 1001)]
    for _ in range(60):  # runs in the middle of other text, and next to other runs
        texts.append("".join(random.choice([random.choice(units) * random.randint(1, 900), "".join(random.choices("abethr-= _.", k=random.randint(0, 20)))]) for _ in range(5)))
    memo = spiece.Memo()
    for t in texts:
        assert spiece.encode_batch(vocabulary, [t], memo)[0].tolist() == ids_by_rows(vocabulary, t)
    flat, n = spiece.encode_batch(vocabulary, texts)  # all of them side by side
    assert flat.tolist() == [i for t in texts for i in ids_by_rows(vocabulary, t)]


@pytest.mark.parametrize("unit", [" ", "-", "=", "a", "-=", "ab"])
def test_window_is_bounded_on_runs(vocabulary, unit):
    text = "ha" + unit * (1_000_000 // len(unit)) + "th"
    codes = np.array([0x2581 if c == " " else ord(c) for c in text], np.int64)
    one = spiece.Alone(vocabulary, codes, spiece.repeats(codes, vocabulary.longest))
    began = time.process_time()
    end, ids = one.run()
    assert time.process_time() - began < 5
    assert one.most_kept < 64 * vocabulary.longest and end[-1] == len(codes) and (np.diff(end) > 0).all()
    tracemalloc.start()
    flat, n = spiece.encode_batch(vocabulary, [text])
    assert tracemalloc.get_traced_memory()[1] < 64 * len(text)
    tracemalloc.stop()
    raw, _ = spiece.decode_batch(vocabulary, flat, n)
    assert raw.tobytes().decode() == text


def test_real_texts_pass_through_the_windows(spark, vocabulary, monkeypatch):
    """Every stream of real texts is coded by Windows, once, and the memo changes nothing, full or not."""
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()]
    streams = []
    run = spiece.Windows.run
    monkeypatch.setattr(spiece.Windows, "run", lambda self: (streams.append(len(self.first)), run(self))[1])
    memo = spiece.Memo()
    want = [spiece.encode_batch(vocabulary, [t]) for t in texts]
    streams.clear()
    got = [spiece.encode_batch(vocabulary, [t], memo) for t in texts]
    assert sum(streams) == len(memo.key) > 100
    monkeypatch.setattr(spiece, "MEMO", 50)
    memo = spiece.Memo()
    small = [spiece.encode_batch(vocabulary, [t], memo) for t in texts]
    assert len(memo.key) <= 50
    for t, w, *others in zip(texts, want, got, small):
        assert all(np.array_equal(w[0], o[0]) for o in others)
        codes = np.array([ord(c) for c in t[:2000]], np.uint32)
        literal = codes == 0x2581
        codes[codes == 32] = 0x2581
        if len(t) <= 2000:
            assert w[0].tolist() == best_by_brute_force(vocabulary, codes, literal)


def test_coding_of_frames(spark):
    docs = frame(spark, ODD)
    got = spiece.encode(docs)
    rows = got.orderBy("doc_id").collect()
    assert [r["restored"] for r in rows] == [None] + [True] * 9 and rows[0]["ids"] is None and rows[1]["ids"] == []
    back = spiece.decode(got).orderBy("doc_id").collect()
    assert [r["text"] for r in back] == ODD
    assert spiece.encode(frame(spark, [])).count() == 0
    assert QUERIES["op9_sentencepiece"](spark, SF).filter("not restored").count() == 0


# ---------------------------------------------------------------- token counts


@pytest.fixture(scope="module")
def count():
    encode = tokencount.encoder(tokencount.default_ranks()).encode_ordinary
    return lambda parts: [len(encode(p)) for p in parts]


def test_edits_equal_recounting(count):
    random.seed(5)
    alphabet = ["a", "b ", " ", "\n", "'s", "é", "7", "!!", "  ", "x" * 30, "日"]
    for _ in range(400):
        text = "".join(random.choices(alphabet, k=random.randint(0, 60)))
        parts = tokencount.leaves(text, 4)
        tree = tokencount.TokenTree(parts, count(parts), count, 4)
        assert tree.text == text
        for _ in range(6):
            a, n, put = random.randint(0, len(text) + 1), random.randint(0, 6), "".join(random.choices(alphabet, k=random.randint(0, 3)))
            tree.edit(a, n, put)
            text = text[:a] + put + text[a + n :]
            assert tree.text == text and tree.total == count([text])[0]


def test_only_touched_regions_are_encoded(count):
    text = "some plain words here " * 5000
    parts = tokencount.leaves(text)
    tree = tokencount.TokenTree(parts, count(parts), count)
    tree.edit(50_000, 10, "other")
    assert tree.total == count([text[:50_000] + "other" + text[50_010:]])[0] and tree.reencoded < 2000


def test_many_appends_cost_their_own_length(count):
    """No leaf grows with the number of edits, and the tree stays flat."""
    text = "a first line of the text\n" * 400
    parts = tokencount.leaves(text)
    tree = tokencount.TokenTree(parts, count(parts), count)
    for k in range(1000):
        put = f" and appended words no {k % 10}"
        tree.edit(len(text), 0, put)
        text += put
    for k in range(200):
        tree.edit(5000 + 7 * k, 3, f" mid{k % 7}")
        text = text[: 5000 + 7 * k] + f" mid{k % 7}" + text[5003 + 7 * k :]
    assert tree.text == text and tree.total == count([text])[0]
    assert tree.reencoded < 1_000_000 and max(map(len, tree.parts)) < 3 * tokencount.LEAF_CHARS

    def depth(node):
        return 0 if node is None else 1 + max(depth(node.left), depth(node.right))

    assert depth(tree.root) <= 5 * np.log2(len(tree.parts) + 1)


def test_recount_of_frames(spark, count):
    texts = [*ODD, "one two three four five"]
    edits = [{"start": 4, "length": 3, "replacement": "2"}, {"start": 5, "length": 30, "replacement": None}, {"start": 0, "length": 0, "replacement": "# "}]
    docs = frame(spark, texts).withColumn("edits", F.array(*[F.struct(F.lit(e["start"]).alias("start"), F.lit(e["length"]).alias("length"), F.lit(e["replacement"]).cast("string").alias("replacement")) for e in edits]))
    for r in tokencount.recount(docs).collect():
        t = texts[r["doc_id"]]
        if t is None:
            assert r["n_tokens"] is None and r["n_tokens_edited"] is None
            continue
        assert r["n_tokens"] == count([t])[0]
        new = "# " + t[:4] + "2" + t[35:]
        assert r["n_tokens_edited"] == count([new])[0]
    plain = tokencount.recount(frame(spark, texts).withColumn("edits", F.lit(None).cast("array<struct<start:int,length:int,replacement:string>>"))).collect()
    assert all(r["n_tokens"] == r["n_tokens_edited"] for r in plain)
