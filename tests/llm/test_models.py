"""The classifiers on their held-out folds, and the language model against a plain recursion and SQL."""

import math
import zlib

import duckdb
import numpy as np
import pytest

from concordia.llm import bpe, language, lattice_lm as LM, quality
from concordia.llm.token_counts import unigram_vocabulary
from llm_model import MODEL

FOLDER = "/root/testdata/sf0.01"


def test_quality_on_the_held_out_fold(spark):
    documents, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = quality.score(documents, quality.fit(documents, labels)).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.95


def test_quality_gradients():
    rng = np.random.default_rng(0)
    texts, y = [bytes(rng.integers(97, 110, n).astype(np.uint8)) for n in (40, 300, 700)], np.array([0, 1, 1], np.float32)
    net = quality.train(texts, [0, 1, 1], seed=1)
    for p in net.parts():
        p[...] = p + rng.normal(0, 0.05, p.shape)
    each = [quality.chunks_of(t) for t in texts]

    def loss():
        p = np.clip(quality.probabilities(net, texts), 1e-9, 1 - 1e-9)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = quality._gradients(net, each, y, np.ones(3, np.float32))
    for p, g in zip(net.parts(), grads):
        # the weight with the steepest gradient: of filters, bias and the output's weights
        k = np.unravel_index(np.abs(g).argmax(), g.shape)
        before, step = p[k], 3e-3
        p[k] = before + step
        up = loss()
        p[k] = before - step
        down = loss()
        p[k] = before
        assert abs((up - down) / (2 * step) - g[k]) < 0.05 * abs(g[k]) + 2e-3


def plain_probability(net, data):
    """The network by plain loops over chunks, filters and places."""
    n = max(1, -(-(len(data) - (quality.CHUNK - quality.STEP)) // quality.STEP))
    data = data.ljust((n - 1) * quality.STEP + quality.CHUNK, b"\0")
    pool = []
    for c in range(n):
        chunk = data[c * quality.STEP : c * quality.STEP + quality.CHUNK]
        tops = []
        for f in range(quality.FILTERS):
            best = max(sum(float(net.filters[k][chunk[i + k]][f]) for k in range(quality.SPAN)) for i in range(quality.CHUNK - quality.SPAN + 1))
            tops.append(max(0.0, best + float(net.bias[f])))
        pool.append(tops)
    z = float(net.offset[0])
    for f in range(quality.FILTERS):
        column = [row[f] for row in pool]
        z += sum(column) / n * float(net.mean_weight[f]) + max(column) * float(net.max_weight[f])
    return 1 / (1 + math.exp(-z))


def test_quality_like_plain_loops(spark, texts):
    folder = "/root/testdata/sf0.001"
    documents, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    net = quality.fit(documents, labels)
    some = [i for i, t in texts.items() if len(t) < 3000][:8]
    rows = {r.doc_id: r for r in quality.score(documents, net).collect()}
    for i in some:
        want = plain_probability(net, texts[i].encode())
        assert rows[i].score == pytest.approx(want, abs=1e-4) and rows[i].predicted == (rows[i].score >= 0.5)
    assert len(rows) == len(texts)


def test_quality_sample_takes_whole_texts_and_one_row_of_an_id(spark):
    long = "x " * 100_000 + "the end"
    docs = spark.createDataFrame([(0, long), (2, "b"), (2, "a"), (2, "a"), (6, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (2, 0, 0), (6, 0, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    held = [i for i in (0, 2, 6) if zlib.crc32(str(i).encode()) % 3 != 1]
    want = {0: (long.encode(), 1), 2: (b"a", 0), 6: (b"", 0)}
    assert [*zip(*quality.sample(docs, labels))] == [want[i] for i in held] and 0 in held
    assert quality.sample(docs, labels, 1)[1].count(0) <= 1


def test_quality_of_a_tie_is_one(spark, odd):
    net = quality.train([], [])
    rows = quality.score(odd, net).collect()
    assert {(r.score, r.predicted) for r in rows} == {(0.5, 1)} and quality.keep_good(odd, net).count() == odd.count()


def test_chunks_cover_the_whole_text():
    for n in (0, 1, quality.CHUNK - 1, quality.CHUNK, quality.CHUNK + 1, 5000):
        data = bytes(1 + k % 250 for k in range(n))
        chunks = quality.chunks_of(data)
        covered = bytearray(max(n, 1) + quality.CHUNK * 2)
        for k, c in enumerate(chunks):
            covered[k * quality.STEP : k * quality.STEP + quality.CHUNK] = c.tobytes()
        assert bytes(covered[:n]) == data
    one_end = quality.train([b"a" * 5000, b"a" * 5000 + b"#$%&" * 50] * 40, [1, 0] * 40)
    s = quality.probabilities(one_end, [b"a" * 9000, b"a" * 9000 + b"#$%&" * 50])
    assert s[0] > 0.5 > s[1]


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(0, 0, 0), (7, 1, 0), (7, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    net = quality.fit(odd, labels)
    rows = quality.score(odd, net).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert quality.keep_good(odd, net).columns == odd.columns
    assert quality.score(empty, quality.fit(empty, labels.limit(0))).count() == 0


def test_language_on_the_held_out_fold(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = language.identify(documents, language.fit(documents)).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in held]) >= 0.97


def plain_language(found, text):
    """Features, votes and probabilities by plain loops over trigrams and pairs."""
    data = b" " + text.lower().encode() + b" "
    counts = {}
    for i in range(len(data) - 2):
        code = ((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 2654435761 & 0xFFFFFFFF) >> 20
        counts[code] = counts.get(code, 0) + 1
    norm = math.sqrt(sum(counts.values()))

    def choose(names):
        votes, margins, closest = [0] * len(names), [0.0] * len(names), [math.inf] * len(names)
        for i, a in enumerate(names):
            for j in range(i + 1, len(names)):
                w = found.machines[a, names[j]]
                m = sum(float(w[c]) * math.sqrt(n) / norm for c, n in counts.items()) + float(w[-1])
                votes[i if m > 0 else j] += 1
                for k, own in ((i, m), (j, -m)):
                    margins[k] += own
                    closest[k] = min(closest[k], own)
        win = max(range(len(names)), key=lambda k: (votes[k], margins[k], -k))
        return names[win], 1 / (1 + math.exp(-4 * closest[win])) if closest[win] < math.inf else 1.0

    family, sure = choose(sorted(found.families))
    lang, p = choose(found.families[family])
    return lang, sure * p


def test_language_like_plain_loops(documents, texts):
    found = language.fit(documents)
    rows = {r.doc_id: r for r in language.identify(documents, found).collect()}
    for i in [i for i, t in texts.items() if any(c.isalpha() for c in t)][:30]:
        lang, score = plain_language(found, texts[i])
        assert rows[i].lang_pred == lang and rows[i].score == pytest.approx(score, abs=1e-4)


def test_language_ties_and_sample(spark):
    found = language.Identifier({"one": ["aa", "bb", "cc"]}, {p: np.zeros(language.BUCKETS + 1, np.float32) for p in (("aa", "bb"), ("aa", "cc"), ("bb", "cc"))})
    assert found.predict(["some text"] * 2)[0] == ["cc", "cc"]  # a margin of zero speaks for the later name
    long = "eine lange geschichte " * 5000
    docs = spark.createDataFrame([(k, long if k % 2 else "a short story", "de" if k % 2 else "en") for k in (0, 1, 4, 5, 8, 9)] * 2, "doc_id long, text string, lang string")
    assert {lang for names in language.fit(docs, 2).families.values() for lang in names} == {"de", "en"}
    one = language.fit(docs.filter("lang = 'de'"))
    assert [(r.lang_pred, r.score) for r in language.identify(docs.limit(1), one).collect()] == [("de", 1.0)]


def test_signs_that_are_no_letters_are_undetermined(spark, documents):
    """Number signs of Unicode are no letters; a letter of any script is one."""
    found = language.fit(documents)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["½", "²³ 12", "Ⅷ ①", "\u0663", "½ a", "漢", "é1"])], "doc_id int, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(df, found).collect()}
    assert [got[k] for k in range(4)] == [("und", 0.0)] * 4 and all(got[k][0] != "und" for k in (4, 5, 6))


def test_language_odd_rows(odd, empty):
    found = language.fit(odd)
    rows = language.identify(odd, found).collect()
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert {0, 2, 11, 12} <= und and len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert language.identify(odd, language.fit(empty)).filter("lang_pred != 'und'").count() == 0
    assert language.identify(empty, found).count() == 0


VOCABULARY = unigram_vocabulary(bpe.load_vocabulary(MODEL))
PRIOR = LM.start_weights(VOCABULARY)
LATTICE = LM.Lattice((PRIOR, VOCABULARY))
PIECES = {p: PRIOR[i] for i, (p, _, kind) in enumerate(VOCABULARY) if kind == "n"}
BYTES = {int(p[3:5], 16): PRIOR[i] for i, (p, _, kind) in enumerate(VOCABULARY) if kind == "b"}


def recursion(word):
    t = bpe.SPACE + word
    a = [0.0]
    for e in range(1, len(t) + 1):
        terms = [a[s] + PIECES[t[s:e]] for s in range(e) if t[s:e] in PIECES]
        terms += [] if t[e - 1] in PIECES else [a[e - 1] + sum(BYTES[b] for b in t[e - 1].encode())]
        a.append(max(terms) + math.log(sum(math.exp(x - max(terms)) for x in terms)))
    return a[-1]


def test_marginals():
    words = ["the", "a", "naïve", "漢x字", "x" * 70, "͸", "ereation", "lange漢" * 400]
    for got, w in zip(LATTICE.marginals([w.encode() for w in words]), words):
        assert got == pytest.approx(recursion(w), abs=1e-8)
    assert np.exp(PRIOR[np.isfinite(PRIOR)]).sum() == pytest.approx(1)
    assert LATTICE.marginals([]).shape == (0,)


def test_one_long_word_takes_linear_time():
    import time

    seconds = []
    for n in (20_000, 160_000):
        began = time.process_time()
        assert LATTICE.marginals([b"unspaced" * n])[0] < 0
        seconds.append(time.process_time() - began)
    assert seconds[1] < 16 * seconds[0] + 1


@pytest.mark.parametrize("hot_words", [LM.HOT_WORDS, 40])
def test_scores_like_sql_and_recursion(documents, texts, hot_words):
    """With few hot words most occurrences go through the join."""
    rows = {r.doc_id: r for r in LM.score(documents, MODEL, hot_words).collect()}
    held = [i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents_with_fold AS SELECT doc_id, text, doc_id IN (SELECT unnest(?)) AS held_out FROM '/root/testdata/sf0.001/documents.parquet'", [held])
    for doc_id, held_out, n, known, train, base in con.execute(LM.BASE_SQL).fetchall():
        r = rows[doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out, n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    # the score by the plain recursion over every word, with the vocabulary's scores as they are
    marginal, ends = {}, len(texts) - len(held)
    stop = (ends + 1) / (train + 2)
    for i, t in texts.items():
        words = [w.decode() for w in t.encode().lower().split()]
        for w in words:
            if w not in marginal:
                marginal[w] = recursion(w)
        want = math.log(stop) + sum(marginal[w] + math.log(1 - stop) for w in words)
        assert rows[i].score == pytest.approx(want / math.log(10), rel=1e-8)


def test_scores_do_not_depend_on_order_and_long_words_are_hot(spark):
    long = "y" * 500
    data = [(k, f"{long} word{k % 7} Word{k} rare{k} {long}") for k in range(60)]
    a = LM.score(spark.createDataFrame(data, "doc_id long, text string").repartition(5), MODEL, 3).collect()
    b = LM.score(spark.createDataFrame(data[::-1], "doc_id long, text string").repartition(2), MODEL).collect()
    assert sorted(a) == sorted(b) and all(r.n_tokens == 6 for r in a)
    one = next(r for r in a if r.doc_id == 0)
    words = [long, "word0", "word0", "rare0", long]
    ends = sum(zlib.crc32(str(k).encode()) % 7 != 2 for k in range(60))
    stop = (ends + 1) / (one.train_tokens + 2)
    assert one.train_tokens == 6 * ends
    assert one.score * math.log(10) == pytest.approx(math.log(stop) + sum(recursion(w) + math.log(1 - stop) for w in words), rel=1e-8)


def test_language_model_odd_rows(odd, empty):
    rows = LM.score(odd, MODEL).collect()
    assert len(rows) == odd.count()
    assert sum(r.doc_id == 7 for r in rows) == 2 and len({r.score for r in rows if r.doc_id == 7}) == 1
    assert {r.n_tokens for r in rows if r.doc_id in (0, 2)} == {1}
    assert LM.score(empty, MODEL).count() == 0
