"""Personal data, licences and decontamination against brute force."""

import hashlib
import re

import pytest
from hypothesis import given, settings, strategies as st

from concordia.llm import decontamination as DC, license_scan as LS, pii

FIELD = pii.train(pii.labelled_table(), rounds=40)


def brute_base(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15],
    }


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from("0192+-. ()@ab%_"), max_size=60))
def test_base_patterns(text):
    assert pii.base_spans(text) == brute_base(text)


def test_base_on_documents(documents, texts):
    for r in pii.find_personal_data(documents, FIELD).collect():
        base = brute_base(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in base[k])
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(base[k]) for k in pii.KINDS]
        assert {*filter(None, joined.split(","))} <= {*r.spans.split(",")}


def test_long_runs_take_linear_time():
    for run in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "a@" * 50_000, "+1 " * 60_000):
        pii.base_spans(run)


def test_long_texts_take_linear_time():
    """Dense with spans, with and without personal data: eight times the text, at most some sixteen times the time."""
    import time

    unit = "mail ann.b@x.org or bob (at) host.com, call 555-123-4567 or +1 (183) 555-1276 from 10.0.0.1 "
    seconds = []
    for n in (200, 1600):
        text, began = unit * n, time.process_time()
        base = pii.base_spans(text)
        added = pii.added_spans(FIELD, [text], [base])[0]
        seconds.append(time.process_time() - began)
        assert len(base["email"]) == n and len(added) >= n
    assert seconds[1] < 16 * seconds[0] + 1
    began = time.process_time()
    prose = "some plain words without any sign " * 300_000
    assert pii.added_spans(FIELD, [prose + "(at)"], [pii.base_spans(prose)]) == [[]] and time.process_time() - began < 20


_ODD = ["", "no sign", "1", "a" * 300 + "(AT)" + "b" * 300 + ".org", "x y z " * 30 + "q[at]r.com" + " x y z" * 30 + " 55", "\u0663 é1é ñ@ñ . , - " * 9, "Éß 漢字\U00020000b \x00\t+1 (183) 555-12"]


def plain_tokens(text):
    return [m.span() for m in re.finditer(r"[0-9]+|[^\W\d_]+|\S", text) if not m[0].isspace()]


def whole_decode(field, features):
    """Plain Viterbi over all tokens, one after another."""
    import numpy as np

    weights, moves, score, back = field.weights, field.moves, field.first, []
    for k, f in enumerate(features):
        e = np.zeros(len(pii.TAGS))
        for x in f:
            e = e + weights[x]
        if k:
            each = score[:, None] + moves
            back.append(each.argmax(axis=0))
            score = each.max(axis=0)
        score = e + score
    path = [int(score.argmax())] if len(features) else []
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def wild_field(seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    return pii.Field(rng.normal(size=(pii.BUCKETS, len(pii.TAGS))), rng.normal(size=(len(pii.TAGS),) * 2), rng.normal(size=len(pii.TAGS)))


def test_tokens_of_many_texts_are_those_of_each(texts):
    """Tokens by a pattern, and features that don't see other texts."""
    some = _ODD + [t for t in texts.values()][:80] + [""]
    every = pii.Tokens.of(some)
    for k, t in enumerate(some):
        own, mine = pii.Tokens.of([t]), every.text == k
        assert [*zip(own.start.tolist(), own.end.tolist())] == [*zip(every.start[mine].tolist(), every.end[mine].tolist())] == plain_tokens(t)
        assert (own.features == every.features[mine]).all()


def test_every_token_is_decoded(texts):
    """Texts side by side against plain Viterbi over each whole text, also with random weights."""
    import numpy as np

    some = _ODD + [t for t in texts.values() if len(t) < 20_000][:60]
    tokens = pii.Tokens.of(some)
    for field in (FIELD, wild_field(4)):
        got = pii.decode(field, tokens.features, np.bincount(tokens.text, minlength=len(some)))
        for k in range(len(some)):
            assert got[tokens.text == k].tolist() == whole_decode(field, tokens.features[tokens.text == k])


def test_long_texts_are_decoded_by_segments(monkeypatch, texts):
    """Segments of any length give the path of the whole text."""
    import numpy as np

    some = _ODD + [t for t in texts.values() if len(t) < 20_000][:20]
    tokens = pii.Tokens.of(some)
    sizes = np.bincount(tokens.text, minlength=len(some))
    for field in (FIELD, wild_field(9)):
        want = pii.decode(field, tokens.features, sizes)
        for segment in (1, 2, 7, 64):
            monkeypatch.setattr(pii, "SEGMENT", segment)
            monkeypatch.setattr(pii, "MANY", 2)
            assert (pii.decode(field, tokens.features, sizes) == want).all()
        monkeypatch.undo()


def test_added_spans_on_documents(documents, texts):
    """Over the whole table: spans of unconstrained decoding of each whole text."""
    for r in pii.find_personal_data(documents, FIELD).collect():
        text = texts[r.doc_id]
        base = brute_base(text)
        taken = [s for spans in base.values() for s in spans]
        tokens, found, before = pii.Tokens.of([text]), [], ""
        for a, b, tag in zip(tokens.start.tolist(), tokens.end.tolist(), whole_decode(FIELD, tokens.features)):
            kind = pii.TAGS[tag][2:]
            if kind and pii.TAGS[tag][0] == "I" and kind == before:
                found[-1][2] = b
            elif kind:
                found.append([kind, a, b])
            before = kind
        found = [(k, a, b) for k, a, b in found if pii._plausible(k, text[a:b]) and not any(a < e and s < b for s, e in taken)]
        want = sorted([(k, *s) for k, spans in base.items() for s in spans] + found, key=lambda x: (pii.KINDS.index(x[0]), x[1:]))
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in want) and r.n_added == len(found)


def test_field_finds_what_is_planted_in_documents(texts):
    """Numbers without a check digit, national telephone numbers and written-out addresses between words of documents."""
    import random

    rng, empty = random.Random(3), {k: [] for k in pii.KINDS}
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    makers = [("card", lambda: digits(16)), ("phone", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"), ("phone", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}"), ("email", lambda: f"ann.lee (at) {rng.choice(['marti', 'onga'])}.org")]
    found = total = 0
    for k, t in enumerate(list(texts.values())[:160]):
        words = t.split(" ")
        kind, make = makers[k % 4]
        body, at = make(), rng.randrange(len(words) + 1)
        before = " ".join(words[:at])
        text = " ".join([*words[:at], body, *words[at:]])
        start = len(before) + (at > 0)
        total, found = total + 1, found + ((kind, start, start + len(body)) in pii.added_spans(FIELD, [text], [empty])[0])
    assert found >= 0.85 * total


def test_field_finds_held_out_cases():
    cases = pii.labelled_table(300, seed=77)
    empty = {k: [] for k in pii.KINDS}
    right = sum(sorted(pii.added_spans(FIELD, [t], [empty])[0]) == sorted(s) for t, s in cases)
    assert right >= 0.95 * len(cases)


def test_field_decodes_as_by_enumeration():
    import itertools

    import numpy as np

    field, rng = wild_field(1), np.random.default_rng(1)
    sizes = np.array([1, 3, 0, 2, 4, 4, 3])
    features = rng.integers(0, pii.BUCKETS, (sizes.sum(), pii.WIDTH)).astype(np.int16)
    got, at = pii.decode(field, features, sizes), 0
    for n in sizes.tolist():
        emit = [field.weights[f].sum(axis=0) for f in features[at : at + n]]
        value = lambda p: sum(e[t] for e, t in zip(emit, p)) + sum(field.moves[a, b] for a, b in zip(p, p[1:])) + (field.first[p[0]] if p else 0)  # noqa: B023, E731
        assert tuple(got[at : at + n].tolist()) == max(itertools.product(range(len(pii.TAGS)), repeat=n), key=value)
        at += n


def test_licenses_like_brute_force(documents, texts):
    got = {r.doc_id: r.licenses for r in LS.scan_licenses(documents).collect()}
    for i, t in texts.items():
        own = {*LS.shingles_of(LS.words_of(t))}
        want = [n for n, x in LS.all_templates().items() if len(own & (s := {*LS.shingles_of(LS.words_of(x))})) >= 0.8 * len(s)]
        assert got[i] == ",".join(sorted(want))


def test_license_containment_and_place():
    index = LS.Index(LS.all_templates())
    body = LS.TEMPLATES["MIT#2"]
    text = "filler words here " * 300 + body.replace("copy", "cpy", 1) + " more filler" * 300
    (name, a, b, share), *more = index.scan(text)
    assert (name, more) == ("MIT#2", []) and 0.8 <= share < 1 and text[a:b].startswith("Permission is")
    half = " ".join(body.split()[: len(body.split()) // 2])
    assert index.scan("x " * 50 + half) == []
    with pytest.raises(ValueError, match="fewer"):
        LS.Index({"short": "two words"})


@pytest.mark.parametrize("name, block", [("ISC", 10), ("ISC", 20), ("ISC", 300), ("GPL-3.0#2", 40), ("MIT#2", 80), ("MIT#2", 2000)])
def test_license_with_a_block_inside(name, block):
    index = LS.Index({name: LS.TEMPLATES[name]})
    words = LS.TEMPLATES[name].split()
    half = len(words) // 2
    want = {*LS.shingles_of(LS.words_of(LS.TEMPLATES[name]))}
    for before in range(0, 140, 1 if block < 300 else 10):
        text = " ".join(["pad"] * before + words[:half] + ["block"] * block + words[half:] + ["pad"] * 30)
        share = len(want & {*LS.shingles_of(LS.words_of(text))}) / len(want)
        assert share >= 0.8
        assert index.scan(text) == [(name, 4 * before, len(text) - 121, share)]


def test_license_copies_have_a_span_each(spark):
    index = LS.Index(dict(LS.TEMPLATES))
    isc, bsd, mit = (LS.TEMPLATES[n] for n in ("ISC", "BSD-3-Clause", "MIT#1"))
    words = isc.split()
    split = " ".join(words[:15] + ["block"] * 60 + words[15:])
    # strays before and after, copies side by side, with a block inside, and of a template that repeats itself
    text = " ".join(words[15:22] + ["pad"] * 90) + "\n".join(["", isc, isc, split, split, bsd, bsd, mit, mit, ""]) + " ".join(["pad"] * 90 + words[:9])
    got = index.scan(text)
    assert [text[a:b].strip(".") for n, a, b, _ in got if n == "ISC"] == [x.strip(".") for x in (isc, isc, split, split)]
    assert [text[a:b].strip(".") for n, a, b, _ in got if n == "BSD-3-Clause"] == [bsd.strip(".")] * 2
    assert [text[a:b] for n, a, b, _ in got if n == "MIT#1"] == [mit.strip(".")] * 2
    assert [n for n, *_ in got] == ["BSD-3-Clause"] * 2 + ["BSD-notice"] * 2 + ["ISC"] * 4 + ["MIT#1"] * 2
    row = LS.scan_licenses(spark.createDataFrame([(1, text), (1, text)], "doc_id int, text string")).collect()
    assert [(r.n_licenses, r.licenses, len(r.spans)) for r in row] == [(4, "BSD-3-Clause,BSD-notice,ISC,MIT#1", 10)] * 2


def test_whole_licences_are_found_by_their_own_text(spark, tmp_path):
    """As a file has it, wrapped anew, and inside other text; a user's own folder of templates; a part isn't enough."""
    whole = LS.read_templates()
    assert len(whole) >= 7 and min(len(LS.words_of(t)) for t in whole.values()) > 900
    rows = []
    for k, (name, text) in enumerate(sorted(whole.items())):
        rows += [(3 * k, name, text), (3 * k + 1, name, "filler here " * 500 + " ".join(text.split()) + " and so on" * 70), (3 * k + 2, None, " ".join(text.split()[: len(text.split()) // 2]))]
    df = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id int, text string")
    got = {r.doc_id: r.licenses.split(",") for r in LS.scan_licenses(df).collect()}
    for i, name, text in rows:
        assert name in got[i] if name else not any(n.endswith("#text") for n in got[i])
    (tmp_path / "own.txt").write_text("a licence of our own that nobody else has ever seen before")
    mine = LS.scan_licenses(spark.createDataFrame([(1, "see: a licence of our own that nobody else has ever seen before!")], "doc_id int, text string"), LS.read_templates(tmp_path)).head()
    assert mine.licenses == "own#text"


def test_bands_alone_retrieve_what_containment_finds(documents, texts):
    """Recall of the bands over documents, over copies with words put in or changed, and over texts read as one sequence."""
    import random

    index, rng = LS.Index(dict(LS.TEMPLATES)), random.Random(6)
    cases = [t for t in texts.values()]
    for name, body in LS.TEMPLATES.items():
        for k in range(30):
            words = body.split()
            for _ in range(len(words) // 60 * (k % 3 > 0)):
                at = rng.randrange(len(words))
                words[at : at + (k % 3 == 1)] = ["changed"]
            cases.append(" ".join(["pad"] * rng.randrange(900) + words + ["pad"] * rng.randrange(900)))
    sequence = index.scan_all(cases)
    right = total = 0
    for text, found in zip(cases, sequence):
        own = {*LS.shingles_of(LS.words_of(text))}
        want = {n for n, x in LS.TEMPLATES.items() if len(own & (s := {*LS.shingles_of(LS.words_of(x))})) >= 0.8 * len(s)}
        alone = {n for n, *_ in index.retrieved(LS.words_of(text))}
        assert {n for n, *_ in found} == {n for n, *_ in index.scan(text)}
        right, total = right + len(want & alone), total + len(want)
    assert total > 400 and right == total


def test_license_scan_of_a_long_text_takes_linear_time():
    import time

    index = LS.Index(dict(LS.TEMPLATES))
    body, seconds = LS.TEMPLATES["ISC"] + " and some other words between the copies ", []
    for n in (400, 3200):
        began = time.process_time()
        assert sum(x[0] == "ISC" for x in index.scan(body * n)) == n
        seconds.append(time.process_time() - began)
    assert seconds[1] < 16 * seconds[0] + 1


def brute_hits(text, items, size=10):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        for window in {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else ():
            for i in range(len(own) - len(window) + 1):
                if tuple(own[i : i + len(window)]) == window:
                    hit |= {*range(i, i + len(window))}
                    found.add(item)
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("shard_bytes", [DC.SHARD_BYTES, 3000])
def test_decontamination_like_brute_force(spark, documents, texts, benchmark_items, shard_bytes):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    some = documents.filter("doc_id % 4 = 0") if shard_bytes < 10_000 else documents
    rows = DC.decontaminate(some, benchmark, shard_bytes=shard_bytes).collect()
    assert rows
    for r in rows:
        assert (r.n_words, r.n_hit, r["items"]) == brute_hits(texts[r.doc_id], benchmark_items)
        assert r.contaminated == (r.n_hit > 0) == bool(r.spans)


def test_scan_time_does_not_grow_with_the_benchmark():
    """A hundred times the windows and words: the same matches as by search, and about the same time."""
    import random
    import time

    rng, seconds = random.Random(2), []
    text = [b"v%d" % rng.randrange(50_000) for _ in range(200_000)]
    for n in (1000, 100_000):
        words = [b"w%d" % k for k in range(n)]
        windows = [b" ".join(rng.choice(words) for _ in range(10)) for _ in range(n)]
        auto = DC.Automaton((w, [str(k)]) for k, w in enumerate(windows))
        assert max(map(len, auto.code.values())) == auto.digits and len({*"".join(auto.code.values())}) <= 2 * DC.DIGITS
        planted = text[:1000] + windows[7].split() + text[:3] + windows[n - 1].split()[:9]
        assert auto.matches(planted) == [(1000, 1010, 7)]
        began = time.process_time()
        assert auto.matches(text) == []
        seconds.append(time.process_time() - began)
    assert seconds[1] < 5 * seconds[0] + 0.2


@pytest.mark.parametrize("digits", [2, 16])
def test_word_numbers_never_match_across_words(monkeypatch, digits):
    monkeypatch.setattr(DC, "DIGITS", digits)
    import itertools

    words = [b"%c" % c for c in b"abcdefghijklmnopqrs"]
    windows = [b"a b", b"b a b", b"s r", b"c", b"r s r s"]
    auto = DC.Automaton((w, [w.decode()]) for w in [*windows, *words[3:12]])
    for text in itertools.product([b"a", b"b", b"s", b"r", b"c", b"?"], repeat=5):
        want = sorted((i, i + len(w.split()), k) for k, w in enumerate(windows) for i in range(5) if list(text[i : i + len(w.split())]) == w.split())
        assert sorted(auto.matches(list(text))) == want


def test_decontamination_cases(spark, odd, empty):
    items = spark.createDataFrame([("a", "Two words"), ("b", None), ("c", "..."), ("d", "one two three four five six seven eight nine ten eleven"), ("a2", "two words")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "x TWO—words, two words y"), (2, "two-words"), (3, None), (4, "two three four five six seven eight nine ten eleven twelve"), (5, "one two three four five six seven eight nine TEN eleven")], "doc_id int, text string")
    got = {r.doc_id: r for r in DC.decontaminate(docs, items).collect()}
    # the dash is no ASCII character, so it belongs to the word
    assert (got[1].n_words, got[1].n_hit, got[1]["items"]) == (5, 2, ["a", "a2"]) and docs.head().text[got[1].spans[0].start : got[1].spans[0].end] == "two words"
    assert (got[2].n_hit, got[3].n_words, got[3].n_hit, got[4].n_hit, got[5].n_hit) == (2, 0, 0, 10, 11)
    assert [r.doc_id for r in DC.keep_clean(docs, items).collect()] == [3]
    assert [r.doc_id for r in DC.keep_clean(docs, items, shard_bytes=60).collect()] == [3]
    twice = docs.unionByName(docs)
    assert sorted(map(repr, DC.decontaminate(twice, items).collect())) == sorted(map(repr, DC.decontaminate(twice, items, shard_bytes=60).collect())) and DC.shards(items, shard_bytes=60)[0] > 1
    assert DC.decontaminate(odd, items).count() == odd.count() and DC.keep_clean(odd, items.limit(0)).columns == odd.columns
    seven = [r for r in DC.decontaminate(odd, spark.createDataFrame([(1, "b c d"), (2, "B c d")], "item_id int, text string")).collect() if r.doc_id == 7]
    assert [(r.n_words, r.n_hit, r["items"]) for r in seven] == [(12, 3, ["1", "2"])] * 2
    assert DC.decontaminate(odd, items.limit(0)).filter("contaminated").count() == 0
    assert DC.decontaminate(empty, items).count() == pii.find_personal_data(empty, FIELD).count() == LS.scan_licenses(empty).count() == 0


def test_odd_rows(odd):
    every = pii.find_personal_data(odd.unionByName(odd), FIELD).collect()
    rows = {r.doc_id: r for r in every}
    assert len(every) == 2 * odd.count() and all(r == rows[r.doc_id] for r in every if r.doc_id not in (1, None))
    assert rows[0].spans == "" and rows[15].n_email == rows[15].n_phone == 1
    found = LS.scan_licenses(odd).collect()
    assert len(found) == odd.count() and [r.licenses for r in found if r.doc_id == 15] == ["MIT#1"]
