"""The text operators against brute force, and on nulls, empties, ties, repeats, long texts, empty tables and clashing columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import audio, fingerprints, jaccard, licenses, lines, packing, pieces, queries, stages, substring, toxicity, urls
from tallyspark.llm.common import Words, gram_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPLIT = re.compile("[\x20\x09-\x0d]+")


def words(text):
    return [w for w in SPLIT.split(text or "") if w]


def documents(spark, texts, first=0):
    return spark.createDataFrame([(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts, first)], SCHEMA)


def prose(seed, n, vocabulary=4000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


BASE, PASSAGE = prose(1, 300), prose(2, 60)
NEAR = " ".join("other" if i in (40, 200) else w for i, w in enumerate(BASE.split()))
ODD = [None, "", " \t\n", "one", "a b c d", BASE, BASE, NEAR, prose(3, 50) + " " + PASSAGE + " " + prose(4, 50), prose(5, 70) + "\n" + PASSAGE, "é中😀 \x00 x", "x " * 60_000, prose(6, 13), prose(6, 13) + " tail", "line\nline\n" + BASE]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD).cache()


@pytest.fixture(scope="module")
def clashing(odd):
    """The same with columns that the operators use inside."""
    return odd.withColumns({c: F.lit("kept") for c in ("rid", "n", "h", "class", "label", "anchor", "starts", "k1", "bands", "shard", "row", "line", "part", "filter", "keys", "own", "edited", "__n", "cluster", "piece")})


RESULTS = ("Score", "n_lines", "N_DROPPED", "n_words", "n_removed", "repeats", "media", "log_mel", "spans", "n_tokens", "ids", "decoded", "fingerprint", "bin_id", "class_id", "n_links")


@pytest.fixture(scope="module")
def taken(odd):
    """The same with columns that are called like the operators' results."""
    return odd.withColumns({c: F.lit("kept") for c in RESULTS})


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("false")


def test_word_hashes_match_words():
    texts = [(t or "").encode() for t in ODD]
    found = Words(texts)
    for i, t in enumerate(ODD):
        own = slice(found.bounds[i], found.bounds[i + 1])
        assert [found.data[a:b].decode() for a, b in zip(found.starts[own], found.ends[own])] == words(t)
    seen = {}
    for h, a, b in zip(found.hashes, found.starts, found.ends):
        assert seen.setdefault(found.data[a:b], h) == h
    assert len(set(seen.values())) == len(seen)
    assert len(gram_hashes(found.hashes[:3], 5)) == 0


# 1


def shingle_set(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def test_fingerprints(spark, odd, none, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: odd)
    rows = {r.doc_id: r for r in queries.op1_fingerprints(spark, "").collect()}
    assert len(rows) == len(ODD)
    for i, t in enumerate(ODD):
        t, following = t or "", ODD[(i + 1) % len(ODD)] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
        assert rows[i].near_edited == pytest.approx(contained(t, edited), abs=0.25), i
    assert rows[5].fingerprint == rows[6].fingerprint != rows[7].fingerprint and rows[5].near_next == 1
    assert fingerprints.compare_with_next(none).count() == 0
    same = documents(spark, ["a b c d e f g", None]).unionAll(documents(spark, ["a b c d e f g"])).unionAll(spark.createDataFrame([(None, "q r s t u v w x", "en", "s", 1)], SCHEMA))
    assert fingerprints.compare_with_next(same).count() == 4
    a, b = (fingerprints.sketch(F.lit(t)) for t in (BASE, PASSAGE))
    got = spark.range(1).select(fingerprints.merged(a, b).alias("m"), fingerprints.sketch(F.lit(BASE)).alias("a"), fingerprints.sketch(F.lit(PASSAGE)).alias("b")).first()
    assert set(got.m.hashes) == set(got.a.hashes) | set(got.b.hashes) and got.m.n == max(got.a.n, got.b.n) == len(shingle_set(BASE)) and got.m.whole is None


def likeness(spark, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    return [r.x for r in df.select("i", fingerprints.containment(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))).alias("x")).orderBy("i").collect()]


def contained(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a) if a else float(not b)


def test_short_excerpts_of_long_texts(spark):
    rng, pairs = random.Random(12), []
    for i in range(60):
        long = prose(500 + i, 300, 800).split()
        at = rng.randrange(288)
        pairs += [(" ".join(long[at : at + 12]), " ".join(long)), (prose(700 + i, 12, 800), " ".join(long))]
    got = likeness(spark, pairs)
    assert min(got[::2]) > 0 and np.mean(np.abs(np.array(got[::2]) - 1)) < 0.1
    assert np.mean(got[1::2]) < 0.1


def test_containment_of_unequal_texts_near_brute_force(spark):
    pairs = []
    for i in range(40):
        long, other = prose(800 + i, 900).split(), prose(900 + i, 200).split()
        part = long[100 : 100 + 20 * i] + other[: 400 - 10 * i]
        pairs += [(" ".join(part), " ".join(long)), (" ".join(long), " ".join(part))]
    got, want = np.array(likeness(spark, pairs)), np.array([contained(a, b) for a, b in pairs])
    assert np.abs(got - want).mean() < 0.03 and np.abs(got - want).max() < 0.2 and len({*np.round(want, 1)}) > 5


def test_texts_of_one_repeated_word(spark):
    spam, other = " ".join(["spam"] * 200), " ".join(["other"] * 200)
    pairs = [(spam, ""), ("", spam), (spam, other), (other, spam), (spam, spam + " spam"), ("", " \n"), (None, None)]
    assert likeness(spark, pairs) == [0, 0, 0, 0, 1, 1, 1]
    many = [f"word{i}" for i in range(40)]
    assert likeness(spark, [(" ".join([w] * 200), " ".join([v] * 100)) for w, v in zip(many, many[1:])]) == [0] * 39


# 2


def test_packing(spark, odd, clashing, none):
    many = odd.unionAll(documents(spark, [prose(100 + i, 50 + 7 * i) for i in range(80)] + ["copy of a text"] * 40, 1000))
    rows = packing.pack(many, capacity=256, shard_rows=60).collect()
    text = {r.doc_id: r.text or "" for r in many.collect()}
    source = {r.doc_id: r.source for r in many.collect()}
    total, bins = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        total[r.doc_id] += r.length
        bins[r.bin_id].append(r)
        assert r.start == r.piece * 256
    assert set(total) == set(text) and all(total[d] == -(-len(t.encode()) // 4) for d, t in text.items())
    for held in bins.values():
        assert sum(r.length for r in held) <= 256 and sorted(r.place for r in held) == list(range(len(held)))
        assert len({source[r.doc_id] for r in held}) == len(held) and len({text[r.doc_id] for r in held}) == len(held)
    assert packing.pack(clashing).count() == packing.pack(odd).count() and packing.pack(none).count() == 0
    assert packing.pack(odd.withColumn("source", F.lit(None).cast("string"))).count() == packing.pack(odd).count()


def test_near_copies_of_a_class_keep_apart(spark):
    docs = documents(spark, [f"{BASE} end{i}" for i in range(12)] + [prose(40 + i, 30) for i in range(40)]).withColumn("source", F.col("doc_id").cast("string"))
    classed = docs.join(jaccard.near_duplicates(docs).select("doc_id", "class_id"), "doc_id")
    rows = packing.pack(classed, capacity=100_000, cluster=F.col("class_id"), shard_rows=1000).collect()
    assert len({r.bin_id for r in rows if r.doc_id < 12}) == 12 and len({r.bin_id for r in rows}) == 12


def test_best_fit_takes_the_tightest_compatible_bin():
    rng, bins, open_ = random.Random(5), packing.Bins(100), []
    for _ in range(400):
        length, s, c = rng.randrange(0, 80), rng.randrange(5), rng.randrange(30)
        fits = [(left, n) for n, (left, ss, cc) in enumerate(open_) if left >= length and s not in ss and c not in cc and (left > 0)]
        number, _ = bins.put(length, s, c)
        if fits:
            assert open_[number][0] == min(fits)[0]
        else:
            assert number == len(open_)
            open_.append([100, set(), set()])
        open_[number][0] -= length
        open_[number][1].add(s), open_[number][2].add(c)


# 3


def removed(texts):
    """Brute force: words in windows that also start in an earlier document."""
    first, out = {}, []
    split = [words(t) for t in texts]
    for i, w in enumerate(split):
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    for i, w in enumerate(split):
        gone = set()
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < i:
                gone.update(range(p, p + 13))
        out.append([x for j, x in enumerate(w) if j not in gone])
    return out


def test_substring_dedup(spark, odd, clashing, none, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: odd)
    rows = {r.doc_id: r for r in queries.op3_substring_dedup(spark, "").collect()}
    for i, kept in enumerate(removed(ODD)):
        assert rows[i].n_removed == len(words(ODD[i])) - len(kept), i
        assert rows[i].kept_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()
    out = substring.drop_repeats(clashing)
    assert out.columns == [*clashing.columns, "n_words", "n_removed", "repeats"] and out.filter("rid = 'kept'").count() == len(ODD)
    assert substring.drop_repeats(none).count() == 0
    twice = odd.unionAll(odd).unionAll(spark.createDataFrame([(None, BASE, "en", "s", 1)], SCHEMA))
    again = substring.drop_repeats(twice)
    assert again.count() == 2 * len(ODD) + 1 and again.filter("doc_id IS NULL").first().n_removed == 0
    assert again.agg(F.sum("n_removed")).first()[0] == 2 * sum(r.n_removed for r in rows.values())


def extended(texts, window=13, gram=5):
    """Seed and extend, word by word: spans of matches of at least ``window`` words with an earlier text."""
    split, out = [words(t) for t in texts], []
    places = collections.defaultdict(list)
    for i, w in enumerate(split):
        gone = set()
        for p in range(len(w) - gram + 1):
            for j, q in places[tuple(w[p : p + gram])]:
                a = b = 0
                while p - a > 0 and q - a > 0 and w[p - a - 1] == split[j][q - a - 1]:
                    a += 1
                while p + b < len(w) and q + b < len(split[j]) and w[p + b] == split[j][q + b]:
                    b += 1
                if a + b >= window:
                    gone.update(range(p - a, p + b))
        for p in range(len(w) - gram + 1):
            places[tuple(w[p : p + gram])].append((i, p))
        out.append(sorted(gone))
    return out


def test_repeats_are_those_of_word_by_word_extension(spark):
    rng = random.Random(30)
    passages = [prose(300 + i, rng.randrange(8, 40), 60) for i in range(12)]
    texts = [" ".join([prose(400 + i, rng.randrange(0, 30), 60), *(rng.choice(passages) for _ in range(rng.randrange(3))), prose(500 + i, rng.randrange(0, 30), 60)]) for i in range(60)]
    want = extended(texts)
    got = {r.doc_id: r for r in substring.drop_repeats(documents(spark, texts)).collect()}
    for i, gone in enumerate(want):
        spans = [x for r in got[i].repeats for x in range(r.start, r.end)]
        assert spans == gone and got[i].n_removed == len(gone) and all(a.end < b.start for a, b in zip(got[i].repeats, got[i].repeats[1:]))
    assert sum(map(bool, want)) > 20


def test_every_window_owns_an_anchor():
    rng = np.random.default_rng(3)
    grams = rng.integers(0, 50, 200).astype(np.uint64)
    at = substring.owners(grams)
    for i, p in enumerate(at):
        part = grams[i : i + substring.WINNOW]
        assert p == i + max(j for j, g in enumerate(part) if g == part.min())
    assert len(substring.owners(grams[:5])) == 0


# 4


def test_toxicity(spark, odd, none):
    rng = random.Random(4)
    bad = ["idiot", "vermin", "worthless"]
    texts, labels = [], []
    for i in range(1200):
        w = prose(i, 60, 300).split()
        toxic = i % 4 == 0
        if toxic:
            w.insert(rng.randrange(60), rng.choice(bad))
        texts.append(" ".join(w)), labels.append((i, 1, int(toxic)))
    docs, marks = documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    scored = toxicity.score_texts(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    assert {r.doc_id for r in scored if r.held} == {i for i in range(1200) if zlib.crc32(str(i).encode()) % 4 == 2}
    right = [(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in scored if r.held]
    assert sum(right) / len(right) > 0.95
    out = toxicity.score_texts(odd, model).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out) and out[0].score == out[1].score == out[2].score and out[5].score == out[6].score
    assert toxicity.score_texts(none, model).count() == 0
    blank = toxicity.train(docs, marks.filter("toxic = 0"))
    assert {r.score for r in toxicity.score_texts(odd, blank).collect()} == {0.0}
    assert {r.score for r in toxicity.score_texts(odd, toxicity.train(none, marks)).collect()} == {0.0}


def test_toxicity_scores_keep_the_share_of_all_labels(spark, monkeypatch):
    rng = random.Random(40)
    texts, labels = [], []
    for i in range(2400):
        toxic = i % 8 == 0
        w = prose(i, 40, 300).split()
        if rng.random() < (0.7 if toxic else 0.08):
            w.insert(rng.randrange(40), rng.choice(["idiot", "vermin", "worthless"]))
        texts.append(" ".join(w)), labels.append((i, 1, int(toxic)))
    docs, marks = documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    monkeypatch.setattr(toxicity, "MAX_ORDINARY", 220)
    model = toxicity.train(docs, marks)
    scores = [r.score for r in toxicity.score_texts(docs, model).collect()]
    assert np.mean(scores) == pytest.approx(1 / 8, abs=0.04)
    monkeypatch.setattr(toxicity, "MAX_TOXIC", 0)
    known = [y for i, _, y in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    assert toxicity.train(docs, marks).base == sum(known) / len(known)


def area(scores, labels):
    """Area under the curve, ties counted half."""
    scores, labels = np.array(scores), np.array(labels)
    diff = scores[labels == 1][:, None] - scores[labels == 0]
    return ((diff > 0) + 0.5 * (diff == 0)).mean()


@pytest.mark.parametrize(("sf", "least"), [("sf0.01", 0.7), ("sf0.1", 0.94)])
def test_toxicity_on_held_out_documents(spark, sf_dir, sf, least):
    folder = sf_dir.replace("sf0.001", sf)
    docs, marks = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = docs.select("doc_id", "text").join(marks.filter("toxic in (0, 1)"), "doc_id").withColumn("held", toxicity.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id")).collect()
    known, held = [r for r in rows if not r.held], [r for r in rows if r.held]
    made = toxicity.Distance(toxicity.fit([(r.text, r.toxic) for r in known]))
    labels, scores = [r.toxic for r in held], [made.score(r.text) for r in held]
    # for comparison: how many different words of a text are in a list of words that toxic documents prefer
    seen = [collections.Counter(w for r in known if r.toxic == y for w in set(toxicity.words_of(r.text))) for y in (0, 1)]
    size = [sum(r.toxic == y for r in known) for y in (0, 1)]
    listed = {w for w, n in seen[1].items() if n >= 2 and np.log((n + 0.5) / (size[1] + 1)) - np.log((seen[0][w] + 0.5) / (size[0] + 1)) > 2}
    plain = [len(listed & set(toxicity.words_of(r.text))) for r in held]
    flagged = np.array(scores) >= toxicity.THRESHOLD
    print(sf, "area", round(area(scores, labels), 3), "of a word list", round(area(plain, labels), 3), "recall", flagged[np.array(labels) == 1].mean(), "false positives", flagged[np.array(labels) == 0].mean())
    assert area(scores, labels) > least and area(scores, labels) > area(plain, labels) - (0.1 if sf == "sf0.01" else 0)
    assert flagged[np.array(labels) == 0].mean() < 0.03


# 5


def test_audio_features(spark, odd, clashing, none, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: odd)
    rows = {r.doc_id: r for r in queries.op5_audio_features(spark, "").collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        media = audio.to_wave(payload)
        assert audio.from_wave(media) == (payload, audio.RATE)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(media))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(media).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
    assert rows[5].feature == rows[6].feature != rows[7].feature
    made = audio.audio_column(clashing)
    assert made.count() == len(ODD) and audio.audio_column(none).count() == 0
    tensor, times = audio.from_tensors(bytes(made.filter("doc_id = 8").first().log_mel))
    assert tensor.shape[1:] == (audio.PATCH, audio.BANDS) and len(times) == len(tensor) and (times[:, 1] > times[:, 0]).all()


def test_audio_parts_match_plain_forms():
    rng = np.random.default_rng(1)
    signal = rng.random(1001).astype(np.float32)
    plain = np.convolve(np.concatenate([np.zeros(audio.TAPS // 2), signal, np.zeros(audio.TAPS)]), audio.low_pass()[::-1], "valid")[:: audio.DOWN][:501]
    assert np.abs(plain - audio.resample(signal)).max() < 1e-5
    energy, active, spans = rng.random(500), False, []
    for i, e in enumerate(energy):
        if not active and e >= 0.8:
            active, start = True, i
        elif active and e < 0.3:
            active = False
            spans.append((start, i))
    assert audio.segments(energy, 0.8, 0.3) == spans + ([(start, 500)] if active else [])
    tone = np.sin(2 * np.pi * 440 * np.arange(8000) / 4000).astype(np.float32)
    mels, _ = audio.log_mel(tone, 4000)
    assert mels.mean(0).argmax() == audio.mel_bank(4000)[round(440 * audio.FRAME / 4000)].argmax()


# 6


def classes(texts):
    sets = [frozenset(shingle_set(t)) for t in texts]
    parent, links = list(range(len(texts))), collections.Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] == sets[b] or (both and both / len(sets[a] | sets[b]) >= 0.8):
            links[a] += 1
            links[b] += 1
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))], links


def test_ngram_jaccard(spark, odd, clashing, none):
    group = []
    for i in range(90):
        w = BASE.split()
        for _ in range(i % 6):
            w[random.Random(i).randrange(300)] = f"edit{i}"
        group.append(" ".join(w) + f" end{i}")
    texts = ODD + group + [prose(1000 + i, 40) for i in range(30)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(documents(spark, texts)).collect()}
    want, links = classes(texts)
    assert {i: (want[i], links[i]) for i in range(len(texts))} == got
    kept = jaccard.keep_one(clashing)
    assert kept.columns == clashing.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(classes(ODD)[0]))
    assert jaccard.keep_one(none).count() == 0
    twice = odd.unionAll(odd).unionAll(spark.createDataFrame([(None, BASE, "en", "s", 1)], SCHEMA))
    assert sorted(r.doc_id for r in jaccard.keep_one(twice).collect()) == sorted(set(classes(ODD)[0]))


def test_blocks_find_the_same_links(spark, monkeypatch):
    texts = [" ".join(w if j != i % 60 else f"edit{i}" for j, w in enumerate(BASE.split()[:60])) for i in range(70)]
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(documents(spark, texts), 0.5).collect()}
    sets = [shingle_set(t) for t in texts]
    links = collections.Counter(x for a, b in itertools.combinations(range(70), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5 for x in (a, b))
    assert {i: n for i, (_, n) in got.items()} == {i: links[i] for i in range(70)}


def test_ngram_jaccard_finds_every_link_of_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet".replace("sf0.001", "sf0.01")).select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets = {d: frozenset(hash(x) for x in shingle_set(t)) for d, t in texts.items()}
    holders = collections.defaultdict(list)
    for d, found in sets.items():
        for x in found:
            holders[x].append(d)
    shared = collections.Counter((a, b) for held in holders.values() for a, b in itertools.combinations(sorted(held), 2))
    links, parent = collections.Counter(), {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    blank = [d for d, found in sets.items() if not found]
    for a, b in [*((a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9), *itertools.combinations(sorted(blank), 2)]:
        links[a] += 1
        links[b] += 1
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(docs).collect()}
    assert got == {d: (root(d), links[d]) for d in sets} and sum(links.values()) > 200


def test_large_groups_by_differences(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 40)
    base = prose(60, 120).split()
    texts = []
    for i in range(160):
        w, rng = list(base), random.Random(6000 + i)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(120)] = f"e{rng.randrange(40)}"
        texts.append(" ".join(w))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(documents(spark, texts)).collect()}
    want, links = classes(texts)
    assert got == {i: (want[i], links[i]) for i in range(len(texts))} and 0 < sum(links.values()) < 160 * 159


def test_differences_give_the_same_links():
    rng = np.random.default_rng(61)
    common = np.unique(rng.integers(0, 1 << 40, 300))
    sets = [np.unique(np.concatenate([rng.permutation(common)[: rng.integers(200, 300)], rng.integers(0, 1 << 40, rng.integers(0, 60))])) for _ in range(50)]
    apart = [np.setxor1d(s, common) for s in sets]
    sizes = np.array([len(s) for s in sets], float)
    for threshold in (0.5, 0.7, 0.8):
        assert np.array_equal(jaccard.linked(sets, threshold), jaccard.linked_by_differences(sizes, apart, threshold))
    sigs = np.stack([(jaccard.signature(s.astype(np.uint64)) & np.uint64(255)).astype(np.uint8) for s in sets])
    steps = jaccard.least_matches()
    pairs = jaccard.alive_pairs(sigs, steps)
    assert np.array_equal(pairs, pairs.T) and not pairs.diagonal().any() and pairs[jaccard.linked(sets, 0.8)].all()
    far = rng.integers(0, 256, (300, jaccard.HASHES)).astype(np.uint8)
    assert not jaccard.alive_pairs(far, steps).any()


def test_pruning_keeps_similar_pairs():
    rng = np.random.default_rng(8)
    steps = jaccard.least_matches()
    a = rng.integers(0, 256, (4000, jaccard.HASHES)).astype(np.uint8)
    near, far = (np.where(rng.random(a.shape) < s, a, rng.integers(0, 256, a.shape)).astype(np.uint8) for s in (0.82, 0.2))
    assert jaccard.alive(a, near, steps).all() and not jaccard.alive(a, far, steps).any()


# 7


def frequent_lines(texts, least=10):
    keys = [[x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").split("\n")] for t in texts]
    counts = collections.Counter(k for ks in keys for k in set(ks))
    return [[k != "" and counts[k] >= least for k in ks] for ks in keys]


@pytest.mark.parametrize("shipped", [lines.SHIPPED_KEYS, -1])
def test_line_dedup(spark, clashing, none, shipped):
    rng = random.Random(7)
    pool = ["Shared LINE", " shared line\t", "É accent", "é accent", "rare", "", "  ", "x\x1cy", "shared line"]
    texts = ODD + ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    got = {r.doc_id: r for r in lines.drop_frequent_lines(documents(spark, texts), shipped_keys=shipped).collect()}
    for i, gone in enumerate(frequent_lines(texts)):
        left = [x for x, g in zip((texts[i] or "").split("\n"), gone) if not g]
        assert (got[i].n_lines, got[i].n_dropped) == (len(gone), sum(gone))
        assert got[i].text == (None if texts[i] is None else "\n".join(left))
    out = lines.drop_frequent_lines(clashing, shipped_keys=shipped)
    assert out.columns == [*clashing.columns, "n_lines", "n_dropped"] and out.filter("rid = 'kept'").count() == len(ODD)
    assert lines.drop_frequent_lines(none, shipped_keys=shipped).count() == 0


def test_line_counts_are_reversible(spark, odd):
    before = lines.line_counts(odd)
    more = documents(spark, ["line\nnew line", BASE], 100)
    state = lambda df: sorted(tuple(r) for r in df.select("k1", "k2", "n_docs").collect())
    grown = lines.merge_counts(before, added=more)
    assert state(grown) == state(lines.line_counts(odd.unionAll(more))) != state(before)
    assert state(lines.merge_counts(grown, deleted=more)) == state(before)


def test_deletions_change_later_decisions(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 16)
    rng = random.Random(70)
    texts = ["\n".join(f"line {rng.randrange(120)}" for _ in range(12)) for _ in range(150)]
    docs = documents(spark, texts)
    gone, new = docs.filter("doc_id % 3 = 0"), documents(spark, ["line 500\nline 501"] * 12, 1000)
    index = lines.LineIndex.of(docs)
    later = index.updated(added=new, deleted=gone)
    left = docs.filter("doc_id % 3 <> 0").unionAll(new)
    keys = lambda i: {tuple(x) for r in i.filters.collect() for x in np.frombuffer(bytes(r["keys"]), np.int64).reshape(-1, 2).tolist()}
    assert index.shards > 1 and keys(later) == keys(lines.LineIndex.of(left)) != keys(index)
    for r in later.filters.collect():
        held = np.frombuffer(bytes(r["keys"]), np.int64).reshape(-1, 2)
        table = lines.CuckooFilter(table=np.frombuffer(bytes(r["filter"]), np.uint16).reshape(-1, 4))
        assert len(held) == r["n_keys"] and table.contains(held[:, 0].view(np.uint64)).all() and (held[:-1, 0] <= held[1:, 0]).all()
    after = {r.doc_id: r.text for r in lines.drop_frequent_lines(docs, later).collect()}
    assert after == {r.doc_id: r.text for r in lines.drop_frequent_lines(docs, later, shipped_keys=0).collect()}
    still = {k for k, n in collections.Counter(x for r in left.collect() for x in set(r.text.split("\n"))).items() if n >= 10}
    assert after == {i: "\n".join(x for x in t.split("\n") if x not in still) for i, t in enumerate(texts)}
    assert after != {r.doc_id: r.text for r in lines.drop_frequent_lines(docs, index).collect()}
    back = later.updated(added=gone, deleted=new)
    assert keys(back) == keys(index) and {r.doc_id: r.text for r in lines.drop_frequent_lines(docs, back).collect()} == {r.doc_id: r.text for r in lines.drop_frequent_lines(docs, index).collect()}


def test_a_shard_with_many_lines_is_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_LINES", 7)
    texts = ["same line\n" * (1 + i % 3) + f"own {i}" for i in range(60)]
    got = {r.doc_id: r.text for r in lines.drop_frequent_lines(documents(spark, texts), shipped_keys=0).collect()}
    assert got == {i: f"own {i}" for i in range(60)}


def test_cuckoo_filter_inserts_and_deletes():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2)
    made = lines.CuckooFilter.of(hashes)
    assert made.contains(hashes).all()
    assert made.contains(rng.integers(0, 2**63, 20_000, dtype=np.uint64)).mean() < 0.001
    made.delete(hashes[:2500])
    assert made.contains(hashes[2500:]).all() and made.contains(hashes[:2500]).mean() < 0.01


# 8


def rule_of(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
    best = None
    for kind, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, kind)
    return host, path, best


def test_url_rules(spark):
    seen = [None, "", "no scheme", "http://", "https://A.COM", "http://x.example.com/en/1?x=/es/", "http://www.example.com/en/", "http://m.www.example.com/en/2#f", "http://a.net/fr/", "http://net/es/1", "http://anet/es/1", "http://b.net/de/", "ftp://É.org/x", "http://a.com?b/en/", "http://xexample.com/en/", "http://a.net/es", "http://u@a.net:80/es/"]
    pages = spark.createDataFrame(list(enumerate(seen)), "page_id long, url string")
    for r in urls.judge(pages.withColumns({"host": F.lit("old"), "__n": F.lit(1)})).collect():
        host, path, rule = rule_of(seen[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule[0] if rule else None)
        assert r.verdict == rule[1] if rule else r.verdict in ("allow", "block")
    assert urls.judge(pages.filter("false")).count() == 0
    # of rules of equal length the later one counts; without labels of both kinds the trees allow
    both = urls.judge(pages, rules=[("allow", "com", "/a"), ("block", "com", "/a")], labelled=pages.select("url", F.lit(0).alias("label"))).collect()
    assert all(r.verdict == ("block" if r.rule else "allow") for r in both)
    again = spark.createDataFrame([(1, "http://a.com/a"), (1, "http://a.com/a"), (2, "http://a.com/" + "a" * 200_000)], "page_id long, url string")
    assert [r.verdict for r in urls.judge(again, rules=[("block", "com", "/a")]).collect()] == ["block"] * 3


def test_trees_learn_and_generalise(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet".replace("sf0.001", "sf0.01"))  # the smallest table has too few junk urls to learn from
    got = urls.judge(pages).select("host", "rule", "junk_score", urls.junk_label(F.col("host")).alias("junk")).collect()
    assert np.mean([(r.junk_score >= 0.5) == bool(r.junk) for r in got]) > 0.97
    # labelled urls of one half of the hosts judge those of the other half
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet".replace("sf0.001", "sf0.1"))
    host, _ = urls.host_and_path(F.col("url"))
    marked = pages.select("page_id", "url", host.alias("host_name"), urls.junk_label(host).alias("label"))
    hosts = [sorted(r[0] for r in marked.filter(F.col("label") == y).select("host_name").distinct().collect()) for y in (1, 0)]
    blocked = ([], [])
    for fold in (0, 1):
        known = marked.filter(F.col("host_name").isin(hosts[0][fold::2] + hosts[1][fold::2]))
        rest = marked.join(known.select("host_name").distinct(), "host_name", "left_anti")
        for r in urls.judge(rest, rules=[], labelled=known.select("url", "label")).collect():
            blocked[r.label].append(r.verdict == "block")
    print("held-out hosts: junk blocked", np.mean(blocked[1]), "of", len(blocked[1]), "others blocked", np.mean(blocked[0]), "of", len(blocked[0]))
    assert len(blocked[1]) > 100 and np.mean(blocked[1]) > 0.8 and np.mean(blocked[0]) < 0.06
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] > 0.5)).astype(float)
    trees = urls.BoostedTrees().fit(x[:2000], y[:2000])
    assert ((trees.predict(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95


# 9


@pytest.fixture(scope="module")
def model():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_pieces_match_the_library(spark, odd, clashing, none, model):
    made = pieces.codec(model)
    rng = random.Random(9)
    alphabet = [*"abc xyz \t\n▁é中😀\x00", "the ", " of", "　", "ﬁ", "①", "<unk>", "<s>", "<0x41>", "  ", "ing"]
    for text in [*(t or "" for t in ODD), *("".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000))]:
        ids = made.library.encode(text)
        assert made.encode(text) == ids and made.decode(ids) == made.library.decode(ids)
    rows = pieces.encode_texts(clashing, model, check_every=1).collect()
    assert [(r.n_tokens, r.ids, r.decoded) for r in rows] == [(len(i), i, made.library.decode(i)) for i in (made.library.encode(t or "") for t in ODD)]
    assert pieces.encode_texts(none, model).count() == 0 and rows[0].n_tokens == rows[1].n_tokens == 0


def test_new_words_are_merged_side_by_side(model, monkeypatch):
    made, rng = pieces.MergeCodec(model), random.Random(4)
    alphabet = [*"abcdefghijklmnopqrstuvwxyz", *"ABÄéê中😀.,\n\x00", "ing", "ten", "schaft", *made.tied]
    words = sorted({"", "a", *("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 26))) for _ in range(3000))})
    want = {w: array("i", made.merge(pieces.MARK + w)).tobytes() for w in words}
    assert made.merge_many(words) == want and made.merge_many([]) == {}
    # texts of one part, with tables that change places between and behind them
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    monkeypatch.setattr(pieces, "AT_ONCE", 400)
    texts = [" ".join(rng.choice(words).strip("\n\x00") for _ in range(30)) for _ in range(40)] + ["", " two  marks", "x" * 500]
    parts = list(pieces._parts(texts))
    assert sum(parts, []) == texts and len(parts) > 1
    for part in parts:
        made.learn(part)
        for text in part:
            assert made.checked(text)[0] == array("i", made.library.encode(text)).tobytes()
    made = pieces.MergeCodec(model)
    monkeypatch.setattr(made, "merge_short", lambda segment: pytest.fail("a word is merged by itself"))
    made.learn(["plain words that nobody has met"])
    assert made.checked("plain words that nobody has met")[1] == "plain words that nobody has met"


def test_every_text_is_held_against_the_library(spark, model, monkeypatch):
    made = pieces.codec(model)
    monkeypatch.setattr(made, "encode_bytes", lambda t: b"" if t == "wrong" else pieces.MergeCodec.encode_bytes(made, t))
    monkeypatch.setattr(pieces, "small_batches", lambda df: df)
    docs = documents(spark, ["right"] * 10 + ["wrong"])
    kept = {}
    monkeypatch.setattr(type(docs), "mapInArrow", lambda _, f, schema: kept.update(f=f))
    pieces.encode_texts(docs.select("doc_id", "text"), model)
    import pyarrow as pa

    with pytest.raises(ValueError, match="wrong"):
        list(kept["f"]([pa.RecordBatch.from_pydict({"doc_id": list(range(11)), "text": ["right"] * 10 + ["wrong"]})]))


# 10


def license_cosines(texts):
    """Brute force: cosine of a text to a template, weights by the share of all texts that have a word."""
    df = collections.Counter(w for t in texts for w in set(licenses.words(t or "")))
    idf = lambda w: np.log((1 + licenses.RARE) / (df[w] / len(texts) + licenses.RARE)) + 1
    norm = lambda c: np.sqrt(sum((n * idf(w)) ** 2 for w, n in c.items()))

    def cosine(text, template):
        a, b = (collections.Counter(licenses.words(x or "")) for x in (text, template))
        return sum(n * b[w] * idf(w) ** 2 for w, n in a.items()) / (norm(a) * norm(b)) if a else 0.0

    def best(text):
        """(cosine, license) of the nearest template, the license that sorts first in a tie."""
        found = [(round(cosine(text, t), 9), name) for name, ts in sorted(licenses.TEMPLATES.items()) for t in ts]
        return max(found, key=lambda x: x[0])

    return best


LICENSED = {
    "r/LICENSE": "Some words of ours\n" + licenses.TEMPLATES["MIT"][0] + ".", "r/a/x": "prose only", "r/a/b/y": prose(1, 30) + "\nLicensed under the Apache License, Version 2.0.", "q/z": None,
    "r/a/COPYING.txt": "free software: you can redistribute it and modify under the terms of the GNU General Public License of any version", "r/a/b/c/w": "", "top": "software", "r2/x": "x",
    "r3/prose": "plain prose about a lake and the general software version four", "r3/other": "more prose", "r4/whole": licenses.TEMPLATES["BSD-3-Clause"][0], "r4/d/e/f": "text", "r2/notice": "nothing of the kind",
}


def test_license_scan_matches_brute_force(spark):
    files = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(LICENSED.items())], "doc_id long, path string, text string")
    got = {r.path: r for r in licenses.scan(files.withColumns({"license": F.lit("clash"), "rid": F.lit("clash"), "parts": F.lit("clash")})).collect()}
    best, named = license_cosines(list(LICENSED.values())), {}
    own = {path: max((best(line) for line in (text or "").split("\n")), key=lambda x: x[0]) for path, text in LICENSED.items()}
    for path, text in LICENSED.items():
        known = own[path][0] >= licenses.HEADER
        assert got[path].own_license == (own[path][1] if known else None) and (not known or got[path].cosine == pytest.approx(own[path][0], abs=1e-6)), path
        near = best(text)
        if re.search(licenses.NAMES, path):
            license = own[path][1] if known else near[1] if near[0] >= licenses.NAMED else None
        else:
            license = near[1] if near[0] >= licenses.WHOLE else None
        if license:
            named.setdefault("/".join(path.split("/")[:-1]), license)
    assert named == {"r": "MIT", "r/a": "GPL-3.0", "r4": "BSD-3-Clause"}
    for path in LICENSED:
        above = ["/".join(path.split("/")[:n]) for n in range(path.count("/"), -1, -1)]
        near = next((d for d in above if d in named), None)
        want = (got[path].own_license, None) if got[path].own_license else (named.get(near), near)
        assert (got[path].license, got[path].inherited_from) == want, path
    assert len(got) == len(LICENSED) and got["r3/prose"].license is None and got["r/a/b/c/w"].license == "GPL-3.0"


def test_license_scan_of_odd_rows(spark, none):
    notice, schema = licenses.TEMPLATES["MIT"][0], "doc_id long, path string, text string"
    rows = [(None, "a/x", notice), (None, "a/y", "text"), (1, "b/LICENSE", notice), (1, "b/LICENSE", notice), (2, None, notice), (3, None, "text"), (4, "c/LICENSE", notice), (5, "c/LICENSE", licenses.TEMPLATES["GPL-3.0"][0]), (6, "c/x", None), (7, "d/" + "e/" * 300 + "x", "y " * 100_000)]
    got = sorted((r.doc_id or 0, r.path or "", r.own_license, r.license, r.inherited_from) for r in licenses.scan(spark.createDataFrame(rows, schema)).collect())
    assert len(got) == len(rows) and (0, "a/x", "MIT", "MIT", None) in got and (0, "a/y", None, "MIT", "a") in got
    assert got.count((1, "b/LICENSE", "MIT", "MIT", None)) == 2 and (2, "", "MIT", "MIT", None) in got and (3, "", None, None, None) in got
    assert (6, "c/x", None, "MIT", "c") in got and got[-1][2:] == (None, None, None)
    assert licenses.scan(none.withColumn("path", F.lit("x"))).count() == 0


def test_inheritance_in_a_large_tree(spark):
    rng, texts = random.Random(10), {}
    for i in range(900):
        directory = "/".join(f"d{rng.randrange(4)}" for _ in range(rng.randrange(1, 5)))
        texts[f"{directory}/{'LICENSE-' if i % 30 == 0 else ''}{i}"] = rng.choice(licenses.TEMPLATES[rng.choice(sorted(licenses.TEMPLATES))]) if i % 30 == 0 else prose(i, 12)
    files = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(texts.items())], "doc_id long, path string, text string")
    got = {r.path: r for r in licenses.scan(files).collect()}
    named = {}
    for path in texts:
        if "LICENSE" in path:
            named.setdefault(path.rpartition("/")[0], got[path].own_license)
    inherited = 0
    for path in texts:
        if got[path].own_license is None:
            above = ["/".join(path.split("/")[:n]) for n in range(path.count("/"), -1, -1)]
            near = next((d for d in above if d in named), None)
            assert (got[path].license, got[path].inherited_from) == (named.get(near), near)
            inherited += near is not None
    assert inherited > 300 and all(got[p].own_license for p in texts if "LICENSE" in p)


def test_licenses_do_not_depend_on_corpus_size(spark):
    texts = ["Released by Acme under the MIT License", "Licensed under the Apache License, Version 2.0", "MIT License", prose(11, 40) + "\nReleased under the MIT License."]
    texts += [prose(20 + i, 30) for i in range(36)]
    got = []
    for copies in (1, 50):
        files = spark.createDataFrame([(c * len(texts) + i, f"c{c}/{i:02}/x", t) for c in range(copies) for i, t in enumerate(texts)], "doc_id long, path string, text string")
        got.append([(r.doc_id % len(texts), r.own_license, r.cosine, r.license) for r in licenses.scan(files).collect()])
    assert set(got[0]) == set(got[1]) and len(got[1]) == 50 * len(got[0])


def test_no_line_beats_its_bound(spark):
    rng, notices = random.Random(13), [t for ts in licenses.TEMPLATES.values() for t in ts]
    texts = [" ".join(rng.choices(rng.choice(notices).split(), k=rng.randrange(2, 8)) + prose(i, rng.randrange(0, 6)).split()) for i in range(200)]
    files = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frequency, n = licenses.document_frequencies(files)
    weights, best = licenses.Weights(frequency, n), license_cosines(texts)
    for r in files.withColumn("most", weights.most(licenses.terms_of(F.col("text")))).collect():
        assert r.most >= best(r.text)[0] - 1e-9


# clashing results


def test_results_replace_columns_of_their_name(spark, taken, none, model):
    fresh = toxicity.Model(base=0.25)
    for made, added in [
        (toxicity.score_texts(taken, fresh), ["score"]),
        (lines.drop_frequent_lines(taken), ["n_lines", "n_dropped"]),
        (lines.drop_frequent_lines(taken, shipped_keys=-1), ["n_lines", "n_dropped"]),
        (substring.drop_repeats(taken), ["n_words", "n_removed", "repeats"]),
        (audio.audio_column(taken), ["media", "log_mel", "spans"]),
        (pieces.encode_texts(taken, model), ["n_tokens", "ids", "decoded"]),
    ]:
        assert made.columns[-len(added) :] == added and len({c.lower() for c in made.columns}) == len(made.columns)
        assert made.filter(F.col("bin_id") == "kept").count() == made.filter(F.col(added[0]).isNotNull()).count() == len(ODD)
    assert fingerprints.compare_with_next(taken).count() == packing.pack(taken).select("doc_id").distinct().count() == len(ODD)
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string").withColumns({c: F.lit("kept") for c in ("host", "Path", "rule", "verdict", "junk_score", "__host")})
    assert urls.judge(pages).select("host", "path", "__host").first() == ("a.com", "/x", "kept")


@pytest.mark.parametrize("stage", [s for s, _ in stages.STAGES[:-1]])
def test_stages_return_the_columns_they_got(spark, taken, stage, sf_dir):
    run = dict(stages.STAGES)[stage]
    nameless = spark.createDataFrame([(None, "a text without id", "en", "s", 3)], SCHEMA).withColumns({c: F.lit("kept") for c in RESULTS})
    got = run(spark, taken.unionAll(nameless), sf_dir)
    assert got.schema.names == taken.schema.names and got.filter("doc_id is null").count() == 1
    rows = got.filter("doc_id is not null").collect()
    assert all(r[c] == "kept" for r in rows for c in RESULTS)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    assert run(spark, taken.filter("false"), sf_dir).count() == 0
    assert run(spark, taken.drop("n_chars", *RESULTS), sf_dir).columns == ["doc_id", "text", "lang", "source"]


# pipeline


def test_pipeline_stages_compose(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "substring_dedup", "packing"]
    clean = stages.toxicity(spark, docs, sf_dir)
    scores = {r.doc_id: r.score for r in toxicity.score_texts(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).collect()}
    left = {r.doc_id: r.text for r in clean.collect()}
    assert set(left) == {d for d, s in scores.items() if s < stages.REJECT} and clean.columns == docs.columns
    order = sorted(left)
    gone = frequent_lines([left[d] for d in order])
    cut = ["\n".join(x for x, g in zip((left[d] or "").split("\n"), flags) if not g) for d, flags in zip(order, gone)]
    unique = sorted(set(classes(cut)[0]))
    kept = removed([cut[i] for i in unique])
    want = {order[i]: " ".join(words(cut[i])) if len(k) == len(words(cut[i])) else " ".join(k) for i, k in zip(unique, kept)}
    stage3 = corpus_pipeline.STAGES[3][1](spark, stages.ngram_jaccard(spark, stages.line_dedup(spark, clean, sf_dir), sf_dir), sf_dir)
    assert stage3.columns == docs.columns
    assert {r.doc_id: " ".join(words(r.text)) for r in stage3.collect()} == want
    packed = corpus_pipeline.run(spark, sf_dir).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    lengths = {r.doc_id: -(-len((r.text or "").encode()) // 4) for r in stage3.collect()}
    assert {r.doc_id: r.n for r in packed} == lengths


def test_pipeline_goes_on_and_cleans_up(spark, sf_dir, tmp_path, monkeypatch):
    import corpus_pipeline

    from tallyspark.llm import common

    small = str(tmp_path / "in")
    spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 60").write.parquet(f"{small}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{small}/labels.parquet")
    shared = str(tmp_path / "shared")
    monkeypatch.setattr(common, "shared_dir", lambda _: shared)
    monkeypatch.setattr(corpus_pipeline, "shared_dir", lambda _: shared)
    ran = []
    counted = [(n, lambda *a, n=n, f=f: (ran.append(n), f(*a))[1]) for n, f in stages.STAGES]

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [*counted[:3], ("substring_dedup", broken), counted[4]])
    base = str(tmp_path / "mine")
    with pytest.raises(RuntimeError, match="lost"):
        corpus_pipeline.run(spark, small, base)
    monkeypatch.setattr(corpus_pipeline, "STAGES", counted)
    got = corpus_pipeline.run(spark, small, base)
    assert ran == [n for n, _ in stages.STAGES] and sorted(p.name for p in (tmp_path / "mine").iterdir()) == [f"{i}-{n}" for i, (n, _) in enumerate(stages.STAGES)]
    assert not list((tmp_path / "shared").iterdir())
    again = corpus_pipeline.run(spark, small)
    assert sorted(got.collect()) == sorted(again.collect())
    (left,) = (tmp_path / "shared").iterdir()
    assert [p.name for p in left.iterdir()] == ["4-packing"]
