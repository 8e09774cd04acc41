import hashlib
import io
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerline.llm import ann, bpe_codec, neardup, packing, quality, sharding, substring, token_counts, toxicity, warc
from ledgerline.llm.vocab import vocabulary

PATH = public_tokenizers.path("word_bpe_49k.json")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def texts():
    rng = random.Random(3)
    base = " ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(120))
    odd = ["", None, " \t\n", "don't <|endoftext|>x ÉΣ 日本 ½", "a" * 3000, base, base, base + " tail", base.replace("alpha", "omega", 1), "x\n" * 60]
    return [(i, t, "extra") for i, t in enumerate(odd)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), "doc_id long, text string, n_words string")


def test_tokens_and_codec(docs):
    library = Tokenizer.from_file(PATH)
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, PATH).collect()}
    trips = {r["doc_id"]: r for r in bpe_codec.round_trip(docs, PATH).collect()}
    for i, t, _ in texts():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert counts[i] == trips[i]["n_tokens"] == len(ids)
        assert trips[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert trips[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_latin_chunks_as_the_library():
    vocab, library = vocabulary(PATH), Tokenizer.from_file(PATH)
    rng, chars = random.Random(2), [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x180))]
    for chunk in [*chars, *("".join(rng.choices(chars, k=rng.randint(2, 9))) for _ in range(5000))]:
        assert list(vocab.words(chunk.encode())) == [w for w, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(chunk))]


def test_quality_repeats(docs):
    found = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    for i, t, _ in texts():
        w = (t or "").encode().split()
        at = {}
        for j in range(len(w) - 2):
            at.setdefault(tuple(w[j : j + 3]), []).append(j)
        cover = {j + k for places in at.values() if len(places) > 1 for j in places for k in range(3)}
        assert (found[i]["n_words"], found[i]["n_repeat_words"]) == (len(w), len(cover))
    assert quality.quality(docs.filter("false")).count() == 0


@pytest.mark.parametrize("n", [60, 2500, 66000])
def test_quality_repeats_with_equal_hashes(spark, monkeypatch, n):
    """All windows have one hash, so only their words tell them apart."""
    w = [f"w{k}" for k in range(n)]
    w[20:24] = w[4:8]
    w[40:43] = w[4:7]
    at = {}
    for j in range(len(w) - 2):
        at.setdefault(tuple(w[j : j + 3]), []).append(j)
    cover = {j + k for places in at.values() if len(places) > 1 for j in places for k in range(3)}
    monkeypatch.setattr(quality.F, "xxhash64", lambda *cols: F.lit(0).cast("long"))
    docs = spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")
    assert quality.quality(docs).select("n_repeat_words").first()[0] == len(cover)


def test_substring(docs):
    first, found = {}, {r["doc_id"]: (r["n_removed"], r["kept_text"]) for r in substring.dedup(docs, batches=3).collect()}
    for i, t, _ in texts():
        w = (t or "").encode().split()
        cut = set()
        for j in range(len(w) - 12):
            if first.setdefault(tuple(w[j : j + 13]), i) < i:
                cut |= {*range(j, j + 13)}
        assert found[i] == (len(cut), b" ".join(x for k, x in enumerate(w) if k not in cut).decode())


def test_substring_two_texts_under_one_id(spark):
    word = lambda a, n: " ".join(f"{a}{k}" for k in range(n))
    passage = word("p", 20)
    rows = [(1, passage), (5, word("a", 60) + " " + passage), (5, word("b", 30)), (5, word("b", 30)), (5, passage + " " + word("c", 70)), (9, word("b", 30)), (9, None)]
    first = {}
    for i, t in rows:
        w = (t or "").split()
        for j in range(len(w) - 12):
            key = tuple(w[j : j + 13])
            first[key] = min(first.get(key, i), i)
    wanted = []
    for i, t in rows:
        w = (t or "").split()
        cut = {k for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < i for k in range(j, j + 13)}
        wanted.append((i, len(w), len(cut), " ".join(x for k, x in enumerate(w) if k not in cut)))
    found = substring.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in found.collect()) == sorted(wanted)


def cut_by_hand(rows):
    """(id, words, words removed, rest) of each row by plain Python."""
    first = {}
    for i, t in rows:
        w = (t or "").split()
        for j in range(len(w) - 12):
            if i is not None:
                key = tuple(w[j : j + 13])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = (t or "").split()
        cut = {k for j in range(len(w) - 12) if i is not None and first[tuple(w[j : j + 13])] < i for k in range(j, j + 13)}
        out.append((i, len(w), len(cut), " ".join(x for k, x in enumerate(w) if k not in cut)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches, levels", [(3, [0, 0, 1, 0]), (5, [0, 0, 1, 0, 0, 1, 2, 0])])
def test_batches_compact(spark, monkeypatch, batches, levels):
    """Passages at all distances, so that what is opened, known and compacted all matters; a null id, empty and long texts."""
    rng, made = random.Random(batches), []
    passages = [" ".join(f"p{k}w{rng.randint(0, 40)}" for _ in range(rng.randint(13, 40))) for k in range(12)]
    for i in range(180):
        parts = [" ".join(f"d{i}w{rng.randint(0, 9)}" for _ in range(rng.randint(0, 30)))]
        for p in rng.sample(passages, rng.randint(0, 3)):
            w = p.split()
            at = rng.randint(0, 4)
            parts += [" ".join(w[at:]), f"x{i}"]
        made.append((i, " ".join(parts)))
    rows = [*made, (None, made[3][1]), (None, None), (181, ""), (182, " ".join([made[7][1]] * 60)), (183, "same word " * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index_levels, write = [], substring.FingerprintIndex._prints
    monkeypatch.setattr(substring.FingerprintIndex, "_prints", lambda self, df, number: index_levels.append(number) or write(self, df, number))
    built, compact = [], substring.FingerprintIndex.compact

    def watched(self):
        before = {r.number for r in self.runs}
        compact(self)
        built.extend(r.level for r in self.runs if r.number not in before or r.level == 0 and r.number == max(x.number for x in self.runs))

    monkeypatch.setattr(substring.FingerprintIndex, "compact", watched)
    found = sorted((tuple(r) for r in substring.dedup(docs, batches=batches).collect()), key=str)
    assert found == cut_by_hand(rows)
    assert max(built) == max(levels) and len(index_levels) == len(levels)


def test_substring_clashing_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y")], "doc_id long, text string, n_words string, kept_text string")
    found = substring.dedup(docs, carry=["n_words", "kept_text"])
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_text"] and found.collect()[0][1:] == (2, 0, "a b")
    assert substring.dedup(docs.filter("false")).count() == 0


def test_near_duplicates(docs):
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, percent=85).collect()}
    assert found == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 5, 8: 5, 9: 9}
    assert neardup.near_duplicates(docs.filter("false")).count() == 0


def test_null_id_with_a_shared_text(spark):
    base = texts()[5][1]
    rows = [(None, base), (None, base), (3, base), (4, base), (5, base + " tail"), (6, None), (None, None), (7, "one two")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs, percent=85).collect()), key=str)
    assert found == [(3, 3, True), (4, 3, False), (5, 3, False), (6, 6, True), (7, 7, True), *[(None, None, None)] * 3]
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted(((i, t) for i, t in rows if i not in (4, 5)), key=str)


def test_salvage():
    records = [warc.member(warc.record_bytes(i, "http://h", b"page %d" % i, warc.digest(b"page %d" % i), None)) for i in range(6)]
    whole = b"".join(records)
    assert [r["page_id"] for r in warc.salvage(io.BytesIO(whole), "p")] == [0, 1, 2, 3, 4, 5]
    start = len(records[0]) + len(records[1])
    bad = bytearray(whole)
    bad[start + 30] ^= 0xFF
    found = list(warc.salvage(io.BytesIO(bytes(bad)), "p"))
    assert [r["page_id"] for r in found if "gap" not in r] == [0, 1, 3, 4, 5]
    assert [(r["start"], r["end"]) for r in found if "gap" in r] == [(start, start + len(records[2]))]
    assert "gap" in list(warc.salvage(io.BytesIO(whole[:-5]), "p"))[-1]


def test_shards(spark):
    rows = sharding.shard(spark.range(2000).withColumnRenamed("id", "doc_id"), [1.0] * 16, grown=1.0).collect()
    for s in range(16):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert {r["grown_shard"] for r in rows if r["grown_shard"] != r["shard"]} == {16}


def test_packing(docs):
    library, at = Tokenizer.from_file(PATH), {}
    pieces = packing.pack(docs, PATH, length=64, with_ids=True).collect()
    assert max(p["offset"] + p["length"] for p in pieces) <= 64
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        assert len(at.setdefault(p["doc_id"], [])) == p["start"]
        at[p["doc_id"]] += p["ids"]
    assert at == {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t, _ in texts()}


def test_best_cuts_against_brute_force():
    rng = random.Random(1)
    for _ in range(50):
        at = sorted({0, *rng.sample(range(1, 40), 12), 40})
        penalty = [0.0] + [float(rng.randint(0, 9)) for _ in at[1:]]
        if max(b - a for a, b in zip(at, at[1:])) > 10:
            continue
        pay = lambda n: 0 if n & (n - 1) == 0 else 10 - n
        cost = [0.0] + [np.inf] * (len(at) - 1)
        for j in range(1, len(at)):
            cost[j] = min(cost[i] + pay(at[j] - at[i]) for i in range(j) if at[j] - at[i] <= 10) + penalty[j] + packing.SEQUENCE
        path = packing.best_cuts(at, penalty, 10)
        got = sum(pay(b - a) + penalty[at.index(b)] + packing.SEQUENCE for a, b in zip(path, path[1:]))
        assert got == cost[-1]


def test_toxicity_learns():
    rng = random.Random(5)
    rows = [(" ".join(rng.choice(WORDS) for _ in range(40)) + (" foul" if k % 5 == 0 else ""), int(k % 5 == 0)) for k in range(600)]
    at, w = toxicity.fit([(toxicity.features(t.encode()), y) for t, y in rows[:400]])
    dense = np.zeros(toxicity.BIAS + 1)
    dense[at] = w
    right = [(dense[toxicity.BIAS] + dense[toxicity.features(t.encode())].sum() > 0) == y for t, y in rows[400:]]
    assert np.mean(right) > 0.97


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((800, 16))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (950, [0.0] * 16), (1000, [float("nan")] * 16)]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, block=300).collect()
    hits = 0
    for q in range(0, 800, 50):
        c = v @ v[q] / (np.linalg.norm(v, axis=1) * np.linalg.norm(v[q]))
        c[q] = -2
        hits += len({*np.argsort(-c)[:5].tolist()} & {r["vec_id"] for r in found if r["query_id"] == q})
    assert hits / 80 >= 0.9 and {r["query_id"] for r in found} == {*range(0, 800, 50)}


def classes_by_hand(rows, percent, k=5):
    """Component of each row's id by plain Python: all pairs of full sets; rows of one id are one node."""
    sets = []
    for i, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets.append((i, {tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, min(len(w), 1)))}))
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return sorted([(i, len(x), None if i is None else find(i), None if i is None else find(i) == i) for i, x in sets], key=str)


def near_copies(seed):
    """Groups of copies with a few words changed, so that similarities lie around the threshold, and chains of them."""
    rng, rows = random.Random(seed), []
    for g in range(12):
        w = [f"g{g}w{rng.randint(0, 400)}" for _ in range(rng.randint(30, 160))]
        for _ in range(rng.randint(1, 9)):
            copy = list(w)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = f"n{rng.randint(0, 10**6)}"
            rows.append((len(rows) * 3, " ".join(copy)))
            if rng.random() < 0.4:
                w = copy
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_against_brute_force(spark, percent):
    rows = near_copies(percent)
    rows += [(1, "A b c d e f"), (5, "a B c d e f"), (5, "u v w x y z"), (7, "U v w x y z"), (7, "U v w x y z"), (11, ""), (12, None), (None, rows[0][1]), (None, ""), (13, "one two"), (14, "ONE two"), (15, "same " * 5000), (16, "same " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("x")).withColumn("class_key", F.lit(1))
    assert sorted((tuple(r) for r in neardup.near_duplicates(docs, percent=percent).collect()), key=str) == classes_by_hand(rows, percent)
