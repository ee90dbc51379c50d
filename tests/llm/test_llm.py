"""Operators of the llm subpackage against brute force, exact round trips and held-out accuracy, on small fixtures."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.llm import chunks, components, hashing, hyperminhash, jaccard, langid, licenses, media, mixing, packing, parsing, substrings, suffixes, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: clashing names besides the columns of documents
EXTRA = "chunk string, key string, kept string, score string, n string, part string, block string"


def corpus(seed=3, n=60, words=120):
    """Random texts with copies, near copies, shared passages, repeats inside a text, empties and nulls."""
    rng = random.Random(seed)
    vocabulary = [rng.choice(["", "é", "ß", "X"]) + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ".", "\n"]) for _ in range(k))
    passage, out = text(90), []
    for i in range(n):
        t = text(rng.randint(1, words))
        kind = i % 10
        if kind == 3 and out:
            t = rng.choice([x for x in out if x] or [t])
        elif kind in (4, 5) and out:
            w = rng.choice([x for x in out if x] or [t]).split(" ")
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = "Edited"
            t = " ".join(w)
        elif kind == 6:
            t = text(10) + " " + passage + " " + text(10)
        elif kind == 7:
            p = text(80)
            t = p + " middle " + p
        elif kind == 8:
            t = ["", None, " \n ", "one", "a b c"][i // 10 % 5]
        out.append(t)
    return out


def frame(spark, texts, ids=None, extra=False):
    ids = ids or range(len(texts))
    rows = [(i, t, ["en", "fr", None][k % 3], f"src{k % 4}" if k % 7 else None, len(t) if t else None) + (("x",) * 7 if extra else ()) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA + (", " + EXTRA if extra else ""))


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus(), extra=True).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# Hashing -------------------------------------------------------------------------------------------------


def test_words_and_grams():
    texts = ["a  b\tc", "", None, "a b c d"]
    w = hashing.Words(texts)
    assert w.count.tolist() == [3, 0, 0, 4]
    assert (w.hash[:3] == w.hash[3:6]).all()
    g, ok = hashing.grams(w.hash, 3), w.inside(3)
    assert ok.tolist() == [True, False, False, True, True] and g[0] == g[3]


def test_segments_do_not_matter(monkeypatch):
    texts = corpus()
    a = hashing.Words(texts).hash
    monkeypatch.setattr(hashing, "SEGMENT", 64)
    assert (hashing.Words(texts).hash == a).all()


def thue_morse(n=1024):
    """Two different words of n letters that collide in every polynomial modulo 2**64 with an odd base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_hash_of_strings():
    one, other = thue_morse()
    words = [one, other, "a" * 64, "a" * 65, "a\0", "a", "ab" * 40, "ba" * 40, *(x[:n] for x in thue_morse() for n in (4, 8, 16, 32, 64))]
    w = hashing.Words([" ".join(words), *words])
    assert len(set(w.hash[: len(words)].tolist())) == len(words) and w.hash[: len(words)].tolist() == w.hash[len(words) :].tolist()
    assert not set(w.hash.tolist()) & set(w.hashed(seed=1).tolist())
    rng = random.Random(5)
    raw = bytes(rng.choice(b"ab") for _ in range(5000))
    a, n = np.array([rng.randrange(4000) for _ in range(3000)]), np.array([rng.choice([0, 1, 2, 3, 7, 8, 9, 16, 70]) for _ in range(3000)])
    b = np.array([raw.find(raw[i : i + k]) if rng.random() < 0.5 else rng.randrange(4000) for i, k in zip(a.tolist(), n.tolist())])
    want = [raw[i : i + k] == raw[j : j + k] for i, j, k in zip(a.tolist(), b.tolist(), n.tolist())]
    assert hashing.equal(raw, n, a, b).tolist() == want and 1000 < sum(want) < 3000
    same = hashing.strings(raw, a, a + n) == hashing.strings(raw, b, b + n)
    assert same.tolist() == want


@pytest.mark.parametrize("k", range(1, 18))
def test_grams_follow_their_words(k):
    one, other = thue_morse(16)
    names = {"a": "x", "b": "y"}
    words = [names[c] for c in one + other + one + "b" * 20]
    w = hashing.Words([" ".join(words)])
    g = hashing.grams(w.hash, k)
    content = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    assert len(g) == len(content) and len(set(g.tolist())) == len(set(content)) == len(set(zip(g.tolist(), content)))


def test_complementary_words_are_told_apart(spark):
    one, other = thue_morse()
    docs = frame(spark, [f"p q r s {one}", f"p q r s {other}"])
    assert [r.component_id for r in jaccard.near_duplicates(docs).orderBy("doc_id").collect()] == [0, 1]
    twelve = " ".join(f"w{i}" for i in range(12))
    assert [r.n_removed for r in substrings.remove_repeats(frame(spark, [f"{twelve} {one}", f"{twelve} {other}"])).orderBy("doc_id").collect()] == [0, 0]
    encode = packing.Encoder()
    assert all((a == encode.whole(t)).all() for a, t in zip(encode([one, other]), [one, other]))


def test_encoder_survives_equal_hashes(monkeypatch):
    monkeypatch.setattr(packing, "strings", lambda raw, a, z: (z - a).astype(np.uint64) % np.uint64(5))
    encode, texts = packing.Encoder(), [t for t in corpus() if t]
    assert all((a == encode.whole(t)).all() for a, t in zip(encode(texts), texts))


# Substrings ----------------------------------------------------------------------------------------------


def brute_windows(texts, window=13):
    seen, out = {}, []
    for t in texts:
        w = WORD.findall(t or "")
        gone, new = [False] * len(w), []
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            if k in seen:
                gone[p : p + window] = [True] * window
            new.append(k)
        seen |= dict.fromkeys(new)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def test_substrings_match_brute_force(docs):
    got = {r.doc_id: tuple(r)[1:] for r in substrings.remove_repeats(docs).collect()}
    want = brute_windows(corpus())
    assert sum(r[1] for r in want) > 500 and got == dict(enumerate(want))


def test_substrings_over_many_chunks(spark, docs, monkeypatch):
    monkeypatch.setattr(chunks.Exchange.__init__, "__defaults__", (700, 2000, ()))
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(docs).collect()}
    assert got == {i: r[1] for i, r in enumerate(brute_windows(corpus()))}


# Suffix arrays -------------------------------------------------------------------------------------------


def brute_bytes(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = {}
    for b in raw:
        for p in range(len(b) - length + 1):
            k = b[p : p + length]
            count[k] = count.get(k, 0) + 1
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length,gram,hot", [(400, 100, 2000), (60, 20, 2000), (60, 20, 1), (40, 10, 3)])
def test_suffixes_match_brute_force(docs, length, gram, hot):
    texts = corpus()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(docs, length, gram, hot).collect()}
    assert got == dict(enumerate(brute_bytes(texts, length)))


def test_suffixes_over_many_chunks(docs, monkeypatch):
    monkeypatch.setattr(chunks.Exchange.__init__, "__defaults__", (900, 4000, ()))
    monkeypatch.setattr(suffixes, "BATCH", 8)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(docs, 60, 20).collect()}
    assert got == dict(enumerate(brute_bytes(corpus(), 60)))


def test_suffixes_overlap_themselves(spark):
    texts = ["a" * 500, "b" * 30, "ab" * 300]
    got = {r.doc_id: r.n_removed for r in suffixes.remove_repeats(frame(spark, texts)).collect()}
    assert got == {i: r[1] for i, r in enumerate(brute_bytes(texts, 400))}


def test_family_levels_double():
    f = suffixes.Family(8, 2)
    for i in range(7):
        f.add(suffixes.level([(b"\0" * 8 + bytes([i]) * 8, b"\0" * 8, 0, 0, 2 * i), (b"\0" * 8 + bytes([i % 3]) * 8, b"\0" * 8, 0, 0, 2 * i + 1)]))
    assert [len(x) for x in f.levels] == [8, 4, 2]
    assert sorted(f.found) == [0, 1, 2, 3, 4, 5, 7, 9, 11, 13]


# Jaccard -------------------------------------------------------------------------------------------------


def brute_components(texts):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    of = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = of[i], of[j]
                of = [min(x, y) if v in (x, y) else v for v in of]
    return [(len(s), c) for s, c in zip(sets, of)]


@pytest.mark.parametrize("block", [2048, 3])
def test_jaccard_matches_brute_force(spark, docs, block):
    every, links = jaccard.join_sets(docs, block=block)
    labels = components.components(links).collect()
    least: dict = {}
    for r in labels:
        least[r.label] = min(r.node, least.get(r.label, r.node))
    label = {r.node: least[r.label] for r in labels}
    got = {r.doc_id: (r.n_shingles, label.get(r.doc_id, r.doc_id)) for r in every.collect()}
    want = brute_components(corpus())
    assert len({c for _, c in want}) < len(want) - 8 and got == dict(enumerate(want))


def test_jaccard_dense_blocks(spark, monkeypatch):
    """Large groups of near copies of one and of several sizes, dealt to trees by number and by bytes."""
    rng = random.Random(22)
    texts = []
    for size in (30, 60, 61, 200):
        base = [f"w{size}x{k}" for k in range(size)]
        for _ in range(12):
            w = list(base)
            w[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w[: size - rng.randrange(3)]))
        texts.append(" ".join(base))
    want = brute_components(texts)
    for block, size in ((3, 8 << 20), (2048, 3000), (5, 900)):
        monkeypatch.setattr(jaccard, "BYTES", size)
        every, links = jaccard.join_sets(frame(spark, texts), block=block)
        least: dict = {}
        rows = components.components(links).collect()
        for r in rows:
            least[r.label] = min(r.node, least.get(r.label, r.node))
        label = {r.node: least[r.label] for r in rows}
        assert {r.doc_id: (r.n_shingles, label.get(r.doc_id, r.doc_id)) for r in every.collect()} == dict(enumerate(want))


def test_jaccard_over_many_chunks(docs, monkeypatch):
    monkeypatch.setattr(chunks.Exchange.__init__, "__defaults__", (500, 2000, ()))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == dict(enumerate(brute_components(corpus())))


def test_jaccard_repeated_and_null_ids(spark):
    t = "a b c d e f g h"
    got = sorted(jaccard.near_duplicates(frame(spark, [t, t, "x", t, None], [5, 5, 6, None, None])).collect(), key=str)
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(5, 5), (5, 5), (6, 6)]
    assert sum(r.doc_id is None and r.component_id is None for r in got) == 2


def test_tree_join_is_complete():
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 1 << 60, rng.integers(3, 60)).astype(np.uint64)) for _ in range(40)]
    sets = []
    for i in range(200):
        b = base[i % 40].copy()
        b[rng.integers(0, len(b), len(b) // 10)] = rng.integers(0, 1 << 60, len(b) // 10)
        sets.append((i, np.unique(b)))
    of = list(range(200))
    for a, b in jaccard.dual_join(sets, sets):
        x, y = of[a], of[b]
        of = [min(x, y) if v in (x, y) else v for v in of]
    want = list(range(200))
    for i in range(200):
        for j in range(i):
            s, t = set(sets[i][1].tolist()), set(sets[j][1].tolist())
            if 5 * len(s & t) >= 4 * len(s | t):
                x, y = want[i], want[j]
                want = [min(x, y) if v in (x, y) else v for v in want]
    assert of == want


@pytest.mark.parametrize("few", [components.FEW, 12, 0])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    edges = [(i, i + 1) for i in range(0, 40) if i != 20] + [(100, 101), (7, 7)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups: dict = {}
    for k, v in got.items():
        groups.setdefault(v, set()).add(k)
    assert sorted(map(sorted, groups.values())) == [list(range(21)), list(range(21, 41)), [100, 101]]


# Packing -------------------------------------------------------------------------------------------------

SNIPPETS = ["a", "B", "é", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "'d", "1", "٣", "!", "’", "-", " ", "　", "中", "🙂", "<|endoftext|>", "\0", "\r\n", "x's", "\x85"]


def test_encoder_equals_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = ["".join(rng.choice(SNIPPETS) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + [t or "" for t in corpus()]
    want = [e.ids for e in Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in packing.Encoder()(texts)] == want


@pytest.mark.parametrize("capacity", [2048, 50])
def test_packing_round_trip(spark, docs, capacity):
    rows = packing.pack(docs, capacity).collect()
    encode, texts = packing.Encoder(), corpus()
    ids = [np.append(x, 0).astype("<u4") for x in encode([t or "" for t in texts])]
    by: dict = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and r.start == sum(p.length for p in by.get(r.doc_id, []))
        by.setdefault(r.doc_id, []).append(r)
    for d, x in enumerate(ids):
        assert sum(r.length for r in by[d]) == len(x) and (len(by[d]) == 1 or all(r.length == capacity for r in by[d][1:]))
    bins: dict = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r["offset"], r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= capacity
    assert len(bins) <= -(-sum(map(len, ids)) // capacity) * 1.02 + 2


def test_packing_in_chunks(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "CHUNKED", 5)
    rows = packing.pack(docs, 50).collect()
    assert len({(r.sequence_id, r["offset"]) for r in rows}) == len(rows)


def test_fullest_bin():
    assert sum(n * k for n, k in packing.fullest({7: 1, 5: 1, 3: 2, 2: 1}, 12)) == 12
    assert packing.plan({3: 10}, 10) == [(3, 0, 9, 0, 3, 0), (3, 9, 10, 3, 1, 0)]


# Fingerprints --------------------------------------------------------------------------------------------


def test_fingerprints(docs):
    got = {r.doc_id: r for r in parsing.fingerprints(docs).collect()}
    texts = [t or "" for t in corpus()]
    for i, t in enumerate(texts):
        q = len(t) // 4
        edited = t[: len(t) - q] + texts[(i + 1) % len(texts)][:q]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    by: dict = {}
    for i, t in enumerate(texts):
        by.setdefault(t, set()).add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by.values())


def test_fingerprints_over_parts(docs, monkeypatch):
    whole = {r.doc_id: tuple(r) for r in parsing.fingerprints(docs).collect()}
    monkeypatch.setattr(parsing, "PART", 1500)
    assert {r.doc_id: tuple(r) for r in parsing.fingerprints(docs).collect()} == whole


def brute_phrases(names):
    """One round on one sequence, name by name."""
    runs = []
    for x in names:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    one = lambda x: int(hashing.mix(np.array([x], np.uint64))[0])
    v = [one((x + n) % (1 << 64)) if n > 1 else x for x, n in runs]
    labels, bits = [x >> 32 for x in v], 32
    for _ in range(3):
        out = []
        for i, x in enumerate(labels):
            differ = x ^ labels[i - 1] if i else (1 << bits) - 1
            low = next((j for j in range(bits) if differ >> j & 1), None)
            out.append((2 * low + (x >> low & 1)) if low is not None else 2 * bits)
        labels, bits = out, 8
    begin = [i for i in range(len(v)) if i == 0 or i < len(v) - 1 and labels[i] > labels[i - 1] and labels[i] > labels[i + 1]]
    return [int(hashing.spans(hashing.prefix(np.array(v[a:z], np.uint64)), np.array([0]), np.array([z - a]))[0]) for a, z in zip(begin, [*begin[1:], len(v)])]


def test_sketches_equal_brute_force():
    rng = random.Random(23)
    texts = ["".join(rng.choice("aab cdé\n🙂") for _ in range(n)) for n in [0, 1, 2, 3, 5, 6, 7, 30, 47, 48, 49, 100, 400, 3000] for _ in range(3)]
    got = parsing.sketches([parsing.code_points(t) for t in texts])
    for t, mine in zip(texts, got):
        v = [(ord(c) + 1) * hashing.BASE % (1 << 64) for c in t]
        names = set()
        for k in range(parsing.ROUNDS):
            if v and (k >= parsing.LONG or len(t) < parsing.SHORT):
                names |= {int(hashing.mix(np.array([x ^ k], np.uint64))[0]) >> 33 | (0 if k >= parsing.LONG else parsing.EARLY) for x in v}
            v = brute_phrases(v) if v else v
        assert mine.tolist() == sorted(names)[: parsing.SKETCH]


def test_likeness_of_short_texts():
    """No step where texts begin to count as long."""
    rng = random.Random(24)
    for _ in range(20):
        t = "".join(rng.choice("abcdefgh ") for _ in range(60))
        a, b, c = parsing.sketches([parsing.code_points(x) for x in (t[:47], t[:48], t[:49])])
        assert abs(parsing.likeness(a, b) - parsing.likeness(b, c)) < 0.75 and parsing.likeness(a, b) > 0
        assert parsing.likeness(a, a) == parsing.likeness(b, b) == 1


def test_parts_follow_bytes(spark, monkeypatch):
    monkeypatch.setattr(parsing, "PART", 1000)
    rows = [(i, "x" * (900 if i % 50 == 0 else 20)) for i in range(500)] + [(None, "y" * 50), (None, None), (7, "z" * 40)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("at", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    edges = parsing.part_edges(d)
    sums = [0] * len(edges)
    for i, t in rows:
        at = -(1 << 63) if i is None else i
        sums[int(np.searchsorted(np.array(edges[1:]), at, side="right"))] += len(t or "")
    assert edges[0] == -(1 << 63) and len(edges) > 15 and max(sums) <= 2000
    monkeypatch.setattr(parsing, "MOST_PARTS", 4)
    assert len(parsing.part_edges(d)) <= 5
    assert parsing.part_edges(d.limit(0)) == []


def test_phrases_do_not_depend_on_offset():
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghij klm") for _ in range(3000))
    a, b = parsing.sketches([parsing.code_points(text), parsing.code_points("zzz " + text)])
    assert parsing.likeness(a, b) > 0.9


# Language, toxicity, licenses, mixing, media -----------------------------------------------------------------


def test_language_on_held_out_texts(spark):
    rng = random.Random(6)
    stems = {"aa": "lor em ip sum dol or".split(), "bb": "ka ti mo zu re na".split(), "cc": "schu pf tz ei au gen".split()}
    word = lambda k: "".join(rng.choice(stems[k]) for _ in range(3))
    rows = [(i, " ".join(word(k) for _ in range(40)), k) for i, k in enumerate(["aa", "bb", "cc"] * 60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    pred = {r.doc_id: r.lang_pred for r in langid.identify(d, langid.learn(d.where("doc_id < 90"))).collect()}
    assert sum(pred[i] == k for i, _, k in rows[90:]) >= 88
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "x")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(odd, langid.learn(d)).collect() if r.doc_id < 4} == {1: "und", 2: "und", 3: "und"}


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(5))
    texts, labels = [], []
    for i in range(400):
        w = [word() for _ in range(30)]
        if i % 4 == 0:
            w[rng.randrange(30)] = rng.choice(["zonkhead", "zonky", "plimpter"])
        texts.append(" ".join(w) + ".")
        labels.append((i, int(i % 4 == 0)))
    d = frame(spark, texts)
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(d, toxicity.learn(d, y.where("doc_id < 250"))).collect()}
    assert all((got[i] >= toxicity.THRESHOLD) == bool(t) for i, t in labels[250:])


def test_clause_not_word():
    g = toxicity.Grammar({"fool": (3.0, 0.0)}, (-2.9, 1.5, 1.0, 0.75))
    marks = lambda t: [m for c in g.clauses(t) for m in c]
    assert marks("a fool, he said nothing") == [("fool", "")] and marks("it said fool") == [("fool", "r")]
    assert marks("you fool") == [("fool", "t")] and marks("you are not a fool") == [("fool", "nt")]
    assert marks("a fool, not that it matters") == [("fool", "")] and marks("not late but a fool") == [("fool", "")]
    # a negation reaches SCOPE words
    assert marks("not one of you who read this long clause before was a fool") == [("fool", "t")]
    assert g.score("a fool")[0] > 0.7 > g.score("it said fool")[0] > g.score("you are not a fool")[0] > g.score(None)[0]
    assert g.score(None) == g.score("") == (g.score("unfool")[0], 0) and g.score("foolish. fool")[1] == 2 and g.score("a fool " * 3)[1] == 1


def test_threats_need_their_target():
    g = toxicity.Grammar({})
    assert g.score("I will kill you")[0] == g.score("ich werde dich töten")[0] == g.score("te voy a matar")[0] == 0.75
    for t in ("he will not kill you", "I want to kill time before you arrive", "he said he will kill you", "kill", "you kill time", "they never hurt you", "il a dit que je vais te tuer"):
        assert g.score(t)[0] < toxicity.THRESHOLD, t


def brute_marks(classes):
    """Without machines: what the grammar says of each word of a clause."""
    out, last = [], lambda k, xs: max((j for j in range(k) if classes[j] in xs), default=-1)
    taken = set()
    marks = {}
    for k, x in enumerate(classes):
        if x in "IT":
            edge = last(k, "B")
            negated = last(k, "N") > edge and k - last(k, "N") <= toxicity.SCOPE
            marks[k] = ("n" if negated else "") + ("r" if last(k, "R") > edge else "")
    finished = {}
    open_, objects = None, -99
    for k, x in enumerate(classes):
        if x == "T":
            if k - objects <= toxicity.BEFORE:
                finished[k], open_, objects = marks[k], None, -99
            else:
                open_, objects = k, -99
        elif x in "YP":
            if open_ is not None and k - open_ <= toxicity.AFTER:
                finished[k], open_ = marks[open_], None
            if x == "P":
                objects = k
    for k, x in enumerate(classes):
        if k in finished:
            out.append("X" + finished[k])
        elif x == "I":
            targeted = any(classes[j] in "YP" or j in finished for j in range(k))
            out.append("I" + marks[k] + ("t" if targeted else ""))
        else:
            out.append("O" if x == "T" else x)
    return out


def test_composed_machine_equals_the_cascade_and_brute_force():
    steps = ((0, toxicity.negation_step), (False, toxicity.reported_step), ((None, 0, 0), toxicity.threat_step), (False, toxicity.target_step))
    rng = random.Random(20)
    for _ in range(3000):
        classes = [rng.choice("ITYPNRBOOO") for _ in range(rng.randint(0, 14))]
        cascade = classes
        for state, step in steps:
            out = []
            for x in cascade:
                state, y = step(state, x)
                out.append(y)
            cascade = out
        assert toxicity.MACHINE(classes) == cascade == brute_marks(classes), classes


def test_toxicity_learns_marks_and_chance():
    assert toxicity.weigh_marks({}) == toxicity.DAMPED
    many = toxicity.weigh_marks({("", 1): 1000, ("n", 1): 500, ("r", 0): 500})
    assert many["n"] > 0.95 and many["r"] == toxicity.DAMPED["r"]
    assert toxicity.beyond_chance(1, 2000, 0.001) == 0 < toxicity.beyond_chance(1, 20, 0.001) < toxicity.beyond_chance(3, 20, 0.001)


def test_toxicity_of_odd_rows(spark):
    long = "word " * 300_000 + "you fool"
    rows = [(1, "a fool", "x", 3), (1, "a fool", "x", 3), (None, "fool", "x", 3), (2, None, None, None), (3, "", "x", 3), (4, long, "x", 3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, score string, toxic int")
    g = toxicity.Grammar({"fool": (3.0, 0.0)}, (-2.9, 1.5, 1.0, 0.75))
    got = sorted(((r.doc_id, round(r.score, 3), r.clauses) for r in toxicity.score(d, g).collect()), key=str)
    assert [(i, n) for i, _, n in got] == [(1, 1), (1, 1), (2, 0), (3, 0), (4, 1), (None, 1)] and got[0][1] == got[1][1]
    labels = spark.createDataFrame([(1, None), (None, 1), (1, 7), (9, 1)], "doc_id long, toxic int")
    learned = toxicity.learn(d.drop("toxic"), labels)
    assert learned.insults == {} and 0 <= learned.score(None)[0] < 0.5


def test_licenses(spark):
    texts = ["intro\nReleased under the MIT License.\nend", "Licensed under the Apache License Version 2.0", "a license to kill", None, "", "Permission is hereby granted, free of charge, to any person obtaining a copy\n" + licenses.TEMPLATES["MIT-text"][76:]]
    got = sorted((r.doc_id, r.license) for r in licenses.scan(frame(spark, texts)).collect())
    assert got == [(0, "MIT"), (1, "Apache-2.0"), (5, "MIT-text")]


def test_licenses_inside_long_lines(spark):
    """Notices in prose, in one-line documents and in minified files."""
    rng = random.Random(16)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    header = licenses.TEMPLATES["Apache-2.0-header"]
    broken = header.replace("License. You", "License.\n * You")
    texts = [
        "The source code of this project is released under the MIT License.",
        f"{prose(300)} Licensed under CC BY-NC 4.0. {prose(300)}",
        f"{prose(50)} {header} {prose(50)}; Released under the MIT License. Released under the MIT License. {prose(9)}",
        f"/*{prose(20)} {broken} {prose(20)}*/var a=1;" + "x=f(x);" * 400,
        f"one\ntwo license three {licenses.TEMPLATES['GPL-3.0']} four\nfive",
    ]
    rows = licenses.scan(frame(spark, texts)).collect()
    got = sorted((r.doc_id, r.start, r.license, r.first, r.last) for r in rows)
    assert [(d, k, a, b) for d, _, k, a, b in got] == [(0, "MIT", 0, 0), (1, "CC-BY-NC-4.0", 0, 0), (2, "Apache-2.0-header", 0, 0), (2, "MIT", 0, 0), (2, "MIT", 0, 0), (3, "Apache-2.0-header", 0, 1), (4, "GPL-3.0", 1, 1)]
    assert all(r.alike == 1 for r in rows)
    assert {texts[r.doc_id][r.start : r.stop] for r in rows if r.license == "MIT"} == {"released under the MIT License", "Released under the MIT License"}


def test_licenses_are_told_apart(spark):
    t = licenses.TEMPLATES
    known = {
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "GPL-2.0-header",
        t["GPL-3.0-header"].replace("General", "Lesser General"): "LGPL-3.0-header",
        t["GPL-3.0-header"].replace("General", "Affero General"): "AGPL-3.0-header",
        "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0-short",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0-long",
        "Released under the BSD License.": "BSD",
        "Licensed under the Apache License, Version 2": "Apache-2.0",
        "Released under the 3-Clause BSD License.": "BSD-3-Clause",
        t["BSD-2-Clause-text"].replace("Redistributions of", "1. Redistributions of").replace("Redistributions in", "2. Redistributions in"): "BSD-2-Clause-text",
        t["BSD-3-Clause-text"].replace("the copyright holder nor", "Example Inc. nor"): "BSD-3-Clause-text",
        t["ISC-text"]: "ISC-text",
        t["MPL-2.0-header"]: "MPL-2.0-header",
    }
    unknown = ["Licensed under the Apache License, Version 1.1.", "Released under the EUPL License.", "Released under the Free License.", "Licensed under CC BY-SA 1.0.", "Licensed under the GNU General Public License, version 7."]
    texts = [*known, *unknown, *t.values()]
    got = sorted((r.doc_id, r.license) for r in licenses.scan(frame(spark, texts)).collect())
    assert got == list(enumerate(known.values())) + [(i + len(known) + len(unknown), k) for i, k in enumerate(t)]


def test_licenses_are_chosen_by_compression(spark):
    """Two wordings miss one word each: the one that saves more bytes wins, whatever their order and number of words."""
    far = "Zephyr notice: redistribution and use of quartz is allowed with the above statement kept intact"
    near = far.replace("redistribution", "relicensing").replace("quartz", "these configurations")
    text = near.replace("configurations", "configuration").replace("relicensing", "redistribution")
    templates = {"far": far.replace("quartz", "such quartz"), "near": near.replace("relicensing", "redistributions")}
    for t in (templates, dict(reversed(templates.items()))):
        rows = licenses.scan(frame(spark, [f"one {text} two"]), t).collect()
        assert [r.license for r in rows] == ["near"], rows
        s = licenses.Scanner(t)
        own, given = s.sizes(text, "near")
        assert given < s.sizes(text, "far")[1] and rows[0].saving == 1 - given / own


def test_licenses_recall_in_long_lines(spark):
    """Every template, whole and slightly changed, somewhere in lines of 10,000 words; and none where there is none."""
    rng = random.Random(25)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(500)] + "the of under mit licensed license general software any version public".split()
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts, want = [], []
    for k, v in licenses.TEMPLATES.items():
        words = v.split()
        changed = [w for w in words if rng.random() > 0.06 or licenses.names(licenses.plain(licenses.WORD.findall(w.lower() + "x")[0][:-1] or "x"), words) or len(words) < 12]
        for t in (v, " ".join(changed)):
            texts.append(f"{prose(rng.randint(1, 5000))} {t} {prose(rng.randint(1, 5000))}")
            want.append(k)
    texts += [prose(10_000) for _ in range(5)]
    got = [(r.doc_id, r.license) for r in licenses.scan(frame(spark, texts)).collect()]
    hit = sum((i, k) in set(got) for i, k in enumerate(want))
    assert hit >= 0.9 * len(want), (hit, len(want))
    assert sum(i >= len(want) for i, _ in got) == 0


def test_seeds_are_in_every_block():
    """Whatever words a confirmed block lacks, it has a seed of its template."""
    rng = random.Random(26)
    s = licenses.Scanner(licenses.TEMPLATES)
    for k, own in s.words.items():
        mine = licenses.seeds(own)
        for _ in range(30):
            block = [w for w in own if rng.random() > rng.choice((0.1, 0.3, 0.5))]
            alike, missing, added = s.difference(" ".join(block), k)
            if alike >= licenses.MIN_ALIKE and not s.other(k, missing, added):
                assert mine & set(block), (k, block)


def test_licenses_of_odd_rows(spark):
    t = licenses.TEMPLATES["MIT"]
    rows = [(1, t, "x", 1), (1, t, "x", 1), (None, f"{t} {t}", "x", 1), (2, None, None, None), (3, "", "x", 1), (4, "x" * 1_000_000 + " " + t, "x", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, license string, start int")
    got = sorted((str(r.doc_id), r.license) for r in licenses.scan(d).collect())
    assert got == [("1", "MIT"), ("1", "MIT"), ("4", "MIT"), ("None", "MIT"), ("None", "MIT")]


def test_shortages_go_to_siblings_first():
    leaves = {("a", "x", "1"): 10, ("a", "x", "2"): 1000, ("b", "y", "3"): 1000}
    got = mixing.budgets(leaves, 600, 1)
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 290, ("b", "y", "3"): 300}
    assert mixing.budgets({("a", "x", "1"): 10, ("b", "y", "2"): 100}, 80, 1) == {("a", "x", "1"): 10, ("b", "y", "2"): 70}


def test_mixing_takes_the_prefix(spark):
    texts = [f"{'w ' * (i % 9 + 1)}" for i in range(300)] + [None]
    d = frame(spark, texts)
    got = mixing.mix(d, 0.5, 2, {("domain0",): 3.0})
    rows = got.select("doc_id", "mix_domain", "lang", "source", "mix_tokens", "mix_epoch").collect()
    leaf = lambda r: (r["mix_domain"], r["lang"] or "unknown", r["source"] or "unknown")
    every = d.withColumn("mix_domain", mixing.domain_of(F.col("source"))).withColumn("t", mixing.tokens(F.col("text"))).withColumn("o", F.shiftrightunsigned(F.xxhash64(F.lit(17), F.lit(0).cast("long"), "doc_id"), 4)).withColumn("p", F.shiftrightunsigned(F.xxhash64(F.lit(17), F.lit(1).cast("long"), "doc_id"), 4)).collect()
    total: dict = {}
    for r in every:
        total[leaf(r)] = total.get(leaf(r), 0) + r.t
    want = set()
    for k, b in mixing.budgets(total, sum(total.values()) // 2, 2, {("domain0",): 3.0}).items():
        for epoch, order in ((0, "o"), (1, "p")):
            left = b - epoch * total[k]
            for r in sorted((r for r in every if leaf(r) == k), key=lambda r: (r[order], r.doc_id)):
                if left - r.t < 0:
                    break
                left -= r.t
                want.add((r.doc_id, epoch))
    assert {(r.doc_id, r.mix_epoch) for r in rows} == want


def test_mixing_meets_target_weights(spark):
    """Leaf totals near their weights where no leaf is short, and names that clash with inner ones."""
    rng = random.Random(21)
    rows = [(i, "w " * rng.randint(1, 20), ["en", "fr"][i % 2], f"s{i % 5}", "x", 1, "y", 2, 3, 4) for i in range(4000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, e string, upto int, mix_domain string, mix_row int, n int, d int")
    targets = spark.createDataFrame([("domain0", None, None, 3.0), ("domain0", "en", None, 2.0), ("domain0", "fr", None, 1.0)], "domain string, lang string, source string, weight double")
    weights = mixing.weights_of(targets)
    assert weights == {("domain0",): 3.0, ("domain0", "en"): 2.0, ("domain0", "fr"): 1.0}
    where = F.when(F.col("source").isin("s0", "s1"), "domain0").otherwise("domain1")
    got = mixing.mix(d, 0.3, 1, weights, domain=where)
    assert got.columns == ["doc_id", "text", "lang", "source", "e", "upto", "mix_row", "n", "d", "mix_domain", "mix_tokens", "mix_epoch"]
    assert {(r.e, r.upto, r.mix_row, r.n, r.d) for r in got.select("e", "upto", "mix_row", "n", "d").distinct().collect()} == {("x", 1, 2, 3, 4)}
    total = sum(len(r[1].split()) for r in rows) * 0.3
    sums = {(r.mix_domain, r.lang): r.t for r in got.groupBy("mix_domain", "lang").agg(F.sum("mix_tokens").alias("t")).collect()}
    want = {("domain0", "en"): total * 3 / 4 * 2 / 3, ("domain0", "fr"): total * 3 / 4 / 3, ("domain1", "en"): total / 8, ("domain1", "fr"): total / 8}
    assert all(abs(sums[k] - v) < 60 for k, v in want.items()), (sums, want)
    with pytest.raises(ValueError):
        mixing.weights_of(spark.createDataFrame([("a", None, "b", 1.0)], "domain string, lang string, source string, weight double"))


def test_media_finds_edited_copies(spark):
    rng = np.random.default_rng(9)
    pictures, rows = [], []
    for _ in range(6):
        coarse = rng.random((14, 14)) * 255
        pictures.append(media.box(np.kron(coarse, np.ones((8, 8))), 2).astype(np.uint8))
    for i, p in enumerate(pictures):
        rows += [(i * 50, p), (i * 50 + 1, p[8:104, 12:108]), (i * 50 + 2, np.clip(p * 0.8 + 20, 0, 255).astype(np.uint8)), (i * 50 + 3, p)]
    data = [(i, np.ascontiguousarray(p).tobytes(), p.shape[1]) for i, p in rows] + [(1001, None, 4), (1002, b"abc", 2), (1003, bytes(400), 20)]
    members, found = media.find_copies(spark.createDataFrame(data, "image_id long, pixels binary, width int"))
    name = {r["class"]: r.image_id for r in members.orderBy(F.desc("image_id")).collect()}
    pairs = {(name[r.query], name[r["class"]]) for r in found.collect()}
    assert {(i * 50, i * 50 + k) for i in range(6) for k in (1, 2)} <= pairs
    assert all(a // 50 == b // 50 for a, b in pairs)


def test_media_finds_all_matches(spark, monkeypatch):
    """All pairs within the distance, against brute force, though hundreds of entries share each band value."""
    rng = np.random.default_rng(12)
    base = rng.integers(0, 256, (3, media.BITS // 8), dtype=np.uint8)
    bits = np.repeat(base, 150, axis=0)
    for b in bits:
        for k in rng.choice(media.BITS, rng.integers(0, 5), replace=False):
            b[k // 8] ^= 1 << k % 8
    halves = bits.view(">i8")
    rows = [(i, float(i), 2.0 * i, 0.0, 1, int(h), int(g)) for i, (h, g) in enumerate(halves)]
    index = spark.createDataFrame(rows, "no long, x float, y float, angle float, size int, high long, low long")
    apart = np.bitwise_count(bits[:, None] ^ bits[None]).sum(2)
    want = {(i, j) for i in range(len(bits)) for j in range(i + 1, len(bits)) if apart[i, j] <= media.DISTANCE}
    assert len(want) > 10000
    for block in (2048, 20):
        monkeypatch.setattr(media, "BLOCK", block)
        assert {(r.q, r.no) for r in media.matches(index).collect()} == want
        some = {(r.q, r.no) for r in media.star_matches(index, None, 0).collect()}
        assert some and some <= want
    # entries of one group are not compared with each other
    labels = spark.createDataFrame([(i, i // 150) for i in range(0, len(bits), 2)], "node long, label long")
    group = lambda i: i // 150 if i % 2 == 0 else i
    assert {(r.q, r.no) for r in media.matches(index, labels).collect()} == {(i, j) for i, j in want if group(i) != group(j)}


def test_media_bands_cover_the_bits(spark):
    rng = np.random.default_rng(17)
    bits = rng.integers(0, 256, (20, media.BITS // 8), dtype=np.uint8)
    rows = [(i, int(h), int(g)) for i, (h, g) in enumerate(bits.view(">i8"))]
    got = spark.createDataFrame(rows, "no long, high long, low long").select("no", *(media.band(i).alias(f"b{i}") for i in range(media.BANDS))).collect()
    for r in got:
        text = "".join(f"{b:08b}" for b in bits[r.no])
        assert [r[1 + i] for i in range(media.BANDS)] == [(i << media.WIDTH) + int(text[i * media.WIDTH : (i + 1) * media.WIDTH], 2) for i in range(media.BANDS)]


def groups_of(df):
    out: dict = {}
    for r in df.collect():
        out.setdefault(r.copy_id, set()).add(r.image_id)
    return sorted(map(sorted, out.values()))


def test_media_has_a_row_for_every_image(spark):
    """Exact copies without another near copy, members besides the least, null ids and odd pixels are in the result."""
    rng = np.random.default_rng(13)
    made = [media.box(np.kron(rng.random((14, 14)) * 255, np.ones((8, 8))), 2).astype(np.uint8) for _ in range(2)]
    pixels = {0: made[0], 7: made[0], 9: made[0], 50: made[1], 51: np.ascontiguousarray(made[1][8:104, 12:108]), 53: made[1]}
    data = [(i, p.tobytes(), p.shape[1], "x", 1) for i, p in pixels.items()] + [(60, None, 4, "x", 1), (None, None, 4, None, None), (None, b"abc", 2, "x", 1)]
    images = spark.createDataFrame(data, "image_id long, pixels binary, width int, class string, no int")
    got = media.find_groups(images).collect()
    assert sorted((str(r.image_id), str(r.class_id), r.members, str(r.copy_id)) for r in got) == sorted(
        [("0", "0", 3, "0"), ("7", "0", 3, "0"), ("9", "0", 3, "0"), ("50", "50", 2, "50"), ("53", "50", 2, "50"), ("51", "51", 1, "50"), ("60", "60", 2, "60"), ("None", "60", 2, "60"), ("None", "None", 1, "None")]
    )
    assert media.find_groups(images.limit(0)).count() == 0


def test_media_pictures_of_odd_vectors(spark):
    rows = [(1, [0.5] * 64), (2, None), (3, []), (4, [float("nan")] * 64), (5, [None, 1.0]), (6, [0.0] * 64), (None, [1.0, 2.0, 3.0])]
    got = {r.image_id: r.pixels and len(r.pixels) for r in media.picture(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    n = media.SIDE**2
    assert got == {1: n, 2: None, 3: None, 4: None, 5: None, 6: n, None: n}


@pytest.mark.parametrize("block", [2048, 6])
def test_media_groups_equal_all_pairs(spark, monkeypatch, block):
    """Groups of the query's own pictures against brute force over all corners of all pairs."""
    monkeypatch.setattr(media, "BLOCK", block)
    rng = np.random.default_rng(18)
    vectors = rng.normal(size=(24, 64))
    rows = [(10 * i + k, (v + rng.normal(0, 0.05 * k, 64)).tolist()) for i, v in enumerate(vectors) for k in range(4)]
    images = media.picture(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    own = {r.image_id: media.describe(np.frombuffer(bytes(r.pixels), np.uint8).reshape(-1, r.width)) for r in images.collect()}
    ids = sorted(own)
    of = {i: i for i in ids}
    pairs = set()
    for i in ids:
        for j in ids:
            if i < j:
                m = [(0, 1, p[0], p[1], q[0], q[1], q[2] - p[2], q[3] / p[3]) for p in own[i] for q in own[j] if sum(bin((a ^ b) & (1 << 64) - 1).count("1") for a, b in zip(p[4:], q[4:])) <= media.DISTANCE]
                if len(m) < media.VOTES:
                    continue
                batch = media.pa.RecordBatch.from_arrays([media.pa.array(v, f.type) for v, f in zip(zip(*m), media.PA_MATCH)], schema=media.PA_MATCH)
                if any(v * media.SHARE >= min(len(own[i]), len(own[j])) for b in media.vote([batch]) for v in b.column("votes").to_pylist()):
                    pairs.add((i, j))
                    x, y = of[i], of[j]
                    of = {k: min(x, y) if c in (x, y) else c for k, c in of.items()}
    assert len(pairs) > 24 and all(i // 10 == j // 10 for i, j in pairs)
    assert {r.image_id: r.copy_id for r in media.find_groups(images).collect()} == of
    members, found = media.find_copies(images)
    name = {r["class"]: r.image_id for r in members.collect()}
    assert {(name[r.query], name[r["class"]]) for r in found.collect()} == pairs | {(j, i) for i, j in pairs}


def turned(p, degrees):
    """The middle of a picture, turned about its centre, between pixels by their four neighbours."""
    n, m, a = len(p), len(p) // 2 - 18, np.radians(degrees)
    v, u = np.mgrid[-m : m + 1, -m : m + 1].astype(float)
    x, y = (n - 1) / 2 + u * np.cos(a) + v * np.sin(a), (n - 1) / 2 - u * np.sin(a) + v * np.cos(a)
    i, j = y.astype(int), x.astype(int)
    f, g, p = y - i, x - j, p.astype(float)
    return (p[i, j] * (1 - f) * (1 - g) + p[i + 1, j] * f * (1 - g) + p[i, j + 1] * (1 - f) * g + p[i + 1, j + 1] * f * g).astype(np.uint8)


def test_media_finds_turned_and_resized_copies(spark):
    rng = np.random.default_rng(14)
    rows = []
    for i in range(5):
        p = media.box(np.kron(rng.random((20, 20)) * 255, np.ones((8, 8))), 2).astype(np.uint8)
        half = p.reshape(80, 2, 80, 2).mean((1, 3)).astype(np.uint8)
        rows += [(i * 50 + k, v) for k, v in enumerate((p, np.rot90(p), np.rot90(p, 2), np.rot90(p, 3), half, np.rot90(half), turned(p, 20), turned(p, -75)))]
    data = [(i, np.ascontiguousarray(p).tobytes(), p.shape[1]) for i, p in rows]
    members, found = media.find_copies(spark.createDataFrame(data, "image_id long, pixels binary, width int"))
    name = {r["class"]: r.image_id for r in members.collect()}
    pairs = {(name[r.query], name[r["class"]]) for r in found.collect()}
    missed = {(i * 50, i * 50 + k) for i in range(5) for k in range(1, 8)} - pairs
    assert not missed, missed
    assert all(a // 50 == b // 50 for a, b in pairs)


def test_media_compares_all_with_all(spark):
    rng = np.random.default_rng(15)
    data = []
    for i in range(3):
        p = media.box(np.kron(rng.random((14, 14)) * 255, np.ones((8, 8))), 2).astype(np.uint8)
        data += [(10 * i + 1, p.tobytes(), 112), (10 * i + 2, np.ascontiguousarray(p[8:104, 12:108]).tobytes(), 96)]
    assert groups_of(media.find_groups(spark.createDataFrame(data, "image_id long, pixels binary, width int"))) == [[10 * i + 1, 10 * i + 2] for i in range(3)]


# Defined cases -----------------------------------------------------------------------------------------------


def test_empty_tables(spark, empty):
    assert substrings.remove_repeats(empty).count() == 0 and suffixes.remove_repeats(empty).count() == 0
    assert jaccard.near_duplicates(empty).count() == 0 and parsing.fingerprints(empty).count() == 0
    assert packing.pack(empty).count() == 0 and mixing.mix(empty).count() == 0 and licenses.scan(empty).count() == 0
    assert langid.identify(empty, langid.learn(empty)).count() == 0
    assert toxicity.score(empty, toxicity.learn(empty, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0


def test_null_and_repeated_ids(spark):
    t = " ".join(f"w{i}" for i in range(40))
    d = frame(spark, [t, t, t, None], [3, 3, None, None], extra=True)
    assert sorted((str(r.doc_id), r.n_removed) for r in substrings.remove_repeats(d).collect()) == [("3", 0), ("3", 0), ("None", 0), ("None", 40)]
    assert suffixes.remove_repeats(d).count() == 4 and parsing.fingerprints(d).count() == 4 and packing.pack(d).count() == 4
    assert langid.identify(d, {}).count() == 4 and mixing.mix(d, 1.0, 1).count() == 4


def test_very_long_text(spark):
    t = " ".join(f"w{i % 7919}" for i in range(400_000))
    d = frame(spark, [t, "x y z", t[:5000]])
    assert {r.doc_id: r.n_removed > 0 for r in suffixes.remove_repeats(d, keep=False).collect()} == {0: True, 1: False, 2: True}
    assert packing.pieces(d).where("doc_id = 0").count() > 500


def brute_first(texts, length):
    """Texts without the bytes of strings that start earlier too."""
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            k = b[p : p + length]
            if k in seen:
                gone[p : p + length] = True
            seen.add(k)
        out.append((int(gone.sum()), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("length,gram,hot,sizes", [(400, 100, 2000, None), (60, 20, 2000, None), (60, 20, 1, None), (40, 10, 3, (900, 4000)), (60, 20, 2000, (700, 2000))])
def test_suffixes_keep_the_first_place(docs, monkeypatch, length, gram, hot, sizes):
    if sizes:
        monkeypatch.setattr(chunks.Exchange.__init__, "__defaults__", (*sizes, ()))
        monkeypatch.setattr(suffixes, "BATCH", 8)
    rows = suffixes.remove_repeats(docs, length, gram, hot, first=True, carry=("lang", "source", "key")).collect()
    texts = corpus()
    assert {r.doc_id: (r.n_removed, bytes(r.kept)) for r in rows} == dict(enumerate(brute_first(texts, length)))
    assert {r.doc_id: (r.lang, r.source, r.key) for r in rows} == {r.doc_id: (r.lang, r.source, r.key) for r in docs.collect()}
    assert all(r.kept_text == (None if texts[r.doc_id] is None else bytes(r.kept).decode("utf-8", "ignore")) for r in rows)


def test_suffixes_measure_other_lengths(docs, monkeypatch):
    monkeypatch.setattr(chunks.Exchange.__init__, "__defaults__", (900, 4000, ()))
    rows = suffixes.remove_repeats(docs, 60, 20, also=(30, 90)).collect()
    assert {r.doc_id: r.n_removed for r in rows} == {i: r[1] for i, r in enumerate(brute_bytes(corpus(), 60))}
    want = [[r[1] for r in brute_bytes(corpus(), k)] for k in (30, 90)]
    assert {r.doc_id: r.n_repeated for r in rows} == {i: [a, b] for i, (a, b) in enumerate(zip(*want))}


def test_parts_of_the_hash_space():
    rng = np.random.default_rng(19)
    for n, buckets in ((0, 8), (5, 8), (5, 1000), (1000, 8), (1000, 999), (3, 7)):
        h = np.sort(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        got = list(chunks.parts(h, buckets))
        assert [x for b, i, j in got for x in [b] * (j - i)] == [int(x) * buckets >> 64 for x in h] and all(i < j for _, i, j in got)


@pytest.fixture(scope="module")
def odd(spark):
    """Ties, repeated and null ids, null columns, clashing names and a very long text."""
    t = " ".join(f"w{i % 977}" for i in range(120_000))
    rows = [(1, t), (1, t), (2, t[:4000]), (3, ""), (4, None), (None, t[:4000]), (None, None), (5, " \n"), (6, "one two three"), (6, "four five")]
    extra = "chunk string, key string, kept string, score string, n string, part string, block string, owner string, c0 string, at string, cell string, range string"
    return spark.createDataFrame([(i, x, None, None, None, *["z"] * 12) for i, x in rows], SCHEMA + ", " + extra), rows


def test_odd_rows_of_every_operator(odd):
    d, rows = odd
    ids = sorted(str(i) for i, _ in rows)
    same = lambda df: sorted(str(r.doc_id) for r in df.select("doc_id").collect()) == ids
    for df in (langid.identify(d, langid.learn(d)), parsing.fingerprints(d), suffixes.remove_repeats(d), jaccard.near_duplicates(d), substrings.remove_repeats(d), mixing.mix(d, 1.0, 1), toxicity.score(d, toxicity.Grammar({}))):
        assert same(df)
    assert {str(r.doc_id) for r in packing.pieces(d).select("doc_id").collect()} == set(ids)
    parts = {(str(r.doc_id), r.n_shingles): r.component_id for r in jaccard.near_duplicates(d).collect()}
    assert parts[("1", 977)] == 1 and parts[("3", 0)] == 3 and parts[("6", 1)] == 6 and parts[("None", 0)] is None
    kept = sorted((str(r.doc_id), r.n_removed > 0) for r in substrings.remove_repeats(d).collect())
    assert ("1", True) not in kept and ("2", True) in kept and ("None", True) in kept  # rows of one id do not remove from each other
    prints = [r for r in parsing.fingerprints(d).collect() if r.doc_id == 1]
    assert prints[0].fingerprint == prints[1].fingerprint and prints[0].n_chars > 500_000


def test_language_ties_and_long_texts(spark):
    dictionaries = {"b": b"xyz " * 50, "a": b"xyz " * 50}
    d = spark.createDataFrame([(1, "xyz xyz xyz"), (1, "xyz xyz xyz"), (2, "abcdefgh " * 60_000)], "doc_id long, text string")
    got = langid.identify(d, dict(sorted(dictionaries.items()))).collect()
    assert [r.lang_pred for r in got if r.doc_id == 1] == ["a", "a"] and not any(r.accepted for r in got if r.doc_id == 1)
    assert all(0 <= r.score <= 1 for r in got)


# HyperMinHash --------------------------------------------------------------------------------------------


def brute_near(texts, words):
    """(number of shingles, least reachable index) of each text."""
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    of = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                x, y = of[i], of[j]
                of = [min(x, y) if v in (x, y) else v for v in of]
    return [(len(s), c) for s, c in zip(sets, of)]


@pytest.mark.parametrize("block", [2048, 3])
def test_hyperminhash_matches_brute_force(docs, block):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in hyperminhash.deduplicated(docs, block=block).collect()}
    want = brute_near(corpus(), 4)
    assert len({c for _, c in want}) < len(want) - 8 and got == {i: (n, c, c == i) for i, (n, c) in enumerate(want)}


def test_hyperminhash_over_many_chunks(docs, monkeypatch):
    monkeypatch.setattr(chunks.Exchange.__init__, "__defaults__", (500, 2000, ()))
    monkeypatch.setattr(hyperminhash, "TOGETHER", 4)
    got = {r.doc_id: r.component_id for r in hyperminhash.deduplicated(docs).collect()}
    assert got == {i: c for i, (_, c) in enumerate(brute_near(corpus(), 4))}


def near_sets(rng, n, similarity, size):
    """Pairs of sets of about this similarity, as hashes."""
    for _ in range(n):
        both = round(size * 2 * similarity / (1 + similarity))
        h = rng.integers(0, 1 << 63, 2 * size - both).astype(np.uint64)
        yield np.sort(h[:size]), np.sort(h[size - both :])


@pytest.mark.parametrize("size", [1, 5, 9, 40, 400, 5000])
def test_hyperminhash_estimates_and_recall(size):
    """All pairs of at least 0.8 are found in spite of bands and estimates; estimates are right on average."""
    rng = np.random.default_rng(size)
    for similarity in (0.8, 0.95, 0.3, 0.0):
        seen = []
        for a, b in near_sets(rng, 40, similarity, size):
            true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
            one = [(1, a), (2, b)]
            assert bool(list(hyperminhash.sketch_join(one, one))) == (true >= 0.8)
            assert bool(list(hyperminhash.sketch_join([(1, a)], [(2, b)]))) == (true >= 0.8)
            r = hyperminhash.registers(np.concatenate([a, b]), np.repeat([0, 1], size), 2)
            j, n = hyperminhash.estimates(r[0], size, r[1:], np.array([size]))
            seen.append(j[0] - true)
        assert abs(np.mean(seen)) < 0.05


def test_hyperminhash_registers_equal_brute_force():
    rng = np.random.default_rng(1)
    values, owner = rng.integers(0, 1 << 63, 900).astype(np.uint64), np.sort(rng.integers(0, 3, 900))
    got = hyperminhash.registers(values, owner, 4)
    assert (got[3] == hyperminhash.EMPTY).all()
    want = np.full((4, hyperminhash.REGISTERS), hyperminhash.EMPTY)
    least: dict = {}
    for v, o in zip(values, owner.tolist()):
        place = int(hashing.mix(np.array([v]))[0]) // 2**32 * hyperminhash.REGISTERS // 2**32
        rest = int(hashing.mix(np.array([v ^ np.uint64(0xD6E8FEB86659FD93)]))[0]) >> 24
        least[o, place] = min(rest, least.get((o, place), rest))
    for (o, place), rest in least.items():
        digits = f"{rest:040b}"
        zeros = len(digits) - len(digits.lstrip("0"))
        want[o, place] = zeros << 10 | int((digits[zeros + 1 :] + "0" * 10)[:10], 2)
    assert (got == want).all()


def test_hyperminhash_join_is_complete():
    """Dense groups around a base, of which not all are linked with each other, in one list and between two."""
    rng = np.random.default_rng(5)
    sets = []
    for g in range(6):
        base = rng.integers(0, 1 << 63, 80).astype(np.uint64)
        for _ in range(30):
            b = base.copy()
            b[rng.integers(0, 80, 8)] = rng.integers(0, 1 << 63, 8).astype(np.uint64)
            sets.append((len(sets), np.unique(b)))
        sets.append((len(sets), np.unique(base)))
    both = [set(h.tolist()) for _, h in sets]

    def closed(links):
        of = list(range(len(sets)))
        for a, b in links:
            x, y = of[a], of[b]
            of = [min(x, y) if v in (x, y) else v for v in of]
        return of

    similar = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(both[i] & both[j]) >= 4 * len(both[i] | both[j])]
    links = list(hyperminhash.sketch_join(sets, sets))
    assert closed(links) == closed(similar) and len(links) == len(sets) - len(set(closed(similar))) > 150 and set(links) <= {*similar, *((j, i) for i, j in similar)}
    one, two = sets[::2], sets[1::2]
    across = list(hyperminhash.sketch_join(one, two))
    assert closed(across) == closed([(i, j) for i, j in similar if i % 2 != j % 2])


def test_hyperminhash_defined_cases(spark, empty):
    t = "a b c d e f g h"
    got = hyperminhash.deduplicated(frame(spark, [t, t, "x", t, None, "", "x y", "X"], [5, 5, 6, None, None, 8, 9, 4], extra=True)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id) == [(4, 1, 4, True), (5, 5, 5, True), (5, 5, 5, True), (6, 1, 4, False), (8, 0, 8, True), (9, 1, 9, True)]
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None) == [(0, None, None), (5, None, None)]
    assert hyperminhash.deduplicated(empty).count() == 0
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = hyperminhash.deduplicated(frame(spark, [long, long.replace("w7 ", "W7x "), "short"])).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in rows] == [(59_997, 0), (59_997, 0), (1, 2)]


def test_hyperminhash_hot_bands(spark, monkeypatch):
    """Bands of more sets than fit one meeting, and chunks of few documents."""
    monkeypatch.setattr(hyperminhash, "PART", 3)
    monkeypatch.setattr(chunks.Exchange.__init__, "__defaults__", (900, 2000, ()))
    rng = random.Random(8)
    texts = []
    for size in (40, 41, 90):
        base = [f"w{size}x{k}" for k in range(size)]
        for _ in range(30):
            w = list(base)
            w[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w[: size - rng.randrange(3)]))
        texts.append(" ".join(base))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in hyperminhash.deduplicated(frame(spark, texts)).collect()}
    assert got == dict(enumerate(brute_near(texts, 4)))


def test_hyperminhash_stars_connect_what_is_near():
    """Groups of two, of more and of equal sets; what is far apart stays apart, and shared passages make no chain."""
    rng = np.random.default_rng(9)
    rows, group = [], []
    passage = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    for g in range(40):
        own = rng.integers(0, 1 << 63, 200).astype(np.uint64)
        for k in range(1 + g % 4):
            h = np.concatenate([own, passage])
            h[rng.integers(0, 200, k)] = rng.integers(0, 1 << 63, k).astype(np.uint64)
            rows.append(np.unique(h))
            group.append(g)
    n = len(rows)
    regs = hyperminhash.registers(np.concatenate(rows), np.repeat(np.arange(n), [len(r) for r in rows]), n)
    e = np.zeros(n, hyperminhash.ENTRY)
    e["band"], e["id"], e["n"], e["brief"] = 5, np.arange(n), [len(r) for r in rows], hyperminhash.brief(regs)
    to = hyperminhash.stars(e)
    assert all((to[i] < 0) == (group.count(group[i]) == 1) for i in range(n))
    assert all((to[i] == to[j]) == (group[i] == group[j]) for i in range(n) for j in range(n) if to[i] >= 0 and to[j] >= 0)
    pair = e[[group.index(3), group.index(3) + 1, group.index(2), group.index(5)]].copy()
    pair["band"] = [1, 1, 2, 2]
    assert hyperminhash.stars(pair).tolist() == [0, 0, -1, -1]
