"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from ledgerloom.llm import fingerprint, packing, pieces, quality_cnn, quality_rules, simhash, substring_dedup
from ledgerloom.llm import textkernel as k

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    vocabulary = ["casa", "Straße", "the", "of", "日本", "naïve", "x", "word" * 20, "B", "é", "🙂", "#tag", "a|b"]
    make = lambda n: "".join(vocabulary[i] + " \n\t  "[rng.integers(0, 5)] for i in rng.integers(0, len(vocabulary), n))
    shared = make(40)
    out = [None, "", "   \n", "one", "a b", "  ", make(3000)]
    out += [make(n) for n in rng.integers(1, 120, 25)]
    out += [make(10) + " " + shared + " " + make(10) for _ in range(5)] + [shared] * 3 + ["line here\nline here\n\nline here"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(10 * i + 3, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[8]], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- operator 1


def test_fingerprint_likeness_is_generalised_jaccard():
    rng = np.random.default_rng(5)
    gaps = []
    for _ in range(40):
        a = [f"w{i}" for i in rng.integers(0, 40, 300)]
        b = a[: rng.integers(100, 300)] + [f"w{i}" for i in rng.integers(0, 40, 60)]
        x, y = (Counter(zip(t)) for t in (a, b))
        true = sum((x & y).values()) / sum((x | y).values())
        p = fingerprint.fingerprints(pa.array([" ".join(a), " ".join(b)]), 1)
        gaps.append(fingerprint.likeness(p[:1], p[1:])[0] - true)
    assert abs(np.mean(gaps)) < 0.03 and np.std(gaps) < 0.08


def test_fingerprints_of_neighbours(docs, texts):
    rows = fingerprint.edited_likeness(docs.dropDuplicates(), ranges=5).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts)
    order = sorted(got, reverse=True)
    text = {10 * i + 3: t or "" for i, t in enumerate(texts)}
    for i, d in enumerate(order):
        own, following = text[d], text[order[(i + 1) % len(order)]]
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        assert got[d]["n_chars"] == len(own)
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = fingerprint.fingerprints(pa.array([own, edited, following]))
        assert got[d]["fingerprint"] == fingerprint.as_hex(a[None])[0]
        assert got[d]["edited_fingerprint"] == fingerprint.as_hex(b[None])[0]
        assert got[d]["near_edited"] == (a == b).mean() and got[d]["near_next"] == (a == c).mean()


def test_fingerprints_of_null_repeated_and_few_rows(spark):
    rows = [(5, "a b c"), (5, "a b c"), (None, "x"), (9, None)]
    got = fingerprint.edited_likeness(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as range", "2 as tail")).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == Counter([(5, 5), (5, 5), (None, 1), (9, 0)])
    (alone,) = fingerprint.edited_likeness(spark.createDataFrame([(1, "abcdef")], SCHEMA)).collect()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest()
    assert fingerprint.edited_likeness(empty(spark)).count() == 0
    many = spark.createDataFrame([(i, f"t{i}") for i in range(500)], SCHEMA)
    for ranges in (1, 3, 200):
        got = {r["doc_id"]: r["edited_sha256"] for r in fingerprint.edited_likeness(many, ranges).collect()}
        edit = lambda i: (a := f"t{i}")[: len(a) - len(a) // 2] + f"t{(i - 1) % 500}"[: len(a) // 2]
        assert got == {i: hashlib.sha256(edit(i).encode()).hexdigest() for i in range(500)}


# ---- operator 2


def _merged_plainly(unit, score, part, skipped):
    """Again and again the best adjacent pair that no hash skips; the leftmost of equals."""
    cuts = list(range(len(part) + 1))
    while True:
        found = [
            (-score(unit[part[a:c]]), a, j)
            for j, (a, b, c) in enumerate(zip(cuts, cuts[1:], cuts[2:]))
            if part[a:c] in unit and not skipped(a, b, c)
        ]
        if not found:
            return [(unit[part[a:b]], a) for a, b in zip(cuts, cuts[1:])]
        del cuts[min(found)[2] + 1]


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5])
def test_merges_equal_plain_ones(dropout):
    import public_tokenizers
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Pieces(path)
    rng, bar = np.random.default_rng(1), int(dropout * 2**64)
    vocabulary = [" the", " international", "ization", "casa", "ção", " ", "aaaa", "e", "straße", "un"]
    parts = ["".join(vocabulary[i] for i in rng.integers(0, 10, n)) for n in rng.integers(1, 7, 60)]
    keys = rng.integers(0, 1 << 63, len(parts), dtype=np.uint64)
    ids = [[int(model.char[ord(c)]) for c in p] for p in parts]
    c = [int(x) for x in pieces._C]
    want = []
    for p, key in zip(parts, keys):
        skip = lambda i, j, e, key=int(key): bool(bar) and pieces._mix1(key + i * c[0] + j * c[1] + e * c[2]) < bar
        want.append(_merged_plainly(model.unit, library.get_score, p, skip))
    assert [pieces.merge_one(model, x, int(key), bar) for x, key in zip(ids, keys)] == want
    off = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
    part, first, found = pieces.merge_many(model, np.concatenate(ids), off, keys, bar)
    got = [[] for _ in parts]
    for i, a, x in zip(part.tolist(), first.tolist(), found.tolist()):
        got[i].append((x, a))
    assert got == want or [[(x, a - off[i]) for x, a in g] for i, g in enumerate(got)] == want


def test_pieces_round_trip_and_without_dropout_equal_the_library(spark, docs):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    plain = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (2, "uma casa na cidade de São Paulo")], SCHEMA)
    assert [[library.IdToPiece(i) for i in r["ids"]] for r in pieces.encode(plain, dropout=0.0).orderBy("doc_id").collect()] == [
        library.EncodeAsPieces(r["text"]) for r in plain.orderBy("doc_id").collect()
    ]
    ids = pieces.encode(docs)
    back = Counter((r["doc_id"], r["text"]) for r in pieces.decode_ids(ids).collect())
    assert back == Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    assert all(r["lossless"] for r in pieces.round_trip(docs).collect())
    same, other, none = (sum(len(r["ids"]) for r in pieces.encode(docs, seed=s, dropout=p).collect()) for s, p in ((42, 0.1), (7, 0.1), (42, 0.0)))
    assert same == sum(len(r["ids"]) for r in ids.collect()) and none < same and abs(other - same) < 0.1 * same
    assert pieces.encode(empty(spark)).count() == 0


def test_dropout_acts_on_each_occurrence():
    encoder = pieces.Encoder(pieces._path(pieces.MODEL))
    model = encoder.model
    # a part with one possible merge: whole unless that is skipped
    word = next(p for p in sorted(model.unit) if len(p) == 2 and p[0] == " " and p[1] != " " and model.char[ord(p[1])] >= 0)
    for text, docs, n in (([word[1] + word * 19999], [7], 20000), ([word[1]] * 20000, list(range(20000)), 20000)):
        ids, place = encoder.encode(text, np.array(docs))
        assert abs((len(ids) - n) / n - 0.1) < 0.01


def test_remembered_ids_equal_merging_every_occurrence(texts):
    docs = [t for t in texts if t] + ["the international house of the the the uma ação e outra ação " * 400, "x" * 300 + " aaaa" * 300]
    found, plain = (pieces.Encoder(pieces._path(pieces.MODEL), dropout=0.3) for _ in range(2))
    plain.memory.find = lambda key, learn: (lambda ids, size: (ids, np.concatenate(([0], np.cumsum(size)))))(*learn(np.arange(len(key))))
    for part in (docs, docs[::-1]):
        at = np.arange(len(part))
        assert [x.tolist() for x in found.encode(part, at)] == [x.tolist() for x in plain.encode(part, at)]


# ---- operator 3


def test_quality_rules_counts(docs, texts):
    got = by_id(quality_rules.quality_rules(docs, quality_rules.fit(*k.utf8(pa.array([], pa.string())), np.zeros(0, np.int64), np.zeros(0))))
    for i, t in enumerate(texts):
        w, r = words(t), got[10 * i + 3]
        windows = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        inside = {j + d for j in range(len(w) - 2) if windows[tuple(w[j : j + 3])] > 1 for d in range(3)}
        seen = [line for line in (t or "").split("\n") if words(line)]
        assert r["n_words"] == len(w) and r["word_chars"] == sum(map(len, w)), t
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t or "") and r["n_dup_lines"] == len(seen) - len(set(seen))
        assert r["n_repeat_words"] == len(inside)
        assert r["base_failed"] == (len(w) < 50 or 100 * len(inside) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])


def test_rule_scores_do_not_depend_on_the_texts_beside(texts):
    rng = np.random.default_rng(5)
    model = {"weights": [rng.normal(0, 1, 1 << quality_rules.BITS).astype(np.float32) for _ in range(3)], "bias": 0.3, "a": 1.1, "b": -0.2}
    own = [t for t in texts if t is not None]
    alone = [quality_rules.score(*k.utf8(pa.array([t])), model)[0] for t in own]
    for order in (range(len(own)), rng.permutation(len(own))):
        assert quality_rules.score(*k.utf8(pa.array([own[i] for i in order])), model).tolist() == [alone[i] for i in order]
    grams = quality_rules._features(*k.utf8(pa.array(["é日🙂aé日🙂a"])))[2]
    assert len(grams[0]) == 5 and grams[0][0] == grams[0][4]


def _auc(p, y):
    order = np.argsort(np.argsort(p))
    good = y == 1
    return (order[good].sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum())


def test_models_tell_good_from_bad_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = labels.filter(quality_cnn.is_held_out()).join(docs.select("doc_id", "text"), "doc_id")
    net = quality_cnn.fit_classifier(docs, labels)
    got = quality_cnn.classify(held.select("doc_id", "text"), net).join(held.select("doc_id", "quality"), "doc_id").toPandas()
    assert _auc(got["score"].to_numpy(), got["quality"].to_numpy()) > 0.9
    model = quality_rules.fit_rules(docs, labels.filter(~quality_cnn.is_held_out()))
    got = quality_rules.quality_rules(held.select("doc_id", "text"), model).join(held.select("doc_id", "quality"), "doc_id").toPandas()
    judged = got[~got["base_failed"]]  # the model learns from and judges only what the base rules pass
    assert _auc(judged["p_good"].to_numpy(), judged["quality"].to_numpy()) > 0.97
    assert judged[judged["quality"] == 1]["kept"].mean() > 0.97 and got[got["quality"] == 0]["kept"].mean() < 0.03


def test_models_without_labels_and_columns_kept(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    net = quality_cnn.fit_classifier(docs, labels)
    assert {r["score"] for r in quality_cnn.classify(docs, net).collect()} == {0.5}
    odd = docs.selectExpr("doc_id", "text", "1 as score", "2 as quality", "'x' as kept")
    assert quality_cnn.keep_good(odd, net).columns == odd.columns
    assert quality_rules.keep_quality_rules(odd, quality_rules.fit_rules(odd, labels)).columns == odd.columns


def test_models_take_empty_tables_null_ids_long_texts_and_one_class(spark):
    long = "word casa " * 200_000
    rows = [(None, "a"), (None, None), (4, long), (4, long), (5, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (4, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    for fit, run in ((quality_rules.fit_rules, quality_rules.quality_rules), (quality_cnn.fit_classifier, quality_cnn.classify)):
        for given in (labels, labels.filter("quality = 1"), labels.limit(0)):
            model = fit(docs, given)
            got = run(docs, model).collect()
            assert Counter(r["doc_id"] for r in got) == Counter([None, None, 4, 4, 5])
            assert len({tuple(r)[1:] for r in got if r["doc_id"] == 4}) == 1
            assert run(empty(spark), model).count() == 0
    sample = quality_rules.labelled_sample(docs, labels, 10).collect()
    assert sorted((r["doc_id"], r["y"]) for r in sample) == [(4, 0), (5, 1)]


def test_scores_do_not_depend_on_the_texts_beside():
    rng = np.random.default_rng(5)
    c = quality_cnn
    draw = lambda *n: rng.normal(0, 1, n).astype(np.float32)
    net = {"embed": draw(256, c.CHANNELS), "filters": draw(c.STEP * c.CHANNELS, c.GROUPS * c.FILTERS), "shift": draw(c.FILTERS), "v_mean": draw(c.FILTERS), "v_max": draw(c.FILTERS), "bias": 0.0}

    def logits(texts):
        return c.logits(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))), net)

    words = [b"the ", b"casa ", b"of the ", b"word "]
    texts = [b"".join(words[i] for i in rng.integers(0, 4, n // 4))[:n] for n in (0, 1, 92, 96, 108, 111, 112, 113, 236, 240, 368, 700) for _ in range(4)]
    alone = np.concatenate([logits([t]) for t in texts])
    for order in (np.arange(len(texts)), np.arange(len(texts))[::-1], rng.permutation(len(texts))):
        np.testing.assert_allclose(logits([texts[i] for i in order]), alone[order], rtol=1e-4, atol=1e-4)


# ---- operator 6


def test_packing(spark, docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    rows = packing.pack(docs, capacity=64).collect()
    ids = {10 * i + 3: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    sequences = {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and len(part) == r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(len(x) for x in ids.values()) + len(ids[83])
    assert sum(r["length"] for r in rows) == total
    assert len(sequences) <= -(-total // 64) + 2
    for d, x in ids.items():
        got = sorted({(r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == d})
        assert sum(n for _, _, n in got) == len(x) and [p for p, _, _ in got] == list(range(len(got)))
        assert all(n == 64 for p, _, n in got if p) and (len(got) == 1) == (len(x) <= 64)
    assert packing.pack(empty(spark)).count() == 0


def test_packing_of_null_and_repeated_ids_and_clashing_columns(spark):
    rows = [(None, "a b"), (None, "a b"), (7, None), (7, "x " * 300), (7, "x " * 300)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as length", "2 as salt", "3 as rank", "4 as piece")
    out = packing.pack(docs, capacity=50)
    assert dict(out.dtypes)["piece"] == "int"
    got = out.collect()
    assert Counter(r["doc_id"] for r in got if r["start"] == 0) == Counter([None, None, 7, 7, 7])
    held = packing.pack(docs, capacity=50, ids=True).collect()
    assert Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in held) == Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in got)
    assert all(len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in held)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in places.values():
        ends = [0, *np.cumsum([n for _, n in sorted(s)])]
        assert [o for o, _ in sorted(s)] == ends[:-1] and ends[-1] <= 50


# ---- operator 7


def brute_fingerprint(text, n=3):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_simhash_fingerprints(spark, docs, texts):
    got = by_id(simhash.fingerprint_table(docs))
    for i, t in enumerate(texts):
        assert got[10 * i + 3]["fp"] % 2**64 == brute_fingerprint(t), t


@pytest.mark.parametrize("radius, hot", [(2, 16384), (2, 12), (6, 16384)])
def test_covering_links_equal_brute_force(spark, radius, hot):
    rng = np.random.default_rng(radius + hot)
    f = set()
    for b in rng.integers(0, 1 << 62, 30):
        for _ in range(rng.integers(1, 40)):
            f.add(int(b) ^ sum(1 << int(j) for j in {int(j) for j in rng.integers(0, 64, rng.integers(0, 5))}))
    f = np.array(sorted(f), np.uint64)
    label = list(range(len(f)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= radius):
            a, b = find(i), find(i + 1 + int(j))
            label[max(a, b)] = min(a, b)
    nodes = spark.createDataFrame([(i, int(x)) for i, x in enumerate(f.view(np.int64))], "node long, fp long")
    found = {r["node"]: r["component"] for r in simhash.components(simhash.links(nodes, radius, hot)).collect()}
    assert [found.get(i, i) for i in range(len(f))] == [find(i) for i in range(len(f))]


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(9)
    base = [[f"w{i}" for i in rng.integers(0, 3000, 300)] for _ in range(20)]
    rows = []
    for i, b in enumerate(base):
        rows.append((100 * i, " ".join(b)))
        for j in (1, 2):
            copy = list(b)
            for at in rng.integers(0, 300, j):
                copy[at] = "changed"
            rows.append((100 * i + j, " ".join(copy)))
        half = b[:150] + [f"v{x}" for x in rng.integers(0, 3000, 150)]
        rows.append((100 * i + 50, " ".join(half)))
    rows += [(None, "no id"), (7000, ""), (7001, None), (7000, "")]
    out = simhash.keep_first(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as component_id", "2 as wide"))
    assert out.columns == ["doc_id", "text", "component_id", "wide"]
    kept = Counter(r["doc_id"] for r in out.collect())
    assert all(kept[100 * i] == 1 and kept[100 * i + 50] == 1 for i in range(20))
    assert sum(kept[100 * i + j] for i in range(20) for j in (1, 2)) <= 1
    assert kept[None] == 1 and kept[7000] == 1 and kept[7001] == 0


def test_rows_of_one_id_are_kept_by_their_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (9, b + " more"), (7, c), (7, c), (7, c.upper()), (None, a)]
    kept = Counter((r["doc_id"], r["text"].lower()) for r in simhash.keep_first(spark.createDataFrame(rows, SCHEMA)).collect())
    assert kept == Counter([(3, a), (5, b), (7, c), (None, a)])
    other = [(5, a), (5, b), (9, b)]  # one id is the first of two groups
    assert Counter((r["doc_id"], r["text"]) for r in simhash.keep_first(spark.createDataFrame(other, SCHEMA)).collect()) == Counter([(5, a), (5, b)])


def _jaccard_pairs(texts, n=5, least=0.8):
    """All pairs of different word sets with a likeness of ``least`` in distinct n-word shingles, by an inverted index."""
    sets = [{tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (words(t.lower()) for t in texts)]
    rows, shared = {}, Counter()
    for i, x in enumerate(sets):
        for g in x:
            rows.setdefault(g, []).append(i)
    # a set's rarest shingles: of so many as two like sets cannot both lack, one is shared
    for i, x in enumerate(sets):
        rare = sorted(x, key=lambda g: (len(rows[g]), g))[: len(x) - math.ceil(least * len(x)) + 1]
        for j in {j for g in rare for j in rows[g] if j < i}:
            shared[(j, i)] = len(x & sets[j])
    return [(a, b) for (a, b), c in shared.items() if c >= least * (len(sets[a]) + len(sets[b]) - c) and sets[a] != sets[b]]


def test_similar_groups_find_pairs_of_the_stated_similarity(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").filter("text is not null").collect()
    one_each = list({" ".join(words(r["text"].lower())): r for r in rows}.values())
    pairs = _jaccard_pairs([r["text"] for r in one_each])
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    linked = sum(found[one_each[a]["doc_id"]] == found[one_each[b]["doc_id"]] for a, b in pairs)
    assert len(pairs) > 20 and linked >= 0.9 * len(pairs)


def test_simhash_of_null_and_repeated_ids(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (3, "x y z"), (None, "only here"), (9, None), (8, "")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as fp", "'x' as component_id")
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == Counter([(None, 5), (5, 5), (5, 5), (3, 3), (None, None), (9, 8), (8, 8)])
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.keep_first(empty(spark)).count() == 0


# ---- operator 10


def _removed(rows, n):
    """For each row the words that stay: those outside windows that a row of a smaller id has; null ids come last."""
    key = lambda d: float("inf") if d is None else d
    first = {}
    for d, t in rows:
        w = words(t)
        for j in range(len(w) - n + 1):
            first[tuple(w[j : j + n])] = min(key(d), first.get(tuple(w[j : j + n]), float("inf")))
    out = []
    for d, t in rows:
        w = words(t)
        gone = {j + x for j in range(len(w) - n + 1) if first[tuple(w[j : j + n])] < key(d) for x in range(n)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1024, 1])
@pytest.mark.parametrize("n", [13, 4])
def test_substring_dedup(spark, texts, hot, n, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 2000)
    rng = np.random.default_rng(8)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(10 * i + 3, t) for i, t in enumerate(texts)]
    rows += [(1000 + i, " ".join(f"w{x}" for x in rng.integers(0, 3, 60))) for i in range(20)]  # few words: many ties of hashes
    rows += [(2000 + i, f"a{i} {passage} b{i} c{i} {passage[:-4]}") for i in range(40)]
    rows += [(None, passage), (None, passage + " end"), (2005, "again " + passage), rows[8], rows[8], (7, "x" * 5000 + " " + passage)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [tuple(r) for r in substring_dedup.repeat_digests(docs.selectExpr("*", "1 as key", "'y' as chunk"), n, hot).collect()]
    assert Counter(got) == Counter(_removed(rows, n))
    whole = {}
    for d, _, gone, sha in got:
        whole.setdefault(d, []).append((sha, gone))
    cut = substring_dedup.cut_repeats(docs.selectExpr("*", "length(text) as n_chars", "1 as told"), n, hot).collect()
    assert len(cut) == len(rows)
    for r in cut:
        assert hashlib.sha256(" ".join(words(r["text"])).encode()).hexdigest() in {sha for sha, _ in whole[r["doc_id"]]}
        assert r["told"] == 1 and (r["n_chars"] in (None, len(r["text"])))
    spans = Counter()
    for r in substring_dedup.repeat_spans(docs, n, hot).collect():
        spans[r["doc_id"]] += r["n_words"]
    assert spans == Counter({d: x for d, x in ((d, sum(g for _, g in v)) for d, v in whole.items()) if x})
    assert substring_dedup.repeat_digests(empty(spark)).count() == 0


def test_deep_windows_equal_brute_force():
    rng, n, short = np.random.default_rng(4), 6, 2
    for _ in range(30):
        rows = []
        for _ in range(60):
            left = int(rng.integers(0, n - short + 1))
            right = int(rng.integers(max(short, n - left), n + 1))
            rows.append((left, rng.integers(1, 3, left + right).astype(np.uint64), int(rng.integers(0, 20))))
        h, off = np.concatenate([w for _, w, _ in rows]), np.concatenate(([0], np.cumsum([len(w) for _, w, _ in rows])))
        got = substring_dedup.deep_windows(h, off, np.array([x for x, _, _ in rows]), np.array([d for _, _, d in rows]), n, short)
        window = lambda left, w, l: tuple(w[left - l : left - l + n]) if l <= left and len(w) - left >= n - l else None  # noqa: E731, E741
        for l in range(n - short + 1):  # noqa: E741
            least = {}
            for left, w, d in rows:
                least[window(left, w, l)] = min(d, least.get(window(left, w, l), d))
            want = [window(left, w, l) is not None and least[window(left, w, l)] < d for left, w, d in rows]
            assert [bool(m >> l & 1) for m in got.tolist()] == want


def test_maximal_repeats_join_in_the_document(spark):
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(1, f"a b c {shared} d e"), (2, f"x {shared} y z"), (3, " ".join(shared.split()[5:25]) + " tail")]
    got = {(r["doc_id"], r["first_word"], r["n_words"]) for r in substring_dedup.repeat_spans(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(2, 1, 40), (3, 0, 20)}
