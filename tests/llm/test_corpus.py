"""Models, joins and encoders next to brute force, exact round trips and held-out accuracy."""
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sheenwake.llm import bloom_lm, common, decontaminate, ngram_join, quality, sentencepiece_fst, severity, token_files

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "  \n "), (4, "one"), (5, "one two three"), (None, "no id here at all"), (6, "same text here now ok"),
       (6, "same text here now ok"), (7, "Same text here now ok"), (8, "é" * 3000 + " x"), (9, "tab\tand\x1cctrl\x85 end▁ 　")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x") for r in ODD], "doc_id long, text string, label string")


def test_components(spark):
    random.seed(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 200)] + [(300, k) for k in range(301, 330)]
    random.shuffle(edges)
    got = {r["node"]: r["root"] for r in common.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == 100 and 200 not in got and got[329] == 300
    assert common.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_banding():
    bands, rows = ngram_join.plan_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999
    with pytest.raises(ValueError):
        ngram_join.plan_bands(0.05, 0.9999, 10)


def plain_groups(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        if i is not None and w:
            k = min(5, len(w))
            sets.setdefault(frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)), []).append(i)
    keys = list(sets)
    links, root = {k: set() for k in range(len(keys))}, list(range(len(keys)))

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(range(len(keys)), 2):
        both = len(keys[a] & keys[b])
        if both and both >= 0.8 * len(keys[a] | keys[b]) - 1e-9:
            links[a].add(b), links[b].add(a)
            root[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for k in range(len(keys)):
        least[top(k)] = min(least.get(top(k), math.inf), *sets[keys[k]])
    return Counter((i, least[top(k)], len(links[k]), len(sets[keys[k]])) for k in range(len(keys)) for i in sets[keys[k]])


def test_near_copies(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    random.seed(5)
    words = [f"w{i}" for i in range(500)]
    rows = list(ODD)
    for g in range(6):
        base = random.choices(words, k=120)
        for c in range(40 if g == 0 else 4):
            t = list(base)
            for _ in range(random.choice((0, 1, 2, 3, 4))):
                t[random.randrange(120)] = f"z{random.random()}"
            rows.append((1000 + 50 * g + c, " ".join(t)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.jaccard_groups(d).collect()
    assert len(got) == len(rows)
    want = plain_groups(rows)
    have = Counter(tuple(r) for r in got if r["n_links"] is not None and not (r["n_copies"] == 1 and r["doc_id"] in (1, 2, 3)))
    assert have == want
    by = {r["doc_id"]: r for r in got}
    assert by[1]["class_id"] == 1 and by[2]["n_links"] == 0 and by[None]["class_id"] is None
    assert ngram_join.jaccard_groups(d.limit(0)).count() == 0


def test_retrieval_is_exhaustive():
    random.seed(11)
    words = [f"t{i}".encode() for i in range(300)]
    items = [(k, b" ".join(random.choices(words, weights=[1 / (i + 1) for i in range(300)], k=random.randint(4, 60)))) for k in range(250)]
    frequency = Counter(w for _, t in items for w in set(t.split()))
    index = decontaminate.Index(items, len(items), sum(len(t.split()) for _, t in items) / len(items), frequency)
    for _ in range(60):
        text = random.choices(words, k=80) + random.choice(items)[1].split()
        numbers = np.array([index.numbers.get(w, -1) for w in text])
        query = np.unique(numbers[numbers >= 0])
        want = {}
        for n in query.tolist():
            for i, w in zip(index.lists[n].items, index.lists[n].weights):
                want[i] = want.get(i, 0) + w
        want = {i: s for i, s in want.items() if s >= index.threshold - 1e-9}
        got = dict(index.retrieve(query.tolist()))
        assert got.keys() == want.keys() and all(math.isclose(got[i], want[i]) for i in got)
        seen = {i for i, *_ in index.search(numbers, 0.0)}
        for s, e in index.windows(len(numbers)):
            q = {n for n in numbers[s:e].tolist() if n >= 0}
            full = {}
            for n in q:
                for i, w in zip(index.lists[n].items, index.lists[n].weights):
                    full[i] = full.get(i, 0) + w
            assert {index.ids[i] for i, x in full.items() if x >= index.threshold} <= seen


def test_decontamination(spark, odd, docs):
    bench = spark.createDataFrame([(1, "What is the capital of France? It is the old city of Paris on the river Seine.", 0), (2, None, 0),
                                   (3, "one two", 0), (None, "seven green bottles were standing on a very long wall today", 0)],
                                  "item_id long, text string, doc_id int")
    extra = spark.createDataFrame([(50, "Intro words. WHAT is the capital of France?? it is the old city of paris on the river seine, and on", "x"),
                                   (51, "What is the capital of France? Nobody knows that any more these days.", "x"),
                                   (52, "filler " * 5000 + "seven green bottles were standing on a very long wall today", "x")], odd.schema)
    for chars in (8_000_000, 60):
        got = decontaminate.contaminated(odd.union(extra), bench, shard_chars=chars).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in got if r["item_id"]) == [(5, 3), (50, 1)]
        assert [r["doc_id"] for r in got if r["item_id"] is None] == [52]
    assert decontaminate.contaminated(odd.limit(0), bench).count() == 0
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == 0
    real = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r[0]: decontaminate.terms(r[1].encode()) for r in real.collect()}
    want = set()
    for r in docs.collect():
        w = b" ".join(decontaminate.terms((r["text"] or "").encode()))
        want |= {(r["doc_id"], i) for i, t in items.items() if b" " + b" ".join(t) + b" " in b" " + w + b" "}
    assert want <= {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, real).collect()}


def test_short_items_are_found_in_sequence(spark):
    bench = spark.createDataFrame([("sum", "2 + 2? four"), ("yes", "Yes."), ("no words", "?!"), ("long", "which of the two roads goes down to the sea? the left one")],
                                  "item_id string, text string")
    texts = ["they say 2 + 2 (four) and so on", "2 or 2 or four", "yes", "oh YES, of course", "yesterday", "which of the two roads goes down to the sea? the left one, yes"]
    docs = spark.createDataFrame([(float(k), t) for k, t in enumerate(texts)], "doc_id double, text string")
    got = {(r["doc_id"], r["item_id"], round(r["score"], 6)) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(0, "sum", 1), (2, "yes", 1), (3, "yes", 1), (5, "yes", 1), (5, "long", 1)}
    few = decontaminate.contaminated(docs, bench.where("item_id <> 'long'")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in few} == {x[:2] for x in got if x[1] != "long"}


def test_quality_statistics_cover_all_rows(spark):
    """Mean, deviation and the prior's counts do not change with the bound on gradient rows."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("etaoinshr") for _ in range(n))
    rows = []
    for k in range(3000):
        good = rng.random() < .4
        text = " ".join(word(rng.randrange(2, 8)) for _ in range(60)) + "." if good else "$$ " + "#".join(word(3) for _ in range(rng.randrange(2, 30)))
        rows.append((k, text, good))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k, _, good in rows if good and k % 2], "doc_id long, quality int")
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    x = np.array([quality.features(t.encode()) for _, t, _ in train])
    for bound in (400, 10_000):
        model = quality.fit(docs, labels, max_rows=bound)
        assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, x.std(0) + 1e-3)
        assert abs(model.prior - .4) < .12


def check_model(docs, rows):
    counts = Counter(w for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1
                     for w in [*(t or "").encode().lower().split(), b"\n"])
    n, v = sum(counts.values()), len(counts)
    model = bloom_lm.train(docs.where(~bloom_lm.held_out()))
    assert (model.tokens, model.words) == (n, v)
    got = bloom_lm.score(docs, model).collect()
    assert len(got) == len(rows)
    want = Counter()
    for _, t in rows:
        w = [*(t or "").encode().lower().split(), b"\n"]
        want[len(w), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)] += 1
    assert Counter((r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
    return model, got


def test_language_model(docs, odd, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model, got = check_model(docs, rows)
    new = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1]
    assert sum(r["lm_score"] for r in new) > sum(r["base_score"] for r in new) and all(r["lm_score"] <= 0 for r in got)
    monkeypatch.setattr(bloom_lm, "WAVE_BYTES", 60_000)
    waves, again = check_model(docs, rows)
    assert len(waves.waves) > 1
    assert sorted(round(r["lm_score"], 6) for r in again) == sorted(round(r["lm_score"], 6) for r in got)
    check_model(odd, ODD)
    assert bloom_lm.score(odd, bloom_lm.train(odd.limit(0))).count() == len(ODD)


def test_language_model_next_to_plain_bigrams(docs):
    """The score by exact counts, quantised alike; the filter may only add what its false hits add."""
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split() + [b"\n"]) for r in docs.collect()]
    train = [w for i, w in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    one, two = Counter(x for w in train for x in w), Counter(p for w in train for p in zip([b" ", *w], w))
    found, model = bloom_lm.train_and_score(docs, ~bloom_lm.held_out())
    assert model.weight > 0
    meant = lambda c: bloom_lm.MEANT[bloom_lm.levels(np.array([c]))[0]] if c else 0.0
    n, v = sum(one.values()), len(one)
    plain = {}
    for i, w in rows:
        total = 0.0
        for a, b in zip([b" ", *w], w):
            front = max(len(train), 1) if a == b" " else meant(one[a])
            rate = min(meant(two[a, b]) / front, 1.0) if front else 0.0
            total += math.log10((1 - model.weight) * (meant(one[b]) + 0.5) / (n + 0.5 * (v + 1)) + model.weight * rate)
        plain[i] = total
    got = {r["doc_id"]: r["lm_score"] for r in found.collect()}
    assert got.keys() == plain.keys()
    off = np.array([abs(got[i] - plain[i]) / max(1.0, abs(plain[i])) for i in plain])
    assert off.max() < 0.02 and np.median(off) < 2e-3


def test_weight_rests_on_all_training_texts(spark, docs, monkeypatch):
    import xxhash

    # 400 texts of the lowest hashes, each of words of its own, and 800 others of one sentence said over and over
    texts = sorted((f"a{k} b{k} c{k}" for k in range(3000)), key=lambda t: xxhash.xxh64_intdigest(t.encode(), 42) ^ 1 << 63)[:400]
    last = int(xxhash.xxh64_intdigest(texts[-1].encode(), 42) ^ 1 << 63)
    said = [t for k in range(8000) if xxhash.xxh64_intdigest((t := f"it was a long road to the sea and back n{k}").encode(), 42) ^ 1 << 63 > last][:800]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts + said)], "doc_id long, text string")
    model = bloom_lm.train(d)
    shape = (model.tokens, model.words, model.texts)

    def finish(sizes, known, base, level, front, pair):
        first = np.cumsum(sizes) - sizes
        return [[float(bloom_lm._sums(bloom_lm._logs(level, front, pair, first, shape, w, 1.0), sizes)[k]) for w in bloom_lm.WEIGHTS]
                for k in range(len(sizes))]

    sums = np.sum([r["_lm"] for r in model.look_up(d, "text", finish, "array<double>").collect()], axis=0)
    assert model.weight == bloom_lm.WEIGHTS[int(np.argmax(sums))] > 0.5
    for size in (bloom_lm.WAVE_BYTES, 60_000):
        monkeypatch.setattr(bloom_lm, "WAVE_BYTES", size)
        own, again = bloom_lm.train_and_score(docs, ~bloom_lm.held_out())
        other = bloom_lm.train(docs.where(~bloom_lm.held_out()))
        assert again.weight == other.weight > 0
        plain = {r["doc_id"]: r for r in bloom_lm.score(docs, other).collect()}
        got = own.collect()
        assert len(got) == len(plain)
        for r in got:
            assert all(math.isclose(r[c], plain[r["doc_id"]][c], rel_tol=1e-12) for c in ("n_tokens", "n_known", "base_score", "lm_score"))


def test_word_cache_is_emptied_whole(monkeypatch):
    import xxhash

    texts = [" ".join(f"w{k}" for k in range(a, b)).encode() for a, b in ((0, 40), (100, 140), (20, 110), (300, 310), (0, 140))]
    hashes = np.array(sorted(xxhash.xxh64_intdigest(f"w{k}".encode()) for k in range(0, 140, 3)), np.uint64)
    counts = np.arange(1, len(hashes) + 1, dtype=np.int64)
    size, bits = bloom_lm.fill(hashes, counts)
    packed = bloom_lm.Wave.pack([(0, size, bits, hashes.tobytes(), counts.tobytes())])
    room = float(counts.sum())
    want = [bloom_lm.Wave(packed, 1, room, (0, 1)).look_up([t]) for t in texts]
    monkeypatch.setattr(bloom_lm, "KEPT_WORDS", 5)
    wave = bloom_lm.Wave(packed, 1, room, (0, 1))
    for t, w in zip(texts, want):
        assert all((a == b).all() for a, b in zip(wave.look_up([t]), w))


def test_bloom_levels():
    keys = common.mix(np.arange(20_000, dtype=np.uint64) * np.uint64(2654435761))
    counts = np.random.default_rng(1).geometric(0.3, 20_000) ** 3
    size, bits = bloom_lm.fill(keys, counts)
    table = bloom_lm.Filter(np.array([0]), np.array([size], np.uint64), np.array([0]), bits, 1)
    want, got = bloom_lm.levels(counts), table.levels(keys)
    for some in (keys, keys[::-1], np.r_[keys, keys, np.uint64(0)]):
        assert (table.remembered(some) == table.levels(some)).all()
    assert (got >= want).all() and (got == want).mean() > 0.98
    assert (table.levels(common.mix(np.arange(10**6, 10**6 + 50_000, dtype=np.uint64))) > 0).mean() < 0.01


def test_quality(spark, docs, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    sf = SF.replace("0.001", "0.01")
    big, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(big, known)
    rows = quality.score(big, model).where(common.remainder("doc_id", 4) == 2).join(known, "doc_id").select("quality", "quality_score").collect()
    assert np.mean([(r["quality_score"] >= quality.ACCEPT) == (r["quality"] == 1) for r in rows]) > 0.95
    share = np.mean([r["quality"] for r in rows])
    assert abs(model.prior - share) < 0.12
    got = quality.score(odd, model, out="label").collect()
    assert len(got) == len(ODD) and all(0 <= r["label"] <= 1 for r in got)
    assert quality.score(odd, quality.fit(odd.limit(0), labels.limit(0))).count() == len(ODD)


def test_quality_by_synthetic_mixture():
    r = np.random.default_rng(4)
    n = quality.N_FEATURES
    good, bad = r.normal(0, 1, (6000, n)), r.normal(0, 1, (6000, n)) + np.r_[np.full(4, 2.5), np.zeros(n - 4)]
    unl = np.vstack([good[3000:5100], bad[:900]])
    r.shuffle(unl)
    model = quality.fit_arrays(good[:3000], unl)
    assert abs(model.prior - 0.7) < 0.08
    assert (model.score(good[5100:]) >= 0.5).mean() > 0.95 and (model.score(bad[900:]) < 0.5).mean() > 0.9


def test_severity(spark, odd):
    sf = SF.replace("0.001", "0.1")
    big, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = severity.fit(big, known)
    assert (np.diff(model.thresholds) > 0).all()
    rows = severity.score(big, model).where(common.remainder("doc_id", 4) == 2).join(known, "doc_id").collect()
    flag = np.array([r["toxic_probability"] >= 0.5 for r in rows])
    truth = np.array([r["toxic"] == 1 for r in rows])
    assert (flag == truth).mean() > 0.97 and flag[~truth].mean() < 0.01
    got = severity.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["expected_severity"] <= 3 for r in got)
    none = severity.fit(odd.limit(0), known.limit(0))
    assert severity.score(odd, none).where("expected_severity > 0.1").count() == 0


def test_severity_order():
    texts = [Counter([b"x"] + [b"bad"] * k) for k in (0, 1, 2, 3, 5)] * 60
    model = severity.fit_rows(texts, [c[b"bad"] > 0 for c in texts])
    p = model.probabilities([Counter({b"bad": k}) if k else Counter() for k in range(6)])
    assert np.allclose(p.sum(1), 1) and (np.diff(p @ np.arange(4)) > 0).all()


def test_pieces_equal_the_library(docs):
    import sentencepiece

    own, theirs = sentencepiece_fst.Pieces(), sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.model_file())
    texts = [r["text"] or "" for r in docs.collect()] + [t or "" for _, t in ODD]
    texts += ["", " ", "  a  b ", "x" * 900, "\n\n", "a@b.c#d 12345 ÀÉ \U0001d11e", "aaaaaaaaaaaa bbbb"]
    for t, ids in zip(texts, own.encode([t.encode() for t in texts])):
        ids = np.frombuffer(ids, np.int32).tolist()
        assert ids == theirs.encode(t)
        assert own.decode(ids) == t.replace("▁", " ")


def test_unigram_shortest_path():
    own = sentencepiece_fst.Pieces()
    own.bpe = False
    r = np.random.default_rng(0)
    own.score = -r.random(len(own.texts)) * 5
    for t in ("▁hello", "▁there", "▁xyzzy", "▁internation"):
        path = own.solve([t])[0]
        best = {0: 0.0}
        for e in range(1, len(t) + 1):
            best[e] = min((best[s] - own.score[own.ids[t[s:e]]] for s in range(e) if s in best and t[s:e] in own.ids), default=math.inf)
        assert math.isclose(-sum(own.score[path]), best[len(t)]) and "".join(own.texts[p] for p in path) == t


def test_encode_frames(odd):
    got = sentencepiece_fst.decode(sentencepiece_fst.encode(odd, out="label"), "label").collect()
    assert len(got) == len(ODD)
    assert all(r["decoded"] == (r["text"] or "").replace("▁", " ") for r in got)
    assert sentencepiece_fst.encode(odd.limit(0)).count() == 0


def test_token_encoder(docs, monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_files.vocabulary())
    own = token_files.Encoder(token_files.vocabulary())
    odd = ["a  b", " a", "a ", "a\n\nb", "a \nb", "x\n y", "it's\tfine <|endoftext|> ok", "x <|endoftext|>y", "é\xa0 ü", "\n", " ",
           "a\x1c b", "", "\nab cd\nab", "ab\n", "x" * 1_000_000 + " y", "\x02a \x02b\u3000c", "日本語 のテキスト"]
    texts = odd + [r["text"] or "" for r in docs.select("text").collect()]

    def check(some):
        flat, sizes = own.encode(pa.array(some))
        want = [[*tok.encode(t, add_special_tokens=False).ids, 0] for t in some]
        assert sizes.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]

    for t in odd:
        for _ in range(2):
            check([t])
    check(texts)
    monkeypatch.setattr(token_files, "KEPT_WORDS", 50)
    for k in range(0, len(texts), 7):
        check(texts[k:k + 7])


def test_token_files_of_other_ids(spark, tmp_path):
    rows = [("b", "one two", "x"), ("a", None, "x"), (None, "three", "x"), ("b", "one two", "x")]
    for kind in ("string", "decimal(20,2)", "smallint"):
        frame = spark.createDataFrame(rows, "doc_id string, text string, start string").selectExpr(
            "doc_id" if kind == "string" else f"cast(case doc_id when 'a' then 1 when 'b' then 2 end as {kind}) as doc_id", "text", "start")
        folder = f"{tmp_path}/{kind[:5]}"
        files = token_files.write_token_files(frame, folder)
        got = token_files.read_documents(files, folder, dict(frame.dtypes)["doc_id"]).orderBy("start").collect()
        assert [r["n_tokens"] for r in got] == [2, 1, 3, 3] and got[0]["doc_id"] is None and got[2]["doc_id"] == got[3]["doc_id"]
        assert [r["start"] for r in got] == [0, 2, 3, 6]


def test_token_files(spark, docs, odd, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_files.vocabulary())
    for name, frame in (("docs", docs.select("doc_id", "text")), ("odd", odd.where("doc_id <> 6").select("doc_id", "text"))):
        folder = f"{tmp_path}/{name}"
        files = token_files.write_token_files(frame, folder, length=32, rows=4, chars_a_file=40_000)
        got = {r["doc_id"]: r for r in token_files.read_documents(files, folder).collect()}
        start = 0
        rows = sorted(frame.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
        assert len(got) == len(rows)
        for r in rows:
            ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
            g = got[r["doc_id"]]
            assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)
    one = token_files.TokenFile(f"{tmp_path}/docs", 0)
    ids, mask = one.row(1)
    assert ids.shape == (32,) and all(mask.to_pylist()) and not ids.flags.owndata
    assert (one.span(32, 32) == ids).all()
    empty = token_files.write_token_files(docs.limit(0), f"{tmp_path}/none")
    assert token_files.read_documents(empty, f"{tmp_path}/none").count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    folder = f"{tmp_path}/in"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.limit(1)
    docs.union(first).union(first.selectExpr("cast(null as bigint)", "text", "lang", "source", "n_chars")).write.parquet(f"{folder}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, now, folder).cache()
        seen.append((now, after))
        now = after
    for before, after in seen[:-1]:
        assert after.columns == docs.columns and 0 < after.count() <= before.count()
    kept = seen[1][1].where("doc_id is not null").collect()
    assert len({r["doc_id"] for r in kept}) == len(kept)
    groups = plain_groups([(r["doc_id"], r["text"]) for r in seen[1][0].collect()])
    assert {r["doc_id"] for r in kept if (r["text"] or "").split()} == {c for _, c, *_ in groups}
    assert "piece_ids" in now.columns and now.where("piece_ids is null").count() == 0
    assert corpus_pipeline.run(spark, folder).count() == now.count()
    none = docs.limit(0)
    assert all(stage(spark, none, folder).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_pipeline_rows_without_own_id(spark, tmp_path):
    import corpus_pipeline

    random.seed(8)
    a, b, c, d, item = (" ".join(random.choices([f"w{i}" for i in range(400)], k=60)) for _ in range(5))
    rows = [(1, a), (None, a), (None, a + " end"), (None, b), (None, b), (None, b + " end"), (7, c), (7, a), (7, c), (None, d),
            (8, "intro " + item + " end"), (8, d + " " + c), (None, "other " + item), (None, ""), (None, ""), (None, None), (9, ""), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    once = corpus_pipeline.keep_one_of_each_group(spark, docs, "")
    assert once.columns == docs.columns
    got = Counter(map(tuple, once.collect()))
    kept_b = [r for r in got if r[0] is None and (r[1] or "").startswith(b)]
    assert len(kept_b) == 1 and got.pop(kept_b[0]) == 1
    # both texts with the item are copies but for their first and last words
    assert got == Counter([(1, a), (7, c), (None, d), (8, rows[10][1]), (8, rows[11][1]), (None, ""), (None, ""), (None, None), (9, "")])
    folder = f"{tmp_path}/in"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    clean = corpus_pipeline.drop_test_items(spark, docs, folder)
    assert Counter(map(tuple, clean.collect())) == Counter(r for r in rows if item not in (r[1] or ""))


def test_whole_queries(spark):
    import __spark_entry__ as entry

    size = lambda t: spark.read.parquet(f"{SF}/{t}.parquet").count()
    n, seen = size("documents"), 0
    for name, q in entry.queries().items():
        if not (name.startswith("op") and name[2].isdigit()) or name.startswith("op2_"):
            continue
        seen += 1
        if name.startswith("op11_"):  # a row per node; every conversation is a member of the root
            found = q(spark, SF).collect()
            convs = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
            assert [r["n_convs"] for r in found if r["depth"] == 0] == [convs]
        else:
            assert q(spark, SF).count() == (32 * size("embeddings") if name.startswith("op12_") else n), name
    assert seen == 12
