"""Operators against brute force, SQL and held-out labels; every edge case has a defined result."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from oracle import SF_DIR, available, compare
from pyspark.sql import functions as F

from meterline.llm import exact_dedup, kneser_ney, language_id, mixing, near_copies, packing, preference, quality_rules, queries, simhash, substring_dedup, toxicity, url_filter
from meterline.llm.components import components

needs_tables = pytest.mark.skipif(not available(), reason="driver tables are absent")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, hits int"
LONG = " ".join(f"w{k % 977}" for k in range(30_000))
#: nulls anywhere, empty and blank and very long texts, repeated rows, equal ids, columns with clashing names
EDGES = [
    (1, "a b c d e f", "en", "s", 1, "x", 1), (1, "a b c d e f", "en", "s", 1, "x", 1), (2, "a b c d e f", None, "s", 1, "x", 1), (None, None, None, None, None, None, None), (None, "a b c d e f", "en", None, 1, "x", 1),
    (3, "", "en", "t", 0, "x", 1), (4, None, "en", "t", None, "x", 1), (5, " \n\t ", "en", "t", 3, "x", 1), (6, LONG, "en", "u", 1, "x", 1), (6, LONG + " tail", "en", "u", 1, "x", 1), (7, LONG + " more", "fr", "u", 1, "x", 1), (8, "é ü ß", "fr", "t", 1, "x", 1), (9, "12 34", "fr", "t", 1, "x", 1),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def rows(df):
    return [tuple(r) for r in df.collect()]


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.SQL[name])


# --- quality rules


def brute_quality(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 500 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in twice for j in range(i, i + 8)}
    return len(words), len(covered)


def test_quality_edges(edges, nothing):
    found = quality_rules.ledger(edges).select("n_words", "n_repeat_words").collect()
    assert sorted(map(tuple, found)) == sorted(brute_quality(e[1]) for e in EDGES)
    assert quality_rules.apply_policy(quality_rules.ledger(nothing), quality_rules.BASE).count() == 0
    assert quality_rules.passed(edges).columns == edges.columns


def test_ablations_count_bits(spark):
    ledger = spark.createDataFrame([(1,), (1,), (3,), (0,), (4,)], "failed_bits long")
    got = {r["rule"]: (r["n_failed"], r["n_recovered"]) for r in quality_rules.ablations(ledger, quality_rules.BASE).collect()}
    assert got == {"too_few_words": (3, 2), "repeated_windows": (1, 0)}


# --- language ID


@needs_tables
def test_language_held_out(spark):
    got = queries.op2_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.98
    assert got["score"].between(0, 1).all()


def test_language_edges(spark, edges, nothing):
    learned = spark.createDataFrame([(k, text, lang) for k in range(60) for text, lang in (("the cat sat on the mat and the hat", "en"), ("der Hund und die Katze über den Fluß", "de"))], "doc_id long, text string, lang string")
    model = language_id.fit(learned.withColumn("doc_id", F.col("doc_id") * 2 + (F.col("lang") == "de").cast("int")))
    got = language_id.identify(edges, model).collect()
    assert len(got) == len(EDGES)
    for text, r in sorted(((e[1] or "", r) for e, r in zip(EDGES, got, strict=True)), key=lambda x: x[0]):
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, text))) and 0 <= r["score"] <= 1
    assert language_id.identify(nothing, model).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(edges, language_id.fit(nothing)).collect()} == {"und"}


def plain_kneser_ney(texts, order):
    """P(symbol | context) by the recursion over dictionaries of n-grams."""
    grams = __import__("collections").Counter()
    for t in texts:
        padded = [kneser_ney.START] * (order - 1) + kneser_ney.encode(t).tolist()
        grams.update(tuple(padded[i : i + order]) for i in range(len(padded) - order + 1))
    levels = {order: dict(grams)}
    for n in range(order - 1, 0, -1):
        levels[n] = dict(__import__("collections").Counter(g[1:] for g in levels[n + 1]))

    def p(gram):
        n = len(gram)
        if not n:
            return 2.0**-16
        counts = levels[n]
        n1, n2 = (sum(c == k for c in counts.values()) for k in (1, 2))
        d = min(max(n1 / (n1 + 2 * n2), 0.1), 0.9) if n1 else 0.5
        same = [c for g, c in counts.items() if g[:-1] == gram[:-1]]
        if not same:
            return p(gram[1:])
        return max(counts.get(gram, 0) - d, 0) / sum(same) + d * len(same) / sum(same) * p(gram[1:])

    return grams, p


def kn_model(texts, order):
    codes, n = np.unique(kneser_ney.ngrams([kneser_ney.encode(t) for t in texts], order)[0], return_counts=True)
    return kneser_ney.KneserNey({"x": (codes, n)}, order), codes


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_kneser_ney_equals_plain_recursion(order):
    texts = ["abracadabra alakazam", "banana bandana", "Ça va\U00010400\U00010400 漢字"]
    model, codes = kn_model(texts, order)
    grams, p = plain_kneser_ney(texts, order)
    unseen = [tuple(g[:-1]) + (ord("q"),) for g in list(grams)[:5]] + [(ord("z"),) * order]
    asked = [*grams, *unseen]
    packed = np.array([sum(int(x) << 16 * (order - 1 - k) for k, x in enumerate(g)) for g in asked], np.uint64)
    assert np.allclose(np.exp(model.log_p(packed)[:, 0]), [p(g) for g in asked], rtol=1e-4)
    entropy, lengths = model.cross_entropy(["banana", "", "zq ban"])
    symbols = [kneser_ney.START] * (order - 1) + kneser_ney.encode("zq ban").tolist()
    expected = -np.mean([np.log(p(tuple(symbols[i : i + order]))) for i in range(len(symbols) - order + 1)])
    assert lengths.tolist() == [6, 0, 6] and abs(entropy[2, 0] - expected) < 1e-3


def test_kneser_ney_sums_to_one():
    model, codes = kn_model(["abracadabra alakazam", "banana bandana"], 3)
    for context in (int(codes[0]) >> 16, int(codes[5]) >> 16, 0xFEFEFEFE):
        every = np.uint64(context << 16) | np.arange(1 << 16, dtype=np.uint64)
        assert abs(np.exp(model.log_p(every)[:, 0].astype(np.float64)).sum() - 1) < 1e-3


def test_letters_of_large_scripts_stay_apart():
    han = "".join(chr(0x4E00 + k) for k in range(3000))
    assert len(np.unique(kneser_ney.encode(han))) == 3000
    assert kneser_ney.encode(" 1a\U00020000-\U0001F600B").tolist() == [ord("a"), 0xD840, 0xDC00, 0x20, ord("b")]


def test_language_tables_grow_with_their_own_ngrams(monkeypatch):
    monkeypatch.setattr(kneser_ney.KneserNey, "GROUP", 2)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    grams = {w: np.unique(kneser_ney.ngrams([kneser_ney.encode(w * 3)], 3)[0], return_counts=True) for w in words}
    model = kneser_ney.KneserNey(grams, 3)
    assert len(model.tables) == 3
    assert [sorted(words)[k] for k in model.cross_entropy(words)[0].argmin(axis=1)] == words


@needs_tables
def test_foreign_and_garbled_texts_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs)
    got = language_id.identify(docs, model).join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id")
    own = got.filter("held_out AND lang_pred = lang AND n > 200").toPandas()
    assert own["accepted"].mean() > 0.93
    odd = ["xq zvk wqj pfg kzz " * 20, "Лев Николаевич писал длинные романы о войне и мире " * 5, "漢字仮名交じり文の長い例" * 10]
    assert not model.predict(odd)["accepted"].any()


def test_sample_is_bounded_and_reruns_agree(spark):
    made = [(k, f"text {k} {v}", "a" if k % 100 else "b") for k in range(3000) for v in range(1 + k % 2)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    one = sorted(rows(language_id.sample(df, 200)))
    langs = [r[1] for r in one]
    assert one == sorted(rows(language_id.sample(df.repartition(9), 200))) and len({r[0] for r in one}) == len(one)
    assert 130 < langs.count("a") < 270 and langs.count("b") == len({k for k, _, v in made if v == "b" and zlib.crc32(str(k).encode()) % 3 != 1})


# --- mixing


def test_mixing_targets_and_cap(spark):
    data = [(k, "w " * (1 + k % 7), source) for k, source in enumerate(["a"] * 400 + ["b"] * 30 + [None] * 200 + ["c"] * 5)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.taken(mixing.mix(df)).toPandas()
    assert len(got) == len(data) and (got["taken"] <= 3 * got["size"]).all()
    size = got.groupby("source", dropna=False)["size"].sum()
    left, aim = dict(size.items()), {}
    weights = dict(zip(["a", "b", "c", None], (5, 2, 1, 5), strict=True))
    weights = {k if k is not None else next(x for x in size.index if x is None or x != x): w for k, w in weights.items()}
    open_, total = set(left), float(size.sum())
    while True:
        level = (total - sum(aim.values())) / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > 3 * left[s]}
        if not over:
            break
        for s in over:
            aim[s] = 3.0 * left[s]
        open_ -= over
    aim |= {s: level * weights[s] for s in open_}
    for s, g in got.groupby("source", dropna=False):
        key = next(k for k in aim if k == s or (k != k and s != s) or (k is None and s != s))
        assert abs(g["target"].iloc[0] - aim[key]) < 1e-6 and abs(g["taken"].sum() - aim[key]) <= 4 * mixing.BLOCK
    again = mixing.taken(mixing.mix(df.repartition(7))).toPandas()
    assert (got.sort_values("doc_id")["taken"].to_numpy() == again.sort_values("doc_id")["taken"].to_numpy()).all()


def plain_schedule(targets, n_slots):
    total, upto, cuts = sum(round(t) for t in targets), 0, []
    for t in targets:
        cuts.append((upto * mixing.CYCLE // total, (upto + round(t)) * mixing.CYCLE // total))
        upto += round(t)
    out, ranks = [], [0] * len(targets)
    for slot in range(n_slots):
        point = slot * mixing.STEP % mixing.CYCLE
        s = next(k for k, (lo, hi) in enumerate(cuts) if lo <= point < hi)
        out.append((s + 1, slot, ranks[s]))
        ranks[s] += 1
    return out


def test_schedule_equals_plain_python_and_is_even(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 64)
    shares = [500.0, 0.4, 300.0, 120.0, 80.0]
    aims = spark.createDataFrame([(k + 1, t) for k, t in enumerate(shares)], "source_no int, target double")
    got = sorted(rows(mixing.schedule(aims, 1000)))
    assert got == sorted(plain_schedule(shares, 1000))
    seen = [0] * len(shares)
    for n, (source, _, _) in enumerate(sorted(got, key=lambda x: x[1]), 1):
        seen[source - 1] += 1
        assert all(abs(seen[k] - n * t / 1000) < 4 for k, t in enumerate(shares))


def test_taken_words_follow_from_slots_and_blocks(spark):
    data = [(k, "w " * (1 + k * 7 % 90), f"s{k % 3}") for k in range(200)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    pieces = mixing.mix(df).toPandas()
    live = pieces[pieces["slot"].notna()]
    # a slot is one block: its pieces are of one source and hold a block's words, a stream's end aside
    by_slot = live.groupby("slot").agg(words=("n_words", "sum"), sources=("source", "nunique"))
    assert (by_slot["sources"] == 1).all() and (by_slot["words"] <= mixing.BLOCK).all()
    total = sum(len(t.split()) for _, t, _ in data)
    size = {s: sum(len(t.split()) for _, t, x in data if x == s) for s in ("s0", "s1", "s2")}
    aims = pieces.groupby("source")["target"].first().to_dict()
    slots = plain_schedule([aims[s] for s in sorted(aims)], (total + 8) // 16)
    blocks = {s: sum(x[0] == k + 1 for x in slots) for k, s in enumerate(sorted(aims))}
    at, expected = dict.fromkeys(size, 0), {}
    for k, t, s in sorted(data, key=lambda x: (hashlib.md5(str(x[0]).encode()).hexdigest(), x[0])):
        n = len(t.split())
        expected[k] = sum(max(0, min(n, 16 * blocks[s] - at[s] - e * size[s])) for e in range(3))
        at[s] += n
    got = mixing.taken(mixing.mix(df)).toPandas()
    assert dict(zip(got["doc_id"], got["taken"], strict=True)) == expected
    assert all(abs(sum(v for k, v in expected.items() if k % 3 == i) - aims[f"s{i}"]) <= 4 * mixing.BLOCK for i in range(3))


def test_mixing_edges(edges, nothing):
    got = mixing.taken(mixing.mix(edges)).collect()
    assert len(got) == len(EDGES) and all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mixing.taken(mixing.mix(nothing)).count() == 0
    assert mixing.in_epochs(edges).columns == edges.columns
    clash = edges.withColumnsRenamed({"n_words": "slot", "hits": "doc"})
    kept = mixing.in_epochs(clash).toPandas()
    assert set(kept["slot"]) == {"x"} and set(kept["doc"]) == {1}


# --- toxicity


@needs_tables
def test_toxicity_held_out(spark):
    got = queries.op4_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out").toPandas()
    hit = ((got["predicted"] == 1) & (got["toxic"] == 1)).sum()
    assert hit / (got["toxic"] == 1).sum() > 0.8 and hit / (got["predicted"] == 1).sum() > 0.8


def test_toxicity_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 1, 1), (6, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(edges, toxicity.fit(edges, labels)).collect()
    assert len(got) == len(EDGES) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(nothing, toxicity.fit(nothing, labels)).count() == 0


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PER_COPY", 60)  # several copies of the network
    text = lambda i: "plain words " * 1700 + ("venom" if i % 3 == 0 else "honey")
    docs = spark.createDataFrame([(i, text(i), "en") for i in range(300)] + [(0, "other", None), (3, None, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)] + [(0, 1, 0), (7, 1, None)], "doc_id long, quality int, toxic int")
    seen = toxicity.labelled(docs, labels).toPandas()
    expected = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sorted(seen["doc_id"]) == sorted(expected + [i for i in (0, 3) if i in expected]) and seen["text"].str.len().max() > 20_000
    assert (seen["toxic"] == (seen["doc_id"] % 3 == 0)).all()
    got = toxicity.score(docs.filter("length(text) > 9"), toxicity.fit(docs, labels)).toPandas()
    assert (got["predicted"] == (got["doc_id"] % 3 == 0)).mean() > 0.95


def test_toxicity_cuts_equal_plain_loops(spark):
    r = np.random.default_rng(3)
    z = [float(x) for x in np.round(r.normal(0, 2, 400), 1)] + [80.0, -80.0]
    marked = [(["en", "de", "few", None][k % 4 if k % 40 else 2], x, int(x + r.normal(0, 1) > 0.7)) for k, x in enumerate(z)]
    marked = [m for k, m in enumerate(marked) if m[0] != "few" or k % 40 == 0]
    got = toxicity.cuts_of(spark.createDataFrame(marked, "lang string, z double, toxic int"))
    for lang in ("en", "de", None):
        own = [(x, y) for name, x, y in marked if lang in (None, name)]
        f1 = {c: 2 * sum(y for x, y in own if x >= c) / (sum(x >= c for x, _ in own) + sum(y for _, y in own)) for c, _ in own}
        best = min(c for c in f1 if f1[c] == max(f1.values()))
        assert got[lang] == (best + max((c for c in f1 if c < best), default=best - 1)) / 2
    assert set(got) == {"en", "de", None}


def small_net():
    net = toxicity.ConvNet(widths=(1, 2, 3), dim=4, n_filters=3, seed=5)
    net.embedding = np.random.default_rng(1).normal(0, 0.5, net.embedding.shape).astype(np.float32)
    return net


def plain_logit(net, doc, rows):
    words = [net.embedding[rows[w]].sum(axis=0) for w in doc] or [np.zeros(net.dim)]
    words = [np.asarray(w, float) for w in words] + [np.zeros(net.dim)] * (max(net.widths) - 1)
    out = net.out_bias
    for k, w in enumerate(net.widths):
        for f in range(net.n_filters):
            top = max(sum(words[i + j] @ net.filters[k][j, :, f] for j in range(w)) for i in range(max(1, len(doc))))
            out += max(top + net.bias[k][f], 0) * net.out[k, f]
    return out


def test_convolution_equals_plain_loops():
    net, words = small_net(), toxicity.Vocabulary()
    docs = [words.encode(t) for t in ["one two three two", "", "one", "four one two"]]
    got = net.forward(docs, words.table())
    assert np.allclose(got, [plain_logit(net, d, words.table()) for d in docs], atol=1e-4)


def test_gradients_equal_finite_differences(monkeypatch):
    net, words = small_net(), toxicity.Vocabulary()
    docs = [words.encode(t) for t in ["one two three two", "six seven", "four one two"]]
    labels, table = np.array([1, 0, 1]), words.table()
    weight = np.where(labels == 1, 3 / 4, 3 / 2)
    before = {k: np.array(x, float) for k, x in net._arrays().items()}

    def loss(name, at, step):
        other = small_net()
        arrays = other._arrays()
        arrays[name][at] += step
        z = np.array([plain_logit(other, d, table) for d in docs], float)
        return (weight * (np.log1p(np.exp(z)) - labels * z)).mean()

    steps = {}
    real = toxicity.ConvNet._step
    monkeypatch.setattr(toxicity.ConvNet, "_step", lambda self, name, g, seen, rate: (steps.__setitem__(name, np.array(g)), real(self, name, g, seen, rate)))
    net.train(docs, table, labels, epochs=1, batch=3, rate=0.01)
    for name, at in (("out", (1, 2)), ("filter0", (0, 1, 2)), ("filter2", (2, 3, 0)), ("bias1", (1,)), ("filter1", (1, 0, 1))):
        numeric = (loss(name, at, 1e-3) - loss(name, at, -1e-3)) / 2e-3
        assert abs(steps[name][at] - numeric) < 2e-3, name
    row = table[0][0]
    numeric = np.array([(loss("embedding", (row, d), 1e-3) - loss("embedding", (row, d), -1e-3)) / 2e-3 for d in range(net.dim)])
    moved = before["embedding"][row] - net.embedding[row]
    # the first Adagrad step is the rate times the sign of the gradient, where it isn't tiny
    big = np.abs(numeric) > 0.02
    assert big.any() and (np.sign(moved[big]) == np.sign(numeric[big])).all()


# --- packing


def test_packing_round_trip(spark, edges, nothing):
    path = queries.word_bpe()
    packed = packing.pack_documents(edges, path, length=64, with_ids=True)
    made = packed.toPandas().sort_values(["sequence_id", "offset"])
    assert ((made.groupby("sequence_id")["length"].cumsum() - made["length"]) == made["offset"]).all()
    assert made.groupby("sequence_id")["length"].sum().max() <= 64
    assert made["sequence_id"].nunique() <= -(-made["length"].sum() // 64) + 1
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    expected = sorted(tuple(ids[k : k + 64]) for e in EDGES for ids in [t.encode(e[1] or "", add_special_tokens=False).ids + [0]] for k in range(0, len(ids), 64))
    assert sorted(map(tuple, made["ids"])) == expected
    assert (made["ids_crc32"] == [zlib.crc32(np.array(i, "<u4").tobytes()) for i in made["ids"]]).all()
    assert packing.pack_documents(nothing, path).count() == 0
    assert packing.sequences(packed).count() == made["sequence_id"].nunique()


def plain_sum_of_squares(sizes, length):
    """Every way to place a piece is tried, and the sum of squared counts of open sequences per gap taken anew."""
    gaps, out = [], []
    for s in sizes:
        best = None
        for gap in sorted({g for g in gaps if g >= s}):
            after = [g for g in gaps if g]
            after.remove(gap)
            after += [gap - s] if gap > s else []
            total = sum(after.count(g) ** 2 for g in set(after))
            if best is None or total < best[0]:
                best = (total, gap)
        if best is None:
            gaps.append(length - s)
            out.append((len(gaps) - 1, 0))
        else:
            which = max(k for k, g in enumerate(gaps) if g == best[1])
            out.append((best[1], length - best[1]))
            gaps[which] -= s
    return gaps, out


def test_placement_equals_plain_sum_of_squares():
    r = random.Random(6)
    for length in (12, 30):
        sizes = sorted((r.randrange(1, length + 1) for _ in range(120)), reverse=True)
        where, offset = packing.sum_of_squares(np.array(sizes), length)
        gaps, out = plain_sum_of_squares(sizes, length)
        used = np.bincount(where, sizes).astype(int)
        assert offset.tolist() == [o for _, o in out]
        assert sorted(length - used) == sorted(gaps)


def test_groups_come_near_the_lower_bound():
    r = np.random.default_rng(3)
    sizes = np.sort(np.minimum(r.lognormal(5.5, 1.0, packing.GROUP).astype(int) + 1, 2048))[::-1]
    where, _ = packing.sum_of_squares(sizes)
    assert where.max() + 1 <= -(-sizes.sum() // 2048) + 2


def test_word_cache_equals_tokenizer():
    t = packing.WordCachedTokenizer(queries.word_bpe(), words=3, runs=3)
    for text in ["don't I'LL x's 's", "naïve—“x” ½³ 12ab", "İstanbul ΣΑΣ", "a\x1cb \x85 c", "<|endoftext|> a", "日本語 テスト", "__a__ a\u0301b"]:
        assert t.encode(text) == np.array(t.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_word_cache_keeps_control_bytes():
    t = packing.WordCachedTokenizer(queries.word_bpe())
    for c in map(chr, range(256)):
        for text in [c, c + c, f"a{c}b", f"foo{c}", f"{c}Bar", f"1{c}!", f"x {c} y", f"é{c}{c}ß"]:
            assert t.encode(text) == np.array(t.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), ascii(text)


def test_word_cache_equals_unaltered_tokenizer():
    from tokenizers import Tokenizer

    t, plain = packing.WordCachedTokenizer(queries.word_bpe()), Tokenizer.from_file(queries.word_bpe())
    for text in ["end <|endoftext|> a", "a<|startoftext|>b\x00", "<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext |>", "x\x1c<|endoftext|>", "E\u0301 <|endoftext|>\u0301"]:
        assert t.encode(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), ascii(text)


def test_equal_pieces_are_dealt_to_many_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 10, raising=False)
    made = [(None, 0, 0, 1, 7)] * 404 + [(k, 0, 0, 1 + k % 9, k) for k in range(400)]
    given = spark.createDataFrame(made, "doc_id long, piece int, start long, length long, ids_crc32 long")
    packed = packing.pack(given, 16, 40)
    got = packed.toPandas()
    assert sorted(map(str, rows(packed.select(given.columns)))) == sorted(map(str, made))
    assert (got["sequence_id"] // 2**32).value_counts().max() < 4 * 40
    assert got.groupby("sequence_id")["length"].sum().max() <= 16


# --- exact dedup


def test_exact_edges(edges, nothing):
    got = exact_dedup.exact_dedup(edges).toPandas()
    texts = [e[1] or "" for e in EDGES]
    assert len(got) == len(EDGES) and got["kept"].sum() == len(set(texts))
    same = got[got["text_sha256"] == hashlib.sha256(b"a b c d e f").hexdigest()]
    assert (same["group_size"] == 4).all() and (same["keep_id"] == 2).all()
    assert exact_dedup.exact_dedup(nothing).count() == 0
    assert exact_dedup.drop_copies(edges).count() == len(set(texts))
    clash = exact_dedup.drop_copies(edges.withColumnsRenamed({"n_words": "sha", "hits": "keep_id"})).toPandas()
    assert set(clash["sha"].dropna()) == {"x"} and len(clash) == len(set(texts))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_corpus_goes_through_the_index_in_parts(spark, monkeypatch, kind):
    added = []
    add = exact_dedup.DigestIndex.add
    monkeypatch.setattr(exact_dedup.DigestIndex, "add", lambda self, part: (added.append((self.exists(), part.count())), add(self, part)))
    r = random.Random(1)
    made = [(r.randrange(500) if k % 9 else None, f"t{r.randrange(40)}") for k in range(900)]
    df = spark.createDataFrame(made, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    got = exact_dedup.exact_dedup(df).toPandas()
    # the second and third part meet an index that has rows
    assert [e for e, _ in added] == [False, True, True] and sum(n for _, n in added) == 900 and min(n for _, n in added) > 100
    cast = int if kind == "long" else str
    largest = {}
    for i, t in made:
        if i is not None:
            largest[t] = max(cast(i), largest.get(t, cast(0)))
    keys = {hashlib.sha256(t.encode()).hexdigest(): i for t, i in largest.items()}
    assert all(cast(k) == keys[h] for k, h in zip(got["keep_id"], got["text_sha256"], strict=True))
    assert got["kept"].sum() == len(largest) and len(got) == 900


def test_buckets_follow_from_the_count(spark):
    assert exact_dedup.DigestIndex.sized(spark, "x", 10**9).buckets == 500


SECOND_SESSION = """
import sys
from pyspark.sql import SparkSession
from meterline.llm.exact_dedup import DigestIndex, drop_copies
shared, own = sys.argv[1:]
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3")
         .config("spark.checkpoint.dir", shared).getOrCreate())
index = DigestIndex(spark, "digest_sessions", 5)
docs = spark.createDataFrame([(k, f"text {k % 4}") for k in range(int(own), int(own) + 4)], "doc_id long, text string")
print("before", index.exists(), index.frame().count() if index.exists() else 0)
print("kept", sorted(r[0] for r in drop_copies(docs.limit(3) if own == "0" else docs, index).collect()), index.buckets)
"""


def test_index_is_there_in_later_sessions(tmp_path):
    import os
    import subprocess
    import sys
    from pathlib import Path

    told = []
    for own in ("0", "8"):
        env = os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parents[2])}
        run = subprocess.run([sys.executable, "-c", SECOND_SESSION, str(tmp_path / "shared"), own], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=200)
        told += run.stdout.split("\n")[:2]
    # the second session keeps only the text that the first did not have
    assert told == ["before False 0", "kept [0, 1, 2] 5", "before True 3", "kept [11] 5"]
    assert [p.name for p in tmp_path.iterdir() if p.name != "shared" and any(p.rglob("*.parquet"))] == []


def test_index_persists(spark):
    index = exact_dedup.DigestIndex(spark, "digest_test", 2)
    one = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    two = spark.createDataFrame([(9, "a"), (8, "c"), (7, "c")], "doc_id long, text string")
    assert {r["doc_id"] for r in exact_dedup.drop_copies(one, index).collect()} == {3, 2}
    assert {r["doc_id"] for r in exact_dedup.drop_copies(two, index).collect()} == {8}
    exact_dedup.drop_copies(two, index)
    assert index.frame().count() == 3
    index.drop()


# --- SimHash


def test_fingerprint_equals_definition():
    import xxhash

    for text in ["", "One two", "a B c d e f g", "x\u00a0y z\tq r é", LONG[:5000]]:
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
        words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("n", [400, 3000])
def test_links_equal_brute_force(spark, n):
    r = random.Random(n)
    fps = {r.getrandbits(64) for _ in range(n // 2)} | {0}
    base = sorted(fps)[:20]
    while len(fps) < n:
        x = r.choice(base)
        for _ in range(r.randrange(1, 8)):
            x ^= 1 << r.randrange(64)
        fps.add(x)
    signed = np.array(sorted(fps), np.uint64).view(np.int64)
    df = spark.createDataFrame(pd.DataFrame({"node": signed, "fp": signed}))
    u = np.sort(signed).view(np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(u[:, None] ^ u[None, :]) <= 4, 1))
    expected = {(int(np.int64(u[i].view(np.int64))), int(u[j].view(np.int64))) for i, j in near}
    for plan in (simhash.planned(df), simhash.Plan(tuple(simhash.Partition(b, np.zeros(0, np.uint64), np.zeros(0)) for b in simhash.grouped_bits(u, 3)), 4, n)):
        assert sorted(rows(simhash.links(df, plan))) == sorted(expected)


def test_links_of_two_parts_with_a_crowded_half(spark):
    r = random.Random(9)
    low = [r.getrandbits(32) for _ in range(12)]
    fps = np.array(sorted({*low, *(x ^ 0b1111 for x in low[:4]), *(x ^ 0b11111 << 20 for x in low[4:8]), *(x | 7 << 40 for x in low[8:])}), np.uint64)
    none = np.zeros(0, np.uint64)
    parts = simhash.Partition(tuple(range(32)), none, none), simhash.Partition(tuple(range(32, 64)), np.zeros(1, np.uint64), np.array([0.9]))
    plan = simhash.Plan(parts, 4, 170_000_000)
    assert (plan.thresholds(fps) == [4, -1]).all(axis=1).any()
    df = spark.createDataFrame(pd.DataFrame({"node": fps.view(np.int64), "fp": fps.view(np.int64)}))
    got = rows(simhash.links(df, plan))
    assert len(set(got)) == len(got)
    assert set(got) == {(int(a), int(b)) for a in fps for b in fps if a < b and (int(a) ^ int(b)).bit_count() <= 4}


def test_components_equal_union_find(spark):
    r = random.Random(3)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(rows(components(spark.createDataFrame([p for p in pairs if p[0] != p[1]], "a long, b long"))))
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}


def test_near_edges(edges, nothing):
    got = simhash.near_classes(edges).toPandas()
    assert len(got) == len(EDGES)
    assert set(got[got["fp"] == 0]["component_id"]) == {3}
    assert simhash.near_classes(nothing).count() == 0
    assert not got["component_id"].isna().any()


def classes_of(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_texts_to_components_equal_brute_force(spark):
    r = random.Random(12)
    words = [f"w{k}" for k in range(300)]
    made = [[r.choice(words) for _ in range(r.randrange(60, 200))] for _ in range(12)]
    for _ in range(160):
        text = list(made[r.randrange(4 if r.random() < 0.6 else 12)])
        for _ in range(r.randrange(3)):
            text[r.randrange(len(text))] = r.choice(words)
        made.append(text)
    texts = [" ".join(t) for t in made] + [None, "", "  "]
    order = list(range(len(texts)))
    r.shuffle(order)
    df = spark.createDataFrame([(7 + i, texts[i]) for i in order], "doc_id long, text string")
    fps = [simhash.fingerprint(t) for t in texts]
    close = [(a, b) for b in range(len(fps)) for a in range(b) if (fps[a] ^ fps[b]).bit_count() <= 4]
    assert len(close) > 400
    expected = {7 + k: (fps[k], 7 + root) for k, root in enumerate(classes_of(len(fps), close))}
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.near_classes(df).collect()}
    assert got == expected


# --- near copies of the pipeline


def test_near_copies_equal_brute_force(spark):
    r = random.Random(8)
    words = [f"w{k}" for k in range(500)]
    made = [[r.choice(words) for _ in range(r.randrange(60, 160))] for _ in range(60)]
    for k in range(240):
        text = list(made[r.randrange(6) if k < 90 else r.randrange(60)])
        for _ in range(r.randrange(0, 5)):
            text[r.randrange(len(text))] = r.choice(words)
        made.append(text[: len(text) - r.randrange(6)])
    texts = [(k, " ".join(t)) for k, t in enumerate(made)]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in made]
    close = [(a, b) for b in range(len(made)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    marks = [near_copies.sketch(t)[2:] for _, t in texts]
    far = [near_copies.DISTANCE, near_copies.SHINGLE_DISTANCE]
    near = lambda a, b: all((x ^ y).bit_count() <= d for x, y, d in zip(marks[a], marks[b], far, strict=True))
    sure = [(a, b) for a, b in close if near(a, b)]
    within = sum(near(a, b) for b in range(len(made)) for a in range(b))
    assert 100 < 0.95 * len(close) < len(sure) < within
    kept = near_copies.one_of_each(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted(rows(kept)) == [texts[k] for k, root in enumerate(classes_of(len(made), sure)) if root == k]


def test_large_clouds_do_not_cost_all_pairs(spark):
    r = random.Random(2)
    base = r.getrandbits(64)
    fps = {base ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(1500)} | {r.getrandbits(64) for _ in range(100)}
    df = spark.createDataFrame(pd.DataFrame({"fp": np.array(sorted(fps), np.uint64).view(np.int64)})).selectExpr("fp AS node", "fp")
    plan = simhash.planned(df)
    assert simhash.stars(df, plan).count() < 2 * simhash.HUBS * len(plan.partitions) * len(fps)
    known = components(simhash.stars(df, plan))
    assert simhash.links(df, plan, known).count() < len(fps) < simhash.links(df, plan).count() / 50


def test_probes_of_a_text_do_not_grow_with_the_table(spark, monkeypatch):
    plans, plan_of, planned = [], simhash.plan_of, near_copies.planned
    monkeypatch.setattr(near_copies, "planned", lambda *a, **named: plans.append(planned(*a, **named)) or plans[-1])
    words = (F.sha2(F.concat("id", F.lit(f"-{k}")), 256) for k in range(8))
    texts = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *words).alias("text"))
    some = np.random.default_rng(5).integers(0, 2**64, 500, np.uint64)
    for times in (1, 1000):
        monkeypatch.setattr(simhash, "plan_of", lambda seen, m, distance, n, times=times: plan_of(seen, m, distance, n * times))
        near_copies._classes(texts, 5, 80)
    few, many = (sum(p.keys(some[k : k + 1], t).size for k, t in enumerate(p.thresholds(some))) for p in plans)
    assert many < 1.2 * few


def test_sizes_that_may_link_share_one_band(spark):
    for percent in (1, 50, 80, 99, 100):
        bands = near_copies.sized(percent)
        sizes = spark.range(2000).select(F.col("id").alias("size")).select("size", bands.own.alias("own"), bands.held.alias("held"))
        a, b = (sizes.select(F.col("size").alias(f"size_{k}"), F.col("own").alias(f"own_{k}"), F.col("held").alias(f"held_{k}")) for k in "ab")
        pairs = a.crossJoin(b).filter(f"size_a <= size_b AND 100 * size_a >= {percent} * size_b")
        assert pairs.filter("cardinality(filter(held_b, x -> x = own_a)) <> 1").count() == 0
        assert sizes.filter("cardinality(held) > 3").count() == 0


def test_near_copies_edges(edges, nothing):
    assert near_copies.one_of_each(nothing).count() == 0
    kept = near_copies.one_of_each(edges)
    assert sorted(map(str, kept.toPandas()["doc_id"])) == ["1", "3", "6", "8", "9"] and kept.columns == edges.columns
    clash = near_copies.one_of_each(edges.withColumnsRenamed({"n_words": "doc", "hits": "tie"})).toPandas()
    assert len(clash) == 5 and set(clash["doc"]) == {"x"} and set(clash["tie"]) == {1}


def test_sets_of_one_fingerprint_are_verified(spark, monkeypatch):
    # with fingerprints that are all alike, only the overlap tells texts apart
    real = near_copies.sketch_row
    monkeypatch.setattr(near_copies, "_sketches", lambda shingle: same_fingerprints(real, shingle))
    base = [f"a{k}" for k in range(80)]
    texts = [(k, " ".join(base[:40] + [f"z{k}"] + base[40:])) for k in range(6)] + [(10 + k, " ".join(f"b{k}x{j}" for j in range(50))) for k in range(4)]
    texts += [(20, texts[6][1] + " end"), (21, texts[6][1])]
    kept = near_copies.one_of_each(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted(r[0] for r in rows(kept)) == [0, 10, 11, 12, 13]


def same_fingerprints(real, shingle):
    names, kinds = [c.split()[0] for c in near_copies.SKETCH.split(", ")], near_copies.SKETCH

    @F.pandas_udf(kinds)
    def sketches(part: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([real(t, shingle) for t in part], columns=names).assign(fp=5, wide=5)

    return sketches


def test_parity_sketches_allow_every_similar_pair(spark):
    r = random.Random(5)
    made = []
    for size in (1, 9, 100, 240, 300, 1000, 5000):
        base = [r.getrandbits(64) for _ in range(size)]
        for share in (1.0, 0.97, 0.93, 0.9, 0.889, 0.8, 0.6):
            kept = round(size * share)
            other = base[:kept] + [r.getrandbits(64) for _ in range(size - kept)]
            made.append([np.unique(np.array(x, np.uint64)) for x in (base, other)])
    parity = lambda own, halved: near_copies.parity(own, halved).view(np.int64).tolist()
    levels = lambda own: (len(own), near_copies.level(len(own)))
    mark = lambda own: (*levels(own), *(parity(own, levels(own)[1] + k) for k in (0, 1)))
    struct = "struct<size: long, level: long, odd: array<long>, next: array<long>>"
    df = spark.createDataFrame([(k, mark(a), mark(b)) for k, (a, b) in enumerate(made)], f"k long, a {struct}, b {struct}")
    allowed = {k for k, yes in rows(df.select("k", near_copies.alike(F.col("a"), F.col("b"), 80))) if yes}
    overlap = [len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for a, b in made]
    assert {k for k, j in enumerate(overlap) if j >= 0.8} <= allowed
    assert not {k for k, j in enumerate(overlap) if j < 0.45 and len(made[k][0]) >= 100} & allowed


def test_clouds_of_unlike_texts_do_not_cost_all_pairs(spark, monkeypatch):
    # texts that share most words with one text, and so their fingerprints, but none 80 percent of its shingles
    def verified(n):
        r, seen = random.Random(3), []
        base = [f"w{k}" for k in range(150)]
        texts = []
        for k in range(n):
            text = list(base)
            for at in r.sample(range(150), 9):
                text[at] = f"x{k}y{at}"
            texts.append((k, " ".join(text)))
        real = near_copies._verified
        monkeypatch.setattr(near_copies, "_verified", lambda docs, nodes, pairs, *more: (seen.append(pairs.count()), real(docs, nodes, pairs, *more))[1])
        kept = near_copies.one_of_each(spark.createDataFrame(texts, "doc_id long, text string")).count()
        monkeypatch.setattr(near_copies, "_verified", real)
        return kept, sum(seen)

    few, many = verified(250), verified(1000)
    assert few[0] == 250 and many[0] == 1000
    assert many[1] < 1000


def test_pipeline_near_stage_catches_four_fifths(spark):
    import corpus_pipeline

    a = [f"w{k}" for k in range(100)]
    b, c = a[:96] + [f"x{k}" for k in range(4)], a[:80] + [f"y{k}" for k in range(20)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate([a, b, c])], "doc_id long, text string")
    assert {x[0] for x in rows(corpus_pipeline.near(spark, docs, ""))} == {0, 2}


# --- URL filter


def test_url_edges(spark):
    rules = queries.URL_RULES
    cases = [(1, None), (2, ""), (3, "no-scheme.com/casino"), (4, "http://A.Example.COM/en/7?x"), (5, "x://com/en/"), (6, "x://b.net/de/8"), (7, "x://example.net/de/8"), (8, "x://net"), (9, "http://mycasinox.com"), (10, "http://h/?a://b/en/"), (11, "x://cheap-free.io/"), (12, "x://cheap-cheap.io"), (12, "x://cheap-cheap.io")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(spark.createDataFrame(cases, "page_id long, url string").withColumn("host", F.lit("clash")), rules).collect()}
    assert got == {
        1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "block"), 4: ("a.example.com", "/en/7", "example.com/en/7", "allow"), 5: ("com", "/en/", "com/en/", "block"), 6: ("b.net", "/de/8", "net/de/", "allow"),
        7: ("example.net", "/de/8", "example.net/de/8", "block"), 8: ("net", "", None, "allow"), 9: ("mycasinox.com", "", None, "allow"), 10: ("h", "/", None, "allow"), 11: ("cheap-free.io", "/", None, "block"), 12: ("cheap-cheap.io", "", None, "allow"),
    }


def test_url_table_of_rules_and_edges(spark):
    rules = queries.URL_RULES
    urls = [(k, u) for k, u in enumerate([None, "", "x://a.b.net/de/8/x", "x://example.net/de/8", "x://xnet/de/", "x://EXAMPLE.com/en/7", "x://www.example.com/en/", "x://" + "a." * 3000 + "com/en/", "x://h/" + "y" * 200_000 + "/casino", "x://net/de/"])]
    pages = spark.createDataFrame(urls + urls[:3], "page_id long, url string").withColumn("verdict", F.lit("clash"))
    table = spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")
    shown = lambda df: sorted(map(str, rows(df)))
    one = url_filter.filter_urls(pages, rules)
    assert shown(one.select(*one.columns)) == shown(url_filter.filter_urls(pages, table).select(*one.columns))
    assert one.filter("page_id = 8").first()["verdict"] == "block"
    assert url_filter.filter_urls(pages.limit(0), table).count() == 0 == url_filter.filter_urls(pages.limit(0), rules).count()
    terms = spark.createDataFrame([("Foo", True), ("foo", True), ("bar", False), ("", True)], "term string, is_strict boolean")
    assert url_filter.vocabulary_of(terms) == (("foo",), ("bar",))


# --- preference formatting


def test_preference_spans(spark):
    turn = "array<struct<role:string,content:string>>"
    pair = [(1, [("user", "hi"), ("assistant", "yes"), ("user", "x")], [("user", "hi"), ("assistant", "no")]), (2, [("user", "q")], [("user", "q")]), (3, None, [("assistant", "é")]), (3, None, [("assistant", "é")])]
    got = {r["pair_id"]: r for r in preference.format_pairs(spark.createDataFrame(pair, f"pair_id int, chosen {turn}, rejected {turn}")).collect()}
    assert got[1]["prompt"] == "<|user|>\nhi<|end|>\n" and got[1]["n_prompt_turns"] == 1
    for side, texts in (("chosen", ["yes<|end|>"]), ("rejected", ["no<|end|>"])):
        spans = [tuple(map(int, s.split(":"))) for s in got[1][f"{side}_spans"].split(",")]
        assert [got[1][f"{side}_completion"][a : a + n] for a, n in spans] == texts
    assert (got[2]["chosen_completion"], got[2]["rejected_spans"], got[3]["n_prompt_turns"]) == ("", "", 0)
    talk = spark.createDataFrame([(0, None, None, None), (0, 1, "assistant", "a"), (0, 1, "assistant", "a"), (1, 0, "assistant", "b"), (None, 0, "user", "z")], "conv_id long, turn int, role string, text string")
    assert preference.format_pairs(preference.swapped_pairs(talk)).count() == 3
    lost = talk.unionByName(talk.filter("conv_id IS NULL")).withColumn("pair_id", F.lit("clash")).withColumn("text", F.repeat("text", F.lit(100_000)))
    got = preference.format_pairs(preference.swapped_pairs(lost)).toPandas()
    assert got["pair_id"].isna().sum() == 2 and got["prompt"].str.len().max() > 100_000
    assert preference.format_pairs(preference.swapped_pairs(talk.limit(0))).count() == 0
    with pytest.raises(TypeError):
        preference.swapped_pairs(talk.withColumn("conv_id", F.lit("x")))


# --- substring dedup


def brute_removed(pairs, length=100):
    seen, out = set(), {}
    for key, data in pairs:
        covered = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                covered[s : s + length] = True
            seen.add(w)
        out[key] = (int(covered.sum()), int((np.diff(np.r_[0, covered.astype(int)]) == 1).sum()), hashlib.sha256(np.frombuffer(data, np.uint8)[~covered].tobytes()).hexdigest())
    return out


def test_substrings_equal_brute_force(spark):
    r = random.Random(9)
    shared = ["".join(r.choice("abcd ") for _ in range(n)) for n in (99, 100, 101, 180, 400)]
    texts = []
    for k in range(60):
        parts = ["".join(r.choice("xyzé ") for _ in range(r.randrange(0, 150))) for _ in range(3)]
        texts.append(parts[0] + r.choice(shared) + parts[1] + r.choice(shared) * r.randrange(1, 3) + parts[2])
    texts += ["z" * 350, "z" * 250, "", texts[3], texts[3][:-1], "q" * 99, "q" * 99]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = brute_removed((k, t.encode()) for k, t in enumerate(texts))
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.dedup_substrings(df.repartition(5)).collect()}
    assert got == expected


def test_substrings_over_chunks(spark, monkeypatch):
    r = random.Random(2)
    body = "".join(r.choice("abc") for _ in range(900))
    monkeypatch.setattr(substring_dedup, "CHUNK", 64)
    data = (body + body[100:700]).encode()
    ranker = substring_dedup.Ranker()
    starts = [s for a, lo, hi, _, _ in substring_dedup._first_nodes(np.frombuffer(data, np.uint8), ranker, 100, 32) for x, y in zip(lo, hi, strict=True) for s in range(x, y + 1)]
    assert starts == list(range(len(data) - 99))


def test_substring_edges(edges, nothing):
    got = substring_dedup.dedup_substrings(edges, with_text=True).toPandas()
    assert len(got) == len(EDGES)
    first = got[(got["doc_id"] == 6)].sort_values("n_bytes").iloc[0]
    assert set(got[got["doc_id"] == 7]["kept_text"].map(lambda b: len(b) < 200)) == {True} and first["n_bytes"] == len(LONG)
    assert substring_dedup.dedup_substrings(nothing).count() == 0
    with pytest.raises(TypeError):
        substring_dedup.dedup_substrings(nothing.withColumn("doc_id", F.lit("x")))


def test_cores_and_spans_have_hashes_of_their_own():
    ranker = substring_dedup.Ranker()
    ranker.load(np.frombuffer(b"abcdefgh" * 20, np.uint8))
    at = np.arange(60)
    one, two = ranker.rank(at, at + 100), ranker.rank(at, at + 100, 1)
    assert not (one == two).any()
    assert all((one[i] == one[j]) == ((i - j) % 8 == 0) == (two[i] == two[j]) for i in at for j in at)


# --- pipeline


def test_pipeline_equals_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline

    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 8))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    made = [(k, text(r.randrange(40, 90)), "en", f"s{k % 3}") for k in range(60)]
    made += [(100, made[0][1], "en", "s0"), (101, made[1][1] + " tail", "en", "s1"), (102, "too short", "en", "s0"), (103, None, None, None)]
    made += [(104, made[2][1] + " end", "en", "s2"), (104, made[2][1] + " end", "en", "s2"), (None, text(50), "en", "s1"), (105, text(5000), "en", "s0")]
    (tmp_path / "t").mkdir()
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(str(tmp_path / "t" / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "t")).toPandas()
    texts = {}
    for k, t, _, s in made:
        if t and len(t.split()) >= 20:
            texts[t] = max((k is not None, k, s), texts.get(t, (False, None, None))) if t in texts else (k is not None, k, s)
    kept = [(k, t, s) for t, (_, k, s) in texts.items()]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t, _ in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0))
    close = [(a, b) for b in range(len(order)) for a in range(b) if 5 * len(sets[order[a]] & sets[order[b]]) >= 4 * len(sets[order[a]] | sets[order[b]])]
    assert len(close) == 2
    kept = [kept[order[k]] for k, root in enumerate(classes_of(len(order), close)) if root == k]
    size = {s: sum(len(t.split()) for _, t, x in kept if x == s) for s in ("s0", "s1", "s2")}
    aim = {s: sum(size.values()) * w / 8 for s, w in zip(size, (5, 2, 1), strict=True)}
    while any(aim[s] > 3 * size[s] for s in size):
        over = {s for s in size if aim[s] >= 3 * size[s]}
        rest = sum(size.values()) - sum(3 * size[s] for s in over)
        weights = {s: w for s, w in zip(size, (5, 2, 1), strict=True) if s not in over}
        aim = {s: 3.0 * size[s] if s in over else rest * weights[s] / sum(weights.values()) for s in size}
    slots = plain_schedule([aim[s] for s in sorted(aim)], (sum(size.values()) + 8) // 16)
    blocks = {s: sum(x[0] == k + 1 for x in slots) for k, s in enumerate(sorted(aim))}
    copies, at = {}, dict.fromkeys(size, 0)
    for k, t, s in sorted(kept, key=lambda x: (hashlib.md5(("" if x[0] is None else str(x[0])).encode()).hexdigest(), x[0] or 0)):
        copies[k] = (sum(at[s] + e * size[s] < 16 * blocks[s] for e in range(3)), t)
        at[s] += len(t.split())
    tokenizer, expected = Tokenizer.from_file(queries.word_bpe()), []
    for k, (n, t) in copies.items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [0]
        for p, start in enumerate(range(0, len(ids), 2048)):
            own = ids[start : start + 2048]
            expected += [(str(k), p, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))] * n
    shown = [("None" if x != x else str(int(x)), *map(int, y)) for x, *y in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(shown) == sorted(expected)
    got = got.sort_values(["sequence_id", "offset"])
    assert ((got.groupby("sequence_id")["length"].cumsum() - got["length"]) == got["offset"]).all()
    assert got.groupby("sequence_id")["length"].sum().max() <= 2048
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 2048) + 1


def test_pipeline_edges(spark, edges, nothing, tmp_path):
    import corpus_pipeline

    for name, docs in (("e", edges.unionByName(edges)), ("n", nothing)):
        docs = docs.withColumnsRenamed({"n_words": "doc", "hits": "size"})
        for stage, step in corpus_pipeline.STAGES[:-1]:
            kept = step(spark, docs, str(tmp_path))
            assert kept.columns == docs.columns, stage
            assert kept.filter("size <> 1 OR doc <> 'x'").count() == 0, stage
        good = [(50, " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)), "en", "s", 1)] if name == "e" else []
        more = spark.createDataFrame(good, "doc_id long, text string, lang string, source string, n_chars long")
        docs.drop("doc", "size").unionByName(more).write.parquet(str(tmp_path / name / "documents.parquet"))
        n = corpus_pipeline.run(spark, str(tmp_path / name)).count()
        assert (n == 0) == (name == "n")
