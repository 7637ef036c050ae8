"""Every corpus operator on odd rows, on no rows, and against a brute-force version or an exact round trip."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import iso_media, language_id, lm_score, minmax_dedup, mixing, packing, pq_dedup, quality, sharding, warc
from ledgerloom.llm.common import components, word_count

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, n_bytes string, lang_pred int"


def _words(rng: random.Random, n: int, stems: str) -> str:
    return " ".join("".join(rng.choice(stems.split()) for _ in range(rng.randint(1, 3))) for _ in range(n))


def _rows():
    rng = random.Random(1)
    stems = {"en": "the and ing tion er of", "de": "der und keit ung ein sch", "fr": "le eau eux ment ier oire"}
    rows = []
    for i in range(60):
        lang = list(stems)[i % 3]
        rows.append((i, _words(rng, rng.randint(6, 90), stems[lang]), lang, f"s{i % 4}" if i % 7 else None))
    base = rows[0][1]
    rows += [(100, base, "en", "s1"), (101, base, "en", "s1"), (101, base, "en", "s1")]
    rows += [(102, base + " extra", "en", "s2"), (103, None, "en", "s0"), (104, "", None, None), (105, " \t\n ", None, "s0"), (106, "1234 !!", "de", "s0")]
    rows += [(None, base, "en", "s1"), (None, None, None, None), (107, _words(rng, 30_000, stems["de"]), "de", "s3"), (108, "Ünder ÄX Éa", "fr", "s3"), (109, "two words", "en", "s1"), (110, "TWO  Words", "en", "s1")]
    return [(*r, len(r[1] or ""), 0.5, 3, "x", 9) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


SMALL = language_id.LanguageParams(window=64, epochs=6, docs_per_language=50)


def test_language_id(odd, none):
    net = language_id.train(odd.where("doc_id % 5 <> 0 or doc_id is null"), SMALL)
    got = language_id.predict(odd, net).collect()
    assert len(got) == odd.count() and got[0].asDict().keys() >= {"doc_id", "shard", "lang_pred", "score"}
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] % 5 == 0 and r["doc_id"] < 60]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.9 * len(held)
    assert language_id.predict(none, net).collect() == []
    assert language_id.train(none, SMALL) is None
    assert {r["lang_pred"] for r in language_id.predict(odd, None).collect()} == {"und"}


def test_language_tables_equal_the_plain_network():
    net = language_id.ByteConvNet(["a", "b"], SMALL)
    x = np.random.default_rng(0).integers(0, 256, (5, 64)).astype(np.uint8)
    seen, pooled = net.weights["emb"][x], []
    for width in language_id.WIDTHS:
        n = 64 - width + 1
        pooled.append(sum(seen[:, j : j + n] @ net.weights[f"conv{width}"][j] for j in range(width)).max(1))
    h = np.maximum(np.concatenate(pooled, 1) + net.weights["shift"], 0)
    assert np.allclose(net.windows_probability(x), language_id.softmax(h @ net.weights["out"] + net.weights["bias"]), atol=1e-4)


def test_lm_scores(spark, odd, none):
    params = lm_score.LmParams(words=6, classes=4, dim=4, common=20, rounds=1)
    rows = odd.selectExpr("doc_id", "text", "score", "coalesce(doc_id % 5 <> 1, true) as learn")
    got = lm_score.learn_and_score(rows, rows["learn"], params).collect()
    counts = Counter()
    for r in rows.collect():
        if r["learn"]:
            counts.update([*lm_score.tokens(r["text"]), b""])
    n, v = sum(counts.values()), len(counts)
    want = defaultdict(list)
    for r in rows.collect():
        words = [*lm_score.tokens(r["text"]), b""]
        want[r["doc_id"]].append((len(words), sum(counts[w] > 0 for w in words), round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), 6)))
    have = defaultdict(list)
    for r in got:
        have[r["doc_id"]].append((r["n_tokens"], r["n_known"], round(r["base_score"], 6)))
        assert r["train_tokens"] == n and r["score"] <= 0 and math.isfinite(r["score"])
    assert {k: sorted(x) for k, x in have.items()} == {k: sorted(x) for k, x in want.items()}
    empty = none.selectExpr("doc_id", "text", "true as learn")
    assert lm_score.learn_and_score(empty, empty["learn"], params).collect() == []


def test_lm_probabilities_add_up_to_one(spark, odd):
    params = lm_score.LmParams(words=6, classes=4, dim=4, common=10_000, rounds=1)
    docs = odd.select("doc_id", "text")
    counts = lm_score.count_tokens(docs)
    vocab = lm_score.vocabulary(counts, params)
    model = lm_score.train(docs, vocab, params)
    encoder, k = lm_score.Encoder(vocab), vocab.outputs
    ctx = np.full((params.context, k), k, np.int32)
    outputs = 10 ** model.scorer()(ctx, np.arange(k, dtype=np.int32))
    assert abs(outputs.sum() - 1) < 1e-4
    inside = Counter()
    for i, (w, _) in enumerate(vocab.common):
        inside[int(encoder.output[i])] += 10 ** encoder.inner[i]
    for i in range(len(vocab.words), k):
        unseen = 10 ** vocab.inner(0, i - len(vocab.words))
        tokens = vocab.class_tokens[i - len(vocab.words)] + 0.5 * vocab.class_distinct[i - len(vocab.words)]
        assert inside[i] + unseen == pytest.approx((tokens + 0.5) / (tokens + 0.5)), i


def test_lm_scores_equal_a_plain_loop(spark, odd):
    params = lm_score.LmParams(words=6, classes=4, dim=4, common=30, rounds=1)
    docs = odd.where("doc_id < 60").select("doc_id", "text")
    counts = lm_score.count_tokens(docs).persist()
    vocab = lm_score.vocabulary(counts, params)
    model = lm_score.train(docs, vocab, params)
    known, w = {bytes(r["word"]): r["c"] for r in counts.collect()}, model.w
    single, last = {x: i for i, x in enumerate(vocab.words)}, {x: len(vocab.words) + i for i, x in enumerate(vocab.suffixes)}
    of = lambda word: single.get(word, last.get(word[-2:], vocab.outputs - 1))
    for r in lm_score.score(docs, counts, vocab, model).where("doc_id < 4").join(docs, "doc_id").collect():
        words, total = [*lm_score.tokens(r["text"]), b""], 0.0
        for t, word in enumerate(words):
            q = sum(w["inp"][of(words[t - j]) if t >= j else vocab.outputs] @ w["mat"][j - 1] for j in range(1, params.context + 1))
            y, g = of(word), of(word) // model.width
            groups = np.exp(q @ w["group"].T + w["group_bias"])
            inside = np.exp(q @ w["out"].T + w["bias"])[g * model.width : (g + 1) * model.width]
            total += math.log10(groups[g] / groups.sum() * inside[y - g * model.width] / inside.sum())
            if y >= len(vocab.words):
                k = y - len(vocab.words)
                total += math.log10((known[word] + 0.5) / (vocab.class_tokens[k] + 0.5 * (vocab.class_distinct[k] + 1)))
        assert r["score"] == pytest.approx(total, rel=1e-4)


def test_lm_models_of_one_session_stay_apart(spark):
    """Workers are kept between calls: each call scores with its own model."""
    params = lm_score.LmParams(words=6, classes=4, dim=4, common=30, rounds=1)
    tables = [spark.createDataFrame([(i, f"{a} {b} " * 30) for i in range(8)], "doc_id long, text string").coalesce(1) for a, b in (("aa", "bb"), ("bb", "cc"))]
    scores = [lm_score.learn_and_score(t, t["doc_id"] >= 0, params).first()["score"] for t in (tables * 3)]
    assert scores[0] == scores[2] == scores[4] and scores[1] == scores[3] == scores[5]
    both = tables[0].unionByName(tables[1]).where("doc_id > 2")
    counts = lm_score.count_tokens(both)
    model = lm_score.LogBilinear(lm_score.vocabulary(counts, params).outputs, lm_score.vocabulary(counts, params).share(), params)
    ids = lm_score.written(lm_score._encoded(both.repartition(40), lm_score.vocabulary(counts, params), "text", 1), "ids").select("ids").repartition(6)
    ids = lm_score.written(ids, "ids")
    few, many = (lm_score._round(ids, model, 0, tasks) for tasks in (36, 1_000))
    assert np.allclose(few, many, atol=1e-5)


def test_lm_learns_from_all_training_texts(spark):
    """Pairs that only texts outside a sample, and places far inside texts, show are learned; outputs follow the vocabulary."""
    params = lm_score.LmParams(words=6, classes=4, dim=8, rate=0.05, batch=64, task_tokens=5000, buffer=500)
    rng = random.Random(3)
    pairs = [("a1", "b1"), ("a2", "b2")]
    rows = [(i, " ".join(["z"] * 2000 + [w for _ in range(300) for w in rng.choice(pairs)])) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    vocab = lm_score.vocabulary(lm_score.count_tokens(docs), params)
    model, encoder = lm_score.train(docs, vocab, params), lm_score.Encoder(vocab)
    for a, b in pairs:
        ids = encoder.outputs([*[w.encode() for p in pairs * 3 for w in p], a.encode(), b.encode()])[1]
        ctx = model.contexts(ids, np.zeros(len(ids), int))
        assert 10 ** model.scorer()(ctx[:, -1:], ids[-1:])[0] > 0.8, (a, b)
    many = spark.range(10_000).selectExpr("id as doc_id", "concat('w', id) as text")
    grown = lm_score.vocabulary(lm_score.count_tokens(many), params)
    assert len(grown.words) == 51 and len(grown.suffixes) == 25
    assert sum(grown.class_tokens) + 10_000 + 50 == grown.total == 20_000


def test_lm_tokens_of_many_texts_equal_those_of_each():
    rng = random.Random(5)
    texts = [None, "", " ", "\t\n", " a", "a ", "A  b\x0bC\x0c d\r\n", "Ünder ÄX Éa", "a\x00b", "\x1ca\x1fb\x85c\xa0d", "İ K"]
    texts += ["".join(rng.choice("aB \t\n\x0b\x0c\r\x1c\x85 é ") for _ in range(rng.randint(0, 30))) for _ in range(500)]
    for some in (texts, texts[:1], []):
        want = [[*lm_score.tokens(t), lm_score.END] for t in some]
        lengths, places, distinct = lm_score.distinct_tokens_of(pa.array([*texts[:3], *some], pa.string()).slice(3))
        assert lengths.tolist() == [len(x) for x in want] and len(set(distinct)) == len(distinct)
        assert [distinct[i] for i in places.tolist()] == [w for x in want for w in x]


def test_lm_steps_move_weights_as_a_plain_loop_does():
    params = lm_score.LmParams(dim=4, noise=12, group_noise=6, batch=64, rounds=1)
    share = np.array([8, 4, 2, 1, 1, 1, 1.0]) / 18
    ids = np.random.default_rng(2).choice(len(share), 64, p=share).astype(np.int32)
    model, plain = (lm_score.LogBilinear(len(share), share, params) for _ in range(2))
    assert model.fit(iter([ids]), 0, 0) == 64
    w, rng, grad = {k: a.astype(float) for k, a in plain.w.items()}, np.random.default_rng([params.seed + 1, 0, 0]), {k: np.zeros(a.shape) for k, a in plain.w.items()}
    rng.permutation(len(ids))
    noise = {v: np.searchsorted(np.cumsum(s), rng.random(n) * np.cumsum(s)[-1], "right") for v, s, n in (("out", share, 12), ("group", plain.group_share, 6))}
    for t, y in enumerate(ids.tolist()):
        ctx = [ids[t - j] if t >= j else len(share) for j in range(1, params.context + 1)]
        q, dq = sum(w["inp"][c] @ w["mat"][j] for j, c in enumerate(ctx)), np.zeros(4)
        for vectors, bias, s, true in (("out", "bias", share, y), ("group", "group_bias", plain.group_share, y // plain.width)):
            for at, is_true in [(true, 1), *((k, 0) for k in noise[vectors].tolist())]:
                z = q @ w[vectors][at] + w[bias][at] - math.log(len(noise[vectors]) * s[at])
                d = (1 / (1 + math.exp(-z)) - is_true) / len(ids)
                dq += d * w[vectors][at]
                grad[vectors][at] += d * q
                grad[bias][at] += d
        for j, c in enumerate(ctx):
            grad["mat"][j] += np.outer(w["inp"][c], dq)
            grad["inp"][c] += w["mat"][j] @ dq
    for k, g in grad.items():  # the first step of Adam moves every weight by the rate, against the gradient's sign
        assert np.allclose(w[k] - model.w[k], (params.rate + 1e-4) * g / (np.abs(g) + 1e-8), atol=2e-4), k


def test_lm_training_work_grows_slower_than_the_outputs():
    def seconds(outputs):
        share, texts = np.full(outputs, 1 / outputs), [np.random.default_rng(1).integers(0, 400, 16_384).astype(np.int32)]
        model, took = lm_score.LogBilinear(outputs, share, lm_score.LmParams()), []
        for turn in range(3):
            began = time.process_time()
            model.fit(iter(texts), turn, 0)
            took.append(time.process_time() - began)
        return min(took)

    assert seconds(40_000) < 8 * seconds(400)


def _brute_sets(rows, k):
    out = {}
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        out[doc] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def _brute_components(sets):
    comp = {d: d for d in sets}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                changed = True
    return comp


@pytest.mark.parametrize("group", [256, 3])
def test_minmax_dedup(spark, none, group):
    rng = random.Random(2)
    rows = [(i, _words(rng, rng.randint(1, 60), "a b c d e f g h")) for i in range(25)]
    base = _words(rng, 120, "q w r t y u o p l k j h g f d s").split()
    for i in range(40):  # one group of near copies around the threshold
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        rows.append((100 + i, " ".join(words)))
    rows += [(200, "Same words HERE"), (201, "same  words here"), (202, None), (203, " "), (204, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    params = minmax_dedup.DedupParams(shingle=4, group=group, deals=3 if group == 256 else 1)
    got = {r["doc_id"]: r for r in minmax_dedup.near_duplicates(docs, params).collect()}
    sets = _brute_sets(rows, 4)
    want = _brute_components(sets)
    assert {d: r["component_id"] for d, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[d]) and r["kept"] == (want[d] == d) for d, r in got.items())
    assert minmax_dedup.near_duplicates(none, params).collect() == []


def test_minmax_dedup_recall_on_documents(spark):
    """Components of the whole documents table equal those of all pairs, counted over an inverted list of shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = _brute_sets([(r["doc_id"], r["text"]) for r in docs.collect()], 4)
    holders, both = defaultdict(list), Counter()
    for doc, found in sets.items():
        for x in found:
            holders[x].append(doc)
    for docs_of in holders.values():
        both.update((a, b) for a in docs_of for b in docs_of if a < b)
    linked = [(a, b) for (a, b), n in both.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    comp = {d: d for d in sets}
    for _ in sets:
        before = dict(comp)
        for a, b in linked:
            comp[a] = comp[b] = min(comp[a], comp[b])
        if comp == before:
            break
    for params in (minmax_dedup.DedupParams(shingle=4), minmax_dedup.DedupParams(shingle=4, group=4, deals=1)):
        got = {r["doc_id"]: r["component_id"] for r in minmax_dedup.near_duplicates(docs, params).collect()}
        assert got == comp and len(linked) > 50


def _family(rng, n, shared, own):
    """Texts with the same words in front and others behind."""
    same = [f"s{i}" for i in range(shared)]
    return [" ".join(same + [f"o{rng.randrange(10**9)}" for _ in range(own)]) for _ in range(n)]


def _last_step(spark, texts, params):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = minmax_dedup.written(minmax_dedup.full_sets(docs, docs.select(docs.doc_id.alias("rep")), params, "text", "doc_id"), "sets")
    rest = sets.select("rep", sets.rep.alias("label"))
    placed = minmax_dedup.written(minmax_dedup.meetings(minmax_dedup.prefixes(rest, sets, params), params), "placed")
    possible = minmax_dedup.possible(placed, sets, params)
    return placed.count(), possible.join(sets, "rep").selectExpr("coalesce(sum(n), 0)").first()[0], minmax_dedup.remaining_links(rest, sets, params)


def test_last_step_of_near_dedup_is_linear_in_texts_that_share_boilerplate(spark):
    params, rng = minmax_dedup.DedupParams(shingle=4), random.Random(6)
    found = {}
    for n in (1000, 2000, 4000):
        rows, hashes, links = _last_step(spark, _family(rng, n, 120, 60) + _family(rng, n // 10, 300, 10)[: n // 20], params)
        found[n] = rows, hashes
        assert len(components(links).collect()) == n // 20  # only those with little of their own are linked
    assert found[4000][0] <= 2.1 * found[2000][0] <= 4.5 * found[1000][0] and found[4000][1] <= 2.1 * found[2000][1] <= 4.5 * found[1000][1]


def test_last_step_of_near_dedup_finds_every_link(spark):
    params, rng = minmax_dedup.DedupParams(shingle=4, group=4), random.Random(7)
    base = _family(rng, 1, 60, 0)[0].split()
    texts = [" ".join(w if rng.random() > p / 100 else f"x{rng.randrange(30)}" for w in base[: rng.randint(40, 60)]) for p in range(5) for _ in range(30)]
    sets = _brute_sets(list(enumerate(texts)), 4)
    want = _brute_components(sets)
    got = {r["id"]: r["component"] for r in components(_last_step(spark, texts, params)[2]).collect()}
    assert {d: got.get(d, d) for d in sets} == want and 2 < len(set(want.values())) < len(texts)


def test_minmax_dedup_of_odd_rows(odd):
    got = minmax_dedup.near_duplicates(odd, minmax_dedup.DedupParams(shingle=4)).collect()
    assert len(got) == odd.count()
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["component_id"], r["kept"]))
    assert by[100] == by[101] == by[102] == {(0, False)} and by[0] == {(0, True)}
    assert by[103] == {(103, True)} and by[110] == {(109, False)} and by[None] == {(0, False), (None, False)}
    kept = minmax_dedup.drop_duplicates(odd, minmax_dedup.DedupParams(shingle=4))
    assert kept.columns == odd.columns and kept.where("doc_id in (100, 101, 102)").count() == 0 and kept.where("doc_id = 0").count() == 1


@pytest.mark.parametrize("shards", [1, 4])
def test_sharding(odd, none, shards):
    got = sharding.shard(odd, sharding.ShardParams(shards=shards, rows_per_bin=7)).collect()
    assert len(got) == odd.count()
    want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in odd.collect())
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(shards))
    assert sharding.shard(none).collect() == []


def test_sharding_keeps_groups_and_balance(spark):
    rng = random.Random(3)
    rows = [(i, f"text {rng.randrange(300)} " + "y" * 40) for i in range(3000)] + [(9000 + i, f"alone {i} " + "z" * rng.randint(1, 80)) for i in range(4000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), sharding.ShardParams(shards=8)).toPandas()
    load = got.groupby("shard")["size"].sum()
    assert load.max() - load.min() <= 200
    texts = dict(rows)
    groups = got[got["doc_id"] < 9000].assign(text=lambda d: d["doc_id"].map(texts)).groupby("text")["shard"].nunique()
    assert (groups > 1).mean() < 0.05


def _vectors(seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(120):
        rows.append((i, rng.normal(size=8).tolist(), int(rng.integers(3))))
    centre = rng.normal(size=8)
    for i in range(40):
        rows.append((200 + i, (centre + rng.normal(size=8) * 0.12).tolist(), 1))
    rows += [(300, rows[0][1], rows[0][2]), (301, [2 * x for x in rows[0][1]], rows[0][2]), (302, rows[0][1], None), (303, None, 1), (304, [0.0] * 8, 1)]
    rows += [(305, [float("nan")] + [1.0] * 7, 1), (306, [None] + [1.0] * 7, 1), (307, [1.0, 2.0], 1), (308, [1.0, 2.0], 1), (309, [], 1), (310, [float("inf")] + [1.0] * 7, 1)]
    return rows


def test_pq_dedup(spark):
    rows = _vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    links, comp = defaultdict(set), {i: i for i, _, _ in rows}
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)]
    for i, v, a in good:
        for j, w, b in good:
            if i != j and a == b and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.98:
                links[i].add(j)
    for _ in rows:
        for i, near in links.items():
            comp[i] = min([comp[i], *(comp[j] for j in near)])
    for params in (pq_dedup.PqParams(), pq_dedup.PqParams(block=5, list_length=8, probes=30)):
        got = {r["vec_id"]: r for r in pq_dedup.near_duplicates(frame, params).collect()}
        assert len(got) == len(rows)
        assert {i: r["n_links"] for i, r in got.items()} == {i: len(links[i]) for i, _, _ in rows}
        assert {i: r["component_id"] for i, r in got.items()} == comp
    assert pq_dedup.near_duplicates(frame.limit(0)).collect() == []


def test_pq_recall_over_many_lists(spark):
    """Of near pairs in a table of many lists, of which a vector visits eight, nearly all are found, and none below the threshold."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = np.where(np.arange(1500) % 3 == 0, 0.979, rng.uniform(0.9801, 1, 1500))[:, None]
    y = cosine * x + np.sqrt(1 - cosine**2) * side
    rows = [(2 * i + k, v[i].tolist(), 1) for i in range(1500) for k, v in enumerate((x, y))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    params = pq_dedup.PqParams(list_length=30)
    quantiser = pq_dedup.fit(pq_dedup.classes_of(frame, "vec_id", "embedding", "label"), params, 64)
    assert np.prod([len(c) for c in quantiser.centroids]) >= 100 and quantiser.places(x).shape[1] == 8
    got = {r["vec_id"]: r["n_links"] for r in pq_dedup.near_duplicates(frame, params).collect()}
    linked = np.array([[got[2 * i], got[2 * i + 1]] for i in range(1500)])
    assert (linked[np.arange(1500) % 3 == 0] == 0).all() and linked.max() == 1
    assert linked[np.arange(1500) % 3 > 0].mean() >= 0.98


def test_pq_agrees_with_all_pairs_on_embeddings(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = frame.toPandas()
    unit = np.array(rows["embedding"].tolist(), float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (rows["label"].to_numpy()[:, None] == rows["label"].to_numpy())
    want = dict(zip(rows["vec_id"], near.sum(1) - 1, strict=True))
    for params in (pq_dedup.PqParams(), pq_dedup.PqParams(list_length=4)):
        got = {r["vec_id"]: r["n_links"] for r in pq_dedup.near_duplicates(frame, params).collect()}
        assert got.keys() == want.keys() and sum(want.values()) >= sum(got.values()) >= 0.99 * sum(want.values())


def test_quality_scores_equal_plain_zstandard():
    import zstandard as zs

    rng = random.Random(15)
    sample = [(_words(rng, rng.randint(20, 900), "alpha beta gamma delta eps zeta"), 1) for _ in range(60)] + [("BUY NOW!! " * rng.randint(5, 400), 0) for _ in range(60)]
    model = quality.fit(sample, quality.QualityParams())
    assert model.slope > 0
    for text in ("", "a", _words(rng, 3000, "alpha beta zeta"), "BUY NOW!! " * 999):
        data, sizes = text.encode(), []
        for raw in (model.good, model.bad):
            tool = zs.ZstdCompressor(level=3, dict_data=zs.ZstdCompressionDict(raw), write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(tool.compress(data[i : i + 2048])) for i in range(0, len(data), 2048)))
        want = 1 / (1 + math.exp(-model.slope * (sizes[1] - sizes[0]) / (len(data) + 64) - model.intercept))
        assert model.probability(np.array([model.difference(data, model.compressors())]))[0] == pytest.approx(want)


def test_quality_on_held_out_documents(spark):
    """The difference of two dictionaries alone ranks held-out documents right."""
    from ledgerloom.llm.queries import op6_quality_classifier

    sf = "/root/testdata/sf0.1"
    got = op6_quality_classifier(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    rank, good = got["score"].rank(), got["quality"] == 1
    auc = (rank[good].mean() - (good.sum() + 1) / 2) / (~good).sum()
    assert auc >= 0.97 and (got["predicted"][good] == 1).mean() >= 0.85 and (got["predicted"][~good] == 0).mean() >= 0.9


def test_quality(spark, odd, none):
    rng = random.Random(5)
    good = [(i, _words(rng, 60, "alpha beta gamma delta eps zeta")) for i in range(80)]
    bad = [(100 + i, ("BUY NOW!! " * rng.randint(5, 40))) for i in range(80)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i, _ in good + bad if i % 4 != 2] + [(7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, quality.QualityParams(docs_per_class=200))
    got = quality.score(docs, model).collect()
    assert np.mean([r["predicted"] == (r["doc_id"] < 100) for r in got if r["doc_id"] % 4 == 2]) >= 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    again = quality.score(odd, model).collect()
    assert len(again) == odd.count() and all(0 <= r["score"] <= 1 for r in again)
    assert len({r["score"] for r in again if not r["text"]}) == 1
    assert quality.score(none, model).collect() == []
    assert quality.train(docs, labels.where("quality = 1")) is None
    assert {r["score"] for r in quality.score(docs, None).collect()} == {0.5}


def test_media_round_trip(odd, none):
    got = iso_media.probe(iso_media.store(odd))
    for r in got.collect():
        data = (r["text"] or "").encode()
        payload = data.ljust(max(1, -(-len(data) // 192)) * 192, b" ")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["codec"] == "raw " and r["n_frames"] == len(payload) // 192 and r["media_error"] is None
        assert len(r["keyframes"]) == -(-r["n_frames"] // 12) and all(k["size"] == 192 for k in r["keyframes"])
    assert iso_media.probe(iso_media.store(none)).collect() == []


def test_media_of_other_makers(spark):
    good = iso_media.mux(b"x" * 192 * 25)
    broken = [good[:100], good[:-5], b"", b"\0\0\0\x08mdat", good.replace(b"stco", b"free"), None]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate([good, *broken])], "doc_id long, media binary")
    errors = {r["doc_id"]: r["media_error"] for r in iso_media.probe(rows).collect()}
    assert errors[0] is None and all(errors[i] for i in range(1, 7))
    wide = iso_media.box(b"free") + good  # a box before the others moves nothing that isn't in the tables
    with pytest.raises(ValueError):
        list(iso_media.walk(good[:-1]))
    assert [p[-1] for p, _, _ in iso_media.walk(wide)][0] == b"free"


def test_targets_by_filling(spark):
    rng = random.Random(6)
    for sizes in ([10, 10, 10], [1, 100, 50, 7, 0], [5], [0, 0], [rng.randrange(1000) for _ in range(23)]):
        names = sorted(f"n{i:02d}" for i in range(len(sizes) - 1)) + [None]
        units = spark.createDataFrame(list(zip(names, sizes, [1] * len(sizes), strict=True)), "source string, size long, n long")
        got = {r["source"]: r["target"] for r in mixing.targets(units).collect()}
        weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
        left, want, free = 1.5 * sum(sizes), {}, set(names)
        cap = dict(zip(names, (2.0 * x for x in sizes), strict=True))
        while free:
            level = left / sum(weight[s] for s in free)
            over = {s for s in free if weight[s] * level > cap[s]}
            for s in over or free:
                want[s] = cap[s] if over else weight[s] * level
            left -= sum(want[s] for s in over)
            free -= over or free
        assert got == pytest.approx(want)


def test_mixing(spark, odd, none):
    one = sorted(mixing.decide(odd, mixing.MixParams(block=8)).collect(), key=str)
    assert one == sorted(mixing.decide(odd.repartition(5), mixing.MixParams(block=8)).collect(), key=str)
    assert all(0 <= r["copies"] <= 2 for r in one) and sum(r["n"] for r in one) == odd.count()
    mixed = mixing.mix(odd, mixing.MixParams(block=8))
    assert mixed.columns == odd.columns
    assert mixed.count() == sum(r["copies"] * r["n"] for r in one)
    assert mixing.decide(none).collect() == [] and mixing.mix(none).collect() == []
    rng = random.Random(7)
    rows = [(i, "w " * min(2000, int(rng.lognormvariate(4, 1))), f"s{i % 5}") for i in range(3000)]
    big = mixing.decide(spark.createDataFrame(rows, "doc_id long, text string, source string"), mixing.MixParams(block=50)).toPandas()
    big["taken"] = big["size"] * big["copies"]
    sums = big.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((sums["taken"] - sums["target"]).abs() <= 0.01 * sums["target"]).all()


def test_landing_tries_all_ends():
    import itertools

    rng = random.Random(18)
    for _ in range(20):
        k = rng.randint(1, 8)
        p, count, size = [rng.uniform(0.01, 0.99) for _ in range(k)], [float(rng.randint(1, 3)) for _ in range(k)], [float(rng.randint(0, 50)) for _ in range(k)]
        miss = lambda e: abs(sum((a - b) * c * d for a, b, c, d in zip(e, p, count, size, strict=True)))  # noqa: B023, E731
        assert miss(mixing.landing(list(p), count, size)) == pytest.approx(min(map(miss, itertools.product((0.0, 1.0), repeat=k))))


@pytest.mark.parametrize("block", [5000, 100])
def test_mixing_of_documents_meets_each_target(spark, block):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = mixing.decide(docs, mixing.MixParams(block=block)).toPandas()
    words = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in docs.collect()}
    assert (got["size"] == got["doc_id"].map(words)).all() and got["n"].sum() == len(words)
    sums = got.assign(taken=got["size"] * got["copies"] * got["n"]).groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((sums["taken"] - sums["target"]).abs() <= 0.001 * sums["target"] + 1).all()


def test_flight_keeps_totals():
    rng = random.Random(8)
    size = sorted((float(rng.randrange(1, 900)) for _ in range(200)), reverse=True)
    p = mixing.flight([0.37] * 200, [1.0] * 200, size, rng)
    held = mixing.graded([0.37] * 200, [1.0] * 200, size, 6)
    assert len(held) == 6 and {i for i, v in enumerate(mixing.flight([0.37] * 200, [1.0] * 200, size, rng, held)) if v == 0.37} == held
    assert sum(p) == pytest.approx(74) and sum(a * b for a, b in zip(p, size, strict=True)) == pytest.approx(0.37 * sum(size))
    assert sum(0 < x < 1 for x in p) <= 2


def test_word_count(odd):
    for r in odd.select("text", word_count(odd["text"]).alias("n")).collect():
        assert r["n"] == len((r["text"] or "").encode().split())


@pytest.fixture(scope="module")
def coder():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_packing(odd, none, coder):
    got = packing.pack_documents(odd, packing.PackingParams(block_pieces=20)).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 2048
    want = Counter()
    for r in odd.collect():
        ids = np.array([*coder.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want.update((r["doc_id"], at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes()), len(ids)) for at in range(0, len(ids), 2048))
    assert Counter((p["doc_id"], p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for ps in pieces.values() for p in ps) == want
    assert packing.pack_documents(none).collect() == []


def test_tokenizers_agree(coder):
    import public_tokenizers
    from hypothesis import given, settings
    from hypothesis import strategies as st

    encode = packing.load_tokenizer(None)

    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=60))
    def check(text):
        assert encode(text).tolist() == coder.encode(text, add_special_tokens=False).ids

    check()
    again = packing.Coder(public_tokenizers.path("byte_bpe_50k.json"), most=5, longest=4)
    parts = [" ", "  ", "\n", " a", "b", "　", "1", "2 ", "'s", "<|endoftext|>", "é", "!", "漢", "\x1c", "\x85", "\t", "longword"]
    rng = random.Random(19)
    for _ in range(500):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert again(text).tolist() == coder.encode(text, add_special_tokens=False).ids
    for text in ("<|endoftext|> a", "  \n\n x　 ", "don't I'LL 'S", " 1 2 3"):
        assert encode(text).tolist() == coder.encode(text, add_special_tokens=False).ids


def test_best_fit_against_a_scan():
    rng = random.Random(9)
    lengths = sorted((rng.randrange(1, 101) for _ in range(400)), reverse=True)
    where, place = packing.best_fit_decreasing(lengths, 100)
    rooms: list[int] = []
    for n, w, p in zip(lengths, where, place, strict=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            assert rooms[w] == min(fit) and p == 100 - rooms[w]
        else:
            assert w == len(rooms) and p == 0
            rooms.append(100)
        rooms[w] -= n


def test_warc_round_trip(spark):
    long, short = "<p>" + "x" * 200, "tiny"
    rows = [(1, "http://a/ b", long), (2, None, long), (3, "http://c", short), (4, "u", short), (5, "u", None), (6, "u", ""), (None, "u", long), (2, "again", long), (7, "ü\n", "é" * 60)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    got = warc.round_trip(pages, payload=True).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] == 2:
            assert (r["record_type"], r["refers_to"], r["payload"], r["payload_bytes"]) == ("revisit", 1, None, 203)
        else:
            assert r["record_type"] == "response" and r["refers_to"] is None and hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"] and len(r["payload"]) == r["payload_bytes"]
    assert {(r["page_id"], bytes(r["payload"]).decode()) for r in got if r["payload"] is not None} == {(p, h or "") for p, _, h in rows if p != 2}
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_warc_reader_refuses_damage():
    import gzip
    import io

    params = warc.WarcParams()
    one, two = (warc.record(i, "u", b"p" * 500, None, params) for i in (1, 2))
    assert [f["X-Page-ID"] for f, _ in warc.records(io.BytesIO(one + two))] == ["1", "2"]
    assert gzip.decompress(one).startswith(b"WARC/1.1\r\n")
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO((one + two)[:-20])))
    bad = gzip.compress(gzip.decompress(one).replace(b"pppp", b"qqqq", 1))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(bad)))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 150), (7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 200: 100, 150: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    packed = corpus_pipeline.run(spark, sf)
    assert packed.count() > 0 and {"doc_id", "sequence_id"} <= set(packed.columns)
    first = corpus_pipeline.identify_language(spark, docs, sf)
    assert first.columns == docs.columns and first.count() == docs.where("text rlike '\\\\p{L}'").count()


def test_pipeline_stages_on_odd_rows(spark, odd, none, tmp_path):
    """Each stage against a plain version, on nulls, repeats, ties, long texts and more columns; and on no rows."""
    import corpus_pipeline

    sf_dir = str(tmp_path)
    labels = [(i, int(i % 3 > 0), 0) for i in range(60)] + [(7, None, None), (None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    rows = odd.collect()
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in list(stages.items())[:-1]:
        assert stage(spark, none, sf_dir).collect() == [] and stage(spark, none, sf_dir).columns == none.columns, name
        assert stage(spark, odd, sf_dir).columns == odd.columns, name
    ids = lambda found: Counter(r["doc_id"] for r in found)
    assert ids(stages["language ID"](spark, odd, sf_dir).collect()) == ids(r for r in rows if any(c.isalpha() for c in r["text"] or ""))
    kept = stages["MinHash near-dedup"](spark, odd, sf_dir).collect()
    sets = _brute_sets([(r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None], 5)
    comp = _brute_components(sets)
    assert ids(kept) == Counter({**{d: 1 for d in sets if comp[d] == d}, None: 2})
    model = quality.train(odd, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    tools = model.compressors()
    good = [r for r in rows if model.probability(np.array([model.difference((r["text"] or "").encode(), tools)]))[0] >= corpus_pipeline.LEAST_QUALITY]
    assert ids(stages["quality classifier"](spark, odd, sf_dir).collect()) == ids(good)
    copies = {(r["doc_id"], r["source"], r["size"]): r["copies"] for r in mixing.decide(odd).collect()}
    want = Counter()
    for r in rows:
        want[r["doc_id"]] += copies[(r["doc_id"], r["source"], len((r["text"] or "").encode().split()))]
    assert ids(stages["mixing sources to target weights"](spark, odd, sf_dir).collect()) == +want
    packed = stages["packing"](spark, odd, sf_dir)
    assert ids(packed.where("start = 0").collect()) == ids(rows) and stages["packing"](spark, none, sf_dir).collect() == []
