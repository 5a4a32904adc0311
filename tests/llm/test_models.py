import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest


from itemloom.llm import context_mixing, language_id, vantage_search

SF = "/root/testdata/sf0.001"


def test_language_id_on_held_out_documents(spark):
    from itemloom.llm.registry import QUERIES

    got = {r["doc_id"]: r for r in QUERIES["op10_language_id"](spark, SF).collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got.keys() == truth.keys()
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i in got if got[i]["held_out"]} == set(held)
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_id_of_odd_texts(spark, table):
    learn = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "und", None)], "doc_id long, text string, lang string")
    model = language_id.train(learn)
    assert model.langs == ["de", "en"]
    odd = [(1, None), (2, ""), (3, "123 !?"), (4, "THE DOG"), (5, "und die " * 50_000), (6, "ß"), (None, "the and"), (4, "THE DOG")]
    got = sorted((str(r["doc_id"]), r["lang_pred"]) for r in language_id.predict(table(odd).drop("lang"), model).collect())
    assert [x for x in got if x[0] in ("1", "2", "3")] == [("1", "und"), ("2", "und"), ("3", "und")]
    assert got.count(("4", "en")) == 2 and ("5", "de") in got and ("None", "en") in got
    empty = language_id.train(learn.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(table(odd), empty).collect()} == {"und"}
    assert language_id.predict(table([]), model).count() == 0
    clash = language_id.predict(table(odd).withColumnRenamed("score", "lang_pred"), model)
    assert clash.columns.count("lang_pred") == 1 and ("4", "en") in {(str(r["doc_id"]), r["lang_pred"]) for r in clash.collect()}


def plain_bayes(learn, texts):
    """Language and posterior share of each text, from counts in dictionaries and a prior by documents."""
    mask = (1 << 64) - 1

    def bucket(gram):  # the operator's hash of an n-gram
        x = (sum(ord(c) << 21 * (len(gram) - 1 - j) for j, c in enumerate(gram)) + (len(gram) << 60)) & mask
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return ((x ^ (x >> 31)) >> 40) % language_id.N_BUCKETS

    def grams(text):
        flat = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
        return [bucket(flat[i : i + n]) for n in (1, 2, 3) for i in range(len(flat) - n + 1)]

    counts, docs = {}, Counter()
    for text, lang in learn:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(grams(text))
            docs[lang] += 1
    total, out = {lang: sum(c.values()) for lang, c in counts.items()}, []
    for text in texts:
        if not text or not any(c.isalpha() for c in text):
            out.append(("und", 0.0))
            continue
        log = {lang: math.log(docs[lang] / sum(docs.values())) for lang in sorted(counts)}
        for g in grams(text):
            for lang in log:
                log[lang] += math.log((counts[lang][g] + 0.5) / (total[lang] + 0.5 * language_id.N_BUCKETS))
        best = max(log, key=log.get)
        out.append((best, 1 / sum(math.exp(x - log[best]) for x in log.values())))
    return out


def test_language_id_against_plain_bayes(spark):
    from itemloom.llm.registry import QUERIES

    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    expected = plain_bayes([(t, lang) for i, t, lang in docs if zlib.crc32(str(i).encode()) % 4 != 2], [t for _, t, _ in docs])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in QUERIES["op10_language_id"](spark, SF).collect()}
    for (i, _, _), (lang, score) in zip(docs, expected):
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=1e-3), i


def test_languages_with_more_documents_are_likelier(spark, table):
    learn = [("same words", "b")] * 5 + [("same words", "a")] * 2 + [("andere", "c")]
    model = language_id.train(spark.createDataFrame([(i, *x) for i, x in enumerate(learn)], "doc_id long, text string, lang string"))
    assert np.allclose(np.exp(model.prior), [2 / 8, 5 / 8, 1 / 8])
    for text, (lang, score) in zip(["words", "s"], plain_bayes(learn, ["words", "s"])):
        r = language_id.predict(table([(1, text)]).drop("lang"), model).first()
        assert r["lang_pred"] == lang == "b" and r["lang_score"] == pytest.approx(score, abs=1e-5)


LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def test_base_scores_against_brute_force(spark, table, prose):
    pairs = [(i, prose(30 + i, i)) for i in range(60)] + [(100, None), (101, ""), (102, "Word word WORD ſ"), (103, "y" * 150_000), (None, "word"), (5, prose(35, 5))]
    got = {}
    for r in context_mixing.score_texts(table(pairs)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    words = [(i, (t or "").encode().translate(LOWER).split() + ["END"]) for i, t in pairs]
    counts = Counter(w for i, ws in words if i is not None and zlib.crc32(str(i).encode()) % 10 for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    assert sum(map(len, got.values())) == len(pairs)
    for i, ws in words:
        for r in got[i]:
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), total)
            assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws))
            assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 10 == 0)
            assert r["score"] < 0


def test_bits_are_probabilities_and_learning_helps():
    rng = random.Random(1)
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(3000)).encode()
    raw = np.frombuffer(text, np.uint8)
    keys, _ = context_mixing.grams(raw, np.array([0, len(raw)]))
    blank = context_mixing.Mixer([np.zeros(1 << b, np.float16) for b in context_mixing.CELL_BITS])
    import pyarrow as pa

    from itemloom.llm._packed import squeeze

    distinct, counts = np.unique(keys, return_counts=True)
    cells = context_mixing._to_cells(None, pa.table({"packed": [squeeze(np.diff(distinct.view(np.int64), prepend=0), counts)]}))
    tables = [np.zeros(1 << b, np.float16) for b in context_mixing.CELL_BITS]
    for chunk, packed in zip(cells.column("chunk").to_pylist(), cells.column("packed").to_pylist()):
        order, part = divmod(chunk, 1 << 16)
        values = np.frombuffer(context_mixing._log_odds((pa.scalar(chunk),), pa.table({"packed": [packed]})).column("cells")[0].as_py(), np.float16)
        tables[order][part << 16 : (part << 16) + len(values)] = values
    mixer = context_mixing.Mixer(tables)
    before = mixer.bits(keys).sum()
    for _ in range(2):
        mixer.learn(keys, 0.005)
    after = mixer.bits(keys).sum()
    assert before < 0.2 * blank.bits(keys).sum() and after < 1.02 * before
    # the probabilities of all 256 continuations of a context add up to one
    context = np.uint64(int(keys[50]) >> 8 << 8)
    assert (2.0 ** -mixer.bits(context + np.arange(256, dtype=np.uint64))).sum() == pytest.approx(1, abs=1e-4)
    scorer = context_mixing.Scorer(mixer)
    assert np.allclose(scorer.bits(keys), mixer.bits(keys)) and np.allclose(scorer.bits(keys), mixer.bits(keys))


def test_mixer_learns_from_all_of_its_fold_and_tables_get_it(spark, table, prose):
    fold_of = lambda i: zlib.crc32(str(i).encode()) % 10
    mine = [i for i in range(400) if fold_of(i) == 1][:12]
    pairs = [(i, prose(40, i)) for i in range(60) if fold_of(i) > 1] + [(i, prose(3500, i) + f" zqx{i}jv") for i in mine]
    assert all(len(t) > 20_000 for i, t in pairs if i in mine)
    mixer = context_mixing.train(table(pairs))
    assert mixer.by_bits.any() and (mixer.by_reach != 0.25).any()
    for i in mine:  # the last word stands in no other text
        raw = np.frombuffer(f" zqx{i}jv".encode(), np.uint8)
        keys = context_mixing.grams(raw, np.array([0, len(raw)]))[0][7:8]
        assert mixer.tables[6][context_mixing._cells(6, context_mixing._context(keys, 6), np.uint64(1))].all()
    again = context_mixing.train(table(pairs).repartition(7))
    assert all((a == b).all() for a, b in zip(mixer.values() + mixer.tables, again.values() + again.tables))


def test_every_byte_of_the_fold_is_learned_once(spark, table, prose, monkeypatch):
    pairs = [(i, prose(30 + i, i)) for i in range(3000, 6000)]
    seen, average = [], context_mixing._average
    monkeypatch.setattr(context_mixing, "MIX_BYTES", 20_000)
    monkeypatch.setattr(context_mixing, "_average", lambda results, start: seen.extend(results) or average(results, start))
    pairs = [(i, t[: 400 + i % 300]) for i, t in pairs]
    context_mixing.train(table(pairs))
    own = [len(t) + 1 for i, t in pairs if zlib.crc32(str(i).encode()) % 10 == 1]
    assert len(own) > 256 and sum(r["bytes"] for r in seen) == sum(own)
    assert len({r["group"] for r in seen}) > 1


class PlainMixer:
    """The model bit by bit: counts in dictionaries, texts of one group, learned in the operator's order and steps."""

    def __init__(self, texts, mixer_texts):
        self.counts = {}
        self.add(texts)
        n = context_mixing.ORDERS
        self.reach = {(g, j): 0.25 for g in range((n + 1) * n) for j in range(n)}
        self.node = {(g, j): 0.0 for g in range(256) for j in range(n)}
        self.fine = {(g, b): 1 / (1 + math.exp(-(-8 + b / 2))) for g in range(256) for b in range(33)}
        before = 0
        for some in mixer_texts:
            size, codes = 0, [c for t in some for c in self.codes(t)]
            while size < len(codes):
                done = before + size
                step = min(max(256, done >> 6), 4096)
                for at in range(size, min(size + 16 * step, len(codes)), step):
                    self.learn(codes[at : min(at + step, size + 16 * step)], 0.005 / (1 + done / 40_000) + 0.001)
                size = min(size + 16 * step, len(codes))
            before += size
        self.add(t for some in mixer_texts for t in some)

    @staticmethod
    def codes(text):
        raw = bytes(6) + (text or "").encode() + b"\xff"
        return [(raw[i - 6 : i], raw[i]) for i in range(6, len(raw))]

    @staticmethod
    def cell(order, context, node):
        value = np.array([int.from_bytes(context[6 - order :], "big")], np.uint64)
        return order, int(context_mixing._cells(order, value, np.uint64(node))[0])

    def add(self, texts):
        for t in texts:
            for context, byte in self.codes(t):
                for bit in range(8):
                    for k in range(context_mixing.ORDERS):
                        own = self.counts.setdefault(self.cell(k, context, (1 << bit) | (byte >> (8 - bit))), [0, 0])
                        own[1 - (byte >> (7 - bit) & 1)] += 1

    def inputs(self, context, byte, bit):
        node, x = (1 << bit) | (byte >> (8 - bit)), []
        for k in range(context_mixing.ORDERS):
            one, zero = self.counts.get(self.cell(k, context, node), (0, 0))
            odds = math.log((one + 0.2) / (zero + 0.2)) if one + zero else 0.0
            x.append(float(np.float16(2.0**-14 if one + zero and odds == 0 else odds)))
        reach = max((k + 1 for k in range(context_mixing.ORDERS) if x[k]), default=0)
        place = next((k for k in range(6) if context[5 - k] <= 32), 6)
        mixed = sum(x[j] * (self.reach[reach * 7 + place, j] + self.node[node, j]) for j in range(7))
        return x, reach * 7 + place, node, min(max(mixed, -12), 12), byte >> (7 - bit) & 1

    def learn(self, codes, rate):
        for bit in range(8):
            moves = []
            for context, byte in codes:
                x, gate, node, mixed, y = self.inputs(context, byte, bit)
                spot = (min(max(mixed, -8), 8) + 8) * 2
                low = min(int(spot), 31)
                moves.append((x, gate, node, rate * (y - 1 / (1 + math.exp(-mixed))), low + (spot - low > 0.5), y))
            for at, weights in ((1, self.reach), (2, self.node)):
                n = Counter(m[at] for m in moves)
                for m in moves:
                    for j in range(7):
                        weights[m[at], j] += m[3] * m[0][j] / math.sqrt(n[m[at]])
            seen = {}
            for m in moves:
                seen.setdefault((m[2], m[4]), []).append(m[5])
            for spot, ys in seen.items():
                self.fine[spot] += (1 - 0.99 ** len(ys)) * (sum(ys) / len(ys) - self.fine[spot])
                self.fine[spot] = min(max(self.fine[spot], 1e-4), 1 - 1e-4)

    def score(self, text):
        total = 0.0
        for context, byte in self.codes(text):
            for bit in range(8):
                _, _, node, mixed, y = self.inputs(context, byte, bit)
                spot = (min(max(mixed, -8), 8) + 8) * 2
                low = min(int(spot), 31)
                fine = self.fine[node, low] * (low + 1 - spot) + self.fine[node, low + 1] * (spot - low)
                p = min(max(0.5 / (1 + math.exp(-mixed)) + 0.5 * fine, 1e-5), 1 - 1e-5)
                total += math.log10(p if y else 1 - p)
        return total


def test_scores_against_a_plain_model(spark, table, prose):
    fold_of = lambda i: -1 if i is None else zlib.crc32(str(i).encode()) % 10
    pairs = [(i, prose(6 + i % 9, i)) for i in range(90)] + [(200, None), (201, ""), (None, "aside"), (7, prose(13, 7)), (206, None), (207, "")]
    hashes = {(r["doc_id"], r["text"]): r["h"] for r in table(pairs).selectExpr("doc_id", "text", "xxhash64(doc_id, text) AS h").collect()}
    mine = sorted((p for p in pairs if fold_of(p[0]) == 1), key=lambda p: (hashes[p], p[0], p[1] or ""))
    rounds = [[t for i, t in mine if hashes[i, t] % context_mixing.MIX_ROUNDS == r] for r in range(context_mixing.MIX_ROUNDS)]
    assert len(mine) > 6 and all(rounds)
    plain = PlainMixer([t for i, t in pairs if fold_of(i) > 1], rounds)
    got = context_mixing.score_texts(table(pairs)).collect()
    assert len(got) == len(pairs)
    text_of = dict(pairs)
    for r in got:
        assert r["score"] == pytest.approx(plain.score(text_of[r["doc_id"]]), rel=2e-3, abs=2e-3), r["doc_id"]
        assert r["bits_per_byte"] == pytest.approx(-r["score"] * math.log2(10) / (len((text_of[r["doc_id"]] or "").encode()) + 1))


def test_tasks_of_a_worker_share_what_was_scored(prose, monkeypatch):
    import pyarrow as pa

    mixer, asked = context_mixing.Mixer([np.zeros(1 << b, np.float16) for b in context_mixing.CELL_BITS]), []
    monkeypatch.setattr(mixer, "bits", lambda keys: asked.append(len(keys)) or np.ones(len(keys)))
    monkeypatch.setattr(context_mixing.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 3})())
    shared = type("Shared", (), {"value": (mixer, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0))})
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "held_out": [False, True], "text": [prose(40, 1), prose(40, 2)]})
    scores = [next(context_mixing._score(iter([batch]), shared, 8)).column("score").to_pylist() for _ in range(3)]
    assert scores[0] == scores[1] == scores[2] and all(scores[0])
    padded = ["\0" * 6 + t + "\xff" for t in batch["text"].to_pylist()]
    assert sum(asked) < 1.5 * len({t[i : i + 7] for t in padded for i in range(len(t) - 6)})


def test_empty_corpus(table):
    assert context_mixing.score_texts(table([])).count() == 0


def exact(ids, vectors, queries, k):
    out = []
    for q in queries:
        v = vectors[ids == q][0]
        score, other = (vectors * v).sum(axis=1), ids != q
        order = np.lexsort((ids[other], -score[other]))[:k]
        out += [(int(q), n + 1, int(ids[other][j]), float(score[other][j])) for n, j in enumerate(order)]
    return out


def test_search_is_exact_with_factor_one(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(700, 8))
    vectors[100:300] = vectors[100]  # a third are equal: ties go to the smaller id
    ids = rng.permutation(700).astype(np.int64)
    rows = [(int(i), v.tolist(), "x") for i, v in zip(ids, vectors)]
    rows += [(800, None, "x"), (820, [0.0] * 8, "x"), (840, [float("nan")] * 8, "x"), (860, [None] * 8, "x"), (880, [float("inf")] + [1.0] * 7, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = sorted(tuple(r) for r in vantage_search.nearest(df, df.where("vec_id % 20 = 0")).collect())
    assert got == sorted(exact(ids, vectors, [i for i in ids if i % 20 == 0], 20))


def test_search_is_exact_on_ties(spark, monkeypatch):
    """Distinct vectors with one score, small integers, sums that products round otherwise, over several shards and steps."""
    monkeypatch.setattr(vantage_search, "SHARD_ROWS", 900)
    rng = np.random.default_rng(11)
    level = rng.normal(size=(400, 6))
    level[:, 0] = 1.0
    level[0] = [1, 0, 0, 0, 0, 0]  # scores 1 with all of them
    whole = rng.integers(-2, 3, size=(3000, 6)).astype(float)
    whole = whole[(whole != 0).any(axis=1)]
    near = np.tile(rng.normal(size=6), (300, 1)) * (1 + rng.integers(-2, 3, size=(300, 1)) * 2.0**-52)
    for vectors, every in ((level, 400), (whole, 100), (np.concatenate([whole[:500], near]), 40)):
        ids = np.arange(len(vectors))
        df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>")
        got = sorted(tuple(r) for r in vantage_search.nearest(df, df.where(f"vec_id % {every} = 0")).collect())
        assert got == sorted(exact(ids, vectors, ids[::every], 20))


def test_search_of_repeated_rows_and_other_lengths(spark, monkeypatch):
    rows = [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (1, [2.0, 9.0]), (1, [2.0, 9.0]), (2, [1.0, 1.0, 1.0]), (3, [4.0]), (4, [0.5, 0.0]), (4, [0.5, 0.0]), (None, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(vantage_search, "QUERY_BLOCK", 1)
    got = sorted(tuple(r) for r in vantage_search.nearest(df, df.where("vec_id IN (0, 2, 4)")).collect())
    assert got == [(0, 1, 1, 20.0), (0, 2, 4, 0.5), (4, 1, 1, 1.0), (4, 2, 0, 0.5)]


def test_search_query_on_its_whole_table(spark):
    from itemloom.llm.registry import QUERIES

    rows = [r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r["embedding"] and all(x is not None and math.isfinite(x) for x in r["embedding"]) and any(r["embedding"])]
    ids, vectors = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    got = sorted(tuple(r) for r in QUERIES["op9_vantage_search"](spark, SF).select("query_id", "rank", "vec_id", "score").collect())
    assert got == sorted(exact(ids, vectors, [i for i in ids if i % 20 == 0], 20)) and got


def test_relaxed_search_keeps_recall(spark):
    from itemloom.llm.vantage_search import Tree, search_shard

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    vectors = centres[rng.integers(0, 30, 3000)] + 0.2 * rng.normal(size=(3000, 16))
    ids = np.arange(3000)
    truth = {}
    for q, _, i, _ in exact(ids, vectors, ids[::100], 10):
        truth.setdefault(q, set()).add(i)
    top = np.sqrt((vectors**2).sum(axis=1).max())
    for factor, least in ((1.0, 1.0), (1.5, 0.9)):
        found = {int(q): set(i.tolist()) for q, i, _ in search_shard(ids, vectors, ids[::100], vectors[::100], top, 10, factor)}
        assert np.mean([len(found[q] & truth[q]) / 10 for q in truth]) >= least
    assert sum(len(r) for r, _ in Tree(vectors).leaves) == 3000


def test_search_of_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in vantage_search.nearest(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 0.0)]
    assert vantage_search.nearest(df.limit(0), df.limit(0)).count() == 0
