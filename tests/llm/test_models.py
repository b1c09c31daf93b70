"""Packing, classifier, LM scoring and the pipeline."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from canopyframe.llm import lm_scoring, packing, quality_classifier
from canopyframe.llm.queries import QUERIES, SQL, TOKENIZER


@pytest.fixture(scope="module")
def ids_of():
    t = Tokenizer.from_file(TOKENIZER)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def check_packing(rows, texts, ids_of, size):
    """Pieces tile every document, sequences are gapless and within ``size``; returns the padding share."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    want = Counter()
    for i, t in texts:
        ids = ids_of(t)
        for a in range(0, len(ids), size):
            part = np.array(ids[a:a + size], "<u4")
            want[i, a, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    total = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        total += at
    assert sorted(sequences) == list(range(len(sequences)))
    return 1 - total / size / max(1, len(sequences))


def test_packing(docs, odd_docs, no_docs, ids_of):
    rows = packing.pack(docs, TOKENIZER).collect()
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert check_packing(rows, texts, ids_of, 2048) < 0.02
    odd = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    check_packing(packing.pack(odd_docs, TOKENIZER, 256).collect(), odd, ids_of, 256)
    assert packing.pack(no_docs, TOKENIZER).count() == 0


def test_word_ids_equal_whole_texts(ids_of):
    texts = ["", " \t", "It's 3pm; don't!", "<|endoftext|> x<|startoftext|>y", "Ångström ΣΑΣ ΣΑΣ. İ", "a b c \x85d", "日本語 テスト 👍🏽👍", "é ́x", "x" * 300]
    import pyarrow as pa

    for limit in (1_500_000, 4):
        w = packing.WordIds(TOKENIZER, limit)
        for _ in range(2):
            for lo, hi, data, bounds in packing.chunks(pa.array(texts * 2), 64):
                start, end, row = packing.words(data, bounds)
                ids, count = w(data, start, end)
                at = 0
                for i, t in enumerate((texts * 2)[lo:hi]):
                    n = int(count[row == i].sum())
                    assert ids[at:at + n].tolist() == ids_of(t)[:-1]
                    at += n


def test_cutting_stock_is_optimal():
    rng = np.random.default_rng(1)
    for room, n in ((64, 500), (256, 3000), (10, 7)):
        demand = np.bincount(rng.integers(1, room, n), minlength=room)
        weight = np.flatnonzero(demand)
        columns, use = packing.cutting_stock(weight, demand[weight].astype(float), room, gap=0.0, rounds=5000)
        assert np.allclose(columns @ use, demand[weight]) and (weight @ columns <= room).all()
        price = np.ones(len(weight)) @ np.linalg.inv(columns)
        value = packing.knapsack(np.maximum(price, 0), weight, room)[0]
        assert use.sum() <= price @ demand[weight] / value * 1.002 + 1e-6  # Farley's bound
        # The default gap is kept too.
        rough = packing.cutting_stock(weight, demand[weight].astype(float), room)[1].sum()
        assert rough <= use.sum() * 1.01


def test_knapsack_by_trying():
    rng = np.random.default_rng(5)
    for _ in range(50):
        weight = rng.choice(np.arange(2, 12), 4, replace=False)
        value = rng.random(4)
        best = [0.0] * 31
        for c in range(31):
            best[c] = max([best[c - 1] if c else 0.0, *(best[c - w] + v for w, v in zip(weight, value) if w <= c)])
        got, count = packing.knapsack(value, weight, 30)
        assert abs(got - best[30]) < 1e-9 and abs(count @ value - got) < 1e-9 and count @ weight <= 30


def test_ranked(spark):
    from canopyframe.session import cut

    df = cut(spark.range(5000).selectExpr("id", "cast(if(id % 3 = 0, 1, id % 7) as int) as g").repartition(6))
    got = defaultdict(list)
    for r in packing.ranked(df, "g", "rank", 7).collect():
        got[r.g].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in got.values()) and sum(map(len, got.values())) == 5000


def test_classifier(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_classifier.classified(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.score, quality[r.doc_id]) for r in rows if r.held_out and r.doc_id in quality]
    good, poor = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert sum(a > b for a in good for b in poor) / (len(good) * len(poor)) > 0.97
    # Neither other columns nor held-out labels move a score.
    other = labels.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_classifier.classified(docs.drop("lang", "source"), other).collect()
    assert {r.doc_id: r.score for r in again} == pytest.approx({r.doc_id: r.score for r in rows})
    none = labels.filter("false")
    assert {r.score for r in quality_classifier.classified(odd_docs, none).collect()} == {0.5}
    assert quality_classifier.classified(no_docs, labels).count() == 0
    only = spark.createDataFrame([(6, 1, 0), (6, None, 0), (None, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert quality_classifier.classified(odd_docs, only).count() == odd_docs.count()


def test_classifier_sample(spark):
    """Exactly the least places, repeated rows once, fewer rows where texts are long; a third of all rows are one."""
    docs = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "same").when(F.col("id") % 3 == 1, F.repeat(F.lit("ab "), F.lit(1000))).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(5, None), (5, "")], "doc_id bigint, text string"))
    rows = docs.withColumn("y", (F.col("doc_id") % 2).cast("int")).repartition(5)
    place = F.shiftrightunsigned(F.xxhash64(F.lit(3), "doc_id", "text"), 1)
    every = sorted((r.place, len((r.text or "").encode())) for r in rows.select("doc_id", "text", place.alias("place")).distinct().collect())
    for n in (1, 100, 1500, 9000):
        got = quality_classifier.drawn_rows(rows, n).collect()
        assert sorted(r.place for r in got) == [p for p, _ in every[:n]]
    total, want = 0, []
    for p, size in every:
        total += size
        if total > 1 << 20:
            break
        want.append(p)
    got = quality_classifier.drawn_rows(rows, 9000, 1 << 20).collect()
    assert 100 < len(want) < len(every) and sorted(r.place for r in got) == want
    assert quality_classifier.drawn_rows(rows.filter("false")).count() == 0


def test_descent_separates():
    rng = np.random.default_rng(9)
    cells = [np.unique(rng.integers(0, 400, 30)) for _ in range(300)]
    y = np.array([1 if (c < 40).sum() > 2 else -1 for c in cells])
    w, b = quality_classifier.descend(cells, [np.full(len(c), 1 / math.sqrt(len(c))) for c in cells], y, c=50.0, epochs=60)
    margin = np.array([w[c].sum() / math.sqrt(len(c)) + b for c in cells])
    assert ((margin > 0) == (y > 0)).mean() > 0.97


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def test_lm_scores(spark, odd_docs, no_docs, docs, folder):
    """Against dictionaries over the same hashed vocabulary."""
    import pyarrow as pa

    target = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 1 and toxic = 0").collect()}
    for d, ids in ((docs, target), (odd_docs, {6, 20, 32})):
        rows = [tuple(r) for r in d.select("doc_id", "text").collect()]
        vocabulary = sorted({w for _, t in rows for w in words(t)})
        cells = []
        for _, _, data, bounds in lm_scoring.chunks(pa.array(vocabulary)):
            cells += lm_scoring._word_cells(data, bounds, None)[0].tolist()
        cell = dict(zip(vocabulary, cells))
        count = Counter(cell[w] for _, t in rows for w in words(t))
        unknown = lm_scoring.WORD_CELLS - 1
        known = {c for c, n in count.items() if n >= 2}
        tokens = [[cell[x] if cell[x] in known else unknown for x in words(t)] for _, t in rows]

        def pairs(w):
            return lm_scoring._pair_cells(np.array(w, np.int64), np.zeros(len(w), np.int64)).tolist()

        model = []
        for mine in (lambda i: i in ids, lambda i: True):
            one, two = Counter(), Counter()
            for (i, _), w in zip(rows, tokens):
                if mine(i):
                    one.update(w)
                    two.update(pairs(w))
            model.append((one, two, max(1, sum(one.values()))))
        a, b, c = lm_scoring.WEIGHTS

        def loss(w, k):
            one, two, total = model[k]
            before = [total, *[one[x] for x in w[:-1]]]
            return [-math.log(a * min(1.0, two[p] / max(1, h)) + b * one[x] / total + c / (len(known) + 1)) for p, h, x in zip(pairs(w), before, w)]

        want = Counter()
        for (i, _), w in zip(rows, tokens):
            want[i, len(w), round(sum(x - y for x, y in zip(loss(w, 0), loss(w, 1))) / max(1, len(w)), 5)] += 1
        listed = spark.createDataFrame([(i,) for i in [*ids, *ids, None]], "doc_id bigint")
        got = Counter((r.doc_id, r.n_tokens, round(r.ce_difference, 5)) for r in lm_scoring.scored(d, listed).collect())
        assert sum((got & want).values()) >= 0.99 * len(rows) and sum(got.values()) == len(rows)
    assert lm_scoring.scored(no_docs, listed).count() == 0
    assert lm_scoring.scored(odd_docs, listed.filter("false")).filter("ce_difference is null or isnan(ce_difference)").count() == 0


def test_lm_counts_are_exact(spark):
    """Against dictionaries of the words themselves, with far more pairs than the 2^20 cells kept before."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 60_000, 2000))) for i in range(800)]
    ids = set(range(0, 800, 9))
    one, two = [Counter(), Counter()], [Counter(), Counter()]
    for i, t in rows:
        w = words(t)
        for k in ([0, 1] if i in ids else [1]):
            one[k].update(w)
            two[k].update(zip([None, *w], w))
    assert len(two[1]) > 1 << 20
    known = {w for w, n in one[1].items() if n >= 2}
    assert len(known) == len(one[1])
    a, b, c = lm_scoring.WEIGHTS
    want = {}
    for i, t in rows:
        w = words(t)
        loss = [0.0, 0.0]
        for k in (0, 1):
            total = sum(one[k].values())
            for x, y in zip([None, *w], w):
                history = total if x is None else one[k][x]
                loss[k] -= math.log(a * two[k][x, y] / max(1, history) + b * one[k][y] / total + c / (len(known) + 1))
        want[i] = (loss[0] - loss[1]) / len(w)
    listed = spark.createDataFrame([(i,) for i in ids], "doc_id bigint")
    got = {r.doc_id: r.ce_difference for r in lm_scoring.scored(spark.createDataFrame(rows, "doc_id bigint, text string"), listed).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_lm_scores_do_not_depend_on_what_is_broadcast(spark, odd_docs, docs, monkeypatch):
    """Words and pairs beyond the broadcast ones take the joins, with equal scores; tasks that send often as well."""
    listed = spark.createDataFrame([(6,), (20,), (10,), (1000,)], "doc_id bigint")
    for d in (odd_docs, docs.select("doc_id", "text").limit(300).unionByName(odd_docs.select("doc_id", "text"))):
        d = d.select("doc_id", "text").cache()
        want = sorted(map(repr_of, lm_scoring.scored(d, listed).collect()))
        for table in (0, 40):
            with monkeypatch.context() as m:
                m.setattr(lm_scoring, "FLUSH", 500)
                m.setattr(lm_scoring, "PIECE_TOKENS", 1000)
                assert sorted(map(repr_of, lm_scoring.scored(d, listed, table=table).collect())) == want
    words_left = lm_scoring.common_words(spark.createDataFrame([(5, 9, 1), (6, 2, 0), (-1, 12, 1)], "word bigint, n bigint, nt bigint"), 1)
    assert (words_left.key.tolist(), words_left.whole, words_left.known, words_left.rare) == ([5], False, 2, 1)


def repr_of(r):
    return (repr(r.doc_id), r.n_tokens, round(r.ce_difference, 8) + 0.0)


def test_lm_packing_of_pairs():
    rng = np.random.default_rng(3)
    columns = [rng.integers(0, 1 << 62, 1000), rng.integers(0, 5, 1000), np.zeros(1000, np.int64)]
    for n in (1000, 1, 0):
        assert all((x == y[:n]).all() for x, y in zip(lm_scoring._unpack(lm_scoring._pack(*(c[:n] for c in columns)), 3), columns))
    assert [lm_scoring._first_kept({1: 10, 3: 4, 9: 1}, t) for t in (0, 1, 5, 14, 15)] == [512, 8, 2, 2, 1]


def test_lm_pairs_by_number():
    """Keys of pairs of broadcast words are exact and even, give the words back and are sent in few bytes."""
    rng = np.random.default_rng(5)
    for size in (0, 1, 40, 1 << 20):
        key = np.unique(rng.integers(0, 1 << 62, size))
        w = lm_scoring.Words(key, key, key, True, 1, size, 1, 1, 0, 0)
        before, word = rng.integers(-2, len(key), 3000), np.append(rng.integers(-2, len(key), 2999), -2)
        before[-1] = -2
        pair = w.pairs(before, word)
        assert (pair & 1 == 0).all() and (pair >= 0).all() and (pair < lm_scoring.WORD_CELLS).all()
        assert all((x == y).all() for x, y in zip(w.codes(pair), (before, word)))
        assert len(np.unique(pair)) == len({*zip(before.tolist(), word.tolist())})
        wanted = np.concatenate([key[::3], rng.integers(0, 1 << 62, 500), np.array([0, (1 << 62) - 1])])
        at, hit = w.places.found(wanted)
        assert (hit == np.isin(wanted, key)).all() and (key[at[hit]] == wanted[hit]).all()
        order, first = lm_scoring._groups(pair)
        assert (order == np.argsort(pair, kind="stable")).all() and (pair[order[first]] == np.unique(pair)).all()
        blob = lm_scoring._pack_keys(pair[order], 0, before)
        assert blob[0] >= lm_scoring.HASH_BITS - w.pair_bits
        assert all((x == y).all() for x, y in zip(lm_scoring._unpack_keys(blob, 0, 2), (pair[order], before)))
    n = 1 << 16
    words_of = rng.integers(0, len(key), (2, n))
    hashed = np.sort(lm_scoring._pair_hashes(*words_of))
    assert len(lm_scoring._pack_keys(np.sort(w.pairs(*words_of)), 0)) < 0.7 * len(lm_scoring._pack(np.diff(hashed, prepend=0)))
    # Pairs with another word are odd, so the two kinds never meet.
    assert lm_scoring._unpack_keys(lm_scoring._pack_keys(np.array([3, 7]), 0), 0, 1)[0].tolist() == [3, 7]


def test_pipeline(spark, folder, docs, ids_of):
    """Every stage by the operators' own brute force; here their order, columns and counts."""
    import corpus_pipeline as C

    names = [n for n, _ in C.STAGES]
    assert names == ["quality_rules", "line_dedup", "ngram_jaccard_join", "mixing", "packing"] and C.ORACLE_SQL is None
    d = docs
    for name, stage in C.STAGES[:-1]:
        before, d = d, spark.createDataFrame(stage(spark, d, folder).collect(), docs.schema)
        assert d.columns == before.columns
        assert name == "mixing" or d.count() <= before.count()
        assert d.filter("n_chars <> char_length(text)").count() == 0
    rows = C.run(spark, folder).collect()
    check_packing(rows, [tuple(r) for r in d.select("doc_id", "text").collect()], ids_of, 2048)


def test_pipeline_of_nothing(spark, no_docs, folder):
    import corpus_pipeline as C

    d = no_docs
    for _, stage in C.STAGES:
        d = stage(spark, d, folder)
    assert d.count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, folder, name):
    import check

    assert check.compare(QUERIES[name](spark, folder), check.connect(folder), SQL[name]).startswith("ok")
