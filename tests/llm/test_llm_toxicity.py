import pickle
import random
import tracemalloc

import numpy as np

from helpers import by_id, documents, odd_texts
from tillbook.llm import toxicity
from tillbook.llm.toxicity import _calibrated, _threshold, learn, predict, score, train

BAD = ["idiot", "trash", "moron"]


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(300)]
    rows = []
    for i in range(n):
        toxic, lang = rng.random() < 0.25, rng.choice(["en", "de"])
        found = rng.choices(vocabulary[:150] if lang == "en" else vocabulary[150:], k=rng.randint(5, 200))
        if toxic:
            found.insert(rng.randrange(len(found)), rng.choice(BAD) if lang == "en" else "chlla" + rng.choice(vocabulary))
        rows.append((i, " ".join(found), lang, int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(1500, 5)
    frame = documents(spark, [(i, t, lang, "s") for i, t, lang, _ in rows], extra="score toxic _id")
    labels = spark.createDataFrame([(i, toxic) for i, _, _, toxic in rows if i % 3], "doc_id long, toxic int")
    found = by_id(score(frame, learn(frame, labels)), "predicted", "score")
    right = [found[i][0] == toxic for i, _, _, toxic in rows if i % 3 == 0]
    assert np.mean(right) > 0.95
    assert all((p == 1) == (s >= 0.5) and 0 <= s <= 1 for p, s in found.values())


def test_long_texts_go_through_in_pieces(monkeypatch):
    rows = corpus(600, 7)
    model = train([t for _, t, _, _ in rows], [y for *_, y in rows], [lang for _, _, lang, _ in rows])
    texts = [" ".join(t for _, t, _, _ in rows[:150]), "", None, rows[3][1]]
    whole = predict(model, texts, {})
    monkeypatch.setattr(toxicity, "PIECE", 50)
    pieces = predict(model, texts, {})
    assert np.allclose(whole[0], pieces[0])


def test_odd_rows_and_empty_tables(spark):
    rows = corpus(300, 9)
    frame = documents(spark, [(i + 100, t, lang, "s") for i, t, lang, _ in rows] + odd_texts_rows())
    labels = spark.createDataFrame(
        [(i + 100, y) for i, _, _, y in rows] + [(1, 1), (2, 0), (None, 1), (5, None), (100, 1), (100, 1)], "doc_id long, toxic int"
    )
    result = score(frame, learn(frame, labels))
    assert result.count() == frame.count()
    assert result.where("score IS NULL OR score < 0 OR score > 1 OR isnan(score)").count() == 0
    assert score(frame.limit(0), learn(frame, labels)).count() == 0
    assert by_id(score(frame, learn(frame, labels.limit(0))), "score", "predicted")[1] == (0.0, 0)
    assert learn(frame, labels.where("toxic = 1")) is None


def odd_texts_rows():
    return [(i, t, None if i == 5 else "en", "s") for i, t in odd_texts()]


def test_thresholds_and_calibration():
    p = np.array([0.1, 0.2, 0.3, 0.9, 0.95])
    t = _threshold(p, np.array([0, 0, 0, 1, 1]))
    assert 0.3 < t < 0.9
    scores = _calibrated(np.array([0.0, t - 1e-12, t, 1.0]), np.full(4, t))
    assert scores[0] == 0 and scores[1] < 0.5 <= scores[2] and scores[3] == 1


def test_an_id_brings_one_text_to_the_driver(spark, monkeypatch):
    rows = [(1, f"text {i}", "en", "s") for i in range(2000)] + [(2, "another", "en", "s"), (3, "third", None, "s")]
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic, languages: seen.append((texts, toxic, languages)))
    learn(documents(spark, rows), spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int"))
    assert seen == [(["text 0", "another", "third"], [1, 0, 0], ["en", "en", None])]


def test_all_labelled_documents_are_learnt_from_in_tasks(spark, monkeypatch):
    rows = [(i, f"{t} seldom" if i % 60 == 1 else t, lang, y) for i, t, lang, y in corpus(1500, 5)]
    frame = documents(spark, [(i, t, lang, "s") for i, t, lang, _ in rows]).repartition(3)
    labels = spark.createDataFrame([(i, toxic) for i, _, _, toxic in rows if i % 3], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "train", None)
    model = learn(frame, labels, per_class=50)
    assert toxicity.hashes(b"seldom", model.buckets)[0] in model.row_of  # in 25 documents, of which a sample holds few
    found = by_id(score(frame, model), "predicted", "score")
    assert np.mean([found[i][0] == toxic for i, _, _, toxic in rows if i % 3 == 0]) > 0.95
    assert learn(frame, labels.where("toxic = 0"), per_class=50) is None


def test_counted_thresholds_split_the_classes():
    counts = np.zeros((toxicity.BINS + 1, 2))
    counts[[10, 400], 0], counts[[900, 9000], 1] = 5, 2
    assert 400 < toxicity._counted_threshold(counts) * toxicity.BINS < 900
    docs = [np.repeat([1, 0], [k, 2])[:, None].repeat(3, axis=1) for k in (1, 40, 99)]
    model = toxicity._begun([7], [[3], [4]], [5, 6], 2, np.random.default_rng(1))
    whole = toxicity._judged(model, docs)
    toxicity.PIECE, kept = 16, toxicity.PIECE
    try:
        assert all(np.allclose(a, b) for a, b in zip(whole, toxicity._judged(model, docs), strict=True))
    finally:
        toxicity.PIECE = kept


def test_tasks_return_what_they_trained_some_rows_at_a_time(spark, monkeypatch):
    rows = corpus(300, 5)
    frame = documents(spark, [(i, t, lang, "s") for i, t, lang, _ in rows])
    labels = spark.createDataFrame([(i, toxic) for i, *_, toxic in rows], "doc_id long, toxic int")
    plain, sizes = toxicity.map_batches, []

    def watched(frame, run, schema):
        if "parts" not in schema.names:
            return plain(frame, run, schema)
        found = list(run(iter(frame.toArrow().to_batches())))
        sizes.extend(batch.num_rows for batch in found)
        return spark.createDataFrame([tuple(r.values()) for batch in found for r in batch.to_pylist()], schema)

    monkeypatch.setattr(toxicity, "map_batches", watched)
    monkeypatch.setattr(toxicity, "RETURNED", 100, raising=False)
    assert learn(frame, labels, per_class=50) is not None
    assert sum(sizes) > 3 * 100 and max(sizes) <= 100


def test_a_worker_holds_little_for_each_bucket_and_word():
    tracemalloc.start()
    try:
        model = toxicity._begun(list(range(0, 200_000, 2)), [[3] * 100_000, [4] * 100_000], [5, 6], 1, np.random.default_rng(1), 2**18)
        sent = pickle.dumps(model.row_of)
        start = tracemalloc.get_traced_memory()[0]
        places = pickle.loads(sent)
        assert tracemalloc.get_traced_memory()[0] - start < 10 * 100_000
        assert (places.get(0, 0), places.get(199_998, 0), places.get(1, 0), places.get(200_000, 0)) == (1, 100_000, 0, 0)
        cache: dict = {}
        start = tracemalloc.get_traced_memory()[0]
        predict(model, [" ".join(f"word{i}" for i in range(50_000))], cache)
        assert len(cache) == 50_000 and tracemalloc.get_traced_memory()[0] - start < 170 * 50_000
    finally:
        tracemalloc.stop()
