"""The pipeline's stages against brute force on the generated tables, each on what the one before kept."""

import numpy as np
import pytest

import corpus_pipeline
from compare import TEST_DATA
from helpers import documents, odd_texts
from test_llm_decontaminate import brute as contaminated
from test_llm_jaccard import brute as groups, near_copies

FOLDER = f"{TEST_DATA}/sf0.001"


def lines_removed(rows):
    """{doc_id: text} after dropping the lines of repeated windows, in order of doc_id."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows.items()):
        lines = text.split("\n")
        full = [i for i, line in enumerate(lines) if line.strip(" ")]
        gone = set()
        for a, b, c in zip(full, full[1:], full[2:], strict=False):
            window = tuple(lines[i].strip(" ") for i in (a, b, c))
            if window in seen:
                gone |= set(range(a, c + 1))
            seen.add(window)
        left = "\n".join(line for i, line in enumerate(lines) if i not in gone)
        if not gone or left.strip():
            out[doc_id] = left
    return out


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's name with the documents before and after it."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, FOLDER).write.parquet(str(folder / str(k)))
        docs = spark.read.parquet(str(folder / str(k)))
        out[name] = (before, docs)
    return out


def texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_stages_return_documents(spark, stages):
    columns = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    *filters, (_, mixed) = stages.values()
    assert all(after.columns == columns for _, after in filters)
    assert mixed.columns == [*columns, "copy", "shuffle_key"]


def test_language_id_keeps_texts_with_letters(stages):
    before, after = map(texts, stages["language ID"])
    assert after == {i: t for i, t in before.items() if t and any(c.isalpha() for c in t)}


def test_without_labels_all_documents_stay(spark):
    docs = documents(spark, [(i, text, None, "s") for i, text in odd_texts()])
    assert corpus_pipeline.language_id(spark, docs, FOLDER).count() == len(odd_texts())


def test_line_dedup(stages):
    before, after = map(texts, stages["line dedup"])
    assert after == lines_removed(before)


def test_one_of_each_group_stays(stages):
    before, after = map(texts, stages["n-gram Jaccard join"])
    assert after == {i: before[i] for i, (root, _) in groups(list(before.items())).items() if i == root}


def test_one_row_of_each_group_stays_whatever_its_ids(spark):
    """Repeated rows, null ids and ids that several texts share."""
    made = near_copies(11, 40, 6)
    alone = [(500, "a shared id, two texts, this is one"), (500, made[0][1]), (None, "only here and without an id")]
    rows = [(None if i % 4 == 1 else i // 3, t) for i, t in made] + made[:7] * 3 + [(5, made[9][1])] * 4
    rows += [*alone, alone[-1], *odd_texts(), (40, "four words are here"), (None, "four words are here"), (None, None)]
    group = {i: root for i, (root, _) in groups([(n, t) for n, (_, t) in enumerate(rows)]).items()}
    least = {}
    for n, (doc_id, _) in enumerate(rows):
        least[group[n]] = min(least.get(group[n], (True, 0)), (doc_id is None, doc_id or 0))
    of_text = {t: group[n] for n, (_, t) in enumerate(rows)}
    kept = [tuple(r) for r in corpus_pipeline.near_duplicates(
        spark, documents(spark, rows, extra="row _row first").repartition(5), FOLDER).select("doc_id", "text").collect()]
    with_words = [(i, t) for i, t in kept if any(c.isalnum() for c in t or "")]
    without = [r for r in rows if not any(c.isalnum() for c in r[1] or "")]
    assert sorted(of_text[t] for _, t in with_words) == sorted({g for n, g in group.items() if rows[n] not in without})
    assert all((i is None, i or 0) == least[of_text[t]] for i, t in with_words)
    assert sorted(map(str, without)) == sorted(str(r) for r in kept if r not in with_words)


def test_contaminated_documents_go(spark, stages):
    before, after = map(texts, stages["benchmark decontamination"])
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert after == {i: t for i, t in before.items() if not contaminated(t, items)[-1]}


def test_mixture(stages):
    before, after = stages["mixing"]
    known = texts(before)
    rows = after.collect()
    assert all(known[r["doc_id"]] == r["text"] for r in rows)
    assert 0.7 < len(rows) / len(known) < 1.3


def test_run_equals_the_stages(spark, stages):
    whole = corpus_pipeline.run(spark, FOLDER)
    assert whole.exceptAll(stages["mixing"][1]).count() == 0 and whole.count() == stages["mixing"][1].count()


def test_odd_rows_and_empty_tables(spark, tmp_path):
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    for frame in (documents(spark, odd_texts(), extra="copy class_id score contaminated"), documents(spark, odd_texts()).limit(0)):
        docs = frame
        for name, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema if name != "mixing" else None) if name != "mixing" else stage(spark, docs, str(tmp_path))
            assert np.isfinite(docs.count())
