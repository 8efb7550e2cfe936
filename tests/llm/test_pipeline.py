"""The pipeline's stages against plain implementations of what each of them keeps."""

import collections

import numpy as np
import pytest

import corpus_pipeline
from pixelgrain.llm import decontamination, exact_dedup, quality
from pixelgrain.llm import queries as corpus
from pixelgrain.llm._text import BY_ALNUM, words
from pixelgrain.llm.queries import word_tokenizer_path


@pytest.fixture
def sf_dir():
    return "/root/testdata/sf0.001"


def test_registered(spark):
    found = corpus.queries()
    assert {int(n[2:].split("_")[0]) for n in found} == set(range(1, 11)) and set(corpus.oracle_sql()) <= set(found)


ODD = "_bad _dropped _key _id _body _text _label _kept _length _sha _n component_id kept predicted score text_sha256".split()


def odd_table(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows and ids, columns that clash with inner names."""
    long = " ".join(f"word{k % 997} of{k}" for k in range(20_000))
    plain = "the quick brown fox jumps over the lazy dog near the river bank on a sunny day in june"
    texts = [(0, plain), (1, plain), (1, plain + " again and again until it rains"), (2, plain), (2, plain), (3, None), (4, ""), (5, "  \n"), (None, plain), (None, None), (6, long), (7, long + " end"), (8, "short")]
    rows = [(i, t, None if k % 3 else "en", None if k % 2 else "web", None if k % 5 else k, *([k] * len(ODD))) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in ODD))


def test_stages_keep_columns_and_odd_rows(spark, sf_dir):
    docs = odd_table(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        kept = [tuple(r) for r in out.collect()]
        assert not collections.Counter(kept) - collections.Counter(tuple(r) for r in docs.collect()), name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == docs.count()


def test_quality_stage_holds_one_worker_a_task(spark, sf_dir, monkeypatch):
    """Statistics are taken and summed up in tasks of their own, however few labels there are; the model is that of all labelled rows."""
    tables, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda table: tables.append(table) or fit(table))
    models, keep = [], quality._keep_good
    monkeypatch.setattr(quality, "_keep_good", lambda model, *rest: models.append(model) or keep(model, *rest))
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    corpus_pipeline.quality_stage(spark, docs, sf_dir)
    assert len(tables) == 1 and tables[0].collect()
    plan = tables[0]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" in plan and plan.index("SortMergeJoin") < plan.index("Exchange") < plan.index("MapInArrow")
    whole = fit(quality._labelled(quality.statistics_table(docs), labels, "doc_id", "quality"))
    assert np.allclose(models[0].means, whole.means) and np.allclose(models[0].whiten, whole.whiten) and np.allclose(models[0].offsets, whole.offsets)


def test_exact_stage_judges_rows(spark):
    """Of equal texts one row stays, whatever ids repeat; a text that stands alone stays."""
    rows = [(0, "a"), (1, "a"), (1, "unique text"), (2, "b"), (2, "b"), (3, "b "), (3, "b"), (None, "a"), (4, None), (5, ""), (6, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id, r.text) for r in exact_dedup.drop_exact_copies(docs).collect())
    assert kept == [(0, "a"), (1, "unique text"), (3, "b "), (6, " ")]
    assert exact_dedup.drop_exact_copies(spark.createDataFrame([(2, "b"), (2, "b")], "doc_id long, text string")).count() == 1


def plain_pipeline(docs, model, items, spec):
    """The stages in plain Python over (doc_id, text): ids that stay after each of the first four, and the last one's rows."""
    import hashlib
    import re

    from tokenizers import Tokenizer

    good = {}
    for i, t in docs:
        raw = np.frombuffer(t.encode(), np.uint8)
        if model.score(quality.document_statistics(raw, np.array([0, len(raw)])))[0] >= quality.THRESHOLD:
            good[i] = t
    best = {}
    for i, t in good.items():
        body = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[body] = min(best.get(body, (-len(t), i)), (-len(t), i))
    single = {i: good[i] for _, i in best.values()}
    sets = {}
    for i, t in single.items():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    by_shingle = collections.defaultdict(list)
    for i in sorted(sets):
        shared = collections.Counter(j for s in sets[i] for j in by_shingle[s])
        for j, both in shared.items():
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                group[max(a, b)] = min(a, b)
        for s in sets[i]:
            by_shingle[s].append(i)
    near = {i: t for i, t in single.items() if root(i) == i}
    index = decontamination.build_index([k for k, _ in items], [t.encode() for _, t in items])
    clean = {}
    for i, t in near.items():
        raw = np.frombuffer(t.encode(), np.uint8)
        h, _, _, first = words(raw, np.array([0, len(raw)]), BY_ALNUM)
        if not any(n >= decontamination.COVERAGE * len(index.tokens[k]) for _, k, n, _, _ in decontamination.find(index, h, first)):
            clean[i] = t
    library = Tokenizer.from_str(spec)
    out = {}
    for i, t in clean.items():
        ids = library.encode(t, add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[i] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    return [set(good), set(single), set(near), set(clean)], out


def test_pipeline_against_plain_python(spark, sf_dir):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if r.text]
    model = quality.fit(quality._labelled(quality.statistics_table(spark.read.parquet(f"{sf_dir}/documents.parquet")), labels, "doc_id", "quality"))
    with open(word_tokenizer_path(), encoding="utf-8") as file:
        stages, last = plain_pipeline(docs, model, items, file.read())
    got = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], stages, strict=True):
        got = stage(spark, got, sf_dir)
        assert {r.doc_id for r in got.select("doc_id").collect()} == want, name
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()} == last
