"""Every stage of the pipeline against a plain version on its own input."""

import corpus_pipeline
import pytest

from driftwell.llm import quality, registry


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = corpus_pipeline.documents(spark, sf_dir).cache(), []
    for name, f in corpus_pipeline.STAGES:
        after = f(spark, docs, sf_dir).cache()
        out.append((name, docs.toPandas(), after.toPandas()))
        docs = after
    return out


def test_columns(stages):
    assert len(stages) == 5
    for _, _, after in stages[:-1]:
        assert sorted(after.columns) == sorted(corpus_pipeline.COLUMNS)


def test_quality_drops_bad_and_keeps_good(spark, sf_dir, stages):
    _, before, after = stages[0]
    labels = registry.read(spark, sf_dir, "labels").toPandas().set_index("doc_id")["quality"]
    kept = set(after["doc_id"])
    bad = [i for i in before["doc_id"] if labels.get(i) == 0]
    good = [i for i in before["doc_id"] if labels.get(i) == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i in kept for i in bad) <= 0.2 * len(bad)
    w = quality.train(registry.read(spark, sf_dir, "documents"), registry.read(spark, sf_dir, "labels"))
    h = quality.Hasher()
    for i, t in zip(before["doc_id"], before["text"]):
        at, x = h.vector(t)
        assert (w[at] @ x + w[-1] >= 0) == (i in kept)


def test_one_of_each_group_stays(stages):
    _, before, after = stages[1]
    sets = {}
    for i, t in zip(before["doc_id"], before["text"]):
        w = t.encode().lower().split()
        sets[i] = {b" ".join(w[k : k + 5]) for k in range(max(len(w) - 4, 1))}
    kept, ids = set(after["doc_id"]), sorted(sets)
    like = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] & sets[b]}
    assert not [p for p, j in like.items() if j >= 0.8 and set(p) <= kept]
    for i in set(ids) - kept:
        assert max(j for p, j in like.items() if i in p) >= 0.8
    assert len(after) == len(kept)


def test_repeats_go(stages):
    _, before, after = stages[2]
    first, kept = {}, {}
    for i, t in sorted(zip(before["doc_id"], before["text"])):
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first.setdefault(b[p : p + 50], i) < i:
                gone[p : p + 50] = b"\1" * 50
        kept[i] = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    assert dict(zip(after["doc_id"], after["text"])) == kept
    assert all(n == len(t) for n, t in zip(after["n_chars"], after["text"]))


def test_benchmark_passages_go(spark, sf_dir, stages):
    import re

    _, before, after = stages[3]
    words = lambda t: re.findall(r"\w+", t.lower())
    grams = {tuple(w[i : i + 13]) for w in map(words, registry.read(spark, sf_dir, "benchmark").toPandas()["text"]) for i in range(len(w) - 12)}
    bad = {i for i, t in zip(before["doc_id"], before["text"]) if any(tuple(w) in grams for w in (lambda ws: (ws[k : k + 13] for k in range(len(ws) - 12)))(words(t)))}
    assert bad and not bad & set(after["doc_id"]) and len(before) - len(after) <= len(bad) + 3


def test_tokens(stages):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(registry.vocabulary_path())
    _, before, after = stages[4]
    n = dict(zip(after["doc_id"], after["n_tokens"]))
    assert n == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in zip(before["doc_id"], before["text"])}


def test_run_is_the_stages(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, stages[-1][2].values.tolist()))
