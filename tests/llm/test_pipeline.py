"""Every stage of the pipeline against brute force on its own input."""

from collections import Counter

import corpus_pipeline
from test_ops import brute_components, brute_hits, brute_repeats, brute_targets, check_repeats, words

from kinfold.llm import mixing, quality
from kinfold.session import materialize, table


def test_stages(spark, data):
    docs = table(spark, data, "documents")
    columns = docs.columns
    bench = [(r.item_id, r.text) for r in table(spark, data, "benchmark").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "ngram_join", "decontaminate", "mix"]
    for name, stage in corpus_pipeline.STAGES:
        before = sorted(docs.collect(), key=lambda r: r.doc_id)
        out = materialize(stage(spark, docs, data), name)
        after = sorted(out.collect(), key=lambda r: r.doc_id)
        kept = {r.doc_id: r for r in after}
        if name != "mix":
            assert out.columns == columns
        if name == "quality":
            good = {r.doc_id for r in quality.digest(docs).filter("keep").collect()}
            assert set(kept) == good and all(kept[r.doc_id] == r for r in before if r.doc_id in kept)
        elif name == "line_dedup":
            for r, gone in zip(before, brute_repeats([r.text for r in before]), strict=True):
                new = kept.get(r.doc_id)
                check_repeats(r.text, new.text if new else "", gone)
                assert new or any(gone)
                assert not new or new.n_chars == len(new.text) and (any(gone) or new == r)
        elif name == "ngram_join":
            assert set(kept) == {i for i, _, c in brute_components([(r.doc_id, r.text) for r in before]) if i == c}
        elif name == "decontaminate":
            assert set(kept) == {r.doc_id for r in before if not brute_hits(r.text, bench)[4]}
        else:
            size = Counter()
            for r in before:
                size[r.source] += len(words(r.text))
            goal, source = brute_targets(size), {r.doc_id: r.source for r in before}
            assert set(kept) == set(source)
            taken = Counter()
            for r in after:
                taken[source[r.doc_id]] += r.taken
                assert r.taken <= 3 * r.size and abs(r.target - goal[source[r.doc_id]]) < 1e-6
            assert all(abs(taken[s] - goal[s]) <= 4 * mixing.BLOCK for s in goal)
        docs = out


def test_run_gives_the_last_stage(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert out.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"] and out.count() > 0
