"""The pipeline's stages, one after another, against what each may do to its own input."""

from collections import Counter

import corpus_pipeline as p
from conftest import SF

from siltbed.llm import mixing, rules
from siltbed.llm.shared import cut, documents
from test_ops import brute_components, brute_counts, brute_repeats


def test_stages(spark):
    docs = documents(spark, SF)
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in p.STAGES[:-1]:
        verdict = rules.quality_rules(docs) if name == "quality_rules" else mixing.mix_sources(docs) if name == "source_mix" else None
        docs = cut(stage(spark, docs, SF), name)
        assert tuple(docs.columns) == p.COLUMNS
        rows = docs.collect()
        after = {r["doc_id"]: r["text"] for r in rows}
        if name == "quality_rules":
            want = {r["doc_id"] for r in verdict.where("kept").collect()}
            good = {k for k, t in before.items() if (c := brute_counts(t))[0] >= 50 and 100 * c[4] <= 50 * c[0]}
            assert set(after) == want <= good and len(good - want) <= 0.05 * len(good)
        elif name == "near_duplicates":
            assert set(after) == {k for k, (_, first) in brute_components(before).items() if k == first}
        elif name == "repeated_passages":
            want = brute_repeats(before, 100)
            assert set(after) == set(before) and all(abs(len(after[k].encode()) - len(want[k])) <= 6 * (1 + len(before[k]) // 100) for k in after)
        else:
            assert Counter(r["doc_id"] for r in rows) == Counter({r["doc_id"]: r["mix_copies"] for r in verdict.where("mix_copies > 0").collect()})
        before = after
    out = p.STAGES[-1][1](spark, docs, SF)
    assert out.select("sequence_id", "offset").distinct().count() == out.count() > 0
