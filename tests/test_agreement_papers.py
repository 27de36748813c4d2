"""The agreement report covers every paper, each with its own sample."""

import random

from graphloom.operators import agreement, annotate


def test_every_paper_draws_its_own_sample(spark):
    r = random.Random(2)
    span = lambda c, t, at: {"client_id": c, "text": c, "entity_type": t, "start": at, "end": at + 1, "context_role": None, "source": "m", "decision": "m"}
    rows = []
    for paper, sentences in (("d1", 9), ("d2", 4), ("d3", 14)):
        for i in range(sentences):
            for n in range(1, 4 if i % 4 else 2):
                rel = [{"source_client_id": "a", "target_client_id": "b", "relation_type": r.choice("XY"), "source": "m"}]
                rows.append((paper, f"{paper}-{i}", i, n, [span("a", r.choice("AB"), 0), span("b", r.choice("AB"), 3)], rel))
    kind = f"document_id string, sentence_id string, ordinal int, revision_number int, entities array<{annotate.ENTITY}>, relations array<{annotate.RELATION}>"
    rev = spark.createDataFrame(rows, kind)
    out = {(x.document_id, x.scope): tuple(x)[2:] for x in agreement.agreement_report(rev, size=5).collect()}
    assert set(out) == {(d, s) for d in ("d1", "d2", "d3") for s in ("entity", "relation", "overall")}
    for paper in ("d1", "d2", "d3"):
        alone = agreement.agreement_report(rev.where(f"document_id = '{paper}'").drop("document_id"), size=5).collect()
        assert {(paper, x.scope): tuple(x)[1:] for x in alone} == {k: v for k, v in out.items() if k[0] == paper}
        # the sample is the one drawn from the list of the paper's eligible sentences
        eligible = sorted({(x[2], x[1]) for x in rows if x[0] == paper and x[2] % 4})
        chosen = {s for _, s in random.Random(42).sample(eligible, min(5, len(eligible)))}
        drawn = rev.where(rev.sentence_id.isin(chosen))
        whole = {(paper, x.scope): tuple(x)[2:] for x in agreement.agreement_report(drawn, size=1000).collect()}
        assert whole == {k: v for k, v in out.items() if k[0] == paper}
