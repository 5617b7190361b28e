import public_tokenizers as P
import tiktoken

import corpus_pipeline
from skuforge.llm import byte_bpe, common
from tests.llm.test_decontaminate import brute as windows
from tests.llm.test_ngram_join import brute as groups
from tests.llm.test_pii import base


def test_each_stage_against_brute_force_on_its_own_input(spark):
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in common.table(spark, sf, "labels").collect()}
    items = [(r.item_id, r.text) for r in common.table(spark, sf, "benchmark").collect()]
    work = common.Workspace(spark, "pipeline-test")
    before = {r.doc_id: r for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = work.save(stage(spark, docs, sf), name)
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns if k < 4 else set(columns) < set(docs.columns)
        assert set(after) <= set(before)
        if name == "quality":
            known = [i for i in before if i in labels]
            assert sum((i in after) == (labels[i] == 1) for i in known) > 0.9 * len(known)
        elif name == "near_duplicates":
            assert set(after) == {i for i, _, c in groups([(i, r.text) for i, r in before.items()], 5, 80, 100) if i == c}
        elif name == "decontamination":
            for i, r in before.items():
                n, hit, _ = windows(r.text, items, 10)
                assert (i in after) == (hit <= 0.5 * n)
                if i in after:
                    assert (after[i].text == r.text) == (hit == 0)
        elif name == "personal_data":
            assert set(after) == set(before)
            for i, r in before.items():
                spans = base(r.text)
                assert all(r.text[a:b] not in after[i].text for k, a, b in spans if k == "email")
                assert spans or after[i].text == r.text
        else:
            library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path(corpus_pipeline.RANKS)), special_tokens={})
            for i, r in before.items():
                assert after[i].token_ids == library.encode_ordinary(r.text) and after[i].n_tokens == len(after[i].token_ids)
        before = after
