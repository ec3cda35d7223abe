import numpy as np
import public_tokenizers
import sentencepiece
from test_decontaminate import brute as leaks
from test_lines import brute as later_lines
from test_lines import words
from test_minhash import brute as groups

import corpus_pipeline
from vellum.llm.common import settle, shared_folder

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, folder = docs.columns, shared_folder(spark)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, SF), folder, name)
        got = {r.doc_id: r for r in docs.collect()}
        if name == "quality_rules":
            assert docs.columns == columns
            judged = [(d in got) == (labels[d] == 1) for d, t in kept if d in labels and len(t.split()) >= 20]
            assert np.mean(judged) > 0.9
            want = {d: t for d, t in kept if d in got}
        elif name == "line_dedup":
            gone = later_lines(kept)
            want = {}
            for i, (d, t) in enumerate(kept):
                left = [x for k, x in enumerate(t.split("\n")) if k not in gone[i]]
                if any(words(x) for x in left):
                    want[d] = "\n".join(left)
            assert all(r.n_chars == len(r.text) for r in got.values())
        elif name == "near_duplicates":
            want = {d: t for d, t in kept for row in [0] if d in {g[0] for g in groups(kept, 5) if g[3]}}
        elif name == "decontamination":
            bad = set(leaks(kept, items))
            want = {d: t for d, t in kept if d not in bad}
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            assert {d: (bytes(r.ids), r.decoded) for d, r in got.items()} == {
                d: (np.array(library.encode(t, add_bos=True, add_eos=True), "<u4").tobytes(), library.decode(library.encode(t))) for d, t in kept
            }
            continue
        assert {d: r.text for d, r in got.items()} == want
        kept = list(want.items())


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
