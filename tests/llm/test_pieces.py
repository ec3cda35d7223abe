import hashlib

import numpy as np
import public_tokenizers
import sentencepiece

from vellum.llm.pieces import ChunkCodec, encode_digests

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  a  b ", "a▁b", "▁", "a\x00b", " x　 \n\n y", "x" * 5000, "été ß 漢字 🙂 ▁▁ q", "a \n b\t c", "<s> </s> <0x41>"]


def brute(text):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_as_the_library(spark):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas()["text"].tolist()
    rows = list(enumerate(ODD + texts)) + [(None, "a"), (0, "a")]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_digests(df, MODEL).collect()]
    assert sorted(got, key=str) == sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert encode_digests(df.limit(0), MODEL).count() == 0


def test_small_table_gives_the_same():
    codec = ChunkCodec(MODEL, most_chunks=3)
    assert codec.apart
    assert [len(i) // 4 for i, _ in codec.encode(["a b c d", "e f"])] == [brute("a b c d")[0], brute("e f")[0]]
