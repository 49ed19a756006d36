import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from loanscope.llm import lattice, packing, tokens
from llm_edges import TEXTS, empty, frame

ODD = ["<|endoftext|>", "a<|endoftext|> b <|endoftext|><|endoftext|>", "don't  WE'LL it's\r\n\n  x", "\x1c\x85\xa0  ", "1234 ①½ ٣",
       "tab\tand   spaces   ", "'s 't !'s", "ab\n", "<|startoftext|>x", "x.. ,y, Z."]


def library(name, texts):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    return [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts_equal_the_library():
    texts = TEXTS + ODD
    path = public_tokenizers.path(tokens.BYTE_BPE)
    got = tokens.counter(path, tokens.disputed(path))(texts)
    assert got == [len(x) for x in library(tokens.BYTE_BPE, texts)]


def test_characters_of_another_unicode_version():
    """Where the two Unicode tables differ the library itself cuts the text."""
    path = public_tokenizers.path(tokens.BYTE_BPE)
    odd = tokens.disputed(path)
    texts = [f"x{c}y {c}{c} 1{c}" for c in odd[:50]] + ["no such character, but é"]
    assert tokens.counter(path, odd)(texts) == [len(x) for x in library(tokens.BYTE_BPE, texts)]
    count = tokens.counter(path)  # each character judged when it comes up, pre-tokens remembered
    assert [count([t])[0] for t in texts] == tokens.counter(path, odd)(texts)


def test_token_frame_edges(spark):
    rows = tokens.token_counts(frame(spark), "doc_id", "text").collect()
    want = library(tokens.BYTE_BPE, TEXTS)
    got = sorted((r.doc_id if r.doc_id is not None else 5, r.n_tokens, r.n_bytes, r.over_limit) for r in rows)
    expect = [(i, len(w), len((t or "").encode()), len(w) > 1024) for i, (t, w) in enumerate(zip(TEXTS, want))]
    assert got == sorted(expect + [expect[1]])
    assert tokens.token_counts(empty(spark), "doc_id", "text").collect() == []


def test_packing_ids_equal_the_library():
    import numpy as np
    texts = TEXTS + ODD
    got = packing.id_bytes(packing.WORD_BPE, 1)(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [x + [1] for x in library(packing.WORD_BPE, texts)]


def test_sentencepiece_bpe_equals_the_library(spark):
    import sentencepiece
    texts = TEXTS + ODD + ["▁x y▁", "a" * 300, "-" * 70 + " " * 33 + "if", "x\u0000y", "<s> <0x41> </s>"]
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(lattice.MODEL))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in lattice.encode(df, "doc_id", "text").collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == model.encode(t or ""), t
        assert got[i].round_trip == (model.decode(got[i].ids) == (t or ""))
    back = lattice.decode(spark.createDataFrame([(got[0].ids,), (None,)], "ids array<int>"), "ids").collect()
    assert [r.text for r in back] == [texts[0], None]
    assert lattice.encode(empty(spark), "doc_id", "text").collect() == []
    assert lattice.encode(frame(spark), "doc_id", "text").count() == len(TEXTS) + 1


def test_long_unbroken_runs(spark):
    """Blanks and letters that no place cuts, 100 KB of them: one word, edges by its key."""
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(lattice.MODEL))
    texts = [" " * 100_000, "=" * 60_000, "ab" * 40_000 + " c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in lattice.encode(df, "doc_id", "text").collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == model.encode(t) and got[i].round_trip


def test_sentencepiece_viterbi_equals_the_library(spark, tmp_path):
    """The same pieces read as a unigram model with scores of their own."""
    import random

    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2
    proto = sentencepiece_model_pb2.ModelProto()
    with open(public_tokenizers.path(lattice.MODEL), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    rng = random.Random(5)
    for p in proto.pieces:
        if p.type == proto.SentencePiece.NORMAL:
            p.score = -rng.randrange(4096) / 1024 - len(p.piece) / 4 - 4
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(proto.SerializeToString())
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t[:150] for t in TEXTS + ODD if t]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in lattice.encode(df, "doc_id", "text", path).collect():
        assert r.ids == model.encode(texts[r.doc_id]), texts[r.doc_id]


def test_sentencepiece_deals_its_blocks_once(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(lattice.MODEL))
    long = "x" * 40 + "ab" * 30
    texts = ["the same words here", None, "", "▁ a▁b", "\n\n  the  ", long, long + "c", "the same " + long[:-1], "日本語 \x00 é", "🜲 the"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "doc_id long, text string").repartition(6)
    copies = spark.createDataFrame([(50, "twice the same row")], "doc_id long, text string")
    out = lattice.encode(df.union(copies).union(copies), "doc_id", "text")
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == [*range(len(texts)), 50, 50, 99]
    for r in rows:
        text = {50: "twice the same row", 99: None}.get(r.doc_id, texts[r.doc_id] if r.doc_id < 50 else None) or ""
        assert r.ids == model.encode(text) and r.n_pieces == len(r.ids)
        assert r.round_trip == (model.decode(r.ids) == text), text
    # Blocks, words and ids are dealt once each: blocks are not written twice, words not by key again.
    table = lattice.encode(frame(spark), "doc_id", "text")
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Repartition") == 3  # the blocks' one stands on both sides
    assert "blocks-" not in plan and "Relation" not in plan
