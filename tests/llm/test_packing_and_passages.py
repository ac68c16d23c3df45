"""Packing round trip, passages against brute force, and the pipeline's stages."""
import os
import re
import sys
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpuscope.llm import decontaminate, packing, queries
from made_up import words

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402


@pytest.mark.parametrize("source, block", [("odd_docs", 1 << 17), ("small", 50)])
def test_packing_round_trip(request, source, block):
    docs = request.getfixturevalue(source)
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    got = packing.pack(docs, block=block).collect()
    ids = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        ids[r["doc_id"]].append(coder.encode(r["text"] or "", add_special_tokens=False).ids + [1])
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == ids.keys()
    for key, own in ids.items():
        want = sorted((s, min(2048, len(x) - s), zlib.crc32(np.array(x[s:s + 2048], "<u4").tobytes()), len(x)) for x in own for s in range(0, len(x), 2048))
        assert want == sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in pieces[key])
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 2048


def test_ids_of_added_tokens(spark, tmp_path):
    """The query and the pipeline give the ids of tokenizers with nothing set but add_special_tokens=False."""
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y", "two  <|endoftext|><|endoftext|>\n z", "<|endoftext", "no token  at all", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [coder.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    want = [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes()), len(x)) for i, x in enumerate(ids)]
    assert ids[0] == [64, 220, 50256, 275, 1]
    for got in (queries.op7_packing(spark, str(tmp_path)), corpus_pipeline.pieces(spark, docs, "")):
        assert sorted((r["doc_id"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got.collect()) == want


def test_ids_without_looking_for_special_tokens(monkeypatch):
    """No text or word goes through the encoder that tries for a special token at every character."""
    import tiktoken

    def searched(*_, **__):
        raise AssertionError("looked for special tokens")
    monkeypatch.setattr(tiktoken.Encoding, "encode_to_numpy", searched)
    monkeypatch.setattr(packing, "MEMORY", 3)
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = packing.WordIds(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, packing.added_tokens("byte_bpe_50k.tiktoken"))
    for t in ["", " ", "one", " one", "one ", "a  b", "a b\t c d", "one two, (three) 4th one two five six", "über 日本 語!", "x <|endoftext|>y z", "a\u00a0 b", "a \u00a0b", "\n a b", "a b \r\nc"]:
        assert ids.of(t) == np.array(coder.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t
        assert len(ids.known) <= 3


def test_best_fit():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(1, 33, int(rng.integers(1, 80))).tolist()
        places, opened = packing.best_fit_decreasing(lengths, 32)
        free = []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fit = [(f, k) for k, f in enumerate(free) if f >= lengths[i]]
            if fit:
                assert 32 - places[i][1] == min(fit)[0]  # into a window as tight as any
            else:
                free.append(32)
            free[places[i][0]] -= lengths[i]
        assert opened == len(free) and min(free) >= 0


def test_packing_of_nothing(no_docs):
    assert packing.pack(no_docs).count() == 0


def least_edits(window: bytes, text: bytes) -> int:
    d = [0] * (len(text) + 1)
    for c in window:
        e = [d[0] + 1]
        for j, t in enumerate(text):
            e.append(min(d[j] + (c != t), d[j + 1] + 1, e[j] + 1))
        d = e
    return min(d)


def test_passages(spark, odd_docs, no_docs):
    rng = np.random.default_rng(9)
    items = [(1, " ".join(words(21, 50))), (2, " ".join(words(22, 20))), (3, "Short One, 20 bytes"), (4, None), (5, ""), (6, "tiny"), (7, " ".join(words(21, 50)))]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def changed(t: str, n: int) -> str:
        b = list(t)
        for at in sorted(rng.choice(len(b), n, replace=False), reverse=True):
            b[at:at + 1] = [["#"], [], [b[at], "#"]][rng.integers(3)]
        return "".join(b)
    rows = [(i, " ".join(words(40 + i, 60)) + "\n" + changed(items[i % 2][1], n).upper() + "  " + " ".join(words(80 + i, 30)))
            for i, n in enumerate([0, 0, 1, 2, 4, 6, 8, 10, 14, 20, 30, 40])] + [(50, "x short  one, 20 BYTES y"), (51, items[0][1][100:170])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_passages(docs, bench).collect()}
    want = set()
    for i, t in rows:
        for k, item in items:
            for w in decontaminate.windows(decontaminate.normal((item or "").encode())):
                if least_edits(w, decontaminate.normal(t.encode())) <= decontaminate.budget(len(w)):
                    want.add((i, k))
    assert got == want and {(0, 1), (0, 7), (1, 2), (50, 3)} <= got
    clean = decontaminate.without_passages(docs, bench)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontaminate.find_passages(odd_docs, bench).count() == 0 and decontaminate.without_passages(odd_docs, bench).count() == odd_docs.count()
    assert decontaminate.find_passages(no_docs, bench).count() == 0 and decontaminate.find_passages(docs, bench.limit(0)).count() == 0


def test_texts_are_coded_in_pieces(monkeypatch):
    """What a task holds of q-grams is bounded, and no q-gram or band at a cut is lost."""
    items = [(i, " ".join(words(40 + i, 40)).encode()) for i in range(5)]
    texts = [" ".join(words(60 + i, 30)).encode() + b" " + items[i % 5][1] + b" tail" for i in range(12)]
    patterns = decontaminate.Patterns(items)
    want = [x.tolist() for x in decontaminate.look(patterns, texts)]
    longest = []
    codes = decontaminate.codes
    monkeypatch.setattr(decontaminate, "codes", lambda a: longest.append(len(a)) or codes(a))
    for piece in (1, 9, 100):
        monkeypatch.setattr(decontaminate, "CODED", piece)
        assert [x.tolist() for x in decontaminate.look(patterns, texts)] == want and set(want[0]) == set(range(12))
        assert max(longest) <= piece + decontaminate.Q - 1
        longest.clear()


def test_item_blocks_lose_nothing(spark, monkeypatch):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = decontaminate.find_passages(docs, bench)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 3000)
    assert sorted(whole.collect()) == sorted(decontaminate.find_passages(docs, bench).collect())


def test_pipeline_stages(spark, odd_docs, no_docs, tmp_path):
    folder = "/root/testdata/sf0.001"
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs.write.parquet(str(tmp_path / f"{name} {docs.count()}"), mode="overwrite")
            docs = stage(spark, docs, folder)
            assert docs.columns == odd_docs.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()


def test_pipeline(spark):
    """Each stage keeps what brute force keeps of its predecessor's rows; all kept documents are packed whole."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    bench = [decontaminate.normal(r["text"].encode()) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        now = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert now.items() <= kept.items()
        if name == "exact dedup":
            first = {}
            for i, t in sorted(kept.items()):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
            assert set(now) == set(first.values())
        if name == "benchmark decontamination":
            assert set(now) == {i for i, t in kept.items() if not any(b in decontaminate.normal(t.encode()) for b in bench)}
        kept = now
    pieces = defaultdict(int)
    for r in corpus_pipeline.run(spark, folder).collect():
        pieces[r["doc_id"]] += r["length"]
    assert pieces.keys() == kept.keys()


@pytest.mark.parametrize("stage", ["quality", "passages"])
def test_stages_send_slices_of_a_batch(spark, monkeypatch, stage):
    """A task does not make Python objects, or a filtered copy, of a whole Arrow batch."""
    import pyarrow as pa
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    from corpuscope.llm import quality
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a passage of the benchmark that is long enough to have windows, and that no document holds")], "item_id long, text string")
    sent = []
    monkeypatch.setattr(Classic, "mapInArrow", lambda df, part, schema: sent.append(part) or df)
    if stage == "quality":
        quality.keep_good(docs, {"constant": 1.0, "cut": 0.0})
    else:
        decontaminate.without_passages(docs, bench)
    n = 5000
    batch = pa.record_batch({"doc_id": list(range(n)), "text": ["some words"] * n})
    out = list(sent[0](iter([batch, batch.slice(0, 0)])))
    assert max(b.num_rows for b in out) <= 1000
    assert [x for b in out for x in b.column(0).to_pylist()] == list(range(n))
