"""Ids by distinct words against the library, other tokenizers, and doc_ids that many rows share."""

import json

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from sensorloom.llm import token_files

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "a", " a  b ", "Hello, World!", "x\ty\n\nz", "É tu, Ærø|", "don't stop", "ſ İ ß ﬁ", "a.b.c !! ||", ".", "naïve café—yes", "文字 です", "1,000.5 A1", "\n", "ABC.|,! z", "</w> a</w>", "<s> [INST]", "w" * 5_000, None]


def expected(tokenizer, texts):
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def split(found):
    ids, sizes = found
    ends = np.cumsum(sizes)
    return [ids[a:b].tolist() for a, b in zip(ends - sizes, ends, strict=True)]


def test_ids_of_odd_texts(monkeypatch):
    definition = open(TOKENIZER, encoding="utf-8").read()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    for most in (700_000, 3):
        monkeypatch.setattr(token_files, "CACHE_WORDS", most)
        for _ in range(2):
            assert split(token_files.encode_texts(definition, pa.array(ODD), 1)) == expected(tokenizer, ODD)
    assert split(token_files.encode_texts(definition, pa.array([], pa.string()), 1)) == []


def test_another_tokenizer_encodes_whole_texts():
    plain = Tokenizer(models.WordLevel({"Abc": 3, "abc": 2, "[UNK]": 0, "two": 5}, unk_token="[UNK]"))
    plain.pre_tokenizer = pre_tokenizers.Whitespace()
    definition = plain.to_str()
    assert json.loads(definition) and not token_files._words(definition).by_words
    texts = ["Abc abc two", "", "other.two", None]
    assert split(token_files.encode_texts(definition, pa.array(texts), 1)) == expected(plain, texts)


def test_rows_of_one_id_take_many_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "LEAST_SHARDS", 16)
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"word{i} and {i % 11} more") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    token_files.write_tokens(docs, TOKENIZER, str(tmp_path / "out"))
    sizes = spark.read.parquet(str(tmp_path / "out")).groupBy("shard").agg(F.sum("n_docs").alias("n")).collect()
    assert max(r["n"] for r in sizes) < 200 and sum(r["n"] for r in sizes) == 900
    back = token_files.read_tokens(spark, str(tmp_path / "out")).orderBy("start").collect()
    ids = [r["doc_id"] for r in back]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert [r["start"] for r in back] == np.cumsum([0, *[r["n_tokens"] for r in back]])[:-1].tolist()
    want = sorted(zip([r[0] or -1 for r in rows], expected(Tokenizer.from_file(TOKENIZER), [r[1] for r in rows]), strict=True))
    assert sorted((r["doc_id"] or -1, np.frombuffer(r["ids"], "<u4").tolist()) for r in back) == want


def test_segments_forget_the_words_of_a_worker():
    import public_tokenizers
    import pyarrow as pa

    from sensorloom.llm import token_files

    definition = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    token_files.encode_texts(definition, pa.array(["one two"]), 1)
    assert token_files._words.cache_info().currsize
    assert list(token_files._segments(16, False)[0](iter([]))) == []
    assert not token_files._words.cache_info().currsize


def test_words_share_their_letters_whatever_marks_follow():
    definition = open(TOKENIZER, encoding="utf-8").read()
    tokenizer, words = Tokenizer.from_file(TOKENIZER), token_files.Words(definition)
    texts = [f"Erthat{marks} other" for marks in ("", ".", "$$$", ".%%%", "***", "&&&,", "###|", "'s", "$s")]
    assert words.by_words and split(words.encode(pa.array(texts), 1)) == expected(tokenizer, texts)
    # Only an apostrophe, or letters behind the marks, makes another word of it.
    assert [w for w in words.place if "rthat" in w] == ["erthat", "Erthat's", "Erthat$s"]


def test_words_met_again_are_kept(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_WORDS", 20)
    definition = open(TOKENIZER, encoding="utf-8").read()
    tokenizer, words = Tokenizer.from_file(TOKENIZER), token_files.Words(definition)
    learned, learn = [], words._learn
    words._learn = lambda new, letters: (learned.extend(new), learn(new, letters))[1]
    rare = [chr(97 + i // 26) + chr(97 + i % 26) + "q" for i in range(200)]
    for at in range(0, 200, 5):
        texts = ["often Metagain. " + " ".join(rare[at : at + 5]), "often"]
        assert split(words.encode(pa.array(texts), 1)) == expected(tokenizer, texts)
        assert len(words.place) <= 20 + 8
    # Only the words that do not come again were forgotten.
    assert learned.count("often") == learned.count("metagain") == 1 and set(rare) <= set(learned)
    # Where too many come again, all are forgotten.
    texts = [" ".join(rare[:30])]
    for _ in range(3):
        assert split(words.encode(pa.array(texts), 1)) == expected(tokenizer, texts)
    assert learned.count("often") == 1 and len(words.place) == 1


def test_ids_of_whole_bytes_are_packed_as_any_other(monkeypatch):
    rng = np.random.default_rng(3)
    for bits in (8, 16, 32):
        for n in (0, 1, 7, 8, 1001):
            ids = rng.integers(0, 2**bits, n, np.uint64).astype(np.uint32)
            plain = token_files.pack(ids, bits)
            data = np.frombuffer(b"x" + plain + bytes(8), np.uint8)[1:]  # a block may begin at any byte
            found = [token_files.unpack(data, at, n - at, bits).tolist() for at in range(min(n, 3) + 1)]
            with monkeypatch.context() as m:
                m.setattr(token_files, "WHOLE", {})
                assert token_files.pack(ids, bits) == plain
                assert [token_files.unpack(data, at, n - at, bits).tolist() for at in range(min(n, 3) + 1)] == found
            assert found[0] == ids.tolist()
