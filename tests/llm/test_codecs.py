import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from itemloom.llm import chat_format, sentencepiece_codec, token_files

ODD = [
    "", " ", "  ", "a  b", "a\n b", "a \n b", "a\n\n b\n", " lead", "trail ", "x\t y", "a   b c", "foo<|endoftext|> bar <|endoftext|>", "é  b", "a\u3000 b c", "don't 's 's", "1 2  3", "\n",
    "x▁ y▁▁z", "日本語 テキスト😀", "a" * 300, "x" + "ab" * 4000, "\x00\x01", "<s> </s> <0x41>", "   a   b   ", "\t\t a", "a\xa0 b", "a\x85 b", " \u2028 x",
]


def test_encoder_is_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), token_files.Encoder(path, remembered=5)
    for _ in range(2):
        got = [np.frombuffer(x, own.dtype).tolist() for x in own.encode(ODD)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in ODD]


def test_files_round_trip(spark, table, prose, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    pairs = [(i * 7 % 41, prose(i * 5, i)) for i in range(41)] + [(100 + i, t) for i, t in enumerate(ODD)] + [(90, None)]
    token_files.write_tokens(table(pairs), str(tmp_path / "t"), path, length=64)
    got = sorted(tuple(r) for r in token_files.read_documents(spark, str(tmp_path / "t")).collect())
    library, at, expected = Tokenizer.from_file(path), 0, []
    for i, t in sorted(pairs, key=lambda x: x[0]):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == expected
    file = next((tmp_path / "t").glob("part-*"))
    with pa.memory_map(str(file)) as raw:  # random access to equal sequences without copying
        batch = pa.ipc.open_file(raw).get_batch(0)
        assert batch.schema.field("ids").type == pa.list_(pa.uint16(), 64) and batch.schema.field("mask").type == pa.list_(pa.bool_(), 64)
        assert len(batch.column("ids")[0]) == 64
    token_files.write_tokens(table([]), str(tmp_path / "none"), path)
    assert token_files.read_documents(spark, str(tmp_path / "none")).count() == 0


def test_shards_keep_documents_whole():
    docs = [(1, np.arange(5, dtype=np.uint16)), (None, np.arange(70, dtype=np.uint16)), (3, np.array([9], np.uint16))]
    table = token_files.open_shard(token_files.shard_file(docs, 32, (0, 0))).read_all()
    assert table.num_rows == 3 and table.column("docs").to_pylist() == [[1], [], [None, 3]]
    assert sum(sum(m) for m in table.column("mask").to_pylist()) == 76


def test_agenda_is_the_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Codec(path, remembered=5)
    got = own.encode(ODD)
    assert [x[1] for x in got] == [library.encode(t) for t in ODD] and all(x[2] for x in got)
    words = [w for t in ODD for w in t.split() if w]
    marked = ["▁" + w for w in words if "▁" not in w]
    assert [own.agenda(m) for m in marked] == own.agendas(marked)
    assert own.decode([x[1] for x in got]) == [library.decode(library.encode(t)) for t in ODD]


def test_a_difference_from_the_library_is_flagged(monkeypatch):
    own = sentencepiece_codec.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    monkeypatch.setattr(own, "agendas", lambda texts: [(5,) for _ in texts])
    (_, ids, agrees), = own.encode(["some words"])
    assert not agrees and ids == own.library.encode("some words")


def test_round_trip(table):
    pairs = [*enumerate(ODD), (None, "x"), (500, None), (0, "")]
    got = sentencepiece_codec.round_trip(table(pairs), public_tokenizers.path("piece_bpe_32k.model"), with_ids=True).collect()
    assert len(got) == len(pairs)
    for r in got:
        assert r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert {r["doc_id"]: r["decoded"] for r in got}[3] == "a  b"


CONTROL = ["</s>[INST] ok [/INST]", "\\", "\\</s>", "\\\\[INST]", "<s>", "a\nb%0A", "", None, " [/INST]</s>", "[INST", "é😀"]


def digests(conversations):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for i, turns in conversations.items():
        said = [(r or "", t or "") for r, t in turns]
        learned = "".join(t for r, t in said if r == "assistant")
        out.append((i, len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(learned), sha(learned)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [1, 200, 1 << 16])
def test_chat_round_trip(spark, monkeypatch, limit):
    monkeypatch.setattr(chat_format, "PACK_CHARS", limit)
    conversations = {i: [("system", "same"), ("user", CONTROL[i % len(CONTROL)]), ("assistant", CONTROL[(i + 3) % len(CONTROL)]), ("assistant", f"t{i // 4}")][: 2 + i % 3] for i in range(40)}
    conversations[100] = [(r, t) for r in ("user", "assistant", None, "role\nwith<s>") for t in CONTROL]
    conversations[None] = [("user", "no id")]
    rows = [(i, n, r, t, 1) for i, turns in conversations.items() for n, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, text_length int").repartition(5)
    packs = chat_format.pack_conversations(df)
    got = sorted((tuple(r)[:5] for r in chat_format.read_back(packs).collect()), key=str)
    assert got == digests(conversations)
    assert chat_format.pack_conversations(df.limit(0)).count() == 0


def test_packs_share_prefixes():
    pack = chat_format._Pack()
    for i, turns in enumerate([[("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "c"), ("user", "d")], [("user", "z")]]):
        pack.add(i, turns)
    row = pack.batch().to_pylist()[0]
    assert len(row["nodes"]) == 5 and row["text"].count("[INST] a [/INST]") == 1
    for n in row["nodes"]:
        parent = row["nodes"][n["parent"]] if n["parent"] >= 0 else None
        assert n["position"] == (parent["position"] + parent["length"] if parent else 0)
        assert sum(a["stop"] - a["start"] for a in n["ancestors"]) == n["position"]
    deep = row["nodes"][3]  # its ancestors are apart, since another branch lies between
    assert len(deep["ancestors"]) == 2 and deep["ancestors"][0]["start"] == 0


def test_chat_of_repeated_rows_long_texts_and_rows_without_an_id(spark):
    long = "word </s> " * 50_000
    turns = [("user", long), ("assistant", long + "\\")]
    rows = [(1, n, r, t) for n, (r, t) in enumerate(turns)] * 2 + [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (None, 1, "assistant", "b")]
    got = sorted((tuple(r)[:5] for r in chat_format.read_back(chat_format.pack_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()), key=str)
    own = lambda i, turns: digests({i: turns})[0]
    assert got == sorted([own(1, [t for t in turns for _ in range(2)]), own(None, [("user", "a")]), *[own(None, [("assistant", "b")])] * 2], key=str)


def test_codec_of_no_rows_and_repeated_long_ones(spark, table, prose):
    import sentencepiece

    path, long = public_tokenizers.path("piece_bpe_32k.model"), prose(40_000, 3) + "é" * 5000
    assert sentencepiece_codec.round_trip(table([]), path).count() == 0
    got = sentencepiece_codec.round_trip(table([(1, long), (1, long)]), path).collect()
    ids = sentencepiece.SentencePieceProcessor(model_file=path).encode(long)
    assert [(r["n_tokens"], r["ids_sha256"]) for r in got] == [(len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())] * 2


SF = "/root/testdata/sf0.001"


def documents(spark):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def test_sentencepiece_query_on_its_whole_table(spark):
    import sentencepiece

    from itemloom.llm.registry import QUERIES

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op2_sentencepiece"](spark, SF).collect())
    assert got == [(i, len(ids := library.encode(t)), sha(",".join(map(str, ids))), sha(library.decode(ids))) for i, t in documents(spark)]


def test_chat_query_on_its_whole_table(spark):
    from itemloom.llm.registry import QUERIES

    conversations = {-7: [(r, "</s>[INST] ok [/INST]") for r in ("user", "assistant")]}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        conversations.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    got = QUERIES["op3_chat_format"](spark, SF).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == digests(conversations)
    assert all(r["formatted_chars"] >= r["loss_chars"] for r in got)


def test_token_query_on_its_whole_table(spark):
    from tokenizers import Tokenizer

    from itemloom.llm.registry import QUERIES

    library, start, expected = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for i, t in documents(spark):
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = QUERIES["op4_token_files"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == expected


def test_token_files_hold_repeated_rows_each(spark, table, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_tokens(table([(2, "some words"), (1, "x"), (2, "some words"), (None, None)]), str(tmp_path / "t"), path)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["start"], r["n_tokens"]) for r in token_files.read_documents(spark, str(tmp_path / "t")).collect())
    assert [g[0] for g in got] == [-1, 1, 2, 2] and got[0][1:] == (0, 1) and got[3][1] == got[2][1] + got[2][2]
