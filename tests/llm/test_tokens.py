import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from assimspark.llm.packing import column_generation, first_fit, pack, packed_sequences, usable_patterns, with_checksum
from assimspark.llm.token_files import Shard, _shard_uri, read_documents, write_token_files
from assimspark.llm.tokens import Encoder, encoder, tokenizer_path

TEXTS = [None, "", " ", "a", "a b", "  a", "a  b", "a   b ", "\n\n a\n b", "it's 'tis x y", "tab\t x", "x \ny", "end ", "a \n\n b", "<|endoftext|> z", "　 　 q", "é ½ ² 12 3,4!? Ġ Ġx", "word " * 5000, "x" * 3000, "same text", "same text"]


def ids_of(text):
    return Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library():
    e = Encoder(tokenizer_path(), most=5)
    for _ in range(2):
        assert [np.frombuffer(e.encode(t or ""), e.dtype).tolist() for t in TEXTS] == [ids_of(t) for t in TEXTS]
    assert ids_of("x <|endoftext|> y") == np.frombuffer(e.encode("x <|endoftext|> y"), e.dtype).tolist() and 50256 in ids_of("x <|endoftext|> y")


def test_encoder_keeps_a_bounded_number_of_characters():
    e = Encoder(tokenizer_path(), most=1000, most_chars=200)
    texts = ["".join(chr(97 + (i * k) % 26) for k in range(40 + i)) for i in range(60)] + ["y" * 500, "z" * 500 + " a"]
    for _ in range(2):
        assert [np.frombuffer(e.encode(t), e.dtype).tolist() for t in texts] == [ids_of(t) for t in texts]
        for held in (e.known, e.known.before):
            assert sum(map(len, held)) <= 200


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab'A\u00e91\u00bd \n\t\r.,!\u2019\u2014sdtmrevl\"\u00df\u00ad\u00a0\u3000\u65e5\x1c\u0301<|>", max_size=40))
def test_encoder_on_odd_texts(text):
    e = encoder(tokenizer_path())
    assert np.frombuffer(e.encode(text), e.dtype).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def frame(spark):
    return spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)], "doc_id long, text string, start long").repartition(3)


def test_token_files_round_trip(spark):
    folder, index = write_token_files(frame(spark), seq_len=16, rows_per_batch=3)
    rows = sorted(read_documents(folder, index).collect())
    start = 0
    for r, (i, t) in zip(rows, enumerate(TEXTS)):
        ids = [*ids_of(t), 2]
        assert tuple(r) == (i, start, len(ids), crc(ids))
        start += len(ids)
    shard = index.orderBy("shard").first()["shard"]
    ids, mask = Shard(_shard_uri(folder, shard)).sequence(0)
    assert len(ids) == len(mask) == 16 and not ids.flags.owndata


def test_token_files_with_repeated_and_null_doc_ids(spark):
    rows = [(None, "n"), (3, "b"), (3, "a"), (3, "a"), (-1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted((tuple(r) for r in read_documents(*write_token_files(docs, seq_len=8)).collect()), key=lambda r: r[1])
    want = [(None, "n"), (-1, None), (3, "a"), (3, "a"), (3, "b")]
    assert [(r[0], r[3]) for r in got] == [(d, crc([*ids_of(t), 2])) for d, t in want]
    assert [r[1] for r in got] == np.cumsum([0, *(len(ids_of(t)) + 1 for _, t in want[:-1])]).tolist()


def test_token_files_of_an_empty_table(spark):
    folder, index = write_token_files(frame(spark).where("doc_id < 0"))
    assert read_documents(folder, index).count() == 0


def check_packing(rows, want, seq_len):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == want.keys()
    for d, ids in want.items():
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[at:at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= seq_len
        padding += 0 if at & (at - 1) == 0 else seq_len - at
    return padding


def test_packing_places_each_id_once(spark):
    docs = frame(spark)
    pieces = pack(docs, seq_len=64, most_waste=0).cache()
    want = {i: [*ids_of(t), 0] for i, t in enumerate(TEXTS)}
    assert check_packing(with_checksum(pieces).collect(), want, 64) == 0
    assert sum(len(r["ids"]) for r in packed_sequences(pieces).collect()) == 2 * sum(map(len, want.values()))


def test_packing_many_equal_lengths(spark):
    docs = spark.createDataFrame([(i, "a " * (i % 5 * 7 + 3)) for i in range(400)], "doc_id long, text string").repartition(4)
    want = {i: [*ids_of("a " * (i % 5 * 7 + 3)), 0] for i in range(400)}
    assert check_packing(with_checksum(pack(docs, seq_len=64)).collect(), want, 64) < 0.03 * sum(map(len, want.values()))
    assert pack(docs.where("doc_id < 0"), seq_len=64).count() == 0


def uniform(n, seed=1):
    rng = np.random.default_rng(seed)
    return {int(k): int(v) for k, v in zip(*np.unique(rng.integers(1, 100, n), return_counts=True))}


def test_patterns_cover_all_items_near_the_bound():
    hist = uniform(20000)
    used = {}
    patterns = column_generation(hist, 100)
    for p, t in patterns:
        assert sum(k * c for k, c in p.items()) <= 100
        for k, c in p.items():
            used[k] = used.get(k, 0) + c * t
    assert used == hist and sum(t for _, t in patterns) * 100 <= 1.005 * sum(k * v for k, v in hist.items())


def test_patterns_place_most_items_and_pricing_improves_first_fit():
    for hist in (uniform(20000), uniform(500, 3)):
        placed = sum(t * sum(p.values()) for p, t in usable_patterns(hist, 100, 1))
        assert placed >= 0.8 * sum(hist.values())
    hist = {3: 300, 5: 300, 7: 300}  # with room for 15 ids first fit wastes one (7 + 7), the optimum none (7 + 5 + 3)
    lengths, need = np.array([3, 5, 7]), np.full(3, 300.0)
    assert sum(t for _, t, _ in first_fit(lengths, need, 15, whole=True)) > 300
    assert sum(t for _, t in column_generation(hist, 15)) == 300


def test_packing_with_repeated_and_null_doc_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b"), (8, None)], "doc_id long, text string")
    rows = with_checksum(pack(docs, seq_len=8)).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in rows if r["start"] == 0) == [(0, 3), (7, 3), (7, 3), (8, 1)]
