"""Alignment of two tokenizers against their own libraries, text by text."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from finrecon.llm import alignment as al
from finrecon.llm import op11
from finrecon.llm import textarrays as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, row string, pair string, block string, bits string"
HARD = [
    "", None, " ", "\n", " a", "  a  b ", "a\r\nb;\r\n", "x▁y", "<s>a<|endoftext|>b<0x41>", "日本語 é 　x  y", "\x00\x01 \x0b\x0c\rq", "a\n\n\nb\t\tc   ", "\U0001f600\U0001f600 é",
    "don't they'll 'S  \n 'x", "!!!???...  ---\n---", "\r\n\r\n x", "the the the the", "the", "x" * 5000, "the cat " * 3000,
]


@pytest.fixture(scope="module")
def own_libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    plain = {i: first.decode([i]) for i in range(128)}
    spelt = al._spelt_a(A)
    assert all(spelt[i].decode() == s for i, s in plain.items() if "�" not in s)

    def one(text):
        """(n_a, n_b, n_groups, links, digest) of a text, None without tokens."""
        if not text:
            return None
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        bytes_a = [spelt[i] for i in a]
        bytes_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        raw = (" " + text).encode()
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            return None
        end_a, end_b = (np.cumsum([len(x) for x in side]).tolist() for side in (bytes_a, bytes_b))
        groups, i, j = [], 0, 0
        for cut in sorted(set(end_a) & set(end_b)):
            i_, j_ = i, j
            while i < len(a) and end_a[i] <= cut:
                i += 1
            while j < len(b) and end_b[j] <= cut:
                j += 1
            groups.append(",".join(map(str, a[i_:i])) + "|" + ",".join(map(str, b[j_:j])))
        owner_a = np.repeat(np.arange(len(a)), [len(x) for x in bytes_a])
        owner_b = np.repeat(np.arange(len(b)), [len(x) for x in bytes_b])
        links = Counter((a[x], b[y]) for x, y in set(zip(owner_a.tolist(), owner_b.tolist(), strict=True)))
        return len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()

    return one


def brute(one, texts):
    found = [one(t) for t in texts]
    docs = Counter(p for x in found if x for p in x[3])
    links = Counter()
    for x in found:
        links.update(x[3] if x else {})
    highest = defaultdict(int)
    for (a, _), n in docs.items():
        highest[a] = max(highest[a], n)
    rows = [
        (x[0], x[1], x[2], sum(x[3].values()), sum(n for p, n in x[3].items() if docs[p] == highest[p[0]]), sum(n * docs[p] for p, n in x[3].items()), x[4]) if x else (0, 0, 0, 0, 0, 0, "")
        for x in found
    ]
    return rows, {(a, b, n, links[a, b], n == highest[a]) for (a, b), n in docs.items()}


def test_alignment_of_hard_texts(spark, own_libraries, monkeypatch):
    texts = [*HARD, "the cat sat", "the cat sat", *HARD[:6]]
    docs = spark.createDataFrame([(None if i == 3 else i % 20, t, "clash", "clash", "clash", "clash") for i, t in enumerate(texts)], SCHEMA).repartition(3, "doc_id")
    order = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found, pairs = al.aligned(docs, A, B)
    rows, counts = brute(own_libraries, [t for _, t in order])
    assert Counter(tuple(r) for r in found.collect()) == Counter((i, *r) for (i, _), r in zip(order, rows, strict=True))
    assert {tuple(r) for r in pairs.collect()} == counts


def test_op11_equals_brute_force(spark, small, own_libraries):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    rows, _ = brute(own_libraries, [d["text"] for d in docs])
    assert {tuple(r) for r in op11.op11_token_alignment(spark, small).collect()} == {(d["doc_id"], *r) for d, r in zip(docs, rows, strict=True)}


def test_many_flushes_and_blocks_of_one_pair(own_libraries):
    """Small flushes give several bitmaps of one pair and block, which are OR-merged; numbers of several blocks lie in one batch."""
    texts = ["the cat " * (i % 5 + 1) for i in range(300)]
    numbers = [i * 1000 for i in range(300)]
    batches = [pa.record_batch([pa.array(numbers[k : k + 50]), pa.array(texts[k : k + 50]), pa.array(numbers[k : k + 50])], ["row", "text", "id"]) for k in range(0, 300, 50)]
    old, al.FLUSH_LINKS = al.FLUSH_LINKS, 50
    try:
        out = [b for b in al._map(A, B)(iter(batches)) if b.column("pair").null_count == 0]
    finally:
        al.FLUSH_LINKS = old
    index = pa.Table.from_batches(out).select(["pair", "block", "plane", "bits"]).sort_by([("pair", "ascending"), ("block", "ascending"), ("plane", "ascending")])
    pieces = index.to_batches(max_chunksize=7)
    merged = pa.Table.from_batches(list(al._merged(iter(pieces))))
    keys = list(zip(*(merged.column(k).to_pylist() for k in ("pair", "block", "plane")), strict=True))
    assert len(keys) == len(set(keys)) < len(index)
    rows, counts = brute(own_libraries, texts)
    docs, links = Counter(), Counter()
    for (pair, _, plane), n in zip(keys, merged.column("n").to_pylist(), strict=True):
        docs[pair >> 16, pair & 0xFFFF] += n if plane < 0 else 0
        links[pair >> 16, pair & 0xFFFF] += n << max(plane, 0)
    assert {(a, b, n, links[a, b]) for (a, b), n in docs.items()} == {c[:4] for c in counts}


def test_bitmaps_give_back_their_places():
    draw = np.random.default_rng(1)
    sets = [np.unique(draw.integers(0, high, n)) for high, n in ((65536, 3), (65536, 50_000), (100, 90), (1, 1), (65536, 1), (17, 17), (4096, 300))]
    key, place = np.repeat(np.arange(len(sets)), list(map(len, sets))), np.concatenate(sets)
    k, n, bits = al.bitmaps(key, place)
    row, again = al.places(pa.array(bits, pa.binary()))
    assert k.tolist() == list(range(len(sets))) and n.tolist() == list(map(len, sets))
    assert np.array_equal(row, key) and np.array_equal(again, place)
    assert any(len(b) % 2 for b in bits) and len(bits[1]) < 2 * len(sets[1])


def test_store_survives_equal_hashes(monkeypatch, own_libraries):
    plain = ta.Words.hashes
    monkeypatch.setattr(ta.Words, "hashes", lambda self, key=0: plain(self, key) if key else np.minimum(plain(self, key), np.uint64(1 << 62)))
    aligner = al.Aligner(A, B)
    texts = al.led(next(ta.pieces(pa.array(["one two three four five six seven"])))[1])
    found = aligner.chunks(texts)
    row = aligner.look_up(found)
    assert aligner.key > 0 and aligner.n_a[row].sum() == own_libraries("one two three four five six seven")[0]


def test_no_rows(spark):
    found, pairs = al.aligned(spark.createDataFrame([], SCHEMA), A, B)
    assert found.collect() == [] and pairs.collect() == []
