import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from hearthspan.llm import bpe, packed

TEXTS = ["", None, " ", "  a", " a", "a ", "a  b", "a\n b", "a\t\tb c", " x y", "x　 y", "it's we'll 123 4567 ABC!!! ??\n\n\n  foo", "é" * 700, "x" * 3000 + " " + "ab" * 400, " " * 2000,
         "\n" * 300 + "z", "\x1c a \x1d\x1e b", "日本語 テキスト 😀😀 ok", "<|endoftext|> hi", "a <|endoftext|> b", "a<|endoftext|>b <|endoftext|><|endoftext|>", " <|endoftext|>", "x <|endoftext|>y z", "a\x85b \x85 c", "\r\n a\r\n"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    return TEXTS + ["".join(rng.choice(" \n\tab,.é'1 s") for _ in range(rng.randint(1, 60))) for _ in range(500)]


@pytest.fixture(scope="module")
def by_tiktoken():
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@pytest.fixture(scope="module")
def by_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packed.default_vocabulary())  # as it is: the end-of-text string is its special token
    return lambda x: t.encode(x, add_special_tokens=False).ids


def split(chunks, texts):
    column = pa.array(texts, pa.string())
    out = []
    for i, j in bpe.slices(column, 2000):
        ids, counts = chunks.texts(column.slice(i, j - i))
        out += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    return out


def test_ids_are_those_of_tiktoken(texts, by_tiktoken):
    code = bpe.Encoder(*bpe.default_vocabulary())
    code.chunks.most = 300  # forgetting is part of it
    got = split(code.chunks, texts)
    assert got == [by_tiktoken(t or "") for t in texts]
    assert [code.decode(x) for x in got] == [(t or "").encode() for t in texts]


def test_long_and_short_merges_agree():
    code = bpe.Encoder(*bpe.default_vocabulary())
    rng = random.Random(1)
    for w in [rng.randbytes(rng.randint(2, 300)) for _ in range(60)] + [b"ab" * 200]:
        assert bpe.merge_together(code.ranks, [w])[0].tolist() == bpe.merge_one(code.ranks, w)


def test_library_by_chunks(texts, by_library):
    assert split(packed.Library(packed.default_vocabulary()).chunks, texts) == [by_library(t or "") for t in texts]


@pytest.mark.parametrize("bits", [1, 3, 7, 11, 16, 17, 31])
def test_packing_round_trip(bits):
    x = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype(np.int64)
    assert (packed.unpack(packed.pack(x, bits), bits, 1001) == x).all()


def test_encoded(docs_of, odd_rows, by_tiktoken):
    out = bpe.encoded(docs_of(odd_rows)).collect()
    key = lambda r: str(r)
    want = []
    for i, t in odd_rows:
        ids = by_tiktoken(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key)
    assert bpe.encoded(docs_of([])).count() == 0


def test_files_hold_all_ids(spark, docs_of, odd_rows, by_library, tmp_path):
    rows = odd_rows + [(i, f"text number {i}\n" * (i % 9)) for i in range(20, 120)]
    packed.write_ids(docs_of(rows), str(tmp_path / "ids"), block=64, file_ids=2000)
    out = packed.read_ids(spark, str(tmp_path / "ids")).orderBy("start").collect()
    order = [r.doc_id for r in out]
    assert order == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    ids = {i: by_library(t or "") + [2] for i, t in rows}
    start = 0
    for r in out:
        assert r.start == start and r.ids == ids[r.doc_id] and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    file = next(p for p in (tmp_path / "ids").iterdir() if p.suffix == ".txt" and p.stat().st_size > 500)
    reader = packed.Reader(file.read_bytes())
    whole = reader.ids(0, reader.total)
    for a in range(0, reader.total - 40, 37):
        assert (reader.ids(a, a + 40) == whole[a : a + 40]).all()
    assert (reader.document(2) == whole[reader.ends[1] : reader.ends[2]]).all()


def test_the_special_token_is_one_id_and_the_smallest_long_an_id(docs_of):
    rows = [(-(1 << 63), "a <|endoftext|> b"), (None, "x"), (5, None)]
    got = [(r.doc_id, r.start, r.n_tokens) for r in packed.written_and_read(docs_of(rows), with_ids=True).orderBy("start").collect()]
    assert got == [(None, 0, 2), (-(1 << 63), 2, 5), (5, 7, 1)]


def test_one_id_in_many_files(docs_of):
    rows = [(7, f"the same id {n} " * 20) for n in range(200)] + [(None, "none")] * 50
    out = packed.written_and_read(docs_of(rows), file_ids=500).collect()
    assert sorted(r.doc_id or 0 for r in out) == [0] * 50 + [7] * 200
    ends = sorted((r.start, r.n_tokens) for r in out)
    assert ends[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:]))


def test_empty_table_writes_no_ids(docs_of):
    assert packed.written_and_read(docs_of([])).count() == 0


def test_ids_are_moved_but_not_written_before_they_are_filed(spark, docs_of, tmp_path, monkeypatch):
    names = []
    monkeypatch.setattr(packed, "scratch", lambda spark, name: names.append(name) or str(tmp_path / name))
    rows = [(n // 3, f"text {n} " * 30) for n in range(90)] + [(-(1 << 63), f"least {n}") for n in range(40)] + [(None, f"none {n}") for n in range(40)]
    out = packed.written_and_read(docs_of(rows), file_ids=300).orderBy("start").collect()
    assert names == ["ids"] and len([p for p in (tmp_path / "ids").iterdir() if p.suffix == ".txt"]) > 5
    assert [r.doc_id for r in out] == [None] * 40 + [-(1 << 63)] * 40 + [n // 3 for n in range(90)]
