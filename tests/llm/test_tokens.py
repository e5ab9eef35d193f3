"""Token operators against the tokenizers library on the same texts."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evalweave.llm import bpe, packing, pieces, token_counts, token_files
from evalweave.llm.pieces import ByteBpe
from evalweave.session import scratch_path
from tests.llm.conftest import AWKWARD

BYTE, WORD = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PARTS = [" ", "  ", "\n", " \n", "\t", "a", "the", "'s", "'S", "'re", "'rest", "''s", "!'s", "é", "É", "É", "ß", "12", "٣", "日本", "\U0001f600", "Σ", "İ", "\xa0", "　", "<|endoftext|>", "<|endof", "'", "_", "\r\n", "Ⅷ", "²", "aaaa", "</w>"]


def random_texts(n=4000):
    rng = random.Random(3)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORD)


def test_byte_pieces(byte_library):
    texts = [*random_texts(), None, *(t for _, t in AWKWARD)]
    for number, ids, begins, ends in ByteBpe(BYTE)(texts, spans=True):
        encoded = byte_library.encode(texts[number] or "", add_special_tokens=False)
        assert encoded.ids == ids.tolist()
        assert encoded.offsets == list(zip(begins.tolist(), ends.tolist()))


def test_small_table_forgets(byte_library):
    encode = ByteBpe(BYTE)
    encode.table.most, encode.table.bits = 50, 4
    encode.table.clear()
    texts = random_texts(300)
    assert [ids.tolist() for _, ids, *_ in encode(texts)] == [byte_library.encode(t, add_special_tokens=False).ids for t in texts]


def test_prefix_bpe(word_library):
    rng = random.Random(4)
    texts = [*random_texts(), *("".join(rng.choices(letters, k=rng.randint(1, 40))) for letters in ("abenthiorsd", "aab") for _ in range(1500)), *(t for _, t in AWKWARD)]
    for text, (ids, decoded) in zip(texts, bpe.WordBpe(WORD)(texts)):
        encoded = word_library.encode(text or "", add_special_tokens=False).ids
        assert encoded == ids.tolist()
        assert word_library.decode(encoded, skip_special_tokens=False) == decoded.decode()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_any_text(word_library, byte_library, text):
    assert next(bpe.word_bpe(WORD)([text]))[0].tolist() == word_library.encode(text, add_special_tokens=False).ids
    assert next(ByteBpeOnce.get()([text]))[1].tolist() == byte_library.encode(text, add_special_tokens=False).ids


class ByteBpeOnce:
    held = None

    @classmethod
    def get(cls):
        cls.held = cls.held or ByteBpe(BYTE)
        return cls.held


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet="ab!.'1é \u0085\u001c\u001d\u001e\u001f\u180e\u00a0\u2028\n", max_size=60))
def test_cut_places(word_library, byte_library, text):
    """Texts cut every few characters give the pieces of whole ones, whatever counts as white space elsewhere."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(pieces.slices, "__defaults__", (7,))
        assert next(iter(pieces.byte_bpe(BYTE)([text])))[1].tolist() == byte_library.encode(text, add_special_tokens=False).ids
        assert next(bpe.word_bpe(WORD)([text]))[0].tolist() == word_library.encode(text, add_special_tokens=False).ids


def test_ids_too_wide():
    writer = token_files.FrameWriter(None, 2)
    writer.add(1, np.array([65535], dtype=np.uint32))
    with pytest.raises(ValueError, match="70000"):
        writer.add(2, np.array([3, 70000], dtype=np.uint32))


def test_encode_documents(docs_of, word_library):
    rows = bpe.encode_documents(docs_of(AWKWARD), WORD, bpe.digests, "n_tokens BIGINT, ids_sha256 STRING, decoded_sha256 STRING").collect()
    expected = []
    for doc_id, text in AWKWARD:
        ids = word_library.encode(text or "", add_special_tokens=False).ids
        decoded = word_library.decode(ids, skip_special_tokens=False)
        expected.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=repr) == sorted(expected, key=repr)
    whole = bpe.encode_documents(docs_of(AWKWARD[3:4]), WORD).collect()[0]
    assert whole.decoded == word_library.decode(list(whole.ids), skip_special_tokens=False)
    assert bpe.encode_documents(docs_of([]), WORD).collect() == []


def test_token_files(spark, docs_of, byte_library):
    rows = AWKWARD + [(20 + k, t) for k, t in enumerate(random_texts(300))]
    files = token_files.write_token_files(docs_of(rows), scratch_path(spark, "files"), BYTE, end_id=2, frame_bytes=512, files=4)
    assert files.count() > 1
    expected, start = [], 0
    for doc_id, text in sorted(rows, key=lambda row: (row[0] is not None, row[0] or 0, row[1] or "")):
        ids = [*byte_library.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = token_files.read_token_files(files, emit=token_files.digest_rows, columns="n_tokens BIGINT, ids_crc32 BIGINT").collect()
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    asked = spark.createDataFrame([(4,), (25,), (999,), (None,)], "doc_id BIGINT")
    some = {row.doc_id: bytes(row.ids) for row in token_files.read_token_files(files, asked).collect()}
    assert set(some) == {4, 25} and np.frombuffer(some[25], "<u4").tolist() == [*byte_library.encode(dict(rows)[25], add_special_tokens=False).ids, 2]
    empty = token_files.write_token_files(docs_of([]), scratch_path(spark, "files"), BYTE, end_id=2)
    assert token_files.read_token_files(empty).collect() == []


def test_reader_takes_only_its_frames_and_checks_them(tmp_path):
    path = tmp_path / "ids.zst"
    documents = [np.arange(k, k + 200, dtype=np.uint32) for k in range(50)]
    with open(path, "wb") as sink:
        writer = token_files.FrameWriter(sink, 2, 256)
        for k, ids in enumerate(documents):
            writer.add(k, ids)
        writer.close()

    class Source:
        def __init__(self, raw):
            self.raw, self.at = raw, 0

        def size(self):
            return len(self.raw)

        def seek(self, at):
            self.at = at

        def read(self, n):
            return self.raw[self.at : self.at + n]

    raw = path.read_bytes()
    reader = token_files.FrameReader(Source(raw))
    assert reader.ids(17).tolist() == documents[17].tolist() and reader.frames_read <= 3
    broken = bytearray(raw)
    broken[-9 - 12 * len(reader.sums) + 8] ^= 1  # the first frame's checksum
    with pytest.raises(ValueError, match="checksum"):
        token_files.FrameReader(Source(bytes(broken))).ids(0)


def brute_sections(offsets, spans, rule):
    counts, outside = [0.0] * len(spans), 0.0
    for begin, end in offsets:
        shared = [max(0, min(end, stop) - max(begin, start)) for start, stop in spans]
        if rule == "split":
            for k, n in enumerate(shared):
                counts[k] += n / (end - begin)
            outside += 1 - sum(shared) / (end - begin)
        elif not any(shared) or rule == "start" and not any(a <= begin < b for a, b in spans):
            outside += 1
        else:
            counts[shared.index(max(shared)) if rule == "majority" else [a <= begin < b for a, b in spans].index(True)] += 1
    return counts, outside


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_tokens(spark, byte_library, rule):
    rng = random.Random(6)
    rows = []
    for k, text in enumerate(random_texts(200)):
        cuts = sorted(rng.randint(0, len(text)) for _ in range(6))
        rows.append((k, text, [(a, b) for a, b in zip(cuts[::2], cuts[1::2])]))
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, spans ARRAY<STRUCT<start: INT, end: INT>>")
    found = {}
    for row in token_counts.section_tokens(docs, BYTE, "spans", rule).collect():
        found[row.doc_id, row.section] = row.n_tokens
    for k, text, spans in rows:
        counts, outside = brute_sections(byte_library.encode(text, add_special_tokens=False).offsets, spans, rule)
        assert [found[k, n] for n in range(len(spans))] == pytest.approx(counts)
        assert found.get((k, -1), 0) == pytest.approx(outside)


def test_line_tokens(docs_of, byte_library):
    rows = token_counts.section_tokens(docs_of(AWKWARD), BYTE).collect()
    for doc_id, text in AWKWARD:
        if text is None:
            assert not [row for row in rows if row.doc_id == doc_id]
        elif doc_id != 5:
            own = [row for row in rows if row.doc_id == doc_id]
            assert sum(row.n_tokens for row in own) == len(byte_library.encode(text, add_special_tokens=False).ids)
            assert len(own) == text.count("\n") + 1
    assert len([row for row in rows if row.doc_id == 5]) == 4
    assert token_counts.section_tokens(docs_of([]), BYTE).collect() == []


def packed_well(rows, capacity):
    sequences = {}
    for row in rows:
        sequences.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def best_fit_decreasing(lengths, capacity):
    gaps, n = [], 0
    for length in sorted(lengths, reverse=True):
        fitting = [gap for gap in gaps if gap >= length]
        if fitting:
            gaps.remove(min(fitting))
            gaps.append(min(fitting) - length)
        else:
            n += 1
            gaps.append(capacity - length)
    return n


@pytest.mark.parametrize("stretch_rows", [97, 10_000])
def test_pack(spark, stretch_rows):
    rng = random.Random(8)
    lengths = [min(100, max(1, int(rng.lognormvariate(3, 1)))) for _ in range(700)] + [40] * 400
    items = spark.createDataFrame([(k, n, "x") for k, n in enumerate(lengths)], "item BIGINT, length INT, offset STRING")
    rows = packing.pack(items, 100, stretch_rows).collect()
    assert sorted((row.item, row.length) for row in rows) == list(enumerate(lengths))
    assert packed_well(rows, 100) <= 1.03 * best_fit_decreasing(lengths, 100)


def test_pack_edges(spark):
    items = spark.createDataFrame([(1, None), (2, 0), (3, -5), (4, 11), (5, 10), (6, 1), (7, 9)], "item BIGINT, length INT")
    rows = {row.item: (row.sequence_id, row.offset) for row in packing.pack(items, 10).collect()}
    assert [rows[k] for k in (1, 2, 3, 4)] == [(None, None)] * 4
    assert rows[5] == (5, 0) and rows[6][0] == rows[7][0]
    assert packing.pack(items.limit(0), 10).collect() == []


def test_pack_documents(docs_of, byte_library):
    rows = packing.pack_documents(docs_of(AWKWARD), BYTE, capacity=2048).collect()
    packed_well(rows, 2048)
    pieces = {}
    for row in rows:
        pieces.setdefault((row.doc_id, row.piece), []).append((row.start, row.length, row.ids_crc32))
    for doc_id, text in AWKWARD:
        ids = np.array([*byte_library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        bounds = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            assert (a, b - a, zlib.crc32(ids[a:b].tobytes())) in pieces[doc_id, k]
    assert sum(len(own) for key, own in pieces.items() if key[0] == 5) == 2
    assert packing.pack_documents(docs_of([]), BYTE).collect() == []
