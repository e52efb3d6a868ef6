import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tapewise.llm import bitplanes, bpe, harmonic
from tapewise.llm.common import filesystem, table
from tapewise.llm.tokens import TextIds, default_tokenizer
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_tokenizer())


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(1)
    letters = "aeßİΣς'.,!&% \n\t\x1ćé12<|>　​ K/w"
    odd = ["", " ", "<|endoftext|>x <|startoftext|> y<|endoftext|>", "ΑΣ ΟΔΥΣΣΕΥΣ Σ", "it's I'LL they've 'S", "a\x1cb\x1d c", "İ, ŉa. ǅ ﬁ ẞ",
           "é ́x", "日本語 텍스트 ١٢٣ 12345", "ª º µ", "a..b,,c.d, ...", "x" * 3000, "ab" * 333, "the" * 300, "a\xa0b　c\x85d", "</w> a</w> <w>", "\x00\x01"]
    odd += ["".join(rng.choice(letters) for _ in range(150)) for _ in range(150)]
    odd += ["".join(rng.choice("aeinorst") for _ in range(2000)) for _ in range(5)]
    return odd + [r["text"] for r in table(spark, SMALL, "documents").limit(80).collect()]


def test_ids_by_chunk_are_the_librarys(library, texts):
    own = TextIds(default_tokenizer())
    for text in texts:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_backtracking_gives_the_librarys_ids_and_text(library, texts):
    own = bpe.BacktrackingBpe(default_tokenizer())
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids
        assert own.decode(own.encode(text)).decode() == library.decode(ids, skip_special_tokens=False)


def test_compatible_pairs_are_those_that_merging_keeps():
    """Small vocabulary: every pair of tokens against plain merging of the joined string."""
    merges = [("a", "b"), ("b", "a"), ("ab", "a"), ("a", "a"), ("aa", "ab"), ("b", "b"), ("ba", "bb")]
    vocab = {t: i for i, t in enumerate(dict.fromkeys(["a", "b", *(x + y for x, y in merges)]))}

    def plain(word):
        parts = list(word)
        while True:
            ranks = [merges.index((x, y)) if (x, y) in merges else 99 for x, y in zip(parts, parts[1:])]
            if not ranks or min(ranks) == 99:
                return parts
            at = ranks.index(min(ranks))
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    own = bpe.Backtracker(vocab, merges, None)
    whole = [t for t in vocab if plain(t) == [t]]
    for x in whole:
        for y in whole:
            assert own.compatible(vocab[x], vocab[y]) == (plain(x + y) == [x, y]), (x, y)
    for n in range(1, 11):
        for k in range(2 ** n):
            word = "".join("ab"[k >> i & 1] for i in range(n))
            assert own.encode(word) == [vocab[t] for t in plain(word)], word


def test_encode_decode_tables(spark, odd_docs, odd_rows, no_docs, library):
    got = bpe.decode(bpe.encode(odd_docs)).collect()
    want = [(i, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in odd_rows]
    assert Counter(map(tuple, got)) == Counter(want)
    digests = bpe.round_trip_digests(odd_docs)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in digests.collect()) == Counter(
        (i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in odd_rows)
    assert bpe.round_trip_digests(no_docs).count() == 0


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    ids = np.random.default_rng(0).integers(0, 2 ** 32, 1001, dtype=np.uint32)
    planes = bitplanes.to_planes(ids, bits)
    assert len(planes) == (32 if bits else 4)
    assert (bitplanes.from_planes(planes, len(ids), bits) == ids).all()


@pytest.mark.parametrize("options", [{"block": 64}, {"block": 7, "bits": True}, {}])
def test_plane_files_hold_all_documents_in_order(spark, odd_docs, odd_rows, library, options):
    got = bitplanes.planes_round_trip(spark, odd_docs, **options).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in odd_rows), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    want = Counter()
    for i, t in odd_rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want


def test_plane_files_of_no_documents(spark, no_docs):
    assert bitplanes.planes_round_trip(spark, no_docs).count() == 0


def test_a_chunk_can_be_read_alone(spark, odd_docs, tmp_path):
    manifest = bitplanes.write_planes(odd_docs, str(tmp_path / "planes"), block=32).filter("n_ids > 64").first()
    fs, path = filesystem(manifest["path"])
    with fs.open_input_file(path) as source:
        reader = bitplanes.PlaneReader(source)
        whole = b"".join(ids for _, _, ids in reader.documents())
        assert reader.chunk(1).tobytes() == whole[4 * 32:4 * 64]
        assert reader.n_ids == len(whole) // 4


def test_cut_lengths():
    for n in [*range(1, 9000), 40_960, 123_457]:
        lengths = harmonic.cut_lengths(n)
        assert sum(lengths) == n and min(lengths) > 0 and max(lengths) <= 4096
        for length in lengths:
            j = 4096 // length
            assert 4096 - j * length <= max(4096 / 128, j)  # a set of class mates leaves little room


def test_packing(spark, odd_docs, odd_rows, no_docs, library):
    rows = harmonic.pack_documents(odd_docs, with_ids=True).collect()
    want = Counter()
    for i, t in odd_rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[i, len(ids)] += len(ids)
    have = Counter()
    for r in rows:
        have[r["doc_id"], r["doc_tokens"]] += r["length"]
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    assert have == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(bins) == list(range(len(bins)))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert harmonic.pack_documents(no_docs).count() == 0


def test_packed_sequences_hold_the_ids(spark, odd_docs):
    packed = harmonic.pack_documents(odd_docs, with_ids=True).cache()
    for s in harmonic.sequences(packed, pad_id=7).collect():
        ids = np.frombuffer(bytes(s["ids"]), "<u4")
        n = s["n_tokens"]
        assert len(ids) == (n if n & (n - 1) == 0 else 4096) and (ids[n:] == 7).all()
        parts = sorted(packed.filter(packed["sequence_id"] == s["sequence_id"]).select("offset", "ids").collect())
        assert ids[:n].tobytes() == b"".join(bytes(p["ids"]) for p in parts)
        if s["sequence_id"] > 12:
            break


def test_padding_is_little(spark):
    docs = table(spark, SMALL, "documents")
    per = harmonic.pack_documents(docs).groupBy("sequence_id").sum("length").collect()
    tokens = [r[1] for r in per]
    assert sum(n if n & (n - 1) == 0 else 4096 for n in tokens) <= 1.02 * sum(tokens) + 4096
