"""Token operators against the libraries, over odd texts, code points and random strings."""

import hashlib
import zlib

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from primerflow.llm import bpe_codec, packing, perfect_hash, pattern_fit, token_count, token_store
from primerflow.llm.library import library
from primerflow.llm.units import units
from primerflow.llm.vocab import ids_of, pattern, public, ranks_of, tokenizer

BYTES, WORDS, RANKS = (public(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"))
TEXTS = st.text(st.sampled_from("ab  \n\t'sé1.☃😀\x1c\x85　 ΣİǺ\0<|endoftext|>"), max_size=40)


PLAIN = tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=ranks_of(RANKS), special_tokens={})


def ids(path, text):
    return tokenizer(path).encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def reference():
    return PLAIN


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=5))
def test_cut_texts_have_the_ids_of_whole_texts(texts):
    for path in (BYTES, WORDS):
        assert [np.frombuffer(x, "<u4").tolist() for x in library(path).packed(texts)] == [ids(path, t) for t in texts]
    assert all("".join(units(t)) == t for t in texts)


def test_every_code_point_with_every_kind_of_neighbour():
    """Each character doubled, behind letters, digits and spaces, and with combining marks, as the library reads it whole."""
    planes = [*range(0x40000), *range(0xE0000, 0xE1000)]  # those with assigned characters
    texts = []
    for first in range(0, len(planes), 64):
        chars = [chr(cp) for cp in planes[first : first + 64] if not 0xD800 <= cp < 0xE000]
        texts.append("\n".join(f"A{c}{c}1{c} {c}b\u0301{c}\u0323 \u0301{c}{c} {c}" for c in chars))
    for path in (BYTES, WORDS):
        assert library(path).packed(texts) == [np.array(x, "<u4").tobytes() for x in ids_of(path, texts)]


@pytest.mark.parametrize("slot_bits, store", [(1, 12), (3, 40), (12, 1000)])
def test_what_the_library_said_is_forgotten_in_turn(monkeypatch, slot_bits, store):
    from primerflow.llm import library as module

    monkeypatch.setattr(module, "SLOT_BITS", slot_bits)
    monkeypatch.setattr(module, "STORE", store)
    monkeypatch.setattr(module, "_TEXT", 20)
    texts = ["one two three four", "two three fivefivefive", "", "one <|endoftext|> six", "four one", " ", "x ", " x", "a  b\n c " * 9, "ONE <|ENDOFTEXT|> Two, \u00e9t\u00e9!! \u00c9T\u00c9 l'\u00e9t\u00e9's,"] * 3
    for path in (BYTES, WORDS):
        one = module.Library(path)
        assert [np.frombuffer(x, "<u4").tolist() for x in one.packed(texts)] == [ids(path, t) for t in texts]
        assert one.used <= store and one.n.size == 2**slot_bits


def test_long_texts_are_cut_where_their_ids_allow():
    text = "Word, w\u00f6rter \u4e2d\u6587  <|endoftext|> don't 12\n" * 20_000
    for path in (BYTES, WORDS):
        for t in (text, text.replace(" ", "\t"), "\u4e2d" * 600_000):
            assert library(path).packed([t, "tail"]) == [np.array(x, "<u4").tobytes() for x in ids_of(path, [t, "tail"])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab\u00df\u00e9\u00ff\u00d7\u00f7\u00f8\u0301 ,.!%&*<|>'sI\u0130"), max_size=30), max_size=5))
def test_marks_behind_letters(texts):
    for path in (BYTES, WORDS):
        assert [np.frombuffer(x, "<u4").tolist() for x in library(path).packed(texts)] == [ids(path, t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZ\u00e9\u00d7\u00aa\u0416\u4e2d1 \n\r\t\x0b\x85\xa0\u3000.,'\"-()<|>\u0301"), max_size=20) | st.sampled_from(["<|endoftext|>", "a'll\nb's", ".\n<|endoftext", "|>.\n"]), max_size=20))
def test_marks_and_lines_behind_letters(texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in library(BYTES).packed(texts)] == [ids(BYTES, t) for t in texts]


def test_a_word_is_asked_once_whatever_follows_it(monkeypatch):
    from primerflow.llm import library as module

    asked = []
    monkeypatch.setattr(module, "ids_of", lambda path, texts: asked.extend(texts) or ids_of(path, texts))
    one = module.Library(BYTES)
    texts = ["x wordy, wordy. wordy\nline wordy!!", "x wordy.\nline, wordy) wordy's\nline.", "x wordy"]
    assert [np.frombuffer(x, "<u4").tolist() for x in one.packed(texts)] == [ids(BYTES, t) for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in one.packed(["x wordy?\nline wordy"])] == [ids(BYTES, "x wordy?\nline wordy")]
    whole = "".join(asked)
    assert whole.count("wordy") == 1 and whole.count("line") == 1 and one.mark not in whole


def test_a_vocabulary_without_all_bytes(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    small = Tokenizer(models.BPE({"a": 0, "b": 1, "\u0120": 2, "ab": 3, "\u0120a": 4, ",": 5}, [("a", "b"), ("\u0120", "a")]))
    small.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    small.add_special_tokens(["<|endoftext|>"])
    small.save(path := str(tmp_path / "small.json"))
    texts = ["ab ab, xa\nab zz", "x", "a<|endoftext|> xb"]
    assert [np.frombuffer(x, "<u4").tolist() for x in library(path).packed(texts)] == [ids(path, t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_codec_round_trip(text):
    codec = bpe_codec.codec(RANKS)
    packed = codec.encode(text)
    assert codec.decode(packed) == text.encode()
    assert np.frombuffer(packed, "<u4").tolist() == PLAIN.encode_ordinary(text)


def test_codec_table(odd, odd_rows, empty, reference):
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_codec.round_trip(odd, RANKS).collect())
    enc = lambda t: reference.encode_ordinary(t or "")
    want = sorted((i or -1, len(enc(t)), hashlib.sha256(np.array(enc(t), "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in odd_rows)
    assert got == want
    assert bpe_codec.round_trip(empty, RANKS).count() == 0
    back = bpe_codec.decode(bpe_codec.encode(odd, RANKS), RANKS)
    assert sorted(bytes(r.content) for r in back.collect()) == sorted((t or "").encode() for _, t in odd_rows)


def test_token_counts(odd, odd_rows, empty):
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in token_count.count(odd, BYTES).collect())
    assert got == sorted((i or -1, len((t or "").encode()), len(ids(BYTES, t or ""))) for i, t in odd_rows)
    assert token_count.count(empty, BYTES).count() == 0


def test_packed_pieces_keep_large_values():
    rank = np.arange(400_000)[::-1].copy()
    rows = [(1, 2, np.array([5, 399_999]), np.array([1, 300])), (None, 0, np.array([], int), np.array([], int)), (3, 4, np.array([0]), np.array([255]))]
    out_ids, null, size, each, place, times = token_count.unpack(token_count.pack(rows, rank))
    assert out_ids.tolist() == [1, 0, 3] and null.tolist() == [0, 1, 0] and size.tolist() == [2, 0, 4] and each.tolist() == [2, 0, 1]
    assert list(zip(place.tolist(), times.tolist())) == [(0, 300), (399_994, 1), (399_999, 255)]


def test_store_reads_back_by_key(spark, odd, odd_rows, empty):
    store = token_store.write(odd, BYTES)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.digests(store).collect())
    rows, start = [], 0
    for i, t in sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        one = np.array([*ids(BYTES, t or ""), 0], "<u4")
        rows.append((start, i, one.size, zlib.crc32(one.tobytes())))
        start += one.size
    assert got == rows
    assert token_store.digests(token_store.write(empty, BYTES)).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=300), st.integers(0, 2**64 - 1))
def test_perfect_hash(keys, other):
    k = np.array(keys, np.uint64)
    h = perfect_hash.PerfectHash.build(k)
    assert sorted(h.slots(k).tolist()) == list(range(len(keys)))
    slot = h.slots(np.array([other], np.uint64))[0]
    assert -1 <= slot < max(1, len(keys))


def test_perfect_hash_lists_equal_keys():
    h = perfect_hash.PerfectHash.build(np.array([7, 7, 8], np.uint64))
    assert h.left.size == 2 and h.slots(np.array([8], np.uint64))[0] == 0


def check_plan(histogram):
    kinds = pattern_fit.plan(histogram)
    used = np.zeros_like(histogram)
    for kind, n in kinds:
        assert sum(a * b for a, b in kind.items()) < histogram.size
        for size, m in kind.items():
            used[size] += m * n
    assert (used == histogram).all()
    return sum(n for _, n in kinds)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=33, max_size=33))
def test_plan_places_all(counts):
    h = np.array(counts)
    h[0] = 0
    tokens = int((h * np.arange(33)).sum())
    assert check_plan(h) <= -(-tokens // 32) * 1.5 + 1


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(1)
    h = np.bincount(np.minimum(rng.lognormal(5.5, 1, 20_000).astype(int) + 1, 2048), minlength=2049)
    assert check_plan(h) <= 1.002 * -(-int((h * np.arange(2049)).sum()) // 2048)


@pytest.mark.parametrize("pieces", [1_000, 20_000, 2_000_000])
def test_patterns_place_the_most(pieces):
    rng = np.random.default_rng(2)
    h = np.bincount(np.minimum(rng.lognormal(6.5, 0.9, pieces).astype(int) + 1, 2048), minlength=2049)
    rows = pattern_fit.patterns(h)
    taken, left = pattern_fit.rounded(h, rows, pattern_fit.fit(h, rows))
    assert left.sum() < 0.4 * h.sum() and all(sum(a * b for a, b in kind.items()) == 2048 for kind, _ in taken)


def test_packing(odd, odd_rows, empty):
    rows = packing.pack(odd, WORDS).collect()
    want = []
    for i, t in odd_rows:
        one = np.array([*ids(WORDS, t or ""), 0], "<u4")
        want += [(i or -1, k, k * 2048, len(one[k * 2048 : (k + 1) * 2048]), zlib.crc32(one[k * 2048 : (k + 1) * 2048].tobytes())) for k in range(-(-one.size // 2048))]
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048 and len(ends) <= -(-sum(w[3] for w in want) // 2048) + 1
    assert packing.pack(empty, WORDS).count() == 0
    whole = packing.sequences(packing.pack(odd, WORDS, ids=True)).collect()
    assert sum(len(r.ids) for r in whole) == 4 * sum(w[3] for w in want)


def test_other_tasks_drop_what_workers_keep_of_the_library(spark, odd):
    """Workers go on with the library while they pack, and give it up for a task of another operator."""
    from primerflow.llm import common

    def held(keeps):
        def run(batch):
            return {"id": batch.column(0), "n": [library.cache_info().currsize + tokenizer.cache_info().currsize] * batch.num_rows}

        return {r["n"] for r in common.by_batch(spark.range(64).repartition(8), run, "id long, n long", keeps).collect()}

    packing.pieces(odd, public("word_bpe_49k.json")).count()
    assert held(True) - {0}
    assert held(False) == {0}


def test_ids_of_takes_special_strings_as_the_library_does():
    assert ids_of(BYTES, ["a<|endoftext|>b"])[0] == ids(BYTES, "a<|endoftext|>b") and 50256 in ids(BYTES, "a<|endoftext|>b")
