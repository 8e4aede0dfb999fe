import hashlib
import random
import zlib

import numpy as np
import pytest

from assayer.llm import bpe, pieces, token_files
from assayer.llm.registered import vocabulary

tokenizers = pytest.importorskip("tokenizers")
PATH = vocabulary("byte_bpe_50k.json")
LETTERS = " \n\t ab'sétßñ1२٣!?$%　 \x85\x1c<|endoftext|>漢字🙂́"


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def texts():
    random.seed(3)
    out = ["".join(random.choice(LETTERS) for _ in range(random.randint(0, 60))) for _ in range(1500)]
    return out + ["", " ", "  ", "a   b", " lead", "trail ", "don't  I'll\n\n  he's ", "x <|endoftext|>y<|endoftext|>", "word " * 3000, "a" * 4000]


def test_words_by_speculation_equal_the_library(library):
    found, at = bpe.Codec(PATH).encode(texts())
    assert [found[a:b].tolist() for a, b in zip(at, at[1:])] == [x.ids for x in library.encode_batch(texts(), add_special_tokens=False)]


def test_merging_together_equals_merging_alone():
    own = bpe.Codec(PATH)
    words = [w.encode() for t in texts() for w in t.split()] + [b"abcabcabc", b"aaaaaaa"]
    assert [list(x) for x in own.merged_together(words)] == [own.merged(w) for w in words]


def test_compatible_pairs_are_those_that_merging_keeps():
    own = bpe.Codec(PATH)
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 5000, 4000), rng.integers(0, 5000, 4000)
    expected = [own.merged(own.bytes[x] + own.bytes[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert own.compatible(a, b).tolist() == expected and 0 < sum(expected) < 4000


@pytest.mark.parametrize("most", [5, 40, 200])
def test_cache_may_forget_at_any_time(library, most):
    own = bpe.Codec(PATH)
    own.encoder.most = most
    for t in texts()[:200]:
        assert own.encode([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_round_trip_and_digests(spark, odd, library):
    found = sorted(tuple(r) for r in bpe.round_trip(odd, PATH).collect() if r.doc_id is not None)
    expected = []
    for r in odd.collect():
        if r.doc_id is not None:
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            back = library.decode(ids, skip_special_tokens=False)
            expected.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert found == sorted(expected)
    encoded = bpe.encode(odd, PATH)
    decoded = {(r.doc_id, r.text) for r in bpe.decode(encoded, PATH).collect()}
    assert decoded == {(r.doc_id, r.text or "") for r in odd.collect()}


def test_half_characters_decode_as_in_the_library(library):
    own = bpe.Codec(PATH)
    ids = library.encode("漢字 é", add_special_tokens=False).ids
    for cut in range(len(ids) + 1):
        for some in (ids[:cut], ids[cut:]):
            assert own.decode(np.array(some, np.int64), np.array([0, len(some)]))[0].decode() == library.decode(some, skip_special_tokens=False)


def test_token_files(spark, odd, library, tmp_path):
    parts = token_files.write(odd, str(tmp_path / "ids"), PATH, 2, parts=4)
    found = token_files.read(spark, str(tmp_path / "ids"), parts).orderBy("start").collect()
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start, expected = 0, []
    for r in rows:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        expected.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in found] == expected
    files = {p["part"] for p in parts}
    assert sum(np.memmap(tmp_path / "ids" / f"{p:05d}.ids", "<u2", "r").size for p in files) == start


def test_empty_tables(spark, empty, tmp_path):
    assert bpe.round_trip(empty, PATH).count() == bpe.encode(empty, PATH).count() == 0
    parts = token_files.write(empty, str(tmp_path / "none"), PATH, 2)
    assert parts == [] and token_files.read(spark, str(tmp_path / "none"), parts).count() == 0


@pytest.mark.parametrize("most", [6, 300, 100_000])
def test_counting_keeps_no_ids_and_few_pieces(library, most):
    encoder = token_files.library.__wrapped__(PATH)[0]
    encoder.most_counted, expected = most, [len(x.ids) for x in library.encode_batch(texts(), add_special_tokens=False)]
    rows = [encoder.counted(texts()[a : a + 100]).tolist() for a in range(0, len(texts()), 100)]
    assert [n for row in rows for n in row] == expected
    assert len(encoder.known) == len(encoder.special) and len(encoder.numbers) <= max(most // 2, len(encoder.special))
    own = encoder.counted(texts())
    assert own.tolist() == expected and encoder.counted([]).tolist() == []


def test_counting_looks_up_distinct_pieces_only(library, monkeypatch):
    odd = ["", " ", "  ", " a", "  a", "a  b", "a ", "a \n b", "x\n\n y", "\x00 b", "a\u00a0 b", "a\u00a0b c", "<|endoftext|> a", "a <|endoftext|>", "it's, no", "no, no. \u00e9t\u00e9, a), b.. c: d! e?! f'.", "\u6f22, a1, .", "\U0001f642 \u6f22 a"]
    encoder = token_files.library.__wrapped__(PATH)[0]
    for _ in range(2):
        assert encoder.counted(odd).tolist() == [len(x.ids) for x in library.encode_batch(odd, add_special_tokens=False)]
    looked, own = [], encoder._numbers_of
    monkeypatch.setattr(encoder, "_numbers_of", lambda x: looked.append(list(x)) or own(x))
    assert encoder.counted(["one two one two " * 500 + "one"]).tolist() == [len(library.encode("one two one two " * 500 + "one", add_special_tokens=False).ids)]
    assert [sorted(x) for x in looked] == [[" one", " two", "one"]]


def test_counting_encodes_a_word_once_whatever_mark_follows(library):
    encoder = token_files.library.__wrapped__(PATH)[0]
    asked, own = [], encoder.encode_new
    encoder.encode_new = lambda x: asked.extend(x) or own(x)
    text = "so word, word. word; word: word! word? word), word"
    assert encoder.counted([text]).tolist() == [len(library.encode(text, add_special_tokens=False).ids)]
    assert asked.count(" word") == 1 and sorted(x for x in asked if "word" in x) == [" word", " word),"]


def test_counting_looks_up_known_pieces_in_arrow(library, monkeypatch):
    encoder = token_files.library.__wrapped__(PATH)[0]
    expected = [len(library.encode(x, add_special_tokens=False).ids) for x in ("one two, three", "two one four")]
    asked, own = [], encoder._numbers_of
    monkeypatch.setattr(encoder, "_numbers_of", lambda x: asked.extend(x) or own(x))
    for _ in range(3):
        assert encoder.counted(["one two, three"]).tolist() == expected[:1]
    assert sorted(asked) == [" three", " two", "one"]
    assert encoder.counted(["two one four"]).tolist() == expected[1:] and sorted(asked[3:]) == [" four", " one", "two"]


def test_counting_encodes_a_word_once_whatever_line_ends_before_it(library):
    encoder = token_files.library.__wrapped__(PATH)[0]
    asked, own = [], encoder.encode_new
    encoder.encode_new = lambda x: asked.extend(x) or own(x)
    text = "a line.\nword and\nword or, it is.\nword\n"
    assert encoder.counted([text]).tolist() == [len(library.encode(text, add_special_tokens=False).ids)]
    assert [x for x in asked if "word" in x] == ["\nword", "\nword\n"]


def test_line_starts_are_encoded_in_a_row(library):
    encoder = token_files.library.__wrapped__(PATH)[0]
    own = ["\nWord", " word", "\n\u00e9t\u00e9.", "\nb\nc", "\n", " d\ne", "\n\nf", "\n\u6f22", "g", "\n<", ""]
    names, ids, sizes = encoder.encode_new(own)
    assert sorted(names) == sorted(own)
    ends = np.cumsum(sizes).tolist()
    for name, a, b in zip(names, [0, *ends], ends, strict=False):
        assert ids[a:b].tolist() == library.encode(name, add_special_tokens=False).ids


def test_counting_cuts_at_white_space_as_the_library_does(library):
    encoder = token_files.library.__wrapped__(PATH)[0]
    random.seed(11)
    parts = [" ", " ", "  ", "\n", "\n", "\n\n", "\n\n\n", " \n", "\n ", "\t", "\r\n", "\x0b", "\x1c", "\u00a0", "\u2028", "\x00", "word", "Word", "it's", "a1", ".", "?!", "\u00e9", "\u6f22", "<|endoftext|>"]
    rows = ["".join(random.choices(parts, k=random.randint(0, 14))) for _ in range(6000)]
    rows += ["".join(random.choices(parts, k=300)) for _ in range(40)]
    assert encoder.counted(rows).tolist() == [len(x.ids) for x in library.encode_batch(rows, add_special_tokens=False)]


def test_counting_keeps_few_bytes_of_long_pieces(library, monkeypatch):
    monkeypatch.setattr(pieces, "GENERATION_BYTES", 2000, raising=False)
    encoder = token_files.library.__wrapped__(PATH)[0]
    for i in range(20):
        text = f"{i}" + "\u6f22\u5b57" * 100 + f" word{i}"
        assert encoder.counted([text]).tolist() == [len(library.encode(text, add_special_tokens=False).ids)]
        assert sum(len(str(x)) for x in encoder.numbers) < 2000
