"""The helpers inside tasks against plain restatements."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vetrina.llm import packing, pii, substring_dedup, suffix_dedup, toxicity, warc
from vetrina.llm.bpe import word_bpe
from vetrina.llm.windows import _runs as runs_of
from vetrina.llm.windows import sliding_min, span_runs

WORDS = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_order(symbols):
    s = np.array(symbols + [0], np.uint8)
    data = s.tobytes()
    assert suffix_dedup.suffix_order(s, 100).tolist() == sorted(range(len(s)), key=lambda i: data[i:])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.booleans()), max_size=60))
def test_suffix_order_of_some(symbols):
    s = np.array([c for c, _ in symbols] + [0], np.uint8)
    wanted = np.array([w for _, w in symbols] + [False])
    data = s.tobytes()
    order = suffix_dedup.suffix_order(s, 100, wanted)
    assert order[wanted[order]].tolist() == sorted(np.flatnonzero(wanted).tolist(), key=lambda i: data[i:])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\x0b\x1c\x00é", max_size=30), max_size=4))
def test_word_hashes_tell_words_apart(texts):
    hash_of: dict[bytes, int] = {}
    for text in texts:
        found, hashes = substring_dedup.words(text), substring_dedup.text_hashes(text)
        assert len(found) == len(hashes)
        assert all(hash_of.setdefault(w, h) == h for w, h in zip(found, hashes.tolist()))
    assert len(set(hash_of.values())) == len(hash_of)


def test_runs_of_masks():
    masks = [np.random.default_rng(n).random(n) < 0.5 for n in (3, 1, 9, 0, 4)]
    pairs, each = runs_of(masks)
    assert each.sum() == len(pairs)
    for mask, own in zip(masks, np.split(pairs, np.cumsum(each)[:-1])):
        assert sorted(i for a, b in own.tolist() for i in range(a, b)) == np.flatnonzero(mask).tolist()
    column = pa.array([None, [{"start": 3, "runs": np.array([0, 2, 5, 6], np.int32).tobytes()}, {"start": 9, "runs": np.array([1, 2], np.int32).tobytes()}], []],
                      pa.list_(pa.struct([("start", pa.int32()), ("runs", pa.binary())])))
    assert [r.tolist() for r in span_runs(column)] == [[], [[3, 5], [8, 9], [10, 11]], []]
    assert [r.tolist() for r in span_runs(column.slice(1, 1))] == [[[3, 5], [8, 9], [10, 11]]]


def test_common_prefixes():
    rng = np.random.default_rng(1)
    s = np.append(rng.integers(1, 3, 300).astype(np.uint8), 0).astype(np.uint8)
    order = suffix_dedup.suffix_order(s, 400)
    data, got = s.tobytes(), suffix_dedup.common_prefixes(s, order, 24)
    for k, (i, j) in enumerate(zip(order, order[1:], strict=False)):
        n = 0
        while n < 24 and max(i, j) + n < len(data) and data[i + n] == data[j + n]:
            n += 1
        assert got[k] == n


def test_sliding_min():
    key = np.random.default_rng(2).integers(0, 50, 101).astype(np.uint64)
    for w in (1, 2, 7, 101):
        assert sliding_min(key, w).tolist() == [min(key[i : i + w]) for i in range(len(key) - w + 1)]


def _library():
    t = Tokenizer.from_file(WORDS)
    t.no_truncation()
    t.no_padding()
    return t


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_bpe_any_text(text):
    t, own = _LIB, word_bpe(WORDS)
    ids = t.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids and own.decode(ids) == t.decode(ids, skip_special_tokens=False)


_LIB = _library()


def test_bpe_runs_and_specials():
    own = word_bpe(WORDS)
    random.seed(3)
    cases = ["a" * n for n in range(1, 80)] + ["!" * n for n in range(1, 60)] + ["ab" * 5000, "", " \t\n", "x<|endoftext|>y <|startoftext|>", "I'LL don't İ Σ ﬁ é"]
    cases += ["".join(random.choice("aabeinorst") for _ in range(random.randint(1, 40))) for _ in range(2000)]
    for c in cases:
        assert own.encode(c) == _LIB.encode(c, add_special_tokens=False).ids, c


def test_byte_encoder_is_the_librarys():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    encode = packing._byte_encoder(path, public_tokenizers.PATTERN)
    for text in ("", "a b", "x<|endoftext|>y", "  \n\n  z ", "Größe – ñandú 東京 \U0001f600", "don't  stop" * 50, " " * 3000):
        assert encode(text).tolist() == t.encode(text, add_special_tokens=False).ids


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_configurations_hold_every_piece(histogram):
    plan = packing.configurations(histogram, 64, steps=60)
    held: dict[int, int] = {}
    for uses, n in plan:
        assert sum(s * t for s, t in uses) <= 64 and n > 0
        for s, t in uses:
            held[s] = held.get(s, 0) + t * n
    assert held == histogram
    total = sum(s * n for s, n in histogram.items())
    assert sum(n for _, n in plan) <= max(1, 2 * total // 64 + 1)


def _fewest(pieces: list[int], capacity: int) -> int:
    """Fewest sequences, by search over all subsets."""
    best = {0: (0, 0)}  # pieces placed -> (sequences opened, room in the last)
    for mask in range(1 << len(pieces)):
        for i, size in enumerate(pieces):
            if mask in best and not mask >> i & 1:
                n, room = best[mask]
                to = (n, room - size) if size <= room else (n + 1, capacity - size)
                key = mask | 1 << i
                if key not in best or (to[0], -to[1]) < (best[key][0], -best[key][1]):
                    best[key] = to
    return best[(1 << len(pieces)) - 1][0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 11), min_size=1, max_size=9))
def test_configurations_against_the_optimum(pieces):
    plan = packing.configurations({s: pieces.count(s) for s in pieces}, 12)
    assert _fewest(pieces, 12) <= sum(n for _, n in plan) <= _fewest(pieces, 12) + 1


def test_configurations_near_the_bound():
    draw = np.random.default_rng(5).lognormal(4.2, 0.8, 20_000).astype(int) % 255 + 1
    histogram = {int(s): int(n) for s, n in zip(*np.unique(draw, return_counts=True))}
    assert sum(n for _, n in packing.configurations(histogram, 256)) <= 1.001 * draw.sum() / 256 + 1


def test_best_configuration_is_a_best_knapsack():
    sizes, price = np.array([3, 5, 7]), np.array([3.1, 5.6, 7.5])
    use = packing.best_configuration(sizes, price, 17)
    best = max(a * 3.1 + b * 5.6 + c * 7.5 for a in range(6) for b in range(4) for c in range(3) if 3 * a + 5 * b + 7 * c <= 17)
    assert sum(price[k] * n for k, n in use.items()) == pytest.approx(best)


def test_warc_bundle_random_access():
    out = warc.BundleWriter(frame_bytes=500)
    bodies = [bytes([65 + i]) * (i * 37) + b"\r\n\r\nWARC/1.1\r\n" for i in range(40)]
    for i, body in enumerate(bodies):
        rid = warc.record_id(i, 0)
        out.add(rid, warc.write_record(rid, i, f"http://x/ {i}", body, "0" * 40, None))
    reader = warc.BundleReader(out.finish())
    assert len(reader.frames) > 5
    assert [b for _, b in reader.records()] == bodies
    for i, (rid, frame, offset) in reversed(list(enumerate(out.index))):
        head, body = reader.record(frame, offset)
        assert head["WARC-Record-ID"] == rid and body == bodies[i] and head["WARC-Target-URI"] == f"http://x/%20{i}"
    damaged = bytearray(out.finish())
    damaged[-1] ^= 1
    with pytest.raises(ValueError):
        warc.BundleReader(bytes(damaged))


def test_surrogates_keep_type_and_format():
    text = ("Frau Anna Schmidt and Herr SCHMIDT, a.b9@mail.example.org A.B9@MAIL.example.org, card 4111 1111 1111 1111 or 4111-1111-1111-1111, "
            "ip 192.168.10.7 and 8.8.8.8, DE89 3704 0044 0532 0130 00, 123-45-6789, +1 (017) 555-7713, token 9233A8ECF7C5B09FE5949719B6B82BC439E9329B, plain 12345678")
    found = pii.detect(text)
    kinds = [k.split("-")[0] for _, _, k, _ in found]
    assert kinds == ["given", "family", "family", "email", "email", "card", "card", "ip", "ip", "iban", "ssn", "phone", "secret"]
    new = {}
    for a, b, kind, value in found:
        s = pii.surrogate(b"k", kind, value, 0)
        shown = pii.dress(kind, s, text[a:b])
        assert s != value and new.setdefault((kind, value), s) == s
        if kind == "card":
            assert pii._luhn(s) == 0 and [c for c in shown if not c.isdigit()] == [c for c in text[a:b] if not c.isdigit()]
        if kind == "iban":
            assert shown[:2] == "DE" and pii._iban_rest(s) == 1
    assert new["ip", "192.168.10.7"].startswith("192.168.")
    assert pii.surrogate(b"k", "given-f-latin", "anna", 0).capitalize() in pii.GIVEN["latin", "f"]
    assert pii.surrogate(b"other", "card", "4111111111111111", 0) != new["card", "4111111111111111"]


@pytest.mark.parametrize("text, names", [
    ("Dr. J. Smith came. Smith's aunt and SMITH, a blacksmith.", ["J.", "Smith", "Smith", "SMITH"]),
    ("Herr Ludwig van Beethoven, Frau von der Leyen", ["Ludwig", "Beethoven", "Leyen"]),
    ("Señor Juan Carlos Maria Lopez Garcia", ["Juan", "Carlos", "Maria", "Lopez", "Garcia"]),
    ("Garcia, Mr.  John\nGarcia", ["Garcia", "John", "Garcia"]),
    ("Herr Dr. Meier, Mr O'Brien, Sir I know, Dr. Poe\n\nThe end", ["Meier", "O'Brien", "Poe"]),
    ("Mr" + " Ab" * 1000, ["Ab"] * 1000)])
def test_persons_are_found_whole(text, names):
    found = pii.detect(text)
    assert [text[a:b] for a, b, *_ in found] == names
    by_name = {value: kind for *_, kind, value in found}
    assert "smith" not in by_name or by_name["smith"] == "family-latin" and by_name["j."] == "initial-latin"
    letters = [pii.surrogate(b"k", "initial-latin", c, 0) for c in "abcdefghijklmnopqrstuvwxyz"]
    assert sorted(letters) == list("abcdefghijklmnopqrstuvwxyz") and all(a != b for a, b in zip(letters, sorted(letters)))


def test_noisy_or_points_at_sentences():
    rng = random.Random(4)
    bags = []
    for i in range(400):  # feature 0 makes toxic, feature 1 is noise
        toxic = i % 4 == 0
        others = [[1]] * rng.randint(0, 3)
        bags.append((int(toxic), rng.randint(0, 20), others + ([[0]] if toxic else [])))
    w, bias, leak = toxicity.fit(bags, 2)
    assert toxicity._sigmoid(bias + w[0]) > 0.9 > 0.1 > toxicity._sigmoid(bias + w[1]) and toxicity._sigmoid(leak) < 0.1


def test_crc_is_unsigned_little_endian():
    assert zlib.crc32(np.array([1, 2], "<u4").tobytes()) == zlib.crc32(bytes([1, 0, 0, 0, 2, 0, 0, 0]))
