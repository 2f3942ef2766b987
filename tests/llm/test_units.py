"""Parts of the operators that need no Spark: coders, trees, tables, plans."""

import itertools
import random
import struct

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridspark.llm import bloom_lm, decontamination, encoding, gif_media, langid, packing, simhash, simple8b, toxicity, url_rules

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = ["ab", "Stress", "é", "12", " ", "  ", "\n", "\t", "'s", "-", "<|endoftext|>", "<|startoftext|>", "́", " ", "İ", "\U0001f600", ",", "ſ", "\x1c", "Σ"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_chunked_ids_equal_the_library(text):
    assert encoding.ByteLevelCounter(BYTES)(text) == len(encoding.tokenizer(BYTES).encode(text, add_special_tokens=False).ids)
    assert np.frombuffer(encoding.WordIds(WORDS)(text), "<u4").tolist() == encoding.tokenizer(WORDS).encode(text, add_special_tokens=False).ids


def test_chunk_cache_keeps_two_generations():
    cache = encoding.ChunkCache(str.upper, most=2)
    assert [cache[c] for c in "abc"] == ["A", "B", "C"]
    cache.trim()
    assert not cache and cache["a"] == "A" and len(cache) == 1


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 49407), st.integers(0, (1 << 64) - 1)), max_size=400))
def test_simple8b_round_trip(ids):
    a = np.array(ids, np.uint64)
    words, offsets = simple8b.encode(a)
    assert simple8b.decode(words, offsets, len(a)).tolist() == ids


def test_simple8b_blocks_stand_alone():
    ids = np.random.default_rng(3).integers(0, 49408, 3 * simple8b.BLOCK + 17).astype(np.uint64)
    words, offsets = simple8b.encode(ids)
    for k in range(4):
        own = words[int(offsets[k]) : int(offsets[k + 1])]
        part = ids[k * simple8b.BLOCK : (k + 1) * simple8b.BLOCK]
        assert (simple8b.decode(own, np.array([0, len(own)]), len(part)) == part).all()
    image = simple8b.file_image([1, 5], [b"\1\0\0\0", b""])
    doc_ids, counts, got = simple8b.read_image(image)
    assert doc_ids.tolist() == [1, 5] and counts.tolist() == [1, 0] and got.tolist() == [1]
    with pytest.raises(ValueError):
        simple8b.read_image(b"x" * 64)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=3000), min_size=1, max_size=5))
def test_gif_round_trip(texts):
    payloads = [gif_media.pad(t) for t in texts]
    images = gif_media.encode(payloads)
    for payload, image, shown in zip(payloads, images, gif_media.decode(images)):
        got, histogram, frames, last = gif_media.read_samples(shown, len(payload))
        assert got == payload and histogram.sum() == len(payload) and last == 40 * frames
        assert frames == -(-len(payload) // 1024) and image[:6] == b"GIF89a"


def test_gif_table_that_fills_up():
    noise = random.Random(5).randbytes(40_000)
    codes = gif_media.lzw_codes([noise])
    assert (codes[0] == 256).sum() > 1
    assert gif_media.lzw_decode(gif_media.lzw_pack(codes), 8, [len(noise)]) == [noise]


def _plain_lzw(codes, size):
    """A decoder by the book, with a table."""
    clear, out, table, prev = 1 << size, b"", None, b""
    for c in codes:
        if c == clear:
            table, prev = [bytes([i]) for i in range(clear)] + [b"", b""], b""
        elif c == clear + 1:
            break
        else:
            entry = table[c] if c < len(table) else prev + prev[:1]
            if prev and len(table) < 4096:
                table.append(prev + entry[:1])
            out, prev = out + entry, entry
    return out


def test_lzw_codes_against_a_table_decoder():
    rng = random.Random(9)
    lanes = [bytes(rng.choice(b"abac \0") for _ in range(n)) for n in (1, 2, 64, 700, 5000)] + [b"a" * 3000]
    for lane, codes in zip(lanes, gif_media.lzw_codes(lanes)):
        assert _plain_lzw(codes.tolist(), 8) == lane


def _gif(frames, width=2, height=2, colours=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255))):
    """A GIF of 2-bit samples, never longer than four codes between clear codes."""
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x81, 0, 0), bytes(x for c in colours for x in c)]
    for samples, (left, top, w, h), disposal, transparent, delay, interlaced in frames:
        bits = "".join(f"{c:03b}"[::-1] for s in [samples[i : i + 2] for i in range(0, len(samples), 2)] for c in (4, *s)) + "101"
        data = int(bits[::-1], 2).to_bytes(-(-len(bits) // 8), "little")
        out += [b"\x21\xf9\x04", struct.pack("<BHB", disposal << 2 | (transparent is not None), delay, transparent or 0), b"\0\x2c", struct.pack("<HHHHB", left, top, w, h, 0x40 if interlaced else 0), b"\2", bytes([len(data)]), data, b"\0"]
    return b"".join([*out, b"\x3b"])


def test_gif_transparency_disposal_timing_and_interlacing():
    full, dot = (0, 0, 2, 2), (1, 1, 1, 1)
    image = _gif([([1, 1, 1, 1], full, 1, None, 10, False), ([2], dot, 2, None, 5, False), ([3, 0, 0, 3], full, 3, 0, 7, False), ([2], (0, 0, 1, 1), 0, None, 0, False)])
    shown = [f["rgba"].tolist() for f in next(gif_media.decode([image]))]
    red, green, blue, none = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert shown == [[[red, red], [red, red]], [[red, red], [red, green]], [[blue, red], [red, blue]], [[green, red], [red, none]]]
    assert [f["start_ms"] for f in next(gif_media.decode([image]))] == [0, 100, 150, 220]
    lines = _gif([([1, 2, 3, 0, 1, 2, 3, 0], (0, 0, 1, 8), 1, None, 1, True)], 1, 8)
    order = [0, 4, 2, 6, 1, 3, 5, 7]
    canvas = next(next(gif_media.decode([lines])))["rgba"][:, 0].tolist()
    assert [canvas[r] for r in order] == [[*c, 255] for c in [(255, 0, 0), (0, 255, 0), (0, 0, 255), (0, 0, 0)] * 2]


def test_bk_tree_follows_only_what_is_near():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 30, np.uint64)
    near = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << np.uint64(k)) for k in range(0, 64, 5))]))
    tree = simhash.BKTree(near)
    for node, children in enumerate(tree.children):
        assert all(int(near[node] ^ near[c]).bit_count() == k for k, c in children.items())
    a, b = tree.search(near, 2)
    want = {(i, j) for i, j in itertools.product(range(len(near)), repeat=2) if int(near[i] ^ near[j]).bit_count() <= 2}
    assert set(zip(a.tolist(), b.tolist())) == want


@pytest.mark.parametrize("text", ["", "   ", "one", "One two", "a b c", "a b c a b c a b c d"])
def test_fingerprint_by_definition(text):
    import xxhash

    words = text.lower().split()
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_configurations_use_up_all_counts():
    rng = random.Random(4)
    for _ in range(30):
        sizes = sorted(rng.sample(range(257, 2049), 20))
        counts = [rng.randrange(1, 40) for _ in sizes]
        plan = packing.configurations(sizes, counts, 2048)
        used = [0] * len(sizes)
        for times, own in plan:
            assert sum(sizes[g] * k for g, k in own.items()) <= 2048
            for g, k in own.items():
                used[g] += times * k
        assert used == counts


@pytest.mark.parametrize("law", ["uniform", "short", "long", "two sizes", "thirds"])
def test_never_more_sequences_than_best_fit_decreasing(law):
    rng = np.random.default_rng(7)
    n = 20_000
    lengths = {"uniform": rng.integers(1, 2049, n), "short": np.minimum(2048, 1 + rng.geometric(0.004, n)), "long": 2048 - np.minimum(2040, rng.geometric(0.003, n)), "two sizes": rng.choice([700, 1100], n), "thirds": rng.integers(600, 800, n)}[law]
    values, counts = np.unique(lengths, return_counts=True)
    histogram = list(zip(values.tolist(), counts.tolist()))
    rooms, best_fit = [0] * 2049, 0  # rooms[r]: sequences with room r
    for x in sorted(lengths.tolist(), reverse=True):
        r = next((r for r in range(x, 2049) if rooms[r]), None)
        if r is None:
            best_fit, r = best_fit + 1, 2048
        else:
            rooms[r] -= 1
        rooms[r - x] += 1
    border, rows, sequences, total = packing.plan(histogram, 2048, packing.GROUPS)
    assert -(-int(lengths.sum()) // 2048) <= total <= best_fit
    for groups in (packing.GROUPS, None):  # rooms as they are counted, piece by piece
        large = [h for h in histogram if h[0] > 256]
        rows, sequences, counted = packing.plan_large(large, 2048, groups)
        own = np.repeat([x for x, _ in large], [k for _, k in large])
        at = np.searchsorted(rows[:, 0], np.arange(len(own)), "right") - 1
        left = 2048 - np.bincount(rows[at, 2] + (np.arange(len(own)) - rows[at, 0]) // rows[at, 1], own, sequences).astype(int)
        assert dict(zip(*(x.tolist() for x in np.unique(left, return_counts=True)))) == counted and left.min() >= 0


def test_small_plan_places_every_piece_once():
    rows, new = packing.plan_small([(1, 50), (100, 30), (200, 40)], [(0, 3), (150, 4), (1000, 2)], 2048)
    assert sorted(rows[:, 0].tolist())[0] == 0 and new >= 0
    assert packing.plan_small([(256, 9)], [], 2048)[1] == 2


def test_edit_distance_inside_a_text():
    a = np.array([1, 2, 3, 4], np.uint64)
    assert decontamination.edit_distance(a, np.array([9, 9, 1, 2, 3, 4, 9], np.uint64))[0] == 0
    assert decontamination.edit_distance(a, np.array([9, 1, 3, 4], np.uint64))[0] == 1
    assert decontamination.edit_distance(a, np.zeros(0, np.uint64))[0] == 4


def test_recall_of_edited_passages():
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(3000)]
    items = [(k, [rng.choice(vocabulary).encode() for _ in range(rng.randrange(12, 60))]) for k in range(200)]
    index = decontamination.ItemIndex(12, items)
    texts, want = [], set()
    for k, words in items:
        own = list(words)
        for _ in range(len(own) // 8):  # within a fifth of the words
            at = rng.randrange(len(own))
            own[at : at + 1] = rng.choice([[], [b"new"], [own[at], b"more"]])
        texts.append([rng.choice(vocabulary).encode() for _ in range(50)] + own + [b"end"] * 20)
        want.add((len(texts) - 1, k))
    word, begins, sizes = decontamination._hashes(texts, 26)
    found = set(decontamination.verify(index, word, begins, sizes, *index.candidates(word, np.flatnonzero(word)), 0.8))
    assert len(found & want) >= 0.97 * len(want) and len(found - want) == 0


def test_language_features_stay_inside_texts():
    alone = [langid._points([t]) for t in ("ab c", "", "ÉÀ 12 é")]
    cp, starts = langid._points(["ab c", "", "ÉÀ 12 é"])
    assert cp.tolist() == [x for a, _ in alone for x in a.tolist()]
    together = [np.split(h, begin[1:-1]) for h, begin in langid._grams(cp, starts)]
    for k, (own, first) in enumerate(alone):
        for n, (h, _) in enumerate(langid._grams(own, first)):
            assert together[n][k].tolist() == h.tolist()


def test_filter_returns_quantised_counts():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, np.uint64) >> np.uint64(6))
    counts = rng.geometric(0.05, len(keys))
    part = bloom_lm.filter_part(keys, counts)
    held = bloom_lm.LogFrequencyFilter({(1, 0): len(part)}, 64)
    held.put(1, 0, part)
    levels = held.levels(keys, 1)
    assert (levels >= bloom_lm.levels_of(counts)).all() and (levels == bloom_lm.levels_of(counts)).mean() > 0.97
    other = keys ^ np.uint64(1 << 40)
    assert (held.levels(other, 1) > 0).mean() < 0.03 and (held.levels(keys, 2) == 0).all()
    for k in (keys, keys & np.uint64(0xFFFFFFFFFFFF0000), keys[:1]):
        k = np.unique(k)
        assert (bloom_lm.unpacked(bloom_lm.packed(k)) == k).all()
    many = np.array([1, 254, 255, 256, 1 << 40])
    assert (bloom_lm.unpacked_counts(bloom_lm.packed_counts(many), 5) == many).all()


def test_url_rules_longest_wins_and_collisions(monkeypatch):
    rules = {"org/": "allow", "example.org/es/": "block", "com/fr/": "allow"}
    array = url_rules.DigestArray(rules)
    hosts, paths = zip(*map(url_rules.split_url, ["http://A.example.ORG/es/x?q", "https://example.org", "http://b.org/z", None, "x.org/", "http://notcom/fr/", "http://x.com/fr/#f"]))
    said = [array.rules[k] if k >= 0 else None for k in array.probe(array.mapped(), list(hosts), list(paths))]
    assert said == ["example.org/es/", None, "org/", None, None, None, "com/fr/"]
    monkeypatch.setattr(url_rules, "_key", lambda text: 7)  # every key collides: the strings still decide
    same = url_rules.DigestArray(rules)
    assert [same.rules[k] if k >= 0 else None for k in same.probe(same.mapped(), list(hosts), list(paths))] == said


def test_network_gradients():
    net = toxicity.Network(3)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    rng = np.random.default_rng(0)
    x = rng.standard_normal((5, toxicity.INPUT))
    rows = rng.integers(0, 5, (3, toxicity.WINDOW))
    rows[0, 20:] = -1
    target = np.array([1.0, 0.0, 1.0])

    def loss():
        p = 1 / (1 + np.exp(-net.forward(net.products(x).astype(np.float64), rows).astype(np.float64)))
        return -np.mean(target * np.log(p) + (1 - target) * np.log(1 - p))

    got, _ = net.gradients(x, rows, target)
    for k in ("o", "a", "v", "u", "w", "b"):
        at = tuple(s // 2 for s in net.p[k].shape)
        before, step = net.p[k][at], 1e-2
        net.p[k][at] = before + step
        high = loss()
        net.p[k][at] = before - step
        low = loss()
        net.p[k][at] = before
        assert abs((high - low) / (2 * step) - got[k][at]) < 2e-3


@pytest.mark.parametrize("n", range(1, 61))
def test_recall_at_every_length(n):
    """With as many edits as 0.8 allows, at any words, and whatever follows: all short items, 0.95 of the others."""
    rng = np.random.default_rng(n)
    new = lambda k: [b"w%d" % x for x in rng.integers(0, 1 << 40, k)]
    items = [(k, new(n)) for k in range(300)]
    texts = []
    for _, item in items:
        leak = list(item)
        for _ in range(int(0.2 * n + 1e-9)):
            at, kind = int(rng.integers(0, len(leak))), int(rng.integers(0, 3))
            leak[at : at + (kind != 1)] = new(1) if kind < 2 else []
        texts.append(new(7) + leak + new(9))
    index = decontamination.PieceIndex(items, 0.8) if n < decontamination.SHORT else decontamination.ItemIndex(decontamination.SIZE, items)
    word, begins, sizes = decontamination._hashes(texts, 26)
    found = decontamination.verify(index, word, begins, sizes, *index.candidates(word, np.flatnonzero(word)), 0.8)
    right = {(k, k) for k in range(len(items))}
    assert set(found) <= right and len(found) >= (len(items) if n < decontamination.SHORT else 0.95 * len(items)), len(found)


def test_words_of_unspaced_scripts():
    assert decontamination.words_of("\u6771\u4eac Ab\u00e9") == ["\u6771".encode(), "\u4eac".encode(), "ab\u00e9".encode()]


def _never_cleared(data):
    """An LZW stream of 8-bit samples with a clear code at its begin only."""
    table, free, codes, prefix = {bytes([i]): i for i in range(256)}, 258, [256], b""
    for c in data:
        longer = prefix + bytes([c])
        if longer not in table:
            codes.append(table[prefix])
            if free < 4096:
                table[longer] = free
                free += 1
            longer = bytes([c])
        prefix = longer
    codes += [table[prefix], 257]
    held, bits, out = 0, 0, bytearray()
    for k, c in enumerate(codes):
        held |= c << bits
        bits += 9 if k == 0 else max(9, min(12, (256 + k).bit_length()))
        while bits >= 8:
            out.append(held & 255)
            held, bits = held >> 8, bits - 8
    return bytes(out) + bytes([held & 255]), len(codes)


@pytest.mark.parametrize("letters", [bytes(range(256)), b"abc "])
def test_gif_stream_that_is_never_cleared(letters):
    data = bytes(random.Random(6).choices(letters, k=400_000))
    stream, codes = _never_cleared(data)
    assert codes > 70_000
    assert gif_media.lzw_decode([stream, stream], 8, [len(data), 70_000]) == [data, data[:70_000]]


def test_gif_files_that_are_cut_off():
    payload = gif_media.pad(random.Random(7).randbytes(3000))
    image = gif_media.encode([payload])[0]
    for n in range(13, len(image), 37):
        for f in next(gif_media.decode([image[:n]])):
            left, top, w, h = f["box"]
            got = np.ascontiguousarray(f["rgba"][top : top + h, left : left + w, 0]).tobytes()
            assert len(got) == w * h
    assert [f["start_ms"] for f in next(gif_media.decode([image[: len(image) - 400]]))] == [0, 40, 80]
    with pytest.raises(ValueError):
        gif_media.parse(b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0))


def test_gif_lanes_are_bounded(monkeypatch):
    seen = []
    real = gif_media._lane_codes
    monkeypatch.setattr(gif_media, "_lane_codes", lambda lanes: seen.append((len(lanes), len(lanes[0]))) or real(lanes))
    payloads = [gif_media.pad(b"short")] * 9999 + [gif_media.pad(b"long text " * 3000)]
    images = gif_media.encode(payloads)
    assert all(n <= gif_media.LANES and n << gif_media._table_bits(longest) <= gif_media.ENTRIES for n, longest in seen)
    assert [gif_media.read_samples(s, len(p))[0] == p for p, s in zip(payloads, gif_media.decode(images))] == [True] * 10_000
