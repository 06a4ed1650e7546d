"""The operators against brute force and by hand, without tables."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from loomgraph.llm import bpe, langid, licenses, linefirst, media, neardup, quality, toxicity


# toxicity


def brute_segments(scores):
    """All maximal segments by their definition, recursively: the best one, then those left and right of it."""
    def best(a, b):
        top = None
        for i in range(a, b):
            s = 0.0
            for j in range(i, b):
                s += scores[j]
                if s > 1e-12 and (top is None or s > top[0] + 1e-12):
                    top = (s, i, j + 1)
        return [] if top is None else [*best(a, top[1]), (top[1], top[2], top[0]), *best(top[2], b)]
    return best(0, len(scores))


@pytest.mark.parametrize("seed", range(60))
def test_segments(seed):
    rng = random.Random(seed)
    scores = [rng.choice((-1.25, -0.5, 0.75, 2.0, -3.0)) + rng.random() * 1e-3 for _ in range(rng.randint(0, 14))]
    got = toxicity.segments(scores)
    want = brute_segments(scores)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


def test_runs_of_drift_words_change_nothing():
    m = toxicity.Model({"bad": 3.0, "vile": 2.0}, lam=1.0, k=0.01)
    words = "a bad b c vile d e f g bad bad h".split()
    n, got = m.scan(" ".join(words))
    want = toxicity.segments([m.weights.get(w, toxicity.DRIFT) for w in words])
    assert n == len(words) and [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert m.predict([None, "", "good"])["evidence"] == [0.0, 0.0, 0.0]


def test_significance():
    class R(dict):
        pass

    rows = [R(unit="x", a=12, b=0), R(unit="y", a=3, b=2), R(unit="z", a=3, b=0)]
    assert [r["unit"] for r in toxicity.significant(rows, 1000, 0.1)] == ["x"]
    assert toxicity.significant([], 0, 0.1) == []


def test_units_of_many_documents_are_tested_like_others():
    """The tail in logarithms, against exact sums, on both sides of any size, and of what chance explains."""
    from fractions import Fraction
    from math import comb, exp

    for a, n, p in ((5, 10, 0.1), (60, 399, 0.1), (60, 400, 0.1), (61, 401, 0.1), (30, 1000, 0.01), (1, 3, 0.2)):
        q = Fraction(p).limit_denominator(1000)
        want = float(sum(comb(n, k) * q**k * (1 - q) ** (n - k) for k in range(a, n + 1)))
        assert exp(toxicity.log_tail(a, n, p)) == pytest.approx(want, rel=1e-9)
    assert toxicity.log_tail(60, 400, 0.15) == 0.0 == toxicity.log_tail(0, 5, 0.1) and toxicity.log_tail(900, 1000, 0.001) < -4000
    row = lambda unit, a, b: {"unit": unit, "a": a, "b": b}
    assert toxicity.significant([row("x", 60, 340), row("y", 60, 339), row("z", 500, 10)], 1000, 0.15) == [row("z", 500, 10)]


def test_extreme_values_of_clean_text():
    """Over words drawn as lambda and K assume, a text has a significant passage in few cases, however long it is."""
    import math

    rng = random.Random(21)
    weights, p = {"bad": 3.0, "vile": 2.2, "foul": 1.8}, {"bad": 0.001, "vile": 0.002, "foul": 0.004}
    rise = lambda lam: (1 - sum(p.values())) * math.exp(lam * toxicity.DRIFT) + sum(q * math.exp(lam * weights[w]) for w, q in p.items()) - 1
    low, high = 1e-6, 5.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if rise(mid) < 0 else (low, mid)
    m = toxicity.Model(weights, lam=low, k=1.0)
    pool, odds = [*p, "word"], [*p.values(), 1 - sum(p.values())]
    least = min(weights.values())
    tops = [(n, s) for n in (300, 2000) for _ in range(250) for *_, s in m.scan(" ".join(rng.choices(pool, odds, k=n)))[1]]
    m.k = sum(s >= least for _, s in tops) / (250 * 2300 * math.exp(-low * least))
    for n in (300, 2000):
        hits = sum(bool(m.passages(" ".join(rng.choices(pool, odds, k=n)))[0]) for _ in range(400))
        assert hits / 400 < 2.5 * toxicity.E_VALUE
    assert m.passages("word " * 50 + "bad vile bad foul bad " * 3)[0]


# quality


def test_trees_learn_and_traverse_like_a_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    t = quality.fit(x, y, 40)
    assert ((t.score(x) > 0.5) == y).mean() > 0.95
    for row in x[:20]:
        z = t.base
        for f, th, leaf in zip(t.feature, t.threshold, t.leaf):
            i = 0
            while i < len(f):
                i = 2 * i + 1 + int(row[f[i]] > th[i])
            z += leaf[i - len(f)]
        assert t.raw(row[None])[0] == pytest.approx(z)


def test_quality_of_nothing():
    assert len(quality.statistics(None)) == len(quality.FEATURES) == len(quality.statistics("x " * 100_000))
    assert quality.fit(np.zeros((0, 20)), np.zeros(0)).score(np.zeros((1, 20)))[0] == pytest.approx(0.5)
    assert quality.fit(np.zeros((3, 20)), np.ones(3)).score(np.zeros((1, 20)))[0] > 0.9


# language


def test_automaton_gives_longest_matches():
    m = langid.Model({"a": "abracadabra", "b": "hocus pocus"})

    def brute(sample, text):
        n = i = 0
        while i < len(text):
            j = i
            while j < len(text) and text[i : j + 1] in sample:
                j += 1
            i, n = max(j, i + 1), n + 1
        return n

    texts = ["abra", "cadabra hocus", "us", "xyz", "ab zz ra", "hocus pocus abracadabra"]
    want = [[brute("abracadabra", t), brute("hocus pocus", t)] for t in texts]
    assert m.phrases(texts).tolist() == want
    got = m.predict([None, "", "123 !", "Abra!", "hocus"])
    assert got["lang_pred"] == ["und", "und", "und", "a", "b"] and got["score"][:3] == [0.0] * 3
    assert langid.Model({}).predict(["abc"])["lang_pred"] == ["und"]


def test_long_text_is_parsed_whole():
    m = langid.Model({"a": "ab" * 50, "b": "cd" * 50})
    assert m.predict(["ab" * 10 + "cd" * 40_000])["lang_pred"] == ["b"]


@pytest.mark.parametrize("dense_bytes", [0, langid.DENSE_BYTES])
def test_parse_goes_on_over_segment_borders(dense_bytes):
    """Texts of several segments against one greedy parse, also where parses from different places never meet."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 7)))
    samples = {"a": " ".join(word() for _ in range(300)), "b": "abc" * 40 + "aaa"}
    m = langid.Model(samples, dense_bytes)

    def brute(sample, text):
        n = i = 0
        while i < len(text):
            j = i
            while j < len(text) and text[i : j + 1] in sample:
                j += 1
            i, n = max(j, i + 1), n + 1
        return n

    texts = [" ".join(word() for _ in range(2500)), "a" * 7001, "abc" * 3000, samples["a"] * 5, "x", "ab" * 2048, "z" * 5000, ""]
    want = [[brute(samples[k], t) for k in m.languages] for t in texts]
    assert m.phrases(texts).tolist() == want == [m.phrases([t])[0].tolist() for t in texts]


def test_a_short_sample_is_no_disadvantage():
    """Languages of different syllables, one sample fifty times as long as the other, and one of ideographs."""
    rng = random.Random(12)

    def made(seed, n, letters=None):
        r = random.Random(seed)
        if letters:
            return "".join(rng.choice(letters) for _ in range(n))
        words = ["".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(400)]
        return " ".join(rng.choice(words) for _ in range(n))

    han = [chr(0x4E00 + i) for i in range(3000)]
    samples = {"big": made(1, 8000)[:40_000], "small": made(2, 200)[:800], "han": made(0, 4000, han)}
    m = langid.Model(samples)
    assert len(samples["big"]) == 50 * len(samples["small"]) == 40_000
    texts = [(k, made(s, 60) if s else made(0, 80, han)) for k, s in (("big", 1), ("small", 2), ("han", 0)) for _ in range(100)]
    got = m.predict([t for _, t in texts])["lang_pred"]
    for k in samples:
        assert sum(g == w for g, (w, _) in zip(got, texts) if w == k) > 95, k


# line rules


def brute_repeats(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({k for i, w in enumerate(windows) if windows.count(w) > 1 for k in (i, i + 1, i + 2)})


@pytest.mark.parametrize("seed", range(40))
def test_repeated_words(seed):
    rng = random.Random(seed)
    words = [rng.choice((b"a", b"b", b"c")) for _ in range(rng.randint(0, 25))]
    assert linefirst.repeated_words(words) == brute_repeats(words)


def test_line_rules():
    good = "\n".join(" ".join(f"word{i}{c}" for c in "abcdefgh") + " ends well." for i in range(8))
    n, chars, symbols, dups, repeats, failed, kept, left, text = linefirst.judge(good)
    assert kept and not failed and left == n and text == good
    menu = "\n".join(f"Home{i} | About{i} | Shop{i} | Contact{i} | Help{i} | More{i}." for i in range(12))
    assert linefirst.judge(menu)[6] is False and linefirst.judge(good + "\n" + menu)[8] == good
    assert "privacy" not in linefirst.judge(good + "\nRead our privacy policy, please.")[8]
    assert linefirst.judge("a\n\n a\na\n\n")[3] == 1 and linefirst.judge("#x *| é")[:3] == (2, 6, 3)
    assert linefirst.judge(None)[5:7] == (True, False)


# media


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 1024, 1025, 40_000])
def test_store_round_trip(size):
    text = "".join(chr(random.Random(size).choice((65, 233, 0x4E2D, 0x1F600, 255))) for _ in range(size))
    raw = text.encode()
    payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
    n, m, sha, crc, media_bytes, _, feature = media.digests([text])[0]
    assert (n, m, sha, crc) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert media.digests([text, text])[0] == media.digests([text])[0] and feature.startswith("frames=")


def test_frames_side_by_side_agree_with_the_reader():
    payload = bytes(random.Random(1).randrange(256) for _ in range(64 * 5))
    avi = media.Avi(media.write_avi(payload))
    a, n = avi.frames[0]
    small, full = media.decode(avi.data[a : a + n], 8), media.decode(avi.data[a : a + n])
    assert small.tobytes() == payload and (full[::8, ::8] == small).all() and (full[7::8, 7::8] == small).all()
    f = media.Frame(avi.data[a : a + n])
    d = f.coefficients()[0]
    assert (d[:, :, 0] + 128 == small).all() and not d[:, :, 1:].any()


def encode_gray(x):
    """A baseline JPEG of an 8-bit plane with AC terms, restart markers and tables of fixed-length codes."""
    h, w = x.shape
    q = np.full(64, 4.0)
    dc, ac = bytes(range(12)), bytes([0, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11))])
    lengths = lambda n, k: bytes([n if i == k - 1 else 0 for i in range(16)])
    bits = ""
    last = 0
    parts = []

    def put(v):
        s = abs(v).bit_length()
        return s, format(v if v > 0 else v + (1 << s) - 1, f"0{s}b") if s else ""

    n = 0
    for by in range(h // 8):
        for bx in range(w // 8):
            block = media.DCT @ (x[8 * by : 8 * by + 8, 8 * bx : 8 * bx + 8].astype(float) - 128) @ media.DCT.T
            z = np.rint(block.reshape(-1)[media.ZIGZAG] / q).astype(int).tolist()
            s, b = put(z[0] - last)
            last = z[0]
            bits += format(dc.index(s), "04b") + b
            run = 0
            end = max((i for i in range(1, 64) if z[i]), default=0)
            for v in z[1 : end + 1]:
                if not v:
                    run += 1
                    continue
                while run > 15:
                    bits += format(1, "08b")
                    run -= 16
                s, b = put(v)
                bits += format(ac.index(run << 4 | s), "08b") + b
                run = 0
            if end < 63:
                bits += format(0, "08b")
            n += 1
            if n % 3 == 0 or (by, bx) == (h // 8 - 1, w // 8 - 1):
                bits += "1" * (-len(bits) % 8)
                parts.append(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0"))
                bits, last = "", 0
    data = b"".join(p + (bytes([0xFF, 0xD0 + i % 8]) if i < len(parts) - 1 else b"") for i, p in enumerate(parts))
    seg = media._segment
    return (b"\xff\xd8" + seg(0xDB, b"\0" + bytes([4] * 64)) + seg(0xC4, b"\0" + lengths(12, 4) + dc) + seg(0xC4, b"\x10" + lengths(162, 8) + ac)
            + seg(0xDD, struct.pack(">H", 3)) + seg(0xC0, struct.pack(">BHHB", 8, h, w, 1) + b"\x01\x11\x00") + seg(0xDA, b"\x01\x01\x00\x00\x3f\x00") + data + b"\xff\xd9")


def test_general_jpeg():
    y, x = np.mgrid[0:32, 0:40]
    plane = (128 + 60 * np.sin(x / 5) + 40 * np.cos(y / 3)).astype(np.uint8)
    got = media.decode(encode_gray(plane))
    assert got.shape == plane.shape and np.abs(got.astype(int) - plane).max() <= 8
    with pytest.raises(ValueError):
        media.decode(b"nothing")


def test_shots():
    dark, light = np.full((6, 16, 16), 20, np.uint8), np.full((5, 16, 16), 220, np.uint8)
    assert media.shots(media.histograms(np.concatenate([dark, light, dark]))) == [0, 6, 11]
    payload = b"\x10" * 6144 + b"\xf0" * 5120
    rows = media.clip_rows(media.write_avi(payload))
    assert [(r["first_frame"], r["frames"]) for r in rows] == [(0, 6), (6, 5)] and rows[1]["start_s"] == pytest.approx(0.24)
    broken = media.write_avi(payload).replace(b"idx1", b"junk")
    assert len(media.Avi(broken).frames) == 11


# BPE


def test_perfect_hash_is_minimal_and_exact():
    tokens = [bytes([i]) for i in range(256)] + [f"t{i}".encode() for i in range(3000)]
    p = bpe.PerfectHash(tokens)
    assert [p.rank(t) for t in tokens] == list(range(len(tokens))) and sorted(p.ranks) == list(range(len(tokens)))
    assert p.rank(b"nope") == -1 and p.rank(b"") == -1


def test_bpe_equals_the_library():
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = bpe.vocabulary()
    ranks = bpe.load_ranks(path)
    e = bpe.Encoder(bpe.PerfectHash(ranks), pattern)
    lib = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(ranks)}, special_tokens={})
    rng = random.Random(5)
    texts = ["", " ", "a", "<|endoftext|> it's", "é" * 300, "ab" * 2000, "\n\n  x\t", "漢字かな", "x" * 5000]
    texts += ["".join(rng.choice("abcdefgh éß漢\n'1.") for _ in range(rng.randint(1, 80))) for _ in range(200)]
    for t in texts:
        ids = e.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(t) and e.decode(ids) == t.encode()


# near duplicates


def words_set(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_shingles():
    for t in (None, "", " \n", "a", "A b", "a b c d e", "a b c d e f a b c d e", "É é x y z É", "x" * 70_000 + " y z"):
        assert len(neardup.shingles(t)) == len(words_set(t))
    assert (neardup.shingles("A B c") == neardup.shingles("a b  C\n")).all() and (neardup.shingles("a b") != neardup.shingles("b a")).all()
    assert not set(neardup.shingles("a b c")) & set(neardup.shingles("a b"))


def brute_superminhash(s):
    """Element by element, with a whole permutation each."""
    h = [2**64 - 1] * neardup.HASHES
    for e in s:
        place = list(range(neardup.HASHES))
        for j in range(neardup.HASHES):
            with np.errstate(over="ignore"):
                z = int(neardup.splitmix(np.array([e], np.uint64) + np.uint64(j) * np.uint64(neardup.BASE))[0])
            k = j + ((z & 0xFFFFFFFF) * (neardup.HASHES - j) >> 32)
            place[j], place[k] = place[k], place[j]
            h[place[j]] = min(h[place[j]], j << 32 | z >> 32)
    return h


def test_superminhash_stops_early_without_loss():
    sets = [np.unique(neardup.splitmix(np.arange(k, dtype=np.uint64))) for k in (1, 3, 40)]
    got = neardup.signatures([*sets, np.zeros(0, np.uint64)])
    assert got[:3].tolist() == [brute_superminhash(s) for s in sets] and (got[3] == np.iinfo(np.uint64).max).all()


@pytest.mark.parametrize("union", [50, 1000])
def test_superminhash_estimates_with_less_variance(union):
    """Unbiased, with less variance than as many independent hashes (J (1 - J) / m); by the published factor for 50."""
    n = 300
    a = [neardup.splitmix(np.arange(union * 3 // 4, dtype=np.uint64) + np.uint64(10_000 * i)) for i in range(n)]
    b = [neardup.splitmix(np.arange(union // 4, union, dtype=np.uint64) + np.uint64(10_000 * i)) for i in range(n)]
    share = len(np.intersect1d(a[0], b[0])) / union
    got = (neardup.signatures([np.sort(x) for x in a]) == neardup.signatures([np.sort(x) for x in b])).mean(1)
    plain = share * (1 - share) / neardup.HASHES
    assert got.mean() == pytest.approx(share, abs=4 * (plain / n) ** 0.5)
    m, u = neardup.HASHES, 50
    factor = 1 - sum(k**u * ((k + 1) ** u + (k - 1) ** u - 2 * k**u) / ((m - 1) ** (u - 1) * m**u * (u - 1)) for k in range(1, m))
    assert got.var() < 0.9 * plain and (union != u or got.var() == pytest.approx(factor * plain, rel=0.25))


# licences


@pytest.fixture(scope="module")
def model():
    return licenses.Model()


def test_licences(model):
    for family, templates in licenses.TEMPLATES.items():
        for t in templates:
            assert model.scan(f"Some prose here.\n{t}\nMore prose.")["family"] == family
    for t in ("My driving license expired.", "He has the rights to the song.", None, "", "no trigger"):
        assert model.scan(t)["family"] is None
    got = model.scan("Released under the MIT License.\nLicensed under CC BY 4.0.")
    assert got["families"] == ["CC-BY", "MIT"]


def test_wrapped_licences(model):
    import textwrap

    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge and publish."
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    prose = "\n".join(["The tide came in before noon and the boats lay still."] * 40)
    for family, notice in (("MIT", mit), ("GPL", gpl), ("BSD", bsd)):
        for width in (30, 55, 78):
            for mark in ("", "# ", " * "):
                wrapped = "\n".join(mark + x for x in textwrap.wrap(notice, width))
                for text, line in ((wrapped, 0), (f"{prose}\n{wrapped}\n{prose}", 40), (f"{prose}\n\n{wrapped}\n\n{prose}", 41)):
                    got = model.scan(text)
                    assert got["families"] == [family] and got["paragraph"] == line, (family, width, text[:60])
    assert model.scan("She kept all\nrights to the song that\nhe licensed under\nthe old contract.")["family"] is None


HELD_OUT = [
    ("Apache-2.0", "Our code is licensed under the Apache License, Version 2.0, see the notice file."),
    ("Apache-2.0", "You may obtain this file under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with it."),
    ("MIT", "The library is released under the MIT License by its authors."), ("MIT", "Source code licensed under the MIT license (see LICENSE.txt)."),
    ("GPL", "The plugin is licensed under the GNU General Public License, version 2."),
    ("GPL", "You can redistribute it and modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("LGPL", "The bindings are licensed under the GNU Lesser General Public License, version 2.1."),
    ("BSD", "Use of this code is governed by a BSD-style license that can be found in the root folder."), ("BSD", "It is licensed under the BSD 3-Clause License."),
    ("CC-BY", "All pictures are licensed under a Creative Commons Attribution 4.0 International License."), ("CC-BY-SA", "Text licensed under CC BY-SA 4.0."),
    ("CC-BY-NC", "The recordings are licensed under CC BY-NC 4.0."), ("CC0", "The data set is released into the public domain under CC0 1.0."),
    ("MPL-2.0", "This file is licensed under the Mozilla Public License, version 2.0."), ("all-rights-reserved", "Copyright 2011 Example Ltd. All rights reserved."),
    (None, "Licensed under the Eclipse Public License, version 2.0."), (None, "Eclipse Public License, version 2.0"),
    (None, "The server is licensed under the GNU Affero General Public License, version 3 or later."), (None, "GNU Affero GPL"),
    (None, "The typeface is licensed under the Open Font License."), (None, "Distributed under the Artistic License."),
    (None, "This data is made available under the Open Database License, see the appendix."), (None, "Released under the Academic Free License, version 3.0."),
    (None, "Her driving license was issued in the spring."), (None, "The rights to the film were sold in May."),
    (None, "A license to fish is required on this river, version 2 of the form."), (None, "General permission was given by the public office."),
    (None, "The author has waived all fees."), (None, "Released in the spring, the record sold well under license."),
]


def test_precision_and_recall_on_notices_not_learnt(model):
    got = [(want, model.scan(f"Some prose.\n{text}\nMore prose.")["family"]) for want, text in HELD_OUT]
    right = sum(w == g for w, g in got if w)
    assert right / sum(w is not None for w, _ in got) >= 0.9, got
    assert right / max(1, sum(g is not None for _, g in got)) >= 0.95, got


def test_probabilities_are_calibrated(model):
    """On fresh variations, what is predicted with p is right in about p of the cases."""
    rng = random.Random(99)
    hits, ps = [], []
    for _ in range(600):
        f = rng.choice(model.families)
        pool = licenses.OUTSIDE + licenses.OTHER if f == licenses.UNKNOWN else licenses.TEMPLATES[f]
        z = model.logits(licenses.features(licenses.variation(licenses.words_of(rng.choice(pool).lower()), rng))) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        hits.append(model.families[int(p.argmax())] == f)
        ps.append(p.max())
    assert abs(np.mean(hits) - np.mean(ps)) < 0.06 and np.mean(hits) > 0.9


def test_scan_against_brute_force(model):
    """Every line, and every run of lines, tried without triggers or pair counting: no notice is lost by the search."""
    rng = random.Random(3)
    for seed in range(30):
        lines = [" ".join(rng.choice("the tide came in before noon and boats lay still".split()) for _ in range(8)) for _ in range(6)]
        family = rng.choice(sorted(licenses.TEMPLATES))
        lines.insert(rng.randrange(7), rng.choice(licenses.TEMPLATES[family]))
        found = set()
        for i in range(len(lines)):
            got, p, overlap = model.paragraph(lines[i])
            if got != licenses.UNKNOWN and p >= licenses.LEAST_PROBABILITY and overlap >= licenses.LEAST_OVERLAP:
                found.add(got)
        assert model.scan("\n".join(lines))["families"] == sorted(found) == [family]


def test_languages_of_many_scripts():
    """Each sample's own letters count, however many letters there are in all; against brute force."""
    import random

    rng = random.Random(6)
    ranges = {"am": 0x1200, "el": 0x3B1, "hy": 0x561, "ja": 0x3041, "ka": 0x10D0, "ko": 0xAC00, "th": 0xE01, "zh": 0x4E00}
    made = lambda first, n: " ".join("".join(chr(first + rng.randrange(20)) for _ in range(rng.randint(2, 6))) for _ in range(n))
    samples = {k: langid.letters(made(f, 300)) for k, f in ranges.items()}
    m, hashed = langid.Model(samples), langid.Model(samples, dense_bytes=0)
    assert m.dense is not None and hashed.dense is None
    assert len(set("".join(samples.values()))) > 150
    texts = [langid.letters(made(f, 30)) for f in ranges.values()]

    def brute(sample, text):
        n = i = 0
        while i < len(text):
            j = i
            while j < len(text) and text[i : j + 1] in sample:
                j += 1
            i, n = max(j, i + 1), n + 1
        return n

    assert m.phrases(texts).tolist() == [[brute(samples[k], t) for k in m.languages] for t in texts] == hashed.phrases(texts).tolist()
    assert m.predict(texts)["lang_pred"] == list(ranges)
