import hashlib
import re
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from shoebox.llm import licenses, media
from shoebox.llm.queries import QUERIES


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=9000))
def test_round_trip(data):
    stored = media.wrap(media.pad(data))
    info = media.probe(stored)
    assert media.read_back(stored, info) == media.pad(data)
    assert (info["codec"], info["handler"], info["samples"]) == ("raw ", "vide", len(media.pad(data)) // 192)
    assert info["keys"].tolist() == list(range(0, info["samples"], 12))


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 900), st.integers(0, 255), st.integers(0, 900))
def test_damaged_files_raise_only_bad_media(at, value, cut):
    stored = bytearray(media.wrap(media.pad(b"abc" * 700)))
    stored[at % len(stored)] = value
    for data in (bytes(stored), bytes(stored[:cut])):
        try:
            media.probe(data)
        except media.BadMedia:
            pass


def test_media_whole_table(spark, sf):
    got = {r.doc_id: r for r in QUERIES["op3_media_columns"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        r, raw = got[d.doc_id], (d.text or "").encode()
        payload = raw + b" " * (192 * max(1, -(-len(raw) // 192)) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def b(kind, *parts):
    body = b"".join(parts)
    return (len(body) + 8).to_bytes(4, "big") + kind + body


def u4(*values):
    return b"".join(v.to_bytes(4, "big") for v in values)


def hand_track(handler, codec, sizes, chunks, per_chunk, keys=None, wide=False, half_bytes=False):
    """A trak box written field by field; ``chunks`` are file offsets."""
    places = b(b"co64", u4(0, len(chunks)), *[c.to_bytes(8, "big") for c in chunks]) if wide else b(b"stco", u4(0, len(chunks)), u4(*chunks))
    size = b(b"stsz", u4(0, 0, len(sizes)), u4(*sizes))
    if half_bytes:
        pairs = [*sizes, 0][: len(sizes) + len(sizes) % 2]
        size = b(b"stz2", u4(0, 4, len(sizes)), bytes(x << 4 | y for x, y in zip(pairs[::2], pairs[1::2])))
    sync = b"" if keys is None else b(b"stss", u4(0, len(keys)), u4(*[k + 1 for k in keys]))
    stbl = b(b"stbl", b(b"stsd", u4(0, 1), b(codec, bytes(8))), b(b"stts", u4(0, 1, len(sizes), 10)), sync, b(b"stsc", u4(0, 1, 1, per_chunk, 1)), size, places)
    return b(b"trak", b(b"mdia", b(b"mdhd", u4(0, 0, 0, 100, 0, 0)), b(b"hdlr", u4(0, 0), handler, bytes(13)), b(b"minf", stbl)))


def test_tracks_keep_their_own_tables(spark):
    data = bytes(range(200))
    mdat = b(b"mdat", data)
    audio = hand_track(b"soun", b"mp4a", [5, 3, 9], [8, 40], 2, half_bytes=True)
    video = hand_track(b"vide", b"avc1", [20, 30, 40, 10], [60, 150], 2, keys=[0, 2], wide=True)
    got = media.tracks(mdat + b(b"moov", audio, video))
    assert [(t["handler"], t["codec"], t["samples"], t["duration"]) for t in got] == [("soun", "mp4a", 3, 30), ("vide", "avc1", 4, 40)]
    assert [(t["offset"].tolist(), t["size"].tolist(), t["keys"].tolist()) for t in got] == [([8, 13, 40], [5, 3, 9], [0, 1, 2]), ([60, 80, 150, 190], [20, 30, 40, 10], [0, 2])]
    assert media.read_back(mdat, got[0]) == mdat[8:16] + mdat[40:49]
    other = hand_track(b"vide", b"avc1", [20, 30], [60], 2)
    assert [t["keys"].tolist() for t in media.tracks(mdat + b(b"moov", other, video))] == [[0, 1], [0, 2]]
    with pytest.raises(media.BadMedia):
        media.tracks(mdat + b(b"moov", audio) + b(b"moof", b(b"traf")))
    row = media.media_table(spark.createDataFrame([(bytearray(mdat + b(b"moov", audio, video)),)], "content binary")).first()
    assert (row.media_codec, row.media_seconds, [tuple(k) for k in row.media_keyframes]) == ("avc1", 0.4, [(60, 80), (150, 190)])
    assert [(t.codec, t.samples, len(t.keyframes)) for t in row.media_tracks] == [("mp4a", 3, 3), ("avc1", 4, 2)]


def test_media_table_edge_rows(spark):
    good = bytearray(media.wrap(media.pad(b"x" * 5000)))
    df = spark.createDataFrame([(1, None, "a"), (2, bytearray(), "b"), (3, bytearray(b"junk" * 9), "c"), (4, good, "d")], "id int, content binary, media_codec string")
    rows = {r.id: r for r in media.media_table(df).collect()}
    assert all(rows[i].media_error and rows[i].media_codec is None for i in (1, 2, 3))
    assert rows[4].media_codec == "raw " and rows[4].media_seconds == pytest.approx(27 / 25) and len(rows[4].media_keyframes) == 3
    assert media.media_table(df.limit(0)).count() == 0
    texts = spark.createDataFrame([(1, None, 9), (1, "", 9), (None, "é" * 40000, 9)], "doc_id long, text string, n_bytes int")
    got = sorted((r.n_bytes, r.payload_bytes) for r in media.text_media(texts).collect())
    assert got == [(0, 192), (0, 192), (80000, 80064)]


def slow_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def slow_base(words):
    out = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return sorted(out)


def check_base(rows, texts):
    for r, text in zip(rows, texts):
        words = slow_words(text)
        base = slow_base(words)
        assert (r.n_words, r.n_base) == (len(words), len(base))
        assert (r.first_word, r.last_word) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r.base_labels == ",".join(sorted({b for _, b in base}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_licenses_whole_table(spark, sf):
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect())
    rows = sorted(QUERIES["op7_license_scans"](spark, sf).collect())
    check_base(rows, [d.text for d in docs])
    assert sum(r.n_base for r in rows) > 0


def test_licenses_edge_rows(spark):
    texts = [None, "", "Under THE\nMIT-License under the mit license", "cc by nc by nc cc by nc", "éunder the mit license", "Relased undr the MIT license", "x" * 50000 + " Apache License, Version 2.0"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    rows = sorted(licenses.license_scan(df).collect())
    check_base(rows, texts)
    assert rows[2].n_base == 2 and rows[3].n_base == 2 and rows[5].labels == "mit" and 0 < rows[5].score < 1 and rows[5].notices[0].edits == 2
    assert licenses.license_scan(df.limit(0)).count() == 0


words = st.lists(st.sampled_from(["released", "under", "the", "mit", "license", "licence", "permissive", "a"]), max_size=12).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(words)
def test_fuzzy_finds_what_a_full_search_finds(text):
    import regex

    for notice, label in licenses.NOTICES.items():
        k = licenses.edits(notice)
        whole = regex.search("(?:" + regex.escape(notice) + "){e<=%d}" % k, text)
        got = [x for x in licenses.fuzzy(text.encode(), {notice: label})]
        assert bool(whole) == bool(got)
        assert all(n <= k for _, _, _, n, _ in got)


def labels_of(text):
    return {x[2] for x in licenses.fuzzy(text.encode())}


def test_close_licenses_are_told_apart():
    for v in "23":
        assert labels_of(f"licensed under the gnu general public license version {v}") == {f"gpl-{v}"}
        assert labels_of(f"licenced under the gnu generl public license version {v} or later") == {f"gpl-{v}"}
    for other in ("licensed under cc by sa 4 0", "licensed under the apache license version 1 1", "released under the mpl license", "licensed under the gnu general public license version 21"):
        assert labels_of(other) == set()
    assert labels_of("licenced under cc by nc 4 0") == {"cc-by-nc"} and labels_of("licensed under the apache licence version 2 0") == {"apache-2"}


def test_a_better_match_behind_does_not_hide_a_notice():
    got = licenses.fuzzy(b"relesed undr the mit license released under the mit license and relesed under the mit license")
    assert [(x[2], x[3]) for x in got] == [("mit", 2), ("mit", 0), ("mit", 1)]


def test_a_table_that_claims_more_than_there_is_costs_nothing(spark):
    mdat = b(b"mdat", bytes(range(200)))
    video = hand_track(b"vide", b"avc1", [20, 30, 40, 10], [60, 150], 2)
    run = b(b"stsc", u4(0, 1, 1, 2, 1))
    assert run in video
    for first, count in ((1, 2**32 - 1), (2**32 - 1, 2), (2**32 - 1, 2**32 - 1), (0, 2**32 - 1)):
        content = mdat + b(b"moov", video.replace(run, b(b"stsc", u4(0, 1, first, count, 1))))
        try:
            assert [t["samples"] for t in media.tracks(content)] == [4]
        except media.BadMedia:
            pass
    long = mdat + b(b"moov", video.replace(run, b(b"stsc", u4(0, 1, 1, 2**32 - 1, 1))))
    rows = media.media_table(spark.createDataFrame([(bytearray(long),), (bytearray(mdat + b(b"moov", video)),)], "content binary")).collect()
    assert [r.media_samples for r in rows][1] == 4 and all(r.media_samples == 4 or r.media_error for r in rows)
    away = mdat + b(b"moov", hand_track(b"vide", b"avc1", [20, 30], [2**64 - 60], 2, wide=True))
    with pytest.raises(media.BadMedia):
        media.tracks(away)


def test_a_license_of_opposite_meaning_is_not_reported():
    for other in ("creative commons attribution commercial", "creative commons attribution no commercial"):
        assert labels_of(other) == set()
    for same in ("creative commons attribution noncommercial", "creative commons attribution non commercial", "creative comons attribution noncomercial", "creative commons attribution share alike"):
        assert len(labels_of(same)) == 1


def test_word_numbers_of_many_places():
    rng = __import__("random").Random(3)
    parts = [*licenses.PHRASES, *licenses.NOTICES, "word", "two words", "relesed under the mit license"]
    text = " ".join(rng.choice(parts) for _ in range(3000))
    got = licenses.scan(text.encode())
    words = text.split()
    assert got["base"] == slow_base(words)
    for first, stop, label, edits, _ in got["fuzzy"]:
        assert edits > 0 or " ".join(words[first:stop]) in [n for n, of in licenses.NOTICES.items() if of == label]
    assert any(x[3] == 0 for x in got["fuzzy"]) and any(x[3] > 0 for x in got["fuzzy"])


def test_media_features_of_the_whole_table(spark, sf):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op3_media_columns"](spark, sf).collect():
        raw = docs[r.doc_id]
        payload = raw + b" " * (192 * max(1, -(-len(raw) // 192)) - len(raw))
        stored, n = media.wrap(payload), len(payload) // 192
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        at = len(stored) - len(payload)  # frames of 192 bytes in a row, every twelfth a keyframe
        ranges = b"".join((at + i * 192 + d).to_bytes(8, "little") for i in range(0, n, 12) for d in (0, 192))
        assert stored[at:] == payload and r.feature == f"raw/vide/25/{n}/{n}/{-(-n // 12)}/{zlib.crc32(ranges):08x}"
