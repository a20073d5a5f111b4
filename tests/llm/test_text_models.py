"""SentencePiece, LM scoring, media, quality and the Jaccard join against brute force."""

from __future__ import annotations

import collections
import hashlib
import io
import math
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import language_model as lm
from quire.llm import media, near_dup, pieces, quality
from quire.llm.textops import chunks, split_words

ODD = [None, "", " ", "  a  b\n\n c\t", "x" * 300, "\U0001f600 é中文 Straße", "hello " * 3, "hello " * 3, "a b c", "tail "]


def frame(spark, texts):
    """Ids with a null and a repeat, and columns whose names clash with the operators' own."""
    rows = [(i, t, "k", 1) for i, t in enumerate(texts)] + [(None, "null id here", "k", 1), (0, texts[0], "k", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, ids int")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_split_words():
    texts = pa.array(["", " a  b\x0b\x0cc ", "\n", "é ü"], pa.large_string())
    offsets, codes, known = split_words(texts.slice(1, 3))
    assert [[known[c] for c in codes[a:b]] for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [["a", "b", "c"], [], ["é", "ü"]]


def test_chunks_cover_every_row():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (5, 0, 50, 3, 3, 3, 200)] + [None]})
    got = [t for _, part in chunks(iter([batch]), "text", 10) for t in part.to_pylist()]
    assert got == ["a" * n for n in (5, 0, 50, 3, 3, 3, 200)] + [""]


# -- SentencePiece


@pytest.mark.parametrize("s", [pieces.Settings(), pieces.Settings(lattice_chars=3, shared_rows=5)])
def test_ids_equal_the_library(spark, s):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), pieces.load(path)
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("abcdefgh  \n.,A1é▁") for _ in range(80)) for _ in range(20)]
    df = frame(spark, texts)
    encoded = pieces.encode(df, model, s)
    got = sorted(((r.doc_id is None, r.doc_id, list(r.ids)) for r in encoded.collect()), key=str)
    want = sorted(((r.doc_id is None, r.doc_id, library.encode(r.text or "")) for r in df.collect()), key=str)
    assert got == want
    back = {r.doc_id: r.text for r in pieces.decode(encoded, model).collect()}
    for i, t in enumerate(texts):
        assert back[i] == (t or "").replace("▁", " ")
    found = {r.doc_id: r for r in pieces.encode_and_check(df, model, s, paths=True).collect()}
    assert found[5].decoded_sha256 == hashlib.sha256(ODD[5].encode()).hexdigest()
    # the best path over the whole text: no piece reaches across the end of a segment
    for i, t in enumerate(texts):
        bounds, cost = pieces.best_path("▁" + t.replace(" ", "▁"), model) if t else ([0], 0.0)
        assert found[i].path_cost == pytest.approx(cost) and list(found[i].ids) == library.encode(t or "")
        assert found[i].path_pieces <= len(bounds) - 1


def test_workers_map_the_shared_segments(spark):
    """A worker reads the table of segments from the broadcast's file; it holds no copy."""
    arrays = (np.arange(50_000, dtype=np.uint64), np.arange(30_001, dtype=np.uint16), None, np.empty(0, np.float32))
    for given in (arrays, tuple(a if a is None else a[:7] for a in arrays)):
        shared = spark.sparkContext.broadcast(pieces._blob(given))

        def look(_, shared=shared):
            found = pieces._held(shared)
            yield [a if a is None else a.tolist() for a in found], [a is None or a.flags.aligned for a in found], hasattr(shared, "_value")

        values, aligned, copied = spark.sparkContext.parallelize([0], 1).mapPartitions(look).first()
        assert values == [a if a is None else a.tolist() for a in given] and all(aligned) and not copied
    assert all(np.array_equal(a, b) for a, b in zip(arrays, pieces._arrays(pieces._blob(arrays)), strict=True) if a is not None)


@pytest.mark.parametrize("paths", [False, True])
def test_the_table_is_gathered_by_ranges(spark, paths, monkeypatch):
    rng = random.Random(7)
    rows = [(rng.getrandbits(64) - (1 << 63), i, [rng.choice([5, 70_000 if i == 9 else 6])] * rng.randint(0, 3), i / 3, i) for i in range(300)]
    table = spark.createDataFrame(rows, "hi long, lo long, ids array<int>, cost double, steps int").select("hi", "lo", "ids", *["cost", "steps"] * paths)
    want = pieces._gathered(table, 300)
    asked, packed = [], pieces._packed
    monkeypatch.setattr(pieces, "GATHER_ROWS", 50)
    monkeypatch.setattr(pieces, "_packed", lambda t: asked.append(t.num_rows) or packed(t))
    got = pieces._gathered(table, 300)
    assert len(asked) == 8 and sum(asked) == 300 and max(asked) < 100
    assert all(np.array_equal(a, b) and a.dtype == b.dtype if b is not None else a is None for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize("known", [0, 2, 512])
def test_segments_by_definition(known, monkeypatch):
    """Cuts are where no piece holds the pair, whether the table knows both characters, one or none."""
    monkeypatch.setattr(pieces, "TABLE_CHARS", known)
    names = ["<unk>", "▁a", "ab", "b\u65e5", "\u65e5\U0001f600", "▁▁", "a", "b"]
    model = pieces.PieceModel(tuple(names), (0.0,) * len(names), (2,) + (1,) * (len(names) - 1), pieces.BPE, True, 0)
    pairs = {p[k : k + 2] for p in names[1:] for k in range(len(p) - 1)}
    rng = random.Random(known)
    texts = ["".join(rng.choice("ab \u65e5\U0001f600▁\u00e9\U0010ffff\n") for _ in range(rng.randrange(9))) for _ in range(400)]
    offsets, codes, found = pieces.segments(pa.array(texts, pa.large_string()), model)
    assert len(model.neighbour_table[1]) <= known + 1
    for i, t in enumerate(texts):
        got, whole = [found[c] for c in codes[offsets[i] : offsets[i + 1]]], "▁" + t.replace(" ", "▁") if t else ""
        assert "".join(got) == whole
        # a word's first character is cut off whatever it follows
        assert all(a + b in pairs for x in got for a, b in zip(x, x[1:], strict=False))
        assert all(a[-1] + b[0] not in pairs or b[0] == "▁" for a, b in zip(got, got[1:], strict=False))


@pytest.mark.parametrize("least", [1, 2])
def test_few_substrings_are_exploded_and_no_piece_is_missed(spark, least):
    model, rng = pieces.public_model(), random.Random(4)
    segs = sorted({"".join(rng.choice(["th", "er", "ing", "▁", "é", "中", "x", "schaft", "Q"]) for _ in range(rng.randint(1, 9))) for _ in range(500)})
    offsets, found = pieces.spans(segs, model, least)
    got = [{(x & 255, x >> 8) for x in found[a:b].tolist()} for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    want = [{(s, e) for s in range(len(x)) for e in range(s + least, len(x) + 1) if x[s:e] in model.usable or least == 1 == e - s} for x in segs]
    assert len(found) == sum(map(len, got)) and all(w <= g for w, g in zip(want, got, strict=True))
    assert all(g for x, g in zip(segs, got, strict=True) if len(x) >= least)
    # all substrings were exploded before
    assert len(found) < 1.2 * (sum(map(len, want)) + (least - 1) * len(segs)) < 0.6 * sum(n * (n + 1) // 2 for n in map(len, segs))
    table = spark.createDataFrame([(x, 1, found[a:b].tolist()) for x, a, b in zip(segs, offsets[:-1], offsets[1:], strict=True)], "seg string, n long, spans array<smallint>")
    rows = {(r.seg, r.s, r.e, r.sub) for r in pieces.substrings(table).collect()}
    assert rows == {(x, s, e, x[s:e]) for x, g in zip(segs, got, strict=True) for s, e in g}


def test_segments_are_counted_by_words():
    model, rng = pieces.public_model(), random.Random(5)
    texts = pa.array([" ".join(rng.choice(["the", "a1b2", "", "Straße", "中x", "the\nend"]) for _ in range(rng.randint(0, 40))) for _ in range(50)], pa.large_string())
    _, codes, segs = pieces.segments(texts, model)
    found, n = pieces.segment_counts(texts, model)
    assert found == segs and n.tolist() == np.bincount(codes, minlength=len(segs)).tolist()
    assert pieces.segment_counts(texts.slice(0, 0), model)[0] == []


@pytest.mark.parametrize("scale", [1.0, 0.3])
def test_paths_with_whole_and_other_costs(spark, scale):
    """Whole costs are packed as they are, others by their place."""
    rng = random.Random(6)
    names = ["<unk>", "▁", "a", "b", *sorted({rng.choice("▁ab") + "".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(30)})]
    scores = tuple(-scale * rng.randint(1, 40) for _ in names)
    model = pieces.PieceModel(tuple(names), scores, (2,) + (1,) * (len(names) - 1), pieces.BPE, True, 0)
    assert model.whole == (scale == 1.0)
    texts = ["".join(rng.choice("abc ") for _ in range(25)) for _ in range(30)]
    got = {r.doc_id: r.path_cost for r in pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, paths=True).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(pieces.best_path("▁" + t.replace(" ", "▁"), model)[1])


def test_encode_empty_table(spark):
    assert pieces.encode_and_check(frame(spark, ["x"]).limit(0), pieces.public_model()).count() == 0


def test_viterbi_finds_the_best_path(spark):
    names = ["<unk>", *"abc▁", "ab", "bc", "abc", "▁a", "▁ab", "ca", "cab"]
    rng = random.Random(4)
    model = pieces.PieceModel(tuple(names), tuple([0.0] + [-rng.uniform(1, 9) for _ in names[1:]]), tuple([2] + [1] * (len(names) - 1)), pieces.UNIGRAM, True, 0)
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 8))) for _ in range(40)]
    got = {r.doc_id: list(r.ids) for r in pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}

    def cost(ids):
        return sum(pieces.unk_cost(model) if i == 0 else -model.scores[i] for i in ids)

    def best(t):
        if not t:
            return 0.0
        found = [pieces.unk_cost(model) + best(t[1:])] if t[0] not in model.usable else []
        return min(found + [-model.scores[i] + best(t[len(p):]) for p, i in model.usable.items() if t.startswith(p)])

    for i, t in enumerate(texts):
        assert cost(got[i]) == pytest.approx(best("▁" + t.replace(" ", "▁")) if t else 0.0)


# -- LM scoring


def lm_losses(target, every, s, leave_out=0):
    """loss(text, side) by definition; side 0 is the target."""
    sides = [[words(t) for t in target], [words(t) for t in every]]
    uni = [collections.Counter(w for t in side for w in t) for side in sides]
    two = [collections.Counter(p for t in side for p in zip([0, *t], t, strict=False)) for side in sides]
    hist = [collections.Counter(p[0] for p in c.elements()) for c in two]
    size = len(set(uni[0]) | set(uni[1])) + 1

    def loss(t, k):
        w, out = words(t), leave_out * k
        p1 = lambda x: (uni[k][x] - out + s.add) / (uni[k].total() - out + s.add * size)
        return sum(-math.log((two[k][p] - out + s.prior * p1(p[1])) / (hist[k][p[0]] - out + s.prior)) for p in zip([0, *w], w, strict=False)) / len(w)

    return loss


@pytest.mark.parametrize("s", [lm.Settings(), lm.Settings(prior=2.0, add=0.1)])
def test_scores_against_brute_force(spark, s):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(vocab[: rng.randint(2, 30)]) for _ in range(rng.randint(0, 30))) for _ in range(40)] + [f"once{i} w{i} twice{i // 2}" for i in range(20)]
    texts += ["w1 w2 " * 3000, "", "\n "]
    target = [" ".join(rng.choice(vocab[:5]) for _ in range(20)) for _ in range(5)] + [None, "only target target"]
    df = frame(spark, texts)
    asked = frame(spark, ["w1 w2 never seen", "target target once3", None])
    model = lm.train(spark.createDataFrame([(t,) for t in target], "text string"), df, s)
    for table, leave_out in ((df, 0), (df, 1), (asked, 0)):
        loss = lm_losses(target, [r.text for r in df.collect()], s, leave_out)
        rows = {r.doc_id: r.text for r in table.collect()}
        out = lm.score(table, model, s, leave_out=bool(leave_out)).collect()
        assert len(out) == table.count()
        for r in out:
            t = rows[r.doc_id]
            if not words(t):
                assert r.n_tokens == 0 and r.score is None
            else:
                assert r.n_tokens == len(words(t)) and r.target_loss == pytest.approx(loss(t, 0)) and r.score == pytest.approx(loss(t, 0) - loss(t, 1))
    with pytest.raises(ValueError):
        lm.score(asked, model, s, leave_out=True)


def test_rare_pairs_keep_their_counts_between_pieces(spark):
    """Seven pieces, several ranges of hashes, and counts of one in millions of tokens."""
    texts = [f"p{i // 2} q{i // 2} r{i // 2}" for i in range(30)] + ["a b c d " * 20_000] * 30 + ["lone words here"]
    rng = random.Random(5)
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    s = lm.Settings()
    out = lm.score(df, lm.train(spark.createDataFrame([("a b c",)], "text string"), df, s), s, leave_out=True).collect()
    loss = lm_losses(["a b c"], texts, s, 1)
    for r in out:
        if len(texts[r.doc_id]) < 100:
            assert r.background_loss == pytest.approx(loss(texts[r.doc_id], 1)) and r.target_loss == pytest.approx(loss(texts[r.doc_id], 0))
    # what occurs twice is told apart from what occurs once
    by = {texts[r.doc_id]: r.background_loss for r in out}
    assert by["lone words here"] > by["p3 q3 r3"] + 1


def test_packed_numbers():
    for x in (np.array([], np.uint64), np.array([0, 1, 2**64 - 1], np.uint64), np.arange(-5, 500, dtype=np.int64)):
        assert (lm.unpack(lm.pack(x), len(x), x.dtype) == x).all()


def test_model_grows_with_the_background(spark):
    """A word and a pair that occur twice keep their counts in 300,000 other tokens."""
    docs = spark.createDataFrame([(i, "rare pair") for i in range(2)] + [(9, "once only")] + [(i, "a b c " * 1000) for i in range(10, 110)], "doc_id long, text string")
    model = lm.train(docs.where("doc_id > 200"), docs)
    out = {r.doc_id: r for r in lm.score(docs, model).collect()}
    assert {r.doc_id: r for r in lm.score(docs.select("*"), model).collect()} == out
    assert len(out) == 103 and out[0].background_loss < out[9].background_loss - 0.01 and out[0][1:] == out[1][1:]


def test_target_like_text_scores_lower(spark):
    docs = spark.createDataFrame([(i, "red green blue " * 5 if i % 2 else "one two three four " * 5) for i in range(40)], "doc_id long, text string")
    out = lm.score(docs, lm.train(spark.createDataFrame([("red green blue",)] * 3, "text string"), docs))
    by = {r.doc_id: r.score for r in out.collect()}
    assert max(by[i] for i in by if i % 2) < min(by[i] for i in by if not i % 2)
    empty = docs.limit(0)
    assert lm.score(empty, lm.train(empty, empty)).count() == 0


# -- media


def test_decoders():
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4, 1)
    assert (media.decode_image(b"P5 # c\n4 3\n255\n" + grey.tobytes()) == grey).all()
    assert (media.decode_image(b"P2\n4 3 255\n" + " ".join(map(str, range(12))).encode()) == grey).all()
    assert media.decode_image(b"P1\n2 1\n1 0")[:, :, 0].tolist() == [[0, 255]]
    assert media.decode_image(b"P4\n2 1\n\x40")[:, :, 0].tolist() == [[255, 0]]
    assert media.decode_image(b"P5 1 1 65535\n\x01\x02").tolist() == [[[258]]]
    assert media.decode_image(b"P3 1 1 15\n15 0 3").tolist() == [[[255, 0, 51]]]
    pixels = struct.pack("<6B2x6B2x", *range(12))
    bmp = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 70, 0, 0, 54, 40, 2, 2, 1, 24, 0, 16, 0, 0, 0, 0) + pixels
    assert media.decode_image(bmp).tolist() == [[[8, 7, 6], [11, 10, 9]], [[2, 1, 0], [5, 4, 3]]]
    table = bytes([0, 0, 0, 0, 3, 2, 1, 0])
    one = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 66, 0, 0, 62, 40, 3, -1, 1, 1, 0, 4, 0, 0, 2, 0) + table + b"\xa0\0\0\0"
    assert media.decode_image(one).tolist() == [[[1, 2, 3], [0, 0, 0], [1, 2, 3]]]
    for bad in (b"", b"P6", b"P5 2 2 255\n1", b"BM", b"GIF89a", b"P5 0 1 255\n"):
        with pytest.raises((media.BadImage, ValueError)):
            media.decode_image(bad)


@pytest.mark.parametrize("shape", [(1, 1, 1), (7, 5, 3), (64, 64, 1), (3, 40, 3), (20, 2, 1)])
def test_resize_against_exact_fractions(shape, monkeypatch):
    from fractions import Fraction

    monkeypatch.setattr(media, "STRIP_ROWS", 4)
    img = np.random.default_rng(0).integers(0, 256, shape, dtype=np.uint8)
    got = media.area_resize(img, 8, 9)
    h, w, c = shape

    def share(n, parts, k, i):
        return max(Fraction(0), min(Fraction((k + 1) * n, parts), i + 1) - max(Fraction(k * n, parts), i))

    for y in (0, 3, 7):
        for x in (0, 4, 8):
            for z in range(c):
                total = sum(int(img[i, j, z]) * share(h, 8, y, i) * share(w, 9, x, j) for i in range(h) for j in range(w))
                assert Fraction(int(got[y, x, z])) == total * 72


def plain_feature(payload):
    """The feature from its definition, in exact fractions."""
    from fractions import Fraction

    h = len(payload) // 192
    img = [[[payload[(y * 64 + x) * 3 + c] for c in range(3)] for x in range(64)] for y in range(h)]

    def shares(n, parts):
        return [[max(Fraction(0), min(Fraction((k + 1) * n, parts), i + 1) - max(Fraction(k * n, parts), i)) for i in range(n)] for k in range(parts)]

    def mean(rows, cols, c):
        return sum(r * q * img[y][x][c] for y, r in enumerate(rows) if r for x, q in enumerate(cols) if q) / (sum(rows) * sum(cols))

    rows, cols = shares(h, 8), shares(64, 9)
    grey = [[sum(mean(r, q, c) for c in range(3)) for q in cols] for r in rows]
    bits = "".join(str(int(b > a)) for line in grey for a, b in zip(line, line[1:], strict=False))
    rows, cols = shares(h, 16), shares(64, 16)
    tile = np.array([[[math.floor(mean(r, q, c) + Fraction(1, 2)) for c in range(3)] for q in cols] for r in rows], np.uint8)
    out = io.BytesIO()
    np.save(out, tile)
    return f"{int(bits, 2):016x}-{hashlib.sha256(out.getvalue()).hexdigest()[:16]}"


def test_media_of_an_empty_table_and_text_ids(spark, tmp_path):
    schema = "doc_id string, text string, feature int, n_bytes string"
    for name, rows in (("none", []), ("some", [("a", "x", 1, "y"), (None, None, None, None), ("a", "x", 1, "y")])):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        out = media.op6_media_columns(spark, str(tmp_path / name)).collect()
        assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in rows)


def test_media_query(spark, tmp_path):
    frame(spark, [*ODD, "y" * 192, "z" * 5_000_000]).write.parquet(str(tmp_path / "documents.parquet"))
    rows = media.op6_media_columns(spark, str(tmp_path)).collect()
    assert len(rows) == len(ODD) + 4
    by = {r.doc_id: r for r in rows}
    for i, t in enumerate([*ODD, "y" * 192]):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:])
        assert r.feature == plain_feature(payload)
        stored = b"P6\n64 %d\n255\n" % (len(payload) // 192) + payload
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert by[6][2:] == by[7][2:] and by[0].feature == by[1].feature


def test_image_table(spark):
    ppm = media.as_ppm(bytes(range(192)) * 4)
    df = spark.createDataFrame([(1, ppm, "x"), (2, b"bad", "x"), (3, None, "x"), (1, ppm, "x")], "id long, content binary, tile string")
    rows = sorted(media.image_features(df).collect(), key=lambda r: r.id)
    assert (rows[0].height, rows[0].width, rows[0].channels) == (4, 64, 3) and rows[0] == rows[1]
    assert np.load(io.BytesIO(rows[0].tile)).shape == (16, 16, 3) and rows[2].error and rows[3].error
    assert media.image_features(df.limit(0)).count() == 0


# -- quality


def test_quality_learns(spark):
    rng = random.Random(0)
    good = lambda: " ".join(rng.choice(["the", "cat", "sat", "on", "mats", "quietly", "today."]) for _ in range(30))
    bad = lambda: " ".join(rng.choice(["BUY!!", "NOW!!", "$$$"]) for _ in range(30))
    texts = [good() if i % 3 else bad() for i in range(300)]
    df = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(bool(i % 3)), 0) for i in range(300)] + [(5, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(df, labels)
    out = [r for r in quality.score(df, model).collect() if r.doc_id is not None]
    assert all((r.score >= 0.3) == bool(r.doc_id % 3) for r in out) and all(0 <= r.score <= 1 for r in out)
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns and kept.where("doc_id % 3 = 0").count() == 0
    odd = quality.score(frame(spark, ODD), model).collect()
    assert len(odd) == len(ODD) + 2 and all(r.score is not None for r in odd)


def test_shape_covers_the_whole_word():
    assert quality.shape("a" * 64 + "1B") == "a0A"


def test_fit_against_a_quadratic_program():
    """Ratios by definition; the dual of the hinge loss by projected gradient over all variables."""
    rng = np.random.default_rng(4)
    s = quality.Settings(bits=6, epochs=4000, calibration=5)
    y = rng.integers(0, 2, 60)
    rows = [np.unique(rng.integers(0, 64, 12) // (1 + k)) for k in y]
    got = quality.fit(rows, y, s)
    fitting = [i for i in range(60) if i % 5]
    count = np.ones((2, 64))
    for i in fitting:
        for c in rows[i]:
            count[y[i], c] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    x = np.zeros((60, 64))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r]
        x[i] /= np.linalg.norm(x[i])
    x = np.hstack([x, np.ones((60, 1))])
    sign = np.where(y > 0, 1.0, -1.0)
    a = x[fitting] * sign[fitting, None]
    share = np.bincount(y[fitting], minlength=2)
    most = np.array([len(fitting) / (2 * share[y[i]]) for i in fitting])
    dual, pace = np.zeros(len(fitting)), 1 / np.linalg.eigvalsh(a @ a.T).max()
    for _ in range(100_000):
        dual = np.clip(dual + pace * (1 - a @ (a.T @ dual)), 0, most)
    margin = x @ (a.T @ dual)
    length = np.array([np.linalg.norm(ratio[r]) for r in rows])
    mine = np.array([got.weights[r].sum() for r in rows]) / length + got.bias
    assert mine == pytest.approx(margin, abs=0.02)
    assert got.squares == pytest.approx(ratio**2) and got.slope > 0


def test_indicators_by_definition():
    """The distinct hashes of a text's n-grams, as many as there are without collisions."""
    texts = ["the cat the cat sat", "", "A1 a1 a1 a1 b!!", " one\tone\n"]
    who, column = quality.indicators(pa.array(texts, pa.large_string()), 40)
    for i, t in enumerate(texts):
        w, n = words(t), lambda x, k: {("n", k, tuple(x[j : j + k])) for j in range(len(x) - k + 1)}
        look = [quality.shape(x) for x in w]
        want = n(w, 1) | n(w, 2) | {("s", *g) for k in (1, 2, 3) for g in n(look, k)}
        want |= {("r", k) for k in (2, 3) if any(len(set(w[j : j + k])) == 1 for j in range(len(w) - k + 1))}
        assert (who == i).sum() == len(want) and len(set(column[who == i])) == len(want)


def test_repeated_ids_are_learnt_by_the_smallest_text(spark):
    rows = [(i, f"good words {i}" if i % 2 else f"BAD!! 00 {i}") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    more = rows + [(i, "zzz " + t) for i, t in rows] + rows[:9] + [(None, "x"), (3, None)]
    make = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    one, two = quality.train(make(rows), labels), quality.train(make(more[::-1]), labels)
    assert (one.weights == two.weights).all() and (one.bias, one.slope) == (two.bias, two.slope)
    assert quality.sample_rows(make(more), labels, quality.Settings()).count() == quality.sample_rows(make(rows), labels, quality.Settings()).count()
    long = make([(1, "good words " * 300_000), (2, "x" * 3_000_000)])
    assert quality.score(long, one).count() == 2


def test_quality_without_labels(spark):
    df = frame(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(df, quality.train(df, none)).collect()} == {0.5}
    assert quality.score(df.limit(0), quality.train(df.limit(0), none)).count() == 0


# -- Jaccard join


def sets_of(t):
    w = words((t or "").lower())
    return frozenset(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """class id and links by definition."""
    seq = {}
    for i, t in rows:
        seq.setdefault(tuple(words((t or "").lower())), []).append(i)
    keys, sets = list(seq), {k: sets_of(" ".join(k)) for k in seq}
    linked = {k: [j for j in keys if j != k and sets[k] and 5 * len(sets[k] & sets[j]) >= 4 * len(sets[k] | sets[j])] for k in keys}
    out = {}
    for k in keys:
        seen, todo = {k}, [k]
        while todo:
            for j in linked[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [i for j in seen for i in seq[j] if i is not None]
        out[k] = (min(ids, default=None), len(linked[k]), len(seq[k]))
    return out


@pytest.mark.parametrize("s", [near_dup.Settings(), near_dup.Settings(bucket=4, depth=3, block_rows=8, block_tokens=900, pivots=2, block_keys=8)])
def test_join_against_brute_force(spark, s):
    rng = random.Random(7)
    vocab = [f"v{i}" for i in range(500)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(30, 90))) for _ in range(25)]
    shared = " ".join(rng.choice(vocab) for _ in range(20))

    def edit(t, n):
        w = t.split()
        for _ in range(n):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        return " ".join(w)

    texts = base + [edit(t, 1) for t in base for _ in range(4)] + [edit(t, 3) for t in base] + [f"{shared} {t}" for t in base] + [base[0].upper(), "a b", "a b", "A  b\n", "a c"] + ODD
    df = frame(spark, texts)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = brute(rows)
    got = near_dup.join_similar(df, s).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        assert (r.class_id, r.n_links, r.n_copies) == want[tuple(words((text[r.doc_id] or "").lower()))], r
    assert near_dup.recall(near_dup.Settings()) > 0.9999


def test_a_large_group_of_near_copies(spark):
    """600 distinct texts, each a word apart from one base: no path of a member may end in a large bucket."""
    base = [f"u{k}" for k in range(120)]
    texts = [" ".join([*base[: i % 120], f"x{i}", *base[i % 120 + 1 :]]) for i in range(600)]
    want = brute(list(enumerate(texts)))
    for r in near_dup.join_similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        assert (r.class_id, r.n_links, r.n_copies) == want[tuple(words(texts[r.doc_id]))], r
    s = near_dup.Settings()
    assert all(near_dup.recall(s, level) > 0.9999 for level in range(1, s.depth + 1))


def test_shared_template(spark):
    """1,200 texts with half of their shingles in common: pairs at the threshold are found in buckets that
    stay large, and unrelated texts are not candidates of each other."""
    rng = random.Random(11)
    template = [f"t{k}" for k in range(44)]
    texts = [template + [f"o{i}x{k}" for k in range(30)] for i in range(1000)]
    for i in range(200):
        w = list(texts[i])
        w[44 + rng.randrange(5, 25)] = f"changed{i}"
        texts.append(w)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    pair = lambda i, j: len(sets_of(rows[i][1]) & sets_of(rows[j][1])) / len(sets_of(rows[i][1]) | sets_of(rows[j][1]))
    assert 0.35 < pair(3, 7) < 0.6 and all(0.8 <= pair(i, 1000 + i) < 0.9 for i in range(200))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    s = near_dup.Settings()
    got = {r.doc_id: r.class_id for r in near_dup.join_similar(df, s).collect()}
    found = sum(got[1000 + i] == got[i] == i for i in range(200))
    assert found >= 198 and all(got[i] == i for i in range(1000))
    from quire.llm.graph import components

    sets = near_dup.signatures(df, s).select("key", "sketch", "brief")
    groups = components(near_dup.candidate_links(sets, s)).groupBy("label").count()
    assert groups.agg({"count": "max"}).first()[0] <= 4


def test_null_and_repeated_ids(spark):
    """Each text is decided on its own, and many rows without an id are no burden for each other."""
    own = lambda k: " ".join(f"w{k}x{i}" for i in range(20))
    rows = [(None, own(k // 2)) for k in range(600)] + [(5, own(1000 + k // 2)) for k in range(600)] + [(None, own(3) + " end")]
    out = near_dup.join_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows) and {r.n_copies for r in out} == {1, 2} and sum(r.n_links for r in out) == 3
    assert near_dup.join_similar(spark.createDataFrame([(1, "a b " * 500_000 + "c"), (2, "a b " * 500_000), (3, "x" * 2_000_000)], "doc_id long, text string")).count() == 3


def test_join_empty(spark):
    assert near_dup.join_similar(frame(spark, ["x"]).limit(0)).count() == 0


def test_components(spark):
    from quire.llm.graph import components, contract

    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(k, k + 1) for k in range(500, 560)] + [(7, 7)]
    want = {}
    for a, b in links:
        if a != b:
            group = want.setdefault(a, {a}) | want.setdefault(b, {b})
            for x in group:
                want[x] = group
    df = spark.createDataFrame(links, "u long, v long")
    assert {r.u: r.label for r in components(df).collect()} == {x: min(g) for x, g in want.items()}
    assert contract(df.unionAll(df).unionAll(df)).count() <= 8 * len(want)
    assert components(df.limit(0)).count() == 0
