"""Each method against brute force, an exact round trip or held-out accuracy."""

import os
import random
import struct
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import bpe, forest, langid, lines, queries, rans, sharding, wfst

DIR = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@tables
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(str, want))


# -- 2 ----------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 299), max_size=3000), st.integers(1, 40), st.integers(1, 9))
def test_rans_round_trip(ids, lanes, every):
    table = rans.Table(rans.quantise(np.bincount(np.array(ids, int), minlength=300), 12))
    block = rans.encode_block(np.array(ids, int), table, lanes, every)
    assert rans.decode_block(block, table, every).tolist() == ids
    steps = -(-len(ids) // max(1, min(lanes, len(ids)))) if ids else 0
    for i in range(-(-steps // every)):
        lane = min(lanes, len(ids))
        assert rans.decode_block(block, table, every, range(i, i + 1)).tolist() == ids[i * every * lane : (i + 1) * every * lane]


def test_rans_damage_is_found():
    ids = np.arange(5000) % 50
    table = rans.Table(rans.quantise(np.bincount(ids), 12))
    block = bytearray(rans.encode_block(ids, table, 8, 16))
    block[-3] ^= 1
    with pytest.raises(ValueError):
        rans.decode_block(bytes(block), table, 16)
    with pytest.raises(ValueError):
        rans.decode_block(rans.encode_block(ids, table), rans.Table(rans.quantise(np.arange(50), 12)))


def test_quantise():
    for counts in ([0] * 10, [1, 0, 10**9], list(range(1000))):
        f = rans.quantise(np.array(counts), 12)
        assert f.sum() == 4096 and f.min() >= 1


ODD = ["a", "B", " ", "  ", "\n", "\t", "é", "漢", "🙂", "'s", "1", "23", ".", "!!", "<|endoftext|>", "<", "\x1c", "ß", "\r\n", "don't", "　", "\x85"]


def test_words_equal_the_library():
    from tokenizers import Tokenizer

    rng, tok, enc = random.Random(2), Tokenizer.from_file(BPE), bpe.Encoder(BPE)
    for _ in range(3000):
        t = "".join(rng.choices([*ODD, " ", " ", "word"], k=rng.randint(0, 12)))
        assert np.frombuffer(enc.ids(t), enc.dtype).tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


# -- 3, 4 --------------------------------------------------------------------
def brute(sets, num, den):
    """Components of sets with den * |a & b| >= num * |a | b|, by all pairs."""
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]


def family(rng, n_groups, size, edits):
    vocab = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(n_groups):
        base = rng.choices(vocab, k=rng.randint(30, 160))
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("groups", "size", "edits"), [(40, 3, 4), (2, 70, 3), (1, 90, 9)])
def test_forest_against_all_pairs(spark, groups, size, edits):
    texts = family(random.Random(groups), groups, size, edits)
    got = forest.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)})
    want = brute(sets, 85, 100)
    assert [r["component_id"] for r in got.orderBy("doc_id").collect()] == want


def star(rng, size, words, low, high):
    """Copies of one text with ``low`` to ``high`` words replaced; most are near the text, few near each other."""
    vocab = [f"w{i}" for i in range(3000)]
    base = rng.choices(vocab, k=words)
    out = []
    for _ in range(size):
        w = list(base)
        for at in rng.sample(range(words), rng.randint(low, high)):
            w[at] = rng.choice(vocab)
        out.append(" ".join(w))
    return out


def test_forest_on_crowded_groups(spark, monkeypatch):
    texts = [*star(random.Random(8), 400, 120, 2, 5), *star(random.Random(9), 300, 200, 3, 8)]
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in map(str.split, texts)]
    want = brute(sets, 85, 100)
    assert 10 < len(set(want)) < len(texts) - 100
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (512, 64):
        monkeypatch.setattr(forest, "BLOCK", block, raising=False)
        assert [r["component_id"] for r in forest.near_duplicates(docs).orderBy("doc_id").collect()] == want


def test_lines_against_all_pairs(spark):
    rng = random.Random(5)
    texts = family(rng, 50, 3, 3)
    shingles = [{t[i : i + 5] for i in range(len(t) - 4)} for t in texts]
    want = brute(shingles, 80, 100)
    rows = [(i, t) for i, t in enumerate(texts)]
    out = {r["doc_id"]: r["n_removed"] for r in lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = [i for i in range(len(texts)) if (want[i] != i) != bool(out[i])]
    assert sum(want[i] != i for i in range(len(texts))) > 40 and len(missed) <= 1


def _line_classes(texts):
    """Roots over all pairs at 0.8, by first line."""
    sets = [{t[i : i + 5] for i in range(max(1, len(t) - 4))} for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_lines_of_any_length_and_kind(spark):
    """Lines without spaces, one repeated phrase and changed openings are linked like any other."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    x, url = word(199), word(190)
    phrase = lambda n: ("the same words again and " * 20)[:n]
    pairs = [("A" + x, "B" + x), ("https" + url, "HTTPS" + url), (phrase(57), phrase(260))]
    for _ in range(40):  # one character changed anywhere in 160 without a space
        t = word(160)
        i = rng.randrange(160)
        pairs.append((t, t[:i] + "!" + t[i + 1 :]))
    han = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(120))
    pairs.append((han, han[:50] + "," + han[51:]))
    texts = [t for p in pairs for t in p]
    out = {r["doc_id"]: r["n_removed"] for r in lines.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [out[i] for i in range(len(texts))] == [0, 1] * len(pairs)


def test_lines_recall_in_groups(spark):
    """20 groups of 40 edited lines against all pairs."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    texts = []
    for _ in range(20):
        base = [rng.choice(words) for _ in range(rng.randint(8, 40))]
        for _ in range(40):
            t = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 8))):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    want = _line_classes(texts)
    out = {r["doc_id"]: r["n_removed"] for r in lines.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    lost = sum(r != i for i, r in enumerate(want))
    missed = sum(r != i and not out[i] for i, r in enumerate(want))
    assert lost > 300 and missed <= 0.01 * lost, (missed, lost)
    assert not any(out[i] for i, r in enumerate(want) if r == i)


def test_lines_on_crowded_bands(spark):
    texts = star(random.Random(10), 200, 10, 1, 1)
    want = brute([{t[i : i + 5] for i in range(len(t) - 4)} for t in texts], 80, 100)
    assert len(set(want)) < 100
    out = {r["doc_id"]: r["n_removed"] for r in lines.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    missed = [i for i in range(len(texts)) if (want[i] != i) != bool(out[i])]
    assert len(missed) <= 1


def test_lines_without_python(spark, monkeypatch):
    """DataFrame functions only, with links between lines of code points beyond 16 bits and between long lines."""
    from pyspark.sql import DataFrame, GroupedData

    def refuse(*_, **__):
        raise AssertionError("Python on the executors")

    for kind, name in ((DataFrame, "mapInArrow"), (DataFrame, "mapInPandas"), (GroupedData, "applyInArrow"), (GroupedData, "applyInPandas")):
        monkeypatch.setattr(kind, name, refuse)
    rng = random.Random(12)
    faces = "".join(chr(0x1F600 + rng.randrange(60)) for _ in range(80))
    long = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(150))
    texts = [faces, faces[:40] + "!" + faces[41:], long, long[:500] + "#" + long[501:], "abcdefgh", "abcd"]
    out = lines.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert not any(x in out._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))
    assert [r["n_removed"] for r in out.orderBy("doc_id").collect()] == [0, 1, 0, 1, 0, 0]


def test_line_stage_without_python(spark, monkeypatch):
    """The pipeline's line_dedup is made of DataFrame functions too."""
    import corpus_pipeline
    from pyspark.sql import DataFrame

    def refuse(*_, **__):
        raise AssertionError("Python on the executors")

    monkeypatch.setattr(DataFrame, "mapInArrow", refuse)
    docs = spark.createDataFrame([(1, "one line of text\nanother", 24), (2, "one line of text", 16)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in corpus_pipeline.line_dedup(spark, docs, "").collect()] == [(1, "one line of text\nanother", 24)]


# -- 6 ----------------------------------------------------------------------
@tables
def test_language_held_out(spark):
    got = queries.op6_language_id(spark, DIR.replace("0.001", "0.01"))
    docs = spark.read.parquet(DIR.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)


def test_clusters_have_length_one():
    x = np.random.default_rng(1).random((50, langid.DIMS)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose(np.linalg.norm(langid.cluster(x, 4), axis=1), 1, atol=1e-4)


# -- 9 ----------------------------------------------------------------------
def test_matrix_rows_add_up():
    parts = np.array([5, 0, 17, 100, 3])
    prefix = np.concatenate([[0], np.cumsum(parts)])
    sizes, k = sharding.cell_sizes(125, 7, 6)
    m = np.array([sharding.matrix_row(prefix, sizes, p, 1) for p in range(5)])
    assert (m.sum(axis=1) == parts).all() and (m.sum(axis=0) == sizes).all() and (m >= 0).all()
    shards = sizes.reshape(7, k).sum(axis=1)
    assert shards.max() - shards.min() <= 1 and sizes.max() <= 6


def test_matrix_law():
    """Counts of one cell over many seeds have the hypergeometric mean and variance."""
    prefix, sizes = np.array([0, 30, 100]), np.array([40, 60])
    x = np.array([sharding.matrix_row(prefix, sizes, 0, s)[0] for s in range(4000)])
    assert abs(x.mean() - 12) < 0.15 and abs(x.var() - 30 * 0.4 * 0.6 * 70 / 99) < 0.4


def test_large_urns():
    rng = np.random.default_rng(0)
    x = np.array([sharding._split_large(rng, 300, 700, 100) for _ in range(4000)])
    y = rng.hypergeometric(300, 700, 100, 4000)
    assert abs(x.mean() - y.mean()) < 0.3 and abs(x.var() - y.var()) < 1.5 and 0 <= x.min() and x.max() <= 100
    assert abs(sharding._split_large(rng, 3 * 10**9, 10**9, 10**9) / 10**9 - 0.75) < 1e-3


# -- 10 ---------------------------------------------------------------------
def model(pieces, kind, **flags):
    """A model file written by hand: (piece, score, type) and a few switches."""

    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    field = lambda n, data: varint(n << 3 | 2) + varint(len(data)) + data
    number = lambda n, v: varint(n << 3) + varint(v)
    body = b""
    for p, s, t in pieces:
        body += field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + number(3, t))
    trainer = number(3, kind) + number(35, flags.get("bytes", 0)) + number(40, 0) + number(41, (1 << 64) - 1) + number(42, (1 << 64) - 1) + number(43, (1 << 64) - 1)
    normaliser = field(1, b"identity") + number(3, flags.get("dummy", 1)) + number(4, flags.get("squeeze", 0)) + number(5, 1)
    return body + field(2, trainer) + field(3, normaliser)


@pytest.mark.parametrize("with_bytes", [0, 1])
@pytest.mark.parametrize("squeeze", [0, 1])
def test_unigram_equals_the_library(with_bytes, squeeze):
    import sentencepiece

    rng = random.Random(4)
    words = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "▁▁", "cab", "▁c", "aa"]
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if with_bytes else []
    pieces += [(w, -rng.uniform(1, 9), 1) for w in words]
    data = model(pieces, 1, bytes=with_bytes, squeeze=squeeze)
    lib = sentencepiece.SentencePieceProcessor()
    lib.LoadFromSerializedProto(data)
    t = wfst.Transducer(data)
    for _ in range(800):
        text = "".join(rng.choices(["a", "b", "c", " ", "é", "\n", "d"], weights=[5, 5, 5, 3, 1, 1, 1], k=rng.randint(0, 14)))
        got, want = np.frombuffer(t.encode(text), t.dtype).tolist(), lib.encode(text)
        # Paths of one weight may differ: the library adds in single precision.
        weight = lambda ids: sum(pieces[i][1] for i in ids)
        assert (sorted(got) == sorted(want) or abs(weight(got) - weight(want)) < 1e-4) and lib.decode(got) == lib.decode(want), repr(text)


def test_bpe_equals_the_library():
    import sentencepiece

    rng, lib, t = random.Random(6), sentencepiece.SentencePieceProcessor(model_file=PIECES), wfst.transducer(PIECES)
    for _ in range(1500):
        text = "".join(rng.choices([*ODD, " ", " ", "tion", "ing", "the", "=", "==", "http://", "    "], k=rng.randint(0, 14)))
        ids = t.encode(text)
        assert np.frombuffer(ids, t.dtype).tolist() == lib.encode(text), repr(text)
        assert t.decode(ids) == text


# -- pipeline ---------------------------------------------------------------
@tables
def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, DIR).cache()
        kept[name] = {r["doc_id"]: r.asDict() for r in out.collect()}
        if name != "sentencepiece":
            assert out.columns == docs.columns
        docs = out
    first = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    # 4: every line that stays is the first of its kind; exact repeats are gone.
    seen = Counter(x for r in kept["line_dedup"].values() for x in r["text"].split("\n") if x.strip())
    assert max(seen.values()) == 1
    every = {x for i in kept["language_id"] for x in first[i].split("\n") if x.strip()}
    assert len(every) - len(seen) < 0.1 * len(every)
    # 3: five-word shingles at 0.8.
    ids = sorted(kept["line_dedup"])
    sets = []
    for i in ids:
        w = kept["line_dedup"][i]["text"].encode().lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    roots = brute(sets, 80, 100)
    assert set(kept["near_dedup"]) == {i for k, i in enumerate(ids) if roots[k] == k}
    # 7: ten-word windows of the benchmark.
    from tickloom.llm.decontam import words

    items = [words(r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    by_size = defaultdict(set)
    for w in items:
        for j in range(max(1, len(w) - 9)):
            by_size[len(w[j : j + 10])].add(tuple(w[j : j + 10]))
    hit = lambda w: any(tuple(w[j : j + n]) in s for n, s in by_size.items() for j in range(len(w) - n + 1))
    assert set(kept["decontaminate"]) == {i for i, r in kept["near_dedup"].items() if not hit(words(r["text"]))}
    # 10: the library's ids.
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert all(r["ids"] == lib.encode(kept["decontaminate"][i]["text"]) for i, r in kept["sentencepiece"].items())
    assert set(kept["sentencepiece"]) == set(kept["decontaminate"])
