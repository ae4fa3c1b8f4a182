"""Nulls, empty and very long texts, ties and repeated rows, empty tables, clashing columns: every operator."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tickloom.llm import decontam, forest, langid, lengths, licences, lines, quality, rans, sharding, wfst

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"word{i % 977} and" for i in range(40_000))
TEXT = "the quick brown fox jumps over the lazy dog while seven wizards quietly box with nine very jolly sphinxes near a river bank today"
ROWS = [
    (1, TEXT), (2, TEXT), (2, TEXT), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (None, TEXT + " again"), (7, LONG), (8, LONG + " tail"),
    (9, "é漢字🙂 \x1c ▁ <|endoftext|>\r\n\n  x"), (10, "..."), (None, None),
]
#: Columns that the operators add themselves.
CLASH = ["shard", "slot", "n_words", "hits", "items", "ids", "n_ids", "lang_pred", "score", "rejected", "removed", "n_lines", "n_removed", "component_id", "kept", "tid", "row", "_at", "_cell"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def by_id(df, *cols):
    return sorted((tuple(r[c] for c in ("doc_id", *cols)) for r in df.collect()), key=str)


def test_quality(docs, none):
    got = quality.judge(docs).collect()
    assert len(got) == len(ROWS)
    one = {r["doc_id"]: r for r in got if r["doc_id"]}
    assert one[3]["n_words"] == one[4]["n_words"] == one[5]["n_words"] == 0 and one[3]["base_failed"] and not one[3]["kept"]
    assert one[7]["n_words"] == 80_000 and one[7]["n_repeat_words"] == 80_000
    assert quality.judge(none).count() == 0
    assert quality.estimate([], 3)[0] == 0.5


def test_rans(spark, docs, none, tmp_path):
    path = rans.write_tokens(docs, BPE, 2, str(tmp_path / "tokens"))
    got = rans.read_tokens(spark.newSession(), path, with_ids=True).orderBy("start").collect()
    assert len(got) == len(ROWS)
    tok = Tokenizer.from_file(BPE)
    want = sorted(([i, t] for i, t in ROWS), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in got] == [r[0] for r in want]
    at = 0
    for r in got:
        texts = [t for i, t in ROWS if i == r["doc_id"]]
        options = [[*tok.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
        assert r["ids"] in options and r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    assert spark.read.parquet(f"{path}/parts").selectExpr("sum(n)").first()[0] == at
    assert rans.read_tokens(spark, rans.write_tokens(none, BPE, 2)).count() == 0


def test_near_duplicates(docs, none):
    got = forest.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    c = {r["doc_id"]: (r["component_id"], r["kept"], r["n_shingles"]) for r in got if r["doc_id"]}
    assert c[1][:2] == (1, True) and c[2][:2] == (1, False) and c[7][:2] == (7, True) and c[8][:2] == (7, False)
    assert c[3] == (3, True, 0) and c[5] == (5, True, 0) and c[6] == (6, True, 1)
    assert sorted(str(r["component_id"]) for r in got if r["doc_id"] is None) == ["1", "None"]
    assert forest.near_duplicates(none).count() == 0


def test_lines(spark, docs, none):
    got = {r["doc_id"]: r for r in lines.deduplicate(docs).collect() if r["doc_id"]}
    # The null doc_id comes first, so that its near copy of TEXT stays.
    assert got[1]["text"] == "" and got[2]["removed"] == [0] and got[3]["text"] is None and got[4]["text"] == ""
    assert got[5]["n_lines"] == 0 and got[6]["text"] == "one" and got[8]["text"] == "" and got[7]["n_removed"] == 0
    assert lines.deduplicate(none).count() == 0
    rows = [(1, f"{TEXT}\n\n{TEXT}\nabc"), (2, f"abc\n{TEXT}!\n ")]
    out = {r["doc_id"]: (r["text"], r["removed"], r["n_lines"]) for r in lines.deduplicate(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert out == {1: (f"{TEXT}\n\nabc", [2], 3), 2: (" ", [0, 1], 2)}


def test_lengths(docs, none):
    h = lengths.length_histogram(docs, BPE)
    tok = Tokenizer.from_file(BPE)
    n = sorted(len(tok.encode(t or "", add_special_tokens=False).ids) for _, t in ROWS)
    assert {r["n_tokens"]: r["n_docs"] for r in h.collect()} == {x: n.count(x) for x in n}
    got = {r["context_limit"]: (r["docs_over"], r["truncated_total"]) for r in lengths.at_limits(h, [0, 1, 10, 10**9]).collect()}
    assert got == {x: (sum(v > x for v in n), sum(min(v, x) for v in n)) for x in (0, 1, 10, 10**9)}
    q = {r["share"]: r["n_tokens"] for r in lengths.quantiles(h, [0.0, 0.5, 1.0]).collect()}
    assert q == {0.0: n[0], 0.5: n[-(-len(n) // 2) - 1], 1.0: n[-1]}
    assert all(r["truncated_total"] == sum(min(v, r["n_tokens"]) for v in n) for r in h.collect())
    assert lengths.length_histogram(none, BPE).count() == 0


def test_language(spark, docs, none):
    rows = [(t, lang) for lang, words in (("aa", "abra kadabra alakazam barara"), ("bb", "zork mizzle zuzzle phizz")) for t in (" ".join(words.split()[i % 4 :] + words.split()[: i % 4]) for i in range(12))]
    model = langid.fit(spark.createDataFrame([*rows, (None, "aa"), ("...", "bb"), ("text", None)], "text string, lang string"))
    assert set(model["langs"]) == {"aa", "bb"}
    got = by_id(langid.predict(docs, model), "lang_pred", "score", "rejected")
    assert len(got) == len(ROWS)
    assert [g for g in got if g[0] in (3, 4, 5, 10)] == [(i, "und", 0.0, True) for i in (10, 3, 4, 5)]
    assert all(0 <= g[2] <= 1 for g in got)
    empty = langid.fit(none)
    assert {r["lang_pred"] for r in langid.predict(docs, empty).collect()} == {"und"} and langid.predict(none, model).count() == 0


def test_decontaminate(spark, docs, none):
    items = spark.createDataFrame([(5, TEXT), (40, "ONE"), (None, "lazy dog, while seven wizards"), (7, None), (8, ""), (9, "not there at all")], "item_id long, text string")
    for block in (200_000, 3):
        out = decontam.contaminate(docs, items, block_windows=block).collect()
        got = {r["doc_id"]: (r["n_words"], [tuple(h) for h in r["hits"]], r["items"]) for r in out if r["doc_id"]}
        assert len(out) == len(ROWS)
        assert got[1] == got[2] == (len(TEXT.split()), [(0, len(TEXT.split()))], ["5", "null"])
        assert got[6] == (1, [(0, 1)], ["40"]) and got[3] == got[4] == (0, [], []) and got[7][1:] == ([], [])
    assert decontam.contaminate(none, items).count() == 0
    assert all(r["hits"] == [] for r in decontam.contaminate(docs, items.where("false")).collect())
    many = decontam.contaminate(docs, items, shingle=3, block_windows=2)
    assert {r["doc_id"] for r in many.collect() if r["hits"]} == {1, 2, 6, None}


def test_licences(spark, docs, none):
    assert licences.scan(docs).count() == 0 and licences.scan(none).count() == 0
    wrapped = licences.TEMPLATES["MIT"][1].replace(", ", ",\n", 3)
    rows = [(1, "x\nreleased under the MIT license"), (1, "x\nreleased under the MIT license"), (2, f"a b\n\n{wrapped}\n\nc d"), (None, "Licensed under CC BY-NC 4.0."), (3, "license")]
    got = by_id(licences.scan(spark.createDataFrame(rows, "doc_id long, text string")), "unit", "unit_no", "licence", "dice")
    whole = [g for g in got if g[4] == 1.0]
    assert whole == [(1, "line", 1, "MIT", 1.0), (1, "line", 1, "MIT", 1.0), (2, "paragraph", 1, "MIT", 1.0), (None, "line", 0, "CC-BY-NC-4.0", 1.0)]
    assert (1, "paragraph", 0, "MIT", 0.888889) in got and (3, "line") not in {g[:2] for g in got}
    assert licences.scan(docs, templates={}).count() == 0


def test_shards(spark, docs, none):
    got = sharding.shard(docs, n_shards=5, cell_rows=2).collect()
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(str(i) for i, _ in ROWS)
    assert sorted(map(len, slots.values())) == [2, 2, 3, 3, 3] and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard(none).count() == 0


def test_pieces(docs, none):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = wfst.encode_documents(docs, PIECES).collect()
    assert len(got) == len(ROWS)
    want = {str(i): [lib.encode(t or "") for j, t in ROWS if j == i] for i, _ in ROWS}
    for r in got:
        assert r["ids"] in want[str(r["doc_id"])] and r["n_ids"] == len(r["ids"]) and r["round_trip"] == ("▁" not in (r["text"] or ""))
    assert wfst.encode_documents(none, PIECES).count() == 0


PIPE = [(1, TEXT), (1, "another text of some eight or nine words altogether here"), (None, TEXT), (None, "alone without an id but with its own words"), (2, None), (3, ""), (4, " "), (5, TEXT), (5, TEXT)]


def _pipe(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, 8) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, tid int, lost_id int")


def test_stage_near_dedup(spark):
    """Rows that share a doc_id, or have none, lose only what is a copy; clashing columns stay."""
    docs = _pipe(spark, PIPE)
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect())
    assert got == sorted((i or 0, t or "") for i, t in [PIPE[0], PIPE[1], PIPE[3], PIPE[4], PIPE[5], PIPE[6]])
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_stages_on_edges(spark):
    docs = _pipe(spark, PIPE)
    for name, stage in corpus_pipeline.STAGES:
        if name == "near_dedup":
            continue
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.count() <= len(PIPE) and stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
        if name != "sentencepiece":
            assert out.columns == docs.columns
    kept = {r["text"] for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert None not in kept and "" not in kept and " " not in kept and TEXT in kept
