"""Repeated sentence spans against a plain grouping of all spans of a table."""

import collections

import numpy as np
import pytest

pytest.importorskip("stocktide.llm")

from pyspark.sql import functions as F  # noqa: E402

from stocktide.llm import sentences as S  # noqa: E402

SF = "/root/testdata/sf0.001"


def plain(rows, least_sentences=2, least_words=12):
    """{(id, text): kept text}: every span of pieces tried, shortest from and back to each piece, grouped by its words."""
    seen = {}
    for i, text in sorted({(i if i is not None else 1 << 63, t or "") for i, t in rows}, key=lambda x: (x[0], th(x[1]))):
        words, before, places = S.pieces(text)
        n = len(before) - 1
        enough = lambda a, b: b - a >= least_sentences and before[b] - before[a] >= least_words
        found = {(a, min(b for b in range(a, n + 1) if enough(a, b))) for a in range(n) if enough(a, n)}
        found |= {(max(a for a in range(b) if enough(a, b)), b) for b in range(1, n + 1) if enough(0, b)}
        for a, b in sorted(found):
            key = tuple(tuple(words[x:y]) for x, y in zip(before[a:b], before[a + 1:b + 1]))
            seen.setdefault(key, []).append((i, text, places[a], places[b]))
    gone = collections.defaultdict(set)
    for places in seen.values():
        first = min(places, key=lambda p: (p[0], th(p[1]), p[2]))
        for p in places:
            if p != first:
                gone[p[0], p[1]].update(range(p[2], p[3]))
    return {(i if i < 1 << 63 else None, t): "".join(c for k, c in enumerate(t) if k not in gone[i, t]) for i, t in {(i if i is not None else 1 << 63, t or "") for i, t in rows}}


TH = {}


def th(text):
    return TH[text]


def learned(spark, rows):
    texts = sorted({t or "" for _, t in rows})
    TH.update({r.t: r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()})


def kept(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


def wanted(rows):
    found = plain(rows)
    return collections.Counter((i, found[i, t or ""]) for i, t in rows)


def test_the_given_table_against_all_spans(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    learned(spark, rows)
    got = S.remove_repeats(spark.read.parquet(f"{SF}/documents.parquet"))
    assert kept(got) == wanted(rows)
    assert sum(r.n_removed for r in got.collect()) == sum(len(t or "") for _, t in rows) - sum(len(t) for _, t in wanted(rows).elements())


@pytest.mark.parametrize("buffer", [1, 40, 1 << 19])
def test_copies_missing_ids_and_hot_passages(spark, buffer, monkeypatch):
    monkeypatch.setattr(S, "BUFFER", buffer)
    rng = np.random.default_rng(11)
    line = lambda n: " ".join("w%d" % rng.integers(300) for _ in range(n)) + ". "
    hot = line(9) + line(30) + line(8)
    rows = [(int(rng.integers(0, 40)) if k % 7 else None, line(rng.integers(1, 20)) + (hot if k % 3 == 0 else "") + line(rng.integers(1, 40)) + (hot if k % 9 == 0 else "")) for k in range(90)]
    rows += rows[:10] + [(1, None), (2, ""), (3, " \n "), (0, hot), (-1, hot * 3), (None, hot)]
    learned(spark, rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert kept(S.remove_repeats(df)) == wanted(rows)


def test_columns_of_any_name_and_type_pass_through(spark):
    passage = "One two three four five six. Seven eight nine ten eleven twelve. Thirteen more words are here now."
    rows = [(1, f"Start. {passage}"), (2, f"Begin! {passage} End of it."), (3, passage), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({
        "_id": F.lit("a"), "_th": F.array(F.lit(1)), "_starts": F.lit(2.5), "_ends": F.lit(None).cast("date"), "places": F.lit(True), "row": F.lit(7), "id": F.lit("i"),
        "th": F.struct(F.lit(1).alias("x")), "a.b": F.lit("dot"), "n_chars": F.length("text")})
    out = S.drop_repeats(df)
    assert out.schema.simpleString() == df.schema.simpleString()
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == {1, 2, 4} and got[4].text is None and got[4].n_chars is None
    assert got[2].text == "Begin! End of it." and got[2].n_chars == len(got[2].text) and got[2]["a.b"] == "dot" and got[2].th.x == 1


def test_ranges_of_one_text_are_merged():
    id_, th_ = np.array([1, 1, 1, 2, 1, 2]), np.array([5, 5, 5, 5, 6, 5])
    place = np.array([a << 32 | b for a, b in [(0, 4), (9, 12), (3, 6), (6, 9), (6, 9), (0, 6)]])
    a, b, c = S._merged(id_, th_, place)
    assert list(zip(a.tolist(), b.tolist(), (c >> 32).tolist(), (c & 0xFFFFFFFF).tolist())) == [(1, 5, 0, 6), (1, 5, 9, 12), (1, 6, 6, 9), (2, 5, 0, 9)]


def test_scripts_without_spaces(spark):
    shared = "昨日は朝から雨が降っていたので私たちは家で本を読みました。午後には晴れて近くの公園まで散歩に出かけました。"
    rows = [(1, f"最初の文です。{shared}"), (2, f"まったく別の始まり方をする文章です。{shared}終わり。"), (3, "这是一段没有重复的中文文字。它只出现一次。")]
    got = {r.doc_id: r.text for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "まったく別の始まり方をする文章です。終わり。", 3: rows[2][1]}
