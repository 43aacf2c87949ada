"""Awkward input across the text operators: workers without the package, empty tables, clashing columns, very long markup."""

import os
import subprocess
import sys
import textwrap
import time

import pytest

pytest.importorskip("stocktide.llm")

from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from stocktide.llm import decontaminate, dom, encode, language, sentences, sequences, simhash  # noqa: E402
from stocktide.llm.common import keyed  # noqa: E402
from stocktide.session import work_path  # noqa: E402

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_workers_need_no_copy_of_the_package(tmp_path):
    """All operators in a session of their own, whose workers cannot import the package."""
    script = tmp_path / "run.py"
    script.write_text(textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        import __spark_entry__ as entry
        from stocktide.session import build_session
        spark = build_session("alone", "local[8]", **{{"spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false"}})

        def importable(_):
            import importlib.util
            yield importlib.util.find_spec("stocktide") is not None

        assert spark.sparkContext.parallelize([0], 1).mapPartitions(importable).collect() == [False]
        for name, build in entry.queries().items():
            if name == "pipeline" or name.startswith("op") and name[2].isdigit():
                assert build(spark, {SF!r}).count() > 0, name
        print("all ran")
    """))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != ROOT)}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "all ran" in done.stdout, done.stderr[-3000:]


def test_empty_tables_of_every_operator(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    none, items = docs.limit(0), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert language.predict(none, language.fit(docs)).count() == language.predict(none, language.fit(none)).count() == 0
    folder = work_path(spark, "none")
    assert sequences.read_back(sequences.write_sequences(none, folder), folder).count() == 0
    assert decontaminate.leaks(keyed(none, "doc_id", "text"), items).count() == 0
    assert decontaminate.leaks(keyed(docs, "doc_id", "text"), items.limit(0)).count() == 0
    assert decontaminate.drop_leaking(docs, items.limit(0)).count() == docs.count()
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert dom.extract(pages.limit(0), dom.fit(pages)).count() == dom.extract(pages.limit(0), dom.fit(pages.limit(0))).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, none, SF)
        assert out.count() == 0 and out.columns == docs.columns
    assert encode.encode_digest(none).count() == 0


def test_stages_keep_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).withColumns({
        "_id": F.lit("a"), "_th": F.lit(1.5), "_starts": F.lit(None).cast("date"), "_ends": F.array(F.lit(1)), "_gone_id": F.lit("g"), "_gone_th": F.lit(True),
        "id": F.lit("i"), "th": F.lit("t"), "row": F.lit(3), "places": F.lit(4), "bucket": F.lit(5), "cls": F.lit(6)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        first = docs.first()
        assert (first["_id"], first["_th"], first["_starts"], first["_ends"], first["_gone_id"], first["_gone_th"], first["cls"]) == ("a", 1.5, None, [1], "g", True, 6)
    assert simhash.keep_first(docs).columns == sentences.drop_repeats(docs).columns == docs.columns


def test_language_stage_drops_what_has_no_learned_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    junk = [(900001, "1234 5678 !!!", None), (900002, None, None), (900003, "昨日は朝から雨が降っていたので私たちは家で本を読みました。" * 20, None),
            (900004, "привет как дела сегодня хорошая погода и мы пошли гулять в парк " * 20, None), (900005, "", "en")]
    both = docs.unionByName(spark.createDataFrame(junk, docs.schema))
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, both, SF).collect()}
    assert kept == {r.doc_id for r in docs.collect()}


@pytest.mark.parametrize("source", ["<a " * 350_000, "<b>" * 100_000 + "</i>" * 100_000, '<a ">" ' * 100_000 + '"', "<p><li>" + "<b>" * 20_000 + "<h1></h1>" * 20_000, "<!-- " * 200_000,
                                    "<a '" * 200_001 + ">x", "<script>" * 100_000, "</" * 500_000])
def test_long_markup_takes_linear_time(source):
    began = time.process_time()
    page = dom.Page(source)
    page.features()
    assert time.process_time() - began < 2


def test_marks_end_where_their_quotes_allow():
    text = lambda s: "".join(t for _, t in dom.Page(s).texts).split()
    assert text("<p title='a > b'>one</p> two") == ["one", "two"]
    assert text('<p title="x>one</p>two') == ["one", "two"]  # the quotation mark is never closed
    assert text("one <b two") == ["one", "<b", "two"]
    assert text("one <!-- two > three") == ["one"]
    assert text("one <!-- two --> three <!doctype x> four") == ["one", "three", "four"]
