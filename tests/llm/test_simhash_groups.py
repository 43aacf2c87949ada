"""One document of each SimHash component stays."""

import collections

import numpy as np
import pytest

pytest.importorskip("stocktide.llm")

from pyspark.sql import functions as F  # noqa: E402

from stocktide.llm import components, simhash  # noqa: E402

SF = "/root/testdata/sf0.001"


def bits(text, width=4):
    """The fingerprint word by word: a bit is set if it is in over half of the shingle hashes."""
    import re

    import xxhash

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def first_of_groups(rows):
    """Keys (id, text) of the smallest document of each group of chained links."""
    keys = sorted({(i is None, i or 0, t or "") for i, t in rows})
    prints = np.array([bits(t) for _, _, t in keys], dtype=np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None]) <= 4
    group = np.arange(len(keys))
    for _ in keys:
        new = np.array([group[n].min() for n in near])
        if (new == group).all():
            break
        group = new
    return keys, group


def test_the_given_table_keeps_one_of_each_group(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    keys, group = first_of_groups(rows)
    want = {keys[g][1] for g in set(group.tolist())}
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want and len(want) < len(rows)
    prints = {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.fingerprints(docs).collect()}
    assert prints == {i: bits(t) for i, t in rows}


def test_odd_rows_and_clashing_columns(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(5, " ".join(words)), (3, " ".join(words[:-1] + ["other"])), (9, " ".join(words)), (9, " ".join(words)), (None, " ".join(words)), (1, None), (2, ""), (2, " \n"),
            (7, "a b"), (8, "A B"), (4, "something else altogether that is long enough"), (None, "x y z"), (None, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("i"), "th": F.lit(None), "fp": F.lit(1.5), "root": F.lit("r"), "row": F.lit(0)})
    keys, group = first_of_groups(rows)
    best = {g: min((keys[k] for k in range(len(keys)) if group[k] == g), key=lambda x: x[:2])[:2] for g in set(group.tolist())}
    got = simhash.keep_first(df).collect()
    assert {(r.doc_id is None, r.doc_id or 0) for r in got} == set(best.values())
    assert collections.Counter(r.text for r in got)["x y z"] == 2  # equal rows stay together
    assert simhash.keep_first(df.limit(0)).columns == df.columns and {r.fp for r in got} == {1.5}


def sent(df):
    """The parts of the plan below each broadcast: what Spark would gather in the driver on its own sizes."""
    lines = df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0].splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            yield "\n".join(lines[i + 1:end])


def test_the_keys_of_all_tables_are_not_sent_to_the_driver(spark):
    prints = spark.range(4000).select(F.xxhash64(F.col("id") % 3000).alias("fp")).distinct()
    links = simhash.near_links(prints)
    assert "SortMergeJoin" in links._jdf.queryExecution().executedPlan().toString() and not list(sent(links))
    assert not links.collect()  # random fingerprints are far apart


def test_links_are_not_sent_to_the_driver(spark, monkeypatch):
    written, kept = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, label: (written.append((label, df)), kept(df, label))[1])
    # A chain of links in ids, some twice, and a pair beside it.
    links = spark.range(0, 40).selectExpr("explode(array(id, id, id + 1)) a", "id + 1 b").union(spark.createDataFrame([(900, 901), (901, 900)], "a long, b long"))
    roots = {r.node: r.root for r in components.components(links).collect()}
    assert roots == {i: 0 for i in range(41)} | {900: 900, 901: 900}
    assert {label for label, _ in written} == {"links", "large", "small"} and not [x for _, df in written for x in sent(df) if "Aggregate" not in x]


def repeated_rows(spark):
    """Pairs of documents with one text, whose rows come ten times in a row and so make short files of fingerprints."""
    return spark.range(0, 6000, 1, 4).selectExpr("id div 10 doc_id", "concat_ws(' ', transform(sequence(1, 30), x -> hash(x, id div 20))) text")


def test_fingerprints_of_repeated_rows_are_not_sent_to_the_driver_by_the_pipeline(spark):
    left = simhash.keep_first(repeated_rows(spark))
    assert collections.Counter(r.doc_id for r in left.collect()) == {i: 10 for i in range(0, 600, 2)}
    assert not [x for x in sent(left) if "Aggregate" not in x and "fingerprints-" in x]


def test_fingerprints_of_repeated_rows_are_not_sent_to_the_driver_by_op5(spark):
    found = simhash.near_duplicates(repeated_rows(spark))
    assert collections.Counter((r.doc_id, r.component_id) for r in found.collect()) == {(i, i - i % 2): 10 for i in range(600)}
    assert not [x for x in sent(found) if "Aggregate" not in x and "fingerprints-" in x]
