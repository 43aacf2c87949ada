"""The text operators against brute force and the tokenizers library, on small frames with awkward rows."""

import collections
import hashlib
import itertools
import re
import struct
import zlib

import numpy as np
import pytest

pytest.importorskip("stocktide.llm")

from pyspark.sql import functions as F  # noqa: E402

from stocktide.llm import bpe, decontaminate, dom, encode, imatch, language, repeats, sentences, sequences, simhash, token_count  # noqa: E402
from stocktide.llm.common import keyed  # noqa: E402
from stocktide.llm.suffixes import RunIndex  # noqa: E402
from stocktide.session import work_path  # noqa: E402

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (2, ""), (3, "a"), (3, "a"), (None, "x y z"), (4, "été là. <|endoftext|> b\n\n c"), (5, "a" * 3000), (6, "ab \x1c\x00 \t\n '!s it's")]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with an extra column whose name an operator might use."""
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("th", F.lit(0))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def byte_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path("byte_bpe_50k.json"))


def rows(df):
    return collections.Counter(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.collect())


@pytest.mark.parametrize("leaf", [7, 64, 16384])
def test_encoding_equals_the_library(odd, byte_library, leaf):
    want = collections.Counter()
    for i, t in ODD:
        ids = byte_library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256(byte_library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert rows(encode.encode_digest(odd, leaf=leaf)) == want


def test_counts_equal_the_library(odd, docs, byte_library):
    want = collections.Counter((i, len((t or "").encode()), len(byte_library.encode(t or "", add_special_tokens=False).ids)) for i, t in ODD)
    assert rows(token_count.token_counts(odd).drop("over_limit")) == want
    counts = {r.doc_id: r.n_tokens for r in token_count.token_counts(docs).collect()}
    assert all(counts[r.doc_id] == len(byte_library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect())


def test_sequences_read_back(spark, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path("word_bpe_49k.json"))
    folder = work_path(spark, "test-sequences")
    index = sequences.write_sequences(odd, folder, length=16)
    got = sequences.read_back(index, folder).orderBy("start").collect()
    want = collections.Counter()
    for i, t in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want[i, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    first = index.orderBy("shard", "first").first()
    ids, mask = sequences.SequenceReader(folder, first["file"]).sequence(0)
    assert len(ids) == len(mask) == 16 and not ids.flags.owndata


def test_languages_of_held_out_rows(docs, odd, spark):
    model = language.fit(docs)
    found = {r.doc_id: r.lang_pred for r in language.predict(docs, model).collect()}
    truth = docs.where(language.held_out()).where("lang is not null").collect()
    assert np.mean([found[r.doc_id] == r.lang for r in truth]) > 0.97
    assert {(r.doc_id, r.lang_pred) for r in language.predict(odd, model).collect() if r.doc_id in (1, 2)} == {(1, "und"), (2, "und")}
    assert language.predict(odd, language.fit(docs.limit(0))).where("lang_pred != 'und'").count() == 0
    assert language.keep_determined(docs, model).count() == docs.count()
    half = spark.createDataFrame([(1, "the and of thth " * 40 + "für enau sch der ung " * 40)], "doc_id long, text string")
    assert language.predict(half, model).first()["langs"] != ""


def test_simhash_links_every_pair_within_the_radius(docs, odd):
    found = simhash.near_duplicates(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    v = found.fp.to_numpy().view(np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 4
    label = np.arange(len(v))
    for _ in range(len(v)):
        new = np.where(near, label[None, :], len(v)).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert found.component_id.tolist() == found.doc_id.to_numpy()[label].tolist()
    assert simhash.near_duplicates(odd).count() == len(ODD)
    assert simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_covering_masks(radius):
    masks, rng = simhash.covering_masks(radius), np.random.default_rng(3)
    for _ in range(500):
        difference = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
        assert any(difference & m == 0 for m in masks)


def test_latin_words_are_cut_without_the_library(monkeypatch):
    """Words of ASCII and Latin letters have the ids of the library, without a call of its normalizer for each."""
    import tokenizers

    text = bpe.read_text(bpe.default_path("word_bpe_49k.json"))
    library = tokenizers.Tokenizer.from_str(text)
    calls = []

    class Normal:
        def normalize_str(self, word):
            calls.append(word)
            return library.normalizer.normalize_str(word)

    class Spy:
        normalizer = Normal()
        from_str = classmethod(lambda cls, _: cls())
        __getattr__ = lambda self, name: getattr(library, name)

    monkeypatch.setattr(tokenizers, "Tokenizer", Spy)
    encoder, rng = sequences.WordEncoder(text), np.random.default_rng(2)
    letters = [chr(c) for c in [*range(33, 127), *range(0xC0, 0x100)] if chr(c) not in "×÷"] + ["Œ", "œ", "'s", "'LL"]
    words = ["".join(rng.choice(letters, rng.integers(1, 12))) for _ in range(5000)] + letters
    for word in words:
        assert encoder.ids(word) == np.array(library.encode(word, add_special_tokens=False).ids, dtype="<u2").tobytes()
    assert not calls
    odd = ["e\u0301té", "İı", "ΑΣ", "ﬁn", "a×b÷c", "語é", "\u0149ſŸ", "٣²"]
    for word in odd:
        assert encoder.ids(word) == np.array(library.encode(word, add_special_tokens=False).ids, dtype="<u2").tobytes()
    assert calls == odd


def _brute_repeats(pairs):
    seen, out = set(), {}
    for i, t in pairs:
        raw = (t or "").encode()
        cover = np.zeros(len(raw), dtype=bool)
        for s in range(len(raw) - 99):
            if raw[s:s + 100] in seen:
                cover[s:s + 100] = True
            seen.add(raw[s:s + 100])
        out[i] = (len(raw), int(cover.sum()), bytes(np.frombuffer(raw, dtype=np.uint8)[~cover]) if raw else b"")
    return out


@pytest.mark.parametrize("variants", [4096, 2])
def test_suffix_repeats(spark, docs, variants):
    rng = np.random.default_rng(5)
    base = "".join(rng.choice(list("abcdefg "), 1500))
    cases = [(i, "".join(base[a:a + int(rng.integers(20, 300))] for a in rng.integers(0, 1300, 4)) + "xy" * int(rng.integers(0, 90))) for i in range(60)]
    cases += [(100, None), (101, ""), (102, "é" * 200)] + [(r.doc_id + 1000, r.text) for r in docs.orderBy("doc_id").limit(40).collect()]
    want = _brute_repeats(cases)
    df = spark.createDataFrame(cases, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in repeats.remove_repeats(df, variants=variants).collect()}
    assert got == want


def test_bundles_stream_no_settled_window_again(monkeypatch):
    """Marks are those of brute force; of a large group whose windows are settled early, little is indexed."""
    rng, reach = np.random.default_rng(7), 38
    texts = [bytes(rng.integers(97, 99, 2 * reach).astype(np.uint8)) for _ in range(6)]
    groups, lefts, rights = [], [], []
    for g, size in enumerate([64, 1, 2, 33, 7]):
        for _ in range(size):
            a, b = texts[rng.integers(6)], texts[rng.integers(6)]
            groups.append(g)
            lefts.append(a[:reach][int(rng.integers(0, 3)) * 15:])
            rights.append(b[:int(rng.integers(0, 4)) * 13])
    want, seen = set(), set()
    for i, (g, left, right) in enumerate(zip(groups, lefts, rights)):
        for o in range(max(0, reach - len(right)), len(left) + 1):
            window = (g, o, left[len(left) - o:] + right[:reach - o])
            if window in seen:
                want.add((i, -o))
            seen.add(window)
    indexed, build = [], repeats.RunIndex
    monkeypatch.setattr(repeats, "RunIndex", lambda text: indexed.append(len(text)) or build(text))
    who, where = repeats.bundle_marks(np.array(groups), lefts, rights, reach)
    assert set(zip(who.tolist(), where.tolist())) == want and len(who) == len(want)
    assert sum(indexed) < sum(len(a) + 2 + len(b) for a, b in zip(lefts, rights))


def test_crowded_anchor_without_common_halves_is_not_split(spark, monkeypatch):
    """Occurrences of an anchor that share its halves in small groups stay in small groups, however many they are."""
    rng = np.random.default_rng(11)
    noise = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    many = noise(200000)
    at = int(repeats.anchor_places(many.encode(), np.array([len(many)]), len(many))[0][0])
    anchor, cases = many[at:at + repeats.ANCHOR], []  # its hash is so low that windows choose it
    for i in range(24):
        left, right = noise(90), noise(90)
        cases += [(4 * i + j, noise(60) + (left if j < 3 else noise(90)) + anchor + (right if j > 0 else noise(90)) + noise(60)) for j in range(4)]
    made, split = [], repeats._split
    monkeypatch.setattr(repeats, "_split", lambda large, length: made.append(large.count()) or split(large, length))
    got = {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in repeats.remove_repeats(spark.createDataFrame(cases, "doc_id long, text string"), variants=8).collect()}
    assert got == _brute_repeats(cases)
    assert made == [0]


def test_matching_statistics():
    rng = np.random.default_rng(1)
    text = np.concatenate([np.append(rng.integers(0, 3, 20), 10 + i) for i in range(6)])
    patterns = rng.integers(0, 4, (8, 15))
    got = RunIndex(text).matching_statistics(patterns)
    flat = ",".join(map(str, text)) + ","
    for i, j in np.ndindex(*patterns.shape):
        size = 0
        while j + size < 15 and re.search("(^|,)" + ",".join(map(str, patterns[i, j:j + size + 1])) + ",", flat):
            size += 1
        assert got[i, j] == size


def removed(first, second):
    """Words of the second text that no span of the first and of it covers, as drop_repeats would leave them."""
    known = {h for h, _, _ in sentences.spans(first, 2, 12)}
    cut = [(s, e) for h, s, e in sentences.spans(second, 2, 12) if h in known]
    return sentences.cut_out(second, [s for s, _ in cut], [e for _, e in cut])[0].split() if cut else None


@pytest.mark.parametrize("lengths", [[54], [26, 27], [30, 30], [18, 18, 18], [10, 11, 12, 13, 10]])
def test_spans_of_passages_inside_sentences(lengths):
    rng = np.random.default_rng(3)
    word = lambda: "w%d" % rng.integers(2000)
    glue = lambda: " ".join(word() for _ in range(rng.integers(1, 21)))
    for _ in range(200):
        names = iter(rng.permutation(5000))
        own = [["p%d" % next(names) for _ in range(n)] for n in lengths]
        passage = ". ".join(" ".join(s) for s in own)
        left = removed(f"{glue()} {passage} {glue()}.", f"{glue()} {passage} {glue()}.")
        assert left is not None
        stay = [k for k, w in enumerate(w for s in own for w in s) if w in left or w + "." in left]
        assert all(k < 20 or k >= sum(lengths) - 20 for k in stay)


def test_spans_cover_whole_repeated_sentences():
    rng = np.random.default_rng(4)
    line = lambda n: " ".join("w%d" % rng.integers(2000) for _ in range(n)) + ". "
    for _ in range(300):
        a, b = rng.integers(6, 40, 2)
        passage = line(a) + line(b)
        before = line(8)
        assert removed(line(9) + passage + line(7), before + passage + "End here.") == (before + "End here.").split()


def test_sentence_spans(spark, odd):
    passage = "One two three four five six. Seven eight nine ten eleven twelve. Thirteen more words are here now."
    df = spark.createDataFrame([(1, f"Start of one. {passage} End of one."), (2, f"Another begin! {passage} Another end."), (3, "Clean text stays. All of it stays as it was written here today.")],
                               "doc_id long, text string").withColumn("n_chars", F.length("text"))
    kept = {r.doc_id: r.text for r in sentences.drop_repeats(df).collect()}
    assert kept[1].count("Thirteen") == 1 and "Thirteen" not in kept[2] and kept[2].startswith("Another begin!") and kept[3] == df.collect()[2].text
    assert sentences.remove_repeats(odd).count() == len(ODD)


def test_leaks_tolerate_substitutions(spark, docs, odd):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma"
    changed = item.replace("gamma", "gimel").replace("kappa", "kaf")
    items = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    df = spark.createDataFrame([(1, f"before {item.upper()}, after"), (2, f"x {changed} y"), (3, "alpha beta gamma something else"), (4, None)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(keyed(df, "doc_id", "text"), items).collect()} == {(1, 7), (2, 7)}
    small = decontaminate.leaks(keyed(df, "doc_id", "text"), items, block_bytes=10)
    assert {r.doc_id for r in small.collect()} == {1, 2}
    assert {r.doc_id for r in decontaminate.drop_leaking(df, items).collect()} == {3, 4}
    assert decontaminate.drop_leaking(odd, items).count() == len(ODD)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")

    def norm(t):
        return " ".join(re.findall(r"[^\W_]+", (t or "").lower()))

    planted = {(d.doc_id, b.item_id) for d in docs.collect() for b in bench.collect() if norm(b.text) and f" {norm(b.text)} " in f" {norm(d.text)} "}
    assert planted <= {(r.doc_id, r.item_id) for r in decontaminate.leaks(keyed(docs, "doc_id", "text"), bench).collect()}


def leaking(text, item, **more):
    """(agreeing words, length, first word) of the overlap of two lists of words, or None."""
    found = list(decontaminate.overlaps([" ".join(text)], decontaminate.Items([(7, " ".join(item))], more.get("least_words", 13)), more.get("least_words", 13), 0.8))
    return found[0][2:] if found else None


def altered(item, changed, around=6):
    foreign = [f"f{i}" for i in range(around)]
    return [*foreign, *(f"x{i}" if i in changed else w for i, w in enumerate(item)), *foreign[::-1]]


@pytest.mark.parametrize("words", range(5, 19))
def test_leaks_of_whole_items_under_all_substitutions(words):
    item = [f"w{i}" for i in range(words)]
    for n in range(words // 5 + 1):
        for changed in itertools.combinations(range(words), n):
            same, length, _ = leaking(altered(item, changed), item)
            assert same * 5 >= length * 4 and length >= min(words, 13)
    if words < 13:  # one change too many; a longer item may hold a shorter good stretch
        assert all(leaking(altered(item, c), item) is None for c in itertools.combinations(range(words), words // 5 + 1))


def test_leaks_of_passages_inside_altered_items():
    for runs in ([20, 9, 20, 9, 20], [30, 14, 30, 14, 30]):
        item = [f"w{i}" for i in range(sum(runs))]
        starts = np.cumsum([0, *runs])
        changed = {i for k in (1, 3) for i in range(starts[k], starts[k + 1])}
        assert leaking(altered(item, changed), item)[0] >= runs[0]
    item = [f"w{i}" for i in range(100)]
    assert leaking(altered(item, {i for i in range(100) if not 40 <= i < 60 and i % 4 == 0}), item)[0] >= 20
    assert leaking(altered(item, {i for i in range(100) if i % 3 == 0}), item) is None
    assert leaking(altered(item, {i for i in range(100) if not 40 <= i < 48}), item) is None
    assert leaking(altered(item, {i for i in range(100) if not 40 <= i < 48}), item, least_words=8) is not None


def test_longest_stretch_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(300):
        same = rng.random(int(rng.integers(1, 60))) < rng.choice([0.6, 0.75, 0.9])
        for least in (5, 13):
            want = max((e - s for s in range(len(same)) for e in range(s + least, len(same) + 1) if 5 * same[s:e].sum() >= 4 * (e - s)), default=0)
            got = decontaminate.best_stretch(same, 0.8, least)
            assert (got is None) == (want == 0)
            if got:
                start, end, n = got
                assert n == same[start:end].sum() and least <= end - start <= want and 5 * n >= 4 * (end - start)


def test_imatch_edits(docs, odd):
    texts = [(r.doc_id, r.text) for r in docs.orderBy(F.desc("doc_id")).collect()]
    got = {r.doc_id: r for r in imatch.compare_edits(docs, imatch.lexicon(docs)).collect()}
    for (i, t), (_, after) in zip(texts, texts[1:] + texts[:1]):
        half = len(t) // 2
        assert got[i].edited_sha256 == hashlib.sha256((t[:len(t) - half] + after[:half]).encode()).hexdigest()
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.7
    by_text = collections.defaultdict(set)
    for i, t in texts:
        by_text[t].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert imatch.compare_edits(odd, imatch.lexicon(odd)).count() == len(ODD)


@pytest.mark.parametrize("hot", [None, 50])
def test_imatch_splits_an_id_that_many_rows_share(spark, hot):
    """All rows in their order by id and text hash, whatever ranges they fall into."""
    given = [(i, f"text {i} " * 5) for i in range(100) if i != hot] + [(hot, f"other {i} " * 7) for i in range(900)]
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(5)
    sizes = {r["range"]: r["count"] for r in imatch.in_order(keyed(df, "doc_id", "text"), 8).where("not guest").groupBy("range").count().collect()}
    assert sum(sizes.values()) == len(given) and max(sizes.values()) < 300
    ordered = [r.text for r in keyed(df, "doc_id", "text").orderBy(F.desc("id"), F.desc("th")).collect()]
    want = collections.Counter()
    for t, after in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(t) // 2
        want[hashlib.sha256((t[:len(t) - half] + after[:half]).encode()).hexdigest()] += 1
    got = imatch.compare_edits(df, imatch.lexicon(df), parts=8)
    assert collections.Counter(r.edited_sha256 for r in got.collect()) == want


def test_main_text(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = dom.fit(pages)
    for r in pages.limit(20).collect():
        page = dom.Page(r.html)
        assert page.text(page.decode(model.odds(page.features()))) == page.text(page.labels())
    odd_pages = spark.createDataFrame([(1, None, None), (1, None, None), (2, "u", ""), (3, "u", "<<b>x &lt; <script>if(a<b)")], "page_id long, url string, html string")
    assert dom.extract(odd_pages, model).count() == 4 and dom.extract(odd_pages, dom.fit(odd_pages)).count() == 4


def test_decoding_is_consistent():
    page = dom.Page("<div><article><p>a</p><div class=ad><p>b</p></div></article><p>c</p></div>")
    chosen = page.decode(np.random.default_rng(2).normal(size=len(page.parent)))
    for i in range(1, len(chosen)):
        ups, p = [], i
        while p > 0:
            ups.append(bool(chosen[p]))
            p = page.parent[p]
        assert "".join("10"[not c] for c in reversed(ups)).count("01") <= 1  # no path enters the article twice


@pytest.mark.parametrize("name", ["op1_bpe_encode", "op2_language_mixture", "op4_suffix_repeats", "op5_simhash_components", "op6_imatch_fingerprints", "op7_token_counts", "op9_sentence_spans"])
def test_query_has_a_row_for_each_document(spark, docs, name):
    import __spark_entry__ as entry

    assert entry.queries()[name](spark, SF).select("doc_id").distinct().count() == docs.count()


def test_empty_tables(docs, spark):
    none = docs.limit(0)
    assert encode.encode_digest(none).count() == token_count.token_counts(none).count() == 0
    assert simhash.near_duplicates(none).count() == repeats.remove_repeats(none).count() == sentences.remove_repeats(none).count() == 0
    assert imatch.compare_edits(none, imatch.lexicon(none)).count() == 0
    assert simhash.keep_first(none).count() == 0 and simhash.keep_first(none).columns == none.columns


def test_training_takes_a_text_once(spark):
    """A text that holds most rows neither fills the sample nor the counts."""
    many = spark.createDataFrame([("a", "hot text")] * 500 + [("a", f"cold {i}") for i in range(20)] + [("b", "other")], "lang string, text string")
    once = spark.createDataFrame([("a", "hot text")] + [("a", f"cold {i}") for i in range(20)] + [("b", "other")], "lang string, text string")
    for n in (10, 5000):
        assert (language.train(many, rows=n)[1] == language.train(once, rows=n)[1]).all()


def test_pipeline(spark, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontamination", "bpe_encoding"]
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, SF)
        assert step.columns == docs.columns
    kept = {r.doc_id for r in step.collect()}
    final = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in final.collect()} == kept and 0 < len(kept) < docs.count()
